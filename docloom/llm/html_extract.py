"""HTML main text by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import ast
import hashlib
import html as _html
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, ship

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+(?P<rest>[^>]*+))(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
#: Element names. RAW elements hold text that is not markup.
RAW = frozenset("script style textarea xmp iframe noembed noframes title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("head nav footer aside form script style textarea xmp iframe noembed noframes title noscript template select option button svg object audio video canvas dialog menu".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside caption".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body".split())
SAME = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
#: Words of class, id and role that mark what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion sidebar sidebars side nav navbar navigation menu menus "
    "breadcrumb breadcrumbs header masthead topbar footer foot copyright comment comments commentlist disqus reply replies respond discussion notice notices cookie cookies consent "
    "gdpr popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended widget toolbar pagination pager skip search complementary contentinfo".split()
)
MAIN = frozenset("article main".split())
ELSEWHERE = frozenset("has with no without is not".split())
#: Longest group that is looked for as a repetition, and the nodes of a wrapper beyond which it keeps only those that
#: all pages have. Optional nodes tell no template text, so what is dropped decides nothing.
PERIOD, MAX_NODES = 12, 4096
#: Partial wrappers of a host that one task merges, about.
FAN = 16
#: Longest text that stands for itself in a wrapper (longer ones by a digest), and the different main contents of a host's pages from which template texts are told.
PLAIN_CHARS, LEAST_PAGES = 32, 3
NOT_NOISE = ("#a", "#o")
#: Wrapper tables up to this many bytes are sent to every executor; larger ones are joined to the pages by host.
MAX_BROADCAST = 32 << 20


def _noise(name: str, attrs: str, zone: str) -> tuple[bool, bool]:
    """Whether class, id or role mark an element as noise, or as the main content.

    A name like ``has-sidebar`` tells of something elsewhere. An article is noise only by a whole name (``comment``,
    not ``comments-open``), and a header inside it holds its title.
    """
    bad = main = False
    for m in _ATTR.finditer(attrs):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            words = _WORDS.findall(token)
            main |= m[1].lower() == "role" and token == "main"
            if words and words[0] not in ELSEWHERE:
                marks = NOISE.intersection([token] if name in MAIN else words)
                bad |= bool(marks - {"header"} if zone == "a" else marks)
    return bad, main


class Page:
    """The token stream of one page: symbols of tags and of texts, with the texts beside them.

    A text's symbol tells where it stands: ``#a`` in the article, ``#n`` in noise, ``#o`` elsewhere, and the element that
    holds it. With that, and the element in the symbol of its end, only places of one kind are aligned.
    """

    def __init__(self, source: str) -> None:
        self.symbols: list[str] = []
        self.texts: list[tuple[int, str]] = []  # block number and decoded text, by text symbol
        self._block = 0
        stack: list[tuple[str, str, str]] = []  # name, zone inside, symbol
        at, n = 0, len(source)
        low: str | None = None
        while at < n:
            m = _MARKUP.search(source, at)
            self._text(source[at : m.start() if m else n], stack)
            if not m:
                break
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if m["rest"]:  # a quote that never closes: the tag ends at the first >
                at = source.find(">", m.start()) + 1 or n
            if m["end"]:
                self._close(name, stack)
                continue
            self._open(name, m["attrs"] or "", stack)
            if name in RAW:
                low = low if low is not None else source.lower() if source.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), source)
                end = low.find(f"</{name}", at)
                at = n if end < 0 else end

    def main(self) -> list[int]:
        """Numbers of the texts in the article; of those outside noise, where there is no article."""
        zones = [s[:2] for s in self.symbols if s[0] == "#"]
        zone = "#a" if "#a" in zones else "#o"
        return [k for k, z in enumerate(zones) if z == zone]

    def _symbol(self, s: str, name: str) -> None:
        if name in BLOCK:
            self._block += 1
        self.symbols.append(s)

    def _open(self, name: str, attrs: str, stack: list[tuple[str, str, str]]) -> None:
        if name in CLOSES_P:
            self._implied("p", stack, BLOCK - {"p"})
        if name in SAME:
            self._implied(name if name not in ("dt", "dd", "td", "th") else {"dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th"}[name], stack, frozenset(SAME[name].split()))
        zone = stack[-1][1] if stack else "o"
        bad, main = _noise(name, attrs, zone)
        if zone != "n" and name not in ("html", "body"):
            if name in OUT or bad or (name == "header" and zone != "a"):
                zone = "n"
            elif name in MAIN or main:
                zone = "a"
        words = sorted({w for m in _ATTR.finditer(attrs) if m[1].lower() != "id" for w in _WORDS.findall((m[2] or m[3] or m[4] or "").lower())})
        symbol = ".".join([f"<{name}", *words])
        self._symbol(symbol, name)
        if name == "br" and self.texts:  # a line break is white space
            block, text = self.texts[-1]
            self.texts[-1] = (block, text + " ")
        if name not in VOID:
            stack.append((name, zone, symbol))

    def _implied(self, names: str, stack: list[tuple[str, str, str]], border: frozenset[str]) -> None:
        wanted = names.split()
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in wanted:
                if stack[i][0] in BLOCK:
                    self._block += 1
                del stack[i:]
                return
            if stack[i][0] in border:
                return

    def _close(self, name: str, stack: list[tuple[str, str, str]]) -> None:
        symbol = f"<{name}"
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                symbol = stack[i][2]
                del stack[i:]
                break
        self._symbol(f"</{symbol[1:]}", name)

    def _text(self, raw: str, stack: list[tuple[str, str, str]]) -> None:
        if not raw or raw.isspace():
            if raw and self.texts:
                block, text = self.texts[-1]
                self.texts[-1] = (block, text + " ")
            return
        zone, symbol = stack[-1][1:] if stack else ("o", "")
        self.symbols.append(f"#{zone}{symbol}")
        self.texts.append((self._block, _html.unescape(raw)))


# A node is a symbol, or a tuple of nodes: a repeated group. A wrapper is a list of [node, optional, fixed], where
# fixed lists the keys of the texts that all pages have in this place (a place without one is a slot; None: there is no text).


def fold_repeats(symbols: Iterable) -> tuple[list, list[int]]:
    """The nodes of a stream in which tandem repetitions of up to ``PERIOD`` nodes are groups, and how many
    symbols each node covers."""
    out: list = []
    covers: list[int] = []
    for s in symbols:
        out.append(s)
        covers.append(1)
        changed = True
        while changed:
            changed = False
            for p in range(1, min(PERIOD, len(out) - 1) + 1):
                if isinstance(out[-p - 1], tuple) and len(out[-p - 1]) == p and out[-p - 1] == tuple(out[-p:]):
                    covers[-p - 1 :] = [sum(covers[-p - 1 :])]
                    del out[-p:]
                    changed = True
                    break
                if 2 * p <= len(out) and out[-1] == out[-p - 1] and out[-p:] == out[-2 * p : -p] and any(isinstance(x, str) and x[0] == "<" for x in out[-p:]):
                    covers[-2 * p :] = [sum(covers[-2 * p :])]
                    out[-2 * p :] = [tuple(out[-p:])]
                    changed = True
                    break
    return out, covers


def _groups(nodes: Iterable) -> set[tuple]:
    return {n for n in nodes if isinstance(n, tuple)}


def _regroup(items: list[list], groups: set[tuple]) -> list[list]:
    """Single occurrences of what is a repeated group elsewhere become that group, with all their texts. The group is
    optional if every occurrence has an optional node, and only the texts of other occurrences are sure to be there."""
    for g in sorted(groups, key=lambda g: (-len(g), repr(g))):
        i, k, out = 0, len(g), []
        while i < len(items):
            if items[i][0] == g[0] and tuple(x[0] for x in items[i : i + k]) == g:
                one = items[i : i + k]
                optional = any(x[1] for x in one)
                texts = [t for x in one for t in x[2] or ()] if not optional else []
                if out and out[-1][0] == g:
                    _, o, f = out[-1]
                    out[-1] = [g, o and optional, f if f is None else list(dict.fromkeys([*(() if o else f), *texts]))]
                else:
                    out.append([g, optional, list(dict.fromkeys(texts)) if _has_text(g) else None])
                i += k
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _skips(x: list, y: list) -> list[np.ndarray]:
    """For every pair of places, a bit: whether leaving out the one of ``x`` loses no more than leaving out that of ``y``."""
    number: dict = {}
    p, q = ([number.setdefault(n, len(number)) for n in side] for side in (x, y))
    equal = {n: np.equal(q, n) for n in set(p)}
    below = np.zeros(len(y) + 1, dtype=np.int32)  # the longest common subsequence of what is left, by place of y
    out = []
    for n in reversed(p):
        row = np.append(np.maximum(below[:-1], (below[1:] + 1) * equal[n]), 0)
        row = np.maximum.accumulate(row[::-1])[::-1].astype(np.int32)
        out.append(np.packbits(below[:-1] >= row[1:]))
        below = row
    return out[::-1]


def _align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of equal nodes in a longest common subsequence, after the common ends."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    pairs, i, j = [(k, k) for k in range(lo)], 0, 0
    skips = _skips(x, y) if x and y else []
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            pairs.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif skips[i][j >> 3] >> (7 - (j & 7)) & 1:
            i += 1
        else:
            j += 1
    return pairs + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


class Wrapper:
    """A union-free regular expression over tags and texts, with optional and repeated groups and text slots."""

    def __init__(self, items: list | None = None, mains: Iterable[str] = ()) -> None:
        self.items: list[list] = items or []
        self.mains = sorted(set(mains))[:LEAST_PAGES]  # digests of different main contents, as many as it takes

    @staticmethod
    def of(page: Page) -> Wrapper:
        texts = iter(page.texts)
        items = []
        flat = 0
        for node, n in zip(*fold_repeats(page.symbols), strict=True):
            inside = [next(texts)[1] for s in page.symbols[flat : flat + n] if s[0] == "#"]
            flat += n
            items.append([node, False, list(dict.fromkeys(map(text_key, inside))) if inside else None])
        return Wrapper(items, [_digest("\0".join(text_key(page.texts[k][1]) for k in page.main()))] if items else ())

    def nodes(self) -> list:
        return [i[0] for i in self.items]

    def merge(self, other: Wrapper) -> Wrapper:
        """The wrapper of both: what only one has is optional, groups repeat if they do in either, texts that differ are slots."""
        if not self.mains or not other.mains:  # no page; a wrapper may have pages and no nodes that all of them have
            return self if self.mains else other
        groups = _groups(self.nodes()) | _groups(other.nodes())
        a, b = Wrapper(_regroup(self.items, groups)), Wrapper(_regroup(other.items, groups))
        out: list[list] = []
        i = j = 0
        for x, y in [*_align(a.nodes(), b.nodes()), (len(a.items), len(b.items))]:
            out += [[n, True, f] for n, _, f in a.items[i:x]] + [[n, True, f] for n, _, f in b.items[j:y]]
            if x < len(a.items):
                (n, o, f), (_, p, g) = a.items[x], b.items[y]
                out.append([n, o or p, common(f, g)])
            i, j = x + 1, y + 1
        if len(out) > MAX_NODES:
            out = [x for x in out if not x[1]]
        return Wrapper(out, [*self.mains, *other.mains])

    def absorb(self, same: Wrapper) -> None:
        """Merge a page of the very same structure, in place."""
        self.mains = sorted({*self.mains, *same.mains})[:LEAST_PAGES]
        for a, b in zip(self.items, same.items, strict=True):
            if a[2] != b[2]:
                a[2] = common(a[2], b[2])

    def slots(self) -> tuple:
        """What pages need: the nodes, whether they are optional, and for every one its template texts, in places that all
        pages have; nothing if there are none outside noise. Copies of one page, or few pages, tell nothing about what is
        template, whatever changes around their main content."""
        if len(self.mains) < LEAST_PAGES:
            return ()
        out = tuple((n, optional, tuple(f) if f and not optional and _has_text(n, NOT_NOISE) else ()) for n, optional, f in self.items)
        return out if any(f for _, _, f in out) else ()

    def dump(self) -> str:
        return json.dumps([self.mains, self.items], ensure_ascii=False)

    @staticmethod
    def load(text: str) -> Wrapper:
        mains, items = json.loads(text)
        return Wrapper([[_tuples(n), o, f] for n, o, f in items], mains)


def _has_text(n, zones: tuple[str, ...] = ("#",)) -> bool:
    return any(_has_text(x, zones) for x in n) if isinstance(n, tuple) else n.startswith(zones)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).hexdigest()


def text_key(text: str) -> str:
    """A text as wrappers remember it: itself if it is short, else a digest and the length of all of it."""
    text = text.strip()
    return text if len(text) <= PLAIN_CHARS else f"{_digest(text)}:{len(text)}"


def common(f: list | None, g: list | None) -> list | None:
    if f is None or g is None:
        return None
    both = set(f).intersection(g)
    return [x for x in f if x in both]


def _tuples(n):
    return tuple(_tuples(x) for x in n) if isinstance(n, list) else n


class Slots:
    """A host's wrapper as its pages are read, with the alignments of the structures met."""

    MAX_MET = 256

    def __init__(self, slots: tuple) -> None:
        self.items = [[n, optional, frozenset(fixed)] for n, optional, fixed in slots]
        self.groups = _groups(n for n, _, _ in slots)
        self._met: dict[tuple, list[tuple[frozenset, list[int]]]] = {}

    def template_texts(self, page: Page) -> set[int]:
        """Numbers of the texts that stand where the wrapper has the same text on every page."""
        if not self.items:
            return set()
        nodes, extents = fold_repeats(page.symbols)
        key = tuple(nodes)
        if key not in self._met:
            if len(self._met) >= self.MAX_MET:
                self._met.clear()
            self._met[key] = self._places(nodes)
        number, at, inside = 0, 0, []
        for n in extents:
            inside.append(range(number, number := number + sum(s[0] == "#" for s in page.symbols[at : at + n])))
            at += n
        return {k for fixed, places in self._met[key] for j in places for k in inside[j] if text_key(page.texts[k][1]) in fixed}

    def _places(self, nodes: list) -> list[tuple[frozenset, list[int]]]:
        """Template texts, and the numbers of the nodes that may hold them."""
        groups = self.groups | _groups(nodes)
        wrapper, own = _regroup(self.items, groups), _regroup([[n, False, [j]] for j, n in enumerate(nodes)], groups)
        pairs = _align([i[0] for i in wrapper], [i[0] for i in own])
        return [(frozenset(wrapper[i][2]), own[j][2]) for i, j in pairs if wrapper[i][2] and not wrapper[i][1]]


def main_text(page: Page, slots: Slots | None = None) -> str:
    """The article's blocks (a page without an article element: all blocks outside noise) without template texts."""
    fixed = slots.template_texts(page) if slots else ()
    kept = [page.texts[k] for k in page.main() if k not in fixed]
    blocks: dict[int, list[str]] = {}
    for block, text in kept:
        blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(x for x in lines if x)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper``: one row per host.

    Every task folds its own pages into one wrapper for each host (a structure that it has met before costs no
    alignment), so the pages themselves never move. The partial wrappers of a host meet in a tree, about ``FAN`` at a
    time: a host with a third of all pages is merged by many tasks, in as many rounds as the logarithm of its parts.

    Equal alignments are broken in a fixed way (the earlier place first), and partial wrappers are merged in the order of
    their text, so a task that runs again gives the same. Merging is not associative, though: another split of the
    table into tasks may align optional groups otherwise.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wrappers: dict[str, Wrapper] = {}
        met: dict[str, dict] = {}
        for batch in batches:
            for host, source in zip(batch["host"], batch["html"], strict=True):
                if not source:
                    continue
                one = Wrapper.of(Page(source))
                key = tuple(one.nodes())
                same = met.setdefault(host, {})
                if key in same:  # only the texts can differ
                    same[key].absorb(one)
                elif len(same) < 256:
                    same[key] = one
                else:  # bounds what a task holds of a host
                    wrappers[host] = wrappers.get(host, Wrapper()).merge(one)
        for host, same in met.items():
            for one in same.values():
                wrappers[host] = wrappers.get(host, Wrapper()).merge(one)
        rows = [(h, w.dump()) for h, w in wrappers.items()]
        yield pd.DataFrame(rows, columns=["host", "wrapper"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out = Wrapper()
        for text in sorted(group["wrapper"]):
            out = out.merge(Wrapper.load(text))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [out.dump()]})

    columns = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    schema = "host string, wrapper string"
    parts = checkpoint(columns.mapInPandas(fold, schema))
    most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    salts = [1]
    while salts[0] * FAN < most:
        salts.insert(0, salts[0] * FAN)
    for n in salts:
        parts = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(n))).applyInPandas(merge, schema)
    return parts


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The input with ``text_col``, the main text of the whole page (replaced if it is there).

    Every page is aligned with its host's wrapper; texts in places that all pages of the host have alike are template,
    and the slots that vary are the text. Names of elements and classes tell which slots are none of the article's.

    Null or empty html gives an empty text. Pages without a host share the host "". Every row is read, repeated ones alike
    (and copies of a page tell a wrapper nothing more); an empty table gives an empty result.
    """
    spark = ship(pages.sparkSession)
    wrappers = infer_wrappers(pages, url_col, html_col).select("host", "wrapper")
    wrappers = checkpoint(wrappers)
    bytes_ = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    names = [c for c in pages.columns if c != text_col]
    if bytes_ <= MAX_BROADCAST:
        distinct: dict[str, int] = {}
        hosts = {h: distinct.setdefault(repr(Wrapper.load(w).slots()), len(distinct)) for h, w in wrappers.collect()}
        shared = spark.sparkContext.broadcast((hosts, list(distinct)))

        @F.pandas_udf("string")
        def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            ids, texts = shared.value
            slots: dict[int, Slots] = {}
            for host, source in batches:
                out = []
                for h, s in zip(host, source, strict=True):
                    k = ids.get(h)
                    if k is not None and k not in slots:
                        slots[k] = Slots(ast.literal_eval(texts[k]))
                    out.append(main_text(Page(s), slots.get(k)) if s else "")
                yield pd.Series(out, dtype=object)

        return pages.withColumn(text_col, read(host_of(F.col(url_col)), F.col(html_col)))

    @F.pandas_udf("string")
    def read_joined(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for wrapper, source in batches:
            yield pd.Series([(main_text(Page(s), Slots(Wrapper.load(w).slots()) if w else None) if s else "") for w, s in zip(wrapper, source, strict=True)], dtype=object)

    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), host_of(F.col(url_col)).alias("host"))
    joined = row.join(wrappers, "host", "left")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names], read_joined(F.col("wrapper"), F.col("row").getField(html_col)).alias(text_col))
