"""Personal data: exact base patterns, and a skip-chain CRF that adds entities by context and repetition."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import free_name, ship

KINDS = ("email", "ip", "card", "phone")
#: The kind that only the CRF finds: key material (tokens, passwords, API keys).
ADDED = "secret"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A suffix of a run of digits fails where the run fails, so only whole runs are tried: linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base patterns, leftmost and without overlap per kind; matches that fail their test are dropped."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = _NOT_DIGIT.sub("", m.group())
            if len(digits) <= 19 and len(digits) >= 16 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# The skip-chain CRF. Nodes are tokens around those that could be an entity; labels are 0 (other) and the kinds.

LABELS = ("other", *KINDS, ADDED)
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"[A-Za-z0-9+/_=-]+")
_KEYLIKE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{12,}+")
_HEX = re.compile(r"[0-9a-fA-F]+")
_WORD = re.compile(r"[a-z0-9_]+")
_NOT_ALNUM = re.compile(r"[^a-z0-9]+")
_EDGE = re.compile(r"^[^A-Za-z0-9+(]+|[^A-Za-z0-9)]+$")
#: Words that announce an entity of a kind.
TRIGGERS = {
    "email": frozenset("email mail e-mail mailto contact".split()),
    "ip": frozenset("ip ipv4 host server address".split()),
    "card": frozenset("card visa mastercard amex credit debit".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell whatsapp".split()),
    "secret": frozenset("token secret password passwd pwd passphrase apikey api_key key access_key secret_key private_key auth bearer credential credentials".split()),
}
#: Words that announce a fingerprint, which is public.
CHECKSUMS = frozenset("commit sha sha1 sha256 md5 hash checksum digest revision rev etag uuid".split())
_ANNOUNCED = re.compile(rf"(?i)\b(?:{'|'.join(sorted((w for k in ('phone', 'secret') for w in TRIGGERS[k]), key=len, reverse=True))})\b\W{{0,4}}[=:]")
#: Share of tokens that look like an entity and have no word before them that are one in the training sentences. Alone
#: they are not labelled, but they do not outvote one that is announced.
UNTOLD = 0.4
WINDOW = 2
#: Shortest normal form that is linked; sweeps end when no message moves by more than the tolerance, or after the last.
LINKED, TOLERANCE, SWEEPS = 6, 1e-3, 500
FEATURES = (
    "bias", "keylike", "hex", "long", "very_long", "quoted", "all_digits", "no_digit", "assigned", "digits_7_15", "digits_16_19", "dots", "at", "plus",
    "mixed", "checksum", *(f"base_{k}" for k in KINDS), *(f"near_{k}" for k in LABELS[1:]), *(f"assigned_{k}" for k in LABELS[1:]),
)
#: Features that tell of a token's place; the others tell of the token itself, which repeats say again.
_OF_PLACE = np.array([f in ("quoted", "assigned", "checksum") or f.startswith(("base_", "near_", "assigned_")) for f in FEATURES])


def _core(token: str) -> str:
    return max(_CORE.findall(token), key=len, default="")


def normal_form(token: str) -> str:
    """What similar tokens share: lower-case letters and digits only; of a long number its last seven digits, which are
    the same with and without a prefix."""
    plain = _NOT_ALNUM.sub("", token.lower())
    if len(plain) >= 7 and plain.isdigit():
        return plain[-7:] if len(plain) <= 15 else plain
    return plain


def _features(tokens: list[str], i: int, base: str | None) -> np.ndarray:
    token, core = tokens[i], _core(tokens[i])
    digits = sum(c in "0123456789" for c in core)
    number = len(_NOT_DIGIT.sub("", token))
    only_number = not any(c.isalpha() for c in token)
    lead = tokens[max(0, i - 2) : i]
    before = " ".join(lead).lower()
    words = set(_WORD.findall(before)) | {w for t in lead for w in (t.lower().strip(".,:;=()\"'"),)}
    first, sep, _ = token.partition("=") if "=" in token else token.partition(":")
    own = {first.lower()} if sep else set()
    assigned = bool(sep and first.isidentifier()) or bool(re.search(r"[=:]\W*$", before))
    near = [bool(TRIGGERS[k] & (words | own)) for k in LABELS[1:]]
    return np.array([
        1, 0 < digits < len(core) and len(core) >= 12, bool(_HEX.fullmatch(core)) and 0 < digits < len(core), len(core) >= 16, len(core) >= 32,
        '"' in token or "'" in token, digits == len(core) > 0, digits == 0, assigned, only_number and 7 <= number <= 15, only_number and 16 <= number <= 19,
        token.count(".") >= 3, "@" in token, "+" in token[:2], core.isalnum() and 0 < digits < len(core) and 6 <= len(core) < 12, bool(CHECKSUMS & words), *(base == k for k in KINDS), *near, *(n and assigned and len(core) >= 4 for n in near),
    ], dtype=float)


class SkipChain:
    """Weights: for each label and feature, one for two neighbours of the same kind, one for agreement across a skip edge."""

    def __init__(self, weights: np.ndarray, chain: float, skip: float) -> None:
        """``weights``: features by labels."""
        self.weights, self.chain, self.skip = weights, chain, skip

    def tables(self) -> np.ndarray:
        """Scores of pairs of labels across a chain edge and across a skip edge."""
        n = self.weights.shape[1]
        chain = np.diag([0.0, *[self.chain] * (n - 1)])
        return np.array([chain, self.skip * np.eye(n)])

    def marginals(self, unary: np.ndarray, chain: list[tuple[int, int]], skips: list[tuple[int, int]]) -> np.ndarray:
        """Probability of each label of every node by loopy sum-product message passing, until the messages settle."""
        edges = [(a, b, 0) for a, b in chain] + [(a, b, 1) for a, b in skips]
        belief = unary
        if edges:
            one = np.array(edges)
            source, target, kind = np.concatenate([one[:, 0], one[:, 1]]), np.concatenate([one[:, 1], one[:, 0]]), np.tile(one[:, 2], 2)
            reverse = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            pair = np.exp(self.tables())[kind]
            message = np.zeros((len(source), unary.shape[1]))
            for _ in range(SWEEPS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                own = belief[source] - message[reverse]
                top = own.max(axis=1, keepdims=True)
                out = np.log(np.einsum("el,elm->em", np.exp(own - top), pair))
                out -= out.max(axis=1, keepdims=True)
                if np.abs(out - message).max() < TOLERANCE:
                    break
                message = 0.5 * message + 0.5 * out  # damped, so that cycles settle
            belief = unary.copy()
            np.add.at(belief, target, message)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def graph(self, tokens: list[str], base: list[str | None]) -> tuple[list[int], list[tuple[int, int]], list[tuple[int, int]]]:
        """The nodes (numbers of tokens), and chain and skip edges between them (numbers of nodes).

        Nodes are candidates (key-like tokens, tokens of base spans, what is assigned near a word that announces a kind),
        every token of the text with the normal form of one, and their neighbours. Of tokens of one form each is linked
        to the next, and to the one that its features say most of, so that evidence crosses any distance in two steps.
        What a token is like counts once, at that one; the others add what their places say.
        """
        candidates = {i for i, t in enumerate(tokens) if base[i] or _KEYLIKE.search(t)}
        for i, t in enumerate(tokens):
            if "=" in t or ":" in t or (i and ("=" in tokens[i - 1] or ":" in tokens[i - 1])):
                words = {w for x in tokens[max(0, i - 2) : i + 1] for w in _WORD.findall(x.lower())}
                if words & TRIGGERS["secret"] or words & TRIGGERS["phone"] and _DIGIT.search(t):
                    candidates.add(i)
        forms: dict[str, list[int]] = {form: [] for i in candidates if len(form := normal_form(tokens[i])) >= LINKED}
        if forms:
            for i, t in enumerate(tokens):
                if len(t) >= LINKED and (form := normal_form(t)) in forms:
                    forms[form].append(i)
        found = candidates.union(*forms.values())
        nodes = sorted({j for i in found for j in range(max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1))})
        at = {j: k for k, j in enumerate(nodes)}
        chain = [(at[j], at[j + 1]) for j in nodes if j + 1 in at]
        seen = np.array([_features(tokens, j, base[j]) for j in nodes]).reshape(len(nodes), len(FEATURES))
        self._unary = seen @ self.weights
        says = (self._unary.max(axis=1) - self._unary[:, 0]).tolist()
        skips = set()
        for places in forms.values():
            ks = [at[i] for i in places]
            best = max(ks, key=lambda k: (says[k], -k), default=0)
            others = [k for k in ks if k != best]
            self._unary[others] = (seen[others] * _OF_PLACE) @ self.weights
            skips |= {(a, b) for a, b in zip(ks[:-1], ks[1:], strict=True)} | {(min(k, best), max(k, best)) for k in others}
        return nodes, chain, sorted(skips)

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Entities of a whole text beside the base spans: neighbouring tokens of one kind are one span."""
        if not (base or _KEYLIKE.search(text) or _ANNOUNCED.search(text)):
            return []
        places = [m.span() for m in _TOKEN.finditer(text)]
        tokens = [text[a:b] for a, b in places]
        kinds: list[str | None] = [None] * len(tokens)
        starts = [a for a, _ in places]
        for kind, a, b in base:
            for i in range(max(0, bisect_right(starts, a) - 1), bisect_left(starts, b)):
                if places[i][1] > a:
                    kinds[i] = kinds[i] or kind
        nodes, chain, skips = self.graph(tokens, kinds)
        if not nodes:
            return []
        found: list[Span] = []
        last = -2
        for j, k in zip(nodes, self.marginals(self._unary, chain, skips).argmax(axis=1).tolist(), strict=True):
            if not k or kinds[j]:
                continue
            core = _core(tokens[j]) if LABELS[k] == ADDED else _EDGE.sub("", tokens[j])
            if not core:
                continue
            start = places[j][0] + tokens[j].rindex(core)
            if last == j - 1 and found[-1][0] == LABELS[k] != ADDED:
                found[-1] = (LABELS[k], found[-1][1], start + len(core))
            else:
                found.append((LABELS[k], start, start + len(core)))
            last = j
        return found


def _numbers(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def examples(n: int, seed: int, syllables: str = "ka lo mi ten ra sho ve dun el is or an the in", announced: dict[str, list[str]] | None = None) -> Iterator[tuple[list[str], list[int], list[str | None]]]:
    """Sentences with entities, what looks like them, and neither, the same for a seed: tokens, labels, and kinds of base
    spans. ``announced``: the words before entities."""
    rng = random.Random(seed)
    parts = syllables.split()
    leads = announced or {k: sorted(v) for k, v in TRIGGERS.items()}
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."])
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    secret = lambda: "".join(rng.choices(rng.choice(alphabets), k=rng.choice([16, 20, 24, 32, 40, 64])))
    code = lambda: rng.choice([f"{word().strip(',.')}{rng.randrange(1000)}", "".join(rng.choices(alphabets[2], k=rng.randint(6, 11)))])
    dashed = lambda d: f"{d[:3]}-{d[3:6]}-{d[6:]}"
    plain = lambda: rng.choice([_numbers(rng, 16), _numbers(rng, rng.randint(1, 9)), f"{word()}-{rng.randrange(1000)}", f"{rng.randrange(1900, 2100)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}", f"id={rng.randrange(10**8)}", f"section-{rng.randrange(9)}-chapter-{rng.randrange(9)}", f"http://{word()}.example/{rng.randrange(10**6)}"])
    at = {k: i for i, k in enumerate(LABELS)}
    for _ in range(n):
        rows: list[tuple[str, int, str | None]] = []
        kept: list[tuple[str, str]] = []

        def lead(kind: str, rows=rows) -> None:
            w = rng.choice(leads[kind])
            rows.extend((t, 0, None) for t in ([w, "="] if rng.random() < 0.5 else [w + rng.choice(":=")]))

        for _ in range(rng.randint(2, 7)):
            rows += [(word(), 0, None) for _ in range(rng.randint(2, 6))]
            dice = rng.random()
            if dice < 0.25:
                s = rng.choice([secret, secret, code])()
                kept.append(("secret", s))
                lead("secret")
                rows.append((rng.choice(['"{}"', "{}", "'{}'", '"{}"!!']).format(s), at["secret"], None))
            elif dice < 0.33:
                s = _numbers(rng, 10)
                kept.append(("phone", dashed(s)))
                rows.append((f"+1-{dashed(s)}", at["phone"], "phone"))
            elif dice < 0.4:
                s = dashed(_numbers(rng, 10))
                kept.append(("phone", s))
                lead("phone")
                rows.append((s, at["phone"], None))
            elif dice < 0.46:
                name = f"{word().strip(',.')}.{word().strip(',.')}"
                rows.append((f"{name}@{word().strip(',.')}.example", at["email"], "email"))
            elif dice < 0.5:
                rows.append((".".join(str(rng.randrange(256)) for _ in range(4)), at["ip"], "ip"))
            elif dice < 0.54:
                rows.append((_numbers(rng, 16), at["card"], "card"))
            elif dice < 0.66 and kept:
                kind, s = rng.choice(kept)
                rows.append((rng.choice(['"{}"', "{}", "({})"]).format(s), at[kind], None))
            elif dice < 0.74:
                rows += [(rng.choice(sorted(CHECKSUMS)) + rng.choice(["", "", ":"]), 0, None), (secret(), 0, None)]
            # Without a word before them these tell nothing: about as many are entities as are not.
            elif dice < 0.78:
                rows.append((rng.choice([secret, secret, code])(), at["secret"] if rng.random() < UNTOLD else 0, None))
            elif dice < 0.81:
                rows.append((dashed(_numbers(rng, 10)), at["phone"] if rng.random() < UNTOLD else 0, None))
            else:
                rows.append((plain(), 0, None))
        yield [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def _half() -> dict[str, list[str]]:
    """Every second of the announcing words: the model learns what it is to be announced, not the words."""
    return {k: sorted(v)[::2] for k, v in TRIGGERS.items()}


@functools.lru_cache(maxsize=4)
def train(n: int = 400, seed: int = 7) -> SkipChain:
    """Fit by pseudo-likelihood: each label given its neighbours' is a logistic regression over the labels (Newton steps
    on each label's weights in turn, the pair weights last)."""
    rows, targets, pairs = [], [], []
    classes = len(LABELS)
    for tokens, labels, base in examples(n, seed, announced=_half()):
        same: dict[str, list[int]] = {}
        for i, t in enumerate(tokens):
            if len(form := normal_form(t)) >= LINKED:
                same.setdefault(form, []).append(i)
        linked = {i: [g[k] for k in (j - 1, j + 1) if 0 <= k < len(g)] for g in same.values() for j, i in enumerate(g)}
        for i in range(len(tokens)):
            near = np.bincount([labels[j] for j in (i - 1, i + 1) if 0 <= j < len(tokens)], minlength=classes).astype(float)
            near[0] = 0
            pairs.append([near, np.bincount([labels[j] for j in linked.get(i, ())], minlength=classes).astype(float)])
            rows.append(_features(tokens, i, base[i]))
            targets.append(labels[i])
    x, y, pair = np.array(rows), np.eye(classes)[targets], np.array(pairs)
    w, ends = np.zeros((x.shape[1], classes)), np.zeros(2)

    def probabilities() -> np.ndarray:
        score = x @ w + np.tensordot(pair, ends, axes=(1, 0))
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    for _ in range(8):
        for k in range(classes):
            p = probabilities()[:, k]
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
            w[:, k] += np.linalg.solve(hessian, x.T @ (y[:, k] - p) - w[:, k])
        p = probabilities()
        for e in range(2):
            mean = (p * pair[:, e]).sum(axis=1)
            spread = (p * pair[:, e] ** 2).sum() - (mean**2).sum() + 1
            ends[e] += ((y * pair[:, e]).sum() - mean.sum() - ends[e]) / spread
    return SkipChain(w, float(ends[0]), float(ends[1]))


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, ADDED))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def find_pii(docs: DataFrame, text_col: str = "text", model: SkipChain | None = None) -> DataFrame:
    """The input with ``n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256`` and ``spans`` (columns of
    these names are replaced). Positions are code points of the whole text, ends exclusive.

    Base spans stay as they are; the CRF adds spans of any kind, ``secret`` among them, that overlap none. Null, empty and
    entity-free texts have no spans. Every row is judged by its text alone, repeated rows alike; an empty table gives an
    empty result.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model or train())

    @F.pandas_udf("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for s in texts:
            rows = []
            for t in s:
                base = base_spans(t) if t else []
                more = crf.spans(t, base) if t else []
                more = [m for m in more if not any(a < m[2] and m[1] < b for _, a, b in base)]
                counts = [sum(x[0] == k for x in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kept = [c for c in docs.columns if c not in names]
    name = free_name(docs, "found")
    both = docs.select(*[F.col(f"`{c}`") for c in kept], find(F.col(text_col)).alias(name))
    return both.select(*[F.col(f"`{c}`") for c in kept], *[F.col(name).getField(n).alias(n) for n in names])
