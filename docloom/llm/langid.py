"""Language ID: script ranges, per-word scores, and Viterbi with a switching penalty."""

from __future__ import annotations

import functools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import free_name, ship

#: The Unicode ranges of the scripts told apart (first, last code point, name).
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x0370, 0x03FF, "greek"), (0x1F00, 0x1FFF, "greek"),
    (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0xAC00, 0xD7AF, "hangul"), (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"),
)
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
GRAMS = (1, 2, 3)
#: Documents of each language that the counts are taken from, about (the bound of the training sample).
TRAIN_PER_LANG = 600
#: Languages that are learned at most: those with the most labelled documents (ties: the first by name).
MAX_LANGS = 200
#: Nats that a change of language costs, and the weight of a gram that was never seen.
SWITCH, SMOOTH = 6.0, 0.5
CACHE_SIZE = 200_000


@functools.lru_cache(maxsize=1 << 16)
def script_of(c: str) -> str:
    n = ord(c)
    return next((name for a, b, name in SCRIPTS if a <= n <= b), "other")


def bucket(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5))


class LanguageModel:
    """Naive Bayes over the 1- to 3-grams of a word with its ends marked; scores are log-probabilities per language.

    Letters are small numbers (0 marks a word's end; letters that were never seen are one number for each script), so the
    grams of many words at once are whole-number keys, looked up in one sorted array.
    """

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.langs = sorted({lang for lang, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        n = len(self.langs)
        table: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        totals = np.zeros((max(GRAMS) + 1, n))
        letters = np.zeros(n)
        scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        for (lang, gram), k in counts.items():
            table[gram][at[lang]] += k
            totals[len(gram), at[lang]] += k
            if len(gram) == 1 and gram != "^":
                letters[at[lang]] += k
                scripts[script_of(gram)][at[lang]] += k
        seen = {size: sum(len(g) == size for g in table) + 1 for size in GRAMS}
        known = sorted({c for g in table for c in g} - {"^"})
        names = sorted({name for _, _, name in SCRIPTS} | {"other"})
        self.letter = {"^": 0} | {c: i for i, c in enumerate(known, 1)}
        self.unseen = {name: len(known) + 1 + i for i, name in enumerate(names)}
        self.base = len(known) + 1 + len(names)
        #: A language is a candidate for a script if at least one letter in a hundred of it is of that script.
        candidates = {name: scripts[name] >= 0.01 * np.maximum(letters, 1) if name in scripts else np.zeros(n, dtype=bool) for name in names}
        self.allowed = np.array([np.zeros(n, dtype=bool), *(candidates[script_of(c)] for c in known), *(candidates[name] for name in names)]).reshape(self.base, n)
        self.keys, self.rows = {}, {}
        for size in GRAMS:
            grams = sorted((self._key(g), g) for g in table if len(g) == size)
            self.keys[size] = np.array([k for k, _ in grams], dtype=np.int64)
            floor = np.log(SMOOTH / (totals[size] + SMOOTH * seen[size]))
            #: The last row is for grams that were never seen.
            self.rows[size] = np.array([*(np.log((table[g] + SMOOTH) / (totals[size] + SMOOTH * seen[size])) for _, g in grams), floor]).reshape(len(grams) + 1, n)

    def _key(self, gram: str) -> int:
        out = 0
        for c in gram:
            out = out * self.base + self.letter[c]
        return out

    def _number(self, c: str) -> int:
        i = self.letter.get(c)
        return self.unseen[script_of(c)] if i is None else i

    def _scores(self, size: int, keys: np.ndarray) -> np.ndarray:
        known = self.keys[size]
        if not len(known):
            return self.rows[size][np.zeros(len(keys), dtype=np.int64)]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return self.rows[size][np.where(known[at] == keys, at, len(known))]

    def score(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters of each chunk, how many of them are in words of a script that some language uses, and the chunk's score
        for each language (zeros: it says nothing)."""
        n = len(self.langs)
        letters, heard = np.zeros((2, len(chunks)), dtype=np.int64)
        out = np.zeros((len(chunks), n))
        words, owner = [], []
        for k, chunk in enumerate(chunks):
            found = LETTERS.findall(chunk.lower())
            words += found
            owner += [k] * len(found)
        if not words:
            return letters, heard, out
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        np.add.at(letters, owner, sizes)
        if not n:
            return letters, heard, out
        text = "^" + "^".join(words) + "^"
        codes, where = np.unique(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), return_inverse=True)
        c = np.array([0 if x == ord("^") else self._number(chr(x)) for x in codes.tolist()], dtype=np.int64)[where]
        # Word w has the letters first[w] to first[w] + sizes[w] and an end mark on either side.
        first = np.cumsum(sizes + 1) - sizes
        own = np.add.reduceat(self._scores(1, c), first)  # the mark behind a word has to go again
        own -= self._scores(1, np.zeros(1, dtype=np.int64))
        own += np.add.reduceat(self._scores(2, c[:-1] * self.base + c[1:]), first - 1)
        three = self._scores(3, (c[:-2] * self.base + c[1:-1]) * self.base + c[2:])
        own += np.add.reduceat(three, first - 1)
        ends = first[:-1] + sizes[:-1] - 1  # the gram that spans two words
        own[:-1] -= three[ends]
        allowed = np.logical_or.reduceat(self.allowed[c], first)
        own -= own.max(axis=1, keepdims=True)
        own = np.where(allowed, own, own.min(axis=1, keepdims=True) - 20.0)
        own[~allowed.any(axis=1)] = 0.0
        np.add.at(heard, owner, sizes * allowed.any(axis=1))
        np.add.at(out, owner, own)
        return letters, heard, out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> LanguageModel:
    """Learn from the labelled documents outside the held-out fifth.

    About ``per_lang`` documents of each language are taken, by a threshold on the hash of their id that the
    language's count sets: no sort, and the same documents on every run. Grams are counted on the cluster;
    what comes back is the table of grams, which the sample bounds. Of more than ``MAX_LANGS`` labels the most frequent
    are learned. Rows repeated under one id are all taken or all left out; a null id counts as the empty text; without a
    labelled row nothing is learned.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & (bucket(id_col) != 0)).where(F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().sort(F.desc("count"), lang_col).limit(MAX_LANGS).collect()}
    if not sizes:
        return LanguageModel({})
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_lang / n)))])
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = labelled.where(draw < F.element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("w")).groupBy("lang", "w").count()
    marked = F.concat(F.lit("^"), F.col("w"), F.lit("^"))
    grams = F.flatten(F.array(*[_slices(marked, size) for size in GRAMS]))
    counted = words.select("lang", "count", F.explode(grams).alias("g")).where("g <> '^'").groupBy("lang", "g").agg(F.sum("count").alias("n"))
    return LanguageModel({(r[0], r[1]): r[2] for r in counted.collect()})


def _slices(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - F.lit(size - 1)), lambda i: F.substring(text, i, F.lit(size)))


BLOCK = 64


def _blocks(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all documents in rows of ``BLOCK``, each document padded with words that say nothing (row 0
    of the scores); the first row of every document; its number of rows."""
    counts = np.array([-(-len(x) // BLOCK) for x in ids], dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    flat = np.zeros((int(counts.sum()), BLOCK), dtype=np.int64)
    whole = flat.reshape(-1)
    for x, f in zip(ids, firsts, strict=True):
        whole[f * BLOCK : f * BLOCK + len(x)] = x
    return flat, firsts, counts


def viterbi(scores: np.ndarray, flat: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The best language of every word, where a change of language costs ``SWITCH``.

    Blocks of words are solved side by side as max-plus matrices, joined from block to block, and traced back
    in the same two steps, so a very long document takes as many array operations as it has blocks. Ties stay.
    """
    rows, n = flat.shape[0], scores.shape[1]
    labels = np.zeros((rows, BLOCK), dtype=np.int8)
    if not rows:
        return labels
    # Values of the best paths through each block, from each language before it to each at its end.
    through = np.full((rows, n, n), -np.inf)
    through[:, np.arange(n), np.arange(n)] = 0.0
    for t in range(BLOCK):
        through = np.maximum(through, through.max(axis=2, keepdims=True) - SWITCH) + scores[flat[:, t]][:, None, :]
    order = np.argsort(-counts, kind="stable")
    alive = np.searchsorted(-counts[order], -np.arange(counts.max()), side="left")
    before = np.zeros((rows, n))
    value = np.zeros((len(order), n))
    for j, k in enumerate(alive):
        at = firsts[order[:k]] + j
        before[at] = value[:k]
        value[:k] = (value[:k, :, None] + through[at]).max(axis=1)
    back = np.zeros((BLOCK, rows, n), dtype=np.int8)
    origin = np.tile(np.arange(n, dtype=np.int8), (rows, 1))
    stay, v = np.arange(n, dtype=np.int8), before
    for t in range(BLOCK):
        top = v.argmax(axis=1)
        jump = v[np.arange(rows), top][:, None] - SWITCH
        back[t] = np.where(v >= jump, stay, top[:, None])
        origin = np.take_along_axis(origin, back[t].astype(np.int64), axis=1)
        v = np.maximum(v, jump) + scores[flat[:, t]]
    state = value.argmax(axis=1)
    end = np.zeros(rows, dtype=np.int64)
    for j in range(len(alive) - 1, -1, -1):
        k = alive[j]
        at = firsts[order[:k]] + j
        end[at] = state[:k]
        state[:k] = origin[at, state[:k]]
    for t in range(BLOCK - 1, -1, -1):
        labels[:, t] = end
        end = back[t][np.arange(rows), end]
    return labels


class Labeller:
    """Labels the words of many documents at once."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.size = 1  # row 0: a word that says nothing
        self.scores = np.zeros((1024, len(self.model.langs)))
        self.letters = np.zeros(1024, dtype=np.int64)
        self.heard = np.zeros(1024, dtype=np.int64)

    def _learn(self, chunks: list[str]) -> None:
        letters, heard, scores = self.model.score(chunks)
        says = letters > 0
        n = int(says.sum())
        while self.size + n > len(self.letters):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.heard = np.concatenate([self.heard, np.zeros_like(self.heard)])
        at = slice(self.size, self.size + n)
        self.scores[at], self.letters[at], self.heard[at] = scores[says], letters[says], heard[says]
        self.index.update(zip(chunks, np.where(says, self.size - 1 + np.cumsum(says), 0).tolist(), strict=True))
        self.size += n

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: the language (its index) of every word, its letters, and those of a script in use."""
        if len(self.index) > CACHE_SIZE:
            self._reset()
        words = [t.split() if t else [] for t in texts]
        self._learn([w for w in {w for ws in words for w in ws} if w not in self.index])
        ids = [np.fromiter(map(self.index.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in words]
        scores, letters, heard = self.scores, self.letters, self.heard
        if not self.model.langs:
            return [(np.zeros(len(x), dtype=np.int64), letters[x], heard[x]) for x in ids]
        flat, firsts, counts = _blocks(ids)
        labels = viterbi(scores, flat, firsts, counts)
        out, at = [], 0
        for x, n in zip(ids, counts, strict=True):
            out.append((labels[at : at + n].ravel()[: len(x)].astype(np.int64), letters[x], heard[x]))
            at += n
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, list[tuple[int, int, str]]]]:
        """Language, score, support and spans (first word, end, language) of each text.

        The language is the one with the most letters in its spans (ties: the first by name); the score is
        its share of all letters; the support is the share of letters in words of a script that a learned language uses.
        Without a letter, or without a model, the language is ``und`` and score and support are 0.
        """
        out = []
        for labels, letters, heard in self.label(texts):
            total = int(letters.sum())
            if not total or not self.model.langs:
                out.append((UNKNOWN, 0.0, 0.0, []))
                continue
            mass = np.bincount(labels, weights=letters, minlength=len(self.model.langs))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
            spans = [(int(a), int(b), self.model.langs[labels[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            k = int(mass.argmax())
            out.append((self.model.langs[k], float(mass[k] / total), float(heard.sum() / total), spans))
        return out


_LABELLERS: dict[str, Labeller] = {}


def _labeller(key: str, shared) -> Labeller:
    """One labeller for each model and worker process: the scores of words outlive a task."""
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = Labeller(shared.value)
    return _LABELLERS[key]


def language_id(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", support_col: str = "lang_support", spans_col: str = "lang_spans"
) -> DataFrame:
    """The input with language, score, support and spans of every whole text (columns of these names are replaced).

    Spans are ``array<struct<first int, end int, lang string>>`` in words. Null, empty and letterless texts (a letter is
    ``\\p{L}``) are ``und``. Every row is judged by its text alone, repeated rows alike; an empty table gives an empty result.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    key = uuid.uuid4().hex

    @F.pandas_udf("struct<lang:string,score:double,support:double,spans:array<struct<first:int,end:int,lang:string>>>")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = _labeller(key, shared)
        for s in texts:
            values = s.tolist()
            rows = []
            for i in range(0, len(values), 1000):
                rows += labeller.predict(values[i : i + 1000])
            spans = [[{"first": a, "end": b, "lang": x} for a, b, x in r[3]] for r in rows]
            yield pd.DataFrame({"lang": [r[0] for r in rows], "score": [r[1] for r in rows], "support": [r[2] for r in rows], "spans": spans})

    new = {pred_col: "lang", score_col: "score", support_col: "support", spans_col: "spans"}
    kept = [c for c in docs.columns if c not in new]
    name = free_name(docs, "predicted")
    both = docs.select(*[F.col(f"`{c}`") for c in kept], predict(F.col(text_col)).alias(name))
    return both.select(*[F.col(f"`{c}`") for c in kept], *[F.col(name).getField(f).alias(c) for c, f in new.items()])
