"""Near-duplicate texts by Order MinHash, confirmed by banded alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import MIN_LONG, checkpoint, doc_key, ship
from docloom.llm.graph import components

#: Words of a shingle (the k-mers here), and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Sketches of a text. Two texts of similarity s agree in one with a probability of about s ** size: of pairs of
#: similarity 0.8, 8 in a million agree in none.
SKETCHES = 64
#: The least minimum of each sketch agrees with probability s, so 51 of 64 are expected at 0.8, with a deviation of 3.2.
#: Pairs with fewer than 35 (2 in a million of similarity 0.8) are not aligned.
AGREE = 35
#: Hubs of a bucket in the first wave after the first hub; every further wave has twice as many.
HUBS = 1024
#: (below so many shingles, minima per sketch): short texts have few shingles to draw from.
SIZES = ((16, 2), (48, 4), (1 << 62, 8))
#: Classes of more documents than this, and than one in 2 ** 20 of all, have their sizes sent to every executor: at most
#: 2 ** 20 of them.
LARGE_CLASS = 256
#: Texts of candidates up to this many characters in all are sent to every executor; more are joined to the pairs.
MAX_BROADCAST = 16 << 20
#: Shingles that a task remembers of texts it has aligned (8 bytes each).
HELD = 2 << 20
#: Members of buckets that a task of a wave writes, about: their rows are small, and the driver keeps a record of each task.
MEMBERS = 20_000
#: Pairs that a task aligns, about, where they are dealt apart from their texts.
PAIRS = 2000
_WORD = re.compile(r"\w+")
_RNG = np.random.default_rng(20240229)
_C = _RNG.integers(1 << 60, 1 << 63, size=WORDS + 16, dtype=np.uint64) | np.uint64(1)
_XOR = _RNG.integers(0, 1 << 32, size=(SKETCHES, 1), dtype=np.uint32)
_MUL = _RNG.integers(1 << 28, 1 << 32, size=(SKETCHES, 1), dtype=np.uint32) | np.uint32(1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[WORDS]
    return h ^ (h >> np.uint64(29))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the shingles in text order, each labelled with how often it came before. Fewer than five words are
    one shingle, no words none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _C[i]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    if same.any():
        at = np.arange(len(h))
        first = np.maximum.accumulate(np.where(same, 0, at))
        times = np.zeros(len(h), dtype=np.uint64)
        times[order] = (at - first).astype(np.uint64)
        h = np.where(times > 0, _mix(h + times * _C[WORDS + 1]), h)
    return h


def _size(n: float) -> int:
    return next(size for below, size in SIZES if n < below)


def sketch(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sketches: for each, the ``size`` shingles least under its hash, in text order; and a byte of the
    least one of each."""
    n, l = len(h), min(size, len(h))  # noqa: E741
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    limit = min(2.0**32, 2.0**32 * 4 * size / n)
    while True:
        found = []
        for at in range(0, n, 1 << 16):
            g = (low[None, at : at + (1 << 16)] ^ _XOR) * _MUL
            rows, cols = np.nonzero(g < limit) if limit < 2.0**32 else (np.repeat(np.arange(SKETCHES), g.shape[1]), np.tile(np.arange(g.shape[1]), SKETCHES))
            # Sketch, value and place in one number: sorted, they are the sketches' least values in turn.
            found.append((rows.astype(np.uint64) << np.uint64(58)) | ((g[rows, cols] >> np.uint32(2)).astype(np.uint64) << np.uint64(28)) | (cols + at).astype(np.uint64))
        packed = np.sort(np.concatenate(found))
        counts = np.bincount((packed >> np.uint64(58)).astype(np.int64), minlength=SKETCHES)
        if counts.min() >= l or limit >= 2.0**32:
            break
        limit *= 4
    starts = np.cumsum(counts) - counts
    places = np.sort((packed[starts[:, None] + np.arange(l)] & np.uint64((1 << 28) - 1)).astype(np.int64), axis=1)
    least = _mix(h[(packed[starts] & np.uint64((1 << 28) - 1)).astype(np.int64)]).astype(np.uint8)
    picked = h[places]
    keys = np.full(SKETCHES, size, dtype=np.uint64)
    for i in range(l):
        keys = _mix(keys ^ picked[:, i]) * _C[WORDS + 2]
    return _mix(keys + np.arange(SKETCHES, dtype=np.uint64) * _C[WORDS + 3]), least


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles over all shingles of two texts, 0 where it cannot reach ``least``.

    Labelled shingles occur once in a text, so the alignment is the longest chain of common shingles that runs
    forward in both, inside the band that the least similarity leaves for shifts.
    """
    n = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    need = least / (1 + least) * n
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = n - 2 * need
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < need - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    else:
        common = len(j)
    return common / (n - common)


def _sketch_rows(ids, texts) -> Iterator[tuple]:
    for i, text in zip(ids, texts, strict=True):
        words = words_of(text)
        if not words:
            continue
        whole = xxhash.xxh3_128_intdigest(" ".join(words))
        a, b = (int(np.uint64(x).astype(np.int64)) for x in (whole >> 64, whole & (1 << 64) - 1))
        h = shingles(words)
        # A partner has at least 0.8 and at most 1.25 times as many shingles.
        for size in sorted({_size(len(h)), _size(np.floor(SIMILARITY * len(h))), _size(np.ceil(len(h) / SIMILARITY))}):
            keys, least = sketch(h, size)
            yield i, a, b, size, keys.view(np.int64), least.view(np.int64)


def _sketch_batches(batches: Iterator[pd.DataFrame], step: int = 1000) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), step):
            part = batch.iloc[k : k + step]
            yield pd.DataFrame(list(_sketch_rows(part["id"], part["text"])), columns=["id", "h1", "h2", "size", "keys", "sign"])


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h1, h2, size, keys, sign``: per text and size of sketch, its keys, and the bytes of the least minima (8 longs)."""
    ship(docs.sparkSession)
    base = docs.select(doc_key(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return base.mapInPandas(_sketch_batches, "id bigint, h1 bigint, h2 bigint, size int, keys array<bigint>, sign array<bigint>")


def _agreement(a: Column, b: Column) -> Column:
    """In how many bytes the two signs agree (an agreement of minima is one of bytes)."""
    ones = F.lit(0x0101010101010101)

    def differ(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(ones))

    total = differ(0)
    for i in range(1, SKETCHES // 8):
        total = total + differ(i)
    return F.lit(SKETCHES) - total


def _shingle_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hashes = [shingles(words_of(t)).view(np.int64) for t in batch["text"]]
        yield pd.DataFrame({"id": batch["id"], "n": [len(h) for h in hashes], "hashes": hashes})


def _shared_counts(texts: DataFrame) -> DataFrame:
    """``id, n, shared``: the shingles of each text, and how many of them another of these texts holds too."""
    counted = texts.select("id", "text").mapInPandas(_shingle_batches, "id bigint, n int, hashes array<bigint>")
    alone = counted.select("id", F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("id").alias("id")).where("texts = 1")
    single = alone.groupBy("id").agg(F.count(F.lit(1)).alias("single"))
    return counted.select("id", "n").join(single, "id", "left").select("id", "n", (F.col("n") - F.coalesce("single", F.lit(0))).alias("shared"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose alignment reaches the similarity; each once, if ``pairs`` has it once and ``texts`` an id once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            keep = []
            for u, v, a, b in zip(batch["u"], batch["v"], batch["text_u"], batch["text_v"], strict=True):
                sides = []
                for i, text in ((u, a), (v, b)):
                    x = known.get(i)
                    if x is None:
                        x = shingles(words_of(text))
                        if held > HELD:
                            known.clear()
                            held = 0
                        known[i] = x
                        held += len(x)
                    sides.append(x)
                keep.append(similarity(*sides) >= SIMILARITY - 1e-9)
            yield batch.loc[keep, ["u", "v"]]

    small = (texts.agg(F.sum(F.length("text"))).first()[0] or 0) <= MAX_BROADCAST
    if small:  # a pair is a few bytes and an alignment is not: no task gets many for being small
        pairs = pairs.repartition(1 + pairs.count() // PAIRS).sortWithinPartitions("v", "u")
    side = F.broadcast(texts) if small else texts
    joined = pairs.join(side.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u").join(side.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")
    return joined.select("u", "v", "text_u", "text_v").mapInPandas(run, "u bigint, v bigint")


def _least(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row for each ``by``: the least in ``order``, whatever the order of the rows."""
    rest = [c for c in df.columns if c not in by and c not in order]
    return df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("x")).select(*by, "x.*")


def _waves(state: DataFrame, tested: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links between classes that the first hubs did not find.

    ``state``: the members of buckets of several classes (``key, id, sign, meets, n, shared, keys, component, done``;
    ``done`` marks the first hub). In every wave each bucket takes new hubs among the members outside its largest class,
    and they are compared with all members of other classes; what merges is one class from then on. The waves end when
    every bucket is one class or every member outside its largest class has been a hub, so no candidate pair between
    classes stays untested. A wave's pairs are linear in the members, and the hubs double, so waves are few.
    """
    more: list[DataFrame] = []
    wave, tasks = 0, 1 + state.count() // MEMBERS
    packed = lambda df: checkpoint(df.coalesce(tasks))
    while True:
        classes = state.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
        main = classes.groupBy("key").agg(F.max(F.struct("members", F.bitwise_not("component").alias("r"))).alias("main"), F.count(F.lit(1)).alias("classes"))
        main = main.where("classes > 1").select("key", F.bitwise_not("main.r").alias("main"))
        current = packed(state.join(main, "key").withColumn("outside", F.col("component") != F.col("main")).drop("main"))
        slot = F.pmod(F.xxhash64("id", F.lit(wave)), F.lit(HUBS << wave))
        hubs = current.where("outside AND NOT done").groupBy("key", slot.alias("slot")).agg(F.max(F.struct("meets", F.bitwise_not("id").alias("r"))).alias("hub"))
        hubs = packed(hubs.select("key", F.bitwise_not("hub.r").alias("id"), F.lit(True).alias("now")))
        if hubs.isEmpty():
            break
        marked = packed(current.join(hubs, ["key", "id"], "left").withColumn("now", F.coalesce("now", F.lit(False))))
        column = lambda c, side: F.col(c).alias(f"{c}_{side}")
        of = lambda df, side: df.select("key", F.col("id").alias(side), *[column(c, side) for c in ("sign", "n", "shared", "keys", "component", "now")])
        left, right = of(marked.where("now"), "u"), of(marked.where("NOT done"), "v")
        # Two texts have no more shingles in common than either shares with any other text in play.
        possible = F.least("shared_u", "shared_v") >= SIMILARITY / (1 + SIMILARITY) * (F.col("n_u") + F.col("n_v")) - 1e-6
        apart = (F.col("component_u") != F.col("component_v")) & (~F.col("now_v") | (F.col("u") < F.col("v")))
        once = left["key"] == F.array_min(F.array_intersect("keys_u", "keys_v"))  # a pair that shares buckets is met in one of them
        fit = apart & possible & once & (_agreement(F.col("sign_u"), F.col("sign_v")) >= AGREE)
        pairs = left.join(right, (left["key"] == right["key"]) & fit).select("u", "v").distinct()
        links = checkpoint(_verified(checkpoint(pairs.join(tested, ["u", "v"], "left_anti")), texts))
        state = marked.withColumn("done", F.col("done") | F.col("now")).drop("now", "outside")
        if not links.isEmpty():
            more.append(links)
            of_id = marked.select("id", "component").distinct()
            ends = links.join(of_id.select(F.col("id").alias("u"), F.col("component").alias("a")), "u").join(of_id.select(F.col("id").alias("v"), F.col("component").alias("b")), "v")
            merged = components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("id").alias("component"), F.col("component").alias("into"))
            state = state.join(merged, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into")
        state = packed(state)
        wave += 1
    return reduce(DataFrame.unionByName, more) if more else None


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id``: one row per id that has words; the class id is the least id of the class.

    1. Texts of the same words are one node, the least id's.
    2. Nodes that share a sketch meet in its bucket. In each bucket everything is first compared with the bucket's
       hub, the member that meets most others, which joins a group of any size with as many pairs as members.
    3. Buckets that still hold several classes take more hubs in waves, until no candidate pair between classes is
       untested (``_waves``).
    Before texts are fetched for alignment, pairs whose least minima agree too rarely for the similarity are left out.
    """
    found = checkpoint(sketches(docs, id_col, text_col))
    words = found.groupBy("h1", "h2").agg(F.min("id").alias("node"))
    members = found.select("id", "h1", "h2").distinct().join(words, ["h1", "h2"]).select("id", "node").distinct()
    nodes = _least(found.join(words.select(F.col("node").alias("id"), "h1", "h2"), ["id", "h1", "h2"]), ["id", "size"], ["h1", "h2"]).drop("h1", "h2")
    spread = nodes.select("id", "size", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = checkpoint(spread.join(shared, "key"))
    popular = buckets.groupBy("id").agg(F.sum("n").alias("meets"))
    signs = checkpoint(nodes.join(popular, "id").select("id", "size", "sign", "meets"))
    rows = buckets.join(signs, ["id", "size"]).select("key", "id", "size", "sign", "meets")
    hubs = rows.groupBy("key").agg(F.max(F.struct("meets", F.bitwise_not("id").alias("r"), "sign")).alias("hub")).select("key", F.bitwise_not("hub.r").alias("hub"), F.col("hub.sign").alias("hub_sign"))
    to_hub = checkpoint(
        rows.join(hubs, "key").where(F.col("id") != F.col("hub")).where(_agreement(F.col("sign"), F.col("hub_sign")) >= AGREE)
        .select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()
    )
    texts = docs.select(doc_key(id_col).alias("id"), F.col(text_col).alias("text")).join(signs.select("id").distinct(), "id", "left_semi")
    texts = checkpoint(_least(texts.where(F.col("text").isNotNull()).withColumn("h", F.xxhash64("text")), ["id"], ["h"]).drop("h"))
    links = checkpoint(_verified(to_hub, texts))
    first = components(links)
    classed = rows.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = classed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    of_key = mixed.join(hubs.select("key", "hub"), "key")
    placed = checkpoint(classed.join(of_key, "key").select("key", "id", "sign", "meets", "component", (F.col("id") == F.col("hub")).alias("done")))
    bounds = _shared_counts(texts.join(placed.select("id").distinct(), "id", "left_semi"))
    own = placed.groupBy("id").agg(F.collect_set("key").alias("keys"))  # at most three sizes of sketch
    # A text that shares less than the similarity of its own shingles with all others in play is similar to none of them.
    bounds = checkpoint(bounds.where(F.col("shared") >= SIMILARITY * F.col("n") - 1e-6))
    both = to_hub.unionByName(to_hub.select(F.col("v").alias("u"), F.col("u").alias("v")))
    more = _waves(checkpoint(placed.join(bounds, "id").join(own, "id")), both, texts)
    final = components(links if more is None else links.unionByName(more))
    out = members.join(final.select(F.col("id").alias("node"), "component"), "node", "left")
    return out.groupBy("id").agg(F.min(F.coalesce("component", "node")).alias("class_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with ``class_id``, ``class_size`` and ``kept`` (columns of these names are replaced).

    Two texts are linked if the shingles of five words (letters, digits and _, lower case) that align are at least
    0.8 of all; classes are what links connect; the row of the least id of a class is kept. Null, empty and
    wordless texts are classes of their own and kept. A null id counts as the smallest, and rows repeated under
    one id are one document: where their texts differ, the class is the least of theirs, and one of the texts, always the
    same, is compared. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("class_id", "class_size", "kept")]
    classes = checkpoint(near_classes(docs, id_col, text_col))
    sizes = checkpoint(classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).where("class_size > 1"))
    # Rows of large classes take the size from a broadcast and are dealt by their own ids, so that no class is one task; the
    # other classes are joined.
    many = max(LARGE_CLASS, classes.count() >> 20)
    large = sizes.where(F.col("class_size") > many).select("class_id", F.col("class_size").alias("large_size"))
    dealt = classes.join(F.broadcast(large), "class_id", "left").withColumn("apart", F.when(F.col("large_size").isNotNull(), F.col("id")))
    small = sizes.where(F.col("class_size") <= many).select("class_id", F.col("class_size").alias("small_size"), F.lit(None).cast("long").alias("apart"))
    same = (dealt["class_id"] == small["class_id"]) & dealt["apart"].eqNullSafe(small["apart"])
    sized = dealt.join(small, same, "left").select("id", dealt["class_id"], F.coalesce("large_size", "small_size").alias("class_size"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), doc_key(id_col).alias("id"))
    joined = row.join(sized, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        F.when(F.col("class_id") != MIN_LONG, F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("class_id") == F.col("id")).alias("kept"),
    )
