"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, doc_key, let, text_of
from docloom.llm.shingling import WORDS, BitFilter, labelled, places_of, shingle_hashes, shingles_of, window_starts, word_hashes

SIMILARITY = 0.8
#: Two windows of equal size and weighted similarity 0.8 differ in 64 * acos(8/9) / pi = 9.7 of 64 bits, with a deviation
#: of 2.9; up to 21 (four deviations) they are candidates. 22 blocks: within 21 bits at least one block is equal.
RADIUS, BLOCKS = 21, 22
#: Consecutive windows whose fingerprints roll on from the first one's.
CHUNK = 64
#: Item shingles up to this number are sent to every executor (24 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 1 << 20
#: Items of fewer shingles take 16 bits to count a vote, others 32.
_NARROW = 1 << 14


class Votes:
    """SimHash votes in lanes of a long: 16 longs of four lanes, or 32 of two where an item has 2 ** 14 shingles or more.

    Lane b of long k counts bit ``k + width * b`` of the hashes. A lane's upper two bits stay clear, so whole longs are
    added and subtracted.
    """

    def __init__(self, largest: int) -> None:
        self.width = 16 if largest < _NARROW else 32
        self._ones = sum(1 << at for at in range(0, 64, self.width))

    def none(self) -> Column:
        return F.array(*[F.lit(0).cast("long")] * self.width)

    def moved(self, votes: Column, into: Column, out: Column | None = None) -> Column:
        """The votes with one hash more and one less (a null hash has no votes)."""
        ones = F.lit(self._ones)
        of = lambda h, k: F.shiftrightunsigned(h, k).bitwiseAND(ones)
        zero = F.lit(0).cast("long")
        if out is None:
            return F.array(*[F.get(votes, k) + of(into, k) for k in range(self.width)])
        both = F.struct(F.coalesce(into, zero).alias("i"), F.coalesce(out, zero).alias("o"))
        return let(both, lambda h: F.array(*[F.get(votes, k) + of(h["i"], k) - of(h["o"], k) for k in range(self.width)]))

    def total(self, shingles: Column) -> Column:
        return F.aggregate(shingles, self.none(), lambda acc, h: self.moved(acc, h))

    def fingerprint(self, votes: Column, n: Column) -> Column:
        """64 bits: whether more than half of ``n`` hashes have the bit."""
        top = self.width - 2

        def bits(add: Column) -> Column:
            # votes + (2 ** top - 1 - n // 2) reaches a lane's bit ``top`` if the votes exceed n / 2.
            one = lambda k: (F.get(votes, k) + add).bitwiseAND(F.lit(self._ones << top))
            out = F.shiftrightunsigned(one(0), top)
            for k in range(1, self.width):
                out = out.bitwiseOR(F.shiftrightunsigned(one(k), top - k) if k <= top else F.shiftleft(one(k), k - top))
            return out

        return let((F.lit(2**top - 1).cast("long") - F.floor(n / 2)) * F.lit(self._ones), bits)

    def simhash(self, shingles: Column) -> Column:
        return let(self.total(shingles), lambda v: self.fingerprint(v, F.size(shingles)))

    def rolled(self, part: Column, size: Column, count: Column) -> Column:
        """Fingerprints of the windows of ``size`` that start at the first ``count`` places of ``part``: each is the one
        before with one hash more and one less. Windows end where ``part`` ends."""

        def step(acc: Column, i: Column) -> Column:
            votes = F.when(i == 0, acc["votes"]).otherwise(self.moved(acc["votes"], F.get(part, i + size - 1), F.get(part, i - 1)))
            n = F.least(size, F.size(part) - i)
            return let(votes, lambda v: F.struct(v.alias("votes"), F.array_append(acc["prints"], self.fingerprint(v, n)).alias("prints")))

        start = F.struct(self.total(F.slice(part, 1, size)).alias("votes"), F.array().cast("array<bigint>").alias("prints"))
        return F.aggregate(F.sequence(F.lit(0), count - 1), start, step, lambda acc: acc["prints"])


def blocks(fingerprint: Column) -> Column:
    """``array<struct<block, bits>>``: the blocks of a fingerprint. Two within the radius have an equal one."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    cut = lambda a, b: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << b - a) - 1)).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("block"), cut(a, b).alias("bits")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])


def _chunks(starts: Column) -> Column:
    """Runs of consecutive starts in pieces of at most ``CHUNK``: ``array<struct<first, count>>``."""
    end = lambda side: F.filter(starts, lambda s, i: F.coalesce(F.get(starts, i + side) != s + side, F.lit(True)))
    cut = lambda r: F.transform(F.sequence(r["a"], r["b"], F.lit(CHUNK)), lambda x: F.struct(x.alias("first"), F.least(F.lit(CHUNK), r["b"] - x + 1).alias("count")))
    runs = F.arrays_zip(end(-1).alias("a"), end(1).alias("b"))
    return F.flatten(F.transform(runs, cut))


def _windows(docs: DataFrame, sizes: dict[int, list[int]], known, least: float, id_col: str, text_col: str) -> DataFrame:
    """``id, text_hash, words, size, first, count, part``: chunks of windows that may reach the similarity.

    Of a window and an item of ``m`` and ``n`` shingles, ``(m + n) * least / (1 + least)`` are common, so a window with
    fewer shingles that any item has (``known``) cannot reach it and gets no fingerprint. At the end of a text windows
    are shorter than the item, down to ``least`` of it.
    """
    up = lambda x: F.ceil(x - F.lit(1e-9)).cast("int")

    def of_size(k: int, s: Column, places: Column, n: Column) -> Column:
        total, need, short = F.size(s), up(2 * n * least / (1 + least)), up(n * least)
        full = window_starts(places, n, need, total - n)
        tail = F.greatest(total - n + 1, F.lit(0))
        ends = F.when((total - short >= tail) & (F.get(places, F.size(places) - short) >= tail), F.sequence(tail, total - short))
        starts = F.concat(full, F.coalesce(ends, F.array().cast("array<int>")))
        row = lambda c: F.struct(F.lit(k).alias("words"), n.alias("size"), c["first"].alias("first"), c["count"].alias("count"), F.slice(s, c["first"] + 1, n + c["count"] - 1).alias("part"))
        return let(starts, lambda a: F.transform(_chunks(a), row))

    def of_words(k: int, s: Column) -> Column:
        each = F.split(F.lit(",".join(map(str, sizes[k]))), ",").cast("array<int>")
        few = F.slice(each, 1, 0)  # no size needs more than all places
        tried = lambda p: F.when(F.size(p) >= up(F.lit(sizes[k][0] * least)), F.filter(each, lambda n: up(n * least) <= F.size(p))).otherwise(few)
        return let(places_of(s, known), lambda p: F.flatten(F.transform(tried(p), lambda n: of_size(k, s, p, n))))

    found = let(word_hashes(text_of(text_col)), lambda h: F.concat(*[let(shingles_of(h, k), lambda s, k=k: of_words(k, s)) for k in sorted(sizes)]))
    return docs.select(doc_key(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), F.explode(found).alias("x")).select("id", "text_hash", "x.*")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY, prune: bool = True
) -> DataFrame:
    """``id, text_hash, item_id, first, similarity``: every (document, item) where a window of the item's size reaches
    the similarity, with the best window (its first word, from 0; of equal ones the first).

    Windows of the size of an item get rolling SimHash fingerprints; those that share a Hamming block with an item of
    their size, which all within the radius do, are candidates; within the radius they are compared exactly. With
    ``prune``, windows that hold too few shingles of any item to reach the similarity get no fingerprint (a constant
    Bloom filter in the scan counts them); that loses nothing, and without it every window gets one.

    Items of fewer than five words are one shingle of their own length. Null, empty and wordless texts and items match
    nothing; an empty table gives an empty result. Items repeated with the same id and text count once, and so do rows
    repeated with the same id and text; a null document id counts as the smallest, and null item ids are left out.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), text_of(item_text).alias("text"))
    items = items.withColumn("words", F.least(F.lit(WORDS), F.size(word_hashes(F.col("text"))))).where("words > 0")
    by_words = F.coalesce(*[F.when(F.col("words") == k, shingle_hashes(F.col("text"), k)) for k in range(1, WORDS + 1)])
    items = checkpoint(items.select("item_id", "words", by_words.alias("item")).distinct().select("*", F.size("item").alias("size"), F.xxhash64("item").alias("item_hash")))
    sizes: dict[int, list[int]] = {}
    # Distinct sizes are few: d of them take d * d / 2 shingles.
    for k, n in items.select("words", "size").distinct().sort("words", "size").collect():
        sizes.setdefault(k, []).append(n)
    if not sizes:
        item_type = benchmark.schema[item_col].dataType.simpleString()
        return spark.createDataFrame([], f"id long, text_hash long, item_id {item_type}, first int, similarity double")
    vocabulary = items.select(F.explode(F.array_distinct("item")).alias("h")).distinct()
    total = items.agg(F.sum("size")).first()[0]
    small = total <= MAX_BROADCAST
    side = lambda frame: F.broadcast(frame) if small else frame
    votes = Votes(max(n for ns in sizes.values() for n in ns))
    # Written before the blocks are cut, so that each fingerprint is made once.
    of_items = checkpoint(items.select("item_id", "item_hash", "words", "size", labelled(F.col("item")).alias("item"), votes.simhash(F.col("item")).alias("item_print")))
    known = BitFilter(vocabulary, vocabulary.count()).may_hold if prune else lambda h: F.lit(True)
    chunks = checkpoint(_windows(docs, sizes, known, least, id_col, text_col))
    place = ["id", "text_hash", "words", "size", "first"]
    prints = chunks.select(*place, F.posexplode(votes.rolled(F.col("part"), F.col("size"), F.col("count"))).alias("i", "print"))
    keyed = side(of_items.drop("item").select("*", F.inline(blocks(F.col("item_print")))))
    met = prints.select("*", F.inline(blocks(F.col("print")))).join(keyed, ["words", "size", "block", "bits"])
    near = met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select(*place, "i", "item_id", "item_hash").distinct()
    tried = near.join(chunks.select(*place, "part").dropDuplicates(place), place).join(side(of_items.select("item_id", "item_hash", "item")), ["item_id", "item_hash"])
    window = F.slice("part", F.col("i") + 1, F.col("size"))
    common = F.size(F.array_intersect("item", labelled(window))).cast("long")
    sums = tried.select("id", "text_hash", "item_id", (F.col("first") + F.col("i")).alias("first"), common.alias("common"), (F.size(window) + F.col("size")).alias("sum"))
    hits = sums.select("id", "text_hash", "item_id", "first", (F.col("common") / (F.col("sum") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= least)
    best = hits.groupBy("id", "text_hash", "item_id").agg(F.max(F.struct("similarity", F.negative("first").alias("back"))).alias("b"))
    return best.select("id", "text_hash", "item_id", F.negative("b.back").alias("first"), F.col("b.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (rows repeated under one id are judged by their own text)."""
    bad = contaminated(docs, benchmark, id_col, text_col, **kw).select("id", "text_hash").distinct()
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), doc_key(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"))
    return row.join(bad, ["id", "text_hash"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in names])
