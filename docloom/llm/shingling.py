"""Shingles of five words as 64-bit hashes, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.llm.common import let

WORDS = 5
NOT_WORD = r"[^\p{L}\p{N}_]+"


def word_hashes(text: Column) -> Column:
    """``array<bigint>``: a hash of every word (letters, digits and _, lower case), in text order."""
    words = F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles_of(hashes: Column, words: int = WORDS) -> Column:
    """``array<bigint>``: a hash of every ``words`` consecutive ones; empty for fewer."""
    at = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(words)])
    return F.when(F.size(hashes) >= words, F.transform(F.sequence(F.lit(0), F.size(hashes) - words), at)).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The shingles of a text; empty for texts of fewer words."""
    return let(word_hashes(text), lambda h: shingles_of(h, words))


def long_array(values: list[int]) -> Column:
    """A constant ``array<bigint>``, folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def labelled(shingles: Column) -> Column:
    """Each hash with how often it came before, as one hash: what two of these arrays share is what the multisets share."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        one = lambda x, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(k == 0, x).otherwise(F.xxhash64(x, k)))
        return let(heads, lambda h: F.flatten(F.transform(h, lambda p, j: one(F.get(s, p), F.coalesce(F.get(h, j + 1), F.size(s)) - p))))

    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), shingles).otherwise(let(F.sort_array(shingles), runs))


def places_of(shingles: Column, known: Callable[[Column], Column]) -> Column:
    """The places (from 0) of the hashes that ``known`` takes."""
    return F.filter(F.transform(shingles, lambda h, i: F.when(known(h), i)), lambda i: i.isNotNull())


def window_starts(places: Column, width: Column, need: Column, last: Column, step: Column | int = 1) -> Column:
    """Starts, in order, of the windows of ``width`` that hold at least ``need`` of the ``places``: multiples of ``step``
    up to ``last``. Each start is met once, at the first place in its window, so the work is linear."""
    whole = lambda x: x.cast("int")

    def met(j: Column) -> Column:
        low = F.greatest(F.lit(0), F.get(places, j - 1) + 1, F.get(places, j + need - 1) - width + 1)
        a, b = whole(F.ceil(low / step)), whole(F.floor(F.least(F.get(places, j), last) / step))
        return F.when(a <= b, F.sequence(a, b))

    found = F.transform(F.sequence(F.lit(0), F.size(places) - need), met)
    return F.when(F.size(places) >= need, F.flatten(F.filter(found, lambda x: x.isNotNull()))).otherwise(F.array().cast("array<int>"))


class BitFilter:
    """A Bloom filter of three bits per hash, built on the cluster and held as a constant of bounded size; it takes two
    in a million other hashes, and more where the bound leaves it fewer than 256 bits a hash (three in a hundred at 8)."""

    #: Words of the largest filter (8 MiB).
    MAX_WORDS = 1 << 20

    def __init__(self, hashes, n: int) -> None:
        """``hashes``: a frame with ``h``; ``n``: its number of rows. ``ok`` is False if the filter would be too large."""
        bits = min(1 << max(12, (256 * max(n, 1) - 1).bit_length()), 64 * self.MAX_WORDS)
        self.ok = bits >= 8 * n
        if not self.ok:
            return
        self.mask = bits - 1
        places = hashes.select(F.explode(F.array(*self._places(F.col("h")))).alias("p"))
        rows = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b")).collect()
        words = [0] * (bits // 64)
        for w, b in rows:
            words[w] = b
        self.words = long_array(words)

    def _places(self, h: Column) -> tuple[Column, ...]:
        return tuple(F.shiftright(h, k).bitwiseAND(F.lit(self.mask)) for k in (0, 19, 37))

    def may_hold(self, h: Column) -> Column:
        if not self.ok:
            return F.lit(True)
        a, b, c = (F.getbit(F.get(self.words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in self._places(h))
        return a & b & c
