"""BPE encoding by backtracking over longest token matches; decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import free_name, ship

WORD_END = "</w>"
#: White space of the pattern's ``\s``, as the tokenizer's regular expressions read it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What str.split() also splits at.
SEPARATORS = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile(f"[{SPACE}]+")
#: A chunk's result is kept only up to this length, and only so many of them (bounds a worker's memory).
CACHE_CHARS, CACHE_SIZE = 48, 150_000


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in plain}
    for b in (b for b in range(256) if b not in out):
        out[b] = chr(256 + len(out) - len(plain))
    return out


class BpeCodec:
    """A byte-level BPE model with word ends, from a ``tokenizers`` JSON file.

    Encoding: every word is a string of 512 symbols (a byte, or a byte that ends the word). At each position
    the Aho-Corasick automaton gives the longest token; a token may follow another only if the two, put side
    by side, are what the merges would leave (the pair-compatibility test, remembered in a table); otherwise the
    next shorter token is tried, and if there is none the encoder steps back. A position from which no way
    leads on is marked, so that none is entered twice: the work is linear in the text.
    """

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model = data["model"]
        letters = {c: b for b, c in byte_letters().items()}
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        names = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        size = max(names) + 1
        self.names = [names.get(i, "") for i in range(size)]

        def symbols(token: str) -> str:
            ends = token.endswith(WORD_END) and token != WORD_END
            raw = [letters[c] for c in (token[: -len(WORD_END)] if ends else token)]
            return "".join(map(chr, raw[:-1])) + chr(raw[-1] + 256 * ends)

        self.symbols = {i: symbols(t) for t, i in self.vocab.items()}
        of = {s: i for i, s in self.symbols.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank = {i: -1 for i in of.values()}
        self.pairs: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j = self.vocab[a], self.vocab[b]
            made = self.vocab[a.removesuffix(WORD_END) + b]
            if (i, j) not in self.pairs:
                self.pairs[i, j] = r
            if made not in self.split:
                self.split[made], self.rank[made] = (i, j), r
        self._fits: dict[tuple[int, int], bool] = {}
        self._words: dict[str, bytes] = {}
        self._chunks = _ChunkCache(self)
        # A token that its own merges would not make can never come out; it is left out of the automaton.
        usable = {i for i in of.values() if i not in self.split}
        for made in sorted(self.split, key=self.rank.__getitem__):
            i, j = self.split[made]
            if i in usable and j in usable and self._compatible(i, j, self.rank[made]):
                usable.add(made)
        self._fits.clear()
        self.lengths = {i: len(s) for i, s in self.symbols.items()}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in of.items():
            if i in usable:
                self.automaton.add_word(s, i)
                self.shorter[i] = next((of[s[:n]] for n in range(len(s) - 1, 0, -1) if of.get(s[:n]) in usable), -1)
        self.automaton.make_automaton()
        pattern = "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))
        self.specials = regex.compile(f"({pattern})") if pattern else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
        # The offset table: token i is blob[offsets[i]:offsets[i + 1]], each followed by the space that joins tokens.
        pieces = [f"{t} ".encode() for t in self.names]
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def _compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether no merge would have joined ``left`` and ``right`` across their border.

        The two are taken apart from the latest merge back. A pair that touches the border joins if its merge
        comes before the merge that used up one of its sides; at equal rank the left one goes first.
        ``below``: only merges before this one count.
        """
        # (rank, 1) on the right side: the merge that made it lies right of the border, so an equal rank across wins.
        limit = (below if below is not None else 1 << 40, 0)
        while True:
            across = self.pairs.get((left, right))
            if across is not None and (across, 0) < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = min(limit, (a, 0)), self.split[left][1]
            else:
                limit, right = min(limit, (b, 1)), self.split[right][0]

    def fits(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > CACHE_SIZE:
                self._fits.clear()
            known = self._fits[left, right] = self._compatible(left, right)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        text = word[:-1].decode("latin-1") + chr(word[-1] + 256)
        longest = [-1] * len(text)
        lengths, shorter, fits = self.lengths, self.shorter, self.fits
        for end, token in self.automaton.iter(text):
            longest[end + 1 - lengths[token]] = token  # ends grow: the last one stays
        open_ = bytearray(b"\x01") * (len(text) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            end = at + lengths[token]
            while not (open_[end] and (not out or fits(out[-1], token))):
                token = shorter[token]
                if token < 0:
                    break
                end = at + lengths[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(text) else -1
            else:
                open_[at] = 0
                token = out.pop()
                at -= lengths[token]
        return out

    def word_ids(self, word: str) -> bytes:
        """Ids of one word of the pattern, as little-endian unsigned 32-bit integers."""
        ids = self._words.get(word)
        if ids is None:
            ids = struct.pack(f"<{len(out)}I", *out) if len(out := self.encode_word(word.encode())) else b""
            if len(word) <= CACHE_CHARS:
                if len(self._words) >= CACHE_SIZE:
                    self._words.clear()
                self._words[word] = ids
        return ids

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a piece of text; pieces may be cut at white space."""
        if self.specials and "<" in chunk:
            out = []
            for part in self.specials.split(chunk):
                out.append(struct.pack("<I", self.added[part]) if part in self.added else self._encode_plain(part))
            return b"".join(out)
        return self._encode_plain(chunk)

    def _encode_plain(self, part: str) -> bytes:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part)
            if "Σ" in part:  # no final sigma
                part = "".join(c.lower() for c in part)
        return b"".join(map(self.word_ids, self.words.findall(part.lower())))

    def encode(self, text: str) -> np.ndarray:
        chunks = SPACES.split(text) if SEPARATORS.search(text) else text.split()
        return np.frombuffer(b"".join(map(self._chunks.__getitem__, chunks)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.decode_parts(ids)).decode()

    def decode_parts(self, ids: np.ndarray, step: int = 1 << 17) -> Iterator[bytes]:
        for i in range(0, len(ids), step):
            part = ids[i : i + step].astype(np.int64)
            start, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            to = np.cumsum(size)
            out = self.blob[np.arange(to[-1]) + np.repeat(start - to + size, size)]
            yield (out if i + step < len(ids) else out[:-1]).tobytes()


class _ChunkCache(dict):
    def __init__(self, codec: BpeCodec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        ids = self.codec.encode_chunk(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[chunk] = ids
        return ids


_CODECS: dict[str, BpeCodec] = {}


def codec(spec: str) -> BpeCodec:
    """One codec for each model and process."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = BpeCodec(spec)
    return _CODECS[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shared_spec(docs: DataFrame, path: str):
    """The model file, read on the driver and sent once to each executor; its size does not depend on the data."""
    spec = read_spec(path)
    if len(spec) > 64 << 20:
        raise ValueError(f"{path}: a model file of {len(spec)} characters is too large to send to all executors")
    return ship(docs.sparkSession).sparkContext.broadcast(spec)


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The input with ``ids_col array<bigint>`` (replaced if it is there). Null text gives null, empty text no ids."""
    spec = _shared_spec(docs, path)

    @F.pandas_udf("array<bigint>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(spec.value)
        for s in texts:
            yield pd.Series([None if t is None else c.encode(t).astype(np.int64) for t in s], dtype=object)

    return docs.withColumn(ids_col, encode(F.col(text_col)))


def bpe_decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The input with ``text_col``: the tokens of ``ids_col`` joined by spaces, as the model without a decoder has it."""
    spec = _shared_spec(docs, path)

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(spec.value)
        for s in ids:
            yield pd.Series([None if i is None else c.decode(np.asarray(i, dtype=np.int64)) for i in s], dtype=object)

    return docs.withColumn(text_col, decode(F.col(ids_col)))


def bpe_digest(docs: DataFrame, path: str, text_col: str = "text", ids_col: str | None = None) -> DataFrame:
    """The input with ``n_tokens, ids_sha256, decoded_sha256``, and the ids themselves if ``ids_col`` is named.

    Whole texts are encoded and decoded again; the ids' digest is that of little-endian unsigned 32-bit integers.
    Null text counts as empty. Columns of these names are replaced. Every row is encoded by itself, repeated rows alike; an
    empty table gives an empty result.
    """
    spec = _shared_spec(docs, path)
    fields = "n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>" if ids_col else "")

    @F.pandas_udf(f"struct<{fields}>")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(spec.value)
        for s in texts:
            rows = []
            for t in s:
                ids = c.encode(t or "")
                decoded = hashlib.sha256()
                for part in c.decode_parts(ids):
                    decoded.update(part)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), decoded.hexdigest(), *([ids.astype(np.int32)] if ids_col else [])))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids_col else [])])

    names = {"n_tokens": "n_tokens", "ids_sha256": "ids_sha256", "decoded_sha256": "decoded_sha256"} | ({ids_col: "ids"} if ids_col else {})
    kept = [c for c in docs.columns if c not in names]
    name = free_name(docs, "digest")
    both = docs.select(*[F.col(f"`{c}`") for c in kept], digest(F.col(text_col)).alias(name))
    return both.select(*[F.col(f"`{c}`") for c in kept], *[F.col(name).getField(f).alias(n) for n, f in names.items()])
