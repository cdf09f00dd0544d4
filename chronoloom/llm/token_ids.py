"""Encoding of the whole corpus with a public byte-level tokenizer (problem 7)."""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every worker; a parameter of each operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: One in so many possible cuts is made; bytes of chunk text remembered by a worker.
CUT_EVERY, REMEMBER_BYTES = 24, 24_000_000
#: A stretch of more bytes without a place where the tokenizer always splits is cut anywhere, and the joins repaired.
LONG_STRETCH = 2_048
#: Where the pattern begins a token whatever is around: between letters, numbers and other signs, but not after an apostrophe.
BORDER = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each token, by id."""
    e = encoding(path)
    return np.array([len(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)], dtype=np.int64)


def chunk_ends(raw: np.ndarray, every: int = CUT_EVERY) -> tuple[list[int], set[int]]:
    """Ends of chunks, and those of them that end a long stretch.

    Cuts are content-defined: positions whose hash of the eight bytes before them is small, wherever they lie in a text, of those before a space or
    newline that follows a visible ASCII character. The tokenizer's pattern always begins a token there, whatever is around, so that chunks
    encoded apart join into exactly the ids of the whole. A long stretch without such a position is a chunk of its own.
    """
    at = np.flatnonzero((raw[1:] == 32) | (raw[1:] == 10)) + 1
    before = raw[at - 1]
    at = at[(before > 32) & (before < 127) & (at >= 8)]
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(1, 9):
        h = h << np.uint64(8) | raw[at - k].astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    cuts = at[h <= np.uint64((2**64 - 1) // every)]
    edges = np.r_[0, at, len(raw)]
    far = np.flatnonzero(np.diff(edges) > LONG_STRETCH)
    if not len(far):
        return [*cuts.tolist(), len(raw)], set()
    long = edges[far + 1].tolist()
    return sorted({*cuts.tolist(), *edges[far].tolist(), *long, len(raw)} - {0}), set(long)


def inner_cuts(raw: np.ndarray, every: int = CUT_EVERY) -> list[int]:
    """Content-defined cuts of a long stretch, between any two characters: one in some 16 * `every` of them."""
    at = np.flatnonzero((raw[8:] & 0xC0) != 0x80) + 8
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(1, 9):
        h = h << np.uint64(8) | raw[at - k].astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return at[h <= np.uint64((2**64 - 1) // (16 * every))].tolist()


def well_formed(text: str) -> str:
    """The text without lone surrogates, which no UTF-8 source holds."""
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


class Encoder:
    """Encodes texts by chunks; a chunk met before, in whatever document, is not encoded again."""

    def __init__(self, path: str = VOCABULARY, every: int = CUT_EVERY):
        self.encode, self.every, self.sizes = encoding(path).encode_ordinary, every, token_bytes(path)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def chunk(self, chunk: bytes) -> bytes:
        got = self.known.get(chunk)
        if got is None:
            got = array("i", self.encode(chunk.decode("utf-8"))).tobytes()
            if self.held > REMEMBER_BYTES:
                self.known.clear()
                self.held = 0
            self.known[chunk] = got
            self.held += len(chunk)
        return got

    def stretch(self, raw: bytes) -> bytes:
        """The ids of a long stretch: chunks cut anywhere, then each join encoded anew between the nearest borders at which the tokenizer always splits.

        Those borders are ends of tokens in the chunks as well, so that what is put in agrees with the ids to both sides of it; joins without a border
        between them are repaired together.
        """
        ends = [*inner_cuts(np.frombuffer(raw, dtype=np.uint8), self.every), len(raw)]
        parts = [np.frombuffer(self.chunk(raw[a:b]), dtype=np.int32) for a, b in zip([0, *ends], ends)]
        if len(parts) == 1:
            return parts[0].tobytes()
        ids = np.concatenate(parts)
        stops = np.cumsum(self.sizes[ids])  # where each token ends
        text = raw.decode("utf-8")
        borders = np.array([0, *(m.start() for m in BORDER.finditer(text)), len(text)])
        if len(text) != len(raw):  # from characters to bytes
            wide = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
            borders = np.append(wide, len(raw))[borders]
        out, done = [], 0
        joins = np.array(ends[:-1])
        left, right = borders[np.searchsorted(borders, joins, side="right") - 1], borders[np.searchsorted(borders, joins)]
        for a, b in zip(left.tolist(), right.tolist()):
            if a == b or b <= done:
                continue
            a = max(a, done)
            lo, hi = np.searchsorted(stops, [done, a], side="right") if done else (0, int(np.searchsorted(stops, a, side="right")))
            out += [ids[lo:hi].tobytes(), array("i", self.encode(raw[a:b].decode("utf-8"))).tobytes()]
            done = b
        out.append(ids[int(np.searchsorted(stops, done, side="right")) if done else 0 :].tobytes())
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers; none for null and empty texts."""
        if not text:
            return b""
        raw = well_formed(text).encode("utf-8")
        out, start = [], 0
        ends, long = chunk_ends(np.frombuffer(raw, dtype=np.uint8), self.every)
        for end in ends:
            chunk = raw[start:end]
            out.append(self.stretch(chunk) if end in long else self.chunk(chunk))
            start = end
        return b"".join(out)


def _encode(path: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, whole = Encoder(path), encoding(path).encode_to_numpy
        for batch in batches:
            # A few megabytes of text at a time, so that a batch of long texts stays small.
            texts = batch.column(1)
            lo = 0
            while lo < batch.num_rows:
                hi, size = lo, 0
                got = []
                while hi < batch.num_rows and size < 4_000_000:
                    text = texts[hi].as_py()
                    got.append(encoder.ids(text) if not counts_only else 4 * len(whole(well_formed(text))) if text else 0)
                    size += got[-1] if counts_only else len(got[-1])
                    hi += 1
                lens = np.fromiter(((g if counts_only else len(g)) // 4 for g in got), dtype=np.int64, count=len(got))
                keys = batch.column(0).slice(lo, hi - lo)
                if counts_only:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(lens)], names=["_key", "n_tokens"])
                else:
                    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(got), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["_key", "ids"])
                lo = hi

    return run


def encoded(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """key, ids: the token ids of every row's whole text, without special tokens; empty for null and empty texts.

    Strings of special tokens in a text are ordinary text. Repeated rows come out as often as they are; other columns are ignored.
    Method: content-defined chunks; a worker encodes a chunk once however many documents share it. Cuts are made where the tokenizer always
    splits, so that joins agree; a long stretch without such a place is cut anywhere, and its joins are repaired by encoding them anew between the
    nearest borders of tokens. There is no shuffle.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(_encode(path, False), f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def token_counts(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """key, n_tokens (bigint) of every row, as `encoded` would give them; 0 for null and empty texts."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(_encode(path, True), f"_key {kind}, n_tokens bigint").withColumnRenamed("_key", key)
