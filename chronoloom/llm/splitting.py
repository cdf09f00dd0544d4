"""Cutting oversized items at natural boundaries, with an overlap (problem 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.token_ids import VOCABULARY, encoding, token_bytes, well_formed

# Places to cut and the penalty of a cut there: paragraphs and code blocks, lines, sentences, clauses, words, signs inside long strings.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, SIGN, ANYWHERE = 0.0, 0.6, 1.0, 2.0, 3.0, 6.0, 20.0
#: A match ends at the place. Lines, words, clauses and sentences are found by their bytes, without a pattern.
LINE_TAG = re.compile(rb"<br\s*/?>|</li>|</blockquote>")
PARAGRAPH_TAG = re.compile(rb"(?:<br\s*/?>\s*){2,}|</p>|</pre>")
PARAGRAPH_END = re.compile(rb"\n(?:[ \t\r]*\n+|(?=```)|(?=#{1,6} ))|```[^\n`]*\n")
WIDE_SENTENCE = re.compile(rb"\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xe0\xa5\xa4")
WIDE_CLAUSE = re.compile(rb"\xe3\x80\x81|\xef\xbc\x8c")
SIGNS = re.compile(rb"[^\w\s\x80-\xff](?=\w)")
#: By the byte before a space: how good a place it is.
AFTER = np.full(256, WORD)
AFTER[[*b".!?"]] = SENTENCE
AFTER[[*b",;:"]] = CLAUSE
CLOSING = np.zeros(256, dtype=bool)
CLOSING[[*b"\"')]"]] = True
#: Tokens of a stretch. A place that is dearer than another one in its stretch by more than moving a cut by a stretch can change in balance is no
#: place; characters are places only in stretches without any.
STRETCH = 24


def best_cuts(at: list[int], starts: list[int], price: list[float], limit: int, even: float, scale: float) -> list[int]:
    """For each place the place of the cut before it in the cheapest division up to there; -1 where there is none.

    A piece from starts[i] to at[j] costs price[j] + scale * (its size - even)^2 and has at most `limit` tokens; starts ascend with at.
    Exact dynamic programming over all places in linear time: of two earlier cuts the later one, once better, stays better as pieces grow,
    so candidates wait in a queue in the order in which they take over, at the crossing of their costs or when the one before grows too long.
    """
    m, half = len(at), 0.5 / scale
    cost, back = [0.0] * m, [-1] * m
    queue, since, head, tail = [0] * m, [-1] * m, 0, 0
    for j in range(1, m):
        t = at[j]
        while head < tail and since[head + 1] <= t:
            head += 1
        i = queue[head]
        size = t - starts[i]
        if size > limit:
            continue
        back[j] = i
        size -= even
        own = cost[j] = cost[i] + scale * size * size + price[j]
        s, turn = starts[j], -1
        while tail >= head:
            k = queue[tail]
            first = starts[k]
            gap, turn = s - first, first + limit  # k is too long beyond
            if gap:
                cross = (s + first) * 0.5 + even + (own - cost[k]) * half / gap
                if cross < turn:
                    turn = int(cross) if cross > 0 else -1
            elif own < cost[k]:
                turn = -1
            turn += 1  # it takes over at the next whole number of tokens
            if turn > since[tail] and (turn > t or tail > head):
                break
            tail -= 1
            turn = -1
        tail += 1
        queue[tail], since[tail] = j, turn
    return back


class Splitter:
    def __init__(self, limit: int = 512, overlap: int = 64, path: str = VOCABULARY, every_place: bool = False):
        if not 0 <= overlap < limit // 2:
            raise ValueError("the overlap must be less than half the limit")
        self.limit, self.overlap, self.every_place = limit, overlap, every_place
        self.sizes, self.encode, self.whole = token_bytes(path), encoding(path).encode_ordinary, encoding(path).encode_to_numpy
        self.tails: dict[bytes, int] = {}

    def _places(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers and penalties of the places to cut: each ends a token and lies between characters."""
        n = len(ends)
        penalty = np.full(n + 1, np.inf)

        def mark(at: np.ndarray, cost) -> None:
            k = np.searchsorted(ends, at)
            ok = k < n - 1
            ok[ok] = ends[k[ok]] == at[ok]
            penalty[k[ok] + 1] = cost if np.isscalar(cost) else cost[ok]

        def ended(pattern: re.Pattern) -> np.ndarray:
            return np.array([m.end() for m in pattern.finditer(raw)], dtype=np.int64)

        bytes_ = np.frombuffer(raw, dtype=np.uint8)
        at = np.flatnonzero((bytes_[1:] == 32) & (bytes_[:-1] > 32)) + 1
        before = bytes_[at - 1]
        cost = AFTER[before]
        quoted = CLOSING[before] & (at > 1)
        cost[quoted] = np.where(AFTER[bytes_[at[quoted] - 2]] == SENTENCE, SENTENCE, WORD)
        mark(at, cost)
        if not raw.isascii():
            mark(ended(WIDE_CLAUSE), CLAUSE)
            mark(ended(WIDE_SENTENCE), SENTENCE)
        tags = b"<" in raw
        if tags:
            mark(ended(LINE_TAG), LINE)
        lines = np.flatnonzero(bytes_ == 10) + 1
        if len(lines):
            mark(lines, LINE)
            mark(ended(PARAGRAPH_END), PARAGRAPH)
        if tags:
            mark(ended(PARAGRAPH_TAG), PARAGRAPH)
        first = np.arange(0, n + 1, STRETCH)
        best = np.minimum.reduceat(penalty, first)
        if np.isinf(best).any():
            lonely = np.repeat(np.isinf(best), np.diff(np.append(first, n + 1)))
            inside = np.zeros(n + 1, dtype=bool)
            inside[1:n] = (bytes_[ends[: n - 1]] & 0xC0) == 0x80  # the next byte goes on with a character
            signs = np.full(n + 1, np.inf)
            kept, penalty = penalty, signs
            mark(ended(SIGNS), SIGN)
            penalty = np.where(lonely, np.where(inside, np.inf, np.minimum(signs, ANYWHERE)), kept)
            best = np.minimum.reduceat(penalty, first)
        if not self.every_place:
            penalty[penalty > np.repeat(best + 16 * STRETCH / self.limit, np.diff(np.append(first, n + 1)))] = np.inf
        penalty[0] = penalty[n] = 0.0
        at = np.flatnonzero(np.isfinite(penalty))
        return at, penalty[at]

    def cuts(self, raw: bytes, ends: np.ndarray, limit: int) -> list[tuple[int, int, bool]]:
        """(from, to, hard) of the pieces in token numbers: dynamic programming over all places to cut. hard: an end lies inside a long string.

        The cost of a piece is its cut's penalty plus its squared distance from an even share; a piece begins near `overlap` tokens before
        the cut before it, at the best place there, and has at most `limit` tokens.
        """
        n, overlap = len(ends), self.overlap
        at, penalty = self._places(raw, ends)
        far = (at >= overlap) | (at == 0)  # a first piece within the overlap would lie in the second
        at, penalty = at[far], penalty[far]
        begin = self._begins(n, at, penalty)
        parts = max(2, -(-(n - overlap) // (limit - overlap)))
        even = (n + overlap * (parts - 1)) / parts
        back = best_cuts(at.tolist(), at[begin].tolist(), (penalty + 1.5).tolist(), limit, even, 4.0 / limit**2)
        out, j = [], len(at) - 1
        while j > 0:
            i = back[j]
            if i < 0:
                return []
            out.append((int(at[begin[i]]), int(at[j]), bool(penalty[j] >= SIGN or penalty[begin[i]] >= SIGN)))
            j = i
        return out[::-1]

    def _begins(self, n: int, at: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        """Where the piece after a cut at each place begins: at the place `overlap` / 2 to 2 `overlap` tokens before it with the least distance from `overlap` and penalty."""
        own, overlap = np.arange(len(at)), self.overlap
        if not overlap:
            return own
        least, most = max(1, overlap // 2), 2 * overlap
        cost = np.full(n + 1 + most, np.inf, dtype=np.float32)  # by token number + most, so that every window lies inside
        cost[at + most] = penalty / 4
        distance = (np.abs(np.arange(most, least - 1, -1) - overlap) / overlap).astype(np.float32)
        windows = np.lib.stride_tricks.sliding_window_view(cost, most - least + 1)
        begin = own.copy()
        for lo in range(0, len(at), 4096):  # a few megabytes at a time
            t = at[lo : lo + 4096]
            found = windows[t] + distance
            best = found.argmin(axis=1)
            place = t - most + best
            begin[lo : lo + 4096] = np.where(np.isfinite(found[np.arange(len(t)), best]), np.searchsorted(at, place), own[lo : lo + 4096])
        begin[0] = 0
        return np.minimum(np.maximum.accumulate(begin), own)

    def _even(self, raw: bytes, ends: np.ndarray, limit: int) -> list[tuple[int, int, bool]]:
        """Pieces of `limit` tokens at character borders, for texts in which the places to cut leave no way through."""
        n, out, a = len(ends), [], 0
        ok = np.ones(n + 1, dtype=bool)
        ok[1:n] = (np.frombuffer(raw, dtype=np.uint8)[ends[: n - 1]] & 0xC0) != 0x80
        good = np.flatnonzero(ok)
        while True:
            b = int(good[np.searchsorted(good, min(n, a + limit), side="right") - 1])
            out.append((a, b, True))
            if b >= n:
                return out
            a = int(good[max(np.searchsorted(good, b - self.overlap), np.searchsorted(good, a, side="right"))])

    def count(self, piece: bytes, ends: np.ndarray, a: int, b: int, hard: bool) -> int:
        """Tokens of a piece encoded by itself.

        Between places where the tokenizer always splits they are those of the whole text, but for white space at the end, which by itself
        is one stretch; a piece cut inside a string is encoded.
        """
        if hard:
            return len(self.encode(piece.decode("utf-8")))
        body = piece.rstrip(b" \t\r\n\x0b\x0c")
        if len(body) == len(piece) or not body:
            return b - a if body else len(self.encode(piece.decode("utf-8")))
        base = int(ends[a - 1]) if a else 0
        k = int(np.searchsorted(ends, base + len(body)))
        if ends[k] != base + len(body):
            return len(self.encode(piece.decode("utf-8")))
        tail = piece[len(body) :]
        if tail not in self.tails:
            self.tails[tail] = len(self.encode(tail.decode("utf-8")))
        return k + 1 - a + self.tails[tail]

    def pieces(self, text: str | None) -> list[tuple[int, int, int, str]]:
        """(start, end, tokens, text) of each piece, in characters of the text. None for null and empty texts."""
        if not text:
            return []
        text = well_formed(text)
        ids = self.whole(text)
        if len(ids) <= self.limit:
            return [(0, len(text), len(ids), text)]
        raw = text.encode("utf-8")
        ends = np.cumsum(self.sizes[ids])
        limit = self.limit
        while True:
            out, good = [], True
            spans = self.cuts(raw, ends, limit) or self._even(raw, ends, limit)
            for a, b, hard in spans:
                lo, hi = (int(ends[a - 1]) if a else 0), int(ends[b - 1])
                piece = raw[lo:hi]
                tokens = self.count(piece, ends, a, b, hard)
                if tokens > self.limit:
                    good = False
                    break
                out.append((lo, hi, tokens, piece.decode("utf-8")))
            if good:
                break
            limit -= 8  # a cut inside a long string made tokens anew; leave a little more room
        if text.isascii():
            return out
        result, last_byte, last_char = [], 0, 0
        for lo, hi, tokens, piece in out:
            start = last_char + len(raw[last_byte:lo].decode("utf-8")) if lo >= last_byte else last_char - len(raw[lo:last_byte].decode("utf-8"))
            last_byte, last_char = lo, start
            result.append((start, start + len(piece), tokens, piece))
        return result


SCHEMA = pa.schema([("_key", pa.int64()), ("piece_no", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.int32()), ("piece", pa.string())])


def _split(limit: int, overlap: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(limit, overlap, path)
        for batch in batches:
            keys, texts, rows, held = batch.column(0), batch.column(1), [], 0
            for i in range(batch.num_rows):
                for no, (a, b, n, piece) in enumerate(splitter.pieces(texts[i].as_py())):
                    rows.append((i, no, a, b, n, piece))
                    held += len(piece)
                if rows and (held > 4_000_000 or i == batch.num_rows - 1):
                    yield _batch(keys, rows)
                    rows, held = [], 0
            if rows:
                yield _batch(keys, rows)

    def _batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, *cols = zip(*rows)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *[pa.array(c, f.type) for c, f in zip(cols, list(SCHEMA)[1:])]], names=SCHEMA.names)

    return run


def split_texts(df: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 64, path: str = VOCABULARY) -> DataFrame:
    """key, piece_no, start_char, end_char, n_tokens, piece: every text in pieces of at most `limit` tokens, counted on the piece by itself.

    Cuts lie between paragraphs, code blocks, lines, sentences, clauses or words where there are any, and consecutive pieces share about
    `overlap` tokens; a text within the limit is one piece; null and empty texts have none; whole texts are cut, whatever their length.
    Repeated rows are cut as often as they are; other columns, also of clashing names, are ignored.
    Method: dynamic programming over the places to cut minimises cut penalties and size imbalance subject to limit and overlap. Places that are
    dearer than another one within 24 tokens by more than balance can make up are left out (the cost is then 0.03 % above that of all places on the test
    documents); 24 tokens without any place may be cut between characters. Rows are independent: there is no shuffle.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    out = rows.mapInArrow(_split(limit, overlap, path), f"_key {kind}, piece_no int, start_char bigint, end_char bigint, n_tokens int, piece string")
    return out.withColumnRenamed("_key", key)
