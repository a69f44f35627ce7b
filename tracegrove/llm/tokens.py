"""Problem 6: byte-level BPE ids of every document.

Pre-tokenisation runs without regex over whole batches of texts at once. Every code point has a class
(letter, number, apostrophe, other, white space); with its neighbours' classes it becomes one of nine
symbols. A symbol is a function from automaton state to automaton state; the functions that arise from
composing them form a small monoid, so a run of text is one monoid element and composition is a table
look-up. Text is laid out in columns, each column is scanned with all others side by side, the columns'
totals are composed, and that gives the state before every character, hence every slice's start.

Slices are merged by rank (``merge``) once each and kept in a cache per task. A slice is looked up by a hash of its
code points and then held against the code points of the one that was kept, so equal hashes of different slices give
no wrong ids. Ids never depend on the batch. The slices' offsets are retained (``encode_with_offsets``): with them
any stretch of a text is decoded from its own ids alone.

Defined cases: null and empty text give no ids; text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import bisect
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHED = 300_000  # slices kept per task
BLOCK = 1_500_000  # code points scanned at once

# Classes of code points.
OTHER, LETTER, NUMBER, SPACE, WHITE, APOSTROPHE, END = range(7)
END_MARK = 0x110000
# Symbols: a code point with what its neighbours decide.
S_OTHER, S_LETTER, S_NUMBER, S_SHORT, S_LONG, S_LEAD, S_LONE, S_WHITE, S_END = range(9)
# States: what the slice so far is. LEAD: one space that the next slice begins with. TWO, ONE: code points still due in a contraction.
FRESH, IN_OTHER, IN_LETTER, IN_NUMBER, IN_WHITE, LEAD, TWO, ONE = range(8)
# Code points that are white space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@cache
def classes() -> np.ndarray:
    """The class of every code point; the one behind the last stands for the end of a text."""
    category = {"L": LETTER, "N": NUMBER}
    out = np.full(END_MARK + 1, END, np.uint8)
    out[:END_MARK] = np.fromiter((category.get(unicodedata.category(chr(i))[0], OTHER) for i in range(END_MARK)), np.uint8, END_MARK)
    out[WHITE_SPACE] = WHITE
    out[32], out[39] = SPACE, APOSTROPHE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice starts at the symbol."""
    if state in (TWO, ONE) and symbol != S_END:
        return (ONE if state == TWO else FRESH), False
    if symbol in (S_OTHER, S_LETTER, S_NUMBER):
        into = {S_OTHER: IN_OTHER, S_LETTER: IN_LETTER, S_NUMBER: IN_NUMBER}[symbol]
        return into, state not in (into, LEAD)
    if symbol in (S_SHORT, S_LONG):  # 's or 'll; inside or after a run of others the apostrophe is one of them
        return (IN_OTHER, False) if state in (IN_OTHER, LEAD) else ((ONE if symbol == S_SHORT else TWO), True)
    if symbol == S_LEAD:
        return LEAD, True
    if symbol == S_LONE:
        return FRESH, True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    return FRESH, True


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Composition table, the element of each symbol, the state each element leads to from FRESH, and the starts by state and symbol."""
    symbols = [tuple(_step(s, y)[0] for s in range(8)) for y in range(9)]
    elements = {tuple(range(8)): 0}
    for f in symbols:
        elements.setdefault(f, len(elements))
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in symbols:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    if len(elements) > 65_535:
        raise ValueError("too many elements")
    every = list(elements)
    table = np.array([[elements[tuple(g[x] for x in f)] for g in every] for f in every], np.uint16)
    starts = np.array([[_step(s, y)[1] for y in range(9)] for s in range(8)])
    return table, np.array([elements[f] for f in symbols], np.uint16), np.array([f[FRESH] for f in every], np.uint8), starts


def slice_starts(points: np.ndarray) -> np.ndarray:
    """Indices in ``points`` at which slices start. Texts are separated by END_MARK, which is a slice of its own."""
    n = len(points)
    kind = classes()[points]
    after = np.empty(n, np.uint8)
    after[:-1], after[-1:] = kind[1:], END
    space = (kind == SPACE) | (kind == WHITE)
    before_word = space & (after <= NUMBER) | space & (after == APOSTROPHE)
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_WHITE, S_OTHER, S_END], np.uint8)[kind]
    symbol[before_word & (kind == SPACE)] = S_LEAD
    symbol[before_word & (kind == WHITE)] = S_LONE
    at = np.flatnonzero(kind == APOSTROPHE)
    if len(at):
        one = points[np.minimum(at + 1, n - 1)]
        two = points[np.minimum(at + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "sdmt"]) & (at + 1 < n)
        long = ((one == ord("l")) & (two == ord("l")) | (one == ord("v")) & (two == ord("e")) | (one == ord("r")) & (two == ord("e"))) & (at + 2 < n)
        symbol[at[short]] = S_SHORT
        symbol[at[long & ~short]] = S_LONG
    table, of_symbol, leads_to, starts = monoid()
    # Columns of equal height; the last is filled up with the neutral element.
    height = max(1, int(n**0.5) // 2)
    width = -(-n // height)
    element = np.zeros(height * width, np.uint16)
    element[:n] = of_symbol[symbol]
    grid = np.ascontiguousarray(element.reshape(width, height).T)
    flat, m = table.ravel(), len(table)
    grid = grid.astype(np.int32)
    prefix = np.empty(grid.shape, np.uint16)  # composition of what stands above in the column
    total = np.zeros(width, np.uint16)
    for row in range(height):
        prefix[row] = total
        total = flat.take(total * np.int32(m) + grid[row])
    carry, running = np.zeros(width, np.uint16), 0
    for column, t in enumerate(total.tolist()):
        carry[column] = running
        running = int(table[running, t])
    # What matters of carry then prefix is the state they lead to from a fresh start.
    state = after_both().ravel().take(carry.astype(np.int32)[None, :] * np.int32(m) + prefix).T.ravel()[:n]
    return np.flatnonzero(starts.ravel().take(state.astype(np.int16) * np.int16(9) + symbol))


@cache
def after_both() -> np.ndarray:
    """The state that one element and then another lead to from FRESH."""
    table, _, leads_to, _ = monoid()
    return leads_to[table]


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(data: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one slice: the pair of lowest rank is joined, leftmost first, until none is known."""
    if data in rank:
        return [rank[data]]
    if len(data) > 400:
        return _merge_long(data, rank)
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [rank[p] for p in parts]


def _merge_long(data: bytes, rank: dict[bytes, int]) -> list[int]:
    """As ``merge``, in n log n by a heap over a linked list: a slice may be as long as a text."""
    import heapq

    n = len(data)
    part, left, right = [data[i : i + 1] for i in range(n)], list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []

    def push(i):
        j = right[i]
        if j >= 0 and (r := rank.get(part[i] + part[j])) is not None:
            heapq.heappush(heap, (r, i, part[i], part[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if part[i] is None or j < 0 or part[i] != a or part[j] != b:
            continue
        part[i], part[j], right[i] = a + b, None, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [rank[p] for p in part if p is not None]


LONGEST_KNOWN = 64  # code points of a slice that is looked up by its hash; longer ones are merged each time
_BASE = 0x9E3779B97F4A7C15 | 1  # an odd multiplier, so that it has an inverse modulo 2**64


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return out[0], out[1]


class Encoder:
    """Ids of many texts, with the slices seen so far known by a 64-bit polynomial hash of their code points."""

    def __init__(self, path: str = VOCABULARY):
        self.rank = ranks(path)
        self._forget()

    def _forget(self):
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and the slice of each
        self.ids, self.first = [], [0]  # ids of slice k: ids[first[k] : first[k + 1]]
        self.points, self.begin = [], [0]  # code points of slice k, as ids

    def slices(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts and their code points, where each slice starts and stops, and how many each text has."""
        joined = "\x00".join(texts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        points[np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1] = END_MARK
        starts = slice_starts(points)
        mark = points[starts] == END_MARK
        counts = np.diff(np.flatnonzero(mark), prepend=-1) - 1
        stops = np.append(starts[1:], len(points))
        return joined, points, starts[~mark], stops[~mark], counts

    def _numbers(self, joined: str, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The number of each slice; new ones are merged and added."""
        key = self._keys(points, starts, stops)
        at = np.searchsorted(self.hashes, key)
        hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == key if len(self.hashes) else np.zeros(len(key), bool)
        long = stops - starts > LONGEST_KNOWN
        key[long] = np.flatnonzero(long).astype(np.uint64) | np.uint64(1 << 63)  # one key each, forgotten below
        new, where = np.unique(key[~hit | long], return_index=True)
        number = np.empty(len(key), np.int64)
        if len(new):
            place = np.flatnonzero(~hit | long)[where]
            fresh = self._add(joined, points, starts[place], stops[place])
            number[~hit | long] = fresh[np.searchsorted(new, key[~hit | long])]
        hit &= ~long
        number[hit] = self.numbers[at[hit]]
        if len(new):
            keep = ~long[place]
            hashes, numbers = np.concatenate([self.hashes, new[keep]]), np.concatenate([self.numbers, fresh[keep]])
            order = np.argsort(hashes)
            self.hashes, self.numbers = hashes[order], numbers[order]
        wrong = np.flatnonzero(~self._same(points, starts, stops, number))
        if len(wrong):  # another slice has the same hash: these are merged each time
            number[wrong] = self._add(joined, points, starts[wrong], stops[wrong])
        return number

    def _keys(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """A hash of each slice's code points."""
        size = 1 << max(20, (len(points) + 1).bit_length())
        up, down = _powers(size)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
        key = (total[stops] - total[starts]) * down[starts]
        return key ^ (key >> np.uint64(29))

    def _add(self, joined: str, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Merges slices and keeps them; their numbers."""
        fresh = np.arange(len(starts)) + len(self.first) - 1
        for i, j in zip(starts.tolist(), stops.tolist()):
            self.ids += merge(joined[i:j].encode("utf-8", "replace"), self.rank)
            self.first.append(len(self.ids))
            self.points.append(points[i:j])
            self.begin.append(self.begin[-1] + j - i)
        return fresh

    def _same(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether each slice is the one kept under its number, code point by code point."""
        if len(self.points) > 1:
            self.points = [np.concatenate(self.points)]
        kept, begin = self.points[0] if self.points else points[:0], np.array(self.begin, np.int64)
        lengths = stops - starts
        same = begin[number + 1] - begin[number] == lengths
        # ``shift`` leads from a place in the text to its place among what is kept; 32 bits hold both.
        for a in range(0, len(number), 100_000):
            part = np.flatnonzero(same[a : a + 100_000]) + a
            n = lengths[part]
            place = np.arange(int(n.sum()), dtype=np.int32) + np.repeat((starts[part] - (np.cumsum(n) - n)).astype(np.int32), n)
            shift = np.repeat((begin[number[part]] - starts[part]).astype(np.int32), n)
            differs = kept[place + shift] != points[place]
            if differs.any():
                same[np.repeat(part, n)[differs]] = False
        return same

    def encode(self, texts: list[str], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and how many each text has. Longer texts than ``block`` are scanned in parts."""
        if not any(len(t) > block for t in texts):
            return self._encode(texts)
        ids, counts = [], []
        for t in texts:
            parts = [self._encode([p])[0] for p in cut_long(t, block)]
            ids += parts
            counts.append(sum(map(len, parts)))
        return np.concatenate(ids), np.array(counts, np.int64)

    def offsets(self, text: str, block: int = BLOCK) -> tuple[list[int], list[int], list[int]]:
        """The ids of a text, where each of its slices begins (in code points), and how many ids each slice has."""
        ids, begins, lengths, base = [], [], [], 0
        for part in cut_long(text, block):
            if len(self.first) > CACHED:
                self._forget()
            joined, points, starts, stops, _ = self.slices([part])
            number = self._numbers(joined, points, starts, stops)
            first = np.array(self.first, np.int64)
            for k in number.tolist():
                ids += self.ids[first[k] : first[k + 1]]
            lengths += np.diff(first)[number].tolist()
            begins += (starts + base).tolist()
            base += len(part)
        return ids, begins, lengths

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.first) > CACHED:
            self._forget()
        joined, points, starts, stops, counts = self.slices(texts)
        number = self._numbers(joined, points, starts, stops)
        first = np.array(self.first, np.int64)
        lengths = np.diff(first)[number]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.array(self.ids, np.int32)[np.repeat(first[number] - total[:-1], lengths) + np.arange(total[-1])]
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


def _safe(text: str, at: int, block: int) -> int:
    """The first place from ``at`` on where a blank, tab or line feed follows something that is not white, or the end."""
    while at < len(text):
        kind = classes()[np.frombuffer(text[at - 1 : at + block].encode("utf-32-le", "surrogatepass"), np.uint32)]
        points = np.frombuffer(text[at : at + block].encode("utf-32-le", "surrogatepass"), np.uint32)
        white = (kind == SPACE) | (kind == WHITE)
        found = np.flatnonzero(np.isin(points, [9, 10, 32]) & ~white[:-1])
        if len(found):
            return at + int(found[0])
        at += block
    return len(text)


def cut_long(text: str, block: int) -> list[str]:
    """Parts of about ``block`` code points, cut before white space that follows something else: a slice starts there whatever comes before."""
    parts, at = [], 0
    while len(text) - at > block:
        end = _safe(text, at + block, block)
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]] if at < len(text) or not parts else parts


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _encoding(path: str, lengths_only: bool, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_local(path))
        for batch in batches:
            keep = [c for c in batch.schema.names if c != text]
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for a, b in _blocks(texts):
                ids, counts = encoder.encode(texts[a:b])
                if lengths_only:
                    out = pa.array(counts, pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), out], [*keep, "n_tokens" if lengths_only else "ids"])

    return run


def vocabulary_path(path: str | None = None) -> str:
    return path or os.environ.get("TOKENIZER_PATH") or VOCABULARY


def _shipped(df: DataFrame, path: str | None) -> str:
    """The vocabulary's path, once Spark has sent the file to every executor under its name."""
    path = vocabulary_path(path)
    context = df.sparkSession.sparkContext
    if os.path.exists(path) and not any(os.path.basename(f) == os.path.basename(path) for f in context.listFiles):
        context.addFile(path)
    return path


def _local(path: str) -> str:
    """Where a task finds the vocabulary: what was sent to it, else the path itself."""
    sent = SparkFiles.get(os.path.basename(path))
    return sent if os.path.exists(sent) else path


def _shape(df: DataFrame, text: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)


def encode(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` and ``ids``, one row per row of ``df``."""
    rows = df.select(*keep, F.col(text))
    return rows.mapInArrow(_encoding(_shipped(df, path), False, text), f"{_shape(rows, text)}, ids array<int>")


def encode_with_offsets(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep``, ``ids``, and of each slice its first code point (``starts``) and its number of ids (``lengths``)."""
    rows, path = df.select(*keep, F.col(text)), _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_local(path))
        for batch in batches:
            found = [encoder.offsets(t or "") for t in batch.column(text).to_pylist()]
            kept = [c for c in batch.schema.names if c != text]
            columns = [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "ids", "starts", "lengths"])

    return rows.mapInArrow(run, f"{_shape(rows, text)}, ids array<int>, starts array<int>, lengths array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` and ``n_tokens``, one row per row of ``df``."""
    rows = df.select(*keep, F.col(text))
    return rows.mapInArrow(_encoding(_shipped(df, path), True, text), f"{_shape(rows, text)}, n_tokens long")


def decode_stretch(ids: list[int], starts: list[int], lengths: list[int], begin: int, end: int, path: str | None = None) -> str:
    """The code points ``begin`` to ``end`` of a text, from the ids of the slices that reach into them alone."""
    first = max(0, bisect.bisect_right(starts, begin) - 1)
    last = bisect.bisect_left(starts, end)
    before = sum(lengths[:first])
    text = decode(ids[before : before + sum(lengths[first:last])], path)
    return text[begin - starts[first] : end - starts[first]] if starts else ""


def decode(ids: list[int], path: str | None = None) -> str:
    back = _back(vocabulary_path(path))
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


@cache
def _back(path: str) -> dict[int, bytes]:
    return {i: t for t, i in ranks(path).items()}


def counts_by(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """Documents, tokens and the longest document per ``key``."""
    counted = token_counts(df, [key], text, path)
    return counted.groupBy(key).agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
