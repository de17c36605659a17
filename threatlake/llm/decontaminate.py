"""Benchmark decontamination by the q-gram lemma.

Shared character q-grams of a document and a benchmark item are counted in overlapping
bands of diagonals. A text within e edits of an item of length n shares at least
n + 1 - q - q*e of its q-grams in some band; regions that reach this bound are verified
by banded alignment. Short items have shorter grams, so that the bound is at least 1.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, filter_texts, fresh

#: Longest grams; an item of length n with e edits has min(Q, n // (e + 1)).
Q = 10
#: Edits allowed, as a share of the item's length.
EDIT_SHARE = 0.08
#: Text of the benchmark that is sent to the tasks at once; a larger one is searched in blocks.
BLOCK_CHARS = 4_000_000
#: Shared grams that one numpy step counts, about.
STEP_HITS = 1_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def normal(text: str) -> str:
    """Lower case, white space as one space; positions refer to this form."""
    return " ".join(text.lower().split())


def gram_keys(text: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit key of the q characters from each position on (UTF-32 code points)."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = text.astype(np.uint64)
    if q != Q:
        key = c[:n]
        for i in range(1, q):
            key = (key ^ (key >> np.uint64(29))) * _MIX[i % 2] + c[i : i + n]
        return key ^ (key >> np.uint64(32))
    two = c[:-1] * np.uint64(0x100000001B3) + c[1:]
    four = two[:-2] * _MIX[0] + two[2:]
    eight = (four[:-4] ^ (four[:-4] >> np.uint64(31))) * _MIX[1] + four[4:]
    key = (eight[:n] ^ (eight[:n] >> np.uint64(29))) * _MIX[0] + two[8 : 8 + n]
    return key ^ (key >> np.uint64(32))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Grams:
    """q-grams of the items with one q, sorted by key, with a bitmap in front."""

    q: int
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, q: int, items: list[int], texts: list[str]) -> Grams:
        keys = [gram_keys(points(texts[i]), q) for i in items]
        key = np.concatenate(keys)
        item = np.repeat(np.array(items, np.int64), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k), dtype=np.int64) for k in keys])
        order = np.argsort(key, kind="stable")
        bitmap = np.zeros(1 << 22, bool)
        bitmap[(key & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        return cls(q, key[order], item[order], place[order], bitmap)

    def hits(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, diagonal) of every shared gram, in steps of about STEP_HITS: a gram that is
        frequent in a text and in an item makes as many as the product of both."""
        key = gram_keys(text, self.q)
        at = np.flatnonzero(self.bitmap[(key & np.uint64((1 << 22) - 1)).astype(np.int64)])
        low, high = np.searchsorted(self.keys, key[at], "left"), np.searchsorted(self.keys, key[at], "right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        ends, begin = np.cumsum(n), 0
        while begin < len(n):
            last = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP_HITS, "right")))
            m, first = n[begin:last], low[begin:last]
            hit = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            yield self.item[hit], np.repeat(at[begin:last], m) - self.place[hit]
            begin = last


class _Counts:
    """Occurrences of codes, summed as they come."""

    def __init__(self):
        self.code, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, code: np.ndarray) -> None:
        code, n = np.unique(code, return_counts=True)
        if not len(self.code):
            self.code, self.n = code, n
        elif len(code):
            self.code, at = np.unique(np.concatenate([self.code, code]), return_inverse=True)
            self.n = np.bincount(at, np.concatenate([self.n, n]), len(self.code)).astype(np.int64)


@dataclass
class Index:
    """A block of benchmark items and their q-grams, by q."""

    ids: list
    texts: list[str]
    grams: list[Grams]
    budget: np.ndarray
    need: np.ndarray
    share: float
    longest: int

    @classmethod
    def of(cls, rows: list[tuple[object, str]], share: float) -> Index:
        rows = [(i, t) for i, t in ((i, normal(t or "")) for i, t in rows) if t]
        texts = [t for _, t in rows]
        length = np.array([len(t) for t in texts], np.int64)
        budget = np.floor(length * share).astype(np.int64)
        q = np.minimum(Q, length // (budget + 1))  # so that need is 1 at least
        grams = [Grams.of(int(k), np.flatnonzero(q == k).tolist(), texts) for k in np.unique(q)]
        return cls([i for i, _ in rows], texts, grams, budget, length + 1 - q - q * budget, share, max(map(len, texts), default=0))

    def regions(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, first, last diagonal) of bands that hold enough shared q-grams."""
        code = points(text)
        for grams in self.grams:
            yield from self._regions(grams.hits(code), len(text))

    def _regions(self, hits: Iterator[tuple[np.ndarray, np.ndarray]], length: int) -> Iterator[tuple[int, int, int]]:
        zero = np.int64(self.longest + 2)  # diagonals, and numbers of bands, are no less than minus this
        span = np.int64(length + 2 * self.longest + 8)
        exact, banded_ = _Counts(), _Counts()
        for item, diagonal in hits:
            plain = self.budget[item] == 0
            exact.add(item[plain] * span + diagonal[plain] + zero)
            item, diagonal = item[~plain], diagonal[~plain]
            band = np.floor_divide(diagonal, self.budget[item] + 1)
            # bands are two widths wide and overlap by one: a diagonal lies in two of them, and any
            # `budget` + 1 adjacent diagonals lie together in one
            banded_.add(np.concatenate([item * span + band + zero, item * span + band + zero - 1]))
        # without edits a diagonal is the only place of a match
        i, d = exact.code // span, exact.code % span - zero
        enough = (exact.n >= self.need[i]) & (d >= 0)
        yield from ((i, d, d) for i, d in zip(i[enough].tolist(), d[enough].tolist()))
        item, band, count = banded_.code // span, banded_.code % span - zero, banded_.n
        enough = count >= self.need[item]
        # a place lies in two neighbouring bands, which are aligned as one; two matches
        # apart are a length apart, so never in the same
        last = None
        for i, b in zip(item[enough].tolist(), band[enough].tolist()):
            if last and last[0] == i and b - last[2] <= 1 and b - last[1] < 2:
                last = (i, last[1], b)
                continue
            if last:
                yield self._band(*last)
            last = (i, b, b)
        if last:
            yield self._band(*last)

    def _band(self, i: int, first: int, last: int) -> tuple[int, int, int]:
        width = int(self.budget[i]) + 1
        return i, (first - 1) * width, (last + 3) * width

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Verified matches (item, start, end, edits). Of an item's matches that overlap the one
        with the fewest edits is kept, of equal ones the first; matches apart are all kept."""
        text = normal(text)
        code, found = points(text), set()
        for i, low, high in self.regions(text):
            item = self.texts[i]
            exact = text.find(item, max(0, low), max(0, high) + len(item))
            if exact >= 0:
                found.add((i, 0, exact, exact + len(item)))
            elif match := banded(points(item), code, low, high, int(self.budget[i])):
                found.add((i, *match))
        out, taken = [], {}
        for i, edits, start, end in sorted(found):
            mine = taken.setdefault(i, [])
            at = bisect.bisect(mine, (start, end))
            if not (at and mine[at - 1][1] > start or at < len(mine) and mine[at][0] < end):
                mine.insert(at, (start, end))
                out.append((i, start, end, edits))
        return sorted(out, key=lambda m: (m[1], m[0]))


#: Edits tried first; more are allowed step by step, so that a near copy costs little.
FIRST_EDITS, MORE_EDITS = 64, 8
#: Rows after which dead diagonals are dropped.
TRIM = 16
_BIG = np.int64(1 << 36)  # a cost and a start are one number: costs below 2^26, texts below 2^36


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the whole pattern's best match in a text on the diagonals from low
    to high, None beyond `budget` edits. Of equal ones the latest start, then the first end.

    Row by row only diagonals of the band are kept, shifted by one place a row, and those at
    the band's rims that have used up the edits tried are dropped.
    """
    tried = min(budget, FIRST_EDITS)
    while True:
        if (match := _within(pattern, text, low, high, tried)) or tried >= budget:
            return match
        tried = min(budget, tried * MORE_EDITS)


def _within(pattern: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """banded() for a number of edits. A cell is cost * _BIG + (_BIG - 1 - start), so that the
    least is the cheapest and then the latest."""
    n, m = len(text), len(pattern)
    first, high = max(low, -edits), min(high, n)
    if first > high:
        return None
    dead = np.int64(edits + 1) * _BIG
    diagonal = np.arange(first, high + 1, dtype=np.int64)
    cell = np.where(diagonal >= 0, _BIG - 1 - diagonal, dead)  # a match may begin anywhere in the text
    step = np.arange(len(cell), dtype=np.int64) * _BIG
    for row in range(1, m + 1):
        # characters of the text on this row's diagonals; beyond its ends nothing matches
        a, z = row - 1 + first, row - 1 + first + len(cell)
        seen = text[max(a, 0) : max(0, min(z, n))]
        cost = np.full(len(cell), _BIG, np.int64)
        cost[max(0, -a) : max(0, -a) + len(seen)][seen == pattern[row - 1]] = 0
        new = cell + cost
        new[:-1] = np.minimum(new[:-1], cell[1:] + _BIG)
        if z > n:
            new[max(0, n + 1 - row - first) :] = dead  # these end behind the text
        if a < -1:
            new[: -1 - a] = dead  # and these before it
        cell = np.minimum.accumulate(new - step[: len(new)]) + step[: len(new)]
        if row % TRIM == 0:
            alive = np.flatnonzero(cell < dead)
            if not len(alive):
                return None
            # the next rows reach so many places to the left of what lives, and none to its right
            begin = max(0, int(alive[0]) - TRIM)
            cell, first = np.minimum(cell[begin : alive[-1] + 1], dead), first + begin
    at = int(cell.argmin())
    least = int(cell[at])
    if least >= int(dead):
        return None
    return least // int(_BIG), int(_BIG) - 1 - least % int(_BIG), m + first + at


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """One row per benchmark passage found in a document: id, item, start, end, edits.

    Positions are code points of the text in lower case with single spaces. An item matches
    where at most share * length edits turn it into a part of the document. Null or empty
    texts hold nothing; null or empty items are never matched, and short ones are matched
    like all others (without edits below 1 / share characters); two items with equal text
    are both reported. Repeated document rows repeat their rows, null ids stay null, other
    columns are ignored, and texts of any length are searched whole. The benchmark is the stated query set: it goes to the tasks in blocks of BLOCK_CHARS, each
    block against every document; no documents are gathered anywhere.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType()),
    ])
    base, out = fresh(docs, id_col, text_col), None
    for rows in _blocks(benchmark, item_col, item_text):
        found = _search(spark, base, rows, schema, share)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of about BLOCK_CHARS, one at a time."""
    items = benchmark.select(F.col(item_col).alias("_item"), F.coalesce(F.col(item_text), F.lit("")).alias("_text"))
    size = items.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_CHARS))
    for block in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block).orderBy("_item", "_text").collect()]


def _search(spark: SparkSession, base: DataFrame, rows: list[tuple], schema: T.StructType, share: float) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    sent = spark.sparkContext.broadcast(Index.of(rows, share))
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        import pyarrow as pa

        index = sent.value
        for batch in batches:
            for part, texts in chunks(batch, "_text"):
                got = [(doc, index.ids[i], a, z, e) for doc, text in zip(part.column("_id").to_pylist(), texts) for i, a, z, e in index.find(text)]
                columns = list(zip(*got)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=schema.names)

    return base.mapInArrow(run, schema)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark passage (see find_leaks).

    One filter for each block of the benchmark; no shuffle.
    """
    for rows in _blocks(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(Index.of(rows, share))
        docs = filter_texts(docs, lambda texts, sent=sent: [not sent.value.find(t) for t in texts], text_col)
    return docs
