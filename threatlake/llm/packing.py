"""Packing by harmonic classes.

What is left of a document after its whole sequences is one piece of length l; it belongs
to class k where C/(k+1) < l <= C/k. A bin of class k takes exactly k such pieces. The room
that then remains in it is filled from the next document before that one is classed, so a
bin costs one cut and no padding. Every partition fills its own bins; nothing is shuffled.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BATCH_BYTES, fresh, release, slices, small_batches

CAPACITY = 2048
END = 1
#: Words whose tokens a Python worker remembers, at most about; beyond it starts anew.
REMEMBERED = 500_000
#: Words whose tokens are put together in one numpy step.
STEP_WORDS = 50_000
#: Characters that are single tokens of common vocabularies; one of them stands between unseen words.
_MARKS = "\U0001f602\u2764\u2122\u20ac"
_JOINED = 2_000


class Tokens:
    """Ids of whole texts. Words between white space are tokenized once and remembered, as
    Arrow strings and flat arrays.

    This equals encoding the whole text, as this vocabulary drops white space and never
    merges across it. A text with `<|` (part of the special tokens' strings) is encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        single = [(m, ids[0]) for m in _MARKS if len(ids := self._encode([m])[0]) == 1]
        self.mark, self.mark_id = single[0] if single else (None, -1)
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat = np.array([END], np.uint32)  # the end of a text, then the words' ids, one word after another
        self.start = np.array([0, 1], np.int64)  # a word's number is its place among the words plus one

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, unseen: pa.StringArray) -> None:
        """Tokenizes unseen words, many at a time with the mark between them."""
        flat, size = [self.flat], [self.start[1:] - self.start[:-1]]
        for begin in range(0, len(unseen), _JOINED):
            some = unseen.slice(begin, _JOINED).to_pylist()
            if self.mark and not any(self.mark in w for w in some):
                ids = np.array(self._encode([f" {self.mark} ".join(some)])[0], np.uint32)
                marks = np.flatnonzero(ids == self.mark_id)
                flat.append(np.delete(ids, marks))
                size.append(np.diff(marks, prepend=-1, append=len(ids)) - 1)
            else:
                each = self._encode(some)
                flat.append(np.fromiter(chain.from_iterable(each), np.uint32))
                size.append(np.fromiter(map(len, each), np.int64, len(each)))
        self.flat = np.concatenate(flat)
        self.start = np.append(0, np.cumsum(np.concatenate(size)))
        self.words = pa.concat_arrays([self.words, unseen])

    def ids(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """Per text its ids and END. The distinct words of a call are looked up once."""
        if not len(texts):
            return
        if len(self.words) > REMEMBERED:
            self.forget()
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = lists.flatten().dictionary_encode()
        known = len(self.words)
        place = pc.index_in(words.dictionary, value_set=self.words)
        unseen = words.dictionary.filter(pc.is_null(place))
        if len(unseen):
            self._learn(unseen)
        number = place.fill_null(-1).to_numpy() + np.int32(1)
        number[number == 0] = np.arange(known + 1, known + 1 + len(unseen), dtype=np.int32)
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        words = np.insert(number[words.indices.to_numpy()], ends, np.int32(0))  # every text's words, then word 0
        ends = ends + np.arange(1, len(ends) + 1)
        whole = pc.match_substring(texts, "<|").to_pylist()
        begin = doc = 0
        while doc < len(ends):
            last = max(doc + 1, int(np.searchsorted(ends, begin + STEP_WORDS, "right")))
            some = words[begin : ends[last - 1]]
            size = self.start[some + 1] - self.start[some]
            end = np.cumsum(size)
            flat = self.flat[np.repeat(self.start[some] - (end - size), size) + np.arange(int(end[-1]))]
            for i, one in enumerate(np.split(flat, end[ends[doc : last - 1] - begin - 1]), doc):
                yield np.array(self._encode([texts[i].as_py()])[0] + [END], np.uint32) if whole[i] else one
            begin, doc = int(ends[last - 1]), last


_loaded: dict[str, Tokens] = {}


class Bins:
    """Open bins of one partition. A document is (id, its ids as bytes); emitted pieces are
    rows [id, start, length, crc32, tokens of the document, sequence, offset]."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity = first, capacity
        self.open: dict[int, list[tuple]] = {}
        self.short: list[list] = []  # [room, pieces] of bins with all k pieces and room left

    def put(self, doc: object, raw: bytes) -> Iterator[list]:
        """Places a document; gives the rows of the sequences that it completes."""
        at, total = 0, len(raw) // 4
        while self.short and at < total:
            filling = self.short[-1]
            take = min(filling[0], total - at)
            filling[1].append(self._piece(doc, raw, at, take))
            filling[0] -= take
            at += take
            if not filling[0]:
                yield from self._rows(self.short.pop()[1])
        while total - at >= self.capacity:
            yield from self._rows([self._piece(doc, raw, at, self.capacity)])
            at += self.capacity
        if at < total:
            k = self.capacity // (total - at)
            pieces = self.open.setdefault(k, [])
            pieces.append(self._piece(doc, raw, at, total - at))  # the tail's ids only, not the document's
            if len(pieces) == k:
                room = self.capacity - sum(len(p[2]) // 4 for p in self.open.pop(k))
                if room:
                    self.short.append([room, pieces])
                else:
                    yield from self._rows(pieces)

    @staticmethod
    def _piece(doc: object, raw: bytes, start: int, length: int) -> tuple:
        """(id, start, ids of the piece as bytes, tokens of the document)."""
        return doc, start, raw[4 * start : 4 * (start + length)], len(raw) // 4

    def _rows(self, pieces: list[tuple]) -> Iterator[list]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield [doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset]
            offset += len(ids) // 4
        self.next += 1

    def rest(self) -> Iterator[list]:
        """What is left, one piece after another; cut where a sequence ends, so only the last one is padded."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        room, now = self.short.pop() if self.short else (self.capacity, [])
        self.open = {}
        for doc, start, ids, total in pieces:
            while ids:
                take = min(room, len(ids) // 4)
                now.append((doc, start, ids[: 4 * take], total))
                start, ids, room = start + take, ids[4 * take :], room - take
                if not room:
                    yield from self._rows(now)
                    room, now = self.capacity, []
        if now:
            yield from self._rows(now)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    tokenizer: the vocabulary file, present on every executor. A null or empty text is the end
    id alone. Every id lies in exactly one piece; a text of any length is cut at whole
    sequences. All sequences of a partition but its last have capacity ids, so padding is
    less than one sequence a partition. sequence_id is unique over all partitions (the
    partition's number, then a count). Repeated rows are packed as often as they occur; null
    ids are kept; other columns, whatever their names, are ignored; an empty table gives no
    rows. A partition keeps one open bin per class, fewer than k pieces of at most capacity / k ids,
    and the full bins of k pieces that wait for a cut, which the next document fills first.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
    ])

    def batch(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(columns[0], type=kind), *(pa.array(c, type=pa.int64()) for c in columns[1:])], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer not in _loaded:
            _loaded[tokenizer] = Tokens(tokenizer)
        tokens, bins, kind = _loaded[tokenizer], Bins(TaskContext.get().partitionId() << 36, capacity), None
        for whole in batches:
            kind = whole.schema.field("_id").type
            for part in slices(whole, "_text", BATCH_BYTES):
                ids = tokens.ids(part.column("_text"))
                yield batch([row for doc, one in zip(part.column("_id").to_pylist(), ids) for row in bins.put(doc, one.tobytes())], kind)
        if kind is not None:
            yield batch(list(bins.rest()), kind)
        tokens.forget()
        release()

    small_batches(docs)
    return fresh(docs, id_col, text_col).mapInArrow(run, schema)
