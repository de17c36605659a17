"""Language-model scores by context-tree weighting.

A byte is eight binary decisions. Each decision has a context tree over the bytes before it;
a node mixes its own Krichevsky-Trofimov estimate with the product of its children's, with
weights from the training counts, over all depths 0 to DEPTH. Counts of byte sequences of
DEPTH + 1 determine every node, so the model is one number per such sequence.

Nothing that grows with the corpus is broadcast: documents are dealt into blocks, a block
gives its distinct words and byte sequences once, these are joined with the model, and the
block's documents are scored with what comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, fresh

DEPTH = 5
#: Characters of a block, at most about; its documents and its part of the model meet in one task.
BLOCK_CHARS = 48_000_000
#: Characters that are counted or scored in one numpy step, about.
STEP_CHARS = 800_000
#: Distinct sequences whose probabilities one group works out, about; those of three context bytes stay together.
GROUP = 100_000
END_KEY = 0  # the end token's; words have their hashes
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_PAD = bytes(DEPTH)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def _packed(dealt: DataFrame) -> DataFrame:
    """(block, payload): documents in compressed groups of about STEP_CHARS, some of which
    make a block. A block never spans input partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, filled = TaskContext.get().partitionId() << 24, 0
        waiting: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in waiting:
                    out.write_batch(b)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

        size = 0
        for batch in batches:
            for part, texts in chunks(batch, "_text", STEP_CHARS):
                size += sum(map(len, texts))
                waiting.append(part)
                if size >= STEP_CHARS // 2:
                    yield close()
                    filled += size
                    size = 0
                    if filled >= BLOCK_CHARS:
                        block, filled = block + 1, 0
        if waiting:
            yield close()

    return dealt.mapInArrow(run, "block long, payload binary")


def _groups(payloads) -> Iterator[tuple[list, np.ndarray, list[bytes]]]:
    """(ids, held, lower-cased bytes) of each group of documents."""
    for payload in payloads:
        with pa.ipc.open_stream(payload) as stream:
            for batch in stream:
                raw = [t.encode("utf-8", "surrogatepass").lower() for t in batch.column("_text").to_pylist()]
                yield batch.column("_id"), np.array(batch.column("_held").to_pylist(), bool), raw


def sequences(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The byte sequences that end at each byte and at the end mark (zero) of every text, and
    where each text begins in them. DEPTH zero bytes stand before a text."""
    size = np.array([len(r) + 1 for r in raw], np.int64)
    start = np.cumsum(size) - size
    if not len(raw):
        return np.zeros(0, np.uint64), start
    flat = np.frombuffer(b"".join(_PAD + r + b"\0" for r in raw), np.uint8).astype(np.uint64)
    two = flat[:-1] << np.uint64(8) | flat[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    code = four[:-2] << np.uint64(16) | two[4:]
    # of DEPTH + 1 = 6 bytes each; those that begin in a text's last DEPTH bytes run into the next one
    keep = np.ones(len(flat), bool)
    ends = np.cumsum(size + DEPTH)
    for k in range(1, DEPTH + 1):
        keep[ends - k] = False
    return code[keep[: len(code)]], start


def tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, and the text that each is of.

    A word's hash is its bytes weighted by powers of an odd number, mixed with its length.
    """
    size = np.array([len(r) + 1 for r in raw], np.int64)
    flat = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    inside = ~_BLANK[flat]
    first = np.flatnonzero(inside & np.append(True, ~inside[:-1])) if len(flat) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.int64), first
    length = np.add.reduceat(inside, first, dtype=np.int64)
    begin = np.zeros(len(flat), np.int64)
    begin[first] = np.diff(first, prepend=0)
    offset = np.arange(len(flat)) - np.cumsum(begin)
    power = np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = np.zeros(len(flat), np.uint64)
    value[inside] = (flat[inside] + np.uint64(1)) * power[offset[inside]]
    h = np.add.reduceat(value, first) ^ (length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64), np.searchsorted(np.cumsum(size), first, "right")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key of sorted parts."""
    key, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


class _Sums:
    """Counts by key; merged whenever many parts have come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, trained: np.ndarray) -> None:
        """key: every occurrence; trained: whether it is of a training document."""
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.put(key[first], np.add.reduceat(trained[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64))

    def put(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key, n))
        if len(self.parts) > 1 and sum(len(p[0]) for p in self.parts) > max(1_000_000, 2 * len(self.parts[0][0])):
            self.parts = [_merged(self.parts)]


def count_block(payloads) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, keys, counts) of a block's distinct tokens (kind 0) and byte sequences (kind 1):
    all that occur, with how often training documents have them."""
    words, grams = _Sums(), _Sums()
    for _, held, raw in _groups(payloads):
        key, of = tokens(raw)
        words.add(key, ~held[of])
        words.put(np.array([END_KEY]), np.array([int((~held).sum())]))
        code, start = sequences(raw)
        size = np.diff(np.append(start, len(code)))
        code = np.sort((code << np.uint64(1)) | np.repeat(~held, size).astype(np.uint64))
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        n = np.diff(np.append(first, len(code))) * (code[first] & np.uint64(1)).astype(np.int64)
        grams.put((code[first] >> np.uint64(1)).view(np.int64), n)
    yield 0, *_merged(words.parts)
    yield 1, *_merged(grams.parts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the blocks that a task reads, one block after another."""
    names = ["block", "kind", "key", "n"]

    def out(block: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        for kind, key, n in count_block(payloads):
            columns = [pa.array(np.full(len(key), block)), pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    now, waiting = None, []
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
            if block != now and waiting:
                yield from out(now, waiting)
                waiting = []
            now = block
            waiting.append(payload)
    if waiting:
        yield from out(now, waiting)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series after a shift by eight."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zero + 0.5) + log_gamma(one + 0.5) - log_gamma(zero + one + 1) - np.log(np.pi)


def _bits(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[row, decision] -> the tree node of the bits before it (1 to 255), and its bit."""
    place = np.arange(8)
    node = (256 | symbol[:, None]) >> (8 - place)
    return node, (symbol[:, None] >> (7 - place)) & 1


def _level(context: np.ndarray, node: np.ndarray, bit: np.ndarray, n: np.ndarray):
    """Counts of the nodes at one depth: unique (context, node) keys, the rows' places, zeros, ones."""
    key, at = np.unique(context[:, None] * 256 + node, return_inverse=True)
    at = at.reshape(node.shape)
    one = np.bincount(at.ravel(), (bit * n[:, None]).ravel(), len(key))
    zero = np.bincount(at.ravel(), ((1 - bit) * n[:, None]).ravel(), len(key))
    return key, at, zero, one


def lower_depths(rows: pd.DataFrame) -> pd.DataFrame:
    """Mixes depths DEPTH to 3 for sequences whose three-byte contexts are all in `rows`.

    Per sequence (kind 1) the probabilities of its eight bits, -1 where training has not seen
    the node; per depth-3 node (kind 0) its counts and the log of its weighted probability.
    """
    key, n = rows["key"].to_numpy(np.int64), rows["n"].to_numpy(float)
    symbol, context = key & 255, key >> 8
    node, bit = _bits(symbol)
    below, chance = None, None
    for depth in range(DEPTH, 2, -1):
        keys, at, zero, one = _level(context & ((1 << (8 * depth)) - 1), node, bit, n)
        own = log_kt(zero, one)
        seen = (zero + one > 0)[at]
        kt = np.where(bit == 1, one[at] + 0.5, zero[at] + 0.5) / (zero + one + 1)[at]
        if below is None:
            weighted, mixed = own, kt
        else:
            # a child's place among this depth's nodes, once per child
            child = np.zeros(len(keys))
            first = np.unique(below[1], return_index=True)[1]
            np.add.at(child, at.ravel()[first], below[0])
            total = np.logaddexp(own, child)
            weighted = total - np.log(2)
            share = np.exp(own - total)[at]
            mixed = np.where(below[2], share * kt + (1 - share) * chance, kt)
        below, chance = (weighted, at, seen), mixed
    out = np.where(seen, mixed, -1.0).astype("<f4")
    grams = pd.DataFrame({"kind": 1, "key": key, "p": [r.tobytes() for r in out], "zero": 0.0, "one": 0.0, "weighted": 0.0})
    nodes = pd.DataFrame({"kind": 0, "key": keys, "p": None, "zero": zero, "one": one, "weighted": weighted})
    return pd.concat([grams, nodes[(nodes["zero"] + nodes["one"]) > 0]])


def top_depths(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """Depths 2 to 0 from depth-2 nodes: key (two context bytes * 256 + node), zero, one, child
    (sum of the children's logs). At most 65,536 contexts; those seen have a row each in the
    tables of estimates and weights."""
    key = rows["key"].to_numpy(np.int64)
    zero, one, child = (rows[c].to_numpy(float) for c in ("zero", "one", "child"))
    contexts, at = np.unique(key >> 8, return_inverse=True)
    row = np.full(1 << 16, -1, np.int32)
    row[contexts] = np.arange(len(contexts))
    own = log_kt(zero, one)
    total = np.logaddexp(own, child)
    p2, w2, seen2 = (np.zeros((len(contexts) + 1, 256), t) for t in (np.float32, np.float32, bool))
    place = at, key & 255
    p2[place], w2[place], seen2[place] = (one + 0.5) / (zero + one + 1), np.exp(own - total), True
    sums = np.zeros((3, 256, 256))
    for table, value in zip(sums, (zero, one, total - np.log(2))):
        np.add.at(table, (key >> 8 & 255, key & 255), value)
    zero, one, child = sums
    own = log_kt(zero, one)
    total = np.logaddexp(own, child)
    zero0, one0 = zero.sum(0), one.sum(0)
    own0 = log_kt(zero0, one0)
    share0 = np.exp(own0 - np.logaddexp(own0, (total - np.log(2)).sum(0)))
    return {
        "row": row, "p2": p2, "w2": w2, "seen2": seen2, "p1": (one + 0.5) / (zero + one + 1), "w1": np.exp(own - total), "seen1": zero + one > 0,
        "p0": (one0 + 0.5) / (zero0 + one0 + 1), "w0": share0,
    }


def finish(key: np.ndarray, lower: np.ndarray, top: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence's last byte after the bytes before it."""
    node, bit = _bits(key & 255)

    def estimate(one: np.ndarray) -> np.ndarray:
        return np.where(bit == 1, one, 1 - one)

    place = top["row"][key >> 8 & 65535][:, None], node  # -1, the last row, if not seen
    kt, w = estimate(top["p2"][place]), top["w2"][place]
    p = np.where(lower < 0, kt, w * kt + (1 - w) * lower)
    known = top["seen2"][place]
    place = (key >> 8 & 255)[:, None], node
    kt, w = estimate(top["p1"][place]), top["w1"][place]
    p = np.where(known, w * kt + (1 - w) * p, kt)
    kt, w = estimate(top["p0"][node]), top["w0"][node]
    p = np.where(top["seen1"][place], w * kt + (1 - w) * p, kt)
    return np.log10(p).sum(1)


class _Lookup:
    """Values by key: a direct table for most keys, binary search for those that it misses."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        self.shift = np.uint64(64 - min(23, max(12, len(key).bit_length() + 1)))
        self.slot = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slot[self._hash(self.key)] = np.arange(len(key), dtype=np.int32)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self.slot[self._hash(key)]
        miss = np.flatnonzero(self.key[at] != key)
        at[miss] = np.searchsorted(self.key, key[miss])
        return self.value[at]


def score_block(payloads, kind: np.ndarray, key: np.ndarray, value: np.ndarray, total: int, distinct: int) -> Iterator[pa.Table]:
    """Scores a block's documents with the block's own part of the model."""
    word, gram = (_Lookup(key[kind == k], value[kind == k]) for k in (0, 1))
    chance = lambda c: np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    end = word(np.array([END_KEY]))
    for doc, held, raw in _groups(payloads):
        keys, of = tokens(raw)
        c = word(keys)
        n = len(raw)
        counts = np.bincount(of, minlength=n).astype(np.int64) + 1
        known = np.bincount(of[c > 0], minlength=n).astype(np.int64) + int(end[0] > 0)
        base = np.bincount(of, chance(c), n) + chance(end)[0]
        code, start = sequences(raw)
        score = np.add.reduceat(gram(code.view(np.int64)), start)
        sizes = np.array([len(r) for r in raw], np.int64)
        yield pa.table([doc, *map(pa.array, (held, counts, known, base, score, sizes))], names=["_id", "_held", "n_tokens", "n_known", "base_score", "score", "n_bytes"])


def score_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Both models learn from every document with crc32(id as text) mod 5 != 1, whole texts,
    A-Z lower-cased. score is the log10 probability of the text's bytes and an end mark;
    bits_per_byte is its code length over its bytes and the end mark. A null text is empty:
    one end token. Null ids are trained on. Repeated rows count as often as they occur. Words
    are known by 64-bit hashes. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(spark, "ctw")
    base = fresh(docs, id_col, text_col)
    packed = scratch.keep(_packed(base.select("_id", "_text", held_out(F.col("_id")).alias("_held"))), "packed")
    parts = scratch.keep(packed.mapInArrow(_counted, "block long, kind int, key long, n long"), "parts")
    counts = scratch.keep(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.count("*").alias("rows")).collect()}
    total, distinct = (int(sums[0]["n"]), int(sums[0]["v"])) if 0 in sums else (0, 0)
    groups = max(1, -(-int(sums[1]["rows"] if 1 in sums else 0) // GROUP))
    grams = counts.where("kind = 1").withColumn("_g", F.pmod(F.xxhash64(F.expr("shiftright(key, 8) & 16777215")), F.lit(groups)))
    mixed = scratch.keep(
        grams.groupBy("_g").applyInPandas(lambda rows: lower_depths(rows), "kind int, key long, p binary, zero double, one double, weighted double"), "mixed"
    )
    # at most 65,536 contexts of two bytes with 255 nodes each, through Arrow
    top = top_depths(
        mixed.where("kind = 0").groupBy(F.expr("(shiftright(key, 8) & 65535) * 256 + (key & 255)").alias("key"))
        .agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("weighted").alias("child")).toArrow().to_pandas()
    )
    sent = spark.sparkContext.broadcast(top)

    def values(batches):
        for rows in batches:
            p = np.frombuffer(b"".join(rows["p"]), "<f4").reshape(-1, 8).astype(float)
            key = rows["key"].to_numpy(np.int64)
            yield pd.DataFrame({"kind": 1, "key": key, "value": finish(key, p, sent.value)})

    model = mixed.where("kind = 1").select("key", "p").mapInPandas(values, "kind int, key long, value double")
    model = scratch.keep(model.union(counts.where("kind = 0").select("kind", "key", F.col("n").cast("double"))), "model")
    scratch.drop("mixed")
    scratch.drop("counts")
    # a block that lay in two input splits was counted in two parts; a key's value is the same in both
    mine = parts.select("block", "kind", "key").join(model, ["kind", "key"]).select("block", "kind", "key", "value")
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, _held boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, key, value = (right.column(n).to_numpy() for n in ("kind", "key", "value"))
        return pa.concat_tables(score_block(left.column("payload").to_pylist(), kind, key, value, total, distinct))

    scored = packed.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(run, schema)
    return scored.select(
        F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score", (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
