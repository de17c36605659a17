"""MinHash near-duplicates with sequential Bayesian verification.

Banded signatures propose candidates. A candidate's signature is compared batch by batch
and dropped once the posterior probability that its similarity reaches the threshold is
below a chosen miss probability; survivors are verified on their full shingle sets.

Candidates are never all pairs of a bucket. First every member is paired with one hub, the
least member of its buckets; what links is contracted to components. For the nodes of buckets
that still hold several components, shingles take the place of buckets: two linked sets share
one of their rarest shingles, with enough of either set behind it. The most central node of a
shingle is the second hub, and every pair across components that this bound leaves is verified.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shared import components
from .common import Scratch, fresh, map_texts

WORDS = 5
THRESHOLD = 75  # per cent
ROWS, BANDS = 5, 40  # a pair of similarity 0.75 meets in some band with probability 1 - 2e-5
K = ROWS * BANDS
BATCH = 40  # signature values compared at a time
MISS = 1e-7
#: Document ids that are sent to every task at most (8 bytes each); beyond it, a shuffled join.
SENT_IDS = 2_000_000
#: Hubs a node tries in a round before the rest is paired across components.
HUBS = 3
_rng = np.random.default_rng(20_240_501)
_A = (_rng.integers(0, 1 << 31, K, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Per text its distinct shingles, as sorted 64-bit hashes."""
    import xxhash

    numbers: dict[bytes, int] = {}
    ids: list[int] = []
    counts = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        counts.append(len(words))
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
    word = known[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
    n = max(0, len(word) - WORDS + 1)
    window = np.full(n, WORDS, np.uint64)
    for k in range(WORDS):
        window = _mix(window ^ word[k : k + n]) + np.uint64(k)
    out, at = [], 0
    for size in counts:
        if size >= WORDS:
            got = np.sort(window[at : at + size - WORDS + 1])
            out.append(got[np.concatenate([[True], got[1:] != got[:-1]])])
        elif size:
            one = np.full(1, size, np.uint64)
            for k in range(size):
                one = _mix(one ^ word[at + k : at + k + 1]) + np.uint64(k)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def _node(s: np.ndarray) -> int:
    """The hash of a set of shingles, which stands for it."""
    weights = np.arange(1, len(s) + 1, dtype=np.uint64)
    return int(_mix(np.array([_mix(s * (weights | np.uint64(1)) + weights).sum()], np.uint64) + np.uint64(len(s))).view(np.int64)[0])


def _sets(texts: list[str]) -> dict[str, list]:
    sets = shingle_sets(texts)
    return {"s": [x.view(np.int64) for x in sets], "own": [_node(x) for x in sets]}


def _signatures(texts: list[str]) -> dict[str, list]:
    sets = shingle_sets(texts)
    some = [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in some], np.int64)
    starts = np.cumsum(sizes) - sizes
    low = np.empty((K, len(some)), np.uint32)
    if some:
        x = (_mix(np.concatenate(some)) >> np.uint64(32)).astype(np.uint32)
        for k in range(K):
            low[k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
    band = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(some), 1)
    for r in range(ROWS):
        band = _mix(band ^ low[r::ROWS].astype(np.uint64)) + np.uint64(r)
    small = ((low * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
    got: dict[str, list] = {n: [] for n in ("n", "node", "bands", "sig")}
    j = 0
    for s in sets:
        got["n"].append(len(s))
        if not len(s):
            got["node"].append(None), got["bands"].append(None), got["sig"].append(None)
            continue
        got["node"].append(_node(s))  # documents with equal sets are one node
        got["bands"].append(band[:, j].view(np.int64))
        got["sig"].append(small[:, j].tobytes())
        j += 1
    return got


def prune_table(threshold: float = THRESHOLD / 100, miss: float = MISS) -> np.ndarray:
    """[batches compared] -> least number of equal values with which a candidate goes on.

    Uniform prior over the similarity; an unequal minimum still agrees in its 8 stored bits
    once in 256.
    """
    s = np.linspace(0.0005, 0.9995, 1000)
    p = s + (1 - s) / 256
    least = []
    for seen in range(BATCH, K + 1, BATCH):
        m = np.arange(seen + 1)[:, None]
        like = m * np.log(p) + (seen - m) * np.log1p(-p)
        like = np.exp(like - like.max(1, keepdims=True))
        post = like[:, s >= threshold].sum(1) / like.sum(1)
        least.append(int(np.flatnonzero(post >= miss)[0]))
    return np.array(least)


def _survive(pairs: DataFrame) -> DataFrame:
    """(a, b) of the candidates that the sequential comparison of signatures does not drop."""
    least = prune_table()

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint8).reshape(-1, K)
            y = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint8).reshape(-1, K)
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            live = np.flatnonzero(100 * np.minimum(na, nb) >= THRESHOLD * np.maximum(na, nb))
            equal = np.zeros(len(live), np.int64)
            for t, need in enumerate(least):
                cut = slice(t * BATCH, (t + 1) * BATCH)
                equal += (x[live, cut] == y[live, cut]).sum(1)
                go = equal >= need
                live, equal = live[go], equal[go]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(live)), batch.column("b").take(pa.array(live))], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


@dataclass
class _Verifier:
    """Checks candidates on full shingle sets."""

    docs: DataFrame  # _id, _text
    nodes: DataFrame  # node, low, n, sig
    scratch: Scratch

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """pairs: a, b (b < a). Returns those with 100 * intersection >= THRESHOLD * union."""
        left = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"), F.col("low").alias("la"))
        right = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"), F.col("low").alias("lb"))
        live = self.scratch.keep(_survive(pairs.join(left, "a").join(right, "b")), f"{name}-live")
        # every survivor's first text with the second's key, and every second text once
        want = live.join(left, "a").select(F.col("la").alias("_id"), "a", F.col("b").alias("key")).union(
            live.select("b").distinct().join(right, "b").select(F.col("lb").alias("_id"), F.lit(None).cast("long").alias("a"), F.col("b").alias("key"))
        )
        want = self.scratch.keep(want, f"{name}-want")
        near = F.broadcast(want) if want.count() <= SENT_IDS // 2 else want
        texts = self.docs.join(near, "_id")
        # an id may be used for several texts: only the one that gives the node is meant
        rows = map_texts(texts, _sets, "s array<long>, own long", carry=("a", "key")).where("own = coalesce(a, key)").drop("own")
        rows = self.scratch.keep(rows, f"{name}-sets")
        one = rows.where("a is not null").select("a", F.col("key").alias("b"), F.col("s").alias("x"))
        two = rows.where("a is null").select(F.col("key").alias("b"), F.col("s").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        good = one.join(two, "b").where(100 * both >= THRESHOLD * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()
        good = self.scratch.keep(good, f"{name}-links")
        for done in ("live", "want", "sets"):
            self.scratch.drop(f"{name}-{done}")
        return good

    def prefixes(self, open_: DataFrame) -> DataFrame:
        """(s, node, n, c) of the given nodes: the shingles that a linked pair has to share.

        A set's shingles are ordered by the number of these nodes that hold them, rarest first;
        c is what the set holds from s on. Two linked sets share a shingle, and of their first
        one both hold at least the needed intersection from there on. Shingles of a single node
        only count, and sets that share too little with all others are left out.
        """
        want = self.scratch.keep(open_.join(self.nodes, "node").select(F.col("low").alias("_id"), "node"), "open-ids")
        near = F.broadcast(want) if want.count() <= SENT_IDS else want
        texts = self.docs.join(near, "_id")
        sets = map_texts(texts, _sets, "s array<long>, own long", carry=("node",)).where("own = node")
        each = self.scratch.keep(sets.select("node", F.size("s").cast("long").alias("n"), F.explode("s").alias("s")), "open-sets")
        # written, as a join of two plain tables can be split at frequent shingles while it runs
        often = self.scratch.keep(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "open-often")
        own = W.partitionBy("node")
        ranked = each.join(often, "s").withColumns({"m": F.count("*").over(own), "r": F.row_number().over(own.orderBy("df", "s"))})
        return ranked.withColumn("c", F.col("m") - F.col("r") + 1).where(100 * F.col("c") >= THRESHOLD * F.col("n")).select("s", "node", "n", "c")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_shingles, component_id (least id reachable over links), kept.

    A link is a similarity of at least THRESHOLD per cent of two documents' sets of distinct
    5-word shingles. Documents with equal sets are one node (known by a 64-bit hash of the
    set). Empty texts, nulls among them, have no shingles and are linked with nothing; a text
    of fewer than five words is one shingle. Null ids take part in no group: their
    component_id is null and they are kept. Repeated rows with one id give equal rows; of an
    id that has several texts every row has the component of its own text. Of a component
    the least id is kept, so there are no ties. Texts of any length are compared whole.
    Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "neardup")
    base = fresh(docs, id_col, text_col)
    sigs = scratch.keep(map_texts(base, _signatures, "n long, node long, bands array<long>, sig binary"), "sigs")
    real = sigs.where("node is not null and _id is not null")
    bands = real.select("node", F.explode("bands").alias("band"))
    shared = scratch.keep(bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("band", "hub"), "shared")
    members = scratch.keep(bands.join(shared, "band").distinct(), "members")
    # what is needed of a node, for nodes that share a bucket
    each = real.groupBy("node").agg(F.min("_id").alias("low"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    nodes = scratch.keep(each.join(members.select("node").distinct(), "node", "left_semi"), "nodes")
    check = _Verifier(base.where("_id is not null"), nodes, scratch)
    first = members.where("node <> hub").groupBy("node").agg(F.min("hub").alias("b")).select(F.col("node").alias("a"), "b")
    links = check.links(first, "first")
    roots = components(links, scratch, "one")
    # the rest by the shingles that two linked sets must share
    members = _open(members.select("band", "node"), roots, "band", scratch, "band")
    shared = scratch.keep(check.prefixes(members.select("node").distinct()), "prefixes")
    scratch.drop("open-sets")
    scratch.drop("open-often")
    entries = _open(shared, roots, "s", scratch, "s-1")
    pairs = scratch.keep(_few(_untried(_to_central(entries, scratch), first)), "pairs-1")
    links = links.union(check.links(pairs, "second"))
    roots = components(links, scratch, "two")
    entries = _open(shared, roots, "s", scratch, "s-2")
    pairs = scratch.keep(_untried(_across(entries, scratch), first.union(pairs)), "pairs-2")
    links = links.union(check.links(pairs, "rest"))
    roots = components(links, scratch, "three")
    return _labelled(sigs, real, roots, scratch, id_col)


def _open(rows: DataFrame, roots: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """The rows (key, node, ...), with their root, whose key several components share."""
    placed = rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = scratch.keep(placed, f"{name}-placed")
    several = placed.groupBy(key).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select(key)
    several = scratch.keep(several, f"{name}-several")
    kept = scratch.keep(placed.join(several, key, "left_semi"), f"{name}-open")
    scratch.drop(f"{name}-placed")
    return kept


def _to_central(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node with its shingle's most central node (least of the set in front of the shingle,
    so the fewest rare shingles), if that is of another component and can be linked."""
    hub = entries.groupBy("s").agg(F.min_by(F.struct("node", "root", "n", "c"), F.struct(F.col("n") - F.col("c"), "node")).alias("hub"))
    hub = scratch.keep(hub, "hubs")
    met = entries.join(hub, "s").where((F.col("root") != F.col("hub.root")) & _can_link(F.col("n"), F.col("c"), F.col("hub.n"), F.col("hub.c")))
    return met.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    done = tried.select(F.least("a", "b").alias("ta"), F.greatest("a", "b").alias("tb"))
    return pairs.join(done, (F.least("a", "b") == F.col("ta")) & (F.greatest("a", "b") == F.col("tb")), "left_anti")


def _few(pairs: DataFrame) -> DataFrame:
    """At most HUBS hubs a node; what is left stays for the exact rest."""
    order = W.partitionBy("a").orderBy(F.xxhash64("b"), "b")
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= HUBS).select("a", "b")


def _can_link(na: Column, ca: Column, nb: Column, cb: Column) -> Column:
    """Whether sets of na and nb shingles, of which at most ca and cb are shared, can reach the
    threshold: a similarity of t needs an intersection of t / (1 + t) of the sizes' sum."""
    return (100 + THRESHOLD) * F.least(ca, cb) >= THRESHOLD * (na + nb)


def _across(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Every pair of different components that can be linked and shares a prefix shingle.

    A shingle's most frequent component is one side only, never paired with itself, and nodes
    too large for the smallest partner under a shingle leave it first.
    """
    least = scratch.keep(entries.groupBy("s").agg(F.min("n").alias("low")), "least")
    low = F.greatest(F.col("low"), F.ceil(F.col("n") * THRESHOLD / 100))
    some = entries.join(least, "s").where((100 + THRESHOLD) * F.col("c") >= THRESHOLD * (F.col("n") + low)).select("s", "node", "root", "n", "c")
    some = scratch.keep(some, "some")
    sizes = some.groupBy("s", "root").agg(F.count("*").alias("k"))
    major = sizes.groupBy("s").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("roots")).where("roots > 1")
    major = scratch.keep(major, "major")
    some = some.join(major.select("s", "major"), "s")
    one = some.where("root <> major").select("s", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("c").alias("ca"))
    two = some.select("s", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("major"))
    once = (F.col("rb") == F.col("major")) | (F.col("b") < F.col("a"))
    met = one.join(two, (one.s == two.s) & (F.col("ra") != F.col("rb")) & once & _can_link(F.col("na"), F.col("ca"), F.col("nb"), F.col("cb")))
    return met.select("a", "b").distinct()


def _labelled(sigs: DataFrame, real: DataFrame, roots: DataFrame, scratch: Scratch, id_col: str) -> DataFrame:
    lows = scratch.keep(real.groupBy("node").agg(F.min("_id").alias("low")), "lows")
    placed = lows.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    best = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = scratch.keep(placed.join(best, "root").select("node", "component_id"), "ids")
    out = sigs.select("_id", "n", "node").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("_id")).when(F.col("_id").isNotNull(), F.col("component_id"))
    return out.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, all columns; empty texts and nulls all stay.

    The row of the least id stays, then of the least text hash; null ids take part and come
    last. Rows equal in id and text are known by a 64-bit hash of both and become one row
    before any text is shuffled, the one with the least hash of its other columns. Texts of
    any length are compared whole; extra columns may have any name; an empty table gives no
    rows.
    """
    scratch = Scratch(spark, "gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    id_, text = F.col("row")[id_col], F.col("row")[text_col]
    key = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text"))
    found = near_duplicates(spark, rows.select(key.alias("_key"), text.alias("_text")), "_key", "_text").where("n_shingles > 0")
    marks = found.groupBy("_key").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1")
    marks = scratch.keep(marks.select(F.xxhash64("_key").alias("mark"), "kept"), "ids")
    again = marks.where("kept").select("mark")
    sent = lambda some: F.broadcast(some) if some.count() <= SENT_IDS else some
    keyed = rows.withColumn("mark", F.xxhash64(key))
    out = keyed.join(sent(marks.select("mark")), "mark", "left_anti").select("row.*")
    if again.isEmpty():
        return out
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in (id_col, text_col)]
    order = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    one = keyed.join(sent(again), "mark", "left_semi").groupBy("mark").agg(F.min_by("row", order).alias("row"))
    return out.union(one.select("row.*"))
