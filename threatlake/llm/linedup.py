"""Line dedup by a suffix array over line ids, DataFrame operations only.

Lines that occur once end every repeat, so the array is built over the others. Prefix
doubling ranks the suffixes by their first 1, 2, 4, ... lines, until no rank is shared: each
step sorts the pairs of ranks, and their sorted order numbers the next ones. Suffixes that
agree on m lines form an interval of the array whose least common prefix is at least m; the
pair of ranks of the 2^k-line prefixes at a run's start and 2^k lines before its end names
that interval. A run of a stated number of words is looked up in its interval, whose first
suffix in the text's order keeps it. With that suffix every left-maximal run's least common
prefix is found by descending through the ranks; it makes the run right-maximal. What these
maximal repeated runs cover is cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Words of a long repeated run: a passage rather than a line that happens to agree.
LONG_WORDS = 50
#: Bytes of the deleted stretches up to which they are broadcast; beyond, a shuffled join.
SENT_BYTES = 64 << 20
_KEY = ["_k"]  # a document: the hash of its id and text


def _ranked(rows: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The classes of `by` with two or more rows, ranked in their sorted order."""
    classes = rows.groupBy(*by).agg(F.count("*").alias("_c")).where("_c > 1").select(*by)
    return scratch.keep(classes.orderBy(*by).withColumn("new", F.monotonically_increasing_id()), name)


def _document(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, F.coalesce(text, F.lit("")))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_d"), _document(F.col(id_col), text).alias("_k"), F.posexplode(F.split(text, "\n")).alias("line", "_line"))
    return keyed.select("_d", "_k", "line", F.xxhash64("_line").alias("h"), F.xxhash64(F.lit("line"), "_line").alias("g"), F.regexp_count("_line", F.lit(WORD)).alias("words"))


def _shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(document, start, m): for each line the shortest run of min_words words that starts there,
    and the shortest that ends there, within unbroken stretches of repeated lines."""
    order = W.partitionBy(*_KEY).orderBy("line")
    lines = lines.withColumn("stretch", F.col("line") - F.row_number().over(order))
    inside = W.partitionBy(*_KEY, "stretch").orderBy("line")
    lines = lines.withColumn("upto", F.sum("words").over(inside)).withColumn("all", F.sum("words").over(W.partitionBy(*_KEY, "stretch")))
    lines = lines.where(F.col("all") >= min_words).withColumn("before", F.col("upto") - F.col("words"))
    # a run from i to j has upto[j] - before[i] words. In the order of word counts, the first j
    # with upto >= before[i] + min_words ends the shortest run from i, and the last i with
    # before <= upto[j] - min_words starts the shortest run to j
    keys = ["_d", *_KEY, "stretch"]
    ends = lines.select(*keys, F.col("upto").alias("at"), F.lit(1).alias("kind"), "line")
    asks = lines.select(*keys, (F.col("before") + min_words).alias("at"), F.lit(2).alias("kind"), "line")
    down = W.partitionBy(*_KEY, "stretch").orderBy(F.desc("at"), F.desc("kind"), F.desc("line")).rowsBetween(W.unboundedPreceding, 0)
    # equal word counts (empty lines): descending order meets the least line last
    forward = ends.union(asks).withColumn("other", F.last(F.when(F.col("kind") == 1, F.col("line")), True).over(down))
    forward = forward.where("kind = 2 and other is not null").select("_d", *_KEY, F.col("line").alias("start"), (F.col("other") - F.col("line") + 1).alias("m"))
    starts = lines.select(*keys, F.col("before").alias("at"), F.lit(1).alias("kind"), "line")
    asks = lines.select(*keys, (F.col("upto") - min_words).alias("at"), F.lit(2).alias("kind"), "line")
    up = W.partitionBy(*_KEY, "stretch").orderBy("at", "kind", "line").rowsBetween(W.unboundedPreceding, 0)
    backward = starts.union(asks).withColumn("other", F.last(F.when(F.col("kind") == 1, F.col("line")), True).over(up))
    backward = backward.where("kind = 2 and other is not null").select("_d", *_KEY, F.col("other").alias("start"), (F.col("line") - F.col("other") + 1).alias("m"))
    return forward.union(backward).distinct()


def later_copies(spark: SparkSession, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, least: tuple[int, ...]) -> DataFrame:
    """(_k, start, m, least): maximal runs of m lines with `least` words or more that repeat an
    earlier run, for each of `least`."""
    lines = _lines(docs, id_col, text_col)
    ranks = _ranked(lines, ["h", "g"], scratch, "rank-0")
    # repeated rows of one document are one document
    found = lines.join(ranks, ["h", "g"]).select("_d", "_k", "line", F.col("new").alias("rank"), "words")
    found = scratch.keep(found.repartition(*_KEY).dropDuplicates([*_KEY, "line"]), "lines")
    levels = _levels(found.select(*_KEY, "line", "rank"), scratch)
    runs = [_shortest_runs(found, n).withColumn("least", F.lit(n)) for n in least]
    runs = scratch.keep(reduce(DataFrame.union, runs).withColumn("k", F.floor(F.log2("m") + 1e-9).cast("int")), "runs")
    every = reduce(DataFrame.union, (level.withColumn("k", F.lit(k)) for k, level in enumerate(levels)))
    head = every.select(*_KEY, F.col("line").alias("start"), "k", F.col("rank").alias("r"))
    tail = every.select(*_KEY, F.col("line").alias("last"), "k", F.col("rank").alias("s"))
    # a run of 2^k lines is named by its one rank, without a second look
    exact = F.col("m") == F.expr("cast(shiftleft(1, k) as int)")
    headed = scratch.keep(runs.join(head, [*_KEY, "start", "k"]), "headed")
    longer = headed.where(~exact).withColumn("last", F.col("start") + F.col("m") - F.expr("cast(shiftleft(1, k) as int)"))
    named = headed.where(exact).select("_d", *_KEY, "start", "m", "least", "r", F.col("r").alias("s"))
    named = named.unionByName(longer.join(tail, [*_KEY, "last", "k"]).select("_d", *_KEY, "start", "m", "least", "r", "s"))
    named = scratch.keep(named, "named")
    place = F.struct("_d", *_KEY, "start")
    first = named.groupBy("m", "r", "s").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    first = scratch.keep(first, "first")
    pairs = named.join(first, ["m", "r", "s"]).where(place != F.col("first"))
    pairs = scratch.keep(pairs.select(*_KEY, "start", "least", F.col("first._k").alias("_f"), F.col("first.start").alias("at")), "pairs")
    # left-maximal: one line before, it is not the same copy of the same run
    before = pairs.select(*_KEY, F.col("start") + 1, "least", "_f", F.col("at") + 1).toDF(*pairs.columns)
    return _prefixes(pairs.join(before, pairs.columns, "left_anti"), levels, scratch)


def _levels(level: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Ranks (document, line, rank) of the suffixes by their first 1, 2, 4, ... lines, up to the
    last length at which two suffixes share one."""
    levels = [level]
    while True:
        k = len(levels)
        later = level.select(*_KEY, (F.col("line") - (1 << (k - 1))).alias("line"), F.col("rank").alias("next"))
        pairs = scratch.keep(level.join(later, [*_KEY, "line"]), f"pairs-{k}")
        ranks = _ranked(pairs, ["rank", "next"], scratch, f"rank-{k}")
        if ranks.isEmpty():
            return levels
        level = scratch.keep(pairs.join(ranks, ["rank", "next"]).select(*_KEY, "line", F.col("new").alias("rank")), f"level-{k}")
        scratch.drop(f"pairs-{k}")
        levels.append(level)


#: Levels that one plan descends before its result is written.
DESCENT = 3


def _prefixes(pairs: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """pairs of suffixes (_k, start) and (_f, at) with m, the lines of their least common prefix:
    where the next 2^k lines have one rank, both go on by as many, from the longest down."""
    now = scratch.keep(pairs.withColumn("m", F.lit(0)), "left-maximal")
    for k in reversed(range(len(levels))):
        mine = levels[k].select(F.col("_k"), F.col("line").alias("_line"), F.col("rank").alias("_mine"))
        theirs = levels[k].select(F.col("_k").alias("_f"), F.col("line").alias("_other"), F.col("rank").alias("_theirs"))
        now = now.withColumns({"_line": F.col("start") + F.col("m"), "_other": F.col("at") + F.col("m")})
        now = now.join(mine, ["_k", "_line"], "left").join(theirs, ["_f", "_other"], "left")
        same = F.coalesce(F.col("_mine") == F.col("_theirs"), F.lit(False))
        now = now.withColumn("m", F.col("m") + F.when(same, 1 << k).otherwise(0)).drop("_line", "_other", "_mine", "_theirs")
        if k % DESCENT == 0 and k:
            now = scratch.keep(now, f"common-{k}")
    return now.select(*_KEY, "start", "m", "least")


def _stretches(runs: DataFrame, name: str) -> DataFrame:
    """Per document the merged deleted stretches, as an array of (from, to), to exclusive, their
    lines, and the lines of the longest run."""
    order = W.partitionBy(*_KEY).orderBy("start", "end")
    runs = runs.select(*_KEY, "start", (F.col("start") + F.col("m")).alias("end"))
    runs = runs.withColumn("reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    runs = runs.withColumn("part", F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(order))
    parts = runs.groupBy(*_KEY, "part").agg(F.min("start").alias("from"), F.max("end").alias("to"), F.max(F.col("end") - F.col("start")).alias("most"))
    return parts.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias(name), F.sum(F.col("to") - F.col("from")).alias(f"n_{name}"), F.max("most").alias(f"most_{name}"))


def dedup_lines(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1, count_col: str | None = None, long_col: str | None = None, run_col: str | None = None
) -> DataFrame:
    """The documents, all columns, with later copies of repeated line runs cut from the text.

    Lines are split at \\n. A run repeats where equal lines follow one another, inside one
    document too; of a run's copies the first by (id, hash of id and text, line) stays. With
    the default every repeated line goes that has a word, or lies in a repeated run that has
    one; a greater min_words leaves shorter runs. A null text stays null and an empty one
    empty; a text whose lines all go becomes empty, and its row stays. Ids of any orderable
    type; null ids sort first. Repeated rows (same id and text) are one document and get
    equal texts; no row is added or lost, an empty table gives no rows, and extra columns may
    have any name. count_col: adds the number of lines cut; long_col: adds how many lie in
    repeated runs of LONG_WORDS words or more; run_col: adds the lines of the longest run cut. A document's lines are windowed in one task,
    as its text is a row anyway.
    """
    scratch = Scratch(spark, "linedup")
    least = tuple(dict.fromkeys([min_words, *([LONG_WORDS] if long_col else [])]))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    row = F.col("_row")
    bare = rows.select(row[id_col].alias("_id"), row[text_col].alias("_text"))
    copies = scratch.keep(later_copies(spark, bare, scratch, "_id", "_text", least), "copies")
    gone = _stretches(copies.where(F.col("least") == min_words), "gone")
    if long_col:
        gone = gone.join(_stretches(copies.where(F.col("least") == LONG_WORDS), "long").drop("long", "most_long"), "_k", "full")
    gone = scratch.keep(gone, "gone")
    size = gone.agg(F.sum(40 + 8 * F.size(F.coalesce("gone", F.array())))).first()[0] or 0
    joined = rows.withColumn("_k", _document(row[id_col], row[text_col])).join(F.broadcast(gone) if size <= SENT_BYTES else gone, "_k", "left")
    # what stands between the deleted stretches, each a slice of the lines
    lines = F.split(row[text_col], "\n")
    edges = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["to"].cast("int")))
    stops = F.concat(F.transform("gone", lambda g: g["from"].cast("int")), F.array(F.size(lines)))
    left = F.flatten(F.zip_with(edges, stops, lambda a, z: F.slice(lines, a + 1, z - a)))
    out = [F.when(F.col("gone").isNull(), row[c]).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else row[c].alias(c) for c in docs.columns]
    out += [F.coalesce(n, F.lit(0)).cast("long").alias(c) for n, c in (("n_gone", count_col), ("n_long", long_col), ("most_gone", run_col)) if c]
    return joined.select(*out)
