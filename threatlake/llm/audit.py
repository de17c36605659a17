"""How filters interact, by failing-id relations.

One table holds the ids that fail each filter. The survivors of a set of filters are the
survivors of a smaller set left-anti joined with the ids of one more filter; what a filter
removes after a set is a left-semi join of the set's survivors with its ids, and what it
would remove again is the left-anti join of its ids with those survivors. Orders that begin
with the same filters share these: five filters have 120 orders, but 32 sets.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, same_ids

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"
#: What a filter does at a step, counted in rows.
EFFECTS = ("removed", "redundant", "good_lost", "toxic_lost")


def text_filters() -> dict[str, Column]:
    """Failure conditions over the columns _text, _words and _copy."""
    text = F.col("_text")
    words = F.size("_words")
    return {
        "A": words < 50,
        "B": 100 * F.size(F.array_distinct("_words")) < 65 * words,
        "C": 100 * (F.length(text) - F.length(F.translate(text, LETTERS, ""))) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": F.col("_copy"),
    }


def with_copies(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (_row, _doc, _digest, ...) and _copy: whether a smaller _doc has the same digest.

    Rows without a _doc have no smaller one and are none. Both sides of the join are written
    tables, so that Spark can split a digest that many rows share.
    """
    least = rows.groupBy("_digest").agg(F.min("_doc").alias("_least"), F.count("*").alias("_many")).where("_many > 1").select("_digest", "_least")
    found = rows.join(scratch.keep(least, "copies"), "_digest", "left")
    return found.withColumn("_copy", F.coalesce(F.col("_doc") > F.col("_least"), F.lit(False))).drop("_least", "_digest")


def prepare(scratch: Scratch, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One written row per document: a number of its own, its part, its labels and what it fails."""
    named = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"))
    rows = named.withColumn("_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    own = {k: v for k, v in text_filters().items() if k != "E"}
    # a repeated or missing id would join wrongly: rows get a number, fixed when they are written
    rows = rows.select("_doc", "_part", F.unhex(F.sha2("_text", 256)).alias("_digest"), *(v.alias(k) for k, v in own.items()), F.monotonically_increasing_id().alias("_row"))
    rows = with_copies(scratch.keep(rows, "rows"), scratch).withColumn("E", F.col("_copy"))
    marks = labels.select(F.col(id_col).alias("_doc"), "quality", "toxic").where("_doc is not null").groupBy("_doc")
    marks = marks.agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    rows, marks = same_ids(rows, marks, "_doc")
    rows = rows.join(marks, "_doc", "left").select("_row", "_part", *"ABCDE", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("_good", "_toxic")))
    return scratch.keep(rows, "base")


def relations(scratch: Scratch, base: DataFrame, filters: str) -> tuple[DataFrame, DataFrame]:
    """Counts by part of what survives each set of filters (_part, prefix, kept), and of what
    each filter does after each set (_part, prefix, step_filter and the four of EFFECTS).

    base: _row, _part, _good, _toxic and one boolean column per filter; filters: letters in
    rising order. The filter is a column of the failing ids and the set one of the survivors,
    so that one join serves all of them: a join per filter and set makes plans, generated code
    and broadcasts that fill the driver, however few the rows. Ids are merged, not broadcast:
    their files are many times smaller than what the driver would hold.
    """
    letters = F.array(*map(F.lit, filters))
    sets = [s for k in range(1, len(filters)) for s in map("".join, combinations(filters, k))]
    failed = F.explode(F.array_compact(F.array(*(F.when(F.col(f), f) for f in filters))))
    failing = scratch.keep(base.select("_row", "_part", failed.alias("step_filter")), "failing")
    ids = failing.select("_row", "step_filter").hint("merge")
    names = [f"survivors-{k}" for k in range(len(filters) + 1)]
    survivors = scratch.keep(base.select("_row", "_part", "_good", "_toxic", F.lit("").alias("prefix")), names[0])
    for name in names[1:]:
        # each set is reached once, from the set without its last filter
        later = F.filter(letters, lambda f: f > F.substring("prefix", -1, 1))
        passed = survivors.withColumn("step_filter", F.explode(later)).join(ids, ["_row", "step_filter"], "left_anti")
        survivors = scratch.keep(passed.select("_row", "_part", "_good", "_toxic", F.concat("prefix", "step_filter").alias("prefix")), name)
    survivors = scratch.spark.read.schema(survivors.schema).parquet(*(f"{scratch.base}/{name}" for name in names))
    kept = scratch.keep(survivors.groupBy("_part", "prefix").agg(F.count("*").alias("kept")), "kept")
    others = F.filter(letters, lambda f: ~F.col("prefix").contains(f))
    removed = survivors.withColumn("step_filter", F.explode(others)).join(ids, ["_row", "step_filter"], "left_semi")
    after = F.filter(F.array(*map(F.lit, sets)), lambda s: ~s.contains(F.col("step_filter")))
    again = failing.withColumn("prefix", F.explode(after)).join(survivors.select("_row", "prefix").hint("merge"), ["_row", "prefix"], "left_anti")
    cells = [
        removed.select("_part", "prefix", "step_filter", *marks(1, 0, F.col("_good").cast("int"), F.col("_toxic").cast("int"))),
        again.select("_part", "prefix", "step_filter", *marks(0, 1, 0, 0)),
    ]
    sums = reduce(DataFrame.unionByName, cells).groupBy("_part", "prefix", "step_filter").agg(*(F.sum(c).cast("long").alias(c) for c in EFFECTS))
    return kept, scratch.keep(sums, "effects")


def marks(*values: int | Column) -> list[Column]:
    """One row's share in each of EFFECTS."""
    return [(F.lit(v) if isinstance(v, int) else v).alias(c) for c, v in zip(EFFECTS, values, strict=True)]


def orders(spark: SparkSession, filters: str) -> DataFrame:
    """filter_order, step, step_filter, the sets before and after the step, and all others."""
    whole = spark.range(1).select(F.explode(F.split(F.lit(",".join(map("".join, permutations(filters)))), ",")).alias("filter_order"))
    steps = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))

    def sorted_set(text: Column) -> Column:
        return F.array_join(F.array_sort(F.split(text, "")), "")

    return steps.select(
        "filter_order", "step", F.substring("filter_order", F.col("step"), 1).alias("step_filter"),
        F.when(F.col("step") == 1, "").otherwise(sorted_set(F.expr("left(filter_order, step - 1)"))).alias("prefix"),
        sorted_set(F.expr("left(filter_order, step)")).alias("after"),
    )


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, order of the five text filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty (it fails A alone, and E where a smaller id has an empty text); a
    null part is the empty string. Every row is a document: repeated rows are counted each,
    and as their ids are equal none is a copy on account of the other; a row without an id
    fails E never and makes no other row fail it. Labels of an id given several times count
    if one of them says so; labels without an id count for nothing. Texts of any length are
    judged whole. Other columns are ignored, whatever their names. An empty table has no
    parts and gives no rows.
    """
    scratch = Scratch(spark, "audit")
    base = prepare(scratch, docs, labels, id_col, text_col, part_col)
    kept, effects = relations(scratch, base, FILTERS)
    parts = kept.where("prefix = ''").select("_part")
    steps = parts.select("_part", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))).alias("filter_order"))
    steps = steps.join(F.broadcast(orders(spark, FILTERS)), "filter_order")
    steps = steps.join(effects, ["_part", "prefix", "step_filter"], "left").fillna(0, list(EFFECTS))
    steps = steps.join(kept.select("_part", F.col("prefix").alias("after"), "kept"), ["_part", "after"], "left").fillna(0, ["kept"])
    # after all the others a filter removes what fails it alone; every order has the filter once
    alone = effects.where(F.length("prefix") == len(FILTERS) - 1).select("_part", "step_filter", F.col("removed").alias("unique_fails"))
    shapley = steps.groupBy("_part", "step_filter").agg(F.sum("removed").cast("long").alias("shapley"))
    steps = steps.join(alone, ["_part", "step_filter"], "left").fillna(0, ["unique_fails"]).join(shapley, ["_part", "step_filter"])
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return steps.select(F.col("_part").alias("part"), "filter_order", "step", *counts)
