"""Facets, top lists and per-command scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .severity import RANK

#: The fields with facets, in order.
FACETS = ("source_ip", "destination_ip", "hostname", "process_name", "parent_process_name", "user_name", "event_id", "provider", "protocol", "logon_type")
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b"
URL = r"https?://[^\s'\")\]]+"


def facets(events: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in FACETS)))
    return events.select(pairs.alias("p")).select("p.*").where("trim(value) <> ''").distinct()


def top_counts(events: DataFrame, columns: tuple[str, ...] = ("event_id", "hostname", "user_name"), most: int = 12) -> DataFrame:
    """The most frequent values; of equal counts the first seen. Ranks run over counted values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in columns)))
    counts = events.select("seq", pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    order = W.partitionBy("field").orderBy(F.desc("n"), "first_seq")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def process_edges(events: DataFrame, most: int = 20) -> DataFrame:
    pairs = events.groupBy(F.lower("parent_process_name").alias("parent"), F.lower("process_name").alias("child")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return pairs.orderBy(F.desc("n"), "first_seq").limit(most)


def iocs(events: DataFrame) -> DataFrame:
    """Distinct addresses (with their port) and links in distinct commands, external unless private."""
    found = F.concat(*(F.regexp_extract_all("commandline", F.lit(p), 0) for p in (IPV4, URL)))
    out = events.select("commandline").distinct().select(F.explode(found).alias("ioc")).distinct()
    return out.withColumn("external", ~F.col("ioc").rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"))


#: Slots of an embedding; a text has at most as many of them.
DIM = 256
SPARSE = "array<struct<idx: int, w: double>>"


def embedded(texts: DataFrame, column: str, dim: int = DIM) -> DataFrame:
    """Signed hashed 3-grams of lower-cased text, L2-normalised: (text, slots), one row per
    distinct text; null counts as empty. A text of under three characters is padded with
    blanks; slots that cancel out are left out, so slots may be empty."""
    rows = texts.select(F.coalesce(column, F.lit("")).alias("text")).distinct()
    low = F.lower("text")
    low = F.when(F.length(low) < 3, F.rpad(low, 3, " ")).otherwise(low)
    rows = rows.select("text", low.alias("_low"))
    grams = F.transform(F.sequence(F.lit(1), F.length("_low") - 2), lambda i: F.substring(F.col("_low"), i, F.lit(3)))
    rows = rows.select("text", F.explode(grams).alias("g"))
    digest = F.md5("g")
    index = F.conv(F.substring(digest, 31, 2), 16, 10).cast("int") % dim
    sign = F.when(F.conv(F.substring(digest, 29, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    sums = rows.groupBy("text", index.alias("idx")).agg(F.sum(sign).alias("w"))
    slots = F.filter(F.array_sort(F.collect_list(F.struct("idx", "w"))), lambda x: x["w"] != 0)
    whole = sums.groupBy("text").agg(slots.alias("_s"))
    norm = F.sqrt(F.aggregate("_s", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return whole.select("text", F.transform("_s", lambda x: F.struct(x["idx"].alias("idx"), (x["w"] / norm).alias("w"))).cast(SPARSE).alias("slots"))


def embed(texts: DataFrame, column: str, dim: int = DIM) -> DataFrame:
    """The embeddings as sparse rows (text, idx, w)."""
    return embedded(texts, column, dim).select("text", F.inline("slots"))


def enrich_timeline(events: DataFrame, findings: DataFrame, correlated: DataFrame) -> DataFrame:
    """Events with the greatest severity and the rules of their process's findings and of the
    correlations of their source."""
    def marks(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.max(F.expr(RANK)).alias(f"_{name}"), F.array_join(F.array_sort(F.collect_set("rule_id")), "|").alias(f"_{name}_rules"))

    joined = events.join(marks(findings, "process_guid", "p"), "process_guid", "left").join(marks(correlated, "source_ip", "s"), "source_ip", "left")
    rank = F.greatest(F.coalesce("_p", F.lit(0)), F.coalesce("_s", F.lit(0)))
    return joined.withColumns({"severity_rank": rank, "rules": F.concat_ws("|", "_p_rules", "_s_rules")}).drop("_p", "_s", "_p_rules", "_s_rules")


def filter_timeline(timeline: DataFrame, host: str = "", process: str = "", severity: str = "") -> DataFrame:
    """Rows of an enriched timeline by host, process and severity; `malicious` is all but benign."""
    words = {"critical": 4, "high": 3, "medium": 2, "low": 1, "benign": 0}
    if host:
        timeline = timeline.where(F.col("hostname") == host)
    if process:
        timeline = timeline.where(F.col("process_name") == process)
    if severity:
        timeline = timeline.where("severity_rank > 0" if severity == "malicious" else F.col("severity_rank") == words[severity])
    return timeline


def pivots(events: DataFrame, findings: DataFrame, addresses: int = 5, most: int = 10) -> DataFrame:
    """What to look at next: the first addresses, and the processes of the first findings with their rule."""
    some = events.where("destination_ip <> ''").select(F.col("destination_ip").alias("value")).distinct().orderBy("value").limit(addresses)
    first = findings.orderBy("seq", "rule_ord").limit(most).withColumn("n", F.row_number().over(W.orderBy("seq", "rule_ord"))).where("process_name <> ''")
    pairs = first.groupBy("process_name").agg(F.min_by("rule_name", "n").alias("rule_name"), F.min("n").alias("ord"))
    return some.select(F.lit("address").alias("kind"), "value", F.lit(1).alias("ord")).unionByName(
        pairs.select(F.lit("process").alias("kind"), F.concat("process_name", F.lit(" ("), "rule_name", F.lit(")")).alias("value"), "ord"))
