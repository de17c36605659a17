"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character 3- and
4-grams, followed by a softmax layer; both are trained by numpy stochastic gradient
descent. The softmax input is linear in the average, so a trained model folds into one
number per hash slot, and scoring is a table look-up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, map_texts, same_ids

#: Hash slots; the model that every task gets holds this many 32-bit floats, whatever the data.
SLOTS = 1 << 18
DIM = 8
_PAD = b"\0\0\0\0"


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of every document's features, and where each document begins in them.

    Per byte position of the lower-cased text a 3-gram and a 4-gram (zero bytes stand after
    the end), and per word its hash. An empty text has the pads' grams only.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() + _PAD for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw) + _PAD, np.uint8)
    n = int(size.sum())
    b = flat.astype(np.uint32)
    three = b[:n] | b[1 : n + 1] << 8 | b[2 : n + 2] << 16
    four = three | b[3 : n + 3] << 24
    shift = np.uint32(32 - 18)
    blank = (flat[:n] <= 32) & ((flat[:n] == 32) | (flat[:n] == 0) | (flat[:n] >= 9) & (flat[:n] <= 13))
    inside = ~blank
    first = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]])) if n else np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    if len(first):
        # a word's hash: its bytes weighted by powers of an odd number, most recent first
        at = np.arange(n, dtype=np.int64)
        place = np.zeros(n, np.int64)
        place[first] = np.diff(np.concatenate([[0], first]))
        offset = at - np.cumsum(place)
        weight = _powers(int(offset.max()) + 1)[np.maximum(offset, 0)]
        words = np.add.reduceat(np.where(inside, b[:n] * weight, 0).astype(np.uint32), first).astype(np.uint32)
        of_word = np.searchsorted(begin, first, "right") - 1
    else:
        words, of_word = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    per_doc = np.bincount(of_word, minlength=len(texts)).astype(np.int64)
    use = size - 3  # grams that begin in the text or at its first pad, so never reach the next text
    total = 2 * use + per_doc
    start = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.uint32)
    doc = np.repeat(np.arange(len(texts)), use)
    rel = np.arange(int(use.sum())) - (np.cumsum(use) - use)[doc]
    here = begin[doc] + rel
    out[start[doc] + rel] = (three[here] * np.uint32(2654435761)) >> shift
    out[start[doc] + use[doc] + rel] = (four[here] * np.uint32(2246822519)) >> shift
    word_rank = np.arange(len(words)) - (np.cumsum(per_doc) - per_doc)[of_word]
    out[start[of_word] + 2 * use[of_word] + word_rank] = (words * np.uint32(3266489917)) >> shift
    return out, start


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 16777619, np.uint32)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint32)


def train(texts: list[str], labels: np.ndarray, epochs: int = 12, rate: float = 0.4, seed: int = 7) -> np.ndarray:
    """Stochastic gradient descent over documents; returns the folded model, SLOTS floats
    whose average over a document's features is its log-odds of label 1. The last float is a bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (SLOTS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    seen = []
    for begin in range(0, len(texts), 64):
        slots, start = features(texts[begin : begin + 64])
        for a, z in zip(start, np.append(start[1:], len(slots))):
            ids, n = np.unique(slots[a:z], return_counts=True)
            seen.append((ids.astype(np.int32), (n / n.sum()).astype(np.float32)))
    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            step = rate * (1 - done / steps)
            done += 1
            ids, share = seen[i]
            rows = table[ids]
            mean = share @ rows
            logit = out @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = p @ out
            out -= step * np.outer(p, mean)
            bias -= step * 0.1 * p
            table[ids] = rows - step * np.outer(np.sqrt(share), back)
    folded = table @ (out[1] - out[0])
    return np.append(folded, bias[1] - bias[0]).astype(np.float32)


def score(texts: list[str], model: np.ndarray) -> np.ndarray:
    slots, start = features(texts)
    total = np.add.reduceat(model[slots].astype(np.float64), start) if len(texts) else np.zeros(0)
    mean = total / np.diff(np.append(start, len(slots)))
    return 1 / (1 + np.exp(-np.clip(mean + model[-1], -30, 30)))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 3000) -> np.ndarray:
    """Trains in one task on at most `sample` labelled documents, whole texts, those with the
    least hash of the id. Only ids with crc32(id as text) mod 3 != 1 are learned from. Rows
    that share an id are one document, the one with the least text."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).dropna().groupBy("_id").agg(F.max("_y").cast("int").alias("_y"))
    marks = marks.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "_text"], kind="stable").head(sample)
        y = (rows["_y"].to_numpy() > 0).astype(int)
        return pd.DataFrame({"model": [train(list(rows["_text"]), y).tobytes()]})

    texts, marks = same_ids(fresh(docs, id_col, text_col), marks)
    learned = texts.join(F.broadcast(marks), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y"))
    got = learned.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(one, "model binary").collect()
    return np.frombuffer(bytes(got[0][0]), np.float32) if got else np.zeros(SLOTS + 1, np.float32)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000) -> DataFrame:
    """Per document: held_out, score (0 to 1) and predicted (score >= 0.5).

    The model is fitted on a bounded sample (see fit) and then scores every whole text; a
    null text is empty and gets the score of an empty text. Without labels every score is
    0.5. Null ids are not held out and not learned from. Ids are compared as text where their
    types differ. Repeated rows get equal rows; other columns, whatever their names, are
    ignored; texts of any length are scored whole; an empty table gives no rows. The broadcast model has a fixed size (SLOTS floats, 1 MB).
    """
    model = fit(spark, docs, labels, id_col, text_col, sample=sample)
    sent = spark.sparkContext.broadcast(model)
    scored = map_texts(fresh(docs, id_col, text_col), lambda texts: {"score": score(texts, sent.value)}, "score double")
    return scored.select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
