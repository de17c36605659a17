"""The pipeline against a plain version of every stage, and its stages on odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threatlake.llm import classifier, decontaminate, packing, queries

from .test_operators import check_bins, deleted, distance, linked

NAMES = ["_id", "_text", "_gone", "_row", "row", "mark", "_k", "_d", "gone", "_key", "_y", "_g", "line", "node", "start", "length", "offset", "score", "lang", "source", "n_chars"]


def corpus(spark, folder):
    """Good and bad texts, a passage that repeats, near copies, a leaked benchmark item."""
    rng = random.Random(12)
    good, bad = [f"g{k}" for k in range(400)], [f"b{k}" for k in range(400)]
    some = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    passage = "\n".join(some(good, 20) for _ in range(3))
    item = some(good, 25)
    texts = {}
    for k in range(60):
        texts[k] = "\n".join(some(good if k % 3 else bad, 30) for _ in range(3))
    for k in (4, 7, 10, 13):
        texts[k] += "\n" + passage
    for k in (20, 23, 26):
        texts[k] = " ".join(w if i % 60 else f"x{k}" for i, w in enumerate(some(good, 1).split() + texts[17].split()))
    for k in (31, 34):
        texts[k] += " " + item + " " + some(good, 5)
    texts |= {60: None, 61: ""}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, some(bad, 25))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, [item]


def test_pipeline_matches_plain_stages(spark, tmp_path):
    texts, items = corpus(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(spark, docs, labels)
    left = {d: t for d, t in texts.items() if classifier.score([t or ""], model)[0] >= 0.5}
    assert all(d in left for d in texts if d < 60 and d % 3) and not any(d in left for d in texts if d < 60 and d % 3 == 0)
    cut = deleted({d: t or "" for d, t in left.items()}, 50)
    left = {d: cut[d] if t is not None else None for d, t in left.items()}
    assert sum((texts[d] or "") != (t or "") for d, t in left.items()) >= 3
    groups = linked(left)
    left = {d: t for d, t in left.items() if groups[d][2]}
    assert 17 in left and not {20, 23, 26} & set(left)
    plain = [decontaminate.normal(i) for i in items]
    left = {d: t for d, t in left.items() if all(distance(i, decontaminate.normal(t or "")) > int(len(i) * decontaminate.EDIT_SHARE) for i in plain)}
    assert not {31, 34} & set(left) and len(left) > 30
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(left)
    tokens = packing.Tokens(queries.tokenizer()).model
    assert {r.doc_id: r.doc_tokens for r in rows} == {d: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in left.items()}
    check_bins(rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, tmp_path, name):
    """Nulls, empty and long texts, ties, repeated rows, text ids, columns with every private name."""
    corpus(spark, str(tmp_path))
    stage = dict(corpus_pipeline.STAGES)[name]
    long = "\n".join(f"g{k % 400} g{k * 7 % 400} line {k}" for k in range(20_000))
    rows = [("a", None), ("b", ""), (None, "g1 g2 g3"), (None, None), ("c", "  \n\t"), ("d", long), ("d", long), ("d", "g7 g8"), ("e", long), ("f", "one"), ("g", "ONE")]
    odd = spark.createDataFrame([(i, t, *range(len(NAMES))) for i, t in rows], f"doc_id string, text string, {', '.join(f'`{n}` int' for n in NAMES)}")
    assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    for ids in ("string", "long"):
        frame = odd.withColumn("doc_id", F.ascii("doc_id").cast(ids) if ids == "long" else F.col("doc_id"))
        got = stage(spark, frame, str(tmp_path))
        kept = got.collect()
        if name == "packing":
            assert sum(r.length for r in kept if r.length == r.doc_tokens == 1) >= 3 and {r.doc_id for r in kept} == {r.doc_id for r in frame.select("doc_id").collect()}
            continue
        assert got.columns == frame.columns
        if name == "minhash near-dedup":
            assert len(kept) == 8 and sum(r.text == long for r in kept) == 1
        elif name == "line dedup":
            assert len(kept) == 11 and sum(r.text == long for r in kept) == 2 and sum(r.text is None for r in kept) == 2
        elif name == "benchmark decontamination":
            assert len(kept) == 11
        else:
            assert len(kept) <= 11 and (np.array([r["_gone"] for r in kept]) == NAMES.index("_gone")).all()
