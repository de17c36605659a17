"""Filter audit: brute force over documents, orders and steps on odd rows."""

import re
from itertools import permutations

from threatlake.llm import audit


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for doc, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = doc is not None and any(o is not None and o < doc and (t or "") == text for o, t, _ in rows)
        judged.append((part or "", {f for f, bad in fails.items() if bad}, doc in good, doc in toxic))
    out, shapley = [], {}
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [j for j in mine if f in j[1] and not before & j[1]]
                kept = sum(not (before | {f}) & j[1] for j in mine)
                again = sum(f in j[1] and bool(before & j[1]) for j in mine)
                out.append((part, order, step, kept, len(removed), again, sum(j[1] == {f} for j in mine), sum(j[2] for j in removed), sum(j[3] for j in removed), f))
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, None, "a"), (2, "", "a"), (None, "", "a"), (3, long, "b"), (4, long, "b"), (4, long, "b"), (5, long.upper(), "b"), (6, "same " * 80, None), (7, "same " * 80, ""),
        (8, "#" + long, "b"), (None, long, "b"), (9, "x " * 500_000, "b"), (10, "Short TEXT $", "a"), (10, "short text", "b"),
    ]
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, None), (6, 0, 1), (None, 1, 1), (99, 1, 1), (10, None, 1)]
    docs = spark.createDataFrame([(*r, 1, "z", 0) for r in rows], "doc_id long, text string, source string, _row int, prefix string, quality int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(spark, docs, marks)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit.audit(spark, docs, labels).count() == 0


def test_one_join_serves_all_filters(spark, monkeypatch):
    """The driver's memory follows the plans: a join per filter and set filled it on few rows."""
    joins, sent = [], []
    keep = audit.Scratch.keep

    def counted(self, df, name):
        run = df._jdf.queryExecution()
        joins.append(run.optimizedPlan().toString().count("Join "))
        if name.startswith(("survivors", "effects")):
            sent.append("Broadcast" in run.sparkPlan().toString())
        return keep(self, df, name)

    monkeypatch.setattr(audit.Scratch, "keep", counted)
    docs = spark.createDataFrame([(1, "some text", "a")], "doc_id long, text string, source string")
    audit.audit(spark, docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert sum(joins) > 0 and max(joins) <= 2 and sum(joins) <= 10, joins
    assert sent and not any(sent)
