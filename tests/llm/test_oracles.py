"""Queries with SQL against DuckDB; base statistics of the rules against SQL."""

import duckdb
import pytest

from threatlake.llm import queries

SF = "/root/testdata/sf0.001"


def asked(sql):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet{'/*.parquet' if __import__('os').path.isdir(f'{SF}/{t}.parquet') else ''}')")
    return con.sql(sql).fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    got = queries.queries()[name](spark, SF)
    columns = ", ".join(sorted(got.columns))
    assert sorted(map(tuple, got.selectExpr(*sorted(got.columns)).collect()), key=repr) == sorted(asked(f"select {columns} from ({queries.oracle_sql()[name]}) q"), key=repr)


def test_rule_statistics(spark):
    """The columns that the contract fixes; kept is learned and held by accuracy."""
    sql = r"""with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
      win as (select doc_id, i, concat_ws(chr(31), w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) as s from (select *, unnest(range(1, len(w) - 3)) as i from d) q),
      rep as (select doc_id, count(distinct i + k) as n from (select win.doc_id, i from win join (select doc_id, s from win group by 1, 2 having count(*) > 1) r on r.doc_id = win.doc_id and r.s = win.s) q, range(5) o(k) group by doc_id),
      dup as (select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from d) q where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id)
      select d.doc_id, len(w), length(array_to_string(w, '')), len(regexp_extract_all(t, '[#*$%&|<>]')), coalesce(dup.n, 0), coalesce(rep.n, 0) from d left join rep using (doc_id) left join dup using (doc_id)"""
    got = queries.op3_quality_rules(spark, SF).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted(asked(sql))


def test_chat_tables_with_odd_rows(spark):
    """Null keys, roles and texts, repeated rows, and columns with names used inside."""
    from threatlake.llm import chat

    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, None, None), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (2, None, "user", "</s>")]
    names = ["row", "turns", "formatted", "loss_mask", "pieces", "_r", "_t", "layout"]
    frame = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{n}` int" for n in names))
    done = chat.format_conversations(frame)
    got = {r.conv_id: [tuple(t) for t in r.t] for r in done.select("conv_id", chat.read_back(done["formatted"]).alias("t")).collect()}
    assert got == {None: [("user", "a"), ("assistant", "b")], 1: [("", ""), ("assistant", "x"), ("assistant", "x")], 2: [("user", "</s>")]}
    assert chat.format_conversations(frame.limit(0)).count() == 0
