import pytest

from skillscope.llm.oracle_sql import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    from oracle.check import compare
    assert compare(spark, "/root/testdata/sf0.001", keys=[name], verbose=False)[name]["status"] == "match"


def test_quotation_sql_on_quoted_messages(spark, tmp_path):
    """The driver's conversations quote nothing, so the SQL is also held against messages that do."""
    import duckdb

    from skillscope.llm import quotations
    rows = [(1, 0, "a", "First line here.\nSecond line."), (1, 1, "b", "b alone"),
            (1, 2, "c", "a wrote:\n> first  LINE here.\n> Second line.\nanswer"), (1, 3, "d", ">> Second line.\n> answer\nthird"),
            (1, 4, "e", "> b alone\n> answer\n> answer\nfourth"), (2, 0, "a", "> nothing\nown"), (2, 1, "b", "> own")]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chat.write.parquet(str(tmp_path / "c"))
    got = sorted(map(str, (tuple(r) for r in quotations.reply_ordered(chat).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    want = sorted(map(str, con.execute(ORACLE_SQL["op3_quotation_linking"]).fetchall()))
    assert got == want
