import pytest

from helpers import as_rows, plan_of
from dockside.operators import guarded_sql as g

VERDICTS = {
    "SELECT 1": ("ok", None),
    "select a from t": ("ok", None),
    "  \n\tSelect 1": ("ok", None),
    " SELECT 1": ("ok", None),
    "SELECTED": ("not_select", None),
    "WITH t AS (SELECT 1) SELECT * FROM t": ("not_select", None),
    "DROP TABLE orders": ("not_select", None),
    "": ("not_select", None),
    None: ("not_select", None),
    "SELECT 1;": ("blocked", ";"),
    "SELECT 'Updated'": ("blocked", "update"),
    "SELECT created_at FROM t": ("blocked", "create"),
    "SELECT 1 -- note": ("blocked", "--"),
    "SELECT 1; DROP TABLE t": ("blocked", "drop"),
    "SELECT execute": ("blocked", "exec"),
    "SELECT reflect('a', 'b')": ("blocked", "reflect"),
    "SELECT `input_file_name` ()": ("blocked", "input_file_name"),
    "SELECT 'reflected', 'it''s reflect(1)' AS x": ("ok", None),
}


def test_audit(spark):
    df = spark.createDataFrame([(text,) for text in VERDICTS], "statement string")
    audited = g.sql_audit(df, "statement")
    assert {row[0]: row[1:] for row in as_rows(audited)} == VERDICTS
    assert "Python" not in plan_of(audited)
    counts = {row[:2]: row[2] for row in as_rows(g.audit_counts(audited))}
    assert counts[("not_select", None)] == 5


def test_single_statement_agrees_with_audit():
    for text, (verdict, word) in VERDICTS.items():
        if text is None:
            continue
        if verdict == "ok":
            g.check_statement(text)
            continue
        with pytest.raises(g.GuardError) as refused:
            g.check_statement(text)
        assert (word or "SELECT") in str(refused.value)


def views(rows):
    return {"orders": lambda session: session.range(rows).withColumnRenamed("id", "order_id")}


@pytest.mark.parametrize("rows, kept, cut", [(0, 0, False), (50, 50, False), (51, 50, True)])
def test_cap(spark, rows, kept, cut):
    result = g.guarded_select(spark, "SELECT order_id FROM orders ORDER BY 1", views(rows))
    record = result.collect()
    assert record["columns"] == ["order_id"]
    assert (len(record["rows"]), record["row_count"], record["truncated"]) == (kept, kept, cut)
    rows = result.frame.collect()
    assert [row.order_id for row in rows] == list(range(kept))
    assert {(row.row_count, row.truncated) for row in rows} <= {(kept, cut)}


def test_limit_is_in_the_plan(spark):
    result = g.guarded_select(spark, "SELECT order_id FROM orders ORDER BY 1", views(1000))
    assert "TakeOrderedAndProject(limit=51" in plan_of(result._probe)


def test_errors_are_messages(spark, tmp_path):
    with pytest.raises(g.GuardError, match="missing_column"):
        g.guarded_select(spark, "SELECT missing_column FROM orders", views(1))
    with pytest.raises(g.GuardError):
        g.guarded_select(spark, "SELECT 1 / (order_id - order_id) FROM orders", views(1)).collect()
    spark.range(1).write.parquet(str(tmp_path / "secret"))
    with pytest.raises(g.GuardError):
        g.guarded_select(spark, f"SELECT * FROM parquet.`{tmp_path}/secret`", views(1))
    with pytest.raises(g.GuardError, match="not permitted"):
        g.guarded_select(spark, "SELECT reflect('java.lang.System', 'exit', 1)", views(1))


def test_only_given_views(spark):
    spark.range(1).createOrReplaceTempView("private_view")
    with pytest.raises(g.GuardError):
        g.guarded_select(spark, "SELECT * FROM private_view", views(1))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM global_temp.secret",
        "SELECT (SELECT MAX(x) FROM global_temp.secret) FROM orders",
        "SELECT * FROM saved_table",
        "SELECT * FROM default.orders",
        "SELECT * FROM range(5)",
        "SELECT 1 FROM orders WHERE EXISTS (SELECT 1 FROM saved_table)",
        "SELECT * FROM IDENTIFIER('global_temp.secret')",
        "SELECT * FROM IDENTIFIER('global_temp.' || 'secret')",
        "SELECT (SELECT MAX(x) FROM IDENTIFIER('global_temp.' || 'secret')) FROM orders",
        "SELECT 1 FROM orders WHERE order_id IN (SELECT x FROM IDENTIFIER('global_temp.secret'))",
        "SELECT * FROM IDENTIFIER('not_' || 'there')",
        "SELECT * FROM orders JOIN LATERAL (SELECT * FROM IDENTIFIER('global_temp.secret')) ON true",
    ],
)
def test_no_relation_but_the_views(spark, sql):
    spark.sql("SELECT 42 AS x").createOrReplaceGlobalTempView("secret")
    with pytest.raises(g.GuardError, match="given views"):
        g.guarded_select(spark, sql, views(1))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT IDENTIFIER('java_' || 'method')('java.lang.System', 'lineSeparator')",
        "SELECT IDENTIFIER('input_file_' || 'name')() FROM orders",
        "SELECT order_id FROM orders ORDER BY IDENTIFIER('ref' || 'lect')('java.lang.System', 'lineSeparator')",
    ],
)
def test_no_call_outside_by_another_name(spark, sql):
    with pytest.raises(g.GuardError, match="not permitted"):
        g.guarded_select(spark, sql, views(1))


@pytest.mark.parametrize(
    "sql,n",
    [
        ("SELECT a.order_id FROM orders a JOIN orders b ON a.order_id = b.order_id", 3),
        ("SELECT order_id FROM IDENTIFIER('ord' || 'ers')", 3),
        ("SELECT order_id FROM orders WHERE order_id IN (SELECT MAX(order_id) FROM orders)", 1),
        ("SELECT x FROM VALUES (1), (2) AS v(x)", 2),
        ("SELECT order_id FROM ORDERS UNION ALL SELECT 9", 4),
        ("SELECT 1", 1),
    ],
)
def test_the_views_in_any_form(spark, sql, n):
    assert g.guarded_select(spark, sql, views(3)).collect()["row_count"] == n


def test_saved_tables_stay_hidden(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS saved_numbers")
    spark.range(3).write.option("path", str(tmp_path / "saved")).saveAsTable("saved_numbers")
    try:
        with pytest.raises(g.GuardError, match="given views"):
            g.guarded_select(spark, "SELECT * FROM saved_numbers", views(1))
        with pytest.raises(g.GuardError, match="given views"):
            g.guarded_select(spark, "SELECT * FROM IDENTIFIER('saved_' || 'numbers')", views(1))
    finally:
        spark.sql("DROP TABLE saved_numbers")


def test_no_products(spark):
    for sql in ("SELECT 1 AS x FROM orders a, orders b", "SELECT 1 AS x FROM orders a CROSS JOIN orders b"):
        with pytest.raises(g.GuardError):
            g.guarded_select(spark, sql, views(2)).collect()


def test_literals_and_settings(spark):
    record = g.guarded_select(spark, "SELECT 'reflected' AS word FROM orders", views(1)).collect()
    assert record["rows"] == [["reflected"]]
    child = g._child_session(spark)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        assert child.conf.get(key) == spark.conf.get(key)


def test_names_of_result_columns(spark):
    for sql in ("SELECT 1 AS row_count FROM orders", "SELECT order_id, order_id FROM orders"):
        with pytest.raises(g.GuardError, match="names"):
            g.guarded_select(spark, sql, views(1))
