"""Which statements may run."""

from __future__ import annotations

import pytest

from forumlens.operators.guard import guarded_sql, unsafe_reason
from tests.fixture import evidence, labels, values

REFUSED = [
    # A function named by a computed text, by a path of names or by a parameter.
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT IDENTIFIER('re' || 'flect')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT brand FROM labels WHERE IDENTIFIER('java_method')('java.lang.Math', 'abs', 1) = 1",
    "SELECT IDENTIFIER('brand') FROM labels", "SELECT system.builtin.reflect('a', 'b')", "SELECT :name", "SELECT ?",
    "SELECT try_reflect('java.lang.Math', 'abs', 1)", "SELECT reflect('java.lang.Math', 'abs', 1)",
    "SELECT java_method('java.lang.Math', 'abs', 1)", "VALUES (reflect('java.lang.Math', 'abs', 1))",
    "SELECT brand FROM labels PIVOT (max(reflect('a', 'b')) FOR brand IN ('a'))",
    "SELECT filter(array(1), x -> reflect('a', 'b') = x)", "SELECT max(brand) FILTER (WHERE reflect('a', 'b') = '') FROM labels",
    # What tells about the session or its files.
    "SELECT input_file_name() FROM labels", "SELECT current_user()", "SELECT version()", "SELECT my_udf(brand) FROM labels",
    "SELECT count(*) FROM labels GROUP BY input_file_block_start()",
    # Files as tables, tables made by functions, generators and scripts.
    "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM csv.`/etc/hosts`", "SELECT * FROM json.`s3://b/k`",
    "SELECT * FROM range(10)", "SELECT * FROM explode(array(1))", "SELECT * FROM identifier('hidden')",
    "SELECT * FROM labels LATERAL VIEW explode(array(1)) t AS x", "SELECT transform(a) USING 'cat' AS b FROM labels",
    # Anything that is no query, or more than one.
    "CACHE TABLE labels", "CREATE OR REPLACE TEMP VIEW labels AS SELECT 1", "DROP VIEW labels", "INSERT INTO labels VALUES ('x')",
    "INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT * FROM labels", "SET spark.sql.shuffle.partitions = 1", "RESET",
    "SHOW TABLES", "DESCRIBE labels", "EXPLAIN SELECT 1", "ADD JAR x", "EXECUTE IMMEDIATE 'select 1'", "BEGIN SELECT 1; END",
    "DECLARE VARIABLE v = 1", "SELECT 1; SELECT 2", "", " \n",
    # Tables that were not given, wherever a plan can hold one.
    "SELECT * FROM hidden", "FROM hidden SELECT *", "TABLE hidden", "SELECT * FROM labels, hidden",
    "SELECT * FROM labels JOIN `hidden` USING (evidence_id)", "SELECT * FROM labels WHERE brand IN (SELECT brand FROM hidden)",
    "SELECT (SELECT max(brand) FROM hidden)", "SELECT * FROM labels ORDER BY (SELECT max(brand) FROM hidden)",
    "SELECT count(*) OVER (PARTITION BY (SELECT max(brand) FROM hidden)) FROM labels",
    # Windows that have a name.
    "SELECT count(*) OVER w FROM labels WINDOW w AS (PARTITION BY brand = (SELECT max(brand) FROM hidden))",
    "SELECT count(*) OVER w FROM labels WINDOW w AS (PARTITION BY (SELECT min(a) FROM parquet.`/tmp/x`))",
    "SELECT count(*) OVER w FROM labels WINDOW w AS (PARTITION BY reflect('a', 'b'))",
    "SELECT count(*) OVER w FROM labels WINDOW v AS (PARTITION BY brand), w AS (ORDER BY input_file_name())",
    "SELECT * FROM (SELECT count(*) OVER w FROM labels WINDOW w AS (PARTITION BY (SELECT max(brand) FROM hidden))) x",
    "SELECT * FROM labels, LATERAL (SELECT * FROM hidden)", "SELECT brand FROM labels UNION SELECT brand FROM hidden",
    "SELECT brand FROM labels GROUP BY brand HAVING EXISTS (SELECT 1 FROM hidden)",
    "SELECT * FROM other.labels", "SELECT * FROM spark_catalog.default.labels",
    # Names of common table expressions count only where they are in scope.
    "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden",
    "SELECT * FROM (WITH s AS (SELECT 1 a) SELECT * FROM s) JOIN s", "WITH a AS (SELECT 1) SELECT * FROM (SELECT * FROM hidden) x",
]

ALLOWED = [
    "SELECT MIN(created_at), MAX(score) FROM evidence_units",
    "SELECT subreddit, AVG(confidence) FROM labels JOIN evidence_units USING (evidence_id) WHERE NOT is_delight "
    "GROUP BY ALL ORDER BY 2 LIMIT 3",
    "SELECT upper(brand) || '-' || model, confidence * 100 % 7, CASE WHEN brand LIKE 'C%' THEN 1 ELSE -1 END FROM labels "
    "WHERE confidence BETWEEN 0.1 AND 1 AND brand IN ('Chevy', 'GM') OR pain_theme IS NULL",
    "SELECT CAST(score AS STRING), substring(title FROM 1 FOR 3), array(1, 2)[0], struct(1 AS a).a FROM evidence_units",
    "SELECT transform(array(1, 2), x -> x + 1), SUM(score) OVER (ORDER BY created_at ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) "
    "FROM evidence_units",
    "SELECT brand, count(*) FROM labels GROUP BY CUBE (brand, model)",
    "WITH pain AS (SELECT evidence_id FROM labels WHERE is_pain_point = TRUE) SELECT COUNT(*) FROM pain",
    "WITH a AS (SELECT brand FROM labels), b AS (SELECT * FROM a) SELECT COUNT(*) FROM b",
    "SELECT EXTRACT(YEAR FROM e.created_at) FROM evidence_units e",
    "WITH p(id) AS (SELECT evidence_id FROM labels) SELECT id FROM p",
    "SELECT 'SET x; DROP TABLE y' AS s FROM labels;",
    "SELECT brand, RANK() OVER (PARTITION BY brand ORDER BY confidence DESC) r FROM labels",
    "SELECT * FROM (SELECT brand, sentiment FROM labels) PIVOT (count(*) FOR sentiment IN ('positive', 'negative'))",
    "SELECT DATE_TRUNC('week', created_at) w, COUNT(*) FROM evidence_units GROUP BY 1 ORDER BY 1",
    "SELECT * FROM labels l WHERE EXISTS (SELECT 1 FROM evidence_units e WHERE e.evidence_id = l.evidence_id)",
    "SELECT brand FROM labels UNION ALL SELECT author FROM Evidence_Units",
    "SELECT brand, count(*) OVER w, max(confidence) OVER v FROM labels WINDOW w AS (PARTITION BY brand), v AS (ORDER BY model)",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    assert unsafe_reason(spark, sql)


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed_and_runs(spark, sql):
    assert unsafe_reason(spark, sql) is None
    guarded_sql(spark, sql, {"evidence_units": evidence(spark), "labels": labels(spark)}).collect()


def test_result(spark):
    tables = {"evidence_units": evidence(spark), "labels": labels(spark)}
    sql = """SELECT ROUND(100.0 * SUM(CASE WHEN l.sentiment = 'negative' THEN 1 ELSE 0 END) / COUNT(*), 1) AS pct
             FROM evidence_units e JOIN labels l ON e.evidence_id = l.evidence_id WHERE l.brand = 'GMC'"""
    assert [float(v) for (v,) in values(guarded_sql(spark, sql, tables))] == [40.0]
    with pytest.raises(ValueError, match="secret"):
        guarded_sql(spark, "SELECT * FROM secret", tables)


def test_views_are_put_back(spark):
    spark.range(3).createOrReplaceTempView("labels")
    try:
        found = guarded_sql(spark, "SELECT brand FROM labels", {"labels": labels(spark)})
        assert spark.table("labels").columns == ["id"] and found.columns == ["brand"] and found.count() == labels(spark).count()
    finally:
        spark.catalog.dropTempView("labels")
    guarded_sql(spark, "SELECT 1 FROM evidence_units", {"evidence_units": evidence(spark)})
    assert "evidence_units" not in [t.name for t in spark.catalog.listTables()]


def test_the_analysed_plan_is_looked_at_again(spark, monkeypatch):
    from forumlens.operators import guard

    monkeypatch.setattr(guard, "unsafe_reason", lambda *a: None)
    with pytest.raises(ValueError, match="CallMethodViaReflection"):
        guarded_sql(spark, "SELECT IDENTIFIER('reflect')('java.lang.Math', 'abs', 1) FROM labels", {"labels": labels(spark)})


def test_relations_of_the_analysed_plan_are_looked_at(spark, monkeypatch, tmp_path):
    from forumlens.operators import guard

    monkeypatch.setattr(guard, "unsafe_reason", lambda *a: None)
    path = str(tmp_path / "other")
    labels(spark).write.parquet(path)
    for sql in (
        f"SELECT * FROM parquet.`{path}`", "SELECT * FROM range(3)",
        f"SELECT brand FROM labels WHERE brand IN (SELECT brand FROM parquet.`{path}`)",
        f"WITH a AS (SELECT brand FROM parquet.`{path}`) SELECT x.brand FROM a x JOIN a y USING (brand)",
        f"SELECT count(*) OVER w FROM labels WINDOW w AS (PARTITION BY (SELECT min(brand) FROM parquet.`{path}`))",
    ):
        with pytest.raises(ValueError, match="reading"):
            guarded_sql(spark, sql, {"labels": labels(spark)})
