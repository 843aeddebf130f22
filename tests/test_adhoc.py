"""The guarded SQL entry."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from weblens.formats import NGINX
from weblens.operators import parse as p
from weblens.plans import adhoc

LINE = '10.0.0.{n} - - [01/May/2025:10:00:{n:02d} +0000] "{m} /p{n} HTTP/1.1" {s} {n} "-" "a"'


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    lines = [(LINE.format(n=n, m=m, s=s),) for n, m, s in
             ((1, "GET", 200), (2, "POST", 201), (3, "GET", 500), (4, "DELETE", 404))]
    logs = p.accepted(p.parse(spark.createDataFrame(lines, "value string"), NGINX))
    logs.withColumn("created_at", F.col("timestamp")).createOrReplaceTempView("nginx_logs")
    logs.createOrReplaceTempView("nexus_logs")
    spark.range(5000).createOrReplaceTempView("many")


@pytest.mark.parametrize("text", [
    "SELECT * FROM nginx_logs",
    "select ip_address from nginx_logs",
    "   SELECT   timestamp   FROM nginx_logs ORDER BY timestamp DESC   ",
    "SELECT nginx.ip_address, nexus.path FROM nginx_logs nginx, nexus_logs nexus",
    "SELECT created_at FROM nginx_logs WHERE method = 'DELETE'",
    "SELECT count(*) FROM nginx_logs;",
    "SELECT transform(array(1, 2), x -> x + 1) AS a",
    "SELECT 'reflect(drop table)' AS text, path FROM nginx_logs WHERE user_agent LIKE '%using%'",
    "SELECT a.path FROM nginx_logs a JOIN nexus_logs b USING (path)",
])
def test_accepted(spark, text):
    assert adhoc.query(spark, text).columns


@pytest.mark.parametrize("text", [
    "DROP TABLE nginx_logs", "UPDATE nginx_logs SET ip_address = '0'", "DELETE FROM nginx_logs",
    "INSERT INTO nginx_logs VALUES (1)", "CREATE TABLE t (id INT)", "ALTER TABLE nginx_logs ADD COLUMN x INT",
    "WITH x AS (SELECT 1) SELECT * FROM x", "SELE CT * FROM nginx_logs", "", "   ", None,
    "-- note\nSELECT 1",
])
def test_refused_unless_select(spark, text):
    with pytest.raises(adhoc.QueryRefused):
        adhoc.query(spark, text)


@pytest.mark.parametrize("text", [
    "SELECT * FROM nginx_logs; DROP TABLE nexus_logs", "SELECT * FROM", "SELECT 1; SELECT 2",
])
def test_one_statement_only(spark, text):
    with pytest.raises(AnalysisException):
        adhoc.query(spark, text)


@pytest.mark.parametrize("text", [
    "SELECT TRANSFORM(path) USING 'cat' AS (x) FROM nginx_logs",
    "SELECT * FROM (SELECT TRANSFORM(path) USING 'cat' AS (x) FROM nginx_logs)",
    "SELECT * FROM (MAP path USING 'cat' AS (x) FROM nginx_logs)",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT java_method('java.util.UUID', 'randomUUID')",
    "SELECT path FROM nginx_logs WHERE try_reflect('java.util.UUID', 'randomUUID') = 'x'",
    "SELECT (SELECT reflect('java.util.UUID', 'randomUUID')) AS x",
    "SELECT path FROM nginx_logs WHERE EXISTS (SELECT reflect('java.util.UUID', 'randomUUID'))",
])
def test_programs_and_jvm_calls_are_refused(spark, text):
    with pytest.raises((adhoc.QueryRefused, ParseException)) as raised:
        adhoc.query(spark, text)
    assert "TRANSFORM" in text or "MAP" in text or raised.type is adhoc.QueryRefused


def test_files_cannot_be_read_by_path(spark, tmp_path):
    (tmp_path / "secret").write_text("x")
    before = spark.conf.get("spark.sql.runSQLOnFiles", None)
    with pytest.raises(AnalysisException):
        adhoc.query(spark, f"SELECT * FROM text.`{tmp_path}/secret`")
    assert spark.conf.get("spark.sql.runSQLOnFiles", None) == before


def test_row_cap(spark):
    assert adhoc.run_sql(spark, "SELECT * FROM many").count() == 100
    assert adhoc.run_sql(spark, "SELECT * FROM many", limit=7).count() == 7
    assert adhoc.run_sql(spark, "SELECT * FROM many", limit=99999).count() == 1000
    assert adhoc.run_sql(spark, "SELECT * FROM many", limit=0).count() == 100
    assert adhoc.run_sql(spark, "SELECT * FROM many LIMIT 3000", limit=50).count() == 50
    assert adhoc.run_sql(spark, "SELECT * FROM many LIMIT 3").count() == 3


def test_envelope(spark):
    text = "SELECT method, COUNT(*) AS count FROM nginx_logs GROUP BY method ORDER BY method"
    found = adhoc.execute(spark, text)
    assert found["columns"] == ["method", "count"] and found["row_count"] == 3
    assert found["results"][1] == {"method": "GET", "count": 2}
    assert found["query_text"] == text and found["execution_time"] >= 0
    empty = adhoc.execute(spark, "SELECT * FROM nginx_logs WHERE 1=0")
    assert (empty["results"], empty["columns"], empty["row_count"]) == ([], [], 0)


def test_values(spark):
    named = adhoc.query(spark, "SELECT path FROM nginx_logs WHERE status_code = :s", {"s": 500})
    assert [r.path for r in named.collect()] == ["/p3"]
    placed = adhoc.query(spark, "SELECT path FROM nginx_logs WHERE method = ? AND status_code < ?", ["GET", 300])
    assert [r.path for r in placed.collect()] == ["/p1"]
    hostile = adhoc.query(spark, "SELECT path FROM nginx_logs WHERE method = ?", ["x' OR '1'='1"])
    assert hostile.count() == 0


def test_names_of_forbidden_classes_may_be_text(spark):
    found = adhoc.execute(spark, "SELECT 'TryReflect' AS a, 'ScriptTransformation' AS b")
    assert found["row_count"] == 1 and not found["truncated"]
    with pytest.raises(adhoc.QueryRefused):
        adhoc.query(spark, "SELECT * FROM (SELECT reflect('java.lang.Math', 'random') AS r)")


def test_a_cut_result_says_so(spark):
    spark.range(20).createOrReplaceTempView("twenty")
    assert adhoc.execute(spark, "SELECT * FROM twenty", limit=19)["truncated"]
    assert not adhoc.execute(spark, "SELECT * FROM twenty", limit=20)["truncated"]
    assert adhoc.execute(spark, "SELECT * FROM twenty", limit=5000, most=7)["row_count"] == 7
