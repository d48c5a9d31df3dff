"""External records: a body is looked into once a name, and one small file of records is dealt to tasks."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import reports
from tessera.sources import views as V

SF = "/root/testdata/sf0.1"


def test_a_name_is_looked_up_once(spark):
    body = spark.createDataFrame([('{"resource":"https://a.example/x/","healthy":true,"type":" ","transport":"my-agent","safety":"","safetyStatus":"safe"}',), ("no json",), (None,)], "body string")
    found = body.select(reports.external_record(F.col("body")).alias("r")).select("r.*")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    names = sum(map(len, reports.EXTERNAL_FIELDS.values())) + 4 + 4 + 3 + 2
    assert 0 < plan.count("get_json_object(") <= names
    rows = [(r.url, r.key, r.liveness, r.safety, r.status) for r in found.collect()]
    assert rows == [("https://a.example/x", "a2a:https://a.example/x", "pass", "pass", "active"), (None, None, "unknown", "unknown", "unknown"), (None, None, "unknown", "unknown", "unknown")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_records_are_dealt_by_number(spark):
    part = V.read(spark, SF, "part")
    sizes = [r.n for r in V.dealt(part, 2_000, "p_partkey").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == part.count() and len(sizes) == 10 and max(sizes) < 4_000
