"""The walk over a JSON text parses it once, and asks for kinds of leaves only."""

from pyspark.sql import functions as F

from tessera.operators import records


def test_a_text_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"b":[1.0,{"c":"x"},null,[]],"a":{"z":true,"y":{}},"n":"5","e":1e20}',), ("[2,",), (None,), ("7",)], "j string")
    found = rows.select(records.flattened(F.col("j")).alias("lines"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(") == 1 and plan.count("schema_of_variant(") == 1
    assert [list(r.lines) for r in found.collect()] == [["a.z: true", "b[0]: 1", "b[1].c: x", "e: 1.0E20", "n: 5"], [], [], [": 7"]]
