"""Snippets cut and search a text once."""

from pyspark.sql import functions as F

from lectern.operators import fusion


def test_snippet_cuts_a_text_once(spark):
    rows = spark.createDataFrame([("one two three four", "three")], "t string, q string").select(fusion.snippet(F.col("t"), F.col("q"), 2).alias("s"))
    assert rows.first()["s"] == "… three four"
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 1
