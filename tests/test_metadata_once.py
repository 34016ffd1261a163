"""Metadata read from rendered texts."""

from lectern.plans.registered import documents


def test_metadata_renders_a_text_once(spark):
    plan = documents.text_metadata(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!-- page: ") == 1
