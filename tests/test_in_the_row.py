"""Features of a text are counted in its row."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.plans.registered import searching


def shuffled(spark, run):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    def total():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))

    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_features_are_counted_in_the_row(spark):
    texts = ["b a b a b c", "", None, "one", "Ä ä ä"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", vx.feature_counts(tx.feature_tokens(F.col("t"))).alias("c")).collect()
    for row in rows:
        words = (row["t"] or "").lower().split()
        want = Counter("word:" + w for w in words) + Counter(f"bigram:{a}\x1f{b}" for a, b in zip(words, words[1:]))
        assert {c["feature"]: c["n"] for c in row["c"] or []} == dict(want)


@pytest.mark.parametrize("query", ["hash_features", "hash_embedding"])
def test_features_are_not_shuffled(spark, tmp_path, query):
    rows = [(d, " ".join(f"w{d}x{n}" for n in range(5000))) for d in range(16)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(16, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    run, _ = searching.QUERIES[query]
    moved = shuffled(spark, lambda: run(spark, str(tmp_path)).collect())
    # Texts are not moved either, as the scan has enough splits; sums of slots are 64 small rows a document.
    assert moved < sum(len(t) for _, t in rows) / 4


@pytest.mark.parametrize("query", ["hash_features", "hash_embedding"])
def test_repeated_ids_are_added_up_as_in_sql(spark, tmp_path, query):
    rows = [(1, "a b a"), (1, "a c"), (2, "a b"), (None, "x y"), (None, "x"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run, sql = searching.QUERIES[query]
    held = duckdb.connect()
    held.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    asked = held.execute(sql)
    names = [d[0] for d in asked.description]
    order = lambda found: sorted((tuple(r) for r in found), key=str)
    assert order(run(spark, str(tmp_path)).select(*names).collect()) == order(asked.fetchall())
