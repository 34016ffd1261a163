"""BM25 against SQLite FTS5, cosine against NumPy, fusion and snippets on literals."""

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators import dense, evaluation, fusion, lexical, notes
from lectern.plans.registered.searching import LiveIndex

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa cóte naïve state art".split()


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    return [(str(i), " ".join(rng.choices(WORDS, k=rng.randint(1, 3))), " ".join(rng.choices(WORDS, weights=range(14, 0, -1), k=rng.randint(3, 40)))) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame(corpus(), "entity_id string, title string, text string")
    entities = rows.select(F.lit("section").alias("kind"), "entity_id", F.concat(F.lit("p"), F.substring("entity_id", 1, 1)).alias("paper_id"), "title",
                           F.lit("").alias("section_path"), "text", F.array("text").alias("match_fields"), F.array("title").alias("extra_fields"))
    return LiveIndex(entities)


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, title, text) VALUES (?, ?, ?)", [(int(i), a, b) for i, a, b in corpus()])
    return db


@pytest.mark.parametrize("query,match,exact", [
    ("alpha kappa", '"alpha" OR "kappa"', False), ("state-art cote", '"state-art" OR "cote"', False), ("naive", '"naive"', False), ("alpha beta", '"alpha beta"', True),
])
def test_bm25_equals_fts5(spark, index, fts, query, match, exact):
    queries = spark.createDataFrame([("q", query, None)], "query_id string, text string, scope string")
    got = {r["entity_id"]: r["score"] for r in lexical.score_phrases(index, lexical.query_terms(queries, exact)).collect()}
    want = {str(r[0]): -r[1] for r in fts.execute(f"SELECT rowid, bm25(t) FROM t WHERE t MATCH '{{text}}: ({match})'")}
    assert got.keys() == want.keys() and len(want) > 0
    assert all(math.isclose(got[k], want[k], abs_tol=2e-9) for k in want)


def test_scope_keeps_corpus_statistics(spark, index):
    run = lambda scope: {r["entity_id"]: r["score"] for r in lexical.search_lexical(index, spark.createDataFrame([("q", "alpha beta", scope)], "query_id string, text string, scope string"), ("section",), 1000).collect()}
    everything, scoped = run(None), run("p1")
    assert scoped and scoped == {k: v for k, v in everything.items() if k.startswith("1")}


def test_dense_equals_numpy_and_ties_by_key(spark):
    rng = np.random.default_rng(1)
    data = [(f"e{n}", rng.normal(size=8).tolist()) for n in range(300)] + [("z", [1.0] + [0.0] * 7), ("a", [2.0] + [0.0] * 7), ("zero", [0.0] * 8), ("short", [1.0, 0.0])]
    rows = spark.createDataFrame([("paper", k, k, v) for k, v in data], "kind string, entity_id string, paper_id string, vector array<float>").repartition(3)
    asked = [1.0] + [0.0] * 7
    queries = spark.createDataFrame([("q", asked, None), ("only", asked, "e7")], "query_id string, vector array<double>, scope string")
    got = dense.search_dense(rows, queries, 20).orderBy("query_id", "rank").collect()
    values = {k: (np.float32(v).astype(float)[0] / np.linalg.norm(np.float32(v).astype(float)) if any(v) else 0.0) for k, v in data if len(v) == 8}
    want = sorted(values, key=lambda k: (-round(values[k], 9), "paper:" + k))[:20]
    assert [r["entity_id"] for r in got if r["query_id"] == "q"] == want and want[:2] == ["a", "z"]
    assert [r["entity_id"] for r in got if r["query_id"] == "only"] == ["e7"]


@pytest.mark.parametrize("bound", [8 << 20, 0])
def test_dense_blocks_of_queries(spark, monkeypatch, bound):
    """Small blocks on both sides, the queries broadcast or dealt over salts."""
    monkeypatch.setattr(dense, "BLOCK_ROWS", 2)
    monkeypatch.setattr(dense, "HELD_QUERIES", 3)
    monkeypatch.setattr(dense, "SALT_BLOCKS", 2)
    monkeypatch.setattr(dense, "BROADCAST_BYTES", bound)
    rows = spark.createDataFrame([("paper", str(n), str(n), [float(n), 1.0]) for n in range(6)], "kind string, entity_id string, paper_id string, vector array<float>")
    queries = spark.createDataFrame([(f"q{n}", [float(n), 1.0], None) for n in range(5)], "query_id string, vector array<float>, scope string")
    got = dense.search_dense(rows, queries, 1).collect()
    assert {r["query_id"]: r["entity_id"] for r in got} == {f"q{n}": str(n) for n in range(5)}


def test_dense_plan_is_the_same_for_any_number_of_queries(spark):
    rows = spark.createDataFrame([("paper", str(n), str(n), [float(n), 1.0]) for n in range(50)], "kind string, entity_id string, paper_id string, vector array<float>")

    def planned(count):
        queries = spark.range(count).select(F.col("id").cast("string").alias("query_id"), F.array(F.sin("id"), F.cos("id")).alias("vector"), F.lit(None).cast("string").alias("scope"))
        found = dense.search_dense(rows, queries, 3)
        assert found.count() == 3 * count
        return found._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert planned(10) == planned(100_000)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    row = df.select(vx.normalized(F.col("a")), vx.cosine(F.col("a"), F.col("b")), vx.cosine(F.col("a"), F.col("z"))).head()
    assert [round(x, 6) for x in row[0]] == [0.6, 0.8] and round(row[1], 9) == 1.0 and row[2] == 0.0
    for bad in ("z",):
        with pytest.raises(Exception, match="zero-length"):
            df.select(vx.normalized(F.col(bad))).collect()
    with pytest.raises(Exception, match="float32 blob"):
        spark.createDataFrame([(b"abc", 1)], "b binary, n int").select(vx.decode_float32("b", "n")).collect()


def test_hash_embedding_features(spark):
    import hashlib

    tokens = ["a", "b", "a"]
    want = np.zeros(32)
    for feature, count, weight in (("word:a", 2, 1.0), ("word:b", 1, 1.0), ("bigram:a\x1fb", 1, 0.55), ("bigram:b\x1fa", 1, 0.55)):
        digest = hashlib.blake2b(feature.encode(), digest_size=16, person=vx.HASH_TAG).digest()
        want[int.from_bytes(digest[:8], "little") % 32] += (1 if digest[8] & 1 else -1) * weight * (1 + math.log(count))
    got = spark.createDataFrame([("A b a",)], "t string").select(vx.hash_embedding(32)(tx.feature_tokens(F.col("t")))).head()[0]
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-6)
    assert list(vx.hash_vector([], 8)) == [0.0] * 8


def test_embed_parts_equals_joined_text(spark):
    from lectern.plans.index import embed_parts

    texts = ["one two", "", "two three", "one two"]
    rows = [("p", (n // 2, n % 2, ""), t) for n, t in enumerate(texts)]
    parts = spark.createDataFrame(rows, "paper_id string, place struct<part:int,n:int,id:string>, text string")
    got = embed_parts(parts, 64).head()["vector"]
    assert np.allclose(got, vx.hash_vector(" ".join(texts).split(), 64), atol=1e-6)


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id string, list_no int, weight double, rank int, key string, text string, routing_note string")


def test_fusion_scores_order_and_notes(spark):
    df = lists(spark, [("q", 0, 1.0, 1, "a", "A", None), ("q", 0, 1.0, 2, "b", "B", None), ("q", 1, 1.0, 1, "b", "B", "note"), ("q", 1, 1.0, 2, "c", "C", None)])
    rows = fusion.reciprocal_rank_fusion(df, 60).orderBy(F.desc("score"), "first_seen").collect()
    assert [r["key"] for r in rows] == ["b", "a", "c"]
    assert rows[0]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-12) and rows[0]["routing_note"] == "note"
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(df, 0)


def test_text_merge(spark):
    df = lists(spark, [("q", 0, 1.0, 1, "a", "start", None), ("q", 1, 1.0, 1, "a", "start and more", None), ("q", 2, 1.0, 1, "a", "more", None), ("q", 3, 1.0, 1, "a", "else", None)])
    assert fusion.merge_texts(df).head()["text"] == "start\n\nand more\n\nelse"


def test_duplicate_places_keep_their_rank(spark):
    df = spark.createDataFrame([("q", 0, 1, "a"), ("q", 0, 2, "a"), ("q", 0, 3, "b")], "query_id string, list_no int, place int, key string")
    assert {r["key"]: r["rank"] for r in fusion.rank_lists(df).collect()} == {"a": 1, "b": 3}


def test_diversify(spark):
    df = spark.createDataFrame([("q", "a", "p1", 3.0), ("q", "b", "p1", 2.0), ("q", "c", "p2", 1.0), ("q", "n", None, 0.5)], "query_id string, key string, paper_id string, score double")
    assert [r["key"] for r in fusion.diversify(df, 3, 1).orderBy("rank").collect()] == ["a", "c", "n"]


def test_snippet_and_math(spark):
    text = " ".join(f"w{n}" for n in range(300)) + " needle here " + " ".join(f"v{n}" for n in range(198))
    df = spark.createDataFrame([(text, "needle here"), ("short  text", "x")], "t string, q string")
    long, short = [r[0] for r in df.select(fusion.snippet(F.col("t"), F.col("q"), 100)).collect()]
    assert "needle here" in long and len(long.split()) <= 102 and long.startswith("… ") and long.endswith(" …")
    assert short == "short  text"
    assert spark.createDataFrame([("G¹ and G^1, c {1} C^{2}  C 3",)], "t string").select(tx.normalize_math(F.col("t"))).head()[0] == "G1 and G1, c {1} C2} C3"


def test_lexical_f1(spark):
    pool = spark.createDataFrame([("q", "a", "the cat sat"), ("q", "b", "dog"), ("q", "c", "")], "query_id string, key string, text string").withColumn("routing_note", F.lit(None).cast("string"))
    queries = spark.createDataFrame([("q", "cat sat sat")], "query_id string, text string")
    got = {r["key"]: r["rerank_score"] for r in fusion.lexical_f1(pool, queries, F.col("text")).collect()}
    assert got["a"] == pytest.approx(2 / 3) and got["b"] == 0.0 and got["c"] == 0.0


def test_note_routing_by_blocks(spark):
    hits = spark.createDataFrame([("q", 0, 1, "n1", "curated:n1", 2.0), ("q", 0, 2, "n2", "curated:n2", 1.0), ("q", 0, 3, "n3", "curated:n3", 0.5)],
                                 "query_id string, list_no int, rank int, entity_id string, key string, score double")
    links = spark.createDataFrame([("n1", f"p{n:03d}", n // 10) for n in range(30)] + [("n2", "p005", 0), ("n2", "q1", 9)], "entry_id string, paper_id string, block int")
    texts = spark.createDataFrame([(f"n{n}", "H", f" note {n} ") for n in (1, 2, 3)], "entry_id string, heading_path string, text string")
    loose, routed = notes.route_notes(hits, links, texts)
    assert [(r["entity_id"], r["rank"]) for r in loose.collect()] == [("n3", 1)]
    rows = routed.orderBy("rank").collect()
    assert [r["entity_id"] for r in rows] == [f"p{n:03d}" for n in range(30)] + ["q1"]
    assert rows[5]["routing_note"] == "note 1" and [r["rank"] for r in rows] == list(range(1, 32))


def test_shared_notes(spark):
    links = spark.createDataFrame([("e1", "a"), ("e1", "b"), ("e2", "a"), ("e2", "c"), ("e3", "a"), ("e3", "c")], "entry_id string, paper_id string")
    asked = spark.createDataFrame([("q", "a")], "query_id string, paper_id string")
    assert [(r["paper_id"], r["shared"]) for r in notes.shared_note_papers(asked, links, 5).orderBy("rank").collect()] == [("c", 2), ("b", 1)]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "other", 1), ("q", "r1", 2), ("q", "r2", 3)], "query_id string, paper_id string, rank int")
    relevant = spark.createDataFrame([("q", "r1"), ("q", "r2")], "query_id string, paper_id string")
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    rows = {r["query_id"]: r for r in evaluation.query_metrics(ranked, relevant, queries).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert rows["q"]["recall_at_5"] == 1.0 and rows["q"]["mrr"] == 0.5
    assert rows["q"]["ndcg_at_10"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / ideal)
    assert rows["none"]["mrr"] == 0.0
