"""Near-duplicates, repeated passages, vectors and components."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lectern.llm import graph, neardup, substrings
from lectern.llm.shared import components
from tests.llm.rows import documents, no_documents, odd_documents, odd_rows


def sentence(draw, words, base=5000):
    return [f"w{draw.randrange(base)}" for _ in range(words)]


def edited(draw, words, share):
    return [f"e{draw.randrange(10**6)}" if draw.random() < share else w for w in words]


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components_by_hand(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    lead = {i: i for i in sets}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                lead[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_against_all_pairs(spark):
    draw = random.Random(11)
    rows, number = [], 0
    for size in (2, 3, 5, 60):
        base = sentence(draw, 120)
        for _ in range(size):
            rows.append((number, " ".join(edited(draw, base, draw.choice((0, 0.01, 0.02, 0.03))))))
            number += 1
    rows += [(number + i, " ".join(sentence(draw, draw.randint(1, 60)))) for i in range(30)]
    rows += [(900, None), (901, "  "), (902, "Two words"), (903, "two  WORDS"), (904, rows[0][1].upper())]
    draw.shuffle(rows)
    want = components_by_hand(rows)
    for block in (1024, 8):
        found = neardup.near_duplicates(documents(spark, rows), block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicate_edges(spark):
    found = neardup.near_duplicates(odd_documents(spark)).collect()
    assert len(found) == len(odd_rows())
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[2].component_id == 1 and not by_id[2].kept and by_id[3].n_shingles == 0 and by_id[4].kept
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    assert neardup.near_duplicates(no_documents(spark)).count() == 0
    left = neardup.without_near_duplicates(odd_documents(spark))
    assert left.columns == odd_documents(spark).columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [-5, 1, 3, 4, 5, 7, 8, 9]
    assert left.where("doc_id is null").count() == 2


def test_pairs_between_80_and_85_in_the_pipeline(spark):
    draw, factors, hasher = random.Random(17), neardup.multipliers(), neardup.WordHasher(lower=True)
    rows, far = [], 0
    while far < 2 or len(rows) < 20:
        base = sentence(draw, 400, 10**6)
        other = list(base)
        for at in draw.sample(range(20, 380), 9):
            other[at] = f"e{draw.randrange(10**6)}"
        pair = [" ".join(base), " ".join(other)]
        a, b = (shingle_set(t) for t in pair)
        if not 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b):
            continue
        one, two = (neardup.signature(x, factors) for x in neardup._sets(pa.array(pair), hasher, 5))
        # Of these pairs, also two that differ in more values than are confirmed at 0.85.
        distant = (one != two).sum() > neardup.MAX_DISTANCE
        if distant and far < 2 or len(rows) < 16:
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
            far += bool(distant)
    docs = documents(spark, rows)
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [i for i, _ in rows if i % 2 == 0]
    assert neardup.without_near_duplicates(docs).count() == len(rows)


def test_few_pairs_of_80_are_missed():
    limit, count = neardup.distance_limit(80), neardup.CHUNKS * neardup.WIDTH
    assert neardup.distance_limit() == neardup.MAX_DISTANCE
    beyond = sum(math.comb(count, k) * 0.2**k * 0.8 ** (count - k) for k in range(limit + 1, count + 1))
    no_chunk = (1 - 0.8**neardup.WIDTH - neardup.WIDTH * 0.2 * 0.8 ** (neardup.WIDTH - 1)) ** neardup.CHUNKS
    assert beyond + no_chunk < 1.2e-5


def test_pigeonhole_of_chunk_keys():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 16, (50, neardup.CHUNKS * neardup.WIDTH)).astype(np.uint16)
    other = base.copy()
    for row in other:
        row[draw.permutation(base.shape[1])[: neardup.MAX_DISTANCE]] ^= 1
    a, b = neardup.chunk_keys(base), neardup.chunk_keys(other)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))
    assert not set(a[0].tolist()) & set(a[1].tolist())


def test_components(spark):
    draw = random.Random(12)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + draw.randrange(50), 1000 + draw.randrange(50)) for _ in range(40)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    lead = {}

    def root(i):
        lead.setdefault(i, i)
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            lead[y] = x
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: root(i) for i in lead}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def best_chain(x, y, size, gap):
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    score = {}
    for i in order:
        score[i] = size + max([0.0, *(score[j] - gap * (x[i] - x[j] + y[i] - y[j]) for j in score if x[j] < x[i] and y[j] < y[i])])
    return max(score.values())


def test_chains_have_the_best_score():
    draw = random.Random(13)
    for _ in range(200):
        n = draw.randint(2, 25)
        x, y = [draw.randrange(60) for _ in range(n)], [draw.randrange(60) for _ in range(n)]
        found = substrings.chain(x, y, 5, 0.05)
        want = best_chain(x, y, 5, 0.05)

        def value(c):
            return 5 * len(c) - 0.05 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(c, c[1:]))

        for c in found:
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:]))
        if want > 5:
            assert abs(value(found[0]) - want) < 1e-9


def test_seed_places_against_windows():
    draw = np.random.default_rng(2)
    for n in (1, 5, 12, 13, 40, 300):
        runs = draw.integers(0, 1 << 40, n).astype(np.uint64)
        want = {int(i + np.argmin(runs[i : i + 12])) for i in range(max(1, n - 11))}
        assert set(substrings.seed_places(runs).tolist()) == want


def test_planted_passages_are_found(spark):
    draw = random.Random(14)
    rows = [(i, sentence(draw, 200)) for i in range(60)]
    planted = {}
    for i in range(0, 40, 2):
        passage = sentence(draw, 52 + i)
        share = (0, 0, 0.05, 0.1)[i // 2 % 4]
        a, b = draw.randrange(150), draw.randrange(150)
        rows[i] = (i, rows[i][1][:a] + passage + rows[i][1][a:])
        rows[i + 1] = (i + 1, rows[i + 1][1][:b] + edited(draw, passage, share) + rows[i + 1][1][b:])
        planted[i, i + 1] = (a, b, len(passage), share)
    common = sentence(draw, 60)
    for i in range(40, 55):
        rows[i] = (i, rows[i][1][:i] + common + rows[i][1][i:])
    rows = [(i, " ".join(w)) for i, w in rows] + [(70, " ".join(rows[3][1])), (71, " ".join(common[:30])), (72, None), (73, ""), (None, " ".join(common))]
    found = substrings.repeated_passages(documents(spark, rows)).collect()
    pairs = {tuple(sorted((r.doc_id, r.other_id))): r for r in found}
    for pair, (a, b, size, share) in planted.items():
        row = pairs[pair]
        if share == 0:
            mine, other = ((a, b) if row.doc_id == pair[0] else (b, a))
            assert (row.first_word, row.n_words, row.other_first, row.equal_words) == (mine, size, other, size)
        assert row.identity >= 0.8
    linked = {i for r in found for i in (r.doc_id, r.other_id) if 40 <= i < 55}
    assert linked == set(range(40, 55))
    assert (3, 70) in pairs and pairs[3, 70].equal_words == len(rows[3][1].split())
    clean = {55, 56, 57, 58, 59, 71, 72, 73}
    assert not clean & {i for r in found for i in (r.doc_id, r.other_id)}


@pytest.mark.parametrize("others", [1, 30])
def test_passages_whose_halves_stand_in_other_texts(spark, others):
    """Two texts meet although every seed of their passage stands in texts that hold only half of it."""
    draw = random.Random(17)
    rows, wanted = [], []
    for n in range(6):
        passage = sentence(draw, 56, 10**6)
        for half in (passage[:28], passage[28:]):
            rows += [[*sentence(draw, 40, 10**6), *half, *sentence(draw, 40, 10**6)] for _ in range(others)]
        wanted.append((len(rows), len(rows) + 1))
        rows += [[*sentence(draw, 40 + s, 10**6), *passage, *sentence(draw, 40, 10**6)] for s in (0, 1)]
    found = substrings.repeated_passages(documents(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])).collect()
    pairs = {tuple(sorted((r.doc_id, r.other_id))): r for r in found}
    assert sorted(pairs) == wanted
    assert all(r.n_words == r.equal_words == 56 for r in found) and len(found) == len(wanted)


def test_passages_with_unequal_words_between(spark):
    draw = random.Random(15)
    rows, want = [], {}
    for n, (first, gap, second) in enumerate([(60, 40, 60), (60, 100, 60), (60, 300, 60), (60, 60, 20), (20, 60, 60), (400, 150, 60), (60, 10, 60)]):
        one, two = sentence(draw, first, 10**6), sentence(draw, second, 10**6)
        for side in (0, 1):
            rows.append((2 * n + side, " ".join([*sentence(draw, 30, 10**6), *one, *sentence(draw, gap + 3 * side, 10**6), *two, *sentence(draw, 30, 10**6)])))
        want[2 * n, 2 * n + 1] = [first + second] if gap < 20 else [k for k in (first, second) if k >= 50]
    found = {}
    for r in substrings.repeated_passages(documents(spark, rows)).collect():
        assert r.identity >= 0.8
        found.setdefault(tuple(sorted((r.doc_id, r.other_id))), []).append((r.first_word, r.equal_words))
    assert {k: [e for _, e in sorted(v)] for k, v in found.items()} == want


def test_parts_against_all_ranges():
    draw = random.Random(16)
    for _ in range(100):
        x, y, equal = [0], [0], [5]
        for _ in range(draw.randint(1, 25)):
            a, b = draw.randint(5, 30), draw.randint(5, 30)
            x.append(x[-1] + a)
            y.append(y[-1] + b)
            equal.append(draw.randint(5, min(a, b)))

        def similar(i, j):
            return 5 + sum(equal[i + 1 : j + 1]) >= 0.8 * (max(x[j] - x[i], y[j] - y[i]) + 5) - 1e-9

        found = substrings.parts(x, y, equal)
        assert [k for i, j in found for k in range(i, j + 1)] == list(range(len(x))) and all(similar(i, j) for i, j in found)
        longest = max(x[j] - x[i] for i in range(len(x)) for j in range(i, len(x)) if similar(i, j))
        assert max(x[j] - x[i] for i, j in found) == longest


def test_passage_edges(spark):
    found = substrings.repeated_passages(odd_documents(spark)).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(2, 1)}
    assert substrings.repeated_passages(no_documents(spark)).count() == 0


def nearest_by_hand(ids, vectors, query, k):
    scores = vectors @ vectors[list(ids).index(query)]
    order = sorted((-s, i) for s, i in zip(scores.tolist(), ids) if i != query)
    return order[:k]


def test_graph_recall(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(1500, 24)).astype(np.float32) * draw.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    vectors[100:400] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 24), (5060, [float("nan")] * 24), (5080, [1.0, None, *[0.0] * 22]), (5100, [1.0, 2.0]), (5120, [2.0, 1.0]), (None, vectors[3].tolist()), (0, vectors[0].tolist())]
    table = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    for shard in (8192, 300):
        found = graph.nearest(table, table["vec_id"] % 20 == 0, 20, shard).collect()
        by_query = {}
        for r in found:
            by_query.setdefault(r.query_id, []).append(r)
        assert set(by_query) == {*range(0, 1500, 20), 5100, 5120}
        assert [(r.vec_id, r.score) for r in by_query[5100]] == [(5120, 4.0)]
        ids, exact, hits = list(range(1500)), vectors.astype(float), []
        for query in range(0, 1500, 20):
            mine = sorted(by_query[query], key=lambda r: r.rank)
            assert [r.rank for r in mine] == list(range(1, 21)) and all(r.vec_id != query for r in mine)
            assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
            best = nearest_by_hand(ids, exact, query, 20)
            hits.append(len({i for _, i in best} & {r.vec_id for r in mine}) / 20)
        assert np.mean(hits) >= 0.95
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert graph.nearest(empty, empty["vec_id"] % 20 == 0).count() == 0


def test_pruning_keeps_diverse_edges():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2]], np.float32)
    kept = graph.robust_prune(points, np.array([0]), [[1, 2, 3]], 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]
