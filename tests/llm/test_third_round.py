"""Hard negatives, phrase collocations and subword pieces against brute force and the library."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import hyperplanes, phrases, pieces
from tests.llm.rows import documents, no_documents, odd_documents, odd_rows

LETTERS = " " * 6 + "▁\n\t\r\x00aabbcdeeht.,;:'\"<>/0x12éü日本語ß😀́ا한國-_=+�²½"


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.default_model())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_pieces_are_those_of_the_library(model, library):
    draw, vocabulary = random.Random(3), list(model.ids)
    texts = ["", " ", "   ", "▁", "\n", " a", "a" * 999, " " * 99, "ab" * 500, "=-" * 500, "<s> </s> <0x0A> <unk>"]
    for _ in range(3000):
        texts.append("".join(draw.choice(vocabulary) if draw.random() < 0.3 else draw.choice(LETTERS) for _ in range(draw.choice((1, 3, 8, 20, 60)))))
    for text in texts:
        want = library.encode(text)
        assert np.frombuffer(model.encode(text), np.int32).tolist() == want
        assert "".join(model.split(text.replace("▁", " "))) == text.replace("▁", " ")
        ids = np.array([*want, pieces.END_ID])
        assert model.decode(ids, np.array([0, len(ids)])) == [library.decode(ids.tolist())]


def test_any_ids_decode_as_in_the_library(model, library):
    draw = random.Random(4)
    for _ in range(2000):
        ids = [draw.choice((draw.randrange(32000), draw.randrange(3, 259), draw.randrange(3))) for _ in range(8)]
        assert model.decode(np.array(ids), np.array([0, 8])) == [library.decode(ids)]
    with pytest.raises(ValueError):
        model.decode(np.array([40_000]), np.array([0, 1]))


def test_backtracking_gives_up_longest_pieces(model):
    """The row laid longest first alone is wrong for some words, and the bit field ends all ways through a dead place."""
    words = {w for t in ("".join(random.Random(n).choices("abcdehilnorst", k=9)) for n in range(3000)) for w in [t]}
    greedy_fails = 0
    for word in words:
        at, greedy = 0, []
        while at < len(word):
            size = max(n for n in range(1, 17) if n == 1 or word[at : at + n] in model.ids and at + n <= len(word))
            greedy.append(word[at : at + size])
            at += size
        assert model.split(word) == model.merged(word)
        greedy_fails += greedy != model.merged(word)
    assert greedy_fails > 100


def test_encoding_tables(spark, model, library):
    rows = odd_rows()
    read = pieces.decode(pieces.encode(odd_documents(spark))).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in read) == Counter((r[0], tuple([*library.encode(r[1] or ""), 2])) for r in rows)
    assert Counter((r.doc_id, r.text) for r in read) == Counter((r[0], r[1] or "") for r in rows)
    assert pieces.decode(pieces.encode(no_documents(spark))).count() == 0
    assert pieces.encode(documents(spark, [(1, None)]), end=None).first().ids == []
    assert pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).select("text").distinct().collect() == [("",)]


def phrases_by_hand(rows, minimum, top):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            listed = re.findall("[^ \t]+", piece)
            words[lang] += len(listed)
            for size in range(1, 5):
                counts[lang].update(tuple(listed[i : i + size]) for i in range(len(listed) - size + 1))
    out = []
    for lang, held in counts.items():
        frequent = {p: n for p, n in held.items() if len(p) > 1 and n >= minimum}
        around = Counter()
        for p, n in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around[p[i : i + size]], n)
        scored = []
        for p, a in frequent.items():
            if p in around and 100 * around[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (held[p[:k]] + held[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def chatter(draw, count):
    words = "the of Red house big cat dog. sat, on mat é ß 日本 x; y! new york city".split()
    return [(n, " ".join(draw.choices(words, k=draw.randint(0, 40))), draw.choice(("en", "de", None, "und")), "s") for n in range(count)]


@pytest.mark.parametrize("burst,held,kept", [(4096, 400_000, 400_000), (3, 10, 400_000), (2, 50, 8)])
def test_collocations_by_hand(spark, monkeypatch, burst, held, kept):
    """The same phrases whether containers burst, subtrees leave early or the words are forgotten."""
    monkeypatch.setattr(phrases, "BURST", burst)
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "KEPT_WORDS", kept)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 2000)
    rows = chatter(random.Random(5), 400) + [(900, None, "en", None), (901, "", None, None), (902, " \t\n", "fr", None), (903, "New York\tcity " * 3000, "en", "x")]
    rows += rows[:3]
    found = phrases.collocations(documents(spark, rows), minimum=6, top=40).collect()
    assert sorted(map(tuple, found)) == phrases_by_hand([r[1:3] for r in rows], 6, 40)
    assert any(r.rank == 40 for r in found)


def test_collocations_of_odd_rows(spark):
    assert phrases.collocations(no_documents(spark)).count() == 0
    found = phrases.collocations(odd_documents(spark)).collect()
    assert sorted(map(tuple, found)) == phrases_by_hand([r[1:3] for r in odd_rows()], 30, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    """2,000,000 times a count of 10**16 passes 64 bits."""
    big = 10**16
    held = spark.createDataFrame([("en", "a", big + 3), ("en", "b", big + 1), ("en", "a b", big)], "lang string, phrase string, n long")
    total = held.groupBy("lang").agg(F.sum("n").alias("n"))
    original = phrases.frequent_phrases
    try:
        phrases.frequent_phrases = lambda docs, minimum: (held, total)
        row = phrases.collocations(held).first()
    finally:
        phrases.frequent_phrases = original
    assert (row.score, row.a, row.l, row.r) == (2_000_000 * big // (2 * big + 4), big, big + 3, big + 1)


def negatives_by_hand(rows):
    held = {}
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = math.fmod(label + 1, 10) if vec_id % 7 == 0 else label
        row = (int(label), [math.floor(256 * x) for x in vector])
        held[vec_id] = min(held.get(vec_id, row), row)
    out = []
    for a, (label, v) in held.items():
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, other == label) for b, (other, w) in held.items() if b != a and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted(s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
            out.extend((a, positive, rank, b, -p, -s) for rank, (s, b, _) in enumerate(fits, 1))
    return sorted(out)


def vector_rows(draw, count, size=6):
    middles = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    rows = []
    for n in range(count):
        middle = draw.choice(middles)
        rows.append((n, [x + draw.gauss(0, 0.15) for x in middle], draw.randrange(10)))
    return rows


def mined(spark, rows, **settings):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, score string, shard string")
    return sorted(map(tuple, hyperplanes.hard_negatives(hyperplanes.quantised(table), F.col("vec_id") % 100 == 0, **settings).collect()))


def test_hard_negatives_by_hand(spark):
    draw = random.Random(6)
    rows = vector_rows(draw, 900)
    rows += [(1000 + n, rows[0][1], n % 3) for n in range(150)]  # one vector many times
    rows += [(1200, None, 1), (1201, [1.0] * 6, None), (1300, [1.0, None, 1.0, 1.0, 1.0, 1.0], 2), (1301, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0], 2), (1302, [float("inf")] * 6, 2), (None, [1.0] * 6, 1)]
    rows += [(1400, [0.0] * 6, 3), (1500, [0.5, 0.25], 4), (1501, [0.5, 0.125], 4), (1502, [0.5, 0.2], 5), (-100, [0.3] * 6, 1), (-7, [0.25] * 6, 1)]
    rows += rows[:30] + [(5, [9.0] * 6, 0)]
    want = negatives_by_hand(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, shard_size=100) == want


def test_hard_negatives_of_large_numbers_and_nothing(spark):
    draw = random.Random(7)
    rows = [(n, [draw.uniform(-1, 1) * 2.0**40 for _ in range(3)], n % 2) for n in range(60)]
    want = negatives_by_hand(rows)
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert mined(spark, rows, shard_size=25) == [(*r[:4], clamp(r[4]), clamp(r[5])) for r in want] and want
    assert mined(spark, [(100, [1.0], 1), (1, [1e300], 1), (2, [-1.7e308], 2)]) == []
    assert mined(spark, []) == []


def test_trees_leave_out_subtrees():
    """On clustered rows only some leaves are scored, and the search still equals a scan."""
    draw = np.random.default_rng(8)
    middles = draw.normal(size=(30, 8)) * 2000
    points = np.floor(middles[draw.integers(30, size=6000)] + draw.normal(size=(6000, 8)) * 40)
    tree = hyperplanes.HyperplaneTree(np.arange(6000), draw.integers(4, size=6000), points)
    anchors = tree.points[:50]
    high = np.full((50, 1), 1 << 40)
    scores, places = tree.search(anchors, tree.ids[:50], tree.labels[:50], -high, high, False, 5)
    assert tree.scored < 0.5 * 50 * 6000
    exact = (anchors @ tree.points.T).astype(np.int64)
    for a in range(50):
        order = sorted((-exact[a, b], b) for b in range(6000) if tree.labels[b] != tree.labels[a])[:5]
        assert sorted((-s, p) for s, p in zip(scores[a, 0].tolist(), places[a, 0].tolist())) == order
