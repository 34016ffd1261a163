"""Words, quality rules, languages, the classifier and license scans."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lectern.llm import classifier, language, licenses, quality
from lectern.llm.words import WordHasher, byte_slices, row_shingles
from tests.llm.rows import documents, no_documents, odd_documents, odd_rows

WORD = re.compile("[^\x20\x09-\x0d]+")
SYLLABLES = {"en": "the ing er on an re th", "de": "der ung sch ein ge ver zu", "fr": "le eau ou de ment ique la", "es": "el cion os ado que mente la"}


def prose(draw, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(words))


def test_words_and_hashes():
    texts = ["a b  a", None, "", "\tb\n", "é a", "x" * 100_000 + " a"]
    hashes, first = WordHasher(block=2)(pa.array(texts))
    assert np.diff(first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert hashes[0] == hashes[2] == hashes[5] == hashes[7] and len(set(hashes.tolist())) == 4
    shifted, _ = WordHasher(lower=True)(pa.array(["B", "b", "Ab"]).slice(1))
    assert shifted[0] == WordHasher()(pa.array(["b"]))[0][0]
    sizes = [len(s) for s in row_shingles(*WordHasher()(pa.array(["a b c d e f", "a b", ""])), 5)]
    assert sizes == [2, 1, 0]
    batch = pa.record_batch({"text": pa.array(["aa", None, "bbbb", "c"])})
    assert [p.num_rows for p in byte_slices(batch, "text", 3)] in ([2, 1, 1], [2, 2], [1, 1, 1, 1]) or sum(p.num_rows for p in byte_slices(batch, "text", 3)) == 4


def base_by_hand(text):
    words = WORD.findall(text or "")
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(runs)
    inside = {i + j for i, r in enumerate(runs) if often[r] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark):
    rows = [r[:4] for r in odd_rows()] + [(20, "a b c a b c d\n x \n x \n\n", "en", "s"), (21, "# $é| a b c d a b c d a b c d", "en", "s")]
    docs = documents(spark, rows)
    found = quality.judge(docs).collect()
    assert len(found) == len(rows)
    want = Counter((r[0], *base_by_hand(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept is False or not r.base_failed
    assert quality.judge(odd_documents(spark)).count() == len(odd_rows())
    assert quality.judge(no_documents(spark)).count() == 0
    kept = quality.good_documents(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns


def test_language_model_is_a_distribution(spark):
    draw = random.Random(1)
    docs = documents(spark, [(i, prose(draw, lang, 80), lang, "s") for i in range(40) for lang in ("en", "de")])
    model = quality.kneser_ney(quality.gram_counts(docs), quality.ORDER)
    arrays = quality.sorted_models(model, quality.ORDER)
    assert set(arrays) == {"en", "de"}
    for context in (b"\x02\x02\x02", b"\x02\x02t", b"the", b"zzz"):
        start = int.from_bytes(context, "big") << 8
        total = np.exp(arrays["en"].log_probabilities(start + np.arange(256))).sum()
        assert abs(total - 1) < 1e-4


def test_large_models_are_joined_with_the_same_result(spark):
    draw = random.Random(2)
    docs = documents(spark, [(i, prose(draw, "en", 60), "en", "s") for i in range(30)] + [(90, prose(draw, "fr", 70), None, "s"), (91, None, "en", "s"), (None, "an odd one", "en", "s")])
    near = {r.doc_id: r.log_sum for r in quality.measured(docs).collect()}
    far = {r.doc_id: r.log_sum for r in quality.measured(docs, model_rows=0).collect()}
    assert near.keys() == far.keys()
    for key, value in near.items():
        assert (value is None) == (far[key] is None) and (value is None or abs(value - far[key]) < 1e-3)


def test_noise_is_rejected_and_clean_text_kept(spark):
    draw = random.Random(3)
    clean = [(i, prose(draw, "en", 300), "en", "s") for i in range(120)]
    noise = [(500 + i, " ".join("".join(draw.choices("qxzj#0198ÆØ", k=9)) for _ in range(300)), "en", "s") for i in range(3)]
    found = {r.doc_id: r.kept for r in quality.judge(documents(spark, clean + noise)).collect()}
    assert all(found[i] for i, *_ in clean) and not any(found[i] for i, *_ in noise)


def test_languages(spark):
    draw = random.Random(4)
    rows = [(i, prose(draw, lang, draw.randint(20, 80)), lang, "s") for i in range(200) for lang in (sorted(SYLLABLES)[i % 4],)]
    odd = [(900, None, "en", "s"), (901, "12 34 ... ²", "en", "s"), (902, "", None, "s"), (None, "the ing", "en", "s"), (0, rows[0][1], rows[0][2], "s")]
    found = language.held_out_languages(documents(spark, rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang, _ in rows}
    import zlib

    for r in found:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95
    assert language.held_out_languages(no_documents(spark)).count() == 0
    assert {r.lang_pred for r in language.held_out_languages(documents(spark, [(1, "abc def", None, "s")])).collect()} == {"und"}
    assert language.held_out_languages(odd_documents(spark)).count() == len(odd_rows())


def test_predictions_ignore_the_language_column(spark):
    draw = random.Random(5)
    rows = [(i, prose(draw, lang, 40), lang, "s") for i in range(80) for lang in (sorted(SYLLABLES)[i % 4],)]
    model = language.fit(documents(spark, rows))
    right = {r.doc_id: r.lang_pred for r in language.identify(documents(spark, rows), model).collect()}
    blank = {r.doc_id: r.lang_pred for r in language.identify(documents(spark, [(i, t, None, None) for i, t, *_ in rows]), model).collect()}
    assert right == blank


def test_classifier(spark):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        text = prose(draw, "en", 60)
        rows.append((i, re.sub(r"(\w+)", r"\1&&&", text) if bad else text))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, None), (1001, ""), (None, "the ing"), (0, rows[0][1])]
    table = spark.createDataFrame([*labels, (None, 1), (77777, 0), (2, None)], "doc_id long, quality int")
    found = classifier.held_out_quality(documents(spark, rows), table).collect()
    assert len(found) == len(rows)
    truth = dict(labels)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    nobody = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.held_out_quality(odd_documents(spark), nobody).collect()} == {0.5}
    assert classifier.held_out_quality(no_documents(spark), nobody).count() == 0


def test_context_vectors_match_a_loop(spark):
    texts = ["the cat the dog", "A!! b", None]
    table = classifier.context_table(documents(spark, list(enumerate(texts))))
    hasher, want = WordHasher(classes=classifier.character_classes()), np.zeros(table.shape)
    for text in texts:
        hashes, _ = hasher(pa.array([text], pa.string()))
        for i, h in enumerate(hashes.tolist()):
            for j, other in enumerate(hashes.tolist()):
                if i != j and abs(i - j) <= classifier.REACH:
                    for at in range(classifier.SPARSE):
                        bits = other >> (8 * at)
                        want[h >> (64 - classifier.BUCKET_BITS), bits % classifier.SIZE] += 1 if bits & 128 else -1
    norm = np.maximum(np.sqrt((want * want).sum(axis=1, keepdims=True)), 1e-12)
    assert np.abs(table - want / norm).max() < 1e-6


def test_licenses(spark):
    draw = random.Random(7)
    names = list(licenses.TEMPLATES)
    rows, want = [], Counter()
    for i in range(120):
        name = names[i % len(names)]
        words = licenses.TEMPLATES[name].split()
        before, after = prose(draw, "en", draw.randint(0, 90)), prose(draw, "fr", draw.randint(0, 40))
        if i % 3 == 0:
            words = [w.upper() for w in words]
        rows.append((i, " ".join([before, *words, after])))
        want[i, name] += 1
    rows += [(200 + i, prose(draw, "en", 200)) for i in range(20)] + [(300, None), (301, ""), (302, "MIT"), (None, licenses.TEMPLATES["MIT-line"])]
    found = licenses.scan(documents(spark, rows)).collect()
    exact = {(r.doc_id, r.license) for r in found}
    assert set(want) <= exact and not any(i >= 200 for i, _ in exact if i is not None) and (None, "MIT-line") in exact
    hasher = WordHasher(lower=True, classes=licenses.token_classes())
    sets = {n: {tuple(w) for w in zip(*(hasher(pa.array([t]))[0].tolist()[k:] for k in range(5)))} for n, t in licenses.TEMPLATES.items()}
    for i, text in rows[:40]:
        have = {tuple(w) for w in zip(*(hasher(pa.array([text]))[0].tolist()[k:] for k in range(5)))}
        assert {n for n, s in sets.items() if len(s & have) >= 0.8 * len(s)} == {n for d, n in exact if d == i}
    half = licenses.TEMPLATES["MIT"].split()
    assert licenses.scan(documents(spark, [(1, " ".join(half[: len(half) // 2]))])).where("license = 'MIT'").count() == 0
    assert licenses.scan(odd_documents(spark)).count() == 0 and licenses.scan(no_documents(spark)).count() == 0
