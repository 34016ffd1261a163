"""Best rows of a query in a shard against adding up every posting, and how queries are dealt to parts."""

import numpy as np
import pandas as pd

from lectern.operators import lexical, postings


def _shard(random, size, terms):
    """Posting blocks of one shard, some of a term's in one run lying across each other, and the scores by term."""
    rows, dense = [], {}
    for n in range(terms):
        name, count = f"t{n}", int(random.integers(1, size if n % 5 == 0 else max(2, size // 20)))
        own = np.sort(random.choice(size, count, replace=False))
        tfs, dls = random.integers(1, 9, count), random.integers(5, 60, count)
        whole = np.zeros(size)
        whole[own] = lexical._plain_saturation(tfs.astype(float), dls, 30.0)
        dense[name] = whole
        for part in (own[::2], own[1::2]) if n % 3 == 0 and count > 1 else (own,):
            at = np.searchsorted(own, part)
            rows.append({"term": name, "rows": np.diff(part, prepend=0).astype(np.int32), "tfs": tfs[at].astype(np.int32), "dls": dls[at].astype(np.int32), "max_tf": tfs[at].max(), "min_dl": dls[at].min()})
    return pd.DataFrame(rows), dense


def test_best_rows_equal_all_sums():
    random = np.random.default_rng(5)
    for size in (3, 70, 900):
        held, dense = _shard(random, size, 40)
        most = lexical._plain_saturation(held["max_tf"].to_numpy(float), held["min_dl"].to_numpy(), 30.0)
        by_term = {t: postings._Postings(held, at, float(most[at].max())) for t, at in held.groupby("term").indices.items()}
        for limit in (1, 7, 60, None):
            for inside in (None, np.arange(size) % 3 == 0):
                for _ in range(25):
                    names = random.choice(list(by_term), int(random.integers(1, 30)), replace=False)
                    weights = random.random(len(names)) ** 3 * 8 + 1e-6
                    rows, scores = postings._best_rows([(w, by_term[n]) for n, w in zip(names, weights)], 30.0, size, lexical._plain_saturation, limit, inside)
                    want = sum(w * dense[n] for n, w in zip(names, weights))
                    some = np.flatnonzero(want if inside is None else want * inside)
                    cut = lambda r, s: [(int(r[i]), round(float(s[i]), 9)) for i in np.lexsort((r, -np.round(s, 9)))[:limit]]
                    assert cut(rows, scores) == cut(some, want[some])


def test_blocks_are_sent_to_few_parts():
    """A shard's blocks go out once for each part, so parts must not grow with the queries alone."""
    assert lexical.query_parts(200, 48, 12) == 1
    assert lexical.query_parts(5_128, 8, 12) == 3
    assert lexical.query_parts(51_000, 8, 12) == 6
    assert lexical.query_parts(310_000, 48, 12) == 10


def test_shards_give_ids_for_the_wanted_rows_only(spark):
    """Eight shards with four rows each leave the best two and the rows that tie with the second."""
    found = spark.createDataFrame(
        [("q", "paper", shard, row, float(8 - min(shard, 3)) - row) for shard in range(8) for row in range(4)], "query_id string, kind string, shard int, row_no int, score double"
    )
    held = sorted((r["shard"], r["row_no"], r["score"]) for r in lexical.best_of_all(found, 2).collect())
    assert held == [(0, 0, 8.0), (0, 1, 7.0), (1, 0, 7.0)]
    assert lexical.best_of_all(found, None).count() == 32
