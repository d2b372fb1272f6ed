import random

import numpy as np
import pytest

from octavo.llm import jaccard
from octavo.llm.shingles import shingle_sets, word_hashes


def brute(rows, width, num):
    """Components of all linked pairs, ids as nodes."""
    sets = list(shingle_sets([t for _, t in rows], width))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if len(sets[i]) and len(sets[j]) and 100 * o >= num * (len(sets[i]) + len(sets[j]) - o):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 1 << 60), doc)
    return {doc: (len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)}


def corpus(seed, n=160):
    """Random documents, copies with few edits, short ones, a shared passage and a large group of near copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of"] * 40
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passage, hot = say(60), say(70)
    docs = []
    for i in range(n):
        kind = i % 5
        if kind == 0 or not docs:
            d = say(rng.randint(1, 90))
        elif kind == 1:
            d = list(rng.choice(docs))
            for _ in range(rng.randint(0, 3)):
                d[rng.randrange(len(d))] = rng.choice(words)
        elif kind == 2:
            d = say(20) + passage + say(rng.randint(10, 40))
        elif kind == 3:
            d = list(hot)
            for _ in range(rng.randint(0, 4)):
                d[rng.randrange(len(d))] = f"new{rng.random()}"
        else:
            d = say(rng.randint(8, 24))
        docs.append(d)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize(("width", "num", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, width, num, seed):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SHORT", 4)
    rows = corpus(seed)
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), width, num)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, width, num)


def test_shuffled_candidate_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = corpus(4, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df).collect()} == want
    assert {r.doc_id for r in jaccard.keep_one(df).collect()} == {d for d, (_, c) in want.items() if d == c}


def test_edge_cases(edge, empty):
    found = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(edge, 3, 90).collect()), key=str)
    got = {d: (n, c) for d, n, c in found}
    assert len(found) == 13 and got[1] == (12, 1) and got[2] == (12, 1)
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (1, 6) and got[7] == (1, 6)
    assert got[8] == (1, 8) and got[9] == (1, 9)
    assert {(n, c) for d, n, c in found if not d} == {(0, None), (12, 1)}
    assert jaccard.jaccard_groups(empty).count() == 0
    kept = jaccard.keep_one(edge, 3, 90)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 8, 9, 10]


def test_ids_that_several_texts_carry(spark):
    """Such rows lose nothing and name no group; their copies elsewhere still are one group."""
    a, b = "a b c d e f g h i j", "k l m n o p q r s t u"
    rows = [(9, a), (9, b), (9, b), (3, b), (5, b), (7, a), (7, a), (8, None), (8, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.named) for r in jaccard.jaccard_groups(df).collect())
    assert found == sorted([(9, 6, 7, False), (9, 7, 3, False), (9, 7, 3, False), (3, 7, 3, True), (5, 7, 3, True), (7, 6, 7, True), (7, 6, 7, True), (8, 0, 8, False), (8, 1, 8, False)])
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(df).collect()), key=str)
    assert kept == sorted([(9, a), (9, b), (3, b), (7, a), (8, None), (8, "x y z")], key=str)


def test_long_sets_part_their_cluster(spark, monkeypatch):
    """Blocks are bounded by shingles, and blocks still find every link."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 60)
    rows = corpus(6, 80)
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, 3, 90)


def test_least_overlap_is_exact():
    for num in (50, 80, 90):
        for a in range(1, 60):
            for b in range(a, 60):
                o = jaccard.least_overlap(a, b, num)
                assert 100 * o >= num * (a + b - o) and (o == 0 or 100 * (o - 1) < num * (a + b - o + 1))


def test_light_keys_meet_exactly_when_sets_link():
    rng = np.random.default_rng(0)
    num, most = 80, 14
    for _ in range(300):
        n = int(rng.integers(1, most))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[int(rng.integers(0, 3)) :], rng.integers(0, 1 << 62, int(rng.integers(0, 3))).astype(np.uint64)]))
        if not 0 < len(b) <= most:
            continue
        o = len(np.intersect1d(a, b))
        keys = [dict(zip(*jaccard.light_keys(x, num, most), strict=True)) for x in (a, b)]
        met = any(keys[0][k] == keys[1][k] == 0 or {keys[0][k], keys[1][k]} == {1, 2} for k in keys[0].keys() & keys[1].keys())
        assert met == (100 * o >= num * (len(a) + len(b) - o))


def test_bins_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (5, 300, 9000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 62, n).astype(np.uint64)]))
        x, y = (np.frombuffer(jaccard.binned(s), dtype=np.uint8).astype(int)[None] for s in (a, b))
        k = min(x.shape[1], y.shape[1])
        assert np.abs(jaccard._folded(x, k) - jaccard._folded(y, k)).sum() <= len(np.setxor1d(a, b))


def test_boundary_follows_cost():
    assert jaccard.boundary({5: 1000}, 90) >= 5
    assert jaccard.boundary({400: 10}, 90) == 0
    assert jaccard.boundary({30: 1000, 5: 1}, 80) < 30


def test_words_do_not_depend_on_pieces():
    block = ("ab  cd\n" * 999 + "x" * 5000 + " é ü\t").encode()
    whole, pieces = word_hashes(block, 1 << 30), word_hashes(block, 777)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
