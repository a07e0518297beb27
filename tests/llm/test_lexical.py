"""Ranked search against scores term by term, and the graph of shared sums against the items it stands for."""

import math
import random
from collections import Counter

import numpy as np

from regimecast.llm import lexical
from regimecast.llm.common import alnum_words
from tests.llm.helpers import edge_rows, frame, prose

ITEMS = "item_id string, text string"


def brute_force(docs, items, depth=lexical.DEPTH):
    texts = [(d, alnum_words(t)) for d, t, *_ in docs]
    texts = [(d, w) for d, w in texts if w]
    total, length = len(texts), sum(len(w) for _, w in texts)
    holding = Counter(t for _, w in texts for t in set(w))
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked.setdefault(i, set()).update(alnum_words(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, words in texts:
            m, own, score = 50 + (50 * len(words) * total) // length, Counter(words), 0
            for t in terms:
                if own[t]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * holding[t] + 1)))
                    score += w * ((1_000_000_000 * own[t]) // (1000 * own[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:depth])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items_of(n):
    stem = prose(90, 12)
    return [(f"q{k:03}", f"{stem if k % 3 else prose(91, 5)} {prose(k, 6)}") for k in range(n)]


def test_shared_sums_stand_for_their_items():
    rng = random.Random(1)
    items = [sorted(rng.sample(range(60), rng.randint(1, 30))) for _ in range(40)] + [[1, 2, 3]] * 5
    sums, parts = lexical.share(items, 60)
    assert sums and sum(map(len, parts)) + 2 * len(sums) < sum(map(len, items))

    def terms(p):
        return [p] if p < 60 else terms(sums[p - 60][0]) + terms(sums[p - 60][1])

    for item, own in zip(items, parts):
        assert sorted(t for p in own for t in terms(p)) == item
    assert all(max(pair) < 60 + k for k, pair in enumerate(sums))
    assert lexical.share([], 5) == ([], []) and lexical.share([[3]], 5) == ([], [[3]])


def test_search_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(lexical, "_SLICE", 64)
    rows = [*edge_rows(), *[(100 + k, prose(k % 70, 5 + k % 40, 1 + k % 3), "en", "a") for k in range(400)]]
    items = [*items_of(40), ("none", None), (None, "the of"), ("blank", " .,"), ("odd", "zzzz never there"), ("q001", "extra tion")]
    docs = frame(spark, rows).selectExpr("*", "1 AS item_id", "2 AS score", "3 AS n").repartition(5)
    want = brute_force(rows, items)
    assert len(want) > 1000
    assert got(lexical.search(docs, spark.createDataFrame(items, ITEMS))) == want


def test_batches_of_items(spark, monkeypatch):
    rows = [(k, prose(k, 20), "en", "a") for k in range(60)]
    items = items_of(12)
    whole = brute_force(rows, items, depth=3)
    monkeypatch.setattr(lexical, "BATCH_BYTES", 300)
    assert len(list(lexical.item_batches(spark.createDataFrame(items, ITEMS), "item_id", "text"))) > 2
    assert got(lexical.search(frame(spark, rows), spark.createDataFrame(items, ITEMS), depth=3)) == whole


def test_ties_go_to_the_smaller_id_and_long_texts_count_whole(spark):
    text = "alpha beta"
    rows = [(k, text, "en", "a") for k in range(200, 0, -1)] + [(None, text, "en", "a"), (500, "alpha " + "pad " * 200_000, "en", "a")]
    found = got(lexical.search(frame(spark, rows), spark.createDataFrame([("i", "alpha")], ITEMS)))
    assert sorted(found, key=lambda r: r[1]) == sorted(brute_force(rows, [("i", "alpha")]), key=lambda r: r[1])
    assert [r[2] for r in sorted(found, key=lambda r: r[1])] == list(range(1, 51))


def test_empty_tables(spark):
    docs, items = frame(spark, edge_rows()), spark.createDataFrame(items_of(3), ITEMS)
    assert got(lexical.search(docs.limit(0), items)) == []
    assert got(lexical.search(docs, items.limit(0))) == []


def test_best_of_many_slices():
    rng = np.random.default_rng(4)
    weights = np.array([5, 7], np.int64)
    scorer = lexical.Scorer([([0], [(2, (0, 1))], [[2]])], weights, 1000, 10_000, 10)
    rows = []
    for start in range(0, 1000, 100):
        counts = rng.integers(1, 50, 200)
        ids = np.arange(start, start + 100)
        scorer.add(ids, np.zeros(100, bool), np.full(100, 10), np.full(100, 2), np.tile([0, 1], 100), counts)
        m = 50 + 50 * 10 * 1000 // 10_000
        gain = np.array([5, 7])[np.tile([0, 1], 100)] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))
        rows += list(zip(-gain.reshape(-1, 2).sum(axis=1), ids))
    want = sorted(rows)[:10]
    assert list(zip(*[a.tolist() for a in scorer.best[0][:2]])) == [(-s, i) for s, i in want]
