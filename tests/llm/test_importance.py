"""Resampling against sums feature by feature."""

import hashlib
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from regimecast.llm import importance
from regimecast.llm.common import alnum_words
from tests.llm.helpers import edge_rows, frame, prose


def brute_force(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    def hashed(text):
        words = alnum_words(text)
        runs = [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [crc32(r) % buckets for r in runs]

    own = [(d, *hashed(t)) for d, t, *_ in docs]
    source, wanted = Counter(b for _, _, f in own for b in f), Counter(b for t in target for b in hashed(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * (s + buckets) / ((source[b] + 1.0) * (t + buckets)))) for b in range(buckets)]
    out = []
    for d, n, found in own:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def table():
    rows = [*edge_rows(), *[(100 + k, prose(k % 50, 3 + k % 60), "en", "a") for k in range(300)]]
    return rows, [prose(7, 100), None, "", prose(11, 40)]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (2, 70_000), (1, 65)])
def test_resampling_is_brute_force(spark, longest, buckets):
    rows, target = table()
    docs = frame(spark, rows).selectExpr("*", "1 AS weight", "2 AS n_words", "3 AS buckets").repartition(6)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    found = got(importance.resample(docs, items, longest=longest, buckets=buckets))
    # Of the repeated rows of one id either may come first; they are equal in all columns but the rank.
    want = brute_force(rows, target, longest, buckets)
    assert found == want
    assert sum(r[4] is not None for r in found) == 10 * sum(len(alnum_words(r[1])) >= 20 for r in rows) // 100


def test_planes_give_exact_sums():
    rng = np.random.default_rng(2)
    for buckets, low, high in ((10_000, -9000, 8000), (100, 0, 1), (64, -1, 0), (7, -5, 900), (3, 0, 1)):
        gain = rng.integers(low, high, buckets)
        lens = np.array([0, 1, 5000, 0, 300, 40_000])
        found = np.minimum(rng.integers(0, buckets, lens.sum()), rng.integers(0, buckets, lens.sum()))
        want = [int(gain[found[a:b]].sum()) for a, b in zip(np.cumsum(lens) - lens, np.cumsum(lens))]
        assert importance.BitSliced(gain).sums(found, lens).tolist() == want


def test_many_short_documents_in_one_slice():
    gain = np.arange(-50, 50)
    lens = np.ones(1000, np.int64)
    found = np.arange(1000) % 100
    assert importance.BitSliced(gain).sums(found, lens).tolist() == gain[found].tolist()


def test_empty_tables(spark):
    rows, target = table()
    docs, items = frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string")
    assert got(importance.resample(docs.limit(0), items)) == []
    assert got(importance.resample(docs, items.limit(0))) == brute_force(rows, [])


def test_one_text_in_a_third_of_the_rows(spark):
    rows = [(k, prose(1 if k % 3 == 0 else k, 25), "en", "a") for k in range(900)]
    items = spark.createDataFrame([(prose(1, 30),)], "text string")
    assert got(importance.resample(frame(spark, rows), items)) == brute_force(rows, [prose(1, 30)])
