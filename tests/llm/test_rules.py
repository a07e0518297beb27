"""License scan and quality rules against brute force, with edge cases and plan checks."""

import collections
import math
import random
import re

import numpy as np
import pytest

from regimecast.llm import licenses as C
from regimecast.llm import quality_rules as Q
from tests.llm.helpers import edge_rows, frame, prose

# Licenses.


def license_docs(spark):
    rng = random.Random(2)
    rows = [(100 + i, prose(i, 40), "en", "a") for i in range(8)]
    for i, (_, text) in enumerate(C.TEMPLATES):
        words = text.split()
        rows.append((200 + i, "intro\n\n" + " ".join(words) + "\n \n" + prose(i, 10), "en", "a"))
        fewer = [w for w in words if rng.random() > 0.25]
        rows.append((300 + i, " ".join(fewer).upper(), "en", "b"))
        rows.append((400 + i, text[: len(text) // 2] + "\n\n" + text[len(text) // 2 :], "en", "b"))
    rows.append((500, "MIT License, the mit  license! Apache-License gnu general public license cc by cc-by MITlicense", "en", "a"))
    return frame(spark, [*rows, *[r for r in edge_rows()]])


def brute_license(text):
    words = C.words_of(text or "")
    base = []
    for phrase, label in C.PHRASES:
        own = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    found, share = set(), 0.0
    for block in re.split(r"\n[ \t\r\f]*(?:\n[ \t\r\f]*)+", text or ""):
        held = set(C.words_of(block))
        for _, label, size, need, own in C.template_words(C.TEMPLATES, C.CONTAINMENT):
            if len(held & set(own)) >= need:
                found.add(label)
                share = max(share, len(held & set(own)) / size)
    places = [i for i, _ in base]
    labels = {x for _, x in base}
    return (
        len(words), len(base), min(places, default=None), max(places, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | found)), 1.0 if base else share,
    )


def test_licenses_brute_force(spark):
    docs = license_docs(spark)
    want = sorted(((r["doc_id"], *brute_license(r["text"])) for r in docs.collect()), key=repr)
    got = sorted((tuple(r) for r in C.op6_license_scan(docs).collect()), key=repr)
    assert got == want
    labels = {r[0]: r[6] for r in got}
    assert all(labels[200 + i] for i in range(len(C.TEMPLATES)))
    assert any(labels[300 + i] == "" for i in range(8)) or any(labels[300 + i] for i in range(8))
    assert C.op6_license_scan(docs.limit(0)).collect() == []


def test_license_scan_stays_native(spark):
    plan = C.op6_license_scan(license_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_no_templates(spark):
    rows = C.scan(license_docs(spark), templates=()).collect()
    assert all(r["found"] == [] and r["share"] == 0 for r in rows)
    with pytest.raises(ValueError):
        C.template_words([("x", " ".join(map(str, range(C.MAX_WORDS + 1))))], 0.8)


# Quality rules.


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(inside)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def quality_docs(spark):
    rows = [(1000 + i, prose(i, 60 + i % 50, 3), "en", "a") for i in range(120)]
    rows += [(2000 + i, prose(i, 80) + " ### $$$ |||" * 40 + f" {i}", "en", "a") for i in range(6)]
    rows += [(3000 + i, ("word " * 40) + prose(i, 10), "en", "a") for i in range(3)]
    rows += [(4000 + i, prose(i, 30) + "\n" + "\n".join(["a b c d e f"] * 3), "de", f"s{i}") for i in range(5)]
    return frame(spark, [*rows, *edge_rows()])


def test_counts_brute_force(spark):
    docs = quality_docs(spark)
    want = sorted(((r["doc_id"], *brute_counts(r["text"])) for r in docs.collect()), key=repr)
    out = Q.judge(docs.selectExpr("*", "1 AS kept", "2 AS n_words"))
    got = out.collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == want
    verdicts = {r["doc_id"]: r["kept"] for r in got}
    assert all(not verdicts[2000 + i] and not verdicts[3000 + i] for i in range(3))
    assert all(verdicts[1000 + i] for i in range(120))
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert Q.op7_quality_rules(docs.limit(0)).collect() == []


def test_c_steps_match_numpy(spark):
    """Centre, covariance and determinant after the C-steps, recomputed from the starting medians."""
    rng = np.random.default_rng(3)
    x = np.round(rng.multivariate_normal([0, 0, 0, 0], np.diag([4e4, 9e6, 1e4, 1e5]), 300) + 500)
    x[:40] += 9000
    names = list(Q.STATISTICS)
    rows = [(1, *map(float, r)) for r in x]
    table = spark.createDataFrame(rows, "g int, " + ", ".join(f"{n} double" for n in names))
    got = Q.minimum_covariance(table, names).first()
    floor = np.array([Q.STATISTICS[n] for n in names], float)
    low = lambda v: np.sort(v)[math.ceil(0.5 * len(v)) - 1]
    centre = np.array([low(x[:, i]) for i in range(4)])
    spread = np.array([max(1.4826 * low(np.abs(x[:, i] - centre[i])), floor[i]) for i in range(4)])
    cov, before = np.diag(spread**2), None
    for _ in range(Q.STEPS):
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        bins = np.floor(np.log2(1 + d) * Q._BINS)
        inner = x[bins <= np.sort(bins)[math.ceil(Q.SHARE * len(x)) - 1]]
        centre, cov = inner.mean(axis=0), np.cov(inner.T, bias=True) + np.diag(floor**2)
        now = np.linalg.slogdet(cov)[1]
        if before is not None and abs(now - before) < 1e-6:
            break
        before = now
    assert np.allclose([got[f"m{i}"] for i in range(4)], centre)
    lower = np.array([[got[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert np.allclose(lower @ lower.T, cov, rtol=1e-6)
    assert abs(got["logdet"] - now) < 1e-6


def test_chi_square():
    assert abs(Q.chi2_quantile(0.95, 4) - 9.487729) < 1e-5
    assert abs(Q._even_chi2(12.591587, 6) - 0.95) < 1e-6


def test_quality_rules_stay_native(spark):
    plan = Q.op7_quality_rules(quality_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
