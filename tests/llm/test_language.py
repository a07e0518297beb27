"""Language profiles: accuracy on held-out rows, edge cases, and the sums behind the profiles."""

import numpy as np
import pytest

from regimecast.llm import catalog, langid
from regimecast.llm.common import read
from tests.conftest import SMALL
from tests.llm.helpers import edge_rows, frame


def test_held_out_accuracy(spark):
    out = catalog.QUERIES["op1_language_id"](spark, SMALL)
    truth = read(spark, SMALL, "documents").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 20
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_profiles_do_not_depend_on_partitions(spark):
    docs = read(spark, SMALL, "documents")
    one = langid.LanguageProfiles.fit(docs.coalesce(1))
    many = langid.LanguageProfiles.fit(docs.repartition(7, "doc_id"))
    assert one.labels == many.labels
    assert np.array_equal(one.vectors, many.vectors)


def test_profile_is_the_sum_of_its_trigrams(spark):
    docs = frame(spark, [(1, "abc", "en", None), (2, "Abd!", "en", None)])
    got = langid.LanguageProfiles.fit(docs).vectors[0]
    a, b, c = langid._letter_vectors(langid.DIMENSIONS)
    want = np.zeros(langid.DIMENSIONS)
    for word in ("abc", "abd"):
        s = [0, *[ord(x) - 96 for x in word], 0]
        for x, y, z in zip(s, s[1:], s[2:]):
            want += a[x].astype(int) * b[y] * c[z]
    assert np.array_equal(got, want)


def test_edges_and_clashing_columns(spark):
    docs = frame(spark, edge_rows()).selectExpr("*", "'mine' AS score", "1 AS _fields")
    profiles = langid.LanguageProfiles.fit(docs)
    out = profiles.predict(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_fields", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or r["score"] == 0


def test_nothing_learned_and_empty_table(spark):
    docs = frame(spark, [(1, "abc", None, None)])
    assert [r["lang_pred"] for r in langid.LanguageProfiles.fit(docs).predict(docs).collect()] == ["und"]
    assert langid.op1_language_id(docs.limit(0)).collect() == []


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.LanguageProfiles.fit(frame(spark, [(i, "abc", f"l{i}", None) for i in range(4)]))
