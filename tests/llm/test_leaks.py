"""Benchmark windows against brute force, offsets, blocks and edge cases."""

import hashlib

from regimecast.llm import decontaminate as D
from regimecast.llm.common import alnum_words
from tests.llm.helpers import edge_rows, frame, prose


def brute(text, items, window=10):
    words, hit, found = alnum_words(text), set(), set()
    for item, body in items:
        own = alnum_words(body)
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if size else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


ITEMS = [(3, prose(100, 25)), (11, prose(101, 6)), (2, prose(100, 25).upper()), (5, None), (6, "?!"), (7, "Zebra")]


def docs(spark):
    inside = "Intro, words. " + prose(100, 25).replace(" ", ", ") + " end. " + prose(101, 6) + " zebra-zebra"
    part = " ".join(prose(100, 25).split()[3:14])
    edges = [r for r in edge_rows() if len(r[1] or "") < 100_000]
    return frame(spark, [(100, inside, "en", "a"), (101, part, "en", "a"), (102, prose(102, 300), "en", "a"), *edges])


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id bigint, text string")


def check(spark):
    rows = docs(spark)
    got = sorted((tuple(r)[:6] for r in D.op2_decontaminate(rows, bench(spark)).collect()), key=repr)
    items = [(i, t) for i, t in ITEMS if t]
    want = sorted(((r["doc_id"], *brute(r["text"], items)) for r in rows.collect()), key=repr)
    assert got == want
    assert any(r[5] for r in got)


def test_brute_force(spark):
    check(spark)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    check(spark)


def test_offsets_and_cut(spark):
    text = "Ähm -- " + prose(101, 6).replace(" ", " ;; ") + " -- tail"
    row = D.cut(D.find_leaks(frame(spark, [(1, text, None, None)]), bench(spark))).first()
    assert row["text"] == "Ähm --  -- tail"
    assert [tuple(s) for s in row["spans"]] == [(1, 7)]
    assert row["items"] == ["11"]


def test_no_items_and_clashing_columns(spark):
    rows = docs(spark).selectExpr("*", "1 AS spans", "2 AS `n_words`")
    out = D.find_leaks(rows, bench(spark).limit(0))
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "n_words", "spans", "items"])
    assert all(r["spans"] == [] and r["items"] == [] for r in out.collect())
    assert D.op2_decontaminate(rows.limit(0), bench(spark)).collect() == []
