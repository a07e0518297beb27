"""Line chunks, suffix sort and fingerprints against brute force, with edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from regimecast.llm import line_dedup as L
from regimecast.llm import simhash as S
from regimecast.llm import suffixes as X
from tests.llm.helpers import edge_rows, frame, prose


def corpus(spark, copies=6):
    rng = random.Random(4)
    shared = prose(50, 8, 6)
    rows = [(i + 100, f"{prose(60 + i, 7, 3)}\n{shared}\n{prose(90 + i, 7, 2)}", "en", "a") for i in range(copies)]
    base = prose(40, 300)
    for i in range(5):
        words = base.split()
        words[rng.randrange(300)] = "changed"
        rows.append((i + 200, " ".join(words), "en", "a"))
    rows += [(300, base, "en", "a"), (301, base, "en", "b"), (302, "ab " * 300, "en", "a"), (303, shared + "\n" + shared, "en", "a")]
    return frame(spark, rows + edge_rows())


# Line chunks.


def brute_lines(rows):
    """Earlier equal chunk by (doc_id, hash, place); equal rows are one document."""
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["th"] or 0))
    for r in order:
        key = (r["doc_id"], r["text"])
        if key in out:
            continue
        kept, removed = [], 0
        for a, b, data in L.chunks(r["text"]):
            if b - a >= L.MIN_LINES and data.strip():
                if data in seen:
                    removed += b - a
                    continue
                seen[data] = True
            kept.append(data)
        text = None if r["text"] is None else b"\n".join(kept).decode()
        out[key] = (0 if r["text"] is None else r["text"].count("\n") + 1, removed, text)
    return out


def test_lines_brute_force(spark):
    docs = corpus(spark)
    want = brute_lines(docs.selectExpr("*", "xxhash64(text) AS th").collect())
    out = L.remove_repeated(docs.selectExpr("*", "text AS input", "9 AS n_lines", "7 AS _doc"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "input", "_doc", "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_lines"], r["n_removed"], r["text"]) == want[(r["doc_id"], r["input"])]
    assert sum(r["n_removed"] for r in rows) > 20


def test_chunks_cover_and_resist_shifts():
    shared = prose(51, 6, 60)
    one, two = L.chunks("a\nb\nc\n" + shared), L.chunks("x\n" + shared)
    assert b"\n".join(c[2] for c in one).decode() == "a\nb\nc\n" + shared
    common = {c[2] for c in one} & {c[2] for c in two}
    assert len(common) > 0.7 * len(one)
    assert all(b - a >= L.MIN_LINES for a, b, _ in one[:-1])


def test_lines_empty_table(spark):
    assert L.op4_line_dedup(corpus(spark).limit(0)).collect() == []


# Suffixes.


@pytest.mark.parametrize("length", [40, 200])
def test_deep_shallow_order(length):
    rng = np.random.default_rng(length)
    for n in range(12):
        noise = bytes(rng.integers(97, 99, 300 + 40 * n).astype(np.uint8))
        buffer = noise + b"abcab" * 90 + noise[: 60 * n] + b"abcab" * 80
        starts = rng.permutation(len(buffer) - length + 1)
        order, equal = X.deep_shallow(buffer, starts, length)
        found = [buffer[s : s + length] for s in starts[order]]
        assert sorted(order.tolist()) == list(range(len(starts)))
        assert found == sorted(found)
        assert equal.tolist() == [False] + [a == b for a, b in zip(found, found[1:])]


def brute_bytes(rows, length=X.LENGTH):
    seen, twice = set(), set()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in rows]
    for _, b in texts:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            (twice if s in seen else seen).add(s)
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in twice:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot,piece", [(X.HOT_CONTEXTS, X._PIECE), (1, 700)])
def test_suffixes_brute_force(spark, monkeypatch, hot, piece):
    """The second case takes the way of hot anchors and of texts longer than a piece."""
    monkeypatch.setattr(X, "HOT_CONTEXTS", hot)
    docs = corpus(spark).where("doc_id is null or doc_id <> 5")
    rows = docs.collect()
    if piece != X._PIECE:
        body = rows[0]["text"].encode() * 3
        whole = X.runs(body)
        monkeypatch.setattr(X, "_PIECE", piece)
        cut = X.runs(body)
        cover = lambda r: [p for a, b in zip(r[0], r[1]) for p in range(a, b + 1)]
        assert cover(whole) == cover(cut) == list(range(len(body) - X.LENGTH + 1))
    got = sorted((tuple(r) for r in X.op5_suffix_dedup(docs).collect()), key=repr)
    assert got == brute_bytes(rows)
    assert sum(r[2] for r in got) > 1000


def test_suffixes_with_text_and_empty(spark):
    docs = corpus(spark).where("doc_id between 100 and 103")
    rows = X.remove_repeated(docs).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows)
    assert all(len(r["kept"]) + r["n_removed"] == r["n_bytes"] for r in rows)
    assert X.op5_suffix_dedup(docs.limit(0)).collect() == []


# Fingerprints.


def brute_print(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    pieces = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids, prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    out = {}
    for i, d in enumerate(ids):
        out.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in out.items()}
    return [least[root(i)] for i in range(len(prints))]


def test_fingerprints_brute_force(spark):
    rows = corpus(spark).collect()
    prints = [brute_print(r["text"]) for r in rows]
    want = zip([r["doc_id"] for r in rows], [f"{p:016x}" for p in prints], brute_components([r["doc_id"] for r in rows], prints))
    got = [tuple(r) for r in S.op10_simhash(corpus(spark)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    keys = {(r["doc_id"], r["text"]) for r in S.keep_one(corpus(spark)).collect()}
    assert len(keys) == len(set(brute_components(list(range(len(prints))), prints)))


@pytest.mark.parametrize("hot", [1, 8, S.HOT_BUCKET])
def test_links_lose_none(spark, monkeypatch, hot):
    """Random fingerprints around centres: chains, stars, both halves, the sign bit; a half that all of a group share."""
    monkeypatch.setattr(S, "HOT_BUCKET", hot)
    rng = random.Random(5)
    prints = []
    for _ in range(8):
        centre = rng.getrandbits(64)
        for _ in range(40):
            centre ^= 1 << rng.randrange(64)
            prints.append(centre ^ (1 << 63 if rng.random() < 0.2 else 0))
            prints.append(prints[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    half = rng.getrandbits(32)
    prints += [half << 32 | rng.getrandbits(3) << rng.randrange(28) for _ in range(150)]
    prints += [rng.getrandbits(3) << 40 | half for _ in range(20)] + [0, (1 << 64) - 1, 1 << 63]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    roots = {r["fp"]: r["root"] for r in S.components(table).collect()}
    want = brute_components(list(range(len(prints))), prints)
    groups = {}
    for p, w in zip(signed, want):
        groups.setdefault(w, set()).add(roots[p])
    assert all(len(g) == 1 for g in groups.values())
    assert len(set(roots.values())) == len(groups)
    distinct = sorted(set(signed))
    near = {(u, v) for u in distinct for v in distinct if u > v and ((u ^ v) % (1 << 64)).bit_count() <= 2}
    assert {tuple(r) for r in S.links(table.distinct()).collect()} == near
    # The table has one row for every segment of a fingerprint.
    held = S.segment_rows(table.distinct(), S._itself).collect()
    assert len(held) == S.SEGMENTS * len(distinct)
    assert all((r["fp"] >> (S.SEGMENT_BITS * r["segment"])) % (1 << S.SEGMENT_BITS) == r["value"] for r in held)


def test_fingerprints_empty_table(spark):
    assert S.op10_simhash(corpus(spark).limit(0)).collect() == []
    assert S.keep_one(corpus(spark).limit(0)).collect() == []
