"""Repeated runs of lines against a brute force that knows no chunks."""

import random
from collections import Counter

from regimecast.llm import line_dedup as L
from tests.llm.helpers import edge_rows, frame, prose


def brute_runs(rows):
    """Every run of two or more lines is looked for, whole, in all that stands before it; equal rows are one document.

    Its lines go, but for those of two neighbouring lines that stand nowhere before and again later.
    """
    earlier, out = [], {}
    counts = Counter(p for text in {(r["doc_id"], r["text"]): r["text"] for r in rows}.values() for _, _, p in L.pairs_of_lines(text))

    def stands(run, lines, until):
        """Whether the run begins in an earlier text or before ``until`` in this one."""
        places = [(other, len(other)) for other in earlier] + [(lines, until)]
        return any(other[i : i + len(run)] == run for other, end in places for i in range(end) if other[i] == run[0])

    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["th"] or 0)):
        key = (r["doc_id"], r["text"])
        if key in out:
            continue
        lines = [] if r["text"] is None else r["text"].split("\n")
        full = [i for i, line in enumerate(lines) if line.encode().strip()]
        gone, stay = set(), set()
        for a in range(len(full)):
            for b in range(a + 1, len(full)):
                if not stands(lines[full[a] : full[b] + 1], lines, full[a]):
                    if b == a + 1 and counts["\n".join(lines[full[a] : full[b] + 1]).encode()] > 1:
                        stay.update(range(full[a], full[b] + 1))
                    break
                gone.update(range(full[a], full[b] + 1))
        gone -= stay
        text = None if r["text"] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[key] = (len(lines), len(gone), text)
        earlier.append(lines)
    return out


def pairs(text):
    """Every two neighbouring lines of a text."""
    return {data for _, _, data in L.pairs_of_lines(text)}


def corpus(spark):
    rng = random.Random(11)
    shared = {n: prose(200 + n, 9, n) for n in range(2, 7)}
    rows = []
    for i in range(60):
        head, tail = prose(300 + i, 8, rng.randrange(1, 5)), prose(400 + i, 8, rng.randrange(1, 5))
        rows.append((i + 100, f"{head}\n{shared[2 + i % 5]}\n{tail}", "en", "a"))
    once = prose(500, 60)
    rows += [(200, f"x\n{once}\ny", "en", "a"), (201, f"z\n\n{once}\n\nw", "en", "a"), (202, "p q\n\nr s\nt", "en", "a"), (203, "u\np q\n\nr s\n\n", "en", "a")]
    rows.append((204, "ab\ncd\nab\ncd\nab\ncd", "en", "a"))
    return frame(spark, rows + edge_rows())


def test_runs_brute_force(spark):
    docs = corpus(spark)
    want = brute_runs(docs.selectExpr("*", "xxhash64(text) AS th").collect())
    out = L.remove_runs(docs.selectExpr("*", "text AS input")).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r["n_lines"], r["n_removed"], r["text"]) == want[(r["doc_id"], r["input"])]
    passages = {r["doc_id"]: r["n_removed"] for r in out if 105 <= (r["doc_id"] or 0) < 160}
    assert all(n == 2 + (d - 100) % 5 for d, n in passages.items())
    removed = {r["doc_id"]: r["n_removed"] for r in out}
    assert (removed[200], removed[201], removed[202], removed[203]) == (0, 0, 0, 3)
    # Nothing is lost: each repeated pair of lines still stands in some text.
    before = Counter(p for text in {(r["doc_id"], r["input"]): r["input"] for r in out}.values() for p in pairs(text))
    after = set().union(*[pairs(r["text"]) for r in out])
    assert {p for p, n in before.items() if n > 1} <= after


def test_a_kept_copy_is_one_whose_lines_stay(spark):
    texts = {1: "alpha\nbeta", 2: "alpha\nbeta\ngamma", 3: "beta\ngamma", 4: "zz\nzz\nzz", 5: "a1\nb1\nc1\nd1", 6: "a1\nb1\nc1\nd1", 7: "zz\nzz"}
    out = {r["doc_id"]: r["text"] for r in L.remove_runs(frame(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert out == {1: "alpha\nbeta", 2: "beta\ngamma", 3: "", 4: "zz\nzz", 5: "a1\nb1\nc1\nd1", 6: "", 7: ""}


def test_query_removes_every_passage(spark):
    removed = {r["doc_id"]: r["n_removed"] for r in L.op4_line_dedup(corpus(spark)).collect()}
    assert all(removed[d] == 2 + (d - 100) % 5 for d in range(105, 160))


def test_chunks_are_cut_by_their_own_lines_and_compared_by_bytes(spark):
    """Cuts inside a passage do not depend on what stands around it, and a hash alone removes nothing."""
    passage = prose(600, 8, 40)
    alone = {data for _, _, whole, data in L.pieces(passage) if whole}
    inside = {data for _, _, whole, data in L.pieces(f"x y\n{passage}\nz") if whole}
    assert len(alone) > 4 and len(alone - inside) <= 2
    pairs = [data for _, _, whole, data in L.pieces(passage) if not whole]
    assert pairs == [data for _, _, data in L.pairs_of_lines(passage)]
    rows = [(1, f"a\n{passage}", "en", "a"), (2, f"{passage}\nb", "en", "a"), (3, "p q\nr s", "en", "a"), (4, "t u\nv w", "en", "a")]

    def one_hash(frames):
        for frame in L._hashed_pieces(frames):
            yield frame.assign(h=b"\0" * 16)

    docs = frame(spark, rows).selectExpr("doc_id", "xxhash64(text) AS th", "text")
    found = docs.mapInPandas(one_hash, "doc_id bigint, th bigint, chunk int, place int, whole boolean, h binary")
    first = found.where("NOT whole").selectExpr("*", "min(struct(doc_id, th, place)) OVER () AS first")
    assert [(r["doc_id"], r["place"]) for r in L._equal(first, docs, False).collect()] == [(1, 0)]
