"""The pipeline stage by stage against brute force, and its behaviour on odd tables."""

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from regimecast.llm import decontaminate, line_dedup
from tests.llm.helpers import DOCS, edge_rows, frame, prose
from tests.llm.test_leaks import brute
from tests.llm.test_line_runs import brute_runs
from tests.llm.test_near_copies import brute_groups


@pytest.fixture
def folder(spark, tmp_path):
    shared = prose(70, 9, 8)
    rows = [(i + 100, prose(i, 60, 4), "en" if i % 5 else None, "a") for i in range(12)]
    rows += [(i + 200, f"{prose(i + 30, 9, 3)}\n{shared}", "en", "b") for i in range(4)]
    rows += [(300, rows[0][1], "en", "a"), (301, prose(80, 60) + " " + prose(81, 14), "en", "a"), (302, "123 456 --", None, "a")]
    frame(spark, rows + edge_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(81, 14)), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    write = lambda df, n: (df.write.parquet(f"{folder}/{n}"), spark.read.parquet(f"{folder}/{n}"))[1]

    one = write(stage["language_id"](spark, docs, folder), "one")
    want = [r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(map(repr, want)) == sorted(repr(r["doc_id"]) for r in one.collect())

    two = write(stage["line_dedup"](spark, one, folder), "two")
    texts = brute_runs(one.selectExpr("*", "xxhash64(text) AS th").collect())
    expected = sorted(repr((r["doc_id"], texts[(r["doc_id"], r["text"])][2])) for r in one.collect())
    assert expected == sorted(repr((r["doc_id"], r["text"])) for r in two.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    three = write(stage["near_dedup"](spark, two, folder), "three")
    rows = two.collect()
    assert three.count() == len(brute_groups(rows))
    assert {tuple(r) for r in three.collect()} <= {tuple(r) for r in rows}

    four = write(stage["benchmark_decontamination"](spark, three, folder), "four")
    clean = [r["doc_id"] for r in three.collect() if not brute(r["text"], [(1, prose(81, 14))])[4]]
    assert sorted(map(repr, clean)) == sorted(repr(r["doc_id"]) for r in four.collect())
    assert four.count() < three.count()
    assert one.columns == two.columns == three.columns == four.columns == names

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    five = stage["bpe_encoding"](spark, four, folder).collect()
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in four.collect()}
    assert {r["doc_id"]: r["ids"] for r in five} == ids

    assert sorted(r["ids_sha256"] for r in corpus_pipeline.run(spark, folder).collect()) == sorted(r["ids_sha256"] for r in five)


def test_clashing_columns_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS score", "'x' AS spans", "2 AS fp", "3 AS _hash")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns[5:] == ["score", "spans", "fp", "_hash"]
        assert all(tuple(r)[5:] == (1, "x", 2, 3) for r in docs.collect())


def test_empty_table(spark, folder):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == []
        docs = out if "text" in out.columns else docs


def test_stages_call_their_operators():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert callable(decontaminate.find_leaks) and callable(line_dedup.remove_repeated)
