"""Token shards and forced-boundary encoding against the library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from regimecast.llm import bpe, tokens
from regimecast.session import scratch_path
from tests.llm.helpers import edge_rows, frame, prose

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def odd_texts():
    rng = random.Random(3)
    chars = list(" \n\t\r  .,'!?-_()<|>sStTaAbBzZ09é̈中ΣİǄ\U0001f600́\x1c\x00​")
    noise = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return [*noise, "a<|endoftext|>b c <|endoftext|> d", "<|startoftext|>x <|endoftext|>", "  a   b \n c\n\n d ", " ", "\n\n \n", prose(1, 500)]


def test_cached_encoder_is_the_library():
    tool, library = tokens.CachedEncoder(tokens.vocabulary_of(BYTES)), Tokenizer.from_file(BYTES)
    for t in odd_texts():
        assert np.frombuffer(tool.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_forced_boundaries_are_the_library(path):
    tool, library = bpe.ForcedBoundaryBpe(tokens.vocabulary_of(path)), Tokenizer.from_file(path)
    for t in odd_texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert tool.encode(t) == ids
        assert tool.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_fragments_join_to_the_word():
    tool = bpe.ForcedBoundaryBpe(tokens.vocabulary_of(WORDS))
    word = "xqzjthequickvvkw"
    assert "".join(tool.cut(word)) == word and len(tool.cut(word)) > 1
    assert all(a[-1] + b[0] not in tool.joined for a, b in zip(tool.cut(word), tool.cut(word)[1:]))


def test_shards(spark):
    docs, library = frame(spark, edge_rows()), Tokenizer.from_file(BYTES)
    got = tokens.op8_token_binary(docs).collect()
    order = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for doc_id, text, *_ in order:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert tokens.op8_token_binary(docs.limit(0)).collect() == []


def test_shards_by_document_and_dictionary(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_BYTES", 2000)
    rows = [(i, prose(i, 80), "en", "a") for i in range(300)]
    path = scratch_path(spark, "tokens-test")
    tokens.write_tokens(frame(spark, rows).select("doc_id", "text"), tokens.vocabulary_of(BYTES), path)
    library = Tokenizer.from_file(BYTES)
    assert tokens.read_document(spark, path, 17) == [library.encode(rows[17][1], add_special_tokens=False).ids + [2]]
    assert tokens.read_document(spark, path, 1000) == []
    shards = spark.read.parquet(f"{path}/shards").collect()
    dictionary = tokens.read_dictionary(spark, path)
    assert len(shards) > 8 and dictionary
    assert {r["dict_sha256"] for r in shards} == {hashlib.sha256(dictionary).hexdigest()}
    with pytest.raises(ValueError):
        tokens.decompressor(b"other", shards[0]["dict_sha256"])
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in tokens.read_tokens(spark, path).collect())
    assert [s[2] for s in starts] == list(range(300))
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:]))


def test_bpe_frames(spark):
    docs, library = frame(spark, edge_rows()).selectExpr("*", "1 AS n_tokens", "2 AS _fields"), Tokenizer.from_file(WORDS)
    out = bpe.digests(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_fields", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in out.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    both = bpe.decode(bpe.encode(docs.select("text")))
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in both.collect())
    assert bpe.op9_bpe(docs.limit(0)).collect() == []


def test_fragments_of_a_column_are_the_library():
    tool, library = tokens.CachedEncoder(tokens.vocabulary_of(BYTES)), Tokenizer.from_file(BYTES)
    texts = [None, "", *odd_texts(), "one.\nTwo", "\n", "Ó.×.\u00a0x", "don't.'s"]
    got = tool.encode_many(pa.array(texts).slice(1))
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[1:]]
    held = set(tool.held)
    assert {"one", ".", "\n", "Two"} <= held and not any("one." in f for f in held)


def test_caches_stay_within_their_limit(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 40)
    tool, library = bpe.ForcedBoundaryBpe(tokens.vocabulary_of(WORDS)), Tokenizer.from_file(WORDS)
    for i in range(40):
        text = prose(i, 30)
        assert tool.encode(text) == library.encode(text, add_special_tokens=False).ids
        for cache in (tool.chunks, *tool.fragments):
            assert len(cache) + len(cache.older) <= 40


def test_digests_come_in_portions(spark, monkeypatch):
    rows = [(i, prose(i, 300), "en", "a") for i in range(60)]
    docs = frame(spark, rows).coalesce(1)
    want = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    monkeypatch.setattr(tokens, "PIECE_BYTES", 2000)
    batch = next(iter(pa.table({"text": [r[1] for r in rows]}).to_batches()))
    assert len(list(tokens.pieces(batch, 0))) > 10
    got = bpe.digests(docs, with_ids=True, with_text=False)
    assert "text" not in got.columns
    for r in got.collect():
        assert len(r["ids"]) == r["n_tokens"] and r["ids_sha256"] == want[r["doc_id"]]["ids_sha256"]
