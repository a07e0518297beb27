"""The prefix table against the sentencepiece library."""

import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from regimecast.llm import pieces
from tests.llm.helpers import edge_rows, frame, prose
from tests.llm.test_tokens import odd_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coder():
    return pieces.PrefixBpe(Path(PATH).read_bytes())


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def test_encoding_is_the_library(coder, library):
    rng = random.Random(5)
    held = list(coder.ids)
    texts = odd_texts()
    texts += ["".join(rng.choice("      ab▁t\n") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" " * k + "a" * (k % 2) for k in range(80)]
    texts += ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice(held) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for t in texts:
        ids = library.encode(t)
        assert coder.encode(t) == ids, t
        assert "".join(d for _, _, d in coder.described(t))[1:] == library.decode(ids)


def test_table_holds_the_last_token_of_every_prefix(coder, library):
    for text in ("unbelievable", "theirs中\U0001f9ff中x", "in▁▁▁▁the"):
        table = coder.table(text)
        for n in range(1, len(text) + 1):
            ids = coder.fragment(text[:n])
            assert ids[-1] == (table[n] if table[n] >= 0 else coder.bytes[text[n - 1].encode()[-1]])


def test_seams_are_those_of_the_merges(coder, library):
    rng = random.Random(9)
    held = [i for p, i in coder.ids.items() if len(p) > 1]
    for _ in range(3000):
        a, b = rng.choice(held), rng.choice(held)
        text = coder.pieces[a] + coder.pieces[b]
        parts = [coder.ids[c] for c in text]
        while True:  # plain merges, one at a time
            found = [(coder.order[m], k, m) for k in range(len(parts) - 1) if (m := coder.ids.get(coder.pieces[parts[k]] + coder.pieces[parts[k + 1]])) is not None]
            if not found:
                break
            _, k, m = min(found)
            parts[k : k + 2] = [m]
        assert coder.apart(a, b) == (parts == [a, b])


def test_other_models_are_refused():
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(Path(PATH).read_bytes())
    spec.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.PrefixBpe(spec.SerializeToString())


def test_frames(spark, library):
    docs = frame(spark, [*edge_rows(), (11, "z" * 30_000 + "中" * 5000, "xx", "a")]).selectExpr("*", "1 AS n_tokens", "2 AS _fields")
    out = pieces.digests(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_fields", *pieces.FIELDS]
    got = out.collect()
    assert len(got) == len(edge_rows()) + 1
    for r in got:
        ids = library.encode(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    both = pieces.decode(pieces.encode(docs.select("text")))
    assert all(r["decoded"] == library.decode(library.encode(r["text"] or "")) and r["ids"] == library.encode(r["text"] or "") for r in both.collect())
    assert pieces.op11_sentencepiece(docs.limit(0)).collect() == []


def test_words_are_learned_again_after_the_cache_is_cleared(coder, library, monkeypatch):
    monkeypatch.setattr(pieces, "_CACHE_WORDS", 20)
    text = prose(3, 400)
    assert coder.encode(text) == library.encode(text)
