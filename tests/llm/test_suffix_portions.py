"""Tasks of op5 hand on their rows in portions of bounded size, and nothing changes by it."""

import numpy as np
import pandas as pd
import zstandard

from regimecast.llm import suffixes


def test_runs_come_in_portions():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 3000))) for _ in range(1500)]
    frame = pd.DataFrame({"doc_id": range(1500), "th": range(1500), "text": texts})
    parts = list(suffixes._runs(iter([frame, frame.head(0)])))
    assert len(parts) > 1 and max(map(len, parts)) < 100_000
    whole = pd.concat(parts)
    for i in (0, 700, 1499):
        own = whole[whole["doc_id"] == i]
        for name, expected in zip(("lo", "hi", "h", "ch"), suffixes.runs(texts[i].encode())):
            assert own[name].tolist() == expected.tolist()


def test_null_texts_and_one_long_text_keep_their_rows():
    frame = pd.DataFrame({"doc_id": pd.array([None, 2, 3], "Int64"), "th": [0, 1, 2], "text": [None, "ab" * 1_500_000, "cd" * 150]})
    parts = pd.concat(suffixes._runs(iter([frame])))
    assert set(parts["doc_id"]) == {2, 3}
    assert parts[parts["doc_id"] == 2]["hi"].max() == 3_000_000 - suffixes.LENGTH


def test_contexts_come_in_portions():
    text = bytes(range(256)) * 400
    packed = zstandard.ZstdCompressor().compress(text)
    at = list(range(0, 100_000, 250))
    row = {"packed": packed, "lo": at, "hi": [a + 60 for a in at], "h": at, "ch": at, "n": [1] * len(at)}
    parts = list(suffixes._contexts(iter([pd.DataFrame([row] * 100)])))
    assert len(parts) > 1
    assert max(p["data"].map(len).sum() for p in parts) < suffixes._YIELD + 260
    whole = pd.concat(parts)
    assert len(whole) == 100 * len(at)
    assert (whole["data"] == [text[a : a + 260] for a in whole["h"]]).all()
