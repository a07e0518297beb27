"""Words of letters are looked up without the tokenizer's own normaliser, whatever letters up to U+00FF they have."""

import public_tokenizers
from tokenizers import Tokenizer

from regimecast.llm import bpe, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [c for c in map(chr, range(256)) if c.isalpha()]


def test_words_with_marks_need_no_normaliser(monkeypatch):
    """A word and a mark after it are cached by themselves: texts whose words hardly repeat took most of their time there."""
    coder, library = bpe.ForcedBoundaryBpe(tokens.vocabulary_of(WORDS)), Tokenizer.from_file(WORDS)
    for mark in ".,;:!?":
        coder.encode(mark)
    asked = []
    monkeypatch.setattr(coder, "words", lambda text: asked.append(text))
    text = "Größe, Ärger; maße über: ÇEDILLE! naïve? plain. Ende"
    assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert asked == []


def test_letters_and_marks_as_the_library():
    coder, library = bpe.ForcedBoundaryBpe(tokens.vocabulary_of(WORDS)), Tokenizer.from_file(WORDS)
    texts = [a + b for a in LETTERS for b in LETTERS]
    texts += [w + m + n for w in ("a", "é", "Don't", "x1", "İ", "é", "ſ", "中") for m in ".,;:!?'…" for n in ("", ".", "s", "́")]
    text = " ".join(texts)
    assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert all(coder.encode(t) == library.encode(t, add_special_tokens=False).ids for t in texts[::7])
