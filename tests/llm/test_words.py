"""Word hashes against the words themselves."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import common as C


def same_words(texts):
    """Hashes are equal where words are, and there are as many."""
    known, found = {}, C.hash_words(texts)
    assert len(found) == len(texts)
    for text, h in zip(texts, found, strict=True):
        ws = C.words(text)
        assert len(ws) == len(h)
        for w, x in zip(ws, h.tolist(), strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbB\x00éÉ日 \t\n\r\x0b\x0c\x1c\xa0 "), max_size=40)), max_size=8))
def test_words_of_odd_texts(texts):
    same_words(texts)


def test_words_of_long_texts(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, n)) for n in (0, 1, 50, 5000, 40_000)]
    texts += ["x" * 30_000, " " * 9000 + "a" + "b" * 5000 + " a", "q" * 4096, "p" * 4095 + " r", None, ""] + [c * 60 for c in "abc"]
    same_words(texts)
    whole = C.hash_words(texts)
    monkeypatch.setattr(C, "CHUNK", 4096)
    for a, b in zip(whole, C.hash_words(texts), strict=True):
        assert (a == b).all()


def test_many_words_do_not_collide():
    h = C.word_hashes(" ".join(f"{a}{b}" for a in range(1000) for b in ("x", "y", *range(300))))
    ws = {f"{a}{b}" for a in range(1000) for b in ("x", "y", *range(300))}
    assert len(np.unique(h)) == len(ws)
