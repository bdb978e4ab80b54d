import numpy as np
import pyarrow as pa

from quire.llm import wordhash

from .helpers import words


def _spell(texts, w):
    buf, _ = wordhash.utf8(pa.array(texts, pa.string()))
    return [bytes(buf[s:e]).decode() for s, e in zip(w.start, w.end)]


def test_words_are_those_of_the_pattern():
    rng = np.random.default_rng(3)
    letters = list("ab é  \t\n\x0b\x0c\r\x1f\x85,") + ["日本", " "]
    texts = ["".join(rng.choice(letters, size=rng.integers(0, 60))) for _ in range(300)] + [None, ""]
    w = wordhash.words(pa.array(texts, pa.string()))
    assert _spell(texts, w) == [x for t in texts for x in words(t)]
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]


def test_equal_words_have_equal_hashes_across_pieces(monkeypatch):
    texts = ["alpha beta alpha", "beta", "x" * 500 + " alpha"] * 20
    whole = wordhash.words(pa.array(texts))
    monkeypatch.setattr(wordhash, "PIECE", 64)
    small = wordhash.words(pa.array(texts))
    assert (whole.hash == small.hash).all() and (whole.start == small.start).all() and (whole.row == small.row).all()
    spelled = _spell(texts, whole)
    assert len(set(spelled)) == len(set(whole.hash.tolist()))


def test_lower_folds_only_ascii():
    a = wordhash.words(pa.array(["ABC É"]), lower=True).hash
    b = wordhash.words(pa.array(["abc é"]), lower=True).hash
    assert a[0] == b[0] and a[1] != b[1]


def test_windows_stay_within_rows():
    w = wordhash.words(pa.array(["a b c", "b c", "a b c"]))
    at, h = wordhash.windows(w, 2)
    assert w.row[at].tolist() == [0, 0, 1, 2, 2]
    assert h[0] == h[3] and h[1] == h[2] == h[4] and h[0] != h[1]
    assert (wordhash.windows(w, 2, salt=1)[1] != h).all()
