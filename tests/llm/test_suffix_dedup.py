import hashlib
import random

import numpy as np
import pytest

from quire.llm import suffix_dedup as sd

from .helpers import DOCS, docs_of, odd_docs


def brute(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, digest) of (doc_id, text) rows."""
    least = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            if doc is not None:
                least[b[i:i + length]] = min(doc, least.get(b[i:i + length], doc))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone, own = bytearray(len(b)), set()
        for i in range(len(b) - length + 1 if doc is not None else 0):
            s = b[i:i + length]
            if least[s] < doc or s in own:
                gone[i:i + length] = b"\1" * length
            own.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()), key=str)


def _corpus(rng):
    vocabulary = ["alpha", "be", "ça", "dé", "x", "lorem ", "中文", "\n", "tail"]
    passages = ["".join(rng.choice(vocabulary) + " " for _ in range(rng.randint(20, 120))) for _ in range(8)]
    texts = []
    for _ in range(100):
        text = ""
        for _ in range(rng.randint(0, 4)):
            text += "".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            text += p[a:rng.randint(a, len(p))]
        texts.append(text)
    near = "".join(rng.choice("abcdefghij klmnop") for _ in range(700))
    for _ in range(40):                                          # copies with edits, many of them shared by later ones only
        at = rng.choice([50, 160, 300, 420, 555, 640])
        texts.append(near[:at] + rng.choice("XYZ") + near[at + 1:] if rng.random() < 0.9 else near)
    texts += [texts[3]] * 5 + ["the same two " * 40, "the same two " * 30, "a" * 950, "a" * 99, "a" * 100, "ab" * 300, "é" * 400]
    return texts


@pytest.mark.parametrize("settings", [{}, {"salt_rows": 3}, {"block": 4000, "bucket": 300}, {"salt_rows": 5, "block": 1500, "bucket": 64}])
def test_matches_brute_force(spark, settings):
    texts = _corpus(random.Random(8))
    docs = docs_of(spark, texts).repartition(5)
    assert _got(sd.remove_repeated_bytes(docs, **settings)) == brute(list(enumerate(texts)))


def test_other_lengths(spark):
    texts = _corpus(random.Random(9))
    docs = docs_of(spark, texts).repartition(3)
    for length, anchor in ((48, 20), (150, 60), (301, 40)):
        assert _got(sd.remove_repeated_bytes(docs, length=length, anchor=anchor)) == brute(list(enumerate(texts)), length)


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(sd, "_PIECE", 257)
    texts = _corpus(random.Random(10))
    for text in texts:
        b = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(b)])
        start, stop, anchor, place, _ = sd._anchors(b, offsets, 100, 40)
        starts = [i for a, z in zip(start, stop) for i in range(a, z)]
        assert starts == list(range(max(0, len(b) - 99)))
        for a, z in zip(start, stop):                            # a chosen piece lies in every string of its run
            assert any(a <= p <= z - 1 + 60 for p in place)


def test_suffix_groups(spark):
    rng = np.random.default_rng(1)
    for alphabet, size in ((2, 3000), (4, 5000), (1, 500)):
        text = rng.integers(97, 97 + alphabet, size, dtype=np.uint8)
        text[size // 2:size // 2 + size // 4] = text[:size // 4]
        padded = np.concatenate([text, np.zeros(2 * sd.PERIOD + 7 * sd._WORD, np.uint8)])
        starts = np.arange(size - 99)
        for bucket in (100, 1 << 19):
            got = {}
            for n, (at, group) in enumerate(sd._repeats(padded, starts, 100, bucket)):
                for a, g in zip(at.tolist(), group.tolist()):
                    got.setdefault((n, g), []).append(a)
            want = {}
            for i in starts.tolist():
                want.setdefault(text[i:i + 100].tobytes(), []).append(i)
            assert sorted(got.values()) == sorted(v for v in want.values() if len(v) > 1)


def test_cover_has_a_step_for_every_pair():
    assert sd._STEP.max() < sd.PERIOD


def test_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "'x' as n_bytes", "'x' as first", "'x' as row")
    docs = docs.unionByName(docs.where("doc_id = 10").selectExpr("* except (text)", "concat('other ', text, text) as text").select(docs.columns))
    got = sd.remove_repeated_bytes(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _got(got) == brute(rows)
    assert {r["row"] for r in got.collect()} == {"x"} and got.columns[:2] == ["doc_id", "text"]


def test_empty_table(spark):
    assert sd.remove_repeated_bytes(spark.createDataFrame([], DOCS)).count() == 0
