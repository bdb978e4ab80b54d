import hashlib
import random

import pytest

from quire.llm import repeated_phrases as rp

from .helpers import DOCS, docs_of, odd_docs, words


def brute(rows, window=13):
    """doc_id -> (n_words, kept words) of (doc_id, text) rows."""
    least = {}
    for doc, text in rows:
        if doc is not None:
            w = words(text)
            for i in range(len(w) - window + 1):
                g = tuple(w[i:i + window])
                least[g] = min(doc, least.get(g, doc))
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and least[tuple(w[i:i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("salt_rows", [2, 2000])
def test_matches_brute_force(spark, salt_rows):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(13, 60))] for _ in range(6)]
    texts = []
    for _ in range(120):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            text += p[a:rng.randint(a, len(p))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(text))
    texts += [texts[3]] * 5 + ["the same two " * 20, "the same two " * 15]
    docs = docs_of(spark, texts).repartition(5)
    assert _got(rp.remove_repeats(docs, salt_rows=salt_rows)) == brute(list(enumerate(texts)))


def test_window_that_only_later_documents_share(spark):
    phrase = "a b c d e f g h"                              # the anchor's first document lacks the whole windows
    tail = " ".join(f"t{i}" for i in range(20))
    texts = [f"x y z q r {phrase}", f"{phrase} {tail}", f"k {phrase} {tail}", f"{phrase} {tail} end"]
    assert _got(rp.remove_repeats(docs_of(spark, texts))) == brute(list(enumerate(texts)))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = rp.remove_repeats(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _got(got) == brute(rows)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"]: r["text"] for r in got.collect()}
    assert kept[1] is None and kept[3] == " \t\n\r\x0b\x0c " and kept[7] == ""


def test_empty_table(spark):
    assert rp.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
