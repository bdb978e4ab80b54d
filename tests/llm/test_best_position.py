import math
import random
import re

import numpy as np
import pytest

from quire.llm import best_position as bp

from .helpers import DOCS, docs_of, odd_docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=50):
    """{(item_id, rank, doc_id, score)} of lists of (id, text)."""
    found = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(1 for _, w in found if w), sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = set()
    for item, query in asked.items():
        scored = []
        for doc, w in found:
            if doc is None or not w:
                continue
            m = 100 - 50 + (50 * len(w) * n_docs) // total
            score = 0
            for x in query & set(w):
                tf = w.count(x)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc))
        out |= {(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)}
    return out


def _got(df):
    rows = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _items(spark, texts):
    return spark.createDataFrame(list(texts), "item_id bigint, text string")


@pytest.mark.parametrize("settings", [{}, {"shard_entries": 150}, {"block_terms": 12}, {"k": 3, "shard_entries": 40}])
def test_matches_brute_force(spark, settings):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(80)] + ["É", "Ça-va", "x1", "中文", "The"]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(vocabulary[min(84, int(rng.expovariate(0.06)))] for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(i, docs[7][1]) for i in range(300, 380)]                       # many ties
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))) for i in range(15)] + [(15, docs[7][1]), (16, "absent words"), (17, "w0 W0 the THE")]
    table = docs_of(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(4)
    assert _got(bp.ranked(table, _items(spark, items), **settings)) == brute(docs, items, settings.get("k", 50))


def test_stops_early_and_at_ties():
    """Strong documents end the search; documents that tie with the k-th best are all looked at."""
    rng = np.random.default_rng(2)
    n = 20_000
    doc = np.repeat(np.arange(n), 3)
    term = np.tile(np.arange(3), n)
    impact = rng.integers(1, 1000, 3 * n)
    impact[:300] += 100_000
    shard = bp.Shard(n, doc, term, impact, 3)
    ids = rng.permutation(n)
    want = np.array([impact[3 * d:3 * d + 3].sum() for d in range(n)])
    top, scores = shard.best(np.arange(3), ids, 20)
    order = np.lexsort((ids, -want))[:20]
    assert sorted(zip(scores, ids[top])) == sorted(zip(want[order], ids[order]))
    assert shard.read < n
    tied = bp.Shard(n, doc, term, np.full(3 * n, 7), 3)
    top, scores = tied.best(np.arange(3), ids, 20)
    assert sorted(ids[top]) == list(range(20)) and set(scores) == {21}


def test_direct_accesses_move_best_positions_ahead_of_the_reading():
    """Two lists with the same documents at the top in other orders: what one list shows is seen in the other."""
    n = 4000
    doc = np.repeat(np.arange(n), 2)
    term = np.tile([0, 1], n)
    first, second = 10_000 - np.arange(n), 10_000 - np.concatenate([np.arange(64)[::-1], np.arange(64, n)])
    shard = bp.Shard(n, doc, term, np.column_stack([first, second]).ravel(), 2)
    top, _ = shard.best(np.arange(2), np.arange(n), 10)
    assert len(top) == 10 and shard.read < 400


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "word1 goes Word2"), (1, "w5"), (2, None), (3, ""), (4, " - "), (None, "two x"), (5, "endoftext ok é")]
    got = bp.ranked(docs, _items(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    ours = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=str)
    assert ours == sorted(brute(rows, items), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = _items(spark, [(1, "a b")])
    assert bp.ranked(none, items).count() == 0
    assert bp.ranked(odd_docs(spark), items.limit(0)).count() == 0
    assert bp.ranked(none, items.limit(0)).count() == 0
