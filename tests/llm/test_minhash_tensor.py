import random

import numpy as np
import pyarrow as pa

from quire.llm import minhash_tensor as mt

from .helpers import DOCS, docs_of, odd_docs, words


def shingles(text, size=2):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute(rows, percent=80, size=2):
    """(doc_id, set size, component) of (doc_id, text) rows with distinct doc_ids."""
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def _got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def _edited(rng, base, share):
    return [f"e{rng.randint(0, 10**6)}" if rng.random() < share else w for w in base]


def test_matches_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(6):                                      # families around the threshold
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(40, 120))]
        texts += [" ".join(_edited(rng, base, rng.choice([0, 0.02, 0.05, 0.06, 0.08, 0.12]))) for _ in range(25)]
    texts += [texts[0].upper(), texts[1], "", "one", "ONE", "a b", "a b c d e f", "a b c d e", "a b c d e f g"]
    rng.shuffle(texts)
    got = mt.near_duplicates(docs_of(spark, texts).repartition(4))
    assert _got(got) == brute(list(enumerate(texts)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_shuffled_id_fetch_gives_the_same(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(_edited(rng, base, 0.07)) for _ in range(30)]
    docs = docs_of(spark, texts)
    assert _got(mt.near_duplicates(docs, broadcast_ids=0)) == _got(mt.near_duplicates(docs)) == brute(list(enumerate(texts)))


def test_prefix_filter_leaves_out_no_link(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(_edited(rng, base, rng.choice([0.03, 0.05, 0.07])) ) for _ in range(40)]
    docs = docs_of(spark, texts)
    members = spark.createDataFrame([(i, len(shingles(t)), i) for i, t in enumerate(texts)], "doc_id bigint, n_shingles bigint, component bigint")
    found = {(r["a"], r["b"]) for r in mt.across(members, docs, 2, 80).collect()}
    sets = [shingles(t) for t in texts]
    linked = {(a, b) for a in range(40) for b in range(a + 1, 40) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked and linked <= found and len(found) < 40 * 39 / 2


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = mt.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    for empty in (1, 2, 3):
        assert (by[empty]["n_shingles"], by[empty]["component_id"], by[empty]["kept"]) == (0, empty, True)
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert [by[k]["component_id"] for k in (6, 7, 8)] == [6, 6, 6] and not by[7]["kept"]
    assert mt.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_tables_need_two_equal_half_keys():
    sets, edges = mt.shingle_sets(pa.array(["a b c d e f", "a b c d e f"]), 2)
    keys = mt.half_keys(sets, edges, 3, 17)
    assert (keys[0] == keys[1]).all()
    blobs = pa.array([k.tobytes() for k in keys])
    assert mt.table_keys(blobs, 17).shape == (2, 136)
    keys[1, 1:] += np.uint64(1)                              # one half key in common: no table
    one = mt.table_keys(pa.array([k.tobytes() for k in keys]), 17)
    assert not set(one[0].tolist()) & set(one[1].tolist())
