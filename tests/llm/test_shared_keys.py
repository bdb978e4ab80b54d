import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from quire.llm import components, shared_keys


def _rows(batches):
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


def test_runs_across_batches_name_the_first_and_salt_the_others():
    rng = random.Random(5)
    keys = defaultdict(set)
    parts = []
    for part in range(6):                                   # six map batches, disjoint documents
        pairs = [(rng.randint(0, 30), part * 100 + rng.randint(0, 99)) for _ in range(200)]
        for k, d in pairs:
            keys[k].add(d)
        parts.append(shared_keys.combine(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])))
    keys[99] = {7}                                          # a key of one document
    parts.append(shared_keys.combine(np.array([99]), np.array([7])))
    table = pa.Table.from_batches(parts).sort_by([("key", "ascending"), ("first", "ascending")])
    for size in (1, 3, 50, 10_000):                         # however the run is cut into batches
        got = defaultdict(dict)
        for doc, key, first, salt in _rows(shared_keys._runs(iter(table.to_batches(max_chunksize=size)), 10)):
            assert first == min(keys[key]) and doc not in got[key]
            got[key][doc] = salt
        assert {k: set(v) for k, v in got.items()} == {k: v for k, v in keys.items() if len(v) > 1}
        for k, salts in got.items():
            others = [s for d, s in salts.items() if d != min(keys[k])]
            assert salts[min(keys[k])] == -(-len(others) // 10)
            assert sorted(set(others)) == list(range(max(others) + 1)) and max(map(others.count, others)) <= 10


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 100, 3, 1000, 0)] + [None]})
    got = [r for b in shared_keys.slices(iter([batch]), max_bytes=50) for r in b.column("text").to_pylist()]
    assert got == batch.column("text").to_pylist()


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000, x) for x in range(1001, 1200)] + [(5, 5)]
    edges += [(2000 + i, 2001 + i) for i in range(40)]      # a chain
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
