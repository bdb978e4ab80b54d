import hashlib
import random
import re

import pytest

from quire.llm import fill_in_middle as fim

from .helpers import DOCS, docs_of, odd_docs

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc, text):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    if doc is None:
        return n, "plain", None, None, text
    digest = hashlib.sha256(f"1:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _check(docs):
    rows = fim.restore(fim.fill_in_middle(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"]), r["doc_id"]
        assert r["restored"] == (r["text"] or "")
    return rows


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_matches_brute_force(spark, monkeypatch, block):
    rng = random.Random(3)
    pieces = ["word", "ab", "é", "ç", "中文", "\U0001f600", " ", "\n", "1", "<", ">", "<P", "S>", "<<S", "M>", "A", "z\x00y", "é́"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["has <P> in it", "<M>", "x<S>", "a", "é", "\U0001f600"] * 10
    monkeypatch.setattr(fim, "BLOCK", block)
    rows = [(i, t) for i, t in enumerate(texts)]
    import pyarrow as pa
    hashes = [[int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for i, _ in rows] for k in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(texts, pa.string()), *[pa.array(h, pa.int64()) for h in hashes]],
                                       names=["doc_id", "text", "_h1", "_h2", "_h3", "_h4"])
    made = fim._transform(batch)
    back = fim._restore(made.column("output"), made.column("form")).to_pylist()
    for r, b in zip(made.to_pylist(), back):
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"])
        assert b == r["text"]
    if block > 7:
        got = _check(docs_of(spark, texts).repartition(3))
        assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "'x' as form", "'x' as output", "'x' as n", "'x' as restored")
    rows = _check(docs)
    assert rows[0]["kept"] == "x" and rows[0]["lang"] == "en"
    equal = {(r["n"], r["form"], r["output"]) for r in rows if r["doc_id"] == 7}
    assert len(equal) == 1


def test_empty_table(spark):
    assert fim.restore(fim.fill_in_middle(spark.createDataFrame([], DOCS))).count() == 0
