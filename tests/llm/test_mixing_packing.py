import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import cutting_stock, mixing_es, packing, stages

from ..conftest import SF_SMALL
from .helpers import DOCS, docs_of, labels_of, odd_docs, words


def reshared(sizes, weights, most=3):
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        by = sum(w for i, w in enumerate(weights) if i not in capped)
        out = [most * s if i in capped else left * weights[i] / by for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and out[i] > most * sizes[i] + 1e-9}
        if not over:
            return out
        capped |= over


def test_targets_match_resharing(spark):
    rng = random.Random(1)
    for _ in range(8):
        n = rng.randint(1, 14)
        sizes = [rng.choice([0, 1, 5, 20, 1000, rng.randint(0, 3000)]) for _ in range(n)]
        rows = spark.createDataFrame([(i, f"s{i:02}", s) for i, s in enumerate(sizes)], "doc_id bigint, source string, size bigint")
        got = [r["target"] for r in mixing_es.targets(rows).orderBy("source").collect()]
        assert got == pytest.approx(reshared(sizes, [(5, 2, 1)[i % 3] for i in range(n)]) if sum(sizes) else [0] * n)


@pytest.mark.parametrize("buckets", [3, 4096])
def test_sources_meet_targets_in_key_order(spark, buckets):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.choice([0, 1, 7, 30, 200])) for _ in range(300)]
    sources = [rng.choice(["a", "a", "a", "b", "c", None, "é"]) for _ in texts]
    docs = docs_of(spark, texts, sources=sources)
    rows = {r["doc_id"]: r for r in mixing_es.mix(docs, buckets=buckets).collect()}
    keys = {r["doc_id"]: r["key"] for r in mixing_es.sizes(docs).collect()}
    by = defaultdict(list)
    for i, s in enumerate(sources):
        by[s].append(i)
    for ids in by.values():
        r = rows[ids[0]]
        assert sum(rows[i]["taken"] for i in ids) == round(r["target"]) and sum(rows[i]["size"] for i in ids) == r["source_size"]
        extra = [rows[i]["extra"] for i in sorted(ids, key=lambda i: (keys[i], i)) if rows[i]["size"]]
        size = [rows[i]["size"] for i in sorted(ids, key=lambda i: (keys[i], i)) if rows[i]["size"]]
        whole = [e == s for e, s in zip(extra, size)]
        border = whole.index(False) if False in whole else len(whole)
        assert all(whole[:border]) and not any(extra[border + 1:])
    assert all(r["taken"] <= 3 * r["size"] for r in rows.values())


def test_heavier_documents_are_drawn_more_often(spark):
    docs = docs_of(spark, ["w " * 10] * 2000, sources=["a" if i % 2 else "b" for i in range(2000)])
    quality = docs.select("doc_id", F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0).alias("weight"))
    got = mixing_es.mix(docs, quality, weights=(1, 3)).where("source_size > 0").collect()
    drawn = Counter((r["doc_id"] % 4 < 2) for r in got if r["taken"] > r["epochs"] * r["size"])
    assert drawn[True] > 1.5 * drawn[False]


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark)
    rows = mixing_es.mix(docs).collect()
    assert len(rows) == docs.count() and sum(r["taken"] for r in rows) == pytest.approx(sum(r["size"] for r in rows), abs=4)
    assert mixing_es.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mixed_stage_writes_whole_copies_and_first_words(spark):
    docs = docs_of(spark, [f"{c}1  {c}2\n{c}3 " for c in "abcdefghijkl"], sources=["a"] * 2 + ["b"] * 10)
    plan = {r["doc_id"]: r for r in mixing_es.mix(docs).collect()}
    got = defaultdict(list)
    for r in stages.mixed(docs, labels_of(spark, [])).collect():
        got[r["doc_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i, r in plan.items():
        text = f"{'abcdefghijkl'[i]}1  {'abcdefghijkl'[i]}2\n{'abcdefghijkl'[i]}3 "
        want = [text] * r["epochs"] + ([words_prefix(text, r["extra"])] if r["extra"] else [])
        assert sorted(got[i]) == sorted(want)


def words_prefix(text, n):
    end = 0
    for w in words(text)[:n]:
        end = text.index(w, end) + len(w)
    return text[:end]


@pytest.mark.parametrize("kind", ["uniform", "hot", "small"])
def test_patterns_use_every_piece_once(kind):
    rng = np.random.default_rng(4)
    lengths = {"uniform": rng.integers(1, 257, 3000), "hot": np.where(rng.random(3000) < 0.4, 170, rng.integers(1, 257, 3000)),
               "small": np.array([256, 255, 3, 3])}[kind]
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    places = packing._Places(dict(histogram), 256)
    spans, cut = defaultdict(list), 0
    slots = defaultdict(list)
    for length, n in histogram.items():
        sequence, slot, at = places.of(length, np.arange(n))
        for q, s, a in zip(sequence.tolist(), slot.tolist(), at.tolist()):
            if a < 0:
                slots[q].append((s, length))
            else:
                spans["stream"].append((a, a + length))
                cut += a // 256 != (a + length - 1) // 256
    assert all(sum(n for _, n in v) <= 256 and len({s for s, _ in v}) == len(v) for v in slots.values())
    stream = sorted(spans["stream"])
    assert not stream or stream[0][0] == 0 and all(a[1] == b[0] for a, b in zip(stream, stream[1:]))
    used = len(slots) + (-(-stream[-1][1] // 256) if stream else 0)
    if kind != "small":
        assert lengths.sum() / 256 / used > 0.97


def test_relaxed_program_is_near_the_area_bound():
    lengths = np.arange(1, 65)
    demand = np.random.default_rng(0).integers(1, 50, 64).astype(float)
    total = sum(times for _, times in cutting_stock.relaxed(lengths, demand, 64))
    assert (lengths * demand).sum() / 64 <= total <= (lengths * demand).sum() / 64 * 1.03


def _check_pieces(docs, pieces, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = Counter()
    want = Counter()
    for r in docs.collect():
        full = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[(r["doc_id"], len(full))] += len(full)
    by_sequence = defaultdict(list)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    for p in pieces:
        ids[(p["doc_id"], p["doc_tokens"])] += p["length"]
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        a, b = p["start"], p["start"] + p["length"]
        assert any(len(t) == p["doc_tokens"] and zlib.crc32(t[a:b].tobytes()) == p["ids_crc32"] for t in texts[p["doc_id"]])
    assert ids == want
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= packing.CAPACITY
    return len(by_sequence)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    pieces = packing.pack(docs, bucket_rows=7)
    pieces = pieces.checkpoint()
    rows = pieces.collect()
    used = _check_pieces(docs, rows, packing.vocabulary_path())
    assert sum(r["length"] for r in rows) / used / packing.CAPACITY > 0.97
    whole = {r["sequence_id"]: r["ids"] for r in packing.token_sequences(pieces, docs).collect()}
    assert sum(map(len, whole.values())) == sum(r["length"] for r in rows)
    some = rows[0]
    cut = np.array(whole[some["sequence_id"]][some["offset"]:some["offset"] + some["length"]], dtype="<u4")
    assert zlib.crc32(cut.tobytes()) == some["ids_crc32"]


def test_packing_odd_rows(spark):
    docs = odd_docs(spark)
    _check_pieces(docs, packing.pack(docs).collect(), packing.vocabulary_path())
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = list("ab Z9'\n\t  .,!é日🙂\x00 ́-_") + ["'ll", "<|endoftext|>", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(500)] + ["x" * 5000, " " * 300 + "a"]
    for t in texts:
        assert packing.encode(t, path).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_mixed_stage_keeps_rows_without_an_id_and_rows_that_share_one(spark):
    rng = random.Random(5)
    texts = [" ".join(f"t{i}w{k}" for k in range(rng.randint(1, 60))) for i in range(240)]
    ids = [None if i % 3 == 0 else i // 8 for i in range(240)]                # a third has none, the others share theirs across sources
    sources = [("a", "b", "c", None)[i % 4] for i in range(240)]
    docs = docs_of(spark, [*texts, *texts[:5]], [*ids, *ids[:5]], [*sources, *sources[:5]]).repartition(3)
    size = Counter()
    for t, s in zip([*texts, *texts[:5]], [*sources, *sources[:5]]):
        size[s] += len(words(t))
    order = ["a", "b", "c", None]
    target = dict(zip(order, reshared([size[s] for s in order], [5, 2, 1, 5])))
    got, origin = Counter(), {t.split(" ")[0]: (i, t) for i, t in enumerate(texts)}
    for r in stages.mixed(docs, labels_of(spark, [])).collect():
        i, text = origin[r["text"].split(" ")[0]]
        assert (r["doc_id"], r["source"]) == (ids[i], sources[i]) and text.startswith(r["text"]) and r["n_chars"] == len(r["text"])
        got[r["source"]] += len(words(r["text"]))
    assert all(abs(got[s] - target[s]) <= 1 for s in order)


def test_packing_keeps_cut_pieces_of_rows_without_an_id(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([300, 700, 800, 900, 1500]) + rng.randint(0, 90))) for _ in range(90)]
    docs = docs_of(spark, [*texts, *texts[:20]], [None] * 100 + [7] * 10).repartition(3)
    pieces = packing.pack(docs, bucket_rows=7).collect()
    whole = [-(-n // packing.CAPACITY) for n in (len(packing.encode(r["text"], packing.vocabulary_path())) for r in docs.collect())]
    assert len(pieces) > sum(whole)                                           # some are cut by a sequence's end
    _check_pieces(docs, pieces, packing.vocabulary_path())


def test_ties_are_mixed_alike_on_every_run(spark):
    """Rows without id, and rows that share one, have one key; which of them the mix takes does not hang on partitions."""
    texts = [" ".join(["w"] * (1 + i % 37)) + f" t{i}" for i in range(400)]
    ids = [None if i % 2 else 7 for i in range(400)]
    docs = docs_of(spark, texts, ids, ["a" if i % 5 else "b" for i in range(400)])
    runs = []
    for parts in (1, 3, 8):
        got = mixing_es.mix(docs.repartition(parts, "text"), whole=True).select("row.text", "taken", "epochs", "extra").collect()
        runs.append(sorted(map(tuple, got)))
    assert runs[0] == runs[1] == runs[2] and any(r[3] for r in runs[0])
