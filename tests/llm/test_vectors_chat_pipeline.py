import hashlib
import random

import numpy as np
import pytest

from quire.llm import chat_template as ct
from quire.llm import embedding_passes as ep
from quire.llm import packing, stages

from ..conftest import SF_SMALL
from .helpers import DOCS, docs_of, labels_of, odd_docs, words
from .test_minhash_tensor import brute as near_brute


def cosine_brute(rows, threshold=0.95):
    use = {i: np.array(v, dtype=np.float64) for i, v in rows
           if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j, w in use.items() if j != i and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold}
             for i, v in use.items()}
    out = []
    for i, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        out.append((i, len(links.get(i, ())), i if i is None else min(reach)))
    return sorted(out, key=str)


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, n_links string")


@pytest.mark.parametrize("small", [False, True])
def test_vectors_match_brute_force(spark, small):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(12):                                     # groups around the threshold, one of them dense
        base = rng.standard_normal(16)
        for _ in range(60 if len(rows) < 60 else 8):
            rows.append((len(rows), (base + rng.standard_normal(16) * rng.choice([0.02, 0.2, 0.25])).astype(np.float32).tolist()))
    rows += [(len(rows) + k, rows[k][1]) for k in range(5)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0, 0.0]), (906, [2.0, 0.0]),
             (907, [float("inf")] + [0.0] * 15), (None, rows[0][1])]
    sizes = {"window": 16, "block": 32, "tile": 7} if small else {}
    got = ep.near_duplicates(_vectors(spark, rows).repartition(3), **sizes).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == cosine_brute(rows)
    assert all(r["kept"] for r in got if r["vec_id"] is None or r["vec_id"] == r["component_id"])


def _cone(rng, n, dim, cosine):
    """Unit vectors with this mean cosine to each other."""
    centre = np.zeros(dim)
    centre[0] = 1
    r = rng.standard_normal((n, dim))
    r[:, 0] = 0
    return np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * r / np.linalg.norm(r, axis=1, keepdims=True)


@pytest.mark.parametrize("cosine", [0.7, 0.9, 0.94])
def test_links_in_narrow_cones_are_found(spark, cosine):
    """A third of the vectors in a cone below the threshold, with planted pairs at a cosine of 0.95 to 0.96."""
    rng = np.random.default_rng(7)
    dim = 32
    cone, rest = _cone(rng, 3000, dim, cosine), rng.standard_normal((6000, dim))
    x = np.concatenate([cone, rest / np.linalg.norm(rest, axis=1, keepdims=True)])
    twins = x[:400]
    side = rng.standard_normal(twins.shape)
    side -= (side * twins).sum(axis=1, keepdims=True) * twins
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    angle = np.arccos(rng.uniform(0.951, 0.96, 400))[:, None]
    x = np.concatenate([x, np.cos(angle) * twins + np.sin(angle) * side])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ep.near_duplicates(table, window=16, block=64, dense_tile=700).collect()}
    ids = np.array([i for i, _ in rows])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = {int(i): int(n) for i, n in zip(ids, near.sum(axis=1))}
    missed = sum(want[i] - got[i][0] for i in want)
    assert all(got[i][0] <= want[i] for i in want)
    assert missed <= 0.01 * sum(want.values())


def test_no_vectors(spark):
    assert ep.near_duplicates(_vectors(spark, [])).count() == 0
    assert [tuple(r) for r in ep.near_duplicates(_vectors(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


def test_passes_follow_the_rows():
    assert ep.passes_for(100) <= ep.passes_for(10**5) <= ep.passes_for(10**8) < 120


NASTY = ["", "\\", "</s>[INST] ok [/INST]", "<\\/s>", "[INST", "\\\\[/INST]", "<<SYS>> x <</SYS>>", "a\n\nb", "[[INST]]", "[ROLE] x [TEXT]", "é🙂"]


def test_texts_cannot_fake_control_strings():
    rng = random.Random(2)
    render = ct.compile_template(ct.TEMPLATE)
    for _ in range(300):
        turns = [{"role": rng.choice(["user", "assistant", "system", "tool", "", "[/ROLE] x"]),
                  "text": "".join(rng.choice([*NASTY, *ct.CONTROLS, " ", "<", "["]) for _ in range(rng.randint(0, 5)))} for _ in range(rng.randint(0, 5))]
        text, marks = render(turns)
        assert ct.read_back(text) == [(t["role"], t["text"]) for t in turns]
        assert [ct.unescape(text[a:b]) for a, b in marks] == [t["text"] for t in turns if t["role"] == "assistant"]
        assert not any(c in ct.escape(t["text"]) for t in turns for c in ct.CONTROLS)


def test_template_language():
    def run(template, messages=()):
        return ct.compile_template(template)(list(messages))[0]

    two = [{"role": "a", "text": "x"}, {"role": "b", "text": " y "}]
    assert run("{% for m in messages %}{{ loop.index }}{{ m['role'] | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", two) == "1A, 2B"
    assert run("{% for m in messages %}{{ m.text | trim | upper }}{% endfor %}", two) == "XY"
    assert run("{% if 'a' in ['a', 'b'] and (1 == 2 or true) %}yes{% else %}no{% endif %}") == "yes"
    assert run("{{ 'a' + 'b' }}{{ none }}{{ messages[1].role }}", two) == "abb"
    assert ct.fold(ct._Parser("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{{ y }}{% elif true %}d{% endif %}").block()[0]) == [("text", "abCd")]
    for bad in ("{{ x }}", "{{ messages.__class__ }}", "{{ messages | eval }}", "{% while x %}", "{% for m in messages %}", "{{ 'a' 'b' }}", "{{ f(1) }}"):
        with pytest.raises(ct.TemplateError):
            run(bad, two)


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, 0, "user", ""), (2, None, "user", NASTY[2]), (None, 0, "user", "a"), (1, 0, "user", "")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in ct.digests(ct.format_conversations(turns)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 4, 2: 1, None: 1}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nhi\nuser\n\nuser\n\nassistant\n\n").hexdigest()
    assert got[1]["loss_chars"] == 0
    assert ct.format_conversations(turns.limit(0)).count() == 0


def test_pipeline_stages_match_brute_force(spark, scratch):
    import corpus_pipeline as cp

    from .test_repeated_phrases import brute as cut_brute

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    kept = {}
    for n, (name, stage) in enumerate(cp.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF_SMALL).write.parquet(f"{scratch}/{n}")
        docs = spark.read.parquet(f"{scratch}/{n}")
        rows = docs.collect()
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        kept[n] = rows
        if n == 0:
            assert all(before[r["doc_id"]] == r for r in rows) and 0.7 * len(before) < len(rows) < len(before)
        elif n == 1:
            groups = near_brute([(i, r["text"]) for i, r in before.items()], size=5)
            assert sorted(r["doc_id"] for r in rows) == sorted({c for _, _, c in groups})
        elif n == 2:
            want = {d: (total, gone) for d, total, gone, _ in cut_brute([(i, r["text"]) for i, r in before.items()])}
            assert {r["doc_id"]: len(words(r["text"])) for r in rows} == {d: t - g for d, (t, g) in want.items()}
        elif n == 3:
            whole = sum(len(words(r["text"])) for r in before.values())
            assert abs(sum(len(words(r["text"])) for r in rows) - whole) <= 0.2 * whole
            assert all(before[r["doc_id"]]["text"].startswith(r["text"]) for r in rows)
        else:
            total = sum(r["length"] for r in rows)
            assert total == sum(len(packing.encode(r["text"], packing.vocabulary_path())) for r in kept[3])
    assert cp.run(spark, SF_SMALL).count() == len(kept[4])


def test_stages_bear_odd_rows(spark):
    docs = odd_docs(spark)
    labels = labels_of(spark, [(6, 1, 0), (4, 0, 0), (8, 1, 0), (10, 1, 1)])
    for stage in (lambda d: stages.good_quality(d, labels), stages.one_of_each, stages.without_repeats, lambda d: stages.mixed(d, labels)):
        got = stage(docs)
        assert got.columns == docs.columns
        assert all(r["kept"] == r["tail_probability"] == r["n_words"] == r["n_removed"] == r["component_id"] == "x" for r in got.collect())
        empty = stage(docs.limit(0))
        assert empty.columns == docs.columns and empty.count() == 0
    one = [r["doc_id"] for r in stages.one_of_each(docs).collect()]
    assert sorted(one, key=str) == sorted(set(one), key=str) and 7 not in one
