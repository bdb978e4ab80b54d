"""Quality, toxicity, rules and language models."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import lm_cross_entropy as lm
from quire.llm import quality_ordinal as qo
from quire.llm import toxicity_counterfactual as tc
from quire.llm import weak_supervision as ws

from ..conftest import SF_ORACLE
from .helpers import DOCS, docs_of, labels_of, odd_docs, words


def _graded(rng, grade):
    clean = " ".join(rng.choice(["the", "of", "river", "stone", "house", "walks", "under", "light"]) for _ in range(60)) + "."
    return {0: clean.replace(" ", "*** "), 1: clean.upper(), 2: clean + " moron.", 3: clean}[grade]


def test_ordinal_orders_four_grades(spark):
    rng = random.Random(1)
    grades = [rng.randint(0, 3) for _ in range(400)]
    docs = docs_of(spark, [_graded(rng, g) for g in grades])
    train = docs.join(spark.createDataFrame(list(enumerate(grades))[:300], "doc_id bigint, y int"), "doc_id").select("doc_id", "text", "y")
    model = qo.fit(train, grades=4)
    assert (np.diff(model.thresholds) > 0).all()
    rows = {r["doc_id"]: r for r in qo.score(docs, model).collect()}
    held = range(300, 400)
    assert sum(round(rows[i]["expected_grade"]) == grades[i] for i in held) >= 95
    assert all((rows[i]["tail_probability"] >= 0.5) == (grades[i] >= 1) for i in held)


def test_quality_separates_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    model = qo.fit(qo.training_rows(docs, labels.where("doc_id % 3 <> 0")))
    got = (qo.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id")
           .select("quality", (F.col("tail_probability") >= 0.5).alias("kept")).collect())
    assert len(got) > 80
    assert sum(r["kept"] == bool(r["quality"]) for r in got) >= 0.97 * len(got)


@pytest.mark.parametrize("rows", [[], [(6, 1, 0)], [(6, None, None), (99, 0, 0)], [(6, 1, 0), (6, 0, 1), (8, 0, 0), (9, 1, 0), (10, 1, 0), (4, 0, 0)]])
def test_odd_rows_and_labels(spark, rows):
    docs, labels = odd_docs(spark), labels_of(spark, rows)
    rated = qo.rate(docs, docs, labels).collect()
    assert len(rated) == docs.count() and all(0 <= r["tail_probability"] <= 1 for r in rated)
    scored = tc.score(docs, tc.fit(tc.training_rows(docs, labels))).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    nothing = spark.createDataFrame([], DOCS)
    assert qo.rate(nothing, nothing, labels).count() == 0
    assert tc.score(nothing, tc.fit(tc.training_rows(nothing, labels))).count() == 0


def test_toxicity_finds_held_out_labels_and_does_not_train_on_them(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    train = tc.training_rows(docs, labels)
    assert not train.where(tc.held_out()).count()
    got = (tc.score(docs, tc.fit(train)).where(tc.held_out()).join(labels, "doc_id").select("toxic", "score").collect())
    clean = [r["score"] for r in got if not r["toxic"]]
    toxic = [r["score"] for r in got if r["toxic"]]
    assert max(clean) < tc.THRESHOLD and sum(s >= tc.THRESHOLD for s in toxic) >= 0.55 * len(toxic)       # few labels at this scale


def test_swapped_identity_terms_score_alike(spark):
    rng = random.Random(3)
    plain = ["the", "of", "river", "stone", "walks", "under"]

    def text(term, bad):
        return " ".join([rng.choice(plain) for _ in range(8)] + [term] + (["moron"] if bad else []) + [rng.choice(plain)])

    # one group is mostly mentioned in toxic texts: a plain fit blames the word
    rows = [(text("muslim", True), 1) for _ in range(60)] + [(text("muslim", False), 0) for _ in range(6)]
    rows += [(text("christian", False), 0) for _ in range(80)] + [(text("jewish", True), 1) for _ in range(6)]
    rows += [(" ".join(rng.choice(plain) for _ in range(9)) + (" fool" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(80)]
    train = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id bigint, text string, y int")
    ask = docs_of(spark, ["a muslim walks under the river", "a christian walks under the river", "moron"])

    def scores(penalty):
        return [r["score"] for r in tc.score(ask, tc.fit(train, penalty=penalty)).orderBy("doc_id").collect()]

    plain_fit, tied = scores(0.0), scores(50.0)
    assert plain_fit[0] - plain_fit[1] > 4 * abs(tied[0] - tied[1])
    assert tied[0] < plain_fit[0] and tied[2] > 0.5


def base_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered))


def test_base_counts_match_brute_force(spark):
    docs = odd_docs(spark).select("doc_id", "text").unionAll(spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text"))
    docs = docs.unionAll(docs_of(spark, ["a b c d e a b c d e x\nq\n q\nq\n\n", "a a a a a a", "#é|日 <b>\nx"]).select("doc_id", "text"))
    got = ws.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = []
    for r in docs.collect():
        c = base_counts(r["text"])
        want.append((r["doc_id"], *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    rows = got.collect()
    assert sorted((tuple(r)[:7] for r in rows), key=str) == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert ws.judge(spark.createDataFrame([], DOCS)).count() == 0


def test_em_on_patterns_is_em_on_rows_and_finds_accuracies():
    rng = np.random.default_rng(5)
    kinds = ["fault", "fault", "fault", "merit", "both"]
    good = rng.random(20_000) < 0.8
    p_bad = np.where(good[:, None], [0.01, 0.02, 0.01, 0, 0.02], [0.5, 0.6, 0.4, 0, 0.5])
    p_up = np.where(good[:, None], [0, 0, 0, 0.8, 0.7], [0, 0, 0, 0.3, 0.2])
    u = rng.random((20_000, 5))
    votes = np.where(u < p_bad, -1, np.where(u < p_bad + p_up, 1, 0))
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, theta = ws.expectation_maximisation(patterns, n.astype(float), kinds)
    share2, theta2 = ws.expectation_maximisation(votes, np.ones(len(votes)), kinds)
    assert np.allclose(theta, theta2) and math.isclose(share, share2)
    assert abs(share - 0.8) < 0.08 and theta[0, 0, 0] > 10 * theta[0, 1, 0]
    kept = ws.posterior(share, theta, patterns)[back.ravel()] >= 0.5
    truth = np.array([[[b[0], 1 - b[0] - b[1], b[1]], [g[0], 1 - g[0] - g[1], g[1]]] for b, g in zip(
        [(0.5, 0), (0.6, 0), (0.4, 0), (0, 0.3), (0.5, 0.2)], [(0.01, 0), (0.02, 0), (0.01, 0), (0, 0.8), (0.02, 0.7)])]) + 1e-9
    best = ws.posterior(0.8, truth, patterns)[back.ravel()] >= 0.5
    assert (kept == good).mean() > (best == good).mean() - 0.01


def test_rules_keep_clean_prose_and_drop_junk(spark):
    got = (ws.judge(spark.read.parquet(f"{SF_ORACLE}/documents.parquet")).join(spark.read.parquet(f"{SF_ORACLE}/labels.parquet"), "doc_id")
           .where("not base_failed").select("quality", "kept").collect())
    assert sum(r["kept"] for r in got if r["quality"] == 1) >= 0.99 * sum(r["quality"] == 1 for r in got)
    assert not any(r["kept"] for r in got if r["quality"] == 0)


def test_cross_entropy_difference_matches_a_dictionary_model(spark):
    rng = random.Random(7)
    target = [" ".join(rng.choice(["sun", "sea", "sand"]) for _ in range(20)) for _ in range(20)]
    rest = [" ".join(rng.choice(["tax", "law", "court", "sea"]) for _ in range(20)) for _ in range(30)]
    texts = [*target, *rest, "Sun, sea!", "law court", "", None]
    docs = docs_of(spark, texts).withColumn("goal", F.col("doc_id") < 20)
    got = {r["doc_id"]: r for r in lm.cross_entropy_difference(docs, F.col("goal")).collect()}

    def tokens(t):
        return (t or "").lower().replace(",", " ").replace("!", " ").split()

    def counted(ts):
        one, two, starts = Counter(), Counter(), 0
        for t in map(tokens, ts):
            one.update(t)
            two.update(zip([None, *t], t))
            starts += bool(t)
        return one, two, starts

    models = [counted(target), counted(texts)]
    scale = sum(models[0][0].values()) / sum(models[1][0].values())

    def loss(t, model, by):
        one, two, starts = model
        total, out = by * sum(one.values()), []
        for h, w in zip([None, *t], t):
            p = (by * one[w] + 1) / (total + len(models[1][0]))     # distinct words of the corpus
            context = by * (starts if h is None else one[h])
            out.append(-math.log((by * two[h, w] + lm.MASS * p) / (context + lm.MASS)))
        return sum(out) / len(out)

    for i, t in enumerate(texts):
        t = tokens(t)
        assert got[i]["n_tokens"] == len(t)
        if t:
            assert math.isclose(got[i]["difference"], loss(t, models[0], 1.0) - loss(t, models[1], scale), abs_tol=1e-3)
        else:
            assert got[i]["difference"] is None
    assert got[50]["difference"] < 0 < got[51]["difference"]


def test_language_models_bear_odd_rows(spark):
    docs = odd_docs(spark)
    assert lm.cross_entropy_difference(docs, F.col("doc_id") == 6).count() == docs.count()
    alike = lm.cross_entropy_difference(docs, F.lit(False)).collect()
    assert all(r["difference"] in (None, 0.0) for r in alike)
    assert lm.cross_entropy_difference(spark.createDataFrame([], DOCS), F.lit(True)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_language_models_keep_all_ngrams_apart(spark, small):
    rng = random.Random(11)                                 # more words and bigrams than tables of 2^18 and 2^21 slots keep apart
    texts = [" ".join(["the", *[f"w{k}x{i}" for k in rng.sample(range(10**6), 1000)], "the", "end"]) for i in range(400)]
    docs = docs_of(spark, [*texts, texts[0], None], ids=[*range(400), None, None]).repartition(7).withColumn("goal", F.col("doc_id") < 40)
    sizes = {"chunk": 5_000, "range_tokens": 20_000} if small else {}       # many chunks and ranges
    got = lm.cross_entropy_difference(docs, F.col("goal"), **sizes).collect()
    one, two, goals = Counter(), Counter(), (Counter(), Counter())
    for i, t in enumerate([*texts, texts[0]]):
        w = t.split()
        for a, b in [(one, two)] + [goals] * (i < 40):
            a.update(w)
            b.update(zip([None, *w], w))
    words = len(one)
    assert words > 1 << 18

    def loss(w, a, b, starts, by):
        n, out = by * sum(a.values()), []
        for h, x in zip([None, *w], w):
            p = (by * a[x] + 1) / (n + words)
            out.append(-math.log((by * b[h, x] + lm.MASS * p) / (by * (starts if h is None else a[h]) + lm.MASS)))
        return sum(out) / len(out)

    assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, [*range(400), None, None]))
    scale = sum(goals[0].values()) / sum(one.values())
    for r in got:
        if r["n_tokens"] == 0:
            assert r["doc_id"] is None and r["difference"] is None
        else:
            w = texts[r["doc_id"] or 0].split()
            assert r["n_tokens"] == len(w)
            assert math.isclose(r["target_loss"], loss(w, *goals, 40, 1.0), rel_tol=1e-9)
            assert math.isclose(r["background_loss"], loss(w, one, two, 401, scale), rel_tol=1e-9)


def test_fits_take_one_row_of_an_id(spark):
    """The bound of a fit holds for rows, however many rows share a rated id."""
    docs = docs_of(spark, [f"text {k:04d}" for k in range(3000)], ids=[k if k < 10 else 0 for k in range(3000)])
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(10)])
    for module in (qo, tc):
        rows = module.training_rows(docs, labels, limit=8).collect()
        assert len(rows) <= 8 and len({r["doc_id"] for r in rows}) == len(rows)
        assert all(r["text"] == f"text {r['doc_id']:04d}" for r in rows)


def test_swapped_sentences_and_their_score_changes(spark):
    groups = (("red", "green", "reddish"), ("old", "young"))
    texts = ["A red boat. The Old man saw red; red! Nothing here", "green and red and reddish", "no terms", None, "", "old\nyoung", "boldly red-old"] * 3
    got = [x for t in texts for x in tc.swaps_of(t, groups)]
    assert ("red", "green", "A red boat", "A green boat") in got and ("old", "young", " The Old man saw red; red", " The young man saw red; red") in got
    assert ("red", "reddish", " The Old man saw red; red", " The Old man saw reddish; reddish") in got
    assert ("red", "green", "boldly red-old", "boldly green-old") in got and len(got) == 3 * 16

    table = np.unique(tc.extract(pa.array(["red green reddish old young boat man saw boldly"]))[1])

    def features(sentence):
        return set(np.searchsorted(table, [f for f in tc.extract(pa.array([sentence]))[1] if f in table]).tolist())

    want = Counter((tuple(sorted(features(s) - features(t))), tuple(sorted(features(t) - features(s)))) for _, _, s, t in got)
    docs = docs_of(spark, texts).repartition(4)
    counted = {(tuple(a), tuple(b)): n for a, b, n in tc.score_changes(docs, table, groups)}
    assert counted == dict(want)
    # the penalty is the mean squared change of the scores of these pairs
    w = np.random.default_rng(1).standard_normal(len(table))
    change = [sum(w[i] for i in features(s)) - sum(w[i] for i in features(t)) for _, _, s, t in got]
    by_rows = sum(n * (w[list(a)].sum() - w[list(b)].sum()) ** 2 for (a, b), n in counted.items()) / len(got)
    assert math.isclose(by_rows, float(np.mean(np.square(change))))
