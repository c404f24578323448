"""Operators 2, 3 and 9: trained models against plain forms and held-out rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, mixing, toxicity
from millrace.llm.text import PUNCTUATION, Words

SCHEMA = "doc_id long, text string, lang string, score string"
SYLLABLES = {"aa": ["ka", "ro", "mi", "te"], "bb": ["xu", "zé", "qy", "wö"]}


def corpus(seed, n=160):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 40))]
        bad = rng.random() < 0.4
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["grobian", "Lump,"]))
        rows.append((i, " ".join(text), lang, "x"))
        labels.append((i, int(bad)))
    return rows, labels


ODD = [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, " 12 !! ", None, "x"), (None, "karo", "aa", "x"),
       (903, "lump " + "karo " * 20_000, "aa", "x"), (903, "mite", "aa", "x")]


def test_toxicity_learns_words_and_leaves_clean_texts(spark):
    rows, labels = corpus(1)
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    train = [i for i, _ in labels if i % 3]
    model = toxicity.fit(docs, marks.where("doc_id % 3 <> 0 or doc_id is null"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(train) > 50 and all((got[i] >= 0.7) == bool(y) for i, y in labels)
    assert len(model.slots) < 3000
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, y in labels if not y}


def test_toxicity_defined_results(spark):
    rows, labels = corpus(2)
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(spark.createDataFrame(ODD, SCHEMA), model).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert len(got) == len(ODD) and len(by[903]) == 2
    assert by[900] == by[901] and by[900][0] < 0.7 and max(by[903]) > 0.7
    none = toxicity.fit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r["score"] for r in toxicity.score(spark.createDataFrame(ODD, SCHEMA), none).collect()) < 0.01
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_ftrl_matches_a_plain_loop():
    """One coordinate at a time, as the algorithm is written down."""
    rng = np.random.default_rng(3)
    examples = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(60)]
    labels = np.array([float(3 in e) for e in examples])
    a, b, l1, l2 = 0.5, 1.0, 0.1, 0.01
    model = toxicity.train(examples, labels, epochs=2, alpha=a, beta=b, l1=l1, l2=l2)
    z, n = [0.0] * 13, [0.0] * 13  # 12 is the bias, without L1
    prior = np.log(labels.mean() / (1 - labels.mean()))

    def weight(i):
        if i < 12 and abs(z[i]) <= l1:
            return 0.0
        cut = np.sign(z[i]) * l1 if i < 12 else 0.0
        return -(z[i] - cut) / ((b + n[i] ** 0.5) / a + l2)

    for _ in range(2):
        for e, y in zip(examples, labels):
            w = {i: weight(i) for i in [*e.tolist(), 12]}
            g = 1 / (1 + np.exp(-(sum(w.values()) + prior))) - y
            for i, v in w.items():
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a
                z[i] += g - s * v
                n[i] += g * g
    dense = np.zeros(12)
    dense[model.slots] = model.weights
    assert np.allclose(dense, [weight(i) for i in range(12)], atol=1e-5)
    assert model.bias == pytest.approx(prior + weight(12))


def test_skip_grams_do_not_cross_texts():
    one = toxicity.occurrences(Words(pa.array(["a b", "c d"]), PUNCTUATION))
    two = toxicity.occurrences(Words(pa.array(["c d"]), PUNCTUATION))
    assert [x & ((1 << toxicity.BITS) - 1) for x in one[one >> toxicity.BITS == 1]] == two.tolist()


def test_language(spark):
    rows, _ = corpus(4)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(docs.where("doc_id % 4 <> 2"))
    got = language.predict(docs, model).collect()
    held = [r for r in got if r["doc_id"] % 4 == 2]
    truth = {r[0]: r[2] for r in rows}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    odd = language.predict(spark.createDataFrame(ODD, SCHEMA), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {900, 901, 902}
    none = language.fit(spark.createDataFrame([], SCHEMA))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_subwords_are_those_of_marked_words():
    slots, rows = language.subwords(pa.array(["ab, Cd", None, "é"]))
    # "ab", "cd": one 4-gram and two 3-grams each; "é" is two bytes: the same
    assert np.bincount(rows, minlength=3).tolist() == [6, 0, 3]
    again, _ = language.subwords(pa.array(["cd"]))
    assert set(again.tolist()) <= set(slots[rows == 0].tolist())


def test_rates_reach_the_targets(spark):
    rows, _ = corpus(5)
    docs = spark.createDataFrame(rows, SCHEMA)
    marked = docs.selectExpr("doc_id", "lang as domain").where("doc_id % 2 = 0")
    domains = mixing.fit_domains(docs, marked)
    mixture = mixing.fit_rates(docs, domains, {"aa": 3, "bb": 1, "unknown": 5})
    assert np.allclose(mixture.reached, mixture.goal, rtol=1e-3)
    out = mixing.with_rates(docs, mixture).collect()
    p, tokens = domains.posteriors(pa.array([r["text"] for r in out]))
    rate = np.array([r["rate"] for r in out])
    total = (rate * tokens) @ p
    assert rate.min() >= 0 and total[0] / total.sum() == pytest.approx(0.75, abs=1e-3)
    assert [r["n_tokens"] for r in out] == [len(r["text"].split()) for r in out]
    # the start minus summed gradients, projected: the rates nearest to 1 that fit
    assert np.allclose(np.maximum(0, 1 - p @ mixture.slopes), rate)


def rate_docs(spark, posteriors, tokens):
    """Documents of n words whose first word alone tells the posterior, and domains that read it so."""
    rows = [(i, " ".join([f"w{i % len(posteriors)}"] + ["z"] * (n - 1)), "x", "s") for i, n in enumerate(tokens)]
    names = [f"d{j}" for j in range(len(posteriors[0]))]

    class Known(mixing.Domains):
        def posteriors(self, texts):
            words = [t.split() for t in texts.to_pylist()]
            return np.array([posteriors[int(w[0][1:])] for w in words]), np.array([len(w) for w in words])

    return spark.createDataFrame(rows, SCHEMA), Known(names, np.zeros((1, len(names))), np.zeros(len(names)))


def plain_rates(p, n, goal, steps=200_000):
    """Projected gradient of the whole objective, until nothing moves."""
    r, scale = np.ones(len(n)), p.T @ n
    for _ in range(steps):
        new = np.maximum(0, r - p @ (((r * n) @ p - goal) / scale))
        if np.abs(new - r).max() < 1e-13:
            break
        r = new
    return r


def test_overlapping_domains(spark):
    """2 % and 98 % of documents with posteriors 0.45 / 0.55: 0.46 / 0.54 is reached in few passes."""
    posteriors = [[0.55, 0.45] if i == 0 else [0.45, 0.55] for i in range(50)]
    docs, domains = rate_docs(spark, posteriors, [5 + i % 7 for i in range(2000)])
    mixture = mixing.fit_rates(docs, domains, {"d0": 0.46, "d1": 0.54})
    assert mixture.passes < 30 and mixture.miss < 1e-4
    assert np.abs(mixture.reached / mixture.reached.sum() - [0.46, 0.54]).max() < 1e-4


def test_rates_against_plain_steps(spark):
    rng = np.random.default_rng(3)
    posteriors = rng.dirichlet([0.4, 0.8, 1.5], 60)
    tokens = rng.integers(1, 40, 240)
    docs, domains = rate_docs(spark, posteriors.tolist(), tokens.tolist())
    p = posteriors[np.arange(240) % 60]
    for goal in ([0.6, 0.3, 0.1], [0.05, 0.05, 0.9], [1 / 3] * 3):
        mixture = mixing.fit_rates(docs, domains, dict(zip(domains.names, goal)))
        best = plain_rates(p, tokens, np.array(goal) * tokens.sum())
        reached = (best * tokens) @ p
        assert np.abs(mixture.reached - reached).max() < 1e-4 * tokens.sum()
        r = mixing.rates(p, mixture.slopes)
        # both fit; these are the nearest to 1
        assert tokens @ (r - 1) ** 2 <= tokens @ (best - 1) ** 2 * (1 + 1e-3) + 1e-6


def test_unreachable_targets_leave_a_miss(spark):
    posteriors = [[0.9, 0.1], [0.7, 0.3], [0.8, 0.2]]
    docs, domains = rate_docs(spark, posteriors, [10] * 30)
    with pytest.warns(UserWarning, match="no rates reach"):
        mixture = mixing.fit_rates(docs, domains, {"d0": 0.2, "d1": 0.8})
    p, n = np.array(posteriors)[np.arange(30) % 3], np.full(30, 10)
    goal = np.array([0.2, 0.8]) * 300
    scale = p.T @ n

    def cost(reached):
        return (((reached - goal) ** 2) / scale).sum()

    assert mixture.miss > 0.2 and mixture.passes < 100
    assert cost(mixture.reached) <= cost((plain_rates(p, n, goal) * n) @ p) * (1 + 1e-3)


def test_rates_stop_at_zero():
    p = np.array([[1.0, 0.0], [0.4, 0.6]])
    assert mixing.rates(p, np.array([2.0, 0.0])).tolist() == [0.0, pytest.approx(0.2)]


def test_a_label_with_many_rows_trains_once(spark):
    """The sample is bounded by its ids, whatever rows they have."""
    rows = [(1, f"text {i}", "aa", "s") for i in range(300)] + [(2, "andere worte", "bb", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    domains = mixing.fit_domains(docs, spark.createDataFrame([(1, "aa"), (2, "bb")], "doc_id long, domain string"))
    assert domains.names == ["aa", "bb"] and np.allclose(domains.bias, np.log(0.5))


def test_classifier_against_plain_steps(spark):
    """The same stochastic gradient steps written with dictionaries."""
    rows = [(i, t, d, "s") for i, (t, d) in enumerate([("a b b c", "x"), ("c d", "y"), ("", "x"), ("e e e a", "y"), ("f", "x")] * 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    domains = mixing.fit_domains(docs, docs.selectExpr("doc_id", "lang as domain"), epochs=2)
    keys = [r[0] for r in docs.select(F.xxhash64("doc_id", "text")).collect()]
    weights, squares = {}, {}
    bias = {d: math.log(sum(r[2] == d for r in rows) / len(rows)) for d in "xy"}
    for _ in range(2):
        for _, (_, text, label, *_) in sorted(zip(keys, rows)):
            count = {w: text.split().count(w) for w in text.split()}
            value = {w: c / math.sqrt(max(1, sum(count.values()))) for w, c in count.items()}
            logits = {d: bias[d] + sum(weights.get((w, d), 0.0) * v for w, v in value.items()) for d in "xy"}
            total = sum(math.exp(z) for z in logits.values())
            for d in "xy":
                g = math.exp(logits[d]) / total - (d == label)
                for w, v in value.items():
                    squares[w, d] = squares.get((w, d), 1e-2) + (v * g) ** 2
                    weights[w, d] = weights.get((w, d), 0.0) - 0.1 * v * g / math.sqrt(squares[w, d])
    for text in ("a b", "c d e f", "", "b b b"):
        p, tokens = domains.posteriors(pa.array([text]))
        words = text.split()
        logits = {d: bias[d] + sum(weights.get((w, d), 0.0) for w in words) / math.sqrt(max(1, len(words))) for d in "xy"}
        total = sum(math.exp(z) for z in logits.values())
        assert tokens[0] == len(words) and np.allclose(p[0], [math.exp(logits[d]) / total for d in "xy"], atol=1e-5)


def test_mixing_defined_results(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    nothing = mixing.fit_domains(docs, spark.createDataFrame([], "doc_id long, domain string"))
    out = mixing.with_rates(docs, mixing.fit_rates(docs, nothing, {"aa": 1.0})).collect()
    assert [r["rate"] for r in out] == [1.0] * len(ODD)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.with_rates(empty, mixing.fit_rates(empty, nothing, {"aa": 1.0})).count() == 0
    with pytest.raises(ValueError):
        mixing.with_rates(docs.withColumnRenamed("score", "rate"), mixing.fit_rates(docs, nothing, {}))
