"""Language model, top-k search and toxicity against brute force and held-out rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import pairs
from oracle import compare, connect
from pyspark.sql import functions as F

from tallyscope.llm import hmm, maxscore, registry, toxicity
from tallyscope.llm.common import held_out

# --- hidden Markov model


def small_model(seed, states, classes):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    emits = np.zeros((hmm.CLASSES + 1, states))
    emits[:classes] = norm(rng.random((classes, states)), 0)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), emits)


def test_forward_is_the_sum_over_all_paths():
    model = small_model(1, 3, 4)
    texts = [[0, 1, 2, 3, 1], [2], [3, 3, 0]]
    got = hmm.log_forward(model, np.array(sum(texts, [])), np.array([len(t) for t in texts]))
    for value, text in zip(got, texts):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emits[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.moves[path[t - 1], path[t]] * model.emits[text[t], path[t]]
            total += p
        assert math.isclose(value, math.log(total), rel_tol=1e-9)


def test_expected_counts_are_those_of_all_paths():
    model, text = small_model(2, 2, 3), [0, 2, 1, 1]
    first, moves, emitted, likelihood = hmm.expected(model, np.array([9, *text, 9]), np.array([1]), np.array([4]), np.array([True]))
    total, want = 0.0, (np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)))
    for path in itertools.product(range(2), repeat=4):
        p = model.start[path[0]] * np.prod([model.emits[w, s] for w, s in zip(text, path)]) * np.prod([model.moves[a, b] for a, b in zip(path, path[1:])])
        total += p
        want[0][path[0]] += p
        for a, b in zip(path, path[1:]):
            want[1][a, b] += p
        for w, s in zip(text, path):
            want[2][w, s] += p
    for got, x in zip((first, moves, emitted[:3]), want):
        assert np.allclose(got, x / total, rtol=1e-4)
    assert math.isclose(likelihood, math.log(total), rel_tol=1e-4)


def plain_pass(model, begin, classes):
    """Scaled forward and backward recursion over one sequence, token by token."""
    alphas, scales = [], []
    for t, c in enumerate(classes):
        alpha = (alphas[-1] @ model.moves if t else begin) * model.emits[c]
        scales.append(alpha.sum())
        alphas.append(alpha / scales[-1])
    beta, first, moves, weights = np.ones(len(begin)), None, np.zeros_like(model.moves), []
    for t in reversed(range(len(classes))):
        weights.append((classes[t], alphas[t] * beta))
        back = model.emits[classes[t]] * beta / scales[t]
        if t:
            moves += np.outer(alphas[t - 1], back) * model.moves
            beta = model.moves @ back
        else:
            first = alphas[0] * beta
    return first, moves, weights, np.log10(scales).sum()


def test_scores_are_those_of_a_plain_baum_welch(spark):
    """Texts shorter and longer than a training sequence, trained and scored token by token."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), size)) for size in (0, 1, 3, 40, hmm.SEQUENCE - 1, hmm.SEQUENCE, 2 * hmm.SEQUENCE + 77)] + ["a zz", None]
    train, states, rounds, prior = len(texts) - 2, 2, 2, 100.0
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: r.score for r in hmm.score(df, F.col("doc_id") < train, states=states, rounds=rounds, prior=prior).collect()}

    coded = [hmm.words(t) for t in texts]
    class_of = lambda w: zlib.crc32(w) % hmm.CLASSES
    counts = Counter(w for words in coded[:train] for w in words)
    n, class_counts = sum(counts.values()), np.zeros(hmm.CLASSES)
    for w, c in counts.items():
        class_counts[class_of(w)] += c
    model = hmm._first_model(class_counts, states, 1)
    for _ in range(rounds):
        share = np.linalg.matrix_power(model.moves, 1 << 12).mean(axis=0)
        first, moves, emitted = np.ones(states), np.ones((states, states)), np.zeros((hmm.CLASSES, states))
        for words in coded[:train]:
            for at in range(0, len(words), hmm.SEQUENCE):
                part = [class_of(w) for w in words[at : at + hmm.SEQUENCE]]
                opening, moved, weights, _ = plain_pass(model, share if at else model.start, part)
                first, moves = first + (0 if at else opening), moves + moved
                for c, weight in weights:
                    emitted[c] += weight
        emits = (emitted + prior * class_counts[:, None] / n) / (emitted.sum(axis=0) + prior)
        model = hmm.Model(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), np.vstack([emits, np.ones(states)]))
    unseen = (sum(c == 1 for c in counts.values()) + 1) / (n + 2)
    for i, words in enumerate(coded):
        classes = [class_of(w) if w in counts else hmm.CLASSES for w in words]
        within = [(1 - unseen) * counts[w] / class_counts[class_of(w)] if w in counts else unseen for w in words]
        assert math.isclose(got[i], plain_pass(model, model.start, classes)[3] + np.log10(within).sum(), rel_tol=1e-4)


def plain_base(rows, training):
    counts = Counter(w for (_, text), train in zip(rows, training) if train for w in hmm.words(text))
    n, v = sum(counts.values()), len(counts)
    return n, [sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in hmm.words(t)) for _, t in rows], [sum(counts[w] > 0 for w in hmm.words(t)) for _, t in rows]


def test_model_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    training = [r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 != 0 for r in odd.collect()]
    got = hmm.score(odd, ~held_out("doc_id", 3), states=3, rounds=2).collect()
    n, base, known = plain_base(rows, training)
    want = sorted(((i, len(hmm.words(t)), k, n) for (i, t), k in zip(rows, known)), key=repr)
    assert sorted(((r.id, r.n_tokens, r.n_known, r.train_tokens) for r in got), key=repr) == want
    assert np.allclose(sorted(r.base_score for r in got), sorted(base)) and all(r.score < 0 for r in got)
    assert hmm.score(none, ~held_out("doc_id", 3)).count() == 0
    untrained = hmm.score(odd, F.lit(False), states=2).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and abs(r.score) < 1e-6 for r in untrained)


def test_word_probabilities_sum_to_one(spark):
    """All two-token texts over the vocabulary and an unseen word, in a model of one-word texts."""
    texts = ["a", "a", "b", "c", "c", "c", "d d", "a b c d e"]
    vocabulary = sorted({w for t in texts for w in t.split()})
    probes = [*texts, *vocabulary, "unseen"]
    df = spark.createDataFrame(list(enumerate(probes)), "doc_id bigint, text string")
    rows = {r.id: r.score for r in hmm.score(df, F.col("doc_id") < len(texts), states=2, rounds=3).collect()}
    # P(w, end) over all w is P(second token is the end)
    total = sum(10 ** rows[len(texts) + i] for i in range(len(vocabulary) + 1))
    assert 0.05 < total < 1


def test_model_table(spark, folder):
    rows = registry.queries()["op1_hidden_markov"](spark, folder).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    n, base, known = plain_base(docs, [zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in docs])
    want = {i: (b, k) for (i, _), b, k in zip(docs, base, known)}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.train_tokens == n
        assert math.isclose(r.base_score, want[r.doc_id][0], rel_tol=1e-9) and r.n_known == want[r.doc_id][1]
    out = [r for r in rows if r.held_out]
    assert out and sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)


# --- top-k search


def test_search_equals_sql(spark, folder):
    assert compare(registry.queries()["op5_maxscore"](spark, folder), connect(folder), registry.oracle_sql()["op5_maxscore"]) is None


@pytest.mark.parametrize("rows_at_once", [8192, 7])
def test_search_odd_vectors(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", rows_at_once)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", rows_at_once)
    monkeypatch.setattr(maxscore, "STEP_ROWS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0], rng.integers(0, 12))]) for i in range(120)]
    rows += [(3, rows[3][1]), (4, [2.0]), (None, [1.0]), (130, None), (131, [1.0, None]), (132, [float("nan")]), (133, [float("inf")]), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("x"))
    got = maxscore.search(maxscore.quantised(df), F.col("id") % 10 == 0, k=4)
    whole = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, v in whole:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert pairs(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    few = maxscore.search(maxscore.quantised(df.filter("vec_id in (10, 11, 12)")), F.col("id") % 10 == 0, k=5)
    assert few.count() == 2 and maxscore.search(maxscore.quantised(df.limit(0)), F.col("id") % 10 == 0).count() == 0


# --- toxicity


def edits(a, b):
    """Edits between two words, a swap of neighbours being one."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_accepts_exactly_the_near_words():
    rng = np.random.default_rng(6)
    word = lambda low, high: "".join(rng.choice(list("abc"), rng.integers(low, high)))
    terms = sorted({word(3, 12) for _ in range(25)})
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(600):
        probe = word(2, 13)
        near = [edits(probe, t) for t in terms if edits(probe, t) <= toxicity.allowed_errors(t)]
        hit = automaton.match(probe)
        assert (hit is None) == (not near) and (hit is None or (hit[1] == min(near) and edits(probe, hit[0]) == hit[1])), probe


def hits(*terms):
    return toxicity.WordHits(toxicity.Model(frozenset({"vile"}), {t: 0.8 for t in terms}, frozenset({"stupor"}), (0.0,) * 6))


def test_misspelt_stretched_and_quoted():
    table = hits("stupid", "worthless")
    for text in ("you are stupid", "you are STUPID", "you are stup1d", "you are stuuuupid", "vileness"):
        assert toxicity.features(text, table)[0] > 0, text
    for text in ("you are stupd", "wortlhess", "worthles"):
        assert toxicity.features(text, table)[:2][1] > 0 == toxicity.features(text, table)[0], text
    for text in ("stupor", "", "clean words only"):
        assert toxicity.features(text, table) == [0.0] * 5
    quoted = toxicity.features('the word "stupid" is an insult', table)
    assert quoted[2] > 0 and quoted[0] == 0
    assert toxicity._probability((-3.0, 2.0, 1.5, 0.5, 1.0, 0.5), np.array([quoted]))[0] < 0.5
    assert toxicity._probability((-3.0, 2.0, 1.5, 0.5, 1.0, 0.5), np.array([toxicity.features("you are a stupid stupid person", table)]))[0] > 0.5


@pytest.fixture(scope="module")
def learned(spark, folder):
    folder = folder.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    return docs, labels, toxicity.fit(docs, labels, 5)


def test_held_out_rows_are_told_apart(learned):
    docs, labels, model = learned
    scored = toxicity.score(docs, model).join(labels, F.col("id") == F.col("doc_id")).filter(held_out("doc_id", 5))
    right = scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.985 and 0 <= right[1] and right[2] <= 1


def test_toxicity_rows(learned, odd, none):
    model = learned[2]
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score < 0.5 for r in rows)
    kept = toxicity.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count() and toxicity.score(none, model).count() == 0


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int")
    for table in (labels, labels.limit(0)):
        model = toxicity.fit(odd, table, 5)
        assert not model.terms and all(0 <= r.score < 0.5 for r in toxicity.score(odd, model).collect())


def test_texts_that_share_words_are_all_evidence(spark):
    """Twelve toxic and twelve clean texts share their most frequent words; a stretched term may be of any length."""
    rows = [(i, f"you are all the same to me number{i} gromble") for i in range(12)] + [(100 + i, f"you are all the same to me thing{i}") for i in range(12)]
    rows += [(200 + i, "You are, a   copied wozzle!") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(not 100 <= i < 200)) for i, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, 1000)
    assert "gromble" in model.terms and "wozzle" not in model.terms
    table = toxicity.WordHits(model)
    assert toxicity.features("you gr" + "o" * 60 + "mble", table) == toxicity.features("you gromble", table) != [0.0] * 5


def test_long_words_long_quotations_and_stems():
    long_term = "gromble" * 7
    table = toxicity.WordHits(toxicity.Model(frozenset({"idio"}), {long_term: 0.8, "idiots": 0.8}, frozenset({"idiomatic"}), (0.0,) * 6))
    assert toxicity.features(f"you {long_term}", table)[0] > 0 and toxicity.features(f"you {long_term[:-1]}", table)[1] > 0
    said = "they are such a lot of " + "very " * 80 + "bad idiots"
    assert toxicity.features(f'"{said}"', table)[0] == 0 < toxicity.features(f'"{said}"', table)[2]
    assert toxicity.features(said, table)[0] > 0
    assert toxicity.features("an idiomatic phrase", table) == [0.0] * 5 != toxicity.features("idiotically so", table)


def test_one_rule_for_words(spark):
    """Words of every script are cut alike for learning and for scoring."""
    term = "हिन्दीगाली"
    rows = [(i, f"{term} text number{i} a‍b") for i in range(8)] + [(100 + i, f"clean text number{i}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, 1000)
    assert term in model.terms and toxicity.features(f"so {term} ist", toxicity.WordHits(model))[0] > 0


def test_scores_follow_the_definition(spark):
    """The operator's scores are those of the features and the regression, worked out row by row without Spark."""
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(filler, k=12) + (rng.choices(["grackle", "vomble"], k=2) if i % 3 == 0 else []))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, 7)
    kept = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7]
    counts = {w: (sum(w in t.split() for i, t in kept if i % 3 == 0), sum(w in t.split() for i, t in kept if i % 3)) for w in {*filler, "grackle", "vomble"}}
    least = max(3, toxicity.LEAST_SHARE * sum(i % 3 == 0 for i, _ in kept))
    assert set(model.terms) == {w for w, (a, b) in counts.items() if a >= least and a >= toxicity.LEAST_PRECISION * (a + b)} >= {"grackle", "vomble"}
    for r in toxicity.score(docs, model).collect():
        x = toxicity.features(dict(rows)[r.id], toxicity.WordHits(model))
        assert abs(r.score - 1 / (1 + math.exp(-(model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x)))))) < 1e-12
