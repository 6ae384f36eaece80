import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tocsin.constants import CLASSES
from tocsin.operators import embeddings, features, linear, profile, scoring
from tocsin.operators import naive_bayes as nb
from tocsin.sources import state as st

TEXTS = {
    0: ["trapped family needs rescue", "rescue boat for trapped people", "people trapped on roof rescue"],
    1: ["need water and food", "need food water blankets", "water food need now"],
    2: ["river level rising fast", "road closed by river", "river warning road closed"],
    3: ["donate money to help", "volunteers donate clothes help", "help us donate money"],
    4: ["nice song today", "song today great", "great song nice"],
}


@pytest.fixture(scope="module")
def train(spark):
    rows = []
    for k, texts in TEXTS.items():
        for copy in range(4):
            for t in texts[: 3 - (k == 1)]:
                rows.append((len(rows), f"{t} x{copy}y", CLASSES[k], "train"))
    return spark.createDataFrame(rows, "doc_id long, clean_text string, target_label string, split string")


@pytest.fixture(scope="module")
def held(spark):
    rows = [
        (1000, "family trapped rescue", CLASSES[0]), (1001, "food and water need", CLASSES[1]),
        (1002, "road and river", CLASSES[2]), (1003, "donate money", CLASSES[3]),
        (1004, "great song", CLASSES[4]), (1005, "zzz unknown words only qqq", CLASSES[4]),
    ]
    return spark.createDataFrame(rows, "doc_id long, clean_text string, target_label string")


@pytest.fixture(scope="module")
def state(train):
    return scoring.fit_text_model(train, min_df=1)


def brute_tfidf(texts, vocab_idf):
    out = []
    for t in texts:
        words = [w for w in t.split() if len(w) > 1]
        grams = Counter(words) + Counter(" ".join(p) for p in zip(words, words[1:]))
        cells = {g: (1 + math.log(n)) * vocab_idf[g] for g, n in grams.items() if g in vocab_idf}
        norm = math.sqrt(sum(v * v for v in cells.values()))
        out.append({g: v / norm for g, v in cells.items()})
    return out


def test_tfidf_and_naive_bayes_against_brute_force(spark, train, held):
    rows = train.orderBy("doc_id").collect()
    texts, labels = [r["clean_text"] for r in rows], [CLASSES.index(r["target_label"]) for r in rows]
    grams = [set(Counter(t.split())) | {" ".join(p) for p in zip(t.split(), t.split()[1:])} for t in texts]
    df = Counter(g for s in grams for g in s)
    n = len(texts)
    idf = {g: math.log((1 + n) / (1 + c)) + 1 for g, c in df.items() if c >= 2}

    terms = features.ngrams_table(train, carry=["target_label"])
    vocab = features.fit_vocab(train, min_df=2, max_df=1.0)
    got = {r["term"]: r["idf"] for r in vocab.collect()}
    assert got == pytest.approx(idf)

    x = brute_tfidf(texts, idf)
    top = {g: max(c.get(g, 0.0) for c in x) for g in idf}
    weight = {k: n / (5 * labels.count(k)) for k in range(5)}
    alpha, v = 0.1, len(idf)
    log_prob = []
    for k in range(5):
        mass = {g: sum(weight[k] * c.get(g, 0.0) / top[g] for c, y in zip(x, labels) if y == k) for g in idf}
        total = sum(mass.values())
        log_prob.append({g: math.log(mass[g] + alpha) - math.log(total + alpha * v) for g in idf})

    weights = profile.class_weights(train)
    params = nb.nb_fit(features.tfidf(terms, vocab), weights, alpha)
    docs = held.select("doc_id", F.col("target_label").alias("y_true"))
    preds = nb.nb_predict(features.tfidf(features.ngrams_table(held), vocab), params, nb.nb_prior(weights), docs)
    rows = {r["doc_id"]: r for r in preds.collect()}
    assert len(rows) == 6
    for r, cells in zip(held.orderBy("doc_id").collect(), brute_tfidf([r["clean_text"] for r in held.orderBy("doc_id").collect()] [:5], idf)):
        joint = np.array([math.log(0.2) + sum(c / top[g] * log_prob[k][g] for g, c in cells.items()) for k in range(5)])
        proba = np.exp(joint - joint.max())
        assert rows[r["doc_id"]]["proba"] == pytest.approx(list(proba / proba.sum()))
    assert rows[1005]["proba"] == pytest.approx([0.2] * 5)  # no known term: the prior alone
    assert rows[1005]["y_pred"] == CLASSES[0]  # a draw goes to the first class


def test_vocabulary_ignores_heldout_rows_and_bounds_are_inclusive(spark, train):
    a = features.fit_vocab(train, min_df=3, max_df=0.95, max_features=12).collect()
    assert len(a) == 12
    assert [r["term_id"] for r in sorted(a, key=lambda r: r["term"])] == list(range(12))
    assert min(r["df"] for r in a) >= 3


def test_all_models_separate_the_classes(state, held):
    known = held.filter("doc_id < 1005")
    rows = scoring.score_all(known, state).collect()
    assert {r["model"] for r in rows} == {"Logistic_Regression", "Linear_SVM", "Naive_Bayes"}
    for r in rows:
        assert r["y_pred"] == r["target_label"], r
        assert sum(r["proba"]) == pytest.approx(1.0)


def test_squared_hinge_reaches_the_optimum(spark, train):
    """A stationary point of the stated objective, recomputed densely."""
    fitted = scoring.fit_text_model(train, kinds=[], min_df=1)
    x = scoring.features_of(train, fitted)
    size = fitted.vocab.count()
    table = linear.train_table(x, train, profile.class_weights(train), size)
    model = linear.svm_fit(table, tol=1e-8)
    assert model.gap <= 1e-8
    dense, y, w = [], [], []
    for r in table.rows.collect():
        row = np.zeros(size)
        row[r["features"]["indices"]] = r["features"]["values"]
        dense.append(row), y.append(int(r["label"])), w.append(r["weight"])
    dense, y, w = np.array(dense), np.array(y), np.array(w)
    coef = np.zeros((size, 5))
    for r in model.weights.collect():
        coef[r["term_id"]] = r["w"]
    bias = np.array(model.intercept)
    for k in range(5):
        sign = np.where(y == k, 1.0, -1.0)
        short = np.maximum(0, 1 - sign * (dense @ coef[:, k] + bias[k]))
        gradient = coef[:, k] - 2 * dense.T @ (w * sign * short)
        start = np.linalg.norm(2 * dense.T @ (w * sign))
        assert np.linalg.norm(gradient) < 1e-4 * start
        assert abs(bias[k] - 2 * np.sum(w * sign * short)) < 1e-3


def test_dual_fit_over_several_parts_has_the_same_optimum(spark, train, monkeypatch):
    """Parts that improve apart meet at the optimum of one part; the gap bounds how far off it can be."""
    fitted = scoring.fit_text_model(train, kinds=[], min_df=1)
    x = scoring.features_of(train, fitted)
    table = linear.train_table(x, train, profile.class_weights(train), fitted.vocab.count())
    whole = linear.svm_fit(table, tol=1e-5)
    monkeypatch.setattr(linear, "PART_ROWS", 20)
    parts = linear.svm_fit(table, tol=1e-3)
    a, b = ({r["term_id"]: r["w"] for r in m.weights.collect()} for m in (whole, parts))
    assert np.allclose([a[t] for t in sorted(a)], [b[t] for t in sorted(b)], atol=0.1)
    assert 0 <= parts.gap <= 1e-3
    with pytest.raises(linear.NotConverged):
        linear.svm_fit(table, max_rounds=2, tol=1e-9)


def test_rows_at_rest_are_left_out_of_most_epochs(monkeypatch):
    """A round visits rows that still move; its variables come as close to the optimum."""
    draw = np.random.default_rng(3)
    n, size = 600, 400
    x = draw.random((n, size)) * (draw.random((n, size)) < 0.1)
    label = draw.integers(0, 2, n).astype("int32")
    x[:, 0] = label  # most rows are told apart at once
    x[:, 1] = 1 - label
    ends = np.cumsum((x > 0).sum(axis=1)).astype("int64")
    columns = {
        "ids": np.nonzero(x)[1].astype("int32"), "xs": x[x > 0], "ends": ends, "label": label,
        "weight": np.ones(n), "fold": np.full(n, -1, "int32"),
    }
    rows = pa.table({"part": [0], **{name: [v.tobytes()] for name, v in columns.items()}})
    state = pa.table({"part": pa.array([], pa.int32()), "alpha": pa.array([], pa.binary())})
    visits, rng = [], np.random.default_rng

    class Counted:
        def __init__(self, seed):
            self.draw = rng(seed)

        def permutation(self, order):
            out = self.draw.permutation(order)
            visits.append(len(out))
            return out

    monkeypatch.setattr(linear.np.random, "default_rng", Counted)
    out = linear._improved(np.zeros((size + 1, 2)), np.zeros(2), size, 2, 1.0, linear.EPOCHS)((pa.scalar(0),), rows, state)
    assert sum(visits) < 0.6 * n * len(visits), visits
    alpha = np.frombuffer(out.column("alpha")[-1].as_py()).reshape(2, n, 2).sum(axis=0)
    sign = np.where(label[:, None] == np.arange(2), 1.0, -1.0)
    w = np.vstack([x.T @ (sign * alpha), (sign * alpha).sum(axis=0)])
    dual = (alpha - 0.25 * alpha * alpha).sum(axis=0) - 0.5 * (w * w).sum(axis=0)
    short = np.maximum(0.0, 1.0 - sign * (x @ w[:size] + w[size]))
    primal = 0.5 * (w * w).sum(axis=0) + (short**2).sum(axis=0)
    assert (alpha >= 0).all() and (dual >= 0.98 * primal).all(), (dual, primal)


def test_logistic_regression_reaches_the_optimum(spark, train):
    fitted = scoring.fit_text_model(train, kinds=["Logistic_Regression"], min_df=1)
    m = fitted.models["Logistic_Regression"]
    docs = train.select("doc_id", "target_label")
    x = scoring.features_of(train, fitted)
    rows = linear.predict(x, m, docs).collect()
    assert all(r["y_pred"] == r["target_label"] for r in rows)
    # At the optimum the weighted residuals of every class sum to zero (free intercepts).
    weight = {r["target_label"]: r["weight"] for r in profile.class_weights(train).collect()}
    for k, c in enumerate(CLASSES):
        residual = sum(weight[r["target_label"]] * (r["proba"][k] - (r["target_label"] == c)) for r in rows)
        assert abs(residual) < 0.05


def test_folds_are_stratified(spark, train):
    rows = train.withColumn("label", F.col("target_label")).select("doc_id", "label")
    sizes = linear.stratified_folds(rows, 3).groupBy("label", "fold").count().collect()
    for c in CLASSES:
        counts = [r["count"] for r in sizes if r["label"] == c]
        assert len(counts) == 3 and max(counts) - min(counts) <= 1


def test_sigmoids_stay_finite_on_separable_margins(spark):
    rows = [(f, float(j), 1.0, [2.0 if i == j else -2.0 for i in range(5)]) for f in range(3) for j in range(5)] * 4
    held = spark.createDataFrame(rows, "fold int, label double, weight double, margins array<double>")
    slope, offset = linear.fit_sigmoids(held, 5, 3)
    assert np.all(np.isfinite(slope)) and np.all(slope > 0) and np.all(np.abs(slope) < 10)


def test_state_round_trip(spark, state, held, tmp_path):
    st.save_state(spark, state, str(tmp_path), "augmented")
    loaded = st.load_state(spark, str(tmp_path), "augmented")
    before = {(r["model"], r["doc_id"]): r["proba"] for r in scoring.score_all(held, state).collect()}
    after = {(r["model"], r["doc_id"]): r["proba"] for r in scoring.score_all(held, loaded).collect()}
    assert set(before) == set(after)
    for key in before:
        assert after[key] == pytest.approx(before[key])


@pytest.mark.parametrize("batch", [1, 2, 32])
def test_batched_scoring_equals_relational(state, held, batch):
    expected = {r["doc_id"]: r["y_pred"] for r in scoring.score_all(held, state).filter("model = 'Logistic_Regression'").collect()}
    got = {r["doc_id"]: r["y_pred"] for r in scoring.score_batched(held, state, "Logistic_Regression", batch).collect()}
    assert got == expected


def test_double_weight_changes_the_machines_only(spark, train, state):
    other = scoring.fit_text_model(train, kinds=["Linear_SVM"], min_df=1, double_weight=True)
    assert other.models["Linear_SVM"].intercept != state.models["Linear_SVM"].intercept


def test_all_models_are_scored_in_one_pass(state, held):
    """One tokenisation and one scan of the features, however many models there are."""
    plan = scoring.score_all(held, state)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    each = {
        (r["model"], r["doc_id"]): r["proba"]
        for m in state.models.values()
        for r in linear.predict(scoring.features_of(held, state), m, held.select("doc_id")).collect()
    }
    for r in scoring.score_all(held, state).collect():
        assert r["proba"] == pytest.approx(each[r["model"], r["doc_id"]])


def test_logistic_regression_has_no_slope_left(spark, train):
    """Gradient of the stated objective by every weight and intercept, recomputed densely."""
    fitted = scoring.fit_text_model(train, kinds=["Logistic_Regression"], min_df=1)
    m, x, size = fitted.models["Logistic_Regression"], scoring.features_of(train, fitted), fitted.vocab.count()
    weight = {r["target_label"]: r["weight"] for r in profile.class_weights(train).collect()}
    label = {r["doc_id"]: r["target_label"] for r in train.select("doc_id", "target_label").collect()}
    place = {d: n for n, d in enumerate(sorted(label))}
    dense, coef = np.zeros((len(place), size)), np.zeros((size, 5))
    for r in x.collect():
        dense[place[r["doc_id"]], r["term_id"]] = r["x"]
    for r in m.weights.collect():
        coef[r["term_id"]] = r["w"]
    y = np.array([CLASSES.index(label[d]) for d in sorted(label)])
    w = np.array([weight[label[d]] for d in sorted(label)])
    z = dense @ coef + np.array(m.intercept)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    residual = w[:, None] * (p - np.eye(5)[y])
    start = np.linalg.norm(dense.T @ (w[:, None] * (0.2 - np.eye(5)[y])))
    assert np.linalg.norm(dense.T @ residual + coef) < 1e-2 * start
    assert np.abs(residual.sum(axis=0)).max() < 1e-2 * w.sum()


def test_projection_spans_the_principal_plane(spark):
    """Squared lengths in the plane equal those by a singular value decomposition."""
    draw = np.random.default_rng(8)
    data = draw.standard_normal((200, 6)) * np.array([5, 3, 1, 0.5, 0.2, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(data)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["x"], r["y"]) for r in embeddings.project_2d(df).collect()}
    axes = np.linalg.svd(data - data.mean(axis=0))[2][:2]
    for i, r in enumerate(data):
        assert np.abs(got[i]) == pytest.approx(np.abs(axes @ r), abs=1e-6)


def test_a_part_in_chunks_and_shares_equals_one_in_one_piece():
    """Chunks of a part and machines dealt to shares change neither the losses nor the steps."""
    draw = np.random.default_rng(5)
    n, size, k = 90, 40, 3
    x = (draw.random((n, size)) * (draw.random((n, size)) < 0.2)).astype("float32")
    x[7], x[-1] = 0, 0  # rows without a term
    label, weight = draw.integers(0, k, n).astype("int32"), draw.random(n) + 0.5

    def packed(cuts):
        out = {"part": [], "chunk": [], **{c: [] for c in ("ids", "xs", "ends", "label", "weight", "fold")}}
        for at, (u, v) in enumerate(zip(cuts, cuts[1:])):
            some = x[u:v]
            for name, value in (
                ("part", 4), ("chunk", at), ("ids", np.nonzero(some)[1].astype("uint16").tobytes()),
                ("xs", some[some > 0].tobytes()), ("ends", np.cumsum((some > 0).sum(axis=1)).astype("int64").tobytes()),
                ("label", label[u:v].tobytes()), ("weight", weight[u:v].tobytes()),
                ("fold", np.full(v - u, -1, "int32").tobytes()),
            ):
                out[name].append(value)
        return pa.table(out)

    state = pa.table({"part": pa.array([], pa.int32()), "alpha": pa.array([], pa.binary())})
    w = draw.normal(size=(size + 1, k))

    def run(rows, turns=None):
        out = linear._improved(w, np.zeros(k), size, k, 1.0, 20, 1e-3, turns)((pa.scalar(4),), rows, state)
        return {r["term_id"]: np.array(r["g"]) for r in out.to_pylist()}

    whole = run(packed([0, n]))
    pieces = run(packed([0, 8, 50, n]).take([2, 0, 1]))  # in any order
    shares = [run(packed([0, n]), [{4: m}]) for m in ([0, 2], [1])]
    dense = x @ w[:size] + w[size]
    sign = np.where(label[:, None] == np.arange(k), 1.0, -1.0)
    loss = (weight[:, None] * np.maximum(0, 1 - sign * dense) ** 2).sum(axis=0)
    assert np.allclose(whole[-1], loss, rtol=1e-6)
    for term, g in whole.items():
        assert np.allclose(g, pieces[term], atol=1e-9)
        assert np.allclose(g, sum(s.get(term, np.zeros(k)) for s in shares), atol=1e-9)


def test_no_two_parts_move_a_machine_at_a_time(spark, train, monkeypatch):
    """Each machine is at every part once a round, so parts do not undo each other's steps."""
    fitted = scoring.fit_text_model(train, kinds=[], min_df=1)
    x = scoring.train_features(train, fitted)
    table = linear.train_table(x, train, profile.class_weights(train), fitted.vocab.count())
    monkeypatch.setattr(linear, "PART_ROWS", 20)
    _, turns, n_parts = linear._parts(table.rows.withColumn("fold", F.lit(-1)), fitted.vocab.count(), 5)
    assert n_parts > 1 and all(
        len(busy := [m for some in turn.values() for m in some]) == len(set(busy)) for turn in turns
    )
    assert {m for turn in turns for some in turn.values() for m in some} == set(range(5))


def test_train_features_are_those_of_any_split(spark, train):
    """Written features are read again, but for ids with rows of two labels."""
    twice = train.unionByName(train.filter("doc_id = 3").withColumn("target_label", F.lit(CLASSES[4])))
    for df, reads in ((train, True), (twice, False)):
        fitted = scoring.fit_text_model(df, kinds=[], min_df=1)
        kept, anew = scoring.train_features(df, fitted), scoring.features_of(df, fitted)
        a, b = ({(r.doc_id, r.term_id): round(r.x, 9) for r in f.collect()} for f in (kept, anew))
        assert a == b and kept.columns == anew.columns
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert ("regexp_extract_all" not in plan) == reads
