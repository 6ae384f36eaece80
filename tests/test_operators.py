import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.constants import CLASSES, LABEL_MAP
from tocsin.operators import augment, embeddings, evaluate, experiments, labels, profile, sampling
from tocsin.operators.tables import top_n_per_group, with_ordinal


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one class, one text copied 4,000 times."""
    return spark.range(9000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, CLASSES[0]).otherwise(CLASSES[2]).alias("target_label"),
        F.when(F.col("id") < 4000, "the very same copied text again and again and more").otherwise(
            F.concat(F.lit("text number "), "id", F.lit(" here"))
        ).alias("text"),
    )


def test_label_map_covers_eleven_labels(spark):
    df = spark.createDataFrame([(k,) for k in LABEL_MAP] + [("new",), (None,)], "raw_label string")
    assert labels.map_labels(df).filter("target_label is null").count() == 2
    assert {r[0]: r[1] for r in labels.unmapped_labels(df).collect()} == {"new": 1, None: 1}


def test_absent_class_keeps_its_zero(spark):
    df = spark.createDataFrame([(CLASSES[0],), (CLASSES[0],), (None,)], "target_label string")
    rows = {r["target_label"]: r for r in profile.class_distribution(df).collect()}
    assert rows[CLASSES[0]]["n_rows"] == 2 and rows[CLASSES[0]]["pct"] == pytest.approx(66.666667)
    assert rows[CLASSES[4]]["n_rows"] == 0
    empty = profile.class_distribution(df.filter("false")).collect()
    assert [r["n_rows"] for r in empty] == [0] * 5


def test_histogram_of_a_single_length(spark):
    df = spark.createDataFrame([(CLASSES[0], 7)] * 3, "target_label string, n int")
    rows = profile.length_histogram(df, "n", 4).filter("n_rows > 0").collect()
    assert [(r["bin"], r["bin_start"], r["n_rows"]) for r in rows] == [(2, 7.0, 3)]


def test_ordinal_is_a_permutation_and_ignores_partitioning(skewed):
    a = with_ordinal(skewed, ["doc_id"], 7).select("doc_id", "ord")
    b = with_ordinal(skewed.repartition(13), ["doc_id"], 7).select("doc_id", "ord")
    assert {r[0]: r[1] for r in a.collect()} == {r[0]: r[1] for r in b.collect()}
    assert sorted(r["ord"] for r in a.collect()) == list(range(9000))


def test_ordinal_within_groups(skewed):
    rows = with_ordinal(skewed, ["doc_id"], 7, by=["target_label"]).groupBy("target_label").agg(
        F.min("ord"), F.max("ord"), F.countDistinct("ord"), F.count("*")
    )
    for r in rows.collect():
        assert r[1] == 0 and r[2] + 1 == r[3] == r[4]


@pytest.mark.parametrize("n", [3, 1500])
def test_top_n_is_exact_below_and_above_the_group_limit(skewed, n):
    rows = top_n_per_group(skewed, ["target_label"], [F.desc("doc_id")], n).collect()
    for c, ids in ((CLASSES[0], range(8997, -1, -3)), (CLASSES[2], [i for i in range(8999, -1, -1) if i % 3])):
        got = sorted((r["doc_id"] for r in rows if r["target_label"] == c), reverse=True)
        assert got == list(ids)[:n]


def test_hot_groups_are_cut_before_the_shuffle(skewed):
    for df in (
        sampling.sample_per_class(skewed, 2, 42),
        sampling.dedup_fingerprint(skewed, "text", ["doc_id"]),
    ):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dedup_keeps_first_arrival(spark):
    df = spark.createDataFrame(
        [(1, "One two three four five six seven eight tail"), (2, "one TWO three four five six seven eight x"),
         (3, "too short"), (4, "something else entirely new")],
        "arrival long, text string",
    )
    assert [r["arrival"] for r in sampling.dedup_fingerprint(df, "text", ["arrival"]).orderBy("arrival").collect()] == [1, 3, 4]
    assert [r["arrival"] for r in augment.accept_generated(df, ["arrival"]).orderBy("arrival").collect()] == [1, 4]


def test_only_good_rows_claim_a_fingerprint(spark):
    long = " ".join(["same"] * 70)
    df = spark.createDataFrame([(1, long), (2, " ".join(["same"] * 20))], "arrival long, text string")
    assert [r["arrival"] for r in augment.accept_generated(df, ["arrival"]).collect()] == [2]


def test_balanced_sample_raises_when_short(skewed):
    with pytest.raises(ValueError, match="Irrelevant"):
        sampling.balanced_sample(skewed, 2, 42)
    ok = sampling.balanced_sample(skewed, 2, 42, labels=[CLASSES[0], CLASSES[2]])
    assert sorted(r["ord"] for r in ok.collect()) == [0, 1, 2, 3]


def test_rotated_seeds_are_distinct_per_call(skewed):
    pool = skewed.filter("doc_id < 23").select("doc_id")
    rows = sampling.rotate_seeds(pool, 50, 5, 42).collect()
    assert len(rows) == 250
    calls = {}
    for r in rows:
        calls.setdefault(r["call_id"], set()).add(r["doc_id"])
    assert all(len(ids) == 5 for ids in calls.values())
    assert len({frozenset(v) for v in calls.values()}) > 40
    with pytest.raises(ValueError):
        sampling.rotate_seeds(pool.limit(4), 1, 5)


def test_augment_keeps_types_and_heldout_rows_out(spark):
    real = spark.createDataFrame(
        [(900000000000000001, "a b", CLASSES[0], "train", 3, 2), (2, "c", CLASSES[1], "test", 1, 1)],
        "doc_id long, clean_text string, target_label string, split string, text_length int, word_count int",
    )
    synthetic = spark.createDataFrame([("x y z", CLASSES[1])], "clean_text string, target_label string").withColumn(
        "split", F.lit("train")
    )
    rows = {r["clean_text"]: r for r in augment.augment_train(real, synthetic).collect()}
    assert set(rows) == {"a b", "x y z"}
    assert rows["a b"]["doc_id"] == 900000000000000001
    assert rows["x y z"]["doc_id"] is None and rows["x y z"]["word_count"] == 3
    assert rows["x y z"]["is_synthetic"] and not rows["a b"]["is_synthetic"]


def test_leakage_is_found(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, clean_text string")
    held = spark.createDataFrame([(3, "z"), (9, "b")], "doc_id long, clean_text string")
    rows = {r["kind"]: (r["n_keys"], r["n_train_rows"]) for r in augment.leakage_check(train, held).collect()}
    assert rows == {"id": (1, 1), "text": (1, 2)}


# --- evaluation ---------------------------------------------------------------


def preds(spark, pairs):
    return spark.createDataFrame(pairs, "y_true string, y_pred string")


def test_report_with_an_unseen_class(spark):
    a, b = CLASSES[0], CLASSES[1]
    df = preds(spark, [(a, a), (a, b), (b, b), (b, "ERROR")])
    report = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert report[a]["precision"] == 1.0 and report[a]["recall"] == 0.5
    assert report[b]["precision"] == 0.5 and report[b]["support"] == 2
    assert report[CLASSES[4]]["f1"] == 0.0 and report[CLASSES[4]]["support"] == 0
    every = evaluate.overall_metrics(df).first()
    seen = evaluate.overall_metrics(df, only_seen=True).first()
    assert every["macro_recall"] == pytest.approx(0.2) and seen["macro_recall"] == pytest.approx(0.5)
    assert every["accuracy"] == 0.5


def test_confusion_keeps_zero_cells_and_rows(spark):
    cm = evaluate.confusion(preds(spark, [(CLASSES[0], CLASSES[1])]))
    assert cm.count() == 25
    norm = {(r["y_true"], r["y_pred"]): r["share"] for r in evaluate.confusion_norm(cm).collect()}
    assert norm[CLASSES[0], CLASSES[1]] == 1.0 and norm[CLASSES[4], CLASSES[4]] == 0.0


def test_means_of_a_published_report(spark):
    # --- fixed values: a published five-class report and its means --------
    report = [
        ("Critical Rescue", 0.8820902188476999, 0.9113982464236271, 0.8965047662278711, 2167),
        ("Resource Requests", 0.5233644859813084, 0.5426356589147286, 0.532825880114177, 516),
        ("Volunteering and Donations", 0.8250763089927213, 0.8502298572465521, 0.8374642516682554, 4133),
        ("Situational Awareness", 0.8061245183532751, 0.7961145603845383, 0.8010882708585247, 4993),
        ("Irrelevant", 0.7207863123407353, 0.6822880771881461, 0.7010090281465746, 2902),
    ]
    published = {
        "macro": (0.751488368903148, 0.7565332800315184, 0.7537784394030806),
        "weighted": (0.7958865857268, 0.7969546597783971, 0.7962113840512259),
    }
    df = spark.createDataFrame(
        [(*row, 1) for row in report],
        "class string, precision double, recall double, f1 double, support long, predicted long",
    )
    means = evaluate.summarize_report(df).first()
    for kind, values in published.items():
        for metric, value in zip(("precision", "recall", "f1"), values):
            assert means[f"{kind}_{metric}"] == pytest.approx(value, abs=1e-9)


def test_curves_by_hand(spark):
    df = spark.createDataFrame(
        [("c", 0.9, True), ("c", 0.8, False), ("c", 0.8, True), ("c", 0.1, False), ("d", 0.5, False)],
        "class string, score double, positive boolean",
    )
    auc = {r["class"]: r["auc"] for r in evaluate.roc_auc(df).collect()}
    assert auc["c"] == pytest.approx(0.875) and auc["d"] is None
    ap = {r["class"]: r["average_precision"] for r in evaluate.average_precision(df).collect()}
    assert ap["c"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and ap["d"] == 0.0
    points = evaluate.roc(df).filter("class = 'c'").orderBy("fpr", "tpr").collect()
    assert [(r["fpr"], r["tpr"]) for r in points] == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]


def test_sliced_sums_equal_one_window(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("class"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("score"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0).alias("positive"),
    )
    rows = df.collect()
    points = evaluate.curve_points(df).collect()
    assert len(points) == len({(r["class"], r["score"]) for r in rows})
    for p in points[::7]:
        above = [r["positive"] for r in rows if r["class"] == p["class"] and r["score"] >= p["threshold"]]
        assert (p["tp"], p["fp"]) == (sum(above), len(above) - sum(above))


def test_curves_keep_scores_apart_that_agree_in_six_digits(spark):
    """Perfectly ranked probabilities far below one millionth."""
    df = spark.createDataFrame([("c", i * 1e-9, i >= 5) for i in range(10)], "class string, score double, positive boolean")
    assert evaluate.roc_auc(df).first()["auc"] == 1.0
    assert evaluate.average_precision(df).first()["average_precision"] == pytest.approx(1.0)


def test_nearest_ranks_what_six_digits_cannot_tell(spark):
    """Ten vectors at angles of 1e-4 to 1e-3: the last is nearest, and queries come in many blocks."""
    rows = [(i, [math.cos((10 - i) * 1e-4), math.sin((10 - i) * 1e-4)]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(7)], "query_id long, query_vec array<double>")
    for block in (256, 2):
        found = embeddings.nearest(df, queries, 3, block=block).collect()
        assert {(r["query_id"], r["rn"], r["vec_id"]) for r in found} == {
            (q, n + 1, 9 - n) for q in range(7) for n in range(3)
        }


def test_call_budget_goes_by_order(spark):
    df = spark.createDataFrame([(i, 1000 + 7 * (i // 4)) for i in range(40)], "arrival long, call_id long")
    assert [r["arrival"] for r in sampling.cap_rows(df, ["arrival"], 10, 5).collect()] == list(range(10))
    assert [r["arrival"] for r in sampling.cap_rows(df, ["arrival"], 30, 20).collect()] == list(range(12))
    made = spark.createDataFrame([(i,) for i in range(990, 1030)], "call_id long")
    assert sampling.cap_rows(df, ["arrival"], 30, 3, calls=made).count() == 12


def test_generated_lines_train_with_ids_of_their_own(spark, monkeypatch):
    lines = spark.createDataFrame(
        [(i, p, f"text {i} {p}", "Irrelevant", "train", True) for i in range(5) for p in range(4)],
        "arrival long, pos int, clean_text string, target_label string, split string, is_synthetic boolean",
    )
    real = spark.createDataFrame(
        [(i, f"real {i}", "Irrelevant", s, 1, 1) for i, s in enumerate(["train", "dev", "test"])],
        "doc_id long, clean_text string, target_label string, split string, text_length int, word_count int",
    )
    seen = {}

    def stop(train, **_):
        seen["ids"] = [r["doc_id"] for r in train.collect()]
        raise InterruptedError

    monkeypatch.setattr(experiments, "fit_text_model", stop)
    with pytest.raises(InterruptedError):
        experiments.grid_variant(real, lines, key=("arrival", "pos"))
    assert len(seen["ids"]) == len(set(seen["ids"])) == 21


def test_scored_summary_without_valid_rows(spark):
    df = preds(spark, [(CLASSES[0], "ERROR"), (CLASSES[0], "UNMATCHED")])
    row = evaluate.scored_summary(df).first()
    assert (row["n_valid"], row["n_skipped"], row["accuracy"]) == (0, 2, 0.0)


def test_dangerous_fn_without_urgent_rows(spark):
    row = evaluate.dangerous_fn(preds(spark, [(CLASSES[4], CLASSES[4])])).first()
    assert row["n_urgent"] == 0 and row["pct_dangerous"] == 0.0


def test_focal_loss_by_hand(spark):
    df = spark.createDataFrame([(CLASSES[0], [0.5, 0.1, 0.2, 0.1, 0.1])], "y_true string, proba array<double>")
    weights = spark.createDataFrame([(CLASSES[0], 2.0)], "target_label string, weight double")
    ce = -2 * math.log(0.5)
    assert evaluate.focal_loss(df, weights).first()["focal_loss"] == pytest.approx((1 - math.exp(-ce)) ** 2 * ce)


def test_cosine_and_nearest(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, query_vec array<double>")
    rows = embeddings.nearest(df, queries, 2).orderBy("rn").collect()
    assert [r["vec_id"] for r in rows] == [0, 1]
    assert [r["similarity"] for r in rows] == pytest.approx([1.0, 0.6], abs=1e-6)



def test_curves_keep_groups_without_a_name(spark):
    """A null in a grouping column is a group like any other."""
    rows = [(m, CLASSES[i % 2], [0.1 * (i % 7), 0.2, 0.0, 0.0, 0.0]) for m in (None, "a") for i in range(12)]
    preds = spark.createDataFrame(rows, "model string, y_true string, proba array<double>")
    points = evaluate.curve_points(evaluate.scores_long(preds, by=["model"]), ["model"])
    found = {r.model: r.n for r in points.groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert found[None] == found["a"] > 0


def test_nearest_multiplies_blocks_and_keeps_the_order_of_pairs(spark, monkeypatch):
    """Copies go by id, rows without a similarity come last, and no row per pair is made."""
    monkeypatch.setattr(embeddings, "SLICE", 7)
    draw = np.random.default_rng(1)
    data = [None, [], [0.0] * 3, [1.0, None, 2.0], [1.0, 2.0], *([[1.0, 2.0, 3.0]] * 4), *draw.standard_normal((30, 3)).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    queries = df.filter("vec_id in (2, 5, 20)").toDF("query_id", "query_vec")
    found = embeddings.nearest(df, queries, 36, block=2)
    assert "zip_with" not in found._jdf.queryExecution().toString()
    score = {}
    for q in (5, 20):
        for i, v in enumerate(data):
            if v and len(v) == 3 and None not in v and any(v):
                a, b = np.array(v), np.array(data[q])
                score[q, i] = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    got = {}
    for r in found.orderBy("query_id", "rn").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
    assert got[2] == [(i, None) for i in range(36)]
    for q in (5, 20):
        assert [i for i, _ in got[q]] == sorted(range(39), key=lambda i: (-round(score.get((q, i), -9), 12), i))[:36]
        assert all(s == (None if (q, i) not in score else pytest.approx(score[q, i])) for i, s in got[q])
