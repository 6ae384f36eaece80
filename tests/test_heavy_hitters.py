"""Bounded summaries against plain counting, and what the plans shuffle."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tocsin.functions.gram_counts import gram_counts
from tocsin.operators import features, heavy_hitters
from tocsin.operators.heavy_hitters import frequent_terms
from tocsin.plans import fixtures as fx
from tocsin.plans.queries import QUERIES
from tocsin.session import cluster_by, write_bucketed


def corpus(n, words, seed=1, most=30):
    draw = random.Random(seed)
    names = [f"w{i:04d}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(draw.choices(names, weights, k=draw.randint(0, most)))) for i in range(n)]


def plain(rows, lo=1, hi=2):
    cnt, df = Counter(), Counter()
    for _, text in rows:
        words = (text or "").split()
        grams = [" ".join(words[i : i + n]) for n in range(lo, hi + 1) for i in range(len(words) - n + 1)]
        cnt.update(grams)
        df.update(set(grams))
    return {t: (cnt[t], df[t]) for t in cnt}


def top(counted, size):
    return dict(sorted(counted.items(), key=lambda x: (-x[1][0], x[0]))[:size])


@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 2), (2, 2), (1, 3)])
def test_without_overflow_every_count_is_exact(spark, lo, hi):
    rows = [*corpus(200, 50), (999, None), (998, "")]
    df = spark.createDataFrame(rows, "doc_id long, clean_text string")
    got = {r.term: (r.cnt, r.df) for r in frequent_terms(df, 10, lo=lo, hi=hi).collect()}
    assert got == plain(rows, lo, hi)


@pytest.mark.parametrize("capacity", [20, 60, 200])
def test_overflow_keeps_the_top_exact(spark, capacity, monkeypatch):
    """Small summaries forget terms; the top is the same, with the same counts, ties included."""
    passes = []
    monkeypatch.setattr(heavy_hitters, "_exact", lambda *a, f=heavy_hitters._exact: passes.append(1) or f(*a))
    rows = corpus(1500, 600, seed=capacity)
    df = spark.createDataFrame(rows, "doc_id long, clean_text string").repartition(4)
    counted = {r.term: (r.cnt, r.df) for r in frequent_terms(df, 15, lo=1, hi=1, capacity=capacity).collect()}
    true = plain(rows, 1, 1)
    assert all(true[t] == c for t, c in counted.items())
    assert top(counted, 15) == top(true, 15)
    assert passes or capacity == 200


def test_bounds_on_documents(spark):
    """A term outside the bounds takes nobody's place, with and without forgetting."""
    rows = corpus(1500, 600)
    df = spark.createDataFrame(rows, "doc_id long, clean_text string").repartition(4)
    true = {t: c for t, c in plain(rows, 1, 1).items() if 3 <= c[1] <= 0.2 * len(rows)}
    for capacity in (40, 100, 10_000):
        vocab = features.fit_vocab(df, 3, 0.2, 12, hi=1, capacity=capacity).collect()
        assert {r.term: (r.cnt, r.df) for r in vocab} == top(true, 12)


def test_same_as_from_the_long_table(spark):
    train = fx.split_of(fx.processed_table(spark, SF), "train")
    one = features.fit_vocab(train, max_features=500, capacity=4000)
    two = features.fit_vocab_of_terms(features.ngrams_table(train), train, max_features=500)
    one, two = ({r.term: (r.term_id, r.df, r.cnt, round(r.idf, 9)) for r in v.collect()} for v in (one, two))
    assert one == two and len(one) == 500


def test_more_terms_wanted_than_there_are(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "bb cc")], "doc_id long, clean_text string")
    assert {r.term for r in features.fit_vocab(df, 1, 1.0, 100, hi=1, capacity=1).collect()} == {"aa", "bb", "cc"}
    assert features.fit_vocab(df.limit(0), 1, 1.0, 100).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(df))


def test_the_vocabulary_shuffles_summaries_only(spark):
    train = fx.split_of(fx.processed_table(spark, SF), "train")
    plan = plan_of(features.fit_vocab(train))
    assert "Generate" not in plan and "regexp_extract_all" not in plan


def test_bucketed_texts_are_not_shuffled(spark):
    """Features of a bucketed table need no exchange by document; of another they do."""
    table = fx.processed_table(spark, SF)
    train = fx.split_of(table, "train")
    vocab = features.fit_vocab(train)
    for df in (
        features.ngrams_table(train),
        features.ngrams_table(train, carry=["target_label"]),
        features.tfidf(features.ngrams_table(train), vocab),
    ):
        assert not [e for e in exchanges(df) if "doc_id" in e], plan_of(df)
    other = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("clean_text"))
    assert [e for e in exchanges(features.ngrams_table(other)) if "doc_id" in e]


def test_buckets(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"), F.lit("x").alias("v"))
    table = spark.table(write_bucketed(df, str(tmp_path / "t"), "k", "s", 4))
    assert table.count() == 1000
    assert not exchanges(table.filter("s = 1").groupBy("k").count())
    assert cluster_by(table, "k") is table and cluster_by(df, "k") is not df
    assert len(list((tmp_path / "t").glob("s=*/*.parquet"))) == 12
    both = table.alias("a").join(table.alias("b"), "k").hint("merge")
    assert not exchanges(both)


def test_only_terms_of_the_vocabulary_are_counted(spark):
    rows = [(1, "aa bb aa bb cc"), (2, "cc dd"), (3, "dd"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, clean_text string")
    vocab = spark.createDataFrame([(0, "aa bb", 1.5), (1, "cc", 2.0)], "term_id int, term string, idf double")
    terms = features.ngrams_table(df, vocab=vocab)
    assert {(r.doc_id, r.term, r.tf) for r in terms.collect()} == {(1, "aa bb", 2), (1, "cc", 1), (2, "cc", 1)}
    assert sorted(features.tfidf(terms, vocab).collect()) == sorted(features.tfidf(features.ngrams_table(df), vocab).collect())


def test_the_profile_reads_written_features(spark):
    """The scaler and the profile both read the features; the n-grams are made once."""
    assert "regexp_extract_all" not in plan_of(QUERIES["F7_matrix_profile"](spark, SF))


@pytest.mark.parametrize("gathered", [features.GATHERED, 40, 0])
@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 2), (2, 3)])
def test_a_document_is_counted_on_its_own(spark, lo, hi, gathered, monkeypatch):
    """The same counts of gathered and of long documents; ids repeat, are null or have no words."""
    monkeypatch.setattr(features, "GATHERED", gathered)
    rows = [(i % 40 or None, "ab"[i % 2], text) for i, text in corpus(120, 12)]
    rows += [(7, "a", None), (77, "a", None), (78, "b", ""), (79, None, "x")]
    true = Counter()
    for i, label, text in rows:
        true.update({(i, label, t): c for t, (c, _) in plain([(i, text)], lo, hi).items() if text != "x"})
    df = spark.createDataFrame(rows, "doc_id long, target_label string, clean_text string")
    terms = features.ngrams_table(df, lo, hi, carry=["target_label"], batched=True)
    assert terms.columns == ["doc_id", "target_label", "term", "tf"]
    got = [((r.doc_id, r.target_label, r.term), r.tf) for r in terms.collect()]
    assert len(got) == len(true) and dict(got) == dict(true)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_slices_of_a_batch(size):
    """However the words of a batch are cut, documents stay whole; texts do not run into each other."""
    texts = [["aa bb aa bb", "bb"], [], [""], ["bb aa", "", "é aa"] * 3, ["cc"]] * 4
    words = [[t.split() for t in document] for document in texts]
    known = [None] * len(words)
    known[4] = "xx"  # counted already
    rows = {"k": range(len(words)), "_term": pa.array(known, pa.string()), "_tf": range(len(words)), "_texts": words}
    [batch] = pa.table(rows).to_batches()
    got = [r for b in gram_counts(["k"], 1, 2, size)([batch, batch.slice(7, 0)]) for r in b.to_pylist()]
    true = {(4, "xx"): 4}
    for k, document in enumerate(words):
        if k != 4:
            true |= {(k, g): c for g, c in Counter(g for t in document for g in [*t, *map(" ".join, zip(t, t[1:]))]).items()}
    assert len(got) == len(true) and {(r["k"], r["term"]): r["tf"] for r in got} == true


def test_no_task_keeps_the_counts_of_a_partition(spark):
    """Short documents are one row each where rows are grouped, not one per n-gram."""
    plan = plan_of(QUERIES["F1_ngrams"](spark, SF))
    assert "MapInArrow" in plan
    assert not re.findall(r"HashAggregate\(keys=\[doc_id#\d+L?, term#", plan)


def test_batched_counts_of_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "aa bb aa bb cc"), (2, "cc dd")], "doc_id long, clean_text string")
    vocab = spark.createDataFrame([(0, "aa bb", 1.5), (1, "cc", 2.0)], "term_id int, term string, idf double")
    terms = features.ngrams_table(df, vocab=vocab, batched=True)
    assert sorted(terms.collect()) == sorted(features.ngrams_table(df, vocab=vocab).collect())


@pytest.mark.parametrize("name", ["F3_tfidf", "F4_tfidf_plain", "F5_transform", "F6_maxabs"])
def test_features_count_the_vocabulary_only(spark, name):
    """Terms outside the vocabulary leave before they are counted."""
    plan = plan_of(QUERIES[name](spark, SF))
    assert plan.count("LeftSemi") == plan.count("explode(concat(") > 0


@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 2), (2, 3)])
def test_listed_terms_are_counted_as_through_the_filter(spark, lo, hi, monkeypatch):
    """Exact counts of candidates looked up as numbers, and of those that pass the filter, are the plain ones."""
    rows = [*corpus(1500, 600, seed=7), (9001, None), (9002, ""), (9003, "w0001")]
    df = spark.createDataFrame(rows, "doc_id long, clean_text string").repartition(3)
    true = plain(rows, lo, hi)
    for most in (1 << 20, 0):
        monkeypatch.setattr(heavy_hitters, "LISTED", most)
        got = {r.term: (r.cnt, r.df) for r in frequent_terms(df, 15, lo=lo, hi=hi, capacity=60).collect()}
        assert all(true[t] == c for t, c in got.items())
        assert top(got, 15) == top(true, 15)
    monkeypatch.setattr(heavy_hitters, "SLICE", 500)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], ["words"])
    wanted = sorted(true)[::3]
    counted = heavy_hitters._listed([batch, batch.slice(0, 0)], lo, hi, pa.array([*wanted, "no such term"])).to_pydict()
    assert dict(zip(counted["term"], zip(counted["cnt"], counted["df"]))) == {t: true[t] for t in wanted}
