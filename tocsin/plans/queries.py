"""Registered queries: one or more per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tocsin.constants import ALPHAS, CLASSES, RESPONSE_LABELS
from tocsin.functions import text as tx
from tocsin.functions.keys import key_to_long
from tocsin.functions.romanize import LATIN_ACCENTS
from tocsin.operators import augment, embeddings, evaluate, experiments, features, labels
from tocsin.operators import naive_bayes as nb
from tocsin.operators import neighbours, profile, projection, sampling, scoring
from tocsin.operators.linear import calibrate, lr_fit, predict, svm_fit, train_table
from tocsin.operators.romanize import romanize_table
from tocsin.plans import fixtures as fx
from tocsin.session import materialize, scratch_path
from tocsin.sources import messages as src
from tocsin.sources import reports, state
from tocsin.functions.permutation import permuted
from tocsin.streaming import dedup, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _checksum(col: str):
    return F.sum(key_to_long(F.md5(col)))


# --- A: sources and sinks ---------------------------------------------------


PHASE_MODELS = {0.1: "Naive_Bayes_tuned", 1.0: "Naive_Bayes_base"}  # by smoothing


def _placed(df, *order):
    """The small ordered table with the position of every row."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))


@query
def A1_read_messages_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    src.write_messages_tsv(fx.messages(spark, sf), path)
    return src.read_messages_tsv(spark, path).groupBy("event_set", "event", "split").agg(
        F.count("*").alias("n_rows"),
        F.count("class_label").alias("n_labelled"),
        F.sum(F.length("tweet_text")).alias("n_chars"),
        _checksum("tweet_text").alias("text_sum"),
        F.sum("tweet_id").alias("id_sum"),
    )


@query
def A2_concat_sources(spark, sf):
    m = fx.messages(spark, sf)
    both = m.filter(F.col("event_set") == "set1").unionByName(m.filter(F.col("event_set") == "set2"))
    return both.groupBy("event_set", "split").agg(F.count("*").alias("n_rows"))


@query
def A3_missing_sources(spark, sf):
    m = fx.messages(spark, sf)
    expected = m.select(F.lit("set1").alias("event_set"), "event").distinct()
    return src.missing_sources(expected, m)


@query
def A4_write_read_messages(spark, sf):
    return fx.processed_table(spark, sf).groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.sum("text_length").alias("n_chars"),
        F.sum("word_count").alias("n_words"),
        _checksum("clean_text").alias("text_sum"),
    )


@query
def A5_read_presplit(spark, sf):
    rows = fx.table(spark, sf, "conversations").select(
        "conv_id",
        F.col("text").alias("message"),
        tx.clean_text("text").alias("clean_text"),
        F.col("role").alias("target_label"),
    )
    digit = F.col("conv_id") % 10
    parts = {"train": digit > 2, "validation": digit == 0, "test": digit.isin(1, 2)}
    paths = {}
    for split, condition in parts.items():
        paths[split] = scratch_path(spark, f"presplit-{split}")
        src.export_csv(rows.filter(condition).drop("conv_id"), paths[split])
    return src.read_presplit(spark, paths).groupBy("split", "target_label").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.length("text")).alias("n_chars"),
        _checksum("text").alias("text_sum"),
        _checksum("clean_text").alias("clean_sum"),
    )


@query
def A6_read_eval_set(spark, sf):
    m = labels.map_labels(fx.messages(spark, sf), fx.label_map())
    other = experiments.labelled(m)
    path = scratch_path(spark, "evalset")
    src.export_csv(other.select("text", F.col("target_label").alias("label")), path)
    return src.read_eval_set(spark, path, "other").groupBy("target_label", "lang").agg(
        F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"), _checksum("text").alias("text_sum")
    )


@query
def A7_report_json(spark, sf):
    path = scratch_path(spark, "report")
    reports.write_table(reports.report_to_json(fx.centroid_preds(spark, sf), ["model"]), path, "json")
    stored = spark.read.schema("model STRING, report STRING").json(path)
    return evaluate.rounded(reports.report_from_json(stored, ["model"]))


@query
def A8_write_errors_csv(spark, sf):
    path = scratch_path(spark, "errors")
    wrong = evaluate.errors(fx.centroid_preds(spark, sf)).drop("proba")
    reports.write_table(wrong, path)
    schema = "model STRING, doc_id LONG, y_true STRING, y_pred STRING"
    return spark.read.schema(schema).options(header=True).csv(path)


@query
def A9_save_load_state(spark, sf):
    table = fx.processed_table(spark, sf)
    fitted = scoring.fit_text_model(fx.split_of(table, "train"), kinds=["Naive_Bayes"])
    path = scratch_path(spark, "state")
    state.save_state(spark, fitted, path, "real")
    loaded = state.load_state(spark, path, "real")
    return scoring.score_all(fx.split_of(table, "test"), loaded).select("doc_id", "target_label", "y_pred")


# --- B: projections, filters, text ------------------------------------------


@query
def B1_map_labels(spark, sf):
    return labels.map_labels(fx.messages(spark, sf), fx.label_map()).select("doc_id", "raw_label", "target_label")


@query
def B2_unmapped_labels(spark, sf):
    return labels.unmapped_labels(fx.messages(spark, sf), fx.label_map())


@query
def B3_mapping_summary(spark, sf):
    return labels.mapping_summary(labels.map_labels(fx.messages(spark, sf), fx.label_map()))


@query
def B4_clean_text(spark, sf):
    return fx.documents(spark, sf, "doc_id", "text").select("doc_id", tx.clean_text("text").alias("clean_text"))


@query
def B4_clean_pages(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", tx.clean_text("html").alias("clean_text"))


@query
def B4_clean_marked_up(spark, sf):
    """Documents inside a retweet, mention, tag, entity and link."""
    wrapped = F.concat(
        F.lit("RT @user"), F.col("doc_id"), F.lit(": #Flood &lt;b&gt; &amp; "), F.col("text"), F.lit(" http://t.co/x y")
    )
    return fx.documents(spark, sf, "doc_id", "text").select("doc_id", tx.clean_text(wrapped).alias("clean_text"))


@query
def B5_drop_empty(spark, sf):
    links_only = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("http://t.co/"), "doc_id")).otherwise(F.col("text"))
    rows = fx.documents(spark, sf, "doc_id", "text").withColumn("text", links_only)
    return profile.empty_audit(rows, tx.clean_text("text"))


@query
def B6_add_lengths(spark, sf):
    return fx.processed(spark, sf).select("doc_id", "text_length", "word_count")


@query
def B7_null_text(spark, sf):
    rows = fx.messages(spark, sf).select("doc_id", F.when(F.col("raw_label").isNotNull(), F.col("text")).alias("text"))
    return rows.select("doc_id", F.length(tx.clean_text("text")).alias("text_length"))


@query
def B8_encode_label(spark, sf):
    mapped = labels.map_labels(fx.messages(spark, sf), fx.label_map()).select("doc_id", "target_label")
    return labels.decode_label(labels.encode_label(mapped), out="decoded").select(
        "doc_id", "target_label", "label", "decoded"
    )


@query
def B9_split_rows(spark, sf):
    return labels.split_rows(fx.messages(spark, sf), "test").select("doc_id", "event", "split")


@query
def B10_strip_list_markers(spark, sf):
    digit = F.col("doc_id") % 3
    listed = (
        F.when(digit == 0, F.concat(F.lit(" - "), "text"))
        .when(digit == 1, F.concat(F.lit('12. "'), "text", F.lit("\" '")))
        .otherwise(F.col("text"))
    )
    return fx.documents(spark, sf, "doc_id", "text").select("doc_id", tx.strip_list_markers(listed).alias("stripped"))


@query
def B11_is_good_row(spark, sf):
    opened = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Here are "), "text")).otherwise(F.col("text"))
    return fx.documents(spark, sf, "doc_id", "text").select(
        "doc_id", tx.is_good_row(opened).alias("good"), tx.is_good_row(opened, 4, 400).alias("good_wide")
    )


@query
def B12_match_label(spark, sf):
    mapped = labels.map_labels(fx.messages(spark, sf), fx.label_map()).withColumn("clean_text", F.col("text"))
    return fx.answers(experiments.labelled(mapped)).select(
        "experiment", "doc_id", tx.match_label("response", RESPONSE_LABELS).alias("y_pred")
    )


@query
def B13_generation_prompts(spark, sf):
    seeds = _seeds(spark, sf)
    return augment.generation_prompts(seeds, "Write ten posts like these:\n{seeds}\nOne per line.")


@query
def B13_classification_prompts(spark, sf):
    rows = fx.processed(spark, sf).select("doc_id", "clean_text")
    return augment.classification_prompts(rows, "Name one class.", "Message: {text}\nClass:").drop("clean_text")


@query
def B14_excerpt(spark, sf):
    return fx.documents(spark, sf, "doc_id", "text").select(
        "doc_id", tx.excerpt("text", 80, ascii_only=True).alias("ascii_80"), tx.excerpt("text", 140).alias("first_140")
    )


@query
def B15_content_words(spark, sf):
    return profile.content_words(fx.processed(spark, sf)).groupBy("target_label").agg(
        F.count("*").alias("n_words"), F.countDistinct("word").alias("n_distinct")
    )


@query
def B16_correct(spark, sf):
    return evaluate.add_correct(fx.centroid_preds(spark, sf)).select("model", "doc_id", "correct")


@query
def B17_romanize(spark, sf):
    return romanize_table(fx.documents(spark, sf, "doc_id", "text"), LATIN_ACCENTS).select("doc_id", "romanized")


@query
def B17_romanize_malayalam(spark, sf):
    """Texts whose letters a-z are written as Malayalam letters, signs, viramas and joiners, romanised."""
    docs = fx.documents(spark, sf, "doc_id", "text")
    native = docs.withColumn("text", F.translate(F.lower("text"), fx.LATIN, fx.AS_MALAYALAM))
    return romanize_table(native).select("doc_id", "romanized")


# --- C: aggregation and profiling ---------------------------------------------


@query
def C1_dataset_summary(spark, sf):
    return profile.dataset_summary(fx.messages(spark, sf))


@query
def C2_null_counts(spark, sf):
    mapped = labels.map_labels(fx.messages(spark, sf), fx.label_map())
    return profile.null_counts(mapped, ["doc_id", "text", "event", "lang", "raw_label", "target_label"])


@query
def C3_value_counts(spark, sf):
    return _placed(profile.value_counts(fx.messages(spark, sf), "raw_label"), F.desc("n_rows"), "raw_label")


@query
def C4_class_distribution(spark, sf):
    return profile.class_distribution(fx.processed(spark, sf))


@query
def C5_imbalance(spark, sf):
    return profile.imbalance(fx.processed(spark, sf))


@query
def C6_length_stats(spark, sf):
    return profile.length_stats(fx.processed(spark, sf))


@query
def C7_char_histogram(spark, sf):
    return profile.length_histogram(fx.processed(spark, sf), "text_length", 50)


@query
def C7_word_histogram(spark, sf):
    return profile.length_histogram(fx.processed(spark, sf), "word_count", 40)


@query
def C8_crosstab(spark, sf):
    return profile.event_class_crosstab(fx.processed(spark, sf))


@query
def C8_crosstab_share(spark, sf):
    return profile.event_class_crosstab(fx.processed(spark, sf), normalize=True)


@query
def C9_top_words(spark, sf):
    return profile.top_words(fx.processed(spark, sf), 20)


@query
def C10_split_balance(spark, sf):
    return profile.split_balance(fx.processed(spark, sf))


@query
def C11_augmentation_summary(spark, sf):
    return profile.augmentation_summary(_augmented(spark, sf))


@query
def C12_generation_yield(spark, sf):
    rows = fx.generated(spark, sf)
    kept = augment.accept_generated(rows, ["arrival"], min_words=4, max_words=400)
    return augment.generation_yield(rows, kept)


@query
def C12_yield_summary(spark, sf):
    rows = fx.generated(spark, sf)
    kept = augment.accept_generated(rows, ["arrival"])
    return augment.yield_summary(augment.generation_yield(rows, kept))


@query
def C13_class_weights(spark, sf):
    weights = profile.class_weights(fx.split_of(fx.processed(spark, sf), "train"))
    return weights.withColumn("weight", F.round("weight", 6))


@query
def C14_sample_weights(spark, sf):
    rows = profile.sample_weights(fx.split_of(fx.processed(spark, sf), "train"))
    return rows.select("doc_id", "target_label", F.round("weight", 6).alias("weight"))


@query
def C14_mean_sample_weight(spark, sf):
    return profile.mean_sample_weight(fx.split_of(fx.processed(spark, sf), "train"))


# --- D: sampling, order, limits -------------------------------------------------


@query
def D1_sample_per_class(spark, sf):
    return sampling.sample_per_class(fx.processed(spark, sf), 2, 42).select("target_label", "doc_id", "event")


@query
def D2_balanced_sample(spark, sf):
    rows = fx.split_of(fx.processed(spark, sf), "test")
    return sampling.balanced_sample(rows, 2, 42, strict=False).select("ord", "target_label", "doc_id")


@query
def D2_class_shortages(spark, sf):
    return sampling.class_shortages(fx.split_of(fx.processed(spark, sf), "test"), 10)


@query
def D3_shuffle(spark, sf):
    return sampling.shuffle(fx.messages(spark, sf).select("doc_id", "event"), 42)


@query
def D3_permute(spark, sf):
    """Every document's place in a shuffled order, computed from its number alone."""
    docs = fx.table(spark, sf, "documents").select("doc_id")
    n = docs.agg(F.max("doc_id")).first()[0]
    size = F.lit(0 if n is None else n + 1).cast("long")
    return docs.select("doc_id", permuted(F.col("doc_id"), size, 42).alias("position"))


@query
def D4_sample_n(spark, sf):
    rows = labels.split_rows(fx.processed(spark, sf), "test").select("doc_id", "target_label", "lang")
    home = sampling.sample_n(rows.filter(F.col("lang") == "en"), 20, 42)
    other = sampling.sample_n(rows.filter(F.col("lang") != "en"), 20, 42)
    return home.unionByName(other).na.drop()


def _seeds(spark, sf):
    pool = fx.split_of(fx.processed(spark, sf), "train").filter(F.col("target_label") == "Situational Awareness")
    return sampling.rotate_seeds(pool.select("doc_id", "clean_text"), 750, 5, 42)


@query
def D5_rotate_seeds(spark, sf):
    return _seeds(spark, sf).select("call_id", "slot", "doc_id")


@query
def D6_dedup_fingerprint(spark, sf):
    rows = sampling.dedup_fingerprint(fx.generated(spark, sf), "text", ["arrival"])
    return rows.select("arrival", "fingerprint")


@query
def D6_accept_generated(spark, sf):
    """Each line of a document as one generated row, as responses arrive."""
    lines = augment.response_lines(fx.generated(spark, sf), "text", "arrival").withColumnRenamed("line", "pos")
    return augment.accept_generated(lines, ["arrival", "pos"]).select("arrival", "pos", "fingerprint")


@query
def D7_cap_rows(spark, sf):
    """The target cuts: more rows are accepted within the calls."""
    return _capped(spark, sf, 200, 10)


@query
def D7_call_budget(spark, sf):
    """The budget cuts: the calls are spent before the target is reached."""
    return _capped(spark, sf, 200, 40)


def _capped(spark, sf, target, per_call):
    """Calls are numbered from 1,000, as the budget goes by their order."""
    rows = fx.generated(spark, sf).withColumn("call_id", F.col("call_id") + 1000)
    kept = augment.accept_generated(rows, ["arrival"], max_words=400)
    return sampling.cap_rows(kept, ["arrival"], target, per_call, calls=rows).select("arrival", "call_id")


@query
def D8_head_examples(spark, sf):
    wrong = evaluate.dangerous_rows(fx.centroid_preds(spark, sf))
    return sampling.head_examples(wrong, 8, ["model", "doc_id"]).drop("proba")


@query
def D9_sorted_results(spark, sf):
    """Results by model and phase, in a stated order that the rank column records."""
    board = evaluate.leaderboard(fx.centroid_preds(spark, sf))
    return _placed(board, F.desc("macro_f1"), "model").select("model", "macro_f1", "position")


@query
def D10_best_alpha(spark, sf):
    return sampling.best_row(_sweep(spark, sf), "macro_f1", "alpha")


# --- E: joins and set operations --------------------------------------------------


@query
def E1_lookup_join(spark, sf):
    mapped = labels.map_labels(fx.messages(spark, sf), fx.label_map())
    return labels.encode_label(mapped).groupBy("event_set", "label").agg(F.count("*").alias("n_rows"))


@query
def E2_side_by_side(spark, sf):
    p = fx.processed(spark, sf)
    return profile.counts_side_by_side(labels.split_rows(p, "train"), labels.split_rows(p, "test"), "event")


@query
def E3_attach_predictions(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.get(F.array(*[F.lit(c) for c in CLASSES]), F.col("label") % len(CLASSES)).alias("target_label"),
    )
    preds = fx.centroid_preds(spark, sf).select("model", "doc_id", "y_pred")
    return evaluate.attach_predictions(rows, preds)


DELTA_PAIRS = [
    ("macro avg", "f1"), ("weighted avg", "f1"), ("Critical Rescue", "recall"),
    ("Resource Requests", "recall"), ("Irrelevant", "recall"), ("Situational Awareness", "recall"),
]


@query
def E4_report_delta(spark, sf):
    preds = fx.centroid_preds(spark, sf)
    a = evaluate.full_long_report(preds.filter(F.col("model") == "euclid"))
    b = evaluate.full_long_report(preds.filter(F.col("model") == "cosine"))
    return evaluate.rounded(evaluate.report_delta(a, b, DELTA_PAIRS))


def _augmented(spark, sf):
    synthetic = augment.generated_rows(fx.generated(spark, sf), ["arrival"], max_words=400)
    real = fx.processed(spark, sf).withColumn("arrival", F.lit(None).cast("long"))
    return augment.augment_train(real, synthetic)


@query
def E5_augment_train(spark, sf):
    return _augmented(spark, sf).select(
        "doc_id", "arrival", "target_label", "split", "event", "is_synthetic", "text_length", "word_count"
    )


@query
def E6_union_results(spark, sf):
    p = fx.processed(spark, sf)
    home = p.filter(F.col("lang") == "en").select("doc_id", "target_label", F.lit("home").alias("language"))
    other = p.filter(F.col("lang") != "en").select(
        "doc_id", F.col("target_label").alias("label"), F.lit("other").alias("language")
    )
    both = home.unionByName(other.withColumnRenamed("label", "target_label")).na.drop()
    return both.groupBy("language", "target_label").agg(F.count("*").alias("n_rows"))


@query
def E7_leakage_check(spark, sf):
    p = fx.processed(spark, sf)
    train = labels.split_rows(p, "train")
    return augment.leakage_check(train, p.filter(F.col("split") != "train"))


# --- F: features and models ---------------------------------------------------------


def _train_terms(spark, sf, **bounds):
    """The vocabulary of the train table and the counts of its terms there."""
    train = fx.split_of(fx.processed_table(spark, sf), "train")
    vocab = materialize(features.fit_vocab(train, **bounds), "vocab")
    return vocab, features.ngrams_table(train, carry=["target_label"], vocab=vocab)


@query
def F1_ngrams(spark, sf):
    grams = features.ngrams_table(fx.processed(spark, sf), batched=True)
    return grams.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"),
        F.sum("tf").alias("n_grams"),
        F.sum(key_to_long(F.md5("term")) * F.col("tf")).alias("term_sum"),
    )


@query
def F2_vocab(spark, sf):
    return evaluate.rounded(features.fit_vocab(fx.split_of(fx.processed_table(spark, sf), "train")))


@query
def F3_tfidf(spark, sf):
    vocab, terms = _train_terms(spark, sf)
    x = features.tfidf(terms, vocab)
    return x.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.round(F.sum("x"), 6).alias("sum_x"), F.round(F.max("x"), 6).alias("max_x")
    )


@query
def F4_tfidf_plain(spark, sf):
    vocab, terms = _train_terms(spark, sf, min_df=1, max_df=1.0, max_features=10_000)
    x = features.tfidf(terms, vocab, sublinear=False)
    return x.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.round(F.sum("x"), 6).alias("sum_x"), F.round(F.max("x"), 6).alias("max_x")
    )


@query
def F5_transform(spark, sf):
    p = fx.processed_table(spark, sf)
    train, test = fx.split_of(p, "train"), fx.split_of(p, "test")
    vocab = materialize(features.fit_vocab(train), "vocab")
    return evaluate.rounded(features.tfidf(features.ngrams_table(test, vocab=vocab), vocab))


@query
def F6_maxabs(spark, sf):
    p = fx.processed_table(spark, sf)
    train, test = fx.split_of(p, "train"), fx.split_of(p, "test")
    vocab = materialize(features.fit_vocab(train), "vocab")
    scale = features.fit_maxabs(features.tfidf(features.ngrams_table(train, vocab=vocab), vocab))
    terms = features.ngrams_table(test, vocab=vocab)
    return evaluate.rounded(features.apply_maxabs(features.tfidf(terms, vocab), scale))


@query
def F7_matrix_profile(spark, sf):
    train = fx.split_of(fx.processed_table(spark, sf), "train")
    vocab = materialize(features.fit_vocab(train), "vocab")
    # Written, as the scaler and the profile both read it.
    x = materialize(features.tfidf(features.ngrams_table(train, vocab=vocab), vocab), "tfidf")
    return features.matrix_profile(features.apply_maxabs(x, features.fit_maxabs(x)), vocab, train)


def _nb_fitted(spark, sf, alpha=0.1):
    """Processed table, vocabulary, unscaled train features, parameters, prior."""
    p = fx.processed_table(spark, sf)
    train = fx.split_of(p, "train")
    vocab = materialize(features.fit_vocab(train), "vocab")
    terms = features.ngrams_table(train, carry=["target_label"], vocab=vocab)
    weights = profile.class_weights(train)
    params = nb.nb_fit(features.tfidf(terms, vocab), weights, alpha)
    return p, vocab, params, nb.nb_prior(weights), weights


@query
def F8_nb_fit(spark, sf):
    _, _, params, _, _ = _nb_fitted(spark, sf)
    return params.select(
        "term_id",
        F.round("max_abs", 6).alias("max_abs"),
        *[F.round(F.col("log_prob")[i], 6).alias(f"log_prob_{i}") for i in range(len(CLASSES))],
    )


def _nb_preds(spark, sf, *splits):
    p, vocab, params, prior, weights = _nb_fitted(spark, sf)
    rows = fx.split_of(p, *(splits or ("test",)))
    x = features.tfidf(features.ngrams_table(rows, vocab=vocab), vocab)
    docs = rows.select("doc_id", F.col("target_label").alias("y_true"))
    return nb.nb_predict(x, params, prior, docs), weights


@query
def F9_nb_predict(spark, sf):
    preds, _ = _nb_preds(spark, sf)
    return preds.select(
        "doc_id", "y_true", "y_pred", *[F.round(F.col("proba")[i], 6).alias(f"proba_{i}") for i in range(len(CLASSES))]
    )


def _sweep(spark, sf):
    p, vocab, params, prior, _ = _nb_fitted(spark, sf, ALPHAS)
    dev = fx.split_of(p, "dev")
    x = features.tfidf(features.ngrams_table(dev, vocab=vocab), vocab)
    preds = nb.nb_sweep_predict(
        x, params, prior, dev.select("doc_id", F.col("target_label").alias("y_true")), ALPHAS
    )
    wide = evaluate.metrics_wide(preds, ["alpha"], only_seen=False)
    return evaluate.rounded(
        wide.select(
            "alpha",
            "macro_f1",
            "weighted_f1",
            F.col("recall_class_critical_rescue").alias("critical_rescue_recall"),
            F.col("recall_class_resource_requests").alias("resource_requests_recall"),
        )
    )


@query
def F10_nb_sweep(spark, sf):
    return _sweep(spark, sf)


def _vectors(spark, sf):
    p = fx.processed_table(spark, sf)
    train, test = fx.split_of(p, "train"), fx.split_of(p, "test")
    fitted = scoring.fit_text_model(train, kinds=[])
    x = scoring.train_features(train, fitted)
    vectors = train_table(x, train, profile.class_weights(train), fitted.vocab.count())
    docs = test.select("doc_id", F.col("target_label").alias("y_true"))
    return x, vectors, scoring.features_of(test, fitted), docs


@query
def F11_logistic_regression(spark, sf):
    _, vectors, test, docs = _vectors(spark, sf)
    return predict(test, lr_fit(vectors), docs)


@query
def F12_linear_svm(spark, sf):
    _, vectors, test, docs = _vectors(spark, sf)
    return predict(test, svm_fit(vectors), docs)


@query
def F13_calibrated_svm(spark, sf):
    x, vectors, test, docs = _vectors(spark, sf)
    return predict(test, calibrate(vectors, x), docs)


@query
def F14_score_all(spark, sf):
    p = fx.processed_table(spark, sf)
    fitted = scoring.fit_text_model(fx.split_of(p, "train"))
    return scoring.score_all(fx.split_of(p, "test"), fitted)


@query
def F15_score_batched(spark, sf):
    p = fx.processed_table(spark, sf)
    fitted = scoring.fit_text_model(fx.split_of(p, "train"), kinds=["Naive_Bayes"])
    return scoring.score_batched(fx.split_of(p, "test"), fitted, "Naive_Bayes", 32)


@query
def F16_experiment_grid(spark, sf):
    real = fx.processed_table(spark, sf)
    synthetic = materialize(augment.generated_rows(fx.generated(spark, sf), ["arrival"], max_words=400), "synthetic")
    return experiments.run_grid(real, synthetic)


@query
def F17_top_terms(spark, sf):
    _, vocab, params, _, _ = _nb_fitted(spark, sf)
    return evaluate.rounded(nb.top_terms(params, vocab, 10))


@query
def F18_focal_loss(spark, sf):
    preds, weights = _nb_preds(spark, sf)
    return evaluate.rounded(evaluate.focal_loss(preds, weights))


@query
def F19_cosine_pairs(spark, sf):
    """Every vector with the one that follows it."""
    v = fx.table(spark, sf, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("vec_b"))
    pairs = v.select("vec_id", F.col("embedding").alias("vec_a")).join(after, "vec_id")
    return evaluate.rounded(embeddings.cosine_pairs(pairs).select("vec_id", "similarity"))


@query
def F19_centroid_similarity(spark, sf):
    cents = embeddings.centroids(fx.table(spark, sf, "embeddings"))
    return evaluate.rounded(embeddings.centroid_similarity(cents))


@query
def F19_nearest(spark, sf):
    v = fx.table(spark, sf, "embeddings")
    queries = embeddings.centroids(v).toDF("query_id", "query_vec")
    return evaluate.rounded(embeddings.nearest(v, queries, 5))


@query
def F19_graph(spark, sf):
    """Ten neighbours of every vector."""
    graph = neighbours.neighbour_graph(fx.table(spark, sf, "embeddings"))
    return graph.select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour"), F.round("similarity", 6).alias("similarity"))


@query
def F19_graph_recall(spark, sf):
    """Whether the graph reaches a recall of 0.95, measured on every fiftieth vector against all."""
    v = fx.table(spark, sf, "embeddings")
    exact = neighbours.exact_neighbours(v, v.filter("vec_id % 50 = 0"), neighbours.K)
    found = neighbours.recall(neighbours.neighbour_graph(v), exact)
    return found.select("n_rows", "n_wanted", (F.col("recall") >= 0.95).alias("recall_reached"))


@query
def F20_project_2d(spark, sf):
    return evaluate.rounded(embeddings.project_2d(fx.table(spark, sf, "embeddings")))


@query
def F20_neighbour_map(spark, sf):
    """A place in the plane for every vector, near its neighbours."""
    v = fx.table(spark, sf, "embeddings")
    placed = projection.neighbour_map(v).withColumnRenamed("id", "vec_id")
    return evaluate.rounded(placed.join(v.select("vec_id", "label"), "vec_id"))


@query
def F20_preservation(spark, sf):
    """Whether the map keeps over twice the neighbours that the principal plane keeps, of every fiftieth vector."""
    v = fx.table(spark, sf, "embeddings")
    asked = v.filter("vec_id % 50 = 0")
    placed = projection.neighbour_map(v)
    plane = embeddings.project_2d(v.select(F.col("vec_id").alias("id"), "embedding"))
    kept = [projection.preservation(v, m, asked, neighbours.K).toDF("n_rows", c) for m, c in ((placed, "map"), (plane, "plane"))]
    return kept[0].join(kept[1], "n_rows").select("n_rows", (F.col("map") > 2 * F.col("plane")).alias("better"))


# --- G: evaluation ------------------------------------------------------------------


@query
def G1_confusion(spark, sf):
    return evaluate.confusion(fx.centroid_preds(spark, sf), ["model"])


@query
def G1_confusion_wide(spark, sf):
    return evaluate.confusion_wide(evaluate.confusion(fx.centroid_preds(spark, sf), ["model"]), ["model"])


@query
def G2_confusion_norm(spark, sf):
    return evaluate.confusion_norm(evaluate.confusion(fx.centroid_preds(spark, sf), ["model"]), ["model"])


@query
def G3_class_report(spark, sf):
    return evaluate.rounded(evaluate.class_report(fx.centroid_preds(spark, sf), ["model"]))


@query
def G4_overall_metrics(spark, sf):
    return evaluate.rounded(evaluate.overall_metrics(fx.centroid_preds(spark, sf), ["model"]))


@query
def G4_overall_metrics_nb(spark, sf):
    """Macro over the classes seen, on naive Bayes predictions."""
    return evaluate.rounded(evaluate.overall_metrics(_nb_preds(spark, sf)[0], only_seen=True))


@query
def G5_metrics_wide(spark, sf):
    return evaluate.rounded(evaluate.metrics_wide(fx.centroid_preds(spark, sf), ["model"], prefix="test_"))


@query
def G6_class_accuracy(spark, sf):
    return evaluate.rounded(evaluate.class_accuracy(fx.centroid_preds(spark, sf), ["model"]))


@query
def G7_dangerous_fn(spark, sf):
    return evaluate.rounded(evaluate.dangerous_fn(fx.centroid_preds(spark, sf), ["model"]))


@query
def G8_pair_confusion(spark, sf):
    return evaluate.pair_confusion(fx.centroid_preds(spark, sf), "Critical Rescue", "Resource Requests", ["model"])


@query
def G8_pair_examples(spark, sf):
    rows = evaluate.pair_rows(fx.centroid_preds(spark, sf), "Critical Rescue", "Resource Requests")
    return sampling.head_examples(rows, 5, ["model", "doc_id"]).drop("proba")


@query
def G9_errors(spark, sf):
    return evaluate.errors(fx.centroid_preds(spark, sf)).drop("proba")


@query
def G10_leaderboard(spark, sf):
    board = evaluate.leaderboard(fx.centroid_preds(spark, sf))
    return _placed(board, F.desc("macro_f1"), "model")


@query
def G11_class_matrix_f1(spark, sf):
    return evaluate.class_matrix(fx.centroid_preds(spark, sf), "f1")


@query
def G11_class_matrix_recall(spark, sf):
    return evaluate.class_matrix(fx.centroid_preds(spark, sf), "recall")


def _phases(preds, table):
    langs = table.select("doc_id", F.when(F.col("lang") == "en", "home").otherwise("other").alias("phase"))
    return preds.join(langs, "doc_id")


def _nb_variant(spark, sf, p, synthetic):
    """Naive Bayes with or without generated rows: predictions on dev and test."""
    return experiments.grid_variant(p, synthetic, kinds=["Naive_Bayes"])


@query
def G12_ablation(spark, sf):
    p = fx.processed_table(spark, sf)
    synthetic = materialize(augment.generated_rows(fx.generated(spark, sf), ["arrival"], max_words=400), "synthetic")
    _, plain = _nb_variant(spark, sf, p, None)
    _, more = _nb_variant(spark, sf, p, synthetic)
    rows = experiments.grid_rows(plain.unionByName(more))
    return evaluate.rounded(evaluate.ablation(rows, "test_macro_f1"))


@query
def G13_roc_points(spark, sf):
    scores = evaluate.scores_long(fx.centroid_preds(spark, sf), by=["model"])
    return evaluate.rounded(evaluate.roc(scores, ["model"]))


@query
def G13_roc_auc(spark, sf):
    scores = evaluate.scores_long(fx.centroid_preds(spark, sf), by=["model"])
    return evaluate.rounded(evaluate.roc_auc(scores, ["model"]))


@query
def G13_roc_auc_exact(spark, sf):
    scores = evaluate.scores_long(fx.centroid_preds(spark, sf), by=["model"])
    return evaluate.rounded(evaluate.roc_auc(scores, ["model"]))


@query
def G13_roc_auc_nb(spark, sf):
    return evaluate.rounded(evaluate.roc_auc(evaluate.scores_long(_nb_preds(spark, sf)[0])))


@query
def G14_pr_points(spark, sf):
    scores = evaluate.scores_long(fx.centroid_preds(spark, sf), by=["model"])
    return evaluate.rounded(evaluate.pr_curve(scores, ["model"]))


@query
def G14_average_precision_nb(spark, sf):
    return evaluate.rounded(evaluate.average_precision(evaluate.scores_long(_nb_preds(spark, sf)[0])))


@query
def G14_average_precision(spark, sf):
    scores = evaluate.scores_long(fx.centroid_preds(spark, sf), by=["model"])
    return evaluate.rounded(evaluate.average_precision(scores, ["model"]))


@query
def G15_phases(spark, sf):
    """Home language, other languages and the romanised copy of the others, for two models."""
    p, vocab, params, prior, _ = _nb_fitted(spark, sf, list(PHASE_MODELS))
    test = fx.split_of(p, "test")
    other = test.filter(F.col("lang") != "en")
    roman = romanize_table(other, LATIN_ACCENTS, "clean_text")
    parts = {
        "home": test.filter(F.col("lang") == "en").select("doc_id", "target_label", "clean_text"),
        "other": other.select("doc_id", "target_label", "clean_text"),
        "romanized": roman.select("doc_id", "target_label", F.col("romanized").alias("clean_text")),
    }
    out = None
    for phase, rows in parts.items():
        x = features.tfidf(features.ngrams_table(rows, vocab=vocab), vocab)
        docs = rows.select("doc_id", F.col("target_label").alias("y_true"))
        model = F.create_map(*[F.lit(v) for pair in PHASE_MODELS.items() for v in pair])[F.col("alpha")]
        preds = nb.nb_sweep_predict(x, params, prior, docs, list(PHASE_MODELS)).select(
            F.lit(phase).alias("phase"), model.alias("model"), "y_true", "y_pred"
        )
        out = preds if out is None else out.unionByName(preds)
    return evaluate.evaluate_phases(out)


def _experiment_preds(spark, sf):
    rows = fx.split_of(labels.map_labels(fx.messages(spark, sf), fx.label_map()), "test")
    return fx.answers(rows.withColumn("clean_text", F.col("text"))).select(
        "experiment",
        "strategy",
        "seed",
        "doc_id",
        F.col("target_label").alias("y_true"),
        tx.match_label("response").alias("y_pred"),
    )


@query
def G16_scored_summary(spark, sf):
    return evaluate.rounded(evaluate.scored_summary(_experiment_preds(spark, sf), ["experiment"]))


@query
def G17_compare_experiments(spark, sf):
    return evaluate.rounded(evaluate.compare_experiments(_experiment_preds(spark, sf)))


@query
def G18_recall_side_by_side(spark, sf):
    return evaluate.side_by_side(fx.centroid_preds(spark, sf), ["cosine", "euclid"])


# --- H: streaming ---------------------------------------------------------------------


@query
def H1_dedup_stream(spark, sf):
    """Documents arrive in several files and micro-batches."""
    return _streamed(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", max_words=400)


@query
def H1_dedup_watermark(spark, sf):
    """Events as short texts; the watermark is wider than the stream, so each text passes once."""
    words = F.concat_ws(" ", F.lit("user"), F.pmod("user_id", F.lit(100)), F.lit("did"), "event_type")
    events = fx.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), words.alias("text"))
    return _streamed(events, "ts", event_time="ts", delay="36500 days")


def _arriving(df, batches, operator, columns):
    """What ``operator`` lets through of a stream over ``df``, whose rows arrive in ``batches`` micro-batches.

    A batch is written by all tasks that read it, in as many files as there are; then the stream
    goes on from its checkpoint and takes what is new as one micro-batch.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "arriving")
    schema = ", ".join(f"{c} {t}" for c, t in df.drop("batch").dtypes)
    for batch in range(batches):
        df.filter(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{path}/in")
        kept = operator(dedup.read_stream(spark, f"{path}/in", schema))
        stateful.run_stateful(kept, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(columns).parquet(f"{path}/out")


def _late_events(spark, sf):
    """Events as short texts. Every tenth arrives three days late, every 33rd half a day; six batches of five days."""
    words = F.concat_ws(" ", F.lit("user"), F.pmod("user_id", F.lit(100)), F.lit("did"), "event_type")
    hours = F.when(F.col("event_id") % 10 == 9, 72).when(F.col("event_id") % 33 == 5, 12).otherwise(0)
    arrival = F.unix_micros("ts") + hours * 3_600_000_000
    day = F.floor((arrival - 1_704_067_200_000_000) / 86_400_000_000)  # from the beginning of 2024
    events = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select("event_id", "ts", words.alias("text"), F.least(F.floor(day / 5), F.lit(5)).cast("int").alias("batch"))


@query
def H1_forgetful_dedup(spark, sf):
    """A text passes again after two days; the watermark lets in what is less than a day late."""
    return _arriving(
        _late_events(spark, sf), 6, lambda s: stateful.forgetful_dedup(s, "event_id", "ts", "2 days", "1 day"),
        "fingerprint STRING, place LONG, at_us LONG",
    )


def _generation(spark, sf, target, per_call):
    rows = fx.generated(spark, sf)
    most = rows.agg(F.max("arrival")).scalar()
    batch = F.least(F.floor(F.col("arrival") * 5 / (most + 1)), F.lit(4)).cast("int")
    arriving = rows.withColumn("call_id", F.col("call_id") + 1000).withColumn("batch", batch)
    return _arriving(
        arriving, 5,
        lambda s: stateful.generation_loop(s.withColumn("run", F.lit("one")), "run", target=target, per_call=per_call, max_words=400),
        "arrival LONG, call_id LONG",
    )


@query
def H1_generation_target(spark, sf):
    """As D7_cap_rows, over five micro-batches."""
    return _generation(spark, sf, 200, 10)


@query
def H1_generation_budget(spark, sf):
    """As D7_call_budget, over five micro-batches."""
    return _generation(spark, sf, 200, 40)


def _streamed(df, order, files=6, per_batch=2, **options):
    """Fingerprints that a stream over a few files of ``df`` lets through.

    Each of the ``files`` is written and read in pieces, enough of them to keep every core at work.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stream")
    pieces = max(1, -(-2 * spark.sparkContext.defaultParallelism // files))
    df.repartitionByRange(files * pieces, order).write.parquet(f"{path}/in")
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    stream = dedup.read_stream(spark, f"{path}/in", schema, per_batch * pieces)
    unique = dedup.dedup_stream(stream, **options).select("fingerprint")
    dedup.write_stream(unique, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("fingerprint STRING").parquet(f"{path}/out")
