import os

import pytest
from pyspark.sql import functions as F

from tocsin.constants import EVENTS
from tocsin.operators.labels import prepare_messages
from tocsin.constants import LABEL_MAP
from tocsin.sources import messages as src
from tocsin.sources import reports
from tocsin.streaming import dedup
from tocsin.operators import evaluate, sampling, augment
from tocsin import session
from tocsin.session import shared_dir

HEADER = "tweet_id\ttweet_text\tclass_label\n"


def write(root, *parts, body):
    path = os.path.join(root, *parts)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(body)


@pytest.fixture()
def raw(tmp_path):
    root = str(tmp_path / "raw")
    write(root, "events_set1_47K", "events_set1", "kaikoura_earthquake_2016", "kaikoura_earthquake_2016_dev.tsv",
          body=HEADER + '798064896545996801\tone "stray quote\tsympathy_and_support\n'
          + "798064896545996802\t#Tag &amp; NA\tcaution_and_advice\n")
    write(root, "events_set1_47K", "events_set1", "Readme.txt", body="not a message file\n")
    write(root, "events_set2_29K", "maryland_floods_2018", "maryland_floods_2018_test.tsv",
          body=HEADER + "1\thttp://only.link\tnot_humanitarian\n2\t\tother_relevant_information\n")
    return root


def test_read_messages_tsv(spark, raw):
    rows = {r["tweet_id"]: r for r in src.read_messages_tsv(spark, raw).collect()}
    assert len(rows) == 4
    first = rows[798064896545996801]
    assert first["tweet_text"] == 'one "stray quote'
    assert (first["event"], first["split"], first["event_set"]) == ("kaikoura_earthquake_2016", "dev", "set1")
    assert (rows[1]["event"], rows[1]["split"], rows[1]["event_set"]) == ("maryland_floods_2018", "test", "set2")
    assert rows[2]["tweet_text"] is None


def test_missing_and_unexpected_sources(spark, raw):
    audit = src.missing_sources(EVENTS, src.read_messages_tsv(spark, raw)).collect()
    unexpected = [(r["event"], r["split"]) for r in audit if r["status"] == "unexpected"]
    assert unexpected == [("maryland_floods_2018", "test")]
    assert sum(r["status"] == "missing" for r in audit) == 17 * 3 - 1


def test_processed_table_round_trip(spark, raw, tmp_path):
    table = prepare_messages(src.as_messages(src.read_messages_tsv(spark, raw)), LABEL_MAP)
    path = str(tmp_path / "processed")
    src.write_messages(table.select("doc_id", "text", "raw_label", "target_label", "event", "event_set", "lang",
                                    "clean_text", "text_length", "word_count", "split"), path)
    back = src.read_messages(spark, path)
    rows = {r["clean_text"]: r for r in back.collect()}
    assert set(rows) == {"one stray quote", "tag and na"}
    assert rows["tag and na"]["target_label"] == "Situational Awareness"
    assert rows["tag and na"]["word_count"] == 3
    dev = back.filter("split = 'dev'")
    assert "PartitionFilters: [isnotnull(split" in dev._jdf.queryExecution().executedPlan().toString()


def test_csv_export_keeps_quotes_and_line_ends(spark, tmp_path):
    path = str(tmp_path / "csv")
    value = ' say "hi", she said\nnext line '
    src.export_csv(spark.createDataFrame([(value, "x")], "text string, label string"), path)
    assert src.read_eval_set(spark, path).first()["text"] == value


def test_report_json_layout(spark):
    df = spark.createDataFrame([("Irrelevant", "Irrelevant")], "y_true string, y_pred string")
    text = reports.report_to_json(df).first()["report"]
    assert '"Irrelevant":{"precision":1.0,"recall":1.0,"f1-score":1.0,"support":1.0}' in text
    assert '"accuracy":1.0' in text and '"macro avg"' in text and '"weighted avg"' in text
    values = {(r["class"], r["metric"]): r["value"] for r in reports.report_from_json(reports.report_to_json(df)).collect()}
    assert values["macro avg", "f1"] == pytest.approx(0.2)
    assert values["weighted avg", "support"] == 1.0


def test_stream_dedup_over_several_batches(spark, tmp_path):
    rows = spark.range(300).select(
        F.col("id").alias("arrival"),
        F.concat(F.lit("- help needed near street number "), F.col("id") % 40, F.lit(" now please")).alias("text"),
    )
    inbox = str(tmp_path / "in")
    rows.repartition(6).write.parquet(inbox)
    stream = dedup.read_stream(spark, inbox, "arrival LONG, text STRING", files_per_trigger=1)
    query = dedup.write_stream(dedup.dedup_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert len(query.recentProgress) > 1
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = augment.accept_generated(rows, ["arrival"])
    assert out.count() == 40
    assert {r[0] for r in out.select("fingerprint").collect()} == {r[0] for r in batch.select("fingerprint").collect()}


def test_late_copy_does_not_hide_one_on_time(spark, tmp_path):
    """The second batch brings a late and an on-time copy of a text in one task, the late one first."""
    inbox, text = str(tmp_path / "in"), "please send help to street number "
    for day, rows in enumerate([[("20", "1")], [("01", "2"), ("20", "2"), ("01", "3")]]):
        stamped = [(f"2024-01-{d} 00:0{day}:00", text + n) for d, n in rows]
        df = spark.createDataFrame(stamped, "ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(inbox)
        stream = dedup.read_stream(spark, inbox, "ts TIMESTAMP, text STRING", files_per_trigger=1)
        unique = dedup.dedup_stream(stream, event_time="ts", delay="1 hour")
        dedup.write_stream(unique, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).select("text").collect()
    assert sorted(r.text[-1] for r in out) == ["1", "2"]


def test_shared_dir_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    else:
        assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_leaderboard_and_best_row_ties(spark):
    df = spark.createDataFrame([(0.5, 0.7), (0.1, 0.7), (2.0, 0.2)], "alpha double, macro_f1 double")
    assert sampling.best_row(df, "macro_f1", "alpha").first()["alpha"] == 0.1
    preds = spark.createDataFrame(
        [("b", "Irrelevant", "Irrelevant"), ("a", "Irrelevant", "Irrelevant"), ("c", "Irrelevant", "ERROR")],
        "model string, y_true string, y_pred string",
    )
    assert [r["model"] for r in evaluate.leaderboard(preds).collect()] == ["a", "b", "c"]


def test_scratch_is_cleared_on_request(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    assert session.materialize(spark.range(3), "x").count() == 3
    assert list(tmp_path.glob("tocsin/*"))
    assert session.clear_scratch(spark)
    assert not list(tmp_path.glob("tocsin/*"))


def test_a_stream_is_fed_by_all_cores(spark, tmp_path, monkeypatch):
    """The files of a stream lie in pieces, at least one for every core, and the batches stay."""
    from tocsin.plans import queries

    monkeypatch.setattr(queries, "scratch_path", lambda *_: str(tmp_path / "s"))
    texts = spark.range(400).selectExpr("id as doc_id", "concat('Text ', id % 300, ' of some six words or more') as text")
    kept = queries._streamed(texts, "doc_id")
    assert kept.count() == kept.distinct().count() == 300
    assert len(list((tmp_path / "s/in").glob("*.parquet"))) >= max(7, spark.sparkContext.defaultParallelism)
    assert len(list((tmp_path / "s/checkpoint/commits").glob("[0-9]*"))) == 3
