"""The pipeline stage by stage against the plain versions of the other tests."""

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_line_dedup import loop
from tests.llm.test_packing import check
from tests.llm.test_simhash import classes, plain_fingerprint
from tocsin.session import materialize


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_keep_the_columns(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "line_dedup", "simhash", "packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_filters_keep_clean_documents(spark, stages):
    label = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in stages[:3]]
    assert ids[2] <= ids[1] <= ids[0]
    clean = {i for i in ids[0] if i in label and label[i].quality and not label[i].toxic}
    assert len(clean & ids[2]) >= 0.99 * len(clean)
    assert not {i for i in ids[2] if i in label and not label[i].quality}


def test_lines(stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    after = {r.doc_id: r for r in stages[3].collect()}
    assert len(after) == len(before)
    for n, (text, _, _) in loop(before).items():
        got = after[before[n][0]]
        assert (got.text, got.n_chars) == (text, len(text))


def test_near_duplicates(stages):
    before = sorted((r.doc_id, r.text) for r in stages[3].collect())
    root = classes([plain_fingerprint(t) for _, t in before])
    kept = sorted((r.doc_id, r.text) for r in stages[4].collect())
    assert kept == [before[n] for n in sorted(set(root))]


def test_sequences(stages):
    rows = [(r.doc_id, r.text) for r in stages[4].collect()]
    pieces = stages[5].collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for p, own in check(rows, pieces):
        assert bytes(p.ids) == own


def test_run_and_empty_table(spark, stages, tmp_path):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() == stages[5].count()
    columns = stages[0].columns
    spark.createDataFrame([], stages[0].schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, "x y z", "en", "s", 5), (2, "", "en", None, 0)]
    spark.createDataFrame(odd, stages[0].schema).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "odd" / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sum(p.length for p in out) == 1 + np.sum([p.length for p in out if p.doc_id is None])
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {k.split("_")[0] for k in entry.queries()}
    assert "pipeline" not in entry.oracle_sql()
