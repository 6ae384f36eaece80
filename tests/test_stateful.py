"""Keyed state over several micro-batches: windows, lateness, budgets, and state that is given back."""

import random

import pytest
from pyspark.sql import functions as F

from tocsin.streaming import dedup, stateful

TEXT = "please send help to street number {}"


def feed(spark, inbox, rows, schema):
    spark.createDataFrame(rows, schema).selectExpr(*["cast(ts as timestamp) ts"] * ("ts" in schema), *[c.split()[0] for c in schema.split(", ") if c != "ts string"]).coalesce(1).write.mode("append").parquet(inbox)


def run(spark, tmp_path, schema, make):
    stream = dedup.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    query = stateful.run_stateful(make(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def expected(batches, window, delay):
    """One pass over the rows as they arrive."""
    last, out, top = {}, [], None
    for rows in batches:
        late = None if top is None else top - delay
        for at, place, text in sorted(rows):
            if (late is None or at > late) and (text not in last or at >= last[text] + window):
                last[text] = at
                out.append(place)
        top = max([at for at, _, _ in rows] + ([] if top is None else [top]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_forgetful_dedup(spark, tmp_path, seed):
    """Random arrivals, some of them late: the same rows as a plain loop."""
    draw, batches, place = random.Random(seed), [], 0
    for b in range(5):
        rows = []
        for _ in range(40):
            rows.append((max(0, b * 100 + draw.randint(-150, 99)), place, TEXT.format(draw.randint(1, 25))))
            place += 1
        batches.append(rows)
        stamped = [(f"2024-01-01 {at // 60:02d}:{at % 60:02d}:00", n, text) for at, n, text in rows]
        feed(spark, str(tmp_path / "in"), stamped, "ts string, n long, text string")
    run(spark, tmp_path, "ts TIMESTAMP, n LONG, text STRING", lambda s: stateful.forgetful_dedup(s, "n", "ts", "40 minutes", "20 minutes"))
    got = sorted(r.place for r in spark.read.parquet(str(tmp_path / "out")).collect())
    wanted = expected(batches, 40, 20)
    assert got == wanted
    assert wanted != expected(batches, 40, 10_000), "no row of the test is late"
    assert wanted != expected(batches, 10_000, 20), "no text of the test passes again"


def test_forgotten_texts_leave_the_state(spark, tmp_path):
    """A text per minute for an hour, then one a day later: the timers remove the sixty."""
    for day, minutes in enumerate([range(60), [0], [1], [2]]):
        rows = [(f"2024-01-{1 + day:02d} 00:{m:02d}:00", m, TEXT.format(f"{day} {m}")) for m in minutes]
        feed(spark, str(tmp_path / "in"), rows, "ts string, n long, text string")
    sizes = run(spark, tmp_path, "ts TIMESTAMP, n LONG, text STRING", lambda s: stateful.forgetful_dedup(s, "n", "ts", "1 hour", "1 minute"))
    assert max(sizes) >= 60 and sizes[-1] < 10, sizes


def test_restart_goes_on_with_its_state(spark, tmp_path):
    make = lambda s: stateful.forgetful_dedup(s, "n", "ts", "1 day", "1 hour")
    for n, minute in enumerate((0, 30)):
        feed(spark, str(tmp_path / "in"), [(f"2024-01-01 00:{minute:02d}:00", n, TEXT.format(1))], "ts string, n long, text string")
        run(spark, tmp_path, "ts TIMESTAMP, n LONG, text STRING", make)
    assert [r.place for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [0]


def loop(rows, target, budget):
    """The generation loop, row by row; good rows have a text."""
    kept, calls, call, seen = [], 0, None, set()
    for arrival, own, text in sorted(rows):
        if own != call:
            if calls == budget:
                break
            calls, call = calls + 1, own
        if text and text not in seen:
            seen.add(text)
            kept.append(arrival)
            if len(kept) == target:
                break
    return kept


@pytest.mark.parametrize("target, per_call", [(12, 4), (30, 10), (1000, 500), (6, 1)])
def test_generation_loop(spark, tmp_path, target, per_call):
    """Two runs side by side, ended by target, by budget, or by the end of the rows."""
    draw, all_rows = random.Random(target), {"a": [], "b": []}
    for batch in range(4):
        rows = []
        for i in range(25):
            for name in all_rows:
                arrival = batch * 25 + i
                text = TEXT.format(draw.randint(1, 40)) if draw.random() < 0.8 else "short"
                all_rows[name].append((arrival, arrival // 5, text if text != "short" else None))
                rows.append((name, arrival, arrival // 5, text))
        draw.shuffle(rows)
        feed(spark, str(tmp_path / "in"), rows, "run string, arrival long, call_id long, text string")
    schema = "run STRING, arrival LONG, call_id LONG, text STRING"
    sizes = run(spark, tmp_path, schema, lambda s: stateful.generation_loop(s, "run", target=target, per_call=per_call))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    for name, rows in all_rows.items():
        wanted = loop(rows, target, target // per_call * 3)
        assert sorted(r.arrival for r in out if r.run == name) == wanted
        ended = len(wanted) == target or target // per_call * 3 < 20
    if ended:
        assert sizes[-1] <= 2, sizes  # one row of progress for each run


def test_tasks_send_a_generation_run_no_more_calls_than_its_budget(spark):
    """Rows behind the budget stay in their task, whatever their order; the row that ends the run is sent."""
    rows = [(name, i, i // 5 if i >= 5 else None, f"text {i}") for name in ("a", None) for i in range(500)]
    random.Random(5).shuffle(rows)
    keyed = spark.createDataFrame(rows, "run string, arrival long, call_id long, fingerprint string").coalesce(1)
    sent = stateful._cut_in_tasks(keyed, 3).collect()
    for name in ("a", None):
        assert sorted(r.arrival for r in sent if r.run == name) == list(range(25))


def test_arriving_rows_are_written_and_read_by_several_tasks(spark, monkeypatch):
    """Each batch lies in several files and is still one micro-batch."""
    from tocsin.plans import queries

    seen, read = [], queries.dedup.read_stream
    rows = [(i, i // 5, TEXT.format(i), i // 20) for i in range(60)]
    df = spark.createDataFrame(rows, "arrival long, call_id long, text string, batch int").repartition(4)

    def watched(session, path, schema, *options):
        seen.append(len(session.read.parquet(path).inputFiles()))
        return read(session, path, schema, *options)

    monkeypatch.setattr(queries.dedup, "read_stream", watched)
    out = queries._arriving(
        df, 3, lambda s: stateful.generation_loop(s.withColumn("run", F.lit("one")), "run", target=1000, per_call=20), "arrival LONG"
    )
    assert sorted(r.arrival for r in out.collect()) == list(range(60))
    assert seen[0] > 1 and seen[0] < seen[1] < seen[2]


def test_delays():
    assert stateful.micros_of("2 hours") == 7_200_000_000
    for wrong in ("", "2", "hours", "-1 day", "1 month"):
        with pytest.raises(ValueError):
            stateful.micros_of(wrong)
