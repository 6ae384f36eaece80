"""Stateful operators on arriving messages, with state that is given back.

Both keep what they need per key in a state store on disk and write only what
changes. :func:`forgetful_dedup` remembers a text for a stated time after it
last went through; a timer on the event time removes it once the watermark has
passed. :func:`generation_loop` repeats the accept loop of a generation run on
a stream: rows in order of arrival, texts not seen before, until the target or
the call budget is reached; a finished run keeps one row of state.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from tocsin.constants import MAX_WORDS, MIN_WORDS, ROWS_PER_CALL, TARGET_ROWS
from tocsin.functions.text import fingerprint, is_good_row, strip_list_markers
from tocsin.operators.augment import good_rows
from tocsin.streaming.dedup import write_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def micros_of(delay: str) -> int:
    """Microseconds of a delay such as ``2 hours``."""
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", delay)
    if not found:
        raise ValueError(f"not a delay: {delay!r}")
    return int(found[1]) * _UNITS[found[2]] * 1_000_000


class _Forgetful(StatefulProcessor):
    """Per text: the event time at which it last went through."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        # The rows of one text in one micro-batch.
        for at, place in sorted((r.at_us, r.place) for r in rows):
            if at > late and (last is None or at >= last + self.window):
                last = at
                yield Row(fingerprint=key[0], place=place, at_us=at)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.last.update((last,))
            self.handle.registerTimer(self._expiry(last))

    def _expiry(self, at: int) -> int:
        return -(-(at + self.window) // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def forgetful_dedup(
    stream: DataFrame, place: str, event_time: str, window: str, delay: str, text_col: str = "text",
    min_words: int = MIN_WORDS, max_words: int = MAX_WORDS,
) -> DataFrame:
    """``(fingerprint, place, at_us)`` of good rows whose text did not go through within ``window`` before.

    ``place`` numbers the rows (a long), ``at_us`` is the event time in
    microseconds. Rows behind the watermark (the latest time of earlier
    micro-batches less ``delay``) are dropped. Within a micro-batch rows count
    by event time, then place. A text that went through is forgotten by a
    timer when the watermark has passed the end of its window, so the state
    holds the texts of one window and one delay; the result does not depend on
    when the timer fires, as no row that is still let in lies before that end.
    """
    good = good_rows(stream, text_col, min_words, max_words).withWatermark(event_time, delay)
    keyed = good.select(
        fingerprint("clean_text").alias("fingerprint"), F.col(place).cast("long").alias("place"),
        F.unix_micros(event_time).alias("at_us"), event_time,
    )
    return keyed.groupBy("fingerprint").transformWithState(
        _Forgetful(micros_of(window)), "fingerprint string, place long, at_us long", "append", "eventTime"
    )


class _Loop(StatefulProcessor):
    """Per run: how far it is, and the texts it has accepted."""

    def __init__(self, target: int, budget: int):
        self.target, self.budget = target, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "kept long, calls long, call long, done boolean")
        self.seen = handle.getMapState("seen", "fingerprint string", "arrival long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        kept, calls, call, done = self.progress.get() if self.progress.exists() else (0, 0, None, False)
        if done:
            return
        known = {f for (f,) in self.seen.keys()}
        new = {}
        for arrival, own_call, mark in sorted((r.arrival, r.call_id, r.fingerprint or "") for r in rows):
            if own_call != call:
                if calls == self.budget:
                    done = True
                    break
                calls, call = calls + 1, own_call
            if not mark or mark in known:
                continue
            known.add(mark)
            new[mark] = arrival
            kept += 1
            yield Row(run=key[0], arrival=arrival, call_id=own_call, fingerprint=mark)
            if kept == self.target:
                done = True
                break
        if done:
            self.seen.clear()
        else:
            for mark, arrival in new.items():
                self.seen.updateValue((mark,), (arrival,))
        self.progress.update((kept, calls, call, done))

    def close(self) -> None:
        pass


def _cut_in_tasks(keyed: DataFrame, budget: int) -> DataFrame:
    """Drop rows that lie behind more calls of their run than the budget has.

    Counted among the rows that the same task of the same micro-batch has met:
    some of the rows never have more calls than all rows. The call after the
    last allowed one stays, as it ends the run.
    """

    def first_calls(rows: pa.Table) -> pa.Table:
        shown = rows.select(["run", "arrival", "call_id", "fingerprint"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        shown["run"] = pd.factorize(shown["run"], use_na_sentinel=False)[0]
        shown["fingerprint"] = shown["fingerprint"].fillna("")
        shown = shown.sort_values(["run", "arrival", "call_id", "fingerprint"], na_position="first")
        run, call = shown["run"].to_numpy(), pd.factorize(shown["call_id"], use_na_sentinel=False)[0]
        new_run = np.append(True, run[1:] != run[:-1])
        calls = np.cumsum(new_run | np.append(True, call[1:] != call[:-1]))
        before = np.maximum.accumulate(np.where(new_run, calls, 0))
        # A first call without a number is not counted by the loop.
        return rows.take(pa.array(shown.index.to_numpy()[calls - before <= budget + 1]))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            held = first_calls(rows) if rows.num_rows else rows
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return keyed.mapInArrow(task, keyed.schema)


def generation_loop(
    stream: DataFrame, run: str, arrival: str = "arrival", call: str = "call_id", text_col: str = "text",
    target: int = TARGET_ROWS, per_call: int = ROWS_PER_CALL, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS,
) -> DataFrame:
    """``(run, arrival, call_id, fingerprint)`` of the rows that a generation run accepts.

    Every value of ``run`` is a run of its own: rows count in the order of
    ``arrival`` (which must not go back from one micro-batch to the next),
    calls in that order as well. A row is accepted if it is good and its
    fingerprint is new to the run. The run ends with ``target`` accepted rows,
    or when a call would exceed three times the calls that would do if every
    row were kept; rows after that are read and dropped, and the texts are
    forgotten. A run is in order by definition, so it is one key; its state
    is bounded by the budget, and so are the rows that a task sends there.
    """
    clean = strip_list_markers(text_col)
    mark = F.when(is_good_row(clean, min_words, max_words), fingerprint(clean))
    keyed = stream.select(
        F.col(run).cast("string").alias("run"), F.col(arrival).cast("long").alias("arrival"),
        F.col(call).cast("long").alias("call_id"), mark.alias("fingerprint"),
    )
    budget = target // per_call * 3
    return _cut_in_tasks(keyed, budget).groupBy("run").transformWithState(
        _Loop(target, budget), "run string, arrival long, call_id long, fingerprint string", "append", "none"
    )


def run_stateful(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """:func:`write_stream` with the state store on disk that these operators need."""
    conf = df.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ON_DISK)
    try:
        return write_stream(df, path, checkpoint)
    finally:
        conf.set(PROVIDER, before)
