"""Graded quality by ordinal regression with cumulative links.

One linear score on hashed features of the text, shared by all grades, and
ordered thresholds: the odds that a document reaches grade k are
``exp(score - threshold_k)``. From the chances of reaching each grade follow
the expected grade, for ranking, and the tail probability of reaching a wanted
grade, for selection.

Features of a text are means over its words, so length does not matter: the
word's outline (capital, small, digit, other signs, runs cut), its signs, its
length, and whether it repeats the word before it. The letters themselves are
left out, so neither topic nor offensive words decide about quality. Every
word's contribution is looked up in a bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.arrow import Batches, kinds, raw, unpacked, whole_row
from tocsin.llm.learn import BUCKETS, EMPTY, Adam, bucket, labelled_sample, sigmoid, softplus
from tocsin.llm.memo import Memo

GRADES = 3
PER_GRADE = 2000  # rated documents of each grade that the model is fitted on
ROUNDS = 200
RATE = 0.2
PENALTY = 1e-5
SCALE = 8.0  # factor of the mean features; the penalty is on weights of this scale
WANTED = 1  # least grade of a document to keep
LEAST_TAIL = 0.5
STRETCH = 40  # characters of a word that are read as one
LONG = 30  # words of that length or more are alike
CACHE_WORDS = 120_000
REPEAT = bucket(b"repeat")


def words_of(text: bytes) -> list[bytes]:
    """Words by ASCII white space; long ones also by any other, and then in consecutive stretches."""
    words = text.split()
    if max(map(len, words), default=0) <= STRETCH:
        return words
    out = []
    for word in words:
        if len(word) <= STRETCH:
            out.append(word)
            continue
        for part in word.decode("utf-8", "replace").split():
            out += [part[at : at + STRETCH].encode("utf-8", "replace") for at in range(0, len(part), STRETCH)]
    return out


def outline(word: str) -> str:
    """Capitals as X, small letters as x, digits as 9, other signs kept; runs are cut to two."""
    kinds = "".join(
        "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word
    )
    return re.sub(r"(.)\1\1+", r"\1\1", kinds)


def features(word: bytes) -> list[int]:
    """Hashed outline, signs and length of a word."""
    text = word.decode("utf-8", "replace")
    signs = re.sub(r"(.)\1\1+", r"\1\1", "".join(c for c in text if not c.isalnum()))
    return [
        bucket(b"o:" + outline(text).encode("utf-8", "replace")),
        bucket(b"s:" + signs.encode("utf-8", "replace")) if signs else EMPTY,
        bucket(b"l:%d" % min(len(text), LONG)),
    ]


@dataclass
class QualityModel:
    """Weights of hashed features and one threshold per grade above the lowest, ascending.

    Without weights (no rating seen) every text has the highest grade.
    """

    weights: np.ndarray | None
    thresholds: np.ndarray
    memo: Memo | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "memo": None}

    def _word(self, word: bytes) -> float:
        return float(self.weights[features(word)].sum())

    def latent(self, text: bytes) -> float:
        """The linear score; 0 for a text without words."""
        words = words_of(text)
        if self.weights is None or not words:
            return 0.0
        if self.memo is None:
            self.memo = Memo(self._word, CACHE_WORDS)
        repeats = sum(map(eq, words, words[1:]))
        return SCALE * (sum(self.memo.all(words)) + repeats * float(self.weights[REPEAT])) / len(words)

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """Chances of reaching grade 1, 2, ... for every score."""
        if self.weights is None:
            return np.ones((len(latent), len(self.thresholds)))
        return sigmoid(latent[:, None] - self.thresholds)


def fit_texts(
    texts: list[bytes], grade: np.ndarray, weight: np.ndarray, grades: int = GRADES, rounds: int = ROUNDS
) -> QualityModel:
    """Maximum penalised likelihood of the cumulative-link model.

    Thresholds start at the log odds of the smoothed shares of the grades and
    are kept in order by fitting their (positive) distances.
    """
    if not len(grade) or grade.min() == grade.max():
        return QualityModel(None, np.zeros(grades - 1))
    index: dict[bytes, int] = {}
    row, column, value = [], [], []
    repeats = np.zeros(len(texts))
    for at, text in enumerate(texts):
        words = words_of(text)
        if not words:
            continue
        ids, counts = np.unique([index.setdefault(x, len(index)) for x in words], return_counts=True)
        row.append(np.full(len(ids), at))
        column.append(ids)
        value.append(SCALE * counts / len(words))
        repeats[at] = SCALE * sum(map(eq, words, words[1:])) / len(words)
    if not row:
        return QualityModel(None, np.zeros(grades - 1))
    # Words are folded into features once; a round then works on (document, feature, share).
    table = np.array([features(x) for x in index], np.int64)
    row, column, value = np.concatenate(row), np.concatenate(column), np.concatenate(value)
    cells = (row[:, None] * BUCKETS + table[column]).ravel()
    cells, inverse = np.unique(cells, return_inverse=True)
    value = np.bincount(inverse, np.repeat(value, table.shape[1]))
    row, column = cells // BUCKETS, cells % BUCKETS
    row, column, value = row[column != EMPTY], column[column != EMPTY], value[column != EMPTY]

    n, w = len(texts), weight / weight.sum()
    share = np.array([w[grade >= k].sum() for k in range(1, grades)])
    share = np.clip(share * n / (n + 2) + 1 / (n + 2), 1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    gaps = np.maximum(np.diff(start), 1e-3)
    values = {"weights": np.zeros(BUCKETS), "first": start[:1].copy(), "gaps": np.log(np.expm1(gaps))}
    adam, tiny = Adam(RATE), 1e-12
    reached = np.arange(1, grades)[None, :] <= grade[:, None]
    last = reached.sum(axis=1)
    for _ in range(rounds):
        thresholds = np.concatenate([values["first"], values["first"] + np.cumsum(softplus(values["gaps"]))])
        z = np.bincount(row, values["weights"][column] * value, n) + repeats * values["weights"][REPEAT]
        tail = np.hstack([np.ones((n, 1)), sigmoid(z[:, None] - thresholds), np.zeros((n, 1))])
        p = np.maximum(tail[np.arange(n), last] - tail[np.arange(n), last + 1], tiny)
        slope = tail * (1 - tail)
        down, up = slope[np.arange(n), last], slope[np.arange(n), last + 1]
        dz = -w * (down - up) / p
        dt = np.zeros((n, grades + 1))
        dt[np.arange(n), last] += w * down / p
        dt[np.arange(n), last + 1] -= w * up / p
        dt = dt[:, 1:grades].sum(axis=0)
        g = np.bincount(column, dz[row] * value, BUCKETS)
        g[REPEAT] += dz @ repeats
        g += PENALTY * values["weights"]
        later = np.cumsum(dt[::-1])[::-1]
        adam.step(
            values, {"weights": g, "first": dt.sum(keepdims=True), "gaps": later[1:] * sigmoid(values["gaps"])}
        )
    thresholds = np.concatenate([values["first"], values["first"] + np.cumsum(softplus(values["gaps"]))])
    return QualityModel(values["weights"], thresholds)


def graded(quality: Column, toxic: Column) -> Column:
    """Rating of a label row: 0 junk, 1 readable but toxic, 2 clean; null without a quality label."""
    return (
        F.when(quality == 0, 0).when((quality > 0) & (F.coalesce(toxic, F.lit(0)) > 0), 1).when(quality > 0, 2)
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    grade: Column,
    key: str = "doc_id",
    text: str = "text",
    grades: int = GRADES,
    per_grade: int = PER_GRADE,
) -> QualityModel:
    """Fit on at most ``per_grade`` rated documents of each grade, weighted back to the sizes of the grades.

    ``grade`` is 0 to ``grades - 1`` over the columns of ``labels``, null where unrated.
    """
    sample, sizes = labelled_sample(docs, labels, key, text, grade, per_grade)
    y = sample.column("class").to_numpy()
    drawn = np.maximum(np.bincount(y, minlength=grades), 1)
    weight = np.array([sizes.get(k, 0) for k in range(grades)]) / drawn
    return fit_texts(raw(sample.column("text").combine_chunks()), y, weight[y].astype(float), grades)


def _judge(model, wanted: int, columns: list[str]):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            tails = own.tails(np.array([own.latent(x) for x in raw(batch.column("text"))]))
            rows = unpacked(batch.column("row"), columns)
            yield pa.RecordBatch.from_arrays(
                [*rows, pa.array(tails.sum(axis=1)), pa.array(tails[:, wanted - 1].copy())],
                [*columns, "expected_grade", "tail_probability"],
            )

    return task


def judge(docs: DataFrame, model: QualityModel, text: str = "text", wanted: int = WANTED) -> DataFrame:
    """Every row with all its columns, ``expected_grade``, ``tail_probability`` and ``kept``.

    ``tail_probability`` is the chance of grade ``wanted`` or better; ``kept``
    says that it reaches ``LEAST_TAIL``. Null, empty and blank texts have the
    latent score 0, that is the odds of the thresholds alone. Repeated rows are
    judged alike; columns of the three names are replaced.
    """
    if not 1 <= wanted <= len(model.thresholds):
        raise ValueError("wanted must be a grade above the lowest")
    columns = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "kept")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(whole_row(columns).alias("row"), F.col(text).alias("text")).mapInArrow(
        _judge(shared, wanted, columns), f"{kinds(docs, columns)}, expected_grade double, tail_probability double"
    )
    return scored.withColumn("kept", F.col("tail_probability") >= LEAST_TAIL)
