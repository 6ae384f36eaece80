"""Toxic documents by multiple-instance learning: labels are on documents, scores on sentences.

A sentence's score is logistic in the sum of its words' weights; a word's
weight is the mean over its hashed features (the word and its beginnings). A
document is toxic unless all of its sentences are harmless: one minus the
product of one minus the sentence scores (noisy-or). The likelihood of the
document labels under that rule trains the weights, so the sentence scores
come out without sentence labels and locate what offends.

Labels err. A share of them, fitted along with the weights, calls documents
toxic without any such sentence. Were it left out, the fit would explain these
documents by a floor under all sentences, and every text of enough sentences
would come out toxic. The floor is a constant instead, so low that a million
sentences without an offending word add up to less than 0.05. Clean documents
count as longer ones, so that words which lean towards toxic texts only a little
are not weighted, and at the end all log odds are stretched by a factor.
"""

from __future__ import annotations

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

PER_CLASS = 2500  # labelled documents of each class that the model is fitted on
ROUNDS = 400
RATE = 0.05
SPARSITY = 3e-5  # absolute-value penalty: a feature must gain that much likelihood per unit of weight
EVIDENCE = 3.0  # standard deviations by which a feature must lean towards toxic documents
LEAST_DOCS = 4  # documents of the sample that a feature must occur in
THRESHOLD = 0.7
MAX_WORDS = 64  # a sentence without an end is read in stretches of so many words
START = -6.0  # log odds of a sentence before training
FLOOR = -17.0  # log odds of a sentence without any weighted word, before they are stretched: 4e-8
NOISE = 0.02  # share of labels that call a harmless document toxic, before training
MISSED = 0.005  # share of labels that call a toxic document clean
LONGER = 30.0  # a clean document of the sample stands for texts so many times as long
SHARP = 3.0  # factor of all log odds after the fit: what leans little then adds nothing up
PREFIXES = (3, 4, 5, 6)
EDGES = bytes(b for b in range(0x21, 0x80) if not chr(b).isalnum())
CACHE_WORDS = 120_000


def held_out(key: Column) -> Column:
    """A third of the documents, by the checksum of the key's text; null counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself in lower case without punctuation around it, and its beginnings."""
    letters = word.decode("utf-8", "replace").lower().strip(EDGES.decode("ascii"))
    if not letters:
        return [EMPTY] * (1 + len(PREFIXES))
    parts = [bucket(b"w:" + letters.encode())]
    parts += [bucket(b"p:" + letters[:n].encode()) if len(letters) >= n else EMPTY for n in PREFIXES]
    return parts


def shares(table: np.ndarray) -> np.ndarray:
    """What each feature of a word adds: short words have fewer features, and the same say."""
    present = table != EMPTY
    return len(PREFIXES) * present / np.maximum(present.sum(axis=-1, keepdims=True), 1)


def closes(word: bytes) -> bool:
    return word.rstrip(b"\"')]").endswith((b".", b"!", b"?"))


def words_of(text: bytes) -> list[bytes]:
    """Words by ASCII white space; a line end is kept as a full stop of its own. A blank text has none."""
    return [] if text.isspace() else text.replace(b"\n", b" . ").split()


def sentence_starts(ends: np.ndarray) -> np.ndarray:
    """Positions of the first words of sentences, given which words close one."""
    n = len(ends)
    starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    length = np.diff(np.append(starts, n))
    if length.max(initial=0) <= MAX_WORDS:
        return starts
    stretches = -(-length // MAX_WORDS)
    step = np.arange(stretches.sum()) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    return np.repeat(starts, stretches) + step * MAX_WORDS


@dataclass
class ToxicityModel:
    """Fitted weights; ``prior`` is returned for every text where only one class, or none, was seen."""

    weights: np.ndarray | None
    bias: float
    prior: float = 0.0
    memo: Memo | None = field(default=None, repr=False, compare=False)
    active: dict[int, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "prior": self.prior, "memo": None, "active": {}}

    #: Added to the weight of a word that closes a sentence, so that one number tells both.
    CLOSED = 1e6

    def _word(self, word: bytes) -> float:
        present = [f for f in features(word) if f != EMPTY]
        found = [self.active[f] for f in present if f in self.active]
        weight = sum(found) * len(PREFIXES) / len(present) if found else 0.0
        return weight + self.CLOSED if closes(word) else weight

    def sentence_logits(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of every sentence, and the positions of their first words."""
        words = words_of(text)
        if not words or self.weights is None:
            return np.empty(0), np.empty(0, np.int64)
        if self.memo is None:
            chosen = np.flatnonzero(self.weights)
            self.active = dict(zip(chosen.tolist(), self.weights[chosen].tolist()))
            self.memo = Memo(self._word, CACHE_WORDS)
        weight = np.array(self.memo.all(words))
        ends = weight > self.CLOSED / 2
        weight[ends] -= self.CLOSED
        weight[1:][list(map(eq, words, words[1:]))] = 0  # a word said twice running counts once
        starts = sentence_starts(ends)
        return np.add.reduceat(weight, starts) + self.bias, starts

    def score(self, text: bytes) -> float:
        """Probability that a text is toxic: noisy-or over its sentences; nothing in a text without words."""
        if self.weights is None:
            return self.prior
        logits, _ = self.sentence_logits(text)
        return float(-np.expm1(-softplus(logits).sum())) if len(logits) else 0.0

    def offending(self, text: bytes, threshold: float = 0.5) -> list[tuple[str, float]]:
        """Sentences whose own score reaches the threshold, in order."""
        logits, starts = self.sentence_logits(text)
        words, ends = words_of(text), np.append(starts[1:], len(words_of(text)))
        p = sigmoid(logits)
        return [
            (b" ".join(words[starts[i] : ends[i]]).decode("utf-8", "replace"), float(p[i]))
            for i in np.flatnonzero(p >= threshold)
        ]


def fit_texts(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> ToxicityModel:
    """Maximum penalised likelihood of document labels under the noisy-or rule."""
    if not len(toxic) or toxic.min() == toxic.max():
        return ToxicityModel(None, 0.0, float(toxic.max()) if len(toxic) else 0.0)
    index: dict[bytes, int] = {}
    closing: list[bool] = []
    tokens, sentence_of, sentences_in, label, importance = [], [], [], [], []
    n_sentences = 0
    for text, y, w in zip(texts, toxic, weight):
        words = words_of(text)
        if not words:
            continue
        for x in words:
            if x not in index:
                index[x] = len(index)
                closing.append(closes(x))
        ids = np.fromiter((index[x] for x in words), np.int32, len(words))
        starts = sentence_starts(np.array([closing[i] for i in ids]))
        lengths = np.diff(np.append(starts, len(ids)))
        fresh = np.append(True, ids[1:] != ids[:-1])
        tokens.append(ids[fresh])
        sentence_of.append((np.repeat(np.arange(len(starts)), lengths) + n_sentences)[fresh])
        n_sentences += len(starts)
        sentences_in.append(len(starts))
        label.append(y)
        importance.append(w)
    if not tokens:
        return ToxicityModel(None, 0.0, 0.0)
    counts = np.array(sentences_in)
    doc = np.cumsum(counts) - counts
    y, w = np.array(label, bool), np.array(importance) / np.sum(importance)
    token, sentence = np.concatenate(tokens), np.concatenate(sentence_of)

    def pull(z: np.ndarray, noise: float, longer: float = 1.0) -> tuple[np.ndarray, float]:
        """Derivatives of the negative log likelihood by the log odds of every sentence, and of the noise.

        A clean document stands for one ``longer`` times as long; a share :data:`MISSED` of them hides an offence.
        """
        total = np.maximum(np.add.reduceat(softplus(z), doc), 1e-9)
        none = np.exp(-total)
        said = 1 - (1 - noise) * none  # chance of a label that says toxic
        clean = (1 - MISSED) * np.exp(-np.minimum(longer * total, 700.0))
        # p of the sentence, times what its document makes of it
        factor = np.where(y, -(1 - noise) * none / said, longer * clean / (clean + MISSED)) * w
        by_noise = np.where(y, -none / said, 1 / (1 - noise)) * w
        return sigmoid(z) * np.repeat(factor, counts), float(by_noise.sum()) * noise * (1 - noise)

    values = {"bias": np.full(1, START)}
    adam = Adam(RATE)
    for _ in range(ROUNDS // 4):
        adam.step(values, {"bias": pull(np.repeat(values["bias"], n_sentences), 0.0)[0].sum(keepdims=True)})

    # Only features that occur often enough and lean towards toxic documents are fitted, and
    # their weights are never negative: no word makes up for an offensive one.
    table = np.array([features(x) for x in index], np.int32)
    doc_of = np.repeat(np.arange(len(counts)), counts)[sentence]
    pairs = np.unique(doc_of.astype(np.int64) * len(index) + token)
    seen = np.bincount(table[pairs % len(index)].ravel(), minlength=BUCKETS)
    dz, _ = pull(np.repeat(values["bias"], n_sentences), 0.0)

    def per_feature(x: np.ndarray) -> np.ndarray:
        return np.bincount(table.ravel(), np.repeat(np.bincount(token, x[sentence], len(index)), table.shape[1]), BUCKETS)

    useful = (-per_feature(dz) > EVIDENCE * np.sqrt(per_feature(dz * dz))) & (seen >= LEAST_DOCS)
    useful[EMPTY] = False
    part = shares(table)
    table = np.where(useful[table], table, EMPTY)
    words = np.flatnonzero((table != EMPTY).any(axis=1))
    new = np.full(len(index), -1)
    new[words] = np.arange(len(words))
    table, part, known = table[words], part[words], new[token] >= 0
    token, sentence = new[token[known]], sentence[known]

    values["weights"] = np.zeros(BUCKETS)
    values["noise"] = np.full(1, np.log(NOISE / (1 - NOISE)))
    for turn in range(2 * rounds):
        if turn == rounds:
            # From here the floor is the constant one; sentences that stood out keep their odds.
            values["weights"] *= (1 - FLOOR) / (1 - min(values["bias"][0], 0.0))
            values["bias"][:] = FLOOR
        # fitted on with hardly any penalty at the end, else weights stay short
        penalty = SPARSITY if turn < rounds else SPARSITY / 20
        longer = LONGER ** min(1.0, max(0.0, (turn - rounds) / (0.75 * rounds)))  # step by step, else doubtful documents count as hidden
        word = (values["weights"][table] * part).sum(axis=1)
        z = np.bincount(sentence, word[token], n_sentences) + values["bias"]
        dz, dnoise = pull(z, float(sigmoid(values["noise"])[0]), longer)
        dword = np.bincount(token, dz[sentence], len(words))
        g = np.bincount(table.ravel(), (part * dword[:, None]).ravel(), BUCKETS)
        g = np.where(useful, g + penalty, 0)
        bias = dz.sum(keepdims=True) if turn < rounds else np.zeros(1)
        adam.step(values, {"weights": g, "noise": np.full(1, dnoise), "bias": bias})
        np.maximum(values["weights"], 0, out=values["weights"])
        if turn >= rounds:
            values["bias"][:] = FLOOR
    return ToxicityModel(SHARP * values["weights"], SHARP * FLOOR)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_class: int = PER_CLASS,
) -> ToxicityModel:
    """Fit on labelled documents outside the held-out third.

    At most ``per_class`` documents of each class are read, chosen by a digest
    of the key and weighted back to the sizes of the classes. With no label,
    or one class only, the model says 0, or that class, for every text.
    """
    train = labels.filter(~held_out(F.col(key)))
    target = F.when(F.col(label) > 0, 1).when(F.col(label) == 0, 0)
    sample, sizes = labelled_sample(docs, train, key, text, target, per_class)
    y = sample.column("class").to_numpy()
    drawn = np.maximum(np.bincount(y, minlength=2), 1)
    weight = np.array([sizes.get(0, 0) / drawn[0], sizes.get(1, 0) / drawn[1]])[y]
    return fit_texts(raw(sample.column("text").combine_chunks()), y, weight)


def _score(model, columns: list[str]):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            scores = [own.score(x) for x in raw(batch.column("text"))]
            rows = unpacked(batch.column("row"), columns)
            yield pa.RecordBatch.from_arrays([*rows, pa.array(scores, pa.float64())], [*columns, "score"])

    return task


def _located(model, threshold: float):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            rows = [
                (i, s, p)
                for i, x in enumerate(raw(batch.column("_text")))
                for s, p in own.offending(x, threshold)
            ]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(at),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.float64()),
                ],
                ["_id", "sentence", "score"],
            )

    return task


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Every row with all its columns and ``score``, the probability that it is toxic.

    Only the text is looked at. Null, empty and blank texts have no sentence
    and score 0. Repeated rows score alike; a column ``score`` is replaced.
    """
    columns = [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(whole_row(columns).alias("row"), F.col(text).alias("text")).mapInArrow(
        _score(shared, columns), f"{kinds(docs, columns)}, score double"
    )


def offending_sentences(
    docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.5
) -> DataFrame:
    """(key, sentence, score) of every sentence whose own score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    found = narrow.mapInArrow(_located(shared, threshold), f"_id {kind}, sentence string, score double")
    return found.withColumnRenamed("_id", key)
