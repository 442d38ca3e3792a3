"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct words, and beginnings of words that are frequent in it, hashed to 2^24
slots. From a bounded sample of labelled rows the
terms that depend on the label (chi-squared) are chosen in Spark, and a factorization machine is fitted to
their presence: bias, a weight for each term, and a vector for each term whose inner products weigh pairs of
terms that occur together. Every text is then scored whole.

Defined results: a null or empty text, or one without any chosen term, gets the bias alone; labels that are
null, and ids without label or document, do not take part; of several labels of one id the largest counts;
without labelled rows of both kinds every text gets the share of label 1 (0 if there is none); null ids and
repeated rows are scored like others; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.labels import SAMPLE_ROWS, labelled_sample
from tallyweave.llm.words import mix, word_hashes
from tallyweave.session import settle

SLOT_BITS = 24
#: Length of the beginnings of words, and the shares of a text's words that count.
HEAD_BYTES = 5
RATES = (1 / 16, 1 / 32, 1 / 64, 1 / 128, 1 / 256)
#: Most terms that are chosen; the sample's bound is in ``labels``.
TERMS = 4_096
LEAST_ROWS_OF_TERM = 4
LEAST_CHI2 = 10.8
FACTORS = 8
EPOCHS = 40
#: A small sample is gone through more often, until this many steps were taken.
LEAST_STEPS = 1_500
BATCH = 128
RATE = 0.3
DECAY = 1e-4


@dataclass(frozen=True)
class Machine:
    """The fitted model; ``slots`` are sorted."""

    slots: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Probability of label 1 for each of ``rows``, given (row, place of term) pairs without repeats."""
        return 1 / (1 + np.exp(-np.clip(_margin(self, row, term, rows)[0], -30, 30)))


def _margin(model: Machine, row: np.ndarray, term: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    linear = np.bincount(row, model.weights[term], rows)
    sums = np.stack([np.bincount(row, model.factors[term, f], rows) for f in range(model.factors.shape[1])], axis=1)
    squares = np.bincount(row, (model.factors[term] ** 2).sum(axis=1), rows)
    return model.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def train(slots: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Fit by AdaGrad on the logistic loss; ``rows`` hold places of terms in ``slots``."""
    random = np.random.default_rng(seed)
    n = len(slots)
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    model = Machine(slots, bias, np.zeros(n), random.normal(0, 0.05, (n, FACTORS)))
    if not n or share in (0.0, 1.0):
        return model
    grown_w, grown_v, grown_b = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // len(rows))):
        order = random.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            row = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            term = np.concatenate([rows[i] for i in part]) if len(row) else np.zeros(0, np.int64)
            margin, sums = _margin(model, row, term, len(part))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)
            grad_b = slope.sum()
            grown_b += grad_b**2
            model = Machine(slots, model.bias - RATE * grad_b / np.sqrt(grown_b), model.weights, model.factors)
            if not len(row):
                continue
            touched, at = np.unique(term, return_inverse=True)
            grad_w = np.bincount(at, slope[row], len(touched)) + DECAY * model.weights[touched]
            each = slope[row][:, None] * (sums[row] - model.factors[term])
            grad_v = np.stack([np.bincount(at, each[:, f], len(touched)) for f in range(FACTORS)], axis=1)
            grad_v += DECAY * model.factors[touched]
            grown_w[touched] += grad_w**2
            grown_v[touched] += grad_v**2
            model.weights[touched] -= RATE * grad_w / np.sqrt(grown_w[touched])
            model.factors[touched] -= RATE * grad_v / np.sqrt(grown_v[touched])
    return model


def _terms_of(texts: list[str | None]):
    """(first row, row of each term, slot of each term, rows), for runs of texts.

    A text's terms are its words, and the beginnings of its words with each of RATES that their share of
    the words reaches.
    """
    for first, hashes, heads, counts in word_hashes(texts, HEAD_BYTES):
        row = np.repeat(np.arange(len(counts)), counts)
        rows, slots = [row], [_slot(hashes)]
        key, times = np.unique((row << 40 | (heads >> np.uint64(24)).astype(np.int64))[heads != 0], return_counts=True)
        owner, head = key >> 40, key & ((1 << 40) - 1)
        share = times / np.maximum(counts[owner], 1)
        for j, rate in enumerate(RATES):
            often = share >= rate
            rows.append(owner[often])
            slots.append(_slot(mix(head[often].astype(np.uint64) * np.uint64(2 * len(RATES) + 1) + np.uint64(j))))
        yield first, np.concatenate(rows), np.concatenate(slots), len(counts)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _distinct(row: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row << bits | value)
    return key >> bits, key & ((1 << bits) - 1)


def term_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, label, slots): the distinct slots of each text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, row, slots, rows in _terms_of(texts):
                row, slots = _distinct(row, slots, SLOT_BITS)
                offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(slots.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, rows), batch.column("label").slice(first, rows), lists], ["doc_id", "label", "slots"]
                )

    return docs.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {id_type}, label int, slots array<int>")


def fit(docs: DataFrame, labels: DataFrame, label_col: str, training: Column, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine fitted to the labelled rows of ``docs`` that ``training``, a condition on doc_id, admits."""
    # the sample is bounded, hence so is what is broadcast
    sample = F.broadcast(labelled_sample(labels, label_col, training, SAMPLE_ROWS))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = settle(term_rows(texts.join(sample, "doc_id")), "terms").withColumn("row", F.monotonically_increasing_id())
    total, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    both, either = F.col("both"), F.col("either")
    odds = both * (total - ones - (either - both)) - (ones - both) * (either - both)
    chi2 = F.lit(float(total)) * odds * odds / (F.lit(float(max(ones, 1))) * max(total - ones, 1) * either * (F.lit(total) - either + 1e-9))
    chosen = (
        rows.select("label", F.explode("slots").alias("slot")).groupBy("slot")
        .agg(F.count("*").cast("double").alias("either"), F.sum("label").cast("double").alias("both"))
        .filter(F.col("either") >= LEAST_ROWS_OF_TERM).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc("chi2"), "slot").limit(TERMS)
    )
    slots = np.sort(np.array([r[0] for r in chosen.select("slot").collect()], np.int64))
    picked = F.array_intersect("slots", F.array(*[F.lit(int(s)) for s in slots])) if len(slots) else F.array().cast("array<int>")
    data = rows.select("doc_id", "label", picked.alias("slots")).orderBy("doc_id").toArrow() if total else None
    if data is None:
        return train(slots, [], np.zeros(0))
    found = [np.searchsorted(slots, np.array(s, np.int64)) for s in data.column("slots").to_pylist()]
    return train(slots, found, data.column("label").to_numpy().astype(float))


def _scored_batches(batches, machine: Machine, text: str):
    """(batch, scores) for runs of rows."""
    known = np.zeros(1 << SLOT_BITS, bool)
    known[machine.slots] = True
    bits = max(1, int(len(machine.slots)).bit_length())
    for batch in batches:
        for first, row, slots, rows in _terms_of(batch.column(text).to_pylist()):
            hit = known[slots]
            row, term = _distinct(row[hit], np.searchsorted(machine.slots, slots[hit]), bits)
            yield batch.slice(first, rows), machine.scores(row, term, rows)


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, without a shuffle."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, scores in _scored_batches(batches, sent.value, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return texts.mapInArrow(run, f"doc_id {id_type}, score double")


def keep_below(docs: DataFrame, model: Machine, most: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``most``; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for part, scores in _scored_batches(batches, sent.value, f"c{names.index(text_col)}"):
            yield part.filter(pa.array(scores < most))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
