"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Its score is ``w0 + w.x + sum over pairs of <v_i, v_j> x_i x_j``. The pair sum of n features costs n operations per factor, since it is half the
difference between the square of the sum and the sum of the squares. The model is fitted on a bounded sample of labelled
documents, chosen by a hash of their id, which is the only thing that reaches the driver; scoring is a map over whole texts.

Defined cases: a null text counts as empty; an empty text is scored from its statistics; null metadata counts as zero; a
document with several labels has their mean, from 0.5 on as 1; labels that are null or belong to no document are not used; without a usable
label every score is 0.5; rows without id and repeated rows are scored like any others, and only rows with id are held out or
trained on; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of

#: Buckets of hashed words.
WORD_BUCKETS = 4096
FACTORS = 8
#: Labelled documents the model is fitted on, about; the bound on what reaches the driver.
TRAINING_DOCUMENTS = 8192
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.02, 1e-4, 7
HELD_OUT_OF = 5
CUT = 0.3
#: Words whose bucket a task remembers.
WORDS_HELD = 1_000_000

STATISTICS = 13
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?"


def _share(raw: bytes, of: bytes) -> float:
    return (len(raw) - len(raw.translate(None, of))) / max(1, len(raw))


class Words:
    """Bucket of each word, remembered up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def bucket(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= WORDS_HELD:
                self.known.clear()
            found = self.known[word] = zlib.crc32(word) % WORD_BUCKETS
        return found


def features_of(text: str, metadata: list[float], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words with a norm of one, then statistics, then metadata."""
    raw = text.encode()
    tokens = raw.lower().split()
    counts = Counter(tokens)
    buckets: dict[int, float] = {}
    for word, count in counts.items():
        bucket = words.bucket(word)
        buckets[bucket] = buckets.get(bucket, 0.0) + count
    weights = np.log1p(np.fromiter(buckets.values(), dtype=np.float64, count=len(buckets)))
    weights /= max(1e-9, float(np.sqrt((weights**2).sum())))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    statistics = [
        np.log1p(len(tokens)),
        len(raw) / max(1, len(tokens)),
        _share(raw, _SYMBOLS),
        _share(raw, _UPPER),
        _share(raw, _MARKS),
        _share(raw, _DIGITS),
        (len(raw) - len(text)) / max(1, len(raw)),
        len(counts) / max(1, len(tokens)),
        max(counts.values(), default=0) / max(1, len(tokens)),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(raw) / max(1, len(lines))),
        raw.count(b"|") / max(1, len(tokens)),
        sum(len(w) <= 2 for w in tokens) / max(1, len(tokens)),
    ]
    dense = np.array([*statistics, *(np.log1p(abs(m)) for m in metadata)])
    indices = np.concatenate([np.fromiter(buckets, dtype=np.int64, count=len(buckets)), WORD_BUCKETS + np.arange(len(dense))])
    return indices, np.concatenate([weights, dense])


class Model(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values with the dense part standardised, and held within five spreads."""
        dense = indices >= WORD_BUCKETS
        out, place = values.copy(), indices[dense] - WORD_BUCKETS
        out[dense] = np.clip((values[dense] - self.mean[place]) / self.spread[place], -5, 5) / 4
        return out

    def odds(self, indices: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-odds of several documents, whose features stand one after the other from ``starts`` on."""
        weighted = self.factors[indices] * values[:, None]
        sums = np.add.reduceat(weighted, starts)
        pairs = (sums**2 - np.add.reduceat(weighted**2, starts)).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.linear[indices] * values, starts) + pairs


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dense: int) -> Model:
    """Logistic loss, Adam on mini-batches."""
    size, rng = WORD_BUCKETS + dense, np.random.default_rng(SEED)
    table = np.array([values[-dense:] for _, values in documents])
    spread = table.std(axis=0)
    blank = Model(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), table.mean(axis=0), np.where(spread > 1e-9, spread, 1.0))
    rows = [(i, blank.scaled(i, v)) for i, v in documents]
    rate = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    weights = [np.array([np.log(rate / (1 - rate))]), blank.linear, blank.factors]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            chosen = order[at : at + BATCH]
            indices, values = (np.concatenate([rows[c][part] for c in chosen]) for part in (0, 1))
            sizes = np.array([len(rows[c][0]) for c in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            model = Model(float(weights[0][0]), weights[1], weights[2], blank.mean, blank.spread)
            error = (_sigmoid(model.odds(indices, values, starts)) - labels[chosen]) / len(chosen)
            each = np.repeat(error, sizes) * values
            weighted = weights[2][indices] * values[:, None]
            sums = np.repeat(np.add.reduceat(weighted, starts), sizes, axis=0)
            linear, factors = DECAY * weights[1], DECAY * weights[2]
            np.add.at(linear, indices, each)
            np.add.at(factors, indices, each[:, None] * (sums - weighted))
            step += 1
            for w, g, m, v in zip(weights, (np.array([error.sum()]), linear, factors), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(float(weights[0][0]), weights[1], weights[2], blank.mean, blank.spread)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == 0, F.lit(False))


def _source(docs: DataFrame, metadata: tuple[str, ...]) -> DataFrame:
    numbers = [F.coalesce(docs[m].cast("double"), F.lit(0.0)) for m in metadata]
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text_of("text").alias("text"), F.array(*numbers).cast("array<double>").alias("metadata")
    )


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...], documents: int = TRAINING_DOCUMENTS) -> Model | None:
    """The model, from labelled rows that are not held out. None without such rows."""
    marks = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .filter(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    )
    share = min(1.0, documents / max(1, marks.count()))
    sample = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [features_of(t, m, words) for t, m in zip(batch.column("text").to_pylist(), batch.column("metadata").to_pylist(), strict=True)]
            columns = [pa.array([x[part] for x in found], pa.list_(kind)) for part, kind in ((0, pa.int64()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *columns], names=["doc_id", "label", "indices", "values"])

    # the sample is bounded by `documents`, give or take its spread
    chosen = _source(docs, metadata).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text", "metadata")
    rows = chosen.mapInArrow(run, "doc_id bigint, label double, indices array<bigint>, values array<double>").toArrow().sort_by([("doc_id", "ascending")])
    if not rows.num_rows:
        return None
    found = zip(_parts(rows["indices"]), _parts(rows["values"]), strict=True)
    return fit(list(found), rows["label"].to_numpy(), STATISTICS + len(metadata))


def _parts(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """A column of lists as views of one array."""
    whole = pa.concat_arrays(lists.chunks)
    offsets = whole.offsets.to_numpy()
    flat = whole.values.to_numpy()
    return [flat[start:stop] for start, stop in zip(offsets[:-1], offsets[1:], strict=True)]


SCORE_SCHEMA = "doc_id bigint, score double"


def score(docs: DataFrame, model: Model | None, metadata: tuple[str, ...]) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                found = [features_of(t, m, words) for t, m in zip(batch.column("text").to_pylist(), batch.column("metadata").to_pylist(), strict=True)]
                for at in range(0, len(found), 256):
                    part = found[at : at + 256]
                    indices, values = (np.concatenate([x[side] for x in part]) for side in (0, 1))
                    starts = np.concatenate([[0], np.cumsum([len(x[0]) for x in part])[:-1]])
                    scores[at : at + 256] = _sigmoid(model.odds(indices, model.scaled(indices, values), starts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return _source(docs, metadata).mapInArrow(run, SCORE_SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, train(docs, labels, metadata), metadata)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
