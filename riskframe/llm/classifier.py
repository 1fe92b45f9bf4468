"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, with a softmax.

Training is stochastic gradient descent in numpy on a bounded sample of labelled documents. Because the output is linear
in the average, a trained model scores by one number for each bucket: the scoring pass is a table look-up and a mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, crc_fold, small_batches, text_bytes

BUCKETS = 1 << 16
#: The most labelled documents that are learned from, the least hashes of their ids: the only bound on what is read.
SAMPLE = 6000
#: The most bytes of features that the driver is sent; where long documents have more, those of the least hashes count.
SAMPLE_BYTES = 256 << 20
GRAMS = (2, 3)


def _byte_classes() -> np.ndarray:
    """White space counts as one blank and digits as one digit."""
    out = np.arange(256, dtype=np.uint32)
    out[[9, 10, 11, 12, 13]] = 32
    out[48:58] = 48
    return out


_CLASSES = _byte_classes()
#: Buckets of the patterns of equal words.
_PATTERNS = np.arange(8) * 7919 + 101


def features(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, buckets of its words, of its runs of bytes, blanks included, and of which of three words in a row are equal; with repeats."""
    words = Words(texts)
    out = []
    for t, a, b in zip(texts, words.bounds[:-1], words.bounds[1:]):
        w = words.hashes[a:b]
        parts = [(w >> np.uint64(48)).astype(np.int64)]
        if len(w) > 2:
            equal = w[1:] == w[:-1]
            parts.append(_PATTERNS[equal[:-1] + 2 * equal[1:] + 4 * (w[2:] == w[:-2])])
        x = _CLASSES[np.frombuffer(t, np.uint8)]
        for n in GRAMS:
            if len(x) >= n:
                h = x[: len(x) - n + 1].copy()
                for i in range(1, n):
                    h = h * np.uint32(0x01000193) ^ x[i : i + len(h)]
                parts.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64))
        out.append(np.concatenate(parts))
    return out


def counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and the share of each."""
    at, n = np.unique(found, return_counts=True)
    return at, n / max(1, n.sum())


@dataclass(frozen=True)
class Model:
    """A score is the logistic function of the mean of a document's bucket weights, plus the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.array([float(self.weights[f].mean(dtype=np.float64)) if len(f) else 0.0 for f in features(texts)], np.float64)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, dimensions: int = 8, visits: int = 30000, rate: float = 4.0, seed: int = 3, batch: int = 32) -> Model:
    """Fits embeddings and the softmax by gradient descent, with about so many visits to documents. rows: distinct buckets and their shares. Without rows, or with one
    label only, the model gives the smoothed share of label 1 to all texts."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    if not len(rows) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (BUCKETS, dimensions)).astype(np.float32) / dimensions
    w, b = np.zeros((2, dimensions), np.float32), np.log(np.array([1 - share, share], np.float32))
    epochs = max(4, -(-visits // len(rows)))
    steps, done = epochs * (-(-len(rows) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            picked = order[a : a + batch]
            at = np.concatenate([rows[i][0] for i in picked])
            by = np.concatenate([rows[i][1] for i in picked]).astype(np.float32)
            lengths = np.array([len(rows[i][0]) for i in picked])
            keep = lengths > 0
            x = np.zeros((len(picked), dimensions), np.float32)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            if len(at):
                x[keep] = np.add.reduceat(e[at] * by[:, None], starts[keep], axis=0)
            z = x @ w.T + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(picked)), labels[picked]] -= 1
            lr = rate * (1 - done / steps)
            done += 1
            g = p / len(picked)
            back = (p @ w)[np.repeat(np.arange(len(picked)), lengths)] * by[:, None]
            w -= lr * (g.T @ x)
            b -= 0.1 * lr * g.sum(axis=0)
            np.subtract.at(e, at, lr * back)
    return Model((e @ (w[1] - w[0])).astype(np.float32), float(b[1] - b[0]))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """quality, f (buckets), s (shares) of the sample. Documents of the held-out fold and labels that are null or not 0 or 1 don't count."""
    small_batches(docs.sparkSession)
    own = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where(crc_fold("_id") != 2)
    # The sample is drawn from ids; texts of no other document are moved.
    drawn = own.orderBy(F.xxhash64("_id"), "_id", "quality").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_d"), text_bytes(text).alias("t")).join(F.broadcast(drawn), F.col("_d") == F.col("_id")).select("_id", "quality", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(f) for f in features(batch["t"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["quality"], pa.array([x.astype(np.uint16).tobytes() for x, _ in found], pa.binary()), pa.array([y.astype(np.float32).tobytes() for _, y in found], pa.binary())], ["_id", "quality", "f", "s"])

    return rows.mapInArrow(run, f"_id {labels.schema['doc_id'].dataType.simpleString()}, quality int, f binary, s binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model that the sample's documents give; the same whatever order they arrive in."""
    scratch = Scratch(docs.sparkSession, "training")
    rows = table = scratch.table(training_rows(docs, labels, sample).withColumn("_o", F.xxhash64("_id")), "features")
    # As many rows as the sample has, of three numbers each.
    upto = F.sum(F.octet_length("f") + F.octet_length("s")).over(Window.orderBy("_o", "_id", "quality").rowsBetween(Window.unboundedPreceding, 0))
    place = F.struct("_o", "_id", "quality")
    last = rows.select("_o", "_id", "quality", upto.alias("_upto")).where(F.col("_upto") <= SAMPLE_BYTES).agg(F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).first()
    if last["n"] < rows.count():
        rows = rows.where(F.col("_o") <= last["last"]["_o"]) if last["n"] else rows.limit(0)
    found = sorted(rows.toLocalIterator(), key=lambda r: (r["_id"], r["quality"], bytes(r["f"])))
    scratch.drop(table)
    rows = [(np.frombuffer(r["f"], np.uint16).astype(np.int32), np.frombuffer(r["s"], np.float32)) for r in found]
    return train(rows, np.array([r["quality"] for r in found], np.int64))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; a row for each row of docs. Null and empty texts have the score of the bias alone."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = known.value.scores(batch["t"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), (crc_fold(doc_id) == 2).alias("held_out"), text_bytes(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """score() of all documents by the model that fit() gives; no labels, or of one value only: every text scores alike."""
    return score(docs, fit(docs, labels, sample))


def kept(docs: DataFrame, model: Model, *, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Rows of docs, whole, whose text scores at least the threshold; in one pass, without a join. Other columns go by unread."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch[text]
                kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
                texts = [x or b"" for x in column.cast(kind).to_pylist()]  # bytes as they are: malformed text can't raise
                yield batch.filter(pa.array(known.value.scores(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
