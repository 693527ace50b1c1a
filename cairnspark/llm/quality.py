"""Quality classifier on supervised subword embeddings.

Words and their character n-grams are hashed to learned vectors; a document
is the average of its vectors and a softmax layer reads it. Trained by
stochastic gradient descent in numpy on a bounded, seeded sample of labelled
documents, taken in full length and turned into features where they are read.
For scoring the softmax layer is folded into the vectors: a feature is one
number, a word the sum of its features. Features are worked out for all
distinct words of some documents at once.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import clear_of, hash_sample, stored, texts
from .blobs import gathered, slices, tidied

#: Bytes of text whose words get their features at once.
SLICE = 2 << 20


@dataclass(frozen=True)
class Settings:
    """max_docs bounds the training sample (half of it per label) and
    max_features the distinct features of its documents together, beyond which
    none is taken. A document's average counts ``smooth`` features of no
    weight besides its own, so that a few words settle little. The rest are
    the sizes of the model and of its training."""

    max_docs: int = 4000
    max_features: int = 1 << 25
    buckets: int = 1 << 17
    dim: int = 8
    ngrams: tuple[int, int] = (3, 4)
    smooth: float = 64.0
    epochs: int = 4
    batch: int = 16
    rate: float = 4.0
    seed: int = 7


def features(words: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, one word's after another's, and each word's
    number: the word itself and its character n-grams, the ends of the word
    being characters too."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "><")[0].as_py()
    signs = np.frombuffer(f"<{joined}>".encode("utf-32-le"), dtype=np.uint32)
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 2
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(signs)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place
    step = np.uint32(0x9E3779B1)
    powers = np.cumprod(np.full(int(sizes.max()), step, dtype=np.uint32), dtype=np.uint32)
    low, high = s.ngrams
    found = np.zeros((len(signs), high - low + 2), dtype=np.uint32)
    found[starts, 0] = np.add.reduceat(signs * powers[place], starts, dtype=np.uint32) ^ np.uint32(0x85EBCA6B)
    code = signs.copy()
    for n in range(2, high + 1):
        code = code[:-1] * step + signs[n - 1 :]
        if n >= low:
            found[: len(code), n - low + 1] = code + np.uint32(n)
    found = (found ^ (found >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    found ^= found >> np.uint32(13)
    held = left[:, None] >= np.array([0, *range(low, high + 1)])
    held[:, 0] = place == 0
    return (found[held] & np.uint32(s.buckets - 1)).astype(np.int64), np.add.reduceat(held.sum(axis=1), starts)


def documents(texts: pa.Array, s: Settings):
    """Feature buckets of each text and their shares, all of weight one."""
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    buckets, sizes = features(coded.dictionary, s)
    which, ends = coded.indices.to_numpy(), np.cumsum(words.value_lengths().to_numpy())
    blank = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)  # stands before leading white space
    for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        own, count = np.unique(which[begin:end], return_counts=True)
        own, count = own[~blank[own]], count[~blank[own]]
        found, _ = gathered(buckets, sizes, own)
        some, at = np.unique(found, return_inverse=True)
        share = np.bincount(at, weights=np.repeat(count, sizes[own]), minlength=len(some)).astype(np.float32)
        yield some, share / (share.sum() + s.smooth)


@dataclass
class Model:
    margins: np.ndarray  # of each bucket, towards label 1
    bias: float
    settings: Settings

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Of every text; one without words has the bias alone."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        buckets, sizes = features(coded.dictionary, self.settings)
        total = np.add.reduceat(self.margins[buckets], np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
        blank = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)  # stands before leading white space
        total, sizes = np.where(blank, 0.0, total), np.where(blank, 0, sizes)
        which, lens = coded.indices.to_numpy(), words.value_lengths().to_numpy().astype(np.int64)
        z, some = np.full(len(lens), self.bias), lens > 0
        if some.any():
            at = (np.cumsum(lens) - lens)[some]
            z[some] += np.add.reduceat(total[which], at) / (np.add.reduceat(sizes[which], at) + self.settings.smooth)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def train(sample: list[tuple[bytes, int]], prior: tuple[int, int], s: Settings) -> Model:
    """``learn`` from (text, label) pairs."""
    return learn(list(documents(pa.array([t.decode() for t, _ in sample], pa.string()), s)), [y for _, y in sample], prior, s)


def learn(docs: list[tuple[np.ndarray, np.ndarray]], marks: list[int], prior: tuple[int, int], s: Settings) -> Model:
    """Fit on the documents' features and labels. ``prior`` holds the counts
    of both labels among all training rows: the sample's own balance is taken
    out again."""
    rng, labels = np.random.default_rng(s.seed), np.array(marks, dtype=np.int64)
    vectors = ((rng.random((s.buckets, s.dim)) - 0.5) / s.dim).astype(np.float32)
    top, bias = (rng.standard_normal((2, s.dim)) / math.sqrt(s.dim)).astype(np.float32), np.zeros(2, np.float32)
    steps, step = max(1, s.epochs * -(-len(docs) // s.batch)), 0
    for _ in range(s.epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), s.batch):
            rate = s.rate * (1 - step / steps)
            step += 1
            rows = [i for i in order[at : at + s.batch] if len(docs[i][0])]
            if not rows:
                continue
            f, share = (np.concatenate([docs[i][k] for i in rows]) for k in (0, 1))
            sizes = np.array([len(docs[i][0]) for i in rows])
            hidden = np.add.reduceat(vectors[f] * share[:, None], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            logits = hidden @ top.T + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            back = p @ top
            top -= rate / len(rows) * (p.T @ hidden)
            bias -= rate / len(rows) * p.sum(axis=0)
            np.add.at(vectors, f, -rate * share[:, None] * np.repeat(back, sizes, axis=0))
    seen = np.bincount(labels, minlength=2) + 1
    shift = math.log((prior[1] + 1) / (prior[0] + 1) * seen[0] / seen[1])
    return Model((vectors @ (top[1] - top[0])).astype(np.float64), float(bias[1] - bias[0]) + shift, s)


def _featured(s: Settings):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                packed = [zlib.compress(b.astype("<u4").tobytes() + w.astype("<f4").tobytes(), 1) for b, w in documents(part.column("text"), s)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(packed, pa.binary())], names=["doc_id", "y", "features"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, settings: Settings = Settings(), label: str = "quality") -> Model:
    """Train on labelled rows whose crc32(doc_id as text) mod ``fold`` is not
    ``held``: of each label those first in a seeded hash order, within
    ``settings.max_docs`` and ``settings.max_features``. No text comes to the
    driver. Rows with a null label or doc_id are not used; of several labels
    of a doc_id both are, and of several texts the smallest."""
    train_on = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    train_on = train_on.where(F.crc32(F.col("doc_id").cast("string")) % fold != held)
    prior = {r["y"]: r["count"] for r in train_on.groupBy("y").count().collect()}
    ids = [(r["doc_id"], y) for y in (0, 1) for r in hash_sample(train_on.where(F.col("y") == y).distinct(), ["doc_id"], settings.max_docs // 2, settings.seed)]
    if not ids:
        return Model(np.zeros(settings.buckets), 0.0, settings)
    small = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")
    found = texts(docs).join(F.broadcast(small), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = stored(found.mapInArrow(tidied(_featured(settings)), "doc_id long, y int, features binary"), "features")
    sample, room = [], settings.max_features
    for r in found.orderBy(F.xxhash64(F.lit(settings.seed), "doc_id"), "doc_id", "y").toLocalIterator():
        data = zlib.decompress(r["features"])
        room -= len(data) // 8
        if room < 0:
            break
        sample.append(((np.frombuffer(data, "<u4", len(data) // 8).astype(np.int64), np.frombuffer(data, "<f4", offset=len(data) // 2)), r["y"]))
    return learn([f for f, _ in sample], [y for _, y in sample], (prior.get(0, 0), prior.get(1, 0)), settings)


def chosen_smooth(docs: DataFrame, labels: DataFrame, candidates: tuple[float, ...] = (4.0, 16.0, 32.0, 64.0, 128.0, 256.0), fold: int = 3, held: int = 1, inner: int = 4, settings: Settings = Settings()) -> dict[float, float]:
    """The mean log loss of each candidate for ``smooth`` on a part of the
    training rows that its model has not learned from; the rows that ``fit``
    holds out take no part. The least loss is the choice."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % fold != held))
    apart = F.xxhash64(F.lit(settings.seed), F.col("doc_id").cast("long")) % inner == 0
    judged = own.where(apart).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    asked, out = stored(texts(docs).join(judged.select("doc_id").distinct(), "doc_id", "left_semi"), "judged"), {}
    for smooth in candidates:
        model = fit(docs, own.where(~apart), fold, held, replace(settings, smooth=smooth))
        p = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
        loss = F.when(F.col("quality") == 1, -F.log(p)).otherwise(-F.log(1 - p))
        out[smooth] = scored(asked, model).join(judged, "doc_id").agg(F.avg(loss)).first()[0]
    return out


class Scorer:
    """Scores one text."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, text: bytes) -> float:
        return float(self.model.scores(pa.array([text.decode()], pa.string()))[0])


def _scores(shared):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(part.column("text")), pa.float64())], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row's whole text; an empty or null text has
    the model's bias alone. The model broadcast has a fixed size."""
    return texts(docs, id_col, text_col).mapInArrow(tidied(_scores(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``. With
    no labelled row every score is 0.5. A null doc_id is not held out; null
    and empty texts have the score of no feature; rows of one doc_id are
    scored each by its own text; an empty table gives an empty result."""
    rows = scored(docs, fit(docs, labels, fold, held, settings))
    return rows.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, with all columns:
    the score is computed beside the row, so nothing is joined. Null texts
    are scored as empty ones; ``docs`` may have columns of any name."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    (rated,) = clear_of(names, "_rated")

    def run(batches):
        for batch in batches:
            for part in slices(batch, rated, SLICE):
                yield part.select(names).filter(pa.array(shared.value.scores(part.column(rated)) >= threshold))

    return docs.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias(rated)).mapInArrow(tidied(run), docs.schema)
