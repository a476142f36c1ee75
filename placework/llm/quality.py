"""Document quality by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages. Each passage is encoded from what its characters and words look like, a gated attention
weighs the encodings, and the weighted sum is scored. Encoder, attention and score are trained together from document
labels, by gradient descent on a bounded sample of labelled documents; all passages of all documents are scored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_PIECE, mix, pieces, text_of, word_hashes

PASSAGE_WORDS = 64
# Labelled documents that training uses, those with the least hash of their id.
TRAINING_DOCUMENTS = 4000
THRESHOLD = 0.7
ENCODED, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 16, 8, 40, 64, 0.01, 1e-4

# Classes of bytes; UTF-8 bytes of other than ASCII characters are one class.
_CLASSES = [" \t", "\n\r", "".join(map(chr, range(97, 123))), "".join(map(chr, range(65, 91))), "0123456789", ".", ",",
            "!?", "|", "#$%&*", "\"'()[]{}<>", "-_/\\:;=+@~^`"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _number, _characters in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _characters]] = _number
_CLASS[128:] = len(_CLASSES) + 1
_SHARES = len(_CLASSES) + 2
FEATURES = _SHARES + 6


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (at least one, of no words if need be)."""
    data = [t.encode() for t in texts]
    words, offsets = word_hashes(data)
    counts = np.diff(offsets)
    passages = np.maximum(-(-counts // PASSAGE_WORDS), 1)
    first = np.cumsum(passages) - passages
    owner = np.repeat(np.arange(len(texts)), counts)
    passage = first[owner] + (np.arange(len(words)) - offsets[:-1][owner]) // PASSAGE_WORDS
    total = int(passages.sum())
    out = np.zeros((total, FEATURES))

    # Bytes by passage: a byte belongs to the passage of the last word that began before it.
    raw = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    text_starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])]).astype(np.int64)
    space = np.isin(raw, np.frombuffer(b"\t\n\v\f\r ", np.uint8))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(raw) else np.zeros(0, np.int64)
    edges = np.concatenate([text_starts[:-1], starts])
    at = np.concatenate([first, passage])
    order = np.argsort(edges, kind="stable")
    lengths = np.diff(np.append(edges[order], len(raw)))
    of_byte = np.repeat(at[order], lengths)
    shares = np.bincount(of_byte * _SHARES + _CLASS[raw], minlength=total * _SHARES).reshape(total, _SHARES)
    size = np.maximum(shares.sum(axis=1), 1)
    out[:, :_SHARES] = shares / size[:, None]

    n = np.bincount(passage, minlength=total)
    some = np.maximum(n, 1)
    letters = shares[:, 2:].sum(axis=1)
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1 if len(raw) else starts
    word_bytes = ends - starts
    keys = mix(words + mix(passage))
    order = np.argsort(keys)
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
    again = (words[1:] == words[:-1]) & (passage[1:] == passage[:-1]) if len(words) else np.zeros(0, bool)
    out[:, _SHARES] = np.log1p(n)
    out[:, _SHARES + 1] = letters / some / 10
    out[:, _SHARES + 2] = np.bincount(passage[order][new], minlength=total) / some
    out[:, _SHARES + 3] = np.bincount(passage[1:][again], minlength=total) / some if len(words) else 0
    out[:, _SHARES + 4] = np.bincount(passage, word_bytes <= 4, total) / some
    out[:, _SHARES + 5] = np.bincount(passage, word_bytes > 20, total) / some
    return out, passages


@dataclasses.dataclass
class AttentionModel:
    """Standardisation of the features, encoder (w, b), gates (v, u), attention (a), score (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, features: np.ndarray, passages: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (features - self.mean) / self.scale, passages)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(m: dict[str, np.ndarray], x: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.cumsum(passages) - passages
    h = np.tanh(x @ m["w"] + m["b"])
    t, s = np.tanh(h @ m["v"]), _sigmoid(h @ m["u"])
    e = (t * s) @ m["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), passages))
    alpha = e / np.repeat(np.add.reduceat(e, starts), passages)
    z = np.add.reduceat(alpha[:, None] * h, starts)
    return {"h": h, "t": t, "s": s, "alpha": alpha, "z": z, "p": _sigmoid(z @ m["c"] + m["d"])}


def _gradients(m, x, passages, y) -> dict[str, np.ndarray]:
    f = _forward(m, x, passages)
    starts = np.cumsum(passages) - passages
    h, t, s, alpha = f["h"], f["t"], f["s"], f["alpha"]
    d_logit = (f["p"] - y) / len(y)
    d_z = np.repeat(d_logit[:, None] * m["c"], passages, axis=0)
    d_alpha = (d_z * h).sum(axis=1)
    d_e = alpha * (d_alpha - np.repeat(np.add.reduceat(alpha * d_alpha, starts), passages))
    d_gate = d_e[:, None] * m["a"]
    d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
    d_h = (alpha[:, None] * d_z + d_t @ m["v"].T + d_s @ m["u"].T) * (1 - h * h)
    return {
        "w": x.T @ d_h, "b": d_h.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s, "a": (t * s).T @ d_e,
        "c": f["z"].T @ d_logit, "d": d_logit.sum(keepdims=True),
    }


def train_attention(bags: list[np.ndarray], labels: list[int], seed: int = 5) -> AttentionModel:
    """Fit to bags of passage features and 0/1 labels with Adam. Without any label the model scores 0.5 for all."""
    rng = np.random.default_rng(seed)
    shapes = {"w": (FEATURES, ENCODED), "b": (ENCODED,), "v": (ENCODED, ATTENTION), "u": (ENCODED, ATTENTION), "a": (ATTENTION,), "c": (ENCODED,), "d": (1,)}
    m = {k: rng.normal(0, 1 / np.sqrt(shape[0]), shape) if len(shape) == 2 or k == "a" else np.zeros(shape) for k, shape in shapes.items()}
    if not bags:
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), m)
    m["c"] = rng.normal(0, 1 / np.sqrt(ENCODED), ENCODED)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 0.01
    bags, y = [(b - mean) / scale for b in bags], np.array(labels, float)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            step += 1
            g = _gradients(m, np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some]), y[some])
            for k in m:
                grad = g[k] + DECAY * m[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                rate = RATE * (1 - epoch / EPOCHS)
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return AttentionModel(mean, scale, m)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in pieces(batch, "content", SMALL_PIECE):
            features, passages = passage_features(texts)
            split = np.split(features, np.cumsum(passages)[:-1])
            quality = part.column(part.schema.get_field_index("quality"))
            yield pa.RecordBatch.from_arrays([quality, pa.array([f.tobytes() for f in split], pa.binary())], names=["quality", "bag"])


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> AttentionModel:
    """A model from up to `most` labelled documents that are not held out; their features come to the driver.

    Labels with a null id or quality are left out; of several labels of an id the greatest counts.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", text_of().alias("content")).join(F.broadcast(sample), "doc_id").select("quality", "content", "doc_id")
    # Repeated ids in docs must not enlarge the sample.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("quality", "content")
    found = rows.mapInArrow(_featured, "quality int, bag binary").collect()
    bags = [np.frombuffer(r["bag"]).reshape(-1, FEATURES) for r in found]
    return train_attention(bags, [r["quality"] for r in found])


def score_quality(docs: DataFrame, model: AttentionModel, column: str = "score") -> DataFrame:
    """docs, all columns as they are, with a score (0 to 1, higher: better) added last under a name of its own.

    A null or empty text is one passage without words and is scored as such; equal texts have equal scores; an empty
    table gives an empty result.
    """
    fields = docs.schema.fieldNames()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", SMALL_PIECE):
                score = model.score(*passage_features([t or "" for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*fields, column])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.7) of every row of docs."""
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of at least 0.7, all columns as they are."""
    scored = score_quality(docs, fit_quality(docs, labels), "_quality_score")
    return scored.where(F.col("_quality_score") >= THRESHOLD).drop("_quality_score")
