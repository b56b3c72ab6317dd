"""Language identification with string kernels.

Kernel: blended-spectrum presence kernel. A text is the set of its byte n-grams of lengths
1 to 4 in lower-cased UTF-8, letters only (all else is one separator), hashed into ``DIM``
places; k(x, y) is the size of the intersection divided by the root of the sizes' product.
Nyström: a bounded number of landmark texts spans the kernel space; one-versus-rest kernel
ridge regression is fitted on a bounded sample. The weights of landmarks are multiplied out
into one ``DIM`` x classes matrix, and batches of presence vectors are scored by one matrix
product. Every text is read whole.

Bounds (parameters): ``each`` training rows per class, ``landmarks`` in all. Only presence
bits of training rows (``DIM`` / 8 bytes each) reach the driver, never texts.

Null and empty texts and texts without a letter get ``und`` and score 0. With no labelled row
every text gets ``und``. Of classes with equal scores the first by name is given. Long texts
are hashed in overlapping parts, whole. Rows are judged one by one, so repeated rows get equal
predictions; in training, rows with one id and label count once. An empty table gives an empty
result. Input columns named as an output are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflock.llm.carry import add_columns
from meshflock.llm.sampling import per_class

DIM = 1 << 15
LETTER = re.compile(r"[^\W\d_]")
CODES = np.zeros(256, np.uint32)
CODES[97:123] = np.arange(1, 27)
CODES[128:] = np.arange(27, 155)
MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
CHUNK = 1 << 20


def presence(text: str) -> np.ndarray:
    """Bits of the n-grams that the text has."""
    bits = np.zeros(DIM, bool)
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    for at in range(0, len(data), CHUNK):  # a long text in parts that overlap by an n-gram
        a = CODES[data[at : at + CHUNK + 3]]
        h = a * MIX[0]
        bits[h >> np.uint32(17)] = True
        for n in range(1, 4):
            if len(a) <= n:
                break
            h = (h[:-1] * np.uint32(31)) ^ (a[n:] * MIX[n])
            bits[(h * np.uint32(0x9E3779B1)) >> np.uint32(17)] = True
    return bits


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.sqrt(np.maximum(a.sum(1), 1)), np.sqrt(np.maximum(b.sum(1), 1))
    return (a @ b.T) / na[:, None] / nb[None, :]


def fit(bits: np.ndarray, labels: list[str], landmarks: int, ridge: float) -> tuple[list[str], np.ndarray]:
    """Classes and the DIM x classes weights of kernel ridge regression in the landmarks' space."""
    classes = sorted(set(labels))
    y = np.where(np.array([[c == v for c in classes] for v in labels]), 1.0, -1.0)
    step = max(1, len(bits) // landmarks)
    marks = bits[::step][:landmarks].astype(np.float64)
    kmm = kernel(marks, marks)
    values, vectors = np.linalg.eigh(kmm)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([kernel(bits[i : i + 256].astype(np.float64), marks) for i in range(0, len(bits), 256)]) @ root
    weight = 1.0 / (y > 0).sum(0)  # classes count alike
    w = np.where(y > 0, weight, 0).sum(1) * len(y) / len(classes)
    mean = (w[:, None] * y).sum(0) / w.sum()
    beta = np.linalg.solve(phi.T @ (w[:, None] * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (w[:, None] * (y - mean)))
    alpha = root @ beta
    return classes, np.vstack([marks.T @ (alpha / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]), mean[None, :]]).astype(np.float32)


def collect_bits(sample: DataFrame, label: str, key: str) -> tuple[np.ndarray, list[str]]:
    def run(batches):
        for b in batches:
            packed = [np.packbits(presence(t or "")).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["k", "label", "bits"])

    cols = sample.select(F.col(key).cast("string").alias("k"), F.col(label).alias("label"), F.col("text"))
    rows = sorted(cols.mapInArrow(run, "k string, label string, bits binary").toArrow().to_pylist(), key=lambda r: (r["k"], r["bits"]))
    bits = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8)).reshape(len(rows), DIM) if rows else np.zeros((0, DIM), np.uint8)
    return bits, [r["label"] for r in rows]


def train(labelled: DataFrame, label: str = "lang", key: str = "doc_id", each: int = 600, landmarks: int = 384, ridge: float = 1.0) -> tuple[list[str], np.ndarray]:
    """Fit on rows with a label and a text (columns key, label, text)."""
    usable = labelled.where(F.col("text").isNotNull())
    sample, _ = per_class(usable, usable, label, each, key)
    bits, labels = collect_bits(sample, label, key)
    return fit(bits, labels, landmarks, ridge) if labels else ([], np.zeros((DIM + 1, 0), np.float32))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row."""
    classes, weights = model

    def judged(texts):
        texts = texts.to_pylist()
        known = [i for i, t in enumerate(texts) if t is not None and classes and LETTER.search(t)]
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            x = np.stack([presence(texts[i]) for i in known]).astype(np.float32)
            f = (x @ weights[:-1]) / np.sqrt(np.maximum(x.sum(1), 1))[:, None] + weights[-1]
            p = np.exp(4 * (f - f.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            for i, k, v in zip(known, f.argmax(1), p.max(1), strict=True):
                pred[i], score[i] = classes[k], min(1.0, float(v))
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

    return add_columns(docs, lambda: judged, [("lang_pred", "string"), ("score", "double")], [text], rows=256)
