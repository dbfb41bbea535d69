"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text (other than letters, every character
counts as a blank, and blanks in a row as one) are hashed into ``2 ** BITS`` features. A text's
value of a feature is its share of the text's n-grams times the inverse document frequency. The
model is trained with FTRL-proximal and an elastic-net penalty, which leaves most weights zero;
then one temperature is fitted on rows kept from the training, so the score is a probability.

The training rows are a bounded sample (``SAMPLE_ROWS``) of the labelled rows, chosen by a hash;
the document frequencies are those of the sample. Everything else covers whole texts of all rows.

Null text, and text without a letter: ``und`` with score 1. Null labels and held-out rows are not
learned from. Without any labelled row, every text is ``und``. Other columns play no part.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import as_row, from_row, released, text_batches

BITS = 16
GRAMS = (1, 2, 3)
#: The bound on labelled rows that are learned from, and the part of them kept for calibration.
SAMPLE_ROWS = 8000
CALIBRATION = 5
EPOCHS = 2
#: FTRL: learning rate, its offset, and the weights of the absolute and the squared penalty.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
UNKNOWN = "und"
_OTHER = regex.compile(r"\P{L}+")


def grams(text: str) -> np.ndarray:
    """The feature of every n-gram of the text; empty if it has no letter."""
    plain = _OTHER.sub(" ", text.lower()).strip()
    if not plain:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32)
    found, value = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        value = (value[: len(codes) - n + 1] * np.uint32(0x9E3779B1)) ^ codes[n - 1 :]
        if n in GRAMS:
            mixed = (value + np.uint32(n)) * np.uint32(0x85EBCA77)
            found.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BITS))
    return np.concatenate(found)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their shares of the text's n-grams."""
    features, counts = np.unique(grams(text), return_counts=True)
    return features, counts / max(1, counts.sum())


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, size: int
) -> np.ndarray:
    """Weights (class, feature) after ``EPOCHS`` passes in a fixed random order."""
    z, n = np.zeros((classes, size)), np.zeros((classes, size))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    generator = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in generator.permutation(len(rows)):
            features, values = rows[i]
            zi, ni = z[:, features], n[:, features]
            w = weights(zi, ni)
            p = _softmax(w @ values)
            p[labels[i]] -= 1
            g = p[:, None] * values
            more = ni + g * g
            z[:, features] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[:, features] = more
    return weights(z, n)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = -5.0, 5.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _scaled(row: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = row[1] * idf[row[0]]
    return row[0], values / max(1e-12, np.sqrt((values**2).sum()))


def fit_rows(texts: list[bytes], labels: list[str], order: list[int]) -> dict[str, np.ndarray]:
    """The model of labelled texts; ``order`` (a hash per row) says which ones calibrate it."""
    size = 2**BITS
    names = sorted(set(labels))
    number = {name: k for k, name in enumerate(names)}
    rows = [_counted(t.decode()) for t in texts]
    used = [i for i, r in enumerate(rows) if len(r[0])]
    frequency = np.zeros(size)
    for i in used:
        frequency[rows[i][0]] += 1
    idf = np.log((1 + len(used)) / (1 + frequency)) + 1
    y = np.array([number[x] for x in labels], np.int64)
    train = [i for i in used if order[i] % CALIBRATION] or used
    held = [i for i in used if not order[i] % CALIBRATION]
    w = ftrl([_scaled(rows[i], idf) for i in train], y[train], max(1, len(names)), size)
    logits = np.array([w[:, f] @ v for f, v in (_scaled(rows[i], idf) for i in held)])
    t = _temperature(logits, y[held]) if held and len(names) > 1 else 1.0
    return {
        "names": np.array(names, dtype=str),
        "weights": (w / t).astype(np.float32),
        "idf": idf.astype(np.float32),
        "temperature": np.array(t),
    }


def _packed(model: dict[str, np.ndarray]) -> bytes:
    data = io.BytesIO()
    np.savez_compressed(data, **model)
    return data.getvalue()


def unpacked(model: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(model)) as data:
        return {k: data[k] for k in data.files}


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, bytes, str]] = []
    for batch, texts in text_batches(batches, text=1):
        orders, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        rows += zip(orders, texts, labels, strict=True)
    if rows:
        rows.sort()
        order, texts, labels = (list(c) for c in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array([_packed(fit_rows(texts, labels, order))], pa.binary())], names=["model"]
        )


def fit(
    labelled: DataFrame, text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS
) -> bytes | None:
    """The model (at most a few MB) of a sample of at most ``sample_rows`` of the labelled rows."""
    rows = labelled.filter(F.col(label).isNotNull()).select(
        F.pmod(F.xxhash64(text), F.lit(2**30)).alias("order"),
        F.col(text).cast("string").alias("text"),
        F.col(label).cast("string").alias("label"),
    )
    share = min(1.0, sample_rows / max(1, rows.count()))
    chosen = rows.filter(F.col("order") < int(share * 2**30)).limit(sample_rows)
    models = chosen.coalesce(1).mapInArrow(released(_train), "model binary").collect()
    return models[0]["model"] if models else None


def predictor(model: bytes | None) -> Callable[[Column], Column]:
    """A column function of texts: struct of ``lang_pred`` and ``score``."""

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parts = unpacked(model) if model else None
        for texts in batches:
            yield _predictions(texts, parts)

    return F.pandas_udf(released(predict), "lang_pred string, score double")


def _predictions(texts: pd.Series, parts: dict[str, np.ndarray] | None) -> pd.DataFrame:
    names: list[str] = []
    scores = np.ones(len(texts))
    for i, text in enumerate(texts):
        features = grams(text) if parts is not None and isinstance(text, str) else ()
        if not len(features):
            names.append(UNKNOWN)
            continue
        # Counting by index beats sorting as soon as a text has some thousand n-grams.
        if len(features) > 4000:
            counts = np.bincount(features, minlength=2**BITS)
            found = np.flatnonzero(counts)
            values = counts[found] * parts["idf"][found]
        else:
            found, counts = np.unique(features, return_counts=True)
            values = counts * parts["idf"][found]
        p = _softmax(parts["weights"][:, found] @ values / np.sqrt((values**2).sum()))
        best = int(p.argmax())
        names.append(str(parts["names"][best]))
        scores[i] = p[best]
    return pd.DataFrame({"lang_pred": names, "score": scores})


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text, by five, leaves nothing."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_language(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang"
) -> DataFrame:
    """``docs`` with ``held_out`` and the struct ``predicted`` (lang_pred, score).

    Learns from the rows of ``docs`` that are not held out and have a label.
    """
    model = fit(docs.filter(~held_out(id_column)), text, label)
    return docs.select(
        "*",
        held_out(id_column).alias("held_out"),
        predictor(model)(F.col(text).cast("string")).alias("predicted"),
    )


def identified(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang"
) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``."""
    narrow = docs.select(id_column, text, label)
    return with_language(narrow, id_column, text, label).select(
        id_column, "held_out", "predicted.lang_pred", "predicted.score"
    )


def accepted(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang",
    least: float = 0.0,
) -> DataFrame:
    """The rows of ``docs`` in a learned language with at least the score ``least``."""
    model = fit(docs.filter(~held_out(id_column)), text, label)
    guess = predictor(model)(F.col(text).cast("string"))
    found = docs.select(as_row(docs), guess.alias("guess"))
    good = (F.col("guess.lang_pred") != UNKNOWN) & (F.col("guess.score") >= least)
    return from_row(found.filter(good), docs.columns)
