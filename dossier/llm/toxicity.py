"""Toxicity by a classifier chain: categories are predicted one after another, and a category's
probability is an input of the later ones.

Each link of the chain is a logistic regression on hashed words (present or not) and on the probabilities of the categories before it. For training, those probabilities are out of
fold: a row's come from a model that has not seen the row, so a later link does not learn to trust
an earlier one more than it deserves. Links are trained by follow-the-regularised-leader with an
absolute and a squared penalty, so words of a few rows keep the weight zero; positive rows weigh as
much in all as negative ones.

The training rows are a bounded sample (``SAMPLE_ROWS``) of the labelled rows, chosen by a hash.
Whole texts of all documents are scored.

Null or empty text is scored as a text without words. Null labels are not learned from; a category
without both values has its share as everyone's probability. Labels of repeated ids are used once
per label row. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import text_batches

BITS = 18
SAMPLE_ROWS = 16_000
FOLDS = 4
EPOCHS = 4
#: Follow-the-regularised-leader: learning rate, its offset, absolute and squared penalty.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 15.0, 0.1
_WORDS = re.compile(r"[^\W_]+|[^\w\s]+")


class _Known(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word)
        return value


def features(text: str, known: dict[str, int]) -> np.ndarray:
    """Distinct hashed words (and runs of signs) of the lower-cased text."""
    words = _WORDS.findall(text.lower())
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return np.unique(hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Link:
    """One linear model: hashed features, the logits of earlier categories, and a bias."""

    def __init__(self, earlier: int):
        self.w = np.zeros(2**BITS)
        self.v = np.zeros(earlier + 1)

    def score(self, rows: Sequence[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        sums = np.array([self.w[r].sum() for r in rows])
        z = sums + earlier @ self.v[:-1] + self.v[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def train(self, rows: Sequence[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> Link:
        if len(set(y.tolist())) < 2:
            self.v[-1] = _logit(np.array([y.mean() if len(y) else 0.0]))[0]
            return self
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        z, n = np.zeros(2**BITS), np.zeros(2**BITS)
        gv = np.full(len(self.v), 1e-6)

        def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
            shrunk = np.sign(zi) * np.maximum(np.abs(zi) - L1, 0)
            return -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2)

        generator = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for i in generator.permutation(len(rows)):
                r, x = rows[i], np.r_[earlier[i], 1.0]
                zi, ni = z[r], n[r]
                w = weights(zi, ni)
                score = np.clip(w.sum() + x @ self.v, -30, 30)
                g = weight[i] * (1 / (1 + np.exp(-score)) - y[i])
                more = ni + g * g
                z[r] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
                n[r] = more
                gv += (g * x) ** 2
                self.v -= 0.1 * g * x / np.sqrt(gv)
        self.w = weights(z, n)
        return self


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Link]:
    """A link per column of ``labels``; ``folds`` numbers the fold of every row."""
    chain: list[Link] = []
    earlier = np.zeros((len(rows), 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        chain.append(Link(c).train(rows, earlier, y))
        if c + 1 < labels.shape[1]:
            out = np.zeros(len(rows))
            for f in range(FOLDS):
                inside, outside = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
                link = Link(c).train([rows[i] for i in inside], earlier[inside], y[inside])
                out[outside] = link.score([rows[i] for i in outside], earlier[outside])
            earlier = np.c_[earlier, _logit(out)]
    return chain


def score_chain(chain: list[Link], rows: Sequence[np.ndarray]) -> np.ndarray:
    """Probabilities (row, category)."""
    earlier, out = np.zeros((len(rows), 0)), []
    for link in chain:
        out.append(link.score(rows, earlier))
        earlier = np.c_[earlier, _logit(out[-1])]
    return np.stack(out, axis=1) if out else np.zeros((len(rows), 0))


def _train(n_labels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = _Known(), []
        for batch, texts in text_batches(batches):
            order = batch.column(0).to_pylist()
            labels = zip(*(batch.column(2 + c).to_pylist() for c in range(n_labels)), strict=True)
            rows += [
                (o, x, features(t.decode(), known))
                for o, x, t in zip(order, labels, texts, strict=True)
            ]
        if rows:
            rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
            folds = np.array([r[0] for r in rows]) % FOLDS
            chain = fit_chain([r[2] for r in rows], np.array([r[1] for r in rows]), folds)
            data = io.BytesIO()
            np.savez_compressed(
                data,
                **{f"w{k}": link.w.astype(np.float32) for k, link in enumerate(chain)},
                **{f"v{k}": link.v for k, link in enumerate(chain)},
            )
            yield pa.RecordBatch.from_arrays([pa.array([data.getvalue()], pa.binary())], names=["model"])

    return run


def fit(
    labelled: DataFrame, labels: Sequence[str], text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> bytes | None:
    """The chain, in the order of ``labels`` (0/1 columns), of at most ``sample_rows`` rows."""
    rows = labelled.dropna(subset=list(labels)).select(
        F.pmod(F.xxhash64(text), F.lit(2**30)).alias("order"),
        F.col(text).cast("string").alias("text"),
        *[F.col(c).cast("int").alias(f"y{k}") for k, c in enumerate(labels)],
    )
    share = min(1.0, sample_rows / max(1, rows.count()))
    chosen = rows.filter(F.col("order") < int(share * 2**30)).limit(sample_rows)
    schema = "model binary"
    models = chosen.coalesce(1).mapInArrow(_train(len(labels)), schema).collect()
    return models[0]["model"] if models else None


def _chain(model: bytes) -> list[Link]:
    with np.load(io.BytesIO(model)) as data:
        chain = []
        for k in range(len(data.files) // 2):
            link = Link(k)
            link.w, link.v = data[f"w{k}"].astype(np.float64), data[f"v{k}"]
            chain.append(link)
    return chain


def scorer(model: bytes | None, n_labels: int):
    """A column function of texts: an array with the probability of each category in order."""

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chain = _chain(model) if model else None
        known = _Known()
        for texts in batches:
            if chain is None:
                yield pd.Series([[0.0] * n_labels] * len(texts))
                continue
            out = []
            for start in range(0, len(texts), 500):
                rows = [
                    features(t if isinstance(t, str) else "", known)
                    for t in texts.iloc[start : start + 500]
                ]
                out += score_chain(chain, rows).tolist()
            yield pd.Series(out)

    return score


def toxic_documents(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str] = ("low_quality", "toxic"),
    least: float = 0.5,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: id, the probability of every category (``p_<category>``), and
    ``is_toxic``: whether the last category's is at least ``least``.

    ``labels`` has the id and a 0/1 column per category, in the order of the chain.
    """
    narrow = docs.select(F.col(id_column), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(id_column).alias("__id"), *categories)
    joined = narrow.join(known, F.col(id_column) == F.col("__id")).drop("__id")
    model = fit(joined, categories, "text")
    p: Column = F.col("__p")
    scored = narrow.withColumn("__p", scorer(model, len(categories))(F.col("text")))
    return scored.select(
        id_column,
        *[p[k].alias(f"p_{c}") for k, c in enumerate(categories)],
        (p[len(categories) - 1] >= least).alias("is_toxic"),
    )
