"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; the model of each sees the
probabilities of those before it.  In training these are out-of-fold, so a
later model meets the same kind of input as in scoring.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.tables import packed, sliced, small_batches, stored, unpacked
from chatlens.llm.words import span_hashes, text_buffers, word_spans

#: Labelled ids that a model is fitted on at most, one row each, chosen by a hash of the id.
SAMPLE = 8000
#: Words kept for each category, and the least sampled rows that hold one.
VOCABULARY, LEAST_ROWS = 128, 3
FOLDS = 5

#: Bytes that part the words here: all ASCII but letters and digits.
_GAPS = np.zeros(256, bool)
_GAPS[:128] = [not chr(i).isalnum() for i in range(128)]


def _words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, word hash) pairs and five measures of each row's writing."""
    raw, at = text_buffers(column)
    n = len(at) - 1
    start, end, row = word_spans(raw, at, _GAPS)
    h = span_hashes(raw, start, end)
    order = np.lexsort((h, row))
    row_o, h_o = row[order], h[order]
    first = np.r_[True, (row_o[1:] != row_o[:-1]) | (h_o[1:] != h_o[:-1])] if len(h) else np.zeros(0, bool)
    kinds = np.zeros((256, 3))
    kinds[65:91, 0] = kinds[48:58, 1] = 1
    kinds[:128, 2] = [chr(i).isprintable() and not chr(i).isalnum() and i != 32 for i in range(128)]
    size = np.maximum(np.diff(at), 1)
    words = np.bincount(row, minlength=n)
    shares = [np.diff(np.r_[0, np.cumsum(kinds[raw, k])][at]) / size for k in range(3)]
    distinct = np.bincount(row_o[first], minlength=n) / np.maximum(words, 1)
    return row_o[first], h_o[first], np.column_stack([*shares, distinct, np.log1p(words) / 10])


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 400) -> np.ndarray:
    """Logistic regression with an intercept (last weight), by accelerated gradient steps."""
    x = np.column_stack([x, np.ones(len(x))])  # in double precision, cast once
    w = look = np.zeros(x.shape[1])
    v = np.random.RandomState(0).rand(x.shape[1])
    for _ in range(20):  # largest eigenvalue, for the step
        v = x.T @ (x @ v)
        norm = np.linalg.norm(v)
        v = v / max(norm, 1e-12)
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 0
    rate = 1 / (norm / 4 + ridge)
    for k in range(steps):
        p = 1 / (1 + np.exp(-(x @ look)))
        new = look - rate * (x.T @ (p - y) + pull * look)
        look = new + k / (k + 3) * (new - w)
        w = new
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the widest stretch of scores with the best F1 on out-of-fold scores."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    ends = np.r_[p[order][1:] < p[order][:-1], True]
    k = int(np.argmax(np.where(ends, f1, -1)))
    low = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + low) / 2)


@dataclass
class Chain:
    """A fitted chain: word hashes, then per category the weights and the threshold."""

    names: list[str]
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def features(self, column) -> np.ndarray:
        row, h, measures = _words(column)
        x = np.zeros((len(measures), len(self.vocabulary)))
        if len(self.vocabulary) and len(h):
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == h
            x[row[hit], at[hit]] = 1
        return np.column_stack([x, measures])

    def predict(self, column) -> np.ndarray:
        """Probability of every category for every text."""
        x = self.features(column)
        out = np.zeros((len(x), len(self.names)))
        for k, w in enumerate(self.weights):
            out[:, k] = probability(x, w)
            x = np.column_stack([x, out[:, k]])
        return out


def fit_chain(docs: DataFrame, labels: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text",
              sample: int = SAMPLE, vocabulary: int = VOCABULARY, folds: int = FOLDS) -> Chain:
    """Fit on at most ``sample`` labelled ids, one row each; ``labels`` has the id and one 0/1 column per name, in chain order.

    Candidate words are counted by Spark; the driver gets the best words and the
    sampled rows' flags for them, both bounded by the parameters.

    Defined results: a category with one class only gets probability 0 (or 1)
    for all; rows with a null label, id or without a text are not learnt from;
    an id counts once, however many rows it has, with its greatest labels and
    its least text; ids are integers; without labelled rows every probability is 0.
    """
    small_batches(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("__id"), *[F.col(c).cast("int").alias(f"__y{k}") for k, c in enumerate(names)]).dropna()
    chosen = marks.groupBy("__id").agg(*[F.max(f"__y{k}").alias(f"__y{k}") for k in range(len(names))])
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null")
    once = text.join(F.broadcast(chosen), "__id").groupBy("__id", *[f"__y{k}" for k in range(len(names))]).agg(F.min("__text").alias("__text"))
    rows = stored(once, "labelled")  # the bounded sample

    b_text = 1 + len(names)

    def count(batches):
        for b in sliced(batches, b_text):
            row, h, _ = _words(b.column(b.num_columns - 1))
            one, back = np.unique(h, return_inverse=True)
            cols = [pa.array(one.view(np.int64)), pa.array(np.bincount(back, minlength=len(one)).astype(np.int64))]
            cols += [pa.array(np.bincount(back, weights=b.column(1 + k).to_numpy()[row], minlength=len(one)).astype(np.int64)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "n", *[f"p{k}" for k in range(len(names))]])

    counted = rows.mapInArrow(count, "h long, n long, " + ", ".join(f"p{k} long" for k in range(len(names))))
    counted = stored(counted.groupBy("h").agg(F.sum("n").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(len(names))]).where(f"n >= {LEAST_ROWS}"), "words")
    total = rows.agg(F.count("*").alias("n"), *[F.sum(f"__y{k}").alias(f"p{k}") for k in range(len(names))]).first()
    best: set[int] = set()
    for k in range(len(names)):
        n, p = total["n"] or 0, total[f"p{k}"] or 0
        if not 0 < p < n:
            continue
        lift = F.expr(f"pow(p{k} - n * {p / n!r}D, 2) / (n * {p / n * (1 - p / n)!r}D * (1 - n / {n + 1}D))")
        best |= {r["h"] for r in counted.orderBy(lift.desc(), "h").limit(vocabulary).collect()}
    chain = Chain(list(names), np.sort(np.array(sorted(best), np.int64).view(np.uint64)))

    def flags(batches):
        for b in sliced(batches, b_text):
            x = chain.features(b.column(b.num_columns - 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[b.column(1 + k) for k in range(len(names))],
                                              packed(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], names=["id", *[f"y{k}" for k in range(len(names))], "x"])

    got = rows.mapInArrow(flags, "id long, " + ", ".join(f"y{k} int" for k in range(len(names))) + ", x binary").toArrow()
    width = len(chain.vocabulary) + 5
    x = unpacked(got["x"], np.float32)[0].reshape(-1, width)
    ids = got["id"].to_numpy()
    order = np.lexsort((x.sum(axis=1), ids))
    x, ids = x[order], ids[order]
    fold = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % folds
    for k in range(len(names)):
        y = got[f"y{k}"].to_numpy()[order].astype(np.float64)
        if not 0 < y.sum() < len(y):
            chain.weights.append(np.r_[np.zeros(x.shape[1]), 50.0 if len(y) and y.all() else -50.0])
            chain.thresholds.append(0.5)
            x = np.column_stack([x, np.full(len(x), float(len(y) > 0 and y.all()))])
            continue
        apart = np.zeros(len(y))
        for f in range(folds):
            held = fold == f
            apart[held] = probability(x[held], fit_linear(x[~held], y[~held]))
        chain.weights.append(fit_linear(x, y))
        chain.thresholds.append(best_threshold(apart, y))
        x = np.column_stack([x, apart])
    return chain


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, p_<name>, ..., <last name>)`` for every row, in one pass and no shuffle.

    The last category of the chain is what a text is judged by: the column of
    its name says whether the probability is over the model's threshold.

    Defined results: a null text is scored as an empty one; repeated rows get
    equal scores; null ids stay null; an empty table gives no rows; other
    columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in sliced(batches, 1):
            p = chain.predict(b.column(1))
            cols, names = [b.column(0)], ["doc_id"]
            for k, name in enumerate(chain.names):
                cols.append(pa.array(p[:, k]))
                names.append(f"p_{name}")
            cols.append(pa.array(p[:, -1] > chain.thresholds[-1]))
            names.append(chain.names[-1])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"p_{n} double" for n in chain.names) + f", {chain.names[-1]} boolean")


def without(docs: DataFrame, chain: Chain, name: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that the chain does not put in category ``name``; no shuffle.

    Defined results: a null text is scored as an empty one; repeated rows stay
    or go together; rows with a null id are judged like any other; an empty
    table gives no rows; columns of any name pass through.
    """
    small_batches(docs.sparkSession)
    at, k = docs.columns.index(text_col), chain.names.index(name)

    def run(batches):
        for b in sliced(batches, at):
            yield b.filter(pa.array(chain.predict(b.column(at))[:, k] <= chain.thresholds[k]))

    return docs.mapInArrow(run, docs.schema)
