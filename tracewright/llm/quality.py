"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model on statistics of the text by the
non-negative unbiased risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). Where the second
part would turn negative, the step goes against its gradient, as published. The class prior is not read off the
labels: a first model tells positives from unlabelled text, and the prior is the least ratio
of unlabelled to positive rows above any of its scores, with a correction for small counts.

Fitting takes bounded samples (``positives``, ``unlabelled``), chosen by a hash of the id; scoring
is a narrow map over all rows.

Defined results: null text is an empty text and is scored like any other. With no positive in the
sample every score is the prior 0.5. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

NAMES = ("words", "mean_length", "distinct", "top_word", "pairs", "upper", "digits", "exclaims", "bars", "symbols", "points", "high_bytes", "lines", "distinct_lines", "capital_words", "longest")
SYMBOLS = np.array([chr(i) in "#$%&*+<=>@^_`{}~\\" for i in range(256)])


def features(text: bytes) -> list[float]:
    """Statistics of the whole text, each of a bounded size."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum()))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        len(counts) / n * np.log1p(n),
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        seen[65:91].sum() / letters,
        seen[48:58].sum() / size,
        seen[33] / size,
        seen[124] / size,
        seen[SYMBOLS].sum() / size,
        (seen[46] + seen[44]) / n,
        seen[128:].sum() / size,
        float(np.log1p(len(lines))),
        len(set(lines)) / max(1, len(lines)),
        sum(map(bytes.isupper, words)) / n,
        float(np.log1p(max(map(len, words), default=0))),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        i, j = np.triu_indices(z.shape[1])
        return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j] / 4], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -40, 40)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w, t)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of unlabelled to positive tails of a score, which no prior can exceed."""
    best = 1.0
    for share in np.linspace(0.1, 1.0, 91):
        at = np.quantile(positive, 1 - share)
        p, u = (positive >= at).mean(), (unlabelled >= at).mean()
        slack = np.sqrt(u * (1 - u) / len(unlabelled)) + u / p * np.sqrt(p * (1 - p) / len(positive))
        best = min(best, (u + slack) / p)
    return float(np.clip(best, 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, decay: float | None = None, rate: float = 0.05) -> Model:
    """The model for rows of features() of trusted positives and of unlabelled text."""
    decay = 3 / len(positive) if decay is None else decay  # few positives say little
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    model = Model(mean, scale, np.zeros(0), 0.5)
    p, u = model.design(positive), model.design(unlabelled)

    def apart(w, _):
        a, b = _sigmoid(p @ w) - 1, _sigmoid(u @ w)
        return p.T @ a / len(p) + u.T @ b / len(u) + decay * w

    first = _descend(apart, p.shape[1], steps // 2, rate)
    # a smaller pull at the prior keeps it honest: its bound is only tight far from the negatives
    prior = estimate_prior(p @ first, u @ first)

    def risk(w, _):
        at_p, at_u = p @ w, u @ w
        negative = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        as_negative = u.T @ _sigmoid(at_u) / len(u) - prior * (p.T @ _sigmoid(at_p)) / len(p)
        if negative < 0:
            return -as_negative
        return prior * (p.T @ (_sigmoid(at_p) - 1)) / len(p) + as_negative + decay * w

    model.weights, model.prior = _descend(risk, p.shape[1], steps, rate), prior
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features_of(docs: DataFrame) -> np.ndarray:
    """One row of features() for each doc_id: of its rows the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for (t,) in common.rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes()).mapInArrow(run, "doc_id long, x array<double>")
    return np.array([r.x for r in rows.groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").collect()]).reshape(-1, len(NAMES))


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> Model | None:
    """A model from rows that are not held out; of at most so many ids of either kind, one row each."""
    mixed = F.xxhash64(F.lit(11), "doc_id")
    free = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    good = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    good = good.orderBy(mixed, "doc_id").limit(positives)
    some = free.select("doc_id").distinct().orderBy(mixed, "doc_id").limit(unlabelled)
    p = _features_of(free.join(F.broadcast(good), "doc_id", "left_semi"))  # both id lists are bounded above
    u = _features_of(free.join(F.broadcast(some), "doc_id", "left_semi"))
    return fit(p, u) if len(p) and len(u) else None


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with a column of this name, 0 to 1, higher where quality 1 is likelier; it takes the place of one that docs has."""
    own = [c for c in docs.columns if c != name]
    row, text = "_row", "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for (t,) in common.rows_of(batch, text)]).reshape(-1, len(NAMES))
            found = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(row), pa.array(found)], [row, "_found"])
        common.tidy()

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias(row), common.text_bytes().alias(text))
    scored = packed.mapInArrow(run, f"{row} {packed.schema[row].dataType.simpleString()}, _found double")
    return scored.select(*(F.col(f"{row}.`{c}`") for c in own), F.col("_found").alias(name))
