"""Toxicity by bags of subword vectors, averaged into a linear softmax.

A word is the bag of itself and its character n-grams, with its borders as characters; its vector is the mean of their vectors (rows of a
hashed table), so a misspelling that was never seen shares most of them. A window of ``WINDOW`` words is the mean of its words, each counted
once and with zero vectors in the places left, and goes through a softmax over two classes; a text is as toxic as the worst of its windows, which
overlap by half, so a few words aren't lost in a long text and one word's repetition says nothing. Vectors and
softmax are trained jointly in numpy: first on any window of a text, then on its worst.

Since the softmax's input is a mean, the score of a text is a sum of one number for each subword: that table (2 ** ``BITS`` numbers) is what goes to
the tasks that score. Fitting takes a bounded sample of labelled rows (``positives``, ``negatives``, one row of an id, at most ``windows``
evenly spaced windows of each), chosen by a hash of the id; scoring is a narrow map over all rows and whole texts.

Defined results: null text is empty; a text without words has the score of the zero vector, the softmax of the bias alone. Without labelled rows of
both classes every score is 0.5. Repeated rows get equal scores. An id with several labels counts as toxic if one says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, BITS, DIM = 16, 17, 16
GRAMS = (3, 4, 5)
#: Characters of a text that are looked at together; words longer than that are cut.
PIECE = 1 << 16
PRIME, INVERSE = 1099511628211, pow(1099511628211, -1, 1 << 64)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Signs that belong to a word only between two letters or digits.
JOINERS = "!#$%&'*+-=@^_`~"
ASCII = np.array([chr(i).isalnum() for i in range(128)])
JOINS = np.array([chr(i) in JOINERS for i in range(128)])


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


POWER, BACK = _powers(PIECE + 8, PRIME), _powers(PIECE + 8, INVERSE)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    h = (h + np.uint64(n)) * MIX
    return ((h ^ (h >> np.uint64(29))) * MIX >> np.uint64(64 - BITS)).astype(np.int32)


def _codes(piece: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points with a space at both ends and in place of what belongs to no word, and where words are."""
    codes = np.frombuffer(f" {piece} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    low = np.minimum(codes, 127)
    plain = ASCII[low] | (codes > 127)
    inside = plain.copy()
    inside[1:-1] |= JOINS[low[1:-1]] & (codes[1:-1] < 128) & plain[:-2] & plain[2:]
    codes[~inside] = 32
    return codes, inside


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case."""
    return [w for piece in pieces(text) for w in _codes(piece)[0].astype(np.uint32).tobytes().decode("utf-32-le").split(" ") if w]


def subwords(piece: str) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(rows of the table, word of each, number of words, hash of each word) of at most PIECE characters. n-grams take a word's borders in
    as spaces."""
    codes, inside = _codes(piece)
    if not inside.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int64), 0, np.zeros(0, np.uint64)
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    word = np.cumsum(np.concatenate([[False], inside[1:] & ~inside[:-1]])) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * POWER[: len(codes)], dtype=np.uint64)])
    own = (sums[ends] - sums[begins]) * BACK[begins]
    ids, words = [_bucket(own, 0)], [np.arange(len(begins))]
    for n in GRAMS:
        if len(codes) < n:
            break
        size = len(codes) - n + 1
        whole = inside[1 : 1 + size].copy()
        for k in range(2, n - 1):
            whole &= inside[k : k + size]
        at = np.flatnonzero(whole)
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h += codes[at + k] * POWER[k]
        ids.append(_bucket(h, n))
        words.append(word[at + 1])
    return np.concatenate(ids), np.concatenate(words), len(begins), own


def pieces(text: str) -> Iterator[str]:
    """A text in lower case, cut between words."""
    text, at = text.lower(), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


def word_scores(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of a table's numbers over each word's subwords, and a hash of each word."""
    scores, hashes = [np.zeros(0)], [np.zeros(0, np.uint64)]
    for piece in pieces(text):
        ids, words, n, own = subwords(piece)
        scores.append(np.bincount(words, table[ids], n) / np.maximum(np.bincount(words, minlength=n), 1))
        hashes.append(own)
    return np.concatenate(scores), np.concatenate(hashes)


def worst(scores: np.ndarray, hashes: np.ndarray) -> float:
    """The largest of a text's windows: each word once, the sum over WINDOW. Windows overlap by half; 0 without words."""
    n, half = len(scores), WINDOW // 2
    if not n:
        return 0.0
    halves = max(2, -(-n // half))
    padded, told = np.zeros(halves * half), np.zeros(halves * half, np.uint64)
    padded[:n], told[:n] = scores, hashes
    at = np.arange(halves - 1)[:, None] * half + np.arange(WINDOW)
    order = np.argsort(told[at], axis=1)
    seen, value = np.take_along_axis(told[at], order, 1), np.take_along_axis(padded[at], order, 1)
    value[:, 1:][seen[:, 1:] == seen[:, :-1]] = 0
    return float(value.sum(1).max() / WINDOW)


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def table(self) -> tuple[np.ndarray, float]:
        """What each subword adds to the log-odds of the second class, and the bias."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0])


@dataclass
class Bags:
    """Words of all windows, each once: subwords of word w are ids[starts[w]:starts[w + 1]]; tokens are words; windows and texts are cut by their firsts."""

    ids: np.ndarray
    starts: np.ndarray
    tokens: np.ndarray
    windows: np.ndarray
    texts: np.ndarray


def bags(texts: list[list[str]]) -> Bags:
    """Of texts as lists of windows, each of at least one word."""
    known: dict[str, int] = {}
    tokens, windows, firsts = [], [0], [0]
    for parts in texts:
        for part in parts:
            tokens += sorted({known.setdefault(w, len(known)) for w in part.split(" ")})
            windows.append(len(tokens))
        firsts.append(len(windows) - 1)
    ids, counts = [], []
    for piece in pieces(" ".join(known)):
        found, words, n, _ = subwords(piece)
        ids.append(found[np.argsort(words, kind="stable")])
        counts.append(np.bincount(words, minlength=n))
    starts = np.concatenate([[0], *counts]).cumsum() if counts else np.zeros(1, np.int64)
    return Bags(np.concatenate(ids) if ids else np.zeros(0, np.int32), starts, np.array(tokens, np.int64), np.array(windows), np.array(firsts))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _texts_with(data: Bags) -> np.ndarray:
    """In how many texts each row of the table occurs."""
    found = np.zeros(1 << BITS, np.int64)
    for first, last in zip(data.windows[data.texts[:-1]], data.windows[data.texts[1:]], strict=True):
        words = np.unique(data.tokens[first:last])
        found[np.unique(data.ids[_ranges(data.starts[words], data.starts[words + 1] - data.starts[words])])] += 1
    return found


def step(model: Model, ids: np.ndarray, shares: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(loss, rows of the table that are used, their gradient, the softmax's two) of texts whose mean is sum(shares * vectors[ids]), by row."""
    used, at = np.unique(ids, return_inverse=True)
    mean = np.zeros((len(labels), model.vectors.shape[1]))
    taken = model.vectors[used][at] * shares[:, None]
    for d in range(mean.shape[1]):
        mean[:, d] = np.bincount(rows, taken[:, d], len(labels))
    z = mean @ model.weights + model.bias
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()
    p[np.arange(len(labels)), labels] -= 1
    p /= len(labels)
    back = (p @ model.weights.T)[rows] * shares[:, None]
    g = np.stack([np.bincount(at, back[:, d], len(used)) for d in range(mean.shape[1])], axis=1)
    return loss, used, g, mean.T @ p, p.sum(0)


def fit(data: Bags, labels: np.ndarray, some: int = 600, worst: int = 1800, batch: int = 64, rate: float = 2.0, least: int = 5, seed: int = 17) -> Model:
    """Adagrad over a window of each text, any window for ``some`` steps, then the worst so far. Rows of the table have a rate of their own;
    those that fewer than ``least`` texts use stay zero, so that chance says nothing."""
    r = np.random.default_rng(seed)
    model = Model(r.uniform(-1, 1, (1 << BITS, DIM)) / DIM, r.normal(0, 0.1, (DIM, 2)), np.zeros(2))
    squares, w_squares, b_squares = np.full(1 << BITS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    texts = len(data.texts) - 1
    rare = _texts_with(data) < least
    model.vectors[rare] = 0
    sizes = np.diff(data.starts)
    steps = 0
    while steps < some + worst:
        best = r.integers(data.texts[:-1], data.texts[1:])
        if steps >= some:
            table, _ = model.table()
            of_word = np.add.reduceat(table[data.ids], data.starts[:-1]) / sizes
            of_window = np.add.reduceat(of_word[data.tokens], data.windows[:-1])
            best = np.array([a + int(of_window[a:b].argmax()) for a, b in zip(data.texts[:-1], data.texts[1:], strict=True)])
        first, last = data.windows[best], data.windows[best + 1]
        order = r.permutation(texts)
        for at in range(0, texts, batch):
            chosen, steps = order[at : at + batch], steps + 1
            lengths = last[chosen] - first[chosen]
            tokens = data.tokens[_ranges(first[chosen], lengths)]
            n = sizes[tokens]
            ids = data.ids[_ranges(data.starts[tokens], n)]
            rows = np.repeat(np.arange(len(chosen)), lengths)
            shares = np.repeat(1 / (WINDOW * n), n)
            _, used, g, gw, gb = step(model, ids, shares, np.repeat(rows, n), labels[chosen])
            g[rare[used]] = 0
            squares[used] += (g * g).sum(1)
            model.vectors[used] -= rate * g / np.sqrt(squares[used])[:, None]
            w_squares += gw * gw
            b_squares += gb * gb
            model.weights -= rate / 3 * gw / np.sqrt(w_squares)
            model.bias -= rate / 3 * gb / np.sqrt(b_squares)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def cut(text: str, most: int) -> list[str]:
    """At most so many windows of a text's words, evenly spaced, none of them empty."""
    words = words_of(text)
    every = range(0, len(words), WINDOW)
    chosen = every if len(every) <= most else [every[int(i)] for i in np.linspace(0, len(every) - 1, most)]
    return [" ".join(words[a : a + WINDOW]) for a in chosen]


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, negatives: int = 8000, windows: int = 32, **fitting) -> Model | None:
    """A model from labelled rows that aren't held out; of either class at most so many ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [cut(t.decode("utf-8", "replace"), windows) for (t,) in common.rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(parts, pa.list_(pa.string()))], ["doc_id", "toxic", "parts"])

    free = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    told = free.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    mixed = F.xxhash64(F.lit(23), "doc_id")
    some = [told.where(F.col("toxic") == c).orderBy(mixed, "doc_id").limit(n) for c, n in ((1, positives), (0, negatives))]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes())
    rows = texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").mapInArrow(run, "doc_id long, toxic int, parts array<string>")  # ids are bounded above
    found = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("parts").alias("parts")).orderBy("doc_id").collect()
    found = [r for r in found if r.parts]
    classes = np.array([r.toxic for r in found], np.int64)
    return fit(bags([r.parts for r in found]), classes, **fitting) if len(set(classes)) == 2 else None


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with a column of this name, 0 to 1, higher where toxic 1 is likelier; it takes the place of one that docs has."""
    own = [c for c in docs.columns if c != name]
    row, text = "_row", "_text"
    table, bias = model.table() if model else (np.zeros(1 << BITS), 0.0)
    table = table.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([worst(*word_scores(t.decode("utf-8", "replace"), table)) + bias for (t,) in common.rows_of(batch, text)])
            yield pa.RecordBatch.from_arrays([batch.column(row), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], [row, "_found"])
        common.tidy()

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias(row), common.text_bytes().alias(text))
    scored = packed.mapInArrow(run, f"{row} {packed.schema[row].dataType.simpleString()}, _found double")
    return scored.select(*(F.col(f"{row}.`{c}`") for c in own), F.col("_found").alias(name))
