"""A gated recurrent language model with a class-factored output softmax.

log P(text) = sum over tokens of log P(class | state) + log P(word | class, state). Words in order of
frequency are cut into classes: the first are classes of their own, then classes grow with the rank. A gated
recurrent network reads a document's tokens (frequent words as themselves, others as their classes); its state feeds
two softmaxes, one over classes and one over the words of the class. In the classes after rank ``modelled``
and in the tail class a word's share is that of its count in the whole training corpus.

1. Counts: each task counts the words it reads; the sums per word are shuffled and written.
   What is gathered so grows with the corpus's vocabulary.
2. Head: the words above a count such that at most ``head`` of them are left; that bound makes
   it safe to broadcast. The rest stays a table.
3. Each document's head places are written once; training and scoring read those, not the texts.
4. Training: truncated backpropagation through time in numpy. Each round takes some of the 16 hash parts of the
   training documents, the first few; together the rounds take all, once each. Every task trains on the documents
   that it holds of the parts, starting from common weights; their average by tokens starts the next round.
5. Scoring: each task packs its documents into lanes and runs them through in windows, carrying the state
   from window to window, reset where a document begins. Texts count whole, whatever their length.
   Tail words meet their counts in a join.

Defined results: null text is an empty text: the end token alone. Rows that repeat a doc_id with one
text are scored alike, up to rounding. Where nothing is in training, each word is unknown. Empty tables give empty results;
further columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

END = b"\n"  # no word holds it
#: Steps and lanes of a window.
STEPS, LANES = 32, 512
#: Tokens that a task holds at once; one longer document is held whole.
HELD = 6_000_000
#: Hash parts that each training round takes, of 16.
ROUNDS = ((0, 1), (1, 4), (4, 16))
#: Tokens that training carries the state over.
PIECE = 512


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, lower-cased; how many each text has. texts: binary, without nulls."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words = pc.list_flatten(lists).cast(pa.binary())
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(words), 0)
    if not pc.all(real).as_py():  # what leads or trails
        words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    return words, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def word_counts(docs: DataFrame, keep: int = 1_000_000) -> DataFrame:
    """word, c over docs(text), the ends of texts included; a task holds at most about ``keep`` counts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]).combine_chunks()

        for batch in batches:
            for at in range(0, len(batch), 4096):
                texts = batch.column("text").slice(at, 4096)
                found = pc.value_counts(words_of(texts)[0])
                parts.append(pa.table({"word": found.field(0), "c": found.field(1)}))
                parts.append(pa.table({"word": pa.array([END], pa.binary()), "c": pa.array([len(texts)], pa.int64())}))
                rows += len(found) + 1
                if rows > keep:
                    whole = merged()
                    parts, rows = [whole], len(whole)
                    if 2 * rows > keep:
                        yield from whole.to_batches()
                        parts, rows = [], 0
        if parts:
            yield from merged().to_batches()

    return docs.select(common.text_bytes()).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Head words by falling count. Class k is the ranks first[k] to first[k + 1]; the last class is the tail's."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    first: np.ndarray
    modelled: int  # classes whose words the network tells apart
    inputs: int  # words that are inputs as themselves; with the classes fewer than 2^15

    def __post_init__(self):
        n = len(self.words)
        self.classes = len(self.first)
        self.tail = self.classes - 1
        self.ends = np.append(self.first[1:], n)
        self.class_of = np.append(np.repeat(np.arange(self.classes), self.ends - self.first), self.tail).astype(np.int32)  # -1: the tail
        mass = np.append(np.add.reduceat(np.append(self.counts + 0.1, 0.0), self.first[:-1]), 0.0) if n else np.zeros(1)
        mass[self.tail] = self.total - self.counts.sum() + 0.1 * (self.distinct - n + 1)
        self.class_mass = np.maximum(mass, 0.1)
        self.base = np.append(np.log10((self.counts + 0.1) / (self.total + 0.1 * (self.distinct + 1))), 0.0)
        self.inside = np.append(np.log((self.counts + 0.1) / self.class_mass[self.class_of[:-1]]), 0.0)
        self.known = int(self.first[self.modelled])  # words that the network tells apart
        self.start = self.inputs + self.classes  # the input at a document's begin
        self.input_of = np.concatenate([np.arange(self.inputs), self.inputs + self.class_of[self.inputs :]]).astype(np.int32)


def cut_classes(counts: np.ndarray, modelled: int, widest: int = 256, bands: int = 4) -> tuple[np.ndarray, int]:
    """Where classes begin, the tail's included, and how many of them lie before rank ``modelled``."""
    n, first, at = len(counts), [], 0
    while at < min(n, modelled):
        first.append(at)
        at += max(1, min(widest, at // 4 if at >= 16 else 1))
    known, at = len(first), min(at, n)
    rest = np.cumsum(counts[at:])
    for k in range(bands if n > at else 0):  # of equal mass
        to = at + int(np.searchsorted(rest, rest[-1] * k / bands, "right")) if k else at
        if not first or to > first[-1] and to < n:
            first.append(to)
    return np.array([*first, n], np.int64), known


class Network:
    """Gated recurrent unit of size H, a softmax over classes and one over the words of each class."""

    NAMES = ("rec", "cand", "bias", "out", "out_bias", "emb", "words", "words_bias")
    SPARSE = ("emb", "words", "words_bias")  # few of whose rows a window touches

    def __init__(self, known: Vocabulary, hidden: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.vocabulary, self.hidden = known, hidden
        self.emb = (r.standard_normal((known.start + 1, 3 * hidden)) * 0.3).astype(np.float32)
        self.rec = (r.standard_normal((hidden, 2 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.cand = (r.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.bias = np.zeros(3 * hidden, np.float32)
        self.bias[:hidden] = 1  # keep at first
        self.out = np.zeros((hidden, known.classes), np.float32)
        self.out_bias = np.log(known.class_mass / known.class_mass.sum()).astype(np.float32)
        self.words = np.zeros((known.known, hidden), np.float32)
        self.words_bias = known.inside[: known.known].astype(np.float32)

    def get(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def run(self, inputs: np.ndarray, keep: np.ndarray, h: np.ndarray, held: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each of T steps of B lanes, and the last; keep: 0 where a document begins. held: gets what backward() needs."""
        n = self.hidden
        drive = self.emb[inputs]
        drive += self.bias
        states = np.empty((*inputs.shape, n), np.float32)
        for t in range(len(inputs)):
            before = h * keep[t]
            gates = before @ self.rec
            gates += drive[t, :, : 2 * n]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :n], gates[:, n:]
            c = (r * before) @ self.cand
            c += drive[t, :, 2 * n :]
            np.tanh(c, out=c)
            h = before - c
            h *= z
            h += c
            states[t] = h
            if held is not None:
                held.append((before, z, r, c))
        return states, h

    def groups(self, wanted: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, end, positions) of the classes of several words that the network tells apart. wanted: word or -1."""
        v = self.vocabulary
        of = v.class_of[wanted].astype(np.int16)  # short numbers sort by radix
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(v.modelled + 1))
        for k in range(v.modelled):
            if edges[k] < edges[k + 1] and v.ends[k] - v.first[k] > 1:
                yield int(v.first[k]), int(v.ends[k]), order[edges[k] : edges[k + 1]]

    def log_probability(self, states: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural log of P(class | state) P(word | class, state) of each wanted word; for -1 that of the tail class."""
        v = self.vocabulary
        logits = states @ self.out
        logits += self.out_bias
        out = _softmax(logits, v.class_of[wanted])[1]
        far = (wanted >= v.known) | (wanted < 0)
        out[far] += v.inside[wanted[far]]
        for a, b, at in self.groups(wanted):
            inner = states[at] @ self.words[a:b].T
            inner += self.words_bias[a:b]
            out[at] += _softmax(inner, wanted[at] - a)[1]
        return out

    def gradient(self, inputs, keep, wanted, weight, h):
        """(loss, gradients, last state) over one window; backpropagation stops at its first step. Gradients of SPARSE
        are (rows, values). weight: 1 for a token, 0 where a lane has ended."""
        n, v, held = self.hidden, self.vocabulary, []
        states, last = self.run(inputs, keep, h, held)
        flat, want, w = states.reshape(-1, n), wanted.ravel(), weight.ravel()
        scale = np.float32(1 / max(1.0, float(w.sum())))
        d = flat @ self.out
        d += self.out_bias
        of, every = v.class_of[want], np.arange(len(want))
        total, told = _softmax(d, of)
        loss = -float((told * w).sum())
        d *= (w * scale / total)[:, None]
        d[every, of] -= w * scale
        g = {"out": flat.T @ d, "out_bias": d.sum(0)}
        d_flat = d @ self.out.T
        rows, values, biases = [], [], []
        for a, b, at in self.groups(want):
            near, weights = flat[at], w[at]
            d = near @ self.words[a:b].T
            d += self.words_bias[a:b]
            here, own = np.arange(len(at)), want[at] - a
            total, told = _softmax(d, own)
            loss -= float((told * weights).sum())
            d *= (weights * scale / total)[:, None]
            d[here, own] -= weights * scale
            rows.append(np.arange(a, b))
            values.append(d.T @ near)
            biases.append(d.sum(0))
            d_flat[at] += d @ self.words[a:b]
        if rows:
            g["words"] = np.concatenate(rows), np.concatenate(values)
            g["words_bias"] = g["words"][0], np.concatenate(biases)
        d_states = d_flat.reshape(states.shape)
        d_drive = np.empty((*inputs.shape, 3 * n), np.float32)
        carry = np.zeros_like(last)
        back, over = self.rec.T.copy(), self.cand.T.copy()
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, c = held[t]
            carry += d_states[t]
            now = d_drive[t]
            dc = now[:, 2 * n :]
            np.multiply(carry, 1 - z, out=dc)
            dc *= 1 - c * c
            drh = dc @ over
            now[:, :n] = carry * (before - c) * z * (1 - z)
            now[:, n : 2 * n] = drh * before * r * (1 - r)
            carry *= z
            drh *= r
            carry += drh
            carry += now[:, : 2 * n] @ back
            carry *= keep[t]
        flat_drive = d_drive.reshape(-1, 3 * n)
        all_before = np.concatenate([x[0] for x in held])
        all_r = np.concatenate([x[2] for x in held])
        g["rec"] = all_before.T @ flat_drive[:, : 2 * n]
        all_r *= all_before
        g["cand"] = all_r.T @ flat_drive[:, 2 * n :]
        g["bias"] = flat_drive.sum(0)
        read = inputs.ravel().astype(np.int16)
        order = np.argsort(read, kind="stable")
        read = read[order]
        begin = np.flatnonzero(np.append(True, read[1:] != read[:-1]))
        g["emb"] = read[begin].astype(np.int64), np.add.reduceat(flat_drive[order], begin)
        return loss * float(scale), g, last


def _softmax(logits: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns logits, in place, into exponentials up to a factor a row. Their sums, and the log of the picked column's share."""
    if logits.max() > 60 or logits.min() < -60:  # else nothing overflows and no row vanishes
        logits -= logits.max(1, keepdims=True)
    chosen = logits[np.arange(len(picked)), picked].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    return total, chosen - np.log(total)


class Descent:
    """Steps against gradients: by their running moments, and for sparse ones by their summed squares."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.mean = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES if k not in net.SPARSE}
        self.square = {k: np.zeros(x.shape if x.ndim == 1 else (len(x), 1), np.float32) if k in net.SPARSE else np.zeros_like(x) for k in net.NAMES for x in [getattr(net, k)]}

    def __call__(self, g: dict, share: float) -> None:
        self.step += 1
        rate = self.rate * share
        for k, x in g.items():
            weights, square = getattr(self.net, k), self.square[k]
            if k in self.net.SPARSE:
                rows, x = x
                square[rows] += x * x if x.ndim == 1 else (x * x).mean(1, keepdims=True)
                weights[rows] -= 8 * rate * x / (np.sqrt(square[rows]) + 1e-6)
            else:
                m = self.mean[k]
                m += 0.1 * (x - m)
                square += 0.01 * (x * x - square)
                weights -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(square / (1 - 0.99**self.step)) + 1e-8)


@dataclass
class Lanes:
    """Documents in lanes of steps; the longest lanes come first, so those that go on at a step are the first ones."""

    wanted: np.ndarray
    inputs: np.ndarray
    keep: np.ndarray
    document: np.ndarray
    alive: np.ndarray

    def windows(self) -> Iterator[tuple[slice, int]]:
        for at in range(0, len(self.wanted), STEPS):
            yield slice(at, at + STEPS), int(self.alive[at])


def lanes(ids: np.ndarray, lengths: np.ndarray, known: Vocabulary, piece: int = 0) -> Lanes:
    """ids: the head places of all documents in order, -1 for the tail. Documents are dealt longest first to the shortest
    lane. piece: cuts them into pieces of so many tokens, each with a state of its own, in mixed order."""
    import heapq

    ends = np.cumsum(lengths)
    starts, sizes, owner = ends - lengths, lengths, np.arange(len(lengths))
    before = np.full(len(lengths), known.start, np.int32)
    order = np.argsort(-sizes, kind="stable")
    if piece:
        cuts = -(-lengths // piece)
        owner = np.repeat(owner, cuts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        starts = starts[owner] + at * piece
        sizes = np.minimum(piece, ends[owner] - starts)
        before = np.where(at > 0, known.input_of[ids[starts - 1]], known.start)
        order = np.random.default_rng(3).permutation(len(owner))
    heap = [(0, i) for i in range(max(1, min(LANES, len(sizes))))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in order.tolist():
        have, i = heap[0]
        dealt[i].append(d)
        heapq.heapreplace(heap, (have + int(sizes[d]), i))
    whole = np.array([int(sizes[d].sum()) for d in dealt])
    order = np.argsort(-whole, kind="stable")
    steps = int(whole.max(initial=0))
    shape = steps, len(dealt)
    made = Lanes(np.full(shape, -1, np.int32), np.full(shape, known.start, np.int16), np.ones((*shape, 1), bool), np.full(shape, -1, np.int32), (whole[order][None, :] > np.arange(0, steps)[:, None]).sum(1))
    for i, lane in enumerate(order.tolist()):
        at = 0
        for d in dealt[lane]:
            own = ids[starts[d] : starts[d] + sizes[d]]
            to = at + len(own)
            made.wanted[at:to, i] = own
            made.inputs[at, i] = before[d]
            made.inputs[at + 1 : to, i] = known.input_of[own[:-1]]
            made.keep[at, i] = 0
            made.document[at:to, i] = owner[d]
            at = to
    return made


def train_here(descent: Descent, ids: np.ndarray, lengths: np.ndarray) -> float:
    """One pass over the documents, with ever smaller steps; the loss a token on the way."""
    net, total, n = descent.net, 0.0, 0
    dealt = lanes(ids, lengths, net.vocabulary, PIECE)
    h = np.zeros((dealt.wanted.shape[1], net.hidden), np.float32)
    for part, k in dealt.windows():
        weight = (dealt.document[part, :k] >= 0).astype(np.float32)
        loss, g, h = net.gradient(dealt.inputs[part, :k], dealt.keep[part, :k], dealt.wanted[part, :k], weight, h[:k])
        descent(g, 1.05 - part.start / len(dealt.wanted))
        total, n = total + loss * weight.sum(), n + weight.sum()
    return total / max(1, n)


def log_scores(net: Network, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each document; of a tail word only that of its class."""
    total = np.zeros(len(lengths))
    if not len(lengths):
        return total
    dealt = lanes(ids, lengths, net.vocabulary)
    h = np.zeros((dealt.wanted.shape[1], net.hidden), np.float32)
    waiting, n = [], 0

    def settle() -> None:
        states, wanted, who = (np.concatenate(x) for x in zip(*waiting, strict=True))
        total[:] += np.bincount(who, weights=net.log_probability(states, wanted), minlength=len(lengths))
        waiting.clear()

    for part, k in dealt.windows():
        states, h = net.run(dealt.inputs[part, :k], dealt.keep[part, :k], h[:k])
        who = dealt.document[part, :k].ravel()
        live = np.flatnonzero(who >= 0)
        waiting.append((states.reshape(-1, net.hidden)[live], dealt.wanted[part, :k].ravel()[live], who[live]))
        n += len(live)
        if n >= STEPS * LANES:  # few lanes are left where a document is long
            settle()
            n = 0
    if waiting:
        settle()
    return total / np.log(10)


@dataclass
class Model:
    vocabulary: Vocabulary
    net: Network
    counts: DataFrame


def top_words(counts: DataFrame, head: int) -> tuple[list[bytes], np.ndarray]:
    """The words above a count such that at most ``head`` are left, by falling count; their counts."""
    by_count = counts.groupBy(F.floor(F.log2("c") * 64).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.col("bin").desc()).collect()  # 4096 rows at most
    least, have = None, 0
    for row in by_count:
        have += row.n
        if have > head:
            break
        least = row.c
    if least is None:
        return [], np.zeros(0)
    top = counts.where(F.col("c") >= least).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return top.column("word").to_pylist(), top.column("c").to_numpy().astype(np.float64)


def encoded(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """row, doc_id, train, ids, tails for each row of docs(doc_id, text): the places of its tokens among the head ``words``, -1 for
    others, and those others. Written once."""
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(pa.array(words, pa.binary()))
    end = words.index(END) if END in words else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found, n = words_of(batch.column("text"))
            place = pc.fill_null(pc.index_in(found, value_set=index.value), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            ids = np.full(len(place) + len(n), end, np.int32)
            at = np.arange(len(place)) + np.repeat(np.arange(len(n)), n)
            ids[at] = place
            ends = np.cumsum(n + 1)
            rest = found.filter(pa.array(place < 0))
            if end < 0:  # ends are tail words too
                source = np.full(len(ids), len(found), np.int64)
                source[at] = np.arange(len(found))
                rest = pa.concat_arrays([found, pa.array([END], pa.binary())]).take(pa.array(source[ids < 0]))
            few = np.append(0, np.cumsum(ids < 0)[ends - 1])
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids)), pa.ListArray.from_arrays(pa.array(few, pa.int32()), rest)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("train"), *lists], ["doc_id", "train", "ids", "tails"])

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out(F.col("doc_id"))).alias("train"), common.text_bytes())
    made = told.mapInArrow(run, "doc_id long, train boolean, ids array<int>, tails array<binary>")
    return common.save(made.withColumn("row", F.monotonically_increasing_id()))[0]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, lengths) of at most HELD tokens or one document."""
    for batch in batches:
        lists = batch.column("ids")
        whole = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(lengths), 0
        while a < len(lengths):
            before = int(ends[a] - lengths[a])
            b = max(a + 1, int(np.searchsorted(ends, before + HELD, "right")))
            yield batch.slice(a, b - a), whole[before : ends[b - 1]], lengths[a:b]
            a = b


def train(net: Network, docs: DataFrame, rate: float = 0.03) -> None:
    """Rounds of training on docs(doc_id, train, ids) of encoded(), in place."""
    part = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(16))
    for turn, (a, b) in enumerate(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], weights=net.get(), known=net.vocabulary, hidden=net.hidden, now=rate / (turn + 1)) -> Iterator[pa.RecordBatch]:
            mine = Network(known, hidden)
            mine.set(weights)
            descent, n = Descent(mine, now), 0
            for _, ids, lengths in chunks(batches):
                train_here(descent, ids, lengths)
                n += len(ids)
            if n:
                yield common.addends(mine.get() * np.float64(n), n)

        weights = common.summed(docs.where(F.col("train") & (part >= a) & (part < b)).select("ids").mapInArrow(run, common.ADDENDS))
        if len(weights):
            net.set(weights)


def learn(docs: DataFrame, head: int = 1 << 18, hidden: int = 24, modelled: int = 8192, inputs: int = 2048) -> tuple[Model, DataFrame]:
    """The model of the training rows of docs(doc_id, text), and encoded() of all."""
    counts, _ = common.save(word_counts(docs.where(~held_out(F.col("doc_id")))))
    told = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    words, known = top_words(counts, head)
    first, apart = cut_classes(known, modelled)
    vocabulary = Vocabulary(words, known, told.n or 0, told.v, first, apart, min(inputs, len(words)))
    net = Network(vocabulary, hidden)
    rows = encoded(docs, words)
    if told.n:
        train(net, rows)
    return Model(vocabulary, net, counts), rows


def score(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text). options: of learn()."""
    return apply(*learn(docs, **options))


def apply(model: Model, rows: DataFrame) -> DataFrame:
    """Scores of encoded() rows."""
    v = model.vocabulary
    shared = rows.sparkSession.sparkContext.broadcast((model.net, v.base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, base = shared.value
        for batch, ids, lengths in chunks(batches):
            starts = np.cumsum(lengths) - lengths
            in_head = np.add.reduceat((ids >= 0).astype(np.int64), starts)
            made = [pa.array(lengths), pa.array(in_head), pa.array(np.add.reduceat(base[ids], starts)), pa.array(log_scores(net, ids, lengths))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("train"), *made], ["row", "doc_id", "train", "n_tokens", "n_head", "base", "score"])

    made = rows.select("row", "doc_id", "train", "ids").mapInArrow(run, "row long, doc_id long, train boolean, n_tokens long, n_head long, base double, score double")
    tail = rows.select("row", F.explode("tails").alias("word")).join(model.counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    per_row = tail.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.1)).alias("logs"), F.count("*").alias("n_tail"), F.count(F.when(F.col("c") > 0, 1)).alias("known_tail"))
    whole = made.join(per_row, "row", "left").na.fill(0, ["logs", "n_tail", "known_tail"])
    return whole.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.col("known_tail")).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tail") * F.lit(float(np.log10(v.total + 0.1 * (v.distinct + 1))))).alias("base_score"),
        (F.col("score") + F.col("logs") - F.col("n_tail") * F.lit(float(np.log10(v.class_mass[v.tail])))).alias("score"),
    )
