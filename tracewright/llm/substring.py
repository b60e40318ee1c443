"""Repeated passages by relative Lempel-Ziv parsing of the corpus against blocks of itself.

A window is ``window`` consecutive words; what repeats an earlier window goes. Each document is factored greedily against
every reference block that can hold a factor of it that long:

1. Anchors. Of the short word n-grams in a window, the rarest by a sketch of the corpus (then the least by hash) is
   its anchor, and a maximal run of windows with one anchor is a phrase. Equal windows have equal anchors, so a
   block is all phrases of an anchor. Frequent n-grams are anchors only where a window has no other, so
   that a common line or word pair doesn't make a crowded block. An anchor seen once holds no repeat.
2. Whole phrases. A phrase equal to an earlier one is one factor; first each task tells those that it has read
   itself. What is left of a block are its distinct phrases, each at its earliest place.
3. Factors. A task indexes blocks by the hashes of their word runs and parses each phrase against what comes before it:
   the longest earlier match of ``window`` words or more from a position is a factor, and the parse
   goes on at the first window that ends behind it, so windows across factor boundaries are checked too. A block of more than
   ``crowd`` phrases is dealt out by the hashes of windows; a phrase goes wherever one of its windows does.

The words that factors cover are removed. Words and runs are compared by 64-bit hashes.

Defined results: null text has no words; texts shorter than a window lose nothing. Rows that repeat
a doc_id are one document if their texts are equal, and neither is earlier than the other; with
different texts they keep apart. A null doc_id comes before all others. An empty table gives an empty result; columns
besides doc_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(17)
LOW, HIGH = (_random.integers(0, 1 << 64, 1024, dtype=np.uint64) | np.uint64(1) for _ in range(2))
HIGH[0] = 1
#: Cells of the sketch, as a power of two.
CELLS = 15
#: Bytes of text and phrases that a task works on at once, one longer text apart.
TEXT, PHRASES = 2_000_000, 1_000_000
#: Words of the blocks that a task factors at once.
WORDS = 1_000_000
NO_ID = -(1 << 63)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads what multiplication left in the high bits."""
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def run_hashes(hashes: np.ndarray, length: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Hash of each run of ``length`` words, by doubling."""
    base, have, done = base | 1, hashes, 1
    out, covered = None, 0
    while True:
        if length & done:  # this power of two is part of the length
            if out is None:
                out = have
            else:
                n = max(0, len(out) - done)
                out = out[:n] + np.uint64(pow(base, covered, 1 << 64)) * have[covered : covered + n]
            covered += done
        if covered == length:
            return mixed(out)
        n = max(0, len(have) - done)
        have = have[:n] + np.uint64(pow(base, done, 1 << 64)) * have[done : done + n]
        done *= 2


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts (binary, without nulls), and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    if first == last:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0] - first
    begin[starts] = inside[starts]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.arange(at[0], len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    factor = LOW[place & 1023]
    if place.max() > 1023:
        factor = factor * HIGH[place >> 10 & 1023]
    factor *= data[at[0] :].astype(np.uint64) + np.uint64(1)
    factor *= inside[at[0] :]
    found = mixed(np.add.reduceat(factor, at - at[0]))
    return found, np.diff(np.searchsorted(at, offsets - first))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with at most TEXT bytes of text, or one."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + TEXT, "right")))
        yield batch.slice(a, b - a)
        a = b


def rarity(docs: DataFrame, gram: int) -> np.ndarray:
    """For each cell of a sketch of all word n-grams: 0 below four times the mean, one more for each doubling from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            for part in slices(batch):
                hashes, n = word_hashes(part.column("text"))
                owner = np.repeat(np.arange(len(n)), n)
                cells = (run_hashes(hashes, gram) >> np.uint64(64 - CELLS)).astype(np.int64)[owner[: len(owner) - gram + 1] == owner[gram - 1 :]] if len(hashes) >= gram else []
                counts += np.bincount(cells, minlength=1 << CELLS)
        yield common.addends(counts.astype(np.float64), 1.0)

    total = common.summed(docs.select("text").mapInArrow(run, common.ADDENDS))
    if not total.any():
        return np.zeros(1 << CELLS, np.uint64)
    return np.clip(np.log2(np.maximum(total / total.mean(), 1)) - 1, 0, 15).astype(np.uint64)


def phrases(hashes: np.ndarray, n: np.ndarray, window: int, gram: int, rare: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, phrase hash, text, start, windows) of each phrase. hashes, n: of word_hashes()."""
    empty = np.zeros(0, np.uint64)
    if len(hashes) < window:
        return empty, empty, *(np.zeros(0, np.int64) for _ in range(3))
    owner = np.repeat(np.arange(len(n)), n)
    grams, whole = run_hashes(hashes, gram), run_hashes(hashes, window)
    # the rarest, then the least hash, then the leftmost: in one number
    key = rare[grams >> np.uint64(64 - CELLS)] << np.uint64(60) | (grams >> np.uint64(8) & np.uint64((1 << 28) - 1)) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
    wide, have = window - gram + 1, 1
    while have < wide:
        step = min(have, wide - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    at = (key & np.uint64((1 << 32) - 1)).astype(np.int64)
    live = np.flatnonzero(owner[: len(whole)] == owner[window - 1 :])
    if not len(live):
        return empty, empty, *(np.zeros(0, np.int64) for _ in range(3))
    first = np.flatnonzero(np.append(True, at[live][1:] != at[live][:-1]))
    count = np.diff(np.append(first, len(live)))
    begin = live[first]
    phrase = mixed(np.add.reduceat(whole[live], first) + whole[begin] * M1 + count.astype(np.uint64))
    text = owner[begin]
    return grams[at[begin]], phrase, text, begin - (np.cumsum(n) - n)[text], count


def references(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, part, text); part tells rows with one doc_id but different texts apart."""
    told = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), common.text_bytes())
    twice = told.groupBy("doc_id").count().where("count > 1").select("doc_id")
    none = F.lit(0).cast("long").alias("part")
    if twice.isEmpty():
        return told.select("doc_id", none, "text")
    twice, _ = common.save(twice)
    return told.join(twice, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("part"), "text").union(told.join(twice, "doc_id", "left_anti").select("doc_id", none, "text"))


ROW = (("anchor", pa.int64()), ("phrase", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("copied", pa.bool_()))
ROW_TOLD = "anchor long, phrase long, doc_id long, part long, start int, windows int, copied boolean"


def _rows(columns: list[np.ndarray], copied: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip([*columns, copied], ROW, strict=True)], [n for n, _ in ROW])


def cut(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """ROW for each phrase of references(); copied where the same task has read an equal phrase that is earlier."""
    rare = rarity(docs, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []

        def told() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            waiting.clear()
            anchor, phrase, doc, part, start, _ = columns
            order = np.lexsort((part, start, doc, phrase, anchor))
            columns = [c[order] for c in columns]
            anchor, phrase, doc, part, start, _ = columns
            same = (anchor[1:] == anchor[:-1]) & (phrase[1:] == phrase[:-1])
            first = np.flatnonzero(np.append(True, ~same))
            lead = np.repeat(first, np.diff(np.append(first, len(anchor))))
            later = (doc > doc[lead]) | (start > start[lead])
            again = np.append(False, same & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & (part[1:] == part[:-1]))
            # copied phrases side by side in one text are one run
            gone = np.flatnonzero(later & ~again)
            gone = gone[np.lexsort((start[gone], part[gone], doc[gone]))]
            windows = columns[5][gone].astype(np.int64)
            d, p, s = doc[gone], part[gone], start[gone]
            on = np.append(False, (d[1:] == d[:-1]) & (p[1:] == p[:-1]) & (s[1:] == s[:-1] + windows[:-1])) if len(gone) else np.zeros(0, bool)
            begin = np.flatnonzero(~on)
            runs = [np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), d[begin], p[begin], s[begin], np.add.reduceat(windows, begin) if len(begin) else windows]
            left = ~later & ~again
            return _rows([np.concatenate([c[left].astype(np.int64), r]) for c, r in zip(columns, runs, strict=True)], np.append(np.zeros(int(left.sum()), bool), np.ones(len(begin), bool)))

        held = 0
        for batch in batches:
            ids, parts = (batch.column(c).to_numpy() for c in ("doc_id", "part"))
            at = 0
            for piece in slices(batch):
                anchor, phrase, text, start, windows = phrases(*word_hashes(piece.column("text")), window, gram, rare)
                waiting.append([anchor.view(np.int64), phrase.view(np.int64), ids[at + text], parts[at + text], start, windows])
                at += len(piece)
                held += len(anchor)
                if held >= PHRASES:
                    yield told()
                    held = 0
        if held:
            yield told()

    return docs.select("doc_id", "part", "text").mapInArrow(run, ROW_TOLD)


def distinct_phrases(rows: DataFrame) -> DataFrame:
    """ROW from those of cut(): copied for each phrase that has an equal earlier one; the others only where their anchor has
    several. Anchors seen once go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, several = None, False  # (anchor, phrase, doc_id, start) of the latest phrase's first row
        held: list[list[np.ndarray]] = []  # first rows of an anchor that has one phrase so far
        for batch in batches:
            done = batch.column("copied").to_numpy(zero_copy_only=False)
            columns = [batch.column(n).to_numpy() for n, _ in ROW[:-1]]
            if done.any():
                yield _rows([c[done] for c in columns], np.ones(int(done.sum()), bool))
                columns = [c[~done] for c in columns]
            anchor, phrase, doc, _, start, _ = columns
            if not len(anchor):
                continue
            fresh = np.append(last is None or anchor[0] != last[0], anchor[1:] != anchor[:-1])
            other = fresh | np.append(last is None or phrase[0] != last[1], phrase[1:] != phrase[:-1])
            group = np.cumsum(other)
            lead = np.flatnonzero(other)
            first_doc, first_start = np.append(last[2] if last else 0, doc[lead])[group], np.append(last[3] if last else 0, start[lead])[group]
            later = (doc > first_doc) | ((doc == first_doc) & (start > first_start))
            block = np.cumsum(fresh)
            many = np.bincount(block, weights=other, minlength=block[-1] + 1)
            many[0] += (last is not None) + several  # the block that goes on
            if held and many[0] > 1:
                yield from (_rows(h, np.zeros(len(h[0]), bool)) for h in held)
                held = []
            elif held and block[-1] > 0:
                held = []
            out = later | (many[block] > 1)
            if out.any():
                yield _rows([c[out] for c in columns], later[out])
            end, several = block[-1], bool(many[block[-1]] > 1)
            if not several:
                rest = (block == end) & ~later
                if rest.any():
                    held.append([c[rest] for c in columns])
            last = (anchor[-1], phrase[-1], first_doc[-1], first_start[-1])

    # copied rows go anywhere
    by = F.when(F.col("copied"), F.xxhash64("doc_id", "start")).otherwise(F.col("anchor"))
    dealt = rows.withColumn("_by", by).repartition(common.parallel(rows.sparkSession), "_by").drop("_by")
    return dealt.sortWithinPartitions("anchor", "phrase", "doc_id", "start", "part").mapInArrow(run, ROW_TOLD)


def longest_matches(words: np.ndarray, room: np.ndarray, starts: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """For each of ``starts`` in words (hashes that tell blocks apart, too) the length of the longest run from there, of at most ``room``
    words, that also begins at a smaller place; 0 if that is shorter than a window."""
    out = np.zeros(len(starts), np.int64)
    live = np.flatnonzero(room >= window)
    length = window
    while len(live):
        runs = run_hashes(words, length)[starts[live]]
        order = np.argsort(runs, kind="stable")
        runs, who = runs[order], live[order]
        first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        size = np.diff(np.append(first, len(runs)))
        least = np.repeat(np.minimum.reduceat(place[who], first), size)
        out[who[place[who] > least]] = length
        length += 1
        live = who[np.repeat(size, size) > 1]  # only runs that are not alone can match further
        live = live[room[live] >= length]
    return out


def parse(longest: np.ndarray, first: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, length) of the factors of phrases, greedily from the left. longest: of all windows of all phrases; a phrase's are
    ``count`` from ``first`` on."""
    ends = first + count
    nothing = len(longest)
    to = np.where(longest > 0, np.arange(nothing), nothing)
    nearest = np.append(np.minimum.accumulate(to[::-1])[::-1], nothing)  # the next window that begins a factor
    cursor, positions = first.copy(), []
    while True:
        at = nearest[cursor]
        going = at < ends
        if not going.any():
            break
        at, ends = at[going], ends[going]
        positions.append(at)
        cursor = np.minimum(at + longest[at] - window + 1, ends)  # the first window that ends behind the factor
    at = np.concatenate(positions) if positions else np.zeros(0, np.int64)
    return at, longest[at]


def factors(docs: DataFrame, edges: DataFrame, window: int, crowd: int) -> DataFrame:
    """(doc_id, part, start, windows): the factors of phrases edges(anchor, doc_id, part, start, windows) of references() docs."""
    hot, _ = common.save(edges.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd))
    edges = edges.join(hot, "anchor", "left").select("doc_id", "part", F.struct("anchor", "start", "windows", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(crowd)).cast("int").alias("ways")).alias("x"))
    wanted = edges.groupBy("doc_id", "part").agg(F.collect_list("x").alias("x"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, n = word_hashes(part.column("text"))
                lists = part.column("x")
                flat = lists.flatten()
                anchor, start, count, ways = (flat.field(k).to_numpy() for k in ("anchor", "start", "windows", "ways"))
                row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                begin = (np.cumsum(n) - n)[row] + start
                way = np.zeros(len(row), np.int64)
                if ways.max(initial=1) > 1:  # a row for each way that one of the phrase's windows takes
                    runs = run_hashes(hashes, window)
                    take, way = [], []
                    for i, w in enumerate(ways.tolist()):
                        of = np.unique(runs[begin[i] : begin[i] + count[i]] % np.uint64(w)) if w > 1 else [0]
                        take += [i] * len(of)
                        way += list(of)
                    anchor, start, count, row, begin = (x[take] for x in (anchor, start, count, row, begin))
                    way = np.array(way, np.int64)
                size = count.astype(np.int64) + window - 1
                ends = np.cumsum(size)
                at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(begin, size)
                made = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(hashes[at].view(np.int64)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(way), part.column("doc_id").take(take), part.column("part").take(take), pa.array(start), made], ["anchor", "way", "doc_id", "part", "start", "words"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def told(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            lists = rows.column("words").combine_chunks()
            anchor, way, doc, start = (rows.column(c).to_numpy() for c in ("anchor", "way", "doc_id", "start"))
            size = lists.value_lengths().to_numpy().astype(np.int64)
            block = np.cumsum(np.append(0, (anchor[1:] != anchor[:-1]) | (way[1:] != way[:-1])))
            hashes = mixed(lists.flatten().to_numpy().view(np.uint64) ^ np.repeat(block.astype(np.uint64) * M2, size))
            count = size - window + 1
            first = np.cumsum(count) - count
            owner = np.repeat(np.arange(len(size)), count)
            step = np.arange(len(owner)) - first[owner]
            _, rank = np.unique(doc, return_inverse=True)
            place = rank[owner] << 32 | start[owner] + step
            at, length = parse(longest_matches(hashes, size[owner] - step, (np.cumsum(size) - size)[owner] + step, place, window), first, count, window)
            take = pa.array(owner[at])
            return pa.RecordBatch.from_arrays([rows.column("doc_id").take(take).combine_chunks(), rows.column("part").take(take).combine_chunks(), pa.array((start[owner[at]] + step[at]).astype(np.int32)), pa.array((length - window + 1).astype(np.int32))], ["doc_id", "part", "start", "windows"])

        held = 0
        for batch in batches:
            if not len(batch):
                continue
            held += len(batch.column("words").flatten())
            waiting.append(batch)
            if held >= WORDS:  # whole blocks only: what the last one has may go on
                rows = pa.Table.from_batches(waiting)
                same = (rows.column("anchor").to_numpy() == rows.column("anchor")[-1].as_py()) & (rows.column("way").to_numpy() == rows.column("way")[-1].as_py())
                n = int(np.argmax(same))
                if n:
                    yield told(rows.slice(0, n))
                    waiting = rows.slice(n).combine_chunks().to_batches()
                    held = sum(len(b.column("words").flatten()) for b in waiting)
        if waiting:
            yield told(pa.Table.from_batches(waiting))

    dealt = docs.join(wanted, ["doc_id", "part"]).select("doc_id", "part", "text", "x").mapInArrow(words, "anchor long, way long, doc_id long, part long, start int, words array<long>")
    dealt = dealt.repartition(common.parallel(docs.sparkSession), "anchor", "way").sortWithinPartitions("anchor", "way", "doc_id", "start", "part")
    return dealt.mapInArrow(found, "doc_id long, part long, start int, windows int")


def covered(n_words: int, runs: list, window: int) -> np.ndarray:
    """Which words stand in a factor."""
    edge = np.zeros(n_words + 1, np.int32)
    for run in runs or ():
        edge[run["start"]] += 1
        edge[min(n_words, run["start"] + run["windows"] - 1 + window)] -= 1
    return np.cumsum(edge[:-1]) > 0


def strip(docs: DataFrame, window: int = 20, gram: int = 5, crowd: int = 4096) -> DataFrame:
    """doc_id, n_words, n_removed, kept: one row for each row of docs(doc_id, text); kept is the text that is left."""
    told = references(docs)
    found, _ = common.save(distinct_phrases(cut(told, window, gram)))
    edges = found.where("not copied").select("anchor", "doc_id", "part", "start", "windows").distinct()
    runs = found.where("copied").select("doc_id", "part", "start", "windows").union(factors(told, edges, window, crowd))
    runs = runs.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, kept = [], [], []
            for text, some in common.rows_of(batch, "text", "runs"):
                own = text.split()
                gone = covered(len(own), some, window) if some else None
                words.append(len(own))
                removed.append(int(gone.sum()) if some else 0)
                kept.append(b" ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g) if some else b" ".join(own))
            ids = [None if i == NO_ID else i for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return told.join(runs, ["doc_id", "part"], "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
