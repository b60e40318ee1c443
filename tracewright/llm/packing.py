"""Best-fit packing of token sequences with a bounded number of open bins.

Each scan partition tokenizes and packs what it reads, in one narrow map, and writes it once. Pieces arrive
online; each goes into the open bin with the least free space that still holds it. Open bins stand in a
bitset keyed by free space, so that bin is the lowest set bit at or above the piece's length. Where no bin fits and
all ``open_bins`` are in use, the fullest closes. At the end of a partition at most ``open_bins`` bins are open. The
pieces in those are packed once more, by the same rule, in tasks that each get the pieces of many partitions: the
number of sequences doesn't depend on how finely the input is cut.

Tokenizing works on whitespace-separated chunks. The vocabulary's pre-tokenizer drops
white space and never joins across it, so a text's ids are its chunks' ids in order; a
bounded table keeps the ids of chunks already seen.

Defined results: null text is an empty text, i.e. the end id alone; texts longer than the limit
are cut into pieces of the full length and a last shorter one. Repeated rows are packed as
often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters whose composed form, lower case and byte encoding need no tokenizer.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
STOPS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself where printable, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b and b != 173]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class ChunkIds:
    """Little-endian 32-bit ids of texts, by chunk.

    Ids of ``keep`` chunks at least and twice as many at most are remembered, the recently used ones. A word with stops
    behind it is its letters' ids and the stops' ids, for the pre-tokenizer parts them there.
    """

    def __init__(self, vocabulary: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.keep = keep
        self.seen: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.stops: dict[str, bytes] = {}

    def _put(self, key: bytes, ids: bytes) -> bytes:
        if len(self.seen) >= self.keep:
            self.older, self.seen = self.seen, {}
        self.seen[key] = ids
        return ids

    def _letters(self, word: str) -> bytes:
        raw = word.encode()
        spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, raw))
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk that isn't in ``seen``."""
        found = self.older.get(chunk)
        if found is None:
            text = chunk.decode("utf-8", "replace")
            core = text.rstrip(STOPS)
            if LETTERS.fullmatch(core):
                low = core.lower()
                key = low.encode()
                found = self.seen.get(key) or self.older.get(key)
                if found is None:
                    found = self._letters(low)
                    if key != chunk:
                        self._put(key, found)
                if len(core) < len(text):
                    stops = text[len(core) :]
                    if stops not in self.stops:
                        if len(self.stops) > 10_000:
                            self.stops.clear()
                        self.stops[stops] = self._plain(stops)
                    found += self.stops[stops]
            else:
                found = self._plain(text)
        return self._put(chunk, found)

    def encode(self, text: bytes) -> bytes:
        chunks = text.split()
        found = list(map(self.seen.get, chunks))
        at = -1
        try:
            while True:  # only what isn't known
                at = found.index(None, at + 1)
                found[at] = self.chunk(chunks[at])
        except ValueError:
            return b"".join(found)


_ENCODERS: dict[str, ChunkIds] = {}


def encoder(vocabulary: str, keep: int) -> ChunkIds:
    """One per Python worker: a reused worker remembers what its earlier tasks met."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ChunkIds(vocabulary, keep)
    _ENCODERS[vocabulary].keep = keep
    return _ENCODERS[vocabulary]


class OpenBins:
    """The open bins of one task: a bitset of their free spaces, and for each the bins that have it."""

    def __init__(self, size: int, limit: int, first: int = 0):
        self.size, self.limit, self.next = size, limit, first
        self.bits, self.count = 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        return got

    def place(self, length: int) -> tuple[int, int, list[int]]:
        """The bin and the place in it for a piece of this length; the bins that this closes."""
        fitting, closed = self.bits >> length, []
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            got = self._take(free)
        else:
            if self.count >= self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest
                self.count -= 1
            got, free = self.next, self.size
            self.next += 1
            self.count += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(got)
            self.bits |= 1 << left
        else:
            closed.append(got)
            self.count -= 1
        return got, self.size - free, closed


FIELDS = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()))
TOLD = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
AT = 5  # where a row's sequence_id and offset stand
ROWS = 2048


def placed(pieces: Iterator[tuple], bins: OpenBins) -> Iterator[tuple[tuple, bool]]:
    """Rows (..., sequence_id, offset, ...) as their bins close; at the end those of the bins still open, with True.
    pieces: rows without the two, the length at position 3."""
    waiting: dict[int, list[tuple]] = {}
    for row in pieces:
        where, offset, closed = bins.place(row[3])
        waiting.setdefault(where, []).append((*row[:AT], where, offset, *row[AT:]))
        for got in closed:
            for done in waiting.pop(got):
                yield done, False
    for rows in waiting.values():
        for row in rows:
            yield row, True


def _batches(rows: Iterator[tuple[tuple, bool]], with_ids: bool, with_open: bool) -> Iterator[pa.RecordBatch]:
    from itertools import batched

    for some in batched(rows, ROWS):
        columns = list(zip(*(row for row, _ in some), strict=True))
        made = [pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=False)]
        names = [n for n, _ in FIELDS]
        if with_ids:
            made.append(pa.array(columns[-1], pa.binary()))
            names.append("ids")
        if with_open:
            made.append(pa.array([left for _, left in some]))
            names.append("open")
        yield pa.RecordBatch.from_arrays(made, names)


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    size: int = 4096,
    end_id: int = 1,
    open_bins: int = 64,
    with_ids: bool = False,
    share: int = 256,
    keep: int = 300_000,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs(doc_id, text).

    with_ids: also ids, the piece's tokens as little-endian unsigned 32-bit numbers, of which ids_crc32 is the sum. ``vocabulary`` is a tokenizer file's path
    on every executor. keep: how many chunks' ids a worker remembers. share: the sequences' worth of leftover pieces that a task of the second packing gets.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = end_id.to_bytes(4, "little")
    told = TOLD + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids_of = encoder(vocabulary, keep).encode
        for batch in batches:
            for doc_id, text in common.rows_of(batch, "doc_id", "text"):
                ids = ids_of(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    yield (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *(part,) * with_ids)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(placed(cut(batches), OpenBins(size, open_bins, TaskContext.get().partitionId() << 33)), with_ids, True)
        common.tidy()

    def rows_again(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from common.rows_of(batch, *(n for n, _ in FIELDS[:AT]), *("ids",) * with_ids)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(placed(rows_again(batches), OpenBins(size, open_bins, 1 << 62 | TaskContext.get().partitionId() << 33)), with_ids, False)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes())
    made, _ = common.save(docs.mapInArrow(first, told + ", open boolean"))
    left = made.where("open")
    tasks = max(1, (left.agg(F.sum("length")).first()[0] or 0) // (size * share))
    # in an order that the layout of the input doesn't decide
    dealt = left.withColumn("_by", F.xxhash64("doc_id", "piece", "ids_crc32")).repartition(tasks, "_by").sortWithinPartitions("_by", "doc_id", "piece").drop("_by", "open")
    return made.where("not open").drop("open").unionByName(dealt.mapInArrow(again, told))
