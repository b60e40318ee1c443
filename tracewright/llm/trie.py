"""Prefix trie of conversations, with totals of subtrees by peeling leaves.

A node is a distinct sequence of first turns. It is known by sums of hashes of its turns and their places (192 bits), which are prefix
sums over a conversation, so that a long one is many tasks; texts aren't shuffled. Each node belongs to the longest of its members (the
smallest id of those), so that the nodes of one owner are a stretch of a path downwards. Stretches are the vertices that pass messages:
each holds a counter of the stretches that hang on it and aren't complete. Those at zero are peeled: they send their totals to the
stretch above, where counters fall, until only the root's is left. A path from the root changes stretches less often than the square root of
twice the nodes, and once or twice in logs of growing conversations, where nodes alone would need a round for each turn.
At the end prefix sums over each stretch, from below and with what came in, are the totals of its nodes.

Defined results: rows without conv_id take no part; a null role or text is empty; turns come by number, nulls first, then by a hash of role and text,
so repeated rows are repeated turns. Without conversations there is no root and the result is empty. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, ranks

#: Bits of a turn's place, or of an id, that are ordered in one task.
NEAR = 12
SUMS = [f"_s{i}" for i in range(6)]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), token (of role and text), weight (code points of the text), turns (of the conversation), written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.lit(":"), text), 256)
    own = conversations.where("conv_id is not null").select("conv_id", "turn", token.alias("token"), F.length(text).cast("long").alias("weight"), F.monotonically_increasing_id().alias("_key"))
    placed, _ = ranks.ranked(common.save(own)[0], ["conv_id"], "turn", "token")
    return common.save(placed.select("conv_id", F.col("_rank").alias("place"), "token", "weight", F.col("_size").alias("turns")))[0]


def rebuilt(turns: DataFrame, period: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, convs) of turns_of(): each conversation after its first h turns, behind the first h turns of the one whose id is the multiple of
    ``period`` at or before it (towards zero); h: crc32 of the id modulo most + 1. rows: conv_id, depth (from 1), token, weight, length;
    convs: conv_id, length, for turnless ones, too."""
    start = F.col("conv_id") - F.col("conv_id") % period
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    heads = turns.where((F.col("conv_id") % period == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "_start")
    sizes = heads.where("place = 0").select("_start", F.col("turns").alias("_there"))
    kept = F.least("_h", F.coalesce("_there", F.lit(0)))
    told = turns.withColumns({"_start": start, "_h": h}).join(sizes, "_start", "left").withColumn("_kept", kept)
    told = told.withColumn("length", F.col("_kept") + F.greatest(F.col("turns") - F.col("_h"), F.lit(0)))
    convs = told.where("place = 0").select("conv_id", "length", "_start", "_h")
    taken = convs.join(heads.select("_start", "place", "token", "weight"), "_start").where("place < _h")
    first = taken.select("conv_id", (F.col("place") + 1).alias("depth"), "token", "weight", "length")
    own = told.where("place >= _h").select("conv_id", (F.col("place") - F.col("_h") + F.col("_kept") + 1).alias("depth"), "token", "weight", "length")
    return first.unionByName(own), convs.select("conv_id", "length")


def _running(rows: DataFrame, group: str, at: str, sums: list[str], down: bool = False) -> DataFrame:
    """rows with the columns ``sums`` as running sums over a group in the order of ``at``, from above if down: inside stretches of
    2**NEAR places, with what the stretches before sum to. Of a group's place there is one row."""
    rows = rows.withColumn("_near", F.shiftright(at, NEAR))
    order = (lambda c: F.col(c).desc()) if down else F.col
    whole = rows.groupBy(group, "_near").agg(*(F.sum(s).alias(f"{s}_in") for s in sums))
    w = Window.partitionBy(group).orderBy(order("_near")).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(group, "_near", *(F.sum(f"{s}_in").over(w).alias(f"{s}_in") for s in sums)).where(f"{sums[0]}_in is not null")
    inside = Window.partitionBy(group, "_near").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumns({s: F.sum(s).over(inside) for s in sums}).join(carried, [group, "_near"], "left")
    return told.withColumns({s: F.col(s) + F.coalesce(f"{s}_in", F.lit(0)) for s in sums}).drop("_near", *(f"{s}_in" for s in sums))


def _key(sums: list[Column], depth: Column) -> Column:
    return F.sha2(F.concat_ws(",", *(s.cast("string") for s in sums), depth.cast("string")), 256)


def _ends(members: DataFrame) -> DataFrame:
    """key, ends: the hash of the ids of members(key, conv_id), ascending and joined by commas. Ids are joined in stretches of 2**NEAR; a node's
    stretches are hashed one after the other as they come in order, however many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, found = None, None, []
        for batch in batches:
            for key, ids in common.rows_of(batch, "key", "ids"):
                if key != now:
                    if now is not None:
                        found.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(found) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["key", "ends"])
                found = []
        if now is not None:
            found.append((now, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["key", "ends"])

    near = members.groupBy("key", F.shiftright("conv_id", NEAR).alias("near")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return near.repartition("key").sortWithinPartitions("key", "near").select("key", "ids").mapInArrow(run, "key string, ends string")


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, key, above (its parent's key), owner, n_convs, weight, ends of each node, written. rows(conv_id, depth, token, weight, length),
    convs(conv_id, length)."""
    told = F.sha2(F.concat(F.col("token"), F.lit(":"), F.col("depth").cast("string")), 256)
    parts = rows.withColumn("_told", told).withColumns({s: F.conv(F.substring("_told", 8 * i + 1, 8), 16, 10).cast("long") for i, s in enumerate(SUMS)}).drop("_told", "token")
    parts = parts.withColumns({f"{s}_own": F.col(s) for s in SUMS})
    paths = _running(parts, "conv_id", "depth", SUMS)
    sums = [F.col(s) for s in SUMS]
    before = _key([F.col(s) - F.col(f"{s}_own") for s in SUMS], F.col("depth") - 1)
    seen = paths.select(_key(sums, F.col("depth")).alias("key"), before.alias("above"), "conv_id", "depth", "weight", "length")
    zero = [F.lit(0)] * len(SUMS)
    root = convs.select(_key(zero, F.lit(0)).alias("key"), F.lit(None).cast("string").alias("above"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("weight"), "length")
    every, _ = common.save(seen.unionByName(root))
    longest = F.max_by("conv_id", F.struct("length", F.bitwise_not("conv_id"))).alias("owner")
    nodes = every.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("above").alias("above"), longest, F.count("*").alias("n_convs"), F.max("weight").alias("weight"))
    ends = _ends(every.where("depth = length").select("key", "conv_id"))
    return common.save(nodes.join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))))[0]


def peeled(stretches: DataFrame) -> DataFrame:
    """stretches(unit, parent, at, saved, leaves) with the totals of all that hangs below them; parent is null for the root's. One row of
    a unit; each round peels those on which nothing hangs any more, and is a written table."""
    waiting = stretches.where("parent is not null").groupBy(F.col("parent").alias("unit")).agg(F.count("*").alias("left"))
    live, _ = common.save(stretches.join(waiting, "unit", "left").withColumn("left", F.coalesce("left", F.lit(0))))
    done = live.where("left = 0").drop("left")
    while not (rest := live.where("left > 0")).isEmpty():
        sent = live.where("left = 0 and parent is not null").groupBy(F.col("parent").alias("unit")).agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"), F.count("*").alias("_sent"))
        more = {a: F.col(a) + F.coalesce(b, F.lit(0)) for a, b in (("saved", "_saved"), ("leaves", "_leaves"))}
        met = rest.join(sent, "unit", "left").withColumns(more | {"left": F.col("left") - F.coalesce("_sent", F.lit(0))})
        live, _ = common.save(met.select(live.columns))
        done = done.unionByName(live.where("left = 0").drop("left"))
    return done


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie over rows(conv_id, depth, token,
    weight, length) and convs(conv_id, length)."""
    nodes = nodes_of(rows, convs)
    children = nodes.where("above is not null").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("_up"))
    told = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(parents, "above", "left")
    own = {"saved": (F.col("n_convs") - 1) * F.col("weight"), "leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")}
    told, _ = common.save(told.withColumns(own).drop("key", "above", "weight"))
    top = F.min(F.struct("depth", "_up")).alias("top")
    stretches = told.groupBy(F.col("owner").alias("unit")).agg(top, F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    sent = peeled(stretches.select("unit", F.col("top._up").alias("parent"), (F.col("top.depth") - 1).alias("at"), "saved", "leaves"))
    arrived = sent.where("parent is not null").groupBy(F.col("parent").alias("owner"), F.col("at").alias("depth")).agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
    summed = told.join(arrived, ["owner", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("saved", "leaves")})
    found = _running(summed, "owner", "depth", ["saved", "leaves"], down=True)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
