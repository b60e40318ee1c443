"""Merkle manifest of a dataset: a hash tree over each source's documents and one over the sources.

Leaves are numbered within their source by exact ranks (``ranks.py``: digit histograms of doc_id, no global sort). The base-16 digits of
a rank are a leaf's key in the trie: nodes that share all digits but the last are a run and become their parent. Runs with the longest
common prefixes are reduced first: three digits at a time, so that each shuffle leaves a 4096th of the nodes and a task holds no more
than 4096 nodes of a tree together. Siblings are handed down the same way, three digits at a time, and proofs are computed row by row.

Defined results: a null field is ``-``; null is a source of its own, the first. doc_ids order leaves, nulls first; rows with one doc_id
come by their leaf, so the manifest is the same whatever the layout, and repeated rows have leaves of their own. An empty table gives
an empty result. Columns other than doc_id, source, lang, n_chars and text take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, ranks

#: Bits of a base-16 digit, and digits reduced between two shuffles.
DIGIT, DEEP = 4, 3
RUN, BLOCK = 1 << DIGIT, 1 << DIGIT * DEEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """The leaf of a row with the columns FIELDS, some of them changed."""
    return F.sha2(F.concat(*(_field(changed.get(name, F.col(name))) for name in FIELDS)), 256)


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def proof_digest(path: Column) -> Column:
    """Of a path's siblings, level by level, from left to right."""
    others = F.transform(path, lambda run: F.filter(run["digests"], lambda _, i: i != run["place"]))
    return _joined(F.flatten(others))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda own, run: _joined(F.transform(run["digests"], lambda d, i: F.when(i == run["place"], own).otherwise(d))))


def _blocks(nodes: DataFrame) -> DataFrame:
    """nodes(_tree, _at, _size, digest, kids), numbered from 0 in trees of _size nodes: a row of the same columns for each BLOCK of them,
    with what is inside as runs of runs of runs. A level of one node is no level: its digest goes up as it is."""
    ats = [F.shiftright("_at", DIGIT * k).alias(f"_at{k}") for k in range(DEEP + 1)]
    level = nodes.select("_tree", "_size", *ats, "digest", "kids").repartition("_tree", f"_at{DEEP}")
    for k in range(1, DEEP + 1):
        run = F.sort_array(F.collect_list(F.struct(F.col(f"_at{k - 1}").alias("at"), "digest", "kids")))
        level = level.groupBy("_tree", "_size", *(f"_at{i}" for i in range(k, DEEP + 1))).agg(run.alias("kids"))
        level = level.withColumn("digest", F.when(F.col("_size") > RUN ** (k - 1), _joined(F.col("kids.digest"))).otherwise(F.col("kids")[0]["digest"]))
    return level.withColumnRenamed(f"_at{DEEP}", "_at")


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The rounds of _blocks() up to one row a tree, each written; most: the nodes of the largest tree."""
    rounds = []
    while True:
        rounds.append(common.save(_blocks(nodes))[0])
        if most <= BLOCK:
            return rounds
        most = -(-most // BLOCK)
        nodes = rounds[-1].select("_tree", "_at", F.shiftright(F.col("_size") + BLOCK - 1, DIGIT * DEEP).alias("_size"), "digest", F.lit(0).alias("kids"))


def _descend(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The nodes that _climb() began with: _tree, _at, digest, kids and path, the runs above each with its place in them, and what paths
    has besides: _tree, path and any other columns, a row for each tree."""
    carried = [c for c in paths.columns if c not in ("_tree", "path")]
    at = paths.withColumn("_at", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        level = blocks.drop("digest").join(at.select("_tree", "_at", "path", *carried), ["_tree", "_at"])
        for k in range(DEEP, 0, -1):
            level = level.select("_tree", "_size", "path", *carried, F.col("kids.digest").alias("digests"), F.posexplode("kids").alias("place", "kid"))
            longer = F.concat(F.array(F.struct("digests", "place")), "path")
            path = F.when(F.col("_size") > RUN ** (k - 1), longer).otherwise(F.col("path")).alias("path")
            level = level.select("_tree", "_size", path, *carried, F.col("kid.at").alias("_at"), F.col("kid.digest").alias("digest"), F.col("kid.kids").alias("kids"))
        at = level
    return at.drop("_size")


def _numbered(trees: DataFrame) -> tuple[DataFrame, int]:
    """trees(_tree, ...) with _at, their places by name, and how many there are: ranges of names, and the rows of earlier ranges."""
    cut, _ = common.save(trees.repartitionByRange(common.parallel(trees.sparkSession), "_tree").withColumn("_part", F.spark_partition_id()))
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_tree")) - 1 + F.col("_before")
    return cut.join(before, "_part").select(*trees.columns, place.alias("_at")), cut.count()


def manifest(docs: DataFrame, **also: Column) -> DataFrame:
    """doc_id, leaf, the columns ``also``, subroot, root and path of each row. path: the runs from the leaf's own up to the root's, each an
    array of digests and the place of the row's own ancestor in it."""
    tree = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit("-")).alias("_tree")
    rows, _ = common.save(docs.select("doc_id", tree, leaf_of().alias("leaf"), *(c.alias(f"_{n}") for n, c in also.items()), F.monotonically_increasing_id().alias("_key")))
    placed, most = ranks.ranked(rows, ["_tree"], "doc_id", "leaf")
    leaves = placed.select("_tree", F.col("_rank").alias("_at"), "_size", F.col("leaf").alias("digest"), F.struct("doc_id", *(f"_{n}" for n in also)).alias("kids"))
    rounds = _climb(leaves, most)
    sources, many = _numbered(rounds[-1].select("_tree", "digest"))
    one = F.lit("").alias("_tree")
    above = _climb(sources.select(one, "_at", F.lit(many).cast("long").alias("_size"), "digest", F.col("_tree").alias("kids")), many)
    nothing = docs.sparkSession.createDataFrame([("", [])], "_tree string, path array<struct<digests: array<string>, place: int>>")
    top = nothing.join(above[-1].select("_tree", F.col("digest").alias("root")), "_tree")  # one row
    paths = _descend(above, top).select(F.col("kids").alias("_tree"), "path", F.col("digest").alias("subroot"), "root")
    found = _descend(rounds, paths)
    return found.select("kids.doc_id", F.col("digest").alias("leaf"), *(F.col(f"kids._{n}").alias(n) for n in also), "subroot", "root", "path")


def audit(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, after the text of the rows where ``tampered`` holds was put in
    lower case (A-Z): the manifest is of the rows as they were, the leaf that is folded of what they are."""
    after = F.when(tampered, leaf_of(text=common.ascii_lower(F.col("text"))))
    told = manifest(docs, after=after).withColumn("_root", folded(F.coalesce("after", "leaf"), F.col("path")))
    return told.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), F.col("_root").alias("folded_root"), (F.col("_root") == F.col("root")).alias("verified"))
