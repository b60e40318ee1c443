"""The registered queries of this package, each over its whole table, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, embdedup, lm, manifest, mixing, packing, pii, quality, simhash, substring, topk, toxicity, trie, urlfilter


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.valid(common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "embedding")
    # whole numbers as doubles: exact at any magnitude
    rows = rows.select("id", F.transform("embedding", lambda x: topk.whole(x.cast("double") * 256)).alias("values"))
    return topk.top_k(rows.where("id % 50 = 0"), rows.where("id is not null"), k=5)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(common.table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.report(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.strip(common.table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(common.table(spark, sf_dir, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_sizes(common.table(spark, sf_dir, "documents")).select("doc_id", "source", "size")
    docs, _ = common.save(docs)  # sizes are counted once, not for each of the steps
    return mixing.copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.turns_of(common.table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(*trie.rebuilt(turns))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.audit(common.table(spark, sf_dir, "documents"), tampered)


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk_search,
        op2_best_fit_packing,
        op3_lm_scoring,
        op4_pii,
        op5_substring_dedup,
        op6_embedding_near_dedup,
        op7_url_filter,
        op8_simhash_near_dedup,
        op9_quality_classifier,
        op10_source_mixing,
        op11_prefix_trie,
        op12_toxicity,
        op13_merkle_manifest,
    )
}

TOPK_SQL = """
WITH v AS (
  SELECT vec_id AS id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.x, c.x)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.x) = len(c.x) WHERE q.id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

SUBSTRING_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20
), k AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM s
), f AS (
  SELECT doc_id, p, rank() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM f WHERE n > 1
), g AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), t AS (
  SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string([z[1] FOR z IN list_zip(w, range(1, len(w) + 1)) IF NOT list_contains(gone, z[2])], ' '), '')) AS kept_sha256
FROM t
"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), r AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.id
), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

URL_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule, host, path, action) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), m AS (
  SELECT h.page_id, h.host, h.path, r.rule, r.action, row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rule) DESC) AS n
  FROM h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(action, CASE
  WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])(casino|bets|poker|porn|xxx|adult|pills|warez)([^A-Za-z0-9]|$)') THEN 'block'
  WHEN regexp_matches(host || path, '^([^/]*\.)?(ads?-track(er|ing)?|click-ads?)\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE n = 1
"""



def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text in SQL: each byte is mixed in, then eight shifts."""
    steps = f"flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split({text}, '')])"
    return f"""xor(4294967295, list_reduce([4294967295] || CAST({steps} AS BIGINT[]), lambda r, s:
      CASE WHEN s >= 0 THEN xor(r, s) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))"""


def _tree_sql(name: str, levels: int) -> str:
    """Levels above {name}0(tree, idx, d): {name}K are nodes with their tree's number of nodes, {name}rK the runs of level K."""
    out = ""
    for k in range(levels):
        out += f""", {name}c{k} AS (SELECT tree, idx, d, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k})
, {name}r{k} AS (SELECT tree, idx // 16 AS idx, array_agg(d ORDER BY idx) AS ds, any_value(n) AS n FROM {name}c{k} GROUP BY tree, idx // 16)
, {name}{k + 1} AS (SELECT tree, idx, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {name}r{k})
"""
    return out


def _path_sql(name: str, levels: int) -> tuple[str, str]:
    """(joins, runs): the runs of x.tree and x.idx as structs of digests and place; those of levels of one node are left out."""
    joins = "".join(f" JOIN {name}r{k} p{k} ON p{k}.tree = x.tree AND p{k}.idx = x.idx // {16 ** (k + 1)}" for k in range(levels))
    runs = ", ".join(f"CASE WHEN p{k}.n > 1 THEN {{'ds': p{k}.ds, 'i': x.idx // {16**k} % 16}} END" for k in range(levels))
    return joins, f"[r FOR r IN [{runs}] IF r IS NOT NULL]"


LEVELS, SOURCE_LEVELS = 7, 4
_joins, _runs = _path_sql("t", LEVELS)
_over, _up = _path_sql("s", SOURCE_LEVELS)
_said = ", ".join(f"coalesce(strlen(CAST({{{c}}} AS VARCHAR)) || ':' || {{{c}}}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text"))
MERKLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(':' || source, '-') AS tree, sha256(concat({_said.format(doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")})) AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0
      THEN sha256(concat({_said.format(doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})) END AS after
  FROM documents
), x AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d)
, t0 AS (SELECT tree, idx, leaf AS d FROM x)
{_tree_sql("t", LEVELS)}, top AS (SELECT tree AS source, row_number() OVER (ORDER BY tree) - 1 AS idx, d FROM t{LEVELS})
, s0 AS (SELECT '' AS tree, idx, d FROM top)
{_tree_sql("s", SOURCE_LEVELS)}, up AS (SELECT x.source, x.d AS subroot, {_up} AS above FROM (SELECT '' AS tree, * FROM top) x {_over})
, p AS (SELECT x.doc_id, x.leaf, x.after, up.subroot, {_runs} || up.above AS path FROM x {_joins} JOIN up ON up.source = x.tree)
, f AS (
  SELECT doc_id, leaf, subroot, (SELECT d FROM s{SOURCE_LEVELS}) AS root,
    sha256(array_to_string(flatten([[z[1] FOR z IN list_zip(r.ds, range(len(r.ds))) IF z[2] <> r.i] FOR r IN path]), '')) AS proof_sha256,
    list_reduce([{{'ds': [coalesce(after, leaf)], 'i': CAST(0 AS BIGINT)}}] || path, lambda a, r:
      {{'ds': [sha256(array_to_string(r.ds[1:r.i] || a.ds || r.ds[r.i + 2:], ''))], 'i': CAST(0 AS BIGINT)}}).ds[1] AS folded_root
  FROM p
)
SELECT *, folded_root = root AS verified FROM f
"""

TRIE_SQL = f"""
WITH k AS (SELECT conv_id AS c, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), ':', coalesce(text, ''))) AS token, length(coalesce(text, '')) AS weight
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, token) AS o FROM k),
n AS (SELECT c, count(*) AS size, c - c % 100 AS b FROM t GROUP BY c),
g AS (SELECT n.c, n.b, n.size, {_crc32("CAST(n.c AS VARCHAR)")} % 6 AS h, coalesce(m.size, 0) AS there FROM n LEFT JOIN n m ON m.c = n.b),
r AS (SELECT g.c, t.o AS depth, t.token, t.weight FROM g JOIN t ON t.c = g.b AND t.o <= g.h
  UNION ALL SELECT g.c, t.o - g.h + least(g.h, g.there), t.token, t.weight FROM g JOIN t ON t.c = g.c AND t.o > g.h),
p AS (SELECT c, depth, weight, array_to_string(list(token) OVER (PARTITION BY c ORDER BY depth), ',') AS key FROM r
  UNION ALL SELECT c, 0, 0, '' FROM n),
l AS (SELECT c, max(depth) AS length FROM p GROUP BY c),
v AS (SELECT key, min(p.c) AS conv_id, max(depth) AS depth, count(*) AS n_convs, max(weight) AS weight,
  sha256(coalesce(string_agg(CASE WHEN depth = length THEN CAST(p.c AS VARCHAR) END, ',' ORDER BY p.c), '')) AS ends_sha256 FROM p JOIN l ON l.c = p.c GROUP BY key),
e AS (SELECT v.*, u.key AS above, u.conv_id AS parent_conv_id FROM v LEFT JOIN p x ON x.c = v.conv_id AND x.depth = v.depth - 1 LEFT JOIN v u ON u.key = x.key),
w AS (SELECT e.*, coalesce(k.n, 0) AS n_children FROM e LEFT JOIN (SELECT above, count(*) AS n FROM e GROUP BY above) k ON k.above = e.key),
a AS (SELECT p.key, sum((w.n_convs - 1) * w.weight) AS saved, count(*) FILTER (w.n_children = 0) AS leaves FROM w JOIN p ON p.c = w.conv_id AND p.depth <= w.depth GROUP BY p.key)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM w JOIN a ON a.key = w.key
"""

ORACLES = {
    "op11_prefix_trie": TRIE_SQL,
    "op13_merkle_manifest": MERKLE_SQL,
    "op1_topk_search": TOPK_SQL,
    "op5_substring_dedup": SUBSTRING_SQL,
    "op6_embedding_near_dedup": EMBEDDING_SQL,
    "op7_url_filter": URL_SQL,
}
