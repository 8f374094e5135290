"""Registered queries ``opN_<name>`` and their oracle SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.llm import bpe, exact_dedup, fingerprint, line_dedup, lm, merkle, minhash, mixing, secrets, sharding, topk, toxicity, trie
from rowtide.llm.common import held_out, read_table

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the vocabulary file of a public tokenizer lies."""
    return public_tokenizers.path(name)


def op1_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to shares of the square root of their source's bytes, as many bytes as there are."""
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(read_table(spark, sf_dir, "documents"), 8)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _with_ranges(found: DataFrame) -> DataFrame:
    ranges = F.transform("removed", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["stop"].cast("string")))
    return found.select("doc_id", "text", "n_lines", F.array_join(ranges, ",").alias("removed"))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_ranges(line_dedup.dedup_lines(read_table(spark, sf_dir, "documents")))


def op4_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op4_line_chunks``, for every shared passage of two lines or more."""
    return _with_ranges(line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), pairs=True))


def op5_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), bpe.read_vocabulary(vocabulary_path()))


def op6_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup.new_index(spark).ingest(read_table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(read_table(spark, sf_dir, "documents"))


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(0))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id", held_out(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("passages")
    )


def op9_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_texts(read_table(spark, sf_dir, "documents"), ~held_out(1))
    return scored.select("doc_id", held_out(1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", "offset", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")


def op11_pivot_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_veb_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document, by crc32 of its id, is shown with its text in lower case."""
    docs = read_table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    proven = merkle.manifest(docs, tampered=F.when(chosen, F.translate("text", letters, letters.lower())))
    digests = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return proven.select(
        "doc_id", *digests, merkle.proof_digest(F.col("proof")).alias("proof_sha256"), F.lower(F.hex("folded_root")).alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_parentheses_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    shared = F.crc32(conv_id.cast("string").cast("binary")) % 6
    return trie.trie(read_table(spark, sf_dir, "conversations"), shared, conv_id - conv_id % 100)


QUERIES = {f.__name__: f for f in (
    op1_chosen_path, op2_poisson_mix, op3_hilbert_shards, op4_line_chunks, op4_line_passages, op5_backtracking_bpe,
    op6_digest_index, op7_scaled_sketch, op8_toxic_segments, op9_backoff_automaton, op10_secret_forest, op11_pivot_distance,
    op12_veb_merkle, op13_parentheses_trie,
)}



def _crc32(column: str) -> str:
    """SQL for crc32 of a number written in decimals."""
    codes = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bit = "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"lambda a, c: list_reduce(list_concat([xor(a, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), {byte}), 4294967295)"


ORACLES = {
    "op2_poisson_mix": """
WITH sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0)) AS size FROM documents GROUP BY source HAVING sum(coalesce(strlen(text), 0)) > 0),
rates AS (
  SELECT source, pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM sizes) * ((SELECT sum(size) FROM sizes) / size) AS rate
  FROM sizes),
cdf AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
  FROM rates, range(0, 400) AS t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    ('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
counted AS (
  SELECT r, doc_id, d.source, count(*) AS copies FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.p <= d.u
  GROUP BY ALL),
copied AS (SELECT doc_id, source, copies, unnest(range(1, copies + 1)) AS copy FROM counted)
SELECT doc_id, source, CAST(copies AS INTEGER) AS copies, CAST(copy AS INTEGER) AS copy,
  row_number() OVER (ORDER BY md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy), doc_id, copy, source) - 1 AS position
FROM copied""",
    "op4_line_chunks": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, text, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
e AS (SELECT *, (h + 3 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4 = 0
  AS ends FROM h),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
g AS (SELECT doc_id, chunk, min(i) AS start, max(i) + 1 AS stop, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, chunk),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS n FROM g
  WHERE stop - start >= 2 AND regexp_matches(body, '[\\pL\\pN]')),
gone AS (SELECT doc_id, start, stop FROM r WHERE n > 1),
per_doc AS (SELECT doc_id, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed FROM gone GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l
  LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i >= g.start AND l.i < g.stop WHERE g.doc_id IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
  CAST(coalesce(len(d.lines), 0) AS INTEGER) AS n_lines, coalesce(p.removed, '') AS removed
FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN per_doc p USING (doc_id)""",
    "op6_digest_index": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_pivot_distance": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score, b.r AS found
  FROM v a JOIN v b ON a.r <> b.r AND a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, found) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 20""",
    "op12_veb_merkle": """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS other FROM f),
d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER () AS r FROM l),
low_nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM d
  UNION ALL
  SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM low_nodes WHERE n > 1
  GROUP BY lang, level, i // 8, n),
subroots AS (
  SELECT lang, h, level AS levels, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low_nodes WHERE n = 1),
top_nodes AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top_nodes WHERE n > 1 GROUP BY level, i // 8, n),
paths AS (
  SELECT d.r, d.lang, t.level AS step, t.level, d.i // CAST(pow(8, t.level) AS BIGINT) AS i, 0 AS part FROM d
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang, range(0, 20) AS t(level) WHERE t.level < s.levels
  UNION ALL
  SELECT d.r, d.lang, s.levels + t.level, t.level, s.i // CAST(pow(8, t.level) AS BIGINT), 1 FROM d
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang, range(0, 20) AS t(level)
  WHERE t.level < (SELECT max(level) FROM top_nodes)),
runs AS (
  SELECT p.r, p.step, p.i,
    coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < p.i), '') AS before,
    coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > p.i), '') AS after
  FROM paths p JOIN (
    SELECT 0 AS part, lang, level, i, h FROM low_nodes UNION ALL SELECT 1, NULL, level, i, h FROM top_nodes) n
  ON n.part = p.part AND n.level = p.level AND n.i // 8 = p.i // 8 AND (p.part = 1 OR n.lang IS NOT DISTINCT FROM p.lang)
  GROUP BY p.r, p.step, p.i),
folds AS (
  SELECT r, 0 AS step, CASE WHEN """ + _crc32("doc_id") + """ % 3 = 0 THEN other ELSE leaf END AS h FROM d
  UNION ALL
  SELECT f.r, f.step + 1, sha256(u.before || f.h || u.after) FROM folds f JOIN runs u ON u.r = f.r AND u.step = f.step),
last AS (SELECT r, arg_max(h, step) AS h FROM folds GROUP BY r),
proofs AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY step)) AS p FROM runs GROUP BY r)
SELECT d.doc_id, d.leaf, s.h AS subroot, t.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, k.h AS folded_root, k.h = t.h AS verified
FROM d JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang JOIN (SELECT h FROM top_nodes WHERE n = 1) t ON true
JOIN last k USING (r) LEFT JOIN proofs p USING (r)""",
    "op13_parentheses_trie": """
WITH t AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS i FROM t),
c AS (SELECT conv_id, """ + _crc32("conv_id") + """ % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, o.i, o.d, o.w FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.i < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.i, o.d, o.w FROM c JOIN o USING (conv_id) WHERE o.i >= c.h),
p AS (
  SELECT conv_id, row_number() OVER g AS depth, list(d) OVER g AS path, w FROM r WINDOW g AS (PARTITION BY conv_id ORDER BY part, i)
  UNION ALL
  SELECT conv_id, 0, [], 0 FROM c),
l AS (SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id),
n AS (
  SELECT path, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS own,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (depth = last), '')) AS ends
  FROM p JOIN l USING (conv_id) GROUP BY path, depth),
k AS (SELECT a.path, count(b.path) AS n_children FROM n a LEFT JOIN n b ON b.depth = a.depth + 1 AND b.path[:a.depth] = a.path GROUP BY a.path),
u AS (
  SELECT a.path, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(b.own) AS saved
  FROM (SELECT n.*, unnest(range(0, depth + 1)) AS up FROM n) b JOIN k ON k.path = b.path JOIN n a ON a.depth = b.up AND a.path = b.path[:b.up]
  GROUP BY a.path)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, k.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN k USING (path) JOIN u USING (path) LEFT JOIN n q ON q.depth = n.depth - 1 AND q.path = n.path[:n.depth - 1]""",
}
