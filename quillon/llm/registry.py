"""The opN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import ann, exact_topk, html, jaccard, lexical, line_dedup, lm_score, mixing, packing, pii, substring_dedup, toxicity, trie
from quillon.session import table

SEED = 20


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


#: The same join in SQL: shingle sets, overlaps of pairs that share a shingle, then the smallest id reached.
OP3_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.seen
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(seen)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id, n
"""


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.sample(docs, mixing.words(F.col("text")), seed=SEED)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, coalesce(((doc_id % {mixing.BUCKETS}) + {mixing.BUCKETS}) % {mixing.BUCKETS}, -1), doc_id) AS k FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5e0, 2e0, 1e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight, 2e0 * source_size AS most,
         row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sources
), level AS (
  SELECT *, (1.5e0 * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
            / sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY most / weight, nth) AS fill FROM weighed
), final AS (
  SELECT arg_min(level, fill) AS level FROM level WHERE NOT most <= level * weight
), aims AS (
  SELECT source, source_size, CASE WHEN most <= level.level * weight THEN most ELSE weight * (SELECT level FROM final) END AS target FROM level
), expected AS (
  SELECT doc_id, size, source_size, target, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS e
  FROM ranked JOIN aims ON ranked.source IS NOT DISTINCT FROM aims.source
)
SELECT doc_id, size, source_size, target,
       CAST(floor(e * k + {mixing.offset_of(SEED)!r}) - floor(e * (k - 1) + {mixing.offset_of(SEED)!r}) AS BIGINT) * size AS taken
FROM expected
"""


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

def learnable(doc_id) -> object:
    """Rows that may be learned from: crc32 of the id as text is not divisible by five."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learnable(F.col("doc_id")))
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.crc32(F.col("conv_id").cast("string")) % 4
    return trie.trie(table(spark, sf_dir, "conversations"), F.col("conv_id") - F.col("conv_id") % 20, taken, most=3)


#: Nodes by grouping prefixes; subtrees by joining every member's nodes with those below. crc32 is spelled out bit by bit.
OP11_SQL = """
WITH turns AS MATERIALIZED (
  SELECT conv_id, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 20 AS base, CAST(xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS BIGINT) AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), parts AS (
  SELECT c.conv_id, 0 AS part, pos, k, words FROM convs c JOIN turns t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, k, words FROM convs JOIN turns USING (conv_id) WHERE pos > h
), seq AS (
  SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM parts
), paths AS MATERIALIZED (
  SELECT conv_id, d, sha256(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)) AS path, words FROM seq
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), steps AS MATERIALIZED (
  SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS above, max(d) OVER (PARTITION BY conv_id) AS length FROM paths
), nodes AS MATERIALIZED (
  SELECT d, path, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n, min(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = d), '')) AS ends
  FROM steps GROUP BY d, path
), kids AS (
  SELECT d, above AS path, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY d, above
), below AS (
  SELECT DISTINCT a.d, a.path, b.d AS d2, b.path AS path2 FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.d >= a.d
), sums AS (
  SELECT below.d, below.path, count(*) FILTER (WHERE kids.path IS NULL) AS leaves, CAST(sum((nodes.n - 1) * nodes.words) AS BIGINT) AS saved
  FROM below JOIN nodes ON nodes.d = d2 AND nodes.path = path2 LEFT JOIN kids ON kids.d = d2 + 1 AND kids.path = path2 GROUP BY ALL
)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, x.ends AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.d = x.d - 1 AND p.path = x.above LEFT JOIN kids ON kids.d = x.d + 1 AND kids.path = x.path JOIN sums ON sums.d = x.d AND sums.path = x.path
"""


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), q AS MATERIALIZED (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), stats AS (
  SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0
), tf AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, stats GROUP BY term, n_docs
), scores AS (
  SELECT item, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), stats GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


_QUERIES = {"op1_packing": op1_packing, "op2_ann": op2_ann, "op3_jaccard_join": op3_jaccard_join, "op4_html": op4_html, "op5_line_dedup": op5_line_dedup, "op6_lm_score": op6_lm_score, "op7_substring_dedup": op7_substring_dedup, "op8_mixing": op8_mixing, "op9_toxicity": op9_toxicity, "op10_exact_topk": op10_exact_topk, "op11_prefix_trie": op11_prefix_trie, "op12_pii": op12_pii, "op13_lexical": op13_lexical}
_SQL = {"op3_jaccard_join": OP3_SQL, "op8_mixing": OP8_SQL, "op10_exact_topk": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_lexical": OP13_SQL}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
