"""The thirteen operators and the pipeline as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.llm import chat_format, collocations, html_extract, language_id, lm_scoring, media_gif, mixing, near_dedup, packing, quality_forest, role_repair, substring_dedup, token_output
from voxelry.llm.shared import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.conversations(rows))


def op7_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_gif.digests(media_gif.media_column(table(spark, sf_dir, "documents")))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.report(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 on pages: markup language, address suffix and host beside the text."""
    pages = table(spark, sf_dir, "pages")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1)
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    rows = pages.select("page_id", body.alias("text"), declared.alias("declared"), language_id.host_of(F.col("url")).alias("host"))
    return language_id.language_id(rows, "text", "declared", "host", "page_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_output, op2_lm_scoring, op3_language_id, op4_near_dedup, op5_mixing, op6_chat_format, op7_media_gif, op8_html_extract, op9_packing, op10_quality_forest, op11_role_repair, op12_collocations, op13_substring_dedup, page_language, pipeline)}

SQL = {
    "op4_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, b AS r FROM ways UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.r),
best AS (SELECT id, min(r) AS r FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(b.r, d.doc_id)) AS component_id, d.doc_id <= coalesce(b.r, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN best b ON b.id = d.doc_id
""",
    "op5_mixing": r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS key FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS s FROM rows GROUP BY source),
weighed AS (SELECT source, s, s * 2.0::DOUBLE AS ceiling, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM sizes),
levels AS (
  SELECT *, ceiling / w AS ratio, (sum(s) OVER () * 1.5::DOUBLE - coalesce(sum(ceiling) OVER (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), one AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
targets AS (SELECT source, s, least(ceiling, one.level * w) AS target, CASE WHEN s > 0 THEN floor(least(ceiling, one.level * w) / s) ELSE 0 END AS whole FROM levels, one),
ordered AS (
  SELECT r.*, t.s, t.target, t.whole, t.target - t.whole * t.s AS rest,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key) AS upto, sum(r.size) OVER (PARTITION BY r.source, r.key) AS own
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, s AS source_size, target,
  (size * least(2, whole + CASE WHEN rest > 0 AND (upto <= rest OR upto - own <= rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
""",
    "op6_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(13 + length(regexp_replace(role || text, '([\\<\[|])', '\1\\', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), sums AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM pieces, range(1, 5) t(k))
  GROUP BY lang, k, g HAVING count(*) >= 30
), phrases AS (SELECT *, string_split(g, ' ') AS w FROM grams WHERE k > 1),
held AS (
  SELECT lang, g, max(f) AS longer FROM (SELECT lang, f, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g FROM phrases, range(2, 4) t(m) WHERE m < k)
  GROUP BY lang, g
), cuts AS (
  SELECT p.lang, p.g, p.f AS a, x.f AS l, y.f AS r, m, (2000000::HUGEINT * p.f) // (x.f + y.f) AS score
  FROM (SELECT *, array_to_string(w[1:m], ' ') AS front, array_to_string(w[m + 1:], ' ') AS rest FROM phrases, range(1, 4) t(m) WHERE m < k) p
  JOIN grams x ON x.lang = p.lang AND x.g = p.front JOIN grams y ON y.lang = p.lang AND y.g = p.rest
  LEFT JOIN held h ON h.lang = p.lang AND h.g = p.g WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < 80::HUGEINT * p.f
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, m) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, s.n, score::BIGINT AS score
FROM best b JOIN sums s ON s.lang = b.lang QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, g) <= 2000
""",
    "op13_substring_dedup": r"""
WITH texts AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
spans AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM spans) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM again),
kept AS (
  SELECT t.doc_id, count(*) AS n, string_agg(t.word, ' ' ORDER BY t.j) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM texts) t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.j = t.j GROUP BY t.doc_id
)
SELECT x.doc_id, len(x.w)::BIGINT AS n_words, (len(x.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts x LEFT JOIN kept k ON k.doc_id = x.doc_id
""",
}
