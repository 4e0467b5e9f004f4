"""The queries of this subpackage's operators with their production parameters, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockgrain.llm import bpe, fertility, langid, line_dedup, minhash, packing, pii, pivot_join, toxicity, url_filter
from lockgrain.llm.common import prepare, read, staged


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = fertility.measure(docs, vocabulary("piece_bpe_32k.model"), keep_text=False)
    return out.select("doc_id", *fertility.FIELDS, "base_failed", "kept", "chars_per_token", "byte_share", "token_entropy")


def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivot_join.near_duplicates(read(spark, sf_dir, "embeddings"), 0.93)
    return found.select("vec_id", "n_links", "component_id", "kept")


def packed(docs: DataFrame) -> DataFrame:
    cut = packing.pieces(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), pattern())
    cut = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(staged(cut, "pieces"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern(), keep_text=False)
    digest = F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256)
    ids = ids.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "token_ids")
    return bpe.decode(ids, path, pattern(), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def severity_labels(labels: DataFrame) -> DataFrame:
    """Grades of the labelled documents: 0 clean, 1 toxic, 2 toxic and of low quality as well."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, 1 + (F.coalesce("quality", F.lit(1)) == 0).cast("int"))
    return labels.select("doc_id", grade.alias("grade"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, severity_labels(read(spark, sf_dir, "labels")))
    return toxicity.grade(docs, model, keep_text=False)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)))
    model = langid.fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model, keep_text=False)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.joined(F.col("base_spans")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "n_lines", "n_dropped", F.concat_ws(",", F.col("dropped_lines").cast("array<string>")).alias("dropped_lines"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=4, threshold_percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_embedding_links": op2_embedding_links,
    "op3_packing": op3_packing,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_language": op7_language,
    "op8_pii": op8_pii,
    "op9_line_dedup": op9_line_dedup,
    "op10_minhash": op10_minhash,
}

#: Components by repeated minimum over links ("link": a, b, both directions) of all nodes ("node": id).
_REACH = """
reach(id, seen) AS (
  SELECT id, id FROM node
  UNION
  SELECT l.b, r.seen FROM reach r JOIN link l ON l.a = r.id
), least AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)"""

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_links": f"""
WITH RECURSIVE usable AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT p.id AS a, q.id AS b FROM usable p JOIN usable q ON p.label = q.label AND p.id <> q.id
  WHERE list_cosine_similarity(p.v, q.v) >= 0.93
), node AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT n.id AS vec_id, (SELECT count(*) FROM link WHERE a = n.id) AS n_links, c.component_id, n.id = c.component_id AS kept
FROM node n JOIN least c ON c.id = n.id""",
    "op9_line_dedup": f"""
WITH RECURSIVE line AS (
  SELECT doc_id, i - 1 AS line_no, trim(lower(raw), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS norm
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), one AS (
  SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, * FROM (SELECT norm, min(doc_id) AS doc_id, arg_min(line_no, (doc_id, line_no)) AS line_no FROM line WHERE length(norm) >= 20 GROUP BY norm)
), node AS (SELECT id FROM one), near AS (
  SELECT p.id AS a, q.id AS b FROM one p JOIN one q ON length(q.norm) IN (length(p.norm), length(p.norm) + 1, length(p.norm) + 2) AND p.id <> q.id
  WHERE levenshtein(p.norm, q.norm) <= 2
), link AS (SELECT a, b FROM near UNION SELECT b, a FROM near), {_REACH}
, head AS (SELECT o.norm, h.doc_id, h.line_no FROM one o JOIN least c ON c.id = o.id JOIN one h ON h.id = c.component_id)
, gone AS (SELECT l.doc_id, l.line_no FROM line l JOIN head h ON h.norm = l.norm WHERE (h.doc_id, h.line_no) <> (l.doc_id, l.line_no))
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_dropped,
  coalesce((SELECT string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FROM gone g WHERE g.doc_id = d.doc_id), '') AS dropped_lines
FROM documents d""",
    "op10_minhash": f"""
WITH RECURSIVE word AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), node AS (SELECT id FROM word), made AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM word
), one AS (SELECT id, unnest(s) AS x FROM made), common AS (
  SELECT p.id AS a, q.id AS b, count(*) AS n FROM one p JOIN one q ON p.x = q.x AND p.id <> q.id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN made m ON m.id = a JOIN made o ON o.id = b
  WHERE 100 * n >= 80 * (len(m.s) + len(o.s) - n)
), {_REACH}
SELECT m.id AS doc_id, CAST(len(m.s) AS BIGINT) AS n_shingles, c.component_id, m.id = c.component_id AS kept
FROM made m JOIN least c ON c.id = m.id""",
}
