"""The registered queries of this package, each a thin use of its operator, and SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm import bpe, decontaminate, embeddings, fillmiddle, lmscore, mixing, negatives, oracle, quality, simhash, substring, suffix, urlfilter, webpage

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    path = path or public_tokenizers.path(VOCABULARY)
    ids = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, drop_text=True)
    both = bpe.decode(ids, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_duplicates(docs, width=4, near=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return lmscore.score(docs, held_out)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_later_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return webpage.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fillmiddle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    restored = fillmiddle.restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(rows, anchors=F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_simhash": op2_simhash,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_suffix_array": op8_suffix_array,
    "op9_html_extraction": op9_html_extraction,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _term(t: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"


_FITS = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in URL_RULES]
_LONGEST = sorted(range(len(URL_RULES)), key=lambda i: -len(URL_RULES[i][1] + URL_RULES[i][2]))

ORACLE_SQL = oracle.ORACLE_SQL | {
    "op3_url_filter": f"""
WITH cut AS (
  SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS u,
         CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, u, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
votes AS (
  SELECT *, ({" OR ".join(_term(t) for t, kind, _ in urlfilter.VOCABULARY if kind == "strict")}) AS hard,
         {" + ".join(f"{_term(t)}::INT" for t, kind, _ in urlfilter.VOCABULARY if kind == "soft")} AS soft,
         {" + ".join(f"{w} * {_term(t)}::INT" for t, kind, w in urlfilter.VOCABULARY if kind == "soft")} AS heavy
  FROM parts)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_FITS[i]} THEN '{URL_RULES[i][1] + URL_RULES[i][2]}'" for i in _LONGEST)} END AS rule,
       CASE {" ".join(f"WHEN {_FITS[i]} THEN '{URL_RULES[i][0]}'" for i in _LONGEST)}
            WHEN hard OR soft >= 2 AND heavy >= {urlfilter.SOFT_NEEDED} THEN 'block' ELSE 'allow' END AS verdict
FROM votes""",
    "op7_mixing": """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, size, -ln((u + 0.5) / 4503599627370496.0) / greatest(w, 0.01) AS k
  FROM (SELECT doc_id, source,
               len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u,
               coalesce(CASE WHEN length(text) > 0 THEN 1 - 0.9::DOUBLE * least(1.0::DOUBLE,
                   10 * (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g'))) / length(text)) ELSE 1.0::DOUBLE END, 1.0::DOUBLE) AS w
        FROM documents)),
sources AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source)),
fill(round, source, source_size, w, full_up, level) AS (
  SELECT 0, source, source_size, w, false, 1.5::DOUBLE * sum(source_size) OVER () / sum(w) OVER () FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, w, up,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) FILTER (up) OVER (), 0)) / nullif(sum(w) FILTER (NOT up) OVER (), 0)
  FROM (SELECT *, full_up OR level * w > 2.0::DOUBLE * source_size AS up, count(*) FILTER (level * w > 2.0::DOUBLE * source_size AND NOT full_up) OVER () AS new FROM fill)
  WHERE new > 0),
targets AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN full_up THEN 2.0::DOUBLE * source_size ELSE least(level * w, 2.0::DOUBLE * source_size) END AS target
  FROM fill WHERE round = (SELECT max(round) FROM fill)),
sampled AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (epochs + CASE WHEN before + size / 2 <= target - epochs * source_size AND epochs < 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sampled""",
}
