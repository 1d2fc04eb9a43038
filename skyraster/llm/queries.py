"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.llm import decontaminate, html_main, jaccard_join, language, lexical_search, mixing, pii, quality_model, quality_rules, repeats, token_counts, tokenfile, whitening
from skyraster.llm.common import table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.maintain(table(spark, sf_dir, "documents"), tokenizer_path(), "word_bpe_49k")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_pii": op5_pii,
    "op6_mix": op6_mix,
    "op7_quality_model": op7_quality_model,
    "op8_token_files": op8_token_files,
    "op9_token_counts": op9_token_counts,
    "op10_language": op10_language,
    "op11_whitening": op11_whitening,
    "op12_repeats": op12_repeats,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op5_pii": pii.ORACLE,
    "op6_mix": mixing.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}

ORACLES["op2_decontaminate"] = r"""
WITH dw AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
iw AS (
  SELECT cast(item_id AS varchar) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
hits AS (
  SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos
  JOIN win ON win.n = pos.n AND win.p = array_to_string(pos.w[pos.i:pos.i + pos.n - 1], ' ')),
hit_words AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits)),
words AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY 1),
place AS (
  SELECT doc_id, k, sum(length(w[k])) OVER o + sum(length(g[k])) OVER o AS e, length(w[k]) AS size FROM (
    SELECT doc_id, w, string_split_regex(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS g, unnest(range(1, len(w) + 1)) AS k FROM dw WHERE doc_id IN (SELECT doc_id FROM words))
  WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
runs AS (
  SELECT doc_id, min(e - size) AS s, max(e) AS e FROM (SELECT doc_id, e, size, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM place JOIN hit_words USING (doc_id, k))
  GROUP BY doc_id, run),
spans AS (SELECT doc_id, string_agg(s::bigint || ':' || e::bigint, ',' ORDER BY s) AS spans FROM runs GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(coalesce(words.n_hit, 0) AS bigint) AS n_hit,
  cast(coalesce(items.n_items, 0) AS bigint) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
  coalesce(words.n_hit, 0) > 0 AS contaminated, coalesce(spans.spans, '') AS spans
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
