"""The queries of this subpackage, as __spark_entry__ registers them, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import decontaminate, language, mixing, near_dups, pii, quality, secrets, substrings, token_counts, toxicity
from quillmesh.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_mixing, op4_substring_dedup, op5_pii, op6_toxicity, op7_quality_rules, op8_near_dups, op9_language_id, op10_secret_scans)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
    WITH dw AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w FROM documents),
    iw AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w FROM benchmark),
    ip AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM iw WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM ip), ks AS (SELECT DISTINCT k FROM win),
    dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, ks WHERE len(w) >= k),
    m AS (SELECT DISTINCT doc_id, item_id, p, dp.k FROM dp JOIN win ON win.k = dp.k AND win.s = array_to_string(w[p:p + dp.k - 1], ' ')),
    q AS (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m), hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM q GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
    SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id"""

_OP8 = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x{{20}}\x{{09}}-\x{{0D}}]+') AS w FROM documents),
    sp AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0), sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 3], ' ')) AS s FROM sp),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(low.b, w.doc_id)) AS kept
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.a = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others learn a model, draw at random or encode with a tokenizer, which SQL can't express."""
    return {"op2_decontamination": _OP2, "op8_near_dups": _OP8}
