"""The registered queries of this subpackage and their DuckDB SQL.

Each query applies its operator with production parameters to its whole
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regsight.llm import (chat_format, decontaminate, exact_dedup, fill_middle, filter_audit, language_id,
                          license_scan, lm_score, mixing, near_dedup, pii_scan, secret_scan, sharding)
from regsight.llm.ship import ship_package
from regsight.session import ensure_checkpoint_dir

SHARD_LIMIT = 4 << 20
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def prepare(spark: SparkSession) -> None:
    """What every query needs of a session: the shared folder and the package on its workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the identifier as text modulo ``folds``; null for a null identifier."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def held_out(folds: int) -> Column:
    return F.coalesce(fold("doc_id", folds) == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out(4)))
    out = language_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score", "distance", "rejected")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                           keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.drop("secrets")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARD_LIMIT, keep=["doc_id"])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_calls(chat_format.events(table(spark, sf_dir, "conversations")),
                                    chat_format.CONVERSATION_TOOLS, further=True)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan_licenses(docs, license_scan.fit(docs), keep=["doc_id"])


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score_texts(table(spark, sf_dir, "documents"), ~held_out(7), VOCABULARY, keep=["doc_id"])
    return out.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                      "score")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_scan.scan_personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.drop("entities")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_secret_scan, op4_sharding, op5_mixing,
                                   op6_exact_dedup, op7_chat_format, op8_near_dedup, op9_license_scan,
                                   op10_lm_score, op11_fill_middle, op12_pii_scan, op13_filter_audit)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op2_decontaminate": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + r""",
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + r""",
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS s, least(len(w), 10) AS n
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS s
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.r, g.k, p.n, p.item_id FROM g JOIN p ON g.s = p.s AND g.n = p.n),
cover AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)""",
    "op4_sharding": """
WITH h AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 10)
                       AS BIGINT) AS h FROM documents),
l AS (SELECT depth, h >> (40 - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes,
             count(*) AS shard_rows FROM h, (SELECT unnest(range(0, 41)) AS depth) GROUP BY 1, 2),
f AS (SELECT *, shard_bytes <= """ + str(SHARD_LIMIT) + """ OR shard_rows = 1 AS fits FROM l),
s AS (SELECT f.* FROM f LEFT JOIN f p ON p.depth = f.depth - 1 AND p.prefix = f.prefix >> 1
      WHERE f.fits AND NOT coalesce(p.fits, false))
SELECT doc_id, CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(depth AS INTEGER) AS depth, n_bytes, shard_bytes, shard_rows
FROM h JOIN s ON s.prefix = h.h >> (40 - s.depth)""",
    "op6_exact_dedup": """
WITH n AS (SELECT doc_id, """ + _LOWER.format("coalesce(text, '')") + """ AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n""",
    "op11_fill_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
             CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
             CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS g, max(CAST(toxic = 1 AS INTEGER)) AS x
      FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(coalesce(g, 0) AS BIGINT) AS g, CAST(coalesce(x, 0) AS BIGINT) AS x,
             (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
              || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
              || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
              || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
              || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(g) AS g, sum(x) AS x FROM f GROUP BY ALL),
e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS e),
o AS (SELECT a.e || b.e || c.e || d.e || k.e AS filter_order FROM e a, e b, e c, e d, e k
      WHERE len(list_distinct([a.e, b.e, c.e, d.e, k.e])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
             substr(filter_order, 1, step - 1) AS earlier
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
j AS (SELECT c.*, s.*, contains(fails, letter) AS bad,
             translate(fails, earlier, '') <> fails AS gone FROM c, s),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
             CAST(sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN NOT gone AND bad THEN g ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN NOT gone AND bad THEN x ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM j GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r""",
}
