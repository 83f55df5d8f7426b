"""The registered queries of this subpackage, ``op<N>_<name>`` and ``pipeline``, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    centroid_clustering,
    decontaminate,
    html_extract,
    language_id,
    line_dedup,
    minhash_dedup,
    quality_classifier,
    quality_rules,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Documents that language identification never learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_run=3, min_words=None)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"), window=50, keep_text=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~held_out())
    return language_id.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), keep_bytes=False)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_html_extract": op10_html_extract,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": pipeline,
}

#: Lines without white space at their ends; the windows of three; where each occurs first.
_OP1 = """
WITH lines AS (
  SELECT doc_id, i AS no, list_extract(l, i) AS line, trim(list_extract(l, i), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare, len(l) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS p FROM lines WHERE bare <> ''
), windows AS (
  SELECT a.doc_id, a.p, a.bare AS x, b.bare AS y, c.bare AS z
  FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.p = a.p + 1 JOIN full_lines c ON a.doc_id = c.doc_id AND c.p = a.p + 2
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, p) AS nth FROM windows) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, p + k AS p FROM later, (SELECT unnest([0, 1, 2]) AS k)
), kept AS (
  SELECT l.doc_id, l.no, l.line, g.p IS NOT NULL AS removed
  FROM lines l LEFT JOIN full_lines f ON l.doc_id = f.doc_id AND l.no = f.no LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(removed::INT)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

_OP2 = """
WITH shingled AS (
  SELECT kind, id, list_aggregate(w[i : i + k - 1], 'string_agg', ' ') AS s, k
  FROM (
    SELECT kind, id, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM (
      SELECT kind, id, w, CASE WHEN kind = 'item' THEN least(len(w), 5) ELSE 5 END AS k
      FROM (
        SELECT kind, id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
        FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark)
      )
    ) WHERE len(w) >= k AND k > 0
  )
), sets AS (SELECT DISTINCT kind, id, s FROM shingled),
sizes AS (SELECT id, count(*) AS n FROM sets WHERE kind = 'item' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(z.n)::BIGINT AS n_item, count(*)::BIGINT AS n_shared
FROM sets i JOIN sets d ON i.s = d.s AND d.kind = 'doc' JOIN sizes z ON z.id = i.id
WHERE i.kind = 'item' GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * any_value(z.n)
"""



def _usable(scale: int) -> str:
    """CTE kept: vectors of finite components as whole numbers."""
    return f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def _lloyd(rounds: int, number: int, width: int) -> str:
    """CTEs near0, mean1, near1, ... of rows(vec_id, p, v) and mean0(p, c, m), separately for each p."""
    far = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT"
    out = []
    for i in range(rounds + 1):
        # The least distance and, of equal ones, the least number.
        out.append(f"near{i} AS MATERIALIZED (SELECT vec_id, p, v, min({far} * {number} + c) AS b FROM rows JOIN mean{i} USING (p) GROUP BY ALL)")
        if i < rounds:
            out.append(f"""mean{i + 1} AS MATERIALIZED (SELECT o.p, o.c, coalesce(n.m, o.m) AS m FROM mean{i} o LEFT JOIN (
  SELECT p, c, list(x ORDER BY i) AS m FROM (SELECT p, b % {number} AS c, i, floor(sum(x) / count(*))::BIGINT AS x FROM (SELECT p, b, unnest(range({width})) AS i, unnest(v) AS x FROM near{i}) GROUP BY ALL) GROUP BY ALL) n USING (p, c))""")
    return ",\n".join(out)


_OP11 = f"""
WITH {_usable(64)},
rows AS MATERIALIZED (SELECT vec_id, 0 AS p, v FROM kept WHERE len(v) = 64),
mean0 AS MATERIALIZED (SELECT 0 AS p, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS m FROM rows ORDER BY sha256('1:' || vec_id) LIMIT 16),
{_lloyd(3, 16, 64)},
said AS (SELECT c, sha256(array_to_string(m, ',')) AS h FROM mean3),
told AS (SELECT vec_id, b % 16 AS c, b // 16 AS distance FROM near3)
SELECT vec_id, told.c::INT AS cluster, distance, sum(distance) OVER (PARTITION BY told.c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, h AS centroid_sha256
FROM told JOIN said ON told.c = said.c
"""

#: Bytes as pairs of hexadecimal digits; windows of 200 that occur twice; what they cover, run by run.
_OP12 = """
WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS MATERIALIZED (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS m FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM rows)),
hits AS (SELECT r, i FROM windows SEMI JOIN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1) USING (m)),
runs AS (SELECT r, min(i) AS b, max(i) + 200 AS e FROM (
  SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (
    SELECT r, i, (i - lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) > 200)::INT AS new FROM hits)) GROUP BY r, g),
rest AS (SELECT r, count(*) AS n_spans, sum(e - b)::BIGINT AS n_removed, max(e) AS e, string_agg(substr(x, 2 * l + 1, 2 * (b - l)), '' ORDER BY b) AS x
  FROM (SELECT *, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY b) AS l FROM runs) JOIN rows USING (r) GROUP BY r)
SELECT doc_id, len(o.x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t.x || substr(o.x, 2 * e + 1), o.x))) AS kept_sha256
FROM rows o LEFT JOIN rest t USING (r)
"""

_OP13 = f"""
WITH {_usable(256)},
rows AS MATERIALIZED (SELECT vec_id, p, v[p * 4 + 1 : p * 4 + 4] AS v FROM kept, (SELECT unnest(range(16)) AS p)),
first64 AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM kept ORDER BY vec_id LIMIT 64),
mean0 AS MATERIALIZED (SELECT p, c, v AS m FROM rows JOIN first64 USING (vec_id)),
{_lloyd(2, 64, 4)},
said AS (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, c)) AS h FROM mean2),
told AS (SELECT vec_id, string_agg(format('{{:02x}}', b % 64), '' ORDER BY p) AS code, sum(b // 64)::BIGINT AS error FROM near2 GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM told JOIN kept USING (vec_id), said
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": _OP1, "op2_decontaminate": _OP2, "op11_centroid_clustering": _OP11, "op12_suffix_dedup": _OP12, "op13_vector_codes": _OP13}
