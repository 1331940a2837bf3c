"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.llm import (
    alignment,
    chat,
    collocations,
    exact_dedup,
    fingerprints,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    quality,
    secret_scan,
    spans,
    unigram,
)
from reviewflow.llm.common import documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(documents(spark, sf_dir))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(documents(spark, sf_dir), size=4, percent=85)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2.0)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir)).drop("packed", "edited_packed")


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    masks = F.zip_with("mask_starts", "mask_ends", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string")))
    return rows.select(
        "conv_id", "speaker", F.col("n_turns").cast("long").alias("n_turns"), "text",
        F.array_join(masks, ",").alias("masks"), F.col("trained_chars").cast("long").alias("trained_chars"),
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = list(pii.KINDS)
    found = pii.find(documents(spark, sf_dir))
    return found.select(
        "doc_id", *[F.size(spans.of_kind("base", k)).cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(spans.listed(F.col("base"), kinds), 256).alias("base_sha256"),
        spans.listed(F.concat("base", "added"), kinds).alias("spans"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, kinds = [r.kind for r in secret_scan.BASE], [r.kind for r in secret_scan.RULES]
    found = secret_scan.scan(documents(spark, sf_dir))
    of_base = F.filter("findings", lambda f: f["kind"].isin(base))
    return found.select(
        "doc_id", *[F.size(spans.of_kind("findings", k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(spans.listed(of_base, kinds), 256).alias("base_sha256"), spans.listed(F.col("findings"), kinds).alias("spans"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), least=100, best=2000)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_texts(documents(spark, sf_dir))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: value for name, value in globals().items() if name.startswith("op") and callable(value)}
    return dict(sorted(found.items(), key=lambda item: int(item[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_chat_perspectives": OP5_SQL, "op10_exact_dedup": OP10_SQL,
            "op11_collocations": OP11_SQL}


OP1_SQL = rf"""
WITH lines AS (
  SELECT doc_id, coalesce('s' || source, '-') AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM lines),
common AS (
  SELECT k, min((doc_id, no)) AS first FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}),
marked AS (SELECT doc_id, no, line, coalesce((doc_id, no) <> first, false) AS gone FROM keyed LEFT JOIN common USING (k)),
cleaned AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines,
    count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, c.text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""

OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '<\|') AS text,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS own
  FROM conversations),
p AS (SELECT DISTINCT conv_id, own, role AS speaker FROM t WHERE role <> 'system'),
s AS (
  SELECT p.conv_id, p.own, p.speaker, coalesce(role = speaker, false) AS trained,
    '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' WHEN role IS NULL THEN 'user'
      ELSE 'user name=' || replace(role, '<|', '<\|') END || chr(10) AS head,
    text || '<|im_end|>' AS body,
    row_number() OVER (PARTITION BY p.conv_id, p.own, p.speaker ORDER BY turn NULLS LAST, role NULLS LAST, text) AS no
  FROM p JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.own = t.own),
o AS (
  SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, own, speaker ORDER BY no) AS BIGINT) - 1 AS stop
  FROM s)
SELECT conv_id, speaker, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY no) AS text,
  string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY no) FILTER (WHERE trained) AS masks,
  CAST(sum(length(body)) FILTER (WHERE trained) AS BIGINT) AS trained_chars
FROM o GROUP BY conv_id, own, speaker
"""

OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""

OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
runs AS (SELECT lang, w[i:i + size - 1] AS p FROM starts, range(1, {collocations.DEPTH + 1}) s(size) WHERE i + size - 1 <= len(w)),
counts AS (SELECT lang, p, count(*) AS f FROM runs GROUP BY lang, p HAVING count(*) >= 100),
cuts AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM counts WHERE len(p) > 1),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, l.f AS l, r.f AS r, n,
    CAST(1000 * c.a::HUGEINT * n::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT) AS BIGINT) AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN counts l ON l.lang = c.lang AND l.p = c.p[:c.k] JOIN counts r ON r.lang = c.lang AND r.p = c.p[c.k + 1:]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (SELECT lang, f, p AS long, unnest(range(1, len(p) + 1)) AS i FROM counts WHERE len(p) > 2),
inside AS (
  SELECT DISTINCT s.lang, s.p FROM longer b, range(2, {collocations.DEPTH}) z(size), counts s
  WHERE size < len(long) AND i + size - 1 <= len(long) AND s.lang = b.lang AND s.p = long[i:i + size - 1] AND 100 * b.f >= 100 * s.f),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM lowest ANTI JOIN inside USING (lang, p))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
