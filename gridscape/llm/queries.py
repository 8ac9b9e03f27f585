"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscape.llm import chat, debruijn, linededup, mil, mixing, packing, simhash, sketch, tokencount, vafile
from gridscape.llm.common import table


def op1_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vafile.scaled(table(spark, sf_dir, "embeddings"), 64)
    return vafile.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.with_successors(table(spark, sf_dir, "documents"))


def byte_vocabulary() -> packing.Vocabulary:
    return packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_vocabulary())


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mil.scored(docs, mil.train(docs, table(spark, sf_dir, "labels")))


def op5_de_bruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.repeats_removed(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.segments(turns.unionByName(own)))


def op7_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.ordered(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op9_simhash_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) > 1 AS again FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE again),
x AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT x.doc_id, string_agg(v, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept, count(c.i) AS n_removed FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, row_number() OVER w AS k, lag(role, 1, 'START') OVER w AS before, lead(role) OVER w IS NULL AS last,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
      ELSE 24 + length(role) + len(regexp_extract_all(role, '\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|role\|>|<\|text\|>|<\|end\|>')) END
    + length(text) + len(regexp_extract_all(text, '\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|role\|>|<\|text\|>|<\|end\|>')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and((before, role) IN (('START', 'system'), ('START', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AND (NOT last OR role = 'assistant')) AS valid
FROM o GROUP BY conv_id
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS site FROM documents),
l AS (SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM d WHERE text <> ''),
t AS (SELECT *, trim(line, ' ') AS bare FROM l),
b AS (SELECT bare, min((doc_id, nr)) AS first FROM t WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 10),
k AS (SELECT t.doc_id, t.nr, t.line, b.bare IS NULL OR b.first = (t.doc_id, t.nr) AS kept FROM t LEFT JOIN b USING (bare)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE kept), '') AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.text, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, k % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS weights
      FROM w WINDOW p AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CAST(cap AS HUGEINT) * weights < rest * weight AS capped FROM f),
e AS (SELECT min_by(rest, (cap / weight, k)) AS rest, min_by(weights, (cap / weight, k)) AS weights FROM g WHERE NOT capped),
t AS (SELECT d.doc_id, d.size, CAST(sum(d.size) OVER o - d.size AS BIGINT) AS ahead, g.source_size, CAST(CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE -0.5 END AS DOUBLE) AS slope,
    CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * e.rest AS DOUBLE) / CAST(e.weights AS DOUBLE) END AS target
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source CROSS JOIN e
  WINDOW o AS (PARTITION BY d.source ORDER BY md5('8:' || d.doc_id), d.size ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size * size
    + CASE WHEN 2 * ahead + size <= 2 * (CAST(floor(target) AS BIGINT) % source_size) THEN size ELSE 0 END END AS taken,
    CASE WHEN target > 0 THEN least(1.0::DOUBLE, CAST(ahead AS DOUBLE) / target) ELSE 0 END AS u FROM t)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN u ELSE (sqrt(greatest(0.0::DOUBLE, (1 - slope) * (1 - slope) + 4 * slope * u)) - (1 - slope)) / (2 * slope) END END AS position FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_va_file_top_k": OP1_SQL, "op5_de_bruijn_repeats": OP5_SQL, "op6_chat_formatting": OP6_SQL, "op7_line_site_spread": OP7_SQL, "op8_curriculum_mix": OP8_SQL}
