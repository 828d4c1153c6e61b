"""Registered queries of the corpus operators, with the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.llm.extraction import extracted
from planshift.llm.jaccard import jaccard_classes
from planshift.llm.lines import drop_boilerplate
from planshift.llm.mixing import mixed
from planshift.llm.packing import packed
from planshift.llm.prefix_trie import ends_sha256, prefix_trie
from planshift.llm.quality import RULES, judged
from planshift.llm.resampling import resampled
from planshift.llm.shared import table
from planshift.llm.sharding import interleaved_shards
from planshift.llm.subwords import fit_quality, quality_scored
from planshift.llm.token_files import read_documents, write_token_files
from planshift.llm.topk import top_k
from planshift.llm.toxicity import fit_toxicity, scored
from planshift.llm.word_ids import vocabulary
from planshift.session import work_path

SHARDS = 16
BOILERPLATE_RATIO = 0.1
LEAST_PAGES = 2
MIX_LEVELS = ("__domain", "lang", "source")
MIX_SHARE = 0.8
MIX_EPOCHS = 2
RULE_ROUNDS = 12


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleaved_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("p_good")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def mix_weights(spark: SparkSession) -> DataFrame:
    """Target weights of the stand-in domains, of languages within a domain, and of two sources; all others by size."""
    domains = [(f"domain{d}", None, None, 4.0 - d) for d in range(4)]
    langs = [(f"domain{d}", lang, None, w) for d in range(4) for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))]
    sources = [("domain0", "en", "src4", 500.0), ("domain1", "en", "src1", 250.0)]
    return spark.createDataFrame([*domains, *langs, *sources], "__domain string, lang string, source string, weight double")


def mixture(docs: DataFrame) -> DataFrame:
    """The mixture of the queries. ``documents`` has no domain: sources are put in four by the last digits of their names."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    placed = docs.withColumn("__domain", F.concat(F.lit("domain"), number % 4))
    return mixed(placed, MIX_LEVELS, MIX_SHARE, MIX_EPOCHS, mix_weights(docs.sparkSession)).drop("__domain")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "epoch")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(
        table(spark, sf_dir, "documents"), work_path(spark, "tokens"), vocabulary("byte_bpe_50k.json")
    )
    return read_documents(files)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = drop_boilerplate(docs, ratio=BOILERPLATE_RATIO, least_pages=LEAST_PAGES, removed="n_removed")
    return cleaned.select("doc_id", "source", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return quality_scored(docs, fit_quality(docs, labels, held_out), held_out)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie(table(spark, sf_dir, "conversations"))
    none = F.sha2(F.lit(""), 256)
    return trie.nodes.join(ends_sha256(trie.ends), ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", none)
    )


# CRC-32 byte by byte over the 256 remainders of the reversed polynomial.
_REMAINDERS = """
WITH RECURSIVE remainder(i, step, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM remainder WHERE step < 8
),
byte_table AS (SELECT list(c ORDER BY i) AS t FROM remainder WHERE step = 8)"""
_CRC32 = f"""{_REMAINDERS},
sized AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
),
checked AS (
  SELECT doc_id, source, size::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2),
      lambda i: ('0x' || substr(h, (i + 1)::INTEGER, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM sized, byte_table
)
"""

OP1_SQL = f"""{_CRC32},
copies AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, crc, size) - 1 AS copy FROM checked),
hashed AS (SELECT *, md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || crc || '|' || copy) AS h FROM copies),
ranked AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, crc, size) - 1) + 1)
    / (2.0::DOUBLE * count(*) OVER (PARTITION BY source)) AS f
  FROM hashed
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY f, h, doc_id, crc, size) - 1 AS place, count(*) OVER () AS n FROM ranked
),
cut AS (SELECT *, place * {SHARDS} // n AS shard FROM placed)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  (place - (shard * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

_RULES = list(RULES)
_ODDS = " + ".join(f"{{v}}{r} * ln(m.a_{r} / (1 - m.a_{r}))" for r in _RULES)


def _clamped(x: str) -> str:
    return f"least(greatest({x}, 0.01::DOUBLE), 0.99::DOUBLE)"


OP3_SQL = f"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM texts
),
windows AS (
  SELECT k, i, array_to_string(w[i:i + 7], ' ') AS v
  FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)
),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, v) AS n FROM windows) WHERE n > 1),
repeated AS (
  SELECT k, sum(least(8, coalesce(lead_i - i, 8)))::BIGINT AS n
  FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS lead_i FROM again) GROUP BY k
),
counts AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (length(t) - length(translate(t, '!', '')))::BIGINT AS n_marks,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeated r USING (k)
),
votes AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in RULES.items())} FROM counts),
patterns AS (SELECT {", ".join(_RULES)}, count(*) AS n FROM votes GROUP BY ALL),
fit AS (
  SELECT 0 AS round, 0.8::DOUBLE AS good, {", ".join(f"0.8::DOUBLE AS a_{r}" for r in _RULES)}
  UNION ALL
  SELECT round + 1, {_clamped("sum(n * p) / sum(n)")},
    {", ".join(_clamped(f"(sum(n * CASE WHEN {r} > 0 THEN p WHEN {r} < 0 THEN 1 - p ELSE 0 END) + 1) / (sum(n * abs({r})) + 2)") for r in _RULES)}
  FROM (
    SELECT m.round, q.*, 1 / (1 + exp(-(ln(m.good / (1 - m.good)) + {_ODDS.format(v="q.")}))) AS p
    FROM fit m, patterns q WHERE m.round < {RULE_ROUNDS}
  ) GROUP BY round
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND 1 / (1 + exp(-(ln(m.good / (1 - m.good)) + {_ODDS.format(v="v.")}))) >= 0.5 AS kept
FROM votes v, (SELECT * FROM fit WHERE round = {RULE_ROUNDS}) m
"""

OP6_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT * FROM whole WHERE vec_id % 50 = 0) q JOIN whole c ON q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""

_BARE = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP10_SQL = f"""
WITH keyed AS (SELECT row_number() OVER () AS k, * FROM documents),
lines AS (
  SELECT DISTINCT k, source, {_BARE.replace("x,", "line,")} AS bare
  FROM (SELECT k, source, unnest(string_split(text, chr(10))) AS line FROM keyed)
),
totals AS (SELECT source, count(*) AS total FROM keyed GROUP BY source),
flagged AS (
  SELECT l.source, l.bare FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.bare <> '' GROUP BY l.source, l.bare, t.total HAVING count(*) >= {LEAST_PAGES} AND count(*) > {BOILERPLATE_RATIO} * t.total
),
per_host AS (SELECT source, list(bare) AS gone FROM flagged GROUP BY source),
kept AS (
  SELECT k.doc_id, k.source, k.text, string_split(k.text, chr(10)) AS l,
    list_filter(string_split(k.text, chr(10)), lambda x: NOT list_contains(coalesce(gone, []), {_BARE})) AS rest
  FROM keyed k LEFT JOIN per_host p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN array_to_string(rest, chr(10)) END AS text,
  CASE WHEN text IS NOT NULL THEN length(array_to_string(rest, chr(10))) END::BIGINT AS n_chars,
  coalesce(len(l) - len(rest), 0)::BIGINT AS n_removed
FROM kept
"""

OP11_SQL = f"""{_REMAINDERS},
texts AS (
  SELECT row_number() OVER () AS k, doc_id, text, TRUE AS raw FROM documents
  UNION ALL SELECT -item_id - 1, NULL, text, FALSE FROM benchmark
),
split AS (
  SELECT k, doc_id, raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
),
placed AS (SELECT k, raw, w, unnest(range(1, len(w) + 1)) AS i FROM split),
runs AS (
  SELECT k, raw, w[i] AS v FROM placed
  UNION ALL SELECT k, raw, w[i] || ' ' || w[i + 1] FROM placed WHERE i + 1 <= len(w)
  UNION ALL SELECT k, raw, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM placed WHERE i + 2 <= len(w)
),
counted AS (SELECT k, raw, v, count(*) AS n FROM runs GROUP BY ALL),
state AS (
  SELECT v, hex(encode(v)) AS h, 0 AS done, 4294967295::BIGINT AS c FROM (SELECT DISTINCT v FROM counted)
  UNION ALL
  SELECT v, h, done + 2, xor(c >> 8, t[(xor(c, ('0x' || substr(h, done + 1, 2))::BIGINT) & 255) + 1]) FROM state, byte_table WHERE done < length(h)
),
bucket AS (SELECT v, xor(c, 4294967295) % 10000 AS b FROM state WHERE done = length(h)),
held AS (SELECT k, raw, b, sum(n)::BIGINT AS n FROM counted JOIN bucket USING (v) GROUP BY ALL),
totals AS (SELECT b, coalesce(sum(n) FILTER (raw), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT raw), 0)::BIGINT AS t FROM held GROUP BY b),
whole AS (SELECT coalesce(sum(s), 0)::BIGINT AS s, coalesce(sum(t), 0)::BIGINT AS t FROM totals),
gain AS (
  SELECT b, floor(1000 * ln(((a.t + 1)::DOUBLE * (w.s + 10000)::DOUBLE) / ((a.s + 1)::DOUBLE * (w.t + 10000)::DOUBLE)))::BIGINT AS g
  FROM totals a, whole w
),
weights AS (SELECT k, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM held JOIN gain USING (b) WHERE raw GROUP BY k),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS words,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (k) WHERE raw
),
ranked AS (
  SELECT doc_id, n_features, score, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place,
    count(*) OVER () AS eligible, weight FROM scored WHERE words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * eligible // 100 THEN place END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE words < 20
"""

OP13_SQL = f"""{_REMAINDERS},
own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
shared AS (
  SELECT c, w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1),
      lambda i: ascii(substr(c::VARCHAR, i::INTEGER, 1))::BIGINT)),
      lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM own, byte_table
),
rebuilt AS (
  SELECT s.c, list_concat(CASE WHEN b.c IS NULL THEN [] ELSE b.w[1:s.h] END, s.w[s.h + 1:]) AS seq
  FROM shared s LEFT JOIN own b ON b.c = s.c - s.c % 100
),
member AS (SELECT c, d, seq[1:d] AS p, len(seq) = d AS here FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (here), '') AS ends
  FROM member GROUP BY d, p
),
child AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
facts AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN child USING (d, p)),
above AS (SELECT a AS d, p[1:a] AS p, d AS below_d, p AS below, n, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM facts)),
subtree AS (
  SELECT d, p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
    sum(CASE WHEN below_d = 0 THEN 0 ELSE (n - 1) * length(below[below_d].t) END)::BIGINT AS saved_tokens
  FROM above GROUP BY d, p
)
SELECT f.conv_id, f.d::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens,
  sha256(f.ends) AS ends_sha256
FROM facts f JOIN subtree s ON f.d = s.d AND f.p = s.p LEFT JOIN node q ON f.d > 0 AND q.d = f.d - 1 AND q.p = f.p[1:f.d - 1]
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_html_extraction, op3_quality_rules, op4_ngram_jaccard_join, op5_toxicity, op6_exact_topk,
        op7_mixing, op8_token_output, op9_packing, op10_line_dedup, op11_importance_resampling, op12_quality_classifier, op13_prefix_trie,
    )
}
SQL = {
    "op1_sharding": OP1_SQL, "op3_quality_rules": OP3_SQL, "op6_exact_topk": OP6_SQL, "op10_line_dedup": OP10_SQL,
    "op11_importance_resampling": OP11_SQL, "op13_prefix_trie": OP13_SQL,
}
