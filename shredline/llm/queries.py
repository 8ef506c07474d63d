"""The registered queries over the operators: ``QUERIES`` and their DuckDB SQL in ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shredline.llm import (bpe, decontamination, fim, language_id, license_scan, lm_scoring, packing, pii, quality, sharding,
                           simhash, trie, url_filter)
from shredline.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.judge(decontamination.match_benchmark(docs, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        "contaminated")


@query
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality.NAMES)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bpe.Bpe(bpe.read_ranks(bpe.default_ranks()))
    ids = F.col("ids")
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(model.decode(ids), 256).alias("decoded_sha256"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    ensure_checkpoint_dir(spark)
    return corpus_pipeline.run(spark, sf_dir)


#: DuckDB words of a text column t: lower-cased A-Z, ASCII letters and digits and everything beyond ASCII.
_WORDS = ("regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

ORACLES["op4_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
i AS (SELECT DISTINCT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS width, array_to_string(w[j : j + least(13, len(w)) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS j FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, width, p, array_to_string(w[p : p + width - 1], ' ') AS gram
       FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS p
             FROM d, (SELECT DISTINCT width FROM iw) WHERE len(w) >= width)),
m AS (SELECT doc_id, item_id, p, width FROM dw JOIN iw USING (width, gram)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit
      FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + width - 1)) AS x FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


ORACLES["op2_license_scan"] = f"""
WITH t AS (SELECT t, label, string_split(body, ' ') AS w, base FROM (VALUES {_values(
    [(i, label, body, base) for i, (label, body, base) in enumerate(
        [(a, b, True) for a, b in license_scan.BASE] + [(a, b, False) for a, b in license_scan.NOTICES])]
)}) AS v(t, label, body, base)),
g AS (SELECT t, label, base, len(w) - 1 AS grams, p, w[p + 1] AS w1, w[p + 2] AS w2
      FROM (SELECT *, unnest(generate_series(0, len(w) - 2)) AS p FROM t)),
d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
x AS (SELECT doc_id, q, w[q + 1] AS w1, w[q + 2] AS w2
      FROM (SELECT *, unnest(generate_series(0, len(w) - 2)) AS q FROM d WHERE len(w) > 1)),
v AS (SELECT doc_id, t, label, base, grams, q - p AS diagonal, min(q) AS first, max(q) AS last, count(*) AS votes,
             bit_or(1::BIGINT << p::INTEGER) AS mask
      FROM x JOIN g USING (w1, w2) GROUP BY ALL),
n AS (SELECT *, CASE WHEN base OR lag(diagonal) OVER near IS NULL OR abs(diagonal - lag(diagonal) OVER near) > 3
                       OR first > lag(last) OVER near + 5 THEN 1 ELSE 0 END AS new
      FROM v WINDOW near AS (PARTITION BY doc_id, t ORDER BY first, diagonal)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, t ORDER BY first, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM n),
c AS (SELECT doc_id, t, label, base, grams, span, bit_count(bit_or(mask)) AS found, min(first) AS a, max(last) + 2 AS b,
             bool_or(votes = grams) AS whole
      FROM s GROUP BY ALL),
k AS (SELECT *, found / grams::DOUBLE AS share,
             CASE WHEN base THEN whole ELSE found / grams::DOUBLE >= 0.6 AND b - a <= ceil(1.5 * (grams + 1)) END AS counts
      FROM c),
r AS (SELECT doc_id, count(*) FILTER (counts AND base) AS n_base, min(a) FILTER (counts AND base) AS first_word,
             max(a) FILTER (counts AND base) AS last_word, max(share) AS score,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (counts AND base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (counts) AS labels
      FROM k GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)
"""

ORACLES["op12_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
k AS (SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
             array_to_string(units[b + 1:n], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                          ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
r AS (SELECT *, CASE form WHEN 'plain' THEN output
                          WHEN 'psm' THEN split_part(split_part(output, '<P>', 2), '<S>', 1) || split_part(output, '<M>', 2)
                                          || split_part(split_part(output, '<S>', 2), '<M>', 1)
                          ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2)
                               || split_part(split_part(output, '<S>', 2), '<P>', 1) END AS restored FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM r
"""

ORACLES["op13_conversation_trie"] = """
WITH c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT),
                    lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))),
                    4294967295) % 4 AS h FROM c),
r AS (SELECT h.conv_id, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns
      FROM h LEFT JOIN c AS b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS length, d, turns[1:d] AS seq FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT d, seq, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends_sha256
      FROM p GROUP BY d, seq),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(x.children, 0) AS n_children,
             CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.seq[n.d]['text'], '[^\\x20\\x09-\\x0D]+')) END AS own
      FROM n LEFT JOIN n AS u ON u.d = n.d - 1 AND u.seq = n.seq[1:n.d - 1]
      LEFT JOIN (SELECT d - 1 AS d, seq[1:d - 1] AS seq, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL) AS x
             ON x.d = n.d AND x.seq = n.seq),
s AS (SELECT a AS d, seq[1:a] AS seq, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved
      FROM (SELECT *, unnest(range(d + 1)) AS a FROM k) GROUP BY ALL)
SELECT k.conv_id, k.d::BIGINT AS depth, k.parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s ON s.d = k.d AND s.seq = k.seq
"""

ORACLES["op1_lm_scoring"] = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda s: ord(s)::BIGINT),
        lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 7 = 2 AS held_out,
    [' '] || regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x20\\x09-\\x0D]+') || [''] AS seq FROM documents),
t AS (SELECT row, held_out, seq[i] AS u, seq[i + 1] AS w FROM (SELECT *, unnest(range(1, len(seq))) AS i FROM d)),
c1 AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
c2 AS (SELECT u, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY u, w),
h AS (SELECT u, sum(c) AS c FROM c2 GROUP BY u UNION ALL SELECT '', c FROM c1 WHERE w = ''),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c1),
p AS (SELECT t.row, coalesce(c1.c, 0) AS c, (coalesce(c1.c, 0) + 1) / (n.n + n.v + 1)::DOUBLE AS p1, coalesce(c2.c, 0) AS c2, coalesce(h.c, 0) AS h
      FROM t CROSS JOIN n LEFT JOIN c1 ON c1.w = t.w LEFT JOIN c2 ON c2.u = t.u AND c2.w = t.w LEFT JOIN h ON h.u = t.u),
s AS (SELECT row, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, sum(log10(p1)) AS base_score,
             sum(log10((c2 + 100 * p1) / (h + 100))) AS score FROM p GROUP BY row)
SELECT doc_id, held_out, n_tokens, n_known, n.n AS train_tokens, base_score, score FROM d JOIN s USING (row) CROSS JOIN n
"""
