"""The registered queries of the package, with SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import (
    credential_scan, decontamination, exact_dedup, mixing, nearest, packing, periodic_runs, quality, sharding, simhash, spelling,
    token_counts, toxicity,
)
from tapeloom.llm.common import held_out, table, utf8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_shards")
def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = utf8("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    test = held_out("doc_id", 5, 0)
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels, ~test))
    return scored.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(cast(doc_id AS VARCHAR), '')) AS h FROM documents),
classed AS (
  SELECT *, 8 * length(bin(size)) + ((size * 8) // (1::BIGINT << (length(bin(size)) - 1))) - 8 AS class,
         cast('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS spread FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)::DOUBLE)
            / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, weight *
         (SELECT arg_min(level, cap::DOUBLE / weight) FROM levels WHERE level * weight <= cap)), cap::DOUBLE) AS target
  FROM levels),
ranked AS (
  SELECT c.doc_id, c.size, c.source, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         cast('0x' || substr(md5('7:' || coalesce(c.source, '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY c.source ORDER BY class DESC, spread, size DESC, h, doc_id NULLS FIRST) - 1 AS rank
  FROM classed c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * least(floor(rate * (rank + 1) + u) - floor(rate * rank + u), ceil(rate)))::BIGINT AS taken
FROM ranked
"""


@query("op4_source_mixing", OP4_SQL)
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.copies(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2, ids=False)


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    test = held_out("doc_id", 3, 1)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels, ~test))
    return scored.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""


@query("op7_exact_top_k", OP7_SQL)
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP8_KIND = """
SELECT row, key, owner, repository, {kind} AS kind, i,
       cast(list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS INT) AS start,
       m[i] AS hit, s[i] AS secret
FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (
  SELECT *, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS s,
         regexp_split_to_array(text, '{pattern}') AS p FROM whole)) t
"""
OP8_SQL = f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id AS key, coalesce(text, '') AS text, source AS owner, lang AS repository FROM documents),
hits AS ({" UNION ALL ".join(
    OP8_KIND.format(kind=k, pattern=p.replace("'", "''"), group=g) for k, (p, g) in enumerate(
        ((credential_scan.ASSIGN, 2), (credential_scan.ACCESS, 0), (credential_scan.HEX, 0))))}),
base AS MATERIALIZED (
  SELECT row, owner, repository, kind, start, start + length(hit) AS stop, start + length(hit) - length(secret) AS origin, secret
  FROM hits WHERE kind > 0 OR length(secret) >= 6),
held AS (
  SELECT secret, count(DISTINCT coalesce(owner, chr(1))) AS owners,
         count(DISTINCT coalesce(owner, chr(1)) || '/' || coalesce(repository, chr(1))) AS repositories FROM base GROUP BY secret),
every AS (
  SELECT row, kind, start, stop FROM base UNION ALL
  SELECT row, CASE WHEN owners <= 2 AND repositories <= 4 THEN 3 ELSE 4 END, origin, stop FROM base JOIN held USING (secret)),
told AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         count(*) FILTER (kind = 3) AS n_live, count(*) FILTER (kind = 4) AS n_example,
         string_agg(names[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base,
         string_agg(names[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans
  FROM (SELECT *, ['assign', 'access', 'hex', 'live', 'example'] AS names FROM every) GROUP BY row)
SELECT key AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM whole LEFT JOIN told USING (row)
"""


@query("op8_secret_scan", OP8_SQL)
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_scan.scan(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
same AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM whole GROUP BY text)
SELECT w.doc_id, s.keep_id, s.group_size,
       w.doc_id IS NOT DISTINCT FROM s.keep_id
         AND row_number() OVER (PARTITION BY w.text, w.doc_id) = 1 AS kept,
       sha256(w.text) AS text_sha256
FROM whole w JOIN same s USING (text)
"""


@query("op9_exact_dedup", OP9_SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


#: A column `crc` of one row: the 256 steps of CRC-32 by its polynomial.
CRC_STEPS = """
steps AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc)
"""


def crc32_sql(codes: str) -> str:
    """CRC-32 of a list of byte values, for rows joined to `steps`."""
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), "
            "lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)))")


def planted(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The words of a text, of every tenth one with a repetition from some word on; a null id is the text ''."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    return words[np.r_[0:a, a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]]


OP11_SQL = f"""
WITH {CRC_STEPS},
split AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w,
         {crc32_sql("list_transform(string_split(coalesce(cast(doc_id AS VARCHAR), ''), ''), lambda s: ascii(s)::BIGINT)")} AS h
  FROM documents, steps),
dealt AS MATERIALIZED (
  SELECT row, doc_id, w, len(w) AS n, h // 10 AS g, h % 10 = 0 AS moved,
         CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
word AS MATERIALIZED (
  SELECT row, n, i, CASE WHEN moved AND i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE w[i + 1] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM dealt)),
equal AS (
  SELECT x.row, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.row = y.row AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT row, i, q, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY row, q, island),
runs AS MATERIALIZED (
  SELECT row, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY row, start, length),
told AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
         first(start ORDER BY length::DOUBLE / period DESC, start, period) AS start,
         first(length ORDER BY length::DOUBLE / period DESC, start, period) AS length,
         first(period ORDER BY length::DOUBLE / period DESC, start, period) AS period FROM runs GROUP BY row),
kept AS (
  SELECT row, string_agg(w, ' ' ORDER BY i) AS collapsed FROM word
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.row = word.row AND word.i >= r.start + r.period AND word.i < r.start + r.length)
  GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM dealt LEFT JOIN told USING (row) LEFT JOIN kept USING (row)
"""


@query("op11_periodic_runs", OP11_SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(docs, beside="doc_id", arrange=planted)
    listed = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("greatest.start").alias("start"),
        F.col("greatest.length").alias("length"), F.col("greatest.period").alias("period"),
        F.expr("1000 * greatest.length div greatest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def utf8_codes_sql(text: str) -> str:
    """The UTF-8 bytes of a text of characters up to U+00FF."""
    return (f"flatten(list_transform(string_split({text}, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] "
            "ELSE [195::BIGINT, unicode(s)::BIGINT - 64] END))")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = f"""
WITH RECURSIVE {CRC_STEPS},
found AS (
  SELECT coalesce(cast(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS w FROM documents),
own AS (SELECT id, w, count(*) AS n FROM found WHERE length(w) >= 5 GROUP BY id, w),
checked AS (SELECT w, n, {crc32_sql(utf8_codes_sql("id || ':' || w"))} AS h FROM own, steps),
vocabulary AS MATERIALIZED (
  SELECT w, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM checked)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
rests AS MATERIALIZED (
  SELECT w, n, i, w[:i] || w[i + 2:] AS rest FROM (SELECT *, unnest(range(length(w))) AS i FROM vocabulary)),
pairs AS (
  SELECT x.w, y.w AS other, y.n AS m FROM rests x JOIN rests y ON x.rest = y.rest AND x.i = y.i AND x.w <> y.w
  UNION SELECT x.w, y.w, y.n FROM rests x JOIN vocabulary y ON x.rest = y.w
  UNION SELECT y.w, x.w, x.n FROM rests x JOIN vocabulary y ON x.rest = y.w),
best AS (SELECT w, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM pairs GROUP BY w),
formed AS MATERIALIZED (
  SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
  FROM vocabulary v LEFT JOIN best USING (w)),
chain AS (
  SELECT w, w AS last, form FROM formed
  UNION ALL SELECT c.w, f.w, f.form FROM chain c JOIN formed f ON c.form = f.w)
SELECT f.w AS word, f.form, c.last AS root, n, n_near, form_n FROM formed f JOIN chain c ON f.w = c.w AND c.form IS NULL
"""


@query("op12_spelling_variants", OP12_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
OP13_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {OP13_WORDS} AS w FROM documents),
items AS (SELECT coalesce(cast(item_id AS VARCHAR), '') AS id, {OP13_WORDS} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT id, least(10, len(w)) AS k, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS j FROM items WHERE len(w) > 0)),
places AS (
  SELECT row, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
hits AS MATERIALIZED (
  SELECT row, p, k, id FROM (SELECT row, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM places) JOIN windows USING (k, g)),
covered AS (
  SELECT row, count(DISTINCT x) AS n_hit FROM (SELECT row, unnest(generate_series(p, p + k - 1)) AS x FROM hits) GROUP BY row),
held AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY encode(id)) AS ids FROM (SELECT DISTINCT row, id FROM hits) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN held USING (row)
"""


@query("op13_decontamination", OP13_SQL)
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.matches(docs, table(spark, sf_dir, "benchmark"), whole=False)
    hit = F.aggregate("matches.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", F.col("matches.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("matches.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("matches.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
