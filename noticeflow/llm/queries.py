"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (context_mixing, decontamination, language, main_text, neardup, neighbours, packing, personal, prefix_trie,
               secrets, token_alignment, toxicity, url_filters)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_toxicity")
def op1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").where(~toxicity.held_out())
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.withColumn("held_out", toxicity.held_out()), model, sentences="sentences")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "sentences")


@query("op2_near_duplicates")
def op2(spark, sf):
    return neardup.classes(table(spark, sf, "documents"))


@query("op3_best_fit_packing")
def op3(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op4_secrets")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op5_main_text")
def op5(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    found = main_text.main_text(pages, main_text.learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op6_neighbours")
def op6(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query("op7_language")
def op7(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", language.held_out())
    model = language.fit(docs.where("not held_out").select("text", "lang"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query("op8_context_mixing")
def op8(spark, sf):
    return context_mixing.score(table(spark, sf, "documents"))


@query("op10_decontamination", r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
  FROM documents),
docs AS (SELECT row_number() OVER () AS r, doc_id,
                regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         unnest(list_transform(range(0, greatest(len(w) - 9, 1)),
                               lambda i: array_to_string(w[i + 1:i + 10], ' '))) AS win
  FROM items WHERE len(w) > 0),
places AS (
  SELECT r, n, unnest(range(0, len(w) - n + 1)) AS i, w FROM docs, (SELECT DISTINCT n FROM windows)
  WHERE len(w) >= n),
hits AS (
  SELECT p.r, p.i, p.n, win.item FROM places p JOIN windows win
  ON win.n = p.n AND win.win = array_to_string(p.w[p.i + 1:p.i + p.n], ' ')),
words AS (
  SELECT r, count(DISTINCT k) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
""")
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontamination.overlaps(docs, table(spark, sf, "benchmark"))
    return decontamination.digest(found).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stamp(days):
    return (F.lit("2024-01-01").cast("timestamp").cast("long") + days.cast("long") * 86_400).cast("timestamp")


def number(text, start: int):
    """A number below 65,536 from the digits of a hash, which SQL can draw too."""
    return F.conv(F.substring(F.md5(text), start, 4), 16, 10).cast("long")


@query("op9_url_filters", r"""
WITH urls AS (
  SELECT page_id, url, 7919 * page_id % 730 AS day,
         lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', '')) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
names AS (
  SELECT DISTINCT 'domain' AS kind, regexp_replace(host, '^(www|m|blog)\.', '') AS key FROM urls WHERE host <> ''
  UNION
  SELECT DISTINCT 'prefix', host || '/' || parts[1] FROM urls WHERE host <> '' AND len(parts) > 0),
drawn AS (
  SELECT kind, key, CAST('0x' || substr(md5(key), 1, 4) AS BIGINT) % 400 AS a,
         CAST('0x' || substr(md5(key), 5, 4) AS BIGINT) % 4 AS b,
         30 + CAST('0x' || substr(md5(key), 9, 4) AS BIGINT) % 200 AS c FROM names),
spans AS (
  SELECT kind, key, a AS since, a + c AS until FROM drawn WHERE b < 3
  UNION ALL SELECT kind, key, a + 300, 1000000 FROM drawn WHERE b = 0),
asked AS (
  SELECT page_id, day, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1),
                   lambda i: {'kind': 'domain', 'key': array_to_string(string_split(host, '.')[i:], '.')}),
    list_transform(range(1, len(parts) + 1),
                   lambda i: {'kind': 'prefix', 'key': host || '/' || array_to_string(parts[1:i], '/')}))) AS k
  FROM urls WHERE host <> ''),
met AS (
  SELECT page_id, count(*) AS n, string_agg(s.kind || ':' || s.key, ' ' ORDER BY length(s.key) DESC, s.kind DESC, s.key DESC) AS rules
  FROM asked JOIN spans s ON s.kind = k.kind AND s.key = k.key AND day >= since AND day < until
  GROUP BY page_id)
SELECT page_id, url, CAST(day AS BIGINT) AS fetched_day, coalesce(n, 0) > 0 AS blocked,
       CAST(coalesce(n, 0) AS BIGINT) AS n_rules, coalesce(rules, '') AS rules
FROM urls LEFT JOIN met USING (page_id)
""")
def op9(spark, sf):
    """Pages as captures; their own hosts and first folders as a list that changes over two years."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    day = F.lit(7919) * F.col("page_id") % 730
    captures = pages.withColumn("fetched_day", day).withColumn("fetched_at", stamp(day))
    host, first = url_filters.host_of("url"), F.get(
        F.filter(F.split(url_filters.path_of("url"), "/"), lambda x: x != ""), F.lit(0))
    named = pages.where(host != "")
    names = (named.select(F.lit("domain").alias("kind"), F.regexp_replace(host, r"^(www|m|blog)\.", "").alias("pattern"))
             .union(named.where(first.isNotNull()).select(F.lit("prefix"), F.concat_ws("/", host, first))).distinct())
    a, b, c = number(F.col("pattern"), 1) % 400, number(F.col("pattern"), 5) % 4, number(F.col("pattern"), 9) % 200 + 30
    entry = lambda action, at: F.struct(F.lit(action).alias("action"), stamp(at).alias("listed_at"))
    changes = (F.when(b == 0, F.array(entry("add", a), entry("remove", a + c), entry("add", a + 300)))
               .when(b < 3, F.array(entry("add", a), entry("remove", a + c))))
    entries = names.select("kind", "pattern", F.explode(changes).alias("e")).select("kind", "pattern", "e.*")
    found = url_filters.active(captures, entries)
    return found.select(
        "page_id", "url", "fetched_day", (F.size("rules") > 0).alias("blocked"),
        F.size("rules").cast("long").alias("n_rules"),
        F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["kind"], r["key"])), " ").alias("rules"))


@query("op11_token_alignment")
def op11(spark, sf):
    return token_alignment.align(table(spark, sf, "documents")).documents


@query("op12_prefix_trie", r"""
WITH t AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, bit: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT conv_id, digest, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth
  FROM (SELECT c.conv_id, 0 AS own, t.pos, t.digest, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
        UNION ALL SELECT c.conv_id, 1, t.pos, t.digest, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h)),
p AS (
  SELECT conv_id, depth, length(text) AS chars, key,
         coalesce(lag(key) OVER w, '') AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM (SELECT *, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM r)
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL
  SELECT conv_id, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id) FROM c),
n AS (
  SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM p GROUP BY key),
k AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
b AS (
  SELECT up.key, sum((n.n_convs - 1) * n.chars) AS saved_tokens, count(*) FILTER (WHERE k.key IS NULL) AS n_leaves
  FROM n JOIN p up ON up.conv_id = n.conv_id AND up.depth <= n.depth LEFT JOIN k ON k.key = n.key GROUP BY up.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs,
       CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n m ON m.key = n.parent LEFT JOIN k ON k.key = n.key JOIN b ON b.key = n.key
""")
def op12(spark, sf):
    return prefix_trie.conversation_trie(table(spark, sf, "conversations"))


@query("op13_personal_data")
def op13(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return personal.digest(personal.scan(docs, personal.fit(docs))).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
