"""Named queries of the operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.decontamination import contamination
from packetloom.llm.fingerprints import fingerprint_edits
from packetloom.llm.lexical_search import lexical_search
from packetloom.llm.line_dedup import dedup_lines
from packetloom.llm.mixing import mixing_plan
from packetloom.llm.near_dedup import near_duplicates
from packetloom.llm.packing import pack
from packetloom.llm.quality import classify
from packetloom.llm.sharding import assign_shards
from packetloom.llm.spelling import DAMAGE, spelling_variants
from packetloom.llm.substring_dedup import remove_repeats
from packetloom.llm.topk_search import top_k
from packetloom.llm.url_filter import filter_urls
from packetloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where SQL can express it."""
    def add(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, len(lines) AS n, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h FROM d),
e AS (SELECT doc_id, n, unnest(list_filter(range(3, n + 1), lambda i:
   ((h[i - 2] * 961 + h[i - 1] * 31 + h[i]) % 1000003) % 3 = 0)) AS e FROM h),
u AS (SELECT *, e - row_number() OVER (PARTITION BY doc_id ORDER BY e) AS run FROM e),
s AS (SELECT doc_id, e FROM (SELECT *, (e - min(e) OVER (PARTITION BY doc_id, run)) % 2 = 0 AS apart FROM u) WHERE apart AND e < n - 1
   UNION ALL SELECT doc_id, n FROM h),
c AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) + 1 AS a, e AS b FROM s),
t AS (SELECT doc_id, a, b, array_to_string(lines[a:b], chr(10)) AS chunk FROM c JOIN d USING (doc_id) WHERE b > a),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) AS nth FROM t),
g AS (SELECT doc_id, flatten(list(range(a, b + 1))) AS gone FROM r WHERE nth > 1 GROUP BY doc_id),
k AS (SELECT d.doc_id, len(lines) AS n_lines, CASE WHEN gone IS NULL THEN lines ELSE
   list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]) END AS kept
   FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_lines, n_lines - len(kept) AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL"""


@query("op1_line_dedup", LINE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


# Small enough that buckets split at several depths in small tables, too.
SHARD_BYTES = 160 << 10
SHARD_SQL = """
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
  lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS address FROM documents),
p AS (SELECT t AS depth, substr(address, 1, t) AS shard, sum(bytes)::BIGINT AS shard_bytes
  FROM d, range(0, 25) r(t) GROUP BY ALL),
f AS (SELECT doc_id, bytes, shard, depth, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS nth
  FROM d JOIN p ON p.shard = substr(d.address, 1, p.depth) WHERE shard_bytes <= 163840)
SELECT doc_id, bytes, shard, CAST(depth AS INT) AS depth, shard_bytes, false AS oversized FROM f WHERE nth = 1"""


@query("op2_sharding", SHARD_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


@query("op5_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


URL_SQL = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
m AS (SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS nth
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE nth = 1"""


@query("op7_url_filter", URL_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


MIX_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM w),
x AS (SELECT *, 3 * sum(source_size) OVER (ORDER BY k) AS fixed, sum(weight) OVER () - sum(weight) OVER (ORDER BY k) AS free,
  sum(source_size) OVER () AS total, lead(3 * source_size / weight) OVER (ORDER BY k) AS edge FROM o),
c AS (SELECT 0 AS fixed, sum(weight) AS free, sum(source_size) AS total, min(3 * source_size / weight) AS edge FROM o
  UNION ALL SELECT fixed, free, total, edge FROM x WHERE free > 0),
l AS (SELECT CAST(total - fixed AS DOUBLE) / free AS level FROM c WHERE CAST(total - fixed AS DOUBLE) / free <= edge
  ORDER BY fixed LIMIT 1),
t AS (SELECT source, source_size, least(weight * level, CAST(3 * source_size AS DOUBLE)) AS target FROM w, l),
n AS (SELECT d.doc_id, size, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS k,
  target / source_size AS rate, CAST('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(u + k * rate) - floor(u + (k - 1) * rate), ceil(rate)) AS BIGINT) * size AS taken FROM n"""


@query("op8_mixing", MIX_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


TOP_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 10"""


@query("op10_topk_search", TOP_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos, len(words) AS n FROM w WHERE len(words) > 0),
k AS (SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM u),
s AS (SELECT DISTINCT doc_id, shingle FROM k WHERE pos + 5 <= n OR pos = 0),
z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * common >= 75 * (x.size + y.size - common)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(size, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN z USING (doc_id)"""


@query("op6_near_dedup", NEAR_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


REPEAT_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos, len(words) AS n FROM w WHERE len(words) > 0),
k AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS key FROM u),
f AS (SELECT doc_id, word, pos, pos + 20 <= n AND row_number() OVER (PARTITION BY key, pos + 20 <= n ORDER BY doc_id, pos) > 1 AS again FROM k),
c AS (SELECT doc_id, word, pos, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)"""


@query("op3_substring_dedup", REPEAT_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


RANK_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS total, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s),
c AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // length))) AS part FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(part * times)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM r WHERE score > 0)
SELECT item_id, CAST(n AS INT) AS rank, doc_id, score FROM o WHERE n <= 10"""


@query("op11_lexical_search", RANK_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The checksum is written out (polynomial 0xEDB88320), as DuckDB has no function for it. Two words are one
# edit apart if one is the other without a letter, or both are equal without the letter at one place.
SPELLING_SQL = """
WITH RECURSIVE k AS (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, s:
  xor(x >> 1, (x & 1) * 3988292384)) ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)),
u AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS times, hex(encode(doc_id || ':' || run)) AS raw FROM u WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, times, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(raw) // 2),
  lambda i: ('0x' || raw[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM g, k),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
n AS (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
c AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM n)),
e AS (SELECT a.word AS a, b.word AS b FROM c a JOIN c b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, n.word FROM c JOIN n ON c.rest = n.word UNION SELECT n.word, c.word FROM c JOIN n ON c.rest = n.word),
b AS (SELECT a, b, f.n AS fn, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY f.n DESC, encode(b)) AS nth
  FROM e JOIN n f ON f.word = b),
m AS (SELECT n.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN fn >= 10 * n THEN b END AS form, CASE WHEN fn >= 10 * n THEN fn END AS form_n
  FROM n LEFT JOIN b ON a = n.word AND nth = 1),
r AS (SELECT word, word AS root, form FROM m UNION ALL SELECT r.word, m.word, m.form FROM r JOIN m ON m.word = r.form)
SELECT word, n, n_near, m.form, form_n, root FROM m JOIN (SELECT word, root FROM r WHERE form IS NULL) USING (word)"""


@query("op12_spelling_variants", SPELLING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), damage=DAMAGE)


LEAK_SQL = """
WITH t AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
z AS (SELECT DISTINCT size FROM g),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT doc_id, i, z.size, gram, item_id FROM p JOIN z ON i + z.size - 1 <= len(w)
  JOIN g ON g.size = z.size AND gram = array_to_string(w[i:i + z.size - 1], ' ')),
x AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN o USING (doc_id)"""


@query("op13_decontamination", LEAK_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(
        F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
