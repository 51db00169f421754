"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

import corpus_pipeline
from lodgeflow.llm.audit import divergence
from lodgeflow.llm.chat import format_chats, loss_text, parse
from lodgeflow.llm.common import SPACE_RE, SPACES, UPPER, read_table
from lodgeflow.llm.decontam import BREAK_RE, decontaminate
from lodgeflow.llm.embed_dedup import near_vectors
from lodgeflow.llm.extract_text import extract_text
from lodgeflow.llm.line_dedup import dedup_lines
from lodgeflow.llm.lm import lm_score
from lodgeflow.llm.mixing import curriculum
from lodgeflow.llm.periods import periodic_runs
from lodgeflow.llm.quality import judge
from lodgeflow.llm.simhash import simhash_components
from lodgeflow.llm.substring import dedup_substrings
from lodgeflow.llm.urlfilter import judge_urls

QUERIES = {"pipeline": corpus_pipeline.run}
SQL = {}
_LOW = f"'{UPPER}', '{UPPER.lower()}'"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _div(a, b):
    """Whole-number division."""
    return F.call_function("div", a, b)


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents (3-word shingles, 2 bits)."""
    return simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more in 5 documents or more stay in the last one only."""
    done = dedup_lines(read_table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op7_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (SELECT *, trim(translate(line, {_LOW}), {_SPACES}) AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.top AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows of all benchmark items in all documents; 5 % of hit words contaminate."""
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    done = decontaminate(docs, items, window=13, share=20)
    return done.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256)).drop("item_ids")


SQL["op10_decontamination"] = f"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOW}), '{BREAK_RE}'), lambda x: x <> '') AS w
  FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOW}), '{BREAK_RE}'), lambda x: x <> '') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS gram
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
found AS (
  SELECT DISTINCT p.doc_id, p.i, p.n, g.item_id FROM places p JOIN grams g ON g.n = p.n AND g.gram = list_slice(p.w, p.i, p.i + p.n - 1)),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the curriculum of weights 5, 2, 1, in order of their first training position."""
    plan = curriculum(read_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), cap=3)
    return (plan.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "doc_id")
            .select("doc_id", "size", "source_size", "target", "taken"))


SQL["op3_mixing"] = f"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE_RE}'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source),
f AS (SELECT *, source_size * 3.0::DOUBLE / weight AS filled FROM s),
o AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
         - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY filled, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(weight) OVER (ORDER BY filled, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f),
t AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, weight * (SELECT coalesce(max(level), 0) FROM o WHERE level < filled)) AS target
  FROM o),
c AS (
  SELECT d.*, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * ((middle < target)::INT + (source_size + middle < target)::INT + (2 * source_size + middle < target)::INT) AS taken
FROM c"""


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality and toxicity of all documents; sites are source and language."""
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), host="source", path="lang")


@_query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that tries to break the template, formatted and read back."""
    tricky = "\\### Assistant: </turn> ok"
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    done = format_chats(table.union(extra)).select(
        "conv_id", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL["op2_chat"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (
  SELECT *, contains(role || chr(0) || text, '### ') OR contains(role || chr(0) || text, '</turn>') OR contains(role, ': ')
         OR contains(role || chr(0) || text, '\\0') OR contains(role || chr(0) || text, '\\1')
         OR contains(role || chr(0) || text, '\\2') OR contains(role, '\\3') AS bad
  FROM t),
f AS (
  SELECT *, CASE WHEN bad THEN replace(replace(replace(text, '\\', '\\0'), '</turn>', '\\1'), '### ', '\\2') ELSE text END AS x,
         CASE WHEN bad THEN replace(replace(replace(replace(role, '\\', '\\0'), '</turn>', '\\1'), '### ', '\\2'), ': ', '\\3') ELSE role END AS y
  FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(x) + length(y) + 14)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""


@_query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under four rules of allowed and blocked sites."""
    rules = spark.sql("""SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS rules(host, path, action)""")
    return judge_urls(read_table(spark, sf_dir, "pages"), rules)


SQL["op4_url_filter"] = f"""
WITH r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOW}) AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM r),
m AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m"""


@_query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal label at a cosine of 0.93."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


@_query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a Katz bigram model of nine tenths of them."""
    return lm_score(read_table(spark, sf_dir, "documents"))


@_query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words that an earlier document holds go from all documents."""
    done = dedup_substrings(read_table(spark, sf_dir, "documents"), window=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op9_substring_dedup"] = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE_RE}'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT gram, min(doc_id) AS least FROM win GROUP BY gram HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN first USING (gram) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@_query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    done = extract_text(read_table(spark, sf_dir, "pages"), keep=("url",))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


SQL["op11_html_extraction"] = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS body FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(body, '&quot;', '"'), '&amp;?', '&', 'g') AS body FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(body, '[\x09-\x0D ]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""


@_query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, and by which terms, over all documents."""
    return divergence(read_table(spark, sf_dir, "documents"), min_docs=10, smooth=2, scale=10 ** 9, top=10)


SQL["op12_source_divergence"] = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, doc, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
g AS (
  SELECT lang, source, coalesce(size, 0)::HUGEINT AS size, coalesce(v, 0)::HUGEINT AS v, coalesce(lang_n, 0)::HUGEINT AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN s USING (lang, source)),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.size + 2 * g.v) AS p,
         1 + 1000000000::HUGEINT * (k.total + 2) // (g.lang_n + 2 * g.v) AS q
  FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM x WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, after a tenth of them (by crc32 of the id) got a periodic tail."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), _div(h, F.lit(10)).alias("g"))
    body = F.btrim("text", F.lit(SPACES))
    docs = docs.withColumn("w", F.when((F.col("h") % 10 == 0) & (F.octet_length(body) > 0), F.split(body, SPACE_RE)))
    docs = docs.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    docs = docs.withColumn("p", (F.lit(1) + _div(rest, F.lit(3) + F.col("g") % 8)).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    docs = docs.select("doc_id", F.when(F.col("w").isNotNull(), F.array_join(F.concat(
        F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), rest)), " ")).otherwise(F.col("text")).alias("text"))
    done = periodic_runs(docs, power=3, least=24)
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best,
                       _div(F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
                       F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
