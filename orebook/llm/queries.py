"""The registered queries of the subpackage: each applies one operator, with its production parameters, to its table."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebook.llm import (
    bpe, decontaminate, forest, language, licences, near_dup, periodic, pii, ranked, shards, sketch, token_counts, url_lists,
)
from orebook.session import shared_path

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 2048

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            TWINS[key] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query("op2_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return bpe.encode_digests(docs, BYTE_RANKS, public_tokenizers.PATTERN).drop("text")


@query("op10_token_counts")
def token_counts_cached(spark: SparkSession, folder: str) -> DataFrame:
    """Starts from an empty cache, so that a run counts everything itself; a user passes a lasting cache."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    docs = table(spark, folder, "documents", "doc_id", "text").withColumn("n_bytes", size)
    counted = token_counts.count_tokens(docs, WORD_TOKENIZER, shared_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query("op5_cross_parsing_language")
def cross_parsing_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    named = language.identify(docs.select("doc_id", "text"), docs.where(~held_out))
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL_WINDOWS = f"""
with item as (
  select item_id, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') as w from benchmark),
doc as (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}'), []) as w
  from documents),
item_window as (
  select distinct item_id, least(len(w), 10) as m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as win
  from item, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as t(s) where len(w) > 0),
doc_window as (
  select doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') as win
  from doc, (select distinct m from item_window), unnest(range(1, len(w) - m + 2)) as t(s)),
found as (select doc_id, s, m, item_id from doc_window join item_window using (m, win)),
word as (select doc_id, count(distinct p) as n from found, unnest(range(s, s + m)) as t(p) group by doc_id),
listed as (
  select doc_id, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
  from found group by doc_id)
select doc.doc_id, len(w)::bigint as n_words, coalesce(word.n, 0)::bigint as n_hit, coalesce(listed.n, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(word.n, 0) > 0 as contaminated
from doc left join word using (doc_id) left join listed using (doc_id)
"""


@query("op6_wu_manber_windows", SQL_WINDOWS)
def wu_manber_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text")
    return decontaminate.report(decontaminate.find_windows(docs, items)).drop("text")


@query("op8_super_minhash")
def super_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents", "doc_id", "text"), shingle=3, percent=85)


@query("op3_projection_forest")
def projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_vectors(table(spark, folder, "embeddings", "vec_id", "embedding"), cosine=0.9)


SHARDS = 24


@query("op9_histogram_shards")
def histogram_sort_shards(spark: SparkSession, folder: str) -> DataFrame:
    sharded = shards.histogram_shards(table(spark, folder, "documents", "doc_id", "text"), SHARDS)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_disclosure")
def disclosure(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.find(table(spark, folder, "documents", "doc_id", "text"), carry=("doc_id",)))


def _sql_known() -> str:
    return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, _, text in licences.KNOWN)


def _sql_spelled(text: str, spellings) -> str:
    for found, used in spellings:
        text = f"regexp_replace({text}, '{found}', '{used}', 'g')"
    return text


def _sql_folded(text: str) -> str:
    """A notice goes up to the line end or the opening words, which stay as what the last group holds."""
    out = rf"regexp_replace(lower(coalesce({text}, '')), '(?m){licences.NOTICE_HEAD}(?:[^\n]*?({licences.OPENS}|\n|\z))', '\1', 'g')"
    out = rf"regexp_replace({out}, '(?m){licences.RESERVED}$', '', 'g')"
    return rf"regexp_replace({_sql_spelled(out, licences.SPELLINGS)}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def _sql_canonical(text: str) -> str:
    return _sql_spelled(rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))", licences.ACROSS_LINES)


SQL_LICENCES = rf"""
with known as (
  select distinct licence, sha256({_sql_canonical(_sql_folded('t'))}) as digest from (values {_sql_known()}) as k(licence, t)),
form as (select doc_id, {_sql_folded('text')} as f from documents),
part as (
  select distinct doc_id, unnest(list_concat(string_split_regex(f, '\n *\n'), string_split_regex(f, '\n'))) as u from form),
unit as (
  select doc_id, true as whole, sha256({_sql_canonical('f')}) as digest from form
  union all select doc_id, false, sha256({_sql_canonical('u')}) from part),
hit as (select doc_id, whole, licence from unit join known using (digest))
select doc_id, coalesce(string_agg(distinct licence, ',' order by licence), '') as licences,
  coalesce(count_if(not whole), 0)::bigint as n_matches, coalesce(bool_or(whole), false) as whole_text
from documents left join hit using (doc_id) group by doc_id
"""


@query("op1_licence_digests", SQL_LICENCES)
def licence_digests(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents", "doc_id", "text"), carry=("doc_id",))


#: The tables have no times of fetch and no lists. A page is fetched on the day of 2024 that its id gives; a host is
#: added to and removed from lists on days that its MD5 gives; known advertising hosts are listed outright.
FIXED_ENTRIES = (
    ("ads", "block", "ads-track.example.com", "2024-02-01", "add"),
    ("ads", "block", "ads-track.example.com", "2024-08-01", "remove"),
    ("ads", "block", "ads-track.example.com", "2024-09-15", "add"),
    ("partners", "allow", "example.org", "2024-11-01", "add"),
)
HEX = "(conv(substring(md5(host), {0}, 3), 16, 10))"


@query("op4_temporal_url_lists", """
with page as (
  select page_id, url, date '2024-01-01' + (page_id % 366)::int as day,
    rtrim(nullif(regexp_extract(lower(url), '^\\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''), '.') as host,
    regexp_replace(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as path from pages),
hosts as (select distinct host, ('0x' || substring(md5(host), 1, 3))::int as a, ('0x' || substring(md5(host), 4, 3))::int as b from page where host is not null),
entry as (
  select * from (values ('ads', 'block', 'ads-track.example.com', date '2024-02-01', 'add'), ('ads', 'block', 'ads-track.example.com', date '2024-08-01', 'remove'),
    ('ads', 'block', 'ads-track.example.com', date '2024-09-15', 'add'), ('partners', 'allow', 'example.org', date '2024-11-01', 'add')) as e(list_name, effect, key, day, action)
  union all select 'hosts', 'block', host, date '2024-01-01' + a % 300, 'add' from hosts where a % 4 = 0
  union all select 'hosts', 'block', host, date '2024-01-01' + a % 300 + 1 + b % 120, 'remove' from hosts where a % 4 = 0 and b % 2 = 0
  union all select 'pages', 'block', host || path, day - 1, 'add' from page where page_id % 50 = 7
  union all select 'pages', 'block', host || path, day, 'remove' from page where page_id % 100 = 7),
hit as (
  select distinct page_id, e.list_name, e.effect, s.day as since
  from page p join entry s on s.action = 'add' and s.day <= p.day
    and (p.host = s.key or p.host like '%.' || s.key or (s.key like '%/%' and p.host || p.path = s.key))
  join entry e on e.list_name = s.list_name and e.effect = s.effect and e.key = s.key and e.day = s.day and e.action = 'add'
  where not exists (select 1 from entry r where r.list_name = s.list_name and r.effect = s.effect and r.key = s.key and r.action = 'remove'
      and r.day > s.day and r.day <= p.day
      and not exists (select 1 from entry g where g.list_name = r.list_name and g.effect = r.effect and g.key = r.key and g.day = r.day and g.action = 'add')))
select p.page_id, p.host, p.day as fetched, coalesce(string_agg(distinct list_name, ',' order by list_name), '') as lists,
  coalesce(bool_or(effect = 'block'), false) and not coalesce(bool_or(effect = 'allow'), false) as blocked, min(since) as listed_since
from page p left join hit using (page_id) group by p.page_id, p.host, p.day
""")
def temporal_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    pages = table(spark, folder, "pages", "page_id", "url").withColumn("fetched", day)
    named = pages.withColumn("host", url_lists.host(F.col("url"))).withColumn("key", url_lists.address(F.col("url")))
    hosts = named.where("host is not null").select("host").distinct().select(
        "host", F.expr(f"{HEX.format(1)}").cast("int").alias("a"), F.expr(f"{HEX.format(4)}").cast("int").alias("b"))
    added = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("a") % 300).cast("int"))

    def entries(df, name, key, day, action):
        return df.select(F.lit(name).alias("list_name"), F.lit("block").alias("effect"), F.col(key).alias("key"), day.alias("day"), F.lit(action).alias("action"))

    fixed = spark.createDataFrame(FIXED_ENTRIES, "list_name string, effect string, key string, day string, action string")
    history = (
        fixed.withColumn("day", F.col("day").cast("date"))
        .union(entries(hosts.where("a % 4 = 0"), "hosts", "host", added, "add"))
        .union(entries(hosts.where("a % 4 = 0 and b % 2 = 0"), "hosts", "host", F.date_add(added, (F.col("b") % 120 + 1).cast("int")), "remove"))
        .union(entries(named.where("page_id % 50 = 7"), "pages", "key", F.date_sub("fetched", 1), "add"))
        .union(entries(named.where("page_id % 100 = 7"), "pages", "key", F.col("fetched"), "remove")))
    return url_lists.evaluate(pages, history).select("page_id", "host", "fetched", "lists", "blocked", "listed_since")


SQL_RANKED = f"""
with doc as (
  select doc_id, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') as w
  from documents),
total as (select count(*) as docs, sum(len(w))::bigint as terms from doc where len(w) > 0),
asked as (
  select distinct item_id,
    unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}')) as term from benchmark),
posting as (
  select doc_id, len(w) as n, term, count(*) as tf from doc, unnest(w) as t(term) group by doc_id, n, term),
weight as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from posting, total group by term, docs),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
  from asked join posting using (term) join weight using (term), total group by item_id, doc_id),
listed as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
  from scored where score > 0)
select * from listed where rank <= 50
"""


@query("op11_stratified_search", SQL_RANKED)
def stratified_search(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text")
    return ranked.rank_all(docs, items, top=50)


@query("op12_scaled_sketches")
def scaled_sketches(spark: SparkSession, folder: str) -> DataFrame:
    found = sketch.compare_with_next(table(spark, folder, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch.as_text(F.col("own")).alias("fingerprint"), sketch.as_text(F.col("own_edited")).alias("edited_fingerprint"),
        sketch.likeness(F.col("own"), F.col("own_edited")).alias("near_edited"),
        sketch.likeness(F.col("own"), F.col("following")).alias("near_next"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts in which, for one id in ten, the words from one place on repeat those of a period after it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    some = docs.withColumn("g", F.floor(h / 10)).withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    some = some.withColumn("a", F.expr("case when size(w) > 0 then cast(g % size(w) as int) end"))
    some = some.withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    planted = F.expr("array_join(transform(w, (x, i) -> case when i >= a then w[a + (i - a) % p] else x end), ' ')")
    return some.withColumn("text", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text"))).select(*docs.columns)


@query("op13_block_convolution_runs")
def block_convolution_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.find_runs(with_planted_runs(table(spark, folder, "documents", "doc_id", "text")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
