"""Data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebook.operators import quality as Q
from orebook.plans.registry import query


@query("dq_not_null", "select o_orderkey, o_custkey from orders where nullif(o_orderstatus, 'P') is null")
def dq_not_null(t):
    x = t.orders.select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return Q.not_null_violations(x, "status").drop("status")


@query("dq_unique", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def dq_unique(t):
    return Q.unique_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("dq_schema_contract", "select n_nationkey, n_name, n_regionkey from nation")
def dq_schema_contract(t):
    return Q.schema_contract(t.nation, ["n_nationkey", "n_name", "n_regionkey"])


@query("dq_safe_int_text", """
with x as (select cast(c_custkey as varchar) as plain, lpad(cast(c_custkey as varchar), 8, '0') as padded, cast(c_custkey + 9007199254740000 as varchar) as big,
    case when c_nationkey = 1 then 'x' || c_custkey else cast(c_custkey as varchar) end as mixed, c_mktsegment as words from customer),
 u as (unpivot x on plain, padded, big, mixed, words into name column_name value v)
select column_name, count(case when regexp_full_match(v, '-?[0-9]+') then 1 end) as digit_texts,
  coalesce(bool_and(case when regexp_full_match(v, '-?[0-9]+') then cast(cast(v as bigint) as varchar) = v and abs(cast(v as bigint)) <= 9007199254740992 end), false) as convertible,
  coalesce(bool_and(regexp_full_match(v, '-?[0-9]+')), false) as only_digits from u group by 1""")
def dq_safe_int_text(t):
    key = F.col("c_custkey").cast("string")
    x = t.customer.select(
        key.alias("plain"), F.lpad(key, 8, "0").alias("padded"), (F.col("c_custkey") + 9007199254740000).cast("string").alias("big"),
        F.when(F.col("c_nationkey") == 1, F.concat(F.lit("x"), key)).otherwise(key).alias("mixed"), F.col("c_mktsegment").alias("words"),
    )
    return Q.integer_text_columns(x, ["plain", "padded", "big", "mixed", "words"])
