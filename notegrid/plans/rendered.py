"""A wiki rendered from relational tables: notes of parts, customers and orders.

It gives the wiki operators an input whose every result can be computed in SQL
from the tables. Text is assembled by column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from notegrid.sources.tables import table


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def part_notes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    p = p.select(F.col("p_partkey").alias("k"), F.col("p_type").alias("t"), brand.alias("b"), "p_size", "p_name")
    p = p.withColumn("key", _text("parts/", F.col("t"), "/", F.col("b"), "/P", _s("k")))
    by_key = p.select(F.col("k").alias("to"), F.col("key").alias("to_key"))
    to = F.when(F.col("k") % 100 == 7, F.col("k") + 1).when(F.col("k") % 100 == 8, F.col("k") - 1).when((F.col("k") % 11 == 1) & (F.col("k") > 1), F.expr("k div 2"))
    p = p.withColumn("to", to).join(by_key, "to", "left")
    body = _text(
        "# P", _s("k"), "\n\n#[[catalog/", F.col("t"), "/", F.col("b"), "]]\n\n", F.when(F.col("p_size") > 25, "## Spec").otherwise("## Notes"), "\n\n", F.col("p_name"), "\n",
        F.when(F.col("p_size") % 10 == 0, _text("\nSee also [[", F.col("key"), "]]\n")).otherwise(""),
        F.when(F.col("k") % 7 == 0, _text("\n![img](https://img.example.com/p", _s("k"), ".png)\n")).otherwise(""),
        F.when(F.col("k") % 5 == 0, _text("\n```sql\nselect '[[not/a/link]]', ", _s("k"), "\n```\n")).otherwise(""),
        F.when(F.col("to_key").isNotNull(), _text("\n![[", F.col("to_key"), "]]\n")).otherwise(""),
    )
    return p.select(_text("P", _s("k")).alias("title"), F.array(F.lit("parts"), "t", "b").alias("ctx"), body.alias("md_text"), F.lit(None).cast("bigint").alias("committed_ts"))


def customer_notes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_custkey % 10 <> 0")
    body = _text("# C", _s("c_custkey"), "\n\n#[[segment/", F.col("c_mktsegment"), "]]\n")
    return c.select(_text("C", _s("c_custkey")).alias("title"), F.lit(None).cast("array<string>").alias("ctx"), body.alias("md_text"), F.lit(None).cast("bigint").alias("committed_ts"))


def order_notes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), _text("parts/", F.col("p_type"), "/", F.replace("p_brand", F.lit("#"), F.lit("")), "/P", _s("p_partkey")).alias("pk"))
    line = table(spark, d, "lineitem").join(part, "l_partkey")
    mark = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_linestatus") == "F", "x").otherwise(" ")
    shown = _text("- [", mark, "] ship [[", F.col("pk"), "#Spec]] qty ", F.col("l_quantity").cast("int").cast("string"), "\n")
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*order, shown.alias("text")))).alias("x"))
    o = table(spark, d, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    body = _text(
        "# O", _s("o_orderkey"), "\n\n#[[status/", F.col("o_orderstatus"), "]] #[[priority/", F.substring("o_orderpriority", 1, 1), "]]\n\nCustomer [[C", _s("o_custkey"), "|buyer]]\n\n## Lines\n",
        F.when(F.col("x").isNotNull(), F.concat(F.lit("\n"), F.array_join("x.text", ""))).otherwise(""),
        F.when((F.col("o_orderkey") % 3 == 0) & F.col("x").isNotNull(), _text("\n![[", F.regexp_extract(F.get("x.text", F.lit(0)), r"\[\[(.*)#Spec", 1), "#Spec]]\n")).otherwise(""),
    )
    return o.select(_text("O", _s("o_orderkey")).alias("title"), F.array(F.lit("orders"), "o_orderstatus").alias("ctx"), body.alias("md_text"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("committed_ts"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    return part_notes(spark, d).unionByName(customer_notes(spark, d)).unionByName(order_notes(spark, d))
