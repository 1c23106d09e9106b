"""Nested documents: differences by dotted path, and masks at a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masking, nested
from ..sources.fixtures import table
from .registry import query

SALT = "documents"


def order_documents(spark, sf) -> DataFrame:
    """Orders as documents before and after a change, in JSON. Every fifth has no address, every seventh no items, every third gets another
    item, every second another status; every fourth customer moves."""
    k = F.col("o_orderkey")
    card = lambda n: F.concat(F.lit("4111-0000-0000-"), F.lpad(((k + n) % 10000).cast("string"), 4, "0"))
    item = lambda n, price: F.struct(F.lit(n).alias("line"), price.cast("long").alias("price"), card(n).alias("card"))

    def document(status, zip_code, items):
        customer = F.struct(F.concat(F.lit("c"), F.col("o_custkey"), F.lit("@mail.example")).alias("email"),
                            F.when(k % 5 != 0, F.struct(zip_code.alias("zip"))).alias("address"))
        return F.to_json(F.struct(k.alias("id"), status.alias("status"), customer.alias("customer"), F.when(k % 7 != 0, items).alias("items")))
    first, second = item(1, F.floor("o_totalprice")), item(2, k)
    zip_code = F.concat(F.lit("Z"), k)
    return table(spark, sf, "orders").select(
        k.alias("key_id"), document(F.col("o_orderstatus"), zip_code, F.array(first, second)).alias("before"),
        document(F.when(k % 2 == 0, F.concat("o_orderstatus", F.lit("2"))).otherwise(F.col("o_orderstatus")),
                 F.when(k % 4 == 0, F.concat(zip_code, F.lit("x"))).otherwise(zip_code),
                 F.when(k % 3 == 0, F.array(first, item(2, k + 1), item(3, k))).otherwise(F.array(first, second))).alias("after"))


def typed(spark, sf) -> tuple[DataFrame, object]:
    rows = order_documents(spark, sf)
    kind = nested.document_type(rows, "before", "after")
    return nested.parsed(rows, kind, "before", "after"), kind


@query("diff_nested", """
SELECT o_orderkey AS key_id, array_to_string(list_sort(list_concat(
  CASE WHEN o_orderkey % 2 = 0 THEN ['status'] ELSE [] END,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0 THEN ['customer.address.zip'] ELSE [] END,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN ['items[1].price', 'items[2].card', 'items[2].line', 'items[2].price'] ELSE [] END)), ',') AS changed
FROM orders""", shared=False)
def diff_nested(spark, sf):
    rows, kind = typed(spark, sf)
    return rows.select("key_id", F.array_join(nested.diff_nested(F.col("before"), F.col("after"), kind), ",").alias("changed"))


@query("mask_nested", f"""
SELECT o_orderkey AS key_id, substr(sha256('c' || o_custkey || '@mail.example:{SALT}'), 1, 16) AS email,
       CASE WHEN o_orderkey % 5 <> 0 THEN 'REDACTED' END AS zip,
       CASE WHEN o_orderkey % 7 <> 0 THEN 'XXXX-XXXX-XXXX-' || lpad(CAST((o_orderkey + 1) % 10000 AS VARCHAR), 4, '0') || ',XXXX-XXXX-XXXX-'
         || lpad(CAST((o_orderkey + 2) % 10000 AS VARCHAR), 4, '0') END AS cards,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS price
FROM orders""", shared=False)
def mask_nested(spark, sf):
    rows, kind = typed(spark, sf)
    masks = {"customer.email": lambda v: masking.email_hash(v, SALT), "customer.address.zip": lambda v: F.lit("REDACTED"), "items[].card": masking.redact_card}
    doc = rows.select("key_id", nested.mask_nested(F.col("before"), kind, masks).alias("d"))
    return doc.select(
        "key_id", F.col("d.customer.email").alias("email"), F.col("d.customer.address.zip").alias("zip"),
        F.when(F.col("d.items").isNotNull(), F.array_join(F.col("d.items.card"), ",")).alias("cards"), F.get(F.col("d.items"), 1)["price"].cast("long").alias("price"))
