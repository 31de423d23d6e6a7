"""Base tables and the business views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Funnel stages in order, and the probability given to each.
OPEN_STAGES = ("Prospecting", "Discovery", "Evaluation", "Proposal", "Negotiation")
STAGES = (*OPEN_STAGES, "Closed Won", "Closed Lost")
PROBABILITY = {"Prospecting": 0.1, "Discovery": 0.2, "Evaluation": 0.4, "Proposal": 0.6, "Negotiation": 0.8, "Closed Won": 1.0, "Closed Lost": 0.0}

#: table -> its columns
COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}

#: from table, column -> referenced table, column
FOREIGN_KEYS = {
    ("nation", "n_regionkey"): ("region", "r_regionkey"),
    ("customer", "c_nationkey"): ("nation", "n_nationkey"),
    ("supplier", "s_nationkey"): ("nation", "n_nationkey"),
    ("orders", "o_custkey"): ("customer", "c_custkey"),
    ("lineitem", "l_orderkey"): ("orders", "o_orderkey"),
    ("lineitem", "l_partkey"): ("part", "p_partkey"),
    ("lineitem", "l_suppkey"): ("supplier", "s_suppkey"),
    ("labels", "doc_id"): ("documents", "doc_id"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stage() -> Column:
    out = F.when(F.col("o_orderstatus") == "F", "Closed Won").when(F.col("o_orderstatus") == "P", "Closed Lost")
    for k, stage in enumerate(OPEN_STAGES, 1):
        out = out.when(F.substring("o_orderpriority", 1, 1) == str(k), stage)
    return out


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("annual_revenue_usd"),
    )


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One deal for each order; a deal without a close date is open."""
    probability = F.create_map(*(F.lit(x) for pair in PROBABILITY.items() for x in pair))
    deals = load(spark, sf_dir, "orders").withColumn("stage", _stage())
    closed = F.col("stage").isin("Closed Won", "Closed Lost")
    deals = deals.select(
        F.col("o_orderkey").alias("opportunity_id"),
        F.col("o_custkey").alias("account_id"),
        "stage",
        F.col("o_totalprice").alias("amount_usd"),
        F.to_date("o_orderdate").alias("created_date"),
        F.when(closed, F.to_date("o_orderdate")).alias("close_date"),
        probability[F.col("stage")].alias("probability"),
    )
    return deals.join(accounts(spark, sf_dir).select("account_id", "region", "segment"), "account_id")


def opp_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("opportunity_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("p_brand").alias("product_code"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price_usd"),
        (F.col("l_discount") + F.lit(0.0)).alias("discount_pct"),
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats of each customer; line quantities are summed before the join to
    customers needs them."""
    line, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    joined = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    active = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)
    return joined.groupBy(F.col("o_custkey").alias("account_id")).agg(F.sum("l_quantity").alias("seats_purchased"), F.sum(active).alias("seats_active"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("activity_id"), F.col("user_id").alias("account_id"), F.col("event_type").alias("activity_type"), "ts", "value", "props")


VIEWS = {"accounts": accounts, "opportunities": opportunities, "opp_products": opp_products, "deployments": deployments, "activities": activities}


def register_views(spark: SparkSession, sf_dir: str, scope: dict[str, list[str] | None] | None = None) -> None:
    """Temp views under their names; ``scope`` (region, segment -> allowed
    values, None for all) filters every view by the accounts it may show."""
    scope = {k: v for k, v in (scope or {}).items() if v is not None}
    for name, make in VIEWS.items():
        view = make(spark, sf_dir)
        if scope:
            allowed = accounts(spark, sf_dir)
            for column, values in scope.items():
                allowed = allowed.where(F.col(column).isin(*values)) if values else allowed.where(F.lit(False))
            if name == "accounts":
                view = allowed
            elif "account_id" in view.columns:
                view = view.join(allowed.select("account_id"), "account_id", "left_semi")
            else:
                deals = opportunities(spark, sf_dir).join(allowed.select("account_id"), "account_id", "left_semi")
                view = view.join(deals.select("opportunity_id"), "opportunity_id", "left_semi")
        view.createOrReplaceTempView(name)
