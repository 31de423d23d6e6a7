"""Queries for projection, joins, aggregation, windows, sets and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import metrics as M
from ..sources import tables as T
from .registry import query

ACCOUNTS = """accounts AS (SELECT c_custkey AS account_id, c_name AS account_name, r_name AS region, c_mktsegment AS segment, c_acctbal AS annual_revenue_usd
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
DEALS = (
    ACCOUNTS
    + """, opportunities AS (SELECT o_orderkey AS opportunity_id, o_custkey AS account_id, stage, o_totalprice AS amount_usd, CAST(o_orderdate AS DATE) AS created_date,
 CASE WHEN stage IN ('Closed Won', 'Closed Lost') THEN CAST(o_orderdate AS DATE) END AS close_date,
 CAST(CASE stage WHEN 'Prospecting' THEN 0.1 WHEN 'Discovery' THEN 0.2 WHEN 'Evaluation' THEN 0.4 WHEN 'Proposal' THEN 0.6 WHEN 'Negotiation' THEN 0.8 WHEN 'Closed Won' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS probability, region, segment
 FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'P' THEN 'Closed Lost' ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Prospecting' WHEN '2' THEN 'Discovery' WHEN '3' THEN 'Evaluation' WHEN '4' THEN 'Proposal' ELSE 'Negotiation' END END AS stage FROM orders) o
 JOIN accounts a ON o.o_custkey = a.account_id)"""
)
WITH = f"WITH {DEALS} "


def _deals(s: SparkSession, d: str) -> DataFrame:
    return T.opportunities(s, d)


# ------------------------------------------------------------------- metrics


@query(WITH + "SELECT segment, count(*) FILTER (stage = 'Closed Won') AS won, count(*) FILTER (stage = 'Closed Lost') AS lost, round(count(*) FILTER (stage = 'Closed Won')::DOUBLE / nullif(count(*) FILTER (stage IN ('Closed Won', 'Closed Lost')), 0), 4) AS win_rate FROM opportunities GROUP BY segment")
def win_rate_by_segment(s, d):
    return M.deal_metrics(_deals(s, d), ["won", "lost", "win_rate"], ["segment"])


@query(WITH + "SELECT stage, count(*) AS deals FROM opportunities GROUP BY stage")
def stage_distribution(s, d):
    return M.deal_metrics(_deals(s, d), ["deals"], ["stage"])


@query(WITH + "SELECT region, count(*) AS deals, round(avg(amount_usd), 2) AS avg_deal_usd FROM opportunities GROUP BY region")
def region_distribution(s, d):
    return M.deal_metrics(_deals(s, d), ["deals", "avg_deal_usd"], ["region"])


@query(WITH + "SELECT year(close_date) AS year, round(sum(amount_usd), 2) AS bookings_usd FROM opportunities WHERE stage = 'Closed Won' GROUP BY 1")
def bookings_by_year(s, d):
    deals = _deals(s, d).where(M.won()).withColumn("year", F.year("close_date").cast("long"))
    return M.deal_metrics(deals, ["bookings_usd"], ["year"])


@query(WITH + "SELECT region, round(sum(amount_usd), 2) AS pipeline_usd, round(sum(amount_usd * probability), 2) AS weighted_pipeline_usd, count(*) AS open_deals FROM opportunities WHERE stage NOT IN ('Closed Won', 'Closed Lost') GROUP BY region")
def open_pipeline_by_region(s, d):
    return M.deal_metrics(_deals(s, d).where(M.open_deal()), ["pipeline_usd", "weighted_pipeline_usd", "open_deals"], ["region"])


@query(WITH + "SELECT stage, round(sum(amount_usd * probability), 2) AS weighted_pipeline_usd FROM opportunities WHERE stage NOT IN ('Closed Won', 'Closed Lost') GROUP BY stage")
def weighted_pipeline(s, d):
    return M.deal_metrics(_deals(s, d).where(M.open_deal()), ["weighted_pipeline_usd"], ["stage"])


@query(
    "SELECT p_brand AS product_code, count(*) AS lines, round(sum(l_quantity * (l_extendedprice / l_quantity) * (1 - l_discount)), 2) AS net_usd FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"
)
def net_line_value_by_product(s, d):
    return T.opp_products(s, d).groupBy("product_code").agg(F.count("*").alias("lines"), M.money(F.sum(M.net_line_value())).alias("net_usd"))


@query(
    "SELECT o_custkey AS account_id, sum(l_quantity) AS seats_purchased, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0.0 END) AS seats_active, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0.0 END) / nullif(sum(l_quantity), 0), 4) AS adoption FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey"
)
def seat_adoption(s, d):
    return M.seat_adoption(T.deployments(s, d))


@query(WITH + "SELECT segment, region, round(avg(amount_usd), 2) AS avg_deal_usd, min(amount_usd) AS least, max(amount_usd) AS most FROM opportunities GROUP BY segment, region")
def deal_size_avg(s, d):
    return _deals(s, d).groupBy("segment", "region").agg(M.money(F.avg("amount_usd")).alias("avg_deal_usd"), F.min("amount_usd").alias("least"), F.max("amount_usd").alias("most"))


@query(WITH + "SELECT count(*) FILTER (close_date >= DATE '1997-01-01' AND close_date < DATE '1998-01-01') AS closed_in, count(*) FILTER (created_date >= DATE '1997-01-01' AND created_date < DATE '1998-01-01') AS created_in FROM opportunities")
def closed_versus_created(s, d):
    year = lambda c: (F.col(c) >= F.lit("1997-01-01").cast("date")) & (F.col(c) < F.lit("1998-01-01").cast("date"))
    return _deals(s, d).agg(F.count_if(year("close_date")).alias("closed_in"), F.count_if(year("created_date")).alias("created_in"))


@query(WITH + "SELECT count(*) AS deals FROM opportunities WHERE stage = 'Closed Won' AND region = 'EUROPE' AND close_date >= DATE '1997-01-01' AND close_date < DATE '1998-01-01'")
def closed_won_count(s, d):
    return M.in_period(_deals(s, d), "won", "1997-01-01", "1998-01-01").where(M.won() & (F.col("region") == "EUROPE")).agg(F.count("*").alias("deals"))


@query(WITH + "SELECT a.segment, count(DISTINCT a.account_id) AS accounts, count(o.opportunity_id) AS deals FROM accounts a LEFT JOIN (SELECT * FROM opportunities WHERE stage = 'Closed Lost') o ON a.account_id = o.account_id GROUP BY a.segment")
def churn_by_segment(s, d):
    lost = _deals(s, d).where(M.lost()).select("account_id", "opportunity_id")
    return T.accounts(s, d).join(lost, "account_id", "left").groupBy("segment").agg(F.count_distinct("account_id").alias("accounts"), F.count("opportunity_id").alias("deals"))


# ------------------------------------------------- projection and predicates


@query("SELECT o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 300000.0")
def filter_equal_and(s, d):
    return T.load(s, d, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") >= 300000.0)).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' GROUP BY o_orderstatus")
def filter_between(s, d):
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return T.load(s, d, "orders").where(F.col("o_orderdate").between(day("1996-01-01"), day("1996-12-31"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3) GROUP BY c_mktsegment")
def filter_in_notin(s, d):
    return T.load(s, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET%' AND p_type LIKE 'ECON%'")
def filter_like(s, d):
    return T.load(s, d, "part").where(F.col("p_name").ilike("%WIDGET%") & F.col("p_type").like("ECON%")).select("p_partkey", "p_name")


@query("SELECT CASE WHEN o_totalprice >= 400000 THEN 'large' WHEN o_totalprice >= 150000 THEN 'medium' ELSE 'small' END AS bucket, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def case_buckets(s, d):
    bucket = F.when(F.col("o_totalprice") >= 400000, "large").when(F.col("o_totalprice") >= 150000, "medium").otherwise("small")
    return T.load(s, d, "orders").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), M.money(F.sum("o_totalprice")).alias("total"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_pairs(s, d):
    return T.load(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query(WITH + "SELECT count(*) FILTER (close_date IS NULL) AS open_deals, count(*) FILTER (close_date IS NOT NULL) AS closed_deals, count(close_date) AS counted FROM opportunities")
def null_tests(s, d):
    return _deals(s, d).agg(F.count_if(F.col("close_date").isNull()).alias("open_deals"), F.count_if(F.col("close_date").isNotNull()).alias("closed_deals"), F.count("close_date").alias("counted"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) - 10.0 / 4.0, 6) AS net, CAST(l_quantity AS BIGINT) // 7 AS whole, l_returnflag || '-' || l_linestatus AS code FROM lineitem WHERE l_quantity > 45")
def arithmetic_and_concat(s, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) - F.lit(10.0) / F.lit(4.0)
    return T.load(s, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", F.round(net, 6).alias("net"), F.expr("cast(l_quantity as bigint) div 7").alias("whole"), F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("code"))


@query("SELECT * FROM nation")
def select_star(s, d):
    return T.load(s, d, "nation").select("*")


# ---------------------------------------------------------------------- joins


@query("SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_inner(s, d):
    orders, customer, nation, region = (T.load(s, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n"), M.money(F.sum("o_totalprice")).alias("total"))


@query("SELECT c_custkey, count(event_id) AS n_events FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY c_custkey")
def join_left(s, d):
    events = T.load(s, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("event_id").alias("n"))
    return T.load(s, d, "customer").select("c_custkey").join(events, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_events"))


@query("SELECT c_custkey, event_id FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON c_custkey = user_id")
def join_right(s, d):
    rich = T.load(s, d, "customer").where("c_acctbal > 5000")
    return rich.join(T.load(s, d, "events").where("event_type = 'error'"), F.col("c_custkey") == F.col("user_id"), "right").select("c_custkey", "event_id")


@query("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_nationkey < 12) s FULL JOIN (SELECT * FROM customer WHERE c_nationkey > 6) c ON s_suppkey = c_custkey")
def join_full(s, d):
    left = T.load(s, d, "supplier").where("s_nationkey < 12")
    right = T.load(s, d, "customer").where("c_nationkey > 6")
    return left.join(right, F.col("s_suppkey") == F.col("c_custkey"), "outer").select("s_suppkey", "c_custkey")


@query("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def join_theta(s, d):
    a, b = T.load(s, d, "nation").alias("a"), T.load(s, d, "nation").alias("b")
    return a.join(b, F.expr("a.n_regionkey < b.n_regionkey and a.n_nationkey > b.n_nationkey")).select(F.col("a.n_name").alias("low"), F.col("b.n_name").alias("high"))


@query("SELECT r_name, seg AS segment, count(c_custkey) AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) x LEFT JOIN (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) c ON n_regionkey = r_regionkey AND c_mktsegment = seg GROUP BY r_name, seg")
def join_cross(s, d):
    """Every region and segment, also those without a customer."""
    customer = T.load(s, d, "customer").join(T.load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = customer.groupBy(F.col("n_regionkey").alias("r_regionkey"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    grid = T.load(s, d, "region").crossJoin(customer.select(F.col("c_mktsegment").alias("segment")).distinct())
    return grid.join(counts, ["r_regionkey", "segment"], "left").select("r_name", "segment", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(s, d):
    return T.load(s, d, "customer").join(T.load(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def join_anti(s, d):
    return T.load(s, d, "customer").join(T.load(s, d, "events"), F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(s, d):
    a, b = T.load(s, d, "supplier").alias("a"), T.load(s, d, "supplier").alias("b")
    return a.join(b, F.expr("a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def join_using(s, d):
    return T.load(s, d, "documents").select("doc_id", "lang").join(T.load(s, d, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("SELECT doc_id, source, toxic FROM documents NATURAL JOIN labels WHERE toxic = 1")
def join_natural(s, d):
    spark_docs, labels = T.load(s, d, "documents"), T.load(s, d, "labels")
    shared = [c for c in spark_docs.columns if c in labels.columns]
    return spark_docs.join(labels.where("toxic = 1"), shared).select("doc_id", "source", "toxic")


# ----------------------------------------------------------------- subqueries


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1.9 * (SELECT avg(o_totalprice) FROM orders)")
def subquery_scalar(s, d):
    T.load(s, d, "orders").createOrReplaceTempView("q_orders")
    return s.sql("select o_orderkey from q_orders where o_totalprice > 1.9D * (select avg(o_totalprice) from q_orders)")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def subquery_in(s, d):
    return T.load(s, d, "part").join(T.load(s, d, "lineitem").where("l_quantity = 50"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def subquery_not_in(s, d):
    T.load(s, d, "supplier").createOrReplaceTempView("q_supplier")
    T.load(s, d, "nation").createOrReplaceTempView("q_nation")
    return s.sql("select s_suppkey from q_supplier where s_nationkey not in (select n_nationkey from q_nation where n_regionkey = 1)")


@query("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def subquery_exists(s, d):
    T.load(s, d, "supplier").createOrReplaceTempView("q_supplier")
    T.load(s, d, "nation").createOrReplaceTempView("q_nation")
    return s.sql("select n_name from q_nation where exists (select 1 from q_supplier where s_nationkey = n_nationkey and s_acctbal > 9000)")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def subquery_correlated(s, d):
    T.load(s, d, "orders").createOrReplaceTempView("q_orders")
    return s.sql("select o_orderkey, o_custkey from q_orders o where o_totalprice = (select max(o_totalprice) from q_orders i where i.o_custkey = o.o_custkey)")


@query("SELECT n_orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) x GROUP BY n_orders")
def derived_table(s, d):
    per = T.load(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return per.groupBy("n_orders").agg(F.count("*").alias("customers"))


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 250000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
def cte(s, d):
    T.load(s, d, "orders").createOrReplaceTempView("q_orders")
    return s.sql("with big as (select * from q_orders where o_totalprice > 250000), per as (select o_custkey, count(*) as n from big group by o_custkey) select n, count(*) as customers from per group by n")


@query("WITH RECURSIVE m AS (SELECT DATE '1995-01-01' AS month UNION ALL SELECT CAST(month + INTERVAL 1 MONTH AS DATE) FROM m WHERE month < DATE '2001-08-01') SELECT month, count(o_orderkey) AS n FROM m LEFT JOIN orders ON CAST(date_trunc('month', o_orderdate) AS DATE) = month GROUP BY month")
def cte_recursive(s, d):
    monthly = T.load(s, d, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.count("*").alias("n"))
    monthly.createOrReplaceTempView("q_monthly")
    return s.sql(
        "with recursive m(month) as (select date'1995-01-01' union all select add_months(month, 1) from m where month < date'2001-08-01')"
        " select m.month, coalesce(n, 0L) as n from m left join q_monthly q on q.month = m.month"
    )


# ---------------------------------------------------------------- aggregation


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_extendedprice), 2) AS avg_price, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_basic(s, d):
    return T.load(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), M.money(F.sum("l_extendedprice")).alias("sum_price"), M.money(F.avg("l_extendedprice")).alias("avg_price"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.count("*").alias("n")
    )


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(o_orderkey) AS n FROM orders GROUP BY o_orderstatus")
def agg_distinct(s, d):
    return T.load(s, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.count("o_orderkey").alias("n"))


@query("SELECT event_type, count(*) FILTER (WHERE value > 20) AS high, round(avg(value) FILTER (WHERE user_id < 50), 4) AS avg_low_users FROM events GROUP BY event_type")
def agg_filter(s, d):
    T.load(s, d, "events").createOrReplaceTempView("q_events")
    return s.sql("select event_type, count(*) filter (where value > 20) as high, round(avg(value) filter (where user_id < 50), 4) as avg_low_users from q_events group by event_type")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def agg_having(s, d):
    return T.load(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@query("SELECT c_mktsegment, coalesce(sum(CASE WHEN c_acctbal < -100000 THEN c_acctbal END)::DOUBLE, 0.0::DOUBLE) AS none, round(coalesce(sum(c_acctbal)::DOUBLE, 0.0::DOUBLE), 2) AS total FROM customer GROUP BY c_mktsegment")
def agg_total(s, d):
    """TOTAL: a sum that is 0.0 where nothing is summed."""
    total = lambda x: F.coalesce(F.sum(x.cast("double")), F.lit(0.0))
    low = F.when(F.col("c_acctbal") < -100000, F.col("c_acctbal"))
    return T.load(s, d, "customer").groupBy("c_mktsegment").agg(total(low).alias("none"), M.money(total(F.col("c_acctbal"))).alias("total"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_group_concat(s, d):
    T.load(s, d, "nation").createOrReplaceTempView("q_nation")
    return s.sql("select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names from q_nation group by n_regionkey")


@query("SELECT o_orderkey, least(o_orderkey, o_custkey) AS low, greatest(o_orderkey, o_custkey) AS high FROM orders WHERE o_orderstatus = 'P'")
def scalar_min_max(s, d):
    return T.load(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.least("o_orderkey", "o_custkey").alias("low"), F.greatest("o_orderkey", "o_custkey").alias("high"))


@query(WITH + "SELECT region, sum(CASE WHEN stage = 'Closed Won' THEN 1 ELSE 0 END)::BIGINT AS won, count(CASE WHEN stage = 'Closed Lost' THEN 1 END) AS lost, round(sum(CASE WHEN stage = 'Closed Won' THEN 1.0 ELSE 0.0 END)::DOUBLE / nullif(count(CASE WHEN stage IN ('Closed Won', 'Closed Lost') THEN 1 END), 0), 4) AS rate FROM opportunities GROUP BY region")
def agg_conditional(s, d):
    return _deals(s, d).groupBy("region").agg(F.sum(F.when(M.won(), 1).otherwise(0)).alias("won"), F.count(F.when(M.lost(), 1)).alias("lost"), M.ratio(F.sum(F.when(M.won(), 1.0).otherwise(0.0)), F.count(F.when(M.won() | M.lost(), 1))).alias("rate"))


# -------------------------------------------------------------------- windows


def _by_customer(order: str = "o_orderdate") -> object:
    return Window.partitionBy("o_custkey").orderBy(F.col(order).desc() if order == "o_totalprice" else F.col(order), F.col("o_orderkey"))


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 3")
def win_row_number_topn(s, d):
    ranked = T.load(s, d, "orders").withColumn("rn", F.row_number().over(_by_customer("o_totalprice")).cast("long"))
    return ranked.where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rnk, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dense FROM part")
def win_rank_dense(s, d):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return T.load(s, d, "part").select("p_partkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"))


@query("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quartile FROM customer")
def win_ntile(s, d):
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return T.load(s, d, "customer").select("c_custkey", F.ntile(4).over(w).cast("long").alias("quartile"))


@query("SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win_lag_lead(s, d):
    w = _by_customer()
    return T.load(s, d, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2).over(w).alias("later"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS last5, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS so_far FROM events")
def win_running_rows(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return T.load(s, d, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-4, 0)), 4).alias("last5"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, min(p_size) OVER (PARTITION BY p_brand) AS least, max(p_size) OVER (PARTITION BY p_brand) AS most, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 4) AS mean FROM part")
def win_range_frame(s, d):
    brand = Window.partitionBy("p_brand")
    return T.load(s, d, "part").select(
        "p_partkey", F.count("*").over(brand.orderBy("p_size").rangeBetween(-2, 2)).alias("near"), F.min("p_size").over(brand).alias("least"), F.max("p_size").over(brand).alias("most"), F.round(F.avg("p_retailprice").over(brand), 4).alias("mean")
    )


# -------------------------------------------------------- order, limits, sets


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_total_order(s, d):
    return T.load(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(WITH + "SELECT close_date, opportunity_id FROM opportunities ORDER BY close_date NULLS FIRST, opportunity_id LIMIT 25")
def order_nulls_first(s, d):
    return _deals(s, d).select("close_date", "opportunity_id").orderBy(F.asc_nulls_first("close_date"), "opportunity_id").limit(25)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40")
def limit_offset(s, d):
    return T.load(s, d, "customer").orderBy("c_acctbal", "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


@query("SELECT r_regionkey AS k FROM region UNION SELECT n_regionkey FROM nation UNION SELECT n_nationkey FROM nation")
def set_union(s, d):
    nation = T.load(s, d, "nation")
    return T.load(s, d, "region").select(F.col("r_regionkey").alias("k")).union(nation.select("n_regionkey")).union(nation.select("n_nationkey")).distinct()


@query("SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) x GROUP BY k")
def set_union_all(s, d):
    both = T.load(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(T.load(s, d, "supplier").select("s_nationkey"))
    return both.groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT user_id FROM events")
def set_intersect(s, d):
    return T.load(s, d, "customer").select(F.col("c_custkey").alias("k")).intersect(T.load(s, d, "events").select("user_id"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_except(s, d):
    return T.load(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(T.load(s, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"))
