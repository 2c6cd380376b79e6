"""One DataFrame query per relational operator, over whole tables.

Plans are left to Catalyst: filters and column lists reach the scans, joins
take the strategy that statistics allow, aggregates combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialecta.registry import query
from dialecta.tables import read_table


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, d, n) for n in names]


def _money(c) -> F.Column:
    return F.round(c, 2)


def _revenue() -> F.Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))

# --- projection and predicates


@query("SELECT p_partkey, p_name, p_size * 2 AS twice FROM part WHERE p_size > 25 AND p_brand <> 'Brand#11'")
def filter_project(spark, d):
    (p,) = _t(spark, d, "part")
    return p.where((F.col("p_size") > 25) & (F.col("p_brand") != "Brand#11")).select("p_partkey", "p_name", (F.col("p_size") * 2).alias("twice"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_rows(spark, d):
    return _t(spark, d, "customer")[0].select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus LIKE 'F%'")
def in_between_like(spark, d):
    o = _t(spark, d, "orders")[0]
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_totalprice").between(1000, 200000) & F.col("o_orderstatus").like("F%")).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE p_type ILIKE '%brass%' OR p_name ILIKE '%a%'")
def ilike(spark, d):
    return _t(spark, d, "part")[0].where(F.col("p_type").ilike("%brass%") | F.col("p_name").ilike("%a%")).select("p_partkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer")
def case_expr(spark, d):
    a = F.col("c_acctbal")
    return _t(spark, d, "customer")[0].select("c_custkey", F.when(a < 0, "debt").when(a < 5000, "low").otherwise("high").alias("band"))


@query("SELECT request_id, object_type IS NULL AS no_type, coalesce(object_type, 'none') AS kind FROM (SELECT DISTINCT request_id, object_type FROM transpile_requests)")
def null_predicates(spark, d):
    r = _t(spark, d, "transpile_requests")[0].select("request_id", "object_type").distinct()
    return r.select("request_id", F.col("object_type").isNull().alias("no_type"), F.coalesce("object_type", F.lit("none")).alias("kind"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def try_cast_json(spark, d):
    return _t(spark, d, "events")[0].select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


# --- joins


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_inner(spark, d):
    o, c, n = _t(spark, d, "orders", "customer", "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY 1")
def join_left(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o.where("o_orderstatus = 'O'"), c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, d):
    s, n = _t(spark, d, "supplier", "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").select("s_suppkey", "n_name")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def join_full(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    a = c.where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    b = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "k", "full")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    r, n = _t(spark, d, "region", "nation")  # both of fixed size
    return r.crossJoin(F.broadcast(n)).select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_semi_exists(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o.where("o_totalprice > 100000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def join_semi_in(spark, d):
    p, li = _t(spark, d, "part", "lineitem")
    return p.join(li.where("l_quantity > 45"), p.p_partkey == li.l_partkey, "left_semi").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def join_anti(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o.where("o_totalprice > 450000"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def join_not_in_nullaware(spark, d):
    s, c = _t(spark, d, "supplier", "customer")
    s.createOrReplaceTempView("nia_supplier")
    c.createOrReplaceTempView("nia_customer")
    return spark.sql("SELECT s_suppkey FROM nia_supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM nia_customer WHERE c_acctbal > 9900)")


_RANGE_SQL = "SELECT p.p_partkey, count(*) AS n_cheaper FROM part p JOIN part q ON p.p_brand = q.p_brand AND q.p_retailprice < p.p_retailprice AND q.p_retailprice >= p.p_retailprice - 50 GROUP BY 1"


@query(_RANGE_SQL)
def join_range(spark, d):
    """Pairs are counted, never made: each distinct price of a brand asks how many rows lie below it and how many below its lower bound.

    Rows are counted by running sums in cells wider than the range, so a question concerns its own cell and the one before only.
    """
    width, cell = 50.0, 64.0  # a power of two: cells are exact, and a lower bound is at most one cell away
    p = _t(spark, d, "part")[0].select("p_partkey", "p_brand", "p_retailprice").where("p_brand is not null and p_retailprice is not null and not isnan(p_retailprice)")  # no others pair
    cell_of = lambda c: F.floor(c / cell)
    prices = p.groupBy(F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price")).agg(F.count("*").alias("n"))
    low = F.col("price") - width
    itself = F.struct(F.col("price").alias("at"), cell_of(F.col("price")).alias("cell"), F.col("n").alias("n"), F.lit(1).alias("side"))
    bound = F.struct(low.alias("at"), cell_of(low).alias("cell"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("side"))
    asked = prices.select("brand", "price", F.inline(F.array(itself, bound)))
    w = Window.partitionBy("brand", "cell").orderBy("at", "side")  # a bound comes before the rows of its price
    asked = asked.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "in_cell": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    # rows below the price in its cell, less those below the bound; a bound in the cell before brings the rest of that cell
    share = F.when(F.col("side") == 1, F.col("upto") - F.col("n")).when(F.col("cell") == cell_of(F.col("price")), -F.col("upto")).otherwise(F.col("in_cell") - F.col("upto"))
    cheaper = asked.select("brand", "price", share.alias("n")).groupBy("brand", "price").agg(F.sum("n").alias("n")).where("n > 0")
    return p.join(cheaper, (p.p_brand == cheaper.brand) & (p.p_retailprice == cheaper.price)).groupBy("p_partkey").agg(F.sum("n").alias("n_cheaper"))


@query("SELECT o_orderkey, word FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS word FROM orders)")
def join_lateral_explode(spark, d):
    return _t(spark, d, "orders")[0].select("o_orderkey", F.explode(F.split("o_orderpriority", "-")).alias("word"))


@query("SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON md5('c' || c_custkey) = md5('c' || o_custkey) GROUP BY 1")
def join_expression_key(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    key = lambda k: F.md5(F.concat(F.lit("c"), F.col(k).cast("string")))
    return c.join(o, key("c_custkey") == key("o_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("SELECT e.event_id, max(o.o_orderdate) AS last_order FROM events e JOIN orders o ON e.user_id = o.o_custkey AND o.o_orderdate <= e.ts GROUP BY 1")
def join_asof(spark, d):
    """The latest order of a user before each event: one sorted pass over the union, no pair join."""
    e, o = _t(spark, d, "events", "orders")
    both = e.select(F.col("user_id").alias("k"), "ts", "event_id", F.lit(None).cast("timestamp_ntz").alias("od"), F.lit(1).alias("side")).unionByName(
        o.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderdate").alias("od"), F.lit(0).alias("side"))
    )
    w = Window.partitionBy("k").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("last_order", F.last("od", True).over(w)).where("side = 1 and last_order is not null").select("event_id", "last_order")


# --- aggregation


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def agg_basic(spark, d):
    li = _t(spark, d, "lineitem")[0].where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), _money(F.sum("l_extendedprice")).alias("price"), F.round(F.avg("l_discount"), 6).alias("disc"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
    )


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1")
def agg_distinct(spark, d):
    return _t(spark, d, "orders")[0].groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("n_customers"))


@query("SELECT l_suppkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned, count(*) FILTER (WHERE l_quantity > 30) AS big FROM lineitem GROUP BY 1")
def agg_conditional(spark, d):
    return _t(spark, d, "lineitem")[0].groupBy("l_suppkey").agg(F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"), F.count_if(F.col("l_quantity") > 30).alias("big"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def agg_having(spark, d):
    return _t(spark, d, "orders")[0].groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def agg_grouping_sets(spark, d):
    c = _t(spark, d, "customer")[0]
    return c.groupingSets([[c.c_mktsegment], [c.c_nationkey], []], c.c_mktsegment, c.c_nationkey).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d):
    return _t(spark, d, "orders")[0].rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return _t(spark, d, "lineitem")[0].cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines, count(*) FILTER (WHERE l_linestatus = 'F') AS done_lines FROM lineitem GROUP BY 1")
def agg_pivot(spark, d):
    p = _t(spark, d, "lineitem")[0].groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1)))
    return p.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("open_lines"), F.coalesce("F", F.lit(0)).alias("done_lines"))


@query("SELECT p_partkey, 'p_size' AS field, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot(spark, d):
    p = _t(spark, d, "part")[0].select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return p.unpivot("p_partkey", ["p_size", "p_retailprice"], "field", "amount")


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def agg_listagg(spark, d):
    r, n = _t(spark, d, "region", "nation")
    joined = r.join(n, r.r_regionkey == n.n_regionkey)
    return joined.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


@query("SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer GROUP BY 1")
def agg_array(spark, d):
    return _t(spark, d, "customer")[0].groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def agg_percentile(spark, d):
    p = lambda q: F.round(F.percentile("o_totalprice", F.lit(q)), 4)
    return _t(spark, d, "orders")[0].groupBy("o_orderpriority").agg(p(0.5).alias("median"), p(0.9).alias("p90"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_done, bool_and(o_totalprice > 1000) AS all_big FROM orders GROUP BY 1")
def agg_bool(spark, d):
    return _t(spark, d, "orders")[0].groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_done"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_big"))


@query("SELECT c_nationkey, round(sum(c_acctbal) / nullif(count(*) FILTER (WHERE c_acctbal < 0), 0), 4) AS ratio FROM customer GROUP BY 1")
def agg_safe_divide(spark, d):
    ratio = F.try_divide(F.sum("c_acctbal"), F.count_if(F.col("c_acctbal") < 0))
    return _t(spark, d, "customer")[0].groupBy("c_nationkey").agg(F.round(ratio, 4).alias("ratio"))


@query("SELECT l_linenumber, count(DISTINCT l_partkey) > 0 AS close FROM lineitem GROUP BY 1")
def agg_approx_distinct(spark, d):
    """Whether the estimate is within a tenth of the exact number, for each line number."""
    li = _t(spark, d, "lineitem")[0].groupBy("l_linenumber").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("e"))
    return li.select("l_linenumber", F.col("a").between(F.col("e") * 0.9, F.col("e") * 1.1).alias("close"))


@query("SELECT l_suppkey % 100 AS bucket, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def agg_statistics(spark, d):
    return _t(spark, d, "lineitem")[0].groupBy((F.col("l_suppkey") % 100).alias("bucket")).agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


# --- windows


def _by_customer(*order) -> Window:
    return Window.partitionBy("o_custkey").orderBy(*order)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def win_row_number(spark, d):
    return _t(spark, d, "orders")[0].select("o_orderkey", F.row_number().over(_by_customer("o_orderdate", "o_orderkey")).alias("rn"))


@query("SELECT p_partkey, rank() OVER w AS rk, dense_rank() OVER w AS drk, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def win_rank(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return _t(spark, d, "part")[0].select("p_partkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("drk"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quartile FROM customer")
def win_ntile(spark, d):
    return _t(spark, d, "customer")[0].select("c_custkey", F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).alias("quartile"))


@query("SELECT o_orderkey, lag(o_totalprice) OVER w AS before_, lead(o_totalprice, 2, -1.0) OVER w AS after_ FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win_lag_lead(spark, d):
    w = _by_customer("o_orderdate", "o_orderkey")
    return _t(spark, d, "orders")[0].select("o_orderkey", F.lag("o_totalprice").over(w).alias("before_"), F.lead("o_totalprice", 2, -1.0).over(w).alias("after_"))


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_, last_value(o_orderkey) OVER w AS last_, nth_value(o_orderkey, 2) OVER w AS second_ FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_first_last(spark, d):
    w = _by_customer("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _t(spark, d, "orders")[0].select("o_orderkey", F.first("o_orderkey").over(w).alias("first_"), F.last("o_orderkey").over(w).alias("last_"), F.nth_value("o_orderkey", 2).over(w).alias("second_"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS so_far FROM orders")
def win_running(spark, d):
    return _t(spark, d, "orders")[0].select("o_orderkey", _money(F.sum("o_totalprice").over(_by_customer("o_orderdate"))).alias("so_far"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean3 FROM orders")
def win_rows_frame(spark, d):
    return _t(spark, d, "orders")[0].select("o_orderkey", F.round(F.avg("o_totalprice").over(_by_customer("o_orderdate", "o_orderkey").rowsBetween(-2, 0)), 4).alias("mean3"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events")
def win_range_frame(spark, d):
    read_table(spark, d, "events").createOrReplaceTempView("wrf_events")
    return spark.sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM wrf_events")


@query("SELECT n_name, n, rank() OVER (ORDER BY n DESC) AS rk FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def win_over_aggregate(spark, d):
    c, n = _t(spark, d, "customer", "nation")
    per = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"))
    return per.withColumn("rk", F.rank().over(Window.orderBy(F.desc("n"))))  # one row per nation


@query("SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 8) AS share FROM customer")
def win_ratio(spark, d):
    return _t(spark, d, "customer")[0].select("c_custkey", F.round(F.col("c_acctbal") / F.sum("c_acctbal").over(Window.partitionBy("c_nationkey")), 8).alias("share"))


@query("SELECT o_orderkey, k FROM (SELECT o_orderkey, (SELECT count(DISTINCT i.o_orderstatus) FROM orders i WHERE i.o_custkey = o.o_custkey) AS k FROM orders o)")
def win_count_distinct(spark, d):
    return _t(spark, d, "orders")[0].select("o_orderkey", F.size(F.collect_set("o_orderstatus").over(Window.partitionBy("o_custkey"))).cast("long").alias("k"))


# --- sort, limit, top-k


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(spark, d):
    return _t(spark, d, "orders")[0].select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")
def limit_offset(spark, d):
    return _t(spark, d, "orders")[0].orderBy(F.desc("o_totalprice"), "o_orderkey").offset(30).limit(10).select("o_orderkey")


@query("SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def top_k_per_group(spark, d):
    rn = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return _t(spark, d, "customer")[0].select("c_nationkey", "c_custkey", rn.alias("rn")).where("rn <= 3")


@query("SELECT fk_id, row_number() OVER (ORDER BY on_delete ASC NULLS FIRST, fk_id) AS pos FROM (SELECT DISTINCT fk_id, on_delete FROM ir_foreign_keys) ORDER BY pos LIMIT 50")
def nulls_first(spark, d):
    f = _t(spark, d, "ir_foreign_keys")[0].select("fk_id", "on_delete").distinct().orderBy(F.asc_nulls_first("on_delete"), "fk_id").limit(50)
    return f.select("fk_id", F.row_number().over(Window.orderBy(F.asc_nulls_first("on_delete"), "fk_id")).alias("pos"))


# --- set operations and subqueries


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).unionAll(s.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return union_all(spark, d).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return c.where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def except_rows(spark, d):
    n, s = _t(spark, d, "nation", "supplier")
    return n.select(F.col("n_nationkey").alias("k")).subtract(s.where("s_acctbal > 8000").select("s_nationkey"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)")
def scalar_subquery(spark, d):
    _t(spark, d, "orders")[0].createOrReplaceTempView("ssq_orders")
    return spark.sql("SELECT o_orderkey FROM ssq_orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM ssq_orders)")


@query("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")
def recursive_cte(spark, d):
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")


# --- scalar functions


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, date_diff('month', TIMESTAMP '1992-01-01', o_orderdate) AS months, (o_orderdate + INTERVAL 45 DAY)::DATE AS due, year(o_orderdate) AS y, last_day(o_orderdate) AS eom FROM orders")
def date_functions(spark, d):
    o = F.col("o_orderdate")
    months = (F.year(o) * 12 + F.month(o)) - (1992 * 12 + 1)
    return _t(spark, d, "orders")[0].select("o_orderkey", F.date_trunc("month", o).cast("date").alias("month"), months.alias("months"), F.date_add(o.cast("date"), 45).alias("due"), F.year(o).alias("y"), F.last_day(o).alias("eom"))


@query("SELECT p_partkey, upper(p_name) AS u, substr(p_brand, 1, 5) AS b, length(p_type) AS n, replace(p_type, ' ', '_') AS t, lpad(p_partkey::VARCHAR, 8, '0') AS k, split_part(p_brand, '#', 2) AS no, md5(p_name) AS h FROM part")
def string_functions(spark, d):
    return _t(spark, d, "part")[0].select(
        "p_partkey", F.upper("p_name").alias("u"), F.substring("p_brand", 1, 5).alias("b"), F.length("p_type").alias("n"), F.replace(F.col("p_type"), F.lit(" "), F.lit("_")).alias("t"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("k"), F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).alias("no"), F.md5("p_name").alias("h"),
    )


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS r, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, p_size % 7 AS m, abs(p_size - 25) AS a, round(ln(p_size), 8) AS l FROM part")
def math_functions(spark, d):
    return _t(spark, d, "part")[0].select(
        "p_partkey", F.round(F.sqrt("p_retailprice"), 6).alias("r"), F.floor("p_retailprice").cast("double").alias("f"), F.ceil("p_retailprice").cast("double").alias("c"),
        (F.col("p_size") % 7).alias("m"), F.abs(F.col("p_size") - 25).alias("a"), F.round(F.log("p_size"), 8).alias("l"),
    )


@query("SELECT DISTINCT table_id, len(columns) AS n, columns[1].name AS first_col, list_contains(primary_key, columns[1].name) AS keyed FROM ir_tables")
def array_functions(spark, d):
    t = _t(spark, d, "ir_tables")[0]
    return t.select("table_id", F.size("columns").alias("n"), F.col("columns")[0]["name"].alias("first_col"), F.array_contains("primary_key", F.col("columns")[0]["name"]).alias("keyed")).distinct()


@query("SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, regexp_extract(p_type, '^(\\w+)', 1) AS head FROM part")
def regex_functions(spark, d):
    return _t(spark, d, "part")[0].select("p_partkey", F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"), F.regexp_extract("p_type", r"^(\w+)", 1).alias("head"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def variant_path(spark, d):
    v = F.parse_json("props")
    return _t(spark, d, "events")[0].select("event_id", F.variant_get(v, "$.k", "int").alias("k"))


@query("SELECT l_returnflag, count(*) AS n, count(*) > 0 AS close FROM lineitem GROUP BY 1")
def table_sample(spark, d):
    """For each return flag all rows, and whether a seeded sample of half the rows holds its share of them."""
    li = _t(spark, d, "lineitem")[0].groupBy("l_returnflag").agg(F.count("*").alias("n"))
    drawn = _t(spark, d, "lineitem")[0].sample(0.5, seed=7).groupBy("l_returnflag").agg(F.count("*").alias("k"))
    return li.join(drawn, "l_returnflag").select("l_returnflag", "n", (F.abs(F.col("k") / F.col("n") - 0.5) < 3 / F.sqrt("n")).alias("close"))


# --- star queries


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def star_revenue(spark, d):
    c, o, li, s, n, r = _t(spark, d, "customer", "orders", "lineitem", "supplier", "nation", "region")
    nations = n.join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name")
    when = o.where("o_orderdate >= timestamp_ntz'1994-01-01' and o_orderdate < timestamp_ntz'1996-01-01'")
    lines = when.join(li, o.o_orderkey == li.l_orderkey).join(c, o.o_custkey == c.c_custkey)
    own = lines.join(s, (li.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).join(nations, s.s_nationkey == nations.n_nationkey)
    return own.groupBy("n_name").agg(_money(F.sum(_revenue())).alias("revenue"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def star_priority(spark, d):
    o, li = _t(spark, d, "orders", "lineitem")
    return o.join(li.where("l_returnflag = 'R'"), o.o_orderkey == li.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY revenue DESC, 1 LIMIT 10")
def star_top_orders(spark, d):
    c, o, li = _t(spark, d, "customer", "orders", "lineitem")
    j = c.where("c_mktsegment = 'BUILDING'").join(o, c.c_custkey == o.o_custkey).join(li, li.l_orderkey == o.o_orderkey)
    return j.groupBy("o_orderkey").agg(_money(F.sum(_revenue())).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)
