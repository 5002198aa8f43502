"""Queries on changes of tables and on their reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import tables as R
from weftline.plans.registry import query
from weftline.session import table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("mark"), F.col("o_totalprice").alias("cache"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'updated' ELSE o_orderpriority END AS mark, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS cache FROM orders""")
def upsert_orders(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    new = orders.filter("o_orderstatus = 'O'")
    twice = new.select("o_orderkey", F.lit("older").alias("mark"), F.lit(1).alias("turn")).unionByName(new.select("o_orderkey", F.lit("updated").alias("mark"), F.lit(2).alias("turn")))
    return R.upsert(orders.drop("o_orderstatus"), twice, ["o_orderkey"], ["cache"], F.col("turn")).select("o_orderkey", "mark", "cache")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 1000000, 'NEW', NULL, NULL""")
def set_fields(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    new = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.upper("s_name")).alias("s_name")).unionByName(spark.sql("SELECT CAST(1000000 AS bigint) AS s_suppkey, 'NEW' AS s_name"))
    return R.set_fields(s, new, ["s_suppkey"])


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL ELSE s_name END AS s_name, CASE s_suppkey % 4 WHEN 1 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier""")
def set_given_fields(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    turn = F.col("s_suppkey") % 4
    given = F.when(turn == 0, F.array(F.lit("s_name"))).when(turn == 1, F.array(F.lit("s_acctbal"))).otherwise(F.array().cast("array<string>"))
    new = s.select("s_suppkey", F.lit(None).cast("string").alias("s_name"), F.lit(0.0).alias("s_acctbal"), given.alias("given"))
    return R.set_fields(s, new, ["s_suppkey"], "given")


@query("""SELECT l_orderkey, l_linenumber, any_value(l_returnflag) AS state, 'new/' || l_orderkey AS path FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 'kept' END AS l_returnflag FROM lineitem) GROUP BY ALL""")
def upsert_children(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    old = keys.filter("l_orderkey % 2 = 0").select("*", F.lit("kept").alias("state"), F.lit("old").alias("path"))
    new = keys.withColumn("path", F.concat(F.lit("new/"), F.col("l_orderkey").cast("string")))
    return R.upsert_children(old, new, ["l_orderkey", "l_linenumber"], ["path"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END AS cache FROM orders""")
def update_existing(spark, sf_dir):
    orders = _orders(spark, sf_dir).select("o_orderkey", "cache")
    new = orders.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit(0.0).alias("cache")).unionByName(spark.sql("SELECT CAST(-1 AS bigint) AS o_orderkey, 1.0D AS cache"))
    return R.update_existing(orders, new, ["o_orderkey"])


@query("""WITH p AS (SELECT p_partkey, p_name FROM part), o AS (SELECT * FROM p WHERE p_partkey % 40 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS r FROM p WHERE p_partkey % 40 <> 0)
SELECT * FROM o UNION ALL SELECT p_partkey, p_name FROM n WHERE r = 1 AND lower(trim(p_name)) NOT IN (SELECT lower(trim(p_name)) FROM o)""")
def insert_absent(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return R.insert_absent(p.filter("p_partkey % 40 = 0"), p.filter("p_partkey % 40 <> 0"), F.lower(F.trim("p_name")), ["p_partkey"])


@query("""WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN 'w' || p_partkey END AS work FROM part), b AS (SELECT p_name, max(p_partkey) AS k FROM p WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT p.work, p.p_name, p.p_partkey AS given, coalesce(CASE WHEN p.work IS NOT NULL AND p.p_partkey % 2 = 0 THEN p.p_partkey END, b.k) AS p_partkey FROM p LEFT JOIN b USING (p_name)""")
def match_two_ways(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("w"), F.col("p_partkey").cast("string"))).alias("work"))
    return R.match_two_ways(p.withColumnRenamed("p_partkey", "given"), p.filter("p_partkey % 2 = 0"), "work", "p_name", "p_partkey")


@query("SELECT o_orderkey, o_orderpriority AS mark, CAST(NULL AS DOUBLE) AS cache FROM orders")
def set_null(spark, sf_dir):
    return R.set_null(_orders(spark, sf_dir).drop("o_orderstatus"), ["cache"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN year(o_orderdate) END AS year FROM orders WHERE o_orderkey % 7 = 0 OR year(o_orderdate) BETWEEN 1995 AND 1998")
def keep_range(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.year("o_orderdate")).alias("year"))
    return R.keep_range(rows, "year", 1995, 1998)


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey % 4 = 0 AND l_linenumber > 1) UNION ALL SELECT DISTINCT l_orderkey, 9 FROM lineitem WHERE l_orderkey % 4 = 0) GROUP BY ALL""")
def replace_parts(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    new = line.filter("l_orderkey % 4 = 0").select("l_orderkey", F.lit(9).alias("l_linenumber")).distinct()
    return R.replace_parts(line, new, ["l_orderkey"], F.col("l_linenumber") > 1).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'changed' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 3 <> 2 UNION ALL SELECT 1000000, 'added'")
def apply_operations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    turn = F.col("s_suppkey") % 3
    ops = s.filter(turn > 0).select("s_suppkey", F.when(turn == 1, "changed").alias("s_name"), F.when(turn == 1, "update").otherwise("delete").alias("operation"))
    return R.apply_operations(s, ops.unionByName(spark.sql("SELECT CAST(1000000 AS bigint) AS s_suppkey, 'added' AS s_name, 'add' AS operation")), ["s_suppkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'c_name,c_mktsegment' WHEN c_custkey % 2 = 0 THEN 'c_name' ELSE 'c_mktsegment' END AS changed FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def changed_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "x").otherwise(F.concat(F.lit(" "), F.col("c_name"))).alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return R.changed_fields(c, new, ["c_custkey"], ["c_name", "c_mktsegment"]).withColumn("changed", F.array_join("changed", ","))


@query("""WITH w AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) SELECT c_custkey, coalesce(v, c_acctbal) AS score FROM customer LEFT JOIN w ON o_custkey = c_custkey""")
def last_writer(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("score"))
    writes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("score"))
    return R.last_writer(base, writes, ["c_custkey"], "o_orderkey", "score")


@query("""SELECT k, min(turn) AS turn FROM (SELECT s_nationkey AS k, 'supplier' AS turn FROM supplier UNION ALL SELECT c_nationkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'supplier' ELSE 'z customer' END FROM customer) GROUP BY 1""")
def union_once(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("turn"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("z customer").alias("turn"))
    return R.union_once([s, c], "k")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042'")
def point_lookup(spark, sf_dir):
    return R.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), c_name="Customer#000000042")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def fetch_by_list(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    return R.fetch(table(spark, sf_dir, "orders"), "o_custkey", wanted).select("o_orderkey", "o_totalprice")


@query("SELECT event_id FROM events WHERE (event_type = 'click' OR event_type IS NULL) AND user_id % 2 = 0 ORDER BY event_id LIMIT 200")
def pending_work(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "click", "pending").when(F.col("event_type").isNotNull(), "done"))
    return R.pending(e, F.col("status"), F.col("user_id") % 2 == 0, "event_id", 200).select("event_id")


@query("""SELECT CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS ordinal, s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey % 2 = 0 QUALIFY TRUE""")
def ordered_fetch(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").filter("s_nationkey % 2 = 0")
    scored = s.select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("n_nationkey"))
    # One list of a bounded size: the suppliers of a request.
    listed = scored.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")))
    return R.ordered_fetch(listed, table(spark, sf_dir, "nation"), "n_nationkey").select("ordinal", "s_suppkey", "n_name")


@query("SELECT lower(c_name) AS c_name, c_custkey % 2 = 0 AS known FROM customer")
def split_known(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return R.split_known(c.select(F.concat(F.lit(" "), F.upper("c_name")).alias("c_name")), c.filter("c_custkey % 2 = 0").select("c_name"), "c_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE -1.0 END AS score FROM customer WHERE c_custkey % 2 = 0")
def cached_or(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cached = c.filter("c_custkey % 3 = 0").select("c_custkey", F.col("c_acctbal").alias("score"))
    return R.cached_or(cached, c.filter("c_custkey % 2 = 0"), ["c_custkey"], lambda rest: rest.withColumn("score", F.lit(-1.0)))


@query("""SELECT kind, value, n FROM (SELECT 'status' AS kind, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2)""")
def frequencies(spark, sf_dir):
    return R.frequencies(table(spark, sf_dir, "orders"), {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})


@query("SELECT CAST(min(year(o_orderdate)) AS INTEGER) AS first, array_to_string(range(2005, CAST(min(year(o_orderdate)) AS BIGINT) - 1, -1), ',') AS options FROM orders")
def year_range(spark, sf_dir):
    return R.year_range(table(spark, sf_dir, "orders"), F.year("o_orderdate"), F.lit(2005)).select("first", F.array_join(F.transform("options", lambda x: x.cast("string")), ",").alias("options"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def counts_per_owner(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


def _batches_oracle() -> str:
    # A recursive walk over each document's lines: the same rule as a running sum that starts anew.
    return """WITH RECURSIVE l AS (SELECT conv_id, turn, length(text) + 3 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
w AS (SELECT conv_id, turn, r, CASE WHEN n > 600 THEN 1 ELSE 0 END AS next, CASE WHEN n > 600 THEN 0 ELSE n END AS used, 0 AS batch FROM l WHERE r = 1
UNION ALL SELECT l.conv_id, l.turn, l.r, b.batch + (l.n > 600)::INT, CASE WHEN l.n > 600 THEN 0 WHEN b.new THEN l.n ELSE w.used + l.n END, b.batch
FROM w JOIN l ON l.conv_id = w.conv_id AND l.r = w.r + 1, LATERAL (SELECT w.used > 0 AND (l.n > 600 OR w.used + l.n > 600) AS new, w.next + (w.used > 0 AND (l.n > 600 OR w.used + l.n > 600))::INT AS batch) b)
SELECT conv_id, turn, CAST(batch AS INTEGER) AS batch FROM w"""


@query(_batches_oracle())
def content_batches(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.char_length("text") + 3).alias("n"))
    return R.batches(talk, ["conv_id"], ["turn"], F.col("n"), 600)


@query("""WITH x AS (SELECT conv_id, turn, least(length(text), 300) AS n FROM conversations), y AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT conv_id, turn, CAST(greatest(0, least(n, 1000 - before)) AS BIGINT) AS taken FROM y WHERE least(n, 1000 - before) > 0""")
def capped_context(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("n"))
    return R.running_cap(talk, ["conv_id"], ["turn"], F.col("n"), 1000, 300).select("conv_id", "turn", "taken")


@query("""SELECT o_custkey, min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) AS o_orderkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def in_all_groups(spark, sf_dir):
    return R.in_all(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", F.col("o_orderpriority") == "1-URGENT")


@query("""SELECT o_custkey, array_to_string([x for x in [5, 3, 3, 9] if list_contains(d, x)][1:0], ',') || array_to_string(list_concat(list_filter([5, 3], lambda x: list_contains(d, x)), list_filter(d, lambda x: x NOT IN (5, 3))), ',') AS ranking FROM (SELECT o_custkey, list_sort(list(DISTINCT CAST(o_orderkey % 6 AS BIGINT))) AS d FROM orders GROUP BY 1)""")
def made_whole(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.col("o_orderkey") % 6)).alias("d"))
    wish = F.array(*(F.lit(x).cast("bigint") for x in (5, 3, 3, 9)))
    return lists.select("o_custkey", F.array_join(F.transform(R.ranking(wish, F.col("d")), lambda x: x.cast("string")), ",").alias("ranking"))


@query("""SELECT part, count(*) > 0 AS some FROM (SELECT CASE WHEN doc_id >= 0 THEN unnest(['train', 'val']) END AS part FROM documents) GROUP BY 1""")
def split_rows(spark, sf_dir):
    return R.split_by_hash(table(spark, sf_dir, "documents"), "doc_id", 7, 0.2).groupBy("part").agg((F.count("*") > 0).alias("some"))


@query("SELECT count(*) AS n FROM (SELECT doc_id FROM documents LIMIT 100)")
def sampled_rows(spark, sf_dir):
    return R.sample_by_hash(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, 100).agg(F.count("*").alias("n"))
