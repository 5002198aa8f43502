"""Queries on sources, sinks and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import training as L
from weftline.plans.registry import query
from weftline.session import shared_dir, table
from weftline.sources import files as S


@query("""SELECT 'id ' || p_partkey AS opportunity_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'summary' ELSE 'hit' END AS agency, p_retailprice AS award_ceiling, p_type || ' & more' AS summary, p_brand || ',x' AS categories FROM part WHERE p_partkey % 7 > 0""")
def opportunity_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    hit = F.to_json(F.struct(F.when(F.col("p_partkey") % 7 > 0, F.concat(F.lit("id "), F.col("p_partkey").cast("string"))).alias("opportunity_id"), F.col("p_name").alias("opportunity_title"), F.lit("hit").alias("agency_name"), F.col("p_retailprice").alias("award_ceiling")))
    summary = F.to_json(F.struct(F.when(F.col("p_partkey") % 2 == 0, "summary").alias("agency_name"), F.concat(F.lit("<p>"), "p_type", F.lit("</p> &amp;\n more")).alias("summary_description"), F.array("p_brand", F.lit("x")).alias("funding_categories")))
    found = S.opportunity_rows(part.select(hit.alias("hit"), summary.alias("summary")), "hit", "summary")
    return found.withColumn("categories", F.array_join("categories", ","))


@query("""SELECT 'https://x.org/' || s_suppkey AS source_url, s_name AS name, lower(s_name) || '@x.org' AS email, 'a,b' AS organizations, 'l' AS links FROM supplier WHERE s_suppkey % 3 > 0""")
def person_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    url = F.concat(F.lit("https://x.org/"), F.col("s_suppkey").cast("string"))
    profile = F.to_json(F.struct(F.when(F.col("s_suppkey") % 3 == 1, url).otherwise(" ").alias("source_url"), F.when(F.col("s_suppkey") % 3 == 2, url).alias("url"), F.col("s_name").alias("name"), F.concat(F.lit(" "), "s_name", F.lit("@x.org")).alias("email"), F.lit("a| b |").alias("organizations"), F.array(F.lit(" l"), F.lit("")).alias("links")))
    found = S.person_rows(s.select(profile.alias("profile")), "profile")
    return found.withColumns({"organizations": F.array_join("organizations", ","), "links": F.array_join("links", ",")})


def _stored(spark, sf_dir):
    """Conversations as stored chunks: the conversation is the owner, the role the address."""
    talk = table(spark, sf_dir, "conversations")
    path = S.chunk_path("x", "talk", F.col("conv_id"), F.col("role"), F.concat(F.lit("turn "), F.col("turn").cast("string")), F.col("turn"))
    chunks = talk.select(F.col("conv_id").alias("owner"), F.col("role").alias("url"), F.lit("t").alias("title"), F.col("turn").alias("chunk_index"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("s3://bucket/"), path).alias("path"), F.when(F.col("turn") % 5 < 4, "done").otherwise("failed").alias("status"), F.lit(None).cast("string").alias("error"))
    return chunks, talk.filter("turn % 7 <> 6").select(path.alias("path"), "text")


@query("""SELECT conv_id AS owner, role AS url, 't' AS title, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text FROM conversations WHERE turn % 5 < 4 AND turn % 7 <> 6 GROUP BY ALL""")
def stitched_chunks(spark, sf_dir):
    return S.stitched(*_stored(spark, sf_dir), ["owner"]).withColumn("text", F.md5("text"))


@query("SELECT 'nation' AS name, 'n_nationkey,n_name,n_regionkey' AS columns, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', 'r_regionkey,r_name', count(*) FROM region")
def report_files(spark, sf_dir):
    return S.write_report({n: table(spark, sf_dir, n) for n in ("nation", "region")}, shared_dir(spark))


@query("SELECT s_suppkey, s_name FROM supplier")
def json_lines(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    path = shared_dir(spark)
    lines = s.select(F.to_json(F.struct("s_suppkey", "s_name")).alias("value")).unionByName(spark.sql("SELECT '{broken' AS value"))
    lines.write.text(path)
    return S.read_json_lines(spark, path, s.schema).filter("s_suppkey is not null")


_RANKED = "r AS (SELECT conv_id AS query, turn AS item, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS INTEGER) AS place, CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS n FROM conversations)"


def _ranked(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query"), F.col("turn").alias("item"))
    return L.ranks(talk, ["query"], [F.desc("item")])


@query(f"""WITH {_RANKED} SELECT a.query, a.item AS positive, b.item AS negative, round(1 - a.place / (a.n - 1), 6) AS positive_score, round(1 - b.place / (a.n - 1), 6) AS negative_score, round((b.place - a.place) / (a.n - 1), 6) AS strength FROM r a JOIN r b ON a.query = b.query AND a.place < b.place""")
def ranked_pairs(spark, sf_dir):
    return L.pairs(_ranked(spark, sf_dir), ["query"], "item")


@query(f"""WITH {_RANKED}, p AS (SELECT a.query, a.item AS i, b.item AS j, round(1 - a.place / (a.n - 1), 6) AS x, round(1 - b.place / (a.n - 1), 6) AS y, round((b.place - a.place) / (a.n - 1), 6) AS s FROM r a JOIN r b ON a.query = b.query AND a.place < b.place)
SELECT query, i AS item, CAST(x AS DOUBLE) AS label, CAST(greatest(0.1, s) AS DOUBLE) AS weight FROM p WHERE s >= 0.3 UNION ALL SELECT query, j, CAST(y AS DOUBLE), CAST(greatest(0.1, s) AS DOUBLE) FROM p WHERE s >= 0.3""")
def pointwise_rows(spark, sf_dir):
    return L.pointwise(L.pairs(_ranked(spark, sf_dir), ["query"], "item"), ["query"], least_strength=0.3)


@query("""WITH r AS (SELECT user_id AS query, event_id AS item, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT query, CASE WHEN place <= 2 THEN 'top' WHEN place <= 5 THEN 'hard' ELSE 'random' END AS kind, count(*) AS n FROM r WHERE n >= 2 AND (place <= 5 OR place <= 9) GROUP BY ALL""")
def candidate_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), F.col("value").alias("score"))
    return L.candidates(e, ["query"], "item", top=2, hard=3, random=4, seed=1).groupBy("query", "kind").agg(F.count("*").alias("n"))


@query(None)
def fuzzy_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    found = part.select("p_partkey", F.col("p_name").alias("title"), F.posexplode(F.array(F.lit("nothing of it"), F.concat(F.col("p_name"), F.lit("s")), F.col("p_name"))).alias("place", "candidate"))
    return L.fuzzy_matches(found, ["p_partkey"], "title", "candidate")


@query("SELECT o_custkey, arg_min(n, (-c, n)) AS dim FROM (SELECT o_custkey, CAST(o_orderkey % 3 + 2 AS INTEGER) AS n, count(*) AS c FROM orders GROUP BY ALL) GROUP BY 1")
def common_dimension(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.array_repeat(F.lit(1.0), (F.col("o_orderkey") % 3 + 2).cast("int")).alias("v"))
    return L.common_dimension(rows, ["o_custkey"], "v")
