"""Queries on filters and retrieval. Documents stand for texts of their source; its place in the source is the chunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.models import scorers
from weftline.operators import search as S, tables as R, vectors as V
from weftline.plans.registry import query
from weftline.plans.texts import _ONE, _toks
from weftline.session import table


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 400000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def in_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.in_range(orders, {"o_totalprice": 400000.0, "o_orderkey": None}, [F.desc("o_totalprice"), F.asc("o_orderkey")], 40)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_type), 'o')")
def containing(spark, sf_dir):
    return S.containing(table(spark, sf_dir, "part"), p_name=" RING", p_type="o", p_brand="  ").select("p_partkey")


@query("""WITH s AS (SELECT p_partkey, p_name, p_type, CASE WHEN lower(p_name) = 'red' THEN 1 WHEN lower(p_name) LIKE '%red%' THEN 2 WHEN lower(p_type) LIKE '%red%' THEN 3 END AS stage FROM part)
SELECT p_partkey, p_name, p_type, CAST(stage AS INTEGER) AS stage FROM s WHERE stage IS NOT NULL ORDER BY stage, p_partkey DESC LIMIT 1""")
def by_title(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return S.by_title(part, F.col("p_name"), F.col("p_type"), " Red ", F.col("p_partkey"))


@query("""SELECT p_partkey FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'U.S. Department of Energy' WHEN 1 THEN 'DOE - office' WHEN 2 THEN 'National Science Foundation' WHEN 3 THEN 'Energy' WHEN 5 THEN 'Doe/NSF' END AS a FROM part) WHERE p_partkey % 6 IN (0, 1, 5)""")
def of_agency(spark, sf_dir):
    turn = F.col("p_partkey") % 6
    agency = F.when(turn == 0, "U.S. Department of Energy").when(turn == 1, "DOE - office").when(turn == 2, "National Science Foundation").when(turn == 3, "Energy").when(turn == 5, "Doe/NSF")
    return S.of_agency(table(spark, sf_dir, "part").select("p_partkey", agency.alias("agency")), F.col("agency"), "DOE").select("p_partkey")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 1")
def of_category(spark, sf_dir):
    turn = F.col("doc_id") % 3
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(turn == 0, "educational").when(turn == 1, " Basic_Research ").alias("category"))
    return S.of_category(docs, F.col("category"), ["basic_research", "unknown"]).select("doc_id")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice / 600000 AS score FROM orders), b AS (SELECT o_custkey, max(score) AS best FROM s GROUP BY 1)
SELECT o_orderkey, score FROM s JOIN b USING (o_custkey) WHERE score >= greatest(0.2, round(best - 0.12, 9))""")
def near_best(spark, sf_dir):
    scored = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 600000).alias("score"))
    return S.near_best(scored, ["o_custkey"], "score").select("o_orderkey", "score")


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderstatus <> 'P' THEN CAST(ascii(o_orderstatus) AS DOUBLE) END, 0.0) DESC, o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def best_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.ascii("o_orderstatus").cast("double")).alias("llm_score"), F.col("o_totalprice").alias("domain_score"))
    return S.best_matches(rows, ["o_custkey"], 3, "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'failed' END WHEN c_custkey % 2 = 0 AND (last IS NULL OR last < TIMESTAMP '2001-01-01' - INTERVAL 30 DAY) THEN 'stale' ELSE 'known' END AS state
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def freshness(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    known = c.filter("c_custkey % 5 <> 4").select("c_custkey").join(last, "c_custkey", "left")
    wanted = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "https://x.org").otherwise(" ").alias("url"))
    return S.freshness(wanted, known, "c_custkey", "last", F.lit("2001-01-01").cast("timestamp"), "url").select("c_custkey", "state")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND o_orderkey % 9 > 0")
def within_years(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 > 0, F.year("o_orderdate")).alias("year"))
    return S.within_years(rows, "year", 1996, 1999).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name = 'small ring' AND p_brand IN ('Brand#2', 'Brand#7', 'Brand#9', 'Brand#12')")
def exact_author(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("at", F.array("p_type", F.when(F.col("p_brand").isin("Brand#2", "Brand#7", "Brand#9", "Brand#12"), " The   Works ").otherwise("elsewhere")))
    return S.exact_author(part, F.col("p_name"), F.col("at"), "Small  Ring", "the works").select("p_partkey")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic IS NULL")
def missing_cache(spark, sf_dir):
    return S.missing_cache(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "quality", "toxic").select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE label % 3 <> 0 AND vec_id % 7 <> 0 AND vec_id % 5 <> 0")
def usable_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    status = F.when(F.col("label") % 3 == 1, "done").when(F.col("label") % 3 == 2, "success").otherwise("pending")
    error = F.when(F.col("vec_id") % 7 == 0, "failed").when(F.col("vec_id") % 2 == 0, "")
    path = F.when(F.col("vec_id") % 5 > 0, F.concat(F.lit("p/"), F.col("vec_id").cast("string")))
    return e.filter(S.usable(status, error, path, F.col("embedding"))).select("vec_id")


_SIMS = """q AS (SELECT vec_id AS owner, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id, label, 'source ' || label AS source, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT owner, source, vec_id AS id, round(list_cosine_similarity(v, e), 6) AS score FROM q, c WHERE c.label % 4 <> owner // 50 % 5)"""


def _scored(spark, sf_dir, queries):
    """The two best rows of each source for a stated query set; some sources are not an owner's."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").filter(queries).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    c = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("source "), F.col("label").cast("string")).alias("source"), F.col("embedding").alias("vector"))
    found = V.top_k_per_source(q, c, 2).select(F.col("query_id").alias("owner"), "source", F.col("item_id").alias("id"), "score")
    label = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    return found.filter((label % 4) != (F.floor(F.col("owner") / 50) % 5))


@query(f"""WITH {_SIMS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner, source ORDER BY score DESC, id) AS INTEGER) AS rank FROM s), k AS (SELECT *, max(score) OVER (PARTITION BY owner, source) AS best FROM r WHERE rank <= 2)
SELECT owner, source, id, score, rank, CAST(row_number() OVER (PARTITION BY owner ORDER BY best DESC, source, rank) AS INTEGER) AS place FROM k""")
def per_source_top_k(spark, sf_dir):
    return S.per_source_by_score(_scored(spark, sf_dir, "true"), ["owner"], 2, "id").drop("best")


_FALL = "f AS (SELECT source AS owner, lang AS source, doc_id AS id, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY n_chars % 7, doc_id) AS INTEGER) AS rank FROM documents)"


@query(f"""WITH {_FALL} SELECT owner, source, id, rank, CAST(row_number() OVER (PARTITION BY owner ORDER BY source, rank) AS INTEGER) AS place FROM f WHERE rank <= 3""")
def per_source_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), F.col("lang").alias("source"), F.col("doc_id").alias("id"), (F.col("n_chars") % 7).alias("chunk_index"))
    return S.per_source_in_order(rows, ["owner"], 3, ["chunk_index", "id"]).drop("chunk_index")


@query(f"""WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY owner, source ORDER BY score DESC, id) AS rank FROM s WHERE owner % 100 = 0), t AS (SELECT owner, id, score FROM r WHERE rank <= 2),
o AS (SELECT vec_id AS owner FROM embeddings WHERE vec_id % 50 = 0), g AS (SELECT owner, id FROM (SELECT owner, c.vec_id AS id, row_number() OVER (PARTITION BY owner, c.source ORDER BY c.vec_id) AS rank FROM o, c WHERE owner % 100 <> 0) WHERE rank <= 2)
SELECT owner, id, score FROM t UNION ALL SELECT owner, id, NULL FROM g""")
def chunk_retrieval(spark, sf_dir):
    ranked = S.per_source_by_score(_scored(spark, sf_dir, "vec_id % 100 = 0"), ["owner"], 2, "id")
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("source "), F.col("label").cast("string")).alias("source"))
    owners = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("owner"))
    return S.source_fallback(rows, owners, ranked, 2, ["id"]).select("owner", "id", "score")


@query(f"""WITH b AS (SELECT conv_id AS owner, role AS source, turn AS id, turn // 2 AS chunk_index, text AS content FROM conversations), q AS (SELECT conv_id AS owner, turn AS idx, text, (turn % 4) / 3.0 AS coverage FROM conversations WHERE turn < 3),
m AS (SELECT b.owner, source, id, chunk_index, idx, coverage, lower({_ONE.format('q.text')}) AS q, lower({_ONE.format('b.content')}) AS c FROM b JOIN q ON b.owner = q.owner),
t AS (SELECT *, {_toks('q')} AS qt, {_toks('c')} AS ct FROM m),
l AS (SELECT *, CASE WHEN len(qt) = 0 OR len(ct) = 0 THEN 0.0 ELSE least(1.0, len(list_filter(qt, lambda x: list_contains(ct, x))) / len(qt) + CASE WHEN contains(c, q) THEN 0.3 WHEN len(qt) >= 3 AND contains(c, array_to_string(qt[1:5], ' ')) THEN 0.15 ELSE 0.0 END) END AS lexical FROM t),
s AS (SELECT owner, source, id, chunk_index, idx, CAST(round(lexical, 6) AS DOUBLE) AS lexical, CAST(round(lexical * (0.65 + 0.35 * coverage), 6) AS DOUBLE) AS score FROM l),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY owner, source, id, chunk_index ORDER BY score DESC, idx) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY owner, source ORDER BY score DESC, chunk_index, id) AS rank FROM d WHERE score >= 0.1),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner ORDER BY score DESC, source, rank) AS INTEGER) AS place FROM k WHERE rank <= 2)
SELECT owner, source, id, idx, lexical, score, place FROM p WHERE place <= 3""")
def requirement_chunks(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    blocks = talk.select(F.col("conv_id").alias("owner"), F.col("role").alias("source"), F.col("turn").alias("id"), F.floor(F.col("turn") / 2).alias("chunk_index"), F.col("text").alias("content"))
    queries = talk.filter("turn < 3").select(F.col("conv_id").alias("owner"), F.col("turn").alias("idx"), "text", ((F.col("turn") % 4) / 3.0).alias("coverage"))
    return S.by_requirements(blocks, queries, ["owner"], 2, 3).drop("chunk_index")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice AS domain_score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
s AS (SELECT *, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS llm_score FROM r WHERE r <= 10) SELECT o_custkey, o_orderkey, llm_score FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY llm_score DESC, domain_score DESC, o_orderkey) <= 2""")
def two_stage_search(spark, sf_dir):
    first = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("domain_score"))
    return S.two_stage(first, lambda pool: pool.withColumn("llm_score", (F.col("o_orderkey") % 10).cast("double") / 10), ["o_custkey"], 2, "o_orderkey").select("o_custkey", "o_orderkey", "llm_score")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice / 1000000 AS base FROM orders) SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 3 = 1 THEN 0.5 ELSE base END AS score FROM c""")
def rescored_matches(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000000).alias("base"))
    answers = c.filter("o_orderkey % 3 < 2").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 7.0).otherwise(0.5).alias("score"))
    return scorers.rescored(c, answers, ["o_orderkey"], "base", "score").select("o_custkey", "o_orderkey", "score")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.3""")
def similar_pairs(spark, sf_dir):
    return V.pairs_over(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3, ["label"])


@query("""WITH s AS (SELECT url, page_id, length(coalesce(html, '')) AS n FROM pages) SELECT coalesce(nullif(trim(CASE WHEN page_id % 3 > 0 THEN url END), ''), 'row:' || page_id) AS source, count(*) AS n FROM pages GROUP BY 1""")
def source_keys(spark, sf_dir):
    url = F.when(F.col("page_id") % 3 > 0, F.col("url"))
    return table(spark, sf_dir, "pages").groupBy(S.source_key(url, F.lit("  "), row=F.col("page_id")).alias("source")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def best_author(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return R.top_per_group(e, ["user_id"], [F.desc("value"), F.asc("event_id")], 1).select("user_id", "event_id")


@query("""SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_name END, ''), p_type) AS abstract FROM part""")
def fallback_chain(spark, sf_dir):
    first = F.when(F.col("p_partkey") % 2 == 0, " ").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(T.blank_to_null(first), T.blank_to_null(F.col("p_type"))).alias("abstract"))
