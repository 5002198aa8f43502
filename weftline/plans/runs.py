"""Queries on whole match runs, pools, incremental rebuilds and batches with statuses.

Stand-ins: vectors of even ids are people, of odd ids opportunities; parts lend both their texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.models import batch as B
from weftline.operators import coverage as C, matching as M, training as L
from weftline.plans.registry import query
from weftline.plans.texts import _toks
from weftline.session import table


def _sides(spark, sf_dir):
    half = (F.size("embedding") / 2).cast("int")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", F.lit(1), half).alias("first"), F.slice("embedding", half + 1, F.size("embedding")).alias("second"))
    return rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")


def _texts(spark, sf_dir):
    """A requirement of an opportunity and a specialization of a person from every part, by the part's place among as many ids."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", (F.col("p_partkey") % 250).alias("place"))
    needs = part.select((F.col("place") * 2 + 1).alias("goal"), F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"), (F.col("p_size") / 50.0).alias("weight"))
    specs = part.select((F.col("place") * 2).alias("person"), F.col("p_partkey").alias("spec_idx"), F.concat_ws(" ", F.reverse(F.split("p_name", " "))).alias("spec"))
    return needs, specs


_RUN = f"""h AS MATERIALIZED (SELECT vec_id, embedding[1:len(embedding)//2]::DOUBLE[] AS a, embedding[len(embedding)//2+1:]::DOUBLE[] AS b FROM embeddings),
d AS MATERIALIZED (SELECT g.vec_id AS goal, p.vec_id AS person, round(greatest(list_cosine_similarity(g.a,p.a), list_cosine_similarity(g.b,p.b), list_cosine_similarity(g.a,p.b), list_cosine_similarity(g.b,p.a)),6) AS domain_score FROM h g, h p WHERE g.vec_id % 2 = 1 AND p.vec_id % 2 = 0),
n AS (SELECT p_partkey % 250 * 2 + 1 AS goal, p_partkey AS idx, p_size / 50.0 AS weight, list_distinct({_toks('p_name', 1)}) AS x FROM part), sp AS (SELECT p_partkey % 250 * 2 AS person, p_partkey AS spec_idx, list_distinct({_toks('p_name', 1)}) AS y FROM part)"""
_ROWS = """pr AS (SELECT goal, person, idx, weight, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS score FROM c JOIN n USING (goal) JOIN sp USING (person)),
me AS (SELECT goal, person, idx, avg(score) AS c FROM pr GROUP BY ALL),
co AS (SELECT c.goal, c.person, string_agg(CASE WHEN round(coalesce(me.c, 0), 9) >= 0.3 THEN idx END, ',' ORDER BY CAST(idx AS VARCHAR)) AS covered, string_agg(CASE WHEN NOT round(coalesce(me.c, 0), 9) >= 0.3 THEN idx END, ',' ORDER BY CAST(idx AS VARCHAR)) AS missing FROM c JOIN n USING (goal) LEFT JOIN me USING (goal, person, idx) GROUP BY ALL),
sc AS (SELECT goal, person, CAST(round(CAST(greatest(0.0, least(1.0, CAST(sum(CAST(weight * score AS DECIMAL(28,9))) AS DOUBLE) / CAST(sum(CAST(weight AS DECIMAL(28,9))) AS DOUBLE))) AS DECIMAL(28,12)), 6) AS DOUBLE) AS score FROM pr WHERE weight > 0 GROUP BY ALL)
SELECT goal, person, domain_score, round(coalesce(sc.score, 0.0) * greatest(0.0, least(1.0, domain_score)), 6) AS llm_score, coalesce(covered, '') AS covered, coalesce(missing, '') AS missing FROM c LEFT JOIN sc USING (goal, person) LEFT JOIN co USING (goal, person)"""


def _shown(rows):
    """Covered and missing requirements as text, in one order."""
    return rows.select("goal", "person", "domain_score", "llm_score", F.coalesce(F.array_join(F.array_sort(F.map_keys("covered")), ","), F.lit("")).alias("covered"), F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"))


@query(f"""WITH {_RUN}, c AS (SELECT * FROM d WHERE domain_score >= 0.3 QUALIFY row_number() OVER (PARTITION BY person ORDER BY domain_score DESC, goal) <= 10), {_ROWS}""")
def matches_of_all(spark, sf_dir):
    people, goals = _sides(spark, sf_dir)
    return _shown(M.match_run(M.candidates(people, goals), *_texts(spark, sf_dir)))


@query(f"""WITH {_RUN}, c AS (SELECT * FROM d WHERE person = 8 AND domain_score >= 0.1 ORDER BY domain_score DESC, goal LIMIT 25), {_ROWS}""")
def matches_of_person(spark, sf_dir):
    people, goals = _sides(spark, sf_dir)
    return _shown(M.match_run(M.candidates(people.filter("id = 8"), goals, 25, 0.1), *_texts(spark, sf_dir)))


@query(f"""WITH {_RUN}, c AS (SELECT * FROM d WHERE goal = 7 AND domain_score >= 0.1 ORDER BY domain_score DESC, person LIMIT 200), {_ROWS}""")
def matches_of_opportunity(spark, sf_dir):
    people, goals = _sides(spark, sf_dir)
    return _shown(M.match_run(M.candidates(people, goals.filter("id = 7"), M.PER_GOAL, 0.1, per="goal"), *_texts(spark, sf_dir)))


@query(f"""WITH {_RUN}, c AS (SELECT * FROM d WHERE goal % 10 = 1 AND person = goal + 1 AND domain_score >= 0), {_ROWS}""")
def matches_of_pairs(spark, sf_dir):
    people, goals = _sides(spark, sf_dir)
    asked = goals.filter("id % 10 = 1").select(F.col("id").alias("goal"), (F.col("id") + 1).alias("person"))
    return _shown(M.match_run(M.named_pairs(people, goals, asked), *_texts(spark, sf_dir)))


def _lines(spark, sf_dir):
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    return line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_brand").alias("goal"), F.col("l_suppkey").alias("person"), F.col("p_size").alias("idx"), (F.col("l_discount") * 10).alias("score"))


def _needs(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("goal"), F.col("p_size").alias("idx")).agg((F.count("*") / 10.0).alias("weight"))


_SCORES = """needs AS (SELECT p_brand AS goal, p_size AS idx, count(*) / 10.0 AS weight FROM part GROUP BY ALL),
scores AS (SELECT goal, person, CAST(round(CAST(greatest(0.0, least(1.0, CAST(sum(CAST(weight * score AS DECIMAL(28,9))) AS DOUBLE) / CAST(sum(CAST(weight AS DECIMAL(28,9))) AS DOUBLE))) AS DECIMAL(28,12)), 6) AS DOUBLE) AS score FROM pairs JOIN needs USING (goal, idx) GROUP BY ALL)"""


@query(f"""WITH pairs AS (SELECT p_brand AS goal, l_suppkey AS person, p_size AS idx, l_discount * 10 AS score FROM lineitem JOIN part ON l_partkey = p_partkey), {_SCORES}, asked AS (SELECT DISTINCT goal, unnest([1, 2, 1000000]) AS person FROM needs),
f AS (SELECT coalesce(s.goal, a.goal) AS goal, coalesce(s.person, a.person) AS person, coalesce(score, 0.0) AS score, a.person IS NOT NULL AS required FROM scores s FULL JOIN asked a ON s.goal = a.goal AND s.person = a.person)
SELECT * FROM f QUALIFY required OR row_number() OVER (PARTITION BY goal ORDER BY required DESC, score DESC, person) <= 50""")
def pools_with_required(spark, sf_dir):
    needs = _needs(spark, sf_dir)
    asked = needs.select("goal").distinct().withColumn("person", F.explode(F.array(*map(F.lit, (1, 2, 1000000))).cast("array<bigint>")))
    return M.pool_with(C.match_scores(_lines(spark, sf_dir), needs), asked, 50)


# One person in ten has changed lines, one in ten has lost all, one in twenty has new ones under another id.
@query(f"""WITH l AS (SELECT p_brand AS goal, l_suppkey AS person, p_size AS idx, l_discount * 10 AS score FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS (SELECT goal, person, idx, CASE WHEN person % 10 = 3 THEN score / 2 ELSE score END AS score FROM l WHERE person % 10 <> 4 UNION ALL SELECT goal, person + 1000000, idx, score FROM l WHERE person % 20 = 7), {_SCORES} SELECT * FROM scores""")
def rebuilt_scores(spark, sf_dir):
    before, needs = _lines(spark, sf_dir), _needs(spark, sf_dir)
    turn = F.col("person") % 10
    after = before.filter(turn != 4).withColumn("score", F.when(turn == 3, F.col("score") / 2).otherwise(F.col("score")))
    after = after.unionByName(before.filter("person % 20 = 7").withColumn("person", F.col("person") + 1000000))
    stored = C.match_scores(before, needs)
    return M.rebuilt(stored, before, after, "person", ["goal", "idx", "score"], lambda rows: C.match_scores(rows, needs))


@query("""WITH t AS (SELECT DISTINCT o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END AS c_custkey FROM orders), k AS (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0),
s AS (SELECT t.c_custkey, CASE WHEN k.c_custkey IS NOT NULL THEN 'skipped_existing' WHEN c.c_custkey IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'failed' WHEN c.c_custkey % 7 = 0 THEN 'failed' ELSE 'processed' END AS status,
 CASE WHEN k.c_custkey IS NULL AND c_acctbal < 0 THEN 'negative' WHEN k.c_custkey IS NULL AND c.c_custkey % 7 = 0 THEN 'breaks each_index_once' END AS error, c_name FROM t LEFT JOIN k USING (c_custkey) LEFT JOIN customer c USING (c_custkey))
SELECT status, error, count(*) AS n, count(CASE WHEN status = 'processed' THEN c_name END) AS n_results, CAST(sum(c_custkey) AS BIGINT) AS keys, (SELECT count(*) FROM s x WHERE x.status = s.status) AS tally FROM s GROUP BY ALL""")
def batch_statuses(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    targets = table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 10000000).otherwise(0)).alias("c_custkey"))

    def score(rows):
        covered = F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
        return rows.select("c_custkey", F.col("c_name").alias("keyword"), covered.alias("covered"), F.array(F.lit(1)).alias("missing"), F.when(F.col("c_acctbal") < 0, "negative").alias("error"))

    once = B.in_one_of(F.array(F.lit(0), F.lit(1)), F.col("covered"), F.col("missing"))
    rows, tallies = B.batch(targets, customer, customer.filter("c_custkey % 5 = 0"), "c_custkey", score, invariants={"each_index_once": once})
    known = F.create_map(*[x for name in B.STATUSES for x in (F.lit(name), F.lit(tallies[name]).cast("bigint"))])
    return rows.groupBy("status", "error").agg(F.count("*").alias("n"), F.count("keyword").alias("n_results"), F.sum("c_custkey").alias("keys")).withColumn("tally", known[F.col("status")])


# ---- candidate sets in full: which items, of which kind, in which place


@query("""WITH r AS (SELECT user_id AS query, event_id AS item, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT query, item, score, CASE WHEN place = 1 THEN 'top' WHEN place = 2 AND query % 2 = 0 THEN 'hard' ELSE 'backfill' END AS kind, CAST(place AS INTEGER) AS place FROM r WHERE n >= 2 AND place <= 2""")
def filled_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), F.col("value").alias("score"))
    even = L.candidates(e.filter("query % 2 = 0"), ["query"], "item", top=1, hard=4, random=3, seed=1, most=2)
    odd = L.candidates(e.filter("query % 2 <> 0"), ["query"], "item", top=1, hard=0, random=0, seed=1)
    return even.unionByName(odd)


@query("""WITH a AS (SELECT o_orderkey % 3 + 2 AS dim, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_linenumber % 4 + 1 AS dim, count(*) AS m FROM lineitem GROUP BY 1) SELECT CAST(arg_max(dim, (n * m, n + m, dim)) AS INTEGER) AS dim FROM a JOIN b USING (dim)""")
def shared_dimension(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.array_repeat(F.lit(1.0), (F.col("o_orderkey") % 3 + 2).cast("int")).alias("v"))
    right = table(spark, sf_dir, "lineitem").select(F.array_repeat(F.lit(1.0), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("v"))
    return L.shared_dimension(left, right, "v")
