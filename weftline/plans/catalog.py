"""Queries over the driver's tables, each with the SQL that gives the same rows.

Stand-ins: a supplier is a person, a brand an opportunity, a part's size a requirement of it, and
a line's discount (times ten) the score of a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import text as T
from weftline.operators import coverage as C, keywords as K, tables as R, teams, vectors as V
from weftline.plans import changes, files, matching, records, runs, searches, stores, texts  # noqa: F401  they register their queries
from weftline.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from weftline.session import table
from weftline.streaming.drain import drain


_HALVES = "SELECT vec_id, embedding[1:len(embedding)//2]::DOUBLE[] AS a, embedding[len(embedding)//2+1:]::DOUBLE[] AS b FROM embeddings"


@query(f"""WITH v AS ({_HALVES}), s AS (SELECT q.vec_id AS query_id, t.vec_id AS item_id, round(greatest(list_cosine_similarity(q.a,t.a), list_cosine_similarity(q.b,t.b), list_cosine_similarity(q.a,t.b), list_cosine_similarity(q.b,t.a)),6) AS score
FROM v q, v t WHERE q.vec_id % 50 = 0 AND q.vec_id <> t.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s WHERE score >= 0.3) SELECT * FROM r WHERE rank <= 5""")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = (F.size("embedding") / 2).cast("int")
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", F.lit(1), half).alias("first"), F.slice("embedding", half + 1, F.size("embedding")).alias("second"))
    return V.top_k(items.filter("id % 50 = 0"), items, 5, 0.30, skip_equal_ids=True)


@query("SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("y"))
    return a.join(b, F.col("right_id") == F.col("left_id") + 1).select("left_id", "right_id", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


def _matching(spark, sf_dir):
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    pairs = line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_brand").alias("goal"), F.col("l_suppkey").alias("person"), F.col("p_size").alias("idx"), (F.col("l_discount") * 10).alias("score"))
    needs = part.groupBy(F.col("p_brand").alias("goal"), F.col("p_size").alias("idx")).agg((F.count("*") / 10.0).alias("weight"))
    return pairs, needs


_PAIRS = """pairs AS (SELECT p_brand AS goal, l_suppkey AS person, p_size AS idx, l_discount * 10 AS score FROM lineitem JOIN part ON l_partkey = p_partkey),
needs AS (SELECT p_brand AS goal, p_size AS idx, count(*) / 10.0 AS weight FROM part GROUP BY ALL), means AS (SELECT goal, person, idx, round(avg(score),6) AS c FROM pairs GROUP BY ALL),
people AS (SELECT DISTINCT goal, person FROM pairs), cov AS (SELECT goal, person, idx, weight, coalesce(c, 0.0) AS c FROM people JOIN needs USING (goal) LEFT JOIN means USING (goal, person, idx)),
scores AS (SELECT goal, person, CAST(round(CAST(greatest(0.0, least(1.0, CAST(sum(CAST(weight * score AS DECIMAL(28,9))) AS DOUBLE) / CAST(sum(CAST(weight AS DECIMAL(28,9))) AS DOUBLE))) AS DECIMAL(28,12)), 6) AS DOUBLE) AS score FROM pairs JOIN needs USING (goal, idx) GROUP BY ALL)"""


@query(f"WITH {_PAIRS} SELECT goal, person, count(*) FILTER (c >= 0.3) AS n_covered, count(*) FILTER (c < 0.3) AS n_missing FROM cov GROUP BY ALL")
def requirement_coverage(spark, sf_dir):
    pairs, needs = _matching(spark, sf_dir)
    found = C.coverage(pairs, needs, pairs.select("goal", "person").distinct())
    return found.groupBy("goal", "person").agg(F.count_if("covered").alias("n_covered"), F.count_if(~F.col("covered")).alias("n_missing"))


@query(f"WITH {_PAIRS} SELECT * FROM scores")
def match_scores(spark, sf_dir):
    return C.match_scores(*_matching(spark, sf_dir))


@query(f"""WITH {_PAIRS}, pool AS (SELECT goal, person FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY score DESC, person) AS r FROM scores) WHERE r <= 15), pc AS (SELECT * FROM cov SEMI JOIN pool USING (goal, person)),
t AS (SELECT x.goal, x.person AS first, y.person AS second, CAST(round(sum(CAST(x.weight * greatest(x.c, y.c) AS DECIMAL(28,9))), 6) AS DOUBLE) AS score FROM pc x JOIN pc y ON x.goal = y.goal AND x.idx = y.idx AND x.person < y.person GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY goal ORDER BY score DESC, first, second) AS INTEGER) AS rank FROM t) SELECT * FROM r WHERE rank <= 3""")
def best_teams(spark, sf_dir):
    pairs, needs = _matching(spark, sf_dir)
    pool = C.pool(C.match_scores(pairs, needs), 15).select("goal", "person")
    found = teams.best_teams(C.coverage(pairs.join(pool, ["goal", "person"], "left_semi"), needs, pool), 2, 3)
    return found.select("goal", F.col("team")[0].alias("first"), F.col("team")[1].alias("second"), "score", "rank")


def _pooled(spark, sf_dir, size):
    """What the best people of each goal cover: four for each seat, 15 at least."""
    pairs, needs = _matching(spark, sf_dir)
    pool = C.pool(C.match_scores(pairs, needs), max(4 * size, 15)).select("goal", "person")
    return C.coverage(pairs.join(pool, ["goal", "person"], "left_semi"), needs, pool)


# Every team of five from a pool of 20, grown by one person at a time; sums as decimals, by requirement.
@query(f"""WITH RECURSIVE {_PAIRS}, pool AS (SELECT goal, person FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY score DESC, person) AS r FROM scores) WHERE r <= 20),
v AS MATERIALIZED (SELECT goal, person, list(CAST(weight * c AS DECIMAL(28,9)) ORDER BY idx) AS x FROM cov SEMI JOIN pool USING (goal, person) GROUP BY ALL),
t AS (SELECT goal, [person] AS team, person AS last, x FROM v UNION ALL SELECT t.goal, list_append(team, person), person, list_transform(list_zip(t.x, v.x), lambda p: greatest(p[1], p[2])) FROM t JOIN v ON v.goal = t.goal AND person > last WHERE len(team) < 5),
r AS (SELECT goal, team, CAST(round(list_sum(x), 6) AS DOUBLE) AS score FROM t WHERE len(team) = 5)
SELECT goal, array_to_string(team, ',') AS team, score, CAST(row_number() OVER (PARTITION BY goal ORDER BY score DESC, team) AS INTEGER) AS rank FROM r QUALIFY rank <= 5""")
def teams_of_five(spark, sf_dir):
    found = teams.best_teams(_pooled(spark, sf_dir, 5), 5, 5)
    return found.select("goal", F.array_join(F.transform("team", lambda x: x.cast("string")), ",").alias("team"), "score", "rank")


# Five people of a team of ten are given, the other five come from the 20 best.
@query(f"""WITH RECURSIVE {_PAIRS}, asked AS (SELECT DISTINCT goal, person FROM needs, range(1, 6) AS r(person)),
rest AS (SELECT goal, person FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY score DESC, person) AS r FROM scores WHERE person NOT BETWEEN 1 AND 5) WHERE r <= 20),
v AS MATERIALIZED (SELECT goal, person, list(CAST(weight * coalesce(c, 0.0) AS DECIMAL(28,9)) ORDER BY idx) AS x FROM (FROM asked UNION ALL FROM rest) JOIN needs USING (goal) LEFT JOIN means USING (goal, person, idx) GROUP BY ALL),
s AS (SELECT goal, list(p ORDER BY i) AS x FROM (SELECT goal, i, max(x[i]) AS p FROM v, range(1, 100) AS r(i) WHERE person BETWEEN 1 AND 5 AND i <= len(x) GROUP BY ALL) GROUP BY goal),
t AS (SELECT goal, CAST([] AS BIGINT[]) AS team, CAST(-1 AS BIGINT) AS last, x FROM s UNION ALL SELECT t.goal, list_append(team, person), person, list_transform(list_zip(t.x, v.x), lambda p: greatest(p[1], p[2])) FROM t JOIN v ON v.goal = t.goal AND person NOT BETWEEN 1 AND 5 AND person > last WHERE len(team) < 5),
r AS (SELECT goal, team, CAST(round(list_sum(x), 6) AS DOUBLE) AS score FROM t WHERE len(team) = 5)
SELECT goal, '1,2,3,4,5,' || array_to_string(team, ',') AS team, score, CAST(row_number() OVER (PARTITION BY goal ORDER BY score DESC, team) AS INTEGER) AS rank FROM r QUALIFY rank <= 5""")
def teams_of_ten(spark, sf_dir):
    found = teams.form_teams(*_matching(spark, sf_dir), 10, [1, 2, 3, 4, 5], 5)
    return found.select("goal", F.array_join(F.transform("team", lambda x: x.cast("string")), ",").alias("team"), "score", "rank")


# Whom to add to suppliers 7 and 3: all pairs of the 15 best others.
@query(f"""WITH {_PAIRS}, rest AS (SELECT goal, person FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY score DESC, person) AS r FROM scores WHERE person NOT IN (3, 7)) WHERE r <= 15),
asked AS (SELECT DISTINCT goal, person FROM needs, (SELECT unnest([3, 7]) AS person)), v AS (SELECT goal, person, idx, weight, coalesce(c, 0.0) AS c FROM (FROM asked UNION ALL FROM rest) JOIN needs USING (goal) LEFT JOIN means USING (goal, person, idx)),
s AS (SELECT goal, idx, max(c) AS c FROM v WHERE person IN (3, 7) GROUP BY ALL),
t AS (SELECT x.goal, x.person AS a, y.person AS b, CAST(round(sum(CAST(x.weight * greatest(x.c, y.c, s.c) AS DECIMAL(28,9))), 6) AS DOUBLE) AS score FROM v x JOIN v y ON x.goal = y.goal AND x.idx = y.idx AND x.person < y.person JOIN s ON s.goal = x.goal AND s.idx = x.idx WHERE x.person NOT IN (3, 7) AND y.person NOT IN (3, 7) GROUP BY ALL)
SELECT goal, a || ',' || b AS people, score, CAST(row_number() OVER (PARTITION BY goal ORDER BY score DESC, a, b) AS INTEGER) AS rank FROM t QUALIFY rank <= 3""")
def collaborators(spark, sf_dir):
    found = teams.collaborators(*_matching(spark, sf_dir), [7, 3], 2, 3)
    return found.select("goal", F.array_join(F.transform("people", lambda x: x.cast("string")), ",").alias("people"), "score", "rank")


@query("SELECT l_suppkey AS person, l_linenumber AS idx, max(l_discount) AS c FROM lineitem GROUP BY ALL")
def member_coverage(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_linenumber").alias("idx"), F.col("l_discount").alias("c")).transform(C.member_coverage, ["person", "idx"], "c")


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def without_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id, lower(source) AS source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def with_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("source").alias("source")).join(table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) AS n FROM orders GROUP BY 1")
def status_tallies(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("done"), F.count_if(s == "O").alias("open"), F.count("*").alias("n"))


@query("SELECT event_type, count(value) AS n, round(avg(value),6) AS mean, round(median(value),6) AS median, quantile_disc(value,0.95) AS p95, min(value) AS least, max(value) AS most, round(stddev_pop(value),6) AS deviation FROM events GROUP BY 1")
def latency_summary(spark, sf_dir):
    return R.latency(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT source, doc_id, n_chars, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 3")
def top_per_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return R.top_per_group(docs, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY conv_id, turn) AS r FROM conversations WHERE length(trim(text)) > 0) WHERE r = 1")
def first_seen_texts(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return R.first_seen(talk, F.lower(F.trim("text")), ["conv_id", "turn"]).select("conv_id", "turn")


@query("""WITH w AS (SELECT p_type, l_returnflag, count(*) / 1000 AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT coalesce(a.p_type, b.p_type) AS p_type, a.weight AS old_weight, b.weight AS new_weight, CASE WHEN a.weight IS NULL THEN 'added' WHEN b.weight IS NULL THEN 'deleted' ELSE 'weight_changed' END AS change
FROM (SELECT * FROM w WHERE l_returnflag = 'A') a FULL JOIN (SELECT * FROM w WHERE l_returnflag = 'R') b ON a.p_type = b.p_type WHERE a.weight IS NULL OR b.weight IS NULL OR abs(a.weight - b.weight) > 1e-9""")
def keyword_diff(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    w = line.join(part, line.l_partkey == part.p_partkey).groupBy("p_type", "l_returnflag").agg((F.count("*") / 1000).alias("weight"))
    return K.differences(w.filter("l_returnflag = 'A'").drop("l_returnflag"), w.filter("l_returnflag = 'R'").drop("l_returnflag"), ["p_type"])




@query("SELECT round(avg((quality-toxic)*(quality-toxic)),6) AS mse, round(avg(abs(quality-toxic)),6) AS mae, round(coalesce(corr(quality,toxic),0),6) AS pearson FROM labels")
def eval_metrics(spark, sf_dir):
    d = F.col("quality") - F.col("toxic")
    return table(spark, sf_dir, "labels").agg(F.round(F.avg(d * d), 6).alias("mse"), F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.coalesce(F.corr("quality", "toxic"), F.lit(0.0)), 6).alias("pearson"))


@query("SELECT p_partkey, lower(regexp_replace(p_name,'[^A-Za-z0-9._-]+','_','g')) AS safe, substr(sha256(p_name),1,20) AS hash, regexp_replace(lower(p_type),'[^a-z0-9_]+','_','g') AS snake FROM part")
def text_scalars(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(T.safe_name(n)).alias("safe"), T.short_hash(n).alias("hash"), T.snake(F.col("p_type")).alias("snake"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text,''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w)/220.0) AS BIGINT))) AS chunk FROM w)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, md5(array_to_string(w[chunk*220+1:chunk*220+220],' ')) AS hash FROM c""")
def word_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.word_chunks(F.col("text"))).alias("chunk", "text")).select("doc_id", "chunk", F.md5("text").alias("hash"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def paged_scan(spark, sf_dir):
    return R.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 100)


@query("SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(list_sort(list(l_linenumber) FILTER (l_linenumber IS NOT NULL))[1], 0) AS first_line FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def with_relations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    full = R.with_related(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", lines=(lines, "l_orderkey", ["l_linenumber", "l_partkey"]))
    return full.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.get("lines", F.lit(0))["l_linenumber"], F.lit(0)).alias("first_line"))


@query("""WITH r AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS n FROM conversations)
SELECT a.conv_id, a.pos AS better, b.pos AS worse, round((b.pos - a.pos) / (a.n - 1), 6) AS strength FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.pos < b.pos""")
def rank_pairs(spark, sf_dir):
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id")
    ranked = table(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(own.orderBy("turn")) - 1).alias("pos"), F.count("*").over(own).alias("n"))
    worse = ranked.select("conv_id", F.col("pos").alias("worse"))
    return ranked.withColumnRenamed("pos", "better").join(worse, "conv_id").filter("better < worse").select("conv_id", "better", "worse", F.round((F.col("worse") - F.col("better")) / (F.col("n") - 1), 6).alias("strength"))


@query("SELECT event_id, user_id, round(value,2) AS value FROM events WHERE event_type IS NOT NULL")
def drained_events(spark, sf_dir):
    return drain(spark, f"{sf_dir}/events.parque[t]", lambda rows: rows.filter("event_type is not null").select("event_id", "user_id", F.round("value", 2).alias("value")))
