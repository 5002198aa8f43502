"""Queries on publications, profiles, justification inputs, keyword sources and training sets.

Stand-ins: customers are people, their orders publications; brands are opportunities, suppliers people.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import coverage as C, keywords as K, payloads as P, publications as W, teams, training as L
from weftline.plans.registry import query
from weftline.plans.runs import _lines, _needs
from weftline.plans.texts import _toks
from weftline.session import table, written


@query("""WITH o AS (SELECT o_custkey AS person, 'W' || o_orderkey AS work_id, o_orderpriority AS title, o_clerk AS abstract, year(o_orderdate) AS year, CAST(o_orderkey AS DOUBLE) AS v, o_orderkey AS k FROM (SELECT *, 'text ' || o_orderstatus AS o_clerk FROM orders)),
n AS (SELECT person, CASE WHEN k % 11 = 0 THEN '' ELSE CASE WHEN k % 3 = 0 THEN 'N' ELSE 'W' END || k END AS work_id, CASE WHEN k % 13 <> 0 THEN 'new ' || title END AS title, CASE WHEN k % 5 = 0 THEN ' ' ELSE 'newer' END AS abstract, year + 1 AS year, CASE WHEN k % 7 > 0 THEN -v END AS v FROM o WHERE k % 2 = 0),
g AS (SELECT * FROM n WHERE work_id <> '' AND title IS NOT NULL)
SELECT coalesce(g.person, o.person) AS person, coalesce(g.work_id, o.work_id) AS work_id, CASE WHEN g.person IS NOT NULL THEN g.title ELSE o.title END AS title, CASE WHEN g.person IS NOT NULL THEN g.abstract ELSE o.abstract END AS abstract, CAST(CASE WHEN g.person IS NOT NULL THEN g.year ELSE o.year END AS INTEGER) AS year,
 CASE WHEN g.person IS NULL THEN o.v WHEN trim(g.abstract) = '' THEN NULL ELSE coalesce(g.v, o.v) END AS v FROM o FULL JOIN g ON g.person = o.person AND g.work_id = o.work_id""")
def upserted_publications(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey")
    old = o.select(F.col("o_custkey").alias("person"), F.concat(F.lit("W"), key).alias("work_id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("text "), "o_orderstatus").alias("abstract"), F.year("o_orderdate").alias("year"), F.array(k.cast("double")).alias("vector"))
    work = F.when(k % 11 == 0, "").otherwise(F.concat(F.when(k % 3 == 0, "N").otherwise("W"), key))
    new = o.filter(k % 2 == 0).select(F.col("o_custkey").alias("person"), work.alias("work_id"), F.when(k % 13 != 0, F.concat(F.lit("new "), "o_orderpriority")).alias("title"), F.when(k % 5 == 0, " ").otherwise("newer").alias("abstract"), (F.year("o_orderdate") + 1).alias("year"), F.when(k % 7 > 0, F.array(-k.cast("double"))).alias("vector"), k.alias("turn"))
    return W.upserted(old, new, "person", "turn").withColumn("v", F.col("vector")[0]).drop("vector")


@query("""WITH w AS (SELECT o_custkey AS author, o_orderkey AS pos, CASE WHEN o_orderkey % 4 > 0 THEN 'W' || (o_orderkey % 500) END AS work_id, o_orderpriority AS title, year(o_orderdate) AS year FROM orders), a AS (SELECT c_custkey AS author, c_custkey % 97 AS turn FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT w.*, turn FROM w JOIN a USING (author) WHERE year BETWEEN 1993 AND 1996), k AS (SELECT * FROM r WHERE work_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY turn, pos, author) = 1 UNION ALL SELECT * FROM r WHERE work_id IS NULL)
SELECT author, pos, work_id, title, CAST(year AS INTEGER) AS year FROM k""")
def works_of_authors(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    works = o.select(F.col("o_custkey").alias("author"), k.alias("pos"), F.when(k % 4 > 0, F.concat(F.lit("https://openalex.org/W"), (k % 500).cast("string"))).alias("work_id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"))
    authors = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("author"), (F.col("c_custkey") % 97).alias("turn"))
    return W.of_authors(works, authors, 1993, 1996).select("author", "pos", "work_id", "title", "year")


@query("""WITH w AS (SELECT DISTINCT lower(p_name) AS title FROM part), h AS (SELECT lower(p_name) AS q, p_partkey AS pos, CASE WHEN p_size % 2 = 0 THEN lower(p_name) ELSE 'other' END AS title, CASE WHEN p_size % 3 = 0 THEN 'abstract ' || p_partkey END AS abstract, CASE WHEN p_size % 5 = 0 THEN 'summary ' || p_partkey END AS summary FROM part WHERE p_partkey % 4 > 0)
SELECT w.title, arg_min(coalesce(abstract, summary), (abstract IS NULL, h.title <> h.q, pos)) AS abstract FROM w LEFT JOIN h ON h.q = w.title AND coalesce(abstract, summary) IS NOT NULL GROUP BY 1""")
def title_abstracts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    hits = part.filter("p_partkey % 4 > 0").select(F.upper("p_name").alias("query"), F.col("p_partkey").alias("pos"), F.when(size % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise("other").alias("title"), F.when(size % 3 == 0, F.concat(F.lit("abstract "), key)).otherwise(" ").alias("abstract"), F.when(size % 5 == 0, F.concat(F.lit("summary "), key)).alias("summary"))
    return W.abstracts(part.select(F.col("p_name").alias("title")), hits)


@query("""WITH c AS (SELECT o_custkey AS person, o_orderkey AS id, '10.1/' || (o_orderkey % 9) AS doi, o_orderpriority AS title, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderkey % 3 > 0),
a AS (SELECT c_custkey AS person, c_custkey AS n, CASE c_custkey % 4 WHEN 0 THEN '10.1/3' WHEN 1 THEN '10.9/' || (c_custkey % 20) END AS doi, CASE WHEN c_custkey % 4 = 2 THEN '1-URGENT' END AS title, CASE WHEN c_custkey % 5 = 0 THEN 2001 END AS year FROM customer),
f AS (SELECT '10.9/' || i AS doi, 'fetched ' || i AS title, 1980 + i AS year FROM range(0, 10) AS r(i)), j AS (SELECT a.person, a.n, a.doi, coalesce(a.title, f.title) AS title, coalesce(a.year, f.year) AS year FROM a LEFT JOIN f USING (doi)),
d AS (SELECT person, doi, arg_max((id, title, year), (year, id)) AS x FROM c GROUP BY ALL), t AS (SELECT person, lower(title) AS title, arg_max((id, title, year), (year, id)) AS x FROM c GROUP BY ALL)
SELECT j.person, j.n, coalesce(d.x, t.x)[1] AS id, coalesce(j.title, coalesce(d.x, t.x)[2]) AS title, CAST(coalesce(j.year, coalesce(d.x, t.x)[3]) AS INTEGER) AS year, CASE WHEN coalesce(j.title, coalesce(d.x, t.x)[2]) IS NULL THEN 'skipped' WHEN d.x IS NOT NULL THEN 'doi' WHEN t.x IS NOT NULL THEN 'title' ELSE 'new' END AS how
FROM j LEFT JOIN d ON d.person = j.person AND d.doi = j.doi LEFT JOIN t ON t.person = j.person AND t.title = lower(coalesce(j.title, ''))""")
def added_publications(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k, p = F.col("o_orderkey"), F.col("c_custkey")
    current = o.filter(k % 3 > 0).select(F.col("o_custkey").alias("person"), k.alias("id"), F.concat(F.lit("10.1/"), (k % 9).cast("string")).alias("doi"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"))
    doi = F.when(p % 4 == 0, "https://doi.org/10.1/3").when(p % 4 == 1, F.concat(F.lit("10.9/"), (p % 20).cast("string")))
    asked = c.select(p.alias("person"), p.alias("n"), doi.alias("doi"), F.when(p % 4 == 2, " 1-Urgent").alias("title"), F.when(p % 5 == 0, 2001).alias("year"))
    fetched = spark.range(10).select(F.concat(F.lit("10.9/"), F.col("id").cast("string")).alias("doi"), F.concat(F.lit("fetched "), F.col("id").cast("string")).alias("title"), (F.col("id") + 1980).cast("int").alias("year"))
    found = W.added(current, asked, fetched, "person")
    return found.withColumn("title", F.when(F.col("title") == "1-Urgent", "1-URGENT").otherwise(F.col("title")))


@query("""SELECT s_suppkey, s_name, coalesce(r.d, '') AS research, coalesce(a.d, '') AS application, s_suppkey % 6 = 0 AS is_existing_member FROM supplier
LEFT JOIN (SELECT l_suppkey, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS d FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY 1) r ON r.l_suppkey = s_suppkey LEFT JOIN (SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS d FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY 1) a ON a.l_suppkey = s_suppkey WHERE s_suppkey % 2 = 0""")
def person_details(spark, sf_dir):
    s, line = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), table(spark, sf_dir, "lineitem")
    wanted = s.filter("s_suppkey % 2 = 0").select("s_suppkey").unionByName(spark.sql("SELECT CAST(-5 AS bigint) AS s_suppkey"))
    domains = lambda column, kept, name: line.filter(kept).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sort_array(F.collect_set(column)).alias("domains")).withColumn("section", F.lit(name))
    keywords = domains("l_linestatus", "l_suppkey % 4 > 0", "research").unionByName(domains("l_returnflag", "l_suppkey % 5 > 0", "application"))
    found = P.details(s, wanted, s.filter("s_suppkey % 6 = 0").select("s_suppkey"), keywords, "s_suppkey")
    return found.select("s_suppkey", "s_name", F.array_join("research_domains", ",").alias("research"), F.array_join("application_domains", ",").alias("application"), "is_existing_member")


@query("""WITH i AS (SELECT p_brand AS b, p_partkey AS pos, p_type AS t, p_size / 50.0 AS w FROM part), f AS (SELECT i.b, i.t, p_partkey AS id, pos, r, 'title ' || ((pos + r) % 300) AS title FROM i JOIN part ON p_partkey = pos, range(0, 3) AS x(r) WHERE (pos + r) % 300 % 7 > 0),
d AS (SELECT b, t, title, min((pos, r)) AS first FROM f GROUP BY ALL), l AS (SELECT b, t, list(title ORDER BY first)[1:2] AS titles FROM d GROUP BY ALL)
SELECT i.b AS p_brand, i.t, CAST(round(max(w), 6) AS DOUBLE) AS w, coalesce(array_to_string(any_value(titles), ','), '') AS titles FROM i LEFT JOIN l ON l.b = i.b AND l.t = i.t GROUP BY ALL""")
def evidence_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    items = part.select("p_brand", F.col("p_partkey").alias("pos"), F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit("  "))).alias("t"), (F.col("p_size") / 50.0).alias("w"))
    cited = part.select("p_brand", F.col("p_partkey").alias("pos"), F.posexplode(F.array(*[(F.col("p_partkey") + r) % 300 for r in range(3)])).alias("rank", "id"))
    titles = part.select((F.col("p_partkey") % 300).alias("id")).distinct().select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("title "), F.col("id").cast("string"))).alias("title"))
    return P.evidence_titles(items, cited, titles, ["p_brand"]).withColumn("titles", F.array_join("titles", ","))


# Teams of two of every brand: members, what each and all of them cover, and the lines of evidence, as one hash each.
@query("""WITH pairs AS (SELECT p_brand AS goal, l_suppkey AS person, p_size AS idx, l_discount * 10 AS score, 'spec ' || l_linenumber AS spec FROM lineitem JOIN part ON l_partkey = p_partkey), needs AS (SELECT p_brand AS goal, p_size AS idx, count(*) / 10.0 AS weight FROM part GROUP BY ALL),
means AS (SELECT goal, person, idx, round(avg(score), 6) AS c FROM pairs GROUP BY ALL), people AS (SELECT DISTINCT goal, person FROM pairs), cov AS (SELECT goal, person, idx, weight, coalesce(c, 0.0) AS c FROM people JOIN needs USING (goal) LEFT JOIN means USING (goal, person, idx)),
ws AS (SELECT goal, person, CAST(round(CAST(greatest(0.0, least(1.0, CAST(sum(CAST(weight * score AS DECIMAL(28,9))) AS DOUBLE) / CAST(sum(CAST(weight AS DECIMAL(28,9))) AS DOUBLE))) AS DECIMAL(28,12)), 6) AS DOUBLE) AS score FROM pairs JOIN needs USING (goal, idx) GROUP BY ALL),
pool AS (SELECT goal, person FROM ws QUALIFY row_number() OVER (PARTITION BY goal ORDER BY score DESC, person) <= 15), pc AS (SELECT * FROM cov SEMI JOIN pool USING (goal, person)),
t AS (SELECT x.goal, x.person AS a, y.person AS b, CAST(round(sum(CAST(x.weight * greatest(x.c, y.c) AS DECIMAL(28,9))), 6) AS DOUBLE) AS score FROM pc x JOIN pc y ON x.goal = y.goal AND x.idx = y.idx AND x.person < y.person GROUP BY ALL),
tm AS MATERIALIZED (SELECT goal, CAST(row_number() OVER (PARTITION BY goal ORDER BY score DESC, a, b) AS INTEGER) AS rank, a, b FROM t QUALIFY rank <= 2), m AS (SELECT goal, rank, unnest([a, b]) AS person FROM tm),
nm AS (SELECT m.*, CASE WHEN person % 3 > 0 THEN 'Person ' || person ELSE 'person_' || person END AS name FROM m),
cv AS (SELECT goal, rank, idx, max(c) AS c FROM m JOIN cov USING (goal, person) GROUP BY ALL),
ev AS (SELECT nm.goal, nm.rank, name, person, idx, spec, max(s.score) AS score, any_value(c.c) AS c FROM nm JOIN pairs s USING (goal, person) JOIN cov c USING (goal, person, idx) GROUP BY ALL),
el AS (SELECT *, row_number() OVER (PARTITION BY goal, rank ORDER BY score DESC, c DESC, person, idx, spec) AS turn FROM ev)
SELECT goal, rank, (SELECT count(*) FROM needs n WHERE n.goal = tm.goal) AS n_needs, (SELECT string_agg(name, ',' ORDER BY person) FROM nm WHERE nm.goal = tm.goal AND nm.rank = tm.rank) AS members,
 (SELECT md5(string_agg(idx || ':' || printf('%.6f', c), ',' ORDER BY 'size.' || idx)) FROM cv WHERE cv.goal = tm.goal AND cv.rank = tm.rank) AS coverage,
 (SELECT md5(string_agg('[size] ' || name || ' | requirement: need ' || idx || ' | specialization: ' || spec || ' | pair=' || printf('%.4f', score) || ' | req=' || printf('%.4f', c), chr(10) ORDER BY turn)) FROM el WHERE el.goal = tm.goal AND el.rank = tm.rank AND turn <= 200) AS evidence FROM tm""")
def justification_inputs(spark, sf_dir):
    pairs, needs = _lines(spark, sf_dir), _needs(spark, sf_dir)
    pool = written(C.pool(C.match_scores(pairs, needs), 15).select("goal", "person"), "pool", small=True)
    held = written(C.coverage(pairs.join(pool, ["goal", "person"], "left_semi"), needs, pool).withColumn("section", F.lit("size")), "held", small=True)
    found = teams.best_teams(held, 2, 2)
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    said = line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_brand").alias("goal"), F.col("l_suppkey").alias("person"), F.lit("size").alias("section"), F.col("p_size").alias("idx"), F.concat(F.lit("spec "), F.col("l_linenumber").cast("string")).alias("spec"), (F.col("l_discount") * 10).alias("score"))
    asked = needs.withColumns({"section": F.lit("size"), "text": F.concat(F.lit("need "), F.col("idx").cast("string"))})
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("Person "), F.col("s_suppkey").cast("string"))).alias("name"))
    goals = needs.select("goal").distinct()
    rows = P.justification_inputs(found, goals, asked, people, held, said)
    covered = F.array_join(F.transform(F.map_entries("coverage"), lambda e: F.concat(F.substring_index(e["key"], ".", -1), F.lit(":"), F.format_string("%.6f", e["value"]))), ",")
    return rows.select("goal", "rank", F.size("requirements").cast("bigint").alias("n_needs"), F.array_join(F.transform("members", lambda m: m["name"]), ",").alias("members"), F.md5(covered).alias("coverage"), F.md5("evidence").alias("evidence"))


_PLACES = "[CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % 64 FOR w IN regexp_extract_all(lower(trim({0})), '[a-z0-9]+')]"


# Sources of a conversation's first turns among all its turns, by cosine of token counts in 64 places.
@query(f"""WITH c AS (SELECT conv_id, role AS type, turn AS id, {_PLACES.format('text')} AS x FROM conversations), v AS MATERIALIZED (SELECT conv_id, type, id, b, count(*) AS n FROM (SELECT conv_id, type, id, unnest(x) AS b FROM c) GROUP BY ALL),
z AS (SELECT conv_id, type, id, sqrt(sum(n * n)) AS z FROM v GROUP BY ALL), d AS (SELECT a.conv_id, a.id AS turn, b.type, b.id, sum(a.n * b.n) AS dot FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.b = b.b AND a.id < 2 GROUP BY ALL),
s AS (SELECT d.conv_id, d.turn, d.type, d.id, round(dot / (p.z * q.z), 6) AS score FROM d JOIN z p ON p.conv_id = d.conv_id AND p.id = d.turn JOIN z q ON q.conv_id = d.conv_id AND q.id = d.id),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY least(1.0, score) DESC, type, id) AS r FROM s WHERE score >= 0.1)
SELECT t.conv_id, t.turn, coalesce(string_agg(type || ':' || id || ':' || printf('%.6f', least(1.0, score)), ',' ORDER BY r), '') AS sources FROM conversations t LEFT JOIN k ON k.conv_id = t.conv_id AND k.turn = t.turn AND r <= 4 WHERE t.turn < 2 GROUP BY ALL""")
def attached_sources(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    keywords = talk.filter("turn < 2").select("conv_id", "turn", F.col("text").alias("t"))
    catalog = talk.select("conv_id", F.col("role").alias("type"), F.col("turn").alias("id"), F.col("text").alias("excerpt"))
    found = K.attached_sources(keywords, catalog, ["conv_id"])
    line = F.transform("sources", lambda x: F.concat(x["type"], F.lit(":"), x["id"].cast("string"), F.lit(":"), F.format_string("%.6f", x["score"])))
    return found.select("conv_id", "turn", F.array_join(line, ",").alias("sources"))


# Turns of users are queries, those of assistants items; no random ones, as SQL has another hash.
@query(f"""WITH c AS (SELECT conv_id * 100 + turn AS id, role, text, {_PLACES.format('text')} AS x, list_distinct({_toks('text', 1)}) AS k FROM conversations WHERE turn % 5 < 4), v AS MATERIALIZED (SELECT id, role, b, count(*) AS n FROM (SELECT id, role, unnest(x) AS b FROM c) GROUP BY ALL),
z AS (SELECT id, sqrt(sum(n * n)) AS z FROM v GROUP BY ALL), q AS (SELECT DISTINCT id FROM v WHERE role = 'user'), i AS (SELECT DISTINCT id FROM v WHERE role <> 'user'),
d AS (SELECT a.id AS query, b.id AS item, sum(a.n * b.n) AS dot FROM v a JOIN v b ON a.b = b.b AND a.role = 'user' AND b.role <> 'user' GROUP BY ALL),
s AS (SELECT q.id AS query, i.id AS item, round(coalesce(dot / (p.z * r.z), 0.0), 6) AS cosine FROM q CROSS JOIN i LEFT JOIN d ON d.query = q.id AND d.item = i.id JOIN z p ON p.id = q.id JOIN z r ON r.id = i.id),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, item) <= 6),
o AS (SELECT t.*, CASE WHEN len(a.k) = 0 OR len(b.k) = 0 THEN 0.0 ELSE len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) END AS score, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, item) AS nearness FROM t JOIN c a ON a.id = t.query JOIN c b ON b.id = t.item),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, cosine DESC, item) - 1 AS place, count(*) OVER (PARTITION BY query) AS n FROM o)
SELECT a.query, a.item AS positive, b.item AS negative, round((b.place - a.place) / (a.n - 1), 6) AS strength, CASE WHEN a.nearness <= 4 THEN 'top' ELSE 'hard' END AS positive_kind FROM p a JOIN p b ON a.query = b.query AND a.place < b.place""")
def training_rows(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", "text", F.when(F.col("turn") % 5 < 4, 0.5).otherwise(0.1).alias("weight"))
    found = L.training_set(talk.filter("role = 'user'"), talk.filter("role <> 'user'"), top=4, hard=2, random=0, least_weight=0.3)
    return found.select("query", "positive", "negative", "strength", "positive_kind")


@query(r"""WITH t AS (SELECT conv_id, turn, text || ' (Score = 0.5), src= .75 Highest-scoring alignment; scored: 88% at 12% Requirements' AS t FROM conversations),
m AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '\(\s*score\s*=\s*[-+]?\d*\.?\d+\s*\)', '', 'gi'), ',\s*src\s*=\s*[-+]?\d*\.?\d+', '', 'gi') AS marks, trim(regexp_replace(t, '\s+', ' ', 'g')) AS s FROM t)
SELECT conv_id, turn, marks, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\(\s*score\s*=\s*[-+]?\d*\.?\d+\s*\)', '', 'gi'), '\b(?:score|scored|scoring)\b\s*[:=]?\s*[-+]?\d*\.?\d+%?', '', 'gi'), '\bat\s+[-+]?\d*\.?\d+%?\b', '', 'gi'), '\bhighest[-\s]?scoring\b', 'strong', 'gi'), '\brequirements?\b', 'priority areas', 'gi'), '\balignment\b', 'fit', 'gi'), '\s+', ' ', 'g')) AS plain FROM m""")
def scrubbed_texts(spark, sf_dir):
    text = F.concat("text", F.lit(" (Score = 0.5), src= .75 Highest-scoring alignment; scored: 88% at 12% Requirements"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_score_marks(text).alias("marks"), T.without_scores(text).alias("plain"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'additional_info_chunk' WHEN 1 THEN 'additional_info_chunk' WHEN 2 THEN 'attachment_chunk' WHEN 3 THEN 'publication' WHEN 4 THEN event_type WHEN 5 THEN '' ELSE 'my_type' END AS source_type,
CASE event_id % 5 WHEN 0 THEN 'great' WHEN 1 THEN 'fantastic' WHEN 2 THEN 'bad' ELSE 'mismatch' END AS fit, CASE event_id % 4 WHEN 0 THEN 'applied_research' WHEN 1 THEN 'educational' ELSE 'unclear' END AS category FROM events""")
def canonical_names(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ("Additional-Info Chunk", "grant_additional_info_chunk", " attachments_CHUNK", "Faculty publication"))), (k % 7).cast("int"))
    kind = F.coalesce(kind, F.when(k % 7 == 4, F.col("event_type")).when(k % 7 == 6, F.lit("my  type")))
    fit = F.get(F.array(*map(F.lit, (" Greate", "FANTASTIC", "bad", "unheard of"))), (k % 5).cast("int"))
    category = F.get(F.array(*map(F.lit, ("Applied_Research ", "educational", "sports"))), (k % 4).cast("int"))
    return e.select("event_id", T.source_type(kind).alias("source_type"), T.fit_label(fit).alias("fit"), T.broad_category(category).alias("category"))


# Words of conversations as keywords: words in one of 64 places have equal vectors and are one cluster; every turn is a batch.
@query(f"""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS batch FROM conversations WHERE trim(text) <> ''),
m AS (SELECT conv_id, turn, batch, unnest({_toks('text', 4)}) AS text, unnest(range(0, len({_toks('text', 4)}))) AS i FROM c),
k AS (SELECT *, least(1.0, length(text) / 10.0) AS w, turn * 16777216 + i AS pos FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, batch ORDER BY least(1.0, length(text) / 10.0) DESC, turn * 16777216 + i) <= 50),
b AS (SELECT conv_id, count(DISTINCT batch) AS all_batches FROM k GROUP BY 1),
n AS (SELECT conv_id, text, count(*) AS n, list(DISTINCT batch) AS batches, sum(CAST(w AS DECIMAL(28,9))) AS ws, max(w) AS mw, min(pos) AS pos, CAST('0x' || substr(md5(text), 1, 6) AS BIGINT) % 64 AS place FROM k GROUP BY ALL),
g AS (SELECT conv_id, place, arg_min(text, (-n, -len(batches), -mw, pos)) AS label, sum(n) AS support, sum(ws) AS ws, len(list_distinct(flatten(list(batches)))) AS batches FROM n GROUP BY 1, 2),
t AS (SELECT *, max(support) OVER (PARTITION BY conv_id) AS most FROM g),
f AS (SELECT conv_id, place, label, support, batches / all_batches AS cover, CAST(round(CAST(greatest(0.0, least(1.0, 0.45 * (CAST(ws AS DOUBLE) / support) + 0.35 * (ln(1 + support) / ln(1 + most)) + 0.20 * (batches / all_batches)
 - 0.25 * (CASE WHEN support <= 1 THEN 0.25 ELSE 0.0 END + CASE WHEN regexp_matches(label, '[0-9]') THEN 0.1 ELSE 0.0 END))) AS DECIMAL(28,12)), 6) AS DOUBLE) AS weight FROM t JOIN b USING (conv_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, support DESC, cover DESC, label) AS INTEGER) AS rank FROM f QUALIFY rank <= 5),
v AS (SELECT conv_id, turn, p AS place, count(*) AS n FROM (SELECT conv_id, turn, unnest({_PLACES.format('text')}) AS p FROM c) GROUP BY ALL), z AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS z FROM v GROUP BY ALL),
s AS (SELECT r.conv_id, rank, turn, round(n / z, 6) AS score FROM r JOIN v USING (conv_id, place) JOIN z USING (conv_id, turn) WHERE round(n / z, 6) >= 0.1),
l AS (SELECT conv_id, rank, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY o) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, rank ORDER BY score DESC, turn) AS o FROM s) WHERE o <= 4 GROUP BY ALL)
SELECT r.conv_id, r.rank, r.label AS keyword, CAST(r.weight AS DOUBLE) AS weight, coalesce(sources, '') AS sources FROM r LEFT JOIN l ON l.conv_id = r.conv_id AND l.rank = r.rank""")
def generated_keywords(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "text")
    found = K.generated(talk, ["conv_id"], batch_chars=1, limit=5)
    return found.select("conv_id", "rank", F.col("t").alias("keyword"), "weight", F.array_join(F.transform("sources", lambda x: x["id"].cast("string")), ",").alias("sources"))
