"""Queries on keywords, requirement coverage and match rows, teams and nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.models import scorers
from weftline.operators import coverage as C, keywords as K, payloads as P, teams
from weftline.plans.registry import query
from weftline.session import table, written

_PHRASE = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s\-_/]', ' ', 'g'), '\s+', ' ', 'g'))"

# A brand's mentions: part names, in batches by type, weighted by size.
_MENTIONS = "m AS (SELECT p_brand, p_name AS text, p_type AS batch, least(1.0, p_size / 40.0) AS weight, p_partkey AS pos FROM part)"


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("text"), F.col("p_type").alias("batch"), (F.col("p_size") / 40.0).alias("weight"), F.col("p_partkey").alias("pos"))


@query(f"""WITH {_MENTIONS}, k AS (SELECT *, {_PHRASE.format('text')} AS key FROM m) SELECT p_brand, key, arg_min(text, pos) AS text, count(*) AS n, array_to_string(list_sort(list(DISTINCT batch)), ',') AS batches, CAST(round(sum(weight), 6) AS DOUBLE) AS weight_sum, CAST(max(weight) AS DOUBLE) AS max_weight FROM k GROUP BY p_brand, key""")
def concepts(spark, sf_dir):
    found = K.concepts(_mentions(spark, sf_dir), ["p_brand"])
    return found.select("p_brand", "key", "text", "n", F.array_join("batches", ",").alias("batches"), F.round(F.col("weight_sum").cast("double"), 6).alias("weight_sum"), "max_weight")


# Names that end in the same word stand for similar phrases: their vectors are equal, others are at right angles.
_CLUSTERS = f"""{_MENTIONS}, k AS (SELECT *, {_PHRASE.format('text')} AS key FROM m), c AS (SELECT p_brand, key, arg_min(text, pos) AS text, count(*) AS n, list(DISTINCT batch) AS batches, sum(weight) AS ws, max(weight) AS mw, min(pos) AS pos FROM k GROUP BY ALL),
g AS (SELECT p_brand, string_split(key, ' ')[-1] AS g, arg_min(text, (-n, -len(batches), -mw, pos)) AS label, sum(n) AS support, sum(ws) AS ws, len(list_distinct(flatten(list(batches)))) AS batches FROM c GROUP BY 1, 2),
t AS (SELECT *, max(support) OVER (PARTITION BY p_brand) AS most FROM g), b AS (SELECT p_brand, count(DISTINCT p_type) AS all_batches FROM part GROUP BY 1),
w AS (SELECT p_brand, label, support, CAST(ws AS DOUBLE) / support AS quality, ln(1 + support) / ln(1 + most) AS global_support, batches / all_batches AS batch_coverage,
 CASE WHEN support <= 1 THEN 0.25 ELSE 0.0 END + CASE WHEN regexp_matches(label, '[0-9]') THEN 0.1 ELSE 0.0 END AS penalty FROM t JOIN b USING (p_brand)),
f AS (SELECT *, CAST(round(CAST(greatest(0.0, least(1.0, 0.45 * quality + 0.35 * global_support + 0.20 * batch_coverage - 0.25 * penalty)) AS DECIMAL(28,12)), 6) AS DOUBLE) AS weight FROM w)"""


def _cluster_scores(spark, sf_dir):
    found = written(K.concepts(_mentions(spark, sf_dir), ["p_brand"]), "concepts", small=True)
    last = F.element_at(F.split("key", " "), -1)
    vectors = found.select("p_brand", "key", scorers.hashed_vector(last, 512).alias("vector"))
    grouped = K.clusters(found, vectors, ["p_brand"])
    batches = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("all_batches"))
    return K.cluster_scores(grouped, ["p_brand"], batches)


@query(f"WITH {_CLUSTERS} SELECT p_brand, label, CAST(support AS BIGINT) AS support, CAST(round(CAST(quality AS DECIMAL(28,12)), 6) AS DOUBLE) AS quality, round(batch_coverage, 6) AS batch_coverage, CAST(penalty AS DOUBLE) AS penalty, CAST(weight AS DOUBLE) AS weight FROM f")
def cluster_scores(spark, sf_dir):
    return _cluster_scores(spark, sf_dir).select("p_brand", "label", "support", F.round(F.col("quality").cast("decimal(28,12)"), 6).cast("double").alias("quality"), F.round("batch_coverage", 6).alias("batch_coverage"), F.round("penalty", 6).alias("penalty"), "weight")


@query(f"WITH {_CLUSTERS} SELECT p_brand, label, CAST(weight AS DOUBLE) AS weight, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY weight DESC, support DESC, batch_coverage DESC, label) AS INTEGER) AS rank FROM f QUALIFY rank <= 3")
def section_keywords(spark, sf_dir):
    return K.section_keywords(_cluster_scores(spark, sf_dir), ["p_brand"], 3).select("p_brand", "label", "weight", "rank")


@query(f"""WITH x AS (SELECT p_brand, lower(p_name) AS key, min((p_type, p_partkey)) AS turn, arg_min(p_name, (p_type, p_partkey)) AS text FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY turn) AS r FROM x)
SELECT p_brand, string_agg(text, ',' ORDER BY r) AS items FROM r WHERE r <= 10 GROUP BY 1""")
def merged_once(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("batch"), F.col("p_partkey").alias("pos"), F.concat(F.lit(" "), "p_name").alias("text"))
    return K.merged_once(rows, ["p_brand"], 10).select("p_brand", F.array_join("items", ",").alias("items"))


@query("""WITH i AS (SELECT p_brand, p_size % 5 AS batch, p_partkey AS pos, p_name AS t, p_retailprice / 2000 AS w FROM part), f AS (SELECT p_brand, batch, lower(t) AS key, arg_min(least(1.0, w), pos) AS w, arg_min(t, pos) AS t FROM i GROUP BY ALL),
b AS (SELECT p_brand, key, arg_max(t, (w, -batch)) AS t, max(w) AS w, count(*) AS support FROM f GROUP BY ALL), e AS (SELECT DISTINCT p_brand, lower(p_type) AS key, p_type AS extra FROM part)
SELECT coalesce(b.p_brand, e.p_brand) AS p_brand, coalesce(b.key, e.key) AS key, coalesce(t, extra) AS t, coalesce(w, 0.0) AS w, coalesce(support, 0) AS support FROM b FULL JOIN e ON b.p_brand = e.p_brand AND b.key = e.key""")
def merged_weights(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    items = part.select("p_brand", (F.col("p_size") % 5).alias("batch"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("t"), (F.col("p_retailprice") / 2000).alias("w"))
    return K.merged_weights(items, part.select("p_brand", F.col("p_type").alias("t")), ["p_brand"])


@query("""WITH o AS (SELECT p_brand, lower(p_name) AS key, arg_min(p_size / 50.0, p_partkey) AS w FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), n AS (SELECT p_brand, lower(p_name) AS key, arg_min(p_size / 50.0, p_partkey) AS w FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL)
SELECT coalesce(o.p_brand, n.p_brand) AS p_brand, coalesce(o.key, n.key) AS key, CASE WHEN o.w IS NULL THEN 'added' WHEN n.w IS NULL THEN 'deleted' ELSE 'weight_changed' END AS change FROM o FULL JOIN n ON o.p_brand = n.p_brand AND o.key = n.key WHERE o.w IS NULL OR n.w IS NULL OR abs(o.w - n.w) > 1e-9""")
def keyword_list_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("pos"), F.upper("p_name").alias("t"), (F.col("p_size") / 50.0).alias("w"))
    return K.keyword_differences(rows.filter("pos % 2 = 0"), rows.filter("pos % 3 = 0"), ["p_brand"]).select("p_brand", "key", "change")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' WHEN p_partkey % 2 = 0 THEN 'old' ELSE '' END AS sources FROM part""")
def with_sources(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    named = lambda rows, x: rows.withColumn("sources", F.array(F.lit(x)))
    found = K.with_sources(part, named(part.filter("p_partkey % 3 = 0"), "new"), named(part.filter("p_partkey % 2 = 0"), "old"), ["p_partkey"])
    return found.withColumn("sources", F.array_join("sources", ","))


@query("""SELECT p_brand, string_agg(t || '=' || w, ',' ORDER BY t) AS weights FROM (SELECT p_brand, p_name AS t, max(p_size) AS w FROM part GROUP BY ALL) GROUP BY 1""")
def weight_map(spark, sf_dir):
    found = K.weight_map(table(spark, sf_dir, "part").select("p_brand", F.concat(F.col("p_name"), F.lit("  ")).alias("t"), F.col("p_size").alias("w")), ["p_brand"])
    return found.select("p_brand", F.array_join(F.transform(F.map_entries("weights"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("weights"))


@query("""WITH s AS (SELECT l_partkey, l_suppkey AS id, l_returnflag AS type, max(l_discount * 10) AS score FROM lineitem WHERE l_discount * 10 >= 0.1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY round(least(1.0, score), 6) DESC, type, id) AS r FROM s)
SELECT l_partkey, id, type, round(least(1.0, score), 6) AS score, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 4""")
def best_sources(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("type"), (F.col("l_discount") * 10).alias("score"))
    return K.best_sources(scored, ["l_partkey"])


@query("""SELECT l_suppkey, count(*) AS n, count(*) FILTER (s >= 0.75) AS at_0, count(*) FILTER (s >= 0.5 AND s < 0.75) AS at_1, count(*) FILTER (s >= 0.35 AND s < 0.5) AS at_2, count(*) FILTER (s < 0.35) AS below, round(avg(s), 6) AS mean, min(s) AS least, max(s) AS most FROM (SELECT l_suppkey, l_discount * 10 AS s FROM lineitem) GROUP BY 1""")
def quality_bands(spark, sf_dir):
    return K.quality_bands(table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") * 10).alias("score")), ["l_suppkey"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS label FROM part")
def valid_labels(spark, sf_dir):
    name = F.col("p_name")
    candidate = F.when(F.col("p_partkey") % 2 == 0, name).otherwise("the nothing of it")
    return table(spark, sf_dir, "part").select("p_partkey", K.valid_label(candidate, F.array(F.upper(name), F.lit("the")), F.col("p_type")).alias("label"))


def _documents(spark, sf_dir):
    """Keyword documents of brands: part names as strings and as objects, one section as JSON text."""
    part = table(spark, sf_dir, "part")
    quoted = F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))
    item = F.when(F.col("p_partkey") % 3 == 0, quoted).when(F.col("p_partkey") % 3 == 1, F.format_string('{"t":%s,"w":0.%d}', quoted, F.col("p_size"))).otherwise(F.format_string('{"t":%s}', quoted))
    lists = part.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("i")))), lambda x: x["i"]), ",").alias("items"))
    research = F.format_string('{"domain":[" d  1 ","","d 2","d 1"],"specialization":[%s,7]}', F.col("items"))
    application = F.to_json(F.struct(F.format_string('{"specialization":[%s]}', F.col("items")).alias("application")))
    doc = F.concat(F.lit('{"research":'), research, F.lit(","), F.substring(application, F.lit(2), F.length(application)))
    return lists.select("p_brand", doc.alias("doc"))


_SPECS = "i AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_name AS t, CASE WHEN p_partkey % 3 = 1 THEN CAST('0.' || p_size AS DOUBLE) ELSE 1.0 END AS w FROM part)"


@query(f"WITH {_SPECS} SELECT p_brand, section, CAST(pos AS INTEGER) AS pos, t, w FROM i, (SELECT unnest(['research', 'application']) AS section)")
def specializations(spark, sf_dir):
    return K.specializations(_documents(spark, sf_dir), "p_brand", "doc")


@query(f"""WITH {_SPECS}, f AS (SELECT p_brand, t, arg_min(w, pos) AS w FROM i GROUP BY ALL) SELECT p_brand, 'd 1,d 2' AS domain, string_agg(t || '=' || printf('%.2f', w), ',' ORDER BY t) AS specialization FROM f GROUP BY 1""")
def keyword_inventory(spark, sf_dir):
    found = K.inventory(_documents(spark, sf_dir), "p_brand", "doc")
    return found.select("p_brand", F.array_join("domain", ",").alias("domain"), F.array_join(F.transform(F.map_entries("specialization"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("specialization"))


# Goals are brands, their requirements part names by type; people are suppliers of the parts.
_TEXTS = """n AS (SELECT p_brand AS goal, p_type AS section, p_size AS idx, min(p_name) AS text, count(*) / 10.0 AS weight FROM part GROUP BY ALL),
s AS (SELECT DISTINCT s_suppkey AS person, p_type AS section, p_size AS spec_idx, p_name AS spec FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey),
g AS (SELECT DISTINCT goal, person, round(1.5 - person % 8 / 8.0, 6) AS domain_score FROM (SELECT DISTINCT goal, CAST(substr(goal, 7) AS INTEGER) % 25 AS k FROM n) b JOIN (SELECT DISTINCT person FROM s) q ON k = person % 25 OR k = (person + 7) % 25),
p AS (SELECT goal, person, section, idx, spec_idx, CAST(len(list_intersect(string_split(text, ' '), string_split(spec, ' '))) AS DOUBLE) / len(list_distinct(list_concat(string_split(text, ' '), string_split(spec, ' ')))) AS score FROM g JOIN n USING (goal) JOIN s USING (person, section))"""


def _pair_tables(spark, sf_dir):
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    needs = part.groupBy(F.col("p_brand").alias("goal"), F.col("p_type").alias("section"), F.col("p_size").alias("idx")).agg(F.min("p_name").alias("text"), (F.count("*") / 10.0).alias("weight"))
    supplied = line.join(part, line.l_partkey == part.p_partkey)
    specs = supplied.select(F.col("l_suppkey").alias("person"), F.col("p_type").alias("section"), F.col("p_size").alias("spec_idx"), F.col("p_name").alias("spec")).repartition("person").distinct()
    # Two brands stand for each person's candidates.
    numbered = needs.select("goal").distinct().withColumn("k", F.substring("goal", 7, 9).cast("int") % 25)
    people = specs.select("person").distinct().withColumn("k", F.explode(F.array(F.col("person") % 25, (F.col("person") + 7) % 25)))
    found = people.join(numbered, "k").select("goal", "person").distinct().withColumn("domain_score", F.round(1.5 - F.col("person") % 8 / 8.0, 6))
    return needs, specs, found


def _pairs(needs, specs, found):
    return C.pair_scores(needs, specs, found, scorers.pair_scorer(), ["section"])


@query(f"WITH {_TEXTS} SELECT goal, person, section, idx, count(*) AS n, round(sum(score), 6) AS total FROM p GROUP BY ALL")
def requirement_pairs(spark, sf_dir):
    return _pairs(*_pair_tables(spark, sf_dir)).groupBy("goal", "person", "section", "idx").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query(f"""WITH {_TEXTS}, m AS (SELECT goal, person, section, idx, avg(score) AS c FROM p GROUP BY ALL), h AS (SELECT goal, person, section, idx, weight, coalesce(c, 0) AS c FROM g JOIN n USING (goal) LEFT JOIN m USING (goal, person, section, idx)),
x AS (SELECT goal, person, sum(weight * score) / sum(weight) AS x FROM p JOIN n USING (goal, section, idx) GROUP BY ALL)
SELECT goal, person, domain_score, CAST(round(round(coalesce(x, 0), 6) * least(1.0, domain_score), 6) AS DOUBLE) AS llm_score, n_covered, n_missing FROM g LEFT JOIN x USING (goal, person) JOIN (SELECT goal, person, count(*) FILTER (round(c, 9) >= 0.3) AS n_covered, count(*) FILTER (round(c, 9) < 0.3) AS n_missing FROM h GROUP BY ALL) USING (goal, person)""")
def match_rows(spark, sf_dir):
    needs, specs, found = _pair_tables(spark, sf_dir)
    rows = C.text_match_rows(found, needs, specs, scorers.pair_scorer(), sections=["section"])
    return rows.select("goal", "person", "domain_score", "llm_score", F.size("covered").cast("long").alias("n_covered"), F.size("missing").cast("long").alias("n_missing"))


@query(f"""WITH {_TEXTS}, m AS (SELECT goal, person, section, idx, round(avg(score), 6) AS c FROM p GROUP BY ALL), e AS (SELECT goal, person, section, idx, spec_idx, max(score) AS score FROM p GROUP BY ALL)
SELECT goal, person, section, idx, spec_idx, CAST(row_number() OVER (PARTITION BY goal ORDER BY score DESC, c DESC, person, section, idx, spec_idx) AS INTEGER) AS rank FROM e JOIN m USING (goal, person, section, idx) QUALIFY rank <= 20""")
def flat_evidence(spark, sf_dir):
    needs, specs, found = _pair_tables(spark, sf_dir)
    return C.text_evidence(found, needs, specs, scorers.pair_scorer(), 20).drop("score", "need_score")


@query(f"""WITH {_TEXTS}, m AS (SELECT goal, person, section, idx, avg(score) AS c FROM p GROUP BY ALL), h AS (SELECT goal, section, idx, text, weight, max(coalesce(c, 0)) AS c FROM g JOIN n USING (goal) LEFT JOIN m USING (goal, person, section, idx) GROUP BY ALL),
d AS (SELECT goal, lower(text) AS key, max(weight) AS weight, max(text) AS text FROM h WHERE round(c, 6) <= 0.4 GROUP BY ALL) SELECT goal, text, CAST(weight AS DOUBLE) AS weight, CAST(row_number() OVER (PARTITION BY goal ORDER BY weight DESC, key) AS INTEGER) AS rank FROM d QUALIFY rank <= 5""")
def team_gaps(spark, sf_dir):
    needs, specs, found = _pair_tables(spark, sf_dir)
    held = C.best_coverage(_pairs(needs, specs, found), needs, found, ["section"])
    return C.gaps(held, 0.4).withColumn("weight", F.col("weight").cast("double"))


_COVER = """n AS (SELECT p_brand AS goal, p_size AS idx, count(*) / 10.0 AS weight FROM part GROUP BY ALL), pr AS (SELECT p_brand AS goal, l_suppkey AS person, p_size AS idx, l_discount * 10 AS score FROM lineitem JOIN part ON l_partkey = p_partkey),
pe AS (SELECT DISTINCT goal, person FROM pr), me AS (SELECT goal, person, idx, round(avg(score), 6) AS c FROM pr GROUP BY ALL), cv AS (SELECT goal, person, idx, weight, coalesce(c, 0.0) AS c FROM pe JOIN n USING (goal) LEFT JOIN me USING (goal, person, idx))"""


def _cover_pairs(spark, sf_dir):
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    pairs = line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_brand").alias("goal"), F.col("l_suppkey").alias("person"), F.col("p_size").alias("idx"), (F.col("l_discount") * 10).alias("score"))
    needs = part.groupBy(F.col("p_brand").alias("goal"), F.col("p_size").alias("idx")).agg((F.count("*") / 10.0).alias("weight"))
    return pairs, needs


def _covered(spark, sf_dir):
    pairs, needs = _cover_pairs(spark, sf_dir)
    return C.coverage(pairs, needs, pairs.select("goal", "person").distinct())


@query(f"""WITH {_COVER}, t AS (SELECT x.goal, x.person AS a, y.person AS b, sum(CAST(x.weight * greatest(x.c, y.c) AS DECIMAL(28,9))) AS cov, sum(CAST(x.weight AS DECIMAL(28,9))) AS most FROM cv x JOIN cv y ON x.goal = y.goal AND x.idx = y.idx AND x.person < y.person GROUP BY ALL),
s AS (SELECT goal, a, b, round(0.7 * CAST(cov AS DOUBLE) / CAST(most AS DOUBLE) + 0.3 * (a / 20.0 + CASE WHEN b < 10 THEN b / 20.0 ELSE 0.0 END - CASE WHEN a >= 10 THEN a / 20.0 ELSE 0.0 END) / 2, 6) AS score FROM t)
SELECT goal, a || ',' || b AS team, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY goal ORDER BY score DESC, a, b) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""")
def blended_teams(spark, sf_dir):
    held = _covered(spark, sf_dir)
    scores = held.select("goal", "person").distinct().filter("person < 10").withColumn("score", F.col("person") / 20.0)
    found = teams.best_teams(held, 2, 3, scores=scores)
    return found.select("goal", F.array_join(F.transform("team", lambda x: x.cast("string")), ",").alias("team"), "score", "rank")


@query(f"""WITH {_COVER}, al AS (SELECT goal, person FROM (SELECT DISTINCT goal FROM n), (SELECT unnest([1, 2, 500]) AS person)) SELECT goal, person, idx, coalesce(c, 0.0) AS c FROM al JOIN n USING (goal) LEFT JOIN me USING (goal, person, idx)""")
def zero_filled(spark, sf_dir):
    held = _covered(spark, sf_dir)
    needs = held.select("goal", "idx", "weight").distinct()
    people = needs.select("goal", F.explode(F.array(F.lit(1), F.lit(2), F.lit(500))).alias("person")).distinct()
    return C.zero_filled(held, needs, people).select("goal", F.col("person").cast("int").alias("person"), "idx", "c")


@query(f"""WITH {_COVER}, l AS (SELECT *, 'need ' || idx AS label FROM cv WHERE idx % 2 = 0) SELECT goal, person, coalesce(string_agg(label, ',' ORDER BY idx) FILTER (c > 0), '') AS covered, coalesce(string_agg(label, ',' ORDER BY idx) FILTER (c <= 0), '') AS missing FROM l GROUP BY ALL""")
def decoded_scores(spark, sf_dir):
    held = _covered(spark, sf_dir)
    labels = held.select("goal", "idx").distinct().filter("idx % 2 = 0").withColumn("label", F.concat(F.lit("need "), F.col("idx").cast("string")))
    return P.decoded(held, labels).select("goal", "person", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"))


# ---- nested documents: customers are people, their orders publications, events chunks

_PUBS = "p AS (SELECT o_custkey AS c_custkey, o_orderkey AS id, o_orderpriority || ' ' || o_orderkey AS title, o_orderstatus AS abstract, CASE WHEN o_orderkey % 10 > 0 THEN year(o_orderdate) END AS year FROM orders)"


def _publications(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderstatus").alias("abstract"), F.when(F.col("o_orderkey") % 10 > 0, F.year("o_orderdate")).alias("year"))


def _chunks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("c_custkey"), F.coalesce("event_type", F.lit("none")).alias("source"), F.col("event_id").cast("int").alias("chunk_index"), F.col("props").alias("content"))


_CH = "h AS (SELECT user_id AS c_custkey, coalesce(event_type, 'none') AS source, event_id AS chunk_index, props AS content FROM events)"


@query(f"""WITH {_PUBS}, {_CH}, a AS (SELECT c_custkey, count(*) AS n, md5(string_agg(source || content, '|' ORDER BY source, chunk_index)) AS hash FROM h GROUP BY 1), b AS (SELECT c_custkey, count(*) AS n, string_agg(title, '|' ORDER BY -coalesce(year, 0), title) AS titles FROM p GROUP BY 1)
SELECT c_custkey, CAST(coalesce(a.n, 0) AS INTEGER) AS n_chunks, CAST(coalesce(b.n, 0) AS INTEGER) AS n_publications, coalesce(hash, md5('')) AS hash, coalesce(titles, '') AS titles FROM customer LEFT JOIN a USING (c_custkey) LEFT JOIN b USING (c_custkey)""")
def person_context(spark, sf_dir):
    found = P.person_context(table(spark, sf_dir, "customer"), _chunks(spark, sf_dir), _publications(spark, sf_dir), "c_custkey")
    joined = F.md5(F.array_join(F.transform("chunks", lambda x: F.concat(x["source"], x["content"])), "|"))
    return found.select("c_custkey", "n_chunks", "n_publications", joined.alias("hash"), F.array_join(F.transform("publications", lambda x: x["title"]), "|").alias("titles"))


@query(f"""WITH {_CH}, i AS (SELECT * FROM h WHERE chunk_index % 2 = 0), a AS (SELECT * FROM h WHERE chunk_index % 2 = 1) SELECT c.c_custkey, (SELECT count(*) FROM i WHERE i.c_custkey = c.c_custkey) AS n_infos, (SELECT count(*) FROM a WHERE a.c_custkey = c.c_custkey) AS n_attachments, (SELECT min(source) FROM i WHERE i.c_custkey = c.c_custkey) AS link FROM customer c""")
def opportunity_context(spark, sf_dir):
    h = _chunks(spark, sf_dir)
    found = P.opportunity_context(table(spark, sf_dir, "customer"), h.filter("chunk_index % 2 = 0"), h.filter("chunk_index % 2 = 1"), "c_custkey")
    return found.select("c_custkey", F.size("infos").cast("long").alias("n_infos"), F.size("attachments").cast("long").alias("n_attachments"), "link")


@query("""WITH p AS (SELECT p_brand, lower(p_name) AS key, min((CASE WHEN p_size < 25 THEN 1 ELSE 2 END, p_partkey)) AS turn, arg_min(p_name, (CASE WHEN p_size < 25 THEN 1 ELSE 2 END, p_partkey)) AS text FROM part GROUP BY ALL) SELECT p_brand, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS content FROM p GROUP BY 1""")
def merged_content(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select("p_brand", F.when(F.col("p_size") < 25, 1).otherwise(2).alias("family"), F.col("p_partkey").alias("place"), F.col("p_name").alias("text"))
    return P.merged_content(rows, "p_brand").withColumn("content", F.md5("content"))


@query("""WITH o AS (SELECT o_custkey AS c_custkey, o_orderpriority AS text, min((CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END, o_orderkey)) AS turn FROM orders WHERE o_orderkey % 6 > 0 GROUP BY ALL), l AS (SELECT c_custkey, string_agg(text, '|' ORDER BY turn) AS contents FROM o GROUP BY 1)
SELECT c_custkey, coalesce(contents, c_name) AS contents FROM customer LEFT JOIN l USING (c_custkey)""")
def keyword_contents(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 6 > 0, F.concat("o_orderpriority", F.lit(" "))).otherwise("  ")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("family"), F.col("o_orderkey").alias("place"), text.alias("text"))
    found = P.contents(o, "c_custkey", table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("text")))
    return found.select("c_custkey", F.array_join("contents", "|").alias("contents"))


@query(f"""WITH {_PUBS}, r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY coalesce(year, 0) DESC, id DESC) AS r FROM p), t AS (SELECT c_custkey, string_agg(title, '; ' ORDER BY r) AS titles FROM r WHERE r <= 5 GROUP BY 1)
SELECT c_custkey, c_name || coalesce(chr(10) || 'Recent publications: ' || titles, '') AS query FROM customer LEFT JOIN t USING (c_custkey)""")
def person_queries(spark, sf_dir):
    return P.person_query(table(spark, sf_dir, "customer"), _publications(spark, sf_dir), "c_custkey", "c_name")


@query(f"""WITH {_PUBS}, a AS (SELECT c_custkey, min(year) AS first_year, max(year) AS latest_year, max(year) FILTER (year BETWEEN 1996 AND 1998) AS fetched_upto, count(*) FILTER (year BETWEEN 1996 AND 1998) AS n FROM p GROUP BY 1)
SELECT c_custkey, CAST(first_year AS INTEGER) AS first_year, CAST(latest_year AS INTEGER) AS latest_year, CAST(fetched_upto AS INTEGER) AS fetched_upto, CAST(coalesce(n, 0) AS INTEGER) AS n FROM customer LEFT JOIN a USING (c_custkey)""")
def profiles(spark, sf_dir):
    found = P.profiles(table(spark, sf_dir, "customer").select("c_custkey"), _publications(spark, sf_dir), "c_custkey", 1996, 1998)
    return found.select("c_custkey", "first_year", "latest_year", "fetched_upto", F.size("publications").alias("n"))


@query(f"""WITH {_COVER}, s AS (SELECT goal, person, person / 20.0 AS score FROM pe) SELECT goal, (SELECT md5(string_agg(idx || '=' || printf('%.2f', weight), ',' ORDER BY CAST(idx AS VARCHAR))) FROM n WHERE n.goal = g.goal) AS needs, (SELECT md5(string_agg(person || ':' || idx || '=' || printf('%.6f', c), ',' ORDER BY person, CAST(idx AS VARCHAR))) FROM cv WHERE cv.goal = g.goal) AS coverage, (SELECT string_agg(CAST(person AS VARCHAR), ',' ORDER BY person) FROM pe WHERE pe.goal = g.goal) AS people, CAST(round((SELECT max(score) FROM s WHERE s.goal = g.goal), 6) AS DOUBLE) AS best FROM (SELECT DISTINCT goal FROM pe) g""")
def matching_inputs(spark, sf_dir):
    pairs, needs = _cover_pairs(spark, sf_dir)
    people = pairs.select("goal", "person").distinct()
    held = C.coverage(pairs, needs, people)
    name = F.col("idx").cast("string")
    scores = people.withColumn("score", F.col("person") / 20.0)
    found = P.matching_parts(needs.select("goal", name.alias("name"), "weight"), held.select("goal", "person", name.alias("name"), "c"), scores)
    shown = lambda m, form: F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.format_string(form, e["value"].cast("double"))))
    # Everybody has a row for each requirement, so no person's text is empty.
    covered = F.transform(F.map_entries("coverage"), lambda p: F.array_join(F.transform(shown(p["value"], "%.6f"), lambda y: F.concat(p["key"].cast("string"), F.lit(":"), y)), ","))
    needed = F.md5(F.array_join(shown("requirements", "%.2f"), ","))
    parts = found.select("goal", "part", needed.alias("needs"), F.array_join(covered, ",").alias("text"), F.array_join(F.transform("people", lambda x: x.cast("string")), ",").alias("people"), F.array_max(F.map_values("scores")).alias("best"))
    return P.joined_parts(parts, "text").select("goal", "needs", F.col("hash").alias("coverage"), "people", F.round("best", 6).alias("best"))


@query(f"""WITH {_COVER}, m AS (SELECT goal, person, CAST(round(sum(c), 6) AS DOUBLE) AS score FROM cv GROUP BY ALL) SELECT goal, string_agg(CAST(person AS VARCHAR), ',' ORDER BY score DESC, person) AS candidates FROM m GROUP BY 1""")
def rerank_inventory(spark, sf_dir):
    held = _covered(spark, sf_dir)
    matches = held.groupBy("goal", "person").agg(F.round(F.sum(F.col("c").cast("decimal(28,9)")).cast("double"), 6).alias("score"))
    plain = lambda key: held.select(key).distinct().select(key, F.array(F.lit("d")).alias("domain"), F.create_map(F.lit("s"), F.lit("1.00")).alias("specialization"))
    found = P.rerank_inventory(matches, plain("goal"), plain("person"), "goal", "person", "score")
    return found.select("goal", F.array_join(F.transform("candidates", lambda x: x["person"].cast("string")), ",").alias("candidates"))


@query(f"""WITH {_COVER}, t AS (SELECT goal, 1 AS rank, unnest([3, 1]) AS person, unnest([0, 1]) AS place FROM (SELECT DISTINCT goal FROM n)) SELECT t.goal, string_agg(s_name, ',' ORDER BY place) AS names, CAST((SELECT count(DISTINCT person) FROM cv WHERE cv.goal = t.goal AND person IN (1, 3)) AS INTEGER) AS n_covering FROM t JOIN supplier ON s_suppkey = person GROUP BY 1""")
def team_context(spark, sf_dir):
    held = _covered(spark, sf_dir)
    goals = held.select("goal").distinct()
    teams = goals.select("goal", F.lit(1).alias("rank"), F.array(F.lit(3), F.lit(1)).cast("array<bigint>").alias("team"), F.lit(0.0).alias("score"))
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name"))
    found = P.team_context(teams, goals, people, held.select("goal", "person", F.col("idx").cast("string").alias("name"), "c"))
    return found.select("goal", F.array_join(F.transform("members", lambda x: x["name"]), ",").alias("names"), F.size("coverage").alias("n_covering"))


@query("SELECT s_suppkey, CAST(place AS INTEGER) AS place, s_suppkey + place AS person FROM supplier, (SELECT unnest([0, 1]) AS place)")
def expanded_teams(spark, sf_dir):
    k = F.col("s_suppkey")
    teams = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(k.cast("string"), F.lit(", x, "), (k + 1).cast("string"), F.lit(",")).alias("team"))
    return P.expanded_teams(teams, "team")


@query("""WITH r AS (SELECT l_suppkey, l_linenumber AS rank, l_partkey AS id FROM lineitem WHERE l_orderkey % 50 = 0), f AS (SELECT l_suppkey, p_name AS text, min((rank, id)) AS turn FROM r JOIN part ON p_partkey = id GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY turn) AS n FROM f)
SELECT l_suppkey, string_agg(text, ',' ORDER BY n) AS texts FROM k WHERE n <= 2 GROUP BY 1""")
def source_texts(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").filter("l_orderkey % 50 = 0").select("l_suppkey", F.col("l_linenumber").alias("rank"), F.lit("part").alias("type"), F.col("l_partkey").alias("id"))
    sources = table(spark, sf_dir, "part").select(F.lit("part").alias("type"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return P.source_texts(refs, sources, ["l_suppkey"], 2).withColumn("texts", F.array_join("texts", ","))


@query("""WITH a AS (SELECT p_brand, 1 AS turn, 'info' AS type, p_partkey AS id, p_name AS excerpt FROM part WHERE p_size < 25 UNION ALL SELECT p_brand, 2, 'publication', p_partkey, p_type FROM part)
SELECT p_brand, type, id, excerpt, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY turn, id, excerpt) AS INTEGER) AS place FROM a QUALIFY place <= 30""")
def source_catalog(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = part.filter("p_size < 25").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return P.source_catalog([("info", first), ("publication", part.select("p_brand", F.col("p_partkey").alias("id"), F.col("p_type").alias("text")))], "p_brand", 30)
