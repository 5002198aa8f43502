"""Queries on text scalars, HTML and vectors from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import chunk, html, text as T
from weftline.models import scorers
from weftline.plans.registry import query
from weftline.session import table

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_ONE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"


def _toks(x: str, least: int = 3) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= {least} AND t NOT IN {_STOP})"


@query(f"""SELECT conv_id, turn, {_ONE.format('text')} AS single, array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(text, chr(160), ' '), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> ''), chr(10)) AS lines FROM conversations""")
def clean_texts(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", T.one_space(F.col("text")).alias("single"), T.clean_lines(F.col("text")).alias("lines"))


_NOISE = "(?i)" + "|".join(T.NOISE)


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), t AS (SELECT doc_id, {_TRIM.format('line')} AS t FROM l),
m AS (SELECT doc_id, t, length(t) AS n, length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')) AS letters, length(t) - length(regexp_replace(t, '\\p{{Nd}}', '', 'g')) AS digits, length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS upper,
 CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '\\s+')) END AS words, coalesce(list_sum(list_transform(regexp_extract_all(t, 'https?://\\S+|www\\.\\S+'), lambda x: length(x))), 0) AS links FROM t)
SELECT doc_id, count(*) AS n, count(*) FILTER (n < 40 OR letters < 8 OR digits > n * 0.35 OR words < 6 OR (upper > letters * 0.75 AND words <= 20) OR links > n * 0.2 OR regexp_matches(t, '{_NOISE}')) AS n_noisy FROM m GROUP BY 1""")
def noisy_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.noisy(F.col("line"))).alias("n_noisy"))


@query(None)
def embedding_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.chunked(F.col("text"), 1000)).alias("chunk", "text"))


@query(f"""SELECT doc_id, md5(substr(array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {_TRIM.format('x')}), lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[0-9]+') AND NOT regexp_matches(lower(x), '^(references|copyright|table of contents)')), chr(10)), 1, 1200)) AS hash FROM documents""")
def compressed_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.compressed(F.col("text"), 1200)).alias("hash"))


@query(f"""WITH c AS (SELECT conv_id, turn, text, {_ONE.format('text')} AS s FROM conversations), k AS (SELECT *, regexp_replace(substr(s, 1, 100), '\\s+$', '') AS cut FROM c), p AS (SELECT *, length(regexp_replace(cut, '[^ ]*$', '')) - 1 AS last FROM k)
SELECT conv_id, turn, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS plain, CASE WHEN length(s) <= 100 THEN s WHEN last >= 60 THEN rtrim(substr(cut, 1, last)) ELSE cut END AS excerpt,
trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[‘’“”]', '''', 'g'), '[^a-z0-9\\s\\-_/]', ' ', 'g'), '\\s+', ' ', 'g')) AS phrase FROM p""")
def text_forms(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_controls(x).alias("plain"), T.excerpt(x, 100).alias("excerpt"), T.phrase(x).alias("phrase"))


@query("""SELECT p_partkey, list_distinct_ordered AS marks, mails, bars FROM (SELECT p_partkey,
array_to_string(list_filter(list_transform([p_name, p_type, upper(p_name), ' - '], lambda x: regexp_replace(regexp_replace(lower(trim(x)), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')), lambda x, i: x <> '' AND i <> 3), ',') AS list_distinct_ordered,
concat(replace(p_name, ' ', '.'), '@x.org') AS mails, array_to_string([p_brand, p_type], ',') AS bars FROM part)""")
def list_scalars(spark, sf_dir):
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    mail = F.concat(F.replace(n, F.lit(" "), F.lit(".")), F.lit("@x.org"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(T.snake_list(F.array(n, t, F.upper(n), F.lit(" - "))), ",").alias("marks"),
        F.array_join(T.emails(F.concat(mail, F.lit("; "), F.upper(mail), F.lit(",none, "))), ",").alias("mails"),
        F.array_join(T.piped(F.concat(b, F.lit(" | | "), t)), ",").alias("bars"),
    )


@query("""SELECT p_partkey, '10.1/' || p_partkey AS doi, 'W' || p_partkey AS work, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS value FROM part""")
def identifier_scalars(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    url = F.concat(F.lit("https://x.org/a?user="), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(""), F.lit("&hl=en"))
    return table(spark, sf_dir, "part").select("p_partkey", T.doi(F.concat(F.lit(" DOI:  https://doi.org/10.1/"), k)).alias("doi"), T.work_id(F.concat(F.lit("https://openalex.org/W"), k, F.lit("/"))).alias("work"), T.query_value(url, "user").alias("value"))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, value / 50)) END AS unit, CASE WHEN event_type IN ('click', 'view') THEN TRUE WHEN event_type = 'error' THEN FALSE END AS flag,
CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'look' ELSE 'other' END AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(year(ts) AS INTEGER) AS year FROM events""")
def value_scalars(spark, sf_dir):
    kind = F.col("event_type")
    word = F.when(kind.isin("click", "view"), " Yes ").when(kind == "error", "off").otherwise("maybe")
    noisy = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        T.unit_float(F.coalesce((F.col("value") / 50).cast("string"), F.lit("n/a")), 0.5).alias("unit"),
        T.optional_bool(word).alias("flag"),
        T.one_of(kind, {"click": "press", "view": "look"}, "other").alias("kind"),
        F.get_json_object(T.json_object(noisy), "$.k").cast("int").alias("k"),
        F.year("ts").alias("year"),
    )


@query(f"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS w FROM conversations) SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') END AS text FROM w""")
def inverted_index_texts(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode_outer(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("at", "word"))
    places = words.filter("word is not null").groupBy("conv_id", "turn", "word").agg(F.collect_list(F.col("at") * 3).alias("places"))
    index = places.groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return every.join(index, ["conv_id", "turn"], "left").select("conv_id", "turn", T.from_inverted_index(F.col("index")).alias("text"))


@query(f"""SELECT p_partkey, p_name || chr(10) || chr(10) || p_type || CASE WHEN p_brand <> p_name THEN chr(10) || chr(10) || p_brand ELSE '' END AS joined, p_name || chr(10) || p_type AS query FROM part""")
def joined_texts(spark, sf_dir):
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.joined_once(F.array(n, t, F.upper(n), F.lit("  "), F.concat(F.lit(" "), b), F.lit(None).cast("string"), t)).alias("joined"), T.search_text(F.concat(n, F.lit("  ")), F.lit(" "), t).alias("query"))


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, lower({_ONE.format('a.text')}) AS q, lower({_ONE.format('b.text')}) AS c FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
t AS (SELECT *, {_toks('q')} AS qt, {_toks('c')} AS ct FROM p),
s AS (SELECT conv_id, turn, CASE WHEN len(qt) = 0 OR len(ct) = 0 THEN 0.0 ELSE least(1.0, len(list_filter(qt, lambda x: list_contains(ct, x))) / len(qt) + CASE WHEN contains(c, q) THEN 0.3 WHEN len(qt) >= 3 AND contains(c, array_to_string(qt[1:5], ' ')) THEN 0.15 ELSE 0.0 END) END AS score FROM t)
SELECT conv_id, turn, CAST(round(score, 6) AS DOUBLE) AS score, CAST(round(score * (0.65 + 0.35 * 0.5), 6) AS DOUBLE) AS weighted FROM s""")
def lexical_scores(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    answer = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    score = T.lexical_score(F.col("text"), F.col("answer"))
    found = talk.join(answer, ["conv_id", "turn"]).withColumn("score", score)
    return found.select("conv_id", "turn", F.round("score", 6).alias("score"), F.round(T.coverage_weighted(F.col("score"), F.lit(0.5)), 6).alias("weighted"))


@query(None)
def html_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.to_text(F.col("html")).alias("text"), html.stripped(F.col("html")).alias("plain"))


@query(r"""SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS l FROM pages)""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(html.links(F.col("html")), " ").alias("links"))


@query(r"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, '') || '<table><tr><th>id</th><td> <b>' || page_id || '</b> x</td></tr><TR></TR></table>', '(?is)<tr\b[^>]*>(.*?)</tr>', 1)) AS row FROM pages), c AS (SELECT page_id, list_transform(regexp_extract_all(row, '(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) AS cells FROM r)
SELECT page_id, count(*) AS n_rows, CAST(sum(len(cells)) AS BIGINT) AS n_cells, max(array_to_string(cells, '|')) AS cells FROM c WHERE len(cells) > 0 GROUP BY 1""")
def page_rows(spark, sf_dir):
    # The pages have hardly a table: each is given one.
    own = F.concat(F.coalesce("html", F.lit("")), F.lit("<table><tr><th>id</th><td> <b>"), F.col("page_id").cast("string"), F.lit("</b> x</td></tr><TR></TR></table>"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(html.table_rows(own)).alias("cells"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"), F.max(F.array_join("cells", "|")).alias("cells"))


@query(r"""SELECT p_partkey, p_name AS name, p_type AS kind FROM part""")
def page_labels(spark, sf_dir):
    page = F.concat(F.lit("<div><dt>Name:</dt><dd>"), F.col("p_name"), F.lit("</dd><h3 class='x'> Kind </h3>\n<p><span>"), F.col("p_type"), F.lit("</span></p></div>"))
    return table(spark, sf_dir, "part").select("p_partkey", html.labelled(page, "Name").alias("name"), html.labelled(page, "Kind").alias("kind"))


@query("""WITH t AS (SELECT conv_id, turn, [CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % 64 FOR w IN regexp_extract_all(lower(trim(text)), '[a-z0-9]+')] AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN len(b) > 0 THEN array_to_string([len(list_filter(b, lambda x: x = i)) FOR i IN range(64)], ',') ELSE '' END AS vector FROM t""")
def hashed_vectors(spark, sf_dir):
    found = scorers.embedded(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "v")
    return found.select("conv_id", "turn", F.coalesce(F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ","), F.lit("")).alias("vector"))


@query(f"""WITH t AS (SELECT a.conv_id, a.turn, list_distinct({_toks('a.text', 1)}) AS x, list_distinct({_toks('b.text', 1)}) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CAST(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) END AS DOUBLE) AS score FROM t""")
def pair_scores(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    answer = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("spec"))
    return scorers.pair_scorer()(talk.join(answer, ["conv_id", "turn"])).select("conv_id", "turn", F.round("score", 6).alias("score"))
