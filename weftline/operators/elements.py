"""Elements of HTML as rows: an interval of places for each, and joins by those intervals.

A page is a list of tokens (tags and texts) at places 0, 1, ... Each name of a tag has a depth of its
own, a running sum over its tags that never falls below zero, so a closing tag ends the latest open
element of its name whatever stands between, and closing tags without one count for nothing. An
element that nothing closes ends at the next tag of its name, or with the smallest closed element
around it, or with the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.html import BEGINS, ENDS

#: Comments, scripts and styles whole; tags; declarations; texts; a lone bracket is text.
TOKEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^>]*>|<![^>]*>|[^<]+|<"
# Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
HIDDEN = ("script", "style")


def tokens(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(id, place, kind, name, text): kind is open, close, void or text; comments, scripts, styles and declarations drop out.

    A null or empty page has no tokens. name is lower case, null for texts; text is the token.
    """
    found = pages.select(F.col(id_column).alias("id"), F.posexplode(F.regexp_extract_all(html_column, F.lit(TOKEN), F.lit(0))).alias("place", "text"))
    tag = F.nullif(F.lower(F.regexp_extract("text", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)), F.lit(""))
    kind = (
        F.when(F.col("text").startswith("<!") | F.col("name").isin(*HIDDEN), None)
        .when(F.col("name").isNull(), "text")
        .when(F.col("text").startswith("</"), "close")
        .when(F.col("name").isin(*VOID) | F.col("text").endswith("/>"), "void")
        .otherwise("open")
    )
    return found.withColumn("name", tag).withColumn("kind", kind).filter("kind IS NOT NULL").select("id", "place", "kind", "name", "text")


def elements(found: DataFrame) -> DataFrame:
    """(id, name, begin, end, depth, closed) from tokens: begin and end are places, depth counts the elements around it."""
    own = Window.partitionBy("id", "name").orderBy("place")
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("kind") == "open", 1).otherwise(-1)
    last = found.groupBy("id").agg((F.max("place") + 1).alias("length"))
    tags = found.filter("kind IN ('open', 'close')").withColumn("total", F.sum(step).over(upto))
    floor = lambda w: F.least(F.lit(0), F.coalesce(F.min("total").over(w), F.lit(0)))
    # An opening tag's depth with itself, a closing tag's with the element that it ends (0: there is none).
    level = F.when(F.col("kind") == "open", F.col("total") - floor(upto)).otherwise(F.col("total") + 1 - floor(before))
    tags = tags.withColumn("level", level).withColumn("next", F.lead("place").over(own))
    same = Window.partitionBy("id", "name", "level").orderBy("place")
    closed = F.lead("kind").over(same) == "close"
    ended = tags.withColumn("closed", F.coalesce(closed, F.lit(False))).withColumn("end", F.when(F.col("closed"), F.lead("place").over(same)).otherwise(F.col("next")))
    spans = ended.filter("kind = 'open'").join(last, "id").select("id", "name", F.col("place").alias("begin"), F.coalesce("end", "length").alias("end"), "closed")
    around = spans.filter("closed").select("id", F.col("begin").alias("from"), F.col("end").alias("to"))
    cut = spans.filter("NOT closed").join(around, "id").filter("from < begin AND begin < to").groupBy("id", "begin").agg(F.min("to").alias("to"))
    spans = spans.join(cut, ["id", "begin"], "left").withColumn("end", F.least("end", "to")).drop("to")
    # Of events at one place the end of an element comes before the begin of the next.
    events = spans.select("id", F.col("begin").alias("at"), F.lit(1).alias("step"), "name", "begin", "end", "closed").unionByName(spans.select("id", F.col("end").alias("at"), F.lit(-1).alias("step")), allowMissingColumns=True)
    around = Window.partitionBy("id").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("depth", F.coalesce(F.sum("step").over(around), F.lit(0))).filter("step = 1").select("id", "name", "begin", "end", "depth", "closed")


def element_texts(spans: DataFrame, found: DataFrame) -> DataFrame:
    """spans plus their text: what stands between begin and end, single-spaced (null if nothing)."""
    texts = found.filter("kind = 'text'").select("id", "place", "text")
    met = spans.join(texts, "id").filter("begin < place AND place < end")
    joined = met.groupBy("id", "begin").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("x"))
    whole = F.trim(F.regexp_replace(F.array_join(F.transform("x", lambda x: x["text"]), " "), r"\s+", " "))
    return spans.join(joined.select("id", "begin", F.nullif(whole, F.lit("")).alias("text")), ["id", "begin"], "left")


def lines(found: DataFrame) -> DataFrame:
    """(id, line, place, text, within, listed): the texts of a page by blocks, single-spaced, blank ones left out.

    within is the name of the tag that opened last before the line's first text (null after a closing
    one); listed says whether the line stands in a list item.
    """
    page = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    blocks = sorted(BEGINS | ENDS)
    edge = F.col("name").isin(*blocks)
    # Inside an item: more items have begun than ended, never below zero.
    item = F.when(F.col("name") == "li", F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1)).otherwise(0)
    marked = found.withColumn("line", F.sum(F.when(edge, 1).otherwise(0)).over(page)).withColumn("items", F.sum(item).over(page))
    marked = marked.withColumn("items", F.col("items") - F.least(F.lit(0), F.min("items").over(page)))
    marked = marked.withColumn("last", F.last(F.when(F.col("kind") != "text", F.struct("kind", "name")), ignorenulls=True).over(page))
    texts = marked.filter("kind = 'text'").withColumn("within", F.when(F.col("last.kind") == "open", F.col("last.name")))
    grouped = texts.groupBy("id", "line").agg(F.sort_array(F.collect_list(F.struct("place", "text", "within", "items"))).alias("x"))
    whole = F.trim(F.regexp_replace(F.array_join(F.transform("x", lambda x: x["text"]), ""), r"\s+", " "))
    return grouped.select("id", "line", F.col("x")[0]["place"].alias("place"), whole.alias("text"), F.col("x")[0]["within"].alias("within"), (F.col("x")[0]["items"] > 0).alias("listed")).filter("text <> ''")


def named(variants: dict[str, list[str]]) -> Column:
    """For `sections`: the name of the label that a line is one of the variants of."""
    names = F.create_map(*[F.lit(x) for name, texts in variants.items() for text in texts for x in (text, name)])
    return names[F.col("text")]


def sections(found: DataFrame, label: Column) -> DataFrame:
    """(id, label, place, items): what follows the first line of each label on a page, up to the next label, in one pass.

    `label` is a column on `lines`, null where a line is no label. Items are the list items of the
    section, or all its lines where it has none.
    """
    page = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("label").isNotNull(), F.struct("label", F.col("line").alias("at"))), ignorenulls=True).over(page)
    marked = lines(found).withColumn("label", label).withColumn("under", at).filter("under IS NOT NULL")
    grouped = marked.groupBy("id", F.col("under.label").alias("label"), F.col("under.at").alias("at")).agg(
        F.sort_array(F.collect_list(F.when(F.col("label").isNull(), F.struct("line", "text", "listed")))).alias("x"), F.min("place").alias("place")
    )
    first = grouped.groupBy("id", "label").agg(F.min_by(F.struct("place", "x"), "at").alias("s"))
    listed = F.filter("s.x", lambda x: x["listed"])
    items = F.transform(F.when(F.size(listed) > 0, listed).otherwise(F.col("s.x")), lambda x: x["text"])
    return first.select("id", "label", "s.place", items.alias("items"))
