"""Sources and sinks on files that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from weftline.functions import html, text as T


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_report(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as CSV below `path`, and a manifest of names, columns and row counts, which is returned."""
    rows = []
    for name, df in tables.items():
        df.write.option("header", True).csv(f"{path}/{name}")
        rows.append((name, ",".join(df.columns), df.sparkSession.read.option("header", True).csv(f"{path}/{name}").count()))
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame(rows, "name string, columns string, n_rows bigint").coalesce(1)
    manifest.write.json(f"{path}/manifest")
    return manifest


def opportunity_rows(rows: DataFrame, listed: str, summary: str) -> DataFrame:
    """Opportunities from a search hit and its summary, both JSON text: the summary's values win.

    Rows without an id are skipped; HTML is stripped from the description; categories are a list.
    """
    def value(name: str, kind: str = "string") -> Column:
        return F.coalesce(*(F.try_variant_get(F.try_parse_json(c), f"$.{name}", kind) for c in (summary, listed)))

    found = rows.select(
        T.blank_to_null(value("opportunity_id")).alias("opportunity_id"),
        T.one_space(value("opportunity_title")).alias("title"),
        value("agency_name").alias("agency"),
        value("award_ceiling", "double").alias("award_ceiling"),
        html.stripped(value("summary_description")).alias("summary"),
        F.coalesce(value("funding_categories", "array<string>"), F.array().cast("array<string>")).alias("categories"),
    )
    return found.filter("opportunity_id is not null")


def person_rows(rows: DataFrame, column: str) -> DataFrame:
    """People from profiles in JSON text: an address of the source is required, blank links drop out."""
    get = lambda name, kind="string": F.try_variant_get(F.try_parse_json(column), f"$.{name}", kind)
    links = F.filter(F.transform(F.coalesce(get("links", "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    found = rows.select(F.coalesce(T.blank_to_null(get("source_url")), T.blank_to_null(get("url"))).alias("source_url"), get("name").alias("name"), F.lower(F.trim(get("email"))).alias("email"), T.piped(get("organizations")).alias("organizations"), links.alias("links"))
    return found.filter("source_url is not null")


def chunk_path(prefix: str, part: str, owner: Column, source: Column, name: Column, place: Column) -> Column:
    """Where a chunk's text is stored: owner, hash of the source, safe name and number."""
    return F.concat(F.lit(f"{prefix}/{part}/"), owner.cast("string"), F.lit("__"), T.short_hash(source), F.lit("__"), T.safe_name(name, 80), F.format_string("__chunk_%04d.txt", place))


def stitched(chunks: DataFrame, stored: DataFrame, owner: list[str], stitch: bool = True) -> DataFrame:
    """Texts of usable chunks (owner, url, title, chunk_index, id, path, status, error) from stored (path, text).

    Chunks that are missing in the store drop out. With `stitch` the chunks of one (url, title) are one text.
    """
    good = chunks.filter(F.col("status").isin("done", "success") & (F.coalesce("error", F.lit("")) == "") & (F.coalesce("path", F.lit("")) != ""))
    bare = F.regexp_replace("path", r"^s3a?://[^/]+/", "")
    rows = good.withColumn("path", bare).join(stored.select("path", "text"), "path")
    if not stitch:
        return rows.select(*owner, "url", "title", "chunk_index", "id", "text")
    lists = rows.groupBy(*owner, "url", "title").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "id", "text"))).alias("x"))
    return lists.select(*owner, "url", "title", F.array_join(F.transform("x", lambda x: x["text"]), "\n\n").alias("text"))
