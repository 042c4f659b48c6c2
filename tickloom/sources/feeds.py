"""RSS feeds through Spark's XML functions: items as rows, damaged ones beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.headlines import clean_url, html_strip, split_title

ITEM = "title string, link string, pubDate string, description string, source string, damaged string"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Every <item> of the files, with its text in `damaged` if it could not be read.

    Files are cut at the items' ends, wherever they split, and each item is parsed by itself: one that is damaged, or never closed, costs no
    other.  A feed's frame does not matter."""
    cut = spark.read.option("lineSep", "</item>").text(path)
    parts = F.split("value", r"(?=<item[\s>])")
    # what stands before the last beginning was never closed
    at = cut.select(F.posexplode(parts).alias("i", "part"), (F.size(parts) - 1).alias("last")).where(F.col("part").rlike(r"\A<item[\s>]"))
    item = F.when(F.col("i") == F.col("last"), F.concat("part", F.lit("</item>"))).otherwise(F.col("part"))
    read = F.from_xml(item, ITEM, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged", "rowTag": "item", "ignoreNamespace": "true"})
    return at.select(F.inline(F.array(read)))  # a generator: conditions on an item's fields stay above it, so each item is parsed once


def feed_time(raw: Column) -> Column:
    """A feed's date (RFC 822, with a zone as an offset or GMT) in UTC; null for anything else."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(raw), "^[A-Za-z]{3}, *", ""), "(GMT|UTC|UT|Z)$", "+0000")
    return F.try_to_timestamp(F.when(plain.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), plain), F.lit("d MMM yyyy HH:mm:ss Z"))


def read_feed(items: DataFrame) -> DataFrame:
    """(url, title, summary, publisher, published_at, fault): what each item says, and why it is no article, null if it is one.

    A title ends in its publisher; if not, the item's source is the publisher.  A summary that only repeats the headline is none.  Faults:
    damaged, no title, no publisher, no date, bad address - the first that holds."""
    raw = F.trim(F.coalesce("title", F.lit("")))
    split = split_title(raw)
    titled = items.select("link", "pubDate", "source", "damaged", raw.alias("raw"), F.trim(split["headline"]).alias("headline"), F.trim(split["publisher"]).alias("named"), html_strip(F.col("description")).alias("text"))
    publisher = F.coalesce("named", F.nullif(F.trim("source"), F.lit("")))
    repeats = (F.col("text") == F.col("headline")) | (F.contains("text", F.col("headline")) & (F.length("text") <= F.length("raw") + 8))
    summary = F.when((F.col("text") != "") & ~repeats, F.col("text"))
    at, url = feed_time(F.col("pubDate")), clean_url(F.trim("link"))
    fault = F.when(F.col("damaged").isNotNull(), "damaged").when(F.col("headline") == "", "no title").when(publisher.isNull(), "no publisher").when(at.isNull(), "no date").when(url.isNull(), "bad address")
    return titled.select(url.alias("url"), F.col("headline").alias("title"), summary.alias("summary"), publisher.alias("publisher"), at.alias("published_at"), fault.alias("fault"))
