"""Plain text of web pages, and documents without the lines that many of them share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeseek.plans.joins import join_small
from tomeseek.session import written

#: What is no text at all: comments (to the end if they are not closed), scripts, styles, navigation.
HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script[ \t\n\f\r]*>|\z)|<style\b.*?(?:</style[ \t\n\f\r]*>|\z)"
    r"|<nav\b.*?</nav[ \t\n\f\r]*>"
)
TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
TITLE_TAG = r"(?is)<title\b[^>]*>.*?</title[^>]*>"
BREAKS = (
    r"(?i)</?(?:p|br|hr|div|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|article|section|header|footer|main|aside|blockquote"
    r"|pre|form)\b[^>]*>"
)
CELLS = r"(?i)</?(?:td|th)\b[^>]*>"
TAGS = r"<[A-Za-z/!?][^>]*>"
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&middot;": "·", "&copy;": "©",
    "&reg;": "®", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&euro;": "€",
    "&amp;": "&",  # last, so that nothing is decoded twice
}


def _readable(text: Column) -> Column:
    """Entities decoded, runs of blanks one blank, runs of line breaks one break."""
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\f\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"\A[ \n]+|[ \n]+\z", "")


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text: what a reader of the page sees, one block to a line.

    Pages without a title have an empty one; NULL stays NULL. No shuffle.
    """
    shown = pages.select("page_id", "url", F.regexp_replace("html", HIDDEN, "").alias("html"))
    body = F.regexp_replace("html", TITLE_TAG, "")
    for pattern, sign in ((BREAKS, "\n"), (CELLS, " "), (TAGS, "")):
        body = F.regexp_replace(body, pattern, sign)
    title = F.regexp_replace(F.regexp_extract("html", TITLE, 1), TAGS, "")
    return shown.select("page_id", "url", _readable(title).alias("title"), _readable(body).alias("text"))


def drop_boilerplate(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` or more different texts have, and n_dropped; n_chars is counted anew.

    Lines are the same if they differ in outer blanks only; blank ones stay. Copies of one
    text count once, or else they would lose all they have. Line order stays; NULL texts
    stay NULL. Hashes of lines are shuffled and counted in each task before, never
    the lines, so one that a third of all documents have is no single task's work.
    """
    lines = F.split("text", "\n", -1)
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.transform(lines, lambda line: F.trim(line))).alias("pos", "line"))
    each = each.where("line <> ''").select("doc_id", "text_hash", "pos", F.sha2("line", 256).alias("line"))
    each = written(each, "line-hashes")
    often = each.select("line", "text_hash").distinct().groupBy("line").count().where(F.col("count") >= min_docs)
    found = join_small(each, written(often.select("line"), "frequent-lines"), "line", ["doc_id"])
    dropped = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    # What stays are the stretches between neighbouring places, so a long text is gone through once.
    bounds = F.concat(F.array(F.lit(-1)), F.col("places"), F.array(F.size(lines)))
    rest = docs.join(dropped, "doc_id", "left").withColumns({"_lines": lines, "_bounds": bounds})
    stretches = F.transform(F.sequence(F.lit(0), F.size("places")), lambda i: F.slice(
        "_lines", F.get("_bounds", i) + 2, F.get("_bounds", i + 1) - F.get("_bounds", i) - 1))
    rest = rest.withColumn("text", F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(stretches), "\n")))
    rest = rest.withColumns({"n_chars": F.length("text").cast("bigint"), "n_dropped": F.coalesce(F.size("places"), F.lit(0))})
    return rest.select(*docs.columns, "n_dropped")
