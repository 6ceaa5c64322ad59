"""Page frames: ``(key..., page_num int, text string)``, one row per page.

Pages of one document are combined with a per-document ``collect_list``
sorted by page number: the group is one document, never more."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import JOINED_HEAD, JOINED_TAIL, PAGE_SEPARATOR, clean_page, is_blank, join_cleaned_pages, valid_text, ws_trim


def pages_from_text_layer(docs: DataFrame, keys: list[str], text_col: str = "text",
                          separator: str = "\f") -> DataFrame:
    """Pages of text-layer inputs whose pages are separated by form feeds:
    one row per page, numbered from 1 (empty pages kept, so numbers stay true)."""
    return docs.select(*keys, F.posexplode(F.split(F.col(text_col), separator, -1)).alias("__i", "text")) \
        .select(*keys, (F.col("__i") + 1).cast("int").alias("page_num"), "text")


def page_limit(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """First ``max_pages`` pages of every document; a falsy value means all."""
    return pages.filter(F.col("page_num") <= max_pages) if max_pages else pages


def pages_drop_blank(pages: DataFrame) -> DataFrame:
    return pages.filter(valid_text("text"))


def pages_keep_blank(pages: DataFrame) -> DataFrame:
    """Page-list mode: blank pages stay as '' so positions are kept; text stripped."""
    return pages.withColumn("text", F.when(is_blank("text"), F.lit("")).otherwise(ws_trim("text")))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Non-blank pages, collapsed and prefixed with their page banner."""
    return pages_drop_blank(pages).withColumn("text", clean_page("text", "page_num"))


def join_pages(pages: DataFrame, keys: list[str], max_pages: int | None = None) -> DataFrame:
    """Full-text mode: one row per document with its non-blank pages cleaned
    and joined in page order. Documents whose pages are all blank give ''."""
    cleaned = F.when(valid_text("text"), F.struct("page_num", clean_page("text", "page_num").alias("t")))
    agg = page_limit(pages, max_pages).groupBy(*keys).agg(F.sort_array(F.collect_list(cleaned)).alias("__p"))
    return agg.select(*keys, join_cleaned_pages(F.transform("__p", lambda x: x["t"])).alias("text"))


def page_stats(pages: DataFrame, keys: list[str], max_pages: int | None = None) -> DataFrame:
    """Per document: pages processed, pages with text, characters of the joined
    text and characters per processed page. The length of the joined text is a
    sum (page lengths, two line ends between pages, the frame around them), so
    partial aggregation does it and no text is shuffled."""
    full = valid_text("text")
    frame = len(JOINED_HEAD) + len(JOINED_TAIL)
    agg = page_limit(pages, max_pages).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages_total"), F.count_if(full).alias("pages_with_text"),
        F.sum(F.when(full, F.length(clean_page("text", "page_num")))).alias("__c"))
    chars = F.when(F.col("pages_with_text") > 0, F.col("__c") + frame + len(PAGE_SEPARATOR) * (F.col("pages_with_text") - 1)).otherwise(0)
    return agg.withColumn("total_chars", chars.cast("long")).select(
        *keys, "pages_total", "pages_with_text", "total_chars", (F.col("total_chars") / F.col("pages_total")).alias("avg_chars_per_page"))
