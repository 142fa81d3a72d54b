"""Blank fill, topic entities of a page, catalogue rows, content heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import patterns as P
from linkloom.functions.text import collapse_ws, py_strip

ORIGINS = ("url", "h1", "title")


def blank_fill(df: DataFrame, cols=("h1", "meta_title", "content")) -> DataFrame:
    """NULL H1 / title / content -> '' (the URL gets no guard)."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def url_entity(url: Column) -> Column:
    """Last path segment of the URL as words; NULL when none qualifies."""
    segment = F.when(F.instr(url, "/") > 0,
                     F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)).otherwise(F.lit(""))
    words = py_strip(F.regexp_replace(F.regexp_replace(segment, P.URL_EXTENSION_RE, ""),
                                      P.URL_WORD_JOINERS_RE, " "))
    return F.when((words != F.lit("")) & (F.instr(words, ".") == 0), words)


def h1_entity(h1: Column) -> Column:
    """Any non-empty H1, stripped (a blank H1 yields '' and is kept)."""
    return F.when(h1 != F.lit(""), py_strip(h1))


def title_entity(title: Column) -> Column:
    """Title text before the first separator, stripped, if non-empty."""
    head = py_strip(F.get(F.split(title, P.TITLE_SEPARATOR_RE), 0))
    return F.when((title != F.lit("")) & (head != F.lit("")), head)


def entity_array(url: Column, h1: Column, title: Column) -> Column:
    """P5: entities in order URL, H1, title, duplicates kept, absent dropped."""
    items = F.array(
        F.struct(F.lit("url").alias("origin"), url_entity(url).alias("entity")),
        F.struct(F.lit("h1").alias("origin"), h1_entity(h1).alias("entity")),
        F.struct(F.lit("title").alias("origin"), title_entity(title).alias("entity")),
    )
    return F.filter(items, lambda e: e["entity"].isNotNull())


def entity_rows(corpus: DataFrame) -> DataFrame:
    """P5 row form: ``(page_id, url, pos, origin, entity)``, ``pos`` from 1."""
    c = blank_fill(corpus)
    return (c.select("page_id", "url",
                     F.posexplode(entity_array(F.col("url"), F.col("h1"), F.col("meta_title"))))
             .select("page_id", "url", (F.col("pos") + 1).alias("pos"),
                     F.col("col.origin").alias("origin"), F.col("col.entity").alias("entity")))


def entity_lists(corpus: DataFrame) -> DataFrame:
    """P5 list form rendered as text: ``(page_id, n_entities, entities)``
    where ``entities`` joins the list with ``' | '``."""
    c = blank_fill(corpus)
    arr = entity_array(F.col("url"), F.col("h1"), F.col("meta_title"))
    return c.select("page_id", F.size(arr).cast("long").alias("n_entities"),
                    F.array_join(F.transform(arr, lambda e: e["entity"]), " | ").alias("entities"))


def catalogue_blocks(catalogue: DataFrame) -> DataFrame:
    """One text block per catalogue row (``page_no, url, h1, meta_title``)."""
    c = blank_fill(catalogue, cols=("h1", "meta_title"))
    return c.select(
        "page_no",
        F.format_string("%d. URL: %s\n   H1: %s\n   Meta Title: %s\n\n",
                        F.col("page_no"), F.col("url"), F.col("h1"), F.col("meta_title"))
         .alias("block"))


def content_head_words(content: Column, n: int = 500) -> Column:
    """First ``n`` words of the content."""
    t = py_strip(collapse_ws(content))
    return F.array_join(F.slice(F.split(t, " "), 1, n), " ")


def content_head_chars(content: Column, n: int = 500) -> Column:
    """First ``n`` characters of the content."""
    return F.left(content, F.lit(n))
