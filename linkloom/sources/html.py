"""Raw HTML pages -> corpus rows (URL, H1, Meta Title, Content).

Pure column expressions over the ``html`` string: one narrow map stage, no
shuffle, no per-row Python. One regex pass reads the tags, knows quoted attributes and leaves only those of
the elements that the corpus needs: the first ``<title>``, the first ``<h1>``, and the text inside ``<article>`` elements
(else ``<main>``, else ``<body>``). The main element's tags are then events, +1 and -1, whose running sum is the
depth: text counts where it is above 0, so nested and repeated regions are whole, text between regions is left out and an
unclosed region ends with the page. Comments, scripts and styles go. Not a general DOM parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import patterns as P
from linkloom.functions.text import collapse_ws, decode_entities, empty_to_null, py_strip

_OPEN, _CLOSE = "\x01", "\x02"  # stand for the main element's tags


def _region_text(marked: Column) -> Column:
    """Text at depth 1 or more. The running depth costs the square of a page's main-element tags, a handful."""
    marks = F.split(F.regexp_replace(marked, f"[^{_OPEN}{_CLOSE}]", ""), "")
    step = lambda depth, mark: F.greatest(F.lit(0), depth + F.when(mark == _OPEN, 1).when(mark == _CLOSE, -1).otherwise(0))
    depths = F.aggregate(marks, F.array(F.lit(0)), lambda acc, mark: F.concat(acc, F.array(step(F.element_at(acc, -1), mark))))
    pieces = F.arrays_zip(F.split(marked, f"[{_OPEN}{_CLOSE}]").alias("text"), depths.alias("depth"))
    inside = F.filter(pieces, lambda x: x["text"].isNotNull() & (x["depth"] > 0))
    return F.array_join(F.transform(inside, lambda x: x["text"]), " ")


def corpus_from_html(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, h1, meta_title, content)``.

    Missing elements give NULL (so A2/A3 can count them); ``content`` is the
    main text without its headings of the first level.
    """
    # One projection per step: each step's expressions read the columns of the one before, so that
    # no regex is evaluated twice.
    keys = ["page_id", "url"]
    shown = pages.select(*keys, F.regexp_replace(F.translate("html", _OPEN + _CLOSE, ""), P.HIDDEN_RE, " ").alias("html"))
    kept = shown.select(*keys, F.regexp_replace("html", P.TAGS_RE, "$1 ").alias("html"))
    parts = kept.select(*keys, F.regexp_extract("html", P.H1_RE, 1).alias("h1"), F.regexp_extract("html", P.TITLE_RE, 1).alias("meta_title"),
                        F.regexp_replace("html", P.H1_RE, " ").alias("html"))
    marked = F.lit("")
    for name in reversed(P.MAIN_ELEMENTS):
        tags = F.regexp_replace(F.regexp_replace("html", P.OPEN_RES[name], _OPEN), P.CLOSE_RES[name], _CLOSE)
        marked = F.when(F.col("html").rlike(P.OPEN_RES[name]), tags).otherwise(marked)
    parts = parts.select(*keys, "h1", "meta_title", F.when(F.col("html").isNotNull(), marked).alias("html"))
    text = ["h1", "meta_title", "html"]
    parts = parts.select(*keys, *[F.regexp_replace(c, P.WANTED_RE, " ").alias(c) for c in text])
    parts = parts.select(*keys, "h1", "meta_title", F.when(F.col("html").isNotNull(), _region_text(F.col("html"))).alias("content"))
    for step in (decode_entities, lambda c: py_strip(collapse_ws(c))):
        parts = parts.select(*keys, *[step(F.col(c)).alias(c) for c in ("h1", "meta_title", "content")])
    return parts.select(*keys, empty_to_null(F.col("h1")).alias("h1"),
                        empty_to_null(F.col("meta_title")).alias("meta_title"), "content")


def corpus_with_gaps(corpus: DataFrame) -> DataFrame:
    """Reference-shaped corpus with missing values and title separators.

    The driver's pages have a title and an H1 everywhere and titles equal
    H1s; the reference's inputs have gaps and ``Title - Site | Name``
    titles. Deterministic by ``page_id``: H1 NULL when ``% 7 = 0``, H1 the
    marker ``'NA'`` when ``% 13 = 0``; title NULL when ``% 11 = 0``, title
    with a site suffix when ``% 3 = 0``.
    """
    pid = F.col("page_id")
    return corpus.select(
        "page_id", "url",
        F.when(pid % 7 == 0, F.lit(None).cast("string"))
         .when(pid % 13 == 0, F.lit("NA")).otherwise(F.col("h1")).alias("h1"),
        F.when(pid % 11 == 0, F.lit(None).cast("string"))
         .when(pid % 3 == 0, F.concat(F.col("meta_title"), F.lit(" - Site | Example")))
         .otherwise(F.col("meta_title")).alias("meta_title"),
        "content",
    )
