"""Full-text search over stored pages, by scan or by a postings table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text
from pageloom.plans.catalog import filter_pages, page_summary, paged, seek

MAX_LIMIT = 100
DEFAULT_LIMIT = 10


@dataclass(frozen=True)
class SearchTerms:
    any_of: tuple[str, ...]
    none_of: tuple[str, ...]
    phrases: tuple[str, ...]


def search_terms(q: str) -> SearchTerms:
    """Split a search string: words, ``-words`` and ``"phrases"``."""
    phrases = tuple(p.lower() for p in re.findall(r'"([^"]+)"', q))
    rest = re.sub(r'"[^"]*"', " ", q).lower()
    negated = re.findall(r"(?:^|\s)-(\w+)", rest)
    wanted = re.findall(r"\w+", re.sub(r"(?:^|\s)-\w+", " ", rest) + " " + " ".join(phrases))
    kept = [w for w in dict.fromkeys(wanted) if w not in text.STOP_WORDS]
    return SearchTerms(tuple(kept), tuple(dict.fromkeys(negated)), phrases)


def _whole_words(words: tuple[str, ...]) -> str:
    """Any of the words, standing alone. A word is tried before what surrounds it,
    which keeps the scan of a text cheap; each word looks back over itself only, so
    one may be the end of another."""
    letter = "[\\p{L}\\p{N}_]"
    options = "|".join(f"{re.escape(w)}(?<!{letter}{re.escape(w)})" for w in words)
    return f"(?:{options})(?!{letter})"


def _fields() -> list[Column]:
    return [
        F.coalesce("content.clean_text", F.lit("")),
        F.coalesce("title", F.lit("")),
        F.coalesce(F.array_join("search_fields.keywords", " "), F.lit("")),
    ]


def search_matches(
    pages: DataFrame,
    q: str,
    section: str | None = None,
    subsection: str | None = None,
    min_quality: int | None = None,
) -> DataFrame:
    """All pages that match, with ``score`` = occurrences of the wanted words.

    A row-wise scan with no shuffle; page filters run before any text is read.
    """
    wanted = search_terms(q)
    pages = filter_pages(pages, section, subsection, min_quality)
    if not wanted.any_of:
        return pages.where(F.lit(False)).withColumn("score", F.lit(0))
    lowered = [F.lower(f) for f in _fields()]
    any_of = F.lit(_whole_words(wanted.any_of))
    score = sum((F.regexp_count(f, any_of) for f in lowered), start=F.lit(0))
    # The exploded array holds the score or nothing. A filter on a computed column
    # would be pushed below it and scan every text twice.
    hit = F.explode(F.filter(F.array(score), lambda s: s > 0))
    hits = pages.select("*", hit.alias("score"))
    for phrase in wanted.phrases:
        hits = hits.where(
            F.contains(lowered[0], F.lit(phrase)) | F.contains(lowered[1], F.lit(phrase))
        )
    if wanted.none_of:
        for field in lowered:
            hits = hits.where(~field.rlike(_whole_words(wanted.none_of)))
    return hits


def _top(hits: DataFrame, limit: int, skip: int) -> DataFrame:
    rows = page_summary(hits, "score")
    return paged(rows, [F.desc("score"), F.asc("url")], limit, skip, MAX_LIMIT)


def search_pages(
    pages: DataFrame,
    q: str,
    section: str | None = None,
    subsection: str | None = None,
    min_quality: int | None = None,
    limit: int = DEFAULT_LIMIT,
    skip: int = 0,
) -> DataFrame:
    """One page of results, best score first, then by url."""
    return _top(search_matches(pages, q, section, subsection, min_quality), limit, skip)


RANKING = (("score", True), ("url", False))


def search_pages_after(
    pages: DataFrame,
    q: str,
    after: Sequence[object] | None = None,
    section: str | None = None,
    subsection: str | None = None,
    min_quality: int | None = None,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """As ``search_pages``, but from a cursor: score and url of the last row seen."""
    rows = page_summary(search_matches(pages, q, section, subsection, min_quality), "score")
    return seek(rows, RANKING, limit, MAX_LIMIT, after)


def search_total(
    pages: DataFrame,
    q: str,
    section: str | None = None,
    subsection: str | None = None,
    min_quality: int | None = None,
) -> DataFrame:
    """How many pages match in all; the response itself counts its own rows."""
    return search_matches(pages, q, section, subsection, min_quality).agg(
        F.count("*").alias("total_matches")
    )


def search_response(results: DataFrame, q: str, **filters: object) -> DataFrame:
    """Results (at most ``MAX_LIMIT`` rows) as one response row."""
    given = {k: str(v) for k, v in filters.items() if v}
    pairs = [F.lit(x) for item in given.items() for x in item]
    chosen = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    item = F.struct(
        (-F.col("score")).alias("rank"), *[F.col(c) for c in ("url", *_without_url(results))]
    )
    return results.agg(
        F.lit(q).alias("query"),
        F.count("*").alias("total_results"),
        F.sort_array(F.collect_list(item)).alias("results"),
        F.any_value(chosen).alias("filters"),
    )


def _without_url(results: DataFrame) -> list[str]:
    return [c for c in results.columns if c != "url"]


def build_postings(pages: DataFrame) -> DataFrame:
    """(term, page id, tf) over the searched fields; counting happens in the row."""
    words = text.index_terms(F.concat_ws(" ", *_fields()))
    return pages.select("_id", F.explode(text.word_frequencies(words)).alias("w")).select(
        F.col("w.word").alias("term"), "_id", F.col("w.n").alias("tf")
    )


def write_postings(postings: DataFrame, path: str, files: int) -> None:
    """Range-partition by (term, page), so a frequent term covers several files and
    a lookup reads only the row groups whose min/max hold its terms."""
    (
        postings.repartitionByRange(files, "term", "_id")
        .sortWithinPartitions("term", "_id")
        .write.mode("errorifexists")
        .parquet(path)
    )


def search_postings(
    postings: DataFrame,
    pages: DataFrame,
    q: str,
    section: str | None = None,
    subsection: str | None = None,
    min_quality: int | None = None,
    limit: int = DEFAULT_LIMIT,
    skip: int = 0,
) -> DataFrame:
    """As ``search_pages`` for word queries, reading postings instead of texts.

    Phrases need the text: pages that hold the words are then checked by scan.
    """
    wanted = search_terms(q)
    kept = filter_pages(pages, section, subsection, min_quality)
    scores = (
        postings.where(F.col("term").isin(list(wanted.any_of)))
        .groupBy("_id")
        .agg(F.sum("tf").cast("int").alias("score"))
    )
    if wanted.none_of:
        unwanted = postings.where(F.col("term").isin(list(wanted.none_of))).select("_id")
        scores = scores.join(unwanted, "_id", "left_anti")
    hits = kept.join(scores, "_id")
    for phrase in wanted.phrases:
        hits = hits.where(
            F.contains(F.lower("content.clean_text"), F.lit(phrase))
            | F.contains(F.lower("title"), F.lit(phrase))
        )
    return _top(hits, limit, skip)
