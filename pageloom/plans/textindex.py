"""A stored full-text index: positional postings in segments that are written once.

Every commit adds one segment with the pages it added or changed, and tombstones for pages that it changed or
removed: a tombstone hides a page in all earlier segments. When ``FAN`` segments of about one size have gathered
they are merged into one without what is hidden, so their number grows with the logarithm of the index.

A file of a segment holds all postings of its pages, sorted by word, and is made where the pages lie, bucket by
bucket: neither texts nor postings move, unless buckets are too large to be sorted. A search reads the few row
groups of each file that may hold its words.

A posting is one row per (word, page) with the places of the word. Places are numbered through a field; the
last bits of a place say in which field it is and whether exactly one blank lies before the word. So a phrase of
words with single blanks between them is found from places alone.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import words
from pageloom.plans.catalog import page_summary, paged
from pageloom.plans.search import DEFAULT_LIMIT, MAX_LIMIT, search_terms
from pageloom.session import conf_set, short_batches
from pageloom.sources.store import FOLDER, Store, Transaction, commit_of

POSTINGS, ENTRIES, DEAD = "postings", "entries", "tombstones"
FAN = 4
TEXT, TITLE, KEYWORDS = 0, 1, 2
# A place is the word's number, then one bit for the blank before it, then two for its field.
JOINED, FIELD_BITS = 4, 2
PLACE_BITS = 3
# Bytes of text whose postings are one file of a segment, at most and (on few cores) at least, about.
SHARD_BYTES, LEAST_BYTES = 32_000_000, 1_000_000
# Bytes of stored pages that one task indexes where they lie, about.
TASK_BYTES = 16_000_000
# So many words are named in a filter that reaches the files; more are met in a join.
NAMED = 500


def positional_postings(pages: DataFrame) -> DataFrame:
    """(term, _id, places) of all words of text, title and keywords; grouped where the page is, without a shuffle."""
    fields = {TEXT: F.col("content.clean_text"), TITLE: F.col("title"), KEYWORDS: F.array_join("search_fields.keywords", " ")}
    return words.places(pages, [fields[number] for number in sorted(fields)], JOINED, PLACE_BITS)


def _dealt(pages: DataFrame) -> DataFrame:
    """Pages over so many tasks that the postings of one are sorted in memory; where they lie, if their files allow it."""
    size = pages.agg(F.sum(F.octet_length("content.clean_text"))).first()[0] or 0
    if size <= 2 * SHARD_BYTES * len(pages.inputFiles()):
        return pages
    cores = pages.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(size / SHARD_BYTES), min(cores, math.ceil(size / LEAST_BYTES)))
    return pages.repartition(shards, "_id")


class TextIndex:
    """The index tables of a store. Writing goes through the transaction that changes the pages."""

    def change(self, tx: Transaction, fresh: DataFrame | None, replaced: DataFrame) -> None:
        """Index ``fresh`` pages and hide the earlier entries of pages in ``replaced`` (their ``_id``)."""
        if tx.has(ENTRIES):
            tx.append(DEAD, replaced.select("_id"))
        if fresh is not None:
            tx.append(ENTRIES, page_summary(fresh), ["_id"])
            with short_batches(tx.spark), conf_set(tx.spark, "spark.sql.files.maxPartitionBytes", str(TASK_BYTES)):
                tx.append(POSTINGS, positional_postings(_dealt(fresh)), ["term", "_id"], in_place=True)
            self.merge(tx)

    def merge(self, tx: Transaction, fan: int = FAN) -> None:
        """Merge segments of one size class where ``fan`` of them have gathered, the smallest class first."""
        pairs = list(zip(tx.tables[ENTRIES]["files"], tx.tables[POSTINGS]["files"], strict=True))
        classes: dict[int, list[tuple[str, str]]] = {}
        for pair in pairs:
            size = tx.store.files.bytes(f"data/{POSTINGS}/{FOLDER}={pair[1]}")
            classes.setdefault(int(math.log(size + 1, fan)), []).append(pair)
        for _, chosen in sorted(classes.items()):
            if len(chosen) >= fan:
                self._merge(tx, chosen)
                break
        if tx.has(DEAD):
            # A tombstone is of no use when no segment is older.
            oldest = min(int(f[:8]) for f in tx.tables[ENTRIES]["files"])
            tx.forget(DEAD, [f for f in tx.tables[DEAD]["files"] if int(f[:8]) <= oldest])

    def _merge(self, tx: Transaction, chosen: list[tuple[str, str]]) -> None:
        for table, place, order in ((ENTRIES, 0, ["_id"]), (POSTINGS, 1, ["term", "_id"])):
            folders = [pair[place] for pair in chosen]
            rows = _live(tx.folders(table, folders), tx.rows(DEAD, marked=True) if tx.has(DEAD) else None)
            tx.append(table, rows.drop(FOLDER), order)
            tx.forget(table, folders)

    def search(
        self,
        store: Store,
        q: str,
        section: str | None = None,
        subsection: str | None = None,
        min_quality: int | None = None,
        limit: int = DEFAULT_LIMIT,
        skip: int = 0,
        version: int | None = None,
    ) -> DataFrame:
        """As ``search.search_pages`` over the pages of the same version, from the index alone.

        Phrases with anything but single blanks between their words are looked up in the texts of the pages
        that match otherwise.
        """
        record = store.record(version)
        hits = self.matches(store, record, q)
        entries = store.rows(record, ENTRIES, marked=True)
        if section:
            entries = entries.where(F.col("section") == section)
        if subsection:
            entries = entries.where(F.col("subsection") == subsection)
        if min_quality:
            entries = entries.where(F.col("quality_score") >= min_quality)
        # Entries and postings of a commit lie in folders of their own; the commit is the same.
        found = entries.withColumn("commit", commit_of(F.col(FOLDER))).drop(FOLDER).join(hits, ["_id", "commit"])
        return paged(found.drop("commit"), [F.desc("score"), F.asc("url")], limit, skip, MAX_LIMIT)

    def matches(self, store: Store, record: dict, q: str) -> DataFrame:
        """_id, commit of its segment, and score of every page that matches."""
        wanted = search_terms(q)
        postings = store.rows(record, POSTINGS, marked=True).withColumn("commit", commit_of(F.col(FOLDER))).drop(FOLDER)
        named = postings.where(F.col("term").isin(list(wanted.any_of)))
        hits = named.groupBy("_id", "commit").agg(F.sum(F.size("places")).cast("int").alias("score"))
        if wanted.none_of:
            unwanted = postings.where(F.col("term").isin(list(wanted.none_of))).select("_id", "commit")
            hits = hits.join(unwanted, ["_id", "commit"], "left_anti")
        for phrase in wanted.phrases:
            if re.fullmatch(r"\w+( \w+)*", phrase):
                hits = hits.join(phrase_pages(postings, phrase.split(" ")), ["_id", "commit"], "left_semi")
        if DEAD in record["tables"]:
            dead = store.rows(record, DEAD, marked=True)
            hits = _live(hits.withColumn(FOLDER, F.format_string("%08d", "commit")), dead).drop(FOLDER)
        for phrase in wanted.phrases:
            if not re.fullmatch(r"\w+( \w+)*", phrase):
                pages = store.rows(record, "pages")
                holds = [F.contains(F.lower(c), F.lit(phrase)) for c in ("content.clean_text", "title")]
                hits = hits.join(pages.where(holds[0] | holds[1]).select("_id"), "_id", "left_semi")
        return hits


def _live(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    """Rows of segments that no later tombstone hides."""
    if dead is None:
        return rows
    last = dead.groupBy(F.col("_id").alias("dead_id")).agg(F.max(commit_of(F.col(FOLDER))).alias("hidden"))
    hides = (F.col("_id") == F.col("dead_id")) & (F.col("hidden") > commit_of(F.col(FOLDER)))
    return rows.join(last, hides, "left_anti")


def phrase_pages(postings: DataFrame, words: list[str]) -> DataFrame:
    """_id and commit of pages with the words side by side, one blank between them, in text or title.

    As a search for the phrase in the lower-cased text finds it: the first word may be the end of a longer
    one, the last the beginning of one, and a single word any part.
    """
    term, parts = F.col("term"), []
    for nth, word in enumerate(words):
        if len(words) == 1:
            rows = _with_words(postings, F.contains(term, F.lit(word)))
        elif nth == 0:
            rows = _with_words(postings, F.endswith(term, F.lit(word)))
        elif nth == len(words) - 1:
            rows = postings.where(F.startswith(term, F.lit(word)))
        else:
            rows = postings.where(term == word)
        parts.append(rows.select("_id", "commit", F.lit(nth).alias("nth"), _begins(nth).alias("begins")))
    if len(words) == 1:
        return parts[0].where(F.size("begins") > 0).select("_id", "commit").distinct()
    # Rows without a place come along: a condition on the places would compute all of them a second time.
    # A page's places stay arrays and meet in one group per page: single places would each move with their page's id.
    all_parts = functools.reduce(DataFrame.unionAll, parts)
    begins = [F.flatten(F.collect_list(F.when(F.col("nth") == n, F.col("begins")))) for n in range(len(words))]
    whole = F.size(functools.reduce(F.array_intersect, begins)) > 0
    return all_parts.groupBy("_id", "commit").agg(whole.alias("whole")).where("whole").select("_id", "commit")


def _begins(nth: int) -> Column:
    """Where the phrase would begin, field included, of all places of its nth word in text or title."""

    def fits(place: Column) -> Column:
        named = place.bitwiseAND((1 << FIELD_BITS) - 1) != KEYWORDS
        return named & (place.bitwiseAND(JOINED) != 0) if nth else named

    def begin(place: Column) -> Column:
        first = F.shiftright(place, PLACE_BITS) - nth
        return F.shiftleft(first, FIELD_BITS) + place.bitwiseAND((1 << FIELD_BITS) - 1)

    return F.transform(F.filter("places", fits), begin)


def _with_words(postings: DataFrame, holds: Column) -> DataFrame:
    """Postings of the words that a condition holds for.

    Files are sorted by word and cannot be pruned by a part of one, so the words are looked up first, in the
    one column that is nearly nothing once compressed; few of them are named in the filter.
    """
    words = [r[0] for r in postings.where(holds).select("term").distinct().limit(NAMED + 1).collect()]
    return postings.where(F.col("term").isin(words) if len(words) <= NAMED else holds)
