"""Roll-ups that are kept up to date by what changed, without reading the pages again.

A change is a pair of measures, before and after a commit; either may be null. The kept table has sums and
counts per (section, subsection), so a change takes its old measures off one group and adds the new ones to
another. Quality is summed as a decimal of six places, so that taking off what was added leaves nothing behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.sources.store import BUCKET, Transaction, bucket_of

SECTIONS = "sections"
KEY = ("section", "subsection")
SUMS = ("pages", "words", "scored", "quality")


def measures() -> Column:
    """What a page counts for, as one struct."""
    section = F.col("navigation.section")
    return F.struct(
        F.when(F.coalesce(section, F.lit("")) == "", "root").otherwise(section).alias("section"),
        F.coalesce("navigation.subsection", F.lit("")).alias("subsection"),
        F.coalesce("content.word_count", F.lit(0)).cast("long").alias("words"),
        F.col("quality_score").cast("decimal(18,6)").alias("quality"),
    )


def deltas(changes: DataFrame) -> DataFrame:
    """Sums to add per group, from changes with ``old`` and ``new`` measures; groups that stay as they are drop out."""

    def signed(side: str, sign: int) -> Column:
        m = F.col(side)
        return F.when(
            m.isNotNull(),
            F.struct(
                m["section"].alias("section"),
                m["subsection"].alias("subsection"),
                F.lit(sign).cast("long").alias("pages"),
                (m["words"] * sign).alias("words"),
                F.when(m["quality"].isNotNull(), sign).otherwise(0).cast("long").alias("scored"),
                (F.coalesce(m["quality"], F.lit(0)) * sign).cast("decimal(18,6)").alias("quality"),
            ),
        )

    sides = changes.select(F.inline(F.array_compact(F.array(signed("old", -1), signed("new", 1)))))
    return _summed(sides).where(" OR ".join(f"{c} <> 0" for c in SUMS))


def _summed(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast("long").alias(c) for c in SUMS[:-1]]
    return rows.groupBy(*KEY).agg(*sums, F.sum("quality").cast("decimal(38,6)").alias("quality"))


def maintain(tx: Transaction, changes: DataFrame, buckets: int = 16) -> None:
    """Bring the kept roll-up to the state after ``changes``; only buckets with changed groups are written."""
    change = deltas(changes)
    if not tx.has(SECTIONS):
        tx.put(SECTIONS, change, KEY, buckets)
        return
    count = tx.buckets_of(SECTIONS)
    placed = change.withColumn(BUCKET, bucket_of(KEY, count))
    touched = [r[0] for r in placed.select(BUCKET).distinct().collect()]
    if touched:
        before = tx.rows(SECTIONS, touched)
        after = _summed(before.unionByName(change)).where("pages <> 0")
        tx.replace_buckets(SECTIONS, after, touched)


def _mean(quality: Column, scored: Column) -> Column:
    return quality.cast("double") / F.nullif(scored, F.lit(0))


def site_structure(sections: DataFrame) -> DataFrame:
    """Pages and mean quality per (section, subsection), from the kept roll-up."""
    mean = _mean(F.col("quality"), F.col("scored")).alias("avg_quality")
    return sections.select(*KEY, F.col("pages").alias("page_count"), mean)


def section_lines(sections: DataFrame) -> DataFrame:
    """Lines of two levels, as ``catalog.section_rollup`` gives them from pages."""
    named = F.col("subsection") != ""
    section = F.struct(F.lit("section").alias("level"), F.lit("").alias("name"))
    own = F.struct(F.lit("subsection").alias("level"), F.col("subsection").alias("name"))
    lines = F.when(named, F.array(section, own)).otherwise(F.array(section))
    return (
        sections.withColumns({"named": named, "line": F.explode(lines)})
        .groupBy("line.level", "section", F.col("line.name").alias("subsection"))
        .agg(
            F.sum("pages").alias("page_count"),
            _mean(F.sum("quality"), F.sum("scored")).alias("avg_quality"),
            F.count_if(F.col("named") & (F.col("line.level") == "section")).alias("subsections"),
        )
    )


def content_statistics(sections: DataFrame) -> DataFrame:
    """Totals of all pages, from the kept roll-up."""
    mean = _mean(F.sum("quality"), F.sum("scored"))
    return sections.agg(
        F.coalesce(F.sum("pages"), F.lit(0)).alias("total_pages"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_quality_score"),
    )
