"""Discovered links: which are followed, and which are alive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.operators.joins import hottest, lookup, salted_join


def follow_rules(hrefs: DataFrame) -> DataFrame:
    """Rows (…, raw, href) with the two ways a link can be followed."""
    blocked = urls.has_blocked_file_type(F.col("href"))
    is_sitemap = F.col("raw").rlike("(?i)sitemap")
    return hrefs.where(~blocked | is_sitemap)


def allowed_links(hrefs: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Links inside the allowed domains, files left out, sitemaps always kept."""
    return follow_rules(hrefs).where(urls.netloc(F.col("href")).isin(list(domains)))


def allowed_links_by_table(hrefs: DataFrame, domains: DataFrame) -> DataFrame:
    """As ``allowed_links`` with a table of domains of any size."""
    names = domains.select(F.col("domain").alias("netloc")).distinct()
    rows = follow_rules(hrefs).withColumn("netloc", urls.netloc(F.col("href")))
    joined = lookup(rows, names, names.count(), ["netloc"], F.col("href"), how="left_semi")
    return joined.drop("netloc")


def discover_links(hrefs: DataFrame, domains: Sequence[str], *keys: str) -> DataFrame:
    """Distinct followed links per page (and per ``keys``)."""
    return allowed_links(hrefs, domains).select(*keys, "url", "href").distinct()


def validate_links(links: DataFrame, checks: DataFrame) -> DataFrame:
    """Set ``status`` of link rows from ``checks(href, status_code)``.

    A check without a status failed to connect; a link without a check stays
    pending. Checks are reduced to one per link first (the best answer wins).
    """
    answers = checks.groupBy("href").agg(
        F.min(F.coalesce("status_code", F.lit(999))).alias("status_code")
    )
    # One row per linked href with its number of links: both sides of the first join
    # are unique, and the counts say which hrefs the second join has to split.
    linked = links.groupBy("href").agg(F.count("*").alias("n")).join(answers, "href")
    hot = hottest(linked, ["href"])
    return salted_join(
        links.drop("status"), linked.drop("n"), ["href"], hot, F.struct("url", "pos")
    ).withColumn(
        "status",
        F.when(F.col("status_code").isNull(), "pending")
        .when(F.col("status_code") < 400, "valid")
        .otherwise("broken"),
    )


def collect_links(links: DataFrame) -> DataFrame:
    """Link rows back to one array per page, in page order (a page bounds the array)."""
    item = F.struct("pos", "href", "text", "title", "type", "status")
    return links.groupBy("url").agg(
        F.transform(
            F.sort_array(F.collect_list(item)),
            lambda i: F.struct(i["href"], i["text"], i["title"], i["type"], i["status"]),
        ).alias("links")
    )
