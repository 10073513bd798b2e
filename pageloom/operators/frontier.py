"""The crawl frontier: what may be fetched next, and what a crawl reaches."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text, urls
from pageloom.functions.times import instant
from pageloom.operators.joins import SMALL_ROWS, hot_keys, hottest, lookup, salted_join
from pageloom.session import cut_lineage

DEFAULT_MAX_DEPTH = 10
RETRY_ATTEMPTS = 3
RETRY_STEP_SECONDS = 10
# A host's robots rules are tried one by one up to so many.
FEW_RULES = 500


def excluded(url: Column, patterns: Sequence[str]) -> Column:
    return urls.matches_any(url, patterns)


def first_rules(rules: DataFrame, agent: str) -> DataFrame:
    """The rules that can decide for ``agent``: the first one per host and prefix.

    A group that names the agent replaces the ``*`` group of its host.
    """
    name = agent.split("/")[0].lower()
    token = F.lower(F.col("agent"))
    named = (token != "*") & F.contains(F.lit(name), token)
    return (
        rules.where(named | (token == "*"))
        .groupBy("host", named.alias("named"), "path_prefix")
        .agg(F.min(F.struct("seq", "allow")).alias("rule"))
        .select("host", "named", "rule.seq", "path_prefix", "rule.allow")
    )


def active_rules(firsts: DataFrame) -> DataFrame:
    """The rules that apply on their host: the group that names the agent, else the ``*`` group."""
    best = firsts.groupBy("host").agg(F.max("named").alias("named"))
    return firsts.join(best, ["host", "named"]).drop("named")


def robots_allowed(rows: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Add ``robots_ok``: the first rule whose prefix fits decides, else allowed.

    A host with up to ``FEW_RULES`` rules brings them along as one array in rule order, so its urls are decided
    where they are, without a shuffle of their own. Urls of hosts with more rules are cut to the lengths that
    the host's prefixes have, and the cuts meet the rules in a join on host and prefix: work is urls times
    different lengths, which the longest prefix bounds, however many rules a host has.
    """
    # An empty prefix with "disallow" allows everything.
    allow = (F.col("allow") | (F.col("path_prefix") == "")).alias("allow")
    active = cut_lineage(active_rules(first_rules(rules, agent)).select("host", "path_prefix", "seq", allow))
    counts = active.groupBy("host").agg(F.count("*").alias("__n"))
    many = counts.where(F.col("__n") > FEW_RULES).select("host")
    few = active.join(many, "host", "left_anti").groupBy(F.col("host").alias("__host"))
    few = few.agg(F.sort_array(F.collect_list(F.struct("seq", "path_prefix", "allow"))).alias("__rules"))
    target = urls.after_netloc(F.col("url"))
    decided = text.bind(
        F.struct(target.alias("target"), F.col("__rules").alias("rules")),
        lambda u: F.get(F.filter(u["rules"], lambda r: F.startswith(u["target"], r["path_prefix"])), F.lit(0))["allow"],
    )
    marked = rows.withColumn("__host", urls.netloc(F.col("url"))).join(few, "__host", "left")
    marked = marked.select(*rows.columns, decided.alias("__allow"))
    if not many.isEmpty():
        far = _by_prefix(rows, active.join(many, "host", "left_semi")).withColumnRenamed("__allow", "__far")
        marked = marked.join(far, "url", "left").withColumn("__allow", F.coalesce("__allow", "__far"))
    return marked.select(*rows.columns, F.coalesce("__allow", F.lit(True)).alias("robots_ok"))


def _by_prefix(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``url`` and what the first fitting rule says, for urls that a rule fits."""
    sizes = rules.groupBy(F.col("host").alias("__host")).agg(
        F.collect_set(F.length("path_prefix")).alias("__sizes")
    )
    cuts = (
        rows.select("url")
        .distinct()
        .select("url", urls.netloc(F.col("url")).alias("__host"), urls.after_netloc(F.col("url")).alias("__target"))
        .join(sizes, "__host")
        .withColumn("__size", F.explode("__sizes"))
        .where(F.col("__size") <= F.length("__target"))
        .select("url", "__host", F.expr("substring(__target, 1, __size)").alias("__prefix"))
    )
    fits = (F.col("__host") == F.col("host")) & (F.col("__prefix") == F.col("path_prefix"))
    return cuts.join(rules, fits).groupBy("url").agg(F.min_by("allow", "seq").alias("__allow"))


def followed(links: DataFrame, max_depth: int = DEFAULT_MAX_DEPTH) -> DataFrame:
    """Links of pages that are not yet at the depth limit, one level deeper."""
    return links.where(F.col("depth") < max_depth).withColumn("depth", F.col("depth") + 1)


QUEUE_KEY = ["job_id", "normalized_url"]
# Which of a key's candidates is first; the rest of the row settles equal ``seq``.
QUEUE_ORDER = ["seq", "url", "parent_url", "depth"]


def _checked(
    candidates: DataFrame, robots: DataFrame | None, agent: str, excluded_patterns: Sequence[str]
) -> DataFrame:
    rows = candidates.withColumn("normalized_url", urls.normalize_url(F.col("url")))
    rows = (
        robots_allowed(rows, robots, agent)
        if robots is not None
        else rows.withColumn("robots_ok", F.lit(True))
    )
    return rows.withColumn("is_excluded", excluded(F.col("url"), excluded_patterns))


def enqueue(
    candidates: DataFrame,
    known: DataFrame,
    robots: DataFrame | None = None,
    agent: str = "*",
    excluded_patterns: Sequence[str] = (),
) -> DataFrame:
    """The candidates (job_id, url, parent_url, depth, seq) that enter the queue.

    Per (job, normalized url) that is the first permitted one, by ``seq`` (any type
    with an order), unless the key is known. It is found by an aggregate, which combines on the map side, and
    only the one-per-key result meets the queue: no url is hot in any step.
    """
    rows = _checked(candidates, robots, agent, excluded_patterns)
    firsts = (
        rows.where(F.col("robots_ok") & ~F.col("is_excluded"))
        .groupBy(*QUEUE_KEY)
        .agg(F.min(F.struct(*QUEUE_ORDER)).alias("first"))
        .select(*QUEUE_KEY, "first.*")
    )
    return firsts.join(known.select(*QUEUE_KEY), QUEUE_KEY, "left_anti")


def enqueue_outcomes(
    candidates: DataFrame,
    known: DataFrame,
    robots: DataFrame | None = None,
    agent: str = "*",
    excluded_patterns: Sequence[str] = (),
) -> DataFrame:
    """What became of every candidate, for the job counters.

    Outcomes: ``duplicate`` (known, or later than the row that was queued),
    ``robots``, ``excluded``, ``queued``. Candidates are read twice, so they should
    be a stored table. Keys with very many candidates are split in the join back.
    """
    rows = _checked(candidates, robots, agent, excluded_patterns)
    usable = F.col("robots_ok") & ~F.col("is_excluded")
    per_key = rows.groupBy(*QUEUE_KEY).agg(
        F.min(F.when(usable, F.struct(*QUEUE_ORDER))).alias("queued"), F.count("*").alias("n")
    )
    marked = known.select(*QUEUE_KEY).distinct().withColumn("is_known", F.lit(True))
    hot = hottest(per_key, QUEUE_KEY)
    decided = salted_join(
        rows,
        per_key.drop("n").join(marked, QUEUE_KEY, "left"),
        QUEUE_KEY,
        hot,
        F.col("seq"),
    )
    return decided.withColumn(
        "outcome",
        F.when(F.col("is_known"), "duplicate")
        .when(F.struct(*QUEUE_ORDER) > F.col("queued"), "duplicate")
        .when(~F.col("robots_ok"), "robots")
        .when(F.col("is_excluded"), "excluded")
        .otherwise("queued"),
    ).drop("is_known", "queued", "robots_ok", "is_excluded")


def queue_rows(
    entering: DataFrame, now: datetime, priority: int = 2, method: str = "manual"
) -> DataFrame:
    """Candidates that enter the queue as rows of ``url_queue``."""
    return entering.select(
        "url",
        "normalized_url",
        F.lit("pending").alias("status"),
        F.lit(priority).alias("priority"),
        instant(now).alias("discovered_at"),
        F.col("parent_url").alias("first_seen_on"),
        F.lit(0).alias("attempts"),
        "job_id",
        "depth",
        "parent_url",
        F.lit(method).alias("discovery_method"),
        F.lit(0).cast("long").alias("estimated_processing_time"),
        F.lit(None).cast("timestamp").alias("next_retry"),
    )


def seed_candidates(starts: DataFrame) -> DataFrame:
    """Start urls (job_id, url, seq) as candidates at depth 0; queue at priority 1."""
    return starts.select(
        "job_id",
        "url",
        F.lit(None).cast("string").alias("parent_url"),
        F.lit(0).alias("depth"),
        "seq",
    )


def crawl_closure(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None = DEFAULT_MAX_DEPTH
) -> DataFrame:
    """Nodes reachable from ``seeds(node)`` over ``edges(src, dst)``, with first depth.

    One level per round: edges that leave the frontier, reduced to distinct
    targets, less what was reached before. Each level is checkpointed, so neither
    plan nor recovery grows with depth. Levels are counted: a small one is joined as
    it is, a larger frontier meets the edges in a salted join, which splits the edges
    of a node that has very many.
    """
    links = edges.select("src", "dst")
    hot = None
    level = cut_lineage(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    levels, depth, size = [level], 0, level.count()
    while size and (max_depth is None or depth < max_depth):
        depth += 1
        if size > SMALL_ROWS and hot is None:
            hot = cut_lineage(hot_keys(links, ["src"]))
        sources = level.select(F.col("node").alias("src"))
        targets = (
            lookup(links, sources, size, ["src"], F.col("dst"), "left_semi", hot)
            .select(F.col("dst").alias("node"))
            .distinct()
        )
        reached = reduce(DataFrame.unionAll, levels).select("node")
        new = targets.join(reached, "node", "left_anti")
        level = cut_lineage(new.withColumn("depth", F.lit(depth)))
        levels.append(level)
        size = level.count()
    return reduce(DataFrame.unionAll, levels)


def pending_batch(
    queue: DataFrame, now: datetime, limit: int = 16, job_id: str | None = None
) -> DataFrame:
    """Next urls to fetch: pending and, when retried, due.

    With a job: one top-k. Without: ``limit`` rows of every job; Spark cuts each
    job to ``limit`` rows before the shuffle, so a large job stays cheap.
    """
    due = queue.where(
        (F.col("status") == "pending")
        & (F.col("next_retry").isNull() | (F.col("next_retry") <= instant(now)))
    )
    order = ["priority", "discovered_at", "normalized_url"]
    if job_id is not None:
        return due.where(F.col("job_id") == job_id).orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    return due.withColumn("rank", rank).where(F.col("rank") <= limit)


def status_latest(transitions: DataFrame) -> DataFrame:
    """Current state per (job_id, url) of an append-only transition table."""
    return transitions.groupBy("job_id", "url").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.max("ts").alias("updated_at"),
        F.max("depth").alias("depth"),
    )


def retry_schedule(
    failures: DataFrame, now: datetime, retry_attempts: int = RETRY_ATTEMPTS
) -> DataFrame:
    """Queue rows that failed: one more attempt, later each time, or given up."""
    tried = F.coalesce("attempts", F.lit(0)) + 1
    again = tried < retry_attempts
    at = instant(now)
    return failures.select(
        *[c for c in failures.columns if c not in ("attempts", "status", "next_retry")],
        tried.alias("attempts"),
        F.when(again, "pending").otherwise("failed").alias("status"),
        F.when(again, F.timestamp_add("SECOND", tried * RETRY_STEP_SECONDS, at)).alias(
            "next_retry"
        ),
    )
