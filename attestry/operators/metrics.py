"""Workspace metrics: periods, activity, health, roll-ups, attention lists, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import numbers as N
from attestry.functions import text as T


def period_kpis(events: DataFrame, start: Column, middle: Column, stop: Column, measures: dict[str, Column]) -> DataFrame:
    """(kpi, current, prior, change): each measure over [middle, stop) and [start, middle), in one scan.

    Change is in percent with one decimal; from nothing to nothing it is 0, from nothing null.
    """
    now = (F.col("ts") >= middle) & (F.col("ts") < stop)
    then = (F.col("ts") >= start) & (F.col("ts") < middle)
    aggs = [F.coalesce(fn(F.when(w, c)).cast("double"), F.lit(0.0)).alias(f"{k}{p}")
            for k, (fn, c) in measures.items() for p, w in (("_now", now), ("_then", then))]
    row = events.filter((F.col("ts") >= start) & (F.col("ts") < stop)).agg(*aggs)
    parts = [F.struct(F.lit(k).alias("kpi"), F.col(f"{k}_now").alias("current"), F.col(f"{k}_then").alias("prior")) for k in measures]
    out = row.select(F.inline(F.array(*parts)))
    return out.withColumn("change", percent_change(F.col("current"), F.col("prior")))


def percent_change(current: Column, prior: Column) -> Column:
    ratio = F.round(F.try_divide(current - prior, prior) * 1000) / 10
    return F.when(prior == 0, F.when(current == 0, 0.0)).otherwise(ratio)


def compliance_rate(findings: DataFrame, by: list[str]) -> DataFrame:
    """(by, findings, rate): compliant over assessed; 0 where nothing was assessed."""
    good = F.count_if(F.col("result") == "compliant")
    assessed = F.count_if(F.col("result").isin("compliant", "non_compliant", "needs_evidence"))
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("findings"), F.coalesce(F.try_divide(good, assessed), F.lit(0.0)).alias("rate"))


def daily_counts(events: DataFrame, first: str, days: int) -> DataFrame:
    """(day, n) for each of so many days, empty days included."""
    calendar = events.sparkSession.range(days).select(F.date_add(F.to_date(F.lit(first)), F.col("id").cast("int")).alias("day"))
    counts = events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def outcome_counts(rows: DataFrame, column: str, values: list[str], by: list[str]) -> DataFrame:
    """(by, one count for each value): conditional counts in one scan."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def health_inputs(sources: DataFrame, versions: DataFrame, permissions: DataFrame, linked: DataFrame, as_of: Column, by: str = "workspace_id") -> DataFrame:
    """(by, counts for the health score): statuses, stale, untagged, unlinked, without grants, duplicate groups."""
    live = sources.filter("deleted_at IS NULL")
    stale = F.col("last_synced_at") < as_of - F.expr("INTERVAL 180 DAYS")
    counts = live.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ready", "failed", "processing", "needs_review")],
        F.count_if(stale).alias("outdated"), F.count_if(F.size("tags") == 0).alias("missing_metadata"),
    )
    unlinked = live.join(linked.select("source_id").distinct(), "source_id", "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("unlinked"))
    closed = live.join(permissions.select("source_id").distinct(), "source_id", "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("permission_issues"))
    current = versions.filter("is_current").join(live.select("source_id", by), "source_id")
    groups = current.groupBy(by, "sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy(by).agg(F.count(F.lit(1)).alias("duplicates"))
    out = reduce(lambda a, b: a.join(b, by, "left"), (unlinked, closed, groups), counts)
    return out.na.fill(0, ["unlinked", "permission_issues", "duplicates"])


def health_score(n: Column, failed: Column, review: Column, outdated: Column, missing: Column, unlinked: Column, duplicates: Column, closed: Column) -> Column:
    """0 to 100; 100 for an empty workspace."""

    def share(x: Column) -> Column:
        return N.clamp(x / F.nullif(n, F.lit(0)))

    score = (
        0.4 * share(n - failed - review) + 0.15 * share(n - outdated) + 0.15 * share(n - missing) + 0.15 * share(n - unlinked)
        + 0.1 * (1 - share(duplicates)) + 0.05 * share(n - closed)
    )
    return F.coalesce(F.floor(N.clamp(score) * 100 + 0.5).cast("long"), F.lit(100))


def duplicate_groups(versions: DataFrame) -> DataFrame:
    """(sha256, n): contents that more than one current version holds."""
    return versions.filter("is_current").groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pooled_title(titles: DataFrame, by: str, title: str = "title", most: int = 120) -> DataFrame:
    """(by, name): titles in order joined by +, white space to _, cut with an ellipsis over ``most``."""
    joined = titles.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(title)), "+").alias("t"))
    clean = F.regexp_replace("t", r"\s+", "_")
    return joined.select(by, F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - 3), F.lit("..."))).otherwise(clean).alias("name"))


def next_versions(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """(source_id, sha256, version_number): new contents numbered after the source's last; known contents keep their version."""
    new = incoming.select("source_id", "sha256", "arrived").join(versions.select("source_id", "sha256"), ["source_id", "sha256"], "left_anti")
    new = new.groupBy("source_id", "sha256").agg(F.min("arrived").alias("arrived"))
    last = versions.groupBy("source_id").agg(F.max("version_number").alias("last"))
    order = Window.partitionBy("source_id").orderBy("arrived", "sha256")
    return new.join(last, "source_id", "left").select("source_id", "sha256", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).alias("version_number"))


def promote(versions: DataFrame) -> DataFrame:
    """Versions with is_current on the one promoted last of each source."""
    order = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("promoted_at"), F.desc("version_number"))
    return versions.withColumn("is_current", F.col("promoted_at").isNotNull() & (F.row_number().over(order) == 1))


QUANTILES = (0.5, 0.95, 0.99)


def metric_points(observations: DataFrame, by: list[str], newest: int = 4096) -> DataFrame:
    """(by, count, sum, p50, p95, p99): totals over everything, nearest-rank percentiles over the newest observations.

    The newest are taken by a limit for each label set, which every task applies before the shuffle.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("event_id"))
    totals = observations.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"))
    recent = observations.select(*by, "ts", "event_id", "value").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= newest)
    ranks = recent.groupBy(*by).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(f"p{int(q * 100)}") for q in QUANTILES])
    same = reduce(lambda x, y: x & y, [totals[c].eqNullSafe(ranks[c]) for c in by])
    return totals.join(ranks, same, "left").select(*[totals[c] for c in by], "count", "sum", *[f"p{int(q * 100)}" for q in QUANTILES])


def metric_sketches(observations: DataFrame, by: list[str], minutes: int, k: int = 200) -> DataFrame:
    """(by, window_start, count, sum, sketch): quantile sketches of each label set and window, to be stored and merged.

    The rank of what a sketch tells as a quantile is off by about 1.7 / k (under 1 % at 200) with 99 %
    confidence, and merging does not add to that. A sketch has a few kilobytes, however many values it saw.
    """
    w = F.window("ts", f"{minutes} minutes").alias("w")
    rows = observations.groupBy(*by, w).agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"), F.kll_sketch_agg_double("value", k).alias("sketch"))
    return rows.select(*by, F.col("w.start").alias("window_start"), "count", "sum", "sketch")


def merged_points(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, count, sum, p50, p95, p99) of stored sketches over any windows and label sets, merged upward."""
    rows = sketches.groupBy(*by).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.kll_merge_agg_double("sketch").alias("s"))
    return rows.select(*by, "count", "sum", *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(f"p{int(q * 100)}") for q in QUANTILES])


def exposition(points: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """One column of ``name{label="x"} value`` lines."""
    shown = F.concat_ws(",", *[F.concat(F.lit(f'{label}="'), F.col(label).cast("string"), F.lit('"')) for label in labels])
    return points.select(F.concat(F.lit(name + "{"), shown, F.lit("} "), F.col(value).cast("string")).alias("line"))


def newest_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def page_of(rows: DataFrame, page: int, size: int, order: list) -> DataFrame:
    """A page of rows in order, each with the total and the number of pages."""
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    out = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    return out.join(total, F.lit(True)).withColumn("pages", F.ceil(F.col("total") / size))


def capped(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """At most so many rows of each group, with the group's total and whether it was cut."""
    # the count goes by its own partial sums, so that the rank is cut below the shuffle
    totals = rows.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("total"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= most)
    return first.join(totals, F.col(by).eqNullSafe(F.col("_by"))).drop("_by").withColumn("truncated", F.col("total") > most)


def attention(kinds: dict[str, DataFrame], most: int, dismissed: DataFrame) -> DataFrame:
    """(kind, item_id, workspace_id): the newest of each kind for each workspace, without what was dismissed."""
    rows = None
    for kind, items in kinds.items():
        own = capped(items, "workspace_id", [F.desc("at"), "item_id"], most).select(F.lit(kind).alias("kind"), "item_id", "workspace_id")
        rows = own if rows is None else rows.unionByName(own)
    return rows.join(dismissed, ["kind", "item_id"], "left_anti")


def page_ranges(rows: DataFrame, by: str, page: str = "page") -> DataFrame:
    """(by, ranges): distinct pages as '1-3, 7'."""
    order = Window.partitionBy(by).orderBy(page)
    islands = rows.select(by, page).distinct().withColumn("g", F.col(page) - F.row_number().over(order)).groupBy(by, "g").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return islands.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("r")).select(by, F.array_join("r.t", ", ").alias("ranges"))


def stage_rollup(jobs: DataFrame, minutes: int = 10) -> DataFrame:
    """(stage, complete, running, blocked, state) over the newest job of each source in the current batch.

    The batch is every job that is active or started within so many minutes of the newest.
    """
    newest = newest_per_key(jobs, ["source_id"], [F.desc("started_at"), F.desc("job_id")])
    last = newest.agg(F.max("started_at")).first()[0]
    batch = newest.filter(F.col("status").isin("queued", "running") | (F.col("started_at") >= F.lit(last) - F.expr(f"INTERVAL {minutes} MINUTES")))
    stages = batch.select(F.explode("stages").alias("s")).select(F.col("s.key").alias("stage"), "s.state")
    out = stages.groupBy("stage").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("complete", "running", "blocked")], F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("blocked") > 0, "blocked").when(F.col("running") > 0, "running").when(F.col("complete") == F.col("n"), "complete").otherwise("pending")
    return out.withColumn("state", state).drop("n")


def rate_windows(events: DataFrame, seconds: int, by: str = "user_id") -> DataFrame:
    """(by, window_start, n, weighted): the window's count plus the previous window's, weighed by the overlap left at its end."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    counts = events.groupBy(by, start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_timestamp("ts") % seconds).alias("at"))
    order = Window.partitionBy(by).orderBy("window_start")
    adjacent = F.unix_timestamp(F.lag("window_start").over(order)) == F.unix_timestamp("window_start") - seconds
    before = F.when(adjacent, F.lag("n").over(order)).otherwise(0)
    return counts.select(by, "window_start", "n", (F.col("n") + before * (1 - F.col("at") / seconds)).alias("weighted"))


def alerts(events: DataFrame, minutes: int = 15, share: float = 0.05) -> DataFrame:
    """(window_start, n, failed): windows where more than ``share`` of the events failed."""
    w = events.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"))
    return w.filter(F.col("failed") > share * F.col("n")).select(F.col("w.start").alias("window_start"), "n", "failed")


def queue_alerts(changes: DataFrame, limit: int = 100, minutes: float = 10, by: str = "queue") -> DataFrame:
    """(by, start, until): times in which a queue stays over ``limit`` for ``minutes`` at least.

    changes (by, ts, delta): how a queue's depth changes. Sums run within hours and are carried on from
    one hour to the next, and only changes between over and not over go on, so that no task meets a
    queue's whole history. A queue that is over the limit at its last change is so until then.
    """
    at = changes.filter("ts IS NOT NULL").groupBy(by, "ts").agg(F.sum("delta").alias("delta")).withColumn("_h", F.date_trunc("hour", "ts"))
    hours = at.groupBy(by, "_h").agg(F.sum("delta").alias("net"), F.max("ts").alias("last"))
    earlier = Window.partitionBy(by).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(by, "_h", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(by, "_h").orderBy("ts")
    rows = at.join(hours, [by, "_h"]).withColumn("depth", F.col("before") + F.sum("delta").over(inside))
    over = F.col("depth") > limit
    was = F.coalesce(F.lag(over).over(inside), F.col("before") > limit)
    flips = rows.select(by, "_h", "ts", over.alias("over"), was.alias("was")).filter("over <> was").select(by, "_h", "ts", "over")
    # the flip after the last one of an hour is the first of the next hour that has one
    firsts = flips.groupBy(by, "_h").agg(F.min("ts").alias("first"))
    later = Window.partitionBy(by).orderBy("_h").rowsBetween(1, 1)
    firsts = firsts.select(by, "_h", F.min("first").over(later).alias("next"))
    ends = at.groupBy(by).agg(F.max("ts").alias("end"))
    told = flips.join(firsts, [by, "_h"]).join(ends, by)
    until = F.coalesce(F.lead("ts").over(inside), F.col("next"), F.col("end"))
    spans = told.withColumn("until", until).filter("over").select(by, F.col("ts").alias("start"), "until")
    return spans.filter(F.col("until") >= F.col("start") + F.expr(f"INTERVAL {round(minutes * 60)} SECONDS"))


def all_alerts(runs: DataFrame, queue: DataFrame, citations: DataFrame, retrievals: DataFrame, minutes: int = 15, share: float = 0.05,
               depth: int = 100, lasting: float = 10, slow: float = 4.0) -> DataFrame:
    """(kind, subject, start, value) of four alerts.

    failures: share of failed runs (ts, failed) of a window over ``share``; queue: minutes for which a
    queue (queue, ts, delta) stays over ``depth``, ``lasting`` at least; verification: share of verified
    citations (ts, verified) of a window under 1; retrieval: nearest-rank 95th percentile of the seconds
    of retrievals (ts, seconds) of a window over ``slow``.
    """
    w = F.window("ts", f"{minutes} minutes").alias("w")
    none = F.lit("").alias("subject")
    failed = runs.groupBy(w).agg((F.count_if("failed") / F.count(F.lit(1))).alias("value")).filter(F.col("value") > share)
    verified = citations.groupBy(w).agg(F.avg(F.col("verified").cast("double")).alias("value")).filter("value < 1")
    p95 = retrievals.groupBy(w).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds)").alias("value")).filter(F.col("value") > slow)
    out = queue_alerts(queue, depth, lasting).select(
        F.lit("queue").alias("kind"), F.col("queue").cast("string").alias("subject"), "start",
        (F.timestamp_diff("MICROSECOND", F.col("start"), F.col("until")) / 60_000_000).alias("value"),
    )
    for kind, rows in (("failures", failed), ("verification", verified), ("retrieval", p95)):
        out = out.unionByName(rows.select(F.lit(kind).alias("kind"), none, F.col("w.start").alias("start"), F.col("value").cast("double").alias("value")))
    return out


def stage_progress(stages: Column) -> Column:
    """Per cent of the stages that are done."""
    done = F.size(F.filter(stages, lambda s: s["state"] == "complete"))
    return F.coalesce(F.round(F.try_divide(done * 100, F.size(stages))).cast("int"), F.lit(0))


def next_jobs(jobs: DataFrame, as_of: Column, by: list[str], most: int = 1) -> DataFrame:
    """The queued jobs whose time has come, highest priority and then oldest first, at most so many of each group."""
    due = jobs.filter((F.col("status") == "queued") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= as_of)))
    order = Window.partitionBy(*by).orderBy(F.desc("priority"), "created_at", "job_id")
    return due.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


#: Orders in which rows are listed; each ends in the unique key.
LISTINGS = {
    "title": ["title"], "updated": ["-updated_at"], "status": ["status", "-updated_at"], "pinned": ["-pinned", "-updated_at"],
}


def listing(rows: DataFrame, name: str, key: str, most: int) -> DataFrame:
    """The first rows in one of LISTINGS with their place; the limit is taken in each task before they meet."""
    order = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in LISTINGS[name]]
    first = rows.orderBy(*order, key).limit(most)  # at most so many rows reach the window
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order, key))).withColumn("listing", F.lit(name))


def term_counts(chunks: DataFrame, key: str, document: str, text: str = "content") -> DataFrame:
    """(term, tf, df): how often a content term stands, and in how many different keys.

    A row counts its terms and its different terms by itself, and only terms are shuffled. Where a
    document, which a key names, stands more than once, its keys may too, and their terms meet first.
    """
    many = chunks.select(document, "ordinal").filter("ordinal = 1").groupBy(document).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(document)

    def told(tokens):
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        places = F.transform(tokens, lambda t: F.struct(t.alias("term"), one.alias("tf"), zero.alias("df")))
        return F.concat(places, F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), zero.alias("tf"), one.alias("df"))))

    once = chunks if many.isEmpty() else chunks.join(many, document, "left_anti")
    counts = once.select(F.explode(T.let(T.content_tokens(F.col(text)), told)).alias("x")).select("x.*").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    if once is chunks:
        return counts
    again = chunks.join(many, document, "left_semi").select(key, F.explode(T.content_tokens(F.col(text))).alias("term"))
    per = again.groupBy("term", key).agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    return counts.unionByName(per).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
