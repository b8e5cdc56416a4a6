"""Operational views over queue, index, artifact and log tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.times import epoch_ms, relative_label_to_ms
from parley.functions.urls import PLATFORMS
from parley.operators import KEY
from parley.operators.artifacts import latest_openable

SORT_KEYS = ("title", "source_id", "status", "priority", "attempts", "discovered_at", "website_time", "last_seen_at",
             "last_export_at", "updated_at")


def _detail(name: str) -> Column:
    """A member of the details that is a text."""
    value = F.try_variant_get(F.try_parse_json("details"), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def log_context(logs: DataFrame) -> DataFrame:
    """Logs with platform, source, trace, worker and code lifted from the details where the column is empty."""
    return logs.withColumns({
        "platform": _log_platform(),
        "source_id": F.coalesce("source_id", _detail("sourceId")),
        "trace_id": F.coalesce("trace_id", _detail("traceId")),
        "worker_id": F.coalesce("worker_id", _detail("workerId")),
        "code": F.coalesce("code", _detail("code")),
    })


def platform_stats(queue: DataFrame, index: DataFrame) -> DataFrame:
    """One row per platform: counts of the queue and the index, zeros included."""
    # Distinct ids are counted from (platform, id) groups, so no task holds a platform's ids.
    per_id = queue.groupBy(*KEY).agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "failed")])
    q = per_id.groupBy("platform").agg(
        F.count_if(F.col("source_id").isNotNull()).alias("queued_ids"),
        *[F.sum(s).alias(s) for s in ("pending", "processing", "completed", "failed")])
    i = index.groupBy("platform").agg(F.count(F.lit(1)).alias("indexed"),
                                      F.count_if(F.col("export_state") == "exported").alias("exported"))
    zero = F.lit(0).cast("bigint")
    known = queue.sparkSession.createDataFrame([(p,) for p in PLATFORMS], "platform string")
    return known.join(q, "platform", "left").join(i, "platform", "left").select(
        "platform", F.greatest(F.coalesce("indexed", zero), F.coalesce("queued_ids", zero)).alias("discovered"),
        *[F.coalesce(n, zero).alias(n) for n in ("exported", "pending", "processing", "completed", "failed")])


def service_status(services: DataFrame, stats: DataFrame) -> DataFrame:
    """Services with the status their desired state, workers and queue imply."""
    pending = stats.select("platform", F.col("pending").alias("_pending"))
    tabs, workers = F.col("active_discovery_tabs") > 0, F.col("active_workers") > 0
    status = (F.when(~F.col("desired_running"), F.when(workers | tabs, "pausing").otherwise("paused"))
              .when(tabs, F.when(F.col("status") == "discovering", "discovering").otherwise("backfilling"))
              .when(workers, "running")
              .when(F.coalesce("_pending", F.lit(0)) > 0, "starting")
              .when(F.col("status") == "error", "error").otherwise("idle"))
    return services.join(pending, "platform", "left").withColumn("status", status).drop("_pending")


def filter_queue(queue: DataFrame, index: DataFrame, platform: str, status: str = "all", search: str = "") -> DataFrame:
    rows = queue.where(F.col("platform") == platform)
    if status != "all":
        rows = rows.where(F.col("status") == status)
    if not search:
        return rows
    seen = index.where(F.col("platform") == platform).select(
        *KEY, F.col("latest_source_updated_label").alias("_label"), F.col("latest_source_updated_at").alias("_at"))
    fields = ("title", "source_id", "last_error", "url", "error_code", "skip_reason", "_label", "_at")
    text = F.concat_ws(" ", *[F.nullif(F.col(f), F.lit("")) for f in fields])
    return rows.join(seen, KEY, "left").where(F.lower(text).contains(search.lower())).drop("_label", "_at")


def sort_queue(queue: DataFrame, index: DataFrame, latest: DataFrame, key: str, direction: str, now: Column) -> DataFrame:
    """Queue rows in the dashboard's order. Text keys compare without case and accents, digits by value."""
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key {key!r}")
    c = F.col
    rows = queue
    if key in ("title", "website_time", "last_seen_at"):
        rows = rows.join(index.select(*KEY, c("title").alias("_title"), c("latest_source_updated_at").alias("_at"),
                                      c("latest_source_updated_label").alias("_label"),
                                      c("last_seen_at").alias("_seen")), KEY, "left")
    if key == "last_export_at":
        rows = rows.join(latest.select(*KEY, c("exported_at").alias("_exported")), KEY, "left")

    def zero(x: Column) -> Column:
        return F.coalesce(x, F.lit(0))

    def natural(x: Column) -> Column:
        wide = F.regexp_replace(x, r"(\d+)", "00000000000000000000$1")
        return F.collate(F.regexp_replace(wide, r"0*(\d{20})(?!\d)", "$1"), "UNICODE_CI_AI")

    value = {
        "title": lambda: natural(F.coalesce("title", "_title", F.lit(""))),
        "source_id": lambda: natural(c("source_id")),
        "status": lambda: c("status"), "priority": lambda: c("priority"), "attempts": lambda: c("attempts"),
        "discovered_at": lambda: epoch_ms(c("discovered_at")),
        "website_time": lambda: F.coalesce(epoch_ms(c("_at")), zero(relative_label_to_ms(c("_label"), now))),
        "last_seen_at": lambda: zero(epoch_ms(c("_seen"))),
        "last_export_at": lambda: zero(epoch_ms(c("_exported"))),
        "updated_at": lambda: epoch_ms(c("updated_at")),
    }[key]()
    up = direction == "asc"
    order = [value.asc() if up else value.desc(), c("updated_at").asc() if up else c("updated_at").desc(), c("pos").asc()]
    return rows.orderBy(*order).select(*queue.columns)


def _before(a: Column, b: Column, order: list[tuple[str, bool]]) -> Column:
    """Whether struct ``a`` comes before ``b``; NULL is the least value of a column."""
    ways = {ascending for _, ascending in order}
    if len(ways) == 1:  # structs compare in the order of their fields
        return a < b if True in ways else b < a
    out, same = F.lit(False), F.lit(True)
    for name, ascending in order:
        x, y = (a[name], b[name]) if ascending else (b[name], a[name])
        out = out | (same & F.coalesce(x < y, x.isNull() & y.isNotNull()))
        same = same & x.eqNullSafe(y)
    return out


#: Ranges of a page's order: coarse ones, each of so many fine ones.
COARSE, FINE = 8, 8


def page(df: DataFrame, order: list[tuple[str, bool]], number: int, size: int = 100) -> DataFrame:
    """Page ``number`` (from 1), clamped to the last one; ``order``: (column, ascending) pairs, the last of them unique.

    Rows are counted in ranges of the order, whose bounds come from a sample of at most 1,024 rows; the counts tell which
    one or two ranges hold the page, and only those are sorted. Bounds and counts are scalar subqueries, so nothing runs
    while the plan is made, and no task sorts the whole table.
    """
    names, ranges = [name for name, _ in order], COARSE * FINE
    rows = df.withColumn("_key", F.struct(*names))
    sample = rows.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(16 * ranges).agg(F.collect_list("_key").alias("keys"))
    in_order = F.array_sort("keys", lambda a, b: F.when(_before(a, b, order), -1).when(_before(b, a, order), 1).otherwise(0))
    step = F.greatest(F.ceil(F.size("keys") / ranges).cast("int"), F.lit(1))
    bounds = sample.select(F.filter(in_order, lambda _, i: i % step == 0).alias("fine"))
    bounds = bounds.select(F.struct("fine", F.filter("fine", lambda _, i: i % FINE == 0).alias("coarse"))).scalar()

    def passed(some: Column) -> Column:
        return F.size(F.filter(some, lambda b: ~_before(F.col("_key"), b, order)))

    # The coarse bound first, then the fine ones behind it.
    placed = rows.withColumn("_bounds", bounds)
    placed = placed.withColumn("_first", F.greatest(passed(F.col("_bounds.coarse")) - 1, F.lit(0)) * FINE)
    fine = passed(F.slice(F.col("_bounds.fine"), F.col("_first") + 1, FINE))
    placed = placed.withColumn("_range", F.col("_first") + fine).drop("_bounds", "_first")
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(W.partitionBy())
    # The table of ranges has ``ranges`` + 1 rows at most.
    last = F.greatest(F.lit(1), F.ceil(total / size))
    start = (F.least(F.lit(max(1, number)).cast("bigint"), last) - 1) * size
    counts = counts.select("_range", before.alias("_from"), "_n", start.alias("_start"))
    hit = counts.where((F.col("_from") < F.col("_start") + size) & (F.col("_from") + F.col("_n") > F.col("_start")))
    keys = [F.col(name).asc() if ascending else F.col(name).desc() for name, ascending in order]
    near = placed.join(F.broadcast(hit), "_range").withColumn(
        "_at", F.row_number().over(W.partitionBy("_range").orderBy(*keys)) + F.col("_from") - 1)
    found = near.where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + size))
    return found.orderBy(*keys).select(*df.columns)


def filter_logs(logs: DataFrame, levels: Iterable[str], scope: str = "all", platform: str = "all", code: str = "all",
                search: str = "") -> DataFrame:
    c = F.col
    rows = logs.where(c("level").isin(*levels))
    if scope != "all":
        rows = rows.where(c("scope") == scope)
    if code != "all":
        rows = rows.where(c("code") == code)
    if platform != "all":
        rows = rows.where(_log_platform() == platform)
    if search:
        text = F.concat_ws(" ", F.nullif(c("scope"), F.lit("")), F.nullif(c("code"), F.lit("")),
                           F.nullif(c("message"), F.lit("")), F.coalesce("details", F.lit("{}")))
        rows = rows.where(F.lower(text).contains(search.lower()))
    return rows


def _log_platform() -> Column:
    named = F.lit(None).cast("string")
    # A later `when` wraps the earlier ones, so the list is walked from last to first choice.
    for platform in ("aistudio", "gemini", "chatgpt", "deepseek"):
        named = F.when(F.col("scope").contains(platform), platform).otherwise(named)
    return F.coalesce("platform", _detail("platform"), named)


def log_facets(logs: DataFrame) -> DataFrame:
    """(facet, value) sorted, `all` first in each facet."""
    both = logs.select(F.explode(F.array(
        F.struct(F.lit("scope").alias("facet"), F.col("scope").alias("value")),
        F.struct(F.lit("code").alias("facet"), F.nullif(F.col("code"), F.lit("")).alias("value")))).alias("f")).select("f.*")
    distinct = both.where("value IS NOT NULL").distinct()
    first = logs.sparkSession.createDataFrame([("scope", "all", 0), ("code", "all", 0)], "facet string, value string, rank int")
    return first.unionByName(distinct.withColumn("rank", F.lit(1))).orderBy("facet", "rank", "value").select("facet", "value")


def related_logs(logs: DataFrame, target: DataFrame) -> DataFrame:
    """Logs that share the target's source, else its trace, else its worker, else the target alone.

    ``target`` holds one row of ``logs``; what it shares is a scalar subquery, so the selection is a plain filter.
    """
    def shared() -> Column:
        keys = [F.when(F.coalesce(n, F.lit("")) != "", F.concat(F.lit(f"{n}:"), n)) for n in ("source_id", "trace_id", "worker_id")]
        return F.coalesce(*keys, F.concat(F.lit("id:"), "id"))

    one = log_context(target).select(shared().alias("k")).agg(F.first("k")).scalar()
    rows = log_context(logs.withColumn("_row", F.struct(*logs.columns))).withColumn("_want", one)
    kind = F.substring_index("_want", ":", 1)
    same = F.lit(False)
    for n in ("source_id", "trace_id", "worker_id", "id"):
        same = same | ((kind == n) & F.coalesce(F.concat(F.lit(f"{n}:"), n) == F.col("_want"), F.lit(False)))
    return rows.where(same).select("_row.*").orderBy("timestamp", "id")


def index_map(index: DataFrame, platform: str) -> DataFrame:
    return index.where(F.col("platform") == platform)


def openable_artifacts(artifacts: DataFrame, platform: str) -> DataFrame:
    return latest_openable(artifacts.where(F.col("platform") == platform))


def missing_local(queue: DataFrame, openable: DataFrame) -> DataFrame:
    """Queue rows that are not being processed and have no openable artifact."""
    return queue.where(F.col("status") != "processing").join(openable.select(*KEY), KEY, "left_anti")


def retain_logs(logs: DataFrame, n: int = 400) -> DataFrame:
    """Newest ``n`` logs (at least 50), newest first."""
    return logs.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(max(50, int(n)))

