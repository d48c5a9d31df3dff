"""Writes of the versioned catalog as set operations over ordered events: observations, options, overrides, stores, ledgers.

Events are ordered by a number per key; a micro-batch's number is the catalog version, so version order is commit order.
Everything here is windows and joins: a key's history is one ordered pass, nothing is folded row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def observe(events: DataFrame, key: str = "key", order: str = "id") -> DataFrame:
    """(key, order, outcome, active_hash) of each observation: indexed or pending for a new resource, quarantined for another
    owner than the first, refreshed, versioned, pending or rejected for the owner's own.

    events: (key, order, owner, hash, activate, reject_changes). A declaration that is known, a rival's quarantined one
    included, is never rejected; the active declaration is the last one that its owner activated. Null owners and hashes
    are values like others; events of a null key are one key's.
    """
    whole = Window.partitionBy(key).orderBy(order)
    same = Window.partitionBy(key, "hash").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumns({"__owner": F.first("owner").over(whole), "__first": F.row_number().over(whole) == 1})
    seen = seen.withColumn("__own", F.col("owner").eqNullSafe(F.col("__owner")))
    # a declaration is stored by the first event of a resource, by rivals, and by every own event that may change it
    stored = (F.col("__first") | ~F.col("__own") | ~F.col("reject_changes")).cast("int")
    seen = seen.withColumn("__known", F.coalesce(F.max(stored).over(same), F.lit(0)) == 1)
    rejected = F.col("__own") & ~F.col("__first") & ~F.col("__known") & F.col("reject_changes")
    activates = F.col("__own") & F.col("activate") & ~rejected
    seen = seen.withColumn("__active", F.last(F.when(activates, F.struct("hash")), True).over(before)["hash"])
    live = F.col("__active").eqNullSafe(F.col("hash"))
    outcome = (
        F.when(~F.col("__own"), "quarantined")
        .when(F.col("__first"), F.when(F.col("activate"), "indexed").otherwise("pending"))
        .when(rejected, "rejected")
        .when(F.col("__known") & live, "refreshed")
        .otherwise(F.when(F.col("activate"), "versioned").otherwise("pending"))
    )
    return seen.select(key, order, outcome.alias("outcome"), F.when(activates, F.col("hash")).otherwise(F.col("__active")).alias("active_hash"))


def option_history(events: DataFrame, group: list[str], value: str = "option_hash", order: str = "id") -> DataFrame:
    """(group, value, created_version, retired_version) of options under retire-and-append: a changed option retires the live
    one of its group and is appended, or revived where it was there before; the same option again changes nothing.

    retired_version is null for the live option of a group.
    """
    w = Window.partitionBy(*group).orderBy(order)
    changes = events.withColumn("__last", F.lag(F.struct(value)).over(w)).filter(F.col("__last").isNull() | ~F.col("__last")[value].eqNullSafe(F.col(value)))
    runs = changes.withColumn("__end", F.lead(order).over(w))
    return runs.groupBy(*group, value).agg(F.min(order).alias("created_version"), F.max_by("__end", order).alias("retired_version"))


def override_status(resources: DataFrame, overrides: DataFrame, key: str = "key", allowed: tuple[str, ...] = ("active", "disabled", "quarantined", "tombstoned")) -> DataFrame:
    """resources with the status, reason and catalog version of their last operator override; overrides: (key, version, status,
    reason), of which those with a status that is not allowed are left out."""
    last = overrides.filter(F.col("status").isin(*allowed)).groupBy(key).agg(F.max_by(F.struct("status", "reason", "version"), "version").alias("__o"))
    joined = resources.join(last, key, "left")
    own = lambda c: F.col(c) if c in resources.columns else F.lit(None)
    set_ = F.col("__o").isNotNull()
    return joined.withColumns({
        "status": F.when(set_, F.col("__o.status")).otherwise(own("status")),
        "quarantine_reason": F.when(set_, F.col("__o.reason")).otherwise(own("quarantine_reason").cast("string")),
        "updated_version": F.when(set_, F.col("__o.version")).otherwise(own("updated_version")),
    }).drop("__o")


def store_results(results: DataFrame, jobs: DataFrame, documents: DataFrame, dimension: int) -> DataFrame:
    """results with `outcome`: wrong_dimension, fenced (the job is gone or was claimed again), requeued (the document changed
    meanwhile) or stored.

    results: (job, fence, source_hash, size); jobs: (job, fence, document); documents: (document, source_hash), one row each.
    """
    j = jobs.select("job", F.col("fence").alias("__fence"), "document")
    d = documents.select("document", F.col("source_hash").alias("__hash"))
    met = results.join(j, "job", "left").join(d, "document", "left")
    outcome = (
        F.when(~F.col("size").eqNullSafe(F.lit(dimension)), "wrong_dimension")
        .when(~F.coalesce(F.col("__fence") == F.col("fence"), F.lit(False)), "fenced")
        .when(~F.coalesce(F.col("__hash") == F.col("source_hash"), F.lit(False)), "requeued")
        .otherwise("stored")
    )
    return met.withColumn("outcome", outcome).drop("__fence", "__hash")


def commit_versions(writes: DataFrame, batch: str, order: str) -> DataFrame:
    """writes with `version`, numbered without gaps in commit order: by batch, then by order within it. Batches are numbered by
    their counted rows, so no task holds more than one batch."""
    sizes = writes.groupBy(batch).agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    return writes.withColumn("__p", place).join(starts, batch).withColumn("version", (F.col("__start") + F.col("__p")).cast("long")).drop("__p", "__start")


def watermark(versions: DataFrame, done: Column) -> DataFrame:
    """The version up to which all writes are done: readers are pinned to it. versions: (version, ...), numbered from 1."""
    return versions.agg(F.coalesce(F.min(F.when(~done, F.col("version"))) - 1, F.max("version"), F.lit(0)).cast("long").alias("watermark"))


def settlement_state(requests: DataFrame, key: str = "key", order: str = "id") -> DataFrame:
    """requests with `decision`: owner (first of its key), conflict (another payload under the key), cached (the outcome is
    known), resume (the owner's lease ran out) or wait.

    requests: (key, order, payload, at) and the owner's (completed_at, lease_until), the latter on the first request.
    """
    w = Window.partitionBy(key).orderBy(order)
    first = lambda c: F.first(c).over(w)
    decision = (
        F.when(F.row_number().over(w) == 1, "owner")
        .when(~first("payload").eqNullSafe(F.col("payload")), "conflict")
        .when(F.coalesce(first("completed_at") <= F.col("at"), F.lit(False)), "cached")
        .when(F.coalesce(first("lease_until") < F.col("at"), F.lit(False)), "resume")
        .otherwise("wait")
    )
    return requests.withColumn("decision", decision)


def lease_channels(channels: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """(request, channel): free channels, least recently updated first, dealt to requests in their order; requests beyond the
    free channels get null. Leases that ran out count as free. Only as many channels as there are requests are ordered."""
    n = requests.count()
    free = channels.filter(F.col("lease_until").isNull() | (F.col("lease_until") < as_of)).orderBy("updated_at", "channel").limit(n)
    c = free.withColumn("__n", F.row_number().over(Window.orderBy("updated_at", "channel"))).select("channel", "__n")
    r = requests.withColumn("__n", F.row_number().over(Window.orderBy("request")))
    return r.join(c, "__n", "left").select("request", "channel")


def ledger_check(events: DataFrame, legal: dict[str | None, tuple[str, ...]], run: str = "run", order: str = "id", state: str = "state") -> DataFrame:
    """events with `legal`: whether the step from the run's last state is allowed; None stands for the start."""
    before = F.lag(state).over(Window.partitionBy(run).orderBy(order))
    ok = F.lit(False)
    for a, targets in legal.items():
        ok |= before.eqNullSafe(F.lit(a)) & F.col(state).isin(*targets)
    return events.withColumn("legal", F.coalesce(ok, F.lit(False)))


def version_hash(declaration: str, options: str) -> Column:
    """sha256 of a declaration's hash and its options' hashes in sorted order, so that the order of options does not count."""
    return F.sha2(F.concat_ws("|", F.col(declaration), F.array_join(F.array_sort(F.array_compact(options)), "|")), 256)


def mismatches(expected: str, actual: str, fields: list[str]) -> Column:
    """Names of the fields in which two structs differ, in order; an empty array lets a call pass. Null equals null."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{expected}.{f}").eqNullSafe(F.col(f"{actual}.{f}")), F.lit(f)) for f in fields]))


def natural_keys(resources: DataFrame, wanted: DataFrame, visible: Column) -> DataFrame:
    """For each wanted (type, url, tool) the newest visible resource, null ids where there is none; only tools of mcp resources are
    compared."""
    tool = lambda c: F.when(F.col("type") == "mcp", F.coalesce(F.col(c), F.lit("")))
    mine = resources.filter(visible).withColumn("__t", F.coalesce(tool("tool"), F.lit(""))).groupBy("type", "url", "__t").agg(F.max("id").alias("id"))
    asked = wanted.withColumn("__t", F.coalesce(tool("tool"), F.lit("")))
    return asked.join(mine, ["type", "url", "__t"], "left").drop("__t")


def queue_coverage(documents: DataFrame, vectors: DataFrame, jobs: DataFrame) -> DataFrame:
    """(expected, indexed, pending, failed, complete) of an index: active documents, those with a ready vector of their present
    source, and open and failed jobs.

    documents: (document, source_hash); vectors: (document, source_hash, status); jobs: (state).
    """
    ready = vectors.filter("status = 'ready'").select("document", "source_hash").distinct()
    marked = documents.join(ready.withColumn("__r", F.lit(1)), ["document", "source_hash"], "left")
    index = marked.agg(F.count("*").alias("expected"), F.count("__r").alias("indexed"))
    states = jobs.agg(F.count_if(F.col("state").isin("pending", "leased")).alias("pending"), F.count_if(F.col("state").isin("failed", "dead")).alias("failed"))
    complete = (F.col("expected") == F.col("indexed")) & (F.col("pending") == 0) & (F.col("failed") == 0)
    return index.crossJoin(states).withColumn("complete", complete)


def upsert_sessions(impressions: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, queries, shown, first_seen, last_seen): one row per session of an impression log: distinct queries, and the
    resources of its last query by position.

    impressions: (session, query, resource_id, position, created_at). A query's list is as long as the page that was shown.
    """
    pages = impressions.groupBy(session, "query").agg(
        F.max("created_at").alias("at"), F.min("created_at").alias("from"), F.transform(F.sort_array(F.collect_list(F.struct("position", "resource_id"))), lambda x: x["resource_id"]).alias("page")
    )
    last = F.max_by("page", F.struct("at", "query"))
    return pages.groupBy(session).agg(F.count("*").alias("queries"), last.alias("shown"), F.min("from").alias("first_seen"), F.max("at").alias("last_seen"))
