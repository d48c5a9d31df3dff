"""Payment and site analytics: filters, windows of time, leaderboards, concentration, breakdowns, conversion.

Every function takes DataFrames and an explicit `as_of`; none reads a clock. `days` 0 means all time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.views import at

ALLOWED_DAYS = (0, 1, 7, 14, 30)
OBSERVED_HOURS = (1, 6, 24, 72, 168, 360, 720)


def success() -> Column:
    return F.col("status") == "success"


def settled() -> Column:
    return F.col("stage") == "settled"


def total(amount: str = "amount", where: Column | None = None) -> Column:
    """Sum as a decimal without overflow to null; 0 where no row counts."""
    c = F.col(amount) if where is None else F.when(where, F.col(amount))
    return F.coalesce(F.sum(c), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)")


def clamp_days(days: int | None) -> int:
    return days if days in ALLOWED_DAYS else 30


def clamp_page(limit: int | None, offset: int | None, most: int = 100, default: int = 20) -> tuple[int, int]:
    return max(1, min(most, default if limit is None else limit)), max(0, offset or 0)


def within(days: int, as_of: str, column: str = "occurred_at") -> Column:
    return F.lit(True) if days <= 0 else F.col(column) >= at(as_of) - F.expr(f"interval {int(days)} days")


def matching(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of the equality filters that are given; None means no filter."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def overview(facts: DataFrame, days: int, as_of: str) -> DataFrame:
    s = settled()
    return facts.filter(within(days, as_of)).agg(
        F.count_if(s).alias("total_transactions"),
        F.count_if(s & success()).alias("successful_transactions"),
        F.count_if(s & (F.col("status") == "failed")).alias("failed_transactions"),
        F.count_if(F.col("stage") == "verified").alias("total_verifications"),
        total("amount", s & success()).alias("total_amount"),
        total("fee", s).alias("total_fee"),
        F.count_distinct(F.when(s, F.col("payer"))).alias("unique_buyers"),
        F.count_distinct(F.when(s, F.col("pay_to"))).alias("unique_sellers"),
        F.count_distinct("facilitator_id").alias("unique_facilitators"),
        F.count_distinct("network").alias("unique_networks"),
        F.count_distinct("resource_id").alias("unique_resources"),
        F.max("occurred_at").alias("latest_activity"),
        F.min("occurred_at").alias("first_activity"),
    )


def catalog_counts(resources: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s)
    return resources.agg(F.count("*").alias("cataloged"), of("active").alias("active"), of("stale").alias("stale"), of("quarantined").alias("quarantined"), F.count_distinct("origin").alias("origins"))


def timeseries(facts: DataFrame, bucket: str, days: int, as_of: str) -> DataFrame:
    start = F.date_trunc(bucket, "occurred_at").cast("timestamp_ntz")
    return facts.filter(settled() & within(days, as_of)).groupBy(start.alias("bucket_start")).agg(
        F.count("*").alias("total_transactions"), total("amount", success()).alias("total_amount"), F.count_distinct("payer").alias("unique_buyers"), F.count_distinct("pay_to").alias("unique_sellers")
    )


def transactions(facts: DataFrame, limit: int, offset: int, **equal) -> DataFrame:
    """A page of settled rows, newest first, with the number of all rows that match in each row."""
    found = matching(facts.filter(settled()), **equal)
    page = found.orderBy(F.desc("occurred_at"), F.desc("id")).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


def latest_by(facts: DataFrame, column: str, value) -> DataFrame:
    return facts.filter(F.col(column) == value).orderBy(F.desc("occurred_at"), F.desc("id")).limit(1)


def _roles(role: str) -> tuple[str, str]:
    return ("payer", "pay_to") if role == "buyer" else ("pay_to", "payer")


def participants(facts: DataFrame, role: str, days: int, as_of: str) -> DataFrame:
    """The leaderboard of buyers or sellers, unordered; order by amount, count (both falling) and address."""
    own, other = _roles(role)
    return facts.filter(settled() & F.col(own).isNotNull() & within(days, as_of)).groupBy(F.col(own).alias("address")).agg(
        F.count("*").alias("tx_count"),
        total("amount", success()).alias("total_amount"),
        F.count_distinct(other).alias("unique_counterparties"),
        F.count_distinct("network").alias("unique_networks"),
        F.sort_array(F.collect_set("network")).alias("networks"),
        F.sort_array(F.collect_set("facilitator_id")).alias("facilitators"),
        F.max("occurred_at").alias("latest_activity"),
    )


def page_of(board: DataFrame, limit: int, offset: int) -> DataFrame:
    return board.orderBy(F.desc("total_amount"), F.desc("tx_count"), "address").offset(offset).limit(limit)


def participant_count(facts: DataFrame, role: str, days: int, as_of: str) -> DataFrame:
    own, _ = _roles(role)
    return facts.filter(settled() & within(days, as_of)).agg(F.count_distinct(own).alias("total"))


def concentration(facts: DataFrame, role: str, days: int, as_of: str, tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Amounts of the largest parties. Only the largest max(tops) are ordered, so no window over all parties is needed."""
    own, _ = _roles(role)
    parties = facts.filter(settled() & F.col(own).isNotNull() & within(days, as_of)).groupBy(F.col(own).alias("address")).agg(total("amount", success()).alias("amount"), F.count("*").alias("transactions"))
    everyone = parties.agg(total("amount").alias("total_amount"), F.coalesce(F.sum("transactions"), F.lit(0)).alias("total_transactions"), F.count("*").alias("participants"))
    top = parties.orderBy(F.desc("amount"), "address").limit(max(tops))
    ranked = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("amount"), "address")))
    sums = [total("amount", F.col("position") <= n).alias(f"top{n}_amount") for n in tops]
    return ranked.agg(*sums, F.coalesce(F.sum(F.when(F.col("position") <= 5, F.col("transactions"))), F.lit(0)).alias("top5_transactions")).crossJoin(F.broadcast(everyone))


def participant_detail(facts: DataFrame, role: str, address, days: int, as_of: str) -> DataFrame:
    own, other = _roles(role)
    return facts.filter(settled() & (F.col(own) == address) & within(days, as_of)).agg(
        F.count("*").alias("tx_count"),
        F.count_if(success()).alias("successful"),
        total("amount", success()).alias("total_amount"),
        F.count_distinct(other).alias("unique_counterparties"),
        F.sort_array(F.collect_set("network")).alias("networks"),
        F.sort_array(F.collect_set("scheme")).alias("schemes"),
        F.min("occurred_at").alias("first_activity"),
        F.max("occurred_at").alias("latest_activity"),
    )


def counterparties(facts: DataFrame, role: str, address, days: int, as_of: str) -> DataFrame:
    own, other = _roles(role)
    return facts.filter(settled() & (F.col(own) == address) & within(days, as_of)).groupBy(F.col(other).alias("address")).agg(
        F.count("*").alias("tx_count"), total("amount", success()).alias("total_amount"), F.sort_array(F.collect_set("network")).alias("networks"), F.max("occurred_at").alias("latest_activity")
    )


def breakdowns(facts: DataFrame, days: int, as_of: str, keys: tuple[str, ...] = ("network", "scheme", "asset", "status")) -> DataFrame:
    """(dimension, key, measures) for every dimension in one scan: rows are unfolded once and grouped once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("key")) for k in keys])).alias("d")
    slim = facts.filter(settled() & within(days, as_of)).select(pairs, "amount", "payer", "pay_to", "facilitator_id", "occurred_at", success().alias("ok"))
    return slim.groupBy("d.dimension", "d.key").agg(
        F.count("*").alias("tx_count"),
        total("amount", F.col("ok")).alias("total_amount"),
        F.count_distinct("payer").alias("unique_buyers"),
        F.count_distinct("pay_to").alias("unique_sellers"),
        F.count_distinct("facilitator_id").alias("unique_facilitators"),
        F.max("occurred_at").alias("latest_activity"),
    )


def daily_totals(facts: DataFrame) -> DataFrame:
    """The rollup by day and six dimensions; statuses other than success carry no amount."""
    keys = [F.to_date("occurred_at").alias("usage_day"), "network", "scheme", "asset", "pay_to", "status"]
    return facts.filter(settled()).groupBy(*keys).agg(F.count("*").alias("transactions"), total("amount", success()).alias("amount"), total("fee").alias("fee"))


def daily_volume(rollup: DataFrame, days: int, as_of: str) -> DataFrame:
    recent = rollup if days <= 0 else rollup.filter(F.col("usage_day") >= F.date_sub(F.to_date(at(as_of)), days))
    return recent.groupBy("usage_day", "network", "scheme", "asset", "status").agg(F.sum("transactions").alias("transactions"), total("amount").alias("amount"), total("fee").alias("fee"))


def zero_filled(series: DataFrame, day: str, measures: list[str], days: int, as_of: str) -> DataFrame:
    """One row for each of the last `days` days up to as_of's; missing measures are 0."""
    spark = series.sparkSession
    calendar = spark.range(1).select(F.explode(F.expr(f"sequence(date_sub(date'{as_of[:10]}', {days - 1}), date'{as_of[:10]}', interval 1 day)")).alias(day))
    return F.broadcast(calendar).join(series, day, "left").select(day, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


def origins(resources: DataFrame, facts: DataFrame) -> DataFrame:
    """Origins with their resources' payments; facts are summed by resource before they meet the catalog."""
    per = facts.filter(settled() & F.col("resource_id").isNotNull()).groupBy("resource_id").agg(F.count("*").alias("n"), total("amount", success()).alias("a"))
    joined = resources.join(per, F.col("id") == F.col("resource_id"), "left")
    return joined.groupBy("origin").agg(F.count("*").alias("resources"), F.count_if(F.col("status") == "active").alias("active_resources"), F.coalesce(F.sum("n"), F.lit(0)).alias("tx_count"), total("a").alias("total_amount"))


def _slot(t: Column, seconds: int) -> Column:
    """Number of the span of `seconds` that a local timestamp falls in; independent of the session's time zone."""
    of_day = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return F.floor((F.date_diff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + of_day) / seconds)


def conversion_flags(impressions: DataFrame, events: DataFrame, hours: int, slots: int = 60) -> DataFrame:
    """impressions with booleans verified and settled: an event of the resource within `hours` after it, both ends included.

    Time is cut into spans of `hours`, and these into `slots` of a whole number of seconds, a divisor of hours * 3600. The next
    event of an impression stands in its own slot, in a later one of its span, or first in the span after it; what comes
    later is too late. Firsts by slot are small after their partial sums, and give each slot the first event behind it by an
    ordered pass over the at most `slots` + 1 rows of a span. Then one pass over each resource's rows of one slot finds the
    next events: a resource with most of all events is dealt to tasks by its slots, and no pairs are made. Impressions
    without a time, and those of a null resource, have no event.
    """
    width = hours * 3600 // slots
    if width * slots != hours * 3600:
        raise ValueError(f"{slots} slots do not divide {hours} hours")
    marks = [F.when(F.col("stage") == s, F.col("occurred_at")) for s in ("verified", "settled")]
    found = events.filter(F.col("resource_id").isNotNull()).select("resource_id", F.col("occurred_at").alias("t"), marks[0].alias("v"), marks[1].alias("s"))
    shown = impressions.select("resource_id", F.col("created_at").alias("t"), F.lit(None).cast("timestamp_ntz").alias("v"), F.lit(None).cast("timestamp_ntz").alias("s"), F.struct("*").alias("row"))
    both = shown.unionByName(found, allowMissingColumns=True).withColumn("slot", _slot(F.col("t"), width))
    least = [F.min(c).alias(c) for c in ("v", "s")]
    # rows of impressions alone keep their slots here, as these have to learn what follows; columns but the times are not read
    firsts = shown.select("resource_id", "t", "v", "s").unionByName(found).withColumn("slot", _slot(F.col("t"), width)).groupBy("resource_id", "slot").agg(*least)
    spans = firsts.withColumn("span", F.floor(F.col("slot") / slots))
    # the first event of a span is also the last row of the span before it
    behind = spans.groupBy("resource_id", "span").agg(*least).select("resource_id", F.lit(None).cast("long").alias("slot"), "v", "s", (F.col("span") - 1).alias("span"))
    later = Window.partitionBy("resource_id", "span").orderBy(F.asc_nulls_last("slot")).rowsBetween(1, Window.unboundedFollowing)
    carried = spans.unionByName(behind).withColumns({c: F.min(c).over(later) for c in ("v", "s")}).filter("slot is not null and (v is not null or s is not null)")
    whole = both.unionByName(carried.select("resource_id", "slot", "v", "s"), allowMissingColumns=True)
    ahead = Window.partitionBy("resource_id", "slot").orderBy(F.asc_nulls_last("t")).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    nexts = whole.withColumns({"v": F.min("v").over(ahead), "s": F.min("s").over(ahead)}).filter(F.col("row").isNotNull())
    soon = lambda c: F.coalesce(F.col(c) <= F.col("t") + F.expr(f"interval {int(hours)} hours"), F.lit(False))
    return nexts.select("row.*", soon("v").alias("verified"), soon("s").alias("settled"))


def recent_impressions(impressions: DataFrame, as_of: str, hours: int, days: int = 30) -> DataFrame:
    """Impressions that a conversion report takes in: of the last `days`, and of the attribution window before them."""
    return impressions.filter(F.col("created_at") >= at(as_of) - F.expr(f"interval {int(hours)} hours") - F.expr(f"interval {int(days)} days"))


def conversion(flags: DataFrame) -> DataFrame:
    top = lambda n: F.count_if(F.col("settled") & (F.col("position") <= n))
    return flags.agg(
        F.count("*").alias("impressions"), F.count_distinct("session_id").alias("sessions"), F.count_if("verified").alias("verified_impressions"), F.count_if("settled").alias("settled_impressions"),
        top(1).alias("settled_at_position_1"), top(3).alias("settled_within_top_3"), top(5).alias("settled_within_top_5"),
    )


def conversion_by_mode(impressions: DataFrame) -> DataFrame:
    fell = lambda key: F.count_if(F.get_json_object("degraded", f"$.{key}").isin("timeout", "error", "unavailable"))
    return impressions.groupBy("mode", "reranked").agg(
        F.count("*").alias("impressions"), F.count_distinct("session_id").alias("sessions"), F.round(F.avg("latency_ms")).cast("int").alias("avg_latency_ms"), fell("semantic").alias("semantic_fallbacks"), fell("reranking").alias("rerank_fallbacks")
    )


def observability(facts: DataFrame, as_of: str, hours: tuple[int, ...] = OBSERVED_HOURS) -> DataFrame:
    """Calls and successes of each resource in every window of time, and over all time, in one pass."""
    recent = {h: F.col("occurred_at") >= at(as_of) - F.expr(f"interval {h} hours") for h in hours}
    columns = [c for h, r in recent.items() for c in (F.count_if(r).alias(f"calls_{h}h"), F.count_if(r & success()).alias(f"success_{h}h"))]
    return facts.filter(settled() & F.col("resource_id").isNotNull()).groupBy("resource_id").agg(
        F.count("*").alias("calls_all_time"), F.count_if(success()).alias("success_all_time"), F.count_if(F.col("status") == "failed").alias("failed_all_time"), F.count_distinct("payer").alias("unique_buyers"), total("amount", success()).alias("total_amount"), *columns
    )


def site_summary(site: DataFrame) -> DataFrame:
    return site.agg(F.count_distinct("visitor").alias("visitors"), F.count_distinct("visitor", "page_path").alias("visits"), F.count_if(F.col("event_type") == "page_view").alias("page_views"), F.count_if(F.col("event_type") == "impression").alias("impressions"))


def site_daily(site: DataFrame) -> DataFrame:
    return site.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count_distinct("visitor").alias("visitors"), F.count_if(F.col("event_type") == "page_view").alias("page_views"))


def top_pages(site: DataFrame, n: int = 20) -> DataFrame:
    pages = site.groupBy("page_path").agg(F.count_if(F.col("event_type") == "page_view").alias("views"), F.count_distinct("visitor").alias("visits"))
    return pages.orderBy(F.desc("views"), F.desc("visits"), "page_path").limit(n)


def full_keys(observed: DataFrame, configured: DataFrame, key: str, measure: str) -> DataFrame:
    """Observed and configured keys together; what was not observed counts 0."""
    seen = observed.select(key, measure).join(configured.select(key, F.lit(True).alias("c")), key, "full_outer")
    return seen.select(key, F.coalesce(measure, F.lit(0)).alias(measure), F.coalesce("c", F.lit(False)).alias("configured"))
