"""Audit of how a labelled collection is spread: thirty named checks and eight associations from one scan of its records.

Every record is turned into the cells it counts in - groups, values of an axis within a group, pairs of values - and the cells
are counted once, with partial sums where the records are. Spreads, concentrations, drifts and contingency tables are then
read off the counts, which are as many as there are different values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written

#: What a release is held to.
POLICY = {
    "catalog": 500, "labeled": 100, "distractors": 400, "providers": 120, "http": 85, "mcp": 15, "exact_only": 70, "exact_and_upto": 22, "upto_only": 8, "adversarial": 15, "sparse": 10, "families": 20,
    "distractor_upto_share": 0.01, "mcp_min_families": 8, "upto_min_price_tiers": 8, "mcp_min_price_tiers": 8, "adversarial_min_price_tiers": 6, "sparse_min_price_tiers": 5, "network_drift": 0.15, "mcp_upto_drift": 0.05,
    "most_per_price_tier": 2, "upto_price_tier_share": 0.20, "slot_share": 0.40, "association": 0.30,
}
NETWORKS = ("testnet_only", "pubnet_only", "both")
GROUPS = ("mcp", "upto", "adversarial", "sparse")
#: The associations and their two sides.
ASSOCIATIONS = {
    "upto-family": ("upto", "family"), "upto-price-tier": ("upto", "price_tier"), "upto-input-method": ("upto", "input_method"), "mcp-family": ("resource_type", "family"), "mcp-price-tier": ("resource_type", "price_tier"),
    "network-family": ("network", "family"), "network-price-tier": ("network", "price_tier"), "network-input-method": ("network", "input_method"),
}
_AXES = ("family", "slot", "price_tier", "input_method", "resource_type", "network", "scheme_set")


def cells(sidecars: DataFrame, catalog: DataFrame) -> DataFrame:
    """(part, name, x, y, n): counts of all cells; the axes and pairs by one scan of the records. sidecars: (id, provider, is_distractor, resource_type, family,
    slot, price_tier, input_method, network, scheme_set, adversarial, sparse); catalog: (id, upto, agrees). A record that the
    other table lacks, that has its id more than once, or whose wire record does not agree is an error of the wire."""
    # narrow rows of both tables meet by id; repeated and null ids are only counted
    a = sidecars.select("id", F.lit(1).alias("s"), F.lit(0).alias("c"), F.col("is_distractor").cast("int").alias("d"), F.lit(None).cast("boolean").alias("upto"), F.lit(None).cast("boolean").alias("agrees"))
    b = catalog.select("id", F.lit(0).alias("s"), F.lit(1).alias("c"), F.lit(0).alias("d"), "upto", "agrees")
    met = a.unionByName(b).groupBy("id").agg(*[F.sum(n).alias(n) for n in ("s", "c", "d")], F.max("upto").alias("upto"), F.min("agrees").alias("agrees"))
    wrong = F.col("id").isNull() | (F.col("s") != 1) | (F.col("c") != 1) | ~F.coalesce("agrees", F.lit(False))
    offered = F.col("id").isNotNull() & F.coalesce("upto", F.lit(False))
    of_id = met.select(F.explode(F.array_compact(F.array(_cell("id", "catalog", n=F.col("c")), F.when(wrong, _cell("id", "errors")), F.when(offered, _cell("group", "distractor_upto", n=F.coalesce("d", F.lit(0))))))).alias("cell"))
    rows = sidecars
    labeled, bears = ~F.col("is_distractor"), F.col("scheme_set") != "exact_only"
    member = {"labeled": labeled, "mcp": labeled & (F.col("resource_type") == "mcp"), "upto": labeled & bears, "adversarial": labeled & F.col("adversarial"), "sparse": labeled & F.col("sparse")}
    own = [F.when(m, _cell("axis", g, F.lit(a), F.col(a).cast("string"))) for g, m in member.items() for a in _AXES]
    own += [F.when(m, _cell("group", g)) for g, m in member.items()]
    own += [F.when(member["mcp"] & bears, _cell("group", "mcp_upto")), F.when(~labeled, _cell("group", "distractors")), _cell("group", "sidecars"), _cell("provider", "all", F.col("provider").cast("string"))]
    own += [F.when(~labeled & (F.col("resource_type") != "http"), _cell("group", "distractor_mcp"))]
    side = lambda x: F.when(bears, "upto_bearing").otherwise("exact_only") if x == "upto" else F.col(x).cast("string")
    own += [F.when(labeled, _cell("pair", i, side(x), side(y))) for i, (x, y) in ASSOCIATIONS.items()]
    each = of_id.unionByName(rows.select(F.explode(F.array_compact(F.array(*own))).alias("cell")))
    return each.groupBy("cell.part", "cell.name", "cell.x", "cell.y").agg(F.sum("cell.n").alias("n"))


def _cell(part: str, name: str, x: Column | None = None, y: Column | None = None, n: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), (none if x is None else x).alias("x"), (none if y is None else y).alias("y"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def _facts(counts: DataFrame) -> DataFrame:
    """One row: n_<group>, <group>_<axis>_distinct and _most, <group>_<value> of the small axes, providers, errors and drifts."""
    here = lambda part, name: (F.col("part") == part) & (F.col("name") == name)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    out = {f"n_{g}": total(here("group", g)) for g in ("labeled", *GROUPS, "mcp_upto", "distractors", "sidecars", "distractor_upto", "distractor_mcp")}
    out |= {"n_catalog": total(here("id", "catalog")), "errors": total(here("id", "errors")), "providers": F.count_if((F.col("part") == "provider") & F.col("x").isNotNull())}
    for g in ("labeled", *GROUPS):
        for a in ("family", "slot", "price_tier"):
            axis = here("axis", g) & (F.col("x") == a) & F.col("y").isNotNull()
            out |= {f"{g}_{a}_distinct": F.count_if(axis), f"{g}_{a}_most": F.coalesce(F.max(F.when(axis, F.col("n"))), F.lit(0))}
        for a, values in {"network": NETWORKS, "input_method": ("GET", "POST"), "resource_type": ("http", "mcp"), "scheme_set": ("exact_only", "exact_and_upto", "upto_only")}.items():
            out |= {f"{g}_{v}": total(here("axis", g) & (F.col("x") == a) & (F.col("y") == v)) for v in values}
    one = counts.agg(*[c.alias(n) for n, c in out.items()])
    apart = lambda g, v: F.abs(F.col(f"{g}_{v}") / F.col(f"n_{g}") - F.col(f"labeled_{v}") / F.col("n_labeled"))
    drifts = {f"{g}_drift": F.when((F.col(f"n_{g}") == 0) | (F.col("n_labeled") == 0), 1.0).otherwise(F.greatest(*[apart(g, v) for v in NETWORKS])) for g in GROUPS}
    share = lambda k, n: F.when(F.col(n) > 0, F.col(k) / F.col(n)).otherwise(0.0)
    shares = {"upto_share": share("n_upto", "n_labeled"), "mcp_upto_share": share("n_mcp_upto", "n_mcp"), "upto_tier_share": share("upto_price_tier_most", "n_upto")} | {f"{g}_slot_share": share(f"{g}_slot_most", f"n_{g}") for g in GROUPS}
    return one.withColumns(drifts | shares)


def associations(counts: DataFrame, most: float) -> DataFrame:
    """(id, observed, passed): Cramer's V of the pairs of each association; null, and not passed, where a side has fewer than two values."""
    pairs = counts.filter("part = 'pair'")
    margin = lambda c: F.sum("n").over(Window.partitionBy("name", c))
    sums = pairs.withColumns({"row": margin("x"), "column": margin("y")}).groupBy("name").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("row") * F.col("column"))).alias("s"), (F.least(F.count_distinct("x"), F.count_distinct("y")) - 1).alias("free"))
    # cells that do not occur add their expectation to chi square, which is n (s - 1)
    v = F.when(F.col("free") > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / F.col("free")))
    ids = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(i) for i in ASSOCIATIONS])).alias("name"))
    found = F.broadcast(ids).join(sums, "name", "left").withColumn("v", v)
    return found.select(F.col("name").alias("id"), F.coalesce(_fixed(F.col("v")), F.lit("none")).alias("observed"), F.coalesce(F.col("v") <= most, F.lit(False)).alias("passed"))


def _fixed(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.6f", c.cast("double")))


def distribution_audit(sidecars: DataFrame, catalog: DataFrame, policy: dict[str, float] | None = None) -> DataFrame:
    """(id, observed, passed): thirty checks and eight associations; the release passes if all of them have passed. See cells() for the
    columns. Null axes count as no value; empty tables give all rows, with what holds of nothing."""
    p = POLICY | (policy or {})
    counts = written(cells(sidecars, catalog), "cells")
    c, text = F.col, lambda x: F.col(x).cast("string")
    told = lambda *names: F.concat_ws(", ", *[F.concat(F.lit(f"{n.removeprefix('labeled_').removeprefix('n_')}="), text(n)) for n in names])
    of = lambda x, n: F.concat(text(x), F.lit(f"/{n}"))
    listed = lambda g, vs: F.coalesce(F.nullif(F.concat_ws(",", *[F.when(c(f"{g}_{v}") > 0, v) for v in vs]), F.lit("")), F.lit("none"))
    drift = F.abs(c("mcp_upto_share") - c("upto_share"))
    checks = {
        "corpus-counts": ((c("n_catalog") == p["catalog"]) & (c("n_sidecars") == p["catalog"]) & (c("n_labeled") == p["labeled"]) & (c("n_distractors") == p["distractors"]), told("n_catalog", "n_sidecars", "n_labeled", "n_distractors")),
        "provider-count": (c("providers") == p["providers"], of("providers", p["providers"])),
        "catalog-sidecar-wire": (c("errors") == 0, F.concat(text("errors"), F.lit(" error(s)"))),
        "distractor-scheme-budget": (c("n_distractor_upto") <= int(p["distractors"] * p["distractor_upto_share"]), F.concat_ws("/", text("n_distractor_upto"), text("n_distractors"))),
        "distractor-resource-type-target": (c("n_distractor_mcp") == 0, F.concat(F.lit("http="), (c("n_distractors") - c("n_distractor_mcp")).cast("string"), F.lit(", mcp="), text("n_distractor_mcp"))),
        "resource-type-target": ((c("labeled_http") == p["http"]) & (c("labeled_mcp") == p["mcp"]), told("labeled_http", "labeled_mcp")),
        "scheme-target": ((c("labeled_exact_only") == p["exact_only"]) & (c("labeled_exact_and_upto") == p["exact_and_upto"]) & (c("labeled_upto_only") == p["upto_only"]), told("labeled_exact_only", "labeled_exact_and_upto", "labeled_upto_only")),
        "adversarial-target": (c("n_adversarial") == p["adversarial"], text("n_adversarial")), "sparse-target": (c("n_sparse") == p["sparse"], text("n_sparse")),
        "upto-family-spread": (c("upto_family_distinct") == p["families"], of("upto_family_distinct", p["families"])),
        "upto-price-spread": (c("upto_price_tier_distinct") >= p["upto_min_price_tiers"], text("upto_price_tier_distinct")),
        "upto-http-method-spread": ((c("upto_GET") > 0) & (c("upto_POST") > 0), listed("upto", ("GET", "POST"))), "upto-resource-type-spread": ((c("upto_http") > 0) & (c("upto_mcp") > 0), listed("upto", ("http", "mcp"))),
        "mcp-upto-share": (drift <= p["mcp_upto_drift"], F.concat(F.lit("overall="), _fixed(c("upto_share")), F.lit(", mcp="), _fixed(c("mcp_upto_share")), F.lit(", drift="), _fixed(drift))),
        "mcp-family-spread": (c("mcp_family_distinct") >= p["mcp_min_families"], of("mcp_family_distinct", p["families"])),
    }
    checks |= {f"{g}-price-spread": (c(f"{g}_price_tier_distinct") >= p[f"{g}_min_price_tiers"], text(f"{g}_price_tier_distinct")) for g in ("mcp", "adversarial", "sparse")}
    checks |= {f"{g}-network-drift": (c(f"{g}_drift") <= p["network_drift"], _fixed(c(f"{g}_drift"))) for g in GROUPS}
    checks |= {f"{g}-price-concentration": (c(f"{g}_price_tier_most") <= p["most_per_price_tier"], text(f"{g}_price_tier_most")) for g in ("mcp", "adversarial", "sparse")}
    checks["upto-price-concentration"] = (c("upto_tier_share") <= p["upto_price_tier_share"], _fixed(c("upto_tier_share")))
    checks |= {f"{g}-slot-concentration": (c(f"{g}_slot_share") <= p["slot_share"], _fixed(c(f"{g}_slot_share"))) for g in GROUPS}
    rows = [F.struct(F.lit(i).alias("id"), seen.alias("observed"), F.coalesce(ok, F.lit(False)).alias("passed")) for i, (ok, seen) in checks.items()]
    return _facts(counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*").unionByName(associations(counts, p["association"]))
