"""Keyed state: upserts with retraction, catalog observation, rate windows, budgets. One fold serves batches and streams.

A fold is a plain function (state, event) -> (state, output). fold_batch runs it over each key's events in order; stream()
runs the same function by applyInPandasWithState, so both give equal results for events that arrive in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Fold = Callable[[dict | None, dict], tuple[dict, dict]]


def fold_batch(events: DataFrame, key: str, order: list[str], fold: Fold, schema: str) -> DataFrame:
    """The outputs of a fold over each key's events in order. A key's events stream through one task one by one: they are
    sorted on disk where needed and only the state is held. Events of a null key are one key's; integers stay whole."""
    spread = events.repartition(key).sortWithinPartitions(key, *order)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            out = []
            for event in b.to_pylist():
                if event[key] != now:
                    now, state = event[key], None
                state, row = fold(state, event)
                out.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)

    return spread.mapInArrow(run, schema)


def fold_stream(events: DataFrame, key: str, order: list[str], fold: Fold, schema: str) -> DataFrame:
    """The same over a stream; a micro-batch's events of a key are taken in order."""

    def run(keys, frames, state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        rows = []
        for event in pd.concat(list(frames)).sort_values(order).to_dict("records"):
            held, row = fold(held, event)
            rows.append(row)
        state.update((json.dumps(held),))
        yield pd.DataFrame(rows)

    return events.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def budget(limit: int) -> Fold:
    """Admits an amount while the sum of admitted amounts of the key stays within the limit; a denied amount adds nothing."""

    def step(state: dict | None, e: dict) -> tuple[dict, dict]:
        spent = (state or {"spent": 0})["spent"]
        ok = spent + int(e["amount"]) <= limit
        spent += int(e["amount"]) if ok else 0
        return {"spent": spent}, {"id": int(e["id"]), "admitted": bool(ok), "spent": int(spent)}

    return step


def two_scope_budget(per_scope: int, everyone: int) -> Fold:
    """Admits an amount only while both the sum of its scope and the sum of all scopes stay within their limits; the key is the
    period, such as a day, as the common limit ties all its events together. spent is the sum of all scopes."""

    def step(state: dict | None, e: dict) -> tuple[dict, dict]:
        s = state or {"own": {}, "all": 0}
        scope, amount = str(e["scope"]), int(e["amount"])
        own = s["own"].get(scope, 0)
        ok = own + amount <= per_scope and s["all"] + amount <= everyone
        if ok:
            s["own"][scope] = own + amount
            s["all"] += amount
        return s, {"id": int(e["id"]), "admitted": ok, "spent": s["all"]}

    return step


def period_budget(limit: int, period: int) -> Fold:
    """As budget(), but the sum starts anew with the first event `period` or more after the one that opened the window."""

    def step(state: dict | None, e: dict) -> tuple[dict, dict]:
        s = state if state and int(e["ledger"]) < state["opened"] + period else {"opened": int(e["ledger"]), "spent": 0}
        ok = s["spent"] + int(e["amount"]) <= limit
        s = {"opened": s["opened"], "spent": s["spent"] + (int(e["amount"]) if ok else 0)}
        return s, {"id": int(e["id"]), "admitted": bool(ok), "spent": s["spent"]}

    return step


def reservations() -> Fold:
    """reserve, settle, release, unknown by payment id; repeats change nothing. Gives the reserved and settled sums of the key; each
    event changes the sums by its own payment, so that its time does not depend on how many are open."""

    def step(state: dict | None, e: dict) -> tuple[dict, dict]:
        s = state or {"held": {}, "done": {}, "settled": 0}
        # a state that was kept without the sum of the open payments gets it once
        if "reserved" not in s:
            s["reserved"] = sum(s["held"].values())
        p, kind, amount = str(e["payment"]), e["kind"], int(e["amount"])
        if kind == "reserve" and p not in s["held"] and p not in s["done"]:
            s["held"][p] = amount
            s["reserved"] += amount
        elif kind in ("settle", "release") and p in s["held"]:
            s["reserved"] -= s["held"].pop(p)
            s["done"][p] = kind
            s["settled"] += amount if kind == "settle" else 0
        # an unknown outcome keeps its reservation
        return s, {"id": int(e["id"]), "reserved": s["reserved"], "settled": s["settled"]}

    return step


def reservation_changes(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """events (key, payment, kind, amount) with what each adds to its key's reserved and settled sums, which are the sums of these
    columns over the key's events so far; as reservations(). Payments of a key do not touch each other, so that each is a window of
    its own and a key with most of all events is dealt to tasks."""
    so_far = Window.partitionBy(key, "payment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kind, amount = F.col("kind"), F.col("amount")
    reserves = events.withColumn("__reserves", F.count_if(kind == "reserve").over(so_far))
    closing = kind.isin("settle", "release") & (F.col("__reserves") > 0)
    seen = reserves.withColumns({"__closings": F.count_if(closing).over(so_far), "__held": F.first(F.when(kind == "reserve", amount), ignorenulls=True).over(so_far)})
    opens, closes = (kind == "reserve") & (F.col("__reserves") == 1), closing & (F.col("__closings") == 1)
    reserved = F.when(opens, amount).when(closes, -F.col("__held")).otherwise(0)
    return seen.withColumns({"reserved": reserved, "settled": F.when(closes & (kind == "settle"), amount).otherwise(0)}).drop("__reserves", "__closings", "__held")


def catalog_observation() -> Fold:
    """create, refresh, version or quarantine: the first owner keeps a resource; another owner's declaration is quarantined; the
    same declaration refreshes; a changed one of the owner appends a version."""

    def step(state: dict | None, e: dict) -> tuple[dict, dict]:
        if state is None:
            s, action = {"owner": e["owner"], "hash": e["hash"], "version": 1}, "create"
        elif e["owner"] != state["owner"]:
            s, action = state, "quarantine"
        elif e["hash"] == state["hash"]:
            s, action = state, "refresh"
        else:
            s, action = {**state, "hash": e["hash"], "version": state["version"] + 1}, "version"
        return s, {"id": int(e["id"]), "action": action, "version": int(s["version"])}

    return step


def last_write(facts: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last state of each key: repeated and out-of-date writes fall away; of writes of one order the greatest row counts, column by
    column, so that the result does not depend on how rows are dealt out."""
    rest = [c for c in facts.columns if c not in key]
    latest = F.max(F.struct(F.col(order).alias("order"), F.struct(*rest).alias("row"))).alias("l")
    return facts.groupBy(*key).agg(latest).select(*key, "l.row.*")


def retractions(facts: DataFrame, key: list[str], order: str, dimensions: list[str], amount: str) -> DataFrame:
    """Deltas of a rollup: every write adds its row and takes its predecessor's back. (dimensions, transactions, amount) sums
    equal the rollup of last_write, with zero rows where everything was taken back."""
    w = Window.partitionBy(*key).orderBy(order)
    before = {f"__{c}": F.lag(c).over(w) for c in [*dimensions, amount]}
    with_before = facts.withColumns(before).withColumn("__n", F.lag(F.lit(1)).over(w))
    plus = with_before.select(*dimensions, F.lit(1).alias("transactions"), F.col(amount).alias("amount"))
    minus = with_before.filter("__n is not null").select(*[F.col(f"__{c}").alias(c) for c in dimensions], F.lit(-1).alias("transactions"), (-F.col(f"__{amount}")).alias("amount"))
    return plus.unionByName(minus).groupBy(*dimensions).agg(F.sum("transactions").alias("transactions"), F.sum("amount").alias("amount"))


def rate_windows(events: DataFrame, key: str, ts: str, most: int, width: str = "1 minute") -> DataFrame:
    """Events per key and fixed window, and how many of them a limit admits."""
    counted = events.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), "n", F.least("n", F.lit(most)).alias("admitted"))


def backoff(attempts: int, base: float, most: float) -> float:
    return min(base * 2 ** (attempts - 1), most)


def claimable(jobs: DataFrame, as_of, limit: int) -> DataFrame:
    """Jobs that are due: pending with their time come, or leased with the lease run out; each claim raises the fence."""
    due = ((F.col("state") == "pending") & (F.col("due") <= as_of)) | ((F.col("state") == "leased") & (F.col("lease_until") < as_of))
    return jobs.filter(due).orderBy("due", "id").limit(limit).withColumn("fence", F.col("fence") + 1)


def settle_attempt(jobs: DataFrame, base: float, most: float, max_attempts: int) -> DataFrame:
    """State after a failed attempt: pending with a later time, or dead at the last attempt."""
    n = F.col("attempts") + 1
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), n - 1), F.lit(most))
    return jobs.select("id", n.alias("attempts"), F.when(n >= max_attempts, "dead").otherwise("pending").alias("state"), F.when(n < max_attempts, wait).alias("wait"))


def revive(jobs: DataFrame, as_of) -> DataFrame:
    """Dead jobs start again: pending, due now, without attempts."""
    dead = F.col("state") == "dead"
    return jobs.withColumns({"attempts": F.when(dead, 0).otherwise(F.col("attempts")), "due": F.when(dead, as_of).otherwise(F.col("due")), "state": F.when(dead, "pending").otherwise(F.col("state"))})


def enqueue(documents: DataFrame, vectors: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents that need a vector: none of their source hash and no open job."""
    need = documents.join(vectors.select("id", "hash"), ["id", "hash"], "left_anti")
    return need.join(jobs.filter("state in ('pending', 'leased')").select("id"), "id", "left_anti")


def stale(rows: DataFrame, last_seen: str, as_of, hours: int) -> DataFrame:
    """Active rows become stale by their age and active again by an observation."""
    old = F.col(last_seen) < as_of - F.expr(f"interval {hours} hours")
    return rows.withColumn("status", F.when(F.col("status").isin("active", "stale"), F.when(old, "stale").otherwise("active")).otherwise(F.col("status")))
