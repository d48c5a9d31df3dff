"""Records: documents compiled for search, flattening, external records, probes, classification, validation, hash vectors."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.json_schema import let
from tessera.functions.text import ATOMIC_TOKEN, WORD_TOKEN, seeded, tokens


_NODES = "array<struct<order:array<struct<place:int,name:string>>,path:string,v:variant>>"


def _json_levels(text: Column, depth: int, start, collect, finish) -> Column:
    """A walk over a JSON text, a level of nesting at a time, in built-in functions: collect(state, nodes) at each of `depth` + 1 levels,
    of nodes n with their members or items, then finish(state, nodes) with those that lie deeper. A node knows its path and its place in the order of keys; its last
    name is its key, null for items and for the top."""
    node = lambda n, place, name, path, x: F.struct(F.concat(n["order"], F.array(F.struct(place.alias("place"), name.alias("name")))).alias("order"), path.alias("path"), x.alias("v"))

    # types differ in what may be null only, which needs no cast: the first state allows it everywhere
    def below(x: Column) -> Column:
        n = x["n"]
        by_name = F.transform(x["members"], lambda e: node(n, F.lit(0), e["key"], F.when(n["path"] == "", e["key"]).otherwise(F.concat(n["path"], F.lit("."), e["key"])), e["value"]))
        by_place = F.transform(x["items"], lambda y, i: node(n, i, F.lit(None).cast("string"), F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), y))
        return F.coalesce(by_name, by_place, F.array().cast(_NODES))

    def level(state: Column, _: Column) -> Column:
        # a node is opened once: only an object has members, only an array has items
        taken = lambda n: F.struct(n.alias("n"), F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>")).alias("members"), F.try_variant_get(n["v"], "$", "array<variant>").alias("items"))
        deeper = lambda nodes: F.struct(F.flatten(F.transform(nodes, below)).alias("now"), collect(state["found"], nodes).alias("found"))
        return F.when(F.size(state["now"]) > 0, let(F.transform(state["now"], taken), deeper)).otherwise(state)

    def walk(v: Column) -> Column:
        root = F.array(F.struct(F.array().cast("array<struct<place:int,name:string>>").alias("order"), F.lit("").alias("path"), v.alias("v"))).cast(_NODES)
        first = F.struct(F.when(v.isNotNull(), root).otherwise(F.array().cast(_NODES)).alias("now"), start.alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), first, level, lambda state: finish(state["found"], state["now"]))

    return let(F.try_parse_json(text), walk)


def _shown(v: Column) -> Column:
    """A value that is no object and no array as a text: whole numbers without a point, however they are written."""
    text = F.try_variant_get(v, "$", "string")
    number = lambda n: F.when((n == F.floor(n)) & (F.abs(n) < 1e15), F.try_variant_get(v, "$", "decimal(38,0)").cast("string")).otherwise(text)
    return F.when(F.schema_of_variant(v).isin("STRING", "BOOLEAN"), text).otherwise(let(F.try_variant_get(v, "$", "double"), number))


def flattened(text: Column, depth: int = 8, most: int = 50) -> Column:
    """`path: value` lines of a JSON text in key order, at most `depth` levels below the top and `most` lines; nulls have none. Null and
    malformed texts, and those with a repeated key, give an empty array."""
    lines = "array<struct<order:array<struct<place:int,name:string>>,line:string>>"

    def collect(found: Column, nodes: Column) -> Column:
        leaves = F.filter(nodes, lambda n: n["members"].isNull() & n["items"].isNull() & ~F.is_variant_null(n["n"]["v"]))
        return F.concat(found, F.transform(leaves, lambda n: F.struct(n["n"]["order"].alias("order"), F.concat(n["n"]["path"], F.lit(": "), _shown(n["n"]["v"])).alias("line"))))

    return F.slice(_json_levels(text, depth, F.array().cast(lines), collect, lambda found, _: F.transform(F.array_sort(found), lambda x: x["line"])), 1, most)


def forbidden_keys(text: Column, names: set[str], depth: int = 64) -> Column:
    """Keys of a JSON text, at any depth, that are among names; sorted. Null and malformed texts, and those with a repeated key, have
    none; a text that is nested deeper than `depth` has the entry `(deeper)` besides, as it is not known to be clean."""
    wanted = F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>")

    def collect(found: Column, nodes: Column) -> Column:
        keys = F.transform(nodes, lambda n: F.get(n["n"]["order"], F.size(n["n"]["order"]) - 1)["name"])
        return F.array_union(found, F.array_intersect(keys, wanted))

    deeper = lambda found, nodes: F.array_sort(F.when(F.size(nodes) > 0, F.array_union(found, F.array(F.lit("(deeper)")))).otherwise(found))
    return _json_levels(text, depth, F.array().cast("array<string>"), collect, deeper)


def compile_document(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """rows with `document`: a `name: value` line for each field that is not null or empty, in the given order, and lexical
    fields high (the first), medium (the second) and low (the rest), in which each token stands once."""
    lines = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}: "), c)) for n, c in fields.items()]
    values = list(fields.values())
    once = lambda cs: F.array_join(F.array_distinct(tokens(F.concat_ws(" ", *cs), ATOMIC_TOKEN)), " ")
    return rows.withColumns({"document": F.concat_ws("\n", *lines), "high": once(values[:1]), "medium": once(values[1:2]), "low": once(values[2:]) if values[2:] else F.lit("")})


def search_document(rows: DataFrame) -> DataFrame:
    """rows with `document`, the lines of a resource in a fixed order, and the lexical fields high, medium and low, in which each token
    stands once. Fields that are null or empty have no line.

    rows: name, description, type, method, tool, route, url, parameters (array of name, required, description; the first 50 by name count), output,
    tags, mime, transport, examples (array of text) and options (array of network, scheme, amount, symbol, asset, pay_to).
    """
    c, none = F.col, F.array().cast("array<string>")
    given = lambda x: F.nullif(x, F.lit(""))
    line = lambda label, x: F.when(given(x).isNotNull(), F.array(F.concat(F.lit(f"{label}: "), x))).otherwise(none)
    listed = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.array(F.lit(f"{label}:")), F.transform(xs, lambda x: F.concat(F.lit("- "), x)))).otherwise(none)
    empty = lambda x, kind: F.coalesce(x, F.array().cast(kind))
    tags, examples = empty(c("tags"), "array<string>"), empty(c("examples"), "array<string>")
    parameters = F.slice(F.array_sort(empty(c("parameters"), rows.schema["parameters"].dataType.simpleString())), 1, 50)
    told = F.transform(parameters, lambda p: F.concat(p["name"], F.when(p["required"], " (required)").otherwise(""), F.coalesce(F.concat(F.lit(": "), given(p["description"])), F.lit(""))))
    options = empty(c("options"), rows.schema["options"].dataType.simpleString())
    payments = F.transform(options, lambda o: F.concat(F.lit("Payment: "), F.concat_ws(", ", o["network"], o["scheme"], F.concat_ws(" ", o["amount"], F.coalesce(o["symbol"], o["asset"])))))
    kind = F.when(c("type") == "mcp", F.concat_ws(" ", F.lit("MCP tool"), c("tool"))).otherwise(F.concat_ws(" ", F.lit("HTTP"), c("method")))
    lines = F.concat(
        line("Service", c("name")), line("Description", c("description")), line("Type", kind), line("Route", c("route")), line("Resource", c("url")), listed("Parameters", told), line("Output", c("output")),
        line("Tags", F.array_join(tags, ", ")), line("MIME", c("mime")), line("Transport", c("transport")), listed("Examples", examples), payments,
    )
    once = lambda *xs: F.array_join(F.array_distinct(tokens(F.concat_ws(" ", *xs), ATOMIC_TOKEN)), " ")
    low = F.flatten(F.transform(options, lambda o: F.array(o["network"], o["scheme"], o["amount"], o["symbol"], o["asset"], o["pay_to"])))
    return rows.withColumns({
        "document": F.array_join(lines, "\n"), "high": once(c("name"), c("type"), c("method"), c("tool"), c("route"), c("url")),
        "medium": once(c("description"), F.array_join(F.flatten(F.transform(parameters, lambda p: F.array(p["name"], p["description"]))), " "), c("output")),
        "low": once(F.array_join(tags, " "), c("mime"), c("transport"), F.array_join(examples, " "), F.array_join(low, " ")),
    })


def by_priority(body: str, names: list[str]) -> Column:
    """The first of the JSON fields that is there and not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(body, f"$.{n}")), F.lit("")) for n in names])


def apply_probes(records: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """records with a probe's status over their own, but unsafe wins from either side."""
    joined = records.join(probes.select(key, F.col("status").alias("__p")), key, "left")
    status = F.when((F.col("status") == "unsafe") | (F.col("__p") == "unsafe"), "unsafe").otherwise(F.coalesce("__p", "status"))
    return joined.withColumn("status", status).drop("__p")


def overlay(rows: DataFrame, patch: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """rows with the patch's values where it has any. Patch rows without a row are found with a left_anti join."""
    p = patch.select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.join(p, on, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def overlay_rejects(rows: DataFrame, patch: DataFrame, on: list[str]) -> DataFrame:
    """Patch rows outside the sample; an import with any of them is refused."""
    return patch.join(rows.select(*on), on, "left_anti")


def first_category(text: Column, keywords: dict[str, list[str]], default: str = "other") -> Column:
    """The first category, in the given order, of which a keyword occurs as a token."""
    words = tokens(text, ATOMIC_TOKEN)
    chain = reduce(lambda acc, kv: acc.when(F.arrays_overlap(words, F.array(*map(F.lit, kv[1]))), kv[0]), keywords.items(), F.when(F.lit(False), ""))
    return chain.otherwise(default)


def overlap_score(query: Column, name: Column, text: Column, categories: Column) -> Column:
    """Query tokens (repeats count) that the text has, 2 where a category is a query token, 1 where a query token is part of the name."""
    return token_overlap(tokens(query, WORD_TOKEN), name, tokens(text, WORD_TOKEN), categories)


def token_overlap(q: Column, name: Column, have: Column, categories: Column) -> Column:
    """overlap_score() of tokens that are there already."""
    in_category = F.exists(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.array_contains(q, F.lower(c)))
    in_name = F.exists(q, lambda w: F.contains(F.lower(F.coalesce(name, F.lit(""))), w))
    return F.size(F.filter(q, lambda w: F.array_contains(have, w))) + F.when(in_category, 2).otherwise(0) + F.when(in_name, 1).otherwise(0)


def filters_met(filters: Column, option: Column, fields: dict[str, str]) -> Column:
    """Whether an option has every value that the filters (a map) ask for; fields: filter name to option field."""
    tests = [~F.map_contains_key(filters, n) | F.coalesce(option[f] == filters[n], F.lit(False)) for n, f in fields.items()]
    return reduce(Column.__and__, tests)


#: Filters of a query and the fields of a payment option that they ask for.
OPTION_FILTERS = {"network": "network", "scheme": "scheme", "asset": "asset", "payTo": "pay_to"}


def resource_eligibility(filters: Column) -> Column:
    """Why a resource does not fit a query, or eligible: unsafe, unreachable, stale, incompatible, in this order. filters is a map of
    texts; the resource's columns are status, safety, liveness, transport, categories and accepts (array of options)."""
    c, has = F.col, lambda n: F.coalesce(filters[n], F.lit("")) != ""
    own = F.exists(F.coalesce("categories", F.array().cast("array<string>")), lambda x: F.lower(x) == F.lower(filters["category"]))
    asked = reduce(Column.__or__, [filters[n].isNotNull() for n in OPTION_FILTERS])
    fits = F.exists("accepts", lambda o: reduce(Column.__and__, [filters[n].isNull() | F.coalesce(o[f] == filters[n], F.lit(False)) for n, f in OPTION_FILTERS.items()]))
    bad = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when(bad(c("status") == "unsafe") | bad(c("safety") == "fail"), "unsafe").when(bad(c("status") == "unreachable") | bad(c("liveness") == "fail"), "unreachable").when(bad(c("status") == "stale"), "stale")
        .when(has("type") & ~c("transport").eqNullSafe(filters["type"]), "incompatible").when(has("category") & ~bad(own), "incompatible").when(bad(asked) & ~bad(fits), "incompatible").otherwise("eligible")
    )


#: Queries that meet all resources at once, larger sets are taken in blocks; and pairs of both that a task scores and sorts, about.
RANKED_QUERIES, RANKED_PAIRS = 1_000, 500_000


def ranked_resources(resources: DataFrame, queries: DataFrame, limit: int = 100) -> DataFrame:
    """(query_id, resource_id, eligibility, score, rank): the first `limit` resources of each query of a stated set, eligible ones first, then
    by score, then by id in byte order.

    resources: resource_id, service_name, description, resource, tags, categories, accepts, status, safety, liveness, transport;
    queries: query_id, text, filters. Null texts have no tokens, null filters ask for nothing. A block of counted size of
    queries is broadcast; each task keeps its first `limit` of a query before anything is shuffled. Resources are dealt by their counted
    number, so that a task has about RANKED_PAIRS pairs to sort; tokens are taken once a resource and once a query.
    """
    c = F.col
    options = F.flatten(F.transform(F.coalesce("accepts", F.array().cast(resources.schema["accepts"].dataType)), lambda o: F.array(o["scheme"], o["network"], o["asset"])))
    lists = [F.coalesce(x, F.array().cast("array<string>")) for x in (c("tags"), c("categories"), options)]
    have = tokens(F.concat_ws(" ", "service_name", "description", "resource", *lists), WORD_TOKEN)
    n_queries, n_resources = queries.count(), resources.count()
    blocks = -(-n_queries // RANKED_QUERIES) or 1
    tasks = -(-n_resources * -(-n_queries // blocks) // RANKED_PAIRS) or 1
    rows = resources.repartition(tasks, F.xxhash64("resource_id", "service_name")).withColumn("__have", have)
    asked = queries.select("query_id", tokens(c("text"), WORD_TOKEN).alias("__asked"), F.coalesce("filters", F.create_map().cast("map<string,string>")).alias("filters"))
    order = Window.partitionBy("query_id").orderBy(F.desc(c("eligibility") == "eligible"), F.desc("score"), "resource_id")
    parts = []
    for n in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        met = rows.join(F.broadcast(block))
        scored = met.select("query_id", "resource_id", resource_eligibility(c("filters")).alias("eligibility"), token_overlap(c("__asked"), c("service_name"), c("__have"), c("categories")).cast("long").alias("score"))
        parts.append(scored.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= limit))
    return reduce(DataFrame.unionByName, parts)


def judgment_pool(candidates: DataFrame, query: str, key: str, size: int, seed: str) -> DataFrame:
    """Per query the best candidate of each source first, then the best of the rest up to size; in seeded order.

    candidates: (query, key, source, score).
    """
    own = Window.partitionBy(query, "source").orderBy(F.desc("score"), key)
    fill = Window.partitionBy(query).orderBy(F.col("__s") > 1, F.desc("score"), key)
    picked = candidates.withColumn("__s", F.row_number().over(own)).withColumn("__f", F.row_number().over(fill)).filter(F.col("__f") <= size)
    shuffled = Window.partitionBy(query).orderBy(seeded(seed, F.concat_ws("|", F.col(query), F.col(key))), key)
    return picked.withColumn("place", F.row_number().over(shuffled)).drop("__s", "__f")


def attribute_fetches(fetches: DataFrame, sessions: DataFrame) -> DataFrame:
    """fetches with the position of their resource in the session's list, null where it was not shown."""
    joined = fetches.join(sessions.select("session_id", "shown"), "session_id", "left")
    return joined.withColumn("position", F.nullif(F.array_position("shown", F.col("resource_id")), F.lit(0).cast("long"))).drop("shown")


def prune(rows: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    return rows.filter(F.col(column) >= as_of - F.expr(f"interval {int(days)} days"))


def one_active(generations: DataFrame, activate: int) -> DataFrame:
    """Generations of which exactly the named one is active; what was active is retired."""
    status = F.when(F.col("id") == activate, "active").when(F.col("status") == "active", "retired").otherwise(F.col("status"))
    return generations.withColumn("status", status)


def hash_embedding(text: str, dimension: int = 64, memo: dict | None = None) -> list[float]:
    """A deterministic vector: every token adds a signed 1 at the place its sha256 gives, and a signed half at that of the token
    with #2 behind it; scaled to length 1."""
    out, memo = [0.0] * dimension, {} if memo is None else memo
    for w in re.findall("[a-z0-9]+", (text or "").lower()):
        if w not in memo:
            digests = [hashlib.sha256(x.encode()).digest() for x in (w, f"{w}#2")]
            memo[w] = [(int.from_bytes(h[:4], "big") % dimension, a if h[4] % 2 == 0 else -a) for h, a in zip(digests, (1.0, 0.5), strict=True)]
        for at, x in memo[w]:
            out[at] += x
    length = math.sqrt(sum(x * x for x in out))
    return [x / length for x in out] if length else out


#: Words whose hashes a task of hash vectors holds at most, and texts that it cuts into words at once.
EMBEDDED_WORDS, EMBEDDED_TEXTS = 65_536, 256


class _Places(dict):
    """What a word adds to a hash vector, as one number: place and sign of its own hash, then of that with #2 behind it."""

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        code = 0
        for h in (hashlib.sha256(x.encode()).digest() for x in (word, f"{word}#2")):
            code = code * 2 * self.dimension + int.from_bytes(h[:4], "big") % self.dimension * 2 + h[4] % 2
        if len(self) >= EMBEDDED_WORDS:
            self.clear()
        self[word] = code
        return code


def hash_embeddings(texts: pa.Array, dimension: int, places: _Places) -> pa.Array:
    """hash_embedding of each text; sums of halves are exact in any order. Only a few texts are cut into words at once."""
    out = np.zeros((len(texts), dimension))
    for a in range(0, len(texts), EMBEDDED_TEXTS):
        part = texts.slice(a, EMBEDDED_TEXTS).to_pylist()
        sums = np.zeros(len(part) * dimension)
        for i, t in enumerate(part):
            words = re.findall("[a-z0-9]+", (t or "").lower())
            own, twice = np.divmod(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), 2 * dimension)
            row = sums[i * dimension : (i + 1) * dimension]
            for code, x in ((own, 1.0), (twice, 0.5)):
                row += x * np.bincount(code >> 1, 1.0 - 2.0 * (code & 1), dimension)
        m = sums.reshape(len(part), dimension)
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        np.divide(m, length, out=out[a : a + len(part)], where=length > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dimension, pa.int32()), pa.array(out.ravel()))


def embedded(text: Column, dimension: int = 64) -> Column:
    """Hash vectors of texts, null ones as empty; a task holds the words of some texts and EMBEDDED_WORDS hashes besides the batch."""

    @F.arrow_udf("array<double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = _Places(dimension)
        for texts in batches:
            yield hash_embeddings(texts, dimension, places)

    return vectors(text)


def envelope(rows: DataFrame, assets: DataFrame, scheme: str, network: str, max_timeout: int, settling: bool = False) -> DataFrame:
    """rows with `reason`, the first broken rule of an envelope, null: none. In order: version, scheme, network, requirements
    (asset or receiver, then timeout, then amount), timeout, asset, amount, sponsorship.

    rows: request_version, payload_version and structs accepted and required of (scheme, network, asset, pay_to, timeout, amount:
    text, sponsored). assets: (asset, max_payment), one row each, that are allowed. Only version 2 is taken. Amounts need
    not agree when an open-ended scheme settles. Nulls break the rule they belong to.
    """
    a, r = F.col("accepted"), F.col("required")
    both = lambda name, value: a[name].eqNullSafe(F.lit(value)) & r[name].eqNullSafe(F.lit(value))
    same = lambda name: a[name].eqNullSafe(r[name])
    amount = F.when(F.regexp_like(a["amount"], F.lit(r"^[+-]?\d{1,38}$")), a["amount"].try_cast("decimal(38,0)"))
    j = rows.join(assets.select(F.col("asset").alias("__asset"), F.col("max_payment").alias("__most")), r["asset"] == F.col("__asset"), "left")
    amounts_agree = same("amount") if scheme == "exact" or not settling else F.lit(True)
    rules = [
        ("version", F.col("request_version").eqNullSafe(F.lit(2)) & F.col("payload_version").eqNullSafe(F.lit(2))),
        ("scheme", both("scheme", scheme)), ("network", both("network", network)),
        ("requirements", same("asset") & same("pay_to") & same("timeout") & amounts_agree),
        ("timeout", F.coalesce((r["timeout"] > 0) & (r["timeout"] <= max_timeout), F.lit(False))), ("asset", F.col("__asset").isNotNull()),
        ("amount", F.coalesce((amount > 0) & (amount <= F.col("__most")), F.lit(False))), ("sponsorship", both("sponsored", True)),
    ]
    first = F.coalesce(*[F.when(~ok, F.lit(n)) for n, ok in rules])
    return j.withColumn("reason", first).drop("__asset", "__most")


def fee_class(resource: Column, inclusion: Column, ceilings: tuple[int, int, int]) -> Column:
    return F.when(resource > ceilings[0], "resource").when(inclusion > ceilings[1], "inclusion").when(resource + inclusion > ceilings[2], "total").otherwise("ok")


def settlement_broken(max_amount: Column, actual: Column, after: Column, deadline: Column, refund: Column) -> Column:
    """Names of the settlement invariants that a row breaks."""
    rules = {"max": max_amount <= 0, "actual": (actual < 0) | (actual > max_amount), "deadline": after > deadline, "refund": refund != max_amount - actual}
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def valid_site_event(path: Column, visitor: Column, kind: Column, element: Column | None = None) -> Column:
    """Whether a raw site event is taken: known kind, well-formed visitor id and path, and an element key that is well formed where given."""
    ok = kind.isin("page_view", "impression") & F.regexp_like(visitor, F.lit("^[a-zA-Z0-9_-]{16,128}$")) & F.regexp_like(path, F.lit(r"^/[\w./-]{0,511}$"))
    if element is not None:
        ok &= element.isNull() | F.regexp_like(element, F.lit("^[a-z0-9_-]{1,96}$"))
    return F.coalesce(ok, F.lit(False))


def visitor_hash(visitor: Column) -> Column:
    """What is stored in place of a visitor id."""
    return F.sha2(visitor, 256)


def decisions(rows: DataFrame, original: str = "grade", final: str = "final", decision: str = "decision") -> DataFrame:
    """(decision, n, share, broken): owner review counts; approved rows must be unchanged and corrected ones changed."""
    wrong = ((F.col(decision) == "approved") & (F.col(original) != F.col(final))) | ((F.col(decision) == "corrected") & (F.col(original) == F.col(final)))
    counts = rows.groupBy(decision).agg(F.count("*").alias("n"), F.count_if(wrong).alias("broken"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def seeded_selection(candidates: DataFrame, query: str, key: str, n: int, family_most: int, seed: str) -> DataFrame:
    """Per query its anchor, then at most family_most of the anchor's family, then others by seeded order, n in all.

    candidates: (query, key, is_anchor, same_family).
    """
    h = seeded(seed, F.concat_ws("|", F.col(query), F.col(key)))
    kin = F.row_number().over(Window.partitionBy(query, "is_anchor", "same_family").orderBy(h, key))
    tier = F.when(F.col("is_anchor"), 0).when(F.col("same_family") & (F.col("__k") <= family_most), 1).when(~F.col("same_family"), 2).otherwise(3)
    ranked = candidates.withColumn("__k", kin).withColumn("__t", tier).filter("__t < 3")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("__t", h, key))).filter(F.col("place") <= n).drop("__k", "__t")
