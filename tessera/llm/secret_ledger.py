"""Secret scans with an incremental ledger of blobs, in built-in functions only.

Every version of a file is a blob, named by the digest of its text. The ledger is a table in the shared folder with one row
for each blob and run: the rules that were tried on it, each with its version, and what they found. A scan reads only texts
of which some rule in its current version has not been tried, one copy of each, and tries only these rules. Findings are then
joined back to every path and version that holds the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remove, scratch_root


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group has at least `least` characters; changed rules take a new version. Patterns
    must not match nothing, and `group` is one of theirs or 0 for the whole. Texts without `has` are not tried."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    has: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Kinds of the contract, in its order; their patterns are fixed values.
BASE = (
    Rule("assign", 1, rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, "[0-9a-f]+", 0, 24),
)
#: Kinds that the scan adds: keys in PEM blocks, signed web tokens, tokens with a public prefix, passwords in URLs.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", has="-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", has="eyJ"),
    Rule("prefixed", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,})"),
    Rule("url", 1, r"[a-z]{2,12}://[A-Za-z0-9._~%-]{1,64}:[^\x00-\x20/@:]{3,64}@[A-Za-z0-9.-]+", has="://"),
)
PRODUCTION_RULES = BASE + ADDED
_SPANS = "array<struct<kind:string,start:long,end:long>>"


def blob_id(text: Column) -> Column:
    """Address of a text by its content; a null text is an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def spans_of(text: Column, rule: Rule) -> Column:
    """array of (kind, start, end) in code points, end exclusive: leftmost matches that do not overlap, those too short left out.

    What split() leaves between the matches says where each of them stands.
    """
    # long runs of a class are its maximal runs, so short ones need not be looked at
    simple = {("[0-9a-f]+", 0): "[0-9a-f]{%d,}" % rule.least}.get((rule.pattern, rule.group), rule.pattern)
    whole = F.regexp_extract_all(text, F.lit(simple), F.lit(0))
    sizes = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(simple), F.lit(rule.group))
    gaps = F.split(text, simple, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        this = F.array(F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), end.alias("end"))).cast(_SPANS)
        kept = F.when(F.length(x["size"]) >= rule.least, F.concat(state["out"], this)).otherwise(state["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    # one gap stands before each match; the one behind the last is left out
    matches = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.arrays_zip(whole.alias("whole"), sizes.alias("size")), lambda g, m: F.struct(g.alias("gap"), m["whole"].alias("whole"), m["size"].alias("size")))
    return F.when(text.contains(rule.has) & text.rlike(simple), F.aggregate(matches, start, step, lambda s: s["out"])).otherwise(F.array().cast(_SPANS))


def of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


class Ledger:
    """The ledger in a folder of the shared store: (blob, rules, spans), one part for each run.

    A run is written beside the ledger and moved into it as a whole, so that one that failed leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def rows(self) -> DataFrame:
        """What is known: (blob, rules, spans); without rows where nothing was scanned yet."""
        schema = f"blob string, rules array<string>, spans {_SPANS}"
        fs, where = self._at(f"{self.path}/runs")
        if not fs.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/runs/*")

    def append(self, found: DataFrame) -> None:
        name = uuid.uuid4().hex
        found.write.parquet(f"{self.path}/open/{name}")
        fs, to = self._at(f"{self.path}/runs")
        fs.mkdirs(to)
        if not fs.rename(self._at(f"{self.path}/open/{name}")[1], self._at(f"{self.path}/runs/{name}")[1]):
            raise OSError(f"{self.path}: the run could not be added")


def unseen(addressed: DataFrame, ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, pending): the blobs of addressed, each once, with the names of the rules whose current version was not tried on them;
    those without such a rule are left out."""
    blobs = addressed.select("blob").distinct()
    tried = ledger.rows().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("tried"))
    now = F.array(*(F.lit(r.name) for r in rules))
    pending = F.array_except(now, F.coalesce("tried", F.array().cast("array<string>")))
    return blobs.join(tried, "blob", "left").select("blob", pending.alias("pending")).filter(F.size("pending") > 0)


def scan(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = PRODUCTION_RULES, keys: tuple[str, ...] = ("path", "version"), text: str = "text") -> DataFrame:
    """Scans what the ledger does not know and returns one row per row of versions: keys, blob, spans of the rules.

    spans are (kind, start, end), sorted by start and then as the rules are listed. Keys may be null or repeated: rows are
    told apart by their blobs. Null and empty texts are one blob without findings. A second scan of the same versions reads no
    text twice; a rule with a new version, and only it, is tried on all blobs again. Other columns of versions are not read.
    """
    spark = versions.sparkSession
    columns = [F.col(c).alias(f"key{i}") for i, c in enumerate(keys)]
    addressed = materialize(versions.select(*columns, blob_id(F.col(text)).alias("blob"), F.xxhash64(*keys).alias("place")), "addressed")
    pending = unseen(addressed, ledger, rules)
    # of all copies of a blob the text of one place is read; rows of one place and blob are equal, and cost a second look at most
    carriers = addressed.groupBy("blob").agg(F.min("place").alias("place")).join(pending, "blob")
    t = F.coalesce(F.col(text), F.lit(""))
    texts = versions.select(blob_id(F.col(text)).alias("blob"), F.xxhash64(*keys).alias("place"), t.alias("text"))
    due = texts.join(carriers.hint("shuffle_hash"), ["blob", "place"])
    tried = [F.when(F.array_contains("pending", r.name), spans_of(F.col("text"), r)).otherwise(F.array().cast(_SPANS)) for r in rules]
    ledger.append(due.select("blob", F.col("pending").alias("rules"), F.concat(*tried).alias("spans")))
    # of each kind, what its current version has found; the kinds of a run's rules tell the versions apart
    known = ledger.rows()
    current = [F.when(F.array_contains("rules", r.name), of_kind(r.kind)).otherwise(F.array().cast(_SPANS)) for r in rules]
    each = known.filter(F.size("spans") > 0).select("blob", F.explode(F.concat(*current)).alias("s")).distinct()
    rank = F.coalesce(*(F.when(F.col("s.kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)))
    found = each.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("s.start", rank.alias("rank"), "s.end", "s.kind"))).alias("spans"))
    out = addressed.join(found, "blob", "left")
    listed = F.transform(F.coalesce("spans", F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(*(F.col(f"key{i}").alias(c) for i, c in enumerate(keys)), "blob", listed.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n_<kind> of each base kind, base_sha256 (their spans) and spans (all) as text."""
    kinds = [r.kind for r in BASE]
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(*keys, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document as the one version of its path, against a ledger that is empty before: the report, one row per document."""
    spark = docs.sparkSession
    ledger = Ledger(spark, f"{scratch_root(spark)}/tessera-ledger-{uuid.uuid4().hex}")
    found = materialize(report(scan(docs, ledger, keys=(key,), text=text), (key,)), "findings")
    remove(spark, ledger.path)
    return found


def _sql() -> str:
    """Matches and what stands between them, kind by kind; places are sums of their lengths."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    parts = [f"SELECT row, {i} AS rank, '{r.kind}' AS kind, regexp_extract_all(text, {quote(r.pattern)}, 0) AS w, regexp_extract_all(text, {quote(r.pattern)}, {r.group}) AS g, string_split_regex(text, {quote(r.pattern)}) AS b, {r.least} AS least FROM d WHERE regexp_matches(text, {quote(r.pattern)})" for i, r in enumerate(PRODUCTION_RULES)]
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT row, rank, kind, least, unnest(w) AS w, unnest(g) AS g, unnest(b[1:len(w)]) AS b, unnest(range(1, len(w) + 1)) AS i FROM m),
s AS (SELECT row, rank, kind, CAST(sum(length(b) + length(w)) OVER (PARTITION BY row, rank ORDER BY i) AS BIGINT) AS stop, length(w) AS size, length(g) >= least AS good FROM e),
f AS (SELECT row, rank, kind, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM s WHERE good),
a AS (SELECT row, {counts}, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM f GROUP BY row)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row)
"""


#: DuckDB form of scan_documents().
ORACLE = _sql()
