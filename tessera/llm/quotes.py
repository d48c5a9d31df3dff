"""Chat formatting by quotation linking, in built-in functions only.

Lines that begin with > marks, outside fenced code, are quotes; the number of marks is the level. Runs of lines of one level, parted at blank
lines, are passages. Passages and single lines are normalised (A-Z and other capitals lower-cased, white space folded)
and hashed, and quoted hashes are joined to the first message of the same conversation that has them as its own words.
A message replies to the earlier message that most of its shallowest linked quotes come from. Replies are ordered by the
message their chain starts from and then by turn, so each stands after what it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

_MARKS = r"^(?:[ \t]*>)+"
#: Lines that announce a quote, in the languages of the corpus; dropped where a quote follows.
_ANNOUNCES = r"^(?:On|Am|Le|El)\b.*(?:wrote|schrieb.*|a écrit|escribió)\s*:\s*$"


#: Put before a line of fenced code, so that it is no quote.
_CODE = "\x02"


def guarded(text: Column) -> Column:
    """The text with _CODE before each line of a closed block of fenced code that would be taken for a quote."""
    parts = F.split(F.concat(F.lit("\n"), text), r"(?m)(?=^[ \t]*```)", -1)
    inside = lambda i, v: (i % 2 == 1) & (i < F.size(v) - 1)
    marked = let(parts, lambda v: F.transform(v, lambda x, i: F.when(inside(i, v), F.regexp_replace(x, r"(?m)^(?=[ \t]*>)", _CODE)).otherwise(x)))
    return F.when(F.contains(text, F.lit("```")), F.substr(F.array_join(marked, ""), F.lit(2))).otherwise(text)


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def lines_of(text: Column) -> Column:
    """array<struct<level, line>> of a text; level 0 is the author's own."""
    raw = F.split(guarded(F.coalesce(text, F.lit(""))), r"\r?\n", -1)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", ""))
    line = lambda x: F.regexp_replace(F.regexp_replace(x, _MARKS + r"[ \t]?", ""), "^" + _CODE + r"(?=[ \t]*>)", "")
    return F.transform(raw, lambda x: F.struct(level(x).alias("level"), line(x).alias("line")))


def passages_of(lines: Column) -> Column:
    """array<struct<level, passage>>: runs of lines of one level, parted at blank lines, in normalised form."""

    def runs(v: Column) -> Column:
        blank = lambda i: F.trim(F.get(v, i)["line"]) == ""
        begins = lambda i: (i == 0) | (F.get(v, i)["level"] != F.get(v, i - 1)["level"]) | blank(i) | blank(i - 1)
        heads = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.coalesce(begins(i), F.lit(True)))

        def texts(h: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                part = F.slice(v, s + 1, F.coalesce(F.get(h, k + 1), F.size(v)) - s)
                return F.struct(F.get(v, s)["level"].alias("level"), normalised(F.array_join(F.transform(part, lambda x: x["line"]), " ")).alias("passage"))

            return F.filter(F.transform(h, one), lambda x: x["passage"] != "")

        return let(heads, texts)

    return let(lines, runs)


def _units(messages: DataFrame, quoted: bool, least_chars: int) -> DataFrame:
    """(conv, turn, level, place, hash, passage): passages (place from 0) and single lines (place from -1 down) of a kind."""
    kind = (lambda x: x["level"] > 0) if quoted else (lambda x: x["level"] == 0)
    whole = F.transform("passages", lambda x, i: F.struct(x["level"].alias("level"), i.alias("place"), x["passage"].alias("passage")))
    single = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), (-1 - i).alias("place"), normalised(x["line"]).alias("passage")))
    both = F.filter(F.concat(whole, single), lambda x: kind(x) & (F.length(x["passage"]) >= F.when(x["place"] < 0, least_chars).otherwise(1)))
    return messages.select("conv", "turn", F.explode(both).alias("u")).select("conv", "turn", "u.level", "u.place", F.xxhash64("u.passage").alias("hash"), "u.passage")


def _chains(links: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) for links (conv, turn, reply_to): pointers are doubled until all of them end at a message without a link."""
    now = materialize(links.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")), "chain")
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = now.join(up, ["conv", "root"], "left")
        if step.filter("next is not null").isEmpty():
            return now
        now = materialize(step.select("conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chain")


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", least_chars: int = 2) -> DataFrame:
    """messages with text rid of its quotes, and reply_to (turn of the message answered, null: none), thread (turn its chain of
    replies starts from), depth (replies between), n_quotes (quoted passages), n_linked (of them, found in an earlier message)
    and unlinked (the passages that were not found, so nothing is lost). Single lines of a passage are looked up from least_chars on.

    In a conversation, order by thread, turn gives the reply order. Null texts stay null, texts of quotes only become empty.
    Messages of a null conversation or turn are not linked. Repeated rows are kept and linked alike; of several messages with
    a passage the earliest turn is its origin, and only earlier turns can be answered. Columns of the added names are replaced.
    """
    shaped = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), lines_of(F.col(text)).alias("lines")).filter("conv is not null and turn is not null")
    quoting = shaped.filter(F.exists("lines", lambda x: x["level"] > 0)).dropDuplicates(["conv", "turn", "lines"])
    quotes = materialize(_units(quoting.withColumn("passages", passages_of(F.col("lines"))), True, least_chars), "quotes")
    if quotes.isEmpty():
        none = F.lit(None).cast(messages.schema[turn].dataType)
        bare = {"reply_to": none, "thread": F.col(turn), "depth": F.lit(0), "n_quotes": F.lit(0).cast("long"), "n_linked": F.lit(0).cast("long"), "unlinked": F.array().cast("array<string>")}
        return messages.withColumns(bare).withColumn(text, _own(F.col(text)))
    wanted = quotes.select("conv", "hash").distinct()
    asked = shaped.join(quotes.select("conv").distinct(), "conv", "left_semi").withColumn("passages", passages_of(F.col("lines")))
    own = _units(asked, False, least_chars).join(wanted, ["conv", "hash"], "left_semi")
    origin = own.groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    found = quotes.join(origin, ["conv", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    found = materialize(found.select("conv", "turn", "level", "place", "origin", "passage"), "found")
    votes = found.filter("origin is not null").groupBy("conv", "turn", "level", "origin").agg(F.count("*").alias("n"))
    links = votes.groupBy("conv", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), "n", "origin")).alias("reply_to"))
    links = materialize(links, "links")
    counts = found.filter("place >= 0").groupBy("conv", "turn").agg(
        F.count("*").alias("n_quotes"),
        F.count("origin").alias("n_linked"),
        F.array_sort(F.collect_list(F.when(F.col("origin").isNull(), F.struct("place", "passage")))).alias("u"),
    )
    facts = counts.join(links, ["conv", "turn"], "left").join(_chains(links), ["conv", "turn"], "left")
    facts = facts.select(F.col("conv").alias("__c"), F.col("turn").alias("__n"), *[F.col(c).alias(f"__{c}") for c in ("reply_to", "root", "depth", "n_quotes", "n_linked", "u")])
    out = messages.join(materialize(facts, "facts"), (F.col(conv) == F.col("__c")) & (F.col(turn) == F.col("__n")), "left")
    zero = F.lit(0).cast("long")
    added = {
        "reply_to": F.col("__reply_to"), "thread": F.coalesce("__root", turn), "depth": F.coalesce("__depth", F.lit(0)), "n_quotes": F.coalesce("__n_quotes", zero), "n_linked": F.coalesce("__n_linked", zero),
        "unlinked": F.coalesce(F.transform("__u", lambda x: x["passage"]), F.array().cast("array<string>")), text: _own(F.col(text)),
    }
    return out.withColumns(added).select(*messages.columns, *[c for c in added if c not in messages.columns])


def conversations(linked: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """linked (of link_quotes) in reply order, with chat: the message as its role's turn, and opens: it begins a thread.

    Rows are sorted by conversation, thread and turn over all partitions by range, so a conversation's rows stand together in
    reply order and one of any length is never collected. Null roles are "user", null texts are empty turns.
    """
    mark = F.concat(F.lit("<|"), F.coalesce(F.col(role), F.lit("user")), F.lit("|>\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    return linked.withColumns({"chat": mark, "opens": F.col("thread").eqNullSafe(F.col(turn))}).orderBy(conv, "thread", turn)


def _own(text: Column) -> Column:
    """The text without quoted lines and the lines that announce them; white space at its ends goes where a quote was."""

    def kept(v: Column) -> Column:
        follows = lambda i: F.coalesce(F.get(v, i + 1)["level"] > 0, F.lit(False))
        stays = F.filter(v, lambda x, i: (x["level"] == 0) & ~(F.regexp_like(x["line"], F.lit(_ANNOUNCES)) & follows(i)))
        return F.regexp_replace(F.array_join(F.transform(stays, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")

    return F.when(F.regexp_like(guarded(text), F.lit(r"(?m)^[ \t]*>")), let(lines_of(text), kept)).otherwise(text)
