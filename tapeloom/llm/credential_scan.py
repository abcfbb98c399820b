"""Secret scans that tell copied examples from live credentials by who holds them.

Patterns find candidate spans in every text. A candidate's secret is hashed, and
the hashes of the whole corpus are counted by distinct repositories and distinct
owners: what many owners hold is an example that was copied, what one or a few
hold looks live. Everything is built-in functions on DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import materialize


def either_case(word: str) -> str:
    """A pattern for a word in ASCII letters of either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The three kinds of spans, in their order.
NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # a match that is too short holds none that is long enough: 20 characters in all
HEX = "[0-9a-f]{24,}"  # as before
KINDS = ("assign", "access", "hex", "live", "example")
SHORTEST_VALUE = 6
#: A secret of more distinct owners than this is a copied example; so is one of more distinct repositories.
LIVE_OWNERS = 2
LIVE_REPOSITORIES = 4
#: Numbers summed by appending to an array, which copies it.
BLOCK = 64


def named(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ends_before(lengths: Column, levels: int = 2) -> Column:
    """For each number of an array the sum of those before it.

    Appending to an array copies it, so the array is summed in blocks: the sums of the
    blocks, one level up, tell where each block begins. With two levels no array beyond
    BLOCK numbers is appended to until there are BLOCK cubed of them, and the work stays in
    proportion to the length.
    """
    def add(state: Column, x: Column) -> Column:
        return F.struct((state["at"] + x).alias("at"), F.concat(state["found"], F.array(state["at"])).alias("found"))

    def within(numbers: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("found"))
        return F.aggregate(numbers, first, add, lambda state: state["found"])

    if not levels:
        return within(lengths, F.lit(0))

    def blocks(whole: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(whole, i, BLOCK))

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda sum_, x: sum_ + x)

    return named(named(lengths, blocks), lambda cut: F.flatten(
        F.zip_with(cut, ends_before(F.transform(cut, total), levels - 1), within)))


def spans(text: Column, pattern: str, group: int, order: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end, secret): code points, end exclusive.

    The parts between matches and the matches alternate, so their lengths sum to the
    places. The secret, `group` of the pattern, is the end of the match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secrets = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    both = F.zip_with(matches, secrets, lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), both, lambda gap, x: F.struct(
        F.length(gap).alias("gap"), F.length(x["m"]).alias("size"), x["s"].alias("secret")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,secret:string>>")

    def placed(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.struct(
            start.alias("start"), F.lit(order).alias("kind"), (start + x["size"]).alias("end"), x["secret"].alias("secret"))

    every = named(steps, lambda s: F.zip_with(ends_before(F.transform(s, lambda x: x["gap"] + x["size"])), s, placed))
    return F.when(F.rlike(text, F.lit(pattern)), every).otherwise(none)


def joined(listed: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(listed, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source",
         repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Per row of `docs`: key, n_assign, n_access, n_hex, n_live, n_example, base_sha256, spans.

    `owner` and `repository` name the columns that tell owners and their repositories
    apart; null is a value like any other. Base spans are those of the patterns. Each of
    them adds a span of kind live or example over its secret, by the owners and
    repositories that hold the same secret. A null text is empty and has no spans; a very
    long text is read whole, in time proportional to its length and its matches; rows
    that repeat are scanned each and held by the same owner; an empty table gives an
    empty table; other columns are not read.

    The text is read once. Its spans, one short row per document, are written out, and
    hashes are counted after a reduction to one row per hash, owner and repository, so a
    secret that a third of all rows hold is a few rows per task.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    assigned = F.filter(spans(whole, ASSIGN, 2, 0), lambda x: F.length(x["secret"]) >= SHORTEST_VALUE)
    base = F.array_sort(F.concat(assigned, spans(whole, ACCESS, 0, 1), spans(whole, HEX, 0, 2)))
    hashed = F.transform(base, lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"),
        (x["end"] - F.length(x["secret"])).alias("from"), F.sha2(x["secret"], 256).alias("hash")))
    rows = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        F.coalesce(F.sha2(F.col(owner).cast("string"), 256), F.lit("")).alias("owner"),
        F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in repository]).alias("repository"),
        hashed.alias("base"),
    ), "spans")
    held = rows.select("row", "owner", "repository", F.explode("base").alias("x")).select("*", F.col("x.hash").alias("hash"))
    ownership = (
        held.select("hash", "owner", "repository").distinct()
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    )
    live = (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES)
    added = held.join(ownership, "hash").select("row", F.struct(
        F.col("x.from").alias("start"), F.when(live, 3).otherwise(4).alias("kind"), F.col("x.end").alias("end")).alias("x"))
    added = added.groupBy("row").agg(F.collect_list("x").alias("added"))  # a row's own spans
    listed = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    everything = F.array_sort(F.concat(listed, F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))

    def number(kind: int) -> Column:
        return F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return rows.join(added, "row", "left").select("key", "base", everything.alias("all")).select(
        F.col("key").alias(key), *map(number, range(len(KINDS))),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
