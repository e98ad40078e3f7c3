"""Secret scans with corpus-wide ownership counts, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.text import let
from hindcast.operators.spread import broadcast_small
from hindcast.sources.shared import settle

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of these signs is always matched whole, so a lower bound on its length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
MIN_VALUE = 8
# An opaque string needs a letter, a digit and this many different signs.
MIN_DISTINCT = 10
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 50
# Spans of a text that are handled together.
BLOCK = 256
MASK = "[SECRET]"
_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"


def _in_steps(n: Column, start: Column, none: Column, item: Callable[[Column, Column], Column]) -> Column:
    """``out`` of a running state over 0 to n - 1, in blocks.

    ``item(at, i)`` gives the next ``at`` and an element. An array that grows by one element a
    step is copied each time, so elements are gathered in blocks of ``BLOCK`` and then the blocks.
    """

    def inside(at: Column, k: Column) -> Column:
        def step(done: Column, i: Column) -> Column:
            return let(item(done["at"], i), lambda new: F.struct(new["at"].alias("at"), F.concat(done["out"], F.array(new["element"])).alias("out")))

        places = F.sequence(k * BLOCK, F.least(n, (k + 1) * BLOCK) - 1)
        return F.aggregate(places, F.struct(at.alias("at"), none.alias("out")), step)

    def block(done: Column, k: Column) -> Column:
        return let(inside(done["at"], k), lambda new: F.struct(new["at"].alias("at"), F.concat(done["out"], F.array(new["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int"))
    empty = F.slice(F.array(none), 1, 0)
    whole = F.aggregate(blocks, F.struct(start.alias("at"), empty.alias("out")), block)
    return F.when(n > 0, let(whole, lambda w: F.struct(w["at"].alias("at"), F.flatten(w["out"]).alias("out")))).otherwise(
        F.struct(start.alias("at"), none.alias("out"))
    )


def _spans(text: Column, pattern: str, kind_no: int, kind: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches with code-point offsets (0-based, end exclusive).

    A match starts after all that splitting by the pattern leaves before it and after the
    matches before it. The expressions run once for each text, however many matches it has.
    """
    none = F.array().cast(_SPAN)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches

    def located(held: Column) -> Column:
        def span(at: Column, i: Column) -> Column:
            begin = at + F.char_length(F.get(held["parts"], i))
            return let(begin, lambda start: let(start + F.char_length(F.get(held["matches"], i)), lambda end: F.struct(
                end.alias("at"),
                F.struct(
                    start.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"),
                    F.lit(kind).alias("kind"), F.get(held["values"], i).alias("value"),
                ).alias("element"),
            )))

        return _in_steps(F.size(held["matches"]), F.lit(0), none, span)["out"]

    held = F.struct(matches.alias("matches"), values.alias("values"), F.split(text, pattern, -1).alias("parts"))
    return F.when(F.rlike(text, F.lit(pattern)), let(held, located)).otherwise(none)


def _base(text: Column) -> list[Column]:
    """Spans of the fixed kinds, each kind in order."""
    low = F.lower(text)
    named = F.contains(low, F.lit(KEYWORDS[0]))
    for word in KEYWORDS[1:]:
        named = named | F.contains(low, F.lit(word))
    assign = F.filter(_spans(text, ASSIGN, 0, "assign", 2), lambda s: F.char_length(s["value"]) >= MIN_VALUE)
    none = F.array().cast(_SPAN)
    return [
        F.when(named, assign).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1, "access")).otherwise(none),
        _spans(text, HEX, 2, "hex"),
    ]


def _meets(spans: Column, s: Column) -> Column:
    """Whether ``s`` overlaps any of these spans, which are in order and apart from each other.

    Halves the places in question until it knows how many spans begin before the end of ``s``;
    the last one of these has the largest end.
    """

    def halve(done: Column, _: Column) -> Column:
        def tried(middle: Column) -> Column:
            before = F.get(spans, middle)["start"] < s["end"]
            open_ = done["low"] < done["high"]
            return F.struct(
                F.when(open_ & before, middle + 1).otherwise(done["low"]).alias("low"),
                F.when(open_ & ~before, middle).otherwise(done["high"]).alias("high"),
            )

        return let(F.shiftright(done["low"] + done["high"], 1), tried)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1.0))).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    return F.aggregate(rounds, start, halve, lambda done: F.coalesce(F.get(spans, done["low"] - 1)["end"] > s["start"], F.lit(False)))


def _opaque(text: Column, *base: Column) -> Column:
    """Opaque strings outside the base spans."""

    def odd(s: Column) -> Column:
        value = s["value"]
        varied = F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT
        apart = ~reduce(lambda a, b: a | b, [(F.size(spans) > 0) & _meets(spans, s) for spans in base])
        return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & varied & apart

    return F.filter(_spans(text, OPAQUE, 3, "opaque"), odd)


def _named(spans: Column) -> Column:
    """``kind:start:end`` of the spans in order, comma-joined."""
    names = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(names, ",")


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """How widely each value is spread: ``value, n_owners, n_repos, verdict``.

    ``found`` has ``value, owner, repo`` for every occurrence. Occurrences are merged by value,
    owner and repository before they move, so a value in a third of all rows is no group of
    that size. ``example``: at ``example_owners`` owners or in ``example_repos`` repositories, or
    more; ``live``: else, at one owner only; ``shared``: else. A null owner or repository counts as one
    of its own.
    """
    pairs = found.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("value", "owner").agg(F.count("*").alias("n_repos"))
    values = owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos"))
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    verdict = F.when(copied, "example").when(F.col("n_owners") == 1, "live")
    return values.withColumn("verdict", verdict.otherwise("shared"))


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS,
    example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """Secrets in every text, one row for each input row.

    Returns ``doc_id, text_hash, base, added, n_live, n_shared, n_example``. ``base`` holds the
    spans of the fixed kinds (``assign``, ``access``, ``hex``). ``added`` holds opaque strings outside
    them that are no widely copied example: those of one owner, and those that a few share.
    ``n_live``, ``n_shared`` and ``n_example`` count the spans, base and opaque, whose value has
    that verdict of :func:`ownership`. Values are compared by SHA-256; none is returned. What a
    text holds is written to the shared folder once, without the text. Null and empty texts hold
    nothing; null ids, owners and repositories are values of their own; repeated rows stay repeated;
    other columns are not read. The work on a text grows with its length and its matches, also
    where it has very many.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    kinds = [c.alias(f"base{i}") for i, c in enumerate(_base(F.col("text")))]
    based = rows.select("*", *kinds)
    base = [F.col(f"base{i}") for i in range(len(kinds))]

    def hidden(spans: Column) -> Column:
        return F.transform(spans, lambda s: s.withField("value", F.sha2(s["value"], 256)))

    held = based.select(
        "doc_id", "owner", "repo", "text_hash", hidden(F.concat(*base)).alias("base"), hidden(_opaque(F.col("text"), *base)).alias("opaque")
    )
    held = settle(held, "secrets")
    found = held.select("doc_id", "owner", "repo", "text_hash", F.inline(F.concat("base", "opaque")))
    known = ownership(found.select("value", "owner", "repo"), example_owners, example_repos).select("value", "verdict")
    told = found.join(known, "value").groupBy("doc_id", "owner", "repo", "text_hash")
    live, opaque = F.col("verdict") != "example", F.col("kind") == "opaque"
    span = F.struct("start", "kind_no", "end", "kind", "verdict")
    told = told.agg(F.collect_set(span).alias("spans"), F.collect_set(F.when(live & opaque, F.struct("start", "kind_no", "end", "kind"))).alias("added"))
    told = told.select([F.col(c).alias(f"_{c}") for c in told.columns])
    same = F.lit(True)
    for c in ("doc_id", "owner", "repo", "text_hash"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))

    def count(verdict: str) -> Column:
        return F.coalesce(F.size(F.filter("_spans", lambda s: s["verdict"] == verdict)), F.lit(0)).cast("long")

    return held.join(told, same, "left").select(
        "doc_id",
        "text_hash",
        F.transform("base", lambda s: s.dropFields("value")).alias("base"),
        F.coalesce("_added", F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")).alias("added"),
        *[F.when(F.col("_spans").isNull(), F.lit(0).cast("long")).otherwise(count(v)).alias(f"n_{v}") for v in ("live", "shared", "example")],
    )


def scan_digest(scan: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the base spans and all spans as text, from :func:`secret_scan`."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
        _named(F.concat("base", "added")).alias("spans"),
        "n_live",
        "n_shared",
        "n_example",
    )


def mask_secrets(docs: DataFrame, scan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with base and added spans replaced by ``MASK``; spans that overlap by one.

    Rows with the same id and text (nulls are equal) get the same result. A text is cut into as
    many stretches as its spans need blocks, and only a stretch is searched for the place of a span. The
    spans are written and measured: while they are small, texts stay where they are.
    """
    own = [f"__{c}_of_spans" for c in ("id", "hash", "found")]
    found = F.array_sort(F.concat("base", "added"))
    spans = scan.select(F.col("doc_id").alias(own[0]), F.col("text_hash").alias(own[1]), found.alias(own[2]))
    spans = spans.filter(F.size(own[2]) > 0).groupBy(*own[:2]).agg(F.first(own[2]).alias(own[2]))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own[0])) & (F.xxhash64(F.col(text_col)) == F.col(own[1]))
    text = F.col(text_col)

    def masked(held: Column) -> Column:
        """The spans in blocks: each block's stretch of the text is cut out first, then its pieces."""

        def block(done: Column, k: Column) -> Column:
            first = k * BLOCK
            last = F.least(F.size(held), first + BLOCK) - 1
            # Up to the start of the next block's first span; overlaps are seen by ``at``.
            until = F.coalesce(F.get(held, last + 1)["start"], F.lit(2**31 - 1))

            def pieces(stretch: Column) -> Column:
                def step(state: Column, i: Column) -> Column:
                    def one(s: Column) -> Column:
                        fresh = s["start"] >= state["at"]
                        before = F.substring(stretch, state["at"] - done["at"] + 1, s["start"] - state["at"])
                        return F.struct(
                            F.greatest(state["at"], s["end"]).alias("at"),
                            F.when(fresh, F.concat(state["out"], F.array(before, F.lit(MASK)))).otherwise(state["out"]).alias("out"),
                        )

                    return let(F.get(held, i), one)

                start = F.struct(done["at"].alias("at"), F.array().cast("array<string>").alias("out"))

                def closed(state: Column) -> Column:
                    rest = F.when(until > state["at"], F.substring(stretch, state["at"] - done["at"] + 1, until - state["at"])).otherwise(F.lit(""))
                    return F.struct(
                        F.greatest(state["at"], until).alias("at"),
                        F.concat(done["out"], F.array(F.concat(F.array_join(state["out"], ""), rest))).alias("out"),
                    )

                return let(F.aggregate(F.sequence(first, last), start, step), closed)

            return let(F.substring(text, done["at"] + 1, F.greatest(until - done["at"], F.lit(0))), pieces)

        blocks = F.sequence(F.lit(0), ((F.size(held) - 1) / BLOCK).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(blocks, start, block, lambda done: F.array_join(done["out"], ""))

    new = F.when(F.col(own[2]).isNull(), text).otherwise(let(F.col(own[2]), masked))
    spans = broadcast_small(settle(spans, "spans"))
    return docs.join(spans, same, "left").select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])
