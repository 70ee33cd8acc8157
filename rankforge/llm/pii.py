"""Personal data by bootstrapped contextual extraction.

Seeds are what four fixed rules find (e-mail and IP addresses, payment card
and phone numbers).  The word in front of a seed is a lexical pattern.  All
other identifier-like tokens of the corpus are instances of the patterns in
front of them, and the graph of patterns and instances is scored in rounds:
a pattern by how many of its distinct instances are known (reliability times
the logarithm of the support), an instance by the patterns that found it
(one minus the product of their doubts).  Confident instances join the seeds
of the next round.  Tokens behind accepted patterns become `context` spans.

Everything is DataFrame expressions and joins.  Positions come from the
lengths of the matches and of the gaps between them, so they are code
points and each rule reads a text twice.  The rules are written without
backtracking into a run (possessive, anchored at the run's start or the end
of the last match), so long runs stay linear.

Null and empty texts have no spans; repeated rows are read row by row.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

KINDS = ("email", "ip", "card", "phone", "context")

_LOCAL = "A-Za-z0-9._%+-"
#: Rules as run-anchored Java patterns, and what a text must have to be worth the search.
RULES = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
              lambda t: t.contains("@")),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
    "card": (r"[0-9](?:[ -]?[0-9]){11,}+", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}")),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]")),
}
#: Identifier-like tokens: five digits and letters at least, one digit first or behind a short prefix.
CANDIDATE = r"(?<![A-Za-z0-9])[A-Za-z]{0,6}+[-#/]?[0-9](?:[-/.]?[A-Za-z0-9]){4,}+"

_SPAN = "struct<start:int,stop:int,value:string,before:string>"


def _located(text: Column, pattern: str, worth: Column) -> Column:
    """array of (start, stop, value, the 60 characters before) of all matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found,
                       lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("size"),
                                               m.alias("value"), F.right(gap, F.lit(60)).alias("before")))
    walk = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + p["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["size"]).alias("stop"),
                p["value"].alias("value"), p["before"].alias("before")))).alias("out")),
        lambda acc: acc["out"])
    return F.when(worth, walk).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).cast("int"))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


#: What a match must satisfy beyond the pattern.
_VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s["value"], r"\."), lambda p: _small(F.regexp_replace(p, "^0+", ""))),
    "card": lambda s: F.char_length(_digits(s["value"])).between(12, 19) & luhn(_digits(s["value"])),
    "phone": lambda s: F.char_length(_digits(s["value"])).between(9, 15),
}


def _small(digits: Column) -> Column:
    return (F.char_length(digits) <= 3) & (F.when(digits == "", 0).otherwise(digits.cast("int")) <= 255)


def base_matches(text: Column, kind: str) -> Column:
    pattern, worth = RULES[kind]
    return F.filter(_located(text, pattern, worth(text)), _VALID[kind])


def _ranked(kind: str):
    rank = KINDS.index(kind)
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                              s["stop"].alias("stop"), s["value"].alias("value"), s["before"].alias("before"))


def _pattern(before: Column) -> Column:
    """The nearest word with a letter in front and the punctuation behind it
    (blanks out), lower case; null if the line has none."""
    near = F.regexp_extract(before, r"([^\s\p{L}]{0,20}+\p{L}[^\s\p{L}]{0,20}+(?:\p{L}[^\s\p{L}]{0,20}+){0,39}+(?:[ \t]++[^\s\p{L}]++){0,3}+)[ \t]*+$", 1)
    word = F.lower(F.regexp_replace(near, r"[ \t]", ""))
    return F.when(word != "", word)


def read(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, base spans, candidate tokens that touch no base span)."""
    t = text_or_empty(text)
    base = F.concat(*[F.transform(base_matches(F.col("t"), k), _ranked(k)) for k in RULES])
    loose = _located(F.col("t"), CANDIDATE, F.col("t").rlike("[0-9]"))
    free = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    return (df.select(F.col(key).alias("key"), t.alias("t"))
            .withColumn("base", F.array_sort(base)).withColumn("loose", loose)
            .select(F.monotonically_increasing_id().alias("row"), "key", "base", free.alias("free")))


def score_graph(edges: DataFrame, rounds: int | None, support: int, reliable: float, sure: float) -> DataFrame:
    """Accepted (pattern, instance) edges.

    ``edges``: distinct pattern, instance, seed (whether a rule found the
    instance).  A pattern is accepted with ``support`` known instances and a
    share of known ones of at least ``reliable``; an unseen instance when the
    patterns that found it leave a doubt below 1 - ``sure``.  Ends when no
    instance is added, or after ``rounds``.
    """
    known = stored(edges.groupBy("instance").agg(F.max("seed").alias("seed")).filter("seed").select("instance"), "known")
    for turn in count(1):
        marked = edges.join(known.withColumn("known", F.lit(1)), "instance", "left")
        patterns = (marked.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.coalesce("known", F.lit(0))).alias("k"))
                    .withColumn("trust", F.col("k") / F.col("n"))
                    .withColumn("score", F.col("trust") * F.log2(F.col("k") + 1))
                    .filter((F.col("k") >= support) & (F.col("trust") >= reliable)))
        patterns = stored(patterns.select("pattern", "trust", "score"), "patterns")
        doubt = (marked.filter("known is null").join(patterns, "pattern").groupBy("instance")
                 .agg(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))).alias("doubt"))
                 .filter(F.exp("doubt") <= 1 - sure).select("instance"))
        grown = stored(known.union(doubt).distinct(), "known")
        done = turn == rounds or grown.count() == known.count()
        known = grown
        if done:
            break
    return edges.join(patterns, "pattern").join(known, "instance", "left_semi").select("pattern", "instance", "score")


def find(df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int | None = None, support: int = 3,
         reliable: float = 0.5, sure: float = 0.5) -> DataFrame:
    """key and spans (array<struct<kind, start, stop>> by start, then kind) of
    every row."""
    rows = stored(read(df, key, text), "pii")
    free = rows.select("row", F.explode("free").alias("s")).select(
        "row", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"),
        _pattern(F.col("s.before")).alias("pattern"), F.col("s.value").alias("instance")).filter("pattern is not null")
    seeds = rows.select(F.explode("base").alias("s")).select(
        _pattern(F.col("s.before")).alias("pattern"), F.col("s.value").alias("instance")).filter("pattern is not null")
    edges = (seeds.withColumn("seed", F.lit(True)).unionByName(free.select("pattern", "instance").withColumn("seed", F.lit(False)))
             .groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    accepted = score_graph(stored(edges, "edges"), rounds, support, reliable, sure)
    hits = (free.join(accepted, ["pattern", "instance"], "left_semi").groupBy("row")
            .agg(F.collect_list(F.struct("start", F.lit(KINDS.index("context")).alias("rank"), F.lit("context").alias("kind"),
                                         "stop")).alias("more")))  # tokens of one text
    slim = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"),
                                                  s["kind"].alias("kind"), s["stop"].alias("stop")))
    kind = "array<struct<start:int,rank:int,kind:string,stop:int>>"
    every = F.array_sort(F.concat(slim.cast(kind), F.coalesce(F.col("more").cast(kind), F.array().cast(kind))))
    return (rows.join(hits, "row", "left")
            .select(F.col("key").alias(key), F.transform(every, lambda s: F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans")))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [kind]; overlapping spans are
    masked once, under the kind of the first."""
    step = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(
                acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(text.isNotNull(), step)
