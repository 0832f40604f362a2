"""JSON texts of any shape as Columns, without a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import identity

# The fields that hold a source's address.
URL_FIELDS = ("finalUrl", "sourceUrl", "transparencyStatementUrl", "url", "website")
# End of fixed values.


def stable(json: Column) -> Column:
    """The text with the keys of every object in order and no white space between; null where it isn't JSON.

    A VARIANT keeps its objects' fields sorted, so reading the text as one and writing it sorts at every depth. Nulls stay.
    Numbers are written in one form; an object that repeats a key isn't read.
    """
    return F.to_json(F.try_parse_json(json), {"ignoreNullFields": "false"})


def revision(json: Column) -> Column:
    """SHA-256 of the stable text: equal for records that differ in the order of their keys only."""
    return F.sha2(stable(json), 256)


def rewritten(json: Column, fields: Sequence[str] = URL_FIELDS) -> Column:
    """The text with the addresses in ``fields``, at any depth, in canonical form, and else byte for byte the same.

    A quote inside a JSON string has a backslash before it, so what follows a brace, a comma or white space and is in
    quotes before a colon is a key and nothing else. Addresses that aren't http, or aren't URLs, stay.
    """
    names = "|".join(fields)
    pair = rf'(?<=[{{,\s])"(?:{names})"\s*+:\s*+"http[^"\\]*+(?:\\.[^"\\]*+)*+"'
    found = F.regexp_extract_all(json, F.lit(pair), F.lit(0))
    between = F.split(json, pair, -1)

    def canonical(whole: Column) -> Column:
        key = F.regexp_extract(whole, r'^"[^"]*"\s*:\s*', 0)
        quoted = F.substr(whole, F.char_length(key) + 1)
        url = F.get(F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), "array<string>"), 0)
        made = identity(url)
        written = F.to_json(F.array(made))
        return F.when(made == url, whole).otherwise(F.concat(key, F.substr(written, F.lit(2), F.char_length(written) - 2)))

    parts = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(canonical(b), b, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(json)


def rekeyed(entries: DataFrame, key: str, made: Column) -> DataFrame:
    """entries under their canonical keys, with ``collides``: another entry has come to the same key."""
    moved = entries.withColumn("_made", F.coalesce(made, F.col(key)))
    many = moved.groupBy("_made").agg((F.count("*") > 1).alias("collides"))
    return moved.join(many, "_made").withColumn(key, F.col("_made")).drop("_made")


def balanced(text: Column) -> Column:
    """The first object or array of a text up to the bracket that closes it; null if none is closed, or is closed by the
    other kind of bracket. Brackets inside strings don't count.

    The text from its first bracket on is cut into escapes, quotes, brackets and what lies between, and folded once.
    """
    rest = F.regexp_extract(text, r"(?s)[\[{].*", 0)
    parts = F.regexp_extract_all(rest, F.lit(r'(?s)\\.|["\[\]{}\\]|[^"\[\]{}\\]+'), F.lit(0))
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, part: Column) -> Column:
        # outside a string a backslash means nothing, so the character after it counts
        char = F.when(s["quoted"], part).otherwise(F.right(part, F.lit(1)))
        at = s["at"] + F.char_length(part)
        opens = ~s["quoted"] & char.isin("{", "[")
        closes = ~s["quoted"] & char.isin("}", "]")
        fits = F.left(s["open"], F.lit(1)) == char
        stack = F.when(opens, F.concat(F.when(char == "{", "}").otherwise("]"), s["open"])).when(closes & fits, F.substr(s["open"], F.lit(2))).otherwise(s["open"])
        end = F.when(closes & ~fits, -1).when(closes & (F.char_length(s["open"]) == 1), at).otherwise(0)
        quoted = F.when(char == '"', ~s["quoted"]).otherwise(s["quoted"])
        moved = F.struct(stack.alias("open"), quoted.alias("quoted"), at.alias("at"), end.alias("end"))
        return F.when(s["end"] != 0, s).otherwise(moved)

    end = F.aggregate(parts, start, step, lambda s: s["end"])
    return F.when(end > 0, F.left(rest, end))


def reply(text: Column) -> Column:
    """The JSON of a reply: the whole of it, what stands in a code fence, or its first balanced value; null if none parses."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    fenced = F.nullif(F.regexp_extract(bare, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1), F.lit(""))
    parses = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(parses(bare), parses(fenced), parses(balanced(bare)))
