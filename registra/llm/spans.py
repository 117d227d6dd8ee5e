"""Positions of regular-expression matches as columns, without Python on the executors. All of it is linear in the
length of a text and in its number of matches, whatever these are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements of an array whose results are appended one by one; arrays of so many are then appended as a whole.
BLOCK = 256
#: Code points of a piece of text. Cutting out of a piece costs its length and not the distance from the text's begin.
PIECE = 1024


def running(items: Column, zero: Column, step: Callable, kind: str) -> Column:
    """struct<at, out>: at goes through step(at, item) -> (at, result) from `zero` on, out is the array of results
    (of SQL type `kind`). items is evaluated once."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc, x):
        at, result = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(result)).alias("out"))

    def over(xs):
        def block(acc, k):
            own = F.slice(xs, k * BLOCK + 1, F.lit(BLOCK))
            return F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), one, lambda s: F.struct(s["at"].alias("at"), F.concat(acc["out"], F.array(s["out"])).alias("out")))

        start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(xs) / BLOCK).cast("int") - 1))
        return F.aggregate(blocks, start, block, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out")))

    return F.transform(F.array(items), over)[0]


def matches(text: Column, pattern: str, gate: str | None = None, group: int = 0) -> Column:
    """Array of struct<start, end, hit>: leftmost non-overlapping matches in code points, end exclusive; hit is the
    match, or its group. The gaps between the matches give the positions. gate: a pattern that every text with a
    match of interest contains; other texts get an empty array at the price of one search."""
    kind = "struct<start:int,end:int,hit:string>"
    parts = [F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole")]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("hit"))

    def step(at, x):
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        return end, F.struct(start.alias("start"), end.alias("end"), x["hit" if group else "whole"].alias("hit"))

    # there is one gap more than matches: the text behind the last match, whose hit is null
    found = F.filter(running(F.arrays_zip(*parts), F.lit(0), step, kind)["out"], lambda x: x["hit"].isNotNull())
    return F.when(text.rlike(gate or pattern), found).otherwise(F.array().cast(f"array<{kind}>"))


def pieces(text: Column) -> Column:
    """The text cut into pieces of PIECE code points, for between()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive; what is beyond the text is left out) of the text that pieces() has cut."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    joined = F.array_join(F.slice(cut, first + 1, F.greatest(F.lit(0), last - first + 1)), "")
    return F.substring(joined, start - first * PIECE + 1, F.greatest(F.lit(0), end - start))


def numbered(found: Column, k: int, names: str = "skb") -> Column:
    """Array of struct<start, k, end> ordered by start ("skb") or struct<k, start, end> ordered by kind first ("ksb")."""

    def one(x):
        own = [x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")]
        return F.struct(*(own if names == "skb" else [own[1], own[0], own[2]]))

    return F.transform(found, one)


def text_of(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined, in the array's order."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"], x["end"])), ",")


def apart(parts: DataFrame, base: Column) -> DataFrame:
    """parts (key, start, end, ...) without the rows that are not base and overlap a base row of their key."""
    up = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("key").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marked = parts.withColumn("__open", F.max(F.when(base, F.col("end"))).over(up)).withColumn("__next", F.min(F.when(base, F.col("start"))).over(down))
    clear = F.coalesce(F.col("__open") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("__next") >= F.col("end"), F.lit(True))
    return marked.where(base | clear).drop("__open", "__next")
