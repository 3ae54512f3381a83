"""Places of pattern matches in texts, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"


def find(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Array of (start, end, match) of the leftmost matches that don't overlap, in code points, end exclusive.

    The lengths of what lies between the matches give their places. guard is a cheap test that spares texts without any.
    """
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.slice(between, F.lit(1), F.size(hits)), lambda h, b: F.struct(h.alias("h"), b.alias("b")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["h"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["h"].alias("match"))).alias("out"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), SPAN).alias("out")), step, lambda acc: acc["out"])
    return found if guard is None else F.when(guard, found).otherwise(F.from_json(F.lit("[]"), SPAN))


def replaced(text: Column, spans: Column, by) -> Column:
    """text with each of the spans, in order and apart from one another, replaced by by(span)."""

    def step(acc: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), by(s)).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def joined(spans: Column) -> Column:
    """kind:start:end of an array of structs (start, kind order, kind, end), comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
