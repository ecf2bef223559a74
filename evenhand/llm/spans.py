"""Places of pattern matches in texts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def running(values: Column) -> Column:
    """Exclusive prefix sums of an array of integers (of the kind long).

    Sums are appended chunk by chunk, so that the cost stays in proportion to the length.
    """
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    zero = F.lit(0).cast("long")
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK)
    )
    sums = F.transform(chunks, lambda x: F.aggregate(x, zero, lambda s, y: s + y))
    starts = F.aggregate(sums, F.array(zero), add)
    # starts has one entry more than chunks; the last meets a null
    whole = F.zip_with(chunks, starts, lambda x, s: F.slice(F.aggregate(F.coalesce(x, F.array().cast("array<bigint>")), F.array(s), add), 1, F.coalesce(F.size(x), F.lit(0))))
    return F.when(F.size(values) > 0, F.flatten(whole)).otherwise(F.array().cast("array<bigint>"))


def found(text: Column, pattern: str, group: int = 0, hint: Column | None = None) -> Column:
    """array<struct<start, stop, text, part>> of a pattern's leftmost matches that do not overlap, in code points.

    ``part`` is the text of ``group``. ``hint`` is a cheaper condition that every text with a match fulfils; the
    pattern must match no empty text.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    between = F.split(text, pattern, -1)
    steps = F.zip_with(between, matches, lambda b, m: F.length(b).cast("long") + F.coalesce(F.length(m), F.lit(0)).cast("long"))
    # the sum before a step, and the text between, end where its match starts
    starts = F.zip_with(running(steps), between, lambda s, b: s + F.length(b))
    spans = F.zip_with(
        F.arrays_zip(matches.alias("m"), parts.alias("p")),
        F.slice(starts, 1, F.size(matches)),
        lambda x, s: F.struct(s.alias("start"), (s + F.length(x["m"])).alias("stop"), x["m"].alias("text"), x["p"].alias("part")),
    )
    any_match = text.rlike(pattern) if hint is None else hint & text.rlike(pattern)
    none = F.array().cast("array<struct<start:bigint,stop:bigint,text:string,part:string>>")
    return F.when(any_match, spans).otherwise(none)
