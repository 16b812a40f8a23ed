"""Snippets of symbols as expressions over arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import classify as C
from cairn.functions.text import truncate_words


def lines_of(text: Column) -> Column:
    """Lines without a last empty one, as Python counts them."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, "\n$", ""), "\n"))


def body(lines: Column, start: Column, end: Column) -> Column:
    """EXT-14: lines ``start`` to ``end``, counted from 1."""
    first = F.greatest(start, F.lit(1))
    return F.slice(lines, first, F.greatest(end - first + 1, F.lit(0)))


def active_mask(lines: Column, kws: Column) -> Column:
    """WN-06: active lines and their neighbours."""
    n = F.size(lines)
    own = F.transform(lines, lambda x, i: C.is_active_line(i, n, x, kws))
    at = lambda i: F.coalesce(F.get(own, i), F.lit(False))
    return F.transform(own, lambda x, i: x | at(i - 1) | at(i + 1))


def slice_lines(lines: Column, kws: Column, short: int = 20, gap: int = 4, marker: Column | None = None) -> Column:
    """WN-07: in bodies of over ``short`` lines each inactive run of over ``gap`` lines becomes one marker at its first line's indentation."""
    mask = active_mask(lines, kws)
    mark = F.lit("#") if marker is None else marker
    pairs = F.arrays_zip(lines.alias("line"), mask.alias("on"))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), empty.alias("run"))

    def close(acc: Column) -> Column:
        indent = F.regexp_extract(F.coalesce(F.get(acc["run"], 0), F.lit("")), r"^(\s*)", 1)
        note = F.concat(indent, mark, F.lit(" ... "), F.size(acc["run"]).cast("string"), F.lit(" lines"))
        return F.concat(acc["out"], F.when(F.size(acc["run"]) > gap, F.array(note)).otherwise(acc["run"]))

    def step(acc: Column, p: Column) -> Column:
        on = F.struct(F.concat(close(acc), F.array(p["line"])).alias("out"), empty.alias("run"))
        off = F.struct(acc["out"].alias("out"), F.concat(acc["run"], F.array(p["line"])).alias("run"))
        return F.when(p["on"], on).otherwise(off)

    return F.when(F.size(lines) <= short, lines).otherwise(F.aggregate(pairs, start, step, close))


def best_window(lines: Column, kws: Column, before: int = 5, after: int = 15, words: int = 80) -> Column:
    """WN-08: the lines around the first line with most keywords, cut to so many words."""
    hits = F.transform(lines, lambda x, i: F.struct(F.size(F.filter(kws, lambda k: F.contains(F.lower(x), F.lower(k)))).alias("n"), (-i).alias("i")))
    at = -F.array_max(hits)["i"]
    first = F.greatest(at - before, F.lit(0))
    part = F.slice(lines, first + 1, at + after + 1 - first)
    return F.when(F.size(lines) > 0, truncate_words(F.array_join(part, "\n"), words)).otherwise("")


def contextual(lines: Column, signature: Column, tier: Column, kws: Column) -> Column:
    """FN-18: support: the signature; workflow: the best window; critical: the sliced body of at most 150 words; else 80 lines."""
    return (
        F.when(tier == "support", signature)
        .when(tier == "workflow", best_window(lines, kws))
        .when(tier == "critical", truncate_words(F.array_join(slice_lines(lines, kws), "\n"), 150))
        .otherwise(F.array_join(F.slice(lines, 1, 80), "\n"))
    )


def mask_rows(lines: DataFrame, by: list[str], kws: Column) -> DataFrame:
    """WN-06 over rows ``line, text`` for texts too long for an array: the neighbours by lag and lead."""
    w = Window.partitionBy(*by).orderBy("line")
    n = F.count("*").over(Window.partitionBy(*by))
    own = lines.withColumn("own", C.is_active_line(F.col("line") - 1, n, F.col("text"), kws))
    near = lambda c: F.coalesce(c, F.lit(False))
    return own.withColumn("active", F.col("own") | near(F.lag("own").over(w)) | near(F.lead("own").over(w))).drop("own")
