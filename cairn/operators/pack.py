"""Packing selected rows into text under a token budget: compact, JSON, XML and Markdown, and layered payloads.

Three folds that look alike and are not: JSON stops at the first block that does not fit, compact
stops the current tier there, XML and Markdown try a full block, then a reference, then go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import short_id, xml_escape
from cairn.operators.fold import number, stream_fold, text
from cairn.operators.select import TIER_WEIGHT, tier_number

SHORT_TIER = {"critical": "crt", "workflow": "wkf", "support": "sup"}
MARKS = (("called_by", "<"), ("calls", ">"), ("imports", "+"), ("dep_called_by", "<<"), ("dep_calls", ">>"))


def compact_block(code: Column | None = None) -> Column:
    """FMT-02: ``!id|tier|kind|role|confidence``, a line for each relation, the signature (120 characters) and the code (80 lines)."""
    head = F.concat(F.lit("!"), short_id("id"), F.lit("|"), F.substring("tier", 1, 3), F.lit("|"), F.substring("kind", 1, 4), F.lit("|"), F.substring("role", 1, 4), F.lit("|"), F.round(F.coalesce("confidence", F.lit(0.0)), 2).cast("string"))
    marked = lambda mark: lambda r: F.concat(F.lit(f"  {mark} "), _short(r))
    rel = [F.array_join(F.transform(F.col(f"relations.{name}"), marked(mark)), "\n") for name, mark in MARKS]
    sig = F.substring(F.trim(F.replace(F.coalesce("signature", F.lit("")), F.lit("\n"), F.lit(" "))), 1, 120)
    parts = [head, *[F.nullif(r, F.lit("")) for r in rel], F.when(sig != "", F.concat(F.lit("  sig: "), sig))]
    if code is not None:
        lines = F.slice(F.split(code, "\n"), 1, 80)
        parts.append(F.when(code != "", F.concat(F.lit("  code:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), x)), "\n"))))
    return F.concat_ws("\n", *parts)


def _short(r: Column) -> Column:
    file = F.element_at(F.split(F.substring_index(r, "::", 1), "/"), -1)
    return F.when(F.contains(r, F.lit("::")), F.concat(file, F.lit("::"), F.substring_index(r, "::", -1))).otherwise(r)


def json_block(columns: list[str]) -> Column:
    """FMT-01 as JSON of the columns kept (PRJ-11)."""
    return F.to_json(F.struct(*columns))


def xml_block(code: Column) -> Column:
    """FMT-01 as XML: attributes, relevance, signature, code in CDATA."""
    at = lambda name, value: F.concat(F.lit(f' {name}="'), xml_escape(value), F.lit('"'))
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    head = F.concat(F.lit("  <sym"), *[at(k, c(v)) for k, v in (("id", "id"), ("tier", "tier"), ("kind", "kind"), ("role", "role"), ("exported", "exported"), ("file", "file"), ("line", "start_line"), ("confidence", "confidence"), ("label", "confidence_label"))], F.lit(">"))
    return F.concat_ws("\n", head, F.concat(F.lit("    <relevance>"), xml_escape(c("summary")), F.lit("</relevance>")), F.concat(F.lit("    <sig>"), xml_escape(c("signature")), F.lit("</sig>")), F.concat(F.lit("    <code><![CDATA[\n"), code, F.lit("\n]]></code>")), F.lit("  </sym>"))


def markdown_block(code: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("### "), F.col("id"), F.lit(" ("), F.col("tier"), F.lit(")")), F.concat(F.lit("`"), F.col("signature"), F.lit("`")), F.lit("```"), code, F.lit("```"))


def prefix_fit(rows: DataFrame, by: list[str], order: list[Column], most: int, cost: str = "cost") -> DataFrame:
    """FMT-04 and FMT-08: rows up to the first that overflows the budget. Here a running sum is right."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).filter(F.col("used") <= most)


def tier_fit(rows: DataFrame, by: list[str], order: list[Column], most: int, cost: str = "cost") -> DataFrame:
    """FMT-03: tiers in order; the first block that does not fit ends its tier, the next tier goes on. Adds ``included, used``."""
    tier_first = [tier_number(F.col("tier"), TIER_WEIGHT).desc(), *order]

    def step(state: list, tier: str, price: int) -> tuple[bool, int]:
        fits = state[1] != tier and state[0] + price <= most
        state[0] += price if fits else 0
        state[1] = state[1] if fits else tier
        return fits, state[0]

    return stream_fold(rows, by, tier_first, [text("tier"), number(F.col(cost))], lambda: [0, None], step, "included boolean, used long")


def three_way_fit(rows: DataFrame, by: list[str], order: list[Column], most: int, full: str = "cost", reference: str = "ref_cost") -> DataFrame:
    """FMT-05 and FMT-07: the full block if it fits, else its reference, else nothing, and on. Support rows are references at once. Adds ``form, used``."""
    tier_first = [tier_number(F.col("tier"), TIER_WEIGHT).desc(), *order]

    def step(state: list, tier: str, whole: int, short: int) -> tuple[str, int]:
        form = "full" if tier != "support" and state[0] + whole <= most else "reference" if state[0] + short <= most else "omitted"
        state[0] += {"full": whole, "reference": short, "omitted": 0}[form]
        return form, state[0]

    return stream_fold(rows, by, tier_first, [text("tier"), number(F.col(full)), number(F.col(reference))], lambda: [0], step, "form string, used long")


def document(rows: DataFrame, block: Column, by: list[str], order: list[Column], header: str = "", sep: str = "\n") -> DataFrame:
    """The blocks of each group in order under a header, as one text; bounded by the budget that chose the rows."""
    numbered = rows.withColumn("doc_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("doc_block", block)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_no", "doc_block"))), lambda x: x["doc_block"]), sep)
    return numbered.groupBy(*by).agg(F.concat(F.lit(header), text).alias("text"))


def layers(rows: DataFrame, by: list[str], order_col: str) -> DataFrame:
    """TK-12: ids of each tier in order."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct(order_col, "id"))), lambda x: x["id"])
    return rows.groupBy(*by, "tier").agg(ids.alias("ids"))


def expansion_plan(rows: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """TK-05: what to open next: rows not included first, then tier, score and value; rows in full and support rows without score are skipped."""
    useful = rows.filter((F.col("form") != "full") & ~((F.col("tier") == "support") & (F.col("score") <= 0)))
    w = Window.partitionBy(*by).orderBy((F.col("form") == "omitted").desc(), tier_number(F.col("tier"), TIER_WEIGHT).desc(), F.col("score").desc(), F.col("value").desc(), "id")
    return useful.withColumn("plan_no", F.row_number().over(w)).filter(F.col("plan_no") <= most)


def compact_graph(files: DataFrame, chars: int = 60) -> DataFrame:
    """SNK-10: symbols become their number, summaries are clipped."""
    s = F.coalesce("summary", F.lit(""))
    return files.withColumns({"symbols": F.size("symbols"), "summary": F.when(F.length(s) > chars, F.concat(F.substring(s, 1, chars), F.lit("..."))).otherwise(s)})
