"""Choosing rows for a task: diversity, admission per file, greedy budget, caps, confidence, relations.

What depends on the rows before it is a streamed fold (``fold``); all else are windows, joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import classify as C
from cairn.functions.text import dirname, extension, stem
from cairn.operators.fold import number, stream_fold
from cairn.operators.rollup import test_candidates
from cairn.operators.score import neighbor_score

SEEDS = 40
TIER_WEIGHT = {"critical": 3, "workflow": 2, "support": 1}
TIER_LIMIT = {"critical": 3, "workflow": 2, "support": 1}


def tier_number(tier: Column, table: dict[str, int]) -> Column:
    out = F.when(F.lit(False), 0)
    for k, v in table.items():
        out = out.when(tier == k, F.lit(v))
    return out.otherwise(0)


def mmr(scored: DataFrame, by: list[str], keep: int = SEEDS, decay: float = 0.7) -> DataFrame:
    """WN-01: the k-th row of a file counts ``decay ** k`` of its score; the best ``keep`` of each task stay. Columns: final, task_score, id, file."""
    order = [F.col("final").desc(), F.col("task_score").desc(), F.col("id").desc()]
    place = F.row_number().over(Window.partitionBy(*by, "file").orderBy(*order)) - 1
    rows = scored.withColumn("mmr", F.round(F.col("final") * F.pow(F.lit(decay), place), 6))
    w = Window.partitionBy(*by).orderBy(F.col("mmr").desc(), *order)
    return rows.withColumn("seed_no", F.row_number().over(w)).filter(F.col("seed_no") <= keep)


def greedy_budget(rows: DataFrame, by: list[str], budget: int, order: list[Column], cost: str = "cost") -> DataFrame:
    """WN-05: walk the rows in order, take each that still fits, skip the others and go on. Adds ``taken`` and ``used`` (after the row).

    A running sum would be wrong: a skipped row leaves its room to later ones."""

    def step(state: list, price: int | None) -> tuple[int, bool]:
        fits = price is not None and state[0] + price <= budget
        state[0] += price if fits else 0
        return state[0], fits

    return stream_fold(rows, by, order, [number(F.col(cost))], lambda: [0], step, "used long, taken boolean")


def file_cap(rows: DataFrame, by: list[str], order: list[Column], tier: str = "tier", file: str = "file") -> DataFrame:
    """WN-02: one counter per file, but the limit is that of the row's own tier, so admission depends on the order. Adds ``admitted``."""

    def step(state: list, most: int) -> tuple[bool]:
        ok = state[0] < most
        state[0] += ok
        return (ok,)

    return stream_fold(rows, [*by, file], order, [tier_number(F.col(tier), TIER_LIMIT)], lambda: [0], step, "admitted boolean")


def confidence(rows: DataFrame, by: list[str], order: list[Column], low: Column, high: Column, score: str = "score") -> DataFrame:
    """WN-03: 0.55 of the score's place between the candidates' extremes and 0.45 of the row's place in the order."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(*order)) - 1
    scaled = F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0)
    blend = F.round(0.55 * scaled + 0.45 * (1 - place / F.count("*").over(w)), 4)
    return rows.withColumn("confidence", blend).withColumn("confidence_label", C.confidence_label(F.col("confidence")))


def cap_tests(rows: DataFrame, by: list[str], is_test: Column, score: str = "score", share: float = 0.3) -> DataFrame:
    """WN-04: where over ``share`` of a task's rows are tests, only the best of them stay: that share of all rows, one at least."""
    w = Window.partitionBy(*by)
    rows = rows.withColumns({"_test": is_test, "_n": F.count("*").over(w)})
    rows = rows.withColumn("_k", F.sum(F.col("_test").cast("int")).over(w))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_test").orderBy(F.col(score).desc(), F.col("id"))))
    allowed = F.greatest(F.lit(1), F.floor(share * F.col("_n")))
    return rows.filter(~F.col("_test") | (F.col("_k") <= share * F.col("_n")) | (F.col("_r") <= allowed)).drop("_test", "_n", "_k", "_r")


# What a role is called, and words that name a domain.
ROLE_LABELS = {"entry_point": "entry point", "api_surface": "highly consumed API", "hub": "structural hub", "leaf": "leaf node", "utility": "internal utility"}
DOMAIN_WORDS = tuple("auth authentication login payment email search cache order".split())


def relevance_summary(overlap: Column, role: Column, exported: Column, reasons: Column) -> Column:
    """PRJ-15: the first five keywords, the role, whether it is exported, and why it was chosen."""
    named = role
    for k, v in ROLE_LABELS.items():
        named = F.when(role == k, v).otherwise(named)
    parts = F.concat_ws(
        " | ",
        F.when(F.size(overlap) > 0, F.concat(F.lit("keywords: "), F.array_join(F.slice(overlap, 1, 5), ", "))),
        F.when(F.coalesce(role, F.lit("")) != "", F.concat(F.lit("role: "), named)),
        F.when(exported, "exported (public API)"),
        F.when(F.size(reasons) > 0, F.concat(F.lit("selected as: "), F.array_join(reasons, ", "))),
    )
    return F.when(parts == "", "structural match").otherwise(parts)


def strongest(rows: DataFrame) -> DataFrame:
    """``id, score, reasons`` with one row an id: its largest score and all its reasons."""
    return rows.groupBy("id").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))


def neighbors(seeds: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """JN-16 in full: callers and callees one and two steps away, and neighbours over other edges (0.35 of the seed's score inwards, 0.30
    outwards, by ``neighbor_score``). One step away only rows that pass the ``gate`` join. ``known(id, task_score, overlap, gate)``."""
    call = F.col("kind").isin("calls-symbol", "calls-symbol-local")
    s = F.broadcast(seeds.select(F.col("id").alias("seed"), F.col("score").alias("base")))  # SEEDS rows
    rows = None
    for here, there, step, far, share in (("target", "source", 0.70, 0.30, 0.35), ("source", "target", 0.65, 0.25, 0.30)):
        name = "callers" if there == "source" else "callees"
        first = edges.join(s, F.col(here) == F.col("seed")).select("seed", "base", F.col(there).alias("id"), call.alias("call")).distinct()
        hop = first.filter("call")
        second = hop.withColumnRenamed("id", "mid").join(edges.filter(call).select(F.col(here).alias("mid"), F.col(there).alias("id")).distinct(), "mid")
        for part, factor, reason in ((hop, step, name), (second, far, f"{name}_2hop"), (first.filter("not call"), share, "import_neighbors")):
            part = part.select("id", "base", F.lit(factor).alias("factor"), F.lit(reason).alias("reason")).distinct()
            rows = part if rows is None else rows.unionByName(part)
    held = rows.join(known, "id").filter(F.col("gate") | F.col("reason").endswith("_2hop"))
    imported = F.col("reason") == "import_neighbors"
    value = F.when(imported, neighbor_score(F.col("base"), F.col("factor"), F.col("task_score"), F.col("overlap"))).otherwise(F.col("base") * F.col("factor"))
    return strongest(held.select("id", value.alias("score"), F.array("reason").alias("reasons")))


def task_tests(matches: DataFrame) -> DataFrame:
    """JN-19: for tasks about tests or bugs, symbols in test files that share ``overlap`` keywords with the task. ``matches(id, file, overlap, ints)``."""
    path, tests = F.lower("file"), F.array_contains("ints", "tests")
    rows = matches.filter((path.contains("test") | path.contains("spec")) & (tests | F.array_contains("ints", "bugfix")))
    value = F.when(tests, 3.0 + F.col("overlap")).otherwise(1.2 + 0.5 * F.col("overlap"))
    return rows.select("id", value.alias("score"), F.array(F.lit("tests")).alias("reasons"))


def test_counterparts(seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    """JN-18: symbols of the files that would test a seed's file, at half the best seed's score. ``seeds(file, score)`` are few."""
    wanted = seeds.select(F.explode(test_candidates(dirname("file"), stem("file"), extension("file"))).alias("file"), "score").groupBy("file").agg(F.max("score").alias("base"))
    rows = symbols.join(F.broadcast(wanted), "file")  # SEEDS rows times the patterns
    return rows.select("id", (0.5 * F.col("base")).alias("score"), F.array(F.lit("code_test_map")).alias("reasons"))


# Containers that are no types of the project.
CONTAINERS = tuple("Result Option String Vec Box Promise List Map Set Dict Any".split())


def type_dependencies(rows: DataFrame, types: DataFrame, taken: DataFrame) -> DataFrame:
    """JN-17: types not yet taken that are named in the signatures of critical and workflow rows, at a score of 0.85."""
    words = rows.filter(F.col("tier").isin("critical", "workflow")).select(F.explode(F.regexp_extract_all("signature", F.lit(r"\b[A-Za-z_]\w*\b"), 0)).alias("name"))
    named = words.filter(~F.col("name").isin(*CONTAINERS)).distinct()
    hit = types.join(named, "name", "left_semi").join(taken.select("id"), "id", "left_anti")
    return hit.select("id", F.lit(0.85).alias("score")).distinct()


def relations(selected: DataFrame, edges: DataFrame, most: int = 15, most_far: int = 10) -> DataFrame:
    """JN-23: of each selected row its calls, callers and imports within the selection, and those two steps away that are not direct."""
    ids = selected.select("id")
    inner = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").filter("source <> target").select("source", "target", "kind").distinct()
    calls = inner.filter("kind like 'calls-symbol%'").select("source", "target").distinct()
    far = calls.alias("x").join(calls.alias("y"), F.col("x.target") == F.col("y.source")).select(F.col("x.source").alias("source"), F.col("y.target").alias("target")).filter("source <> target").distinct()

    out = ids.distinct()
    direct = {"dep_calls": calls, "dep_called_by": calls}
    for pairs, key, other, name, cap in (
        (calls, "source", "target", "calls", most),
        (calls, "target", "source", "called_by", most),
        (inner.filter("kind = 'imports-symbol'"), "source", "target", "imports", most),
        (far, "source", "target", "dep_calls", most_far),
        (far, "target", "source", "dep_called_by", most_far),
    ):
        rest = pairs.select("source", "target").join(direct[name], ["source", "target"], "left_anti") if name in direct else pairs.select("source", "target").distinct()
        # the first of each row by rank, so that no list is longer than what is shown
        first = rest.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(other))).filter(F.col("_r") <= cap)
        out = out.join(first.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(other)).alias(name)), "id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("calls", "called_by", "imports", "dep_calls", "dep_called_by")})


def density(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-08: nodes, edges among them (parallel ones counted) and edges / (n * (n - 1))."""
    ids = selected.select("id").distinct()
    inner = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    n, e = ids.agg(F.count("*").alias("nodes")), inner.agg(F.count("*").alias("edges"))
    full = F.col("nodes") * (F.col("nodes") - 1)
    return n.crossJoin(e).withColumn("density", F.round(F.when(full > 0, F.col("edges") / full).otherwise(0.0), 6))


def frontier(selected: DataFrame, cut: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """JN-24 and TK-04: neighbours of the selection that the budget cut: ``id, from_id, score, kind``; 0.75 of the score over a call, 0.30 else."""
    around = edges.select(F.col("source").alias("near"), F.col("target").alias("id"), "kind").unionByName(edges.select(F.col("target").alias("near"), F.col("source").alias("id"), "kind"))
    hit = around.join(selected.select(F.col("id").alias("near"), "score", F.col("order_no")), "near").join(cut.select("id", "tier"), "id")
    score = F.round(F.col("score") * F.when(F.col("kind").startswith("calls-symbol"), 0.75).otherwise(0.30), 6)
    first = Window.partitionBy("id").orderBy("order_no", score.desc(), "kind")
    best = hit.withColumn("plan_score", score).withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    weight = tier_number(F.col("tier"), TIER_WEIGHT)
    return best.orderBy(F.col("plan_score").desc(), weight.desc(), "id").limit(most).select("id", F.col("near").alias("from_id"), "plan_score", "kind", "tier")


def merge_priority(results: DataFrame) -> DataFrame:
    """AG-18 and SO-03: sub-task results as one list: ten for each appearance plus the first score. Columns: id, selection_score, part, place. Rows without an id all stay."""
    order = F.struct("part", "place")
    named = results.filter("id is not null").groupBy("id").agg(F.count("*").alias("appearances"), F.min_by("selection_score", order).alias("first_score"))
    bare = results.filter("id is null").select("id", F.lit(1).cast("long").alias("appearances"), F.col("selection_score").alias("first_score"))
    every = named.unionByName(bare)
    return every.withColumn("priority", F.round(10 * F.col("appearances") + F.col("first_score"), 6))
