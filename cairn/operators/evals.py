"""Retrieval quality: recall, precision, penalties, case scores, suite means, gates and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import identifier_tokens

FLOOR, MAX_DROP, WARN_DROP = 0.80, 0.03, 0.10


def _hits(wanted: Column, found: Column) -> Column:
    """JN-30: how many wanted strings are in some found id, in either case."""
    low = F.transform(found, F.lower)
    return F.size(F.filter(wanted, lambda w: F.exists(low, lambda s: F.contains(s, F.lower(w)))))


def recall(wanted: Column, found: Column) -> Column:
    return F.when(F.size(wanted) == 0, 1.0).otherwise(_hits(wanted, found) / F.size(wanted))


def precision(wanted: Column, found: Column, k: Column) -> Column:
    top = F.slice(found, F.lit(1), F.greatest(k, F.lit(1)))
    return F.when((k == 0) | (F.size(wanted) == 0), 0.0).otherwise(F.least(F.lit(1.0), _hits(wanted, top) / k))


def forbidden_share(forbidden: Column, found: Column) -> Column:
    return F.when(F.size(forbidden) == 0, 0.0).otherwise(_hits(forbidden, found) / F.size(forbidden))


def case_scores(cases: DataFrame) -> DataFrame:
    """AG-19 over ``case_id, must, must_not, found (ids in order), top_n, tier_accuracy``."""
    c = F.col
    rows = cases.withColumns({"recall": recall(c("must"), c("found")), "precision": precision(c("must"), c("found"), c("top_n")), "penalty": forbidden_share(c("must_not"), c("found"))})
    return rows.withColumn("score", F.round(0.40 * c("recall") + 0.25 * c("precision") + 0.20 * (1 - c("penalty")) + 0.15 * c("tier_accuracy"), 6))


def tier_accuracy(expected: DataFrame, selected: DataFrame) -> DataFrame:
    """Of the names expected in a tier, the share whose first match in the order has it: ``case_id, tier_accuracy``."""
    hit = expected.join(selected, "case_id").filter(F.contains(F.lower("id"), F.lower("name")))
    first = hit.groupBy("case_id", "name", "tier").agg(F.min_by("found_tier", "place").alias("got"))
    every = expected.join(first, ["case_id", "name", "tier"], "left")
    return every.groupBy("case_id").agg((F.count_if(F.col("got") == F.col("tier")) / F.count("*")).alias("tier_accuracy"))


def required_ranks(expected: DataFrame, selected: DataFrame) -> DataFrame:
    """WN-09: ``case_id, name, place`` of the first match of each required name, null if it is not there."""
    hit = expected.join(selected, "case_id").filter(F.contains(F.lower("id"), F.lower("name"))).groupBy("case_id", "name").agg(F.min("place").alias("place"))
    return expected.join(hit, ["case_id", "name"], "left")


def graph_score(recall_: Column, critical: Column, precise: Column, precise_critical: Column, penalty: Column, over_budget: Column) -> Column:
    """AG-20: 0.55 recall, 0.15 critical recall, 0.12 and 0.10 precision, 0.08 for nothing forbidden; three quarters of it over budget."""
    s = 0.55 * recall_ + 0.15 * critical + 0.12 * precise + 0.10 * precise_critical + 0.08 * (1 - penalty)
    return F.round(F.when(over_budget, 0.75 * s).otherwise(s), 4)


def grep_ranking(symbols: DataFrame, tasks: DataFrame) -> DataFrame:
    """TK-08: the token-grep baseline: 3 a name hit, 1.2 a file hit, 1 a hit; rows without any are left out. ``tasks(task_id, kws)`` is broadcast."""
    tok = symbols.withColumns({"tn": identifier_tokens("name"), "tf": identifier_tokens("file"), "ta": identifier_tokens(F.concat_ws(" ", "id", "name", "file", "signature"))})
    rows = tok.crossJoin(F.broadcast(tasks)).withColumn("hits", F.size(F.array_intersect("kws", "ta"))).filter("hits > 0")
    score = 3.0 * F.size(F.array_intersect("kws", "tn")) + 1.2 * F.size(F.array_intersect("kws", "tf")) + F.col("hits")
    rows = rows.withColumn("score", F.round(score, 6))
    w = Window.partitionBy("task_id").orderBy(F.col("score").desc(), F.col("rank").desc(), F.col("id").desc())
    return rows.select("task_id", "id", "score", F.row_number().over(w).alias("place"))


def lift(score: Column, *baselines: Column) -> Column:
    return F.round(score - F.greatest(*baselines, F.lit(0.0)), 4)


def mean_recall(cases: DataFrame) -> DataFrame:
    """AG-21: by fixture, by category and in all, in one pass of grouping sets: ``level, key, recall, cases``."""
    level = F.when(F.grouping("fixture") == 0, "fixture").when(F.grouping("category") == 0, "category").otherwise("all")
    rows = cases.groupingSets([[F.col("fixture")], [F.col("category")], []], "fixture", "category").agg(level.alias("level"), F.round(F.avg("recall"), 4).alias("recall"), F.count("*").alias("cases"))
    return rows.select("level", F.coalesce("fixture", "category", F.lit("")).alias("key"), "recall", "cases")


def recall_gate(current: DataFrame, baseline: DataFrame, floor: float = FLOOR, drop: float = MAX_DROP, warn: float = WARN_DROP) -> DataFrame:
    """FLT-28 over two results of ``mean_recall``: ``level, key, recall, before, verdict`` (fail, warn, ok)."""
    both = current.select("level", "key", "recall").join(baseline.select("level", "key", F.col("recall").alias("before")), ["level", "key"], "left")
    loss = F.round(F.coalesce("before", "recall") - F.col("recall"), 6)
    overall = F.col("level") == "all"
    verdict = F.when(overall & ((F.col("recall") < floor) | (loss > drop)), "fail").when((F.col("level") == "fixture") & (loss > warn), "warn").otherwise("ok")
    return both.withColumn("verdict", verdict)


def suite_means(cases: DataFrame) -> DataFrame:
    """AG-22: means over a suite of ``score, lift, utilization, guarded``."""
    return cases.agg(F.count("*").alias("cases"), F.round(F.avg("score"), 4).alias("score"), F.round(F.avg("lift"), 4).alias("lift"), F.round(F.avg("utilization"), 4).alias("utilization"), F.round(F.avg(F.col("guarded").cast("double")), 4).alias("guarded_rate"))


def knowledge_covered(knowledge: Column, texts: Column) -> Column:
    """Is a piece of knowledge in one of the texts: a whole word of it, or half of its words in part (four letters or more)?"""
    words = F.array_distinct(F.split(F.lower(knowledge), r"\s+"))

    def covered(t: Column) -> Column:
        have = F.array_distinct(F.split(F.lower(t), r"\s+"))
        part = F.size(F.filter(words, lambda k: (F.length(k) >= 4) & F.exists(have, lambda h: (F.length(h) >= 4) & (F.contains(h, k) | F.contains(k, h)))))
        return F.arrays_overlap(words, have) | (part >= 0.5 * F.size(words))

    return F.exists(texts, covered)


def agent_quality(contexts: DataFrame) -> DataFrame:
    """AG-23 over ``case_id, knowledge, files_to_edit, texts, files, tiers, used, budget``: 0.45 knowledge, 0.25 files, 0.15 critical share, 0.15 tokens left."""
    c = F.col
    known = F.size(F.filter("knowledge", lambda k: knowledge_covered(k, c("texts")))) / F.greatest(F.size("knowledge"), F.lit(1))
    edited = F.size(F.filter("files_to_edit", lambda f: F.exists("files", lambda x: F.contains(F.lower(x), F.lower(f))))) / F.greatest(F.size("files_to_edit"), F.lit(1))
    critical = F.size(F.filter("tiers", lambda t: t == "critical")) / F.greatest(F.size("tiers"), F.lit(1))
    left = F.when(c("budget") > 0, 1 - c("used") / F.greatest(c("budget"), F.lit(1))).otherwise(0.0)
    rows = contexts.withColumns({"knowledge_coverage": F.round(known, 3), "file_coverage": F.round(edited, 3), "token_efficiency": F.round(left, 3)})
    return rows.withColumn("quality", F.round(0.45 * known + 0.25 * edited + 0.15 * critical + 0.15 * left, 3))


def dataset_hash(cases: DataFrame) -> DataFrame:
    """AG-28: the first 16 hex digits of the SHA-256 of the cases' JSON in id order; a labelled set is small by nature."""
    xs = F.sort_array(F.collect_list(F.struct("case_id", F.to_json(F.struct("*")).alias("j"))))
    return cases.agg(F.substring(F.sha2(F.array_join(F.transform(xs, lambda x: x["j"]), "\n"), 256), 1, 16).alias("dataset_hash"))
