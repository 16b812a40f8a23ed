"""Relevance of symbols to a task: IDF, task score, final score, neighbour and semantic blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import classify as C
from cairn.functions.text import focus, identifier_tokens, token_set

SEARCHED = ("id", "name", "file", "kind", "signature")


def idf(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """AG-04: ``token, df, idf`` with ``ln((N + 1) / (df + 1)) + 1`` over distinct tokens of each row."""
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n"))  # one row
    return df.crossJoin(F.broadcast(total)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def symbol_tokens(symbols: DataFrame) -> DataFrame:
    """PRJ-02: the token sets that scoring needs, computed once."""
    return symbols.withColumns({
        "t_name": F.array_distinct(identifier_tokens("name")),
        "t_file": F.array_distinct(identifier_tokens("file")),
        "t_sig": F.array_distinct(identifier_tokens("signature")),
        "t_all": token_set(*SEARCHED),
    })


def task_idf(tokens: DataFrame, task_words: DataFrame) -> DataFrame:
    """``task_id, kws, idfs``: each task's keywords with their IDF, 1 where no symbol has the word."""
    words = task_words.select("task_id", F.posexplode("kws").alias("pos", "token"))
    found = words.join(tokens.select("token", "idf"), "token", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    sorted_ = F.sort_array(F.collect_list(F.struct("pos", "token", "idf")))
    return found.groupBy("task_id").agg(sorted_.alias("x")).select("task_id", F.col("x.token").alias("kws"), F.col("x.idf").alias("idfs"))


def task_score(kws: Column, idfs: Column, pairs: tuple = C.FALSE_PAIRS) -> Column:
    """FN-04 over the columns of ``symbol_tokens``; keywords of falsely similar names count for nothing."""
    weighted = F.arrays_zip(kws.alias("k"), idfs.alias("w"))
    name, file, sig, every = F.col("t_name"), F.col("t_file"), F.col("t_sig"), F.col("t_all")
    lname, lfile = F.lower(C.s("name")), F.lower(C.s("file"))
    total = lambda tokens: F.aggregate(F.filter(weighted, lambda p: F.array_contains(tokens, p["k"])), F.lit(0.0), lambda a, p: a + p["w"])
    count = lambda tokens: F.size(F.array_intersect(kws, tokens))
    base = count(name) * 0.0
    base = base + F.when(count(name) > 0, count(name) * (5.0 + 0.5 * total(name))).otherwise(0.0)
    base = base + F.when(count(file) > 0, count(file) * (1.6 + 0.3 * total(file))).otherwise(0.0)
    base = base + 1.5 * count(sig) + 0.6 * F.greatest(F.lit(0), count(every) - count(name))
    plain_path = ~lfile.contains("test") & ~lfile.contains("spec")
    base = base + F.when((F.size(F.array_intersect(focus(kws), file)) > 0) & (F.lower(C.s("kind")) == "func") & C.b("exported") & plain_path, 1.2).otherwise(0.0)

    def per_keyword(p: Column) -> Column:
        k, w = p["k"], p["w"]
        extra = 0.8 * (w - 1)
        prefix = F.exists(name, lambda t: F.startswith(t, k) & (t != k))
        in_name = (
            F.when(~F.contains(lname, k), 0.0)
            .when(F.array_contains(name, k), 1.5 * w * (1 + extra))
            .when(prefix, 0.8 * w * (1 + extra / 2))
            .otherwise(0.2 * w)
        )
        in_file = F.when(F.contains(lfile, k), 0.45 * w * (1 + 0.3 * extra)).otherwise(0.0)
        long_hit = F.when(F.exists(name, lambda t: (t == k) & (F.length(t) > 4)) & (F.length(k) > 3), 0.5 * w).otherwise(0.0)
        return F.when(C.is_false_pair(k, name, pairs), 0.0).otherwise(in_name + in_file + long_hit)

    return base + F.aggregate(weighted, F.lit(0.0), lambda a, p: a + per_keyword(p))


def score_tasks(symbols: DataFrame, tasks: DataFrame, pairs: tuple = C.FALSE_PAIRS) -> DataFrame:
    """Every symbol against every task: ``task_score, overlap``. Tasks are few and stated by the caller; they are broadcast."""
    tokens = symbol_tokens(symbols)
    words = task_idf(idf(tokens, "t_all"), tasks)
    rows = tokens.crossJoin(F.broadcast(words))
    return rows.withColumns({"task_score": task_score(F.col("kws"), F.col("idfs"), pairs), "overlap": F.size(F.array_intersect("kws", "t_all"))})


def final_score(task: Column, most: Column, graph: Column, kws: Column, intents: Column, hotspot: Column) -> Column:
    """FN-05 over the columns of ``score_tasks``."""
    overlap, lines = F.col("overlap"), C.line_count(F.col("start_line"), F.col("end_line"))
    generic = F.when(C.is_generic_type() & (overlap == 0) & ~F.array_contains(intents, "types"), 0.45).otherwise(1.0)
    calls = F.least(C.n("inbound_calls"), F.lit(8)) / 8.0
    core = F.when(C.is_non_core(C.s("file")), 0.6).otherwise(1.0)
    mix = 0.55 * task / F.when(most == 0, 1.0).otherwise(most) + 0.25 * calls + 0.20 * graph
    return mix * generic * C.support_factor(kws, intents, ready=True) * C.size_penalty(lines) * C.role_boost(C.s("role")) * core * (1 + 0.4 * hotspot)


def graph_score(rank: Column, personal: Column, seeded: Column) -> Column:
    """Rank alone, or 0.4 of it with 0.6 of the personalised rank when the task has seeds."""
    return F.when(seeded, 0.4 * rank + 0.6 * personal).otherwise(rank)


def neighbor_score(base: Column, default: Column, task: Column, overlap: Column) -> Column:
    """FN-06: a neighbour keeps a share of its seed's score, less if it shares no keyword, and never under 0.35 of its own task score."""
    factor = F.when(overlap > 0, default).when(task > 0, default * 0.75).otherwise(F.least(default, F.lit(0.035)))
    return F.greatest(base * factor, 0.35 * task)


def semantic_blend(score: Column, similarity: Column, is_best: Column) -> Column:
    """FN-07: the single best semantic match moves 0.3 of the way to ten times its similarity."""
    return F.when(is_best, 0.7 * score + 0.3 * 10 * similarity).otherwise(score)
