"""Text columns: identifier tokens, task keywords, intents, token costs, path pieces. All JVM-side."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Words that never make a keyword.
STOP_WORDS = tuple(
    "the a an is are to of in for on with at by from and or not this that it i we you need want make add when while during after before "
    "fix update change el la los las un una de del en con por para que como es son hay quiero necesito hacer crear modificar arreglar".split()
)
# Keywords that name no focus.
ENTITY_WORDS = tuple("item items model models data support bug wrong empty strategy".split())
# Words that show what a task intends.
INTENTS = {
    "bugfix": tuple("bug fix fail failure error regression broken crash incorrect exception bugfix fallo arreglar".split()),
    "tests": tuple("test tests spec coverage unittest prueba pruebas".split()),
    "types": tuple("type types interface schema typing tipo tipos".split()),
}
# Conjunctions between parts of a task, and verbs that name an action.
CONJUNCTIONS = tuple("and y e & plus also with con und et".split())
ACTIONS = tuple(
    "add create implement fix update modify refactor optimize remove delete improve enhance extend support handle "
    "agregar crear implementar arreglar actualizar modificar".split()
)
# Tokens per budget profile.
PROFILES = {"micro": 1500, "standard": 4096, "deep": 8192}
# Characters per token of the estimators.
CHARS_PER_TOKEN = {"gemini": 3.7, "claude": 3.5, "default": 4.0}


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def identifier_tokens(text) -> Column:
    """PRJ-01: lower-case alphanumeric runs, split at camel humps and at ``@ . / _ -``. Null gives no tokens."""
    humps = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(F.regexp_replace(humps, r"[@./_\-]+", " ")), F.lit(r"[a-z0-9]+"), 0)


def token_set(*columns) -> Column:
    """PRJ-02: distinct tokens over several columns."""
    return F.array_distinct(F.flatten(F.array(*[identifier_tokens(c) for c in columns])))


def vector_tokens(text) -> Column:
    """PRJ-03: identifier tokens, ``:`` and ``\\`` split too, longer than one character."""
    return F.filter(identifier_tokens(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[:\\]+", " ")), lambda t: F.length(t) > 1)


def keywords(task, synonyms: dict[str, tuple[tuple[str, ...], bool]] | None = None) -> Column:
    """FN-01: keywords of a task in order; JN-29: with a synonym table each is followed by its canonical names and full groups."""
    runs = F.regexp_extract_all(F.coalesce(_c(task), F.lit("")), F.lit(r"(?U)[\w@./-]+"), 0)
    words = F.flatten(F.transform(runs, identifier_tokens))
    words = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(strings(STOP_WORDS), w))
    words = F.array_distinct(words)
    return F.array_distinct(expand(words, synonyms)) if synonyms else words


def expand(words: Column, synonyms: dict[str, tuple[tuple[str, ...], bool]]) -> Column:
    """Each word, then for each group that has it (in name order) the group's name, and all of it if the group is a full one."""
    after: dict[str, list[str]] = {}
    for name in sorted(synonyms):
        members, full = synonyms[name]
        for m in sorted({*members, name}):
            after.setdefault(m, []).extend([name, *(sorted(members) if full else ())])
    table = F.create_map(*[x for k, v in after.items() for x in (F.lit(k), strings(list(dict.fromkeys(v))))])
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(table, w), strings([])))))


def focus(words: Column) -> Column:
    """FLT-20: keywords that are not mere entities."""
    return F.array_except(words, strings(ENTITY_WORDS))


def intents(task) -> Column:
    """FN-02: which of bugfix, tests and types the words of a task show."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(_c(task), F.lit(""))), F.lit(r"(?U)[\w@./-]+"), 0)
    words = F.filter(F.flatten(F.transform(runs, identifier_tokens)), lambda w: F.length(w) > 2)
    return F.filter(F.array(*[F.when(F.arrays_overlap(words, strings(v)), F.lit(k)) for k, v in INTENTS.items()]), lambda x: x.isNotNull())


def task_parts(task) -> Column:
    """FN-03: parts of a task between conjunctions as structs (text, action); the first verb in text order is the action."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_c(task), F.lit(""))), F.lit(r"(?U)\w+"), 0)
    # a mark stands for each conjunction that follows at least one word of a part
    joined = F.aggregate(
        words,
        F.struct(F.lit("").alias("done"), F.lit("").alias("part")),
        lambda acc, w: F.when(
            F.array_contains(strings(CONJUNCTIONS), w) & (acc["part"] != ""),
            F.struct(F.concat(acc["done"], acc["part"], F.lit("\n")).alias("done"), F.lit("").alias("part")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat_ws(" ", F.nullif(acc["part"], F.lit("")), w).alias("part"))),
        lambda acc: F.concat(acc["done"], acc["part"]),
    )
    parts = F.filter(F.split(joined, "\n"), lambda p: p != "")
    verb = lambda p: F.coalesce(F.get(F.filter(F.split(p, " "), lambda w: F.array_contains(strings(ACTIONS), w)), 0), F.lit("modify"))
    cut = F.transform(parts, lambda p: F.struct(p.alias("text"), verb(p).alias("action"), keywords(p).alias("keywords")))
    useful = F.when(F.size(parts) > 1, F.filter(cut, lambda s: F.size(s["keywords"]) > 0)).otherwise(F.array().cast(_PART))
    whole = F.lower(F.trim(F.coalesce(_c(task), F.lit(""))))
    first = F.coalesce(F.get(F.filter(words, lambda w: F.array_contains(strings(ACTIONS), w)), 0), F.lit("modify"))
    return F.when(F.size(useful) > 0, useful).otherwise(F.array(F.struct(whole.alias("text"), first.alias("action"), keywords(task).alias("keywords"))))


_PART = "array<struct<text:string,action:string,keywords:array<string>>>"


def estimate_tokens(text, model: str = "default") -> Column:
    """PRJ-05: estimated tokens, one at least."""
    n = F.length(F.coalesce(_c(text), F.lit("")))
    k = next((v for name, v in CHARS_PER_TOKEN.items() if name in model.lower()), CHARS_PER_TOKEN["default"])
    return F.greatest(F.lit(1), F.floor(n / F.lit(k)).cast("int"))


def token_counter(ranks_path: str, pattern: str) -> Callable[[Column], Column]:
    """UD-01 and PRJ-05: a function of a text column that counts the tokens of a public rank file (base64 token and rank a line) under its split pattern.

    The file is read where this is called; workers get its contents and build the encoder once."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    held: dict = {}

    @pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        if "encode" not in held:
            import tiktoken

            held["encode"] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return texts.map(lambda t: len(held["encode"](t or "")))

    return lambda text: count(_c(text))


# Words that never make a token of a benchmark task.
TASK_STOP_WORDS = tuple("the a an is are to of in for on with at by from and or not fix add update change when empty wrong support".split())


def benchmark_tokens(task) -> Column:
    """PRJ-04: distinct tokens of a benchmark task in order, over two characters; ``:`` splits too."""
    words = identifier_tokens(F.regexp_replace(F.coalesce(_c(task), F.lit("")), ":+", " "))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(strings(TASK_STOP_WORDS), w)))


def budget(profile, tokens) -> Column:
    """PRJ-06: tokens of a profile; ``custom`` takes the argument; other names are errors."""
    p = _c(profile)
    out = F.when(p == "custom", _c(tokens))
    for name, n in PROFILES.items():
        out = out.when(p == name, F.lit(n))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown budget profile: "), p)).cast("int"))


def truncate_tokens(text, most: int) -> Column:
    """PRJ-16: at most so many estimated tokens, marked where cut."""
    t = _c(text)
    return F.when(F.floor(F.length(t) / 4) > most, F.concat(F.substring(t, 1, 4 * most), F.lit("\n... [truncated]"))).otherwise(t)


def truncate_words(text, most: int) -> Column:
    """FN-19: at most so many words, joined by one space and followed by an ellipsis where cut."""
    words = F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > most, F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit(" ..."))).otherwise(_c(text))


def basename(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)/*$", 1)


def dirname(path) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def extension(path) -> Column:
    """Without the dot, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(_c(path), r"[^/]\.([^./]+)$", 1))


def stem(path) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def normalize_path(path) -> Column:
    """FN-13: fold ``.`` and ``..`` segments; ``..`` above the top stays."""
    parts = F.filter(F.split(_c(path), "/"), lambda s: ~s.isin("", "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(folded, "/")


def short_id(symbol_id) -> Column:
    """PRJ-10: base name of the file, ``::``, symbol."""
    s = _c(symbol_id)
    return F.when(s.contains("::"), F.concat(basename(F.substring_index(s, "::", 1)), F.lit("::"), F.expr(f"substring({_sql(s)}, instr({_sql(s)}, '::') + 2)") if isinstance(symbol_id, str) else F.regexp_extract(s, r"::(.*)$", 1))).otherwise(s)


def _sql(c: Column) -> str:
    return c._jc.toString() if hasattr(c, "_jc") else str(c)


def search_text(*columns) -> Column:
    """PRJ-09: the non-empty columns joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(_c(c), F.lit("")) for c in columns])


def comment_leader(ext) -> Column:
    """PRJ-14."""
    e = F.regexp_replace(F.lower(_c(ext)), r"^\.+", "")
    return F.when(e.isin(*"py rb sh toml yaml yml r ex exs".split()), "#").when(e == "sql", "--").otherwise("//")


def xml_escape(text) -> Column:
    """FN-12: ``& < >``; quotes stay."""
    t = F.replace(_c(text), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def lsp_kind(kind) -> Column:
    """PRJ-18: numeric symbol kinds of the language server protocol."""
    k = F.lower(_c(kind))
    codes = {"file": 1, "module": 2, "namespace": 3, "class": 5, "method": 6, "property": 7, "enum": 10, "interface": 11, "func": 12, "function": 12, "variable": 13, "const": 14, "struct": 23, "type": 26}
    out = F.when(F.lit(False), 0)
    for name, code in codes.items():
        out = out.when(k == name, F.lit(code))
    return out.otherwise(13)
