"""Predicates and ordered classifications of symbols and paths, as boolean, string and number columns.

Symbol columns: ``name, kind, file, signature, start_line, end_line, exported, named_imports,
resolved_imports, inbound_calls, outbound_calls, rank, role``. Keyword columns are arrays of strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basename, extension, focus, strings, token_set

# Fixed values.
BUILTIN_NAMES = tuple("ValueError TypeError RuntimeError Exception Error Promise Map Set Array Object String Number".split())
DECLARATIONS = tuple(
    "def |async def |class |export |function |async function |const |let |var |interface |type |enum |public |private |protected |static |final |"
    "void |boolean |string |int |long |double |float |decimal |namespace |using ".split("|")
)
GENERIC_KINDS = ("symbol", "interface", "type", "enum", "struct")
MODEL_KINDS = ("class", "interface", "type", "enum", "struct")
DISTRACTORS = "noise|noisy|mock|mocks|sample|samples|fixture|fixtures"
NON_CORE = "examples|example|benchmarks|benchmark|demo|demos|docs|doc|samples|sample|scripts|tools"
SOURCE_EXTENSIONS = tuple("py ts tsx js jsx go rs java rb php cs swift kt scala c cpp h hpp ex exs".split())
FLOW_WORDS = tuple(
    "if else for while return match switch case default try catch finally throw raise yield break continue struct class impl fn func function "
    "pub public private protected".split()
)
FALSE_PAIRS = (
    ("payment", "timeout"), ("payment", "settimeout"), ("email", "mailinglist"), ("auth", "checkbox"), ("auth", "pathname"),
    ("cache", "workspace"), ("search", "research"), ("test", "testing_framework"), ("order", "border"),
)
ROLE_BOOST = {"entry_point": 1.30, "hub": 1.25, "api_surface": 1.20, "module": 1.00, "leaf": 0.85, "utility": 0.75}


def s(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def b(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def match(kws: Column, *columns: str) -> Column:
    """PRJ-07: keywords among the tokens of the columns."""
    return F.array_intersect(kws, token_set(*columns))


#: Token sets that ``score.symbol_tokens`` adds; rules with ``ready`` read them instead of cutting names again.
READY = {"name": "t_name", "file": "t_file", "signature": "t_sig"}


def hits(kws: Column, *columns: str, ready: bool = False) -> Column:
    """Does any keyword stand among the tokens of the columns?"""
    if not ready:
        return F.arrays_overlap(kws, token_set(*columns))
    out = F.lit(False)
    for c in columns:
        out = out | F.arrays_overlap(kws, F.col(READY[c]))
    return out


def starts_with_any(text: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def is_noise() -> Column:
    """FLT-01."""
    sig, name = F.trim(s("signature")), s("name")
    call = (n("start_line") == n("end_line")) | sig.endswith(")") | (~sig.contains("{") & ~sig.contains("=>") & ~sig.endswith(":"))
    raised = starts_with_any(sig, ("raise ", "throw new ")) & name.endswith("Error")
    loose = (F.lower(s("kind")) == "func") & (sig != "") & ~starts_with_any(sig, DECLARATIONS) & call & ~b("exported")
    return name.isin(*BUILTIN_NAMES) | raised | loose


def is_generic_type() -> Column:
    """FLT-02."""
    return F.lower(s("kind")).isin(*GENERIC_KINDS) & (n("named_imports") >= 25) & (n("inbound_calls") == 0)


def is_weak_file_match(kws: Column, ready: bool = False) -> Column:
    """FLT-03."""
    return ~hits(kws, "name", "signature", ready=ready) & hits(kws, "file", ready=ready)


def is_unrequested_test(intents: Column) -> Column:
    """FLT-04."""
    path = F.lower(s("file"))
    test = F.concat(F.lit("/"), path).contains("/test") | path.endswith("_test.py") | path.endswith(".test.ts")
    return test & ~F.array_contains(intents, "tests")


def is_isolated_match(kws: Column, ready: bool = False) -> Column:
    """FLT-05."""
    signal = n("inbound_calls") + n("outbound_calls") + n("named_imports") + n("resolved_imports")
    there = F.concat(F.lit("/"), F.lower(s("file"))).rlike(f"/({DISTRACTORS})/")
    return hits(focus(kws), "name", "signature", ready=ready) & (signal == 0) & there


def is_probable_external(spec: Column) -> Column:
    """FLT-06: a scoped name of two segments or fewer, or a bare name; relative specifiers never."""
    scoped = spec.startswith("@") & (F.size(F.split(spec, "/")) <= 2)
    return ~spec.startswith(".") & (scoped | ~spec.contains("/"))


def is_non_core(file: Column) -> Column:
    """FLT-08."""
    return F.concat(F.lit("/"), F.lower(file)).rlike(f"/({NON_CORE})/")


def is_test_path(path: Column) -> Column:
    """FLT-09."""
    p, base = F.lower(path), basename(F.lower(path))
    named = base.startswith("test_") | base.endswith("_test.py") | base.contains(".test.")
    placed = F.concat(F.lit("/"), p).rlike("/(test|tests|__tests__|spec|specs)/")
    return ~base.isin("__init__.py", "conftest.py", "pytest.ini", "setup.cfg", "tox.ini") & (named | placed)


def is_source_path(path: Column) -> Column:
    return extension(path).isin(*SOURCE_EXTENSIONS) & ~is_test_path(path)


def is_false_pair(keyword: Column, tokens: Column, pairs: tuple[tuple[str, str], ...] = FALSE_PAIRS) -> Column:
    """FLT-10: does a name with these tokens look like the keyword by accident? UD-06: the pairs are a parameter."""
    out = F.lit(False)
    for k in sorted({k for k, _ in pairs}):
        bad = strings([t for a, t in pairs if a == k])
        out = out | ((keyword == k) & F.arrays_overlap(tokens, bad))
    return out


def is_active_line(index: Column, total: Column, line: Column, kws: Column) -> Column:
    """FLT-11: the first two lines, the last one, and lines with control flow, a keyword or a call."""
    t = F.trim(line)
    flow = F.arrays_overlap(F.regexp_extract_all(t, F.lit(r"\b[A-Za-z_]\w*\b"), 0), strings(FLOW_WORDS))
    hit = F.exists(kws, lambda k: F.contains(F.lower(t), F.lower(k)))
    call = t.contains("(") | t.contains("new ") | t.contains(".") | t.contains("::")
    return (index < 2) | (index == total - 1) | ((t != "") & (flow | hit | call))


def _tests_file(file: Column) -> Column:
    return F.lower(file).contains("test") | F.lower(file).contains("spec")


def _model_dir() -> Column:
    """A folder of that name below the first one, with either slash."""
    path = F.lower(s("file"))
    return path.contains("/models/") | path.contains("\\models\\")


def _model_like() -> Column:
    return F.lower(s("kind")).isin(*MODEL_KINDS) | _model_dir()


def context_tier(kws: Column, intents: Column, ready: bool = False) -> Column:
    """FLT-12: critical, workflow or support; the first rule that holds decides."""
    f = focus(kws)
    func = F.lower(s("kind")) == "func"
    has = lambda words, *cols: hits(words, *cols, ready=ready)
    overlap = has(kws, "name", "file", "signature")
    called = (n("inbound_calls") > 0) | (n("outbound_calls") > 0)
    return (
        F.when(_tests_file(s("file")), F.when(F.array_contains(intents, "tests"), "workflow").otherwise("support"))
        .when(func & has(f, "name", "signature"), "critical")
        .when(func & ~_model_like() & has(f, "file") & b("exported"), "critical")
        .when(_model_like() & has(kws, "name") & b("exported"), "critical")
        .when(_model_like() & has(f, "name", "signature"), "critical")
        .when(func & ~_model_like() & overlap & called, "workflow")
        .when(_model_like() & overlap, "workflow")
        .otherwise("support")
    )


def support_factor(kws: Column, intents: Column, ready: bool = False) -> Column:
    """FLT-13: the first rule that holds decides."""
    f = focus(kws)
    return (
        F.when(~F.array_contains(intents, "tests") & _tests_file(s("file")), 0.55)
        .when(F.size(f) == 0, 1.0)
        .when(hits(f, "name", "file", "signature", ready=ready), 1.0)
        .when(_model_like(), 0.25)
        .when(hits(kws, "name", "file", "signature", ready=ready), 0.58)
        .when(s("name").rlike(r"^\p{Lu}") & ~hits(kws, "name", ready=ready), 0.70)
        .otherwise(1.0)
    )


def role_boost(role: Column) -> Column:
    """FLT-14."""
    out = F.when(F.lit(False), 1.0)
    for name, x in ROLE_BOOST.items():
        out = out.when(role == name, F.lit(x))
    return out.otherwise(1.0)


def size_penalty(lines: Column) -> Column:
    """FLT-15."""
    return F.when(lines > 100, 0.7).when(lines > 50, 0.85).otherwise(1.0)


def line_count(start: Column, end: Column) -> Column:
    """Lines of a symbol, both ends counted."""
    return F.coalesce(end, F.lit(0)) - F.coalesce(start, F.lit(0)) + 1


def neighbor_ok(overlap: Column, tier: Column) -> Column:
    """FLT-16: may a one-hop neighbour join the candidates?"""
    return overlap | (tier != "support") | F.lower(s("kind")).isin(*MODEL_KINDS)


def seed_ok(task_score: Column, final_score: Column) -> Column:
    """FLT-17."""
    return (task_score >= 0.15) | (final_score >= 0.3)


def confidence_label(c: Column) -> Column:
    """FLT-18."""
    return F.when(c >= 0.65, "very_high").when(c >= 0.35, "high").when(c >= 0.10, "medium").otherwise("low")


def grade(score: Column) -> Column:
    """FLT-19."""
    return F.when(score >= 0.9, "A+").when(score >= 0.8, "A").when(score >= 0.7, "B").when(score >= 0.6, "C").when(score >= 0.5, "D").otherwise("F")


def role(indegree: Column, outdegree: Column) -> Column:
    """AG-13: the order of the rules is part of the meaning, so ``utility`` has none left."""
    i, o = indegree, outdegree
    return (
        F.when((i > 0) & (o == 0), "leaf")
        .when((o > 0) & (i == 0), "entry_point")
        .when((i >= 3) & (o >= 3), "hub")
        .when((i >= 5) & (i > 3 * o), "api_surface")
        .otherwise("module")
    )
