from pyspark.sql import functions as F

from cairn.functions import classify as C
from cairn.functions import text as T


def one(spark, **columns):
    """A frame of one row and a function that evaluates a column on it."""
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, (list, tuple)) else T.strings(v).alias(k) for k, v in columns.items()])
    return lambda c: df.select(c.alias("x")).first().x


def symbol(spark, **changes):
    base = dict(id="a/b.py::run", name="run", file="a/b.py", kind="func", signature="def run(x):", start_line=1, end_line=5, exported=True, named_imports=0, resolved_imports=0, inbound_calls=1, outbound_calls=0, rank=0.5, role="module")
    return one(spark, **(base | changes))


def test_identifier_tokens(spark):
    get = one(spark, s="getUserName_v2/api.Route@x-y", n=None)
    assert get(T.identifier_tokens("s")) == ["get", "user", "name", "v2", "api", "route", "x", "y"]
    assert get(T.identifier_tokens("n")) == []


def test_keywords_drop_stop_words_and_expand(spark):
    get = one(spark, t="Fix the LOGIN of users and the loginForm")
    assert get(T.keywords("t")) == ["login", "users", "form"]
    synonyms = {"auth": (("login", "token"), True), "user": (("users",), False)}
    assert get(T.keywords("t", synonyms)) == ["login", "auth", "token", "users", "user", "form"]  # members in order, then the rest


def test_intents(spark):
    assert one(spark, t="add tests for the broken Schema")(T.intents("t")) == ["bugfix", "tests", "types"]
    assert one(spark, t="nothing")(T.intents("t")) == []


def test_task_parts(spark):
    parts = one(spark, t="add login form and fix payment errors")(T.task_parts("t"))
    assert [(p.text, p.action) for p in parts] == [("add login form", "add"), ("fix payment errors", "fix")]
    whole = one(spark, t="login form")(T.task_parts("t"))
    assert [(p.text, p.action, p.keywords) for p in whole] == [("login form", "modify", ["login", "form"])]


def test_token_estimates_and_budgets(spark):
    get = one(spark, t="x" * 37, e="", p="micro", c="custom")
    assert get(T.estimate_tokens("t")) == 9
    assert get(T.estimate_tokens("t", "gemini-pro")) == 10
    assert get(T.estimate_tokens("e")) == 1
    assert get(T.budget("p", F.lit(7))) == 1500
    assert get(T.budget("c", F.lit(7))) == 7


def test_paths(spark):
    get = one(spark, p="a/./b/../c.tar.gz", q="../x/../../y", d=".py", s="lib/x.py::C::m")
    assert get(T.normalize_path("p")) == "a/c.tar.gz"
    assert get(T.normalize_path("q")) == "../../y"
    assert get(T.stem("p")) == "c.tar"
    assert get(T.extension("p")) == "gz"
    assert get(T.extension("d")) == ""


def test_xml_escape_leaves_quotes(spark):
    assert one(spark, t="a<b & \"c\">")(T.xml_escape("t")) == 'a&lt;b &amp; "c"&gt;'


def test_truncate_words(spark):
    get = one(spark, t="a b\nc d")
    assert get(T.truncate_words("t", 3)) == "a b c ..."
    assert get(T.truncate_words("t", 4)) == "a b\nc d"


def test_noise(spark):
    assert symbol(spark, name="TypeError")(C.is_noise())
    assert symbol(spark, signature="raise PayError", name="PayError")(C.is_noise())
    assert symbol(spark, signature="run(x)", exported=False)(C.is_noise())
    assert not symbol(spark, signature="run(x)", exported=True)(C.is_noise())
    assert not symbol(spark, signature="def run(x)", exported=False)(C.is_noise())


def test_tiers(spark):
    kws, none, tests = T.strings(["run", "item"]), T.strings([]), T.strings(["tests"])
    assert symbol(spark)(C.context_tier(kws, none)) == "critical"
    assert symbol(spark, file="tests/b.py")(C.context_tier(kws, none)) == "support"
    assert symbol(spark, file="tests/b.py")(C.context_tier(kws, tests)) == "workflow"
    assert symbol(spark, name="item", signature="", id="")(C.context_tier(kws, none)) == "workflow"
    assert symbol(spark, kind="class", name="Item", exported=True, signature="")(C.context_tier(kws, none)) == "critical"
    assert symbol(spark, name="other", signature="")(C.context_tier(kws, none)) == "support"


def test_support_factor_order(spark):
    kws, none = T.strings(["pay"]), T.strings([])
    assert symbol(spark, file="spec/x.py")(C.support_factor(kws, none)) == 0.55
    assert symbol(spark)(C.support_factor(T.strings(["items"]), none)) == 1.0
    assert symbol(spark, kind="class")(C.support_factor(kws, none)) == 0.25
    assert symbol(spark, name="Run")(C.support_factor(kws, none)) == 0.70


def test_roles_follow_the_order_of_rules(spark):
    cases = {(0, 0): "module", (2, 0): "leaf", (0, 9): "entry_point", (3, 3): "hub", (9, 2): "api_surface", (2, 2): "module"}
    for (i, o), want in cases.items():
        assert one(spark, i=i, o=o)(C.role(F.col("i"), F.col("o"))) == want


def test_test_paths(spark):
    for path, want in {"tests/a.py": True, "a/test_b.py": True, "a/b.test.ts": True, "a/b_test.py": True, "tests/conftest.py": False, "latest/a.py": False, "a/b.py": False}.items():
        assert one(spark, p=path)(C.is_test_path(F.col("p"))) == want, path


def test_external_imports(spark):
    for spec, want in {"react": True, "@a/b": True, "@a/b/c": False, "./x": False, "a/b": False}.items():
        assert one(spark, p=spec)(C.is_probable_external(F.col("p"))) == want, spec
