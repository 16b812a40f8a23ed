"""Import resolution and symbol edges, as candidate generation and prioritised equi-joins.

Each import makes an array of candidate paths in order of priority; one join with the file list
keeps the candidates that exist, and the first of them wins. No import is searched for in a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import classify as C
from cairn.functions.text import basename, dirname, normalize_path, strings
from cairn.operators.graph import closure

from .extract import NOISE_ROOTS

# Extensions tried after a bare path, in order.
PROBED = tuple(".ts .tsx .js .jsx .mjs .cjs .py .php .json .rs .go .java .cs".split())
# Base names that many files share.
AMBIGUOUS = tuple("index main utils helpers types constants config app models __init__".split())


def probe_paths(base: Column) -> Column:
    """JN-03: a path as it is, with each extension, and as a folder's index."""
    named = F.concat(F.array(base), F.transform(strings(PROBED), lambda e: F.concat(base, e)))
    index = F.transform(strings(PROBED), lambda e: F.concat(base, F.lit("/index"), e))
    return F.when(basename(base).contains("."), named).otherwise(F.concat(named, index))


def relative_base(file: Column, spec: Column) -> Column:
    return normalize_path(F.concat_ws("/", F.nullif(dirname(file), F.lit("")), spec))


def python_relative(file: Column, spec: Column) -> Column:
    """``..pkg.mod`` from a file: one folder up for each dot after the first."""
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    rest = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    return normalize_path(F.concat(F.coalesce(F.nullif(dirname(file), F.lit("")), F.lit(".")), F.lit("/"), up, rest))


def python_paths(base: Column) -> Column:
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))


def rust_paths(file: Column, spec: Column, crate: Column) -> Column:
    """JN-05: ``crate``, ``super`` and ``self`` paths: the module's file, its ``mod.rs``, ``lib.rs``, then the parent module's."""
    parts = F.split(spec, "::")
    own_dir = F.when(basename(file).isin("mod.rs", "lib.rs", "main.rs"), dirname(file)).otherwise(F.regexp_replace(file, r"\.rs$", ""))
    root = F.when(parts[0] == "crate", F.concat_ws("/", F.nullif(crate, F.lit("")), F.lit("src"))).when(parts[0] == "super", dirname(own_dir)).otherwise(own_dir)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    path = lambda n: F.concat_ws("/", F.nullif(root, F.lit("")), F.array_join(F.slice(inner, F.lit(1), F.greatest(n, F.lit(0))), "/"))
    clean = lambda p: F.regexp_replace(p, "/+$", "")
    whole, parent = clean(path(F.size(inner))), clean(path(F.size(inner) - 1))
    of = lambda p: F.array(F.concat(p, F.lit(".rs")), F.concat(p, F.lit("/mod.rs")), F.concat(p, F.lit("/lib.rs")))
    return F.concat(of(whole), of(parent))


def crate_roots(files: DataFrame) -> DataFrame:
    """The nearest folder with a Cargo manifest over each Rust file: ``path, crate``."""
    roots = files.filter(basename("path") == "Cargo.toml").select(dirname("path").alias("crate"))
    rust = files.filter(F.col("path").endswith(".rs")).select("path")
    segs = F.split("path", "/")
    ups = rust.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(segs) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("crate"))
    return ups.join(roots, "crate").groupBy("path").agg(F.max_by("crate", F.length("crate")).alias("crate"))


def alias_candidates(imports: DataFrame, configs: DataFrame) -> DataFrame:
    """JN-06: ``file, ord, base, rank`` of imports under path aliases (``dir, base_url, alias, target``): configs that hold the file first, the longest folder, then their order. The part before the star is met by an equality on the prefixes of the import."""
    pre, post = F.substring_index("alias", "*", 1), F.when(F.contains(F.col("alias"), F.lit("*")), F.substring_index("alias", "*", -1)).otherwise("")
    order = F.struct("dir", "alias", "target")
    c = configs.withColumns({"pre": pre, "post": post, "no": order})
    star = F.contains(F.col("alias"), F.lit("*"))
    fits = F.when(star, F.startswith("source", "pre") & F.endswith("source", "post") & (F.length("source") >= F.length("pre") + F.length("post"))).otherwise(F.col("source") == F.col("alias"))
    heads = F.transform(F.sequence(F.lit(0), F.length("source")), lambda n: F.substring(F.col("source"), F.lit(1), n))
    hit = imports.withColumn("pre", F.explode(heads)).join(c, "pre").filter(fits)
    middle = F.substring(F.col("source"), F.length("pre") + 1, F.length("source") - F.length("pre") - F.length("post"))
    base = normalize_path(F.concat_ws("/", "dir", "base_url", F.when(star, F.concat(F.substring_index("target", "*", 1), middle, F.when(F.contains(F.col("target"), F.lit("*")), F.substring_index("target", "*", -1)).otherwise(""))).otherwise(F.col("target"))))
    holds = (F.col("dir") == "") | F.startswith("file", F.concat("dir", F.lit("/")))
    w = Window.partitionBy("file", "ord").orderBy(holds.desc(), F.length("dir").desc(), "no")
    return hit.withColumn("rank", F.row_number().over(w)).select("file", "ord", base.alias("base"), "rank")


def namespace_candidates(imports: DataFrame, namespaces: DataFrame) -> DataFrame:
    """JN-07: ``file, ord, base, rank`` by the longest namespace prefix (``namespace, base``)."""
    ns = namespaces.select(F.regexp_replace("namespace", r"\\+$", "").alias("ns"), F.regexp_replace("base", "/+$", "").alias("dir"))
    parts = F.split("source", r"\\")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "\\"))
    hit = imports.withColumn("ns", F.explode(heads)).join(ns, "ns")  # every prefix of whole segments, so the join is an equality
    rest = F.replace(F.substring(F.col("source"), F.length("ns") + 2, F.length("source")), F.lit("\\"), F.lit("/"))
    w = Window.partitionBy("file", "ord").orderBy(F.length("ns").desc(), "ns")
    return hit.withColumn("rank", F.row_number().over(w)).select("file", "ord", F.concat_ws("/", F.nullif("dir", F.lit("")), rest).alias("base"), "rank")


def suffix_index(files: DataFrame) -> DataFrame:
    """JN-04: every path suffix of each Python module: ``suffix, path``; shallow, short and small paths first."""
    base = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/__init__$", "")
    rows = files.filter(F.col("path").endswith(".py")).select("path", base.alias("base"))
    segs = F.split("base", "/")
    ups = rows.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.array_join(F.slice(F.split("base", "/"), n, F.size(F.split("base", "/"))), "/"))).alias("suffix"))
    w = Window.partitionBy("suffix").orderBy(F.size(F.split("path", "/")), F.length("path"), "path")
    return ups.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("suffix", "path")


def resolve(records: DataFrame, files: DataFrame, configs: DataFrame | None = None, namespaces: DataFrame | None = None, go_module: str | None = None) -> DataFrame:
    """JN-02: ``file, ord, target`` of each import record that names a file; other records are missing. ``records``: file, ord, source, kind."""
    paths = files.select("path").distinct()
    f, s = F.col("file"), F.col("source")
    ext = F.regexp_extract(f, r"\.([^./]+)$", 1)
    dotted = F.replace(s, F.lit("."), F.lit("/"))
    none = F.array().cast("array<string>")
    rows = records.join(crate_roots(files).withColumnRenamed("path", "file"), "file", "left").withColumn("crate", F.coalesce("crate", F.lit("")))
    by_rule = (
        F.when(F.col("kind") == "rust-use", F.when(s.rlike("^(crate|super|self)(::|$)"), rust_paths(f, s, F.col("crate"))).otherwise(none))
        .when((ext == "py") & s.startswith("."), python_paths(python_relative(f, s)))
        .when(s.startswith("."), probe_paths(relative_base(f, s)))
        .when(ext == "py", python_paths(dotted))
        .when(ext == "java", F.array(F.concat(dotted, F.lit(".java")), F.concat(F.lit("src/main/java/"), dotted, F.lit(".java"))))
        .when(ext == "cs", F.array(F.concat(dotted, F.lit(".cs"))))
        .otherwise(probe_paths(s))
    )
    if go_module:
        inner = F.regexp_replace(F.substring(s, F.lit(len(go_module) + 1), F.length(s)), "^/", "")
        by_rule = F.when((ext == "go") & s.startswith(go_module), probe_paths(inner)).otherwise(by_rule)
    options = rows.select("file", "ord", F.posexplode(by_rule).alias("n", "cand")).select("file", "ord", (F.col("n") + 1_000_000).alias("rank"), "cand")
    for extra, start in ((alias_candidates(records, configs) if configs is not None else None, 0), (namespace_candidates(records, namespaces) if namespaces is not None else None, 500_000)):
        if extra is not None:
            more = extra.select("file", "ord", "rank", F.posexplode(probe_paths(F.col("base"))).alias("n", "cand"))
            options = options.unionByName(more.select("file", "ord", (F.lit(start) + F.col("rank") * 1000 + F.col("n")).cast("int").alias("rank"), "cand"))
    found = options.join(paths.withColumnRenamed("path", "cand"), "cand", "left_semi")
    modules = suffix_index(files)
    late = records.filter(F.col("file").endswith(".py") & ~s.startswith(".")).select("file", "ord", dotted.alias("suffix")).join(modules, "suffix").select("file", "ord", F.lit(2_000_000).alias("rank"), F.col("path").alias("cand"))
    return found.unionByName(late).groupBy("file", "ord").agg(F.min_by("cand", F.struct("rank", "cand")).alias("target"))


def file_edges(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """JN-01: one edge per pair of files; the first record wins."""
    rows = records.join(resolved, ["file", "ord"]).filter("file <> target")
    w = Window.partitionBy("file", "target").orderBy("ord")
    first = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return first.select(F.col("file").alias("source"), "target", F.col("source").alias("import"), "line", "kind", "specifiers")


def unresolved(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """FLT-07: records that name no file, but neither a URL nor a package from outside nor noise."""
    rows = records.join(resolved, ["file", "ord"], "left_anti")
    root = F.regexp_replace(F.substring_index("source", "/", 1), "^@", "")
    return rows.filter(~F.col("source").rlike("^(?i)(https?:)?//") & ~C.is_probable_external(F.col("source")) & ~F.lower(root).isin(*sorted(NOISE_ROOTS))).select("file", "source", "line")


def classic_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """JN-09 over ``file, import``: files that share the import's last segment or path, nearest folder first; ambiguous names keep only the best."""
    clean = F.regexp_replace(F.replace("import", F.lit("."), F.lit("/")), "^/+|/+$", "")
    want = imports.select("file", "import", clean.alias("clean")).withColumn("base", F.element_at(F.split("clean", "/"), -1))
    bare = F.regexp_replace("path", r"(?<=.)\.[^./]+$", "")
    have = files.select("path", bare.alias("bare")).withColumn("base", F.element_at(F.split("bare", "/"), -1))
    hit = want.join(have, "base").filter((F.col("file") != F.col("path")) & F.endswith("bare", "clean"))
    near = F.when(dirname("file") == dirname("path"), 3).when(F.startswith(F.concat(dirname("file"), F.lit("/")), F.concat(dirname("path"), F.lit("/"))) | F.startswith(F.concat(dirname("path"), F.lit("/")), F.concat(dirname("file"), F.lit("/"))), 2).otherwise(1)
    w = Window.partitionBy("file", "import").orderBy(near.desc(), "path")
    rows = hit.withColumns({"_r": F.row_number().over(w), "proximity": near})
    return rows.filter(~F.col("base").isin(*AMBIGUOUS) | (F.col("_r") == 1)).select(F.col("file").alias("source"), F.col("path").alias("target"), "proximity").distinct()


def direct_exports(parsed: DataFrame, symbols: DataFrame) -> DataFrame:
    """JN-10: ``file, name, symbol`` of what a file exports itself; ``default`` is its first exported symbol."""
    named = parsed.select("file", F.explode("exports").alias("name")).join(symbols.select("file", "name", "id"), ["file", "name"]).select("file", "name", F.col("id").alias("symbol"))
    flagged = symbols.filter("exported").select("file", "name", F.col("id").alias("symbol"))
    has_default = parsed.filter(F.array_contains("exports", "default")).select("file")
    first = symbols.filter("exported").join(has_default, "file", "left_semi").groupBy("file").agg(F.min_by("id", F.struct("line", "id")).alias("symbol")).select("file", F.lit("default").alias("name"), "symbol")
    return named.unionByName(flagged).unionByName(first).distinct()


def export_index(parsed: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """JN-11: exports with everything that re-exports pass on."""
    spec = edges.filter("kind = 're-export'").select(F.col("source").alias("file"), "target", F.explode("specifiers").alias("s"))
    return closure(direct_exports(parsed, symbols), spec.select("file", "target", F.col("s.imported").alias("imported"), F.col("s.local").alias("exported")))


def import_edges(symbols: DataFrame, edges: DataFrame, exports: DataFrame) -> DataFrame:
    """JN-12: from the exported symbols of the importing file (its first one if none is) to each imported symbol, once per pair and names."""
    own = symbols.filter("exported").select("file", F.col("id").alias("from_id"))
    bare = symbols.join(own.select("file").distinct(), "file", "left_anti").groupBy("file").agg(F.min_by("id", F.struct("line", "id")).alias("from_id"))
    ends = own.unionByName(bare)
    want = edges.select(F.col("source").alias("file"), "target", "line", F.explode("specifiers").alias("s")).select("file", "target", "line", "s.*")
    same = (F.col("w.imported") == F.col("e.name")) | (F.col("w.imported") == "*")
    hit = want.alias("w").join(exports.alias("e"), (F.col("w.target") == F.col("e.file")) & same)
    hit = hit.select(F.col("w.file").alias("file"), F.col("w.target").alias("target_file"), F.col("w.line").alias("line"), F.col("e.name").alias("imported"), F.when(F.col("w.imported") == "*", F.col("e.name")).otherwise(F.col("w.local")).alias("local"), F.col("e.symbol").alias("to_id"))
    rows = hit.join(ends, "file").groupBy("from_id", "to_id", "imported", "local").agg(F.min(F.struct("line", "file", "target_file")).alias("m"))
    return rows.select(F.col("from_id").alias("source"), F.col("to_id").alias("target"), "imported", "local", F.col("m.file").alias("source_file"), F.col("m.target_file").alias("target_file"), F.col("m.line").alias("line"), F.lit("imports-symbol").alias("kind"))


def call_edges(symbols: DataFrame, edges: DataFrame, exports: DataFrame, kinds: tuple[str, ...] = ("import",)) -> DataFrame:
    """JN-13 and JN-14: calls by local name, by namespace, by a class of the file, by ``self`` and ``this``.

    ``symbols`` has ``id, file, name, line, end_line, calls``. For one (qualifier, member) of a file a later rule overrides an
    earlier one: imported, then same file, then self; a call to oneself is none."""
    calls = symbols.select(F.col("id").alias("caller"), "file", F.explode(F.array_distinct("calls")).alias("call"))
    parts = F.split(F.replace("call", F.lit("::"), F.lit(".")), r"\.")
    calls = calls.select("caller", "file", F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("").alias("qualifier"), F.element_at(parts, -1).alias("member"))
    spec = edges.filter(F.col("kind").isin(*kinds)).select(F.col("source").alias("file"), F.col("target").alias("from_file"), F.explode("specifiers").alias("s")).select("file", "from_file", "s.imported", "s.local")
    offers = exports.select(F.col("file").alias("from_file"), F.col("name").alias("offered"), "symbol")
    single = spec.filter("imported <> '*'").join(offers, "from_file").filter("imported = offered").select("file", F.lit("").alias("qualifier"), F.col("local").alias("member"), "symbol", F.lit(1).alias("p"))
    space = spec.filter("imported = '*'").join(offers, "from_file").select("file", F.col("local").alias("qualifier"), F.col("offered").alias("member"), "symbol", F.lit(1).alias("p"))
    # members of an imported class: Type.method
    inner = symbols.select(F.col("file").alias("from_file"), F.col("name").alias("member"), F.col("id").alias("symbol"))
    typed = spec.filter("imported <> '*'").join(inner, "from_file").select("file", F.col("local").alias("qualifier"), "member", "symbol", F.lit(0).alias("p"))
    here = symbols.select("file", F.lit("").alias("qualifier"), F.col("name").alias("member"), F.col("id").alias("symbol"), F.lit(2).alias("p"))
    classes = symbols.filter("kind = 'class'").select("file", F.col("name").alias("qualifier"))
    own = classes.join(symbols.select("file", F.col("name").alias("member"), F.col("id").alias("symbol")), "file").select("file", "qualifier", "member", "symbol", F.lit(2).alias("p"))
    selfs = symbols.select("file", F.explode(strings(("self", "this", "cls", "Self"))).alias("qualifier"), F.col("name").alias("member"), F.col("id").alias("symbol"), F.lit(3).alias("p"))
    known = single
    for part in (space, typed, here, own, selfs):
        known = known.unionByName(part)
    known = known.groupBy("file", "qualifier", "member").agg(F.max_by("symbol", F.struct("p", "symbol")).alias("symbol"))
    hit = calls.join(known, ["file", "qualifier", "member"]).filter("caller <> symbol")
    target_file = F.substring_index("symbol", "::", 1)
    kind = F.when(target_file == F.col("file"), "calls-symbol-local").otherwise("calls-symbol")
    return hit.select(F.col("caller").alias("source"), F.col("symbol").alias("target"), F.col("member").alias("imported"), F.col("member").alias("local"), F.col("file").alias("source_file"), target_file.alias("target_file"), kind.alias("kind"), (F.col("qualifier") != "").alias("qualified")).distinct()
