"""Roll-ups: debt markers, hotspots and coupling, coverage, domains by keyword, overview, packages, relevance probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import classify as C
from cairn.functions.text import basename, dirname, extension, identifier_tokens, stem, token_set
from cairn.operators.graph import cut

# Tags in the order in which the pattern tries them, and what weighs more than low.
DEBT_TAGS = "TODO|FIXME|HACK|XXX|BUG|OPTIMIZE|TEMP|WORKAROUND|KLUDGE|HACKY|CLEANUP|REVISIT"
DEBT_PATTERN = rf"(?i)(?:^|\s)[#/;/*-]*\s*({DEBT_TAGS})[\s:)]*\s*(.*?)(?:\n|$|(?:--|//|#|;))"
HIGH_TAGS = ("FIXME", "BUG", "XXX")
MEDIUM_TAGS = ("HACK", "HACKY", "KLUDGE", "WORKAROUND")

# Words that show a project's domain, in order of preference on ties.
DOMAINS = {
    "calculator": "solve calculate compute eval expression parser ast tokenize matrix equation math numeric complex vector",
    "web_app": "route controller middleware handler endpoint api request response server http router",
    "e_commerce": "order payment cart checkout product inventory shipping refund invoice",
    "auth_system": "login authenticate authorization session token jwt oauth credential password user",
    "data_pipeline": "pipeline etl transform ingest stream batch queue worker job",
    "game": "entity sprite render physics collision game player score level animation canvas",
    "desktop_app": "window dialog menu toolbar statusbar widget gui app tauri electron",
    "library": "export module package publish docs example api",
    "cms": "page post content editor template theme admin blog",
    "monitoring": "telemetry metrics log trace monitor alert dashboard health",
}


def debt_markers(lines: DataFrame) -> DataFrame:
    """EXT-15 over ``file, line, text``: one row per marker. Upper or lower case, and no word end is asked for after a tag."""
    text = F.col("text")
    tags = F.regexp_extract_all(text, F.lit(DEBT_PATTERN), 1)
    notes = F.regexp_extract_all(text, F.lit(DEBT_PATTERN), 2)
    rows = lines.filter(text.rlike(rf"(?i){DEBT_TAGS}")).select("file", "line", "text", F.inline(F.arrays_zip(tags.alias("tag"), notes.alias("note"))))
    tag = F.upper("tag")
    severity = F.when(tag.isin(*HIGH_TAGS), "high").when(tag.isin(*MEDIUM_TAGS), "medium").otherwise("low")
    return rows.select("file", "line", tag.alias("tag"), severity.alias("severity"), F.substring(F.trim("note"), 1, 120).alias("note"), F.substring(F.trim("text"), 1, 200).alias("text"))


def debt_rollup(markers: DataFrame) -> DataFrame:
    """AG-09: counts by severity, by tag and in all, with the number of files, in one pass of grouping sets."""
    level = F.when(F.grouping("severity") == 0, "severity").when(F.grouping("tag") == 0, "tag").otherwise("all")
    rows = markers.groupingSets([[F.col("severity")], [F.col("tag")], []], "severity", "tag").agg(level.alias("level"), F.count("*").alias("markers"), F.countDistinct("file").alias("files"))
    return rows.select("level", F.coalesce("severity", "tag", F.lit("")).alias("key"), "markers", "files")


def debt_top_files(markers: DataFrame, most: int = 20, shown: int = 3) -> DataFrame:
    """WN-10: files by the number of high markers among their first three, then by their markers."""
    w = Window.partitionBy("file").orderBy("line", "tag", "note")
    rows = markers.withColumn("_r", F.row_number().over(w))
    by = rows.groupBy("file").agg(F.count_if((F.col("_r") <= shown) & (F.col("severity") == "high")).alias("high_shown"), F.count("*").alias("markers"))
    return by.orderBy(F.col("high_shown").desc(), F.col("markers").desc(), "file").limit(most)


def hotspots(touches: DataFrame) -> DataFrame:
    """AG-10 over ``file, commit`` within the window of interest: commits of a file over those of the busiest one."""
    per = touches.groupBy("file").agg(F.countDistinct("commit").alias("commits"))
    most = per.agg(F.max("commits").alias("most"))
    return per.crossJoin(F.broadcast(most)).select("file", "commits", F.round(F.col("commits") / F.col("most"), 6).alias("score"))


def recent_touches(commits: DataFrame, now: Column, weeks: int = 4, extensions: tuple[str, ...] = C.SOURCE_EXTENSIONS) -> DataFrame:
    """SRC-09: files touched in the last weeks, by extension, of ``commit, ts, file``."""
    return commits.filter(F.col("ts") >= now - F.make_interval(weeks=F.lit(weeks))).filter(extension("file").isin(*extensions)).select("file", "commit")


def recent_commits(commits: DataFrame, most: int = 200) -> DataFrame:
    """SRC-10: ``commit, file`` of the last ``most`` commits that touch two files or more."""
    last = commits.groupBy("commit").agg(F.max("ts").alias("ts")).orderBy(F.col("ts").desc(), F.col("commit").desc()).limit(most)
    sets = commits.join(F.broadcast(last.select("commit")), "commit", "left_semi").groupBy("commit").agg(F.collect_set("file").alias("files"))
    return sets.filter(F.size("files") >= 2).select("commit", F.explode("files").alias("file"))


def coupling(changes: DataFrame) -> DataFrame:
    """JN-22 and AG-11 over ``commit, file``: shared commits of two files over those of the one that changes less, 1 at most."""
    pairs = changes.alias("x").join(changes.alias("y"), "commit").filter("x.file < y.file").groupBy(F.col("x.file").alias("a"), F.col("y.file").alias("b")).agg(F.count("*").alias("together"))
    per = changes.groupBy("file").agg(F.count("*").alias("n"))
    both = pairs.join(per.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(per.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    score = F.round(F.least(F.lit(1.0), F.col("together") / F.least("na", "nb")), 6)
    one = both.select("a", "b", "together", score.alias("score"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "together", "score"))


def score_boost(files: DataFrame, hot: DataFrame, coupled: DataFrame, related: DataFrame) -> DataFrame:
    """AG-12: 1 + 0.40 of the hotspot score + 0.25 of the mean coupling to the related files (``file, related``)."""
    mean = related.join(coupled.select(F.col("a").alias("file"), F.col("b").alias("related"), F.col("score").alias("c")), ["file", "related"], "left").groupBy("file").agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("c"))
    rows = files.select("file").join(hot.select("file", F.col("score").alias("h")), "file", "left").join(mean, "file", "left")
    return rows.select("file", F.round(1 + 0.40 * F.coalesce("h", F.lit(0.0)) + 0.25 * F.coalesce("c", F.lit(0.0)), 6).alias("boost"))


def keyword_domain(texts: DataFrame, by: list[str], domains: dict[str, str] | None = None) -> DataFrame:
    """AG-08: per group the domain with most of its words in the text, in the table's order on ties; ``general`` if none has any."""
    table = domains or DOMAINS
    low = F.lower("text")
    scores = F.array(*[F.struct(F.lit(0).alias("unused"), sum((F.contains(low, F.lit(w)).cast("int") for w in words.split()), F.lit(0)).alias("score"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, words) in enumerate(table.items())])
    best = F.array_max(F.transform(scores, lambda x: F.struct(x["score"], x["o"], x["name"])))
    return texts.select(*by, F.when(best["score"] > 0, best["name"]).otherwise("general").alias("domain"), best["score"].alias("score"))


def test_candidates(d: Column, name: Column, ext: Column) -> Column:
    """PRJ-12: where a test of the source file ``d/name.ext`` may be: eight places beside it, six in each of four test folders."""
    dot = F.concat(F.lit("."), ext)
    beside = [F.concat(d, F.lit(f"/{pre}"), name, F.lit(post), dot) for pre, post in (("test_", ""), ("", "_test"), ("", ".test"), ("test/", ""), ("tests/", ""), ("__tests__/", ""), ("spec/", ""), ("", "_spec"))]
    away = []
    for folder in ("test", "tests", "__tests__", "spec"):
        for inner in (False, True):
            lead = F.concat(F.lit(folder + "/"), d, F.lit("/")) if inner else F.lit(folder + "/")
            away.append(F.concat(lead, F.lit("test_"), name, dot))
            away.append(F.concat(lead, name, F.lit("_test"), dot))
            away.append(F.concat(lead, name, F.lit("" if inner else ".test"), dot))
    return F.array(*beside, *away)


def source_candidate(path: Column) -> Column:
    """PRJ-13: the source file that a test file is likely to test."""
    d, ext = dirname(path), extension(path)
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem(path), r"^(test|spec)[_-]", ""), r"[_-](test|spec)$", ""), r"^_+", "")
    file = F.concat(name, F.lit("."), ext)
    framed = F.concat(F.lit("/"), d, F.lit("/"))
    out = F.when(F.lit(False), F.lit(""))
    for folder in ("test", "tests", "__tests__", "spec"):
        # inside a longer path the folder drops out; at its top the rest of the path stays
        rest = F.regexp_replace(F.replace(framed, F.lit(f"/{folder}/"), F.lit("/")), r"^/+|/+$", "")
        out = out.when(framed.contains(f"/{folder}/"), F.when(rest == "", file).otherwise(F.concat(rest, F.lit("/"), file)))
    return out.otherwise(F.concat(d, F.lit("/"), file))


def coverage(files: DataFrame, most: int = 50) -> DataFrame:
    """JN-20 and AG-17 over ``path``: one row with counts, the share of source files that have a test, and the first untested and dead ones."""
    rows = files.select("path").distinct().select("path", dirname("path").alias("d"), stem("path").alias("n"), extension("path").alias("e"), basename("path").alias("b"))
    rows = cut(rows.withColumns({"is_test": C.is_test_path(F.col("path")), "guess": source_candidate(F.col("path"))}))
    tests, sources = rows.filter("is_test"), rows.filter(~F.col("is_test") & F.col("e").isin(*C.SOURCE_EXTENSIONS))
    forward = sources.select("path", F.explode(test_candidates(F.col("d"), F.col("n"), F.col("e"))).alias("test")).join(tests.select(F.col("path").alias("test")), "test", "left_semi").select("path", "test")
    first = sources.groupBy("b").agg(F.min("path").alias("path"))
    exact = tests.select("guess", F.col("path").alias("test")).join(sources.select(F.col("path").alias("guess")), "guess", "left_semi").select(F.col("guess").alias("path"), "test")
    by_name = tests.select(F.col("path").alias("test"), basename("guess").alias("b")).join(first, "b").select("path", "test")
    links = cut(forward.unionByName(exact).unionByName(by_name).distinct())
    tested, used = links.select("path").distinct(), links.select("test").distinct()
    untested = sources.join(tested, "path", "left_anti")
    dead = tests.join(used, tests["path"] == used["test"], "left_anti")
    first = lambda rows, name: rows.select("path").orderBy("path").limit(most).agg(F.sort_array(F.collect_list("path")).alias(name))
    untested = untested.agg(F.count("*").alias("untested_files")).crossJoin(first(untested, "untested"))
    dead = dead.agg(F.count("*").alias("dead_tests")).crossJoin(first(dead, "dead"))
    n = sources.agg(F.count("*").alias("total_source_files")).crossJoin(tests.agg(F.count("*").alias("total_test_files")))
    rows = n.crossJoin(untested).crossJoin(dead).withColumn("tested_files", F.col("total_source_files") - F.col("untested_files"))
    total = F.col("total_source_files")
    return rows.withColumn("coverage_ratio", F.round(F.when(total > 0, F.col("tested_files") / total).otherwise(0.0), 4))


def overview(files: DataFrame, edges: DataFrame, most: int = 15, kinds: int = 10, hubs: int = 5) -> DataFrame:
    """AG-14 and AG-15: ``section, key, value``: totals, the most important files, the commonest types, the hubs."""
    totals = files.agg(F.count("*").cast("double").alias("files")).crossJoin(edges.agg(F.count("*").cast("double").alias("connections")))
    total = lambda name: F.struct(F.lit("total").alias("section"), F.lit(name).alias("key"), F.col(name).alias("value"))
    parts = totals.select(F.inline(F.array(total("files"), total("connections"))))
    top = files.orderBy(F.col("importance").desc(), "id").limit(most).select(F.lit("important").alias("section"), F.col("id").cast("string").alias("key"), F.col("importance").cast("double").alias("value"))
    types = files.groupBy("type").count().orderBy(F.col("count").desc(), "type").limit(kinds).select(F.lit("type").alias("section"), F.col("type").alias("key"), F.col("count").cast("double").alias("value"))
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).groupBy("id").count().orderBy(F.col("count").desc(), "id").limit(hubs)
    return parts.unionByName(top).unionByName(types).unionByName(ends.select(F.lit("hub").alias("section"), F.col("id").cast("string").alias("key"), F.col("count").cast("double").alias("value")))


def edge_statistics(edges: DataFrame) -> DataFrame:
    """AG-14: how many edges of which kind."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return edges.agg(F.count("*").alias("connections"), kind("calls-symbol").alias("calls"), kind("calls-symbol-local").alias("local_calls"), kind("imports-symbol").alias("named_imports"))


def folders(path: str) -> Column:
    """All folders above a path, the root (an empty string) among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def project_domain(files: DataFrame) -> DataFrame:
    """AG-08 over a whole project (``text``): a domain's score is the number of its words that any file has; no text leaves its row."""
    low = F.lower("text")
    found = files.agg(*[F.coalesce(F.max(F.contains(low, F.lit(w)).cast("int")), F.lit(0)).alias(f"{name}:{w}") for name, words in DOMAINS.items() for w in words.split()])
    scores = [F.struct(sum((F.col(f"`{name}:{w}`") for w in words.split()), F.lit(0)).alias("score"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, words) in enumerate(DOMAINS.items())]
    best = F.array_max(F.array(*scores))
    return found.select(F.when(best["score"] > 0, best["name"]).otherwise("general").alias("domain"), best["score"].alias("score"))


def package_summary(packages: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """AG-27: files, lines, symbols and inner edges of each workspace package (``package, root``), by the longest root that holds a file."""
    held = files.withColumn("root", F.explode(folders("id"))).join(packages, "root")
    own = held.groupBy("id").agg(F.max_by("package", F.length("root")).alias("package"), F.first("lines").alias("lines"), F.first("symbols").alias("symbols"))
    inner = edges.join(own.select(F.col("id").alias("source"), F.col("package").alias("p")), "source").join(own.select(F.col("id").alias("target"), F.col("package").alias("q")), "target").filter("p = q").groupBy(F.col("p").alias("package")).agg(F.count("*").alias("edges"))
    rows = own.groupBy("package").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("symbols").alias("symbols"))
    return rows.join(inner, "package", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def package_edges(packages: DataFrame, files: DataFrame, chars: int = 10_000) -> DataFrame:
    """JN-21: packages whose name stands in the first characters of another package's source files. Names are searched for in heads, so they are
    broadcast if Spark finds them small, and met in blocks if not."""
    own = files.withColumn("root", F.explode(folders("path"))).join(packages.select(F.col("package").alias("source"), "root"), "root")
    head = own.select("source", F.substring("content", 1, chars).alias("head"))
    other = packages.select(F.col("package").alias("target"), F.col("name").alias("target_name"))
    return head.join(other, (F.col("source") != F.col("target")) & F.contains("head", F.col("target_name"))).select("source", "target").distinct()


def probe(symbols: DataFrame, tasks: DataFrame) -> DataFrame:
    """AG-24: how much of the symbols a task's keywords match: HIGH over 5 %, MEDIUM over 1 % or with any match, else LOW. ``tasks(task_id, kws)``."""
    tok = symbols.select(F.array_distinct(F.concat(identifier_tokens("name"), identifier_tokens("file"))).alias("t"))
    hit = tok.crossJoin(F.broadcast(tasks)).groupBy("task_id").agg(F.count("*").alias("total"), F.count_if(F.arrays_overlap("t", "kws")).alias("matched"))
    share = F.col("matched") / F.greatest(F.col("total"), F.lit(1))
    level = F.when(share > 0.05, "HIGH").when((share > 0.01) | (F.col("matched") > 0), "MEDIUM").otherwise("LOW")
    return hit.withColumn("relevance", level)


def file_search(files: DataFrame, keyword: str) -> DataFrame:
    """AG-25 over ``id, summary, names, imports``: path 3, summary 2, 1 for each symbol that matches, imports 1; files without points are left out."""
    k = F.lit(keyword.lower())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), k)
    points = F.when(has("id"), 3).otherwise(0) + F.when(has("summary"), 2).otherwise(0) + F.size(F.filter("names", has)) + F.when(F.exists("imports", has), 1).otherwise(0)
    return files.withColumn("points", points).filter("points > 0")


def focused_files(files: DataFrame, kws: list[str], semantic: DataFrame | None = None) -> DataFrame:
    """AG-26: points per keyword (path 3, summary 2, any symbol 2, any import 1), twice the importance, five times the best semantic hit of the file."""
    has = lambda k: lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(k.lower()))
    points = F.lit(0)
    for k in kws:
        points = points + F.when(has(k)(F.col("id")), 3).otherwise(0) + F.when(has(k)(F.col("summary")), 2).otherwise(0)
        points = points + F.when(F.exists("names", has(k)), 2).otherwise(0) + F.when(F.exists("imports", has(k)), 1).otherwise(0)
    rows = files.withColumn("points", points.cast("double"))
    if semantic is not None:
        best = semantic.groupBy("id").agg(F.max("similarity").alias("sim"))
        rows = rows.join(best, "id", "left").withColumn("points", F.col("points") + 5 * F.coalesce("sim", F.lit(0.0))).drop("sim")
    return rows.filter("points > 0").withColumn("score", F.round(F.col("points") + 2 * F.coalesce("importance", F.lit(0.0)), 6))


def find_symbols(symbols: DataFrame, query: str, most: int = 15) -> DataFrame:
    """FLT-22: symbols whose name has the query in it."""
    return symbols.filter(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy(F.col("rank").desc(), "id").limit(most)


def regex_symbols(symbols: DataFrame, pattern: str, kind: str | None = None, most: int = 20) -> DataFrame:
    """FLT-21: symbols whose name matches a pattern in either case; a bad pattern is the caller's error."""
    rows = symbols.filter(F.col("name").rlike(f"(?i){pattern}"))
    return (rows.filter(F.lower("kind") == kind.lower()) if kind else rows).orderBy(F.col("rank").desc(), "id").limit(most)


def resolve_symbol(symbols: DataFrame, query: str) -> DataFrame:
    """FLT-23: the symbol of that id or name, else the first whose id has it; by rank."""
    q = query.lower()
    cls = F.when((F.lower("id") == q) | (F.lower("name") == q), 0).when(F.contains(F.lower("id"), F.lit(q)), 1)
    return symbols.withColumn("_c", cls).filter("_c is not null").orderBy("_c", F.col("rank").desc(), "id").limit(1).drop("_c")


def missing_keywords(symbols: DataFrame, task: DataFrame) -> DataFrame:
    """SO-04: ``keyword`` of a task (``kws``) that no symbol has among its tokens."""
    words = task.select(F.explode("kws").alias("keyword")).distinct()
    tokens = symbols.select(F.explode(token_set("id", "name", "file", "kind", "signature")).alias("keyword"))
    return words.join(tokens, "keyword", "left_anti")


def safeguards(domain: Column, languages: Column) -> Column:
    """PRJ-17: which rules of care apply: always structure first and small scope, types with Rust, numerics with simulations."""
    rust = F.array_contains(languages, "rs")
    numeric = domain.isin("scientific_computing", "calculator") | F.lower(domain).rlike("sim|circuit|solver|math")
    rules = F.array(F.lit("structure_first"), F.when(rust, "scope_rust").otherwise("scope"), F.when(rust, "types_rust"), F.when(numeric, "damping"), F.when(numeric, "stamp_signs"), F.when(numeric, "index_base"))
    return F.filter(rules, lambda r: r.isNotNull())
