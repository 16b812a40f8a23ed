"""Project configuration as tables: path aliases, namespaces, modules, workspaces, and a PHP framework's routes, schema and log.

Manifests are few and small; they are read from the file table (``path, content``), never from a disk.
"""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import basename, dirname

CONFIG = "dir string, base_url string, alias string, target string"


def loads(text: str | None) -> dict:
    """FN-11: JSON with comments and trailing commas; an empty table for anything else."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text or "", flags=re.S)
    try:
        out = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def _manifests(files: DataFrame, *names: str) -> dict[str, str]:
    rows = files.filter(basename("path").isin(*names) & ~F.col("path").contains("node_modules/")).select("path", "content")
    return {r.path: r.content for r in rows.toLocalIterator()}


def path_aliases(files: DataFrame) -> DataFrame:
    """SRC-11 as ``CONFIG`` rows: a config inherits from what it extends (each once), its own options win."""
    texts = {p: c for p, c in _manifests(files, "tsconfig.json", "jsconfig.json", "tsconfig.base.json").items()}

    def options(path: str, seen: frozenset) -> dict:
        if path not in texts or path in seen:
            return {}
        doc = loads(texts[path])
        parent = doc.get("extends")
        base = {}
        if isinstance(parent, str) and parent.startswith("."):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(path), parent))
            base = options(name if name.endswith(".json") else f"{name}.json", seen | {path})
        own = doc.get("compilerOptions") or {}
        if "paths" in own or "baseUrl" in own:
            own = own | {"_dir": posixpath.dirname(path)}
        return base | own

    rows = []
    for path in sorted(texts):
        opts = options(path, frozenset())
        where, url = opts.get("_dir", posixpath.dirname(path)), opts.get("baseUrl", ".")
        for alias, targets in (opts.get("paths") or {}).items():
            rows += [(where, url, alias, t) for t in ([targets] if isinstance(targets, str) else targets)]
        if "baseUrl" in opts:
            rows.append((where, url, "*", "*"))
    return files.sparkSession.createDataFrame(rows, CONFIG)


def psr4(files: DataFrame) -> DataFrame:
    """SRC-12: ``namespace, base`` of a PHP manifest, for use and for development."""
    rows = []
    for path, text in sorted(_manifests(files, "composer.json").items()):
        doc = loads(text)
        for section in ("autoload", "autoload-dev"):
            for ns, where in ((doc.get(section) or {}).get("psr-4") or {}).items():
                rows += [(ns, posixpath.normpath(posixpath.join(posixpath.dirname(path), w))) for w in ([where] if isinstance(where, str) else where)]
    return files.sparkSession.createDataFrame(rows, "namespace string, base string")


def go_module(files: DataFrame) -> str | None:
    """SRC-13."""
    row = files.filter("path = 'go.mod'").select(F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("m")).first()
    return row.m if row and row.m else None


def source_dirs(files: DataFrame) -> DataFrame:
    """SRC-14: folders that have a ``bin`` folder, else the root."""
    found = files.filter(F.col("path").rlike("(^|/)bin/")).select(F.regexp_replace("path", r"/?bin/.*$", "").alias("dir")).distinct()
    root = files.sparkSession.createDataFrame([("",)], "dir string")
    return found.unionByName(root.join(found.limit(1).select(F.lit(1).alias("x")), how="left_anti", on=F.lit(True)))


def workspaces(files: DataFrame) -> DataFrame:
    """SRC-15 to SRC-17 and HLP-06: ``package, root, name`` of npm or yarn and cargo workspaces, else of top folders with a manifest."""
    texts = _manifests(files, "package.json", "Cargo.toml")
    dirs = {posixpath.dirname(p) for p in texts}
    patterns: list[str] = []
    root = loads(texts.get("package.json"))
    spaces = root.get("workspaces")
    spaces = spaces.get("packages", []) if isinstance(spaces, dict) else spaces or []
    patterns += [spaces] if isinstance(spaces, str) else [x if isinstance(x, str) else x.get("location", "") for x in spaces]
    cargo = re.search(r"(?ms)^\[workspace\](.*?)(?=^\[|\Z)", texts.get("Cargo.toml") or "")
    if cargo and (members := re.search(r"members\s*=\s*\[(.*?)\]", cargo[1], re.S)):
        patterns += [m for m in re.findall(r"\"([^\"]+)\"", members[1]) if "*" not in m]
    found = {d for d in dirs for p in patterns if d and re.fullmatch(re.escape(p.strip("./")).replace(r"\*\*", ".*").replace(r"\*", "[^/]*"), d)}
    if not found and not patterns:
        found = {d for d in dirs if d and "/" not in d and not d.startswith(".")}
    rows = []
    for d in sorted(found):
        name = loads(texts.get(f"{d}/package.json")).get("name") or (re.search(r'(?m)^name\s*=\s*"([^"]+)"', texts.get(f"{d}/Cargo.toml") or "") or ["", posixpath.basename(d)])[1]
        rows.append((d, d, name))
    return files.sparkSession.createDataFrame(rows, "package string, root string, name string")


def framework_overview(files: DataFrame) -> DataFrame:
    """SRC-18: one row: is it a PHP framework project, its versions, numbers of controllers, models, migrations, its route files."""
    p = F.col("path")
    manifest = F.max(F.when(p == "composer.json", F.col("content")))
    version = lambda name: F.regexp_extract(manifest, rf'"{name}"\s*:\s*"([^"]+)"', 1)
    php = p.endswith(".php")
    return files.agg(
        (F.max(F.when(p == "artisan", 1).otherwise(0)) == 1).alias("is_project"),
        version("laravel/framework").alias("framework_version"),
        version("php").alias("php_version"),
        F.count_if(p.startswith("app/Http/Controllers/") & php).alias("controllers"),
        F.count_if(p.startswith("app/Models/") & php).alias("models"),
        F.count_if(p.startswith("database/migrations/") & php).alias("migrations"),
        F.sort_array(F.collect_set(F.when(p.startswith("routes/") & php, p))).alias("route_files"),
    )


def framework_routes(files: DataFrame) -> DataFrame:
    """SRC-19: ``file, method, uri, action`` of route declarations."""
    # the verbs of a match stand in a list before the path
    pattern = r"(?s)Route::(get|post|put|patch|delete|any|options|resource|apiResource|match)\s*\(\s*(?:\[[^\]]*\]\s*,\s*)?['\"]([^'\"]+)['\"]\s*,\s*(.*?)\)\s*(?:;|->)"
    rows = files.filter(F.col("path").startswith("routes/") & F.col("path").endswith(".php"))
    parts = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), i).alias(n) for i, n in ((1, "method"), (2, "uri"), (3, "action"))])
    return rows.select(F.col("path").alias("file"), F.inline(parts)).withColumn("action", F.trim(F.regexp_replace("action", r"\s+", " ")))


def framework_schema(files: DataFrame) -> DataFrame:
    """SRC-20: ``table, type, name`` of the columns that migrations create or add."""
    rows = files.filter(F.col("path").startswith("database/migrations/"))
    block = F.lit(r"(?s)Schema::(?:create|table)\s*\(\s*['\"]([^'\"]+)['\"](.*?)\n\s*\}\s*\)")
    of = lambda x, pattern, *names: F.inline(F.arrays_zip(*[F.regexp_extract_all(x, pattern, i).alias(n) for i, n in enumerate(names, 1)]))
    blocks = rows.select(of("content", block, "table", "body"))
    return blocks.select("table", of("body", F.lit(r"\$table->(\w+)\s*\(\s*['\"](\w+)['\"]"), "type", "name"))


def recent_errors(lines: DataFrame, most: int = 80) -> DataFrame:
    """SRC-21 over ``line, text``: the last lines that speak of an error or exception, in order."""
    return lines.filter(F.col("text").contains("ERROR") | F.col("text").contains("Exception")).orderBy(F.col("line").desc()).limit(most).orderBy("line")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log file as ``line, text``; the order within a file is that of its bytes."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.posexplode(F.split("value", "\n")).alias("line", "text"))


def git_commits(spark: SparkSession, root: str, weeks: int | None = None, timeout: int = 15) -> DataFrame:
    """SRC-09 and SRC-10 from a repository: ``commit, ts, file``; an empty table where git fails."""
    import subprocess
    from datetime import datetime, timezone

    cmd = ["git", "-C", root, "log", "--name-only", "--pretty=format:%x01%H%x02%ct"] + ([f"--since={weeks} weeks ago"] if weeks else [])
    rows = []
    try:
        out = subprocess.run(cmd, capture_output=True, text=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        out = ""
    for block in out.split("\x01")[1:]:
        head, *names = block.strip("\n").split("\n")
        commit, seconds = head.split("\x02")
        rows += [(commit, datetime.fromtimestamp(int(seconds), timezone.utc).replace(tzinfo=None), n) for n in names if n]
    return spark.createDataFrame(rows, "commit string, ts timestamp_ntz, file string")
