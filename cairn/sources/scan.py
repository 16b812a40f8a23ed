"""File scans: listing, skip rules, ignore files, hashes, incremental state, and the sinks beside them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.text import basename, extension

from .extract import decode

MAX_BYTES = 2_000_000
# Fixed values.
EXTENSIONS = tuple("py js ts jsx tsx sql c cpp h hpp java go rs php rb cs sh bat ps1 swift kt scala ex exs lua r jl".split())
DOCUMENT_EXTENSIONS = tuple("md json yaml yml toml ini xml html css".split())
SKIP_DIRS = tuple("__pycache__ .git node_modules venv .venv dist build .next target .cache coverage .pytest_cache .agents vendor bin obj .idea .vs".split())
KEPT_DOT_DIRS = (".github", ".vscode")

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("length", T.LongType()), T.StructField("hash", T.StringType())])


def glob_regex(pattern: str) -> str:
    """A path pattern of an ignore file as a regular expression on relative paths."""
    anchored, folder = "/" in pattern.rstrip("/"), pattern.endswith("/")
    p, out, i = pattern.strip("/"), "", 0
    while i < len(p):
        if p.startswith("**", i):
            i += 2
            if p.startswith("/", i):
                out, i = out + "(?:.*/)?", i + 1
            else:
                out += ".*"
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i:]:
            end = p.index("]", i)
            out, i = out + "[" + p[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """SRC-04: the last pattern that matches decides; one with ``!`` takes a path back in."""
    out = F.lit(False)
    for line in patterns:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        out = F.when(path.rlike(glob_regex(line.lstrip("!"))), F.lit(not keep)).otherwise(out)
    return out


def skipped(path: Column, length: Column, documents: bool = False, skip_files: tuple[str, ...] = (), patterns: list[str] | None = None) -> Column:
    """SRC-03: ignored and hidden folders, ignored files, foreign extensions, files over two million bytes."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    bad_dir = F.exists(dirs, lambda d: d.isin(*SKIP_DIRS) | (d.startswith(".") & ~d.isin(*KEPT_DOT_DIRS, ".", "..")))
    wanted = extension(path).isin(*EXTENSIONS, *(DOCUMENT_EXTENSIONS if documents else ()))
    out = bad_dir | ~wanted | (length > MAX_BYTES)
    if skip_files:
        out = out | basename(path).isin(*skip_files)
    return out | ignored(path, patterns) if patterns else out


def scan_files(spark: SparkSession, root: str, documents: bool = False, patterns: list[str] | None = None) -> DataFrame:
    """SRC-01: ``path, content, length, hash`` of the files under a root. Size and path rules come before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(re.sub(r"^file:/*", "/", root).rstrip("/"))
    rows = raw.filter(F.col("length") <= MAX_BYTES).withColumn("rel", F.regexp_replace("path", rf"^(?:\w+:/*)?/?{base.lstrip('/')}/+", ""))
    rows = rows.filter(~skipped(F.col("rel"), F.col("length"), documents, patterns=patterns))
    return decoded(rows.select(F.col("rel").alias("path"), "content", "length", F.sha2("content", 256).alias("hash")))


def decoded(files: DataFrame) -> DataFrame:
    """SRC-05: ``content`` from bytes to text in the first encoding that reads them; the other columns pass through."""
    names, kinds = files.columns, {f.name: f.dataType.simpleString() for f in files.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([decode(x) for x in b.column("content").to_pylist()], pa.string())
            yield pa.record_batch([text if n == "content" else b.column(n) for n in names], names)

    return files.mapInArrow(run, ", ".join(f"`{n}` {'string' if n == 'content' else kinds[n]}" for n in names))


def from_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """The same columns from (path, content) pairs."""
    files = spark.createDataFrame(rows, "path string, content string")
    return files.select("path", "content", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("hash"))


def refresh(state: DataFrame, listing: DataFrame) -> DataFrame:
    """SRC-02 and SRC-07: ``path, status`` of a cached state against a listing (both ``path, hash``): kept, changed, added, removed."""
    a, b = state.select("path", F.col("hash").alias("_a")), listing.select("path", F.col("hash").alias("_b"))
    status = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").when(F.col("_a") == F.col("_b"), "kept").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def incremental(state: DataFrame, listing: DataFrame, parse) -> DataFrame:
    """Parsed rows of the new listing: those of unchanged files from the state, the others parsed anew. ``state`` has ``path, hash`` and what ``parse`` gives."""
    status = refresh(state, listing)
    kept = state.join(status.filter("status = 'kept'"), "path", "left_semi")
    fresh = parse(listing.join(status.filter("status in ('changed', 'added')"), "path", "left_semi"))
    return kept.unionByName(fresh)


def write_graph(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """SNK-01: a Parquet table for each part of a graph."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """SRC-08."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_json_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """SNK-01 as JSON: one folder of JSON lines per part."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """SNK-02, SNK-03, SNK-06, SNK-07: a report that the driver holds as one string, to any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def render_html(bundle: dict, template: str | None = None) -> str:
    """SNK-04: a graph as JSON in a page; closing script tags in it are escaped."""
    page = template or "<!doctype html><meta charset=utf-8><title>graph</title><pre id=out></pre><script>const GRAPH = __DATA__;document.getElementById('out').textContent = JSON.stringify(GRAPH, null, 1);</script>"
    return page.replace("__DATA__", json.dumps(bundle, ensure_ascii=False).replace("</", "<\\/"))


def save_snapshot(snapshot: DataFrame, path: str) -> None:
    """SNK-05 and SNK-09."""
    snapshot.write.mode("overwrite").parquet(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """SRC-22: labelled cases of a JSON document, one row each; other names of fields are accepted."""
    rows = spark.read.option("multiLine", "true").json(path).select(F.explode("cases").alias("c")).select("c.*")
    alias = {"must": ("must_include", "must_include_ids", "expected_top_symbols"), "must_not": ("must_not_include", "must_not_include_ids", "forbidden_top_symbols"), "budget": ("budget", "max_tokens"), "case_id": ("id", "case_id")}
    for name, options in alias.items():
        have = [F.col(o) for o in options if o in rows.columns]
        if have:
            rows = rows.withColumn(name, F.coalesce(*have))
    return rows
