"""The engine: a source tree (or any table shaped like one) as DataFrames, and the queries on them.

Each method is one lazily planned DataFrame; what is iterated (ranks, closures) is materialised once
per engine.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import classify as C
from cairn.functions import text as T
from cairn.operators import graph, pack, rollup, score, select, semantic, snippet
from cairn.sources import extract, projects, resolve, scan


class Engine:
    """``files`` has ``path, content`` (and ``length, hash`` where known)."""

    def __init__(self, spark: SparkSession, source: DataFrame, hotspots: DataFrame | None = None, synonyms: dict | None = None, count_tokens: Callable[[Column], Column] = T.estimate_tokens):
        """UD-01: ``count_tokens`` turns a text column into its number of tokens (any column function, a pandas UDF over a tokenizer too)."""
        self.spark, self.source, self.hot, self.synonyms, self.count_tokens = spark, source, hotspots, synonyms, count_tokens

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, **options) -> Engine:
        return cls(spark, scan.scan_files(spark, root), **options)

    @cached_property
    def parsed(self) -> DataFrame:
        code = self.source.filter(~scan.skipped(F.col("path"), F.octet_length("content")))
        return graph.cut(extract.parse_files(code))

    @cached_property
    def records(self) -> DataFrame:
        return extract.record_rows(self.parsed)

    @cached_property
    def resolved(self) -> DataFrame:
        aliases, namespaces = projects.path_aliases(self.source), projects.psr4(self.source)
        return graph.cut(resolve.resolve(self.records, self.source, aliases, namespaces, projects.go_module(self.source)))

    @cached_property
    def file_edges(self) -> DataFrame:
        return graph.cut(resolve.file_edges(self.records, self.resolved))

    @cached_property
    def unresolved(self) -> DataFrame:
        return resolve.unresolved(self.records, self.resolved)

    @cached_property
    def files(self) -> DataFrame:
        """Files with rank, importance and role."""
        nodes = self.parsed.select(F.col("file").alias("id"), F.col("n_lines").alias("lines"), F.size("symbols").alias("symbols"), "summary", "imports", F.transform("symbols", lambda s: s["name"]).alias("names"))
        rank = graph.pagerank(nodes, self.file_edges).withColumnRenamed("rank", "pagerank")
        rows = nodes.join(rank, "id")
        rows = rows.join(graph.importance(rows.select("id", "lines", "symbols", "pagerank"), self.file_edges).select("id", "importance"), "id")
        rows = rows.join(graph.roles(nodes, self.file_edges).select("id", "role"), "id")
        return graph.cut(rows.withColumn("type", T.extension("id")))

    @cached_property
    def _raw_symbols(self) -> DataFrame:
        rows = extract.symbol_rows(self.parsed)
        return graph.cut(rows)

    @cached_property
    def exports(self) -> DataFrame:
        return graph.cut(resolve.export_index(self.parsed, self._raw_symbols, self.file_edges))

    @cached_property
    def symbol_edges(self) -> DataFrame:
        imports = resolve.import_edges(self._raw_symbols, self.file_edges, self.exports).withColumn("qualified", F.lit(False))
        calls = resolve.call_edges(self._raw_symbols, self.file_edges, self.exports).withColumn("line", F.lit(None).cast("int"))
        return graph.cut(imports.unionByName(calls))

    @cached_property
    def symbols(self) -> DataFrame:
        """Ranked symbols."""
        resolved = self.file_edges.groupBy(F.col("source").alias("file")).agg(F.count("*").alias("resolved_imports"))
        files = self.files.select(F.col("id").alias("file"), F.when(F.col("pagerank") != 0, F.col("pagerank")).otherwise(F.col("importance")).alias("file_rank"), "role")
        base = self._raw_symbols.select("id", "name", "kind", "file", F.col("line").alias("start_line"), "end_line", "signature", "exported")
        rows = graph.symbol_degrees(base, self.symbol_edges).join(files, "file").join(resolved, "file", "left").withColumn("resolved_imports", F.coalesce("resolved_imports", F.lit(0)))
        rank = graph.symbol_rank(F.col("file_rank"), F.col("exported"), F.col("incoming_file_imports"), F.col("inbound_calls"))
        return graph.cut(rows.withColumn("rank", rank))

    @cached_property
    def lines(self) -> DataFrame:
        return self.source.select(F.col("path").alias("file"), F.posexplode(snippet.lines_of(F.col("content"))).alias("n", "text")).select("file", (F.col("n") + 1).alias("line"), "text")

    # reports

    def overview(self) -> DataFrame:
        return rollup.overview(self.files, self.file_edges)

    def coverage(self) -> DataFrame:
        return rollup.coverage(self.source.select("path"))

    def debt(self) -> DataFrame:
        return rollup.debt_markers(self.lines)

    def communities(self) -> DataFrame:
        members = graph.communities(self.files, self.file_edges)
        return members.join(graph.community_labels(members), "community")

    def cycles(self) -> DataFrame:
        return graph.cycles(self.file_edges)

    def domain(self) -> DataFrame:
        text = F.concat_ws(" ", F.array_join("names", " "), F.array_join("imports", " "), "summary")
        return rollup.project_domain(self.files.select(text.alias("text")))

    def packages(self) -> DataFrame:
        return rollup.package_summary(projects.workspaces(self.source), self.files, self.file_edges)

    def package_edges(self) -> DataFrame:
        return rollup.package_edges(projects.workspaces(self.source), self.source)

    def statistics(self) -> DataFrame:
        """AG-14."""
        one = lambda df, name: df.agg(F.count("*").alias(name))
        calls = rollup.edge_statistics(self.symbol_edges).drop("connections")
        return one(self.files, "total_files").crossJoin(one(self.file_edges, "connections")).crossJoin(one(self.symbols, "total_symbols")).crossJoin(calls).crossJoin(one(self.unresolved, "unresolved_imports"))

    # lookups

    def find_symbols(self, query: str) -> DataFrame:
        return rollup.find_symbols(self.symbols, query)

    def regex_symbols(self, pattern: str, kind: str | None = None) -> DataFrame:
        return rollup.regex_symbols(self.symbols, pattern, kind)

    def workspace_symbols(self, query: str, most: int = 50) -> DataFrame:
        return rollup.find_symbols(self.symbols, query, most).withColumn("lsp_kind", T.lsp_kind("kind"))

    def symbol_at(self, file: str, line: int) -> DataFrame:
        """FLT-24: definition and hover."""
        return self.symbols.filter((F.col("file") == file) & (F.col("start_line") == line))

    def references(self, symbol: str) -> DataFrame:
        """JN-28: edges into a symbol."""
        found = rollup.resolve_symbol(self.symbols, symbol).select(F.col("id").alias("target"))
        return self.symbol_edges.join(F.broadcast(found), "target", "left_semi")

    def related(self, symbol: str, kind: str | None = None, direction: str = "both") -> DataFrame:
        """JN-25: ``id, direction, kind`` around a symbol; callers and callees are the edges of kind ``calls-symbol``."""
        found = F.broadcast(rollup.resolve_symbol(self.symbols, symbol).select(F.col("id").alias("_s")))
        e = self.symbol_edges if kind is None else self.symbol_edges.filter(F.col("kind") == kind)
        into = e.join(found, F.col("target") == F.col("_s")).select(F.col("source").alias("id"), F.lit("in").alias("direction"), "kind")
        out = e.join(found, F.col("source") == F.col("_s")).select(F.col("target").alias("id"), F.lit("out").alias("direction"), "kind")
        return {"in": into, "out": out}.get(direction, into.unionByName(out)).distinct()

    def trace_callers(self, symbol: str) -> DataFrame:
        return self.related(symbol, "calls-symbol", "in")

    def trace_callees(self, symbol: str) -> DataFrame:
        return self.related(symbol, "calls-symbol", "out")

    def deep_dive(self, symbol: str) -> DataFrame:
        """GR-05."""
        calls = self.symbol_edges.filter(F.col("kind").startswith("calls-symbol"))
        return graph.neighborhood(calls, rollup.resolve_symbol(self.symbols, symbol).select("id"))

    def symbol_context(self, symbol: str, edges: int = 20) -> DataFrame:
        """API-12: a symbol with its code and its first edges in and out."""
        found = rollup.resolve_symbol(self.symbols, symbol)
        text = self.source.select(F.col("path").alias("file"), snippet.lines_of(F.col("content")).alias("lines"))
        code = F.array_join(F.slice(snippet.body(F.col("lines"), F.col("start_line"), F.col("end_line")), 1, 80), "\n")
        near = self.related(symbol)
        side = lambda d: near.filter(F.col("direction") == d).agg(F.slice(F.sort_array(F.collect_set("id")), 1, edges).alias(d))
        return found.join(text, "file").withColumn("code", code).drop("lines").crossJoin(side("in")).crossJoin(side("out"))

    def file_deps(self, path: str) -> DataFrame:
        """JN-26: edges of the file of that path, or the first whose path has it."""
        hit = self.files.filter(F.contains(F.lower("id"), F.lit(path.lower()))).orderBy((F.col("id") == path).desc(), "id").limit(1).select(F.col("id").alias("_f"))
        e = self.file_edges.select("source", "target", "kind")
        return e.join(F.broadcast(hit), (F.col("source") == F.col("_f")) | (F.col("target") == F.col("_f"))).select("source", "target", "kind", F.when(F.col("source") == F.col("_f"), "out").otherwise("in").alias("direction"))

    def search_files(self, keyword: str) -> DataFrame:
        return rollup.file_search(self.files, keyword).orderBy(F.col("points").desc(), "id")

    def smart_start(self, task: str) -> DataFrame:
        return rollup.probe(self.symbols, self._task(task).select("task_id", "kws"))

    def semantic_search(self, query: str, k: int = 10) -> DataFrame:
        docs = self.symbols.select("id", T.vector_tokens(T.search_text("name", "kind", "file", "signature")).alias("tokens"))
        words = score.idf(docs)
        q = self.spark.createDataFrame([(query,)], "text string").select(F.lit("query").alias("id"), T.vector_tokens("text").alias("tokens"))
        return semantic.sparse_topk(semantic.tfidf(q, idf=words), semantic.tfidf(docs, idf=words), k)

    # selection

    def _task(self, task: str) -> DataFrame:
        return self.spark.createDataFrame([(1, task)], "task_id int, task string").select("task_id", T.keywords("task", self.synonyms).alias("kws"), T.intents("task").alias("ints"))

    def _scored(self, task: str) -> DataFrame:
        """Every symbol with its scores for a task: ``task_score, final, tier``."""
        words = self._task(task)
        rows = score.score_tasks(self.symbols, words.select("task_id", "kws")).join(F.broadcast(words.select("task_id", "ints")), "task_id")
        rows = graph.cut(rows)
        kws, ints = F.col("kws"), F.col("ints")
        edges = self.symbol_edges.select("source", "target", "kind")
        seeded = rows.filter("task_score > 0")
        personal = graph.pagerank(self.symbols, edges, seeds=seeded.select("id", F.col("task_score").alias("weight"))).withColumnRenamed("rank", "personal")
        most = rows.agg(F.max("task_score").alias("most"))
        rows = rows.join(personal, "id").crossJoin(F.broadcast(most))  # one row
        if self.hot is not None:
            rows = rows.join(self.hot.select("file", F.col("score").alias("hotspot")), "file", "left").withColumn("hotspot", F.coalesce("hotspot", F.lit(0.0)))
        else:
            rows = rows.withColumn("hotspot", F.lit(0.0))
        linked = score.graph_score(F.col("rank"), F.col("personal"), F.col("most") > 0)
        final = score.final_score(F.col("task_score"), F.col("most"), linked, kws, ints, F.col("hotspot"))
        return graph.cut(rows.withColumns({"final": final, "tier": C.context_tier(kws, ints, ready=True)}))

    def candidates(self, task: str) -> DataFrame:
        """Symbols that a task may need: direct matches, callers, callees and import neighbours of the seeds, tests, types; else the best ranked.
        Columns of the scored symbols with ``score, reasons, cost, value``."""
        rows = self._scored(task)
        kws, ints = F.col("kws"), F.col("ints")
        isolated = C.is_isolated_match(kws, ready=True) & ~(C.b("exported") | F.lower("kind").isin(*C.MODEL_KINDS))
        weak = C.is_weak_file_match(kws, ready=True) & ~F.array_contains(ints, "bugfix")
        open_ = graph.cut(rows.filter(~C.is_noise() & ~C.is_unrequested_test(ints) & ~weak))
        direct = open_.filter((F.col("task_score") > 0) & ~isolated)
        seeds = graph.cut(select.mmr(direct.filter(C.seed_ok(F.col("task_score"), F.col("final"))), ["task_id"]).select("id", "file", F.col("final").alias("score")))
        one = lambda reason: F.array(F.lit(reason))
        every = direct.select("id", F.col("final").alias("score"), one("direct_matches").alias("reasons"))
        gate = C.neighbor_ok(F.col("overlap") > 0, F.col("tier"))
        near = select.neighbors(seeds.select("id", "score"), self.symbol_edges.select("source", "target", "kind"), open_.select("id", "task_score", "overlap", gate.alias("gate")))
        every = every.unionByName(near)
        wanted = open_.filter(F.col("overlap") > 0).select("id", "file", "overlap", "ints")
        every = graph.cut(every.unionByName(select.task_tests(wanted)))
        mapped = select.test_counterparts(seeds, open_.select("id", "file")).join(every.select("id"), "id", "left_anti")
        every = graph.cut(select.strongest(every.unionByName(mapped)))
        held = rows.join(every.select("id"), "id", "left_semi")
        types = select.type_dependencies(held, open_.filter(F.lower("kind").isin(*C.MODEL_KINDS)), every)
        every = every.unionByName(types.withColumn("reasons", one("type_dependency")))
        fallback = open_.orderBy(F.col("rank").desc(), "id").limit(80).filter(~C.is_generic_type()).select("id", (0.5 * F.col("rank")).alias("score"), one("global_fallback").alias("reasons"))
        if every.isEmpty():
            every = fallback
        cand = open_.join(every.withColumn("score", F.round("score", 6)), "id")
        return self._priced(cand)

    def _priced(self, rows: DataFrame) -> DataFrame:
        """PRJ-08: the cost of a symbol is that of its JSON with its code as it would be shown; its value is score per token."""
        text = self.source.select(F.col("path").alias("file"), snippet.lines_of(F.col("content")).alias("_all"))
        code = snippet.contextual(snippet.body(F.col("_all"), F.col("start_line"), F.col("end_line")), F.col("signature"), F.col("tier"), F.col("kws"))
        priced = rows.join(text, "file", "left").withColumn("_code", F.coalesce(code, F.lit(""))).drop("_all")
        shown = F.to_json(F.struct("id", "file", "kind", "signature", "reasons", F.col("_code").alias("code")))
        priced = priced.withColumn("cost", self.count_tokens(shown)).drop("_code")
        return graph.cut(priced.withColumn("value", F.round(F.col("score") / F.greatest("cost", F.lit(1)), 6)))

    def select(self, task: str, budget: int = 4096) -> DataFrame:
        """Rows for a task: scored, personalised, diversified, expanded, admitted by budget, file and test caps, with confidence."""
        cand = self.candidates(task)
        tier = select.tier_number(F.col("tier"), select.TIER_WEIGHT).desc()
        order = [F.col("value").desc(), tier, F.col("score").desc(), F.col("rank").desc(), F.col("id")]
        fit = graph.cut(select.greedy_budget(cand, ["task_id"], budget, order))
        self.cut_rows = fit.filter("not taken")
        kept = select.file_cap(fit.filter("taken"), ["task_id"], order).filter("admitted")
        tests = F.arrays_overlap("reasons", F.array(F.lit("tests"), F.lit("code_test_map")))
        kept = select.cap_tests(kept, ["task_id"], tests)
        ends = cand.groupBy("task_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        out = select.confidence(kept.join(F.broadcast(ends), "task_id"), ["task_id"], order, F.col("_lo"), F.col("_hi"))
        words_hit = F.array_sort(F.array_intersect("kws", "t_all"))
        out = out.withColumn("summary", select.relevance_summary(words_hit, F.col("role"), F.col("exported"), F.col("reasons")))
        return graph.cut(out.select("task_id", "id", "name", "kind", "file", "start_line", "end_line", "signature", "exported", "role", "rank", "tier", "score", "reasons", "cost", "value", "used", "confidence", "confidence_label", "summary", "kws"))

    def selection_report(self, task: str, budget: int = 4096) -> dict:
        """FLT-26: what a selection rests on: counts by reason, what the budget left out, and a warning where the task does not fit the project."""
        chosen = self.select(task, budget)
        words = self._task(task)
        kws = words.first()["kws"]
        counts = {r["reason"]: r["n"] for r in chosen.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).collect()}
        n = chosen.count()
        warning = None
        if not counts.get("direct_matches"):
            missing = rollup.missing_keywords(self.symbols, words)
            missing = sorted(r["keyword"] for r in missing.collect())
            warning = f"no symbol has the words {missing}" if missing else "no symbol matches directly; neighbours or the best ranked stand in"
        else:
            domain = [k for k in kws if k in select.DOMAIN_WORDS]
            named = F.exists(F.array(*[F.lit(k) for k in domain]) if domain else F.array(F.lit("")), lambda k: F.contains(F.lower("name"), k) | F.contains(F.lower("file"), k))
            if domain and chosen.filter(named).isEmpty():
                warning = f"no chosen symbol names {sorted(domain)}"
        return {"keywords": list(kws), "selected": n, "reasons": counts, "omitted_by_budget": self.cut_rows.count(), "degraded": not counts.get("direct_matches") and (bool(counts.get("global_fallback")) or not n), "warning": warning}

    def context(self, task: str, budget: int = 4096, form: str = "compact") -> str:
        """The selection packed as one text: compact, json, xml or markdown."""
        chosen = self.select(task, budget)
        rel = select.relations(chosen, self.symbol_edges)
        text = self.source.select(F.col("path").alias("file"), snippet.lines_of(F.col("content")).alias("_all"))
        rows = chosen.join(rel.select("id", F.struct("calls", "called_by", "imports", "dep_calls", "dep_called_by").alias("relations")), "id").join(text, "file")
        rows = rows.withColumn("code", snippet.contextual(snippet.body(F.col("_all"), F.col("start_line"), F.col("end_line")), F.col("signature"), F.col("tier"), F.col("kws"))).drop("_all")
        block = {"compact": pack.compact_block(F.col("code")), "json": pack.json_block(["id", "name", "kind", "file", "tier", "signature", "confidence", "code"]), "xml": pack.xml_block(F.col("code")), "markdown": pack.markdown_block(F.col("code"))}[form]
        rows = rows.withColumn("block", block).withColumn("cost", self.count_tokens(F.col("block")))
        order = [F.col("score").desc(), F.col("id")]
        if form == "json":
            fit = pack.prefix_fit(rows, ["task_id"], order, budget)
        elif form == "compact":
            fit = pack.tier_fit(rows, ["task_id"], order, budget).filter("included")
        else:
            fit = pack.three_way_fit(rows.withColumn("ref_cost", self.count_tokens(F.col("signature"))), ["task_id"], order, budget).filter("form <> 'omitted'")
            fit = fit.withColumn("block", F.when(F.col("form") == "full", F.col("block")).otherwise(F.concat_ws(" ", "id", "signature")))
        tier = select.tier_number(F.col("tier"), select.TIER_WEIGHT).desc()
        out = pack.document(fit, F.col("block"), ["task_id"], [tier, *order], header=f"# task: {task}\n# budget: {budget}\n").first()
        return out.text if out else f"# task: {task}\n# budget: {budget}\n"

    def not_staged(self, task: str, staged: list[str], budget: int = 4096) -> DataFrame:
        """JN-31: chosen symbols whose files are not among those of a change."""
        return self.select(task, budget).filter(~F.col("file").isin(staged) if staged else F.lit(True))

    def context_layer(self, task: str, tier: str = "all", budget: int = 4096, code: bool = True) -> dict:
        """FMT-07: the chosen symbols of one tier or of all as objects, with code while the budget lasts, then without it, and how many are left out."""
        chosen = self.select(task, budget)
        rows = chosen if tier == "all" else chosen.filter(F.col("tier") == tier)
        text = self.source.select(F.col("path").alias("file"), snippet.lines_of(F.col("content")).alias("_all"))
        body = snippet.contextual(snippet.body(F.col("_all"), F.col("start_line"), F.col("end_line")), F.col("signature"), F.col("tier"), F.col("kws"))
        rows = rows.join(text, "file", "left").withColumn("code", F.coalesce(body, F.lit("")) if code else F.lit("")).drop("_all")
        keep = ["id", "name", "kind", "file", "tier", "signature", "confidence", "summary"]
        bare, whole = F.to_json(F.struct(*keep)), F.to_json(F.struct(*keep, "code"))
        rows = rows.withColumns({"full": self.count_tokens(whole), "ref_cost": self.count_tokens(bare)})
        # support rows may have code here too, so the fold sees one tier
        fit = pack.three_way_fit(rows.withColumns({"own": F.col("tier"), "tier": F.lit("critical"), "cost": F.col("full")}), ["task_id"], [select.tier_number(F.col("own"), select.TIER_WEIGHT).desc(), F.col("score").desc(), F.col("id")], budget)
        fit = graph.cut(fit.withColumn("tier", F.col("own")))
        shown = fit.filter("form <> 'omitted'").orderBy(select.tier_number(F.col("tier"), select.TIER_WEIGHT).desc(), F.col("score").desc(), "id")
        made = shown.select(*keep, F.when(F.col("form") == "full", F.col("code")).alias("code")).toJSON().collect()  # bounded by the budget
        used = fit.agg(F.max("used").alias("u")).first().u
        return {"task": task, "tier": tier, "symbols": [json.loads(r) for r in made], "omitted": fit.filter("form = 'omitted'").count(), "used": used or 0, "budget": budget}

    def focused_context(self, task: str, budget: int = 4096) -> str:
        """API-05 and FMT-08: the context of the symbols where there are any, else blocks of the files that match best, until the budget is used."""
        if not self.symbols.isEmpty():
            return self.context(task, budget, "json")
        kws = list(self._task(task).first()["kws"]) or task.lower().split()[:5]
        found = rollup.focused_files(self.files, kws)
        listed = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
        head = F.concat(F.lit("### "), "id", F.lit(" [score:"), F.round("score", 1).cast("string"), F.lit(" | "), F.col("lines").cast("string"), F.lit("L]"))
        block = F.concat_ws("\n", head, F.when(F.col("summary") != "", F.concat(F.lit("> "), "summary")), F.when(F.size("names") > 0, F.concat(F.lit("SYMBOLS: "), listed("names", 15))), F.when(F.size("imports") > 0, F.concat(F.lit("DEPENDS: "), listed("imports", 8))))
        rows = found.withColumns({"one": F.lit(1), "block": block}).withColumn("cost", self.count_tokens(F.col("block")))
        order = [F.col("score").desc(), F.col("id")]
        fit = pack.prefix_fit(rows, ["one"], order, budget)
        out = pack.document(fit, F.col("block"), ["one"], order, header=f"FOCUSED CONTEXT for: {task}\nKeywords: {', '.join(kws)}\n\n").first()
        return out.text if out else f"no file matches: {task}"

    # projects

    def framework_overview(self) -> DataFrame:
        return projects.framework_overview(self.source)

    def framework_routes(self) -> DataFrame:
        return projects.framework_routes(self.source)

    def framework_schema(self) -> DataFrame:
        return projects.framework_schema(self.source)

    def recent_errors(self, path: str) -> DataFrame:
        return projects.recent_errors(projects.read_log(self.spark, path))

    def is_monorepo(self) -> bool:
        """HLP-06."""
        return not projects.workspaces(self.source).isEmpty()

    def domain_by_examples(self, examples: DataFrame) -> DataFrame:
        """AG-06 and AG-07: the domain whose examples (``domain, id, tokens``, any number of domains) the project's first symbols and imports are nearest to."""
        words = score.idf(examples)
        first = self.files.select(F.explode(F.concat(F.slice("names", 1, 50), F.slice("imports", 1, 30))).alias("t")).orderBy("t").limit(80)
        vector = first.agg(F.array_join(F.collect_list("t"), " ").alias("t")).select(F.lit("project").alias("id"), T.vector_tokens("t").alias("tokens"))
        return semantic.detect_domain(semantic.tfidf(vector, idf=words), semantic.prototypes(examples, words))

    def rescanned(self, root: str | DataFrame) -> Engine:
        """API-08, SRC-02 and ST-03: the engine of the tree as it is now (a folder, or its files); files whose digest has not changed are not parsed again."""
        source = graph.cut(scan.scan_files(self.spark, root) if isinstance(root, str) else root)
        fresh = Engine(self.spark, source, self.hot, self.synonyms, self.count_tokens)
        same = source.select("path", "hash").join(self.source.select("path", "hash"), ["path", "hash"], "left_semi").select(F.col("path").alias("file"))
        kept = self.parsed.join(same, "file", "left_semi")
        code = source.filter(~scan.skipped(F.col("path"), F.octet_length("content")))
        changed = code.join(same.withColumnRenamed("file", "path"), "path", "left_anti")
        fresh.parsed = graph.cut(kept.unionByName(extract.parse_files(changed)))
        return fresh

    def save_semantic(self, path: str) -> None:
        """SNK-08: the IDF and the weights of the symbols as tables."""
        docs = graph.cut(self.symbols.select("id", T.vector_tokens(T.search_text("name", "kind", "file", "signature")).alias("tokens")))
        words = score.idf(docs)
        scan.write_graph({"idf": words, "weights": semantic.tfidf(docs, idf=words)}, path)

    def bundle(self, most: int = 2000) -> dict:
        """SNK-04 and SNK-10: the clipped files and edges that a page shows, the most important ones."""
        files = pack.compact_graph(self.files.select("id", "lines", "importance", "role", F.col("names").alias("symbols"), "summary").orderBy(F.col("importance").desc(), "id").limit(most))
        edges = self.file_edges.select("source", "target", "kind").orderBy("source", "target").limit(5 * most)
        rows = lambda df: [json.loads(r) for r in df.toJSON().collect()]
        return {"files": rows(files), "edges": rows(edges)}

    def tables(self) -> dict[str, DataFrame]:
        return {"files": self.files, "file_edges": self.file_edges, "symbols": self.symbols, "symbol_edges": self.symbol_edges}

    def snapshot(self) -> DataFrame:
        """What a gate compares: files and symbols with their digests."""
        files = self.source.select(F.concat(F.lit("file:"), "path").alias("key"), F.sha2("content", 256).alias("hash"))
        return files.unionByName(self.symbols.select(F.concat(F.lit("symbol:"), "id").alias("key"), F.lit("").alias("hash")))


#: A small invented project in three languages, for the queries that need source files.
DEMO = (
    ("shop/__init__.py", ""),
    ("shop/store.py", '"""Keeps orders in memory."""\n\nclass Store:\n    def put(self, order):\n        return save(order)\n\n    def get(self, key):\n        return self.find(key)\n\n    def find(self, key):\n        return None\n\ndef save(order):\n    # TODO write to disk\n    return order\n'),
    ("shop/api.py", "from .store import Store, save\nfrom shop.util import clean\n\ndef create_order(data):\n    item = clean(data)\n    return Store().put(item)\n\ndef quick(data):\n    return save(data)\n"),
    ("shop/util.py", "def clean(value):\n    return value.strip()\n\ndef _hidden():\n    return clean('x')\n"),
    ("tests/test_store.py", "from shop.store import Store\n\ndef test_put():\n    assert Store().put(1) == 1\n"),
    ("web/package.json", '{"name": "web"}'),
    ("web/tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"]}}}'),
    ("web/lib/index.ts", "export * from './money'\n"),
    ("web/lib/money.ts", "export function format(value: number) {\n  return pad(value)\n}\nfunction pad(value: number) {\n  return `$` + value\n}\n"),
    ("web/app.ts", "import { format } from '@lib/index'\nimport * as money from './lib/money'\n\nexport function render(total: number) {\n  money.format(total)\n  return format(total)\n}\n"),
    ("core/Cargo.toml", '[package]\nname = "core"\n'),
    ("core/src/lib.rs", "use crate::engine::run;\n\npub fn start() {\n    run();\n}\n"),
    ("core/src/engine.rs", "pub fn run() {\n    helper();\n}\n\nfn helper() {\n}\n"),
)


def demo_engine(spark: SparkSession) -> Engine:
    return Engine(spark, scan.from_rows(spark, list(DEMO)).cache())
