import pytest
from pyspark.sql import functions as F

from cairn.engine import Engine, demo_engine
from cairn.sources import extract, projects, scan
from cairn.streaming import watch


@pytest.fixture(scope="module")
def engine(spark):
    return demo_engine(spark)


def test_import_rules():
    lines = [
        "import React, { useState as us, memo } from 'react'",
        "import * as api from './api'",
        "import {",
        "  one,",
        "  two as three,",
        "} from './many'",
        "import './side'",
        "const x = require('./old')",
        "export { a as b } from './c'",
        "export default function main() {}",
        "const t = `",
        "import fake from './fake'",
        "`",
    ]
    records, exports = extract.import_records(lines)
    got = [(r["source"], r["kind"], [(s["imported"], s["local"]) for s in r["specifiers"]]) for r in records]
    assert got == [
        ("react", "import", [("default", "React"), ("useState", "us"), ("memo", "memo")]),
        ("./api", "import", [("*", "api")]),
        ("./many", "import", [("one", "one"), ("two", "three")]),
        ("./side", "import", []),
        ("./old", "require", []),
        ("./c", "re-export", [("a", "b")]),
    ]
    assert exports == ["b", "main", "default"]


def test_other_languages():
    assert extract.import_records(["from a.b import (", "    c,", "    d,", ")"])[0][0]["specifiers"] == [{"imported": "c", "local": "c"}, {"imported": "d", "local": "d"}]
    php = extract.import_records(["use App\\Models\\User as U;"])[0][0]
    assert (php["kind"], php["specifiers"][0]["local"]) == ("php-use", "U")
    rust = extract.import_records(["use crate::a::{b, c as d};"])[0][0]
    assert (rust["source"], [s["local"] for s in rust["specifiers"]]) == ("crate::a", ["b", "d"])


def test_python_symbols_have_ends_and_calls():
    found = extract.extract("m.py", "class A:\n    def go(self):\n        return self.x(b.c())\n\ndef _p():\n    pass\n")
    got = {s["name"]: (s["kind"], s["line"], s["end_line"], s["calls"], s["exported"]) for s in found.symbols}
    assert got["go"] == ("func", 2, 3, ["self.x", "b.c"], True)
    assert got["_p"][4] is False
    assert found.exports == ["A", "go"]


def test_decode_falls_back():
    assert extract.decode("é".encode("latin-1")) == "é"
    assert extract.decode(None) == ""


def test_file_edges(engine):
    got = {(r.source, r.target) for r in engine.file_edges.collect()}
    assert got == {
        ("shop/api.py", "shop/store.py"), ("shop/api.py", "shop/util.py"), ("tests/test_store.py", "shop/store.py"),
        ("web/app.ts", "web/lib/index.ts"), ("web/app.ts", "web/lib/money.ts"), ("web/lib/index.ts", "web/lib/money.ts"), ("core/src/lib.rs", "core/src/engine.rs"),
    }


def test_call_edges(engine):
    got = {(r.source, r.target, r.kind) for r in engine.symbol_edges.collect()}
    assert ("shop/api.py::create_order", "shop/util.py::clean", "calls-symbol") in got
    assert ("shop/store.py::get", "shop/store.py::find", "calls-symbol-local") in got
    assert ("web/app.ts::render", "web/lib/money.ts::format", "calls-symbol") in got
    assert ("web/app.ts::render", "web/lib/money.ts::format", "imports-symbol") in got
    assert all(s != t for s, t, _ in got)


def test_selection_stays_in_budget(engine):
    rows = engine.select("fix order store put", 200).collect()
    assert rows and sum(r.cost for r in rows) <= 200
    # the cost of a symbol is that of its JSON with its code, so three fit and the method itself does not
    assert rows[0].task_id == 1 and {r.id for r in rows} == {"shop/api.py::create_order", "shop/store.py::Store", "shop/store.py::find"}
    wide = {r.id for r in engine.select("fix order store put", 1000).collect()}
    assert wide == {"shop/api.py::create_order", "shop/store.py::Store", "shop/store.py::save", "shop/store.py::put"}  # three of a file at most
    text = engine.context("fix order store put", 300, "markdown")
    assert "store.py::put" in text


def test_reports_warn_where_a_task_does_not_fit(engine):
    fits = engine.selection_report("fix order store put", 1000)
    assert fits["warning"] is None and not fits["degraded"] and fits["reasons"]["direct_matches"] == 4
    alien = engine.selection_report("zeppelin quaternion", 1000)
    assert alien["degraded"] and "quaternion" in alien["warning"] and alien["reasons"] == {"global_fallback": alien["selected"]}
    tests = engine.candidates("add tests for store put").filter("file = 'tests/test_store.py'").collect()
    assert [r.id for r in tests] == ["tests/test_store.py::test_put"] and "tests" in tests[0].reasons


def test_lookups(engine):
    assert [r.id for r in engine.find_symbols("ORDER").collect()] == ["shop/api.py::create_order"]
    assert {r.id for r in engine.trace_callers("clean").collect()} == {"shop/api.py::create_order"}
    assert engine.symbol_at("shop/util.py", 1).first().name == "clean"
    assert engine.file_deps("store.py").count() == 2
    assert engine.semantic_search("create order").first().doc == "shop/api.py::create_order"


def symbols_of(path, text):
    return {s["name"]: (s["kind"], s["line"], s["end_line"], s["calls"]) for s in extract.extract(path, text).symbols}


def test_declarations_by_tokens():
    ts = "// a comment with function fake() {\nexport class Box<T> {\n  constructor(x: number) { this.go(x) }\n  async go(x: number): Promise<void> {\n    if (x) { helper('}') }\n  }\n}\nexport const add = (a: number): number => a + sum(a)\nconst z = 5\n"
    assert symbols_of("a.ts", ts) == {"Box": ("class", 2, 7, []), "constructor": ("func", 3, 3, ["this.go"]), "go": ("func", 4, 6, ["helper"]), "add": ("func", 8, 8, ["sum"])}
    java = "public class A extends B {\n  public A(int n) { super(n); }\n  public <T> List<T> get(Map<String, T> m) throws E, F {\n    for (int i = 0; i < n; i++) { m.put(x(), new C(i)); }\n    return D.make(m);\n  }\n  abstract void none();\n}\n"
    assert symbols_of("A.java", java) == {"A": ("class", 1, 8, []), "get": ("func", 3, 6, ["m.put", "x", "C", "D.make"]), "none": ("func", 7, 7, [])}
    go = "type S struct { a int }\nfunc (s *S) Run(a int) error {\n  return y.Do(a)\n}\n"
    assert symbols_of("m.go", go) == {"S": ("struct", 1, 1, []), "Run": ("func", 2, 4, ["y.Do"])}
    rust = "pub struct P<'a> { x: &'a str }\nimpl<'a> P<'a> {\n  fn go(&self) { self.x.len(); b::run('}'); }\n}\npub enum E { A, B }\n"
    assert symbols_of("l.rs", rust) == {"P": ("struct", 1, 1, []), "go": ("func", 3, 3, ["self.x.len", "b::run"]), "E": ("enum", 5, 5, [])}
    c = "static int add(int a, int b) {\n  return mul(a, b);\n}\nint main(void)\n{\n  print(\"} %d\", add(1, 2)); /* } */\n}\n"
    assert symbols_of("x.c", c) == {"add": ("func", 1, 3, ["mul"]), "main": ("func", 4, 7, ["print", "add"])}
    cs = "namespace N {\n  public class K {\n    public async Task<int> Go(int a) { return await Do(a); }\n  }\n}\n"
    assert symbols_of("x.cs", cs) == {"N": ("class", 1, 5, []), "K": ("class", 2, 4, []), "Go": ("func", 3, 3, ["Do"])}
    php = "<?php\nclass C extends B {\n  public function index($a) { return view(U::all()); }\n}\n"
    assert symbols_of("x.php", php) == {"C": ("class", 2, 4, []), "index": ("func", 3, 3, ["view", "U::all"])}
    ruby = "class Foo\n  def bar(x)\n    baz(x)\n  end\nend\n"
    assert symbols_of("x.rb", ruby) == {"Foo": ("class", 1, 5, []), "bar": ("func", 2, 4, ["baz"])}


def test_imports_of_many_languages():
    def plain(path, text):
        return extract.extract(path, text).imports

    assert plain("A.java", "import java.util.List;\nimport a.c.D;\nimport static a.b.*;\n") == ["a.c.D", "a.b"]
    assert plain("m.go", 'import (\n "fmt"\n "x/y"\n)\n') == ["x/y"]
    assert plain("x.c", '#include <lib/a.h>\n#include "b.h"\n') == ["lib/a.h", "b.h"]
    assert plain("x.cs", "using A.B;\n") == ["A.B"]
    many = "import {" + ",".join(f"\n  name{i}" for i in range(200)) + "\n} from './wide'\n"
    assert len(extract.import_records(many.split("\n"))[0][0]["specifiers"]) == 200
    assert extract.import_records(["from . import a", "from ..b.c import d as e"], "py")[0][1]["source"] == "..b.c"


def test_files_in_other_encodings_are_scanned(spark, tmp_path):
    (tmp_path / "a.py").write_bytes("# é\ndef aa():\n    pass\n".encode("latin-1"))
    (tmp_path / "b.py").write_bytes(b"def bb():\n    pass\n\xff")
    got = {r.path: r.content for r in scan.scan_files(spark, str(tmp_path)).collect()}
    assert got["a.py"].startswith("# é\n") and set(got) == {"a.py", "b.py"}


def test_ignore_patterns(spark):
    rows = [("a/x.py",), ("b/x.py",), ("a/keep.py",), ("node_modules/y.js",), ("c/deep/z.py",)]
    df = spark.createDataFrame(rows, "path string").withColumn("n", F.lit(1))
    got = {r.path for r in df.filter(~scan.skipped(F.col("path"), F.col("n"), patterns=["a/*.py", "!a/keep.py", "deep/"])).collect()}
    assert got == {"b/x.py", "a/keep.py"}


def test_scan_and_refresh(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.py").write_text("def aa():\n    pass\n")
    (tmp_path / "pkg/b.py").write_text("def bb():\n    pass\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/c.js").write_text("x")
    first = spark.createDataFrame(scan.scan_files(spark, str(tmp_path)).collect())
    assert {r.path for r in first.collect()} == {"pkg/a.py", "pkg/b.py"}
    (tmp_path / "pkg/b.py").write_text("def cc():\n    pass\n")
    second = scan.scan_files(spark, str(tmp_path))
    assert {(r.path, r.status) for r in scan.refresh(first, second).collect()} == {("pkg/a.py", "kept"), ("pkg/b.py", "changed")}
    assert Engine.from_path(spark, str(tmp_path)).symbols.count() == 2


def test_project_files(spark):
    files = scan.from_rows(
        spark,
        [
            ("package.json", '{"workspaces": ["apps/*"]}'),
            ("apps/one/package.json", '{"name": "one-app"}'),
            ("composer.json", '{"require": {"php": "^8.1", "laravel/framework": "^10"}, "autoload": {"psr-4": {"App\\\\": "app/"}}}'),
            ("artisan", ""),
            ("routes/web.php", "<?php\nRoute::get('/users', [UserController::class, 'index']);\nRoute::match(['get', 'post'], '/both', 'Both');\n"),
            ("database/migrations/1_users.php", "Schema::create('users', function (Blueprint $table) {\n    $table->string('email');\n    $table->integer('age');\n});\nSchema::table('orders', function (Blueprint $table) {\n    $table->date('due');\n});\n"),
            ("tsconfig.base.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@x/*": ["src/*"]}}} // base'),
            ("web/tsconfig.json", '{"extends": "../tsconfig.base.json"}'),
        ],
    )
    assert [(r.package, r.name) for r in projects.workspaces(files).collect()] == [("apps/one", "one-app")]
    assert [(r.namespace, r.base) for r in projects.psr4(files).collect()] == [("App\\", "app")]
    o = projects.framework_overview(files).first()
    assert (o.is_project, o.framework_version, o.migrations) == (True, "^10", 1)
    assert [(r.method, r.uri) for r in projects.framework_routes(files).collect()] == [("get", "/users"), ("match", "/both")]
    assert [(r.table, r.type, r.name) for r in projects.framework_schema(files).collect()] == [("users", "string", "email"), ("users", "integer", "age"), ("orders", "date", "due")]
    assert {(r.dir, r.alias) for r in projects.path_aliases(files).collect()} == {("", "@x/*"), ("", "*")}


def test_watch_batches(spark, tmp_path):
    state = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, hash string")
    batch = spark.createDataFrame([("a", "2"), ("b", None), ("c", "1")], "key string, hash string")
    edges = spark.createDataFrame([("x", "a")], "source string, target string")
    after, report = watch.apply_batch(state, batch, edges)
    assert {(r.key, r.hash) for r in after.collect()} == {("a", "2"), ("c", "1")}
    r = report.first()
    assert (r.added, r.removed, r.changed, r.affected) == (["c"], ["b"], ["a"], ["x"])


def test_file_stream_sees_new_files(spark, tmp_path):
    root, seen = tmp_path / "src", []
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    q = watch.watch(watch.file_stream(spark, str(root)), lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    (root / "b.py").write_text("y = 1\n")
    watch.watch(watch.file_stream(spark, str(root)), lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"), once=True).awaitTermination()
    assert [p.rsplit("/", 1)[1] for p in seen] == ["a.py", "b.py"]
