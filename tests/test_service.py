"""Tools, the language server's framing, layers, focus, rescans and sinks."""

import io
import json

import pytest

from cairn.engine import Engine, demo_engine
from cairn.functions import text as T
from cairn.service import Service, clipped, read_message, write_message
from cairn.sources import scan


@pytest.fixture(scope="module")
def engine(spark):
    return demo_engine(spark)


def test_tools(engine):
    service = Service(engine)
    names = {t["name"] for t in service.answer({"id": 1, "method": "tools/list"})["result"]["tools"]}
    assert {"context_layer", "focused_context", "rescan", "framework_routes", "recent_errors", "packages", "expand_symbol"} <= names
    call = lambda name, **a: service.answer({"id": 2, "method": "tools/call", "params": {"name": name, "arguments": a}})
    assert [r["id"] for r in call("query", query="clean")["result"]] == ["shop/util.py::clean"]
    assert call("nothing")["error"]["code"] == -32601
    assert call("query")["error"]["code"] == -32000
    assert call("packages")["result"] and call("statistics")["result"][0]["total_files"] == 10
    assert call("rescan")["error"]["code"] == -32000
    assert len(clipped("x" * 100, 5)) < 100 and clipped("x", 5) == "x"


def test_layers(engine):
    whole = engine.context_layer("fix order store put", "all", 1000)
    assert {s["tier"] for s in whole["symbols"]} == {"critical"} and whole["omitted"] == 0 and all(s["code"] for s in whole["symbols"])
    tight = engine.context_layer("fix order store put", "critical", 150)
    assert tight["used"] <= 150
    assert engine.context_layer("fix order store put", "support", 1000)["symbols"] == []
    assert "create_order" in engine.focused_context("fix order store put", 1000)


def test_focus_without_symbols(spark):
    files = scan.from_rows(spark, [("a/order.sql", "-- about every order we keep\nselect 1;\n"), ("b/other.sql", "select 2;\n")])
    text = Engine(spark, files).focused_context("order report", 500)
    assert "### a/order.sql [score:" in text and "b/other.sql" not in text
    assert Engine(spark, files).focused_context("zeppelin", 500).startswith("no file matches")


def test_language_server(engine):
    service = Service(engine, "/work")
    sent, out = io.BytesIO(), io.BytesIO()
    at = {"textDocument": {"uri": "file:///work/shop/util.py"}, "position": {"line": 0, "character": 4}}
    for i, (method, params) in enumerate([("initialize", {}), ("textDocument/definition", at), ("textDocument/hover", at), ("textDocument/references", at), ("workspace/symbol", {"query": "ORDER"}), ("exit", {})]):
        write_message(sent, {"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    sent.seek(0)
    service.serve_language(sent, out)
    out.seek(0)
    got = []
    while (m := read_message(out)) is not None:
        got.append(m["result"])
    assert got[0]["capabilities"]["hoverProvider"]
    assert got[1]["uri"] == "file:///work/shop/util.py" and got[1]["range"]["start"]["line"] == 0
    assert "clean" in got[2]["contents"]["value"]
    assert {g["uri"].rsplit("/", 1)[1] for g in got[3]} == {"api.py", "util.py"}
    assert [g["name"] for g in got[4]] == ["create_order"] and got[4][0]["kind"] == 12


def test_rescans_parse_only_what_changed(spark, tmp_path, monkeypatch):
    (tmp_path / "a.py").write_text("def aa():\n    pass\n")
    (tmp_path / "b.py").write_text("def bb():\n    pass\n")
    engine = Engine(spark, spark.createDataFrame(scan.scan_files(spark, str(tmp_path)).collect()))
    assert engine.symbols.count() == 2
    (tmp_path / "b.py").write_text("def cc():\n    pass\n")
    (tmp_path / "d.py").write_text("def dd():\n    pass\n")
    seen = []
    from cairn.sources import extract

    real = extract.parse_files
    monkeypatch.setattr(extract, "parse_files", lambda files: seen.extend(r.path for r in files.collect()) or real(files))
    fresh = engine.rescanned(str(tmp_path))
    assert sorted(seen) == ["b.py", "d.py"] and {r.name for r in fresh.symbols.collect()} == {"aa", "cc", "dd"}


def test_sinks(spark, engine, tmp_path):
    scan.write_text(spark, "é\n", f"file://{tmp_path}/r.md")
    assert (tmp_path / "r.md").read_text(encoding="utf-8") == "é\n"
    bundle = engine.bundle()
    page = scan.render_html(bundle | {"x": "</script>"})
    assert "</script>" not in page.split("const GRAPH = ")[1].split(";document")[0] and len(bundle["files"]) == 10
    engine.save_semantic(str(tmp_path / "sem"))
    assert spark.read.parquet(str(tmp_path / "sem" / "idf")).count() > 5
    scan.write_graph({"files": engine.files.drop("names", "imports")}, str(tmp_path / "g"))
    assert scan.read_graph(spark, str(tmp_path / "g"), ["files"])["files"].count() == 10
    scan.write_json_bundle({"edges": engine.file_edges}, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "edges")).count() == 7
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"id": "c1", "must_include": ["a"], "budget": 5}, {"id": "c2", "must_include_ids": ["b"], "max_tokens": 7}]}))
    rows = {r.case_id: (r.must, r.budget) for r in scan.read_cases(spark, str(tmp_path / "cases.json")).collect()}
    assert rows == {"c1": (["a"], 5), "c2": (["b"], 7)}


def test_advice_and_domains(spark, engine):
    got = {r.file for r in engine.not_staged("fix order store put", ["shop/store.py"], 1000).collect()}
    assert got == {"shop/api.py"}
    examples = spark.createDataFrame([("shop", "1", ["order", "store", "put"]), ("game", "2", ["sprite", "player"])], "domain string, id string, tokens array<string>")
    assert engine.domain_by_examples(examples).first().domain == "shop"
    assert engine.is_monorepo()


def test_counting_by_a_rank_file(spark, tmp_path):
    import base64

    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abab"]
    (tmp_path / "tiny.ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(ranks)))
    count = T.token_counter(str(tmp_path / "tiny.ranks"), r"\S+|\s+")
    rows = spark.createDataFrame([("abab x",), ("",), (None,)], "t string")
    assert [r.n for r in rows.select(count("t").alias("n")).collect()] == [3, 0, 0]
