"""The engine as a service: named tools over JSON lines, and the language server protocol over framed messages.

What a tool returns is bounded: rows by ``ROWS``, texts by the caller's budget of tokens.
"""

from __future__ import annotations

import json
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyspark.sql import functions as F

from cairn.engine import Engine
from cairn.functions.text import PROFILES

ROWS = 100
#: Tools that give rows: name to (engine method, names of its arguments).
ROW_TOOLS = {
    "overview": ("overview", ()),
    "query": ("find_symbols", ("query",)),
    "deps": ("file_deps", ("path",)),
    "search": ("search_files", ("keyword",)),
    "regex_query": ("regex_symbols", ("pattern",)),
    "find_related": ("related", ("symbol",)),
    "trace_callers": ("trace_callers", ("symbol",)),
    "trace_callees": ("trace_callees", ("symbol",)),
    "context_for_symbol": ("symbol_context", ("symbol",)),
    "expand_symbol": ("symbol_context", ("symbol",)),
    "deep_dive": ("deep_dive", ("symbol",)),
    "semantic_search": ("semantic_search", ("query",)),
    "smart_start": ("smart_start", ("task",)),
    "workspace_symbols": ("workspace_symbols", ("query",)),
    "references": ("references", ("symbol",)),
    "statistics": ("statistics", ()),
    "framework_overview": ("framework_overview", ()),
    "framework_routes": ("framework_routes", ()),
    "framework_schema": ("framework_schema", ()),
    "recent_errors": ("recent_errors", ("path",)),
    "packages": ("packages", ()),
    "package_edges": ("package_edges", ()),
    "coverage": ("coverage", ()),
    "debt": ("debt", ()),
    "cycles": ("cycles", ()),
    "communities": ("communities", ()),
}
#: Tools that give one text or object.
TEXT_TOOLS = ("context", "precision_context", "context_layer", "focused_context", "rescan", "selection_report")


def budget_of(arguments: dict) -> int:
    """PRJ-06: the tokens of a profile, or those that are asked for."""
    profile = str(arguments.get("profile", "custom")).lower()
    if profile not in (*PROFILES, "custom"):
        raise ValueError(f"unknown budget profile: {profile}")
    return PROFILES.get(profile) or int(arguments.get("budget", 4096))


def clipped(text: str, most: int) -> str:
    """FMT-09: at most so many estimated tokens of a response, marked where cut."""
    return text if len(text) // 4 <= most else text[: 4 * most] + "\n... [truncated]"


class Service:
    """An engine, rebuilt from its root on demand, and the answers it gives."""

    def __init__(self, engine: Engine, root: str | None = None):
        self.engine, self.root = engine, root

    def tools(self) -> list[dict]:
        return [{"name": n, "arguments": list(a)} for n, (_, a) in ROW_TOOLS.items()] + [{"name": n, "arguments": ["task"]} for n in TEXT_TOOLS]

    def call(self, name: str, arguments: dict):
        """One tool by name; rows as a list of objects."""
        if name in ROW_TOOLS:
            method, names = ROW_TOOLS[name]
            rows = getattr(self.engine, method)(*[arguments[n] for n in names]).limit(ROWS)
            return [json.loads(r) for r in rows.toJSON().collect()]
        if name == "rescan":
            if self.root is None:
                raise ValueError("the engine was not built from a folder")
            self.engine = self.engine.rescanned(self.root)
            return json.loads(self.engine.statistics().toJSON().first())
        if name == "selection_report":
            return self.engine.selection_report(arguments["task"], budget_of(arguments))
        if name == "context_layer":
            return self.engine.context_layer(arguments["task"], arguments.get("tier", "all"), budget_of(arguments), bool(arguments.get("code", True)))
        if name == "focused_context":
            return self.engine.focused_context(arguments["task"], budget_of(arguments))
        if name in ("context", "precision_context"):
            form = "json" if name == "precision_context" else arguments.get("form", "json")
            return clipped(self.engine.context(arguments["task"], budget_of(arguments), form), 2 * budget_of(arguments))
        raise KeyError(name)

    def answer(self, request: dict) -> dict:
        """API-27: one JSON-RPC request: tools/list, or tools/call with name and arguments."""
        base = {"jsonrpc": "2.0", "id": request.get("id")}
        if request.get("method") == "tools/list":
            return base | {"result": {"tools": self.tools()}}
        params = request.get("params") or {}
        if request.get("method") != "tools/call" or params.get("name") not in (*ROW_TOOLS, *TEXT_TOOLS):
            return base | {"error": {"code": -32601, "message": "no such method"}}
        try:
            return base | {"result": self.call(params["name"], params.get("arguments") or {})}
        except Exception as e:
            return base | {"error": {"code": -32000, "message": f"{type(e).__name__}: {e}"[:500]}}

    # the language server protocol

    def _path(self, params: dict) -> str:
        path = unquote(urlparse(params["textDocument"]["uri"]).path)
        return path.removeprefix((self.root or "").rstrip("/")).lstrip("/")

    def _location(self, row) -> dict:
        place = {"line": max(0, (row.start_line or 1) - 1), "character": 0}
        return {"uri": f"file://{(self.root or '').rstrip('/')}/{row.file}", "range": {"start": place, "end": place}}

    def language(self, method: str, params: dict):
        """API-22: initialize, definition, references, hover and workspace symbols; None for what is not known."""
        if method == "initialize":
            return {"capabilities": {"definitionProvider": True, "referencesProvider": True, "hoverProvider": True, "workspaceSymbolProvider": True}}
        if method == "workspace/symbol":
            rows = self.engine.workspace_symbols(params.get("query", "")).collect()
            return [{"name": r.name, "kind": r.lsp_kind, "location": self._location(r)} for r in rows]
        if method not in ("textDocument/definition", "textDocument/hover", "textDocument/references"):
            return None
        here = self.engine.symbol_at(self._path(params), params["position"]["line"] + 1).first()
        if here is None:
            return [] if method == "textDocument/references" else None
        if method == "textDocument/definition":
            return self._location(here)
        if method == "textDocument/hover":
            return {"contents": {"kind": "markdown", "value": f"**{here.name}** ({here.kind})\n\n```\n{here.signature}\n```\n\nrank {here.rank}, {here.inbound_calls} calls in, {here.outbound_calls} out"}}
        into = self.engine.references(here.id).select(F.col("source").alias("id")).distinct().limit(ROWS)
        return [self._location(r) for r in self.engine.symbols.join(into, "id", "left_semi").collect()]

    def serve_language(self, source: BinaryIO, sink: BinaryIO) -> None:
        """SRC-25: messages framed by Content-Length, until the source ends."""
        while (request := read_message(source)) is not None:
            reply = {"jsonrpc": "2.0", "id": request.get("id")}
            try:
                reply["result"] = self.language(request.get("method", ""), request.get("params") or {})
            except Exception as e:
                reply["error"] = {"code": -32603, "message": str(e)[:500]}
            if request.get("id") is not None:
                write_message(sink, reply)
            if request.get("method") == "exit":
                return


def read_message(source: BinaryIO) -> dict | None:
    """The next framed message, None at the end. The length counts bytes."""
    length = None
    while line := source.readline():
        name, _, value = line.decode("ascii", "replace").partition(":")
        if name.strip().lower() == "content-length":
            length = int(value)
        elif not line.strip() and length is not None:
            return json.loads(source.read(length))
    return None


def write_message(sink: BinaryIO, message: dict) -> None:
    body = json.dumps(message, ensure_ascii=False).encode()
    sink.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
    sink.flush()
