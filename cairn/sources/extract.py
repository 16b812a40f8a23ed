"""Extraction: one source file to its symbols, imports, import records and exports.

The only step that needs Python workers: files go through ``mapInArrow`` in Arrow batches and
come back as one nested row each; everything after is ``explode`` and joins. Python files are
read by the standard ``ast`` module; the rest (and Python that does not parse) is cut into tokens, so that strings, comments
and brackets are known, and declarations, calls and import statements are read from those.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexer import SIGN, STRING, WORD, Token, partners, tokens

SIGNATURE_CHARS = 180
SUMMARY_LINES, SUMMARY_PARTS, SUMMARY_LEAST = 30, 3, 8

# Words that are never a symbol's name, and import roots that are noise.
NOT_NAMES = frozenset(
    "if else for while switch case return throw catch try new delete typeof instanceof void null true false this super import export from class "
    "extends implements interface package using namespace var let const int string bool float double long short byte char boolean object dynamic "
    "readonly where select".split()
)
NOISE_ROOTS = frozenset(
    "os re sys json time math random datetime pathlib typing dataclasses collections itertools functools io abc enum copy hashlib base64 urllib http "
    "threading subprocess shutil glob argparse logging unittest string struct socket contextlib traceback inspect ast textwrap uuid asyncio "
    "multiprocessing signal tempfile pickle csv xml html email sqlite3 decimal fs path crypto events stream util url https net dns child_process "
    "process buffer assert cluster readline zlib tls react vue angular svelte express fastapi flask django fastify axios lodash moment numpy pandas "
    "matplotlib scipy sklearn torch requests pytest click pydantic sqlalchemy next nuxt vite webpack babel eslint tailwindcss prisma mongoose "
    "sequelize typeorm java javax android fmt strings strconv errors context sync testing encoding reflect runtime sort bytes std core alloc tokio "
    "serde anyhow clap".split()
)
#: Words that declare a type, with the kind of what they declare.
TYPE_WORDS = {"class": "class", "struct": "struct", "interface": "interface", "trait": "interface", "enum": "enum", "contract": "class", "namespace": "class", "module": "class", "record": "class", "protocol": "interface"}
FUNCTION_WORDS = frozenset("def fn func function procedure sub method fun".split())
#: Words that begin a statement which is no declaration.
ACTION_WORDS = frozenset("return throw if for while switch case await yield else do in new delete typeof catch match unless until when assert raise not and or".split())
VARIABLE_WORDS = frozenset("const let var".split())
#: Languages whose functions may be declared by a type alone, and those whose blocks are not in braces.
BRACED = frozenset("js ts jsx tsx mjs cjs vue c cpp cc h hpp java go rs php cs swift kt scala".split())
SCRIPTS = frozenset("js ts jsx tsx mjs cjs vue".split())
# How comments begin that tell nothing about a file.
SKIPPED_NOTES = ("copyright", "license", "eslint", "@ts-", "type:", "noqa", "pylint", "!/")


@dataclass
class Found:
    """What a file holds."""

    symbols: list[dict] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    records: list[dict] = field(default_factory=list)
    exports: list[str] = field(default_factory=list)
    summary: str = ""
    n_lines: int = 0


def decode(data: bytes | None) -> str:
    """SRC-05: the first encoding that reads the bytes."""
    for name in ("utf-8", "utf-16", "latin-1"):
        try:
            return (data or b"").decode(name)
        except UnicodeError:
            continue
    return ""


def end_line(lines: list[str], start: int) -> int:
    """EXT-09: the last line of the indented block under line ``start`` (from 1); a closing line at the indentation of its head belongs to it."""
    depth = lambda s: len(s) - len(s.lstrip())
    indent, last = depth(lines[start - 1]), start
    for i in range(start, len(lines)):
        if lines[i].strip():
            if depth(lines[i]) <= indent:
                return i + 1 if last > start and lines[i].strip() in ("end", "}", "};", "fi", "done") else last
            last = i + 1
    return last


def note_of(line: str) -> str | None:
    """The text of a comment line or of a docstring's first line, None if it is neither."""
    s = line.strip()
    for quote in ('"""', "'''"):
        if s.startswith(quote):
            return s[3:].split(quote)[0] or None
    for lead in ("/**", "/*", "//", "#", "*", "--", ";"):
        if s.startswith(lead):
            return s[len(lead) :] or None
    return None


def summary(lines: list[str]) -> str:
    """EXT-08: the first telling comments at the head of a file."""
    out = []
    for line in lines[:SUMMARY_LINES]:
        text = (note_of(line) or "").strip().strip("*/").strip()
        if len(text) > SUMMARY_LEAST and any(c.isalnum() for c in text) and not text.lower().startswith(SKIPPED_NOTES):
            out.append(text)
        if len(out) == SUMMARY_PARTS:
            break
    return " // ".join(out)


def signature(lines: list[str], line: int) -> str:
    """EXT-13: a declaration's line, clipped."""
    sig = lines[line - 1].strip() if line <= len(lines) else ""
    return sig if len(sig) <= SIGNATURE_CHARS else sig[: SIGNATURE_CHARS - 3] + "..."


class Source:
    """A tokenised file: its declarations, the calls in them and its import statements."""

    def __init__(self, text: str, ext: str = ""):
        self.lines, self.ext = text.splitlines(), ext
        self.found = tokens(text, ext)
        self.close = partners(self.found)

    def at(self, i: int) -> Token | None:
        return self.found[i] if 0 <= i < len(self.found) else None

    def text(self, i: int) -> str:
        return self.found[i].text if 0 <= i < len(self.found) else ""

    def word(self, i: int) -> str:
        t = self.at(i)
        return t.text if t and t.kind == WORD else ""

    def string(self, i: int) -> str | None:
        t = self.at(i)
        return t.text.strip("'\"`") if t and t.kind == STRING else None

    def starts(self, i: int) -> bool:
        """Does a statement begin here?"""
        return i == 0 or self.found[i - 1].line < self.found[i].line or self.text(i - 1) in (";", "{", "}")

    # declarations

    def _after_brackets(self, i: int) -> int:
        return self.close.get(i, i) + 1

    def _declared(self, i: int) -> tuple[str, str, int] | None:
        """(name, kind, place of the name) of a declaration whose word or name stands at ``i``."""
        w = self.word(i)
        if not w or self.text(i - 1) in (".", "::", "?.", "->"):
            return None
        if w in TYPE_WORDS and self.word(i + 1) and self.word(i + 1) not in ("extends", "implements"):
            return self.word(i + 1), TYPE_WORDS[w], i + 1
        if w == "type" and self.word(i + 1) and self.starts(i) | (self.word(i - 1) in ("export", "pub")):  # an alias, or a named struct or interface
            kind = self.word(i + 2)
            return (self.word(i + 1), kind if kind in ("struct", "interface") else "type", i + 1) if kind in ("struct", "interface") or self.text(i + 2) in ("=", "<") else None
        if w in FUNCTION_WORDS:
            j = i + 1
            if self.text(j) == "(" and self.ext == "go":  # the receiver
                j = self._after_brackets(j)
            j += self.text(j) in ("*", "&")
            name = self.word(j)
            while name and self.text(j + 1) in (".", "::") and self.word(j + 2):  # a method named with its owner
                j += 2
                name = self.word(j)
            opens = self.text(j + 1) in ("(", "<", "[") or self.ext not in BRACED
            return (name, "func", j) if name and opens else None
        if w in VARIABLE_WORDS and self.word(i + 1):
            return (self.word(i + 1), "func", i + 1) if self._is_function_value(i + 2) else None
        if self.text(i + 1) == "(" and self.ext in BRACED and self._is_typed(i):
            return w, "func", i
        return None

    def _is_function_value(self, i: int) -> bool:
        """Is what a variable is set to a function?"""
        j = i
        while j < min(i + 40, len(self.found)) and self.text(j) != "=":
            if self.text(j) in (";", ",") or self.found[j].line != self.found[i - 1].line and self.text(j) not in (":", ">"):
                return False
            j = self._after_brackets(j) if self.text(j) in ("(", "[", "{") else j + 1
        if self.text(j) != "=":
            return False
        j += 1 + (self.word(j + 1) == "async")
        if self.word(j) == "function" or self.word(j) and self.text(j + 1) == "=>":
            return True
        return self.text(j) == "(" and self._arrow_follows(self._after_brackets(j))

    def _arrow_follows(self, j: int) -> bool:
        if self.text(j) == ":":  # a result type
            end = j + 12
            while j < min(end, len(self.found)) and self.text(j) != "=>":
                j = self._after_brackets(j) if self.text(j) in ("(", "[", "{") else j + 1
        return self.text(j) == "=>"

    def _is_typed(self, i: int) -> bool:
        """Does the name at ``i``, followed by a parameter list, declare a function by its type or as a member?"""
        before, behind = self.at(i - 1), self._after_brackets(i + 1)
        if behind == i + 2 and self.text(i + 1) == "(" and i + 1 not in self.close:
            return False
        tail = behind
        while self.word(tail) in ("const", "noexcept", "override", "final"):
            tail += 1
        if self.word(tail) in ("throws", "where"):
            while self.word(tail) or self.text(tail) in (",", ".", ":", "<", ">"):
                tail += 1
        if self.text(tail) in (":", "->"):
            end = tail + 24
            while tail < min(end, len(self.found)) and self.text(tail) not in ("{", ";", "}", "=>"):
                tail = self._after_brackets(tail) if self.text(tail) in ("(", "[") else tail + 1
        owner = self.owners[-1][1] if self.owners else None
        typed = before is not None and (before.kind == WORD and before.text not in ACTION_WORDS and before.text not in FUNCTION_WORDS or before.text in (">", "]", "*", "&")) and before.line >= self.found[i].line - 1
        if self.ext in SCRIPTS:
            member = owner not in (None, "func") and (before is None or before.text in ("{", "}", ";") or before.line < self.found[i].line or before.text in ("async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*"))
            return member and self.text(tail) in ("{", ";")
        own_name = owner not in (None, "func") and before is not None and (before.text in ("{", "}", ";", "public", "private", "protected", "internal") or before.line < self.found[i].line)
        if self.text(tail) == "{" or self.text(tail) == "=>" and typed:
            return typed or own_name and self.word(i) == self.owners[-1][2]
        return self.text(tail) == ";" and typed and owner != "func" and not self.starts(i)

    def symbols(self) -> list[dict]:
        """EXT-02, EXT-10 to EXT-13: declarations, the first of each name (WN-11), with their ends, and the calls in them that no inner one has."""
        out: dict[str, dict] = {}
        self.owners: list[tuple[int, str, str]] = []  # place of the end, kind, name
        spans: list[tuple[int, int, str]] = []
        self.places: set[int] = set()  # of all declared names, of those that others have taken too
        skip = -1
        for i in range(len(self.found)):
            while self.owners and i > self.owners[-1][0]:
                self.owners.pop()
            if i <= skip or self.found[i].kind != WORD or not (hit := self._declared(i)):
                continue
            name, kind, place = hit
            skip = place
            self.places.add(place)
            first, end = self.found[i].line, self._end(place)
            if self.ext in BRACED and end is not None and self.text(end) == "}":
                self.owners.append((end, kind, name))
            if name in out or name.lower() in NOT_NAMES or kind == "func" and len(name) < 2:
                continue
            last = self.found[end].line if end is not None else end_line(self.lines, first)
            line = self.found[place].line
            out[name] = {"name": name, "kind": kind, "line": line, "end_line": max(line, last), "signature": signature(self.lines, line), "exported": self._exported(line), "calls": []}
            stop = end if end is not None else max((k for k in range(place, min(len(self.found), place + 100_000)) if self.found[k].line <= last), default=place)
            spans.append((place, stop, name))
        self._calls(spans, out)
        return list(out.values())

    def _end(self, place: int) -> int | None:
        """The token that ends what is declared at ``place``: the brace of its body or the end of its statement; None where only indentation tells."""
        if self.ext and self.ext not in BRACED:
            return None
        j = place + 1
        while j < len(self.found):
            s = self.text(j)
            if s == "{":
                return self.close.get(j, len(self.found) - 1)
            if s == ";":
                return j
            if s == "=>" and self.text(j + 1) != "{":  # an expression: to the end of its statement
                while j + 1 < len(self.found) and self.text(j + 1) not in (";", ")", "]", "}"):
                    if self.found[j + 1].line != self.found[j].line and self.text(j) not in ("=>", ",", "?", ":", "+", "-", "&", "|", "."):
                        break
                    j = self.close.get(j + 1, j + 1)
                return j
            if s == "}":
                return j - 1
            j = self._after_brackets(j) if s in ("(", "[") else j + 1
        return len(self.found) - 1

    def _exported(self, line: int) -> bool:
        """EXT-13: an export word at the head of the line or of the one before."""
        here = self.lines[line - 1].strip() if line <= len(self.lines) else ""
        above = self.lines[line - 2].strip() if line >= 2 else ""
        return here.startswith(("export ", "pub ", "public ")) or above.startswith("export ") and not above.endswith((";", "}"))

    def _calls(self, spans: list[tuple[int, int, str]], out: dict[str, dict]) -> None:
        """EXT-11 and EXT-12: simple, qualified and constructor calls, each once, under the innermost declaration."""
        open_: list[tuple[int, int, str]] = []
        todo = sorted(spans)
        k = 0
        for i, t in enumerate(self.found):
            while k < len(todo) and todo[k][0] <= i:
                open_.append(todo[k])
                k += 1
            while open_ and open_[-1][1] < i:
                open_.pop()
            if t.kind != WORD or not open_ or i in self.places or self.text(i + 1) != "(" or t.text in ACTION_WORDS or t.text in NOT_NAMES or t.text in FUNCTION_WORDS:
                continue
            if self.word(i - 1) in FUNCTION_WORDS:
                continue
            name, j = t.text, i
            while self.text(j - 1) in (".", "::", "?.", "->") and self.word(j - 2):
                name = f"{self.word(j - 2)}{'::' if self.text(j - 1) == '::' else '.'}{name}"
                j -= 2
            owner = out[open_[-1][2]]
            calls = owner["calls"]
            if name not in calls and owner["kind"] not in ("interface", "struct", "enum", "type"):
                calls.append(name)

    # imports

    def _names(self, i: int, end: int) -> list[tuple[str, str]]:
        """EXT-07: ``a, b as c`` between two places to (imported, local) pairs."""
        out, part = [], []
        for j in range(i, end + 1):
            if j == end or self.text(j) == ",":
                words = [w for w in part if w != "type"] or part
                if words:
                    out.append((words[0], words[2] if len(words) == 3 and words[1] == "as" else words[0]))
                part = []
            elif self.word(j) or self.text(j) == "*":
                part.append(self.text(j))
        return out

    def _path(self, i: int, joints: tuple[str, ...]) -> tuple[str, int]:
        """A name of words and joints from ``i`` on the same line, and the place after it."""
        out, j, line = "", i, self.found[i].line if i < len(self.found) else 0
        while j < len(self.found) and self.found[j].line == line and (self.word(j) or self.text(j) in joints or self.text(j) == "*" and out.endswith(joints)):
            if self.word(j) and out and not out.endswith(joints):
                break
            out += self.text(j)
            j += 1
        return out, j

    def _script_import(self, i: int) -> tuple[str, list[tuple[str, str]]] | None:
        """Source and names of ``import ... from "source"`` at ``i``."""
        j, pairs = i + 1 + (self.word(i + 1) == "type" and self.word(i + 2) != "from"), []
        while j < len(self.found) and self.word(j) != "from":
            if self.text(j) == "{":
                end = self.close.get(j)
                if end is None:
                    return None
                pairs += self._names(j + 1, end)
                j = end + 1
            elif self.text(j) == "*" and self.word(j + 1) == "as":
                pairs.append(("*", self.word(j + 2)))
                j += 3
            elif self.word(j) and self.text(j + 1) in (",", "from"):
                pairs.append(("default", self.word(j)))
                j += 1
            elif self.text(j) == ",":
                j += 1
            else:
                return None
        source = self.string(j + 1)
        return (source, pairs) if source is not None else None

    def statements(self) -> tuple[list[dict], list[str], list[str]]:
        """EXT-03 to EXT-06: import records, exported names and imported names; what starts a statement decides how it is read."""
        records: list[dict] = []
        exports: dict[str, None] = {}
        plain: dict[str, None] = {}

        def record(i: int, source: str, kind: str, pairs: list[tuple[str, str]]) -> None:
            records.append({"source": source, "line": self.found[i].line, "kind": kind, "specifiers": [{"imported": a, "local": b} for a, b in pairs]})
            plain[source] = None

        for i in range(len(self.found)):
            w = self.word(i)
            if w == "require" and self.text(i + 1) == "(" and (source := self.string(i + 2)):
                record(i, source, "require", [])
            if not w or not self.starts(i) and not (self.text(i - 1) == "#" and w in ("include", "import")) and self.word(i - 1) not in ("pub", "global"):
                continue
            if w == "import":
                if (source := self.string(i + 1)) is not None:
                    record(i, source, "import", []) if self.ext in SCRIPTS or not self.ext else plain.update({source: None})
                elif (hit := self._script_import(i)) is not None:
                    record(i, hit[0], "import", hit[1])
                elif self.text(i + 1) == "(":  # a list of strings
                    plain |= dict.fromkeys(s for j in range(i + 2, self.close.get(i + 1, i)) if (s := self.string(j)))
                elif name := self._path(i + 1 + (self.word(i + 1) == "static"), (".",))[0]:
                    plain[name.removesuffix(".*")] = None
            elif w == "from":
                dots = i + 1
                while self.text(dots) in (".", "..."):
                    dots += 1
                lead = "".join(self.text(k) for k in range(i + 1, dots))
                name, j = self._path(dots, (".",)) if self.word(dots) and self.word(dots) != "import" else ("", dots)
                if self.word(j) == "import" and lead + name:
                    record(i, lead + name, "import", self._python_names(j + 1))
            elif w == "export":
                self._export(i, record, exports)
            elif w == "use":
                self._use(i, record)
            elif w in ("using", "include", "require", "require_once", "include_once"):
                if (source := self.string(i + 1)) is not None:
                    plain[source] = None
                elif self.text(i + 1) == "<" and self.text(i - 1) == "#":
                    j = i + 2
                    while j < len(self.found) and self.text(j) != ">":
                        j += 1
                    plain["".join(self.text(k) for k in range(i + 2, j))] = None
                elif w == "using" and (name := self._path(i + 1, (".",))[0]) and "=" not in self.text(i + 2):
                    plain[name] = None
        kept = [n for n in plain if n not in (".", "..") and n.split(".")[0].split("/")[0].split("::")[0].lstrip("@").lower() not in NOISE_ROOTS]
        return records, list(exports), kept

    def _python_names(self, i: int) -> list[tuple[str, str]]:
        """Imported names up to the end of the line or of the bracket; a renamed one keeps both words as its name."""
        end = self.close.get(i) if self.text(i) == "(" else None
        if end is None:
            end = i
            while end < len(self.found) and self.found[end].line == self.found[i].line and self.text(end) != ";":
                end += 1
        else:
            i += 1
        out, part = [], []
        for j in range(i, end + 1):
            if j == end or self.text(j) == ",":
                if part:
                    out.append((" ".join(part), " ".join(part)))
                part = []
            else:
                part.append(self.text(j))
        return out

    def _export(self, i: int, record, exports: dict[str, None]) -> None:
        j = i + 1
        if self.text(j) in ("*", "{"):
            names = [("*", "*")] if self.text(j) == "*" else self._names(j + 1, self.close.get(j, j + 1))
            j = j + 1 if self.text(j) == "*" else self.close.get(j, j) + 1
            if self.word(j) == "as":
                j += 2
            source = self.string(j + 1) if self.word(j) == "from" else None
            if source is not None:
                record(i, source, "re-export", names)
            exports |= dict.fromkeys(local for _, local in names if source is not None or local != "*")
            return
        default = self.word(j) == "default"
        j += default
        j += self.word(j) in ("async", "abstract", "declare")
        if default:
            exports_first = self.word(j)
            if exports_first in ("function", "class"):
                j += 1 + (self.text(j + 1) == "*")
            name = self.word(j)
        else:
            name = self.word(j + 1) if self.word(j) in ("function", "class", "interface", "type", "const", "let", "var", "enum") else ""
            name = self.word(j + 2) if self.word(j) == "const" and self.word(j + 1) == "enum" else name
        if name:
            exports[name] = None
        if default:
            exports["default"] = None

    def _use(self, i: int, record) -> None:
        name, j = self._path(i + 1, ("\\",))
        if "\\" in name or self.word(j) == "as" and "::" not in name:
            local = self.word(j + 1) if self.word(j) == "as" else name.rsplit("\\", 1)[-1]
            record(i, name, "php-use", [(local, local)])
            return
        name, j = self._path(i + 1, ("::",))
        if not name:
            return
        if self.text(j) == "{" and name.endswith("::"):
            pairs = self._names(j + 1, self.close.get(j, j + 1))
            pairs = [("*", "*")] if ("*", "*") in pairs else pairs
            record(i, name.removesuffix("::"), "rust-use", pairs)
        else:
            last = name.split("::")[-1]
            record(i, name, "rust-use", [(last, last)])


def import_records(lines: list[str], ext: str = "") -> tuple[list[dict], list[str]]:
    """EXT-04: import and export statements of a file."""
    records, exports, _ = Source("\n".join(lines), ext).statements()
    return records, exports


class _Python(ast.NodeVisitor):
    """EXT-10 and EXT-11 for Python: definitions with their ends and the calls in them, nested definitions left out."""

    def __init__(self, lines: list[str]):
        self.lines, self.found = lines, {}

    @staticmethod
    def callee(node: ast.expr) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            left = _Python.callee(node.value)
            return f"{left}.{node.attr}" if left else node.attr
        return _Python.callee(node.func) if isinstance(node, ast.Call) else None

    def calls(self, node: ast.AST) -> list[str]:
        out: dict[str, None] = {}
        stack = list(ast.iter_child_nodes(node))
        while stack:
            x = stack.pop(0)
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(x, ast.Call) and (name := self.callee(x.func)):
                out[name] = None
            stack.extend(ast.iter_child_nodes(x))
        return list(out)

    def define(self, node, kind: str) -> None:
        if node.name not in self.found and (len(node.name) > 1 or kind == "class"):
            self.found[node.name] = {"name": node.name, "kind": kind, "line": node.lineno, "end_line": node.end_lineno, "signature": signature(self.lines, node.lineno), "exported": not node.name.startswith("_"), "calls": self.calls(node)}
        self.generic_visit(node)

    def visit_FunctionDef(self, node):
        self.define(node, "func")

    def visit_AsyncFunctionDef(self, node):
        self.define(node, "func")

    def visit_ClassDef(self, node):
        self.define(node, "class")


def extract(path: str, text: str) -> Found:
    """EXT-01: symbols by syntax tree where there is one, those of the token rules whose names are new after them (SO-06)."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    source = Source(text, ext)
    symbols: dict[str, dict] = {}
    if ext == "py":
        try:
            tree = _Python(source.lines)
            tree.visit(ast.parse(text))
            symbols = tree.found
        except (SyntaxError, ValueError, RecursionError):
            pass
    if not symbols:
        symbols = {s["name"]: s for s in source.symbols()}
    records, exports, imports = source.statements()
    named = set(exports)
    for s in symbols.values():
        s["exported"] = s["exported"] or s["name"] in named
    if ext == "py":
        exports = [s["name"] for s in symbols.values() if not s["name"].startswith("_")]
    return Found(list(symbols.values()), imports, records, exports, summary(source.lines), len(source.lines))


SCHEMA = (
    "file string, n_lines int, summary string, imports array<string>, exports array<string>, "
    "symbols array<struct<name:string,kind:string,line:int,end_line:int,signature:string,exported:boolean,calls:array<string>>>, "
    "records array<struct<source:string,line:int,kind:string,specifiers:array<struct<imported:string,local:string>>>>"
)

_SYMBOL = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("exported", pa.bool_()), ("calls", pa.list_(pa.string()))]))
_RECORD = pa.list_(pa.struct([("source", pa.string()), ("line", pa.int32()), ("kind", pa.string()), ("specifiers", pa.list_(pa.struct([("imported", pa.string()), ("local", pa.string())])))]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [extract(p, t or "") for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
        yield pa.record_batch(
            [
                b.column("path"),
                pa.array([f.n_lines for f in found], pa.int32()),
                pa.array([f.summary for f in found], pa.string()),
                pa.array([f.imports for f in found], pa.list_(pa.string())),
                pa.array([f.exports for f in found], pa.list_(pa.string())),
                pa.array([f.symbols for f in found], _SYMBOL),
                pa.array([f.records for f in found], _RECORD),
            ],
            ["file", "n_lines", "summary", "imports", "exports", "symbols", "records"],
        )


def parse_files(files: DataFrame) -> DataFrame:
    """``path, content`` to one nested row per file (``SCHEMA``)."""
    return files.select("path", "content").mapInArrow(_run, SCHEMA)


def symbol_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("file", F.explode("symbols").alias("s")).select("file", "s.*")
    return rows.withColumn("id", F.concat_ws("::", "file", "name"))


def record_rows(parsed: DataFrame) -> DataFrame:
    """Import records in order; a file without any has its plain imports as records."""
    plain = F.transform("imports", lambda x: F.struct(x.alias("source"), F.lit(0).alias("line"), F.lit("import").alias("kind"), F.array().cast("array<struct<imported:string,local:string>>").alias("specifiers")))
    records = F.when(F.size("records") > 0, F.col("records")).otherwise(plain)
    return parsed.select("file", F.posexplode(records).alias("ord", "r")).select("file", "ord", "r.*")
