"""A small lexer for source files: words, numbers, strings, comments and signs with their lines, and the brackets that belong together."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

WORD, NUMBER, STRING, COMMENT, SIGN = range(5)

#: Extensions by what starts a comment to the end of the line besides ``//``, and by what single quotes and backticks hold.
HASH = frozenset("py rb sh php r ex exs jl yaml yml toml bash".split())
DASH = frozenset("sql lua".split())
NO_SLASH = frozenset("py rb sh r ex exs jl yaml yml toml bash sql lua".split())
CHARACTERS = frozenset("c cpp cc h hpp java go rs cs swift kt scala".split())
BACKTICKS = frozenset("js ts jsx tsx mjs cjs vue go".split())


@dataclass(frozen=True, slots=True)
class Token:
    kind: int
    text: str
    line: int  # from 1


@cache
def _master(ext: str) -> re.Pattern:
    comments = [] if ext in NO_SLASH else [r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"]
    comments += [r"\#[^\n]*"] if ext in HASH else []
    comments += [r"--[^\n]*"] if ext in DASH else []
    strings = [r'""".*?(?:"""|\Z)', r"'''.*?(?:'''|\Z)"] if ext in ("py", "jl", "ex", "exs", "") else []
    strings += [r'"(?:\\.|[^"\\\n])*"?']
    strings += [r"'(?:\\[^\n']+|[^\\'\n])'"] if ext in CHARACTERS else [r"'(?:\\.|[^'\\\n])*'?"]
    strings += [r"`(?:\\.|[^`\\])*(?:`|\Z)"] if ext in BACKTICKS or not ext else []
    parts = [("c", comments), ("s", strings), ("w", [r"[^\W\d][\w$]*|\$[\w$]*"]), ("n", [r"\d[\w.]*"]), ("p", [r"::|=>|->|\?\.|\.\.\.|[^\s\w]"])]
    return re.compile("|".join(f"(?P<{name}>{'|'.join(options)})" for name, options in parts if options), re.S)


_KIND = {"c": COMMENT, "s": STRING, "w": WORD, "n": NUMBER, "p": SIGN}


def tokens(text: str, ext: str = "") -> list[Token]:
    """All tokens but comments, in order."""
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    return [Token(_KIND[m.lastgroup], m[0], bisect_right(starts, m.start())) for m in _master(ext).finditer(text) if m.lastgroup != "c"]


def partners(found: list[Token]) -> dict[int, int]:
    """The place of the closing bracket of each opening one."""
    out, open_ = {}, []
    closes = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(found):
        if t.kind != SIGN:
            continue
        if t.text in "([{":
            open_.append(i)
        elif t.text in closes:
            while open_ and found[open_[-1]].text != closes[t.text]:
                open_.pop()
            if open_:
                out[open_.pop()] = i
    return out
