"""Symbols, calls and imports of files, by the table of grammars; the parents and callers that follow are joins.

Each file goes by itself: one pass blanks comments and the insides of literals, so that all else runs over text of the same
offsets, and pairs brackets and blocks. Python goes by its own parser. Files of svelte and vue are looked into where they hold
scripts. A file that does not parse, or has no grammar, gives no rows.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import imports
from .grammars import COMPILED, Compiled

#: Languages in which a name after a type is declared, not called; and words that a call may follow all the same.
TYPED = frozenset("c cpp glsl hlsl objc java csharp groovy d dart".split())
BEFORE_CALL = frozenset("return else throw case in of and or not do await yield if when while then go defer try echo print assert emit typeof void delete new goto co_return co_await".split())
_BRACKET = re.compile(r"[()\[\]{}]")
_TYPE_BEFORE = re.compile(r"([A-Za-z_]\w*)[ \t*&]+\Z")
_GOES_ON = re.compile(r"\s*(?:\{|where\b|extends\b|implements\b|with\b|throws\b|:(?!:)|->|is\b)")

#: Rows that a task holds before it sends them on.
FLUSH = 20_000
#: what: symbol, call or import. prefix: names of the modules around a rust import.
SCHEMA = "path string, what string, kind string, name string, start_line int, end_line int, raw_path string, is_wildcard boolean, module_prefix array<string>"


def mask(text: str, c: Compiled) -> tuple[str, str]:
    """(code, bare): text with comments and the insides of literals blank, and with comments alone blank."""
    if c.opener is None:
        return text, text
    code, bare, at = [], [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    while m := c.opener.search(text, at):
        kind, start = m.lastgroup or "", m.start()
        code.append(text[at:start])
        bare.append(text[at:start])
        if kind[0] == "b" and kind[1:].isdigit():
            end = _block_end(text, m.end(), *c.grammar.block[int(kind[1:])], c.grammar.nested)
            code.append(blank(text[start:end]))
            bare.append(code[-1])
        elif kind[0] == "l" and kind[1:].isdigit():
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            code.append(" " * (end - start))
            bare.append(code[-1])
        else:
            kind = next(k for k in c.literals if m.groupdict().get(k) is not None)
            whole = c.literals[kind].match(text, start)
            end = whole.end() if whole else m.end()
            s = text[start:end]
            code.append(s if len(s) < 2 else s[0] + blank(s[1:-1]) + (s[-1] if s[-1] in "'\"`\n" else " "))
            bare.append(s)
        at = max(end, start + 1)
        if at > end:
            code[-1] += text[end:at]
            bare[-1] += text[end:at]
    code.append(text[at:])
    bare.append(text[at:])
    return "".join(code), "".join(bare)


def _block_end(text: str, at: int, opens: str, closes: str, nested: bool) -> int:
    depth = 1
    while depth:
        end = text.find(closes, at)
        if end < 0:
            return len(text)
        inner = text.find(opens, at, end) if nested else -1
        depth, at = (depth + 1, inner + len(opens)) if inner >= 0 else (depth - 1, end + len(closes))
    return at - (1 if closes == "\n" else 0)


class Source:
    """A file's code with its lines, bracket pairs and block pairs."""

    def __init__(self, text: str, c: Compiled) -> None:
        self.c, self.text = c, text
        self.code, self.bare = mask(text, c)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.pairs = self._brackets()
        self.opens, self.closes = self._blocks()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def line_end(self, at: int) -> int:
        end = self.code.find("\n", at)
        return len(self.code) if end < 0 else end

    def _brackets(self) -> dict[int, int]:
        pairs, stack = {}, []
        for m in _BRACKET.finditer(self.code):
            if m[0] in "([{":
                stack.append((m[0], m.start()))
                continue
            want = "([{"[")]}".index(m[0])]
            if any(o == want for o, _ in stack[-8:]):  # an unclosed bracket or a few do not lose the rest
                while stack:
                    o, at = stack.pop()
                    if o == want:
                        pairs[at] = m.start()
                        break
        return pairs

    def _blocks(self) -> tuple[list[int], list[int]]:
        pairs, stack = {}, []
        for m in self.c.blocks.finditer(self.code) if self.c.blocks else ():
            if m.lastgroup == "open":
                stack.append(m.start() + len(m[0]) - len(m[0].lstrip()))
            elif stack:
                pairs[stack.pop()] = m.end() - 1
        return sorted(pairs), [pairs[k] for k in sorted(pairs)]

    def end_of(self, kind: str, start: int, name_end: int, head_end: int) -> int:
        """Where the last character of a definition is."""
        style, code = self.c.grammar.body, self.code
        if style == "brace":
            return self._brace(name_end)
        if style == "paren":
            return self.pairs.get(start, self.line_end(start))
        if style == "end":
            i = bisect_left(self.opens, start)
            if i < len(self.opens) and self.opens[i] <= self.line_end(head_end):
                return self.closes[i]
            return self._to(";", name_end) if self.c.grammar.ignore_case else self.line_end(start)
        if style == "indent":
            return self._indent(start)
        if style == "semicolon":
            return self._to(";", name_end)
        if style == "header":
            over = re.compile(r"\bendfunction\b").search(code, name_end) if kind.startswith("function") else None
            return over.end() - 1 if over else self._to(";", name_end)
        if style == "stop":
            over = re.compile(r"\.(?=\s|\Z)").search(code, name_end)
            return over.start() if over else len(code)
        return self.line_end(start)

    def _to(self, mark: str, at: int) -> int:
        while m := re.compile(rf"[(\[{{]|{re.escape(mark)}").search(self.code, at):
            if m[0] == mark:
                return m.start()
            at = self.pairs.get(m.start(), m.start()) + 1
        return self.line_end(at)

    def _brace(self, at: int) -> int:
        while m := re.compile(r"[({\[;\n]").search(self.code, at):
            if m[0] == "{":
                return self.pairs.get(m.start(), len(self.code))
            if m[0] == ";":
                return m.start()
            if m[0] == "\n":
                before = self.code[self.code.rfind("\n", 0, m.start()) + 1 : m.start()].rstrip()
                if not before.endswith(("=", ",", "->", "=>", "(")) and not _GOES_ON.match(self.code, m.end()):
                    return m.start()
                at = m.end()
            else:
                at = self.pairs.get(m.start(), m.start()) + 1
        return len(self.code)

    def _indent(self, start: int) -> int:
        ls, first = self.starts, self.line(start) - 1
        text = lambda i: self.code[ls[i] : ls[i + 1] - 1 if i + 1 < len(ls) else len(self.code)]
        width = lambda s: len(s) - len(s.lstrip())
        base, last = width(text(first)), first
        for i in range(first + 1, len(ls)):
            s = text(i)
            if not s.strip():
                continue
            if width(s) <= base:
                return ls[i] if width(s) == base and re.match(r"\s*(?:end\b|\)|\}|\]|;;)", s) else ls[last]
            last = i
        return ls[last]


def symbols_and_calls(s: Source, lang: str) -> tuple[list[tuple], list[tuple]]:
    """(kind, name, start line, end line) and (name, line), in the order of the text."""
    found, c = [], s.c
    for kind, pattern in c.defs:
        for m in pattern.finditer(s.code):
            g = m.lastindex or 0
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            found.append((start, m.start(g), m.end(g), m.end(), kind))
    heads = {i for _, at, end, *_ in found for i in range(at, end)}
    seen, symbols = set(), []
    for start, at, name_end, head_end, kind in sorted(found):
        if at in seen or (s.code[at:name_end].lower() if c.grammar.ignore_case else s.code[at:name_end]) in c.reserved:
            continue  # the first kind of a name at its place counts
        seen.add(at)
        symbols.append([kind, s.bare[at:name_end], s.line(start), s.line(max(s.end_of(kind, start, name_end, head_end), start)), start])
    if lang == "erlang":  # a clause ends where the next one starts
        clauses = [x for x in symbols if x[0] == "function_clause"]
        for a, b in zip(clauses, clauses[1:]):
            a[3] = min(a[3], max(a[2], b[2] - 1))
    calls = []
    for m in c.call.finditer(s.code) if c.call else ():
        g = m.lastindex or 0
        name, at = m[g], m.start(g)
        if (name.lower() if c.grammar.ignore_case else name) in c.reserved or (at in heads and not c.grammar.heads):
            continue
        if lang in TYPED and s.code[m.end(g) : m.end(g) + 40].lstrip()[:1] == "(" and (t := _TYPE_BEFORE.search(s.code, max(0, at - 80), at)) and t[1] not in BEFORE_CALL:
            continue
        calls.append((name, s.line(at)))
    return [tuple(x[:4]) for x in symbols], calls


def python_rows(text: str) -> list[tuple]:
    """By Python's own parser; nothing if the text does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append(("symbol", "class_definition" if isinstance(n, ast.ClassDef) else "function_definition", n.name, n.lineno, n.end_lineno, None, False, []))
        elif isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
            if name:
                out.append(("call", "call", name, n.lineno, n.lineno, None, False, []))
        elif isinstance(n, ast.Import):
            out += [("import", "import", None, n.lineno, n.lineno, a.name, False, []) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            m = "." * n.level + (n.module or "")
            out += [("import", "import", None if a.name == "*" else a.name, n.lineno, n.lineno, f"{m}.*" if a.name == "*" else m, a.name == "*", []) for a in n.names]
    return out


def rows_of(text: str, lang: str) -> list[tuple]:
    """(what, kind, name, start, end, raw_path, is_wildcard, module_prefix) of one file."""
    if lang == "python":
        return python_rows(text)
    if lang in imports.ISLANDS:
        return [(*r[:3], r[3] + line, r[4] + line, *r[5:]) for line, inner, body in imports.islands(text) for r in rows_of(body, inner) if r[0] == "import"]
    if lang not in COMPILED:
        return []
    s = Source(text, COMPILED[lang])
    symbols, calls = symbols_and_calls(s, lang)
    out = [("symbol", kind, name, a, b, None, False, []) for kind, name, a, b in symbols]
    out += [("call", "call", name, line, line, None, False, []) for name, line in calls]
    return out + [("import", "import", i.name, s.line(i.at), s.line(i.at), i.raw, i.wildcard, list(i.prefix)) for i in imports.of(s, lang)]


def extract(files: DataFrame) -> DataFrame:
    """SCHEMA of files (path, lang, text); rows of a file in no order. A null text or path gives none."""

    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, lang, text in zip(b["path"], b["lang"], b["text"]):
                rows += [(path, *r) for r in rows_of(text, lang)] if text and path else []
                if len(rows) >= FLUSH:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "lang", "text").mapInPandas(run, SCHEMA)
