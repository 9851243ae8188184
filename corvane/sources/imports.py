"""Import statements of a file, one row per thing that is bound: the path as written, the name if there is one, and whether
all names come along. Nested trees give a row per leaf.

Patterns run over text without comments whose strings are whole; a match counts only where it starts in code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

#: Languages whose imports are those of the scripts inside.
ISLANDS = ("svelte", "vue")


class Import(NamedTuple):
    raw: str
    name: str | None = None
    wildcard: bool = False
    at: int = 0
    prefix: tuple[str, ...] = ()


#: One path per match: (pattern, whether all names come along, what is added to the path). Fixed values.
_QUOTED = r"(?:\"([^\"\n]+)\"|'([^'\n]+)')"
_INCLUDE = (r"^[ \t]*#[ \t]*(?:include|import)[ \t]*\"([^\"\n]+)\"", False, "")
PLAIN: dict[str, tuple[tuple[str, bool, str], ...]] = {
    **dict.fromkeys(("c", "cpp", "objc", "glsl", "hlsl"), (_INCLUDE,)),
    "vim": ((r"^[ \t:]*so(?:urce)?!?[ \t]+([^\s|]+)", False, ""),), "proto": ((rf"^[ \t]*import[ \t]+(?:public[ \t]+|weak[ \t]+)?{_QUOTED}", False, ""),),
    "solidity": ((rf"^[ \t]*import\b[^;\"']*{_QUOTED}", False, ""),), "verilog": ((r"^[ \t]*`include[ \t]+\"([^\"\n]+)\"", False, ""),),
    "nix": ((r"\bimport[ \t]+(\.{0,2}/[\w./+-]+)", False, ""),), "erlang": ((r"^-[ \t]*include[ \t]*\([ \t]*\"([^\"\n]+)\"", False, ""),),
    "zig": ((r"@import[ \t]*\([ \t]*\"([^\"\n]+)\"", False, ""),), "php": ((rf"\b(?:require|include)(?:_once)?[ \t(]+{_QUOTED}[ \t)]*;", False, ""),),
    "latex": ((r"\\(?:input|include)[ \t]*\{([^{}\n]+)\}", False, ""),), "dart": ((rf"^[ \t]*(?:import|export)[ \t]+(?!['\"](?:package|dart):){_QUOTED}", False, ""),),
    "bash": ((r"(?:^|[;&|])[ \t]*(?:source|\.)[ \t]+[\"']?([^\s;&|\"'$]+)", False, ""),), "fish": ((r"(?:^|;)[ \t]*(?:source|\.)[ \t]+[\"']?([^\s;\"'$]+)", False, ""),),
    "ruby": ((rf"^[ \t]*(?:require|require_relative|load)[ \t(]+{_QUOTED}", False, ""),), "r": ((rf"(?<![\w.])source[ \t]*\([ \t]*{_QUOTED}", False, ""),),
    "racket": ((r"\(require[^()]*?\"([^\"\n]+)\"", False, ""),), "scheme": ((r"\((?:include|load)[ \t]+\"([^\"\n]+)\"", False, ""),),
    "cmake": ((r"(?i:^[ \t]*(?:include|add_subdirectory))[ \t]*\([ \t]*([^\s()\"$]+)", False, ""),), "lua": ((rf"\brequire[ \t(]+{_QUOTED}", False, ""),),
    "crystal": ((r"^[ \t]*require[ \t]+\"([^\"\n]+)\"", False, ""),), "asm": ((r"^[ \t]*[.%]include[ \t]+\"([^\"\n]+)\"", False, ""), (r"(?i:^[ \t]*include)[ \t]+\"?([^\s\";]+)\"?", False, "")),
    "powershell": ((r"^[ \t]*\.[ \t]+[\"']?([^\s\"'$]+)", True, ""), (r"(?i:^[ \t]*Import-Module)[ \t]+(?:-Name[ \t]+)?[\"']?(\.{1,2}[\\/][^\s\"']+)", False, "")),
    "ocaml": ((r"\bopen!?[ \t]+([A-Z][\w.]*)", True, ".*"),), "swift": ((r"^[ \t]*(?:@\w+[ \t]+)?import[ \t]+(?:(?:struct|class|enum|func|protocol|typealias|var|let)[ \t]+)?([A-Za-z_][\w.]*)", True, ".*"),),
    "elixir": ((r"^[ \t]*(?:alias|import|require|use)[ \t(]+([A-Z][\w.]*)(?![\w.]*\{)", True, ".*"),), "vhdl": ((r"(?i:\buse[ \t]+work)\.(\w+)", True, ""),),
    "wgsl": ((r"^[ \t]*#import[ \t]+(\"[^\"\n]+\"|[\w:./]+)", True, ""),), "hcl": ((r"\bmodule[ \t]+\"[^\"\n]*\"\s*\{[^{}]*?\bsource[ \t]*=[ \t]*\"(\.{1,2}/[^\"\n]*)\"", True, ""),),
}
_PLAIN = {lang: tuple((re.compile(p, re.M), w, s) for p, w, s in rows) for lang, rows in PLAIN.items()}


def of(s, lang: str) -> list[Import]:
    """Imports of a Source, in the order of the text."""
    found = _SPECIAL[lang](s) if lang in _SPECIAL else _plain(s, lang)
    return sorted(found, key=lambda i: i.at)


def _matches(s, pattern: str | re.Pattern, flags: int = re.M) -> Iterator[re.Match]:
    for m in re.compile(pattern, flags).finditer(s.bare) if isinstance(pattern, str) else pattern.finditer(s.bare):
        first = m.start() + len(m[0]) - len(m[0].lstrip())
        if s.code[first : first + 1] == s.bare[first : first + 1]:
            yield m


def _plain(s, lang: str) -> Iterator[Import]:
    for pattern, wildcard, added in _PLAIN.get(lang, ()):
        for m in _matches(s, pattern):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            yield Import(next(g for g in m.groups() if g is not None).strip("\"'") + added, None, wildcard, at)


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that no bracket holds, without blanks around; empty ones are left out."""
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch in "({[") - (ch in ")}]")
        if ch == mark and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [p for x in [*parts, text[last:]] if (p := x.strip())]


def use_leaves(tree: str, prefix: tuple[str, ...] = ()) -> Iterator[tuple[str, str | None, bool]]:
    """(path, name, wildcard) of each leaf of a use-tree; a renamed leaf keeps its own name."""
    tree = tree.strip()
    if tree.endswith("}") and "{" in tree:
        head, _, inner = tree[:-1].partition("{")
        for part in split_top(inner):
            yield from use_leaves(part, (*prefix, *(x.strip() for x in head.split("::") if x.strip())))
        return
    path = re.split(r"\s+as\s+", tree)[0]
    names = (*prefix, *(x.strip() for x in path.split("::") if x.strip()))
    if names:
        yield "::".join(names), (None if names[-1] == "*" else names[-1]), names[-1] == "*"


def _rust(s) -> Iterator[Import]:
    mods = [(m.end() - 1, s.pairs.get(m.end() - 1, len(s.code)), m[1]) for m in re.finditer(r"\bmod\s+(\w+)\s*\{", s.code)]
    for m in re.finditer(r"(?:^|(?<=[;{}\])]))\s*(?:pub(?:\s*\([^)]*\))?\s+)?use\s+([^;]+);", s.code, re.M):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        around = tuple(name for a, b, name in mods if a < at < b)
        for raw, name, wildcard in use_leaves(m[1]):
            yield Import(raw, name, wildcard, at, around)


def _js(s) -> Iterator[Import]:
    for m in _matches(s, r"^[ \t]*import\b(?![ \t]*[(.])\s*(?:type\s+(?!from\b))?([^;'\"`()]*?)(?:\bfrom\s*)?['\"]([^'\"\n]*)['\"]"):
        at, clause, bound = m.start() + len(m[0]) - len(m[0].lstrip()), m[1].strip(), False
        for part in split_top(clause):
            if part.startswith("{"):
                for spec in split_top(part.strip("{}")):
                    name = re.sub(r"^type\s+(?!as\b)", "", re.split(r"\s+as\s+", spec)[0].strip())
                    if re.fullmatch(r"[\w$]+", name):
                        bound = True
                        yield Import(m[2], name, False, at)
            else:
                bound = True
                yield Import(m[2], None, False, at)
        if not bound:
            yield Import(m[2], None, False, at)


def _go(s) -> Iterator[Import]:
    for m in _matches(s, r"^import\s*(\(|(?:[\w.]+[ \t]+)?[\"`][^\"`\n]+[\"`])"):
        end = s.pairs.get(m.end() - 1, m.end()) if m[1] == "(" else m.end()
        for p in re.finditer(r"[\"`]([^\"`\n]+)[\"`]", s.bare[m.start() : end]):
            yield Import(p[1], None, True, m.start() + p.start())


def _dotted(keyword: str, star: str | None) -> object:
    pattern = re.compile(rf"^[ \t]*{keyword}[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?([A-Za-z_][\w.]*?)(\.\*)?[ \t]*(?:as[ \t]+\w+[ \t]*)?(?:;|$)", re.M)

    def run(s) -> Iterator[Import]:
        for m in _matches(s, pattern):
            at, wild = m.start() + len(m[0]) - len(m[0].lstrip()), bool(m[2]) and star is not None
            yield Import(f"{m[1]}.{star}", None, True, at) if wild else Import(m[1], m[1].rsplit(".", 1)[-1], False, at)

    return run


def _scala(s) -> Iterator[Import]:
    for m in _matches(s, r"^[ \t]*import[ \t]+([^\n;]+)"):
        first = split_top(m[1])[0]
        raw = first.split("{")[0].strip().rstrip(".")
        wild = raw.endswith("_") or "{" in first
        path = raw.rstrip("_").rstrip(".") + "._" if wild else raw
        if raw:
            yield Import(path, None if wild else raw.rsplit(".", 1)[-1], wild, m.start())


def _names(text: str) -> list[str]:
    """Names of a list, without what each brings along in brackets."""
    return [n for x in split_top(text) if (n := re.split(r"[\s(=]", x.strip("()"))[0].strip())]


def _elm(s) -> Iterator[Import]:
    for m in _matches(s, r"^import[ \t]+([A-Z][\w.]*)(?:[ \t]+as[ \t]+\w+)?(?:\s+exposing\s*\()?"):
        end = s.pairs.get(m.end() - 1, m.end()) if m[0].endswith("(") else m.end()
        inner = s.code[m.end() : end].strip()
        if not m[0].endswith("("):
            yield Import(m[1], None, False, m.start())
        elif inner == "..":
            yield Import(f"{m[1]}.*", None, True, m.start())
        else:
            yield from (Import(m[1], n, False, m.start()) for n in _names(inner))


def _haskell(s) -> Iterator[Import]:
    for m in _matches(s, r"^import[ \t]+(?:safe[ \t]+)?(qualified[ \t]+)?([A-Z][\w.]*)([ \t]+qualified)?(?:[ \t]+as[ \t]+([A-Z][\w.]*))?(?:[ \t]+(hiding)\b)?\s*(\(?)"):
        own, raw = bool(m[1] or m[3]), m[2]
        inner = s.code[m.end() : s.pairs.get(m.end() - 1, m.end())] if m[6] else None
        if inner is not None and not m[5]:
            yield from (Import(raw, n, False, m.start()) for n in _names(inner))
        elif own or (m[4] and not m[5]):
            yield Import(raw, None, False, m.start())
        else:
            yield Import(f"{raw}.*", None, True, m.start())


def _d(s) -> Iterator[Import]:
    for m in _matches(s, r"^[ \t]*(?:(?:public|private|package)[ \t]+)?(static[ \t]+)?import[ \t]+([^;]+);"):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        modules, _, chosen = m[2].partition(":")
        parts = split_top(modules)
        for i, part in enumerate(parts):
            alias, _, path = part.rpartition("=")
            path = path.strip()
            if chosen and i == len(parts) - 1:
                yield from (Import(path, n.split("=")[-1].strip(), False, at) for n in split_top(chosen))
            elif m[1] or alias:
                yield Import(path, None, False, at)
            else:
                yield Import(f"{path}.*", None, True, at)


def _julia(s) -> Iterator[Import]:
    for m in _matches(s, r"^[ \t]*(using|import)[ \t]+([^\n;]+)"):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        module, colon, chosen = m[2].partition(":")
        if colon:
            yield from (Import(module.strip(), n, False, at) for n in split_top(chosen) if " as " not in n)
        else:
            for path in split_top(module):
                wild = m[1] == "using"
                yield Import(re.split(r"\s+as\s+", path)[0] + (".*" if wild else ""), None, wild, at)


def _ada(s) -> Iterator[Import]:
    for m in _matches(s, r"^[ \t]*(?:limited[ \t]+)?(?:private[ \t]+)?with[ \t]+([\w., \t\n]+?);", re.M | re.I):
        yield from (Import(p, None, True, m.start()) for p in split_top(m[1]))


def _perl(s) -> Iterator[Import]:
    for m in _matches(s, r"^[ \t]*use[ \t]+([A-Za-z_]\w*(?:::\w+)*)(?:[ \t]+qw[ \t]*([(/\[{<])([^)/\]}>]*)[)/\]}>])?[^;\n]*;"):
        if m[1][0].islower() and "::" not in m[1]:
            continue  # a pragma
        if m[2]:
            yield from (Import(m[1], n, False, m.start()) for n in m[3].split())
        else:
            yield Import(f"{m[1]}.*", None, True, m.start())


def _fortran(s) -> Iterator[Import]:
    for m in _matches(s, rf"^[ \t]*include[ \t]*{_QUOTED}", re.M | re.I):
        yield Import(m[1] or m[2], None, False, m.start())
    for m in _matches(s, r"^[ \t]*use(?:[ \t]*,[ \t]*\w+)?(?:[ \t]*::[ \t]*|[ \t]+)(\w+)[ \t]*(?:,[ \t]*only[ \t]*:((?:[^\n&]|&[ \t]*\n)*))?", re.M | re.I):
        if m[2] is None:
            yield Import(f"{m[1]}.*", None, True, m.start())
        else:
            yield from (Import(m[1], n.split("=>")[-1].strip(), False, m.start()) for n in split_top(m[2].replace("&", " ")))


def _prolog(s) -> Iterator[Import]:
    for m in _matches(s, r"^:-\s*(?:(?:use_module|consult|ensure_loaded)\s*\(\s*'([^'\n]+)'|\[([^\]]*)\])"):
        for p in [m[1]] if m[1] else split_top(m[2]):
            if re.fullmatch(r"'[^']*'|[a-z]\w*", p) or m[1]:
                yield Import(p.strip("'"), None, False, m.start())


def _nim(s) -> Iterator[Import]:
    path = lambda x: re.sub(r"\s*/\s*", "/", re.split(r"\s+as\s+|\s+except\s+", x.strip())[0]).strip('"')
    for m in _matches(s, r"^[ \t]*(import|include)[ \t]+([^\n]+(?:,[ \t]*\n[^\n]+)*)|^[ \t]*from[ \t]+(\S+(?:[ \t]*/[ \t]*\S+)*)[ \t]+import[ \t]+([^\n]+)"):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        if m[1]:
            yield from (Import(path(p), None, False, at) for p in split_top(m[2].split(" except ")[0]))
        else:
            names = [n for n in split_top(m[4]) if re.fullmatch(r"\w+", n) and n != "nil"]
            yield from (Import(path(m[3]), n, False, at) for n in names or [None])


def _graphql(s) -> Iterator[Import]:
    for m in re.finditer(r"^[ \t]*#[ \t]*import\b[^\n]*?\bfrom[ \t]+['\"]([^'\"\n]+)['\"]", s.text, re.M):
        yield Import(m[1], None, False, m.start())


_SPECIAL = {"rust": _rust, **dict.fromkeys(("javascript", "typescript", "tsx"), _js), "go": _go, "java": _dotted("import", "*"), "groovy": _dotted("import", "*"), "kotlin": _dotted("import", "*"), "csharp": _dotted(r"(?:global[ \t]+)?using", None), "scala": _scala, "elm": _elm, "haskell": _haskell, "d": _d, "julia": _julia, "ada": _ada, "perl": _perl, "fortran": _fortran, "prolog": _prolog, "nim": _nim, "graphql": _graphql}


def islands(text: str) -> Iterator[tuple[int, str, str]]:
    """(lines before, language, body) of each script of a page of components."""
    for m in re.finditer(r"<script\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</script\s*>", text, re.S | re.I):
        lang = re.search(r"\blang\s*=\s*[\"']?(\w+)", m[1])
        yield text.count("\n", 0, m.start(2)), "typescript" if lang and lang[1] in ("ts", "typescript") else "javascript", m[2]
