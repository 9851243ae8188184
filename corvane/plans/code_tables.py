"""Source files, import statements and trees of paths that follow from the table part, in Spark and in SQL alike.

Every row of part is a file. Its language goes by its key, its name by brand and size, and it refers to another row of the
same language some way on. So each query below has work that grows with the table, and SQL can say what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {n} the file's name, {c} the name referred to, {t} its key, {w} words that must not be found.
#: Per language: extension, kind, first and last line of the definition, line of the call, of a head that counts as one, text.
CODE: dict[str, tuple[str, str, int, int, int | None, int | None, str]] = {
    "c": ("c", "function_definition", 2, 4, 3, None, "// {w} {c}(1)\nint {n}(int a) {\n  return {c}(a, \"{c}(2)\");\n}\n"),
    "cpp": ("cpp", "function_definition", 1, 3, 2, None, "int {n}(int a) {\n  return x.{c}(R\"q({c}(1))q\");\n}\n"),
    "go": ("go", "function_declaration", 2, 4, 3, None, "/* {w} */\nfunc {n}(a int) int {\n\treturn pkg.{c}(`{c}(1)`)\n}\n"),
    "java": ("java", "method_declaration", 1, 3, 2, None, "  public int {n}(int a) throws E {\n    return {c}(a); // {c}(1)\n  }\n"),
    "csharp": ("cs", "method_declaration", 1, 3, 2, None, "  public int {n}(int a) {\n    return {c}(@\"{c}(1)\");\n  }\n"),
    "rust": ("rs", "function_item", 1, 3, 2, None, "pub fn {n}(a: u8) -> u8 {\n    {c}(r#\"{c}(1)\"#) /* a /* {w}() */ */\n}\n"),
    "javascript": ("js", "function_declaration", 1, 3, 2, None, "function {n}(a) {\n  return {c}(a, `{w}(1)`);\n}\n"), "typescript": ("ts", "function_declaration", 1, 3, 2, None, "export function {n}<T>(a: T): T {\n  return {c}(a);\n}\n"),
    "php": ("php", "function_definition", 2, 4, 3, None, "<?php # {w}(1)\nfunction {n}($a) {\n  return {c}($a);\n}\n"), "solidity": ("sol", "function_definition", 1, 3, 2, None, "  function {n}(uint a) public {\n    {c}(a); // {c}(1)\n  }\n"),
    "swift": ("swift", "function_declaration", 1, 3, 2, None, "func {n}(a: Int) -> Int {\n  return {c}(a)\n}\n"), "kotlin": ("kt", "function_declaration", 1, 3, None, None, "fun {n}(a: Int): Int {\n  return {c}(a)\n}\n"), "scala": ("scala", "function_definition", 1, 3, 2, None, "def {n}(a: Int): Int = {\n  {c}(a)\n}\n"),
    "dart": ("dart", "function_declaration", 1, 3, 2, None, "int {n}(int a) {\n  return {c}(a);\n}\n"), "zig": ("zig", "function_declaration", 1, 3, 2, None, "fn {n}(a: i32) i32 {\n    return {c}(a);\n}\n"), "groovy": ("groovy", "function_definition", 1, 3, 2, None, "def {n}(a) {\n  {c}(a)\n}\n"),
    "d": ("d", "function_declaration", 1, 3, 2, None, "int {n}(int a) {\n  return {c}(a); /+ {c}(1) +/\n}\n"), "objc": ("m", "function_definition", 1, 3, 2, None, "int {n}(int a) {\n  return {c}(a);\n}\n"), "glsl": ("glsl", "function_definition", 1, 3, 2, None, "float {n}(float a) {\n  return {c}(a);\n}\n"), "hlsl": ("hlsl", "function_definition", 1, 3, 2, None, "float {n}(float a) {\n  return {c}(a);\n}\n"), "wgsl": ("wgsl", "function_declaration", 1, 3, None, None, "fn {n}(a: f32) -> f32 {\n  return {c}(a);\n}\n"),
    "bash": ("sh", "function_definition", 1, 5, 2, None, "{n}() {\n  {c} \"$1\" # {w}\n  X=1\n\n}\n"), "r": ("r", "binary_operator", 1, 3, 2, None, "{n} <- function(a) {\n  {c}(a) # {c}(1)\n}\n"), "perl": ("pl", "function_definition", 1, 3, 2, None, "sub {n} {\n  return {c}($a); # {c}(1)\n}\n"), "powershell": ("ps1", "function_statement", 1, 3, 2, None, "function {n} {\n  {c} \"x\" # {w}\n}\n"),
    "graphql": ("graphql", "object_type_definition", 1, 2, None, None, "type {n} {\n}\n# {w} {c}\n"), "proto": ("proto", "message", 1, 3, None, None, "message {n} {\n  string x = 1; // {c}(1)\n}\n"), "hcl": ("tf", "block", 1, 3, 2, None, "module \"{n}\" {\n  x = {c}(\"{c}(1)\")\n}\n"),
    "ruby": ("rb", "method", 1, 5, 3, None, "def {n}(a)\n  if a # {w} end\n    {c}(a)\n  end\nend\n"), "crystal": ("cr", "method_def", 1, 5, 3, None, "def {n}(a)\n  if a\n    {c}(a)\n  end\nend\n"), "lua": ("lua", "function_declaration", 1, 5, 3, None, "function {n}(a)\n  for i = 1, 2 do\n    {c}(i, [[{c}(1)]])\n  end\nend\n"),
    "julia": ("jl", "function_definition", 1, 5, 3, 1, "function {n}(a)\n  if a > 0\n    {c}(a)\n  end\nend\n"), "elixir": ("ex", "call", 1, 5, 3, 1, "def {n}(a) do\n  if a do\n    {c}(a)\n  end\nend\n"), "fish": ("fish", "function_definition", 1, 5, 3, None, "function {n}\n  for x in 1 2\n    {c} $x\n  end\nend\n"),
    "fortran": ("f90", "subroutine", 1, 3, 2, None, "subroutine {n}(a)\n  call {c}(a) ! call {n}(1)\nend subroutine\n"), "cmake": ("cmake", "function_def", 1, 3, 2, None, "function({n} a)\n  {c}(a) # {c}(b)\nendfunction()\n"), "vim": ("vim", "function_definition", 1, 3, 2, None, "function! {n}(a)\n  call {c}(a:a)\nendfunction\n"),
    "vhdl": ("vhd", "architecture_definition", 1, 6, 4, None, "architecture {n} of top is\nbegin\n  process (a) begin\n    {c}(a);\n  end process;\nend {n};\n"), "ada": ("adb", "subprogram_body", 1, 4, 3, None, "procedure {n} (A : T) is\nbegin\n   {c} (A);\nend {n};\n"),
    "python": ("py", "function_definition", 1, 2, 2, None, "def {n}(a):\n    return {c}(a, '{w}(1)')  # {w}(2)\n"), "nim": ("nim", "proc_declaration", 1, 2, 2, None, "proc {n}(a: int): int =\n  return {c}(a)\n"), "haskell": ("hs", "function", 1, 2, 1, None, "{n} x = {c} x\n  where y = 1\n"), "elm": ("elm", "value_declaration", 1, 2, 2, None, "{n} x =\n    {c} x\n-- {w}\n"), "ocaml": ("ml", "let_binding", 1, 2, 2, None, "let {n} x =\n  {c} x\n(* {w} *)\n"),
    "racket": ("rkt", "list", 1, 2, 2, 1, "(define ({n} a)\n  ({c} a \"({w})\"))\n"), "scheme": ("scm", "list", 1, 2, 2, 1, "(define ({n} a)\n  ({c} a)) ; ({w})\n"), "erlang": ("erl", "function_clause", 1, 2, 2, None, "{n}(A) ->\n  {c}(A). % {c}(1)\n"), "prolog": ("pro", "clause", 1, 2, 2, 1, "{n}(X) :-\n  {c}(X). % {c}(1)\n"),
    "nix": ("nix", "binding", 2, 2, 2, None, "{ # {w}\n  {n} = a: {c} a;\n}\n"), "asm": ("asm", "label", 1, 1, 2, None, "{n}:\n  call {c} ; call {n}\n"), "latex": ("tex", "section", 1, 1, None, None, "\\section{{n}}\n% \\section{{c}}\n"), "verilog": ("v", "module_header", 1, 1, 2, None, "module {n}(a);\n  initial x = {c}(a); // {c}(1)\nendmodule\n"),
}
FAMILIES = {
    "extract_brace": "c cpp go java csharp rust javascript typescript php solidity swift kotlin scala dart zig groovy d objc glsl hlsl wgsl bash r perl powershell graphql proto hcl".split(),
    "extract_blocks": "ruby crystal lua julia elixir fish fortran cmake vim vhdl ada".split(),
    "extract_indented": "python nim haskell elm ocaml".split(),
    "extract_lists": "racket scheme erlang prolog nix asm latex verilog".split(),
}
#: Per language an import of {m}, with what must be found: (path, name, wildcard); {a} and {b} are names.
IMPORTS: dict[str, tuple[str, tuple[tuple[str, str | None, bool], ...]]] = {
    "rust": ("use crate::{m}::{{a}, deep::{{b} as x, more::*}, self};\n", (("crate::{m}::{a}", "{a}", False), ("crate::{m}::deep::{b}", "{b}", False), ("crate::{m}::deep::more::*", None, True), ("crate::{m}::self", "self", False))),
    "typescript": ("import all, { {a} as x, type {b} } from './{m}';\n", (("./{m}", None, False), ("./{m}", "{a}", False), ("./{m}", "{b}", False))), "javascript": ("import * as x from '../{m}';\nimport './{a}';\n", (("../{m}", None, False), ("./{a}", None, False))),
    "python": ("import {m}.{a} as x\nfrom ..{m} import {a}, {b} as y\nfrom {b} import *\n", (("{m}.{a}", None, False), ("..{m}", "{a}", False), ("..{m}", "{b}", False), ("{b}.*", None, True))), "go": ('import (\n\t"{m}"\n\tx "{a}/{b}"\n)\n', (("{m}", None, True), ("{a}/{b}", None, True))),
    "java": ("import a.{m};\nimport b.{a}.*;\n", (("a.{m}", "{m}", False), ("b.{a}.*", None, True))), "scala": ("import a.{m}\nimport a.{a}._\nimport b.{b}.{X, Y => Z}\n", (("a.{m}", "{m}", False), ("a.{a}._", None, True), ("b.{b}._", None, True))),
    "haskell": ("import A\nimport qualified B as X\nimport C (x, T(..))\nimport D hiding (y) -- {m} {a} {b}\n", (("A.*", None, True), ("B", None, False), ("C", "x", False), ("C", "T", False), ("D.*", None, True))), "ocaml": ("open M{m}\nopen! N.P\n", (("M{m}.*", None, True), ("N.P.*", None, True))),
    "perl": ("use {m}::{a} qw(x y);\nuse A::{b};\n", (("{m}::{a}", "x", False), ("{m}::{a}", "y", False), ("A::{b}.*", None, True))), "fortran": ("use {m}\nuse {a}, only: {b}, z => w\ninclude '{m}.inc'\n", (("{m}.*", None, True), ("{a}", "{b}", False), ("{a}", "w", False), ("{m}.inc", None, False))),
    "nim": ("import {m}, {a} / {b} as x\nfrom {b} import y\n", (("{m}", None, False), ("{a}/{b}", None, False), ("{b}", "y", False))), "d": ("import {m}.x : {a}, {b};\nstatic import {a};\nimport {b};\n", (("{m}.x", "{a}", False), ("{m}.x", "{b}", False), ("{a}", None, False), ("{b}.*", None, True))), "julia": ("using {m}\nimport {a}: {b}\n", (("{m}.*", None, True), ("{a}", "{b}", False))),
    "vue": ("<script lang=\"ts\">\nimport { {a} } from './{m}'\n</script>\n<p>import '{b}'</p>\n", (("./{m}", "{a}", False),)), "c": ('#include "{m}.h"\n// #include "{a}.h"\n#include <{b}.h>\n', (("{m}.h", None, False),)),
}


def _sql(x: str | int | bool | None) -> str:
    if x is None:
        return "CAST(NULL AS VARCHAR)"
    return str(x) if isinstance(x, (int, bool)) else "'" + x.replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: str) -> str:
    """Rows as a table in DuckDB."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS t({columns}))"


#: The part table as files: k key, n name, t the row referred to and c its name, or the row's own where there is none.
def base_sql(step: int) -> str:
    return f"""SELECT p.p_partkey AS k, p.p_size AS size, lower(replace(p.p_brand, '#', '')) AS brand, 'f' || lower(replace(p.p_brand, '#', '')) || '_' || CAST(p.p_size AS VARCHAR) AS n,
coalesce(q.p_partkey, p.p_partkey) AS t, coalesce(q.p_size, p.p_size) AS t_size, lower(replace(coalesce(q.p_brand, p.p_brand), '#', '')) AS t_brand,
'f' || lower(replace(coalesce(q.p_brand, p.p_brand), '#', '')) || '_' || CAST(coalesce(q.p_size, p.p_size) AS VARCHAR) AS c, p.p_name AS w
FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey + {step} * (1 + p.p_partkey % 5)"""


def base(spark: SparkSession, sf: str, step: int) -> DataFrame:
    """The same in Spark, as that SQL means the same there.

    Rows are dealt by key: they are a few bytes each, so that a whole table is one or two splits, and the work per row is not small.
    """
    rows = spark.sql(base_sql(step).replace("part p", "{part} p").replace("part q", "{part} q").replace("VARCHAR", "STRING"), part=spark.read.parquet(f"{sf}/part.parquet"))
    return rows.repartition("k")
