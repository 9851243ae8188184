"""Language tags by file name. A tag is what other tables are keyed by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = {
    "rust": "rs", "python": "py pyw", "javascript": "js jsx mjs cjs", "typescript": "ts mts cts", "tsx": "tsx", "c": "c h", "cpp": "cc cpp cxx hpp hh hxx", "go": "go", "java": "java", "csharp": "cs",
    "php": "php php3 php4 php5 phtml", "ruby": "rb rake gemspec", "bash": "sh bash zsh", "lua": "lua", "solidity": "sol", "powershell": "ps1 psm1 psd1", "haskell": "hs lhs", "fish": "fish", "dart": "dart", "zig": "zig",
    "julia": "jl", "groovy": "groovy gvy gradle", "graphql": "graphql gql", "crystal": "cr", "d": "d di", "asm": "asm s", "elixir": "ex exs", "scala": "scala sc", "swift": "swift", "perl": "pl pm t",
    "r": "r", "ocaml": "ml mli", "elm": "elm", "nim": "nim nims", "erlang": "erl hrl", "vim": "vim", "latex": "tex latex sty cls", "nix": "nix", "hcl": "hcl tf tfvars", "cmake": "cmake",
    "verilog": "v vh", "vhdl": "vhd vhdl", "fortran": "f90 f95 f03 f08 f for", "prolog": "pro", "racket": "rkt", "scheme": "scm ss", "proto": "proto", "svelte": "svelte", "vue": "vue", "objc": "m mm",
    "glsl": "glsl vert frag geom comp tesc tese", "hlsl": "hlsl fx", "wgsl": "wgsl", "ada": "adb ads", "kotlin": "kt kts", "html": "html htm", "css": "css scss sass less", "json": "json jsonc", "yaml": "yml yaml", "toml": "toml",
    "xml": "xml xsd xsl", "markdown": "md markdown", "sql": "sql", "ini": "ini cfg conf",
}
NAMES = {"Dockerfile": "dockerfile", "Containerfile": "dockerfile", "Makefile": "makefile", "makefile": "makefile", "GNUmakefile": "makefile", "CMakeLists.txt": "cmake"}


def rows() -> list[tuple[str, str]]:
    return [(e, lang) for lang, ext in EXTENSIONS.items() for e in ext.split()]


def tag(df: DataFrame, path: str = "path") -> DataFrame:
    """df with lang: by exact name, then the Dockerfile. prefix, then the extension in lower case, else text."""
    spark: SparkSession = df.sparkSession
    name = F.regexp_extract(F.col(path), r"([^/]*)\z", 1)
    ext = F.translate(F.regexp_extract(name, r"[^.]\.([^.]*)\z", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_name: Column = F.lit(None).cast("string")
    for k, v in NAMES.items():
        by_name = F.when(name == k, v).otherwise(by_name)
    table = F.broadcast(spark.createDataFrame(rows(), "__ext string, __lang string"))
    j = df.withColumn("__e", ext).join(table, F.col("__e") == F.col("__ext"), "left")
    return j.withColumn("lang", F.coalesce(by_name, F.when(name.startswith("Dockerfile."), "dockerfile"), "__lang", F.lit("text"))).drop("__e", "__ext", "__lang")
