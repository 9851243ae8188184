"""Which files of a tree are walked: hidden entries, directories that never are, and the rules of ignore files.

Rules are a table, joined to the directories above each entry. Of the rules that fit an entry the one of the deepest directory,
and there the last, decides; ! takes back, and a trailing slash means directories alone. What lies below an ignored
directory is ignored, whatever rules say of it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parent_dir

#: Directories that are never walked. Fixed values.
SKIP_DIRS = (".git", "target", "node_modules", "dist", "build", "venv", ".venv", "__pycache__", ".mypy_cache", ".idea", ".vscode")


def pattern_regex(pattern: str) -> str | None:
    """A regular expression, over paths named from the rules' directory, for an ignore pattern without ! and trailing slash.

    None for a pattern that means nothing. A slash at the start or inside ties the pattern to the directory; * and ? stop at
    slashes, and ** between slashes does not.
    """
    anchored = "/" in pattern
    pattern = pattern.removeprefix("/")
    if not pattern:
        return None
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern[i:] == "**" and i and pattern[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif ch == "*":
            out, i = out + "[^/]*", i + len(re.match(r"\*+", pattern[i:])[0])
        elif ch == "?":
            out, i = out + "[^/]", i + 1
        elif ch == "[" and (m := re.match(r"\[([!^]?)(\]?[^\]]*)\]", pattern[i:])):
            inner = re.sub(r"([\\\[&~])", r"\\\1", m[2])
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{inner}]", i + len(m[0])
        else:
            if ch == "\\" and i + 1 < len(pattern):
                i, ch = i + 1, pattern[i + 1]
            out, i = out + re.sub(r"([^A-Za-z0-9_/])", r"\\\1", ch), i + 1
    return f"\\A{'' if anchored else '(?:.*/)?'}{out}\\z"


def rules(ignore_files: DataFrame) -> DataFrame:
    """(dir, ord, negated, dir_only, rx) of ignore files (path, text): dir is the directory of the file, ord its line."""

    @F.pandas_udf("string")
    def regex(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: None if p is None else pattern_regex(p))

    lines = ignore_files.select(parent_dir(F.col("path")).alias("dir"), F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line"))
    # Blanks at the end do not count unless escaped; # starts a comment and ! takes back, unless escaped.
    line = F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")
    lines = lines.withColumn("line", line).where("line <> '' and line not like '#%'")
    lines = lines.withColumn("negated", F.col("line").startswith("!")).withColumn("p", F.when(F.col("line").startswith("!"), F.expr("substring(line, 2)")).otherwise(F.col("line")))
    lines = lines.withColumn("dir_only", F.col("p").endswith("/")).withColumn("rx", regex(F.regexp_replace("p", "/$", "")))
    # A slash at the end alone does not tie the pattern.
    return lines.where("rx is not null").select("dir", "ord", "negated", "dir_only", "rx")


def prefixes(path: Column) -> Column:
    """The directories above a path, the root '' first."""
    s = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda n: F.array_join(F.slice(s, F.lit(1), n), "/"))


def decided(entries: DataFrame, ruled: DataFrame) -> DataFrame:
    """The entries (path, is_dir) that rules ignore, each by itself: path."""
    e = entries.select("path", "is_dir", F.explode(prefixes(F.col("path"))).alias("dir"))
    rel = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    hits = e.join(ruled, "dir").where(F.col("is_dir") | ~F.col("dir_only"))
    hits = hits.withColumn("rel", rel).where("rel rlike rx")
    return hits.groupBy("path").agg(F.max_by("negated", F.struct(F.length("dir"), "ord")).alias("negated")).where("not negated").select("path")


def walk(files: DataFrame, ruled: DataFrame | None = None, skip: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """The rows of files (path, ...) that are walked. Directories are what paths have above them, each looked at once."""
    parts = F.split("path", "/")
    open_ = files.where(~F.exists(parts, lambda x: x.startswith(".")) & ~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.isin(*skip)))
    if ruled is None:
        return open_
    dirs = open_.select(F.explode(prefixes(F.col("path"))).alias("path")).where("path <> ''").distinct()
    shut = decided(dirs.withColumn("is_dir", F.lit(True)), ruled).select(F.col("path").alias("gone"))
    above = open_.select("path", F.explode(prefixes(F.col("path"))).alias("gone")).join(shut, "gone").select("path")
    own = decided(open_.select("path").distinct().withColumn("is_dir", F.lit(False)), ruled)
    return open_.join(above.unionByName(own).distinct(), "path", "left_anti")


def listing(files: DataFrame, directory: str = "", recursive: bool = False) -> DataFrame:
    """(entry): what lies in a directory of walked files, directories with a slash; all that lies below it if recursive."""
    inside = files.select("path") if directory == "" else files.where(F.col("path").startswith(directory + "/")).select(F.expr(f"substring(path, {len(directory) + 2})").alias("path"))
    s = F.split("path", "/")
    depth = F.size(s) if recursive else F.lit(1)
    names = F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(F.array_join(F.slice(s, F.lit(1), n), "/"), F.when(n < F.size(s), "/").otherwise("")))
    return inside.select(F.explode(names).alias("entry")).distinct()
