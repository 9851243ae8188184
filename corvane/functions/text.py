"""Text expressions: plain columns, so that they stay in the JVM and fold into scans."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _folding() -> tuple[str, str]:
    """Latin letters with marks and their bare forms, by Unicode decomposition."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(c, b) for c, b in pairs if b != c and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _folding()
TOKEN = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without marks: the form of every index and query term."""
    return F.translate(F.lower(text), MARKED, BARE)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once per row.

    Without the explode the optimizer may fold the expression into a lambda that uses it, which then works it out again
    for every element.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def query_words(query: Column) -> Column:
    """Words of a search string: split on all but letters, digits and _, of two bytes at least."""
    return F.filter(F.split(query, r"[^\p{L}\p{N}_]+"), lambda w: F.octet_length(w) >= 2)


def lines(text: Column) -> Column:
    r"""Lines ended by \n or \r\n, without a trailing empty one; none for an empty text."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def chunk(df: DataFrame, text: str = "text", window: int = 150, overlap: int = 30) -> DataFrame:
    """A row per window of lines: start_line and end_line (from 1, inclusive) and body, in place of text."""
    step = window - overlap
    d = df.withColumn("__ln", lines(F.col(text))).withColumn("__n", F.size("__ln")).where("__n > 0")
    last = F.ceil(F.greatest(F.col("__n") - window, F.lit(0)) / step).cast("int")
    d = d.withColumn("__k", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("__k") * step
    keep = [c for c in df.columns if c != text]
    return d.select(*keep, (start + 1).alias("start_line"), F.least(start + window, "__n").alias("end_line"), F.array_join(F.slice("__ln", start + 1, window), "\n").alias("body"))


def strip_block(html: Column, tag: str) -> Column:
    return F.regexp_replace(html, rf"(?s)<{tag}.*?(</{tag}>|\z)", " ")


#: Entities in the order in which they are replaced. Fixed values.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "))


def unescape(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_tags(html: Column) -> Column:
    return F.replace(F.regexp_replace(html, r"(?s)<[^>]*(>|\z)", ""), F.lit(">"), F.lit(""))


def html_to_text(html: Column) -> Column:
    plain = unescape(strip_tags(strip_block(strip_block(html, "script"), "style")))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def percent_encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


@F.pandas_udf(StringType())
def percent_decode(texts: pd.Series) -> pd.Series:
    """+ is a space, bad escapes stay, bytes that are no UTF-8 are replaced."""
    from urllib.parse import unquote_to_bytes

    return texts.map(lambda t: None if t is None else unquote_to_bytes(t.replace("+", " ")).decode("utf-8", "replace"))


def glob_regex(pattern: Column) -> Column:
    r"""A regular expression for a pattern in which * alone is special."""
    return F.concat(F.lit(r"(?s)\A"), F.replace(F.regexp_replace(pattern, r"([^A-Za-z0-9*])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit(r"\z"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[^A-Za-z]*[A-Za-z]", "")


def preview(text: Column, width: int = 160) -> Column:
    """The first line, cut to width characters, with the whole size in bytes."""
    return F.concat(F.left(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(width)), F.lit(" ("), F.octet_length(text).cast("string"), F.lit(" bytes)"))


def camel_to_snake(name: Column) -> Column:
    """Underscores before capitals that have a lower-case letter beside them, but not at the start."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z0-9])(?=[A-Z][a-z])", "_"))


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest start of the text that takes at most `most` bytes in UTF-8 and cuts no character."""
    b = F.substring(F.encode(text, "UTF-8"), 1, most)
    # At most three bytes of a cut character are at the end.
    tries = F.array(*(F.substring(F.encode(text, "UTF-8"), 1, max(most - k, 0)) for k in range(1, 4)))
    ok = lambda x: F.is_valid_utf8(x.cast("string"))
    return F.when(ok(b), b).otherwise(F.element_at(F.filter(tries, ok), 1)).cast("string")


def line_range(text: Column, start: int, end: int) -> Column:
    r"""Lines start to end (from 1, inclusive, clamped), ended as in lines(); empty if there are none."""
    lo = max(start, 1)
    return F.array_join(F.slice(lines(text), lo, max(end - lo + 1, 0)), "\n")


def fold_path(path: Column) -> Column:
    """The path with . and .. folded; null if it escapes the root. \\ counts as /."""
    seg = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("p"))
    got = F.aggregate(
        seg, start,
        lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", F.struct((a["ok"] & (F.size(a["p"]) > 0)).alias("ok"), F.slice(a["p"], F.lit(1), F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"))).otherwise(F.struct(a["ok"].alias("ok"), F.concat(a["p"], F.array(x)).alias("p"))),
    )
    return F.when(got["ok"], F.array_join(got["p"], "/"))


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")
