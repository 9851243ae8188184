"""Extraction per language, against what the fixtures say."""

import time

import pytest
from fixtures_code import FILES

from corvane.functions.languages import EXTENSIONS
from corvane.sources import extract, grammars, imports


@pytest.mark.parametrize("lang", sorted(FILES))
def test_language(lang):
    text, symbols, calls, found = FILES[lang]
    rows = extract.rows_of(text, lang)
    assert sorted(r[1:5] for r in rows if r[0] == "symbol") == sorted(symbols)
    assert sorted(r[2:4] for r in rows if r[0] == "call") == sorted(calls)
    assert sorted((r[5], r[2] or "", r[6]) for r in rows if r[0] == "import") == sorted((p, n or "", w) for p, n, w in found)


def test_every_language_with_a_grammar_has_a_fixture():
    assert set(FILES) == set(grammars.COMPILED) | {"python"} | set(imports.ISLANDS)
    assert set(FILES) <= set(EXTENSIONS)


def test_lines_of_islands_and_modules():
    rows = extract.rows_of(FILES["svelte"][0], "svelte")
    assert [(r[3], r[5]) for r in rows] == [(3, "./store")]
    assert [r[3] for r in extract.rows_of(FILES["vue"][0], "vue")] == [3, 5]
    assert [r[7] for r in extract.rows_of(FILES["rust"][0], "rust") if r[5] == "super::open"] == [["inner"]]


@pytest.mark.parametrize("lang", sorted(grammars.COMPILED))
def test_broken_text_ends(lang):
    for text in ("", "{" * 3000, '"' + "x" * 50_000, "/* " * 999, "(" * 500 + "}" * 500, "def \n" * 300, "\\\n" * 99, "'" * 7, "<<EOF\nx", "\x00\ud800".encode("utf-8", "replace").decode()):
        extract.rows_of(text, lang)


def test_masks_keep_offsets():
    for lang, (text, *_) in FILES.items():
        if lang in grammars.COMPILED:
            code, bare = extract.mask(text, grammars.COMPILED[lang])
            assert len(code) == len(bare) == len(text) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(code) if c == "\n"]
            assert all(c in (" ", t) for c, t in zip(code, text)) and all(c in (" ", t) for c, t in zip(bare, text))


def test_rows_of_a_table(spark):
    files = spark.createDataFrame([(f"a.{lang}", lang, text) for lang, (text, *_) in FILES.items()] + [("n", "rust", None), (None, "rust", "fn x() {}"), ("t", "text", "fn x() {}"), ("bad.py", "python", "def (")], "path string, lang string, text string")
    got = extract.extract(files)
    assert got.where("path = 'a.rust'").count() == len(extract.rows_of(FILES["rust"][0], "rust"))
    assert got.where("path is null or path in ('n', 't', 'bad.py')").count() == 0


@pytest.mark.parametrize("lang", ["java", "csharp"])
def test_long_names_are_read_in_linear_time(lang):
    """A line that is no method was tried in every division of its words: a name of 17 letters took two seconds, each letter more twice that."""
    start = time.perf_counter()
    rows = extract.rows_of("".join(f"import {'a' * n}.{'b' * n};\n" for n in range(1, 60)) + "class A {\n  int  x [] , b f(int a) {\n  }\n}\n", lang)
    assert time.perf_counter() - start < 2
    assert [r[1:3] for r in rows if r[0] == "symbol"][-1] == ("method_declaration", "f")
