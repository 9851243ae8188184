"""Ignore rules against what the rules say, and a tree on disk."""

import re

import pytest

from corvane.operators import ignore
from corvane.sources import repo


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("*.log", ["a.log", "x/y.log"], ["a.logs", "log"]), ("/top", ["top"], ["x/top"]), ("a/b", ["a/b"], ["x/a/b"]), ("**/a", ["a", "x/y/a"], ["xa"]), ("a/**", ["a/b", "a/b/c"], ["a"]), ("a/**/b", ["a/b", "a/x/y/b"], ["ab", "x/a/b"]),
        ("?x", ["ax", "q/bx"], ["x", "/x"]), ("[a-c]z", ["az", "q/cz"], ["dz"]), ("[!a]z", ["bz"], ["az"]), ("a\\*b", ["a*b"], ["axb"]), ("a+b.(c)", ["a+b.(c)"], ["aab.(c)"]), ("foo", ["foo", "x/foo"], ["foobar", "barfoo"]), ("a*c", ["abc", "ac"], ["a/c"]),
    ],
)
def test_patterns(pattern, yes, no):
    rx = re.compile(ignore.pattern_regex(pattern).replace(r"\z", r"\Z"))
    assert all(rx.match(x) for x in yes) and not any(rx.match(x) for x in no)


def test_tree_on_disk(spark, tmp_path):
    tree = {
        ".gitignore": "*.log\n!keep.log\n/out/\nlogs\n#a.py\n\\#b.py\n", "pkg/__init__.py": "a", "pkg/_private.py": "b", "pkg/.gitignore": "gen*\n!generous.py\nsub/\n", "pkg/gen1.py": "c", "pkg/generous.py": "d", "pkg/sub/x.py": "e", "a.py": "f", "#b.py": "g",
        "a.log": "h", "keep.log": "i", "out/a.py": "j", "pkg/out/a.py": "k", "logs/keep.log": "l", ".git/info/exclude": "excluded.py\nkeep.log\n", "excluded.py": "m", "node_modules/x.js": "n", "pkg/target": "o", ".env": "p", "big.txt": "x" * 300,
    }
    for path, text in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r.path: bytes(r.content).decode() for r in repo.read_files(spark, str(tmp_path), max_bytes=200).collect()}
    assert got == {p: tree[p] for p in ("pkg/__init__.py", "pkg/_private.py", "pkg/generous.py", "a.py", "keep.log", "pkg/out/a.py", "pkg/target")}
    files = spark.createDataFrame([(p,) for p in got], "path string")
    assert sorted(r.entry for r in ignore.listing(files).collect()) == ["a.py", "keep.log", "pkg/"]
    assert sorted(r.entry for r in ignore.listing(files, "pkg", recursive=True).collect()) == ["__init__.py", "_private.py", "generous.py", "out/", "out/a.py", "target"]
