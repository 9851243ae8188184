"""What each language's imports mean, one small tree for all rules."""

import pytest

from corvane.operators import resolve

PATHS = """lib/token.sol lib/mod.zig lib/page.php lib/run.psm1 lib/types.hrl lib/io.s lib/io.inc lib/w.dart lib/q.gql lib/f.fish lib/b.bash lib/k.ss lib/c.cmake
x/near.nim near.nim far.nim src/main/java/boot.py boot.py tools/boot.py src/defs.f90 src/main/defs.inc work/defs.inc src/solo.f90 src/other.F95
src/app/Cat.kt src/app/Cat.kts app/Dog.hs app/Dog.lhs source/io/pipe.d source/io/pipe.di zone/io/pipe.d lua/net/http.lua hdl/alu.vhd rtl/ALU.vhdl src/Data/Bag.elm
src/main/scala/org/zoo/A.scala src/main/scala/org/zoo/B.scala zone/org/zoo/C.scala src/org/zoo/D.java lib/Text/Wrap.pm src/geo-shape.ads zone/core.mli lib/shop/http_cart.exs
web/a.ts web/b/index.tsx web/c.mjs pkg/__init__.py pkg/sub.py __init__.py top.py""".split()
CASES = [
    ("solidity", "lib/a.sol", "./token", "lib/token.sol"), ("zig", "lib/a.zig", "mod", "lib/mod.zig"), ("php", "lib/a.php", "page", "lib/page.php"), ("powershell", "lib/a.ps1", "./run", "lib/run.psm1"), ("erlang", "lib/a.erl", "types", "lib/types.hrl"),
    ("asm", "lib/a.s", "io", "lib/io.inc lib/io.s"), ("dart", "lib/a.dart", "./w", "lib/w.dart"), ("graphql", "lib/a.gql", "./q", "lib/q.gql"), ("fish", "lib/a.fish", "./f", "lib/f.fish"), ("bash", "lib/a.sh", "./b", "lib/b.bash"), ("scheme", "lib/a.scm", "k", "lib/k.ss"),
    ("cmake", "lib/CMakeLists.txt", "c", ""), ("cmake", "lib/CMakeLists.txt", "c.cmake", "lib/c.cmake"), ("c", "lib/a.c", "../../x.h", ""),
    ("nim", "x/a.nim", "near", "x/near.nim"), ("nim", "x/a.nim", "far", "far.nim"), ("python", "a.py", "boot", "boot.py tools/boot.py"), ("fortran", "work/a.f90", "defs", "work/defs.inc"), ("fortran", "a.f90", "Solo.*", "src/solo.f90"), ("fortran", "a.f90", "other.*", "src/other.F95"),
    ("kotlin", "a.kt", "app.Cat", "src/app/Cat.kt"), ("haskell", "a.hs", "Dog.*", "app/Dog.hs"), ("d", "a.d", "io.pipe.*", "source/io/pipe.d zone/io/pipe.d"), ("lua", "a.lua", "net.http", "lua/net/http.lua"), ("vhdl", "a.vhd", "ALU", "hdl/alu.vhd rtl/ALU.vhdl"), ("elm", "a.elm", "Data.Bag", "src/Data/Bag.elm"),
    ("scala", "a.scala", "org.zoo._", "src/main/scala/org/zoo/A.scala src/main/scala/org/zoo/B.scala zone/org/zoo/C.scala"), ("java", "a.java", "org.zoo.*", "src/org/zoo/D.java"), ("perl", "a.pl", "Text::Wrap.*", "lib/Text/Wrap.pm"), ("ada", "a.adb", "Geo.Shape", "src/geo-shape.ads"), ("ocaml", "a.ml", "Core.Sub.*", "zone/core.mli"), ("elixir", "a.ex", "Shop.HTTPCart.*", "lib/shop/http_cart.exs"),
    ("typescript", "web/x.ts", "./a", "web/a.ts"), ("vue", "web/x.vue", "./b", "web/b/index.tsx"), ("svelte", "web/x.svelte", "../web/c", "web/c.mjs"), ("javascript", "web/x.js", "a", ""), ("wgsl", "web/x.wgsl", "a.ts", ""), ("text", "web/x", "./a.ts", ""),
    ("python", "pkg/a.py", ".", "pkg/__init__.py"), ("python", "pkg/a.py", "..top", "top.py"), ("python", "pkg/a.py", "...top", ""), ("python", "top.py", ".", "__init__.py"),
]


@pytest.fixture(scope="module")
def found(spark):
    i = spark.createDataFrame([(n, at, lang, raw, None, raw.endswith((".*", "._"))) for n, (lang, at, raw, _) in enumerate(CASES)], "import_id int, importer string, lang string, raw_path string, imported_name string, is_wildcard boolean")
    got = {}
    for r in resolve.resolve(i, spark.createDataFrame([(p,) for p in PATHS], "path string")).collect():
        got.setdefault(r.import_id, set()).add(r.path)
    return got


@pytest.mark.parametrize("n", range(len(CASES)), ids=lambda n: f"{CASES[n][0]}-{CASES[n][2]}")
def test_import(found, n):
    assert found.get(n, set()) == set(CASES[n][3].split())


def test_rows_of_whole_directories_are_not_shuffled(spark):
    """500 imports of a directory of 500 files: each pair once, and what is sent between tasks grows with imports and files alone."""
    files = [f"{d}/f{n}.{e}" for d, e in (("m/p", "go"), ("src/org/p", "java"), ("Sources/P/x", "swift"), ("mods/p", "tf")) for n in range(500)]
    asked = {"go": "ex.io/m/p", "java": "org.p.*", "swift": "P.*", "hcl": "./mods/p"}
    i = spark.createDataFrame([(f"{lang}{n}", "top.x", lang, raw, None, True) for lang, raw in asked.items() for n in range(500)], "import_id string, importer string, lang string, raw_path string, imported_name string, is_wildcard boolean")
    paths = spark.createDataFrame([(p,) for p in files + files], "path string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        it, out = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator(), {}
        while it.hasNext():
            s = it.next()
            out[s.stageId()] = s.shuffleWriteRecords()
        return out

    before = stages()
    found = resolve.resolve(i, paths, spark.createDataFrame([("m", "ex.io/m")], "dir string, module string"))
    got = found.selectExpr("count(*) as n", "count(distinct import_id) as i").first()
    # count(distinct import_id) sends an id on once a task.
    assert (got.n, got.i) == (4 * 500 * 500, 2000)
    assert sum(v for k, v in stages().items() if k not in before) < 60_000


def _same(spark, lang, raw, files, n=600):
    """n imports that say the same and a file's whole neighbourhood."""
    i = spark.createDataFrame([(k, f"d{k % 3}/top.x" if lang != "hcl" else "top.x", lang, raw, None, True) for k in range(n)], "import_id long, importer string, lang string, raw_path string, imported_name string, is_wildcard boolean")
    return i, spark.createDataFrame([(p,) for p in files], "path string")


WHOLE = {"java": ("org.p.*", "src/main/java/org/p/F{}.java"), "swift": ("P.Part.*", "Sources/P/f{}.swift"), "hcl": ("./mods/p", "mods/p/f{}.tf")}


@pytest.mark.parametrize("lang", WHOLE)
def test_imports_that_say_the_same_are_looked_up_once(spark, lang):
    """600 imports and 600 files: no row for each root that an import may lie below, nor for each name that a file may go by."""
    raw, at = WHOLE[lang]
    i, paths = _same(spark, lang, raw, [at.format(n) for n in range(600)])
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        it, out = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator(), 0
        while it.hasNext():
            out += it.next().shuffleWriteRecords()
        return out

    before = written()
    resolve.resolve(i, paths).write.format("noop").mode("overwrite").save()
    # Imports go by what they say and by directory, files by directory; then both by block.
    assert written() - before < 2_600


@pytest.mark.parametrize("lang", WHOLE)
def test_rows_of_a_file_come_together(spark, lang):
    raw, at = WHOLE[lang]
    i, paths = _same(spark, lang, raw, [at.format(n) for n in range(50)], 200)
    rows = [r.path for r in resolve.resolve(i, paths).collect()]
    assert len(rows) == 50 * 200 and sum(a != b for a, b in zip(rows, rows[1:])) == 49


def test_directories_of_many_blocks_are_whole(spark, monkeypatch):
    """Blocks of 4: each pair once, whichever side has more; a null id and the files that an import also means by itself included."""
    monkeypatch.setattr(resolve, "BLOCK", 4)
    files = [f"src/org/{d}/F{k}.java" for d, n in (("p", 13), ("q", 1), ("r", 4)) for k in range(n)]
    rows = [(k, "top.x", "java", raw, None, True) for raw, ids in (("org.p.*", range(3)), ("org.q.*", range(3, 20)), ("org.r.*", [20, 21, 22, None]), ("org.p.*", [3, 3])) for k in ids]
    rows += [(0, "top.x", "java", "org.p.F1", None, False), (1, "top.x", "java", "org.q.F0", None, False), (7, "top.x", "java", "org.p.F2", None, None)]
    i = spark.createDataFrame(rows, "import_id long, importer string, lang string, raw_path string, imported_name string, is_wildcard boolean")
    want = {(k, p) for k, _, _, raw, _, wild in rows for p in files if (p.startswith("src/" + raw[:-1].replace(".", "/")) if wild else p == "src/" + raw.replace(".", "/") + ".java")}
    got = [tuple(r) for r in resolve.resolve(i, spark.createDataFrame([(p,) for p in files + files], "path string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
