"""Import resolution: candidate paths per language, kept where a file has them. No match gives no row, never a guess.

imports: import_id, importer, lang, raw_path, imported_name (null: none), is_wildcard. paths: path. What a language tries is a row
of RULES, joined by language; candidates meet the paths in equi joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import camel_to_snake, fold_path, parent_dir

#: Extensions tried after the exact path beside the importer, by language. Fixed values.
BESIDE = {"c": "", "cpp": "", "objc": "", "glsl": "", "hlsl": "", "proto": "", "verilog": "", "cmake": "", "vim": "vim", "solidity": "sol", "nix": "nix", "bash": "sh bash", "fish": "fish", "ruby": "rb", "r": "R r", "racket": "rkt", "erlang": "hrl", "zig": "zig", "php": "php", "latex": "tex", "dart": "dart", "scheme": "scm ss", "powershell": "ps1 psm1", "crystal": "cr", "asm": "inc asm s", "prolog": "pro pl", "graphql": "graphql gql", "fortran": "inc", "nim": "nim"}
JS = ["ts", "tsx", "js", "jsx", "mjs", "cjs"]
#: Languages whose modules lie below roots: how a module becomes a path, its extensions, and the conventional roots beside the
#: root itself and every top-level directory. Fixed values.
JVM = "src/main/java src/test/java src/main/kotlin src/test/kotlin src/main/scala src/main/groovy src"
ROOTED = {
    "java": ("dotted", "java", JVM), "kotlin": ("dotted", "kt", JVM), "groovy": ("dotted", "groovy", JVM), "scala": ("dotted", "scala", JVM), "csharp": ("dotted", "cs", "src"), "elm": ("dotted", "elm", "src"),
    "haskell": ("dotted", "hs", "src app lib"), "d": ("dotted", "d", "source src"), "julia": ("dotted", "jl", "src"), "lua": ("dotted", "lua", "lua src"), "ada": ("dashed", "ads adb", "src source"), "ocaml": ("first", "ml mli", "src lib"),
    "perl": ("colons", "pm", "lib"), "fortran": ("cases", "f90 f95 f03 f08 f for F90 F95 F", "src"), "elixir": ("snake", "ex exs", "lib"), "vhdl": ("cases", "vhd vhdl", "src rtl hdl"), "nim": ("slashes", "nim", ""), "python": ("python", "", ""),
}
#: Languages in which a wildcard means all files of a directory.
PACKAGES = ("java", "kotlin", "groovy", "scala")
#: So many imports and so many files of a directory are paired at once.
BLOCK = 8192


def rules(spark: SparkSession) -> DataFrame:
    """(lang, beside, shape, exts, roots): a row per language; a null array where the language has no such rule."""
    rows = [(k, BESIDE[k].split() if k in BESIDE else None, *((ROOTED[k][0], ROOTED[k][1].split(), ["", *ROOTED[k][2].split()]) if k in ROOTED else (None, None, None))) for k in sorted({*BESIDE, *ROOTED})]
    return F.broadcast(spark.createDataFrame(rows, "lang string, beside array<string>, shape string, exts array<string>, roots array<string>"))


def beside(importer: Column, raw: Column) -> Column:
    return fold_path(F.concat(parent_dir(importer), F.lit("/"), raw))


def _below(root: Column, rel: Column) -> Column:
    return F.when(root == "", rel).otherwise(F.concat(root, F.lit("/"), rel))


def _product(a: Column, b: Column, f) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: f(x, y))))


def candidates(imports: DataFrame) -> DataFrame:
    """(import_id, lang, rank, kind, place): what an import may mean, lower ranks first.

    kind: "path", a file named from the repository; "short", one named from a top-level directory, whichever; "dir" and an
    extension, or "topdir" and one, all such files of a directory named likewise; "swift", all files of a target.
    """
    raw, name = F.col("raw_path"), F.col("imported_name")
    i = imports.join(rules(imports.sparkSession), "lang", "left")
    plain = F.regexp_replace(raw, r"[.](\*|_)$", "")
    none = F.array().cast("array<string>")
    rel = beside(F.col("importer"), raw)
    js = F.col("lang").isin("javascript", "typescript", "tsx", "svelte", "vue") & raw.rlike(r"^\.\.?/")
    near = F.when(js, F.concat(F.array(rel), *(F.array(F.concat(rel, F.lit(f".{e}"))) for e in JS), *(F.array(F.concat(rel, F.lit(f"/index.{e}"))) for e in JS[:4])))
    near = near.when(F.col("beside").isNotNull(), F.concat(F.array(rel), F.transform("beside", lambda e: F.concat(rel, F.lit("."), e))))
    # Python: dots beyond the first climb; without dots a module lies below a root.
    dots = F.length(F.regexp_extract(raw, r"^\.*", 0))
    tail = F.replace(F.regexp_replace(plain, r"^\.*", ""), F.lit("."), F.lit("/"))
    up = beside(F.col("importer"), F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), tail))

    def modules(m: Column) -> Column:
        join = lambda s: F.when(m == "", s).otherwise(F.concat(m, F.lit("/"), s))
        return F.array(F.when(m != "", F.concat(m, F.lit(".py"))), join(F.lit("__init__.py")), join(F.concat(name, F.lit(".py"))), join(F.concat(name, F.lit("/__init__.py"))))

    near = F.when((F.col("lang") == "python") & (dots > 0), modules(up)).otherwise(near)
    shape = F.col("shape")
    rooted = (
        F.when(shape == "dotted", F.array(F.replace(plain, F.lit("."), F.lit("/")))).when(shape == "dashed", F.array(F.replace(F.lower(plain), F.lit("."), F.lit("-")))).when(shape == "first", F.array(F.lower(F.split_part(plain, F.lit("."), F.lit(1)))))
        .when(shape == "colons", F.array(F.replace(plain, F.lit("::"), F.lit("/")))).when(shape == "cases", F.array_distinct(F.array(plain, F.lower(plain)))).when(shape == "slashes", F.array(raw))
        .when(shape == "snake", F.array(F.array_join(F.transform(F.split(plain, r"\."), camel_to_snake), "/")))
    )
    package = F.col("lang").isin(*PACKAGES) & F.col("is_wildcard")
    named = F.when(package, none).when((shape == "python") & (dots == 0), modules(tail)).otherwise(_product(rooted, F.col("exts"), lambda m, e: F.concat(m, F.lit("."), e)))
    below = _product(F.col("roots"), named, _below)
    packages = F.when(package, F.transform("roots", lambda r: _below(r, rooted[0])))
    later = F.when(F.col("beside").isNotNull(), 1).otherwise(0)
    dirs = F.when(F.col("lang") == "hcl", F.array(rel)).when(F.col("lang") == "swift", F.array(F.concat(F.lit("Sources/"), F.split_part(plain, F.lit("."), F.lit(1))))).otherwise(packages)

    want = reduce(lambda a, k: a.when(F.col("lang") == k, F.lit(ROOTED[k][1])), PACKAGES, F.when(F.col("lang") == "hcl", F.lit("tf")))

    def each(places: Column, kind: Column, rank: Column) -> Column:
        return F.coalesce(F.transform(F.filter(places, lambda x: x.isNotNull()), lambda x: F.struct(kind.alias("kind"), x.alias("place"), rank.alias("rank"))), F.array().cast("array<struct<kind:string,place:string,rank:int>>"))

    found = F.concat(
        each(near, F.lit("path"), F.lit(0)), each(below, F.lit("path"), later), each(named, F.lit("short"), later),
        each(dirs, F.when(F.col("lang") == "swift", F.lit("swift")).otherwise(F.concat(F.lit("dir."), want)), F.lit(0)), each(F.when(package, F.slice(rooted, 1, 1)), F.concat(F.lit("topdir."), want), F.lit(0)),
    )
    return i.select("import_id", "lang", F.explode(F.array_distinct(found)).alias("c")).select("import_id", "lang", "c.*")


def targets(paths: DataFrame) -> DataFrame:
    """(kind, place, path): each file under every name that a candidate may have for it."""
    path, ext = F.col("path"), F.regexp_extract("path", r"\.([^./]*)$", 1)
    inner, directory = F.regexp_replace(path, r"\A[^/]*/", ""), parent_dir(path)
    deep = F.contains(path, F.lit("/"))
    row = lambda kind, place: F.struct(kind.alias("kind"), place.alias("place"))
    packaged = ext.isin("tf", *(ROOTED[k][1] for k in PACKAGES))
    all_ = F.array(
        row(F.lit("path"), path), row(F.lit("short"), F.when(deep, inner)), row(F.when(packaged, F.concat(F.lit("dir."), ext)), directory),
        row(F.when(packaged & F.contains(directory, F.lit("/")), F.concat(F.lit("topdir."), ext)), parent_dir(inner)),
        row(F.when((ext == "swift") & path.rlike(r"\ASources/[^/]+/"), F.lit("swift")), F.concat(F.lit("Sources/"), F.split_part(path, F.lit("/"), F.lit(2)))),
    )
    return paths.select("path", F.explode(F.filter(all_, lambda x: x["kind"].isNotNull() & x["place"].isNotNull())).alias("t")).select("t.kind", "t.place", "path")


def directories(path: Column) -> tuple[Column, Column]:
    """(set, directory): the files that some import means as one, of which path is one; nulls for a path that is in no such set."""
    ext = F.regexp_extract(path, r"\.([^./]*)$", 1)
    target = (ext == "swift") & path.rlike(r"\ASources/[^/]+/")
    set_ = F.when(target, F.lit("swift")).when(ext.isin("tf", "go", *(ROOTED[k][1] for k in PACKAGES)), ext)
    return set_, F.when(target, F.concat(F.lit("Sources/"), F.split_part(path, F.lit("/"), F.lit(2)))).when(set_.isNotNull(), parent_dir(path))


def resolve(imports: DataFrame, paths: DataFrame, manifests: DataFrame | None = None, crates: DataFrame | None = None) -> DataFrame:
    """Distinct (import_id, path).

    What means single files is one equi join of candidates and files, for which no file is sent on where no import means any. What
    means all files of a directory is joined to directories, once for all imports that say the same, and last to their files.
    """
    lang = F.col("lang")
    package = lang.isin(*PACKAGES) & F.coalesce("is_wildcard", F.lit(False))
    one = imports.where(~(lang.isin("go", "hcl", "swift") | package))
    some = one.select(F.lit(1)).exists()
    found = candidates(one).join(targets(paths.where(some)).where(F.col("kind").isin("path", "short")), ["kind", "place"]).select("import_id", "lang", "rank", "path")
    # Where a language looks beside the importer first, what lies below a root counts only if nothing does.
    twice = sorted(set(BESIDE) & set(ROOTED))
    best = F.min(F.when(F.col("lang").isin(twice), F.col("rank"))).over(Window.partitionBy("import_id"))
    files = found.withColumn("best", best).where(F.col("best").isNull() | (F.col("rank") == F.col("best"))).select("import_id", "path")
    files = files.unionByName(resolve_rust(imports, paths.where(some), crates)).distinct()

    set_, directory = directories(F.col("path"))
    placed = paths.select(set_.alias("set"), directory.alias("directory"), "path").where("set is not null")
    members = placed.repartition("set", "directory").distinct()
    known = placed.select("set", "directory").distinct()
    # Only hcl's directories depend on where the importer lies.
    asked = imports.where(lang.isin("hcl", "swift") | package).withColumn("at", F.when(lang == "hcl", parent_dir(F.col("importer"))).otherwise(""))
    said = asked.groupBy("lang", "at", "raw_path").agg(F.min("importer").alias("importer")).select("lang", "raw_path", "importer", F.struct("lang", "at", "raw_path").alias("import_id"), F.lit(None).cast("string").alias("imported_name"), lang.isin(*PACKAGES).alias("is_wildcard"))
    d = F.col("directory")
    inner = F.when((F.col("set") != "swift") & F.contains(d, F.lit("/")), F.regexp_replace(d, r"\A[^/]*/", ""))
    named = lambda kind, place: F.struct(kind.alias("kind"), place.alias("place"))
    kinds = F.array(named(F.when(F.col("set") == "swift", "swift").otherwise(F.concat(F.lit("dir."), "set")), d), named(F.concat(F.lit("topdir."), "set"), inner))
    names = known.select("set", "directory", F.inline(F.filter(kinds, lambda x: x["place"].isNotNull())))
    means = candidates(said).join(names, ["kind", "place"]).select("import_id.*", "set", "directory").distinct()
    meant = asked.select("import_id", "lang", "at", "raw_path").join(means, ["lang", "at", "raw_path"]).select("import_id", "set", "directory")
    meant = meant.unionByName(go_directories(imports, known.where("set = 'go'"), manifests))
    # A file that an import also means by itself is one of the directory's.
    files = files.withColumns({"set": set_, "directory": directory}).join(meant.where(some), ["import_id", "set", "directory"], "left_anti").select("import_id", "path")
    return files.unionByName(_pairs(meant.repartition("set", "directory").distinct(), members))


def _pairs(meant: DataFrame, members: DataFrame) -> DataFrame:
    """(import_id, path) of imports and files of a directory, both distinct and dealt by (set, directory).

    These can be as many as imports times files. They are made last, in blocks of BLOCK imports and BLOCK files of a directory that
    are dealt over tasks each for itself, and are neither sorted nor sent on. Ids go along in lists, so that a task holds one
    list a block, and the rows of one file come together, which a column store keeps in few bytes.
    """
    key = ["set", "directory"]
    block = lambda by: F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(by)) - 1) / BLOCK).cast("int")
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Structs, as a list of ids leaves out nulls.
    ids = meant.withColumn("i", block("import_id")).groupBy(*key, "i").agg(F.collect_list(F.struct("import_id")).alias("ids"))
    ids = ids.join(blocks(members, "n"), key).select(*key, "i", "ids", each("n").alias("j"))
    files = members.withColumn("j", block("path")).join(blocks(meant, "n"), key).select(*key, "j", "path", each("n").alias("i"))
    # By a given number, as tasks are joined up by what they read, which says little of what they make.
    n = int(meant.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, *key, "i", "j").join(ids, [*key, "i", "j"]).select(F.inline("ids"), "path")


def go_directories(imports: DataFrame, known: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(import_id, set, directory), of known: the directory that an import path names below the module whose path is its longest prefix.

    manifests: (dir, module) of each go.mod; without any, nothing resolves.
    """
    if manifests is None:
        return imports.select("import_id", F.lit("go").alias("set"), F.col("raw_path").alias("directory")).limit(0)
    i = imports.where("lang = 'go'").select("import_id", "raw_path", F.split("raw_path", "/").alias("s"))
    pre = i.select("import_id", "raw_path", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda n: F.array_join(F.slice("s", 1, n), "/"))).alias("module"))
    best = pre.join(manifests, "module").groupBy("import_id", "raw_path").agg(F.max_by(F.struct("module", "dir"), F.length("module")).alias("m"))
    rest = F.col("raw_path").substr(F.length("m.module") + 2, F.length("raw_path"))
    want = best.select("import_id", F.array_join(F.filter(F.array("m.dir", rest), lambda x: x != ""), "/").alias("directory"))
    return want.join(known, "directory").select("import_id", "set", "directory")


def resolve_rust(imports: DataFrame, paths: DataFrame, crates: DataFrame | None = None) -> DataFrame:
    """Files that a use path means: below the crate that owns the importer (crate, self, super) or another crate's src.

    crates: (name, dir, src) of each Cargo package; without any, a crate at the root with src is taken.
    """
    spark = imports.sparkSession
    crates = crates if crates is not None else spark.createDataFrame([("", "", "src")], "name string, dir string, src string")
    i = imports.where("lang = 'rust'")
    segs = F.split(F.regexp_replace("raw_path", r"::\*$", ""), "::")
    dirs = F.split(parent_dir(F.col("importer")), "/")
    pre = i.select("import_id", "importer", segs.alias("s"), F.coalesce(F.col("module_prefix"), F.array().cast("array<string>")).alias("inner"), F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda n: F.array_join(F.slice(dirs, 1, n), "/")))).alias("dir")) if "module_prefix" in i.columns else i.select("import_id", "importer", segs.alias("s"), F.array().cast("array<string>").alias("inner"), F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda n: F.array_join(F.slice(dirs, 1, n), "/")))).alias("dir"))
    own = pre.join(crates.select("dir", F.col("src").alias("src")), "dir").groupBy("import_id", "importer", "s", "inner").agg(F.max_by("src", F.length("dir")).alias("src"))
    below = F.col("importer").substr(F.length("src") + 2, F.length("importer"))
    stem = F.regexp_replace(below, r"(^|/)(lib|main|mod)\.rs$|\.rs$", "")
    module = F.concat(F.filter(F.split(stem, "/"), lambda x: x != ""), "inner")
    first = F.element_at("s", 1)
    supers = F.size(F.filter("s", lambda x: x == "super"))
    rest = F.slice("s", F.lit(2), F.size("s"))
    target = F.when(first == "crate", rest).when(first == "self", F.concat(module, rest)).when(first == "super", F.concat(F.slice(module, F.lit(1), F.greatest(F.size(module) - supers, F.lit(0))), F.slice("s", supers + 1, F.size("s"))))
    local = own.select("import_id", "src", target.alias("t")).where("t is not null")
    other = own.select("import_id", first.alias("k"), rest.alias("t")).join(crates.select(F.replace("name", F.lit("-"), F.lit("_")).alias("k"), "src"), "k").select("import_id", "src", "t")
    both = local.unionByName(other)
    shorter = F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))
    t = both.select("import_id", "src", F.explode(F.when(F.size("t") > 0, F.array(F.col("t"), shorter)).otherwise(F.array("t"))).alias("t"))
    base = F.concat_ws("/", "src", F.array_join("t", "/"))
    path = F.when(F.size("t") == 0, F.array(F.concat("src", F.lit("/lib.rs")), F.concat("src", F.lit("/main.rs")))).otherwise(F.array(F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs"))))
    return t.select("import_id", F.explode(path).alias("path")).join(paths.select("path"), "path", "left_semi").select("import_id", "path")
