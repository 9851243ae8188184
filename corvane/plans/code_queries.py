"""Queries over source files: extraction, import resolution and the call graph, on files that follow from part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callgraph, delta, graph, ignore, resolve
from ..sources import extract
from ..sources.shared import cut, fingerprint, shared_dir
from ..sources.snapshots import Store
from .base import callers_sql, query
from .code_tables import CODE, FAMILIES, IMPORTS, base, base_sql, values_sql


def _filled(text, **by: str):
    """A template with its places filled by columns."""
    for place, column in by.items():
        text = F.replace(text, F.lit("{" + place + "}"), F.col(column))
    return text


def _filled_sql(text: str, **by: str) -> str:
    for place, column in by.items():
        text = f"replace({text}, '{{{place}}}', CAST({column} AS VARCHAR))"
    return text


def _templates(spark: SparkSession, sf: str, rows: list[tuple], columns: str, step: int) -> DataFrame:
    """part as files of len(rows) languages, each with the row of its language."""
    return base(spark, sf, step).withColumn("idx", (F.col("k") % len(rows)).cast("int")).join(F.broadcast(spark.createDataFrame(rows, columns)), "idx")


def _family(langs: list[str]):
    rows = [(i, lang, CODE[lang][0], CODE[lang][6]) for i, lang in enumerate(langs)]

    def run(spark, sf):
        t = _templates(spark, sf, rows, "idx int, lang string, ext string, text string", len(langs))
        files = t.select(F.format_string("src/%d.%s", "k", "ext").alias("path"), "lang", _filled(F.col("text"), n="n", c="c", w="w").alias("text"))
        return extract.extract(files).select("path", "what", "kind", "name", "start_line", "end_line")

    facts = values_sql([(i, *CODE[lang][:4], CODE[lang][4] or 0, CODE[lang][5] or 0) for i, lang in enumerate(langs)], "idx, ext, kind, a, z, cl, head")
    return run, f"""WITH b AS ({base_sql(len(langs))}), f AS (SELECT *, 'src/' || k || '.' || ext AS path FROM b JOIN {facts} l ON l.idx = b.k % {len(langs)})
SELECT path, 'symbol' AS what, kind, n AS name, CAST(a AS INTEGER) AS start_line, CAST(z AS INTEGER) AS end_line FROM f
UNION ALL SELECT path, 'call', 'call', c, CAST(cl AS INTEGER), CAST(cl AS INTEGER) FROM f WHERE cl > 0
UNION ALL SELECT path, 'call', 'call', n, CAST(head AS INTEGER), CAST(head AS INTEGER) FROM f WHERE head > 0"""


for _name, _langs in FAMILIES.items():
    _run, _want = _family(_langs)
    query(_want, _name)(_run)

#: The query of the first two languages' code by the name it has had.
_run, _want = _family(["python", "rust"])
query(f"SELECT path, what, name, start_line AS line FROM ({_want})", "extract_code")(lambda spark, sf, run=_run: run(spark, sf).select("path", "what", "name", F.col("start_line").alias("line")))

_ILANGS = list(IMPORTS)
_LEAVES = values_sql([(i, p, n, w) for i, lang in enumerate(_ILANGS) for p, n, w in IMPORTS[lang][1]], "idx, p, x, is_wildcard")
_PLACES = {"m": "n", "a": "c", "b": "'p' || t_size"}


@query(f"SELECT 'src/' || k || '.' || (k % {len(_ILANGS)}) AS path, {_filled_sql('p', **_PLACES)} AS raw_path, coalesce({_filled_sql('x', **_PLACES)}, '') AS name, is_wildcard FROM ({base_sql(len(_ILANGS))}) b JOIN {_LEAVES} l ON l.idx = b.k % {len(_ILANGS)}")
def extract_imports(spark, sf):
    """Import statements of 16 languages, with nested trees, lists of names and islands."""
    rows = [(i, lang, IMPORTS[lang][0]) for i, lang in enumerate(_ILANGS)]
    t = _templates(spark, sf, rows, "idx int, lang string, text string", len(rows)).withColumn("p", F.concat(F.lit("p"), "t_size"))
    files = t.select(F.format_string("src/%d.%d", "k", "idx").alias("path"), "lang", _filled(F.col("text"), m="n", a="c", b="p").alias("text"))
    return extract.extract(files).where("what = 'import'").select("path", "raw_path", F.coalesce("name", F.lit("")).alias("name"), "is_wildcard")


# The call graph: classes with a method that calls the method of another file, which is imported by name, or all of it.
_GRAPH = [
    (0, "python", "py/m{k}.py", "from m{t} import {c}\nclass K{n}:\n    def {n}(self):\n        return {c}(1)  # {w}(2)\n"),
    (1, "typescript", "ts/m{k}.ts", "import { {c} } from './m{t}';\nexport class K{n} {\n  {n}(a: number) {\n    return {c}(a, \"{w}(1)\");\n  }\n}\n"),
    (2, "haskell", "hs/M{k}.hs", "import M{t}\n{n} x = {c} x\n  where y = 1\n"),
]
_PATH = "CASE b.k % 3 WHEN 0 THEN 'py/m' || {0} || '.py' WHEN 1 THEN 'ts/m' || {0} || '.ts' ELSE 'hs/M' || {0} || '.hs' END"
_FACTS = f"""b AS ({base_sql(3)}), fl AS (SELECT *, {_PATH.format('k')} AS path, {_PATH.format('t')} AS target FROM b),
sy AS (SELECT path AS file_id, path || CASE WHEN k % 3 = 2 THEN ':2:' || n || ':function' WHEN k % 3 = 1 THEN ':3:' || n || ':method_definition' ELSE ':3:' || n || ':function_definition' END AS symbol_id, n AS name, CASE WHEN k % 3 = 2 THEN 2 ELSE 3 END AS line, CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 3 END AS last, CASE WHEN k % 3 < 2 THEN 'K' || n END AS parent FROM fl
  UNION ALL SELECT path, path || ':2:K' || n || CASE WHEN k % 3 = 0 THEN ':class_definition' ELSE ':class_declaration' END, 'K' || n, 2, CASE WHEN k % 3 = 0 THEN 4 ELSE 6 END, NULL FROM fl WHERE k % 3 < 2),
ca AS (SELECT path || CASE WHEN k % 3 = 2 THEN ':2:' ELSE ':4:' END || c AS call_id, path AS file_id, c AS callee_name, CASE WHEN k % 3 = 2 THEN 2 ELSE 4 END AS line, n AS caller FROM fl),
im AS (SELECT path AS import_id, path AS file_id, CASE WHEN k % 3 < 2 THEN c END AS imported_name, k % 3 = 2 AS is_wildcard FROM fl)"""


def _files(spark, sf):
    """(k, path, lang, text) of the graph's files."""
    t = base(spark, sf, 3).withColumn("idx", (F.col("k") % 3).cast("int")).join(F.broadcast(spark.createDataFrame(_GRAPH, "idx int, lang string, p string, text string")), "idx")
    t = t.withColumn("k", F.col("k").cast("string")).withColumn("t", F.col("t").cast("string"))
    return t.select(F.col("k").cast("long").alias("k"), _filled(F.col("p"), k="k").alias("path"), "lang", _filled(F.col("text"), n="n", c="c", t="t", w="w").alias("text"))


def _graph(spark, sf):
    return graph.tables(_files(spark, sf).drop("k"))


@query(f"WITH {_FACTS} SELECT symbol_id, name, parent FROM sy")
def symbol_parent(spark, sf):
    return _graph(spark, sf)["symbols"].select("symbol_id", "name", "parent")


@query(f"WITH {_FACTS} SELECT call_id, symbol_id AS caller_symbol_id FROM ca JOIN sy ON sy.file_id = ca.file_id AND sy.name = ca.caller")
def call_owner(spark, sf):
    return _graph(spark, sf)["calls"].select("call_id", "caller_symbol_id")


@query(f"WITH {_FACTS} SELECT * FROM ({callers_sql('(SELECT path AS file_id, path FROM fl)', 'sy', 'ca', 'im', '(SELECT path AS import_id, target AS target_id FROM fl)', 'c.caller')})")
def callers(spark, sf):
    g = _graph(spark, sf)
    return callgraph.callers(g["calls"], g["symbols"], g["files"], g["imports"], g["resolutions"])


@query(f"WITH {_FACTS}, r AS (SELECT s.name AS caller, c.file_id AS path, c.line, c.callee_name, row_number() OVER (PARTITION BY s.name ORDER BY c.file_id, c.line, c.callee_name) AS r FROM ca c JOIN sy s ON s.file_id = c.file_id AND s.name = c.caller) SELECT caller, path, string_agg(line || ':' || callee_name, ',' ORDER BY line, callee_name) AS calls FROM r WHERE r <= 30 GROUP BY caller, path")
def callees(spark, sf):
    g = _graph(spark, sf)
    return callgraph.callees(g["calls"], g["symbols"], g["files"].select("file_id", "path"))


# Resolution: every row is a file somewhere below a root that its language has, or not, and imports another row's module.
_MODULE = {"dotted": ("org/{b}/M{s}", "org.{b}.M{s}"), "dashed": ("org-{b}-m{s}", "Org.{b}.M{s}"), "first": ("{b}m{s}", "{b}m{s}.Sub.*"), "colons": ("Org/{b}/M{s}", "Org::{b}::M{s}.*"), "cases": ("{b}m{s}", "{b}m{s}"), "slashes": ("{b}/m{s}", "{b}/m{s}"), "snake": ("{b}/http_mod{s}", "{b}.HTTPMod{s}.*"), "python": ("{b}/m{s}", "{b}.m{s}")}


def _resolved(name: str, langs: list[str]) -> None:
    """A query for these languages: files below conventional roots, below any top-level directory, or too deep to be found."""
    n, rows, roots = len(langs), [], []
    for i, lang in enumerate(langs):
        shape, exts, known = resolve.ROOTED[lang]
        path, raw = _MODULE[shape]
        known = ["", *known.split()]
        for j, root in enumerate([*known, "zone", "too/deep"]):
            rows.append((i, j, len(known) + 2, lang, root + "/" if root else "", (exts or "py").split()[0], path, raw))
        roots += [(i, r + "/" if r else "") for r in known]

    def run(spark, sf):
        t = base(spark, sf, n).withColumn("idx", (F.col("k") % n).cast("int"))
        t = t.join(F.broadcast(spark.createDataFrame(rows, "idx int, j int, of int, lang string, root string, ext string, p string, raw string")), "idx").where(F.floor(F.col("k") / n) % F.col("of") == F.col("j"))
        for c in ("size", "t_size"):
            t = t.withColumn(c, F.col(c).cast("string"))
        t = cut(t.select("k", "lang", F.concat("root", _filled(F.col("p"), b="brand", s="size"), F.lit("."), "ext").alias("path"), _filled(F.col("raw"), b="t_brand", s="t_size").alias("raw_path")))
        i = t.select(F.col("k").alias("import_id"), F.col("path").alias("importer"), "lang", "raw_path", F.lit(None).cast("string").alias("imported_name"), F.lit(False).alias("is_wildcard"))
        return resolve.resolve(i, t.select("path").distinct())

    places, other = {"b": "brand", "s": "size"}, {"b": "t_brand", "s": "t_size"}
    query(f"""WITH b AS ({base_sql(n)}), l AS (SELECT * FROM {values_sql(rows, 'idx, j, of_, lang, root, ext, p, raw')} t), ro AS (SELECT * FROM {values_sql(roots, 'idx, root')} t),
f AS (SELECT k, l.idx, root, {_filled_sql('p', **places)} || '.' || ext AS own, {_filled_sql('p', **other)} || '.' || ext AS want FROM b JOIN l ON l.idx = b.k % {n} AND l.j = (b.k // {n}) % l.of_),
d AS (SELECT DISTINCT idx, root, own FROM f)
SELECT f.k AS import_id, d.root || d.own AS path FROM f JOIN d ON d.idx = f.idx AND d.own = f.want WHERE d.root = 'zone/' OR EXISTS (SELECT 1 FROM ro WHERE ro.idx = d.idx AND ro.root = d.root)""", name)(run)


for _name, _langs in {"resolve_dotted": "java kotlin groovy scala csharp elm haskell d julia lua", "resolve_flat": "ada ocaml perl fortran vhdl", "resolve_elixir": "elixir", "resolve_python": "python"}.items():
    _resolved(_name, _langs.split())


def _beside(name: str, langs: list[str], index: bool = False) -> None:
    """A query for languages whose imports are paths: every row imports another by a path with or without its extension."""
    n = len(langs)
    exts = ["ts"] * n if index else [(resolve.BESIDE[x].split() or [x])[-1] for x in langs]
    rows = [(i, lang, exts[i], bool(index or resolve.BESIDE[lang])) for i, lang in enumerate(langs)]
    at = ["/" + "index" if index else "", ""]

    def run(spark, sf):
        t = base(spark, sf, n).withColumn("idx", (F.col("k") % n).cast("int")).join(F.broadcast(spark.createDataFrame(rows, "idx int, lang string, ext string, bare boolean")), "idx")
        inner = lambda c: F.when(F.col(c) % 2 == 0, at[0]).otherwise(at[1])
        t = cut(t.select("k", "lang", F.concat(F.lit("d"), "size", F.lit("/"), "n", inner("size"), F.lit("."), "ext").alias("path"), F.concat(F.lit("../d"), "t_size", F.lit("/./"), "c", F.when(F.col("bare"), "").otherwise(F.concat(F.lit("."), "ext"))).alias("raw_path"), "n", "size"))
        # An importer lies in a directory of the first level, whatever its own file is called.
        i = t.select(F.col("k").alias("import_id"), F.concat(F.lit("d"), "size", F.lit("/importer")).alias("importer"), "lang", "raw_path", F.lit(None).cast("string").alias("imported_name"), F.lit(False).alias("is_wildcard"))
        return resolve.resolve(i, t.select("path").distinct())

    path = "'d' || {1}size || '/' || {0} || CASE WHEN {1}size % 2 = 0 THEN '" + at[0] + "' ELSE '" + at[1] + "' END || '.' || ext"
    query(f"""WITH f AS (SELECT k, {path.format('n', '')} AS own, {path.format('c', 't_')} AS want FROM ({base_sql(n)}) b JOIN {values_sql(rows, 'idx, lang, ext, bare')} l ON l.idx = b.k % {n})
SELECT DISTINCT f.k AS import_id, f.want AS path FROM f JOIN f g ON g.own = f.want""", name)(run)


_beside("resolve_relative", [x for x in resolve.BESIDE if x not in ("nim", "fortran")])
_beside("resolve_nim", ["nim"])
_beside("resolve_js", ["javascript", "typescript", "tsx", "svelte", "vue"], index=True)


def _by_directory(name: str, lang: str, path: str, raw: str, manifest: bool = False) -> None:
    """A query for a language whose imports mean all files of a directory."""

    def run(spark, sf):
        t = base(spark, sf, 1)
        for c in ("k", "size", "t_size"):
            t = t.withColumn(c, F.col(c).cast("string"))
        t = cut(t.select("k", "brand", _filled(F.lit(path), k="k", b="brand", s="size").alias("path"), _filled(F.lit(raw), b="t_brand", s="t_size").alias("raw_path")))
        i = t.select(F.col("k").cast("long").alias("import_id"), F.lit("top.x").alias("importer"), F.lit(lang).alias("lang"), "raw_path", F.lit(None).cast("string").alias("imported_name"), F.lit(True).alias("is_wildcard"))
        mods = t.select(F.col("brand").alias("dir"), F.concat(F.lit("ex.io/"), "brand").alias("module")).distinct() if manifest else None
        return resolve.resolve(i, t.select("path"), mods)

    query(f"WITH b AS ({base_sql(1)}) SELECT x.k AS import_id, {_filled_sql(repr(path), k='y.k', b='y.brand', s='y.size')} AS path FROM b x JOIN b y ON y.brand = x.t_brand AND y.size = x.t_size", name)(run)


_by_directory("resolve_go", "go", "{b}/p{s}/f{k}.go", "ex.io/{b}/p{s}", manifest=True)
_by_directory("resolve_swift", "swift", "Sources/{b}x{s}/f{k}.swift", "{b}x{s}.Part.*")
_by_directory("resolve_hcl", "hcl", "mods/{b}/m{s}/f{k}.tf", "./mods/{b}/m{s}")
_by_directory("resolve_packages", "java", "src/main/java/{b}/p{s}/F{k}.java", "{b}.p{s}.*")


@query(f"""WITH b AS ({base_sql(1)}), f AS (SELECT DISTINCT brand, size FROM b)
SELECT DISTINCT b.k AS import_id, 'crates/' || f.brand || '/src/m' || f.size || CASE WHEN f.size % 3 = 0 THEN '/mod.rs' ELSE '.rs' END AS path FROM b JOIN f ON f.size = b.t_size AND f.brand = CASE WHEN b.k % 2 = 0 THEN b.brand ELSE b.t_brand END""")
def resolve_rust(spark, sf):
    """Even rows use a module of their own crate, odd ones a function of another's."""
    b = cut(base(spark, sf, 1))
    at = lambda brand, size: F.concat(F.lit("crates/"), brand, F.lit("/src/m"), size, F.when(F.col(size) % 3 == 0, "/mod.rs").otherwise(".rs"))
    raw = F.when(F.col("k") % 2 == 0, F.concat(F.lit("crate::m"), "t_size")).otherwise(F.concat(F.lit("c_"), "t_brand", F.lit("::m"), "t_size", F.lit("::run")))
    i = b.select(F.col("k").alias("import_id"), at("brand", "size").alias("importer"), F.lit("rust").alias("lang"), raw.alias("raw_path"), F.lit(None).cast("string").alias("imported_name"), F.lit(False).alias("is_wildcard"))
    crates = b.select(F.concat(F.lit("c-"), "brand").alias("name"), F.concat(F.lit("crates/"), "brand").alias("dir"), F.concat(F.lit("crates/"), "brand", F.lit("/src")).alias("src")).distinct()
    return resolve.resolve(i, b.select(at("brand", "size").alias("path")).distinct(), crates=crates)


# Conventional and top-level roots together, over one tree of several languages.
_resolved("resolve_roots", ["python", "java", "vhdl", "lua"])


#: Ignore files of the tree below, as text and as what SQL makes of them: directory, line, negated, directories alone, expression.
_IGNORE = {".gitignore": "# top\n*.log\n/only_here\nbrand1*/m?/\n!keep.log\ndeep/**/x\\ y\n\ncache/  \n", "brand2/.gitignore": "*\n!*.txt\n!m*/\n", "brand3/.gitignore": "m[1-3]\n!m2\n/keep.log\n"}
_RULED = [("", 1, False, False, "(.*/)?[^/]*[.]log"), ("", 2, False, False, "only_here"), ("", 3, False, True, "brand1[^/]*/m[^/]"), ("", 4, True, False, "(.*/)?keep[.]log"), ("", 5, False, False, "deep/([^/]+/)*x y"), ("", 7, False, True, "(.*/)?cache"),
          ("brand2", 0, False, False, "(.*/)?[^/]*"), ("brand2", 1, True, False, "(.*/)?[^/]*[.]txt"), ("brand2", 2, True, True, "(.*/)?m[^/]*"), ("brand3", 0, False, False, "(.*/)?m[123]"), ("brand3", 1, True, False, "(.*/)?m2"), ("brand3", 2, False, False, "keep[.]log")]
_LEAF = "CASE k % 11 WHEN 0 THEN 'keep.log' WHEN 1 THEN 'a' || k || '.log' WHEN 2 THEN 'only_here' WHEN 3 THEN 'cache/a' || k || '.txt' WHEN 4 THEN '.hidden' WHEN 5 THEN 'target/x.c' WHEN 6 THEN 'cache' WHEN 7 THEN 'x y' WHEN 8 THEN '.venv/b.py' ELSE 'a' || k || '.txt' END"
_TREE = f"SELECT DISTINCT CASE WHEN k % 13 = 0 THEN '' WHEN k % 13 = 1 THEN 'deep/' || brand || '/' ELSE brand || '/m' || size || '/' END || {_LEAF} AS path FROM ({{}})"


def _tree(spark, sf):
    b = base(spark, sf, 1)
    return spark.sql(_TREE.format("select * from {b}"), b=b)


_WALKED = f"""t AS ({_TREE.format(base_sql(1))}), s AS (SELECT path, string_split(path, '/') AS p FROM t),
o AS (SELECT * FROM s WHERE len(list_filter(p, lambda x: starts_with(x, '.'))) = 0 AND NOT list_has_any(p[1:len(p) - 1], {list(ignore.SKIP_DIRS)})),
e AS (SELECT path, unnest(range(1, len(p) + 1)) AS n, p FROM o), en AS (SELECT DISTINCT path, array_to_string(p[1:n], '/') AS entry, n < len(p) AS is_dir FROM e),
ru AS (SELECT * FROM {values_sql(_RULED, 'dir, ord, negated, dir_only, rx')} t),
h AS (SELECT en.path, entry, negated, row_number() OVER (PARTITION BY en.path, entry ORDER BY length(dir) DESC, ord DESC) AS r FROM en JOIN ru ON (dir = '' OR starts_with(entry, dir || '/')) AND (is_dir OR NOT dir_only) AND regexp_full_match(CASE WHEN dir = '' THEN entry ELSE substring(entry, length(dir) + 2) END, rx)),
w AS (SELECT path FROM o ANTI JOIN (SELECT path FROM h WHERE r = 1 AND NOT negated) USING (path))"""


def _walked(spark, sf):
    files = spark.createDataFrame(list(_IGNORE.items()), "path string, text string")
    return ignore.walk(_tree(spark, sf), ignore.rules(files))


@query(f"WITH {_WALKED} SELECT path FROM w")
def ignored_walk(spark, sf):
    """A tree of part's rows under three ignore files."""
    return _walked(spark, sf).select("path")


@query(f"WITH {_WALKED}, d AS (SELECT string_split(path, '/') AS p FROM w), n AS (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM d) SELECT DISTINCT array_to_string(p[1:n], '/') || CASE WHEN n < len(p) THEN '/' ELSE '' END AS entry FROM n")
def list_tree(spark, sf):
    return ignore.listing(_walked(spark, sf), recursive=True)


def _passes(spark, sf):
    """A store after two passes: in the first every seventh file is not there yet and every fifth says something else; in the
    second all are as they should be, less every eleventh, which is gone. The counts of the second pass, and the store."""
    store = Store(spark, f"{shared_dir(spark)}/delta-{fingerprint(spark, f'{sf}/part.parquet')}")
    if store.open_or_init().version >= 2:
        return store.open(2)
    files = cut(_files(spark, sf)).withColumn("hash", F.md5("text"))
    if store.open().version < 1:
        first = files.where("k % 7 <> 3").withColumn("text", F.when(F.col("k") % 5 == 0, F.concat(F.lit("\n"), "text")).otherwise(F.col("text"))).withColumn("hash", F.md5("text"))
        delta.update(store, first, 2, 1)
    return delta.update(store, files.where("k % 11 <> 4"), 2, 1)[0]


_LEFT = "fl.k % 11 <> 4"


@query(f"WITH {_FACTS}, g AS (SELECT path FROM fl WHERE {_LEFT}) SELECT im.import_id || CASE WHEN k % 3 = 2 THEN ':1:M' || t || '.*' WHEN k % 3 = 1 THEN ':1:./m' || t || ':' || c ELSE ':1:m' || t || ':' || c END AS import_id, target AS target_id FROM fl JOIN im ON im.file_id = fl.path JOIN g ON g.path = fl.target WHERE {_LEFT}")
def delta_resolutions(spark, sf):
    """What imports resolve to after an update, which must be what a full rebuild gives."""
    return _passes(spark, sf).read("resolutions")


@query(f"WITH {_FACTS} SELECT symbol_id, name, parent FROM sy JOIN fl ON fl.path = sy.file_id WHERE {_LEFT}")
def delta_symbols(spark, sf):
    return _passes(spark, sf).read("symbols").select("symbol_id", "name", "parent")


@query(f"WITH {_FACTS}, l AS (SELECT path, CASE WHEN k % 3 = 0 THEN 4 WHEN k % 3 = 1 THEN 6 ELSE 3 END AS n FROM fl WHERE {_LEFT}), w AS (SELECT path, n, unnest(range(1, greatest(n - 1, 1) + 1)) AS s FROM l) SELECT path, CAST(s AS INTEGER) AS start_line, CAST(least(s + 1, n) AS INTEGER) AS end_line FROM w")
def delta_chunks(spark, sf):
    return _passes(spark, sf).read("chunks").select("path", "start_line", "end_line")
