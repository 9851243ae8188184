"""Delta maintenance: a pass over a tree that redoes what its edits touch and leaves the rest, equal to a full rebuild.

Files that have not changed keep their rows in every table. Files that were added or changed are extracted anew. Of the other
files' imports only those are resolved again of which a candidate is a path that came or went; go and rust, whose modules
are directories of a manifest, are resolved again as a whole where a file of theirs did. Vectors of chunks that are gone go too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from ..sources.snapshots import Snapshot, Store
from . import graph
from .index import chunks_of, diff
from .resolve import candidates, resolve, targets

#: Tables that hang on a file, by the column that names it.
PER_FILE = {"chunks": "path", "symbols": "file_id", "calls": "file_id", "imports": "file_id"}


def _asked(imports: DataFrame, files: DataFrame) -> DataFrame:
    f = files.select(F.col("path").alias("file_id"), F.col("path").alias("importer"), "lang")
    return imports.join(f, "file_id").select("import_id", "importer", "lang", "raw_path", "imported_name", "is_wildcard", "module_prefix")


def touched(imports: DataFrame, moved: DataFrame) -> DataFrame:
    """(import_id): imports (as resolve takes them) that paths which came or went, moved (path), may bear upon."""
    by_path = candidates(imports).join(targets(moved), ["kind", "place"]).select("import_id")
    kinds = moved.select(F.when(F.col("path").endswith(".go"), "go").when(F.col("path").endswith(".rs"), "rust").alias("lang")).where("lang is not null").distinct()
    return by_path.unionByName(imports.join(F.broadcast(kinds), "lang", "left_semi").select("import_id")).distinct()


def update(store: Store, seen: DataFrame, window: int = 150, overlap: int = 30, manifests: DataFrame | None = None, crates: DataFrame | None = None) -> tuple[Snapshot, DataFrame]:
    """A new version of the store after a pass over seen (path, lang, text, hash), and one row of counts.

    The first pass builds all. embeddings (chunk_id, ...), if the store has them, lose the vectors of chunks that are gone.
    """
    base = store.open_or_init()
    seen = seen.select("path", "lang", "text", "hash")
    files = cut(seen.drop("text"))
    old = base.read("files") if "files" in base.tables else files.limit(0)
    states = cut(diff(files, old))
    fresh = seen.join(states.where("state in ('added', 'changed')").select("path"), "path", "left_semi")
    gone = states.where("state in ('changed', 'removed')").select("path")
    moved = states.where("state in ('added', 'removed')").select("path")
    new = graph.tables(fresh, manifests, crates, paths=files.select("path")) | {"chunks": chunks_of(fresh, window, overlap)}
    out = {"files": files}
    for name, column in PER_FILE.items():
        out[name] = new[name]
        if name in base.tables:
            out[name] = base.read(name).join(gone.withColumnRenamed("path", column), column, "left_anti").unionByName(new[name])
    found = new["resolutions"]
    if "imports" in base.tables:
        still = base.read("imports").join(gone.withColumnRenamed("path", "file_id"), "file_id", "left_anti")
        again = _asked(still, files)
        again = cut(again.join(touched(again, moved), "import_id", "left_semi"))
        kept = base.read("resolutions").join(still.select("import_id"), "import_id", "left_semi").join(again.select("import_id"), "import_id", "left_anti")
        redone = resolve(again, files.select("path"), manifests, crates).select("import_id", F.col("path").alias("target_id"))
        found = kept.unionByName(found).unionByName(redone)
    out["resolutions"] = found
    if "embeddings" in base.tables:
        out["embeddings"] = base.read("embeddings").join(out["chunks"].select("chunk_id"), "chunk_id", "left_semi")
    snapshot = store.commit(base, replace=out)
    count = lambda state: F.count_if(F.col("state").isin(*state))
    stats = states.agg(count(["added", "changed", "same"]).alias("scanned"), count(["added", "changed"]).alias("indexed"), count(["same"]).alias("skipped"), count(["removed"]).alias("removed"))
    for name in ("symbols", "calls", "imports", "resolutions", "chunks"):
        stats = stats.join(F.broadcast(snapshot.read(name).agg(F.count("*").alias("resolved" if name == "resolutions" else name))))
    return snapshot, stats
