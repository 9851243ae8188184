"""The engine's own queries, each with DuckDB SQL where SQL can say the same. Ties are broken by keys, floats rounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages
from ..functions import text as T
from ..operators import callgraph, context, index, logs, search, sessions, stored_search, vector
from ..sources.shared import fingerprint, shared_dir
from ..sources.snapshots import Store
from . import code_queries  # noqa: F401  registers its queries
from .base import ORACLE, QUERIES, callers_sql, query, read

def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"select * from values {rows} as t({columns})")


def rel(rows: str, columns: str) -> str:
    return f"(SELECT * FROM (VALUES {rows}) AS t({columns}))"


_FOLD = f"translate(lower(coalesce(text, '')), '{T.MARKED}', '{T.BARE}')"
_TOK = f"regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}]+')"
TERMS = ["the", "stupid", "and", "inthat"]
_TERMS = ", ".join(f"'{t}'" for t in TERMS)
_BM = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))"
_IDF = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)"
_POST = f"toks AS (SELECT doc_id, {_TOK} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS average FROM toks), post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM toks) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
_HITS = f"WITH {_POST} SELECT doc_id, round(sum({_IDF} * {_BM}), 6) AS score FROM post JOIN dfs USING (term), st WHERE term IN ({_TERMS}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT"


def stored(spark: SparkSession, sf: str) -> stored_search.Index:
    """The stored index over documents, in the shared folder: built by the first search of a session or of a lasting folder,
    and anew where the table's files have changed."""
    at = f"{sf}/documents.parquet"
    store = Store(spark, f"{shared_dir(spark)}/search-{fingerprint(spark, at)}")
    snapshot = store.open_or_init()
    return stored_search.open_index(snapshot if "blocks" in snapshot.tables else stored_search.append(store, read(spark, sf, "documents"), "doc_id"))


@query(f"{_HITS} 10")
def bm25_search(spark, sf):
    return stored_search.bm25(stored(spark, sf), TERMS, 10).withColumnRenamed("key", "doc_id")


@query(f"WITH {_POST}, q AS (SELECT DISTINCT item_id, unnest({_TOK}) AS term FROM benchmark), s AS (SELECT item_id, doc_id, round(sum({_IDF} * {_BM}), 6) AS score FROM q JOIN post USING (term) JOIN dfs USING (term), st GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5")
def bm25_batch(spark, sf):
    return stored_search.bm25_batch(stored(spark, sf), read(spark, sf, "benchmark"), "item_id", "text", 5).withColumnRenamed("key", "doc_id")


@query(f"WITH toks AS (SELECT doc_id, {_TOK} AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM toks) SELECT doc_id, count(*) AS n FROM p WHERE t[i] = 'of' AND t[i + 1] = 'the' GROUP BY doc_id")
def phrase_search(spark, sf):
    return stored_search.phrase(stored(spark, sf), ["of", "the"]).select(F.col("key").alias("doc_id"), "n")


_MATCHED = [["of", "the"], ["stupid"], ["in", "the"], ["und"]]
_FOUND = " UNION ALL ".join(f"SELECT {i} AS p, doc_id, len(t) AS len, len(list_filter(range(1, len(t) + 1), lambda i: t[i:i + {len(w) - 1}] = {w})) AS tf FROM toks" for i, w in enumerate(_MATCHED))


@query(f"WITH toks AS (SELECT doc_id, {_TOK} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS average FROM toks), found AS (SELECT * FROM ({_FOUND}) WHERE tf > 0), dfs AS (SELECT p, count(*) AS df FROM found GROUP BY p) SELECT doc_id, round(sum({_IDF} * {_BM}), 6) AS score FROM found JOIN dfs USING (p), st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 12")
def match_search(spark, sf):
    """A search string of words, two of which are phrases by their underscore."""
    return stored_search.match(stored(spark, sf), "OF_the? stupid! in_the, (Ünd) - a", 12).withColumnRenamed("key", "doc_id")


@query("SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda w: strlen(w) >= 2), ' ') AS terms FROM benchmark")
def fts_tokens(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.array_join(T.query_words(F.col("text")), " ").alias("terms"))


@query(f"WITH {_POST} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM post GROUP BY term")
def term_stats(spark, sf):
    return stored_search.term_stats(stored(spark, sf))


@query(f"WITH toks AS (SELECT doc_id, {_TOK} AS t FROM documents), p AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM toks) SELECT doc_id, term, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM p WHERE term IN ({_TERMS}) GROUP BY ALL")
def postings(spark, sf):
    p = stored_search.postings(stored(spark, sf), TERMS)
    return p.select(F.col("key").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf"), F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(f"WITH toks AS (SELECT doc_id, {_TOK} AS t FROM documents WHERE lang IS DISTINCT FROM 'de') SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL) GROUP BY term")
def index_merge(spark, sf):
    """A segment per source of every fourth hash, appended one by one, then merged without the documents of one language."""
    d = read(spark, sf, "documents")
    store = Store(spark, f"{shared_dir(spark)}/merged-{fingerprint(spark, f'{sf}/documents.parquet')}")
    snapshot = store.open_or_init()
    for part in range(len(snapshot.tables.get("blocks", ())), 4) if snapshot.version < 5 else ():
        snapshot = stored_search.append(store, d.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == part), "doc_id")
    if snapshot.version < 5:
        snapshot = stored_search.merge(store, drop=d.where("lang = 'de'").select(F.col("doc_id").alias("key")))
    return stored_search.term_stats(stored_search.open_index(snapshot))


_LINES = r"CASE WHEN coalesce(text, '') = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(regexp_replace(text, '\r?\n\z', ''), '\r?\n') END"


def _chunks(window: int, overlap: int) -> str:
    step = window - overlap
    return f"WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents), k AS (SELECT doc_id, ls, unnest(range(0, CAST(ceil(greatest(len(ls) - {window}, 0) / {step}.0) AS BIGINT) + 1)) AS k FROM l WHERE len(ls) > 0) SELECT doc_id, CAST(k * {step} + 1 AS INTEGER) AS start_line, CAST(least(k * {step} + {window}, len(ls)) AS INTEGER) AS end_line, md5(array_to_string(ls[k * {step} + 1:k * {step} + {window}], chr(10))) AS body_md5 FROM k"


def _chunk_query(spark, sf, window, overlap):
    return T.chunk(read(spark, sf, "documents").select("doc_id", "text"), "text", window, overlap).select("doc_id", "start_line", "end_line", F.md5("body").alias("body_md5"))


query(_chunks(150, 30), "chunk_default")(lambda spark, sf: _chunk_query(spark, sf, 150, 30))
query(_chunks(8, 2), "chunk_small")(lambda spark, sf: _chunk_query(spark, sf, 8, 2))

#: What file names can look like: every known extension in either case, special names, and some that say nothing.
_ENDS = [*(f"x/a.{e.upper() if i % 3 == 0 else e}" for i, (e, _) in enumerate(languages.rows())), *(f"x/{n}" for n in languages.NAMES), "x/Dockerfile.dev", "x/README", "x/.gitignore", "a.b/c", "x/y.tar.gz", "x/.rs", "x/makefile.py", "x/dockerfile"]
_LANG_ROWS = ", ".join(f"('{e}', '{k}')" for e, k in languages.rows())
_NAME_ROWS = ", ".join(f"('{e}', '{k}')" for e, k in languages.NAMES.items())
_ENDS_SQL = rel(", ".join(f"({i}, '{e}')" for i, e in enumerate(_ENDS)), "i, e")


@query(f"WITH p AS (SELECT 'p' || doc_id || '/' || e AS path, regexp_extract(e, '([^/]*)$', 1) AS name FROM documents JOIN {_ENDS_SQL} ON i = doc_id % {len(_ENDS)}), e AS (SELECT *, lower(regexp_extract(name, '[^.][.]([^.]*)$', 1)) AS ext FROM p) SELECT path, coalesce(n.lang, CASE WHEN name LIKE 'Dockerfile.%' THEN 'dockerfile' END, x.lang, 'text') AS lang FROM e LEFT JOIN {rel(_LANG_ROWS, 'ext, lang')} x ON x.ext = e.ext LEFT JOIN {rel(_NAME_ROWS, 'nm, lang')} n ON n.nm = e.name")
def lang_tag(spark, sf):
    """A path per document, whose name goes by its id."""
    ends = F.broadcast(spark.createDataFrame(list(enumerate(_ENDS)), "i long, e string"))
    d = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % len(_ENDS)).alias("i")).join(ends, "i")
    return languages.tag(d.select(F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("/"), "e").alias("path"))).select("path", "lang")


@query("SELECT 'docs/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash FROM documents WHERE text IS NOT NULL AND strlen(text) <= 2097152")
def file_gates(spark, sf):
    f = read(spark, sf, "documents").select(F.concat(F.lit("docs\\"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size"))
    # One file too large, one binary and one ill-coded, none of which passes.
    bad = spark.sql("select * from values ('big', cast(repeat('a', 2097153) as binary)), ('binary', X'6100'), ('coded', X'C328') as t(path, content)")
    f = f.unionByName(bad.withColumn("size", F.octet_length("content").cast("long")))
    return index.gate(f).select("path", "size", "hash")


_SEEN = "SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS hash FROM documents WHERE doc_id % 11 <> 0"
_PREV = "SELECT 'd' || doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 13 <> 0"
_STATES = f"s AS ({_SEEN}), p AS ({_PREV}), states AS (SELECT coalesce(s.path, p.path) AS path, CASE WHEN p.hash IS NULL THEN 'added' WHEN s.hash IS NULL THEN 'removed' WHEN s.hash = p.hash THEN 'same' ELSE 'changed' END AS state FROM s FULL JOIN p ON s.path = p.path)"


def _snapshots(spark, sf):
    d = read(spark, sf, "documents")
    path, own = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.md5("text")
    seen = d.where("doc_id % 11 <> 0").select(path, "text", F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(own).alias("hash"))
    return seen, d.where("doc_id % 13 <> 0").select(path, "text", own.alias("hash"))


@query(f"WITH {_STATES} SELECT path, state FROM states")
def snapshot_diff(spark, sf):
    return index.diff(*_snapshots(spark, sf))


@query(f"WITH {_STATES}, n AS (SELECT count(*) AS chunks FROM ({_chunks(8, 2)}) c WHERE doc_id % 11 <> 0) SELECT count(*) FILTER (state <> 'removed') AS scanned, count(*) FILTER (state IN ('added', 'changed')) AS indexed, count(*) FILTER (state = 'same') AS skipped, count(*) FILTER (state = 'removed') AS removed, any_value(n.chunks) AS chunks FROM states, n")
def index_stats(spark, sf):
    seen, prev = _snapshots(spark, sf)
    _, chunks, states = index.update(seen, prev.drop("text"), index.chunks_of(prev, 8, 2), 8, 2)
    return index.stats(states, chunks)


@query("SELECT p_partkey, p_name, word FROM (SELECT p_partkey, p_name, CASE WHEN contains(lower(p_name), 'red') THEN 0 WHEN contains(lower(p_name), 'part') THEN 1 END AS word FROM part) WHERE word IS NOT NULL ORDER BY word, p_partkey LIMIT 8")
def symbol_like(spark, sf):
    return search.symbol_like(read(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["red", "part", "a"], 8, ["p_partkey"])


#: Tables of the shape of a call graph: part keys as names, orders as files.
_CA_FILES = "(SELECT l_orderkey AS file_id, 'f' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS path FROM lineitem GROUP BY l_orderkey)"
_CA_SYMS = "(SELECT l_orderkey AS file_id, 'p' || (l_partkey % 500) AS name, l_linenumber AS line FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 = 0 GROUP BY ALL)"
_CA_CALLS = "(SELECT l_orderkey * 10 + l_linenumber AS call_id, l_orderkey AS file_id, 'p' || (min(l_partkey) % 500) AS callee_name, l_linenumber AS line FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey, l_linenumber)"


@query(callers_sql(_CA_FILES, _CA_SYMS, _CA_CALLS, "(SELECT l_orderkey AS import_id, l_orderkey AS file_id, CAST(NULL AS VARCHAR) AS imported_name, true AS is_wildcard FROM lineitem WHERE l_orderkey % 9 = 0 GROUP BY l_orderkey)", "(SELECT l_orderkey AS import_id, l_orderkey + 3 AS target_id FROM lineitem WHERE l_orderkey % 9 = 0 GROUP BY l_orderkey)"))
def callers_all(spark, sf):
    l = read(spark, sf, "lineitem")
    name = lambda c: F.concat(F.lit("p"), (c % 500).cast("string"))
    f = l.select(F.col("l_orderkey").alias("file_id")).distinct().withColumn("path", F.concat(F.lit("f"), F.lpad(F.col("file_id").cast("string"), 9, "0")))
    s = l.where("l_linenumber = 1 and l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("file_id"), name(F.col("l_partkey")).alias("name"), F.lit("k").alias("kind"), F.lit(None).cast("string").alias("parent"), F.col("l_linenumber").alias("start_line")).distinct()
    c = l.where("l_orderkey % 3 = 0").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("l_orderkey").alias("file_id"), name(F.col("k")).alias("callee_name"), F.col("l_linenumber").alias("line"))
    i = l.where("l_orderkey % 9 = 0").select(F.col("l_orderkey").alias("import_id")).distinct()
    return callgraph.callers(c, s, f, i.select("import_id", F.col("import_id").alias("file_id"), F.lit(None).cast("string").alias("imported_name"), F.lit(True).alias("is_wildcard")), i.select("import_id", (F.col("import_id") + 3).alias("target_id")))


QUERY_VECTOR = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_QV = f"CAST([{', '.join(map(str, QUERY_VECTOR))}] AS DOUBLE[])"
_EV = "CAST(embedding AS DOUBLE[])"
_COS = "round(list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x)))), 5)"


@query(f"SELECT vec_id, {_COS.format(a=_EV, b=_QV)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf):
    return vector.top_k(read(spark, sf, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, 10)


@query("WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 5) AS score FROM embeddings, q WHERE vec_id <> qid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) SELECT qid, vec_id, score, rank FROM r WHERE rank <= 3")
def cosine_batch(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return vector.top_k_batch(e, "vec_id", "embedding", e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), "qid", 3)


@query()
def ann_batch(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    cells = vector.fit_cells(e, "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return vector.search_index(vector.build_index(e, "vec_id", "embedding", cells), "vec_id", "embedding", q, "qid", cells, 3)


@query("SELECT count(*) AS missing, CAST(min(doc_id) AS BIGINT) AS first_id FROM documents ANTI JOIN (SELECT vec_id AS doc_id FROM embeddings WHERE label = 1) USING (doc_id)")
def embed_backlog(spark, sf):
    e = read(spark, sf, "embeddings").where("label = 1").select(F.col("vec_id").alias("doc_id"), F.lit("m").alias("model"))
    return vector.backlog(read(spark, sf, "documents"), e, "doc_id", "m").agg(F.count("*").alias("missing"), F.min("doc_id").alias("first_id"))


@query(f"WITH t AS (SELECT vec_id, {_COS.format(a=_EV, b=_QV)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10) SELECT vec_id, score, lang, left(text, 40) AS head FROM t JOIN documents ON doc_id = vec_id")
def hydrate(spark, sf):
    top = vector.top_k(read(spark, sf, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, 10)
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", F.left("text", F.lit(40)).alias("head"))
    return d.join(F.broadcast(top), "vec_id").select("vec_id", "score", "lang", "head")


_PROMO = f"WITH h AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_HITS} 12)), b AS (SELECT h.*, strlen(text) AS bytes FROM h JOIN documents USING (doc_id))"


def _hits(spark, sf):
    h = stored_search.bm25(stored(spark, sf), TERMS, 12).withColumnRenamed("key", "doc_id")
    rows = h.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("h"))  # 12 rows
    ranked = rows.select(F.posexplode("h").alias("p", "x")).select(F.col("x.doc_id").alias("doc_id"), (F.col("p") + 1).alias("rank"))
    sizes = read(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return sizes.join(F.broadcast(ranked), "doc_id")


@query(f"{_PROMO} SELECT CAST(doc_id AS VARCHAR) AS path, CAST(rank AS INTEGER) AS rank, CAST(bytes AS BIGINT) AS bytes FROM b WHERE bytes <= 20000 ORDER BY rank LIMIT 3")
def promote_files(spark, sf):
    h = _hits(spark, sf).withColumn("path", F.col("doc_id").cast("string"))
    promoted, _ = context.promote(h.select("path", F.lit(1).alias("grp"), "rank"), h.select("path", "bytes"))
    return promoted.select("path", "rank", "bytes")


@query(f"{_PROMO.replace('WITH h', 'WITH RECURSIVE h')}, f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, '' AS kept UNION ALL SELECT f.i + 1, CASE WHEN f.used + b.bytes <= 18020 THEN f.used + b.bytes ELSE f.used END, CASE WHEN f.used + b.bytes <= 18020 THEN f.kept || CASE WHEN f.kept = '' THEN '' ELSE ',' END || b.rank ELSE f.kept END FROM f JOIN b ON b.rank = f.i + 1) SELECT used, kept FROM f ORDER BY i DESC LIMIT 1")
def assemble_budget(spark, sf):
    return context.assemble(_hits(spark, sf).select("rank", "bytes"), 18_020).select("used", "kept")


_TURN = "'--- ' || upper(role) || ' ---' || chr(10) || coalesce(text, '') || chr(10)"


@query(f"SELECT conv_id, right(string_agg({_TURN}, '' ORDER BY turn), 500) AS tail, CAST(length(string_agg({_TURN}, '' ORDER BY turn)) AS INTEGER) AS n_chars FROM conversations GROUP BY conv_id")
def handoff_tail(spark, sf):
    return context.handoff(read(spark, sf, "conversations"), "conv_id", "turn", "role", "text", 500)


_CTX = [1024, 8192, 32768]


@query(f"WITH c AS (SELECT conv_id, {_CTX}[conv_id % 3 + 1] AS num_ctx, CAST(sum(length(coalesce(text, ''))) AS BIGINT) * (1 + conv_id % 40) AS chars FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(least(num_ctx, greatest(2048, pow(2, ceil(log2(floor(chars / 4.0) + 2048))))) AS BIGINT) AS bucket, CAST(trunc(num_ctx * 0.55) * 4 AS BIGINT) AS budget FROM c")
def prompt_bucket(spark, sf):
    """The room for each conversation, as often over as its id says, in one of three models."""
    c = read(spark, sf, "conversations").groupBy("conv_id").agg((F.sum(F.length(F.coalesce("text", F.lit("")))) * (1 + F.col("conv_id") % 40)).alias("chars"))
    num_ctx = F.element_at(F.array(*map(F.lit, _CTX)), (F.col("conv_id") % 3 + 1).cast("int"))
    return c.select("conv_id", context.prompt_bucket(num_ctx, F.col("chars")).alias("bucket"), context.context_budget(num_ctx).alias("budget"))


def _unescape(x: str) -> str:
    for a, b in T.ENTITIES:
        x = f"replace({x}, '{a}', {chr(39) + b.replace(chr(39), chr(39) * 2) + chr(39)})"
    return x


_PLAIN = _unescape(r"replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?(</script>|\z)', ' ', 'g'), '(?s)<style.*?(</style>|\z)', ' ', 'g'), '(?s)<[^>]*(>|\z)', '', 'g'), '>', '')")


@query(rf"SELECT page_id, md5(trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("text_md5"))


@query("SELECT page_id, replace(url_encode(url || ' *~'), '%20', '+') AS encoded, url || ' *~' AS decoded FROM pages")
def url_codec(spark, sf):
    u = read(spark, sf, "pages").select("page_id", T.percent_encode(F.concat("url", F.lit(" *~"))).alias("encoded"))
    return u.withColumn("decoded", T.percent_decode("encoded"))


@query("SELECT page_id, i AS pos, l[i + 1] AS href FROM (SELECT page_id, l, unnest(range(0, len(l))) AS i FROM (SELECT page_id, list_slice(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1, 8) AS l FROM pages))")
def scrape_links(spark, sf):
    l = F.slice(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), 1, 8)
    return read(spark, sf, "pages").select("page_id", F.posexplode(l).alias("pos", "href")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query("WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM conversations), f AS (SELECT *, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY no) AS k FROM l) SELECT conv_id, turn, count(*) FILTER (line NOT LIKE '```%' AND k % 2 = 1) AS code_lines, count(*) FILTER (line NOT LIKE '```%' AND k % 2 = 0) AS prose_lines FROM f GROUP BY conv_id, turn")
def code_fences(spark, sf):
    f = sessions.fence_lines(read(spark, sf, "conversations"), ["conv_id", "turn"], "text")
    return f.groupBy("conv_id", "turn").agg(F.count_if(F.col("state") == 1).alias("code_lines"), F.count_if(F.col("state") == 0).alias("prose_lines"))


@query("SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN split_part(text, chr(10), 1) ELSE text END AS shown FROM conversations WHERE role = 'user' OR role = 'assistant' AND trim(text) <> ''")
def transcript_view(spark, sf):
    c = read(spark, sf, "conversations").where("role = 'user' or role = 'assistant' and trim(text) <> ''")
    return c.select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.split_part("text", F.lit("\n"), F.lit(1))).otherwise(F.col("text")).alias("shown"))


@query("SELECT conv_id, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS prompt_bytes, CAST(least(999, floor(sum(length(coalesce(text, ''))) / 4.0 * 100 / 8192)) AS BIGINT) AS percent FROM conversations GROUP BY conv_id")
def prompt_size(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length(t)).alias("prompt_bytes"), F.least(F.lit(999), F.floor(F.sum(F.length(t)) / 4 * 100 / 8192)).cast("long").alias("percent"))


_RULES = """(1, 'error', '*"k": 1*', 'allow'), (2, 'error', '*"k": 12*', 'deny'), (3, 'signup', cast(null as string), 'allow'), (4, 'click', '{"k": 5?}', 'deny'), (5, '*', '*77*', 'deny'), (6, 'view', '*', 'ask'), (7, '*', '{*: 3*}', 'allow')"""
_LIKE = "replace(replace(replace(replace(r.pattern, '\\', '\\\\'), '%', '\\%'), '_', '\\_'), '*', '%')"


@query(f"SELECT c.event_id, coalesce((SELECT CASE WHEN min_by(r.action, r.ord) = 'ask' THEN 'fallback' ELSE min_by(r.action, r.ord) END FROM {rel(_RULES.replace('cast(null as string)', 'CAST(NULL AS VARCHAR)'), 'ord, tool, pattern, action')} r WHERE (r.tool = '*' OR r.tool = c.event_type) AND (r.pattern IS NULL OR c.props LIKE {_LIKE} ESCAPE '\\')), 'fallback') AS verdict FROM events c")
def permission_eval(spark, sf):
    """Every event as a call of a tool, under a few rules; * alone is special in a pattern."""
    calls = read(spark, sf, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), F.col("props").alias("arg"))
    return sessions.verdicts(calls, values(spark, _RULES, "ord, tool, pattern, action")).withColumnRenamed("call_id", "event_id")


_MANIFEST = "(SELECT 's' || (user_id % 20) AS session, event_id AS seq, 'f' || (event_id % 37) AS path, CASE event_type WHEN 'signup' THEN 'Create' WHEN 'error' THEN 'Delete' ELSE 'Modify' END AS action FROM events)"


def _manifest(spark, sf):
    action = F.when(F.col("event_type") == "signup", "Create").when(F.col("event_type") == "error", "Delete").otherwise("Modify")
    return read(spark, sf, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("session"), F.col("event_id").alias("seq"), F.concat(F.lit("f"), (F.col("event_id") % 37).cast("string")).alias("path"), action.alias("action"))


@query(f"SELECT session, count(*) AS steps, count(DISTINCT path) AS paths, max(seq) + 1 AS next_seq FROM {_MANIFEST} GROUP BY session")
def session_summary(spark, sf):
    return sessions.summaries(_manifest(spark, sf))


@query(f"SELECT session, path, CASE WHEN min_by(action, seq) = 'Create' THEN 'remove' ELSE 'restore' END AS effect, min(seq) AS seq FROM {_MANIFEST} WHERE seq > 300 GROUP BY session, path")
def rollback_effect(spark, sf):
    return sessions.rollback(_manifest(spark, sf), 300)


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events ORDER BY event_id DESC LIMIT 15")
def recent_runs(spark, sf):
    return read(spark, sf, "events").orderBy(F.desc("event_id")).limit(15).select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events), b AS (SELECT user_id, t, r, t AS open FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.t, e.r, CASE WHEN e.t < b.open + 600000000 THEN b.open ELSE e.t END FROM b JOIN e ON e.user_id = b.user_id AND e.r = b.r + 1) SELECT user_id, open AS opened, count(*) AS n FROM b GROUP BY user_id, open")
def debounce_bursts(spark, sf):
    return sessions.bursts(read(spark, sf, "events").select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("t")), "user_id", "t", 600_000_000).withColumnRenamed("at", "opened")


@query("SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS seq FROM events")
def event_replay(spark, sf):
    return sessions.replay(read(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT brand, CAST(greatest(1, count(*) FILTER (s <= 0.7 * 12000)) * 3 AS BIGINT) AS slots FROM (SELECT p_brand AS brand, sum(p_size * 100) OVER (PARTITION BY p_brand ORDER BY p_size * 100, p_partkey ROWS UNBOUNDED PRECEDING) AS s FROM part) GROUP BY brand")
def concurrency_plan(spark, sf):
    """Parts as models of a brand that share a machine."""
    m = read(spark, sf, "part").select(F.col("p_brand").alias("brand"), (F.col("p_size") * 100).alias("mb"), "p_partkey")
    return context.slots(m, "brand", "mb", "p_partkey", 12_000)


#: A model's tag by a part: provider or none, family, and size.
_TAGS = ["cloudy:big-{}b", "qwen2.5-coder:{}b", "local-embed-text", "llava:{}b", "other-{}", "Cloudy:x{}B", "mixed-vision-{}b:latest"]
_TAG = f"CASE p_partkey % {len(_TAGS)} " + " ".join(f"WHEN {i} THEN " + " || ".join(x if x == "p_size" else f"'{x}'" for x in [y for part in t.split("{}") for y in (part, "p_size")][:-1] if x) for i, t in enumerate(_TAGS)) + " END"


def _tags(spark, sf):
    return spark.sql(f"select p_partkey, {_TAG} as tag from {{part}}", part=read(spark, sf, "part"))


@query(f"SELECT p_partkey, tag, CASE WHEN tag LIKE 'cloudy:%' THEN 'cloudy' ELSE 'local' END AS provider, CASE WHEN tag LIKE 'cloudy:%' THEN substring(tag, 8) ELSE tag END AS model FROM (SELECT p_partkey, {_TAG} AS tag FROM part)")
def model_route(spark, sf):
    cloud = F.split_part("tag", F.lit(":"), F.lit(1)).isin("cloudy") & F.col("tag").contains(":")
    return _tags(spark, sf).select("p_partkey", "tag", F.when(cloud, F.split_part("tag", F.lit(":"), F.lit(1))).otherwise("local").alias("provider"), F.when(cloud, F.regexp_replace("tag", "^[^:]*:", "")).otherwise(F.col("tag")).alias("model"))


@query(f"SELECT p_partkey, tag, CASE WHEN contains(tag, 'embed') THEN 'embedding' WHEN contains(tag, 'llava') THEN 'vision' WHEN contains(tag, 'coder') THEN 'code' ELSE 'general' END AS kind, TRY_CAST(nullif(regexp_extract(tag, '([0-9]+)b', 1), '') AS INTEGER) AS billions FROM (SELECT p_partkey, {_TAG} AS tag FROM part)")
def model_classify(spark, sf):
    kind = F.when(F.col("tag").contains("embed"), "embedding").when(F.col("tag").contains("llava"), "vision").when(F.col("tag").contains("coder"), "code").otherwise("general")
    return _tags(spark, sf).select("p_partkey", "tag", kind.alias("kind"), F.expr("try_cast(nullif(regexp_extract(tag, '([0-9]+)b', 1), '') as int)").alias("billions"))


@query("SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN '[x] ' ELSE '[ ] ' END || role || ' ' || turn, chr(10) ORDER BY turn) AS shown FROM conversations GROUP BY conv_id")
def plan_render(spark, sf):
    """A plan of steps per conversation, kept as JSON, rendered."""
    step = F.struct("turn", F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("text"), F.when(F.col("turn") % 2 == 0, "done").otherwise("pending").alias("status"))
    plans = read(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(step)).alias("steps"))).alias("j"))
    return plans.select("conv_id", context.rendered_plan(F.col("j")).alias("shown"))


@query(f"SELECT doc_id, coalesce(array_to_string(({_LINES})[2:4], chr(10)), '') AS lines FROM documents WHERE text IS NOT NULL")
def read_lines(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", T.line_range(F.col("text"), 2, 4).alias("lines"))


@query(f"SELECT doc_id, 'docs/' || doc_id || '.txt:1-' || len({_LINES}) || ' (' || coalesce(lang, 'text') || ')' AS header, array_to_string(({_LINES})[1:6], chr(10)) AS body FROM documents WHERE text IS NOT NULL")
def hit_rendering(spark, sf):
    header = F.format_string("docs/%s.txt:1-%d (%s)", F.col("doc_id").cast("string"), F.size(T.lines(F.col("text"))), F.coalesce("lang", F.lit("text")))
    return read(spark, sf, "documents").where("text is not null").select("doc_id", header.alias("header"), T.line_range(F.col("text"), 1, 6).alias("body"))


_COUNTED = ["documents", "pages", "embeddings", "conversations", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def table_counts(spark, sf):
    out = [read(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _COUNTED]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@query("SELECT DISTINCT p_type AS model FROM part")
def distinct_models(spark, sf):
    return read(spark, sf, "part").select(F.col("p_type").alias("model")).distinct()


@query("SELECT p_brand AS kind, min_by(p_name, {'s': p_size, 'k': p_partkey}) AS smallest, max_by(p_name, {'s': p_size, 'k': p_partkey}) AS largest FROM part GROUP BY p_brand")
def size_extremes(spark, sf):
    by = F.struct("p_size", "p_partkey")
    return read(spark, sf, "part").groupBy(F.col("p_brand").alias("kind")).agg(F.min_by("p_name", by).alias("smallest"), F.max_by("p_name", by).alias("largest"))


# The longest start of at most 300 bytes, found in SQL by summing the characters' bytes.
@query("SELECT doc_id, coalesce((SELECT string_agg(c, '' ORDER BY i) FROM (SELECT c, i, sum(octet_length(encode(c))) OVER (ORDER BY i) AS b FROM (SELECT unnest(string_split(left(text, 300), '')) AS c, generate_subscripts(string_split(left(text, 300), ''), 1) AS i)) WHERE b <= 300), '') AS cut FROM documents WHERE text IS NOT NULL")
def byte_truncation(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", T.truncate_bytes(F.col("text"), 300).alias("cut"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)")
def latest_session(spark, sf):
    c = read(spark, sf, "conversations")
    return c.join(F.broadcast(c.agg(F.max("conv_id").alias("conv_id"))), "conv_id", "left_semi").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND contains(lower(text), 'the') ORDER BY conv_id DESC, turn DESC LIMIT 20")
def history_search(spark, sf):
    """The latest 20 questions that hold a word: the limit is the feature."""
    hit = read(spark, sf, "conversations").where((F.col("role") == "user") & F.contains(F.lower("text"), F.lit("the")))
    return hit.orderBy(F.desc("conv_id"), F.desc("turn")).limit(20).select("conv_id", "turn", "text")


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s, CAST(floor(epoch((SELECT max(ts) FROM events))) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS seconds_ago FROM events")
def seconds_ago(spark, sf):
    e = read(spark, sf, "events")
    now = e.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("now"))
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.crossJoin(F.broadcast(now)).select("event_id", at.alias("epoch_s"), (F.col("now") - at).alias("seconds_ago"))


@query("SELECT count(*) > 0 AS found FROM embeddings WHERE embedding IS NOT NULL")
def has_embeddings(spark, sf):
    some = read(spark, sf, "embeddings").where("embedding is not null").limit(1)
    return some.agg((F.count("*") > 0).alias("found"))


_RUNNER = "['tests: 3 total', 'FAILED a::' || turn, '  --- FAIL: x', 'ok', 'thread panicked at ' || turn, '12 passed, 1 Failed', 'FAIL y ', '✗ z', 'E AssertionError: ' || role, '']"
_OUTPUT = f"conv_id, turn, coalesce(text, '') || CASE WHEN (conv_id + turn) % 3 = 0 THEN '' ELSE chr(10) || {_RUNNER}[(conv_id + turn) % 10 + 1] || chr(10) || {_RUNNER}[(conv_id * 7 + turn) % 10 + 1] END"
_BAD = "(starts_with(trim(line), 'FAILED ') OR starts_with(trim(line), 'FAIL ') OR starts_with(trim(line), '--- FAIL:') OR contains(line, 'AssertionError') OR contains(line, 'panicked at') OR starts_with(trim(line), '✗') OR starts_with(trim(line), '✕'))"
_SUMS = "(contains(lower(line), 'passed') OR contains(lower(line), 'failed') OR (contains(lower(line), 'tests:') AND contains(lower(line), 'total')))"


@query(rf"""WITH c AS (SELECT {_OUTPUT} AS text FROM conversations), g AS (SELECT conv_id, max(turn) % 2 = 0 AS ok, string_agg(text, chr(10) ORDER BY turn) AS text FROM c GROUP BY conv_id),
l AS (SELECT conv_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM (SELECT conv_id, {_LINES} AS ls FROM g)),
f AS (SELECT conv_id, string_agg(trim(line), chr(10) ORDER BY no) AS failing FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY no) AS r FROM l WHERE {_BAD}) WHERE r <= 20 GROUP BY conv_id),
s AS (SELECT conv_id, max_by(trim(line), no) AS sum_ FROM l WHERE {_SUMS} GROUP BY conv_id), t AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY no) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY no DESC) AS r FROM l) WHERE r <= 40 GROUP BY conv_id)
SELECT conv_id, CASE WHEN ok THEN 'TESTS PASSED' ELSE 'TESTS FAILED' END || chr(10) || CASE WHEN sum_ IS NULL AND failing IS NULL THEN chr(10) || '(no recognizable summary line — raw output tail)' || chr(10) || coalesce(tail, '') ELSE coalesce(sum_ || chr(10), '') || coalesce(chr(10) || 'failing:' || chr(10) || failing || chr(10), '') END AS summary
FROM g LEFT JOIN f USING (conv_id) LEFT JOIN s USING (conv_id) LEFT JOIN t USING (conv_id)""")
def test_output(spark, sf):
    """Conversations as logs of test runs, with lines in the manner of several runners between what they say."""
    c = spark.sql(f"select {_OUTPUT.replace('chr(10)', 'char(10)').replace('[' + chr(39), 'array(' + chr(39)).replace(', ' + chr(39) * 2 + ']', ', ' + chr(39) * 2 + ')').replace(' % 10 + 1]', ' % 10]')} as text from {{c}}", c=read(spark, sf, "conversations"))
    g = c.groupBy("conv_id").agg((F.max("turn") % 2 == 0).alias("ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return logs.summarized(g, "conv_id", "text", "ok")


@query("""WITH d AS (SELECT conv_id, turn, role, replace(replace(coalesce(text, ''), '"', ''), chr(92), '') AS t FROM conversations)
SELECT conv_id, string_agg(t, '' ORDER BY turn) FILTER (role <> 'assistant') AS content, coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS thinking, count(*) FILTER (turn % 2 = 1) > 0 AS called, coalesce(string_agg(turn || ',', '' ORDER BY turn) FILTER (turn % 2 = 1), '') AS arguments FROM d GROUP BY conv_id""")
def reply_fragments(spark, sf):
    """Each conversation as a streamed reply: a record per turn, cut into chunks of 37 bytes whatever they cut, and put together."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r'["\\\\]', "")
    call = F.when(F.col("turn") % 2 == 1, F.array(F.struct(F.lit(0).alias("index"), F.when(F.col("turn") == 1, "c1").alias("id"), F.struct(F.lit(None).cast("string").alias("name"), F.concat(F.col("turn").cast("string"), F.lit(",")).alias("arguments")).alias("function"))))
    delta = F.struct(F.when(F.col("role") != "assistant", t).alias("content"), F.when(F.col("role") == "assistant", t).alias("reasoning_content"), call.alias("tool_calls"))
    record = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices"))), F.lit("\r\n\n"))
    whole = read(spark, sf, "conversations").withColumn("record", record).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "record"))), lambda x: x["record"]), "").alias("all"))
    b = whole.withColumn("b", F.encode(F.concat("all", F.lit(": ping\n\ndata: [DONE]\ndata: {}\n")), "UTF-8"))
    chunks = b.select("conv_id", "b", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / 37).cast("int"))).alias("seq")).select("conv_id", "seq", F.expr("substring(b, seq * 37 + 1, 37)").alias("data"))
    r = logs.replies(logs.records(chunks, "conv_id", "seq", "data"), "conv_id")
    return r.select("conv_id", "content", "thinking", (F.size("calls") > 0).alias("called"), F.coalesce(F.get("calls", F.lit(0))["arguments"], F.lit("")).alias("arguments"))
