"""Tokens, postings, vectors, chunks, links and messages over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.registry import Context, query
from graphloom.catalog.sqltext import GRAPH, NODES, bm25_index, bm25_scores, dense_scores, fused, top
from graphloom.functions import jsonprops, links, messages, scoring, text, vectors
from graphloom.operators import chunking, containment, reindex, textindex, vectorsearch
from graphloom.plans.retrieve import fuse_ranks

N = "cast(count(*) as bigint)"
DOC_QUERY = "the worthless that edston the"
DOC_TOKENS = DOC_QUERY.split()
GRAPH_QUERY = "worthless edston widget blue thouinor"
GRAPH_TOKENS = GRAPH_QUERY.split()
_DOCS = "SELECT doc_id AS id, lang AS label, text FROM documents"


def _documents(c: Context):
    return c.table("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text")


def _doc_index(c: Context) -> textindex.TextIndex:
    return c._once("documents", lambda: textindex.TextIndex.build(_documents(c)))


# --- index and BM25 ----------------------------------------------------------

@query("doc_freq", f"WITH {bm25_index(_DOCS)} SELECT term, cast(df as bigint) AS doc_freq FROM dfreq")
def doc_freq(c: Context):
    return _doc_index(c).terms.select("term", "doc_freq")


@query("term_freq", f"WITH {bm25_index(_DOCS)} SELECT id, term, cast(f as bigint) AS tf, cast(dl as int) AS doc_len FROM tf2")
def term_freq(c: Context):
    return _doc_index(c).postings.select("id", "term", "tf", "doc_len")


@query("corpus_stats", f"""WITH {bm25_index(_DOCS)} SELECT cast(n as bigint) AS documents, round(avgdl, 6) AS avg_len,
  (SELECT {N} FROM dfreq) AS terms, round((SELECT avg(raw) FROM idf0), 6) AS mean_idf FROM corpus""")
def corpus_stats(c: Context):
    return textindex.corpus_stats(_documents(c)).select(
        "documents", F.round("avg_len", 6).alias("avg_len"), "terms", F.round("mean_idf", 6).alias("mean_idf"))


@query("bm25_documents", f"WITH {bm25_index(_DOCS)}, {bm25_scores(DOC_TOKENS)} "
       "SELECT id, round(score, 6) AS score FROM sparse_all")
def bm25_documents(c: Context):
    return _doc_index(c).scores(DOC_QUERY).select("id", F.round("score", 6).alias("score"))


@query("bm25_topk", f"WITH {NODES}, {bm25_index()}, {bm25_scores(GRAPH_TOKENS)}, {top('sparse_all', 20, 'best')} "
       "SELECT id, label, round(score, 6) AS score FROM best")
def bm25_topk(c: Context):
    return c.retriever.bm25(GRAPH_QUERY, 20).select("id", "label", F.round("score", 6).alias("score"))


# --- vectors -----------------------------------------------------------------

@query("dense_topk", f"WITH {NODES}, {dense_scores(0)}, {top('dense_all', 20, 'best')} "
       "SELECT id, label, round(score, 6) AS score FROM best")
def dense_topk(c: Context):
    r = c.retriever
    scores = vectorsearch.cosine_scores(r.node_vectors, c.vector(0)).select("id", "label", "score")
    return (scores.filter("score > 0").orderBy(F.desc("score"), "id").limit(20)
            .select("id", "label", F.round("score", 6).alias("score")))


@query("dense_pooled", f"WITH {NODES}, {dense_scores(0, with_snippets=40)}, {top('dense_all', 40, 'best')} "
       "SELECT id, label, round(score, 6) AS score FROM best")
def dense_pooled(c: Context):
    return c.retriever.dense(c.vector(0), 40).select("id", "label", F.round("score", 6).alias("score"))


@query("dense_terms_only", f"WITH {NODES}, {dense_scores(0)}, terms AS (SELECT * FROM dense_all WHERE label = 'BusinessTerm'), "
       f"{top('terms', 10, 'best')} SELECT id, round(score, 6) AS score FROM best")
def dense_terms_only(c: Context):
    return c.retriever.dense(c.vector(0), 10, terms_only=True).select("id", F.round("score", 6).alias("score"))


_Q0 = "(SELECT embedding::double[] AS q FROM embeddings WHERE vec_id = 0)"
_COS = ("list_dot_product(embedding::double[], q) / sqrt(list_dot_product(embedding::double[], embedding::double[])) "
        "/ sqrt(list_dot_product(q, q))")


@query("snippet_maxpool", f"SELECT 'doc:' || (vec_id % 50) AS id, round(max({_COS}), 6) AS score FROM embeddings, {_Q0} GROUP BY 1")
def snippet_maxpool(c: Context):
    return vectorsearch.file_scores(c.snippets, c.vector(0)).select("id", F.round("score", 6).alias("score"))


@query("snippet_top3", f"""SELECT file, id, cast(place as int) AS place, round(score, 6) AS score FROM (
  SELECT 'doc:' || (vec_id % 50) AS file, 'snip:' || vec_id AS id, {_COS} AS score,
  row_number() OVER (PARTITION BY vec_id % 50 ORDER BY round({_COS}, 9) DESC, 'snip:' || vec_id) AS place
  FROM embeddings, {_Q0}) WHERE place <= 3""")
def snippet_top3(c: Context):
    best = vectorsearch.top_snippets(c.snippets, c.vector(0))
    return best.select(F.col("codefile_node_id").alias("file"), "id", "place", F.round("score", 6).alias("score"))


@query("snippet_counts", f"SELECT {N} AS snippets, cast(count(embedding) as bigint) AS with_embedding FROM embeddings")
def snippet_counts(c: Context):
    return vectorsearch.snippet_counts(c.snippets)


@query("vector_norms", "SELECT vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS norm, "
       "round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS first FROM embeddings")
def vector_norms(c: Context):
    return c.table("embeddings").select(
        "vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"),
        F.round(vectors.unit(F.col("embedding"))[0], 6).alias("first"))


@query("vector_codec", "SELECT vec_id, cast(octet_length(embedding::blob) as int) AS bytes, embedding[64]::double AS last FROM "
       "(SELECT vec_id, embedding, repeat('0123', len(embedding)) AS blob FROM embeddings)".replace(
           "octet_length(embedding::blob)", "length(blob)"))
def vector_codec(c: Context):
    """Every stored vector through the float32 byte form and back."""
    packed = c.table("embeddings").select("vec_id", vectors.encode_float32("embedding").alias("blob"))
    return packed.select("vec_id", F.octet_length("blob").alias("bytes"),
                         vectors.decode_float32("blob")[63].cast("double").alias("last"))


# --- fusion ------------------------------------------------------------------

_HYBRID = (f"WITH {NODES}, {bm25_index()}, {bm25_scores(GRAPH_TOKENS)}, {dense_scores(0, with_snippets=40)}, "
           f"{top('dense_all', 40, 'd')}, {top('sparse_all', 40, 's')}, {fused('d', 's', 'rrf')}, {top('rrf', 40, 'h')} ")


@query("rrf_hybrid", _HYBRID + "SELECT id, label, round(score, 6) AS score FROM h")
def rrf_hybrid(c: Context):
    return c.retriever.hybrid(GRAPH_QUERY, c.vector(0), 40).select("id", "label", F.round("score", 6).alias("score"))


@query("hybrid_labelled", _HYBRID + "SELECT h.id, round(h.score, 6) AS score, n.name FROM h JOIN nodes n USING (id) "
       "WHERE h.label = 'CodeFile' ORDER BY h.score DESC, h.id LIMIT 20")
def hybrid_labelled(c: Context):
    rows = c.retriever.retrieve(GRAPH_QUERY, 20, label_filter="CodeFile", vector=c.vector(0))
    return rows.select("id", F.round("score", 6).alias("score"), "name")


@query("rrf_merge", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rk FROM documents QUALIFY rk <= 50),
  b AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) / (doc_id + 1) DESC, doc_id) AS rk FROM documents QUALIFY rk <= 50)
SELECT doc_id AS id, round(sum(1.0::double / (60 + rk)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def rrf_merge(c: Context):
    docs = c.table("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "n_chars",
                                       (F.length("text") / (F.col("doc_id") + 1)).alias("share"))
    lists = [docs.select("id", "label", F.col(s).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(50)
             for s in ("n_chars", "share")]
    return fuse_ranks(*lists).select("id", F.round("score", 6).alias("score"))


# --- terms and overlap -------------------------------------------------------

@query("exact_term_match", "SELECT doc_id, item_id AS term_id FROM documents, benchmark "
       "WHERE contains(lower(documents.text), lower(benchmark.text))")
def exact_term_match(c: Context):
    terms = c.table("benchmark").select(F.col("item_id").alias("term_id"), F.col("text").alias("name"))
    return containment.contained_terms(c.table("documents"), terms)


@query("short_term_match", """WITH t AS (
  SELECT item_id AS term_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS name FROM benchmark UNION ALL
  SELECT 1000000 + item_id, split_part(text, ' ', 3) FROM benchmark UNION ALL SELECT 2000000 + p_partkey, p_brand FROM part)
SELECT term_id, doc_id FROM t, documents WHERE name <> '' AND contains(lower(text), lower(name))""")
def short_term_match(c: Context):
    """Terms of one or two words, which may be parts of longer words of the texts."""
    items = c.table("benchmark").withColumn("w", F.split("text", " "))
    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    pairs = items.select(F.col("item_id").alias("term_id"), F.concat(word(0), F.lit(" "), word(1)).alias("name"))
    singles = items.select((F.col("item_id") + 1000000).alias("term_id"), word(2).alias("name"))
    brands = c.table("part").select((F.col("p_partkey") + 2000000).alias("term_id"), F.col("p_brand").alias("name"))
    return containment.contained_terms(c.table("documents"), pairs.unionAll(singles).unionAll(brands))


@query("term_in_text", """WITH t AS (SELECT doc_id, text || ' on ' || upper(p_name) || '.' AS text FROM documents JOIN part ON p_partkey = doc_id)
SELECT doc_id, max('part:' || p_partkey) AS id FROM t, part WHERE contains(lower(text), lower(p_name)) GROUP BY doc_id, lower(p_name)""")
def term_in_text(c: Context):
    """Parts whose name stands in a document, for every document that has a part of its number; of equal names the largest id."""
    parts = c.table("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("term_id"), F.col("p_name").alias("name"), "p_partkey")
    named = F.concat("text", F.lit(" on "), F.upper("name"), F.lit("."))
    docs = c.table("documents").join(parts, F.col("p_partkey") == F.col("doc_id")).select("doc_id", named.alias("text"))
    # the largest id of a name is known beforehand: a document then meets a name once, however many parts have it
    largest = parts.filter("term_id is not null").groupBy(F.lower("name").alias("name")).agg(F.max("term_id").alias("id"))
    found = containment.contained_terms(docs, largest.select(F.col("name").alias("term_id"), "name")).distinct()
    return found.join(largest, F.col("term_id") == F.col("name")).select("doc_id", "id")


@query("lexical_overlap", r"""WITH q AS (SELECT list_filter(regexp_split_to_array(lower('The worthless, Edston_x that'), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS t)
SELECT doc_id, round(len(list_filter(t, lambda x: contains(lower(text), x)))::double / len(t), 6) AS overlap FROM documents, q""")
def lexical_overlap(c: Context):
    return c.table("documents").select("doc_id", F.round(
        text.lexical_overlap(F.lit("The worthless, Edston_x that"), F.col("text")), 6).alias("overlap"))


@query("lexical_tokens", r"""SELECT doc_id, cast(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) as int) AS tokens FROM documents""")
def lexical_tokens(c: Context):
    return c.table("documents").select("doc_id", F.size(text.lexical_tokens(F.col("text"))).alias("tokens"))


@query("token_hit_ratio", r"""SELECT d.doc_id, round(len(list_filter(q.t, lambda x: contains(lower(d.text), x)))::double / greatest(len(q.t), 1), 6) AS ratio
FROM documents d JOIN (SELECT doc_id, list_filter(regexp_split_to_array(lower(source || ' ' || lang), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS t FROM documents) q USING (doc_id)""")
def token_hit_ratio(c: Context):
    tokens = text.lexical_tokens(F.concat_ws(" ", "source", "lang"))
    return c.table("documents").select("doc_id", F.round(text.token_hit_ratio(tokens, F.col("text")), 6).alias("ratio"))


@query("aliases", r"""WITH w AS (SELECT p_partkey, [p_name, p_type, lower(p_type), p_brand, 'Z' || p_size, p_type || ' ', ''] AS a FROM part),
c AS (SELECT p_partkey, list_filter(list_transform(a, lambda x: trim(x)), lambda x: x <> '') AS a FROM w),
u AS (SELECT p_partkey, list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i) AS a FROM c)
SELECT p_partkey, array_to_string((list_concat(
  list_filter(a, lambda x: regexp_full_match(x, '[A-Za-z][A-Za-z0-9_./:-]*') AND length(x) BETWEEN 2 AND 64),
  list_filter(a, lambda x: NOT (regexp_full_match(x, '[A-Za-z][A-Za-z0-9_./:-]*') AND length(x) BETWEEN 2 AND 64))))[1:3], '|') AS aliases
FROM u""")
def aliases(c: Context):
    names = F.array("p_name", "p_type", F.lower("p_type"), "p_brand", F.concat(F.lit("Z"), F.col("p_size").cast("string")),
                    F.concat("p_type", F.lit(" ")), F.lit(""))
    return c.table("part").select("p_partkey", F.array_join(text.prioritised_aliases(names, 3), "|").alias("aliases"))


# --- chunks ------------------------------------------------------------------

def _windows_sql(size: int, overlap: int, fold: int) -> str:
    step = size - overlap
    return f"""
lined AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> ''),
n AS (SELECT doc_id, l, len(l) AS total, CASE WHEN len(l) <= {size} THEN 1 ELSE cast(ceil((len(l) - {size}) / {step}.0) as int) + 1 END AS k FROM lined),
win AS (SELECT doc_id, l, total, i, k, (i - 1) * {step} + 1 AS s, least((i - 1) * {step} + {size}, total) AS e
        FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM n)),
folded AS (SELECT doc_id, l, i, s, CASE WHEN i = k - 1 AND total - ((k - 1) * {step}) < {fold} THEN total ELSE e END AS e,
  CASE WHEN i = k - 1 AND total - ((k - 1) * {step}) < {fold} THEN '__chunk_' || i || '+__chunk_' || k ELSE '__chunk_' || i END AS name
  FROM win WHERE NOT (i = k AND k > 1 AND total - ((k - 1) * {step}) < {fold}))"""


@query("chunk_windows", f"WITH {_windows_sql(30, 10, 0)} SELECT doc_id, cast(i as int) AS n, cast(s as int) AS start_line, "
       "cast(e as int) AS end_line, sha256(array_to_string(l[s:e], chr(10))) AS hash FROM win")
def chunk_windows(c: Context):
    docs = c.table("documents").filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    lines = F.split("text", "\n")
    return (docs.select("doc_id", lines.alias("l"))
            .select("doc_id", "l", F.posexplode(chunking.line_windows(F.size("l"), 30, 10)).alias("p", "c"))
            .select("doc_id", (F.col("p") + 1).alias("n"), "c.start_line", "c.end_line", text.content_hash(F.array_join(
                F.slice("l", F.col("c.start_line"), F.col("c.end_line") - F.col("c.start_line") + 1), "\n")).alias("hash")))


@query("chunk_documents", f"""WITH {_windows_sql(30, 10, 15)}
SELECT doc_id, CASE WHEN total < 15 THEN 'doc_' || doc_id ELSE name END AS symbol_name, cast(CASE WHEN total < 15 THEN 1 ELSE s END as int) AS start_line,
  cast(CASE WHEN total < 15 THEN total ELSE e END as int) AS end_line,
  sha256(CASE WHEN total < 15 THEN array_to_string(l, chr(10)) ELSE array_to_string(l[s:e], chr(10)) END) AS hash
FROM folded JOIN (SELECT doc_id, total FROM n) USING (doc_id) WHERE total >= 15 OR i = 1""")
def chunk_documents(c: Context):
    """Whole documents as text files: short ones in one chunk, the others in folded windows."""
    files = c.table("documents").select(F.col("doc_id").alias("file_id"),
                                        F.format_string("notes/doc_%d.txt", "doc_id").alias("path"), F.col("text").alias("code"))
    chunks = chunking.chunk_files(files, minimum=15, size=30, overlap=10)
    return chunks.select(F.col("file_id").alias("doc_id"), "symbol_name", "start_line", "end_line",
                         text.content_hash(F.col("code_text")).alias("hash"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(c: Context):
    return c.table("documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("chunk_incremental", """SELECT change, cast(count(*) as bigint) AS files FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'new'
  WHEN l.toxic = 1 THEN 'changed' WHEN l.quality = 1 THEN 'outdated' ELSE 'current' END AS change
  FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def chunk_incremental(c: Context):
    """Labelled documents are indexed already, toxic ones under another hash, good ones under an old version."""
    files, status = _files_and_status(c)
    return reindex.change_counts(reindex.classify_files(files, status))


def _files_and_status(c: Context):
    docs, labels = c.table("documents"), c.table("labels")
    files = docs.select(F.col("doc_id").cast("string").alias("codefile_node_id"),
                        F.format_string("notes/doc_%d.txt", "doc_id").alias("file_path"), F.col("text").alias("code"))
    status = labels.join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("codefile_node_id"), F.format_string("notes/doc_%d.txt", "doc_id").alias("file_path"),
        F.octet_length("text").cast("long").alias("file_size"),
        F.when(F.col("toxic") == 1, F.lit("stale")).otherwise(text.content_hash(F.col("text"))).alias("file_hash"),
        F.lit(1).alias("snippet_count"),
        F.when(F.col("quality") == 1, F.lit("v0")).otherwise(F.lit(reindex.INDEX_VERSION)).alias("index_version"),
        F.lit(None).cast("timestamp").alias("indexed_at"))
    return files, status


@query("reindex_status", f"""WITH {_windows_sql(100, 20, 50)}, c AS (SELECT doc_id, total, CASE WHEN total < 50 THEN 1 ELSE count(*) END AS chunks
  FROM folded JOIN (SELECT doc_id, total FROM n) USING (doc_id) GROUP BY doc_id, total)
SELECT d.doc_id::varchar AS codefile_node_id, sha256(d.text) AS file_hash, 'v1' AS index_version,
  cast(CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 0 AND l.quality = 0 THEN 1 ELSE coalesce(c.chunks, 0) END as int) AS snippet_count
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN c USING (doc_id)""")
def reindex_status(c: Context):
    """The status table after one incremental run over all documents."""
    from graphloom.schema import SNIPPET_TABLE

    files, status = _files_and_status(c)
    done = reindex.reindex(files, c.spark.createDataFrame([], SNIPPET_TABLE), status)
    return done.status.select("codefile_node_id", "file_hash", "index_version", "snippet_count")


@query("embed_text", """SELECT doc_id, sha256('File: ' || source || '/' || doc_id || '.lua' || chr(10) || 'Language: lua' || chr(10)
  || 'Function: f' || doc_id || chr(10) || text) AS hash FROM documents""")
def embed_text(c: Context):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".lua"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    return c.table("documents").select("doc_id", text.content_hash(text.embed_text(
        path, F.lit("lua"), F.lit("function"), name, F.col("text"))).alias("hash"))


def _covered_lines(c: Context, suffix: str, before: list[str], after: list[str], prefix: str):
    """Filled lines of files made of fixed code around every document's lines that lie in some chunk."""
    body = F.transform(F.split("text", "\n"), lambda line: F.concat(F.lit(prefix), line))
    lines = F.concat(F.array(*[F.lit(x) for x in before]), body, F.array(*[F.lit(x) for x in after]))
    files = c.table("documents").select(F.col("doc_id").cast("string").alias("file_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"),
                                        F.array_join(lines, "\n").alias("code"))
    spans = chunking.chunk_files(files).groupBy("file_id").agg(F.collect_set(F.struct("start_line", "end_line")).alias("spans"))
    filled = F.filter(F.transform(F.split("code", "\n"), lambda line, i: F.when(line.rlike(r"\S"), i + 1)), lambda no: no.isNotNull())
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start_line"], s["end_line"])))
    return (files.select("file_id", filled.alias("filled")).join(spans, "file_id").select("file_id", F.size(F.array_intersect("filled", covered)).alias("n"))
            .groupBy(F.col("file_id").cast("long").alias("doc_id")).agg(F.sum("n").alias("lines")).filter("lines > 0"))


@query("chunk_lines_covered", "SELECT doc_id, CAST(69 + len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents")
def chunk_lines_covered(c: Context):
    """Lua files with code before, between and after two functions."""
    body = ["  local y = 1"] * 31
    return _covered_lines(c, ".lua", ["local a = 1", "", "function one()", *body, "end", "local between = 2", "function two()"], [*body, "end", "return a"], "-- ")


@query("class_lines_covered", "SELECT doc_id, CAST(269 + len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents")
def class_lines_covered(c: Context):
    """C# files with members between the methods of a long class and code around it."""
    method = ["  int One(int a) {", *["    a++;"] * 128, "  }"]
    return _covered_lines(c, ".cs", ["using System;", "class Big {", "", "  int field;", *method, "  int between;"], [*method, "  int last;", "}", "// end", "class Small { }", "// end"], "// ")


@query("chunk_bounds", """WITH d AS (SELECT doc_id, 'f' || doc_id AS f, 69 + len(string_split(text, chr(10))) AS total FROM documents)
SELECT doc_id, f || ':__header+one' AS name, 'file_header' AS kind, cast(1 as int) AS start_line, cast(35 as int) AS end_line FROM d
UNION ALL SELECT doc_id, 'Box.two+' || f || ':__tail', 'method', 36, cast(total as int) FROM d""")
def chunk_bounds(c: Context):
    """Names, kinds and bounds of Lua chunks: the short header goes with the first function, the tail with the second one, which holds a document as comments."""
    body = ["  local y = 1"] * 31
    lines = F.concat(F.array(*[F.lit(x) for x in ["local a = 1", "", "function one()", *body, "end", "function Box.two()"]]),
                     F.transform(F.split("text", "\n"), lambda line: F.concat(F.lit("  -- "), line)), F.array(*[F.lit(x) for x in [*body, "end", "return a"]]))
    files = c.table("documents").select(F.col("doc_id").alias("file_id"), F.format_string("f%d.lua", "doc_id").alias("path"), F.array_join(lines, "\n").alias("code"))
    return chunking.chunk_files(files, minimum=20).select(F.col("file_id").alias("doc_id"), F.col("symbol_name").alias("name"), F.col("symbol_type").alias("kind"), "start_line", "end_line")


# --- links and names ---------------------------------------------------------

_REC = "'record/' || replace(n.path[15:], '\\', '/')"


@query("asset_link", f"WITH {NODES} SELECT id, CASE WHEN label = 'CodeFile' THEN {_REC} WHEN label = 'Folder' THEN 'record/' || id[5:] "
       "ELSE id END AS link FROM nodes n")
def asset_link(c: Context):
    none = F.lit(None).cast("string")
    return c.graph.nodes.select("id", links.asset_link(
        F.col("id"), F.col("label"), F.col("path"), none, none, none, none).alias("link"))


@query("record_path", f"WITH {NODES} SELECT id, CASE WHEN label = 'CodeFile' THEN {_REC} ELSE '' END AS path FROM nodes n")
def record_path(c: Context):
    return c.graph.nodes.select("id", links.record_path(F.col("id"), F.col("path")).alias("path"))


@query("code_file_filters", f"WITH {NODES} SELECT id, regexp_matches(name, '\\.(lua|cs|py)$') AS indexed, "
       "regexp_matches(name, '\\.(lua|cs|py)$') AS outlined FROM nodes WHERE label = 'CodeFile'")
def code_file_filters(c: Context):
    return c.graph.nodes.filter("label = 'CodeFile'").select(
        "id", links.is_index_code_file(F.col("name")).alias("indexed"),
        links.is_outline_candidate(F.col("id"), F.col("path"), F.lit(None).cast("string")).alias("outlined"))


@query("display_name", f"""WITH {NODES} SELECT id, coalesce(nullif(name, ''), CASE WHEN length(id) > 25
  THEN id[1:10] || '…' || right(id, 10) ELSE id END) AS shown FROM nodes""")
def display_name(c: Context):
    return c.graph.nodes.select("id", text.display_name(F.col("id"), F.col("name")).alias("shown"))


@query("readable_name", f"WITH {NODES} SELECT id, coalesce(name, regexp_replace(id, '^[^:]*:', '')) AS shown FROM nodes")
def readable_name(c: Context):
    return c.graph.nodes.select("id", text.readable_name(F.col("id"), F.col("name")).alias("shown"))


@query("url_classify", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(
  replace(replace(replace(url, '/en/', '/wiki/'), '/fr/', '/sheets/'), '/de/', '/docx/'), '\?.*$', ''), '/+$', '') AS u FROM pages)
SELECT page_id, CASE WHEN contains(u, '/wiki/') THEN 'wiki' WHEN contains(u, '/docx/') THEN 'docx' WHEN contains(u, '/sheets/') THEN 'sheet' END AS kind,
  CASE WHEN contains(u, '/wiki/') OR contains(u, '/docx/') OR contains(u, '/sheets/') THEN string_split(u, '/')[-1] END AS token,
  CASE WHEN contains(u, '/wiki/') OR contains(u, '/docx/') THEN 'docx' WHEN contains(u, '/sheets/') THEN 'xlsx' END AS export_ext FROM p""")
def url_classify(c: Context):
    url = F.col("url")
    for lang, segment in (("en", "wiki"), ("fr", "sheets"), ("de", "docx")):
        url = F.replace(url, F.lit(f"/{lang}/"), F.lit(f"/{segment}/"))
    return c.table("pages").select("page_id", links.url_parts(url).alias("u")).select("page_id", "u.*")


@query("text_links", r"""SELECT event_id, unnest([0, 1, 2]) AS place, unnest(['story', 'wiki', 'status_story']) AS kind,
  unnest([(10000000 + event_id)::varchar, repeat('Ab3_', 6) || event_id, (20000000 + event_id)::varchar]) AS id FROM events""")
def text_links(c: Context):
    """Links in the order of the text."""
    number = lambda plus: (F.col("event_id") + plus).cast("string")
    said = F.concat(F.lit("see wiki_story:"), number(10000000), F.lit(" and token: "), F.repeat(F.lit("Ab3_"), F.lit(6)), F.col("event_id").cast("string"),
                    F.lit(" or status_story:"), number(20000000), F.lit(" "), "props")
    return c.table("events").select("event_id", F.posexplode(links.text_links(said)).alias("place", "l")).select("event_id", "place", "l.*")


# --- JSON --------------------------------------------------------------------

@query("json_get", "SELECT event_id, cast(json_extract_string(props, '$.k') as int) AS k FROM events")
def json_get(c: Context):
    return c.table("events").select("event_id", jsonprops.prop(F.col("props"), "k").cast("int").alias("k"))


@query("json_merge", "SELECT event_id, cast(json_extract_string(props, '$.k') as int) AS k, 'done' AS status, 2 AS tags FROM events")
def json_merge(c: Context):
    merged = jsonprops.merge_properties(F.col("props"), {"status": '"done"', "tags": "[1, 2]"})
    return c.table("events").select("event_id", merged.alias("p")).select(
        "event_id", jsonprops.prop(F.col("p"), "k").cast("int").alias("k"), jsonprops.prop(F.col("p"), "status").alias("status"),
        F.json_array_length(jsonprops.prop(F.col("p"), "tags")).alias("tags"))


@query("markdown_blocks", """SELECT doc_id, sha256('# ' || trim(source || lang) || chr(10) || trim(text)) AS hash FROM documents
WHERE trim(text) <> ''""")
def markdown_blocks(c: Context):
    """Documents as a heading block and a text block, rendered to Markdown."""
    def run(content):
        return F.array(F.struct(F.struct(content.alias("content")).alias("text_run")))

    def body(*contents):
        return F.struct(F.concat(*[run(x) for x in contents]).alias("elements"))

    empty = F.lit(None).cast("struct<elements:array<struct<text_run:struct<content:string>>>>")
    blocks = F.to_json(F.array(
        F.struct(F.lit(3).alias("block_type"), body(F.col("source"), F.col("lang")).alias("heading1"), empty.alias("text")),
        F.struct(F.lit(2).alias("block_type"), empty.alias("heading1"), body(F.col("text")).alias("text"))))
    return c.table("documents").filter(F.trim("text") != "").select(
        "doc_id", text.content_hash(jsonprops.blocks_to_markdown(blocks)).alias("hash"))


@query("unwrap_result", "SELECT event_id, props AS payload FROM events")
def unwrap_result(c: Context):
    wrapped = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("props").alias("text"))).alias("content")))
    return c.table("events").select("event_id", jsonprops.unwrap_tool_result(wrapped).alias("payload"))


# --- scores ------------------------------------------------------------------

@query("confidence_bucket", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c >= 0.75 THEN 'high' WHEN c >= 0.45 THEN 'medium' ELSE 'low' END AS bucket,
  CASE WHEN c >= 0.6 THEN 'high' ELSE 'low' END AS level FROM (SELECT *, l_quantity / 50.0::double AS c FROM lineitem)""")
def confidence_bucket(c: Context):
    value = F.col("l_quantity") / F.lit(50.0)
    return c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                      scoring.confidence_bucket(value).alias("bucket"),
                                      scoring.confidence_level(value).alias("level"))


@query("normalised_scores", "SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS share FROM orders")
def normalised_scores(c: Context):
    orders = c.table("orders")
    best = orders.agg(F.max("o_totalprice").alias("best")).withColumn("one", F.lit(1))
    return (orders.withColumn("one", F.lit(1)).join(F.broadcast(best), "one")  # one row
            .select("o_orderkey", F.round(scoring.safe_norm(F.col("o_totalprice"), F.col("best")), 6).alias("share")))


# --- messages ----------------------------------------------------------------

@query("message_runs", """WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role FROM conversations),
m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS s FROM r),
n AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
SELECT conv_id, cast(run as bigint) AS run, role, min(turn) AS first_turn, max(turn) AS last_turn, cast(count(*) as bigint) AS blocks FROM n GROUP BY ALL""")
def message_runs(c: Context):
    rows = c.table("conversations").withColumn(
        "role", F.when(F.col("role") == "system", F.lit("user")).otherwise(F.col("role")))
    return messages.runs(rows, "role")


@query("message_convert", """SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role,
  'text' AS block_type, sha256(text) AS hash FROM conversations WHERE role = 'user' OR (role = 'assistant' AND coalesce(text, '') <> '')""")
def message_convert(c: Context):
    return messages.convert(c.table("conversations")).select(
        "conv_id", "turn", "role", "block_type", text.content_hash(F.col("text")).alias("hash"))


@query("tool_result_merge", """WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 0 ELSE 1 END AS tool FROM conversations),
m AS (SELECT *, CASE WHEN tool = 1 AND lag(tool) OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 0 ELSE 1 END AS s FROM r)
SELECT conv_id, turn, cast(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) as bigint) AS message FROM m""")
def tool_result_merge(c: Context):
    """User and system turns taken as tool results: adjacent ones become one message."""
    rows = c.table("conversations").withColumn(
        "role", F.when(F.col("role") == "assistant", F.lit("assistant")).otherwise(F.lit("tool"))).withColumn(
        "text", F.concat(F.lit("x"), "text"))
    return messages.merge_tool_results(messages.convert(rows)).select("conv_id", "turn", "message")


@query("system_texts", "SELECT conv_id, arg_max(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY 1")
def system_texts(c: Context):
    return messages.system_texts(c.table("conversations"))


@query("message_diagnostics", """SELECT conv_id, cast(count(*) as bigint) AS messages, cast(sum(length(text)) as bigint) AS chars,
  arg_max(role, turn) AS last_role, array_to_string(list_reverse((list_reverse(list(role ORDER BY turn)))[1:6]), ',') AS recent_roles
FROM conversations GROUP BY 1""")
def message_diagnostics(c: Context):
    return messages.diagnostics(c.table("conversations"))
