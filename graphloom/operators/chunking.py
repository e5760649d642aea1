"""Code files to indexable chunks: structural where the language allows, else line windows.

Files are rows; their lines become rows only for the structural languages, and
every window or join stays inside one file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.codelines import LUA_CLOSERS, LUA_OPENERS, line_rows, with_block_ends, with_depth
from graphloom.session import materialize

# --- fixed values ------------------------------------------------------------
MIN_LINES = 50
MAX_CLASS_LINES = 200
WINDOW_LINES = 100
OVERLAP_LINES = 20
LANG_BY_SUFFIX = {"lua": "lua", "cs": "csharp"}
LUA_FUNCTION = r"^(?:local\s+)?function\s+([\w.]+(?::\w+)?)"
CS_CLASS = r"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|new|readonly|unsafe|ref)\s+)*(?:class|struct|interface)\s+([A-Za-z_]\w*)"
CS_METHOD = r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|new|extern|unsafe|partial)\s+)*[A-Za-z_][\w<>,.?\[\]\s]*\s+([A-Za-z_]\w*)\s*(?:<[^>]*>)?\s*\("
CS_STATEMENT = r"^\s*(?:return|new|else|throw|await|yield|using|if|for|foreach|while|switch|lock)\b"
# -----------------------------------------------------------------------------

CHUNK = "array<struct<symbol_type:string,symbol_name:string,start_line:int,end_line:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it, also inside functions of array elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_language(files: DataFrame) -> DataFrame:
    """``lang`` for the structurally chunked suffixes, null for all others."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANG_BY_SUFFIX.items() for x in pair])
    return files.withColumn("lang", F.try_element_at(table, suffix))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")


def line_windows(total: Column, size: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> Column:
    """Windows over ``total`` lines; the last one is the first to reach the end."""
    step = size - overlap
    count = F.when(total <= size, F.lit(1)).otherwise(F.ceil((total - size) / F.lit(step)) + 1).cast("int")
    return F.transform(F.sequence(F.lit(1), count), lambda n: F.struct(
        F.lit("file_chunk").alias("symbol_type"),
        F.concat(F.lit("__chunk_"), n.cast("string")).alias("symbol_name"),
        ((n - 1) * step + 1).cast("int").alias("start_line"),
        F.least((n - 1) * step + size, total).cast("int").alias("end_line")))


def _lines_of(chunk: Column) -> Column:
    return chunk["end_line"] - chunk["start_line"] + 1


def fold_small(chunks: Column, minimum: int = MIN_LINES) -> Column:
    """Join neighbours left to right while the running chunk is short; a short rest joins its predecessor.

    One pass settles which chunks begin a new run; runs are then cut out, so no
    array is copied for each chunk.
    """
    return _let(chunks, lambda whole: _folded(whole, minimum))


def _folded(chunks: Column, minimum: int) -> Column:
    state = "struct<starts:array<int>,first:int,last:int>"
    at = F.transform(chunks, lambda c, i: F.struct(c.alias("c"), i.alias("i")))

    def step(s: Column, x: Column) -> Column:
        # a run of lines first..last goes on while it is short
        grow = (s["first"] > 0) & (s["last"] - s["first"] + 1 < minimum)
        return F.when(grow, F.struct(s["starts"].alias("starts"), s["first"].alias("first"), x["c"]["end_line"].alias("last"))).otherwise(
            F.struct(F.concat(s["starts"], F.array(x["i"])).alias("starts"), x["c"]["start_line"].alias("first"), x["c"]["end_line"].alias("last")))

    empty = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("first"), F.lit(0).alias("last")).cast(state)

    def kept(done: Column) -> Column:
        short = (F.size(done["starts"]) > 1) & (done["last"] - done["first"] + 1 < minimum)
        return F.when(short, F.slice(done["starts"], 1, F.size(done["starts"]) - 1)).otherwise(done["starts"])

    def run(pair: Column) -> Column:
        members = F.slice(chunks, pair["a"] + 1, pair["b"] - pair["a"])
        return F.struct(F.get(members, F.lit(0))["symbol_type"].alias("symbol_type"),
                        F.array_join(F.transform(members, lambda m: m["symbol_name"]), "+").alias("symbol_name"),
                        F.get(members, F.lit(0))["start_line"].alias("start_line"), F.element_at(members, -1)["end_line"].alias("end_line"))

    def runs(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(chunks)))
        return F.transform(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), run)

    return _let(_let(F.aggregate(at, empty, step), kept), runs)


def with_gaps(chunks: Column, lines: Column, base: Column) -> Column:
    """Ordered, disjoint chunks with one more for every stretch of lines between them that is not blank."""
    return _let(F.struct(chunks.alias("chunks"), lines.alias("lines")), lambda x: _gapless(x["chunks"], x["lines"], base))


def _gapless(chunks: Column, lines: Column, base: Column) -> Column:
    count = F.size(chunks)
    places = F.transform(F.sequence(F.lit(0), count), lambda i: F.struct(
        i.alias("i"), F.when(i == 0, F.lit(1)).otherwise(F.get(chunks, i - 1)["end_line"] + 1).alias("a"),
        F.when(i == count, F.size(lines)).otherwise(F.get(chunks, i)["start_line"] - 1).alias("b")))
    filled = F.filter(places, lambda p: (p["b"] >= p["a"]) & F.exists(
        F.slice(lines, p["a"], F.greatest(p["b"] - p["a"] + 1, F.lit(0))), lambda line: line.rlike(r"\S")))
    name = lambda p: F.when(p["i"] == 0, F.lit(":__header")).when(p["i"] == count, F.lit(":__tail")).otherwise(F.concat(F.lit(":__between_"), p["i"].cast("string")))
    gaps = F.transform(filled, lambda p: F.struct(
        F.lit("file_header").alias("symbol_type"), F.concat(base, name(p)).alias("symbol_name"),
        p["a"].cast("int").alias("start_line"), p["b"].cast("int").alias("end_line")))
    keyed = F.transform(F.concat(chunks, gaps.cast(CHUNK)), lambda c: F.struct(c["start_line"].alias("o"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def chunk_files(files: DataFrame, minimum: int = MIN_LINES, size: int = WINDOW_LINES,
                overlap: int = OVERLAP_LINES) -> DataFrame:
    """``files (file_id, path, code)`` to ``(file_id, path, ordinal, symbol_type, symbol_name, start_line,
    end_line, line_count, code_text)``. Blank files give nothing, short ones a single chunk."""
    filled = with_language(files.filter(F.trim(F.regexp_replace("code", r"\s+", " ")) != ""))
    sized = filled.withColumn("total", F.size(F.split("code", "\n")))
    # only structural files meet their structure; the texts of all others stay where they are
    is_structural = (F.col("total") >= minimum) & F.col("lang").isNotNull()
    structural = sized.filter(is_structural)
    found = structural.join(_structure(structural), "file_id", "left").withColumn(
        "chunks", with_gaps(F.col("chunks"), F.split("code", "\n"), stem(F.col("path"))))
    plain = sized.filter(~F.coalesce(is_structural, F.lit(False))).withColumn("chunks", F.lit(None).cast(CHUNK))
    planned = found.unionByName(plain).withColumn(
        "plan", F.when(F.col("total") < minimum, F.array(F.struct(
            F.lit("file_chunk").alias("symbol_type"), stem(F.col("path")).alias("symbol_name"),
            F.lit(1).alias("start_line"), F.col("total").alias("end_line"))))
        .otherwise(fold_small(F.coalesce("chunks", line_windows(F.col("total"), size, overlap)), minimum)))
    # texts are cut inside the row, so the file itself is not repeated per chunk, and is split once for all its chunks
    cut = lambda lines: F.transform("plan", lambda c: F.struct(
        c["symbol_type"].alias("symbol_type"), c["symbol_name"].alias("symbol_name"),
        c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), _lines_of(c).alias("line_count"),
        F.array_join(F.slice(lines, c["start_line"], _lines_of(c)), "\n").alias("code_text")))
    return (planned.select("file_id", "path", F.posexplode(_let(F.split("code", "\n"), cut)).alias("ordinal", "c"))
            .select("file_id", "path", "ordinal", "c.*"))


def _structure(files: DataFrame) -> DataFrame:
    """``(file_id, chunks)``: functions of Lua files, classes and methods of C# files, in line order.

    A Lua file without functions and a C# file without classes is one whole chunk.
    """
    telling = materialize(_telling(line_rows(files)), "lines")  # few lines, read by several joins; texts are cut into lines once
    lines = with_block_ends(with_depth(telling))
    parts = _lua_parts(lines).unionByName(_class_parts(lines))
    whole = files.select("file_id", F.lit("file_chunk").alias("symbol_type"), stem(F.col("path")).alias("symbol_name"),
                         F.lit(1).alias("start_line"), F.col("total").alias("end_line")).join(
        parts.select("file_id").distinct(), "file_id", "left_anti")
    fields = ["symbol_type", "symbol_name", "start_line", "end_line"]
    packed = F.array_sort(F.collect_list(F.struct(
        F.col("start_line").alias("o"), F.struct(*fields).alias("c"))))
    return (parts.unionByName(whole).groupBy("file_id").agg(packed.alias("k"))
            .select("file_id", F.transform("k", lambda v: v["c"]).cast(CHUNK).alias("chunks")))


def _telling(lines: DataFrame) -> DataFrame:
    """The lines that open or close a block or may name a part, with these names instead of their text; no other line tells of structure."""
    name = lambda lang, pattern: F.when(F.col("lang") == lang, F.regexp_extract("line", pattern, 1)).otherwise(F.lit(""))
    method = F.when(F.col("line").rlike(CS_STATEMENT), F.lit("")).otherwise(name("csharp", CS_METHOD))
    named = lines.select("file_id", "lang", "no", "bare", name("lua", LUA_FUNCTION).alias("function_name"),
                         name("csharp", CS_CLASS).alias("class_found"), method.alias("method_name"))
    marks = F.when(F.col("lang") == "lua", F.col("bare").rlike(f"{LUA_OPENERS}|{LUA_CLOSERS}")).otherwise(F.col("bare").rlike(r"[{}]"))
    return named.filter(marks | (F.concat("function_name", "class_found", "method_name") != ""))


def _lua_parts(lines: DataFrame) -> DataFrame:
    """The top-level functions."""
    name = F.col("function_name")
    functions = lines.filter((F.col("lang") == "lua") & (F.col("before") == 0) & (name != "") & F.col("end_line").isNotNull())
    kind = F.when(name.rlike("[.:]"), F.lit("method")).otherwise(F.lit("function"))
    return functions.select("file_id", kind.alias("symbol_type"), name.alias("symbol_name"), F.col("no").alias("start_line"), "end_line")


def _class_parts(lines: DataFrame) -> DataFrame:
    """Outermost classes whole, or the methods of a class that is long.

    The class a line lies in is the last outermost one that began before it, so
    one running value in line order tells it.
    """
    cs = lines.filter(F.col("lang") == "csharp")
    name = F.when(F.col("end_line").isNotNull(), F.nullif("class_found", F.lit("")))
    named = cs.withColumn("class_name", name)
    before = Window.partitionBy("file_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.when(F.col("class_name").isNotNull(), F.col("end_line"))).over(before), F.lit(0))
    outer = named.withColumn("outermost", F.col("class_name").isNotNull() & (F.col("no") > covered))
    head = F.when(F.col("outermost"), F.struct(
        "class_name", F.col("no").alias("from"), F.col("end_line").alias("to"), (F.col("before") + 1).alias("level")))
    within = outer.withColumn("own", F.last(head, ignorenulls=True).over(before))
    long = F.col("end_line") - F.col("no") + 1 > MAX_CLASS_LINES
    whole = outer.filter("outermost").filter(~long).select(
        "file_id", F.lit("class").alias("symbol_type"), F.col("class_name").alias("symbol_name"), F.col("no").alias("start_line"), "end_line")
    method = F.col("method_name")
    members = within.filter((method != "") & F.col("end_line").isNotNull() & ~F.col("outermost")
                            & (F.col("own.to") - F.col("own.from") + 1 > MAX_CLASS_LINES)
                            & (F.col("no") <= F.col("own.to")) & (F.col("before") == F.col("own.level")))
    # methods of one class stand one after the other; what an earlier one covers is no method of its own
    open_end = F.coalesce(F.max("end_line").over(Window.partitionBy("file_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    methods = members.withColumn("open_end", open_end).filter(F.col("no") > F.col("open_end")).select(
        "file_id", F.lit("method").alias("symbol_type"), F.concat("own.class_name", F.lit("."), method).alias("symbol_name"),
        F.col("no").alias("start_line"), "end_line")
    return whole.unionByName(methods)
