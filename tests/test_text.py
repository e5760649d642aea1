"""Retrieval, chunking and outlines against hand-worked or re-derived values."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.functions import jsonprops, links, text, vectors
from graphloom.functions.islands import number_runs
from graphloom.graph import PropertyGraph
from graphloom.operators import chunking, containment, outline, reindex
from graphloom.operators.textindex import TextIndex, exact_terms
from graphloom.plans import code_search, default_search, index_only
from graphloom.plans.retrieve import Retriever
from graphloom.plans.toolkit import Toolkit, normalise_mode

CORPUS = ["red fox and red hen", "the fox", "the hen the hen the", "", "the end of the fox and the hen", "a b c"]


def _bm25(corpus, query, k1=1.5, b=0.75):
    docs = [re.findall(r"[^\W_]{2,}", d) for d in corpus]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - f + .5) - math.log(f + .5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: .25 * mean if v < 0 else v for t, v in idf.items()}
    out = {}
    for i, d in enumerate(docs):
        tf = Counter(d)
        s = sum(idf[q] * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(d) / avg))
                for q in re.findall(r"[^\W_]{2,}", query) if q in tf)
        if round(s, 9) > 0:
            out[str(i)] = s
    return out


def test_bm25_with_repeats_and_negative_idf(spark):
    docs = spark.createDataFrame([(str(i), "Doc", t) for i, t in enumerate(CORPUS)], "id string, label string, text string")
    index = TextIndex.build(docs)
    for query in ("red fox", "the the hen", "The fox", "missing"):
        got = {r["id"]: r["score"] for r in index.scores(query).collect()}
        want = _bm25(CORPUS, query)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-8 for k in got)
    assert index.scores("a ! b") is None


def test_containment_against_brute_force(spark):
    rng = random.Random(2)
    words = ["al", "ala", "b-c", "kala", "x", "x1", "ö", "the", "!", "a.b", "lab"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    terms = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))).upper() for _ in range(60)} | {"A", " ", "- ", "LA"})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = spark.createDataFrame(list(enumerate(terms)), "term_id long, name string")
    got = {(r["doc_id"], r["term_id"]) for r in containment.contained_terms(docs, names).collect()}
    assert got == {(d, t) for d, x in enumerate(texts) for t, n in enumerate(terms) if n.lower() in x.lower()}


def test_exact_terms_keep_largest_id_of_equal_names(spark):
    nodes = spark.createDataFrame([("bt:1", "Fox", "", "BusinessTerm"), ("bt:2", "fox", "", "BusinessTerm"), ("bt:3", "owl", "", "BusinessTerm")],
                                  "id string, name string, description string, label string")
    assert [r["id"] for r in exact_terms(nodes, "A FOXtrot").collect()] == ["bt:2"]


def test_aliases_and_links(spark):
    df = spark.createDataFrame([(["登录", "LoginMgr", " loginmgr ", "", "x", "9lives", "Ui.Panel"],)], "a array<string>")
    assert df.select(text.prioritised_aliases(F.col("a"), 5).alias("v")).first()["v"] == ["LoginMgr", "Ui.Panel", "登录", "x", "9lives"]
    row = spark.createDataFrame([("file:a//b.lua", "c:/git/record/src\\x.lua", "https://h/wiki/AbC/Tok?x=1", "T" * 25)],
                                "id string, path string, url string, bare string")
    none = F.lit(None).cast("string")
    got = row.select(links.record_path(F.col("id"), none).alias("a"), links.record_path(F.col("id"), F.col("path")).alias("b"),
                     links.url_parts(F.col("url")).alias("u"), links.url_parts(F.col("bare")).alias("v")).first()
    assert (got["a"], got["b"]) == ("record/a/b.lua", "record/src/x.lua")
    assert tuple(got["u"]) == ("wiki", "Tok", "docx") and tuple(got["v"]) == ("docx", "T" * 25, "docx")


def test_json_merge_keeps_nested_values(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"x":[1,2.5]}}',), (None,)], "p string")
    got = [r["v"] for r in df.select(jsonprops.merge_properties(F.col("p"), {"a": '"n"', "t": "[1]"}).alias("v")).collect()]
    assert got == ['{"b":{"x":[1,2.5]},"a":"n","t":[1]}', '{"a":"n","t":[1]}']


def test_runs_across_slices(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice("ab")) for g in range(3) for i in range(40)]
    df = number_runs(spark.createDataFrame(rows, "g int, i long, k string"), "g", "i", F.col("k"), width=4)
    got = {(r["g"], r["i"]): r["run"] for r in df.collect()}
    for g in range(3):
        run, last = 0, None
        for i in range(40):
            key = rows[g * 40 + i][2]
            run, last = run + (key != last), key
            assert got[(g, i)] == run


def _chunks(spark, path, code, **kw):
    files = spark.createDataFrame([("f", path, code)], "file_id string, path string, code string")
    rows = chunking.chunk_files(files, **kw).orderBy("ordinal").collect()
    return [(r["symbol_type"], r["symbol_name"], r["start_line"], r["end_line"]) for r in rows]


def test_window_chunks_and_fold(spark):
    lines = lambda n: "\n".join(f"line {i}" for i in range(n))
    assert _chunks(spark, "a/b.txt", "  \n ") == []
    assert _chunks(spark, "a/b.txt", lines(49)) == [("file_chunk", "b", 1, 49)]
    assert _chunks(spark, "a/b.txt", lines(100)) == [("file_chunk", "__chunk_1", 1, 100)]
    assert _chunks(spark, "a/b.txt", lines(120)) == [("file_chunk", "__chunk_1+__chunk_2", 1, 120)]
    assert _chunks(spark, "a/b.txt", lines(181)) == [("file_chunk", "__chunk_1", 1, 100), ("file_chunk", "__chunk_2+__chunk_3", 81, 181)]
    assert _chunks(spark, "a/b.txt", lines(230)) == [
        ("file_chunk", "__chunk_1", 1, 100), ("file_chunk", "__chunk_2", 81, 180), ("file_chunk", "__chunk_3", 161, 230)]


def test_lua_functions_become_chunks(spark):
    body = "\n".join(f"  local x{i} = 'end' -- if" for i in range(60))
    code = f"local M = {{}}\n\nfunction M.one(a)\n{body}\nend\n\nlocal function two()\n  if a then\n{body}\n  end\nend\nreturn M"
    assert _chunks(spark, "x/mod.lua", code) == [
        ("file_header", "mod:__header+M.one", 1, 64),
        ("function", "two+mod:__tail", 66, 130)]


def test_csharp_classes_and_methods(spark):
    method = lambda n, size: f"    public int M{n}(int a)\n    {{\n" + "\n".join("      x++;" for _ in range(size)) + "\n    }\n"
    big = "namespace N\n{\n  public class Big : Base\n  {\n    int field;\n" + "".join(method(i, 70) for i in range(3)) + "  }\n"
    small = "  class Small\n  {\n" + method(9, 60) + "  }\n}\n"
    assert _chunks(spark, "Big.cs", big + small) == [
        ("file_header", "Big:__header+Big.M0", 1, 78), ("method", "Big.M1", 79, 151), ("method", "Big.M2", 152, 224),
        ("file_header", "Big:__between_3+Small+Big:__tail", 225, 293)]


def test_text_and_comments_open_no_blocks(spark):
    filler = "\n".join(f"  x = {i}" for i in range(60))
    code = f"function a()\n  local s = [[ if do\n function ]] .. 'end'\n--[==[ end\nend ]==]\n{filler}\nend\nlocal between = 1\nfunction b()\n{filler}\nend"
    assert _chunks(spark, "m.lua", code) == [("function", "a", 1, 66), ("file_header", "m:__between_1+b", 67, 129)]
    body = "\n".join("    x++;" for _ in range(60))
    cs = f"class A {{\n  string s = @\"{{ \"\" {{\n{{\";\n /* }} \n }} */ char c = '{{';\n{body}\n}}\nclass B {{ // {{\n{body}\n}}"
    assert _chunks(spark, "m.cs", cs) == [("class", "A", 1, 66), ("class", "B", 67, 128)]


def test_every_filled_line_is_in_a_chunk(spark):
    import random

    rng = random.Random(4)
    for path in ("f.lua", "f.cs", "f.txt"):
        for _ in range(4):
            lines = [rng.choice(["function m.f()", "end", "local x = 1", "", "class A {", "}", "  int M(int a) {", "if a then", "repeat", "until x"]) for _ in range(rng.randint(1, 300))]
            covered = {n for _, _, a, b in _chunks(spark, path, "\n".join(lines)) for n in range(a, b + 1)}
            assert {n for n, line in enumerate(lines, 1) if line.strip()} <= covered


def test_outlines(spark):
    files = spark.createDataFrame([
        ("p", "p.py", "class A(Base):\n    def one(self, x: Dict[str, int] = {}, *args):\n        pass\n\n    class In:\n        def two(self) -> int:\n            pass\n    def three(self): pass\ndef free(a, b=1):\n    pass\n"),
        ("c", "c.cs", "namespace N {\n public class Foo : Bar {\n  public int Size { get; set; }\n  static List<Map<int, int>> Go(int a, Map<int, int> m) {\n  }\n }\n}\n"),
        ("l", "l.lua", "Foo = {\nfunction Foo:go(a, b)\nlocal function free()\n")], "file_id string, path string, code string")
    rows = outline.symbols(files)
    got = {(r["path"], r["kind"], r["name"], r["parent_symbol"], r["line_number"]) for r in rows.collect()}
    assert got == {
        ("p.py", "class", "A", "A", 1), ("p.py", "method", "one", "A", 2), ("p.py", "class", "In", "In", 5), ("p.py", "method", "two", "In", 6),
        ("p.py", "method", "three", "A", 8), ("p.py", "function", "free", "", 9),
        ("c.cs", "class", "Foo", "Foo", 2), ("c.cs", "method", "Size", "Foo", 3), ("c.cs", "method", "Go", "Foo", 4),
        ("l.lua", "class", "Foo", "Foo", 1), ("l.lua", "method", "Foo:go", "Foo", 2), ("l.lua", "function", "free", "", 3)}
    one = rows.filter("name = 'one'").first()
    assert [tuple(p) for p in one["parameters"]] == [("self", "", ""), ("x", "Dict[str, int]", "{}"), ("*args", "", "")]
    go = rows.filter("name = 'Go'").first()
    assert [tuple(p) for p in go["parameters"]] == [("a", "int", ""), ("m", "Map<int, int>", "")]
    shown = {r["path"]: r["outline"] for r in outline.outlines(rows).collect()}
    assert shown["l.lua"] == "l.lua:\n  class Foo\n    + Foo:go(a, b)\n  fn free()"
    assert shown["p.py"].startswith("p.py:\n  class A\n    + one(")
    assert tuple(outline.totals(rows).first()) == (4, 2, 6)
    best = outline.outlines(rows.filter("path = 'p.py'"), "three", "score_only", max_symbols=1).first()["outline"]
    assert "three(self)" in best and "one(" not in best


def test_reindex_only_touches_changed_files(spark):
    from graphloom.schema import FILE_STATUS_TABLE, SNIPPET_TABLE

    files = spark.createDataFrame([("f1", "a.lua", "x = 1"), ("f2", "b.cs", "class A {}")], "codefile_node_id string, file_path string, code string")
    first = reindex.reindex(files, spark.createDataFrame([], SNIPPET_TABLE), spark.createDataFrame([], FILE_STATUS_TABLE), vectors.HashingEmbedder(8))
    assert first.snippets.count() == 2 and first.snippets.filter("size(embedding) = 8").count() == 2
    status = spark.createDataFrame(first.status.collect(), FILE_STATUS_TABLE)
    edited = files.withColumn("code", F.when(F.col("codefile_node_id") == "f1", F.lit("x = 2")).otherwise(F.col("code")))
    second = reindex.reindex(edited, first.snippets, status)
    assert [(r["codefile_node_id"], r["change"]) for r in second.work.collect()] == [("f1", "changed")]
    assert second.snippets.count() == 2 and second.status.count() == 2
    assert second.snippets.filter("codefile_node_id = 'f2'").first()["lang"] == "csharp"


@pytest.fixture(scope="module")
def retriever(spark):
    rows = [("bt:1", "BusinessTerm", "Guild War", "fight of guilds", None, ["GuildBattle"], [1.0, 0.0]),
            ("bt:2", "BusinessTerm", "Login", "enter the game", None, [], [0.0, 1.0]),
            ("file:src/guild_war.lua", "CodeFile", "guild_war.lua", "guild war manager", "C:/Git/record/src/guild_war.lua", None, [0.9, 0.1]),
            ("file:src/login.cs", "CodeFile", "login.cs", "login manager", None, None, [0.1, 0.9]),
            ("file:cfg/war.json", "CodeFile", "war.json", "guild war table", None, None, [0.8, 0.0]),
            ("entity:1", "InBusinessEntity", "Guild", "guild entity", None, None, [0.7, 0.7]),
            ("q:1", "Question", "Guild War?", "why", None, None, None)]
    nodes = spark.createDataFrame(rows, "id string, label string, name string, description string, path string, aliases array<string>, embedding array<float>")
    nodes = nodes.withColumn("infra_layer", F.lit(None).cast("string")).withColumn("properties", F.lit("{}")) \
        .withColumn("discovered_aliases", F.array().cast("array<string>")).withColumn("summary", F.lit(None).cast("string"))
    edges = spark.createDataFrame([("bt:1", "entity:1", "HAS_ENTITY", "{}"), ("bt:1", "file:src/guild_war.lua", "IMPLEMENTED_IN", "{}"),
                                   ("entity:1", "file:cfg/war.json", "ENTITY_REFS_FILE", "{}"), ("bt:2", "file:src/login.cs", "IMPLEMENTED_IN", "{}"),
                                   ("bt:1", "q:1", "RAISES_QUESTION", "{}")], "source string, target string, relationship string, properties string")
    return Retriever.build(PropertyGraph(nodes, edges))


def test_retrieve_modes_and_late_label_filter(retriever):
    names = lambda df: [r["id"] for r in df.collect()]
    assert names(retriever.retrieve("guild", 2, "dense", vector=[1.0, 0.0])) == ["bt:1", "file:cfg/war.json"]
    assert names(retriever.retrieve("GuildBattle", 3, "bm25")) == ["bt:1"]
    late = names(retriever.retrieve("guild", 1, "dense", label_filter="InBusinessEntity", vector=[1.0, 0.0]))
    early = names(retriever.retrieve("guild", 1, "dense", label_filter="InBusinessEntity", vector=[1.0, 0.0], prefilter=True))
    assert (late, early) == ([], ["entity:1"])
    assert names(retriever.retrieve("guild", 5, label_filter="BusinessTerm", vector=[1.0, 0.0])) == ["bt:1"]


def test_composed_searches(retriever):
    answer = default_search.search(retriever, "guild war", 5, vector=[1.0, 0.0])
    rows = answer.results.orderBy("rank").collect()
    assert rows[0]["id"] == "bt:1" and all(r["label"] not in ("InBusinessEntity", "Question") for r in rows)
    assert answer.snapshots.nodes.filter("label = 'Question'").isEmpty()
    assert not answer.cards.isEmpty()
    code = code_search.search(retriever, "guild war", vector=[1.0, 0.0])
    files = code.files.orderBy("rank").collect()
    assert files[0]["path"] == "record/src/guild_war.lua" and all(not f["path"].endswith(".json") for f in files)
    pointers = index_only.index_only(retriever, "guild war", 5, node_types=["CodeFile"], vector=[1.0, 0.0])
    assert [r["asset_link"] for r in pointers.orderBy("rank").collect()][0] == "record/src/guild_war.lua"
    assert index_only.format_lines(pointers).first()["line"].startswith("- [rank=1 | score_norm=1.000")


def test_toolkit_texts(retriever):
    tools = Toolkit(retriever)
    assert "Guild" in tools.query_default("guild war", 3, 2, vector=[1.0, 0.0])
    looked = tools.term_lookup("1").collect()
    assert [r["name"] for r in looked if r["kind"] == "term"] == ["Guild War"]
    assert ("HAS_ENTITY", "Guild") in {(r["relationship"], r["name"]) for r in looked if r["kind"] == "related"}
    assert {r["kind"] for r in tools.term_lookup("logi").collect()} == {"similar"} and tools.term_lookup("zzz").isEmpty()
    assert tools.neighbors_view("entity:1")[0].count() == 3 and "**Nodes:** 7" in tools.stats_text()
    custom = tools.lab_custom("", ["bt:1", "q:1", "nope"])
    assert custom.centers == ["bt:1"] and custom.nodes.filter("label = 'Question'").isEmpty()
    found = tools.query_custom("guild war", top_k=3, vector=[1.0, 0.0])
    assert found.centers and found.nodes.count() >= 3
    assert [normalise_mode(m) for m in (None, "dense", "index_only", "BM25", "odd")] == ["default", "default", "code_semantic", "custom", "default"]
