"""Symbols and outlines of source files that are spelled out from the documents table, one file a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.catalog.registry import Context, query
from graphloom.operators import outline

#: Methods of the outer class, by document.
_METHODS = "cast(n_chars % 5 as int)"

_CSHARP = ("namespace Shop {", "    class Outer@ {", ("        public static int M#(int a, List<string> b = null)", "        { return #; } // class Fake {"),
           "        class Inner : Base {", "            private string In(int a) {", "                if (a > 0) {", "                    return \"}\";", "                }",
           "                return \"x\";", "            }", "        }", "        protected void After(string s) {", "        }", "        public int Size { get; set; }", "    }",
           "    class Late { int Alone() { return 1; } }", "}")
_PYTHON = ("class Outer@(Base):", ("    def m#(self, a: int = #) -> str:", "        return a"), "    class Inner:", "        def inside(self):", "            return 1",
           "", "    # class Fake:", "    def after(self):", "        def helper(x):", "            return x", "        return helper(2)", "def free(x, *rest):", "    return x")
_LUA = ("Mod@ = {}", ("function Mod@:m#(a, b)", "  if a then return b end", "end"), "function Mod@.plain()", "end", "local function alone(x)", "  return x", "end")


def _repeated(lines: tuple[str, ...]) -> Column:
    """A group of lines for each method, # its number."""
    text = F.lit("\n".join(lines))
    many = F.transform(F.sequence(F.lit(0), F.expr(_METHODS)), lambda i: F.when(i < F.expr(_METHODS), F.replace(text, F.lit("#"), i.cast("string"))))
    return F.filter(many, lambda x: x.isNotNull())


def _spelled(lines: tuple) -> Column:
    """The lines as one text, @ the document's id."""
    parts = [F.array(F.lit(line)) if isinstance(line, str) else _repeated(line) for line in lines]
    return F.replace(F.array_join(F.concat(*parts), "\n"), F.lit("@"), F.col("doc_id").cast("string"))


def code_files(c: Context) -> DataFrame:
    """(file_id, path, code): C# for English documents, Python for French ones, Lua for the others."""
    lang = F.col("lang")
    chosen = lambda *x: F.when(lang == "en", x[0]).when(lang == "fr", x[1]).otherwise(x[2])
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), chosen(F.lit(".cs"), F.lit(".py"), F.lit(".lua")))
    return c.table("documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), chosen(_spelled(_CSHARP), _spelled(_PYTHON), _spelled(_LUA)).alias("code"))


_D = "d AS (SELECT doc_id, source || '/' || doc_id AS p, CASE lang WHEN 'en' THEN 'cs' WHEN 'fr' THEN 'py' ELSE 'lua' END AS kind, cast(n_chars % 5 as int) AS k FROM documents), m AS (SELECT *, unnest(range(k)) AS i FROM d)"


def _row(frame: str, kind: str, line: str, what: str, name: str, owner: str, params: str = "''", returns: str = "''", where: str = "true") -> str:
    return (f"SELECT p || '.{kind}' AS path, cast({line} as int) AS line_number, '{what}' AS kind, {name} AS name, {owner} AS parent_symbol, "
            f"{params} AS params, {returns} AS return_type FROM {frame} WHERE kind = '{kind}' AND {where}")


_OUTER, _MOD = "'Outer' || doc_id", "'Mod' || doc_id"
_ROWS = " UNION ALL ".join([
    _row("d", "cs", "2", "class", _OUTER, _OUTER), _row("m", "cs", "3 + 2 * i", "method", "'M' || i", _OUTER, "'int a, List<string> b = null'", "'int'"),
    _row("d", "cs", "3 + 2 * k", "class", "'Inner'", "'Inner'"), _row("d", "cs", "4 + 2 * k", "method", "'In'", "'Inner'", "'int a'", "'string'"),
    _row("d", "cs", "11 + 2 * k", "method", "'After'", _OUTER, "'string s'", "'void'"), _row("d", "cs", "13 + 2 * k", "method", "'Size'", _OUTER, "''", "'int'"),
    _row("d", "cs", "15 + 2 * k", "class", "'Late'", "'Late'"),
    _row("d", "py", "1", "class", _OUTER, _OUTER), _row("m", "py", "2 + 2 * i", "method", "'m' || i", _OUTER, "'self, a: int = ' || i", "'str'"),
    _row("d", "py", "2 + 2 * k", "class", "'Inner'", "'Inner'"), _row("d", "py", "3 + 2 * k", "method", "'inside'", "'Inner'", "'self'"),
    _row("d", "py", "7 + 2 * k", "method", "'after'", _OUTER, "'self'"), _row("d", "py", "8 + 2 * k", "method", "'helper'", _OUTER, "'x'"),
    _row("d", "py", "11 + 2 * k", "function", "'free'", "''", "'x, *rest'"),
    _row("d", "lua", "1", "class", _MOD, _MOD), _row("m", "lua", "2 + 3 * i", "method", f"{_MOD} || ':m' || i", _MOD, "'a, b'"),
    _row("d", "lua", "2 + 3 * k", "method", f"{_MOD} || '.plain'", _MOD), _row("d", "lua", "4 + 3 * k", "function", "'alone'", "''", "'x'")])


@query("code_symbols", f"WITH {_D} {_ROWS}")
def code_symbols(c: Context):
    """Every symbol of every file with the innermost class it lies in: after a nested class the outer one goes on."""
    return outline.symbols(code_files(c)).select("path", "line_number", "kind", "name", "parent_symbol", "params", "return_type")


@query("outline_totals", f"""WITH {_D}, r AS ({_ROWS}) SELECT cast(count(*) FILTER (kind = 'class') as bigint) AS total_classes,
  cast(count(*) FILTER (kind = 'function') as bigint) AS total_functions, cast(count(*) FILTER (kind = 'method') as bigint) AS total_methods FROM r""")
def outline_totals(c: Context):
    return outline.totals(outline.symbols(code_files(c)))


@query("symbol_parameters", f"""WITH {_D} SELECT p || '.cs' AS path, 'M' || i AS symbol, n.name, n.type, n.value FROM m,
  (VALUES ('a', 'int', ''), ('b', 'List<string>', 'null')) n(name, type, value) WHERE kind = 'cs'
UNION ALL SELECT p || '.py', 'm' || i, n.name, n.type, CASE WHEN n.name = 'a' THEN i::varchar ELSE '' END FROM m, (VALUES ('self', ''), ('a', 'int')) n(name, type) WHERE kind = 'py'
UNION ALL SELECT p || '.lua', 'Mod' || doc_id || ':m' || i, n.name, '', '' FROM m, (VALUES ('a'), ('b')) n(name) WHERE kind = 'lua'""")
def symbol_parameters(c: Context):
    """Names, types and defaults of the parameters of every repeated method."""
    rows = outline.symbols(code_files(c)).filter(F.col("name").rlike("(^|:)[Mm][0-9]+$"))
    return rows.select("path", F.col("name").alias("symbol"), F.explode("parameters").alias("v")).select("path", "symbol", "v.name", "v.type", F.col("v.default").alias("value"))


@query("code_outline", f"""WITH {_D}, r AS ({_ROWS}),
l AS (SELECT path, cls.line_number AS block, 0 AS part, 0 AS line, '  class ' || cls.name AS text FROM r cls WHERE kind = 'class' UNION ALL
  SELECT m.path, c.line_number, 1, m.line_number, '    + ' || CASE WHEN m.path LIKE '%.cs' THEN m.return_type || ' ' || m.name || CASE WHEN m.name = 'Size' THEN ' {{ get; set; }}' ELSE '(' || m.params || ')' END
      ELSE m.name || '(' || m.params || ')' || CASE WHEN m.return_type <> '' THEN ' -> ' || m.return_type ELSE '' END END
  FROM r m JOIN r c ON c.path = m.path AND c.kind = 'class' AND c.name = m.parent_symbol WHERE m.kind = 'method' UNION ALL
  SELECT path, 1000000, 2, line_number, '  fn ' || name || '(' || params || ')' FROM r WHERE kind = 'function')
SELECT path, path || ':' || chr(10) || string_agg(text, chr(10) ORDER BY block, part, line) AS outline FROM l WHERE path NOT LIKE '%.cs' GROUP BY path""")
def code_outline(c: Context):
    """The outline text of every Python and Lua file."""
    return outline.outlines(outline.symbols(code_files(c).filter(~F.endswith("path", F.lit(".cs")))))
