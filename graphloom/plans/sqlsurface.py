"""Read-only SQL over the graph and snippet tables.

A statement is run as the inside of ``SELECT * FROM ( ... )``: anything that is
not a query fails to parse there, whatever its first word, and the row limit
holds even when the text has a LIMIT of its own. A recursive CTE with UNION runs
as a fixpoint of written rounds, so that it ends on cyclic data; Spark's own
recursion knows UNION ALL only. Every relation it names has to
be a view of the chosen database or one of its own CTEs; files and other tables
of the catalog are refused. A few spellings of the dialect that users of the
surface write are turned into Spark's, outside of string literals. ``NOT IN`` of
a subquery runs as an existence join under the same rules for missing values:
Spark's own plan for it holds the whole subquery in the driver.
"""

from __future__ import annotations

import re
import time
from contextlib import suppress
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.closure import closure

# --- fixed values ------------------------------------------------------------
ROW_LIMIT = 500
DATABASES = {"main": ["nodes", "edges"], "snippets": ["snippets", "file_index_status"]}
COMPATIBILITY = {
    "json_extract": "(doc STRING, path STRING) RETURNS STRING RETURN get_json_object(doc, path)",
    "strftime": "(form STRING, at TIMESTAMP) RETURNS STRING RETURN date_format(at, replace(replace(replace(replace(replace(replace(form, '%Y', 'yyyy'), '%m', 'MM'), '%d', 'dd'), '%H', 'HH'), '%M', 'mm'), '%S', 'ss'))",
    "datetime": "(at TIMESTAMP) RETURNS STRING RETURN date_format(at, 'yyyy-MM-dd HH:mm:ss')",
    "julianday": "(day TIMESTAMP) RETURNS DOUBLE RETURN unix_micros(day) / 86400000000.0D + 2440587.5D",
}
# name or qualified name, and a literal (kept as L0, L1, ... while spellings are changed)
_NAME, _LITERAL = r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?", r"\x00\d+\x00"
SPELLINGS = [
    (rf"(?i)\bgroup_concat\(\s*({_NAME})\s*\)", r"listagg(CAST(\1 AS STRING), ',')"),
    (rf"(?i)\bgroup_concat\(\s*({_NAME})\s*,\s*({_LITERAL})\s*\)", r"listagg(CAST(\1 AS STRING), \2)"),
    (rf"(?i)\btotal\(\s*({_NAME})\s*\)", r"coalesce(sum(CAST(\1 AS DOUBLE)), 0.0D)"),
    (rf"({_NAME})\s*->>?\s*({_LITERAL})", r"get_json_object(\1, \2)"),
]
#: A lateral ``json_each`` over the members of an object or the items of an array: names, values as text, and their types.
JSON_TYPES = {"STRING": "text", "BIGINT": "integer", "DOUBLE": "real", "VOID": "null"}
# -----------------------------------------------------------------------------
_ALIAS = r"(?:\s+(?:AS\s+)?(?!(?:WHERE|GROUP|ORDER|JOIN|LEFT|INNER|ON|LIMIT|UNION|HAVING|CROSS)\b)([A-Za-z_]\w*))?"
JSON_EACH = rf"(?i)(,|\bJOIN)\s*json_each\(\s*({_NAME})\s*(?:,\s*({_LITERAL})\s*)?\){_ALIAS}"


def _json_each(match: re.Match) -> str:
    joined, document, path, alias = match.groups()
    whole = f"try_parse_json({document})"
    inside = f"try_variant_get({whole}, {path}, 'variant')" if path else whole
    kind = "schema_of_variant(value)"
    types = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in JSON_TYPES.items())
    kinds = (f"CASE WHEN {kind} LIKE 'OBJECT%' THEN 'object' WHEN {kind} LIKE 'ARRAY%' THEN 'array' WHEN {kind} LIKE 'DECIMAL%' THEN 'real' "
             f"WHEN {kind} = 'BOOLEAN' THEN CAST(value AS STRING) ELSE CASE {kind} {types} END END")
    text = f"CASE WHEN {kind} LIKE 'OBJECT%' OR {kind} LIKE 'ARRAY%' THEN to_json(value) ELSE CAST(value AS STRING) END"
    return (f"{joined} LATERAL (SELECT coalesce(key, CAST(pos AS STRING)) AS key, {text} AS value, {kinds} AS type "
            f"FROM variant_explode({inside})) AS {alias or 'json_each'}")

# -----------------------------------------------------------------------------


class Refused(ValueError):
    """The text is not a single read-only statement this surface runs."""


@dataclass(frozen=True)
class SqlAnswer:
    columns: list[str]
    rows: list[dict[str, Any]]
    row_count: int
    elapsed_ms: int
    db: str


class SqlSurface:
    """Temporary views for both databases and the functions their dialect expects."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, snippets: DataFrame | None = None,
                 file_index_status: DataFrame | None = None):
        self.spark = spark
        self.views = {"nodes": nodes, "edges": edges, "snippets": snippets, "file_index_status": file_index_status}
        spark.conf.set("spark.sql.runSQLOnFiles", "false")  # no statement names a file
        for name, signature in COMPATIBILITY.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature}")

    def query(self, sql: str, db: str = "main") -> DataFrame:
        """The answer as a DataFrame of at most 500 rows."""
        if db not in DATABASES:
            raise Refused(f"unknown database {db!r}")
        for name in DATABASES[db]:
            if self.views[name] is not None:
                self.views[name].createOrReplaceTempView(name)
        text = sql.strip().rstrip(";").strip()
        pragma = re.fullmatch(r"(?is)pragma\s+table_info\s*\(\s*['\"]?(\w+)['\"]?\s*\)", text)
        if pragma:
            return self._table_info(pragma.group(1), db)
        explain = re.match(r"(?is)explain(?:\s+query\s+plan)?\s+", text)
        if explain:
            return self._run("EXPLAIN ", text[explain.end():], db)
        return self._run("", text, db).limit(ROW_LIMIT)

    def _run(self, prefix: str, text: str, db: str, also: tuple[str, ...] = ()) -> DataFrame:
        parts = _recursive_union(text)
        if parts and not prefix:
            return self._fixpoint(*parts, db)
        text = spark_spelling(text)
        try:
            text, plan = self._planned(text)
            self._check_relations(plan, db, also)
            return self.spark.sql(f"{prefix}SELECT * FROM (\n{text}\n)")
        except PySparkException as error:
            lines = [x for x in str(error).splitlines() if x.strip()]
            raise Refused(lines[0] if lines else "the statement could not be read") from error

    def _planned(self, text: str) -> tuple[str, str]:
        """The text to run and its plan: with existence joins, or as it is where a subquery's own references do not allow them."""
        explain = lambda some: self.spark.sql(f"EXPLAIN EXTENDED SELECT * FROM (\n{some}\n)").first()[0]
        joined = existence_joins(text)
        if joined != text:
            with suppress(PySparkException):
                plan = explain(joined)
                if "== Analyzed Logical Plan ==" in plan:
                    return joined, plan
        return text, explain(text)

    def _fixpoint(self, name: str, columns: list[str], seed: str, step: str, rest: str, db: str) -> DataFrame:
        """``WITH RECURSIVE name(columns) AS (seed UNION step) rest``."""
        if name in self.views or self.spark.catalog.tableExists(name):
            raise Refused(f"{name!r} names a table")

        def again(found: DataFrame) -> DataFrame:
            found.createOrReplaceTempView(name)
            return self._run("", step, db, (name,))

        first = self._run("", seed, db)
        try:
            closure(first.toDF(*columns) if columns else first, again).createOrReplaceTempView(name)
            return self._run("", rest, db, (name,))
        finally:
            self.spark.catalog.dropTempView(name)

    def _check_relations(self, plan: str, db: str, also: tuple[str, ...] = ()) -> None:
        """Refuse a plan whose parsed form names anything but the database's views, its own CTEs and ``also``."""
        parsed = plan.partition("== Analyzed Logical Plan ==")[0]
        for names in re.findall(r"UnresolvedRelation \[([^\]]*)\]", parsed):
            parts = [p.strip() for p in names.split(",")]
            if len(parts) == 1 and (parts[0] in DATABASES[db] or parts[0] in also):
                continue
            if len(parts) > 1 or self.spark.catalog.tableExists(parts[0]):
                raise Refused(f"no table {'.'.join(parts)!r} in {db}")
        if "== Analyzed Logical Plan ==" not in plan:
            raise Refused("the statement could not be read")

    def _table_info(self, table: str, db: str) -> DataFrame:
        view = self.views.get(table) if table in DATABASES[db] else None
        if view is None:
            raise Refused(f"no table {table!r} in {db}")
        fields = list(enumerate(view.schema))
        counts = view.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in fields])  # one pass
        described = [F.struct(F.lit(i).alias("cid"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
                              F.lit(not f.nullable).alias("notnull"), (F.col("rows") - F.col(f"c{i}")).alias("nulls")) for i, f in fields]
        return counts.select(F.explode(F.array(*described)).alias("d")).select("d.*")

    def answer(self, sql: str, db: str = "main") -> SqlAnswer:
        started = time.time()
        df = self.query(sql, db)
        rows = [r.asDict(recursive=True) for r in df.limit(ROW_LIMIT).collect()]
        return SqlAnswer(df.columns, rows, len(rows), int((time.time() - started) * 1000), db)


def _recursive_union(text: str) -> tuple[str, list[str], str, str, str] | None:
    """Name, columns, seed, step and what follows of a statement that is one recursive CTE with UNION and a query on it; else None."""
    head = re.match(r"(?is)\s*WITH\s+RECURSIVE\s+([A-Za-z_]\w*)\s*(?:\(([^()]*)\))?\s*AS\s*\(", text)
    if not head:
        return None
    depth, split, at = 1, None, head.end()
    for token in re.finditer(r"'(?:[^']|'')*'|[()]|\bUNION\b(?!\s+ALL\b)", text[head.end():], re.IGNORECASE):
        depth += {"(": 1, ")": -1}.get(token[0], 0)
        if depth == 1 and token[0].upper() == "UNION" and split is None:
            split = (at + token.start(), at + token.end())
        if not depth:
            rest = text[at + token.end():]
            if split is None or rest.lstrip().startswith(","):
                return None
            columns = [c.strip() for c in head[2].split(",")] if head[2] else []
            return head[1], columns, text[at:split[0]], text[split[1]:at + token.start()], rest
    return None


def spark_spelling(text: str) -> str:
    """The statement with other dialects' spellings of a few functions and operators replaced, literals untouched."""
    literals: list[str] = []

    def keep(match: re.Match) -> str:
        literals.append(match[0])
        return f"\x00{len(literals) - 1}\x00"

    def glob(match: re.Match) -> str:
        pattern = literals[int(match[1])][1:-1]
        body = "".join({"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c, c if c in "[]" else re.escape(c)) for c in pattern)
        return " RLIKE r'^" + body + "$'"

    out = re.sub(r"'(?:[^']|'')*'", keep, text)
    for pattern, replacement in SPELLINGS:
        out = re.sub(pattern, replacement, out)
    out = re.sub(JSON_EACH, _json_each, out)
    out = re.sub(r"(?i)\s+GLOB\s+\x00(\d+)\x00", glob, out)
    return re.sub(r"\x00(\d+)\x00", lambda m: literals[int(m[1])], out)


def existence_joins(text: str) -> str:
    """``name NOT IN (SELECT ...)`` as a test for a match; null where SQL says so, true for an empty subquery."""
    masked = re.sub(r"'(?:[^']|'')*'", lambda m: "\x01" * len(m[0]), text)
    head = re.search(rf"(?i)({_NAME})\s+NOT\s+IN\s*\(\s*(?=(?:SELECT|WITH)\b)", masked)
    if not head:
        return text
    depth, end = 1, head.end()
    while end < len(masked) and depth:
        depth += {"(": 1, ")": -1}.get(masked[end], 0)
        end += 1
    if depth:
        return text
    name, rows = head[1], f"({existence_joins(text[head.end():end - 1])}) AS not_in_rows(not_in_value)"
    test = (f"CASE WHEN (SELECT count(*) FROM {rows}) = 0 THEN TRUE WHEN EXISTS (SELECT 1 FROM {rows} WHERE not_in_value = {name}) THEN FALSE "
            f"WHEN {name} IS NULL OR (SELECT count(*) FROM {rows}) > (SELECT count(not_in_value) FROM {rows}) THEN NULL ELSE TRUE END")
    return f"{text[:head.start()]}({test}){existence_joins(text[end:])}"


def readable(nodes: DataFrame) -> DataFrame:
    """The stored node columns plus the name, as the SQL surface shows them."""
    return nodes.select("id", "label", F.col("name"), "properties")
