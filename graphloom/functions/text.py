"""Tokenising, lexical overlap and the small string rules of the retrieval layer."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
INDEX_TOKEN = r"[\p{L}\p{N}]{2,}"
LEXICAL_SPLIT = r"[^\p{L}\p{N}_]+"
DEV_ALIAS = r"^[A-Za-z][A-Za-z0-9_./:-]*$"
LANGUAGE_BY_SUFFIX = {"py": "python", "cs": "csharp", "lua": "lua", "js": "javascript",
                      "ts": "typescript", "java": "java", "cpp": "cpp", "c": "c"}
# -----------------------------------------------------------------------------


def index_tokens(text: Column) -> Column:
    """Index and query tokens: runs of two or more letters or digits, case kept."""
    return F.regexp_extract_all(text, F.lit(INDEX_TOKEN), F.lit(0))


def query_tokens(text: str) -> list[str]:
    """The same tokens for a user's query string, repeats included."""
    return re.findall(r"[^\W_]{2,}", text or "")


def lexical_tokens(text: Column) -> Column:
    """Lower-cased word pieces used by the overlap scores."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), LEXICAL_SPLIT), lambda t: t != "")


def lexical_query_tokens(text: str) -> list[str]:
    return [t for t in re.split(r"\W+", (text or "").lower()) if t]


def token_hit_ratio(tokens: Column, target: Column) -> Column:
    """Share of ``tokens`` (an array) found as substrings of ``target``; 0 for no tokens."""
    low = F.lower(F.coalesce(target, F.lit("")))
    hits = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    return F.when(F.size(tokens) > 0, hits.cast("double") / F.size(tokens)).otherwise(F.lit(0.0))


def lexical_overlap(query: Column, target: Column) -> Column:
    return token_hit_ratio(lexical_tokens(query), target)


def is_dev_alias(alias: Column) -> Column:
    """Code-like alias: 2 to 64 characters, ASCII letter first, identifier characters only."""
    trimmed = F.trim(alias)
    return F.length(trimmed).between(2, 64) & trimmed.rlike(DEV_ALIAS)


def distinct_ignoring_case(values: Column) -> Column:
    """Trimmed, non-empty array items; of items equal up to case the first is kept."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    lowered = F.transform(clean, lambda v: F.lower(v))
    return F.filter(clean, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)


def prioritised_aliases(values: Column, limit: int = 3) -> Column:
    """Distinct aliases, code-like ones first, at most ``limit``."""
    clean = distinct_ignoring_case(F.coalesce(values, F.array().cast("array<string>")))
    dev = F.filter(clean, lambda v: is_dev_alias(v))
    other = F.filter(clean, lambda v: ~is_dev_alias(v))
    return F.slice(F.concat(dev, other), 1, max(1, limit))


def language_of(path: Column) -> Column:
    """Language by file suffix, null when the suffix is not known."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_SUFFIX.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def embed_text(path: Column, language: Column, symbol_type: Column, symbol_name: Column,
               code: Column, limit: int | None = None) -> Column:
    """The text handed to the embedding model for one code chunk; ``limit`` cuts the code to so many characters."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), path),
        F.concat(F.lit("Language: "), language),
        F.concat(F.initcap(symbol_type), F.lit(": "), symbol_name),
        code if limit is None else F.substring(code, 1, limit))


def question_id(question: Column, created_at: Column, ordinal: Column) -> Column:
    """Readable question key: cleaned first 30 characters, epoch seconds, ordinal."""
    head = F.regexp_replace(F.substring(question, 1, 30), r"[^\p{L}\p{N}_]", "_")
    return F.concat(F.lit("question:"), head, F.lit("_"),
                    F.unix_timestamp(created_at).cast("string"), F.lit("_"), ordinal.cast("string"))


def display_name(node_id: Column, name: Column) -> Column:
    """Name for a graph view; without one, the last two path parts or head and tail of the id."""
    parts = F.split(node_id, r"[/\\\\]")
    tail = F.array_join(F.slice(parts, -2, 2), "/")
    short = F.concat(F.substring(node_id, 1, 10), F.lit("…"), F.right(node_id, F.lit(10)))
    return (F.when(F.coalesce(name, F.lit("")) != "", name)
            .when(F.size(parts) > 1, tail)
            .when(F.length(node_id) > 25, short)
            .otherwise(node_id))


def readable_name(node_id: Column, known_name: Column) -> Column:
    """A known node name, else the id without its prefix."""
    return F.coalesce(known_name,
                      F.when(F.contains(node_id, F.lit(":")),
                             F.regexp_replace(node_id, r"^[^:]*:", "")).otherwise(node_id))
