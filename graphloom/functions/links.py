"""Asset links, record paths and document-URL rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import CODE_LABEL, FOLDER_LABEL, PREFAB_LABEL

# --- fixed values ------------------------------------------------------------
RECORD_ROOT = "record"
DRIVE_PREFIX = r"(?i)^C:/Git/record/"
INDEX_CODE_FILES = r"(?i)\.(cs|lua|py|cpp|h|c|js|ts)$"
OUTLINE_CODE_FILES = r"(?i)\.(py|cs|lua)$"
CODE_FILE_KINDS = ["script", "code", "source", "lua", "python", "csharp", "cs"]
URL_KINDS = [("wiki", "wiki"), ("docx", "docx"), ("sheets", "sheet"), ("base", "bitable"),
             ("docs", "doc")]
SPREADSHEET_KINDS = ["sheet", "bitable"]
WIKI_TOKEN = r"\btoken:\s*([A-Za-z0-9_-]{20,})\b"
WIKI_STORY = r"\bwiki_story:(\d{8,12})\b"
STATUS_STORY = r"\bstatus_story:(\d{8,12})\b"
# -----------------------------------------------------------------------------


def _filled(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value)


def _under_root(path: Column, root: str) -> Column:
    return F.replace(F.concat(F.lit(f"{root}/"), path), F.lit("//"), F.lit("/"))


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), DRIVE_PREFIX, "")


def record_path(node_id: Column, path: Column, root: str = RECORD_ROOT) -> Column:
    """Repository path of a code node from its path, else from a ``file:`` id, else empty."""
    return (F.when(_filled(path).isNotNull(), _under_root(_plain_path(path), root))
            .when(F.startswith(node_id, F.lit("file:")),
                  _under_root(F.regexp_replace(node_id, "^file:", ""), root))
            .otherwise(F.lit("")))


def asset_link(node_id: Column, label: Column, path: Column, wiki_url: Column, wiki_link: Column,
               story_url: Column, sheet_url: Column, root: str = RECORD_ROOT) -> Column:
    """Where a node's asset lives: its own URL, its repository path, or its id."""
    url = F.coalesce(*[_filled(c) for c in (wiki_url, wiki_link, story_url, sheet_url)])
    located = record_path(node_id, path, root)
    in_tree = label.isin(CODE_LABEL, FOLDER_LABEL)
    return (F.when(url.isNotNull(), url)
            .when(in_tree & (located != ""), located)
            .when(in_tree & F.startswith(node_id, F.lit("dir:")),
                  _under_root(F.regexp_replace(node_id, "^dir:", ""), root))
            .when((label == PREFAB_LABEL) & _filled(path).isNotNull(),
                  _under_root(F.replace(path, F.lit("\\"), F.lit("/")), root))
            .otherwise(node_id))


def is_index_code_file(name: Column) -> Column:
    return name.rlike(INDEX_CODE_FILES)


def is_outline_candidate(node_id: Column, target_path: Column, file_type: Column) -> Column:
    """Code file the outline can read: by suffix of path or id, or by its declared kind."""
    return (target_path.rlike(OUTLINE_CODE_FILES) | node_id.rlike(OUTLINE_CODE_FILES)
            | F.lower(F.coalesce(file_type, F.lit(""))).isin(CODE_FILE_KINDS))


def url_parts(url: Column) -> Column:
    """``struct(kind, token, export_ext)`` of a document URL; kind is null when unsupported."""
    clean = F.regexp_replace(F.regexp_replace(url, r"\?.*$", ""), r"/+$", "")
    kind, token = F.lit(None).cast("string"), F.lit(None).cast("string")
    for segment, name in reversed(URL_KINDS):
        found = F.contains(clean, F.lit(f"/{segment}/"))
        last = F.regexp_extract(clean, rf".*/{segment}/(?:.*/)?([^/]*)$", 1)
        kind = F.when(found, F.lit(name)).otherwise(kind)
        token = F.when(found, last).otherwise(token)
    bare = kind.isNull() & (F.length(url) > 20) & ~F.contains(url, F.lit("/"))
    kind = F.when(bare, F.lit("docx")).otherwise(kind)
    token = F.when(bare, url).otherwise(token)
    ext = (F.when(kind.isin(SPREADSHEET_KINDS), F.lit("xlsx"))
           .when(kind.isNotNull(), F.lit("docx")))
    return F.struct(kind.alias("kind"), token.alias("token"), ext.alias("export_ext"))


def text_links(text: Column) -> Column:
    """``array<struct<kind,id>>`` of wiki tokens and story ids named in a text, in its order and without overlaps."""
    patterns = {"wiki": WIKI_TOKEN, "story": WIKI_STORY, "status_story": STATUS_STORY}
    any_of = "|".join(re.sub(r"\((?!\?)", "(?:", p) for p in patterns.values())

    def read(said: Column) -> Column:
        kind = ident = F.lit(None).cast("string")
        for name, pattern in patterns.items():
            hit = F.startswith(said, F.lit(re.match(r"\\b(\w+:)", pattern)[1]))
            kind, ident = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, F.regexp_extract(said, pattern, 1)).otherwise(ident)
        return F.struct(kind.alias("kind"), ident.alias("id"))

    return F.transform(F.regexp_extract_all(text, F.lit(any_of), F.lit(0)), read)
