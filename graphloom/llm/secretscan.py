"""Secrets in texts: fixed patterns, and strings that compression cannot explain in a sensitive context.

The fixed patterns are exact. Beyond them, every run of key characters shortly
after a sensitive word is a candidate. Its novelty is what it adds to the
zstandard-compressed size of the text around it, where the compressor is primed
with a dictionary of identifiers: words, names and repeats of what stands near
cost next to nothing, key material costs most of its length. Sensitive words,
runs and spans are each listed once in order and merged by position, so the time
grows with the text and the runs, whatever they hold.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import tidy

# --- fixed values: patterns that results must agree on -----------------------------
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# -----------------------------------------------------------------------------------

#: Words after which a string may be a secret, how far after them it may begin, and its least length.
CONTEXT = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api key", "access key", "private key", "credential", "bearer", "signing key")
REACH, SHORTEST = 48, 8
#: Text on either side that the compressor sees, and the least added bytes of a reported string: in all, a character of one
#: that mixes digits or cases, and a character of one that might be an unknown word.
AROUND, NOVEL_BYTES, NOVEL_SHARE, WORD_SHARE = 600, 9, 0.5, 0.75
#: Identifiers and code words that prime the compressor.
IDENTIFIERS = " ".join((
    "abstract assert async await boolean break case catch class const continue def default delete do double elif else enum except export extends false final finally float for from function global if implements import in include instanceof int interface lambda let long namespace new none null object override package pass private protected public raise return self short static string struct super switch template this throw throws true try type typedef union unsigned using var virtual void while with yield",
    "access_key accessKey account address admin algorithm api_key apiKey argument array attribute auth authorization backend base64 bearer buffer bucket callback certificate channel client client_id client_secret config connection constructor container content context controller cookie count credential credentials database decode default_value description directory document email encode endpoint environment error event example exception export factory filename folder format gateway handler hash header host hostname identifier index initialize input instance integer iterator key keyboard language length library listener localhost location logger login manager message method middleware module network number option output parameter parser passphrase password passwd path payload permission placeholder plugin policy port private_key privateKey process production profile project property protocol provider public_key query queue record redirect reference register repository request resource response result role route runtime sandbox schema scope secret secret_key secretKey sequence server service session settings signature signing_key source staging status storage stream subscription system table template test_token testing thread timeout timestamp token transaction update upload url user username utf-8 validate value variable version warning webhook window workspace your_api_key your_password changeme example.com",
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 12345678 00000000 11111111 aaaaaaaa xxxxxxxx XXXXXXXX http://www. https://api. .example.com/ v1 v2",
))

_PATTERNS = {"assign": re.compile(ASSIGN), "access": re.compile(ACCESS), "hex": re.compile("[0-9a-f]{24,}")}
_HEX_RUNS = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_HEX_LONG = b"h" * LEAST["hex"]
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_CONTEXT_WORDS = tuple(w.encode() for w in CONTEXT)
_CONTEXT = re.compile("|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else re.escape(c) for c in w) for w in CONTEXT))
_RUN = re.compile(rf"[A-Za-z0-9+/_=.\-]{{{SHORTEST},}}")
_MIXED = re.compile("[0-9]|[a-z][A-Z]|[A-Z][A-Z]+[a-z]")

Span = tuple[str, int, int, float | None]


class Novelty:
    """Bytes that a string adds to its compressed surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, before: str, candidate: str, after: str) -> int:
        around = (before + after).encode()
        return len(self.compressor.compress(around + candidate.encode())) - len(self.compressor.compress(around))


def base_spans(text: str, data: bytes, low: bytes) -> list[Span]:
    """Matches of the fixed patterns; ``data`` and ``low`` are the text's UTF-8 and its lower-cased form."""
    found: list[Span] = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", *m.span(), None) for m in _PATTERNS["assign"].finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in data:
        found += [("access", *m.span(), None) for m in _PATTERNS["access"].finditer(text) if len(m[0]) >= LEAST["access"]]
    if _HEX_LONG in data.translate(_HEX_RUNS):
        found += [("hex", *m.span(), None) for m in _PATTERNS["hex"].finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters that a sensitive word precedes by at most ``REACH``, or from the last such word in them that leaves enough."""
    ends = [m.end() for m in _CONTEXT.finditer(text)]
    found = []
    for run in _RUN.finditer(text) if ends else ():
        start, end = run.span()
        inside = bisect_right(ends, end - SHORTEST)
        if inside and ends[inside - 1] > start:
            found.append((ends[inside - 1], end))
        elif (before := bisect_right(ends, start)) and start - ends[before - 1] <= REACH:
            found.append((start, end))
    return found


def novel_spans(text: str, low: bytes, taken: list[Span], novelty: Novelty) -> list[Span]:
    """Candidates whose novelty is high and that no other span touches."""
    if not any(w in low for w in _CONTEXT_WORDS):
        return []
    joined: list[tuple[int, int]] = []  # other spans, overlapping ones as one
    for _, start, end, _ in sorted(taken, key=lambda s: s[1]):
        if joined and start < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    starts, found = [s for s, _ in joined], []
    for start, end in candidates(text):
        before = bisect_left(starts, end) - 1
        if before >= 0 and joined[before][1] > start:
            continue
        string = text[start:end].strip("=.-_/")
        if len(string) < SHORTEST:
            continue
        added = novelty.added(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND])
        if added >= NOVEL_BYTES and added >= (NOVEL_SHARE if _MIXED.search(string) else WORD_SHARE) * (end - start):
            found.append(("novel", start, end, added / (end - start)))
    return found


def spans_of(text: str | None, novelty: Novelty) -> list[Span]:
    """All spans of a whole text by start, then kind; a null text has none."""
    if not text:
        return []
    data = text.encode()
    low = data.lower()
    found = base_spans(text, data, low)
    found += novel_spans(text, low, found, novelty)
    order = {kind: k for k, kind in enumerate((*KINDS, "novel"))}
    return sorted(found, key=lambda s: (s[1], order[s[0]]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text, any others).

    A span is (kind, start, end, novelty) in code points, end exclusive; novelty
    is set for kind ``novel``. Spans are in order of start, then kind. Null and
    empty texts have none; repeated rows each get a row; an empty table gives
    none. Time grows with the length of a text, whatever it holds. Other columns
    are not read, so their names do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "novelty"), s)) for s in spans_of(t, novelty)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, spans array<struct<kind:string,start:long,end:long,novelty:double>>")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``<secret:KIND>`` and n_chars, where there is one, counted again; no row is lost.

    Null and empty texts stay as they are, repeated rows are handled each, an
    empty table stays empty, very long texts are read once from end to end; all
    columns keep their name, type and place, whatever they are called.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)  # Spark passes no column with a dot in its name to a task
    text_name, count_name = (names[docs.columns.index(c)] if c in docs.columns else None for c in ("text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            before = batch.column(text_name).to_pylist()
            texts = list(before)
            for k, text in enumerate(texts):
                spans, out, at = spans_of(text, novelty), [], 0
                for kind, start, end, _ in spans:
                    if start >= at:
                        out += [text[at:start], f"<secret:{kind}>"]
                    at = max(at, end)
                if spans:
                    texts[k] = "".join(out) + text[at:]
            columns = {name: batch.column(name) for name in names}
            columns[text_name] = pa.array(texts, batch.schema.field(text_name).type)
            if count_name:
                old = columns[count_name].to_pylist()
                columns[count_name] = pa.array([o if t == s else len(t) for o, t, s in zip(old, texts, before)], batch.schema.field(count_name).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return plain.mapInArrow(tidy(run), plain.schema).toDF(*docs.columns)


def listed(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end``, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*KINDS)) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
