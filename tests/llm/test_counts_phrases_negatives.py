"""Token counts, phrases and hard negatives: odd rows, small chunks and tries, and plain Python on the smallest tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import hardnegatives, phrases, tokencount
from graphloom.llm.queries import QUERIES
from graphloom.llm.common import read_table
from tests.llm.conftest import FOLDER

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def counted(library, texts):
    return Counter((k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for k, t in texts)


def rows_of(df):
    return Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in df.collect())


def test_token_counts_equal_the_library(session, library):
    docs = read_table(session, FOLDER, "documents")
    got = QUERIES["op12_resynchronised_token_counts"](session, FOLDER)
    assert rows_of(got) == counted(library, [(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.collect())


def test_token_counts_of_odd_rows(odd, empty, library):
    want = counted(library, [(r.doc_id, r.text) for r in odd.collect()])
    assert rows_of(tokencount.token_counts(odd, BYTES)) == want
    assert rows_of(tokencount.token_counts(odd, BYTES, chunk=700, overlap=120, cell=16)) == want
    assert tokencount.token_counts(empty, BYTES).count() == 0


def test_spliced_counts_whatever_stands_at_the_seams(session, library):
    """Endless words, white space, marks, special strings and other scripts across every seam; open seams are widened."""
    source = random.Random(3)
    bits = ["word", " ", "  ", "\n\n", "'ll", "'", "don't ", "<|endoftext|>", "<|endof", "12", "4,5.", " ", "漢字かな", "é", "x" * 300, " " * 300, "\t", "!?", "　", "Σİ", "\x1c", "🙂"]
    texts = [(k, "".join(source.choice(bits) for _ in range(900))) for k in range(20)]
    texts += [(20, "y" * 20_000), (21, " " * 9_000), (22, "漢" * 5_000), (23, "<|endoftext|>" * 600), (24, "a b " * 400 + "z" * 3_000 + " c d" * 400)]
    docs = session.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = counted(library, texts)
    for chunk, overlap, cell in ((500, 100, 16), (3_000, 300, 128)):
        assert rows_of(tokencount.token_counts(docs, BYTES, chunk=chunk, overlap=overlap, cell=cell)) == want


def test_marks_part_every_text_for_certain(library):
    source = random.Random(5)
    signs = "ab Z09'\n\t.,<|é漢 "
    for _ in range(300):
        text = "".join(source.choice(signs) for _ in range(60))
        whole = len(library.encode(text, add_special_tokens=False))
        for match in tokencount.STABLE.finditer(text):
            at = match.end()
            assert whole == sum(len(library.encode(t, add_special_tokens=False)) for t in (text[:at], text[at:]))


def test_a_vocabulary_without_proof_is_refused():
    with pytest.raises(ValueError):
        tokencount._library(public_tokenizers.path("word_bpe_49k.json"))


def frequencies(rows, longest):
    found, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                found[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return found, sizes


def mined(rows, least, longest=5, top=2000):
    found, sizes = frequencies(rows, longest)
    out = []
    for lang, f in found.items():
        common = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in common.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        lines = []
        for p, a in common.items():
            if inside[p] < a:
                score, k = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                lines.append((" ".join(p), a, f[p[:k]], f[p[k:]], sizes[lang], score))
        lines.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, rank, *line) for rank, line in enumerate(lines[:top], 1)]
    return sorted(out)


def listed(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("shard, bits", [(200_000, 1 << 20), (400, 64)])
def test_phrases_equal_plain_counts(session, shard, bits):
    """Also with tries of few phrases, and with a bitmap so full that it sorts nothing out."""
    docs = read_table(session, FOLDER, "documents")
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = listed(phrases.collocations(docs, least=25, shard=shard, bits=bits))
    assert len(got) > 50 and got == mined(rows, 25)


def test_phrases_of_odd_rows(odd, empty, session):
    langs = odd.withColumn("lang", F.when(F.col("doc_id") < 9, "xx"))
    rows = [(r.text, r.lang) for r in langs.collect()]
    assert listed(phrases.collocations(langs, least=3, top=50)) == mined(rows, 3, top=50)
    assert phrases.collocations(langs.where("doc_id = -1"), least=3).count() == 0
    assert phrases.collocations(langs, least=10**6).count() == 0
    shared = session.createDataFrame([("A b, a B; a\tb", None), ("a b", "und"), ("KELVIN K", "en")], "text string, lang string")
    assert listed(phrases.collocations(shared, least=2)) == [("und", 1, "a b", 4, 4, 4, 8, 2000)]


def test_double_array_accepts_its_phrases_only():
    source = random.Random(7)
    listed_phrases = sorted({tuple(source.randint(1, 30) for _ in range(source.randint(2, 5))) for _ in range(400)})
    base, check, states = phrases.double_array([list(p) for p in listed_phrases])
    assert len(set(states.tolist())) == len(listed_phrases)
    text = [source.randint(0, 30) for _ in range(5_000)] + [c for p in listed_phrases for c in (*p, 0)]
    counts = phrases.count_states(np.array(text), base, check, 5)
    for phrase, state in zip(listed_phrases, states):
        assert counts[state] == sum(tuple(text[i : i + len(phrase)]) == phrase for i in range(len(text)))


def negatives(rows, every=50, most=5, least=3):
    rows = [(k, i, [int(np.floor(256 * float(x))) for x in v], l) for k, (i, v, l) in enumerate(rows)
            if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = float("inf")
    out = []
    for k, i, v, l in rows:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), last if j is None else j, n, m) for n, j, w, m in rows if n != k)
        for s, j, n, m in [x for x in scored if x[3] == l][:most]:
            close = [x for x in scored if x[3] != l and 50 * -s <= 100 * -x[0] <= 95 * -s][:least]
            out += [(i, None if j == last else j, rank, None if x[1] == last else x[1], -s, -x[0]) for rank, x in enumerate(close, 1)]
    return Counter(out)


def mined_rows(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_hard_negatives_with_odd_rows_and_ties(session):
    source = random.Random(11)
    rows = [(k, [source.choice((-1.0, 0.0, 0.25, 0.5)) for _ in range(4)], source.randint(0, 2)) for k in range(300)]
    rows += [(None, [0.5] * 4, 1), (50, [0.5] * 4, 1), (50, [0.5] * 4, 1), (400, None, 1), (450, [0.5] * 4, None), (500, [0.5, None, 0.1, 0.1], 1),
             (550, [float("nan"), 0.1, 0.1, 0.1], 1), (600, [float("inf"), 0.1, 0.1, 0.1], 0), (650, [], 2), (700, [0.5, 0.5], 2)]
    df = session.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("anchor", "score", "kind", "group", "rows", "place", "key")]).repartition(5)
    want = negatives(rows)
    assert len(want) > 20 and mined_rows(hardnegatives.hard_negatives(df)) == want
    assert mined_rows(hardnegatives.hard_negatives(df, group=2, piece=64)) == want
    assert hardnegatives.hard_negatives(df.where("vec_id = -1")).count() == 0


def test_large_scores_stay_exact(session):
    rows = [(50 * k, [3e5 + k, 2e5 - 7 * k, 1.0 * k], k % 2) for k in range(20)] + [(1, [2**20 + 1.0, 1.0, 1.0], 0), (2, [3e6, 5.0, 7e4], 1)]
    df = session.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined_rows(hardnegatives.hard_negatives(df)) == negatives(rows)
    huge = session.createDataFrame([(0, [1e30], 0), (1, [1e30], 0), (2, [1e29], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="int|overflow|large"):
        hardnegatives.hard_negatives(huge).collect()
