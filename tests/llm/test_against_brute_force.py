"""Every registered training-data query over the smallest tables, against plain Python or its SQL."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import FOLDER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall())


def result(session, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    return QUERIES[name](session, FOLDER).toPandas()


def tokens(name, text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in text]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_are_balanced_and_keep_equal_texts_together(session, texts):
    got = result(session, 1)
    assert sorted(got.doc_id) == sorted(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got.itertuples())
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    assert got.assign(t=got.doc_id.map(texts)).groupby("t").shard.nunique().max() == 1
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() < 0.02 * sums.mean()


def test_packing_holds_every_id_once(session, texts):
    got = result(session, 2)
    ids = dict(zip(texts, tokens("word_bpe_49k.json", texts.values())))
    for doc, rows in got.groupby("doc_id"):
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == crc(ids[doc][at : at + r.length]) and r.doc_tokens == len(ids[doc])
            at += r.length
        assert at == len(ids[doc])
    assert set(got.doc_id) == set(texts)
    padding = 0
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert list(rows.offset) == [0, *rows.length.cumsum()[:-1]]
        length = rows.length.sum()
        padding += 0 if length & (length - 1) == 0 else 4096 - length
    assert padding == 0


def test_quality_counts(session, texts):
    got = result(session, 3)
    for r in got.itertuples():
        text = texts[r.doc_id]
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_keeps_documents_labelled_good(session):
    got = result(session, 3)
    labels = duckdb.sql(f"SELECT doc_id, quality AS good FROM '{FOLDER}/labels.parquet'").df().merge(got, on="doc_id")
    judged = labels[~labels.base_failed]
    assert (judged.kept == (judged.good == 1)).mean() > 0.95


def test_secrets(session, texts):
    from graphloom.llm.secretscan import ACCESS, ASSIGN

    for r in result(session, 5).itertuples():
        text, found = texts[r.doc_id], []
        for k, (kind, pattern, least) in enumerate((("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", "[0-9a-f]+", 24))):
            found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[2] if k == 0 else m[0]) >= least]
        listed = [x[2] for x in sorted(found)]
        assert r.base_sha256 == sha256(",".join(listed).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == listed
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in listed) for k in ("assign", "access", "hex"))


def test_benchmark_passages_are_found(session, texts):
    plain = lambda t: f" {' '.join(re.findall(chr(92) + 'w+', t.lower()))} "
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    want = {(d, i) for d, t in texts.items() for i, x in items if plain(x) in plain(t)}
    got = {(r.doc_id, r.item_id) for r in result(session, 6).itertuples()}
    assert want <= got and len(got - want) <= 0.02 * len(texts)


def test_token_file_round_trip(session, texts):
    got, start = result(session, 7).sort_values("doc_id"), 0
    ids = dict(zip(texts, tokens("byte_bpe_50k.json", texts.values())))
    assert list(got.doc_id) == sorted(texts)
    for r in got.itertuples():
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), crc(ids[r.doc_id]))
        start += r.n_tokens


def test_toxicity_on_held_out_rows(session):
    import pandas as pd

    from graphloom.llm.toxicity import toxicity

    folder = "/root/testdata/sf0.1"
    docs, labels = session.read.parquet(f"{folder}/documents.parquet"), session.read.parquet(f"{folder}/labels.parquet")
    got = toxicity(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted").toPandas()
    assert got.score.between(0, 1).all() and len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.itertuples())
    held = pd.merge(got, labels.toPandas(), on="doc_id").query("held_out")
    toxic, plain = held[held.toxic == 1], held[held.toxic == 0]
    assert toxic.predicted.mean() > 0.85 and plain.predicted.mean() < 0.03
    assert (toxic.score.to_numpy()[:, None] > plain.score.to_numpy()[None, :]).mean() > 0.93


def brute_components(texts):
    sets = {}
    for doc, text in texts.items():
        words = text.encode().lower().split()
        sets[doc] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for k, a in enumerate(docs):
        for b in docs[:k]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(sets[d]), root(d)) for d in docs}


def test_near_duplicates(session, texts):
    want = brute_components(texts)
    got = result(session, 9)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert (got.kept == (got.doc_id == got.component_id)).all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(session, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](session, FOLDER).toPandas()
    want = db.sql(ORACLES[name]).df()[list(got.columns)]
    rows = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    as_number = {c: "float64" for c in got.columns if got[c].dtype.kind in "if"}
    assert rows(got.astype(as_number)) == rows(want.astype(as_number))


def test_pipeline(session, texts):
    import corpus_pipeline

    docs = session.read.parquet(f"{FOLDER}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(session, kept, FOLDER)
        assert out.columns == columns
        out, before = out.cache(), kept.count()
        assert out.count() <= before
        if name == "near duplicates":
            left = {r.doc_id: r.text for r in kept.collect()}
            assert {r.doc_id for r in out.collect()} == {d for d, (_, c) in brute_components(left).items() if d == c}
        if name == "secrets":
            assert out.count() == before
            assert not [r for r in out.collect() if re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text)]
        kept = out
    pieces = corpus_pipeline.run(session, FOLDER).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in kept.collect()}


def test_every_copy_that_the_checks_accept_is_found(session, texts):
    """Copies with words put in, replaced and left out, against the longest common subsequence with every stretch of a document."""
    from graphloom.llm import decontam

    draw = np.random.default_rng(7)
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet' ORDER BY 1").fetchall()
    filler = [t.split() for t in texts.values() if len(t.split()) > 60]
    other = [w for t in filler for w in t[:20]]
    drawn = lambda n: [other[k] for k in draw.integers(len(other), size=n)]
    rows = []
    for put_in, replaced, left_out in ((0, 0, 0), (0.5, 0, 0), (1, 0, 0), (1.8, 0, 0), (0, 0.25, 0), (0.6, 0.25, 0), (1.2, 0, 0.3), (0, 0.3, 0)):
        for item, text in items[::4]:
            copy = []
            for word in text.split():
                chance = draw.random()
                copy += [] if chance < left_out else drawn(1) if chance < replaced else [word]
                copy += drawn(int(put_in + draw.random()))
            around = filler[draw.integers(len(filler))][:60]
            at = int(draw.integers(len(around)))
            rows.append((len(rows), " ".join([*around[:at], *copy, *around[at:]]), item, put_in + replaced + left_out == 0))
    docs = session.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, session.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row
            row = [0]
            for k, y in enumerate(b):
                row.append(before[k] + 1 if x == y else max(row[-1], before[k + 1]))
        return row[-1]

    bare = lambda t: [x for w in t.lower().split() if (x := w.strip(decontam._EDGES))]
    want = set()
    for doc, text, item, whole in rows:
        words, planted = bare(text), bare(items[item][1])
        answer = bare([s for s in re.split(r"(?<=[.!?])\s+|\n", items[item][1]) if s.strip()][-1])
        if common(planted, words) < decontam.PARAPHRASE * len(planted):
            continue
        for at in [k for k, w in enumerate(words) if w in planted]:
            part = words[at : at + 3 * len(planted)]
            share = common(planted, part) / len(planted)
            if share >= decontam.VERBATIM or share >= decontam.PARAPHRASE and common(answer, part) >= decontam.ANSWERED * len(answer):
                want.add((doc, item))
                break
    assert len(want) > 0.6 * len(rows) and {(d, i) for d, _, i, whole in rows if whole} <= want
    assert want <= got, (len(want & got), len(want))


def test_toxicity_merges_no_counts(session, monkeypatch):
    """Scores do not depend on a number of hash buckets."""
    from graphloom.llm import toxicity

    docs, labels = (session.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scores = lambda: {r.doc_id: r.score for r in toxicity.toxicity(docs.select("doc_id", "text"), labels).collect()}
    want = scores()
    monkeypatch.setattr(toxicity, "BUCKETS", {k: 1 << 6 for k in toxicity.BUCKETS})
    got = scores()
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)
