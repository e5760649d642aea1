"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names; and the parts that need no Spark."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import chatformat, common, decontam, licenses, neardup, packing, quality, secretscan, sharding, tokenfile, tokens, toxicity
from graphloom.session import work_path
from tests.llm.conftest import FOLDER

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


# --- Spark operators on awkward rows ---------------------------------------------


def test_sharding_odd_rows(odd, empty):
    got = sharding.shard(odd, 4, block_groups=3).toPandas()
    assert len(got) == odd.count() and set(got.shard) <= set(range(4))
    assert (got[got.doc_id.isin([3])]["size"] == 1).all() and (got[got.doc_id == 3].text_crc32 == 0).all()
    assert all(sorted(r.slot) == list(range(len(r))) for _, r in got.groupby("shard"))
    assert sharding.shard(empty).count() == 0


def test_sharding_cuts_a_group_larger_than_a_shard(session):
    df = session.range(4_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2_000, "copy " * 20).otherwise(F.concat(F.lit("t" * 99), "id")).alias("text"))
    sums = sharding.shard(df, 8, block_groups=100).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    assert len(sums) == 8 and sums.max() < 1.01 * sums.mean()


def test_packing_odd_rows(odd, empty):
    got = packing.pack(odd, WORDS, window=64).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 64).all()
    assert (got[got.doc_id.isin([3, 4, 5])].doc_tokens == 1).all()
    assert len(got[(got.doc_id == 7) & (got.start == 0)]) == 2
    assert packing.pack(empty, WORDS).count() == 0


def test_token_file_odd_rows(session, odd, empty):
    path = work_path(session, "odd-tokens")
    tokenfile.write_tokens(odd, path, BYTES, part_ids=20_000)
    got = tokenfile.read_tokens(session, path).toPandas().sort_values("start")
    assert len(got) == odd.count() and list(got.start) == [0, *got.n_tokens.cumsum()[:-1]]
    assert got.doc_id.iloc[:2].isna().all() and list(got.doc_id.iloc[2:]) == sorted(got.doc_id.iloc[2:])
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    for r in got.iloc[2:].itertuples():
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
    path = work_path(session, "no-tokens")
    tokenfile.write_tokens(empty, path, BYTES)
    assert tokenfile.read_tokens(session, path).count() == 0


def test_quality_odd_rows(odd, empty):
    got = quality.quality(odd).toPandas()
    assert len(got) == odd.count()
    assert (got[got.doc_id.isin([3, 4, 5])].n_words == 0).all() and not got[got.n_words < 50].kept.any()
    assert bool(got[got.doc_id == 11].kept.iloc[0]) and not bool(got[got.doc_id == 9].kept.iloc[0])
    assert quality.quality(empty).count() == 0


def test_secrets_odd_rows(session, odd, empty):
    got = secretscan.secret_spans(odd).toPandas()
    assert len(got) == odd.count() and all(len(s) == 0 for s in got.spans[got.doc_id.isin([3, 4, 5, 7])])
    assert secretscan.secret_spans(empty).count() == 0
    df = session.createDataFrame([(1, "the password=abcdef12 here", 26, "x"), (2, None, None, "y")], "doc_id long, text string, n_chars long, spans string")
    redacted = {r.doc_id: r for r in secretscan.redact(df).collect()}
    assert redacted[1].text == "the <secret:assign> here" and redacted[1].n_chars == len(redacted[1].text) and redacted[2].text is None
    assert redacted[2].spans == "y"


def test_decontamination_odd_rows(session, odd, empty):
    items = session.createDataFrame([(1, None), (2, ""), (3, " ".join(f"word{k} and thing{k % 7}" for k in range(20, 30))), (4, "..."), (None, "short text")], "item_id long, text string")
    got = decontam.contaminated(odd, items, item_block=2).toPandas()
    assert {1, 2} <= set(got[got.item_id == 3].doc_id.dropna()) and not set(got.item_id.dropna()) & {1, 2, 4}
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.contaminated(odd, items.where("item_id = -1")).count() == 0


def test_toxicity_odd_rows(session, odd, empty):
    labels = session.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all() and list(got.columns).count("score") == 1 and "key" in got
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(odd.limit(3), labels.where("doc_id = -1")).where("predicted = 1").count() == 0


def test_near_duplicates_odd_rows(odd, empty):
    got = neardup.near_duplicates(odd, key_block=2, region_block=200).toPandas()
    assert len(got) == odd.count()
    group = got[got.doc_id.isin([1, 2, 6])]
    assert set(group.component_id) == {1} and list(group.sort_values("doc_id").kept) == [True, False, False]
    assert set(got[got.doc_id.isna() & (got.n_shingles > 0)].component_id) == {1}
    assert set(got[got.doc_id.isin([7, 12])].component_id) == {7}
    alone = got[got.doc_id.isin([3, 4, 5])]
    assert (alone.n_shingles == 0).all() and (alone.component_id == alone.doc_id).all() and alone.kept.all()
    assert neardup.near_duplicates(empty).count() == 0


def test_licenses_odd_rows(session, odd, empty):
    df = session.createDataFrame([
        (1, "Released under the MIT License. again UNDER, THE mit-license; cc by nc"), (1, "Released under the MIT License."), (2, None), (3, ""), (4, "cc by nc cc by nc"),
        (5, "x " * 9 + "redistribution and use in source or binary forms with or without changes and modification are permitted provided that the following conditions are met")], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in licenses.license_report(df).collect()}
    assert got[1, 13].n_base == 3 and (got[1, 13].first_word, got[1, 13].last_word) == (1, 10) and got[1, 13].base_labels == "cc-by-nc,mit"
    assert got[1, 5].n_base == 1 and got[2, 0].n_base == 0 and got[3, 0].labels == "" and got[4, 6].n_base == 2
    assert got[5, 32].labels == "bsd" and 0.7 <= got[5, 32].score < 1 and got[5, 32].first_word is None
    assert licenses.license_report(odd).count() == odd.count() and licenses.license_report(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.template_grams(session, {"two words": "x"}, [])


def test_chats_odd_rows(session):
    hostile = "\\l<turn x> \\b </turn>\n\\\\g >"
    rows = [(1, 0, "user", hostile), (1, 1, "assistant", hostile), (1, 2, "assistant", None), (None, None, None, None), (2, 0, "a>b<", ""), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "user", "a")]
    df = session.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"rows": F.lit(1), "segments": F.lit(2), "body": F.lit(3)})
    out = chatformat.format_chats(chatformat.text_turns(df))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chatformat.read_turns(F.col("formatted")).alias("turns"), chatformat.learned_text(F.col("segments")).alias("learned")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", hostile), ("assistant", hostile), ("assistant", "")] and got[1].learned == hostile
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")] and got[2].turns[0].role == "a>b<"
    assert [t.text for t in got[3].turns] == ["a", "a", "b"]
    assert chatformat.format_chats(chatformat.text_turns(df.where("conv_id = -1"))).count() == 0


def test_chat_parts(session):
    turns = session.sql(f"""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array(
        named_struct('kind', 'text', 'text', 'see <this>', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('kind', 'image', 'text', null, 'ref', 's3://a.png', 'width', 700, 'height', 300, 'seconds', null, 'pages', null),
        named_struct('kind', 'audio', 'text', null, 'ref', 'b.wav', 'width', null, 'height', null, 'seconds', 2.0D, 'pages', null),
        named_struct('kind', 'document', 'text', null, 'ref', 'c.pdf', 'width', null, 'height', null, 'seconds', null, 'pages', 3)) AS parts
        UNION ALL SELECT 1L, 1L, 'assistant', CAST(null AS array<{chatformat.PART}>)""")
    row = chatformat.format_chats(turns).first()
    assert row.formatted == "<turn user>see \\lthis><image 1 448><audio 2 50><document 3 1536></turn>\n<turn assistant></turn>\n"
    assert [(a["index"], a["ref"], a["tokens"]) for a in row.attachments] == [(1, "s3://a.png", 448), (2, "b.wav", 50), (3, "c.pdf", 1536)]
    assert row.attachment_tokens == 448 + 50 + 1536


# --- without Spark ------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_differencing_is_tight_and_whole(seed):
    weights = np.random.default_rng(seed).integers(1, 10_000, 500).tolist()
    places = sharding.difference(([(w, k)] for k, w in enumerate(weights)), 7)
    assert sorted(k for _, members in places for k in members) == list(range(500))
    assert all(total == sum(weights[k] for k in members) for total, members in places)
    assert max(t for t, _ in places) - min(t for t, _ in places) <= 100
    assert [t for t, _ in sharding.difference([], 3)] == [0, 0, 0]


def test_sum_of_squares_levels():
    packer = packing.SumOfSquares(8)
    choose = lambda counts, size: (packer.counts.__setitem__(slice(None), counts), packer.level(size))[1]
    rng = np.random.default_rng(0)
    for _ in range(300):
        counts = rng.integers(0, 3, 9)
        counts[[0, 8]] = 0
        size = int(rng.integers(1, 8))
        def after(h):
            n = counts.copy()
            n[h] -= h > 0
            n[h + size] += 1
            return int((n[1:8] ** 2).sum())
        options = {h: after(h) for h in range(0, 9 - size) if h == 0 or counts[h]}
        assert options[choose(counts, size)] == min(options.values())


def test_packer_bounds_open_windows():
    packer, rng, total = packing.SumOfSquares(64, open_tokens=500), np.random.default_rng(1), 0
    for k in range(400):
        n = int(rng.integers(1, 150))
        packer.add(k, np.arange(n, dtype="<u4").tobytes())
        total += n
        assert packer.held <= 500
    packer.finish()
    sizes = [sum(len(p[2]) // 4 for p in w) for w in packer.done]
    assert sum(sizes) == total and all(s == 64 or s & (s - 1) == 0 for s in sizes)


@pytest.mark.parametrize("path,blank", [(BYTES, True), (WORDS, False)])
def test_spaced_encoding_is_the_tokenizers(path, blank):
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \n b", "\n\na", "a\n", "Don't stop, it's 12,5. Really.. ~tilde~ ~ x~", "ÉTÉ Ünï İΣ ΑΣ Å é ŀ ",
             "tab\tand\x1cother space\x85", "<|endoftext|> ok", "x.,", ",", ".", "~", "word " * 50, "日本語 テキスト。 русский, текст."]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("ab~. ,\n'é1!"), 60)) for _ in range(200)]
    encoder = tokens.SpacedEncoder(path, blank)
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_words_are_what_python_splits():
    import pyarrow as pa

    texts = ["a b a", None, "", "  x\ty\n", "\x0b\x0cz\r q", "é\xa0ü  w", "   "]
    words, numbers, bounds = common.distinct_words(pa.array(texts))
    got = [[words[int(k)].as_py() for k in numbers[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [[w.decode() for w in (t or "").encode().split()] for t in texts]


def test_steps_cover_a_batch():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 30, None, "", "b" * 5, "c" * 200, "d"])], ["text"])
    steps = list(common.text_steps(batch, most=40))
    assert [x for s in steps for x in s.column("text").to_pylist()] == batch.column("text").to_pylist() and [len(s) for s in steps] == [4, 1, 1]


@pytest.mark.parametrize("limit", [6, 9, 20])
def test_huffman_lengths_and_bits(limit):
    counts = np.zeros(60, np.int64)
    counts[5:55] = (1.5 ** np.arange(50)).astype(np.int64)
    lengths = tokenfile.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(int)
    assert len(used) == 50 and used.max() <= limit and sum(2.0 ** -used) <= 1
    codes = tokenfile.canonical_codes(lengths)
    written = [format(int(codes[k]), "b").zfill(int(lengths[k])) for k in np.flatnonzero(lengths)]
    assert not any(a != b and b.startswith(a) for a in written for b in written)
    ids = np.random.default_rng(limit).integers(5, 55, 1_000).astype(np.uint16)
    data, sizes, within = tokenfile.encode_bits(ids, np.array([1, 699, 300]), codes, lengths)
    at = 0
    for doc, start, size in ((ids[:1], 0, sizes[0]), (ids[1:700], 1, sizes[1]), (ids[700:], 700, sizes[2])):
        bits, at = data[at : at + size], at + size
        assert "".join(format(b, "08b") for b in bits).startswith("".join(written[k - 5] for k in doc))
        marks = within[start : start + len(doc) : tokenfile.STRIDE]
        lanes = np.full(len(marks), tokenfile.STRIDE)
        lanes[-1] = len(doc) - tokenfile.STRIDE * (len(marks) - 1)
        assert tokenfile.decode_bits(bits, marks, lanes, tokenfile.decode_table(lengths)).tolist() == doc.tolist()


def test_huffman_of_few_ids():
    assert tokenfile.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0] and tokenfile.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        tokenfile.code_lengths(np.ones(9, int), 3)


def test_signatures_within_the_guarantee_share_a_key():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for _ in range(50):
        a = rng.integers(0, 1 << 16, neardup.SLOTS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(neardup.SLOTS, neardup.GUARANTEED, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([a.tobytes(), b.tobytes()], pa.binary()), pa.array([1, 2])], ["signature", "node"])
        keys = next(iter(neardup._keys(iter([batch])))).to_pandas().groupby("node").key.agg(set)
        assert keys[1] & keys[2]


def test_common_words_is_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 20)).tolist()
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        assert decontam.common_words(decontam._masks(a), len(a), b) == row[-1]


def test_novelty_tells_keys_from_words():
    novelty = secretscan.Novelty()
    found = lambda t: [s for s in secretscan.spans_of(t, novelty) if s[0] == "novel"]
    assert found("our credential is stored as kJ8sQz71LmPx04TbVw9Ry3 in the vault")
    assert not found("our credential is stored as configuration_parameter_1 in the vault configuration_parameter_1")
    assert not found("nothing here kJ8sQz71LmPx04TbVw9Ry3") and not found("")
    spans = secretscan.spans_of("secret:token:abcdefgh token = 'abcdefgh'", novelty)
    assert [s[:3] for s in spans if s[0] == "assign"] == [("assign", 22, 39)]
    assert re.match(secretscan.ASSIGN, "Api_KEY : x")


def test_novel_spans_equal_a_plain_search():
    """Each run is looked at once; the plain search looks at every word for every run."""
    import random

    novelty, source = secretscan.Novelty(), random.Random(4)
    signs = "abcXYZ0189+/_-=."
    bits = [*secretscan.CONTEXT, " ", ": ", " is ", "\n", " the words go on and on ", "configuration", "password = 'hunter22'", "deadbeef" * 4]
    for _ in range(150):
        text = "".join(source.choice(bits) if source.random() < 0.7 else "".join(source.choice(signs) for _ in range(source.randint(5, 40))) for _ in range(25))
        taken = secretscan.base_spans(text, text.encode(), text.encode().lower())
        want = []
        for run in re.finditer(r"[A-Za-z0-9+/_=.\-]+", text):
            words = [m.end() for m in secretscan._CONTEXT.finditer(text)]
            inside = [w for w in words if run.start() < w <= run.end() - secretscan.SHORTEST]
            near = [w for w in words if w <= run.start()][-1:]
            start = inside[-1] if inside else run.start() if near and run.start() - near[0] <= secretscan.REACH else None
            if start is None or run.end() - run.start() < secretscan.SHORTEST or any(s < run.end() and start < e for _, s, e, _ in taken):
                continue
            string = text[start : run.end()]
            if len(string.strip("=.-_/")) < secretscan.SHORTEST:
                continue
            added = novelty.added(text[max(0, start - secretscan.AROUND) : start], string, text[run.end() : run.end() + secretscan.AROUND])
            mixed = secretscan._MIXED.search(string.strip("=.-_/"))
            if added >= max(secretscan.NOVEL_BYTES, (secretscan.NOVEL_SHARE if mixed else secretscan.WORD_SHARE) * len(string)):
                want.append((start, run.end()))
        assert [s[1:3] for s in secretscan.novel_spans(text, text.encode().lower(), taken, novelty)] == want


def test_secret_scan_takes_time_with_the_length_only():
    import time

    novelty, began = secretscan.Novelty(), time.monotonic()
    assert secretscan.spans_of("secret " * 300_000, novelty) == []
    assert len(secretscan.spans_of("token = abcdef1234 " * 100_000, novelty)) == 100_000
    secretscan.spans_of("secret" * 100_000, novelty)
    assert time.monotonic() - began < 60


def test_keys_without_digits_and_unknown_words():
    novelty = secretscan.Novelty()
    found = lambda t: [s[:3] for s in secretscan.spans_of(t, novelty)]
    assert found("passphrase: QwErTyZxCvBnMkLpOi") == [("novel", 12, 30)]
    assert not found("your secret is authentication-related, the bearer of configuration management")


def test_window_codes_and_buckets(session):
    grams, owner = toxicity.word_codes(["ab", "", "c"])
    assert owner.tolist() == [0, 0, 0, 1, 2, 2]
    chars = [tuple(int(g) >> 12 * k & 0xFFF for k in (4, 3, 2, 1, 0)) for g in grams]
    assert chars[0] == (1, 1, 1, 1, 97) and chars[2] == (1, 1, 97, 98, 2) and chars[3] == (1, 1, 1, 1, 2) and chars[5] == (1, 1, 1, 99, 2)
    df = session.createDataFrame([(int(g),) for g in grams], "gram long")
    for order in toxicity.BUCKETS:
        got = [r[0] for r in df.select(toxicity._hash_bucket(F.col("gram"), order)).collect()]
        assert got == toxicity._bucket_of(grams, order).tolist()


def test_estimated_accuracies_follow_agreement(session):
    rows = [(1, 1, 0, 900), (-1, 0, 0, 50), (-1, -1, 0, 50)]
    patterns = session.createDataFrame(rows, "vote_a int, vote_b int, vote_c int, n long")
    got = quality.estimate(patterns, ["a", "b", "c"])
    assert got["a"] > 0.9 and got["b"] > 0.9 and got["c"] == quality.START_ACCURACY


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_pipeline_stages_with_odd_rows(session, odd, empty):
    """No stage touches a column, whatever it is called, and rows without ids or with equal ids are told apart."""
    import corpus_pipeline

    source = odd.withColumnsRenamed({"words": "n.words", "score": "Predicted_"}).withColumn("score", F.lit("x")).withColumn("row", F.lit(1.5)).withColumn("doc", F.lit(2))
    docs = source.select("text", *[f"`{c}`" for c in source.columns if c != "text"])
    stages = dict(corpus_pipeline.STAGES)
    before = _rows(docs)
    for name in ("toxicity", "near duplicates", "decontamination", "secrets"):
        out = stages[name](session, docs, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and not _rows(out) - before, name
        none = stages[name](session, docs.where("doc_id = -1"), FOLDER)
        assert none.columns == docs.columns and none.count() == 0, name
    ids = Counter(r.doc_id for r in stages["near duplicates"](session, docs, FOLDER).collect())
    assert ids == Counter([1, 3, 4, 5, 7, None, 8, 9, 10, 11])  # prose: 1 of 1, 2, 6 and one without id; "short text": one of 7, 7 and 12
    bad = session.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    mixed = session.createDataFrame([(1, bad), (1, "a clean text"), (None, bad), (None, "another clean text")], "doc_id long, text string")
    kept = stages["decontamination"](session, mixed, FOLDER)
    assert sorted(r.text for r in kept.collect()) == ["a clean text", "another clean text"]
    assert stages["packing"](session, docs, FOLDER).count() >= docs.count() and stages["packing"](session, empty, FOLDER).count() == 0
