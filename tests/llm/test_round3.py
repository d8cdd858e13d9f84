"""Byte-level BPE by joins, the source audit and whitening, against the library, DuckDB and numpy."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import divergence, monoid, pretokens, whitening
from brindle.llm.shared import prepared
from conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return monoid.encoder(monoid.rank_file())


# --- encoding by joins -------------------------------------------------------------------------------------------------


@given(st.text(st.sampled_from("ab'st \n\té́世𝒳😀1٣!=\x00\x85\x1c　"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_texts_encode_as_the_library_has_them(text):
    import public_tokenizers

    one = monoid.encoder(monoid.rank_file())
    if not hasattr(test_texts_encode_as_the_library_has_them, "library"):
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        test_texts_encode_as_the_library_has_them.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = one.encode(text)
    assert ids == test_texts_encode_as_the_library_has_them.library.encode_ordinary(text)
    assert one.monoid.decode(ids) == text.encode()


def test_long_pretokens(encoder, library):
    r = random.Random(3)
    for text in ("a" * 20_001, "abc" * 7_001, "=" * 5_003, "é" * 3_001, "".join(r.choice("abcdefgh") for _ in range(30_000)), "".join(r.choice("aA") for _ in range(9_000))):
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_join_is_associative_for_any_vocabulary():
    """Random ranks, among them tokens that no merge reaches: joins equal merging all bytes at once, wherever the halves are cut."""
    r = random.Random(9)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        for i in range(r.randint(1, 40)):
            token = bytes(r.choice(b"abc") for _ in range(r.randint(2, 6)))
            ranks.setdefault(token, 256 + r.randint(0, 10**6) * 64 + i)
        one = monoid.Monoid(ranks)
        for _ in range(40):
            piece = bytes(r.choice(b"abc") for _ in range(r.randint(1, 120)))
            whole = one.merged(piece)
            assert one._merged_long(piece) == whole
            assert one.reduced(piece) == whole
            a, b = sorted(r.randint(0, len(piece)) for _ in range(2))
            x, y, z = one.reduced(piece[:a]), one.reduced(piece[a:b]), one.reduced(piece[b:])
            assert one.join(one.join(x, y), z) == one.join(x, one.join(y, z)) == whole
            assert one.decode(whole) == piece


def test_a_token_that_merges_do_not_reach_is_taken_whole_only_as_a_pretoken():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300}
    one = monoid.Monoid(ranks)
    assert one.encode(b"abc") == (300,)
    assert one.encode(b"abcd") == tuple(b"abcd")


def test_splitter_equals_the_pattern():
    import public_tokenizers
    import regex

    known, r = regex.compile(public_tokenizers.PATTERN), random.Random(4)
    one = pretokens.splitter()
    for _ in range(300):
        text = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xD800), r.randrange(0xE000, 0x10000), r.choice([0x20, 0x0A, 0x27, 0x1D7D8, 0x1F600])])) for _ in range(80))
        assert one.findall(text) == known.findall(text)


def test_byte_bpe_query_and_odd_inputs(spark, library):
    prepared(spark)
    want = {}
    for row in pd.read_parquet(f"{SF}/documents.parquet").itertuples():
        ids = library.encode_ordinary(row.text)
        want[row.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(row.text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in monoid.op11_byte_bpe(spark, SF).collect()} == want
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x" * 100_000, "en", "s", 1), (4, "twice 😀", "en", "s", 1), (4, "twice 😀", "en", "s", 1)]
    odd = spark.createDataFrame(rows, DOCS).selectExpr("*", "'a' as n_tokens", "1 as ids")
    got = monoid.encoded(odd).collect()
    assert sorted(bytes(r["__decoded"]).decode() for r in got) == sorted(t or "" for _, t, *_ in rows)
    assert all(list(r["__ids"]) == library.encode_ordinary(r.text or "") for r in got)
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256) for r in monoid.digests(odd).where("doc_id < 3").collect()] == [(0, empty)] * 2
    assert monoid.digests(odd.limit(0)).collect() == [] == monoid.encoded(odd.limit(0)).collect()


# --- source divergence -------------------------------------------------------------------------------------------------


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def by_sql(rows):
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"text": "string", "lang": "string", "source": "string"})  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    return sorted(con.execute(divergence.OP12_SQL).fetchall())


def test_divergence_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows_of(divergence.op12_source_divergence(spark, SF)) == sorted(con.execute(divergence.OP12_SQL).fetchall())


def random_documents(seed, n):
    r = random.Random(seed)
    vocabulary = ["a", "B", "the", "é", "É", "x1y", "ss", "𝒳z", "-", "Word", "word", "zz9", "\x00q"]
    return [(r.choice([None, i, 3]), r.choice([None, "", "12 _", *[" ".join(r.choices(vocabulary, k=r.randint(1, 30))) for _ in range(8)]]), r.choice([None, "", "en", "de", "none"]), r.choice([None, "", "s1", "s2", "é", "z"]), 1) for i in range(n)]


def test_divergence_of_odd_documents(spark, monkeypatch):
    prepared(spark)
    for name, value in (("HELD_TERMS", 7), ("PART_BYTES", 5), ("EMITTED", 3), ("HELD_PAIRS", 4), ("SCANNED_ROWS", 2)):
        monkeypatch.setattr(divergence, name, value)
    for seed, n in ((1, 120), (2, 9), (3, 3), (4, 1)):
        rows = random_documents(seed, n)
        docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "'x' as term", "1 as count", "2 as block")
        assert rows_of(divergence.divergence(docs)) == by_sql(rows)
    empty = spark.createDataFrame([], DOCS)
    assert divergence.divergence(empty).collect() == []


def test_counts_beyond_longs_and_many_sources(spark, monkeypatch):
    prepared(spark)
    share = spark.sql(f"select {divergence._share('c', 'n', 'v')} as p from values (99999999999999L, 400000000000000L, 3L) as t(c, n, v)").first().p
    assert share == 1 + 10**9 * 10**14 // (4 * 10**14 + 3)
    rows = [(i, f"common only{i % 40} pair{i % 2}", "en", f"s{i % 40}", 1) for i in range(160)]
    want = by_sql(rows)
    docs = spark.createDataFrame(rows, DOCS)
    assert rows_of(divergence.divergence(docs)) == want


def test_a_text_is_split_in_parts_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PART_BYTES", 3)
    assert [t for p in divergence.terms("ab Cd,é9fghijk  l".encode()) for t in p] == [b"ab", b"cd", "é".encode(), b"fghijk", b"l"]


# --- whitening ---------------------------------------------------------------------------------------------------------


def whitened_by_numpy(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = (x - 1_000_000) - (total - n * 1_000_000) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    return n, [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total)) for row in x], centred, values[::-1], axes[:, ::-1], np.trace(cov)


def check(found, ids, vectors, k):
    n, deviations, centred, values, axes, trace = whitened_by_numpy(vectors)
    assert len(found) == n * k and set(found.n) == {n}
    assert (found.identity_error <= 1e-9).all() and found.identity_error.nunique() == 1
    table = found.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    signs = np.sign((table * want).sum(axis=0))
    assert np.allclose(table * signs, want, atol=1e-6)
    assert found.drop_duplicates("vec_id").set_index("vec_id").loc[ids].deviation.tolist() == deviations
    assert np.allclose(found.drop_duplicates("component").sort_values("component").explained, values[:k] / trace, rtol=1e-9)
    assert np.allclose(table.T @ table / n, np.eye(k), atol=1e-9)


def test_whitening_equals_numpy(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    check(whitening.op13_whitening(spark, SF).toPandas(), table.vec_id.tolist(), table.embedding.tolist(), 32)


@pytest.mark.parametrize("most,least,dimensions", [(3, 2, 7), (2, 2, 5), (512, 16, 3), (4, 4, 4)])
def test_tiles_of_any_size(spark, monkeypatch, most, least, dimensions):
    prepared(spark)
    monkeypatch.setattr(whitening, "TILE_MOST", most)
    monkeypatch.setattr(whitening, "TILE_LEAST", least)
    r = np.random.default_rng(5)
    vectors = (r.normal(size=(300, dimensions)) @ r.normal(size=(dimensions, dimensions)) + 7).astype(np.float32).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(5)
    check(whitening.whitened(df).toPandas(), list(range(300)), vectors, dimensions)


def test_whitening_odd_inputs(spark):
    prepared(spark)
    good = [[1.0, 2.0], [2.0, 1.0], [4.0, 4.5], [-3.0, 0.25]]
    rows = [(1, good[0]), (2, good[1]), (None, good[2]), (2, good[3]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (10, [3e38, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as component", "1 as n", "null as label")
    found = whitening.whitened(df).toPandas()
    n, deviations, *_ = whitened_by_numpy(good)
    assert len(found) == 8 and set(found.n) == {4}
    assert sorted(found.deviation) == sorted(deviations * 2)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    assert whitening.whitened(same).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whitened(line).collect()} == {1}
    assert whitening.whitened(df.limit(0)).collect() == [] == whitening.whitened(df.where("vec_id in (4, 9)")).collect()


def test_deviations_beyond_longs():
    fit = whitening.Fit(2, 3 * 10**9, [3 * 10**9, 5])
    assert fit.deviations(np.array([[1, 0], [2, 0], [4, 0]])) == [25, 9 * 10**18 + 25, None]


# --- decontamination ---------------------------------------------------------------------------------------------------


def covered_by_brute_force(text, items, window=13):
    ws = divergence_words(text)
    hit, found = [False] * len(ws), set()
    for i, t in items:
        theirs = divergence_words(t)
        n = min(window, len(theirs))
        for q in range(len(theirs) - n + 1 if n else 0):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == theirs[q : q + n]:
                    hit[p : p + n] = [True] * n
                    found.add("" if i is None else str(i))
    return len(ws), sum(hit), sorted(found)


def divergence_words(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block,shard", [(16 << 20, 2 << 20), (60, 2 << 20), (16 << 20, 150)])
def test_coverage_of_repetitive_texts_equals_brute_force(spark, monkeypatch, block, shard):
    from brindle.llm import suffix

    prepared(spark)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix, "TOGETHER", 7)
    monkeypatch.setattr(suffix, "LOOKED_UP", 5)
    r = random.Random(11)
    say = lambda n: " ".join(r.choice(["go", "Yes", "no"] if r.random() < 0.5 else ["go"]) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 5, 13, 20, 40]))) for i in range(12)] + [(3, "yes"), (None, "go"), (50, None), (51, "..."), (52, "absent"), (53, "yes")]
    docs = [(i, say(r.randint(0, 60))) for i in range(25)] + [(None, None), (7, "yes"), (7, "yes"), (9, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as content", "1 as n_hit", "2 as of", "3 as __content")
    want = sorted(repr((i, *covered_by_brute_force(t, items))) for i, t in docs)
    found = suffix.coverage(rows, bench).collect()
    assert sorted(repr((x.doc_id, x.n_words, x.n_hit, sorted(x["items"]))) for x in found) == want
    assert all(x.n_hit == len({k for p in x.passages for k in range(p.doc_pos, p.doc_pos + p.n_words)}) for x in found)
    left = suffix.decontaminated(rows, bench)
    assert left.columns == rows.columns
    clean = [(i, t) for i, t in docs for n, hit, _ in [covered_by_brute_force(t, items)] if not (hit and 20 * hit >= n)]
    assert sorted(map(repr, ((x.doc_id, x.text) for x in left.collect()))) == sorted(map(repr, clean))


def test_coverage_takes_each_range_once():
    """One word over and over, in items and texts, and ten thousand items of one word: time and memory do not grow with their product."""
    import resource
    import time

    from brindle.llm import suffix, words

    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    raw = [b"go " * 500_000, b"yes " * 5_000]
    found = words.split(raw, words.ALNUM)
    tests = suffix.Tests([("long", "go " * 5_000), *((str(i), "yes") for i in range(10_000))], 13)
    n_hit, passages, items = suffix.shard_coverage(found, suffix.Shard(suffix.sequence_of(found), 13), tests)
    assert n_hit.tolist() == [500_000, 5_000] and passages.to_pylist() == [[{"doc_pos": 0, "n_words": 500_000}], [{"doc_pos": 0, "n_words": 5_000}]]
    assert items[0].as_py() == ["long"] and len(items[1]) == 10_000
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


# --- token counts ------------------------------------------------------------------------------------------------------


def test_stored_trees_are_edited_again(spark):
    """Two batches of edits: the second works on what the first stored, and counts only what it touched."""
    from brindle.llm import bpe, edits
    from brindle.llm.shared import written

    prepared(spark)
    r = random.Random(12)
    pieces = ["word ", "it's", " 12", "\n\n", "é", "<|endoftext|>", "<|endof", "text|>", "𝒳 ", "  ", "longer words here "]
    raw = [("".join(r.choices(pieces, k=r.choice([0, 1, 9, 4000])))) for _ in range(40)] + [None]
    rows = spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string")
    change = lambda a, b, new: f"array(named_struct('start', {a}, 'end', {b}, 'text', '{new}'))"
    first = written(edits.recounted(edits.trees(rows).selectExpr("*", f"{change('int(length(text) / 3)', 'int(length(text) / 3) + 7', '<|endo')} as edits")), "first")
    again = first.selectExpr("doc_id", "edited as text", *edits.STORED, f"{change('int(length(edited) / 2)', 'int(length(edited) / 2) + 2000', 'x')} as edits")
    tokenizer = bpe.compiled(bpe.tokenizer_file())
    before = {x.doc_id: x.edited for x in first.collect()}
    for x in edits.recounted(again).collect():
        assert x.n_tokens == len(tokenizer.encode(before[x.doc_id])) and x.n_tokens_edited == len(tokenizer.encode(x.edited))
        assert x.n_pretokens == sum(1 for _ in tokenizer.pieces(before[x.doc_id])) and x.n_reencoded < 60
        n, at = len(before[x.doc_id]), len(before[x.doc_id]) // 2
        assert x.edited == before[x.doc_id][:at] + "x" + before[x.doc_id][min(at + 2000, n) :]


def test_an_edit_touches_two_leaves_of_a_long_text():
    from brindle.llm import bpe, edits

    one = edits.CountedText("some words " * 100_000, bpe.compiled(bpe.tokenizer_file()))
    one.edit(300_000, 700_000, "thing")  # thousands of leaves go without being looked at
    assert one.touched < 3 * edits.LEAF and one.counts.n_tokens == len(one.tokenizer.encode(one.text))
    one.edit(0, 0, "new words " * 5_000)
    assert one.counts.n_tokens == len(one.tokenizer.encode(one.text)) and max(one.counts.nodes[2][one.counts.width :]) <= edits.GROWN * edits.LEAF


# --- licences ----------------------------------------------------------------------------------------------------------


def test_words_put_in_or_left_out_do_not_hide_a_licence(spark):
    from brindle.llm import licences
    from brindle.llm.licence_texts import PARAGRAPHS

    r = random.Random(21)
    rows, long = [], [(i, label, text.split()) for i, (label, text, phrases) in enumerate(PARAGRAPHS) if len(text.split()) >= 30]
    rows.append((0, "", "Permission is hereby granted, free of charge, to any person or company obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute"))
    for i, label, ws in long:
        phrase = {w for p in PARAGRAPHS[i][2] for w in p.split()}
        for n in range(6):  # one word in twenty is changed, put in or left out; key phrases stay
            out = []
            for w in ws:
                fixed = "".join(c for c in w.lower() if c.isalnum()) in phrase
                what = r.random()
                out += [w] if fixed or what > 0.05 else [] if what < 0.015 else [f"q{r.getrandbits(20)}"] if what < 0.035 else [w, f"q{r.getrandbits(20)}"]
            rows.append((100 * (i + 1) + n, label, "some words before it " * r.randint(0, 3) + " ".join(out) + " and some after"))
    shuffled = [(10**6 + i, "", " ".join(r.sample(ws, len(ws)))) for i, _, ws in long]
    found = {x.doc_id: {f.label for f in x.finds} for x in licences.scanned(prepared(spark).createDataFrame([(i, t) for i, _, t in rows + shuffled], "doc_id long, text string")).collect()}
    assert "mit" in found[0]
    assert [i for i, label, _ in rows[1:] if label not in found[i]] == []
    assert all(not found[i] for i, _, _ in shuffled)


# --- SimHash -------------------------------------------------------------------------------------------------------------


def test_links_by_unions_of_segments_and_through_hubs(spark):
    from brindle.llm import simhash

    prepared(spark)
    r = random.Random(17)
    base = [r.getrandbits(64) for _ in range(5)]
    values = sorted({b ^ sum(1 << p for p in r.sample(range(64), k)) for b in base for k in range(8) for _ in range(5)} | {0, 2**64 - 1, 1 << 63})
    # a large group of near copies, and a chain whose ends are far apart
    values = sorted({*values, *(sum(1 << p for p in (40, *r.sample(range(40), 2))) for _ in range(60)), *((1 << 4 * k) - 1 for k in range(16))})
    n = len(values)
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "node long, f0 long")
    want = {(a, b) for b in range(n) for a in range(b) if (values[a] ^ values[b]).bit_count() <= 4}
    assert {tuple(x) for x in simhash.links(df, simhash.Unions()).collect()} == want
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in sorted(want):
        root[max(find(a), find(b))] = min(find(a), find(b))
    tied = {(x, find(x)) for pair in want for x in pair}
    for scheme in (*simhash.SCHEMES, simhash.Unions()):
        assert {tuple(x) for x in simhash.linked(df, scheme).collect()} == tied
    assert len(simhash.Unions().masks) == 70 and [type(simhash.search_for(k)).__name__ for k in (0, 10**6, 10**9, 10**10)] == ["Scheme", "Scheme", "Unions", "Unions"]
    assert all(simhash.work(simhash.search_for(k), k) < 400 for k in (10**6, 10**9))
