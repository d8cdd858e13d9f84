"""The corpus operators against brute force, round trips and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, canonical, components, edits, kneser_ney, licences, quality, registry, simhash, suffix, warc, winnow, words
from brindle.llm.shared import prepared
from conftest import SF

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def table():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    prepared(spark)
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (4, long, "en", None, len(long)), (4, long, "en", None, len(long)), (5, "one", "fr", "s", 3), (None, "no id here", "en", "s", 10), (6, long + " x", "en", "s", 1), (7, "one", "fr", "s", 3)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("clash")).withColumn("node", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return prepared(spark).createDataFrame([], SCHEMA)


def pandas_of(df, *by):
    return df.toPandas().sort_values(list(by or ["doc_id"])).reset_index(drop=True)


# --- words -----------------------------------------------------------------------------------------------------------


def test_words_and_hashes_are_those_of_the_patterns(table):
    raw = [t.encode() for t in table.text[:40]] + [b"", b" ", "É x-Y é1 𝒳".encode()]
    for kind, pattern in ((words.SPACED, rb"[^\x20\x09-\x0D]+"), (words.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = words.split(raw, kind)
        want = [re.findall(pattern, t.lower()) for t in raw]
        assert [found.word(i) for i in range(len(found))] == [w for ws in want for w in ws]
        assert np.diff(found.first).tolist() == [len(ws) for ws in want]
        pairs = dict(zip(found.hashes().tolist(), (w for ws in want for w in ws)))
        assert len(pairs) == len({w for ws in want for w in ws})


# --- 1: scoring ------------------------------------------------------------------------------------------------------


def brute_scores(texts, train):
    split = [(t or "").encode().lower().split() + [None] for t in texts]
    unigrams, bigrams = Counter(), Counter()
    for ws, use in zip(split, train):
        if use:
            unigrams.update(ws)
            bigrams.update(zip(["<s>", *ws[:-1]], ws))
    n, v = sum(unigrams.values()), len(unigrams)
    follows, context = Counter(w for _, w in bigrams), defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), c in bigrams.items():
        context[a][0] += c
        context[a][min(c, 3)] += 1
    counts = lambda values: kneser_ney.discounts(*[sum(x == k for x in values) for k in (1, 2, 3, 4)])
    upper, lower = counts(bigrams.values()), counts(follows.values())
    d = lambda by, c: by[min(c, 3) - 1] if c else 0.0
    total = len(bigrams)
    mass = sum(d(lower, c) for c in follows.values()) / total if total else 1.0
    out = []
    for ws in split:
        score = base = 0.0
        for a, w in zip(["<s>", *ws[:-1]], ws):
            p = max(follows[w] - d(lower, follows[w]), 0) / max(1, total) + mass / (v + 1)
            if a in context:
                c = context[a]
                p = max(bigrams[a, w] - d(upper, bigrams[a, w]), 0) / c[0] + sum(x * y for x, y in zip(upper, c[1:])) / c[0] * p
            score += math.log10(p)
            base += math.log10((unigrams[w] + 1) / (n + v + 1))
        out.append((len(ws), sum(unigrams[w] > 0 for w in ws), base, score))
    return out, n


def test_scores_equal_brute_force(spark, table):
    got = pandas_of(registry.QUERIES["op1_lm_score"](spark, SF))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in table.doc_id]
    want, n = brute_scores(table.text, [not h for h in held])
    assert got.held_out.tolist() == held and set(got.train_tokens) == {n}
    assert got[["n_tokens", "n_known"]].values.tolist() == [list(w[:2]) for w in want]
    np.testing.assert_allclose(got[["base_score", "score"]].values, [w[2:] for w in want], rtol=1e-9)
    shown = got[got.held_out]
    assert shown.score.sum() > shown.base_score.sum()


def test_probabilities_after_a_context_sum_to_one(spark, table):
    prepared(spark)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in table.text[:30]], "text string"))
    h, before, _ = kneser_ney.tokens([t.encode() for t in table.text[:30]])
    every = np.unique(h)
    for context in (before[0], before[5], np.uint64(12345)):
        p, _ = model.probabilities(np.append(every, np.uint64(77)), np.full(len(every) + 1, context, dtype=np.uint64))
        assert p.sum() == pytest.approx(1.0)


def test_scoring_odd_inputs(spark, odd, empty):
    model = kneser_ney.train(odd)
    got = pandas_of(kneser_ney.scored(odd, model), "doc_id", "n_tokens")
    want, _ = brute_scores([r.text for r in odd.collect()], [True] * 9)
    assert sorted(got.score.round(6)) == sorted(round(w[3], 6) for w in want)
    none = kneser_ney.train(empty)
    assert kneser_ney.scored(empty, none).count() == 0
    assert kneser_ney.scored(odd, none).where("n_known > 0").count() == 0


def test_scoring_without_a_shard_fails(spark, table):
    prepared(spark)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in table.text[:5]], "text string"))
    kneser_ney._mapped.cache_clear()
    model.path += "-gone"
    h, before, _ = kneser_ney.tokens([table.text[0].encode()])
    with pytest.raises(FileNotFoundError):
        model.probabilities(h, before)


# --- 2: fingerprints -------------------------------------------------------------------------------------------------


def test_fingerprints_and_edits(spark, table):
    got = pandas_of(registry.QUERIES["op2_fingerprints"](spark, SF))
    texts, n = table.text.tolist(), len(table)
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % n][: len(t) // 2] for i, t in enumerate(texts)]
    assert got.doc_id.tolist() == table.doc_id.tolist() and got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    by_text = defaultdict(list)
    for i, t in zip(table.doc_id, texts):
        by_text[canonical.canonical(t)].append(i)
    assert got.group_id.tolist() == [min(by_text[canonical.canonical(t)]) for t in texts]
    assert got.fingerprint.nunique() == len(by_text)
    assert got.near_edited.tolist() == [float(canonical.canonical(t) == canonical.canonical(e)) for t, e in zip(texts, edited)]


def test_canonical_folds_forms_case_and_space():
    assert canonical.canonical(" Ｆｉｎ\t ﬁn \nÉ ") == canonical.canonical("fin fin é")
    assert canonical.canonical("ß") == canonical.canonical("SS")


def test_fingerprints_odd_inputs(spark, odd, empty):
    assert canonical.with_next(empty).count() == 0 and canonical.exact_groups(empty).count() == 0
    pairs = canonical.with_next(odd).collect()
    assert len(pairs) == 9
    order = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert sorted((r.text, r.next_text) for r in pairs) == sorted((a.text or "", b.text or "") for a, b in zip(order, order[1:] + order[:1]))
    groups = {(r.doc_id, r.group_id) for r in canonical.exact_groups(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (7, 5), (4, 4), (6, 6)} <= groups


def test_texts_that_share_a_digest_are_told_apart(spark, monkeypatch):
    df = prepared(spark).createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")

    def colliding(docs):
        return docs.selectExpr("doc_id", "'same' as fingerprint")

    monkeypatch.setattr(canonical, "digests", colliding)
    assert {(r.doc_id, r.group_id) for r in canonical.exact_groups(df).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_groups_where_repeated_digests_are_many(spark, monkeypatch):
    rows = [(i, f"Text {i % 7}" if i < 60 else f"only {i}") for i in range(80)] + [(None, "Text 1"), (None, "nobody")]
    df = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(canonical, "small_or_none", lambda df: False)
    assert {(r.doc_id, r.group_id) for r in canonical.exact_groups(df).collect()} == {(i, (i % 7 if i < 60 else i) if i is not None else g) for i, g in [*((i, None) for i in range(80)), (None, 1), (None, None)]}


def test_one_document_is_its_own_next(spark):
    df = prepared(spark).createDataFrame([(9, "abc")], "doc_id long, text string")
    assert [(r.text, r.next_text) for r in canonical.with_next(df).collect()] == [("abc", "abc")]


# --- 3: passages -----------------------------------------------------------------------------------------------------


def brute_runs(rows, run=50):
    split, first = {i: (t or "").encode().lower().split() for i, t in rows}, {}
    for i in sorted(split):
        for k in range(len(split[i]) - run + 1):
            first.setdefault(tuple(split[i][k : k + run]), i)
    marks = {}
    for i, ws in split.items():
        mark, own = np.zeros(len(ws), dtype=bool), {}
        for k in range(len(ws) - run + 1):
            window = tuple(ws[k : k + run])
            if first[window] < i or own.setdefault(window, k) <= k - run:
                mark[k : k + run] = True
        marks[i] = mark
    return marks


def marked(df):
    out = {}
    for r in df.collect():
        out[r.doc_id] = set()
        for x in r.runs or []:
            out[r.doc_id] |= set(range(x.start, x.start + x.n_words))
    return out


def test_repeated_runs_equal_brute_force(spark, table):
    got = marked(registry.QUERIES["op3_line_dedup"](spark, SF))
    want = brute_runs(zip(table.doc_id, table.text))
    assert got == {i: set(np.flatnonzero(m)) for i, m in want.items()}
    assert any(got.values())


def test_passages_across_lines_and_short_ones(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    wrapped = passage.replace(" p30", "\np30")
    rows = [(1, f"a b {passage} c"), (2, f"x y z {wrapped} tail"), (3, " ".join(f"p{i}" for i in range(49))), (4, passage)]
    df = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in winnow.deduplicated(df).collect()}
    assert got == {1: rows[0][1], 2: "x y z tail", 3: rows[2][1], 4: ""}


def test_runs_behind_a_shorter_first_owner_and_other_places(spark):
    rng = random.Random(11)
    own = lambda n: " ".join(f"u{rng.getrandbits(40)}" for _ in range(n))
    rows = []
    for k in range(40):  # A has a piece of the passage (once short, once whole), later documents have more of it
        passage = [f"q{k}x{i}" for i in range(rng.choice([60, 90, 400]))]
        cut = rng.randint(16, 45)
        at = rng.randint(0, len(passage) - cut)
        short = " ".join(passage[at : at + cut])
        whole = " ".join(passage)
        a = f"{own(30)} {short} {own(30)}" + (f" {whole} {own(20)}" if k % 4 == 0 else "")
        rows += [(10 * k, a), (10 * k + 1, f"{own(40)} {whole} {own(9)}"), (10 * k + 2, f"{own(5)} {whole} {own(60)}"), (10 * k + 3, f"{own(9)} {' '.join(passage[3:])} {own(8)} {short}")]
    got = marked(winnow.repeated_runs(prepared(spark).createDataFrame(rows, "doc_id long, text string")))
    want = {i: set(np.flatnonzero(m)) for i, m in brute_runs(rows).items() if m.any()}
    assert got == want and all(10 * k + 2 in want for k in range(40))


def test_passages_that_a_document_repeats(spark):
    rng = random.Random(12)
    own = lambda n: " ".join(f"o{rng.getrandbits(40)}" for _ in range(n))
    run, long = own(80), own(400)
    rows = [(1, f"{own(20)} {run} {own(30)} {run} {own(5)} {run}"), (2, "go " * 300), (3, f"{own(60)} {run} {own(60)} {run}"), (4, f"{long} {own(3)} {long[:2000]} {own(9)}"), (5, own(200))]
    got = marked(winnow.repeated_runs(prepared(spark).createDataFrame(rows, "doc_id long, text string")))
    want = {i: set(np.flatnonzero(m)) for i, m in brute_runs(rows).items() if m.any()}
    assert got == want and len(want[1]) == 160 and len(want[2]) == 250 and len(want[3]) == 160 and 5 not in want


def test_rows_of_one_id_keep_their_own_texts(spark):
    run = " ".join(f"r{i}" for i in range(70))
    rows = [(1, run), (2, run), (2, "short other text"), (2, f"{run} and more"), (3, " ".join(f"x{i}" for i in range(120)))]
    got = sorted((r.doc_id, r.text) for r in winnow.deduplicated(prepared(spark).createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, run), (2, ""), (2, "short other text"), (2, "and more"), rows[4]])


def test_keys_joined_by_a_shuffle(spark, table, monkeypatch):
    docs = prepared(spark).read.parquet(f"{SF}/documents.parquet")
    want = marked(winnow.repeated_runs(docs))
    monkeypatch.setattr(winnow, "BROADCAST_KEYS", 0)
    assert marked(winnow.repeated_runs(docs)) == want


def test_passages_odd_inputs(spark, odd, empty):
    assert winnow.deduplicated(empty).count() == 0
    got = winnow.deduplicated(odd).collect()
    assert len(got) == 9
    text = {r.doc_id: r.text for r in got}
    assert text[1] is None and text[None] == "no id here" and len(text[6]) < 10 and len(text[4]) > 1000


# --- 4: near-duplicates ----------------------------------------------------------------------------------------------


def brute_components(prints, links):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if links(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark, table):
    import xxhash

    got = pandas_of(registry.QUERIES["op4_simhash"](spark, SF))
    want = []
    for t in table.text:
        ws = t.encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))] if ws else []
        want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    assert got.fingerprint.tolist() == [f"{w:016x}" for w in want]
    roots = brute_components(want, lambda a, b: (want[a] ^ want[b]).bit_count() <= 4)
    assert got.component_id.tolist() == [int(table.doc_id[r]) for r in roots]


def test_spark_hashes_are_the_same_xxh64(spark):
    import xxhash

    assert spark.sql("select xxhash64('a b c d')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_all_links_within_the_radius_are_found(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ sum(1 << p for p in random.sample(range(64), k)) for b in base for k in range(7) for _ in range(4)})
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    df = prepared(spark).createDataFrame(signed, "node long, f0 long")
    for scheme in simhash.SCHEMES:
        got = {tuple(r) for r in simhash.links(df, scheme).collect()}
        assert got == {(a, b) for b in range(len(values)) for a in range(b) if (values[a] ^ values[b]).bit_count() <= 4}
    assert [simhash.scheme_for(n).segments for n in (0, 10**6, 10**10)] == [(22, 21, 21), (22, 21, 21), (32, 32)]


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    found = {r.node: r.root for r in components.components(prepared(spark).createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_odd_inputs(spark, odd, empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert found[1] == found[2] == found[3] == 1 and found[5] == found[7] == 5
    left = simhash.deduplicated(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 4, 5]


def test_near_duplicate_removal_equals_brute_force(spark, table):
    docs = prepared(spark).read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    split = [t.lower().split() for t in table.text]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]
    roots = brute_components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert left == {int(table.doc_id[r]) for r in set(roots)}


def test_near_duplicates_of_one_id_are_judged_each(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.getrandbits(40)}" for _ in range(80))
    a, b = text(), text()
    rows = [(1, a), (2, a + " x"), (2, b), (2, b), (3, text()), (4, b + " y"), (None, a)]
    left = simhash.deduplicated(prepared(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(1, a), (2, b), (0, a), rows[4]])


def test_different_texts_that_one_repeated_word_dominates_stay(spark):
    rng = random.Random(4)
    rows = [(i, "go " * 300 + " ".join(f"w{rng.getrandbits(40)}" for _ in range(200))) for i in range(4)]
    left = simhash.deduplicated(prepared(spark).createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3]


def test_large_groups_of_near_copies_and_links_across_them(spark):
    rng = random.Random(9)
    made = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    base, rows = made(120), []
    for i in range(150):  # near copies of one text, some of them shorter; chains whose ends are not similar
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i}"
        rows.append(copy[: 120 - i % 9])
    chain = made(150)
    for i in range(12):
        rows.append(chain[:])
        chain = chain[5:] + made(5)
    rows += [base[:60] + made(60), base[40:] + made(10), base[:100] + base[:30]]
    texts = [(i, " ".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(texts)
    left = {r.doc_id for r in simhash.deduplicated(prepared(spark).createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    roots = brute_components(sets, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert left == set(roots)


def test_every_pair_of_the_similarity_is_found(spark):
    rng = random.Random(6)
    made = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    rows = []
    for k in range(400):  # each pair 0.805, near to the limit
        base, n = made(300), 32
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[n:] + made(n)))]
    block = made(30)
    rest = made(150)
    rows += [(900, " ".join(rest + block)), (901, " ".join(rest + block * 12))]
    left = {r.doc_id for r in simhash.deduplicated(prepared(spark).createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)} for i, t in rows}
    assert left == {i for i in sets if i % 2 == 0 or 5 * len(sets[i] & sets[i - 1]) < 4 * len(sets[i] | sets[i - 1])}
    assert 901 not in left and len(left) == 401


# --- 5, 10: tokens ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PIECES = ["a", "e", " ", "t", "h", "in", "  ", "\n", "é", "ß", "1", "23", "'s", "'ll", "!", "...", "日本", "aaaa", "<|endoftext|>", "　", "\t", "\xa0", "😀", "ing", "‍", "́", "Ⅷ", "²", "ﬁ", "\x00", "\x85"]


def test_bpe_equals_the_library(library, table):
    mine = bpe.compiled(bpe.tokenizer_file())
    random.seed(7)
    cases = table.text.tolist() + ["".join(random.choices(PIECES, k=random.randint(0, 14))) for _ in range(3000)] + ["", "a" * 3000, " " * 2000 + "x", "ab" * 1500]
    for text, want in zip(cases, library.encode_batch(cases, add_special_tokens=False)):
        ids = mine.encode(text)
        assert ids == want.ids, text[:80]
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_follows_the_merges_of_any_vocabulary():
    merges = [(b"a", b"a"), (b"b", b"a"), (b"aa", b"b"), (b"ba", b"aa"), (b"a", b"b"), (b"ab", b"ab")]
    vocabulary = {x: i for i, x in enumerate([b"a", b"b", *dict.fromkeys(a + b for a, b in merges)])}
    made = bpe.Automaton(vocabulary, merges)

    def plain(text):
        parts = [bytes([c]) for c in text]
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == a and parts[i + 1] == b:
                    parts[i : i + 2] = [a + b]
                i += 1
        return tuple(vocabulary[p] for p in parts)

    random.seed(1)
    for _ in range(2000):
        text = bytes(random.choices(b"ab", k=random.randint(1, 14)))
        assert made.encode(text) == plain(text), text


def test_bpe_query_and_odd_inputs(spark, library, table, odd, empty):
    got = pandas_of(registry.QUERIES["op5_bpe"](spark, SF))
    ids = [e.ids for e in library.encode_batch(table.text.tolist(), add_special_tokens=False)]
    assert got.n_tokens.tolist() == [len(x) for x in ids]
    assert got.ids_sha256.tolist() == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
    assert got.decoded_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in table.text]
    assert bpe.encoded(empty).count() == 0
    for r in bpe.encoded(odd).collect():
        assert r["__decoded"] == (r.text or "") and r["__ids"] == library.encode(r.text or "", add_special_tokens=False).ids


def test_counts_follow_edits(table):
    tokenizer = bpe.compiled(bpe.tokenizer_file())
    random.seed(3)
    special = "<|endoftext|>"
    pieces = [*PIECES, *(special[i:j] for i, j in ((0, 2), (0, 7), (2, 13), (7, 13), (12, 13))), special]
    for turn in range(1500):
        text = "".join(random.choices(pieces, k=random.randint(0, 30))) if turn % 3 else random.choice(table.text.tolist())[: random.choice([200, 3000])]
        counted = edits.CountedText(text, tokenizer)
        for _ in range(random.randint(1, 6)):
            start = random.randint(0, len(text))
            end, new = min(len(text), start + random.choice([0, 0, 1, 3, 50])), "".join(random.choices(pieces, k=random.choice([0, 2, 8])))
            counted.edit(start, end, new)
            text = text[:start] + new + text[end:]
            split = [w for _, w in tokenizer.pieces(text)]
            assert "".join(split) == text == counted.text and [x for leaf in counted.tree.sizes for x in leaf] == [len(w) for w in split]
            assert counted.tree.n_tokens == len(tokenizer.encode(text)) and counted.tree.n_chars == len(text)


def test_edits_touch_little_of_a_long_text():
    counted = edits.CountedText("word " * 50_000, bpe.compiled(bpe.tokenizer_file()))
    counted.edit(100_000, 100_004, "thing")
    assert counted.reencoded < 10


def test_stored_trees_and_odd_edits(spark, odd, empty):
    rows = odd.withColumn("edits", F.expr("if(doc_id = 2, null, array(named_struct('start', -5, 'end', 3, 'text', 'new '), named_struct('start', 1000000, 'end', 2000000, 'text', null)))"))
    built, stored = edits.recounted(rows), edits.recounted(edits.trees(rows))
    assert sorted(map(repr, built.collect())) == sorted(map(repr, stored.collect()))
    tokenizer = bpe.compiled(bpe.tokenizer_file())
    for r in built.collect():
        assert r.n_tokens_edited == len(tokenizer.encode(r.edited))
    assert edits.recounted(empty.withColumn("edits", F.expr("cast(null as array<struct<start:int,end:int,text:string>>)"))).count() == 0


def test_token_count_query(spark, table):
    got = pandas_of(registry.QUERIES["op10_token_counts"](spark, SF))
    tokenizer = bpe.compiled(bpe.tokenizer_file())
    for r, t in zip(got.itertuples(), table.text):
        n = len(t)
        new = t[: max(n // 2 - 10, 0)] + " an edited passage " + t[min(n // 2 + 10, n) :]
        new = "Note: " + new
        new = new[: max(len(new) - 16, 0)]
        assert r.n_tokens == len(tokenizer.encode(t)) and r.n_tokens_edited == len(tokenizer.encode(new)) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()


# --- 6: archive ------------------------------------------------------------------------------------------------------


def test_archive_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    df = registry.QUERIES["op6_warc"](spark, SF)
    want = con.execute(warc.OP6_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


def test_archive_round_trip_and_odd_pages(spark, tmp_path):
    big = "x" * 150
    rows = [(3, "u", big), (1, "u2", big), (2, None, None), (4, "a\r\nb", "é" * 60), (5, "v", "small"), (6, "v", "small"), (7, "w", "é" * 60), (1, "u2", big), (None, "n", big)]
    pages = prepared(spark).createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = warc.read_records(spark, path)
    found = {(r.page_id, r.record_type, r.refers_to) for r in warc.parsed(records).where("verified").collect()}
    assert found == {(1, "response", None), (3, "revisit", 1), (2, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "revisit", 4), (None, "response", None)}
    for r in records.collect():
        assert bytes(r.record).startswith(b"WARC/1.1\r\n") and bytes(r.record).endswith(b"\r\n\r\n")
    warc.write_archive(pages.limit(0), f"{path}0")
    assert warc.read_records(spark, f"{path}0").count() == 0


# --- 7: quality ------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    out = np.array([zlib.crc32(f"held {i}".encode()) % 3 == 0 for i in labels.doc_id])
    docs = prepared(spark).read.parquet(f"{sf}/documents.parquet")
    model, features = quality.train(docs, spark.createDataFrame(labels[~out]))
    found = quality.scored(features, model).toPandas().merge(labels[out], on="doc_id")
    rejected = (found["__low_quality"] >= 0.5) | (found["__toxic"] >= 0.5)
    bad = (found.quality == 0) | (found.toxic == 1)
    assert bad.sum() > 20 and rejected[bad].mean() > 0.7 and (~rejected[~bad]).mean() > 0.95


def brute_co_training(content, page, labels, held, used):
    """Two dense views, plain loops over rows and rounds, by the schedule that the operator documents."""
    names = {"text": content, "page": page}
    train, calib, rest = [i for i in labels if i not in held], [i for i in labels if i in held], [i for i in range(len(content)) if i not in labels]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    out = {}
    for target in (0, 1):
        y = {i: float(labels[i][target]) for i in labels}
        w = {v: np.zeros(x.shape[1]) for v, x in names.items()}
        platt = {}

        def descend(v, steps, told, rate, state):
            for _ in range(steps):
                slope = sum((sig(names[v][i] @ w[v]) - y[i]) * names[v][i] for i in train) / len(train)
                slope = (slope + told) * used(target, v) + 1e-3 * w[v]
                state[0] += 1
                state[1] = 0.9 * state[1] + 0.1 * slope
                state[2] = 0.99 * state[2] + 0.01 * slope * slope
                w[v] = w[v] - rate * (state[1] / (1 - 0.9 ** state[0])) / (np.sqrt(state[2] / (1 - 0.99 ** state[0])) + 1e-8)

        def calibrated():
            for v, x in names.items():
                platt[v] = quality.fit_dense((x[calib] @ w[v])[:, None], np.array([y[i] for i in calib]))

        for v in names:
            descend(v, 150, 0.0, 0.1, [0, 0.0, 0.0])
        calibrated()
        prior = sum(y[i] for i in train) / len(train)
        for _ in range(quality.ROUNDS - 1):
            sure = {v: {i: platt[v][0] * (names[v][i] @ w[v]) + platt[v][1] for i in rest} for v in names}
            states = {v: [0, 0.0, 0.0] for v in names}
            for _ in range(quality.SWEEPS):
                told = {}
                for v, other in (("text", "page"), ("page", "text")):
                    told[v] = 0.0
                    for label, share in ((0, 1 - prior), (1, prior)):
                        mine = [i for i in rest if (sig(sure[other][i]) >= 1 - quality.CONFIDENT if label else sig(sure[other][i]) <= quality.CONFIDENT)]
                        if mine:
                            told[v] = told[v] + quality.PSEUDO_WEIGHT * share * sum((sig(names[v][i] @ w[v]) - label) * names[v][i] for i in mine) / len(mine)
                for v in names:
                    descend(v, quality.STEPS, told[v], 0.02, states[v])
            calibrated()
        both = lambda i: np.array([platt[v][0] * (names[v][i] @ w[v]) + platt[v][1] for v in ("text", "page")])
        mix = quality.fit_dense(np.array([both(i) for i in calib]), np.array([y[i] for i in calib]))
        out[target] = [float(sig(np.append(both(i), 1.0) @ mix)) for i in range(len(content))]
    return out


def test_co_training_equals_brute_force(spark):
    rng = random.Random(5)
    words_ = [["calm", "garden", "river", "stone", "window"], ["spam", "casino", "click", "free", "winner"], ["hate", "ugly", "stupid", "worst", "idiot"]]
    rows, labels = [], {}
    for i in range(220):
        kind = rng.choice([0, 0, 0, 1, 2])
        text = " ".join(rng.choice(words_[kind] if rng.random() < 0.6 else words_[0]) for _ in range(rng.choice([12, 30, 60]) + 40 * kind))
        rows.append((i, text, rng.choice(["en", "de"]), f"s{kind}" if rng.random() < 0.9 else "s0"))
        if i % 3:
            labels[i] = (int(kind == 1), int(kind == 2))
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([(i, 1 - a, b) for i, (a, b) in labels.items()], "doc_id long, quality int, toxic int")
    model, features = quality.train(docs, known)
    got = quality.scored(features, model).toPandas().sort_values("doc_id")
    dense = {v: np.zeros((len(rows), n + 1)) for v, n in model.sizes.items()}
    for r in features.collect():
        for v in quality.VIEWS:
            dense[v][r.doc_id, list(r[v])] = 1
            dense[v][r.doc_id, -1] = 1
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 0}
    want = brute_co_training(dense["text"], dense["page"], labels, held, lambda target, view: model.used(quality.TARGETS[target], view))
    np.testing.assert_allclose(got["__low_quality"], want[0], atol=1e-6)
    np.testing.assert_allclose(got["__toxic"], want[1], atol=1e-6)
    assert set(model.mix) == {"low_quality", "toxic"}


def test_features_are_alike_at_every_length():
    for layout in ("\tword\r\n", "a\xa0b ", "a b\n", "A1! "):
        short, long = quality.shares([(layout * 100).encode(), (layout * 10_000).encode()])
        assert short == pytest.approx(long)


def test_the_page_view_does_not_read_the_words():
    assert quality.metadata_features("good calm text\nx", "en", "s") == quality.metadata_features("hate hate hate\nx", "en", "s")


def test_quality_odd_inputs(spark, odd, empty):
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 1), (5, None, 0), (999, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.kept(empty, labels).count() == 0
    assert quality.kept(odd, labels.limit(0)).count() == 9
    assert quality.kept(odd, labels).columns == odd.columns
    assert quality.kept(odd.drop("lang", "source"), labels.limit(0)).columns == [c for c in odd.columns if c not in ("lang", "source")]


# --- 8: licences -----------------------------------------------------------------------------------------------------

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def brute_licences(text):
    ws, places, labels = ALNUM.findall(low(text)), [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        for k in range(len(ws) - len(p) + 1):
            if ws[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences_equal_brute_force(spark, table):
    got = registry.QUERIES["op8_licences"](spark, SF).collect()
    by_id = {r.doc_id: r for r in got}
    for i, t in zip(table.doc_id, table.text):
        r = by_id[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licences(t)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels


def test_licences_in_crafted_texts(spark, odd, empty):
    texts = ["UNDER THE MIT LICENSE under the mit license", "cc-by-nc cc", "nc", "cc by", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files", "mit", "apache license version 2"]
    df = prepared(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(f.label, f.first_word) for f in r.finds] for r in licences.scanned(df).collect()}
    assert found == {0: [("mit", 0), ("mit", 4)], 1: [("cc-by-nc", 0)], 2: [], 3: [], 4: [("mit", 0)], 5: [], 6: [("apache-2", 0)]}
    assert licences.scanned(empty).count() == 0
    found = sorted((str(r.doc_id), r.n_words, len(r.finds)) for r in licences.scanned(odd).collect())
    assert found == sorted((str(r.doc_id), len(ALNUM.findall(low(r.text))), 0) for r in odd.collect())


def test_whole_licence_texts_are_found_at_their_places(spark):
    rng = random.Random(3)
    from brindle.llm.licence_texts import PARAGRAPHS

    rows, want = [], {}
    for i, (label, text, _) in enumerate(PARAGRAPHS):
        before = [f"w{rng.getrandbits(30)}" for _ in range(i)]
        rows.append((i, " ".join(before) + " " + text.upper() + " tail words"))
        want[i] = (label, i)
        ws = text.split()
        rows.append((100 + i, " ".join(ws[: len(ws) // 4])))  # a piece of it is none
    finds = {r.doc_id: [(f.label, f.first_word, f.template) for f in r.finds] for r in licences.scanned(prepared(spark).createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((*want[i], i) in finds[i] for i in want)
    assert all(i not in {f[2] for f in finds[100 + i]} for i in want if len(PARAGRAPHS[i][1].split()) > 12)


def test_rare_words_must_agree_on_where_the_text_begins():
    index = licences.Index([("x", "alpha beta gamma delta", ("alpha",))] * 3 + [("y", "one two three four five six", ("two",))])
    raw = [b"one two three four five six", b"six five four three two one", b"one zz three zz five six two"]
    found = words.split(raw, words.ALNUM)
    got = {t: list(zip(starts.tolist(), owners.tolist())) for t, starts, owners in index.candidates(found.hashes(), found.doc())}
    assert (0, 0) in got[3] and not any(owner == 1 for _, owner in got[3])


# --- 9: decontamination ----------------------------------------------------------------------------------------------


def brute_hits(text, windows):
    ws = ALNUM.findall(low(text))
    hit, items = np.zeros(len(ws), dtype=bool), set()
    for n in {len(w) for w in windows}:
        for k in range(len(ws) - n + 1):
            if (found := windows.get(tuple(ws[k : k + n]))) is not None:
                items |= found
                hit[k : k + n] = True
    return len(ws), int(hit.sum()), sorted(map(str, items))


def windows_of(items):
    windows = defaultdict(set)
    for i, t in ((("" if i is None else i), t) for i, t in items):
        ws = ALNUM.findall(low(t))
        for k in range(max(1, len(ws) - 12) if ws else 0):
            windows[tuple(ws[k : k + 13])].add(i)
    return windows


def test_decontamination_equals_brute_force(spark, table):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    windows = windows_of(zip(items.item_id, items.text))
    by_id = {r.doc_id: r for r in registry.QUERIES["op9_decontamination"](spark, SF).collect()}
    for i, t in zip(table.doc_id, table.text):
        n, hit, found = brute_hits(t, windows)
        r = by_id[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0 and 20 * hit >= n)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_short_items_blocks_and_odd_inputs(spark, odd, empty, monkeypatch):
    items = [(1, "One"), (None, "here no id"), (2, "w1 w2 w3 W4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (3, None), (4, "..."), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (5, "no id")]
    bench = prepared(spark).createDataFrame(items, "item_id long, text string")
    windows = windows_of(items)
    want = sorted(brute_hits(r.text, windows) for r in odd.collect())
    for size in (suffix.BLOCK_BYTES, 20):
        monkeypatch.setattr(suffix, "BLOCK_BYTES", size)
        got = [(r["__n_words"], r["__n_hit"], sorted({str(m.item_id) for m in r["__matches"]})) for r in suffix.matches(odd, bench).collect()]
        assert sorted(got) == want
    assert suffix.matches(empty, bench).count() == 0
    assert suffix.matches(odd, bench.limit(0)).where("__n_hit > 0").count() == 0
    left = suffix.decontaminated(odd, bench)
    assert left.columns == odd.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(r.doc_id) for r in odd.collect() if not (lambda n, hit, _: hit and 20 * hit >= n)(*brute_hits(r.text, windows)))


def test_text_item_ids_and_repeated_items(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = prepared(spark).createDataFrame([("a", f"x {item} y"), ("b", "nothing"), ("a", f"x {item} y")], "doc_id string, text string")
    bench = spark.createDataFrame([("q/10", item), ("q/9", item), ("q/9", item), (None, "nothing")], "item_id string, text string")
    got = sorted((r.doc_id, r["__n_words"], r["__n_hit"], sorted({m.item_id for m in r["__matches"]})) for r in suffix.matches(docs, bench).collect())
    assert got == [("a", 22, 20, ["q/10", "q/9"])] * 2 + [("b", 1, 1, [""])]


def test_shards_are_cut_between_texts(spark, table, monkeypatch):
    docs = prepared(spark).read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda: sorted((r.doc_id, r["__n_words"], r["__n_hit"], sorted(map(tuple, r["__matches"]))) for r in suffix.matches(docs, bench).collect())
    want = rows()
    monkeypatch.setattr(suffix, "SHARD_BYTES", 30_000)
    assert rows() == want


def test_suffix_array_is_sorted_and_finds_all():
    rng = np.random.default_rng(2)
    sequence = rng.integers(1, 5, 400).astype(np.uint64)  # 0 is the gap between texts
    shard = suffix.Shard(sequence, 16)
    as_text = [tuple(sequence[i : i + 16].tolist()) + (0,) * max(0, i + 16 - 400) for i in shard.order]
    assert all(a <= b for a, b in zip(as_text, as_text[1:]))
    for n in (1, 2, 3, 7):
        queries = np.array([sequence[i : i + n].tolist() + [0] * (13 - n) for i in range(50)], dtype=np.uint64)
        low_, high = shard.find(queries, np.full(50, n))
        for q, lo, hi in zip(queries, low_, high):
            assert sorted(shard.order[lo:hi].tolist()) == [i for i in range(400 - n + 1) if (sequence[i : i + n] == q[:n]).all()]


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline
    from brindle.llm.shared import documents, written

    docs, seen = documents(spark, SF), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        seen[name] = (before.toPandas(), docs.toPandas())
        if name != "bpe_encoding":
            assert docs.columns == columns
    before, after = seen["line_dedup"]
    assert sorted(before.doc_id) == sorted(after.doc_id) and (after.n_chars == after.text.str.len()).all()
    before, after = seen["decontamination"]
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    windows = windows_of(zip(items.item_id, items.text))
    clean = {i for i, t in zip(before.doc_id, before.text) for n, hit, _ in [brute_hits(t, windows)] if not (hit and 20 * hit >= n)}
    assert set(after.doc_id) == clean
    before, after = seen["bpe_encoding"]
    tokenizer = bpe.compiled(bpe.tokenizer_file())
    assert {r.doc_id: list(r.ids) for r in after.itertuples()} == {r.doc_id: tokenizer.encode(r.text) for r in before.itertuples()}
