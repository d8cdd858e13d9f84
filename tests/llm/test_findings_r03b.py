"""Round 3's failed checks of the corpus operators: each test failed before the step was mended."""

from pyspark.sql import functions as F

from brindle.llm import winnow
from brindle.llm.shared import prepared


def test_only_texts_with_something_to_delete_are_dealt_out(spark, monkeypatch):
    """op3: with many keys every text was shuffled and sorted, so the disk grew by a jump where the keys became too many to be sent."""
    monkeypatch.setattr(winnow, "BROADCAST_KEYS", 0)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(70)) + (" " + passage if i in (3, 7) else "")) for i in range(200)] + [(None, passage), (300, None)]
    found = winnow.deduplicated(prepared(spark).createDataFrame(rows, "doc_id long, text string"))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in text and "__perhaps" not in found.columns
    got = {r.doc_id: (r.text, bool(r["__runs"])) for r in found.collect()}
    want = {i: (t, False) for i, t in rows} | {7: (rows[7][1][: -len(passage)], True)}
    assert got == want


def test_the_filter_of_ids_lets_all_asked_through_and_few_others(spark, monkeypatch):
    docs = spark.range(0, 20_000).select(F.when(F.col("id") != 5, F.col("id")).alias("doc_id"))
    ids = spark.range(0, 20_000, 100).select(F.col("id").alias("doc_id"))
    for most in (winnow.MOST_BITS, 64):  # of a bitmap that is too small all may go through, but none is lost
        monkeypatch.setattr(winnow, "MOST_BITS", most)
        kept = [r.doc_id for r in winnow.perhaps(docs, ids).where("__perhaps").collect()]
        assert None not in kept and set(range(0, 20_000, 100)) <= set(kept)
        assert most == 64 or len(kept) < 3000


def test_words_met_first_outlive_a_full_cache(monkeypatch):
    """op10: a full cache was emptied, so frequent words were encoded again and again."""
    from brindle.llm import bpe

    tokenizer = bpe.Tokenizer(bpe.tokenizer_file())
    fresh = bpe.Tokenizer(bpe.tokenizer_file())
    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    words = [f" qz{k}xw" for k in range(200)]
    assert tokenizer.counts([*words, *tokenizer.special]) == [*(len(fresh.automaton.encode(w.encode())) for w in words), *(1 for _ in tokenizer.special)]
    assert words[0] in tokenizer._words and len(tokenizer._words) <= 40 + len(tokenizer.special)


def test_a_path_is_given_up_where_it_is_dead():
    """op10: every prefix was ended, also those that the word's only path does not touch; the path is the library's."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer as Library

    from brindle.llm import bpe

    known, ours, rng = Library.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.compiled(bpe.tokenizer_file()), random.Random(7)
    made = ["".join(rng.choices("aeth nrsßñ0é\n'", k=rng.randint(1, 60))) for _ in range(3000)] + ["a" * k for k in range(1, 200)]
    assert [ours.encode(t) for t in made] == [known.encode(t, add_special_tokens=False).ids for t in made]
