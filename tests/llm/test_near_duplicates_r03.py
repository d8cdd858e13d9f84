"""Near-duplicates by SimHash first, and keys that do not meet by chance (findings of round 3)."""

import random


def _prints(spark, n, seed):
    rng = random.Random(seed)
    values = {rng.getrandbits(64) - (1 << 63) for _ in range(n)}
    for v in list(values)[: n // 4]:  # chains within and just beyond the distance
        for _ in range(3):
            for bit in rng.sample(range(63), rng.choice((2, 4, 5))):
                v ^= 1 << bit
            values.add(v)
    return sorted(values)


def test_near_dedup_ties_near_copies_by_simhash_first(spark, monkeypatch):
    """What SimHash finds is checked exactly and not looked for again by the exact filter; what it misses is."""
    from brindle.llm import simhash
    from brindle.llm.shared import prepared

    base = [f"word{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:399], "other"]), " ".join([*base[:350], *(f"new{i}" for i in range(43)), *base[393:]]), "quite another text of a few words"]
    docs = prepared(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, similar = [], simhash._similar

    def spying(pairs, *more):
        asked.append({tuple(x) for x in pairs.collect()})
        return similar(pairs, *more)

    monkeypatch.setattr(simhash, "_similar", spying)
    left = {r.doc_id for r in simhash.deduplicated(docs, 5, 0.8).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    alike = {(i, j) for i in range(4) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert left == set(range(4)) - {i for i, _ in alike}
    assert len(asked) == 3 and asked[0] and not any(asked[0] & later for later in asked[1:])


def test_simhash_rows_that_meet_do_not_grow_with_the_square(spark):
    """So many fingerprints would meet in segments of 21 bits by chance; in unions they hardly do, and all links are found."""
    from brindle.llm import simhash

    assert isinstance(simhash.growing_search(245_000), simhash.Unions) and not isinstance(simhash.growing_search(100), simhash.Unions)
    prints = _prints(spark, 3000, 5)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(prints)], "node long, f0 long")
    tied = {r.node: r.root for r in simhash.linked(df, simhash.Unions()).collect()}
    want = {r.node: r.root for r in simhash.linked(df, simhash.Scheme()).collect()}
    assert tied == want and want
    lone = spark.range(60_000).selectExpr("id as node", "xxhash64(id) as f0")
    assert simhash.met_rows(lone, simhash.Unions()).count() < 1000
