"""State between polls, walks, folds by rounds and sinks: restarts, gaps, repeats, chunks, odd rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import matching, ordered, profiles, state, walks
from brindle.plans import cycle
from brindle.sources import traces
from brindle.sources import walks as sources
from brindle.streaming.stateful import run_to_end


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


# --- the cycle's tables ------------------------------------------------------------------------------------------------


def test_commits_have_gaps_and_unfinished_parts_do_not_count(spark, tmp_path):
    kept = cycle.CycleState(spark, f"file://{tmp_path}/state", every=3)
    seen = lambda *ids: spark.createDataFrame([(i, "olx", str(i)) for i in ids], "pos bigint, source string, source_id string")
    sources_ = lambda at: spark.createDataFrame([("olx", at, at)], "source string, established_at timestamp_ntz, complete_at timestamp_ntz")
    first, second = datetime(2024, 1, 1), datetime(2024, 1, 2)
    none = {n: spark.createDataFrame([], s) for n, s in cycle.SCHEMAS.items()}
    assert kept.version == 0 and kept.read("seen").count() == 0
    kept.commit(1, none | {"seen": seen(1, 2), "sources": sources_(first)})
    kept.commit(3, none | {"seen": seen(3), "sources": sources_(second)})
    assert kept.version == 3 and sorted(r.pos for r in kept.read("seen").collect()) == [1, 2, 3]
    seen(9).withColumn("poll", F.lit(4)).write.parquet(f"file://{tmp_path}/state/seen/p4")  # a poll that broke off
    assert sorted(r.pos for r in kept.read("seen").collect()) == [1, 2, 3]
    assert kept.current("sources").first().complete_at == second
    kept.commit(4, none | {"seen": seen(5)})  # the third part: all are folded into a snapshot
    again = cycle.CycleState(spark, f"file://{tmp_path}/state", every=3)
    assert again.version == 4 and sorted(r.pos for r in again.read("seen").collect()) == [1, 2, 3, 5]
    assert again._numbers("commits") == [] and again._numbers("snapshots") == [4]
    assert again.current("sources").first().complete_at == second
    again.commit(7, none | {"seen": seen(6)})
    assert sorted(r.pos for r in again.read("seen").collect()) == [1, 2, 3, 5, 6] and again.version == 7


def test_a_poll_that_is_run_again_changes_nothing(spark, tmp_path):
    kept = cycle.CycleState(spark, f"file://{tmp_path}/state")
    columns = "pos bigint, source string, source_id string, url string, published_at timestamp_ntz, refreshed_at timestamp_ntz, accepted boolean, seller_type string, level string, needs_check boolean"
    row = lambda i, source, day, check=False: (i, source, str(i), f"https://{source}.example/{i}", datetime(2024, 1, day), None, True, "unknown", "private_unknown", check)
    rules = cycle.Rules(hold="interval 2 days", checks=2)
    replies = lambda *rows: spark.createDataFrame(list(rows), "pos bigint, cached boolean, `check` string, send string")
    batch = lambda *rows: spark.createDataFrame(list(rows), columns)
    outcomes = lambda n: {r.pos: r.outcome for r in kept.read("decisions").where(f"poll = {n}").collect()}
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    cycle.poll(kept, cycle.Poll(1, day(2)), batch(row(1, "olx", 1)), replies(), rules)
    second = [row(1, "olx", 1), row(2, "olx", 3), row(3, "olx", 1), row(4, "olx", 3, True), row(5, "olx", 3, True), row(6, "olx", 3, True), row(7, "olx", 3)]
    said = replies((2, False, None, "error"), (4, False, "unresolved", "ok"), (5, False, "reject", "ok"), (6, False, "allow", "ok"), (7, False, None, "ok"))
    for _ in range(2):
        cycle.poll(kept, cycle.Poll(3, day(4)), batch(*second), said, rules)
    # the third lookup is beyond the bound; a null publication date never came up
    assert outcomes(1) == {1: "baseline"}
    assert outcomes(3) == {1: "seen", 2: "delivery_failed", 3: "late_discovered", 4: "held", 5: "rejected_seller", 6: "held", 7: "delivered"}
    cycle.poll(kept, cycle.Poll(4, day(5), degraded=["olx"]), batch(*second), replies((2, False, None, "ok"), (4, False, "unresolved", None), (6, False, "allow", "ok")), rules)
    got = kept.read("decisions").where("poll = 4 and outcome not in ('seen', 'held')").collect()
    assert {r.pos: r.outcome for r in got} == {2: "retried", 4: "hold_kept", 6: "delivered"}
    assert kept.current("sources").first().complete_at == datetime(2024, 1, 4)  # a poll in part does not move it
    cycle.poll(kept, cycle.Poll(5, day(7)), batch(row(8, "olx", 5)), replies((8, False, None, "ok")), rules)
    assert outcomes(5) == {4: "hold_expired", 8: "delivered"}


def test_the_first_come_of_rows_that_share_keys(spark):
    r = random.Random(8)
    for n in (0, 1, 60):
        rows = [(p, f"k{r.randrange(40)}") for p in range(n) for _ in range(r.randint(1, 3))]
        taken, kept = set(), []
        for p in range(n):
            own = {k for q, k in rows if q == p}
            if not own & taken:
                kept.append(p)
                taken |= own
        assert [x[0] for x in rows_of(matching.first_come(spark.createDataFrame(rows, "pos bigint, key string")))] == kept
    chain = [(p, f"k{p + d}") for p in range(9) for d in (0, 1)]  # every row decides the next
    assert [x[0] for x in rows_of(matching.first_come(spark.createDataFrame(chain, "pos bigint, key string")))] == [0, 2, 4, 6, 8]


def test_ties_to_rejected_listings_equal_all_pairs(spark):
    r = random.Random(2)
    keys = {(f"s{r.randrange(2)}", str(r.randrange(12)), r.choice(["url:a", "url:b", "olx:token:1", "lun:group:1", "rieltor:id:2"])): r.choice(matching.CLASSES) for _ in range(60)}
    rows = [(*k, c) for k, c in keys.items()]
    bad = {(s, i) for s, i, _, _ in rows if int(i) % 3 == 0}
    want = {(s, i) for s, i, k, c in rows for t, j, l, d in rows if k == l and (s, i) != (t, j) and (t, j) in bad and "explicit_external" in (c, d) and not k.startswith("lun:")}
    got = matching.tied_to(spark.createDataFrame(rows, "source string, source_id string, key string, key_class string"), spark.createDataFrame(sorted(bad), "source string, source_id string"))
    assert set(rows_of(got)) == want


# --- upserts, recent values, clean-ups ---------------------------------------------------------------------------------

SEEN = "pos bigint, id string, url string, fingerprint string, published timestamp_ntz, first_seen timestamp_ntz, last_seen timestamp_ntz"


def test_clashing_rows_become_one_in_any_number_of_batches(spark):
    r = random.Random(6)
    at = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    rows = [(p, f"i{r.randrange(25)}", r.choice([None, f"u{r.randrange(25)}"]), f"f{p}", r.choice([None, at(p)]), at(p), at(p)) for p in range(30)]
    df = spark.createDataFrame(rows, SEEN)
    none = df.limit(0).withColumn("aliases", F.array().cast("array<string>"))
    fold = lambda now, batch: state.merged_unique(now, batch, ["id", "url", "fingerprint"], ["published"], ["first_seen"], ["last_seen"]).checkpoint()
    once = fold(none, df)
    parts = none
    for i in (0, 1, 2, 1):
        parts = fold(parts, df.where(f"pos % 3 = {i}"))
    keys = ["pos", "id", "url", "fingerprint", "first_seen", "last_seen", "aliases"]
    text = lambda x: sorted(map(repr, x.select(*keys).collect()))
    assert text(once) == text(parts) == text(fold(parts, df))
    assert fold(none, df.limit(0)).count() == 0


def test_recent_values_over_two_polls(spark):
    columns = "seller bigint, address string, at bigint"
    rows = [(1, "a", 1), (1, "b", 2), (1, "a", 5), (1, None, 6), (2, "z", 1), (2, "z", 1)]
    df, none = spark.createDataFrame(rows, columns), spark.createDataFrame([], columns)
    one = state.recent_distinct(none, df, "seller", "address", "at", 8)
    two = state.recent_distinct(state.recent_distinct(none, df.where("at < 3"), "seller", "address", "at", 8), df.where("at >= 3"), "seller", "address", "at", 8)
    assert rows_of(one) == rows_of(two) == [(1, "a", 1), (1, "b", 2), (2, "z", 1)]
    many = spark.createDataFrame([(1, f"v{i:02d}", i) for i in range(20)], columns)
    assert [x[1] for x in rows_of(state.recent_distinct(none, many, "seller", "address", "at", 8))] == [f"v{i}" for i in range(12, 20)]


def test_profiles_of_sellers_and_of_none(spark):
    columns = "pos bigint, source string, seller string, owner boolean, readable boolean, year int, created timestamp_ntz, likely boolean"
    rows = [
        (1, "olx", "a", True, True, 2026, None, False),
        (2, "olx", "a", False, True, None, None, False),
        (3, "olx", "b", False, False, None, None, None),
        (4, "olx", "c", False, True, None, datetime(2024, 1, 3), True),
        (5, "olx", None, False, True, None, None, True),
        (6, "olx", None, True, True, None, None, True),
        (7, "olx", "d", False, True, None, datetime(2023, 1, 1), True),
    ]
    now = F.lit("2024-01-05").cast("timestamp_ntz")
    found = profiles.profile_gate(spark.createDataFrame(rows, columns), now, F.lit("reject"), F.lit("keep"))
    assert rows_of(found.select("pos", "verdict", "kept")) == [
        (1, "seller_registration_year_2026", True), (2, "seller_registration_year_2026", False), (3, "unknown", True), (4, "profile_high_risk", True),
        (5, "profile_likely_intermediary", False), (6, "confirmed_owner", True), (7, "profile_likely_intermediary", False),
    ]


# --- walks ---------------------------------------------------------------------------------------------------------------


def test_running_values_over_chunks_equal_a_loop(spark):
    r = random.Random(4)
    rows = [(g, p, r.choice([None, r.randrange(9)])) for g in "ab" for p in range(1, 40)]
    found = walks.running(spark.createDataFrame(rows, "g string, p int, v int"), "g", "p", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, chunk=7)
    for g, p, _, s, m in found.select("g", "p", "v", "s", "m").collect():
        upto = [v for h, q, v in rows if h == g and q <= p and v is not None]
        assert s == sum(upto) and m == max(upto, default=None)


PAGES = "walk int, page int, elapsed_ms int, error string, status int, parsed boolean, shown int, declared int, declared_pages int, rejects int"


def test_ends_of_walks(spark):
    good = lambda w, p, **x: tuple({"walk": w, "page": p, "elapsed_ms": p, "error": None, "status": 200, "parsed": True, "shown": p, "declared": None, "declared_pages": None, "rejects": 0}[k] if k not in x else x[k] for k in PAGES.replace(",", "").split()[::2])
    pages = [good(1, 1, error="timeout"), good(2, 1), good(2, 2, status=500), good(3, 1), good(3, 2), good(4, 1, declared=2), good(5, 1, declared=9), good(5, 2), good(6, 1), good(7, 1, declared_pages=2), good(7, 2, declared_pages=3), good(8, 1), good(8, 2, shown=1)]
    items = [(2, 1, 1), (3, 1, 1), (3, 1, 2), (3, 2, 2), (3, 2, 1), (4, 1, 1), (4, 1, 2), (5, 1, 1), (7, 1, 1), (7, 2, 2), (8, 1, 1), (8, 2, 9)]
    found = walks.page_walks(spark.createDataFrame(pages, PAGES), spark.createDataFrame(items, "walk int, page int, id int"), 1000, 50, 100)
    got = {r.walk: (r.pages, r.n_ids, r.whole, r.reasons, r.first_page_failed) for r in found.collect()}
    assert got == {
        1: (0, 0, False, "", True), 2: (1, 1, False, "http_error", False), 3: (1, 2, False, "repeated_page", False), 4: (1, 2, True, "", False), 5: (2, 1, False, "premature_empty", False),
        6: (1, 0, True, "", False), 7: (1, 1, False, "total_pages_changed", False), 8: (1, 1, False, "page_mismatch", False),
    }


def test_a_gap_is_closed_before_the_watermark_moves():
    old, overlap = {"watermark": "2024-01-01T00:00:00", "target": "", "resume": 1}, timedelta(minutes=30)
    assert sources.planned({"watermark": "", "target": "", "resume": 1}, 3) == [1]
    assert sources.planned(old, 3) == [1, 2, 3]
    behind, read = sources.walked(old, [(p, True, f"2024-01-09T0{5 - p}:00:00", f"2024-01-08T0{5 - p}:00:00") for p in (1, 2, 3)], overlap)
    assert read == [1, 2, 3] and behind == {"watermark": old["watermark"], "target": "2024-01-09T04:00:00", "resume": 4}
    assert sources.planned(behind, 3) == [1, 3, 4]
    broken, read = sources.walked(behind, [(1, True, "2024-01-10T00:00:00", "2024-01-09T00:00:00"), (3, False, "", ""), (4, True, "x", "y")], overlap)
    assert read == [1] and broken["resume"] == 3 and broken["watermark"] == old["watermark"]
    closed, _ = sources.walked(broken, [(1, True, "2024-01-10T00:00:00", "2024-01-09T00:00:00"), (2, True, "2024-01-02T00:00:00", "2023-12-31T23:00:00")], overlap)
    assert closed == {"watermark": "2024-01-09T04:00:00", "target": "", "resume": 1}
    nothing, read = sources.walked(old, [(1, False, "", "")], overlap)
    assert nothing == old and read == []


def test_a_walk_goes_on_from_its_checkpoint(spark, tmp_path):
    pages = []
    for cycle_ in (1, 2, 3):
        top = 10 * cycle_
        for page in range(1, 6):
            pages += [(cycle_, "flats", page, 200, i, top - 2 * (page - 1) - i, datetime(2024, 1, 1) + timedelta(days=top - 2 * (page - 1) - i)) for i in (0, 1)]
    df = spark.createDataFrame(pages, sources.PAGES)
    spark.dataSource.register(sources.PageWalk)
    path = f"file://{tmp_path}"

    def polled(part):
        df.where(part).write.mode("append").partitionBy("cycle").parquet(f"{path}/pages")
        return run_to_end(spark.readStream.format("page_walk").option("path", f"{path}/pages").load(), path)

    assert {(r.cycle, r.page) for r in polled("cycle = 1").collect()} == {(1, 1)}
    assert {(r.cycle, r.page) for r in polled("cycle = 2").collect()} == {(1, 1), (2, 1), (2, 2), (2, 3)}
    found = polled("cycle = 3")
    assert {(r.cycle, r.page) for r in found.where("cycle = 3").collect()} == {(3, 1), (3, 3), (3, 4)}
    assert found.count() == found.distinct().count()


# --- traces --------------------------------------------------------------------------------------------------------------


def test_trace_selection_below_the_cap_and_with_duplicates(spark):
    columns = "pos bigint, source string, id string, first boolean"
    few = spark.createDataFrame([(1, "a", "x", True), (2, "a", "x", True)], columns)
    pick = lambda df, cap: [r.pos for r in ordered.consuming_round_robin(df, "first", "source", "pos", ["source", "id"], cap).orderBy("rank").collect()]
    assert pick(few, 2) == [1, 2]
    rows = [(1, "a", "x", True), (2, "a", "x", True), (3, "a", "y", True), (4, "b", "z", False), (5, "b", "z", False), (6, "b", "w", False), (7, "a", "q", False)]
    # the second pass has only a duplicate, which ends the first phase; the rest come in the second one, whose pass 2 is a duplicate and a fresh row
    assert pick(spark.createDataFrame(rows, columns), 6) == [1, 3, 4, 7, 6]
    assert pick(spark.createDataFrame(rows, columns), 3) == [1, 3, 4]


def test_traces_append_once_and_aborted_files_go(spark, tmp_path):
    schema = spark.createDataFrame([], "id bigint, at timestamp_ntz").schema
    path = f"file://{tmp_path}/traces"
    one = spark.createDataFrame([(1, datetime(2024, 1, 1)), (None, None)], schema).collect()
    writer = traces.TraceWriter(path, schema)
    writer.commit([writer.write(iter(one)), writer.write(iter([])), None], 0)
    writer.commit([writer.write(iter(one))], 0)  # the batch again
    writer.abort([writer.write(iter(one)), None], 1)
    assert sorted(map(repr, traces.appended(spark, path, schema).collect())) == sorted(map(repr, one))
    assert len(list((tmp_path / "traces/parts").iterdir())) == 1
