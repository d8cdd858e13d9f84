"""Rules and folds on small inputs: order, nulls, ties, repeated batches, streams."""

import json
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import geo, sellers, texts, urls
from brindle.operators import decisions, freshness, graphs, matching, ordered, state
from brindle.sources import pages, sites
from brindle.streaming import stateful


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("lat", "lng", "reason"),
    [(None, None, "missing"), ("", None, "missing"), ("49.8", None, "malformed"), ("x", "24", "malformed"), ("0", "0", "zero"), ("49,8", "24,0", "ok"), ("24.0", "49.8", "ok"), ("10", "10", "out-of-range")],
)
def test_coordinates(spark, lat, lng, reason):
    found = one(spark, geo.validated(F.lit(lat).cast("string"), F.lit(lng).cast("string")))
    assert found["reason"] == reason
    assert found["swapped"] == (lat == "24.0")


def test_antipodes_have_a_distance(spark):
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(6371 * 3.141592653589793)


@pytest.mark.parametrize(
    ("url", "canonical"),
    [("HTTPS://WWW.A.ua:443/B/?q#h", "https://a.ua/b"), ("https://a.ua", "https://a.ua"), (" No URL ", "no url"), ("http://a.ua//x///", "http://a.ua//x")],
)
def test_canonical_url(spark, url, canonical):
    assert one(spark, urls.canonical(F.lit(url))) == canonical


def test_amounts(spark):
    shown = [one(spark, texts.grouped_amount(F.lit(float(x)))) for x in (0, 999, 1234567.5, -1000.05, 12.3)]
    assert shown == ["0", "999", "1 234 567,5", "-1 000,05", "12,3"]


def test_negated_phrases_are_not_evidence(spark):
    level = lambda t: one(spark, sellers.text_signals(F.lit(t)))["level"]
    assert level("Ми не є агентство нерухомості") == "unknown"
    assert level("агентство нерухомості") == "confirmed"
    assert level(None) == "unknown"


def test_freshness_rules_in_order(spark):
    at = lambda s: F.expr(f"cast('{s}' as timestamp_ntz)") if s else F.lit(None).cast("timestamp_ntz")
    kind = lambda p, r=None: one(spark, freshness.freshness(at(p), at(r), at("2024-01-31"), at("2024-01-20"), F.expr("interval 20 days"), F.expr("interval 12 days")))
    assert kind(None) == "first_noticed"
    assert kind("2024-01-01", "2024-01-11") == "refreshed_old"
    assert kind("2024-01-01") == "old_publication"
    assert kind("2024-01-19") == "new_publication"
    assert kind("2024-01-18") == "late_discovered"
    assert kind("2024-02-10") == "new_publication"


def test_keepers_are_greedy_in_order(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/cp")
    keys = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c")], "pos long, key string")
    kept = {r["pos"] for r in matching.keepers(keys, graphs.key_components(keys)).where("kept").collect()}
    assert kept == {1, 3, 4}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20)), min_size=1, max_size=20))
def test_keep_first_is_idempotent(spark, values):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(values)], "k int, v int, i int")
    once = ordered.keep_first(df, ["k"], ["v", "i"])
    assert sorted(once.collect()) == sorted(ordered.keep_first(once, ["k"], ["v", "i"]).collect())
    assert {(r["k"], r["v"]) for r in once.collect()} == {(k, min(v for x, v in values if x == k)) for k, _ in values}


def test_merge_applied_twice_is_merge_applied_once(spark):
    old = spark.createDataFrame([(1, "a", 5, 5), (2, "b", 3, 3)], "k int, v string, lo int, hi int")
    batch = spark.createDataFrame([(1, None, 2, 9, 1), (1, "c", 7, 7, 2), (3, None, 1, 1, 3)], "k int, v string, lo int, hi int, at int")
    fold = lambda s: state.merged(s, batch, ["k"], ["v"], ["lo"], ["hi"], ["at"])
    assert sorted(map(tuple, fold(old).collect())) == sorted(map(tuple, fold(fold(old)).collect())) == [(1, "c", 2, 9), (2, "b", 3, 3), (3, None, 1, 1)]


def test_longest_streaks_leave_out_sources_without_failures(spark):
    df = spark.createDataFrame([("a", 0, 1, False), ("a", 0, 2, True), ("a", 1, 3, True), ("b", 0, 1, False)], "s string, c int, t int, bad boolean")
    assert [tuple(r) for r in ordered.longest_streaks(df, "s", "c", ["t"], F.col("bad")).collect()] == [("a", 2)]


def test_streaks_over_chunks_equal_a_plain_fold(spark):
    rng = random.Random(2)
    rows = [(s, t // rng.choice([1, 7, 30]) if s % 2 else t // 10, t, rng.random() < 0.6 + 0.1 * (s % 4)) for s in range(8) for t in range(120)]
    rows = [(s, max(r[1] for r in rows if r[0] == s and r[2] <= t), t, bad) for s, _, t, bad in rows]
    want = {}
    for s in range(8):
        run = longest = opened = recovered = 0
        for *_, bad in sorted(r for r in rows if r[0] == s):
            if bad:
                run += 1
                opened += run == 3
            else:
                recovered += run >= 3
                run = 0
            longest = max(longest, run)
        want[s] = (longest, opened, recovered, run)
    found = ordered.streaks(spark.createDataFrame(rows, "s int, c int, t int, bad boolean"), "s", "c", ["t"], F.col("bad"))
    assert {r.s: (r.longest_streak, r.opened, r.recovered, r.open_streak) for r in found.collect()} == want


def test_key_components_of_a_long_chain(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/cp")
    keys = spark.createDataFrame([(i, f"k{i + d}") for i in range(1000) for d in (0, 1)] + [(5000, "alone")], "pos long, key string")
    found = {r["pos"]: r["component"] for r in graphs.key_components(keys).collect()}
    assert found == {i: 0 for i in range(1000)} | {5000: 5000}


def test_text_evidence_is_evaluated_once(spark):
    plan = spark.createDataFrame([("x",)], "text string").select(sellers.text_signals(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 100 and len(plan) < 60_000


def test_text_signals_of_mixed_texts(spark):
    rows = [("Комісія 50%, є інші варіанти", "likely", ["inventory", "transaction"]), ("Я рієлтор, комісія", "confirmed", []), ("Без комісії. Покази щодня", "unknown", ["transaction"]), (None, "unknown", [])]
    found = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select("i", sellers.text_signals(F.col("t")).alias("s")).collect()
    assert [(r.s.level, sorted(r.s.families)) for r in sorted(found)] == [r[1:] for r in rows]


def test_cursors_that_are_none(spark):
    bad = ['{"target":"x","resumePage":2}', '{"target":"2024-01-01T00:00:00Z","resumePage":0}', '{"target":"2024-01-01T00:00:00Z","resumePage":1.5}', "{", "", None, "[]"]
    df = spark.createDataFrame([(b,) for b in [*bad, '{"target":"2024-01-01T00:00:00.000Z","resumePage":3}']], "c string")
    found = df.select(decisions.cursor(F.col("c")).alias("x")).collect()
    assert [r.x is None for r in found] == [True] * len(bad) + [False] and found[-1].x.resume_page == 3


def test_clips_end_between_characters(spark):
    texts_ = ["", "abc", "їїї", "a😀b", "aїb" * 5, None]
    for most in (1, 2, 3, 4, 5, 9):
        got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "i int, t string").orderBy("i").select(pages.clipped(F.col("t"), most).alias("c")).collect()]
        assert got == [None if t is None else t.encode()[:most].decode(errors="ignore") for t in texts_]


def test_sources_are_chosen_by_their_settings():
    assert sites.enabled_sources({"olx": True, "olx_browser": True, "lun": True}) == [("lun", "http"), ("olx", "browser")]
    assert sites.enabled_sources({"olx": True}) == [("olx", "http")] and sites.enabled_sources({}) == []


def test_shops_and_profiles(spark):
    html = ['<a data-testid="seller-link" href="https://m.olx.ua/x"> https://Dom1.olx.ua/home/', '<a href="https://a-b.olx.ua/q" data-testid="user-profile-link">', "https://www.olx.ua/home/", "/uk/list/user/Ab1"]
    found = spark.createDataFrame([(h,) for h in html], "h string").select(sites.shop_url(F.col("h")).alias("s"), sites.profile_path(F.col("h")).alias("p")).collect()
    assert [tuple(r) for r in found] == [("https://dom1.olx.ua/uk/home/", None), ("https://a-b.olx.ua/uk/home/", None), (None, None), (None, "/uk/list/user/Ab1/")]


def test_state_blobs():
    assert pages.state_blob('x S = {"a": "}"} y', "S") == '{"a": "}"}'
    assert pages.state_blob('S = {"a": "}"}', "S", strings=False) == '{"a": "}'
    assert pages.state_blob('S = "{\\"a\\":1}";', "S") == '"{\\"a\\":1}"'
    assert pages.state_blob('S = {"a": ', "S") is None
    assert pages.state_blob(None, "S") is None


def test_deep_walk_survives_bad_json(spark):
    deep = json.dumps({"x": [{"id": 1, "title": "a", "y": {"id": 2, "title": "b"}}]})
    df = spark.createDataFrame([(deep,), ("{",), (None,)], "raw string")
    found = df.lateralJoin(pages.OfferLike(F.col("raw").outer(), F.lit(10))).select("id", "title", "depth")
    assert sorted(map(tuple, found.collect())) == [("1", "a", 2), ("2", "b", 3)]


def test_streaming_streaks_equal_the_batch_fold(spark, tmp_path):
    rows = [(s, i, (i * 7 + s) % 3 != 0) for s in range(3) for i in range(12)]
    for part in (0, 6):
        chunk = [r for r in rows if part <= r[1] < part + 6]
        spark.createDataFrame(chunk, "source long, at long, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source long, at long, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got: dict = {}
    query = stateful.health_streaks(stream, "source").writeStream.outputMode("update").foreachBatch(lambda df, i: got.update({r["source"]: (r["streak"], r["n_attempts"]) for r in df.collect()}))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = state.health_fold(spark.createDataFrame(rows, "source long, at long, ok boolean"), "source", ["at"], F.col("ok"), F.lit(False))
    assert got == {r["source"]: (r["consecutive_failures"], r["n_attempts"]) for r in batch.collect()}


def test_state_table_ignores_a_batch_it_has_seen(spark, tmp_path):
    kept = stateful.StateTable(spark, f"file://{tmp_path}/s", "k int, v int", ["k"], ["v"], [], [], ["at"])
    batch = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "k int, v int, at int")
    kept.fold(batch, 0)
    kept.fold(batch.withColumn("v", F.lit(9)), 0)
    assert [tuple(r) for r in kept.read().collect()] == [(1, 6)]


def test_state_table_goes_on_after_a_restart(spark, tmp_path):
    opened = lambda: stateful.StateTable(spark, f"file://{tmp_path}/s", "k int, v int", ["k"], ["v"], [], [], ["at"])
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v int, at int")
    opened().fold(rows((1, 5, 1)), 0, "a")
    opened().fold(rows((2, 7, 1)), 1, "a")
    opened().fold(rows((1, 9, 1)), 1, "a")  # seen
    opened().fold(rows((3, 1, 1)), 0, "b")  # another stream
    (tmp_path / "s" / "v4" / "data").mkdir(parents=True)  # a crash before the version was done
    assert sorted(map(tuple, opened().read().collect())) == [(1, 5), (2, 7), (3, 1)]
    opened().fold(rows((4, 4, 4)), 1, "b")
    assert sorted(r["k"] for r in opened().read().collect()) == [1, 2, 3, 4]


def test_holds_by_the_clock_on_any_key_column(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "id string, verdict string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", "defer"), ("b", "defer"), ("c", "allow")])
    stream = spark.readStream.schema("id string, verdict string").parquet(str(tmp_path / "in"))
    writer = stateful.held_until(stream, "id", 20).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second")
    query = writer.format("parquet").option("path", str(tmp_path / "out")).start()
    seen = lambda: sum(p["numInputRows"] for p in query.recentProgress)
    try:  # such a query never counts as idle, so it is watched
        for rows in (3, 5):
            for _ in range(60):
                if seen() >= rows:
                    break
                query.awaitTermination(1)
            if rows == 3:
                put([("a", "defer"), ("b", "reject")])
        query.awaitTermination(2)
    finally:
        query.stop()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("b", "dropped"), ("c", "sent")]


def test_keyed_state_outlives_a_run(spark, tmp_path):
    place, schema = str(tmp_path / "in"), "key string, at long, tie long, ok boolean"
    stream = lambda: stateful.source_health(spark.readStream.schema(schema).parquet(place))
    spark.createDataFrame([("x", i, i, False) for i in range(4)], schema).write.mode("append").parquet(place)
    first = stateful.run_latest(stream(), str(tmp_path / "run"), ["key"]).first()
    spark.createDataFrame([("x", 9, 9, True), ("y", 1, 1, False)], schema).write.mode("append").parquet(place)
    second = {r["key"]: tuple(r)[1:] for r in stateful.run_latest(stream(), str(tmp_path / "run"), ["key"]).collect()}
    assert tuple(first) == ("x", 4, 4, 1, 0) and second == {"x": (0, 5, 1, 1), "y": (1, 1, 0, 0)}


def test_migrations_keep_rows_and_are_not_taken_twice(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "customer long, label string")
    new = state.migrated(old, 1, state.MIGRATIONS)
    again = state.migrated(new, 3, state.MIGRATIONS)
    assert sorted(map(tuple, again.collect())) == [(1, "a", "pending", "v1", 0), (2, None, "pending", "v1", 0)]


def test_retention_keeps_undated_rows(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": [1, 2, 3], "at": pd.to_datetime(["2024-01-01", None, "2024-02-01"])}))
    assert {r["k"] for r in state.retained(df, "at", F.lit("2024-01-15").cast("timestamp")).collect()} == {2, 3}


def test_settings_are_tolerant():
    from brindle.functions.config import Settings

    found = Settings.of({"LISTINGS_RADIUS_KM": " 900 ", "LISTINGS_KINDS": "House, boat", "LISTINGS_DRY_RUN": "YES", "LISTINGS_MAX_AGE_DAYS": "x", "LISTINGS_UNKNOWN_PLACES": "?"})
    assert (found.radius_km, found.kinds, found.dry_run, found.max_age_days, found.unknown_places) == (500, ("house",), True, 7, "exclude")


def test_captured_pages_of_several_formats(spark, tmp_path):
    from brindle.sources import readers

    rows = spark.createDataFrame([("x", 1, 1, None, 200, 'a "b"\nc'), ("x", 2, 1, None, 404, None)], readers.CAPTURE)
    rows.write.parquet(f"{tmp_path}/p")
    rows.write.json(f"{tmp_path}/j")
    rows.write.orc(f"{tmp_path}/o")
    places = {"first": (f"{tmp_path}/j", "json"), "second": (f"{tmp_path}/p", "parquet"), "third": (f"{tmp_path}/o", "orc")}
    found = readers.united(spark, places, ["second", "third", "first"])
    assert sorted((r["rank"], r["source"], r["page"], r["body"]) for r in found.where("page = 1").collect()) == [(0, "second", 1, 'a "b"\nc'), (1, "third", 1, 'a "b"\nc'), (2, "first", 1, 'a "b"\nc')]
    assert readers.united(spark, places, []).count() == 0
