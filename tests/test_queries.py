import time
from datetime import timedelta

import pytest
from event_rows import event, events, rows_of, utc

from eventledger.operators import filters, metrics, paging, patterns
from eventledger.operators.numbering import number_rows, totals_before
from eventledger.operators.uniqueness import duplicate_rejects, unique_by_id

NOW = utc(2024, 5, 1, 0, 30)


def ids(df):
    return [row.id for row in df.collect()]


def test_time_range_is_inclusive(spark, store):
    store.append_events(
        events(spark, *(event(id=str(h), timestamp=NOW - timedelta(hours=h)) for h in (0, 1, 2)))
    )
    kept = paging.query_page(
        store.events(), start_time=NOW - timedelta(minutes=90), end_time=NOW.isoformat()
    )
    assert ids(kept) == ["0", "1"]
    exact = filters.filter_events(store.events(), start_time=NOW, end_time=NOW)
    assert ids(exact) == ["0"]


def test_bounds_with_an_offset_and_naive_bounds(spark):
    df = events(spark, event(id="a", timestamp=NOW))
    assert filters.filter_start_time(df, "2024-05-01T02:30:00+02:00").count() == 1
    assert filters.filter_start_time(df, "2024-05-01T00:30:00.000001").count() == 0
    assert filters.filter_end_time(df, "2024-05-01T00:30:00").count() == 1


def test_combined_filters(spark):
    df = events(
        spark,
        event(id="hit", session_id="s", event_type="a"),
        event(id="type", session_id="s", event_type="b"),
        event(id="session", session_id=None, event_type="a"),
    )
    assert ids(filters.filter_events(df, session_id="s", event_type="a")) == ["hit"]
    assert filters.filter_events(df, session_id="", event_type=None).count() == 3
    assert filters.filter_events(df, session_id="S").count() == 0
    with pytest.raises(TypeError):
        filters.filter_events(df, colour="red")


def test_values_are_values_not_sql(spark):
    df = events(spark, event(id="x' OR '1'='1"), event(id="b"))
    assert ids(filters.get_event_by_id(df, "x' OR '1'='1")) == ["x' OR '1'='1"]
    assert filters.get_event_by_id(df, "none").count() == 0


def test_pages_of_equal_timestamps_are_disjoint(spark):
    df = events(spark, *(event() for _ in range(10)))
    first, second = ids(paging.page(df, 5, 0)), ids(paging.page(df, 5, 5))
    assert len(first) == len(second) == 5 and not set(first) & set(second)


def test_has_more(spark):
    df = events(spark, *(event() for _ in range(15)))
    info = [tuple(paging.page_info(df, 10, offset).first()) for offset in (0, 5, 10, 100)]
    assert info == [(15, 10, 0, True), (15, 10, 5, False), (15, 10, 10, False), (15, 10, 100, False)]
    assert paging.page(df, 10, 100).count() == 0


@pytest.mark.parametrize("args", [(0, 0), (1001, 0), (10, -1), (2000, 0), (True, 0), ("5", 0)])
def test_bad_page_arguments(args):
    with pytest.raises(ValueError):
        paging.validate_page_args(*args)
    with pytest.raises(ValueError):
        paging.page(None, *args)


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of all events shares one instant; the others spread over days to seconds."""
    rows = [event(id=f"tie-{n:04d}", timestamp=NOW) for n in range(60)]
    for n in range(120):
        step = [timedelta(days=n), timedelta(hours=n), timedelta(seconds=n), timedelta(0, 0, n)][n % 4]
        rows.append(event(id=f"e{n:03d}", timestamp=NOW - step))
    df = events(spark, *rows).cache()
    order = sorted(rows, key=lambda r: r[0])
    order.sort(key=lambda r: r[5], reverse=True)
    return df, [row[0] for row in order]


@pytest.mark.parametrize("offset", [0, 3, 30, 59, 63, 88, 95, 130, 170, 177, 180, 500])
def test_deep_pages_equal_a_full_sort(crowd, offset):
    df, order = crowd
    assert ids(paging.page(df, 7, offset, keep=9)) == order[offset : offset + 7]
    assert ids(paging.page(df, 7, offset, prune=True)) == order[offset : offset + 7]


def test_keyset_walk_visits_everything_once(crowd):
    df, order = crowd
    seen, page = [], paging.page(df, 50).collect()
    while page:
        seen += [row.id for row in page]
        last = page[-1]
        page = paging.page_after(df, last.timestamp, last.id, 50).collect()
    assert seen == order


def test_histogram_labels_and_sum(spark):
    df = events(spark, *(event(storage_latency_ms=ms) for ms in (0.5, 1.0, 30.0, 5000.0, None)))
    rows = {r.le: r for r in metrics.storage_latency_histogram(df).collect()}
    assert [rows[le].bucket_count for le in ("0.001", "0.025", "0.05", "1.0", "+Inf")] == [2, 2, 3, 3, 4]
    assert (rows["+Inf"].observed_sum, rows["+Inf"].observed_count) == (5.0315, 4)
    grouped = metrics.histogram(df, "storage_latency_ms / 1000", (1.0,), by=("event_type",))
    assert {(r.event_type, r.le, r.bucket_count) for r in grouped.collect()} == {
        ("order.placed", "1.0", 3),
        ("order.placed", "+Inf", 4),
    }


def test_empty_histogram(spark):
    rows = metrics.storage_latency_histogram(events(spark, event()).limit(0)).collect()
    assert len(rows) == 11 and all(r.bucket_count == 0 and r.observed_sum == 0.0 for r in rows)


def test_latest_latency(spark):
    df = events(
        spark,
        event(id="a", stored_at=NOW, storage_latency_ms=1.0),
        event(id="b", stored_at=NOW, storage_latency_ms=2.0),
        event(id="c", stored_at=NOW - timedelta(1), storage_latency_ms=3.0),
    )
    assert metrics.latest_storage_latency(df).first()[0] == 2.0


def test_trail_is_oldest_first(spark):
    df = events(
        spark,
        *(event(id=str(n), correlation_id="c", timestamp=NOW - timedelta(n)) for n in range(3)),
        event(correlation_id=None),
    )
    assert ids(patterns.audit_trail(df, "c")) == ["2", "1", "0"]
    assert ids(patterns.event_replay(df, end_time=NOW - timedelta(1))) == ["2", "1"]


def test_a_hot_id_is_reduced_before_the_shuffle(spark):
    rows = spark.range(0, 30_000, 1, 8).selectExpr(
        "IF(id % 3 = 0, 'hot', string(id)) AS id", "id AS arrival_seq"
    )
    first = unique_by_id(rows)
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    assert first.where("id = 'hot'").first().arrival_seq == 0
    assert first.count() == 20_001
    rejects = duplicate_rejects(rows)
    assert rejects.count() == 9_999 and rejects.where("id <> 'hot'").count() == 0


def test_filters_reach_the_scan(spark, store):
    store.append_events(events(spark, event(), event(timestamp=NOW - timedelta(9))))
    query = paging.query_page(
        store.events(), event_type="a", start_time="2024-04-30", end_time="2024-05-02"
    )
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "EqualTo(event_type,a)" in plan and "GreaterThanOrEqual(timestamp" in plan
    counted = paging.total_count(store.events(), start_time="2024-04-30")
    schema = counted._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert schema.startswith("struct<timestamp:timestamp>")


def test_roundtrip_of_an_event(spark, store):
    row = event()
    store.append_events(events(spark, row))
    got = store.events().selectExpr(*store.events().columns[:11]).first()
    want = tuple(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for v in row)
    assert tuple(got) == want
    assert rows_of(store.events()) == [want]


def test_histories_are_whole(spark):
    df = events(spark, *(event(id=f"{n:04}", session_id="s", event_type="t") for n in range(1_200)))
    assert patterns.session_history(df, "s").count() == 1_200
    assert patterns.conversation_context(df, "s", "t").count() == 1_200
    assert ids(patterns.session_history(df, "s", limit=5, offset=10)) == [f"{n:04}" for n in range(10, 15)]


def test_rejects_and_first_writes_are_complements(spark):
    rows = [("a", None, 1), ("a", None, 2), ("a", 5, 3), ("b", 7, 4), ("b", 7, 5), ("c", 1, 6), ("c", 1, 6), ("d", 2, 7)]
    df = spark.createDataFrame(rows, "id string, arrival_seq long, x int")
    kept, gone = unique_by_id(df).collect(), duplicate_rejects(df).collect()
    assert sorted(map(tuple, kept + gone), key=str) == sorted(rows, key=str)
    assert sorted(r.id for r in kept) == ["a", "b", "c", "d"]


def test_deep_pages_in_another_zone(spark, monkeypatch):
    """Around the end of summer time, with a driver that does not run in UTC."""
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        start = utc(2024, 11, 3, 4)
        df = events(spark, *(event(id=f"{n:03}", timestamp=start + timedelta(minutes=7 * n)) for n in range(60)))
        order = [f"{n:03}" for n in reversed(range(60))]
        for offset in range(0, 60, 7):
            assert ids(paging.page(df, 5, offset, keep=9)) == order[offset : offset + 5]
    finally:
        monkeypatch.undo()
        time.tzset()


def test_a_page_near_the_top_opens_few_days(spark, store):
    store.append_events(events(spark, *(event(id=f"{n:03}", timestamp=NOW + timedelta(days=n)) for n in range(40))))
    table = store.events()
    days = paging._stored_days(table)
    assert len(days) == 40 and days[0] > days[-1]
    opened = lambda df: df.select("event_date").distinct().count()
    assert opened(paging.newest_days(table, 3, days)) <= 7
    assert opened(paging.newest_days(table, 3, days, newest=days[20])) <= 28
    for offset in (0, 10, 38, 50):
        want = ids(paging.page(table, 4, offset, prune=False))
        assert ids(paging.page(table, 4, offset, prune=True)) == want
    after = paging.page_after(table, NOW + timedelta(days=20), "020", 3)
    assert ids(after) == ["019", "018", "017"]


def test_page_and_total_in_one_call(spark):
    df = events(spark, *(event(id=str(n), event_type="ab"[n % 2]) for n in range(30)))
    found = paging.fetch_page(df, 4, 8, event_type="a")
    assert (len(found.rows), found.total, found.has_more) == (4, 15, True)
    assert not paging.fetch_page(df, 10, 5, event_type="a").has_more


def test_numbering_shuffles_rows_once(spark):
    rows = spark.range(0, 500, 1, 4).selectExpr("id * 7 % 500 AS n", "id AS m")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables beyond it
    try:
        for found in (number_rows(rows, ["n"], parts=3), totals_before(rows, ["n"], "n", name="position", parts=3)):
            assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
            places = [r.position for r in found.orderBy("n").collect()]
            assert places in (list(range(500)), [n * (n - 1) // 2 for n in range(500)])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
