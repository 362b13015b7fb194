"""Changes of a store that are cut short, the key, the counts and the stream of appends."""

import json
from datetime import timedelta
from pathlib import Path

import pytest
from event_rows import event, events, raw, rows_of, utc
from pyspark.sql import functions as F

from eventledger.operators import metrics, paging
from eventledger.operators.envelopes import normalize_envelope
from eventledger.operators.patterns import persisted_feed
from eventledger.plans import commits, store as stores
from eventledger.plans.commits import CommitLog
from eventledger.plans.files import Files
from eventledger.plans.ingest import ingest_batch
from eventledger.plans.keys import KeyTable
from eventledger.plans.store import EventStore
from eventledger.streaming import live
from eventledger.streaming.ingest import append_stream

DAY = utc(2024, 5, 1)


class Lost(BaseException):
    """The driver is gone: nothing after this runs, no clean-up either."""


@pytest.fixture
def lose(monkeypatch):
    """lose(method, prefix, after): the driver is lost at a file operation whose name begins so."""

    def arm(method, prefix, after=0):
        plain, left = getattr(Files, method), [after]

        def cut(self, name, *rest):
            target = rest[0] if method == "move" else name
            if target.startswith(prefix):
                if not left[0]:
                    raise Lost
                left[0] -= 1
            return plain(self, name, *rest)

        patch = pytest.MonkeyPatch()
        patch.setattr(Files, method, cut)
        patch.setattr(Files, "many", lambda self, work, names: [work(n) for n in names])
        patch.setattr(CommitLog, "cancel", lambda self, change: None)
        patches.append(patch)
        return patch

    patches = []
    yield arm
    for patch in patches:
        patch.undo()


def body(event_id, **changes):
    envelope = {"id": event_id, "ts": "2024-05-01", "event_type": "t", "source": "s", "data": {}}
    return json.dumps(envelope | changes)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def again(spark, store):
    """The same store as a driver sees it that has just started."""
    return EventStore(spark, store.root)


def drained(store, folder):
    rows = store.tail().select("id", "commit_seq")
    append_stream(rows, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return ids(store.spark.read.parquet(f"{folder}/rows"))


def fill(spark, store, parts=3, size=5):
    for n in range(parts):
        store.append_events(events(spark, *(event(id=f"{n}-{i}", timestamp=DAY + timedelta(hours=i)) for i in range(size))))
    return sorted(f"{n}-{i}" for n in range(parts) for i in range(size))


# --- merges ---

CUTS = [("put", "pending/", 0), ("move", "events/", 0), ("put", "commits/", 0), ("delete", "events/", 0), ("delete", "events/", 1), ("delete", "staging/", 0)]


@pytest.mark.parametrize("cut", CUTS, ids=lambda c: f"{c[0]}-{c[1]}-{c[2]}")
def test_a_merge_cut_short_shows_each_row_once(spark, store, tmp_path, lose, cut):
    want = fill(spark, store)
    assert drained(store, tmp_path / "tail") == want
    patch = lose(*cut)
    with pytest.raises(Lost):
        store.compact("2024-06-01")
    patch.undo()
    found = again(spark, store)
    assert ids(found.events()) == want
    assert drained(found, tmp_path / "tail") == want
    found.commits.abandon()  # the lost driver's change, where it was not ready
    found.compact("2024-06-01")
    assert ids(found.events()) == want and ids(found.keys.live(found.keys.all()).distinct()) == want
    assert len(list(Path(store.events_path).glob("event_date=*/*.parquet"))) == 1
    assert not list(Path(store.root, "pending").glob("0*")) and not list(Path(store.root, "staging").glob("*"))
    assert drained(found, tmp_path / "tail") == drained(found, tmp_path / "later") == want
    assert all(found.get_event(i).count() == 1 for i in (want[0], want[-1]))


def test_tail_of_rows_merged_twice(spark, store, tmp_path):
    want = fill(spark, store, parts=2)
    store.compact("2024-06-01")
    want = sorted(want + ["x"])
    store.append_events(events(spark, event(id="x", timestamp=DAY)))
    assert drained(store, tmp_path / "a") == want
    store.compact("2024-06-01")
    store.append_events(events(spark, event(id="y", timestamp=DAY)))
    assert drained(store, tmp_path / "a") == drained(store, tmp_path / "b") == sorted([*want, "y"])


def test_live_counts_do_not_change_with_a_merge(spark, store, tmp_path):
    path, checkpoint = str(tmp_path / "rows"), str(tmp_path / "checkpoint")
    fill(spark, store)
    for step in (lambda: None, lambda: store.compact("2024-06-01"), lambda: None):
        step()
        live.publish_counters(live.live_stored(store), path, checkpoint).awaitTermination()
        assert live.read_counters(store, path).first().total == 15


# --- appends ---


@pytest.mark.parametrize("cut", [("put", "pending/", 0), ("move", "events/", 0), ("move", "events/", 1), ("put", "commits/", 0), ("delete", "pending/", 1)], ids=str)
def test_a_batch_cut_short_is_stored_and_told_once(spark, store, tmp_path, lose, cut):
    batch = raw(spark, body("a"), body("b", ts="2024-05-02"), body("a", data={"k": 1}), "{oops")

    def notices(found):
        feed = persisted_feed(found.tail())
        append_stream(feed, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
        return sorted(r.original_event_id for r in spark.read.schema(feed.schema).parquet(f"{tmp_path}/out").collect())

    patch = lose(*cut)
    with pytest.raises(Lost):
        ingest_batch(batch, store, batch_id=1, writer="w")
    patch.undo()
    found = again(spark, store)
    assert set(ids(found.events())) <= {"a", "b"} and set(notices(found)) <= {"a", "b"}
    ingest_batch(batch, found, batch_id=1, writer="w")
    assert ids(found.events()) == ["a", "b"] == notices(found)
    ingest_batch(batch, found, batch_id=1, writer="w")
    ingest_batch(raw(spark, body("a", data={"k": 2})), found, batch_id=2, writer="w")
    assert ids(found.events()) == ["a", "b"] == notices(found)
    assert sorted(r.error_type for r in found.quarantine().collect()) == ["IntegrityError", "IntegrityError", "JSONDecodeError"]
    assert found.total_count().first().total == 2


def test_another_writer_finishes_what_is_ready(spark, store, lose):
    patch = lose("move", "events/")
    with pytest.raises(Lost):
        ingest_batch(raw(spark, body("a")), store, batch_id=1, writer="w")
    patch.undo()
    ingest_batch(raw(spark, body("a", data={"k": 1}), body("b")), again(spark, store), batch_id=1, writer="v")
    assert {r.id: r.payload for r in store.refresh().events().collect()} == {"a": "{}", "b": "{}"}


def test_a_second_ingest_is_refused(spark, store, monkeypatch):
    monkeypatch.setattr(commits, "WAIT_SECONDS", 0.5)
    store.commits.begin(commits.APPEND, "other", 7)
    with pytest.raises(RuntimeError, match="another change is open"):
        ingest_batch(raw(spark, body("a")), again(spark, store))
    assert store.refresh().events().count() == 0
    store.commits.abandon()
    ingest_batch(raw(spark, body("a")), again(spark, store))
    assert ids(store.refresh().events()) == ["a"]


def test_numbers_are_given_once(spark, store):
    first = store.commits.begin(commits.APPEND, "a")
    assert not store.files.create(f"pending/{first.name}.open", "")
    store.commits.cancel(first)
    second = store.commits.begin(commits.APPEND, "b")
    assert second.seq == first.seq
    store.commits.ready(second)
    store.commits.finish(second)
    store.commits.finish(second)
    assert again(spark, store).commits.last() == second.seq


def test_last_recorded():
    for n in range(70):
        asked = []
        assert commits.last_recorded(lambda seq: asked.append(seq) or seq <= n) == n
        assert len(asked) < 16 and commits.last_recorded(lambda seq: seq <= n, n // 2) == n


# --- the key ---


def numbered(spark, start, stop):
    return events(spark, *(event(id=f"id{n}", timestamp=DAY + timedelta(minutes=n)) for n in range(start, stop)))


def test_a_batch_opens_its_buckets_and_no_event(spark, store, monkeypatch):
    store.append_events(numbered(spark, 0, 300))
    opened = []
    plain = KeyTable.of_buckets
    monkeypatch.setattr(KeyTable, "of_buckets", lambda self, wanted, n: opened.append(list(wanted)) or plain(self, wanted, n))
    monkeypatch.setattr(EventStore, "events", lambda self: 1 / 0)
    ingest_batch(raw(spark, body("id7"), body("new"), body("id7")), store)
    table = store.keys
    assert opened == [sorted({int(spark.sql(f"SELECT {table.bucket_of(table.buckets)} FROM (SELECT '{i}' AS id)").first()[0]) for i in ("id7", "new")})]
    monkeypatch.undo()
    assert store.refresh().events().count() == 301
    assert sorted(r.error_type for r in store.quarantine().collect()) == ["IntegrityError"] * 2


def test_ten_times_the_store_reads_the_same_bytes(spark, tmp_path):
    def bytes_for(store):
        return sum(store.keys.files_of("id7").values())

    sizes = []
    for rows in (2_000, 20_000):
        store = EventStore(spark, str(tmp_path / str(rows))).init()
        many = spark.range(rows).selectExpr("concat('id', id) AS id", "DATE '2024-05-01' AS event_date", "'f' AS file", "'w' AS writer", "0L AS batch_id")
        Path(store.events_path, "event_date=2024-05-01").mkdir()
        Path(store.events_path, "event_date=2024-05-01", "f").touch()
        store.keys.add(many)
        store.keys.tidy(bucket_ids=100)
        assert store.keys.all().count() == rows and len(store.keys.files_of("id7")) == 1
        sizes.append(bytes_for(store))
    assert sizes[1] < 1.3 * sizes[0]


def test_a_lookup_opens_two_files(spark, store):
    for n in range(10):
        store.append_events(numbered(spark, 10 * n, 10 * n + 10))
    store.keys.tidy(merge_files=1)
    found = store.get_event("id37")
    assert ids(found) == ["id37"]
    assert len(store.keys.files_of("id37")) == 1 and len(found.inputFiles()) == 1
    assert store.get_event("absent").collect() == [] == store.get_event("").collect()
    store.compact("2024-06-01")
    assert ids(store.get_event("id37")) == ["id37"] and len(store.get_event("id37").inputFiles()) == 1
    store.archive_before("2024-06-01")
    assert store.get_event("id37").collect() == []


def test_key_of_gone_files_goes(spark, store):
    store.append_events(numbered(spark, 0, 40))
    store.compact("2024-06-01")
    store.archive_before("2024-05-02")
    store.append_events(numbered(spark, 40, 50))
    store.keys.tidy(merge_files=0)
    assert ids(store.keys.all()) == ids(store.events()) == sorted(f"id{n}" for n in range(40, 50))


def test_a_store_from_before_the_key(spark, store):
    want = fill(spark, store)
    for folder in ("keys", "counts", "commits", "pending"):
        store.files.delete(folder)
    found = again(spark, store).init()
    assert ids(found.keys.all()) == want and found.total_count().first().total == 15
    ingest_batch(raw(spark, body(want[0]), body("new")), found)
    assert ids(found.events()) == sorted([*want, "new"]) and found.total_count().first().total == 16


# --- counts ---


def totals(df):
    return sorted(tuple(r) for r in df.collect())


def counted_as_scanned(store):
    store.refresh()
    rows, rejects = store.events(), store.quarantine()
    assert totals(store.stored_total()) == totals(metrics.events_stored_total(rows))
    assert totals(store.failed_total()) == totals(metrics.events_failed_total(rejects))
    assert totals(store.received_total()) == totals(metrics.received_of_store(rows, rejects))
    asked = [
        {}, {"event_type": "t"}, {"source": "s", "event_type": "none"}, {"start_time": "2024-05-01", "end_time": "2024-05-02T23:59:59.999999"},
        {"start_time": "2024-05-01T10:30:00", "event_type": "t"}, {"end_time": "2024-05-03T00:00:00.5"}, {"start_time": "2024-05-09", "end_time": "2024-05-01"},
        {"start_time": "2024-05-02T10:00:00", "end_time": "2024-05-02T10:31:00"}, {"start_time": "2024-05-01T23:59:59.999999", "end_time": "2024-05-04"},
    ]
    for wanted in asked:
        assert totals(store.total_count(**wanted)) == totals(paging.total_count(rows, **wanted)), wanted
    wanted = {"session_id": "q", "event_type": "t"}
    assert totals(store.page_info(10, 2, **wanted)) == totals(paging.page_info(rows, 10, 2, **wanted))
    assert totals(store.page_info(1, 1)) == totals(paging.page_info(rows, 1, 1))


def test_counts_equal_the_scan(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "FOLD_COUNTS", 2)
    stamps = ["2024-05-01T10:30:00", "2024-05-01T23:59:59.999999", "2024-05-02", "2024-05-02T10:31:00", "2024-05-03T00:00:00.5", "2024-05-04"]
    batch = raw(spark, *(body(f"e{n}", ts=t, event_type="tu"[n % 2], source="sv"[n // 3]) for n, t in enumerate(stamps)), body("e0"), "{x", body(""))
    for _ in range(2):
        ingest_batch(batch, store, batch_id=0, writer="w")
        counted_as_scanned(store)
    for n in range(3):
        ingest_batch(raw(spark, body(f"n{n}", session_id="q"), body("e1"), "[]", start=50), store, batch_id=n + 1, writer="w")
    counted_as_scanned(store)
    store.compact("2024-05-02")
    assert store.files.names("folded") and not [n for n in store.files.names("counts") if int(n[4:]) <= 4]
    store.archive_before("2024-05-02")
    store.archive_before("2024-05-02")
    counted_as_scanned(store)
    ingest_batch(raw(spark, body("late")), store)
    counted_as_scanned(store)


def test_plans_of_totals_leave_events_alone(spark, store):
    fill(spark, store)
    for df in (store.total_count(event_type="t", start_time="2024-05-01"), store.page_info(), store.stored_total(), store.failed_total(), store.received_total()):
        opened = df.inputFiles()
        assert opened and all(f"{store.root}/counts/" in name for name in opened)
    assert normalize_envelope(raw(spark, body("a"))).count() == 1
    assert rows_of(store.events())


# --- pages and file order ---


def test_pages_of_a_large_store(spark, store, monkeypatch):
    monkeypatch.setattr(paging, "PRUNE_BYTES", 0)
    stamp = lambda n: DAY + timedelta(hours=5 * n)
    store.append_events(events(spark, *(event(id=f"e{n:03}", timestamp=stamp(n), event_type="tu"[n % 2]) for n in range(120))))
    scanned = paging.query_page
    asked = [{}, {"event_type": "u"}, {"event_type": "none"}, {"end_time": stamp(50)}, {"start_time": stamp(100), "source": "shop"}]
    for wanted in [*asked, {"start_time": stamp(3), "end_time": stamp(9)}, {"session_id": "x"}]:
        for limit, offset in ((1, 0), (10, 0), (10, 7), (100, 30)):
            want = [tuple(r) for r in scanned(store.events(), limit, offset, **wanted).collect()]
            page = store.fetch_page(limit, offset, **wanted)
            assert [tuple(r) for r in page.rows] == want
            assert page.total == paging.total_count(store.events(), **wanted).first().total
    monkeypatch.setattr(paging, "newest_days", lambda *a: 1 / 0)
    assert [r.id for r in store.query_page(3, 1).collect()] == ["e118", "e117", "e116"]
    days = store.query_page(3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in days and store._oldest_day_of_page(4) == stamp(116).date()


def test_merged_days_are_cut_by_several_columns(spark, store, monkeypatch):
    """Files that a filter's value can lie in by their minima and maxima, before and after."""
    rows = spark.range(0, 40_000, 1, 8).selectExpr(
        "uuid() AS id", "concat('type', pmod(hash(id), 20)) AS event_type", "'s' AS source", "CAST(NULL AS STRING) AS target", "'t' AS routing_key",
        "timestamp_micros(1714521600000000 + pmod(xxhash64(id), 86400000) * 1000) AS timestamp", "current_timestamp() AS stored_at", "'{}' AS payload",
        "IF(id % 10 = 0, NULL, substring(md5(string(id % 500)), 1, 8)) AS session_id", "CAST(NULL AS STRING) AS correlation_id", "1D AS storage_latency_ms",
    )
    for _ in range(3):
        store.append_events(rows)
    before = store.events().count()
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "250KB")
    try:
        store.append_events(rows.limit(0).union(rows))  # many files, each sorted by session
        opened = {}
        for step in ("before", "after"):
            found = store.refresh().events()
            files = found.groupBy("_metadata.file_name").agg(
                *(f(c).alias(f"{n}_{c}") for c in ("session_id", "event_type", "timestamp") for n, f in (("lo", F.min), ("hi", F.max)))
            ).collect()
            probe = found.where("session_id IS NOT NULL").orderBy(F.xxhash64("id")).limit(20).collect()
            share = lambda c: sum(f[f"lo_{c}"] is not None and f[f"lo_{c}"] <= r[c] <= f[f"hi_{c}"] for f in files for r in probe) / len(files) / len(probe)
            opened[step] = {c: round(share(c), 2) for c in ("session_id", "event_type", "timestamp")}
            if step == "before":
                sizes = store.files.sizes("events/event_date=2024-05-01")
                monkeypatch.setattr(stores, "COMPACT_BYTES", sum(sizes.values()) // (len(files) // 2))
                store.compact("2024-06-01")
                assert len(files) > 8
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert store.events().count() > before
    # Four or five files: the first bits are the session's and the type's.
    assert opened["before"] == {"session_id": 1.0, "event_type": 1.0, "timestamp": 1.0}
    assert opened["after"]["session_id"] < 0.7 and opened["after"]["event_type"] < 0.8
