"""Streams in order: late and shuffled rows over several micro-batches against the batch form or a plain simulation."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from auditspark.operators import events as E
from auditspark.streaming import ordered as O

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
END = "~end"


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def files(spark, path, batches, schema):
    """One file a batch, so that each trigger reads one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def collected(stream, path, mode="append"):
    """Rows by batch."""
    found = {}

    def keep(batch, number):
        if rows := batch.collect():
            found[number] = rows

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return found


def every(found):
    return [r for n in sorted(found) for r in found[n]]


def shuffled_within(rows, span, seed=0):
    """Rows in an order in which none comes more than ``span`` seconds late."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, span)))


def cut(rows, n):
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_suppression_in_order(spark, tmp_path):
    """More rows of one pattern than an Arrow batch holds, in falling order; and others, late ones among them."""
    rng = random.Random(1)
    hot = [("hot", at(i / 100), i, i in (9_000, 15_000)) for i in range(25_000)]
    others = [(f"p{i % 7}", at(i / 10), i, rng.random() < 0.02) for i in range(2_000)]
    batches = [hot[::-1], *cut(shuffled_within(others, 30), 4), [(END, at(10_000), 0, False)]]
    # The first batch is whole, so that its order, not its lateness, counts.
    stream = files(spark, tmp_path / "in", [batches[0] + batches[1], *batches[2:]], "pattern string, at timestamp, seq long, rejected boolean")
    found = every(collected(O.stream_suppression(stream, delay="300 seconds"), tmp_path))
    first = {}
    for p, _, seq, rejected in hot + others:
        if rejected:
            first[p] = min(seq, first.get(p, seq))
    assert {(r.pattern, r.seq): r.suppressed for r in found} == {(p, seq): seq > first.get(p, seq) for p, _, seq, _ in hot + others}
    assert len(found) == 27_000


def test_many_patterns_few_states(spark, tmp_path, monkeypatch):
    """Patterns of a row or two: the state store holds rows by shard and cell, not by pattern, and a shard whose last row is far
    ahead lets the others go."""
    monkeypatch.setattr(O, "SHARDS", 8)
    monkeypatch.setattr(O, "CELLS", 4)
    rows = [(f"p{i % 4_000}", at(i / 100), i, i % 7 == 0) for i in range(6_000)]
    stream = files(spark, tmp_path / "in", [*cut(rows, 2), [(END, at(10_000), 0, False)]], "pattern string, at timestamp, seq long, rejected boolean")
    found = []
    query = O.stream_suppression(stream, delay="10 seconds").writeStream.foreachBatch(lambda batch, n: found.extend(batch.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert {(r.pattern, r.seq): r.suppressed for r in found} == {(p, seq): seq >= 4_000 and (seq - 4_000) % 7 == 0 for p, _, seq, _ in rows}
    assert len(found) == 6_000 and 0 < max(sizes) < 400


def test_states_in_order(spark, tmp_path):
    rng = random.Random(2)
    phases = ["init", "analyzing", "static_analysis", "auditing", "completed", "error", "cancelled", "unknown"]
    rows = [(f"s{rng.randrange(12)}", at(i / 7), i, rng.choices(phases, [5, 5, 5, 5, 1, 1, 1, 2])[0], f"m{i}") for i in range(1_500)]
    schema = "scan_id string, ts timestamp, seq long, phase string, message string"
    stream = files(spark, tmp_path / "in", [*cut(shuffled_within(rows, 20), 5), [(END, at(5_000), 0, "init", "")]], schema)
    last = {}
    for r in every(collected(O.stream_states(stream, delay="20 seconds"), tmp_path)):
        last[r.scan_id] = max((r.n_events, r.status, r.static_done, r.last_message), last.get(r.scan_id, (0,)))
    batch = E.scan_states(spark.createDataFrame(rows, schema)).collect()
    assert last == {r.scan_id: (r.n_events, r.status, r.static_done, r.last_message) for r in batch}


def simulated_reports(rows, debounce, heartbeat, until):
    """Second by second."""
    sent = sent_at = wait = last = None
    out, rows = [], sorted(rows, key=lambda r: (r[1], r[2]))
    for now in range(until + 1):
        here = [r for r in rows if r[1] == at(now)]
        for _, _, seq, signature in here:
            last = (seq, signature)
            if sent_at is None:
                sent, sent_at = signature, now
                out.append((now, seq, signature, "first"))
            elif wait is None:
                wait = now + debounce
        if sent_at is None:
            continue
        if wait is not None and now >= wait:
            wait = None
            if last[1] != sent:
                sent, sent_at = last[1], now
                out.append((now, *last, "change"))
        if wait is None and now >= sent_at + heartbeat:
            sent, sent_at = last[1], now
            out.append((now, *last, "heartbeat"))
    return out


def test_reports_by_time(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{k}", at(t), 1000 * k + t, rng.choice("abc")) for k in range(8) for t in sorted(rng.sample(range(600), 5 + 15 * k))]
    end = 900
    stream = files(spark, tmp_path / "in", [*cut(shuffled_within(rows, 40), 6), [(END, at(end + 40), 0, "x")]], "session string, at timestamp, seq long, signature string")
    found = {}
    for r in every(collected(O.stream_reports(stream, delay="40 seconds"), tmp_path)):
        found.setdefault(r.session, []).append((round((r.sent_at.replace(tzinfo=timezone.utc) - START).total_seconds()), r.seq, r.signature, r.kind))
    expected = {f"s{k}": simulated_reports([r for r in rows if r[0] == f"s{k}"], 2, 60, end) for k in range(8)}
    assert {k: [r for r in v if r[0] <= end - 60] for k, v in found.items() if k != END} == {k: [r for r in v if r[0] <= end - 60] for k, v in expected.items()}
    assert {kind for v in expected.values() for *_, kind in v} == {"first", "change", "heartbeat"}


def test_reports_by_the_clock(spark, tmp_path):
    """Live, timers run on processing time: the first is sent at once, the change after the debounce, then a heartbeat."""
    import time

    schema = "session string, at timestamp, seq long, signature string"
    spark.createDataFrame([("s", at(0), 1, "a")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    found = []
    stream = O.stream_reports(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), debounce_seconds=0.2, heartbeat_seconds=3.0, live=True)
    query = stream.writeStream.foreachBatch(lambda batch, n: found.extend(batch.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="200 milliseconds").start()
    try:
        for kind, wait in (("first", 60), ("change", 60), ("heartbeat", 60)):
            if kind == "change":
                spark.createDataFrame([("s", at(1), 2, "b"), ("s", at(2), 3, "c")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
            began = time.time()
            while not any(r.kind == kind and (kind != "heartbeat" or r.signature == "c") for r in found) and time.time() - began < wait and query.isActive:
                time.sleep(0.1)
    finally:
        query.stop()
    kinds = [(r.kind, r.seq, r.signature) for r in found if not (r.kind == "heartbeat" and r.signature == "a")]
    assert kinds[:3] == [("first", 1, "a"), ("change", 3, "c"), ("heartbeat", 3, "c")]


def simulated_offline(rows, timeout):
    out, seen, running = [], None, []
    for _, when, _, scan, status in sorted(rows, key=lambda r: (r[1], r[2])):
        if running and seen + timeout <= when:
            out += [(scan_, "cancelled") for scan_ in running]
            running = []
        seen = when
        if scan is not None:
            running = [s for s in running if s != scan] + ([scan] if status in ("analyzing", "auditing") else [])
            out.append((scan, status))
    return out + [(s, "cancelled") for s in running]


def test_silent_agents(spark, tmp_path):
    """At the end the states equal the batch form, with the agents' dead as they are."""
    rng = random.Random(4)
    rows, seq = [], 0
    for a in range(10):
        now = 0.0
        for _ in range(120):
            now += rng.choice([5, 10, 20, 20, 95, 140] if a % 2 else [5, 10, 20])
            seq += 1
            scan, status = (f"{a}-{rng.randrange(6)}", rng.choice(["analyzing", "auditing", "completed", "error"])) if rng.random() < 0.5 else (None, None)
            rows.append((f"a{a}", at(now), seq, scan, status))
    schema = "agent string, at timestamp, seq long, scan_id string, status string"
    stream = files(spark, tmp_path / "in", [*cut(shuffled_within(rows, 60), 5), [(END, at(100_000), 0, None, None)]], schema)
    found = {}
    for r in every(collected(O.stream_offline(stream, delay="60 seconds"), tmp_path)):
        found.setdefault(r.agent, []).append((r.scan_id, r.status))
    expected = {f"a{a}": simulated_offline([r for r in rows if r[0] == f"a{a}"], timedelta(seconds=90)) for a in range(10)}
    assert found == expected
    last = spark.createDataFrame([(a, s, st) for a, v in expected.items() for s, st in {s: st for s, st in v if st != "cancelled"}.items()], "agent string, scan_id string, status string")
    dead = last.select("agent").distinct()
    batch = {r.scan_id: r.status for r in E.reconcile_offline(last, dead, "agent", "status", ["analyzing", "auditing"], "cancelled").collect()}
    assert {s: st for v in found.values() for s, st in v} == {s: st for s, st in batch.items()}


@pytest.mark.parametrize("n", [3, 500])
def test_last_events_at_every_trigger(spark, tmp_path, n):
    rng = random.Random(5)
    rows = [(f"s{i % 3}", at(rng.randrange(5_000)), i, rng.choice(["init", "auditing"]), f"m{i}") for i in range(4_000)]
    batches = cut(rows, 4)
    found = collected(O.stream_last_events(files(spark, tmp_path / "in", batches, "scan_id string, ts timestamp, seq long, phase string, message string"), n=n), tmp_path, "update")
    assert len(found) == 4
    seen = []
    for number, batch in zip(sorted(found), batches):
        seen += batch
        expected = {(k, i, r[2], r[4]) for k in {r[0] for r in batch} for i, r in enumerate(sorted((r for r in seen if r[0] == k), key=lambda r: (r[1], r[2]), reverse=True)[:n], 1)}
        assert {(r.scan_id, r.place, r.seq, r.message) for r in found[number]} == expected


def test_keepalives(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"c{k}", at(t), t, f"e{t}") for k in range(4) for t in sorted(rng.sample(range(900), 6 + 20 * k))]
    stream = files(spark, tmp_path / "in", [*cut(shuffled_within(rows, 50), 4), [(END, at(2_000), 0, "")]], "consumer string, at timestamp, seq long, payload string")
    found = {}
    for r in every(collected(O.stream_with_keepalives(stream, delay="50 seconds"), tmp_path)):
        found.setdefault(r.consumer, []).append((round((r.sent_at.replace(tzinfo=timezone.utc) - START).total_seconds()), r.kind, r.payload))
    for k in range(4):
        expected, sent = [], None
        for now in range(1_500):
            here = [r for r in rows if r[0] == f"c{k}" and r[1] == at(now)]
            if here:
                expected += [(now, "event", r[3]) for r in here]
                sent = now
            elif sent is not None and now == sent + 30:
                expected.append((now, "keepalive", None))
                sent = now
        assert [r for r in found[f"c{k}"] if r[0] < 1_500] == expected
