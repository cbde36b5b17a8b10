"""The streaming order state and windows: the processors against plain models
(any order of arrival, redelivery, settling, expiry), and the runs they drive."""

import collections
import datetime as dt
import json
import os
import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.operators import history as H
from orderflow.plans import queries as Q
from orderflow.session import scratch_path, ship_package
from orderflow.sources import adapters as A
from orderflow.streaming import jobs as JOBS
from orderflow.streaming import lifecycle as LC
from orderflow.streaming import sinks as SK
from orderflow.streaming import windows as WIN


class Value:
    def __init__(self):
        self.v = None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map(dict):
    def getValue(self, k):
        return dict.get(self, k)

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        self.pop(k, None)

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    """The parts of a stateful processor's handle that the operators use, for one key."""

    def __init__(self):
        self.timers, self.states = set(), {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Map())

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def event(ts, lsn, **parts):
    return {"ts_us": ts * 1_000_000, "lsn": lsn, "child_id": parts.pop("child", ""),
            **dict.fromkeys(("header", "line", "allocation", "shipment")), **parts}


def header(ts, lsn, status=None, family=None, **fields):
    values = {**{f: None for f in LC.FIELDS}, **fields, **({"order_status": status} if status else {})}
    has = [f in fields or (f == "order_status" and status is not None) for f in LC.FIELDS]
    return event(ts, lsn, header={**values, "has": has, "family": family})


def line(ts, lsn, child, quantity, family=None):
    return event(ts, lsn, child=child, line={"sku": f"s{quantity}", "product_family": family or "", "description": None, "quantity": float(quantity),
                                             "unit_price": 1.0, "line_status": "OPEN", "family": family})


def random_events(rng, n):
    out = []
    for lsn in range(1, n + 1):
        ts = rng.randint(1, 30)
        kind = rng.choice(["header", "header", "line", "line", "allocation", "shipment"])
        if kind == "header":
            out.append(header(ts, lsn, rng.choice(["CREATED", "ALLOCATED", "SHIPPED", None]), rng.choice([None, None, f"h{lsn}"]),
                              **({"channel": f"c{lsn}"} if rng.random() < .5 else {})))
        elif kind == "line":
            out.append(line(ts, lsn, f"l{rng.randint(0, 4)}", rng.randint(0, 9), rng.choice([None, f"f{lsn}"])))
        elif kind == "allocation":
            out.append(event(ts, lsn, child=f"a{rng.randint(0, 3)}", allocation={"sku": "x", "warehouse_id": "w", "allocated_qty": float(rng.randint(1, 5)), "status": "S"}))
        else:
            out.append(event(ts, lsn, shipment={"shipment_id": f"p{lsn}", "carrier": None, "tracking_number": None, "status": "SHIPPED", "ship_date": None, "delivery_date": None}))
    return out


def model(events):
    """The order after all events, and its history, by position."""
    es = sorted({(e["ts_us"], e["lsn"]): e for e in events}.items())
    h, lines, allocations, ship, fam, statuses = dict(LC.DEFAULTS), {}, {}, None, None, []
    first_line, line_fam = None, {}
    for p, e in es:
        if e["header"]:
            for f, has in zip(LC.FIELDS, e["header"]["has"]):
                if has:
                    h[f] = e["header"][f]
            if e["header"]["family"] and fam is None:
                fam = (p, e["header"]["family"])
            if e["header"]["has"][LC.FIELDS.index("order_status")]:
                statuses.append((p, e["header"]["order_status"]))
        elif e["line"]:
            c = e["child_id"]
            first_line = first_line or c
            lines[c] = e["line"]["quantity"]
            if e["line"]["family"]:
                line_fam.setdefault(c, (p, e["line"]["family"]))
        elif e["allocation"]:
            allocations[e["child_id"]] = e["allocation"]["allocated_qty"]
        else:
            ship = e["shipment"]["shipment_id"]
    families = [x for x in (fam, line_fam.get(first_line)) if x]
    prev, history = "CREATED", []
    for p, s in statuses:
        if s != prev:
            history.append((p[0], p[1], s, prev))
        prev = s
    return (h["order_status"], h["channel"], min(families)[1] if families else "", len(lines), sum(lines.values()),
            len(allocations), sum(allocations.values()), ship), history


def folded(processor, handle, batches, watermarks=None):
    processor.init(handle)
    state, history = None, {}
    for i, batch in enumerate(batches):
        at = At(watermarks[i] if watermarks else 0)
        for row in processor.handleInputRows(("o",), iter(batch), at):
            v = json.loads(row["payload"])
            if row["kind"] == "order":
                state = (v["order_status"], v["channel"], v["product_family"], v["line_count"], v["total_demand"],
                         v["allocation_count"], v["allocated_qty"], (v["shipment"] or {}).get("shipment_id"))
            elif row["kind"] == "history":
                history[(v["timestamp"], v["lsn"])] = None if v["removed"] else (v["status"], v["prev_status"])
    return state, sorted((*k, *v) for k, v in history.items() if v)


@pytest.mark.parametrize("inline", [24, 1])
def test_fold_is_the_same_in_any_order_of_arrival(monkeypatch, inline):
    monkeypatch.setattr(LC, "INLINE", inline)
    for seed in range(25):
        rng = random.Random(seed)
        events = random_events(rng, rng.randint(1, 40))
        arrived = events + rng.sample(events, len(events) // 3)         # redelivered
        rng.shuffle(arrived)
        cuts = sorted(rng.randint(0, len(arrived)) for _ in range(3))
        batches = [b for b in np.split(np.array(arrived, object), cuts) if len(b)]
        handle = Handle()
        assert folded(LC.OrderFold(), handle, batches) == model(events)
        moved = len(handle.states["lines"]) + len(handle.states["statuses"])
        assert (moved > 0) <= (inline == 1 or len(events) > 24)


def test_settled_history_forgets_events_but_no_entry():
    handle = Handle()
    events = [header(t, t, s) for t, s in ((10, "CREATED"), (20, "ALLOCATED"), (30, "ALLOCATED"), (40, "ALLOCATED"), (200, "SHIPPED"))]
    late = header(25, 99, "CREATED")                                    # before the settled bound: given up
    _, history = folded(LC.OrderFold(settle_ms=60_000), handle, [events[:4], [events[4]], [late], [header(210, 100, "SHIPPED")]],
                        [0, 120_000, 150_000, 300_000])
    assert [h[2:] for h in history] == [("ALLOCATED", "CREATED"), ("SHIPPED", "ALLOCATED")]
    kept = json.loads(handle.states["order"].v[0])["own_statuses"]
    assert len(kept) < 5 and all(v[1] or i == len(kept) - 1 for i, (_k, v) in enumerate(kept))


def test_an_idle_order_expires_by_event_time():
    handle, p = Handle(), LC.OrderFold(ttl_ms=1000_000)
    folded(p, handle, [[header(100, 1, "CREATED")], [line(150, 2, "l", 3)]], [0, 120_000])
    assert handle.timers == {100_000 + 1000_000} or handle.timers == {150_000 + 1000_000}
    assert list(p.handleExpiredTimer(("o",), At(2000_000), None)) == [] and handle.states["order"].v is None


def snapshot(spark):
    """A large order and a small one; the prices are no numbers."""
    t0, rows = dt.datetime(2024, 1, 1), []
    for order, n, total in (("big", 300, "5.5"), ("small", 2, "7")):
        rows.append((order, "orders", "r", t0, 1, None, {"order_id": order, "order_status": "ALLOCATED", "total_value": total}))
        rows += [(order, "order_line_items", "u", t0, i + 2, None, {"order_id": order, "line_id": f"l{i}", "sku": "s\"\n", "quantity": "2", "unit_price": "NaN"})
                 for i in range(n)]
    return spark.createDataFrame(rows, S.CHANGE_EVENT)


def test_an_orders_seeds_reach_the_operator_together(spark):
    seeds = LC.seed_rows(snapshot(spark))
    rows = collections.defaultdict(list)
    for r in seeds.collect():
        rows[r.order_id].append(r.asDict())
    assert {o: len(v) for o, v in rows.items()} == {"big": 2, "small": 1}       # 302 and 4 seeds
    assert max(len(json.loads(r["seeds"])) for v in rows.values() for r in v) <= LC.SEEDS
    for order, n in (("big", 300), ("small", 2)):
        handle, p = Handle(), LC.OrderFold()
        p.init(handle)
        for r in rows[order]:
            p.handleInitialState((order,), r, At(0))
        out = {r["child_id"]: json.loads(r["payload"]) for r in p.handleInputRows((order,), iter([line(1, 1, "l0", 9), header(1, 1, channel="c")]), At(0))}
        state = out[None]
        assert (state["order_status"], state["line_count"], state["total_demand"]) == ("ALLOCATED", n, 2.0 * n)
        assert state["total_value"] == {"big": 5.5, "small": 7.0}[order]
        assert out["l0"]["sku"] == "s\"\n" and np.isnan(out["l0"]["unit_price"])   # the event is older than the snapshot


def test_a_large_order_is_handed_over_in_several_rows(spark):
    root = scratch_path(spark, f"seeds-{uuid.uuid4().hex[:8]}")
    A.write_topics(snapshot(spark).where("source_table = 'orders' or lsn < 60"), os.path.join(root, "raw"), 3)
    JOBS.start_lifecycle_job(spark, Q._topics(os.path.join(root, "raw"), ["orders", "order_line_items"]), os.path.join(root, "state"),
                             os.path.join(root, "ckpt"), max_files=1, initial_state=LC.seed_rows(snapshot(spark))).awaitTermination()
    got = {(r.order_id, r.line_count, r.total_demand) for r in LC.state_orders(spark, os.path.join(root, "ckpt")).collect()}
    assert got == {("big", 300, 600.0), ("small", 2, 4.0)}


def test_history_run_equals_batch_history_and_readers_are_independent(spark, sf):
    """Two readers of the same topic, with their own checkpoints and batch sizes."""
    root = scratch_path(spark, f"readers-{uuid.uuid4().hex[:8]}")
    ch = A.change_stream(spark, sf)
    A.write_topics(ch, os.path.join(root, "raw"), 3)
    want = {(r.order_id, r.seq_no, r.status, r.prev_status) for r in H.status_history(ch).collect()}
    for reader, files in (("a", 1), ("b", None)):
        q = JOBS.start_lifecycle_job(spark, Q._topics(os.path.join(root, "raw"), ["orders"]), os.path.join(root, reader),
                                     os.path.join(root, f"ckpt-{reader}"), max_files=files)
        q.awaitTermination()
        got = LC.history_table(spark, os.path.join(root, reader)).collect()
        assert len(got) == len(want) and {(r.order_id, r.seq_no, r.status, r.prev_status) for r in got} == want


def test_recovered_run_has_no_row_twice_and_state_can_be_read_per_batch(spark, sf):
    root = scratch_path(spark, f"recover-{uuid.uuid4().hex[:8]}")
    ch = Q._star_events(spark, sf).where("cast(order_id as int) < 200")
    A.write_topics(ch, os.path.join(root, "raw"), 3)
    done = []

    def stop(batch_id):
        done.append(batch_id)
        if done == [0, 1]:
            raise Q.StoppedBetweenCommits

    runs = []
    for _ in range(2):
        q = JOBS.start_lifecycle_job(spark, Q._topics(os.path.join(root, "raw")), os.path.join(root, "state"), os.path.join(root, "ckpt"),
                                     max_files=2, after_write=stop)
        try:
            q.awaitTermination()
            runs.append("ended")
        except Q.StreamingQueryException:
            runs.append("stopped")
    assert runs == ["stopped", "ended"] and done[:3] == [0, 1, 1]
    rows = SK.read_batches(spark, os.path.join(root, "state")).where("kind = 'order'")
    assert rows.count() == rows.select("order_id", "version").distinct().count()
    assert rows.where("pipeline_ts is null").count() == 0
    # the state after batch n is the newest row up to batch n
    for n in (0, done[-1]):
        live = LC.state_orders(spark, os.path.join(root, "ckpt"), n).select("order_id", "version", "order_status", "total_demand").collect()
        written = LC.order_table(spark, os.path.join(root, "state"), upto=n).select("order_id", "version", "order_status", "total_demand").collect()
        assert sorted(live) == sorted(written) and live


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path.replace("file:", "")) for f in fs)


def test_a_batch_writes_its_own_rows_however_large_the_table(spark):
    path = scratch_path(spark, f"cost-{uuid.uuid4().hex[:8]}")
    listing = path + "-listing"
    sink = SK.upsert_sink(path, ["k"], F.col("ts"), listing, F.col("v") != "", ("unit",))
    batch = lambda i, n: spark.range(i * n, (i + 1) * n).select(F.col("id").cast("string").alias("k"), F.lit(i).alias("ts"),
                                                               F.sha2(F.col("id").cast("string"), 256).alias("v"), (F.col("id") % 3).cast("string").alias("unit"))
    for i in range(10):
        sink(batch(i, 2000), i)
    sizes = [folder_bytes(SK.batch_path(path, i)) for i in range(10)]
    assert max(sizes) < 1.2 * min(sizes)
    before = sorted(SK.read_latest(spark, path, ["k"], F.col("ts")).collect())
    sink(batch(3, 2000), 3)                                             # replay
    assert sorted(SK.read_latest(spark, path, ["k"], F.col("ts")).collect()) == before and len(before) == 20_000
    rows = SK.read_batches(spark, listing)
    assert rows.count() == 20_000 and "unit" in rows.columns
    assert SK.read_latest(spark, path, ["k"], F.col("ts"), upto=1).count() == 4000


def test_a_replayed_batch_reads_the_version_it_read_first(spark):
    path = scratch_path(spark, f"version-{uuid.uuid4().hex[:8]}")
    assert SK.recorded_version(spark, path, 0, lambda: 7) == 7
    assert SK.recorded_version(spark, path, 0, lambda: 9) == 7
    assert SK.recorded_version(spark, path, 1, lambda: None) is None
    assert SK.recorded_version(spark, path, 1, lambda: 5) is None


def test_a_slow_source_holds_windows_open(spark):
    """One topic ends ten days before the other; windows close 30 s behind the first to end."""
    root = scratch_path(spark, f"slow-{uuid.uuid4().hex[:8]}")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"o{d}", table, "u", t0 + dt.timedelta(days=d), d, None, {"order_id": f"o{d}"})
            for table, days in (("orders", 30), ("shipments", 20)) for d in range(days)]
    A.write_topics(spark.createDataFrame(rows, S.CHANGE_EVENT), os.path.join(root, "raw"), 1, again=1 << 20)
    JOBS.start_table_windows_job(spark, Q._topics(os.path.join(root, "raw"), ["orders", "shipments"]), os.path.join(root, "out"),
                                 os.path.join(root, "ckpt"), size="1 day").awaitTermination()
    got = SK.read_batches(spark, os.path.join(root, "out")).groupBy("source_table").agg(F.max("window_end").alias("m"), F.sum("events").alias("n")).collect()
    assert {(r.source_table, r.m, r.n) for r in got} == {(t, t0 + dt.timedelta(days=18), 18) for t in ("orders", "shipments")}


def plain_windows(batches, specs):
    """Windows and late sums of (ts, cents) batches under the watermark each batch sees."""
    sums, late, closed = collections.Counter(), collections.Counter(), set()
    ends = lambda ts, size, slide: range((ts - size) // slide * slide + slide + size, ts // slide * slide + size + 1, slide)
    for now, rows in batches:
        for ts, cents in rows:
            for name, (size, slide) in specs.items():
                for end in ends(ts, size, slide):
                    (late if end <= now else sums)[(name, end)] += cents
        closed |= {k for k in sums if k[1] <= now}
    return {k: v for k, v in sums.items() if k in closed}, dict(late)


def test_windows_and_late_rows_are_the_whole_input_and_each_is_the_models():
    specs = {"a": (12 * WIN.PANE, WIN.PANE), "b": (24 * WIN.PANE, 8 * WIN.PANE), "c": (16 * WIN.PANE, 16 * WIN.PANE)}
    for seed in range(20):
        rng = random.Random(seed)
        batches, now = [], 0
        for _ in range(6):
            rows = [(max(0, now + rng.randint(-40, 60) * WIN.PANE + rng.randint(0, 999)), rng.randint(1, 99)) for _ in range(rng.randint(0, 12))]
            batches.append((now, rows))
            now += rng.randint(0, 30) * WIN.PANE + rng.randint(0, 9) * 1000
        batches.append((now, []))
        handle, fold = Handle(), WIN.WindowFold(specs)
        fold.init(handle)
        got, late = collections.Counter(), []
        for now, rows in batches:
            frames = []
            if rows:
                pdf = pd.DataFrame({"ts_us": [r[0] for r in rows], "order_id": "o", "supply_c": 0, "cnt": 1, "prio": 1, "demand_c": [r[1] for r in rows]})
                frames = list(fold.handleInputRows(("u", "f", "h", 0), iter([pdf.iloc[:5], pdf.iloc[5:]]), At(now // 1000)))
            due = {t for t in handle.timers if t * 1000 <= now}
            handle.timers -= due
            frames += [f for _t in due for f in fold.handleExpiredTimer(("u", "f", "h", 0), At(now // 1000), None)]
            for f in frames:
                for r in f[f["kind"] == "window"].itertuples():
                    assert (r.window_type, r.window_end) not in got
                    got[(r.window_type, r.window_end)] += r.demand_c
                late += list(f[f["kind"] == "late"].itertuples())
        missed = collections.Counter()
        for r in late:
            for end in range(r.window_end, r.missed_to + 1, specs[r.window_type][1]):
                missed[(r.window_type, end)] += r.demand_c
        want, want_late = plain_windows([(n // 1000 * 1000, r) for n, r in batches], specs)
        assert dict(got) == want and dict(missed) == want_late
        stored = handle.states["panes"].v
        assert stored is None or all(max(p // sl * sl + si for si, sl in specs.values()) > stored[0] for p in stored[1])


def test_hot_key_of_windows_spreads_over_salts(spark):
    ship_package(spark)
    root = scratch_path(spark, f"hot-{uuid.uuid4().hex[:8]}")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"o{i}", "EMEA", "Compute" if i % 3 else f"f{i % 7}", "D1", "CREATED", i % 50, 1, True, t0 + dt.timedelta(minutes=i)) for i in range(900)]
    rec = spark.createDataFrame(rows, "order_id string, bu string, product_family string, horizon string, status string, total_value long, priority int, atp_feasible boolean, ts timestamp_ntz")
    rec = rec.withColumn("total_value", F.col("total_value").cast(S.MONEY))
    rec.write.parquet(os.path.join(root, "rec"))
    stream = spark.readStream.schema(rec.schema).parquet(os.path.join(root, "rec"))
    JOBS.start_windows_job(spark, stream, os.path.join(root, "rows"), os.path.join(root, "metrics"), os.path.join(root, "ckpt")).awaitTermination()
    part = SK.read_batches(spark, os.path.join(root, "rows")).where("kind = 'window' and product_family = 'Compute'")
    assert part.select("salt").distinct().count() == WIN.SALTS
    m = SK.read_batches(spark, os.path.join(root, "metrics"))
    assert m.count() == m.select("bu", "product_family", "window_type", "window_end").distinct().count()
    assert json.loads(m.first()["json"])["bu"] == "EMEA"                 # SNK-5: one JSON document a window


def test_settle_and_expiry_on_a_stream(spark, sf):
    """With event-time timers: the same rows leave, and idle orders leave the store."""
    root = scratch_path(spark, f"ttl-{uuid.uuid4().hex[:8]}")
    ch = Q._star_events(spark, sf).where("cast(order_id as int) < 60")
    A.write_topics(ch, os.path.join(root, "raw"), 1, again=1 << 20)
    rows = []
    for name, options in (("plain", {}), ("timed", {"settle": 3600, "ttl_days": 400})):
        JOBS.start_lifecycle_job(spark, Q._topics(os.path.join(root, "raw")), os.path.join(root, name), os.path.join(root, f"ckpt-{name}"),
                                 **options).awaitTermination()
        rows.append(sorted(tuple(r) for r in Q._star_state(LC.order_table(spark, os.path.join(root, name))).collect()))
    assert rows[0] == rows[1] and rows[0]
    newest = {r.order_id: r.t for r in ch.groupBy("order_id").agg(F.max("ts").alias("t")).collect()}
    mark = min(r.t for r in ch.groupBy("source_table").agg(F.max("ts").alias("t")).collect()) - dt.timedelta(seconds=30)
    kept = {r.order_id for r in LC.state_orders(spark, os.path.join(root, "ckpt-timed")).collect()}
    assert kept == {o for o, t in newest.items() if t + dt.timedelta(days=400) > mark} and 0 < len(kept) < len(newest)
    assert {r.order_id for r in LC.state_orders(spark, os.path.join(root, "ckpt-plain")).collect()} == set(newest)
