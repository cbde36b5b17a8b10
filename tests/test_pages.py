"""Orders that share a page of state: the same fold, fewer calls to the store, less on disk."""

import datetime as dt
import glob
import json
import os
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_lifecycle import At, Handle, event, header, line, model, random_events

from orderflow import schemas as S
from orderflow.operators import cdc as CDC
from orderflow.plans import queries as Q
from orderflow.session import scratch_path
from orderflow.sources import adapters as A
from orderflow.streaming import jobs as JOBS
from orderflow.streaming import lifecycle as LC
from orderflow.streaming import sinks as SK


def frame(events):
    """(order, event) pairs as the operator gets them: JSON without nulls."""
    drop = lambda v: {k: drop(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else v
    return pd.DataFrame({"event": [json.dumps(drop({"order_id": o, **e})) for o, e in events]})


def sent(fold, batch, at=0):
    for pdf in fold.handleInputRows(("p",), iter([batch.iloc[:7], batch.iloc[7:]]), At(at)):
        yield from pdf.itertuples()


@pytest.mark.parametrize("inline", [24, 1])
def test_orders_of_a_page_fold_as_each_alone(monkeypatch, inline):
    monkeypatch.setattr(LC, "INLINE", inline)
    monkeypatch.setattr(LC, "TOGETHER", 3)
    for seed in range(15):
        rng = random.Random(seed)
        orders = {o: random_events(rng, rng.randint(1, 30)) for o in ("a", "b", None, "c")}
        rows = [(o, e) for o, es in orders.items() for e in es + rng.sample(es, len(es) // 3)]
        rng.shuffle(rows)
        fold, state, history = LC.PageFold(), {}, {}
        fold.init(Handle())
        for i in range(0, len(rows), 20):
            for r in sent(fold, frame(rows[i:i + 20])):
                for e in json.loads(r.entries):
                    v = e[e["kind"]]
                    if e["kind"] == "order":
                        state[r.order_id] = (v["order_status"], v["channel"], v["product_family"], v["line_count"], v["total_demand"],
                                             v["allocation_count"], v["allocated_qty"], (v["shipment"] or {}).get("shipment_id"))
                    elif e["kind"] == "history":
                        history[(r.order_id, v["timestamp"], v["lsn"])] = None if v["removed"] else (v["status"], v["prev_status"])
        for o, es in orders.items():
            got = sorted((*k[1:], *v) for k, v in history.items() if v and k[0] == o)
            assert (state[o], got) == model(es)


def test_a_page_is_read_and_written_once_a_batch():
    fold, handle, calls = LC.PageFold(), Handle(), []
    fold.init(handle)
    page = handle.states["page"]
    get, update = page.get, page.update
    page.get = lambda: calls.append("get") or get()
    page.update = lambda v: calls.append("update") or update(v)
    rows = [(f"o{i}", line(1, i + 1, "l", 2)) for i in range(200)]
    assert sum(1 for _ in sent(fold, frame(rows))) == 200 and calls == ["get", "update"]
    assert len(json.loads(page.v[0])) == 200


def test_orders_of_a_page_expire_one_by_one(monkeypatch):
    monkeypatch.setattr(LC, "INLINE", 1)
    fold, handle = LC.PageFold(ttl_ms=1000), Handle()
    fold.init(handle)
    many = [("old", line(1, i, f"l{i}", 2)) for i in range(1, 4)]
    list(sent(fold, frame([*many, ("new", header(5, 9, "CREATED")), ("new", line(5, 10, "x", 1)), ("new", line(5, 11, "y", 1))])))
    assert handle.timers == {2000} and len(handle.states["lines"]) == 5
    expired = type("Info", (), {"getExpiryTimeInMs": lambda self: 2000})()
    assert list(fold.handleExpiredTimer(("p",), At(2500), expired)) == []
    assert [o["order_id"] for o in json.loads(handle.states["page"].v[0])] == ["new"]
    assert {k[0] for k in handle.states["lines"]} == {"new"} and handle.timers == {6000}
    expired = type("Info", (), {"getExpiryTimeInMs": lambda self: 6000})()
    list(fold.handleExpiredTimer(("p",), At(9000), expired))
    assert handle.states["page"].v is None and not handle.states["lines"] and not handle.timers


def test_numbers_that_json_lacks_pass_through_a_page():
    fold = LC.PageFold()
    fold.init(Handle())
    e = event(1, 1, child="l", line={"sku": "s", "quantity": 2.0, "unit_price": "NaN", "line_status": "OPEN"})
    (row,) = sent(fold, frame([("o", e)]))
    got = next(x["line"] for x in json.loads(row.entries) if x["kind"] == "line")
    assert got["unit_price"] != got["unit_price"] and got["description"] is None


def snapshot(spark):
    t0, rows = dt.datetime(2024, 1, 1), []
    for i in range(12):
        rows.append((f"o{i}", "orders", "r", t0, 1, None, {"order_id": f"o{i}", "order_status": "ALLOCATED", "total_value": "5.5", "business_unit": "EMEA"}))
        rows += [(f"o{i}", "order_line_items", "u", t0 + dt.timedelta(days=k), k + 2, None,
                  {"order_id": f"o{i}", "line_id": f"l{k}", "sku": "s\"\n", "quantity": "2", "unit_price": "NaN" if k else "3"}) for k in range(i + 1)]
    return spark.createDataFrame(rows, S.CHANGE_EVENT)


def test_a_run_with_pages_is_the_run_without(spark, pages=5):
    """Rows, listing, state by batch and a handover, with few pages and with none."""
    root = scratch_path(spark, f"pages-{uuid.uuid4().hex[:8]}")
    A.write_topics(snapshot(spark), os.path.join(root, "raw"), 3)
    raw = glob.glob(os.path.join(root.removeprefix("file:"), "raw", "*", "*", "part-*"))
    assert raw and all(f.endswith(".gz") for f in raw)
    topics, got = Q._topics(os.path.join(root, "raw"), ["orders", "order_line_items"]), []
    for name, n in (("none", None), ("some", pages)):
        at = lambda p, name=name: os.path.join(root, name, p)
        JOBS.start_lifecycle_job(spark, topics, at("state"), at("ckpt"), at("listing"), max_files=1, pages=n).awaitTermination()
        JOBS.start_lifecycle_job(spark, topics, at("state-2"), at("ckpt-2"), max_files=1, pages=n,
                                 initial_state=LC.seed_rows(snapshot(spark).where("lsn < 5"))).awaitTermination()
        tables = [LC.order_table(spark, at("state")).drop("pipeline_ts"), LC.child_table(spark, at("state"), "line"), LC.history_table(spark, at("state")),
                  SK.read_batches(spark, at("listing")).drop("_batch"), LC.state_orders(spark, at("ckpt")), LC.state_orders(spark, at("ckpt-2")),
                  LC.state_orders(spark, at("ckpt"), 0)]
        got.append([sorted(map(str, t.collect())) for t in tables])
        kept = spark.read.format("statestore").option("stateVarName", "page").load(at("ckpt")).count()
        assert kept == (12 if n is None else len({r[0] for r in snapshot(spark).select(F.pmod(F.xxhash64("order_id"), F.lit(n))).collect()}))
    assert got[0] == got[1] and all(got[0])


def test_a_line_is_parsed_once(spark):
    good = '{"op":"u","__table":"orders","ts_ms":1,"lsn":1,"after":{"order_id":"o"}}'
    rows = CDC.valid(CDC.parse_envelope(spark.createDataFrame([(good,), ("{",), (None,), ('{"op":"x"}',)], "value string")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert [r.order_id for r in rows.collect()] == ["o"]
    assert sorted(r.reject_reason or "" for r in CDC.parse_envelope(spark.createDataFrame([(good,), ("{",), (None,), ('{"op":"x"}',)], "value string")).collect()) \
        == ["", "malformed_json", "malformed_json", "missing_field"]
