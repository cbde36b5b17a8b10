"""Window semantics: sliding membership, tumbling additivity, pane plan ==
direct plan, segmented scan == single window."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.functions.scan import segmented_scan
from orderflow.operators import backlog as BL

T0 = dt.datetime(2024, 1, 1)


def records(spark, minutes):
    rows = [("NA", "Compute", "D7", S.UNFULFILLED_STATUSES[i % 3] if i % 4 else "SHIPPED",
             float(i % 17) + 0.25, 1 + i % 5, i % 2 == 0, T0 + dt.timedelta(minutes=m))
            for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "bu string, product_family string, horizon string, "
                                     "status string, v double, priority int, "
                                     "atp_feasible boolean, ts timestamp_ntz")
    return df.withColumn("total_value", F.col("v").cast(S.MONEY)).drop("v")


def test_each_event_in_twelve_sliding_windows(spark):
    rec = records(spark, [7.5])
    w = BL.backlog_windows(rec, "1 hour", "5 minutes", "sliding_1h")
    assert w.count() == 12
    assert w.agg(F.min("window_start"), F.max("window_start")).collect()[0] == \
        (T0 - dt.timedelta(minutes=50), T0 + dt.timedelta(minutes=5))


def test_tumbling_windows_add_up_to_total(spark):
    rec = records(spark, list(range(0, 3000, 7)))
    w = BL.backlog_windows(rec, "1 hour", None, "tumbling_1h")
    tot = rec.agg(F.count_if(F.col("status").isin(*S.UNFULFILLED_STATUSES))).collect()[0][0]
    assert w.agg(F.sum("order_count")).collect()[0][0] == tot


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 600), min_size=1, max_size=40))
def test_pane_plan_equals_direct_plan(spark, minutes):
    rec = records(spark, minutes)
    a = BL.backlog_windows(rec, "1 hour", "5 minutes", "s")
    b = BL.backlog_windows_direct(rec, "1 hour", "5 minutes", "s")
    assert sorted(a.collect()) == sorted(b.collect())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 500),
                          st.one_of(st.none(), st.integers(0, 99))), min_size=1, max_size=40))
def test_segmented_scan_equals_window(spark, rows):
    df = spark.createDataFrame([(k, T0 + dt.timedelta(hours=h), i, v)
                                for i, (k, h, v) in enumerate(rows)],
                               "k int, ts timestamp_ntz, i int, v int")
    seg = F.date_trunc("day", F.col("ts"))
    for how, fn in (("last", lambda c, w: F.last(c, ignorenulls=True).over(w)),
                    ("first", lambda c, w: F.first(c, ignorenulls=True).over(w)),
                    ("max", lambda c, w: F.max(c).over(w)),
                    ("sum", lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)))):
        for inclusive in (True, False):
            w = Window.partitionBy("k").orderBy("ts", "i").rowsBetween(
                Window.unboundedPreceding, 0 if inclusive else -1)
            want = sorted(df.withColumn("o", fn(F.col("v"), w)).collect())
            got = sorted(segmented_scan(df, ["k"], seg, ["ts", "i"], F.col("v"), how, "o",
                                        inclusive).select(*df.columns, "o").collect())
            assert got == want, (how, inclusive)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-50, 50))),
                min_size=1, max_size=60))
def test_exact_quantiles_equal_percentile(spark, rows):
    from orderflow.functions.quantiles import exact_quantiles
    df = spark.createDataFrame(rows, "g int, v int")
    probs = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p1": 1.0}
    want = {r["g"]: [round(x, 9) if x is not None else None for x in (r["p"] or [None] * 5)]
            for r in df.groupBy("g").agg(F.percentile(F.col("v").cast("double"),
                                                      F.array(*[F.lit(p) for p in probs.values()]))
                                         .alias("p")).collect()}
    got = {r["g"]: [round(r[k], 9) for k in probs]
           for r in exact_quantiles(df, ["g"], F.col("v"), probs).collect()}
    for g, vals in got.items():
        assert vals == want[g]
    assert all(want[g] == [None] * 5 for g in want if g not in got)


def test_summary_latest_only_uses_newest_window_per_key(spark):
    rec = records(spark, [5, 65, 125])                     # three hourly windows
    m = BL.backlog_windows(rec, "1 hour", None, "tumbling_1h")
    full = {r["product_family"]: r for r in BL.backlog_summary(m).collect()}
    last = {r["product_family"]: r for r in BL.backlog_summary(m, latest_only=True).collect()}
    newest = m.orderBy(F.desc("window_start")).first()
    assert last["ALL"]["demand"] == newest["unfulfilled_demand"]
    assert full["ALL"]["demand"] == m.agg(F.sum("unfulfilled_demand")).first()[0]
