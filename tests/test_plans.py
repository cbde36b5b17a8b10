"""Plan guards: no query may contain a cartesian or nested-loop join, the
point lookup must reach the parquet scans, and the pane plan must aggregate
before expanding windows."""

import contextlib
import io

import pytest

import __spark_entry__ as E

BATCH = sorted(n for n in E.queries() if not n.startswith(("stream_", "serving_")))


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", BATCH)
def test_no_cartesian_or_nested_loop_join(spark, sf, name):
    p = plan(E.queries()[name](spark, sf), "simple")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_lookup_predicate_reaches_both_scans(spark, sf):
    p = plan(E.queries()["order_lookup"](spark, sf))
    assert "EqualTo(o_orderkey,7)" in p and "EqualTo(l_orderkey,7)" in p


def test_panes_aggregate_before_window_expansion(spark, sf):
    p = plan(E.queries()["backlog_sliding_1h"](spark, sf), "simple")
    gen = p.index("Generate")
    assert "HashAggregate" in p[gen:]          # a pane aggregate sits below the expansion


def test_search_page_is_a_top_k(spark, sf):
    assert "TakeOrderedAndProject" in plan(E.queries()["order_search_page"](spark, sf), "simple")
