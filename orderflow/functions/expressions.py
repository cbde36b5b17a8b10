"""Column-expression helpers (JVM-side, inside whole-stage codegen).

Every helper returns a ``Column``; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow import schemas as S


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pick(values, index_col: Column) -> Column:
    """Element ``index_col`` (0-based) of a fixed list."""
    return F.element_at(lit_array(values), (index_col + F.lit(1)).cast("int"))


def money(c: Column) -> Column:
    """Exact money: decimal(15,2); sums stay order-independent."""
    return c.cast(S.MONEY)


def money_out(c: Column) -> Column:
    """Money leaves the engine as double (after exact decimal arithmetic)."""
    return c.cast("double")


def ratio(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def to_ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def ms_to_ts(ms: Column) -> Column:
    """Epoch milliseconds -> timestamp_ntz (UTC), null-safe (PRJ-9)."""
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def ts_to_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def ts_to_iso(ts: Column) -> Column:
    """ISO-8601 text with a ``+00:00`` offset (PRJ-9); the fraction appears
    only when the time has microseconds, as in common ISO renderings."""
    t = ts.cast("timestamp")
    whole = F.unix_micros(t) % F.lit(1_000_000) == 0
    return F.when(whole, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx")) \
        .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def flexible_ts(text: Column) -> Column:
    """Row-image timestamp: epoch-ms digits or ISO text (Q13)."""
    return (F.when(text.rlike(r"^-?[0-9]+$"), ms_to_ts(text.try_cast("bigint")))
            .otherwise(text.try_cast("timestamp_ntz")))


def try_money(text: Column) -> Column:
    """Decimal-as-string coercion (PRJ-5)."""
    return text.try_cast(S.MONEY)


def classify_horizon(expected_ship: Column, as_of: Column) -> Column:
    """D1/D7/D30/D90 by days between ``as_of`` and the expected ship time.

    Null ship date -> D90; past due counts as D1 (PRJ-8). The clock is an
    explicit column so results replay (Q17)."""
    days_out = (F.unix_micros(expected_ship.cast("timestamp")) -
                F.unix_micros(as_of.cast("timestamp"))) / F.lit(86400.0 * 1e6)
    expr = F.when(expected_ship.isNull(), F.lit("D90"))
    for name, limit in S.HORIZON_LIMITS_DAYS:
        expr = expr.when(days_out <= F.lit(float(limit)), F.lit(name))
    return expr.otherwise(F.lit("D90"))


def priority_label(tier: Column) -> Column:
    """P1-Critical .. P5-Minimal, ``P<n>`` outside the table (PRJ-15)."""
    return F.coalesce(
        F.when((tier >= 1) & (tier <= len(S.PRIORITY_LABELS)),
               F.element_at(lit_array(S.PRIORITY_LABELS), tier.cast("int"))),
        F.concat(F.lit("P"), tier.cast("string")))


def tokens(text: Column) -> Column:
    """Lower-cased word tokens (letters/digits), empty strings removed."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"),
                    lambda t: t != F.lit(""))


def star_status(o_orderstatus: Column) -> Column:
    """Adapter A: O/P/F -> CREATED/IN_PRODUCTION/SHIPPED."""
    return (F.when(o_orderstatus == "O", "CREATED")
            .when(o_orderstatus == "P", "IN_PRODUCTION")
            .when(o_orderstatus == "F", "SHIPPED"))


def event_status(event_type: Column) -> Column:
    """Adapter B: event type -> order status."""
    return (F.when(event_type == "signup", "CREATED")
            .when(event_type == "view", "ALLOCATED")
            .when(event_type == "click", "IN_PRODUCTION")
            .when(event_type == "purchase", "SHIPPED")
            .when(event_type == "error", "CANCELLED"))
