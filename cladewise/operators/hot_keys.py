"""Per-key results where a few keys hold most rows: eager aggregation through joins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators.skew import share_of


def pair_states(facts: DataFrame, a: Column, b: Column, at: Column) -> DataFrame:
    """One compact state per pair of values: (a, b, n_rows, first_at, last_at).

    The pair is the grouping key, so the rows of a hot value of ``a`` spread over its values of ``b``, and repeated pairs
    shrink in the map tasks. Null values stay, since such rows count for the other field.
    """
    rows = facts.select(a.alias("a"), b.alias("b"), at.alias("at"))
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_rows"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def rolled_up(states: DataFrame, field_a: str, field_b: str) -> DataFrame:
    """States of both fields' values: (key_field, key_name, n_rows, n_partners, first_at, last_at).

    A pair stands once in ``states``, so distinct partners are a plain count and every figure is combined in the map
    tasks: a task gets one row per key and map task, whatever the key's share.
    """

    def side(field: str, key: str, partner: str) -> Column:
        return F.struct(F.lit(field).alias("key_field"), F.col(key).alias("key_name"), F.col(partner).isNotNull().cast("long").alias("partner"), "n_rows", "first_at", "last_at")

    both = states.select(F.explode(F.array(side(field_a, "a", "b"), side(field_b, "b", "a"))).alias("x")).select("x.*")
    return both.where("key_name is not null").groupBy("key_field", "key_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("partner").alias("n_partners"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )


def key_profiles(facts: DataFrame, a: Column, b: Column, at: Column, others: DataFrame, field_a: str, field_b: str) -> DataFrame:
    """Results per key of the join of ``facts`` with ``others``, without making the joined rows.

    ``others`` has (key_field, key_name, amount), any number of rows per key; it is aggregated by key too, and the two
    compact states are joined. Returns (key_field, key_name, n_rows, n_partners, first_at, last_at, n_joined, amount_joined):
    ``n_joined`` is the product of both row counts and ``amount_joined`` the sum of ``amount`` over the joined rows; both are
    0 where ``others`` has no row. Null amounts add nothing. Null names are no keys. Empty facts give no rows.
    """
    right = others.where("key_field is not null and key_name is not null").groupBy("key_field", "key_name").agg(
        F.count(F.lit(1)).alias("n_other"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount")
    )
    left = rolled_up(pair_states(facts, a, b, at), field_a, field_b)
    joined = left.join(right, ["key_field", "key_name"], "left")
    return joined.select(
        "key_field", "key_name", "n_rows", "n_partners", "first_at", "last_at",
        (F.col("n_rows") * F.coalesce("n_other", F.lit(0))).alias("n_joined"), (F.col("n_rows") * F.coalesce("amount", F.lit(0))).alias("amount_joined"),
    )


def dominant_keys(profiles: DataFrame, facts: DataFrame, share: float | Decimal) -> DataFrame:
    """Profiles of keys that hold at least ``share`` of all rows of ``facts``, rows without a key included."""
    total = facts.agg(F.count(F.lit(1))).scalar()
    return profiles.where(F.col("n_rows") >= share_of(total, share))
