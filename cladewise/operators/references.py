"""References to records that do not exist: a linear merge of references and validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladewise.operators.skew import copied, hot_keys, sliced

_FOREVER = "9999-12-31 23:59:59.999999"


def intervals(parents: DataFrame) -> DataFrame:
    """Validity intervals (field, key, since, until), one per start, each with a row of its key without a start and an end.

    Of rows that start together the one that ends last covers the others; no end counts as the end of the year 9999. The row
    without a start stands before all references in the merge and tells that the key has records.
    """
    kind = parents.schema["until"].dataType
    end = F.coalesce("until", F.lit(_FOREVER).cast(kind))
    own = parents.where("field is not null and key is not null").groupBy("field", "key", "since").agg(F.max(end).alias("until"))
    nothing = F.struct(F.lit(None).cast(parents.schema["since"].dataType).alias("since"), F.lit(None).cast(kind).alias("until"))
    return own.select("field", "key", F.explode(F.array(F.struct("since", "until"), nothing)).alias("x")).select("field", "key", "x.*")


def dangling(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose target isn't there when they are made: (field, id, key, at, reason).

    ``refs`` has (field, key, id, at), ``parents`` (field, key, since, until): a key exists from ``since`` until before
    ``until``, without end if that is null. Reasons: ``missing`` (no parent row at all), ``late`` (the first interval starts
    after the reference, or has no start), ``deleted`` (intervals started, all ended). References with a null key are none
    and don't come out; one with a null time is never covered. A parent row with a null start is never valid. Intervals
    that end before they start cover nothing. Repeated parent rows change nothing; repeated references all come out.

    Both streams are partitioned and sorted alike by (key, time) and merged in one pass, which keeps the latest end seen and
    whether the key has records; no partition is held.
    Keys with a thousandth of the references are spread over slices, each with the key's intervals; nothing else is copied.
    """
    refs = refs.where("field is not null and key is not null").select("field", "key", "id", "at")
    hot = hot_keys(refs, ["field", "key"])
    end = parents.schema["until"].dataType
    left = sliced(refs, hot, ["field", "key"], F.col("id")).select("field", "key", "_slice", "at", F.lit(1).alias("kind"), "id", F.lit(None).cast(end).alias("until"))
    right = copied(intervals(parents), hot, ["field", "key"]).select(
        "field", "key", "_slice", F.col("since").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(refs.schema["id"].dataType).alias("id"), "until"
    )
    group = Window.partitionBy("field", "key", "_slice").orderBy(F.asc_nulls_first("at"), "kind")
    started = F.when((F.col("kind") == 0) & F.col("at").isNotNull(), F.col("until"))
    running = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far, ever = F.max(started).over(running), F.min("kind").over(running)
    merged = left.unionByName(right).select("field", "id", "key", "at", "kind", so_far.alias("so_far"), ever.alias("ever"))
    reason = F.when(F.col("ever") == 1, "missing").when(F.col("so_far").isNull(), "late").otherwise("deleted")
    open_ref = F.col("so_far").isNull() | F.col("at").isNull() | (F.col("so_far") <= F.col("at"))
    return merged.where((F.col("kind") == 1) & open_ref).select("field", "id", "key", "at", reason.alias("reason"))


def dangling_report(found: DataFrame) -> DataFrame:
    """Dangling references per referenced table, month and reason: (field, month, reason, n). A null time has a null month."""
    month = F.date_format("at", "yyyy-MM")
    return found.groupBy("field", month.alias("month"), "reason").agg(F.count(F.lit(1)).alias("n"))
