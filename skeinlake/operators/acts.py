"""What users do to documents: a log of acts, and documents as the acts leave them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Acts (doc_id, act, until, at, seq); seq tells apart what has one time.
ACTS = "doc_id bigint, act string, until timestamp, at timestamp, seq bigint"
KINDS = ("pin", "unpin", "snooze", "unsnooze", "forget", "restore", "touch")


def applied(docs: DataFrame, acts: DataFrame) -> DataFrame:
    """``docs`` after the acts: of each pair of opposite acts on a document the last counts.

    pin and unpin set ``pinned``; snooze sets ``snoozed_until`` to the act's
    ``until`` and unsnooze ends it; forget and restore set ``active``; touch adds
    one to ``access_count`` and moves ``last_accessed_at`` on.  Acts on ids that
    aren't there, and unknown acts, do nothing.  A document with any number of
    acts is one row of partial aggregates.
    """
    order = F.struct("at", "seq")

    def last(*kinds: str) -> Column:
        mine = F.col("act").isin(*kinds)
        return F.max_by(F.when(mine, F.struct("act", "until")), F.when(mine, order))

    touched = F.col("act") == "touch"
    sums = acts.groupBy(F.col("doc_id").alias("id")).agg(last("pin", "unpin").alias("_pin"), last("snooze", "unsnooze").alias("_snooze"), last("forget", "restore").alias("_forget"), F.count_if(touched).alias("_touches"), F.max(F.when(touched, F.col("at"))).alias("_touched"))
    both = docs.join(sums, "id", "left")
    return both.withColumns(
        {
            "pinned": F.when(F.col("_pin").isNull(), F.col("pinned")).otherwise(F.col("_pin.act") == "pin"),
            "snoozed_until": F.when(F.col("_snooze").isNull(), F.col("snoozed_until")).when(F.col("_snooze.act") == "snooze", F.col("_snooze.until")),
            "active": F.when(F.col("_forget").isNull(), F.col("active")).otherwise(F.col("_forget.act") == "restore"),
            "access_count": F.col("access_count") + F.coalesce("_touches", F.lit(0)),
            "last_accessed_at": F.greatest("last_accessed_at", "_touched"),
        }
    ).select(*docs.columns)
