"""Links between events and the records that report them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sibling_links(links: DataFrame) -> DataFrame:
    """(event_id, link, others, least_source) of every distinct (event_id, link, source): the event's other links and the least source among them.

    Rows that repeat a link are no siblings of each other; their others are added up. Of each event three figures suffice: its rows, and its two
    smallest (source, link); a link's least sibling is the first of them that is not itself. The two are picked by a limited
    rank, of which every task passes on two rows an event at most, so no two links of an event are joined with each other. Rows without
    event are left out.
    """
    own = links.where("event_id is not null").groupBy("event_id", "link", "source").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("source", "link"))
    least = own.select("event_id", "source", "link").withColumn("rank", rank).where("rank <= 2")
    two = least.groupBy("event_id").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("source", "link"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("source"))).alias("second")
    )
    events = own.groupBy("event_id").agg(F.sum("n").alias("rows")).join(two, "event_id")
    joined = own.join(events, "event_id")
    is_first = F.col("source").eqNullSafe(F.col("first.source")) & F.col("link").eqNullSafe(F.col("first.link"))
    return joined.select("event_id", "link", ((F.col("rows") - F.col("n")) * F.col("n")).alias("others"), F.when(is_first, F.col("second")).otherwise(F.col("first.source")).alias("least_source"))
