"""Choice of the edge that serves a client."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import region_from_ip


def edge_for(requests: DataFrame, edges: DataFrame, default_id: str, default_url: str) -> DataFrame:
    """Adds the edge named by ``edge_id``, else the edge of the client's region, else the default.

    ``edges`` has edge_id, region and url. Of several edges with one id (in any case) or one region, that
    with the least edge_id is meant.
    """
    ids = edges.groupBy(F.lower("edge_id").alias("_id_key")).agg(F.min(F.struct("edge_id", "region", "url")).alias("e"))
    regions = edges.groupBy("region").agg(F.min(F.struct("edge_id", "url")).alias("e"))
    by_id = ids.select("_id_key", F.col("e.edge_id").alias("_id"), F.col("e.region").alias("_id_region"), F.col("e.url").alias("_id_url"))
    by_region = regions.select(F.col("region").alias("_region"), F.col("e.edge_id").alias("_region_id"), F.col("e.url").alias("_region_url"))
    rows = requests.withColumn("_id_key", F.lower(F.trim("edge_id"))).withColumn(
        "_region", region_from_ip(F.col("client_ip"))
    )
    rows = rows.join(by_id, "_id_key", "left").join(by_region, "_region", "left")
    named = F.col("_id").isNotNull()
    return rows.select(
        *requests.columns,
        F.coalesce("_id", "_region_id", F.lit(default_id)).alias("chosen_edge"),
        F.when(named, F.col("_id_region")).otherwise(F.col("_region")).alias("chosen_region"),
        F.coalesce("_id_url", F.when(~named, F.col("_region_url")), F.lit(default_url)).alias("chosen_url"),
    )
