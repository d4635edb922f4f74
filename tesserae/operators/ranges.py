"""Reads by place and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_bounds(triples: DataFrame, north: float, south: float, east: float, west: float, lat: str = "geo.location.latitude", lon: str = "geo.location.longitude", limit: int = 100) -> DataFrame:
    """entity_id, lat, lon, truncated: entities inside a box, by id; a box whose east lies west of its west crosses the date line, and east may exceed 180."""
    value = lambda predicate: F.min(F.when(F.col("predicate") == predicate, F.col("object_num")))
    places = triples.where(F.col("predicate").isin(lat, lon)).groupBy(F.col("subject").alias("entity_id")).agg(value(lat).alias("lat"), value(lon).alias("lon"))
    turn = lambda x: (x + 540.0) % 360.0 - 180.0
    if east - west >= 360:
        inside = F.lit(True)
    elif turn(west) <= turn(east):
        inside = F.col("lon").between(turn(west), turn(east))
    else:
        inside = (F.col("lon") >= turn(west)) | (F.col("lon") <= turn(east))
    found = places.where(F.col("lat").between(south, north) & F.col("lon").isNotNull() & inside).orderBy("entity_id").limit(limit + 1)
    n = found.agg(F.count("*").alias("n_"))
    return found.orderBy("entity_id").limit(limit).crossJoin(F.broadcast(n)).select("entity_id", "lat", "lon", (F.col("n_") > limit).alias("truncated"))


def changed_between(triples: DataFrame, start: Column, end: Column) -> DataFrame:
    """entity_id, updated_at: entities whose latest statement lies in the range, both ends included."""
    return triples.groupBy(F.col("subject").alias("entity_id")).agg(F.max("ts").alias("updated_at")).where(F.col("updated_at").between(start, end))
