"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys are hashed to a fixed number of places on the ring. The documents at a place go to
the shard of the next virtual node clockwise that still has room, the largest places
first. No shard may hold more than (1 + SLACK) of the mean, so sizes are near equal, and
keys that fit where the ring sends them stay there when shards come or go. The driver
sees the size of each place, at most PLACES rows whatever the number of documents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.frames import small_frame
from plumbline.sources.shared import written

SHARDS = 8
VIRTUAL_NODES = 256
PLACES = 1 << 16
SLACK = 0.001


def ring_nodes(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in clockwise order, positions in 60 bits."""
    return sorted(
        (int(hashlib.md5(f"{shard}#{k}".encode()).hexdigest()[:15], 16), shard)
        for shard in range(n_shards)
        for k in range(virtual_nodes)
    )


def walk(
    sizes: dict[int, int],
    n_shards: int,
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = SLACK,
    places: int = PLACES,
) -> dict[int, int]:
    """Shard of each place. A place that fits nowhere goes to the emptiest shard."""
    nodes = ring_nodes(n_shards, virtual_nodes)
    positions = [p for p, _ in nodes]
    limit = (1 + slack) * sum(sizes.values()) / n_shards
    loads = [0] * n_shards
    shard_of = {}
    for place, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = bisect_right(positions, place * ((1 << 60) // places))
        refused: set[int] = set()
        chosen = None
        for k in range(len(nodes)):
            shard = nodes[(at + k) % len(nodes)][1]
            if shard in refused:
                continue
            if loads[shard] + size <= limit:
                chosen = shard
                break
            refused.add(shard)
            if len(refused) == n_shards:
                break
        if chosen is None:
            chosen = min(range(n_shards), key=lambda s: (loads[s], s))
        loads[chosen] += size
        shard_of[place] = chosen
    return shard_of


def sharded(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n_shards: int = SHARDS,
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = SLACK,
    places: int = PLACES,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    ``size`` is the text's length in UTF-8 bytes plus one, ``law`` is ``bytes``: shard sizes
    are near equal, as far as single places allow. Slots number the rows of a shard from 0
    without gaps. ``grown_shard`` is NULL: bounded loads move a few keys between old shards
    too when one is added. Rows that share an id stay together; rows without id are keyed by
    their text. NULL text has no bytes. No rows give no rows; other columns are not read.
    """
    text = F.coalesce(col(text_column).cast("string"), F.lit(""))
    data = F.encode(text, "UTF-8")
    key = F.coalesce(
        col(id_column).cast("string"), F.concat(F.lit("text "), F.md5(data))
    )
    digits = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
    rows = written(
        docs.select(
            col(id_column).cast("bigint").alias("id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.shiftright(digits, 60 - (places.bit_length() - 1)).alias("place"),
            F.xxhash64(text).alias("tie"),
        ),
        "keys",
    )
    held = rows.groupBy("place").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    shard_of = walk({r["place"]: r["size"] for r in held}, n_shards, virtual_nodes, slack, places)
    starts, filled = [], [0] * n_shards
    for place, n in sorted((r["place"], r["n"]) for r in held):
        shard = shard_of[place]
        starts.append((place, shard, filled[shard]))
        filled[shard] += n
    schema = pa.schema([("place", pa.int64()), ("shard", pa.int32()), ("start", pa.int64())])
    # At most PLACES rows of 20 bytes.
    where = F.broadcast(small_frame(docs.sparkSession, starts, schema))
    inside = Window.partitionBy("place").orderBy("id", "size", "text_crc32", "tie")
    return (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(where, "place")
        .select(
            F.col("id").alias(id_column),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("at")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
