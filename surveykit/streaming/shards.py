"""Many small keys in one state: a task that turns to each key by itself pays several round trips to its state per key.

Keys are dealt over a fixed number of shards by their hash. A shard's rows come as one frame, with the key as text in
column ``key``, and its state is one Arrow table, so the price of a key is that of its rows. A shard holds the waiting
rows and the facts of ``1 / SHARDS`` of the keys; the number is part of a checkpoint and can't change afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

SHARDS = 256


def dealt(df: DataFrame, keys: Sequence[str], *columns: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """``shard``, ``key`` and ``columns``; rows of one key, or of one key and ``by``, share a shard."""
    key = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    rows = df.select(key.alias("key"), *columns)
    return rows.select(F.pmod(F.xxhash64("key", *by), F.lit(SHARDS)).cast("int").alias("shard"), "*")


def undealt(df: DataFrame, key_ddl: str) -> DataFrame:
    """The key columns again in place of ``key``."""
    parts = F.from_json("key", "array<string>")
    names = [parts[i].cast(f.dataType).alias(f.name) for i, f in enumerate(StructType.fromDDL(key_ddl))]
    return df.select(*names, *[c for c in df.columns if c != "key"])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()
