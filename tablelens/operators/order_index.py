"""Stored order index (C6, W3, W3b): a table kept in one order, with positions.

The table is written once in range buckets of the order (``order.GlobalOrder``), each
bucket sorted, with every row's position beside it; the rows of each bucket are
counted. A page or a sample then opens only the buckets that hold its positions:
no sampling, no counting, no bucket boundaries again, and no shuffle of rows.

The index knows the files it was built from (paths, lengths, times of change).
``open_order_index`` refuses one whose table has changed since.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import array_literal, rows_frame
from ..session import ensure_checkpoint_dir, release
from .order import BUCKET, GlobalOrder, _prefix, default_order

POSITION = "_position"


def table_fingerprint(df: DataFrame) -> str | None:
    """Digest of the files behind a table (path, length, time of change); None if
    it has none. Only file metadata is read."""
    spark = df.sparkSession
    paths = sorted(df.inputFiles(), key=str.encode)
    if not paths:
        return None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha256()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(p))
        status = path.getFileSystem(conf).getFileStatus(path)
        h.update(f"{p}\0{status.getLen()}\0{status.getModificationTime()}\n".encode())
    return h.hexdigest()


@dataclass
class OrderIndex:
    """``path`` holds the folder ``rows`` (one subfolder per bucket) and ``layout``."""

    spark: SparkSession
    path: str
    columns: list[str]
    order: list[str]
    counts: list[int]
    fingerprint: str | None
    schema: T.StructType

    @property
    def n_rows(self) -> int:
        return sum(self.counts)

    def release(self) -> bool:
        """Delete the index."""
        return release(self.spark, self.path)

    def buckets_of(self, positions: Sequence[int]) -> list[int]:
        """The buckets that hold the positions."""
        starts, out, b = _prefix(self.counts), [], 0
        for p in sorted(positions):
            while b < len(self.counts) and p >= starts[b] + self.counts[b]:
                b += 1
            if b < len(self.counts) and p >= 0 and (not out or out[-1] != b):
                out.append(b)
        return out

    def rows(self, positions: Sequence[int]) -> DataFrame:
        """The rows at 0-based positions of the order, with ``_position``; only
        their buckets are opened."""
        positions = sorted({int(p) for p in positions})
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").where(F.col(BUCKET).isin(self.buckets_of(positions)))
        if positions and positions[-1] - positions[0] + 1 == len(positions):
            wanted = F.col(POSITION).between(positions[0], positions[-1])
        else:
            wanted = F.col(POSITION).isin(positions)
        return stored.where(wanted).select(*[F.col(f"`{c}`") for c in self.columns], POSITION)

    def page(self, page_no: int, size: int = 15) -> DataFrame:
        """One page of the order, in order."""
        at = range(page_no * size, min((page_no + 1) * size, self.n_rows))
        return self.rows(at).orderBy(POSITION).drop(POSITION)

    def sample(self, points: int = 50, limit: int | None = None) -> DataFrame:
        """Every ``step``-th row, ``step = max(1, n // points)`` (the first
        ``limit`` of them), with ``idx``, its position."""
        at = list(range(0, self.n_rows, max(1, self.n_rows // points)))[:limit]
        return self.rows(at).withColumnRenamed(POSITION, "idx")


def build_order_index(df: DataFrame, order: Sequence[str] | str | None = None, path: str | None = None,
                      buckets: int | None = None) -> OrderIndex:
    """Write the index of a table by ``order`` (a unique key; nulls first), under
    ``path`` or the checkpoint folder. A column named ``_position`` or ``_bucket`` is refused."""
    if {POSITION, BUCKET} & set(df.columns):
        raise ValueError(f"rename the columns {POSITION} and {BUCKET}")
    spark, order = df.sparkSession, default_order(df, order)
    path = (path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablelens-order-{uuid.uuid4().hex}").rstrip("/")
    go = GlobalOrder.build(df, order, buckets=buckets)
    counts = go.bucket_counts()
    local = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*[F.col(f"`{c}`") for c in order]))
    placed = go.dealt(go.with_bucket()).withColumn(
        POSITION, (F.element_at(array_literal(_prefix(counts), T.LongType()), F.col(BUCKET) + 1) + local - 1).cast("long"))
    placed.write.partitionBy(BUCKET).parquet(f"{path}/rows")        # a bucket is one task, so one sorted file
    fingerprint = table_fingerprint(df)
    layout = json.dumps({"columns": df.columns, "order": order, "counts": counts, "fingerprint": fingerprint,
                         "schema": placed.schema.json()})
    rows_frame(spark, [(layout,)], "layout string").write.parquet(f"{path}/layout")
    return OrderIndex(spark, path, df.columns, order, counts, fingerprint, placed.schema)


def open_order_index(spark: SparkSession, path: str, table: DataFrame | None = None) -> OrderIndex:
    """An index written earlier. With ``table``, one that was built from other
    files, or before they changed, is refused (ValueError)."""
    path = path.rstrip("/")
    meta = json.loads(spark.read.parquet(f"{path}/layout").first()["layout"])
    if table is not None and table_fingerprint(table) != meta["fingerprint"]:
        raise ValueError("the table has changed since the index was built")
    return OrderIndex(spark, path, meta["columns"], meta["order"], meta["counts"], meta["fingerprint"],
                      T.StructType.fromJson(json.loads(meta["schema"])))
