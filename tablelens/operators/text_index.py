"""Text index for search (C5): per file a bit field of the trigrams its cells hold.

A search needs every cell of every row. The index is built once over a table in
the loader's file order; a search then opens only files whose bit field has all
trigrams of the needle. Files are never missed (a field can only have bits too
many), and the rows that the open files hold are tested as without an index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import order_columns
from ..session import ensure_checkpoint_dir, release
from .explore import cell_texts, search_rows

#: Bits of a file's field: 2 MB; some 16 million different trigrams of bytes exist.
BITS = 24


def _trigrams(data: bytes) -> np.ndarray:
    """The places of the byte trigrams of a text in a field."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    return (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, dtype=np.uint32)


def _fields(bits: int):
    """Text cells of rows to bit fields: (file, part, bits as bytes), a part of
    32,768 bits each; only parts with a bit set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, field = None, None

        def emit():
            parts = field.reshape(-1, 4096)
            at = np.flatnonzero(parts.any(axis=1))
            return pa.record_batch([pa.array([file] * len(at), pa.string()), pa.array(at, pa.int32()),
                                    pa.array([parts[i].tobytes() for i in at], pa.binary())], names=["file", "part", "bits"])

        def add(texts):
            # cells are joined by a byte that no text has, so trigrams over it are not asked for
            b = np.frombuffer(b"\xff".join(t.encode("utf-8", "surrogatepass") for t in texts if t), dtype=np.uint8).astype(np.uint32)
            if len(b) > 2:
                place = np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:])
                np.bitwise_or.at(field, place >> 3, (1 << (place & 7)).astype(np.uint8))

        for batch in batches:
            names = batch.column(0)
            for name in names.unique().to_pylist():
                if name != file:
                    if file is not None:
                        yield emit()
                    file, field = name, np.zeros(1 << (bits - 3), dtype=np.uint8)
                rows = batch.filter(pa.compute.equal(names, name))
                for column in rows.columns[1:]:
                    add(column.to_pylist())
        if file is not None:
            yield emit()

    return run


def _has_bit(bit: int):
    """Whether a part of a field has a bit set."""
    return lambda b: F.conv(F.hex(F.substring(b, (bit >> 3) + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(1 << (bit & 7))) > 0


@dataclass
class TextIndex:
    spark: SparkSession
    path: str

    def release(self) -> bool:
        return release(self.spark, self.path)

    def files(self, text: str) -> list[str] | None:
        """The files that may hold ``text`` (None: any, for a text of under three
        bytes). Only the parts of the fields that the needle asks for are read."""
        places = sorted(set(_trigrams(text.lower().encode()).tolist()))
        if not places:
            return None
        parts: dict[int, list[int]] = {}
        for p in places:
            parts.setdefault(p >> 15, []).append(p & 0x7FFF)
        stored = self.spark.read.parquet(self.path).where(F.col("part").isin(list(parts)))
        # a file read in several tasks has several fields
        one = stored.groupBy("file", "part").agg(F.collect_list("bits").alias("all"))
        ok = F.lit(True)
        for part, bits in parts.items():
            for bit in bits:
                ok = ok & ((F.col("part") != part) | F.exists("all", _has_bit(bit)))
        found = one.where(ok).groupBy("file").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(parts))
        return sorted(r["file"] for r in found.collect())

    def search(self, df: DataFrame, text: str) -> DataFrame:
        """``search_rows`` over the files that may hold the text; ``df`` is the table
        the index was built from."""
        names = self.files(text)
        if names is not None:
            df = df.where(F.col(f"`{order_columns(df)[0]}`").isin(names))
        return search_rows(df, text)


def build_text_index(df: DataFrame, path: str | None = None) -> TextIndex:
    """The index of a table in the loader's file order, written under ``path`` or
    the checkpoint folder: at most 2 MB per file and task that reads it."""
    marked = order_columns(df)
    if not marked:
        raise ValueError("a text index needs a table of load_table")
    spark = df.sparkSession
    path = (path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablelens-text-{uuid.uuid4().hex}").rstrip("/")
    texts = [F.lower(t).alias(f"t{i}") for i, t in enumerate(cell_texts(df).values())]
    fields = df.select(F.col(f"`{marked[0]}`").alias("file"), *texts).mapInArrow(_fields(BITS), "file string, part int, bits binary")
    fields.write.parquet(path)
    return TextIndex(spark, path)
