"""Small driver-side results as DataFrames, built in the JVM.

``spark.createDataFrame(list)`` without Arrow ships the rows through a Python
worker. The results built here (report lines, KPI rows, per-column
statistics, chart metadata) are a few rows each, so they go to Spark as
one JSON string literal read with ``from_json``; the optimizer folds it, and
``inline`` turns it into rows with no Python on the executors.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
LTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"
JSON_OPTIONS = {"timestampNTZFormat": NTZ_FORMAT, "timestampFormat": LTZ_FORMAT,
                "allowNonNumericNumbers": "true"}


def parse_schema(schema: str | T.DataType) -> T.DataType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def jsonable(v, dt: T.DataType):
    """A Python value of Spark type ``dt`` as JSON that ``from_json`` reads back exactly."""
    if v is None:
        return None
    if isinstance(dt, T.StructType):
        vals = v if isinstance(v, (tuple, list)) else [v[f.name] for f in dt.fields]
        return {f.name: jsonable(x, f.dataType) for f, x in zip(dt.fields, vals)}
    if isinstance(dt, T.ArrayType):
        return [jsonable(x, dt.elementType) for x in v]
    if isinstance(dt, T.TimestampType):
        # naive values are UTC wall time here (the library creates them that way)
        if v.tzinfo is not None:
            from datetime import timezone
            v = v.astimezone(timezone.utc).replace(tzinfo=None)
        return v.strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"
    if isinstance(dt, (T.TimestampNTZType, T.DateType)):
        return v.isoformat()
    if isinstance(dt, T.DecimalType):
        return str(v)          # from_json reads a decimal's text exactly
    return v


def array_literal(values: Sequence, dtype: T.DataType) -> Column:
    """One typed array literal for many driver-side values (folded by the optimizer)."""
    payload = json.dumps([jsonable(v, dtype) for v in values], allow_nan=True)
    return F.from_json(F.lit(payload), T.ArrayType(dtype, True), JSON_OPTIONS)


def rows_frame(spark: SparkSession, rows: Sequence, schema: str | T.StructType) -> DataFrame:
    """A DataFrame of ``rows`` (tuples in schema order) built in the JVM."""
    st = parse_schema(schema)
    arr = array_literal([tuple(r) for r in rows], st)
    return spark.range(0, 1, 1, 1).select(F.inline(arr)).select(
        *[F.col("`" + f.name.replace("`", "``") + "`") for f in st.fields])
