"""Small driver-side results as DataFrames.

An Arrow table becomes a local relation that Spark evaluates on the driver,
whatever the session's Arrow setting, so projections of per-column facts cost
no job. Only for results bounded by the schema (columns, column pairs), never
for data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def local_frame(spark: SparkSession, rows, schema: str | StructType) -> DataFrame:
    """``rows`` as a DataFrame; numpy scalars count as the Python values they hold."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = [tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows]
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(st.fields)]
    table = pa.Table.from_arrays(columns, schema=pa.schema([(f.name, c.type) for f, c in zip(st.fields, columns)]))
    return spark.createDataFrame(table, st)
