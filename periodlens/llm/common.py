"""What several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these six ASCII separators; ``bytes.split()`` splits at exactly these.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A supplied table. Where the package is not installed, workers find it in the folder this one was imported from."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf}/{table}.parquet")


def narrow(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that other columns of a table can't clash: ``narrow(df, id="doc_id")``."""
    return docs.select(*[F.col(f"`{name}`").alias(alias) for alias, name in columns.items()])


def arrow_map(df: DataFrame, schema: str, rows: Callable[[list[list]], dict[str, object]]) -> DataFrame:
    """Map batches: ``rows`` gets the columns of a batch as Python lists and returns new columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in wanted], schema=wanted)

    return df.mapInArrow(run, schema)
