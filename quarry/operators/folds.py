"""Folds over the rows of each key, in order, that hold one batch of rows and the state of one key at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], Callable], name: str, kind: str) -> DataFrame:
    """`rows` with one more column: what `start()`, called for each key, says to the key's rows in turn (the values of `order`).

    The rows of a key come to one task sorted, and are read there batch by batch; the sort spills, so a key may have any
    number of rows. Nulls are first, and null is a key."""

    def run(batches):
        now, step = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, *order)]
            said = []
            for k, *values in zip(*columns, strict=True):
                if step is None or k != now:
                    now, step = k, start()
                said.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, {"long": pa.int64(), "boolean": pa.bool_()}[kind])], [*batch.schema.names, name])

    schema = StructType([*rows.schema.fields]).add(name, kind)
    # by a hash: Spark leaves out a repartition by what a join before it has dealt by, and may then split a large key
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)
