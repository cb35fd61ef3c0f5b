"""Row-by-row machines over sorted partitions.

A machine sees the rows of one key in order and says something about each from the little that
it remembers, such as which group a row belongs to. It never holds rows, so a key of any size
streams through a task, and what it says becomes a column for ordinary aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def run_machine(frame: DataFrame, keys: Sequence[str], order: Sequence[str], reads: Sequence[str], machine: Callable[[], Callable[..., tuple]], adds: str, ready: bool = False) -> DataFrame:
    """frame with the columns `adds` (a schema string): for each row what the key's machine returns for the values of `reads`. ready: the rows of each key already lie together in order, as a window over the same keys and order leaves them."""
    schema = StructType([*frame.schema.fields, *StructType.fromDDL(adds).fields])
    arrow = to_arrow_schema(schema)
    added = len(arrow.names) - len(frame.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            own = zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys))
            rows = zip(*(batch.column(batch.schema.get_field_index(r)).to_pylist() for r in reads))
            said = []
            for key, row in zip(own, rows):
                if step is None or key != now:
                    now, step = key, machine()
                said.append(step(*row))
            columns = zip(*said) if said else [()] * added
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[-added:]))], names=arrow.names)

    placed = frame if ready else frame.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, schema)
