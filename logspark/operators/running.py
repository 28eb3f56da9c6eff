"""Running sums along the rows of a key, in one exchange, however many rows the key has.

Rows are sorted by range of key and order, so a key with many rows lies in many parts, cut where its rows are, not by
time. Each part is summed in one pass over its batches; what a key brings along from the parts before it is known from
one row a part.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut_lineage, send_code_of

_BORDER = "part INT, first_key STRING, last_key STRING, first_sum BIGINT, first_reset BOOLEAN, last_sum BIGINT, last_reset BOOLEAN, single BOOLEAN"


class _Scan:
    """Sums since the last reset of the key, batch after batch."""

    def __init__(self, key=None, total: int = 0):
        self.key, self.total = key, total
        self.reset = False  # was there a reset in the key's rows so far

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        keys = batch.column("_key")
        value = batch.column("_value").to_numpy(zero_copy_only=False)
        reset = batch.column("_reset").to_numpy(zero_copy_only=False).astype(bool)
        n = len(value)
        opens = np.ones(n, bool)
        opens[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        opens[0] = keys[0].as_py() != self.key
        total = np.cumsum(value)
        base = np.where(reset, total, total - value)
        last = np.maximum.accumulate(np.where(reset | opens, np.arange(n), -1))
        out = np.where(last >= 0, total - base[last], total + self.total)
        self.key, self.total = keys[n - 1].as_py(), int(out[-1])
        start = np.flatnonzero(opens)[-1] if opens.any() else 0
        self.reset = bool(reset[start:].any()) or (not opens.any() and self.reset)
        return out


def _border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a part: its first and last key with the sums at the end of their rows, were they alone."""
    scan, first, part = _Scan(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("_key")
        if part is None:
            part, first_key, first_sum, first_reset, single = batch.column("_part")[0].as_py(), keys[0].as_py(), 0, False, True
        if single:
            own = pc.equal(keys, first_key).to_numpy(zero_copy_only=False)
            count = int(own.sum())
            if count:
                scan(batch.slice(0, count))
                first_sum, first_reset = scan.total, scan.reset
            single = count == batch.num_rows
            batch = batch.slice(count)
        if batch.num_rows:
            scan(batch)
    if part is not None:
        row = (part, first_key, scan.key, first_sum, first_reset, scan.total, scan.reset, single)
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_()]
        names = [f.split()[0] for f in _BORDER.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


def _carried(borders: list) -> dict[int, tuple[str, int]]:
    """Key and sum that each part starts with, where its first key comes from the part before."""
    out, key, total = {}, None, 0
    for b in sorted(borders, key=lambda b: b.part):
        brought = total if b.first_key == key else 0
        if b.first_key == key:
            out[b.part] = (key, brought)
        key = b.last_key
        total = b.last_sum + (brought if b.single and not b.first_reset else 0)
    return out


def running_sum(df: DataFrame, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows of ``df`` with the running sum at each.

    ``rows`` has the columns ``_key`` STRING, ``_value`` BIGINT, ``_reset`` BOOLEAN (the sum starts again behind the row),
    those named in ``order``, and ``_row``: the row of ``df`` as a struct, or null for a row that only counts.
    """
    sort = ["_key", *order]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id())
    placed = cut_lineage(placed.select("_part", "_key", "_value", "_reset", "_row"))
    carried = {}
    if placed.rdd.getNumPartitions() > 1:
        carried = _carried(placed.drop("_row").mapInArrow(_border, _BORDER).collect())  # one row a part

    names = [*df.columns, name]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if scan is None:
                scan = _Scan(*carried.get(batch.column("_part")[0].as_py(), (None, 0)))
            sums = pa.array(scan(batch), pa.int64())
            row = batch.column("_row")
            real = row.is_valid()
            yield pa.RecordBatch.from_arrays([*row.filter(real).flatten(), sums.filter(real)], names=names)

    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields], T.StructField(name, T.LongType())])
    return placed.mapInArrow(add, schema)


def one_key(keys: list[str]) -> Column:
    """The key columns as one text."""
    return F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})


send_code_of(sys.modules[__name__])
