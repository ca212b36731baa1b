"""Row numbering, joins and ordered concatenation that survive hot keys.

A single key may hold a large share of all rows. Nothing here puts such a group
into one task: rows are numbered over ranges that may cut a key, and joins split
only hot keys, whose list is short by construction (a key must hold at least
``1/HOT_KEYS`` of all rows).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from plumbline.session import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its task functions travel with the job

HOT_KEYS = 1000          # a hot key holds at least 1/1000 of the rows: at most 1000 of them
HOT_ROWS = 1_000_000     # and at least this many rows, so small tables never split
BLOCK_ROWS = 10_000      # rows concatenated into one value


def _key_changes(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """Per row, whether its key differs from the row above; ``before`` is the key of the
    row above the first one, None where there is none."""
    n = len(columns[0])
    same = np.ones(n - 1, bool)
    for c in columns:
        up, down = c.slice(0, n - 1), c.slice(1)
        alike = pc.fill_null(pc.equal(up, down), False)
        tests = [pc.is_null] + [pc.is_nan] * pa.types.is_floating(c.type)  # each is one key
        for test in tests:
            alike = pc.or_(alike, pc.fill_null(pc.and_(test(up), test(down)), False))
        same &= alike.to_numpy(zero_copy_only=False)
    first = before is None or repr(before) != repr(_key_at(columns, 0))
    return np.concatenate(([first], ~same))


def _key_at(columns: list[pa.Array], row: int) -> tuple:
    return tuple(c[row].as_py() for c in columns)


def _numbered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one task with ``_at`` (task and place), ``_pos`` (place within the
    key inside the task) and ``_first`` (whether the key is the task's first)."""
    at = TaskContext.get().partitionId() << 33
    before, count, on_first = None, 0, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k) for k in keys]
        new = _key_changes(columns, before) if keys else np.zeros(n, bool)
        new[0] &= before is not None  # the task's first row goes on from zero rows
        rows = np.arange(n)
        start = np.maximum.accumulate(np.where(new, rows, -1))
        pos = np.where(start < 0, rows + count, rows - start) + 1
        first = (start < 0) if on_first else np.zeros(n, bool)
        on_first = on_first and bool(first[-1])
        before, count = _key_at(columns, n - 1), int(pos[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(at + rows), pa.array(pos.astype(np.int64)), pa.array(first)],
            [*batch.schema.names, "_at", "_pos", "_first"])
        at += n


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str, cut_by: int | None = None) -> DataFrame:
    """Add ``out`` (bigint): the 1-based position of each row within ``keys`` in ``order``.

    One sampled range sort by (keys, order), whatever the sizes of the keys: a key may
    lie in many tasks. Each task numbers its own rows; a key that goes on from the task
    before is shifted by what came there. That shift is one number per task, found from
    one row per task, so nothing else passes the driver and no join brings it back.

    ``cut_by``: ranges are cut by the first so many columns of ``order`` only (all, if not
    given); cheaper where these leave few rows alike.

    Null is a key like any other and sorts first; no keys means one group. Rows equal in
    keys and order are numbered in any order; an empty table stays empty. Keys are columns
    of plain types. The numbered rows are kept on shared storage.
    """
    schema = StructType([*df.schema, StructField("_at", LongType()), StructField("_pos", LongType()),
                         StructField("_first", BooleanType())])
    ordered = df.repartitionByRange(*keys, *order[:cut_by]).sortWithinPartitions(*keys, *order)
    rows = saved(ordered.mapInArrow(lambda batches: _numbered(batches, keys), schema))
    key = F.struct(F.lit(0), *keys)
    tasks = (rows.groupBy(F.shiftright("_at", 33).alias("task"))
             .agg(F.min_by(key, "_at").alias("head"), F.max_by(key, "_at").alias("tail"),
                  F.max_by("_first", "_at").alias("whole"), F.max_by("_pos", "_at").alias("run"))
             .orderBy("task").collect())
    shift, open_key, length = {}, None, 0
    for t in tasks:
        start = length if repr(t["head"]) == open_key else 0
        if start:
            shift[t["task"]] = start
        open_key, length = repr(t["tail"]), t["run"] + (start if t["whole"] else 0)
    position = F.col("_pos")
    if shift:
        per_task = F.lit([shift.get(t, 0) for t in range(max(shift) + 1)]).cast("array<bigint>")
        task = F.shiftright("_at", 33).cast("int")
        position = position + F.when(F.col("_first"), F.coalesce(F.get(per_task, task), F.lit(0))).otherwise(0)
    return rows.withColumn(out, position).drop("_at", "_pos", "_first")


def has_large_group(df: DataFrame, keys: list[str]) -> bool:
    """Does a key hold more than HOT_ROWS rows?"""
    return bool(df.groupBy(*keys).count().where(F.col("count") > HOT_ROWS).limit(1).count())


def number_small_groups(df: DataFrame, keys: list[str], order: list[str], out: str, cut_by: int | None = None,
                        large: bool | None = None) -> DataFrame:
    """``number_rows``, at less cost where no key holds more than HOT_ROWS rows (one count of
    the keys tells): a task then sorts and numbers whole keys, in one shuffle and without
    sampling, and a join or grouping by the keys that follows needs no other. With a larger
    key all rows go through ``number_rows``. ``large``: what ``has_large_group`` says, if known."""
    if has_large_group(df, keys) if large is None else large:
        return number_rows(df, keys, order, out, cut_by)
    within = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(within).cast("bigint"))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], rows_col: str,
                row_id: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``left`` to a ``right`` holding one row per key.

    ``rows_col`` of ``right`` is the number of left rows of that key. Rows of the
    (at most HOT_KEYS) hot keys meet their partner by broadcast; the others by a
    shuffle in which the hot rows are spread over all tasks.
    """
    cols = [c for c in right.columns if c not in keys]
    total = right.agg(F.sum(rows_col).alias("_total"))
    hot = (right.filter(F.col(rows_col) >= hot_rows)
           .join(F.broadcast(total), F.col(rows_col) * HOT_KEYS >= F.col("_total"))
           .select(*keys, F.struct(*cols).alias("_hot")))
    rest = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                        F.lit(0).cast("long").alias("_r_spread"), F.struct(*cols).alias("_rest"))
    tagged = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_spread", F.when(F.col("_hot").isNotNull(),
                          F.shiftrightunsigned(F.xxhash64(*row_id), 1) + 1).otherwise(F.lit(0)))
    on = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_spread") == F.col("_r_spread")]
    met = tagged.join(rest, on, "left")
    pair = F.coalesce("_hot", "_rest")
    return (met.withColumn("_pair", pair).filter(F.col("_pair").isNotNull())
               .select(*left.columns, *[F.col("_pair")[c].alias(c) for c in cols]))


def by_label_block(label_no) -> Column:
    """Join salt of a label: dense label numbers cut into blocks."""
    return F.floor((F.col(label_no) - 1) / F.lit(HOT_ROWS)).cast("int")


def spread_over_blocks(per_case: DataFrame, last_label_no: str) -> DataFrame:
    """Repeat a per-case row once per block of its labels (once for usual cases)."""
    last = F.greatest(by_label_block(last_label_no), F.lit(0))
    return per_case.withColumn("_block", F.explode(F.sequence(F.lit(0), last)))


def ordered_concat(df: DataFrame, keys: list[str], position: str, value: str, separator: str,
                   out: str, block_rows: int | None = None) -> DataFrame:
    """Join values in position order, one row per ``block_rows`` (or BLOCK_ROWS) positions.

    Usual groups fit block 0 and give the one joined value; larger groups go on
    in further blocks, so no group is gathered beyond ``block_rows`` values.
    Positions count from 1 and are unique within the keys.
    """
    block = F.floor((F.col(position) - 1) / F.lit(block_rows or BLOCK_ROWS)).cast("int")
    pairs = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).cast("string").alias("v"))))
    return (df.groupBy(*keys, block.alias("block_no"))
              .agg(pairs.alias("_pairs"))
              .withColumn(out, F.array_join(F.col("_pairs")["v"], separator))
              .drop("_pairs"))
