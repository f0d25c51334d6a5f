"""User functions over rows and partitions, run as Arrow batches.

A function of whole keys gets each key in exactly one call, however many rows
it has (``map_by_key``, ``map_aligned``); ``map_aligned_batches`` hands a side of
any length over batch by batch. A function of parts gets two slices of every key
and more of a large one, up to a declared number, and a second aggregation merges
what it returns (``collect_udaf``), so one hot key never lands in one task whole.
A function returns a frame or, much cheaper for few rows, a dict of columns.
"""

from __future__ import annotations

import math
import queue
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import chain, groupby
from operator import and_, itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lakeloom.operators.sets import union_branches
from lakeloom.session import materialize, shuffle_partitions

OUTCOME = "idx bigint, ok boolean, value string, error string, attempts int"
#: Most parts of a key that a partial function sees, and rows that are a part of their own.
SLICES, SLICE_ROWS = 64, 10_000

#: What a user function returns: a frame, or a dict of columns, which costs far less for few rows.
Result = pd.DataFrame | Mapping[str, Sequence]


def _length(result: Result) -> int:
    return len(result) if isinstance(result, pd.DataFrame) else max(map(len, result.values()), default=0)


def _stacked(results: Sequence[Result], names: Sequence[str]) -> pd.DataFrame:
    """Results of one row and more one below the other."""
    if all(isinstance(r, pd.DataFrame) for r in results):
        return pd.concat(results, ignore_index=True)[names]
    columns = {}
    for name in names:
        values = [r[name] for r in results]
        if all(isinstance(v, np.ndarray) for v in values):
            columns[name] = np.concatenate(values)
        else:
            # as objects, so that integers beside nulls stay integers
            columns[name] = pd.Series(list(chain.from_iterable(values)), dtype=object)
    return pd.DataFrame(columns)


def _by_group(
    df: DataFrame,
    group: Sequence[str],
    columns: Sequence[str],
    call: Callable[[tuple, pd.DataFrame], Result],
    schema: StructType | str,
) -> DataFrame:
    """``call(group_key, rows)`` per group, rows as ``columns``, many groups to an Arrow batch.

    Groups arrive sorted, so a group ends where the key changes; only the last
    group of a batch is held back until its end is seen. This costs far less per
    group than one Arrow stream each. The partition count is explicit, because
    few bytes may still be much Python work and must not be merged into one task.
    """
    group, columns = list(group), list(columns)
    parts = shuffle_partitions(df.sparkSession)
    out_schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = out_schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        held_key = None

        def keys_at(pdf: pd.DataFrame, rows) -> list[tuple]:
            return [tuple(r) for r in pdf[group].iloc[rows].itertuples(index=False)]

        def joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
            return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)

        for pdf in batches:
            if len(pdf) == 0:
                continue
            marks = pdf[group]
            before = marks.shift()
            same = (marks == before) | (marks.isna() & before.isna())
            starts = (~same.all(axis=1)).to_numpy().nonzero()[0].tolist()
            if not starts or starts[0] != 0:
                starts = [0, *starts]
            keys = keys_at(pdf, starts)
            ends = [*starts[1:], len(pdf)]
            body = pdf[columns]
            out = []
            for key, lo, hi in zip(keys, starts, ends, strict=True):
                if held and key != held_key:
                    out.append(call(held_key, joined(held)))
                    held = []
                held_key = key
                held.append(body.iloc[lo:hi])
            if out := [r for r in out if _length(r)]:
                yield _stacked(out, names)
        if held and _length(last := call(held_key, joined(held))):
            yield _stacked([last], names)

    return df.repartition(parts, *group).sortWithinPartitions(*group).mapInPandas(run, out_schema)


def map_by_key(
    df: DataFrame,
    keys: Sequence[str],
    fn: Callable[[tuple, pd.DataFrame], Result],
    schema: StructType | str,
) -> DataFrame:
    """``fn(key, rows)`` for every partition key, exactly one call per key at every size.

    The largest key has to fit one task's memory; a function whose partial
    results can be merged belongs in :func:`collect_udaf`.
    """
    return _by_group(df, keys, df.columns, fn, schema)


def _plain_key(values: Sequence[object]) -> tuple:
    """A key that equals itself: one object stands for all not-a-numbers."""
    return tuple(math.nan if isinstance(v, float) and math.isnan(v) else v for v in values)


def _frame(rows: pa.StructArray) -> pd.DataFrame:
    # integers beside nulls stay integers
    return pa.RecordBatch.from_struct_array(rows).to_pandas(integer_object_nulls=True)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, bool, pd.DataFrame]]:
    """(key, whether left, rows) for each run of one key and one side; the first ``width`` columns are the key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        is_left = batch.column(width).to_numpy(zero_copy_only=False)
        # numbers of values, so that runs are found without a Python loop over rows
        codes = [pc.fill_null(c.dictionary_encode("encode").indices, -1).to_numpy() for c in batch.columns[:width]]
        starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in (*codes, is_left)], axis=0)]))
        keys = zip(*[c.take(pa.array(starts)).to_pylist() for c in batch.columns[:width]], strict=True)
        sides = [_frame(batch.column(k).filter(pa.array(mask))) for k, mask in ((width + 1, is_left), (width + 2, ~is_left))]
        at = np.concatenate([[0], np.cumsum(is_left)])
        for key, lo, hi in zip(keys, starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            left = bool(is_left[lo])
            rows = sides[0].iloc[at[lo] : at[hi]] if left else sides[1].iloc[lo - at[lo] : hi - at[hi]]
            yield _plain_key(key), left, rows


def _packed(results: Iterator[Result], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Results of any size as batches of ``size`` rows or somewhat more."""
    held, n = [], 0
    for result in chain(results, [None]):
        if result is not None and (rows := _length(result)):
            held.append(result)
            n += rows
        if held and (result is None or n >= size):
            yield pa.RecordBatch.from_pandas(_stacked(held, schema.names), schema, preserve_index=False)
            held, n = [], 0


def _joined(parts: list[pd.DataFrame], none: pd.DataFrame) -> pd.DataFrame:
    if len(parts) > 1:
        return pd.concat(parts, ignore_index=True)
    return parts[0] if parts else none.copy()


def _aligned(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    call: Callable[[tuple, pd.DataFrame, Iterator[pd.DataFrame]], Iterator[Result]],
    schema: StructType | str,
    how: str,
) -> DataFrame:
    """``call(key, right_rows, left_batches)`` per key, from one sorted stream of both sides.

    A side's rows travel as one struct column, so that types stay as they are
    where the other side has none. Rows of the right side come first.
    """
    if how not in ("left", "full"):
        raise ValueError(f"how is left or full, not {how!r}")
    keys, names = list(keys), [f"_key_{i}" for i in range(len(keys))]
    sides = {"_left": left, "_right": right}
    shapes = {name: F.struct(*df.columns) for name, df in sides.items()}

    def tagged(name: str) -> DataFrame:
        df = sides[name]
        columns = []
        for other in sides:
            none = F.lit(None).cast(sides[other].schema)
            columns.append((shapes[other] if other == name else none).alias(other))
        return df.select(
            *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.lit(name == "_left").alias("_is_left"), *columns
        )

    out_schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow_out = to_arrow_schema(out_schema)
    empty = to_arrow_schema(right.schema).empty_table().to_pandas()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[Result]:
        for key, group in groupby(_pieces(batches, len(keys)), key=itemgetter(0)):
            other, first = [], []
            for _, is_left, rows in group:
                if is_left:
                    first = [rows]
                    break
                other.append(rows)
            if not first and how == "left":
                continue
            yield from call(key, _joined(other, empty), chain(first, (rows for _, _, rows in group)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(frames(batches), arrow_out)

    both = tagged("_left").unionByName(tagged("_right"))
    parts = shuffle_partitions(left.sparkSession)
    return both.repartition(parts, *names).sortWithinPartitions(*names, "_is_left").mapInArrow(run, out_schema)


def map_aligned(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fn: Callable[[tuple, pd.DataFrame, pd.DataFrame], Result],
    schema: StructType | str,
    how: str = "left",
) -> DataFrame:
    """``fn(key, left_rows, right_rows)`` over two aligned partitions, exactly one call per key at every size.

    Both sides have any number of rows per key. Keys are those of ``left``, or
    with ``how`` full those of either side; a side without rows gives an empty
    frame. Null keys are one key, and so are not-a-numbers. The rows of both sides
    of a key have to fit one task; see :func:`map_aligned_batches` for more.
    """
    none = to_arrow_schema(left.schema).empty_table().to_pandas()

    def call(key: tuple, other: pd.DataFrame, ours: Iterator[pd.DataFrame]) -> Iterator[Result]:
        yield fn(key, _joined(list(ours), none), other)

    return _aligned(left, right, keys, call, schema, how)


def map_aligned_batches(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fn: Callable[[tuple, Iterator[pd.DataFrame], pd.DataFrame], Iterator[Result]],
    schema: StructType | str,
    how: str = "left",
) -> DataFrame:
    """``fn(key, left_batches, right_rows)`` per key, for a left side of any length.

    The left rows come as frames of at most an Arrow batch and the function yields
    frames, so a task holds the right rows of a key and one batch. Still one call
    per key; keys and empty sides are those of :func:`map_aligned`.
    """
    return _aligned(left, right, keys, lambda key, other, ours: fn(key, ours, other), schema, how)


class TimedCaller:
    """Calls functions with a time limit on one helper thread.

    Python cannot stop a running call, so after a timeout the thread is left
    behind and the next call gets a new one.
    """

    def __init__(self, timeout: float | None):
        self.timeout = timeout if timeout and timeout > 0 else None
        self.todo: queue.SimpleQueue | None = None
        self.done: queue.SimpleQueue | None = None

    def __call__(self, fn: Callable[[object], object], item: object) -> object:
        if self.timeout is None:
            return fn(item)
        if self.todo is None:
            self.todo, self.done = queue.SimpleQueue(), queue.SimpleQueue()
            threading.Thread(target=self.serve, args=(self.todo, self.done), daemon=True).start()
        self.todo.put((fn, item))
        try:
            value, error = self.done.get(timeout=self.timeout)
        except queue.Empty:
            self.todo = None
            raise TimeoutError(f"no result within {self.timeout:g} seconds") from None
        if error is not None:
            raise error
        return value

    @staticmethod
    def serve(todo: queue.SimpleQueue, done: queue.SimpleQueue) -> None:
        while True:
            fn, item = todo.get()
            try:
                done.put((fn(item), None))
            except Exception as exc:
                done.put((None, exc))


def attempt(
    fn: Callable[[object], object],
    item: object,
    retries: int = 1,
    backoff: float = 0.0,
    call: TimedCaller | None = None,
) -> tuple[bool, str | None, str | None, int]:
    """Call ``fn(item)`` up to ``retries`` times: (ok, value, error, attempts).

    The wait after failed attempt ``n`` is ``backoff * n`` seconds; an attempt
    over the caller's time limit counts as failed.
    """
    call = call or TimedCaller(None)
    error = None
    tries = max(1, int(retries))
    for number in range(1, tries + 1):
        try:
            value = call(fn, item)
            return True, None if value is None else str(value), None, number
        except Exception as exc:
            error = f"{type(exc).__name__}: {exc}"
        if number < tries and backoff > 0:
            time.sleep(backoff * number)
    return False, None, error, tries


def guarded_map(
    df: DataFrame,
    idx: str,
    item: str,
    fn: Callable[[object], object],
    retries: int = 1,
    backoff: float = 0.0,
    timeout: float | None = 300.0,
    parallelism: int | None = None,
) -> DataFrame:
    """``fn`` over every item, all settled: (idx, ok, value, error, attempts).

    A failing item yields its error and stops no other. ``idx`` is the argument
    order; sort by it where order matters. Attempts are counted within one
    successful task, since Spark may run a task again. ``parallelism`` spreads
    the items over that many tasks, for functions slow beside the size of an item.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = TimedCaller(timeout)
        for pdf in batches:
            rows = [
                (i, *attempt(fn, x, retries, backoff, call))
                for i, x in zip(pdf["idx"], pdf["item"], strict=True)
            ]
            yield pd.DataFrame(rows, columns=["idx", "ok", "value", "error", "attempts"])

    picked = df.select(F.col(idx).cast("bigint").alias("idx"), F.col(item).alias("item"))
    if parallelism:
        picked = picked.repartition(parallelism)
    return picked.mapInPandas(run, OUTCOME)


def branch_map(
    df: DataFrame,
    idx: str,
    item: str,
    branches: Mapping[str, Callable[[object], object]],
    retries: int = 1,
    parallelism: int | None = None,
) -> DataFrame:
    """Several functions over the same items, results tagged by branch."""
    return union_branches(
        {
            tag: guarded_map(df, idx, item, fn, retries, parallelism=parallelism)
            for tag, fn in branches.items()
        }
    )


def outcome_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("ok").agg(
        F.count(F.lit(1)).alias("items"), F.sum("attempts").alias("attempts")
    )


def split_outcomes(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settled results as (values, errors); pass a materialized frame."""
    return (
        results.where("ok").select("idx", "value", "attempts"),
        results.where("NOT ok").select("idx", "error", "attempts"),
    )


def collect_udaf(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[tuple, pd.DataFrame], Result],
    partial_schema: StructType | str,
    merge: Mapping[str, Column],
    slices: int = SLICES,
    slice_by: Sequence[str] | None = None,
) -> DataFrame:
    """User aggregate over all partition values of a parent.

    Every parent, however small, is cut into two slices by a hash of ``slice_by`` (all
    columns by default), a parent of more rows into one for each ``SLICE_ROWS`` rows, up
    to ``slices``. Rows of the large parents are counted beforehand. ``partial`` turns a
    slice into partial results; ``merge`` names the aggregate columns that combine
    them and may not be empty.
    """
    if not merge:
        raise ValueError("slices of a key need columns that merge them")
    columns, width = df.columns, len(keys)
    names = [f"_key_{i}" for i in range(width)]
    # at most rows / 2 * SLICE_ROWS keys, so the written table is tiny beside the data
    counted = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("_rows"))
    large = materialize(counted.where(F.col("_rows") > 2 * SLICE_ROWS), "large")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    wanted = F.greatest(F.lit(2), F.ceil(F.coalesce("_rows", F.lit(0)) / SLICE_ROWS))
    place = F.pmod(F.xxhash64(*(slice_by or columns)), F.least(F.lit(slices), wanted)).cast("bigint")
    parts = _by_group(
        df.join(large, same, "left").select(*columns, place.alias("_slice")),
        [*keys, "_slice"],
        columns,
        lambda group, pdf: partial(group[:width], pdf),
        partial_schema,
    )
    return parts.groupBy(*keys).agg(*[c.alias(name) for name, c in merge.items()])


def expand_keys(df: DataFrame, json_list: str, out: str = "key") -> DataFrame:
    """One row per string or number of a JSON list; other elements are no keys."""
    each = F.arrays_zip(
        F.from_json(F.col(json_list), "array<string>").alias("text"),
        F.from_json(F.col(json_list), "array<variant>").alias("value"),
    )
    rows = df.withColumn("_each", F.explode(each))
    kind = F.schema_of_variant("_each.value")
    return (
        rows.where(kind.rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)"))
        .withColumn(out, F.col("_each.text"))
        .drop("_each")
    )
