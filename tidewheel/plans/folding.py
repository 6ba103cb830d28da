"""Python folds over ordered rows: in groups, running in many tasks, and over trailing windows.

Rows come to Python in Arrow batches, in order, and states of consecutive rows are merged; no fold needs to commute.
"""

from __future__ import annotations

import copy
import pickle
from collections import namedtuple
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.plans.durable import kept

PART, STATE = "__part", "__state"
_NAN = object()


def fields_of(summarizers: list) -> list[T.StructField]:
    return [f for s in summarizers for f in T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in s.fields.items())).fields]


def same_key(values: tuple) -> tuple:
    """Keys that compare equal where a grouping takes them for one: nulls, and NaNs."""
    return tuple(_NAN if isinstance(x, float) and x != x else x for x in values)


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def keyed_rows(batch: pa.RecordBatch, keys: list[str], names: list[str]) -> Iterator[tuple[tuple, tuple]]:
    """(key, values) of each row."""
    own, values = _columns(batch, keys), _columns(batch, names)
    for k in range(batch.num_rows):
        yield same_key(tuple(c[k] for c in own)), tuple(c[k] for c in values)


class Queue:
    """The states of a window of rows: two stacks, so that each row is merged a few times at most whatever the window holds.

    The front stack keeps, for each of its rows, the fold from that row to the stack's end; the back one is a single fold.
    """

    def __init__(self, zero, merge):
        self.zero, self.merge = zero, merge
        self.front: list[tuple[Any, Any]] = []
        self.back: list[tuple[Any, Any]] = []
        self.folded = None

    def push(self, number: Any, state: Any) -> None:
        self.back.append((number, state))
        self.folded = copy.deepcopy(state) if self.folded is None else self.merge(self.folded, state)

    def evict(self, least: Any) -> None:
        """Drop the rows before ``least``."""
        while True:
            if not self.front:
                if not self.back or self.back[0][0] >= least:
                    return
                total = None
                for number, state in reversed(self.back):
                    total = state if total is None else self.merge(state, copy.deepcopy(total))
                    self.front.append((number, total))
                self.back, self.folded = [], None
            if self.front[-1][0] >= least:
                return
            self.front.pop()

    def fold(self) -> Any:
        first = self.front[-1][1] if self.front else None
        if first is None:
            return self.zero() if self.folded is None else self.folded
        return first if self.folded is None else self.merge(copy.deepcopy(first), self.folded)


class Folding:
    """Several fold summarizers with dependencies before them, as one fold over rows ``names``."""

    def __init__(self, folds: list, names: list[str], hidden: dict[str, str]):
        #: ``hidden``: results that folds depend on, by the columns that hold them.
        self.folds, self.names, self.hidden = folds, names, hidden
        self.row = namedtuple("Row", names, rename=True)

    def zero(self) -> list:
        return [s.zero() for s in self.folds]

    def update(self, states: list, values: tuple) -> list:
        row = self.row(*values)
        return [s.update(state, row) for s, state in zip(self.folds, states)]

    def one(self, values: tuple) -> list:
        return self.update(self.zero(), values)

    def merge(self, a: list, b: list) -> list:
        return [s.merge(x, y) for s, x, y in zip(self.folds, a, b)]

    def finish(self, states: list, known: dict[str, Any]) -> dict[str, Any]:
        for s, state in zip(self.folds, states):
            known |= s.finish(state, known)
        return known


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def running(df: DataFrame, keys: list[str], order: list[str], names: list[str], folding: Folding, wanted: list[T.StructField]) -> DataFrame:
    """``df`` with the folds after each row of a key, in ``order``.

    Rows are dealt by ranges of (keys, order), once; a task folds its last key's rows to one state.  Those states, at most one
    a task, make the carry with which the next tasks start, and each then goes through its rows.
    """
    dealt = kept(df.repartitionByRange(*[F.col(f"`{c}`") for c in (*keys, *order)]).sortWithinPartitions(*[F.col(f"`{c}`") for c in (*keys, *order)]).withColumn(PART, F.spark_partition_id()))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = states = first = part = None
        for batch in batches:
            part = batch.column(batch.schema.get_field_index(PART))[0].as_py() if batch.num_rows else part
            for own, values in keyed_rows(batch, keys, names):
                first = own if states is None else first
                if states is None or own != key:
                    key, states = own, folding.zero()
                states = folding.update(states, values)
        if states is not None:
            # A key that began here starts afresh; one that fills the task goes on from the task before.
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps((_plain(key), key == first, states))], pa.binary())], [PART, STATE])

    carries: dict[int, tuple] = {}
    key = states = None
    for r in dealt.mapInArrow(last, f"{PART} int, {STATE} binary").orderBy(PART).collect():  # one row a task
        carries[r[PART]] = (key, states)
        own, whole, folded = pickle.loads(r[STATE])
        states = folding.merge(copy.deepcopy(states), folded) if states is not None and whole and own == key else folded
        key = own
    shape = T.StructType([*df.schema.fields, *wanted])
    kinds = [arrow_type(f.dataType) for f in wanted]
    hidden, own_columns, every = list(folding.hidden.values()), df.columns, shape.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = states = None
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                begun = True
                key, states = carries[batch.column(batch.schema.get_field_index(PART))[0].as_py()]
            known, results = _columns(batch, hidden), {f.name: [] for f in wanted}
            for k, (own, values) in enumerate(keyed_rows(batch, keys, names)):
                if states is None or _plain(own) != key:
                    key, states = _plain(own), folding.zero()
                states = folding.update(states, values)
                out = folding.finish(states, {n: c[k] for n, c in zip(folding.hidden, known)})
                for f in wanted:
                    results[f.name].append(out[f.name])
            kept_columns = [batch.column(batch.schema.get_field_index(c)) for c in own_columns]
            yield pa.RecordBatch.from_arrays([*kept_columns, *[pa.array(results[f.name], kind) for f, kind in zip(wanted, kinds)]], every)

    return dealt.mapInArrow(run, shape)


def _plain(key: tuple) -> tuple:
    """A key that stays equal through pickling."""
    return tuple(("nan",) if x is _NAN else x for x in key)


def trailing(both: DataFrame, by: list[str], order: list[str], number: str, present: str, names: dict[str, str], span: Any, out: list[str], folding: Folding, wanted: list[T.StructField]) -> DataFrame:
    """The rows of ``both`` that are not ``present``, with the folds of the present rows of their group at most ``span`` before.

    Rows of a group ``by`` go through one task in ``order``, and only those of the window are held.
    """
    sort = [F.col(f"`{c}`") for c in (*by, *order)]
    dealt = both.repartition(*[F.col(f"`{c}`") for c in by]).sortWithinPartitions(*sort)
    shape = T.StructType([*[both.schema[c] for c in out], *wanted])
    kinds = [arrow_type(f.dataType) for f in wanted]
    hidden, columns = list(folding.hidden.values()), list(names.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queue = None, Queue(folding.zero, folding.merge)
        for batch in batches:
            numbers, here = _columns(batch, [number, present])
            known, results, asked = _columns(batch, hidden), {f.name: [] for f in wanted}, []
            for k, (own, values) in enumerate(keyed_rows(batch, by, columns)):
                if own != group:
                    group, queue = own, Queue(folding.zero, folding.merge)
                if here[k]:
                    queue.evict(numbers[k] - span)
                    queue.push(numbers[k], folding.one(values))
                    continue
                queue.evict(numbers[k] - span)
                made = folding.finish(queue.fold(), {n: c[k] for n, c in zip(folding.hidden, known)})
                asked.append(k)
                for f in wanted:
                    results[f.name].append(made[f.name])
            at = pa.array(asked, pa.int64())
            kept_columns = [batch.column(batch.schema.get_field_index(c)).take(at) for c in out]
            yield pa.RecordBatch.from_arrays([*kept_columns, *[pa.array(results[f.name], kind) for f, kind in zip(wanted, kinds)]], shape.fieldNames())

    return dealt.mapInArrow(run, shape)
