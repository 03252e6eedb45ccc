"""Operators that move elements: static positions become gathers and slices of the row-major array."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.functions import tensors as t
from kymo.operators import ordered
from kymo.operators.base import BatchOperator, ColumnOperator, Operator, Shape, Trials, batch_column, norm_axis, size_of


def places(shape: Shape) -> np.ndarray:
    """Row-major position of every element."""
    return np.arange(int(np.prod(shape))).reshape(shape)


class Moved(ColumnOperator):
    """The output's elements are the input's at ``index(shape)``.

    Where the input is itself moved, positions are composed when the plan is built, and elements move once.
    """

    def index(self, shape: Shape) -> np.ndarray:
        raise NotImplementedError

    def infer(self, a: Shape) -> Shape:
        return self.index(a).shape

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        index = self.index(shapes[0])
        if index.shape == ():
            return F.get(columns[0], F.lit(int(index)))
        return columns[0] if shapes[0] != () and np.array_equal(index.ravel(), np.arange(size_of(shapes[0]))) else t.gather(columns[0], index)

    def apply(self, trials: Trials) -> Trials:
        a = self.inputs[0]
        shape = trials.shape(a)
        if a in trials.moved:
            source, places_ = trials.moved[a]
            index = places_.ravel()[self.index(shape)]
            column = _Positions(source, index).column([F.col(source)], [trials.shape(source)])
        else:
            source, index = a, self.index(shape)
            column = self.column([F.col(a)], [shape])
        return trials.with_column(self.output, column, index.shape, (source, index))


class _Positions(Moved):
    """Elements at positions that are known already."""

    def __init__(self, a: str, index: np.ndarray):
        self.inputs, self._index = (a,), index

    def index(self, shape: Shape) -> np.ndarray:
        return self._index


class Transpose(Moved):
    """Permuted axes; None reverses them."""

    def __init__(self, a: str, output: str, axes: Sequence[int] | None = None):
        self.inputs, self.output, self.axes = (a,), output, axes

    def index(self, shape: Shape) -> np.ndarray:
        if self.axes is not None and sorted(norm_axis(x, len(shape)) for x in self.axes) != list(range(len(shape))):
            raise ValueError(f"axes {self.axes} don't permute a tensor of rank {len(shape)}")
        return places(shape).transpose(self.axes)


class Reshape(Moved):
    """Another shape for the same elements: only metadata change. One length may be -1."""

    def __init__(self, a: str, output: str, shape: Shape):
        self.inputs, self.output, self.target = (a,), output, tuple(shape)

    def index(self, shape: Shape) -> np.ndarray:
        return places(shape).reshape(self.target)

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        self.index(shapes[0])
        return columns[0] if shapes[0] != () else F.array(columns[0])

    def apply(self, trials: Trials) -> Trials:
        a = self.inputs[0]
        if trials.shape(a) == ():
            return ColumnOperator.apply(self, trials)
        source, index = trials.moved.get(a, (a, places(trials.shape(a))))
        return trials.with_column(self.output, F.col(a), self.infer(trials.shape(a)), (source, index.reshape(self.target)))


class Extract(Moved):
    """The outer product of one index list, int, slice or None (all) for each axis; ``reduce_dims`` drops axes of length one."""

    def __init__(self, a: str, indices: Sequence[int | slice | Sequence[int] | None], output: str, reduce_dims: bool = False):
        self.inputs, self.output, self.indices, self.reduce_dims = (a,), output, tuple(indices), reduce_dims

    def index(self, shape: Shape) -> np.ndarray:
        if len(self.indices) != len(shape):
            raise ValueError("one index for each axis")
        every = [np.arange(n) for n in shape]
        picked = [x if i is None else np.atleast_1d(x[i if isinstance(i, slice) else np.asarray(i)]) for x, i in zip(every, self.indices)]
        out = places(shape)[np.ix_(*picked)]
        return out.squeeze() if self.reduce_dims else out


class Epoch(Moved):
    """Windows of ``length`` every ``stride`` samples (default: side by side) along ``axis``; a new axis before it counts them."""

    def __init__(self, a: str, output: str, length: int, stride: int | None = None, axis: int = -1):
        if length < 1 or stride is not None and stride < 1:
            raise ValueError("length and stride are positive")
        self.inputs, self.output, self.length, self.stride, self.axis = (a,), output, length, stride or length, axis

    def index(self, shape: Shape) -> np.ndarray:
        axis = norm_axis(self.axis, len(shape))
        if shape[axis] < self.length:
            raise ValueError("an epoch is longer than the axis")
        starts = np.arange(0, shape[axis] - self.length + 1, self.stride)
        return np.take(places(shape), starts[:, None] + np.arange(self.length), axis=axis)

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        shape, axis = shapes[0], norm_axis(self.axis, len(shapes[0]))
        if axis < len(shape) - 1:
            return super().column(columns, shapes)
        n, count = shape[-1], self.infer(shape)[-2]
        windows = F.sequence(F.lit(0), F.lit(int(np.prod(shape[:-1])) * count - 1))
        first = lambda w: (F.floor(w / count) * n + w % count * self.stride + 1).cast("int")
        return t.bound(lambda x: F.flatten(F.transform(windows, lambda w: F.slice(x, first(w), self.length))), columns[0])


class Concatenation(ColumnOperator):
    """Two tensors along an axis; where one has a rank less it gets a first axis of length one."""

    def __init__(self, a: str, b: str, output: str, axis: int = 0):
        self.inputs, self.output, self.axis = (a, b), output, axis

    @staticmethod
    def matched(a: Shape, b: Shape) -> tuple[Shape, Shape]:
        a, b = a or (1,), b or (1,)
        if abs(len(a) - len(b)) > 1:
            raise ValueError("ranks may differ by one")
        return ((1,) + a, b) if len(a) < len(b) else (a, (1,) + b) if len(b) < len(a) else (a, b)

    def index(self, a: Shape, b: Shape) -> np.ndarray:
        a, b = self.matched(a, b)
        return np.concatenate([places(a), places(b) + int(np.prod(a))], axis=norm_axis(self.axis, len(a)))

    def infer(self, a: Shape, b: Shape) -> Shape:
        return self.index(a, b).shape

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        both = F.concat(*[c if s != () else F.array(c) for c, s in zip(columns, shapes)])
        index = self.index(*shapes)
        return both if np.array_equal(index.ravel(), np.arange(index.size)) else t.gather(both, index)


class Stack(ColumnOperator):
    """Tensors of one shape on a new axis."""

    def __init__(self, inputs: Sequence[str], output: str, axis: int = 0):
        self.inputs, self.output, self.axis = tuple(inputs), output, axis

    def index(self, *shapes: Shape) -> np.ndarray:
        if len(set(shapes)) != 1:
            raise ValueError("stacked tensors have one shape")
        size = int(np.prod(shapes[0]))
        return np.stack([places(s) + i * size for i, s in enumerate(shapes)], axis=norm_axis(self.axis, len(shapes[0]) + 1))

    def infer(self, *shapes: Shape) -> Shape:
        return self.index(*shapes).shape

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        every = F.array(*columns) if shapes[0] == () else F.concat(*columns)
        index = self.index(*shapes)
        return every if np.array_equal(index.ravel(), np.arange(index.size)) else t.gather(every, index)


class TensorStack(Stack):
    """Two tensors of one shape on a new axis."""

    def __init__(self, a: str, b: str, output: str, axis: int = 0):
        super().__init__((a, b), output, axis)


MOVING_MODES = ("edge", "reflect", "symmetric", "wrap")


class Pad(ColumnOperator):
    """numpy's padding; modes that repeat elements are gathers, constants fill gaps, the others run in numpy."""

    def __init__(self, a: str, output: str, pad_width, mode: str | Callable = "constant", **options):
        self.inputs, self.output, self.width, self.mode, self.options = (a,), output, pad_width, mode, options

    def infer(self, a: Shape) -> Shape:
        return np.pad(np.zeros(a), self.width, "edge").shape

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        if self.mode == "constant":
            index = np.pad(places(shapes[0]), self.width, "constant", constant_values=-1)
            fill = self.options.get("constant_values", 0)
            if np.ndim(fill) == 0:
                pick = lambda x, i: F.when(i < 0, F.lit(float(fill))).otherwise(F.get(x, F.greatest(i, F.lit(0))))
                return t.bound(lambda x: F.transform(t.constant_ints(index), lambda i: pick(x, i)), columns[0])
        elif self.mode in MOVING_MODES and self.options.get("reflect_type", "even") == "even":
            return t.gather(columns[0], np.pad(places(shapes[0]), self.width, self.mode))
        return _NumpyPad(self).as_column(columns, shapes)


class _NumpyPad(BatchOperator):
    def __init__(self, pad: Pad):
        self.width, self.mode, self.options, self.infer = pad.width, pad.mode, pad.options, pad.infer

    def as_column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        width, mode, options = self.width, self.mode, self.options

        def run(a: np.ndarray) -> np.ndarray:
            return np.stack([np.pad(x, width, mode, **options) for x in a])

        return batch_column(run, columns, shapes, self.infer(shapes[0]), columns)


class Enqueue(Operator):
    """Ring buffer: what the last ``capacity`` pushes up to and with each trial hold, oldest first, as array<array<double>>.

    With ``flag`` only trials whose flag is true are pushed; the others see the buffer as it stands. ``by`` are the
    columns of a recording (each has a buffer of its own). A recording is ordered by ``order`` in a task of its own or, with
    ``split`` (the default where there is only one), in blocks of trials over all tasks.
    """

    def __init__(self, a: str, output: str, capacity: int, order: str, by: Sequence[str] = (), flag: str | None = None, split: bool | None = None):
        if capacity < 1:
            raise ValueError("a buffer holds at least one element")
        self.inputs, self.output, self.capacity, self.order, self.by, self.flag = (a,), output, capacity, order, tuple(by), flag
        self.split = not self.by if split is None else split

    def infer(self, a: Shape) -> Shape:
        return (self.capacity, *a)

    def apply(self, trials: Trials) -> Trials:
        if self.split:
            return self._in_blocks(trials)
        by = [F.col(b) for b in self.by] or [F.lit(0)]
        rows = Window.orderBy(self.order).rowsBetween(1 - self.capacity, 0)
        value = F.col(self.inputs[0])
        if self.flag is None:
            return trials.with_df(trials.df.withColumn(self.output, F.collect_list(value).over(rows.partitionBy(*by))))
        df = trials.df.withColumn("_pushed", self._pushed())
        df = df.withColumn("_buffer", F.when(F.col("_pushed"), F.collect_list(value).over(rows.partitionBy(*by, F.col("_pushed")))))
        past = Window.partitionBy(*by).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
        held = F.coalesce(F.last("_buffer", ignorenulls=True).over(past), self._nothing(df))
        return trials.with_df(df.withColumn(self.output, held).drop("_pushed", "_buffer"))

    def _pushed(self) -> Column:
        return F.lit(True) if self.flag is None else F.coalesce((F.col(self.flag).cast("double") != 0), F.lit(False))

    def _nothing(self, df: DataFrame) -> Column:
        return F.array().cast(f"array<{dict(df.dtypes)[self.inputs[0]]}>")

    def _in_blocks(self, trials: Trials) -> Trials:
        df, others = trials.df, [c for c in trials.df.columns if c != self.output]
        held = lambda w: F.collect_list(self.inputs[0]).over(w)
        if self.flag is None:
            placed = ordered.earlier(df, self.by, [self.order], {"_n": F.lit(True)})
            return trials.with_df(ordered.last_rows(placed, self.by, "_n", self.capacity, {self.output: held}).drop("_n"))
        placed = ordered.earlier(df.withColumn("_pushed", self._pushed()), self.by, [self.order], {"_n": F.lit(True), "_k": F.col("_pushed")})
        pushes = ordered.last_rows(placed.filter("_pushed"), self.by, "_k", self.capacity, {"_buffer": held})
        both = pushes.unionByName(placed.filter("not _pushed").withColumn("_buffer", F.lit(None).cast(pushes.schema["_buffer"].dataType)))
        blocks = both.withColumn("_at", F.expr(f"_n div {ordered.BLOCK}"))
        # before the first push of a block stands the buffer of the last push before the block: one row for each block
        first = blocks.groupBy(*self.by, "_at").agg(F.min("_k").alias("_k")).withColumn("_k", F.col("_k") - 1)
        keys = [(b, f"_key{i}") for i, b in enumerate(self.by)]
        same = lambda *more: functools.reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(k)) for b, k in keys] + list(more))
        renamed = first.select(*(F.col(b).alias(k) for b, k in keys), F.col("_at").alias("_key_at"), F.col("_k").alias("_key_k"))
        carried = pushes.join(renamed, same(F.col("_k") == F.col("_key_k"))).select(*(k for _, k in keys), "_key_at", F.col("_buffer").alias("_carried"))
        past = Window.partitionBy(*self.by, "_at").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
        known = blocks.withColumn("_last", F.last("_buffer", ignorenulls=True).over(past)).join(carried, same(F.col("_at") == F.col("_key_at")), "left")
        out = known.withColumn(self.output, F.coalesce("_last", "_carried", self._nothing(df)))
        return trials.with_df(out.select(*others, self.output))


class RunningAverage(Operator):
    """Mean of the last ``length`` trials, the current one included; at first of those that exist. ``split`` as for ``Enqueue``."""

    def __init__(self, a: str, output: str, length: int, order: str, by: Sequence[str] = (), split: bool | None = None):
        if length < 1:
            raise ValueError("the length is positive")
        self.inputs, self.output, self.length, self.order, self.by = (a,), output, length, order, tuple(by)
        self.split = not self.by if split is None else split

    def infer(self, a: Shape) -> Shape:
        return a

    def apply(self, trials: Trials) -> Trials:
        a, shape = self.inputs[0], trials.shape(self.inputs[0])
        made = F.avg(a) if shape == () else F.collect_list(a)
        if self.split:
            placed = ordered.earlier(trials.df, self.by, [self.order], {"_n": F.lit(True)})
            df = ordered.last_rows(placed, self.by, "_n", self.length, {"_held": made.over}).drop("_n")
        else:
            df = trials.df.withColumn("_held", made.over(Window.partitionBy(*([F.col(b) for b in self.by] or [F.lit(0)])).orderBy(self.order).rowsBetween(1 - self.length, 0)))
        if shape == ():
            mean = F.col("_held")
        else:
            zero = F.array_repeat(F.lit(0.0), int(np.prod(shape)))
            sums = F.aggregate("_held", zero, lambda s, x: F.zip_with(s, x, lambda u, v: u + v))
            mean = F.transform(sums, lambda v: v / F.size("_held"))
        out = trials.with_df(df).with_column(self.output, mean, shape)
        return out.with_df(out.df.drop("_held"))


class BaselineCorrection(ColumnOperator):
    """Minus the mean over samples ``period[0]`` up to ``period[1]`` (left out; negatives count from the end) along ``axis``."""

    def __init__(self, a: str, output: str, period: tuple[int, int] = (0, -1), axis: int = -1):
        self.inputs, self.output, self.period, self.axis = (a,), output, period, axis

    def bounds(self, a: Shape) -> tuple[int, int, int]:
        axis = norm_axis(self.axis, len(a))
        first, last = (p + a[axis] if p < 0 else p for p in self.period)
        if not 0 <= first < last <= a[axis]:
            raise ValueError(f"the baseline {self.period} isn't a stretch of the axis")
        return axis, first, last

    def infer(self, a: Shape) -> Shape:
        self.bounds(a)
        return a

    def column(self, columns: list[Column], shapes: list[Shape]) -> Column:
        axis, first, last = self.bounds(shapes[0])
        outer = int(np.prod(shapes[0][:axis]))
        inner = int(np.prod(shapes[0][axis + 1 :]))
        of = np.broadcast_to(np.arange(outer * inner).reshape(outer, 1, inner), (outer, shapes[0][axis], inner))

        def corrected(x: Column) -> Column:
            means = F.transform(t.lanes(x, shapes[0], axis), lambda lane: t.total(F.slice(lane, first + 1, last - first)) / (last - first))
            return F.zip_with(x, t.gather(means, of), lambda v, m: v - m)

        return t.bound(corrected, columns[0])
