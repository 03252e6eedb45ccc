"""A plan of operators wired by column names: ordered, checked and pruned before any data is read.

Operators may be added in any order. Each column has one producer. Building a plan sorts the operators, infers every
shape, and leaves out what no wanted output needs (Spark can't see through a numpy batch, so this is done here).
Fitting hands each estimator the training trials as the operators before it leave them.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Mapping

from pyspark import cloudpickle
from pyspark.sql import SparkSession

from kymo.operators.base import Estimator, Operator, Shape, Trials, tensors_of

Stage = Operator | Estimator


class Plan:
    """Operators and estimators in the order in which they were added."""

    def __init__(self, stages: Iterable[Stage] = ()):
        self.stages: list[Stage] = list(stages)

    def add(self, stage: Stage) -> Plan:
        self.stages.append(stage)
        return self

    def updated(self, output: str, **parameters: object) -> Plan:
        """A plan in which the stage that makes ``output`` has other parameters; this plan stays as it is."""
        stages = [copy.copy(s) if s.output == output else s for s in self.stages]
        for s in stages:
            if s.output == output:
                for name, value in parameters.items():
                    if not hasattr(s, name):
                        raise AttributeError(f"{type(s).__name__} has no parameter {name}")
                    setattr(s, name, value)
        return Plan(stages)

    def ordered(self, given: Iterable[str], outputs: Iterable[str] | None = None) -> list[Stage]:
        """The stages that ``outputs`` (default: all) need, producers before consumers."""
        producer: dict[str, Stage] = {}
        for s in self.stages:
            if s.output in producer:
                raise ValueError(f"{s.output} has two producers")
            producer[s.output] = s
        given, out, state = set(given), [], {}

        def visit(name: str, by: Stage | None) -> None:
            if name not in producer or (by is not None and by.output == name and name in given):
                if name not in given:
                    raise ValueError(f"nothing produces {name}")
                return
            s = producer[name]
            if state.get(name) == "open":
                raise ValueError(f"{name} depends on itself")
            if name not in state:
                state[name] = "open"
                for i in s.inputs:
                    visit(i, s)
                state[name] = "done"
                out.append(s)

        for name in outputs if outputs is not None else [s.output for s in self.stages]:
            visit(name, None)
        return out

    def infer(self, shapes: Mapping[str, Shape], outputs: Iterable[str] | None = None) -> dict[str, Shape]:
        """Shapes of all columns of the plan; errors name the stage."""
        known = dict(shapes)
        for s in self.ordered(known, outputs):
            try:
                known[s.output] = s.infer(*(known[i] for i in s.inputs))
            except (ValueError, TypeError) as e:
                e.add_note(f"in {type(s).__name__} for {s.output}")
                raise
        return known

    def fit(self, trials: Trials, outputs: Iterable[str] | None = None) -> FittedPlan:
        """Fit all estimators on training trials."""
        outputs = list(outputs) if outputs is not None else None
        self.infer(trials.shapes, outputs)
        done: list[Operator] = []
        stages = self.ordered(trials.shapes, outputs)
        last = max((i for i, s in enumerate(stages) if isinstance(s, Estimator)), default=-1)
        for i, s in enumerate(stages):
            operator = s.fit(trials) if isinstance(s, Estimator) else s
            done.append(operator)
            if i < last:  # nothing after the last estimator needs the training trials
                trials = operator.apply(trials)
        return FittedPlan(done)

    def transform(self, trials: Trials, outputs: Iterable[str] | None = None) -> Trials:
        """Run a plan without estimators."""
        outputs = list(outputs) if outputs is not None else None
        if any(isinstance(s, Estimator) for s in self.ordered(trials.shapes, outputs)):
            raise ValueError("a plan with estimators is fitted first")
        return self.fit(trials, outputs).transform(trials)


class FittedPlan:
    """Operators ready to run on trials, batch or streaming."""

    def __init__(self, operators: list[Operator]):
        self.operators = operators

    def transform(self, trials: Trials) -> Trials:
        for o in self.operators:
            trials = o.apply(trials)
        return trials

    def update(self, trials: Trials, rate: float) -> None:
        """Let operators that follow new data (states, potatoes) move toward all trials, in order of their ids.

        Each moves on from where the trial before left it, so trials stream through the driver, some at a time.
        """
        for o in self.operators:
            for part in [o, *vars(o).values()]:
                if hasattr(part, "update") and hasattr(part, "inputs") and part.inputs[0] in trials.shapes:
                    for some in tensors_of(trials, part.inputs[0]):
                        part.update(some, rate)
            trials = o.apply(trials)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the fitted operators, as a table of one row, to any store that Spark reaches."""
        spark.createDataFrame([(bytearray(cloudpickle.dumps(self.operators)),)], "operators binary").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedPlan:
        """A plan that ``save`` wrote. As with any pickle, load only what you wrote."""
        return cls(cloudpickle.loads(bytes(spark.read.parquet(path).first()["operators"])))
