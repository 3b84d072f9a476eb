"""From query text to a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import (
    QUANTILE_COLUMNS,
    InvalidArgType,
    InvalidExpressionType,
    InvalidInput,
    InvalidOutputType,
    MissingArg,
    UnrecognizedFunction,
)
from tidemark.operators import windows as ops
from tidemark.plans.language import Call, parse
from tidemark.plans.output import lines


@dataclass
class Plan:
    """kind: sketch, quantile or metric. settled: a fetch, whose windows have the start of each of their rows."""

    kind: str
    df: DataFrame
    settled: bool = False


def _arg(call: Call, at: int, kind: type, optional: bool = False):
    if at >= len(call.args):
        if optional:
            return None
        raise MissingArg(f"{call.name}: argument {at + 1}")
    if type(call.args[at]) is not kind:
        raise InvalidArgType(f"{call.name}: argument {at + 1}")
    return call.args[at]


class Engine:
    """Runs queries over a store."""

    def __init__(self, store) -> None:
        self.store, self.tier = store, store.tier

    def plan(self, text: str) -> Plan:
        """The checked plan of a query, sketches allowed as its result."""
        tree = parse(text)
        if not isinstance(tree, Call):
            raise InvalidExpressionType(text)
        return self._build(tree)

    def query(self, text: str) -> DataFrame:
        """Result rows in order: quantiles by window and phi, or names."""
        plan = self.plan(text)
        if plan.kind == "sketch":
            raise InvalidOutputType(text)
        if plan.kind == "metric":
            return plan.df
        return plan.df.orderBy("window_start", "window_end", "at").select(*QUANTILE_COLUMNS)

    def text(self, text: str) -> DataFrame:
        """The result as lines of text."""
        return lines(self.query(text))

    def _build(self, call: Call) -> Plan:
        rule = getattr(self, f"_{call.name}", None) if call.name in ("coalesce", "combine", "fetch", "group", "quantile", "search") else None
        if rule is None:
            raise UnrecognizedFunction(call.name)
        return rule(call)

    def _sketches(self, call: Call, at: int) -> Plan:
        plan = self._build(_arg(call, at, Call))
        if plan.kind != "sketch":
            raise InvalidInput(f"{call.name}: argument {at + 1}")
        return plan

    def _fetch(self, call: Call) -> Plan:
        metric, start, end = _arg(call, 0, str), _arg(call, 1, int, True), _arg(call, 2, int, True)
        return Plan("sketch", self.store.fetch(metric, start, end), settled=True)

    def _search(self, call: Call) -> Plan:
        return Plan("metric", self.store.search(_arg(call, 0, str)))

    def _coalesce(self, call: Call) -> Plan:
        inner = call.args[0] if call.args else None
        if isinstance(inner, Call) and inner.name == "coalesce":
            return self._build(inner)
        return Plan("sketch", ops.coalesce(self.tier, self._sketches(call, 0).df))

    def _group(self, call: Call) -> Plan:
        unit = _arg(call, 0, str)
        inner = self._sketches(call, 1)
        # stored windows have distinct starts, so by seconds there is nothing to merge
        if unit == "seconds" and inner.settled:
            return inner
        return Plan("sketch", ops.group(self.tier, inner.df if inner.settled else self.tier.settle(inner.df), unit))

    def _combine(self, call: Call) -> Plan:
        frames = [self._sketches(call, k).df for k in range(len(call.args))]
        if not frames:
            return Plan("sketch", self.store.fetch("none").where(F.lit(False)))
        return Plan("sketch", ops.combine(self.tier, frames))

    def _quantile(self, call: Call) -> Plan:
        if len(call.args) < 2:
            raise MissingArg("quantile")
        inner = self._sketches(call, 0)
        phis = [_arg(call, k, float) for k in range(1, len(call.args))]
        return Plan("quantile", ops.quantile(self.tier, inner.df, phis, repeats=not inner.settled))
