"""Declarative metric formulas, compiled to Columns."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import cell, factor_unit, quotient_unit, sum_unit


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Const:
    value: float


@dataclass(frozen=True)
class Op:
    """left op right, op one of + - * /."""

    op: str
    left: Ref | Const | Op
    right: Ref | Const | Op


@dataclass(frozen=True)
class Input:
    """A named input: its concepts in order of preference, the kind of its period and the family of its unit."""

    name: str
    concepts: tuple[str, ...]
    period: str = "instant"  # or duration
    family: str = "monetary"  # shares, pure
    taxonomy: str = "us-gaap"


@dataclass(frozen=True)
class Formula:
    name: str
    inputs: tuple[Input, ...]  # in the order in which a missing one is told
    body: Ref | Const | Op
    output: str = "pure"  # family of the result's unit

    @property
    def period(self) -> str:
        return "duration" if any(i.period == "duration" for i in self.inputs) else "instant"


_VALUE = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide}


def value_of(node: Ref | Const | Op) -> Column:
    if isinstance(node, Ref):
        return F.col(node.name).cast("double")
    return F.lit(float(node.value)) if isinstance(node, Const) else _VALUE[node.op](value_of(node.left), value_of(node.right))


def divisors_of(node: Ref | Const | Op) -> list[Column]:
    if not isinstance(node, Op):
        return []
    mine = [value_of(node.right)] if node.op == "/" else []
    return divisors_of(node.left) + divisors_of(node.right) + mine


def compiled(formula: Formula) -> Column:
    """struct<status,value,reason> over columns named as the inputs: the first missing input in declared order, then a zero divisor, tell the reason."""
    missing = [(F.col(i.name).isNull(), "missing_input") for i in formula.inputs]
    zero = [(d == 0, "divide_by_zero") for d in divisors_of(formula.body)]
    return cell(value_of(formula.body), *missing, *zero)


@dataclass(frozen=True)
class Part:
    """Value, unit and reason of a part of a formula."""

    value: Column
    unit: Column
    reason: Column


def evaluated(node: Ref | Const | Op, of: dict[str, Column]) -> Part:
    """A formula over input structs<value,unit>, all of them known: operands first, left before right; a zero divisor before units that don't fit."""
    if isinstance(node, Ref):
        return Part(of[node.name]["value"], of[node.name]["unit"], F.lit(None).cast("string"))
    if isinstance(node, Const):
        return Part(F.lit(float(node.value)), F.lit("pure"), F.lit(None).cast("string"))
    left, right = evaluated(node.left, of), evaluated(node.right, of)
    unit = {"+": sum_unit, "-": sum_unit, "*": factor_unit, "/": quotient_unit}[node.op](left.unit, right.unit)
    zero = (right.value == 0) if node.op == "/" else F.lit(False)
    mine = F.when(zero, "divide_by_zero").when(unit.isNull(), "unit_mismatch")
    return Part(_VALUE[node.op](left.value, right.value), unit, F.coalesce(left.reason, right.reason, mine))


def first_known(*candidates: Column) -> Column:
    """Concept fallback: the first candidate that has a value."""
    return F.coalesce(*candidates)


#: Concepts of common statements (fixed values).
CONCEPTS = {
    "current_assets": ("AssetsCurrent",), "current_liabilities": ("LiabilitiesCurrent",), "inventory": ("InventoryNet", "InventoryFinishedGoodsNetOfReserves"), "liabilities": ("Liabilities",), "equity": ("StockholdersEquity",), "assets": ("Assets",),
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"), "cost_of_revenue": ("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"), "operating_income": ("OperatingIncomeLoss",), "net_income": ("NetIncomeLoss",),
}
DURATIONS = ("revenue", "cost_of_revenue", "operating_income", "net_income")


def _inputs(*names: str) -> tuple[Input, ...]:
    return tuple(Input(n, CONCEPTS[n], "duration" if n in DURATIONS else "instant") for n in names)


def _ratio(name: str, top: str, bottom: str) -> Formula:
    return Formula(name, _inputs(top, bottom), Op("/", Ref(top), Ref(bottom)))


#: Eight formulas of common statements; more are added by putting them here.
BUILTIN = {
    f.name: f
    for f in (
        _ratio("current_ratio", "current_assets", "current_liabilities"),
        Formula("quick_ratio", _inputs("current_assets", "inventory", "current_liabilities"), Op("/", Op("-", Ref("current_assets"), Ref("inventory")), Ref("current_liabilities"))),
        Formula("working_capital", _inputs("current_assets", "current_liabilities"), Op("-", Ref("current_assets"), Ref("current_liabilities")), "monetary"),
        Formula("gross_margin", _inputs("revenue", "cost_of_revenue"), Op("/", Op("-", Ref("revenue"), Ref("cost_of_revenue")), Ref("revenue"))),
        _ratio("operating_margin", "operating_income", "revenue"),
        _ratio("net_margin", "net_income", "revenue"),
        _ratio("debt_to_equity", "liabilities", "equity"),
        _ratio("asset_turnover", "revenue", "assets"),
    )
}


def described(node: Ref | Const | Op) -> object:
    if isinstance(node, Ref):
        return {"ref": node.name}
    return {"const": node.value} if isinstance(node, Const) else {"op": node.op, "left": described(node.left), "right": described(node.right)}


def identity(formula: Formula) -> str:
    """formula:<SHA-256> of a formula's content: inputs in order, body and output; the name does not count."""
    content = {"inputs": [[i.name, list(i.concepts), i.period, i.family, i.taxonomy] for i in formula.inputs], "body": described(formula.body), "output": formula.output}
    return "formula:" + hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
