"""Three-valued logic, typed comparison and criterion trees as columns.

A truth value is a nullable boolean: SQL's AND, OR and NOT are Kleene's.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERED = ("number", "date")
OPERATORS = ("==", "!=", ">", ">=", "<", "<=")

#: Decisions from the best to the worst, for ranking.
PRIORITY = {"eligible": 2, "unknown": 1, "ineligible": 0}


@dataclass(frozen=True)
class Expr:
    """A criterion tree: op is atom, all, any or not."""

    op: str
    parts: tuple[Expr, ...] = ()
    atom: str = ""

    def __post_init__(self) -> None:
        arity = {"atom": 0, "not": 1}.get(self.op)
        if self.op not in ("atom", "all", "any", "not") or (arity is not None and len(self.parts) != arity) or (arity is None and not self.parts):
            raise ValueError(f"bad node {self.op} with {len(self.parts)} parts")
        if (self.op == "atom") != bool(self.atom):
            raise ValueError("exactly the atoms name a condition")


def atom(name: str) -> Expr:
    return Expr("atom", atom=name)


def all_of(*parts: Expr) -> Expr:
    return Expr("all", parts)


def any_of(*parts: Expr) -> Expr:
    return Expr("any", parts)


def negated(part: Expr) -> Expr:
    return Expr("not", (part,))


def truth(tree: Expr, atoms: Mapping[str, Column]) -> Column:
    """The tree's truth value, over one nullable boolean column per atom."""
    if tree.op == "atom":
        return atoms[tree.atom]
    parts = [truth(p, atoms) for p in tree.parts]
    if tree.op == "not":
        return ~parts[0]
    return reduce((lambda a, b: a & b) if tree.op == "all" else (lambda a, b: a | b), parts)


def truth_sql(tree: Expr, atoms: Mapping[str, str]) -> str:
    """The same as one SQL expression over expressions per atom; much cheaper to build for large rule sets."""
    if tree.op == "atom":
        return f"({atoms[tree.atom]})"
    parts = [truth_sql(p, atoms) for p in tree.parts]
    return f"(NOT {parts[0]})" if tree.op == "not" else "(" + (" AND " if tree.op == "all" else " OR ").join(parts) + ")"


def decision(value: Column, kind: Column) -> Column:
    """A criterion's decision: inclusion criteria want true, exclusion criteria false."""
    met = F.when(kind == "inclusion", value).otherwise(~value)
    return F.when(met.isNull(), F.lit("unknown")).when(met, F.lit("eligible")).otherwise(F.lit("ineligible"))


def reasons(pairs: Mapping[str, Column]) -> Column:
    """The names whose conditions hold, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in pairs.items()]))


def first_reason(pairs: Mapping[str, Column], otherwise: str | None = None) -> Column:
    """The first name whose condition holds: a precedence cascade."""
    chain = F.lit(otherwise).cast("string")
    for name, c in reversed(pairs.items()):
        chain = F.when(F.coalesce(c, F.lit(False)), F.lit(name)).otherwise(chain)
    return chain


def ratio(top: Column, bottom: Column, empty: float | None = None) -> Column:
    """top / bottom as double; `empty` (default null) where the bottom is 0 or null."""
    return F.when(F.coalesce(bottom, F.lit(0)) != 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(empty).cast("double"))
