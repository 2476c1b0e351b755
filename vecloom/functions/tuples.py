"""Arithmetic on fixed-width tuples, held as arrays (one type) or structs (mixed types)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
}


def array_transform(arr: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(arr, f)


def combine(a: Column, b: Column, op: str | Callable[[Column, Column], Column]) -> Column:
    """Element by element; arrays of one length (a longer one is an error)."""
    f = BINARY[op] if isinstance(op, str) else op
    same = F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) != F.size(b)), F.raise_error(F.lit("tuple lengths differ")).cast("array<double>")).otherwise(same)


def with_scalar(a: Column, s: Column, op: str, scalar_first: bool = False) -> Column:
    """tuple op scalar; the scalar may come first for + and *."""
    if scalar_first and op not in "+*":
        raise ValueError(f"scalar {op} tuple is not defined")
    f = BINARY[op]
    return F.transform(a, (lambda x: f(s, x)) if scalar_first else (lambda x: f(x, s)))


def assign(f: Callable[[Column], Column], kinds: StructType, struct: Column, first: int | None = None) -> Column:
    """Apply ``f`` to the first ``first`` (default all) members; results convert back to each member's own type."""
    n = len(kinds) if first is None else first
    return F.struct(*[(f(struct[k.name]).cast(k.dataType) if i < n else struct[k.name]).alias(k.name) for i, k in enumerate(kinds)])


def assign_pairwise(f: Callable[[Column, Column], Column], kinds: StructType, a: Column, b: Column, others: Sequence[str], first: int | None = None) -> Column:
    """a.k = f(a.k, b.k) for the first members; the widths must agree."""
    if len(kinds) != len(others):
        raise ValueError("tuple widths differ")
    n = len(kinds) if first is None else first
    return F.struct(*[(f(a[k.name], b[o]).cast(k.dataType) if i < n else a[k.name]).alias(k.name) for i, (k, o) in enumerate(zip(kinds, others))])


def array_to_struct(arr: Column, n: int) -> Column:
    return F.struct(*[arr[i].alias(f"_{i}") for i in range(n)])


def struct_to_array(struct: Column, kinds: StructType) -> Column:
    if len({k.dataType for k in kinds}) != 1:
        raise ValueError("members must have one type")
    return F.array(*[struct[k.name] for k in kinds])
