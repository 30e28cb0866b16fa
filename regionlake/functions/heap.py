"""Task paths as heap indices: root 1, children 2h and 2h + 1. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def depth(h: Column) -> Column:
    return F.length(F.bin(h)) - 1


def parent(h: Column) -> Column:
    return F.shiftright(h, 1)


def left(h: Column) -> Column:
    return h * 2


def right(h: Column) -> Column:
    return h * 2 + 1


def ancestor(h: Column, at: Column | int) -> Column:
    """The ancestor at depth at; h itself or deeper paths of smaller depth give 0 or less sense: filter."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.call_function("shiftright", h, (depth(h) - at).cast("int"))


def in_subtree(h: Column, root: Column) -> Column:
    """Whether h is root or lies below it."""
    return (depth(h) >= depth(root)) & (F.call_function("shiftright", h, F.greatest(depth(h) - depth(root), F.lit(0)).cast("int")) == root)


def path(h: Column) -> Column:
    """The bits after the leading one."""
    return h - F.call_function("shiftleft", F.lit(1).cast("long"), depth(h).cast("int"))


def text(h: Column) -> Column:
    """The path as .0.1: root is the empty string."""
    return F.regexp_replace(F.substring(F.bin(h), 2, 64), "(.)", r".$1")
