"""Algebra of sorted id sets held as arrays, as column expressions. Bounds are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def intersect_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def bounded(a: Column, upper: Column) -> Column:
    """Elements below ``upper``."""
    return F.filter(a, lambda x: x < upper)


def intersect_bounded(a: Column, b: Column, upper: Column) -> Column:
    return bounded(intersect(a, b), upper)


def intersect_except(a: Column, b: Column, *ancestors: Column, upper: Column | None = None) -> Column:
    """Common elements other than the ancestors, below ``upper`` if given."""
    left = F.array_except(intersect(a, b), F.array(*ancestors))
    return F.array_sort(left if upper is None else bounded(left, upper))


def difference(a: Column, b: Column, owner: Column, upper: Column | None = None) -> Column:
    """Elements of ``a`` neither in ``b`` nor the vertex ``owner`` that ``b`` belongs to."""
    left = F.array_except(a, F.array_append(b, owner))
    return F.array_sort(left if upper is None else bounded(left, upper))


def labelled_difference(a: Column, b: Column, owner: Column, labels: Column, label: Column | int, upper: Column | None = None) -> Column:
    """Vertex-induced: elements of ``a`` with ``label``, neither in ``b`` nor its owner; ``labels`` goes beside ``a``, element by element."""
    mine = F.transform(F.filter(F.arrays_zip(a.alias("v"), labels.alias("l")), lambda x: x["l"] == label), lambda x: x["v"])
    return difference(mine, b, owner, upper)


def edge_difference(a: Column, owner: Column, labels: Column, label: Column | int) -> Column:
    """Edge-induced: elements of ``a`` with ``label`` other than ``owner``; further edges between them do not matter."""
    mine = F.transform(F.filter(F.arrays_zip(a.alias("v"), labels.alias("l")), lambda x: x["l"] == label), lambda x: x["v"])
    return F.array_sort(F.filter(mine, lambda x: x != owner))


def lower_bound(a: Column, value: Column) -> Column:
    """How many elements of a sorted array are below ``value``."""
    return F.size(bounded(a, value)).cast("long")


def in_intervals(a: Column, intervals: Column, upper: Column | None = None) -> Column:
    """How many values lie in any of the half-open, disjoint intervals ``struct(lo, hi)``."""
    hit = F.filter(a, lambda x: F.exists(intervals, lambda i: (x >= i["lo"]) & (x < i["hi"])))
    return F.size(hit if upper is None else bounded(hit, upper)).cast("long")


def intervals_overlap(a: Column, b: Column, upper: Column | None = None) -> Column:
    """How many integers two lists of half-open intervals share."""
    end = (lambda x, y: F.least(x, y)) if upper is None else (lambda x, y: F.least(x, y, upper))
    each = lambda i: F.aggregate(b, F.lit(0).cast("long"), lambda s, j: s + F.greatest(end(i["hi"], j["hi"]) - F.greatest(i["lo"], j["lo"]), F.lit(0)).cast("long"))
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, i: s + each(i))
