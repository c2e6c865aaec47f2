"""Vector arithmetic as column expressions.

Up to `UNROLL` dimensions the loops run when the plan is built and unroll to scalar
arithmetic inside whole-stage code generation. Beyond that the generated method
would be too large for the JIT compiler (measured: 21 unrolled dimensions run nine
times slower than the higher-order functions, 12 run three times faster), so longer
vectors are summed by higher-order functions, behind a cheap test on the first
dimensions.
"""

from pyspark.sql import Column, functions as F

UNROLL = 12


def _squares(u: Column, v: Column, size: int) -> Column:
    total = F.lit(0.0)
    for i in range(size):
        gap = F.get(u, F.lit(i)) - F.get(v, F.lit(i))
        total = gap * gap if i == 0 else total + gap * gap
    return total


def l2(u: Column, v: Column, size: int) -> Column:
    if size <= UNROLL:
        return F.sqrt(_squares(u, v, size))
    gaps = F.zip_with(u, v, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x))


def within(u: Column, v: Column, size: int, radius: float) -> Column:
    near = l2(u, v, size) <= F.lit(radius)
    if size <= UNROLL:
        return near
    return (_squares(u, v, UNROLL) <= F.lit(radius * radius * (1 + 1e-9))) & near


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def distance_at(similarity_value: float) -> float:
    """The distance at which a pair has the given similarity."""
    return 1.0 / similarity_value - 1.0


def grid_cells(vector: Column, size: int, width: float, shift: Column) -> Column:
    return F.array(*[
        F.floor((F.get(vector, F.lit(i)) + shift) / F.lit(width)) for i in range(size)
    ])
