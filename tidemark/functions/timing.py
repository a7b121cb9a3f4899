"""Time arithmetic. Seconds are doubles; subtraction of the gap is exact decimal."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .text import _col

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_EXACT = "decimal(20,9)"


def parse_seconds(text) -> Column:
    """``HH:MM:SS.ff`` (hours >= 0, 0 <= minutes, seconds < 60) or plain seconds; else NULL."""
    t = F.trim(_col(text).cast("string"))
    parts = F.split(t, ":")

    def part(i):
        p = F.trim(parts[i])
        return F.when(p.rlike(_NUMBER), p.try_cast(_EXACT))

    h, m, s = part(0), part(1), part(2)
    legal = (h >= 0) & (m >= 0) & (m < 60) & (s >= 0) & (s < 60)
    clock = F.when(legal, (h * 3600 + m * 60 + s).cast("double"))
    plain = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    seconds = F.when(F.size(parts) == 3, clock).when(F.size(parts) == 1, plain)
    return F.when(F.abs(seconds) < F.lit(math.inf), seconds)


def cutoff(start, gap: float = 1.0) -> Column:
    """``start - gap``, subtracted as decimals so 0.1 + 0.2 style noise never moves the cutoff."""
    return (_col(start).cast(_EXACT) - F.lit(str(gap)).cast(_EXACT)).cast("double")


def observation(start, stop, sta_cutoff, task, context: float = 5.0) -> Column:
    """What may be observed. AR sees ``[start, stop)``; STA sees the ``context`` seconds that end
    at the cutoff, end included; a cutoff before the video start sees nothing."""
    if not (context > 0 and math.isfinite(context)):
        raise ValueError("context must be positive and finite")
    start, stop, c, task = _col(start), _col(stop), _col(sta_cutoff), _col(task)
    zero = F.lit(0.0)

    def window(lo, hi, inclusive, empty):
        return F.struct(lo.alias("start"), hi.alias("end"), F.lit(inclusive).alias("inclusive_end"),
                        F.lit(empty).alias("empty"))

    return (F.when(task == "AR", window(start, stop, False, False))
            .when((task == "STA") & (c < 0), window(zero, c, True, True))
            .when(task == "STA", window(F.greatest(zero, c - context), c, True, False)))


def step_times(sta_cutoff, steps: int = 16, stride: float = 1.0) -> Column:
    """Array of ``steps`` anchors; the last one is the cutoff itself."""
    if steps < 1 or not stride > 0:
        raise ValueError("need steps >= 1 and stride > 0")
    c = _col(sta_cutoff)
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: c - (steps - k) * F.lit(float(stride)))


def targets(start, end, n: int = 8) -> Column:
    """Mid-points of ``n`` equal bins of a window."""
    if n < 1:
        raise ValueError("need at least one target")
    lo, hi = _col(start), _col(end)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: lo + (i + F.lit(0.5)) * (hi - lo) / F.lit(n))


def half_even_count(n, fraction: float) -> Column:
    """Size of a hold-out: half-even rounding of ``n * fraction``, kept within ``[1, n - 1]``."""
    n = _col(n)
    return F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(float(fraction)), 0).cast("long")))
