"""Evaluate an expression once and use it many times inside higher-order functions.

A lambda re-evaluates whatever it captures for every element. Binding the captured value to a lambda
variable first keeps element-wise vector arithmetic linear in the vector length."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
