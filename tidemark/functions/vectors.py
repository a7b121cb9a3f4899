"""Array arithmetic with higher-order functions; everything stays in the JVM."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let
from .text import _col


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _doubles(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(v), lambda x: x * x)))


def normalize(v, eps: float = 1e-12) -> Column:
    """Unit vector; a zero vector stays zero."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda length: F.transform(_doubles(v), lambda x: x / length))


def cosine(a, b, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def softmax(z) -> Column:
    """Shifted by the maximum so large scores cannot overflow."""
    def shares(e):
        return let(_sum(e), lambda total: F.transform(e, lambda x: x / total))

    def shifted(z):
        return let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp(x - top)), shares))

    return let(_doubles(z), shifted)


def adjust(logits, log_prior, tau: float = 0.0, temperature: float = 1.0) -> Column:
    """``z / T - tau * log(pi)``: a positive tau lifts rare classes."""
    if not 0 < temperature < float("inf"):
        raise ValueError("temperature must be positive")
    return F.zip_with(_doubles(logits), _doubles(log_prior),
                      lambda z, p: z / F.lit(float(temperature)) - F.lit(float(tau)) * p)


def all_finite(v) -> Column:
    """True when no element is NULL, NaN or infinite."""
    return F.coalesce(F.forall(_doubles(v), lambda x: x.isNotNull() & ~F.isnan(x)
                               & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def zero_vector(like) -> Column:
    return F.transform(_doubles(like), lambda x: F.lit(0.0))


def mask_vector(v, keep) -> Column:
    """The vector where ``keep`` holds, zeros elsewhere; NaN in a masked vector is dropped too."""
    return F.when(_col(keep), _doubles(v)).otherwise(zero_vector(v))


def gate_mix(h, e, g) -> Column:
    """Element-wise ``g * h + (1 - g) * e`` for a vector gate in [0, 1]."""
    h, e, g = _doubles(h), _doubles(e), _col(g)
    pairs = F.arrays_zip(h.alias("h"), e.alias("e"))
    return F.zip_with(pairs, g.cast("array<double>"),
                      lambda p, w: w * p["h"] + (F.lit(1.0) - w) * p["e"])


def mean_vector(tokens) -> Column:
    """Element-wise mean of an array of equally long vectors."""
    t = _col(tokens).cast("array<array<double>>")
    total = F.aggregate(t, F.transform(F.get(t, F.lit(0)), lambda x: F.lit(0.0)),
                        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return let(F.size(t), lambda n: F.transform(total, lambda x: x / n))


def named_slice(packed, layout: dict[str, tuple[int, int]], name: str) -> Column:
    """A named half-open range of a packed vector."""
    lo, hi = layout[name]
    return F.slice(_col(packed), lo + 1, hi - lo)


def joint_id(verb, noun, num_nouns: int = 300) -> Column:
    return _col(verb).cast("long") * num_nouns + _col(noun)


def split_joint_id(action, num_nouns: int = 300) -> Column:
    a = _col(action)
    noun = F.pmod(a, F.lit(num_nouns))
    return F.struct(((a - noun) / num_nouns).cast("int").alias("verb"), noun.cast("int").alias("noun"))
