"""Readable names for run options."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col

# Gate branches in gate order.
BRANCHES = ("history", "present", "future")


def branch_list(text) -> Column:
    """Branches named in a comma list, in gate order; NULL when the list is empty or has others."""
    given = F.filter(F.transform(F.split(_col(text), ","), lambda b: F.trim(b)), lambda b: b != "")
    ordered = F.filter(F.array(*[F.lit(b) for b in BRANCHES]), lambda b: F.array_contains(given, b))
    unknown = F.size(F.array_except(given, F.array(*[F.lit(b) for b in BRANCHES])))
    return F.when((unknown == 0) & (F.size(given) > 0), ordered)


def fusion_label(fusion, branches, future_encoder) -> Column:
    """``aga``, or ``three_way H+P+F (future: mean)``; a future branch without encoder is left out."""
    fusion = F.coalesce(_col(fusion), F.lit("aga"))
    encoder = F.coalesce(_col(future_encoder), F.lit("none"))
    listed = F.split(F.coalesce(_col(branches), F.lit(",".join(BRANCHES))), ",")
    kept = F.filter(F.transform(listed, lambda b: F.trim(b)),
                    lambda b: (b != "") & ((b != "future") | (encoder != "none")))
    letters = F.array_join(F.transform(kept, lambda b: F.upper(F.substring(b, 1, 1))), "+")
    suffix = F.when(encoder == "none", F.lit("")).otherwise(F.concat(F.lit(" (future: "), encoder, F.lit(")")))
    return F.when(fusion != "three_way", fusion).otherwise(F.concat(F.lit("three_way "), letters, suffix))


def memory_label(memory_init, freeze_memory, step_features, step_keys) -> Column:
    """How the memory started, and whether its steps are stored scorer outputs."""
    none = F.coalesce(_col(memory_init), F.lit("")) == ""
    start = (F.when(none, F.lit("scratch"))
             .when(F.coalesce(_col(freeze_memory), F.lit(False)), F.lit("pre-trained (frozen)"))
             .otherwise(F.lit("pre-trained")))
    keys = F.when(_col(step_keys) == "features", F.lit(" (feature keys)")).otherwise(F.lit(""))
    plain = F.coalesce(_col(step_features), F.lit("")) == ""
    return F.when(plain, start).otherwise(F.concat(F.lit("probe steps"), keys, F.lit(", "), start))


def present_label(present_encoder, freeze_present) -> Column:
    """Present-clip setting of a run."""
    encoder = F.coalesce(_col(present_encoder), F.lit("mean"))
    frozen = F.coalesce(_col(freeze_present), F.lit(False))
    return (F.when(encoder == "none", F.lit("none (memory only)"))
            .when(frozen, F.concat(encoder, F.lit(" (frozen)")))
            .when(encoder == "probe", F.concat(encoder, F.lit(" (trainable)")))
            .otherwise(encoder))
