"""String helpers. Invalid input becomes NULL; the integrity gates report it."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def video_number(video_id) -> Column:
    """``P01_101`` -> 101; NULL when there is no integer after the last underscore."""
    v = _col(video_id)
    tail = F.substring_index(v, "_", -1)
    return F.when(F.instr(v, "_") > 0, tail.try_cast("int"))


def config_name(run) -> Column:
    """Run name without its first ``_seed<N>``."""
    r = _col(run)
    pattern = r"^(.*?)_seed(\d+)(.*)$"
    cut = F.concat(F.regexp_extract(r, pattern, 1), F.regexp_extract(r, pattern, 3))
    return F.when(r.rlike(pattern), cut).otherwise(r)


def config_seed(run) -> Column:
    """The seed in a run name, NULL when it names none."""
    return F.regexp_extract(_col(run), r"_seed(\d+)", 1).try_cast("int")


def is_safe_id(event_id) -> Column:
    """Identifiers that are safe as file names: letters, digits, dot, underscore, hyphen."""
    return F.coalesce(_col(event_id).rlike(r"^[A-Za-z0-9_.-]+$"), F.lit(False))


def parse_bool(flag) -> Column:
    """``true`` or ``1`` in any case, surrounding space ignored; anything else is false."""
    text = F.lower(F.trim(_col(flag).cast("string")))
    return F.coalesce(text.isin("true", "1"), F.lit(False))


def format_mean_sd(mean, sd, n) -> Column:
    """``8.28 ± 0.11``; one value prints the mean alone, none prints a dash."""
    mean, sd, n = _col(mean), _col(sd), _col(n)
    return (F.when(mean.isNull() | (n == 0), F.lit("–"))
            .when(n == 1, F.format_string("%.2f", mean))
            .otherwise(F.format_string("%.2f ± %.2f", mean, sd)))
