"""A baseline whose answer is a closed form: weighted ridge regression of class indicators on pooled vectors.

Every task adds up its weighted moments (one small matrix per label field), the matrices are summed in two steps, and one solve of
``dims + 1`` unknowns is left. All fields are fitted in one pass over the rows; nothing iterates and no row is sampled."""
from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import all_finite
from .metrics import prior_arrays
from .stats import prior
from .vectors import score_frozen

FAN = 64


def _moments(fields: Mapping[str, int], weights: dict[str, np.ndarray], dims: int):
    """Arrow mapper over (vector, one column per field): ``X'W [X | Y]`` of the task row by row, a constant being the last of X."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {f: np.zeros((dims + 1, dims + 1 + n)) for f, n in fields.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ones((batch.num_rows, dims + 1))
            x[:, :dims] = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, dims)
            for at, (f, n) in enumerate(fields.items(), 1):
                known = np.flatnonzero(np.asarray(batch.column(at).is_valid()))
                y = np.asarray(batch.column(at).take(pa.array(known))).astype(np.int64)
                if len(y) and (y.min() < 0 or y.max() >= n):
                    raise ValueError(f"{f} holds classes outside 0 to {n - 1}")
                weighted = x[known] * weights[f][y][:, None]
                sums[f][:, :dims + 1] += weighted.T @ x[known]
                indicators = np.zeros((len(y), n))
                indicators[np.arange(len(y)), y] = 1
                sums[f][:, dims + 1:] += weighted.T @ indicators
        for f, s in sums.items():
            if s[-1, dims]:  # a row was counted
                yield pa.RecordBatch.from_arrays([pa.array([f] * (dims + 1)), pa.array(np.arange(dims + 1, dtype=np.int32)), pa.array(list(s))], names=["field", "i", "moments"])

    return run


def fit_ridge(features: DataFrame, fields: Mapping[str, int], weights: DataFrame | None = None, vector: str = "vector", reg: float = 1.0) -> dict[str, dict]:
    """``{field: {"W": classes x dims, "b": classes}}`` for label columns ``fields`` (name and number of classes): the minimum of
    ``sum of weight * |W v + b - indicator|^2 + reg * |W|^2``.

    ``weights`` is an optional table (field, class_id, weight); classes that it doesn't name weigh one. A row without a label counts for its other fields only, rows whose vector is null or not
    finite for none. Vectors of different lengths, labels out of range and fields without any row are errors. What reaches the driver is one matrix of
    ``dims + 1`` rows per field, whatever the number of rows."""
    if not reg > 0:
        raise ValueError("reg must be positive")
    table = {f: np.ones(n) for f, n in fields.items()}
    for r in weights.where(F.col("field").isin(*fields)).collect() if weights is not None else ():  # the label space
        table[r["field"]][r["class_id"]] = r["weight"]
    v = F.col(vector).cast("array<double>")
    rows = features.where(all_finite(v)).select(v.alias("v"), *fields)
    widths = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if widths["least"] is None or widths["least"] != widths["most"]:
        raise ValueError("no vectors to fit on" if widths["least"] is None else "vectors differ in length")
    dims = widths["most"]
    total = Summarizer.sum(array_to_vector("moments"))
    parts = rows.mapInArrow(_moments(fields, table, dims), "field string, i int, moments array<double>")
    some = parts.groupBy("field", "i", F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("fan")).agg(vector_to_array(total).alias("moments"))
    sums = {(r["field"], r["i"]): r["moments"] for r in some.groupBy("field", "i").agg(vector_to_array(total).alias("moments")).collect()}
    model = {}
    for f in fields:
        if (f, 0) not in sums:
            raise ValueError(f"no row has a label of {f}")
        m = np.array([sums[f, i] for i in range(dims + 1)])
        penalty = np.diag([reg] * dims + [0.0])
        solved = np.linalg.solve(m[:, :dims + 1] + penalty, m[:, dims + 1:])
        model[f] = {"W": solved[:dims].T, "b": solved[dims]}
    return model


def ridge_outputs(features: DataFrame, model: Mapping[str, dict], counts: DataFrame, use_prior: Column | str = "use_prior", version: str = "ridge-1",
                  vector: str = "vector", alpha: float = 1.0, floor: float = 1e-8) -> DataFrame:
    """Add ``verb_output`` and ``noun_output``: the fitted scores, or, where ``use_prior`` holds or the vector can't be used, the log of the smoothed
    class shares of ``counts`` (field, class_id, n). ``used_prior`` says which."""
    flag = F.col(use_prior) if isinstance(use_prior, str) else use_prior
    v = F.col(vector).cast("array<double>")
    dims = model["verb"]["W"].shape[1]
    usable = ~F.coalesce(flag, F.lit(True)) & all_finite(v) & (F.size(v) == dims)
    flagged = features.withColumn("used_prior", ~F.coalesce(usable, F.lit(False))).withColumn(vector, v)
    safe = flagged.withColumn("_v", F.when(F.col("used_prior"), F.array_repeat(F.lit(0.0), dims)).otherwise(v))
    stacked = {"W": np.concatenate([model[f]["W"] for f in ("verb", "noun")]), "b": np.concatenate([model[f]["b"] for f in ("verb", "noun")])}
    scored = score_frozen(safe, stacked, version, "_v")
    verbs, nouns = len(model["verb"]["b"]), len(model["noun"]["b"])
    cold = prior_arrays(prior(counts, alpha), "prior", log=True, floor=floor).select(F.col("verb_output").alias("_pv"), F.col("noun_output").alias("_pn"))
    out = scored.join(F.broadcast(cold), F.lit(True))  # one row of the label space
    return out.select(*flagged.columns, "scorer_version",
                      F.when(F.col("used_prior"), F.col("_pv")).otherwise(F.slice("scores", 1, verbs)).alias("verb_output"),
                      F.when(F.col("used_prior"), F.col("_pn")).otherwise(F.slice("scores", verbs + 1, nouns)).alias("noun_output"))
