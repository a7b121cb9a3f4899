"""Vector features as table operators."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import all_finite, dot, let, mask_vector, mean_vector, normalize
from ..session import with_scalar
from .batches import attention
from .retrieval import retrieval_hits, retrieval_top1  # noqa: F401


def mean_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Add ``vector``, the mean over an array of token vectors."""
    return df.withColumn("vector", mean_vector(tokens))


def _mean(vec: Column) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(vec.cast("array<double>"))))


def _bins(at: Column, n: int, out: int) -> Column:
    """Adaptive pooling: output bins ``[floor(i n / out), ceil((i + 1) n / out))`` that hold ``at``."""
    return F.filter(F.sequence(F.lit(0), F.lit(out - 1)),
                    lambda i: (F.floor(i * n / out) <= at) & (at < F.ceil((i + 1) * n / out)))


def pool_tokens(tokens: DataFrame, slices: int = 8, grid: int = 24, out: int = 4, last: int = 2,
                by: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Long ``(clip_id, t, y, x, vec)`` to ``slices`` temporal means (positions 0..slices-1) followed
    by an ``out`` x ``out`` spatial pool over the last ``last`` slices. Every token is sent to its
    positions and averaged in one aggregation with partial sums."""
    spatial = F.flatten(F.transform(_bins(F.col("y"), grid, out), lambda r: F.transform(
        _bins(F.col("x"), grid, out), lambda c: slices + r * out + c)))
    places = F.concat(F.array(F.col("t")), F.when(F.col("t") >= slices - last, spatial).otherwise(
        F.array().cast("array<int>"))).cast("array<int>")
    return (tokens.select(*by, F.explode(places).alias("position"), "vec")
            .groupBy(*by, "position").agg(_mean(F.col("vec")).alias("vec")))


def merge_predicted(observed: DataFrame, predicted: DataFrame, slices: int = 8, grid: int = 24, out: int = 4,
                    pred_slices: int = 1, by: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Pooled observed tokens plus a predicted block: the observed slices shift left by the number
    of predicted slices, the predicted slice means follow, and the spatial pool is the predicted one."""
    pooled = pool_tokens(predicted, pred_slices, grid, out, pred_slices, by)
    drop = max(0, pred_slices - slices)
    shifted = min(pred_slices, slices)
    old = (observed.where((F.col("position") < slices) & (F.col("position") >= shifted))
           .withColumn("position", (F.col("position") - shifted).cast("int")))
    new_slices = (pooled.where((F.col("position") < pred_slices) & (F.col("position") >= drop))
                  .withColumn("position", (F.col("position") - drop + slices - shifted).cast("int")))
    space = (pooled.where(F.col("position") >= pred_slices)
             .withColumn("position", (F.col("position") - pred_slices + slices).cast("int")))
    return old.select(*by, "position", "vec").unionByName(new_slices).unionByName(space)


def predicted_mean(df: DataFrame, positions: Sequence[int], tokens: str = "tokens") -> DataFrame:
    """Mean over the chosen token positions (those that hold predictions)."""
    chosen = F.filter(F.col(tokens), lambda t, i: i.isin(*positions))
    return df.withColumn("vector", mean_vector(chosen))


def offdiag_cosine(df: DataFrame, vector: str) -> DataFrame:
    """Mean cosine between different rows, from one sum: ``(|sum u|^2 - sum |u|^2) / (n (n - 1))``
    over unit vectors. No pairs are built."""
    u = df.select(normalize(vector).alias("u"))
    s = u.agg(vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("_s"), F.sum(dot("u", "u")).alias("_q"),
              F.count(F.lit(1)).alias("n"))
    pairs = F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1))
    return s.select("n", ((dot("_s", "_s") - F.col("_q")) / pairs).alias("mean_cosine"))


def dimension_spread(df: DataFrame, vector: str, collapsed: float = 0.99) -> DataFrame:
    """Mean over dimensions of the sample standard deviation, with the mean cosine and whether it
    says that the vectors are nearly identical."""
    spread = df.agg(vector_to_array(Summarizer.std(array_to_vector(F.col(vector).cast("array<double>")))).alias("_sd"))
    mean = F.aggregate("_sd", F.lit(0.0), lambda a, x: a + x) / F.size("_sd")
    return (with_scalar(spread, offdiag_cosine(df, vector))
            .select(mean.alias("mean_sd"), "mean_cosine", (F.col("mean_cosine") > collapsed).alias("collapsed")))


def attend(steps: DataFrame, query: str, key: str, value: str, valid: str, heads: int = 1,
           by: str = "narration_id", order: str = "k", queries: DataFrame | None = None) -> DataFrame:
    """Masked attention per event: scaled dot products of the query with the keys of valid steps,
    softmax, weighted sum of values. Without a usable key the result is a zero vector and zero
    weights. Heads are equal consecutive ranges of the vectors.

    Steps of an event are few and fixed in number; each is scored before they are brought together. With
    ``queries`` (``by`` and the query), the query joins once per event instead of travelling with every step, and
    events without any step are answered too; leave steps that aren't valid out then."""
    fields = [F.col(order).alias("k"), F.col(valid).alias("ok")]
    fields += [F.col(key).alias("key")] if key != value else []
    item = F.struct(*fields, F.col(value).alias("value"))
    kind = dict(steps.dtypes)[by]
    schema = f"{by} {kind}, attended array<double>, weights array<array<double>>"
    gathered = F.array_sort(F.collect_list(item)).alias("steps")
    if queries is None:
        return steps.groupBy(by).agg(F.first(query).alias("q"), gathered).mapInArrow(attention(heads), schema)
    asked = queries.select(by, F.col(query).alias("q"))
    told = asked.join(steps.groupBy(by).agg(gathered), by, "left")
    return told.mapInArrow(attention(heads), schema)


def gate_fuse(df: DataFrame, branches: Sequence[str], scores: str, available: str) -> DataFrame:
    """Softmax of the branch scores over available branches only, then the weighted sum of the branch
    vectors. Values of a missing branch are ignored even when NaN; with none available both the
    weights and the fused vector are zero."""
    n = len(branches)
    masked = [F.when(F.col(available)[i], F.col(scores)[i].cast("double")) for i in range(n)]
    top = F.greatest(*masked) if n > 1 else masked[0]
    e = [F.coalesce(F.exp(m - top), F.lit(0.0)) for m in masked]
    total = sum(e[1:], e[0])
    out = df.withColumn("gate_weights", F.array(*[F.when(total > 0, x / total).otherwise(F.lit(0.0)) for x in e]))

    def weighted(b, i):
        return let(F.col("gate_weights")[i], lambda w: F.transform(mask_vector(b, F.col(available)[i]), lambda x: x * w))

    parts = [weighted(b, i) for i, b in enumerate(branches)]
    fused = parts[0]
    for p in parts[1:]:
        fused = F.zip_with(fused, p, lambda a, b: a + b)
    return out.withColumn("fused", fused)


def availability(history_rows: DataFrame, present: DataFrame, future: DataFrame | None = None, steps: int = 16,
                 vector: str = "future") -> DataFrame:
    """Per event: any valid step before the last, a present clip, a finite future vector that is not
    all zeros."""
    past = history_rows.groupBy("narration_id").agg(
        F.max(F.col("valid") & (F.col("k") < steps)).alias("history_available"))
    out = past.join(present.select("narration_id", (F.col("present_source") > 0).alias("present_available")), "narration_id", "left")
    if future is not None:
        v = F.col(vector).cast("array<double>")
        flag = F.coalesce(all_finite(v) & F.exists(v, lambda x: x != 0), F.lit(False))
        out = out.join(future.select("narration_id", flag.alias("future_available")), "narration_id", "left")
        out = out.withColumn("future_available", F.coalesce("future_available", F.lit(False)))
    return out.withColumn("present_available", F.coalesce("present_available", F.lit(False)))


def score_frozen(features: DataFrame, weights: dict, version: str, vector: str = "vector",
                 done: str | None = None) -> DataFrame:
    """Apply a frozen linear scorer, ``scores = W v + b``, to every feature row in Arrow batches and
    tag the rows with its version. ``weights`` holds numpy arrays ``W`` (classes x dims) and ``b``.

    ``done`` is the version already stored: equal means nothing to do, different is refused."""
    if done == version:
        return features
    if done is not None:
        raise ValueError(f"features already carry scores of version {done}; write {version} elsewhere")
    import numpy as np

    w, b = np.asarray(weights["W"], dtype="float64"), np.asarray(weights["b"], dtype="float64")
    shared = features.sparkSession.sparkContext.broadcast((w, b))
    schema = T.StructType([*features.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType())),
                           T.StructField("scorer_version", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        matrix, bias = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            flat = table.column(vector).combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            v = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype="float64").reshape(len(batch), -1)
            scores = v @ matrix.T + bias
            offsets = pa.array(np.arange(len(batch) + 1, dtype="int32") * matrix.shape[0])
            column = pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))
            table = table.append_column("scores", column)
            yield from table.append_column("scorer_version", pa.array([version] * len(batch))).to_batches()

    return features.mapInArrow(run, schema)


def score_classes(features: DataFrame, classes: DataFrame, version: str, vector: str = "vector") -> DataFrame:
    """As ``score_frozen`` for a table of classes ``(class_id, w, b)``, of any number: the class table, which the label space
    bounds, becomes one broadcast row and never passes the driver. ``scores`` maps class ids to ``w v + b``."""
    rows = classes.agg(F.collect_list(F.struct("class_id", "w", "b")).alias("_classes"))
    v = F.col(vector).cast("array<double>")
    scores = F.map_from_entries(F.transform("_classes", lambda c: F.struct(c["class_id"], dot(v, c["w"]) + c["b"])))
    return with_scalar(features, rows).withColumn("scores", scores).withColumn("scorer_version", F.lit(version)).drop("_classes")


def fit_baseline(features: DataFrame, field: str, weights: DataFrame | None = None, vector: str = "vector",
                 max_iter: int = 50, reg: float = 1e-2):
    """Multinomial logistic regression of one label field on pooled vectors; ``weights`` is an
    optional ``(class_id, weight)`` table. The fitted model's ``transform`` adds probabilities."""
    from pyspark.ml.classification import LogisticRegression

    data = features.where(F.col(field).isNotNull()).select("*", array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
                                                          F.col(field).cast("double").alias("label"))
    args = dict(featuresCol="features", labelCol="label", family="multinomial", maxIter=max_iter, regParam=reg,
                tol=1e-6)
    if weights is not None:
        data = data.join(F.broadcast(weights.select(F.col("class_id").cast("double").alias("label"), "weight")), "label")
        args["weightCol"] = "weight"
    return LogisticRegression(**args).fit(data)
