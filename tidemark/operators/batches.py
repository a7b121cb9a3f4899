"""Vector arithmetic over Arrow batches, for the places where it dominates a query.

Spark decides what is in a batch; these helpers only turn columns into matrices. The column functions
in ``tidemark.functions`` give the same answers inside the JVM (the tests compare them)."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def shares(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def best(p: np.ndarray, k: int) -> np.ndarray:
    """Class ids of the ``k`` highest scores per row, ties to the lower id."""
    return np.argsort(-p, axis=1, kind="stable")[:, :k]


def ranker(kind: str, k: int, search: int, num_nouns: int):
    """Pandas UDF ``(verb scores, noun scores) -> (verbs, nouns, actions)``, the top ``k`` of each."""
    if kind not in ("logits", "probabilities"):
        raise ValueError("kind is logits or probabilities")
    if search < k:
        raise ValueError("search must be at least k")

    @F.pandas_udf("verbs array<int>, nouns array<int>, actions array<bigint>")
    def rank(verb: pd.Series, noun: pd.Series) -> pd.DataFrame:
        pv, pn = matrix(verb), matrix(noun)
        if kind == "logits":
            pv, pn = shares(pv), shares(pn)
        top_v, top_n = best(pv, search), best(pn, search)
        # candidates in id order: a stable sort on the product then prefers the lower joint id
        cv, cn = np.sort(top_v, axis=1), np.sort(top_n, axis=1)
        product = np.take_along_axis(pv, cv, 1)[:, :, None] * np.take_along_axis(pn, cn, 1)[:, None, :]
        ids = (cv[:, :, None] * num_nouns + cn[:, None, :]).reshape(len(pv), -1)
        first = best(product.reshape(len(pv), -1), k)
        actions = np.take_along_axis(ids, first, 1)
        return pd.DataFrame({"verbs": list(top_v[:, :k].astype("int32")), "nouns": list(top_n[:, :k].astype("int32")),
                             "actions": list(actions.astype("int64"))})

    return rank


def grid_hits(task: str, taus_v, taus_n, log_v, log_n, temperature: float, num_nouns: int, k: int = 5):
    """Pandas UDF ``(verb scores, noun scores, verb, noun) -> hit per grid cell``, row by row of the grid."""
    log_v, log_n = np.asarray(log_v, dtype="float64"), np.asarray(log_n, dtype="float64")

    @F.pandas_udf("array<boolean>")
    def hits(verb: pd.Series, noun: pd.Series, yv: pd.Series, yn: pd.Series) -> pd.Series:
        zv, zn = matrix(verb) / temperature, matrix(noun) / temperature
        yv, yn = yv.to_numpy(dtype="int64"), yn.to_numpy(dtype="int64")
        cells = []
        if task == "AR":
            right_v = [(zv - t * log_v).argmax(axis=1) == yv for t in taus_v]
            right_n = [(zn - t * log_n).argmax(axis=1) == yn for t in taus_n]
            cells = [a & b for a in right_v for b in right_n]
        else:
            def ranked(z, log_prior, tau, y):
                p = shares(z - tau * log_prior)
                ids = best(p, k)
                return ids, np.take_along_axis(p, ids, 1), np.take_along_axis(p, y[:, None], 1)[:, 0], (ids == y[:, None]).any(axis=1)
            axis_v = [ranked(zv, log_v, t, yv) for t in taus_v]
            axis_n = [ranked(zn, log_n, t, yn) for t in taus_n]
            mine_id = (yv * num_nouns + yn)[:, None, None]
            for iv, pv, mv, in_v in axis_v:
                for i_n, pn, mn, in_n in axis_n:
                    product, mine = pv[:, :, None] * pn[:, None, :], (mv * mn)[:, None, None]
                    ids = iv[:, :, None] * num_nouns + i_n[:, None, :]
                    ahead = (product > mine) | ((product == mine) & (ids < mine_id))
                    cells.append(in_v & in_n & (ahead.sum(axis=(1, 2)) < k))
        return pd.Series(list(np.stack(cells, axis=1)))

    return hits


def _flat(array: pa.Array) -> np.ndarray:
    return np.asarray(array.flatten().to_numpy(zero_copy_only=False), dtype="float64")


def attention(heads: int):
    """Arrow mapper over rows ``(id, q, steps: list<struct<k, ok, key, value>>)``: per row the attended
    vector and one weight list per head. Rows may have different numbers of steps; without any, the vector is zero and the lists are empty."""
    def run(batches):
        for batch in batches:
            some = np.asarray(batch.column(2).value_lengths().fill_null(0)) > 0
            if not some.all():
                none = batch.filter(pa.array(~some))
                ends = np.concatenate([[0], np.cumsum(none.column(1).value_lengths().fill_null(0))]).astype("int32")
                vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.zeros(ends[-1])))
                lists = pa.array([[[]] * heads] * none.num_rows, pa.list_(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([none.column(0), vectors, lists], names=[batch.schema.names[0], "attended", "weights"])
                batch = batch.filter(pa.array(some))
            if batch.num_rows == 0:
                continue
            steps = batch.column(2)
            counts = np.asarray(steps.value_lengths())
            items = steps.flatten()
            q = _flat(batch.column(1)).reshape(batch.num_rows, -1)
            dims = q.shape[1]
            ok = np.asarray(items.field("ok").to_numpy(zero_copy_only=False), dtype=bool)
            value = _flat(items.field("value")).reshape(len(items), dims)
            key = _flat(items.field("key")).reshape(len(items), dims) if "key" in items.type.names else value
            # NaN in a masked step must not reach the sums
            key, value = np.where(ok[:, None], key, 0.0), np.where(ok[:, None], value, 0.0)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            width = dims // heads
            split = (len(items), heads, width)
            score = (key * np.repeat(q, counts, axis=0)).reshape(split).sum(axis=2) / np.sqrt(width)
            score = np.where(ok[:, None], score, -np.inf)
            top = np.maximum.reduceat(score, starts, axis=0)
            top = np.where(np.isfinite(top), top, 0.0)
            e = np.exp(score - np.repeat(top, counts, axis=0))
            total = np.add.reduceat(e, starts, axis=0)
            w = e / np.repeat(np.where(total > 0, total, 1.0), counts, axis=0)
            out = np.add.reduceat(w[:, :, None] * value.reshape(split), starts, axis=0).reshape(batch.num_rows, dims)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype="int32") * dims), pa.array(out.ravel()))
            ends = np.concatenate([[0], np.cumsum(np.repeat(counts, heads))]).astype("int32")
            order = np.concatenate([w[a:a + n].T.ravel() for a, n in zip(starts, counts)])
            inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(order))
            outer = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype="int32") * heads), inner)
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, outer], names=[batch.schema.names[0], "attended", "weights"])
    return run
