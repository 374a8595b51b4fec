"""Penalised logistic regression by proximal Newton steps.

MLlib's quasi-Newton optimiser reads the rows once per evaluation of the loss: over 168 correlated features 500 to 1,000
jobs a fit.  Here one pass gives loss, gradient and Hessian (a features x features matrix, summed over the tasks by a tree), the
quadratic model with the penalty is minimised on the driver, and some ten passes reach the same minimum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: widest table whose Hessian is formed, as in MLlib's normal equations
MAX_FEATURES = 4096

#: cells (rows x columns) of one block of rows
BLOCK_CELLS = 1_000_000


# what runs in tasks is nested, so that it travels by value and executors need not import this module
def _blocks(rows: DataFrame) -> DataFrame:
    """(label, features) as blocks of rows: ``n`` and the bytes of a matrix of the label, a 1 and the features."""
    most = BLOCK_CELLS

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                m = np.column_stack([b.column("label").to_numpy(zero_copy_only=False), np.ones(len(x)), x])
                step = max(1, most // m.shape[1])
                parts = [m[i:i + step] for i in range(0, len(m), step)]
                yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                                                 ["n", "cells"])

    return rows.mapInArrow(run, "n long, cells binary")


def _summed(blocks: RDD, f) -> tuple:
    """Sum over the blocks of the tuple of arrays ``f(label, x)``."""
    def run(rows):
        total = None
        for r in rows:
            m = np.frombuffer(r["cells"]).reshape(r["n"], -1)
            part = f(m[:, 0], m[:, 1:])
            total = part if total is None else tuple(a + b for a, b in zip(total, part))
        return [] if total is None else [total]

    return blocks.mapPartitions(run).treeReduce(lambda a, b: tuple(x + y for x, y in zip(a, b)))


def _moments():
    return lambda y, x: (np.array([float(len(y)), y.sum(), float(((y != 0) & (y != 1)).sum())]), x.sum(axis=0), (x * x).sum(axis=0))


def _derivatives(beta: np.ndarray):
    def f(y, x):
        m = x @ beta
        p = 0.5 * (1.0 + np.tanh(0.5 * m))
        return np.logaddexp(0.0, m).sum() - y @ m, x.T @ (p - y), (x * (p * (1.0 - p))[:, None]).T @ x

    return f


def minimise(grad: np.ndarray, hess: np.ndarray, at: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """``v`` that minimises ``grad.(v - at) + (v - at)'hess(v - at) / 2 + sum(l1 |v|)``: the minimum for the present signs, as far
    towards it as lowers the sum most, then the column that violates its bound most joins (feature-sign search)."""
    if not l1.any():
        return at - np.linalg.lstsq(hess, grad, rcond=None)[0]
    rhs, tiny, slack = hess @ at - grad, 1e-10 * np.diag(hess).max(), 1e-7 * l1.max()
    v = at.copy()
    sign, free = np.sign(v), (v != 0) | (l1 == 0)
    least = np.inf
    for _ in range(20 * len(v)):
        k = np.flatnonzero(free)
        w = v.copy()
        w[k] += np.linalg.solve(hess[np.ix_(k, k)] + tiny * np.eye(len(k)), (rhs - hess @ v - l1 * sign)[k])
        turns = np.flatnonzero((v * w < 0) & (l1 > 0))
        when = np.append(v[turns] / (v[turns] - w[turns]), 1.0)
        path = v + when[:, None] * (w - v)
        path[np.arange(len(turns)), turns] = 0.0
        value = 0.5 * ((path @ hess) * path).sum(axis=1) - path @ rhs + abs(path) @ l1
        best = value.argmin()
        v, sign = path[best], np.sign(path[best])
        free = (v != 0) | (l1 == 0)
        slope = hess @ v - rhs
        if abs(slope + l1 * sign)[free].max() <= slack:  # the minimum for these signs
            over = np.where(free, 0.0, abs(slope) - l1)
            j = over.argmax()
            if over[j] <= slack or not value[best] < least:
                break
            least = value[best]
            free[j], sign[j] = True, -np.sign(slope[j])
    return v


class NewtonLogisticRegression(LogisticRegression):
    """``LogisticRegression`` of two classes with unscaled penalties: same objective, parameters and model, fitted by Newton steps
    until the next one would lower the objective by less than a thousandth of ``tol`` of it.  What has no such fit
    (one class, other labels, weights, values that are not finite, very wide tables) goes to MLlib's own."""

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        if self.getStandardization() or not self.getFitIntercept() or self.getRegParam() <= 0 or self.isDefined(self.weightCol):
            return super()._fit(dataset)
        rows = dataset.select(F.col(self.getLabelCol()).cast("double").alias("label"), vector_to_array(self.getFeaturesCol()).alias("features"))
        first = rows.select(F.size("features").alias("width")).first()
        if first is None or not 0 < first["width"] <= MAX_FEATURES:
            return super()._fit(dataset)
        # the RDD, not the table: fits side by side make equal tables, and the first to end would release them all
        blocks = _blocks(rows).rdd.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            beta = self._minimum(blocks)
        finally:
            blocks.unpersist()
        if beta is None:
            return super()._fit(dataset)
        sc = dataset.sparkSession.sparkContext
        made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(self.uid, _py2java(sc, Vectors.dense(beta[1:])), float(beta[0]))
        return self._copyValues(LogisticRegressionModel(made))

    def _minimum(self, blocks: RDD) -> np.ndarray | None:
        """Intercept and coefficients, or None where there is no finite minimum to find this way."""
        (n, ones, other), total, squares = _summed(blocks, _moments())
        if other or not 0 < ones < n or not np.isfinite(squares).all():
            return None
        reg, share = self.getRegParam(), self.getElasticNetParam()
        # a constant column changes nothing that the intercept does not: no coefficient, as in MLlib
        mean = total / n
        used = np.flatnonzero(squares / n - mean * mean > 1e-12 * np.maximum(squares / n, 1e-300))
        used = np.concatenate([[0], used[used > 0]])
        inside = (used > 0).astype(float)
        l1, l2 = reg * share * inside, reg * (1.0 - share) * inside

        def at(v):
            beta = np.zeros(len(total))
            beta[used] = v
            loss, grad, hess = _summed(blocks, _derivatives(beta))
            return loss / n + (l1 * abs(v)).sum() + (l2 * v * v).sum() / 2, grad[used] / n + l2 * v, hess[np.ix_(used, used)] / n + np.diag(l2)

        v = np.zeros(len(used))
        v[0] = np.log(ones / (n - ones))
        f, grad, hess = at(v)
        for _ in range(self.getMaxIter()):
            d = minimise(grad, hess, v, l1) - v
            gain = -(grad @ d + (l1 * (abs(v + d) - abs(v))).sum())  # at a Newton step twice what the objective may still lose
            if not gain > 1e-3 * self.getTol() * abs(f):
                break
            size = 1.0
            while size > 1e-6:
                new = at(v + size * d)
                if new[0] <= f - 1e-4 * size * gain:
                    break
                size /= 2
            else:
                break
            v, (f, grad, hess) = v + size * d, new
        beta = np.zeros(len(total))
        beta[used] = v
        return beta
