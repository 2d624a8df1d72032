"""Negative-binomial regression with a fixed dispersion and robust errors.

Row work stays on the executors: a pass sums weighted cross-products per
partition and Spark adds the partitions up, so the driver sees matrices as
wide as the model and never a row. Several models on one table share each pass.
Before the passes, rows with equal inputs are folded to one cell with their number, mean and spread: all that the fit and
its errors need of them. A pass over records with few distinct inputs costs as much as there are cells, not records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.session import settle

INTERCEPT = "Intercept"


@dataclass(frozen=True)
class Category:
    """A treatment-coded column: one 0/1 column per level but the first in sort order."""

    column: str

    def dummies(self, levels: dict[str, list]) -> list[tuple[str, Column]]:
        return [
            (f"C({self.column})[T.{level}]", (F.col(self.column) == F.lit(level)).cast("double"))
            for level in levels[self.column][1:]
        ]


@dataclass(frozen=True)
class Product:
    """Main effects of a category and a number, and their products."""

    category: Category
    number: str


Term = str | Category | Product


def _levels(df: DataFrame, terms: list[Term], max_levels: int = 1000) -> dict[str, list]:
    names = {
        t.category.column if isinstance(t, Product) else t.column for t in terms if isinstance(t, (Category, Product))
    }
    found = {}
    for name in sorted(names):
        rows = df.select(name).distinct().limit(max_levels + 1).collect()
        if len(rows) > max_levels:
            raise ValueError(f"{name} has more than {max_levels} levels")
        found[name] = sorted(r[0] for r in rows)
    return found


def design_columns(terms: list[Term], levels: dict[str, list]) -> dict[str, Column]:
    """Term name → double column, intercept first, each main effect once."""
    out: dict[str, Column] = {INTERCEPT: F.lit(1.0)}
    for term in terms:
        if isinstance(term, str):
            out[term] = F.col(term).cast("double")
        elif isinstance(term, Category):
            out.update(term.dummies(levels))
        else:
            number = F.col(term.number).cast("double")
            dummies = term.category.dummies(levels)
            out.update(dummies)
            out[term.number] = number
            out.update({f"{name}:{term.number}": flag * number for name, flag in dummies})
    return out


def _inputs(terms: list[Term]) -> list[str]:
    used = []
    for term in terms:
        used += [term] if isinstance(term, str) else (
            [term.column] if isinstance(term, Category) else [term.category.column, term.number]
        )
    return list(dict.fromkeys(used))


def _summed(design: DataFrame, partials) -> dict[str, np.ndarray]:
    """Run ``partials`` on every partition and add the (model, values) rows up."""
    parts = design.mapInPandas(partials, "model string, vals array<double>")
    cells = parts.select("model", F.posexplode("vals").alias("pos", "val"))
    total = cells.groupBy("model", "pos").agg(F.sum("val").alias("val")).toArrow().to_pandas()
    return {m: g.sort_values("pos")["val"].to_numpy() for m, g in total.groupby("model")}


def folded(df: DataFrame, response: str, inputs: list[str]) -> DataFrame:
    """Distinct inputs with the response's count ``_n``, mean ``_mean`` and sum of squared deviations ``_spread``."""
    y = F.col(response).cast("double")
    return df.groupBy(*inputs).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg(y).alias("_mean"),
                                   (F.var_pop(y) * F.count(F.lit(1))).alias("_spread"))


def _batches(batches: Iterator[pd.DataFrame]):
    for pdf in batches:
        if len(pdf):
            yield np.stack(pdf["x"].to_numpy()), *(pdf[c].to_numpy() for c in ("_n", "_mean", "_spread", "off"))


def _inverse(gram: np.ndarray) -> np.ndarray:
    """Pseudo-inverse after scaling columns to unit length; all-zero columns get zero."""
    scale = np.sqrt(np.diag(gram))
    unit = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    return np.linalg.pinv(gram * np.outer(unit, unit), rcond=1e-11, hermitian=True) * np.outer(unit, unit)


def _irls_pass(design, columns, betas, mean_y, alpha):
    def partials(batches):
        sums = {}
        for x_all, n, y, _, off in _batches(batches):
            for name, idx in columns.items():
                x = x_all[:, idx]
                eta = np.log((y + mean_y) / 2) if betas is None else x @ betas[name] + off
                mu = np.exp(eta)
                w = n * mu / (1 + alpha * mu)
                z = eta - off + (y - mu) / mu
                xw = x * w[:, None]
                part = np.concatenate([(xw.T @ x).ravel(), xw.T @ z, [n.sum()]])
                sums[name] = sums.get(name, 0) + part
        yield pd.DataFrame({"model": list(sums), "vals": [v.tolist() for v in sums.values()]})

    return _summed(design, partials)


def _sandwich_pass(design, columns, betas, breads, alpha):
    def partials(batches):
        sums = {}
        for x_all, n, y, spread, off in _batches(batches):
            for name, idx in columns.items():
                x = x_all[:, idx]
                mu = np.exp(x @ betas[name] + off)
                slack = 1 - mu / (1 + alpha * mu) * np.einsum("ij,jk,ik->i", x, breads[name], x)
                squares = (spread + n * (y - mu) ** 2) / (1 + alpha * mu) ** 2  # of the scores of the cell's rows
                jack = np.divide(squares, slack ** 2, out=np.zeros_like(squares), where=slack > 1e-10)
                score = n * (y - mu) / (1 + alpha * mu)
                sums[name] = sums.get(name, 0) + np.concatenate(
                    [((x * squares[:, None]).T @ x).ravel(), ((x * jack[:, None]).T @ x).ravel(), (x * score[:, None]).sum(axis=0)])
        yield pd.DataFrame({"model": list(sums), "vals": [v.tolist() for v in sums.values()]})

    return _summed(design, partials)


RESULT = (
    "model string, term string, coef double, se_hc0 double, se_hc3 double, z double, p_value double, "
    "ci_low double, ci_high double, dropped boolean, converged boolean, iterations int, n long, score double"
)


def fit_counts(
    df: DataFrame,
    response: str,
    models: dict[str, list[Term]],
    exposure: str | None = None,
    alpha: float = 1.0,
    tol: float = 1e-7,
    max_iter: int = 100,
    max_levels: int = 1000,
) -> DataFrame:
    """Coefficient tables of all ``models``, log link, offset ``log(exposure)``.

    Rows with a null in a used column are left out. Errors are the sandwich
    with raw (``se_hc0``) and leave-one-out (``se_hc3``) residuals; z, p and the
    95 % interval use the latter. Terms that are zero on all rows are reported
    as dropped. A fit has converged when no coefficient moves by more than
    ``tol`` of its standard error. ``score`` is what is left of each term's score
    equation, in units of its standard deviation. Models are as wide as their categories
    have levels; more than ``max_levels`` of one are refused.
    """
    everything = [t for terms in models.values() for t in terms]
    inputs = list(dict.fromkeys([*([exposure] if exposure else []), *_inputs(everything)]))
    rows = settle(folded(df.select(*dict.fromkeys([response, *inputs])).dropna(), response, inputs))
    levels = _levels(rows, everything, max_levels)
    per_model = {name: design_columns(terms, levels) for name, terms in models.items()}
    wide: dict[str, Column] = {}
    for cols in per_model.values():
        wide.update(cols)
    position = {name: i for i, name in enumerate(wide)}
    columns = {m: np.array([position[t] for t in cols]) for m, cols in per_model.items()}
    offset = F.log(F.col(exposure).cast("double")) if exposure else F.lit(0.0)
    design = rows.select(
        "_n", "_mean", "_spread", offset.alias("off"), F.array(*wide.values()).alias("x")
    )
    mean_y = rows.agg(F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).first()[0]

    betas: dict[str, np.ndarray] | None = None
    grams, count, done = {}, {}, {}
    for step in range(1, max_iter + 1):
        active = {m: idx for m, idx in columns.items() if m not in done}
        sums = _irls_pass(design, active, betas, mean_y, alpha)
        betas = dict(betas or {})
        for m, idx in active.items():
            p = len(idx)
            gram, moment = sums[m][: p * p].reshape(p, p), sums[m][p * p : p * p + p]
            beta = _inverse(gram) @ moment
            if step > 1 and np.max(np.abs(beta - betas[m]) * np.sqrt(np.diag(gram))) <= tol:
                done[m] = step
            betas[m], grams[m], count[m] = beta, gram, int(sums[m][-1])
        if len(done) == len(columns):
            break

    breads = {m: _inverse(g) for m, g in grams.items()}
    meats = _sandwich_pass(design, columns, betas, breads, alpha)
    out = []
    for m, idx in columns.items():
        p, bread = len(idx), breads[m]
        half = p * p
        errors = [
            np.sqrt(np.maximum(np.diag(bread @ meats[m][a : a + half].reshape(p, p) @ bread), 0)) for a in (0, half)
        ]
        zero = np.diag(grams[m]) == 0
        left = np.abs(meats[m][2 * half:]) / np.sqrt(np.where(zero, 1.0, np.diag(grams[m])))
        for j, term in enumerate(per_model[m]):
            coef, hc0, hc3 = float(betas[m][j]), float(errors[0][j]), float(errors[1][j])
            z = coef / hc3 if hc3 > 0 else None
            out.append((
                m, term, coef, hc0, hc3, z, math.erfc(abs(z) / math.sqrt(2)) if z is not None else None,
                coef - 1.959963984540054 * hc3, coef + 1.959963984540054 * hc3,
                bool(zero[j]), m in done, done.get(m, max_iter), count[m], float(left[j]),
            ))
    return df.sparkSession.createDataFrame(out, RESULT)
