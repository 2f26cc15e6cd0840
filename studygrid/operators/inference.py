"""Linear models of any number of predictors from matrices that one pass adds up."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studygrid.functions.tdist import t_quantile, t_two_sided


def _known(df: DataFrame, names: list[str]) -> DataFrame:
    rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)))
    return rows.where(" AND ".join(f"x{i} IS NOT NULL AND NOT isnan(x{i})" for i in range(len(names))))


def moments(df: DataFrame, names: list[str]) -> DataFrame:
    """One row ``(n, means, covariances)`` of the rows that have all of the columns; covariances (of the population) row by row of the upper triangle."""
    rows, k = _known(df, names), len(names)
    return rows.agg(
        F.count("*").alias("n"),
        F.array(*(F.avg(f"x{i}") for i in range(k))).alias("means"),
        F.array(*(F.covar_pop(f"x{i}", f"x{j}") for i in range(k) for j in range(i, k))).alias("covariances"),
    )


def products(df: DataFrame, names: list[str]) -> DataFrame:
    """One row ``(n, products)``: sums of products of two columns, about zero, row by row of the upper triangle."""
    rows, k = _known(df, names), len(names)
    return rows.agg(F.count("*").alias("n"), F.array(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k))).alias("products"))


def _square(flat, k: int):
    import numpy as np

    out = np.zeros((k, k))
    out[np.triu_indices(k)] = flat
    return out + np.triu(out, 1).T


def _inverse(matrix):
    """By Cholesky of the matrix scaled to a unit diagonal; None if it is singular."""
    import numpy as np

    scale = np.sqrt(np.diag(matrix))
    if not (scale > 0).all():
        return None
    try:
        lower = np.linalg.cholesky(matrix / np.outer(scale, scale))
    except np.linalg.LinAlgError:
        return None
    if np.diag(lower).min() < 1e-7:
        return None
    half = np.linalg.solve(lower, np.eye(len(scale)))
    return half.T @ half / np.outer(scale, scale)


def fit_many(df: DataFrame, y: str, predictors: list[str], alpha: float = 0.05) -> DataFrame:
    """``(term, n, estimate, se, t, p, ci_low, ci_high)`` of y on a constant (``Intercept``) and the predictors.

    Rows without all values are left out. Standard errors and the rest are null
    without a degree of freedom, all but n where predictors depend on each other.
    Only one row of sums meets a task, whose matrix is as wide as the predictors are many.
    """
    terms, k = ["Intercept", *predictors], len(predictors)

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in frames:
            for n, means, covariances in zip(frame["n"], frame["means"], frame["covariances"], strict=True):
                out = {c: [None] * (k + 1) for c in ("estimate", "se", "t", "p", "ci_low", "ci_high")}
                all_ = _square(list(covariances), k + 1) if n else None
                inverse = _inverse(all_[1:, 1:]) if n and k else (np.zeros((0, 0)) if n else None)
                if inverse is not None:
                    means = np.array(list(means), float)
                    slopes = inverse @ all_[1:, 0]
                    out["estimate"] = [means[0] - slopes @ means[1:], *slopes]
                    free, left = int(n) - k - 1, max(0.0, all_[0, 0] - slopes @ all_[1:, 0])
                    if free > 0:
                        variance = left * n / free
                        se = np.sqrt(variance * np.r_[(1 + means[1:] @ inverse @ means[1:]) / n, np.diag(inverse) / n])
                        reach = t_quantile(1 - alpha / 2, free)
                        out["se"] = list(se)
                        out["t"] = [b / s if s > 0 else None for b, s in zip(out["estimate"], se, strict=True)]
                        out["p"] = [None if t is None else t_two_sided(t, free) for t in out["t"]]
                        out["ci_low"], out["ci_high"] = ([b + w * reach * s for b, s in zip(out["estimate"], se, strict=True)] for w in (-1, 1))
                yield pd.DataFrame({"term": terms, "n": int(n), **{c: pd.Series(v, dtype="float64") for c, v in out.items()}})

    numbers = ", ".join(f"{c} double" for c in ("estimate", "se", "t", "p", "ci_low", "ci_high"))
    return moments(df, [y, *predictors]).mapInPandas(work, f"term string, n long, {numbers}")


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, vif)``: variance inflation of each column of a design without a constant, from R² about zero; infinite for dependent columns."""
    k = len(columns)

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in frames:
            for n, flat in zip(frame["n"], frame["products"], strict=True):
                found = [None] * k
                if n:
                    matrix = _square(list(flat), k)
                    inverse = _inverse(matrix)
                    if inverse is not None:
                        found = list(np.diag(matrix) * np.diag(inverse))
                    else:
                        for j in range(k):
                            rest = [i for i in range(k) if i != j]
                            share = matrix[j, rest] @ np.linalg.pinv(matrix[np.ix_(rest, rest)], rcond=1e-12) @ matrix[rest, j] / matrix[j, j] if matrix[j, j] else np.nan
                            found[j] = np.inf if share > 1 - 1e-9 else 1 / (1 - share)
                yield pd.DataFrame({"column": columns, "vif": pd.Series(found, dtype="float64")})

    return products(df, columns).mapInPandas(work, "column string, vif double")
