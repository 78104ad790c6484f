"""Regressions whose sums are aggregations: no design matrix leaves the tasks that hold its rows.

* Logistic models by Newton steps: many scores share one pass over the rows a step.
* Ridge by folds: Gram matrices of folds, training ones as the total less the fold's; the leave-one-out
  error of every penalty from leverages, in one more pass.
* Elastic nets by folds: coordinate descent on Gram matrices of (fold, inner fold) cells, all from one pass; the
  penalty by inner cross-validation, whose errors follow from the same matrices.
* Least squares with an interaction; a category is absorbed by centring within its levels."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.local import CELLS, TooLarge, cut, sized_broadcast, to_local
from ..functions.special import normal_two_sided, t_two_sided
from ..functions.sums import block_sums

ROUNDS, STEP, FAR, SWEEPS = 100, 1e-10, 50.0, 3000
#: Levels of a category at most, and numbers of a block in a task.
LEVELS, BLOCK = 1000, 4_000_000


def levels_of(rows: DataFrame, category: str) -> list:
    """The levels of a category in order; a column with more than LEVELS of them is none."""
    found = to_local(rows.select(category).filter(F.col(category).isNotNull()).distinct(), f"levels of {category}", cells=LEVELS)
    return sorted(found[category].tolist())


# ---------------------------------------------------------------- logistic


def _design(rows: DataFrame, controls: Sequence[str], categories: Sequence[str]) -> list[Column]:
    """1, the controls, and 0/1 columns of the categories' levels but the first."""
    out = [F.lit(1.0), *[F.col(c).cast("double") for c in controls]]
    for c in categories:
        out += [(F.col(c) == F.lit(v)).cast("double") for v in levels_of(rows, c)[1:]]
    return out


def _sums(pdf: pd.DataFrame, b: np.ndarray, live: np.ndarray, scores: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """For each live score: rows, ones, gradient, and the upper triangle of X'WX, the score's column last."""
    p, k = b.shape[1] - 1, len(live)
    up = np.triu_indices(p)
    total = np.zeros((2 + p + 1 + len(up[0]) + p + 1, k))
    step = max(1, BLOCK // max(1, len(b)))
    for lo in range(0, len(pdf), step):
        part = pdf.iloc[lo : lo + step]
        x, s, y = np.stack(part["x"].to_numpy()).astype(float), scores(part)[:, live], part["y"].to_numpy(float)
        ok = np.isfinite(s)
        s = np.where(ok, s, 0.0)
        mu = 1 / (1 + np.exp(-np.clip(x @ b[live, :p].T + s * b[live, p], -35, 35)))
        w, r = mu * (1 - mu) * ok, (y[:, None] - mu) * ok
        total += np.vstack([ok.sum(0), y @ ok, x.T @ r, (s * r).sum(0), (x[:, up[0]] * x[:, up[1]]).T @ w, x.T @ (w * s), (w * s * s).sum(0)])
    return total.ravel()


def logistic(scores: DataFrame, lines: DataFrame, y: str, controls: Sequence[str] = (), categories: Sequence[str] = (), sample: str = "sample", feature: str = "feature", score: str = "score") -> DataFrame:
    """feature, n, coef, se, z, p, odds, lo, hi, status, rounds of y (0/1) on each score, standardised over
    all lines that have it, beside the controls and categories.

    scores: sample, feature, score; lines: sample, y, controls, categories. Lines with a null among them
    take no part in a fit. All fits take each Newton step in one pass; status is ok, one class, constant,
    separated (a coefficient beyond 50), singular or not converged, and all but ok leave NULLs."""
    full = lines.filter(F.col(y).isNotNull()).dropna(subset=[*controls, *categories])
    names = to_local(scores.select(feature).distinct(), "scores to fit").sort_values(feature)[feature].tolist()
    spark = scores.sparkSession
    kind = scores.schema[feature].dataType.simpleString()
    index = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"`{feature}` {kind}, _k int")
    known = scores.select(sample, feature, score).filter(F.col(score).isNotNull()).join(lines.select(sample), sample, "left_semi").join(sized_broadcast(index, 48), feature)
    at = known.groupBy("_k").agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    z = F.try_divide(F.col(score) - F.col("_m"), F.nullif("_s", F.lit(0.0)))
    cells = known.join(sized_broadcast(at, 32), "_k").select(sample, F.struct("_k", z.alias("z")).alias("c")).filter("c.z IS NOT NULL")
    by = F.map_from_entries("c")
    wide = cells.groupBy(sample).agg(F.collect_list("c").alias("c")).select(sample, F.transform(F.sequence(F.lit(0), F.lit(max(len(names) - 1, 0))), lambda i: F.coalesce(F.try_element_at(by, i), F.lit(float("nan")))).alias("s"))
    design = _design(full, controls, categories)
    rows = cut(full.join(wide, sample).select(F.array(*design).alias("x"), "s", F.col(y).cast("double").alias("y")))
    return _newton(rows, len(design), names, f"`{feature}` {kind}", lambda pdf: np.stack(pdf["s"].to_numpy()).astype(float))


def logistic_derived(held: DataFrame, derive: Callable[[pd.DataFrame], np.ndarray], count: int, lines: DataFrame, y: str, controls: Sequence[str] = (), categories: Sequence[str] = (), sample: str = "sample", feature: str = "feature") -> DataFrame:
    """What `logistic` gives for features 0 to count - 1, whose scores are no rows: derive(rows of held) makes them anew
    in each pass, a row a line and a column a feature, NaN where a line has none. Features without any score are left out.

    held: sample, and what derive needs of it, one row a sample."""
    full = lines.filter(F.col(y).isNotNull()).dropna(subset=[*controls, *categories])
    held = cut(held.join(lines.select(sample), sample, "left_semi"))
    step = max(1, BLOCK // max(1, count))

    def parts(pdf: pd.DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        return sum((of(derive(pdf.iloc[lo : lo + step])) for lo in range(0, len(pdf), step)), np.zeros((2, count))).ravel()

    n, total = block_sums(held, lambda pdf: parts(pdf, lambda s: np.stack([np.isfinite(s).sum(0), np.nansum(s, axis=0)])), 2 * count, "sums of scores").reshape(2, count)
    mean = total / np.maximum(n, 1)
    _, square = block_sums(held, lambda pdf: parts(pdf, lambda s: np.stack([np.isfinite(s).sum(0), np.nansum((s - mean) ** 2, axis=0)])), 2 * count, "squares of scores").reshape(2, count)
    sd = np.sqrt(square / np.maximum(n, 1))
    sd[sd <= 1e-12 * np.abs(mean)] = np.nan  # constant
    names = np.flatnonzero(n > 0)
    design = _design(full, controls, categories)
    rows = cut(full.join(held, sample).select(F.array(*design).alias("x"), *[c for c in held.columns if c not in (sample, "x", "y")], F.col(y).cast("double").alias("y")))
    return _newton(rows, len(design), names.tolist(), f"`{feature}` int", lambda pdf: ((derive(pdf) - mean) / sd)[:, names])


def _newton(rows: DataFrame, p: int, names: list, named: str, scores: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """The fits of all scores(rows), by name. rows: x (p columns), y, and what the scores are made of."""
    spark, count = rows.sparkSession, len(names)
    b, status, rounds = np.zeros((count, p + 1)), np.full(count, "", object), np.zeros(count, int)
    n, se = np.zeros(count, int), np.full((count, p + 1), np.nan)
    up, low = np.triu_indices(p), 3 + p
    for step in range(1, ROUNDS + 1):
        live = np.flatnonzero(status == "")
        if not len(live):
            break
        shared = spark.sparkContext.broadcast((b, live))
        size = (2 + p + 1 + len(up[0]) + p + 1) * len(live)
        got = block_sums(rows, lambda pdf, own=shared: _sums(pdf, *own.value, scores), size, "sums of logistic fits").reshape(-1, len(live))
        shared.unpersist()
        for j, k in enumerate(live):
            g = got[:, j]
            n[k], ones = int(round(g[0])), g[1]
            h = np.zeros((p + 1, p + 1))
            h[up] = g[low : low + len(up[0])]
            h[:p, p] = g[low + len(up[0]) : -1]
            h = h + np.triu(h, 1).T
            h[p, p] = g[-1]
            if not n[k]:
                status[k] = "constant"
            elif ones in (0, g[0]):
                status[k] = "one class"
            elif not np.isfinite(h).all() or np.linalg.matrix_rank(h) <= p:
                status[k] = "singular" if step == 1 else "separated"
            else:
                move = np.linalg.solve(h, g[2 : 3 + p])
                b[k] += move
                rounds[k] = step
                if np.abs(b[k]).max() > FAR:
                    status[k] = "separated"
                elif np.abs(move).max() < STEP:
                    status[k], se[k] = "ok", np.sqrt(np.diag(np.linalg.inv(h)))
    status[status == ""] = "not converged"
    out = []
    for k, name in enumerate(names):
        if status[k] != "ok":
            out.append((name, int(n[k]), *[None] * 7, status[k], int(rounds[k])))
            continue
        c, s = float(b[k, p]), float(se[k, p])
        half = 1.959963984540054 * s
        out.append((name, int(n[k]), c, s, c / s, float(normal_two_sided(c / s)), math.exp(c), math.exp(c - half), math.exp(c + half), "ok", int(rounds[k])))
    return spark.createDataFrame(out, f"{named}, n long, coef double, se double, z double, p double, odds double, lo double, hi double, status string, rounds int")


# ---------------------------------------------------------------- ridge by folds


def _grams(pdf: pd.DataFrame, folds: int, width: int) -> np.ndarray:
    a = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy()).astype(float).reshape(len(pdf), width), pdf["y"].to_numpy(float)])
    fold, total = pdf["fold"].to_numpy(), np.zeros((folds, width + 2, width + 2))
    for f in np.unique(fold):
        own = a[fold == f]
        total[f] += own.T @ own
    return total.ravel()


class _Fold:
    """A training set by its cross products of (1, x, y): scaled, decomposed once, for every penalty."""

    def __init__(self, g: np.ndarray, pool: np.ndarray, alphas: np.ndarray, scaled: bool) -> None:
        self.n = g[0, 0]
        whole = np.zeros((g.shape[0], pool.shape[1] + 2))
        whole[0, 0] = whole[-1, -1] = 1
        whole[1:-1, 1:-1] = pool
        g = whole.T @ g @ whole
        self.mean, self.base = g[0, 1:-1] / self.n, g[0, -1] / self.n
        c = g[1:-1, 1:-1] - self.n * np.outer(self.mean, self.mean)
        sd = np.sqrt(np.maximum(np.diag(c) / self.n, 0))
        constant = sd <= 1e-7 * np.sqrt(np.maximum(np.diag(g)[1:-1] / self.n, 1e-300))
        self.scale = np.where(constant, 1.0, sd) if scaled else np.ones(len(sd))
        c[constant, :] = c[:, constant] = 0
        xy = np.where(constant, 0, g[1:-1, -1] - self.n * self.mean * self.base) / self.scale
        d, v = np.linalg.eigh(c / np.outer(self.scale, self.scale))
        self.pool, self.turn, self.d = pool, v, np.maximum(d, 0)
        self.shrink = 1 / (self.d[None, :] + np.asarray(alphas, float)[:, None])  # a row a penalty
        self.q = v.T @ xy

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Rows on the turned, scaled columns."""
        return ((x @ self.pool - self.mean) / self.scale) @ self.turn

    def errors(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of squared leave-one-out errors of training rows, by penalty."""
        t = self.scores(x)
        fit, hat = t @ (self.shrink * self.q).T, (t * t) @ self.shrink.T + 1 / self.n
        return (((y[:, None] - self.base - fit) / np.maximum(1 - hat, 1e-12)) ** 2).sum(axis=0)

    def predict(self, x: np.ndarray, penalty: int) -> np.ndarray:
        return self.base + self.scores(x) @ (self.shrink[penalty] * self.q)


def ridge_by_fold(rows: DataFrame, line: str, features: str, y: str, alphas: Sequence[float], fold: str = "fold", scaled: bool = True, categories: Sequence[int] = (), least: int = 5) -> DataFrame:
    """line, fold, truth, pred, alpha, edge, n_train: each fold (0, 1, ...) predicted by ridge on the others,
    with the penalty of the least leave-one-out error there.

    Two passes of sums and one of predictions. Columns named in `categories` are the 0/1 columns of one category
    each: those with fewer than `least` training rows share a column, and levels unseen in training are zeros.
    A fold that is all rows has no training set, and no predictions."""
    full = rows.select(F.col(line).alias("line"), F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("fold")).filter("y IS NOT NULL AND fold IS NOT NULL")
    full = cut(full)
    shape = full.agg(F.max("fold"), F.max(F.size("x"))).first()
    folds, width, penalties = (shape[0] if shape[0] is not None else -1) + 1, shape[1] or 0, np.asarray(alphas, float)
    spark = rows.sparkSession
    out = f"line {full.schema['line'].dataType.simpleString()}, fold int, truth double, pred double, alpha double, edge boolean, n_train long"
    if not folds:
        return spark.createDataFrame([], out)
    own = block_sums(full.select("x", "y", "fold"), lambda pdf: _grams(pdf, folds, width), folds * (width + 2) ** 2, "Gram matrices of folds").reshape(folds, width + 2, width + 2)
    train = own.sum(axis=0) - own
    marks = np.zeros(width, bool)
    marks[list(categories)] = True
    models: list[_Fold | None] = []
    for g in train:
        seen = np.diag(g)[1:-1]  # training rows of each 0/1 column
        rare = marks & (seen < least)
        pool = np.eye(width)[:, ~rare]
        if (marks & (seen > 0) & rare).any():
            pool = np.column_stack([pool, (rare & (seen > 0)).astype(float)])
        models.append(_Fold(g, pool, penalties, scaled) if g[0, 0] > 0.5 else None)
    shared = spark.sparkContext.broadcast(models)
    best = np.zeros(folds, int)
    if len(penalties) > 1:

        def errors(pdf: pd.DataFrame) -> np.ndarray:
            x, t, f = np.stack(pdf["x"].to_numpy()).astype(float).reshape(len(pdf), width), pdf["y"].to_numpy(float), pdf["fold"].to_numpy()
            return np.concatenate([np.zeros(len(penalties)) if m is None else m.errors(x[f != i], t[f != i]) for i, m in enumerate(shared.value)])

        best = block_sums(full.select("x", "y", "fold"), errors, folds * len(penalties), "errors by penalty").reshape(folds, -1).argmin(axis=1)

    def predict(batches):
        for pdf in batches:
            x, f = np.stack(pdf["x"].to_numpy()).astype(float).reshape(len(pdf), width) if len(pdf) else np.zeros((0, width)), pdf["fold"].to_numpy()
            pred, seen = np.full(len(pdf), np.nan), np.zeros(len(pdf), int)
            for i in np.unique(f):
                if (m := shared.value[i]) is not None:
                    pred[f == i], seen[f == i] = m.predict(x[f == i], best[i]), round(m.n)
            yield pd.DataFrame({"line": pdf["line"], "fold": f, "truth": pdf["y"], "pred": pred, "alpha": penalties[best[f]], "edge": np.isin(best[f], (0, len(penalties) - 1)), "n_train": seen})[seen > 0]

    return full.mapInPandas(predict, out)


def covariance_path(a: np.ndarray, c: np.ndarray, alphas: np.ndarray, l1: float, scale: float, tol: float = 1e-9) -> np.ndarray:
    """Coefficients (alphas x features) of the elastic net with Z'Z / n = a and Z'y / n = c of centred data, from the largest
    penalty down, each from the one before. A step costs one column of a, whatever the rows."""
    out, b, g, small = np.zeros((len(alphas), len(c))), np.zeros(len(c)), c.astype(float).copy(), tol * max(scale, 1e-300)
    for k in np.argsort(-np.asarray(alphas), kind="stable"):
        lam, ridge = alphas[k] * l1, alphas[k] * (1 - l1)
        for _ in range(SWEEPS):
            todo, before = np.flatnonzero((np.abs(g) > lam) | (b != 0)), b.copy()
            for _ in range(SWEEPS):
                move = 0.0
                for j in todo:
                    if a[j, j] <= 0:
                        continue
                    old = b[j]
                    s = g[j] + a[j, j] * old
                    new = math.copysign(max(abs(s) - lam, 0.0), s) / (a[j, j] + ridge)
                    if new != old:
                        g -= a[:, j] * (new - old)
                        b[j] = new
                        move = max(move, abs(new - old))
                if move <= small:
                    break
            if np.abs(b - before).max(initial=0.0) <= small:
                break
        out[k] = b
    return out


def _moments(g: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    """n, means of x, mean of y, centred x'x / n and x'y / n of cross products of (1, x, y)."""
    n = max(g[0, 0], 1.0)
    m, base = g[0, 1:-1] / n, g[0, -1] / n
    return g[0, 0], m, base, g[1:-1, 1:-1] / n - np.outer(m, m), g[1:-1, -1] / n - m * base


def _squares(v: np.ndarray, b: np.ndarray, base: float) -> float:
    """Sum of (y - base - xb)^2 over the rows behind v."""
    w = np.concatenate([[-base], -b, [1.0]])
    return float(max(w @ v @ w, 0.0))


def _net(cells: np.ndarray, alphas: np.ndarray, l1: float) -> tuple[int, np.ndarray, float, int]:
    """(penalty, raw coefficients, intercept, rows) for one training set, by inner fold: cells are their cross products."""
    whole = cells.sum(axis=0)
    n, m, base, a, c = _moments(whole)
    sd = np.sqrt(np.maximum(np.diag(a), 0))
    sd = np.where(sd > 1e-7 * np.sqrt(np.maximum(np.diag(whole)[1:-1] / max(n, 1), 1e-300)), sd, 0.0)
    scale = np.where(sd > 0, sd, 1.0)
    spread = math.sqrt(max(whole[-1, -1] / max(n, 1) - base * base, 0.0))
    live = np.outer(sd > 0, sd > 0) / np.outer(scale, scale)
    loss = np.zeros(len(alphas))
    for v in cells if len(alphas) > 1 else ():
        k, own, b0, ai, ci = _moments(whole - v)
        if k < 1 or v[0, 0] < 1:
            continue
        for i, b in enumerate(covariance_path(ai * live, np.where(sd > 0, ci / scale, 0), alphas, l1, spread)):
            raw = b / scale
            loss[i] += _squares(v, raw, b0 - own @ raw) / v[0, 0]
    best = int(loss.argmin())
    raw = covariance_path(a * live, np.where(sd > 0, c / scale, 0), alphas[best : best + 1], l1, spread)[0] / scale
    return best, raw, base - m @ raw, int(round(n))


def elastic_net_by_fold(rows: DataFrame, line: str, features: str, y: str, alphas: Sequence[float], l1: float = 0.5, fold: str = "fold", inner: str = "inner") -> DataFrame:
    """line, fold, truth, pred, alpha, edge, n_train: each fold predicted by an elastic net on the others, on scaled
    columns, with the penalty of the least mean error over inner folds (0, 1, ...: a column of rows, unused for one penalty).

    One pass of sums and one of predictions; folds are fitted in tasks of their own, from the sums. The sums are (folds x
    inner folds) matrices of features x features, counted before they come (TooLarge): this is for narrow tables, and
    a wide one is screened first (modelling.cross_validate_long)."""
    full = rows.select(F.col(line).alias("line"), F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), F.coalesce(F.col(inner).cast("int"), F.lit(0)).alias("inner"))
    full = cut(full.filter("y IS NOT NULL AND fold IS NOT NULL"))
    shape = full.agg(F.max("fold"), F.max(F.size("x")), F.max("inner")).first()
    folds, width, inners, penalties = (shape[0] if shape[0] is not None else -1) + 1, shape[1] or 0, (shape[2] or 0) + 1, np.asarray(alphas, float)
    spark = rows.sparkSession
    out = f"line {full.schema['line'].dataType.simpleString()}, fold int, truth double, pred double, alpha double, edge boolean, n_train long"
    if not folds:
        return spark.createDataFrame([], out)
    if folds * inners * (width + 2) ** 2 > CELLS:
        raise TooLarge(f"Gram matrices of {width} features in {folds} x {inners} cells")
    own = block_sums(full.select("x", "y", (F.col("fold") * inners + F.col("inner")).alias("fold")), lambda pdf: _grams(pdf, folds * inners, width), folds * inners * (width + 2) ** 2, "Gram matrices of cells")
    shared = spark.sparkContext.broadcast(own.reshape(folds, inners, width + 2, width + 2))

    def fit(batches):
        for pdf in batches:
            found = []
            for f in pdf["id"]:
                train = shared.value.sum(axis=0) - shared.value[f]
                if train[:, 0, 0].sum() > 0.5:
                    best, b, base, n = _net(train, penalties, l1)
                    found.append((int(f), best, b.tolist(), base, n))
            yield pd.DataFrame(found, columns=["id", "best", "b", "base", "n"])

    fits = to_local(spark.range(0, folds, 1, folds).mapInPandas(fit, "id long, best int, b array<double>, base double, n long"), "models by fold", width)
    models = {int(r.id): (int(r.best), np.asarray(r.b, float), float(r.base), int(r.n)) for r in fits.itertuples()}
    given = spark.sparkContext.broadcast(models)

    def predict(batches):
        for pdf in batches:
            pdf = pdf[pdf["fold"].isin(list(given.value))]
            own = [given.value[f] for f in pdf["fold"]]
            pred = [base + float(np.asarray(x, float) @ b) for x, (_, b, base, _) in zip(pdf["x"], own, strict=True)]
            yield pd.DataFrame({"line": pdf["line"], "fold": pdf["fold"], "truth": pdf["y"], "pred": np.array(pred, float), "alpha": [penalties[m[0]] for m in own], "edge": [m[0] in (0, len(penalties) - 1) for m in own], "n_train": [m[3] for m in own]})

    return full.mapInPandas(predict, out)


def cross_validate_sums(matrix: DataFrame, line: str, features: str, y: str, model: str = "ridge", group: str | None = None, folds: int = 5, repeats: int = 5, seed: int = 0, by_group: bool = False) -> DataFrame:
    """Out-of-fold predictions on the folds of modelling.cross_validate (line, repeat, fold, truth, pred, alpha, edge,
    n_train) by "ridge", "tuned" or "fixed" elastic nets, of a narrow table of any number of lines.

    Inner folds of "tuned" follow a seeded order of all lines. by_group: each group is a fold, once."""
    from . import modelling
    from ..functions.ranks import numbered

    rows = matrix.filter(F.col(y).isNotNull()).select(F.col(line).cast("string").alias("line"), F.col(features).alias("_x"), F.col(y).alias("_y"), *([F.col(group).alias("_g")] if group else []))
    rows = cut(numbered(rows, ["line"]).drop("_n").withColumnRenamed("_i", "row_ix"))
    if by_group:
        names = rows.select("_g").filter("_g IS NOT NULL").distinct().withColumn("fold", F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("_g")) - 1).withColumn("repeat", F.lit(0))  # a row a group
        plans = [rows.join(sized_broadcast(names, 48), "_g")]
    else:
        table = modelling.fold_table(matrix.sparkSession, rows.count(), folds, repeats, seed)
        plans = [rows.join(table.filter(F.col("repeat") == r), "row_ix") for r in range(repeats)]
    inner = numbered(rows.select("row_ix", F.md5(F.concat_ws(":", F.lit(f"inner{seed}"), "line").cast("binary")).alias("_h")), ["_h"]).select("row_ix", (F.col("_i") % modelling.INNER).cast("int").alias("inner")) if model == "tuned" else None
    out = None
    for r, plan in enumerate(plans):
        if model == "ridge":
            got = ridge_by_fold(plan, "line", "_x", "_y", modelling.RIDGE_ALPHAS)
        else:
            width = rows.agg(F.max(F.size("_x"))).first()[0] or 0
            grid = [modelling.ALPHA] if model == "fixed" else modelling.ALPHAS_WIDE if width > 50 else modelling.ALPHAS_NARROW
            own = plan.withColumn("inner", F.lit(0)) if inner is None else plan.join(inner, "row_ix")
            got = elastic_net_by_fold(own, "line", "_x", "_y", grid, modelling.L1_RATIO)
        got = got.select("line", F.lit(r).alias("repeat"), "fold", "truth", "pred", "alpha", "edge", F.col("n_train").cast("int").alias("n_train"))
        out = got if out is None else out.unionByName(got)
    return out


def baselines(table: DataFrame, line: str, y: str, numeric: Sequence[str], category: str, alphas: Sequence[float], folds: int = 5, seed: int = 0, least: int = 5) -> DataFrame:
    """baseline, pearson_r, r2, rmse, n of ridge on each number, on the category, on both, and of both on
    permuted labels (the leakage tripwire: rows are matched with the labels of others by two seeded orders).

    Folds are dealt by a seeded order of the lines."""
    from ..functions.ranks import numbered
    from .relational import regression_metrics

    rows = table.dropna(subset=[y, *numeric]).select(F.col(line).alias("_line"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(category).cast("string"), F.lit("UNKNOWN")).alias("_c"), *[F.col(c).cast("double") for c in numeric])
    draw = lambda tag: F.md5(F.concat_ws(":", F.lit(f"{tag}{seed}"), F.col("_line")).cast("binary"))
    placed = cut(numbered(rows.withColumn("_h", draw("fold")), ["_h"]).drop("_h", "_n").withColumn("fold", (F.col("_i") % folds).cast("int")))
    labels = numbered(placed.select("y", draw("label").alias("_h")), ["_h"]).select("_i", F.col("y").alias("_other"))
    names = levels_of(placed, "_c")
    dummies = [(F.col("_c") == F.lit(v)).cast("double") for v in names]
    both = placed.join(labels, "_i")
    numbers, out = list(numeric), None
    designs = [*[(c, [F.col(c)], [], "y") for c in numbers], (category, dummies, range(len(names)), "y")]
    for name, truth in ((f"{category} + numbers", "y"), ("permuted labels", "_other")):
        designs.append((name, [*[F.col(c) for c in numbers], *dummies], range(len(numbers), len(numbers) + len(names)), truth))
    for name, columns, marks, truth in designs:
        found = ridge_by_fold(both.withColumn("_x", F.array(*columns)), "_line", "_x", truth, alphas, categories=list(marks), least=least)
        row = regression_metrics(found, "truth", "pred").select(F.lit(name).alias("baseline"), F.col("r").alias("pearson_r"), "r2", "rmse", "n")
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- least squares with an interaction


def interaction(table: DataFrame, y: str, score: str, flag: str, category: str | None = None) -> DataFrame:
    """n, estimate, se, lo, hi, p of the score x flag term of y ~ score * flag (+ category), by least squares.

    One pass: sums of products by level of the category (null: its own), centred within levels, so
    that levels need no columns. NULL where the terms are collinear or no degree of freedom is left."""
    rows = table.select(F.coalesce(F.col(category).cast("string"), F.lit("UNKNOWN")).alias("_c") if category else F.lit("").alias("_c"), *[F.col(c).cast("double").alias(n) for c, n in ((score, "s"), (flag, "f"), (y, "y"))]).dropna(subset=["s", "f", "y"])
    base = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in "sfy"]).first()  # near the origin, squares keep their digits
    s, f, t = (F.col(c) - F.lit(float(m)) for c, m in zip("sfy", base, strict=True))
    v = [s, f, s * f, t]
    terms = [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"m{i}") for i, x in enumerate(v)], *[F.sum(v[i] * v[j]).alias(f"g{i}{j}") for i in range(4) for j in range(i, 4)]]
    levels = rows.groupBy("_c").agg(*terms)
    within = [F.sum(F.col(f"g{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") / F.col("n")) for i in range(4) for j in range(i, 4)]
    got = iter(levels.agg(F.count(F.lit(1)), F.sum("n"), *within).first())
    k, n = next(got), next(got) or 0
    g = np.zeros((4, 4))
    for i in range(4):
        for j in range(i, 4):
            g[i, j] = g[j, i] = next(got) or 0.0
    spark, schema = table.sparkSession, "n long, estimate double, se double, lo double, hi double, p double"
    size = np.sqrt(np.maximum(np.diag(g)[:3], 0))
    dof = n - k - 3
    if not (size > 0).all() or dof <= 0 or np.linalg.matrix_rank(g[:3, :3] / np.outer(size, size), tol=1e-10) < 3:
        return spark.createDataFrame([(int(n), None, None, None, None, None)], schema)
    inverse = np.linalg.inv(g[:3, :3] / np.outer(size, size)) / np.outer(size, size)
    b = inverse @ g[:3, 3]
    # a product of shifted terms has the same coefficient as the product itself
    se = math.sqrt(max(g[3, 3] - b @ g[:3, 3], 0.0) / dof * inverse[2, 2])
    e = float(b[2])
    return spark.createDataFrame([(int(n), e, se, e - 1.96 * se, e + 1.96 * se, float(t_two_sided(e / se, dof)) if se > 0 else None)], schema)
