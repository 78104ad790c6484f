"""Fold-safe, repeated cross-validation of penalised regression.

The feature screen runs in Spark over the long table, so that no task sees more than the
chosen features; each (repeat, fold) is then one task of a grouped map, with numpy solvers.
Nothing a fold learns (group means, screens, scales, penalties) has seen its test rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.local import cut, sized_broadcast, to_local
from ..functions.nulls import safe_corr
from .resampling import bootstrap_lines, row_r

#: The workload's constants.
TOP_FEATURES, ALPHA, L1_RATIO, MAX_ITER = 1500, 0.02, 0.5, 3000
FOLDS, REPEATS, INNER = 5, 5, 3
ALPHAS_WIDE = np.geomspace(0.5, 0.002, 13)
ALPHAS_NARROW = np.geomspace(0.5, 1e-5, 22)
RIDGE_ALPHAS = np.geomspace(0.01, 1000, 26)


def kfold(n: int, folds: int, seed: int) -> np.ndarray:
    """Fold of each row: rows shuffled by the legacy generator, the first n % folds folds one larger."""
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    out = np.empty(n, int)
    size = np.full(folds, n // folds)
    size[: n % folds] += 1
    out[order] = np.repeat(np.arange(folds), size)
    return out


def fold_table(spark, n: int, folds: int = FOLDS, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """repeat, row_ix, fold: one row per line and repeat."""
    rows = [(r, i, int(f)) for r in range(repeats) for i, f in enumerate(kfold(n, folds, seed + r))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["repeat", "row_ix", "fold"]))


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, mean, scale) by population SD; a constant column has scale 1."""
    m, s = x.mean(axis=0), x.std(axis=0)
    s = np.where(s > 0, s, 1.0)
    return (x - m) / s, m, s


def elastic_net_path(x: np.ndarray, y: np.ndarray, alphas: np.ndarray, l1: float = L1_RATIO, max_iter: int = MAX_ITER, tol: float = 1e-4) -> np.ndarray:
    """Coefficients (alphas x features) of 1/(2n)|y - xb|^2 + a l1 |b|_1 + a (1 - l1)/2 |b|^2 for
    centred x and y, from the largest alpha down, each from the one before.

    Coordinate descent on the active set, then over all features until none moves."""
    n, p = x.shape
    xf = np.asfortranarray(x)
    norm = (xf * xf).sum(axis=0) / n
    out, b, r = np.zeros((len(alphas), p)), np.zeros(p), y.astype(float).copy()
    scale = max(float(np.abs(y).max(initial=0.0)), 1e-12)
    for k in np.argsort(-np.asarray(alphas), kind="stable"):
        lam, ridge = alphas[k] * l1, alphas[k] * (1 - l1)
        for _ in range(max_iter):
            grad = xf.T @ r / n
            todo = np.flatnonzero((np.abs(grad) > lam) | (b != 0))
            before = b.copy()
            for _ in range(max_iter):
                move = 0.0
                for j in todo:
                    if norm[j] == 0:
                        continue
                    old = b[j]
                    g = xf[:, j] @ r / n + norm[j] * old
                    new = math.copysign(max(abs(g) - lam, 0.0), g) / (norm[j] + ridge)
                    if new != old:
                        r += xf[:, j] * (old - new)
                        b[j] = new
                        move = max(move, abs(new - old))
                if move <= tol * scale * 1e-2:
                    break
            if np.abs(b - before).max(initial=0.0) <= tol * scale * 1e-2:
                break
        out[k] = b
    return out


@dataclass
class ElasticNet:
    """Fixed penalty."""

    alpha: float = ALPHA
    l1: float = L1_RATIO
    coef: np.ndarray = field(default_factory=lambda: np.empty(0))
    chosen: float = math.nan
    edge: bool = False

    def fit(self, x: np.ndarray, y: np.ndarray) -> ElasticNet:
        z, self.mean, self.scale = standardise(x)
        self.base = y.mean()
        self.coef = elastic_net_path(z, y - self.base, np.array([self.alpha]), self.l1)[0]
        self.chosen = self.alpha
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + ((x - self.mean) / self.scale) @ self.coef


@dataclass
class TunedElasticNet(ElasticNet):
    """Penalty by inner cross-validation on the rows it is given; the grid depends on the width."""

    inner: int = INNER
    seed: int = 0

    def fit(self, x: np.ndarray, y: np.ndarray) -> TunedElasticNet:
        grid = ALPHAS_WIDE if x.shape[1] > 50 else ALPHAS_NARROW
        fold, loss = kfold(len(x), self.inner, self.seed), np.zeros((self.inner, len(grid)))
        z, _, _ = standardise(x)
        for f in range(self.inner):
            a, t = z[fold != f], fold == f
            m, c = a.mean(axis=0), y[~t].mean()
            coef = elastic_net_path(a - m, y[~t] - c, grid, self.l1)
            loss[f] = ((y[t][:, None] - c - (z[t] - m) @ coef.T) ** 2).mean(axis=0)
        best = int(loss.mean(axis=0).argmin())
        self.alpha = float(grid[best])
        super().fit(x, y)
        self.edge = best in (0, len(grid) - 1)
        return self


@dataclass
class Ridge:
    """Ridge with the penalty of the least leave-one-out error (from one SVD), on scaled columns."""

    alphas: np.ndarray = field(default_factory=lambda: RIDGE_ALPHAS)
    scaled: bool = True

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ridge:
        z, self.mean, self.scale = standardise(x) if self.scaled else (x - x.mean(axis=0), x.mean(axis=0), np.ones(x.shape[1]))
        self.base = y.mean()
        c = y - self.base
        u, s, vt = np.linalg.svd(z, full_matrices=False)
        best = (math.inf, 0)
        for i, a in enumerate(self.alphas):
            d = s * s / (s * s + a)
            hat = (u * u * d).sum(axis=1) + 1 / len(y)
            err = (((c - u @ (d * (u.T @ c))) / np.maximum(1 - hat, 1e-12)) ** 2).mean()
            best = min(best, (err, i))
        self.chosen, self.edge = float(self.alphas[best[1]]), best[1] in (0, len(self.alphas) - 1)
        self.coef = vt.T @ (s / (s * s + self.chosen) * (u.T @ c))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + ((x - self.mean) / self.scale) @ self.coef


class Screened:
    """Keeps the k features most correlated with y on the training rows, then fits a model."""

    def __init__(self, inner, k: int = TOP_FEATURES) -> None:
        self.inner, self.k = inner, k

    def fit(self, x: np.ndarray, y: np.ndarray) -> Screened:
        r = np.nan_to_num(np.abs(row_r(x.T, np.broadcast_to(y, (x.shape[1], len(y))))))
        self.keep = np.sort(np.argsort(-r, kind="stable")[: self.k])
        self.inner.fit(x[:, self.keep], y)
        self.chosen, self.edge = self.inner.chosen, self.inner.edge
        self.coef = np.zeros(x.shape[1])
        self.coef[self.keep] = self.inner.coef
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.inner.predict(x[:, self.keep])


class ScaledTarget:
    """Fits y standardised on the training rows times sd, and predicts on the old scale."""

    def __init__(self, inner, sd: float = 1.0) -> None:
        self.inner, self.sd = inner, sd

    def fit(self, x: np.ndarray, y: np.ndarray) -> ScaledTarget:
        self.m, s = y.mean(), y.std()
        self.k = (s if s > 0 else 1.0) / self.sd
        self.inner.fit(x, (y - self.m) / self.k)
        self.chosen, self.edge, self.coef = self.inner.chosen, self.inner.edge, self.inner.coef
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.inner.predict(x) * self.k + self.m


def transcriptome_model() -> Screened:
    return Screened(TunedElasticNet())


def fixed_model() -> Screened:
    return Screened(ElasticNet())


# ---------------------------------------------------------------- the feature screen


def screen_by_fold(long: DataFrame, target: DataFrame, folds: DataFrame, sample: str, feature: str, value: str, y: str, k: int = TOP_FEATURES, group: str | None = None) -> DataFrame:
    """repeat, fold, feature: the k features most correlated with y on the training rows of each fold.

    One pass: sums over each fold's rows are aggregated by (feature, repeat, fold); training sums
    are the other folds'. With a group column of target, values are centred and y is standardised
    by the training rows of each group, as `deconfounded` does: the sums are kept by group."""
    keys = [F.col(group).alias("_g")] if group else [F.lit(0).alias("_g")]
    t = target.filter(F.col(y).isNotNull()).select("row_ix", sample, F.col(y).cast("double").alias("_y"), *keys).filter("_g IS NOT NULL")
    f = folds.join(t, "row_ix").select("repeat", "fold", sample, "_y", "_g")
    rows = long.filter(F.col(value).isNotNull()).join(sized_broadcast(f, 64), sample)
    x, t = F.col(value).cast("double"), F.col("_y")
    parts = {"n": F.lit(1.0), "sx": x, "sy": t, "sxx": x * x, "syy": t * t, "sxy": x * t}
    own = rows.groupBy("repeat", "fold", "_g", feature).agg(*[F.sum(v).alias(c) for c, v in parts.items()])
    # a group without a row in a fold is in that fold's training rows as a whole
    every = F.collect_set("fold").over(W.partitionBy("repeat"))
    whole = own.groupBy("repeat", "_g", feature).agg(*[F.sum(c).alias(f"all_{c}") for c in parts])
    plan = folds.select("repeat", "fold").distinct().withColumn("folds", every).select("repeat", "folds").distinct()
    whole = whole.join(F.broadcast(plan), "repeat").withColumn("fold", F.explode("folds")).drop("folds")  # a row a repeat
    g = whole.join(own, ["repeat", "fold", "_g", feature], "left").select("repeat", "fold", feature, "_g", *[(F.col(f"all_{c}") - F.coalesce(c, F.lit(0.0))).alias(c) for c in parts]).filter("n > 0")
    n = F.col("n")
    g = g.select("repeat", "fold", feature, "n", (F.col("sxx") - F.col("sx") * F.col("sx") / n).alias("cxx"), (F.col("syy") - F.col("sy") * F.col("sy") / n).alias("cyy"), (F.col("sxy") - F.col("sx") * F.col("sy") / n).alias("cxy"))
    if group:
        sd = F.sqrt(F.try_divide(F.col("cyy"), F.nullif(n - 1, F.lit(0.0))))
        g = g.filter("n > 1 AND cyy > 0").select("repeat", "fold", feature, "cxx", (F.col("cxy") / sd).alias("cxy"), (n - 1).alias("cyy"))
        g = g.groupBy("repeat", "fold", feature).agg(*[F.sum(c).alias(c) for c in ("cxx", "cxy", "cyy")])
    r = F.abs(F.try_divide(F.col("cxy"), F.nullif(F.sqrt(F.greatest("cxx", F.lit(0.0)) * F.greatest("cyy", F.lit(0.0))), F.lit(0.0))))
    rank = F.row_number().over(W.partitionBy("repeat", "fold").orderBy(F.desc_nulls_last("r"), feature))
    return g.withColumn("r", r).withColumn("_rn", rank).filter(F.col("_rn") <= k).select("repeat", "fold", feature)


# ---------------------------------------------------------------- cross-validation

OOF = "line string, repeat int, fold int, truth double, pred double, alpha double, edge boolean, n_train int"


def deconfounded(x: np.ndarray, y: np.ndarray, group: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x centred and y standardised (sample SD) by the training rows' group statistics, and the
    rows that have them; x and y of the test rows use the training statistics too."""
    xs, ys, ok = x.astype(float).copy(), np.full(len(y), np.nan), np.zeros(len(y), bool)
    for g in pd.unique(group):
        if g is None or g != g:
            continue
        own, fit = group == g, (group == g) & train
        if fit.sum():
            xs[own] -= x[fit].mean(axis=0)
            sd = y[fit].std(ddof=1) if fit.sum() > 1 else np.nan
            ys[own] = (y[own] - y[fit].mean()) / sd if sd and sd > 0 else np.nan
            ok |= own
    return xs, ys, ok


def _fold_plan(n: int, group: np.ndarray, folds: int, repeats: int, seed: int, by_group: bool) -> np.ndarray:
    """repeats x rows: the fold of each row; -1 for rows without a group where groups are folds."""
    if not by_group:
        return np.array([kfold(n, folds, seed + r) for r in range(repeats)])
    names = sorted({v for v in group if v is not None})
    return np.array([[names.index(v) if v is not None else -1 for v in group]])


def _one_fold(x: np.ndarray, y: np.ndarray, names: np.ndarray, group: np.ndarray, folds: np.ndarray, r: int, f: int, factory: Callable, deconfound: bool) -> pd.DataFrame:
    """The out-of-fold rows (OOF) of one fold."""
    train, test = folds != f, folds == f
    if deconfound:
        x, y, ok = deconfounded(x, y, group, train)
        if (test & ok).sum() < 5:
            return pd.DataFrame(columns=[c.split()[0] for c in OOF.split(", ")])
        train, test = train & ok & np.isfinite(y), test & ok & np.isfinite(y)
    m = factory().fit(x[train], y[train])
    n = int(test.sum())
    return pd.DataFrame({"line": names[test], "repeat": r, "fold": f, "truth": y[test], "pred": m.predict(x[test]), "alpha": [m.chosen] * n, "edge": [bool(m.edge)] * n, "n_train": int(train.sum())})


def cross_validate(matrix: DataFrame, line: str, features: str, y: str, factory: Callable, group: str | None = None, deconfound: bool = False, folds: int = FOLDS, repeats: int = REPEATS, seed: int = 0, by_group: bool = False) -> DataFrame:
    """Out-of-fold predictions (OOF), one task per (repeat, fold), of a narrow table: scores, modules.

    matrix: one row a line with a feature array. It is broadcast once, so lines x features are
    counted first (TooLarge beyond functions.local.CELLS); a transcriptome goes through
    cross_validate_long. by_group: each group is a fold, once."""
    if deconfound and group is None:
        raise ValueError("deconfounding needs a group column")
    cols = [line, features, y, *([group] if group else [])]
    rows = matrix.select(*cols).filter(F.col(y).isNotNull())
    width = rows.agg(F.max(F.size(features))).first()[0] or 1
    pdf = to_local(rows, "the lines of a model", width).sort_values(line, kind="stable")
    x = np.stack(pdf[features].to_numpy()).astype(float) if len(pdf) else np.empty((0, 0))
    t, ids = pdf[y].to_numpy(float), pdf[line].astype(str).to_numpy()
    g = pdf[group].to_numpy(object) if group else np.full(len(pdf), "all", object)
    plan = _fold_plan(len(pdf), g, folds, repeats, seed, by_group)
    spark = matrix.sparkSession
    shared = spark.sparkContext.broadcast((x, t, ids, g, plan))
    jobs = [(r, int(f)) for r in range(len(plan)) for f in sorted(set(plan[r].tolist()) - {-1})]

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        xs, ys, names, groups, folds_ = shared.value
        r, f = map(int, key)
        return _one_fold(xs, ys, names, groups, folds_[r], r, f, factory, deconfound)

    tasks = spark.createDataFrame(pd.DataFrame(jobs, columns=["repeat", "fold"])).repartition(max(1, len(jobs)), "repeat", "fold")
    return tasks.groupBy("repeat", "fold").applyInPandas(run, OOF)


#: Numbers in the sums of all folds at most.
SUMS = 4_000_000


def _fixed_by_sums(long: DataFrame, index: DataFrame, names: DataFrame, y: np.ndarray, group: np.ndarray, plan: np.ndarray, sample: str, feature: str, value: str, model: ElasticNet, deconfound: bool) -> DataFrame:
    """OOF of an ElasticNet on all features (names), without a block of lines: a line is a row, and two passes add up
    each fold's group means and the products of its training rows about them. Folds are fitted in tasks of their own.

    y, group (one for all lines if not deconfounded) and plan go by row_ix (index)."""
    from ..functions.ranks import numbered
    from ..functions.sums import block_sums
    from .regression import covariance_path

    spark, n = long.sparkSession, len(y)
    places = cut(numbered(names, [feature]).select(F.col(feature).alias("_f"), F.col("_i").cast("int").alias("_p")))
    width = places.count()
    cells = long.select(sample, feature, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    cells = cells.join(sized_broadcast(index, 48), sample).join(sized_broadcast(places, 48), F.col(feature) == F.col("_f"))
    cells = cells.groupBy("row_ix", F.col(sample).cast("string").alias("line")).agg(F.collect_list(F.struct("_p", "v")).alias("c"))

    def dense(batches):
        for pdf in batches:
            at = np.repeat(np.arange(len(pdf)) * width, [len(p) for p in pdf["p"]]) + np.concatenate([*pdf["p"], np.empty(0, np.int64)]).astype(np.int64)
            has = np.bincount(at, minlength=len(pdf) * width)
            if (has == 0).any():
                raise ValueError("a line lacks a feature; fill the table first")
            x = np.bincount(at, np.concatenate([*pdf["v"], np.empty(0)]), len(pdf) * width) / has
            yield pd.DataFrame({"row_ix": pdf["row_ix"], "line": pdf["line"], "x": list(x.reshape(len(pdf), width))})

    rows = cut(cells.select("row_ix", "line", F.col("c._p").alias("p"), F.col("c.v").alias("v")).mapInPandas(dense, "row_ix int, line string, x array<double>"))
    if rows.count() < n:
        raise ValueError("a line lacks a feature; fill the table first")
    levels = {v: i for i, v in enumerate(sorted({v for v in group.tolist() if v is not None and v == v}, key=str))}
    of, groups = np.array([levels.get(v, -1) for v in group.tolist()], int), max(len(levels), 1)
    jobs = [(r, int(f)) for r in range(len(plan)) for f in sorted(set(plan[r].tolist()) - {-1})]
    # of each job: lines, mean and scale of y by group, and whether the group is in its fit
    count, centre, scale = (np.zeros((len(jobs), groups)) for _ in range(3))
    base, far, tested = np.zeros(len(jobs)), np.zeros(len(jobs)), np.zeros(len(jobs), int)
    for j, (r, f) in enumerate(jobs):
        fit = (plan[r] != f) & (of >= 0)
        count[j] = np.bincount(of[fit], minlength=groups)
        with np.errstate(all="ignore"):
            mean = np.bincount(of[fit], y[fit], groups) / count[j]
            sd = np.sqrt(np.bincount(of[fit], (y[fit] - mean[of[fit]]) ** 2, groups) / (count[j] - 1))
        centre[j], scale[j] = (mean, np.where((count[j] > 1) & (sd > 0), sd, np.nan)) if deconfound else (0.0, 1.0)
        z = (y[fit] - centre[j, of[fit]]) / scale[j, of[fit]]
        z = z[np.isfinite(z)]
        base[j] = z.mean() if len(z) else np.nan
        far[j] = np.abs(z - base[j]).max(initial=0.0)
        tested[j] = ((plan[r] == f) & (of >= 0) & (count[j, of] > 0)).sum()
    at = {job: j for j, job in enumerate(jobs)}
    shared = spark.sparkContext.broadcast((of, plan, y))
    folds = int(plan.max(initial=0)) + 2  # lines of no fold come first

    def block(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return pdf["row_ix"].to_numpy(), np.stack(pdf["x"].to_numpy()).astype(float).reshape(len(pdf), width)

    def sums(pdf: pd.DataFrame) -> np.ndarray:
        (ix, x), (of_, plan_, _) = block(pdf), shared.value
        total = np.zeros((len(plan_), folds * groups, width))
        for r in range(len(plan_)):
            cell = np.where(of_[ix] >= 0, (plan_[r, ix] + 1) * groups + of_[ix], -1)
            order = np.argsort(cell, kind="stable")
            order = order[np.searchsorted(cell[order], 0) :]
            if len(order):
                found, first = np.unique(cell[order], return_index=True)
                total[r, found] += np.add.reduceat(x[order], first, axis=0)
        return total.ravel()

    own = block_sums(rows, sums, len(plan) * folds * groups * width, "means of folds").reshape(len(plan), folds, groups, width)
    with np.errstate(all="ignore"):
        means = np.stack([(own[r].sum(axis=0) - own[r, f + 1]) / count[j][:, None] for j, (r, f) in enumerate(jobs)])
    fits_ = np.isfinite(scale) & (count > 0)
    known = spark.sparkContext.broadcast((means, centre, scale, base, fits_))

    def products(pdf: pd.DataFrame) -> np.ndarray:
        (ix, x), (of_, plan_, y_), (means_, centre_, scale_, base_, used) = block(pdf), shared.value, known.value
        total = np.zeros((len(jobs), width, width + 1))
        for j, (r, f) in enumerate(jobs):
            i = np.flatnonzero((plan_[r, ix] != f) & (of_[ix] >= 0) & used[j, of_[ix]])
            q = of_[ix[i]]
            z = x[i] - means_[j, q]
            total[j] += z.T @ np.column_stack([z, (y_[ix[i]] - centre_[j, q]) / scale_[j, q] - base_[j]])
        return total.ravel()

    gram = spark.sparkContext.broadcast(block_sums(rows, products, len(jobs) * width * (width + 1), "products of folds").reshape(len(jobs), width, width + 1))
    trained = (count * fits_).sum(axis=1)

    def fit_(batches):
        for pdf in batches:
            out = []
            for j in pdf["id"]:
                a = gram.value[j] / max(trained[j], 1)
                sd = np.sqrt(np.maximum(np.diag(a), 0))
                sd = np.where(sd > 0, sd, 1.0)
                out.append((covariance_path(a[:, :width] / np.outer(sd, sd), a[:, width] / sd, np.array([model.alpha]), model.l1, max(far[j], 1e-12), 1e-6)[0] / sd).tolist())
            yield pd.DataFrame({"id": pdf["id"], "b": out})

    fitted = to_local(spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(fit_, "id long, b array<double>"), "models by fold", width) if jobs else pd.DataFrame({"id": [], "b": []})
    coefs = np.zeros((len(jobs), width))
    for j, b in zip(fitted["id"], fitted["b"], strict=True):
        coefs[int(j)] = b
    given = spark.sparkContext.broadcast(coefs)

    def predict(batches):
        of_, plan_, y_ = shared.value
        means_, centre_, scale_, base_, used = known.value
        for pdf in batches:
            ix, x = block(pdf)
            for j, (r, f) in enumerate(jobs):
                i = np.flatnonzero((plan_[r, ix] == f) & (of_[ix] >= 0))
                i = i[used[j, of_[ix[i]]]]
                if len(i) and (not deconfound or tested[j] >= 5):
                    q = of_[ix[i]]
                    yield pd.DataFrame({"line": pdf["line"].to_numpy()[i], "repeat": r, "fold": f, "truth": (y_[ix[i]] - centre_[j, q]) / scale_[j, q], "pred": base_[j] + (x[i] - means_[j, q]) @ given.value[j], "alpha": model.alpha, "edge": False, "n_train": int(trained[j])})

    return rows.mapInPandas(predict, OOF)


def cross_validate_long(long: DataFrame, target: DataFrame, sample: str, feature: str, value: str, y: str, factory: Callable, group: str | None = None, deconfound: bool = False, folds: int = FOLDS, repeats: int = REPEATS, seed: int = 0, by_group: bool = False, k: int = TOP_FEATURES) -> DataFrame:
    """Out-of-fold predictions (OOF) from a long table of any number of features.

    The screen runs in Spark (screen_by_fold, on the de-confounded values if asked); each (repeat,
    fold) is then a task that gets its own k features of the lines, and fits factory() to them. An ElasticNet of fixed
    penalty on k features or fewer needs no screen and no block of lines: all folds are fitted from sums (_fixed_by_sums),
    for any number of lines the driver's count admits. Values must be complete (median_fill): a line without one of the features raises ValueError."""
    if deconfound and group is None:
        raise ValueError("deconfounding needs a group column")
    lines = target.filter(F.col(y).isNotNull()).join(long.select(sample).distinct(), sample, "left_semi").select(sample, y, *([group] if group else []))
    pdf = to_local(lines, "the lines of a model").sort_values(sample, kind="stable")
    t, ids = pdf[y].to_numpy(float), pdf[sample].to_numpy()
    g = pdf[group].to_numpy(object) if group else np.full(len(pdf), "all", object)
    plan = _fold_plan(len(pdf), g, folds, repeats, seed, by_group)
    spark = long.sparkSession
    kind = long.schema[sample].dataType.simpleString()
    index = spark.createDataFrame(pa.table({"row_ix": np.arange(len(ids)), sample: pa.Array.from_pandas(ids)})).select(F.col("row_ix").cast("int").alias("row_ix"), F.col(sample).cast(kind)) if len(ids) else spark.createDataFrame([], f"row_ix int, {sample} {kind}")
    model = factory()
    if type(model) is ElasticNet:
        names = cut(long.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).join(sized_broadcast(index, 48), sample, "left_semi").select(feature).distinct())
        width, jobs = names.count(), sum(len(set(p.tolist()) - {-1}) for p in plan)
        if width <= k and jobs * (width + 1) ** 2 <= SUMS and jobs * (width + 1) * (len(set(g.tolist())) if deconfound else 1) <= SUMS:
            return _fixed_by_sums(long, index, names, t, g if deconfound else np.full(len(t), "all", object), plan, sample, feature, value, model, deconfound)
    table = spark.createDataFrame([(r, i, int(f)) for r in range(len(plan)) for i, f in enumerate(plan[r]) if f >= 0], "repeat int, row_ix int, fold int")
    rows = lines.join(sized_broadcast(index, 48), sample)
    chosen = screen_by_fold(long, rows, table, sample, feature, value, y, k, group if deconfound else None)
    cells = long.join(sized_broadcast(index, 48), sample).select("row_ix", feature, F.col(value).cast("double").alias("v"))
    cells = cells.join(sized_broadcast(chosen, 48), feature)  # k features a fold
    shared = spark.sparkContext.broadcast((t, ids.astype(str), g, plan))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        ys, names, groups, folds_ = shared.value
        r, f = map(int, key)
        x = own.pivot_table(index="row_ix", columns=feature, values="v").reindex(np.arange(len(ys))).to_numpy(float)
        if np.isnan(x).any():
            raise ValueError("a line lacks a feature; fill the table first")
        return _one_fold(x, ys, names, groups, folds_[r], r, f, factory, deconfound)

    return cells.groupBy("repeat", "fold").applyInPandas(run, OOF)


def concordance(y: np.ndarray, p: np.ndarray, event: np.ndarray | None = None) -> float:
    """Share of pairs that p orders as y (those whose smaller y has the event), ties in p as half,
    counted digit by digit of the order of y: n log n, as operators.stats.concordance."""
    event = np.ones(len(y), bool) if event is None else np.asarray(event, bool)
    number = np.unique(y, return_inverse=True)[1]
    good = pairs = 0.0
    for level in range(int(number.max(initial=0)).bit_length()):
        group, high = number >> (level + 1), (number >> level) & 1 == 1
        order = np.lexsort((p, group))
        first, second = (~high & event)[order].astype(float), high[order].astype(float)
        upto = np.concatenate([[0.0], np.cumsum(first)])
        new = np.concatenate([[True], np.diff(group[order]) != 0])
        tie = new | np.concatenate([[True], np.diff(p[order]) != 0])
        starts, ends = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(p))
        at, to = np.flatnonzero(tie), np.append(np.flatnonzero(tie)[1:], len(p))
        of_group = np.cumsum(new) - 1
        of_tie = np.cumsum(tie) - 1
        base = upto[starts][of_group]
        good += (second * ((upto[at] + upto[to])[of_tie] / 2 - base)).sum()
        pairs += (second * (upto[ends][of_group] - base)).sum()
    return float(good / pairs) if pairs else math.nan


def within_groups(oof: DataFrame, groups: DataFrame, key: str, group: str, least: int = 10) -> DataFrame:
    """r_within_median, n_groups_within: the median r inside groups of at least `least` rows. Unlike the
    pooled r it does not reward a group's average."""
    per = oof.join(groups.select(F.col(key).cast("string").alias("line"), F.col(group).alias("_g")), "line").filter("_g IS NOT NULL").groupBy("_g").agg(F.count(F.lit(1)).alias("n"), safe_corr("truth", "pred").alias("r"))
    return per.filter(F.col("n") >= least).agg(F.median("r").alias("r_within_median"), F.count(F.lit(1)).alias("n_groups_within"))


def summarise(oof: DataFrame, name: str, seed: int = 0) -> dict:
    """model, r_mean, r_lo, r_hi, r_sd, rho_mean, cindex_mean, alpha_median, alpha_edge_frac."""
    from ..functions.special import rank_average

    pdf = to_local(oof, "out-of-fold predictions")
    t, p = (pdf.pivot(index="line", columns="repeat", values=c).to_numpy(float) for c in ("truth", "pred"))
    r = row_r(t.T, p.T)
    ok = [np.isfinite(t[:, k]) & np.isfinite(p[:, k]) for k in range(t.shape[1])]
    rho = [float(row_r(rank_average(t[m, k])[None], rank_average(p[m, k])[None])[0]) for k, m in enumerate(ok)]
    lo, hi = bootstrap_lines(t, p, seed=seed)
    fits = pdf.drop_duplicates(["repeat", "fold"])
    return {
        "model": name, "r_mean": float(np.nanmean(r)), "r_lo": lo, "r_hi": hi, "r_sd": float(np.nanstd(r)), "rho_mean": float(np.nanmean(rho)),
        "cindex_mean": float(np.nanmean([concordance(t[m, k], p[m, k]) for k, m in enumerate(ok)])), "alpha_median": float(fits["alpha"].median()), "alpha_edge_frac": float(fits["edge"].mean()),
    }


def per_repeat(oof: DataFrame) -> DataFrame:
    """repeat, n, r over the lines of each repeat."""
    return oof.groupBy("repeat").agg(F.count(F.lit(1)).alias("n"), safe_corr("truth", "pred").alias("r"))


def late_fusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """The mean of two models' predictions on the same folds."""
    keys = ["line", "repeat", "fold", "truth"]
    return a.join(b.select(*keys[:3], F.col("pred").alias("_p")), keys[:3]).withColumn("pred", (F.col("pred") + F.col("_p")) / 2).drop("_p")


def permuted_labels(pdf_y: np.ndarray, seed: int = 0) -> np.ndarray:
    """The labels in random order, for the leakage tripwire."""
    return np.random.default_rng(seed).permutation(pdf_y)


class LeakError(RuntimeError):
    """A model predicts permuted labels."""


def tripwire(r: float, stop: bool, limit: float = 0.05) -> bool:
    """Whether r^2 on permuted labels is over the limit; raises LeakError if it should stop."""
    high = abs(r * r) > limit
    if high and stop:
        raise LeakError(f"r^2 = {r * r:.3f} on permuted labels")
    return high


def one_hot(values: np.ndarray, train: np.ndarray, least: int = 1, drop_first: bool = False) -> np.ndarray:
    """0/1 columns of the categories with at least `least` training rows, in sorted order; rarer
    ones share a column, and those unseen in training have zeros."""
    names, counts = np.unique(values[train].astype(str), return_counts=True)
    common, rare = names[counts >= least], set(names[counts < least])
    cols = [(values.astype(str) == c).astype(float) for c in common]
    if rare:
        cols.append(np.isin(values.astype(str), list(rare)).astype(float))
    cols = cols[1:] if drop_first else cols
    return np.stack(cols, axis=1) if cols else np.zeros((len(values), 0))


def deconfounded_fit(x: np.ndarray, y: np.ndarray, group: np.ndarray, names: list[str], factory: Callable = fixed_model) -> pd.DataFrame:
    """gene, coef (non-zero, largest size first) of one fit on group-centred data."""
    xs, ys, ok = deconfounded(x, y, group, np.ones(len(y), bool))
    keep = ok & np.isfinite(ys)
    coef = factory().fit(xs[keep], ys[keep]).coef
    i = np.flatnonzero(coef)
    out = pd.DataFrame({"gene": [names[j] for j in i], "coef": coef[i]})
    return out.reindex(out["coef"].abs().sort_values(ascending=False, kind="stable").index).reset_index(drop=True)
