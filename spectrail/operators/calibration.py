"""Models of mass errors along the mass axis.

Both models are fitted to tables of bounded size that Spark sums up in one pass: the spline to the products of its basis
columns, the boosted trees to counts by bins of the feature and of the target. What follows is linear algebra on a dozen columns, or
400 rounds over a few hundred bins, and goes on without the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ppm_ranges(psms: DataFrame, columns: tuple[str, ...] = ("precursor_ppm", "fragment_ppm")) -> DataFrame:
    """One row: least and largest value of each column."""
    return psms.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def split(psms: DataFrame, share: float = 0.8, seed: int = 42, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows for training and for testing: by a hash of ``key`` (the same in each run), or at random without one."""
    if key is None:
        train, test = psms.randomSplit([share, 1 - share], seed)
        return train, test
    own = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_003)) < F.lit(int(share * 1_000_003))
    return psms.where(own), psms.where(~own)


def _usable(*columns: str) -> Column:
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < F.lit(float("inf")))
    return good


# --- boosted trees for the absolute error


@dataclass
class Boosted:
    """A value for each bin of the feature; ``cuts`` are the least values of the bins but the first."""

    feature: str
    cuts: list[float]
    values: list[float]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds prediction; null where the feature is."""
        at = F.size(F.filter(F.array(*map(F.lit, self.cuts)), lambda c: c <= F.col(self.feature).cast("double"))) if self.cuts else F.lit(0)
        return rows.withColumn("prediction", F.when(F.col(self.feature).isNotNull(), F.element_at(F.array(*map(F.lit, self.values)), at + 1)))


def _cuts(rows: DataFrame, column: str, bins: int) -> list[float]:
    """Values that cut a column into about equal parts."""
    found = rows.agg(F.percentile_approx(F.col(column).cast("double"), [i / bins for i in range(1, bins)], 50 * bins)).first()[0]
    return sorted(set(found or []))


def _grown(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """The leaf of each bin in a tree of ``depth`` levels: each part is cut where the gain of its gradients' sums is best."""
    sums, counts = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    parts = [(0, len(g))]
    for _ in range(depth):
        new = []
        for a, b in parts:
            at = np.arange(a + 1, b)
            gl, hl = sums[at] - sums[a], counts[at] - counts[a]
            gr, hr = sums[b] - sums[at], counts[b] - counts[at]
            gain = np.where((hl >= 1) & (hr >= 1), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -np.inf)
            k = int(gain.argmax()) if len(gain) else -1
            total = sums[b] - sums[a]
            if k < 0 or gain[k] <= total**2 / (counts[b] - counts[a] + ridge) + 1e-12:
                new.append((a, b))
            else:
                new += [(a, int(at[k])), (int(at[k]), b)]
        parts = new
    leaf = np.zeros(len(g), int)
    for i, (a, b) in enumerate(parts):
        leaf[a:b] = i
    return leaf


def boosted_bins(counts: np.ndarray, centers: np.ndarray, trees: int = 400, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, ridge: float = 1.0, seed: int = 42) -> np.ndarray:
    """A value for each bin of the feature, from counts by (bin of the feature, bin of the target) and the target bins' centers.

    Each round grows a tree on the signs of the residuals and adds ``rate`` times the median residual of each leaf. A round
    sees each row with the chance ``subsample``: it thins the counts as sampling rows would.
    """
    rng = np.random.default_rng(seed)

    def median(values: np.ndarray, weights: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        return float(values[order][np.searchsorted(upto, upto[-1] / 2)])

    own = np.full(len(counts), median(centers, counts.sum(axis=0)))
    for _ in range(trees):
        seen = counts if subsample >= 1 else rng.binomial(counts, subsample)
        residual = centers[None, :] - own[:, None]
        leaf = _grown((seen * np.sign(residual)).sum(axis=1), seen.sum(axis=1).astype(float), depth, ridge)
        for k in range(leaf.max() + 1):
            mine = leaf == k
            w = seen[mine]
            if w.any():
                hit = w > 0
                own[mine] += rate * median(residual[mine][hit], w[hit])
    return own


def boosted(train: DataFrame, target: str, feature: str = "expmass", bins: int = 256, target_bins: int = 1_024, **rounds: float) -> Boosted:
    """Gradient-boosted trees for the absolute error over one feature; rows with a null or non-finite value do not count.

    Both columns are cut at approximate quantiles; the driver gets ``bins * target_bins`` counts at most. A target bin stands
    at its mean, so a target with fewer different values is kept as it is. ``rounds`` go to ``boosted_bins``.
    """
    rows = train.where(_usable(feature, target)).select(F.col(feature).cast("double").alias("x"), F.col(target).cast("double").alias("y"))
    cuts, targets = _cuts(rows, "x", bins), _cuts(rows, "y", target_bins)
    place = lambda c, at: F.size(F.filter(F.array(*map(F.lit, at)), lambda v: v <= F.col(c))) if at else F.lit(0)
    # two-step: different values first, so that the search among the cuts runs once for each of them
    placed = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).select(place("x", cuts).alias("i"), place("y", targets).alias("j"), "y", "n")
    cells = placed.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("s")).collect()
    if not cells:
        return Boosted(feature, [], [0.0])
    counts, sums = np.zeros((len(cuts) + 1, len(targets) + 1), np.int64), np.zeros(len(targets) + 1)
    for c in cells:
        counts[c["i"], c["j"]] += c["n"]
        sums[c["j"]] += c["s"]
    used = counts.sum(axis=0) > 0
    centers = sums[used] / counts[:, used].sum(axis=0)
    return Boosted(feature, cuts, boosted_bins(counts[:, used], centers, **rounds).tolist())


# --- spline with Bayesian ridge


@dataclass
class Basis:
    """Quadratic B-splines on knots at even distances; values beyond the range count as its ends, and the last spline is left out."""

    low: float
    high: float
    knots: int = 10

    @property
    def size(self) -> int:
        return self.knots

    def piece(self, feature: str) -> tuple[Column, Column]:
        """Between which knots a value lies, from 0, and how far behind the first of them, from 0 to 1."""
        step = (self.high - self.low) / (self.knots - 1) or 1.0
        t = F.least(F.greatest((F.col(feature).cast("double") - F.lit(self.low)) / F.lit(step), F.lit(0.0)), F.lit(float(self.knots - 1)))
        piece = F.least(F.floor(t), F.lit(self.knots - 2)).cast("int")
        return piece, t - piece


#: The three splines over a piece as polynomials of the way u behind its first knot: factors of 1, u and u * u.
PARTS = np.array([[1, -2, 1], [1, 2, -2], [0, 0, 1]]) / 2


def gram(rows: DataFrame, basis: Basis, target: Column, feature: str) -> np.ndarray:
    """Sums of products of all pairs of (1, splines, target), from sums of powers for each piece between two knots."""
    piece, u = basis.piece(feature)
    named = rows.select(piece.alias("p"), u.alias("u"), target.cast("double").alias("y"))
    sums = [F.sum(F.pow("u", F.lit(k))).alias(f"u{k}") for k in range(5)] + [F.sum(F.pow("u", F.lit(k)) * F.col("y")).alias(f"y{k}") for k in range(3)] + [F.sum(F.col("y") * F.col("y")).alias("yy")]
    n = basis.size + 3  # with the spline that is left out
    out = np.zeros((n, n))
    for r in named.groupBy("p").agg(*sums).collect():  # one row for each piece
        powers, own = [r[f"u{k}"] for k in range(5)], np.arange(r["p"], r["p"] + 3) + 1
        hankel = np.array([[powers[i + j] for j in range(3)] for i in range(3)])
        out[np.ix_(own, own)] += PARTS @ hankel @ PARTS.T
        out[0, 0] += powers[0]
        out[0, own] += PARTS @ powers[:3]
        out[own, 0] = out[0, own]
        out[own, -1] += PARTS @ [r[f"y{k}"] for k in range(3)]
        out[-1, own] = out[own, -1]
        out[0, -1] += r["y0"]
        out[-1, 0] = out[0, -1]
        out[-1, -1] += r["yy"]
    keep = [*range(basis.size + 1), n - 1]
    return out[np.ix_(keep, keep)]


def _placed(rows: DataFrame, basis: Basis, feature: str) -> DataFrame:
    """``rows`` with _p and _u, a row's piece and its way into it, so that long expressions read them as columns."""
    piece, u = basis.piece(feature)
    return rows.withColumns({"_p": piece, "_u": u})


def _part(k: int) -> Column:
    return F.lit(float(PARTS[k, 0])) + F.lit(float(PARTS[k, 1])) * F.col("_u") + F.lit(float(PARTS[k, 2])) * F.col("_u") * F.col("_u")


def _line(model: Ridge) -> Column:
    """The model's value: three weights count for a row."""
    at = F.array(*[F.lit(float(w)) for w in (*model.weights, 0.0)])
    return sum((F.element_at(at, F.col("_p") + 1 + k) * _part(k) for k in range(3)), F.lit(model.offset))


def _doubt(model: Ridge) -> Column:
    """The variance of a prediction: that of the weights at the row's splines, and the noise."""
    n = len(model.means) + 1
    full = np.zeros((n, n))
    full[:-1, :-1] = model.covariance
    means = np.append(model.means, 0.0)
    cells, cross = F.array(*[F.lit(float(x)) for x in full.ravel()]), F.array(*[F.lit(float(x)) for x in full @ means])
    pairs = sum((F.element_at(cells, (F.col("_p") + i) * n + F.col("_p") + j + 1) * _part(i) * _part(j) for i in range(3) for j in range(3)), F.lit(0.0))
    single = sum((F.element_at(cross, F.col("_p") + i + 1) * _part(i) for i in range(3)), F.lit(0.0))
    return F.greatest(pairs - 2 * single + F.lit(float(means @ full @ means)), F.lit(0.0)) + F.lit(1 / model.noise)


@dataclass
class Ridge:
    """Weights and offset in the basis, precision of the noise, and the weights' covariance around the columns' means."""

    weights: np.ndarray
    offset: float
    noise: float
    means: np.ndarray
    covariance: np.ndarray


def bayesian_ridge(sums: np.ndarray, rounds: int = 300, tolerance: float = 1e-3, prior: float = 1e-6) -> Ridge:
    """Ridge regression whose two precisions maximise the evidence, from sums of products.

    Columns are divided by their deviation and centered with the target, so the offset is not shrunk. Precisions are updated in
    turn with weak gamma priors until the weights move by less than ``tolerance`` in all.
    """
    n, s, y = sums[0, 0], sums[0, 1:-1], sums[0, -1]
    means, mean_y = s / n, y / n
    centered = sums[1:-1, 1:-1] - n * np.outer(means, means)
    scale = np.sqrt(np.maximum(np.diag(centered) / n, 0))
    scale[scale < 1e-12] = 1.0
    g = centered / np.outer(scale, scale)
    xy = (sums[1:-1, -1] - n * means * mean_y) / scale
    yy = max(sums[-1, -1] - n * mean_y**2, 0.0)
    eig, v = np.linalg.eigh(g)
    eig = np.maximum(eig, 0)
    noise, shrink, before = 1 / (yy / n + 1e-15), 1.0, None
    for k in range(rounds):
        w = v @ ((v.T @ xy) / (eig + shrink / noise))
        wrong = max(yy - 2 * w @ xy + w @ g @ w, 0.0)
        if before is not None and np.abs(w - before).sum() < tolerance:
            break
        before = w
        if k < rounds - 1:
            used = (noise * eig / (shrink + noise * eig)).sum()
            shrink = (used + 2 * prior) / (w @ w + 2 * prior)
            noise = (n - used + 2 * prior) / (wrong + 2 * prior)
    covariance = (v / (shrink + noise * eig)) @ v.T / np.outer(scale, scale)
    weights = w / scale
    return Ridge(weights, float(mean_y - means @ weights), float(noise), means, covariance)


@dataclass
class Spline:
    """A model of the target and one of the residuals' size, on one basis."""

    feature: str
    basis: Basis
    center: Ridge
    spread: Ridge

    def predict(self, rows: DataFrame, sigmas: float = 2.0) -> DataFrame:
        """Adds prediction, low and high (``sigmas`` times the predicted size of a residual, at least 0, to either side) and
        deviation, the prediction's own standard deviation with the noise; null where the feature is."""
        known, center = F.col(self.feature).isNotNull(), _line(self.center)
        size = F.greatest(_line(self.spread), F.lit(0.0)) * F.lit(sigmas)
        found = {"prediction": center, "low": center - size, "high": center + size, "deviation": F.sqrt(_doubt(self.center))}
        return _placed(rows, self.basis, self.feature).withColumns({name: F.when(known, x) for name, x in found.items()}).drop("_p", "_u")


def spline(train: DataFrame, target: str, feature: str = "expmass", knots: int = 10) -> Spline:
    """Both models, in three passes: the feature's range, sums for the target, sums for the residuals' sizes."""
    rows = train.where(_usable(feature, target))
    r = rows.agg(F.min(feature).alias("a"), F.max(feature).alias("b")).first()
    if r["a"] is None:
        raise ValueError("no row with a finite feature and target")
    basis = Basis(float(r["a"]), float(r["b"]), knots)
    center = bayesian_ridge(gram(rows, basis, F.col(target), feature))
    return Spline(feature, basis, center, bayesian_ridge(gram(_placed(rows, basis, feature), basis, F.abs(F.col(target) - _line(center)), feature)))


def metrics_table(predicted: DataFrame, target: str) -> DataFrame:
    """One row: mae, rmse and r2 of the column ``prediction``, and the number of rows with both values (r2 null for a constant target)."""
    e, y = F.col(target) - F.col("prediction"), F.col(target).cast("double")
    rows = predicted.where(F.col(target).isNotNull() & F.col("prediction").isNotNull())
    total = F.var_pop(y)
    found = rows.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("_m"), total.alias("_v"), F.count(F.lit(1)).alias("n"))
    return found.select("mae", "rmse", F.when(F.col("_v") > 0, 1 - F.col("_m") / F.col("_v")).alias("r2"), "n")


def metrics(predicted: DataFrame, target: str) -> dict[str, float]:
    """mae, rmse and r2 of the prediction."""
    row = metrics_table(predicted, target).first()
    return {m: row[m] for m in ("mae", "rmse", "r2")}
