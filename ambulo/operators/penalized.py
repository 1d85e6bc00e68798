"""Penalized linear models of many subsets of rows at once (M8, M10, M15), from sums that add up over rows.

A subset is a side of a split, or a hashed subsample of one. One pass over the rows gives, for every side and class, the
matrix of products of all columns. From it follow, columns by columns and without the rows: missing rates, imputation by
constants, variances, correlations, standardization, F values, least-squares models with any penalty, and the bound of
the curvature of a logistic loss. Logistic models need their gradients besides: a pass gives those of all models, and
each step then minimizes the bounded loss with its penalty exactly, so few passes do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

TRAIN, TEST = 1, 2
#: Rows whose scores a worker holds at a time, and models of a side whose gradients are summed as one row.
ROWS, MODELS = 2048, 64
MISSING, LEAST_VARIANCE, MOST_CORRELATION = 0.6, 1e-8, 0.95


@dataclass
class Design:
    """rows(key, y, x array with nulls, sides array of 0 or TRAIN or TEST, samples array of 0 or 1), stored."""

    rows: DataFrame
    cols: list[str]
    sides: int
    samples: int


def design(df: DataFrame, key: str, cols: list[str], label: str, sides: DataFrame | None = None, n_sides: int = 1, samples: int = 0, share: float = 0.7, seed: int = 42) -> Design:
    """The rows of df whose label is not null, with the sides they are on: sides(key, sides); without, all train.

    Subsample k holds the rows whose hash of key and seed + k falls into the share. NaN is null.
    """
    x = F.array(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols))
    drawn = [(F.pmod(F.xxhash64(key, F.lit(seed + k)), F.lit(1000)) < round(share * 1000)).cast("tinyint") for k in range(samples)]
    rows = df.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"), x.alias("x"), F.array(*drawn).cast("array<tinyint>").alias("samples"))
    if sides is None:
        rows = rows.withColumn("sides", F.array(F.lit(TRAIN)).cast("array<tinyint>"))
    else:
        rows = rows.join(sides.select(F.col(key).alias("key"), F.col("sides").cast("array<tinyint>").alias("sides")), "key")
    return Design(stored(rows), cols, n_sides, samples)


def _matrix(column, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width) if width else np.zeros((len(column), 0))


def _augmented(x: np.ndarray) -> np.ndarray:
    """One, the values with nulls as zero, and where they are null; the last are left out if there are none."""
    gone = np.isnan(x)
    if not gone.any():
        return np.hstack([np.ones((len(x), 1)), x])
    return np.hstack([np.ones((len(x), 1)), np.where(gone, 0.0, x), gone.astype(float)])


def _summed(d: Design, work, partials) -> dict[int, np.ndarray]:
    """slot -> sum over all rows: work(z, x, y, sides, samples) adds a batch to `partials()`, an array by slot.

    Every partition emits its arrays once, and those of one slot meet in one group, a row from each partition.
    """
    width, n_sides, n_samples = len(d.cols), d.sides, d.samples

    def run(batches):
        held = partials()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                x = _matrix(b.column("x"), width).astype(float)
                work(held, _augmented(x), x, b.column("y").to_numpy(zero_copy_only=False), _matrix(b.column("sides"), n_sides), _matrix(b.column("samples"), n_samples))
        for slot, v in held.items():
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int64()), "v": pa.array([v.ravel()], pa.list_(pa.float64()))})

    def total(rows: pa.Table) -> pa.Table:
        v = np.sum([r.values.to_numpy() for r in rows.column("v")], axis=0)
        return pa.table({"slot": rows.column("slot")[:1], "v": pa.array([v], pa.list_(pa.float64()))})

    parts = d.rows.mapInArrow(run, "slot long, v array<double>")
    out = parts.groupBy("slot").applyInArrow(total, "slot long, v array<double>").toArrow()
    return {s: v.values.to_numpy() for s, v in zip(out.column("slot").to_pylist(), out.column("v"), strict=True)}


@dataclass
class Sums:
    """For each side and class the products of the augmented columns; rows of each subsample; rows of each bin."""

    products: np.ndarray  # sides, 2, 1 + 2 p, 1 + 2 p
    drawn: np.ndarray  # sides, 2, samples
    bins: np.ndarray  # sides, 2, p, bins + 1; the last bin holds nulls
    targets: np.ndarray  # sides, 1 + 2 p: products with y
    squares: np.ndarray  # sides: sum of y * y


def sums(d: Design, bins: int = 16, code: int = TRAIN) -> Sums:
    """One pass over the rows on the `code` part of each side. Bins are those between the quantiles of all rows.

    A task of the quantiles holds the distinct values of its own columns, not of all.
    """
    p, wide = len(d.cols), 1 + 2 * len(d.cols)
    cut = F.percentile("x", F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("q")
    quantiles = {r["j"]: r["q"] for r in d.rows.select(F.posexplode("x").alias("j", "x")).groupBy("j").agg(cut).collect()}
    edges = [np.unique(quantiles[j]) if quantiles.get(j) else np.empty(0) for j in range(p)]
    per, n_sides, n_samples = bins + 1, d.sides, d.samples

    def partials():
        return {k: np.zeros(n) for s in range(n_sides) for k, n in ((4 * s, 2 * wide * wide), (4 * s + 1, 2 * n_samples), (4 * s + 2, 2 * p * per), (4 * s + 3, wide + 1))}

    def work(held, z, x, y, sides, samples):
        binned = np.stack([np.where(np.isnan(x[:, j]), bins, np.searchsorted(edges[j], x[:, j], "left")) for j in range(p)], axis=1) if p else np.zeros((len(x), 0), int)
        slots = binned + np.arange(p) * per
        w = z.shape[1]
        for s in range(sides.shape[1]):
            on = sides[:, s] == code
            held[4 * s + 3][:w] += z[on].T @ y[on]
            held[4 * s + 3][wide] += float((y[on] ** 2).sum())
            for c in (0, 1):
                m = on & ((y > 0) == bool(c))
                own = z[m]
                held[4 * s].reshape(2, wide, wide)[c, :w, :w] += own.T @ own
                held[4 * s + 1].reshape(2, -1)[c] += samples[m].sum(axis=0)
                held[4 * s + 2].reshape(2, -1)[c] += np.bincount(slots[m].ravel(), minlength=p * per)

    got = _summed(d, work, partials)
    take = lambda k, *shape: np.stack([got.get(4 * s + k, np.zeros(int(np.prod(shape)))).reshape(shape) for s in range(d.sides)])
    targets = take(3, wide + 1)
    return Sums(take(0, 2, wide, wide), take(1, 2, d.samples), take(2, 2, p, per), targets[:, :wide], targets[:, wide])


def side_medians(d: Design, s: Sums) -> np.ndarray:
    """M2: sides by columns: exact medians of the training rows, asked for only where a column has nulls; else 0."""
    p = len(d.cols)
    out = np.zeros((d.sides, p))
    gone = [j for j in range(p) if s.products[:, :, 0, 1 + p + j].sum() > 0]
    if gone:
        on = d.rows.select("x", F.posexplode("sides").alias("side", "code")).where(F.col("code") == TRAIN)
        for r in on.groupBy("side").agg(*(F.percentile(F.get("x", F.lit(j)), F.lit(0.5)).alias(f"m{j}") for j in gone)).collect():
            out[r["side"], gone] = [r[f"m{j}"] or 0.0 for j in gone]
    return out


@dataclass
class Side:
    """A side's columns as its models see them: imputed, filtered, standardized; `to` maps models to augmented columns."""

    k: int
    columns: np.ndarray
    rows: np.ndarray  # rows of each class
    to: np.ndarray  # 1 + 2 p, 1 + p
    moments: np.ndarray  # 2, 1 + p, 1 + p: products of one and the standardized columns, by class
    targets: np.ndarray  # 1 + p: products with y
    correlation: np.ndarray
    f: np.ndarray = field(default=None)
    f_line: np.ndarray = field(default=None)

    def balanced(self) -> np.ndarray:
        """Class weights that make the classes weigh alike."""
        return self.rows.sum() / (2 * np.maximum(self.rows, 1))


def side_of(s: Sums, medians: np.ndarray, k: int, filters: bool = True) -> Side:
    """M1 to M6 of side k from the sums alone. A column that its filters drop is left out of `columns`."""
    p = medians.shape[1]
    both = s.products[k].sum(axis=0)
    n = max(both[0, 0], 1.0)
    fill = np.zeros((1 + 2 * p, 1 + p))
    fill[0, 0] = 1
    fill[np.arange(1, p + 1), np.arange(1, p + 1)] = 1
    fill[np.arange(p + 1, 2 * p + 1), np.arange(1, p + 1)] = medians[k]
    filled = fill.T @ both @ fill
    mean = filled[0, 1:] / n
    covariance = filled[1:, 1:] / n - np.outer(mean, mean)
    variance = np.clip(np.diag(covariance), 0, None)
    kept = np.arange(p)
    scale = np.where(variance > 1e-20, np.sqrt(np.maximum(variance, 1e-300)), 1.0)
    correlation = covariance / scale[:, None] / scale[None, :]
    if filters:
        missing = both[0, 1 + p :] / n
        kept = kept[missing < MISSING] if (missing < MISSING).any() else kept[:1]
        kept = kept[variance[kept] > LEAST_VARIANCE]
        far: list[int] = []
        for j in kept:
            if not (np.abs(correlation[j, far]) > MOST_CORRELATION).any():
                far.append(int(j))
        kept = np.array(far, int)
    to = fill.copy()
    to[:, 1:] = (fill[:, 1:] - np.outer(np.eye(1 + 2 * p)[0], mean)) / scale
    moments = np.stack([to.T @ c @ to for c in s.products[k]])
    rows = s.products[k, :, 0, 0]
    # F between the classes: the standardized columns have mean 0 and mean square 1.
    group = moments[:, 0, 1:] / np.maximum(rows, 1)[:, None]
    between = (rows[:, None] * group**2).sum(axis=0) / max(1, (rows > 0).sum() - 1)
    within = (n - (rows[:, None] * group**2).sum(axis=0)) / max(1.0, n - (rows > 0).sum())
    f = np.where((variance > 1e-20) & (within > 0), between / np.where(within > 0, within, 1), 0.0)
    # F of the straight line of each column: of its correlation with y.
    targets = to.T @ s.targets[k]
    spread = max(s.squares[k] / n - (targets[0] / n) ** 2, 0.0)
    r2 = np.clip((targets[1:] / n) ** 2 / (spread or 1.0), 0, 1)
    f_line = np.where((variance > 1e-20) & (spread > 0), r2 / np.maximum(1 - r2, 1e-300) * max(n - 2, 0.0), 0.0)
    return Side(k, kept, rows, to, moments, targets, correlation, f, f_line)


def components(side: Side, blocks: list[np.ndarray] | None = None, variance: float = 0.95, least: int = 1) -> Side:
    """A side whose columns are the leading principal components of its own, of all or of each block.

    Each block keeps the components that hold the share of its variance, `least` at the least; blocks of up to two columns
    stay as they are. Signs: the largest loading is positive. Components are scaled to mean square 1, as a model would.
    """
    p = len(side.correlation)
    n = max(side.rows.sum(), 1.0)
    whole = side.moments.sum(axis=0)
    loading, used = np.zeros((1 + p, 1 + p)), 0
    loading[0, 0] = 1
    for block in blocks or [side.columns]:
        own = np.array([j for j in block if whole[1 + j, 1 + j] > 0], int)
        if not len(own):
            continue
        if blocks and len(own) <= 2:
            part = np.eye(len(own))
        else:
            values, vectors = np.linalg.eigh(whole[np.ix_(own + 1, own + 1)] / n)
            values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
            vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(own))] < 0, -1, 1)
            many = min(max(int(np.searchsorted(np.cumsum(values) / (values.sum() or 1), variance - 1e-12)) + 1, least), len(own))
            part = vectors[:, :many] / np.sqrt(np.maximum(values[:many], 1e-12))
        loading[np.ix_(own + 1, np.arange(used, used + part.shape[1]) + 1)] = part
        used += part.shape[1]
    moments = np.stack([loading.T @ m @ loading for m in side.moments])
    return Side(side.k, np.arange(used), side.rows, side.to @ loading, moments, loading.T @ side.targets, moments.sum(axis=0)[1:, 1:] / n)


def binned_information(s: Sums, k: int) -> np.ndarray:
    """M7 of side k by bins: mutual information of each column's bin and the class."""
    t = s.bins[k]
    n = max(t[:, 0].sum(), 1.0) if t.shape[1] else 1.0
    joint = t / n
    alone = joint.sum(axis=0, keepdims=True) * joint.sum(axis=2, keepdims=True)
    return np.where(joint > 0, joint * np.log(np.where(joint > 0, joint, 1) / np.where(alone > 0, alone, 1)), 0.0).sum(axis=(0, 2))


@dataclass
class Model:
    """A logistic model to fit: the place of its Side among those given (of whose rows a subsample may be taken), its
    columns and penalties.

    Its loss is the weighted sum over rows, plus l1 times the sum of absolute weights, plus l2 / 2 times their squares.
    The intercept is not penalized.
    """

    side: int
    columns: tuple[int, ...]
    l1: float = 0.0
    l2: float = 0.0
    sample: int = -1


def _gradients(d: Design, sides: list[Side], models: list[Model], coefficients: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradients (models by augmented columns) of the weighted losses; a pass over the rows.

    Models of one side are worked on together, with the training rows of that side only.
    """
    wide = coefficients.shape[1]
    side, sample = np.array([sides[m.side].k for m in models]), np.array([m.sample for m in models])
    groups = [g for k in np.unique(side) for own in [np.flatnonzero(side == k)] for g in np.split(own, range(MODELS, len(own), MODELS))]
    sent = d.rows.sparkSession.sparkContext.broadcast([(side[g[0]], sample[g], coefficients[g].T.copy(), weights[g]) for g in groups])

    def partials():
        return {k: np.zeros((len(g), wide)) for k, g in enumerate(groups)}

    def work(held, z, x, y, sides, samples):
        at, w = None, z.shape[1]
        for k, (own, drawn, c, balance) in enumerate(sent.value):
            if own != at:
                at, on = own, sides[:, own] == TRAIN
                rows, label, picked = z[on], y[on], samples[on]
            rate = rows @ c[:w]
            np.clip(rate, -500, 500, out=rate)
            np.exp(np.negative(rate, out=rate), out=rate)
            rate += 1
            np.reciprocal(rate, out=rate)
            rate -= label[:, None]
            rate *= np.where(label[:, None] > 0, balance[:, 1], balance[:, 0])
            if (drawn >= 0).any():
                rate *= np.where(drawn >= 0, picked[:, np.maximum(drawn, 0)], 1)
            held[k][:, :w] += rate.T @ rows

    got = _summed(d, work, partials)
    sent.unpersist()
    out = np.zeros((len(models), wide))
    for k, v in got.items():
        out[groups[k]] = v.reshape(-1, wide)
    return out


def _shrunk(curvature: np.ndarray, gradient: np.ndarray, start: np.ndarray, l1: np.ndarray, l2: np.ndarray, free: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Minima of g (b - b0) + (b - b0) H (b - b0) / 2 + l1 |b| + l2 b b / 2, by coordinates, for many models of one H.

    start: models by 1 + p; free says which weights may move; the first is the intercept.
    """
    b, slope = start.copy(), gradient.copy()
    steep = np.diag(curvature)
    for _ in range(sweeps):
        most = 0.0
        for j in np.flatnonzero(free.any(axis=0) & (steep > 0)):
            pull = steep[j] * b[:, j] - slope[:, j]
            new = pull / steep[j] if j == 0 else np.sign(pull) * np.maximum(np.abs(pull) - l1, 0) / (steep[j] + l2)
            change = np.where(free[:, j], new - b[:, j], 0.0)
            b[:, j] += change
            slope += change[:, None] * curvature[j]
            most = max(most, float(np.abs(change).max(initial=0)))
        if most < 1e-9:
            break
    return b


def logistic(d: Design, s: Sums, sides: list[Side], models: list[Model], tolerance: float = 1e-6, passes: int = 200) -> np.ndarray:
    """Weights (models by 1 + p, on standardized columns, intercept first) of logistic models with balanced classes.

    The curvature of a logistic loss is at most a quarter of the weighted products, which the sums hold; the products of
    a subsample are at most those of its side. So every step lowers the loss, and nothing has to be tried. A model is
    done when no weight moves by more than the tolerance. A side without one of the classes has weights of zero.
    """
    p = len(d.cols)
    out = np.zeros((len(models), 1 + p))
    weights = np.zeros((len(models), 2))
    free = np.zeros((len(models), 1 + p), bool)
    for i, m in enumerate(models):
        rows = sides[m.side].rows if m.sample < 0 else s.drawn[sides[m.side].k][:, m.sample]
        if rows.min() > 0:
            weights[i] = rows.sum() / (2 * rows)
            free[i, [0, *(c + 1 for c in m.columns)]] = True
    by_side = {k: [i for i, m in enumerate(models) if m.side == k and weights[i].min() > 0] for k in {m.side for m in models}}
    curvature = {k: 0.25 * np.einsum("c,cij->ij", weights[own].max(axis=0), sides[k].moments) for k, own in by_side.items() if own}
    l1, l2 = np.array([m.l1 for m in models]), np.array([m.l2 for m in models])
    # Without l1 the step is linear: its matrix is inverted once.
    linear = {}
    for k, own in by_side.items():
        for i in own:
            if not l1[i]:
                at = np.flatnonzero(free[i])
                ridge = np.diag(np.where(at > 0, l2[i], 0.0))
                linear[i] = at, np.linalg.pinv(curvature[k][np.ix_(at, at)] + ridge, hermitian=True)
    active = [i for own in by_side.values() for i in own]
    for _ in range(passes):
        if not active:
            break
        coefficients = np.stack([sides[models[i].side].to @ out[i] for i in active])
        slopes = _gradients(d, sides, [models[i] for i in active], coefficients, weights[active])
        left = []
        for k in sorted({models[i].side for i in active}):
            own = [j for j, i in enumerate(active) if models[i].side == k]
            slope = slopes[own] @ sides[k].to
            for bent in (False, True):
                some = [r for r, j in enumerate(own) if bool(l1[active[j]]) == bent]
                if not some:
                    continue
                ids = [active[own[r]] for r in some]
                before = out[ids]
                if bent:
                    new = _shrunk(curvature[k], slope[some], before, l1[ids], l2[ids], free[ids])
                else:
                    new = before.copy()
                    for r, i in enumerate(ids):
                        at, inverse = linear[i]
                        pull = slope[some[r]][at] + np.where(at > 0, l2[i], 0.0) * before[r][at]
                        new[r, at] -= inverse @ pull
                out[ids] = new
                moved = np.abs(new - before).max(axis=1) > tolerance
                left += [i for i, m in zip(ids, moved, strict=True) if m]
        active = left
    return out


def least_squares(side: Side, columns, alpha: float, l1_share: float) -> np.ndarray:
    """Weights (1 + p) of a least-squares model on standardized columns, from the side's products alone.

    Loss: half the mean square error, plus alpha * l1_share times the absolute weights, plus alpha * (1 - l1_share) / 2
    times their squares; l1_share of 1 is the lasso.
    """
    n = max(side.rows.sum(), 1.0)
    h, g = side.moments.sum(axis=0) / n, -side.targets / n
    free = np.zeros((1, len(h)), bool)
    free[0, [0, *(c + 1 for c in columns)]] = True
    return _shrunk(h, g[None, :], np.zeros((1, len(h))), np.array([alpha * l1_share]), np.array([alpha * (1 - l1_share)]), free, 2000)[0]


def scores(d: Design, sides: list[Side], models: list[Model], weights: np.ndarray, code: int = TEST) -> DataFrame:
    """model, key, y and the log odds of every row on the `code` part of the model's side: a row for each of both."""
    c = np.stack([sides[m.side].to @ w for m, w in zip(models, weights, strict=True)])
    side = np.array([sides[m.side].k for m in models])
    sent = d.rows.sparkSession.sparkContext.broadcast(c.T.copy())
    width, n_sides = len(d.cols), d.sides

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                z = _augmented(_matrix(b.column("x"), width).astype(float))
                row, model = np.nonzero(_matrix(b.column("sides"), n_sides)[:, side] == code)
                score = (z @ sent.value[: z.shape[1]])[row, model]
                yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), b.column("key").take(pa.array(row)), b.column("y").take(pa.array(row)), pa.array(score)], ["model", "key", "y", "score"])

    return d.rows.mapInArrow(run, f"model int, key {d.rows.schema['key'].dataType.simpleString()}, y double, score double")
