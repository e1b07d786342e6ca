"""Gradient-boosted trees on histograms: bin edges once, then one aggregate for each level of a tree.

Features are binned by approximate quantiles and stored once, a byte a value. A level of a tree is one
pass: tasks evaluate the trees so far, take each row's gradient and curvature and add them up by
(node, feature, bin); sums of tasks meet in one aggregate, whose size depends on nodes, features and
bins alone, and the driver picks the splits. Any number of formulations (losses, targets, training rows)
grow side by side in the same passes, so that four losses or the folds of a cross-validation cost
no more passes than one. Missing values have a bin of their own, and a split sends them to the side that
gains more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.streaming.runtime import shared_path

#: Trees that are evaluated anew in each pass; then the sums so far are written beside the rows.
FOLDED = 25
LOSSES = ("squared", "huber", "tweedie", "quantile")


@dataclass(frozen=True)
class Formulation:
    """What a model learns: target, a loss and its parameter (huber: where it turns linear; tweedie: the power, 1 for Poisson, of
    counts or amounts on a log scale; quantile: which), and the rows to learn from."""

    target: Column
    loss: str = "squared"
    param: float = 0.0
    rows: Column | None = None


@dataclass
class Booster:
    """A trained model. trees: arrays over the nodes of complete trees (feature, bin, missing), and over their leaves (value)."""

    features: list[str]
    edges: list[list[float]]
    loss: str
    base: float
    depth: int
    trees: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        plain = [{k: np.asarray(v).tolist() for k, v in t.items()} for t in self.trees]
        return json.dumps(self.__dict__ | {"trees": plain})

    @staticmethod
    def from_json(text: str) -> Booster:
        raw = json.loads(text)
        raw["trees"] = [{k: np.asarray(v) for k, v in t.items()} for t in raw["trees"]]
        return Booster(**raw)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features, NaN where missing: predictions on the loss's own scale."""
        binned = np.stack([_bins(x[:, i], np.asarray(e)) for i, e in enumerate(self.edges)], axis=1)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t["value"][leaf_of(binned, t, self.depth)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.exp(self.raw(x)) if self.loss == "tweedie" else self.raw(x)


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin 0 for missing values, else 1 and the number of edges below."""
    return np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x, "left")).astype(np.int8)


def leaf_of(binned: np.ndarray, tree: Mapping[str, np.ndarray], depth: int) -> np.ndarray:
    """The node that each row reaches after ``depth`` levels, counted from the left."""
    node = np.zeros(len(binned), np.int64)
    at = np.arange(len(binned))
    for level in range(depth):
        k = (1 << level) - 1 + node
        b = binned[at, tree["feature"][k]]
        left = np.where(b == 0, tree["missing"][k], b <= tree["bin"][k])
        node = 2 * node + ~left.astype(bool)
    return node


def slopes(loss: str, param: float, f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the prediction ``f``; for huber and quantile the second is 1."""
    one = np.ones_like(f)
    if loss == "squared":
        return f - y, one
    if loss == "huber":
        return np.clip(f - y, -param, param), one
    if loss == "quantile":
        return np.where(y > f, -param, 1 - param), one
    if loss == "tweedie":
        a, b = np.exp((1 - param) * f), np.exp((2 - param) * f)
        return b - y * a, (2 - param) * b - (1 - param) * y * a
    raise ValueError(f"no loss {loss!r}: one of {', '.join(LOSSES)}")


def start(loss: str, param: float, mean: float, quantile: float) -> float:
    """The constant that boosting begins with: for quantile and huber that quantile (the median), for tweedie the log of the mean."""
    if loss == "tweedie":
        return float(np.log(max(mean, 1e-9)))
    return quantile if loss in ("quantile", "huber") else mean


def best_splits(sums: np.ndarray, l2: float, least: int) -> dict[str, np.ndarray]:
    """Of sums (node, feature, bin, 3) of gradient, curvature and rows: each node's split, and the (gradient, curvature, rows) left and right of it.

    A node without a split of ``least`` rows on each side that gains sends all rows left. Of equal gains the first by
    feature, bin, and missing values left is taken; gains are compared to nine digits, so that the order of adding doesn't matter.
    """
    nodes, _, bins, _ = sums.shape
    total = sums[:, :1].sum(axis=2)  # every feature has the same total
    below = np.cumsum(sums[:, :, 1:], axis=2)
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2 + 1e-12)
    options = []
    for missing in (True, False):
        left = below + (sums[:, :, :1] if missing else 0)
        right = total[:, :, None] - left
        gain = score(left) + score(right) - score(total[:, :, None])
        gain[(left[..., 2] < least) | (right[..., 2] < least)] = -np.inf
        options.append(gain)
    gain = np.stack(options, axis=-1).reshape(nodes, -1)
    scale = np.maximum(score(total[:, 0])[:, None], 1e-12)
    with np.errstate(invalid="ignore"):
        rounded = np.round(gain / scale, 9)
    pick = np.argmax(rounded, axis=1)
    n = np.arange(nodes)
    split = rounded[n, pick] > 0
    f, b, m = np.unravel_index(pick, (sums.shape[1], bins - 1, 2))
    f, b, missing = np.where(split, f, 0), np.where(split, b + 1, 127), np.where(split, m == 0, True)
    left = np.where(split[:, None], below[n, f, np.minimum(b, bins - 1) - 1] + np.where(missing[:, None], sums[n, f, 0], 0), total[:, 0])
    return {"feature": f, "bin": b, "missing": missing, "left": left, "right": total[:, 0] - left}


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to ``bins`` - 1 edges a feature, at approximate quantiles; one aggregate."""
    wanted = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), wanted, 20 * bins).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return [sorted({v for v in (e or []) if v == v}) for e in found]


def _binned(rows: DataFrame, features: list[str], edges: list[list[float]], models: list[Formulation], bases: list[float]) -> DataFrame:
    """Bins of each feature, targets (missing where a model doesn't learn from the row) and the sums so far, as arrays."""

    @F.arrow_udf("array<tinyint>")
    def binned(x: pa.Array) -> pa.Array:
        m = x.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(x), len(features))
        b = np.stack([_bins(m[:, i], np.asarray(e)) for i, e in enumerate(edges)], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(features)), pa.array(b.ravel()))

    targets = [F.when(m.rows if m.rows is not None else F.lit(True), m.target.cast("double")) for m in models]
    learned = rows.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.array(*targets).alias("y"))
    learned = learned.where(F.exists("y", lambda v: v.isNotNull() & ~F.isnan(v)))
    return learned.select(binned("x").alias("b"), "y", F.array(*[F.lit(float(v)) for v in bases]).alias("f"))


def _matrix(a: pa.Array, width: int) -> np.ndarray:
    return a.flatten().fill_null(float("nan") if pa.types.is_floating(a.type.value_type) else 0).to_numpy(zero_copy_only=False).reshape(len(a), width)


def fit(rows: DataFrame, features: list[str], models: Mapping[str, Formulation], *, trees: int = 100, depth: int = 5, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 20, seed: int = 0, share: float = 1.0) -> dict[str, Booster]:
    """Train one booster for each formulation, all in the same passes: trees x depth aggregates.

    features: names of numeric columns, null or NaN where missing. share: of the features that a tree of each model may split
    by, drawn by ``seed``. Rows without any target take no part. A formulation without rows, or with a constant target, predicts its start.
    bins: 127 at most.
    """
    if not 1 < bins <= 126:
        raise ValueError("bins must be from 2 to 126")
    names, specs = list(models), list(models.values())
    for s in specs:
        slopes(s.loss, s.param, np.zeros(1), np.zeros(1))
    edges = bin_edges(rows, features, bins)
    width, n_models, n_bins = len(features), len(specs), max(map(len, edges), default=0) + 2
    learns = [F.when(s.rows if s.rows is not None else F.lit(True), s.target.cast("double")) for s in specs]
    at = [F.percentile_approx(y, s.param if s.loss == "quantile" else 0.5, 10_000) for s, y in zip(specs, learns)]
    first = rows.agg(*[F.avg(y).alias(f"m{i}") for i, y in enumerate(learns)], *[q.alias(f"q{i}") for i, q in enumerate(at)]).first()
    bases = [start(s.loss, s.param, first[f"m{i}"] or 0.0, first[f"q{i}"] or 0.0) for i, s in enumerate(specs)]
    spark, base_path = rows.sparkSession, shared_path(rows.sparkSession, "boosting")
    _binned(rows, features, edges, specs, bases).write.parquet(f"{base_path}/0")
    table, grown, fresh = spark.read.parquet(f"{base_path}/0"), [[] for _ in specs], []
    losses = [(s.loss, s.param) for s in specs]
    rng = np.random.default_rng(seed)

    def sums_of(b: np.ndarray, f: np.ndarray, done: list[list[dict]]) -> np.ndarray:
        out = f.copy()
        for step in done:
            for m, t in enumerate(step):
                out[:, m] += t["value"][leaf_of(b, t, depth)]
        return out

    def histograms(done: list[list[dict]], now: list[dict], level: int):
        nodes = 1 << level

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_models * nodes * width * n_bins, 3))
            for batch in batches:
                b, y = _matrix(batch.column("b"), width), _matrix(batch.column("y"), n_models)
                f = sums_of(b, _matrix(batch.column("f"), n_models), done)
                for m, (loss, param) in enumerate(losses):
                    some = np.flatnonzero(~np.isnan(y[:, m]))
                    if not len(some):
                        continue
                    g, h = slopes(loss, param, f[some, m], y[some, m])
                    node = leaf_of(b[some], now[m], level)
                    cell = (((m * nodes + node) * width)[:, None] + np.arange(width)) * n_bins + b[some]
                    for i, v in enumerate((g, h, np.ones_like(g))):
                        total[:, i] += np.bincount(cell.ravel(), np.repeat(v, width), len(total))
            held = np.flatnonzero(total[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(held), *[pa.array(total[held, i]) for i in range(3)]], ["cell", "g", "h", "n"])

        parts = table.mapInArrow(count, "cell long, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"])
        t = parts.toArrow()  # cells at most: models x nodes x features x bins
        sums = np.zeros((n_models * nodes * width * n_bins, 3))
        sums[t["cell"].to_numpy()] = np.stack([t[c].to_numpy() for c in "ghn"], axis=1)
        return sums.reshape(n_models, nodes, width, n_bins, 3)

    for step in range(trees if width else 0):
        used = [np.sort(rng.choice(width, max(1, round(share * width)), replace=False)) for _ in specs]
        now = [{"feature": np.zeros(0, np.int64), "bin": np.zeros(0, np.int64), "missing": np.zeros(0, bool)} for _ in specs]
        for level in range(depth):
            sums = histograms(fresh, now, level)
            for m in range(n_models):
                split = best_splits(sums[m][:, used[m]], l2, least)
                now[m] = {"feature": np.append(now[m]["feature"], used[m][split["feature"]]), **{k: np.append(now[m][k], split[k]) for k in ("bin", "missing")}}
                if level == depth - 1:
                    ends = np.stack([split["left"], split["right"]], axis=1).reshape(-1, 3)
                    now[m]["value"] = np.where(ends[:, 2] > 0, -rate * ends[:, 0] / (ends[:, 1] + l2 + 1e-12), 0.0)
        fresh.append(now)
        for m in range(n_models):
            grown[m].append(now[m])
        if len(fresh) == FOLDED and step + 1 < trees:
            done = fresh

            def folded(batches: Iterator[pa.RecordBatch], done: list[list[dict]] = done) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    f = sums_of(_matrix(batch.column("b"), width), _matrix(batch.column("f"), n_models), done)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * n_models), pa.array(f.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("y"), flat], ["b", "y", "f"])

            path = f"{base_path}/{step + 1}"
            table.mapInArrow(folded, "b array<tinyint>, y array<double>, f array<double>").write.parquet(path)
            table, fresh = spark.read.parquet(path), []
    jvm = spark._jvm.org.apache.hadoop.fs.Path(base_path)
    jvm.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jvm, True)
    return {n: Booster(list(features), edges, s.loss, bases[i], depth, grown[i]) for i, (n, s) in enumerate(zip(names, specs))}


def predict(rows: DataFrame, boosters: Mapping[str, Booster]) -> DataFrame:
    """``rows`` with a column for each booster's prediction, in the target's units."""
    shared = rows.sparkSession.sparkContext.broadcast(dict(boosters))  # trees only

    def one(name: str, width: int) -> Column:
        @F.arrow_udf("double")
        def value(x: pa.Array) -> pa.Array:
            return pa.array(shared.value[name].predict(_matrix(x, width).astype(np.float64)))

        return value(F.array(*[F.col(f).cast("double") for f in boosters[name].features]))

    return rows.withColumns({n: one(n, len(b.features)) for n, b in boosters.items()})


def nonnegative(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """The w >= 0 that minimises w'Gw / 2 - w'm, by an active set of few unknowns."""
    n = len(moment)
    w, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n + 1):
        slope = moment - gram @ w
        slope[active] = -np.inf
        i = int(np.argmax(slope)) if n else 0
        if not n or slope[i] <= 1e-10 * max(1.0, np.abs(moment).max()):
            break
        active[i] = True
        while True:
            trial = np.zeros(n)
            trial[active] = np.linalg.lstsq(gram[np.ix_(active, active)], moment[active], rcond=None)[0]
            bad = active & (trial <= 0)
            if not bad.any():
                break
            step = min(w[j] / (w[j] - trial[j]) for j in np.flatnonzero(bad) if w[j] != trial[j])
            w = w + step * (trial - w)
            active &= w > 1e-14
            w[~active] = 0
        w = trial
    return w


def stack_weights(rows: DataFrame, predictions: list[str], observed: str) -> dict[str, float]:
    """Non-negative least-squares weights of predictions, from one aggregate of their products; rows with a missing value take no part."""
    columns = [*predictions, observed]
    whole = rows.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in columns)) if columns else rows
    n = len(predictions)
    got = whole.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(predictions) for j, b in enumerate(columns) if j >= i]).first()
    gram, moment = np.zeros((n, n)), np.array([got[f"s{i}_{n}"] or 0.0 for i in range(n)])
    for i in range(n):
        for j in range(i, n):
            gram[i, j] = gram[j, i] = got[f"s{i}_{j}"] or 0.0
    return dict(zip(predictions, nonnegative(gram, moment).tolist()))


def out_of_fold(rows: DataFrame, features: list[str], models: Mapping[str, Formulation], fold: Column, folds: int, **settings) -> DataFrame:
    """``rows`` with each formulation's prediction by the model that did not learn from the row's fold, a number from 0 to ``folds`` - 1.

    All folds of all formulations grow in the same passes. A row without a fold gets no prediction.
    """
    seen = lambda m: m.rows if m.rows is not None else F.lit(True)
    each = {f"{n}__{k}": Formulation(m.target, m.loss, m.param, seen(m) & (fold != k)) for n, m in models.items() for k in range(folds)}
    told = predict(rows, fit(rows, features, each, **settings))
    chosen = {n: F.coalesce(*[F.when(fold == k, F.col(f"{n}__{k}")) for k in range(folds)]) for n in models}
    return told.withColumns(chosen).drop(*each)
