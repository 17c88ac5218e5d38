"""Hidden-state models of panels, many at a time: every training window and every start is a model of one job.

A sequence is an entity's rows in one training window, written once as a row of arrays. A round of training is a narrow
pass over the sequences in which each meets the models of its window, followed by a sum of sufficient statistics per
model; only these sums (states x columns numbers a model, and models are counted by calendar and starts) reach the driver,
which makes the next parameters. Models that have converged leave the rounds. Two kinds:

* ``mixture``: hidden Markov states with diagonal Gaussian emissions, by expectation-maximisation;
* ``stays``: states with a distribution of how long a stay lasts (discrete, 1 to max_stay), by Viterbi training: the best
  paths are decoded, then counted. A sequence's last stay is cut off by its end, so it doesn't count as a duration.

Starts are nearest-centre clusterings (Lloyd's rounds, the same sums) from rows drawn by hash; of a window's starts the
best final likelihood counts (the first of equals), and states are numbered in the order of their means. Nothing depends
on partitioning but the last bits of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import recursions
from panelforge.operators.quantiles import quantiles
from panelforge.panel import ratio
from panelforge.shared import materialize, release

c = F.col
#: Sequences that a task works on at a time.
TOGETHER = 128


@dataclass(frozen=True)
class Config:
    """n_states, starts, most rounds of clustering and of training, and what ends them.

    tol: a round's gain in likelihood that ends a mixture's training; rel_tol: the share of the likelihood for stays.
    smoothing: added to each count of a start, a move and a duration of a model of stays. floor: the least variance.
    """

    kind: str = "mixture"
    n_states: int = 3
    starts: int = 3
    rounds: int = 300
    cluster_rounds: int = 20
    tol: float = 1e-2
    rel_tol: float = 1e-4
    max_stay: int = 60
    smoothing: float = 1.0
    floor: float = 1e-4


@dataclass
class Models:
    """Parameters of models side by side: window number, log likelihood, and arrays with a model to a row."""

    config: Config
    window: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    start: np.ndarray
    move: np.ndarray
    stay: np.ndarray
    score: np.ndarray
    trace: list[list[float]] = field(default_factory=list)

    def take(self, at: np.ndarray) -> Models:
        arrays = {x: getattr(self, x)[at] for x in ("window", "mean", "var", "start", "move", "stay", "score")}
        return replace(self, **arrays, trace=[self.trace[i] for i in at])

    def dens(self, m: np.ndarray, x: np.ndarray) -> np.ndarray:
        return recursions.log_density(x, self.mean[m], self.var[m])

    def tables(self, m: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables of best paths of sequences under their models."""
        with np.errstate(divide="ignore"):
            return recursions.stays(self.dens(m, x), np.log(self.start[m]), np.log(self.move[m]), np.log(self.stay[m]))


def sequences(rows: DataFrame, columns: list[str], window: str = "window", train: Column | None = None) -> DataFrame:
    """(window, entity, n_train, dates, x) of rows, written: x holds the columns' values row by row, in time order.

    Rows with a null column are left out. n_train counts the first rows for which train holds (all, if not given).
    """
    known = rows.where(" and ".join(f"{x} is not null" for x in columns))
    row = F.struct("trade_date", F.array(*(c(x).cast("double") for x in columns)).alias("v"), (train if train is not None else F.lit(True)).alias("own"))
    held = known.groupBy(c(window).cast("int").alias("window"), "entity").agg(F.sort_array(F.collect_list(row)).alias("r"))
    n_train = F.size(F.filter("r", lambda s: s["own"])).alias("n_train")
    return materialize(held.select("window", "entity", n_train, c("r.trade_date").alias("dates"), F.flatten("r.v").alias("x")), "sequences")


def _batches(batch: pa.RecordBatch, d: int, trained: bool) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, windows, lengths, padded values) of a batch (window, n_train, x), sequences of like length together."""
    windows, values = batch.column("window").to_numpy(), [np.asarray(v.values).reshape(-1, d) for v in batch.column("x")]
    if trained:
        values = [v[:n] for v, n in zip(values, batch.column("n_train").to_pylist())]
    order = sorted((i for i in range(len(values)) if len(values[i])), key=lambda i: len(values[i]))
    for at in range(0, len(order), TOGETHER):
        rows = order[at : at + TOGETHER]
        lengths = np.array([len(values[i]) for i in rows])
        x = np.zeros((len(rows), lengths.max(), d))
        for r, i in enumerate(rows):
            x[r, : lengths[r]] = values[i]
        yield rows, windows[rows], lengths, x


def _counts(stays: list[tuple[int, int, int]], x: np.ndarray, config: Config) -> list[np.ndarray]:
    """Starts, moves, occupancy, sums, squares and ended durations of one sequence's stays."""
    k, d = config.n_states, x.shape[1]
    start, move, n, sx, sxx, stay = np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), np.zeros((k, config.max_stay))
    start[stays[0][0]] = 1
    for i, (s, a, b) in enumerate(stays):
        n[s] += b - a
        sx[s] += x[a:b].sum(0)
        sxx[s] += (x[a:b] ** 2).sum(0)
        if i + 1 < len(stays):
            stay[s, min(b - a, config.max_stay) - 1] += 1
            if stays[i + 1][0] != s:
                move[s, stays[i + 1][0]] += 1
    return [start, move.ravel(), n, sx.ravel(), sxx.ravel(), stay.ravel()]


def _statistics(models: Models, m: np.ndarray, lengths: np.ndarray, x: np.ndarray, cluster: bool) -> np.ndarray:
    """Sufficient statistics of sequences under the models m, a row each."""
    config, live = models.config, (np.arange(x.shape[1]) < lengths[:, None])
    out = []
    if cluster:
        far = ((x[:, :, None, :] - models.mean[m][:, None]) ** 2).sum(3)
        near, cost = far.argmin(2), (far.min(2) * live).sum(1)
        for i, n in enumerate(lengths):
            out.append(np.concatenate([[-cost[i]], *_counts(recursions.runs_of(near[i, :n]), x[i, :n], config)]))
    elif config.kind == "stays":
        best, age, source = models.tables(m, x)
        for i, n in enumerate(lengths):
            path = recursions.path_of(best[i], age[i], source[i], n)
            out.append(np.concatenate([[best[i, n].max()], *_counts(path, x[i, :n], config)]))
    else:
        gamma, moves, score = recursions.expected(models.dens(m, x), lengths, models.start[m], models.move[m])
        gx, gxx = np.matmul(gamma.transpose(0, 2, 1), x), np.matmul(gamma.transpose(0, 2, 1), x**2)
        none = np.zeros((len(m), config.n_states * config.max_stay))
        return np.concatenate([score[:, None], gamma[:, 0], moves.reshape(len(m), -1), gamma.sum(1), gx.reshape(len(m), -1), gxx.reshape(len(m), -1), none], 1)
    return np.array(out)


def _summed(seqs: DataFrame, models: Models, d: int, cluster: bool) -> np.ndarray:
    """Statistics summed per model: one narrow pass over the sequences and an aggregation of a row a task and model."""
    of = {w: np.flatnonzero(models.window == w) for w in np.unique(models.window)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, windows, lengths, x in _batches(batch, d, True):
                which = [(i, m) for i, w in enumerate(windows) for m in of.get(w, ())]
                for at in range(0, len(which), TOGETHER):
                    i, m = map(np.array, zip(*which[at : at + TOGETHER]))
                    for model, row in zip(m.tolist(), _statistics(models, m, lengths[i], x[i], cluster)):
                        sums[model] = sums[model] + row if model in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["model", "s"])

    parts = seqs.select("window", "n_train", "x").mapInArrow(run, "model int, s array<double>")
    rows = parts.select("model", F.posexplode("s").alias("i", "v")).groupBy("model", "i").agg(F.sum("v").alias("v")).toPandas()
    k = models.config.n_states
    out = np.zeros((len(models.window), 1 + k + k * k + k + 2 * k * d + k * models.config.max_stay))
    out[rows["model"].to_numpy(), rows["i"].to_numpy()] = rows["v"].to_numpy()
    return out


def _updated(models: Models, sums: np.ndarray, d: int, counted: bool) -> Models:
    """Models with the parameters that statistics give; counted: by counts of paths, with smoothing."""
    config, k, n = models.config, models.config.n_states, len(sums)
    _, start, move, total, sx, sxx, stay = np.split(sums, np.cumsum([1, k, k * k, k, k * d, k * d]), axis=1)
    total, sx, sxx, move = total[:, :, None], sx.reshape(n, k, d), sxx.reshape(n, k, d), move.reshape(n, k, k)
    seen = total > 1e-9
    mean = np.where(seen, sx / np.maximum(total, 1e-9), models.mean)
    var = np.where(seen, np.maximum(sxx / np.maximum(total, 1e-9) - mean**2, config.floor), models.var)
    if counted:
        start, move, stay = start + config.smoothing, move + config.smoothing, stay.reshape(n, k, -1) + config.smoothing
        move[:, np.arange(k), np.arange(k)] = 0.0
    else:
        start, move, stay = np.maximum(start, 1e-12), move + 1e-6, models.stay
    unit = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1e-300)
    return replace(models, mean=mean, var=var, start=unit(start), move=unit(move), stay=unit(stay))


def _first_centres(seqs: DataFrame, d: int, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """(windows, centres): for each window and start, n_states training rows drawn by hash of window, entity and date."""
    train = seqs.select("window", "entity", F.posexplode(F.slice("dates", 1, F.col("n_train"))).alias("i", "date"), "x")
    rows = train.select("window", "entity", "date", F.slice("x", c("i") * d + 1, d).alias("v"))
    drawn = rows.withColumn("h", F.xxhash64("window", "entity", "date"))
    few = drawn.withColumn("part", F.pmod("h", F.lit(64)))  # a window's rows meet in one task only after most are gone
    need = config.n_states * config.starts
    for by in (["window", "part"], ["window"]):
        few = few.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "entity", "date"))).where(c("r") <= need)
    got = few.select("window", "r", "v").toPandas()
    windows, centres = [], []
    for w, own in got.sort_values(["window", "r"]).groupby("window"):
        values = np.array(own["v"].tolist())
        for s in range(config.starts):
            windows.append(w)
            centres.append(values[(np.arange(config.n_states) + s * config.n_states) % len(values)])
    return np.array(windows, int), np.array(centres).reshape(-1, config.n_states, d)


def fit(seqs: DataFrame, d: int, config: Config, first: Models | None = None) -> Models:
    """The best model of each window of seqs (sorted by window), trained from config.starts clusterings, or from first."""
    k = config.n_states
    if first is None:
        windows, centres = _first_centres(seqs, d, config)
        n = len(windows)
        models = Models(config, windows, centres, np.ones((n, k, d)), np.full((n, k), 1 / k), np.full((n, k, k), 1 / k), np.full((n, k, config.max_stay), 1 / config.max_stay), np.full(n, -np.inf), [[] for _ in range(n)])
        models = _rounds(seqs, models, d, True)
        if config.kind == "mixture":
            models.start[:] = 1 / k
            models.move[:] = 0.1 / max(1, k - 1)
            models.move[:, np.arange(k), np.arange(k)] = 0.9 if k > 1 else 1.0
        models.score[:] = -np.inf
        models.trace = [[] for _ in models.trace]
    else:
        models = first
    models = _rounds(seqs, models, d, False)
    best = {w: models.score[models.window == w].max() for w in np.unique(models.window)}
    near = [models.score[i] >= best[w] - 1e-6 * max(1.0, abs(best[w])) for i, w in enumerate(models.window)]
    first_of = {w: i for i, w in reversed(list(enumerate(models.window))) if near[i]}
    return _in_order(models.take(np.array([first_of[w] for w in sorted(first_of)], int)))


def _in_order(models: Models) -> Models:
    """Models with their states in the order of their means, so that states have the same numbers whatever start won."""
    for i in range(len(models.window)):
        order = np.lexsort(models.mean[i].T[::-1])
        for name in ("mean", "var", "start", "stay"):
            getattr(models, name)[i] = getattr(models, name)[i][order]
        models.move[i] = models.move[i][order][:, order]
    return models


def _rounds(seqs: DataFrame, models: Models, d: int, cluster: bool) -> Models:
    config, open_ = models.config, np.arange(len(models.window))
    for _ in range(config.cluster_rounds if cluster else config.rounds):
        if not len(open_):
            break
        now = models.take(open_)
        sums = _summed(seqs, now, d, cluster)
        new = _updated(now, sums, d, cluster or config.kind == "stays")
        for name in ("mean", "var", "start", "move", "stay"):
            getattr(models, name)[open_] = getattr(new, name)
        gain, before = sums[:, 0] - models.score[open_], models.score[open_]
        models.score[open_] = sums[:, 0]
        for i, s in zip(open_, sums[:, 0]):
            models.trace[i].append(float(s))
        if cluster:
            ended = gain <= 0
        elif config.kind == "stays":
            ended = np.abs(gain) < config.rel_tol * np.maximum(np.abs(np.where(np.isfinite(before), before, 1.0)), 1.0)
        else:
            ended = gain < config.tol
        open_ = open_[~ended]
    return models


def _decode(seqs: DataFrame, models: Models, d: int, each, schema: str, names: list[str]) -> DataFrame:
    """(window, entity, trade_date, in_train, ...) of every row of the sequences whose window has a model."""
    row_of = {int(w): i for i, w in enumerate(models.window)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array([w in row_of for w in batch.column("window").to_pylist()], pa.bool_()))
            for rows, windows, lengths, x in _batches(batch, d, False):
                got = each(np.array([row_of[w] for w in windows]), lengths, x)
                own = batch.take(pa.array(rows))
                at = np.repeat(np.arange(len(rows)), lengths)
                step = np.concatenate([np.arange(n) for n in lengths])
                train = step < own.column("n_train").to_numpy()[at]
                dates = pa.concat_arrays([v.values for v in own.column("dates")])
                columns = [own.column("window").take(pa.array(at)), own.column("entity").take(pa.array(at)), dates, pa.array(train), *got]
                yield pa.RecordBatch.from_arrays(columns, names=["window", "entity", "trade_date", "in_train", *names])

    return seqs.mapInArrow(run, f"window int, entity string, trade_date date, in_train boolean, {schema}")


def _flat(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(np.concatenate([v[:n] for v, n in zip(values, lengths)]), kind)


def filtered(seqs: DataFrame, models: Models, d: int) -> DataFrame:
    """Each row's state and the probability p of each state, given what was seen so far (mixtures)."""

    def each(m: np.ndarray, lengths: np.ndarray, x: np.ndarray) -> list[pa.Array]:
        alpha, _ = recursions.forward(models.dens(m, x), lengths, models.start[m], models.move[m])
        p = np.concatenate([a[:n] for a, n in zip(alpha, lengths)])
        return [pa.array(p.argmax(1), pa.int32()), pa.array(list(p), pa.list_(pa.float64()))]

    return _decode(seqs, models, d, each, "state int, p array<double>", ["state", "p"])


def decoded(seqs: DataFrame, models: Models, d: int) -> DataFrame:
    """Each row's state, stay (from 1), age in its stay and its sequence's score on the best path over the whole sequence."""

    def each(m: np.ndarray, lengths: np.ndarray, x: np.ndarray) -> list[pa.Array]:
        best, age, source = models.tables(m, x)
        paths = [recursions.path_of(b, a, s, n) for b, a, s, n in zip(best, age, source, lengths)]
        of = lambda f: np.concatenate([np.concatenate([f(i, st, b - a) for i, (st, a, b) in enumerate(p)]) for p in paths])
        states, segments = of(lambda i, s, n: np.full(n, s)), of(lambda i, s, n: np.full(n, i + 1))
        scores = np.repeat([b[n].max() for b, n in zip(best, lengths)], lengths)
        return [pa.array(states, pa.int32()), pa.array(segments, pa.int64()), pa.array(of(lambda i, s, n: np.arange(1, n + 1)), pa.int32()), pa.array(scores)]

    return _decode(seqs, models, d, each, "state int, segment bigint, age int, score double", ["state", "segment", "age", "score"])


def endpoints(seqs: DataFrame, models: Models, d: int) -> DataFrame:
    """Each row's state and age as the end of the best path over the rows until then: later rows can't change it."""

    def each(m: np.ndarray, lengths: np.ndarray, x: np.ndarray) -> list[pa.Array]:
        best, age, _ = models.tables(m, x)
        state = best[:, 1:].argmax(2)
        ages = np.take_along_axis(age[:, 1:], state[:, :, None], 2)[:, :, 0]
        return [_flat(state, lengths, pa.int32()), _flat(ages, lengths, pa.int32())]

    return _decode(seqs, models, d, each, "state int, age int", ["state", "age"])


def parameters(seqs: DataFrame, models: Models) -> DataFrame:
    """(window, state, mean, move, stay): the models as rows."""
    rows = [(int(w), s, models.mean[i, s].tolist(), models.move[i, s].tolist(), models.stay[i, s].tolist()) for i, w in enumerate(models.window) for s in range(models.config.n_states)]
    return seqs.sparkSession.createDataFrame(rows, "window int, state int, mean array<double>, move array<double>, stay array<double>")


# what states mean


def trend_labels(rows: DataFrame, trend: Column, risk: Column, by: str = "window") -> DataFrame:
    """(window, state, label) of rows (window, state, ...): TrendUp for the highest trend, RiskOff for the highest risk.

    trend and risk are aggregates of a state's rows. The trend state is chosen first and isn't RiskOff unless it is the
    only one; all others are Neutral. Ties go to the lower state.
    """
    stats = rows.groupBy(by, "state").agg(F.coalesce(trend, F.lit(0.0)).alias("trend"), F.coalesce(risk, F.lit(0.0)).alias("risk"))
    first = lambda *order: F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1
    marked = stats.withColumn("up", first(F.desc("trend"), "state"))
    marked = marked.withColumn("off", first("up", F.desc("risk"), "state") & ~c("up"))
    return marked.select(by, "state", F.when(c("up"), "TrendUp").when(c("off"), "RiskOff").otherwise("Neutral").alias("label"))


def profile_labels(rows: DataFrame, scores: list[tuple[str, dict[str, float], int]], by: str = "window", otherwise: str = "Neutral") -> DataFrame:
    """(window, state, label) by greedy choice: each label in turn takes the state left over that scores highest.

    scores lists (label, weights of columns, least number of states). A column counts as the z-score, over the states, of
    its mean in each; a name that begins with ``|`` counts the mean's absolute value. Ties go to the lower state.
    """
    used = sorted({x for _, weights, _ in scores for x in weights})
    means = rows.groupBy(by, "state").agg(*(F.avg(x.removeprefix("|")).alias(x) for x in used))
    over = Window.partitionBy(by)
    value = lambda x: F.abs(c(f"`{x}`")) if x[0] == "|" else c(f"`{x}`")
    z = lambda x: F.coalesce(ratio(value(x) - F.avg(value(x)).over(over), F.stddev_pop(value(x)).over(over)), F.lit(0.0))
    total = [sum((w * z(x) for x, w in weights.items()), F.lit(0.0)).alias(f"s{i}") for i, (_, weights, _) in enumerate(scores)]
    got = means.select(by, "state", F.count(F.lit(1)).over(over).alias("n"), *total, F.lit(None).cast("string").alias("label"))
    for i, (label, _, least) in enumerate(scores):
        best = F.row_number().over(over.orderBy(c("label").isNotNull(), F.desc(f"s{i}"), "state")) == 1
        got = got.withColumn("label", F.when(c("label").isNull() & best & (c("n") >= least), label).otherwise(c("label")))
    return got.select(by, "state", F.coalesce("label", F.lit(otherwise)).alias("label"))


def lifecycle(ages: DataFrame, stays: DataFrame, on: list[str], horizons: list[int]) -> DataFrame:
    """ages (on..., age) with what stays (on..., stay: chances of 1, 2, ... rows) say of a stay of that age.

    duration_percentile: chance of at most age rows (1 from the longest on, 0 at age 0); p_exit_h: chance to end before
    h more rows, given that it lasts age rows at least (null at age 0 and from the longest on); expected_rest: rows still
    to come on average (0 from the longest on); phase and tail_status by percentile and age. A missing stay gives nulls.
    """
    known = ages.join(stays.select(*on, "stay"), on, "left")
    n, age = F.size("stay"), c("age")
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    left = add(F.slice("stay", F.greatest(age, F.lit(1)), n))
    ended = F.when(age <= 0, 0.0).when(age >= n, 1.0).otherwise(add(F.slice("stay", 1, F.greatest(age, F.lit(0)))))
    inside = (age > 0) & (age < n) & (left > 1e-12)
    rest = F.aggregate(F.transform(F.slice("stay", F.greatest(age, F.lit(1)), n), lambda v, i: v * F.greatest(i + F.greatest(age, F.lit(1)) - age, F.lit(0))), F.lit(0.0), lambda s, v: s + v)
    out = known.select(
        *ages.columns, F.when(c("stay").isNotNull(), ended).alias("duration_percentile"),
        *(F.when(inside, F.least(ratio(add(F.slice("stay", age, h)), left), F.lit(1.0))).alias(f"p_exit_{h}") for h in horizons),
        F.when((age < n) & (left > 1e-12), ratio(rest, left)).when(c("stay").isNotNull(), 0.0).alias("expected_rest"),
        F.when(age <= 0, "unavailable").when(age >= n, "beyond_duration_support").when(c("stay").isNotNull(), "within_duration_support").alias("tail_status"),
    )
    p = c("duration_percentile")
    return out.withColumn("phase", F.when(p.isNull(), "unknown").when(p < 0.33, "early").when(p < 0.67, "mature").otherwise("late"))


def empirical_stays(ended: DataFrame, labels: DataFrame, max_stay: int, smoothing: float = 1.0) -> DataFrame:
    """(label, stay array) from the ages of ended stays (label, age), for each label in labels; longer stays count as max_stay."""
    counts = ended.groupBy("label", F.least("age", F.lit(max_stay)).alias("d")).agg(F.count(F.lit(1)).alias("k"))
    every = labels.select("label").distinct().select("label", F.explode(F.sequence(F.lit(1), F.lit(max_stay))).alias("d"))
    known = every.join(counts, ["label", "d"], "left").withColumn("k", F.coalesce("k", F.lit(0)) + smoothing)
    share = F.struct("d", (c("k") / F.sum("k").over(Window.partitionBy("label"))).alias("v"))
    return known.select("label", share.alias("s")).groupBy("label").agg(F.sort_array(F.collect_list("s")).alias("s")).select("label", c("s.v").alias("stay"))


# walk forward


def training_windows(panel: DataFrame, signals: DataFrame, period: Column, window: int, least_rows: int, least_sequence: int) -> DataFrame:
    """(window, train_start, train_end, first_signal, last_signal) for signals (signal_date): a model for each period.

    period is a function of signal_date. Each period's model is trained at its first signal date that has history enough:
    the last window dates, of entities with least_sequence rows there, least_rows together. It serves the signal dates
    from then until the next model is trained.
    """
    calendar = Window.orderBy("trade_date")  # windows over the calendar see one row a date
    days = panel.select("trade_date").distinct().withColumn("day", F.row_number().over(calendar))
    wanted = signals.select(c("signal_date").alias("trade_date"), F.lit(True).alias("asked")).distinct()
    both = days.join(wanted, "trade_date", "full").withColumn("day", F.max("day").over(calendar))  # the day number as of a signal
    asked = both.where("asked and day is not null").select(c("trade_date").alias("signal_date"), "day")
    # an entity's running count of rows as of a day holds until its next row
    over = Window.partitionBy("entity").orderBy("day")
    dated = panel.select("entity", "trade_date").join(days, "trade_date").select("entity", "day", F.row_number().over(over).alias("so_far"), F.lead("day").over(over).alias("next"))
    until = days.agg(F.max("day").alias("until"))
    held = dated.crossJoin(until).select("entity", "so_far", F.explode(F.sequence("day", F.coalesce(c("next") - 1, c("until")))).alias("day"))
    marks = asked.select("day").unionByName(asked.select((c("day") - window).alias("day"))).distinct()
    counts = held.join(marks, "day", "left_semi")
    gone = counts.select((c("day") + window).alias("day"), "entity", c("so_far").alias("gone"))
    own = counts.join(gone, ["day", "entity"], "left").select("day", (c("so_far") - F.coalesce("gone", F.lit(0))).alias("rows"))
    size = own.groupBy("day").agg(F.coalesce(F.sum(F.when(c("rows") >= least_sequence, c("rows"))), F.lit(0)).alias("rows")).where(c("rows") >= least_rows)
    able = asked.join(size, "day")
    first = able.groupBy(period.alias("period")).agg(F.min("signal_date").alias("signal_date"), F.min("day").alias("day"))
    trained = first.select("signal_date", "day", F.row_number().over(Window.orderBy("signal_date")).alias("window"))
    in_turn = Window.orderBy("signal_date")
    served = asked.select("signal_date").join(trained.select("signal_date", "window"), "signal_date", "left").withColumn("window", F.max("window").over(in_turn))
    last = served.where("window is not null").groupBy("window").agg(F.max("signal_date").alias("last_signal"))
    bounds = trained.join(last, "window").join(days.withColumnRenamed("trade_date", "train_end"), "day").withColumn("from", F.greatest(c("day") - (window - 1), F.lit(1)))
    bounds = bounds.join(days.select(c("day").alias("from"), c("trade_date").alias("train_start")), "from")
    return bounds.select("window", "train_start", "train_end", c("signal_date").alias("first_signal"), "last_signal")


def window_rows(panel: DataFrame, windows: DataFrame, least_sequence: int) -> DataFrame:
    """panel's rows in each window, from train_start to last_signal, with in_train; of entities with enough rows to train.

    windows is broadcast: a period of the calendar has one row at most.
    """
    at = F.expr("trade_date between train_start and last_signal")
    rows = panel.join(F.broadcast(windows), at).withColumn("in_train", c("trade_date") <= c("train_end"))
    n = F.count(F.when(c("in_train"), True)).over(Window.partitionBy("window", "entity"))
    return rows.withColumn("_n", n).where(c("_n") >= least_sequence).drop("_n")


def clipped(rows: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, by: str = "window") -> DataFrame:
    """Columns clipped to the quantiles of a window's training rows (range, if ten or fewer), then standardised by them."""
    train = rows.where("in_train")
    q = quantiles(train, columns, [low, high], [by])
    n = train.groupBy(by).agg(*(F.struct(F.count(x).alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).alias(f"_r_{x}") for x in columns))
    bounds = n.join(q, by).select(by, *(F.struct(F.when(c(f"_r_{x}.n") > 10, c(x)[0]).otherwise(c(f"_r_{x}.a")).alias("a"), F.when(c(f"_r_{x}.n") > 10, c(x)[1]).otherwise(c(f"_r_{x}.b")).alias("b")).alias(f"_q_{x}") for x in columns))
    inside = {f"_c_{x}": F.when(c(x).isNotNull(), F.greatest(F.least(c(x), c(f"_q_{x}.b")), c(f"_q_{x}.a"))) for x in columns}
    done = standardised(rows.join(bounds, by).withColumns(inside), list(inside), by)
    return done.select(*rows.columns, *(c(f"z__c_{x}").alias(f"z_{x}") for x in columns))


def standardised(rows: DataFrame, columns: list[str], by: str = "window") -> DataFrame:
    """rows with z_<column>, by the mean and deviation of a window's training rows."""
    scale = rows.where("in_train").groupBy(by).agg(*(F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(f"_s_{x}") for x in columns))
    z = {f"z_{x}": (c(x) - c(f"_s_{x}.m")) / F.when(c(f"_s_{x}.s") > 0, c(f"_s_{x}.s")).otherwise(1.0) for x in columns}
    return rows.join(scale, by).withColumns(z).drop(*(f"_s_{x}" for x in columns))


def _read_once(panel: DataFrame, columns: list[str], signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """panel's rows that have all columns, and the distinct signal dates, both written: what they come from is read once."""
    known = panel.where(" and ".join(f"{x} is not null" for x in columns))
    return materialize(known, "known"), materialize(signals.select("signal_date").distinct(), "signals")


def walk_forward(panel: DataFrame, columns: list[str], signals: DataFrame, period: Column, config: Config, trend: Column, risk: Column, window: int = 504, least_rows: int = 120, least_sequence: int = 30) -> DataFrame:
    """States of each entity at each signal date, by models that were trained on earlier dates only.

    (entity, trade_date, state, label, prob_trend_up, prob_neutral, prob_risk_off, next_trend_up, next_neutral, next_risk_off,
    train_start, train_end). Probabilities are filtered, summed by label; the next ones are p times the transitions.
    Nothing after a signal date reaches its rows.
    """
    known, signals = _read_once(panel, columns, signals)
    windows = materialize(training_windows(known, signals, period, window, max(least_rows, config.n_states * 30), least_sequence), "windows")
    rows = materialize(clipped(window_rows(known, windows, least_sequence), columns), "rows")
    z = [f"z_{x}" for x in columns]
    seqs = sequences(rows, z, train=c("in_train"))
    models = fit(seqs, len(columns), config)
    states = materialize(filtered(seqs, models, len(columns)), "states")
    raw = rows.drop(*z, "in_train")
    labels = trend_labels(states.where("in_train").join(raw, ["window", "entity", "trade_date"]), trend, risk)
    named = labels.groupBy("window").agg(F.map_from_entries(F.collect_list(F.struct("state", "label"))).alias("names"))
    moves = parameters(seqs, models).groupBy("window").agg(F.map_from_entries(F.collect_list(F.struct("state", "move"))).alias("moves"))
    asked = states.join(windows, "window").join(signals.select(c("signal_date").alias("trade_date")).distinct(), "trade_date").where("trade_date >= first_signal and trade_date <= last_signal")
    full = asked.join(named, "window").join(moves, "window")
    own = F.transform("p", lambda v, i: F.struct(v.alias("v"), F.coalesce(c("names")[i.cast("int")], F.lit("Neutral")).alias("label")))
    nxt = F.transform("p", lambda _, j: F.struct(F.aggregate(F.transform("p", lambda v, i: v * c("moves")[i.cast("int")][j]), F.lit(0.0), lambda s, v: s + v).alias("v"), F.coalesce(c("names")[j.cast("int")], F.lit("Neutral")).alias("label")))
    share = lambda what, label: F.aggregate(F.filter(what, lambda s: s["label"] == label), F.lit(0.0), lambda s, v: s + v["v"])
    kinds = [("trend_up", "TrendUp"), ("neutral", "Neutral"), ("risk_off", "RiskOff")]
    out = full.withColumn("_own", own).withColumn("_next", nxt)
    got = out.select("entity", "trade_date", "state", F.coalesce(c("names")[c("state")], F.lit("Neutral")).alias("label"), *(share("_own", v).alias(f"prob_{x}") for x, v in kinds), *(share("_next", v).alias(f"next_{x}") for x, v in kinds), "train_start", "train_end")
    done = materialize(got, "walked")
    release(known, signals, windows, rows, seqs, states)
    return done


def walk_forward_stays(panel: DataFrame, columns: list[str], signals: DataFrame, period: Column, config: Config, scores: list[tuple[str, dict[str, float], int]], horizons: list[int], window: int = 504, least_sequences: int = 3, least_sequence: int = 30) -> DataFrame:
    """Lifecycle of each entity's state at each signal date, by the model of stays of the latest checkpoint.

    A period's checkpoint is its first signal date with history enough. A row is the end of the best path over the rows
    until then; label_age counts an entity's signal rows with the same label in a row, over checkpoints too.
    """
    known, signals = _read_once(panel, columns, signals)
    windows = materialize(training_windows(known, signals, period, window, least_sequences * least_sequence, least_sequence), "windows")
    rows = every = materialize(window_rows(known, windows, least_sequence), "rows")
    enough = rows.where("in_train").groupBy("window").agg(F.count_distinct("entity").alias("k")).where(c("k") >= least_sequences).select("window")
    rows = materialize(standardised(rows.join(enough, "window"), columns), "rows")
    z = [f"z_{x}" for x in columns]
    seqs = sequences(rows, z, train=c("in_train"))
    models = fit(seqs, len(columns), config)
    paths = decoded(seqs.withColumn("x", F.slice("x", 1, c("n_train") * len(columns))).withColumn("dates", F.slice("dates", 1, c("n_train"))), models, len(columns))
    labels = profile_labels(paths.join(rows.drop(*z, "in_train"), ["window", "entity", "trade_date"]), scores)
    stays = parameters(seqs, models)
    ends = endpoints(seqs, models, len(columns)).join(windows, "window").where("trade_date >= first_signal and trade_date <= last_signal")
    asked = ends.join(signals.select(c("signal_date").alias("trade_date")).distinct(), "trade_date").select("window", "entity", "trade_date", "train_end", "state", "age")
    likely = stays.select("window", "state", (F.array_position("move", F.array_max("move")) - 1).cast("int").alias("next_state"), F.array_max("move").alias("next_probability"))
    full = lifecycle(asked, stays, ["window", "state"], horizons).join(labels, ["window", "state"]).join(likely, ["window", "state"])
    full = full.join(labels.select("window", c("state").alias("next_state"), c("label").alias("next_label")), ["window", "next_state"], "left")
    over = Window.partitionBy("entity").orderBy("trade_date")
    run = full.withColumn("_new", (~c("label").eqNullSafe(F.lag("label").over(over))).cast("int")).withColumn("_run", F.sum("_new").over(over))
    aged = run.withColumn("label_age", F.row_number().over(Window.partitionBy("entity", "_run").orderBy("trade_date"))).drop("_new", "_run", "window")
    done = materialize(aged, "walked")
    release(known, signals, windows, every, rows, seqs)
    return done


def episodes(states: DataFrame) -> DataFrame:
    """Runs of one state in walk-forward rows (entity, trade_date, state, label, train_end), with what bounds them.

    The first of an entity is cut off on the left, the last is open and cut off on the right.
    """
    over = Window.partitionBy("entity").orderBy("trade_date")
    run = states.withColumn("_new", (~c("state").eqNullSafe(F.lag("state").over(over))).cast("int")).withColumn("episode", F.sum("_new").over(over))
    got = run.groupBy("entity", "episode").agg(
        F.first("state").alias("state"), F.min_by("label", "trade_date").alias("label"), F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count(F.lit(1)).alias("n_days"),
        F.min_by("train_end", "trade_date").alias("checkpoint_start"), F.max_by("train_end", "trade_date").alias("checkpoint_end"),
    )
    nxt = Window.partitionBy("entity").orderBy("episode")
    return got.select(
        "*", (F.date_diff("end_date", "start_date") + 1).cast("bigint").alias("calendar_days"), F.lead("start_date").over(nxt).alias("exit_date"), F.lead("state").over(nxt).alias("next_state"), F.lead("label").over(nxt).alias("next_label"),
        (F.row_number().over(nxt) == 1).alias("left_censored"), F.lead("start_date").over(nxt).isNull().alias("right_censored"),
    )
