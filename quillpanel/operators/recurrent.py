"""A long short-term memory network on each symbol's last rows, trained by synchronous Adam steps for several training sets (folds) at once.

Rows are packed once into chunks by a hash of symbol and date; every step reads the chunks of one batch in one stage, and every chunk's gradient is turned into whole numbers of a
fixed unit before it is added up. Sums have no order then: the weights are the same in 1 and in 32 partitions. Weights and Adam's moments live at the driver, in doubles; rows pass
through the network in single precision, as the reference's do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillpanel.sources.market import Scratch

#: Gradients are whole multiples of this; a chunk's are clipped at 2^16, so 2^21 chunks a batch add up within 63 bits.
FINE = 2.0**-24


@dataclass(frozen=True)
class Settings:
    """batches: Adam steps in an epoch; the reference batch of 256 rows would be a step for each 256 rows of the table, which no cluster can synchronise."""

    length: int = 10
    hidden: int = 32
    epochs: int = 20
    batches: int = 8
    rate: float = 0.01
    chunk: int = 512
    seed: int = 42


def _logistic(negative: np.ndarray) -> None:
    """1 / (1 + exp(z)) in place of z, which is the argument with its sign turned."""
    np.exp(np.minimum(negative, 80, out=negative), out=negative)
    negative += 1
    np.reciprocal(negative, out=negative)


@dataclass
class Network:
    """Weights as one vector: gates (inputs and state to four gates), their biases, the output's weights and its bias. scale: of inputs (mean, spread) and target."""

    flat: np.ndarray
    features: list[str]
    hidden: int
    mean: np.ndarray
    spread: np.ndarray
    base: float
    unit: float

    @classmethod
    def start(cls, features: list[str], hidden: int, seed: int, mean, spread, base: float, unit: float) -> Network:
        n, rng = len(features), np.random.default_rng(seed)
        bound = 1 / np.sqrt(hidden)
        parts = rng.uniform(-bound, bound, (n + hidden, 4 * hidden)).ravel(), rng.uniform(-bound, bound, 4 * hidden), rng.uniform(-bound, bound, hidden), np.zeros(1)
        return cls(np.concatenate(parts), features, hidden, np.asarray(mean, float), np.asarray(spread, float), base, unit)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h, n = self.hidden, len(self.features)
        a, b = (n + h) * 4 * h, (n + h + 1) * 4 * h
        return self.flat[:a].reshape(n + h, 4 * h), self.flat[a:b], self.flat[b : b + h], self.flat[b + h :]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num((x - self.mean) / self.spread)

    def run(self, x: np.ndarray, keep: bool = True) -> tuple[np.ndarray, np.ndarray, tuple]:
        """x: rows, steps, features (scaled). Outputs, last states, and (keep) what the way back needs.

        Inputs meet their weights in one product for all steps. All gates take one logistic function: tanh(z) is twice that of 2z, less 1, and signs and twos are put into the weights.
        """
        gates, bias, out, shift = (v.astype(x.dtype) for v in self.parts())
        h, (n, steps, width) = self.hidden, x.shape
        turned = np.repeat(np.array([-1, -2], x.dtype), [3 * h, h])
        own = gates[width:] * turned
        a = (np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(-1, width) @ (gates[:width] * turned) + bias * turned).reshape(steps, n, 4 * h)
        count = steps if keep else 1
        states, memories, bends = (np.zeros((k, n, h), x.dtype) for k in (count + 1, count + 1, count))
        product = np.empty((n, h), x.dtype)
        for t in range(steps):
            k, after = (t, t + 1) if keep else (0, 0)
            g = a[t]
            if t:
                g += states[k] @ own
            _logistic(g)
            tanh = g[:, 3 * h :]
            tanh *= 2
            tanh -= 1
            np.multiply(g[:, h : 2 * h], memories[k], out=memories[after])
            np.multiply(g[:, :h], g[:, 3 * h :], out=product)
            memories[after] += product
            np.multiply(memories[after], -2, out=bends[k])
            _logistic(bends[k])
            bends[k] *= 2
            bends[k] -= 1
            np.multiply(g[:, 2 * h : 3 * h], bends[k], out=states[after])
        last = states[steps if keep else 0]
        return last @ out + shift[0], last, (a, states, memories, bends)

    def slope(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient of the rows' summed squared errors (halved), as one vector; y is scaled."""
        gates, _, out, _ = (v.astype(x.dtype) for v in self.parts())
        made, state, (a, states, memories, bends) = self.run(x)
        h, (n, steps, width) = self.hidden, x.shape
        err = (made - y)[:, None]
        back = gates[width:].T.copy()
        ds, dm, held = err * out, np.zeros_like(state), np.empty_like(state)
        da = np.empty((steps, n, 4 * h), x.dtype)
        for t in reversed(range(steps)):
            i, f, o, g = (a[t, :, k * h : (k + 1) * h] for k in range(4))
            di, df, do, dg = (da[t, :, k * h : (k + 1) * h] for k in range(4))
            np.multiply(bends[t], bends[t], out=held)
            np.subtract(1, held, out=held)
            held *= o
            held *= ds
            dm += held
            np.multiply(dm, g, out=di)
            np.multiply(dm, memories[t], out=df)
            np.multiply(ds, bends[t], out=do)
            np.multiply(dm, i, out=dg)
            logistic = a[t, :, : 3 * h]
            da[t, :, : 3 * h] *= logistic
            da[t, :, : 3 * h] *= 1 - logistic
            np.multiply(g, g, out=held)
            np.subtract(1, held, out=held)
            dg *= held
            if t:
                ds = da[t] @ back
                dm *= f
        flat = da.reshape(-1, 4 * h)
        inputs = np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(-1, width)
        d_gates = np.concatenate([inputs.T @ flat, states[:-1].reshape(-1, h).T @ flat])
        return np.concatenate([d_gates.ravel(), flat.sum(axis=0), (state * err).sum(axis=0), err.sum(axis=0)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A few thousand rows at a time, so that a run's arrays stay small."""
        made = [self.run(self.scaled(x[k : k + 2048]).astype(np.float32), keep=False)[0] for k in range(0, len(x), 2048)]
        return np.concatenate([np.zeros(0), *made]) * self.unit + self.base


def sequences(rows: DataFrame, features: list[str], length: int, key: tuple[str, ...] = ("fold", "symbol")) -> DataFrame:
    """_q: the last `length` rows of features of each symbol's row, its own included, one after the other; NULL where there are fewer."""
    w = Window.partitionBy(*key).orderBy("date").rowsBetween(-(length - 1), 0)
    q = F.collect_list(F.array(*(F.col(f"`{c}`").cast("double") for c in features))).over(w)
    return rows.withColumn("_q", F.when(F.size(q) == length, F.flatten(q)))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """All numbers of a column of lists, NaN where missing."""
    column = column.combine_chunks()
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def pack(known: DataFrame, nets: dict[int, Network], chunks: int, s: Settings, scratch: Scratch) -> DataFrame:
    """batch, fold, chunk, n, x (scaled, rows by steps by features) and y (scaled) as bytes of single floats, rows in order of date and symbol; known has fold, date, symbol, _q and _y. A batch has a folder: a step reads its own rows only."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("date", "ascending"), ("symbol", "ascending")])
        net = nets[part.column("fold")[0].as_py()]
        x = net.scaled(_flat(part.column("_q")).reshape(len(part), -1, len(net.features))).astype(np.float32)
        y = ((part.column("_y").to_numpy(zero_copy_only=False) - net.base) / net.unit).astype(np.float32)
        return pa.table({"fold": part.column("fold").slice(0, 1), "chunk": part.column("chunk").slice(0, 1), "n": pa.array([len(part)], pa.int64()), "x": [x.tobytes()], "y": [y.tobytes()]})

    rows = known.withColumn("chunk", F.pmod(F.xxhash64("symbol", "date", F.lit(s.seed)), F.lit(chunks)).cast("int")).select(F.col("fold").cast("int").alias("fold"), "chunk", "date", "symbol", "_q", "_y")
    parts = 2 * known.sparkSession.sparkContext.defaultParallelism  # so that no few tasks make, or read, all chunks
    made = rows.repartition(parts, "fold", "chunk").groupBy("fold", "chunk").applyInArrow(run, "fold int, chunk int, n long, x binary, y binary")
    return scratch.saved(made.withColumn("batch", F.col("chunk") % s.batches), "recurrent-packed", "batch")


def fit(train: DataFrame, features: dict[int, list[str]], target: str, s: Settings) -> dict[int, Network]:
    """A network for each fold; train has fold, date, symbol, the target and all features. A fold without a full window of rows keeps none."""
    names = list(dict.fromkeys(c for f in features.values() for c in f))
    stats = train.groupBy("fold").agg(*(F.avg(f"`{c}`") for c in [*names, target]), *(F.stddev_samp(f"`{c}`") for c in [*names, target])).collect()
    nets = {}
    for r in stats:
        mean, spread = (np.array([float(v or 0.0) for v in r[a:b]]) for a, b in ((1, len(names) + 2), (len(names) + 2, 2 * len(names) + 3)))
        mean, spread = np.round(mean, 9), np.where(spread > 1e-9, np.round(spread, 9), 1.0)
        own = np.isin(names, features.get(r["fold"], []))
        nets[r["fold"]] = Network.start(names, s.hidden, s.seed, mean[:-1], np.where(own, spread[:-1], np.inf), float(mean[-1]), float(spread[-1]))
    known = sequences(train, names, s.length).where(F.col("_q").isNotNull() & F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("double"))
    place = F.row_number().over(Window.partitionBy("fold", "symbol").orderBy("date"))  # as many rows as known has, without their windows
    counts = {r["fold"]: r["count"] for r in train.select("fold", F.col(target).alias("_y"), place.alias("_i")).where((F.col("_i") >= s.length) & F.col("_y").isNotNull()).groupBy("fold").count().collect()}
    nets = {f: net for f, net in nets.items() if counts.get(f)}
    if not nets:
        return {}
    with Scratch(train.sparkSession) as scratch:
        _train(pack(known, nets, max(s.batches, -(-max(counts.values()) // s.chunk)), s, scratch), nets, s)
    return nets


def _train(packed: DataFrame, nets: dict[int, Network], s: Settings) -> None:
    """Moves the networks' weights through all epochs."""
    size = len(next(iter(nets.values())).flat)
    first, second = ({f: np.zeros(size) for f in nets} for _ in range(2))
    context, step = packed.sparkSession.sparkContext, 0
    for _ in range(s.epochs):
        for batch_number in range(s.batches):
            step += 1
            held = context.broadcast(nets)

            def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sums: dict[int, np.ndarray] = {}
                for batch in batches:
                    fold, n, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("fold", "n", "x", "y"))
                    for k, (f, rows) in enumerate(zip(fold.to_pylist(), n.to_pylist(), strict=True)):
                        net = held.value[f]
                        g = net.slope(np.frombuffer(x[k].as_buffer(), np.float32).reshape(rows, s.length, len(net.features)), np.frombuffer(y[k].as_buffer(), np.float32)).astype(np.float64)
                        g = np.rint(np.clip(g, -(2.0**16), 2.0**16) / FINE).astype(np.int64)
                        sums[f] = sums.get(f, 0) + np.append(g, rows)
                for f, g in sums.items():
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([g.tobytes()], pa.binary())], names=["fold", "g"])

            found: dict[int, np.ndarray] = {}
            for r in packed.where(F.col("batch") == batch_number).mapInArrow(slopes, "fold int, g binary").toArrow().to_pylist():  # a task's sums for each fold
                found[r["fold"]] = found.get(r["fold"], 0) + np.frombuffer(r["g"], np.int64)
            for f, net in nets.items():
                if f in found:
                    total = found[f].astype(np.float64)
                    mean = total[:-1] * FINE / total[-1]
                    first[f] = 0.9 * first[f] + 0.1 * mean
                    second[f] = 0.999 * second[f] + 0.001 * mean * mean
                    net.flat = net.flat - s.rate * (first[f] / (1 - 0.9**step)) / (np.sqrt(second[f] / (1 - 0.999**step)) + 1e-8)
            held.destroy()


def predict(train: DataFrame, test: DataFrame, nets: dict[int, Network], features: dict[int, list[str]], s: Settings) -> DataFrame:
    """test and pred_score. A test row's window may begin in the training rows; where it is too short the fold's middle prediction of training rows stands in, and 0 where nothing was trained.

    One kernel scores a symbol's rows of a fold. Training rows are scored only in folds that have test rows with too short a window.
    """
    names = list(dict.fromkeys(c for f in features.values() for c in f))
    both = train.withColumn("_t", F.lit(0)).unionByName(test.withColumn("_t", F.lit(1)), allowMissingColumns=True)
    per = both.groupBy("fold", "symbol").agg(F.sum("_t").alias("new"), F.sum(1 - F.col("_t")).alias("old")).where((F.col("new") > 0) & (F.col("old") < s.length - 1))
    short = {r["fold"] for r in per.select("fold").distinct().collect()} & nets.keys()
    held = test.sparkSession.sparkContext.broadcast(nets)
    schema = StructType([*both.schema.fields, StructField("pred_score", DoubleType())])

    def run(rows: pa.Table) -> pa.Table:
        rows, f = rows.sort_by("date"), rows.column("fold")[0].as_py()
        new, out = rows.column("_t").to_numpy() == 1, np.full(len(rows), np.nan)
        wanted = np.flatnonzero(new | (f in short))
        full = wanted[wanted >= s.length - 1]
        if f in held.value and len(full):
            x = np.column_stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names])
            out[full] = held.value[f].predict(sliding_window_view(x, s.length, axis=0)[full - (s.length - 1)].transpose(0, 2, 1))
        return rows.append_column("pred_score", pa.array(out, pa.float64(), from_pandas=True)).take(pa.array(wanted))

    scored = both.groupBy("fold", "symbol").applyInArrow(run, schema)
    out = scored.where("_t = 1").withColumn("_middle", F.lit(None).cast("double"))
    if short:
        middle = scored.where("_t = 0").groupBy(F.col("fold").alias("_f")).agg(F.percentile_approx("pred_score", 0.5, 10_000).alias("_middle"))
        out = out.drop("_middle").join(F.broadcast(middle), F.col("fold") == F.col("_f"), "left").drop("_f")
    return out.withColumn("pred_score", F.coalesce("pred_score", "_middle", F.lit(0.0))).drop("_t", "_middle")
