"""Levels of boosted trees over blocks of rows, for models whose nodes fit a broadcast.

A block has some thousand rows of one group: bins as bytes, targets, folds, and the prediction so
far of every run. One level of one tree is one job: tasks add up histograms of (group, run, node), the
shuffle adds those of all tasks, and a reducer chooses the split of its nodes. The driver gets the
splits, a row for each node of the level and never a row of the table, and broadcasts them. Predictions
move on every SAVE trees; until then tasks walk the trees grown since. Tables whose nodes don't fit
(``boosting.boost`` counts them) are grown by joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import stable

BLOCK = 8192  # rows
SAVE = 10  # trees
FLUSH = 32 << 20  # bytes of histograms that a task holds
MIN_GAIN = 1e-12
SPLIT = [("gid", pa.int32()), ("rid", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()),
         ("gain", pa.float64()), ("n", pa.int64()), ("value", pa.float64()), ("left_value", pa.float64()), ("right_value", pa.float64())]


def grouped(rows: DataFrame, by: Sequence[str], runs: Mapping[str, Mapping]) -> DataFrame:
    """Per group: number of rows and, for every run, the mean of its training targets (null if it has none)."""
    own = lambda p: F.lit(True) if p["train_before"] is None else F.coalesce(F.col("__fold") < p["train_before"], F.lit(True))
    means = [F.avg(F.when(own(p), F.col("target"))) for p in runs.values()]
    return stable(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.array(*means).alias("means")))


def blocks_of(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per block: gid, block, and arrays of its rows, targets, folds and bins (row by row)."""
    place = groups.select(*by, "gid", F.ceil(F.col("rows") / BLOCK).alias("blocks"))
    dealt = rows.withColumn("__at", F.monotonically_increasing_id()).join(place, list(by))
    dealt = dealt.groupBy("gid", (F.col("__at") % F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("row", "target", "bins", "__fold")).alias("c"))
    c = lambda n: F.col("c").getField(n)
    return stable(dealt.select("gid", "block", c("row").alias("row"), c("target").alias("target"), c("__fold").alias("fold"), F.flatten(c("bins")).alias("bins")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays as bytes; a missing fold is -1, so that its row is always trained on."""
    kinds = {"target": np.float64, "fold": np.int32, "bins": np.uint8}
    for b in batches:
        cols = [b.column("gid"), b.column("block")]
        for name, kind in kinds.items():
            lists = [v.values.fill_null(-1).to_numpy(zero_copy_only=False).astype(kind).tobytes() for v in b.column(name)]
            cols.append(pa.array(lists, pa.binary()))
        yield pa.RecordBatch.from_arrays(cols, ["gid", "block", *kinds])


def walk(bins: np.ndarray, tree: Mapping[str, np.ndarray], key: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, value) that each row reaches in the tree of ``key``; it stays where nothing splits."""
    node, value = np.zeros(len(bins), np.int64), np.full(len(bins), tree["root"][key])
    every = np.arange(len(bins))
    for _ in range(depth):
        f = tree["feature"][key][node]
        live = f >= 0
        if not live.any():
            break
        right = bins[every, np.maximum(f, 0)] > tree["bin"][key][node]
        value = np.where(live, np.where(right, tree["right"][key][node], tree["left"][key][node]), value)
        node = np.where(live, 2 * node + 1 + right, node)
    return node, value


def _moved(block: tuple, trees: Sequence[Mapping], depth: int) -> tuple:
    gid, at, target, fold, bins, pred = block
    pred = pred.copy()
    for tree in trees:
        for r in range(len(pred)):
            pred[r] += walk(bins, tree, gid * len(pred) + r, depth)[1]
    return gid, at, target, fold, bins, pred


def _histograms(blocks: Iterator[tuple], grown: Sequence[Mapping], tree: Mapping, level: int, live: Sequence[tuple[int, int]], depth: int, width: int) -> Iterator[tuple]:
    """((gid, run, node), sums of residuals and rows by feature and bin), added up as far as FLUSH allows."""
    held: dict[tuple, np.ndarray] = {}
    first, count = 2**level - 1, 2**level
    for block in blocks:
        gid, _, target, fold, bins, pred = _moved(block, grown, depth)
        n_features = bins.shape[1]
        for r, before in live:
            node = walk(bins, tree, gid * len(pred) + r, level)[0] - first
            use = (fold < before) & (node >= 0)
            own, b, res = node[use], bins[use], (target - pred[r])[use]
            if not len(own):
                continue
            cells = ((own[:, None] * n_features + np.arange(n_features)) * width + b).ravel()
            size = count * n_features * width
            sums = np.stack([np.bincount(cells, np.repeat(res, n_features), size), np.bincount(cells, minlength=size)]).reshape(2, count, n_features, width)
            for k in np.unique(own):
                key = (gid, r, int(first + k))
                held[key] = held[key] + sums[:, k] if key in held else sums[:, k].copy()
        if len(held) * 2 * n_features * width * 8 > FLUSH:
            yield from held.items()
            held = {}
    yield from held.items()


def best_split(sums: np.ndarray, l2: float, rate: float, least: float) -> tuple:
    """(feature, bin, gain, n, value, left_value, right_value); the first four of a node that stays whole are (None, None, None, n)."""
    g, n = sums
    gl, nl, gt, nt = g.cumsum(1), n.cumsum(1), g.sum(1, keepdims=True), n.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a, b: a * a / (b + l2)
        gain = part(gl, nl) + part(gt - gl, nt - nl) - part(gt, nt)
        gain = np.where((nl >= least) & (nt - nl >= least) & (gain > MIN_GAIN), gain, -np.inf)
        at = int(gain.argmax())  # the first feature and lowest bin of equal gains
        f, b = divmod(at, g.shape[1])
        whole = (int(nt[0, 0]), float(rate * gt[0, 0] / (nt[0, 0] + l2)))
        if not gain[f, b] > MIN_GAIN:
            return None, None, None, *whole, None, None
        return f, b, float(gain[f, b]), *whole, float(rate * gl[f, b] / (nl[f, b] + l2)), float(rate * (gt[f, 0] - gl[f, b]) / (nt[f, 0] - nl[f, b] + l2))


def grow(rows: DataFrame, groups: DataFrame, n_groups: int, by: Sequence[str], runs: Mapping[str, Mapping], n_features: int, bins: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, trees, fitted) of every run in every group, as ``boosting.boost`` returns them."""
    spark = rows.sparkSession
    sc, names, settings = spark.sparkContext, list(runs), list(runs.values())
    n_runs, depth = len(runs), max(p["depth"] for p in settings)
    groups = stable(groups.withColumn("gid", F.row_number().over(Window.orderBy(*by)) - 1))
    means, taught = np.zeros((n_groups, n_runs)), np.zeros((n_groups, n_runs), bool)
    for x in groups.select("gid", "means").collect():
        means[x["gid"]], taught[x["gid"]] = [v or 0.0 for v in x["means"]], [v is not None for v in x["means"]]
    blocks, start = blocks_of(rows, groups, by), sc.broadcast(means)

    def opened(x) -> tuple:
        target = np.frombuffer(x["target"])
        return x["gid"], x["block"], target, np.frombuffer(x["fold"], np.int32), np.frombuffer(x["bins"], np.uint8).reshape(len(target), n_features), np.repeat(start.value[x["gid"]][:, None], len(target), 1)

    packed = blocks.select("gid", "block", "target", "fold", "bins").mapInArrow(_packed, "gid int, block bigint, target binary, fold binary, bins binary")
    n_blocks = blocks.count()
    parts = max(1, min(sc.defaultParallelism, -(-n_blocks // 4)), -(-n_blocks // 32))
    reducers = min(parts, sc.defaultParallelism)
    state = packed.repartition(parts, "gid", "block").rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    before = [np.inf if p["train_before"] is None else p["train_before"] for p in settings]
    grown, found, tables = [], [], []
    rounds = max(p["rounds"] for p in settings)
    for t in range(rounds):
        shape = (n_groups * n_runs, 2**depth - 1)
        tree = {"feature": np.full(shape, -1, np.int16), "bin": np.zeros(shape, np.int16), "left": np.zeros(shape), "right": np.zeros(shape), "root": np.zeros(shape[0])}
        reach = max((p["depth"] for p in settings if p["rounds"] > t), default=0)
        for level in range(reach):
            live = [(r, before[r]) for r, p in enumerate(settings) if p["rounds"] > t and p["depth"] > level]
            sent = sc.broadcast((grown, tree))
            add = lambda part, sent=sent, level=level, live=live: _histograms(part, *sent.value, level, live, depth, bins + 1)
            choose = lambda x: (*x[0], *best_split(x[1], *(settings[x[0][1]][k] for k in ("l2", "rate", "min_rows"))))
            made = state.mapPartitions(add).reduceByKey(np.add, reducers).map(choose).collect()
            for gid, r, node, f, b, gain, n, value, left, right in made:
                found.append((gid, r, t, node, f, b, gain, n, value, left, right))
                key = gid * n_runs + r
                if node == 0:
                    tree["root"][key] = value
                if f is not None:
                    tree["feature"][key, node], tree["bin"][key, node], tree["left"][key, node], tree["right"][key, node] = f, b, left, right
            sent.unpersist()
            if not made:
                break
        grown = [*grown, tree]
        if len(grown) == SAVE or t == rounds - 1:
            sent, last = sc.broadcast(grown), state
            state = last.map(lambda x, sent=sent: _moved(x, sent.value, depth)).persist(StorageLevel.MEMORY_AND_DISK)
            state.count()
            last.unpersist()
            columns = list(zip(*sorted(found, key=lambda x: x[:4]), strict=True)) or [[] for _ in SPLIT]
            tables.append(stable(spark.createDataFrame(pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, SPLIT, strict=True)], names=[n for n, _ in SPLIT]))))
            grown, found = [], []
    run = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("rid") + 1).alias("run")
    area = groups.select(*by, "gid")
    trees = reduce(DataFrame.unionByName, tables).join(area, "gid").select(*by, run, *[n for n, _ in SPLIT[2:]])
    base = groups.select(*by, F.posexplode("means").alias("rid", "base")).where("base is not null").select(*by, run, "base")

    def fitted(x) -> Iterator[tuple]:
        gid, at, _, fold, _, pred = x
        for r, last in enumerate(before):
            if taught[gid, r]:
                yield gid, at, r, np.where(fold <= last, fold < last, None).tolist(), pred[r].tolist()

    yhat = spark.createDataFrame(state.flatMap(fitted), "gid int, block bigint, rid int, train array<boolean>, yhat array<double>", verifySchema=False)
    cells = yhat.join(blocks, ["gid", "block"]).select("gid", "rid", F.inline(F.arrays_zip("row", "train", "target", "yhat"))).where("train is not null")
    out = stable(cells.join(area, "gid").select(*by, run, "row.*", "train", "target", "yhat"))
    state.unpersist()
    return base, trees, out
