"""Hard negatives: for an anchor and each of its positives, the nearest rows of other labels within a window of scores.

Scores are inner products of whole-number vectors (``floor(scale * x)``). Every row stores, for each
segment of its vector, the segment's mean and its deviation (the length of what is left after the
mean is taken away). For two vectors, a segment of size m adds m * mean * mean' to the score, give or take
deviation * deviation'; summed over segments that bounds the score from both sides. Bounds from 4 long
segments are tried first; rows that they cannot settle are bounded again by 16 short ones, and only
what is still open is scored exactly. A row is dropped where its upper bound is below the k-th largest
sure lower bound, or its bounds miss the window; so nothing is lost.

Anchors are a stated query set. They meet all rows in blocks: a grid of about ANCHORS anchors by about
ROWS rows, dealt by a hash of the row's place, so neither a label nor a vector that a third of the rows share
is a key. Each block returns at most k rows for an anchor (and positive), the best of which are then taken.

Rows with a null label, or whose vector is null, empty or holds a null or non-finite entry, take no
part. Vectors of different lengths, and entries of 2^31 or more after scaling, are errors. A row with a
null id is never an anchor and comes after all ids in a tie. Of an anchor id that repeats, the
smallest (label, vector) is the anchor; a row with the anchor's own id is never its positive. Other repeated
rows each count. Without rows, anchors or positives there is no result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.llm.vectors import clean, dimension, matrix

SEGMENTS = (4, 16)
ROWS, ANCHORS = 2048, 1024  # of a block of the grid
CHUNK = 64  # anchors that are bounded together
NO_ID = np.iinfo(np.int64).max


def bounds_of(d: int, segments: int) -> np.ndarray:
    return np.linspace(0, d, min(d, segments) + 1).astype(int)


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment, level after level."""
    means, deviations = [], []
    for level in SEGMENTS:
        cuts = bounds_of(q.shape[1], level)
        size = np.diff(cuts)
        mean = np.add.reduceat(q, cuts[:-1], axis=1) / size
        rest = np.add.reduceat((q - np.repeat(mean, size, axis=1)) ** 2, cuts[:-1], axis=1)
        means.append(mean)
        deviations.append(np.sqrt(rest))
    return np.hstack(means), np.hstack(deviations)


class Side:
    """Rows of one side of a block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, means: np.ndarray, deviations: np.ndarray) -> None:
        self.ids, self.labels, self.q, self.means, self.deviations = ids, labels, q, means, deviations

    @classmethod
    def of(cls, t: pa.Table, d: int) -> Side:
        long = lambda c, fill: t.column(c).fill_null(fill).to_numpy()
        wide = sum(len(bounds_of(d, s)) - 1 for s in SEGMENTS)
        return cls(long("id", NO_ID), long("label", 0), matrix(t.column("q"), d).astype(float), matrix(t.column("means"), wide), matrix(t.column("deviations"), wide))

    def take(self, which) -> Side:
        return Side(self.ids[which], self.labels[which], self.q[which], self.means[which], self.deviations[which])

    def bounds(self, other: Side, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of every score, rows by anchors, from the segments of a level."""
        cuts = [bounds_of(self.q.shape[1], s) for s in SEGMENTS]
        start = sum(len(c) - 1 for c in cuts[:level])
        own = slice(start, start + len(cuts[level]) - 1)
        middle = (self.means[:, own] * np.diff(cuts[level])) @ other.means[:, own].T
        reach = self.deviations[:, own] @ other.deviations[:, own].T
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-3  # scores are whole numbers
        return middle - reach - slack, middle + reach + slack

    def scores(self, other: Side) -> np.ndarray:
        top = float(np.abs(self.q).max(initial=0)) * float(np.abs(other.q).max(initial=0)) * self.q.shape[1]
        if top < 2.0**53:
            return (self.q @ other.q.T).astype(np.int64)
        if top < 2.0**63:
            return self.q.astype(np.int64) @ other.q.astype(np.int64).T
        raise ValueError("a score is beyond the range of a long")


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """k-th largest of every column, -inf where there are fewer rows."""
    return np.partition(x, len(x) - k, axis=0)[len(x) - k] if len(x) >= k else np.full(x.shape[1], -np.inf)


def best(score: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int):
    """(column, ids, scores) of the first k valid rows of every column: high scores, then small ids."""
    least = kth_largest(np.where(valid, score, -np.inf), k)
    valid = valid & (score >= least)
    for c in np.flatnonzero(valid.any(axis=0)):
        at = np.flatnonzero(valid[:, c])
        at = at[np.lexsort((ids[at], -score[at, c]))[:k]]
        yield int(c), ids[at], score[at, c]


def nearest_alike(rows: Side, anchors: Side, k: int):
    """(anchor, ids, scores) of the k best rows of each anchor's label."""
    for label in np.unique(anchors.labels):
        alike, own = rows.take(rows.labels == label), np.flatnonzero(anchors.labels == label)
        for c in range(0, len(own), CHUNK):
            left, some = alike, anchors.take(own[c:c + CHUNK])
            floor = np.full(len(some.ids), -np.inf)
            for level in range(len(SEGMENTS)):
                low, high = left.bounds(some, level)
                other = left.ids[:, None] != some.ids
                floor = np.maximum(floor, kth_largest(np.where(other, low, -np.inf), k))
                left = left.take((other & (high >= floor)).any(axis=1))
            for at, ids, score in best(left.scores(some), left.ids, left.ids[:, None] != some.ids, k):
                yield own[c + at], ids, score


def nearest_other(rows: Side, anchors: Side, low: np.ndarray, high: np.ndarray, k: int):
    """(anchor, window, ids, scores): the k best rows of other labels with low <= score <= high, for each window of an anchor."""
    for c in range(0, len(anchors.ids), CHUNK):
        left, some = rows, anchors.take(slice(c, c + CHUNK))
        least, most = low[c:c + CHUNK].astype(float), high[c:c + CHUNK].astype(float)
        floor = least.copy()
        for level in range(len(SEGMENTS)):
            below, above = left.bounds(some, level)
            other = left.labels[:, None] != some.labels
            wanted = np.zeros(len(left.ids), dtype=bool)
            for w in range(low.shape[1]):
                sure = other & (below >= least[:, w]) & (above <= most[:, w])
                floor[:, w] = np.maximum(floor[:, w], kth_largest(np.where(sure, below, -np.inf), k))
                wanted |= (other & (above >= floor[:, w]) & (below <= most[:, w])).any(axis=1)
            left = left.take(wanted)
        score = left.scores(some)
        other = left.labels[:, None] != some.labels
        for w in range(low.shape[1]):
            lo, hi = low[c:c + CHUNK, w], high[c:c + CHUNK, w]
            for at, ids, s in best(score, left.ids, other & (score >= lo) & (score <= hi), k):
                yield c + at, w, ids, s


def _prepared(df: DataFrame, id_col: str, label: Column, vector_col: str, anchor: Column, scale: int) -> tuple[DataFrame, int]:
    """id, label, anchor, q, means, deviations of the rows that take part, written once; and the dimension."""
    src = df.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"), F.col(vector_col).alias("vector"))
    src = clean(src.where(F.col("label").isNotNull()), "vector")
    _, d = dimension(src, "vector")

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                s = b.slice(a, ROWS)
                q = np.floor(scale * matrix(s.column("vector"), d))
                if np.abs(q).max(initial=0) >= 2**31:
                    raise ValueError("an entry is 2^31 or more after scaling")
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [s.column("id"), s.column("label"), s.column("anchor"), lists(q.astype(np.int32)), *map(lists, summaries(q))],
                    names=["id", "label", "anchor", "q", "means", "deviations"])

    return stable(src.mapInArrow(run, "id long, label long, anchor boolean, q array<int>, means array<double>, deviations array<double>")), d


def _grid(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int, schema: str, fn) -> DataFrame:
    """``fn(rows, anchors)`` on every block of the grid."""
    down, across = -(-n_rows // ROWS), -(-n_anchors // ANCHORS)
    cast = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(down)).cast("int")  # of a written table: the same again
    left = rows.withColumn("r", place).withColumn("a", cast(across))
    right = anchors.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(across)).cast("int")).withColumn("r", cast(down))
    return left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInArrow(fn, schema)


def hard_negatives(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", label: str | Column = "label", vector_col: str = "embedding", *,
    positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows are anchors; a negative's score is ``least`` to ``most`` hundredths of the positive's.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, d = _prepared(df, id_col, F.col(label) if isinstance(label, str) else label, vector_col, anchor, scale)
    content = ["id", "label", "q", "means", "deviations"]
    anchors = stable(
        rows.where("anchor").groupBy("id").agg(F.min(F.struct(*content[1:])).alias("s")).select("id", "s.*"))
    n_rows, n_anchors = rows.count(), anchors.count()
    if n_anchors == 0:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.select(*content)

    def table(columns: dict) -> pa.Table:
        ids = np.concatenate(columns["id"]) if columns["id"] else np.zeros(0, dtype=np.int64)
        made = {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in columns.items() if k != "id"}
        return pa.table({"anchor": made["anchor"], "place": made["place"].astype(np.int32), "score": made["score"], "id": pa.array(ids, mask=ids == NO_ID)})

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"anchor": [], "place": [], "score": [], "id": []}
        if left.num_rows and right.num_rows:
            r, a = Side.of(left, d), Side.of(right, d)
            for at, ids, score in nearest_alike(r, a, positives):
                for k, v in (("anchor", np.full(len(ids), a.ids[at])), ("place", np.zeros(len(ids))), ("score", score), ("id", ids)):
                    out[k].append(v)
        return table(out)

    def unlike(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"anchor": [], "place": [], "score": [], "id": []}
        if left.num_rows and right.num_rows:
            r, a = Side.of(left, d), Side.of(right, d)
            low, high = np.full((len(a.ids), positives), 1), np.full((len(a.ids), positives), 0)  # nothing is in an empty window
            for i, scores in enumerate(right.column("scores").to_pylist()):
                low[i, :len(scores)] = [-(-least * p // 100) for p in scores]
                high[i, :len(scores)] = [most * p // 100 for p in scores]
            for at, w, ids, score in nearest_other(r, a, low, high, negatives):
                for k, v in (("anchor", np.full(len(ids), a.ids[at])), ("place", np.full(len(ids), w)), ("score", score), ("id", ids)):
                    out[k].append(v)
        return table(out)

    found = "anchor long, place int, score long, id long"
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    first = lambda made, k, by: made.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= k)
    near = first(_grid(rows, n_rows, anchors, n_anchors, found, alike), positives, ["anchor"])
    pairs = stable(near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "id"))).alias("p")))  # at most ``positives`` entries
    with_scores = stable(anchors.join(pairs, F.col("id") == F.col("anchor")).select(*content, F.col("p.score").alias("scores")))
    n_anchors = with_scores.count()
    if n_anchors == 0:
        return df.sparkSession.createDataFrame([], schema)
    hard = first(_grid(rows, n_rows, with_scores, n_anchors, found, unlike), negatives, ["anchor", "place"])
    at = F.element_at("p", F.col("place") + 1)
    return hard.withColumnRenamed("anchor", "of").join(pairs, F.col("of") == F.col("anchor")).select(
        F.col("of").alias("anchor_id"), at["id"].alias("positive_id"), F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        at["score"].alias("positive_score"), F.col("score").alias("negative_score"))
