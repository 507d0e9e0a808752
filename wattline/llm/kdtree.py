"""Shards of near-equal bytes by a k-d tree over metadata. Law: ``bytes``.

The tree begins with all rows and the wanted number of shards. A node with k shards is cut
into parts of floor(k / 2) and ceil(k / 2) shards at the weighted median (the point that divides
its bytes in that proportion) along its widest metadata dimension, until a leaf is one shard of
about the target bytes. Dimensions: language, logarithm of the size (both as numbers), checksum of the text. Width is the range of
the node's values relative to the range of all rows.

Medians are found without sorting. A row's place along a dimension is a number of
72 bits: value, then checksum, then a hash of its id. All nodes of a level look at 12 bits at a time:
one small aggregate gives bytes per node and value of those bits, and the next round looks only at rows
whose earlier bits are those of the median; it ends when the rows left weigh under ``slack`` of a
leaf. So nothing is collected but sums, at most shards x 4096 at a time, and no task holds
a node. Equal texts share value and checksum: a cut parts them only if they weigh more than that.

Slots number the rows of a shard from 0: rows fall into buckets by hash, bucket sizes are added
up, and rows are numbered within their bucket; the number of buckets follows the number of rows.

Null texts have no bytes and weigh 16; null languages are a value of their own, the lowest. Repeated rows are rows like
others. With fewer rows than shards some shards are empty; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import stable

OVERHEAD = 16  # bytes of a row besides its text
DIGIT = 12  # bits looked at in one round
WORD = 24  # bits of value, of checksum and of hash
TOP = (1 << WORD) - 1
BUCKET_ROWS = 10_000


def keyed(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One row per row of ``docs`` without its text: what the tree and the slots need."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), F.coalesce(F.crc32(F.col(lang_col).cast("binary")), F.lit(-1).cast("long")).alias("lang"),
    ).withColumn("row", F.monotonically_increasing_id())
    return stable(rows.withColumns({
        "scale": F.floor(F.log2("size") * 65536), "sum24": F.shiftright("crc", 8), "tie": F.pmod(F.xxhash64("id", "row"), F.lit(TOP + 1)),
    }))


DIMS = ("lang", "scale", "sum24")


def with_nodes(at: DataFrame, values: dict[int, tuple], names: str) -> DataFrame:
    """Joins the numbers of the row's node; there are at most as many nodes as shards, so their broadcast is bounded."""
    return at.join(F.broadcast(at.sparkSession.createDataFrame([(n, *v) for n, v in values.items()], f"node int, {names}")), "node")


def ranges(at: DataFrame) -> dict[int, dict]:
    """Bytes of every node and the range of its values in each dimension."""
    found = at.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))])
    return {r["node"]: r.asDict() for r in found.collect()}  # one row per node


def medians(at: DataFrame, targets: dict[int, float], limit: float) -> dict[int, tuple[int, int]]:
    """For every node the place (high, tie) from which rows go right, so that about ``targets`` bytes go left."""
    prefix, below, cuts = dict.fromkeys(targets, 0), dict.fromkeys(targets, 0.0), {}
    digits = 2 * WORD // DIGIT
    for j in range(digits + WORD // DIGIT):
        todo = [n for n in targets if n not in cuts]
        if not todo:
            break
        if j < digits:
            shift = 2 * WORD - DIGIT * (j + 1)
            head, digit = F.shiftright("high", shift + DIGIT), F.shiftright("high", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        else:
            shift = WORD - DIGIT * (j - digits + 1)
            head, digit = F.col("high") * (1 << (DIGIT * (j - digits))) + F.shiftright("tie", shift + DIGIT), F.shiftright("tie", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        sums: dict[int, list] = {n: [] for n in todo}
        near = with_nodes(at, {n: (prefix[n],) for n in todo}, "prefix long").where(head == F.col("prefix"))
        for r in near.groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("bytes")).collect():  # nodes x 4096 at most
            sums[r["node"]].append((r["digit"], r["bytes"]))
        for n in todo:
            for d, weight in sorted(sums[n]):
                if below[n] + weight >= targets[n] or (d, weight) == max(sums[n]):
                    break
                below[n] += weight
            prefix[n] = prefix[n] << DIGIT | d
            if weight <= limit or j == digits + WORD // DIGIT - 1:
                edge = prefix[n] + (targets[n] - below[n] > weight / 2)  # the nearer edge of the bin
                cuts[n] = (edge << shift, 0) if j < digits else (prefix[n] >> DIGIT * (j - digits + 1), (edge - (prefix[n] >> DIGIT * (j - digits + 1) << DIGIT * (j - digits + 1))) << shift)
    return cuts


def grow(rows: DataFrame, shards: int, slack: float) -> DataFrame:
    """Rows with ``node``: the number of their leaf, 0 to shards - 1."""
    at = rows.withColumn("node", F.lit(0))
    root = ranges(at).get(0)
    if root is None:
        return at
    span = {d: max(1, root[f"hi_{d}"] - root[f"lo_{d}"]) for d in DIMS}
    nodes = {0: shards}  # first shard of a node: its number of shards
    while any(k > 1 for k in nodes.values()):
        known = {n: r for n, r in ranges(at).items() if nodes[n] > 1}
        widest = {n: max(DIMS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / span[d]) for n, r in known.items()}
        value = F.floor((F.array(*DIMS)[F.col("dim")] - F.col("lo")) * TOP / F.col("span")).cast("long")
        scale = {n: (DIMS.index(d), known[n][f"lo_{d}"], max(1, known[n][f"hi_{d}"] - known[n][f"lo_{d}"])) for n, d in widest.items()}
        placed = stable(with_nodes(at, scale, "dim int, lo long, span long").withColumn("high", value * (1 << WORD) + F.col("sum24")).drop("dim", "lo", "span"))
        left = {n: nodes[n] // 2 for n in widest}
        cuts = medians(placed, {n: known[n]["bytes"] * left[n] / nodes[n] for n in widest}, slack * root["bytes"] / shards)
        right = (F.col("high") > F.col("c_high")) | ((F.col("high") == F.col("c_high")) & (F.col("tie") >= F.col("c_tie")))
        moved = with_nodes(placed, {n: (*cuts[n], left[n]) for n in cuts}, "c_high long, c_tie long, step int")
        moved = moved.withColumn("node", F.col("node") + F.when(right, F.col("step")).otherwise(0)).select(*at.columns)
        rest = at.where(F.col("node").isin([n for n, k in nodes.items() if k == 1]))
        at = stable(rest.union(moved))
        nodes = {m: k for n, old in nodes.items() for m, k in (((n, left[n]), (n + left[n], old - left[n])) if n in left else ((n, min(old, 1)),))}
    return at


def kd_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, shards: int | None = None, target_bytes: int = 1 << 30, slack: float = 0.01) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    ``shards`` fixes the number of leaves; else it follows from ``target_bytes``.
    """
    rows = keyed(docs, id_col, text_col, lang_col)
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    shards = shards or max(1, math.ceil((total or 0) / target_bytes))
    buckets = max(1, math.ceil(n / (shards * BUCKET_ROWS)))
    leaf = stable(grow(rows, shards, slack).select("id", "size", "crc", "row", "tie", F.col("node").cast("int").alias("shard"), F.shiftright(F.col("tie") * buckets, WORD).cast("int").alias("bucket")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = leaf.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(F.col("shard").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("tie", "id", "row")
    numbered = leaf.withColumn("n", F.row_number().over(inside)).join(offset, (F.col("shard") == F.col("s2")) & (F.col("bucket") == F.col("b2")))
    return numbered.select(
        "id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
