"""Linear text models on character n-gram indicators scaled by naive Bayes log-count ratios.

Shared by the toxicity and the quality operator. An n-gram indicator is a slot of a hashed table
of fixed size; its value is the log-count ratio of the slot between the classes, and the vector
of a text has length 1. Scoring needs two numbers per slot, so a model is a table of fixed size,
whatever it was learned from.

Bound of the sample: ``per_class`` labelled rows of each class, in order of a hash of the id; of a
text of more than ``doc_chars`` characters, that many from pieces spread over all of it. Rows are counted per
range of hashes first, so only the ranges that hold the sample are sorted. Every text, of any
length, is scored whole; a long one is read in parts, with the n-grams across their seams.

Ids with a null or an unclear label (both values) teach nothing. If a class has no row, every
score is 0.5. Null texts are scored like empty ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.llm.common import map_text, spread, text_of, type_of

SLOT_BITS = 20
PART_CHARS = 1 << 18
_SPACE = re.compile(r"\s")
Words = Callable[[list[str], str], list[str]]  # words of a part, and the word before it


def parts(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    start = 0
    while len(text) - start > limit:
        m = _SPACE.search(text, start + limit)
        if m is None:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:] if start else text


def slots(text: str, n: int) -> np.ndarray:
    """Slots of the character n-grams of a text."""
    s = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    if len(s) < n:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(len(s) - n + 1, dtype=np.uint64)
    for j in range(n):  # fixed odd multipliers of a multiplicative hash
        h = h * np.uint64(0x9E3779B97F4A7C15) + s[j:len(s) - n + 1 + j] + np.uint64(1)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def features(text: str, n: int, words: Words) -> np.ndarray:
    """Distinct slots of a whole text."""
    if len(text) <= PART_CHARS:
        return np.unique(slots(" ".join(words(text.split(), "")), n))
    seen = np.zeros(1 << SLOT_BITS, dtype=bool)
    carry = last = ""
    for part in parts(text):
        found = part.split()
        if not found:
            continue
        s = (carry + " " if carry else "") + " ".join(words(found, last))
        last = found[-1]
        for i in range(0, len(s), PART_CHARS):
            seen[slots(s[i:i + PART_CHARS + n - 1], n)] = True
        carry = s[1 - n:]
    return np.flatnonzero(seen)


def ratios(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Log-count ratio of every slot: how much likelier a text of class 1 has it than one of class 0."""
    def share(which: np.ndarray) -> np.ndarray:
        held = [rows[i] for i in np.flatnonzero(which)]
        return (np.bincount(np.concatenate(held), minlength=1 << SLOT_BITS) + 1.0) / (len(held) + 2.0)

    return np.log(share(positive) / share(~positive))


HASH_BITS = 14  # ranges of hashes that are counted


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, per_class: int, doc_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(id, label, text): the bounded sample. ``learn`` says which ids may teach."""
    known = (
        labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("top")).where("label = top").select("id", "label")
    )
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    held = stable(known.join(rows.select("id"), "id", "left_semi").withColumn("range", F.shiftright(F.xxhash64("id"), 64 - HASH_BITS)))
    counts = {0: [], 1: []}
    for r in held.groupBy("label", "range").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2 ** (HASH_BITS + 1) rows
        counts[r["label"]].append((r["range"], r["n"]))
    parts = []
    for label, found in counts.items():
        total, last = 0, -(1 << HASH_BITS)
        for at, n in sorted(found):
            if total < per_class:
                total, last = total + n, at
        parts.append(held.where((F.col("label") == label) & (F.col("range") <= last)).orderBy(F.xxhash64("id"), "id").limit(per_class))
    chosen = stable(parts[0].unionByName(parts[1]).select("id", "label"))
    return rows.join(chosen, "id").groupBy("id", "label").agg(F.min(spread("text", doc_chars)).alias("text"))


def fitted(rows: DataFrame, fit: Callable[[list[np.ndarray], list[np.ndarray], np.ndarray], tuple[np.ndarray, float]], n: int, words: Words) -> tuple[bytes, bytes, float] | None:
    """Learns in one task, from the bounded sample: per slot ratio x weight and ratio squared, and the bias."""
    def train(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id", kind="stable")
        positive = pdf.label.to_numpy() == 1
        if positive.all() or not positive.any():
            return pd.DataFrame({"weight": [], "square": [], "bias": []})
        x = [features(t, n, words) for t in pdf.text]
        r = ratios(x, positive)
        w, b = fit([normed(r, i) for i in x], x, positive)
        return pd.DataFrame({"weight": [(r * w).astype("<f4").tobytes()], "square": [(r * r).astype("<f4").tobytes()], "bias": [b]})

    got = rows.groupBy(F.lit(1).alias("one")).applyInPandas(train, "weight binary, square binary, bias double").collect()
    return (bytes(got[0]["weight"]), bytes(got[0]["square"]), got[0]["bias"]) if got else None


def normed(r: np.ndarray, slots_of: np.ndarray) -> np.ndarray:
    v = r[slots_of]
    return v / (np.sqrt(v @ v) + 1e-9)


def scored(docs: DataFrame, model: tuple[bytes, bytes, float] | None, slope: float, n: int, words: Words, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        ids, texts = batch.column("id"), batch.column("text").to_pylist()
        if shared.value is None:
            return {"id": ids, "score": [0.5] * len(texts)}
        weight, square = (np.frombuffer(x, dtype="<f4") for x in shared.value[:2])
        out = []
        for t in texts:
            x = features(t, n, words)
            m = float(weight[x].sum(dtype=np.float64)) / (float(np.sqrt(square[x].sum(dtype=np.float64))) + 1e-9) + shared.value[2]
            out.append(float(1 / (1 + np.exp(-np.clip(slope * m, -50, 50)))))
        return {"id": ids, "score": out}

    kind = type_of(docs, id_col)
    return map_text(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), "text", f"id {kind}, score double", run)
