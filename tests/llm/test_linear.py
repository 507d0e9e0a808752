"""The toxicity and quality queries against dense brute force; the bounded samples."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import prose


def corpus():
    r = random.Random(11)
    rows, labels = [], []
    for i in range(150):
        good = i % 2
        text = " ".join(r.choice(["Lorem", "ipsum", "dolor", "sit", "amet"] if r.random() < (0.6 if good else 0.4) else ["spam", "Spam", "buy", "now", "now"]) for _ in range(r.randint(4, 25)))
        rows.append((i, text))
        if i % 3:
            labels.append((i, good, good))
    rows += [(200, None), (201, ""), (202, "x"), (203, rows[5][1]), (None, "no id"), (204, "  a\tb  ")]
    labels += [(5, 1, 1), (7, None, None), (9, 0, 0), (9, 1, 1), (999, 1, 1), (None, 1, 1)]
    return rows, labels


def grams(text, n, kind):
    words = (text or "").split()
    if kind == "toxic":
        words = [w.lower() for w in words]
    else:
        words = ["\x01" if i and words[i - 1] == w else w for i, w in enumerate(words)]
    s = " ".join(words)
    return {s[i:i + n] for i in range(len(s) - n + 1)}


def dense(rows, labels, n, kind):
    """(id -> unit vector for every row, training matrix, targets) over all n-grams as columns."""
    clear = {i: {y for j, y in labels if j == i and y is not None} for i, _ in labels}
    taught = {i: y.pop() for i, y in clear.items() if len(y) == 1}
    train = sorted((i, t) for i, t in rows if i is not None and i in taught)
    x = [grams(t, n, kind) for _, t in train]
    y = np.array([taught[i] for i, _ in train])
    columns = sorted(set().union(*x, *(grams(t, n, kind) for _, t in rows)))
    at = {g: k for k, g in enumerate(columns)}
    hit = np.zeros((len(x), len(columns)))
    for k, g in enumerate(x):
        hit[k, [at[e] for e in g]] = 1
    share = lambda which: (hit[which].sum(axis=0) + 1) / (which.sum() + 2)
    ratio = np.log(share(y == 1) / share(y == 0))

    def unit(g):
        v = np.zeros(len(columns))
        own = [at[e] for e in g]
        v[own] = ratio[own]
        return v / (np.linalg.norm(v) + 1e-9)

    return [unit(grams(t, n, kind)) for _, t in rows], np.array([unit(g) for g in x]), y


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, 1, "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, label int, range string, n int")
    return docs, spark.createDataFrame([(i, a, b, "x") for i, a, b in labels], "doc_id long, quality int, toxic int, text string")


def by_id(got, rows):
    return sorted(((r["id"], r["score"]) for r in got), key=repr), [i for i, _ in rows]


def test_toxicity_equals_dense_steps(spark):
    from wattline.llm.toxicity import toxicity

    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    every, x, y = dense(rows, [(i, b) for i, _, b in labels], 5, "toxic")
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = ahead = np.zeros(x.shape[1])
    b = 0.0
    for k in range(80):
        g = (1 / (1 + np.exp(-(x @ ahead + b))) - y) * share
        step = ahead - 200.0 * (x.T @ g + 1e-5 * ahead)
        b -= 0.05 * 200.0 * g.sum()
        ahead, w = step + k / (k + 3) * (step - w), step
    want = sorted(((i, float(1 / (1 + math.exp(-(v @ w + b))))) for (i, _), v in zip(rows, every, strict=True)), key=repr)
    got, _ = by_id(toxicity(docs, marks, F.lit(True)).collect(), rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-4)


def test_quality_reaches_the_hinge_optimum(spark):
    from wattline.llm.quality import SLOPE, quality

    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    every, x, y = dense(rows, [(i, a) for i, a, _ in labels], 4, "quality")
    z = np.hstack([x, np.ones((len(x), 1))]) * np.where(y == 1, 1.0, -1.0)[:, None]
    q, alpha = z @ z.T, np.zeros(len(z))
    for _ in range(60_000):  # projected gradient on the dual
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.eigvalsh(q)[-1] if _ == 0 else alpha - (q @ alpha - 1) / top, 0, 1)
        top = np.linalg.eigvalsh(q)[-1] if _ == 0 else top
    w = alpha @ z
    want = sorted(((i, float(1 / (1 + math.exp(-SLOPE * (v @ w[:-1] + w[-1]))))) for (i, _), v in zip(rows, every, strict=True)), key=repr)
    got, _ = by_id(quality(docs, marks, F.lit(True)).collect(), rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=0.03)


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_without_labels_every_score_is_a_half(spark, kind):
    import importlib

    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    score = getattr(importlib.import_module(f"wattline.llm.{kind}"), kind)
    for none in (marks.limit(0), marks.where("quality = 1")):
        assert {r["score"] for r in score(docs, none, F.lit(True)).collect()} == {0.5}
    assert score(docs.limit(0), marks, F.lit(True)).count() == 0


def test_hinge_without_end_is_an_error():
    from wattline.llm.quality import hinge

    x = [np.array([1.0])] * 2
    with pytest.raises(ArithmeticError):
        hinge(x, [np.array([0])] * 2, np.array([True, False]), epochs=1, eps=0.0)


def test_sample_is_the_first_rows_by_hash(spark):
    from wattline.llm.linear import sample

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = {(r["id"], r["label"], r["text"]) for r in sample(docs, labels, "toxic", F.lit(True), 700, 100, "doc_id", "text").collect()}
    keyed = labels.select("doc_id", "toxic", F.xxhash64(F.col("doc_id")).alias("h")).collect()
    want = {(r["doc_id"], r["toxic"], f"t{r['doc_id']}") for y in (0, 1) for r in sorted((r for r in keyed if r["toxic"] == y), key=lambda r: (r["h"], r["doc_id"]))[:700]}
    assert got == want


def test_long_texts_are_sampled_all_over(spark):
    from wattline.llm.common import spread

    text = "".join(chr(0x61 + i // 1000) for i in range(20_000))
    got = spark.createDataFrame([(text,), ("short",), ("",), (None,)], "t string").select(spread("t", 800).alias("s")).collect()
    assert [r["s"] for r in got[1:]] == ["short", "", None]
    assert len(got[0]["s"]) <= 800 and got[0]["s"][0] == "a" and got[0]["s"][-1] == "t" and len(set(got[0]["s"])) >= 9


def test_language_stage_sets_the_language(spark):
    from wattline.llm.language import keep_identified, language_sample

    texts = {"xx": prose(1, 400).replace("a", "b"), "yy": "qwx " * 300}
    rows = [(1, texts["xx"], "xx"), (2, texts["yy"], "yy"), (2, texts["yy"], "yy"), (3, texts["yy"][:300], None), (4, "12", "xx"), (5, texts["xx"][500:900], "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_sample(docs.where("doc_id < 3"), doc_chars=400)
    assert sorted(sample) == ["xx", "yy"] and all(len(t) <= 400 for t in sample.values())
    got = sorted((r["doc_id"], r["lang"]) for r in keep_identified(docs, sample).collect())
    assert got == [(1, "xx"), (2, "yy"), (2, "yy"), (3, "yy"), (5, "xx")]
