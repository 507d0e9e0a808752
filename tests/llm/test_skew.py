"""Buckets with more visitors than homes, documents full of one benchmark word."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import by_row, component_ids, contamination_expected, prose


def test_more_visitors_than_homes(spark, monkeypatch):
    """One bucket with a few homes beside one with many fingerprints, cut into blocks on both sides."""
    from wattline.llm import simhash as S

    monkeypatch.setattr(S, "VISITS", 2)
    r = random.Random(3)
    near = r.getrandbits(64)
    fps = {near}
    while len(fps) < 30:
        fps.add(near ^ 1 << r.randrange(26, 64))
    while len(fps) < 700:  # the same first block, the next one two bits away: visitors of the bucket, not at home
        fps.add(near ^ 3 << 13 ^ r.getrandbits(38) << 26)
    fps |= {x ^ 3 << 13 for x in list(fps)[:10]}
    fps = sorted(fps)
    rows = [(n, "k", f - 2**64 if f >= 2**63 else f) for n, f in enumerate(fps)]
    got = {x["fp"] % 2**64: x["component_id"] for x in S.labels(spark.createDataFrame(rows, "id long, key string, fp long"), 8).collect()}
    assert [got[f] for f in fps] == component_ids(fps, list(range(len(fps))))


def test_blocks_are_bounded(spark, monkeypatch):
    from wattline.llm import simhash as S

    r = np.random.default_rng(1)
    fps = [int(x) for x in r.integers(0, 1 << 38, 900) << 26]
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in set(fps)], "fp long")
    home, visit = S.sent(nodes, 1), S.sent(nodes, 2)
    assert home.groupBy("bucket").count().agg(F.max("count")).head()[0] >= 800  # one bucket of the first table
    assert S.star(np.array([1]), np.array([3])).tolist() == [[3, 1]]
    assert visit.count() > 10 * home.count() and S.links(nodes, 16).count() >= 0


@pytest.mark.parametrize("listed", [3, 2000])
def test_documents_full_of_one_item_word(spark, monkeypatch, listed):
    from wattline.llm import decontaminate as D

    monkeypatch.setattr(D, "LISTED", listed)
    items = [(1, "echo"), (2, "one two three"), (3, prose(1, 20))]
    rows = [(1, "echo " * 500), (2, "ECHO, one two three! " * 40), (3, prose(1, 20) + " x"), (4, None), (5, ""), (1, "echo " * 500), (6, prose(2, 50)), (7, "one two two three")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = by_row(D.contamination(docs, bench).collect(), "id", "n_words", "n_hit", "n_items", "items", "contaminated")
    assert got == contamination_expected(rows, items)


def test_a_long_text_of_one_word(spark):
    """Three million bytes: no row of the list of occurrences holds more than LISTED."""
    from wattline.llm import decontaminate as D

    docs = spark.createDataFrame([(1, "echo " * 600_000), (2, "other words")], "doc_id long, text string")
    bits = D._bitmap(spark.createDataFrame([("echo",)], "word string"))
    listed = D.occurrences(docs, bits, "doc_id", "text").select("row", "id", "n_words", F.size("found").alias("n"))
    s = listed.groupBy("id").agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.count("n_words").alias("docs"), F.max("n_words").alias("words")).collect()
    assert {r["id"]: (r["most"], r["all"], r["docs"], r["words"]) for r in s} == {1: (D.LISTED, 600_000, 1, 600_000), 2: (0, 0, 1, 2)}
