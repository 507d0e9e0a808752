"""Packing, whitening and hard negatives against brute force, on rows that are awkward in every way."""

import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

VOCAB = P.path("word_bpe_49k.json")


# 11 ------------------------------------------------------------------ packing
def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéößñ日İΣ") for _ in range(r.randint(1, 7))) + r.choice(["", "", ".", "'s", "!?", " 12"]) for _ in range(n))


TEXTS = [
    (1, words(1, 40)), (2, words(1, 40)), (2, words(1, 40)), (3, None), (4, ""), (5, " \t\n"), (None, "no id"), (None, None), (6, words(2, 3000)),
    (7, "<|endoftext|>. <|EndOfText|> it's 'tis ... x='s' ’.’ ≮ é. 日本語。 12.5% ΣΑΣ. Å."), (8, "x" * 3000), (9, words(3, 90_000)), (10, "a\x1cb\x85c d\x0be"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, n, n, "p") for n, (i, t) in enumerate(TEXTS)], "doc_id long, text string, part int, length int, rank string")


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(VOCAB).encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(docs, capacity):
    from wattline.llm.packing import pack

    got = pack(docs, VOCAB, capacity=capacity, with_ids=True).collect()
    want = []
    for i, t in TEXTS:
        ids = ids_of(t)
        want += [(i, n, a, ids[a:a + capacity]) for n, a in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r.id, r.piece, r.start, list(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():  # gapless from 0, within the capacity
        ends = list(itertools.accumulate((n for _, n in sorted(s)), initial=0))
        assert [o for o, _ in sorted(s)] == ends[:-1] and ends[-1] <= capacity
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / capacity) + 1


def test_packing_of_nothing(docs):
    from wattline.llm.packing import pack

    assert pack(docs.limit(0), VOCAB).count() == 0


def test_word_table_is_bounded():
    import pyarrow as pa

    from wattline.llm.packing import Coder

    texts = pa.array([words(s, 300) for s in range(6)])
    small, whole = Coder(VOCAB, memo=500), Coder(VOCAB)
    for t in range(6):
        assert small.encode(texts.slice(t, 1), 1)[0].tolist() == whole.encode(texts.slice(t, 1), 1)[0].tolist() == ids_of(texts[t].as_py())
        assert len(small.at) <= 1500


def fewest(sizes: list[int], capacity: int) -> int:
    """Fewest sequences, by trying every subset."""
    n = len(sizes)
    total = [sum(sizes[i] for i in range(n) if m >> i & 1) for m in range(1 << n)]
    need = [0] + [n] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        low, s = m & -m, m
        while s:
            if s & low and total[s] <= capacity:
                need[m] = min(need[m], need[m ^ s] + 1)
            s = (s - 1) & m
    return need[-1]


def test_dominance_keeps_the_optimum():
    """What the reduction fixes plus the optimum of the rest is the optimum of the whole."""
    from wattline.llm.packing import best_fit, dominant_sets, plan

    r = random.Random(5)
    fixed_any = 0
    for _ in range(60):
        sizes = [r.choice([r.randint(1, 20), r.randint(5, 12)]) for _ in range(r.randint(1, 9))]
        counts = np.bincount(sizes, minlength=21)
        best = fewest(sizes, 20)
        left = counts.astype(np.int64)
        sets = list(dominant_sets(left, 20))
        assert all(sum(s) <= 20 for s, _ in sets)
        rest = np.repeat(np.arange(21), left).tolist()
        assert sum(n for _, n in sets) + fewest(rest, 20) == best
        fixed_any += bool(sets)
        assert best <= plan(counts, 20)[1] <= best + 1
        kinds = best_fit(counts.astype(np.int64), 20)
        assert sum((np.bincount([x for x, _ in c], weights=[k * n for _, k in c], minlength=21) for c, n in kinds), np.zeros(21)).tolist() == counts.tolist()
    assert fixed_any > 40


def test_best_fit_equals_one_by_one():
    from wattline.llm.packing import best_fit

    r = random.Random(9)
    for _ in range(30):
        sizes = sorted((r.randint(1, 50) for _ in range(r.randint(1, 300))), reverse=True)
        rooms = []
        for w in sizes:
            fit = [i for i, x in enumerate(rooms) if x >= w]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= w
            else:
                rooms.append(50 - w)
        assert sum(n for _, n in best_fit(np.bincount(sizes, minlength=51).astype(np.int64), 50)) == len(rooms)


# vectors ------------------------------------------------------------------
def vector_rows(n: int, d: int, seed: int = 0):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((4, d)) * 0.2
    rows = [(i, (centre[i % 4] + r.standard_normal(d) * 0.1).astype(np.float32).tolist(), i % 4) for i in range(n)]
    rows[3] = (3, rows[2][1], 3)  # a tie
    rows += [rows[10], rows[10], (None, rows[11][1], 2), (n, None, 1), (n + 1, [None] * d, 1), (n + 2, [float("nan")] * d, 2), (n + 3, rows[5][1][:-1] + [float("inf")], 0), (n + 4, rows[6][1], None), (n + 5, [], 1)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, id string, q int, vector int, anchor int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1) for r in rows], SCHEMA)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


# 12 ------------------------------------------------------------------ whitening
@pytest.mark.parametrize(("n", "d"), [(400, 12), (60, 5), (12, 30)])
def test_whitening(spark, n, d):
    from wattline.llm.whitening import whiten

    rows = vector_rows(n, d)
    got = whiten(frame(spark, rows).repartition(5), components=8).collect()
    held = [(i, v) for i, v, _ in rows if usable(v)]
    x = np.floor(1024 * np.array([v for _, v in held], dtype=float)).astype(np.int64) + 100_000
    s, m = x.sum(axis=0), len(x)
    y = (x * m - s) / m
    e, q = np.linalg.eigh(y.T @ y / m)
    e, q = e[::-1], q[:, ::-1]
    k = min(8, d)
    assert len(got) == m * k
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    deviation = sorted(((i, int(v)) for (i, _), v in zip(held, ((x * m - s) ** 2).sum(axis=1), strict=True)), key=repr)
    for c in range(1, k + 1):
        assert sorted(((r.id, r.deviation) for r in by[c]), key=repr) == deviation
        assert {r.n for r in by[c]} == {m} and by[c][0].explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
        want = y @ q[:, c - 1] / np.sqrt(e[c - 1])
        mine = {r.deviation: r.whitened for r in by[c]}
        ref = {int(v): w for v, w in zip(((x * m - s) ** 2).sum(axis=1), want, strict=True)}
        sign = np.sign(sum(mine[v] * ref[v] for v in ref))
        assert max(abs(mine[v] * sign - ref[v]) for v in ref) < 1e-8
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_without_variance(spark):
    from wattline.llm.whitening import whiten

    one = whiten(frame(spark, [(1, [0.5, 0.25], 0)])).collect()
    assert [(r.id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, c, 1, 0, None, None, 0.0) for c in (1, 2)]
    flat = whiten(frame(spark, [(i, [0.5, float(i)], 0) for i in range(4)])).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in flat} == {(1, False, 1.0), (2, True, 0.0)}
    assert whiten(frame(spark, [(1, None, 0)])).count() == 0 and whiten(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError, match="2 to 3 entries"):
        whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0, 3.0], 0)]))


def test_deviation_beyond_64_bits(spark):
    from wattline.llm.whitening import whiten

    rows = [(1, [1.0e12, 0.0], 0), (2, [0.0, 0.0], 0), (3, [0.0, 1.0], 0)]
    got = {r.id: r.deviation for r in whiten(frame(spark, rows)).where("component = 1").collect()}
    x = [[int(math.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v, _ in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for (i, _, _), v in zip(rows, x, strict=True)}
    assert got == {i: v if v < 2**63 else None for i, v in want.items()}


@pytest.mark.parametrize("kind", ["gauss", "graded", "ones", "zero", "short", "two-fold", "rank", "cluster", "twins"])
def test_singular_vectors(kind):
    from wattline.llm.whitening import singular

    r = np.random.default_rng(1)
    q = np.linalg.qr(r.standard_normal((40, 40)))[0]
    a = {
        "gauss": r.standard_normal((300, 40)), "graded": r.standard_normal((300, 40)) * 10.0 ** -np.arange(40), "ones": np.ones((30, 7)), "zero": np.zeros((5, 4)),
        "short": r.standard_normal((5, 12)), "two-fold": np.diag([5.0] * 20 + [1.0] * 20) @ q, "rank": np.diag([5.0] * 20 + [0.0] * 20) @ q,
        "cluster": np.diag(1 + 1e-9 * np.arange(40)) @ q, "twins": np.repeat(r.standard_normal((50, 10)), 2, axis=1),
    }[kind]
    n = a.shape[1]
    tri = np.linalg.qr(a, mode="r")
    tri = np.vstack([tri, np.zeros((n - len(tri), n))])
    s, v = singular(tri)
    ref = np.linalg.svd(a, compute_uv=False)
    assert np.abs(np.sqrt(np.maximum(s, 0)) - np.concatenate([ref, np.zeros(n - len(ref))])).max() <= 1e-13 * max(1, ref.max())
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-10
    assert np.abs(tri.T @ (tri @ v) - v * s).max() <= 1e-12 * max(1, s.max())


# 13 ------------------------------------------------------------------ hard negatives
def expected_negatives(rows, positives=5, negatives=10, every=10):
    held = [(i, np.floor(256 * np.array(v, dtype=float)).astype(np.int64), (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in rows if usable(v) and lab is not None]
    last = lambda i: (i is None, i)
    anchors = {}
    for i, v, lab in held:
        if i is not None and i % every == 0:
            anchors[i] = min(anchors.get(i, (lab, v.tolist())), (lab, v.tolist()))
    out = []
    for a, (lab, v) in anchors.items():
        scored = [(int(np.dot(v, w)), i, own) for i, w, own in held]
        alike = sorted(((s, i) for s, i, own in scored if own == lab and i != a), key=lambda x: (-x[0], last(x[1])))[:positives]
        for p, pid in alike:
            hard = sorted(((s, i) for s, i, own in scored if own != lab and 30 * p <= 100 * s <= 90 * p), key=lambda x: (-x[0], last(x[1])))[:negatives]
            out += [(a, pid, n, i, p, s) for n, (s, i) in enumerate(hard, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "d", "rows", "anchors"), [(300, 16, 64, 7), (300, 3, 2048, 1024), (90, 21, 10, 3)])
def test_hard_negatives(spark, monkeypatch, n, d, rows, anchors):
    from wattline.llm import negatives

    monkeypatch.setattr(negatives, "ROWS", rows)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    data = vector_rows(n, d, seed=d)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(frame(spark, data).repartition(3), F.col("vec_id") % 10 == 0, label=label).collect()
    assert sorted(map(tuple, got), key=repr) == expected_negatives(data)
    assert len(got) > 100


def test_hard_negatives_with_ties(spark):
    """One vector under many ids, labels and copies."""
    from wattline.llm.negatives import hard_negatives

    data = [(i, [0.5, 0.25, -0.5], i % 3) for i in range(60)] + [(i, [0.3, 0.2, -0.1], i % 3) for i in range(60, 100)] + [(20, [0.5, 0.25, -0.5], 2)] * 3
    got = hard_negatives(frame(spark, data), F.col("vec_id") % 10 == 0, label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))).collect()
    assert sorted(map(tuple, got), key=repr) == expected_negatives(data)


def test_hard_negatives_of_nothing(spark):
    from wattline.llm.negatives import hard_negatives

    anchor = F.col("vec_id") % 10 == 0
    assert hard_negatives(frame(spark, []).limit(0), anchor).count() == 0
    assert hard_negatives(frame(spark, [(1, [1.0], 0), (2, [1.0], 1)]), anchor).count() == 0
    assert hard_negatives(frame(spark, [(10, [1.0], 0), (2, [1.0], 1)]), anchor).count() == 0  # no positive


def test_segment_bounds_hold():
    from wattline.llm.negatives import SEGMENTS, Side, summaries

    r = np.random.default_rng(3)
    q = np.floor(r.standard_normal((200, 19)) * 100) + r.integers(-50, 50, (200, 1))
    side = Side(np.arange(200), np.zeros(200), q, *summaries(q))
    exact = side.scores(side)
    widths = []
    for level in range(len(SEGMENTS)):
        low, high = side.bounds(side, level)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths[1] < widths[0]
