"""The ten text operators against brute force, on rows that are awkward in every way."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzäéñ"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(LETTERS) for _ in range(r.randint(1, 9))) for _ in range(n))


LONG = prose(1, 300_000)  # several parts
ROWS = [
    (1, prose(2, 60)), (2, prose(2, 60)), (2, prose(2, 60)), (3, prose(2, 60).upper()), (4, None), (5, ""), (6, " \t\n"), (7, LONG),
    (8, "Äpfel ÄPFEL"), (9, "äpfel äpfel"), (None, "no id"), (None, None), (10, "<|endoftext|> it's 1234\r\n\r\n  don't!"), (11, "x" * 500),
    (12, prose(2, 60)[:-1] + "q"), (13, "日本語 テキスト 12"), (14, "..."), (15, "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry names that the operators use inside."""
    rows = [(i, t, "en" if n % 2 else None, f"s{n % 3}", n, f"k{n}", n, n) for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, row int, id int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_row(rows, *cols):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=repr)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# 1 ------------------------------------------------------------------ WARC
def warc_expected(rows):
    first = {}
    for i, t in rows:
        if len((t or "").encode()) >= 100 and i is not None:
            first[t] = min(first.get(t, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        again = t in first and i != first[t]
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[t] if again else None))
    return sorted(out, key=repr)


def read_back(spark, pages, path):
    from wattline.llm.warc import read_warc, write_warc

    write_warc(pages, path)
    got = read_warc(spark, path).withColumns({"id": F.col("id").cast("long"), "refers": F.col("refers").cast("long")}).collect()
    return by_row(got, "id", "payload_bytes", "payload_digest", "kind", "refers")


def test_warc(spark, docs, empty, tmp_path):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "key", "row")
    assert read_back(spark, pages, str(tmp_path / "a")) == warc_expected(ROWS)
    assert read_back(spark, pages.limit(0), str(tmp_path / "b")) == []


def test_warc_magic_over_splits(spark, tmp_path):
    """Payloads that hold whole records, in archives of many small splits."""
    from wattline.llm.warc import MAGIC

    inner = MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, (inner * (i % 4) + prose(i, 40)) * (1 + i % 3) + (MAGIC if i % 5 == 0 else "")) for i in range(60)] + [(99, inner * 100), (98, inner * 100)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")).coalesce(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        assert read_back(spark, pages, str(tmp_path / "w")) == warc_expected(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_warc_names(spark, tmp_path):
    from wattline.llm.warc import read_warc, write_warc

    rows = [("a:b>c", "u", "x" * 200), ("b", "u\r\nContent-Length: 1", "x" * 200), ("", None, None)]
    write_warc(spark.createDataFrame(rows, "page_id string, url string, html string"), str(tmp_path / "w"))
    got = by_row(read_warc(spark, str(tmp_path / "w")).collect(), "id", "kind", "refers", "payload_bytes")
    assert got == sorted([("a:b>c", "response", None, 200), ("b", "revisit", "a:b>c", 200), (None, "response", None, 0)], key=repr)


def test_warc_broken_chain(spark, tmp_path):
    from wattline.llm.warc import MAGIC, read_warc

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_bytes((MAGIC + "WARC-Type: response\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n").encode())
    with pytest.raises(ValueError, match="1 archives"):
        read_warc(spark, str(tmp_path / "x"))


# 2 ------------------------------------------------------------------ token counts
def test_token_counts(docs, empty):
    from tokenizers import Tokenizer
    from wattline.llm.tokens import token_counts

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = by_row(token_counts(docs, path).collect(), "id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 2048) for i, t in ROWS]
    assert got == sorted(want, key=repr)
    assert token_counts(empty, path).count() == 0


def test_token_table_is_bounded():
    from wattline.llm.tokens import _model, count_batch

    path = P.path("word_bpe_49k.json")
    texts = [prose(s, 300).encode() for s in range(6)]
    whole = count_batch(path, texts)
    _model(path)[1].clear()
    assert count_batch(path, texts, memo_limit=200) == whole


# 3 ------------------------------------------------------------------ shards
def test_kd_shards(spark, docs, empty):
    from wattline.llm.kdtree import kd_shards

    r = random.Random(3)
    rows = [(i, "t" * r.randint(0, 400) if i % 3 else "same text of a third of all rows" * 9, r.choice(["en", "de", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = kd_shards(df, shards=7).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert sorted(got["id"]) == list(range(3000)) and len(size) == 7
    assert size.max() - size.min() <= 0.05 * size.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert {(i, s, c) for i, s, c in zip(got["id"], got["size"], got["text_crc32"])} == {(i, len(t) + 16, zlib.crc32(t.encode())) for i, t, _ in rows}
    odd = kd_shards(docs, shards=5).toPandas()
    assert len(odd) == len(ROWS) and set(odd["shard"]) <= set(range(5)) and odd["law"].eq("bytes").all()
    assert kd_shards(empty, shards=5).count() == 0
    assert kd_shards(df, target_bytes=100_000).agg(F.max("shard")).first()[0] == -(-sum(len(t) + 16 for _, t, _ in rows) // 100_000) - 1


# 4, 7 --------------------------------------------------------------- classifiers
def labelled(spark, bad):
    r = random.Random(5)
    rows = []
    for i in range(400):
        words = prose(i, r.randint(5, 80)).split(" ")
        if y := i % 4 == 0:
            words = bad(words, r)
        rows.append((i, " ".join(words), int(y)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, LONG), (None, "x"), (3, rows[3][1])], "doc_id long, text string").withColumn("score", F.lit("clash"))
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (5, 1), (5, 0), (77777, 1)], "doc_id long, y int")


def held_out(got, labels, n):
    y = {r["doc_id"]: r["y"] for r in labels.collect() if r["doc_id"] not in (None, 5, 77777) and r["y"] is not None}
    return [(r["score"], y[r["id"]]) for r in got if r["id"] in y and zlib.crc32(str(r["id"]).encode()) % n == 1]


def test_toxicity(spark):
    from wattline.llm.common import remainder
    from wattline.llm.toxicity import toxicity

    def bad(words, r):
        for _ in range(3):
            words[r.randrange(len(words))] = r.choice(["grumblefex", "snorkwit", "blatherskite"])
        return words

    docs, labels = labelled(spark, bad)
    got = toxicity(docs, labels, remainder("doc_id", 3) != 1, label_col="y").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = held_out(got, labels, 3)
    assert len(held) > 100 and np.mean([(s >= 0.7) == y for s, y in held]) >= 0.97
    assert toxicity(docs.limit(0), labels, F.lit(True), label_col="y").count() == 0
    assert {r["score"] for r in toxicity(docs.where("doc_id < 9"), labels.limit(0), F.lit(True), label_col="y").collect()} == {0.5}


def test_quality(spark):
    from wattline.llm.common import remainder
    from wattline.llm.quality import quality, words

    assert words(["a", "a", "b", "b", "b"], "a") == ["\x01", "\x01", "b", "\x01", "\x01"]
    docs, labels = labelled(spark, lambda w, r: [x for x in w for _ in range(6)] if r.random() < 0.5 else [x + r.choice(["%%%", "###"]) for x in w])
    got = quality(docs, labels, remainder("doc_id", 3) != 1, label_col="y").collect()
    held = held_out(got, labels, 3)
    assert np.mean([(s >= 0.5) == y for s, y in held]) >= 0.97
    assert quality(docs.limit(0), labels, F.lit(True), label_col="y").count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal and the dual value meet."""
    from wattline.llm.quality import hinge

    r = np.random.default_rng(1)
    slots = [np.sort(r.choice(50, 8, replace=False)) for _ in range(60)]
    values = [r.normal(size=8) / 3 for _ in slots]
    y = r.random(60) < 0.4
    w, b = hinge(values, slots, y, eps=1e-9, epochs=5000)
    margin = np.array([v @ w[s] + b for v, s in zip(values, slots)]) * np.where(y, 1, -1)
    primal = 0.5 * (w @ w + b * b) + np.maximum(0, 1 - margin).sum()
    assert all(
        primal <= 0.5 * ((w + d) @ (w + d) + (b + e) ** 2) + np.maximum(0, 1 - np.array([v @ (w + d)[s] + b + e for v, s in zip(values, slots)]) * np.where(y, 1, -1)).sum() + 1e-6
        for d, e in [(np.where(np.arange(len(w)) < 50, r.normal(size=len(w)), 0) * 10.0**-k, r.normal() * 10.0**-k) for k in range(4) for _ in range(5)]
    )


def test_features_over_seams():
    from wattline.llm import linear
    from wattline.llm.quality import words

    whole = np.unique(linear.slots(" ".join(words(LONG.split(), "")), 4))
    assert len(LONG) > 3 * linear.PART_CHARS and (linear.features(LONG, 4, words) == whole).all()


# 5 ------------------------------------------------------------------ exact duplicates
@pytest.mark.parametrize("runs, bits", [(256, 4), (5, 1), (1, 3)])
def test_exact_groups(docs, empty, runs, bits):
    from wattline.llm.exact import exact_groups

    groups = defaultdict(list)
    for i, t in ROWS:
        groups[lower(t)].append(i)
    got = exact_groups(docs, runs=runs, bits=bits).collect()
    want = [(i, max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in ROWS]
    assert by_row(got, "id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["id"] == r["keep_id"] for r in kept)
    assert exact_groups(empty).count() == 0
    small = exact_groups(docs, largest=False).where("kept").collect()
    assert sorted((r["id"] for r in small), key=repr) == sorted((min((x for x in g if x is not None), default=None) for g in groups.values()), key=repr)


def test_exact_dedup_keeps_whole_rows(docs):
    from wattline.llm.exact import exact_dedup

    got = exact_dedup(docs)
    assert got.columns == docs.columns and got.count() == len({lower(t) for _, t in ROWS})


def test_exact_dedup_is_native(docs):
    from wattline.llm.exact import exact_groups

    plan = exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 6 ------------------------------------------------------------------ decontamination
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination_expected(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[s:s + k])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if ids := windows.get(tuple(w[s:s + k])):
                    hit |= set(range(s, s + k))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination(spark, empty):
    from wattline.llm.decontaminate import contamination, decontaminate

    r = random.Random(7)
    words = ["a", "b", "c", "the", "é", "x1"]
    items = [(n, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 12, 13, 14, 20, 40])))) for n in range(12)] + [(3, "The,B-c!"), (4, None), (None, "The b C"), (5, "..."), (5, "...")]
    rows = [(n, " ".join(r.choice(words) for _ in range(r.randint(0, 60))) + " " + (r.choice(items)[1] or "").upper() + ", " + " ".join(r.choice(words) for _ in range(9))) for n in range(60)]
    rows += [(100, None), (101, ""), (7, rows[7][1]), (None, items[3][1]), (102, prose(9, 400_000) + " " + items[10][1] + " " + prose(10, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("row", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("seq", F.lit(1))
    got = contamination(docs, bench).collect()
    want = contamination_expected(rows, items)
    assert by_row(got, "id", "n_words", "n_hit", "n_items", "items", "contaminated") == want
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not x[-1] for x in want)
    assert contamination(empty, bench).count() == 0
    assert {x["n_hit"] for x in contamination(docs, bench.limit(0)).collect()} == {0}


# 8 ------------------------------------------------------------------ byte-level BPE
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, empty):
    from wattline.llm.bpe import bpe_decode, bpe_encode

    path, enc = P.path("byte_bpe_50k.tiktoken"), encoding()
    got = bpe_decode(bpe_encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    want = [(i, np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for i, t in ROWS]
    assert sorted(((r["id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe_encode(empty, path, P.PATTERN).count() == 0


def test_bpe_pieces():
    """Both forms of the segment tree, on pieces of every length up to 200."""
    from wattline.llm.bpe import WIDE, coder

    c, enc = coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), encoding()
    r = random.Random(2)
    for n in [*range(2, WIDE + 1), 65, 100, 200, 5000]:
        pieces = ["".join(r.choice("aabcdethingé") for _ in range(n)).encode()[:n] for _ in range(5)] + [b"a" * n, b"ab" * (n // 2)]
        want = [enc.encode_single_token(p) if p in c.ranks else None for p in pieces]
        one = [c.merge_one(p) for p in pieces]
        assert all(b"".join(c.bytes_of[x] for x in ids) == p for ids, p in zip(one, pieces))
        if n <= WIDE:
            some = [p for p in pieces if len(p) > 1]
            assert c.merge_many(some, 1 << (max(map(len, some)) - 1).bit_length()) == [c.merge_one(p) for p in some]
        for p, ids, token in zip(pieces, one, want):
            if token is None:
                assert ids == enc._core_bpe.encode_single_piece(p)


# 9 ------------------------------------------------------------------ language
def test_cross_parsing():
    """Phrases by automaton and by search in the sample."""
    from wattline.llm.language import BLOCK, Model

    sample = {"a": prose(1, 80), "b": prose(2, 60) + "ß", "c": "ab"}
    m = Model(sample)
    texts = [prose(s, 90) for s in range(4)] + ["", "!!", "ßßß ab", "日本"]
    coded = [m.encode(t) for t in texts]

    def phrases(s, model):
        n = 0
        for b in range(0, len(s), BLOCK):
            block, i = s[b:b + BLOCK], 0
            while i < len(block):
                j = i + 1
                while j <= len(block) and block[i:j] in model:
                    j += 1
                n, i = n + 1, max(i + 1, j - 1)
        return n

    assert m.phrases(coded).tolist() == [[phrases(c.tobytes(), m.encode(sample[k]).tobytes()) for k in m.langs] for c in coded]


def test_letters_and_phrases_whole():
    """No letters are merged, other languages change nothing, phrases cross the edges of lanes."""
    from wattline.llm.language import BLOCK, Model

    def text(seed, start, letters, n):
        r = random.Random(seed)
        return "".join(" " if r.random() < 0.2 else chr(start + r.randrange(letters)) for _ in range(n))

    scripts = {"zh": (0x4E00, 3000), "ko": (0xAC00, 2000), "ru": (0x430, 32), "el": (0x3B1, 25), "en": (0x61, 26)}
    sample = {k: text(1, *v, 1500) for k, v in scripts.items()} | {"xx": "aaa"}
    sample |= {f"l{i}": text(i, 0x61, 26, 300) for i in range(60)}
    m = Model(sample, block=None)
    assert len({m.encode(c)[0] for k, v in sample.items() for c in v if c != " "}) == len(set("".join(sample.values()))) - 1
    assert m.bits[m.langs.index("zh")] == np.log2(len(m.encode(sample["zh"])))
    texts = [sample["zh"][10:700], text(3, 0x430, 32, 2000), sample["en"][:900] + "日" * 600, "a" * 2000, "ab" * 700 + sample["ru"], "", "!"] + [text(9, *v, BLOCK + 1) for v in scripts.values()]

    def phrases(s, model):
        n = i = 0
        while i < len(s):
            j = i + 1
            while j <= len(s) and s[i:j] in model:
                j += 1
            n, i = n + 1, max(i + 1, j - 1)
        return n

    plain = lambda t: re.sub(r"[\W\d_]+", " ", t.lower())
    got = m.phrases([m.encode(t) for t in texts])
    assert got[:, [m.langs.index(k) for k in [*scripts, "xx"]]].tolist() == [[phrases(plain(t), plain(sample[k])) for k in [*scripts, "xx"]] for t in texts]
    few = Model({k: sample[k] for k in scripts}, block=None)
    assert few.phrases([few.encode(t) for t in texts]).tolist() == got[:, [m.langs.index(k) for k in few.langs]].tolist()


def test_language(spark, docs, empty):
    from wattline.llm.language import identify, keep_identified, language_sample

    r = random.Random(4)
    vocab = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(50)] for k, a in (("xx", "abcdefgh"), ("yy", "defghijkl"), ("zz", "aeioéà"))}
    rows = [(n, " ".join(r.choice(vocab[k]) for _ in range(30)), k) for n in range(300) for k in [("xx", "yy", "zz")[n % 3]]] + [(900, "xx " * 9, None), (901, "...", "xx"), (902, None, "yy")] * 2
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("hash", F.lit(1))
    sample = language_sample(known.where("doc_id % 2 = 0"), docs_per_lang=8)
    assert sorted(sample) == ["xx", "yy", "zz"]
    got = {(x["id"], x["lang_pred"]) for x in identify(known, sample).collect()}
    assert all((n, k) in got for n, _, k in rows[:300]) and {(901, "und"), (902, "und")} <= got
    kept = keep_identified(known, sample)
    assert kept.columns == known.columns and kept.count() == len(rows) - 4
    assert {x["lang_pred"] for x in identify(docs, {}).collect()} == {"und"}
    assert identify(empty, sample).count() == 0 and language_sample(empty) == {}
    marks = {x["id"]: x["lang_pred"] for x in identify(docs, sample).collect()}
    assert marks[4] == marks[5] == marks[6] == marks[14] == "und" and marks[13] != "und" and marks[7] != "und"


def test_no_labelled_text_keeps_the_corpus(docs):
    from wattline.llm.language import keep_identified

    kept = {r["row"] for r in keep_identified(docs, {}).collect()}
    assert kept == {n for n, (_, t) in enumerate(ROWS) if t and any(c.isalpha() for c in t)}


# 10 ----------------------------------------------------------------- near duplicates
def simhash(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t).encode())
    s = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum((2 * n > len(s)) << b for b, n in enumerate(ones)) if s else 0


def component_ids(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i in range(len(fps)):
        low[find(i)].append(ids[i])
    return [min((x for x in low[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_near_groups(docs, empty):
    from wattline.llm.simhash import near_dedup, near_groups

    rows = [(i, t) for i, t in ROWS if t != LONG]
    short = docs.where("doc_id is null or doc_id <> 7")
    fps = [simhash(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, component_ids(fps, [i for i, _ in rows]))]
    got = by_row(near_groups(short).collect(), "id", "fingerprint", "component_id")
    assert got == sorted(want, key=repr)
    left = near_dedup(short)
    assert left.columns == docs.columns and left.count() == len({c if c is not None else f for _, f, c in want})
    assert near_groups(empty).count() == 0


def test_long_fingerprint():
    from wattline.llm.simhash import fingerprint

    t = LONG[:1_300_000]
    assert fingerprint(t.encode()) == simhash(t)


@pytest.mark.parametrize("crowd", [2, 256])
def test_labels_find_all_links(spark, crowd):
    """Chains, dense balls and lone fingerprints; small buckets and crowded ones."""
    from wattline.llm.simhash import labels

    r = random.Random(11)
    fps = [r.getrandbits(64) for _ in range(150)]
    for _ in range(150):
        x = r.choice(fps)
        for b in r.sample(range(64), r.randint(1, 5)):
            x ^= 1 << b
        fps.append(x)
    ball = r.getrandbits(64)
    fps += [ball ^ 1 << r.randrange(64) for _ in range(40)] + [0, 0, 2**64 - 1]
    rows = [(n, "k", f - 2**64 if f >= 2**63 else f) for n, f in enumerate(fps)]
    got = {x["fp"] % 2**64: x["component_id"] for x in labels(spark.createDataFrame(rows, "id long, key string, fp long"), crowd).collect()}
    want = component_ids(fps, list(range(len(fps))))
    assert all(got[f] == c for f, c in zip(fps, want))


def test_every_pair_meets_in_a_bucket():
    """Fingerprints at distance 4 or less share a bucket: the reason that the search is exact."""
    from wattline.llm.simhash import WIDTHS, _code, anchors

    words = _code()
    assert len(words) == 16 and all(min((v ^ w).bit_count() for w in words) <= 1 for v in range(128))
    for width in set(WIDTHS):
        offset, near = anchors(width, 2)
        home = {v: next(w for w in near[offset[v]:offset[v + 1]] if (v ^ int(w)).bit_count() <= 1 and (v ^ int(w)) < 128) for v in range(0, 1 << width, 37)}
        for v, h in home.items():
            for b in [0] + [1 << i for i in range(width)]:
                assert h in near[offset[v ^ b]:offset[(v ^ b) + 1]]
