"""Benchmark decontamination by a prefix-filtered join.

A window is 13 consecutive words of an item (all words of a shorter one). A document contains
a window only if it contains the window's rarest word, so that one word is the prefix which
has to be joined: words are ordered by the number of documents they occur in, counted over all
documents. Positional bound: an occurrence of the prefix word fixes where the window would lie.
Length bound: only words within 12 places of it matter, fewer where the item ends. The exact
check compares the two neighbourhoods word by word; the common run around the prefix word, if it
is as long as a window, is a stretch of hit words. Windows of an item that share a prefix word
are one index row, so a passage gives a row per prefix word and occurrence, not per window.

Documents are split into words in Arrow functions. Which words of a document can matter is looked
up in a bitmap of fixed size, whose false positives fall out in the join; the size of nothing
that is broadcast by hand depends on the data. A frequent prefix word is a skewed join key, which
AQE splits.

Words: maximal runs of a-z (after lower-casing A-Z), 0-9 and characters beyond ASCII. Null and
empty texts have none: such a document has no hits and counts as not contaminated, such an item
has no window. Repeated document rows are counted each; repeated item rows once. Null item ids
are listed as the empty string.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.llm.common import SLICE_BYTES, digest, drop_listed, map_text, slices, text_of, type_of
from wattline.llm.tokens import parts

WINDOW = 13
LISTED = 2000  # occurrences in one row
SLOTS = 1 << 22
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def _bitmap(words: DataFrame) -> bytes:
    """One bit per slot that a word of ``words(word)`` falls into; its size is fixed."""
    slots = words.select((F.crc32(F.col("word").cast("binary")) % SLOTS).alias("slot")).distinct()
    byte = slots.groupBy(F.shiftright("slot", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot % 8 as int))")).alias("bits"))
    out = np.zeros(SLOTS >> 3, dtype=np.uint8)
    for r in byte.collect():  # at most SLOTS / 8 rows
        out[r["at"]] = r["bits"]
    return out.tobytes()


def _marked(bits: bytes, word: bytes) -> bool:
    slot = zlib.crc32(word) & (SLOTS - 1)
    return bits[slot >> 3] >> (slot & 7) & 1 == 1


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words, seq): the words of every item that has any, and the digest that names the sequence."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [b" ".join(words_of(t)).decode() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        return {"item": batch.column("item"), "words": found}

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_of(text_col).alias("text"))
    return map_text(rows, "text", "item string, words string", run).where("words <> ''").select("item", "words", F.md5("words").alias("seq")).distinct()


def rarity(docs: DataFrame, bits: bytes, text_col: str) -> DataFrame:
    """(word, n): number of documents with the word, for words of the bitmap, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        found: dict[bytes, int] = {}
        bits = shared.value
        known: dict[bytes, bool] = {}
        for b in batches:
            for t in b.column("text"):
                words = set()
                for part in parts(t.as_py()):
                    words.update(words_of(part))
                if len(known) > 1_000_000:
                    known.clear()
                for w in words:
                    ok = known.get(w)
                    if ok is None:
                        ok = known[w] = _marked(bits, w)
                    if ok:
                        found[w] = found.get(w, 0) + 1
            if len(found) > 200_000:
                yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in found], "n": pa.array(list(found.values()), pa.int64())})
                found = {}
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    return docs.select(text_of(text_col).cast("binary").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def index_rows(sequences: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, seq, left, right, need): every prefix word of a sequence with its neighbourhood."""
    each = sequences.select("seq", F.posexplode(F.split("words", " ")).alias("pos", "word"))
    ranked = each.join(counts, "word", "left").select("seq", F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), "word").alias("w"))
    whole = ranked.groupBy("seq").agg(F.array_sort(F.collect_list("w")).alias("words"))  # one item's words

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("word", "seq", "left", "right", "need")}
            for seq, words in zip(b.column("seq").to_pylist(), b.column("words").to_pylist(), strict=True):
                text = [w["word"] for w in words]
                order = [(w["n"], w["word"], w["pos"]) for w in words]
                need = min(WINDOW, len(text))
                for q in sorted({min(order[s:s + need])[2] for s in range(len(text) - need + 1)}):
                    for k, v in zip(out, (text[q], seq, " ".join(text[max(0, q - WINDOW + 1):q]), " ".join(text[q + 1:q + WINDOW]), need), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "need" else pa.string()) for k, v in out.items()})

    return whole.mapInArrow(run, "word string, seq string, left string, right string, need int")


def places(text: bytes, bits: bytes):
    """Occurrences of marked words with up to 12 words on either side, at most LISTED at a time, and last the number of words.

    A long text is read in parts; words at their seams wait until their neighbours are there.
    """
    side = WINDOW - 1
    out, words, first, todo = [], [], 0, 0
    pieces = list(parts(text))
    for n, part in enumerate(pieces, 1):
        words += words_of(part)
        end = len(words) if n == len(pieces) else max(todo, len(words) - side)
        some = {w for w in set(words) if _marked(bits, w)}
        if some:
            for i in range(todo, end):
                if words[i] in some:
                    out.append({"word": words[i].decode(), "pos": first + i, "left": b" ".join(words[max(0, i - side):i]).decode(), "right": b" ".join(words[i + 1:i + WINDOW]).decode()})
                    if len(out) == LISTED:
                        yield out
                        out = []
        cut = max(0, end - side)
        words, first, todo = words[cut:], first + cut, end - cut
    yield out
    yield first + len(words)


def occurrences(docs: DataFrame, bits: bytes, id_col: str, text_col: str) -> DataFrame:
    """(row, id, key, n_words, found): found lists where words of the bitmap stand, with their neighbours. A document whose
    list is long has further rows, with n_words null, so no row outgrows LISTED occurrences."""
    from pyspark.sql.types import StructType

    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = type_of(docs, id_col)
    target = StructType.fromDDL(f"row long, id {kind}, key string, n_words long, found array<struct<word:string,pos:long,left:string,right:string>>")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)

        def batch(at: list[int], n_words: list, found: list, s: pa.RecordBatch) -> pa.RecordBatch:
            take = pa.array(at, pa.int64())
            held = {"row": s.column("row").take(take), "id": s.column("id").take(take), "key": s.column("key").take(take), "n_words": pa.array(n_words, pa.int64())}
            return pa.RecordBatch.from_arrays([held[f.name].cast(f.type) if f.name in held else pa.array(found, f.type) for f in arrow], schema=arrow)

        for b in batches:
            for s in slices(b, "text"):
                at, n_words, found, size = [], [], [], 0
                for i, t in enumerate(s.column("text").cast(pa.binary()).to_pylist()):
                    *lists, total = places(t, shared.value) if len(t) <= SLICE_BYTES else (None,)
                    if total is None:  # a long text: its lists leave as they are made
                        last = []
                        for x in places(t, shared.value):
                            if isinstance(x, int):
                                at, n_words, found = [*at, i], [*n_words, x], [*found, last]
                            else:
                                if last:
                                    yield batch([i], [None], [last], s)
                                last = x
                        continue
                    for k, x in enumerate(lists):
                        at.append(i)
                        n_words.append(total if k == len(lists) - 1 else None)
                        found.append(x)
                        size += len(x)
                    if size > 4 * LISTED:
                        yield batch(at, n_words, found, s)
                        at, n_words, found, size = [], [], [], 0
                yield batch(at, n_words, found, s)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), digest(text_col).alias("key"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, target)


def runs(pairs: DataFrame) -> DataFrame:
    """Exact check of candidates: (row, seq, start, stop) of the common runs that are long enough."""

    def run(batches):
        for b in batches:
            d = b.to_pydict()
            out: dict[str, list] = {k: [] for k in ("row", "seq", "start", "stop")}
            for row, seq, pos, l1, r1, l2, r2, need in zip(*(d[k] for k in ("row", "seq", "pos", "left", "right", "i_left", "i_right", "need")), strict=True):
                before, after = 0, 0
                for x, y in zip(reversed(l1.split(" ")), reversed(l2.split(" ")), strict=False):
                    if x != y or not x:
                        break
                    before += 1
                for x, y in zip(r1.split(" "), r2.split(" "), strict=False):
                    if x != y or not x:
                        break
                    after += 1
                if before + after + 1 >= need:
                    for k, v in zip(out, (row, seq, pos - before, pos + after + 1), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k == "seq" else pa.int64()) for k, v in out.items()})

    return pairs.mapInArrow(run, "row long, seq string, start long, stop long")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, key (digest of the text), n_words, n_hit, n_items, items (list of ids), contaminated."""
    pairs = stable(item_words(items, item_col, item_text))
    sequences = pairs.select("seq", "words").distinct()
    counts = rarity(docs, _bitmap(sequences.select(F.explode(F.split("words", " ")).alias("word"))), text_col)
    index = stable(index_rows(sequences, counts))
    listed = stable(occurrences(docs, _bitmap(index.select("word")), id_col, text_col))
    rows = listed.where("n_words is not null")
    places = listed.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    found = stable(runs(places.join(index.withColumnsRenamed({"left": "i_left", "right": "i_right"}), "word").select("row", "seq", "pos", "left", "right", "i_left", "i_right", "need")).distinct())

    from pyspark.sql import Window

    w = Window.partitionBy("row").orderBy("start", "stop")
    reach = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = found.select("row", "start", "stop").distinct().select("row", F.greatest(F.col("stop") - F.greatest("start", reach), F.lit(0)).alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    named = found.select("row", "seq").distinct().join(pairs.select("seq", "item"), "seq").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = hits.join(named, "row")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select("row", "id", "key", "n_words").join(both, "row", "left").select(
        "id", "key", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    bad = stable(contamination(docs, items, id_col, text_col, **kw).where("contaminated").select("id", "key").distinct())
    return drop_listed(docs, bad, id_col, digest(text_col))
