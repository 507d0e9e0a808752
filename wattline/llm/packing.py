"""Packing of tokenised documents into as few sequences as can be found of at most ``capacity`` tokens.

A document is its ids under a public tokenizer file and an end id. Only longer documents are cut,
into pieces of ``capacity``. What decides a packing is how many pieces there are of each length,
at most ``capacity`` numbers however many documents there are, so the plan is made of counts:

1. Dominance reduction (Martello and Toth). For a piece of the longest length left, a set of at
   most three pieces is fixed for good if it provably dominates every other sequence that holds that
   piece: nothing else fits; at most one more fits, or the pair fills the sequence to the last token;
   at most two more fit and the largest that fits outweighs the best pair, or the best pair covers
   every other pair part by part. All copies of such a set are fixed at once, and the rule is
   repeated on the shrunken instance until it fixes nothing.
2. Best fit on the remainder, by falling length; equal sequences are one entry with a count.

The plan lists intervals of ranks: the pieces of a length with ranks in an interval go to given
sequences at given offsets. Ranks are counted in the tasks that encode, and shifted by the counts of
the tasks before. So pieces never meet in one task, and a length that a third of them has is not a key of
rows: the driver sees one row per length, the shuffle of offsets one per task and length.

Null and empty texts are the end id alone. Repeated rows are packed each; a null id is kept. Ties
(equal lengths) are dealt by task and order of reading. An empty table has no pieces. Columns of
``docs`` other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.llm.common import slices, text_of, type_of
from wattline.llm.tokens import PART_BYTES, parts

CAPACITY = 4096
MEMO = 400_000  # words whose ids a worker remembers
TEXT_BYTES = 2 << 20  # text that a task splits into words at one time
MARKS = ".,!?;:#$%&*+-/=@^_~()[]{}<>|\""  # ASCII marks that a word may end with
PLAIN = "^[a-zß-öø-ÿ]+$"  # words that the tokenizer neither changes nor splits
_coders: dict[str, Coder] = {}


# ---------------------------------------------------------------------- the plan
def dominant_sets(counts: np.ndarray, capacity: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets and takes them out of ``counts``: (lengths, number of such sequences)."""
    changed = True
    while changed:
        changed = False
        for w in np.flatnonzero(counts)[::-1].tolist():
            while counts[w]:
                found = _dominant(counts, w, capacity)
                if found is None:
                    break
                need = np.bincount(found)
                times = min(int(counts[x]) // int(need[x]) for x in set(found))
                for x in found:
                    counts[x] -= times
                changed = True
                yield found, times


def _dominant(counts: np.ndarray, w: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``w`` that dominates all others with it, or None if none of the rules applies."""
    room = capacity - w
    rest = counts[:room + 1].copy()
    if w <= room:
        rest[w] -= 1
    sizes = np.flatnonzero(rest)
    if not len(sizes):
        return (w,)
    top = int(sizes[-1])
    least = np.repeat(sizes[:3], np.minimum(rest[sizes[:3]], 3))[:3]  # the smallest pieces that fit
    if top == room or len(least) < 2 or least[:2].sum() > room:
        return (w, top)
    if len(least) == 3 and least.sum() <= room:
        return None
    below = np.zeros(room + 1, dtype=np.int64)  # the largest length present, up to each
    below[sizes] = sizes
    below = np.maximum.accumulate(below)
    small = sizes[sizes <= room // 2]
    large = below[room - small]
    fits = (large > small) | (rest[small] > 1)
    if not fits.any():
        return (w, top)
    best = int(np.argmax(np.where(fits, small + large, -1)))
    a, b = int(large[best]), int(small[best])
    if top >= a + b:
        return (w, top)
    over = sizes[sizes > b]
    next_up = np.repeat(over[:2], np.minimum(rest[over[:2]], 2))[:2]
    if a == top and (len(next_up) < 2 or next_up.sum() > room):
        return (w, a, b)
    return None


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit by falling length: (pieces of a sequence as (length, number), number of such sequences).

    A piece goes to the fullest sequence that has room, which stays the fullest as long as another
    fits; so sequences of equal content are filled together, and a length adds at most two kinds.
    """
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(room: int, content: list[tuple[int, int]], times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((content, times))

    for w in np.flatnonzero(counts)[::-1].tolist():
        m = int(counts[w])
        while m:
            at = bisect_left(rooms, w)
            if at == len(rooms):  # new sequences
                room, content, times = capacity, [], -(-m // (capacity // w))
            else:
                room = rooms[at]
                content, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            each = room // w
            full = min(times, m // each)
            if full:
                put(room - each * w, [*content, (w, each)], full)
            m -= full * each
            times -= full
            if times and m:
                put(room - m * w, [*content, (w, m)], 1)
                times, m = times - 1, 0
            if times:
                put(room, content, times)
    return [x for kinds in open_.values() for x in kinds]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Intervals of ranks (length, first rank, first sequence, pieces a sequence, offset), and the number of sequences.

    ``counts[n]`` is the number of pieces of length n. The rows are in order of length and rank.
    """
    left = counts.astype(np.int64).copy()
    kinds = [([(x, s.count(x)) for x in sorted(set(s), reverse=True)], n) for s, n in dominant_sets(left, capacity)]
    kinds += best_fit(left, capacity)
    given, rows, first = np.zeros(len(counts), dtype=np.int64), [], 0
    for content, times in kinds:
        offset = 0
        for w, each in content:
            rows.append((w, int(given[w]), first, each, offset))
            given[w] += each * times
            offset += w * each
        first += times
    assert (given == counts).all()
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), first


def places(rows: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, from their length and their rank among those of that length."""
    starts = np.searchsorted(rows[:, 0], np.arange(int(length.max(initial=0)) + 2))
    at = np.empty(len(length), dtype=np.int64)
    for w in np.unique(length):
        own = slice(starts[w], starts[w + 1])
        pick = length == w
        at[pick] = starts[w] + np.searchsorted(rows[own, 1], rank[pick], side="right") - 1
    w, start, first, each, offset = rows[at].T
    return first + (rank - start) // each, offset + (rank - start) % each * w


# ---------------------------------------------------------------------- ids
def joined(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start:start + length] of every entry, one after the other."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


class Coder:
    """Ids of words, remembered; words are runs without ASCII white space."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.memo, self.whole, self.plain = memo, Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None  # plain words are in normal form
        vocab = self.whole.get_vocab()
        self.special = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.start, self.length = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def _add(self, words: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.at.update(zip(words, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.used += len(ids)

    def _learn(self, words: list[str], simple: bool) -> None:
        if simple:  # one word is one run of the tokenizer, and each run ends with one marked id
            lines = [" ".join(words[i:i + 200]) for i in range(0, len(words), 200)]
            ids = [x for e in self.plain.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids]
            flat = np.array(ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[flat])
            if len(ends) == len(words):
                return self._add(words, flat, np.diff(ends, prepend=-1))
        found = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        self._add(words, np.array([x for ids in found for x in ids], dtype=np.uint32), np.array([len(ids) for ids in found], dtype=np.int64))

    def places(self, words: pa.Array) -> np.ndarray:
        """Entry of each of the given distinct words."""
        listed = words.to_pylist()
        new = [w for w in listed if w not in self.at]
        if len(self.at) + len(new) > self.memo and len(self.at) > 1:
            self.clear()
            new = [w for w in listed if w]
        simple = pc.match_substring_regex(pa.array(new, type=pa.string()), PLAIN).to_pylist()
        for kind in (True, False):
            if some := [w for w, s in zip(new, simple, strict=True) if s == kind]:
                self._learn(some, kind)
        return np.fromiter(map(self.at.__getitem__, listed), dtype=np.int64, count=len(listed))

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds between texts; ``end`` closes each of them."""
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy().astype(np.int64)
        words, lower = words.flatten(), pc.ascii_lower(words.flatten())
        if held := [x for x in self.special if pc.any(pc.match_substring(lower, x)).as_py()]:  # special strings keep their case
            lower = pc.if_else(pc.match_substring_regex(lower, "|".join(map(re.escape, held))), words, lower)
        coded = lower.dictionary_encode()
        body = pc.ascii_rtrim(coded.dictionary, characters=MARKS)
        sure = pc.match_substring_regex(body, "[0-9a-zß-öø-ÿ]$")  # else the run of marks may reach into the body
        for x in held:
            sure = pc.and_not(sure, pc.match_substring(pc.ascii_lower(coded.dictionary), x))
        body = pc.if_else(sure, body, coded.dictionary)
        tail = _tails(coded.dictionary, body)
        distinct = pa.concat_arrays([body, tail]).dictionary_encode()
        entry = self.places(distinct.dictionary)[distinct.indices.to_numpy()].reshape(2, -1).T  # body, tail of each word
        sizes = self.length[entry]
        flat = joined(self.flat, self.start[entry.ravel()], sizes.ravel())
        length = sizes.sum(axis=1)
        start = np.cumsum(length) - length
        index = coded.indices.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        if end is not None:
            flat, start, length = np.append(flat, np.uint32(end)), np.append(start, len(flat)), np.append(length, 1)
            index = np.insert(index, bounds[1:], len(length) - 1)
            bounds = bounds + np.arange(len(bounds))
        total = np.concatenate([[0], np.cumsum(length[index])])
        return joined(flat, start[index], length[index]), total[bounds]


def _tails(words: pa.Array, bodies: pa.Array) -> pa.Array:
    """What follows the body of each word."""
    data, at = words.buffers()[2], np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    skip = pc.binary_length(bodies).to_numpy().astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    length = np.diff(at) - skip
    kept = joined(raw, at[:-1] + skip, length)
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(kept))


def _coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def cut(coder: Coder, texts: pa.Array, end: int, capacity: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, piece, start, ids) of all pieces; a long text is encoded in parts that end at white space."""
    if len(texts) == 1 and len(raw := texts[0].as_buffer()) > PART_BYTES:
        held, piece, start = np.zeros(0, dtype=np.uint32), 0, 0
        for part in parts(raw.to_pybytes()):
            held = np.concatenate([held, coder.encode(pa.array([part.decode()]), None)[0]])
            whole = len(held) // capacity * capacity
            for a in range(0, whole, capacity):
                yield 0, piece, start, held[a:a + capacity]
                piece, start = piece + 1, start + capacity
            held = held[whole:]
        yield 0, piece, start, np.append(held, np.uint32(end))
        return
    flat, bounds = coder.encode(texts, end)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for piece, at in enumerate(range(a, b, capacity)):
            yield i, piece, at - a, flat[at:min(at + capacity, b)]


def pieces(docs: DataFrame, vocab: str, capacity: int, end: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """id, part, piece, start, length, crc (and ids): ``nth`` counts the pieces of a length within a part (a task)."""
    from pyspark.sql.types import StructType

    kind = type_of(docs, id_col)
    target = StructType.fromDDL(f"id {kind}, part int, piece int, start long, length int, ids_crc32 long, nth long" + ", ids array<bigint>" * with_ids)

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, coder, seen = to_arrow_schema(target), _coder(vocab), np.zeros(capacity + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for s in slices(batch, "text", TEXT_BYTES):
                made = {f.name: [] for f in arrow}
                for i, piece, start, ids in cut(coder, s.column("text"), end, capacity):
                    for name, v in (("id", i), ("part", part), ("piece", piece), ("start", start), ("length", len(ids)), ("ids_crc32", zlib.crc32(ids.astype("<u4"))), ("nth", int(seen[len(ids)]))):
                        made[name].append(v)
                    if with_ids:
                        made["ids"].append(ids.astype(np.int64))
                    seen[len(ids)] += 1
                made["id"] = s.column("id").take(pa.array(made["id"], type=pa.int64()))
                yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v := made[f.name], pa.Array) else pa.array(v, type=f.type) for f in arrow], schema=arrow)

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, target)


def pack(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    made = stable(pieces(docs, vocab, capacity, end, id_col, text_col, with_ids))
    counted = stable(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    shift = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    rows, _ = plan(counts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(rows)  # as many rows as lengths and kinds of sequences, not documents

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            sequence, offset = places(shared.value, length, rank)
            kept = [n for n in b.schema.names if n not in ("rank", "length")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in kept), pa.array(length), pa.array(sequence), pa.array(offset)], names=[*kept, "length", "sequence_id", "offset"])

    ranked = made.join(shift, ["part", "length"]).select("id", "piece", "start", "ids_crc32", *["ids"] * with_ids, "length", (F.col("nth") + F.col("before")).alias("rank"))
    types = ", ".join(f"{c} {type_of(ranked, c)}" for c in ranked.columns if c not in ("rank", "length"))
    return ranked.mapInArrow(run, f"{types}, length long, sequence_id long, offset long").select(
        "id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
