"""Byte-level BPE: encoding by ranks and decoding.

A segment tree over the byte positions of a piece stores, at every node, the smallest pair
rank below it and its leftmost position. The root names the next merge; the merge changes the
leaves of at most three live positions (the merged one, the one it swallows and the live
neighbour to the left), each a walk of logarithmic length to the root. Short pieces are merged
many at a time, one tree per row of a matrix; pieces longer than ``WIDE`` bytes have a tree of
their own. A bounded table keeps the ids of pieces already encoded.

Null and empty texts have no ids. Repeated rows are encoded each. Very long texts are matched
in parts that begin at a single space between two ASCII letters, where the pattern always
begins a new match; a text without such a place is matched whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import map_text, text_of, type_of

WIDE = 64
PART_CHARS = 1 << 20
MEMO = 250_000
MANY = 2048  # pieces whose trees stand side by side
NONE = np.int64(1) << 62
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_coders: dict[tuple[str, str], Coder] = {}


class Coder:
    """Ranks, the table of mergeable pairs, and the pieces encoded so far.

    The pair tables are made when a piece is first merged, so decoding doesn't hold them.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.start = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.base = max(self.bytes_of) + 1
        self.memo: dict[str, bytes] = {}

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys (left id x base + right id) in order, and the rank of each pair."""
        keys, values = array("q"), array("q")
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    values.append(rank)
        k, v = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)
        order = np.argsort(k)
        return k[order], v[order]

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The same as a dictionary, for long pieces."""
        return dict(zip(*(x.tolist() for x in self.table), strict=True))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE where the pair doesn't merge."""
        key = left * self.base + right
        keys, values = self.table
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], NONE)

    def merge_many(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of 2 to ``width`` bytes; ``width`` is a power of two."""
        m = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(m, width)
        ids = self.start[raw]
        spot = np.arange(width)
        nxt = np.tile(spot + 1, (m, 1))
        prv = np.tile(spot - 1, (m, 1))
        tree = np.full((m, 2 * width), NONE, dtype=np.int64)
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        rank[spot[1:][None, :] >= size[:, None]] = NONE
        tree[:, width:2 * width - 1] = np.where(rank == NONE, NONE, rank * width + spot[:-1])
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            i = at + width
            tree[row, i] = value
            while True:
                i = i >> 1
                if i[0] == 0:
                    break
                tree[row, i] = np.minimum(tree[row, 2 * i], tree[row, 2 * i + 1])

        def pair(row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """Leaf values of the pairs that begin at ``left``; NONE past either end."""
            ok = (left >= 0) & (right < size[row])
            r = self.rank_of(ids[row, np.where(ok, left, 0)], ids[row, np.where(ok, right, 0)])
            return np.where(ok & (r != NONE), r * width + left, NONE)

        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            top = tree[row, 1]
            at, rank = top % width, top // width
            gone = nxt[row, at]
            after = nxt[row, gone]
            ids[row, at] = rank
            nxt[row, at] = after
            inside = after < width
            prv[row[inside], after[inside]] = at[inside]
            nxt[row, gone] = -1  # no longer live
            put(row, gone, np.full(len(row), NONE))
            put(row, at, pair(row, at, after))
            before = prv[row, at]
            some = before >= 0
            if some.any():
                put(row[some], before[some], pair(row[some], before[some], at[some]))
            row = row[tree[row, 1] != NONE]
        live = (nxt >= 0) & (spot[None, :] < size[:, None])
        return [ids[i, live[i]].tolist() for i in range(m)]

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none = int(NONE)
        ids = [int(self.start[b]) for b in piece]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        get, base = self.pairs.get, self.base

        def pair(left: int, right: int) -> int:
            r = get(ids[left] * base + ids[right]) if left >= 0 and right < n else None
            return none if r is None else r * width + left

        for i in range(n - 1):
            tree[width + i] = pair(i, i + 1)
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(at: int, value: int) -> None:
            i = at + width
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                tree[i] = a if a < b else b
                i >>= 1

        while tree[1] != none:
            rank, at = divmod(tree[1], width)
            gone = nxt[at]
            after = nxt[gone]
            ids[at], nxt[at], ids[gone] = rank, after, -1
            if after < n:
                prv[after] = at
            put(gone, none)
            put(at, pair(at, after))
            if prv[at] >= 0:
                put(prv[at], pair(prv[at], at))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into the table."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.memo[p] = rank.to_bytes(4, "little")
            elif len(raw) > WIDE:
                self.memo[p] = np.array(self.merge_one(raw), dtype="<u4").tobytes()
            else:
                classes.setdefault(1 << (len(raw) - 1).bit_length(), []).append((p, raw))
        for width, held in classes.items():
            for i in range(0, len(held), MANY):
                some = held[i:i + MANY]
                for (p, _), ids in zip(some, self.merge_many([r for _, r in some], width), strict=True):
                    self.memo[p] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in parts(text):
            pieces = self.find(part)
            self.know(pieces)
            out.append(self.join(pieces))
        return b"".join(out)

    def join(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.memo.__getitem__, pieces))
        except KeyError:  # the table was cleared for a long text of the same slice
            self.know(pieces)
            return b"".join(map(self.memo.__getitem__, pieces))

    def know(self, pieces: list[str]) -> None:
        distinct = set(pieces)
        new = [p for p in distinct if p not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(distinct)
        if new:
            self.learn(new)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def parts(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``limit`` characters that the pattern matches on their own."""
    start = 0
    while len(text) - start > limit:
        m = _CUT.search(text, start + limit)
        if m is None:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:] if start else text


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def ids_of(c: Coder, texts: list[str]) -> list[bytes]:
    """Ids of texts of one slice; the new pieces of all of them are merged together."""
    found = [c.find(t) if len(t) <= PART_CHARS else None for t in texts]
    c.know([p for f in found if f for p in f])
    return [c.encode(t) if f is None else c.join(f) for t, f in zip(texts, found, strict=True)]


def bpe_encode(docs: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, decode: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ids (binary, little-endian unsigned 32-bit integers).

    ``decode`` adds the bytes that the ids decode to, in the same worker.
    """

    def run(batch: pa.RecordBatch) -> dict:
        c = coder(vocab, pattern)
        ids = ids_of(c, batch.column("text").to_pylist())
        return {"id": batch.column("id"), "ids": ids, "decoded": [c.decode(x) for x in ids] if decode else None}

    schema = f"id {type_of(docs, id_col)}, ids binary" + ", decoded binary" * decode
    return map_text(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), "text", schema, run)


def bpe_decode(encoded: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """Adds the decoded bytes to rows of (id, ids)."""

    def run(batch: pa.RecordBatch) -> dict:
        c = coder(vocab, pattern)
        return {"id": batch.column("id"), "ids": batch.column("ids"), "decoded": [c.decode(x) for x in batch.column("ids").to_pylist()]}

    kind = type_of(encoded, "id")
    return map_text(encoded.select("id", "ids"), "ids", f"id {kind}, ids binary, decoded binary", run)


def bpe_digests(docs: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids, and digest both: id, n_tokens, ids_sha256, decoded_sha256."""
    both = bpe_encode(docs, vocab, pattern, id_col, text_col, decode=True)
    return both.select(
        "id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
