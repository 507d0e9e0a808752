"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a sample of its labelled texts. A text is
parsed against it into phrases, each the longest match from where the last one ended; phrases x
log2(length of the sample) / length of the text is the cross-parsing entropy. The language
with the smallest value wins; ties go to the first in alphabetical order.

A letter that the sample of a language lacks is a phrase of its own there; no two letters that any
sample holds share a symbol, so a language's value doesn't depend on which others there are.

The automata are sparse tables: the rows of all states lie over each other in one array, each cell
marked with its symbol (row displacement), so one look-up advances one position. Texts are cut into
lanes of ``BLOCK`` symbols, and all lanes of a batch advance together from the root. Then every lane
is advanced again from the state in which the lane before it ended, until both runs meet; so phrases
go on over the edges of lanes. All of every text is parsed, in memory bounded by the batch.

Bound of the sample: ``docs_per_lang`` labelled texts of each language, in order of a hash of
the text, texts of more than ``doc_chars`` characters last and then cut to that length. The
model is that sample, all of it: at most languages x docs_per_lang x doc_chars characters. Workers
build the automata from it, in memory that grows with the number of languages.

Null texts and texts without a letter give ``und`` with score 0. Empty tables give no rows; with
no labelled text at all every text gives ``und``. Repeated rows are scored each, and count once
in the sample. Score is the share of the winner in the sum of 2 ** -(entropy) over languages.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.llm.common import map_text, slices, spread, type_of

BLOCK = 256
UNKNOWN = "und"
_models: dict[str, Model] = {}


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``, by state; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nexts


class Table:
    """A suffix automaton in one array. A state is the place of its row; the root is at 0.

    Cell ``state + symbol`` holds next state x 2 ** shift + symbol. As no two rows begin at the same
    place, a cell with that symbol is the state's own; any other means that there is no transition.
    """

    def __init__(self, nexts: list[dict[int, int]], symbols: int) -> None:
        self.shift = symbols.bit_length()
        self.mask = (1 << self.shift) - 1
        size = np.array([len(to) for to in nexts], dtype=np.int64)
        ends = np.cumsum(size)
        symbol = np.fromiter((c for to in nexts for c in to), dtype=np.int64, count=ends[-1])
        to = np.fromiter((x for t in nexts for x in t.values()), dtype=np.int64, count=ends[-1])
        base = np.zeros(len(nexts), dtype=np.int64)
        room = max(64, 2 * int(ends[-1]))  # places at which rows may begin
        full, begun = np.zeros(room + symbols, dtype=bool), np.zeros(room, dtype=bool)
        full[symbol[: size[0]]] = begun[0] = True
        draw = np.random.default_rng(0)
        later = 1 + np.argsort(-size[1:], kind="stable")
        groups = np.split(later, np.flatnonzero(np.diff(np.ceil(np.log2(size[later] + 1)))) + 1)
        for todo in groups:  # large rows first; those that clash try another place
            tries = 0
            while len(todo):
                tries += 1
                if tries % 32 == 0:
                    full, begun = np.pad(full, (0, room // 2)), np.pad(begun, (0, room // 2))
                    room = len(begun)
                at = draw.integers(1, room, len(todo))
                row = np.repeat(np.arange(len(todo)), size[todo])
                entry = np.arange(len(row)) + np.repeat(ends[todo] - np.cumsum(size[todo]), size[todo])
                cell = at[row] + symbol[entry]
                ok = ~begun[at] & first(at)
                ok[row[full[cell] | ~first(cell)]] = False
                base[todo[ok]] = at[ok]
                begun[at[ok]] = True
                full[cell[ok[row]]] = True
                todo = todo[~ok]
        small = (int(base.max()) + 1) << self.shift < 2**31
        self.cells = np.full(len(full), self.mask, dtype=np.int32 if small else np.int64)
        self.cells[np.repeat(base, size) + symbol] = (base[to] << self.shift) + symbol
        self.restart = np.zeros(symbols, dtype=np.int64)
        self.restart[symbol[: size[0]]] = base[to[: size[0]]]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and where a symbol didn't go on with the phrase."""
        cell = self.cells[state + symbol]
        miss = (cell & self.mask) != symbol
        return np.where(miss, self.restart[symbol], cell >> self.shift), miss


def first(x: np.ndarray) -> np.ndarray:
    """Whether a value stands for the first time."""
    out = np.zeros(len(x), dtype=bool)
    out[np.unique(x, return_index=True)[1]] = True
    return out


class Model:
    """``block``: a phrase also ends after so many symbols (``BLOCK``); None: only where its match does."""

    def __init__(self, sample: dict[str, str], block: int | None = BLOCK) -> None:
        if block not in (BLOCK, None):
            raise ValueError(f"block is {BLOCK} or None")
        self.langs = sorted(sample)
        self.block = block
        letters = sorted({c for text in sample.values() for c in text.lower() if c.isalpha()})
        self.symbols = len(letters) + 2  # 0: run of other characters; the last: letters that no sample holds
        self.code = np.zeros(0x110000, dtype=np.min_scalar_type(self.symbols - 1))
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                self.code[i] = self.symbols - 1
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        coded = {k: self.encode(v) for k, v in sample.items()}
        self.tables = [Table(automaton(coded[k]), self.symbols) for k in self.langs]
        self.bits = [np.log2(max(2, len(coded[k]))) for k in self.langs]

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text; a run of characters that are no letters is one 0."""
        s = self.code[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)]
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep]

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text (rows) in each language (columns)."""
        per = np.array([-(-len(s) // BLOCK) for s in coded], dtype=np.int64)
        lanes = np.zeros((int(per.sum()), BLOCK), dtype=self.code.dtype)
        width = np.full(len(lanes), BLOCK, dtype=np.int64)
        goes_on = np.zeros(len(lanes), dtype=bool)  # the lane before is of the same text, and phrases cross its end
        at = 0
        for s, n in zip(coded, per, strict=True):
            if n:
                lanes[at:at + n].ravel()[: len(s)] = s
                width[at + n - 1] = len(s) - (n - 1) * BLOCK
                goes_on[at + 1:at + n] = self.block is None
                at += n
        order = np.argsort(-width, kind="stable")
        columns = np.ascontiguousarray(lanes[order].T)
        alive = np.searchsorted(-width[order], -np.arange(BLOCK), side="left")  # lanes longer than the column
        out = np.zeros((len(coded), len(self.langs)), dtype=np.int64)
        owner = np.repeat(np.arange(len(coded)), per)
        cut = np.append(~goes_on[1:], True)[: len(lanes)]  # the end of the lane ends a phrase
        for k, table in enumerate(self.tables):
            state = np.zeros(len(lanes), dtype=np.int64)
            n = np.zeros(len(lanes), dtype=np.int64)
            for j in range(BLOCK):
                m = alive[j]
                if not m:
                    break
                # A missing symbol after a known one ends two phrases: the one so far, and itself.
                new, miss = table.step(state[:m], columns[j, :m])
                n[:m] += miss
                n[:m] += (new == 0) & (state[:m] != 0)
                state[:m] = new
            end, total = np.empty_like(state), np.empty_like(n)
            end[order], total[order] = state, n
            if goes_on.any():
                self.join(table, lanes, width, goes_on, end, total)
            total += cut & (end != 0)
            out[:, k] = np.bincount(owner, weights=total, minlength=len(coded)).astype(np.int64)
        return out

    def join(self, table: Table, lanes: np.ndarray, width: np.ndarray, goes_on: np.ndarray, end: np.ndarray, total: np.ndarray) -> None:
        """Makes ``end`` and ``total`` of lanes begun at the root those of lanes begun where the one before ends.

        Only as many positions are worked through as it takes until the run from the true state meets
        the run from the root. A second pass, lane by lane, mends those whose run before didn't meet.
        """
        on = np.flatnonzero(goes_on)
        true, root = end[on - 1], np.zeros(len(on), dtype=np.int64)
        begun = np.zeros_like(end)  # the state from which a lane's values were worked out
        begun[on] = true
        for j in range(BLOCK):
            over = width[on] <= j
            if over.any():
                end[on[over]] = true[over]
                on, true, root = on[~over], true[~over], root[~over]
            apart = true != root
            on, true, root = on[apart], true[apart], root[apart]
            if not len(on):
                break
            c = lanes[on, j]
            for state, sign in ((true, 1), (root, -1)):
                new, miss = table.step(state, c)
                total[on] += sign * (miss.astype(np.int64) + ((new == 0) & (state != 0)))
                state[:] = new
        apart = true != root
        end[on[apart]] = true[apart]
        heap = (np.flatnonzero(goes_on[1:] & (begun[1:] != end[:-1])) + 1).tolist()
        cells, restart, shift, mask = table.cells, table.restart, table.shift, table.mask
        while heap:
            i = heapq.heappop(heap)
            runs = [int(end[i - 1]), int(begun[i])]
            begun[i] = end[i - 1]
            for c in lanes[i, : width[i]].tolist():
                if runs[0] == runs[1]:
                    break
                for r, sign in ((0, 1), (1, -1)):
                    cell = int(cells[runs[r] + c])
                    if cell & mask == c:
                        runs[r] = cell >> shift
                    else:
                        new = int(restart[c])
                        total[i] += sign * (1 + (new == 0 and runs[r] != 0))
                        runs[r] = new
            if runs[0] != runs[1]:
                end[i] = runs[0]
                if i + 1 < len(end) and goes_on[i + 1] and (not heap or heap[0] != i + 1):
                    heapq.heappush(heap, i + 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        coded = [self.encode(t) if t else np.zeros(0, dtype=self.code.dtype) for t in texts]
        size = np.array([len(s) for s in coded])
        letters = np.array([bool(s.any()) for s in coded], dtype=bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        rate = self.phrases(coded) * np.array(self.bits) / np.maximum(size, 1)[:, None]
        best = rate.argmin(axis=1)
        share = 1 / np.exp2(rate[np.arange(len(rate)), best][:, None] - rate).sum(axis=1)
        return (
            [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)],
            [float(x) if ok else 0.0 for x, ok in zip(share, letters, strict=True)],
        )


def name_of(sample: dict[str, str]) -> str:
    return hashlib.sha256(repr(sorted(sample.items())).encode()).hexdigest()


def model_of(key: str, sample: dict[str, str]) -> Model:
    if key not in _models:
        _models.clear()
        _models[key] = Model(sample, block=None)
    return _models[key]


def language_sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, docs_per_lang: int = 32, doc_chars: int = 1500) -> dict[str, str]:
    """The bounded sample of labelled rows: language -> text.

    Copies are one entry before entries are numbered, and numbering keeps docs_per_lang entries of
    a language in each task before it shuffles. Texts are fetched for the chosen entries only.
    """
    t = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text rlike '\\\\p{L}'")
    t = t.withColumn("long", F.length("text") > doc_chars).withColumn("hash", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("long", "hash")
    chosen = stable(t.select("lang", "long", "hash").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs_per_lang))
    rows = (
        t.join(chosen, ["lang", "long", "hash"]).withColumn("text", spread("text", doc_chars))
        .groupBy("lang", "n").agg(F.min("text").alias("text")).collect()
    )
    by: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["n"], r["text"]))
    return {k: "\n".join(x for _, x in sorted(v)) for k, v in by.items()}


def identify(docs: DataFrame, sample: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score."""
    key = name_of(sample)
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batch: pa.RecordBatch) -> dict:
        lang, score = model_of(key, shared.value).predict(batch.column("text").to_pylist())
        return {"id": batch.column("id"), "lang_pred": lang, "score": score}

    kind = type_of(docs, id_col)
    return map_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", f"id {kind}, lang_pred string, score double", run)


def keep_identified(docs: DataFrame, sample: dict[str, str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language (is not ``und``), with that language in ``lang_col``.

    With an empty sample no text has one; then only null texts and texts without a letter go, and
    the column keeps what it says.
    """
    key = name_of(sample)
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    @F.arrow_udf("string")
    def language_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            found = []
            for s in slices(pa.record_batch([b], names=["text"]), "text"):
                model, texts = model_of(key, shared.value), s.column("text").to_pylist()
                found += model.predict(texts)[0] if model.langs else ["" if t and model.encode(t).any() else UNKNOWN for t in texts]
            yield pa.array(found, pa.string())

    # only texts go to Python and only languages come back; not deterministic, so that it is worked out once
    named = docs.select(F.struct("*").alias("row"), language_of.asNondeterministic()(F.col(text_col).cast("string")).alias("found"))
    new = F.when(F.col("found") != "", F.col("found")).otherwise(F.col("row")[lang_col]).cast(type_of(docs, lang_col)) if lang_col in docs.columns else None
    return named.where(F.col("found") != UNKNOWN).select(*[(new if c == lang_col else F.col("row")[c]).alias(c) for c in docs.columns])
