"""Token counts of whole texts under a public tokenizer file.

Arrow functions encode batches and return lengths only. Batches are balanced by bytes, not by
rows. A long text is split at ASCII white space, which the vocabulary drops and which no piece
spans (white space starts no composition and ends every pre-token), so the counts of the parts
add up to the count of the whole; a run without white space is never cut. Within a batch equal
pieces are encoded once, and a bounded table keeps the lengths of pieces already seen.

Null and empty texts have no bytes and no tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import SLICE_BYTES, map_text, text_of, type_of

PART_BYTES = 1 << 20
MEMO = 400_000
_SPACE = re.compile(rb"[ \t\n\r\f\v]")
_models: dict[str, tuple] = {}


def parts(text: bytes, limit: int = PART_BYTES) -> Iterator[bytes]:
    """The text in parts of about ``limit`` bytes that end at white space."""
    start = 0
    while len(text) - start > limit:
        m = _SPACE.search(text, start + limit)
        if m is None:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:] if start else text


def _model(path: str) -> tuple:
    if path not in _models:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _models[path] = (Tokenizer.from_file(path), {})
    return _models[path]


def count_batch(path: str, texts: list[bytes], memo_limit: int = MEMO) -> list[int]:
    """Token counts of texts, in batches of about SLICE_BYTES whatever the lengths of the texts."""
    model, memo = _model(path)
    out = [0] * len(texts)

    def flush(held: list[tuple[int, list[bytes]]]) -> None:
        pieces = set().union(*(p for _, p in held))
        new = [p for p in pieces if p not in memo]
        if len(memo) + len(new) > memo_limit:
            memo.clear()
            new = list(pieces)
        memo.update(zip(new, map(len, model.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)), strict=True))
        for i, p in held:
            out[i] += sum(map(memo.__getitem__, p))

    held, size = [], 0
    for i, text in enumerate(texts):
        for part in parts(text):
            held.append((i, part.split()))
            size += len(part)
            if size >= SLICE_BYTES:
                flush(held)
                held, size = [], 0
    flush(held)
    return out


def token_counts(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        n = count_batch(vocab, texts)
        return {"id": batch.column("id"), "n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    kind = type_of(docs, id_col)
    return map_text(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), "text", f"id {kind}, n_bytes long, n_tokens long, over_limit boolean", run)
