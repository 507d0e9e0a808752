"""Toxicity: logistic model on character 5-grams scaled by naive Bayes log-count ratios.

Letter case and the kind of white space don't count. The bounded sample, nulls, empty and long
texts are as wattline.llm.linear says. Repeated rows are scored each, equal texts alike (no ties to
break); empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from wattline.llm import linear

N = 5


def words(found: list[str], before: str) -> list[str]:
    return [w.lower() for w in found]


def logistic(values: list[np.ndarray], slots: list[np.ndarray], positive: np.ndarray, steps: int = 80, rate: float = 200.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps; both classes weigh the same.

    The number of steps is the regularisation: features outnumber rows, so the loss itself has no
    useful minimum. It is a fixed parameter and no search for convergence.
    """
    columns, at = np.unique(np.concatenate(slots), return_inverse=True)
    v, row = np.concatenate(values), np.repeat(np.arange(len(slots)), [len(x) for x in slots])
    y = positive.astype(float)
    share = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    w = ahead = np.zeros(len(columns))
    b = 0.0
    for k in range(steps):
        z = np.bincount(row, weights=v * ahead[at], minlength=len(slots)) + b
        g = (1 / (1 + np.exp(-z)) - y) * share
        step = ahead - rate * (np.bincount(at, weights=v * g[row], minlength=len(columns)) + decay * ahead)
        b -= 0.05 * rate * g.sum()
        ahead = step + k / (k + 3) * (step - w)
        w = step
    out = np.zeros(1 << linear.SLOT_BITS)
    out[columns] = w
    return out, b


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, per_class: int = 1500, doc_chars: int = 16384) -> DataFrame:
    """One row per row of ``docs``: id, score."""
    rows = linear.sample(docs, labels, label_col, learn, per_class, doc_chars, id_col, text_col)
    model = linear.fitted(rows, logistic, N, words)
    return linear.scored(docs, model, 1.0, N, words, id_col, text_col)
