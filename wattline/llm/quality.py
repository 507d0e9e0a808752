"""Quality: naive Bayes support vectors on character 4-grams.

Indicators of n-grams are scaled by the log-count ratios of the classes; a linear model with
hinge loss is fitted to them by dual coordinate descent. Letter case counts. A word equal to the
one before it is read as a mark, so that repetition has n-grams of its own. The score is the logistic function
of ``SLOPE`` times the margin. The bounded sample, nulls, empty and long texts are as
wattline.llm.linear says. Repeated rows are scored each, equal texts alike (no ties to break); empty
tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from wattline.llm import linear

N = 4
SLOPE = 3.0
MARK = "\x01"


def words(found: list[str], before: str) -> list[str]:
    return [MARK if w == b else w for w, b in zip(found, [before, *found], strict=False)]


def hinge(values: list[np.ndarray], slots: list[np.ndarray], positive: np.ndarray, cost: float = 1.0, epochs: int = 2000, eps: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias by dual coordinate descent: one multiplier per row, clipped to [0, cost].

    Rows are visited in a new order, from a fixed seed, in every epoch; ends when no multiplier is
    further than ``eps`` from its optimum; not to get there is an error. The bias is the weight of a feature that all rows have.
    """
    w, b = np.zeros(1 << linear.SLOT_BITS), 0.0
    y = np.where(positive, 1.0, -1.0)
    alpha = np.zeros(len(y))
    norm = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(y)):
            g = y[i] * (values[i] @ w[slots[i]] + b) - 1.0
            free = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == cost else g
            worst = max(worst, abs(free))
            if free:
                old = alpha[i]
                alpha[i] = min(max(old - g / norm[i], 0.0), cost)
                d = (alpha[i] - old) * y[i]
                w[slots[i]] += d * values[i]
                b += d
        if worst < eps:
            return w, b
    raise ArithmeticError(f"no optimum within {eps} after {epochs} epochs")


def quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, per_class: int = 1500, doc_chars: int = 16384) -> DataFrame:
    """One row per row of ``docs``: id, score."""
    rows = linear.sample(docs, labels, label_col, learn, per_class, doc_chars, id_col, text_col)
    model = linear.fitted(rows, hinge, N, words)
    return linear.scored(docs, model, SLOPE, N, words, id_col, text_col)
