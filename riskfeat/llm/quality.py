"""Quality of texts: a linear hinge-loss model over n-gram indicators that are scaled by
their class log-count ratios (naive Bayes support vectors), fitted by dual coordinate
descent.

The fit takes SAMPLE labelled texts at most (see frames.learn_rows), a fifth of which only
turn the margins into scores. Scoring covers every text whole.

Defined results: a null text is an empty text; an empty text has the score of the bias
alone; without labels of both classes every score is the share of label 1 (0.5 without
any label); repeated rows get the same score; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.llm.frames import learn_rows, remainder
from riskfeat.llm.linear import Linear, Ngrams, numbered, sample_features, score_column

SAMPLE = 8_000
NGRAMS = Ngrams(bits=22, lower=False, repeats=True)


def held_out(key: Column) -> Column:
    return remainder(key, 5) == 0


def constant(share: float, ngrams: Ngrams) -> Linear:
    none = np.zeros(0, np.int64)
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Linear(ngrams, none, none.astype(np.float32), float(np.log(share / (1 - share))))


def log_count_ratios(y: np.ndarray, begins: np.ndarray, buckets: np.ndarray, size: int) -> np.ndarray:
    """log of the smoothed share of a bucket in class 1 over that in class 0; a bucket in
    fewer than two texts says nothing and gets 0."""
    of = np.repeat(y, np.diff(begins))
    ones, zeros = (np.bincount(buckets[of == c], minlength=size).astype(float) for c in (1, 0))
    ratio = np.log((ones + 1) / (ones.sum() + size)) - np.log((zeros + 1) / (zeros.sum() + size))
    return np.where(ones + zeros >= 2, ratio, 0.0)


def dual_coordinate_descent(y, begins, buckets, values, size: int, cost, rounds: int = 12, seed: int = 7):
    """L1-loss support vectors; y is +1 or -1, ``cost`` the bound of each text's alpha. The
    bias is the weight of a feature that is 1 in every text."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    rows = [(buckets[i:j], values[i:j]) for i, j in zip(begins, begins[1:])]
    norms = np.array([v @ v + 1 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            idx, v = rows[i]
            gradient = y[i] * (w[idx] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[idx] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and shift by Newton steps on the log loss, with smoothed targets."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    beta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit_arrays(y: np.ndarray, begins: np.ndarray, buckets: np.ndarray, ngrams: Ngrams = NGRAMS, cost: float = 10.0) -> Linear:
    if len(y) == 0 or y.min() == y.max() or np.bincount(y, minlength=2).min() < 5:
        return constant(float(y.mean()) if len(y) else 0.5, ngrams)
    known, place = numbered(buckets, ngrams.bits)
    fitted = np.random.default_rng(3).random(len(y)) < 0.8
    parts = {}
    for name, mask in (("fit", fitted), ("rest", ~fitted)):
        lengths = np.diff(begins)[mask]
        parts[name] = (y[mask], np.concatenate([[0], np.cumsum(lengths)]), place[np.repeat(mask, np.diff(begins))])
    ratios = log_count_ratios(*parts["fit"], len(known))

    def scaled(begins, place):
        values = ratios[place]
        n = len(begins) - 1
        text = np.repeat(np.arange(n), np.diff(begins))
        return values / np.sqrt(np.maximum(np.bincount(text, values**2, n), 1e-12))[text]

    fy, fb, fp = parts["fit"]
    share = fy.mean()
    bounds = np.where(fy == 1, cost * 0.5 / share, cost * 0.5 / (1 - share))
    w, bias = dual_coordinate_descent(2.0 * fy - 1, fb, fp, scaled(fb, fp), len(known), bounds)
    ry, rb, rp = parts["rest"]
    margins = np.bincount(np.repeat(np.arange(len(ry)), np.diff(rb)), w[rp] * scaled(rb, rp), len(ry)) + bias
    slope, shift = sigmoid_fit(margins, ry) if ry.min() != ry.max() else (1.0, 0.0)
    kept = ratios != 0
    return Linear(ngrams, known[kept].astype(np.int64), (w * ratios)[kept].astype(np.float32), float(bias), ratios[kept].astype(np.float32), slope, shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", holdout=held_out, most: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Linear:
    return fit_arrays(*sample_features(docs, learn_rows(labels, label, holdout, most, key), NGRAMS, key, text))


def score(docs: DataFrame, model: Linear, text: str = "text") -> Column:
    return score_column(docs.sparkSession, model)(F.col(text))
