"""Toxicity of texts: logistic regression over hashed word n-grams and skip-grams, fitted
by FTRL-proximal steps.

Every bucket has its own learning rate, which falls with its gradients so far, and an L1
term that leaves most weights at zero; only the others are broadcast. The fit takes SAMPLE
labelled texts at most (see frames.learn_rows). Scoring covers every text whole.

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
NGRAMS = Ngrams(bits=22, skips=1)


def held_out(key: Column) -> Column:
    return remainder(key, 4) == 2


class Ftrl:
    """The state of the optimiser: z and n for each feature; the bias is not penalised."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        over = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -over / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def bias(self) -> float:
        return -self.bias_z * self.alpha / (self.beta + self.bias_n**0.5)

    def step(self, features: np.ndarray, y: float) -> None:
        z, n = self.z[features], self.n[features]
        w, bias = self.weights(z, n), self.bias()
        g = 1 / (1 + np.exp(-min(max(w.sum() + bias, -30.0), 30.0))) - y
        more = n + g * g
        self.z[features] = z + g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[features] = more
        more = self.bias_n + g * g
        self.bias_z += g - (more**0.5 - self.bias_n**0.5) / self.alpha * bias
        self.bias_n = more


def fit_arrays(y: np.ndarray, begins: np.ndarray, buckets: np.ndarray, ngrams: Ngrams = NGRAMS, rounds: int = 3, seed: int = 5) -> Linear:
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Linear(ngrams, np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    known, place = numbered(buckets, ngrams.bits)
    state, order = Ftrl(len(known)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            state.step(place[begins[i] : begins[i + 1]], float(y[i]))
    w = state.weights(state.z, state.n)
    kept = w != 0
    return Linear(ngrams, known[kept].astype(np.int64), w[kept].astype(np.float32), state.bias())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", holdout=held_out, most: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Linear:
    return fit_arrays(*sample_features(docs, learn_rows(labels, label, holdout, most, key), NGRAMS, key, text))


def score(docs: DataFrame, model: Linear, text: str = "text") -> Column:
    return score_column(docs.sparkSession, model)(F.col(text))
