"""The learners of the two classifiers against plain versions, on small inputs."""

import math
import random

import numpy as np
import pytest

from riskfeat.llm import quality, toxicity
from riskfeat.llm.linear import Ngrams


def sample(n=60, features=25, seed=1):
    """(labels, begins, buckets): each text's distinct features; the first few tell the label."""
    rng = random.Random(seed)
    y, begins, buckets = [], [0], []
    for _ in range(n):
        label = rng.random() < 0.4
        held = {f for f in range(features) if rng.random() < (0.7 if (f < 5) == label else 0.2)}
        y.append(int(label))
        buckets += sorted(held)
        begins.append(len(buckets))
    return np.array(y), np.array(begins), np.array(buckets, np.int64)


def test_log_count_ratios_by_hand():
    y, begins, buckets = sample()
    got = quality.log_count_ratios(y, begins, buckets, 25)
    texts = [set(buckets[i:j].tolist()) for i, j in zip(begins, begins[1:])]
    totals = [sum(len(t) for t, label in zip(texts, y) if label == c) for c in (0, 1)]
    for f in range(25):
        n0, n1 = (sum(f in t for t, label in zip(texts, y) if label == c) for c in (0, 1))
        want = math.log((n1 + 1) / (totals[1] + 25)) - math.log((n0 + 1) / (totals[0] + 25)) if n0 + n1 >= 2 else 0
        assert got[f] == pytest.approx(want)


def test_dual_descent_reaches_the_optimum():
    """Against plain subgradient descent on the primal, and by the gap to the dual."""
    y, begins, buckets = sample()
    sign, cost = 2.0 * y - 1, np.full(len(y), 0.5)
    values = np.ones(len(buckets))
    w, bias = quality.dual_coordinate_descent(sign, begins, buckets, values, 25, cost, rounds=2000)
    x = np.zeros((len(y), 26))
    for i, (a, b) in enumerate(zip(begins, begins[1:])):
        x[i, buckets[a:b]] = 1
    x[:, 25] = 1  # the bias is the weight of a feature that all texts have

    def primal(v):
        return v @ v / 2 + 0.5 * np.maximum(1 - sign * (x @ v), 0).sum()

    plain, best = np.zeros(26), np.inf
    for t in range(1, 40_001):
        inside = sign * (x @ plain) < 1
        plain = plain - (plain - 0.5 * (sign[inside, None] * x[inside]).sum(axis=0)) / t
        best = min(best, primal(plain))
    ours = primal(np.append(w, bias))
    assert best * 0.99 <= ours <= best * 1.01


def test_ftrl_equals_one_coordinate_at_a_time():
    y, begins, buckets = sample(seed=2)
    state = toxicity.Ftrl(25, l1=0.5)
    z, n, bias_z, bias_n = [0.0] * 25, [0.0] * 25, 0.0, 0.0

    def weight(f):
        if abs(z[f]) <= state.l1:
            return 0.0
        return -(z[f] - math.copysign(state.l1, z[f])) / ((state.beta + math.sqrt(n[f])) / state.alpha + state.l2)

    for label, a, b in zip(y, begins, begins[1:]):
        features = buckets[a:b].tolist()
        bias = -bias_z * state.alpha / (state.beta + math.sqrt(bias_n))
        g = 1 / (1 + math.exp(-(sum(map(weight, features)) + bias))) - label
        for f in features:
            w, sigma = weight(f), (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / state.alpha
            z[f] += g - sigma * w
            n[f] += g * g
        sigma = (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / state.alpha
        bias_z, bias_n = bias_z + g - sigma * bias, bias_n + g * g
        state.step(buckets[a:b], float(label))
        assert state.z == pytest.approx(z) and state.n == pytest.approx(n)
    got = state.weights(state.z, state.n)
    assert got == pytest.approx([weight(f) for f in range(25)]) and (got == 0).any()


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_labels_of_one_class_and_none(operator):
    import pyarrow as pa

    ngrams = Ngrams(bits=8)
    _, begins, buckets = sample()
    only = operator.fit_arrays(np.ones(60, int), begins, buckets, ngrams)
    none = operator.fit_arrays(np.zeros(0, int), np.zeros(1, int), np.zeros(0, np.int64), ngrams)
    texts = pa.array(["a b", None, "", "x " * 200_000])
    assert (only.score(texts) > 0.99).all() and none.score(texts) == pytest.approx([0.5] * 4)
    assert len(none.score(pa.array([], pa.string()))) == 0


def test_scores_equal_sums_by_bucket():
    """Weights are found by counting the buckets before them; none, the first, the last and all buckets."""
    import pyarrow as pa

    from riskfeat.llm.linear import Linear

    texts = ["a b c d", None, "", "b a a b", " ".join(f"w{i}" for i in range(500))]
    for bits in (4, 8, 12):
        ngrams, rng = Ngrams(bits=bits, skips=1, repeats=True), np.random.default_rng(bits)
        size = 1 << bits
        for held in ([], [0, size - 1], sorted(rng.choice(size, size // 3, replace=False)), range(size)):
            held = np.array(held, np.int64)
            weights, scales = rng.normal(size=(2, len(held))).astype(np.float32)
            for given in (None, scales):
                got = Linear(ngrams, held, weights, 0.5, given, 1.5, -0.25).score(pa.array(texts, pa.string()))
                weight, scale = dict(zip(held.tolist(), weights.tolist())), dict(zip(held.tolist(), scales.tolist()))
                for first, n, text, bucket in ngrams.blocks(pa.array(texts, pa.string())):
                    for t in range(n):
                        own = [b for b in bucket[text == t].tolist() if b in weight]
                        margin = sum(weight[b] for b in own)
                        if given is not None:
                            margin /= math.sqrt(max(sum(scale[b] ** 2 for b in own), 1e-12))
                        assert got[first + t] == pytest.approx(1 / (1 + math.exp(-(1.5 * (margin + 0.5) - 0.25))))


def test_a_model_and_hashes_take_little_memory():
    """Texts of 4 MB under a model of 22 bits: tables of all values and blocks of 1 MB took over 70 MB."""
    import tracemalloc

    import pyarrow as pa

    from riskfeat.llm import hashing
    from riskfeat.llm.linear import Linear

    held = np.arange(0, 1 << 22, 16)
    model = Linear(Ngrams(bits=22, repeats=True), held, np.ones(len(held), np.float32), 0.0, np.ones(len(held), np.float32))
    texts = pa.array([" ".join(f"w{i * j % 997}" for i in range(400)) for j in range(2000)])
    hashing.forget()
    tracemalloc.start()
    model.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and hashing._powers.cache_info().currsize == 0
