"""Expectation-maximisation and choice of languages against plain loops over words."""

import math

import numpy as np

from packetlake.llm.mixture import BUCKETS, PENALTY, STEPS, TEMPER, LanguageModel, proportions, word_grams

TEXTS = ["alpha beta gamma", "", "12 34 !", "delta", "epsilon zeta eta theta iota kappa lambda mu nu xi", "alpha alpha delta zeta " * 9, "ÄÖ ß été"]


def plain(log_p, text):
    """Shares, number of words and gain of one text, word by word."""
    gram, begins, _ = word_grams([text])
    words = [gram[a:b] for a, b in zip(begins, begins[1:])]
    k = log_p.shape[1]
    if not words:
        return [0.0] * k, 0, 0.0
    logs = [[TEMPER * math.fsum(float(log_p[g, j]) for g in word) for j in range(k)] for word in words]
    allowed, best = list(range(k)), None
    while allowed:
        theta = {j: 1 / len(allowed) for j in allowed}
        for _ in range(STEPS if len(allowed) > 1 else 0):
            total = dict.fromkeys(allowed, 0.0)
            for row in logs:
                part = {j: theta[j] * math.exp(row[j] - max(row)) for j in allowed}
                for j in allowed:
                    total[j] += part[j] / sum(part.values())
            theta = {j: total[j] / len(words) for j in allowed}
        value = math.fsum(math.log(sum(theta[j] * math.exp(row[j] - max(row)) for j in allowed)) for row in logs)
        value -= PENALTY * (len(allowed) - 1) * math.log(len(words) + 1)
        if best is None or value > best[0]:
            best = value, theta
        allowed.remove(min(allowed, key=lambda j: theta[j]))
    theta = best[1]
    told = 0.0
    for row in logs:
        part = {j: theta[j] * math.exp(row[j] - max(row)) for j in theta}
        told += sum(part[j] * row[j] for j in theta) / sum(part.values()) / TEMPER
    return [theta.get(j, 0.0) for j in range(k)], len(words), told / sum(map(len, words)) + math.log(BUCKETS)


def test_shares_equal_plain_loops():
    draw = np.random.default_rng(5)
    for k in (1, 2, 4):
        # Buckets that the languages like unequally, by a little or a lot.
        for spread in (0.2, 2.0):
            log_p = (-math.log(BUCKETS) + spread * draw.standard_normal((BUCKETS, k))).astype(np.float32)
            shares, n_words, gain = proportions(LanguageModel(tuple("abcd"[:k]), log_p), TEXTS)
            for i, text in enumerate(TEXTS):
                wanted = plain(log_p, text)
                assert n_words[i] == wanted[1]
                assert np.allclose(shares[i], wanted[0], atol=1e-4), (k, spread, text)
                assert abs(gain[i] - wanted[2]) < 1e-3
