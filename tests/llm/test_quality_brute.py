"""The quality classifier's features, prior and every step of its fit against loops over plain numbers."""

import math
import random

import numpy as np
from tracewright.llm import quality


def texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(1, 9))) for _ in range(80)]
    good = [" ".join(r.choices(words, k=r.randint(5, 60))).capitalize() + "." for _ in range(n)]
    bad = [" ".join(w.upper() + r.choice(["!!", " | ", " 99"]) for w in r.choices(words[:6], k=r.randint(5, 60))) + "\nsame\nsame" for _ in range(n)]
    return good, bad


def plain_features(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(text))
    letters = max(1, sum(c.isalpha() for c in text))
    times = {w: words.count(w) for w in words}
    return [
        math.log1p(len(words)), sum(len(w) for w in words) / n, len(times) / n * math.log1p(n), max(times.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(c.isupper() for c in text) / letters, sum(c.isdigit() for c in text) / size, text.count("!") / size, text.count("|") / size, sum(c in "#$%&*+<=>@^_`{}~\\" for c in text) / size,
        (text.count(".") + text.count(",")) / n, 0.0, math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), sum(w.isupper() for w in words) / n, math.log1p(max(map(len, words), default=0)),
    ]


def test_features():
    good, bad = texts(20, 1)
    for t in [*good, *bad, "", " \n ", "a"]:
        assert np.allclose(quality.features(t.encode()), plain_features(t))


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def quantile(values, at):
    values = sorted(values)
    place = at * (len(values) - 1)
    low = math.floor(place)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (place - low)


def plain_prior(positive, unlabelled):
    best = 1.0
    for k in range(91):
        at = quantile(positive, 1 - (0.1 + 0.01 * k))
        p, u = (sum(x >= at for x in xs) / len(xs) for xs in (positive, unlabelled))
        slack = math.sqrt(u * (1 - u) / len(unlabelled)) + u / p * math.sqrt(p * (1 - p) / len(positive))
        best = min(best, (u + slack) / p)
    return min(0.98, max(0.05, best))


def plain_fit(positive, unlabelled, steps, rate):
    d = len(positive[0])
    mean = [sum(x[i] for x in unlabelled) / len(unlabelled) for i in range(d)]
    scale = [math.sqrt(sum((x[i] - mean[i]) ** 2 for x in unlabelled) / len(unlabelled)) + 1e-3 for i in range(d)]

    def design(x):
        z = [max(-4.0, min(4.0, (x[i] - mean[i]) / scale[i])) for i in range(d)]
        return [1.0, *z, *(z[i] * z[j] / 4 for i in range(d) for j in range(i, d))]

    p, u = [design(x) for x in positive], [design(x) for x in unlabelled]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    decay, size = 3 / len(p), len(p[0])

    def descend(gradient, steps):
        w, m, v = [0.0] * size, [0.0] * size, [0.0] * size
        for t in range(1, steps + 1):
            for i, g in enumerate(gradient(w)):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] -= rate * (m[i] / (1 - 0.9**t)) / (math.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return w

    def mean_of(rows, weights):
        return [sum(a * row[i] for a, row in zip(weights, rows, strict=True)) / len(rows) for i in range(size)]

    def apart(w):
        a, b = mean_of(p, [sigmoid(dot(x, w)) - 1 for x in p]), mean_of(u, [sigmoid(dot(x, w)) for x in u])
        return [x + y + decay * z for x, y, z in zip(a, b, w, strict=True)]

    first = descend(apart, steps // 2)
    prior = plain_prior([dot(x, first) for x in p], [dot(x, first) for x in u])
    turned = []

    def risk(w):
        loss = lambda rows: sum(math.log1p(math.exp(dot(x, w))) for x in rows) / len(rows)
        minus = [a - prior * b for a, b in zip(mean_of(u, [sigmoid(dot(x, w)) for x in u]), mean_of(p, [sigmoid(dot(x, w)) for x in p]), strict=True)]
        turned.append(loss(u) - prior * loss(p) < 0)
        if turned[-1]:
            return [-x for x in minus]
        plus = mean_of(p, [sigmoid(dot(x, w)) - 1 for x in p])
        return [prior * a + b + decay * z for a, b, z in zip(plus, minus, w, strict=True)]

    return descend(risk, steps), prior, turned


def test_every_step_of_the_fit():
    good, bad = texts(14, 2)
    seen = set()
    for share, steps in ((0.5, 8), (0.05, 24)):
        cut = max(1, int(14 * share * 2))
        positive, unlabelled = [plain_features(t) for t in good[:7]], [plain_features(t) for t in good[7:] + bad[:cut]]
        weights, prior, turned = plain_fit(positive, unlabelled, steps, 0.05)
        model = quality.fit(np.array(positive), np.array(unlabelled), steps=steps)
        assert abs(model.prior - prior) < 1e-9 and np.allclose(model.weights, weights, atol=1e-7)
        seen |= set(turned)
    assert False in seen
