"""The toxicity classifier against loops, its gradients, misspellings it never saw, and awkward rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tracewright.llm import toxicity as tox

BAD = ("moron", "stupid", "worthless", "pathetic")


def plain_words(text):
    """Runs of letters and digits, with the signs that stand between two of them."""
    text, out, now = text.lower(), [], ""
    good = [ord(c) > 127 or c.isalnum() for c in text]
    for i, c in enumerate(text):
        joins = c in tox.JOINERS and 0 < i < len(text) - 1 and good[i - 1] and good[i + 1]
        if good[i] or joins:
            now += c
        elif now:
            out.append(now)
            now = ""
    return [*out, now] if now else out


def plain_bucket(codes, n):
    h = (sum(c * pow(tox.PRIME, k, 1 << 64) for k, c in enumerate(codes)) + n) * int(tox.MIX) % (1 << 64)
    return ((h ^ (h >> 29)) * int(tox.MIX) % (1 << 64)) >> (64 - tox.BITS)


def plain_rows(word):
    edged = [32, *map(ord, word), 32]
    return [plain_bucket(edged[1:-1], 0)] + [plain_bucket(edged[i : i + n], n) for n in tox.GRAMS for i in range(len(edged) - n + 1)]


def plain_score(model, text):
    words = plain_words(text)
    windows = [words[a : a + tox.WINDOW] for a in range(0, max(1, len(words) - tox.WINDOW // 2), tox.WINDOW // 2)]
    best = -1e9
    for window in windows:
        mean = np.zeros(tox.DIM)
        for w in set(window):
            rows = plain_rows(w)
            mean += sum(model.vectors[r] for r in rows) / len(rows) / tox.WINDOW
        z = mean @ model.weights + model.bias
        best = max(best, z[1] - z[0])
    return 1 / (1 + np.exp(-best))


def some_model(seed=3):
    r = np.random.default_rng(seed)
    return tox.Model(r.normal(0, 1, (1 << tox.BITS, tox.DIM)), r.normal(0, 1, (tox.DIM, 2)), np.array([0.3, -0.2]))


TEXTS = ["", " ", "!!", "a", "I'm -not- a m@ron, YOU!are", "é ñandú 😀😀 x" * 9, "one two " * 40, "İ ß \x00   end", " ".join("w%d" % i for i in range(100)), "x" * 300 + "-" + "y" * 300]


def test_scores_against_loops(monkeypatch):
    model = some_model()
    table, bias = model.table()
    for text in TEXTS:
        assert tox.words_of(text) == plain_words(text)
        got = 1 / (1 + np.exp(-(tox.worst(*tox.word_scores(text, table)) + bias)))
        assert abs(got - plain_score(model, text)) < 1e-9
    whole = tox.word_scores(TEXTS[8], table)
    monkeypatch.setattr(tox, "PIECE", 50)  # a text in many pieces
    assert all(np.array_equal(a, b) for a, b in zip(tox.word_scores(TEXTS[8], table), whole, strict=True))


def test_gradients():
    r = np.random.default_rng(1)
    model = tox.Model(r.normal(0, 1, (20, 3)), r.normal(0, 1, (3, 2)), r.normal(0, 1, 2))
    ids, shares, rows, labels = r.integers(0, 20, 60), r.random(60) / 10, np.sort(r.integers(0, 5, 60)), np.array([0, 1, 1, 0, 1])
    loss, used, g, gw, gb = tox.step(model, ids, shares, rows, labels)
    mean = [sum((shares[k] * model.vectors[ids[k]] for k in range(60) if rows[k] == i), np.zeros(3)) for i in range(5)]
    z = [m @ model.weights + model.bias for m in mean]
    assert abs(loss - np.mean([np.log(np.exp(a).sum()) - a[y] for a, y in zip(z, labels, strict=True)])) < 1e-9
    for array, at, got in [(model.vectors, (used[2], 1), g[2, 1]), (model.weights, (1, 0), gw[1, 0]), (model.bias, (1,), gb[1])]:
        array[at] += 1e-6
        assert abs((tox.step(model, ids, shares, rows, labels)[0] - loss) / 1e-6 - got) < 1e-4
        array[at] -= 1e-6


def corpus(n=900):
    r = random.Random(6)
    words = ["".join(r.choices("abcdeghiklmnoprstu", k=r.randint(2, 9))) for _ in range(700)]
    rows, labels = [], []
    for i in range(n):
        text = r.choices(words, k=r.choice([3, 20, 60, 400]))
        if i % 4 == 0:
            bad = r.choice(BAD)
            at = r.randrange(len(bad) - 1)
            if i % 12 == 0:  # a misspelling
                bad = bad[:at] + r.choice("xqz0") + bad[at + 1 :] if r.random() < 0.5 else bad[:at] + bad[at] + bad[at:]
            text[r.randrange(len(text))] = bad
        if i % 4 == 1:
            text += [r.choice(words)] * 200
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def test_held_out_rows_and_misspellings(spark):
    rows, labels = corpus()
    df, told = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.train(df, told)
    found = {r.doc_id: r.score for r in tox.score(df, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    bad, clean = [found[i] >= 0.7 for i in held if i % 4 == 0], [found[i] >= 0.7 for i in held if i % 4]
    plain = [found[i] >= 0.7 for i in held if i % 4 == 0 and i % 12]
    assert sum(plain) / len(plain) > 0.95 and sum(bad) / len(bad) > 0.8 and sum(clean) <= 0.05 * len(clean)
    new = spark.createDataFrame([(0, "you stuppid"), (1, "quite worthlesss really"), (2, "a mild and gentle day")], "doc_id long, text string")
    told = {r.doc_id: r.score for r in tox.score(new, model).collect()}
    assert min(told[0], told[1]) > 0.7 > 0.3 > told[2]


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (tox.train(df, spark.createDataFrame(x, "doc_id long, toxic int"), some=20, worst=20) for x in (labels, other))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.bias, b.bias)


def test_awkward_toxicity(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "bad moron"), (3, "x" * 300000), (7, "word " * 90000), (7, "word " * 90000), (8, "�\x85 é")], schema).withColumns({c: F.lit("own") for c in ("score", "_row", "_text", "toxic", "parts", "_found")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (3, 7), (7, 0), (8, 1), (99, 1)], "doc_id long, toxic int")
    for told in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = tox.train(df, told, some=5, worst=5)
        got = tox.score(df, model).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 and r.toxic == "own" for r in got)
        assert (model is None) == (told is not labels) and (model is not None or {r.score for r in got} == {0.5})
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id == 7}) == 1
    assert tox.score(df.limit(0), None).count() == 0 and tox.train(df.limit(0), labels) is None
