"""Plain versions of the operators, for tables of test size."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text, shingle=4):
    ws = words((text or ""))
    ws = [w.lower() for w in ws]
    if not ws:
        return 0
    runs = [b" ".join(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    """doc_id -> (fingerprint, component)."""
    prints = [(d, fingerprint(t)) for d, t in docs]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= 4]
    root = roots(len(prints), pairs)
    least = {}
    for (d, _), r in zip(prints, root):
        least[r] = min(least.get(r, d), d)
    return sorted((d, f"{p:016x}", least[r]) for (d, p), r in zip(prints, root))


def held_out(doc_id, by, of=0):
    return zlib.crc32(str(doc_id).encode()) % by == of


def base_scores(docs):
    """doc_id -> (n_tokens, n_known, train_tokens, base score)."""
    def tokens(t):
        return [w.lower() for w in words(t)] + [b"\n"]

    counts = Counter(w for d, t in docs if not held_out(d, 10) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {d: (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for d, t in docs}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def substring(docs, window=20):
    """doc_id -> (n_words, n_removed, kept sha) for unique doc_ids."""
    first = {}
    for d, t in sorted(docs):
        ws = words(t)
        for i in range(len(ws) - window + 1):
            first.setdefault(tuple(ws[i : i + window]), (d, i))
    out = {}
    for d, t in docs:
        ws = words(t)
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        out[d] = (len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest())
    return out


def language_model(model, counts, text):
    """log10 probability of a text, one word after the other."""
    import numpy as np

    v, net = model.vocabulary, model.net
    place = {w: i for i, w in enumerate(v.words)}
    f = lambda x: 1 / (1 + np.exp(-x))
    n, h, last, total = net.hidden, np.zeros(net.hidden), v.start, 0.0
    for w in [w.lower() for w in words(text)] + [b"\n"]:
        drive = net.emb[last].astype(float) + net.bias
        gates = f(drive[: 2 * n] + h @ net.rec)
        z, r = gates[:n], gates[n:]
        c = np.tanh(drive[2 * n :] + (r * h) @ net.cand)
        h = z * h + (1 - z) * c
        i = place.get(w, -1)
        k = v.tail if i < 0 else next(k for k in range(v.classes - 1) if v.first[k] <= i < v.ends[k])
        share = np.exp(h @ net.out + net.out_bias)
        total += math.log10(share[k] / share.sum())
        if i < 0:
            total += math.log10((counts.get(w, 0) + 0.1) / v.class_mass[k])
        elif k < v.modelled:
            inner = np.exp(net.words[v.first[k] : v.ends[k]].astype(float) @ h + net.words_bias[v.first[k] : v.ends[k]])
            total += math.log10(inner[i - v.first[k]] / inner.sum())
        else:
            total += math.log10((counts[w] + 0.1) / sum(counts[x] + 0.1 for x in v.words[v.first[k] : v.ends[k]]))
        last = i if 0 <= i < v.inputs else v.inputs + k
    return total
