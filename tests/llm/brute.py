"""Plain versions of operators, row by row, to hold results against."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SOLID = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def toxic_features(text, words):
    """The distinct hashed words, word pairs, and pairs with a word between, in the numbering of the operator."""
    h = [words.hash_word(w) for w in WORD.findall(lower(text))]
    found = {x >> 44 for x in h}
    for gap, salt in ((1, 0x9E6C63D0876A9A47), (2, 0xC2B2AE3D27D4EB4F)):
        for a, b in zip(h, h[gap:]):
            found.add(int(words.mixed(np.array([(a * salt + b) % 2**64], dtype=np.uint64))[0]) >> 44)
    return sorted(found)


def ftrl(examples, epochs=5, alpha=1.0, beta=1.0, l1=10.0):
    """(weights, bias) of follow-the-regularised-leader, one coordinate at a time."""
    z, n, bias_z, bias_n = defaultdict(float), defaultdict(float), 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            found, y = examples[k]
            w, b = {i: weight(i) for i in found}, -bias_z / ((beta + math.sqrt(bias_n)) / alpha)
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + b)))) - y
            for i in found:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    return {i: weight(i) for i in list(z)}, -bias_z / ((beta + math.sqrt(bias_n)) / alpha)


def toxic_scores(docs, labels, place, words):
    """Score of each (id, text); ``labels`` are (id, toxic) rows, ``place`` orders ids."""
    known = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and not held_out(i):
            known[i] = max(toxic, known.get(i, 0))
    found = [toxic_features(t, words) for _, t in docs]
    examples = sorted((place[i], known[i], np.array(found[k], dtype=np.int32).tobytes(), k) for k, (i, _) in enumerate(docs) if i in known)
    weights, bias = ftrl([(found[k], y) for _, y, _, k in examples])
    return [1 / (1 + math.exp(-max(-35, min(35, sum(weights.get(i, 0.0) for i in f) + bias)))) for f in found]


def shingles(text):
    w = SOLID.findall(lower(text))
    return {" ".join(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} if w else set()


def parts(texts):
    """The least id that each of the (id, text) rows is connected with at a similarity of 0.75."""
    sets = {i: shingles(t) for i, t in texts}
    label = {i: i for i in sets}
    where = defaultdict(list)
    for i, x in sets.items():
        for k in x:
            where[k].append(i)
    for i, x in sorted(sets.items()):
        shared = defaultdict(int)
        for k in x:
            for j in where[k]:
                shared[j] += 1
        for j, n in shared.items():
            if j != i and 100 * n >= 75 * (len(x) + len(sets[j]) - n) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return label


def covered(texts):
    """By id, which bytes of the (id, text) rows stand in a 100-byte string that starts earlier too."""
    seen, out = set(), {}
    for i, t in sorted(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(raw[k : k + 100])
        out[i] = gone
    return out


def contaminated(text, items):
    """Whether a window of ten words (or a whole shorter item) of the item texts stands in the text."""
    d = WORD.findall(lower(text))
    windows = set()
    for item in items:
        b = WORD.findall(lower(item))
        n = min(10, len(b))
        windows |= {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
    return any(tuple(d[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(d) - n + 1))


def water(sizes):
    """Target of each source by name, weights 5, 2, 1, at most three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over
