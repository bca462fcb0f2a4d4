"""Plain Python versions of the contracts, one document at a time, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

BLANK_WORD = re.compile("[^\x20\x09-\x0d]+")
PLAIN_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def substrings(docs, window=50):
    """{(doc_id, text): (n_words, n_removed, kept)}"""
    least = {}
    for key, text in docs:
        w = BLANK_WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, key), key)
    out = []
    for key, text in docs:
        w = BLANK_WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < key:
                gone.update(range(i, i + window))
        out.append((key, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def suffixes(docs, window=400):
    seen = Counter()
    for _, text in docs:
        b = (text or "").encode()
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for key, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((key, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def near(docs, size=5, similar=75):
    sets = []
    for _, text in docs:
        w = BLANK_WORD.findall((text or "").translate(UPPER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= similar * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= similar * (len(a) + len(b) - shared):
                    root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(s), least[find(i)], key == least[find(i)]) for i, ((key, _), s) in enumerate(zip(docs, sets))]


def language_model(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base, score)} with plain dictionaries."""
    texts = []
    for key, text in docs:
        fold = zlib.crc32(str(key).encode()) % 10
        texts.append((key, fold, [*BLANK_WORD.findall((text or "").translate(UPPER)), None]))
    word, pair, context = Counter(), Counter(), Counter()
    word8, pair8, context8 = Counter(), Counter(), Counter()
    for _, fold, w in texts:
        pairs = list(zip(["<", *[(x,) for x in w]], w))
        if fold:
            word.update(w)
            pair.update(pairs)
            context.update(p[0] for p in pairs)
            if fold != 9:
                word8.update(w)
                pair8.update(pairs)
                context8.update(p[0] for p in pairs)
    size, total, total8 = len(word), sum(word.values()), sum(word8.values())
    band = lambda n: int(math.log2(n)) + 1 if n else 0
    seen = Counter()
    for _, fold, w in texts:
        if fold == 9:
            for p in zip(["<", *[(x,) for x in w]], w):
                n = context8[p[0]]
                seen[band(n), pair8[p] / max(n, 1), word8[p[1]] / max(total8, 1)] += 1
    weights = {f: [0.4, 0.5, 0.1] for f in range(64)}
    weights[0] = [0.0, 0.9, 0.1]
    for _ in range(15):
        got = {}
        for (f, p2, p1), n in seen.items():
            a, b, c = weights[f][0] * p2, weights[f][1] * p1, weights[f][2] / (size + 1)
            own = got.setdefault(f, [0.0, 0.0, 0.0])
            for i, x in enumerate((a, b, c)):
                own[i] += n * x / (a + b + c)
        for f, x in got.items():
            extra = [0.3 if f else 0.0, 0.4, 0.3]
            weights[f] = [(y + e) / (sum(x) + sum(extra)) for y, e in zip(x, extra)]
    out = []
    for key, fold, w in texts:
        base = sum(math.log10((word[x] + 0.1) / (total + 0.1 * (size + 1))) for x in w)
        score = 0.0
        for p in zip(["<", *[(x,) for x in w]], w):
            n = context[p[0]]
            m = weights[band(n)]
            score += math.log10(m[0] * pair[p] / max(n, 1) + m[1] * word[p[1]] / max(total, 1) + m[2] / (size + 1))
        out.append((key, fold == 0, len(w), sum(word[x] > 0 for x in w), total, base, score))
    return out


def quality(rows):
    """{row number: (distance or None, kept)} of (text, lang, source) rows, written from the definition with numpy."""
    import numpy as np

    facts, groups = [], {}
    for text, *_ in rows:
        text = text or ""
        w, grams = BLANK_WORD.findall(text), Counter()
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        grams.update(windows)
        repeated = len({j for i, g in enumerate(windows) if grams[g] > 1 for j in range(i, i + 5)})
        chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
        capitals = len(re.findall("[A-Z\u00c0-\u00d6\u00d8-\u00de!]", text))
        x = [
            1000 * (symbols / (chars + 250)) ** 0.5, 1000 * ((capitals + 10) / (chars + 250)) ** 0.5,
            1000 * (repeated / (len(w) + 50)) ** 0.5, 250 * np.log((chars + 250) / (len(w) + 50)),
        ]
        facts.append((len(w) < 10 or 100 * repeated > 20 * len(w), np.floor(np.array(x) + 0.5)))
    for i, (_, lang, source) in enumerate(rows):
        if not facts[i][0]:
            groups.setdefault((lang, source), []).append(i)
    pooled = {}
    for (lang, source), members in groups.items():
        pooled.setdefault((lang, source, False) if len(members) >= 100 else (lang, None, True), []).extend(members)
    floors, distance = np.array([25.0, 40.0, 60.0, 15.0]), {}
    level = lambda d: np.floor(64 * np.log(1 + d))
    rescale = lambda d: max(1.0, (np.exp((np.quantile(level(d), 0.5) + 1) / 64) - 1) / 3.357)

    for members in pooled.values():
        if len(members) < 100:
            continue
        x = np.array([facts[i][1] for i in members])
        mid = np.median(x, axis=0)
        first = (((x - mid) / np.maximum(1.4826 * np.median(abs(x - mid), axis=0), floors)) ** 2).sum(axis=1)

        def by(close, factor):
            inverse = np.linalg.inv(factor * np.cov(close.T, bias=True) + np.diag(floors**2))
            off = x - close.mean(axis=0)
            return np.einsum("ij,jk,ik->i", off, inverse, off)

        def concentrated(share, factor):
            d = first
            for _ in range(4):
                d = by(x[level(d) <= np.quantile(level(d), share)], factor)
            return d

        plain, half = concentrated(0.75, 1.0), concentrated(0.5, 2.110)
        again = by(x[half <= 11.143], 1.0644)
        plain, again = plain / rescale(plain), again / rescale(again[again <= 11.143])
        chosen = again if np.mean(again > 60) > 0.25 else plain
        distance.update(zip(members, chosen.tolist()))
    return {i: (distance.get(i), not facts[i][0] and distance.get(i, 0.0) <= 60) for i in range(len(rows))}
