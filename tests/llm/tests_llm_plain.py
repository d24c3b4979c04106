"""Plain Python versions of the stages, shared by tests."""

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from test_langid import key, plain_ngrams, plain_predict  # noqa: E402, F401
from test_pii import plain as plain_spans  # noqa: E402
from test_simhash import plain_components, plain_fingerprint  # noqa: E402, F401


def plain_predict_all(rows, most=400):
    sums = {}
    for i, text, lang, *_ in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            sums.setdefault(lang, Counter()).update(plain_ngrams(text))
    profiles = {lang: [g for g, _ in sorted(c.items(), key=lambda g: (-g[1], key(g[0])))[:most]] for lang, c in sums.items()}
    return {i: plain_predict(profiles, text or "", most) for i, text, *_ in rows}


def plain_redact(text):
    spans = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in plain_spans(text)))
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def plain_near(texts, ids, words=5, similarity=0.8):
    """The smallest id of each text's group, comparing all pairs of shingle sets."""
    found = [(t or "").encode().lower().split() for t in texts]
    sets = [frozenset(tuple(f[i : i + words]) for i in range(max(1, len(f) - words + 1))) for f in found]
    group = {i: i for i in ids}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((top(ids[a]), top(ids[b])))
                group[y] = x
    return {i: top(i) for i in ids}


def topic(text):
    if " | " in text:
        return "table"
    if re.search(r"[%*&$#]{3}", text):
        return "markup"
    return "note" if len(text) < 600 else "prose"


def chance(i):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 16**13


def plain_mix(rows, keep=0.8, powers=(0.7, 0.8, 0.8)):
    cells, place = defaultdict(int), {}
    for i, source, lang, text in rows:
        place[i] = (source or "", lang or "", topic(text))
        cells[place[i]] += len(text.split())
    total = sum(cells.values())
    weight = {c: n / total for c, n in cells.items()}
    targets = []
    for d, power in enumerate(powers):
        sums = defaultdict(float)
        for c, n in cells.items():
            sums[c[d]] += n
        whole = sum(s**power for s in sums.values())
        targets.append({v: s**power / whole for v, s in sums.items()})
    for _ in range(50):
        for d, target in enumerate(targets):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {c: w * target[c[d]] / sums[c[d]] for c, w in weight.items()}
    down, up = 0.0, 1e12
    for _ in range(200):
        mid = (down + up) / 2
        down, up = (mid, up) if sum(n * min(1, mid * weight[c] / n) for c, n in cells.items()) < keep * total else (down, mid)
    return {i: min(1, up * weight[c] / cells[c]) for i, c in place.items()}
