"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def linked(rows, size, percent):
    """{doc_id: (set size, component)} of (doc_id, text) rows."""
    sets = {d: shingles(t, size) for d, t in rows}
    part = {d: d for d in sets}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    by_token = {}
    for d, found in sets.items():
        for token in found:
            by_token.setdefault(token, []).append(d)
    pairs = {(a, b) for docs in by_token.values() for i, a in enumerate(docs) for b in docs[:i]}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            part[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    """Base spans (kind, start, end)."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    return _spans(text, kinds)


def secrets(text):
    kinds = {
        "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
        "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
    }
    return _spans(text, kinds)


def _spans(text, kinds):
    order = list(kinds)
    found = [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m)]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def edited(rows):
    """{doc_id: edited text} of (doc_id, text) rows with distinct ids."""
    rows = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = {}
    for i, (d, t) in enumerate(rows):
        k = len(t) // 3
        out[d] = t[: len(t) - k] + rows[(i + 1) % len(rows)][1][:k]
    return out


def jaccard(a, b, size):
    fold = lambda t: shingles(t.lower(), size)
    x, y = fold(a), fold(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: target} of {source: size}: shares handed out again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, goal = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not above:
            return goal | {s: left * weight[s] / total for s in open_}
        for s in above:
            goal[s] = most * sizes[s]
            open_.discard(s)
        left -= sum(goal[s] for s in above)
    return goal
