"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def secret_spans(text):
    text, out = text or "", []
    names = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                     for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal_spans(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append(("phone", m))
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(g), set()
    for i, x in enumerate(g):
        if n[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def fingerprint(text, width=4):
    import xxhash
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def groups(keys, linked):
    """Smallest key of each key's component."""
    keys, up = sorted(keys), {k: k for k in keys}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Reshare the excess by weight, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    got = {s: total * weight[s] / sum(weight.values()) for s in names}
    fixed = set()
    for _ in range(10 * len(names)):
        over = [s for s in names if got[s] > cap * sizes[s] + 1e-9]
        if not over:
            break
        excess = sum(got[s] - cap * sizes[s] for s in over)
        for s in over:
            got[s] = float(cap * sizes[s])
            fixed.add(s)
        rest = [s for s in names if s not in fixed]
        if not rest:
            break
        for s in rest:
            got[s] += excess * weight[s] / sum(weight[r] for r in rest)
    return got
