"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text, k):
    w = words(text, lower=True)
    return [" ".join(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))] if w else []


def fingerprint(text):
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def simhash_rows(rows):
    """rows: (doc_id, text), ids not null and distinct."""
    rows = sorted(rows)
    fps = [fingerprint(t) for _, t in rows]
    root = components(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    return {(d, f"{fps[i]:016x}", rows[root[i]][0]) for i, (d, _) in enumerate(rows)}


def contained(docs, items):
    out = set()
    have = {d: set(shingles(t, 5)) for d, t in docs}
    for i, t in items:
        own = set(shingles(t, 5))
        for d, x in have.items():
            if own and len(own & x) >= 0.8 * len(own):
                out.add((d, i, len(own & x), len(own)))
    return out


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        s += n - 9 if n > 9 else n
    return s % 10 == 0


def base_spans(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def pii_row(text):
    spans = base_spans(text)
    n = [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
    return (*n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())


def without_repeats(rows, window):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def chat_row(turns):
    """turns: (role, text) in order."""
    all_turns = "".join(f"{r}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def near_groups(rows, threshold=0.8):
    rows = sorted(rows)
    sets = [set(shingles(t, 5)) for _, t in rows]

    def linked(a, b):
        if rows[a][1] == rows[b][1]:
            return True
        shared = len(sets[a] & sets[b])
        return shared > 0 and shared >= threshold * len(sets[a] | sets[b])

    root = components(len(rows), linked)
    return {rows[root[i]][0] for i in range(len(rows))}
