"""Plain Python versions of the operators, on lists of (id, text)."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def shingles(text: str | None, n: int = 5) -> set:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def least_reachable(nodes, edges) -> dict:
    root = {n: n for n in nodes}

    def up(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return {n: up(n) for n in nodes}


def near_duplicates(docs, percent: int = 75) -> dict:
    """id -> (set size, component)"""
    sets = {i: shingles(t) for i, t in docs}
    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    counts: dict = {}
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                counts[ids[b], ids[a]] = counts.get((ids[b], ids[a]), 0) + 1
    edges = [p for p, c in counts.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    comp = least_reachable(sets, edges)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def vectors(rows, cosine: float = 0.98) -> dict:
    """rows (id, vector, label): id -> (links, component)"""
    good = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, edges = {i: 0 for i, *_ in rows}, []
    for k, (i, v, lab) in enumerate(good):
        for j, u, other in good[:k]:
            if lab == other and len(v) == len(u) and float(v @ u) >= cosine:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    comp = least_reachable(links, edges)
    return {i: (links[i], comp[i]) for i in links}


def remove_words(docs, n: int = 50) -> dict:
    """id -> (words, removed, sha)"""
    first: dict = {}
    split = {i: WORD.findall(t or "") for i, t in docs}
    for i in sorted(split):
        w = split[i]
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def remove_bytes(docs, n: int = 100) -> dict:
    """id -> (bytes, removed, spans, sha)"""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            w = hash(raw[k : k + n])
            if w in seen:
                gone[k : k + n] = b"\x01" * n
            else:
                seen.add(w)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[i] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def base_secrets(text: str | None) -> tuple:
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return (*(sum(f[1] == k for f in found) for k in range(3)), sha(said), said)


def edited(docs) -> dict:
    """id -> (chars, sha of the edited text, the edited text, the next text)"""
    rows = sorted((i, t or "") for i, t in docs)
    out = {}
    for k, (i, t) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + follow[:half]
        out[i] = (len(t), sha(e), e, follow)
    return out


def jaccard(a: str, b: str) -> float:
    cut = lambda t: {tuple(w[k : k + 5]) for w in [WORD.findall(t)] for k in range(max(1, len(w) - 4))} if WORD.search(t) else set()
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else float(a == b)


def looped(i, text: str | None) -> list[bytes]:
    """Words of op12 before runs are sought."""
    w = (text or "").encode().split()
    h, n = (zlib.crc32(str(i).encode()) if i is not None else 1), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]


def all_runs(w: list) -> list[tuple]:
    """(start, length, period) of every run of four periods and six words, by trying each period at each place."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if len(part) >= max(6, 4 * q) and not any(all(part[x] == part[x + s] for x in range(len(part) - s)) for s in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out)


def op12_row(i, text) -> tuple:
    w = looped(i, text)
    runs = all_runs(w)
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
    return len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept)


def variants(docs) -> dict:
    """word -> (form, root, n, n_near, form_n), each word against each."""
    n: dict[str, int] = {}
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{low}".encode()) if i is not None else 1
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] = n.get(low, 0) + 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w in n:
        others = [x for x in n if x != w and near(w, x)]
        count[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], count[w], n[form[w]] if form[w] is not None else None)
    return out
