"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re

import xxhash


def words(text, lower=True):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=3):
    """fps: list of (doc_id, fp) -> smallest doc_id of each one's component."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        r = find(i)
        ids = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(ids) if ids else None
    return [least[find(i)] for i in range(len(fps))]


def near_components(rows, radius=3, least=0.8):
    """rows (doc_id, text) -> smallest doc_id of each one's component over near fingerprints or alike five-word shingles."""
    fps = [fingerprint(t) for _, t in rows]
    sets = [shingles(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""), fold=False) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            alike = a and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and len(a & b) >= least * len(a | b) - 1e-9
            if alike or (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        smallest[r] = min(d, smallest.get(r, d))
    return [smallest[find(i)] for i in range(len(rows))]


def quality(text):
    w = words(text, lower=False)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    f = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }
    f["base_failed"] = f["n_words"] < 20 or 100 * f["n_repeat_words"] > 30 * f["n_words"]
    more = 10 * f["n_symbols"] > f["n_words"] or f["word_chars"] < 2 * f["n_words"] or f["word_chars"] > 20 * f["n_words"]
    more = more or 10 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 3 * f["n_words"]
    more = more or (f["n_dup_lines"] >= 4 and 10 * f["n_dup_lines"] > 3 * len(lines))
    f["kept"] = not (f["base_failed"] or more)
    return f


def shingles(text, n=5, fold=True):
    w = (text or "").lower() if fold else text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return set()
    return {" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))}


def contained(text, item):
    a, b = shingles(text), shingles(item)
    return len(a & b), len(b), bool(b) and 10 * len(a & b) >= 8 * len(b)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and _luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)
