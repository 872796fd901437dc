"""Plain restatements of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash


def hits(documents, benchmark, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: pattern.findall(lower(t))
    windows = {}
    for item, text in benchmark:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in documents:
        w = words(text)
        hit, items = [False] * len(w), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    items |= found
                    hit[i : i + size] = [True] * size
        out[doc] = (len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit))
    return out


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def simhash(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest doc_id reachable, from [(doc_id, fingerprint)]."""
    up = {d: d for d, _ in prints}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, f) in enumerate(prints):
        for b, g in prints[:i]:
            if (f ^ g).bit_count() <= 3:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in prints}


def kept_bytes(documents, length=100):
    """doc_id -> (bytes, removed, runs, sha256 of what is kept), from [(doc_id, text)] in any order."""
    seen, out = set(), {}
    for doc, text in sorted(documents):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            piece = raw[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(piece)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out
