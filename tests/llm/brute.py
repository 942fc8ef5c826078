"""Plain versions of the operators for small tables; nothing here is shared with the operators."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import xxhash


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    counts = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(hit),
        "base_failed": n < 50 or 100 * len(hit) > 50 * n,
    }


def contamination(text, items):
    """items: {id: text}."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    words, hit, found = split(text), set(), set()
    at = {}
    for m in range(1, 11):
        for i in range(len(words) - m + 1):
            at.setdefault(tuple(words[i : i + m]), []).append(i)
    for item, body in items.items():
        own = split(body)
        m = min(10, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            for start in at.get(tuple(own[i : i + m]), []):
                hit.update(range(start, start + m))
                found.add(str(item))
    return len(words), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_data(text):
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return spans


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, distance=2):
    """The smallest id reachable, by comparing every print with all others."""
    values = sorted(set(prints))
    array = np.array(values, np.uint64)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for v in values:
        differing = np.bitwise_count(array ^ np.uint64(v))
        for w in array[differing <= distance]:
            a, b = find(v), find(int(w))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, p in zip(ids, prints, strict=True):
        root = find(p)
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return [least.get(find(p)) for p in prints]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
