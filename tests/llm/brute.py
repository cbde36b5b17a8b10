"""Brute-force versions of the operators' results, over lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_rules(text):
    text = text or ""
    words, seen, lines = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered = {k + i for k, w in enumerate(windows) if counts[w] > 1 for i in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), n < 50 or 100 * len(covered) > 50 * n


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[k:k + 3]) for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(docs, bits=2):
    prints = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return Counter((d, f"{p:016x}", least[find(i)]) for i, ((d, _), p) in enumerate(zip(docs, prints)))


def repeated_words(docs, window):
    words = [WORD.findall(t or "") for _, t in docs]
    counts = Counter(tuple(w[k:k + window]) for w in words for k in range(len(w) - window + 1))
    out = Counter()
    for (d, _), w in zip(docs, words):
        gone = {k + i for k in range(len(w) - window + 1) if counts[tuple(w[k:k + window])] > 1 for i in range(window)}
        out[(d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    return out


def repeated_bytes(docs, window):
    last = 1 << 63
    rows = [(last if d is None else d, d, (t or "").encode()) for d, t in docs]
    first = {}
    for r, _, b in rows:
        for k in range(len(b) - window + 1):
            first[b[k:k + window]] = min(r, first.get(b[k:k + window], last))
    out = Counter()
    for r, d, b in rows:
        gone = {k + i for k in range(len(b) - window + 1) if first[b[k:k + window]] < r for i in range(window)}
        spans = sum(1 for i in gone if i - 1 not in gone)
        out[(d, len(b), len(gone), spans, sha(bytes(x for i, x in enumerate(b) if i not in gone)))] += 1
    return out


def leaks(docs, items, window=10):
    where = {}
    for i, t in items:
        w = TERM.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w and i is not None else 0):
            where.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = Counter()
    for d, t in docs:
        w, hit, ids = TERM.findall(lower(t)), set(), set()
        for n in {len(x) for x in where}:
            for k in range(len(w) - n + 1):
                if found := where.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out[(d, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit))] += 1
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    text, digits, out = text or "", lambda x: re.sub("[^0-9]", "", x), []
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15))
    for kind, pattern, valid in kinds:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if valid(m[0])]
    return ",".join(out)
