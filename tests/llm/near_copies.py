"""Near copies by brute force: fingerprints within 4 bits, or sets of five-word shingles of similarity 0.8 or more."""

import random

import xxhash


def shingles(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(b"\t\n\x0b\x0c\r", " ")).split(" ")
    words = [w for w in words if w]
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])


def similar(a, b):
    return bool(a) and 10 * len(a & b) >= 8 * len(a | b)


def kept_ids(rows):
    """The least ids of the groups of (doc_id, text) rows."""
    texts = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        texts.setdefault(t, d)
    sets, prints = {}, {}
    for t, d in texts.items():
        parts = shingles(t)
        h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
        sets[d], prints[d] = set(parts), sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if find(a) != find(b) and ((prints[a] ^ prints[b]).bit_count() <= 4 or similar(sets[a], sets[b])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted({find(d) for d in ids})


def with_copies(texts, seed, vocabulary=3000):
    """The texts and three copies of each with one to a tenth of the words replaced, from ids 1,000,000 on."""
    rng = random.Random(seed)
    out = list(texts)
    for _, t in texts:
        words = (t or "").split()
        if len(words) < 8:
            continue
        for _ in range(3):
            some = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 30))):
                some[rng.randrange(len(some))] = f"w{rng.randrange(vocabulary)}"
            out.append((1_000_000 + len(out), " ".join(some)))
    return out
