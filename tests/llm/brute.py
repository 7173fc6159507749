"""Plain single-machine versions of the corpus operators, for comparison."""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter

import numpy as np
import xxhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def blank(text, lower=False):
    text = text or ""
    return BLANK.findall(text.translate(LOWER) if lower else text)


def license_base(text, phrases):
    words = alnum(text)
    places = [(i, label) for phrase, label in phrases.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def license_notices(text, notices, slack=2, min_share=0.75, long=8):
    """Labels and best share of notices, trying each template at each diagonal that has a vote."""
    words, shares = alnum(text), {}
    for phrase, label in notices.items():
        t = phrase.split()
        votes = set()
        for p in range(len(words) - 1):
            for q in range(len(t) - 1):
                if words[p : p + 2] == t[q : q + 2]:
                    before, after = p and q and words[p - 1] == t[q - 1], words[p + 2 : p + 3] == t[q + 2 : q + 3] != []
                    if len(t) < long or before or after:
                        votes.add((p, q))
        for d in {p - q for p, q in votes}:
            band = [(p, q) for p, q in votes if d <= p - q <= d + slack]
            share = min(len({p for p, _ in band}), len({q for _, q in band})) / (len(t) - 1)
            shares[label] = max(share, shares.get(label, 0))
    found = {label: s for label, s in shares.items() if s >= min_share}
    return set(found), max(found.values(), default=0.0)


def fingerprint(text):
    w = blank(text, True)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    if not shingles:
        return 0
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], dtype=np.uint64)
    bits = [(h >> np.uint64(j)) & np.uint64(1) for j in range(64)]
    return sum(1 << j for j in range(64) if 2 * int(bits[j].sum()) > len(h))


def components(rows, distance=2):
    """rows: (doc_id, fingerprint) -> component id by doc position."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for i, f in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= distance) + i + 1
        for j in near:
            parent[find(fps[j])] = find(f)
    least = {}
    for d, f in rows:
        r = find(f)
        least[r] = min(least.get(r, d), d)
    return [least[find(f)] for _, f in rows]


def word_fingerprint(text):
    """Fingerprint over the different words."""
    words = set(blank(text, True))
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in words] or [0], dtype=np.uint64)
    bits = [(h >> np.uint64(j)) & np.uint64(1) for j in range(64)]
    return sum(1 << j for j in range(64) if words and 2 * int(bits[j].sum()) > len(h))


def shingles(text, size=5):
    w = blank(text, True)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_counts(text):
    """(words, word characters, symbols, repeated lines, words in repeated 3-word windows)."""
    words = blank(text)
    often = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if often[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if blank(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def quality(rows, trusted, threshold=-0.5, buckets=1 << 16, prior=20_000):
    """rows: (doc_id, text) -> for each row (score, kept), gram by gram."""

    def grams(text):
        raw = (text or "").encode()
        for i in range(len(raw) - 2):
            h = (raw[i] * 0x9E3779B1 + raw[i + 1] * 0x85EBCA77 + raw[i + 2] * 0xC2B2AE3D) % 2**32
            h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
            yield (h ^ h >> 16) % buckets

    raw, target = Counter(), Counter()
    for doc_id, text in rows:
        for g in grams(text):
            raw[g] += 1
            if doc_id in trusted:
                target[g] += 1
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = {}
    for g in raw:
        p = (raw[g] + 1) / (n_raw + buckets)
        ratio[g] = round(float(np.log((target[g] + prior * p) / (n_target + prior) / p)) * 1e6) if n_target else 0
    out = []
    for _, text in rows:
        own = [ratio[g] for g in grams(text)]
        words, *_, repeated = plain_counts(text)
        failed = words < 50 or 100 * repeated > 50 * words
        out.append((sum(own) / max(1, len(own)) / 1e6, not failed and sum(own) >= threshold * 1e6 * len(own)))
    return out


def similar_groups(texts, distance=6, similarity=0.8):
    """Group number of each text: links of similar texts within closures of near fingerprints."""
    fps, sets = [word_fingerprint(t) for t in texts], [shingles(t) for t in texts]
    closure = components([(f, f) for f in fps], distance)
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and closure[i] == closure[j] and jaccard(sets[i], sets[j]) >= similarity:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def decontaminate(text, items, n=10):
    """items: (item_id, text)."""
    words = alnum(text)
    hit, found = set(), set()
    for item, item_text in items:
        w = alnum(item_text)
        size = min(n, len(w))
        if not size:
            continue
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def repeated_bytes(texts, size=100):
    """texts: (doc_id, text) in any order -> doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    first, out = {}, {}
    for doc, text in sorted(texts, key=lambda x: x[0]):
        raw = (text or "").encode()
        covered = np.zeros(len(raw) + 1, dtype=np.int64)
        for i in range(len(raw) - size + 1):
            if first.setdefault(raw[i : i + size], (doc, i)) != (doc, i):
                covered[i] += 1
                covered[i + size] -= 1
        mask = np.cumsum(covered)[:-1] > 0
        runs = int((np.diff(np.concatenate(([0], mask.astype(np.int8)))) == 1).sum())
        kept = np.frombuffer(raw, dtype=np.uint8)[~mask].tobytes()
        out[doc] = (len(raw), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def signed_hash(text):
    return (xxhash.xxh64_intdigest((text or "").encode(), 42) ^ 1 << 63) - (1 << 63)


def without_repeats(rows, size=100):
    """rows: (doc_id, text) -> each text without the bytes of strings that start earlier; a character cut within goes whole."""
    place = {}
    for n, (doc, text) in enumerate(rows):
        raw = text.encode()
        for i in range(len(raw) - size + 1):
            place.setdefault(raw[i : i + size], []).append(((doc is not None, doc), i, signed_hash(text), n))
    gone = [set() for _ in rows]
    for where in place.values():
        for _, i, _, n in sorted(where)[1:]:
            gone[n].update(range(i, i + size))
    return [bytes(b for i, b in enumerate(t.encode()) if i not in g).decode(errors="ignore") for (_, t), g in zip(rows, gone)]


def without_items(text, items, n=10):
    """Text without the characters from the first to the last word of each run of hit words of windows that touch or overlap."""
    found = [(m.start(), m.end()) for m in ALNUM.finditer(text.translate(LOWER))]
    words = alnum(text)
    spans = set()
    for _, item in items:
        w = alnum(item)
        size = min(n, len(w))
        for k in range(len(w) - size + 1) if size else ():
            spans |= {(i, i + size) for i in range(len(words) - size + 1) if words[i : i + size] == w[k : k + size]}
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = text[: found[a][0]] + text[found[b - 1][1] :]
    return text
