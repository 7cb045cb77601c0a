"""What the operators have to return, by the plainest means."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def quality(text):
    w = WORD.findall(text or "")
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def repeated_bytes(rows, n=50):
    """id -> (bytes, removed, spans, sha of the kept), for distinct ids."""
    first, out = {}, {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - n + 1):
            if first.setdefault(data[a : a + n], i) < i:
                gone[a : a + n] = b"\1" * n
        out[i] = len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(data, gone) if not g))
    return out


def repeated_words(rows, n=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            key = tuple(w[a : a + n])
            if key in seen:
                gone[a : a + n] = [True] * n
            seen.add(key)
        out[i] = len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))
    return out


def fingerprint(text):
    w = WORD.findall(low(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, most=4):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def hits(text, items, n=10):
    """(words, words hit, items that occur) of a text; items: (id, text)."""
    w, hit, found = ALNUM.findall(low(text)), set(), set()
    for item, t in items:
        x = ALNUM.findall(low(t))
        size = min(n, len(x))
        windows = {tuple(x[a : a + size]) for a in range(len(x) - size + 1)} if x else set()
        for a in range(len(w) - size + 1):
            if tuple(w[a : a + size]) in windows:
                found.add(item)
                hit.update(range(a, a + size))
    return len(w), len(hit), found


def licenses(text, templates, window_of, containment=0.8):
    """(license, start, end, containment) of every window that holds enough of a wording, overlapping ones merged."""
    w, out = ALNUM.findall(low(text)), []
    for name, wordings in templates.items():
        windows = []
        for wording in wordings:
            t = ALNUM.findall(low(wording))
            if not t:
                continue
            size = min(5, len(t))
            want = {tuple(t[i : i + size]) for i in range(len(t) - size + 1)}
            window, step = window_of(len(t) - size + 1)
            have = [tuple(w[i : i + size]) for i in range(max(0, len(w) - size + 1))]
            for a in range(0, len(have), step):
                share = len(want & set(have[a : a + window])) / len(want)
                if share >= containment:
                    windows.append((a, min(a + window + size - 1, len(w)), share))
        merged = []
        for a, b, share in sorted(windows):
            if merged and a < merged[-1][1]:
                start, until, end, best = merged[-1]
                merged[-1] = [a, max(until, b), b, share] if share > best else [start, max(until, b), end, best]
            else:
                merged.append([a, b, b, share])
        out += [(name, a, end, best) for a, _, end, best in merged]
    return out


def fm_score(bias, weights, vectors, terms):
    """A factorization machine pair by pair."""
    import math

    pairs = sum(float(vectors[a] @ vectors[b]) for k, a in enumerate(terms) for b in terms[:k])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(float(weights[t]) for t in terms) + pairs))))


def private(text, mention, kind_names):
    """(start, end, kind) of what has to be replaced: matches of one expression from the left, then the names in them where they stand alone.

    ``kind_names(m)`` gives the words of a mention that are names."""
    import regex

    spans = [(m.start(), m.end(), "mention") for m in regex.finditer(mention, text or "")]
    names = {n for a, b, _ in spans for n in kind_names(text[a:b])}
    names |= {n.upper() for n in names} | {n.lower().title() if "-" not in n and "'" not in n else n for n in names}
    if names:
        alone = regex.compile(r"(?<![\p{L}\p{N}_])(?:" + "|".join(sorted(map(regex.escape, names), reverse=True)) + r")(?![\p{L}\p{N}_])")
        at = 0
        for a, b, _ in [*spans, (len(text), len(text), "")]:
            spans = spans + [(m.start() + at, m.end() + at, "name") for m in alone.finditer(text[at:a])]
            at = b
    return sorted(spans)
