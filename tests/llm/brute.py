"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256

import xxhash

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN = r"[^\x20\x09-\x0D]+"
KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def license_base(text):
    words = re.findall(WORDS, ascii_lower(text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def secret_base(text):
    spans = []
    for number, (kind, pattern, group, least) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            if len(m[group]) >= least:
                spans.append((m.start(), number, m.end(), kind))
    spans.sort()
    counts = Counter(s[3] for s in spans)
    digest = sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
    return counts["assign"], counts["access"], counts["hex"], digest


def simhash(text, width=3):
    words = re.findall(PLAIN, ascii_lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def hamming_groups(rows, bits=3):
    """Smallest doc_id reachable, for (doc_id, fingerprint) rows."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[top(a)] = top(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return [(d, f"{f:016x}", least.get(top(f))) for d, f in rows]


def rule_counts(text):
    text = text or ""
    words = re.findall(PLAIN, text)
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(PLAIN, line):
            repeats += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, r, n < 20 or 100 * r > 30 * n


def repeats(rows, width=100):
    """(n_bytes, n_removed, n_spans, kept_sha256) by key, for (key, text) rows in order."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        fresh = []
        for i in range(len(raw) - width + 1):
            part = raw[i : i + width]
            if part in seen:
                covered[i : i + width] = b"\1" * width
            else:
                seen.add(part)
                fresh.append(part)
        spans = len(re.findall(rb"\x01+", bytes(covered)))
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        out[key] = (len(raw), sum(covered), spans, sha256(kept).hexdigest())
    return out


def near_kept(rows, width=5, least=0.8):
    """Smallest id of each component of texts whose shingle sets are ``least`` alike or more."""
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    kept = {}
    for i, (doc_id, _) in enumerate(rows):
        kept[top(i)] = min(doc_id, kept.get(top(i), doc_id))
    return sorted(kept.values())


def jaccard_groups(rows, width=4, least=80):
    """(doc_id, n_shingles, component_id, kept) for (doc_id, text) rows, all pairs compared."""
    sets = []
    for _, text in rows:
        words = re.findall(PLAIN, ascii_lower(text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= least * (len(sets[i]) + len(sets[j]) - shared):
                root[top(i)] = top(j)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            first[top(i)] = min(doc_id, first.get(top(i), doc_id))
    return [(d, len(s), first.get(top(i)), d == first.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def filter_orders(rows, labels):
    """Rows of the audit for (doc_id, text, lang) and (doc_id, quality, toxic), each order run on its own."""
    from itertools import permutations

    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    by_part = {}
    for d, t, lang in rows:
        words = re.findall(PLAIN, t or "")
        fails = "".join(
            letter for letter, failed in (
                ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
                ("C", 100 * len(re.findall("[A-Z]", t or "")) > 10 * len(t or "")), ("D", re.search(r"[#$%&*|]", t or "")),
                ("E", d is not None and d > least[t or ""]),
            ) if failed
        )
        by_part.setdefault(lang or "", []).append((d, fails))
    out = []
    for part, held in by_part.items():
        total = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = list(held)
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                total[letter] += len(gone)
                fails = sum(letter in f for _, f in held)
                steps.append((part, "".join(order), step, len(left), len(gone), fails - len(gone),
                              sum(f == letter for _, f in held), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), letter))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def phrase_ranks(rows, longest=4, least=30, top=2000):
    """Rows of the collocations for (text, lang), every phrase counted as text."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        held = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                held.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, held in counts.items():
        many = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        over = {}
        for p, a in many.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    over[p[i : i + n]] = max(a, over.get(p[i : i + n], 0))
        ranked = []
        for p, a in many.items():
            score, _, l, r = min((2000000 * a // (held[p[:k]] + held[p[k:]]), k, held[p[:k]], held[p[k:]]) for k in range(1, len(p)))
            if 100 * over.get(p, 0) < 80 * a:
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        ranked.sort()
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(ranked[:top], 1)]
    return sorted(out)
