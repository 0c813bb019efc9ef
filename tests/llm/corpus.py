"""A small corpus with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, a long, key string, n long"


def texts(seed=1, many=60):
    r = random.Random(seed)
    vocabulary = [f"{c}{i}" for c in ("wé", "W", "日本", "x#", "q|") for i in range(60)]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    line = " ".join(r.choice(vocabulary) for _ in range(12))
    out = []
    for _ in range(many):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 4, 5, 30, 60, 120, 300]))]
        t = " ".join(words)
        if r.random() < 0.3:
            t = t[: len(t) // 2] + "\n" + passage + " " + t[len(t) // 2 :]
        if r.random() < 0.3:
            t = line + "\n" + t + "\r\n" + line
        out.append(t)
    base = max(out, key=len)
    near = base.split(" ")
    out += [base, base, " ".join(near[:-4]), " ".join(near[3:]), base.replace(near[5], "ZZZ", 1)]
    out += [None, "", " \t\n ", "one", "One", "a b c d", "a b c d", "tick tock " * 200, "é" * 900, "\n".join(["same line of some length, over forty characters"] * 5)]
    return out


def rows(seed=1):
    """Documents with clashing extra columns, a repeated row, a null id and a null in every column."""
    ts = texts(seed)
    out = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 7 else None, len(t or ""), i, "k", 1) for i, t in enumerate(ts)]
    return [*out, (None, ts[0], None, None, None, None, None, None)]


def docs(spark, seed=1, parts=3):
    return spark.createDataFrame(rows(seed), COLUMNS).repartition(parts)


def removed_words(by_id, window):
    words = {i: WORD.findall(t or "") for i, t in by_id.items()}
    c = Counter(tuple(w[s : s + window]) for w in words.values() for s in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if c[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def removed_bytes(by_id, window):
    raw = {i: (t or "").encode() for i, t in by_id.items()}
    c = Counter(b[s : s + window] for b in raw.values() for s in range(len(b) - window + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if c[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def shingles(text, words=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def components(by_id, percent=75):
    sets = {i: shingles(t) for i, t in by_id.items()}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contaminated(by_id, items, window=10):
    wins = defaultdict(set)
    for name, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[s : s + n])].add(name)
    sizes = {len(x) for x in wins}
    out = {}
    for i, t in by_id.items():
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in wins:
                    hit[s : s + n] = [True] * n
                    found |= wins[x]
        out[i] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))
    return out


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2
