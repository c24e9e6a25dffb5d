"""Plain versions of the contracts, for small inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéßñ") for _ in range(r.randint(2, 7))) + r.choice(["", "", "", ".", ",\n"]) for _ in range(n))


def _nasty():
    shared = _prose(99, 120)
    base = _prose(1, 200)
    rows = [(i, _prose(i, 40 + i)) for i in range(10, 40)]
    rows += [(100 + i, base.replace(" ", f" w{i} ", i % 4)) for i in range(12)]  # near copies
    rows += [(200 + i, base) for i in range(4)] + [(200, base), (200, base)]  # exact copies and repeated rows
    rows += [(300 + i, _prose(500 + i, 30) + " " + shared + "\n" + _prose(600 + i, 25)) for i in range(5)]  # a passage in common
    rows += [(400 + i, _prose(700 + i, 60) + f" you moron{'s' * (i % 2)} and idiot " + _prose(800 + i, 20)) for i in range(16)]
    rows += [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two THREE"), (6, "one two three"), (7, "Ünï cödé 中文 🙂 \x1c x\x85y"), (8, "a" * 2500), (9, "ab " * 900),
             (None, "no id here at all but some words"), (None, None), (50, _prose(50, 30_000)), (51, "word " * 5000), (52, "<|endoftext|> inside a <|endoftext|> text"),
             (53, "  two  spaces \n\n and   tabs\t\tthere  "), (54, "| a | b | c | d | e | f\nReal sentence with enough words to stay in place here.\nAll rights reserved.")]
    return rows


NASTY = _nasty()


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        root = find(k)
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]


def cut(rows, length=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                gone[p:p + length] = b"\x01" * length
        spans = sum(1 for p, g in enumerate(gone) if g and (not p or not gone[p - 1]))
        out.append((i, len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def crc_mod(key, of):
    return None if key is None else zlib.crc32(str(key).encode()) % of


def base_scores(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    texts = [(i, [*words((t or "").translate(LOWER)), None], crc_mod(i, 7) in (2, None)) for i, t in rows]
    counts = Counter(w for _, ws, held in texts if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, held, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws, held in texts]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def first_fit(histogram, size):
    """Sequences that first-fit decreasing uses."""
    room = []
    for length in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
        at = next((i for i, left in enumerate(room) if left >= length), None)
        if at is None:
            room.append(size - length)
        else:
            room[at] -= length
    return len(room)


def audit(rows, labels):
    """Counter of the rows of op11 for (doc_id, text, source) and (doc_id, quality, toxic)."""
    from itertools import permutations

    fails, parts, marks = [], [], []
    for i, t, source in rows:
        t = t or ""
        w = words(t)
        fails.append({f for f, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)), ("D", re.search(r"[#$%&*|]", t)),
                                       ("E", i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))) if bad})
        parts.append(source or "")
        marks.append([i is not None and any(j == i and x == 1 for j, x in ((lab[0], lab[k]) for lab in labels)) for k in (1, 2)])
    out, shapley = {}, Counter()
    for part in set(parts):
        own = [k for k, p in enumerate(parts) if p == part]
        for order in permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if f in fails[k]}
                left -= gone
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in fails[k] for k in own) - len(gone), sum(fails[k] == {f} for k in own),
                                                   sum(marks[k][0] for k in gone), sum(marks[k][1] for k in gone))
    return Counter((*key, *value, shapley[key[0], key[1][key[2] - 1]]) for key, value in out.items())


def simhash(text):
    import xxhash

    w = words((text or "").translate(LOWER))
    grams = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(values, distance=4):
    """The class of each value: the least index reachable by links."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(values))]
