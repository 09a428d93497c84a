"""Plain versions of the operators, for small tables of (doc_id, text)."""

import hashlib
import math
import random
import re
from collections import Counter

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STRIPPED = " \t\n\x0b\x0c\r"


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def symbol_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def shingles(text, k):
    w = blank_words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(rows, k, percent):
    """{doc_id: (n_shingles, component_id)} for rows with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def without_lines(rows, min_chars=20, min_docs=3):
    """{doc_id: (n_lines, n_dropped, text)} for rows with distinct ids."""
    keys = {i: [(line, line.strip(STRIPPED).translate(AZ)) for line in (t or "").split("\n")] for i, t in rows}
    held = {}
    for i, lines in keys.items():
        for _, key in lines:
            if len(key) >= min_chars:
                held.setdefault(key, set()).add(i)
    out = {}
    for i, lines in keys.items():
        kept = [line for line, key in lines if not (len(held.get(key, ())) >= min_docs and i < max(held[key]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def overlaps(rows, items, window=20, percent=80, min_tokens=5):
    """{(doc_id, item_id): (window_tokens, matched)}, at every shift that lets a single token agree."""
    found = {}
    for d, text in rows:
        w = symbol_words(text)
        places = {}
        for at, word in enumerate(w):
            places.setdefault(word, []).append(at)
        for item, passage in items:
            b = symbol_words(passage)
            if len(b) < min_tokens:
                continue
            n = min(window, len(b))
            for shift in {at - p for p, word in enumerate(b) for at in places.get(word, ())}:
                agree = [0 <= p + shift < len(w) and w[p + shift] == b[p] for p in range(len(b))]
                m = max(sum(agree[p : p + n]) for p in range(len(b) - n + 1))
                if 100 * m >= percent * n and m > found.get((d, item), (0, 0))[1]:
                    found[d, item] = (n, m)
    return found


def bm25(rows, queries, k=10, k1=1.2, b=0.75):
    """[(query, rank, doc_id, score)]."""
    docs = [(i, Counter(symbol_words(t))) for i, t in rows]
    df = Counter(w for _, c in docs for w in c)
    mean = max(1, sum(sum(c.values()) for _, c in docs)) / len(docs)
    out = []
    for q, text in queries:
        asked, scored = Counter(symbol_words(text)), []
        for i, c in docs:
            score = 0.0
            for w, times in asked.items():
                if c[w]:
                    idf = math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    score += times * idf * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / mean))
            if score > 0 and i is not None:
                scored.append((-round(score, 6), i))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def lm_scores(rows, target, pull=5.0):
    """{doc_id: (n_words, score)} by exact counts of words and word pairs, without the document's own."""
    texts = {i: blank_words(t) for i, t in rows}
    vocabulary = len({w for words in texts.values() for w in words})
    uni_of = {i: Counter(w) for i, w in texts.items()}
    bi_of = {i: Counter(zip(w, w[1:])) for i, w in texts.items()}
    total = {}
    for chosen in (True, False):
        ids = [i for i in texts if (i in target) == chosen]
        total[chosen] = sum((uni_of[i] for i in ids), Counter()), sum((bi_of[i] for i in ids), Counter())

    def loss(words, uni, bi, n, scale):
        out = 0.0
        for at, w in enumerate(words):
            p = (uni[w] * scale + 1) / (n * scale + vocabulary)
            if at:
                c = uni[words[at - 1]] * scale
                p = (min(bi[words[at - 1], w] * scale, c) + pull * p) / (c + pull)
            out -= math.log(p)
        return out / len(words)

    found = {}
    for i, words in texts.items():
        models = []
        for chosen in (True, False):
            uni, bi = total[chosen]
            if (i in target) == chosen:
                uni, bi = uni - uni_of[i], bi - bi_of[i]
            models.append((uni, bi, uni.total()))
        (tu, tb, tn), (gu, gb, gn) = models
        scale = tn / gn if tn and gn else 1.0
        found[i] = (len(words), loss(words, gu, gb, gn, scale) - loss(words, tu, tb, tn, 1.0) if words else 0.0)
    return found


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed=1, n=120, vocabulary=400, lo=5, hi=80):
    """Rows (doc_id, text) with near copies, exact copies, repeated lines, null, empty and blank texts."""
    rng = random.Random(seed)
    words = [f"w{k}" if k % 7 else f"Wé{k}" for k in range(vocabulary)]
    shared = [" ".join(rng.choices(words, k=8)) for _ in range(4)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        else:
            text = " ".join(rng.choices(words, k=rng.randint(lo, hi)))
        if kind > 0.8:
            text += "\n" + rng.choice(shared).upper() + " \n" + rng.choice(shared) + "\n"
        texts.append(text)
        rows.append((i * 7 % 1009, text))
    return rows + [(2000, None), (2001, ""), (2002, " \t\n "), (2003, "one Two"), (2004, "ONE two"), (2005, "x" * 5000), (2006, " ".join(words) * 20)]
