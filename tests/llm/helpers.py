"""Inputs shared by the tests of the training-data operators."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, key string, size long, `class_id` long"
BLANK = "[ \\t\\n\\x0b\\x0c\\r]+"


def awkward(spark):
    """Null in any column, empty and blank texts, ties, repeated rows, one very long text, columns with clashing names."""
    long_text = "alpha beta gamma delta " * 20_000
    rows = [
        (1, "one two three four five six", "en", "a"),
        (1, "one two three four five six", "en", "a"),
        (2, "one two three  four five six", "en", None),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (None, "one two three four five six", "en", None),
        (None, None, None, None),
        (5, " \t\n", "de", "c"),
        (6, long_text, "de", "c"),
        (7, "é ü ß 漢字 😀 x", "fr", "a"),
        (8, "12345 !!! ---", "fr", "a"),
    ]
    return spark.createDataFrame([(*r, 1, 0.5, True, "k", 9, 8) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed=7, n=60, copies=30):
    """``(doc_id, text)``: independent texts, exact copies, and a crowd of edits of one text."""
    rng = random.Random(seed)
    texts = [" ".join(words_of(rng, rng.randint(3, 120))) for _ in range(n)]
    texts += [rng.choice(texts) for _ in range(n // 3)]
    base = words_of(rng, 150)
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["", "   ", "x", "x"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def shingles(text):
    w = [x for x in re.split(BLANK, text or "") if x]
    if not w:
        return Counter()
    return Counter([tuple(w)]) if len(w) < 5 else Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def classes(rows, similarity=0.8):
    """Class of each row by comparing all pairs."""
    bags = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            common = sum((a & bags[j]).values())
            union = sum(a.values()) + sum(bags[j].values()) - common
            if rows[i][1] == rows[j][1] or (union and common / union >= similarity):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        first[r] = min(first.get(r, doc_id), doc_id)
    return {doc_id: first[find(i)] for i, (doc_id, _) in enumerate(rows)}
