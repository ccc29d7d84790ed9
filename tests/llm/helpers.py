"""Small tables with the hard cases, and brute-force versions."""

import random

WORDS = "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu ka ke ki ko ku".split()


def words(rng, n):
    return [rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]


def documents(spark, rows, source="s"):
    """(doc_id, text) to a table with further columns, some with clashing names."""
    return spark.createDataFrame(
        [(i, t, "en", source, len(t or ""), "x", 1) for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, _block int",
    )


def family(seed=1, groups=12, size=6, length=80, edits=3):
    """Documents in families of edited copies, with nulls, empty, short and repeated texts."""
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "one  two"), (5, "one two three")]
    for _ in range(groups):
        base = words(rng, length)
        for k in range(size):
            text = list(base)
            for _ in range(rng.randrange(edits + 1) * (k > 0)):
                text[rng.randrange(length)] = "edit" + rng.choice(WORDS) + rng.choice(WORDS)
            rows.append((len(rows) + 10, " ".join(text)))
    rows.append((len(rows) + 10, rows[-1][1]))
    rows.append((len(rows) + 10, " ".join(words(rng, 30_000))))
    return rows


def groups_of(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
