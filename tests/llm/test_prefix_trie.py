import hashlib
import random
import zlib

from tidepool.llm import prefix_trie

SCHEMA = "conv_id bigint, turn int, role string, text string, node string, depth int, parent int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, 9) for r in rows], SCHEMA)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            what = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, what, role or "", text or ""))
    own = {c: [r[3:] for r in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children.get(p, [])) or 1
        saved[p] = sum(saved[q] for q in children.get(p, [])) + (len(members[p]) - 1) * len((p[-1][1] if p else "").encode())
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(paths[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(table(spark, rows)).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(60), 5000, 9999, 10000, 10004, -3, -7]:
        for k in range(rng.randrange(14)):
            rows.append((c, rng.choice([k, k, k, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é"])))
    rows += [(77, k, "u", "x") for k in range(40)] + [(78, k, "u", "x") for k in range(40)] + [(79, k, "u", "x") for k in range(35)]
    rows += rows[:5] + [(None, 1, "user", "a")]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_nested_chains_and_long_conversation(spark):
    """Each conversation leaves the one before it one turn later; one of them holds most rows."""
    rows = [(5 * c, k, "u", "same" if k < c else f"own {c} {k}") for c in range(12) for k in range(c + 2)]
    rows += [(1000, k, "u", f"{k % 7}") for k in range(3000)]
    assert found(spark, rows) == brute(rows)


def test_copies_share_every_node(spark):
    rows = [(5 * c, k, "u", "same") for c in range(3000) for k in range(2)]
    assert found(spark, rows) == brute(rows)


def test_turnless_conversation_and_empty_table(spark):
    alone = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(alone, 1, "user", "skipped")]
    assert found(spark, rows) == brute(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert prefix_trie.prefix_trie(table(spark, [])).collect() == [] and found(spark, [(None, 1, "u", "t")]) == []
