import hashlib
import random
import zlib

import pytest

from noticeflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def brute(rows, group=100, most=6):
    """Every node of the rebuilt conversations, by dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [(x[3], x[4]) for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = (*own.get(c - c % group, [])[:h], *turns[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in below)]
        ends = ",".join(str(c) for c in sorted(c for c in cs if built[c] == node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS depth", "1 AS k1", "2 AS part", "3 AS weight")
    return sorted(map(tuple, prefix_trie.conversation_trie(df, **options).collect()), key=str)


def drawn(seed, n):
    pick = random.Random(seed)
    rows = [(c, t, pick.choice(["user", "assistant", None]), pick.choice(["a", "bb", "", None, "漢é"]))
            for c in [*range(100, 100 + n), *range(205, 209)] for t in range(pick.randint(1, 7))]
    rows += [(101, None, "user", "first"), (101, None, "user", "earlier"), (None, 0, "user", "nobody"), (102, 0, "user", "a"),
             (102, 0, "user", "a")]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_brute_force(spark, seed):
    rows = drawn(seed, 25)
    assert nodes(spark, rows) == brute(rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    """A conversation that spans many blocks, and ends in many blocks of ids."""
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 2)
    monkeypatch.setattr(prefix_trie.running, "__defaults__", (False, 3))
    rows = drawn(3, 12) + [(300, t, "user", str(t % 3)) for t in range(40)] + [(301, t, "user", str(t % 3)) for t in range(38)]
    assert nodes(spark, rows) == brute(rows)


def test_turnless_and_empty(spark):
    """Base 400 has no rows and 404 loses all its turns: its only node is the root."""
    c = next(c for c in range(401, 499) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "x")]
    assert nodes(spark, rows) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert nodes(spark, []) == []
    both = rows + [(x, 0, "user", "y") for x in range(500, 510)]
    assert nodes(spark, both) == brute(both)


def test_long_and_repeated_turns(spark):
    rows = [(600, 0, "user", "é" * 200_000), (600, 1, "user", "z")] + [(700, 0, "user", "z")] * 9
    assert nodes(spark, rows) == brute(rows)


def test_leaves_are_sequences_that_no_other_goes_on_from(spark):
    rows = [(c, t, "user", f"{t}") for c, n in ((100, 3), (200, 5), (300, 5)) for t in range(n)]
    turns, convs = prefix_trie.rebuilt(prefix_trie.ordered(spark.createDataFrame(rows, SCHEMA)))
    whole = prefix_trie.sequences(prefix_trie.prefixes(turns), convs)
    assert sorted((r["depth"], r["weight"], r["conv_id"], r["leaf"]) for r in whole.collect()) == [(3, 1, 100, 0), (5, 2, 200, 1)]
