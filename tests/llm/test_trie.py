"""Prefix trie against dictionaries of whole prefixes, and its perfect hash."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from carepath.llm import prefix_trie
from carepath.llm.perfect_hash import PerfectHash
from carepath.llm.queries import ORACLE_SQL, QUERIES
from llm_fixtures import SF_SMALL, rng, table_rows  # noqa: F401

SCHEMA = "conv_id long, turn long, role string, text string, n long, depth string"


def _build(rows, rebuild):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    if not rebuild:
        return own
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def _brute(rows, rebuild=True):
    convs = _build(rows, rebuild)
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        value = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += value
            leaves[node[:d]] += node not in children
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), children.get(node, 0), leaves[node],
                   saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
                  for node, m in members.items())


def _got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_query_and_sql(spark, duck, table_rows):
    rows = table_rows("conversations", "conv_id, turn, role, text")
    got = QUERIES["op11_prefix_trie"](spark, SF_SMALL)
    want = _brute(rows)
    assert _got(got) == want and len(want) > 20
    sql = duck.execute(ORACLE_SQL["op11_prefix_trie"])
    names = [d[0] for d in sql.description]
    assert names == got.columns
    assert sorted(tuple(-1 if x is None else x for x in r) for r in sql.fetchall()) == want


ODD = ([(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c % 3}") for c in range(40) for t in range(c % 7)]
       + [(50, None, "user", "null turn first"), (50, 0, "user", "then"), (50, 0, "user", "a tie"), (50, 0, "user", "a tie"),
          (51, 1, None, None), (52, 1, "", ""), (53, 7, "x" * 5000, "é😀 " * 3000), (None, 1, "user", "no conversation"),
          (-3, 1, "user", "negative"), (-5, 1, "user", "base of it"), (-5, 2, "user", "more"), (54, 1, "a", "bc"), (55, 1, "ab", "c")])


@pytest.mark.parametrize("rebuild", [True, False])
def test_defined_cases(spark, rebuild):
    df = _frame(spark, ODD)
    got = prefix_trie.trie(df, form=prefix_trie.rebuilt if rebuild else prefix_trie.plain)
    assert _got(got) == _brute(ODD, rebuild)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_empty_table(spark):
    assert prefix_trie.report(_frame(spark, [])).collect() == []


@pytest.mark.parametrize("block, band, long", [(4, 5, 6), (3, 7, 1000), (100, 4, 10)])
def test_long_conversations_are_cut(spark, rng, monkeypatch, block, band, long):
    """Digests in blocks, paths in bands and turns by a distributed rank give the same nodes."""
    rows = [(c, t, "u", "same") for c in range(4) for t in range(30 + c)]
    rows += [(10 + c, t, "u", "same" if t < 13 else rng.choice("abc")) for c in range(12) for t in range(rng.randint(5, 25))]
    rows += [(100 + c, t, "u", str(t)) for c in range(3) for t in (8, 12, 12)]
    got = prefix_trie.trie(_frame(spark, rows), block=block, band=band, long=long, shard_rows=20)
    assert _got(got) == _brute(rows, False)


def test_many_copies(spark, monkeypatch):
    """A third of all conversations alike, a hot first turn; id lists that take several rows."""
    monkeypatch.setattr(prefix_trie, "LIST_BYTES", 50)
    rows = [(c, t, "u", "hot" if t == 0 or c % 3 == 0 else f"{c % 11}") for c in range(600) for t in range(3)]
    assert _got(prefix_trie.trie(_frame(spark, rows))) == _brute(rows, False)
    assert _got(prefix_trie.report(_frame(spark, rows))) == _brute(rows, True)


def test_perfect_hash(rng):
    for n in (0, 1, 2, 1000, 50_000):
        a, b = (np.array([rng.getrandbits(64) for _ in range(n)], np.uint64) for _ in range(2))
        table = PerfectHash(a, b)
        assert sorted(table.slots(a, b).tolist()) == list(range(n))
    with pytest.raises(KeyError):
        table.slots(a + np.uint64(1), b)
    with pytest.raises(ValueError):
        PerfectHash(np.zeros(2, np.uint64), np.zeros(2, np.uint64))
