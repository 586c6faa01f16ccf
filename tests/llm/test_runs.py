"""Periodic runs against all periods tried one by one."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from carepath.llm import word_runs
from carepath.llm.queries import QUERIES
from llm_fixtures import SF_SMALL, docs_frame, rng, table_rows  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lyndon(r):
    out = []
    for i in range(len(r)):
        j = i + 1
        while j < len(r) and r[j:] > r[i:]:
            j += 1
        out.append(j - i)
    return out


def _brute(words, min_words=24, min_times=3):
    """Maximal stretches of every period up to a third of the words, without those of a smaller period."""
    n, ids = len(words), np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else []
    smallest = {}
    for p in range(1, n // min_times + 1):
        off = np.flatnonzero(np.concatenate(([True], ids[:-p] != ids[p:], [True])))
        for a, b in zip(off[:-1], off[1:], strict=True):
            length = int(b - a - 1 + p)
            if b - a > 1 and length >= max(min_words, min_times * p):
                smallest.setdefault((int(a), length), p)
    return sorted((s, m, p) for (s, m), p in smallest.items())


def _summary(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = _brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def _same(rows, got):
    want = sorted(((i is None, i or 0, _summary(i, t)) for i, t in rows), key=str)
    have = sorted(((r.doc_id is None, r.doc_id or 0, (r.n_runs, r.start, r.length, r.period, r.exponent_milli,
                                                      r.runs_sha256, r.collapsed_sha256)) for r in got), key=str)
    assert have == want


def test_query(spark, table_rows):
    rows = [r for r in table_rows("documents", "doc_id, text")]
    got = QUERIES["op13_word_runs"](spark, SF_SMALL).collect()
    _same(rows, got)
    assert sum(r.n_runs > 0 for r in got) >= 10


def test_defined_cases(docs_frame):
    odd = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (None, "a row without an id " * 9), (6, "é ü 😀\x1c x" * 30),
           (7, "word " * 3000), (7, "word " * 3000), (8, "x" * 50_000), (9, "a b c " * 8), (10, "a b c " * 7 + "a b"),
           (11, " ".join(f"w{i}" for i in range(5000))), (12, "x y z x y z " * 20)]
    odd += [(i, " ".join(f"{k % 7}" for k in range(i))) for i in range(100, 160)]
    _same(odd, word_runs.report(docs_frame(odd)).collect())
    assert word_runs.report(docs_frame([])).collect() == []


def test_find_carries_columns(docs_frame):
    docs = docs_frame([(1, "a b " * 20 + "end"), (2, None)]).selectExpr("*", "1 AS runs", "'x' AS collapsed", "n AS `odd name`")
    got = {r.doc_id: r for r in word_runs.find(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 40, 2)] and got[1].collapsed == "a b end" and got[1]["odd name"] == 1
    assert got[2].runs == [] and got[2].collapsed == ""


def test_lyndon_array(rng):
    for _ in range(1500):
        n, k = rng.randint(1, 40), rng.choice([1, 2, 2, 3, 5])
        r = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5:
            r = (r[:rng.randint(1, 8)] * 40)[:n]
        assert word_runs.lyndon_array(r) == _lyndon(r)


def test_runs_of_made_up_words(rng):
    for _ in range(1500):
        words = []
        for _ in range(rng.randint(1, 6)):
            root = [rng.randrange(rng.choice([2, 3, 4])) for _ in range(rng.randint(1, 14))]
            words += root * rng.randint(1, 9) + [rng.randrange(20) for _ in range(rng.randint(0, 4))]
        assert word_runs.word_runs(words) == _brute(words)


def test_collided_hashes_are_found_out(rng, monkeypatch):
    """With all prefix hashes alike the word by word comparison still gives true runs only."""
    monkeypatch.setattr(word_runs, "_common", lambda total, power, i, p, most, step: most)
    words = [rng.randrange(9, 50) for _ in range(60)] + [1, 2, 3] * 12 + [rng.randrange(9, 50) for _ in range(60)]
    assert word_runs.word_runs(words) == _brute(words) == [(60, 36, 3)]


@pytest.mark.parametrize("kind", ["one word", "thue-morse", "fibonacci", "coin"])
def test_long_texts_take_time_in_proportion(kind, rng):
    n = 100_000
    if kind == "fibonacci":
        a, words = [0], [0, 1]
        while len(words) < n:
            a, words = words, words + a
    else:
        words = {"one word": lambda i: 1, "thue-morse": lambda i: bin(i).count("1") % 2, "coin": lambda i: rng.randrange(2)}[kind]
        words = list(map(words, range(n)))
    runs = word_runs.word_runs(words)
    if kind == "one word":
        assert runs == [(0, n, 1)]
    if kind == "thue-morse":
        assert runs == []       # overlap-free
    ids = np.array(words)
    for s, m, q in runs[:: max(1, len(runs) // 500)]:
        assert np.array_equal(ids[s:s + m - q], ids[s + q:s + m]) and m >= max(24, 3 * q)
        assert s == 0 or ids[s - 1] != ids[s - 1 + q]
        assert s + m == len(ids) or ids[s + m] != ids[s + m - q]


def test_limits_are_checked():
    with pytest.raises(ValueError):
        word_runs.word_runs([1] * 50, min_words=10)
