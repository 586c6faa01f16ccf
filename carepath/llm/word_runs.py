"""Periodic runs of words, found by Baier's grouping.

A run is a maximal stretch of words with a smallest period q. Every run holds,
under one of the two opposite word orders, a place whose longest Lyndon word has
length q (Bannai et al., "The runs theorem", 2017). Phase one of Baier's suffix
sorter (2016) sorts suffixes into groups by just that word: groups are taken from
the greatest down, each member points to the nearest earlier suffix of a lower
group, and the suffixes pointed to move into a new group whose context grows by the
finished one. What is left is the Lyndon array (Franek et al., 2017), under both
orders by two passes. Each place's Lyndon root is then extended to both sides by the
longest common extension (LCE): a binary search over prefix hashes for all places
at once, after which every reported run is compared word by word.

Only runs of at least ``min_words`` words and ``min_times`` periods are wanted, so
words that cannot lie in one are left out first. In such a run every window of
``SEED`` words recurs a period away inside the run, as 24 words are more than
two periods and a window leave uncovered. So each run lies whole in a stretch of
windows that occur twice in the text, and is maximal there if and only if it is in the text.
Stretches are found by hashes (a collision adds work, never loses a run).

Each row is worked on by itself: nothing is shuffled and a lost executor costs its
tasks. A task holds one slice of texts and one text's words; work grows in proportion to
the words, for any repetition, times the logarithm of a stretch in the LCE search.

Defined cases: a null or empty text has no words and no runs (four nulls, digests of
nothing); repeated rows are treated alike; a null id is carried and plants nothing; one
word said over and over is one run of period 1; an empty table gives an empty table;
other columns are not read by ``report`` and carried by ``find``, one named like an
output being replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from carepath.llm.common import map_arrow, text_slices
from carepath.llm.textnum import mix

MIN_WORDS = 24
MIN_TIMES = 3
#: Words of a window; sound while SEED <= (min_words + 5) // 3 and min_times >= 3 (see ``_stretches``).
SEED = 9
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]      # start, length, period


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place: phase one of Baier's sorter.

    Groups stand in one array by order; a group is known by where it starts. Those before
    ``end`` are open. Members move to the end of their group's part, which then is a
    new group just above what stays.
    """
    n = len(ranks)
    place = sorted(range(n), key=ranks.__getitem__)
    at, group, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for k, i in enumerate(place):
        if k and ranks[i] != ranks[place[k - 1]]:
            start = k
        at[i], group[i] = k, start
        size[start] += 1
    context, before = [1] * n, [-1] * n
    end = n
    while end:
        start = group[place[end - 1]]
        members = sorted(place[start:end]) if end - start > 1 else (place[start],)
        grown = context[members[0]]
        links: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                links[j] = links.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in links.items():
            moved.setdefault((-times, group[j]), []).append(j)
        for times, old in sorted(moved):
            out = moved[times, old]
            left = size[old] - len(out)
            new = old + left
            for k, j in enumerate(out, new):
                # changes places with whatever stands at the end of the group's part
                other, hole = place[k], at[j]
                place[k], place[hole] = j, other
                at[j], at[other] = k, hole
            # members that were swapped to the front stay in the old group
            for j in out:
                group[j] = new
                context[j] -= times * grown
            size[old], size[new] = left, len(out)
        end = start
    return context


def _stretches(ids: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Maximal stretches of at least ``min_words`` words all of whose windows of ``SEED`` words occur twice.

    If neither neighbour of a window one period away lies in a run of length L and period q, then
    L <= 2q + SEED - 2; with L >= 3q that is L <= 3 SEED - 6, which ``min_words`` exceeds.
    """
    n = len(ids) - SEED + 1
    if n < min_words - SEED + 1:
        return []
    value = mix(ids.astype(_U) + _U(1))
    window = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k in range(SEED):
            window = window * _BASE + value[k:k + n]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(n + 2, np.int8)
    twice[1 + order[1:][same]] = 1
    twice[1 + order[:-1][same]] = 1
    edge = np.diff(twice)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= min_words - SEED + 1
    return [(int(a), int(b) + SEED - 1) for a, b in zip(first[long], last[long], strict=True)]


def _common(total: np.ndarray, power: np.ndarray, i: np.ndarray, p: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Longest common extension of the places i and i + p, to the right (step 1) or left (-1), by binary search."""
    low, high = np.zeros(len(i), np.int64), most.copy()
    with np.errstate(over="ignore"):
        while np.any(low < high):
            mid = (low + high + 1) // 2
            a, b = (i, i + mid) if step > 0 else (i - mid, i)
            same = (total[b] - total[a]) * power[p] == total[b + p] - total[a + p]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _extended(ids: np.ndarray, roots: np.ndarray, min_words: int, min_times: int) -> set[Run]:
    """Runs to which the root of length ``roots[i]`` at each place i extends."""
    n = len(ids)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate(([_U(1)], np.full(n, _BASE, _U))), dtype=_U)
        total = np.concatenate(([_U(0)], np.cumsum(mix(ids.astype(_U) + _U(1)) * power[:n], dtype=_U)))
    i = np.flatnonzero(roots * min_times <= n)
    p = roots[i]
    start = i - _common(total, power, i, p, i, -1)
    length = i + p + _common(total, power, i, p, n - i - p, 1) - start
    good = length >= np.maximum(min_words, min_times * p)
    runs: set[Run] = set()
    for place, s, m, q in zip(i[good].tolist(), start[good].tolist(), length[good].tolist(), p[good].tolist(), strict=True):
        if (s, m, q) in runs:
            continue
        if not np.array_equal(ids[s:s + m - q], ids[s + q:s + m]):      # hashes collided: compare words instead
            off = np.flatnonzero(ids[:-q] != ids[q:])
            k = np.searchsorted(off, place)
            s = int(off[k - 1]) + 1 if k else 0
            m = (int(off[k]) if k < len(off) else n - q) + q - s
            if m < max(min_words, min_times * q):
                continue
        runs.add((s, m, q))
    return runs


def word_runs(words: list, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[Run]:
    """(start, length, period) of every run of the word list, ordered by start and period."""
    if min_words < 3 * SEED - 5 or min_times < 3:
        raise ValueError(f"needs min_words of at least {3 * SEED - 5} and min_times of at least 3")
    if len(words) < min_words:
        return []
    number: dict = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    # a run of period q has q distinct words at most, so it repeats two thirds of its own
    if len(ids) - len(number) < min_words - min_words // min_times:
        return []
    runs: set[Run] = set()
    for a, b in _stretches(ids, min_words):
        part = np.unique(ids[a:b], return_inverse=True)[1]
        for ranks in (part, part.max() - part):
            roots = np.array(lyndon_array(ranks.tolist()), np.int64)
            runs |= {(a + s, m, q) for s, m, q in _extended(part, roots, min_words, min_times)}
    return sorted(runs, key=lambda r: (r[0], r[2]))


def planted(words: list, doc_id: int | None) -> list:
    """The words with a periodic tail in every tenth document, decided by its id alone."""
    n, h = len(words), zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    root = words[a:a + period]
    return words[:a] + (root * ((n - a) // period + 1))[:n - a]


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period; of equal ones that with the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def find(docs: DataFrame, *, text_col: str = "text", min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period of each) and ``collapsed`` (the kept words, one space between)."""
    kept = [f for f in docs.schema if f.name not in ("runs", "collapsed")]

    def run(batch):
        for rows, texts in text_slices(batch, text_col):
            words = [t.split() for t in texts]
            found = [word_runs(w, min_words, min_times) for w in words]
            shorter = [b" ".join(collapsed(w, r)) for w, r in zip(words, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                list(rows.columns) + [
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found],
                             pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))),
                    pa.array(shorter, pa.binary()).cast(pa.string())], names=rows.schema.names + ["runs", "collapsed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_arrow(docs.select(*[f"`{f.name}`" for f in kept]), run,
                     f"{fields}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


_REPORT = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _summary(doc_id: int | None, text: bytes) -> tuple:
    words = planted(text.split(), doc_id)
    runs = word_runs(words)
    best = strongest(runs)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of run figures and digests per document, every tenth one with a planted period."""
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batch):
        for rows, texts in text_slices(batch, "text"):
            made = [_summary(i, t) for i, t in zip(rows.column(0).to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)],
                                             names=list(_REPORT))

    read = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    schema = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in _REPORT)
    return map_arrow(read, run, schema)
