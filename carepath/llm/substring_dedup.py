"""Repeated-passage removal by hashing units.

Units are whole lines, the sentences of every line (a line without sentence ends is
one sentence) and winnowed windows of ``WINDOW`` words: of every ``PASSAGE`` - ``WINDOW``
+ 1 neighbouring windows, the one with the smallest hash. A unit is normalised (lower
case, white space as one space) and hashed. All digests are grouped over the corpus; the
earliest occurrence by (doc_id, text hash, place) is kept. In every document the units
that occur earlier are joined to runs of neighbours, and runs of at least
``min_words`` words are removed, with their offsets in the original text. A line that
occurs earlier, as a line or as a sentence, is removed at any length, and so are
paragraphs, line by line.

Inside a line, a short sentence that happens to recur stays where it is. Two texts that
share ``PASSAGE`` words share a window within them, wherever sentences are torn or
edited, so a part of every such passage goes: all whole sentences next to the window,
and all of the passage's words but for at most ``PASSAGE`` - ``WINDOW`` at either end.

Texts are parsed once for all digests, which are written as two arrays per text. Units are
counted with a partial aggregation, so a line that a third of all documents share is one row per task;
only digests that occur twice travel on. Digests with very many occurrences are joined
back by broadcast (``join_counted``), the others by shuffle.

Defined cases: null and empty texts have no units and pass unchanged; rows alike in
id and text are one occurrence and are cut alike; a null id ranks last; ties in rank
cannot occur but for such rows; an empty table gives an empty table. Columns of the
input are carried; ``removed`` replaces a column of that name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import join_counted, map_arrow, staged
from carepath.llm.textnum import mix, words

MIN_WORDS = 25
#: Words of a shared passage that is always found, and of the windows it is found by (a power of two).
PASSAGE = 50
WINDOW = 32
_SENTENCE = re.compile(r"[^\n.!?]*[.!?]+[^\s.!?]*[ \t]*|[^\n.!?]+")
_LINE = re.compile(r"[^\n]+")
_WS_RUN = " \t\r\x0b\x0c"


def _spread(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def _windows(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Spans of each text's winnowed windows; of equal ones that overlap, the first."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    w = words([t.encode() for t in texts], lower=True)
    wide = PASSAGE - WINDOW + 1
    if len(w.value) < PASSAGE:
        return out
    h, size = w.value, 1
    with np.errstate(over="ignore"):
        while size < WINDOW:
            h = mix(h[:-size] * np.uint64(3) + h[size:])
            size *= 2
    inside = w.doc[:len(w.doc) - PASSAGE + 1] == w.doc[PASSAGE - 1:]
    least = np.pad(np.where(inside, _spread(h, wide, np.minimum), np.uint64(0)), wide - 1)
    at = np.flatnonzero(_spread(least, wide, np.maximum) == h)
    point = np.cumsum((w.buf & 0xC0) != 0x80)       # code points up to a byte, itself included
    base = point[w.text_start] - 1
    doc = w.doc[at]
    start, end = point[w.start[at]] - 1 - base[doc], point[w.end[at + WINDOW - 1]] - 1 - base[doc]
    free: dict[tuple[int, int], int] = {}
    for i, n, value, a, b in zip(at.tolist(), doc.tolist(), h[at].tolist(), start.tolist(), end.tolist(), strict=True):
        if free.get((n, value), 0) <= i:
            free[n, value] = i + WINDOW
            out[n].append((a, b))
    return out


def _kinds(text: str, windows: list[tuple[int, int]], min_words: int) -> list[tuple[tuple[int, int], bool]]:
    """Spans of the units in text order, and whether they are a whole line. Lines of several sentences and
    ``min_words`` words need no unit: their sentences make a run of that length."""
    out = dict.fromkeys(windows, False)
    for found in _LINE.finditer(text):
        at, parts = found.start(), []
        for m in _SENTENCE.finditer(found[0]):
            part = m[0].lstrip(_WS_RUN)
            if part:
                a = at + m.end() - len(part)
                parts.append((a, a + len(part.rstrip(_WS_RUN))))
        if len(parts) == 1:
            out[parts[0]] = True
        elif parts:
            for span in parts:
                out.setdefault(span, False)
            line = parts[0][0], parts[-1][1]
            if len(text[line[0]:line[1]].split()) < min_words:
                out[line] = True
    return sorted(out.items())


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Spans (code points, end exclusive) of the units with at least one word, in text order."""
    return [span for span, _ in _kinds(text, _windows([text])[0], min_words)]


def normal(unit: str) -> str:
    return " ".join(unit.lower().split())


def _key(text_col: str):
    return F.hash(F.coalesce(F.col(text_col), F.lit("")))


def unit_table(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(missing, doc_id, text_key, high, low): the digests of a text's units in text order, 64 and 32 bits of each."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), _key(text_col).alias("k"))

    def run(batch):
        ids, texts, keys = (batch.column(j).to_pylist() for j in range(3))
        texts = [t or "" for t in texts]
        start = 0
        while start < len(ids):
            digest, counts, size, end = [], [0], 0, start
            while end < len(ids) and size < 1_000_000:
                size += len(texts[end]) + 100
                end += 1
            part = slice(start, end)
            for t, spans in zip(texts[part], _windows(texts[part]), strict=True):
                digest += [xxhash.xxh3_128_digest(normal(t[a:b])) for (a, b), _ in _kinds(t, spans, min_words)]
                counts.append(len(digest))
            both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            edges = pa.array(counts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([d is None for d in ids[part]], pa.bool_()), pa.array(ids[part], pa.int64()),
                 pa.array(keys[part], pa.int32()), pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(both[:, 0]))),
                 pa.ListArray.from_arrays(edges, pa.array(both[:, 1].astype(np.int32)))],
                names=["missing", "doc_id", "text_key", "high", "low"])
            start = end

    return map_arrow(read, run, "missing boolean, doc_id long, text_key int, high array<long>, low array<int>")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, places array<int>, kept_in array<long>): the units of a text that occur earlier in
    the corpus, and the documents that hold those occurrences."""
    rank = F.struct("missing", "doc_id", "text_key", "place")
    kept = staged(unit_table(docs, id_col, text_col, min_words), "units")
    table = kept.select("missing", "doc_id", "text_key", F.posexplode(F.arrays_zip("high", "low")).alias("place", "d")).select(
        "missing", "doc_id", "text_key", "place", "d.high", "d.low")
    first = staged(table.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
                   .where("n > 1").select("high", "low", "first", "n"), "repeated-units")
    later = join_counted(table, first, ["high", "low"], "n").where(rank != F.col("first"))
    return later.groupBy("missing", "doc_id", "text_key").agg(
        F.sort_array(F.collect_set("place")).alias("places"),
        F.sort_array(F.collect_set("first.doc_id")).alias("kept_in")).drop("missing")


def _joined(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order of start as runs: joined if they overlap or only white space is between."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and (a <= out[-1][1] or text[out[-1][1]:a].isspace()):
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _runs(text: str, places: set[int], min_words: int) -> list[tuple[int, int]]:
    known = _kinds(text, _windows([text])[0], min_words)
    again = [x for i, x in enumerate(known) if i in places]
    long = [(a, b) for a, b in _joined(text, [span for span, _ in again]) if len(text[a:b].split()) >= min_words]
    return _joined(text, sorted(long + [span for span, line in again if line]))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return "".join(kept)


def dedup(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
          changed_only: bool = False) -> DataFrame:
    """``docs`` with the repeated passages cut out of the text and ``removed`` array<struct<start, end>> in
    code points of the original text, and ``kept_in``, the documents that keep an occurrence."""
    found = staged(repeated(docs, id_col, text_col, min_words), "repeats").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("places").alias("_places"),
        F.col("kept_in").alias("_kept_in"))
    columns = [c for c in docs.columns if c not in ("removed", "kept_in") or c == text_col]
    base = docs.select(*columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    extra = "removed array<struct<start:int,end:int>>, kept_in array<long>"
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (_key(text_col) == F.col("_key"))
    keyed = base.join(found, same, "inner" if changed_only else "left").drop("_id", "_key")
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batch):
        texts, places, kept_in = (batch.column(batch.schema.get_field_index(c)).to_pylist()
                                  for c in (text_col, "_places", "_kept_in"))
        runs = [_runs(t, set(p), min_words) if t and p else [] for t, p in zip(texts, places, strict=True)]
        take = [i for i, r in enumerate(runs) if r or not changed_only]
        part = batch.select(columns).take(pa.array(take, pa.int64()))
        new = pa.array([cut(texts[i], runs[i]) if runs[i] else texts[i] for i in take], pa.string())
        cols = [new if c == text_col else part.column(j) for j, c in enumerate(columns)]
        spans = pa.array([[{"start": a, "end": b} for a, b in runs[i]] for i in take], span_type)
        where = pa.array([[x for x in kept_in[i] if x is not None] if runs[i] else [] for i in take], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(cols + [spans, where], names=columns + ["removed", "kept_in"])

    return map_arrow(keyed, run, f"{fields}, {extra}")
