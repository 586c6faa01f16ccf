"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ from its place in a text by ``budget(n)``
edits (insertions, deletions, replacements of characters). It is cut into
budget + 1 pieces: with so few edits at least one piece occurs unchanged. All
pieces of a block of items are searched at once in the whole text
(Aho-Corasick); around every hit, the item's best match is found with Myers'
bit-parallel algorithm (1999) and counts if its distance is within the budget.

Texts and items are compared in a normal form: A-Z... of any script in lower
case, runs of white space as one space. Positions are those of the original.

An item of fewer than ``SHORT`` characters has no budget: it is found word for word, between
characters that are no letters or digits.

Distinct items are handled in blocks of about ``block_bytes`` characters, so what a task
holds is bounded whatever the size of the benchmark; all texts meet all blocks, and
``keep`` writes what is left between two of them.
There is no shuffle but that which merges a document's matches over the blocks.

Defined cases: a null or empty text has no matches; an item that is null or empty in
normal form is not searched; items alike in id and text are one, alike in text only
match each by itself; repeated rows match
alike; a null doc_id is carried; a very long text is searched whole, in time in
proportion to its length and hits; only the named columns are read.
"""

from __future__ import annotations

import bisect
import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import map_arrow, staged

SHORT = 40
#: Characters per tolerated edit; pieces are this long or longer.
CHARS_PER_EDIT = 20
BLOCK_BYTES = 4_000_000
MATCHES = "item_id long, start long, end long, distance long"
_WORD = re.compile(r"\S+")


def budget(n: int) -> int:
    return max(1, n // CHARS_PER_EDIT - 1) if n >= SHORT else 0


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normal form as spans of ``text`` (code points, end exclusive)."""
    norm_at, orig_at, length = [], [], []
    pos = 0
    for m in _WORD.finditer(text):
        norm_at.append(pos)
        orig_at.append(m.start())
        length.append(m.end() - m.start())
        pos += len(m.group().lower()) + 1

    def place(p: int) -> int:
        i = max(0, bisect.bisect_right(norm_at, p) - 1)
        return orig_at[i] + min(p - norm_at[i], length[i])
    return [(place(a), place(b - 1) + 1) for a, b in spans]


class Item:
    """A pattern with its edit budget and Myers' bit masks."""

    def __init__(self, item_id, text: str):
        self.id, self.text, self.n, self.k = item_id, text, len(text), budget(len(text))
        self.masks: dict[str, int] = {}
        self.back: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | (1 << i)
        for i, c in enumerate(reversed(text)):
            self.back[c] = self.back.get(c, 0) | (1 << i)

    def pieces(self):
        parts = self.k + 1
        for i in range(parts):
            a, b = i * self.n // parts, (i + 1) * self.n // parts
            yield a, self.text[a:b]

    def best(self, window: str, masks: dict[str, int], free_start: bool) -> tuple[int, int]:
        """Least distance of the pattern to a substring of ``window`` (or to a prefix, if the
        start is not free) and the end of the first such substring."""
        ones, top = (1 << self.n) - 1, 1 << (self.n - 1)
        plus, minus, score = ones, 0, self.n
        least, at = self.n, 0
        for j, c in enumerate(window):
            eq = masks.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (ones & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) & ones
            if not free_start:
                ph |= 1
            plus = ((mh << 1) & ones) | (ones & ~(xv | ph))
            minus = ph & xv
            if score < least:
                least, at = score, j + 1
        return least, at

    def verify(self, text: str, diagonal: int) -> tuple[int, int, int] | None:
        """(start, end, distance) of the item near ``diagonal`` (its start if it had no edits)."""
        lo = max(0, diagonal - self.k)
        if text.startswith(self.text, max(0, diagonal)) and diagonal >= 0:
            end = diagonal + self.n
            inside = self.k == 0 and (text[max(0, diagonal - 1):diagonal].isalnum() or text[end:end + 1].isalnum())
            return None if inside else (diagonal, end, 0)
        if not self.k:
            return None
        window = text[lo:diagonal + self.n + self.k]
        d, end = self.best(window, self.masks, True)
        if d > self.k:
            return None
        _, back = self.best(window[:end][::-1], self.back, False)
        return lo + end - back, lo + end, d


class Matcher:
    """All items of a block: one automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [Item(i, t) for i, t in items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for offset, piece in item.pieces():
                owners.setdefault(piece, []).append((n, offset))
        self.auto = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.auto.add_word(piece, (len(piece), who))
        if owners:
            self.auto.make_automaton()
        self.empty = not owners

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) in the original text, one per place of an item."""
        if self.empty or not text:
            return []
        norm = normal(text)
        seen: dict[int, set[int]] = {}
        for end, (length, who) in self.auto.iter(norm):
            for n, offset in who:
                seen.setdefault(n, set()).add(end + 1 - length - offset)
        out = []
        for n, diagonals in seen.items():
            item, done = self.items[n], -1
            for diagonal in sorted(diagonals):
                if diagonal < done:      # inside a place already found
                    continue
                hit = item.verify(norm, diagonal)
                if hit:
                    out.append((item.id, *hit))
                    done = hit[1] - item.k
        if not out:
            return []
        spans = _original_spans(text, [(a, b) for _, a, b, _ in out])
        return sorted({(i, a, b, d) for (i, _, _, d), (a, b) in zip(out, spans, strict=True)},
                      key=lambda x: (x[1], x[2], x[0] or 0))


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items in blocks of bounded size; each block is what one pass holds in memory."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_bytes)) if total else 0
    for i in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect() if n > 1 else items.collect()
        pairs = sorted(((r.item_id, normal(r.text)) for r in block), key=lambda p: (p[0] is None, p[0] or 0, p[1]))
        pairs = [p for p in pairs if p[1]]
        if pairs:
            yield pairs


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, distance): every place of an item in every text."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    schema = f"doc_id long, {MATCHES}"
    found = None
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        held: dict[str, Matcher] = {}

        def run(batch, shared=shared, held=held):
            if "m" not in held:
                held["m"] = Matcher(shared.value)
            rows = [(i.as_py(), *hit) for i, t in zip(batch.column(0), batch.column(1), strict=True)
                    for hit in held["m"].find(t.as_py() or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(5)],
                                                 names=["doc_id", "item_id", "start", "end", "distance"])

        part = map_arrow(texts, run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document that holds an item: its matches as sorted arrays."""
    hits = matches(docs, benchmark, **how)
    place = F.sort_array(F.collect_set(F.struct("start", "end", "item_id", "distance"))).alias("m")
    return hits.groupBy("doc_id").agg(place).select(
        "doc_id", F.array_sort(F.array_distinct("m.item_id")).alias("item_ids"),
        F.size("m").cast("long").alias("n_matches"), F.array_min("m.distance").alias("min_distance"),
        F.transform("m", lambda x: F.concat_ws(":", x["item_id"], x["start"], x["end"], x["distance"])).alias("places"))


def keep(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with the columns they came with."""
    columns = docs.columns
    out = docs
    for i, block in enumerate(_blocks(benchmark, block_bytes)):
        if i:       # a stage of its own for each block, so that no task holds two
            out = staged(out, "decontaminated")
        shared = docs.sparkSession.sparkContext.broadcast(block)
        held: dict[str, Matcher] = {}

        def run(batch, shared=shared, held=held):
            if "m" not in held:
                held["m"] = Matcher(shared.value)
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([not held["m"].find(t.as_py() or "") for t in texts], pa.bool_()))

        out = map_arrow(out, run, docs.schema).select(*columns)
    return out
