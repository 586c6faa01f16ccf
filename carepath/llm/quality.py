"""Quality rules on words, lines and compression bands.

``score`` adds the measures and the verdict to every row, ``keep`` returns the
rows that pass. Each row is judged on its whole text by itself, so there is no
shuffle and a lost task is just run again.

Compression bands: the zstandard ratio (compressed / raw bytes) of the whole
text must lie inside the band of its length class, and of the text's fixed
chunks at most ``max_bad_chunks`` (a share) may leave the band for chunks. A
ratio under the band means repetition, one over it means noise such as encoded
data. Texts too short for the ratio to mean anything (under ``MIN_BYTES``) get
no verdict from the bands.

Defined cases: a null text counts as empty (all measures 0, fails the word
minimum); ties and repeated rows are judged alike; an empty table gives an
empty table; other columns are carried along, and a column of the input with
the name of a measure is replaced by the measure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import map_arrow, text_slices
from carepath.llm.textnum import windows, words

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, "
            "base_failed boolean, kept boolean")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_IS_WS = bytes(range(9, 14)) + b" "


@dataclass(frozen=True)
class Band:
    """Limits of the ratio for texts of at least ``from_bytes`` raw bytes."""

    from_bytes: int
    low: float
    high: float


#: Length classes. Natural prose compresses worse the shorter it is, so both limits fall with length;
#: the lower limit stays well under what prose of any language reaches. The upper one stands between 99% of
#: prose at the shortest length of a class (English licences and package descriptions: 0.88 at 192 bytes, 0.83
#: at 256, 0.81 at 320, 0.78 at 384, 0.73 at 512, 0.69 at 768, 0.65 at 1024, 0.57 at 2048, 0.50 at 4096, 0.42 at
#: 16384) and base64 at the longest (least of 4,500: 0.92 at 224, 0.90 at 255, 0.89 at 319, 0.87 at 383, 0.84 at
#: 511, 0.81 at 767, 0.79 at 1023; of fewer: 0.77 at 2047, 0.76 at 4095, 0.75 at 16384 and more).
BANDS = (Band(192, 0.30, 0.91), Band(224, 0.30, 0.89), Band(256, 0.30, 0.87), Band(320, 0.30, 0.85),
         Band(384, 0.30, 0.82), Band(512, 0.26, 0.78), Band(768, 0.26, 0.75), Band(1024, 0.23, 0.72),
         Band(2048, 0.23, 0.70), Band(4096, 0.20, 0.68), Band(16384, 0.16, 0.64))
MIN_BYTES = BANDS[0].from_bytes
CHUNK_BYTES = 2048
#: Band of one whole chunk (of prose 0.63 at most, of base64 0.77) and the share of chunks that may leave it.
CHUNK_BAND = Band(CHUNK_BYTES, 0.15, 0.70)
MAX_BAD_CHUNKS = 0.25
LEVEL = 3


def _band(n: int, bands: tuple[Band, ...]) -> Band | None:
    found = None
    for b in bands:
        if n >= b.from_bytes:
            found = b
    return found


def _compression(raw: bytes, packer, bands) -> tuple[float, int, int, int, bool]:
    """Ratio of the whole, number of whole chunks, chunks under and over the band, verdict."""
    if not raw:
        return 0.0, 0, 0, 0, True
    ratio = len(packer.compress(raw)) / len(raw)
    low = high = 0
    chunks = len(raw) // CHUNK_BYTES
    for i in range(chunks):
        r = len(packer.compress(raw[i * CHUNK_BYTES:(i + 1) * CHUNK_BYTES])) / CHUNK_BYTES
        low += r < CHUNK_BAND.low
        high += r > CHUNK_BAND.high
    band = _band(len(raw), bands)
    good = band is None or (band.low <= ratio <= band.high and low + high <= MAX_BAD_CHUNKS * chunks)
    return ratio, chunks, low, high, good


def _dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(_IS_WS)]
    return len(lines) - len(set(lines))


def _repeat_words(w, n: int) -> np.ndarray:
    """Per text: words inside a 3-word window that occurs twice or more in the text."""
    at, value = windows(w, 3)
    if not len(at):
        return np.zeros(n, np.int64)
    order = np.lexsort((value, w.doc[at]))
    d, v = w.doc[at][order], value[order]
    same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(w.doc), dtype=bool)
    for j in range(3):
        covered[at[twice] + j] = True
    return np.bincount(w.doc[covered], minlength=n)


def measure(texts: list[bytes], bands: tuple[Band, ...] = BANDS, min_words: int = 50,
            max_repeat: float = 0.5) -> list[np.ndarray]:
    """The columns of ``MEASURES`` for a slice of texts."""
    n = len(texts)
    packer = zstandard.ZstdCompressor(level=LEVEL)
    w = words(texts)
    per_text = lambda mask: np.add.reduceat(mask.astype(np.int64), w.text_start)
    n_words = np.bincount(w.doc, minlength=n)
    lead = (w.buf & 0xC0) != 0x80
    solid = np.zeros(len(w.buf) + 1, dtype=np.int8)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    in_word = np.cumsum(solid[:-1]).astype(bool)
    word_chars = per_text(in_word & lead)
    n_symbols = per_text(_SYMBOL[w.buf])
    dup = np.array([_dup_lines(t) for t in texts], dtype=np.int64)
    rep = _repeat_words(w, n)
    packed = [_compression(t, packer, bands) for t in texts]
    base_failed = (n_words < min_words) | (rep > max_repeat * n_words)
    good = np.array([p[4] for p in packed], dtype=bool)
    col = lambda i, t: np.array([p[i] for p in packed], dtype=t)
    return [n_words.astype(np.int64), word_chars, n_symbols, dup, rep.astype(np.int64), col(0, float),
            col(1, np.int64), col(2, np.int64), col(3, np.int64), base_failed, ~base_failed & good]


def score(docs: DataFrame, text: str = "text", bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """Every row with its measures, ``base_failed`` and ``kept``."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    carried = docs.select(*[c for c in docs.columns if c == text or c not in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)

    def run(batch):
        for part, texts in text_slices(batch, text):
            yield pa.RecordBatch.from_arrays(list(part.columns) + [pa.array(x) for x in measure(texts, bands)],
                                             names=part.schema.names + names)

    return map_arrow(carried, run, f"{fields}, {MEASURES}")


def keep(docs: DataFrame, text: str = "text", bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """The rows that pass the rules, with the columns they came with."""
    columns = docs.columns

    def run(batch):
        for part, texts in text_slices(batch, text):
            yield part.filter(pa.array(measure(texts, bands)[-1]))

    return map_arrow(docs, run, docs.schema).select(*columns)


def report(docs: DataFrame) -> DataFrame:
    """Digest columns per document."""
    return score(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("ratio", 6).alias("ratio"), "n_chunks", "n_low_chunks", "n_high_chunks")
