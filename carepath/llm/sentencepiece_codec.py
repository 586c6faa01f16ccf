"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The normalised text is cut into marked words (a run of U+2581 and what follows
it). No piece of the vocabulary reaches over such a cut, which is checked when
the model is loaded, so words encode by themselves. The distinct words of a slice
are sorted; walking them in order is a depth-first walk of their trie, and the
forward state of a common prefix is computed once.

The state of a prefix depends on the model's kind:

* unigram: the score of the best path (Viterbi) and its last piece;
* BPE: the last piece of the prefix's encoding. Exactly one piece that ends there
  fits, namely the one that forms a valid pair with the state before it (a pair
  is valid if encoding the two pieces' joint text gives back the two). So the
  forward pass has one path and needs no scores; merge ranks only decide pairs.

The model file is a public one, named by a path on the driver and sent to the
executors once (at most ``MAX_MODEL_BYTES``); nothing is trained. Text
normalisation is that of the model. Words are remembered between the slices of
a task, up to ``memo_words``, and forgotten at its end, as workers go on to other
stages (unless ``keep_words``). There is no shuffle.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows are encoded alike; an empty table gives an empty table; other
columns are carried, one named like an output is replaced by it; null ids decode
to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import map_arrow, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
MEMO_WORDS = 60_000
MEMO_PAIRS = 250_000
MARK = "\u2581"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message's fields."""
    def varint(i):
        x = shift = 0
        while True:
            b = raw[i]
            x |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return x, i
    i = 0
    while i < len(raw):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = raw[i:i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = raw[i:i + n], i + n
        yield tag >> 3, value


def model_kind(raw: bytes) -> int:
    """Kind of the model: field 3 of the trainer settings (field 2), of which the last counts; unigram if unset."""
    kinds = [kind for number, value in _fields(raw) if number == 2 for inner, kind in _fields(value) if inner == 3]
    return kinds[-1] if kinds else UNIGRAM


#: ``next`` of a prefix that no text has left yet; never written to.
NOWHERE: dict[str, Prefix] = {}


class Prefix:
    """A start of pieces: the pieces of two and more characters that it ends in, longest first, and where the
    next character leads."""

    __slots__ = ("text", "ends", "next")

    def __init__(self, text: str, owner: Codec | None):
        self.text = text
        ids = owner.ids if owner else {}
        self.ends = tuple((text[i:], len(text) - i) for i in range(len(text) - 1) if text[i:] in ids)
        self.next = NOWHERE


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, raw: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.kind = model_kind(raw)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        sp, n = self.sp, self.sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.raw: list[bytes] = []
        self.unk = sp.unk_id()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" \u2047 ".encode())
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                if re.search(f"[^{MARK}]{MARK}", piece):
                    raise ValueError(f"piece {piece!r} reaches over a word's start")
        self.root = Prefix("", None)
        self.prefixes: dict[str, Prefix] = {"": self.root}
        for piece in sorted(self.ids, key=len):
            for i in range(1, len(piece) + 1):
                if piece[:i] not in self.prefixes:
                    self.prefixes[piece[:i]] = Prefix(piece[:i], self)
        self.n_next = 0
        self.worst = min(self.score.values()) - 10.0
        self.prefix = sp.normalize("a") != "a"
        self.packed = {piece: np.int32(i).tobytes() for piece, i in self.ids.items()}
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    # -- words ------------------------------------------------------------
    def _merge(self, text: str) -> list[str]:
        """BPE by definition: join the best-scored neighbouring pair, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, pair: tuple[str, str]) -> bool:
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        left, right = pair
        known = self.pairs[pair] = self._merge(left + right) == ([left, right] if left else [right])
        return known

    def _step(self, at: Prefix, char: str) -> Prefix:
        """The longest suffix of ``at.text + char`` that starts a piece; remembered in ``at.next``."""
        if char not in self.prefixes:
            return self.root
        if self.n_next >= MEMO_PAIRS:
            self.forget_steps()
        text = at.text + char
        while text not in self.prefixes:
            text = text[1:]
        found = self.prefixes[text]
        at.next = at.next or {}
        at.next[char] = found
        self.n_next += 1
        return found

    def forget_steps(self) -> None:
        for known in self.prefixes.values():
            known.next = NOWHERE
        self.n_next = 0

    def _steps_bpe(self, word: str, start: int, state: list, spots: list) -> None:
        pairs, at = self.pairs, spots[-1]
        for i, char in enumerate(word[start - 1:], start):
            at = at.next.get(char) or self._step(at, char)
            spots.append(at)
            for piece, n in at.ends:
                pair = (state[i - n], piece)
                fits = pairs.get(pair)
                if self._fits(pair) if fits is None else fits:
                    state.append(piece)
                    break
            else:
                state.append(char)

    def _steps_unigram(self, word: str, start: int, state: list, spots: list) -> None:
        at = spots[-1]
        for i, char in enumerate(word[start - 1:], start):
            at = at.next.get(char) or self._step(at, char)
            spots.append(at)
            best = (state[i - 1][0] + self.score.get(char, self.worst), char)
            for piece, n in at.ends:
                s = state[i - n][0] + self.score[piece]
                if s > best[0] or s == best[0] and n > len(best[1]):
                    best = (s, piece)
            state.append(best)

    def segment(self, words: list[str]) -> list[list[str]]:
        """Pieces of each of the sorted distinct ``words``."""
        bpe = self.kind == BPE
        steps = self._steps_bpe if bpe else self._steps_unigram
        state: list = ["" if bpe else (0.0, "")]
        spots = [self.root]
        before, out = "", []
        for word in words:
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            del state[same + 1:], spots[same + 1:]
            steps(word, same + 1, state, spots)
            pieces, i = [], len(word)
            while i:
                piece = state[i] if bpe else state[i][1]
                pieces.append(piece)
                i -= len(piece)
            pieces.reverse()
            out.append(pieces)
            before = word
        return out

    def _numbers(self, pieces: list[str]) -> bytes:
        """The ids of ``pieces`` as int32s; a character out of the vocabulary is its bytes, or the unknown id."""
        try:
            return b"".join(map(self.packed.__getitem__, pieces))
        except KeyError:
            out = []
            for p in pieces:
                if p in self.ids:
                    out.append(self.ids[p])
                elif self.byte_id:
                    out.extend(self.byte_id[b] for b in p.encode())
                else:
                    out.append(self.unk)
            return np.array(out, np.int32).tobytes()

    # -- texts ------------------------------------------------------------
    def encode_packed(self, texts: list[str], memo_words: int = MEMO_WORDS) -> list[bytes]:
        """The ids of each text as int32s."""
        units = [_UNIT.findall(self.sp.normalize(t)) if t else [] for t in texts]
        new = sorted(set(chain.from_iterable(units)).difference(self.memo))
        if len(self.memo) + len(new) > memo_words:
            self.memo.clear()
            new = sorted(set(chain.from_iterable(units)))
        self.memo.update(zip(new, map(self._numbers, self.segment(new)), strict=True))
        get = self.memo.__getitem__
        return [b"".join(map(get, u)) for u in units]

    def encode(self, texts: list[str], memo_words: int = MEMO_WORDS) -> list[list[int]]:
        return [_ids(x).tolist() for x in self.encode_packed(texts, memo_words)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def plain(self, text: str) -> str:
        """What decoding gives back: the normal form with marks as spaces."""
        text = self.sp.normalize(text).replace(MARK, " ") if text else ""
        return text[1:] if self.prefix and text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def codec(raw: bytes) -> Codec:
    """The codec of a model, one per process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def forget() -> None:
    """Drops the words and pairs this process remembers."""
    for known in _CODECS.values():
        known.memo, known.pairs = {}, {}
        known.forget_steps()


def load_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is over {MAX_MODEL_BYTES} bytes")
    return raw


def _carried(df: DataFrame, out: set[str], keep: str):
    columns = [c for c in df.columns if c == keep or c not in out]
    part = df.select(*columns)
    return part, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema)


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int32)


def _list(rows: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in rows], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_ids(b"".join(rows))))


def encode(docs: DataFrame, *, text_col: str = "text", model: str = MODEL, verify: bool = False,
           memo_words: int = MEMO_WORDS, keep_words: bool = False) -> DataFrame:
    """``docs`` with ``ids array<int>`` and ``n_ids long``; with ``verify`` also ``round_trip``: decoding the
    ids gives back the normalised text. ``memo_words`` bounds the words a task remembers (some 200 bytes each);
    with ``keep_words`` a worker keeps them for its later tasks."""
    names = ["ids", "n_ids"] + (["round_trip"] if verify else [])
    part_df, fields = _carried(docs, set(names), text_col)
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model))

    def run(batch):
        c = codec(shared.value)
        for part, blobs in text_slices(batch, text_col):
            texts = [b.decode("utf-8", "replace") for b in blobs]
            ids = c.encode_packed(texts, memo_words)
            cols = [_list(ids), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if verify:
                cols.append(pa.array([c.decode(_ids(x).tolist()) == c.plain(t)
                                      for x, t in zip(ids, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(list(part.columns) + cols, names=part.schema.names + names)

    extra = "ids array<int>, n_ids long" + (", round_trip boolean" if verify else "")
    return map_arrow(part_df, run, f"{fields}, {extra}", at_end=None if keep_words else forget)


def decode(df: DataFrame, *, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the text of ``ids_col`` as ``out_col``."""
    part_df, fields = _carried(df, {out_col}, ids_col)
    shared = df.sparkSession.sparkContext.broadcast(load_model(model))

    def run(batch):
        c = codec(shared.value)
        ids = batch.column(batch.schema.get_field_index(ids_col))
        text = pa.array([c.decode([i for i in (x.as_py() or []) if i is not None]) for x in ids], pa.string())
        yield pa.RecordBatch.from_arrays(list(batch.columns) + [text], names=batch.schema.names + [out_col])

    return map_arrow(part_df, run, f"{fields}, `{out_col}` string")


def report(docs: DataFrame, model: str = MODEL, memo_words: int = 800_000) -> DataFrame:
    """doc_id, ids, their number and digest, and whether decoding gives the text back."""
    out = encode(docs.select("doc_id", "text"), model=model, verify=True, memo_words=memo_words, keep_words=True)
    return out.select("doc_id", "n_ids", F.md5(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_md5"),
                      "round_trip", "ids")
