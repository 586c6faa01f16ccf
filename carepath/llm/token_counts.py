"""Token counts from a digest cache.

A cache is a Parquet folder of (version, digest, n_tokens): ``version`` is the
digest of the tokenizer file with its library's name and version, ``digest`` the
SHA-256 of the normalised text. Counting a table takes four steps: reduce it
to ids and digests; join the distinct digests to the stored counts of this
version; encode one text for each digest without one and append the counts;
join the stored counts back. A second run over the same texts encodes nothing,
and a new tokenizer file or library begins with no counts of its own.

Normalisation must not change a count: a null text is empty, else the text
itself, unless ``normalise`` gives another expression.

Encoding: for a byte-level BPE file without normaliser (checked when it is
loaded) a text is cut into the tokenizer's own pre-tokens, and the library
encodes each distinct one once per task (``MEMO_WORDS`` remembered at most).
Characters whose class could differ between regular expression engines send the whole text
to the library, as does any other kind of file. Strings of added tokens count as
the library counts them. Pieces of long texts end before white space that
follows a word, where no pre-token can reach over; a text is never truncated.

Scale: only ids and digests are shuffled, and one text per missing digest
(``first`` is aggregated before the shuffle, so a group of copies of any size
costs one row per task). Digests with many rows (``join_counted``) are joined by
broadcast, the others by shuffle. A lost executor costs its tasks: counts become
visible when Spark commits the append, and repeated appends of a digest are
read as one.

Defined cases: a null or empty text has 0 bytes and 0 tokens; null ids are kept;
repeated rows each get their count; an empty table gives an empty table and
leaves the cache as it is; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import join_counted, map_arrow, staged, text_slices, within
from carepath.session import shared_path

LIMIT = 1024
MAX_MODEL_BYTES = 64 << 20
MEMO_WORDS = 400_000
#: Missing digests up to this number are sent to all tasks (64 bytes each); more are joined by shuffle.
SENT_DIGESTS = 500_000
PIECE_CHARS = 500_000
SCHEMA = "digest binary, n_tokens long, version string"

# Fixed value: the published pre-token pattern of byte-level BPE (GPT-2).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes have long been settled; a text with any other goes to the library whole.
_UNSETTLED = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-ɏΑ-ΡΣ-ϿА-я‐-‧€]")
_CUT = re.compile(r"(?<=[^\s])(?=[ \n])")


def tokenizer_version(path: str, raw: bytes) -> str:
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    tag = f"{library.__name__} {library.__version__} ".encode()
    return hashlib.sha256(tag + raw).hexdigest()


class _Counter:
    """Token counts of texts for one tokenizer file's content."""

    def __init__(self, raw: bytes, is_model: bool):
        self.memo: dict[str, int] = {}
        if is_model:
            import sentencepiece
            lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
            self.whole = lambda texts: [len(x) for x in lib.encode(texts, num_threads=1)]
            self.split = None
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        lib = Tokenizer.from_str(raw.decode())
        lib.no_truncation()
        lib.no_padding()
        self.whole = lambda texts: [len(x) for x in lib.encode_batch_fast(texts, add_special_tokens=False)]
        spec = json.loads(raw)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = (spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
                 and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                 and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added))
        self.split = regex.compile(PRE_TOKEN) if plain else None
        self.special = [t["content"] for t in added]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if self.split is None or _UNSETTLED.search(text) or any(s in text for s in self.special):
            return sum(self.whole(_pieces(text) if self.split else [text]))
        total = 0
        for piece in _pieces(text):
            words = self.split.findall(piece)
            new = [w for w in dict.fromkeys(words) if w not in self.memo]
            if len(self.memo) + len(new) > MEMO_WORDS:
                self.memo.clear()
                new = list(dict.fromkeys(words))
            self.memo.update(zip(new, self.whole(new), strict=True) if new else ())
            total += sum(map(self.memo.__getitem__, words))
        return total


def _pieces(text: str) -> list[str]:
    """``text`` in pieces of about ``PIECE_CHARS``, cut where white space follows a word."""
    out, at = [], 0
    while len(text) - at > PIECE_CHARS:
        cut = _CUT.search(text, at + PIECE_CHARS)
        if cut is None:
            break
        out.append(text[at:cut.start()])
        at = cut.start()
    return out + [text[at:]]


def _content(text_col: str, normalise) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return normalise(text) if normalise else text


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def stored(spark, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of the cache for one tokenizer version, one row per digest."""
    table = spark.read.schema(SCHEMA).parquet(cache).where(F.col("version") == version)
    return table.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(texts: DataFrame, raw: bytes, is_model: bool) -> DataFrame:
    """(digest, n_tokens) of (digest, text) rows."""
    shared = texts.sparkSession.sparkContext.broadcast(raw)
    held: list[_Counter] = []

    def run(batch):
        if not held:
            held.append(_Counter(shared.value, is_model))
        for rows, bodies in text_slices(batch, "text"):
            counts = [held[0](b.decode("utf-8", "replace")) for b in bodies]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return map_arrow(texts, run, "digest binary, n_tokens long", at_end=held.clear)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, normalise=None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; what the cache lacks is encoded and appended to it.

    ``tokenizer`` is a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file on the driver,
    ``cache`` a folder that driver and executors share; it is made if absent.
    """
    spark = docs.sparkSession
    if os.path.getsize(tokenizer) > MAX_MODEL_BYTES:
        raise ValueError(f"{tokenizer} is larger than {MAX_MODEL_BYTES} bytes")
    with open(tokenizer, "rb") as f:
        raw = f.read()
    version = tokenizer_version(tokenizer, raw)
    spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("version").parquet(cache)

    text = F.coalesce(F.col(text_col), F.lit(""))
    content = _content(text_col, normalise)
    keys = staged(docs.select(F.col(id_col).alias("doc_id"), _digest(content).alias("digest"),
                              F.octet_length(text).cast("long").alias("n_bytes")), "token-keys")
    wanted = staged(keys.groupBy("digest").agg(F.count("*").alias("n")), "token-digests")
    missing = staged(wanted.join(stored(spark, cache, version), "digest", "left_anti").select("digest"), "token-misses")
    if not missing.isEmpty():
        texts = docs.select(_digest(content).alias("digest"), content.alias("text"))
        few = within(missing, SENT_DIGESTS)
        if few:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if not few:
            texts = texts.join(missing, "digest", "left_semi")
        fresh = _encoded(texts, raw, tokenizer.endswith(".model"))
        fresh.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    known = staged(wanted.join(stored(spark, cache, version), "digest"), "token-counts")
    return join_counted(keys, known, "digest", "n").select("doc_id", "n_bytes", "n_tokens")


def report(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Counts and whether they exceed ``limit``; without a named cache, a new one in the shared folder."""
    counted = count_tokens(docs, tokenizer, cache or shared_path(docs.sparkSession, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
