"""Token counts against the tokenizer libraries."""


import public_tokenizers
import pytest
from pyspark.sql import functions as F

from carepath.llm import token_counts
from carepath.llm.queries import QUERIES
from llm_fixtures import SF_SMALL, docs_frame, rng, table_rows  # noqa: F401

JSON, MODEL, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "<|endoftext|> a<|endoftext|>  b"), (None, "a row without an id"),
       (6, "é ü 😀 x\x1c\x1d y\x85z 你好 世界"), (7, "word " * 3000), (7, "word " * 3000), (8, "x" * 50_000),
       (9, "Tail\n\nlines\n\n\n"), (10, "I'll 've '' 's ''s don't\r\n  x  y 12三 ²½")]


def _library(path):
    if path.endswith(".model"):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(lib.encode(t))
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(path)
    return lambda t: len(lib.encode(t, add_special_tokens=False))


def _pairs(rows, count):
    return sorted(((i if i is not None else -1), len((t or "").encode()), count(t or "")) for i, t in rows)


def _got(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, r.n_tokens) for r in df.collect())


def test_query_equals_library(spark, table_rows):
    got = QUERIES["op12_token_counts"](spark, SF_SMALL).collect()
    want = {i: (b, n) for i, b, n in _pairs(table_rows("documents", "doc_id, text"), _library(JSON))}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


@pytest.mark.parametrize("path", [JSON, MODEL, WORDS])
def test_odd_texts_and_cache(spark, docs_frame, tmp_path, path):
    cache = str(tmp_path / "cache")
    docs = docs_frame(ODD)
    assert _got(token_counts.count_tokens(docs, path, cache)) == _pairs(ODD, _library(path))
    rows = spark.read.parquet(cache)
    n = rows.count()
    assert n == len({t or "" for _, t in ODD}) and rows.select("version").distinct().count() == 1
    # nothing is encoded twice: stored counts are used, here changed on purpose
    spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 1000).write.mode("append").partitionBy(
        "version").parquet(cache)
    again = _got(token_counts.count_tokens(docs, path, cache))
    assert again == sorted((i, b, c + 1000) for i, b, c in _pairs(ODD, _library(path)))
    assert spark.read.parquet(cache).count() == 2 * n
    # a new text is the only one added
    more = ODD + [(99, "a text not seen before")]
    token_counts.count_tokens(docs_frame(more), path, cache).count()
    assert spark.read.parquet(cache).count() == 2 * n + 1


def test_many_misses_take_the_shuffled_join(docs_frame, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "SENT_DIGESTS", 3)
    rows = ODD + [(20 + i, "copy of one text") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(50)]
    assert _got(token_counts.count_tokens(docs_frame(rows), JSON, str(tmp_path / "c"))) == _pairs(rows, _library(JSON))


def test_versions_do_not_mix(spark, docs_frame, tmp_path):
    docs, cache = docs_frame(ODD), str(tmp_path / "cache")
    for path in (JSON, WORDS, MODEL):
        assert _got(token_counts.count_tokens(docs, path, cache)) == _pairs(ODD, _library(path))
    assert spark.read.parquet(cache).select("version").distinct().count() == 3


def test_empty_table(docs_frame, tmp_path):
    assert token_counts.count_tokens(docs_frame([]), JSON, str(tmp_path / "c")).collect() == []


def test_pre_tokens_equal_library_on_random_strings(rng):
    with open(JSON, "rb") as f:
        count = token_counts._Counter(f.read(), False)
    want = _library(JSON)
    settled = [chr(c) for c in range(0x2100) if not token_counts._UNSETTLED.match(chr(c))]
    for c in settled:
        for t in (c, f"a{c}b", f" {c} ", f"1{c}{c}x"):
            assert count(t) == want(t), (t, hex(ord(c)))
    for _ in range(2000):
        t = "".join(rng.choices(settled + list(" \n'stremld") * 40, k=rng.randint(1, 40)))
        assert count(t) == want(t), t


def test_long_texts_are_cut_where_no_token_reaches(rng, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 50)
    with open(JSON, "rb") as f:
        count = token_counts._Counter(f.read(), False)
    want = _library(JSON)
    for alphabet in ("ab  \n\n\t'x1", "ab 你 <|endoftext|>\n"):
        for _ in range(200):
            t = "".join(rng.choices([alphabet[i] for i in range(len(alphabet))], k=400))
            assert count(t) == want(t)
    assert count("z" * 5000) == want("z" * 5000)
