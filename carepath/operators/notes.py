"""Clinical notes: documents, term vectors, exact per-patient retrieval, contexts.

Vectors are sparse TF-IDF weights, L2-normalised per note. Stored and shuffled they are one row per note (its
terms and their counts as two arrays); (note_id, subject_id, term, weight) rows are made from these where
they are asked for. Retrieval deals each patient's notes and questions into blocks and keeps k rows per
question and block, so no (question, note) pair becomes a row. The same vectorizer fits the notes and is
applied to questions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carepath.functions import scalar as X
from carepath.operators import prompts as P
from carepath.operators.joins import sized_broadcast, spread
from carepath.session import shared_path

# tokenisation = lower case, split on ASCII whitespace runs.
TOKEN_SPLIT = "[ \t\n\r\f]+"
#: Notes per patient that the index lists apart; twice the largest k of a retrieval.
HEADS = 20
#: Most bytes of a broadcast table of idf values or of norms; beyond it they are joined by a shuffle.
LOOKUP_BYTES = 160 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _text_of(c: str, missing: str) -> Column:
    """A metadata value as Python's str() prints it: a missing category is 'None', a missing time 'NaT'."""
    return F.coalesce(F.col(c).cast("string"), F.lit(missing))


def note_documents(notes: DataFrame, with_charttime: bool = True) -> DataFrame:
    """page_content + metadata per note (metadata flattened into columns)."""
    meta = [F.col("subject_id").alias("meta_subject_id"), F.col("hadm_id").alias("meta_hadm_id")]
    if with_charttime:
        meta.append(_text_of("charttime", "NaT").alias("meta_charttime"))
    meta.append(_text_of("category", "None").alias("meta_category"))
    return notes.select("note_id", F.col("text").alias("page_content"), *meta)


def notes_of(notes: DataFrame, patients: DataFrame) -> DataFrame:
    """Notes of the given patients (semi join on subject_id)."""
    return notes.join(patients.select("subject_id"), "subject_id", "left_semi")


def order_notes(notes: DataFrame) -> DataFrame:
    return notes.orderBy("subject_id", "charttime", "note_id")


def tokens(df: DataFrame, id_col: str, text_col: str, keep: list[str], parts: int | None = None) -> DataFrame:
    """(id, keep..., term, tf): every token of the whole text counted (``parts``: see ``spread``)."""
    t = spread(df.select(id_col, *keep, text_col), parts).select(id_col, *keep, F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("term"))
    return t.filter(F.col("term") != "").groupBy(id_col, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(notes: DataFrame, parts: int | None = None) -> DataFrame:
    """(note_id, subject_id, terms, tfs): one row per note, its distinct terms and how often each occurs.

    Tokens are sorted and counted inside the note's row, so no token is shuffled. Rows that share a note_id, or have
    none, are counted together by (note_id, subject_id) as ``tokens`` does (``parts``: see ``spread``).
    """
    repeated = notes.groupBy("note_id").agg(F.count("*").alias("n")).where("n > 1 OR note_id IS NULL").select("note_id")
    if repeated.isEmpty():
        return _counted_rows(spread(notes.select("note_id", "subject_id", "text"), parts))
    ids = sized_broadcast(repeated.where("note_id IS NOT NULL"))
    once = notes.where("note_id IS NOT NULL").join(ids, "note_id", "left_anti")
    again = notes.where("note_id IS NULL").unionByName(notes.join(ids, "note_id", "left_semi").select(notes.columns))
    together = (tokens(again, "note_id", "text", ["subject_id"]).groupBy("note_id", "subject_id")
                .agg(F.collect_list(F.struct("term", "tf")).alias("l"))
                .select("note_id", "subject_id", F.col("l.term").alias("terms"), F.col("l.tf").cast("array<int>").alias("tfs")))
    return _counted_rows(spread(once.select("note_id", "subject_id", "text"), parts)).unionByName(together)


def _counted_rows(notes: DataFrame) -> DataFrame:
    words = F.array_remove(F.split(F.lower(F.col("text")), TOKEN_SPLIT), "")
    # the place of each run of equal words in the sorted list, and the end of the last
    first = F.filter(F.sequence(F.lit(1), F.size("words")),
                     lambda i: (i == 1) | (F.get("words", i - 1) != F.get("words", i - 2)))
    return (notes.select("note_id", "subject_id", F.sort_array(words).alias("words")).where(F.size("words") > 0)
            .withColumn("first", first)
            .select("note_id", "subject_id", F.transform("first", lambda i: F.get("words", i - 1)).alias("terms"),
                    F.transform("first", lambda i, at: F.coalesce(F.get("first", at + 1), F.size("words") + 1) - i).alias("tfs")))


def fit_idf(counts: DataFrame, n_docs) -> DataFrame:
    """(term, idf) of ``term_counts`` with idf = ln((N + 1) / (df + 1)), the smoothed form Spark ML uses.

    ``n_docs`` may be a number or a scalar-subquery Column (no separate job).
    """
    n = F.lit(float(n_docs)) if isinstance(n_docs, (int, float)) else n_docs.cast("double")
    df_ = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df_.select("term", F.log((n + 1.0) / (F.col("df") + 1.0)).alias("idf"))


def _weights(tf: DataFrame, idf: DataFrame, id_col: str) -> DataFrame:
    w = tf.join(idf, "term", "inner").withColumn("w", F.col("tf") * F.col("idf")).filter(F.col("w") != 0)
    norms = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return (w.join(norms, id_col).withColumn("weight", X.stable(F.col("w") / F.col("norm")))
             .drop("w", "norm", "tf", "idf"))


def _unscaled(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """The counts as rows of a term each, with ``w`` = tf * idf.

    The rarest terms, most of a vocabulary, share the largest idf: only the others are looked up, by a broadcast
    while they are few enough, so that the rows of terms stay where they are.
    """
    most = idf.agg(F.max("idf").alias("idf")).first().idf
    others = sized_broadcast(idf.where(F.col("idf") < F.lit(most)), max_bytes=LOOKUP_BYTES)
    keep = [c for c in counts.columns if c not in ("terms", "tfs")]
    rows = (counts.select(*keep, F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
            .select(*keep, F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf")))
    return (rows.join(others, "term", "left")
            .select(*keep, "term", (F.col("tf") * F.coalesce("idf", F.lit(most))).alias("w")).where("w <> 0"))


def note_norms(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(note_id, norm): the length of each note's vector before it is scaled to one."""
    return (_unscaled(counts.select("note_id", "terms", "tfs"), idf).groupBy("note_id")
            .agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("note_id IS NOT NULL"))


def note_weights(counts: DataFrame, idf: DataFrame, norms: DataFrame) -> DataFrame:
    """(note_id, subject_id, term, weight) of ``term_counts``; the norms are joined before a note becomes many rows."""
    scaled = counts.join(sized_broadcast(norms, max_bytes=LOOKUP_BYTES), "note_id")
    return _unscaled(scaled, idf).select("note_id", "subject_id", "term", X.stable(F.col("w") / F.col("norm")).alias("weight"))


def _write(df: DataFrame, path: str) -> DataFrame:
    """The stored table. Its shuffle files go as soon as it is complete, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)
    return df.sparkSession.read.parquet(path)


def vectorize_notes(notes: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(note vectors, idf table). The counts, one row per note, are stored: idf, norms and weights read them."""
    folder = shared_path(notes.sparkSession, "note_vectors")
    counts = _write(term_counts(notes, parts), f"{folder}/counts")
    idf = _write(fit_idf(counts, notes.select(F.count(F.lit(1))).scalar()), f"{folder}/idf")
    return note_weights(counts, idf, _write(note_norms(counts, idf), f"{folder}/norms")), idf


@dataclass
class NoteIndex:
    """The stored tables of one build of the note index.

    ``docs``: the cleaned notes. ``postings``: (note_id, subject_id, terms, tfs), those of a note in one row. Both
    are range-partitioned on (subject_id, note_id) and ordered by them, so a patient's rows are a few row groups and
    a hot patient's are many files. ``norms``: (note_id, norm). ``heads``: each patient's first ``HEADS`` notes.
    ``idf``: (term, idf).
    """

    docs: DataFrame
    postings: DataFrame
    norms: DataFrame
    heads: DataFrame
    idf: DataFrame

    TABLES = ("docs", "postings", "norms", "heads", "idf")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> NoteIndex:
        return cls(*[spark.read.parquet(f"{folder}/{t}") for t in cls.TABLES])

    def weights(self) -> DataFrame:
        """(note_id, subject_id, term, weight): the postings as a row each."""
        return note_weights(self.postings, self.idf, self.norms)

    def terms(self) -> DataFrame:
        """(subject_id, term, max_weight, n_notes): the head of each patient's list of a term."""
        return self.weights().groupBy("subject_id", "term").agg(F.max("weight").alias("max_weight"), F.count("*").alias("n_notes"))

    def of_patients(self, asked: DataFrame, max_ids: int = 1000) -> NoteIndex:
        """The same index read for the patients in ``asked`` only.

        Up to ``max_ids`` distinct ids become a list that is pushed down to the scans, which skip the
        files and row groups of other patients; with more the joins have to do.
        """
        ids = [r.subject_id for r in asked.select("subject_id").distinct().limit(max_ids + 1).collect()]
        if len(ids) > max_ids:
            return self
        near = F.col("subject_id").isin([i for i in ids if i is not None])
        return NoteIndex(self.docs.where(near), self.postings.where(near), self.norms, self.heads.where(near), self.idf)


def build_note_index(notes: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Write the tables of ``NoteIndex`` under ``folder``; each is made from the stored one before it.

    Notes are shuffled once, for their order; their counts are made where the ordered notes lie, unless a number of
    ``partitions`` is asked for, which holds for both.
    """
    order = ["subject_id", "note_id"]

    def ordered(df: DataFrame) -> DataFrame:
        dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
        return dealt.sortWithinPartitions(*order)

    docs = _write(ordered(notes.select("note_id", "subject_id", "hadm_id", "charttime", "category", "text")), f"{folder}/docs")
    counts = term_counts(docs)
    counts = _write(ordered(counts) if partitions else counts.sortWithinPartitions(*order), f"{folder}/postings")
    idf = _write(fit_idf(counts, docs.select(F.count(F.lit(1))).scalar()), f"{folder}/idf")
    _write(note_norms(counts, idf), f"{folder}/norms")
    first = Window.partitionBy("subject_id").orderBy("note_id")
    _write(docs.select("subject_id", "note_id").withColumn("place", F.row_number().over(first))
           .where(F.col("place") <= HEADS).repartitionByRange("subject_id").sortWithinPartitions("subject_id"), f"{folder}/heads")


def vectorize_questions(questions: DataFrame, idf: DataFrame) -> DataFrame:
    """Questions weighted by the notes' idf; terms the corpus never saw carry no weight."""
    tf = tokens(questions, "question_id", "question", ["subject_id"])
    return _weights(tf, idf, "question_id")


def _best_in_block(k: int):
    def run(notes: pa.Table, questions: pa.Table) -> pa.Table:
        out: dict[str, list] = {"question_id": [], "subject_id": [], "note_id": [], "score": []}
        if notes.num_rows and questions.num_rows:
            subject, ids = notes["subject_id"][0].as_py(), notes["note_id"].to_numpy()
            terms, tfs = notes["terms"].combine_chunks(), notes["tfs"].combine_chunks()
            # a row of each (question, term) and of each (note, term), the terms as numbers
            words = pc.unique(questions["term"])
            number = pc.index_in(terms.flatten(), words).fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(number >= 0)
            note = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))[at]
            at, note = at[order := np.argsort(number[at], kind="stable")], note[order]
            starts = np.searchsorted(number[at], np.arange(len(words) + 1))
            asked_term = pc.index_in(questions["term"], words).to_numpy()
            idf = np.zeros(len(words))
            idf[asked_term] = questions["idf"].to_numpy()
            tf = tfs.flatten().to_numpy(zero_copy_only=False)[at].astype(np.float64)
            weight = np.round(tf * idf[number[at]] / notes["norm"].to_numpy()[note], 9)
            asked, asked_weight = questions["question_id"].to_numpy(), questions["weight"].to_numpy()
            # by question and term: the parts of a score are summed in the same order for every note
            order = np.lexsort((asked_term, asked))
            asked, asked_term, asked_weight = asked[order], asked_term[order], asked_weight[order]
            cuts = np.append(np.flatnonzero(np.diff(asked, prepend=asked[0] - 1)), len(asked)).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                lists = [slice(starts[t], starts[t + 1]) for t in asked_term[lo:hi]]
                parts = [weight[x] * w for x, w in zip(lists, asked_weight[lo:hi], strict=True)]
                score = np.bincount(np.concatenate([note[x] for x in lists]), np.concatenate(parts), len(ids))
                floor = np.partition(score, len(ids) - k)[len(ids) - k] if len(ids) > k else 0.0
                hit = np.flatnonzero((score >= floor - 1e-8) & (score > 0))
                score = np.round(score[hit], 9)
                for i in np.lexsort((ids[hit], -score))[:k].tolist():
                    for name, value in zip(out, (int(asked[lo]), subject, int(ids[hit[i]]), float(score[i])), strict=True):
                        out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds, strict=True)})
    return run


def retrieve_topk(questions: DataFrame, q_vecs: DataFrame, index: NoteIndex, k: int = 3, probe: int = 4,
                  note_block: int = 4096, question_block: int = 16384) -> DataFrame:
    """The k most similar notes of the question's own patient (exact cosine).

    Each patient's notes and questions are dealt into blocks (``probe`` has no effect any more); a task takes one block
    of each, adds up the lists of a question's terms and keeps its k best notes. So a question meets notes
    that share a term with it only, no (question, note) pair becomes a row, what is shuffled is the counts and
    k rows per question and block of notes, and a hot patient is many tasks. Notes that share no term score 0; k
    of them at most are wanted, and the patient's first 2k notes hold these. Weights and scores are rounded to 9 places,
    so copies of a note tie exactly and the lower note_id wins.
    """
    if 2 * k > HEADS:
        raise ValueError(f"k is at most {HEADS // 2}")
    spark = questions.sparkSession
    asked = _write(q_vecs.select("question_id", "subject_id", "term", "weight").join(index.idf, "term")
                   .where("question_id IS NOT NULL"), shared_path(spark, "question_terms"))
    held = index.postings.join(sized_broadcast(index.norms, max_bytes=LOOKUP_BYTES), "note_id")
    sizes = sized_broadcast(_write(
        index.postings.groupBy("subject_id").agg(F.count("*").alias("n")).join(
            asked.groupBy("subject_id").agg(F.count_distinct("question_id").alias("m")), "subject_id")
        .select("subject_id", F.ceil(F.col("n") / note_block).alias("note_blocks"),
                F.ceil(F.col("m") / question_block).alias("question_blocks")), shared_path(spark, "note_blocks")))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    note_side = held.join(sizes, "subject_id").select(
        "note_id", "subject_id", "norm", "terms", "tfs", F.pmod(F.xxhash64("note_id"), "note_blocks").alias("nb"),
        each("question_blocks").alias("qb"))
    question_side = asked.join(sizes, "subject_id").select(
        "question_id", F.col("subject_id").alias("subject_id"), "term", "weight", "idf", each("note_blocks").alias("nb"),
        F.pmod(F.xxhash64("question_id"), "question_blocks").alias("qb"))
    key = ["subject_id", "nb", "qb"]
    scored = note_side.groupBy(*key).cogroup(question_side.groupBy(*key)).applyInArrow(
        _best_in_block(k), "question_id long, subject_id long, note_id long, score double")
    fillers = (questions.select("question_id", "subject_id")
               .join(index.heads.where(F.col("place") <= 2 * k), "subject_id")
               .select("question_id", "subject_id", "note_id", F.lit(0.0).alias("score")))
    every = scored.unionByName(fillers).groupBy("question_id", "subject_id", "note_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("note_id"))
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lists) and (len(flat) % len(lists) or np.any(np.diff(lists.offsets.to_numpy()) != len(flat) // len(lists))):
        raise ValueError("vectors of one patient have different lengths")
    return flat.reshape(len(lists), -1)


def _nearest_in_block(k: int):
    def run(notes: pa.Table, questions: pa.Table) -> pa.Table:
        out: dict[str, list] = {"question_id": [], "subject_id": [], "note_id": [], "dist": []}
        if notes.num_rows and questions.num_rows:
            x, q, ids = _matrix(notes["embedding"]), _matrix(questions["qvec"]), notes["note_id"].to_numpy()
            xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
            near = qq[:, None] + xx[None, :] - 2.0 * (q @ x.T)
            kth = np.partition(near, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            # the product's rounding error: whatever could belong to the k nearest is measured again
            slack = 1e-8 + 1e-12 * (qq + xx.max())
            asked, subjects = questions["question_id"].to_pylist(), questions["subject_id"].to_pylist()
            for row in range(len(q)):
                at = np.flatnonzero(near[row] <= kth[row] + slack[row])
                dist = np.round(((x[at] - q[row]) ** 2).sum(axis=1), 9)
                for i in np.lexsort((ids[at], dist))[:k].tolist():
                    for name, value in zip(out, (asked[row], subjects[row], int(ids[at[i]]), float(dist[i])), strict=True):
                        out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds, strict=True)})
    return run


def retrieve_topk_vectors(queries: DataFrame, vectors: DataFrame, k: int = 3, note_block: int = 4096,
                          question_block: int = 512) -> DataFrame:
    """Exact k nearest given dense vectors (squared L2, 9 places) within the query's patient.

    ``queries``: (question_id, subject_id, qvec); ``vectors``: (note_id, subject_id, embedding). Each patient's
    notes and questions are dealt into blocks; a task takes one block of each, forms their distances as one matrix
    product and keeps k rows per question, so no (question, note) pair becomes a row and a hot patient is
    many tasks. Ties go to the lower note_id. Rows without a vector or patient take no part.
    """
    spark = queries.sparkSession
    asked = queries.where("qvec is not null").select("question_id", "subject_id", "qvec")
    held = vectors.where("embedding is not null").select("note_id", "subject_id", "embedding")
    sizes = (held.groupBy("subject_id").agg(F.count("*").alias("n")).join(
        asked.groupBy("subject_id").agg(F.count("*").alias("m")), "subject_id")
        .select("subject_id", F.ceil(F.col("n") / note_block).alias("note_blocks"),
                F.ceil(F.col("m") / question_block).alias("question_blocks")))
    path = shared_path(spark, "vector_blocks")
    sizes.write.parquet(path)
    sizes = sized_broadcast(spark.read.parquet(path))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    note_side = held.join(sizes, "subject_id").select(
        "note_id", "subject_id", "embedding", F.pmod(F.xxhash64("note_id"), "note_blocks").alias("nb"),
        each("question_blocks").alias("qb"))
    # the alias keeps its columns apart when notes ask for notes
    question_side = asked.join(sizes, "subject_id").select(
        "question_id", F.col("subject_id").alias("subject_id"), "qvec", each("note_blocks").alias("nb"),
        F.pmod(F.xxhash64("question_id"), "question_blocks").alias("qb"))
    key = ["subject_id", "nb", "qb"]
    hits = note_side.groupBy(*key).cogroup(question_side.groupBy(*key)).applyInArrow(
        _nearest_in_block(k), "question_id long, subject_id long, note_id long, dist double")
    w = Window.partitionBy("question_id").orderBy(F.asc("dist"), F.asc("note_id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _contexts_in_block(notes: pa.Table, asked: pa.Table) -> pa.Table:
    texts: dict[int, list[str]] = {}
    for i, block in zip(notes["note_id"].to_pylist(), notes["block"].to_pylist(), strict=True):
        texts.setdefault(i, []).append(block)
    contexts = []
    for hits in asked["hits"].to_pylist():
        found = [(h["rank"], b) for h in hits for b in texts.get(h["note_id"], ())]
        contexts.append("\n\n".join(b for _, b in sorted(x for x in found if x[1] is not None)) if found else None)
    out = asked.select(["question_id", "subject_id", "question"]).append_column("context", pa.array(contexts, pa.string()))
    return out.filter(out["context"].is_valid())


def _with_notes(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """Hits with their notes; the hits are stored first, so that few enough go to the notes and these stay where they are."""
    stored = _write(hits.select("question_id", "note_id", "rank"), shared_path(hits.sparkSession, "hits"))
    return notes.join(sized_broadcast(stored), "note_id")


def rag_context(hits: DataFrame, notes: DataFrame, questions: DataFrame, style: str = "api",
                question_block: int = 512) -> DataFrame:
    """Per question: the hits' "[category]\\ntext" (API) or "[category - charttime]\\ntext" (CLI),
    blank-line separated in rank order.

    A patient's questions are dealt into blocks. A note goes to a block once, however many of its questions hit it,
    and the contexts are put together there beside their questions, so that no context is shuffled.
    """
    spark = questions.sparkSession
    head = (F.format_string("[%s]", _text_of("category", "None")) if style == "api"
            else F.format_string("[%s - %s]", _text_of("category", "None"), _text_of("charttime", "NaT")))
    blocks = notes.select("note_id", F.concat(head, F.lit("\n"), F.col("text")).alias("block"))
    hit = (_write(hits.select("question_id", "note_id", "rank"), shared_path(spark, "hits"))
           .groupBy("question_id").agg(F.collect_list(F.struct("rank", "note_id")).alias("hits")))
    # where a question goes decides nothing but the place of the work; one without a patient goes to any
    who = F.coalesce("subject_id", F.lit(-1)).alias("who")
    sizes = _write(questions.groupBy(who).agg(F.ceil(F.count("*") / question_block).alias("n")), shared_path(spark, "question_blocks"))
    asked = _write(questions.select("question_id", "subject_id", "question", who).join(sized_broadcast(sizes), "who")
                   .join(hit, "question_id")
                   .select("question_id", "subject_id", "question", "hits",
                           F.xxhash64("who", F.pmod(F.xxhash64("question_id"), "n")).alias("place")), shared_path(spark, "asked"))
    wanted = _write(asked.select("place", F.explode("hits.note_id").alias("note_id")).distinct(), shared_path(spark, "wanted"))
    texts = blocks.join(sized_broadcast(wanted, max_bytes=LOOKUP_BYTES), "note_id")
    return texts.groupBy("place").cogroup(asked.groupBy("place")).applyInArrow(
        _contexts_in_block, "question_id long, subject_id long, question string, context string")


def rag_sources(hits: DataFrame, notes: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: its sources as a list of metadata in rank order, and the fixed answer when there are none."""
    n = notes.select("note_id", "subject_id", "hadm_id", _text_of("category", "None").alias("category"))
    src = (_with_notes(hits, n)
           .groupBy("question_id").agg(F.array_sort(F.collect_list(
               F.struct("rank", F.struct("subject_id", "hadm_id", "category").alias("m")))).alias("l")))
    j = questions.select("question_id", "subject_id").join(src, "question_id", "left")
    return j.select("question_id", "subject_id",
                    F.coalesce(F.size("l"), F.lit(0)).alias("n_sources"),
                    F.coalesce(F.transform("l", lambda x: x["m"]), F.array()).alias("sources"),
                    F.when(F.col("l").isNull(), F.lit(P.NO_NOTES_ANSWER)).alias("fixed_answer"))
