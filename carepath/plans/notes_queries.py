"""Notes, retrieval and prompts over notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from carepath.functions.predicates import question_nonempty
from carepath.operators import notes as N
from carepath.operators import prompts as P
from carepath.operators.clean import limit_notes, semi_valid_notes
from carepath.plans.catalog import register
from carepath.plans.context import Clinic
from carepath.plans.oracle import fill, lit
from carepath.session import shared_path
from carepath.sources.versions import get_or_build, input_fingerprint


#: Changes whenever the tables of the index or their meaning change.
_INDEX_FORMAT = 2


def index_fingerprint(spark, sf_dir: str) -> str:
    """State of the tables that the cleaned notes are made of."""
    return input_fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in ("documents", "customer", "orders")], _INDEX_FORMAT)


def note_index(spark, sf_dir: str, rebuild: bool = False) -> N.NoteIndex:
    """The stored index of this directory's notes, built on first use and again when an input changes."""
    root = shared_path(spark, "note_index", unique=False)
    folder = get_or_build(spark, root, "notes", index_fingerprint(spark, sf_dir),
                          lambda f: N.build_note_index(Clinic(spark, sf_dir).notes, f), rebuild)
    return N.NoteIndex.read(spark, folder)


class _Retrieval:
    """Top-3 hits of the questions of one data directory, from the stored index."""

    def __init__(self, spark, sf_dir):
        self.questions = question_nonempty(Clinic(spark, sf_dir).questions)
        index = note_index(spark, sf_dir).of_patients(self.questions)
        self.notes = index.docs
        self.hits = N.retrieve_topk(self.questions, N.vectorize_questions(self.questions, index.idf), index, k=3)


@register("limit_notes", "SELECT seq, note_id FROM notes_limited")
def q_limit_notes(spark, sf_dir):
    c = Clinic(spark, sf_dir)
    return limit_notes(semi_valid_notes(c.notes_raw, c.patients, c.admissions)).select("seq", "note_id")


@register("order_notes", "SELECT note_id, subject_id, charttime FROM notes ORDER BY subject_id, charttime, note_id")
def q_order_notes(spark, sf_dir):
    return N.order_notes(Clinic(spark, sf_dir).notes).select("note_id", "subject_id", "charttime")


@register("note_documents", """
SELECT note_id, text AS page_content, subject_id AS meta_subject_id, hadm_id AS meta_hadm_id,
       COALESCE(CAST(charttime AS VARCHAR), 'NaT') AS meta_charttime, COALESCE(category, 'None') AS meta_category FROM notes""")
def q_note_documents(spark, sf_dir):
    return N.note_documents(Clinic(spark, sf_dir).notes)


@register("note_documents_api", """
SELECT note_id, text AS page_content, subject_id AS meta_subject_id, hadm_id AS meta_hadm_id,
       COALESCE(category, 'None') AS meta_category FROM notes""")
def q_note_documents_api(spark, sf_dir):
    """The service's documents: metadata without chart time."""
    return N.note_documents(Clinic(spark, sf_dir).notes, with_charttime=False)


@register("patient_notes", """
SELECT note_id, subject_id, hadm_id, charttime, category FROM notes
WHERE subject_id IN (SELECT subject_id FROM questions_raw WHERE regexp_matches(question, '[^[:space:]]'))
ORDER BY subject_id, charttime, note_id""")
def q_patient_notes(spark, sf_dir):
    """Notes of the patients being asked about (batch form of the one-patient load), by chart time."""
    c = Clinic(spark, sf_dir)
    asked = question_nonempty(c.questions).select("subject_id")
    return N.order_notes(N.notes_of(c.notes, asked)).select("note_id", "subject_id", "hadm_id", "charttime", "category")


@register("vectorize_notes", "SELECT note_id, subject_id, term, weight FROM note_vecs")
def q_vectorize_notes(spark, sf_dir):
    vecs, _ = N.vectorize_notes(Clinic(spark, sf_dir).notes, parts=2 * spark.sparkContext.defaultParallelism)
    return vecs


@register("note_index", "SELECT note_id, subject_id, term, weight FROM note_vecs")
def q_note_index(spark, sf_dir):
    """The postings of the stored index (built by the first query that needs it)."""
    return note_index(spark, sf_dir).weights()


@register("note_index_terms", """
SELECT subject_id, term, MAX(weight) AS max_weight, COUNT(*) AS n_notes FROM note_vecs GROUP BY subject_id, term""")
def q_note_index_terms(spark, sf_dir):
    """The heads of the inverted lists: largest weight and length of each patient's list of a term."""
    return note_index(spark, sf_dir).terms()


@register("retrieve_vectors", """
SELECT question_id, subject_id, note_id, dist, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dist, note_id) AS rank FROM (
    SELECT q.note_id AS question_id, q.subject_id, n.note_id,
           round(list_sum(list_transform(list_zip(q.embedding, n.embedding),
                                         lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))), 9) AS dist
    FROM note_vectors q JOIN note_vectors n ON q.subject_id = n.subject_id WHERE q.note_id % 20 = 0)) WHERE rank <= 3""")
def q_retrieve_vectors(spark, sf_dir):
    """Given vectors: every twentieth note's vector asks for the three nearest of its patient's notes."""
    v = Clinic(spark, sf_dir).note_vectors
    asked = v.where("note_id % 20 = 0").select(F.col("note_id").alias("question_id"), "subject_id",
                                               F.col("embedding").alias("qvec"))
    return N.retrieve_topk_vectors(asked, v, k=3)


@register("retrieve_topk", "SELECT question_id, subject_id, note_id, score, rank FROM hits")
def q_retrieve_topk(spark, sf_dir):
    return _Retrieval(spark, sf_dir).hits.select("question_id", "subject_id", "note_id", "score", "rank")


_CTX_API = "printf('[%s]', COALESCE(category, 'None')) || chr(10) || text"
_CTX_CLI = ("printf('[%s - %s]', COALESCE(category, 'None'), COALESCE(CAST(charttime AS VARCHAR), 'NaT'))"
            " || chr(10) || text")


def _context_sql(block: str) -> str:
    return f"""
SELECT q.question_id, q.subject_id, q.question, c.context FROM questions_ok q JOIN (
  SELECT h.question_id, string_agg({block}, chr(10) || chr(10) ORDER BY h.rank) AS context
  FROM hits h JOIN notes n ON h.note_id = n.note_id GROUP BY h.question_id) c ON q.question_id = c.question_id"""


@register("rag_context", _context_sql(_CTX_API))
def q_rag_context(spark, sf_dir):
    r = _Retrieval(spark, sf_dir)
    return N.rag_context(r.hits, r.notes, r.questions, "api")


@register("rag_context_cli", _context_sql(_CTX_CLI))
def q_rag_context_cli(spark, sf_dir):
    r = _Retrieval(spark, sf_dir)
    return N.rag_context(r.hits, r.notes, r.questions, "cli")


@register("rag_sources", f"""
SELECT q.question_id, q.subject_id, COALESCE(s.n_sources, 0) AS n_sources, COALESCE(s.sources, '[]') AS sources,
       CASE WHEN s.question_id IS NULL THEN {lit(P.NO_NOTES_ANSWER)} END AS fixed_answer
FROM questions_ok q LEFT JOIN (
  SELECT h.question_id, COUNT(*) AS n_sources,
         CAST(to_json(list({{'subject_id': n.subject_id, 'hadm_id': n.hadm_id, 'category': COALESCE(n.category, 'None')}}
                           ORDER BY h.rank)) AS VARCHAR) AS sources
  FROM hits h JOIN notes n ON h.note_id = n.note_id GROUP BY h.question_id) s ON q.question_id = s.question_id""")
def q_rag_sources(spark, sf_dir):
    """Sources of each answer, the list of metadata as JSON."""
    r = _Retrieval(spark, sf_dir)
    return N.rag_sources(r.hits, r.notes, r.questions).withColumn("sources", F.to_json("sources"))


def _prompt_sql(template: str, block: str) -> str:
    vals = {"subject_id": "subject_id", "context": "context", "question": "question"}
    return f"SELECT question_id, subject_id, {fill(template, vals)} AS prompt FROM ({_context_sql(block)})"


@register("prompt_rag", _prompt_sql(P.RAG_PROMPT, _CTX_API))
def q_prompt_rag(spark, sf_dir):
    r = _Retrieval(spark, sf_dir)
    return P.prompt_rag(N.rag_context(r.hits, r.notes, r.questions, "api"), "api")


@register("prompt_rag_cli", _prompt_sql(P.RAG_PROMPT_CLI, _CTX_CLI))
def q_prompt_rag_cli(spark, sf_dir):
    r = _Retrieval(spark, sf_dir)
    return P.prompt_rag(N.rag_context(r.hits, r.notes, r.questions, "cli"), "cli")
