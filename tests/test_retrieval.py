"""The stored note index and retrieval from it."""

import os
import shutil
import time

import numpy as np
from pyspark.sql import functions as F

from carepath.operators import notes as N
from carepath.plans import notes_queries as Q
from carepath.sources import versions as V
from conftest import SF_SMALL

SCHEMA = "note_id long, subject_id long, hadm_id long, charttime timestamp_ntz, category string, text string"


def _notes(spark, rows):
    return spark.createDataFrame([(i, p, i, None, None, t) for i, p, t in rows], SCHEMA)


def _brute(notes, questions, k):
    """Cosine of TF-IDF vectors of every note of the patient."""
    tf = {i: (p, {}) for i, p, t in notes}
    for i, _, t in notes:
        for w in t.lower().split():
            tf[i][1][w] = tf[i][1].get(w, 0) + 1
    df = {}
    for _, c in tf.values():
        for w in c:
            df[w] = df.get(w, 0) + 1
    idf = {w: np.log((len(notes) + 1.0) / (n + 1.0)) for w, n in df.items()}

    def unit(c):
        v = {w: n * idf[w] for w, n in c.items() if idf.get(w)}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: round(x / norm, 9) for w, x in v.items()}
    vec = {i: (p, unit(c)) for i, (p, c) in tf.items()}
    out = {}
    for qid, p, t in questions:
        c = {}
        for w in t.lower().split():
            c[w] = c.get(w, 0) + 1
        q = unit(c)
        scored = [(-round(sum(x * v.get(w, 0) for w, x in q.items()), 9), i) for i, (s, v) in vec.items() if s == p]
        out[qid] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def _check(spark, tmp_path, notes, questions, k, probe, partitions=None):
    folder = str(tmp_path / "index")
    N.build_note_index(_notes(spark, notes), folder, partitions)
    qs = spark.createDataFrame(questions, "question_id long, subject_id long, question string")
    index = N.NoteIndex.read(spark, folder).of_patients(qs)
    hits = N.retrieve_topk(qs, N.vectorize_questions(qs, index.idf), index, k, probe)
    got = {}
    for r in hits.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.note_id, r.score))
    want = _brute(notes, questions, k)
    for qid, hit in want.items():
        assert [i for i, _ in got.get(qid, [])] == [i for i, _ in hit], qid
        assert np.allclose([s for _, s in got.get(qid, [])], [s for _, s in hit], atol=1e-8)
    return index, hits


def test_hits_equal_all_notes_scored(spark, tmp_path):
    rnd = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    share = 1.0 / np.arange(1, 61)
    text = lambda n: " ".join(rnd.choice(words, n, p=share / share.sum()))
    notes = [(i, int(rnd.integers(0, 5)), text(int(rnd.integers(1, 25)))) for i in range(400)]
    notes += [(1000 + i, 3, notes[7][2]) for i in range(10)] + [(2000, 9, "alone"), (2001, 9, "")]
    asked = [(i, int(rnd.integers(0, 6)), text(int(rnd.integers(1, 12)))) for i in range(60)]
    asked += [(500, 9, "nothing shared"), (501, 9, "alone"), (502, 77, "no such patient"), (503, 3, notes[7][2])]
    for k, probe in ((3, 4), (1, 1), (10, 2)):
        (tmp_path / str(k)).mkdir()
        _check(spark, tmp_path / str(k), notes, asked, k, probe)


def test_hot_patient_is_spread_over_partitions(spark, tmp_path):
    notes = [(i, 1 if i % 3 == 0 else 10 + i % 50, f"common word{i % 40} rare{i}") for i in range(1200)]
    index, _ = _check(spark, tmp_path, notes, [(1, 1, "common word3 rare300"), (2, 12, "common")], 3, 4, partitions=8)
    for table, order in (("docs", "note_id"), ("postings", "note_id")):
        files = (getattr(index, table).withColumn("file", F.input_file_name()).groupBy("file")
                 .agg(F.count("*").alias("n"), F.count_if(F.col("subject_id") == 1).alias("hot")).collect())
        total = sum(f.n for f in files)
        assert sum(f.hot > 0 for f in files) > 1, table
        assert max(f.n for f in spark.read.parquet(str(tmp_path / "index" / table)).withColumn("file", F.input_file_name())
                   .groupBy("file").agg(F.count("*").alias("n")).collect()) <= total * 0.6


def test_plan_joins_no_question_to_all_notes_and_pushes_patients(spark, tmp_path):
    notes = [(i, i % 7, f"a{i % 5} b{i % 3}") for i in range(70)]
    _, hits = _check(spark, tmp_path, notes, [(1, 2, "a1 b2"), (2, 3, "a4")], 3, 4)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(subject_id" in plan.replace("IsNotNull(subject_id), ", "").replace("IsNotNull(term), ", "")
    assert "/docs" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan


def test_index_is_built_once_and_again_when_an_input_changes(spark, tmp_path, monkeypatch):
    builds = []
    build = N.build_note_index
    monkeypatch.setattr(N, "build_note_index", lambda notes, folder, *a: (builds.append(folder), build(notes, folder)))
    monkeypatch.setattr(Q, "shared_path", lambda spark, name, unique=True: str(tmp_path / "store"))
    data = tmp_path / "data"
    shutil.copytree(SF_SMALL, data)
    os.chmod(data, 0o755)
    one = Q.note_index(spark, str(data))
    two = Q.note_index(spark, str(data))
    assert len(builds) == 1 and one.docs.inputFiles() == two.docs.inputFiles()
    target = data / "documents.parquet"
    os.chmod(target, 0o644)
    time.sleep(1.1)
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(50).toPandas().to_parquet(target)
    spark.catalog.clearCache()
    three = Q.note_index(spark, str(data))
    assert len(builds) == 2 and three.docs.count() < one.docs.count()
    assert V.manifest(spark, str(tmp_path / "store")).count() == 2


def test_unfinished_build_is_not_read(spark, tmp_path):
    root = str(tmp_path)

    def broken(folder):
        spark.range(3).write.parquet(f"{folder}/part")
        raise RuntimeError("stopped halfway")
    try:
        V.get_or_build(spark, root, "x", "f", broken)
    except RuntimeError:
        pass
    assert V.published(spark, root, "x", "f") is None
    folder = V.get_or_build(spark, root, "x", "f", lambda f: spark.range(3).write.parquet(f"{f}/part"))
    assert V.get_or_build(spark, root, "x", "f", broken) == folder


def test_vector_blocks_equal_brute_force(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(700, 8)).astype(np.float32)
    x[100:160] = x[99]                       # a group of copies: ties go to the lower id
    subject = np.where(np.arange(700) % 3 == 0, 1, np.arange(700) % 11 + 2)
    vec = spark.createDataFrame([(i, int(subject[i]), [float(v) for v in x[i]]) for i in range(700)] + [(900, 1, None)],
                                "note_id long, subject_id long, embedding array<float>")
    asked = vec.where("note_id % 5 = 0").select(F.col("note_id").alias("question_id"), "subject_id",
                                                F.col("embedding").alias("qvec"))
    for blocks in ((4096, 512), (16, 7)):
        got = {}
        for r in N.retrieve_topk_vectors(asked, vec, 3, *blocks).orderBy("question_id", "rank").collect():
            got.setdefault(r.question_id, []).append(r.note_id)
        for q in range(0, 700, 5):
            mine = np.flatnonzero(subject == subject[q])
            d = np.round(((x[mine].astype(float) - x[q].astype(float)) ** 2).sum(axis=1), 9)
            assert got[q] == mine[np.lexsort((mine, d))[:3]].tolist()
    plan = N.retrieve_topk_vectors(asked, vec)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and plan.count("Join") == 2      # each side meets its block counts only


def test_vectors_of_repeated_and_missing_ids_equal_counted_tokens(spark):
    """Rows of one note_id count together, and a term's notes are counted by note_id and patient."""
    rows = [(1, 1, "b a  b"), (1, 1, "a C"), (1, 2, "a d"), (None, 1, "a x"), (None, 1, "x"), (2, 2, " d e\tA "), (3, 2, ""), (4, 3, None)]
    notes = _notes(spark, rows)
    tf = {}
    for i, p, t in rows:
        for w in (t or "").lower().split():
            tf[i, p, w] = tf.get((i, p, w), 0) + 1
    df = {w: sum(1 for x in tf if x[2] == w) for _, _, w in tf}
    w = {x: n * np.log((len(rows) + 1.0) / (df[x[2]] + 1.0)) for x, n in tf.items()}
    norm = {i: np.sqrt(sum(v * v for x, v in w.items() if x[0] == i)) for i in (1, 2)}
    want = {x: round(v / norm[x[0]], 9) for x, v in w.items() if x[0] and v}
    vecs, idf = N.vectorize_notes(notes, parts=3)
    got = {(r.note_id, r.subject_id, r.term): r.weight for r in vecs.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert {r.term for r in idf.collect()} == set(df)


def test_hot_patient_in_many_blocks_equals_one_block(spark, tmp_path):
    notes = [(i, 1, f"common w{i % 7} v{i % 11} rare{i}") for i in range(300)]
    asked = [(i, 1, f"common w{i % 5} v{i % 3} rare{i}") for i in range(40)]
    index, _ = _check(spark, tmp_path, notes, asked, 3, 4)
    qs = spark.createDataFrame(asked, "question_id long, subject_id long, question string")
    hits = N.retrieve_topk(qs, N.vectorize_questions(qs, index.idf), index, 3, note_block=32, question_block=8)
    got = {(r.question_id, r.rank): r.note_id for r in hits.collect()}
    assert got == {(q, n + 1): i for q, hit in _brute(notes, asked, 3).items() for n, (i, _) in enumerate(hit)}


def test_no_posting_is_shuffled_and_no_pair_is_a_row(spark, tmp_path):
    notes = [(i, i % 7, f"a{i % 5} b{i % 3} common") for i in range(700)]
    N.build_note_index(_notes(spark, notes), str(tmp_path / "index"))
    index = N.NoteIndex.read(spark, str(tmp_path / "index"))
    plan = index.weights()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert index.postings.count() == 700      # a row of a note each
    qs = spark.createDataFrame([(1, 2, "a1 b2 common")], "question_id long, subject_id long, question string")
    plan = N.retrieve_topk(qs, N.vectorize_questions(qs, index.idf), index)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate explode(arrays_zip" not in plan


def test_contexts_read_notes_without_shuffling_them(spark):
    notes = _notes(spark, [(i, 1, f"text {i}") for i in range(50)])
    hits = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (2, 3, 1)], "question_id long, note_id long, rank int")
    qs = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "question_id long, subject_id long, question string")
    out = N.rag_context(hits, notes, qs)
    assert {r.question_id: r.context for r in out.collect()} == {1: "[None]\ntext 3\n\n[None]\ntext 2", 2: "[None]\ntext 3"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    sources = {r.question_id: r.n_sources for r in N.rag_sources(hits, notes, qs).collect()}
    assert sources == {1: 2, 2: 1}


def test_a_note_goes_once_to_the_questions_that_hit_it(spark):
    """Contexts are put together beside their questions: what is shuffled is a text per note and block of questions."""
    notes = _notes(spark, [(i, 1, f"text {i}") for i in range(50)] + [(2, 4, "other"), (2, 4, "another"), (60, 1, None)])
    hits = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (2, 3, 1), (3, 99, 1), (4, 60, 1), (4, 5, 2), (5, 60, 1)],
                                 "question_id long, note_id long, rank int")
    qs = spark.createDataFrame([(1, 1, "a"), (1, None, "again"), (2, 1, "b"), (3, 1, "c"), (4, 2, "d"), (5, 2, None), (6, 1, "e"), (None, 1, "f")],
                               "question_id long, subject_id long, question string")
    one = "[None]\ntext 3\n\n[None]\nanother\n\n[None]\nother\n\n[None]\ntext 2"
    want = [(1, 1, "a", one), (1, None, "again", one), (2, 1, "b", "[None]\ntext 3"), (4, 2, "d", "[None]\ntext 5"), (5, 2, None, "")]
    for block in (512, 1):
        out = N.rag_context(hits, notes, qs, question_block=block)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapCoGroupsInArrow") < plan.index("Exchange")


def test_shuffle_files_go_when_a_table_is_stored(spark, tmp_path):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(N._CLEANUP, None)
    stored = N._write(spark.range(1000).repartition(4, "id"), str(tmp_path / "stored"))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and stored.count() == 1000
    assert spark.conf.get(N._CLEANUP, None) == setting
