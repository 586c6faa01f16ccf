"""DuckDB SQL for the correctness gate.

``sql(body)`` prefixes a query with the shared CTE head: the raw-table
derivations of FIXTURES.md, then independently written SQL for the cleaned
and derived tables. DuckDB evaluates only the CTEs a query references.
The Spark side never runs this text; it is the second opinion.
"""

from __future__ import annotations

from carepath import schemas as S

FIXTURE_CTES = r"""
patients_raw AS (
  SELECT 0 AS seq, c_custkey AS subject_id,
         CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
         CASE WHEN c_custkey % 61 = 0 THEN 'not-a-date'
              ELSE CAST(make_date(CAST(1900 + c_custkey % 90 AS INT), CAST(1 + c_custkey % 12 AS INT),
                                  CAST(1 + c_custkey % 28 AS INT)) AS STRING) END AS dob
  FROM customer
  UNION ALL
  SELECT 1, c_custkey, 'F', '1950-01-01' FROM customer WHERE c_custkey % 41 = 0),
admissions_raw AS (
  SELECT 0 AS seq, o_orderkey AS hadm_id,
         CASE WHEN o_orderkey % 101 = 0 THEN 999999999 ELSE o_custkey END AS subject_id,
         CAST(o_orderdate AS STRING) AS admittime,
         CASE WHEN o_orderkey % 97 = 0 THEN 'bad'
              ELSE CAST(o_orderdate + INTERVAL '1' HOUR * CAST(6 + (o_orderkey * 37) % 300 AS INT) AS STRING) END AS dischtime,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'EMERGENCY'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'URGENT'
              WHEN o_orderpriority = '5-LOW' THEN 'ELECTIVE' ELSE 'NEWBORN' END AS admission_type
  FROM orders
  UNION ALL
  SELECT 1, o_orderkey, o_custkey, '2001-12-01 00:00:00', '2001-12-31 00:00:00', 'EMERGENCY'
  FROM orders WHERE o_orderkey % 89 = 0),
diagnoses_raw AS (
  SELECT o_custkey AS subject_id,
         CASE WHEN l_linenumber = 7 THEN NULL
              WHEN l_orderkey % 11 = 0 THEN concat(' ', lpad(CAST(l_partkey % 1000 AS STRING), 3, '0'), CAST(l_linenumber AS STRING))
              ELSE concat(lpad(CAST(l_partkey % 1000 AS STRING), 3, '0'), CAST(l_linenumber AS STRING)) END AS icd9_code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
icustays_raw AS (
  SELECT CASE WHEN event_id % 71 = 0 THEN NULL ELSE event_id END AS icustay_id, user_id AS subject_id,
         CASE WHEN event_id % 83 = 0 THEN NULL ELSE value / CAST(24 AS DOUBLE) END AS los
  FROM events WHERE event_type = 'error' AND event_id % 5 = 0),
notes_raw AS (
  SELECT doc_id AS seq, doc_id AS note_id,
         CASE WHEN doc_id % 13 = 0 THEN 999999999 ELSE doc_id % 97 END AS subject_id,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id * 3 END AS hadm_id,
         CAST(TIMESTAMP '2001-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id AS INT) AS STRING) AS charttime,
         CASE WHEN doc_id % 3 = 0 THEN 'Nursing' WHEN doc_id % 3 = 1 THEN 'Physician' ELSE 'Radiology' END AS category,
         CASE WHEN doc_id % 19 = 0 THEN NULL ELSE text END AS text
  FROM documents),
note_vectors AS (
  SELECT vec_id AS note_id, CAST(label AS BIGINT) AS subject_id, embedding FROM embeddings),
questions_raw AS (
  SELECT conv_id * 1000 + turn AS question_id, conv_id % 97 AS subject_id, text AS question
  FROM conversations WHERE role = 'user'),
risk_fixture AS (
  SELECT c_custkey AS subject_id, (c_custkey * 37 % 101) / CAST(100 AS DOUBLE) AS risk_score,
         CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS label,
         CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'ICU' WHEN c_custkey % 4 = 1 THEN 'MICU'
              WHEN c_custkey % 4 = 2 THEN 'Private' ELSE 'General' END AS predicted_ward
  FROM customer),
shap_fixture AS (
  SELECT c_custkey AS subject_id,
         (c_custkey * 13 % 41 - 20) / CAST(10 AS DOUBLE) AS shap_admission_count,
         (c_custkey * 17 % 31 - 15) / CAST(10 AS DOUBLE) AS shap_emergency_ratio,
         (c_custkey * 19 % 29 - 14) / CAST(10 AS DOUBLE) AS shap_days_since_last_admission,
         (c_custkey * 23 % 11 - 5) / CAST(10 AS DOUBLE) AS shap_has_previous_admission
  FROM customer WHERE c_custkey % 43 <> 0)
"""

US_DAY = "CAST(86400000000 AS DOUBLE)"
AS_OF = "TIMESTAMP '2002-01-01 00:00:00'"


def _charlson_values() -> str:
    rows = ", ".join(f"('{p}', '{c}', {w})" for c, p, w in S.charlson_rows())
    return f"SELECT * FROM (VALUES {rows}) AS t(prefix, condition, weight)"


CLEAN_CTES = f"""
patients_p AS (
  SELECT seq, subject_id, gender, TRY_CAST(dob AS DATE) AS dob FROM patients_raw),
patients AS (
  SELECT subject_id, gender, dob FROM (
    SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq) AS rn FROM patients_p) WHERE rn = 1),
admissions_k AS (
  SELECT * FROM admissions_raw WHERE subject_id IN (SELECT subject_id FROM patients)),
admissions AS (
  SELECT hadm_id, subject_id, admittime, dischtime, admission_type FROM (
    SELECT hadm_id, subject_id, TRY_CAST(admittime AS TIMESTAMP) AS admittime,
           TRY_CAST(dischtime AS TIMESTAMP) AS dischtime, admission_type,
           row_number() OVER (PARTITION BY hadm_id ORDER BY seq) AS rn
    FROM admissions_k) WHERE rn = 1),
notes_valid AS (
  SELECT * FROM notes_raw
  WHERE subject_id IN (SELECT subject_id FROM patients) AND hadm_id IN (SELECT hadm_id FROM admissions)),
notes_limited AS (
  SELECT * FROM notes_valid ORDER BY seq LIMIT 50000),
notes AS (
  SELECT seq, note_id, subject_id, hadm_id, TRY_CAST(charttime AS TIMESTAMP) AS charttime, category, text
  FROM notes_valid WHERE text IS NOT NULL),
stays AS (
  SELECT a.*, epoch_us(a.dischtime) - epoch_us(a.admittime) AS stay_us
  FROM patients p JOIN admissions a ON p.subject_id = a.subject_id
  WHERE a.dischtime IS NOT NULL AND a.admittime IS NOT NULL),
patient_features AS (
  SELECT subject_id,
         COUNT(hadm_id) AS admission_count,
         CAST(SUM(stay_us) AS DOUBLE) / COUNT(*) / {US_DAY} AS avg_los_days,
         MAX(stay_us) / {US_DAY} AS max_los_days,
         CAST(SUM(CASE WHEN admission_type = 'EMERGENCY' THEN 1 ELSE 0 END) AS DOUBLE)
           / CAST(NULLIF(COUNT(hadm_id), 0) AS DOUBLE) AS emergency_ratio,
         (epoch_us({AS_OF}) - epoch_us(MAX(admittime))) / {US_DAY} AS days_since_last_admission,
         CASE WHEN COUNT(hadm_id) > 1 THEN 1 ELSE 0 END AS has_previous_admission,
         CASE WHEN SUM(stay_us) > COUNT(*) * CAST({int(S.HIGH_RISK_MEAN_STAY_DAYS * S.US_PER_DAY)} AS BIGINT)
              THEN 1 ELSE 0 END AS high_risk_label
  FROM stays GROUP BY subject_id),
first_admit AS (
  SELECT subject_id, MIN(TRY_CAST(admittime AS TIMESTAMP)) AS first_admit FROM admissions_raw GROUP BY subject_id),
age_rows AS (
  SELECT p.subject_id, p.seq,
         CASE WHEN f.first_admit IS NULL OR TRY_CAST(p.dob AS DATE) IS NULL THEN NULL
              ELSE least(greatest(
                floor((epoch_us(f.first_admit) - epoch_us(CAST(TRY_CAST(p.dob AS DATE) AS TIMESTAMP))) / CAST(86400000000 AS BIGINT))
                / CAST(365.25 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(90 AS DOUBLE)) END AS age,
         CASE WHEN p.gender = 'M' THEN 1 ELSE 0 END AS gender_male
  FROM patients_raw p LEFT JOIN first_admit f ON p.subject_id = f.subject_id),
age_block AS (
  SELECT subject_id, age, gender_male FROM (
    SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq DESC) AS rn
    FROM age_rows WHERE age IS NOT NULL AND subject_id IS NOT NULL) WHERE rn = 1),
charlson_lookup AS ({_charlson_values()}),
diag_codes AS (
  SELECT DISTINCT subject_id, icd9_code FROM diagnoses_raw WHERE subject_id IS NOT NULL),
charlson AS (
  SELECT subject_id, CAST(SUM(weight) AS DOUBLE) AS charlson_score FROM (
    SELECT DISTINCT d.subject_id, l.condition, l.weight
    FROM diag_codes d JOIN charlson_lookup l ON starts_with(regexp_replace(d.icd9_code, '^[[:space:]]+|[[:space:]]+$', '', 'g'), l.prefix)) GROUP BY subject_id),
ndiag AS (
  SELECT subject_id, CAST(COUNT(DISTINCT icd9_code) AS INTEGER) AS num_diagnoses
  FROM diag_codes GROUP BY subject_id),
icu AS (
  SELECT subject_id, CAST(COUNT(icustay_id) AS INTEGER) AS num_icu_stays,
         round(COALESCE(SUM(los), CAST(0 AS DOUBLE)), 9) AS total_icu_hours, 1 AS had_icu
  FROM icustays_raw GROUP BY subject_id),
enhanced AS (
  SELECT a.subject_id, a.age, a.gender_male,
         COALESCE(c.charlson_score, CAST(0 AS DOUBLE)) AS charlson_score,
         COALESCE(n.num_diagnoses, 0) AS num_diagnoses,
         COALESCE(i.num_icu_stays, 0) AS num_icu_stays,
         COALESCE(i.total_icu_hours, CAST(0 AS DOUBLE)) AS total_icu_hours,
         COALESCE(i.had_icu, 0) AS had_icu
  FROM age_block a LEFT JOIN charlson c ON a.subject_id = c.subject_id
  LEFT JOIN ndiag n ON a.subject_id = n.subject_id LEFT JOIN icu i ON a.subject_id = i.subject_id),
features AS (
  SELECT f.*,
         COALESCE(e.age, CAST(0 AS DOUBLE)) AS age,
         COALESCE(e.gender_male, 0) AS gender_male,
         COALESCE(e.charlson_score, CAST(0 AS DOUBLE)) AS charlson_score,
         COALESCE(e.num_diagnoses, 0) AS num_diagnoses,
         COALESCE(e.num_icu_stays, 0) AS num_icu_stays,
         COALESCE(e.total_icu_hours, CAST(0 AS DOUBLE)) AS total_icu_hours,
         COALESCE(e.had_icu, 0) AS had_icu
  FROM patient_features f LEFT JOIN enhanced e ON f.subject_id = e.subject_id),
scores AS (
  SELECT subject_id, risk_score,
         CASE WHEN risk_score > 0.5 THEN 1 ELSE 0 END AS risk_prediction,
         CASE WHEN risk_score > 0 AND risk_score <= 0.3 THEN 'LOW'
              WHEN risk_score > 0.3 AND risk_score <= 0.6 THEN 'MEDIUM'
              WHEN risk_score > 0.6 AND risk_score <= 1.0 THEN 'HIGH' END AS risk_tier,
         predicted_ward, CAST(NULL AS DOUBLE) AS estimated_los_days
  FROM risk_fixture)
"""

SERVING_CTES = """
profile AS (
  SELECT s.subject_id, s.risk_score, s.risk_tier, s.predicted_ward, s.estimated_los_days,
         f.admission_count, f.emergency_ratio, f.avg_los_days,
         COALESCE(f.days_since_last_admission, -1) AS days_since_last_admission,
         COALESCE(f.age, 0) AS age, COALESCE(f.charlson_score, 0) AS charlson_score,
         COALESCE(f.num_diagnoses, 0) AS num_diagnoses, COALESCE(f.num_icu_stays, 0) AS num_icu_stays,
         COALESCE(f.total_icu_hours, 0) AS total_icu_hours, COALESCE(f.had_icu, 0) AS had_icu
  FROM scores s JOIN features f ON s.subject_id = f.subject_id),
shap_long AS (
  SELECT subject_id, 'shap_admission_count' AS feature, 0 AS position, shap_admission_count AS value FROM shap_fixture
  UNION ALL SELECT subject_id, 'shap_emergency_ratio', 1, shap_emergency_ratio FROM shap_fixture
  UNION ALL SELECT subject_id, 'shap_days_since_last_admission', 2, shap_days_since_last_admission FROM shap_fixture
  UNION ALL SELECT subject_id, 'shap_has_previous_admission', 3, shap_has_previous_admission FROM shap_fixture),
drivers AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY abs(value) DESC, position) AS rank FROM shap_long)
"""

NOTES_CTES = r"""
note_tf AS (
  SELECT note_id, subject_id, term, COUNT(*) AS tf FROM (
    SELECT note_id, subject_id, unnest(regexp_split_to_array(lower(text), '[ \t\n\r\f]+')) AS term FROM notes)
  WHERE term <> '' GROUP BY note_id, subject_id, term),
idf AS (
  SELECT term, ln((CAST((SELECT COUNT(*) FROM notes) AS DOUBLE) + 1.0) / (COUNT(*) + 1.0)) AS idf
  FROM note_tf GROUP BY term),
note_w0 AS (
  SELECT t.note_id, t.subject_id, t.term, t.tf * i.idf AS w FROM note_tf t JOIN idf i ON t.term = i.term
  WHERE t.tf * i.idf <> 0),
note_vecs AS (
  SELECT note_id, subject_id, term, round(w / sqrt(SUM(w * w) OVER (PARTITION BY note_id)), 9) AS weight FROM note_w0),
questions_ok AS (
  SELECT * FROM questions_raw WHERE regexp_matches(question, '[^[:space:]]')),
q_tf AS (
  SELECT question_id, subject_id, term, COUNT(*) AS tf FROM (
    SELECT question_id, subject_id, unnest(regexp_split_to_array(lower(question), '[ \t\n\r\f]+')) AS term
    FROM questions_ok)
  WHERE term <> '' GROUP BY question_id, subject_id, term),
q_w0 AS (
  SELECT t.question_id, t.subject_id, t.term, t.tf * i.idf AS w FROM q_tf t JOIN idf i ON t.term = i.term
  WHERE t.tf * i.idf <> 0),
q_vecs AS (
  SELECT question_id, subject_id, term, round(w / sqrt(SUM(w * w) OVER (PARTITION BY question_id)), 9) AS weight FROM q_w0),
dots AS (
  SELECT q.question_id, n.note_id, round(SUM(q.weight * n.weight), 9) AS score
  FROM q_vecs q JOIN note_vecs n ON q.subject_id = n.subject_id AND q.term = n.term
  GROUP BY q.question_id, n.note_id),
hits AS (
  SELECT * FROM (
    SELECT c.question_id, c.subject_id, c.note_id, COALESCE(d.score, 0) AS score,
           row_number() OVER (PARTITION BY c.question_id ORDER BY COALESCE(d.score, 0) DESC, c.note_id) AS rank
    FROM (SELECT q.question_id, q.subject_id, n.note_id FROM questions_ok q JOIN notes n ON q.subject_id = n.subject_id) c
    LEFT JOIN dots d ON c.question_id = d.question_id AND c.note_id = d.note_id)
  WHERE rank <= 3)
"""

_EXTRA_CTES: list[str] = [SERVING_CTES, NOTES_CTES]


def _round_exact(x: str, digits: int, half_up: bool = False) -> str:
    """SQL twin of ``scalar.round_half_even_exact`` or ``round_half_up_exact`` (Dekker error-free product)."""
    b = f"CAST({10 ** digits} AS DOUBLE)"
    x = f"CAST(({x}) AS DOUBLE)"
    v = f"abs({x})"
    c = "CAST(134217729 AS DOUBLE)"
    vh = f"(({v}) * {c} - (({v}) * {c} - ({v})))"
    vl = f"(({v}) - {vh})"
    bh = f"(({b}) * {c} - (({b}) * {c} - ({b})))"
    bl = f"(({b}) - {bh})"
    pr = f"(({v}) * {b})"
    err = f"((({vh} * {bh} - {pr}) + {vh} * {bl} + {vl} * {bh}) + {vl} * {bl})"
    r = f"floor({pr})"
    fr = f"({pr} - {r})"
    tie = f"{err} >= 0" if half_up else f"({err} > 0 OR ({err} = 0 AND ({r} - 2 * floor({r} / 2)) = 1))"
    k = f"((CASE WHEN {fr} > 0.5 OR ({fr} = 0.5 AND {tie}) THEN {r} + 1 ELSE {r} END) / {b})"
    return f"(CASE WHEN {x} < 0 THEN -{k} ELSE {k} END)"


def fmt(x: str, digits: int, sign: bool = False) -> str:
    """SQL twin of ``scalar.fmt_fixed``."""
    return f"printf('%{'+' if sign else ''}.{digits}f', {_round_exact(x, digits)})"


def fmt_browser(x: str, digits: int) -> str:
    """SQL twin of ``scalar.fmt_browser``."""
    return f"printf('%.{digits}f', {_round_exact(x, digits, half_up=True)})"


def pct(x: str) -> str:
    """SQL twin of ``scalar.fmt_percent``."""
    return f"({fmt(f'CAST({x} AS DOUBLE) * 100.0', 1)} || '%')"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, values: dict[str, str]) -> str:
    """SQL twin of ``prompts.fill``: printf over a literal template."""
    import re
    names = re.findall(r"\{(\w+)\}", template)
    fmt_ = re.sub(r"\{(\w+)\}", "%s", template.replace("%", "%%"))
    return f"printf({lit(fmt_)}, " + ", ".join(f"CAST({values[n]} AS VARCHAR)" for n in names) + ")"


def sql(body: str) -> str:
    parts = [FIXTURE_CTES.strip(), CLEAN_CTES.strip()] + _EXTRA_CTES
    head = "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts)
    body = body.strip()
    if body[:4].upper() == "WITH":          # the body's own CTEs continue the shared list
        return head + ",\n" + body[4:].strip()
    if body.startswith(","):
        return head + "\n" + body
    return head + "\n" + body
