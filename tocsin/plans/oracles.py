"""DuckDB SQL that restates the registered queries on the same tables.

Written independently of the Spark expressions: cleaning runs step by step,
models as plain relational algebra. Queries without an entry are iterative
(linear models, principal components) and have tests of their own.
"""

from __future__ import annotations

from tocsin.constants import ALPHAS, BAD_PREFIXES, CLASSES, RESPONSE_LABELS, STOP_WORDS
from tocsin.functions.romanize import LATIN_ACCENTS, MALAYALAM
from tocsin.operators.tables import snake
from tocsin.plans.fixtures import AS_MALAYALAM, EXPERIMENTS, LATIN, label_map

W = r"\p{L}\p{N}_"
SP = r"\x09-\x0d\x1c-\x20\x85\p{Z}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def q_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


CLASS_LIST = q_list(CLASSES)
CLASS_ROWS = "(VALUES " + ", ".join(f"({i}, {q(c)})" for i, c in enumerate(CLASSES)) + ") AS cls(class_id, target_label)"
MAP_ROWS = "(VALUES " + ", ".join(f"({q(r)}, {q(t)})" for r, t in label_map().items()) + ") AS lm(raw_label, target_label)"


def sub(text: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(repl)}, 'g')"


def clean(text: str) -> str:
    """The ten cleaning steps, one at a time."""
    t = f"coalesce({text}, '')"
    t = sub(t, rf"http[^{SP}]+|www\.[^{SP}]+")
    t = f"regexp_replace({t}, {q(rf'^RT[{SP}]+')}, '')"
    t = sub(t, f"@[{W}]+")
    t = sub(t, f"#([{W}]+)", r"\1")
    t = f"replace(replace(replace({t}, '&amp;', 'and'), '&lt;', '<'), '&gt;', '>')"
    t = sub(t, f"[^{W}{SP}.,!?'-]", " ")
    t = sub(t, f"[{SP}]+", " ")
    return f"lower(trim({t}))"


def strip(text: str) -> str:
    return sub(text, f"^[{SP}]+|[{SP}]+$")


def words(text: str) -> str:
    return f"len(regexp_extract_all({text}, {q(f'[^{SP}]+')}))"


def hkey(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def hlong(key: str) -> str:
    return f"CAST('0x' || substr({key}, 1, 8) AS BIGINT)"


def checksum(col: str) -> str:
    return f"CAST(sum({hlong(f'md5({col})')}) AS BIGINT)"


def fingerprint(text: str) -> str:
    return f"lower(array_to_string(regexp_extract_all({text}, {q(f'[^{SP}]+')})[1:8], ' '))"


def strip_list(text: str) -> str:
    t = strip(text)
    t = sub(t, rf"^[{SP}]*[-•*][{SP}]+")
    t = sub(t, rf"^[{SP}]*\p{{Nd}}+[.)][{SP}]+")
    return strip(f"trim({t}, '\"''')")


def good(text: str, lo: int, hi: int) -> str:
    prefixes = " OR ".join(f"starts_with(lower({strip(text)}), {q(p)})" for p in BAD_PREFIXES)
    numbered = rf"^[{SP}]*\p{{Nd}}+[.)][{SP}]"
    return (
        f"({words(text)} BETWEEN {lo} AND {hi} AND NOT ({prefixes}) AND "
        f"(NOT regexp_matches({text}, {q(numbered)}) OR {words(sub(text, numbered + '+'))} >= {lo}))"
    )


MESSAGE = """
message AS (
  SELECT d.doc_id, d.text, d.source AS event, d.lang,
         CASE WHEN d.lang = 'en' THEN 'set1' ELSE 'set2' END AS event_set,
         CASE WHEN d.doc_id % 10 = 0 THEN 'dev' WHEN d.doc_id % 10 IN (1, 2) THEN 'test' ELSE 'train' END AS split,
         d.lang || '_' || l.quality || '_' || l.toxic AS raw_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
MAPPED = f"""{MESSAGE},
mapped AS (SELECT m.*, lm.target_label FROM message m LEFT JOIN {MAP_ROWS} ON m.raw_label = lm.raw_label)"""
PROCESSED = f"""{MAPPED},
cleaned AS (SELECT *, {clean('text')} AS clean_text FROM mapped),
processed AS (
  SELECT *, CAST(length(clean_text) AS INTEGER) AS text_length,
         CAST({words('clean_text')} AS INTEGER) AS word_count
  FROM cleaned WHERE clean_text <> '')"""
GENERATED = """
gen AS (SELECT doc_id AS arrival, doc_id // 10 AS call_id, text FROM documents)"""


def accepted(lo: int, hi: int, source: str = "gen", order: str = "arrival") -> str:
    return f"""
stripped AS (SELECT *, {strip_list('text')} AS clean_text FROM {source}),
passed AS (SELECT *, {fingerprint('clean_text')} AS fingerprint FROM stripped WHERE {good('clean_text', lo, hi)}),
kept AS (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY {order}) = 1)"""


AUGMENTED = f"""{PROCESSED},{GENERATED},{accepted(4, 400)},
augmented AS (
  SELECT doc_id, CAST(NULL AS BIGINT) AS arrival, clean_text, target_label, split, event, false AS is_synthetic,
         text_length, word_count
  FROM processed WHERE split = 'train'
  UNION ALL
  SELECT NULL, arrival, clean_text, 'Resource Requests', 'train', NULL, true,
         CAST(length(clean_text) AS INTEGER), CAST({words('clean_text')} AS INTEGER) FROM kept)"""

# --- predictions of the centroid models ---------------------------------------

PREDS = f"""
vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dims AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec),
mean_dims AS (SELECT label, i, avg(x) AS x FROM dims GROUP BY label, i),
cent AS (SELECT label, list(x ORDER BY i) AS c FROM mean_dims GROUP BY label),
cand AS (
  SELECT vec_id, vec.label, cent.label AS cl,
         list_cosine_similarity(v, c) AS cosine, -pow(list_distance(v, c), 2) AS euclid
  FROM vec, cent),
class_score AS (
  SELECT vec_id, label, cl % 5 AS class_id, max(cosine) AS cosine, max(euclid) AS euclid
  FROM cand GROUP BY ALL),
score AS (
  SELECT 'cosine' AS model, vec_id, label, class_id, cosine AS score FROM class_score
  UNION ALL SELECT 'euclid', vec_id, label, class_id, euclid FROM class_score),
preds AS (
  SELECT model, vec_id AS doc_id, {CLASS_LIST}[label % 5 + 1] AS y_true,
         {CLASS_LIST}[arg_max(class_id, score) + 1] AS y_pred
  FROM score GROUP BY model, vec_id, label),
scores AS (
  SELECT model, {CLASS_LIST}[class_id + 1] AS class, score, label % 5 = class_id AS positive
  FROM score)"""


def report_ctes(preds: str, by: str = "model") -> str:
    """Class report over a prediction table, as CTE ``report``."""
    b = f"{by}, " if by else ""
    groups = f"(SELECT DISTINCT {by} FROM {preds})" if by else "(SELECT 1 AS one)"
    on = f"AND p.{by} = g.{by}" if by else ""
    g = f"g.{by}, " if by else ""
    return f"""
report0 AS (
  SELECT {g}cls.class_id, cls.target_label AS class,
         count(*) FILTER (p.y_true = cls.target_label AND p.y_pred = cls.target_label) AS tp,
         count(*) FILTER (p.y_pred = cls.target_label) AS predicted,
         count(*) FILTER (p.y_true = cls.target_label) AS support
  FROM {groups} g CROSS JOIN {CLASS_ROWS} JOIN {preds} p ON true {on}
  GROUP BY {g}cls.class_id, cls.target_label),
report AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
         CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
         CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1
  FROM report0),
acc AS (SELECT {b}avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n_rows
        FROM {preds} {f'GROUP BY {by}' if by else ''})"""


def means(only_seen: bool) -> str:
    f = "FILTER (support + predicted > 0)" if only_seen else ""
    macro = [f"round(avg({m}) {f}, 6) AS macro_{m}" for m in ("precision", "recall", "f1")]
    weighted = [
        f"round(sum({m} * support) / sum(support), 6) AS weighted_{m}" for m in ("precision", "recall", "f1")
    ]
    return ", ".join(macro + weighted)


def overall(by: str, only_seen: bool) -> str:
    if not by:
        return f"SELECT round(any_value(acc.accuracy), 6) AS accuracy, {means(only_seen)}, any_value(acc.n_rows) AS n_rows FROM report, acc"
    return (
        f"SELECT report.{by}, round(any_value(acc.accuracy), 6) AS accuracy, {means(only_seen)}, "
        f"any_value(acc.n_rows) AS n_rows FROM report JOIN acc ON report.{by} = acc.{by} GROUP BY report.{by}"
    )


# --- features and naive Bayes -----------------------------------------------------


def grams(source: str, name: str) -> str:
    """N-gram counts per document of ``source(doc_id, target_label, clean_text)``."""
    return f"""
{name}_tok AS (SELECT doc_id, target_label, regexp_extract_all(lower(clean_text), {q(f'[{W}]{{2,}}')}) AS t FROM {source}),
{name}_gram AS (
  SELECT doc_id, target_label, unnest(t) AS term FROM {name}_tok
  UNION ALL
  SELECT doc_id, target_label, a || ' ' || b FROM (
    SELECT doc_id, target_label, unnest(t[:-2]) AS a, unnest(t[2:]) AS b FROM {name}_tok WHERE len(t) > 1)),
{name} AS (SELECT doc_id, target_label, term, count(*) AS tf FROM {name}_gram GROUP BY ALL)"""


def vocab(terms: str, docs: str, min_df: int = 3, max_df: float = 0.95, max_features: int = 30000) -> str:
    return f"""
n_docs AS (SELECT count(*) AS n FROM {docs}),
vocab0 AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cnt FROM {terms} GROUP BY term
  HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT n FROM n_docs)
  ORDER BY cnt DESC, term LIMIT {max_features}),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, df, cnt,
         ln((1 + (SELECT n FROM n_docs)) / (1 + df)) + 1 AS idf
  FROM vocab0)"""


def tfidf(terms: str, name: str, sublinear: bool = True) -> str:
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return f"""
{name}_raw AS (SELECT t.doc_id, t.target_label, v.term_id, {tf} * v.idf AS raw FROM {terms} t JOIN vocab v ON t.term = v.term),
{name} AS (SELECT doc_id, target_label, term_id, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS x FROM {name}_raw)"""


def rows_of(split: str) -> str:
    return f"{split}_rows AS (SELECT * FROM processed WHERE split = '{split}' AND target_label IS NOT NULL)"


TRAIN_X = (
    PROCESSED + ",\n" + rows_of("train") + "," + grams("train_rows", "train_terms") + ","
    + vocab("train_terms", "train_rows") + "," + tfidf("train_terms", "train_x") + """,
scale AS (SELECT term_id, max(abs(x)) AS max_abs FROM train_x GROUP BY term_id)"""
)


def nb(alphas: list[float], train_x: str = "train_x", train_rows: str = "train_rows") -> str:
    return f"""
alphas AS (SELECT unnest([{', '.join(f'CAST({a} AS DOUBLE)' for a in alphas)}]) AS alpha),
weights AS (
  SELECT target_label, count(*) AS n_rows,
         (SELECT count(*) FROM {train_rows}) / ((SELECT count(DISTINCT target_label) FROM {train_rows}) * count(*)) AS weight
  FROM {train_rows} GROUP BY target_label),
mass0 AS (
  SELECT x.target_label, x.term_id, sum(w.weight * x.x / s.max_abs) AS mass
  FROM {train_x} x JOIN scale s ON x.term_id = s.term_id JOIN weights w ON x.target_label = w.target_label
  GROUP BY ALL),
mass AS (
  SELECT cls.class_id, cls.target_label, v.term_id, coalesce(m.mass, 0) AS mass
  FROM {CLASS_ROWS} CROSS JOIN (SELECT term_id FROM scale) v
  LEFT JOIN mass0 m ON m.target_label = cls.target_label AND m.term_id = v.term_id),
params AS (
  SELECT alpha, class_id, target_label, term_id,
         ln(mass + alpha) - ln(sum(mass) OVER (PARTITION BY alpha, class_id) + alpha * count(*) OVER (PARTITION BY alpha, class_id)) AS lp
  FROM mass CROSS JOIN alphas),
prior AS (
  SELECT cls.class_id, cls.target_label, ln(w.weight * w.n_rows / (SELECT sum(weight * n_rows) FROM weights)) AS lp
  FROM {CLASS_ROWS} JOIN weights w ON w.target_label = cls.target_label)"""


def nb_scored(rows: str, terms_x: str, name: str) -> str:
    """Joint scores, probabilities and predictions of ``rows`` as ``{name}``."""
    return f"""
{name}_s0 AS (
  SELECT p.alpha, x.doc_id, p.class_id, sum(x.x / s.max_abs * p.lp) AS s
  FROM {terms_x} x JOIN scale s ON x.term_id = s.term_id JOIN params p ON p.term_id = x.term_id
  GROUP BY ALL),
{name}_s AS (
  SELECT a.alpha, r.doc_id, r.target_label AS y_true, pr.class_id, pr.lp + coalesce(s0.s, 0) AS s
  FROM {rows} r CROSS JOIN alphas a CROSS JOIN prior pr
  LEFT JOIN {name}_s0 s0 ON s0.doc_id = r.doc_id AND s0.class_id = pr.class_id AND s0.alpha = a.alpha),
{name}_p AS (
  SELECT alpha, doc_id, y_true, class_id, s,
         exp(s - max(s) OVER (PARTITION BY alpha, doc_id)) AS e FROM {name}_s),
{name}_proba AS (
  SELECT alpha, doc_id, y_true, class_id, s, e / sum(e) OVER (PARTITION BY alpha, doc_id) AS p FROM {name}_p),
{name} AS (
  SELECT alpha, doc_id, y_true, {CLASS_LIST}[first(class_id ORDER BY round(s, 9) DESC, class_id) + 1] AS y_pred
  FROM {name}_proba GROUP BY alpha, doc_id, y_true)"""


def scored_split(split: str) -> str:
    return (
        rows_of(split) + "," + grams(f"{split}_rows", f"{split}_terms") + "," + tfidf(f"{split}_terms", f"{split}_x")
    )


NB_TEST = TRAIN_X + "," + nb([0.1]) + ",\n" + scored_split("test") + "," + nb_scored("test_rows", "test_x", "nbp")
NB_SWEEP = TRAIN_X + "," + nb(ALPHAS) + ",\n" + scored_split("dev") + "," + nb_scored("dev_rows", "dev_x", "nbp")
SWEEP = f"""WITH {NB_SWEEP},{report_ctes('nbp', 'alpha')}
SELECT alpha, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
       round(max(recall) FILTER (class = 'Critical Rescue'), 6) AS critical_rescue_recall,
       round(max(recall) FILTER (class = 'Resource Requests'), 6) AS resource_requests_recall
FROM report GROUP BY alpha"""

# --- answers to prompts -------------------------------------------------------------

EXP_ROWS = "(VALUES " + ", ".join(f"({q(n)}, {q(s)}, {seed})" for n, s, seed in EXPERIMENTS) + ") AS ex(experiment, strategy, seed)"
MATCH = (
    "CASE WHEN response = 'ERROR' THEN 'ERROR' "
    f"WHEN list_contains({q_list(RESPONSE_LABELS)}, {strip('response')}) THEN {strip('response')} "
    + " ".join(f"WHEN contains(lower(response), {q(lab.lower())}) THEN {q(lab)}" for lab in RESPONSE_LABELS)
    + " ELSE 'UNMATCHED' END"
)
ANSWERS = f"""{MAPPED},
answer AS (
  SELECT ex.*, m.doc_id, m.target_label AS y_true,
         CASE (m.doc_id + ex.seed) % 4 WHEN 0 THEN m.target_label
              WHEN 1 THEN 'I think: ' || lower({CLASS_LIST}[(cls.class_id + 1 + ex.seed) % 5 + 1])
              WHEN 2 THEN 'no idea' ELSE 'ERROR' END AS response
  FROM mapped m JOIN {CLASS_ROWS} ON m.target_label = cls.target_label CROSS JOIN {EXP_ROWS}
  WHERE m.split = 'test'),
ans AS (SELECT experiment, strategy, CAST(seed AS INTEGER) AS seed, doc_id, y_true, {MATCH} AS y_pred FROM answer)"""

ANSWERS_ALL = ANSWERS.replace("\n  WHERE m.split = 'test'", "")
CAPPED = f"""WITH {GENERATED},{accepted(4, 400)}
SELECT arrival, call_id + 1000 AS call_id FROM kept
WHERE call_id IN (SELECT DISTINCT call_id FROM gen ORDER BY call_id LIMIT {{calls}}) ORDER BY arrival LIMIT 200"""

SEEDS = f"""{PROCESSED},
pool AS (
  SELECT doc_id, clean_text, row_number() OVER (ORDER BY {hkey("'42'", 'doc_id')}, doc_id) - 1 AS ord
  FROM processed WHERE split = 'train' AND target_label = 'Situational Awareness'),
slots AS (
  SELECT call_id, slot, slot + 5 * ({hlong(hkey("'42'", 'call_id', 'slot'))} % (((SELECT count(*) FROM pool) - slot + 4) // 5)) AS ord
  FROM range(750) c(call_id), range(5) s(slot)),
seeds AS (SELECT call_id, CAST(slot AS INTEGER) AS slot, doc_id, clean_text FROM slots JOIN pool ON slots.ord = pool.ord)"""


def wide(measure: str, column: str, agg: str = "max") -> str:
    return ", ".join(f"{agg}({measure}) FILTER ({column} = {q(c)}) AS {snake(c)}" for c in CLASSES)


def class_counts(source: str, where: str = "true") -> str:
    return f"""SELECT cls.class_id, cls.target_label, count(p.target_label) AS n_rows
FROM {CLASS_ROWS} LEFT JOIN (SELECT * FROM {source} WHERE {where}) p ON p.target_label = cls.target_label
GROUP BY cls.class_id, cls.target_label"""


def histogram(col: str, bins: int) -> str:
    return f"""WITH {PROCESSED},
span0 AS (SELECT target_label, CAST(min({col}) AS DOUBLE) AS a, CAST(max({col}) AS DOUBLE) AS b
          FROM processed WHERE target_label IS NOT NULL GROUP BY target_label),
span AS (SELECT target_label, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM span0),
hit AS (
  SELECT p.target_label, CAST(least(floor((p.{col} - s.lo) / (s.hi - s.lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
  FROM processed p JOIN span s ON p.target_label = s.target_label GROUP BY ALL)
SELECT s.target_label, CAST(b.i AS INTEGER) AS bin, round(s.lo + b.i * ((s.hi - s.lo) / {bins}), 6) AS bin_start,
       coalesce(h.n, 0) AS n_rows
FROM span s CROSS JOIN range({bins}) b(i) LEFT JOIN hit h ON h.target_label = s.target_label AND h.bin = b.i"""


CURVE = f"""{PREDS},
step AS (
  SELECT model, class, score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg
  FROM scores GROUP BY ALL),
point AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY model, class) AS n_pos, sum(neg) OVER (PARTITION BY model, class) AS n_neg
  FROM step WINDOW w AS (PARTITION BY model, class ORDER BY score DESC))"""
AUC = "round(sum(neg * (tp - pos / 2)) / (max(n_pos) * max(n_neg)), 6) AS auc, CAST(max(n_pos) AS BIGINT) AS n_pos"

romanized = "clean_text"
for _k, _v in LATIN_ACCENTS.items():
    if len(_v) > 1:
        romanized = f"replace({romanized}, {q(_k)}, {q(_v)})"
_single = {k: v for k, v in LATIN_ACCENTS.items() if len(v) == 1}
ROMANIZE = f"translate({romanized}, {q(''.join(_single))}, {q(''.join(_single.values()))})"

def malayalam_sql(text: str) -> str:
    """Letters a-z written in Malayalam and romanised again by a chain of replacements.

    A mark stands behind every consonant and falls where a sign or the virama follows.
    """
    c = f"translate(lower({text}), '{LATIN}', '{AS_MALAYALAM}')"
    for spelled, letter in MALAYALAM.joined.items():
        c = f"replace({c}, '{spelled}', '{letter}')"
    c = rf"regexp_replace({c}, '([ഀ-ൿ])[\x{{200C}}\x{{200D}}]+', '\1', 'g')"
    for spelled, sign in MALAYALAM.composed.items():
        c = f"replace({c}, '{spelled}', '{sign}')"
    after = "".join(MALAYALAM.signs) + MALAYALAM.virama
    c = rf"regexp_replace({c}, '([{''.join(MALAYALAM.consonants)}])', '\1' || chr(57344), 'g')"
    c = rf"regexp_replace({c}, chr(57344) || '([{after}])', '\1', 'g')"
    c = f"replace(replace({c}, chr(57344), 'a'), '{MALAYALAM.virama}', '')"
    for k, v in {**MALAYALAM.consonants, **MALAYALAM.signs, **MALAYALAM.others}.items():
        c = f"replace({c}, '{k}', '{v}')"
    return c


ORACLES: dict[str, str] = {
    # --- A ---
    "A1_read_messages_tsv": f"""WITH {MESSAGE},
one AS (SELECT *, {sub('text', r'[\t\r\n]+', ' ')} AS t FROM message)
SELECT event_set, event, split, count(*) AS n_rows, count(raw_label) AS n_labelled,
       CAST(sum(length(t)) AS BIGINT) AS n_chars, {checksum('t')} AS text_sum, CAST(sum(doc_id) AS BIGINT) AS id_sum
FROM one GROUP BY ALL""",
    "A2_concat_sources": f"WITH {MESSAGE} SELECT event_set, split, count(*) AS n_rows FROM message GROUP BY ALL",
    "A3_missing_sources": f"""WITH {MESSAGE},
wanted AS (SELECT DISTINCT 'set1' AS event_set, event, s.split FROM message, (SELECT unnest(['train', 'dev', 'test']) AS split) s),
found AS (SELECT DISTINCT event_set, event, split FROM message)
SELECT *, 'missing' AS status FROM (FROM wanted EXCEPT FROM found)
UNION ALL SELECT *, 'unexpected' FROM (FROM found EXCEPT FROM wanted)""",
    "A4_write_read_messages": f"""WITH {PROCESSED}
SELECT split, count(*) AS n_rows, CAST(sum(text_length) AS BIGINT) AS n_chars, CAST(sum(word_count) AS BIGINT) AS n_words,
       {checksum('clean_text')} AS text_sum
FROM processed GROUP BY split""",
    "A5_read_presplit": f"""
SELECT CASE WHEN conv_id % 10 = 0 THEN 'validation' WHEN conv_id % 10 IN (1, 2) THEN 'test' ELSE 'train' END AS split,
       role AS target_label, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       {checksum('text')} AS text_sum, {checksum(clean('text'))} AS clean_sum
FROM conversations GROUP BY ALL""",
    "A6_read_eval_set": f"""WITH {MAPPED}
SELECT target_label, 'other' AS lang, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, {checksum('text')} AS text_sum
FROM mapped WHERE target_label IS NOT NULL GROUP BY target_label""",
    "A7_report_json": f"""WITH {PREDS},{report_ctes('preds')},
per AS (UNPIVOT (SELECT model, class, precision, recall, f1, CAST(support AS DOUBLE) AS support FROM report)
        ON precision, recall, f1, support INTO NAME metric VALUE value),
tot AS (SELECT model, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, CAST(sum(support) AS DOUBLE) AS n,
               sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
               sum(f1 * support) / sum(support) AS wf FROM report GROUP BY model),
avgs AS (
  SELECT model, 'macro avg' AS class, unnest(['precision', 'recall', 'f1', 'support']) AS metric, unnest([mp, mr, mf, n]) AS value FROM tot
  UNION ALL
  SELECT model, 'weighted avg', unnest(['precision', 'recall', 'f1', 'support']), unnest([wp, wr, wf, n]) FROM tot
  UNION ALL SELECT model, 'accuracy', 'accuracy', accuracy FROM acc)
SELECT model, class, metric, round(value, 6) AS value FROM per
UNION ALL SELECT model, class, metric, round(value, 6) FROM avgs""",
    "A8_write_errors_csv": f"WITH {PREDS} SELECT * FROM preds WHERE y_true <> y_pred",
    "A9_save_load_state": f"WITH {NB_TEST} SELECT doc_id, y_true AS target_label, y_pred FROM nbp",
    # --- B ---
    "B1_map_labels": f"WITH {MAPPED} SELECT doc_id, raw_label, target_label FROM mapped",
    "B2_unmapped_labels": f"WITH {MAPPED} SELECT raw_label, count(*) AS n_rows FROM mapped WHERE target_label IS NULL GROUP BY raw_label",
    "B3_mapping_summary": f"""WITH {MAPPED}
SELECT raw_label, target_label, count(*) AS n_rows FROM mapped WHERE target_label IS NOT NULL GROUP BY ALL""",
    "B4_clean_text": f"SELECT doc_id, {clean('text')} AS clean_text FROM documents",
    "B4_clean_pages": f"SELECT page_id, {clean('html')} AS clean_text FROM pages",
    "B4_clean_marked_up": f"""
WITH d AS (SELECT doc_id, 'RT @user' || doc_id || ': #Flood &lt;b&gt; &amp; ' || text || ' http://t.co/x y' AS t FROM documents)
SELECT doc_id, {clean('t')} AS clean_text FROM d""",
    "B5_drop_empty": f"""
WITH d AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'http://t.co/' || doc_id ELSE text END AS t FROM documents),
c AS (SELECT {clean('t')} AS t FROM d)
SELECT count(*) AS n_rows, count(*) FILTER (t = '') AS n_dropped, count(*) FILTER (t <> '') AS n_kept FROM c""",
    "B6_add_lengths": f"WITH {PROCESSED} SELECT doc_id, text_length, word_count FROM processed",
    "B7_null_text": f"""WITH {MESSAGE},
d AS (SELECT doc_id, CASE WHEN raw_label IS NOT NULL THEN text END AS t FROM message)
SELECT doc_id, CAST(length({clean('t')}) AS INTEGER) AS text_length FROM d""",
    "B8_encode_label": f"""WITH {MAPPED}
SELECT m.doc_id, m.target_label, CAST(cls.class_id AS INTEGER) AS label, m.target_label AS decoded
FROM mapped m LEFT JOIN {CLASS_ROWS} ON m.target_label = cls.target_label""",
    "B9_split_rows": f"WITH {MESSAGE} SELECT doc_id, event, split FROM message WHERE split = 'test'",
    "B10_strip_list_markers": f"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' - ' || text WHEN 1 THEN '12. "' || text || '" ''' ELSE text END AS t FROM documents)
SELECT doc_id, {strip_list('t')} AS stripped FROM d""",
    "B11_is_good_row": f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Here are ' || text ELSE text END AS t FROM documents)
SELECT doc_id, {good('t', 4, 60)} AS good, {good('t', 4, 400)} AS good_wide FROM d""",
    "B12_match_label": f"WITH {ANSWERS_ALL} SELECT experiment, doc_id, y_pred FROM ans",
    "B13_generation_prompts": f"""WITH {SEEDS}
SELECT call_id, 'Write ten posts like these:' || chr(10) || string_agg('- ' || clean_text, chr(10) ORDER BY slot)
       || chr(10) || 'One per line.' AS prompt
FROM seeds GROUP BY call_id""",
    "B13_classification_prompts": f"""WITH {PROCESSED}
SELECT doc_id, 'Name one class.' AS system_prompt,
       'Message: ' || clean_text || chr(10) || 'Class:' AS user_prompt
FROM processed""",
    "B14_excerpt": rf"""
SELECT doc_id, regexp_replace(substr(text, 1, 80), '[^\x00-\x7F]', '?', 'g') AS ascii_80, substr(text, 1, 140) AS first_140
FROM documents""",
    "B15_content_words": f"""WITH {PROCESSED},
w AS (SELECT target_label, unnest(string_split(clean_text, ' ')) AS word FROM processed)
SELECT target_label, count(*) AS n_words, count(DISTINCT word) AS n_distinct
FROM w WHERE length(word) > 2 AND NOT list_contains({q_list(STOP_WORDS)}, word) GROUP BY target_label""",
    "B16_correct": f"WITH {PREDS} SELECT model, doc_id, y_true = y_pred AS correct FROM preds",
    "B17_romanize": f"SELECT doc_id, {ROMANIZE.replace('clean_text', 'text')} AS romanized FROM documents",
    "B17_romanize_malayalam": f"SELECT doc_id, {malayalam_sql('text')} AS romanized FROM documents",
    # --- C ---
    "C1_dataset_summary": f"""WITH {MESSAGE}
SELECT count(*) AS n_rows, count(*) FILTER (event_set = 'set1') AS n_set1, count(*) FILTER (event_set = 'set2') AS n_set2,
       count(DISTINCT event) AS n_events, count(*) FILTER (split = 'train') AS n_train,
       count(*) FILTER (split = 'dev') AS n_dev, count(*) FILTER (split = 'test') AS n_test FROM message""",
    "C2_null_counts": f"WITH {MAPPED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM mapped"
        for c in ["doc_id", "text", "event", "lang", "raw_label", "target_label"]
    ),
    "C3_value_counts": f"""WITH {MESSAGE}
SELECT raw_label, count(*) AS n_rows, CAST(row_number() OVER (ORDER BY count(*) DESC, raw_label) AS INTEGER) AS position
FROM message WHERE raw_label IS NOT NULL GROUP BY raw_label""",
    "C4_class_distribution": f"""WITH {PROCESSED}, c AS ({class_counts('processed')})
SELECT class_id, target_label, n_rows, round(n_rows * 100.0 / (SELECT count(*) FROM processed), 6) AS pct FROM c""",
    "C5_imbalance": f"""WITH {PROCESSED}, c AS ({class_counts('processed')})
SELECT target_label, n_rows, round(max(n_rows) OVER () / nullif(n_rows, 0), 6) AS ratio,
       row_number() OVER (ORDER BY n_rows, class_id) = 1 AS is_rarest,
       row_number() OVER (ORDER BY n_rows DESC, class_id) = 1 AS is_commonest FROM c""",
    "C6_length_stats": f"""WITH {PROCESSED}
SELECT cls.target_label, cls.class_id, round_even(avg(word_count), 1) AS mean, round_even(stddev_samp(word_count), 1) AS std,
       min(word_count) AS min, round_even(quantile_cont(word_count, 0.5), 1) AS median, max(word_count) AS max
FROM {CLASS_ROWS} LEFT JOIN processed p ON p.target_label = cls.target_label GROUP BY cls.target_label, cls.class_id""",
    "C7_char_histogram": histogram("text_length", 50),
    "C7_word_histogram": histogram("word_count", 40),
    "C8_crosstab": f"""WITH {PROCESSED}
SELECT event, {', '.join(f"count(*) FILTER (target_label = {q(c)}) AS {snake(c)}" for c in CLASSES)}
FROM processed WHERE target_label IS NOT NULL GROUP BY event""",
    "C8_crosstab_share": f"""WITH {PROCESSED}
SELECT event, {', '.join(f"round(count(*) FILTER (target_label = {q(c)}) / count(*), 6) AS {snake(c)}" for c in CLASSES)}
FROM processed WHERE target_label IS NOT NULL GROUP BY event""",
    "C9_top_words": f"""WITH {PROCESSED},
w AS (SELECT target_label, unnest(string_split(clean_text, ' ')) AS word FROM processed WHERE target_label IS NOT NULL),
n AS (SELECT target_label, word, count(*) AS n_rows FROM w
      WHERE length(word) > 2 AND NOT list_contains({q_list(STOP_WORDS)}, word) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY target_label ORDER BY n_rows DESC, word) AS INTEGER) AS rn FROM n QUALIFY rn <= 20""",
    "C10_split_balance": f"""WITH {PROCESSED},
c AS (SELECT cls.target_label, count(*) FILTER (p.split = 'train') AS train_count, count(*) FILTER (p.split = 'test') AS test_count
      FROM {CLASS_ROWS} LEFT JOIN processed p ON p.target_label = cls.target_label GROUP BY cls.target_label)
SELECT *, round_even(train_count * 100.0 / sum(train_count) OVER (), 1) AS train_pct,
       round_even(test_count * 100.0 / sum(test_count) OVER (), 1) AS test_pct FROM c""",
    "C11_augmentation_summary": f"""WITH {AUGMENTED}, c AS ({class_counts('augmented')}),
t AS (SELECT count(*) AS total, count(*) FILTER (NOT is_synthetic) AS "real", count(*) FILTER (is_synthetic) AS synthetic FROM augmented)
SELECT target_label, n_rows, round(n_rows * 100.0 / total, 6) AS pct, total, "real", synthetic FROM c, t""",
    "C12_generation_yield": f"""WITH {GENERATED},{accepted(4, 400)}
SELECT g.call_id, count(*) AS n_returned, count(k.arrival) AS n_kept, round(count(k.arrival) / 10, 6) AS keep_rate
FROM gen g LEFT JOIN kept k ON g.arrival = k.arrival GROUP BY g.call_id""",
    "C12_yield_summary": f"""WITH {GENERATED},{accepted(4, 60)}
SELECT (SELECT count(DISTINCT call_id) FROM gen) AS n_calls, count(*) AS n_kept,
       round(count(*) / ((SELECT count(DISTINCT call_id) FROM gen) * 10), 6) AS keep_rate FROM kept""",
    "C13_class_weights": f"""WITH {PROCESSED}, {rows_of('train')},
c AS (SELECT target_label, count(*) AS n_rows FROM train_rows GROUP BY target_label)
SELECT *, round(sum(n_rows) OVER () / (count(*) OVER () * n_rows), 6) AS weight FROM c""",
    "C14_sample_weights": f"""WITH {PROCESSED}, {rows_of('train')}
SELECT doc_id, target_label, round((SELECT count(*) FROM train_rows) /
       ((SELECT count(DISTINCT target_label) FROM train_rows) * count(*) OVER (PARTITION BY target_label)), 6) AS weight
FROM train_rows""",
    "C14_mean_sample_weight": f"""WITH {PROCESSED}, {rows_of('train')}
SELECT target_label, round((SELECT count(*) FROM train_rows) /
       ((SELECT count(DISTINCT target_label) FROM train_rows) * count(*)), 6) AS mean_weight
FROM train_rows GROUP BY target_label""",
    # --- D ---
    "D1_sample_per_class": f"""WITH {PROCESSED}
SELECT target_label, doc_id, event FROM processed WHERE target_label IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY target_label ORDER BY {hkey("'42'", 'doc_id')}, doc_id) <= 2""",
    "D2_balanced_sample": f"""WITH {PROCESSED}, {rows_of('test')},
s AS (SELECT target_label, doc_id FROM test_rows
      QUALIFY row_number() OVER (PARTITION BY target_label ORDER BY {hkey("'42'", 'doc_id')}, doc_id) <= 2)
SELECT row_number() OVER (ORDER BY {hkey("'42-shuffle'", 'doc_id')}, doc_id) - 1 AS ord, target_label, doc_id FROM s""",
    "D2_class_shortages": f"""WITH {PROCESSED}, {rows_of('test')}, c AS ({class_counts('test_rows')})
SELECT target_label, n_rows AS available FROM c WHERE n_rows < 10""",
    "D3_shuffle": f"""WITH {MESSAGE}
SELECT doc_id, event, row_number() OVER (ORDER BY {hkey("'42'", 'doc_id')}, doc_id) - 1 AS ord FROM message""",
    "D4_sample_n": f"""WITH {PROCESSED},
t AS (SELECT doc_id, target_label, lang FROM processed WHERE split = 'test'),
u AS ((SELECT * FROM t WHERE lang = 'en' ORDER BY {hkey("'42'", 'doc_id')}, doc_id LIMIT 20)
      UNION ALL (SELECT * FROM t WHERE lang <> 'en' ORDER BY {hkey("'42'", 'doc_id')}, doc_id LIMIT 20))
SELECT * FROM u WHERE target_label IS NOT NULL""",
    "D5_rotate_seeds": f"WITH {SEEDS} SELECT call_id, slot, doc_id FROM seeds",
    "D6_dedup_fingerprint": f"""WITH {GENERATED}
SELECT arrival, {fingerprint('text')} AS fingerprint FROM gen
QUALIFY row_number() OVER (PARTITION BY {fingerprint('text')} ORDER BY arrival) = 1""",
    "D6_accept_generated": f"""WITH lines AS (
  SELECT doc_id AS arrival, unnest(string_split(text, chr(10))) AS text,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM documents),{accepted(4, 60, 'lines', 'arrival, pos')}
SELECT arrival, pos, fingerprint FROM kept""",
    "D7_cap_rows": CAPPED.replace("{calls}", "60"),
    "D7_call_budget": CAPPED.replace("{calls}", "15"),
    "D8_head_examples": f"""WITH {PREDS}
SELECT * FROM preds WHERE y_true IN ('Critical Rescue', 'Resource Requests') AND y_pred IN ('Situational Awareness', 'Irrelevant')
ORDER BY model, doc_id LIMIT 8""",
    "D9_sorted_results": f"""WITH {PREDS},{report_ctes('preds')}
SELECT *, CAST(row_number() OVER (ORDER BY macro_f1 DESC, model) AS INTEGER) AS position FROM (
  SELECT model, round(avg(f1) FILTER (support + predicted > 0), 6) AS macro_f1 FROM report GROUP BY model)""",
    "D10_best_alpha": f"SELECT * FROM ({SWEEP}) ORDER BY macro_f1 DESC, alpha LIMIT 1",
    # --- E ---
    "E1_lookup_join": f"""WITH {MAPPED}
SELECT m.event_set, CAST(cls.class_id AS INTEGER) AS label, count(*) AS n_rows
FROM mapped m LEFT JOIN {CLASS_ROWS} ON m.target_label = cls.target_label GROUP BY ALL""",
    "E2_side_by_side": f"""WITH {PROCESSED}
SELECT event, nullif(count(*) FILTER (split = 'train'), 0) AS n_a, nullif(count(*) FILTER (split = 'test'), 0) AS n_b
FROM processed WHERE split <> 'dev' GROUP BY event""",
    "E3_attach_predictions": f"""WITH {PREDS}
SELECT doc_id, y_true AS target_label, model, y_pred, y_true = y_pred AS correct FROM preds""",
    "E4_report_delta": f"""WITH {PREDS},{report_ctes('preds')},
long AS (
  SELECT model, class, 'recall' AS metric, recall AS value FROM report
  UNION ALL SELECT model, 'macro avg', 'f1', avg(f1) FROM report GROUP BY model
  UNION ALL SELECT model, 'weighted avg', 'f1', sum(f1 * support) / sum(support) FROM report GROUP BY model)
SELECT a.class, a.metric, round(a.value, 6) AS value_a, round(b.value, 6) AS value_b, round(b.value - a.value, 6) AS delta
FROM long a JOIN long b ON a.class = b.class AND a.metric = b.metric
WHERE a.model = 'euclid' AND b.model = 'cosine' AND a.class <> 'Volunteering and Donations'""",
    "E5_augment_train": f"""WITH {AUGMENTED}
SELECT doc_id, arrival, target_label, split, event, is_synthetic, text_length, word_count FROM augmented""",
    "E6_union_results": f"""WITH {PROCESSED}
SELECT CASE WHEN lang = 'en' THEN 'home' ELSE 'other' END AS language, target_label, count(*) AS n_rows
FROM processed WHERE target_label IS NOT NULL GROUP BY ALL""",
    "E7_leakage_check": f"""WITH {PROCESSED},
tr AS (SELECT * FROM processed WHERE split = 'train'), he AS (SELECT * FROM processed WHERE split <> 'train')
SELECT 'id' AS kind, count(DISTINCT doc_id) AS n_keys, count(*) AS n_train_rows FROM tr WHERE doc_id IN (SELECT doc_id FROM he)
UNION ALL
SELECT 'text', count(DISTINCT clean_text), count(*) FROM tr WHERE clean_text IN (SELECT clean_text FROM he)""",
    # --- F ---
    "F1_ngrams": f"""WITH {PROCESSED},{grams('processed', 'g')}
SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_grams,
       CAST(sum({hlong('md5(term)')} * tf) AS BIGINT) AS term_sum FROM g GROUP BY doc_id""",
    "F2_vocab": f"""WITH {PROCESSED}, {rows_of('train')},{grams('train_rows', 'g')},{vocab('g', 'train_rows')}
SELECT term_id, term, df, cnt, round(idf, 6) AS idf FROM vocab""",
    "F3_tfidf": f"""WITH {TRAIN_X}
SELECT doc_id, count(*) AS n_terms, round(sum(x), 6) AS sum_x, round(max(x), 6) AS max_x FROM train_x GROUP BY doc_id""",
    "F4_tfidf_plain": f"""WITH {PROCESSED}, {rows_of('train')},{grams('train_rows', 'g')},{vocab('g', 'train_rows', 1, 1.0, 10000)},{tfidf('g', 'x', False)}
SELECT doc_id, count(*) AS n_terms, round(sum(x), 6) AS sum_x, round(max(x), 6) AS max_x FROM x GROUP BY doc_id""",
    "F5_transform": f"WITH {TRAIN_X},\n{scored_split('test')} SELECT doc_id, term_id, round(x, 6) AS x FROM test_x",
    "F6_maxabs": f"""WITH {TRAIN_X},
{scored_split('test')} SELECT t.doc_id, t.term_id, round(t.x / s.max_abs, 6) AS x FROM test_x t JOIN scale s ON t.term_id = s.term_id""",
    "F7_matrix_profile": f"""WITH {TRAIN_X},
c AS (SELECT x.x / s.max_abs AS x FROM train_x x JOIN scale s ON x.term_id = s.term_id),
n AS (SELECT (SELECT count(*) FROM train_rows) AS n_docs, (SELECT count(*) FROM vocab) AS n_terms)
SELECT any_value(n_docs) AS n_docs, any_value(n_terms) AS n_terms, count(*) AS n_cells,
       round(CASE WHEN count(*) = any_value(n_docs * n_terms) THEN min(x) ELSE least(min(x), 0) END, 6) AS min_x,
       round(max(x), 6) AS max_x FROM c, n""",
    "F8_nb_fit": f"""WITH {TRAIN_X},{nb([0.1])}
SELECT p.term_id, round(any_value(s.max_abs), 6) AS max_abs,
       {', '.join(f'round(max(lp) FILTER (class_id = {i}), 6) AS log_prob_{i}' for i in range(5))}
FROM params p JOIN scale s ON p.term_id = s.term_id GROUP BY p.term_id""",
    "F9_nb_predict": f"""WITH {NB_TEST}
SELECT n.doc_id, n.y_true, n.y_pred, {', '.join(f'round(max(p.p) FILTER (p.class_id = {i}), 6) AS proba_{i}' for i in range(5))}
FROM nbp n JOIN nbp_proba p ON n.doc_id = p.doc_id GROUP BY ALL""",
    "F10_nb_sweep": SWEEP,
    "F15_score_batched": f"WITH {NB_TEST} SELECT doc_id, y_pred FROM nbp",
    "F17_top_terms": f"""WITH {TRAIN_X},{nb([0.1])},
lift AS (SELECT v.term, p.target_label, round(p.lp - avg(p.lp) OVER (PARTITION BY p.term_id), 12) AS lift
         FROM params p JOIN vocab v ON p.term_id = v.term_id)
SELECT term, target_label, round(lift, 6) AS lift,
       CAST(row_number() OVER (PARTITION BY target_label ORDER BY lift DESC, term) AS INTEGER) AS rn FROM lift QUALIFY rn <= 10""",
    "F18_focal_loss": f"""WITH {NB_TEST},
ce AS (SELECT -w.weight * ln(p.p) AS ce FROM nbp_proba p JOIN {CLASS_ROWS} ON cls.class_id = p.class_id AND cls.target_label = p.y_true
       JOIN weights w ON w.target_label = p.y_true)
SELECT round(avg(pow(1 - exp(-ce), 2) * ce), 6) AS focal_loss, count(*) AS n_rows FROM ce""",
    "F19_cosine_pairs": """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "F19_centroid_similarity": f"""WITH {PREDS}
SELECT a.label AS label_a, b.label AS label_b, round(list_cosine_similarity(a.c, b.c), 6) AS similarity
FROM cent a JOIN cent b ON a.label < b.label""",
    "F19_nearest": f"""WITH {PREDS},
s AS (SELECT cl AS query_id, vec_id, cosine AS similarity FROM cand)
SELECT query_id, vec_id, round(similarity, 6) AS similarity,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rn FROM s QUALIFY rn <= 5""",
    "F19_graph_recall": """
SELECT count(*) AS n_rows, CAST(sum(least(10, (SELECT count(*) FROM embeddings) - 1)) AS BIGINT) AS n_wanted, TRUE AS recall_reached
FROM embeddings WHERE vec_id % 50 = 0""",
    "F20_project_2d": """
WITH RECURSIVE long AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
centred AS (SELECT vec_id, d, x - avg(x) OVER (PARTITION BY d) AS z FROM long),
cells AS (SELECT a.d AS i, b.d AS j, sum(a.z * b.z) AS s FROM centred a JOIN centred b USING (vec_id) GROUP BY ALL),
cov AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM cells GROUP BY i)),
first_power AS (
  SELECT 0 AS n, m FROM cov UNION ALL
  SELECT n + 1, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c) / list_sum(list_transform(m, lambda w: list_dot_product(w, w)))))
  FROM first_power WHERE n < 20),
first_row AS (SELECT m[list_position(diagonal, list_max(diagonal))] AS r FROM (
  SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS diagonal FROM first_power WHERE n = 20)),
first_unit AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r)) * sign(list_max(r) + list_min(r))) AS u FROM first_row),
less AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j]
    - u[i] * u[j] * list_dot_product(u, list_transform(m, lambda r: list_dot_product(r, u))))) AS m FROM cov, first_unit),
second_power AS (
  SELECT 0 AS n, m FROM less UNION ALL
  SELECT n + 1, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c) / list_sum(list_transform(m, lambda w: list_dot_product(w, w)))))
  FROM second_power WHERE n < 20),
second_row AS (SELECT m[list_position(diagonal, list_max(diagonal))] AS r FROM (
  SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS diagonal FROM second_power WHERE n = 20)),
second_unit AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r)) * sign(list_max(r) + list_min(r))) AS w FROM second_row)
SELECT vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), u), 6) AS x,
       round(list_dot_product(CAST(embedding AS DOUBLE[]), w), 6) AS y FROM embeddings, first_unit, second_unit""",
    "F20_preservation": "SELECT count(*) AS n_rows, TRUE AS better FROM embeddings WHERE vec_id % 50 = 0",
    # --- G ---
    "G1_confusion": f"""WITH {PREDS}
SELECT m.model, t.target_label AS y_true, p.target_label AS y_pred, count(r.doc_id) AS n
FROM (SELECT DISTINCT model FROM preds) m CROSS JOIN {CLASS_ROWS.replace('cls', 't')} CROSS JOIN {CLASS_ROWS.replace('cls', 'p')}
LEFT JOIN preds r ON r.model = m.model AND r.y_true = t.target_label AND r.y_pred = p.target_label
GROUP BY ALL""",
    "G1_confusion_wide": f"""WITH {PREDS}
SELECT model, y_true, {', '.join(f"count(*) FILTER (y_pred = {q(c)}) AS {snake(c)}" for c in CLASSES)} FROM preds GROUP BY model, y_true""",
    "G2_confusion_norm": f"""WITH {PREDS},
c AS (SELECT m.model, t.target_label AS y_true, p.target_label AS y_pred, count(r.doc_id) AS n
      FROM (SELECT DISTINCT model FROM preds) m CROSS JOIN {CLASS_ROWS.replace('cls', 't')} CROSS JOIN {CLASS_ROWS.replace('cls', 'p')}
      LEFT JOIN preds r ON r.model = m.model AND r.y_true = t.target_label AND r.y_pred = p.target_label GROUP BY ALL)
SELECT *, round(n / greatest(sum(n) OVER (PARTITION BY model, y_true), 1), 6) AS share FROM c""",
    "G3_class_report": f"""WITH {PREDS},{report_ctes('preds')}
SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, predicted, tp FROM report""",
    "G4_overall_metrics": f"WITH {PREDS},{report_ctes('preds')} {overall('model', False)}",
    "G4_overall_metrics_nb": f"WITH {NB_TEST},{report_ctes('nbp', '')} {overall('', True)}",
    "G5_metrics_wide": f"""WITH {PREDS},{report_ctes('preds')}, o AS ({overall('model', True)}),
w AS (SELECT model, {', '.join(f"round(max({m}) FILTER (class = {q(c)}), 6) AS test_{m}_class_{snake(c)}" for c in CLASSES for m in ('precision', 'recall', 'f1'))}
      FROM report GROUP BY model)
SELECT w.*, accuracy AS test_accuracy, {', '.join(f'{k}_{m} AS test_{k}_{m}' for k in ('macro', 'weighted') for m in ('precision', 'recall', 'f1'))}
FROM w JOIN o ON w.model = o.model""",
    "G6_class_accuracy": f"""WITH {PREDS}
SELECT model, y_true, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) FILTER (y_true = y_pred) AS n_correct, count(*) AS n_rows FROM preds GROUP BY model, y_true""",
    "G7_dangerous_fn": f"""WITH {PREDS},
d AS (SELECT *, y_true IN ('Critical Rescue', 'Resource Requests') AS urgent,
             y_true IN ('Critical Rescue', 'Resource Requests') AND y_pred IN ('Situational Awareness', 'Irrelevant') AS bad FROM preds)
SELECT model, count(*) FILTER (urgent) AS n_urgent, count(*) FILTER (bad) AS n_dangerous,
       round(coalesce(count(*) FILTER (bad) * 100.0 / nullif(count(*) FILTER (urgent), 0), 0), 6) AS pct_dangerous,
       count(*) FILTER (bad AND y_true = 'Critical Rescue') AS n_critical_rescue,
       count(*) FILTER (bad AND y_true = 'Resource Requests') AS n_resource_requests FROM d GROUP BY model""",
    "G8_pair_confusion": f"""WITH {PREDS}
SELECT model, count(*) FILTER (y_true = 'Critical Rescue' AND y_pred = 'Resource Requests') AS n_a_as_b,
       count(*) FILTER (y_true = 'Resource Requests' AND y_pred = 'Critical Rescue') AS n_b_as_a FROM preds GROUP BY model""",
    "G8_pair_examples": f"""WITH {PREDS}
SELECT * FROM preds WHERE y_true = 'Critical Rescue' AND y_pred = 'Resource Requests' ORDER BY model, doc_id LIMIT 5""",
    "G9_errors": f"WITH {PREDS} SELECT * FROM preds WHERE y_true <> y_pred ORDER BY y_true, doc_id",
    "G10_leaderboard": f"""WITH {PREDS},{report_ctes('preds')}, o AS ({overall('model', True)})
SELECT model, accuracy, macro_precision, macro_recall, macro_f1,
       CAST(row_number() OVER (ORDER BY macro_f1 DESC, model) AS INTEGER) AS position FROM o""",
    "G11_class_matrix_f1": f"""WITH {PREDS},{report_ctes('preds')}, o AS ({overall('model', True)})
SELECT r.model, {wide('round(f1, 6)', 'class')}, any_value(k.rank) AS rank
FROM report r JOIN (SELECT model, CAST(row_number() OVER (ORDER BY macro_f1 DESC, model) AS INTEGER) AS rank FROM o) k ON k.model = r.model
GROUP BY r.model""",
    "G11_class_matrix_recall": f"""WITH {PREDS},{report_ctes('preds')}, o AS ({overall('model', True)})
SELECT r.model, {wide('round(recall, 6)', 'class')}, any_value(k.rank) AS rank
FROM report r JOIN (SELECT model, CAST(row_number() OVER (ORDER BY macro_f1 DESC, model) AS INTEGER) AS rank FROM o) k ON k.model = r.model
GROUP BY r.model""",
    "G13_roc_points": f"""WITH {CURVE}
SELECT model, class, round(score, 6) AS threshold, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM point
UNION ALL SELECT DISTINCT model, class, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM point""",
    "G13_roc_auc": f"WITH {CURVE} SELECT model, class, {AUC} FROM point GROUP BY model, class",
    "G13_roc_auc_exact": f"WITH {CURVE} SELECT model, class, {AUC} FROM point GROUP BY model, class",
    "G13_roc_auc_nb": f"""WITH {NB_TEST},
scores AS (SELECT {CLASS_LIST}[class_id + 1] AS class, p AS score, {CLASS_LIST}[class_id + 1] = y_true AS positive FROM nbp_proba),
step AS (SELECT class, score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM scores GROUP BY ALL),
point AS (SELECT *, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY class) AS n_pos, sum(neg) OVER (PARTITION BY class) AS n_neg
          FROM step WINDOW w AS (PARTITION BY class ORDER BY score DESC))
SELECT class, {AUC} FROM point GROUP BY class""",
    "G14_average_precision_nb": f"""WITH {NB_TEST},
scores AS (SELECT {CLASS_LIST}[class_id + 1] AS class, p AS score, {CLASS_LIST}[class_id + 1] = y_true AS positive FROM nbp_proba),
step AS (SELECT class, score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM scores GROUP BY ALL),
point AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS n_pos
          FROM step WINDOW w AS (PARTITION BY class ORDER BY score DESC))
SELECT class, round(coalesce(sum(tp / (tp + fp) * pos) / nullif(max(n_pos), 0), 0), 6) AS average_precision,
       CAST(max(n_pos) AS BIGINT) AS n_pos FROM point GROUP BY class""",
    "G14_pr_points": f"""WITH {CURVE}
SELECT model, class, round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / n_pos, 6) AS recall FROM point
UNION ALL SELECT DISTINCT model, class, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM point""",
    "G14_average_precision": f"""WITH {CURVE}
SELECT model, class, round(sum(tp / (tp + fp) * pos) / max(n_pos), 6) AS average_precision, CAST(max(n_pos) AS BIGINT) AS n_pos
FROM point GROUP BY model, class""",
    "G16_scored_summary": f"""WITH {ANSWERS}
SELECT experiment, count(*) AS n_rows, count(*) FILTER (y_pred NOT IN ('ERROR', 'UNMATCHED')) AS n_valid,
       count(*) FILTER (y_pred IN ('ERROR', 'UNMATCHED')) AS n_skipped,
       round(coalesce(count(*) FILTER (y_true = y_pred) / nullif(count(*) FILTER (y_pred NOT IN ('ERROR', 'UNMATCHED')), 0), 0), 6) AS accuracy
FROM ans GROUP BY experiment""",
    "G17_compare_experiments": f"""WITH {ANSWERS}
SELECT experiment, strategy, seed,
       round(coalesce(count(*) FILTER (y_true = y_pred) / nullif(count(*) FILTER (y_pred NOT IN ('ERROR', 'UNMATCHED')), 0), 0), 6) AS accuracy,
       count(*) FILTER (y_pred IN ('ERROR', 'UNMATCHED')) AS skipped,
       {', '.join(f"round(count(*) FILTER (y_true = y_pred AND y_true = {q(c)}) / nullif(count(*) FILTER (y_pred NOT IN ('ERROR', 'UNMATCHED') AND y_true = {q(c)}), 0), 6) AS {snake(c)}" for c in CLASSES)}
FROM ans GROUP BY ALL""",
    "G18_recall_side_by_side": f"""WITH {PREDS},{report_ctes('preds')}
SELECT class, round(max(recall) FILTER (model = 'cosine'), 6) AS cosine, round(max(recall) FILTER (model = 'euclid'), 6) AS euclid
FROM report GROUP BY class""",
    # --- H ---
    "H1_dedup_stream": f"WITH {GENERATED},{accepted(4, 400)} SELECT fingerprint FROM kept",
    "H1_dedup_watermark": """
SELECT DISTINCT 'user ' || (user_id % 100) || ' did ' || event_type AS fingerprint FROM events""",
    "H1_forgetful_dedup": """
WITH RECURSIVE e AS (
  SELECT event_id, epoch_us(ts) AS at_us, 'user ' || (user_id % 100) || ' did ' || event_type AS fingerprint,
         epoch_us(ts) + 3600000000 * CASE WHEN event_id % 10 = 9 THEN 72 WHEN event_id % 33 = 5 THEN 12 ELSE 0 END AS arrival
  FROM events),
b AS (SELECT *, least((arrival - 1704067200000000) // 86400000000 // 5, 5) AS batch FROM e),
marks AS (SELECT a.batch, (SELECT max(at_us) FROM b WHERE b.batch < a.batch) // 1000 * 1000 - 86400000000 AS watermark
          FROM (SELECT DISTINCT batch FROM b) a),
-- Rows behind the watermark are late; the others follow each other by batch, time and number.
r AS (
  SELECT fingerprint, event_id, at_us, row_number() OVER (PARTITION BY fingerprint ORDER BY b.batch, at_us, event_id) AS pos
  FROM b JOIN marks USING (batch) WHERE watermark IS NULL OR at_us > watermark),
passed AS (
  SELECT fingerprint, 1::BIGINT AS pos, at_us FROM r WHERE pos = 1
  UNION ALL
  SELECT n.fingerprint, n.pos, r.at_us FROM (
    SELECT r.fingerprint, min(r.pos) AS pos FROM passed p
    JOIN r ON r.fingerprint = p.fingerprint AND r.pos > p.pos AND r.at_us >= p.at_us + 172800000000
    GROUP BY r.fingerprint) n JOIN r ON r.fingerprint = n.fingerprint AND r.pos = n.pos)
SELECT r.fingerprint, r.event_id AS place, r.at_us FROM passed JOIN r USING (fingerprint, pos)""",
    "H1_generation_target": CAPPED.replace("{calls}", "60"),
    "H1_generation_budget": CAPPED.replace("{calls}", "15"),
}


def _feistel(rounds: int = 6) -> str:
    """One mapping of ``x`` in rows of ``walk``, as nested selections of the two digits h and l."""
    sql = "SELECT doc_id, n, a, b, step, x // b AS h, x % b AS l FROM walk WHERE step = 0 OR x >= n"
    for r in range(rounds):
        h = f"(h + {hlong(hkey(chr(39) + '42' + chr(39), str(r), 'l'))}) % a" if r % 2 == 0 else "h"
        low = "l" if r % 2 == 0 else f"(l + {hlong(hkey(chr(39) + '42' + chr(39), str(r), 'h'))}) % b"
        sql = f"SELECT doc_id, n, a, b, step, {h} AS h, {low} AS l FROM ({sql})"
    return f"SELECT doc_id, n, a, b, step + 1 AS step, h * b + l AS x FROM ({sql})"


ORACLES["D3_permute"] = f"""WITH RECURSIVE size AS (
  SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b
  FROM (SELECT max(doc_id) + 1 AS n FROM documents)),
walk AS (
  SELECT doc_id, n, a, b, 0 AS step, doc_id AS x FROM documents, size
  UNION ALL {_feistel()})
SELECT doc_id, x AS position FROM walk WHERE step > 0 AND x < n"""


def _phase_parts() -> str:
    parts = []
    phases = {
        "home": "SELECT doc_id, target_label, clean_text FROM test_rows WHERE lang = 'en'",
        "other": "SELECT doc_id, target_label, clean_text FROM test_rows WHERE lang <> 'en'",
        "romanized": f"SELECT doc_id, target_label, {ROMANIZE} AS clean_text FROM test_rows WHERE lang <> 'en'",
    }
    for name, rows in phases.items():
        parts.append(f"\n{name}_rows AS ({rows})")
        parts.append(grams(f"{name}_rows", f"{name}_terms"))
        parts.append(tfidf(f"{name}_terms", f"{name}_x"))
        parts.append(nb_scored(f"{name}_rows", f"{name}_x", f"{name}_nb"))
    model = "CASE WHEN alpha < 0.5 THEN 'Naive_Bayes_tuned' ELSE 'Naive_Bayes_base' END"
    union = " UNION ALL ".join(f"SELECT '{n}|' || {model} AS run, y_true, y_pred FROM {n}_nb" for n in phases)
    return ",".join(parts) + f",\nphase_preds AS ({union})"


ORACLES["G15_phases"] = (
    f"WITH {TRAIN_X},{nb([0.1, 1.0])},\n{rows_of('test')},{_phase_parts()},{report_ctes('phase_preds', 'run')} "
    f"SELECT * EXCLUDE (run), split_part(run, '|', 1) AS phase, split_part(run, '|', 2) AS model "
    f"FROM ({overall('run', True)})"
)


def _ablation() -> str:
    """Test macro F1 of naive Bayes without and with generated rows."""

    def f1(rows: str) -> str:
        train = f"""{AUGMENTED},
train_rows AS ({rows}),{grams('train_rows', 'train_terms')},{vocab('train_terms', 'train_rows')},{tfidf('train_terms', 'train_x')},
scale AS (SELECT term_id, max(abs(x)) AS max_abs FROM train_x GROUP BY term_id)"""
        return (
            f"WITH {train},{nb([0.1])},\n{scored_split('test')},{nb_scored('test_rows', 'test_x', 'nbp')},"
            f"{report_ctes('nbp', '')} SELECT avg(f1) FILTER (support + predicted > 0) AS f1 FROM report"
        )

    plain = f1("SELECT doc_id, target_label, clean_text FROM augmented WHERE NOT is_synthetic AND target_label IS NOT NULL")
    more = f1("SELECT coalesce(doc_id, -1 - arrival) AS doc_id, target_label, clean_text FROM augmented WHERE target_label IS NOT NULL")
    return f"""
SELECT 'Naive_Bayes' AS model, round(a.f1, 6) AS real_only, round(b.f1, 6) AS augmented, round(b.f1 - a.f1, 6) AS delta
FROM ({plain}) a, ({more}) b"""


ORACLES["G12_ablation"] = _ablation()
