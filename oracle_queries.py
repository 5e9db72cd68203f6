"""Oracle SQL (DuckDB) for every registered query that SQL can express.

Written independently of the Spark plans: windows and joins appear here in
their plain single-node form (e.g. one ``row_number`` over a class), which
is exactly what the distributed Spark versions must reproduce.
"""

from __future__ import annotations

import oracles as O
from quire.operators.reshape import CONTENTS, METHODS, MODELS
from quire.operators.relate import BERT_MODELS, CONTENT_SOURCES, TRAINING_METHODS

SQL = {}
RAW = O.RAW_CORPUS
NL = O.NL
lit = O.lit


def h32(expr: str, salt: str = "") -> str:
    prefix = f"42:{salt}:" if salt else "42:"
    return f"('0x' || substr(md5('{prefix}' || CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


def q(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


TRAIN = "SELECT d.doc_id, d.text, l.quality AS labels FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
TRAIN2 = "SELECT d.doc_id, l.quality AS labels FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
SCORED = f"""
  SELECT doc_id, labels, score, CAST(score >= 0.5 AS INTEGER) AS predictions FROM (
    SELECT doc_id, labels,
           (floor(({h32('doc_id', 'score')} / 4294967296.0) * 60) + labels * 40 + 0.5) / 100.0 AS score
    FROM ({TRAIN2}))
"""

LOG_METRICS = ("eval_accuracy", "eval_f1", "eval_loss", "eval_precision", "eval_recall")
_metric_case = ("CASE event_type WHEN 'view' THEN 'eval_accuracy' WHEN 'click' THEN 'eval_f1' WHEN 'purchase' THEN 'eval_precision' "
                "WHEN 'signup' THEN 'eval_recall' WHEN 'error' THEN 'eval_loss' END")
RUNLOG = f"""
  SELECT user_id AS run_id,
         lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '__' || lower({arr(MODELS)}[user_id % 6 + 1]) AS run_name,
         {arr(METHODS)}[user_id % 7 + 1] AS method,
         {arr(MODELS)}[user_id % 6 + 1] AS model,
         {arr(CONTENTS)}[user_id % 8 + 1] AS content,
         event_id AS step,
         CAST(event_id % 5 + 1 AS INTEGER) AS epoch,
         {_metric_case} AS metric,
         value / (value + 50.0) AS value
  FROM events
"""
EPOCHS = f"""
  SELECT method, model, content, -max({{'m': m, 'ne': -epoch}}).ne AS epoch FROM (
    SELECT method, model, content, epoch, avg(value) AS m FROM ({RUNLOG})
    WHERE metric = 'eval_f1' GROUP BY ALL) GROUP BY ALL
"""
VALUES_AT = f"""
  SELECT l.method, l.model, l.content, l.metric, min({{'s': l.step, 'v': l.value}}).v AS value
  FROM ({RUNLOG}) l JOIN ({EPOCHS}) e
    ON l.method = e.method AND l.model = e.model AND l.content = e.content AND l.epoch = e.epoch
  WHERE l.value IS NOT NULL GROUP BY ALL
"""
# the eight metrics of a run table: raw name, title
EIGHT = (("auc-dev", "Development AUC"), ("auc-test", "Test AUC"), ("eval_f1", "Development F1"),
         ("eval_f_beta_2.0", "Development F2"), ("test_f_beta_2.0", "Test F2"), ("test_f1", "Test F1"),
         ("test_precision", "Test Precision"), ("test_recall", "Test Recall"))
RUNLOG8 = f"""
  SELECT l.run_id, l.method, l.model, l.content, l.step, l.epoch, e.value / (e.value + 5.0) AS value,
         CASE e.event_type WHEN 'view' THEN (CASE WHEN e.event_id % 2 = 0 THEN 'eval_f1' ELSE 'test_f1' END)
              WHEN 'click' THEN (CASE WHEN e.event_id % 2 = 0 THEN 'eval_f_beta_2.0' ELSE 'test_f_beta_2.0' END)
              WHEN 'purchase' THEN (CASE WHEN e.event_id % 2 = 0 THEN 'auc-dev' ELSE 'auc-test' END)
              WHEN 'signup' THEN 'test_precision' WHEN 'error' THEN 'test_recall' END AS metric
  FROM ({RUNLOG}) l JOIN events e ON l.step = e.event_id
"""
EPOCHS8 = f"""
  SELECT method, model, content, arg_max(epoch, (m, -epoch)) AS epoch FROM (
    SELECT method, model, content, epoch, avg(value) AS m FROM ({RUNLOG8}) WHERE metric = 'eval_f1' GROUP BY ALL) GROUP BY ALL
"""
VALUES8 = f"""
  SELECT l.method, l.model, l.content, l.metric, arg_min(l.value, l.step) AS value
  FROM ({RUNLOG8}) l JOIN ({EPOCHS8}) e USING (method, model, content, epoch) WHERE l.value IS NOT NULL GROUP BY ALL
"""
RUNS8 = ("SELECT method, model, content, " + ", ".join(f"max(value) FILTER (metric = '{m}') AS {q(m)}" for m, _ in EIGHT)
         + f" FROM ({VALUES8}) GROUP BY ALL")
COMPLETE = ('SELECT model AS "Model", method AS "Training Method", content AS "Content Source", '
            + ", ".join(f"{q(m)} AS {q(t)}" for m, t in EIGHT) + f" FROM ({RUNS8})")
RUNS = ("SELECT method, model, content, " + ", ".join(
    f"first(value) FILTER (WHERE metric = {lit(m)}) AS {m}" for m in LOG_METRICS) +
    f" FROM ({VALUES_AT}) GROUP BY ALL")


def class_rank(base: str, key: str, label: str, salt: str) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {h32(key, salt)}, {key}) AS rk "
            f"FROM ({base})")


def counts(base: str, label: str) -> str:
    return (f"SELECT {label}, count(*) AS nc, sum(count(*)) OVER () AS n, count(*) OVER () AS k "
            f"FROM ({base}) GROUP BY {label}")


def split_stratified(base: str, key: str, label: str, cols: str) -> str:
    return f"""
      SELECT {cols}, CASE WHEN rk <= qt THEN 'test' WHEN rk <= qt + qd THEN 'dev' ELSE 'train' END AS split
      FROM ({class_rank(base, key, label, 'class')}) r JOIN (
        SELECT {label}, CAST(floor(floor(0.1 * n) * (nc / n)) AS BIGINT) AS qt,
                        CAST(floor(floor(0.1 * n) * (nc / n)) AS BIGINT) AS qd FROM ({counts(base, label)})) USING ({label})
    """


def draws(base: str, key: str, label: str, quota: str, salt: str, cols: str) -> str:
    """Rows of `base` drawn with replacement: `quota` gives (label, m) per class."""
    return f"""
      SELECT {cols}, d.i AS _draw FROM (
        SELECT g.{label}, g.i, (({h32(f"CAST(g.{label} AS VARCHAR) || ':' || CAST(g.i AS VARCHAR)", salt + '-draw')})
                % c.nc) + 1 AS rk
        FROM (SELECT {label}, unnest(range(m)) AS i FROM ({quota})) g
        JOIN ({counts(base, label)}) c USING ({label})) d
      JOIN ({class_rank(base, key, label, salt)}) r ON r.{label} = d.{label} AND r.rk = d.rk
    """


def split_balanced(base: str, key: str, label: str, cols: str) -> str:
    tagged = f"""
      SELECT *, CASE WHEN rk <= qt THEN 'test' WHEN rk <= qt + qd THEN 'dev' ELSE 'rest' END AS part
      FROM ({class_rank(base, key, label, 'class')}) r JOIN (
        SELECT {label}, CAST(floor(floor(0.1 * n) * (nc / n)) AS BIGINT) AS qt,
                        CAST(floor(floor(0.1 * n) * (1.0 / k)) AS BIGINT) AS qd FROM ({counts(base, label)})) USING ({label})
    """
    rest = f"SELECT {cols} FROM ({tagged}) WHERE part = 'rest'"
    quota = f"SELECT {label}, CAST(floor(floor(0.8 * n) * (1.0 / k)) AS BIGINT) AS m FROM ({counts(base, label)})"
    rcols = ", ".join(f"r.{c.strip()}" for c in cols.split(","))
    return f"""
      SELECT {cols}, part AS split, CAST(NULL AS BIGINT) AS _draw FROM ({tagged}) WHERE part <> 'rest'
      UNION ALL
      SELECT {cols}, 'train' AS split, _draw FROM ({draws(rest, key, label, quota, 'balanced', rcols)})
    """


def few_shot(balanced: str, key: str, n: int, cols: str) -> str:
    fk = f"CAST({key} AS VARCHAR) || ':' || CAST(_draw AS VARCHAR)"
    return f"""
      SELECT {cols}, split, _draw FROM ({balanced}) WHERE split <> 'train'
      UNION ALL
      SELECT {cols}, CASE WHEN row_number() OVER (ORDER BY {h32('fk', 'few-shot')}, fk) <= {2 * n}
                          THEN 'train' ELSE 'unlabeled' END AS split, _draw
      FROM (SELECT *, {fk} AS fk FROM ({balanced}) WHERE split = 'train')
    """


def binary_metrics(base: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    tp = "sum(CASE WHEN labels = 1 AND predictions = 1 THEN 1 ELSE 0 END)"
    fp = "sum(CASE WHEN labels <> 1 AND predictions = 1 THEN 1 ELSE 0 END)"
    fn = "sum(CASE WHEN labels = 1 AND predictions <> 1 THEN 1 ELSE 0 END)"
    ok = "sum(CASE WHEN labels = predictions THEN 1 ELSE 0 END)"

    def sd(a, b):
        return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"

    def fb(beta):
        b2 = beta * beta
        return sd(f"{1 + b2} * tp", f"{1 + b2} * tp + {b2} * fn + fp")
    return f"""
      SELECT {g}{sd('ok', 'n')} AS accuracy, {fb(1.0)} AS f1, {sd('tp', 'tp + fp')} AS precision,
             {sd('tp', 'tp + fn')} AS recall, CAST(NULL AS BIGINT) AS support,
             {fb(2.0)} AS f_beta_2_0, {fb(0.5)} AS f_beta_0_5
      FROM (SELECT {g}count(*) AS n, {ok} AS ok, {tp} AS tp, {fp} AS fp, {fn} AS fn FROM ({base}) {grp})
    """


# ------------------------------------------------------------------ T

def _doc_op(name, expr_fn):
    SQL[name] = f"SELECT doc_id, {expr_fn('text')} AS out FROM documents"


_doc_op("t1_normalize_hyphens", O.hyphens)
SQL["t2_strip_tags"] = f"SELECT page_id, {O.tags('html')} AS out FROM pages"
SQL["t3_strip_urls"] = f"SELECT page_id, {O.urls(O.tags('html'))} AS out FROM pages"
_doc_op("t4_strip_dates", O.dates)
_doc_op("t5_strip_hours", O.hours)
_doc_op("t6_strip_boilerplate", O.boilerplate)
_doc_op("t7_normalize_quotes", O.quotes)
_doc_op("t8_trim_ws_hyphen", O.ends)
_doc_op("t9_collapse_ws", O.collapse)
_doc_op("t10_drop_short_suffix", lambda e: O.short_suffix(O.short_suffix(O.collapse(e), "-"), "|"))
_doc_op("t11_fix_quotes", O.fix_quotes)
_doc_op("t12_strip_emoji", O.emoji)
_doc_op("t13_strip_control", O.control)
_doc_op("t14_trim_punct", O.punctuation)
_doc_op("t15_trim_digits", O.digits)

SQL["t16_clean_text"] = f"SELECT doc_id, {O.clean_text('text')} AS clean_text FROM documents"
SQL["t17_clean_columns"] = f"""
SELECT doc_id, {O.clean_text('trafilatura_title')} AS trafilatura_title,
       {O.clean_text('trafilatura_abstract')} AS trafilatura_abstract,
       {O.clean_text('trafilatura_fulltext')} AS trafilatura_fulltext,
       {O.clean_text('translation_title')} AS translation_title FROM ({RAW})
"""
SQL["t18_token_count"] = f"SELECT doc_id, {O.token_count('text')} AS n_tokens FROM documents"
_CT = ("CASE WHEN lower(content_source) LIKE '%title%' THEN 'title' "
       "WHEN lower(content_source) LIKE '%abstract%' THEN 'abstract' "
       "WHEN lower(content_source) LIKE '%fulltext%' THEN 'fulltext' END")
SQL["t19_content_type"] = f"""
SELECT doc_id, content_source, {_CT} AS content_type FROM (
  SELECT doc_id, 'trafilatura_title' AS content_source FROM ({RAW}) UNION ALL
  SELECT doc_id, 'trafilatura_abstract' FROM ({RAW}) UNION ALL
  SELECT doc_id, 'trafilatura_fulltext' FROM ({RAW}) UNION ALL
  SELECT doc_id, 'translation_title' FROM ({RAW}))
"""
_V = (1 << 18) - 1
_ids = f"list_transform({O.tokens('text')}, lambda t: CAST((('0x' || substr(md5(t), 1, 8))::BIGINT % {_V}) + 1 AS INTEGER))"
SQL["t20_encode_fixed"] = f"""
SELECT doc_id,
       list_concat(kept, CAST(list_transform(range(greatest(100 - len(kept), 0)), lambda x: 0) AS INTEGER[])) AS input_ids,
       list_concat(CAST(list_transform(range(len(kept)), lambda x: 1) AS INTEGER[]),
                   CAST(list_transform(range(greatest(100 - len(kept), 0)), lambda x: 0) AS INTEGER[])) AS attention_mask
FROM (SELECT doc_id, coalesce({_ids}[1:100], CAST([] AS INTEGER[])) AS kept FROM documents)
"""

# ------------------------------------------------------------------ F

# the content columns and their types
CONTENT = {"trafilatura_title": "title", "trafilatura_abstract": "abstract", "trafilatura_fulltext": "fulltext",
           "translation_title": "title"}


def _each(select) -> str:
    """One SELECT per content column, all united; `select` gets the column and its type."""
    return " UNION ALL ".join(select(c, t) for c, t in CONTENT.items())


def _pred(name, fn):
    SQL[name] = _each(lambda c, t: f"SELECT doc_id, '{c}' AS content_source, {fn(c, t)} AS flag FROM ({RAW})")


_pred("f1_has_content", lambda c, t: O.has_content(c))
_pred("f2_is_too_short", lambda c, t: O.is_too_short(c))
_pred("f3_is_known_dubious", lambda c, t: O.is_known_dubious(c))
_pred("f4_is_error_message", lambda c, t: O.is_error_message(c))
_pred("f5_is_site_name", lambda c, t: O.is_site_name(c))
_pred("f6_is_boilerplate", lambda c, t: O.is_boilerplate(c, t))
_pred("f6_is_boilerplate_strict", lambda c, t: O.is_boilerplate(c, t, "strict"))
_pred("f7_to_be_kept", lambda c, t: O.to_be_kept(c, t, False))
_pred("f7_to_be_kept_strict", lambda c, t: O.to_be_kept(c, t, False, "strict"))
SQL["f8_quality_gate"] = _each(lambda c, t: f"""
SELECT doc_id, '{c}' AS content_source, reason IS NULL AS kept, reason FROM (
  SELECT doc_id, {O.gate_reason('t', t)} AS reason FROM (
    SELECT doc_id, {O.clean_text(c)} AS t FROM ({RAW})))
""")
_WHOLE = " AND ".join(f"nullif({c}, '') IS NOT NULL" for c in ("sujet", *CONTENT))
SQL["f9_drop_missing"] = f"""
SELECT doc_id, {', '.join(CONTENT)}, sujet, n_rows_with_missing,
       round(n_rows_with_missing * 100.0 / n_rows, 6) AS pct_rows_with_missing
FROM ({RAW}), (SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT ({_WHOLE})) AS n_rows_with_missing FROM ({RAW}))
WHERE {_WHOLE}
"""
SQL["f10_select_runs"] = f"SELECT * FROM ({COMPLETE}) WHERE \"Development F2\" >= 0.79"
SQL["f10_follow_up"] = f"SELECT * FROM ({COMPLETE}) WHERE \"Development AUC\" > 0.8 AND \"Development F2\" > 0.8"

# ------------------------------------------------------------------ A

SQL["a1_has_subject"] = f"SELECT doc_id, {O.has_subject('sujet')} AS has_subject FROM ({RAW})"


def dedup_content(c: str, t: str) -> str:
    return f"""
      SELECT text, max({O.has_subject('sujet')}) AS has_subject FROM (
        SELECT {O.clean_text(c)} AS text, sujet FROM ({RAW}))
      WHERE {O.to_be_kept('text', t, keep_titles=True)} GROUP BY 1
    """


DEDUPED = _each(lambda c, t: f"SELECT '{c}' AS content_source, text, has_subject FROM ({dedup_content(c, t)})")
SQL["a2_dedupe_or_label"] = DEDUPED
SQL["a3_class_proportions"] = f"""
SELECT labels, count(*) AS n, count(*) / sum(count(*)) OVER () AS proportion FROM ({TRAIN}) GROUP BY labels
"""
SQL["a4_class_weights"] = f"""
SELECT labels, count(*) AS n_c, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
FROM ({TRAIN}) GROUP BY labels
"""
SQL["a5_value_counts"] = f"SELECT content_source, has_subject, count(*) AS count FROM ({DEDUPED}) GROUP BY 1, 2"


def _profile(base: str, col: str) -> str:
    n = O.token_count(col)
    return f"""
      SELECT count(n) AS count, avg(n) AS mean, stddev_samp(n) AS std, min(n) AS min,
             quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75,
             max(n) AS max
      FROM (SELECT {n} AS n FROM ({base}))
    """


SQL["a6_length_profile"] = _profile("SELECT text FROM documents", "text")
DEDUP_FULL = f"""
  SELECT trafilatura_fulltext, max({O.has_subject('sujet')}) AS has_subject FROM ({RAW})
  WHERE {O.to_be_kept('trafilatura_fulltext', 'fulltext', keep_titles=True)} GROUP BY 1
"""
SQL["a7_overview"] = f"""
SELECT p.*, c.n_negative, c.n_positive FROM ({_profile(DEDUP_FULL, 'trafilatura_fulltext')}) p,
  (SELECT coalesce(count(*) FILTER (WHERE has_subject = 0), 0) AS n_negative,
          coalesce(count(*) FILTER (WHERE has_subject = 1), 0) AS n_positive FROM ({DEDUP_FULL})) c
"""
_BAL_T = split_balanced(TRAIN2, "doc_id", "labels", "doc_id, labels")


def _splits_of(c: str, t: str) -> str:
    base, cols = dedup_content(c, t), "text, has_subject"
    balanced = split_balanced(base, "text", "has_subject", cols)
    return f"""
      SELECT '{c}' AS content_source, 'unbalanced' AS scheme, split, has_subject AS labels
      FROM ({split_stratified(base, 'text', 'has_subject', cols)})
      UNION ALL SELECT '{c}', 'balanced_dev_train', split, has_subject FROM ({balanced})
      UNION ALL SELECT '{c}', 'pet_50', split, has_subject FROM ({few_shot(balanced, 'text', 50, cols)})
    """


_ALLS = _each(_splits_of)
SQL["a8_split_statistics"] = "SELECT content_source, scheme, " + ", ".join(
    f"CASE WHEN count(*) FILTER (WHERE split = '{s}') > 0 THEN count(*) FILTER (WHERE split = '{s}') END AS {s}_size, "
    f"CASE WHEN count(*) FILTER (WHERE split = '{s}') > 0 THEN CAST(sum(labels) FILTER (WHERE split = '{s}') AS BIGINT) END "
    f"AS {s}_positives, "
    f"CASE WHEN count(*) FILTER (WHERE split = '{s}') > 0 THEN CAST(sum(1 - labels) FILTER (WHERE split = '{s}') AS BIGINT) END "
    f"AS {s}_negatives"
    for s in ("train", "dev", "test", "unlabeled")) + f" FROM ({_ALLS}) GROUP BY content_source, scheme"
SQL["a9_distinct_texts"] = "SELECT count(DISTINCT text) AS n_distinct FROM documents"
_PROF_COLS = [*CONTENT, "sujet", "quality"]
SQL["a10_column_profile"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null FROM ({RAW})" for c in _PROF_COLS)
_MISS = " + ".join(f"(CASE WHEN {c} IS NULL OR {c} = '' THEN 1 ELSE 0 END)"
                   for c in [*CONTENT, "sujet"])
SQL["a11_missing_report"] = f"""
SELECT n_rows, n_missing, n_rows_with_missing, round(n_rows_with_missing * 100.0 / n_rows, 6) AS pct_rows_with_missing
FROM (SELECT count(*) AS n_rows, CAST(sum({_MISS}) AS BIGINT) AS n_missing,
             CAST(sum(CASE WHEN {_MISS} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rows_with_missing FROM ({RAW}))
"""
SQL["a12_classification_metrics"] = binary_metrics(SCORED)
_PER_CLASS = f"""
  SELECT c, sum(CASE WHEN labels = c AND predictions = c THEN 1 ELSE 0 END) AS tp,
            sum(CASE WHEN labels <> c AND predictions = c THEN 1 ELSE 0 END) AS fp,
            sum(CASE WHEN labels = c AND predictions <> c THEN 1 ELSE 0 END) AS fn
  FROM ({SCORED}) s, (SELECT DISTINCT labels AS c FROM ({SCORED}) UNION SELECT DISTINCT predictions FROM ({SCORED})) cl
  GROUP BY c
"""


def _sd(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def _fb(beta):
    b2 = beta * beta
    return _sd(f"{1 + b2} * tp", f"{1 + b2} * tp + {b2} * fn + fp")


SQL["a12_macro_metrics"] = f"""
SELECT (SELECT avg(CASE WHEN labels = predictions THEN 1.0 ELSE 0.0 END) FROM ({SCORED})) AS accuracy,
       avg({_fb(1.0)}) AS f1, avg({_sd('tp', 'tp + fp')}) AS precision, avg({_sd('tp', 'tp + fn')}) AS recall,
       CAST(NULL AS BIGINT) AS support, avg({_fb(2.0)}) AS f_beta_2_0, avg({_fb(0.5)}) AS f_beta_0_5
FROM ({_PER_CLASS})
"""
_PTS = f"""
  SELECT score, pos, neg, row_number() OVER (ORDER BY score DESC) - 1 AS idx,
         sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps,
         sum(pos) OVER () AS P, sum(neg) OVER () AS N
  FROM (SELECT score, sum(CASE WHEN labels = 1 THEN 1 ELSE 0 END) AS pos,
               sum(CASE WHEN labels = 1 THEN 0 ELSE 1 END) AS neg FROM ({SCORED}) GROUP BY score)
"""
SQL["a13_roc_curve"] = f"""
SELECT -1::BIGINT AS idx, max(score) + 1 AS threshold, 0.0 AS fpr, 0.0 AS tpr FROM ({SCORED})
UNION ALL
SELECT idx, score AS threshold, {_sd('fps', 'N')} AS fpr, {_sd('tps', 'P')} AS tpr FROM (
  SELECT *, lead(pos) OVER (ORDER BY idx) AS np, lead(neg) OVER (ORDER BY idx) AS nn,
         max(idx) OVER () AS last FROM ({_PTS}))
WHERE idx = 0 OR idx = last OR np <> pos OR nn <> neg
"""
SQL["a14_roc_auc"] = f"SELECT {_sd('sum(neg * (tps - pos / 2.0))', 'max(N * P)')} AS auc FROM ({_PTS})"
_FOLDS = f"""
  SELECT *, CAST((row_number() OVER (PARTITION BY labels ORDER BY {h32('doc_id', 'kfold')}, doc_id) - 1) % 5 AS INTEGER) AS fold
  FROM ({SCORED})
"""
SQL["a15_cv_summary"] = f"""
SELECT metric, avg(value) AS mean, stddev_samp(value) AS std, metric = 'f1' AS selected FROM (
  UNPIVOT (SELECT fold, accuracy, f1, precision, recall, f_beta_2_0, f_beta_0_5 FROM ({binary_metrics(_FOLDS, 'fold')}))
  ON accuracy, f1, precision, recall, f_beta_2_0, f_beta_0_5 INTO NAME metric VALUE value)
GROUP BY metric
"""
SQL["a16_weighted_cross_entropy"] = f"""
SELECT sum(w * -ln(CASE WHEN s.labels = 1 THEN score ELSE 1.0 - score END)) / sum(w) AS loss
FROM ({SCORED}) s JOIN (
  SELECT labels, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM ({SCORED}) GROUP BY labels) ww
  ON s.labels = ww.labels
"""
SQL["a17_ensemble_summary"] = f"""
SELECT model, {', '.join(f'avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std' for m in LOG_METRICS)} FROM ({RUNS}) GROUP BY model
"""

# ------------------------------------------------------------------ O

SQL["o1_shuffle"] = f"""
SELECT doc_id, labels, row_number() OVER (ORDER BY {h32('doc_id', 'shuffle')}, doc_id) AS position FROM ({TRAIN2})
"""
SQL["o2_top_label"] = f"""
SELECT doc_id, CASE WHEN score >= 1 - score THEN 'relevant' ELSE 'irrelevant' END AS top_label,
       CASE WHEN score >= 1 - score THEN score ELSE 1 - score END AS top_score FROM ({SCORED})
"""
SQL["o3_downsample"] = f"""
SELECT doc_id, labels FROM (
  SELECT *, row_number() OVER (ORDER BY {h32('doc_id', 'downsample')}, doc_id) AS rk,
         count(*) OVER () AS n FROM ({TRAIN2}))
WHERE rk <= round_even(n * 0.1, 0)
"""
SQL["o4_split_ordered"] = f"""
SELECT doc_id, labels, CASE WHEN pos <= floor(0.8 * n) THEN 'train' WHEN pos <= floor({0.8 + 0.1!r} * n) THEN 'dev'
                            ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos, count(*) OVER () AS n FROM ({TRAIN2}))
"""
SQL["o5_sample_by_class"] = f"""
SELECT doc_id, labels FROM ({class_rank(TRAIN2, 'doc_id', 'labels', 'class')}) r
JOIN (SELECT labels, floor(floor(0.3 * n) * (nc / n)) AS qq FROM ({counts(TRAIN2, 'labels')})) USING (labels)
WHERE rk <= qq
"""
SQL["o6_sample_with_replacement"] = draws(
    TRAIN2, "doc_id", "labels", f"SELECT labels, CAST(floor(n * 0.4) AS BIGINT) AS m FROM ({counts(TRAIN2, 'labels')})",
    "replace", "r.doc_id, r.labels")
SQL["o7_split_stratified"] = split_stratified(TRAIN2, "doc_id", "labels", "doc_id, labels")
SQL["o8_split_balanced"] = _BAL_T
SQL["o9_split_few_shot"] = few_shot(_BAL_T, "doc_id", 50, "doc_id, labels")
SQL["o10_stratified_kfold"] = f"""
SELECT doc_id, labels, CAST((row_number() OVER (PARTITION BY labels ORDER BY {h32('doc_id', 'kfold')}, doc_id) - 1) % 10 AS INTEGER) AS fold
FROM ({TRAIN2})
"""
SQL["o11_best_latest_step"] = f"""
SELECT run_id, max(step) AS latest_step, max({{'v': value, 's': step}}) FILTER (WHERE metric = 'eval_f1').s AS best_step
FROM ({RUNLOG}) GROUP BY run_id
"""
SQL["o12_metric_evolution"] = f"""
SELECT run_id, metric, epoch, step, value FROM ({RUNLOG}) WHERE metric IS NOT NULL AND value IS NOT NULL
"""
SQL["o13_split_dataset"] = _each(lambda c, t: f"""
SELECT '{c}' AS content_source, text, has_subject, split, 'unbalanced' AS scheme, CAST(NULL AS BIGINT) AS _draw
FROM ({split_stratified(dedup_content(c, t), 'text', 'has_subject', 'text, has_subject')})
UNION ALL
SELECT '{c}' AS content_source, text, has_subject, split, 'balanced_dev_train' AS scheme, _draw
FROM ({split_balanced(dedup_content(c, t), 'text', 'has_subject', 'text, has_subject')})
""")

# ------------------------------------------------------------------ J, U

SQL["j1_positional_join"] = "SELECT doc_id AS row_id, text, lang FROM documents"
_SAMPLE10 = f"""
SELECT doc_id, labels FROM ({class_rank(TRAIN2, 'doc_id', 'labels', 'class')}) r
JOIN (SELECT labels, floor(floor(0.1 * n) * (nc / n)) AS qq FROM ({counts(TRAIN2, 'labels')})) USING (labels)
WHERE rk <= qq
"""
SQL["j2_difference"] = f"""
SELECT t.doc_id, t.labels FROM ({TRAIN2}) t
WHERE NOT EXISTS (SELECT 1 FROM ({_SAMPLE10}) s
                  WHERE CAST(s.doc_id AS VARCHAR) IS NOT DISTINCT FROM CAST(t.doc_id AS VARCHAR)
                    AND CAST(s.labels AS VARCHAR) IS NOT DISTINCT FROM CAST(t.labels AS VARCHAR))
"""
_REG = " UNION ALL ".join(f"SELECT {lit(s)} AS content_source, {lit(m)} AS bert_model_name, {lit(t)} AS training_method"
                          for s in CONTENT_SOURCES for m in BERT_MODELS for t in TRAINING_METHODS)
SQL["j3_fan_out"] = f"""
SELECT u.doc_id, u.content_source, r.bert_model_name, r.training_method FROM (
  SELECT doc_id, 'trafilatura_title' AS content_source, trafilatura_title AS text FROM ({RAW}) UNION ALL
  SELECT doc_id, 'trafilatura_abstract', trafilatura_abstract FROM ({RAW}) UNION ALL
  SELECT doc_id, 'trafilatura_fulltext', trafilatura_fulltext FROM ({RAW}) UNION ALL
  SELECT doc_id, 'translated_title', translation_title FROM ({RAW})) u
JOIN ({_REG}) r ON u.content_source = r.content_source WHERE u.text IS NOT NULL
"""
_NAMES = f"""
  SELECT run_id, upper({arr(CONTENT_SOURCES)}[run_id % 4 + 1]) || '_' || {arr(TRAINING_METHODS)}[(run_id // 2) % 2 + 1]
         || '_' || {arr(BERT_MODELS)}[run_id % 2 + 1] || '_run' || CAST(run_id AS VARCHAR) AS model_dir
  FROM (SELECT DISTINCT run_id FROM ({RUNLOG}))
"""
SQL["j4_registry_match"] = f"""
SELECT n.run_id, n.model_dir, s.v AS content_source, b.v AS bert_model_name, t.v AS training_method
FROM ({_NAMES}) n
JOIN (SELECT unnest({arr(CONTENT_SOURCES)}) AS v) s ON contains(lower(n.model_dir), s.v)
JOIN (SELECT unnest({arr(BERT_MODELS)}) AS v) b ON contains(lower(n.model_dir), b.v)
JOIN (SELECT unnest({arr(TRAINING_METHODS)}) AS v) t ON contains(lower(n.model_dir), t.v)
"""
SQL["j5_value_at_epoch"] = VALUES_AT
SQL["j6_assemble_runs"] = RUNS8
SQL["j7_label_map"] = f"""
SELECT doc_id, CASE labels WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'relevant' END AS label_name,
       CASE labels WHEN 0 THEN 0 WHEN 1 THEN 1 END AS label_id FROM ({TRAIN})
"""
_MNAMES = " UNION ALL ".join(f"SELECT {lit(m.lower())} AS logical_name, {lit(m)} AS model_label" for m in MODELS)
SQL["j8_run_name_match"] = f"""
SELECT r.run_id, r.run_name, r.logical_name, m.model_label FROM (
  SELECT DISTINCT run_id, run_name, trim(regexp_replace(run_name, '^[0-9]+', ''), '_') AS logical_name FROM ({RUNLOG})) r
JOIN ({_MNAMES}) m ON r.logical_name = m.logical_name
"""
SQL["u1_union_samples"] = f"""
SELECT doc_id, labels FROM ({class_rank(TRAIN2, 'doc_id', 'labels', 'class')}) r
JOIN (SELECT labels, floor(floor(0.2 * n) * (nc / n)) AS qq FROM ({counts(TRAIN2, 'labels')})) USING (labels)
WHERE rk <= qq
"""

# ------------------------------------------------------------------ P

_F1 = f"SELECT * FROM ({VALUES_AT}) WHERE metric = 'eval_f1'"
_GRID = ("SELECT model, " + ", ".join(f"first(value) FILTER (WHERE content = {lit(c)}) AS {q(c)}" for c in CONTENTS)
         + f" FROM ({_F1}) WHERE method = 'PET 1000' GROUP BY model")
SQL["p1_metric_grid"] = _GRID
SQL["p2_method_comparison"] = ("SELECT content, " + ", ".join(
    f"first(value) FILTER (WHERE method = {lit(m)}) AS {q(m)}" for m in METHODS)
    + f" FROM ({_F1}) WHERE model = 'XLM-RoBERTa' GROUP BY content")
_GRID_LONG = " UNION ALL ".join(f"SELECT model, {lit(c)} AS content, {q(c)} AS v FROM ({_GRID})" for c in CONTENTS)
SQL["p3_transpose"] = ("SELECT content, " + ", ".join(
    f"first(v) FILTER (WHERE model = {lit(m)}) AS {q(m)}" for m in MODELS) + f" FROM ({_GRID_LONG}) GROUP BY content")
SQL["p4_fill_missing"] = "SELECT model, " + ", ".join(f"coalesce({q(c)}, 0.0) AS {q(c)}" for c in CONTENTS) + \
    f" FROM ({_GRID})"
SQL["p5_content_unpivot"] = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS content_source, {c} AS text FROM ({RAW})"
    for c in CONTENT)
SQL["p6_complete_table"] = COMPLETE

# ------------------------------------------------------------------ X

# sentences: what stands between the ends ., ! and ?
SENTENCE = r"([^.!?]+[.!?]*)"


def element_sql(tag: str) -> str:
    """Text of the first such element: inner tags removed, the given pages' entities decoded."""
    inner = f"regexp_extract(html, '(?is)<{tag}(?: [^>]*)?>(.*?)</{tag}>', 1)"
    text = f"regexp_replace({inner}, '<[^>]*>', '', 'g')"
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, {lit(entity)}, {lit(char)})"
    text = O.py_strip(text)
    return f"CASE WHEN {text} IN ('', 'None') THEN NULL ELSE {text} END"


PAGE_FIELDS = f"""
  SELECT page_id, {element_sql('title')} AS title, CAST(NULL AS VARCHAR) AS abstract, {element_sql('article')} AS fulltext
  FROM pages
"""
SQL["x1_extract_title"] = f"SELECT page_id, title FROM ({PAGE_FIELDS})"
SQL["x1_extract_fields"] = PAGE_FIELDS
SQL["x2_add_parsed_columns"] = f"""
SELECT p.page_id, f.title AS parsed_trafilatura_title, f.abstract AS parsed_trafilatura_abstract,
       f.fulltext AS parsed_trafilatura_fulltext FROM pages p JOIN ({PAGE_FIELDS}) f ON p.page_id = f.page_id
"""
_KW = lit("(?i)" + O.keyword_regex())
SQL["x3_contains_keywords"] = f"SELECT doc_id, coalesce(regexp_matches(text, {_KW}), false) AS has_keyword FROM documents"


def relevant_sql(expr: str) -> str:
    sents = (f"flatten(list_transform(list_filter(string_split({expr}, {NL}), lambda p: p <> ''), "
             f"lambda p: list_transform(regexp_extract_all({O.py_strip('p')}, {lit(SENTENCE)}, 1), "
             f"lambda s: {O.py_strip('s')})))")
    kept = f"list_filter({sents}, lambda s: regexp_matches(s, {_KW}))"
    return f"(list_transform([{kept}], lambda k: CASE WHEN len(k) > 0 THEN array_to_string(k, '.') END))[1]"


SQL["x4_relevant_sentences"] = f"SELECT doc_id, {relevant_sql('text')} AS sentences FROM documents"
SQL["x4_abbreviations"] = rf"""
WITH w AS (SELECT regexp_replace(unnest({O.tokens('lower(text)')}), '^[^\p{{L}}\p{{Nd}}]+|[,;:!?)\]\p{{Pf}}"'']+$', '', 'g') AS w FROM documents),
c AS (SELECT CASE WHEN regexp_matches(w, '[^.]\.$') THEN w[:-2] ELSE w END AS word, regexp_matches(w, '[^.]\.$') AS stop FROM w),
e AS (SELECT word, count(*) AS n, count(*) FILTER (stop) AS k FROM c WHERE word <> '' GROUP BY word),
t AS (SELECT greatest(least(sum(k) / sum(n), 0.98), 1e-9) AS p FROM e),
l AS (SELECT word, n, k, p, length(replace(word, '.', '')) AS letters FROM e, t)
SELECT word, n, k, 2 * (k * (ln(0.99) - ln(p)) + (n - k) * (ln(0.01) - ln(1 - p))) * exp(-letters) * (length(word) - letters + 1)
    * power(CAST(letters AS DOUBLE), -(n - k)) AS score
FROM l WHERE k >= 2 AND letters >= 1 AND length(word) <= 12 AND regexp_matches(word, '^[\p{{L}}.]+$')
"""
SQL["x5_add_sentence_columns"] = f"""
SELECT doc_id, trafilatura_abstract, trafilatura_fulltext,
       coalesce({relevant_sql('trafilatura_abstract')}, trafilatura_abstract)
         AS sentence_with_keywords_trafilatura_abstract_keep_original_content,
       coalesce({relevant_sql('trafilatura_fulltext')}, trafilatura_fulltext)
         AS sentence_with_keywords_trafilatura_fulltext_keep_original_content
FROM ({RAW})
"""

# ------------------------------------------------------------------ S

SQL["s1_read_table"] = "SELECT doc_id, text AS content, lang FROM documents"
SQL["s2_read_splits"] = SQL["o7_split_stratified"]
SQL["s3_load_labeled"] = f"""
SELECT text, labels, doc_id, split FROM ({split_stratified(TRAIN, 'doc_id', 'labels', 'doc_id, text, labels')})
WHERE nullif(text, '') IS NOT NULL AND labels IS NOT NULL
"""
SQL["s4_write_columns"] = "SELECT doc_id AS row_id, text, lang, source FROM documents"
SQL["s5_read_columns"] = "SELECT doc_id AS row_id, text, lang FROM documents"
SQL["s6_reduce_columns"] = f"""
SELECT doc_id, trafilatura_title, trafilatura_abstract, trafilatura_fulltext, translation_title, sujet FROM ({RAW})
"""


def dedup_sql(col: str, ctype: str, source: str = RAW) -> str:
    return f"""
      SELECT {col}, max({O.has_subject('sujet')}) AS has_subject FROM (
        SELECT {O.clean_text(col)} AS {col}, sujet FROM ({source}))
      WHERE {O.to_be_kept(col, ctype, keep_titles=True)} GROUP BY 1
    """


SQL["s7_write_datasets"] = DEDUPED
SQL["s8_write_splits"] = f"""
SELECT doc_id, labels, CAST(NULL AS BIGINT) AS _draw, 'unbalanced' AS scheme, split
FROM ({split_stratified(TRAIN2, 'doc_id', 'labels', 'doc_id, labels')})
UNION ALL
SELECT doc_id, labels, _draw, 'balanced_dev_train' AS scheme, split FROM ({_BAL_T})
"""
SQL["s9_read_run_logs"] = "SELECT run_id, step, CAST(epoch AS DOUBLE) AS epoch, " + ", ".join(
        f"CASE WHEN metric = {lit(m)} THEN value END AS {m}" for m in LOG_METRICS) + f" FROM ({RUNLOG})"


def roc_sql(base: str, by: str) -> str:
    pts = f"""
      SELECT {by}, score, pos, neg, row_number() OVER (PARTITION BY {by} ORDER BY score DESC) - 1 AS idx,
             sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS tps,
             sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC) AS fps,
             sum(pos) OVER (PARTITION BY {by}) AS P, sum(neg) OVER (PARTITION BY {by}) AS N
      FROM (SELECT {by}, score, sum(CASE WHEN labels = 1 THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN labels = 1 THEN 0 ELSE 1 END) AS neg FROM ({base}) GROUP BY {by}, score)
    """
    curve = f"""
      SELECT {by}, -1::BIGINT AS idx, max(score) + 1 AS threshold, 0.0 AS fpr, 0.0 AS tpr FROM ({base}) GROUP BY {by}
      UNION ALL
      SELECT {by}, idx, score AS threshold, {_sd('fps', 'N')} AS fpr, {_sd('tps', 'P')} AS tpr FROM (
        SELECT *, lead(pos) OVER (PARTITION BY {by} ORDER BY idx) AS np, lead(neg) OVER (PARTITION BY {by} ORDER BY idx) AS nn,
               max(idx) OVER (PARTITION BY {by}) AS last FROM ({pts}))
      WHERE idx = 0 OR idx = last OR np <> pos OR nn <> neg
    """
    auc = f"SELECT {by}, {_sd('sum(neg * (tps - pos / 2.0))', 'max(N * P)')} AS AUC FROM ({pts}) GROUP BY {by}"
    return curve, auc


_curve, _auc = roc_sql(_FOLDS, "fold")
SQL["s10_read_split_metrics"] = f"""
SELECT c.fold, a.AUC, c.idx, c.fpr, c.tpr, c.threshold
FROM ({_curve}) c JOIN ({_auc}) a ON c.fold = a.fold
"""
SQL["s11_read_metric_text"] = f"""
SELECT 'eval_f1-' || model AS name, avg(eval_f1) AS mean, stddev_samp(eval_f1) AS std FROM ({RUNS}) GROUP BY model
"""
SQL["s12_write_predictions"] = f"SELECT labels, predictions, score AS probabilities_for_positive_label, doc_id FROM ({SCORED})"
SQL["s13_write_metrics"] = binary_metrics(SCORED)

# ------------------------------------------------------------------ M, I

SQL["m3_positive_probability"] = f"""
SELECT doc_id, CASE WHEN score >= 1 - score THEN score ELSE 1.0 - (1 - score) END AS probabilities_for_positive_label
FROM ({SCORED})
"""
SQL["m2_predicted_rows"] = f"""
SELECT doc_id, labels, CAST(2 AS BIGINT) AS n_probabilities, true AS sums_to_one
FROM ({split_stratified(TRAIN2, 'doc_id', 'labels', 'doc_id, labels')}) WHERE split = 'test'
"""
SQL["m6_fold_sizes"] = f"""
SELECT CAST((rk - 1) % 10 AS INTEGER) AS fold, count(*) AS n_rows, CAST(sum(labels) AS BIGINT) AS n_positive
FROM ({class_rank(TRAIN2, 'doc_id', 'labels', 'kfold')}) GROUP BY 1
"""
_SRC = {"trafilatura_title": ("trafilatura_title", "title"), "trafilatura_abstract": ("trafilatura_abstract", "abstract"),
        "trafilatura_fulltext": ("trafilatura_fulltext", "fulltext"), "translated_title": ("translation_title", "title")}
SQL["i4_gate_report"] = "SELECT content_source, reason, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{s}' AS content_source, {O.gate_reason('t', ct)} AS reason FROM "
    f"(SELECT {O.clean_text(c)} AS t FROM ({RAW})) WHERE t IS NOT NULL"
    for s, (c, ct) in _SRC.items()) + ") GROUP BY ALL"



def gate_sql(base: str, sources) -> str:
    """(doc_id, content_source, kept, reason) of the cleaned texts in `base`, by source."""
    return "SELECT doc_id, content_source, reason IS NULL AS kept, reason FROM (" + " UNION ALL ".join(
        f"SELECT doc_id, '{s}' AS content_source, {O.gate_reason('t', ct)} AS reason FROM "
        f"(SELECT doc_id, {O.clean_text(c)} AS t FROM ({base})) WHERE t IS NOT NULL" for s, (c, ct) in sources.items()) + ")"


_PAGE_SRC = {"trafilatura_title": ("title", "title"), "trafilatura_abstract": ("abstract", "abstract"),
             "trafilatura_fulltext": ("fulltext", "fulltext")}
SQL["i1_gate"] = gate_sql(RAW, _SRC)
SQL["i2_gate"] = gate_sql(f"SELECT page_id AS doc_id, * FROM ({PAGE_FIELDS})", _PAGE_SRC)


def first_epoch_sql(train: str, texts: str, keys) -> str:
    """`keys`, prediction_id for `texts` (keys..., part, text), by a model of each `part` of `train` (part, doc_id, text, labels).

    Words are lower-cased and hashed by CRC-32; the first epoch goes from zero weights down the
    gradient of the class-weighted loss, each weight by its share of 1 / (curvature + penalty);
    a text is relevant where its TF-IDF lies against that. The step's length does not matter for the sign.
    """
    keys = ", ".join(keys)
    words = O.tokens("lower(text)")
    return f"""
WITH crc AS (
  SELECT list(list_reduce([x, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY x) AS t
  FROM (SELECT CAST(range AS BIGINT) AS x FROM range(256))),
train AS (SELECT part, doc_id, labels, {words} AS words FROM ({train}) WHERE text IS NOT NULL AND labels IN (0, 1)),
texts AS (SELECT {keys}, part, row_number() OVER () AS row, {words} AS words FROM ({texts})),
terms AS (SELECT DISTINCT unnest(words) AS word FROM train UNION SELECT DISTINCT unnest(words) FROM texts),
spelled AS (
  SELECT word, list_transform(range(1, CAST(length(hex(word)) / 2 AS BIGINT) + 1),
    lambda i: 16 * (strpos('0123456789ABCDEF', hex(word)[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', hex(word)[2 * i]) - 1) AS bytes FROM terms),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
    lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1])), 4294967295) % {1 << 18} AS bucket FROM spelled, crc),
tf AS (
  SELECT part, doc_id, labels, bucket, count(*) AS tf
  FROM (SELECT part, doc_id, labels, unnest(words) AS word FROM train) JOIN buckets USING (word) GROUP BY ALL),
size AS (SELECT part, labels, count(*) AS n_c, sum(count(*)) OVER (PARTITION BY part) AS n, count(*) OVER (PARTITION BY part) AS classes
  FROM train GROUP BY part, labels),
idf AS (SELECT part, bucket, ln((any_value(n) + 1) / CAST(count(DISTINCT doc_id) + 1 AS DOUBLE)) AS idf,
    count(DISTINCT doc_id) / CAST(any_value(n) AS DOUBLE) AS share
  FROM tf JOIN size USING (part, labels) GROUP BY part, bucket),
gradient AS (SELECT part, bucket, sum(tf * (0.5 - labels) * n / CAST(classes * n_c AS DOUBLE)) * any_value(idf) * any_value(idf)
    / (any_value(idf) * any_value(idf) * any_value(share) / 4 + 0.01) AS g
  FROM tf JOIN size USING (part, labels) JOIN idf USING (part, bucket) GROUP BY part, bucket)
SELECT {keys}, CAST(coalesce(sum(g), 0) < 0 AS INTEGER) AS prediction_id
FROM (SELECT {keys}, part, row, unnest(words) AS word FROM texts) JOIN buckets USING (word) LEFT JOIN gradient USING (part, bucket)
GROUP BY {keys}, row
"""


SQL["m2_first_epoch_ids"] = first_epoch_sql(f"SELECT 0 AS part, doc_id, text, labels FROM ({TRAIN})",
                                            "SELECT doc_id, 0 AS part, text FROM documents WHERE text IS NOT NULL", ["doc_id"])
SQL["i1_first_epoch_ids"] = first_epoch_sql(
    f"SELECT doc_id % 2 AS part, doc_id, text, labels FROM ({TRAIN})",
    f"""SELECT doc_id, content_source, bert_model_name, training_method, CASE training_method WHEN 'finetuning' THEN 0 ELSE 1 END AS part, text
        FROM ({" UNION ALL ".join(
            f"SELECT doc_id, '{s}' AS content_source, t AS text FROM (SELECT doc_id, {O.clean_text(c)} AS t FROM ({RAW})) "
            f"WHERE t IS NOT NULL AND {O.gate_reason('t', ct)} IS NULL" for s, (c, ct) in _SRC.items())}),
             (SELECT unnest({arr(BERT_MODELS)}) AS bert_model_name), (SELECT unnest({arr(TRAINING_METHODS)}) AS training_method)""",
    ["doc_id", "content_source", "bert_model_name", "training_method"])

# ------------------------------------------------------------------ E

_E1_COLS = {"parsed_trafilatura_title": ("trafilatura_title", "title"),
            "parsed_trafilatura_abstract": ("trafilatura_abstract", "abstract"),
            "parsed_trafilatura_fulltext": ("trafilatura_fulltext", "fulltext"),
            "translation_title": ("translation_title", "title")}


def _e1_part(col: str, orig: str, ctype: str) -> str:
    if col.startswith("parsed_"):
        src = (f"SELECT CASE WHEN {O.py_strip(orig)} IN ('', 'None') THEN NULL ELSE {O.py_strip(orig)} END AS {col}, "
               f"sujet FROM ({RAW})")
    else:
        src = f"SELECT {col}, sujet FROM ({RAW})"
    d = f"SELECT {col} AS text, has_subject FROM ({dedup_sql(col, ctype, src)})"
    bal = split_balanced(d, "text", "has_subject", "text, has_subject")
    return f"""
      SELECT text, has_subject, split, CAST(NULL AS BIGINT) AS _draw, '{col}' AS content_source, 'unbalanced' AS scheme
      FROM ({split_stratified(d, 'text', 'has_subject', 'text, has_subject')})
      UNION ALL SELECT text, has_subject, split, _draw, '{col}', 'balanced_dev_train' FROM ({bal})
      UNION ALL SELECT text, has_subject, split, _draw, '{col}', 'pet_50' FROM ({few_shot(bal, 'text', 50, 'text, has_subject')})
    """


SQL["e1_prepare"] = " UNION ALL ".join(_e1_part(c, o, t) for c, (o, t) in _E1_COLS.items())
SQL["e1_prepare_files"] = SQL["e1_prepare"]
SQL["e2_compare_runs"] = SQL["f10_select_runs"]
