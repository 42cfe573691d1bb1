"""The queries once more as plain SQL, written independently of the DataFrame code: ``name -> SQL``.

Most learners and searches have no SQL form and no entry here; their tests check properties instead. Those with one input or one
split do have one, and run the same code.
"""

from __future__ import annotations

import json
import math

import numpy as np

# The appointment table; ``h`` is the split hash of the row key.
APPOINTMENTS = """
visits AS (
  SELECT *, (o_orderkey * 7919) % 60 AS lead,
         CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS reminded
  FROM orders JOIN customer ON o_custkey = c_custkey
),
appointments AS (
  SELECT o_custkey AS patient_id,
         o_orderkey AS appointment_id,
         CASE WHEN o_orderkey % 97 <> 5 THEN c_mktsegment END AS gender,
         CAST(o_orderdate AS DATE) AS scheduled_day,
         CAST(o_orderdate AS DATE) + CAST(lead AS INTEGER) AS appointment_day,
         CASE WHEN o_orderkey % 89 <> 7 THEN CAST(18 + floor(o_totalprice / 7000) AS DOUBLE) END AS age,
         CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment AS neighborhood,
         CAST(c_acctbal < 0 AS DOUBLE) AS scholarship,
         CAST(o_orderstatus = 'F' AS DOUBLE) AS hypertension,
         CAST(o_orderstatus = 'O' AS DOUBLE) AS diabetes,
         CAST(c_acctbal > 8000 AS DOUBLE) AS alcoholism,
         CAST(o_orderkey % 25 = 3 AS DOUBLE) AS handicap,
         CAST(reminded AS DOUBLE) AS sms_received,
         CASE WHEN o_orderkey % 101 <> 9 THEN
           CAST((o_orderkey * 1664525 + 1013904223) % 2147483647 % 100
                < 88 - 0.3 * lead + 8 * reminded - CASE WHEN c_nationkey % 5 = 0 THEN 12 ELSE 0 END AS DOUBLE)
         END AS showed_up,
         CAST(lead AS DOUBLE) AS date_diff
  FROM visits
),
hashed AS (
  SELECT *, (appointment_id * 1103515245 + 12345) % 2147483647 AS h,
         (appointment_id * 1566083941 + 2531011) % 2147483647 AS fold_h
  FROM appointments
),
split_rows AS (
  SELECT *, h % 100 AS bucket, CASE WHEN h % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM hashed
),
labelled AS (SELECT * FROM split_rows WHERE showed_up IS NOT NULL),
train AS (SELECT * FROM labelled WHERE split = 'train')
"""

BASE = ["age", "scholarship", "hypertension", "diabetes", "alcoholism", "handicap", "sms_received", "date_diff"]
DATES = ["scheduled_day", "appointment_day"]
COLUMNS = [
    "patient_id", "appointment_id", "gender", *DATES, *BASE[:1], "neighborhood", *BASE[1:7], "showed_up", "date_diff",
]
VALID_BASE = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in BASE)


def with_tables(body: str, *more: str) -> str:
    """A query over the appointment table and further named subqueries."""
    return "WITH " + ",\n".join([APPOINTMENTS, *more]) + "\n" + body


def as_text(column: str) -> str:
    return f"CAST({column} AS VARCHAR) AS {column}" if column in DATES else column


def plain(columns: list[str]) -> str:
    return ", ".join(as_text(c) for c in columns)


def rounded(expression: str, name: str) -> str:
    return f"floor(({expression}) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS {name}"


# --- calendar parts --------------------------------------------------------------------------------------

PARTS = {"month": ("month({})", 12), "dayofyear": ("dayofyear({})", 365), "dayofweek": ("dayofweek({}) + 1", 7)}


def calendar(parts: list[str]) -> list[str]:
    columns = []
    for prefix, column in zip(["sched", "appoi"], DATES):
        for part in parts:
            value, period = PARTS[part]
            angle = f"2 * pi() * ({value.format(column)}) / {period}::DOUBLE"
            columns.append(rounded(f"sin({angle})", f"{prefix}_{part}_sin"))
            columns.append(rounded(f"cos({angle})", f"{prefix}_{part}_cos"))
    return columns


# --- planted rows ----------------------------------------------------------------------------------------

OTHERS = [c for c in COLUMNS if c != "appointment_id"]
EMPTIED = (
    "emptied AS (SELECT appointment_id, "
    + ", ".join(f"CASE WHEN appointment_id % 15 <= {i} THEN {c} END AS {c}" for i, c in enumerate(OTHERS))
    + " FROM appointments)"
)
NULL_FIELDS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in ["appointment_id", *OTHERS])

GAPS = """
gaps AS (
  SELECT * REPLACE (
    CASE WHEN appointment_id % 79 = 11 THEN NULL
         WHEN split = 'test' AND appointment_id % 71 = 3 THEN 'opened later'
         ELSE neighborhood END AS neighborhood)
  FROM labelled
),
gaps_train AS (SELECT * FROM gaps WHERE split = 'train')
"""

# --- target encoding -------------------------------------------------------------------------------------


def encoding(source: str, name: str, smoothing: str) -> str:
    """Subquery ``name`` with one row per neighborhood of ``source``."""
    if smoothing == "auto":
        weight = f"{name}_g.tau2 * n / ({name}_g.tau2 * n + sigma2)"
        value = f"{weight} * mean + (1 - {weight}) * g"
    else:
        value = f"(n * mean + {smoothing} * g) / (n + {smoothing})"
    return f"""
{name}_c AS (
  SELECT neighborhood, count(*) AS n, avg(showed_up) AS mean, var_pop(showed_up) AS sigma2
  FROM {source} WHERE neighborhood IS NOT NULL GROUP BY neighborhood
),
{name}_g AS (SELECT avg(showed_up) AS g, var_pop(showed_up) AS tau2 FROM {source}),
{name} AS (SELECT neighborhood, n, mean, {value} AS encoding FROM {name}_c, {name}_g)
"""


OUT_OF_FOLD = """
folded AS (SELECT *, fold_h % 3 AS fold FROM gaps_train),
others AS (
  SELECT a.appointment_id,
         (SELECT count(*) FROM folded x WHERE x.fold <> a.fold) AS rows_out,
         (SELECT avg(showed_up) FROM folded x WHERE x.fold <> a.fold) AS g,
         (SELECT var_pop(showed_up) FROM folded x WHERE x.fold <> a.fold) AS tau2
  FROM folded a
),
pairs AS (SELECT DISTINCT neighborhood, fold FROM folded WHERE neighborhood IS NOT NULL),
outside AS (
  SELECT p.neighborhood, p.fold, count(x.appointment_id) AS n, avg(x.showed_up) AS mean,
         var_pop(x.showed_up) AS sigma2
  FROM pairs p LEFT JOIN folded x ON x.neighborhood = p.neighborhood AND x.fold <> p.fold
  GROUP BY p.neighborhood, p.fold
)
"""

# --- linear scores ---------------------------------------------------------------------------------------

SCORES = """
margins AS (
  SELECT *, 0.8::DOUBLE + age * -0.004::DOUBLE + date_diff * -0.03::DOUBLE + sms_received * 0.5::DOUBLE
            + scholarship * -0.3::DOUBLE + hypertension * 0.1::DOUBLE AS margin
  FROM labelled WHERE age IS NOT NULL
),
scores AS (
  SELECT *, 1 / (1 + exp(-margin)) AS probability,
         CAST(1 / (1 + exp(-margin)) > 0.5 AS DOUBLE) AS prediction
  FROM margins
)
"""
CLASSES = """
classes AS (
  SELECT c.class,
         CAST((SELECT count(*) FROM scores WHERE showed_up = c.class) AS BIGINT) AS support,
         CAST((SELECT count(*) FROM scores WHERE prediction = c.class) AS BIGINT) AS predicted,
         CAST((SELECT count(*) FROM scores WHERE showed_up = c.class AND prediction = c.class) AS BIGINT) AS hits
  FROM (SELECT DISTINCT showed_up AS class FROM scores UNION SELECT DISTINCT prediction FROM scores) c
),
ratios AS (
  SELECT *, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END AS p,
         CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0 END AS r
  FROM classes
),
per_class AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM ratios)
"""
RANKED = """
ranked AS (
  SELECT 80 * sms_received - 3 * date_diff - age AS score, sum(showed_up) AS p, sum(1 - showed_up) AS n
  FROM labelled WHERE age IS NOT NULL GROUP BY 1
),
below AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
          FROM ranked)
"""

INDEXED = """
ranks AS (
  SELECT gender, CAST(row_number() OVER (ORDER BY count(*) DESC, gender) - 1 AS DOUBLE) AS gender_index
  FROM {source} WHERE gender IS NOT NULL GROUP BY gender
)
"""


def one_hot(names: list[str]) -> str:
    return ", ".join(f"CAST(gender_index = {i} AS DOUBLE) AS {name}" for i, name in enumerate(names))


def minmax(columns: list[str]) -> str:
    return ", ".join(
        rounded(f"(r.{c} - m.{c}_min) / (m.{c}_max - m.{c}_min)", f"{c}_scaled") for c in columns
    )


# --- learners with a closed form -------------------------------------------------------------------------

FLAGS = ["scholarship", "hypertension", "diabetes", "alcoholism", "handicap", "sms_received"]
WEIGHTED = "weighted AS (SELECT *, CASE WHEN showed_up = 1 THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END AS w FROM train)"
#: weight and weighted positives on each side of each flag; impurity is what Gini and variance have in common
SPLITS = (
    "sides AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS place, '{c}' AS flag, {c} AS side, sum(w) AS w, sum(w * showed_up) AS pos FROM weighted GROUP BY {c}"
        for i, c in enumerate(FLAGS)
    )
    + """),
best AS (SELECT flag FROM sides GROUP BY flag, place ORDER BY sum(pos * (w - pos) / w), place LIMIT 1),
leaves AS (SELECT side, pos / w AS share FROM sides JOIN best USING (flag)),
placed AS (
  SELECT t.*, l.share FROM labelled t, best b JOIN leaves l ON l.side = CASE b.flag """
    + " ".join(f"WHEN '{c}' THEN t.{c}" for c in FLAGS)
    + """ END
  WHERE t.split = 'test'
)"""
)


def scored_rows(probability: str) -> str:
    value = f"floor(({probability}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"
    return f"SELECT appointment_id, showed_up, {value} AS probability, CAST(share > 0.5 AS DOUBLE) AS prediction FROM placed"


FOLD_AREAS = """
fold_scores AS (
  SELECT fold_h % 3 AS fold, date_diff, sum(showed_up) AS p, sum(1 - showed_up) AS n FROM train GROUP BY ALL
),
fold_below AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY fold ORDER BY date_diff DESC
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM fold_scores
),
areas AS (SELECT fold, sum(p * (b + n / 2)) / (sum(p) * sum(n)) AS area FROM fold_below GROUP BY fold)
"""

BOARD = """
inputs AS (
  SELECT showed_up AS y, unnest(['fixed', 'inverted', 'one input']) AS model,
         unnest([margin, -margin, 15.5 - date_diff]) AS score
  FROM margins
),
per_score AS (
  SELECT model, score, sum(y) AS p, sum(1 - y) AS n FROM inputs GROUP BY ALL
),
lower_scores AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM per_score
),
area AS (SELECT model, sum(p * (b + n / 2)) / (sum(p) * sum(n)) AS auc FROM lower_scores GROUP BY model),
cells AS (
  SELECT model, count(*)::DOUBLE AS total,
         count_if(y = 1 AND score > 0) AS tp, count_if(y = 0 AND score > 0) AS fp,
         count_if(y = 1 AND NOT score > 0) AS fn, count_if(y = 0 AND NOT score > 0) AS tn
  FROM inputs GROUP BY model
),
shares AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0,
         coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
         (tp + fn) / total AS s1, (tn + fp) / total AS s0
  FROM cells
),
values_of AS (
  SELECT model, unnest(['accuracy', 'f1', 'weighted_precision', 'weighted_recall', 'recall_negative', 'auc']) AS metric,
         unnest([(tp + tn) / total,
                 s1 * coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) + s0 * coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0),
                 s1 * p1 + s0 * p0, s1 * r1 + s0 * r0, r0, auc]) AS value
  FROM shares JOIN area USING (model)
),
board AS (SELECT model, CAST(rank() OVER (ORDER BY auc DESC, model) AS BIGINT) AS rank FROM area)
"""

NULLED = """
fold_rows AS (
  SELECT f.fold, date_diff AS x, showed_up AS y, CASE WHEN showed_up = 1 THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END AS w
  FROM train, (VALUES (0), (1), (2)) f(fold) WHERE fold_h % 3 <> f.fold
),
fold_means AS (
  SELECT fold, sum(w) AS sw, sum(w * w) AS sww, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM fold_rows GROUP BY fold
),
fold_limits AS (
  SELECT fold, abs(sum(w * (y - my) * (x - mx))) / any_value(sw) / sqrt(sum(w * (x - mx) * (x - mx)) / any_value(sw - sww / sw)) AS most
  FROM fold_rows JOIN fold_means USING (fold) GROUP BY fold
)
"""


def logistic_points() -> str:
    """The full logistic grid as rows ``(params, corner)``: the strength of the part of the penalty that can remove an input."""
    rows = []
    for mixing in (1.0, 0.0, 0.5):
        for strength in np.logspace(-4, 4, 20).tolist():
            rows += [({"elasticNetParam": mixing, "maxIter": n, "regParam": strength}, mixing * strength) for n in (100, 1000, 2500, 5000)]
    rows += [({"maxIter": n, "regParam": 0.0}, 0.0) for n in (100, 1000, 2500, 5000)]
    return ", ".join(f"('{json.dumps(params, sort_keys=True)}', {corner!r}::DOUBLE)" for params, corner in rows)


def key_hashed(value: str) -> str:
    return f"(({value}) % 2147483647 * 1103515245 + 12345) % 2147483647"


def drawn(tree: int) -> str:
    """Poisson draw of a row for a tree."""
    mixed = key_hashed(f"xor({key_hashed('appointment_id')}, {(tree + 1) * 40503})")
    hashed = key_hashed(f"xor(({mixed}) >> 9, {mixed})")
    steps = [round(sum(math.exp(-1) / math.factorial(k) for k in range(count + 1)) * 2147483647) for count in range(12)]
    cases = " ".join(f"WHEN {hashed} < {step} THEN {count}" for count, step in enumerate(steps))
    return f"CAST(CASE {cases} ELSE 12 END AS INTEGER) AS tree_{tree}"


def bin_edges(column: str) -> str:
    return (
        f"{column}_n AS (SELECT {column} AS v, count(*) AS n FROM valid WHERE split = 'train' GROUP BY v), "
        f"{column}_below AS (SELECT v, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, "
        f"sum(n) OVER () AS rows FROM {column}_n), "
        f"{column}_edges AS (SELECT v FROM {column}_below QUALIFY b > 0 AND floor(b * 32 / rows) > lag(floor(b * 32 / rows)) OVER (ORDER BY v))"
    )


ORACLES: dict[str, str] = {
    "scan_csv_bad_rows": with_tables(
        "SELECT CASE WHEN appointment_id % 50 <> 1 THEN CAST(patient_id AS DOUBLE) END AS patient_id, appointment_id, "
        "CASE WHEN appointment_id % 50 NOT IN (2, 5) THEN age END AS age, CAST(scheduled_day AS VARCHAR) AS scheduled_day, "
        "CASE WHEN appointment_id % 50 <> 3 THEN showed_up END AS showed_up, "
        "CAST(appointment_id % 50 IN (1, 2, 3) AS INTEGER) AS is_bad FROM appointments"
    ),
    "map_lookup_wide": with_tables(
        "SELECT appointment_id, appointment_id % 9000 AS code_key, "
        "CASE WHEN appointment_id % 9000 < 7000 THEN CAST(appointment_id % 9000 * 37 % 1009 AS DOUBLE) END AS code FROM appointments"
    ),
    "string_index_wide": "WITH named AS (SELECT o_orderkey, c_name, (o_orderkey * 1103515245 + 12345) % 2147483647 % 100 < 80 AS train "
    "FROM orders JOIN customer ON o_custkey = c_custkey), "
    "ranks AS (SELECT c_name, CAST(row_number() OVER (ORDER BY count(*) DESC, c_name) - 1 AS DOUBLE) AS name_index "
    "FROM named WHERE train GROUP BY c_name) SELECT o_orderkey, c_name, name_index FROM named JOIN ranks USING (c_name)",
    "quantile_bins": with_tables(
        "SELECT appointment_id, age, date_diff, "
        "CAST((SELECT count(*) FROM age_edges e WHERE e.v <= d.age) AS DOUBLE) AS age_bin, "
        "CAST((SELECT count(*) FROM date_diff_edges e WHERE e.v <= d.date_diff) AS DOUBLE) AS date_diff_bin FROM valid d",
        "valid AS (SELECT * FROM labelled WHERE age IS NOT NULL)",
        bin_edges("age"),
        bin_edges("date_diff"),
    ),
    "roc_by_curve": with_tables(
        "SELECT curve, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, "
        + rounded("sum(p * (b + n / 2)) / nullif(sum(p) * sum(n), 0)", "auc")
        + " FROM curve_below GROUP BY curve",
        "curve_scores AS (SELECT CAST(split_part(neighborhood, '-', 1) AS INTEGER) AS curve, sms_received * 80 - date_diff * 3 - age AS score, "
        f"sum(showed_up) AS p, sum(1 - showed_up) AS n FROM labelled WHERE {VALID_BASE} GROUP BY ALL)",
        "curve_below AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY curve ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b "
        "FROM curve_scores)",
    ),
    "score_batches": with_tables(
        f"SELECT 'linear-1' AS model, CAST(appointment_id % 4 AS INTEGER) AS batch, appointment_id, {rounded('probability', 'probability')}, prediction "
        f"FROM scores UNION ALL SELECT 'linear-2', 3, appointment_id, {rounded('probability', 'probability')}, 1 - prediction FROM scores "
        "WHERE appointment_id % 4 = 3",
        SCORES,
    ),
    "bootstrap_draws": with_tables(f"SELECT appointment_id, {drawn(0)}, {drawn(1)}, {drawn(2)} FROM appointments"),
    "cv_lr_full_one_feature": with_tables(
        "SELECT params, "
        + rounded("sum(CASE WHEN corner >= most THEN 0.5 ELSE area END) / 3", "avg_metric")
        + f" FROM (VALUES {logistic_points()}) grid(params, corner), areas JOIN fold_limits USING (fold) GROUP BY params",
        FOLD_AREAS,
        NULLED,
    ),
    "scan_csv": with_tables(
        "SELECT "
        + plain([c for c in COLUMNS if c != "date_diff"])
        + ", CAST(date_diff AS BIGINT) AS date_diff FROM appointments"
    ),
    "table_roundtrip": with_tables(
        "SELECT appointment_id, split, neighborhood, date_diff, sms_received FROM split_rows"
    ),
    "rename_cast": with_tables(f"SELECT {plain(COLUMNS)} FROM appointments"),
    "drop_ids": with_tables(
        f"SELECT gender, {plain(DATES)}, neighborhood, {plain(BASE)}, showed_up AS label FROM appointments"
    ),
    "drop_sparse_rows": with_tables(
        f"SELECT appointment_id, CAST(patient_id AS DOUBLE) AS patient_id, {plain(OTHERS[1:])} FROM emptied WHERE ({NULL_FIELDS}) * 100 <= 80 * 15", EMPTIED
    ),
    "drop_sparse_columns": with_tables(
        "SELECT appointment_id, gender, age, CASE WHEN appointment_id % 2 = 0 THEN date_diff END AS half_missing "
        "FROM appointments"
    ),
    "drop_null_labels": with_tables("SELECT appointment_id, showed_up FROM labelled"),
    "skip_invalid_rows": with_tables(
        f"SELECT appointment_id, {plain(BASE)} FROM holed WHERE {VALID_BASE}",
        "holed AS (SELECT * REPLACE (CASE WHEN appointment_id % 83 = 3 THEN 'NaN'::DOUBLE ELSE age END AS age) "
        "FROM appointments)",
    ),
    "missing_report": with_tables(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing_count FROM appointments"
            for c in COLUMNS
        )
        + " ORDER BY missing_count DESC, \"column\""
    ),
    "class_balance": with_tables("SELECT showed_up, count(*) AS n FROM labelled GROUP BY showed_up"),
    "sample_rows": with_tables(
        "SELECT appointment_id, neighborhood, date_diff FROM appointments ORDER BY appointment_id LIMIT 5"
    ),
    "hash_split": with_tables("SELECT appointment_id, bucket, split FROM split_rows"),
    "split_sizes": with_tables("SELECT split, count(*) AS n FROM split_rows GROUP BY split"),
    "kfold_assign": with_tables("SELECT appointment_id, fold_h % 3 AS fold FROM hashed"),
    "date_parts": with_tables(
        "SELECT appointment_id, "
        + ", ".join(
            f"{value.format(column)} AS {prefix}_{part}"
            for prefix, column in zip(["sched", "appoi"], DATES)
            for part, (value, _) in PARTS.items()
        )
        + " FROM appointments"
    ),
    "cyclical_dates": with_tables(
        f"SELECT appointment_id, {', '.join(calendar(list(PARTS)))} FROM appointments"
    ),
    "date_diff": with_tables(
        "SELECT appointment_id, date_diff('day', scheduled_day, appointment_day) AS lead_days FROM appointments"
    ),
    "map_lookup": with_tables(
        "SELECT appointment_id, gender, CASE gender WHEN 'AUTOMOBILE' THEN 0.1::DOUBLE WHEN 'BUILDING' THEN 0.2::DOUBLE "
        "WHEN 'FURNITURE' THEN 0.3::DOUBLE WHEN 'MACHINERY' THEN 0.4::DOUBLE END AS code FROM appointments"
    ),
    "assemble": with_tables(f"SELECT appointment_id, {plain(BASE)} FROM appointments WHERE {VALID_BASE}"),
    "minmax_scale": with_tables(
        f"SELECT appointment_id, {minmax(BASE)}, 0.5::DOUBLE AS constant_scaled FROM labelled r, limits m "
        f"WHERE {VALID_BASE}",
        "limits AS (SELECT "
        + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in BASE)
        + f" FROM train WHERE {VALID_BASE})",
    ),
    "string_index": with_tables(
        "SELECT appointment_id, gender, gender_index FROM seen JOIN ranks USING (gender)",
        "seen AS (SELECT * REPLACE (CASE WHEN split = 'test' AND appointment_id % 71 = 3 THEN 'UNSEEN' ELSE gender END "
        "AS gender) FROM split_rows), seen_train AS (SELECT * FROM seen WHERE split = 'train')",
        INDEXED.format(source="seen_train"),
    ),
    "one_hot": with_tables(
        f"SELECT appointment_id, {one_hot([f'gender_vec_{i}' for i in range(4)])} "
        "FROM appointments JOIN ranks USING (gender)",
        INDEXED.format(source="appointments"),
    ),
    "target_encode_auto": with_tables(
        f"SELECT neighborhood, n, {rounded('mean', 'mean')}, {rounded('encoding', 'encoding')} FROM te",
        encoding("train", "te", "auto"),
    ),
    "target_encode_apply": with_tables(
        f"SELECT appointment_id, neighborhood, {rounded('coalesce(encoding, g)', 'neighborhood_te')} "
        "FROM gaps LEFT JOIN te USING (neighborhood), te_g",
        GAPS,
        encoding("gaps_train", "te", "auto"),
    ),
    "target_encode_m": with_tables(
        f"SELECT appointment_id, neighborhood, {rounded('coalesce(encoding, g)', 'neighborhood_te')} "
        "FROM gaps LEFT JOIN te USING (neighborhood), te_g",
        GAPS,
        encoding("gaps_train", "te", "10"),
    ),
    "target_encode_oof": with_tables(
        "SELECT f.appointment_id, f.fold, "
        + rounded(
            "CASE WHEN o.n > 0 AND g.tau2 * o.n + o.sigma2 > 0 THEN (g.tau2 * o.n * o.mean + o.sigma2 * g.g) "
            "/ (g.tau2 * o.n + o.sigma2) ELSE g.g END",
            "neighborhood_te",
        )
        + " FROM folded f JOIN others g USING (appointment_id) "
        "LEFT JOIN outside o ON f.neighborhood = o.neighborhood AND f.fold = o.fold",
        GAPS,
        OUT_OF_FOLD,
    ),
    "feature_matrix": with_tables(
        f"SELECT appointment_id, {plain(BASE)}, {', '.join(calendar(['month', 'dayofyear']))}, "
        f"{one_hot([f'gender_vec_{i}' for i in range(4)])}, "
        f"{rounded('coalesce(encoding, g)', 'neighborhood_te')} "
        f"FROM labelled JOIN ranks USING (gender) LEFT JOIN te USING (neighborhood), te_g WHERE {VALID_BASE}",
        INDEXED.format(source="train"),
        encoding("train", "te", "auto"),
    ),
    "class_weights": with_tables(
        "SELECT appointment_id, showed_up, CASE WHEN showed_up = 1 THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END AS weight_col "
        "FROM train"
    ),
    "class_weights_balanced": with_tables(
        "SELECT appointment_id, showed_up, "
        + rounded(
            "(SELECT count(*) FROM train) / (2.0::DOUBLE * count(*) OVER (PARTITION BY showed_up))", "weight_col"
        )
        + " FROM train"
    ),
    "score_linear": with_tables(
        f"SELECT appointment_id, showed_up, {rounded('margin', 'margin')}, {rounded('probability', 'probability')}, "
        "prediction FROM scores",
        SCORES,
    ),
    "confusion_matrix": with_tables(
        "SELECT showed_up AS label, prediction, count(*) AS n FROM scores GROUP BY ALL", SCORES
    ),
    "per_class_metrics": with_tables(
        f"SELECT class, support, predicted, hits, {rounded('p', 'precision')}, {rounded('r', 'recall')}, "
        f"{rounded('f', 'f1')} FROM per_class",
        SCORES,
        CLASSES,
    ),
    "weighted_metrics": with_tables(
        "SELECT CAST(sum(support) AS BIGINT) AS n, "
        + ", ".join(
            rounded(expression, name)
            for expression, name in [
                ("(SELECT avg(CAST(showed_up = prediction AS INTEGER)) FROM scores)", "accuracy"),
                ("sum(support * p) / sum(support)", "weighted_precision"),
                ("sum(support * r) / sum(support)", "weighted_recall"),
                ("sum(support * f) / sum(support)", "f1"),
                ("max(r) FILTER (WHERE class = 0)", "recall_negative"),
            ]
        )
        + " FROM per_class",
        SCORES,
        CLASSES,
    ),
    "auc": with_tables(
        "SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, "
        + rounded("sum(p * (b + n / 2)) / (sum(p) * sum(n))", "auc")
        + " FROM below",
        RANKED,
    ),
    "model_roundtrip": with_tables(
        "SELECT appointment_id, 1::BIGINT AS same_lr, 1::BIGINT AS same_rf, 1::BIGINT AS same_gbt FROM labelled "
        f"WHERE split = 'test' AND gender IS NOT NULL AND {VALID_BASE}"
    ),
    "lr_closed_form": with_tables(
        "SELECT '(intercept)' AS feature, floor(b0 * 1e5::DOUBLE + 0.5::DOUBLE) / 1e5::DOUBLE AS coefficient FROM odds "
        "UNION ALL SELECT 'sms_received', floor((b1 - b0) * 1e5::DOUBLE + 0.5::DOUBLE) / 1e5::DOUBLE FROM odds",
        WEIGHTED,
        "odds AS (SELECT "
        + ", ".join(
            f"ln(sum(w * showed_up) FILTER (WHERE sms_received = {v}) "
            f"/ sum(w * (1 - showed_up)) FILTER (WHERE sms_received = {v})) AS b{v}"
            for v in (0, 1)
        )
        + " FROM weighted)",
    ),
    "tree_stump": with_tables(scored_rows("share"), WEIGHTED, SPLITS),
    "gbt_first_tree": with_tables(scored_rows("1 / (1 + exp(-2 * (2 * share - 1)))"), WEIGHTED, SPLITS),
    "cv_one_feature": with_tables(
        "SELECT params, "
        + rounded("(SELECT sum(area) / 3 FROM areas)", "avg_metric")
        + " FROM (VALUES ('{\"regParam\": 0.01}'), ('{\"regParam\": 0.1}')) grid(params)",
        FOLD_AREAS,
    ),
    "leaderboard_fixed": with_tables(
        f"SELECT rank, model, metric, {rounded('value', 'value')} FROM values_of JOIN board USING (model)",
        SCORES,
        BOARD,
    ),
}
