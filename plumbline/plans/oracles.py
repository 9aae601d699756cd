"""Plain SQL with the same results as the registered queries, for checking them."""

from __future__ import annotations

PROBS = ", ".join(f"{i * 0.1!r}::DOUBLE" for i in range(10)) + ", 1.0::DOUBLE"

LINE_SPLIT = "l_shipdate < TIMESTAMP '1998-01-01' AS r, l_shipdate >= TIMESTAMP '1998-01-01' AS c"
LINE_SHIFT = "l_shipdate < TIMESTAMP '1998-01-01' AS r, l_quantity >= 20 AS c"
ORDER_SPLIT = "o_orderdate < TIMESTAMP '1998-01-01' AS r, o_orderdate >= TIMESTAMP '1998-01-01' AS c"
EVENT_SPLIT = "ts < TIMESTAMP '2024-01-16' AS r, ts >= TIMESTAMP '2024-01-16' AS c"
LINE_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_CATEGORICAL = ("l_returnflag", "l_linenumber")


def long_numeric(table: str, sides: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {sides}, CAST({c} AS DOUBLE) AS v FROM {table}" for c in columns
    )


def long_text(table: str, sides: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {sides}, CAST({c} AS VARCHAR) AS v FROM {table}" for c in columns
    )


# Each block reads the common table before it and is a list of common tables.
EDGES = f"""
q AS (SELECT feature, quantile_cont(v, [{PROBS}]) AS qs FROM l WHERE r GROUP BY feature),
e AS (SELECT feature, list_sort(list_distinct(qs)) AS es FROM q)
"""

BINS = """
g AS (SELECT feature, es, unnest(range(len(es) - 1)) AS bin FROM e),
gb AS (SELECT feature, CAST(bin AS INTEGER) AS bin, es[bin + 1] AS lo, es[bin + 2] AS hi,
              bin = len(es) - 2 AS is_last FROM g),
h AS (SELECT gb.feature, bin, count(*) FILTER (WHERE r) AS n_ref, count(*) FILTER (WHERE c) AS n_cur
      FROM l JOIN gb ON l.feature = gb.feature AND v >= lo AND (v < hi OR (is_last AND v = hi))
      WHERE r OR c GROUP BY gb.feature, bin)
"""

CATEGORIES = """
h AS (SELECT feature, v AS category, count(*) FILTER (WHERE r) AS n_ref, count(*) FILTER (WHERE c) AS n_cur
      FROM l WHERE v IS NOT NULL AND (r OR c) GROUP BY feature, v)
"""

PSI = """
t AS (SELECT feature, sum(n_ref) AS tr, sum(n_cur) AS tc FROM h GROUP BY feature),
p AS (SELECT h.feature, tr, tc,
             greatest(least(n_ref / nullif(tr, 0), 1.0), 1e-6) AS pe,
             greatest(least(n_cur / nullif(tc, 0), 1.0), 1e-6) AS pa
      FROM h JOIN t ON h.feature = t.feature),
psi AS (SELECT feature, CASE WHEN min(tr) > 0 AND min(tc) > 0 THEN sum((pa - pe) * ln(pa / pe)) ELSE 0.0 END AS psi
        FROM p GROUP BY feature)
"""

# The p-value is the form for samples of unequal size, which all bound samples are.
KS = """
kv AS (SELECT feature, v, count(*) FILTER (WHERE r) AS a, count(*) FILTER (WHERE c) AS b
       FROM l WHERE v IS NOT NULL AND (r OR c) GROUP BY feature, v),
kn AS (SELECT feature, CAST(sum(a) AS BIGINT) AS n_ref, CAST(sum(b) AS BIGINT) AS n_cur FROM kv GROUP BY feature),
kc AS (SELECT feature, sum(a) OVER (PARTITION BY feature ORDER BY v) AS ca,
              sum(b) OVER (PARTITION BY feature ORDER BY v) AS cb FROM kv),
ks AS (SELECT kc.feature, n_ref, n_cur, max(abs(ca / n_ref - cb / n_cur)) AS ks_statistic
       FROM kc JOIN kn ON kc.feature = kn.feature GROUP BY kc.feature, n_ref, n_cur),
km AS (SELECT *, sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) AS en,
              'stephens' AS ks_pvalue_method FROM ks),
kl AS (SELECT *, ks_statistic * (en + 0.12 + 0.11 / en) AS lam FROM km),
kp AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101),
              lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * lam * lam))))) END AS ks_pvalue FROM kl)
"""


def chi2(minimum: float = 5.0) -> str:
    """Statistic and degrees of freedom; the p-value holds for even degrees."""
    return f"""
m AS (SELECT feature, CASE WHEN n_ref < {minimum} THEN '__other__' ELSE category END AS category,
             sum(n_ref) AS n_ref, sum(n_cur) AS n_cur FROM h GROUP BY 1, 2),
mt AS (SELECT feature, sum(n_ref) AS tr, sum(n_cur) AS tc, count(*) - 1 AS dof FROM m GROUP BY feature),
mc AS (SELECT m.feature, dof, n_ref AS o1, n_cur AS o2,
              (n_ref + n_cur) * CAST(tr AS DOUBLE) / (tr + tc) AS e1,
              (n_ref + n_cur) * CAST(tc AS DOUBLE) / (tr + tc) AS e2
       FROM m JOIN mt ON m.feature = mt.feature),
my AS (SELECT feature, dof, e1, e2,
              abs(o1 - e1) - CASE WHEN dof = 1 THEN least(0.5, abs(o1 - e1)) ELSE 0 END AS d1,
              abs(o2 - e2) - CASE WHEN dof = 1 THEN least(0.5, abs(o2 - e2)) ELSE 0 END AS d2 FROM mc),
x AS (SELECT feature, CAST(dof AS INTEGER) AS chi2_dof, sum(d1 * d1 / e1 + d2 * d2 / e2) AS chi2_statistic
      FROM my GROUP BY feature, dof),
cx AS (SELECT *, least(1.0, exp(-chi2_statistic / 2) * list_sum(list_transform(range(0, chi2_dof // 2),
              lambda i: pow(chi2_statistic / 2, i) / factorial(CAST(i AS INTEGER))))) AS chi2_pvalue FROM x)
"""


BAND = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'high' END"


def numeric_psi_sql(table: str, sides: str, columns: tuple[str, ...]) -> str:
    return f"WITH l AS ({long_numeric(table, sides, columns)}), {EDGES}, {BINS}, {PSI}"


def report_tables(sides: str) -> str:
    """Common tables ``rep`` (the report) and ``sm`` (its summary) over line items."""
    numeric = long_numeric("lineitem", sides, LINE_NUMERIC)
    text = long_text("lineitem", sides, LINE_CATEGORICAL)
    return f"""
num AS (WITH l AS ({numeric}), {EDGES}, {BINS}, {PSI}, {KS}
  SELECT kp.feature, 'numeric' AS kind, coalesce(psi, 0.0) AS psi, ks_statistic, ks_pvalue,
         CASE WHEN ks_pvalue < 0.05 THEN 'significant' ELSE 'no_signal' END AS ks_interpretation
  FROM kp LEFT JOIN psi ON kp.feature = psi.feature),
cat AS (WITH l AS ({text}), {CATEGORIES}, {PSI}, {chi2()}
  SELECT cx.feature, 'categorical' AS kind, psi, chi2_statistic, chi2_pvalue, chi2_dof,
         CASE WHEN chi2_pvalue < 0.05 THEN 'significant' ELSE 'no_signal' END AS chi2_interpretation
  FROM cx JOIN psi ON cx.feature = psi.feature),
rep AS (
  SELECT feature, kind, psi, {BAND} AS psi_band, ks_statistic, ks_pvalue, ks_interpretation,
         CAST(NULL AS DOUBLE) AS chi2_statistic, CAST(NULL AS DOUBLE) AS chi2_pvalue,
         CAST(NULL AS INTEGER) AS chi2_dof, CAST(NULL AS VARCHAR) AS chi2_interpretation FROM num
  UNION ALL
  SELECT feature, kind, psi, {BAND}, NULL, NULL, NULL, chi2_statistic, chi2_pvalue, chi2_dof,
         chi2_interpretation FROM cat),
sz AS (SELECT count(*) FILTER (WHERE r) AS n_reference_rows, count(*) FILTER (WHERE c) AS n_current_rows
       FROM (SELECT {sides} FROM lineitem)),
sm AS (SELECT any_value(n_reference_rows) AS n_reference_rows, any_value(n_current_rows) AS n_current_rows,
         count(*) FILTER (WHERE kind = 'numeric') AS n_numeric_features,
         count(*) FILTER (WHERE kind = 'categorical') AS n_categorical_features,
         count(*) FILTER (WHERE psi_band = 'high') AS n_features_high_psi,
         count(*) FILTER (WHERE ks_interpretation = 'significant') AS n_numeric_ks_significant,
         count(*) FILTER (WHERE chi2_interpretation = 'significant') AS n_categorical_chi2_significant,
         avg(psi) AS mean_psi FROM rep, sz)
"""


def reasons(psi: int, ks: int, chi: int) -> str:
    return f"""concat_ws('; ',
  CASE WHEN n_features_high_psi > {psi} THEN 'high_psi count ' || n_features_high_psi || ' > {psi}' END,
  CASE WHEN n_numeric_ks_significant > {ks} THEN 'KS significant ' || n_numeric_ks_significant || ' > {ks}' END,
  CASE WHEN n_categorical_chi2_significant > {chi} THEN 'chi2 significant ' || n_categorical_chi2_significant || ' > {chi}' END)"""


def thirds(table: str, order: str, key: str, columns: str) -> str:
    return f"""SELECT {columns}, CASE WHEN rn < n // 3 THEN 'D1' WHEN rn < 2 * n // 3 THEN 'D2' ELSE 'D3' END AS "window"
FROM (SELECT *, row_number() OVER (ORDER BY {order}, {key}) - 1 AS rn, count(*) OVER () AS n FROM {table})"""


HASH_SIDE = (
    "CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 10000 < 3000 "
    "THEN 'cur' ELSE 'ref' END"
)

DOCS = "SELECT documents.* EXCLUDE (text), quality, toxic FROM documents JOIN labels ON documents.doc_id = labels.doc_id"


def ranked(source: str, group: str) -> str:
    """ROC-AUC and average precision per group from (grp, s, y)."""
    return f"""
src AS ({source}),
v AS (SELECT {group} AS grp, s, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM src GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY grp ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY grp ORDER BY s DESC) AS fp FROM v),
rk AS (SELECT grp, sum(CAST(neg AS DOUBLE) * (tp - pos + pos / 2)) / nullif(sum(pos) * CAST(sum(neg) AS DOUBLE), 0) AS roc_auc,
              sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / nullif(sum(pos), 0) AS pr_auc FROM cum GROUP BY grp)
"""


REPLAY = """
runs AS (SELECT *, coalesce(value, 0.0) AS m,
  max(coalesce(value, 0.0)) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS champion_before FROM events),
rep AS (SELECT *, champion_before IS NULL OR m >= champion_before AS promoted,
  CASE WHEN champion_before IS NULL THEN 'no_existing_champion'
       WHEN m >= champion_before THEN 'f1_macro_improved_or_equal' ELSE 'f1_macro_below_champion' END AS reason FROM runs)
"""

STAGES = """
st AS (SELECT event_id, ts, user_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'staging' WHEN event_type = 'purchase' THEN 'production'
       WHEN event_type = 'error' THEN 'archived' ELSE 'development' END AS stage,
  CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset FROM events)
"""


def profile_row(table: str, column: str) -> str:
    c = f"CAST({column} AS DOUBLE)"
    quantiles = ", ".join(
        f"round(quantile_cont({c}, {q}), 6) AS {n}" for n, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))
    )
    return (
        f"SELECT '{column}' AS feature, count({column}) = 0 AS empty, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, {quantiles} FROM {table}"
    )


def top_values(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS feature, u AS n_unique, value, n, position FROM (
  SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS position, count(*) OVER () AS u
  FROM (SELECT {column} AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)) WHERE position <= 15"""


FILLED = """sha256(concat(
  coalesce('=' || length(CAST(o_custkey AS VARCHAR)) || ':' || CAST(o_custkey AS VARCHAR), '~'),
  coalesce('=' || length(CAST(o_orderkey AS VARCHAR)) || ':' || CAST(o_orderkey AS VARCHAR), '~'),
  coalesce('=' || length(o_orderpriority) || ':' || o_orderpriority, '~')))"""
CHUNK_SUMS = ", ".join(
    f"CAST(sum(CAST('0x' || substr(d, {i * 13 + 1}, 13) AS BIGINT)) AS VARCHAR)" for i in range(5)
)

TEXTS = "t AS (SELECT conv_id, turn, role, sha256(text) AS content_hash FROM conversations)"


def first_copies(source: str, order: str, where: str = "TRUE") -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY {order}) AS copy "
        f"FROM {source} WHERE {where}) WHERE copy = 1"
    )



def _batch_check(k: int) -> str:
    """The events of one slice against the first half of the month."""
    sides = f"ts < TIMESTAMP '2024-01-16' AS r, event_id % 5 = {k} AS c"
    return f"""WITH l AS (SELECT 'value' AS feature, {sides}, value AS v FROM events),
{EDGES}, {BINS}, {PSI}, np AS (SELECT psi FROM psi),
cp AS (WITH l AS (SELECT 'event_type' AS feature, {sides}, event_type AS v FROM events), {CATEGORIES}, {PSI}
  SELECT psi FROM psi),
a AS (SELECT psi FROM np UNION ALL SELECT psi FROM cp)
SELECT CAST({k} AS BIGINT) AS batch_id, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-16') AS n_reference_rows,
  (SELECT count(*) FROM events WHERE event_id % 5 = {k}) AS n_current_rows, count(*) FILTER (WHERE psi >= 0.25) AS n_features_high_psi,
  round(avg(psi), 6) AS mean_psi, count(*) FILTER (WHERE psi >= 0.25) > 0 AS policy_triggered FROM a"""


ORACLES = {
    "clean_markers": """SELECT * FROM (SELECT o_orderkey, o_orderstatus,
  nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders)
WHERE o_orderkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL""",
    "numeric_coercion": """SELECT 'orders' AS source, o_orderkey AS key,
  TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS value FROM orders
UNION ALL SELECT 'part', p_partkey, TRY_CAST(p_name AS DOUBLE) FROM part""",
    "feature_contract": "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linenumber FROM lineitem",
    "slice_shifted": """SELECT l_orderkey, l_quantity, CAST(contains(l_returnflag, 'R') AS INTEGER) AS label,
  l_linenumber AS class_label FROM lineitem WHERE l_quantity >= 20""",
    "hash_split": f"SELECT o_orderkey, {HASH_SIDE} AS side FROM orders",
    "split_semi_join": f"""SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE {HASH_SIDE} = 'ref')""",
    "stratified_split": f"""SELECT doc_id, quality, rn <= ceil(0.2 * n) AS is_holdout FROM (
  SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality
    ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|42'), 1, 13) AS BIGINT), doc_id) AS rn FROM ({DOCS}))""",
    "labeled_split": f"""SELECT doc_id, n_chars, quality,
  CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 10000 < 3000
       THEN 'cur' ELSE 'ref' END AS side FROM ({DOCS})""",
    "incoming_batch": f"""WITH s AS (SELECT *, {HASH_SIDE} = 'ref' AS r, o_orderdate >= TIMESTAMP '1998-01-01' AS c FROM orders),
l AS ({long_text('s', 'r, c', ('o_orderstatus', 'o_orderpriority'))}), {CATEGORIES}, {PSI}
SELECT feature, round(psi, 6) AS psi FROM psi""",
    "temporal_thirds": thirds("events", "ts", "event_id", "event_id"),
    "temporal_thirds_tied": thirds("orders", "o_orderdate", "o_orderkey", "o_orderkey"),
    "window_pair_psi": f"""WITH w AS ({thirds('events', 'ts', 'event_id', '*')}),
pr AS (SELECT unnest(['D1', 'D2', 'D1']) AS a, unnest(['D2', 'D3', 'D3']) AS b),
l AS (SELECT a || '/' || b AS feature, "window" = a AS r, "window" = b AS c, event_type AS v FROM w, pr),
{CATEGORIES}, {PSI}
SELECT 'event_type' AS feature, feature AS pair, round(psi, 6) AS psi FROM psi""",
    "window_profile": f"""WITH w AS ({thirds('events', 'ts', 'event_id', '*')})
SELECT "window", count(*) AS n_rows, CAST(sum(CAST(event_type = 'error' AS INTEGER)) AS BIGINT) AS n_positive,
  round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS positive_rate,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS time_min, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS time_max
FROM w GROUP BY "window" """,
    "sketched_ranks": """SELECT feature, CAST(unnest(range(11)) AS BIGINT) AS decile, n, TRUE AS within_error
FROM (SELECT 'value' AS feature, count(value) AS n FROM events UNION ALL SELECT 'user_id', count(user_id) FROM events)""",
    "sketched_numbers": f"""WITH l AS (SELECT * FROM ({long_numeric('events', 'ts', ('value', 'user_id'))})
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21')
SELECT feature, count(DISTINCT CAST(ts AS DATE)) AS n_parts, count(*) AS n_rows, count(v) AS n, round(avg(v), 6) AS mean,
  round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM l GROUP BY feature""",
    "sketched_categories": f"""WITH l AS (SELECT * FROM ({long_text('events', 'ts', ('event_type', 'user_id'))})
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'),
c AS (SELECT feature, v AS value, count(*) AS n, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, v) AS position
  FROM l WHERE v IS NOT NULL GROUP BY feature, v)
SELECT feature, value, n, position, TRUE AS unique_within_error FROM c WHERE position <= 15""",
    "quantile_edges": f"""WITH l AS ({long_numeric('lineitem', LINE_SPLIT, LINE_NUMERIC)}), {EDGES}
SELECT feature, CAST(i AS BIGINT) AS edge_no, round(es[i + 1], 6) AS edge
FROM (SELECT feature, es, unnest(range(len(es))) AS i FROM e)""",
    "fixed_edge_histogram": f"""WITH l AS ({long_numeric('lineitem', LINE_SHIFT, LINE_NUMERIC)}), {EDGES}, {BINS}
SELECT feature, bin, n_ref, n_cur FROM h""",
    "psi_numeric": f"""{numeric_psi_sql('lineitem', LINE_SHIFT, LINE_NUMERIC)}
SELECT feature, round(psi, 6) AS psi, {BAND} AS psi_band FROM psi""",
    "psi_numeric_out_of_range": f"""WITH l AS (SELECT 'o_totalprice' AS feature, o_totalprice < 250000 AS r,
  o_totalprice >= 250000 AS c, o_totalprice AS v FROM orders), {EDGES}, {BINS}, {PSI},
o AS (SELECT feature, CAST(len(list_filter(es[2:len(es) - 1], lambda x: x <= v)) AS INTEGER) AS bin, r, c
      FROM l JOIN e USING (feature)),
ho AS (SELECT feature, bin, count(*) FILTER (WHERE r) AS n_ref, count(*) FILTER (WHERE c) AS n_cur FROM o GROUP BY 1, 2),
tt AS (SELECT sum(n_ref) AS tr, sum(n_cur) AS tc FROM ho),
po AS (SELECT greatest(n_ref / tr, 1e-6) AS pe, greatest(n_cur / tc, 1e-6) AS pa FROM ho, tt)
SELECT feature, round(psi, 6) AS psi, 'closed' AS mode FROM psi
UNION ALL SELECT 'o_totalprice', round(sum((pa - pe) * ln(pa / pe)), 6), 'open' FROM po""",
    "psi_min_rows": f"""{numeric_psi_sql('lineitem', LINE_SPLIT, ('l_quantity', 'l_discount'))}
SELECT feature, round(psi, 6) AS psi FROM psi
UNION ALL SELECT 'constant', 0.0
UNION ALL SELECT 'n_nationkey', CASE WHEN count(*) FILTER (WHERE n_regionkey = 0) >= 20 THEN 0.0 END FROM nation""",
    "psi_categorical": f"""WITH l AS ({long_text('orders', ORDER_SPLIT, ('o_orderstatus', 'o_orderpriority'))}
  UNION ALL {long_text('events', EVENT_SPLIT, ('event_type',))}
  UNION ALL {long_text('lineitem', LINE_SHIFT, ('l_linenumber', 'l_returnflag'))}), {CATEGORIES}, {PSI}
SELECT feature, round(psi, 6) AS psi FROM psi""",
    "ks_statistic": f"""WITH l AS ({long_numeric('lineitem', LINE_SHIFT, LINE_NUMERIC)}
  UNION ALL {long_numeric('events', EVENT_SPLIT, ('value',))}), {KS}
SELECT feature, n_ref, n_cur, round(ks_statistic, 6) AS ks_statistic FROM ks""",
    "ks_pvalue": f"""WITH l AS ({long_numeric('lineitem', LINE_SPLIT, LINE_NUMERIC)}), {KS}
SELECT feature, round(ks_statistic, 6) AS ks_statistic, round(ks_pvalue, 6) AS ks_pvalue, ks_pvalue_method,
  CASE WHEN ks_pvalue < 0.05 THEN 'significant' ELSE 'no_signal' END AS ks_interpretation FROM kp""",
    "contingency": f"""WITH l AS ({long_text('documents', 'n_chars < 1000 AS r, n_chars >= 1000 AS c', ('source', 'lang'))}),
{CATEGORIES} SELECT feature, category, n_ref, n_cur FROM h""",
    "rare_merge": f"""WITH l AS ({long_text('documents', 'n_chars < 1000 AS r, n_chars >= 1000 AS c', ('source', 'lang'))}),
{CATEGORIES} SELECT feature, CASE WHEN n_ref < 40 THEN '__other__' ELSE category END AS category,
  CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_cur) AS BIGINT) AS n_cur FROM h GROUP BY 1, 2""",
    "chi2_homogeneity": f"""WITH l AS ({long_text('orders', ORDER_SPLIT, ('o_orderstatus', 'o_orderpriority'))}),
{CATEGORIES}, {chi2()} SELECT feature, round(chi2_statistic, 6) AS chi2_statistic, chi2_dof,
  round(chi2_pvalue, 6) AS chi2_pvalue FROM cx""",
    "chi2_yates": f"""WITH l AS ({long_text('lineitem', LINE_SPLIT, ('l_linestatus',))}), {CATEGORIES}, {chi2()}
SELECT feature, round(chi2_statistic, 6) AS chi2_statistic, chi2_dof FROM x""",
    "drift_report": f"""WITH {report_tables(LINE_SHIFT)}
SELECT feature, kind, round(psi, 6) AS psi, psi_band, round(ks_statistic, 6) AS ks_statistic,
  round(ks_pvalue, 6) AS ks_pvalue, ks_interpretation, round(chi2_statistic, 6) AS chi2_statistic,
  round(chi2_pvalue, 6) AS chi2_pvalue, chi2_dof, chi2_interpretation FROM rep""",
    "drift_summary": f"""WITH {report_tables(LINE_SHIFT)}
SELECT * EXCLUDE (mean_psi), round(mean_psi, 6) AS mean_psi FROM sm""",
    "drift_policy": f"""WITH {report_tables(LINE_SPLIT)}
SELECT n_features_high_psi, n_numeric_ks_significant, n_categorical_chi2_significant,
  {reasons(0, 0, 0)} AS reasons, {reasons(0, 0, 0)} <> '' AS policy_triggered FROM sm""",
    "alert_payload": f"""WITH a AS (WITH {report_tables(LINE_SPLIT)} SELECT 'by_date' AS scenario, * FROM sm),
b AS (WITH {report_tables(LINE_SHIFT)} SELECT 'shifted' AS scenario, * FROM sm),
s AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT 'drift_policy_triggered' AS event, scenario, {reasons(0, 2, 3)} AS reasons,
  '{{"n_reference_rows":' || n_reference_rows || ',"n_current_rows":' || n_current_rows ||
  ',"n_features_high_psi":' || n_features_high_psi || ',"n_numeric_ks_significant":' || n_numeric_ks_significant || '}}' AS summary
FROM s WHERE {reasons(0, 2, 3)} <> ''""",
    "drift_ranking": f"""WITH l AS ({long_numeric('lineitem', LINE_SHIFT, LINE_NUMERIC)}), {EDGES}, {BINS}, {PSI}, {KS}
SELECT kp.feature, round(psi, 6) AS psi, round(ks_statistic, 6) AS ks_statistic, round(ks_pvalue, 6) AS ks_pvalue,
  ks_pvalue < 0.05 AS ks_significant, row_number() OVER (ORDER BY psi DESC, kp.feature) AS psi_rank
FROM kp JOIN psi ON kp.feature = psi.feature""",
    "drift_ranking_summary": f"""WITH l AS ({long_numeric('lineitem', LINE_SHIFT, LINE_NUMERIC)}), {EDGES}, {BINS}, {PSI}, {KS}
SELECT count(*) FILTER (WHERE psi > 0.2) AS n_features_high_psi,
  count(*) FILTER (WHERE ks_pvalue < 0.05) AS n_features_ks_significant, round(avg(psi), 6) AS mean_psi
FROM kp JOIN psi ON kp.feature = psi.feature""",
    "profile_numeric": " UNION ALL ".join(
        profile_row(t, c)
        for t, c in (
            ("customer", "c_acctbal"),
            ("part", "p_retailprice"),
            ("part", "p_size"),
            ("lineitem", "l_extendedprice"),
            ("lineitem", "l_quantity"),
        )
    ),
    "profile_categorical": " UNION ALL ".join(
        top_values(t, c)
        for t, c in (
            ("customer", "c_mktsegment"),
            ("customer", "c_name"),
            ("part", "p_brand"),
            ("part", "p_type"),
            ("documents", "source"),
            ("documents", "lang"),
        )
    ),
    "table_snapshot": """WITH n AS (SELECT count(*) AS n FROM customer)
SELECT feature, kind, n AS n_rows, round(mean, 6) AS mean, round(q95, 6) AS q95, n_unique, n_building FROM n, (
  SELECT 'c_custkey' AS feature, 'numeric' AS kind, avg(c_custkey) AS mean, quantile_cont(CAST(c_custkey AS DOUBLE), 0.95) AS q95,
    CAST(NULL AS BIGINT) AS n_unique, CAST(NULL AS BIGINT) AS n_building FROM customer
  UNION ALL SELECT 'c_nationkey', 'numeric', avg(c_nationkey), quantile_cont(CAST(c_nationkey AS DOUBLE), 0.95), NULL, NULL FROM customer
  UNION ALL SELECT 'c_acctbal', 'numeric', avg(c_acctbal), quantile_cont(c_acctbal, 0.95), NULL, NULL FROM customer
  UNION ALL SELECT 'c_name', 'categorical', NULL, NULL, count(DISTINCT c_name), NULL FROM customer
  UNION ALL SELECT 'c_mktsegment', 'categorical', NULL, NULL, count(DISTINCT c_mktsegment),
    nullif(count(*) FILTER (WHERE c_mktsegment = 'BUILDING'), 0) FROM customer)""",
    "training_merge": """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag, l_tax
FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'
UNION SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag, NULL FROM lineitem WHERE l_quantity >= 20""",
    "balanced_weights": f"""SELECT doc_id, quality, round(n / (k * c), 6) AS weight FROM (
  SELECT doc_id, quality, count(*) OVER () AS n, count(*) OVER (PARTITION BY quality) AS c,
    (SELECT count(DISTINCT quality) FROM ({DOCS})) AS k FROM ({DOCS}))""",
    "macro_metrics": f"""WITH d AS (SELECT quality AS y, CAST(n_chars >= 1000 AS INTEGER) AS p FROM ({DOCS})),
k AS (SELECT y AS cls FROM d UNION SELECT p FROM d),
m AS (SELECT cls, count(*) FILTER (WHERE y = cls AND p = cls) AS hits, count(*) FILTER (WHERE y = cls) AS actual,
        count(*) FILTER (WHERE p = cls) AS predicted FROM d, k GROUP BY cls),
f AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0.0) AS pr, coalesce(hits / nullif(actual, 0), 0.0) AS re FROM m)
SELECT round(sum(hits) / sum(actual), 6) AS accuracy, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0)), 6) AS f1_macro,
  round(avg(pr), 6) AS precision_macro, round(avg(re), 6) AS recall_macro, CAST(sum(actual) AS BIGINT) AS n_test FROM f""",
    "binary_metrics": f"""WITH c AS (SELECT lang, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp,
  count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn
  FROM (SELECT lang, n_chars >= 1000 AS p, quality = 1 AS y FROM ({DOCS})) GROUP BY lang)
SELECT lang, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
  round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""",
    "roc_auc": f"""WITH {ranked(f"SELECT lang, CAST(n_chars AS DOUBLE) AS s, quality = 1 AS y FROM ({DOCS})", "lang")}
SELECT grp AS lang, round(roc_auc, 6) AS roc_auc FROM rk""",
    "average_precision": f"""WITH {ranked("SELECT l_linestatus, l_extendedprice AS s, contains(l_returnflag, 'R') AS y FROM lineitem", "l_linestatus")}
SELECT grp AS l_linestatus, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM rk""",
    "auc_delta": f"""WITH {ranked(f'''SELECT 'base' AS g, CAST(n_chars AS DOUBLE) AS s, quality = 1 AS y FROM ({DOCS})
  UNION ALL SELECT 'adapted', -CAST(n_chars AS DOUBLE), quality = 1 FROM ({DOCS})''', "g")}
SELECT round(max(pr_auc) FILTER (WHERE grp = 'base'), 6) AS base, round(max(pr_auc) FILTER (WHERE grp = 'adapted'), 6) AS adapted,
  round(max(pr_auc) FILTER (WHERE grp = 'adapted') - max(pr_auc) FILTER (WHERE grp = 'base'), 6) AS delta FROM rk""",
    "champion_replay": f"WITH {REPLAY} SELECT event_id, champion_before, promoted, reason FROM rep",
    "champion_replay_margin": """WITH RECURSIVE o AS (SELECT event_id, user_id, coalesce(value, 0.0) AS m,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT event_id, user_id, rn, CAST(NULL AS DOUBLE) AS champion_before, m AS champion, TRUE AS promoted FROM o WHERE rn = 1
  UNION ALL SELECT o.event_id, o.user_id, o.rn, w.champion, CASE WHEN o.m >= w.champion + 25.0 THEN o.m ELSE w.champion END,
    o.m >= w.champion + 25.0 FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT event_id, champion_before, promoted, CASE WHEN champion_before IS NULL THEN 'no_existing_champion'
  WHEN promoted THEN 'f1_macro_improved_or_equal' ELSE 'f1_macro_below_champion' END AS reason FROM w""",
    "numbers_against_the_clock": """SELECT event_id, row_number() OVER (
  ORDER BY ts, md5(CAST(event_id AS VARCHAR))) AS no FROM events""",
    "numbers_by_instant": """SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS no FROM events""",
    "neighbours_by_text": """WITH n AS (SELECT o_orderkey, o_orderstatus, printf('model-%09d', o_orderkey * 7919 % 100003) AS name FROM orders)
SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after
FROM n WINDOW w AS (PARTITION BY o_orderstatus ORDER BY name, o_orderkey)""",
    "running_max_with_nulls": """SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY nullif(o_orderstatus, 'O')
  ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END NULLS FIRST, o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM orders""",
    "windows_with_nulls": """WITH o AS (SELECT o_orderkey, row_number() OVER (
    ORDER BY CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END NULLS FIRST, o_orderkey) - 1 AS place,
  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, 'D' || (1 + len(list_filter(range(1, 7), lambda i: place >= i * n // 7))) AS "window" FROM o""",
    "stage_moves_by_text": f"""WITH {STAGES}, m AS (SELECT *, coalesce(lag(stage) OVER (
  PARTITION BY user_id ORDER BY ts, event_id), 'development') AS from_stage FROM st),
a(from_stage, allowed) AS (VALUES ('development', 'staging, production'), ('staging', 'production, archived'), ('production', 'archived'), ('archived', 'none'))
SELECT event_id, m.from_stage, stage FROM m JOIN a ON m.from_stage = a.from_stage
WHERE NOT list_contains(string_split(allowed, ', '), stage)""",
    "replay_in_cells": """WITH RECURSIVE o AS (SELECT event_id, coalesce(value, 0.0) AS m,
  row_number() OVER (ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT *, max(m) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o),
records AS (SELECT rn, m, row_number() OVER (ORDER BY rn) AS k FROM r WHERE top IS NULL OR m > top),
w AS (SELECT k, rn, m AS champion, TRUE AS promoted FROM records WHERE k = 1
  UNION ALL SELECT records.k, records.rn, CASE WHEN records.m >= w.champion + 25.0 THEN records.m ELSE w.champion END,
    records.m >= w.champion + 25.0 FROM w JOIN records ON records.k = w.k + 1),
p AS (SELECT rn, champion FROM w WHERE promoted),
f AS (SELECT o.event_id, o.m, (SELECT max(champion) FROM p WHERE p.rn < o.rn) AS champion_before FROM o)
SELECT event_id, champion_before, champion_before IS NULL OR m >= champion_before + 25.0 AS promoted,
  CASE WHEN champion_before IS NULL THEN 'no_existing_champion'
  WHEN m >= champion_before + 25.0 THEN 'f1_macro_improved_or_equal' ELSE 'f1_macro_below_champion' END AS reason FROM f""",
    "stratified_in_cells": """WITH l AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN ''
    WHEN o_orderpriority NOT LIKE '2%' THEN o_orderpriority END AS label FROM orders)
SELECT o_orderkey, label, rn <= ceil(0.1 * n) AS is_holdout FROM (
  SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label
    ORDER BY CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 13) AS BIGINT), o_orderkey) AS rn FROM l)""",
    "stage_requests": f"""WITH {STAGES}, b AS (SELECT user_id, stage FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM st WHERE ts < TIMESTAMP '2024-01-16') WHERE rn = 1),
q AS (SELECT user_id, event_id, stage FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM st WHERE ts >= TIMESTAMP '2024-01-16') WHERE rn = 1),
a(from_stage, allowed) AS (VALUES ('development', 'staging, production'), ('staging', 'production, archived'), ('production', 'archived'), ('archived', 'none'))
SELECT q.user_id, event_id, a.from_stage, q.stage, list_contains(string_split(allowed, ', '), q.stage) AS is_legal, allowed
FROM q LEFT JOIN b ON q.user_id = b.user_id JOIN a ON a.from_stage = coalesce(b.stage, 'development')""",
    "table_fingerprint": f"""SELECT o_orderstatus, count(*) AS row_count, sha256(concat_ws('|',
  'o_custkey,o_orderkey,o_orderpriority', CAST(count(*) AS VARCHAR), {CHUNK_SUMS})) AS content_hash
FROM (SELECT o_orderstatus, {FILLED} AS d FROM orders) GROUP BY o_orderstatus""",
    "register_datasets": f"""WITH {TEXTS}, k AS ({first_copies('t', 'conv_id, turn', "role = 'user'")}),
f AS ({first_copies('t', 'conv_id, turn')})
SELECT content_hash, conv_id, turn, role, (SELECT count(*) FROM k) + row_number() OVER (ORDER BY conv_id, turn) AS id
FROM f WHERE content_hash NOT IN (SELECT content_hash FROM k)""",
    "register_baselines": f"""WITH d AS (SELECT doc_id, sha256(source) AS dataset_hash, sha256(text) AS content_hash FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS snapshot_id FROM ({first_copies('d', 'doc_id')})),
ds AS (SELECT dataset_hash, row_number() OVER (ORDER BY min(doc_id)) AS dataset_id FROM d GROUP BY dataset_hash)
SELECT snapshot_id, content_hash AS snapshot_hash, doc_id, dataset_id FROM s JOIN ds ON s.dataset_hash = ds.dataset_hash""",
    "experiments": f"""WITH {REPLAY} SELECT row_number() OVER (ORDER BY ts, event_id) AS id, 'retrain_' || event_type AS name,
  CAST(user_id AS VARCHAR) AS dataset, value AS f1_macro, event_type AS scenario, reason AS notes FROM rep""",
    "model_versions": f"""WITH {REPLAY} SELECT row_number() OVER (ORDER BY ts, event_id) AS id,
  row_number() OVER (ORDER BY ts, event_id) AS version_num, row_number() OVER (ORDER BY ts, event_id) AS experiment_id,
  'models/' || event_id AS artifact_path, CASE WHEN promoted THEN 'production' ELSE 'development' END AS stage FROM rep""",
    "model_versions_appended": f"""WITH {REPLAY}, k AS (SELECT count(*) AS n FROM rep WHERE event_id % 3 = 0),
r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS no FROM rep WHERE event_id % 3 <> 0)
SELECT 100 + n + no AS id, n + no AS version_num, n + no AS experiment_id, 'models/' || event_id AS artifact_path,
  CASE WHEN promoted THEN 'production' ELSE 'development' END AS stage FROM r, k""",
    "refused_rows": """WITH b AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'),
f AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT 'repeated' AS rule, 'o_orderkey' AS reference, CAST(o_orderkey AS VARCHAR) AS key, count(*) AS n
FROM b WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'taken', 'o_orderkey', CAST(o_orderkey AS VARCHAR), count(*) FROM b
WHERE o_orderkey IN (SELECT o_orderkey FROM f) GROUP BY o_orderkey
UNION ALL SELECT 'repeated', 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM b
WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'taken', 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM b
WHERE o_custkey IN (SELECT o_custkey FROM f) GROUP BY o_custkey
UNION ALL SELECT 'no_parent', 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM b
WHERE o_custkey NOT IN (SELECT c_custkey FROM c) GROUP BY o_custkey""",
    "duplicate_versions": "SELECT user_id AS version_num, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1",
    "version_numbers": "SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS version_num FROM orders",
    "lineage": """SELECT l_orderkey, l_linenumber, l_suppkey, o_orderstatus, c_mktsegment FROM lineitem
LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""",
    "lineage_orphans": """SELECT 'l_orderkey' AS reference, CAST(l_orderkey AS VARCHAR) AS missing_key, count(*) AS n FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 2
UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 2""",
    "stage_violations": f"""WITH {STAGES}, m AS (SELECT *, coalesce(lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'development') AS from_stage FROM st),
a(from_stage, allowed) AS (VALUES ('development', 'staging, production'), ('staging', 'production, archived'), ('production', 'archived'), ('archived', 'none'))
SELECT event_id, user_id, m.from_stage, stage, allowed FROM m JOIN a ON m.from_stage = a.from_stage
WHERE NOT list_contains(string_split(allowed, ', '), stage)""",
    "stage_current": f"""WITH {STAGES} SELECT user_id, event_id, stage FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM st) WHERE rn = 1""",
    "models_by_stage": f"""WITH {STAGES} SELECT user_id AS version_num, event_id FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM st) WHERE rn = 1 AND stage = 'production'""",
    "production_pointer": f"""WITH {STAGES}, p AS (SELECT *, lag(user_id) OVER (PARTITION BY dataset ORDER BY ts, event_id) AS prev
  FROM st WHERE stage = 'production'), c AS (SELECT * FROM p WHERE prev IS NULL OR prev <> user_id),
s AS (SELECT dataset, user_id AS model, ts AS since, lead(ts) OVER (PARTITION BY dataset ORDER BY ts, event_id) AS until FROM c)
SELECT dataset, model, strftime(since, '%Y-%m-%d %H:%M:%S.%f') AS since, strftime(until, '%Y-%m-%d %H:%M:%S.%f') AS until,
  until IS NULL AS is_current FROM s""",
    "recent_runs": "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 20",
    "run_stats": """SELECT count(*) AS total_runs, count(*) FILTER (WHERE event_type = 'error') AS triggered_runs,
  count(*) FILTER (WHERE event_type <> 'error') AS ok_runs,
  round(coalesce(count(*) FILTER (WHERE event_type = 'error') / nullif(count(*), 0), 0.0), 4) AS trigger_rate FROM events""",
    "overview": """WITH p AS (SELECT l_partkey AS id FROM lineitem ORDER BY l_extendedprice DESC, l_partkey DESC LIMIT 1)
SELECT (SELECT count(*) FROM events) AS n_runs, (SELECT max(event_id) FROM events) AS last_run_id,
  (SELECT event_type = 'error' FROM events ORDER BY event_id DESC LIMIT 1) AS last_run_policy_triggered,
  (SELECT count(*) FROM part) AS n_models, (SELECT max(p_partkey) + 1 FROM part) AS latest_model_version,
  (SELECT count(*) FROM orders) AS n_experiments, (SELECT max(o_orderkey) FROM orders) AS latest_experiment_id,
  (SELECT count(*) FROM documents) AS n_datasets, (SELECT count(*) FROM customer) AS n_baselines,
  (SELECT id FROM p) AS production_model_id, (SELECT id + 1 FROM p) AS production_model_version""",
    "csv_scan_roundtrip": thirds(
        "orders", "o_orderdate", "o_orderkey", "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
    ),
    "baseline_roundtrip": f"{numeric_psi_sql('lineitem', LINE_SHIFT, LINE_NUMERIC)} SELECT feature, round(psi, 6) AS psi FROM psi",
    "text_file_fingerprint": """SELECT o_orderkey // 500 AS part,
  CAST(sum(octet_length(encode(o_orderpriority)) + 1) AS BIGINT) AS length,
  sha256(string_agg(o_orderpriority || chr(10), '' ORDER BY o_orderkey)) AS content_hash FROM orders GROUP BY 1""",
    "streamed_file_fingerprint": """SELECT o_orderkey // 500 AS part,
  CAST(sum(octet_length(encode(o_orderpriority)) + 1) AS BIGINT) AS length,
  sha256(string_agg(o_orderpriority || chr(10), '' ORDER BY o_orderkey)) AS content_hash FROM orders GROUP BY 1""",
    "check_with_hook": f"""WITH {report_tables(LINE_SHIFT)} SELECT 'shifted' AS scenario, {reasons(0, 2, 3)} <> '' AS triggered,
  {reasons(0, 2, 3)} AS reasons, (SELECT count(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01') AS n_reference FROM sm""",
    "scoring_consistency": """SELECT count(*) AS n, count(*) AS n_following_probability, count(*) AS n_named,
  count(*) AS n_in_range FROM documents""",
    "retrain_flow": f"""WITH v(version_num, stage, notes, provenance_id) AS (VALUES (1, 'archived', 'no_existing_champion', 1),
  (2, 'production', 'f1_macro_improved_or_equal', 2))
SELECT CAST(version_num AS BIGINT) AS version_num, stage, notes, CAST(1 AS BIGINT) AS dataset_version_id,
  CAST(1 AS BIGINT) AS baseline_snapshot_id, CAST(provenance_id AS BIGINT) AS provenance_id,
  (SELECT count(*) FROM ({DOCS})) AS row_count FROM v""",
    "model_lookup": """SELECT l_partkey AS id, 'v' || l_partkey AS artifact FROM lineitem
ORDER BY l_extendedprice DESC, l_partkey DESC LIMIT 1""",
    "shifted_split_pair": """SELECT count(*) FILTER (WHERE side = 'ref') AS n_ref, count(*) FILTER (WHERE large) AS n_cur,
  count(*) FILTER (WHERE side = 'ref' AND large) AS n_both FROM (
  SELECT {HASH_SIDE} AS side, o_totalprice >= 200000 AS large FROM orders)""".replace("{HASH_SIDE}", HASH_SIDE),
    "check_to_ledger": f"""WITH {report_tables(LINE_SHIFT)} SELECT 'shifted' AS scenario, {reasons(0, 2, 3)} <> '' AS policy_triggered,
  {reasons(0, 2, 3)} AS reasons, n_reference_rows, n_current_rows, n_features_high_psi FROM sm""",
    "stream_window_counts": f"""WITH l AS ({long_numeric('events', EVENT_SPLIT, ('value',))}), {EDGES},
g AS (SELECT es, unnest(range(len(es) - 1)) AS bin FROM e),
gb AS (SELECT CAST(bin AS INTEGER) AS bin, es[bin + 1] AS lo, es[bin + 2] AS hi, bin = len(es) - 2 AS is_last FROM g)
SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type, bin, count(*) AS n FROM events
JOIN gb ON value >= lo AND (value < hi OR (is_last AND value = hi)) GROUP BY 1, 2, 3""",
    "stream_closed_windows": f"""WITH l AS ({long_numeric('events', EVENT_SPLIT, ('value',))}), {EDGES},
g AS (SELECT es, unnest(range(len(es) - 1)) AS bin FROM e),
gb AS (SELECT CAST(bin AS INTEGER) AS bin, es[bin + 1] AS lo, es[bin + 2] AS hi, bin = len(es) - 2 AS is_last FROM g),
binned AS (SELECT ts, event_type, bin FROM events
  JOIN gb ON value >= lo AND (value < hi OR (is_last AND value = hi)))
SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type, bin, count(*) AS n FROM binned
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM binned)
GROUP BY 1, 2, 3""",
    "stream_window_psi": f"""WITH l AS ({long_numeric('events', EVENT_SPLIT, ('value',))}), {EDGES}, {BINS},
d AS (SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type, bin, count(*) AS n FROM events
  JOIN gb ON value >= lo AND (value < hi OR (is_last AND value = hi)) GROUP BY 1, 2, 3),
k AS (SELECT window_start, event_type, sum(n) AS n FROM d GROUP BY 1, 2),
f AS (SELECT k.window_start, k.event_type, k.n, greatest(h.n_ref / (SELECT sum(n_ref) FROM h), 1e-6) AS pe,
  greatest(coalesce(d.n, 0) / k.n, 1e-6) AS pa FROM k CROSS JOIN h
  LEFT JOIN d ON d.window_start = k.window_start AND d.event_type = k.event_type AND d.bin = h.bin),
z AS (SELECT window_start, event_type, CAST(n AS BIGINT) AS n, sum((pa - pe) * ln(pa / pe)) AS psi FROM f GROUP BY 1, 2, 3)
SELECT window_start, event_type, n, round(psi, 6) AS psi, {BAND} AS psi_band FROM z""",
    "csv_malformed": """SELECT CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'malformed' ELSE 'good' END AS kind,
  o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey || ',' || o_orderpriority
    WHEN o_orderkey % 11 = 0 THEN o_orderkey || ',' || o_orderpriority || ',' || CASE WHEN o_orderkey % 13 = 0 THEN 'abc' ELSE o_orderkey || '' END || ',more'
    WHEN o_orderkey % 13 = 0 THEN o_orderkey || ',' || o_orderpriority || ',abc'
    ELSE o_orderpriority || '|' || o_orderkey || '.0' END AS held FROM orders""",
    "lr_one_feature": """WITH RECURSIVE e AS (SELECT CAST(value AS DOUBLE) AS v, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS y
  FROM events WHERE ts < TIMESTAMP '2024-01-16'),
s AS (SELECT avg(v) AS mu, stddev_samp(v) AS sd, count(*) AS n, sum(y) AS pos FROM e),
x AS (SELECT (v - mu) / sd AS x, y, n / (2.0 * CASE WHEN y = 1 THEN pos ELSE n - pos END) / n AS w, 1.0 / n AS lam FROM e, s),
step AS (SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1
  UNION ALL SELECT k + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT k, b0, b1, sum(w * (p - y)) AS g0, sum(w * (p - y) * x) + any_value(lam) * b1 AS g1, sum(w * p * (1 - p)) AS h00,
      sum(w * p * (1 - p) * x) AS h01, sum(w * p * (1 - p) * x * x) + any_value(lam) AS h11
    FROM (SELECT k, b0, b1, x, y, w, lam, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM step, x WHERE k < 25) GROUP BY k, b0, b1))
SELECT round(b1 , 4) AS coefficient, round(b0, 4) AS intercept FROM step WHERE k = 25""",
    "holdout_counts": """SELECT CAST(contains(l_returnflag, 'R') AS INTEGER) AS label, count(*) - CAST(ceil(round(0.2 * count(*), 9)) AS BIGINT) AS n_train,
  CAST(ceil(round(0.2 * count(*), 9)) AS BIGINT) AS n_test FROM lineitem GROUP BY 1""",
    "category_vocabulary": """WITH c AS (SELECT 'o_custkey' AS feature, CAST(o_custkey AS VARCHAR) AS category FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders)
SELECT feature, category, count(*) AS n, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, category) - 1 AS position
FROM c WHERE category IS NOT NULL GROUP BY feature, category""",
    "category_positions": """WITH e AS (SELECT * FROM orders WHERE o_orderdate < DATE '1995-01-01'),
c AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, CAST(o_custkey AS VARCHAR)) - 1 AS customer_no FROM e GROUP BY o_custkey),
p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS priority_no FROM e GROUP BY o_orderpriority)
SELECT o_orderkey, customer_no, priority_no FROM orders LEFT JOIN c USING (o_custkey) LEFT JOIN p USING (o_orderpriority)""",
    "stream_psi_on_close": f"""WITH l AS ({long_numeric('events', EVENT_SPLIT, ('value',))}), {EDGES}, {BINS},
b AS (SELECT ts, event_type, bin FROM events JOIN gb ON value >= lo AND (value < hi OR (is_last AND value = hi))),
d AS (SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type, bin, count(*) AS n FROM b
  WHERE date_trunc('day', ts) <= (SELECT date_trunc('day', max(ts)) - INTERVAL 2 DAY FROM b) GROUP BY 1, 2, 3),
k AS (SELECT window_start, event_type, sum(n) AS n FROM d GROUP BY 1, 2),
f AS (SELECT k.window_start, k.event_type, k.n, greatest(h.n_ref / (SELECT sum(n_ref) FROM h), 1e-6) AS pe,
  greatest(coalesce(d.n, 0) / k.n, 1e-6) AS pa FROM k CROSS JOIN h
  LEFT JOIN d ON d.window_start = k.window_start AND d.event_type = k.event_type AND d.bin = h.bin),
z AS (SELECT window_start, event_type, CAST(n AS BIGINT) AS n, sum((pa - pe) * ln(pa / pe)) AS psi FROM f GROUP BY 1, 2, 3)
SELECT window_start, event_type, n, round(psi, 6) AS psi, {BAND} AS psi_band FROM z""",
    "stream_drift": " UNION ALL ".join(f"SELECT * FROM ({_batch_check(k)})" for k in range(5)),
}
