"""The derived inputs and operators once more, as SQL fragments for the oracle."""

from __future__ import annotations

from ..schemas import BASIC, GAP_COLUMNS, IRREGULARITY
from .inputs import COMPARISONS, FAMILIES

RESULTS = """raw AS (
  SELECT 'd' || p_size AS dataset, CAST(l_orderkey % 9 AS INTEGER) AS fold, l_suppkey % 12 AS m, count(*) AS k,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, sum(CAST(round(l_tax * 100) AS BIGINT)) AS t
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
results AS (
  SELECT dataset, fold, 'm' || m AS method, 'c' || (m % 4) AS config_type, CASE m % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'tuned' ELSE 'tuned_ensemble' END AS method_subtype,
         CASE WHEN k >= 5 THEN CAST(d AS DOUBLE) / k END AS metric_error, CASE WHEN k >= 5 THEN CAST(t AS DOUBLE) / k END AS metric_error_val, k < 5 AS imputed
  FROM raw WHERE m % 3 < 2)"""

_MEMBERS = ", ".join(f"('{c.name}', '{c.a.name}', '{c.b.name}', '{c.a.label}', '{c.b.label}', {repr(c.expected_direction) if c.expected_direction else 'NULL'}, '{s}', '{t}')" for c in COMPARISONS for s, g in (("a", c.a), ("b", c.b)) for t in sorted(g.config_types))
MEMBERS = f"members(comparison_name, group_a_name, group_b_name, group_a_label, group_b_label, expected_direction, side, config_type) AS (VALUES {_MEMBERS})"
FAMILY = "families(group_name, config_type) AS (VALUES " + ", ".join(f"('{g.name}', '{t}')" for g in FAMILIES.values() for t in sorted(g.config_types)) + ")"


def normalised(e: str) -> str:
    lo, mid = f"min({e}) OVER w", f"quantile_cont({e}, 0.5) OVER w"
    return f"CASE WHEN {e} IS NULL THEN NULL WHEN {mid} > {lo} THEN round(least(1.0, greatest(0.0, ({e} - {lo}) / ({mid} - {lo}))), 12) WHEN {e} = {lo} THEN 0.0 ELSE 1.0 END"


GAPS = f"""{RESULTS},
{MEMBERS},
scaled AS (
  SELECT dataset, fold AS split_id, CAST(fold // 3 AS INTEGER) AS repeat, CAST(fold % 3 AS INTEGER) AS fold, method, method_subtype, config_type, metric_error_val AS sel, metric_error AS eval,
         {normalised("metric_error_val")} AS sel_norm, {normalised("metric_error")} AS eval_norm
  FROM results WINDOW w AS (PARTITION BY dataset, results.fold)),
candidates AS (SELECT * FROM scaled JOIN members USING (config_type) WHERE sel IS NOT NULL AND eval IS NOT NULL AND sel_norm IS NOT NULL AND eval_norm IS NOT NULL),
best AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY dataset, split_id, comparison_name, side ORDER BY sel_norm, sel, method, method_subtype) = 1),
gaps AS (
  SELECT a.dataset, a.repeat, a.fold, a.comparison_name, a.group_a_name, a.group_b_name, a.group_a_label, a.group_b_label, a.expected_direction,
         a.method AS best_a_method, a.eval AS best_a_error, a.eval_norm AS best_a_norm_error, b.method AS best_b_method, b.eval AS best_b_error, b.eval_norm AS best_b_norm_error,
         a.eval - b.eval AS delta_raw, a.eval_norm - b.eval_norm AS delta_norm
  FROM best a JOIN best b USING (dataset, split_id, comparison_name) WHERE a.side = 'a' AND b.side = 'b')"""

_SPLITS = "SELECT r.repeat, f.fold FROM (VALUES (0), (1), (2)) r(repeat), (VALUES (0), (1), (2)) f(fold)"
ROWS = f"""sold AS (
  SELECT 'd' || p_size AS dataset, l_orderkey, l_quantity AS quantity, l_extendedprice AS price, nullif(l_discount, 0.0) AS discount, l_tax AS tax, l_linestatus AS linestatus,
         CASE WHEN l_linenumber <> 7 THEN p_brand END AS brand, l_returnflag AS y, CASE p_size % 3 WHEN 0 THEN 'multiclass' WHEN 1 THEN 'binary' ELSE 'regression' END AS problem_type
  FROM lineitem JOIN part ON l_partkey = p_partkey),
train AS (
  SELECT sold.*, CAST(s.repeat AS INTEGER) AS repeat, CAST(s.fold AS INTEGER) AS fold FROM sold, ({_SPLITS}) s
  WHERE (CASE s.repeat WHEN 0 THEN l_orderkey WHEN 1 THEN l_orderkey // 3 ELSE l_orderkey // 9 END) % 3 <> s.fold)"""

_CELL = "SELECT dataset, repeat, fold, '{f}' AS feature, '{k}' AS kind, {n} AS num, {c} AS cat FROM train"
CELLS = (
    ROWS
    + ",\ncells AS (\n  "
    + "\n  UNION ALL ".join([_CELL.format(f=f, k="num", n=f"CAST({f} AS DOUBLE)", c="CAST(NULL AS VARCHAR)") for f in ("quantity", "price", "discount", "tax")] + [_CELL.format(f=f, k="cat", n="CAST(NULL AS DOUBLE)", c=f) for f in ("linestatus", "brand")])
    + """),
value_counts AS (SELECT dataset, repeat, fold, feature, num, cat, count(*) AS k FROM cells WHERE num IS NOT NULL OR cat IS NOT NULL GROUP BY ALL),
tops AS (SELECT dataset, repeat, fold, feature, count(*) AS n_distinct, max(k) AS top FROM value_counts GROUP BY ALL),
profile AS (
  SELECT c.*, coalesce(t.n_distinct, 0) AS n_distinct, t.top, 1 - c.n_values / c.n_rows AS missing FROM (
    SELECT dataset, repeat, fold, feature, kind, count(*) AS n_rows, count(num) + count(cat) AS n_values,
           CASE WHEN count(num) >= 3 THEN coalesce(skewness(num), 0) END AS skew, CASE WHEN count(num) >= 4 THEN coalesce(kurtosis(num), 0) END AS kurt,
           stddev_samp(num) AS std, min(num) AS low, max(num) AS high, count(*) FILTER (num = 0) AS zeros, quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.75) AS q3,
           CASE WHEN min(num) > 0 THEN count(num) / sum(1 / num) END AS hmean
    FROM cells GROUP BY ALL) c LEFT JOIN tops t USING (dataset, repeat, fold, feature))"""
)

_K = "dataset, repeat, fold"
DESCRIPTORS = f"""{CELLS},
rows_of AS (SELECT {_K}, count(*) AS n, avg(CASE WHEN discount IS NULL OR brand IS NULL THEN 1.0 ELSE 0.0 END) AS row_missing_fraction FROM train GROUP BY ALL),
d_size AS (
  SELECT *, log10(n) AS log_n, log10(d) AS log_d, n / d AS n_over_d, d / n AS d_over_n, n_num_features / d AS num_fraction, n_cat_features / d AS cat_fraction FROM (
    SELECT {_K}, any_value(r.n) AS n, count(*) AS d, count(*) FILTER (kind = 'num') AS n_num_features, count(*) FILTER (kind = 'cat') AS n_cat_features, avg(missing) AS missing_fraction
    FROM profile JOIN rows_of r USING ({_K}) GROUP BY {_K})),
classes AS (SELECT {_K}, y, count(*) AS k FROM train WHERE problem_type IN ('binary', 'multiclass') AND y IS NOT NULL GROUP BY ALL),
shares AS (SELECT *, k / sum(k) OVER (PARTITION BY {_K}) AS p FROM classes),
d_target AS (
  SELECT {_K}, c.n_classes, c.class_entropy, c.majority_class_fraction, c.minority_class_fraction, c.class_imbalance_ratio FROM rows_of LEFT JOIN (
    SELECT {_K}, count(*) AS n_classes, -sum(p * log2(p)) AS class_entropy, max(p) AS majority_class_fraction, min(p) AS minority_class_fraction, max(p) / min(p) AS class_imbalance_ratio FROM shares GROUP BY ALL) c USING ({_K})),
d_card AS (
  SELECT {_K}, avg(n_distinct) FILTER (kind = 'cat') AS mean_cat_cardinality, CAST(max(n_distinct) FILTER (kind = 'cat') AS DOUBLE) AS max_cat_cardinality,
         avg(CASE WHEN n_distinct >= greatest(50.0, 0.1 * n_rows) THEN 1.0 ELSE 0.0 END) FILTER (kind = 'cat') AS high_cardinality_fraction, avg(n_distinct) FILTER (kind = 'cat') / any_value(r.n) AS cat_cardinality_to_n_ratio
  FROM profile JOIN rows_of r USING ({_K}) GROUP BY {_K}),
d_missing AS (
  SELECT {_K}, any_value(r.row_missing_fraction) AS row_missing_fraction, avg(CASE WHEN missing > 0 THEN 1.0 ELSE 0.0 END) AS feature_missing_fraction, avg(missing) FILTER (kind = 'num') AS num_missing_fraction,
         avg(missing) FILTER (kind = 'cat') AS cat_missing_fraction, max(missing) AS max_feature_missing_fraction
  FROM profile JOIN rows_of r USING ({_K}) GROUP BY {_K}),
outliers AS (
  SELECT {_K}, CAST(sum(CASE WHEN num < q1 - 1.5 * (q3 - q1) OR num > q3 + 1.5 * (q3 - q1) THEN k ELSE 0 END) AS DOUBLE) AS outside FROM value_counts JOIN profile USING ({_K}, feature) WHERE num IS NOT NULL GROUP BY ALL),
d_shape AS (
  SELECT {_K}, avg(abs(skew)) AS mean_abs_skew, max(abs(skew)) AS max_abs_skew, avg(kurt) AS mean_kurtosis, any_value(o.outside) / sum(n_values) AS outlier_fraction_iqr, CAST(sum(zeros) AS DOUBLE) / sum(n_values) AS zero_fraction
  FROM profile JOIN outliers o USING ({_K}) WHERE kind = 'num' GROUP BY {_K}),
d_info AS (
  SELECT {_K}, avg(CASE WHEN n_distinct <= 1 THEN 1.0 ELSE 0.0 END) AS constant_feature_fraction, avg(CASE WHEN n_distinct <= 1 OR top / n_values >= 0.95 THEN 1.0 ELSE 0.0 END) AS near_constant_feature_fraction FROM profile GROUP BY ALL),
d_irreg AS (
  SELECT {_K}, CASE WHEN count(std) >= 3 AND min(std) < max(std) THEN skewness(std) END AS irreg_std_skew, CASE WHEN count(high) >= 3 AND min(high - low) < max(high - low) THEN skewness(high - low) END AS irreg_range_skew,
         CASE WHEN count(hmean) >= 2 THEN quantile_cont(hmean, 0.75) - quantile_cont(hmean, 0.25) END AS irreg_iqr_hmean, stddev_samp(kurt) AS irreg_kurtosis_std
  FROM profile WHERE kind = 'num' AND n_distinct > 1 GROUP BY ALL),
described AS (
  SELECT * FROM d_size JOIN d_target USING ({_K}) JOIN d_card USING ({_K}) JOIN d_missing USING ({_K}) JOIN d_shape USING ({_K}) JOIN d_info USING ({_K}) LEFT JOIN (SELECT {_K}, round(irreg_std_skew, 6) AS irreg_std_skew, round(irreg_range_skew, 6) AS irreg_range_skew, round(irreg_iqr_hmean, 6) AS irreg_iqr_hmean, round(irreg_kurtosis_std, 6) AS irreg_kurtosis_std FROM d_irreg) USING ({_K}))"""

PARTS = [c for c in IRREGULARITY if c != "irreg_min_cov_eig"]
FEATURES = [*BASIC, *PARTS]
_G = "dataset, comparison_name, group_a_name, group_b_name, group_a_label, group_b_label, expected_direction"
_GAP_NUMBERS = ["best_a_error", "best_a_norm_error", "best_b_error", "best_b_norm_error", "delta_raw", "delta_norm"]
_W = {c: IRREGULARITY[c] for c in PARTS}
_TOTAL = sum(abs(w) for w in _W.values())
_Z = {c: f"(({c}) - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0)" for c in PARTS}
ANALYSIS = f"""{GAPS},
{DESCRIPTORS},
joined AS (SELECT * FROM described JOIN gaps USING ({_K})),
dataset_rows AS (
  SELECT {_G}, count(*) AS n_splits, {", ".join(f"avg({c}) AS {c}" for c in _GAP_NUMBERS)}, stddev_samp(delta_raw) AS delta_raw_std, stddev_samp(delta_raw) / sqrt(count(delta_raw)) AS delta_raw_sem,
         stddev_samp(delta_norm) AS delta_norm_std, stddev_samp(delta_norm) / sqrt(count(delta_norm)) AS delta_norm_sem, {", ".join(f"CASE WHEN count({c}) = count(*) THEN avg({c}) END AS {c}" for c in FEATURES)}
  FROM joined GROUP BY ALL),
one_each AS (SELECT * FROM dataset_rows QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY comparison_name) = 1),
zs AS (SELECT dataset, {", ".join(f"{z} AS z_{c}" for c, z in _Z.items())} FROM one_each),
composites AS (
  SELECT dataset, ({" + ".join(f"coalesce({w} * z_{c}, 0)" for c, w in _W.items())}) * {_TOTAL} / nullif({" + ".join(f"CASE WHEN z_{c} IS NULL THEN 0 ELSE {abs(w)} END" for c, w in _W.items())}, 0) AS irregularity FROM zs),
analysis AS (SELECT * FROM dataset_rows LEFT JOIN composites USING (dataset))"""

TESTED = [*FEATURES, "irregularity"]
_LONG = "\n  UNION ALL ".join(f"SELECT dataset, '{f}' AS feature, round(CAST({f} AS DOUBLE), 9) AS x, round(delta_norm, 9) AS y FROM main" for f in TESTED)
OBSERVATIONS = f"""{ANALYSIS},
main AS (SELECT * FROM analysis WHERE comparison_name = 'left_vs_right'),
obs AS (
  {_LONG}),
pairs AS (SELECT * FROM obs WHERE x IS NOT NULL AND y IS NOT NULL)"""


def average_rank(v: str, by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(rank() OVER ({part}ORDER BY {v}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{v}) - 1) / 2.0)"


def correlation(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def p_value(r: str, n: str) -> str:
    """The finite series of the two-sided t tail as list expressions."""
    c2 = f"greatest(0.0, 1 - {r} * {r})"
    prod = lambda term, k: f"coalesce(list_aggregate(list_transform(range(1, CAST({k} AS BIGINT) + 1), lambda j: {term}), 'product'), 1.0)"
    even = f"1 - abs({r}) * list_sum(list_transform(range(0, CAST(({n} - 2) // 2 AS BIGINT)), lambda k: pow({c2}, k) * {prod('(2.0 * j - 1) / (2.0 * j)', 'k')}))"
    odd = f"1 - 2 / pi() * (asin(least(1.0, abs({r}))) + abs({r}) * sqrt({c2}) * list_sum(list_transform(range(0, CAST(({n} - 3) // 2 AS BIGINT)), lambda k: pow({c2}, k) * {prod('2.0 * j / (2.0 * j + 1)', 'k')})))"
    return f"CASE WHEN {r} IS NULL THEN NULL WHEN abs({r}) >= 1 THEN 0.0 WHEN {n} % 2 = 0 THEN greatest(0.0, {even}) ELSE greatest(0.0, {odd}) END"


_FEATURE_LIST = ", ".join(f"('{f}')" for f in TESTED)


def associated(method: str = "spearman") -> str:
    """CTEs up to ``tested``: one row per feature."""
    rank = (average_rank("x", "feature"), average_rank("y", "feature")) if method == "spearman" else ("x", "y")
    return f"""{OBSERVATIONS},
ranked AS (SELECT *, {rank[0]} AS cx, {rank[1]} AS cy FROM pairs),
found AS (SELECT feature, count(*) AS n, count(DISTINCT x) AS feature_n_unique, count(DISTINCT y) AS target_n_unique, {correlation("cx", "cy")} AS r FROM ranked GROUP BY feature),
reasons AS (
  SELECT l.feature, coalesce(n, 0) AS n, coalesce(feature_n_unique, 0) AS feature_n_unique, r,
         CASE WHEN coalesce(n, 0) < 30 THEN 'n < 30' WHEN feature_n_unique < 2 THEN 'feature has <2 observed values' WHEN target_n_unique < 2 THEN 'target has <2 observed values' ELSE 'tested' END AS reason
  FROM (VALUES {_FEATURE_LIST}) l(feature) LEFT JOIN found USING (feature)),
clean AS (SELECT feature, n, feature_n_unique, reason, CASE WHEN reason = 'tested' THEN greatest(-1.0, least(1.0, r)) END AS spearman_r FROM reasons),
with_p AS (SELECT *, abs(spearman_r) AS abs_spearman_r, {p_value("spearman_r", "n")} AS p_value FROM clean),
ordered AS (SELECT *, count(p_value) OVER () AS m, CASE WHEN p_value IS NOT NULL THEN row_number() OVER (PARTITION BY p_value IS NULL ORDER BY p_value) END AS k FROM with_p),
tested AS (
  SELECT feature, n, feature_n_unique, reason, spearman_r, abs_spearman_r, p_value,
         CASE WHEN p_value IS NOT NULL THEN least(1.0, min(p_value * m / k) OVER (PARTITION BY p_value IS NULL ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END AS p_value_bh,
         CASE WHEN p_value IS NOT NULL THEN least(1.0, max(p_value * (m - k + 1)) OVER (PARTITION BY p_value IS NULL ORDER BY k ROWS UNBOUNDED PRECEDING)) END AS p_value_holm,
         row_number() OVER (ORDER BY round(abs_spearman_r, 12) DESC NULLS LAST, feature) AS effect_rank FROM ordered)"""


def index(n: str, *key: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 8) AS BIGINT) % {n}"


def r6(columns: str | list[str]) -> str:
    """Doubles to six digits, without a negative zero."""
    names = columns.split() if isinstance(columns, str) else columns
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names)


GAP_NAMES = ", ".join(GAP_COLUMNS[:9])


def six_digits(sql: str) -> str:
    """Every ``round(x, 6) + 0.0`` as the steps of the queries: nine digits, then half up at the sixth."""
    end = ", 6) + 0.0"
    while end in sql:
        stop = sql.index(end)
        depth, at = 1, stop
        while depth:
            at -= 1
            depth += {")": 1, "(": -1}.get(sql[at], 0)
        inner = sql[at + 1 : stop]
        sql = f"{sql[: at - len('round')]}floor(round({inner}, 9) * 1000000 + 0.5) / 1000000 + 0.0{sql[stop + len(end) :]}"
    return sql
