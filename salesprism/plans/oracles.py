"""SQL for the registered queries, over the same tables; money is summed in cents, other doubles are rounded alike."""

from __future__ import annotations

from salesprism.functions.text import DIRECTIVES, ROUTES

SALES = """sales AS (
  SELECT CAST(o_orderdate AS DATE) AS date, p_type AS product, l_extendedprice AS revenue, l_quantity AS quantity,
         l_extendedprice / nullif(l_quantity, 0) AS unit_price, l_quantity * p_retailprice AS cost, l_extendedprice - l_quantity * p_retailprice AS profit,
         CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderpriority AS channel, r_name AS region,
         p_brand AS category, c_mktsegment AS group_segment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cut AS (SELECT CASE WHEN max(date) < last_day(max(date)) THEN CAST(date_trunc('month', max(date)) AS DATE) ELSE DATE '9999-01-01' END AS cut FROM sales),
whole AS (SELECT sales.* FROM sales, cut WHERE date < cut)"""


def _sum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


MONTH = "CAST(date_trunc('month', date) AS DATE)"


def _cells(key: str, source: str = "whole", measure: str = "revenue") -> str:
    """CTEs sums, cells: every observed month with every key."""
    return f"""sums AS (SELECT {MONTH} AS period, {key}, {_sum(measure)} AS value FROM {source} GROUP BY ALL),
cells AS (SELECT p.period, k.{key}, coalesce(s.value, 0.0) AS value FROM (SELECT DISTINCT period FROM sums) p CROSS JOIN (SELECT DISTINCT {key} FROM sums) k
          LEFT JOIN sums s ON s.period = p.period AND s.{key} = k.{key})"""


def _spine(measure: str, name: str, source: str = "whole") -> str:
    return f"""{name}_s AS (SELECT {MONTH} AS period, {_sum(measure)} AS value FROM {source} GROUP BY ALL),
{name} AS (SELECT CAST(p AS DATE) AS period, coalesce(value, 0.0) AS value FROM (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS p FROM {name}_s) LEFT JOIN {name}_s ON period = CAST(p AS DATE))"""


def _halves(key: str, cells: str = "cells", name: str = "halves") -> str:
    by = f"{key}, " if key else ""
    return f"""{name}_o AS (SELECT period, row_number() OVER (ORDER BY period) AS o, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM {cells})),
{name} AS (SELECT {by}sum(CASE WHEN o <= n // 2 THEN value ELSE 0.0 END) / max(n // 2) AS before, sum(CASE WHEN o > n // 2 THEN value ELSE 0.0 END) / max(n - n // 2) AS after
           FROM {cells} JOIN {name}_o USING (period) {f"GROUP BY {key}" if key else ""})"""


SQL: dict[str, str] = {}
SQL["period_sum_month"] = f"WITH {SALES}, {_spine('revenue', 'm', 'sales')} SELECT period, {_r('value')} AS value FROM m"
SQL["period_sum_week"] = f"""WITH {SALES}, bound AS (SELECT CASE WHEN CAST(date_trunc('week', max(date)) AS DATE) + 6 > max(date) THEN CAST(date_trunc('week', max(date)) AS DATE) ELSE DATE '9999-01-01' END AS b FROM sales),
w AS (SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS period, {_sum('revenue')} AS value FROM sales, bound WHERE date < b GROUP BY ALL)
SELECT CAST(p AS DATE) AS period, {_r('coalesce(value, 0.0)')} AS value FROM (SELECT unnest(generate_series(min(period), max(period), INTERVAL 7 DAY)) AS p FROM w) LEFT JOIN w ON period = CAST(p AS DATE)"""
SQL["period_sum_day"] = f"""WITH d AS (SELECT CAST(ts AS DATE) AS period, {_sum('round(value, 2)')} AS value FROM events GROUP BY ALL)
SELECT CAST(p AS DATE) AS period, {_r('coalesce(value, 0.0)')} AS value FROM (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS p FROM d) LEFT JOIN d ON period = CAST(p AS DATE)"""
SQL["product_period_matrix"] = f"WITH {SALES}, {_cells('category')} SELECT period, category, {_r('value')} AS value FROM cells"
SQL["product_ranking"] = f"""WITH {SALES}, t AS (SELECT product, {_sum('revenue')} AS value FROM sales GROUP BY ALL)
SELECT product, {_r('value')} AS value, {_r('value / sum(value) OVER ()')} AS share, row_number() OVER (ORDER BY value DESC, product) AS rank FROM t"""
SQL["margin_by_product"] = f"""WITH {SALES}, t AS (SELECT category, {_sum('revenue')} AS revenue, {_sum('profit')} AS profit FROM sales GROUP BY ALL)
SELECT category, {_r('revenue')} AS revenue, {_r('profit')} AS profit, {_r('CASE WHEN revenue > 0 THEN profit / revenue END')} AS margin,
       row_number() OVER (ORDER BY revenue DESC, category) AS revenue_rank, row_number() OVER (ORDER BY profit DESC, category) AS profit_rank FROM t"""
_SHARES = f"""t AS (SELECT category, {_sum('revenue')} AS v FROM sales GROUP BY ALL HAVING v > 0),
s AS (SELECT category, v, v / sum(v) OVER () AS share, row_number() OVER (ORDER BY v DESC, category) AS r FROM t),
u AS (SELECT *, sum(share) OVER (ORDER BY r) AS until FROM s)"""
SQL["concentration_stats"] = f"""WITH {SALES}, {_SHARES}
SELECT min_by(category, r) AS leader, {_r('sum(share) FILTER (r <= 1)')} AS top1_share, {_r('sum(share) FILTER (r <= 2)')} AS top2_share, {_r('sum(share) FILTER (r <= 3)')} AS top3_share,
       {_r('sum(share * share)')} AS herfindahl, count(*) FILTER (until < 0.5) + 1 AS items_for_half, count(*) AS item_count, {_r(_sum('v'))} AS total FROM u"""
SQL["pareto_classes"] = f"""WITH {SALES}, {_SHARES}, c AS (SELECT *, sum(v) OVER (ORDER BY r) / sum(v) OVER () AS cumulative FROM s),
f AS (SELECT *, count(*) FILTER (cumulative < 0.8) OVER () + 1 AS n_vital FROM c)
SELECT category, {_r('v')} AS value, {_r('share')} AS share, r AS rank, {_r('cumulative')} AS cumulative, r <= n_vital AS is_vital, share < 0.01 AS is_tail FROM f"""
SQL["revenue_decomposition"] = f"""WITH {SALES}, {_cells('product')}, {_halves('product')}
SELECT product, {_r('before')} AS before, {_r('after')} AS after, {_r('after - before')} AS change, {_r('(after - before) / sum(after - before) OVER ()')} AS share_of_change FROM halves"""


def _dimension(d: str) -> str:
    return f"""(WITH s AS (SELECT {d} AS level, * FROM whole WHERE {d} IS NOT NULL), {_cells('level', 's')}, {_halves('level')}, n AS (SELECT {d} AS level, count(*) AS n_rows FROM sales GROUP BY ALL)
SELECT '{d}' AS dimension, level, before, after, n_rows FROM halves JOIN n USING (level))"""


_DIMS = ("channel", "region", "group_segment")
SQL["dimension_decomposition"] = f"""WITH {SALES}, a AS ({" UNION ALL ".join(f"SELECT * FROM {_dimension(d)}" for d in _DIMS)})
SELECT dimension, level, {_r('before')} AS before, {_r('after')} AS after, n_rows, {_r('after - before')} AS change, {_r('(after - before) / sum(after - before) OVER w')} AS share_of_change,
       count(*) OVER w BETWEEN 2 AND 12 AND max(n_rows) OVER w <= 0.75 * sum(n_rows) OVER w AS usable, coalesce(abs((after - before) / abs(before)) < 0.1, false) AS is_steady
FROM a WINDOW w AS (PARTITION BY dimension)"""
SQL["price_volume_split"] = f"""WITH {SALES}, {_spine('revenue', 'rv')}, {_spine('quantity', 'qt')}, {_halves('', 'rv', 'rh')}, {_halves('', 'qt', 'qh')},
x AS (SELECT rh.before AS r0, rh.after AS r1, qh.before AS q0, qh.after AS q1, rh.before / qh.before AS p0, rh.after / qh.after AS p1 FROM rh, qh)
SELECT {_r('q0')} AS quantity_before, {_r('q1')} AS quantity_after, {_r('p0')} AS price_before, {_r('p1')} AS price_after, {_r('(q1 - q0) * p0')} AS volume_effect, {_r('(p1 - p0) * q1')} AS price_effect, {_r('r1 - r0')} AS total_change FROM x"""
SQL["month_of_year_index"] = f"""WITH {SALES}, {_spine('revenue', 'm')}, o AS (SELECT *, avg(value) OVER () AS overall FROM m)
SELECT month(period) AS month, count(*) AS years, {_r('avg(value)')} AS mean, {_r('avg(value) / overall - 1')} AS lift FROM o GROUP BY month(period), overall"""
SQL["lifecycle_status"] = f"""WITH {SALES}, {_cells('category')}, o AS (SELECT period, row_number() OVER (ORDER BY period) AS o, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM cells)),
g AS (SELECT category, count(*) FILTER (value > 0 AND o <= n - 2) AS earlier_active, count(*) FILTER (value > 0 AND o > n - 2) AS recent_active, max(period) FILTER (value > 0) AS last_seen,
      sum(CASE WHEN o <= n - 2 THEN value ELSE 0.0 END) AS earlier_value, sum(CASE WHEN o > n - 2 THEN value ELSE 0.0 END) AS recent_value, max(n) AS n FROM cells JOIN o USING (period) GROUP BY ALL)
SELECT category, earlier_active, recent_active, last_seen, {_r('earlier_value')} AS earlier_value, {_r('recent_value')} AS recent_value,
       CASE WHEN recent_active = 0 AND earlier_active >= greatest(3, (n - 2) // 3) THEN 'stopped' WHEN earlier_active = 0 AND recent_active > 0 THEN 'arrived' ELSE 'trading' END AS status FROM g"""
_ORDERS = f"o AS (SELECT order_id, {_sum('revenue')} AS value FROM sales GROUP BY ALL HAVING value > 0)"
_DECILE = "d AS (SELECT sum(value) FILTER (r <= ceil(n / 10.0)) / sum(value) AS share FROM (SELECT value, row_number() OVER (ORDER BY value DESC) AS r, count(*) OVER () AS n FROM o))"
SQL["order_value_quantiles"] = f"""WITH {SALES}, {_ORDERS}, {_DECILE}
SELECT count(*) AS orders, {_r('avg(value)')} AS mean, {_r('quantile_cont(value, 0.5)')} AS median, {_r('quantile_cont(value, 0.1)')} AS p10, {_r('quantile_cont(value, 0.9)')} AS p90,
       {_r('(SELECT share FROM d)')} AS top_decile_share, {_r('avg(value) / quantile_cont(value, 0.5)')} AS mean_to_median FROM o"""
SQL["top_decile_share"] = f"WITH {SALES}, {_ORDERS}, {_DECILE} SELECT {_r('share')} AS top_decile_share FROM d"


def _ols(keys: str, source: str, x: str = "x", y: str = "y") -> str:
    by = f"{keys}, " if keys else ""
    return f"""g AS (SELECT {by}count(*) AS n, regr_slope({y}, {x}) AS slope, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy, avg({y}) AS mean_y FROM {source} {f"GROUP BY {keys}" if keys else ""}),
ols AS (SELECT *, sxy * sxy / nullif(sxx * syy, 0) AS r2, slope / nullif(sqrt(greatest(syy - sxy * sxy / nullif(sxx, 0), 0) / nullif(n - 2, 0) / nullif(sxx, 0)), 0) AS t FROM g)"""


SQL["trend_regression"] = f"""WITH {SALES}, {_spine('revenue', 'm')}, pts AS (SELECT CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS x, value AS y FROM m), {_ols('', 'pts')}
SELECT n, {_r('slope')} AS slope, {_r('r2')} AS r2, {_r('t')} AS t, {_r('slope / abs(mean_y)')} AS effect, {_r('slope * (n - 1) / abs(mean_y)')} AS fitted_change FROM ols"""
SQL["price_elasticity"] = f"""WITH {SALES}, q AS (SELECT category, {MONTH} AS period, {_sum('quantity')} AS units, {_sum('revenue')} AS rev FROM whole GROUP BY ALL HAVING units > 0 AND rev > 0),
pts AS (SELECT category, rev / units AS price, ln(rev / units) AS x, ln(units) AS y FROM q), {_ols('category', 'pts')}, sp AS (SELECT category, stddev_pop(price) / avg(price) AS v FROM pts GROUP BY ALL)
SELECT category, n, {_r('slope')} AS slope, {_r('r2')} AS r2, {_r('t')} AS t, {_r('v')} AS price_variation, n >= 6 AND v >= 0.05 AS usable FROM ols JOIN sp USING (category)"""


def _anova(d: str) -> str:
    return f"""SELECT '{d}' AS dimension, count(*) AS levels, sum(n) AS rows, sum(n * mean) AS s, sum(n * mean * mean) AS ss, sum((n - 1) * var) AS within, max(mean) AS high, min(mean) AS low, sum(var / n) AS se2, sum(var * var / (n * n * (n - 1))) AS wd
FROM (SELECT {d}, count(*)::DOUBLE AS n, avg(revenue) AS mean, var_samp(revenue) AS var FROM sales WHERE {d} IS NOT NULL GROUP BY ALL) WHERE n >= 5"""


SQL["segment_anova_stats"] = f"""WITH {SALES}, g AS ({" UNION ALL ".join(_anova(d) for d in _DIMS)})
SELECT dimension, levels, rows::BIGINT AS rows, {_r('CASE WHEN levels = 2 THEN (high - low) * (high - low) / se2 ELSE ((ss - s * s / rows) / (levels - 1)) / (within / (rows - levels)) END')} AS statistic, (levels - 1)::DOUBLE AS df1,
       {_r('CASE WHEN levels = 2 THEN se2 * se2 / wd ELSE rows - levels END::DOUBLE')} AS df2, {_r('(high - low) / abs(s / rows)')} AS effect FROM g WHERE levels BETWEEN 2 AND 12"""


def _mix(d: str) -> str:
    return f"""t AS (SELECT {d} AS level, product AS item, count(*) AS n FROM sales GROUP BY ALL), l AS (SELECT level, sum(n)::BIGINT AS n_level FROM t GROUP BY ALL), i AS (SELECT item, sum(n)::BIGINT AS n_item FROM t GROUP BY ALL),
x AS (SELECT level, item, coalesce(n, 0) AS n, n_level, n_item, n_level * n_item / sum(coalesce(n, 0)) OVER () AS expected FROM l CROSS JOIN i LEFT JOIN t USING (level, item))"""


SQL["product_mix_crosstab"] = f"WITH {SALES}, {_mix('channel')} SELECT level, item, n, n_level, n_item, {_r('expected')} AS expected FROM x"
SQL["product_mix_chi2"] = f"""WITH {SALES}, {_mix('region')}
SELECT {_r('sum(power(n - expected, 2) / expected)')} AS chi2, (count(DISTINCT level) - 1) * (count(DISTINCT item) - 1) AS df, {_r('avg((expected < 5)::INT)')} AS small_share FROM x"""
SQL["product_correlation"] = f"""WITH {SALES}, {_cells('category')}, k AS (SELECT *, count(*) FILTER (value > 0) OVER (PARTITION BY category) AS active, (SELECT count(DISTINCT period) FROM cells) AS np FROM cells),
f AS (SELECT * FROM k WHERE np >= 6 AND active >= greatest(3, np // 3))
SELECT a.category AS a, b.category AS b, count(*) AS n, {_r('corr(a.value, b.value)')} AS r FROM f a JOIN f b ON a.period = b.period AND a.category < b.category GROUP BY ALL"""
SQL["bh_adjustment"] = f"""WITH {SALES}, t AS (SELECT category, round(avg((profit < 0)::INT), 9) AS p FROM sales GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY p, category) AS k, count(*) OVER () AS n FROM t)
SELECT category, {_r('p')} AS p, {_r('least(1.0, min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS adjusted FROM r"""
SQL["repeat_vs_new"] = f"""WITH {SALES}, f AS (SELECT customer_id, min(date) AS first FROM sales GROUP BY ALL),
m AS (SELECT {MONTH} AS period, {_sum('CASE WHEN date = first THEN revenue ELSE 0 END')} AS new, {_sum('CASE WHEN date <> first THEN revenue ELSE 0 END')} AS rep FROM whole JOIN f USING (customer_id) GROUP BY ALL),
cells AS (SELECT period, 'new' AS side, new AS value FROM m UNION ALL SELECT period, 'repeat', rep FROM m), {_halves('side')}
SELECT side, {_r('before')} AS before, {_r('after')} AS after, {_r('(after - before) / nullif(abs(before), 0)')} AS change_pct FROM halves"""
_Q = "least(4, greatest(1, ceil({p} * 4)))::BIGINT"
_RANK = "(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) / count(*) OVER ()"
_RFM = f"""now AS (SELECT max(date) AS now FROM sales),
c AS (SELECT customer_id, date_diff('day', max(date), max(now)) AS recency, date_diff('day', min(date), max(now)) AS age, count(*) AS lines, {_sum('revenue')} AS spend FROM sales, now GROUP BY customer_id),
q AS (SELECT *, {_Q.format(p='(1 - ' + _RANK.format(v='recency') + ')')} AS r, {_Q.format(p=_RANK.format(v='lines'))} AS f, {_Q.format(p=_RANK.format(v='spend'))} AS m, greatest(30, floor(quantile_cont(recency, 0.5) OVER ())) AS young FROM c),
rfm AS (SELECT * EXCLUDE (young), CASE WHEN r >= 3 AND f >= 3 THEN 'champions' WHEN r >= 3 AND age <= young AND f <= 2 THEN 'new' WHEN r >= 3 THEN 'loyal' WHEN r <= 2 AND f >= 3 THEN 'at_risk' WHEN r = 1 THEN 'lost' ELSE 'occasional' END AS segment FROM q)"""
SQL["rfm_scores"] = f"WITH {SALES}, {_RFM} SELECT customer_id, recency, age, lines, {_r('spend')} AS spend, r, f, m, segment FROM rfm"
SQL["rfm_segments"] = f"""WITH {SALES}, {_RFM} SELECT segment, count(*) AS customers, {_r(_sum('spend'))} AS spend, {_r('avg(recency)')} AS avg_recency, {_r('avg(lines)')} AS avg_lines, {_r('count(*) / sum(count(*)) OVER ()')} AS share FROM rfm GROUP BY segment"""
SQL["customer_sample"] = f"WITH {SALES}, {_RFM} SELECT customer_id, recency, lines AS frequency, {_r('spend')} AS monetary, segment FROM rfm ORDER BY sha256(customer_id), customer_id LIMIT 400"
_COHORT = """f AS (SELECT customer_id, min(date) AS first FROM sales GROUP BY ALL),
cc AS (SELECT CAST(date_trunc('month', first) AS DATE) AS cohort, date_diff('month', date_trunc('month', first), date_trunc('month', date)) AS age, count(DISTINCT customer_id) AS customers FROM sales JOIN f USING (customer_id) GROUP BY ALL)"""
_RETAIN = """sz AS (SELECT cohort, customers AS size FROM cc WHERE age = 0 AND customers >= 8),
gr AS (SELECT cohort, size, unnest(range(0, date_diff('month', cohort, (SELECT date_trunc('month', max(date)) FROM sales)) + 1)) AS age FROM sz),
ret AS (SELECT cohort, age, size, coalesce(customers, 0) AS retained, coalesce(customers, 0) / size AS rate FROM gr LEFT JOIN cc USING (cohort, age))"""
SQL["cohort_sizes"] = f"WITH {SALES}, {_COHORT} SELECT cohort, customers AS size FROM cc WHERE age = 0"
SQL["cohort_retention"] = f"WITH {SALES}, {_COHORT}, {_RETAIN} SELECT cohort, age, size, retained, {_r('rate')} AS rate FROM ret"
SQL["retention_curve"] = f"WITH {SALES}, {_COHORT}, {_RETAIN} SELECT age, count(*) AS cohorts, {_r('avg(rate)')} AS rate FROM ret WHERE age >= 1 GROUP BY age HAVING count(*) >= 2"


def _baskets(item: str) -> str:
    return f"""b AS (SELECT DISTINCT order_id AS basket, {item} AS item FROM sales), mb AS (SELECT *, count(*) OVER (PARTITION BY basket) AS k FROM b QUALIFY k >= 2),
pr AS (SELECT x.item AS a, y.item AS b, count(*) AS together FROM mb x JOIN mb y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL),
si AS (SELECT item, count(*) AS n FROM mb GROUP BY ALL), lf AS (SELECT pr.a, pr.b, together, sa.n AS n_a, sb.n AS n_b, (SELECT count(DISTINCT basket) FROM mb) AS n_baskets FROM pr JOIN si sa ON sa.item = pr.a JOIN si sb ON sb.item = pr.b)"""


SQL["basket_pairs"] = f"WITH {SALES}, {_baskets('product')} SELECT a, b, together FROM pr"
SQL["basket_lift"] = f"""WITH {SALES}, {_baskets('category')} SELECT a, b, together, n_a, n_b, n_baskets, {_r('together * n_baskets / (n_a * n_b)')} AS lift, {_r('together / n_baskets')} AS support, together >= greatest(8, floor(0.01 * n_baskets)) AS supported FROM lf"""
_LC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
SQL["basket_fisher"] = f"""WITH {SALES}, {_baskets('product')}, sup AS (SELECT * FROM lf WHERE together >= greatest(8, floor(0.01 * n_baskets))),
ks AS (SELECT *, unnest(range(together, least(n_a, n_b) + 1)) AS k FROM sup),
pv AS (SELECT a, b, together, n_a, n_b, n_baskets, least(1.0, sum(CASE WHEN n_baskets - n_a - n_b + k >= 0 THEN exp({_LC.format(n='n_a', k='k')} + (lgamma(n_baskets - n_a + 1) - lgamma(n_b - k + 1) - lgamma(n_baskets - n_a - n_b + k + 1)) - {_LC.format(n='n_baskets', k='n_b')}) ELSE 0.0 END)) AS p FROM ks GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS k, count(*) OVER () AS m FROM pv),
ad AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted FROM rk)
SELECT a, b, together, {_r('together * n_baskets / (n_a * n_b)')} AS lift, {_r('p')} AS p, {_r('adjusted')} AS adjusted, adjusted < 0.05 AND together * n_baskets / (n_a * n_b) >= 1.5 AS confirmed FROM ad"""
_GOALS = "(VALUES ('year', 'revenue', 1e9, DATE '2000-01-01', DATE '2000-12-31'), ('margin', 'profit', 5e6, DATE '2001-01-01', DATE '2001-12-31'), ('later', 'revenue', 1e6, DATE '2002-01-01', DATE '2002-12-31')) AS g(id, metric, target, start, \"end\")"
SQL["goal_progress"] = f"""WITH {SALES}, j AS (SELECT id, metric, target::DOUBLE AS target, start, "end", (SELECT max(date) FROM sales) AS as_of, coalesce((SELECT {_sum("CASE WHEN metric = 'profit' THEN profit ELSE revenue END")} FROM sales WHERE date BETWEEN start AND "end"), 0.0) AS actual FROM {_GOALS}),
e AS (SELECT *, least(1.0, greatest(0.0, (date_diff('day', start, least(as_of, "end")) + 1) / (date_diff('day', start, "end") + 1))) AS elapsed, CASE WHEN as_of < start THEN 'not_started' WHEN as_of >= "end" THEN 'finished' ELSE 'in_progress' END AS state FROM j),
p AS (SELECT *, CASE WHEN state = 'finished' THEN actual WHEN state <> 'in_progress' OR elapsed < 0.08 THEN NULL ELSE actual / elapsed END AS projected FROM e)
SELECT id, metric, target, start, "end", as_of, {_r('actual')} AS actual, {_r('elapsed')} AS elapsed, state, {_r('projected')} AS projected, {_r('actual / target')} AS reached_share, projected IS NOT NULL AND projected < target AS needs_alert FROM p"""
_YEAR = "win AS (SELECT * FROM sales WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31')"
SQL["goal_pace"] = f"""WITH {SALES}, {_YEAR}, {_spine('revenue', 'm', 'win')} SELECT period, {_r('value')} AS value, {_r('1e9 / ceil(366 / 30.44)')} AS needed, value >= 1e9 / ceil(366 / 30.44) AS ahead FROM m"""
SQL["goal_gap_drivers"] = f"""WITH {SALES}, {_YEAR}, {_cells('category', 'win')}, {_halves('category')}, d AS (SELECT category, before, after, after - before AS change FROM halves WHERE after < before)
SELECT category, {_r('before')} AS before, {_r('after')} AS after, {_r('change')} AS change, row_number() OVER (ORDER BY change, category) AS rank FROM d QUALIFY rank <= 5"""
_ROBUST = f"""{_cells('category')}, md AS (SELECT category, quantile_cont(value, 0.5) AS median FROM cells GROUP BY ALL), off AS (SELECT cells.*, median, abs(value - median) AS o FROM cells JOIN md USING (category)),
sp AS (SELECT category, quantile_cont(o, 0.5) AS mad, avg(o) AS mean_dev FROM off GROUP BY ALL),
z AS (SELECT category AS subject, period, value, median, mad, CASE WHEN mad > 0 THEN 0.6745 * (value - median) / mad WHEN mean_dev > 0 THEN 0.7979 * (value - median) / mean_dev ELSE 0.0 END AS z FROM off JOIN sp USING (category))"""
SQL["robust_z_scores"] = f"WITH {SALES}, {_ROBUST} SELECT subject, period, {_r('value')} AS value, {_r('median')} AS median, {_r('mad')} AS mad, {_r('z')} AS z FROM z"
SQL["anomaly_candidates"] = f"""WITH {SALES}, {_ROBUST}, n AS (SELECT *, count(*) OVER (PARTITION BY subject) AS n, row_number() OVER (PARTITION BY subject ORDER BY period DESC) AS back FROM z),
h AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY abs(z) DESC, period DESC) AS k, count(*) OVER (PARTITION BY subject) AS run FROM n WHERE n >= 8 AND back <= 80 AND abs(z) >= 2.5 AND abs((value - median) / abs(median)) >= 0.2)
SELECT subject, period, {_r('value')} AS value, {_r('median')} AS median, {_r('z')} AS z, run, CASE WHEN z < 0 THEN 'ANOMALY_DROP' ELSE 'ANOMALY_SPIKE' END AS kind FROM h WHERE k = 1"""
SQL["quality_duplicates"] = f"SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates, {_r('sum(n - 1) / sum(n)')} AS share FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"
SQL["quality_nulls"] = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_r(f"avg(({c} IS NULL OR trim({c}) = '')::INT)")} AS rate FROM documents" for c in ("text", "lang", "source"))
SQL["quality_gaps"] = f"""WITH {SALES}, m AS (SELECT DISTINCT {MONTH} AS month FROM sales WHERE month(date) % 5 <> 0) SELECT CAST(p AS DATE) AS month FROM (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS p FROM m) WHERE CAST(p AS DATE) NOT IN (SELECT month FROM m)"""
SQL["quality_duplicated_period"] = f"""WITH {SALES}, d AS (SELECT date FROM sales UNION ALL SELECT date FROM sales WHERE month(date) = 3), m AS (SELECT {MONTH} AS month, count(*) AS rows FROM d GROUP BY ALL),
t AS (SELECT *, quantile_cont(rows, 0.5) OVER () AS median, count(*) OVER () AS k, sum(rows) OVER () AS total FROM m) SELECT month, rows, {_r('median::DOUBLE')} AS median FROM t WHERE rows > 1.85 * median AND total >= 90 AND k >= 4"""
SQL["quality_values"] = f"WITH {SALES} SELECT count(profit) AS n, {_r('avg((profit < 0)::INT)')} AS negative_share, {_r('avg((profit = 0)::INT)')} AS zero_share FROM sales"
SQL["quality_dates"] = f"WITH {SALES} SELECT count(date) AS dated, count(*) FILTER (date > DATE '2001-01-02') AS future, count(*) FILTER (date < DATE '1990-01-01') AS ancient FROM sales"
_SNAP = "SELECT count(*) AS rows, quantile_cont(revenue, 0.5) FILTER (revenue <> 0) AS median_value, count(DISTINCT {k}) AS products, min(date) AS first_date, max(date) AS last_date FROM {t}"
SQL["quality_vs_snapshot"] = f"""WITH {SALES}, early AS (SELECT * FROM sales WHERE date < DATE '1998-01-01'), n AS ({_SNAP.format(k='product', t='early')}), o AS ({_SNAP.format(k='product', t='sales')})
SELECT code FROM (SELECT unnest([CASE WHEN n.rows / o.rows - 1 <= -0.5 THEN 'row_count_collapse' WHEN n.rows / o.rows - 1 <= -0.25 THEN 'row_count_drop' END,
  CASE WHEN n.median_value / o.median_value > 3 OR n.median_value / o.median_value < 1 / 3.0 THEN 'distribution_shift' WHEN n.median_value / o.median_value > 1.6 OR n.median_value / o.median_value < 1 / 1.6 THEN 'value_shift' END,
  CASE WHEN n.last_date < o.last_date THEN 'history_went_backwards' END]) AS code FROM n, o) WHERE code IS NOT NULL"""
SQL["snapshot"] = f"WITH {SALES}, x AS ({_SNAP.format(k='category', t='sales')}) SELECT rows, {_r('median_value')} AS median_value, products, first_date, last_date FROM x"
SQL["label_folding"] = """WITH l AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN replace(o_orderpriority, '-', '_') WHEN 2 THEN ' ' || lower(o_orderpriority) ELSE o_orderpriority END AS label FROM orders),
r AS (SELECT trim(label) AS raw, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(raw), '[_\\-/]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM r)
SELECT key, raw, n, first(raw) OVER (PARTITION BY key ORDER BY n DESC, raw) AS label FROM k""".replace("\\\\", "\\")
SQL["numeric_parse"] = f"SELECT p_partkey, {_r('CASE p_partkey % 6 WHEN 3 THEN NULL WHEN 1 THEN -round(p_retailprice, 2) WHEN 4 THEN -round(p_retailprice, 2) ELSE round(p_retailprice, 2) END')} AS value FROM part"
SQL["date_ambiguity"] = """SELECT '/' AS separator, CASE WHEN max(day(o_orderdate)) > 12 THEN true END AS day_first FROM orders"""
SQL["cost_basis_cv"] = f"WITH {SALES} SELECT {_r('stddev_samp(cost / quantity * quantity / revenue) / avg(cost / quantity * quantity / revenue)')} AS per_unit_cv, {_r('stddev_samp(cost / quantity / revenue) / avg(cost / quantity / revenue)')} AS line_cv FROM sales"
SQL["revenue_corroboration"] = f"WITH {SALES}, r AS (SELECT quantile_cont(revenue / (quantity * unit_price), 0.5) AS ratio FROM sales) SELECT {_r('ratio')} AS ratio, ratio BETWEEN 0.8 AND 1.25 AS matches FROM r"
SQL["column_profile"] = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(DISTINCT {c}) AS \"distinct\", {_r(f"avg(({c} IS NULL OR trim({c}::VARCHAR) = '')::INT)")} AS blank_rate, {'1.0' if c in ('c_custkey', 'c_acctbal') else '0.0'}::DOUBLE AS numeric_rate FROM customer" for c in ("c_custkey", "c_name", "c_mktsegment", "c_acctbal"))
SQL["alert_dedupe"] = """WITH a AS (SELECT event_type AS kind, ['high', 'medium', 'low'][event_id % 3 + 1] AS level, 'u' || user_id AS subject, CAST(ts AS DATE) AS period, event_id AS seq, substring(sha256(event_type || '|u' || user_id || '|' || CAST(ts AS DATE)::VARCHAR), 1, 16) AS key FROM events),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1)
SELECT kind, level, subject, period, seq, key FROM f WHERE key NOT IN (SELECT key FROM a WHERE seq < 500) ORDER BY CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, seq LIMIT 6"""
SQL["story_rank"] = f"""WITH {SALES}, t AS (SELECT category, {_sum('profit')} / {_sum('revenue')} AS margin FROM sales GROUP BY ALL), i AS (SELECT category AS id, margin, round(abs(margin - avg(margin) OVER ()), 6) AS importance FROM t),
s AS (SELECT id, CASE WHEN margin < 0.5 THEN 'URGENT' WHEN margin < 0.55 THEN 'WATCH' ELSE 'NEUTRAL' END AS severity, importance + CASE WHEN margin < 0.5 THEN 0.15 WHEN margin < 0.55 THEN 0.08 ELSE 0 END AS score FROM i)
SELECT id, severity, {_r('score')} AS score, row_number() OVER (ORDER BY score DESC, id) AS position FROM s"""
SQL["directive_guard"] = "SELECT conv_id, turn, " + " + ".join(f"coalesce(regexp_matches(lower(text), '{p}')::BIGINT, NULL)" for p in DIRECTIVES) + " AS reasons FROM conversations"
SQL["number_tokens"] = r"""SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9][0-9,]*\.?[0-9]*'), lambda t: CASE WHEN contains(t, '.') THEN rtrim(rtrim(replace(t, ',', ''), '0'), '.') ELSE replace(t, ',', '') END), '|') AS numbers FROM conversations"""


def _route(name: str) -> str:
    words = ROUTES[name][0]
    hits = " + ".join(f"contains(q, '{w}')::INT" for w in words)
    longest = "greatest(0, " + ", ".join(f"CASE WHEN contains(q, '{w}') THEN {len(w)} ELSE 0 END" for w in words) + ")"
    return f"SELECT key, '{name}' AS route, ({hits}) + ({longest}) / 100 AS score FROM c"


SQL["keyword_routing"] = f"""WITH c AS (SELECT conv_id || '/' || turn AS key, conv_id, turn, lower(text) AS q FROM conversations WHERE text IS NOT NULL), s AS ({" UNION ALL ".join(f"(SELECT rid, route, score FROM ({_route(n).replace('SELECT key', 'SELECT rid, key')}))" for n in ROUTES)}),
b AS (SELECT rid, max(score) AS score FROM s GROUP BY rid), w AS (SELECT s.rid, max(route) AS route, b.score FROM s JOIN b ON s.rid = b.rid AND s.score = b.score WHERE b.score > 0 GROUP BY ALL)
SELECT key, route, {_r('least(0.4 + 0.15 * score, 0.75)')} AS confidence FROM w JOIN c USING (rid)""".replace("SELECT conv_id || '/' || turn AS key, conv_id", "SELECT row_number() OVER () AS rid, conv_id || '/' || turn AS key, conv_id")
SQL["first_sentences"] = f"WITH {SALES} SELECT DISTINCT category, 'It sold 1.5 times.' AS sentence FROM sales"
SQL["quality_issues"] = """WITH raw AS (SELECT CASE WHEN l_returnflag <> 'R' THEN CAST(o_orderdate AS DATE) END AS d, l_partkey AS p, l_extendedprice AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
dup AS (SELECT sum(k) AS n_rows, sum(k - 1) AS extra FROM (SELECT count(*) AS k FROM raw GROUP BY d, p, v)),
one AS (SELECT greatest(avg((d IS NULL)::INT), avg((p IS NULL)::INT), avg((v IS NULL)::INT)) AS blank, count(d) AS dated, count(*) FILTER (d > DATE '2001-08-02') AS future, count(*) FILTER (d < DATE '1990-01-01') AS ancient,
        count(v) AS n, count(*) FILTER (v < 0) / count(v) AS negative, count(*) FILTER (v = 0) / count(v) AS zero FROM raw),
m AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month, count(*) AS k FROM raw WHERE d IS NOT NULL GROUP BY ALL),
span AS (SELECT sum(k) AS dated_rows, count(*) AS months, datediff('month', min(month), max(month)) AS span, quantile_cont(k, 0.5) AS middle FROM m),
dbl AS (SELECT count(*) AS doubled FROM m, span WHERE k > 1.85 * middle AND dated_rows >= 90 AND months >= 4),
codes AS (SELECT unnest([
  {'code': 'duplicate_rows', 'severity': CASE WHEN extra >= 0.1 * n_rows THEN 'BLOCK' WHEN extra >= 0.01 * n_rows THEN 'WARN' WHEN extra > 0 THEN 'INFO' END},
  {'code': 'null_spike', 'severity': CASE WHEN blank >= 0.3 THEN 'BLOCK' WHEN blank >= 0.1 THEN 'WARN' END},
  {'code': 'no_dates', 'severity': CASE WHEN dated = 0 THEN 'BLOCK' END},
  {'code': 'future_dates', 'severity': CASE WHEN future > 0.05 * dated THEN 'BLOCK' WHEN future > 0 THEN 'WARN' END},
  {'code': 'ancient_dates', 'severity': CASE WHEN ancient > 0 THEN 'WARN' END},
  {'code': 'date_gaps', 'severity': CASE WHEN dated_rows >= 60 AND span >= 3 AND span + 1 - months > 1 THEN 'BLOCK' WHEN dated_rows >= 60 AND span >= 3 AND span + 1 > months THEN 'WARN' END},
  {'code': 'duplicated_period', 'severity': CASE WHEN dated_rows >= 60 AND span >= 3 AND doubled > 0 THEN 'WARN' END},
  {'code': 'no_values', 'severity': CASE WHEN n = 0 THEN 'BLOCK' END},
  {'code': 'mostly_negative', 'severity': CASE WHEN negative > 0.25 THEN 'BLOCK' END},
  {'code': 'some_negative', 'severity': CASE WHEN negative > 0 AND negative <= 0.25 THEN 'INFO' END},
  {'code': 'mostly_zero', 'severity': CASE WHEN zero > 0.5 THEN 'WARN' END}]) AS x FROM dup, one, span, dbl)
SELECT x.code AS code, x.severity AS severity FROM codes WHERE x.severity IS NOT NULL"""
SQL["level_shift"] = f"""WITH {SALES}, {_spine('revenue', 'm')}, t AS (SELECT count(*) FILTER (NOT late) AS n0, count(*) FILTER (late) AS n1, avg(value) FILTER (NOT late) AS m0, avg(value) FILTER (late) AS m1, var_samp(value) FILTER (NOT late) AS v0, var_samp(value) FILTER (late) AS v1
FROM (SELECT value, period >= DATE '1998-01-01' AS late FROM m))
SELECT n0 AS n_before, n1 AS n_after, {_r('m0')} AS mean_before, {_r('m1')} AS mean_after, {_r('(m1 - m0) / sqrt(v0 / n0 + v1 / n1)')} AS t,
       {_r('(v0 / n0 + v1 / n1) * (v0 / n0 + v1 / n1) / (v0 / n0 * v0 / n0 / (n0 - 1) + v1 / n1 * v1 / n1 / (n1 - 1))')} AS df FROM t"""
SQL["median_gap"] = f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT datediff('day', lag(d) OVER (ORDER BY d), d) AS days FROM d)
SELECT {_r('quantile_cont(days, 0.5)')} AS median_days, count(*) AS gaps FROM g WHERE days IS NOT NULL"""


def _profile(c: str, numeric: bool) -> str:
    """One column's profile; columns of this table are whole, numbers of one kind, texts without dates."""
    x, v = f"{c}::DOUBLE", f"{c}::VARCHAR"
    number = lambda sql: sql if numeric else "0.0"
    return f"""SELECT '{c}' AS "column", count(*) AS n_total, count({c}) AS n_present, {_r(number("1.0"))} AS numeric_rate, 0.0::DOUBLE AS datetime_rate, false AS was_percent, {number(f"avg(({x} BETWEEN 20000 AND 60000 AND {x} = floor({x}))::INT) >= 0.9") if numeric else "false"} AS was_serial,
count(DISTINCT {c}) AS n_unique, {_r(f"count(DISTINCT {c}) / count({c})")} AS uniqueness, {_r(f"(SELECT max(k) FROM (SELECT count(*) AS k FROM customer GROUP BY {c})) / count({c})")} AS top_value_share,
{_r(number(f"avg(({x} = floor({x}))::INT)") if numeric else "0.0")} AS integer_rate, {_r(number(f"avg(({x} > 0)::INT)") if numeric else "0.0")} AS positive_rate, {_r(number(f"avg(({x} = 0)::INT)") if numeric else "0.0")} AS zero_rate, {_r(number(f"avg(({x} < 0)::INT)") if numeric else "0.0")} AS negative_rate,
{_r(f"quantile_cont(abs({x}), 0.5) FILTER ({x} <> 0)" if numeric else "0.0")} AS median_abs, {_r(f"max(abs({x}))" if numeric else "0.0")} AS max_abs, {f"count(DISTINCT {c})" if numeric else "0"} AS numeric_n_unique,
{_r(f"avg(length({v}))")} AS avg_text_len, max(length({v})) AS max_text_len, NULL::DATE AS date_min, NULL::DATE AS date_max, 0 AS date_span_days, {_r(f"1 - count({c}) / count(*)")} AS blank_rate, count({c}) = 0 AS is_empty, count(DISTINCT {c}) = 1 AS is_constant FROM customer"""


SQL["column_profile_full"] = " UNION ALL ".join(_profile(c, n) for c, n in (("c_custkey", True), ("c_name", False), ("c_mktsegment", False), ("c_acctbal", True)))


def _t_p(t: str, df: str, steps: int = 2000) -> str:
    """Student's two-sided probability by Simpson's rule over the angle: 1 - c * integral of cos(x) ** (df - 1)."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    weights = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * power(cos(i * {angle} / {steps}), ({df}) - 1)))"
    return f"greatest(0.0, 1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {angle} / {3 * steps} * {weights})"


def _adjusted(table: str, order: str) -> str:
    """CTEs ranked, done: the table with adjusted, by Benjamini and Hochberg."""
    return f"""ranked AS (SELECT *, row_number() OVER (ORDER BY p, {order}) AS k, count(*) OVER () AS tests FROM {table}),
done AS (SELECT *, least(1.0, min(p * tests / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted FROM ranked)"""


_SE = "abs(slope / t)"
SQL["trend_test"] = f"""{SQL["trend_regression"].rsplit("SELECT", 1)[0]} SELECT n, {_r('slope')} AS slope, {_r('mean_y')} AS mean_y, {_r(_SE)} AS se, {_r('r2')} AS r2, {_r('t')} AS t, {_r('slope / abs(mean_y)')} AS effect,
{_r('slope * (n - 1) / abs(mean_y)')} AS fitted_change, {_r(_t_p('t', '(n - 2)'))} AS p FROM ols"""
SQL["price_response_tests"] = f"""{SQL["price_elasticity"].rsplit("SELECT", 1)[0]}, u AS (SELECT *, {_t_p('t', '(n - 2)')} AS p FROM ols JOIN sp USING (category) WHERE n >= 6 AND v >= 0.05 AND t IS NOT NULL), {_adjusted('u', 'category')}
SELECT category, n, {_r('slope')} AS slope, {_r('mean_y')} AS mean_y, {_r(_SE)} AS se, {_r('r2')} AS r2, {_r('t')} AS t, {_r('v')} AS price_variation, true AS usable, {_r('p')} AS p, {_r('adjusted')} AS adjusted, adjusted < 0.05 AND abs(slope) >= 0.3 AS responds FROM done"""
SQL["product_relationship_tests"] = f"""{SQL["product_correlation"].rsplit("SELECT a.category", 1)[0]}, c AS (SELECT a.category AS a, b.category AS b, count(*) AS n, corr(a.value, b.value) AS r FROM f a JOIN f b ON a.period = b.period AND a.category < b.category GROUP BY ALL),
u AS (SELECT *, {_t_p('(r * sqrt((n - 2) / greatest(1 - r * r, 1e-15)))', '(n - 2)')} AS p FROM c WHERE r IS NOT NULL), {_adjusted('u', 'a, b')}
SELECT a, b, n, {_r('r')} AS r, {_r('p')} AS p, {_r('adjusted')} AS adjusted, adjusted < 0.05 AND abs(r) >= 0.5 AS related FROM done"""


def _below(x: str, density: str, steps: int = 4000) -> str:
    """The integral of a density of `v` from 0 to x by Simpson's rule."""
    return f"({x}) / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * ({density.replace('v', f'(i * ({x}) / {steps})')})))"


_F_DENSITY = "exp(lgamma((df1 + df2) / 2) - lgamma(df1 / 2) - lgamma(df2 / 2)) * power(df1 / df2, df1 / 2) * power(v, df1 / 2 - 1) * power(1 + df1 * v / df2, -(df1 + df2) / 2)"
_CHI_DENSITY = "exp(-v / 2 - lgamma(df / 2.0)) * power(v, df / 2.0 - 1) / power(2, df / 2.0)"
_MIX = {d: SQL["product_mix_chi2"].replace("region AS level", f"{d} AS level").rsplit("SELECT round(sum(power", 1)[0] + f"SELECT '{d}' AS dimension, sum(power(n - expected, 2) / expected) AS chi2, (count(DISTINCT level) - 1) * (count(DISTINCT item) - 1) AS df, avg((expected < 5)::INT) AS small_share FROM x" for d in ("channel", "region", "group_segment")}
SQL["segmentation_tests"] = f"""{SQL["segment_anova_stats"].rsplit("SELECT dimension, levels", 1)[0]}, s AS (SELECT dimension, levels, rows::BIGINT AS rows, ((ss - s * s / rows) / (levels - 1)) / (within / (rows - levels)) AS statistic, (levels - 1)::DOUBLE AS df1, (rows - levels)::DOUBLE AS df2, (high - low) / abs(s / rows) AS effect FROM g WHERE levels BETWEEN 3 AND 12),
u AS (SELECT *, greatest(0.0, 1 - {_below('statistic', _F_DENSITY)}) AS p FROM s), {_adjusted('u', 'dimension')},
mixes AS (SELECT dimension, CASE WHEN small_share <= 0.2 THEN greatest(0.0, 1 - {_below('chi2', _CHI_DENSITY)}) END AS mix_p FROM ({" UNION ALL ".join(f"SELECT * FROM ({x})" for x in _MIX.values())}))
SELECT dimension, levels, rows, {_r('statistic')} AS statistic, df1, df2, {_r('effect')} AS effect, {_r('p')} AS p, {_r('adjusted')} AS adjusted, {_r('mix_p')} AS mix_p, coalesce(mix_p < 0.05, false) AS confounded FROM done LEFT JOIN mixes USING (dimension)"""


def _forms(x: str) -> str:
    """The ways a text may write a number."""
    plain = lambda y, d: f"CAST(CAST({y} AS DECIMAL(38,{d})) AS VARCHAR)" if not d else f"rtrim(rtrim(CAST(CAST({y} AS DECIMAL(38,{d})) AS VARCHAR), '0'), '.')"
    return ", ".join(plain(y, d) for y in (f"abs({x})", f"abs({x}) * 100", f"abs({x}) / 1e3", f"abs({x}) / 1e6") for d in (0, 1, 2))


SQL["answer_checks"] = rf"""WITH c AS (SELECT o_custkey AS k, count(*) AS orders, {_sum('o_totalprice')} AS spend, max(o_totalprice) AS largest, {_sum('CASE WHEN year(o_orderdate) >= 1996 THEN o_totalprice ELSE -o_totalprice END')} AS change FROM orders GROUP BY ALL),
f AS (SELECT *, 'House Q' || k AS name, orders >= 10 AS sure, k % 2 = 0 AS splits, list_concat([{_forms('orders')}], [{_forms('change')}], [{_forms('spend')}], [{_forms('largest')}], [CAST(k AS VARCHAR), CAST(orders AS VARCHAR)]) AS allowed FROM c),
a AS (SELECT *, CASE k % 9 WHEN 0 THEN name || ' placed ' || orders || ' orders worth ' || CAST(round(spend) AS BIGINT) || '.' WHEN 1 THEN name || ' possibly placed ' || (orders + 1) || ' orders.' WHEN 2 THEN 'It seems House Q' || (k + 1000000) || ' leads.'
  WHEN 3 THEN 'Orders of ' || name || ' may have moved because prices did.' WHEN 4 THEN CASE WHEN change > 0 THEN 'It fell, as it seems.' ELSE 'It rose, as it seems.' END WHEN 5 THEN 'It may be that you should order more.'
  WHEN 6 THEN name || ' may lead.' WHEN 7 THEN '   ' ELSE CASE WHEN k % 2 = 0 THEN 'There may be nothing about candles.' ELSE 'Candles may do well.' END END AS text FROM f),
labels AS (SELECT lower(name) AS label, string_split(lower(name), ' ') AS w FROM f),
runs AS (SELECT k, unnest(list_distinct(regexp_extract_all(text, '[A-Z][A-Za-z0-9]*(?: [A-Z][A-Za-z0-9]*)+'))) AS name FROM a WHERE k % 9 NOT IN (6, 7)),
names AS (SELECT k, name FROM runs WHERE NOT EXISTS (SELECT 1 FROM labels WHERE list_has_all(string_split(lower(runs.name), ' '), w) OR list_has_all(w, string_split(lower(runs.name), ' ')))),
p AS (SELECT k, 'empty' AS p FROM a WHERE trim(text) = '' UNION ALL SELECT k, 'uncited' FROM a WHERE k % 9 = 6 UNION ALL SELECT k, 'name:' || name FROM names
  UNION ALL SELECT k, 'number:' || n FROM (SELECT k, allowed, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS n FROM a WHERE k % 9 NOT IN (6, 7)) WHERE NOT list_contains(allowed, n)
  UNION ALL SELECT k, CASE WHEN text LIKE '%rose%' THEN 'direction:up' ELSE 'direction:down' END FROM a WHERE k % 9 = 4 AND change <> 0
  UNION ALL SELECT k, 'cause' FROM a WHERE text LIKE '%because%' AND NOT splits UNION ALL SELECT k, 'certainty' FROM a WHERE k % 9 = 0 AND NOT sure
  UNION ALL SELECT k, 'absent:candles' FROM a WHERE text LIKE 'Candles%' UNION ALL SELECT k, 'advice' FROM a WHERE text LIKE '%you should%')
SELECT CAST(c.k AS VARCHAR) AS answer_id, count(p) = 0 AS shown, coalesce(string_agg(p, ', ' ORDER BY p), '') AS problems FROM c LEFT JOIN p ON p.k = c.k GROUP BY c.k"""


def _spread(x: str) -> str:
    return f"CASE WHEN avg({x}) > 0 AND avg({x}) <= 1.5 THEN stddev_samp({x}) / avg({x}) END"


SQL["cost_basis"] = f"""WITH {SALES}, g AS (SELECT 'unit' AS given, cost / quantity AS c, quantity, revenue FROM sales UNION ALL SELECT 'line', cost, quantity, revenue FROM sales),
v AS (SELECT given, {_spread('c * quantity / revenue')} AS u, {_spread('c / revenue')} AS l FROM g GROUP BY given)
SELECT given, {_r('u')} AS cv_unit, {_r('l')} AS cv_line, CASE WHEN coalesce(l, 'inf'::DOUBLE) < coalesce(u, 'inf'::DOUBLE) THEN 'line' ELSE 'per_unit' END AS basis FROM v"""
