"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from tagwatch.functions.titles import COLOURS, NOISE


def r(x: str, digits: int = 2) -> str:
    scale = 10**digits
    return f"floor(({x})*{scale}+0.5)/{float(scale)}"


def pct(a: str, b: str) -> str:
    return f"(({a})/nullif({b},0)*100)"


def cents(x: str) -> str:
    return f"CAST(round(({x})*100) AS BIGINT)"


def avg(x: str, over: str = "", where: str = "") -> str:
    """Average of prices of two decimals, exact."""
    return f"(CAST(sum({cents(x)}){where}{over} AS DOUBLE)/nullif(CAST(count({x}){where}{over} AS DOUBLE)*100.0,0))"


CAL = """cal AS (
  SELECT CAST(year(d)*10000+month(d)*100+day(d) AS INTEGER) AS date_key, d AS date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
         CAST(month(d) AS INTEGER) AS month, strftime(d,'%B') AS month_name, CAST(day(d) AS INTEGER) AS day, CAST(isodow(d) AS INTEGER) AS day_of_week, strftime(d,'%A') AS day_name,
         CAST(isodow(d)>=6 AS INTEGER) AS is_weekend,
         (SELECT name FROM win WHERE d BETWEEN a AND b ORDER BY k LIMIT 1) AS festival_window,
         CAST(EXISTS (SELECT 1 FROM win WHERE d BETWEEN a AND b) AS INTEGER) AS is_festival,
         CAST(CASE WHEN EXISTS (SELECT 1 FROM win WHERE d BETWEEN a AND b) THEN 0 ELSE -(SELECT min(a) - d FROM win WHERE a > d) END AS INTEGER) AS days_to_festival
  FROM (SELECT CAST(range AS DATE) AS d FROM range(DATE '2024-01-01', DATE '2024-04-01', INTERVAL 1 DAY))
)"""
WIN = "win(k, name, a, b) AS (VALUES (1, 'New Year sale', DATE '2024-01-01', DATE '2024-01-05'), (2, 'Republic Day sale', DATE '2024-01-18', DATE '2024-01-26'))"
OBS = f"""obs AS (
  SELECT listing_id, listing_id % 50 AS product_id, listing_id % 5 AS seller_id, 'site' || (listing_id % 5) AS site_key, 'item ' || listing_id AS title,
         'category' || (listing_id % 4) AS category, obs_date, CAST(year(obs_date)*10000+month(obs_date)*100+day(obs_date) AS INTEGER) AS date_key, selling_price, mrp,
         CASE WHEN selling_price <> 0 AND mrp <> 0 AND mrp >= selling_price THEN {r('(mrp-selling_price)/mrp*100')} END AS computed_discount_pct,
         CASE WHEN listing_id % 10 = 9 THEN 'wayback' ELSE 'live' END AS source
  FROM (SELECT user_id AS listing_id, CAST(ts AS DATE) AS obs_date, {r(avg('value'))} AS selling_price, max(value) AS mrp FROM events GROUP BY 1, 2)
)"""
BASE = f"WITH {WIN}, {CAL}, {OBS}"
S = "(PARTITION BY listing_id ORDER BY date_key)"
ROWS = lambda a, b: f"(PARTITION BY listing_id ORDER BY date_key ROWS BETWEEN {a} PRECEDING AND {b})"

ORACLES: dict[str, str] = {}
ORACLES["calendar_dim"] = f"WITH {WIN}, {CAL} SELECT * FROM cal"

_T = ROWS(30, "1 PRECEDING")
ORACLES["price_timeline"] = f"""{BASE}, w AS (
  SELECT o.*, c.is_festival, c.festival_window, lag(selling_price) OVER {S} AS prev_price, lag(obs_date) OVER {S} AS prev_date, min(selling_price) OVER {_T} AS low,
         max(selling_price) OVER {_T} AS high, {avg('selling_price', f' OVER {_T}')} AS mean, count(*) OVER (PARTITION BY listing_id) AS n_observations
  FROM obs o JOIN cal c USING (date_key) WHERE source = 'live'
)
SELECT listing_id, product_id, site_key, title, category, obs_date, is_festival, festival_window, selling_price, mrp, computed_discount_pct, prev_price,
       {r('selling_price-prev_price')} AS price_delta, {r(pct('selling_price-prev_price', 'prev_price'))} AS price_delta_pct, CAST(obs_date - prev_date AS INTEGER) AS days_since_prev,
       {r('low')} AS trailing_min_30, {r('high')} AS trailing_max_30, {r('mean')} AS trailing_avg_30, {r(pct('selling_price-low', 'low'))} AS premium_over_trailing_min_pct, n_observations
FROM w"""

_P, _B = ROWS(21, "1 PRECEDING"), ROWS(45, "22 PRECEDING")
CANDIDATES = f"""base AS (
  SELECT o.*, c.is_festival, lag(selling_price) OVER {S} AS prev, max(selling_price) OVER {_P} AS peak, {avg('selling_price', f' OVER {_B}')} AS level,
         count(*) OVER (PARTITION BY listing_id ORDER BY date_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_prior_observations
  FROM obs o JOIN cal c USING (date_key)
), told AS (
  SELECT listing_id, site_key, title, category, obs_date AS sale_date, is_festival, {r('level')} AS baseline_price, {r('peak')} AS peak_price, selling_price AS sale_price,
         {r(pct('peak-level', 'level'))} AS rise_pct, {r(pct('peak-selling_price', 'peak'))} AS claimed_discount_pct, {r(pct('level-selling_price', 'level'))} AS real_discount_pct, n_prior_observations
  FROM base WHERE n_prior_observations >= 25 AND {pct('prev-selling_price', 'prev')} >= 8 AND {pct('peak-level', 'level')} >= 10
), cand AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY overstatement_pp DESC, sale_date) AS INTEGER) AS rn
  FROM (SELECT *, {r('claimed_discount_pct-real_discount_pct')} AS overstatement_pp FROM told WHERE claimed_discount_pct > real_discount_pct)
)"""
ORACLES["inflation_candidates_sql"] = f"{BASE}, {CANDIDATES} SELECT * FROM cand"
ORACLES["inflation_candidates_top1"] = f"{BASE}, {CANDIDATES} SELECT * FROM cand WHERE rn = 1"


def events(rise: float, hold: int) -> str:
    return f"""pts AS (
  SELECT *, lag(selling_price) OVER {S} AS prev, count(*) OVER (PARTITION BY listing_id) AS n_observations FROM obs
), sharp AS (
  SELECT * FROM pts WHERE n_observations >= 10 AND prev > 0 AND {pct('prev-selling_price', 'prev')} >= {rise}
), seen AS (
  SELECT s.listing_id, s.obs_date AS sale_start, p.obs_date AS day, p.selling_price AS price, max(p.selling_price) OVER w AS top, count(*) OVER w AS n
  FROM sharp s JOIN obs p ON p.listing_id = s.listing_id AND p.obs_date < s.obs_date AND s.obs_date - p.obs_date <= 21 WINDOW w AS (PARTITION BY s.listing_id, s.obs_date)
), raised AS (
  SELECT *, min(day) FILTER (price >= top*0.98) OVER w AS rise_start, max(day) FILTER (price >= top*0.98) OVER w AS last FROM seen WHERE n >= 4 AND top > 0
  WINDOW w AS (PARTITION BY listing_id, sale_start)
), based AS (
  SELECT listing_id, sale_start, top, rise_start, last - rise_start + 1 AS hold_days, median(price) FILTER (day < rise_start) AS base, count(*) FILTER (day < rise_start) AS n_before
  FROM raised GROUP BY ALL
), told AS (
  SELECT s.listing_id, s.product_id, s.site_key, s.title, {r('base')} AS baseline_price, {r('top')} AS peak_price, {r('selling_price')} AS sale_price, {r('(top-base)/base*100')} AS rise_pct,
         CAST(hold_days AS INTEGER) AS hold_days, rise_start, b.sale_start, CAST(b.sale_start - rise_start AS INTEGER) AS days_between, {r('(top-selling_price)/top*100')} AS claimed_discount_pct,
         {r('(base-selling_price)/base*100')} AS real_discount_pct, {r('(top-selling_price)/top*100-(base-selling_price)/base*100')} AS overstatement_pp, n_observations
  FROM based b JOIN sharp s ON s.listing_id = b.listing_id AND s.obs_date = b.sale_start
  WHERE n_before >= 2 AND base > 0 AND (top-base)/base*100 >= {rise} AND hold_days >= {hold}
), ev AS (
  SELECT * EXCLUDE (rank), CASE WHEN points >= 5 THEN 'high' WHEN points >= 3 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY overstatement_pp DESC, sale_start) AS rank,
               CASE WHEN rise_pct >= 20 THEN 2 WHEN rise_pct >= 12 THEN 1 ELSE 0 END + CASE WHEN hold_days >= 7 THEN 2 WHEN hold_days >= 4 THEN 1 ELSE 0 END
               + CAST(n_observations >= 30 AS INTEGER) + CAST(overstatement_pp >= 15 AS INTEGER) + CAST(sale_price <= baseline_price*1.02 AS INTEGER) AS points FROM told) WHERE rank = 1
), e AS (SELECT * EXCLUDE (points) FROM ev)"""


EV, EV_LOOSE = events(10.0, 3), events(3.0, 1)
ORACLES["inflation_events"] = f"{BASE}, {EV} SELECT * FROM e"
ORACLES["inflation_events_loose"] = f"{BASE}, {EV_LOOSE} SELECT * FROM e"
_SOLID = "FILTER (confidence IN ('high','medium'))"
ORACLES["inflation_summary"] = f"""{BASE}, {EV}, s AS (
  SELECT count(*) AS n_events, count(*) FILTER (confidence='high') AS n_high_confidence, count(*) FILTER (confidence='medium') AS n_medium_confidence, count(*) FILTER (confidence='low') AS n_low_confidence,
         {r(f'median(overstatement_pp) {_SOLID}')} AS median_overstatement_pp, max(overstatement_pp) AS max_overstatement_pp, {r(f'median(claimed_discount_pct) {_SOLID}')} AS median_claimed_discount_pct,
         {r(f'median(real_discount_pct) {_SOLID}')} AS median_real_discount_pct FROM e)
SELECT s.*, n_listings, {r(pct('CAST(n_high_confidence+n_medium_confidence AS DOUBLE)', 'CAST(n_listings AS DOUBLE)'))} AS flagged_rate_pct FROM s, (SELECT count(DISTINCT listing_id) AS n_listings FROM obs)"""
ORACLES["inflation_by_site"] = f"{BASE}, {EV} SELECT site_key, count(*) AS n_events FROM e WHERE confidence IN ('high','medium') GROUP BY 1"

RG = f"""rg AS (
  SELECT l_partkey AS product_id, l_suppkey AS listing_id, r_name AS site_key, {r('l_extendedprice/nullif(l_quantity,0)')} AS mrp, {r('(' + r('l_extendedprice/nullif(l_quantity,0)') + ')*0.9')} AS selling_price,
         p_name AS canonical_title, p_brand AS brand, CAST(year(l_shipdate)*10000+101 AS INTEGER) AS date_key
  FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey JOIN part ON l_partkey=p_partkey
)"""
ORACLES["mrp_dispersion_latest"] = f"""WITH {RG}, q AS (
  SELECT product_id, site_key, min(mrp) AS mrp, min(selling_price) AS selling_price, min(canonical_title) AS canonical_title, min(brand) AS brand FROM rg WHERE mrp > 0 GROUP BY 1, 2
), m AS (SELECT product_id, median(mrp) AS mid, min(mrp) AS low, max(mrp) AS high, count(*) AS n_sellers FROM q GROUP BY 1),
k AS (SELECT q.*, mid, low, high, n_sellers, row_number() OVER (PARTITION BY product_id ORDER BY mrp DESC, site_key) AS rn FROM q JOIN m USING (product_id))
SELECT product_id, canonical_title, brand, n_sellers, {r('low')} AS min_mrp, {r('mid')} AS median_mrp, {r('high')} AS max_mrp, {r(pct('high-low', 'mid'))} AS spread_pct, site_key AS highest_quoting_site,
       {r(pct('mrp-mid', 'mid'))} AS overstatement_vs_median_pct, {r(pct('mrp-selling_price', 'mrp'))} AS claimed_discount_pct, {r(pct('mid-selling_price', 'mid'))} AS discount_vs_median_mrp_pct
FROM k WHERE rn = 1 AND n_sellers >= 3 AND {pct('high-low', 'mid')} > 2"""
CON = f"""{RG}, q AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, site_key ORDER BY listing_id, mrp) AS k FROM rg WHERE mrp > 0) WHERE k = 1
), con AS (
  SELECT product_id, min(canonical_title) AS canonical_title, count(*) AS n_sellers, min(mrp) AS min_mrp, max(mrp) AS max_mrp, median(mrp) AS mid FROM q GROUP BY 1
), worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY mrp DESC, site_key) AS rn FROM q) WHERE rn = 1),
c AS (
  SELECT product_id, con.canonical_title, n_sellers, min_mrp, max_mrp, {r('mid', 4)} AS median_mrp, {r(pct('max_mrp-min_mrp', 'mid'))} AS spread_pct, w.listing_id AS worst_listing_id, w.site_key AS worst_site_key,
         {r(pct('w.mrp-mid', 'mid'))} AS inflation_vs_median_pct
  FROM con JOIN worst w USING (product_id) WHERE n_sellers >= 3 AND mid > 0 AND {pct('max_mrp-min_mrp', 'mid')} > 2
)"""
ORACLES["mrp_contradictions"] = f"WITH {CON} SELECT * FROM c"
ORACLES["mrp_contradictions_by_site"] = f"WITH {CON} SELECT worst_site_key AS site_key, count(*) AS n_highest_quotes FROM c GROUP BY 1"
ORACLES["mrp_contradictions_summary"] = f"WITH {CON} SELECT count(*) AS n_contradictions, {r('median(spread_pct)')} AS median_spread_pct, max(spread_pct) AS max_spread_pct, {r(avg('inflation_vs_median_pct'))} AS mean_overstatement_pct FROM c"

CRED = f"""rows_ AS (
  SELECT * FROM obs o WHERE date_key = (SELECT max(date_key) FROM obs i WHERE i.listing_id = o.listing_id) AND mrp > 0 AND selling_price IS NOT NULL
), vals AS (SELECT site_key, mrp, count(*) AS n, row_number() OVER (PARTITION BY site_key ORDER BY count(*) DESC, mrp) AS place FROM rows_ GROUP BY 1, 2),
top AS (
  SELECT site_key, CAST(sum(n) AS BIGINT) AS n_products, count(*) AS n_distinct_mrp, CAST(sum(n) FILTER (place <= 5) AS DOUBLE) AS top5,
         CAST(coalesce(sum(n) FILTER (CAST(round_even(mrp, 0) AS BIGINT) % 100 = 99), 0) AS DOUBLE) AS n99 FROM vals GROUP BY 1
), dis AS (SELECT site_key, median(computed_discount_pct) AS mid, min(computed_discount_pct) AS low, max(computed_discount_pct) AS high FROM rows_ GROUP BY 1),
prof AS (
  SELECT site_key, n_products, n_distinct_mrp, {r('n_distinct_mrp/CAST(n_products AS DOUBLE)', 4)} AS diversity_ratio, {r('top5/n_products', 4)} AS top5_concentration, {r('n99/n_products', 4)} AS round_number_rate,
         coalesce({r('mid')}, 0.0) AS median_discount_pct, coalesce({r('low')}, 0.0) AS min_discount_pct, coalesce({r('high')}, 0.0) AS max_discount_pct
  FROM top JOIN dis USING (site_key)
), p AS (
  SELECT *, CASE WHEN n_products < 20 THEN 'insufficient' WHEN diversity_ratio < 0.35 AND top5_concentration > 0.50 THEN 'inconsistent with product-specific pricing'
                 WHEN diversity_ratio < 0.60 THEN 'unusually concentrated' ELSE 'consistent with product-specific pricing' END AS verdict FROM prof
)"""
ORACLES["mrp_credibility"] = f"{BASE}, {CRED} SELECT * FROM p"
ORACLES["mrp_credibility_compare"] = f"""{BASE}, {CRED}, f AS (SELECT * FROM p ORDER BY diversity_ratio, site_key LIMIT 1), l AS (SELECT * FROM p ORDER BY diversity_ratio DESC, site_key DESC LIMIT 1)
SELECT (SELECT count(*) FROM p) AS n_retailers, f.site_key AS least_credible, l.site_key AS most_credible, {r('l.diversity_ratio-f.diversity_ratio', 3)} AS diversity_gap,
       {r('f.median_discount_pct-l.median_discount_pct', 1)} AS discount_gap_pp, CAST(NULL AS VARCHAR) AS note FROM f, l"""
ORACLES["mrp_most_repeated"] = f"""{BASE}, rows_ AS (
  SELECT * REPLACE (CAST(ceil(mrp/50)*50 AS DOUBLE) AS mrp) FROM obs o WHERE source = 'live' AND date_key = (SELECT max(date_key) FROM obs i WHERE i.listing_id = o.listing_id AND i.source = 'live') AND mrp > 0 AND selling_price IS NOT NULL
)
SELECT * FROM (SELECT site_key, mrp, count(*) AS n, CAST(row_number() OVER (PARTITION BY site_key ORDER BY count(*) DESC, mrp) AS INTEGER) AS place FROM rows_ GROUP BY 1, 2) WHERE place <= 6 AND n > 1"""

CL = "cl AS (SELECT user_id AS listing_id, 'site' || (user_id % 5) AS site_key, event_type AS pattern_type, ts AS tm, event_id AS seq, CAST(floor(value/100) AS DOUBLE) AS v FROM events)"
SCARCE = f"""WITH {CL}, ch AS (
  SELECT *, lag(v) OVER w AS prev, row_number() OVER w AS first FROM cl WHERE v IS NOT NULL WINDOW w AS (PARTITION BY listing_id, site_key, pattern_type ORDER BY tm, seq)
), isl AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR v <> prev THEN 1 ELSE 0 END) OVER w AS island, nullif(sign(v-prev), 0) AS sgn FROM ch WINDOW w AS (PARTITION BY listing_id, site_key, pattern_type ORDER BY tm, seq)
), tr AS (
  SELECT *, CASE WHEN sgn <> last_value(sgn IGNORE NULLS) OVER (PARTITION BY listing_id, site_key, pattern_type ORDER BY tm, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS turn FROM isl
), runs AS (SELECT listing_id, site_key, pattern_type, island, count(*) AS run FROM tr GROUP BY ALL),
mode_ AS (
  SELECT listing_id, site_key, pattern_type, v AS mode FROM (
    SELECT listing_id, site_key, pattern_type, v, row_number() OVER (PARTITION BY listing_id, site_key, pattern_type ORDER BY count(*) DESC, min(first)) AS k FROM tr GROUP BY listing_id, site_key, pattern_type, v) WHERE k = 1
), t AS (
  SELECT g.listing_id, g.site_key, g.pattern_type, g.n_days_observed, g.dist, g.turns, r.run, m.mode
  FROM (SELECT listing_id, site_key, pattern_type, count(*) AS n_days_observed, count(DISTINCT v) AS dist, CAST(sum(turn) AS BIGINT) AS turns FROM tr GROUP BY ALL) g
  JOIN (SELECT listing_id, site_key, pattern_type, max(run) AS run FROM runs GROUP BY ALL) r USING (listing_id, site_key, pattern_type) JOIN mode_ m USING (listing_id, site_key, pattern_type)
), s AS (
  SELECT listing_id, site_key, pattern_type, n_days_observed, CASE WHEN n_days_observed < 7 THEN 0 ELSE dist END AS distinct_values, CASE WHEN n_days_observed >= 7 THEN mode END AS modal_value,
         CASE WHEN n_days_observed < 7 THEN 0 ELSE run END AS longest_static_run, CASE WHEN n_days_observed < 7 THEN 0 ELSE turns END AS changed_direction_count,
         CASE WHEN n_days_observed < 7 THEN 'insufficient' WHEN dist = 1 THEN 'static' WHEN turns >= 3 THEN 'erratic' ELSE 'plausible' END AS verdict FROM t
)"""
ORACLES["scarcity_claims"] = f"{SCARCE} SELECT * FROM s"
_SHARE = lambda v: r(pct(f"CAST(count(*) FILTER (verdict='{v}') AS DOUBLE)", "CAST(count(*) AS DOUBLE)"))
ORACLES["scarcity_summary"] = f"""{SCARCE} SELECT count(*) AS n_assessed, count(*) FILTER (verdict='static') AS n_static, count(*) FILTER (verdict='erratic') AS n_erratic, {_SHARE('static')} AS pct_static,
  {_SHARE('erratic')} AS pct_erratic, max(longest_static_run) AS longest_static_run_days FROM s WHERE verdict <> 'insufficient'"""
ORACLES["scarcity_by_site"] = f"{SCARCE} SELECT site_key, count(*) AS assessed, count(*) FILTER (verdict='static') AS static, count(*) FILTER (verdict='erratic') AS erratic FROM s WHERE verdict <> 'insufficient' GROUP BY 1"
MART = f"""WITH {CL}, m AS (
  SELECT listing_id, site_key, pattern_type, count(*) AS days_observed, count(DISTINCT v) AS distinct_values, min(v) AS min_value, max(v) AS max_value,
         CASE WHEN count(*) < 7 THEN 'insufficient' WHEN count(DISTINCT v) <= 1 THEN 'static' ELSE 'moves' END AS verdict FROM cl GROUP BY 1, 2, 3)"""
ORACLES["mart_scarcity"] = f"{MART} SELECT * FROM m"
ORACLES["static_stock_claims"] = f"{MART} SELECT count(DISTINCT listing_id) AS static_claims FROM m WHERE verdict = 'static'"

_D = ROWS(30, "CURRENT ROW")
ORACLES["mart_daily_prices"] = f"""{BASE} SELECT listing_id, product_id, seller_id, date_key, site_key, category, selling_price, mrp, computed_discount_pct, source, min(selling_price) OVER {_D} AS price_min_30d,
  max(selling_price) OVER {_D} AS price_max_30d FROM obs WHERE source = 'live'"""
ORACLES["mart_collection_health"] = f"""{BASE} SELECT date_key, site_key, count(*) AS observations, count(DISTINCT listing_id) AS listings_seen, count(*) FILTER (selling_price IS NULL) AS missing_price,
  count(*) FILTER (mrp IS NULL) AS missing_mrp, {r(avg('selling_price'))} AS avg_price FROM obs WHERE source = 'live' GROUP BY 1, 2"""
ORACLES["mart_category_summary"] = f"""{BASE}, {EV} SELECT o.category, o.site_key, count(DISTINCT o.listing_id) AS listings_tracked, count(DISTINCT o.product_id) AS products_tracked,
  {r(avg('computed_discount_pct'))} AS avg_advertised_discount_pct, count(DISTINCT e.listing_id) AS flagged_events, {r(pct('CAST(count(DISTINCT e.listing_id) AS DOUBLE)', 'CAST(count(DISTINCT o.listing_id) AS DOUBLE)'))} AS pct_listings_flagged
  FROM obs o LEFT JOIN e ON e.listing_id = o.listing_id WHERE source = 'live' GROUP BY 1, 2"""
ORACLES["mart_discount_integrity"] = f"""{BASE}, {EV} SELECT *, {r('peak_price-baseline_price')} AS rupees_of_inflation, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS confidence_rank FROM e"""
ORACLES["status_by_source"] = f"{BASE} SELECT source, count(*) AS observations, min(obs_date) AS first_date, max(obs_date) AS last_date FROM obs GROUP BY 1"
ORACLES["last_14_days"] = f"{BASE} SELECT obs_date, count(*) AS observations FROM obs WHERE source = 'live' GROUP BY 1 ORDER BY 1 DESC LIMIT 14"
ORACLES["coverage_pivot"] = f"{BASE} SELECT obs_date, {', '.join(f'''count(*) FILTER (site_key = 'site{k}') AS site{k}''' for k in range(5))} FROM obs GROUP BY 1"
ORACLES["claims_describe"] = f"SELECT p_brand, count(p_retailprice) AS n, {r(avg('p_retailprice'), 4)} AS mean, median(p_retailprice) AS median, max(p_retailprice) AS max FROM part GROUP BY 1"
ORACLES["price_histogram"] = "SELECT CAST(least(greatest(floor((p_retailprice-900.0)/5.0), 0), 39) AS INTEGER) AS bin, count(*) AS n FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1"
ORACLES["panel_seed"] = f"WITH {RG} SELECT product_id, count(DISTINCT site_key) AS n_sites FROM rg GROUP BY 1 HAVING n_sites >= 4 ORDER BY n_sites DESC, product_id LIMIT 300"
ORACLES["panel_limit_per_site"] = "SELECT * FROM (SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS place FROM supplier) WHERE place <= 3"
ORACLES["discovery_status_counts"] = """SELECT CASE WHEN coalesce(l_linestatus,'') = '' OR coalesce(nullif(l_returnflag,'R'),'') = '' THEN 'skipped' WHEN nullif(l_discount,0) IS NULL THEN 'discovered' ELSE 'stored' END AS status, count(*) AS n
  FROM lineitem GROUP BY 1"""

ARR = f"""arr AS (
  SELECT user_id AS listing_id, CAST(year(ts)*10000+month(ts)*100+day(ts) AS INTEGER) AS date_key, 'live' AS source, CASE WHEN event_id % 3 <> 0 THEN value END AS selling_price,
         CASE WHEN event_id % 2 = 0 THEN {r('value*2')} END AS mrp, event_type AS rating, event_id AS seq FROM events
)"""


def merged(where: str = "true") -> str:
    return f"""SELECT listing_id, date_key, source, arg_max(selling_price, seq) FILTER (selling_price IS NOT NULL) AS selling_price, arg_max(mrp, seq) FILTER (mrp IS NOT NULL) AS mrp,
      arg_min(rating, seq) AS rating, min(seq) AS seq FROM arr WHERE {where} GROUP BY 1, 2, 3"""


ORACLES["same_day_merge"] = f"WITH {ARR} {merged()}"
ORACLES["observation_merge"] = f"""WITH {ARR}, o AS ({merged('seq % 2 = 0')}), n AS ({merged('seq % 2 = 1')})
SELECT listing_id, date_key, source, coalesce(n.selling_price, o.selling_price) AS selling_price, coalesce(n.mrp, o.mrp) AS mrp, coalesce(o.rating, n.rating) AS rating
FROM o FULL JOIN n USING (listing_id, date_key, source)"""
ORACLES["listing_upsert"] = """WITH t AS (SELECT o_orderpriority AS site_key, '/c/' || o_custkey AS url, o_orderstatus AS raw_title, CAST(o_orderdate AS DATE) AS seen, o_orderkey AS seq FROM orders)
SELECT site_key, url, arg_min(raw_title, (seen, seq)) AS raw_title, min(seen) AS first_seen_date, max(seen) AS last_seen_date, 1 AS is_active FROM t GROUP BY 1, 2"""
ORACLES["dim_product_first_wins"] = "SELECT p_name AS match_key, arg_min(p_type, p_partkey) AS category, min(p_partkey) AS seq FROM part GROUP BY 1"
ORACLES["seller_upsert"] = """SELECT DISTINCT c_mktsegment AS site_key, lower(c_mktsegment) AS site_name, CASE WHEN c_nationkey > 2 THEN 'seller ' || c_nationkey END AS seller_name,
  CASE WHEN c_nationkey > 2 THEN 0 ELSE 1 END AS is_first_party FROM customer"""

_SD = lambda a, b: f"coalesce(({a})/nullif({b},0),0)"
_F = {
    "n_observations": "n", "coef_variation": f"{_SD('sd', 'mean')}*100", "range_ratio": f"{_SD('hi-lo', 'mid')}*100", "n_price_levels_norm": _SD("CAST(levels AS DOUBLE)", "n"),
    "max_daily_rise_pct": "coalesce(up,0)", "max_daily_drop_pct": "abs(coalesce(down,0))", "n_large_moves_norm": _SD("CAST(large AS DOUBLE)", "n"), "max_rise_21d_pct": "coalesce(rise21,0)",
    "max_drop_after_rise_pct": "coalesce(drop21,0)", "frac_days_at_max": _SD("CAST(at_max AS DOUBLE)", "n"), "frac_days_at_min": _SD("CAST(at_min AS DOUBLE)", "n"),
    "time_at_elevated_frac": _SD("CAST(elevated AS DOUBLE)", "n"), "peak_to_median_pct": f"{_SD('hi-mid', 'mid')}*100", "median_to_min_pct": f"{_SD('mid-lo', 'mid')}*100",
    "rise_then_fall_score": "least(coalesce(rise21,0),coalesce(drop21,0))", "lag1_autocorr": f"CASE WHEN sd > 0 AND n > 3 THEN {_SD('cov', '(n-1)*sd*sd')} ELSE 0.0 END",
    "mean_abs_daily_change_pct": "coalesce(moved,0)", "trend_slope_norm": f"{_SD(_SD('sxy', 'sxx') + '*n', 'mean')}*100",
}
ORACLES["features_matrix"] = f"""{BASE}, pts AS (
  SELECT listing_id, site_key, title, selling_price AS p, row_number() OVER {S} - 1 AS i, lag(selling_price) OVER {S} AS prev FROM obs WHERE source = 'live'
), lv AS (SELECT listing_id, CAST(count(*) AS DOUBLE) AS n, {avg('p')} AS mean, median(p) AS mid, min(p) AS lo, max(p) AS hi FROM pts GROUP BY 1 HAVING count(*) >= 10),
x AS (SELECT *, CASE WHEN prev > 0 THEN (p-prev)/prev*100 END AS ch FROM pts JOIN lv USING (listing_id)),
a AS (
  SELECT listing_id, site_key, title, n, mean, mid, lo, hi, sqrt(sum((p-mean)*(p-mean))/n) AS sd, count(DISTINCT round_even(p/greatest(mid*0.005, 1e-9), 0)) AS levels, max(ch) FILTER (ch > 0) AS up,
         min(ch) FILTER (ch < 0) AS down, count(*) FILTER (abs(ch) >= 5) AS large, avg(abs(ch)) AS moved, count(*) FILTER (p >= hi*0.99) AS at_max, count(*) FILTER (p <= lo*1.01) AS at_min,
         count(*) FILTER (p > mid*1.05) AS elevated, sum((p-mean)*(prev-mean)) AS cov, sum((i-(n-1)/2)*(p-mean)) AS sxy, sum((i-(n-1)/2)*(i-(n-1)/2)) AS sxx
  FROM x GROUP BY listing_id, site_key, title, n, mean, mid, lo, hi
), seg AS (
  SELECT listing_id, i, list(p) OVER (PARTITION BY listing_id ORDER BY i ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS s, min(p) OVER (PARTITION BY listing_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM pts
), ro AS (
  SELECT listing_id, i, tail, list_min(s) AS low, list_max(s) AS high, (list_max(s)-list_min(s))/list_min(s)*100 AS rise FROM seg
  WHERE len(s) >= 3 AND list_min(s) > 0 AND list_position(s, list_max(s)) > list_position(s, list_min(s))
), best AS (SELECT listing_id, rise AS rise21, (high-tail)/high*100 AS drop21 FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY rise DESC, i) AS k FROM ro WHERE rise > 0) WHERE k = 1)
SELECT listing_id, site_key, title, {', '.join(f'{r(e, 4)} AS {c}' for c, e in _F.items())} FROM a LEFT JOIN best USING (listing_id)"""


def confusion(name: str, flagged: str, truth: str) -> str:
    p, q = "coalesce(CAST(tp AS DOUBLE)/nullif(n_flagged,0),0)", "coalesce(CAST(tp AS DOUBLE)/nullif(tp+fn,0),0)"
    return f"""SELECT '{name}' AS detector, n_flagged, tp, fp, fn, {r(p, 4)} AS precision, {r(q, 4)} AS recall, {r(f'coalesce(2*{p}*{q}/nullif({p}+{q},0),0)', 4)} AS f1 FROM (
      SELECT count(f) AS n_flagged, count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (f IS NULL) AS fn
      FROM (SELECT DISTINCT listing_id, 1 AS f FROM {flagged}) FULL JOIN (SELECT DISTINCT listing_id, 1 AS t FROM {truth}) USING (listing_id))"""


_BOTH = f"{BASE}, {CANDIDATES}, {EV.replace('told AS', 'told2 AS').replace('FROM told)', 'FROM told2)')}"
ORACLES["detector_confusion"] = f"{_BOTH} {confusion('candidates', '(SELECT * FROM cand WHERE rn = 1)', 'e')}"
_TRUE = "(SELECT listing_id FROM obs WHERE computed_discount_pct >= 65)"
_SETS = {
    "candidates": "cand", "events": "e", "candidates_AND_events": "(SELECT listing_id FROM cand INTERSECT SELECT listing_id FROM e)", "candidates_OR_events": "(SELECT listing_id FROM cand UNION SELECT listing_id FROM e)",
}
ORACLES["set_ops_benchmark"] = f"{_BOTH} {' UNION ALL '.join(confusion(n, s, _TRUE) for n, s in _SETS.items())}"

_Z2 = "(1.96*1.96)"
_CENTRE, _MARGIN = f"k/m+{_Z2}/(2*m)", f"1.96*sqrt(k/m*(1-k/m)/m+{_Z2}/(4*m*m))"
ORACLES["validation_precision_wilson"] = f"""WITH v AS (SELECT CASE WHEN toxic = 1 THEN 'unclear' WHEN quality = 1 THEN 'confirmed' ELSE 'rejected' END AS v FROM labels),
c AS (SELECT count(*) FILTER (v='confirmed') AS n_confirmed, count(*) FILTER (v='rejected') AS n_rejected, count(*) FILTER (v='unclear') AS n_unclear FROM v),
x AS (SELECT *, CAST(n_confirmed AS DOUBLE) AS k, nullif(CAST(n_confirmed+n_rejected AS DOUBLE), 0) AS m FROM c)
SELECT n_confirmed+n_rejected+n_unclear AS n_reviewed, n_confirmed, n_rejected, n_unclear, {r('coalesce(k/m,0)', 4)} AS precision,
       {r(f'coalesce(least(greatest(({_CENTRE}-{_MARGIN})/(1+{_Z2}/m),0.0),1.0),0.0)', 4)} AS ci_low, {r(f'coalesce(least(greatest(({_CENTRE}+{_MARGIN})/(1+{_Z2}/m),0.0),1.0),0.0)', 4)} AS ci_high FROM x"""
ORACLES["parse_price"] = "SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem"
ORACLES["parse_int"] = "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS n FROM orders"
_RAM = "[2,3,4,6,8,12,16,24][p_size % 8 + 1]"
_VARIANT = f"{_RAM} || 'gb-128gb'"
_BRAND = "CASE p_partkey % 4 WHEN 0 THEN 'samsung' WHEN 1 THEN 'apple' WHEN 3 THEN 'oneplus' END"
ORACLES["extract_variant"] = f"SELECT p_partkey, {_VARIANT} AS variant FROM part"
ORACLES["extract_brand"] = f"SELECT p_partkey, {_BRAND} AS brand FROM part"
ORACLES["jsonld_products"] = """SELECT '/p/' || p_partkey AS url, 'Item & ' || p_name AS raw_title, floor(p_retailprice) AS selling_price, CASE WHEN p_size >= 25 THEN floor(p_retailprice)+p_size-25 END AS mrp,
  CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS in_stock, p_brand AS brand FROM part"""
ORACLES["jsonld_listing"] = """SELECT p_brand AS page, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name) - 1 AS INTEGER) AS position, p_name AS name, 'https://shop.example/' || replace(p_name, ' ', '-') AS url
  FROM (SELECT DISTINCT p_brand, p_name FROM part)"""
ORACLES["modal_price"] = "SELECT '/p/' || p_partkey AS url, floor(p_retailprice) AS price FROM part"
ORACLES["state_items"] = "SELECT '/p/' || p_partkey AS url, p_name AS raw_title, floor(p_retailprice) AS selling_price, CAST(NULL AS DOUBLE) AS mrp, CAST(NULL AS VARCHAR) AS item_url FROM part"
ORACLES["css_items"] = "SELECT '/p/' || p_partkey AS url, p_name AS raw_title, '/x/' || p_partkey AS item_url, floor(p_retailprice) AS selling_price, CAST(NULL AS DOUBLE) AS mrp, CAST(NULL AS INTEGER) AS rating_count, CAST(NULL AS INTEGER) AS in_stock FROM part"
ORACLES["category_fingerprint_collisions"] = """WITH p AS (SELECT p_type AS category, p_name AS url FROM part), u AS (SELECT * FROM p UNION ALL SELECT 'COPY', url FROM p WHERE category = 'ECONOMY'),
f AS (SELECT category, list_sort(list(url)) AS mark, count(DISTINCT url) AS n FROM u GROUP BY 1)
SELECT a.category AS category_a, b.category AS category_b, a.n AS n_products FROM f a JOIN f b ON a.mark = b.mark AND a.category < b.category"""
_DAILY = f"daily AS (SELECT site_key, obs_date, {r(avg('selling_price'))} AS avg_price FROM obs WHERE source = 'live' GROUP BY 1, 2)"
_W7 = "(PARTITION BY site_key ORDER BY obs_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"
ORACLES["rolling_7d_avg"] = f"{BASE}, {_DAILY} SELECT site_key, obs_date, avg_price, {r(avg('avg_price', f' OVER {_W7}'), 4)} AS rolling_avg FROM daily"
_QUARTER = f"""obs AS (SELECT listing_id, 'nation' || s_nationkey AS site_key, obs_date, selling_price, 'live' AS source
  FROM (SELECT l_suppkey AS listing_id, CAST(l_shipdate AS DATE) AS obs_date, min({r('l_extendedprice/nullif(l_quantity,0)')}) AS selling_price FROM lineitem GROUP BY 1, 2) JOIN supplier ON s_suppkey = listing_id)"""
ORACLES["price_30d_ago"] = f"WITH {_QUARTER}, {_DAILY} SELECT a.site_key, a.obs_date, a.avg_price, b.avg_price AS price_then, {r(pct('a.avg_price-b.avg_price', 'b.avg_price'))} AS change_pct FROM daily a LEFT JOIN daily b ON a.site_key = b.site_key AND b.obs_date = a.obs_date - 30"
ORACLES["trailing_30d_min_premium"] = f"""{BASE}, w AS (SELECT *, min(selling_price) OVER (PARTITION BY listing_id ORDER BY obs_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS low FROM obs WHERE source = 'live')
SELECT listing_id, obs_date, selling_price, low AS trailing_min, {r(pct('selling_price-low', 'low'))} AS premium_pct FROM w"""
_SIDE = lambda k: avg("computed_discount_pct", where=f" FILTER (is_festival = {k})")
ORACLES["festival_uplift"] = f"{BASE} SELECT site_key, {r(_SIDE(1))} AS festival_discount, {r(_SIDE(0))} AS other_discount, {r(_SIDE(1) + '-' + _SIDE(0))} AS uplift_pp FROM obs JOIN cal USING (date_key) WHERE source = 'live' GROUP BY 1"
ORACLES["what_if_threshold"] = f"{BASE}, {EV_LOOSE} SELECT CAST(range AS INTEGER) AS threshold, count(DISTINCT e.listing_id) AS n_listings FROM range(41) LEFT JOIN e ON e.rise_pct >= range GROUP BY 1"
ORACLES["headline_measures"] = f"""{BASE}, {EV}, a AS (
  SELECT count(DISTINCT listing_id) AS listings_tracked, count(*) AS observations, {r(avg('selling_price'))} AS avg_price, {r(avg('computed_discount_pct'))} AS avg_advertised_discount FROM obs WHERE source = 'live'
), b AS (
  SELECT count(DISTINCT listing_id) {_SOLID} AS flagged_listings, {r(f'median(overstatement_pp) {_SOLID}')} AS median_overstatement, {r(avg('claimed_discount_pct') + '-' + avg('real_discount_pct'))} AS claimed_minus_real FROM e
) SELECT a.*, b.*, {r(pct('CAST(flagged_listings AS DOUBLE)', 'CAST(listings_tracked AS DOUBLE)'))} AS flagged_rate_pct FROM a, b"""
ORACLES["row_level_security"] = f"{BASE} SELECT category, count(*) AS n FROM obs WHERE category IN ('category1', 'category2') GROUP BY 1"
ORACLES["snapshot_lenient_casts"] = """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey + 0.5 END AS v FROM orders)
SELECT o_orderkey, CAST(v AS DOUBLE) AS as_double, CAST(floor(v) AS INTEGER) AS as_int FROM t"""
ORACLES["stream_daily_windows"] = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS hundredths FROM events GROUP BY 1, 2"
ORACLES["stream_static_run"] = """WITH c AS (SELECT user_id AS listing_id, ts, floor(value/100) AS v FROM events WHERE value IS NOT NULL), p AS (SELECT *, lag(v) OVER w AS prev FROM c WINDOW w AS (PARTITION BY listing_id ORDER BY ts)),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR v <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY listing_id ORDER BY ts) AS island FROM p), n AS (SELECT listing_id, island, count(*) AS run FROM i GROUP BY 1, 2)
SELECT listing_id, max(run) AS longest_static_run FROM n GROUP BY 1"""
_COLOURS = ", ".join(f"'{c}'" for c in [*COLOURS, *NOISE])
_NAME = f"array_to_string(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ({_COLOURS})), ' ')"
_HEAD = "CASE p_partkey % 4 WHEN 1 THEN 'iphone' WHEN 2 THEN 'acme' END"
ORACLES["parse_title"] = f"""WITH t AS (SELECT p_partkey, {_BRAND} AS brand, concat_ws(' ', {_HEAD}, nullif({_NAME}, ''), 'x' || (p_partkey % 100)) AS model, {_VARIANT} AS variant FROM part)
SELECT p_partkey, concat_ws('|', coalesce(brand, 'unknown'), model, variant) AS match_key, brand, model, variant,
       array_to_string(list_transform(string_split(concat_ws(' ', brand, model, replace(variant, 'gb', 'Gb')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS canonical_title, brand IS NOT NULL AS is_confident FROM t"""

ORACLES["stream_sliding_average"] = f"""WITH w AS (
  SELECT CAST(ts AS DATE) - CAST(k.range AS INTEGER) AS first_day, event_type, value FROM events, range(7) k
) SELECT first_day, event_type, count(value) AS n, {r(avg('value'), 4)} AS average FROM w GROUP BY 1, 2"""

# ingest: what the warehouse must hold, straight from the events
ITEMS = f"""{BASE}, it AS (
  SELECT listing_id AS k, site_key, 'https://' || site_key || '.example/p/' || listing_id AS url, title, category, obs_date, date_key, source, listing_id % 50 = 8 AS bad,
         CASE WHEN listing_id % 50 <> 7 THEN CASE WHEN listing_id % 10 = 1 THEN {r('selling_price+1')} ELSE selling_price END END AS selling_price, mrp, selling_price AS first_price
  FROM obs
), fact AS (SELECT * FROM it WHERE NOT bad AND selling_price IS NOT NULL)"""
_LATE = "obs_date >= DATE '2024-01-16'"
ORACLES["store_items"] = f"""{ITEMS} SELECT CAST(sum(CASE WHEN k % 10 = 1 THEN 2 ELSE 1 END) FILTER (NOT bad AND selling_price IS NOT NULL) AS BIGINT) AS stored,
  CAST(sum(CASE WHEN k % 10 = 1 THEN 2 ELSE 1 END) FILTER (bad) AS BIGINT) AS skipped,
  count(DISTINCT title) FILTER (NOT bad AND k NOT IN (SELECT k FROM it WHERE obs_date < DATE '2024-01-16')) AS products_created,
  CAST(sum(CASE WHEN k % 10 = 1 THEN 2 ELSE 1 END) FILTER (NOT bad AND selling_price IS NOT NULL AND k % 3 = 0) AS BIGINT) AS dark_patterns,
  count(*) FILTER (NOT bad AND selling_price IS NULL) AS discovered FROM it WHERE {_LATE}"""
ORACLES["ingest_then_timeline"] = f"""{ITEMS}, w AS (
  SELECT f.*, c.is_festival, lag(selling_price) OVER (PARTITION BY k ORDER BY date_key) AS prev_price, count(*) OVER (PARTITION BY k) AS n_observations FROM fact f JOIN cal c USING (date_key) WHERE source = 'live'
) SELECT url, CASE WHEN true THEN upper(title[1]) || title[2:] END AS title, category, obs_date, is_festival, selling_price, mrp, prev_price, {r('selling_price-prev_price')} AS price_delta, n_observations FROM w"""
ORACLES["ingest_star_counts"] = f"""{ITEMS}, g AS (SELECT * FROM it WHERE NOT bad)
SELECT * FROM (SELECT 'dim_product' AS name, count(DISTINCT title) AS n FROM g UNION ALL SELECT 'dim_listing', count(DISTINCT url) FROM g
  UNION ALL SELECT 'dim_seller', count(DISTINCT (site_key, CASE WHEN k % 3 = 0 THEN k % 7 END)) FROM g UNION ALL SELECT 'fact_price_observation', count(*) FROM fact
  UNION ALL SELECT 'fact_dark_pattern', count(*) FROM fact WHERE k % 3 = 0 UNION ALL SELECT 'dim_date', max(obs_date) - min(obs_date) + 1 FROM g
  UNION ALL SELECT unnest(['analysis_run', 'inflation_event', 'mrp_contradiction']), -1)"""
ORACLES["ingest_listings"] = f"{ITEMS} SELECT site_key, url, any_value(title) AS raw_title, min(obs_date) AS first_seen_date, max(obs_date) AS last_seen_date FROM it WHERE NOT bad GROUP BY 1, 2"
ORACLES["ingest_claims_star"] = f"{ITEMS} SELECT site_key, category, obs_date, count(*) AS n FROM fact WHERE k % 3 = 0 GROUP BY 1, 2, 3"
ORACLES["mrp_dispersion_latest_day"] = ORACLES["mrp_dispersion_latest"].replace("FROM rg WHERE mrp > 0", "FROM rg WHERE mrp > 0 AND date_key = (SELECT max(date_key) FROM rg)")
ORACLES["panel_activate"] = f"{ITEMS} SELECT site_key, count(DISTINCT url) AS n, CASE WHEN site_key IN ('site1','site2') THEN count(DISTINCT url) ELSE 0 END AS n_active FROM it WHERE NOT bad GROUP BY 1"
ORACLES["archived_extract"] = """SELECT '/p/' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN 'Item & ' || p_name ELSE p_name END AS raw_title, floor(p_retailprice) AS selling_price,
  CASE WHEN p_partkey % 3 = 0 AND p_size >= 25 THEN floor(p_retailprice) + p_size - 25 END AS mrp FROM part"""
ORACLES["resolved_links"] = """SELECT p_partkey, ['https://shop.example/a/b?c', 'https://shop.example/d/' || p_partkey || '/c', 'https://other.example/x', 'https://z.example/',
  'https://shop.example/d/' || p_partkey || '/page?page=2', 'https://shop.example/d/up', 'https://shop.example/d/' || p_partkey || '/page?x=1#top'][p_partkey % 7 + 1] AS url FROM part"""
ORACLES["category_health"] = """WITH u AS (SELECT p_type AS category, p_name AS url FROM part UNION ALL SELECT 'COPY', p_name FROM part WHERE p_type = 'ECONOMY'),
f AS (SELECT category, list_sort(list_distinct(list(url))) AS mark, count(DISTINCT url) AS products_found FROM u GROUP BY 1)
SELECT category, products_found, EXISTS (SELECT 1 FROM f b WHERE b.mark = a.mark AND b.category <> a.category) AS collides,
  products_found > 0 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.mark = a.mark AND b.category <> a.category) AS ok FROM f a"""
ORACLES["pseudo_sku"] = "SELECT p_partkey, upper(md5(p_name)[1:7]) AS sku FROM part"
ORACLES["export_date_dim"] = f"""{ITEMS} SELECT date_key, date, is_festival, days_to_festival FROM cal
WHERE date_key BETWEEN (SELECT min(date_key) FROM it WHERE NOT bad) AND (SELECT max(date_key) FROM it WHERE NOT bad) AND (date_key IN (SELECT date_key FROM fact) OR date BETWEEN DATE '2024-05-20' - 120 AND DATE '2024-05-20' + 60)"""
ORACLES["view_daily_prices"] = f"{ITEMS} SELECT site_key, count(*) AS n, min(selling_price) AS low, max(selling_price) AS high FROM fact WHERE source = 'live' GROUP BY 1"
ORACLES["verdict_update"] = """SELECT c_custkey AS event_id, CASE WHEN c_custkey % 4 < 3 THEN 1 ELSE 0 END AS manually_reviewed, CASE c_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'unclear' END AS reviewer_verdict,
  CASE WHEN c_custkey % 4 < 3 THEN c_mktsegment END AS reviewer_note FROM customer"""
# the pages name one number after "only" and the word "hurry"
_LOW = "'hurry, only ' || p_size || ' left! now ₹' || format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) || ' was ₹' || format('{:,}', CAST(floor(p_retailprice) + p_size - 25 AS BIGINT)) || ' now ₹' || format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) || ' save ₹12'"
ORACLES["urgency_extract"] = f"""WITH t AS (SELECT '/p/' || p_partkey AS url, p_size, {_LOW} AS x FROM part)
SELECT url, 'stock_claim' AS kind, trim(x[greatest(strpos(x, 'only') - 30, 1):strpos(x, 'only') + length('only ' || p_size || ' left') + 29]) AS snippet, CAST(p_size AS DOUBLE) AS value FROM t
UNION ALL SELECT url, 'stock_claim', trim(x[1:5 + 30]), NULL FROM t"""

_INGESTED = f"""{OBS.replace('obs AS (', 'obs0 AS (', 1)}, obs AS (
  SELECT * REPLACE (CASE WHEN listing_id % 10 = 1 THEN {r('selling_price+1')} ELSE selling_price END AS selling_price) FROM obs0 WHERE listing_id % 50 NOT IN (7, 8) AND source = 'live'
)"""
ORACLES["ingest_events_star"] = f"""WITH {WIN}, {CAL}, {_INGESTED}, {EV_LOOSE} SELECT 'https://' || site_key || '.example/p/' || listing_id AS url, upper(title[1]) || title[2:] AS title, 'category' || (listing_id % 4) AS category,
  baseline_price, peak_price, sale_price, rise_pct, overstatement_pp, sale_start AS sale_start_date, confidence FROM e"""
ORACLES["validation_sample"] = f"{BASE}, {EV} SELECT *, '' AS verdict, '' AS reviewer_note FROM e ORDER BY md5('20260816|' || listing_id), listing_id LIMIT 10"
