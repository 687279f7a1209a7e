-- :as_of
SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders

-- :places
SELECT n_nationkey AS k, n_name, r_regionkey, r_name
FROM nation JOIN region ON n_regionkey = r_regionkey

-- :bronze_plant_locations
SELECT 'PL' || lpad(CAST(k + 1 AS VARCHAR), 2, '0') AS plant_id, 'Site ' || n_name || ' Plant' AS plant_name,
       n_name AS plant_city, 'ST' AS plant_state, CAST(30.0 + k * 0.75 AS DOUBLE) AS plant_lat,
       CAST(-120.0 + k * 2.5 AS DOUBLE) AS plant_lon, r_name AS plant_region
FROM places

-- :bronze_dc_locations
SELECT 'DC' || lpad(CAST(k + 1 AS VARCHAR), 2, '0') AS dc_id, 'Site ' || n_name || ' Distribution' AS dc_name,
       n_name AS dc_city, 'ST' AS dc_state, 31.0 + k * CAST(0.9 AS DOUBLE) AS dc_lat,
       CAST(-118.0 + k * 3.5 AS DOUBLE) AS dc_lon, r_name AS dc_region
FROM places

-- :buyers
SELECT c_custkey, printf('C%06d', c_custkey) AS customer_id, r_regionkey, r_name AS customer_region,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'distributor' WHEN 'FURNITURE' THEN 'distributor'
            WHEN 'BUILDING' THEN 'contractor' WHEN 'AUTOMOBILE' THEN 'DOT' ELSE 'ag' END AS channel,
       printf('DC%02d', c_nationkey % 11 + 1) AS dc_id
FROM customer JOIN places ON c_nationkey = k

-- :order_lines
SELECT *,
       CASE WHEN l_orderkey % 50 = 7 THEN 'cancelled' WHEN (l_orderkey + l_linenumber) % 12 = 5 THEN 'backorder'
            ELSE 'closed' END AS status,
       CAST(o_orderdate AS DATE) AS od, CAST(l_quantity AS INTEGER) AS qty,
       CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'SMALL') THEN 'pipe'
            WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'chambers' ELSE 'structures' END AS family
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN buyers ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey

-- :bronze_erp_orders_raw
SELECT printf('O%010d', l_orderkey) AS order_id, od AS order_date,
       od + CAST(5 + l_orderkey % 13 AS INTEGER) AS requested_delivery_date,
       CASE WHEN status <> 'cancelled' THEN od + CAST(1 + l_partkey % 3 AS INTEGER) END AS actual_ship_date,
       CASE WHEN status <> 'cancelled'
            THEN od + CAST(2 + l_partkey % 3 + (l_orderkey + l_linenumber * 3 + l_suppkey) % 9 AS INTEGER)
            END AS actual_delivery_date,
       customer_id, customer_region, channel, printf('PL%02d', l_suppkey % 25 + 1) AS plant_id, dc_id,
       printf('SKU%05d', l_partkey) AS sku_id, family AS sku_family, qty AS units_ordered,
       CASE status WHEN 'cancelled' THEN 0 WHEN 'backorder' THEN CAST(qty // 2 AS INTEGER) ELSE qty END AS units_shipped,
       p_retailprice AS unit_price, status AS order_status
FROM order_lines

-- :shipped_lines
SELECT *, CAST(substr(order_id, 2) AS BIGINT) AS order_no, CAST(substr(sku_id, 4) AS BIGINT) AS sku_no
FROM bronze_erp_orders_raw WHERE order_status <> 'cancelled' AND actual_ship_date IS NOT NULL

-- :trips
SELECT *, CAST(300 + (order_no * 7 + sku_no * 13) % 900 AS DOUBLE) AS km,
       CASE WHEN (order_no + sku_no) % 10 < 7 THEN 'own_fleet' ELSE 'carrier' END AS by_mode,
       units_shipped * CAST(CASE sku_family WHEN 'pipe' THEN 0.06 WHEN 'chambers' THEN 0.18 ELSE 0.32 END AS DOUBLE) AS tons
FROM shipped_lines

-- :bronze_tms_shipments_raw
SELECT 'S' || substr(order_id, 2) AS shipment_id, order_id, plant_id, dc_id,
       printf('T%05d', order_no % 1200 + 1) AS truck_id, km AS route_distance_km, by_mode AS mode,
       actual_ship_date AS ship_date, actual_delivery_date AS delivery_date, tons AS total_weight_tons,
       (180.0 + km * CAST(1.1 AS DOUBLE) + tons * CAST(42.0 AS DOUBLE))
         * CAST(CASE by_mode WHEN 'carrier' THEN 1.18 ELSE 1.0 END AS DOUBLE) AS freight_cost_usd,
       km * tons * CAST(CASE by_mode WHEN 'own_fleet' THEN 0.095 ELSE 0.105 END AS DOUBLE) AS co2_kg
FROM trips

-- :bronze_production_output_raw
SELECT actual_ship_date AS date, plant_id, sku_family, CAST(sum(units_ordered) AS BIGINT) AS units_produced,
       CAST(sum(units_ordered) AS DOUBLE)
         * CAST(CASE sku_family WHEN 'pipe' THEN 1.9 WHEN 'chambers' THEN 3.4 ELSE 5.2 END AS DOUBLE) AS energy_kwh
FROM bronze_erp_orders_raw WHERE actual_ship_date IS NOT NULL
GROUP BY actual_ship_date, plant_id, sku_family

-- :bronze_external_signals_raw
SELECT d AS date, r AS region, CAST(85.0 + ((dayofyear(d) * 37 + n * 11) % 50) * 0.5 AS DOUBLE) AS construction_index,
       CAST(((dayofyear(d) * 13 + n * 7) % 80) AS DOUBLE) / 10.0 AS precipitation_mm,
       CAST(((dayofyear(d) * 17 + n * 5) % 350) AS DOUBLE) / 10.0 - 5.0 AS avg_temp_c
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, r_regionkey AS n, customer_region AS r
      FROM orders JOIN buyers ON o_custkey = c_custkey)

-- :stock_moves
SELECT CAST(date_trunc('month', actual_ship_date) AS DATE) AS m, plant_id, CAST(NULL AS VARCHAR) AS dc_id,
       sku_id, sku_no, sku_family, units_ordered, units_shipped FROM shipped_lines
UNION ALL
SELECT CAST(date_trunc('month', actual_ship_date) AS DATE), CAST(NULL AS VARCHAR), dc_id,
       sku_id, sku_no, sku_family, units_ordered, units_shipped FROM shipped_lines

-- :bronze_inventory_positions_raw
SELECT m AS snapshot_date, plant_id, dc_id, sku_id,
       CAST(sum(units_shipped) * 2 + (sku_no * 31 + month(m) * 5) % 300 AS BIGINT) AS on_hand_units,
       CAST(sum(units_ordered - units_shipped) + (sku_no + month(m)) % 120 AS BIGINT) AS on_order_units,
       CASE sku_family WHEN 'pipe' THEN 200 WHEN 'chambers' THEN 80 ELSE 45 END AS safety_stock_units,
       CAST(round((sum(units_shipped) * 2 + (sku_no * 31 + month(m) * 5) % 300)
         / greatest(1.0, CASE sku_family WHEN 'pipe' THEN 200 WHEN 'chambers' THEN 80 ELSE 45 END / 20.0)) AS BIGINT)
         AS days_of_supply
FROM stock_moves GROUP BY m, plant_id, dc_id, sku_id, sku_no, sku_family

-- :silver_erp_orders
SELECT *, CAST(date_trunc('week', order_date) AS DATE) AS order_week, order_status = 'cancelled' AS is_cancelled,
       order_status = 'backorder' AS is_backorder, units_shipped = units_ordered AS is_in_full,
       actual_delivery_date IS NOT NULL AND actual_delivery_date <= requested_delivery_date AS is_on_time,
       units_shipped = units_ordered AND order_status <> 'cancelled'
         AND actual_delivery_date IS NOT NULL AND actual_delivery_date <= requested_delivery_date AS is_otif
FROM bronze_erp_orders_raw WHERE units_shipped >= 0

-- :silver_tms_shipments
SELECT *, CAST(date_trunc('week', ship_date) AS DATE) AS ship_week, concat_ws('→', plant_id, dc_id) AS lane_id
FROM bronze_tms_shipments_raw

-- :silver_inventory_positions
SELECT *, coalesce(plant_id, dc_id) AS location_id, CASE WHEN plant_id IS NULL THEN 'dc' ELSE 'plant' END AS location_type
FROM bronze_inventory_positions_raw

-- :silver_production_output
SELECT *, CAST(date_trunc('week', date) AS DATE) AS week FROM bronze_production_output_raw

-- :silver_external_signals
SELECT CAST(date_trunc('week', date) AS DATE) AS week, region, avg(construction_index) AS construction_index,
       avg(precipitation_mm) AS precipitation_mm, avg(avg_temp_c) AS avg_temp_c
FROM bronze_external_signals_raw GROUP BY 1, 2

-- :live_orders
SELECT * FROM silver_erp_orders WHERE order_status <> 'cancelled'

-- :weekly_demand_actual
SELECT order_week AS week, sku_family, customer_region AS region, CAST(sum(units_ordered) AS BIGINT) AS actual_units,
       CAST(sum(units_shipped) AS BIGINT) AS shipped_units, count(*) AS order_lines
FROM live_orders GROUP BY 1, 2, 3

-- :kpi_otif_weekly
SELECT week, region, dc_id, count(*) AS orders, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS otif_rate,
       avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS perfect_order_rate_proxy
FROM (SELECT order_week AS week, customer_region AS region, dc_id, order_id,
             max(CAST(is_on_time AS INTEGER)) = 1 AND min(CAST(is_in_full AS INTEGER)) = 1 AS ok
      FROM live_orders GROUP BY ALL)
GROUP BY 1, 2, 3

-- :kpi_freight_weekly
SELECT ship_week AS week, dc_id, plant_id, mode, sum(freight_cost_usd) AS freight_cost_usd,
       sum(total_weight_tons) AS total_weight_tons, sum(co2_kg) AS co2_kg,
       sum(freight_cost_usd) / nullif(sum(total_weight_tons), 0) AS freight_cost_per_ton,
       sum(co2_kg) / nullif(sum(total_weight_tons), 0) AS co2_kg_per_ton
FROM silver_tms_shipments GROUP BY 1, 2, 3, 4

-- :kpi_premium_freight_weekly
SELECT week, dc_id, plant_id, coalesce(sum(freight_cost_usd) FILTER (WHERE mode = 'carrier'), 0.0)
         / nullif(sum(freight_cost_usd), 0) AS premium_freight_pct
FROM kpi_freight_weekly GROUP BY 1, 2, 3

-- :kpi_energy_intensity_weekly
SELECT week, plant_id, sku_family, sum(energy_kwh) AS energy_kwh, CAST(sum(units_produced) AS BIGINT) AS units_produced,
       sum(energy_kwh) / nullif(sum(units_produced), 0) AS energy_kwh_per_unit
FROM silver_production_output GROUP BY 1, 2, 3

-- :lane_totals
SELECT week, dc_id, plant_id, sum(freight_cost_usd) AS freight_cost_usd, sum(total_weight_tons) AS total_weight_tons,
       sum(co2_kg) AS co2_kg
FROM kpi_freight_weekly GROUP BY 1, 2, 3

-- :control_tower_weekly
SELECT l.week, o.region, l.plant_id, l.dc_id, o.otif_rate,
       l.freight_cost_usd / nullif(l.total_weight_tons, 0) AS freight_cost_per_ton, p.premium_freight_pct,
       l.co2_kg / nullif(l.total_weight_tons, 0) AS co2_kg_per_ton, e.sku_family, e.energy_kwh_per_unit
FROM lane_totals l
LEFT JOIN kpi_otif_weekly o ON o.week = l.week AND o.dc_id = l.dc_id
LEFT JOIN kpi_premium_freight_weekly p ON p.week = l.week AND p.dc_id = l.dc_id AND p.plant_id = l.plant_id
LEFT JOIN kpi_energy_intensity_weekly e ON e.week = l.week AND e.plant_id = l.plant_id

-- :control_tower_13w
SELECT * FROM control_tower_weekly WHERE week >= (SELECT d - 91 FROM as_of)

-- :lane_weekly
SELECT t.*, p.premium_freight_pct, t.freight_cost_usd / greatest(0.0001, t.total_weight_tons) AS freight_cost_per_ton,
       t.co2_kg / greatest(0.0001, t.total_weight_tons) AS co2_kg_per_ton
FROM lane_totals t LEFT JOIN kpi_premium_freight_weekly p USING (week, dc_id, plant_id)

-- :freight_lanes
SELECT l.plant_id, plant_name, plant_lat, plant_lon, l.dc_id, dc_name, dc_lat, dc_lon,
       half_up(cost, 2) AS freight_cost_per_ton, half_up(co2, 1) AS co2_kg_per_ton, weekly_volume
FROM (SELECT plant_id, dc_id, avg(freight_cost_per_ton) AS cost, avg(co2_kg_per_ton) AS co2, count(*) AS weekly_volume
      FROM control_tower_13w GROUP BY 1, 2) l
JOIN bronze_plant_locations p ON p.plant_id = l.plant_id
JOIN bronze_dc_locations d ON d.dc_id = l.dc_id

-- :recent_orders
SELECT * FROM silver_erp_orders WHERE order_date >= (SELECT d - 91 FROM as_of)

-- :ordered_skus
SELECT DISTINCT sku_id, CAST(substr(sku_id, 4) AS BIGINT) AS p_partkey FROM bronze_erp_orders_raw

-- :sku_dim
SELECT sku_id,
       CASE WHEN p_partkey % 10 < 6 THEN 'pipe' WHEN p_partkey % 10 < 8 THEN 'chambers' ELSE 'structures' END AS sku_family,
       CAST(CASE WHEN p_partkey % 10 < 6 THEN 75.0 + (p_partkey % 50) * CAST(1.2 AS DOUBLE)
                 WHEN p_partkey % 10 < 8 THEN 240.0 + (p_partkey % 40) * 2.5
                 ELSE 520.0 + (p_partkey % 30) * 4.0 END AS DOUBLE) AS unit_price
FROM ordered_skus

-- :ordering_customers
SELECT DISTINCT customer_id, CAST(substr(customer_id, 2) AS BIGINT) AS c_custkey FROM bronze_erp_orders_raw

-- :plant_regions
SELECT list(DISTINCT plant_region ORDER BY plant_region) AS names FROM bronze_plant_locations

-- :customer_dim
SELECT customer_id, (SELECT names FROM plant_regions)[c_custkey % (SELECT len(names) FROM plant_regions) + 1] AS customer_region,
       CASE WHEN c_custkey % 10 < 5 THEN 'distributor' WHEN c_custkey % 10 < 8 THEN 'contractor'
            WHEN c_custkey % 10 < 9 THEN 'DOT' ELSE 'ag' END AS channel
FROM ordering_customers

-- :primary_dc_by_region
SELECT dc_region AS region, min(dc_id) AS primary_dc_id FROM bronze_dc_locations GROUP BY 1

-- :region_plants
SELECT plant_region AS region, list(plant_id ORDER BY plant_id) AS plants FROM bronze_plant_locations GROUP BY 1

-- :calendar_spine
SELECT CAST(unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS DATE) AS date FROM bronze_erp_orders_raw

-- :calendar_features
SELECT date, CAST(dayofyear(date) AS INTEGER) AS doy, CAST(dayofweek(date) + 1 AS INTEGER) AS dow,
       CAST(date_trunc('week', date) AS DATE) AS week, (sin(2 * pi() * dayofyear(date) / 365.25) + 1) / 2 AS season_annual,
       CAST(CASE WHEN dayofweek(date) IN (0, 6) THEN 0.85 ELSE 1.0 END AS DOUBLE) AS weekday_factor
FROM calendar_spine

-- :forecast_training_set
SELECT a.week, a.sku_family, a.region, CAST(actual_units AS DOUBLE) AS y, construction_index, precipitation_mm, avg_temp_c
FROM weekly_demand_actual a LEFT JOIN silver_external_signals s ON s.week = a.week AND s.region = a.region

-- :series_features
SELECT week, sku_family, region, y, CAST(row_number() OVER w - 1 AS DOUBLE) AS t,
       sin(2 * pi() * weekofyear(week) / 52) AS sin_woy, cos(2 * pi() * weekofyear(week) / 52) AS cos_woy,
       lag(y, 1) OVER w AS lag_1, lag(y, 4) OVER w AS lag_4, lag(y, 52) OVER w AS lag_52,
       CASE WHEN row_number() OVER w > 4
            THEN (lag(y, 1) OVER w + lag(y, 2) OVER w + lag(y, 3) OVER w + lag(y, 4) OVER w) / 4 END AS roll4,
       construction_index, precipitation_mm, avg_temp_c
FROM forecast_training_set WINDOW w AS (PARTITION BY sku_family, region ORDER BY week)

-- :series_sizes
SELECT sku_family, region, CAST(count(*) AS INTEGER) AS n,
       CAST(CASE WHEN count(*) <= 62 THEN least(26, greatest(8, count(*) // 4)) ELSE 52 END AS INTEGER) AS holdout_weeks
FROM forecast_training_set GROUP BY 1, 2

-- :backtest_split
SELECT f.*, n, holdout_weeks, t >= n - holdout_weeks AS is_holdout
FROM series_features f JOIN series_sizes USING (sku_family, region)

-- :four_week_mean
SELECT week, sku_family, region,
       coalesce(last_value(roll4 IGNORE NULLS) OVER (PARTITION BY sku_family, region ORDER BY week
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                avg(y) OVER (PARTITION BY sku_family, region)) AS forecast_units
FROM backtest_split WHERE is_holdout

-- :naive_ma4_backtest
SELECT * FROM four_week_mean

-- :naive_ma4_backtest@ridge
SELECT week, sku_family, region, forecast_units FROM chosen_forecast

-- :naive_ma4_future@ridge
SELECT week, sku_family, region, forecast_units, model_name FROM forecasts WHERE is_backtest = 0

-- :naive_ma4_all@ridge
SELECT week, sku_family, region, forecast_units, model_name, is_backtest FROM forecasts

-- :series_sizes@simple
SELECT sku_family, region, CAST(count(*) AS INTEGER) AS n, CAST(least(26, greatest(8, count(*) // 4)) AS INTEGER) AS holdout_weeks
FROM forecast_training_set GROUP BY 1, 2

-- :ridge_rows@simple
SELECT 'train' AS fit, * FROM backtest_inputs_x WHERE NOT is_holdout AND usable
QUALIFY count(*) OVER (PARTITION BY sku_family, region) >= 20

-- :series_last_state
SELECT sku_family, region, max(week) AS last_week, avg(y) FILTER (WHERE t >= n - 4) AS last4_mean,
       coalesce(arg_max(construction_index, week) FILTER (WHERE construction_index IS NOT NULL), 0) AS construction_index,
       coalesce(arg_max(precipitation_mm, week) FILTER (WHERE precipitation_mm IS NOT NULL), 0) AS precipitation_mm,
       coalesce(arg_max(avg_temp_c, week) FILTER (WHERE avg_temp_c IS NOT NULL), 0) AS avg_temp_c
FROM backtest_split GROUP BY 1, 2

-- :future_weeks
SELECT sku_family, region, last_week + CAST(7 * i AS INTEGER) AS week, last4_mean
FROM series_last_state, range(1, 14) AS h(i)

-- :naive_ma4_future
SELECT week, sku_family, region, last4_mean AS forecast_units FROM future_weeks

-- :naive_ma4_all
SELECT *, 'naive_ma4' AS model_name, CAST(1.0 AS DOUBLE) AS is_backtest FROM naive_ma4_backtest
UNION ALL SELECT *, 'naive_ma4', CAST(0.0 AS DOUBLE) FROM naive_ma4_future

-- :ridge_rows
SELECT * FROM (
  SELECT 'train' AS fit, * FROM backtest_inputs_x WHERE NOT is_holdout AND usable
  UNION ALL SELECT 'whole', * FROM backtest_inputs_x WHERE usable)
QUALIFY count(*) OVER (PARTITION BY fit, sku_family, region) >= 20

-- :backtest_inputs_x
SELECT *, lag_1 IS NOT NULL AND lag_4 IS NOT NULL AND roll4 IS NOT NULL AS usable,
       list_transform([t, sin_woy, cos_woy, lag_1, lag_4, lag_52, roll4, construction_index, precipitation_mm, avg_temp_c],
                      lambda v: coalesce(v, 0.0)::DOUBLE) AS x
FROM backtest_split

-- :ridge_values
SELECT fit, sku_family, region, week, y - avg(y) OVER s AS y, avg(y) OVER s AS level, i, v, avg(v) OVER f AS centre,
       CASE WHEN stddev_pop(v) OVER f > 0 THEN stddev_pop(v) OVER f ELSE 1.0 END AS width
FROM (SELECT fit, sku_family, region, week, y, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM ridge_rows)
WINDOW f AS (PARTITION BY fit, sku_family, region, i), s AS (PARTITION BY fit, sku_family, region)

-- :ridge_system
SELECT fit, sku_family, region, list(line ORDER BY i) AS m
FROM (SELECT fit, sku_family, region, i, list(value ORDER BY j) AS line
      FROM (SELECT a.fit, a.sku_family, a.region, a.i, b.i AS j,
                   sum((a.v - a.centre) / a.width * (b.v - b.centre) / b.width) + max(CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END) AS value
            FROM ridge_values a JOIN ridge_values b USING (fit, sku_family, region, week) GROUP BY ALL
            UNION ALL
            SELECT fit, sku_family, region, i, 11, sum((v - centre) / width * y) FROM ridge_values GROUP BY ALL)
      GROUP BY ALL)
GROUP BY ALL

-- :ridge_weights
WITH RECURSIVE elimination AS (
  SELECT fit, sku_family, region, 1 AS k, m FROM ridge_system
  UNION ALL
  SELECT fit, sku_family, region, k + 1, list_transform(m, lambda r, i:
           CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
                ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END)
  FROM elimination WHERE k <= 10)
SELECT fit, sku_family, region, list_transform(m, lambda r: r[11]) AS weights FROM elimination WHERE k = 11

-- :ridge_models
SELECT fit, sku_family, region, slopes, intercept, spread
FROM (SELECT fit, sku_family, region, list(weights[i] / width ORDER BY i) AS slopes,
             any_value(level) - sum(centre * weights[i] / width) AS intercept
      FROM (SELECT DISTINCT fit, sku_family, region, i, level, centre, width FROM ridge_values)
      JOIN ridge_weights USING (fit, sku_family, region) GROUP BY 1, 2, 3)
JOIN (SELECT fit, sku_family, region, stddev_pop(y - list_dot_product(slopes_, x)) AS spread
      FROM ridge_rows JOIN (SELECT fit AS fit_, sku_family AS family_, region AS region_, list(weights[i] / width ORDER BY i) AS slopes_
                            FROM (SELECT DISTINCT fit, sku_family, region, i, width FROM ridge_values)
                            JOIN ridge_weights USING (fit, sku_family, region) GROUP BY 1, 2, 3)
        ON fit_ = fit AND family_ = sku_family AND region_ = region
      GROUP BY 1, 2, 3) USING (fit, sku_family, region)

-- :step_spreads
SELECT sku_family, region, CASE WHEN count(*) > 5 THEN stddev_pop(y - lag_1) ELSE 10.0 END AS step_spread
FROM backtest_split WHERE NOT is_holdout GROUP BY 1, 2

-- :spreads
SELECT s.sku_family, s.region, coalesce(m.spread, step_spread, 10.0) AS spread
FROM series_last_state s
LEFT JOIN step_spreads t ON t.sku_family = s.sku_family AND t.region = s.region
LEFT JOIN ridge_models m ON m.fit = 'train' AND m.sku_family = s.sku_family AND m.region = s.region

-- :ridge_ahead
WITH RECURSIVE ahead AS (
  SELECT s.sku_family, s.region, last_week, last4_mean, [construction_index, precipitation_mm, avg_temp_c] AS signals,
         slopes, intercept, 0 AS i, h.history, CAST(NULL AS DOUBLE) AS value
  FROM series_last_state s
  JOIN (SELECT sku_family, region, list(y ORDER BY t) AS history FROM backtest_split GROUP BY 1, 2) h
    ON h.sku_family = s.sku_family AND h.region = s.region
  JOIN ridge_models m ON m.fit = 'whole' AND m.sku_family = s.sku_family AND m.region = s.region
  UNION ALL
  SELECT sku_family, region, last_week, last4_mean, signals, slopes, intercept, i + 1, list_append(history, value), value
  FROM (SELECT a.* EXCLUDE (value), greatest(0.0, intercept + list_dot_product(slopes, list_concat(
                 [CAST(len(history) AS DOUBLE), sin(2 * pi() * weekofyear(last_week + CAST(7 * (i + 1) AS INTEGER)) / 52),
                  cos(2 * pi() * weekofyear(last_week + CAST(7 * (i + 1) AS INTEGER)) / 52),
                  coalesce(history[-1], last4_mean), coalesce(history[-4], last4_mean), coalesce(history[-52], last4_mean),
                  CASE WHEN len(history) >= 4 THEN (history[-1] + history[-2] + history[-3] + history[-4]) / 4 ELSE last4_mean END],
                 signals))) AS value
        FROM ahead a WHERE i < 13))
SELECT sku_family, region, last_week + CAST(7 * i AS INTEGER) AS week, value FROM ahead WHERE i > 0

-- :raw_forecasts
SELECT b.week, b.sku_family, b.region, b.forecast_units AS prediction, spread, 'naive_ma4' AS model_name, CAST(1.0 AS DOUBLE) AS is_backtest
FROM four_week_mean b JOIN spreads p ON p.sku_family = b.sku_family AND p.region = b.region
UNION ALL
SELECT b.week, b.sku_family, b.region, coalesce(intercept + list_dot_product(slopes, x), b.forecast_units), p.spread, 'ridge_time_lags', 1.0
FROM four_week_mean b
JOIN spreads p ON p.sku_family = b.sku_family AND p.region = b.region
JOIN backtest_inputs_x i ON i.week = b.week AND i.sku_family = b.sku_family AND i.region = b.region
LEFT JOIN ridge_models m ON m.fit = 'train' AND m.sku_family = b.sku_family AND m.region = b.region
UNION ALL
SELECT f.week, f.sku_family, f.region, last4_mean, spread, 'naive_ma4', 0.0
FROM future_weeks f JOIN spreads p ON p.sku_family = f.sku_family AND p.region = f.region
UNION ALL
SELECT f.week, f.sku_family, f.region, coalesce(value, last4_mean), coalesce(m.spread, p.spread), 'ridge_time_lags', 0.0
FROM future_weeks f
JOIN spreads p ON p.sku_family = f.sku_family AND p.region = f.region
LEFT JOIN ridge_ahead a ON a.week = f.week AND a.sku_family = f.sku_family AND a.region = f.region
LEFT JOIN ridge_models m ON m.fit = 'whole' AND m.sku_family = f.sku_family AND m.region = f.region

-- :forecasts
SELECT week, sku_family, region, greatest(0.0, prediction) AS forecast_units,
       greatest(0.0, prediction - CAST(1.64 AS DOUBLE) * spread) AS lower_ci,
       greatest(0.0, prediction + CAST(1.64 AS DOUBLE) * spread) AS upper_ci, model_name, is_backtest
FROM raw_forecasts

-- :chosen_forecast
SELECT week, sku_family, region, forecast_units, lower_ci, upper_ci FROM forecasts WHERE model_name = 'ridge_time_lags' AND is_backtest = 1

-- :all_errors
SELECT week, sku_family, region, model_name,
       CASE WHEN actual_units = 0 THEN CASE WHEN forecast_units = 0 THEN 0.0 ELSE 1.0 END
            ELSE abs(actual_units - forecast_units) / actual_units END AS ape
FROM weekly_demand_actual JOIN forecasts USING (week, sku_family, region) WHERE is_backtest = 1

-- :naive_errors
SELECT week, sku_family, region, actual_units, forecast_units,
       CASE WHEN actual_units = 0 THEN CASE WHEN forecast_units = 0 THEN 0.0 ELSE 1.0 END
            ELSE abs(actual_units - forecast_units) / actual_units END AS ape
FROM weekly_demand_actual JOIN naive_ma4_backtest USING (week, sku_family, region)

-- :kpi_mape_weekly_naive
SELECT week, sku_family, region, avg(ape) AS mape FROM naive_errors GROUP BY 1, 2, 3

-- :series_mape_naive
SELECT sku_family, region, avg(mape) AS avg_mape FROM kpi_mape_weekly_naive GROUP BY 1, 2

-- :family_mape_naive
SELECT sku_family, avg(avg_mape) AS avg_mape FROM series_mape_naive GROUP BY 1

-- :demand_vs_naive
SELECT week, sku_family, region, actual_units, b.forecast_units
FROM weekly_demand_actual LEFT JOIN naive_ma4_backtest b USING (week, sku_family, region)

-- :demand_vs_forecast_weekly_naive
SELECT v.*, u.forecast_units AS forecast_units_future
FROM demand_vs_naive v LEFT JOIN naive_ma4_future u USING (week, sku_family, region)

-- :kpi_mape_sku_weekly
SELECT week, sku_id, p_name AS sku_name, sku_family, region,
       CASE WHEN units = 0 THEN CASE WHEN ma4 = 0 THEN 0.0 ELSE 1.0 END ELSE abs(units - ma4) / units END AS mape
FROM (SELECT *, CASE WHEN count(*) OVER w = 4 THEN avg(units) OVER w END AS ma4
      FROM (SELECT order_week AS week, sku_id, sku_family, customer_region AS region, sum(units_ordered) AS units
            FROM live_orders GROUP BY 1, 2, 3, 4)
      WINDOW w AS (PARTITION BY sku_id, sku_family, region ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
JOIN (SELECT p_name, printf('SKU%05d', p_partkey) AS sku_id FROM part) USING (sku_id)
WHERE ma4 IS NOT NULL

-- :sku_mape
SELECT sku_id, sku_name, sku_family, region, avg(mape) AS avg_mape, count(*) AS weeks_measured
FROM kpi_mape_sku_weekly GROUP BY 1, 2, 3, 4

-- :labelled_orders
SELECT *, CAST(actual_delivery_date IS NOT NULL AND actual_delivery_date > requested_delivery_date AS INTEGER) AS is_late
FROM live_orders

-- :late_risk_features
SELECT order_id, order_date, requested_delivery_date, customer_region, channel, plant_id, dc_id, sku_family,
       units_ordered, unit_price, construction_index, precipitation_mm, avg_temp_c, is_late,
       CAST(requested_delivery_date - order_date AS DOUBLE) AS days_to_request,
       CAST(dayofweek(order_date) + 1 AS DOUBLE) AS dow, CAST(weekofyear(order_date) AS DOUBLE) AS woy,
       CAST(month(order_date) AS DOUBLE) AS month
FROM labelled_orders LEFT JOIN silver_external_signals s ON s.week = order_week AND s.region = customer_region
WHERE order_date BETWEEN (SELECT d - 540 FROM as_of) AND (SELECT d FROM as_of)

-- :scored_by_rule
SELECT order_id, order_date, customer_region, channel, dc_id, plant_id, sku_family, units_ordered, days_to_request, p AS late_risk_prob,
       CAST(p >= 0.5 AS INTEGER) AS late_risk_flag, is_late AS actual_late
FROM (SELECT *, least(CAST(0.95 AS DOUBLE), greatest(CAST(0.01 AS DOUBLE),
               CAST(0.10 AS DOUBLE) + CAST(CASE WHEN days_to_request <= 5 THEN 0.18 ELSE 0 END AS DOUBLE)
               + CAST(CASE WHEN units_ordered >= 50 THEN 0.10 ELSE 0 END AS DOUBLE)
               + CAST(CASE WHEN channel IN ('contractor', 'DOT') THEN 0.08 ELSE 0 END AS DOUBLE))) AS p
      FROM late_risk_features WHERE order_date >= (SELECT d - 91 FROM as_of))
