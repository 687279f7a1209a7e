-- Results equal to a table of tables.sql.

-- :bronze_erp_orders_raw
SELECT * FROM bronze_erp_orders_raw

-- :bronze_tms_shipments_raw
SELECT * FROM bronze_tms_shipments_raw

-- :bronze_production_output_raw
SELECT * FROM bronze_production_output_raw

-- :bronze_inventory_positions_raw
SELECT * FROM bronze_inventory_positions_raw

-- :bronze_external_signals_raw
SELECT * FROM bronze_external_signals_raw

-- :bronze_plant_locations
SELECT * FROM bronze_plant_locations

-- :bronze_dc_locations
SELECT * FROM bronze_dc_locations

-- :silver_erp_orders
SELECT * FROM silver_erp_orders

-- :silver_tms_shipments
SELECT * FROM silver_tms_shipments

-- :silver_inventory_positions
SELECT * FROM silver_inventory_positions

-- :silver_production_output
SELECT * FROM silver_production_output

-- :silver_external_signals construction_index, precipitation_mm, avg_temp_c
SELECT * FROM silver_external_signals

-- :weekly_demand_actual
SELECT * FROM weekly_demand_actual

-- :kpi_otif_weekly otif_rate, perfect_order_rate_proxy
SELECT * FROM kpi_otif_weekly

-- :kpi_freight_weekly freight_cost_usd, total_weight_tons, co2_kg, freight_cost_per_ton, co2_kg_per_ton
SELECT * FROM kpi_freight_weekly

-- :kpi_premium_freight_weekly premium_freight_pct
SELECT * FROM kpi_premium_freight_weekly

-- :kpi_energy_intensity_weekly energy_kwh, energy_kwh_per_unit
SELECT * FROM kpi_energy_intensity_weekly

-- :control_tower_weekly otif_rate, freight_cost_per_ton, premium_freight_pct, co2_kg_per_ton, energy_kwh_per_unit
SELECT * FROM control_tower_weekly

-- :lane_weekly freight_cost_usd, total_weight_tons, co2_kg, premium_freight_pct, freight_cost_per_ton, co2_kg_per_ton
SELECT * FROM lane_weekly

-- :freight_lanes plant_lat, plant_lon, dc_lat, dc_lon, freight_cost_per_ton, co2_kg_per_ton
SELECT * FROM freight_lanes

-- :sku_dim
SELECT * FROM sku_dim

-- :customer_dim
SELECT * FROM customer_dim

-- :primary_dc_by_region
SELECT * FROM primary_dc_by_region

-- :calendar_spine
SELECT * FROM calendar_spine

-- :calendar_features season_annual, weekday_factor
SELECT * FROM calendar_features

-- :forecast_training_set y, construction_index, precipitation_mm, avg_temp_c
SELECT * FROM forecast_training_set

-- :series_features y, t, sin_woy, cos_woy, lag_1, lag_4, lag_52, roll4, construction_index, precipitation_mm, avg_temp_c
SELECT * FROM series_features

-- :backtest_split y, t, sin_woy, cos_woy, lag_1, lag_4, lag_52, roll4, construction_index, precipitation_mm, avg_temp_c
SELECT * FROM backtest_split

-- :future_weeks last4_mean
SELECT * FROM future_weeks

-- :demand_forecast_all forecast_units:3, lower_ci:3, upper_ci:3
SELECT * FROM forecasts

-- :demand_forecast_all_simple@simple forecast_units:3, lower_ci:3, upper_ci:3
SELECT * FROM forecasts

-- :demand_forecast forecast_units:3, lower_ci:3, upper_ci:3
SELECT * FROM chosen_forecast

-- :ridge_backtest forecast_units:3, lower_ci:3, upper_ci:3
SELECT * FROM chosen_forecast

-- :demand_forecast_future forecast_units:3, lower_ci:3, upper_ci:3
SELECT * EXCLUDE (is_backtest) FROM forecasts WHERE is_backtest = 0

-- :ridge_future forecast_units:3, lower_ci:3, upper_ci:3
SELECT * EXCLUDE (is_backtest) FROM forecasts WHERE is_backtest = 0 AND model_name = 'ridge_time_lags'

-- :mape_by_series mape
SELECT sku_family, region, model_name, avg(ape) AS mape FROM all_errors GROUP BY 1, 2, 3

-- :mape_global mape_mean_across_series
SELECT model_name, avg(m) AS mape_mean_across_series
FROM (SELECT model_name, avg(ape) AS m FROM all_errors GROUP BY sku_family, region, model_name) GROUP BY 1

-- :planner_backtest_slice forecast_units:3
SELECT week, forecast_units, model_name FROM forecasts WHERE region = 'ASIA' AND sku_family = 'pipe' AND is_backtest = 1

-- :planner_future_slice forecast_units:3, lower_ci:3, upper_ci:3
SELECT week, forecast_units, lower_ci, upper_ci, model_name FROM forecasts
WHERE region = 'ASIA' AND sku_family = 'pipe' AND is_backtest = 0

-- :demand_outlook@ridge forecast_units:3, forecast_units_future:3
SELECT week, sku_family, region, actual_units, v.forecast_units, f.forecast_units AS forecast_units_future
FROM demand_vs_naive v
FULL JOIN (SELECT * FROM naive_ma4_future WHERE model_name = 'ridge_time_lags') f USING (week, sku_family, region)

-- :naive_ma4_backtest forecast_units
SELECT * FROM naive_ma4_backtest

-- :naive_ma4_future forecast_units
SELECT * FROM naive_ma4_future

-- :kpi_mape_weekly_naive mape
SELECT * FROM kpi_mape_weekly_naive

-- :demand_vs_forecast_weekly_naive forecast_units, forecast_units_future
SELECT * FROM demand_vs_forecast_weekly_naive

-- :kpi_mape_sku_weekly mape
SELECT * FROM kpi_mape_sku_weekly

-- :late_risk_features construction_index, precipitation_mm, avg_temp_c
SELECT * FROM late_risk_features

-- :silver_plant_locations
SELECT * FROM bronze_plant_locations

-- :silver_dc_locations
SELECT * FROM bronze_dc_locations

-- :late_risk_heuristic
SELECT * FROM scored_by_rule

-- :plant_locations
SELECT plant_id, plant_name, plant_city, plant_state, plant_region, plant_lat, plant_lon FROM bronze_plant_locations

-- :dc_locations
SELECT dc_id, dc_name, dc_city, dc_state, dc_region, dc_lat, dc_lon FROM bronze_dc_locations

-- :facility_labels
SELECT plant_id AS location_id, upper(replace(replace(plant_name, 'ADS ', ''), ' Plant', '')) AS label FROM bronze_plant_locations
UNION ALL
SELECT dc_id, upper(replace(replace(replace(replace(replace(dc_name, 'ADS ', ''), ' Distribution', ''), ' Facility', ''),
                            ' Yard', ''), ' Logistics', '')) FROM bronze_dc_locations

-- :conformed_locations
SELECT plant_id AS location_id, 'plant' AS location_type FROM bronze_plant_locations
UNION ALL SELECT dc_id, 'dc' FROM bronze_dc_locations

-- :plants_by_region
SELECT region, array_to_string(plants, ',') AS plants_in_region FROM region_plants

-- :family_counts
SELECT sku_family, count(*) AS row_count FROM sku_dim GROUP BY 1

-- :channel_counts
SELECT channel, count(*) AS row_count FROM customer_dim GROUP BY 1

-- :assign_plant
SELECT order_id, sku_id, customer_region, plants[CAST(substr(order_id, 2) AS BIGINT) % len(plants) + 1] AS plant_id
FROM bronze_erp_orders_raw LEFT JOIN region_plants ON region = customer_region

-- :promise_dates
SELECT order_id, sku_id, channel, order_date,
       order_date + CASE channel WHEN 'DOT' THEN 10 WHEN 'contractor' THEN 6 WHEN 'ag' THEN 7 ELSE 5 END AS promised_date
FROM bronze_erp_orders_raw

-- :shipment_costing
SELECT shipment_id, truck_id, route_distance_km, total_weight_tons, mode,
       CASE mode WHEN 'carrier' THEN 'own_fleet' ELSE 'carrier' END AS other_mode, freight_cost_usd, co2_kg,
       (180.0 + route_distance_km * CAST(1.1 AS DOUBLE) + total_weight_tons * CAST(42.0 AS DOUBLE))
         * CAST(CASE mode WHEN 'carrier' THEN 1.0 ELSE 1.18 END AS DOUBLE) AS other_freight_cost_usd,
       route_distance_km * total_weight_tons * CAST(CASE mode WHEN 'carrier' THEN 0.095 ELSE 0.105 END AS DOUBLE) AS other_co2_kg
FROM bronze_tms_shipments_raw

-- :order_enrichment season_annual
SELECT o.order_id, o.order_date, o.customer_id, o.sku_id, o.units_ordered, c.customer_region AS home_region,
       c.channel AS home_channel, s.sku_family AS rule_family, s.unit_price AS list_price, d.primary_dc_id,
       CAST(len(p.plants) AS INTEGER) AS plants_nearby, f.season_annual, f.weekday_factor, e.construction_index, e.precipitation_mm, e.avg_temp_c
FROM bronze_erp_orders_raw o
LEFT JOIN customer_dim c ON c.customer_id = o.customer_id
LEFT JOIN sku_dim s ON s.sku_id = o.sku_id
LEFT JOIN primary_dc_by_region d ON d.region = c.customer_region
LEFT JOIN region_plants p ON p.region = c.customer_region
LEFT JOIN calendar_features f ON f.date = o.order_date
LEFT JOIN bronze_external_signals_raw e ON e.date = o.order_date AND e.region = c.customer_region

-- :inventory_days_of_supply
SELECT snapshot_date, location_id, sku_id, on_hand_units, safety_stock_units,
       CAST(round(on_hand_units / greatest(1.0, safety_stock_units / 20.0)) AS BIGINT) AS days_of_supply
FROM silver_inventory_positions

-- :inventory_position_summary avg_days_of_supply
SELECT location_type, location_id, count(*) AS positions, CAST(sum(on_hand_units) AS BIGINT) AS on_hand_units,
       CAST(sum(on_order_units) AS BIGINT) AS on_order_units, CAST(sum(safety_stock_units) AS BIGINT) AS safety_stock_units,
       count(*) FILTER (WHERE on_hand_units < safety_stock_units) AS below_safety, avg(days_of_supply) AS avg_days_of_supply
FROM silver_inventory_positions GROUP BY 1, 2

-- :expect_or_drop_orders
SELECT 'nonnegative_shipped' AS rule, count(*) FILTER (WHERE units_shipped >= 0) AS kept,
       count(*) FILTER (WHERE units_shipped < 0 OR units_shipped IS NULL) AS dropped
FROM bronze_erp_orders_raw

-- :ensure_numeric
SELECT order_id, sku_id, TRY_CAST(CAST(unit_price AS VARCHAR) AS DOUBLE) AS unit_price,
       TRY_CAST(order_status AS DOUBLE) AS status FROM bronze_erp_orders_raw

-- :table_row_counts
SELECT 'bronze_erp_orders_raw' AS table_name, count(*) AS row_count FROM bronze_erp_orders_raw
UNION ALL SELECT 'bronze_tms_shipments_raw', count(*) FROM bronze_tms_shipments_raw
UNION ALL SELECT 'bronze_inventory_positions_raw', count(*) FROM bronze_inventory_positions_raw
UNION ALL SELECT 'bronze_production_output_raw', count(*) FROM bronze_production_output_raw
UNION ALL SELECT 'bronze_external_signals_raw', count(*) FROM bronze_external_signals_raw
UNION ALL SELECT 'bronze_plant_locations', count(*) FROM bronze_plant_locations
UNION ALL SELECT 'bronze_dc_locations', count(*) FROM bronze_dc_locations

-- :last_signal construction_index, precipitation_mm, avg_temp_c
SELECT sku_family, region, last_week, construction_index, precipitation_mm, avg_temp_c FROM series_last_state

-- :weekly_sku_demand
SELECT order_week AS week, sku_id, sku_family, customer_region AS region, CAST(sum(units_ordered) AS BIGINT) AS actual_units,
       CAST(sum(units_shipped) AS BIGINT) AS shipped_units, count(*) AS order_lines
FROM live_orders GROUP BY 1, 2, 3, 4

-- :dense_week_grid
SELECT g.week, s.sku_family, s.region, coalesce(actual_units, 0) AS actual_units, coalesce(shipped_units, 0) AS shipped_units,
       coalesce(order_lines, 0) AS order_lines
FROM (SELECT DISTINCT sku_family, region FROM weekly_demand_actual) s
CROSS JOIN (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM weekly_demand_actual) g
LEFT JOIN weekly_demand_actual w ON w.week = g.week AND w.sku_family = s.sku_family AND w.region = s.region

-- :control_tower_snapshot otif_rate, freight_cost_per_ton, premium_freight_pct, co2_kg_per_ton, energy_kwh_per_unit
SELECT * FROM control_tower_13w

-- :control_tower_recent otif_rate, freight_cost_per_ton, premium_freight_pct, co2_kg_per_ton, energy_kwh_per_unit
SELECT * FROM control_tower_weekly
ORDER BY week DESC, region NULLS FIRST, plant_id, dc_id, sku_family NULLS FIRST

-- :control_tower_freight freight_cost_per_ton, premium_freight_pct
SELECT week, dc_id, plant_id, freight_cost_per_ton, premium_freight_pct FROM control_tower_weekly

-- :otif_trend_region otif
SELECT week, region, avg(otif_rate) AS otif FROM control_tower_weekly GROUP BY 1, 2

-- :kpi_snapshot_latest otif_rate, freight_cost_per_ton, premium_freight_pct, co2_kg_per_ton
SELECT max(week) AS week, avg(otif_rate) AS otif_rate, avg(freight_cost_per_ton) AS freight_cost_per_ton,
       avg(premium_freight_pct) AS premium_freight_pct, avg(co2_kg_per_ton) AS co2_kg_per_ton
FROM control_tower_weekly WHERE week = (SELECT max(week) FROM control_tower_weekly)

-- :otif_region_weeks otif_rate, perfect_order_rate_proxy
SELECT * FROM kpi_otif_weekly WHERE region = 'ASIA'

-- :worst_dcs_13w otif_rate_13w
SELECT dc_id, avg(otif_rate) AS otif_rate_13w, CAST(sum(orders) AS BIGINT) AS orders_13w
FROM kpi_otif_weekly
WHERE region = 'ASIA' AND week IN (SELECT DISTINCT week FROM kpi_otif_weekly WHERE region = 'ASIA' ORDER BY week DESC LIMIT 13)
GROUP BY 1 ORDER BY round(avg(otif_rate), 9), dc_id LIMIT 10

-- :lane_recent freight_cost_usd, total_weight_tons, co2_kg, premium_freight_pct, freight_cost_per_ton, co2_kg_per_ton
SELECT * FROM lane_weekly ORDER BY week DESC, plant_id, dc_id

-- :worst_lanes_13w avg_freight_cost_per_ton_13w, avg_premium_freight_pct_13w, freight_cost_usd_13w, tons_13w
SELECT plant_id, dc_id, avg(freight_cost_per_ton) AS avg_freight_cost_per_ton_13w,
       avg(premium_freight_pct) AS avg_premium_freight_pct_13w, sum(freight_cost_usd) AS freight_cost_usd_13w,
       sum(total_weight_tons) AS tons_13w
FROM lane_weekly WHERE week IN (SELECT DISTINCT week FROM lane_weekly ORDER BY week DESC LIMIT 13)
GROUP BY 1, 2 ORDER BY round(avg(freight_cost_per_ton), 9) DESC, plant_id, dc_id LIMIT 10

-- :costliest_lanes freight_cost_per_ton
SELECT plant_id, dc_id, substr(plant_name, 1, 10) || ' → ' || substr(dc_name, 1, 10) AS lane, freight_cost_per_ton
FROM freight_lanes ORDER BY freight_cost_per_ton DESC, plant_id, dc_id LIMIT 10

-- :top_3_lanes freight_cost_per_ton
SELECT plant_id, dc_id, substr(plant_name, 1, 40) || ' → ' || substr(dc_name, 1, 40) AS lane, freight_cost_per_ton
FROM freight_lanes ORDER BY freight_cost_per_ton DESC, plant_id, dc_id LIMIT 3

-- :lane_cost_scaled freight_cost_per_ton, cost_scaled, line_width
SELECT plant_id, dc_id, freight_cost_per_ton,
       (freight_cost_per_ton - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS cost_scaled,
       least(CAST(2 AS DOUBLE) + weekly_volume / CAST(30 AS DOUBLE), CAST(8 AS DOUBLE)) AS line_width
FROM freight_lanes, (SELECT min(freight_cost_per_ton) AS lo, max(freight_cost_per_ton) AS hi FROM freight_lanes)

-- :network_summary avg_freight_cost_per_ton, avg_co2_kg_per_ton
SELECT count(*) AS lanes, avg(freight_cost_per_ton) AS avg_freight_cost_per_ton, avg(co2_kg_per_ton) AS avg_co2_kg_per_ton,
       (SELECT count(*) FROM bronze_plant_locations) AS plants, (SELECT count(*) FROM bronze_dc_locations) AS dcs
FROM freight_lanes

-- :top_lanes_by_cost total_cost, total_tons
SELECT plant_id, dc_id, sum(freight_cost_usd) AS total_cost, sum(total_weight_tons) AS total_tons
FROM kpi_freight_weekly GROUP BY 1, 2 ORDER BY half_up(sum(freight_cost_usd), 4) DESC, plant_id, dc_id LIMIT 10

-- :co2_by_month total_co2_kg
SELECT CAST(date_trunc('month', week) AS DATE) AS month, sum(co2_kg) AS total_co2_kg FROM kpi_freight_weekly GROUP BY 1

-- :co2_by_mode_13w CO2 kg/ton
SELECT mode AS "Mode", half_up(sum(co2_kg) / nullif(sum(total_weight_tons), 0), 3) AS "CO2 kg/ton",
       format('{:,.1f}', half_up(sum(total_weight_tons), 1)) AS "Tons (13w)"
FROM kpi_freight_weekly WHERE week >= (SELECT d - 91 FROM as_of) GROUP BY 1

-- :transport_mode_comparison freight_cost_per_ton, co2_kg_per_ton, tons_shipped
SELECT mode AS transport_mode, half_up(sum(freight_cost_usd) / nullif(sum(total_weight_tons), 0), 2) AS freight_cost_per_ton,
       half_up(sum(co2_kg) / nullif(sum(total_weight_tons), 0), 2) AS co2_kg_per_ton, sum(total_weight_tons) AS tons_shipped
FROM silver_tms_shipments WHERE ship_date >= (SELECT d - 91 FROM as_of) GROUP BY 1

-- :co2_weekly_region_mode co2_kg, total_weight_tons, co2_kg_per_ton
SELECT f.week, region, mode, sum(total_weight_tons) AS total_weight_tons, sum(co2_kg) AS co2_kg,
       sum(co2_kg) / greatest(0.0001, sum(total_weight_tons)) AS co2_kg_per_ton
FROM kpi_freight_weekly f
LEFT JOIN (SELECT DISTINCT week, dc_id, region FROM kpi_otif_weekly) r ON r.week = f.week AND r.dc_id = f.dc_id
GROUP BY 1, 2, 3

-- :energy_recent energy_kwh, energy_kwh_per_unit
SELECT * FROM kpi_energy_intensity_weekly ORDER BY week DESC, plant_id, sku_family

-- :energy_13w avg_energy_kwh_per_unit_13w
SELECT plant_id, sku_family, avg(energy_kwh_per_unit) AS avg_energy_kwh_per_unit_13w
FROM kpi_energy_intensity_weekly
WHERE week IN (SELECT DISTINCT week FROM kpi_energy_intensity_weekly ORDER BY week DESC LIMIT 13) GROUP BY 1, 2

-- :order_volume_kpis
SELECT count(*) AS total_orders, count(DISTINCT customer_id) AS unique_customers, count(DISTINCT channel) AS sales_channels,
       CAST(sum(units_ordered) AS BIGINT) AS total_units_ordered FROM recent_orders

-- :service_performance_kpis perfect_order_rate, cancellation_rate, backorder_rate
SELECT half_up(avg(CASE WHEN is_otif AND NOT is_cancelled AND NOT is_backorder THEN 1 ELSE 0 END), 4) AS perfect_order_rate,
       half_up(avg(CASE WHEN is_cancelled THEN 1 ELSE 0 END), 4) AS cancellation_rate,
       half_up(avg(CASE WHEN is_backorder THEN 1 ELSE 0 END), 4) AS backorder_rate FROM recent_orders

-- :product_family_mix pct_of_total
SELECT sku_family, CAST(units AS BIGINT) AS total_units,
       half_up(CAST(units * 100.0 AS DOUBLE) / (SELECT sum(units_ordered) FROM recent_orders), 1) AS pct_of_total
FROM (SELECT sku_family, sum(units_ordered) AS units FROM recent_orders GROUP BY 1)

-- :orders_by_channel otif_rate
SELECT channel AS sales_channel, count(*) AS order_count, CAST(sum(units_ordered) AS BIGINT) AS units_ordered,
       half_up(avg(CASE WHEN is_otif THEN 1 ELSE 0 END), 4) AS otif_rate FROM recent_orders GROUP BY 1

-- :planner_actual_slice
SELECT week, actual_units, shipped_units FROM weekly_demand_actual WHERE region = 'ASIA' AND sku_family = 'pipe'

-- :backorders_weekly backorder_units_proxy, ordered_units, backorder_rate_proxy
SELECT order_week AS week, CAST(sum(units_ordered - units_shipped) AS DOUBLE) AS backorder_units_proxy,
       CAST(sum(units_ordered) AS DOUBLE) AS ordered_units,
       CAST(sum(units_ordered - units_shipped) AS DOUBLE) / greatest(1, sum(units_ordered)) AS backorder_rate_proxy
FROM live_orders WHERE customer_region = 'ASIA' AND sku_family = 'pipe' GROUP BY 1

-- :mape_by_sku avg_mape
SELECT * FROM sku_mape ORDER BY round(avg_mape, 9) DESC, sku_id, region

-- :mape_by_sku_family avg_mape
SELECT * FROM sku_mape WHERE sku_family = 'pipe' ORDER BY round(avg_mape, 9) DESC, sku_id, region

-- :mape_sku_summary avg_mape, worst_mape, best_mape
SELECT count(DISTINCT sku_id) AS skus_analyzed, avg(avg_mape) AS avg_mape, max(avg_mape) AS worst_mape, min(avg_mape) AS best_mape
FROM sku_mape

-- :late_label
SELECT order_id, order_date, requested_delivery_date, actual_delivery_date, is_late FROM labelled_orders

-- :late_class_balance
SELECT is_late, count(*) AS row_count FROM late_risk_features WHERE order_date < (SELECT d - 90 FROM as_of) GROUP BY 1

-- :train_test_split_counts
SELECT CASE WHEN order_date >= (SELECT d - 90 FROM as_of) THEN 'test' ELSE 'train' END AS split, count(*) AS row_count,
       min(order_date) AS first_order, max(order_date) AS last_order
FROM late_risk_features GROUP BY 1

-- :mv_exec_13w CO2 kg/ton, Energy kWh/unit
SELECT week, half_up(avg(otif_rate) * 100, 1) || '%' AS "OTIF",
       format('${:,.2f}', half_up(avg(freight_cost_per_ton), 2)) AS "Freight $/ton",
       half_up(avg(premium_freight_pct) * 100, 1) || '%' AS "Premium Freight",
       half_up(avg(co2_kg_per_ton), 3) AS "CO2 kg/ton", half_up(avg(energy_kwh_per_unit), 3) AS "Energy kWh/unit"
FROM control_tower_13w GROUP BY 1

-- :mv_otif_region_13w
SELECT week, region, half_up(avg(otif_rate) * 100, 1) || '%' AS "OTIF" FROM control_tower_13w GROUP BY 1, 2

-- :mv_worst_dcs
SELECT dc_id AS "DC", half_up(avg(otif_rate) * 100, 1) || '%' AS "OTIF (13w)"
FROM control_tower_13w GROUP BY 1 ORDER BY round(avg(otif_rate), 9) NULLS FIRST, 1 LIMIT 10

-- :mv_premium_lanes
SELECT plant_id AS "Plant", dc_id AS "DC", half_up(avg(premium_freight_pct) * 100, 1) || '%' AS "Premium Freight (13w)"
FROM control_tower_13w GROUP BY 1, 2 ORDER BY round(avg(premium_freight_pct), 9) DESC, 1, 2 LIMIT 10

-- :mv_freight_lanes CO2 kg/ton
SELECT plant_id AS "Plant", dc_id AS "DC", format('${:,.2f}', half_up(avg(freight_cost_per_ton), 2)) AS "Freight $/ton",
       half_up(avg(premium_freight_pct) * 100, 1) || '%' AS "Premium Freight %", half_up(avg(co2_kg_per_ton), 3) AS "CO2 kg/ton"
FROM control_tower_13w GROUP BY 1, 2 ORDER BY round(avg(freight_cost_per_ton), 9) DESC, 1, 2 LIMIT 10

-- :top_5_freight_lanes CO2 kg/ton
SELECT plant_id AS "Plant", dc_id AS "DC", format('${:,.2f}', half_up(avg(freight_cost_per_ton), 2)) AS "Freight $/ton",
       half_up(avg(premium_freight_pct) * 100, 1) || '%' AS "Premium Freight %", half_up(avg(co2_kg_per_ton), 3) AS "CO2 kg/ton"
FROM control_tower_13w GROUP BY 1, 2 ORDER BY round(avg(freight_cost_per_ton), 9) DESC, 1, 2 LIMIT 5

-- :mv_otif_now otif_rate
SELECT avg(otif_rate) AS otif_rate FROM control_tower_weekly WHERE week >= (SELECT d - 30 FROM as_of)

-- :otif_trend_slope_13w otif_slope
SELECT region, regr_slope(otif, week_no) AS otif_slope, count(*) AS weeks
FROM (SELECT region, week, avg(otif_rate) AS otif, (week - DATE '1970-01-05') / 7 AS week_no FROM control_tower_13w GROUP BY 1, 2)
GROUP BY 1

-- :mape_naive_by_series mape
SELECT sku_family, region, avg(ape) AS mape FROM naive_errors GROUP BY 1, 2

-- :mape_by_series_naive mape
SELECT sku_family, region, 'naive_ma4' AS model_name, avg(ape) AS mape FROM naive_errors GROUP BY 1, 2

-- :mape_global_naive mape_mean_across_series
SELECT 'naive_ma4' AS model_name, avg(m) AS mape_mean_across_series
FROM (SELECT avg(ape) AS m FROM naive_errors GROUP BY sku_family, region)

-- :naive_ma4_backtest_simple forecast_units
SELECT f.week, f.sku_family, f.region, forecast_units
FROM (SELECT week, sku_family, region, t, n,
             coalesce(last_value(roll4 IGNORE NULLS) OVER (
                        PARTITION BY sku_family, region, t >= n - least(26, greatest(8, n // 4)) ORDER BY week
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      avg(y) OVER (PARTITION BY sku_family, region)) AS forecast_units
      FROM backtest_split) f
WHERE t >= n - least(26, greatest(8, n // 4))

-- :planner_backtest_slice_naive forecast_units
SELECT week, forecast_units, 'naive_ma4' AS model_name FROM naive_ma4_backtest WHERE region = 'ASIA' AND sku_family = 'pipe'

-- :planner_future_slice_naive forecast_units
SELECT week, forecast_units, 'naive_ma4' AS model_name FROM naive_ma4_future WHERE region = 'ASIA' AND sku_family = 'pipe'

-- :planner_kpis_naive mape, bias, backorder_units_proxy, backorder_rate_proxy
SELECT m.week, m.mape, CASE WHEN actual_units = 0 THEN CASE WHEN forecast_units = 0 THEN 0.0 ELSE 1.0 END
                            ELSE (forecast_units - actual_units) / actual_units END AS bias,
       backorder_units_proxy, backorder_rate_proxy
FROM kpi_mape_weekly_naive m
JOIN naive_errors e ON e.week = m.week AND e.sku_family = m.sku_family AND e.region = m.region
LEFT JOIN (SELECT order_week AS week, CAST(sum(units_ordered - units_shipped) AS DOUBLE) AS backorder_units_proxy,
                  CAST(sum(units_ordered - units_shipped) AS DOUBLE) / greatest(1, sum(units_ordered)) AS backorder_rate_proxy
           FROM live_orders WHERE customer_region = 'ASIA' AND sku_family = 'pipe' GROUP BY 1) b ON b.week = m.week
WHERE m.region = 'ASIA' AND m.sku_family = 'pipe'

-- :top_mape_problems_naive avg_mape
SELECT * FROM series_mape_naive ORDER BY round(avg_mape, 9) DESC, sku_family, region LIMIT 10

-- :demand_vs_forecast_recent_naive forecast_units
SELECT * FROM demand_vs_naive ORDER BY week DESC, sku_family, region

-- :demand_vs_forecast_series_naive
SELECT week, sku_family, region, format('{:,.0f}', CAST(actual_units AS DOUBLE)) AS "Actual Units",
       format('{:,.0f}', forecast_units) AS "Forecast Units", format('{:,.0f}', forecast_units_future) AS "Future Forecast Units"
FROM (SELECT * FROM demand_vs_forecast_weekly_naive WHERE region = 'ASIA' AND sku_family = 'pipe' ORDER BY week DESC)

-- :demand_outlook_naive forecast_units, forecast_units_future
SELECT week, sku_family, region, actual_units, v.forecast_units, f.forecast_units AS forecast_units_future
FROM demand_vs_naive v FULL JOIN naive_ma4_future f USING (week, sku_family, region)

-- :demand_long_naive units
SELECT week, sku_family, region, 'actual_units' AS series, CAST(actual_units AS DOUBLE) AS units FROM demand_vs_naive
UNION ALL SELECT week, sku_family, region, 'forecast_units', forecast_units FROM demand_vs_naive

-- :series_plot_data_naive forecast, is_backtest
SELECT a.week, a.actual_units AS actual, f.model_name, f.forecast_units AS forecast, f.is_backtest
FROM weekly_demand_actual a
LEFT JOIN naive_ma4_all f ON f.week = a.week AND f.sku_family = a.sku_family AND f.region = a.region
WHERE a.region = 'ASIA' AND a.sku_family = 'pipe'

-- :forecast_next_month_naive forecast
SELECT region, sku_family, sum(forecast_units) AS forecast FROM naive_ma4_future
WHERE week >= (SELECT d FROM as_of) AND week < (SELECT d + 28 FROM as_of) GROUP BY 1, 2

-- :actual_vs_forecast_month_naive forecast_units
SELECT region, CAST(sum(actual_units) AS BIGINT) AS actual_units, sum(forecast_units) AS forecast_units
FROM demand_vs_naive WHERE date_trunc('month', week) = (SELECT date_trunc('month', d) FROM as_of) GROUP BY 1

-- :ape_rows_naive forecast_units, ape
SELECT week, sku_family, region, actual_units, forecast_units, ape FROM naive_errors

-- :mape_by_family_region_naive avg_mape
SELECT * FROM series_mape_naive ORDER BY round(avg_mape, 9) DESC, sku_family, region

-- :mape_family_summary_naive avg_mape
SELECT sku_family, avg_mape, half_up(avg_mape * 100, 1) || '%' AS avg_mape_pct FROM family_mape_naive

-- :mape_severity_naive avg_mape
SELECT sku_family, avg_mape, CASE WHEN avg_mape >= 0.25 THEN 'danger' WHEN avg_mape >= 0.15 THEN 'warning' ELSE 'success' END AS severity
FROM family_mape_naive

-- :mape_pivot_naive AFRICA, AMERICA, ASIA, EUROPE, MIDDLE EAST
SELECT sku_family, avg(avg_mape) FILTER (WHERE region = 'AFRICA') AS "AFRICA", avg(avg_mape) FILTER (WHERE region = 'AMERICA') AS "AMERICA",
       avg(avg_mape) FILTER (WHERE region = 'ASIA') AS "ASIA", avg(avg_mape) FILTER (WHERE region = 'EUROPE') AS "EUROPE",
       avg(avg_mape) FILTER (WHERE region = 'MIDDLE EAST') AS "MIDDLE EAST"
FROM series_mape_naive GROUP BY 1

-- :mape_baseline_naive baseline_mape
SELECT avg(avg_mape) AS baseline_mape,
       (SELECT string_agg(sku_family, ',' ORDER BY round(avg_mape, 9) DESC, sku_family, region)
        FROM (SELECT * FROM series_mape_naive ORDER BY round(avg_mape, 9) DESC, sku_family, region LIMIT 3)) AS top_families
FROM series_mape_naive

-- :mv_mape_worst_naive
SELECT sku_family AS "Family", region AS "Region", half_up(avg(mape) * 100, 1) || '%' AS "MAPE (13w)"
FROM kpi_mape_weekly_naive WHERE week >= (SELECT d - 91 FROM as_of)
GROUP BY 1, 2 ORDER BY round(avg(mape), 9) DESC, 1, 2 LIMIT 10

-- :mv_mape_region_naive mape
SELECT region, avg(mape) AS mape FROM kpi_mape_weekly_naive WHERE week >= (SELECT d - 91 FROM as_of) GROUP BY 1

-- :recent_scored_orders_heuristic days_to_request, late_risk_prob
SELECT order_date, customer_region, channel, dc_id, plant_id, sku_family, units_ordered, days_to_request, late_risk_prob,
       late_risk_flag, actual_late
FROM scored_by_rule
ORDER BY order_date DESC, order_id, customer_region, channel, dc_id, plant_id, sku_family, units_ordered, days_to_request,
         late_risk_prob, late_risk_flag, actual_late

-- :late_risk_this_week_heuristic late_risk_prob
SELECT order_id, order_date, customer_region, plant_id, dc_id, sku_family, half_up(late_risk_prob, 3) AS late_risk_prob
FROM scored_by_rule WHERE date_trunc('week', order_date) = (SELECT date_trunc('week', d) FROM as_of)

-- :late_risk_heuristic_metrics auc, accuracy, late_rate
WITH ranked AS (
  SELECT actual_late, late_risk_flag, rank() OVER (ORDER BY late_risk_prob) + (count(*) OVER (PARTITION BY late_risk_prob) - 1) / 2.0 AS place
  FROM scored_by_rule WHERE actual_late IS NOT NULL)
SELECT (sum(place) FILTER (WHERE actual_late = 1) - sum(actual_late) * (sum(actual_late) + 1) / 2.0)
         / (sum(actual_late) * sum(1 - actual_late)) AS auc,
       avg(CASE WHEN actual_late = late_risk_flag THEN 1.0 ELSE 0.0 END) AS accuracy, avg(actual_late) AS late_rate,
       count(*) AS orders_scored
FROM ranked

-- :late_risk_gradient gradient:3
SELECT DISTINCT unnest(['customer_region=' || customer_region, 'channel=' || channel, 'plant_id=' || plant_id, 'dc_id=' || dc_id,
                        'sku_family=' || sku_family]) AS feature, CAST(0 AS DOUBLE) AS gradient
FROM late_risk_features WHERE order_date < (SELECT d - 90 FROM as_of) AND is_late IS NOT NULL
UNION ALL
SELECT unnest(['units_ordered', 'unit_price', 'days_to_request', 'dow', 'woy', 'month', 'construction_index', 'precipitation_mm',
               'avg_temp_c', 'intercept']), 0.0

-- :late_risk_top_orders_heuristic late_risk_prob
SELECT order_id, order_date, customer_region AS region, plant_id, dc_id, sku_family, half_up(late_risk_prob, 3) AS late_risk_prob
FROM scored_by_rule WHERE late_risk_prob > CAST(0.25 AS DOUBLE)
ORDER BY round(scored_by_rule.late_risk_prob, 9) DESC, order_id, order_date, customer_region, plant_id, dc_id, sku_family LIMIT 25

-- :high_risk_orders_heuristic late_risk_prob
SELECT order_date, customer_region, sku_family, late_risk_prob FROM scored_by_rule WHERE late_risk_prob >= CAST(0.25 AS DOUBLE)
ORDER BY order_date DESC, order_id, round(late_risk_prob, 9) DESC, customer_region, sku_family

-- :late_risk_hotspots_weekly_heuristic avg_late_risk
SELECT CAST(date_trunc('week', order_date) AS DATE) AS week, customer_region, sku_family, avg(late_risk_prob) AS avg_late_risk
FROM scored_by_rule GROUP BY 1, 2, 3 ORDER BY round(avg(late_risk_prob), 9) DESC, 1, 2, 3

-- :risk_hotspots_heuristic late_risk_prob
SELECT * FROM (SELECT customer_region, sku_family, avg(late_risk_prob) AS late_risk_prob FROM scored_by_rule GROUP BY 1, 2)
ORDER BY round(late_risk_prob, 9) DESC, 1, 2

-- :risk_summary_heuristic avg_risk, max_risk
SELECT count(*) AS orders_scored, count(*) FILTER (WHERE late_risk_prob >= CAST(0.25 AS DOUBLE)) AS high_risk_orders,
       avg(late_risk_prob) AS avg_risk, max(late_risk_prob) AS max_risk
FROM scored_by_rule

-- :risk_histogram_heuristic bin_start
SELECT bin, bin / CAST(20 AS DOUBLE) AS bin_start, orders
FROM (SELECT CAST(least(floor(late_risk_prob * 20), 19) AS INTEGER) AS bin, count(*) AS orders FROM scored_by_rule GROUP BY 1)

-- :mv_late_risk_by_region_heuristic Avg late-risk prob, Observed late rate
SELECT CAST(date_trunc('week', order_date) AS DATE) AS order_week, customer_region, avg(late_risk_prob) AS "Avg late-risk prob",
       avg(actual_late) AS "Observed late rate", count(*) AS "Orders scored"
FROM scored_by_rule GROUP BY 1, 2
