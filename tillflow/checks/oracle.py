"""The SQL another engine runs to check every batch query.

Views are chained as common table expressions; each query names the view it
selects from and gets exactly the views that one needs.
"""

from __future__ import annotations

import re

DAY = "1997-02-01"
DAY_BEFORE = "1997-01-31"
DAU_DAY = "2024-01-02"
DAU_DAY_BEFORE = "2024-01-01"
AS_OF = "2020-01-01"
RANGE = ("1997-01-01 00:00:00", "1997-02-01 00:00:00")
TOP_N = 10

VIEWS = {
    "fx_startup": """
        SELECT event_id, 'mid_' || user_id AS mid, CAST(user_id AS VARCHAR) AS uid,
               json_extract_string(props, '$.k') AS ar, event_type AS ch, 'v1' AS vc,
               epoch_us(ts) // 1000 AS ts, ts AS event_time
        FROM events""",
    "fx_province": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
               CAST(100 + n_regionkey AS VARCHAR) AS area_code, 'N' || n_nationkey AS iso_code
        FROM nation""",
    "fx_user": """
        SELECT c_custkey AS id,
               CAST(DATE '1950-01-01' + CAST((c_custkey * 37) % 25000 AS INTEGER) AS DATE) AS birthday,
               CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END AS gender
        FROM customer""",
    "fx_user_state": """
        SELECT c_custkey AS user_id, CASE WHEN c_custkey % 10 = 0 THEN '1' ELSE '0' END AS if_consumed FROM customer""",
    "fx_spu": "SELECT min(p_partkey) AS spu_id, p_name AS spu_name FROM part GROUP BY p_name",
    "fx_tm": """
        SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS tm_id, p_brand AS tm_name
        FROM part""",
    "fx_category3": """
        SELECT min(p_partkey) AS category3_id, p_type AS category3_name FROM part GROUP BY p_type""",
    "fx_sku": """
        SELECT p.p_partkey AS sku_id, s.spu_id, t.tm_id, c.category3_id FROM part p
        JOIN fx_spu s ON p.p_name = s.spu_name JOIN fx_tm t ON p.p_brand = t.tm_name
        JOIN fx_category3 c ON p.p_type = c.category3_name""",
    "fx_order_detail": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                         CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
               l_orderkey AS order_id, l_partkey AS sku_id, CAST(l_quantity AS BIGINT) AS sku_num,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS price_c,
               CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT) AS line_c
        FROM lineitem""",
    "fx_order_total": """
        SELECT order_id, CAST(sum(line_c) AS BIGINT) AS orig_c FROM fx_order_detail GROUP BY order_id""",
    "fx_order_info": """
        SELECT o.o_orderkey AS id, CAST(c.c_nationkey AS BIGINT) AS province_id,
               o.o_orderstatus AS order_status, o.o_custkey AS user_id,
               CAST(round(o.o_totalprice * 100) AS BIGINT) AS final_c, t.orig_c,
               o.o_orderdate + to_seconds((o.o_orderkey * 7919) % 86400) AS create_time,
               CASE WHEN o.o_orderstatus = 'P' THEN NULL
                    ELSE o.o_orderdate + to_seconds((o.o_orderkey * 7919) % 86400 + 3600) END AS operate_time
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        LEFT JOIN fx_order_total t ON t.order_id = o.o_orderkey""",
    "fx_first_flag": """
        SELECT o.id, o.user_id, CASE WHEN coalesce(s.if_consumed, '0') <> '1'
               AND row_number() OVER (PARTITION BY o.user_id ORDER BY o.create_time, o.id) = 1
               THEN '1' ELSE '0' END AS if_first_order
        FROM fx_order_info o LEFT JOIN fx_user_state s ON s.user_id = o.user_id""",
    "fx_user_label": f"""
        SELECT id,
               CASE WHEN birthday + INTERVAL 20 YEAR > DATE '{AS_OF}' THEN '20岁以下'
                    WHEN birthday + INTERVAL 50 YEAR > DATE '{AS_OF}' THEN '20岁~50岁'
                    WHEN birthday IS NOT NULL THEN '50岁以上' END AS user_age_group,
               CASE gender WHEN 'M' THEN '男' WHEN 'F' THEN '女' END AS user_gender
        FROM fx_user""",
    "fx_enriched_order": """
        SELECT o.*, CAST(o.create_time AS DATE) AS create_date,
               CAST(hour(o.create_time) AS INTEGER) AS create_hour, f.if_first_order,
               p.name AS province_name, p.area_code AS province_area_code, p.iso_code AS province_iso_code,
               u.user_age_group, u.user_gender
        FROM fx_order_info o JOIN fx_first_flag f ON f.id = o.id
        LEFT JOIN fx_province p ON p.id = o.province_id
        LEFT JOIN fx_user_label u ON u.id = o.user_id""",
    "fx_enriched_detail": """
        SELECT d.*, k.spu_id, k.tm_id, k.category3_id, s.spu_name, t.tm_name, c.category3_name
        FROM fx_order_detail d LEFT JOIN fx_sku k ON k.sku_id = d.sku_id
        LEFT JOIN fx_spu s ON s.spu_id = k.spu_id LEFT JOIN fx_tm t ON t.tm_id = k.tm_id
        LEFT JOIN fx_category3 c ON c.category3_id = k.category3_id""",
    "fx_order_wide": """
        SELECT d.id AS order_detail_id, o.id AS order_id, o.user_id, d.sku_id, d.sku_num, d.line_c,
               o.orig_c, o.final_c, CAST(o.create_time AS DATE) AS dt, o.create_time,
               k.tm_id, t.tm_name, k.spu_id, k.category3_id
        FROM fx_order_info o JOIN fx_order_detail d ON d.order_id = o.id
        LEFT JOIN fx_sku k ON k.sku_id = d.sku_id LEFT JOIN fx_tm t ON t.tm_id = k.tm_id
        WHERE o.operate_time IS NOT NULL""",
    "fx_raw_split": """
        SELECT *, CAST((2 * CAST(line_c AS HUGEINT) * final_c + orig_c) // (2 * CAST(orig_c AS HUGEINT)) AS BIGINT) AS raw_c,
               row_number() OVER (PARTITION BY order_id ORDER BY order_detail_id) AS rn,
               count(*) OVER (PARTITION BY order_id) AS n
        FROM fx_order_wide""",
    "fx_split": """
        SELECT *, CASE WHEN rn < n THEN raw_c
               ELSE CAST(final_c - coalesce(sum(raw_c) OVER (PARTITION BY order_id ORDER BY order_detail_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS share_c
        FROM fx_raw_split""",
    "fx_open_wide": """
        SELECT * REPLACE (CASE WHEN order_id % 7 = 0 THEN orig_c + 100 ELSE orig_c END AS orig_c) FROM fx_order_wide""",
    "fx_open_raw": """
        SELECT *, CAST((2 * CAST(line_c AS HUGEINT) * final_c + orig_c) // (2 * CAST(orig_c AS HUGEINT)) AS BIGINT) AS raw_c,
               row_number() OVER (PARTITION BY order_id ORDER BY order_detail_id DESC) AS from_last,
               sum(line_c) OVER (PARTITION BY order_id) AS lines_c
        FROM fx_open_wide""",
    "fx_dim_changes": """
        SELECT *, 1 AS seq FROM fx_province
        UNION ALL SELECT id, name || '_v2', area_code, iso_code, 2 AS seq FROM fx_province WHERE id % 5 = 0""",
    "fx_dau": """
        SELECT CAST(event_time AS DATE) AS dt, CAST(hour(event_time) AS INTEGER) AS hr, mid, uid, ar, ch, vc, '00' AS mi, ts
        FROM fx_startup
        QUALIFY row_number() OVER (PARTITION BY CAST(event_time AS DATE), mid ORDER BY ts, event_id) = 1""",
    "fx_stat": """
        SELECT CAST(dt AS TIMESTAMP) AS stat_time, tm_id AS trademark_id, tm_name AS trademark_name,
               CAST(sum(share_c) AS BIGINT) AS amount_c
        FROM fx_split GROUP BY 1, 2, 3""",
    "fx_brand_topn": f"""
        SELECT trademark_id, trademark_name, CAST(sum(amount_c) AS BIGINT) AS order_amount
        FROM fx_stat WHERE stat_time > TIMESTAMP '{RANGE[0]}' AND stat_time < TIMESTAMP '{RANGE[1]}'
        GROUP BY 1, 2 ORDER BY order_amount DESC, trademark_id LIMIT {TOP_N}""",
    "fx_amount_hour": """
        SELECT dt, CAST(hour(create_time) AS INTEGER) AS hr, CAST(sum(share_c) AS BIGINT) AS order_amount
        FROM fx_split GROUP BY 1, 2""",
    "fx_device_day": """
        SELECT mid, min(dt) AS first_day FROM fx_dau GROUP BY mid""",
}

CDC_IMAGES = """
    SELECT 'ODS_BASE_PROVINCE' AS topic, CAST(id AS VARCHAR) AS id, name FROM fx_province
    UNION ALL SELECT 'ODS_USER_INFO', CAST(c_custkey AS VARCHAR), c_name FROM customer
    UNION ALL SELECT 'ODS_SKU_INFO', CAST(p_partkey AS VARCHAR), p_name FROM part"""

DIM_LATEST = """
    SELECT id, name, area_code, iso_code FROM fx_dim_changes
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"""

ORDER_COLUMNS = """id, province_id, order_status, user_id, final_c, orig_c, create_time, operate_time"""

SPLIT = "SELECT order_detail_id, order_id, line_c, orig_c, final_c, share_c FROM fx_split"

QUERIES = {
    "json_parse": "SELECT event_id, mid, uid, ar, ch, vc, ts FROM fx_startup",
    "event_date_hour": """
        SELECT event_id, CAST(event_time AS DATE) AS dt, CAST(hour(event_time) AS INTEGER) AS hr FROM fx_startup""",
    "order_date_hour": """
        SELECT id, CAST(create_time AS DATE) AS create_date, CAST(hour(create_time) AS INTEGER) AS create_hour
        FROM fx_order_info""",
    "orders_operated": f"SELECT {ORDER_COLUMNS} FROM fx_order_info WHERE operate_time IS NOT NULL",
    "dim_scan": "SELECT id, name, area_code, iso_code FROM fx_province",
    "dim_scan_user": "SELECT id, birthday, gender FROM fx_user",
    "dim_scan_sku": "SELECT sku_id, spu_id, tm_id, category3_id FROM fx_sku",
    "dim_scan_spu": "SELECT spu_id, spu_name FROM fx_spu",
    "dim_scan_trademark": "SELECT tm_id, tm_name FROM fx_tm",
    "dim_scan_category3": "SELECT category3_id, category3_name FROM fx_category3",
    "dim_upsert": f"{DIM_LATEST} UNION ALL SELECT -1, 'new', '0', 'N'",
    "state_lookup_semi": """
        SELECT user_id, if_consumed FROM fx_user_state s
        WHERE EXISTS (SELECT 1 FROM fx_order_info o WHERE o.user_id = s.user_id)""",
    "cdc_explode": CDC_IMAGES,
    "cdc_route": CDC_IMAGES,
    "order_with_province": """
        SELECT o.id, o.province_id, p.name AS province_name, p.area_code AS province_area_code,
               p.iso_code AS province_iso_code
        FROM fx_order_info o LEFT JOIN fx_province p ON p.id = o.province_id""",
    "order_with_user": """
        SELECT o.id, o.user_id, u.user_age_group, u.user_gender
        FROM fx_order_info o LEFT JOIN fx_user_label u ON u.id = o.user_id""",
    "user_age_group": "SELECT id, user_age_group FROM fx_user_label",
    "user_gender": "SELECT id, user_gender FROM fx_user_label",
    "order_first_flag_raw": """
        SELECT o.id, o.user_id, CASE WHEN s.if_consumed = '1' THEN '0' ELSE '1' END AS if_first_order
        FROM fx_order_info o LEFT JOIN fx_user_state s ON s.user_id = o.user_id""",
    "order_first_flag": "SELECT id, user_id, if_first_order FROM fx_first_flag",
    "new_consumed_users": """
        SELECT user_id, '1' AS if_consumed FROM fx_first_flag WHERE if_first_order = '1'""",
    "enriched_orders": f"""
        SELECT {ORDER_COLUMNS}, create_date, create_hour, if_first_order, province_name,
               province_area_code, province_iso_code, user_age_group, user_gender
        FROM fx_enriched_order""",
    "detail_with_sku": """
        SELECT d.id, d.order_id, d.sku_id, k.spu_id, k.tm_id, k.category3_id
        FROM fx_order_detail d LEFT JOIN fx_sku k ON k.sku_id = d.sku_id""",
    "detail_enriched": """
        SELECT id, order_id, sku_id, sku_num, price_c, spu_id, tm_id, category3_id,
               spu_name, tm_name, category3_name
        FROM fx_enriched_detail""",
    "order_wide": "SELECT * FROM fx_order_wide",
    "order_wide_dedup": "SELECT * FROM fx_order_wide",
    "order_split_amount": SPLIT,
    "order_split_no_residual": """
        SELECT order_detail_id, order_id, line_c, orig_c, final_c, raw_c AS share_c FROM fx_raw_split""",
    "order_split_incomplete": """
        SELECT order_detail_id, order_id, line_c, orig_c, final_c,
               CASE WHEN from_last = 1 AND lines_c = orig_c
                    THEN CAST(final_c - (sum(raw_c) OVER (PARTITION BY order_id) - raw_c) AS BIGINT) ELSE raw_c END AS share_c
        FROM fx_open_raw""",
    "order_wide_table": """
        SELECT w.order_detail_id, w.order_id, o.order_status, w.create_time, w.user_id, w.sku_id,
               w.sku_num, w.final_c, w.share_c, o.if_first_order, o.province_name,
               o.province_area_code, o.user_age_group, o.user_gender, w.dt, w.spu_id, w.tm_id,
               w.category3_id, s.spu_name, w.tm_name, c.category3_name
        FROM fx_split w JOIN fx_enriched_order o ON o.id = w.order_id
        LEFT JOIN fx_spu s ON s.spu_id = w.spu_id
        LEFT JOIN fx_category3 c ON c.category3_id = w.category3_id""",
    "brand_batch_sum": "SELECT stat_time, trademark_id, trademark_name, amount_c FROM fx_stat",
    "brand_topn": "SELECT trademark_id, trademark_name, order_amount FROM fx_brand_topn",
    "brand_chart": """
        SELECT trademark_name AS x, order_amount AS y, CAST(1 AS INTEGER) AS s FROM fx_brand_topn""",
    "order_amount_total": f"""
        SELECT CAST(sum(share_c) AS BIGINT) AS order_amount FROM fx_split WHERE dt = DATE '{DAY}'""",
    "order_amount_by_hour": f"""
        SELECT dt, hr, order_amount FROM fx_amount_hour WHERE dt = DATE '{DAY}'""",
    "hour_map": f"""
        SELECT dt, '{{' || string_agg('"' || hr || '":' || order_amount, ',' ORDER BY hr) || '}}' AS hours
        FROM fx_amount_hour WHERE dt = DATE '{DAY}' GROUP BY dt""",
    "dau_rows": "SELECT dt, hr, mid, uid, ar, ch, vc, mi, ts FROM fx_dau",
    "dau_distinct_check": """
        SELECT CAST(event_time AS DATE) AS dt, count(DISTINCT mid) AS dau FROM fx_startup GROUP BY 1""",
    "dau_total": f"SELECT count(*) AS dau FROM fx_dau WHERE dt = DATE '{DAU_DAY}'",
    "dau_by_hour": f"""
        SELECT hr, count(*) AS dau FROM fx_dau WHERE dt = DATE '{DAU_DAY}' GROUP BY hr""",
    "report_day_total": f"""
        SELECT 'dau' AS id, '新增日活' AS name,
               (SELECT count(*) FROM fx_dau WHERE dt = DATE '{DAU_DAY}') AS value
        UNION ALL SELECT 'new_mid', '新增设备',
               (SELECT count(*) FROM fx_device_day WHERE first_day = DATE '{DAU_DAY}')
        UNION ALL SELECT 'order_amount', '新增交易额',
               (SELECT CAST(sum(share_c) AS BIGINT) FROM fx_split WHERE dt = DATE '{DAY}')""",
    "report_hour_dau": f"""
        SELECT CASE WHEN dt = DATE '{DAU_DAY}' THEN 'today' ELSE 'yesterday' END AS day, hr, count(*) AS value
        FROM fx_dau WHERE dt IN (DATE '{DAU_DAY}', DATE '{DAU_DAY_BEFORE}') GROUP BY 1, 2""",
    "report_hour_amount": f"""
        SELECT CASE WHEN dt = DATE '{DAY}' THEN 'today' ELSE 'yesterday' END AS day, hr,
               order_amount AS value
        FROM fx_amount_hour WHERE dt IN (DATE '{DAY}', DATE '{DAY_BEFORE}')""",
    # Streaming twins: the whole table has gone through the stream by the end.
    "stream_dau_rows": "SELECT dt, mid FROM fx_dau",
    "stream_cdc_explode": CDC_IMAGES,
    "stream_cdc_route": CDC_IMAGES,
    "stream_dim_upsert": DIM_LATEST,
    "stream_dim_user": "SELECT id, CAST(birthday AS VARCHAR) AS birthday, gender FROM fx_user",
    "stream_dim_sku": "SELECT sku_id, spu_id, tm_id, category3_id FROM fx_sku",
    "stream_dim_spu": "SELECT spu_id, spu_name FROM fx_spu",
    "stream_dim_trademark": "SELECT tm_id, tm_name FROM fx_tm",
    "stream_dim_category3": "SELECT category3_id, category3_name FROM fx_category3",
    "stream_orders_by_day": """
        SELECT id, user_id, if_first_order, create_date, create_hour FROM fx_enriched_order""",
    "stream_detail_enriched": """
        SELECT id, order_id, sku_id, sku_num, price_c, spu_id, tm_id, category3_id,
               spu_name, tm_name, category3_name
        FROM fx_enriched_detail""",
    "stream_order_first_flag": """
        SELECT f.id, f.user_id, f.if_first_order, o.province_name, o.user_age_group, o.user_gender
        FROM fx_first_flag f JOIN fx_enriched_order o ON o.id = f.id""",
    "stream_order_wide": """
        SELECT order_detail_id, order_id, user_id, sku_id, sku_num, line_c, orig_c, final_c, dt, create_time
        FROM fx_order_wide""",
    "stream_order_split": """
        SELECT order_id, count(*) AS lines, CAST(sum(line_c) AS BIGINT) AS line_c, CAST(sum(share_c) AS BIGINT) AS share_c,
               count(*) FILTER (share_c <> raw_c) AS adjusted
        FROM fx_split GROUP BY order_id""",
    "stream_order_wide_late_paid": """
        SELECT order_detail_id, order_id, user_id, sku_id, sku_num, line_c, orig_c, final_c, dt, create_time
        FROM fx_order_wide""",
    "stream_order_wide_late_repaired": """
        SELECT order_detail_id, order_id, user_id, sku_id, sku_num, line_c, orig_c, final_c, dt, create_time
        FROM fx_order_wide""",
    "stream_order_wide_resent": """
        SELECT order_detail_id, order_id, user_id, sku_id, sku_num, line_c, orig_c, final_c, dt, create_time
        FROM fx_order_wide""",
    "stream_order_split_late_repaired": """
        SELECT order_id, count(*) AS lines, CAST(sum(line_c) AS BIGINT) AS line_c, CAST(sum(share_c) AS BIGINT) AS share_c,
               count(*) FILTER (share_c <> raw_c) AS adjusted
        FROM fx_split GROUP BY order_id""",
    "stream_new_buyers": """
        SELECT user_id, '1' AS if_consumed FROM fx_first_flag WHERE if_first_order = '1'""",
    "stream_hour_sums": "SELECT dt, hr, order_amount FROM fx_amount_hour",
    "stream_first_seen": "SELECT DISTINCT mid, first_day AS dt FROM fx_device_day",
    "stream_dau_counts": """
        SELECT (SELECT count(*) FROM fx_startup) AS dau_before, (SELECT count(*) FROM fx_dau) AS dau_after""",
    "stream_rejected": """
        SELECT CASE k WHEN 0 THEN 'broken ' || event_id WHEN 1 THEN '{"common":{"mid":"' || mid || '"},"event_id":' || event_id || '}'
                      WHEN 2 THEN '{"ts":' || ts || ',"event_id":' || event_id || '}'
                      WHEN 3 THEN '{"common":{"mid":"' || mid || '"},"ts":"late","event_id":' || event_id || '}'
                      ELSE CAST(event_id AS VARCHAR) END AS value,
               CASE k WHEN 0 THEN 'no JSON object' WHEN 1 THEN 'no ts' WHEN 2 THEN 'no common.mid' WHEN 3 THEN 'no ts'
                      ELSE 'accepted' END AS reason
        FROM (SELECT *, event_id % 7 AS k FROM fx_startup)""",
    "stream_brand_batch_sum": """
        SELECT trademark_id, trademark_name, CAST(sum(amount_c) AS BIGINT) AS amount_c
        FROM fx_stat GROUP BY 1, 2""",
}


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in re.findall(r"\bfx_\w+", sql):
        if name not in found:
            _needed(VIEWS[name], found)
            found.append(name)
    return found


def sql_for(query: str) -> str:
    """The query with the views it needs in front."""
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _needed(query, []))
    return f"WITH {views}\n{query}" if views else query


def all_sql() -> dict[str, str]:
    return {key: sql_for(query) for key, query in QUERIES.items()}
