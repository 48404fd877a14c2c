"""Declared schemas (Spark DDL) of every entity; nothing is inferred on streams."""

from __future__ import annotations

STARTUP_LOG = "common struct<mid:string,uid:string,ar:string,ch:string,vc:string>, ts bigint"
DAU_INFO = "mid string, uid string, ar string, ch string, vc string, dt date, hr int, mi string, ts bigint"

CDC_ARRAY = "`table` string, data array<string>"
CDC_OBJECT = "`table` string, data string"

_MONEY = "decimal(16,2)"

ORDER_INFO = (
    "id bigint, province_id bigint, order_status string, user_id bigint, "
    f"final_total_amount {_MONEY}, benefit_reduce_amount {_MONEY}, "
    f"original_total_amount {_MONEY}, feight_fee {_MONEY}, "
    "expire_time timestamp, create_time timestamp, operate_time timestamp"
)
# What order enrichment adds.
ORDER_INFO_ENRICHED = (
    ORDER_INFO + ", create_date date, create_hour int, if_first_order string, "
    "province_name string, province_area_code string, province_iso_code string, "
    "user_age_group string, user_gender string"
)

ORDER_DETAIL = (
    f"id bigint, order_id bigint, sku_id bigint, order_price {_MONEY}, "
    "sku_num bigint, sku_name string, create_time timestamp"
)
ORDER_DETAIL_ENRICHED = (
    ORDER_DETAIL + ", spu_id bigint, tm_id bigint, category3_id bigint, "
    "spu_name string, tm_name string, category3_name string"
)

ORDER_WIDE = (
    "order_detail_id bigint, order_id bigint, order_status string, create_time timestamp, "
    f"user_id bigint, sku_id bigint, sku_price {_MONEY}, sku_num bigint, sku_name string, "
    f"benefit_reduce_amount {_MONEY}, original_total_amount {_MONEY}, feight_fee {_MONEY}, "
    f"final_total_amount {_MONEY}, final_detail_amount {_MONEY}, if_first_order string, "
    "province_name string, province_area_code string, user_age_group string, user_gender string, "
    "dt date, spu_id bigint, tm_id bigint, category3_id bigint, "
    "spu_name string, tm_name string, category3_name string"
)

USER_STATE = "user_id bigint, if_consumed string"
TRADEMARK_AMOUNT_STAT = (
    f"stat_time timestamp, trademark_id bigint, trademark_name string, amount {_MONEY}"
)

# Dimensions: row schema and primary key.
PROVINCE = "id bigint, name string, area_code string, iso_code string"
USER = "id bigint, birthday string, gender string"
SKU = "sku_id bigint, spu_id bigint, tm_id bigint, category3_id bigint"
SPU = "spu_id bigint, spu_name string"
TRADEMARK = "tm_id bigint, tm_name string"
CATEGORY3 = "category3_id bigint, category3_name string"

DIMENSIONS = {
    "province": (PROVINCE, "id"),
    "user": (USER, "id"),
    "sku": (SKU, "sku_id"),
    "spu": (SPU, "spu_id"),
    "trademark": (TRADEMARK, "tm_id"),
    "category3": (CATEGORY3, "category3_id"),
}

# JSON of the source tables names some columns differently from the dimension
# tables: {dimension: {json field: column}}.
SOURCE_FIELDS = {
    "sku": {"id": "sku_id"},
    "spu": {"id": "spu_id"},
    "category3": {"id": "category3_id", "name": "category3_name"},
}


def columns(ddl: str) -> list[str]:
    """Top-level column names of a flat DDL string."""
    names, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            names.append(part.split()[0].strip("`"))
            part = ""
        else:
            part += ch
    return names


def source_schema(dimension: str) -> str:
    """DDL of a dimension's JSON row image, with the source's own field names."""
    ddl, _ = DIMENSIONS[dimension]
    back = {column: field for field, column in SOURCE_FIELDS.get(dimension, {}).items()}
    return ", ".join(
        " ".join([back.get(name, name), kind])
        for name, kind in (part.split() for part in ddl.split(", "))
    )
