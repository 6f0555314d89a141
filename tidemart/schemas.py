"""Row shapes of the warehouse."""

from __future__ import annotations

MONEY = "decimal(16,2)"

PAGE_LOG = (
    "common struct<mid: string, vc: string, ch: string, ar: string, is_new: string>, "
    "page struct<page_id: string, last_page_id: string, item: string, item_type: string, during_time: bigint>, "
    "start struct<entry: string, loading_time: bigint>, displays array<struct<item: string, item_type: string>>, ts bigint"
)
CHANGE = "database string, tableName string, type string, before map<string,string>, after map<string,string>"
ROUTING = "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string"
ORDER_INFO = (
    f"id bigint, province_id bigint, order_status string, user_id bigint, total_amount {MONEY}, activity_reduce_amount {MONEY}, "
    f"coupon_reduce_amount {MONEY}, original_total_amount {MONEY}, feight_fee {MONEY}, expire_time string, create_time string, operate_time string"
)
ORDER_DETAIL = (
    f"id bigint, order_id bigint, sku_id bigint, order_price {MONEY}, sku_num bigint, sku_name string, create_time string, "
    f"split_total_amount {MONEY}, split_activity_amount {MONEY}, split_coupon_amount {MONEY}"
)
PAYMENT_INFO = f"id bigint, order_id bigint, user_id bigint, total_amount {MONEY}, subject string, payment_type string, create_time string, callback_time string"

#: Columns of an order line joined with its order, in order.
ORDER_WIDE = (
    "detail_id order_id sku_id order_price sku_num sku_name province_id order_status user_id total_amount activity_reduce_amount "
    "coupon_reduce_amount original_total_amount feight_fee split_feight_fee split_activity_amount split_coupon_amount split_total_amount "
    "expire_time create_time operate_time create_date create_hour province_name province_area_code province_iso_code province_3166_2_code "
    "user_age user_gender spu_id tm_id category3_id spu_name tm_name category3_name"
).split()
#: Columns of a payment joined with the lines of its order, in order.
PAYMENT_WIDE = (
    "payment_id subject payment_type payment_create_time callback_time".split() + ORDER_WIDE[:18] + ["order_create_time"] + ORDER_WIDE[23:]
)
_texts = {
    "sku_name", "order_status", "expire_time", "create_time", "operate_time", "create_date", "create_hour", "province_name", "province_area_code", "province_iso_code",
    "province_3166_2_code", "user_gender", "spu_name", "tm_name", "category3_name", "subject", "payment_type", "payment_create_time", "callback_time", "order_create_time",
}


def _typed(names: list[str]) -> str:
    kind = lambda c: "string" if c in _texts else MONEY if c.endswith(("amount", "fee", "price")) else "int" if c == "user_age" else "bigint"
    return ", ".join(f"{c} {kind(c)}" for c in names)


#: The two as rows of a topic.
ORDER_WIDE_ROW, PAYMENT_WIDE_ROW = _typed(ORDER_WIDE), _typed(PAYMENT_WIDE)
VISITOR_STATS = "stt edt vc ch ar is_new uv_ct pv_ct sv_ct uj_ct dur_sum ts".split()
PRODUCT_STATS = (
    "stt edt sku_id sku_name sku_price spu_id spu_name tm_id tm_name category3_id category3_name display_ct click_ct favor_ct cart_ct "
    "order_sku_num order_amount order_ct payment_amount paid_order_ct refund_order_ct refund_amount comment_ct good_comment_ct ts"
).split()
PROVINCE_STATS = "stt edt province_id province_name province_area_code province_iso_code province_3166_2_code order_amount order_count ts".split()
KEYWORD_STATS = "keyword ct source stt edt ts".split()
