"""SQL side of the mart inputs: the views of ``sources.driver_tables``, for DuckDB."""

from __future__ import annotations

import re

_COMMON = """mid, user_id, province_id, channel, is_new, model, operate_system, version_code, brand"""
_PAGE = """page_id, last_page_id, page_item, page_item_type, during_time, source_type"""
_CLOCK = """concat(cast(cast(o_orderdate as date) as varchar), ' ', lpad(cast(o_orderkey % 24 as varchar), 2, '0'),
              ':', lpad(cast(({minute}) % 60 as varchar), 2, '0'), ':00')"""
_LINE_ID = """cast('0x' || substr(md5(concat_ws('|', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
              cast(l_partkey as varchar), cast(l_suppkey as varchar),
              cast(cast(l_extendedprice as decimal(12,2)) as varchar),
              cast(cast(l_shipdate as date) as varchar))), 1, 15) as bigint)"""


def age(birthday: str, as_of: str = "date '2001-08-02'") -> str:
    return (f"(year({as_of}) - year({birthday}) - case when month({as_of}) * 100 + day({as_of}) "
            f"< month({birthday}) * 100 + day({birthday}) then 1 else 0 end)")


def has_word(text: str, word: str) -> str:
    return rf"list_contains(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), '{word}')"


def change_kind(key: str) -> str:
    return (f"case {key} % 10 when 0 then 'delete' when 1 then 'update' when 2 then 'update' "
            f"when 3 then 'bootstrap-insert' when 4 then 'bootstrap-start' else 'insert' end")


CHANGE_OP = ("case type when 'insert' then 'I' when 'bootstrap-insert' then 'I' "
             "when 'update' then 'U' when 'delete' then 'D' end")


def _change(name: str, view: str, data: str, kind: str = change_kind("id"), occurrence: int = 0) -> str:
    return (f"select id * 2 + {occurrence} seq, {kind} type, '{name}' \"table\", id, {data} data from {view}")


def _json(**fields: str) -> str:
    """A JSON object as text, keys sorted; a value in quotes stands for a text column, * marks money."""
    parts = []
    for name, source in sorted(fields.items()):
        quote = '"' if source.startswith("'") else ""
        text = f"cast({source.strip("'*")} as varchar)"
        if source.startswith("*"):
            text = f"rtrim(rtrim({text}, '0'), '.')"
        parts.append(f"'\"{name}\":{quote}' || {text} || '{quote}'")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


_USER_JSON = _json(id="id", gender="'gender'", birthday="'birthday'")
_FLIPPED = _USER_JSON.replace(
    "cast(gender as", "cast(case when id % 10 = 1 then (case gender when 'F' then 'M' else 'F' end) else gender end as")

VIEWS = {
    "ev": """select event_id seq, user_id uid, event_type kind, epoch_us(ts) // 1000 ts,
             cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) as bigint) k from events""",
    "logs": """select seq, kind, k, ts, 'mid_' || uid mid, cast(uid as varchar) user_id,
             cast(uid % 25 as varchar) province_id, 'ch' || (k % 3) channel, cast(k % 2 as varchar) is_new,
             'md' || (k % 7) model, 'os' || (k % 2) operate_system, 'v2.1' version_code, 'ba' || (k % 5) brand
             from ev""",
    "page_part": """select *, 'p' || (seq % 5) page_id,
             case when seq % 3 <> 0 then 'p' || ((seq + 1) % 5) end last_page_id,
             cast(seq % 100 as varchar) page_item, 'sku_id' page_item_type,
             cast(seq % 10000 as bigint) during_time, 'query' source_type
             from logs where kind not in ('signup', 'error')""",
    "page": f"select seq, {_COMMON}, {_PAGE}, ts from page_part",
    "display": f"""select seq, {_COMMON}, {_PAGE}, 'promo' display_type, cast((seq + n) % 100 as varchar) display_item,
             'sku_id' display_item_type, n display_order, n % 5 display_pos_id, ts
             from (select *, unnest(range(1, k % 4 + 1)) n from page_part)""",
    "action": f"""select seq, {_COMMON}, {_PAGE}, kind action_id, page_item action_item,
             'sku_id' action_item_type, ts + 500 action_ts, ts
             from page_part where kind in ('click', 'purchase')""",
    "start_log": f"""select seq, {_COMMON}, 'icon' entry, k open_ad_id, k * 10 loading_time_ms,
             k * 3 open_ad_ms, cast(0 as bigint) open_ad_skip_ms, ts from logs where kind = 'signup'""",
    "err": """select seq, '{"error_code":' || k || ',"msg":"boom"}' err from logs where kind = 'error'""",
    "user_info": """select c_custkey id, case when c_custkey % 2 = 0 then 'F' else 'M' end gender,
             cast(cast(date '1965-01-01' + cast((c_custkey * 397) % 11000 as int) as date) as varchar) birthday
             from customer""",
    "base_province": """select cast(n_nationkey as bigint) id, n_name name,
             cast(110000 + n_nationkey * 1000 as varchar) area_code,
             'CN-' || lpad(cast(n_nationkey as varchar), 2, '0') iso_code,
             'R' || n_regionkey || '-' || n_nationkey iso_3166_2 from nation""",
    "sku_info": "select p_partkey id, p_name sku_name, p_brand brand, p_type category from part",
    "movie": """select p_partkey id, p_name name, cast(p_size as double) / 5 score,
             [ 'actor_' || (p_partkey % 7), 'actor_' || (p_partkey % 11), 'actor_' || (p_partkey % 7)] actors
             from part""",
    "order_info": f"""select o_orderkey id, cast(c_nationkey as bigint) province_id, o_orderstatus order_status,
             o_custkey user_id, cast(cast(o_totalprice as decimal(12,2)) as decimal(18,4)) total_amount,
             {_CLOCK.format(minute="o_orderkey")} create_time
             from orders join customer on o_custkey = c_custkey""",
    "order_detail": f"""select {_LINE_ID} id, l_orderkey order_id, l_partkey sku_id,
             cast(cast(p_retailprice as decimal(12,2)) as decimal(18,4)) order_price,
             cast(l_quantity as bigint) sku_num, p_name sku_name,
             {_CLOCK.format(minute="o_orderkey + l_linenumber")} create_time,
             cast(cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2)))
               as decimal(18,4)) split_total_amount,
             cast(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2)) as decimal(18,4))
               split_coupon_amount,
             l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate
             from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "header": f"""select o.*, split_part(o.create_time, ' ', 1) create_date,
             split_part(split_part(o.create_time, ' ', 2), ':', 1) create_hour,
             p.name province_name, p.area_code province_area_code, p.iso_3166_2 province_3166_2_code,
             p.iso_code province_iso_code, cast({age("cast(u.birthday as date)")} as int) user_age,
             u.gender user_gender
             from order_info o left join user_info u on o.user_id = u.id
             left join base_province p on o.province_id = p.id""",
    "order_wide": """select d.id detail_id, d.order_id, d.sku_id, d.order_price, d.sku_num, d.sku_name,
             d.split_total_amount, d.split_coupon_amount, h.province_id, h.order_status, h.user_id,
             h.total_amount, d.create_time, h.create_date, h.create_hour, h.province_name,
             h.province_area_code, h.province_3166_2_code, h.province_iso_code, h.user_age, h.user_gender
             from order_detail d join header h on d.order_id = h.id""",
    "change": " union all ".join([
        _change("order_info", "order_info", _json(
            id="id", province_id="province_id", order_status="'order_status'", user_id="user_id",
            total_amount="*total_amount", activity_reduce_amount="0", coupon_reduce_amount="0",
            original_total_amount="0", feight_fee="0", feight_fee_reduce="0",
            create_time="'create_time'")),
        _change("order_detail", "order_detail", _json(
            id="id", order_id="order_id", sku_id="sku_id", order_price="*order_price", sku_num="sku_num",
            sku_name="'sku_name'", create_time="'create_time'", split_total_amount="*split_total_amount",
            split_activity_amount="0", split_coupon_amount="*split_coupon_amount")),
        _change("user_info", "user_info", _USER_JSON),
        _change("user_info", "user_info", _FLIPPED, "'update'", 1),
        _change("base_province", "base_province", _json(
            id="id", name="'name'", area_code="'area_code'", iso_code="'iso_code'", iso_3166_2="'iso_3166_2'")),
        _change("sku_info", "sku_info", _json(
            id="id", sku_name="'sku_name'", brand="'brand'", category="'category'")),
        _change("noise", "(select cast(r_regionkey as bigint) id, r_name from region)",
                _json(id="id", r_name="'r_name'")),
    ]),
    "op_change": f"select * from (select *, {CHANGE_OP} op from change) where op is not null",
    "fact_change": "select * from op_change where \"table\" in ('order_info', 'order_detail', 'sku_info')",
    "dim_change": "select * from op_change where \"table\" in ('user_info', 'base_province', 'sku_info')",
    "dau": f"""select p.mid, p.user_id, p.province_id, p.channel, p.is_new, p.model, p.operate_system,
             p.version_code, p.brand, p.page_id, p.page_item, p.page_item_type, p.source_type, p.during_time,
             u.gender user_gender, cast({age("cast(u.birthday as date)")} as varchar) user_age,
             b.name province_name, b.iso_code province_iso_code, b.iso_3166_2 province_3166_2,
             b.area_code province_area_code, p.dt, p.hr, p.ts
             from first_page p left join user_info u on cast(p.user_id as bigint) = u.id
             left join base_province b on cast(p.province_id as bigint) = b.id""",
    "day_page": """select *, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') dt,
             strftime(make_timestamp(ts * 1000), '%H') hr from page""",
    "first_page": """select * from (select *, row_number() over (partition by mid, dt order by ts, seq) rn
             from day_page where last_page_id is null) where rn = 1""",
    "visit_page": """select *, last_page_id is null or lag(mid) over w is null opens,
             coalesce(lead(last_page_id is null) over w, true) next_opens
             from page window w as (partition by mid order by ts, seq)""",
}


def with_views(body: str) -> str:
    """``body`` with the views it names, and those they name, put in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)
    visit(body)
    if not needed:
        return body
    return "with " + ",\n".join(f"{name} as ({VIEWS[name]})" for name in needed) + "\n" + body
