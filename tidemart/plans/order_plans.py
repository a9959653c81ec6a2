"""Orders: typed topics, the order-wide join, and what is asked of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart import schemas as S
from tidemart.functions import scalars, text
from tidemart.operators import documents, orders, reports, search
from tidemart.plans import inputs as I
from tidemart.plans.registry import query
from tidemart.plans.views_sql import age, change_kind, has_word, with_views
from tidemart.session import scratch_dir
from tidemart.sinks import bucketed
from tidemart.sources import driver_tables as D, tables

KEYWORD = "Red ring"
_ALL_WORDS = f"{has_word('sku_name', 'red')} and {has_word('sku_name', 'ring')}"
_NONE = "cast(null as varchar)"

_HEADER = {
    "total_amount": "cast({}total_amount as double)",
    **{c: "cast(0 as double)" for c in (
        "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount",
        "feight_fee", "feight_fee_reduce")},
    **{c: _NONE for c in ("expire_time", "refundable_time", "operate_time")},
}
_LINE = {
    "order_price": "cast({}order_price as double)",
    "split_total_amount": "cast({}split_total_amount as double)",
    "split_activity_amount": "cast(0 as double)",
    "split_coupon_amount": "cast({}split_coupon_amount as double)",
}


def _fields(layout: S.Layout, made: dict[str, str], prefix: str = "", view: str = "") -> str:
    return ", ".join(f"{made.get(c, '{}' + c).format(view)} {prefix}{c}" for c in S.names(layout))


WIDE_SQL = f"select {_fields(S.ORDER_WIDE, {**_HEADER, **_LINE})} from order_wide"
_INSERTED = "in ('insert', 'bootstrap-insert')"


def _inserted(view: str) -> str:
    return f"(select * from {view} where {change_kind('id')} {_INSERTED})"


@query("parse_typed_header", with_views(
    f"select {_fields(S.ORDER_HEADER, _HEADER)} from {_inserted('order_info')}"))
def parse_typed_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = I.stored_topics(spark, sf_dir, "order_info")
    return I.result(I.inserted(spark, topics, "order_info", S.ORDER_HEADER))


@query("parse_typed_line", with_views(
    f"select {_fields(S.ORDER_LINE, _LINE)} from {_inserted('order_detail')}"))
def parse_typed_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = I.stored_topics(spark, sf_dir, "order_detail")
    return I.result(I.inserted(spark, topics, "order_detail", S.ORDER_LINE))


@query("order_detail_full_outer", with_views(f"""
    select coalesce(h.id, d.order_id) order_id, h.id header_id, d.id detail_id, h.create_time header_time,
           d.create_time line_time
    from {_inserted('order_info')} h full join {_inserted('order_detail')} d on h.id = d.order_id"""))
def order_detail_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New headers and new lines; many of either have no partner."""
    joined = orders.full_outer(*I.parsed_topics(spark, sf_dir, ["id", "create_time"], ["id", "order_id", "create_time"]))
    return joined.select("order_id", F.col("h_id").alias("header_id"), F.col("d_id").alias("detail_id"),
                         F.col("h_create_time").alias("header_time"), F.col("d_create_time").alias("line_time"))


UNMATCHED_SQL = with_views(f"""
    select 'header' side, id, id order_id from {_inserted('order_info')}
    where id not in (select order_id from {_inserted('order_detail')})
    union all select 'line', id, order_id from {_inserted('order_detail')}
    where order_id not in (select id from {_inserted('order_info')})""")


@query("unmatched_orders", UNMATCHED_SQL)
def unmatched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, lines = I.parsed_topics(spark, sf_dir, ["id"], ["id", "order_id"])
    return (orders.unmatched_headers(headers, lines)
            .select(F.lit("header").alias("side"), "id", F.col("id").alias("order_id"))
            .unionByName(orders.unmatched_lines(headers, lines)
                         .select(F.lit("line").alias("side"), "id", "order_id")))


@query("order_wide_batch", with_views(WIDE_SQL))
def order_wide_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.result(I.order_wide(spark, sf_dir))


@query("order_wide_bucketed", with_views(WIDE_SQL))
def order_wide_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From tables stored in buckets by order; the join moves neither."""
    stored = bucketed.store(I.headers(spark, sf_dir), D.order_detail(spark, sf_dir), scratch_dir(spark, "bucketed"), 16)
    return I.result(stored.wide())


@query("merge_order_wide", with_views("""
    select d.id detail_id, h.id order_id, d.create_time, h.create_time header_time, h.create_date
    from order_detail d join header h on d.order_id = h.id"""))
def merge_order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides have a create_time; the wide row has the line's."""
    header = I.headers(spark, sf_dir).withColumn("order_status", F.col("create_time"))
    wide = orders.merge_order_wide(orders.join_order_lines(header, D.order_detail(spark, sf_dir)))
    return wide.select("detail_id", "order_id", "create_time",
                       F.col("order_status").alias("header_time"), "create_date")


@query("split_create_time", with_views("select id, create_date, create_hour from header"))
def split_create_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = F.col("create_time")
    return D.order_info(spark, sf_dir).select(
        "id", scalars.create_date(created).alias("create_date"), scalars.create_hour(created).alias("create_hour"))


@query("age_years", with_views(f"""select id, birthday, cast({age("cast(birthday as date)")} as int) age from user_info"""))
def age_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.user_info(spark, sf_dir).select(
        "id", "birthday", scalars.age_years(F.col("birthday").cast("date"), I.as_of()).alias("age"))


@query("sales_by_field", with_views(f"""
    select province_name as name, cast(sum(split_total_amount) as double) total_amount, count(*) doc_count
    from order_wide where {_ALL_WORDS} and province_name is not null group by 1
    order by doc_count desc, name limit 100"""))
def sales_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sales_by_field(I.order_wide(spark, sf_dir), KEYWORD, "province_name")


def _bands(field: str, bands: list[tuple[str, str]]) -> str:
    parts = [f"select {i} pos, '{name}' as name, cast(coalesce(sum(case when {test} then split_total_amount end), 0) "
             f"as double) as value from hits having count(*) > 0" for i, (name, test) in enumerate(bands)]
    hits = with_views(f"select * from order_wide where {_ALL_WORDS} and {field} is not null")
    return f"with hits as ({hits}) " + " union all ".join(parts)


_BY_GENDER = ("user_gender", [(reports.MALE, "user_gender <> 'F'"), (reports.FEMALE, "user_gender = 'F'")])
_BY_AGE = ("user_age", [
    (reports.UNDER_20, "user_age < 20"), (reports.FROM_20_TO_29, "user_age between 20 and 29"),
    (reports.FROM_30, "user_age >= 30")])


@query("sales_by_gender", _bands(*_BY_GENDER))
def sales_by_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sales_by_gender(I.order_wide(spark, sf_dir), KEYWORD)


@query("sales_by_age_band", _bands(*_BY_AGE))
def sales_by_age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sales_by_age_band(I.order_wide(spark, sf_dir), KEYWORD)


@query("stats_by_item", "select 'gender' kind, * from ({}) union all select 'age', * from ({})".format(
    *(_bands(*b) for b in (_BY_GENDER, _BY_AGE))))
def stats_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of statistics the dashboard asks for, by the name it asks with."""
    wide = I.order_wide(spark, sf_dir)
    parts = [reports.stats_by_item(wide, KEYWORD, None, kind).select(F.lit(kind).alias("kind"), "*")
             for kind in ("gender", "age")]
    return parts[0].unionByName(parts[1])


_MARKED = r"regexp_replace({}, '(?i)\b(red|ring)\b', '<em>\1</em>', 'g')"


_PAGE_2 = with_views(f"""
    select detail_id, create_time, cast(order_price as double) order_price, province_name,
           {_MARKED.format('sku_name')} sku_name, sku_num, cast(total_amount as double) total_amount,
           user_age, user_gender, count(*) over () total
    from order_wide where {_ALL_WORDS} order by create_time, detail_id limit 20 offset 20""")


@query("detail_page", _PAGE_2)
def detail_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.result(search.detail_page(I.order_wide(spark, sf_dir), KEYWORD, page=2))


@query("detail_page_far", _PAGE_2.replace("limit 20 offset 20", "limit 2 offset 24"))
def detail_page_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page found as those far down are; it costs what the first one would."""
    return I.result(search.detail_page(I.order_wide(spark, sf_dir), KEYWORD, page=13, page_size=2, near=0))


@query("total_hits", with_views(f"select count(*) total from order_detail where {_ALL_WORDS}"))
def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.total_hits(D.order_detail(spark, sf_dir), text.match_all_terms(F.col("sku_name"), KEYWORD))


@query("match_all_terms", with_views(f"select id, order_id, sku_name from order_detail where {_ALL_WORDS}"))
def match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.order_detail(spark, sf_dir)
    return lines.where(text.match_all_terms(F.col("sku_name"), KEYWORD)).select("id", "order_id", "sku_name")


@query("match_any_term", with_views(f"""
    select id, order_id, sku_name from order_detail
    where {has_word('sku_name', 'red')} or {has_word('sku_name', 'ring')}"""))
def match_any_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.order_detail(spark, sf_dir)
    return lines.where(text.match_any_term(F.col("sku_name"), KEYWORD)).select("id", "order_id", "sku_name")


@query("highlight", with_views(f"select id, {_MARKED.format('sku_name')} sku_name from sku_info"))
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sku_info(spark, sf_dir).select("id", text.highlight(F.col("sku_name"), KEYWORD).alias("sku_name"))


@query("fetch_source", with_views(f"""
    select {_fields([c for c in S.ORDER_WIDE if c[0] in search.DETAIL_FIELDS], {**_HEADER, **_LINE})} from order_wide"""))
def fetch_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.result(search.fetch_source(I.order_wide(spark, sf_dir)))


_MOVIE_NAME = "red ring"


@query("term_filter", with_views(f"select id, name from movie where name = '{_MOVIE_NAME}'"))
def term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.movie(spark, sf_dir).where(documents.term("name", _MOVIE_NAME)).select("id", "name")


@query("range_filter", with_views("select id, name, score from movie where score >= 5"))
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.movie(spark, sf_dir).where(documents.in_range("score", 5.0)).select("id", "name", "score")


@query("bool_query", with_views(f"""
    select id, name, score from movie where score >= 5 and ({has_word('name', 'red')} or {has_word('name', 'ring')})"""))
def bool_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = documents.bool_query(filters=[documents.in_range("score", 5.0)],
                                     must=[text.match_any_term(F.col("name"), KEYWORD)])
    return D.movie(spark, sf_dir).where(condition).select("id", "name", "score")


@query("search_by_condition", with_views(f"""
    select id, {_MARKED.format('name')} as name, score, count(*) over () total from movie
    where score >= 5 and ({has_word('name', 'red')} or {has_word('name', 'ring')})
    order by score desc, id limit 20"""))
def search_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_by_condition(D.movie(spark, sf_dir), KEYWORD, min_score=5.0)


@query("sort_topk", with_views("select id, name, score from movie order by score desc, id limit 20 offset 20"))
def sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    movies = D.movie(spark, sf_dir).select("id", "name", "score")
    return search.top_rows(movies, [F.desc("score"), "id"], 20, 20)


@query("get_by_id", with_views("select id, name, score from movie where id = 42"))
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.get_by_id(D.movie(spark, sf_dir), 42).select("id", "name", "score")


@query("get_by_id_stored", with_views("select id, name, score from movie where id in (42, 4242, 142)"))
def get_by_id_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a table in 64 ranges of the id, of which a look-up reads one."""
    path = scratch_dir(spark, "by-id")
    tables.write_by_key(D.movie(spark, sf_dir).select("id", "name", "score"), path, "id", 64)
    stored = spark.read.parquet(path)
    return reduce(DataFrame.union, (tables.get_by_id(stored, i) for i in (42, 142, 4242)))


@query("term_filter_stored", with_views("select id, name, score from movie where name = 'red ring'"))
def term_filter_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "by-name")
    tables.write_by_key(D.movie(spark, sf_dir).select("id", "name", "score"), path, "name", 64)
    return spark.read.parquet(path).where(documents.term("name", "red ring"))


_ACTORS = """select name, count(*) doc_count,
    cast(sum(cast(score as decimal(18,6))) as double) / count(*) avg_score
    from (select score, unnest(list_distinct(actors)) as name from movie) group by name"""


@query("nested_array_key", with_views(_ACTORS))
def nested_array_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.group_by_nested(D.movie(spark, sf_dir), "actors", "name", "score")


@query("avg_by_actor", with_views(f"{_ACTORS} order by avg_score desc, name limit 10"))
def avg_by_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.avg_by_actor(D.movie(spark, sf_dir))


@query("bucket_order", with_views(f"select name, avg_score from ({_ACTORS}) order by avg_score desc, name limit 5"))
def bucket_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in order of a measure of theirs: the five best."""
    return documents.avg_by_actor(D.movie(spark, sf_dir), groups=5).select("name", "avg_score")


@query("bucket_limit", with_views("""
    select sku_id, count(*) doc_count from order_detail group by sku_id order by doc_count desc, sku_id limit 100"""))
def bucket_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = D.order_detail(spark, sf_dir).groupBy("sku_id").agg(F.count("*").alias("doc_count"))
    return search.top_rows(groups, [F.desc("doc_count"), "sku_id"], 0, 100)
