"""JSON text -> typed rows.

Every decoder parses a message exactly once. The parsed fields come out of a generator
(`inline`), and Catalyst does not push a later filter below the generator that makes the
filtered column; with a plain projection it would copy the whole parse into the filter,
once for each field the filter names.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart import schemas as S

_JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _inline_json(df: DataFrame, layout: str, value: str, wanted: Column | None = None) -> DataFrame:
    """The parsed fields; messages that are not ``wanted`` are left out unparsed."""
    parsed = F.array(F.from_json(F.col(value), layout, _JSON_OPTIONS))
    return df.select("*", F.inline(parsed if wanted is None else F.when(wanted, parsed)))


def _may_hold(value: str, texts: Iterable[str]) -> Column:
    """False only where none of ``texts`` can be a text of the message: one that is not escaped stands there as it is."""
    return reduce(Column.__or__, (F.col(value).contains(text) for text in (*texts, "\\")))


def parse_log(raw: DataFrame, value: str = "value") -> DataFrame:
    """Behaviour-log messages with the columns of ``RAW_LOG_DDL`` added, and ``fault``.

    ``fault`` names what keeps a record from being used (NULL for a good one).
    """
    parsed = _inline_json(raw, S.RAW_LOG_DDL, value).withColumn("err", json_text("err"))
    return parsed.withColumn("fault", _log_fault(value))


def _log_fault(value: str) -> Column:
    def not_long(name: str, text: str) -> str:
        return f"CASE WHEN try_cast({text} AS BIGINT) IS NULL THEN '{name}' END"

    def any_not_long(items: str, field: str) -> str:
        return (f"CASE WHEN exists({items}, i -> try_cast(i.`{field}` AS BIGINT) IS NULL) "
                f"THEN '{items}.{field}' END")

    on_page = ", ".join([not_long("during_time", "page.during_time"), any_not_long("displays", "pos_id"),
                         any_not_long("displays", "order"), any_not_long("actions", "ts")])
    on_start = ", ".join(not_long(f, f"start.{f}") for f in
                         ("open_ad_skip_ms", "open_ad_ms", "loading_time", "open_ad_id"))
    return F.expr(f"""
        CASE WHEN `{value}` IS NULL OR _corrupt_record IS NOT NULL THEN 'bad_json'
             WHEN err IS NULL THEN nullif(concat_ws(',',
                 CASE WHEN common IS NULL THEN 'common' END, {not_long("ts", "ts")},
                 CASE WHEN page IS NOT NULL THEN nullif(concat_ws(',', {on_page}), '') END,
                 CASE WHEN start IS NOT NULL THEN nullif(concat_ws(',', {on_start}), '') END), '') END""")


def quarantine(parsed: DataFrame, *keep: str, value: str = "value") -> DataFrame:
    """Unusable records of any kind, each with its message and the reason; ``keep`` names further columns."""
    return parsed.where("fault IS NOT NULL").select(*keep, value, F.col("fault").alias("reason"))


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.where("fault IS NULL")


def check_change(raw: DataFrame, value: str = "value") -> DataFrame:
    """Change records: ``type``, ``table``, the row image ``data`` (a VARIANT), the message, and ``fault``.

    A record without type, table, image, or an id in its image cannot be used.
    """
    return _check_change(raw, value)


def _check_change(raw: DataFrame, value: str, wanted: Column | None = None) -> DataFrame:
    parsed = _inline_json(raw, "`type` STRING, `table` STRING, `data` VARIANT, _corrupt_record STRING", value, wanted)
    # The message is looked at only where there is no type, so usable records do not carry it along. Most ids are
    # whole numbers already; a cast out of a VARIANT costs much more per record than asking for its type.
    return parsed.withColumn("fault", F.expr(f"""
        CASE WHEN _corrupt_record IS NOT NULL THEN 'bad_json'
             WHEN type IS NULL THEN CASE WHEN `{value}` IS NULL THEN 'bad_json' ELSE 'type' END
             WHEN table IS NULL THEN 'table'
             WHEN data IS NULL OR is_variant_null(data) THEN 'data'
             WHEN schema_of_variant(try_variant_get(data, '$.id', 'variant')) <=> 'BIGINT' THEN NULL
             WHEN try_variant_get(data, '$.id', 'bigint') IS NULL THEN 'id' END""")).drop("_corrupt_record")


def parse_change(raw: DataFrame, value: str = "value", kinds: Iterable[str] = ()) -> DataFrame:
    """The usable change records, without their messages.

    ``kinds`` are the change types that a reader uses: messages that cannot be of one of them are not parsed.
    Some records of other types may still come out.
    """
    wanted = _may_hold(value, kinds) if kinds else None
    return usable(_check_change(raw, value, wanted)).drop(value, "fault")


def json_text(column: str) -> Column:
    """A VARIANT part as JSON text (keys sorted), NULL for a JSON null.

    Opaque parts are read as VARIANT: read as text, their numbers would pass through DOUBLE.
    """
    return F.when(~F.is_variant_null(column), F.to_json(column))


def check_typed(raw: DataFrame, layout: S.Layout, required: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Fixed records, the message, and ``fault``. Numbers may be quoted; text that is no number becomes NULL.

    A decimal is read as such, which takes both forms and keeps all digits. Other numbers
    are read as text, since the reader takes no quoted ones. A message that is no JSON, or
    whose ``required`` fields are missing or unreadable, cannot be used.
    """
    kept = [c for c in raw.columns if c != value]
    parsed = _inline_json(raw.withColumnsRenamed({c: f"__{c}" for c in raw.columns}),
                          S.text_ddl(layout) + ", _corrupt_record STRING", f"__{value}")
    kinds = dict(layout)
    missing = "".join(f"WHEN try_cast(`{name}` AS {kinds[name]}) IS NULL THEN '{name}' " for name in required)
    fault = F.expr(f"CASE WHEN `__{value}` IS NULL OR _corrupt_record IS NOT NULL THEN 'bad_json' {missing}END")
    return parsed.select(
        *(F.col(f"__{c}").alias(c) for c in kept),
        *(F.col(name) if kind == "STRING" else F.col(name).try_cast(kind).alias(name)
          for name, kind in layout),
        F.col(f"__{value}").alias(value), fault.alias("fault"))


def parse_typed(raw: DataFrame, layout: S.Layout, required: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """The usable fixed records, without their messages."""
    return usable(check_typed(raw, layout, required, value)).drop(value, "fault")
