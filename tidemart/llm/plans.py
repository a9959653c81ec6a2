"""The named queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import (
    decontaminate, html_text, importance, language_net, licenses, line_index, pieces, quality_trees, rule_forest,
    secrets, sharding, simhash, turns)
from tidemart.llm.tables import read
from tidemart.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan
    return register


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op2_html_extract")
def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality_trees.score_quality(docs, quality_trees.fit_quality(docs, labels))


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_forest.rule_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_spans(secrets.find_secrets(read(spark, sf_dir, "documents")))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{licenses.COPYRIGHT_LINE}', '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{licenses.PUNCTUATION}', ' ', 'g'), ' ') || ' '"
    for word, same in licenses.EQUIVALENT.items():
        out = f"replace({out}, ' {word} ', ' {same} ')"
    return out


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.KNOWN)


@query("op7_license_scan", f"""
with known as (
  select sha256({_canonical("text")}) as digest, min(license) as license
  from (values {_KNOWN}) as t(license, text) group by 1),
base as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
units as (
  select rid, 0 as pos, text as unit from base
  union all
  select rid, 1, unnest(string_split(text, chr(10))) from base),
met as (
  select rid, pos, d.digest, k.license
  from (select rid, pos, sha256({_canonical("unit")}) as digest from units) d left join known k using (digest))
select any_value(doc_id) as doc_id, max(digest) filter (where pos = 0) as text_sha256,
       max(license) filter (where pos = 0) as license,
       coalesce((string_agg(distinct license, ',' order by license) filter (where pos > 0)), '') as line_licenses,
       count(license) filter (where pos > 0) as n_lines
from met join base using (rid) group by rid""")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.known_licenses(spark))


_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op8_line_dedup", f"""
with base as (
  select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (
  select rid, doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from base),
keyed as (
  select *, {_LOWER.format(f"trim(line, {_BLANKS})")} as key from lines),
shared as (
  select key, max(doc_id) as last from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
judged as (
  select rid, doc_id, line, pos, s.key is not null and k.doc_id is distinct from s.last as gone
  from keyed k left join shared s on k.key = s.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by rid""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_index.drop_shared_lines(docs, scratch_dir(spark, "line-index")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_tokens", "ids", "round_trip")


def _words(text: str) -> str:
    split = f"string_split_regex({_LOWER.format(text)}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"list_filter({split}, lambda w: w <> '')"


@query("op10_decontaminate", f"""
with docs as (
  select row_number() over () as rid, doc_id, {_words("coalesce(text, '')")} as w from documents),
items as (
  select item_id, {_words("coalesce(text, '')")} as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as size,
         array_to_string(w[i : i + 9], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
sizes as (select distinct size from windows),
words as (select rid, unnest(w) as word, generate_subscripts(w, 1) as i from docs),
places as (
  select rid, i, list(word) over (partition by rid order by i rows between current row and 9 following) as g
  from words),
hits as (
  select rid, i, s.size, item_id from places join sizes s on len(g) >= s.size
  join windows on windows.size = s.size and array_to_string(g[1 : s.size], ' ') = win),
covered as (
  select rid, count(distinct place) as n_hit
  from (select rid, unnest(range(i, i + size)) as place from (select distinct rid, i, size from hits)) group by rid),
found as (
  select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct rid, cast(item_id as varchar) as item from hits where item_id is not null) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (rid) left join found using (rid)""")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


# CRC-32 of a word's bytes, from its rule: no function of the SQL engine has it.
_CRC_TABLE = """list_transform(range(256), lambda n: list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8]::bigint[],
    lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end))"""


def _crc(text: str, table: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(
        range(0, octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), k * 2 + 1, 2))::bigint)),
        lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)))"""


@query("op12_importance", f"""
with docs as (
  select row_number() over () as rid, doc_id, {_words("coalesce(text, '')")} as w from documents),
words as (select rid, unnest(w) as word from docs),
targets as (select unnest({_words("coalesce(text, '')")}) as word from benchmark),
crc_table as (select {_CRC_TABLE} as crcs),
hashed as (
  select word, {_crc("word", "crcs")} % 10000 as bucket
  from (select word from words union select word from targets), crc_table),
corpus as (select bucket, count(*) as s from words join hashed using (word) group by bucket),
target as (select bucket, count(*) as t from targets join hashed using (word) group by bucket),
gains as (
  select word, floor(1000 * ln(
    (coalesce(t, 0) + 1)::double * ((select count(*) from words) + 10000)::double
    / ((coalesce(s, 0) + 1)::double * ((select count(*) from targets) + 10000)::double)))::bigint as gain
  from hashed left join corpus using (bucket) left join target using (bucket)),
weights as (
  select rid, floor(sum(gain)::hugeint / count(*)::double)::bigint as weight
  from words join gains using (word) group by rid),
scored as (
  select rid, doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || sha256('2024:' || coalesce(cast(doc_id as varchar), ''))[1:8])::bigint + 0.5::double) / 4294967296::double
    )))::bigint as score
  from docs left join weights using (rid)),
places as (
  select rid, row_number() over (order by score desc, doc_id nulls last, weight, n_features) as place
  from scored where n_features >= 20)
select doc_id, n_features, weight, score,
       case when place <= 10 * (select count(*) from places) // 100 then place end as rank
from scored left join places using (rid)""")
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "item_id")


# Row by row instead of by spans: per conversation and state the least cost, the least edits for it and what they make.
@query("op13_conversation_repair", f"""
with recursive crc_table as materialized (select {_CRC_TABLE} as crcs),
convs as (select row_number() over () as g, conv_id from (select distinct conv_id from conversations)),
hit as (
  select g, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc("coalesce(cast(c.conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')", "crcs")} % 20 as fate
  from conversations c join convs v on c.conv_id is not distinct from v.conv_id, crc_table),
kept as (
  select g, turn, case when fate = 4 then 'user' else role end as role,
         case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when fate = 3 then 2 else 1 end)) as copy
  from hit where fate <> 0),
numbered as (
  select *, role[1:1] as r, trim(text, {_BLANKS}) as bare,
         row_number() over (partition by g order by turn nulls first, role, sha256(text)) as i
  from kept),
judged as materialized (
  select g, i, r, role, text, turn, bare = '' as blank,
         bare <> '' and row_number() over (partition by g, role, text order by i) > 1 as dup,
         bare <> '' and bare[-1:] not in ('.', '!', '?') as cut,
         lag(r) over (partition by g order by i) as before
  from numbered),
inserts(p, q, c, a, o) as (values
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 3, 'I', chr(10) || 'user:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 2, 3, 'I', chr(10) || 'user:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 2, 3, 'I', chr(10) || 'user:')),
edits(a, p, q, r, role, c) as (values
  ('D', 0, 0, null, null, 4), ('D', 1, 1, null, null, 4), ('D', 2, 2, null, null, 4), ('D', 3, 3, null, null, 4),
  ('K', 0, 1, 's', null, 0), ('K', 0, 2, 'u', null, 0), ('K', 1, 2, 'u', null, 0), ('K', 3, 2, 'u', null, 0),
  ('K', 2, 3, 'a', null, 0), ('R', 0, 2, null, 'user', 3), ('R', 1, 2, null, 'user', 3), ('R', 3, 2, null, 'user', 3),
  ('R', 2, 3, null, 'assistant', 3)),
states(g, i, q, best) as (
  select g, 0::bigint, q, {{'c': c, 'a': a, 'o': o}} from (select distinct g from judged), inserts where p = 0
  union all
  select s.g, j.i, n.q, min({{
    'c': s.best.c + e.c + n.c + case when e.a <> 'D' and j.cut and not j.dup then 3 else 0 end,
    'a': s.best.a || e.a || n.a,
    'o': s.best.o || case when e.a = 'D' then '' else chr(10) || coalesce(e.role, j.role) || ':' || j.text end || n.o}})
  from states s join judged j on j.g = s.g and j.i = s.i + 1
  join edits e on e.p = s.q and (e.r is null or e.r = j.r) and (e.a = 'D' or not (j.blank or j.dup))
  join inserts n on n.p = e.q
  group by s.g, j.i, n.q),
ended as (
  select g, min(best) as best from states s join (select g, max(i) as i from judged group by g) using (g, i)
  where q in (0, 3) group by g),
faults as (
  select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank,
         count(*) filter (where dup) as duplicate, count(*) filter (where cut and not dup) as truncated,
         count(*) filter (where before is not null and before || r not in ('su', 'ua', 'au')) as illegal
  from judged group by g)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost,
       coalesce(best.a, '') as audit, sha256(coalesce(best.o[2:], '')) as repaired_sha256
from convs left join faults using (g) left join ended using (g)""")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return turns.repair(conversations, turns.damaged(conversations))


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_net.predict(docs, language_net.fit(docs))
