"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, mixing, ogg, quality, repair, secrets, simhash, tokencount, trie, urlfilter, wavelet, wrapper
from tessera.llm.common import shared_dir, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return bpe.round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = shared_dir(spark)
    wavelet.write_shards(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), 2, path)
    return wavelet.documents(wavelet.read_shards(spark, path))


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.features(ogg.store(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs, rules, keep=["doc_id"])
    return judged.select("doc_id", *[F.col(f"__{k}").alias(k) for k in quality.BASE], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan_corpus(table(spark, sf_dir, "documents")))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark, RULES))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damage(table(spark, sf_dir, "conversations")), gone="gone")


def op12_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_wavelet": op2_wavelet,
    "op3_wrappers": op3_wrappers,
    "op4_ogg": op4_ogg,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_langid": op8_langid,
    "op9_urls": op9_urls,
    "op10_simhash": op10_simhash,
    "op11_repair": op11_repair,
    "op12_tokencount": op12_tokencount,
    "op13_trie": op13_trie,
}

#: CRC-32 of an ASCII text x as an expression of DuckDB.
CRC32 = """xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, length({x}) + 1), lambda i: cast(ascii({x}[i]) as bigint))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v & 1 = 1 then xor(v >> 1, cast(3988292384 as bigint)) else v >> 1 end)), cast(4294967295 as bigint))"""



def _plus(state: str, cost: str, edit: str) -> str:
    """A state of the repair's SQL, nine digits of cost and then the edits, with one more edit; ~ is out of reach."""
    return f"case when {state} = '~' then '~' else lpad(cast(cast({state}[1:9] as int) + {cost} as varchar), 9, '0') || {state}[10:] || {edit} end"


#: One step over a conversation's symbols in the order of states nothing, system, user, assistant; + stands for insertions.
_INSERTED = f"least(s[3], {_plus('s[1]', '3', chr(39) + 'I' + chr(39))}, {_plus('s[2]', '3', chr(39) + 'I' + chr(39))}, {_plus('s[4]', '3', chr(39) + 'I' + chr(39))})"
_TO = {r: [_plus(f"s[{i}]", f"c + if(r = '{r}', 0, 3)", f"if(r = '{r}', 'K', 'R')") for i in states] for r, states in (("u", (1, 2, 4)), ("a", (3,)))}
_DELETED = [_plus(f"s[{i}]", "4", "'D'") for i in range(1, 5)]
REPAIR_STEP = f"""case when x[1] = '+' then list_transform([{_INSERTED}], lambda u: [s[1], s[2], u, least(s[4], {_plus('u', '3', chr(39) + 'I' + chr(39))})])[1]
  else list_transform([{{'r': lower(x[1]), 'c': if(x[1] = upper(x[1]), 3, 0)}}], lambda k: list_transform([k.r], lambda r: list_transform([k.c], lambda c: case when r = 'd' then [{', '.join(_DELETED)}]
    else [{_DELETED[0]}, least({_DELETED[1]}, if(r = 's', {_plus('s[1]', 'c', chr(39) + 'K' + chr(39))}, '~')), least({_DELETED[2]}, {', '.join(_TO['u'])}), least({_DELETED[3]}, {_TO['a'][0]})] end)[1])[1])[1] end"""

SQL: dict[str, str] = {
    "op11_repair": rf"""
with t as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
h as (select *, {CRC32.format(x="k")} % 20 as f from t),
b as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when f = 3 then [0, 1] else [0] end) as c from h where f != 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, c) as pos, row_number() over (partition by conv_id, role, text order by turn nulls first, c) > 1 as again,
    right(regexp_replace(text, '[ 	-]+$', ''), 1) as last from b),
m as (select *, case when last = '' then 'blank' when again then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault, lag(role[1:1]) over (partition by conv_id order by pos) || role[1:1] as pair from o),
y as (select *, case when fault in ('blank', 'duplicate') then 'd' else case when fault = 'truncated' then upper(r) else r end end as symbol from (select *, case when role[1:1] in ('s', 'u', 'a') then role[1:1] else 'x' end as r from m)),
g as (select conv_id, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, list(['+', symbol] order by pos) as symbols from y group by conv_id),
p as (select *, list_reduce(list_prepend(['000000000', '~', '~', '~'], list_transform(flatten(symbols) || ['+'], lambda q: [q])), lambda s, x: {REPAIR_STEP}) as s from g),
e as (select *, cast(least(s[1], s[4])[1:9] as bigint) as cost, least(s[1], s[4])[10:] as audit from p),
a as (select conv_id, i, audit[i] as edit, i - length(replace(audit[1:i], 'I', '')) as inserted from e, unnest(range(1, length(audit) + 1)) as u(i)),
w as (select a.conv_id, a.i, a.edit, y.role, y.text, row_number() over (partition by a.conv_id order by a.i) as n from a left join y on y.conv_id is not distinct from a.conv_id and a.edit != 'I' and y.pos = a.i - a.inserted where a.edit != 'D'),
q as (select *, n - max(case when n = 1 and edit = 'K' and role[1:1] = 's' then 1 else 0 end) over (partition by conv_id) as k from w),
r as (select conv_id, string_agg(case when edit = 'K' then role when k % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by i) as repaired from q group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join e on e.conv_id is not distinct from c.conv_id left join r on r.conv_id is not distinct from c.conv_id
""",
    "op5_mixing": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [3, 1, 2][(row_number() over (order by source is null, source) - 1) % 3 + 1] as w from s),
l as (select *, (cast(1.5 as double) * cast(sum(source_size) over () as double)
        - cast(2 as double) * cast(coalesce(sum(source_size) over (r rows between unbounded preceding and 1 preceding), 0) as double))
        / cast(sum(w) over () - coalesce(sum(w) over (r rows between unbounded preceding and 1 preceding), 0) as double) as level
      from w window r as (order by cast(source_size as double) / w, source is null, source)),
f as (select first(level order by cast(source_size as double) / w, source is null, source) filter (level * w <= cast(2 as double) * source_size) as final from l),
t as (select source, source_size, least(coalesce(final * w, cast(2 as double) * source_size), cast(2 as double) * source_size) as target from l, f),
j as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate
      from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast((floor(rate) + case when cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || 'mix-1'), 1, 13)) as bigint) / cast(4503599627370496 as double)
    < rate - floor(rate) then 1 else 0 end) * size as bigint) as taken
from j
""",
    "op9_urls": r"""
with p as (select page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(rule_host, rule_path, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (select distinct p.host, p.path, rule_host || rule_path as rule, v from p, r
      where (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)),
b as (select * from m qualify row_number() over (partition by host, path order by length(rule) desc, rule) = 1)
select page_id, p.host, p.path, b.rule, coalesce(b.v, 'allow') as verdict from p left join b on p.host = b.host and p.path = b.path
""",
    "op13_trie": rf"""
with t as (select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
    from conversations where conv_id is not null),
o as (select conv_id, list(id order by turn nulls first, id) as ids, list(words order by turn nulls first, id) as words from t group by conv_id),
h as (select *, conv_id - conv_id % 20 as base, {CRC32.format(x="cast(conv_id as varchar)")} % 4 as h from o),
r as (select h.conv_id, coalesce(b.ids[1:h.h], []) || h.ids[h.h + 1:] as ids, coalesce(b.words[1:h.h], []) || h.words[h.h + 1:] as words from h left join o b on b.conv_id = h.base),
m as (select conv_id, d as depth, len(ids) as n, array_to_string(ids[1:d], '') as node, case when d > 0 then words[d] else 0 end as w from r, unnest(range(0, len(ids) + 1)) as u(d)),
g as (select node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(w) as w, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = depth), '')) as ends_sha256 from m group by node, depth),
c as (select g.*, count(k.node) as n_children from g left join g k on k.depth = g.depth + 1 and substr(k.node, 1, 32 * g.depth) = g.node group by all),
s as (select substr(node, 1, 32 * d) as node, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * w) as saved_tokens from c, unnest(range(0, depth + 1)) as u(d) group by 1)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, c.ends_sha256
from c join s on s.node = c.node left join c p on p.depth = c.depth - 1 and p.node = substr(c.node, 1, greatest(length(c.node) - 32, 0))
""",
}
