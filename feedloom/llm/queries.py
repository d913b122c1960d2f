"""The corpus operators as named queries over the driver's tables, and the SQL that checks them."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom.llm import (
    chunk_dedup, class_lm, langid, mixing, ngram_join, packing, repair, span_dedup, token_counts, topk, toxicity, warc, whitening)
from feedloom.llm.common import fold
from feedloom.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_exact_dedup", """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query("op1_ngram_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


#: The topic of a text, here its form; the same words in both dialects.
TOPIC = """case
    when length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', '')) > length(coalesce(text, '')) / 40.0 then 'table'
    when length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!!', '')) > length(coalesce(text, '')) / 20.0 then 'shout'
    when lower(coalesce(text, '')) like '%license%' then 'notice'
    when length(coalesce(text, '')) < 600 then 'note'
    when length(coalesce(text, '')) < 8000 then 'article' else 'longform' end"""
#: Powers of the observed token mass that make the target shares.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Share of the observed token mass that a mixed corpus has.
SIZE = 0.6


def mix_settings() -> dict:
    dims: dict[str, Column] = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.expr(TOPIC)}
    return {"dims": dims, "weight": F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4),
            "targets": {d: mixing.tempered(p) for d, p in POWERS.items()}, "size": SIZE}


def mix_oracle() -> str:
    dims = list(POWERS)
    steps = [f"""rows as materialized (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, {TOPIC} as topic,
        greatest(1, ceil(strlen(coalesce(text, '')) / 4.0))::bigint as weight from documents)""",
             "cells as materialized (select source, lang, topic, sum(weight)::double as mass from rows group by all)"]
    # Shares of the stated size; a value whose share is beyond its mass gives all it has, and the rest share what is left.
    steps += [f"""s_{d} as materialized (select {d}, seen, pow(seen, {p}) / sum(pow(seen, {p})) over () as share, sum(seen) over () * {SIZE} as wanted
        from (select {d}, sum(mass) as seen from cells group by all)),
        l_{d} as (select *, (wanted - coalesce(sum(seen) over (order by seen / share, {d} rows between unbounded preceding and 1 preceding), 0))
            / sum(share) over (order by seen / share, {d} rows between current row and unbounded following) as level from s_{d}),
        t_{d} as materialized (select {d}, case when level * share >= seen then seen
            else greatest(0, max(level) filter (where level * share < seen) over ()) * share end as target from l_{d})""" for d, p in POWERS.items()]
    last, fit = "cells", "mass"
    for k in range(mixing.ROUNDS):
        for d in dims:
            steps.append(f"""f{k}_{d} as materialized (select source, lang, topic, mass,
                least(mass, {fit} * target / sum({fit}) over (partition by {d})) as fit from {last} join t_{d} using ({d}))""")
            last, fit = f"f{k}_{d}", "fit"
    return f"""with {", ".join(steps)},
        odds as (select source, lang, topic, round(fit / mass, {mixing.PLACES}) as probability from {last})
        select doc_id, source, lang, topic, weight, probability,
               round(('0x' || substr(md5('mix' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {1 << 52}.0::double, {mixing.PLACES})
               < probability as kept
        from rows join odds using (source, lang, topic)"""


@query("op4_mix_sources", mix_oracle())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), **mix_settings())


@query("op5_span_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeats(table(spark, sf_dir, "documents"), run=50).select("doc_id", "text", "n_removed")


@query("op7_exact_top_k", """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select query_id, rank::int as rank, vec_id, score from (
    select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score,
           row_number() over (partition by a.vec_id order by list_dot_product(a.q, b.q) desc, b.vec_id) as rank
    from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0)
where rank <= 5
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query("op8_warc", f"""
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex, max(page_id) over (partition by coalesce(html, '')) as keep
           from pages)
select page_id, strlen(payload) as payload_bytes,
       {" || ".join(f'''array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
           lambda s: substr('{warc.BASE32}', ((('0x' || substr(hex, {10 * k + 1}, 10))::bigint >> s) & 31)::int + 1, 1)), '')''' for k in range(4))}
           as payload_digest,
       case when page_id = keep then 'response' else 'revisit' end as record_type,
       case when page_id <> keep then keep end as refers_to
from p
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/feedloom/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path, captured=F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id")))
    return warc.merge_runs(warc.read_runs(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    return langid.identify(docs, may_learn=~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels").filter(~held_out)).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op12_whiten")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=4, scale=256)


@query("op13_class_lm")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), may_learn=fold("doc_id", 7) != 2).drop("perplexity")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows as their conversation and turn damage them; ``times`` is how often each stands there. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("fault", F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(space("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("times"))


def repair_oracle() -> str:
    """The cost programme forwards as a fold: (cost, audit, repaired text) of the four states, row after row."""
    far = "{'c': 1000000000, 'a': '', 'r': ''}"
    add = lambda s, c, letter, line: f"{{'c': {s}.c + {c}, 'a': {s}.a || '{letter}', 'r': {s}.r || {line}}}"
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    user, bot = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

    def set_in(s, body):
        front = f"list_min([{s}[3], {add(f'{s}[1]', 2, 'I', user)}, {add(f'{s}[2]', 2, 'I', user)}, {add(f'{s}[4]', 2, 'I', user)}])"
        return let(front, "fu", let(f"[{s}[1], {s}[2], fu, list_min([{s}[4], {add('fu', 2, 'I', bot)}])]", "s", body))

    gone = lambda k: add(f"s[{k}]", 3, "D", "''")
    keep = lambda k, i: f"case when e.f in ('', 'truncated') and substr(e.x, 1, 1) = '{i}' then {add(f's[{k}]', 'e.n', 'K', 'chr(10) || e.x')} else {far} end"
    turn = lambda k, role: f"case when e.f in ('', 'truncated') then {add(f's[{k}]', '2 + e.n', 'R', f'{role} || e.t')} else {far} end"
    step = set_in("st.s", "[" + ", ".join([
        gone(1), f"list_min([{gone(2)}, {keep(1, 's')}])",
        f"list_min([{', '.join([gone(3), *[keep(k, 'u') for k in (1, 2, 4)], *[turn(k, user) for k in (1, 2, 4)]])}])",
        f"list_min([{gone(4)}, {keep(3, 'a')}, {turn(3, bot)}])"]) + "]")
    best = set_in("st.s", "list_min([s[1], s[4]])")
    begin = f"[{{'c': 0, 'a': '', 'r': ''}}, {far}, {far}, {far}]"
    crc = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
            lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)), 4294967295::bigint)"""
    return f"""with g as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
        k as (select *, {crc} % 20 as c from g),
        d as (select conv_id, turn, case when c = 4 then 'user' else role end as role,
            case when c = 1 then '' when c = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case c when 0 then 0 when 3 then 2 else 1 end)) as copy
            from k),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos from d),
        m as (select *, min(pos) over (partition by conv_id, role, text) < pos as again, lag(role) over (partition by conv_id order by pos) as before from o),
        f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when again then 'duplicate'
            when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') then 'truncated' else '' end as fault from m),
        l as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
            count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
            count(*) filter (where pos > 1 and substr(before, 1, 1) || substr(role, 1, 1) not in ('su', 'ua', 'au')) as illegal,
            list({{'s': {begin}, 'x': role || ':' || text, 't': text, 'f': fault, 'n': (fault = 'truncated')::int}} order by pos) as rows from f group by conv_id),
        r as (select * exclude (rows), list_reduce(list_prepend({{'s': {begin}, 'x': '', 't': '', 'f': '', 'n': 0}}, rows),
            lambda st, e: {{'s': {step}, 'x': '', 't': '', 'f': '', 'n': 0}}) as st from l),
        b as (select * exclude (st), {best} as b from r)
        select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
            coalesce(illegal, 0) as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(b.r[2:], '')) as repaired_sha256
        from (select distinct conv_id from conversations) i left join b on i.conv_id is not distinct from b.conv_id"""


@query("op11_repair_conversations", repair_oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.Plan(damaged(table(spark, sf_dir, "conversations")), times=F.col("times")).digests()
