"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.llm import (
    ann,
    chat,
    decontaminate,
    extraction,
    fingerprint,
    mixing,
    neardup,
    packing,
    quality,
    repair,
    secret_scan,
    spelling,
    toxicity,
)
from shiftlens.llm.shared import remainder, table, vocabulary_path

QUALITY_CUT = 0.7
TOXIC_CUT = 0.5
CUT = 4


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(vectors, F.col("id") % 20 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    held_out = remainder("doc_id", 4) == 2
    model = quality.train(docs, labels, held_out)
    return quality.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"),
    )


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extraction.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return fingerprint.compare_versions(docs, fingerprint.SketchParams(cut=CUT)).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        F.col("to_edited.ok").alias("peeled_edited"),
        F.col("to_next.ok").alias("peeled_next"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return mixing.mix(docs).select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("tokens"),
        F.col("_weight").alias("weight"),
        F.col("_probability").alias("probability"),
        F.col("_kept").alias("kept"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
        "conv_id long, turn long, role string, text string",
    )
    return chat.digests(chat.format_chats(said.unionByName(added)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.train(docs, labels, held_out)
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json")).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secret_scan.span_digests(secret_scan.scan_secrets(docs))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    params = neardup.NearParams(words=3, percent=85, bands=36, rows=7)
    return neardup.near_duplicates(docs, params).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair.summarize(repair.repair(repair.damaged(said)), said)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.decontaminate(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_quality": op2_quality,
    "op3_main_text": op3_main_text,
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op6_chat": op6_chat,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_spelling": op11_spelling,
    "op12_repair": op12_repair,
    "op13_decontamination": op13_decontamination,
}

OP6_SQL = r"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all
    select -7, turn, role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(turn, role)
), marked as (
    select *, role = 'assistant' as learned,
        contains(text, '[INST]') or contains(text, '<s>')
            or (role = 'assistant' and contains(text, '</s>'))
            or (role <> 'assistant' and contains(text, '[/INST]'))
            or regexp_matches(text, '[\[<]\\+/?(INST\]|s>)') as conflict,
        len(regexp_extract_all(text, '[\[<]\\*/?(?:INST\]|s>)')) as controls
    from said
)
select conv_id,
    count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (learned), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (learned), '')) as loss_sha256,
    (sum(length(role) + 1 + length(text) + case when learned then 7 else 13 end)
        + case when bool_or(conflict) then sum(controls) else 0 end)::bigint as formatted_chars
from marked group by conv_id
"""

OP10_SQL = r"""
with recursive docs as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as w
    from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as shingle
    from docs
), sizes as (
    select doc_id, count(shingle) as n from docs left join shingles using (doc_id) group by doc_id
), pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as common
    from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), links as (
    select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * common >= 85 * (x.n + y.n - common)
), edges as (
    select a, b from links union all select b, a from links
), reached as (
    select doc_id as id, doc_id as other from docs
    union
    select e.b, r.other from reached r join edges e on e.a = r.id
)
select id as doc_id, n as n_shingles, min(other) as component_id, min(other) = id as kept
from reached join sizes on doc_id = id group by id, n
"""

# crc32 of a text, byte by byte with the table of its 256 remainders.
CRC_TABLE = """crc_table as (
    select list_transform(range(256), lambda i: list_reduce(
        [i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))) as tab
)"""


def crc_sql(text: str) -> str:
    bits = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return (
        f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], {bits}), "
        "lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])))"
    )


OP11_SQL = rf"""
with recursive {CRC_TABLE}, runs as (
    select doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) as run
    from documents
), counted as (
    select coalesce(doc_id::varchar, '') as id, run, count(*) as n from runs where length(run) >= 7 group by all
), hashed as (
    select run, n, {crc_sql("(id || ':' || run)")} as h from counted, crc_table
), words as (
    select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run) + 2)::int) else run end as word,
        sum(n)::bigint as n
    from hashed group by 1 having length(word) >= 7 and sum(n) >= 2
), gaps as (
    select word, n, unnest(range(length(word))) as k from words
), holes as (
    select word, n, k, left(word, k::int) || substr(word, (k + 2)::int) as rest from gaps
), pairs as (
    select a.word as word, b.word as near, b.n as near_n from holes a join holes b on a.rest = b.rest and a.k = b.k and a.word <> b.word
    union
    select a.word, b.word, b.n from words a join holes b on a.word = b.rest
    union
    select b.word, a.word, a.n from words a join holes b on a.word = b.rest
), best as (
    select word, count(*) as n_near, min({{'less': -near_n, 'near': near}}) as best from pairs group by word
), forms as (
    select word, n, coalesce(n_near, 0) as n_near,
        case when -best.less >= 10 * n then best.near end as form,
        case when -best.less >= 10 * n then -best.less end as form_n
    from words left join best using (word)
), chains as (
    select word, word as root, 0 as step from words
    union all
    select c.word, f.form, step + 1 from chains c join forms f on f.word = c.root where f.form is not null
), ends as (
    select word, arg_max(root, step) as root from chains group by word
)
select word, form, root, n, n_near, form_n from forms join ends using (word)
"""

OP12_SQL = rf"""
with recursive {CRC_TABLE}, said as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {crc_sql("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as fate
    from conversations, crc_table
), hurt as (
    select conv_id, turn, case fate when 4 then 'user' else role end as role,
        case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(range(case fate when 3 then 2 else 1 end)) as copy
    from said where fate <> 0
), numbered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
        row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
    from hurt
), judged as (
    select conv_id, turn, role, text, i,
        case when body = '' then 'blank' when seen > 1 then 'duplicate'
            when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
        coalesce(left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) not in ('su', 'ua', 'au'), false) as illegal
    from numbered
), known as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
        count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal, count(*) as n
    from judged group by conv_id
), shifts as (
    select * from (values ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'P'), ('P', 'u', 'u')) t(top, initial, after)
), inserts as (
    select * from (values ('', '', ''), ('s', '', 's'), ('u', '', 'u'), ('P', '', 'P'), ('', 'u', 'u'), ('', 'ua', 'P'),
        ('s', 'u', 'u'), ('s', 'ua', 'P'), ('u', 'a', 'P'), ('P', 'u', 'u')) t(top, added, after)
), extended as (
    select top, after, 2 * length(added) as cost, repeat('I', length(added)) as audit,
        case added when '' then []::varchar[] when 'u' then ['user:'] when 'a' then ['assistant:'] else ['user:', 'assistant:'] end as lines
    from inserts
), moves as (
    select e.top, e.cost, e.audit, e.lines, e.after as middle, s.initial, s.after from extended e join shifts s on s.top = e.after
), readings as (
    select distinct conv_id, 0::bigint as i, '' as top, 0::bigint as cost, '' as audit, []::varchar[] as lines from conversations
    union all
    select conv_id, i, top, best.cost, best.audit, best.lines from (
        select conv_id, i, top, min({{'cost': cost, 'audit': audit, 'lines': lines}}) as best from (
            select r.conv_id, j.i, e.after as top, r.cost + e.cost + 3 as cost, r.audit || e.audit || 'D' as audit, r.lines || e.lines as lines
            from readings r join judged j on j.conv_id is not distinct from r.conv_id and j.i = r.i + 1 join extended e on e.top = r.top
            union all
            select r.conv_id, j.i, m.after, r.cost + m.cost + case when left(j.role, 1) = m.initial then 0 else 2 end
                    + case j.fault when 'truncated' then 1 else 0 end,
                r.audit || m.audit || case when left(j.role, 1) = m.initial then 'K' else 'R' end,
                r.lines || m.lines || [case when left(j.role, 1) = m.initial then j.role when m.initial = 'u' then 'user' else 'assistant' end || ':' || j.text]
            from readings r join judged j on j.conv_id is not distinct from r.conv_id and j.i = r.i + 1 join moves m on m.top = r.top
            where j.fault not in ('blank', 'duplicate') and (left(j.role, 1) = m.initial or m.initial <> 's')
        ) group by conv_id, i, top
    )
), ended as (
    select r.conv_id, min({{'cost': r.cost + e.cost, 'audit': r.audit || e.audit, 'lines': r.lines || e.lines}}) as best
    from readings r left join known k on k.conv_id is not distinct from r.conv_id join extended e on e.top = r.top and e.after in ('', 'P')
    where r.i = coalesce(k.n, 0) group by r.conv_id
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.cost as cost, best.audit as audit,
    sha256(array_to_string(best.lines, chr(10))) as repaired_sha256
from ended e left join known k on k.conv_id is not distinct from e.conv_id
"""

OP13_SQL = r"""
with docs as (
    select row_number() over () as row, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), items as (
    select coalesce(item_id::varchar, '') as item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), windows as (
    select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(len(w) - least(len(w), 10) + 1),
        lambda i: array_to_string(w[i + 1:i + least(len(w), 10)], ' '))) as win
    from items where len(w) > 0
), lengths as (
    select distinct n from windows
), places as (
    select row, w, n, unnest(range(len(w) - n + 1)) as i from docs, lengths where len(w) >= n
), found as (
    select row, i, p.n, win from (select *, array_to_string(w[i + 1:i + n], ' ') as win from places) p
    semi join windows using (n, win)
), hit as (
    select row, count(distinct k) as n_hit from (select row, unnest(range(i, i + n)) as k from found) group by row
), named as (
    select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
    from (select distinct row, item_id from found join windows using (n, win)) group by row
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from docs left join hit using (row) left join named using (row)
"""

SQL: dict[str, str] = {
    "op6_chat": OP6_SQL,
    "op10_near_duplicates": OP10_SQL,
    "op11_spelling": OP11_SQL,
    "op12_repair": OP12_SQL,
    "op13_decontamination": OP13_SQL,
}
