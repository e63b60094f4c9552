"""The queries of this subpackage over the given tables, and their SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, fim, host_rules, huffman, langid, licences, line_quality, order_minhash, packing, preference, simhash, toxicity
from ._common import held_out, shared_root, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = preference.preferences(preference.neighbour_pairs(turns), turns)
    spans = {c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string")))) for c in ("chosen_spans", "rejected_spans")}
    return found.withColumns(spans)


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), tau=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select(F.col("id").alias("doc_id"), held_out("id", 3, 1).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "languages")


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = line_quality.score(docs, line_quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out("id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_token_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_root(spark)}/token-files-{uuid.uuid4().hex}"
    huffman.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return huffman.read_ids(spark, path, digest=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.sequences(packing.place(packing.token_pieces(table(spark, sf_dir, "documents"), path)))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs)).withColumnRenamed("id", "doc_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored("output", "form"), 256).alias("restored_sha256"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.with_neighbours(table(spark, sf_dir, "documents"))
    prints = [order_minhash.as_text(c).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", *prints, "near_edited", "near_next")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audits(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_preference": op2_preference,
    "op3_host_rules": op3_host_rules,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_line_quality": op7_line_quality,
    "op8_token_huffman": op8_token_huffman,
    "op9_packing": op9_packing,
    "op10_licences": op10_licences,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_order_minhash": op12_order_minhash,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL = {
    "op2_preference": r"""
        with t as (
            select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, length('<|' || coalesce(role, '') || '|>') + 1 as head,
                   '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as said, turn
            from conversations where conv_id is not null),
        o as (
            select *, row_number() over w as place, sum(length(said)) over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as stop
            from t window w as (partition by conv_id order by turn nulls first, role, text)),
        k as (select conv_id // 2 as pair_id, conv_id % 2 as side, * from o),
        n2 as (
            select pair_id, case when count(distinct side) < 2 then 0 else (
                select coalesce(min(case when not same then place - 1 end), max(place))
                from (select place, count(*) = 2 and min(role) = max(role) and min(text) = max(text) as same from k k2 where k2.pair_id = k.pair_id group by place)) end as n
            from k group by pair_id),
        c as (select k.*, n2.n, coalesce(max(case when place = n2.n then stop end) over (partition by conv_id), 0) as base from k join n2 using (pair_id))
        select pair_id, max(case when side = 0 then conv_id end) as chosen_id, max(case when side = 1 then conv_id end) as rejected_id, max(n)::int as prefix_turns,
               coalesce(string_agg(said, '' order by place) filter (where side = 0 and place <= n), '') as prompt,
               case when bool_or(side = 0) then coalesce(string_agg(said, '' order by place) filter (where side = 0 and place > n), '') end as chosen,
               case when bool_or(side = 1) then coalesce(string_agg(said, '' order by place) filter (where side = 1 and place > n), '') end as rejected,
               coalesce(string_agg((stop - length(said) + head - base)::bigint || '-' || (stop - base)::bigint, ',' order by place) filter (where side = 0 and place > n and role = 'assistant'), '') as chosen_spans,
               coalesce(string_agg((stop - length(said) + head - base)::bigint || '-' || (stop - base)::bigint, ',' order by place) filter (where side = 1 and place > n and role = 'assistant'), '') as rejected_spans
        from c group by pair_id""",
    "op3_host_rules": r"""
        with d as (
            select doc_id, source, coalesce(text, '') as t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
            from documents),
        g as (
            select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
            from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
        r as (
            select doc_id, count(distinct i + k) as n
            from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g), range(3) t(k)
            where c > 1 group by doc_id),
        f as (
            select d.doc_id, source, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
                   (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
                   (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
            from d left join r using (doc_id)),
        b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
        h as (select source, count(*) as n, count(*) filter (where base_failed) as x from b where source is not null group by source),
        m as (select sum(x) / sum(n) as m, avg((x / n) * (x / n)) - avg(x / n) * avg(x / n) - (sum(x) / sum(n)) * (1 - sum(x) / sum(n)) * avg(1.0 / n) as v from h),
        p as (select m, least(greatest(case when v > 0 then m * (1 - m) / v - 1 else 10000 end, 1), 10000) as k from m),
        k as (select source, (x + m * k) / (n + k) <= 0.5 as ok from h, p)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(ok, true) as kept
        from b left join k using (source)""",
    "op11_fill_in_middle": r"""
        with d as (
            select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as l, sha256('7:' || coalesce(doc_id::varchar, '')) as h
            from documents),
        k as (
            select doc_id, t, l, len(l)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[25:32])::bigint as h4,
                   t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') as plain
            from d),
        c as (
            select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b, case when plain then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
            from k),
        p as (select *, array_to_string(l[1:a], '') as p, array_to_string(l[a + 1:b], '') as m, array_to_string(l[b + 1:], '') as s from c)
        select doc_id, n, form, case when not plain then length(p) end as prefix_chars, case when not plain then length(m) end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
               sha256(t) as restored_sha256
        from p""",
}
