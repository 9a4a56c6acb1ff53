"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.decontaminate import find_contamination
from patternloom.llm.exact import find_copies, normalised
from patternloom.llm.langid import fit, held_out, identify
from patternloom.llm.licenses import scan_licenses
from patternloom.llm.mixing import mix_sources
from patternloom.llm.near import near_groups
from patternloom.llm.pages import extract_text, train_weights
from patternloom.llm.pii import KINDS, find_personal_data, listed, train_field
from patternloom.llm.resample import resample
from patternloom.llm.roles import repair_roles
from patternloom.llm.rollup import BytePairs, Rollup, Runs, count_tokens, deletes, inserts, revisions
from patternloom.llm.spread import attach
from patternloom.llm.structure import damaged, digests, emptied, repair_structure
from patternloom.llm.toxicity import fit_toxicity, score_toxicity
from patternloom.session import cut_lineage, ensure_checkpoint_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WHITE_SPACE, WORD_RUNS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs, benchmark)
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op2_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aside = held_out(F.col("doc_id"))
    model = fit(docs.where(~aside & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", aside.alias("held_out"), "text"), model).drop("text")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_copies(docs, every_digest=True).withColumnRenamed("digest", "text_sha256")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal_data(docs, train_field(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.array_max(F.transform("licenses", lambda x: F.struct(x["coverage"], x["license"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("licenses").cast("long").alias("n_licenses"),
        best["license"].alias("license"),
        best["coverage"].alias("coverage"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",").alias("spans"),
    )


def op7_token_rollup(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Totals after four batches: all documents, the same again, without exact copies, words counted anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rollup = Rollup.create(spark, f"{ensure_checkpoint_dir(spark)}/rollup/{uuid.uuid4().hex}")
    # Old and new counts of a row stay side by side, with the digest of its text: ids may repeat or be missing.
    again = F.when(F.col("version") == "words", F.coalesce(F.regexp_count("text", F.lit(WORD_RUNS)), F.lit(0)).cast("long"))
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    counted = cut_lineage(count_tokens(docs, {"words": Runs(WHITE_SPACE), "bpe-50k": BytePairs(tokenizer)}, carry={"digest": digest, "new_tokens": again}))
    copies = cut_lineage(find_copies(docs).where("group_size > 1").select("digest", "keep_id", "group_size").distinct())
    gone = cut_lineage(attach(counted, copies, "digest", "group_size", docs.count()).where(~F.col("id").eqNullSafe(F.col("keep_id"))))
    rollup.commit("load", inserts(counted))
    rollup.commit("load", inserts(counted))
    rollup.commit("copies", deletes(gone))
    # Changes add up: all rows are revised, and what was deleted before is taken back.
    back = gone.withColumns({"n_tokens": F.col("new_tokens"), "new_tokens": F.col("n_tokens")})
    words = [revisions(x.where("version = 'words'")) for x in (counted, back)]
    rollup.commit("recount", words[0].unionByName(words[1]))
    return rollup.totals()


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = extract_text(pages.select("page_id", "url", "html"), train_weights(pages))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, similarity=0.8)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_sources(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repaired = digests(repair_structure(damaged(given), "conv", "turn"), "conv").withColumnRenamed("conv", "conv_id")
    nothing = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing |= {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return repaired.unionByName(emptied(given).withColumns(nothing))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).drop("n_words")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    aside = held_out(F.col("doc_id"))
    scored = score_toxicity(docs, fit_toxicity(docs, labels.where(~aside)))
    return scored.select("doc_id", aside.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontaminate, op2_role_repair, op3_language_id, op4_exact_dedup, op5_personal_data,
        op6_license_scan, op7_token_rollup, op8_main_text, op9_near_dedup, op10_mix_sources,
        op11_structure_repair, op12_importance_resample, op13_toxicity,
    )
}

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 in SQL: the table of 256 remainders, and the fold over the bytes of a text.
_CRC_TABLE = """crc_table as (
            select list(v order by i) as t
            from (select i, list_reduce(range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(256) r(i))
        )"""


def _crc32(text: str) -> str:
    data = f"list_transform(range(1, 2 * octet_length(encode({text})) + 1, 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::bigint)"
    return f"xor(list_reduce({data}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"


ORACLES: dict[str, str] = {
    "op1_decontaminate": rf"""
        with docs as (
            select doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
        ), items as (
            select item_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
        ), windows as (
            select distinct item_id, least(len(ws), 13) as k, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') as w
            from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from items where len(ws) > 0)
        ), grams as (
            select doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') as w
            from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i
                  from docs, (select distinct k from windows) where len(ws) >= k)
        ), found as (select doc_id, i, k, item_id from grams join windows using (k, w)),
        hits as (
            select doc_id, count(distinct word) as n_hit
            from (select doc_id, unnest(range(i, i + k)) as word from (select distinct doc_id, i, k from found)) group by doc_id
        ), named as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
            from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
        )
        select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
               cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(listed, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
        from docs left join hits using (doc_id) left join named using (doc_id)
    """,
    "op4_exact_dedup": f"""
        with normal as (select doc_id, {_LOWERED.format("coalesce(text, '')")} as t from documents),
        grouped as (select t, max(doc_id) as keep_id, count(*) as group_size from normal group by t)
        select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
        from normal join grouped using (t)
    """,
    "op9_near_dedup": rf"""
        with recursive docs as (
            select doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as ws from documents
        ), shingles as (
            select distinct doc_id, array_to_string(ws[i : i + 3], ' ') as s
            from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from docs where len(ws) > 0)
        ), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as c
            from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
        ), links as (
            select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
        ), ends as (select a, b from links union select b, a from links),
        reached as (
            select doc_id as a, doc_id as b from documents
            union
            select reached.a, ends.b from reached join ends on ends.a = reached.b
        ), component as (select a as doc_id, min(b) as component_id from reached group by a)
        select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
        from documents join component using (doc_id) left join sizes using (doc_id)
    """,
    "op10_mix_sources": r"""
        with sized as (
            select doc_id, source, md5('mix:' || cast(doc_id as varchar)) as k,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
            from documents
        ), sources as (
            select source, sum(size)::double as s, count(*) as docs,
                   case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as w
            from sized group by source
        ), filled as (
            select *, 2 * s / w as full_at, row_number() over (order by 2 * s / w, source nulls last) as place,
                   1.5 * sum(s) over () - coalesce(sum(2 * s) over before, 0) as room,
                   sum(w) over () - coalesce(sum(w) over before, 0) as weight
            from sources window before as (order by 2 * s / w, source nulls last rows between unbounded preceding and 1 preceding)
        ), level as (select coalesce(arg_min(room / weight, place) filter (where room / weight <= full_at), max(full_at)) as level from filled),
        targets as (
            select source, s, least(w * level, 2 * s) as target, ceil(docs / 10000) as buckets,
                   case when s > 0 then least(w * level, 2 * s) / s else 0 end as rate
            from sources, level
        ), placed as (
            select doc_id, sized.source, k, size, s, target, rate, ('0x' || k[1:8])::bigint % buckets::bigint as bucket
            from sized join targets on sized.source is not distinct from targets.source
        ), ordered as (
            select *, sum(size) over (partition by source, bucket order by k, doc_id) as upto,
                   floor(sum(size) over (partition by source, bucket) * (rate - floor(rate)) + 0.5) as goal
            from placed
        )
        select doc_id, cast(size as bigint) as size, cast(s as bigint) as source_size, round(target, 6) as target,
               cast(floor(rate) * size + greatest(0, least(upto, goal) - (upto - size)) as bigint) as taken
        from ordered
    """,
    "op11_structure_repair": rf"""
        with recursive {_CRC_TABLE},
        given as (select *, {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations, crc_table),
        kept as (
            select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
                   case kind when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text,
                   unnest(case when kind = 3 then [0, 1] else [0] end) as copy
            from given where kind <> 0
        ), seen as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k,
                   row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, role[1:1] as initial
            from kept
        ), faulty as (
            select *, case when bare = '' then 'blank' when again > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
                   lag(initial) over (partition by conv_id order by k) || initial as pair
            from seen
        ), counted as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
                   count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
                   count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
            from faulty group by conv_id
        ), steps(conv_id, k, e, s, u, a) as (
            -- Cheapest (cost, audit) for each initial written last, after k turns.
            select conv_id, 0::bigint, {{'c': 0, 'w': ''}}, {{'c': 1000000, 'w': ''}}, {{'c': 1000000, 'w': ''}}, {{'c': 1000000, 'w': ''}} from counted
            union all
            select conv_id, k, {{'c': e.c + 3, 'w': e.w || 'D'}}, least({{'c': s.c + 3, 'w': s.w || 'D'}}, {{'c': e.c + if(initial = 's', stay, 1000000), 'w': e.w || 'K'}}),
                   list_sort([{{'c': u1.c + 3, 'w': u1.w || 'D'}}] || list_transform([e, s, a1], lambda x: {{'c': x.c + 2 + stay, 'w': x.w || 'R'}})
                             || list_transform([e, s, a1], lambda x: {{'c': x.c + if(initial = 'u', stay, 1000000), 'w': x.w || 'K'}}))[1],
                   list_sort([{{'c': a1.c + 3, 'w': a1.w || 'D'}}, {{'c': u1.c + 2 + stay, 'w': u1.w || 'R'}}, {{'c': u1.c + if(initial = 'a', stay, 1000000), 'w': u1.w || 'K'}}])[1]
            from (select t.*, f.k as next, f.initial, case fault when 'truncated' then 1 when '' then 0 else 1000000 end as stay,
                         list_sort([u, {{'c': e.c + 2, 'w': e.w || 'I'}}, {{'c': s.c + 2, 'w': s.w || 'I'}}, {{'c': a.c + 2, 'w': a.w || 'I'}}])[1] as u1,
                         list_sort([a, {{'c': u.c + 2, 'w': u.w || 'I'}}, {{'c': e.c + 4, 'w': e.w || 'II'}}, {{'c': s.c + 4, 'w': s.w || 'II'}}])[1] as a1
                  from steps t join faulty f on f.conv_id is not distinct from t.conv_id and f.k = t.k + 1) x(conv_id, before, e, s, u, a, k, initial, stay, u1, a1)
        ), best as (
            select steps.conv_id, list_sort([e, a, {{'c': u.c + 2, 'w': u.w || 'I'}}, {{'c': s.c + 4, 'w': s.w || 'II'}}])[1] as b
            from steps join counted on counted.conv_id is not distinct from steps.conv_id and k = n
        ), edits as (select conv_id, unnest(range(1, len(b.w) + 1)) as i, b.w as w from best),
        placed as (select conv_id, i, w[i] as edit, len(replace(w[1 : i], 'I', '')) as k, len(replace(w[1 : i], 'D', '')) as p from edits),
        written as (
            select placed.*, faulty.role, faulty.text, faulty.initial,
                   max(case when p = 1 and edit = 'K' and initial = 's' then 1 else 0 end) over (partition by placed.conv_id) as headed
            from placed left join faulty on faulty.conv_id is not distinct from placed.conv_id and faulty.k = placed.k and edit <> 'I'
        ), texts as (
            select conv_id, string_agg(case when edit = 'K' then role when (p - headed) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by i) as repaired
            from written where edit <> 'D' group by conv_id
        )
        select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.w, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
        from (select distinct conv_id from conversations) ids
        left join counted on counted.conv_id is not distinct from ids.conv_id
        left join best on best.conv_id is not distinct from ids.conv_id
        left join texts on texts.conv_id is not distinct from ids.conv_id
    """,
    "op12_importance_resample": rf"""
        with {_CRC_TABLE},
        docs as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
        doc_words as (select r, unnest(ws) as w from docs),
        target_words as (select unnest(regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
        vocabulary as (select w, {_crc32("w")} % 10000 as bucket from (select w from doc_words union select w from target_words), crc_table),
        source as (select bucket, count(*) as s from doc_words join vocabulary using (w) group by bucket),
        target as (select bucket, count(*) as t from target_words join vocabulary using (w) group by bucket),
        sums as (select (select coalesce(sum(s), 0) from source)::double as all_s, (select coalesce(sum(t), 0) from target)::double as all_t),
        gain as (
            select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (all_s + 10000) / ((coalesce(s, 0) + 1)::double * (all_t + 10000))))::bigint as g
            from (select distinct bucket from vocabulary) left join source using (bucket) left join target using (bucket), sums
        ), weights as (select r, sum(g)::bigint as weight from doc_words join vocabulary using (w) join gain using (bucket) group by r),
        scored as (
            select doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score
            from docs left join weights using (r)
        ), ranked as (
            select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
                   10 * (count(*) filter (n_features >= 20) over ()) // 100 as drawn
            from scored
        )
        select doc_id, n_features, weight, score, case when n_features >= 20 and place <= drawn then place end as rank from ranked
    """,
}
