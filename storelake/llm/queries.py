"""The operators as registered queries over the given tables, and SQL where it can say them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelake.llm import (
    block_naming,
    filter_audit,
    fingerprint,
    manifest,
    metric_join,
    mixing,
    near_dups,
    pii,
    quality,
    segmentation,
    sharding,
    toxicity,
    warc,
)
from storelake.session import new_path, ship_package, written

#: A public model; any SentencePiece model with byte pieces will do.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(parts: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == remainder, F.lit(False))


def op1_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, folder, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "positions")


def op3_gumbel_segmentations(spark: SparkSession, folder: str) -> DataFrame:
    return segmentation.sample_segmentations(
        table(spark, folder, "documents"), segmentation.load_pieces(MODEL_FILE))


def op4_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, folder, "documents"))


def op5_probminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"))


def op6_block_names(spark: SparkSession, folder: str) -> DataFrame:
    return block_naming.exact_duplicates(table(spark, folder, "documents"))


def op7_cnn_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    network = toxicity.train(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs.select("doc_id", "lang", "text"), network, name="score")
    return scored.select(
        "doc_id", held_out(5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        toxicity.rejected(network, F.col("score"), F.col("lang")).alias("rejected"))


def op8_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op9_line_field(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    field = quality.train(docs, table(spark, folder, "labels"))
    return quality.score(docs.select("doc_id", "text"), field, name="score").select(
        "doc_id", held_out(3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    legacy, archives = new_path(spark, "arc"), new_path(spark, "warc")
    warc.write_arc(table(spark, folder, "pages"), legacy, version="2")
    warc.arc_to_warc(spark, legacy, archives)
    records = written(warc.read_warc(spark, archives), "warc-records").select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), "record_id", F.col("refers_to").alias("refers"))
    first = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    return records.join(first, "refers", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_metric_range_join(spark: SparkSession, folder: str) -> DataFrame:
    return metric_join.link_similar(table(spark, folder, "embeddings"))


def op12_octopus_manifest(spark: SparkSession, folder: str) -> DataFrame:
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return manifest.prove(
        table(spark, folder, "documents"),
        manifest.leaf_digest(text=F.when(touched, lowered).otherwise(F.col("text"))))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {f.__name__: f for f in (
        op1_minimax_shards, op2_curriculum_mix, op3_gumbel_segmentations, op4_multiset_hash,
        op5_probminhash, op6_block_names, op7_cnn_toxicity, op8_weak_supervision,
        op9_line_field, op10_arc_to_warc, op11_metric_range_join, op12_octopus_manifest,
        op13_filter_audit)}
    return found | {"pipeline": corpus_pipeline.run}


#: Levels of the trees in SQL: enough for 8^8 rows of a language.
SQL_LEVELS = 8


def _manifest_statement() -> str:
    """Trees level by level; a crc32 is a fold over its bits."""
    fields = ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", "text")

    def leaf(**changed: str) -> str:
        return "sha256(concat(" + ", ".join(
            f"coalesce(concat(strlen({v}), ':', {v}), '-')"
            for v in (changed.get(f, f) for f in fields)) + "))"

    lowered = ("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
        range(8 * strlen(cast(doc_id as varchar))), lambda i: case when i % 8 = 0
        then cast(ascii(substr(cast(doc_id as varchar), cast(1 + i // 8 as int), 1)) as bigint)
        else 0 end)), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"""
    parts = [f"""
        rows_ as materialized (
            select doc_id, lang, {leaf()} as leaf,
                   case when {crc} % 3 = 0 then {leaf(text=lowered)} else {leaf()} end as shown
            from documents),
        n0 as materialized (
            select lang, leaf as h, row_number() over (
                partition by lang order by doc_id nulls first, leaf, shown) - 1 as pos from rows_),
        f0 as materialized (
            select doc_id, lang, leaf, shown, '' as proof, shown as folded, row_number() over (
                partition by lang order by doc_id nulls first, leaf, shown) - 1 as pos
            from rows_)"""]

    def climb(names: str, level: int) -> str:
        """One level up: of nodes n (key, h, pos), and of folds f."""
        n, f = names
        return f"""
        r{n}{level} as materialized (
            select lang, pos // 8 as up, list(h order by pos) as hs, sum(count(*)) over (
                partition by lang) as total
            from {n}{level} group by lang, pos // 8),
        {n}{level + 1} as materialized (
            select lang, case when total > 1 then sha256(array_to_string(hs, '')) else hs[1] end
                as h, up as pos from r{n}{level}),
        {f}{level + 1} as materialized (
            select f.* exclude (proof, folded, pos),
                   case when r.total = 1 then f.proof else f.proof || array_to_string(
                       list_concat(hs[:f.pos % 8], hs[f.pos % 8 + 2:]), '') end as proof,
                   case when r.total = 1 then f.folded else sha256(array_to_string(list_concat(
                       hs[:f.pos % 8], [f.folded], hs[f.pos % 8 + 2:]), '')) end as folded,
                   r.up as pos
            from {f}{level} f join r{n}{level} r
                on f.lang is not distinct from r.lang and f.pos // 8 = r.up)"""

    parts += [climb("nf", level) for level in range(SQL_LEVELS)]
    parts.append(f"""
        m0 as materialized (
            select '' as lang, h, row_number() over (order by lang nulls first) - 1 as pos,
                   lang as of_lang from n{SQL_LEVELS}),
        g0 as materialized (
            select f.doc_id, f.leaf, m.h as subroot, f.proof, f.folded, m.pos, '' as lang
            from f{SQL_LEVELS} f join m0 m on f.lang is not distinct from m.of_lang)""")
    parts += [climb("mg", level) for level in range(SQL_LEVELS)]
    return f"""with {",".join(parts)}
        select g.doc_id, g.leaf, g.subroot, m.h as root, sha256(g.proof) as proof_sha256,
               g.folded as folded_root, g.folded = m.h as verified
        from g{SQL_LEVELS} g cross join m{SQL_LEVELS} m"""


#: The counts of every step from one row a document: a join of documents and steps, which
#: small tables allow.
AUDIT = """
    with words as (
        select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
        from documents),
    firsts as (select t, min(doc_id) as first_id from words group by t),
    failed as (
        select w.doc_id, part,
               cast(len(w) < 50 as int) + 2 * cast(100 * len(list_distinct(w)) < 65 * len(w) as int)
               + 4 * cast(100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 5 * length(w.t)
                          as int)
               + 8 * cast(regexp_matches(w.t, '[#$%&*|]') as int)
               + 16 * cast(coalesce(f.first_id < w.doc_id, false) as int) as mask
        from words w join firsts f using (t)),
    marked as (
        select part, mask, count(*) as n, count(*) filter (quality = 1) as good,
               count(*) filter (toxic = 1) as bad
        from failed left join labels using (doc_id) group by part, mask),
    letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
    orders as (
        select a.f || b.f || c.f || d.f || e.f as filter_order,
               [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
        from letters a, letters b, letters c, letters d, letters e
        where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    steps as (
        select filter_order, k as step, bits[k] as bit,
               cast(list_sum(list_concat([0], bits[:k - 1])) as bigint) as before
        from orders, unnest(range(1, 6)) as u(k)),
    sums as (
        select part, filter_order, step, bit,
               sum(case when mask & (bit | before) = 0 then n else 0 end) as kept,
               sum(case when mask & bit <> 0 and mask & before = 0 then n else 0 end) as removed,
               sum(case when mask & bit <> 0 and mask & before <> 0 then n else 0 end)
                   as redundant,
               sum(case when mask = bit then n else 0 end) as unique_fails,
               sum(case when mask & bit <> 0 and mask & before = 0 then good else 0 end)
                   as good_lost,
               sum(case when mask & bit <> 0 and mask & before = 0 then bad else 0 end)
                   as toxic_lost
        from marked, steps group by all)
    select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept,
           cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
           cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
           cast(toxic_lost as bigint) as toxic_lost,
           cast(sum(removed) over (partition by part, bit) as bigint) as shapley
    from sums"""

LINKS = """
    with recursive units as (
        select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v
        from embeddings
        where label is not null and embedding is not null and len(embedding) > 0
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
          and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as materialized (
        select a.vec_id as a, b.vec_id as b
        from units a join units b on a.label = b.label and a.vec_id <> b.vec_id
            and len(a.v) = len(b.v)
        where list_cosine_similarity(a.v, b.v) >= 0.93),
    reached as (
        select vec_id as a, vec_id as b from embeddings
        union
        select r.a, l.b from reached r join links l on r.b = l.a),
    lowest as (select a as vec_id, min(b) as component_id from reached group by a),
    counts as (select a as vec_id, count(*) as n from links group by a)
    select e.vec_id, coalesce(c.n, 0) as n_links, w.component_id,
           e.vec_id = w.component_id as kept
    from embeddings e join lowest w using (vec_id) left join counts c using (vec_id)"""


def statements() -> dict[str, str]:
    import corpus_pipeline

    out = {
        "op11_metric_range_join": LINKS,
        "op12_octopus_manifest": _manifest_statement(),
        "op13_filter_audit": AUDIT,
        "op6_block_names": """
            with named as (
                select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz')) as text_sha256
                from documents),
            groups as (
                select text_sha256, max(doc_id) as keep_id, count(*) as group_size
                from named group by text_sha256)
            select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, n.text_sha256
            from named n join groups g using (text_sha256)""",
        "op10_arc_to_warc": """
            with digested as (
                select page_id, strlen(coalesce(html, '')) as payload_bytes,
                       sha1(coalesce(html, '')) as hex
                from pages),
            in_base_32 as (
                select page_id, payload_bytes, array_to_string(list_transform(
                    range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((
                        cast('0x' || substr(hex, cast(1 + 5 * (i // 4) as int), 5) as bigint)
                        >> cast(15 - 5 * (i % 4) as int)) & 31 as int), 1)), '')
                    as payload_digest
                from digested),
            in_order as (
                select *, row_number() over same as place,
                       first_value(page_id) over same as first_page
                from in_base_32
                window same as (partition by payload_digest order by page_id nulls last))
            select page_id, payload_bytes, payload_digest,
                   case when place = 1 or first_page is null then 'response' else 'revisit' end
                       as record_type,
                   case when place > 1 then first_page end as refers_to
            from in_order""",
    }
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
