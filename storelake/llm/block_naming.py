"""Exact duplicates by deterministic naming of blocks.

Every text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted
and get integers as names; then adjacent names are paired, the distinct pairs sorted and
named in turn, until each text has a single name. Two texts have the same name and the
same number of levels exactly if they are equal: no step relies on a hash being unique.

Names are given in buckets by hash, so that no task sorts everything: a block's name is
its rank in its bucket, times the number of buckets, plus the bucket. A 64-bit hash
stands for a block only after it is known that one block alone has it; for the others
the blocks themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelake.llm.filter_audit import possible_members
from storelake.session import written

BLOCK_BYTES = 4096
BUCKETS = 1024
HASH_BITS = 64
ASCII, OTHERS = r"[\x00-\x7F]", r"[^\x00-\x7F]"


def normalised(text: Column) -> Column:
    """A to Z in lower case, nothing else changed; null counts as empty.

    ``lower`` does that for texts of which it changes nothing beyond ASCII. Of the others
    the stretches of ASCII are changed alone.
    """
    text = F.coalesce(text, F.lit(""))
    beyond = F.regexp_replace(text, f"{ASCII}+", "")
    parts = F.split(text, f"(?<={ASCII})(?={OTHERS})|(?<={OTHERS})(?={ASCII})", -1)
    spared = F.array_join(F.transform(parts, lambda p: F.when(
        p.rlike(f"^{OTHERS}"), p).otherwise(F.lower(p))), "")
    return F.when((F.octet_length(text) == F.char_length(text)) | (F.lower(beyond) == beyond),
                  F.lower(text)).otherwise(spared)


def raw_digest(text: Column) -> Column:
    """Digest of the text as it is; that of an empty text for a null one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def cut(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, bits: int) -> DataFrame:
    """Every block of every text, written: row, at (its number), blocks_left (of the text),
    hash and block. The first block's row also has doc_id, raw_sha256 and text_sha256.

    The bytes of a text are a column before the blocks' numbers are exploded, so a text is
    normalised once, and each block is cut from bytes that are there: linear in the text.
    An empty text has one empty block.
    """
    data = F.col("data")
    whole = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        raw_digest(F.col(text_col)).alias("raw_sha256"),
        F.encode(normalised(F.col(text_col)), "UTF-8").alias("data"))
    count = F.greatest(F.ceil(F.octet_length(data) / block_bytes), F.lit(1)).cast("int")
    numbered = whole.select("row", "doc_id", "raw_sha256", F.sha2(data, 256).alias("text_sha256"),
                            "data", count.alias("blocks_left")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks_left") - 1)).alias("at"))
    block = F.substring(data, F.col("at") * block_bytes + 1, F.lit(block_bytes))
    first = F.col("at") == 0
    rows = numbered.select("row", "at", "blocks_left", block.alias("block"), *[
        F.when(first, F.col(c)).alias(c) for c in ("doc_id", "raw_sha256", "text_sha256")])
    return written(rows.withColumn("hash", block_hash(F.col("block"), bits)), "blocks")


def block_hash(block: Column, bits: int) -> Column:
    whole = F.xxhash64(block)
    return whole if bits == 64 else F.pmod(whole, F.lit(1 << bits))


def name_distinct(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The distinct keys, sorted within buckets, with an integer name each."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    order = Window.partitionBy("bucket").orderBy(*keys)
    return rows.select(*keys).distinct().withColumn("bucket", bucket).select(
        *keys, ((F.row_number().over(order) - 1) * F.lit(buckets).cast("long")
                + F.col("bucket")).alias("name"))


def block_ranks(blocks: DataFrame) -> DataFrame | None:
    """Rank of every block among the different blocks of one hash; None if all are alone.

    Only blocks whose hash occurs more than once are compared.
    """
    shared = written(blocks.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
                     .select("hash"), "shared-hashes")
    distinct = blocks.select("hash", "block").join(shared, "hash", "left_semi").distinct()
    torn = written(distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
                   .select("hash"), "torn-hashes")
    if torn.isEmpty():
        return None
    return written(distinct.join(torn, "hash", "left_semi").withColumn(
        "rank", F.row_number().over(Window.partitionBy("hash").orderBy("block"))), "block-ranks")


def identities(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES,
               buckets: int = BUCKETS, bits: int = HASH_BITS) -> DataFrame:
    """row, doc_id, raw_sha256, text_sha256, levels and name of every row.

    Equal texts, and only they, have the same levels and name.
    """
    blocks = cut(docs, id_col, text_col, block_bytes, bits)
    ranks = block_ranks(blocks)
    rows = blocks.select("row", "at", "blocks_left", "hash", F.lit(0).alias("rank"))
    if ranks is not None:
        rows = blocks.select("row", "at", "blocks_left", "hash", "block").join(
            ranks, ["hash", "block"], "left").fillna(0, "rank").drop("block")
        rows = written(rows, "ranked-blocks")
    keys, levels = ["hash", "rank"], []
    named = written(rows.select("row", "at", "blocks_left", *keys).join(
        name_distinct(rows, keys, buckets), keys).drop(*keys), "names")
    while True:
        levels.append(named.filter("blocks_left = 1").select(
            "row", F.lit(len(levels)).alias("levels"), "name"))
        named = named.filter("blocks_left > 1")
        if named.isEmpty():
            break
        pairs = named.groupBy("row", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1))
            .alias("right"),
            F.ceil(F.max("blocks_left") / 2).cast("int").alias("blocks_left"))
        pairs = written(pairs, "pairs")
        named = written(pairs.join(name_distinct(pairs, ["left", "right"], buckets),
                                   ["left", "right"]).drop("left", "right"), "names")
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return blocks.filter("at = 0").select("row", "doc_id", "raw_sha256", "text_sha256").join(
        found, "row")


def verdicts(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, buckets: int,
             bits: int) -> DataFrame:
    """What exact_duplicates gives, and raw_sha256."""
    rows = written(identities(docs, id_col, text_col, block_bytes, buckets, bits), "identities")
    same = ["levels", "name"]
    groups = rows.groupBy(*same).agg(
        F.max(F.struct("doc_id", "raw_sha256", "row")).alias("keeper"),
        F.count("*").alias("group_size"))
    return rows.join(groups, same).select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keeper.row")).alias("kept"), "text_sha256", "raw_sha256")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS,
                     bits: int = HASH_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when they are identical after lower-casing A to Z; null counts as
    empty. Of equal texts the row with the largest id stays (keep_id). Null ids are
    smaller than all others; a group of null ids alone has a null keep_id. Of rows of one
    id the one whose text as it is has the largest digest stays, of repeated rows any one.
    Other columns are not read. An empty table gives an empty result. ``bits``: of the
    block hash; fewer make shared hashes frequent, the result is the same.
    """
    return verdicts(docs, id_col, text_col, block_bytes, buckets, bits).drop("raw_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
                          ) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows are known by id and text as it is. Of rows equal in both the first one in the
    order of all their columns stays.
    """
    found = verdicts(docs, id_col, text_col, BLOCK_BYTES, BUCKETS, HASH_BITS)
    by_key = written(found.groupBy("doc_id", "raw_sha256").agg(
        F.max("kept").alias("stays"), F.count("*").alias("n")).filter("n > 1 or not stays").select(
        F.struct("doc_id", "raw_sha256").alias("gone_key"), "stays"), "gone")
    return rows_left(docs, F.struct(
        F.col(id_col).alias("doc_id"), raw_digest(F.col(text_col)).alias("raw_sha256")), by_key)


def rows_left(docs: DataFrame, key: Column, by_key: DataFrame) -> DataFrame:
    """The rows whose key (a struct) is no gone_key, and one row of each key that stays.

    Of rows of a key that stays the first one in the order of all their columns is left.
    Only rows that a sketch of the keys does not clear are written and shuffled.
    """
    maybe = possible_members(by_key.select(F.xxhash64("gone_key").alias("hash")))
    rows = docs.select(F.struct("*").alias("row"), key.alias("row_key")).withColumn(
        "met", maybe(F.xxhash64("row_key")))
    met = written(rows.filter("met").select("row", "row_key"), "rows-met")
    # Structs are equal if their fields are, nulls too.
    same = F.expr("row_key = gone_key")
    clean = met.join(by_key, same, "left_anti").select("row.*")
    first = Window.partitionBy("row_key").orderBy(F.to_json("row"))
    repeated = met.join(by_key.filter("stays"), same, "left_semi").withColumn(
        "number", F.row_number().over(first)).filter("number = 1").select("row.*")
    return rows.filter("not met").select("row.*").unionByName(clean).unionByName(repeated)
