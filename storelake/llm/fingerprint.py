"""Homomorphic multiset hashes of texts.

A text is a multiset of paragraphs: a paragraph ends at a line break or a sentence's
end, or after eight words. The SHA-256 of a paragraph gives four words of 64 bits and a
vector of 256 signs (its bits), and a text's fingerprint is their sums, the words' modulo
2^64. So the order of paragraphs does not matter, and adding or subtracting those of
paragraphs inserts or deletes them. Two different multisets have the same four words with a
probability of about 2^-256, however often a paragraph is repeated. The sums of signs
estimate how many paragraphs two texts share: their cosine is that of the paragraph
counts, give or take 0.06. They would wrap after 2^63 paragraphs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.llm.text import buffers, slices, spans_of_words

LANES = 256
#: After the lanes of signs, the sums of the digests' words.
DIGEST_WORDS = 4
#: Paragraphs whose signs are held at once.
AT_ONCE = 1 << 15
WORDS = 8
SENTENCE_ENDS = np.frombuffer(b".!?", np.uint8)


def paragraphs(data: np.ndarray, offsets: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (bytes) of each paragraph, and the row it is in."""
    begin, end, row = spans_of_words(data, offsets)
    if not len(begin):
        return begin, end, row
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.ones(len(begin), bool)
    new[1:] = (row[1:] != row[:-1]) | np.isin(data[end[:-1] - 1], SENTENCE_ENDS) | (
        lines[begin[1:]] > lines[end[:-1]])
    place = np.arange(len(begin))
    since = place - np.maximum.accumulate(np.where(new, place, 0))
    first = np.flatnonzero(new | (since % WORDS == 0))
    last = np.append(first[1:], len(begin)) - 1
    return begin[first], end[last], row[first]


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of signs and of digest words of each text; texts without words are all zero."""
    rows = len(offsets) - 1
    out = np.zeros((rows, LANES + DIGEST_WORDS), np.int64)
    begin, end, row = paragraphs(data, offsets)
    view, sha = memoryview(np.ascontiguousarray(data)), hashlib.sha256
    for i in range(0, len(begin), AT_ONCE):
        some = slice(i, i + AT_ONCE)
        digests = np.frombuffer(b"".join([
            sha(view[b:e]).digest()
            for b, e in zip(begin[some].tolist(), end[some].tolist(), strict=True)]),
            np.uint8).reshape(-1, 32)
        signs = 1 - 2 * np.unpackbits(digests, axis=1).view(np.int8)
        own = row[some]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[first], :LANES] += np.add.reduceat(signs, first, axis=0, dtype=np.int64)
        out[own[first], LANES:] += np.add.reduceat(digests.view("<i8"), first, axis=0)
    return out


def vectors_of(column: pa.Array) -> np.ndarray:
    data, offsets = buffers(column)
    parts = [vectors(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
             for i, j in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, LANES + DIGEST_WORDS), np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the signs, 0 at least; 1 for equal rows, 0 if one alone is empty."""
    x, y = a[:, :LANES].astype(np.float64), b[:, :LANES].astype(np.float64)
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), size, out=np.zeros(len(a)), where=size > 0)
    return np.where((a == b).all(1), 1.0, np.clip(cosine, 0, 1))


def shown(rows: np.ndarray) -> list[str]:
    """Base64 of the words, and of the signs in as few bytes (2, 4 or 8) as they all fit in."""
    out = []
    most = np.abs(rows[:, :LANES]).max(axis=1, initial=0)
    words = np.ascontiguousarray(rows[:, LANES:], "<i8")
    for row, word, size in zip(rows, words, most.tolist(), strict=True):
        kind = "<i2" if size < 1 << 15 else "<i4" if size < 1 << 31 else "<i8"
        out.append(base64.b64encode(word.tobytes() + row[:LANES].astype(kind).tobytes()).decode())
    return out


def read(fingerprints: list[str]) -> np.ndarray:
    out = np.zeros((len(fingerprints), LANES + DIGEST_WORDS), np.int64)
    for row, shown_row in zip(out, fingerprints, strict=True):
        data = base64.b64decode(shown_row)
        row[LANES:] = np.frombuffer(data[:8 * DIGEST_WORDS], "<i8")
        signs = data[8 * DIGEST_WORDS:]
        row[:LANES] = np.frombuffer(signs, f"<i{len(signs) // LANES}")
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """The given columns and a fingerprint (base64 of four words and 256 sums of signs).

    Null and empty texts, and those of white space alone, have the zero fingerprint. An
    input column of the same name is replaced.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(shown(vectors_of(batch.column("text"))),
                                               pa.string())], ["row", "fingerprint"])

    kept = [c for c in docs.columns if c != name]
    out = rows.mapInArrow(sums, f"row {rows.schema['row'].dataType.simpleString()}, "
                                "fingerprint string")
    return out.select(*[F.col(f"row.`{c}`") for c in kept], F.col("fingerprint").alias(name))


def changed(fingerprint: str, inserted: list[str] = (), deleted: list[str] = ()) -> str:
    """The fingerprint after whole paragraphs come or go, without the other text."""
    lanes = read([fingerprint])[0]
    lanes = lanes + vectors_of(pa.array(inserted, pa.string())).sum(0, np.int64)
    lanes = lanes - vectors_of(pa.array(deleted, pa.string())).sum(0, np.int64)
    return shown(lanes[None])[0]


def beside_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows in parts, each part in descending id order and followed by the row after it.

    part, guest, doc_id, text; a part's guests (the first rows of the next part, the last
    part's being those of the first) sort after its own rows. No task has more than a
    stretch of ids, and one pass over a part meets each row's next row.
    """
    ids = docs.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)] or [0.5],
                                       10_000)).first()[0] or []
    edges = sorted(set(ids))
    part = F.when(F.col(id_col).isNull(), 0).otherwise(
        1 + F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge < F.col(id_col)))
        if edges else F.lit(1))
    heads = {r[0]: r[1] for r in docs.groupBy(part.alias("part")).agg(F.max(id_col)).collect()}
    order = sorted(heads, reverse=True)
    rows = docs.select(part.alias("part"), F.col(id_col).alias("doc_id"),
                       F.col(text_col).alias("text"))
    # The first row of each part goes to the part before as well.
    targets = [(heads[own], before) for before, own in zip(order, order[1:] + order[:1],
                                                           strict=True)]
    known = [(head, to) for head, to in targets if head is not None]
    unknown = [to for head, to in targets if head is None]
    guest = F.lit(unknown[0] if unknown else None).cast("int")
    if known:
        at = F.array_position(F.array(*[F.lit(head) for head, _ in known]), F.col("doc_id"))
        guest = F.when(F.col("doc_id").isNull(), guest).otherwise(F.get(
            F.array(*[F.lit(to) for _, to in known]), F.nullif(at, F.lit(0)).cast("int") - 1))
    both = F.array_compact(F.array(
        F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")),
        F.when(guest.isNotNull(), F.struct(guest.alias("part"), F.lit(True).alias("guest")))))
    rows = rows.select(F.explode(both).alias("to"), "doc_id", "text").select(
        "to.part", "to.guest", "doc_id", "text")
    return rows.repartitionById(parts + 1, F.col("part")).sortWithinPartitions(
        "part", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as many first characters of the next."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def compared_rows() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pairs(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        changed_texts = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
        own, other, after = (vectors_of(pa.array(x, pa.string()))
                             for x in (texts, changed_texts, nexts))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed_texts]),
            pa.array(shown(own)), pa.array(shown(other)), pa.array(likeness(own, other)),
            pa.array(likeness(own, after))],
            [field.split()[0] for field in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last row of its part so far, for which the next is not known
        ids, texts, nexts, size = [], [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                for part, guest, doc_id, text in zip(
                        *(piece.column(c).to_pylist() for c in
                          ("part", "guest", "doc_id", "text")), strict=True):
                    text = text or ""
                    if waiting is not None and waiting[0] == part:
                        ids.append(waiting[1])
                        texts.append(waiting[2])
                        nexts.append(text)
                        size += len(waiting[2])
                    waiting = None if guest else (part, doc_id, text)
                    if size > 1 << 20:
                        yield pairs(ids, texts, nexts)
                        ids, texts, nexts, size = [], [], [], 0
        if ids:
            yield pairs(ids, texts, nexts)

    return run


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text is the text with its last half (rounded down, in characters) replaced
    by as many first characters of the next document, or all it has; the next document is
    that with the next smaller id, after the last the first. Null texts are empty. Null
    ids come last. Rows of one id stand in the order of a hash of their texts, and where
    a part of the rows begins with repeated ids, the first of them is the next one of the
    part before. A single row is its own next row. An empty table gives an empty result.
    Other columns are not read. ``parts``: number of tasks; the session's number of
    shuffle partitions if not given.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return beside_next(docs, id_col, text_col, parts).mapInArrow(compared_rows(), SCHEMA)
