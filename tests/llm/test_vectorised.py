"""Segmentations, fingerprints, near duplicates, classifiers and archives."""

from __future__ import annotations

import base64
import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storelake.llm import (
    fingerprint,
    near_dups,
    quality,
    queries,
    segmentation,
    text,
    toxicity,
    warc,
)
from storelake.llm.queries import MODEL_FILE
from storelake.session import new_path, ship_package
from tests.compare import difference
from tests.llm.test_native import DOCS, ODD


@pytest.fixture(scope="module")
def odd(spark):
    ship_package(spark)
    docs = spark.createDataFrame(ODD, DOCS)
    return docs.selectExpr("*", "1 as score", "'x' as node", "2 as row", "3 as draw", "4 as part",
                           "5 as guest", "6 as ids", "'y' as toxicity", "7 as quality_score")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def pieces():
    return segmentation.load_pieces(MODEL_FILE, sharpness=0.4)


def test_words_and_hashes():
    texts = ["Ab  cd\n", "", "é x", "ab cd"]
    data, offsets = text.buffers(pa.array(texts))
    begin, end, row = text.spans_of_words(data, offsets)
    words = [bytes(data[b:e]).decode() for b, e in zip(begin, end, strict=True)]
    assert words == ["Ab", "cd", "é", "x", "ab", "cd"] and row.tolist() == [0, 0, 2, 2, 3, 3]
    names = text.Hasher(text.lowered(data))(begin, end)
    assert names[0] == names[4] and names[1] == names[5] and len(set(names.tolist())) == 4


def all_segmentations(content, pieces):
    scores = dict(zip(pieces.content, pieces.score, strict=False))
    data, out = b" " + content.encode(), []

    def go(at, path, total):
        if at == len(data):
            out.append((path, total))
            return
        for size in range(1, pieces.longest + 1):
            piece = data[at:at + size]
            if len(piece) == size and piece in scores:
                go(at + size, (*path, piece), total + scores[piece])
        char = data[at:].decode(errors="ignore")[0].encode()
        if char not in scores:
            go(at + len(char), (*path, *[(b,) for b in char]),
               total + len(char) * pieces.score[-1])

    go(0, (), 0.0)
    whole = np.logaddexp.reduce([t for _, t in out])
    return {p: t - whole for p, t in out}


def draws_of(texts, pieces, k, **options):
    data, offsets = segmentation.spaced(*text.buffers(pa.array(texts)))
    search = segmentation.Search(data, offsets, text.mix(np.arange(len(texts), dtype=np.uint64)),
                                 pieces)
    lattice = search.lattice
    size = len(pieces.content)

    def names(arcs):
        return tuple(pieces.content[p] if p < size else (p - size,) for p in lattice.piece[arcs])

    return [([(names(a), float(lp.sum()), v) for a, lp, v in row[:-1]], row[-1])
            for row in search.draws(k, **options)]


def test_draws_against_all_segmentations(pieces):
    content, n = "ab th\n▁", 6000
    known = all_segmentations(content, pieces)
    counts, weighted = [Counter(), Counter()], Counter()
    for draws, beyond in draws_of([content] * n, pieces, 2):
        assert len({d[0] for d in draws}) == 2
        values = [d[2] for d in draws] + [beyond]
        assert values == sorted(values, reverse=True)
        for i, (path, log, _) in enumerate(draws):
            assert log == pytest.approx(known[path], abs=1e-9)
            counts[i][path] += 1
            weighted[path] += 1 / -math.expm1(-math.exp(log - beyond))
    p = {k: math.exp(v) for k, v in known.items()}
    for path in sorted(p, key=p.get)[-5:]:
        second = sum(p[o] * p[path] / (1 - p[o]) for o in p if o != path)
        assert counts[0][path] / n == pytest.approx(p[path], abs=0.03)
        assert counts[1][path] / n == pytest.approx(second, abs=0.03)
        assert weighted[path] / n == pytest.approx(1, abs=0.15)


def test_draws_do_not_depend_on_depth_or_neighbours(pieces):
    texts = ["the quick brown fox " * 40, "x", "", "ab cd"]
    deep = draws_of(texts, pieces, 3)
    near = draws_of(texts, pieces, 3, near=2, deepest=-0.5)
    assert [[d[0] for d in row] for row, _ in deep] == [[d[0] for d in row] for row, _ in near]
    assert deep[2] == ([((), 0.0, pytest.approx(deep[2][0][0][2]))], -math.inf)
    assert len(deep[1][0]) == len(all_segmentations("x", pieces)) == 2
    alone = draws_of(texts[:1], pieces, 3)
    assert [d[0] for d in alone[0][0]] == [d[0] for d in deep[0][0]]


def test_segmentations_of_odd_rows(odd, nothing, pieces):
    rows = segmentation.sample_segmentations(odd, pieces, 2).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ODD}
    assert all(r["round_trip"] for r in rows if r["ids"] is not None)
    assert [(r["draw"], r["ids"]) for r in rows if r["doc_id"] == 2] == [(1, None)]
    assert [(r["draw"], r["ids"], r["log_inclusion"]) for r in rows if r["doc_id"] == 3] == [
        (1, [], 0.0)]
    assert segmentation.sample_segmentations(nothing, pieces).collect() == []
    spark = odd.sparkSession
    back = segmentation.decode(spark.createDataFrame(
        [(r["doc_id"], r["ids"]) for r in rows], "doc_id long, ids array<int>"), pieces).collect()
    texts = {r[0]: r[1] for r in ODD}
    assert all(r["text"] == texts[r["doc_id"]] for r in back)


def test_fingerprints(spark, odd, nothing):
    texts = ["One two. Three four!\nFive six", "Five six\nOne two.  Three four!", "", None, " \n",
             "One two.", "a b c d e f g h i j k"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    assert prints[0] == prints[1] and prints[2] == prints[3] == prints[4] != prints[5]
    assert fingerprint.changed(prints[5], ["Five six", "Three four!"]) == prints[0]
    assert fingerprint.changed(prints[0], deleted=["Five six", "Three four!"]) == prints[5]
    zero = base64.b64encode(bytes(512)).decode()
    assert prints[2] == zero and fingerprint.changed(prints[6], deleted=[texts[6]]) == zero
    assert fingerprint.fingerprints(odd).count() == len(ODD)
    assert fingerprint.compare_with_edits(odd).count() == len(ODD)
    assert fingerprint.compare_with_edits(nothing).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_edits_use_the_next_row(spark, parts):
    rng = random.Random(parts)
    texts = {i * i - 50: None if i == 3 else "é" * (i % 3) + "".join(
        rng.choices("ab. \n", k=rng.randrange(60))) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = fingerprint.compare_with_edits(docs, parts=parts).collect()
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    assert len(rows) == len(texts)
    for r in rows:
        own, other = texts[r["doc_id"]] or "", texts[after[r["doc_id"]]] or ""
        half = len(own) // 2
        changed = own[:len(own) - half] + other[:half]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = fingerprint.vectors_of(pa.array([own, changed, other], pa.string()))
        assert r["near_edited"] == pytest.approx(fingerprint.likeness(a[None], b[None])[0])
        assert r["near_next"] == pytest.approx(fingerprint.likeness(a[None], c[None])[0])


def probability_jaccard(a, b):
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b})
               for d in a if d in b)


def test_registers_estimate_the_probability_jaccard():
    a = {i: 1.0 + i % 5 for i in range(1, 60)}
    b = {i: 1.0 + i % 4 for i in range(15, 80)}
    row = np.repeat([0, 1], [len(a), len(b)])
    run = text.mix(np.array([*a, *b], np.uint64))
    m = 4096
    signs = near_dups.registers(row, run, np.array([*a.values(), *b.values()]), 2, m)
    assert (signs != 0).all()
    assert (signs[0] == signs[1]).mean() == pytest.approx(probability_jaccard(a, b), abs=0.03)


def test_repeated_lines_hide_no_candidates():
    rng = random.Random(11)
    pairs, found = 60, 0
    for i in range(pairs):
        base = [f"p{i}w{rng.randrange(10 ** 6)}" for _ in range(200)]
        line = [f"p{i}l{j}" for j in range(40)]
        data, offsets = text.buffers(pa.array([" ".join(base), " ".join(base + line * 40), ""]))
        row, run, count, _ = near_dups.runs_of(data, offsets, 5)
        a, b = set(run[row == 0]), set(run[row == 1])
        assert len(a & b) >= 0.8 * len(a | b) and count.max() >= 39
        keys, ends = near_dups.keys_of(row, run, count, 3, 24, 6)
        a, b, none = (keys[x:y].tolist() for x, y in zip(ends, ends[1:], strict=False))
        assert len(a) == len({*a}) == 24 and 24 < len(b) == len({*b}) <= 48 and none == []
        found += bool({*a} & {*b})
    assert found >= pairs - 1


def test_near_duplicates_with_repeated_lines(spark):
    rng = random.Random(12)
    texts = {}
    for i in range(12):
        base = [f"p{i}w{rng.randrange(10 ** 6)}" for _ in range(200)]
        texts[2 * i] = " ".join(base)
        texts[2 * i + 1] = " ".join(base + [f"p{i}l{j}" for j in range(40)] * 40)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_dups.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == brute_classes(texts)


def brute_classes(texts, least=0.8):
    def runs(content):
        words = (content or "").lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root = {i: runs(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            a, b = sets[i], sets[j]
            if i < j and (a == b or len(a & b) >= least * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicates_against_brute_force(spark, odd, nothing):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for family in range(6):
        base = rng.choices(words, k=rng.choice((30, 80, 200)))
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(len(base) // 12 + 1)):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice(([], [rng.choice(words)], copy[at:at + 2]))
            texts[n] = " ".join(copy)
            n += 1
    for content in ("", None, "one two", "One  two", "one two three"):
        texts[n] = content
        n += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_dups.near_duplicates(docs).collect()
    want, sizes = brute_classes(texts), Counter(brute_classes(texts).values())
    assert {r["doc_id"]: r["class_id"] for r in rows} == want
    assert all(r["class_size"] == sizes[r["class_id"]] for r in rows)
    assert {r["doc_id"] for r in rows if r["kept"]} == set(want.values())
    found = near_dups.near_duplicates(odd).collect()
    assert len(found) == len(ODD) and sum(r["kept"] for r in found) == 4
    assert near_dups.drop_near_duplicates(odd).columns == odd.columns
    assert near_dups.near_duplicates(nothing).collect() == []


def test_one_row_of_each_near_class_stays(spark, odd):
    rows = near_dups.drop_near_duplicates(odd).select("doc_id", "text").collect()
    texts = {r[0]: r[1] for r in ODD if r[0]}
    assert sorted(map(tuple, rows)) == [(i, texts[i]) for i in (1, 2, 5, 6)]
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(3, words[0]), (3, words[0]), (None, words[0] + " x"), (None, words[1]),
            (None, words[2]), (None, words[2].upper()), (8, words[3]), (8, words[4] + " y"),
            (4, words[4]), (9, words[5]), (9, words[5].replace(" ", "  "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dups.drop_near_duplicates(docs).collect()
    found = Counter((r["doc_id"], " ".join(r["text"].lower().split())) for r in kept)
    assert found == Counter([(3, words[0]), (None, words[1]), (None, words[2]), (8, words[3]),
                             (4, words[4]), (9, words[5])])


def test_ties_of_near_copies_are_settled_by_all_columns(spark):
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(1, body, source) for source in ("b", "a", None, "c")] + [(2, body + " x", "a")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        kept = near_dups.drop_near_duplicates(docs.repartition(3)).collect()
        assert list(map(tuple, kept)) == [(1, body, "a")]


def test_leftover_pairs_lose_no_link(spark):
    rng = random.Random(8)
    base = list(range(1, 61))
    sets = {i: sorted({*rng.sample(base, 52), *[100 + rng.randrange(30) for _ in range(4)]})
            for i in range(60)}
    sketch = {i: near_dups.odd_sketch(np.zeros(len(s), np.int64), np.array(s, np.uint64), 1)
              for i, s in sets.items()}
    nodes = spark.createDataFrame(
        [(bytes([i]), bytes([i]), s, sketch[i].tolist()) for i, s in sets.items()],
        "node binary, root binary, runs array<bigint>, odd array<bigint>")
    found = {(r["a"][0], r["b"][0]) for r in near_dups.sharing_rare_runs(nodes, 0.8).collect()}
    alike = {(i, j) for i in sets for j in sets if i < j and len({*sets[i]} & {*sets[j]})
             >= 0.8 * len({*sets[i]} | {*sets[j]})}
    assert alike and alike <= found


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(100, 130)] + [(7, 3), (3, 9), (5, 5)]
    pairs = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in links],
                                  "a binary, b binary")
    roots = {r["node"][0]: r["root"][0] for r in near_dups.components(pairs).collect()}
    assert roots == {**{i: 100 for i in range(101, 131)}, 7: 3, 9: 3}


def test_paragraphs_repeated_tens_of_thousands_of_times():
    """Counts that are equal modulo powers of two are told apart."""
    texts = ["a.\n" * 32768, "b.\n" * 32768, "a.\n" * 65536, "", "a.\n" * (32768 + 65536)]
    prints = fingerprint.shown(fingerprint.vectors_of(pa.array(texts)))
    assert len(set(prints)) == len(texts)
    assert fingerprint.changed(prints[2], ["a."] * 32768) == prints[4]
    assert fingerprint.changed(prints[2], deleted=["a."] * 65536) == prints[3]
    vectors = fingerprint.read(prints)
    assert fingerprint.likeness(vectors[:1], vectors[2:3])[0] == pytest.approx(1)
    assert fingerprint.likeness(vectors[:1], vectors[1:2])[0] < 0.3


def test_toxicity_on_held_out_texts(spark, odd, nothing):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(200)], k=30)
                         + (["scum"] if i % 4 == 0 else [])), "en", int(i % 4 == 0))
            for i in range(400)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    network = toxicity.train(docs, labels)
    held = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, network).collect()}
    import zlib

    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((held[r[0]] >= 0.5) == r[3] for r in test) >= 0.95 * len(test)
    scored = toxicity.score(odd, network)
    assert scored.columns == [*[c for c in odd.columns if c != "toxicity"], "toxicity"]
    assert all(0 <= r["toxicity"] <= 1 for r in scored.collect())
    assert toxicity.score(nothing, network).collect() == []
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    flat = toxicity.train(docs, labels.filter("false"))
    assert {r["toxicity"] for r in toxicity.score(odd, flat).collect()} == {0.5}


def test_all_labelled_texts_are_learned(spark, monkeypatch):
    """Also more than 2,000 of a label, and one of more than 100,000 bytes."""
    docs = spark.range(4400).selectExpr(
        "id as doc_id", "if(id = 7, repeat('long ', 30000), concat('w', id % 9)) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    seen = []

    def rows_of(texts):
        seen.append(tuple(texts.selectExpr("count(*)", "max(octet_length(words))").first()))

    monkeypatch.setattr(toxicity, "learned", lambda texts, _: rows_of(texts) or toxicity.Trainer())
    monkeypatch.setattr(toxicity, "thresholds_of", lambda texts, _: rows_of(texts) or {})
    toxicity.train(docs, labels, learn=F.lit(True))
    assert sum(n for n, _ in seen) == 4400 and max(size for _, size in seen) == 60_000


def test_sample_of_either_label(spark):
    docs = spark.range(4400).selectExpr("id as doc_id", "concat('w', id) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    rows, prior = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", F.lit(True),
                                           toxicity.SAMPLE_OF_LABEL, toxicity.LONGEST_SAMPLE)
    assert Counter(r["label"] for r in rows) == {0: 2000, 1: 2000} and prior == 0.5


def test_whole_texts_are_scored():
    network = toxicity.constant(0.5)
    network.tables[0][0][:] = -1
    network.out[0] = 9
    data, offsets = text.buffers(pa.array(["word " * 50_000 + "last"]))
    words, _, _ = toxicity.word_ids(data, offsets)
    network.tables[0][0][words[-1]] = 5
    assert network.scores(pa.array(["word", "word " * 50_000 + "last"])).round(3).tolist() == [
        0.5, 1.0]


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(3)
    x, pairs = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    field, row = quality.Field(np.array([1.0, -0.5]), pairs), np.repeat([0, 1, 2], [5, 1, 3])
    single, double = field.marginals(x, row)
    energy = x @ field.weights
    for r in range(3):
        at = np.flatnonzero(row == r)
        labels = [[(n >> i) & 1 for i in range(len(at))] for n in range(2 ** len(at))]
        weight = np.array([math.exp(sum(energy[i] * y for i, y in zip(at, ys, strict=True)) + sum(
            pairs[a, b] for a, b in zip(ys, ys[1:], strict=False))) for ys in labels])
        weight /= weight.sum()
        for n, i in enumerate(at):
            good = sum(w for w, ys in zip(weight, labels, strict=True) if ys[n])
            assert single[i, 1] == pytest.approx(good)
            if n:
                both = sum(w for w, ys in zip(weight, labels, strict=True) if ys[n - 1] and ys[n])
                assert double[i, 1, 1] == pytest.approx(both)


def test_quality_on_held_out_texts(spark, odd, nothing):
    rng = random.Random(2)
    words = ["the", "house", "stands", "by", "a", "river", "and", "we", "like", "it"]
    rows = []
    for i in range(300):
        lines = [" ".join(rng.choices(words, k=12)) + "." for _ in range(6)]
        if i % 3 == 0:
            lines[1:] = [" | ".join(rng.choices(words, k=8)) for _ in range(5)]
        rows.append((i, "\n".join(lines), int(i % 3 != 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    field = quality.train(docs, labels)
    scores = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, field).collect()}
    import zlib

    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum((scores[r[0]] >= 0.5) == r[2] for r in test) >= 0.95 * len(test)
    lines = quality.line_marginals(docs.filter("doc_id = 3"), field).collect()
    assert [r["line"] for r in lines] == list(range(6))
    assert all(0 <= r["quality_score"] <= 1 for r in quality.score(odd, field).collect())
    assert quality.score(nothing, field).collect() == []
    assert quality.train(docs, labels.filter("false")).curve[0] == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_archives_round_trip(spark, version):
    ship_package(spark)
    pages = [(5, "http://a b/\n", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None),
             (None, "u", "<p>é</p>"), (7, "u", "x\r\n\r\nWARC/1.1\r\n"), (7, "u", ""),
             (8, "u", "y" * 300_000), (8, "u", "y" * 300_000), (7, "v", "aaa"),
             (7, "v", "bbb"), (7, "v", "aaa"), (12, "v", "aaa"), (None, "w", "n"),
             (None, "w", "n")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr(
        "*", "1 as path", "2 as content", "3 as value")
    legacy, archives = new_path(spark, "arc"), new_path(spark, "warc")
    warc.write_arc(rows, legacy, version, limit=1000)
    warc.arc_to_warc(spark, legacy, archives, limit=2000)
    found = warc.read_warc(spark, archives).collect()
    want, responses = Counter(), Counter()
    smallest = {}
    for page, _, html in pages:
        if page is not None:
            smallest[html or ""] = min(page, smallest.get(html or "", page))
    for page, _, html in pages:
        html = html or ""
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        kind = "response"
        if html in smallest and (page != smallest[html] or responses[html]):
            kind = "revisit"
        elif html in smallest:
            responses[html] = 1
        want[str(page) if page else None, len(html.encode()), digest, kind] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["type"])
                   for r in found) == want
    assert all(r["date"] == "2024-01-01T00:00:00Z" for r in found)
    by_id = {r["record_id"]: r for r in found}
    assert len(by_id) == len(found)
    revisits = [r for r in found if r["type"] == "revisit"]
    assert len(revisits) == 6 and all(r["refers_to"] is None for r in found
                                      if r["type"] != "revisit")
    for r in revisits:
        other = by_id[r["refers_to"]]
        assert other["type"] == "response"
        assert other["payload_digest"] == r["payload_digest"]


def test_query_of_archives_is_its_sql_with_repeated_and_missing_ids(spark, tmp_path):
    ship_package(spark)
    rows = [(4, "a", "x"), (4, "a", "x"), (4, "b", "y"), (2, "c", "y"), (None, "d", "y"),
            (None, "d", "z"), (None, "d", "z"), (6, "e", None), (5, "e", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(
        f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert difference(queries.op10_arc_to_warc(spark, str(tmp_path)), con,
                      queries.statements()["op10_arc_to_warc"]) is None


def test_arc_formats():
    body = b"not http \xff\n"
    data = (warc.arc_head("x.arc", "1") + b"\ndns:x 1.2.3.4 20200102030405 text/dns %d\n"
            % len(body) + body + warc.arc_head("y.arc", "2")
            + warc.arc_record("u", b"page", 1, "2"))
    one, two = warc.arc_records(data)
    assert (one.url, one.ip, one.payload, one.head) == ("dns:x", "1.2.3.4", body, b"")
    assert two.payload == b"page"
    assert b"WARC-Type: resource" in warc.as_warc(one, "p", None)
    assert warc.stamp("20200102") == "2020-01-02T00:00:00Z"
    for broken in (b"x 1\n", data[:-2], data.replace(b"1 0 store", b"7 0 store")):
        with pytest.raises(warc.ArchiveError):
            list(warc.arc_records(broken))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(120):
        body = rng.choices(words, k=60)
        rows.append((i, " ".join(body + ["scum"] * (i % 4 == 0)), "en", f"s{i % 3}", 0))
    rows += [(200, rows[1][1].upper(), "en", "s0", 0),
             (201, rows[2][1] + " more", "en", "s1", 0), (202, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int"
                          ).write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in found}
    assert not ids & {i for i in range(0, 120, 4)}
    assert 1 not in ids and 201 not in ids and len(ids) > 60
    assert all(r["round_trip"] for r in found if r["ids"] is not None)
