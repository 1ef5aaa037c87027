"""Sharding, mixing, exact duplicates and personal data."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest

from storelake.llm import block_naming, mixing, pii, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a b c", "en", "s1", 5), (2, None, None, None, None), (3, "", "en", "s1", 0),
       (None, "a b c", "en", "s2", 5), (1, "a b c", "en", "s1", 5), (4, "A B C", "de", "s2", 5),
       (5, "é 😀 " * 3000, "fr", "s3", 12000), (6, "É 😀 " * 3000, "fr", "s3", 12000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns of the operators' own names."""
    docs = spark.createDataFrame(ODD, DOCS)
    return docs.selectExpr("*", "1 as size", "'x' as shard", "2 as row", "3 as key", "4 as name",
                           "5 as bucket", "6 as position", "'y' as kind", "7 as kept")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("false")


def smallest_capacity(sizes, shards):
    """Brute force: the least capacity over all ways to cut."""
    best = None
    for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        edges = (0, *cuts, len(sizes))
        most = max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:], strict=False))
        best = most if best is None else min(best, most)
    return best


def test_shards_are_minimax(spark):
    texts = ["w" * n for n in (5, 90, 3, 44, 60, 7, 200, 12, 30, 30, 8)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_by_bytes(docs, 4, salts=3).collect()
    groups, keys = defaultdict(int), {}
    from pyspark.sql import functions as F

    for r in docs.select("text", F.lower(F.lpad(F.hex(F.xxhash64("text")), 16, "0")).alias("k")
                         ).collect():
        groups[r["k"]] += len(r["text"]) + 8
        keys[r["text"]] = r["k"]
    sizes = [groups[k] for k in sorted(groups)]
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == smallest_capacity(sizes, 4)
    for shard in load:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["doc_id"]: r["text_crc32"] for r in rows} == {
        i: zlib.crc32(t.encode()) for i, t in enumerate(texts)}
    home = defaultdict(set)
    for r in rows:
        home[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())


def test_capacity_search_refines_blocks():
    """Blocks of several groups are split until both bounds agree."""
    import random

    rng = random.Random(4)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    true = sharding.Blocks([(f"{i:04x}", 1, s) for i, s in enumerate(sizes)])
    coarse = sharding.Blocks([(f"{i:04x}"[:3], 16, sum(sizes[16 * i:16 * i + 16]))
                              for i in range(19)])
    exact = true.smallest(7, False)
    assert coarse.smallest(7, True) <= exact <= coarse.smallest(7, False)


def test_shards_of_odd_rows(odd, nothing):
    rows = sharding.shard_by_bytes(odd, 24).collect()
    assert len(rows) == len(ODD)
    assert sharding.shard_by_bytes(nothing, 24).collect() == []
    assert Counter(r["size"] for r in rows)[8] == 2


def test_targets_are_shared_anew(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 0)],
                                  "source string, source_size long")
    rows = {r["source"]: r for r in mixing.source_targets(sizes).collect()}
    total, weights = 1510, {"a": 1, "b": 2, "c": 3, None: 1}
    assert {k: r["weight"] for k, r in rows.items()} == weights
    target, open_ones, left = {}, set(rows), float(total)
    while True:
        share = left / sum(weights[k] for k in open_ones)
        full = {k for k in open_ones if 3 * rows[k]["source_size"] < share * weights[k]}
        if not full:
            break
        for k in full:
            target[k] = 3 * rows[k]["source_size"]
            left -= target[k]
        open_ones -= full
    target |= {k: share * weights[k] for k in open_ones}
    assert {k: pytest.approx(r["target"]) for k, r in rows.items()} == target


def test_mix_takes_its_targets(spark):
    rows = [(i, "w " * (1 + i % 17), f"s{i % 5 if i % 3 else 0}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs, buckets=4).collect()
    taken, target = Counter(), {}
    for r in mixed:
        assert r["size"] == len(rows[r["doc_id"]][1].split())
        assert r["taken"] <= 3 * r["size"] and r["taken"] == len(r["positions"]) * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 17 / 2 for s in target)
    again = mixing.mix_sources(docs.repartition(5), buckets=4).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))
    order = mixing.training_order(docs, buckets=4)
    assert order.columns == docs.columns
    assert Counter(r["doc_id"] for r in order.collect()) == Counter(
        {r["doc_id"]: len(r["positions"]) for r in mixed if r["positions"]})


def test_time_inverts_the_integral(spark):
    shares = (0.5, 2.0, 1.0)
    from pyspark.sql import functions as F

    times = spark.range(0, 101).select((F.col("id") / 100).alias("q")).select(
        "q", mixing.time_of(F.col("q"), F.array(*map(F.lit, shares)), 3).alias("t")).collect()

    def asked(t):
        steps, total = 20_000, 0.0
        for i in range(int(t * steps)):
            x = (i + 0.5) / steps * 2
            j = min(int(x), 1)
            total += (shares[j] + (shares[j + 1] - shares[j]) * (x - j)) / steps
        return total / 1.375

    assert all(asked(r["t"]) == pytest.approx(r["q"], abs=2e-4) for r in times[::10])


def test_mix_of_odd_rows(odd, nothing):
    assert mixing.mix_sources(odd).count() == len(ODD)
    assert mixing.mix_sources(nothing).collect() == []
    assert mixing.training_order(odd).columns == odd.columns
    assert mixing.training_order(nothing).collect() == []


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_duplicates(spark, odd, nothing, bits):
    texts = ["", "abc", "ABC", "abd", "x" * 1000, "x" * 1000 + "y", "X" * 1000, "é", "É", None,
             "ab" * 500, "ba" * 500] + [f"{i % 7}" * (i % 50) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = block_naming.exact_duplicates(docs, block_bytes=16, buckets=5, bits=bits).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(lower)].append(i)
    assert len(rows) == len(texts)
    for r in rows:
        text = (texts[r["doc_id"]] or "").translate(lower)
        ids = groups[text]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (
            max(ids), len(ids), r["doc_id"] == max(ids), hashlib.sha256(text.encode()).hexdigest())
    found = block_naming.exact_duplicates(odd, bits=bits).collect()
    assert sum(r["kept"] for r in found) == 4 and len(found) == len(ODD)
    assert block_naming.exact_duplicates(nothing, bits=bits).collect() == []


def test_exact_duplicates_dropped(odd, nothing):
    rows = block_naming.drop_exact_duplicates(odd)
    assert rows.columns == odd.columns
    assert sorted(r["doc_id"] for r in rows.collect()) == [3, 4, 5, 6]
    assert block_naming.drop_exact_duplicates(nothing).collect() == []


def test_capitals_besides_a_to_z_stay(spark):
    """Every character: only A to Z change, alone and between others."""
    from pyspark.sql import functions as F

    points = [p for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000]
    texts = [("".join(map(chr, points[i:i + 500])),) for i in range(0, len(points), 500)]
    texts += [("AbΣ ΟΔΟΣ İI ẞß Ǆǅǆ ÉcoleÉ Ab",), ("É",), ("AÉ",), ("ÉA",), ("ΣΣ A",)]
    docs = spark.createDataFrame(texts, "text string").repartition(4)
    rows = docs.select("text", block_naming.normalised(F.col("text")).alias("got")).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert len(rows) == len(texts)
    assert all(r["got"] == r["text"].translate(lower) for r in rows)


@pytest.mark.parametrize("end", ["", "É"])
def test_naming_is_linear_in_the_text(spark, end):
    """Texts of 32 MB and copies but for case; a second 4 MB more would show a square."""
    import time

    long = "Some words, and more of them. " * (32 * 1024 * 1024 // 30)
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", f"repeat('{'Some words, and more of them. '}', "
                           f"{len(long) // 30}) || if(doc_id = 3, 'other', '{end}') as text")
    start = time.time()
    rows = {r["doc_id"]: r for r in block_naming.exact_duplicates(docs).collect()}
    assert time.time() - start < 90
    assert (rows[1]["keep_id"], rows[2]["keep_id"], rows[3]["keep_id"]) == (2, 2, 3)
    want = hashlib.sha256((long.lower() + end).encode()).hexdigest()
    assert rows[1]["text_sha256"] == want == rows[2]["text_sha256"]


def test_kept_rows_of_one_id_do_not_change_from_run_to_run(spark):
    rows = [(1, "a", "en", s) for s in "dcba"] + [(1, "A", "de", "z"), (0, "a", "en", "q"),
                                                  (None, "n", "en", "1"), (None, "n", "en", "0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = set()
    for parts in (1, 3, 8):
        kept = block_naming.drop_exact_duplicates(docs.repartition(parts)).collect()
        found.add(tuple(sorted(map(tuple, kept), key=repr)))
    assert len(found) == 1 and len(next(iter(found))) == 2


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(digits):
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4)
                   for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0

    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits),
                    "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark, nothing):
    texts = ["4111 1111 1111 1111 1.2.3.4.5 a@b.c.d@e.f +1 22 (33) 44455 256.1.1.1 a..b@c.d", None,
             "", "é😀 joe@x.org, +49 30 1234567 001.002.003.255 0001.1.1.1", "a@b@c.d.e%x@f.g",
             "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "+1-- 1234567890123456789012", "1" * 50_000,
             "1 " * 20_000 + "a." * 20_000 + "@" + "b." * 20_000 + "c", "7" * 16 + "@" + "+" * 99,
             "4572244787104698,4572-2447-8710-4698 45722447871046981", "x@y.z " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), r
        assert set(spans) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in PATTERNS] == [
            sum(s.startswith(k) for s in spans) for k in PATTERNS]
    assert pii.personal_data(nothing).collect() == []


def test_many_matches_in_one_text(spark):
    """100,000 addresses in one text, in seconds."""
    import time

    text = " ".join(f"a{i}@b{i % 7}.org" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    (row,) = pii.personal_data(docs).collect()
    assert time.time() - start < 120
    spans = base_spans(text)
    assert row["n_email"] == 100_000 == len(spans)
    assert row["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_loose_spans_are_added(spark):
    good = [(i, f"call me: (212) 555-{1000 + i} or mail joe{i} (at) site{i}.com, tel +1 (988) 555-"
             f"{2000 + i} mail a{i}@b.org") for i in range(40)]
    bad = [(100 + i, f"part id 212-555-{1000 + i}x") for i in range(5)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert all(len(rows[i]["spans"].split(",")) == 4 for i, _ in good)
    assert all(rows[i]["n_phone"] == rows[i]["n_email"] == 1 for i, _ in good)


def test_repeated_rows_and_null_ids_keep_their_spans(odd):
    assert pii.personal_data(odd).count() == len(ODD)


def test_rows_cleared_by_the_sketch_are_not_shuffled(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('text ', id % 290) as text")
    met = []
    kept = block_naming.written

    def spy(df, label="table"):
        out = kept(df, label)
        if label == "rows-met":
            met.append(out.count())
        return out

    monkeypatch.setattr(block_naming, "written", spy)
    left = block_naming.drop_exact_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in left) == list(range(10, 300))
    assert 10 <= met[0] < 60


def test_mix_deals_whole_rows_once_before_it_sorts(spark):
    docs = spark.range(20).selectExpr("id as doc_id", "'a b' as text", "'s' as source")
    plan = mixing.training_order(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(coalesce(source" not in plan
    assert mixing.training_order(docs).count() == 20
