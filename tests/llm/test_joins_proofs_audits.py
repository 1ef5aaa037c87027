"""The similarity join, the Merkle manifest and the filter audit against plain loops."""

import itertools
import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelake.llm import filter_audit, manifest, metric_join

# --- similarity join ------------------------------------------------------------


def vectors_of(seed=3, n=240, dim=6):
    """Clusters of several widths, copies, scaled copies and noise in three labels."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            v = rng.normal(size=dim)
        elif kind == 1:  # a third of the rows in one tight cluster, some equal
            v = centres[0] + 0.02 * rng.integers(0, 3) * np.ones(dim)
        else:
            v = centres[rng.integers(5)] + 0.25 * rng.normal(size=dim)
        rows.append((i, [float(x) for x in v * rng.choice([1.0, 0.5, 1e-200, 1e200])],
                     int(rng.integers(3)) if kind != 1 else 0))
    return rows


def joined_plainly(rows, similarity):
    good = []
    for vec_id, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = np.array(v, float)
        if len(x) and np.abs(x).max() > 0:
            x = x / np.abs(x).max()
            good.append((len(good), vec_id, x / np.linalg.norm(x), label))
    links = defaultdict(list)
    for (i, _, x, a), (j, _, y, b) in itertools.combinations(good, 2):
        if a == b and len(x) == len(y) and x @ y >= similarity:
            links[i].append(j)
            links[j].append(i)
    seen, out = {}, []
    for i, *_ in good:
        if i in seen:
            continue
        reach, queue = {i}, [i]
        while queue:
            for j in links[queue.pop()]:
                if j not in reach:
                    reach.add(j)
                    queue.append(j)
        ids = [good[j][1] for j in reach if good[j][1] is not None]
        for j in reach:
            seen[j] = min(ids, default=None)
    for i, vec_id, *_ in good:
        out.append((vec_id, len(links[i]), seen[i], vec_id == seen[i]))
    usable = [(g[1], g[2].tobytes()) for g in good]
    rest = len(rows) - len(usable)
    return out, rest


SCHEMA = "vec_id long, embedding array<double>, label int"


def by_text(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("options", [
    {}, {"root_share": 0.7}, {"root_share": 1.0, "block_bytes": 480}, {"most_pivots": 5,
                                                                     "root_share": 0.5}])
@pytest.mark.parametrize("similarity", [0.93, 0.6])
def test_join_equals_all_pairs(spark, options, similarity):
    rows = vectors_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, _ = joined_plainly(rows, similarity)
    got = metric_join.link_similar(df, similarity, **options)
    assert by_text(got.collect()) == by_text(want)
    assert sum(n for _, n, *_ in want) > 1000


def test_join_of_odd_rows(spark):
    x, y = [1.0, 2.0], [2.0, 4.000001]
    odd = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0),
           (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (7, x, None), (7, x, None)]
    good = [(10, x, 0), (10, x, 0), (11, y, 0), (12, x, 1), (13, [1.0, 2.0, 0.0], 0),
            (None, x, 0), (None, [-1.0, 5.0], 2), (14, [-1.0, -2.0], 0), (9, [3.0, 6.0], 0)]
    df = spark.createDataFrame(odd + good, SCHEMA).withColumns(
        {"unit": F.lit("clash"), "node": F.lit(1), "cell": F.lit(None)})
    got = by_text(metric_join.link_similar(df).collect())
    want, rest = joined_plainly(good, 0.93)
    alone = [(i, 0, i, True) for i, *_ in odd]
    want = [(i, n, c, i == c) for i, n, c, _ in want]
    assert got == by_text(want + alone) and rest == 0
    none = df.limit(0)
    assert metric_join.link_similar(none).collect() == []


def test_join_of_one_label_in_many_blocks(spark):
    """A third of all rows are near each other: every pair counts, none is written."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in np.r_[1, 0.01 * rng.normal(size=3)]], 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = metric_join.link_similar(df, root_share=4, block_bytes=32 * 50).collect()
    assert {tuple(r)[1:3] for r in got} == {(299, 0)}


# --- manifest -------------------------------------------------------------------


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree_of(leaves):
    """All levels of a tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest(*low[i:i + 8]) for i in range(0, len(low), 8)])
    return levels


def siblings_of(levels, place):
    out = []
    for level in levels[:-1]:
        first = place // 8 * 8
        run = level[first:first + 8]
        out.append((run[:place - first], run[place - first + 1:]))
        place //= 8
    return out


def proved_plainly(rows, tampered):
    """rows: doc_id, source, lang, n_chars, text."""
    by_lang = defaultdict(list)
    for row in rows:
        changed = tampered(row)
        by_lang[row[2]].append((row[0], digest(*map(coded, row)), digest(*map(coded, changed))))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        trees[lang] = tree_of([r[1] for r in by_lang[lang]])
    top = tree_of([trees[lang][-1][0] for lang in langs])
    out = []
    for number, lang in enumerate(langs):
        for place, (doc_id, leaf, shown) in enumerate(by_lang[lang]):
            steps = siblings_of(trees[lang], place) + siblings_of(top, number)
            folded = shown
            for before, after in steps:
                folded = digest(*before, folded, *after)
            proof = digest(*(s for b, a in steps for s in (*b, *a)))
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0], proof, folded,
                        folded == top[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def documents_of(n, langs, seed=5):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["s", None, "été"]), rng.choice(langs), rng.choice([None, i]),
             rng.choice(["Abc", "", None, "xyz", "É" * 5 + "A"])) for i in range(n)]
    return rows + rows[:5] + [(None, "s", langs[0], 1, "Q"), (None, "s", langs[0], 1, "R")]


def lowered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 3 or row[4] is None:
        return row
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))


@pytest.mark.parametrize("langs, n", [(["en"] * 8 + ["de", None, "É", ""], 700), (["en"], 513),
                                      (list(map(str, range(30))), 90), (["x"], 1)])
@pytest.mark.parametrize("levels", [1, 4])
def test_manifest_equals_plain_tree(spark, langs, n, levels):
    rows = documents_of(n, langs)
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns(
        {"tree": F.lit("clash"), "pos": F.lit(0), "leaf": F.lit(None)})
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = manifest.leaf_digest(text=F.when(touched, text).otherwise(F.col("text")))
    got = manifest.prove(df, shown, levels=levels).collect()
    assert by_text(got) == by_text(proved_plainly(rows, lowered))


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(4, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    (row,) = manifest.prove(df).collect()
    leaf = digest("1:4", "-", "-", "-", "-")
    assert tuple(row) == (4, leaf, leaf, leaf, digest(""), leaf, True)
    assert manifest.prove(df.limit(0)).collect() == []
    long = [(i, "s", "en", 1, "Ab" * 4_000_000 if i == 3 else "x") for i in range(9)]
    got = manifest.prove(spark.createDataFrame(long, DOCS)).collect()
    assert by_text(got) == by_text(proved_plainly(long, lambda row: row))


def test_missing_nodes_are_the_least_that_prove(spark):
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 700)
        own = sorted(rng.sample(range(n), rng.randint(1, min(n, 40))))
        levels = tree_of([digest(str(i)) for i in range(n)])
        wanted = manifest.missing(own, n)
        need = set()
        for p in own:
            for level in range(len(levels) - 1):
                at = p // 8 ** level
                need |= {(level, k) for k in range(at // 8 * 8, min(at // 8 * 8 + 8,
                                                                   len(levels[level]))) if k != at}
        derived = {(level, p // 8 ** level) for p in own for level in range(len(levels))}
        assert set(wanted) == need - derived and len(wanted) == len(set(wanted))
        assert manifest.height(n) == len(levels) - 1


# --- filter audit ---------------------------------------------------------------


def audited_plainly(docs, labels):
    """docs: doc_id, source, text. labels: doc_id, quality, toxic."""
    marks = {}
    for i, q, t in labels:
        if i is None:
            continue
        old = marks.get(i, (0, 0))
        marks[i] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    smallest = {}
    for i, _, text in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    failed, parts = [], set()
    for i, source, text in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
                 "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and smallest[text] < i}
        parts.add(source or "")
        failed.append((source or "", {f for f in fails if fails[f]}, *marks.get(i, (0, 0))))
    out, shapley = [], defaultdict(int)
    for part in parts:
        own = [r[1:] for r in failed if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                here = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                gone = [r for r in own if f in r[0] and r[0] & set(order[:k])]
                shapley[part, f] += len(here)
                out.append([part, "".join(order), k + 1, len(left), len(here), len(gone),
                            sum(r[0] == {f} for r in own), sum(r[1] for r in here),
                            sum(r[2] for r in here), f])
    return [(*r[:-1], shapley[r[0], r[-1]]) for r in out]


def audit_rows(seed=8):
    rng = random.Random(seed)
    pool = []
    for _ in range(25):
        kind = rng.randint(0, 5)
        words = [f"w{rng.randint(0, 30 if kind == 1 else 4000)}" for _ in range(
            rng.choice([0, 3, 49, 50, 51, 120]))]
        if kind == 2:
            words = [w.upper() for w in words]
        if kind == 3 and words:
            words[0] = rng.choice("#$%&*|") + words[0]
        pool.append(rng.choice([" ", "\n", " \t", "\x0b"]).join(words))
    pool += [None, "", " ", "É" * 70, " ".join(f"ü{i}" for i in range(60))]
    docs = [(i, rng.choice(["a", "b", None, ""]), rng.choice(pool)) for i in range(200)]
    docs += docs[:3] + [(None, "a", pool[0]), (None, "a", pool[0])]
    docs += [(1000 + i, "a", "the same text " * 30) for i in range(100)]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i in range(0, 300, 2)]
    return docs, labels + [(0, 1, 1), (None, 1, 1)]


@pytest.mark.parametrize("most_bits", [filter_audit.MOST_BITS, 64])
def test_audit_equals_replay(spark, most_bits):
    docs, labels = audit_rows()
    got = filter_audit.audit(
        spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(4)
        .withColumns({"part": F.lit("clash"), "mask": F.lit(1), "hash": F.lit(None)}),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        .withColumn("good", F.lit(7)), most_bits)
    assert by_text(got.collect()) == by_text(audited_plainly(docs, labels))


def test_audit_of_nothing_and_of_a_long_text(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    long = [(1, "a", "abc " * 2_000_000), (2, "a", "abc " * 2_000_000), (3, "a", None)]
    got = filter_audit.audit(spark.createDataFrame(long, docs.schema), labels).collect()
    assert by_text(got) == by_text(audited_plainly(long, []))


def test_sketch_clears_only_texts_met_once(spark):
    """Sketches of many tasks, added in several rounds, keep every repeat."""
    texts = [f"text {i}" for i in range(3000)] + [f"text {i}" for i in range(0, 3000, 50)]
    random.Random(1).shuffle(texts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(150)
    bits, functions = filter_audit.sketch_size(len(texts))
    maybe = filter_audit.possible_repeats(docs, bits, functions)
    left = [r[0] for r in docs.filter(maybe(filter_audit.text_hash())).collect()]
    assert {f"text {i}" for i in range(0, 3000, 50)} <= set(left)
    assert len(left) < 120 + 0.06 * 3000
