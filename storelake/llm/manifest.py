"""A Merkle tree over the rows of a dataset, and a proof for each row.

The rows of each language are the leaves of a tree, in the order of their ids; the roots
of these trees, in the order of the languages, are the leaves of one more tree. Nodes
are known by (tree, level, position); tree -1 is the one over the languages. Every
eight consecutive nodes have one parent.

Trees are built a block at a time: a block is the 8^4 consecutive nodes below one node
four levels up, so a pass over blocks makes four levels.

Proofs follow the octopus scheme. The leaves of a block ask for the union of the nodes
that their proofs need and that do not follow from the leaves themselves; this is a few
nodes for each level above the block. They are fetched once for the block by a join. Interiors that leaves
share are derived once, and each leaf's own proof is then put together from both.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.operators.ordered import dense_numbers
from storelake.session import written

ARITY = 8
#: Levels of a block.
LEVELS = 4
#: The tree over the roots of all languages.
TOP = -1

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, level int, pos long, digest string"
PROOF = ("doc_id {id}, leaf string, subroot string, root string, proof_sha256 string, "
         "folded_root string, verified boolean")


def digest_of(texts: Iterable[str]) -> str:
    return sha256("".join(texts).encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """A value with its length in bytes before it, or a dash for a null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                      F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def height(count: int) -> int:
    """Levels above the leaves of a tree of so many leaves."""
    levels = 0
    while count > 1:
        count, levels = -(-count // ARITY), levels + 1
    return levels


def count_at(count: int, level: int) -> int:
    """Nodes on a level of a tree of so many leaves."""
    for _ in range(level):
        count = -(-count // ARITY)
    return count


def missing(positions: Iterable[int], count: int) -> list[tuple[int, int]]:
    """The minimal union of (level, pos) that proofs of these leaves need besides them."""
    out, known = [], set(positions)
    for level in range(height(count)):
        end = count_at(count, level)
        runs = {p // ARITY for p in known}
        out += [(level, p) for r in sorted(runs)
                for p in range(r * ARITY, min(r * ARITY + ARITY, end)) if p not in known]
        known = runs
    return out


def parents(level: dict[int, str], count: int) -> dict[int, str]:
    """Of one level's nodes the parents whose children are all there (count: of the level)."""
    out = {}
    for r in {p // ARITY for p in level}:
        run = range(r * ARITY, min(r * ARITY + ARITY, count))
        if all(p in level for p in run):
            out[r] = digest_of(level[p] for p in run)
    return out


def block_levels(levels: int):
    """The nodes above one block of nodes of a level, as far as ``levels`` go."""
    def work(pdf):
        import pandas as pd

        tree, level, count = (int(pdf[c].iloc[0]) for c in ("tree", "level", "count"))
        nodes = dict(zip(pdf["pos"].tolist(), pdf["digest"], strict=True))
        top, out = height(count), []
        for up in range(level + 1, min(level + levels, top) + 1):
            nodes = parents(nodes, count_at(count, up - 1))
            out += [(tree, up, p, d) for p, d in sorted(nodes.items())]
        return pd.DataFrame(out, columns=["tree", "level", "pos", "digest"])

    return work


def build(leaves: DataFrame, counts: DataFrame, highest: int, levels: int = LEVELS) -> DataFrame:
    """All nodes of all trees, written. leaves: tree, pos, digest; counts: tree, count."""
    nodes = leaves.select("tree", F.lit(0).alias("level"), "pos", "digest")
    parts, edge, block = [nodes], nodes, ARITY ** levels
    for level in range(0, highest, levels):
        # Trees that end below have no node on the edge.
        edge = edge.filter(F.col("level") == level).join(counts, "tree")
        made = edge.groupBy("tree", F.floor(F.col("pos") / block).alias("block")).applyInPandas(
            block_levels(levels), NODE)
        edge = written(made, "merkle-nodes")
        parts.append(edge)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def block_needs(levels: int, langs: int):
    """What the proofs of one block of leaves have to fetch, and what they must come to."""
    def work(pdf):
        import pandas as pd

        tree, count, block = (int(pdf[c].iloc[0]) for c in ("tree", "count", "block"))
        wanted = [(tree, *c) for c in missing(pdf["pos"].tolist(), count)]
        wanted += [(TOP, *c) for c in missing([tree], langs)]
        wanted += [(tree, height(count), 0), (TOP, height(langs), 0)]
        out = pd.DataFrame(list(dict.fromkeys(wanted)), columns=["tree", "level", "pos"])
        return out.assign(of=tree, block=block)[["of", "block", "tree", "level", "pos"]]

    return work


class Prover:
    """The proofs of some leaves of a tree, from them and the nodes fetched for them."""

    def __init__(self, tree: int, count: int, langs: int, leaves: dict[int, str],
                 fetched: dict[tuple[int, int, int], str]) -> None:
        self.tree, self.nodes = tree, dict(fetched)
        self.shapes = [(tree, height(count), count), (TOP, height(langs), langs)]
        self.root = fetched[(TOP, height(langs), 0)]
        self.subroot = fetched[(tree, height(count), 0)]
        self.tails: dict[tuple[int, int, int], str] = {}
        self.folds: dict[tuple[int, int, int, str], str] = {}
        for p, d in leaves.items():
            self.nodes[(tree, 0, p)] = d
        # Interiors that the leaves share, each once.
        for at, top, size, own in ((tree, self.shapes[0][1], count, set(leaves)),
                                   (TOP, self.shapes[1][1], langs, {tree})):
            if at == TOP:
                self.nodes[(TOP, 0, tree)] = self.nodes[(tree, self.shapes[0][1], 0)]
            for level in range(top):
                own = {p // ARITY for p in own}
                for p in own:
                    self.nodes[(at, level + 1, p)] = digest_of(
                        self.nodes[(at, level, k)] for k in self.run(at, level, p * ARITY))

    def run(self, tree: int, level: int, pos: int) -> range:
        count = count_at(self.shapes[tree == TOP][2], level)
        first = pos // ARITY * ARITY
        return range(first, min(first + ARITY, count))

    def above(self, tree: int, level: int, pos: int) -> tuple[int, int, int] | None:
        """The node a node is folded into; the root of a language's tree is a leaf on top."""
        if level < self.shapes[tree == TOP][1]:
            return (tree, level + 1, pos // ARITY)
        return None if tree == TOP else (TOP, 0, self.tree)

    def siblings(self, tree: int, level: int, pos: int) -> tuple[str, str]:
        run = self.run(tree, level, pos)
        return ("".join(self.nodes[(tree, level, p)] for p in run if p < pos),
                "".join(self.nodes[(tree, level, p)] for p in run if p > pos))

    def proof(self, tree: int, level: int, pos: int) -> str:
        """All siblings from this node up to the root."""
        key = (tree, level, pos)
        if key not in self.tails:
            up = self.above(*key)
            own = ""
            if up and up[:2] == (tree, level + 1):
                own = "".join(self.siblings(*key))
            self.tails[key] = own + (self.proof(*up) if up else "")
        return self.tails[key]

    def fold(self, tree: int, level: int, pos: int, digest: str) -> str:
        """The root that follows from a digest in this place; equal ones are folded once."""
        key = (tree, level, pos, digest)
        if key not in self.folds:
            up = self.above(tree, level, pos)
            if up is None:
                return digest
            if up[:2] == (tree, level + 1):
                before, after = self.siblings(tree, level, pos)
                digest = digest_of((before, digest, after))
            self.folds[key] = self.fold(*up, digest)
        return self.folds[key]


def block_proofs(langs: int):
    """The proofs of one block, from its leaves (left) and the nodes fetched (right)."""
    def work(left, right):
        import pandas as pd

        if not len(left):
            return pd.DataFrame(columns=["doc_id", "leaf", "subroot", "root", "proof_sha256",
                                         "folded_root", "verified"])
        tree, count = int(left["tree"].iloc[0]), int(left["count"].iloc[0])
        fetched = {(int(t), int(v), int(p)): d for t, v, p, d in
                   right[["tree", "level", "pos", "digest"]].itertuples(index=False)}
        positions = left["pos"].tolist()
        prover = Prover(tree, count, langs, dict(zip(positions, left["leaf"])), fetched)
        out = pd.DataFrame({"doc_id": left["doc_id"], "leaf": left["leaf"]})
        out["subroot"], out["root"] = prover.subroot, prover.root
        # A leaf's own proof is not kept: only those of the interiors are shared.
        out["proof_sha256"] = [
            digest_of((*prover.siblings(tree, 0, p), prover.proof(*prover.above(tree, 0, p))))
            if count > 1 else digest_of((prover.proof(tree, 0, p),)) for p in positions]
        out["folded_root"] = [prover.fold(tree, 0, p, d)
                              for p, d in zip(positions, left["presented"])]
        out["verified"] = out["folded_root"] == prover.root
        return out

    return work


def prove(docs: DataFrame, presented: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf is the digest of a row's doc_id, source, lang, n_chars and text, other columns are
    not read. ``presented`` is the digest of the row as it is presented for checking (by
    default the leaf itself): folded_root is what it and the proof come to. Null ids
    come first in their language; equal ids are ordered by their leaf, and equal rows are
    leaves each. A null language is one of its own, before the others. A table of one
    row has its leaf for a root and an empty proof; an empty table gives an empty result.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # Written first: dealing rows into ranges reads them twice, and texts are read once.
    rows = written(docs.select("lang", "doc_id", leaf_digest().alias("leaf"), (
        leaf_digest() if presented is None else presented).alias("presented")), "leaf-rows")
    numbers, counts = dense_numbers(rows, ["lang"], ["doc_id", "leaf", "presented"], "place")
    langs, _ = dense_numbers(counts, [], ["lang"], "tree")
    langs = written(langs.select(F.col("lang").alias("of_lang"), (F.col("tree") - 1).alias("tree"),
                                 F.col("n").alias("count")), "languages")
    leaves = written(numbers.join(langs, F.expr("lang <=> of_lang")).select(
        "tree", (F.col("place") - 1).alias("pos"), "count", "doc_id", "leaf", "presented"),
        "leaves")
    total, largest = langs.agg(F.count("*"), F.max("count")).first()
    nodes = build(leaves.select("tree", "pos", F.col("leaf").alias("digest")),
                  langs.select("tree", "count"), height(largest or 0), levels)
    tops = nodes.join(_ends(langs), ["tree", "level"]).select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest")
    tops = written(tops, "subroots")
    ends = tops.select("tree").distinct().withColumn("count", F.lit(total).cast("long"))
    nodes = nodes.unionByName(build(tops, ends, height(total), levels))

    block = F.floor(F.col("pos") / ARITY ** levels)
    blocks = leaves.withColumn("block", block)
    needs = written(blocks.select("tree", "block", "count", "pos").groupBy("tree", "block")
                    .applyInPandas(block_needs(levels, total),
                                   "of long, block long, tree long, level int, pos long"), "needs")
    fetched = needs.join(nodes, ["tree", "level", "pos"])
    return blocks.withColumn("of", F.col("tree")).groupBy("of", "block").cogroup(
        fetched.groupBy("of", "block")).applyInPandas(
        block_proofs(total), PROOF.format(id=id_type))


def _ends(langs: DataFrame) -> DataFrame:
    """The level of the root of each tree."""
    level, left = F.lit(0), F.col("count")
    for _ in range(height(1 << 62)):
        level, left = level + (left > 1).cast("int"), F.ceil(left / ARITY)
    return langs.select("tree", level.alias("level"))
