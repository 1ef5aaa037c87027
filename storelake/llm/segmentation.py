"""Sampled segmentations into the pieces of a SentencePiece model, and back.

A text's segmentations are the paths of a lattice: bytes are its nodes, pieces its arcs.
A piece of rank r has the log probability -ln(r + 1) up to a constant (the public models
used here keep ranks, not probabilities), characters without a piece go by their bytes.
Segmentations are drawn without replacement by perturbing the log probability of each
with Gumbel noise and taking the k largest. The search never lists them: it goes through
the tree of prefixes best first, and a prefix's largest perturbed value is drawn given
its parent's (a Gumbel variable truncated at the parent's value). The child with the
parent's own value is found by sampling an arc, so a path runs straight to its end, and
the frontier holds, for each arc taken, the best of the arcs not taken. The value next
in line after the last draw gives every draw's inclusion probability.

Backward sums make a node's arcs add up to 1, so no path is tried in vain. No piece
crosses from a letter to a following space, nor any byte that is in no piece, so the
lattice falls apart into words there; equal words of a slice share their part, and all
words of a slice are walked at once. Noise depends on the row's key, the draw and the
place in the text only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.llm.text import Hasher, buffers, mix, slices

SAMPLES = 2
SLICE = 1 << 18
#: Gumbel noise from numbers of 32 bits is less than DEEP. The frontier is drawn down to
#: a log probability of DEEPEST or NEAR arcs at first, then as far as its best value asks.
DEEP, DEEPEST, NEAR = 23.0, -30.0, 400
STEP = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def times(draw: int, constant: np.uint64, plus: int = 0) -> np.uint64:
    return np.uint64((draw * int(constant) + plus) % (1 << 64))


@dataclass
class Pieces:
    """The pieces as bytes (a space for the model's space mark), with a trie over them."""

    content: list[bytes]
    score: np.ndarray  # of each piece; of the 256 byte pieces in byte_ids' order at the end
    ids: np.ndarray  # of the pieces in the model
    byte_ids: np.ndarray
    unknown_bytes: np.ndarray  # bytes that are in no piece

    def __post_init__(self) -> None:
        keys, states, ends = {}, 1, {}
        for number, piece in enumerate(self.content):
            state = 0
            for byte in piece:
                key = state << 8 | byte
                if key not in keys:
                    keys[key] = states
                    states += 1
                state = keys[key]
            ends[state] = number
        self.end = np.full(states, -1, np.int32)
        self.end[list(ends)] = list(ends.values())
        # The trie's steps in an open hash table; the first two of them in plain tables.
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int32)
        self.next = np.full(1 << self.bits, -1, np.int32)
        for key, state in keys.items():
            place = int(self.place(np.array([key], np.int32))[0])
            while self.keys[place] >= 0:
                place = (place + 1) & ((1 << self.bits) - 1)
            self.keys[place], self.next[place] = key, state
        self.first = np.full(256, -1, np.int32)
        self.second = np.full(1 << 16, -1, np.int32)
        for byte in range(256):
            state = self.first[byte] = keys.get(byte, -1)
            for other in range(256 if state >= 0 else 0):
                self.second[byte << 8 | other] = keys.get(int(state) << 8 | other, -1)
        self.longest = max(map(len, self.content))
        whole = {int(i): c for i, c in zip(self.ids, self.content, strict=True)}
        whole |= {int(b): bytes([n]) for n, b in enumerate(self.byte_ids)}
        size = max(whole) + 1
        self.lengths = np.array([len(whole.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(whole.get(i, b"") for i in range(size)), np.uint8)


    def place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state after one more byte, -1 if no piece goes on like that."""
        key = state << 8 | byte
        place = self.place(key)
        known = self.keys[place]
        out = np.where(known == key, self.next[place], -1)
        open_ones = np.flatnonzero((known != key) & (known >= 0))
        while len(open_ones):
            place = (place[open_ones] + 1 if len(place) != len(open_ones) else place + 1) & (
                (1 << self.bits) - 1)
            own = key[open_ones]
            known = self.keys[place]
            hit = known == own
            out[open_ones[hit]] = self.next[place[hit]]
            more = ~hit & (known >= 0)
            open_ones, place = open_ones[more], place[more]
        return out


def load_pieces(model_file: str, sharpness: float = 1.0) -> Pieces:
    """Read a model with byte pieces; ``sharpness`` multiplies all log probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    ids, content = [], []
    for i in range(size):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            ids.append(i)
            content.append(model.id_to_piece(i).replace("▁", " ").encode())
    if any(b" " in c[1:] and c.strip(b" ") for c in content):
        raise ValueError("a piece goes on after a space")
    rank = np.arange(len(ids) + 256)
    unknown = np.ones(256, bool)
    unknown[list(set(b"".join(content)))] = False
    score = -sharpness * np.log(rank + 1.0)
    score[len(ids):] = -sharpness * math.log(len(ids) + 1)
    return Pieces(content, score, np.array(ids), byte_ids, unknown)


class Lattice:
    """Arcs of the distinct words of a slice with the probability of each from its node.

    A node is a byte of a word, or its end. Nodes are numbered by how many bytes are left,
    so that sums from the words' ends go through them in order; number 0 is every end.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray,
                 pieces: Pieces) -> None:
        length = (end - begin).astype(np.int32)
        edge = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        total = int(edge[-1])
        source = np.arange(total, dtype=np.int32) + np.repeat(
            (begin - edge[:-1]).astype(np.int32), length)
        letters = data[source].astype(np.int32)
        left = np.repeat(edge[1:], length) - np.arange(total, dtype=np.int32)
        small = left.astype(np.uint16) if total and left.max() < 65536 else left
        byte_of = np.argsort(small, kind="stable").astype(np.int32)  # of each node but 0
        node_of = np.empty(total, np.int32)
        node_of[byte_of] = np.arange(1, total + 1, dtype=np.int32)
        #: Bytes left at each node; where each word begins.
        self.left = np.concatenate([[0], left[byte_of]]).astype(np.int32)
        self.begin = node_of[edge[:-1]] if len(length) else np.zeros(0, np.int32)

        found, count = self._arcs(letters, left, pieces)
        count = np.concatenate([[0], count[byte_of]])
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        arcs = int(self.first[-1])
        self.start, self.to = np.empty(arcs, np.int32), np.empty(arcs, np.int32)
        self.piece = np.empty(arcs, np.int32)
        for at, size, piece, slot in found:
            node = node_of[at]
            place = self.first[node + 1] - 1 - slot  # long pieces first: they are likelier
            self.start[place], self.piece[place] = node, piece
            over = left[at] == size
            self.to[place] = np.where(over, 0, node_of[np.where(over, 0, at + size)])

        score = pieces.score[self.piece]
        ways = np.zeros(total + 1)
        self.log = np.empty(arcs)
        levels = np.flatnonzero(np.append(True, self.left[2:] != self.left[1:-1])) + 1 \
            if total else np.zeros(0, np.int64)
        for i, j in zip(levels.tolist(), np.append(levels[1:], total + 1).tolist(), strict=True):
            a, b = int(self.first[i]), int(self.first[j])
            v = score[a:b] + ways[self.to[a:b]]
            each = count[i:j]
            used = np.flatnonzero(each)  # no path comes to the inner bytes of a whole piece
            if not len(used):
                continue
            first, each = self.first[i:j][used] - a, each[used]
            high = np.maximum.reduceat(v, first)
            whole = high + np.log(np.add.reduceat(np.exp(v - np.repeat(high, each)), first))
            ways[i + used] = whole
            self.log[a:b] = v - np.repeat(whole, each)
        np.minimum(self.log, 0.0, out=self.log)
        sums = np.cumsum(np.exp(self.log))
        if arcs:
            begins = self.first[1:-1]
            base = np.where(begins > 0, sums[begins - 1], 0.0)
            sums -= np.repeat(base, count[1:])
            sums[self.first[2:] - 1] = 1.0
        #: Summed probability of a node's arcs up to each.
        self.reach = sums

    @staticmethod
    def _arcs(letters: np.ndarray, left: np.ndarray, pieces: Pieces) -> tuple[list, np.ndarray]:
        """Arcs by length (byte, length, piece, number at its byte), and how many begin there."""
        total = len(letters)
        count = np.zeros(total, np.int32)
        heads = (letters & 0xC0) != 0x80
        at = np.flatnonzero(heads).astype(np.int32)
        size = np.ones(total, np.int32)
        size[at] = np.diff(np.append(at, total))
        plain = np.zeros(total, bool)
        state, found = pieces.first[letters[at]], []
        for length in range(1, pieces.longest + 1):
            if length > 1:
                inside = left[at] >= length
                at, state = at[inside], state[inside]
                last = letters[at + (length - 1)]
                state = pieces.second[letters[at] << 8 | last] if length == 2 else \
                    pieces.step(state, last)
            alive = state >= 0
            at, state = at[alive], state[alive]
            if not len(at):
                break
            piece = pieces.end[state]
            ends = piece >= 0
            own = at[ends]
            found.append((own, length, piece[ends], count[own]))
            count[own] += 1
            plain[own[np.minimum(size[own], left[own]) == length]] = True
        # Characters without a piece, byte by byte.
        owner = np.maximum.accumulate(np.where(heads, np.arange(total, dtype=np.int32), 0))
        raw = np.flatnonzero(~plain[owner]).astype(np.int32)
        found.append((raw, 1, len(pieces.content) + letters[raw], count[raw]))
        count[raw] += 1
        return found, count

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc of each node, by a number from 0 to 1."""
        arc = self.first[node]
        over = np.flatnonzero(u >= self.reach[arc])
        while len(over):
            arc[over] += 1
            over = over[u[over] >= self.reach[arc[over]]]
        return arc


def uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0 ** -32


def truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of the locations, given that they are below the bounds."""
    return location - np.log(np.exp(np.minimum(location - bound, 700)) - np.log(u))


@dataclass
class Front:
    """What branches off the arcs of one draw: the best value of the siblings of each."""

    before: np.ndarray  # log probability of the path up to the arc
    best: np.ndarray
    place: np.ndarray  # byte of the row's text
    floor: float  # log probability of the path where this front ends, -inf at the path's end
    skip: int
    bound: float
    draw: int
    taken: dict[int, list[int]] = field(default_factory=dict)


class Search:
    """Draws of all rows of one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray,
                 pieces: Pieces) -> None:
        rows = len(offsets) - 1
        self.rows, self.seeds, self.offsets = rows, seeds, offsets
        space = data == 32
        lone = pieces.unknown_bytes[data]
        head = np.zeros(len(data) + 1, bool)
        head[offsets] = True
        before = np.append(False, space[:-1])[:len(data)]
        cut = head[:-1] | (space & ~before) | lone | np.append(False, lone[:-1])[:len(data)]
        self.begin = np.flatnonzero(cut)
        self.end = np.append(self.begin[1:], len(data))
        self.row = np.searchsorted(offsets, self.begin, "right") - 1
        names = Hasher(data)(self.begin, self.end)
        _, one, self.word = np.unique(names, return_index=True, return_inverse=True)
        self.lattice = Lattice(data, self.begin[one], self.end[one], pieces)
        self.words = np.searchsorted(self.row, np.arange(rows + 1))
        # Bytes of the row's text up to the end of each word, to tell where a node is.
        self.until = (self.end - offsets[self.row]).astype(np.int64)

    def walk(self, words: np.ndarray, node: np.ndarray, draw: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of a path through each word from its node on, their log probabilities, and
        where each word's begin."""
        lattice, steps = self.lattice, []
        live = np.flatnonzero(node > 0)
        live = live[np.argsort(self.word[words[live]], kind="stable")]
        at, own, until = node[live], self.seeds[self.row[words[live]]], self.until[words[live]]
        count = np.zeros(len(words), np.int64)
        while len(live):
            noise = (until - lattice.left[at]).view(np.uint64) * STEP + times(draw, OTHER)
            arc = lattice.pick(at, uniform(own ^ mix(noise)))
            steps.append((live, arc, lattice.log[arc]))
            count[live] += 1
            at = lattice.to[arc]
            more = at > 0
            live, at, own, until = live[more], at[more], own[more], until[more]
        first = np.concatenate([[0], np.cumsum(count)])
        out, logs = np.empty(first[-1], np.int32), np.empty(first[-1])
        for turn, (which, arc, log) in enumerate(steps):
            place = first[which] + turn
            out[place], logs[place] = arc, log
        return out, logs, first

    def frontiers(self, rows: np.ndarray, first: np.ndarray, arcs: np.ndarray,
                  logs: np.ndarray, skip: np.ndarray, bound: np.ndarray, draw: int,
                  near: int, deepest: float) -> list[Front]:
        """For a path of each row the best sibling of each arc from ``skip`` on.

        Only the path's beginning is looked at, ``near`` arcs down to a log probability of
        ``deepest``. Noise is less than DEEP, so the siblings of later arcs do not matter
        as long as the front's best value is more than DEEP above its floor.
        """
        count = np.diff(first)
        count = np.minimum(count, skip + near) if near else count
        edge = np.concatenate([[0], np.cumsum(count)])
        if not edge[-1]:
            none = np.zeros(0)
            return [Front(none, none, none, -np.inf, *x, draw)
                    for x in zip(skip.tolist(), bound.tolist(), strict=True)]
        at = np.arange(edge[-1]) + np.repeat(first[:-1] - edge[:-1], count)
        own, arc, log = np.repeat(np.arange(len(rows)), count), arcs[at], logs[at]
        lattice, full = self.lattice, count > 0
        size = (lattice.left[lattice.start[arc]] - lattice.left[lattice.to[arc]]).astype(np.int64)
        sums, bytes_to = np.cumsum(log) - log, np.cumsum(size) - size
        base, zero = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        base[full], zero[full] = sums[edge[:-1][full]], bytes_to[edge[:-1][full]]
        before, place = sums - base[own], bytes_to - zero[own]
        floor = np.where(count < np.diff(first), np.concatenate([sums, [sums[-1] + log[-1]]])[
            edge[1:]] - base, -np.inf)
        keep = before >= deepest
        if not keep.all():
            dropped = np.flatnonzero(~keep)
            high = np.full(len(rows), -np.inf)
            np.maximum.at(high, own[dropped], before[dropped])
            floor = np.maximum(floor, high)
            own, log, before, place, number = (x[keep] for x in (
                own, log, before, place, np.arange(edge[-1]) - edge[:-1][own]))
        else:
            number = np.arange(edge[-1]) - edge[:-1][own]
        with np.errstate(divide="ignore"):
            others = before + np.log(-np.expm1(log))
        noise = uniform(self.seeds[rows[own]] ^ mix(
            place.astype(np.uint64) * OTHER + times(draw, STEP, int(OTHER))))
        best = truncated(others, bound[own], noise)
        # Arcs before skip belong to the draw that the path branched off.
        best[(others < -1e30) | (number < skip[own])] = -np.inf
        edge = np.searchsorted(own, np.arange(len(rows) + 1)).tolist()
        return [Front(before[a:b], best[a:b], place[a:b], *x, draw) for a, b, *x in zip(
            edge[:-1], edge[1:], floor.tolist(), skip.tolist(), bound.tolist(), strict=True)]

    def draws(self, k: int, near: int = NEAR, deepest: float = DEEPEST
              ) -> list[list[tuple[np.ndarray, np.ndarray, float]]]:
        """For each row up to k draws (arcs, their log probabilities, perturbed value), then
        the next value."""
        lattice, rows = self.lattice, self.rows
        top = -np.log(-np.log(uniform(mix(self.seeds ^ OTHER))))
        arcs, logs, first = self.walk(np.arange(len(self.begin)), lattice.begin[self.word], 0)
        first = first[self.words]
        every = np.arange(rows)
        none = np.zeros(rows, np.int64)
        found = [[(arcs[a:b], logs[a:b], value)] for a, b, value in zip(
            first[:-1].tolist(), first[1:].tolist(), top.tolist(), strict=True)]
        fronts = [[f] for f in self.frontiers(every, first, arcs, logs, none, top, 0, near,
                                              deepest)]
        for draw in range(1, k + 1):
            chosen = []
            for r in range(rows):
                if len(found[r]) > len(fronts[r]):  # it had no more
                    continue
                value, n, i = self._best(r, found[r], fronts[r])
                if draw == k or value == -np.inf:
                    found[r].append(value)
                else:
                    chosen.append((r, n, i, value))
            if chosen:
                self._continue(found, fronts, chosen, draw, near, deepest)
        return found

    def _best(self, row: int, found: list, fronts: list[Front]) -> tuple[float, int, int]:
        """The best value of the row's fronts, which one has it, and at which arc."""
        while True:
            best, n, i = -np.inf, 0, 0
            for m, front in enumerate(fronts):
                if len(front.best):
                    at = int(front.best.argmax())
                    if front.best[at] > best:
                        best, n, i = float(front.best[at]), m, at
            short = [m for m, f in enumerate(fronts) if best < f.floor + DEEP]
            if not short:
                return best, n, i
            for m in short:
                f, (arcs, logs, _) = fronts[m], found[m]
                whole = self.frontiers(np.array([row]), np.array([0, len(arcs)]), arcs, logs,
                                       np.array([f.skip]), np.array([f.bound]), f.draw, 0,
                                       -np.inf)[0]
                whole.best[:len(f.best)] = f.best
                whole.taken = f.taken
                fronts[m] = whole

    def _branch(self, arcs: np.ndarray, front: Front, i: int, value: float, u: float, v: float
                ) -> int:
        """Take the best sibling at arc i, and renew what is left there."""
        lattice, arc = self.lattice, int(arcs[i])
        node = lattice.start[arc]
        a, b = int(lattice.first[node]), int(lattice.first[node + 1])
        used = front.taken.setdefault(i, [arc])
        p = [0.0 if a + n in used else math.exp(x)
             for n, x in enumerate(lattice.log[a:b].tolist())]
        whole = sum(p)
        aim, passed, arc = u * whole, 0.0, -1
        for n, x in enumerate(p):
            passed += x
            if x and (arc < 0 or passed - x <= aim):
                arc = n
        left = whole - p[arc]
        used.append(a + arc)
        front.best[i] = -np.inf
        if len(used) < b - a and left > 0:
            place = float(front.before[i]) + math.log(left)
            front.best[i] = place - math.log(math.exp(min(place - value, 700)) - math.log(v))
        return a + arc

    def _continue(self, found: list, fronts: list, chosen: list, draw: int, near: int,
                  deepest: float) -> None:
        """Draws that begin like an earlier one and then take another arc."""
        lattice = self.lattice
        rows = np.array([c[0] for c in chosen])
        places = np.array([int(fronts[r][n].place[i]) for r, n, i, _ in chosen])
        key = self.seeds[rows] ^ mix(places.astype(np.uint64) * STEP + times(draw, OTHER, 77))
        heads = np.array([self._branch(found[r][n][0], fronts[r][n], i, value, u, v)
                          for (r, n, i, value), u, v in zip(
                              chosen, uniform(key).tolist(), uniform(mix(key)).tolist(),
                              strict=True)])
        # The rest of the word, and all words after it.
        word = np.searchsorted(self.begin, self.offsets[rows] + places, "right") - 1
        count = self.words[rows + 1] - word
        ends = np.concatenate([[0], np.cumsum(count)])
        words = np.arange(ends[-1]) + np.repeat(word - ends[:-1], count)
        node = lattice.begin[self.word[words]]
        node[ends[:-1]] = lattice.to[heads]
        arcs, logs, first = self.walk(words, node, draw)
        first = first[ends].tolist()
        paths, sums = [], []
        for n, (r, s, i, _) in enumerate(chosen):
            old, own = found[r][s], slice(first[n], first[n + 1])
            paths += [old[0][:i], heads[n:n + 1], arcs[own]]
            sums += [old[1][:i], lattice.log[heads[n:n + 1]], logs[own]]
        arcs, logs = np.concatenate(paths).astype(np.int32), np.concatenate(sums)
        skip = np.array([c[2] + 1 for c in chosen])
        first = np.concatenate([[0], np.cumsum(skip + np.diff(first))])
        value = np.array([c[3] for c in chosen])
        new = self.frontiers(rows, first, arcs, logs, skip, value, draw, near, deepest)
        for n, (r, _, _, value) in enumerate(chosen):
            found[r].append((arcs[first[n]:first[n + 1]], logs[first[n]:first[n + 1]], value))
            fronts[r].append(new[n])


def decoded(ids: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The bytes of a sequence of piece ids."""
    length = pieces.lengths[ids]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pieces.bytes[np.arange(total) + np.repeat(pieces.starts[ids] - ends + length, length)]


def _id_lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                    pa.array(flat.astype(np.int32), pa.int32()))


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space in front; empty texts stay empty."""
    full = np.diff(offsets) > 0
    moved = offsets + np.concatenate([[0], np.cumsum(full)])
    out = np.full(moved[-1], 32, np.uint8)
    row = np.repeat(np.cumsum(full), np.diff(offsets))
    out[np.arange(len(data)) + row] = data
    return out, moved


def sample_segmentations(docs: DataFrame, pieces: Pieces, samples: int = SAMPLES,
                         id_col: str = "doc_id", text_col: str = "text", seed: int = 0
                         ) -> DataFrame:
    """Distinct segmentations of every text, the best perturbed first.

    doc_id, draw (from 1), ids, n_pieces, log_prob (of the segmentation among all of its
    text), perturbed, log_inclusion (log probability of being among the draws, given the
    next perturbed value), round_trip (the ids give the text's bytes again). A text with
    fewer segmentations gives all it has, each with log_inclusion 0. An empty text has one
    segmentation, without pieces; a null text has one row with null ids. Rows of equal
    id and text get equal draws. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(id_col), F.lit(seed)).alias("seed"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            seeds = batch.column("seed").to_numpy(zero_copy_only=False).astype(np.int64)
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, SLICE):
                text, at = spaced(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                search = Search(text, at, mix(seeds[i:j].view(np.uint64)), known)
                lattice = search.lattice
                names = np.concatenate([known.ids, known.byte_ids])
                own, number, ids, log, perturbed, inclusion, same = ([] for _ in range(7))
                for r, (*draws, beyond) in enumerate(search.draws(samples)):
                    whole = text[at[r]:at[r + 1]]
                    for n, (arcs, logs, value) in enumerate(draws, 1):
                        p = float(logs.sum())
                        piece = names[lattice.piece[arcs]]
                        own.append(i + r)
                        number.append(n)
                        ids.append(piece)
                        log.append(p)
                        perturbed.append(value)
                        x = p - beyond
                        inclusion.append(0.0 if x > 40 else math.log(-math.expm1(-math.exp(x)))
                                         if x > -30 else x)
                        same.append(np.array_equal(decoded(piece, known), whole))
                lists = _id_lists(ids)
                missing = pa.array(null[own])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(own, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(lists.to_pylist(), lists.type, mask=null[own]) if null[own].any()
                    else lists, pa.array([len(x) for x in ids], pa.int32()),
                    pa.array(log, pa.float64()), pa.array(perturbed, pa.float64()),
                    pa.array(inclusion, pa.float64()),
                    pa.array(same, pa.bool_()) if not null[own].any()
                    else pa.array(np.array(same) & ~missing.to_numpy(zero_copy_only=False))],
                    ["doc_id", "draw", "ids", "n_pieces", "log_prob", "perturbed",
                     "log_inclusion", "round_trip"])

    return rows.mapInArrow(run, f"doc_id {kind}, draw int, ids array<int>, n_pieces int, "
                                "log_prob double, perturbed double, log_inclusion double, "
                                "round_trip boolean")


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "ids", name: str = "text"
           ) -> DataFrame:
    """The given columns and the text of the ids, without the space put in front.

    Null ids give a null text. Ids that are no pieces (or control pieces) give nothing;
    bytes that are no UTF-8 are replaced. An input column of the same name is replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pieces)
    packed = rows.select(F.struct("*").alias("row"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                own = np.asarray(ids.values.fill_null(-1), np.int64)
                own = own[(own >= 0) & (own < len(known.lengths))]
                texts.append(decoded(own, known).tobytes().removeprefix(b" ")
                             .decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())],
                                             ["row", "text"])

    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, "
                                 "text string")
    return out.select(*[F.col(f"row.`{c}`") for c in rows.columns if c != name],
                      F.col("text").alias(name))
