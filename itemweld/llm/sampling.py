"""Sampled SentencePiece segmentation, and its lossless inverse.

Each text is a lattice whose edges are the pieces of a public vocabulary. Forward filtering sums
the weights of all paths into every node; backward sampling then draws a path from the end, each
edge in proportion to its share. The draws depend on the row key and the place in the text
alone, so a row's segmentation is the same in every run, batch and partition.

No piece reaches over the start of a run of spaces or over a line break, and few vocabularies have one
that reaches from a word into a full stop or comma, so the lattice falls into segments; that of a
segment is built once for all its occurrences in a batch.
"""

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from itemweld.llm.common import U64, mix, starts_of, text_blocks

MODEL_FILE = "piece_bpe_32k.model"
SHARPNESS = 1.0          # exponent of the piece weights: larger draws come nearer to the best path
BLOCK = 2_500_000        # bytes of text whose lattice is held at once
SEGMENT = re.compile(r" *[^ \n]+|\n| +")
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
FINER = re.compile(rf" *[^ \n]+?(?<={LETTER})(?=[.,])| *[^ \n]+|\n| +")     # also cut between a letter and a stop or comma
SPACE = "▁"
BASE = U64(0x9E3779B97F4A7C15)
STEPS = mix(np.arange(1 << 12, dtype=U64) + BASE)     # one addend per step of a draw


class Numbers(dict):
    """Numbers its keys in the order of their first use."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


class Vocabulary:
    """Pieces of a model file as hashed code points. A piece's weight falls with its rank,
    1 / (rank + 2); runs of spaces weigh as much as the last rank."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_at, pieces = {}, []
        self.raw = [b""] * size
        for i in range(size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(text[3:-1], 16)
                self.bytes_at[value], self.raw[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rank = min(-model.get_score(i), size)
                pieces.append((text, i, -np.log(rank + 2)))
                self.raw[i] = text.replace(SPACE, " ").encode()
        self.segment = SEGMENT if any(re.search(LETTER + "[.,]", p) for p, _, _ in pieces) else FINER
        self.size = size
        self.byte_weight = -np.log(size + 2)
        self.longest = max(len(p) for p, _, _ in pieces)
        prefixes = [{} for _ in range(self.longest + 1)]
        for text, i, weight in pieces:
            h = U64(0)
            with np.errstate(over="ignore"):
                for n, c in enumerate(text, 1):
                    h = h * BASE + U64(ord(c) + 1)
                    prefixes[n].setdefault(int(h), (-1, 0.0))
            prefixes[len(text)][int(h)] = (i, weight)
        self.levels = []
        for table in prefixes[1:]:
            keys = np.array(sorted(table), U64)
            if not self.levels:                                 # first characters: a table by code point
                self.single = np.full(int(keys[-1]) + 1, -1)
                self.single[keys.astype(np.int64) - 1] = np.arange(len(keys))
            self.levels.append((keys, np.array([table[int(k)][0] for k in keys]), np.array([table[int(k)][1] for k in keys])))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def code_points(segments) -> np.ndarray:
    """Code points of all segments in a row, spaces as the vocabulary writes them. A literal
    sign of that kind becomes a number no piece has, and so goes by bytes."""
    codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes[codes == ord(SPACE)] += 1 << 22
    codes[codes == 32] = ord(SPACE)
    return codes


class Lattice:
    """Edges of all segments sorted by the node they end in, with each edge's cumulative share."""

    def __init__(self, segments, v: Vocabulary, sharpness: float):
        sizes = np.array([len(s) for s in segments], np.int64)
        codes, bounds = code_points(segments), starts_of(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        end = bounds[owner + 1]
        at = np.arange(len(codes))
        node = at + owner                                       # a segment of n characters has n + 1 nodes
        self.last = bounds[1:] + np.arange(len(sizes))
        self.first = bounds[:-1] + np.arange(len(sizes))
        starts, ends, pieces, weights = [], [], [], []
        active, h, covered = at, np.zeros(len(codes), U64), np.zeros(len(codes), bool)
        for n, (keys, ids, weight) in enumerate(v.levels, 1):
            active = active[active + n <= end[active]]
            if not len(active):
                break
            if n == 1:
                found = v.single[np.minimum(codes, len(v.single) - 1)]
                known = found >= 0
                h = (codes + 1).astype(U64)
            else:
                now = h[active] * BASE + (codes[active + n - 1] + 1).astype(U64)
                h[active] = now
                found = np.minimum(np.searchsorted(keys, now), len(keys) - 1)
                known = keys[found] == now
            active, found = active[known], found[known]
            whole = ids[found] >= 0
            a, f = active[whole], found[whole]
            if n == 1:
                covered[a] = True
            starts.append(node[a].astype(np.int32))
            ends.append((node[a] + n).astype(np.int32))
            pieces.append(ids[f].astype(np.int32))
            weights.append(weight[f])
        plain = np.flatnonzero(~covered)                        # characters without a piece: their bytes
        points = np.where(codes[plain] >= 1 << 22, codes[plain] - (1 << 22), codes[plain])
        self.char_base = v.size
        length = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        starts.append(node[plain].astype(np.int32))
        ends.append((node[plain] + 1).astype(np.int32))
        pieces.append((v.size + points).astype(np.int32))
        weights.append(v.byte_weight * length)
        start, stop, piece = (np.concatenate(x[::-1]) for x in (starts, ends, pieces))      # longest first: likelier
        weight = np.concatenate(weights[::-1]) * sharpness
        depth = stop - self.first[np.repeat(np.arange(len(sizes)), sizes + 1)[stop]]
        order = np.argsort(stop, kind="stable")
        if depth.max() < 1 << 16:
            depth = depth.astype(np.uint16)                     # sorted by radix
        order = order[np.argsort(depth[order], kind="stable")]
        start, stop, piece, weight, depth = (x[order] for x in (start, stop, piece, weight, depth))
        total = np.full(len(codes) + len(sizes), -np.inf)
        total[self.first] = 0.0
        share = np.empty(len(start))
        levels = np.flatnonzero(np.diff(depth.astype(np.int64), prepend=0))
        for a, b in zip(levels, [*levels[1:], len(start)]):
            value = total[start[a:b]] + weight[a:b]
            cut = np.flatnonzero(np.diff(stop[a:b], prepend=-1))
            top = np.maximum.reduceat(value, cut)
            run = np.repeat(np.arange(len(cut)), np.diff([*cut, b - a]))
            part = np.exp(value - top[run])
            whole = part[cut].copy()
            rank = np.arange(b - a) - cut[run]
            for k in range(1, int(rank.max()) + 1):             # in order, so that sums don't depend on the batch
                at_k = np.flatnonzero(rank == k)
                part[at_k] += part[at_k - 1]
                whole[run[at_k]] = part[at_k]
            share[a:b] = part / whole[run]
            total[stop[a:b][cut]] = top + np.log(whole)
        by_node = np.argsort(stop, kind="stable")
        self.start, self.piece, self.share = start[by_node], piece[by_node], share[by_node]
        self.edge = starts_of(np.bincount(stop, minlength=len(total)))[:-1]      # first edge into each node
        self.share[np.flatnonzero(np.diff(stop[by_node], append=-1))] = 2.0      # the last one takes what is left

    def sample(self, segment: np.ndarray, seeds: np.ndarray):
        """(pieces, bounds): a path through the lattice of each occurrence, first piece first."""
        node, first = self.last[segment].copy(), self.first[segment]
        live, steps = np.arange(len(segment)), []
        count = np.zeros(len(segment), np.int64)
        while len(live):
            draw = (mix(seeds[live] + STEPS[len(steps) % len(STEPS)]) >> U64(11)).astype(np.float64) / 2.0**53
            edge = self.edge[node[live]]
            on = np.flatnonzero(self.share[edge] <= draw)
            while len(on):
                edge[on] += 1
                on = on[self.share[edge[on]] <= draw[on]]
            steps.append((live, self.piece[edge]))
            count[live] += 1
            node[live] = self.start[edge]
            live = live[node[live] != first[live]]
        bounds = starts_of(count)
        out = np.empty(bounds[-1], np.int64)
        for i, (rows, pieces) in enumerate(steps):
            out[bounds[rows + 1] - 1 - i] = pieces
        return out, bounds


def with_bytes(pieces: np.ndarray, v: Vocabulary):
    """Replaces characters without a piece by their byte pieces; also returns how many each became."""
    odd = np.flatnonzero(pieces >= v.size)
    width = np.ones(len(pieces), np.int64)
    if not len(odd):
        return pieces, width
    parts = [[v.bytes_at[b] for b in chr(int(p) - v.size).encode()] for p in pieces[odd]]
    width[odd] = [len(p) for p in parts]
    out = np.repeat(pieces, width)
    at = starts_of(width)[odd]
    for a, p in zip(at, parts):
        out[a:a + len(p)] = p
    return out, width


def segment_batch(keys, texts, v: Vocabulary, sharpness: float):
    """(ids, bounds) of the sampled segmentation of each text; None counts as empty."""
    table = Numbers()
    per, places = [], []
    for t in texts:
        parts = v.segment.findall(t) if t else []
        per.append(np.fromiter(map(table.__getitem__, parts), np.int64, len(parts)))
    if not table:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    lattice = Lattice(list(table), v, sharpness)
    size = np.array([len(p) for p in table], np.int64)
    for p in per:
        places.append(starts_of(size[p])[:-1])
    segment, docs = np.concatenate(per), starts_of([len(p) for p in per])
    seeds = mix(np.repeat(np.array(keys, np.int64).astype(U64), np.diff(docs)) + mix(np.concatenate(places).astype(U64) + U64(1)))
    pieces, bounds = lattice.sample(segment, seeds)
    ids, width = with_bytes(pieces, v)
    return ids, starts_of(width)[bounds][docs]


def encode(docs: DataFrame, *, key="doc_id", text="text", model=None, sharpness=SHARPNESS, seed=0) -> DataFrame:
    """(key, text, pieces array<int>): one sampled segmentation per row.

    The same (key, text, seed) always gives the same pieces; repeated rows get equal ones. A null
    key is hashed as such; a null text gives null pieces, an empty one no pieces. An empty table
    gives no rows. ``decode`` restores every text, with whatever characters.
    """
    model = model or public_tokenizers.path(MODEL_FILE)

    def run(batches):
        v = vocabulary(model)
        for block in text_blocks(batches, limit=BLOCK):
            texts = block.column(1).to_pylist()
            ids, bounds = segment_batch(block.column(2).to_numpy(), texts, v, sharpness)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)),
                                             mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), lists], names=["key", "text", "pieces"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    return rows.mapInArrow(run, f"key {kind}, text string, pieces array<int>")


def decoded(pieces, model=None):
    """Column: the text that an array of piece ids stands for; null for null."""
    model = model or public_tokenizers.path(MODEL_FILE)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        raw = vocabulary(model).raw
        for column in parts:
            yield pd.Series([None if p is None else b"".join([raw[i] for i in p.tolist()]).decode() for p in column], dtype=object)

    return F.pandas_udf(run, "string")(pieces)
