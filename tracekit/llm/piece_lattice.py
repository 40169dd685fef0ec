"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces of a public model span a lattice over each text. A piece's weight is a Zipf law of its rank in the model,
``log p = -log(rank + shift)`` up to a constant, raised to ``alpha`` (small: flat, large: close to the best path). The forward
pass sums the weights of all segmentations up to every character; the backward pass draws pieces from the end in proportion.
Random numbers are a hash of the row's key, the seed and the character position, and the chances at a node are summed
from the node's own edges, so a row's segmentation depends on nothing else: not on partitions, batches or other rows.

Pieces hold a word mark only at their start, so the lattice falls apart at spaces: the forward pass runs once over the
distinct chunks of a batch, in arrays, and only the draws run over all of the text. Characters that the model lacks, and literal
word marks, become byte pieces, so decoding returns every text exactly.

Pieces are found by two independent 64-bit hashes of their characters and their length. A text is segmented in parts of
``PART`` characters that end at spaces, so a text of any length takes bounded memory unless it holds an unbroken run of characters
that long, which is one part.

The model file is read on the driver and its pieces are broadcast (their number is fixed by the model). Defined cases: a null
text gives null pieces, an empty one none; repeated rows with equal keys get equal segmentations; null keys are a key of
their own; extra columns are kept.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BYTES = 2_500_000  # of text in one piece of work
PART = 1_000_000  # characters of one text segmented at once
SHIFT = 8.0
SLOT_BITS = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_CHECK = 0xD1342543DE82EF95  # of a second hash
CHUNK = re.compile(r" *[^ ]+| +")


def read_model(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces in order of their ids with scores, and the ids of the 256 byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
    pieces = [model.id_to_piece(i) if plain[i] else "" for i in range(n)]
    return pieces, [model.get_score(i) for i in range(n)], [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Index(dict):
    """Numbers new keys in order."""

    def __missing__(self, key):
        self[key] = found = len(self)
        return found


class Lattice:
    """Lookup tables of a model; segments texts."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        self.byte_ids = np.array(byte_ids, np.int32)
        usable = [i for i, p in enumerate(pieces) if p]
        rank = np.empty(len(usable))
        rank[np.argsort(-np.array([scores[i] for i in usable]), kind="stable")] = np.arange(len(usable))
        self.longest = max(len(pieces[i]) for i in usable)
        power = _powers(_BASE, self.longest + 1)
        codes = [_mixed(self._codes(pieces[i].replace(MARK, " "))) for i in usable]
        hashes, checks = (np.array([int((c * p[: len(c)]).sum(dtype=np.uint64)) for c in codes], np.uint64) for p in (power, _powers(_CHECK, self.longest + 1)))
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(usable, np.int32)[order]
        self.checks, self.sizes = checks[order], np.array([len(c) for c in codes])[order]
        self.logp = -np.log(rank + SHIFT)[order]
        self.byte_logp = -np.log(len(usable) + SHIFT)
        # pieces by the top bits of their hash; those that collide go to a next table
        slot, self.slots = (self.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64), []
        left = np.arange(len(slot))
        while len(left):
            table = np.full(1 << SLOT_BITS, len(slot), np.int32)
            table[slot[left]] = left
            self.slots.append(table)
            left = left[table[slot[left]] != left]
        self.hashes = np.append(self.hashes, ~self.hashes[-1])
        self.inverse, self.inverse_check = pow(_BASE, -1, 2**64), pow(_CHECK, -1, 2**64)
        self.bytes = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and their places."""
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        k = self.slots[0][slot]
        found = self.hashes[k] == h
        for table in self.slots[1:]:
            other = table[slot]
            better = self.hashes[other] == h
            k = np.where(better, other, k)
            found |= better
        return found, k

    def forward(self, chunks: list[str], alpha: float):
        """Over distinct chunks: where each begins, the code point at each node, and the edges that end at each node.

        Edges are grouped by node; ``cum`` is the running sum of their chances, which starts anew at each node: the edge
        drawn is the first whose sum passes a random fraction.
        """
        n = np.array([len(c) for c in chunks], np.int64)
        begin = np.cumsum(n + 1) - (n + 1)
        size = int((n + 1).sum())
        pos = np.arange(size) - np.repeat(begin, n + 1)
        codes = np.zeros(size, np.uint64)
        codes[pos > 0] = self._codes("".join(chunks))
        mixed = np.where(pos > 0, _mixed(codes), np.uint64(0))
        total, second = (np.cumsum(mixed * _powers(b, size), dtype=np.uint64) for b in (_BASE, _CHECK))
        back, back_second = _powers(self.inverse, size + 1), _powers(self.inverse_check, size + 1)
        order = np.argsort(pos, kind="stable")[len(chunks) :]  # nodes after the first ones, by position
        rank = np.full(size, -1, np.int64)
        rank[order] = np.arange(len(order))
        mark = codes == np.uint64(ord(MARK) + 1)  # a literal mark is no space
        known = np.zeros(size, bool)
        nodes, lengths, ids, weights = [], [], [], []
        at = np.flatnonzero(pos > 0)
        for length in range(1, self.longest + 1):
            at = at[pos[at] >= length]
            if not len(at):
                break
            h = (total[at] - total[at - length]) * back[at - length + 1]
            found, k = self.find(h)
            sure = np.flatnonzero(found)
            here, piece = at[sure], k[sure]
            found[sure] = (self.sizes[piece] == length) & ((second[here] - second[here - length]) * back_second[here - length + 1] == self.checks[piece])
            if length == 1:
                found &= ~mark[at]
                known[at[found]] = True
            nodes.append(at[found])
            lengths.append(np.full(len(nodes[-1]), length, np.int8))
            ids.append(self.ids[k[found]])
            weights.append(alpha * self.logp[k[found]])
        c = codes - np.uint64(1)
        lone = np.flatnonzero((pos > 0) & ~known)
        nodes.append(lone)
        lengths.append(np.ones(len(lone), np.int8))
        ids.append(np.full(len(lone), -2, np.int32))
        weights.append(alpha * self.byte_logp * (1 + (c[lone] > 0x7F).astype(int) + (c[lone] > 0x7FF) + (c[lone] > 0xFFFF)))
        nodes, lengths, ids, weights = map(np.concatenate, (nodes, lengths, ids, weights))
        by = np.argsort(rank[nodes], kind="stable")
        nodes, lengths, ids, weights = nodes[by], lengths[by], ids[by], weights[by]
        edge = np.searchsorted(rank[nodes], np.arange(len(order) + 1))  # every node has an edge of one character at least
        per = np.diff(edge)
        source = nodes - lengths
        reach = np.zeros(size)
        chance = np.empty(len(nodes))
        turns = np.searchsorted(pos[order], np.arange(1, int(n.max()) + 2))
        for low, high in zip(turns, turns[1:], strict=False):
            e, f = edge[low], edge[high]
            w = weights[e:f] + reach[source[e:f]]
            firsts = edge[low:high] - e
            top = np.maximum.reduceat(w, firsts)
            x = np.exp(w - np.repeat(top, per[low:high]))
            whole = np.add.reduceat(x, firsts)
            reach[order[low:high]] = top + np.log(whole)
            chance[e:f] = x / np.repeat(whole, per[low:high])
        cum = chance.copy()
        for k in range(1, int(per.max())):  # a turn for each length of a piece
            more = edge[:-1][per > k] + k
            cum[more] += cum[more - 1]
        return begin, n, c, rank, edge, lengths, ids, cum

    def segment(self, texts: list[str | None], keys: np.ndarray, alpha: float) -> list[np.ndarray | None]:
        """Sampled piece ids of every text."""
        ids, bounds = self.segment_all(texts, keys, alpha)
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, bounds, bounds[1:], strict=False)]

    def segment_all(self, texts: list[str | None], keys: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Sampled piece ids of all texts in one array, and where each text's begin (one more than texts)."""
        if all(t is None or len(t) <= PART for t in texts):
            return self._segment([" " + t if t else t for t in texts], keys, np.zeros(len(texts), np.int64), alpha)
        whole, sizes = [], []
        for t, key in zip(texts, keys.tolist(), strict=True):
            sizes.append(0)
            for start, part in _parts(" " + t if t else t):
                whole.append(self._segment([part], np.array([key]), np.array([start]), alpha)[0])
                sizes[-1] += len(whole[-1])
        return np.concatenate([np.empty(0, np.int32), *whole]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _segment(self, texts: list[str | None], keys: np.ndarray, starts: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts, or parts of texts, with the space that goes before a text; ``starts`` are their places in their texts."""
        index, flat, count = _Index(), [], []
        for t in texts:
            found = CHUNK.findall(t) if t else ()
            flat.extend(map(index.__getitem__, found))
            count.append(len(found))
        if not index:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begin, n, codes, rank, edge, lengths, piece, cum = self.forward(list(index), alpha)
        chunk, count = np.array(flat, np.int64), np.array(count)
        doc = np.repeat(np.arange(len(texts)), count)
        ends = np.cumsum(n[chunk])
        chars = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]  # characters before each text
        start = ends - n[chunk]
        with np.errstate(over="ignore"):
            seed = _mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))[doc]
            seed += (starts[doc] - chars[doc]).astype(np.uint64) * np.uint64(_BASE)  # places count from the start of the text
        # a piece is written where its last character stands, so reading in order needs no sort
        out, point = np.full(int(ends[-1]) + 1, -1, np.int32), np.empty(0, np.int64)
        live, at = np.arange(len(chunk)), n[chunk].copy()
        raw_at, raw_code = [], []
        while len(live):
            node = begin[chunk[live]] + at
            point = start[live] + at
            draw = (_mixed(seed[live] + point.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(11)) * 2.0**-53
            turn = rank[node]
            pick, last = edge[turn], edge[turn + 1] - 1
            on = np.flatnonzero((cum[pick] <= draw) & (pick < last))
            while on.size:
                pick[on] += 1
                on = on[(cum[pick[on]] <= draw[on]) & (pick[on] < last[on])]
            ids = piece[pick]
            out[point] = ids
            raw = np.flatnonzero(ids == -2)
            if len(raw):
                raw_at.append(point[raw])
                raw_code.append(codes[node[raw]])
            at = at - lengths[pick]
            going = at > 0
            live, at = live[going], at[going]
        held = np.flatnonzero(out != -1)
        ids, size = out[held], np.ones(len(held), np.int64)
        if raw_at:
            raw_at, raw_code = np.concatenate(raw_at), np.concatenate(raw_code)
            by = np.argsort(raw_at)
            coded = [chr(c).encode() for c in raw_code[by].tolist()]
            spots = np.flatnonzero(ids == -2)
            size[spots] = [len(b) for b in coded]
            ids = np.repeat(ids, size)
            ids[ids == -2] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        whole = np.concatenate([[0], np.cumsum(size)])
        return ids, whole[np.searchsorted(held, chars, side="right")]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()[1:]


def _parts(text: str | None):
    """(place, part) of a text cut before spaces, in parts of about PART characters."""
    at = 0
    while text and at < len(text):
        end = at + PART
        if end < len(text):  # a cut lies between a character and a space, where no piece crosses
            while end < len(text) and not (text[end] == " " and text[end - 1] != " "):
                end = text.find(" ", end + 1)
                end = len(text) if end < 0 else end
        yield at, text[at:end]
        at = end


@functools.lru_cache(maxsize=2)
def _lattice(token: int, load) -> Lattice:
    return Lattice(*load())


class _Shared:
    """The broadcast model of a query; one lattice a Python worker."""

    def __init__(self, spark, path: str):
        model = read_model(path)
        self.model = spark.sparkContext.broadcast(model)
        self.key = zlib.crc32(repr(model).encode())  # another model at the same path is another lattice

    def get(self) -> Lattice:
        return _lattice(self.key, _Loader(self.model))


class _Loader:
    """Equal for all uses, so that the cache keys by the model's digest alone."""

    def __init__(self, model):
        self.model = model

    def __call__(self):
        return self.model.value

    def __hash__(self):
        return 0

    def __eq__(self, other):
        return isinstance(other, _Loader)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = 0.5, seed: int = 1) -> DataFrame:
    """Adds piece_ids, the sampled segmentation of the text."""
    names, shared = docs.columns, _Shared(docs.sparkSession, model)
    place = names.index(text_col)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "piece_ids"]
    keep = [i for i, n in enumerate(names) if n != "piece_ids"]

    def run(batches):
        lattice = shared.get()
        for b in text_slices(batches, place, BYTES):
            texts = b.column(place).to_pylist()
            ids, bounds = lattice.segment_all(texts, b.column(len(names)).to_numpy(), alpha)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), _listed(texts, ids, bounds)], [*(names[i] for i in keep), "piece_ids"])

    return docs.withColumn(fresh(docs, "_row_key"), F.xxhash64(F.lit(seed), F.col(id_col))).mapInArrow(run, ", ".join([*kept, "piece_ids array<int>"]))


def _listed(texts: list, ids: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts]))


def decode(encoded: DataFrame, model: str = MODEL, out_col: str = "decoded") -> DataFrame:
    """Adds the text of piece_ids."""
    names, shared = encoded.columns, _Shared(encoded.sparkSession, model)
    place = names.index("piece_ids")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != out_col]
    keep = [i for i, n in enumerate(names) if n != out_col]

    def run(batches):
        lattice = shared.get()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = [None if ids is None else lattice.decode(ids.tolist()) for ids in _lists(part.column(place))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(texts, pa.string())], [*(names[i] for i in keep), out_col])

    return encoded.mapInArrow(run, ", ".join([*kept, f"`{out_col}` string"]))


def _lists(column):
    for x in column:
        yield x.values.to_numpy() if x.is_valid else None


def sampled_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = 0.5, seed: int = 1) -> DataFrame:
    """doc_id, n_pieces, piece_ids and whether decoding returned the text, encoded and decoded in one pass."""
    shared = _Shared(docs.sparkSession, model)

    def run(batches):
        lattice = shared.get()
        for b in text_slices(batches, 1, BYTES):
            texts = b.column(1).to_pylist()
            ids, bounds = lattice.segment_all(texts, b.column(2).to_numpy(), alpha)
            same = [t is None or lattice.decode(ids[low:high].tolist()) == t for t, low, high in zip(texts, bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), _listed(texts, ids, bounds), pa.array(same)], ["doc_id", "n_pieces", "piece_ids", "lossless"])

    keyed = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(F.lit(seed), F.col(id_col)))
    return keyed.mapInArrow(run, "doc_id long, n_pieces long, piece_ids array<int>, lossless boolean")
