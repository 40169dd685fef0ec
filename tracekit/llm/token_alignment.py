"""Alignment of two tokenizers over a corpus, each distinct text once.

A byte-level BPE (A) reads space + text, a piece BPE (B) the text, to which it adds the space itself; both cut the same bytes.
Offsets where tokens of both end cut them into groups. An A token and a B token whose byte ranges overlap are a link; how many documents
hold a pair of ids linked is the pair's count, and each document's links are measured by these counts.

1. Documents are shuffled by their full text and counted, so copies, however many, are one row with a multiplicity.
2. Each distinct text is tokenised and aligned once. Both tokenizers start anew at a space behind a character that is no white space (A's
   pattern never crosses it, and no piece of B has a word mark behind another character, which is checked), so a worker
   aligns every distinct chunk between such spaces once (it remembers ``CHUNKS`` of them) and adds chunks up.
3. Texts come in blocks of ``BLOCK`` bytes. A block lists its distinct pairs with the number of documents that hold them, weighted by
   multiplicity, and each text keeps places in that list. Counts are sums over blocks, and what returns to a block is one row for
   each of its distinct pairs instead of one for every pair of every text.
4. Measures are joined to documents by the texts' SHA-256.

Nothing grows with a group of copies or with a frequent pair but the rows of step 4; a block is bounded by its bytes, or by one text. All
texts are read whole. The model files are read on the driver and broadcast (their size is fixed by the models).

Defined cases: texts that are null, empty, or whose tokens do not give back space + text (a literal U+2581, say) have no
tokens: zeros and an empty ``groups``; they count for no pair. Special tokens' strings are plain text. Repeated rows count as
documents of their own and get equal rows; null ids are kept; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices, written

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK = 4_000_000  # bytes of text aligned at once
CHUNKS = 250_000  # that a worker remembers
MARK = "▁"
#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: From a space behind a character that is no white space to the next such space; a single last space, of which B alone would see nothing, stays
#: with what is before it.
CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*(?: \Z)?")
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
COUNTED = ("n_best", "count_sum")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: visible Latin-1 stands for itself, all others follow from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_models(a_path: str = MODEL_A, b_path: str = MODEL_B) -> tuple[str, bytes]:
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


class _Numbers(dict):
    """Numbers new keys in order and lists them."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key):
        self[key] = found = len(self)
        self.new.append(key)
        return found


class Aligner:
    """Both tokenizers, and what the chunks met so far consist of."""

    def __init__(self, a_json: str, b_proto: bytes):
        spec, letters = json.loads(a_json), byte_letters()
        special = {t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if i not in special}
        decoded = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.a_size = np.zeros(max(decoded) + 1, np.int64)
        for i, t in decoded.items():
            self.a_size[i] = len(t)
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        made = [vocab[m.replace(" ", "")] for m in merges]
        if made == sorted(set(made)) and {bytes([b]) for b in range(256)} <= set(decoded.values()):
            # merges stand in the order of ids, so ids serve as ranks
            ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in decoded.items()}, special_tokens={})
            self.a_encode = ranked.encode_ordinary
        else:
            whole = tokenizers.Tokenizer.from_str(a_json)
            whole.encode_special_tokens = True
            self.a_encode = lambda text: whole.encode(text, add_special_tokens=False).ids
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_proto)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(p) for p in self.b_bytes], np.int64)
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.letters = _Numbers(), 0
        self.counts = np.zeros((0, 4), np.int64)  # as MEASURES
        self.bad, self.links, self.first = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.groups: list[str] = []

    def cut(self, text: str) -> list[str]:
        return CHUNK.findall(" " + text) if self.apart else [" " + text]

    def _tokens(self, chunks: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """Ids of A of all chunks, one behind the other, and of B for each."""
        at = [i for i, c in enumerate(chunks) if not self.apart or c[-1].isspace()]  # what follows white space changes how it is cut
        a, low = [], 0
        for i in [*at, len(chunks)]:
            a += self.a_encode("".join(chunks[low:i])) if i > low else []
            a += self.a_encode(chunks[i]) if i < len(chunks) else []
            low = i + 1
        return np.array(a, np.int64), self.b.encode([c[1:] for c in chunks], num_threads=1)

    def _learn(self) -> None:
        new, self.chunks.new = self.chunks.new, []
        if not new:
            return
        plain = [c.encode() for c in new]
        a, b = self._tokens(new)
        size = np.array([len(p) for p in plain], np.int64)
        whole = a.size and self.a_size[a].sum() == size.sum()
        bad = np.array([b"".join([self.b_bytes[i] for i in ids]) != p for ids, p in zip(b, plain, strict=True)]) if whole else np.ones(len(new), bool)
        ends = np.cumsum(size)
        a = a if whole else a[:0]
        a_chunk = np.searchsorted(ends, np.cumsum(self.a_size[a]), "left")
        b_chunk = np.repeat(np.arange(len(new)), [len(x) for x in b])
        b = np.array([i for x in b for i in x], np.int64)
        a, a_chunk, b, b_chunk = a[~bad[a_chunk]], a_chunk[~bad[a_chunk]], b[~bad[b_chunk]], b_chunk[~bad[b_chunk]]
        ends = np.cumsum(np.where(bad, 0, size))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both, every = np.intersect1d(a_end, b_end, assume_unique=True), np.union1d(a_end, b_end)
        upto = [np.searchsorted(x, ends, "right") for x in (both, every)]
        # between two neighbouring ends lie exactly one A and one B token, and no other stretch has these two
        pair = (a[np.searchsorted(a_end, every)] << 32) | b[np.searchsorted(b_end, every)]
        n = len(new)
        held = np.stack([np.bincount(a_chunk, minlength=n), np.bincount(b_chunk, minlength=n), *[np.diff(u, prepend=0) for u in upto]], 1)
        sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
        ia, ib = ([0, *(np.searchsorted(e, both) + 1).tolist()] for e in (a_end, b_end))
        group = [f"{','.join(sa[ia[g] : ia[g + 1]])}|{','.join(sb[ib[g] : ib[g + 1]])}" for g in range(len(both))]
        cuts = [0, *upto[0].tolist()]
        self.groups += [";".join(group[low:high]) for low, high in zip(cuts, cuts[1:], strict=False)]
        self.counts, self.bad, self.links = np.concatenate([self.counts, held]), np.concatenate([self.bad, bad]), np.concatenate([self.links, pair])
        self.first = np.concatenate([self.first, self.first[-1] + upto[1]])

    def align(self, texts: list[str], often: np.ndarray) -> dict:
        """Measures of the texts, their groups, the block's distinct pairs with the documents that hold them, and each text's places in
        that list with the number of its links there."""
        if len(self.chunks) > CHUNKS or self.letters > 64_000_000:
            self._forget()
        rows = [list(map(self.chunks.__getitem__, self.cut(t))) for t in texts]
        self.letters += sum(map(len, self.chunks.new))
        self._learn()
        row = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
        flat = np.array([i for r in rows for i in r], np.int64)
        good = np.bincount(row, self.bad[flat], len(texts)) == 0
        counts = np.stack([np.bincount(row, self.counts[flat, k], len(texts)).astype(np.int64) * good for k in range(4)], 1)
        groups = [";".join([self.groups[i] for i in r]) if ok else "" for r, ok in zip(rows, good.tolist(), strict=True)]
        # a chunk's links once for each text that has the chunk
        kept = good[row]
        key, times = np.unique(row[kept] * len(self.chunks) + flat[kept], return_counts=True)
        row, chunk = key // max(len(self.chunks), 1), key % max(len(self.chunks), 1)
        size = self.first[chunk + 1] - self.first[chunk]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[chunk] - ends + size, size)
        pairs, which = np.unique(self.links[place], return_inverse=True)
        key = np.repeat(row, size) * len(pairs) + which
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.repeat(times, size)[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        at, row, times = key[starts] % max(len(pairs), 1), key[starts] // max(len(pairs), 1), np.add.reduceat(times, starts) if len(starts) else times
        docs = np.bincount(at, often[row], len(pairs)).astype(np.int64)
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        return {"counts": counts, "groups": groups, "pairs": pairs, "docs": docs, "at": at, "times": times, "cuts": cuts}


@functools.lru_cache(maxsize=1)
def _aligner(a_json: str, b_proto: bytes) -> Aligner:
    return Aligner(a_json, b_proto)


def _packed(at: np.ndarray, times: np.ndarray) -> bytes:
    """Rising places and counts, as compressed byte planes."""
    both = np.stack([np.diff(at, prepend=0), times]).astype("<u4")
    return pa.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(held: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(held, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").reshape(2, n).astype(np.int64)
    return np.cumsum(both[0]), both[1]


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, n_docs) of texts that are neither null nor empty: one shuffle by the full text, counted before it."""
    return docs.select(F.col(text_col).alias("text")).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n_docs"))


def aligned(texts: DataFrame, models: tuple[str, bytes], with_groups: bool = False) -> DataFrame:
    """A written table with a row for each text (``text_key``, measures, ``groups_sha256``, ``groups`` if asked for, places in its
    block's list) and one for each block (``pairs``, ``docs``)."""
    shared = texts.sparkSession.sparkContext.broadcast(models)
    schema = "block long, text_key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_pairs int, held binary, pairs array<long>, docs array<long>"

    def work(batches):
        own, number = _aligner(*shared.value), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for part in text_slices(batches, 0, BLOCK):
            done = own.align(part.column(0).to_pylist(), part.column(1).to_numpy())
            n, cuts = part.num_rows, done["cuts"]
            yield pa.RecordBatch.from_pydict(
                {"block": [number] * (n + 1), "text_key": [*part.column(2).to_pylist(), None]}
                | {m: [*done["counts"][:, k].tolist(), None] for k, m in enumerate(MEASURES)}
                | {"groups_sha256": [*(hashlib.sha256(g.encode()).hexdigest() if g else "" for g in done["groups"]), None]}
                | {"groups": [*(done["groups"] if with_groups else [None] * n), None], "n_pairs": [*np.diff(cuts).tolist(), None]}
                | {"held": [*(_packed(done["at"][i:j], done["times"][i:j]) for i, j in zip(cuts, cuts[1:], strict=False)), None]}
                | {"pairs": pa.array([None] * n + [done["pairs"]], pa.list_(pa.int64())), "docs": pa.array([None] * n + [done["docs"]], pa.list_(pa.int64()))},
                pa.schema([("block", pa.int64()), ("text_key", pa.binary()), *[(m, pa.int64()) for m in MEASURES], ("groups_sha256", pa.string()), ("groups", pa.string()), ("n_pairs", pa.int32()), ("held", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]),
            )
            number += 1

    return written(texts.select("text", "n_docs", F.unhex(F.sha2("text", 256)).alias("text_key")).mapInArrow(work, schema))


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold a pair, and whether no pair of its A id has more. A's partners are at most B's vocabulary."""
    listed = table.where("text_key IS NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32))))


def pair_table(table: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs, best)."""
    return pair_counts(table).select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), F.col("n").alias("n_docs"), "best")


def measured(table: DataFrame, counts: DataFrame) -> DataFrame:
    """The texts of an aligned table with ``n_best`` and ``count_sum``: each block with the counts of its own pairs."""
    listed = table.where("text_key IS NULL").select("block", F.posexplode("pairs").alias("at", "pair"))
    own = listed.join(counts, "pair").select(F.col("block").alias("of"), "at", "n", "best")
    texts = table.where("text_key IS NOT NULL").drop("pairs", "docs")
    kept = [c for c in texts.columns if c not in ("block", "n_pairs", "held")]
    types = {f.name: f.dataType.simpleString() for f in texts.schema.fields}

    def work(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        n, best = (np.zeros(pairs.num_rows, np.int64) for _ in range(2))
        at = pairs.column("at").to_numpy()
        n[at], best[at] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        sums = []
        for held, size in zip(rows.column("held").to_pylist(), rows.column("n_pairs").to_pylist(), strict=True):
            place, times = _unpacked(held, size)
            sums.append((int((times * best[place]).sum()), int((times * n[place]).sum())))
        out = rows.select(kept)
        for k, name in enumerate(COUNTED):
            out = out.append_column(name, pa.array([s[k] for s in sums], pa.int64()))
        return out

    schema = ", ".join([*[f"{c} {types[c]}" for c in kept], *[f"{c} long" for c in COUNTED]])
    return texts.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(work, schema)


def alignment(docs: DataFrame, models: tuple[str, bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Every document with the measures of its text, ``groups_sha256`` and, if asked for, ``groups`` (``a1,a2|b1;a3|b2,b3``)."""
    table = aligned(distinct_texts(docs, text_col), models or read_models(), with_groups)
    found = measured(table, pair_counts(table))
    # texts without tokens find no partner: their keys are spread
    none = F.unhex(F.lpad(F.hex(F.xxhash64(id_col)), 16, "0"))
    keyed = docs.select(F.col(id_col), F.when(F.col(text_col) != "", F.unhex(F.sha2(text_col, 256))).otherwise(none).alias("_key"))
    joined = keyed.join(found, F.col("_key") == F.col("text_key"), "left")
    texts = ["groups_sha256", *(["groups"] if with_groups else [])]
    return joined.select(id_col, *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in (*MEASURES, *COUNTED)], *[F.coalesce(t, F.lit("")).alias(t) for t in texts])
