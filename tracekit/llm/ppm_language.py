"""Language ID by prediction with partial matching.

For each language a tree of byte contexts up to order three holds frozen counts from a bounded sample of labelled texts
(``sample_docs`` a language, expected, chosen by hash). The cost of a byte is exact: in the longest context that
was seen it is coded with escape method C (``c / (n + u)``, or ``u / (n + u)`` to escape to the next shorter context), and
finally one of 256 equal bytes. A text goes to the language with the shortest code; the score is that language's posterior
under equal priors.

Counting runs as a Spark job over the sampled rows; the counts (bounded by the sample) are broadcast, and each Python
worker turns them once into tables: one row of costs for every (context, byte) that any language has seen, and one of
escape costs for every context. A byte that no language has seen after its context pays the escape and is looked up after the
next shorter one. Tables grow with what the sample holds times the languages, not with contexts times bytes. The score
compares whole code lengths, so for anything longer than a line it is close to 1 for the right language;
``bits_per_byte`` says how well the text fits.

Defined cases: a null text or one without a letter is ``und`` with score 0; without labelled rows everything is
``und``; null ids are never learned from and never held out; repeated rows and extra columns are kept as they are.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

ORDER = 3
SLICE = 500_000  # bytes scored at once
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(text: str) -> np.ndarray:
    """Every byte with the three before it (zeros before the first), as big-endian numbers."""
    b = np.frombuffer(b"\0\0\0" + text.encode(), np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 250, id_col: str = "doc_id") -> bytes:
    """Frozen counts of (language, four bytes) from about ``sample_docs`` labelled texts of each language, drawn by id and text."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)).alias("draw")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = written(rows.groupBy(F.col("lang").alias("l_lang")).agg((sample_docs / F.count(F.lit(1))).alias("chance")))  # a row a language
    draw = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(sizes, F.col("lang") == F.col("l_lang")).where(draw < F.col("chance")).select("lang", "text")

    def count(batches):
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gram, n = np.unique(_grams(text), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    return pickle.dumps((langs, [counts.loc[counts["lang"] == x, ["gram", "n"]].to_numpy(np.int64) for x in langs]))


class Trees:
    """The context trees of all languages.

    A node is a context of 0 to ORDER symbols; ``node`` finds the longest one that ends a context of ORDER symbols,
    ``parent`` the next shorter one. ``place[node, symbol]`` is the row of ``cost`` (rows x languages, bits) or -1 where no language
    has seen the symbol after the context; then ``escape[node]`` (0 for languages that lack the context) is paid.
    """

    def __init__(self, model: bytes):
        self.langs, counts = pickle.loads(model)
        k = len(self.langs)
        used = np.unique(np.concatenate([(c[:, :1] >> np.array([24, 16, 8, 0])).ravel() & 255 for c in counts])) if k else np.empty(0, np.int64)
        self.width = width = len(used) + 1  # the last symbol stands for bytes never seen
        self.symbol = np.full(256, width - 1, np.int64)
        self.symbol[used] = np.arange(len(used))
        gram, n = (np.concatenate([c[:, i] for c in counts]) if k else np.empty(0, np.int64) for i in (0, 1))
        lang = np.repeat(np.arange(k), [len(c) for c in counts])
        symbols = [self.symbol[(gram >> s) & 255] for s in (24, 16, 8, 0)]
        self.node = np.zeros(width**ORDER, np.int32)
        self.parent, escape, cost, place = [np.zeros(1, np.int32)], [np.zeros((1, k))], [np.full((width, k), 8.0)], [np.arange(width)[None, :]]  # node 0: any byte equally likely
        nodes, rows, before = 1, width, None
        for order in range(ORDER + 1):
            code = np.zeros(len(gram), np.int64)
            for s in symbols[ORDER - order : ORDER]:
                code = code * width + s
            contexts, context = np.unique(code, return_inverse=True) if order else (np.zeros(min(len(gram), 1), np.int64), code)
            shorter = contexts % width ** (order - 1) if order else contexts
            up = before[1][np.searchsorted(before[0], shorter)] if order else np.zeros(len(contexts), np.int32)
            seen, entry = np.unique(context * width + symbols[ORDER], return_inverse=True)
            held = np.zeros((len(seen), k))
            np.add.at(held, (entry, lang), n)
            at, symbol = seen // width, seen % width
            total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(total, at, held)
            np.add.at(kinds, at, held > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                known = -np.log2(held / (total + kinds)[at])
            grid = np.concatenate(place)
            lower = np.concatenate(cost)[grid[up[at], symbol]]  # what is seen after a context is seen after shorter ones
            cost.append(np.where(held > 0, known, out[at] + lower))
            spot = np.full((len(contexts), width), -1, np.int64)
            spot[at, symbol] = rows + np.arange(len(seen))
            place.append(spot)
            escape.append(out)
            self.parent.append(up.astype(np.int32))
            number = (nodes + np.arange(len(contexts))).astype(np.int32)
            if order == ORDER:
                self.node[contexts] = number
            elif len(contexts):
                self.node.reshape(-1, width**order)[:, contexts] = number  # all contexts of three symbols that end like this one
            before = (contexts, number)
            nodes, rows = nodes + len(contexts), rows + len(seen)
        self.parent, self.escape, self.cost, self.place = np.concatenate(self.parent), np.concatenate(escape).astype(np.float32), np.concatenate(cost).astype(np.float32), np.concatenate(place).astype(np.int32)

    def bits(self, data: np.ndarray) -> np.ndarray:
        """(bytes - 3, languages) code lengths of every byte after the first three."""
        s = self.symbol[data]
        node, symbol = self.node[(s[:-3] * self.width + s[1:-2]) * self.width + s[2:-1]], s[3:]
        row = self.place[node, symbol]
        out = self.cost[row]
        open_ = np.flatnonzero(row < 0)
        if len(open_):
            out[open_] = 0.0
        while len(open_):
            out[open_] += self.escape[node[open_]]
            node[open_] = self.parent[node[open_]]
            row = self.place[node[open_], symbol[open_]]
            done = row >= 0
            out[open_[done]] += self.cost[row[done]]
            open_ = open_[~done]
        return out


@functools.lru_cache(maxsize=2)
def tables(model: bytes) -> Trees:
    return Trees(model)


def code_lengths(model: bytes, texts: list[str]) -> np.ndarray:
    """Bits of every text under every language."""
    trees = tables(model)
    bits = np.zeros((len(texts), len(trees.langs)))
    data = [np.frombuffer(b"\0\0\0" + t.encode(), np.uint8) for t in texts]
    n = np.array([len(d) - 3 for d in data], np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + n[end] <= SLICE):
            size, end = size + n[end], end + 1
        joined = np.concatenate(data[at:end])
        ends = np.cumsum(n[at:end] + 3)
        for low in range(0, len(joined), SLICE):  # a very long text takes several turns
            each = trees.bits(joined[max(0, low - 3) : low + SLICE])
            first = max(low, 3) if low else 3
            place = np.arange(first, first + len(each))
            owner = np.searchsorted(ends, place, side="right")
            inside = place - (ends - n[at:end] - 3)[owner] >= 3
            for k in range(len(trees.langs)):
                bits[at:end, k] += np.bincount(owner[inside], each[inside, k], minlength=end - at)
        at = end
    return bits


def predict(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and bits_per_byte to every row (columns of these names are replaced)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    langs = pickle.loads(model)[0]
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    if not langs:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    given = docs.withColumn(fresh(docs, "_letters"), letters)
    names = docs.columns
    place = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            has = np.array(batch.column(len(names)).to_pylist(), bool)
            bits = code_lengths(shared.value, [t if h else "" for t, h in zip(texts, has, strict=True)])
            best = bits.argmin(1)
            low = bits.min(1)
            score = np.where(has, 1 / np.exp2(low[:, None] - bits).sum(1), 0.0)
            size = np.array([len(t.encode()) if h else 1 for t, h in zip(texts, has, strict=True)])
            found = [langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(score), pa.array(low / size)], [*names, "lang_pred", "score", "bits_per_byte"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return given.mapInArrow(run, f"{kinds}, lang_pred string, score double, bits_per_byte double")


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))


def language_table(docs: DataFrame) -> DataFrame:
    """The contract columns for documents."""
    model = fit(learnable(docs))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
