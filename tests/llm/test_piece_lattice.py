import itertools
import math
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from tracekit.llm import piece_lattice as P

TEXTS = ["a b", " a", "a  b ", "a▁b", "é\n\tx", "", None, "ﬁ", "x" * 300, "   ", "日本語\U0001f600 the the", "\x00", "the " * 200]


@pytest.fixture(scope="module")
def lattice():
    return P.Lattice(*P.read_model())


def test_round_trip_and_independence(lattice):
    keys = np.arange(len(TEXTS))
    got = lattice.segment(TEXTS, keys, 0.5)
    for text, ids in zip(TEXTS, got, strict=True):
        assert ids is None if text is None else lattice.decode(ids.tolist()) == text
    again = lattice.segment(TEXTS[::-1], keys[::-1], 0.5)[::-1]
    assert all(a is b is None or (a == b).all() for a, b in zip(got, again, strict=True))
    other = lattice.segment(TEXTS, keys + 100, 0.5)
    assert any(a is not None and (len(a) != len(b) or (a != b).any()) for a, b in zip(got, other, strict=True))


def test_draws_follow_the_exact_distribution(lattice):
    pieces, scores, byte_ids = P.read_model()
    word, alpha = "ther", 0.7
    usable = [i for i, p in enumerate(pieces) if p]
    rank = {i: r for r, i in enumerate(sorted(usable, key=lambda i: (-scores[i], i)))}
    index = {pieces[i]: i for i in usable}
    marked, chances = "▁" + word, {}
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        parts, now = [], marked[0]
        for cut, c in zip(cuts, marked[1:], strict=True):
            if cut:
                parts.append(now)
                now = c
            else:
                now += c
        parts.append(now)
        if all(p in index for p in parts):
            chances[tuple(index[p] for p in parts)] = math.exp(sum(-alpha * math.log(rank[index[p]] + P.SHIFT) for p in parts))
    total, n = sum(chances.values()), 20000
    seen = Counter(tuple(x.tolist()) for x in lattice.segment([word] * n, np.arange(n), alpha))
    assert set(seen) <= set(chances)
    for ids, c in chances.items():
        p = c / total
        assert abs(seen[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_a_very_long_word_and_text(lattice):
    for text in ("q" * 20000, "ab cd " * 20000):
        (ids,) = lattice.segment([text], np.array([1]), 0.5)
        assert lattice.decode(ids.tolist()) == text


def test_query_columns_nulls_and_repeats(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (0, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece_ids", F.lit("clash"))
    got = P.sampled_pieces(df).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert len({tuple(r.piece_ids) for r in got if r.doc_id == 0}) == 1
    assert [r.piece_ids for r in got if r.doc_id == 6] == [None]
    assert P.sampled_pieces(df.limit(0)).count() == 0
    assert P.encode(df).columns == ["doc_id", "text", "piece_ids"]


def test_parts_and_company_change_nothing(lattice, monkeypatch):
    """A text cut into parts, and one among others, gets the pieces that it gets whole and alone."""
    rng = np.random.default_rng(3)
    words = ["the", "of", "tion", "😀", "▁x", "  ", "ſ", "and\n", "q" * 70]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(5)] + ["", None, " lead", "x" * 200]
    keys = np.arange(len(texts)) * 7919
    alone = [lattice.segment([t], keys[i : i + 1], 0.4)[0] for i, t in enumerate(texts)]
    together = lattice.segment(texts, keys, 0.4)
    monkeypatch.setattr(P, "PART", 40)
    cut = lattice.segment(texts, keys, 0.4)
    for t, a, b, c in zip(texts, alone, together, cut, strict=True):
        if t is None:
            assert a is b is c is None
        else:
            assert a.tolist() == b.tolist() == c.tolist() and lattice.decode(a.tolist()) == t
    assert "".join(part for _, part in P._parts(" " + texts[0])) == " " + texts[0] and len(list(P._parts(" " + texts[0]))) > 10


def test_whole_table_is_lossless_and_made_of_pieces(spark, lattice):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = P.sampled_pieces(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.lossless and r.n_pieces == len(r.piece_ids or []) and (r.text is None or lattice.decode(r.piece_ids) == r.text)
