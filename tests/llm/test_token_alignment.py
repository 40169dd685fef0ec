"""Cross-tokenizer alignment against a plain version that tokenises whole texts, and its defined cases."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracekit.llm import token_alignment as ta

SCHEMA = "doc_id long, text string"


class Plain:
    """Both models by their own libraries, whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(ta.MODEL_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=ta.MODEL_B)
        self.letters = ta.byte_letters()

    def tokens(self, text):
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (a, b) if text and b"".join(t for _, t in a) == want == b"".join(t for _, t in b) else ([], [])

    def measures(self, rows):
        spans, held = [], Counter()
        for _, text in rows:
            sides = []
            for side in self.tokens(text) if text else ([], []):
                at, out = 0, []
                for i, t in side:
                    out.append((at, at + len(t), i))
                    at += len(t)
                sides.append(out)
            spans.append(sides)
            links, k = [], 0
            for x in sides[0]:
                while k and sides[1][k - 1][1] > x[0]:
                    k -= 1
                while k < len(sides[1]) and sides[1][k][0] < x[1]:
                    if sides[1][k][1] > x[0]:
                        links.append((x[2], sides[1][k][2]))
                    k += 1
            sides.append(links)
            held.update(set(links))
        best = Counter()
        for (a, _), n in held.items():
            best[a] = max(best[a], n)
        out = []
        for (doc_id, _), (a, b, links) in zip(rows, spans, strict=True):
            ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
            cut = lambda side, low, high: ",".join(str(i) for s, e, i in side if low <= s and e <= high)
            if len(ends) < 300:
                groups = ";".join(f"{cut(a, low, high)}|{cut(b, low, high)}" for low, high in zip([0, *ends], ends, strict=False))
            else:
                groups = self._groups(a, b, ends)
            out.append((doc_id, len(a), len(b), len(ends), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
        return out

    @staticmethod
    def _groups(a, b, ends):
        out, i, j = [], 0, 0
        for e in ends:
            parts = [[], []]
            while i < len(a) and a[i][1] <= e:
                parts[0].append(str(a[i][2]))
                i += 1
            while j < len(b) and b[j][1] <= e:
                parts[1].append(str(b[j][2]))
                j += 1
            out.append("|".join(",".join(p) for p in parts))
        return ";".join(out)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def in_order(rows):
    return sorted(rows, key=repr)


def same(spark, plain, rows, n=3):
    got = [tuple(r) for r in ta.alignment(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()]
    assert in_order(got) == in_order(plain.measures(rows))


def test_whole_table(spark, plain):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = ta.alignment(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain.measures(rows))


def test_spaces_scripts_and_special_strings(spark, plain):
    texts = ["a  b\n c", " lead", "trail \n", "trail ", "\n", " ", "   ", "x  y", "x  y", "a\n  b", "<|endoftext|> </s><s>", "<0x0A>", "naïve café ß", "中文没有空格的一段话", "日本語 の 文", "emoji 👩‍👩‍👧 x", "tab\tand\x0bvt\x0c",
             "can't won't I'LL", "a\x1cb \x1c c", "᠎  y", "x　 y", "100 000,50", "literal ▁ mark", "▁", "nul\x00byte", "a  b", "  ▁x"]
    same(spark, plain, [*enumerate(texts), (90, None), (91, ""), (None, "null id"), (92, "again again"), (92, "again again"), (None, None), (None, None)])


def test_random_strings(spark, plain):
    rng = random.Random(5)
    letters = [" ", " ", " ", "\n", "\t", "a", "b", "the", "ing", "1", "2", ".", "'s", "é", "ß", "ж", "中", "文", "👍", "́", " ", " ", "﻿", "-", "_", "▁"]
    rows = [(i, "".join(rng.choices(letters[: rng.choice([8, 20, 25, 26])], k=rng.randint(0, 60)))) for i in range(400)]
    same(spark, plain, rows + rows[:50])


def test_counts_follow_copies_and_company(spark, plain):
    rows = [(i, "the same copy") for i in range(300)] + [(1000 + i, f"the other {i % 7} copy") for i in range(60)]
    same(spark, plain, rows)
    table = {(r.a_id, r.b_id): r for r in ta.pair_table(ta.aligned(ta.distinct_texts(spark.createDataFrame(rows, SCHEMA)), ta.read_models())).collect()}
    assert max(r.n_docs for r in table.values()) == 360 and all(r.best for r in table.values() if r.n_docs == 360)


def test_very_long_texts(spark, plain):
    rows = [(1, "word " * 60_000 + "中" * 20_000), (2, "x" * 50_000), (3, "short")]
    same(spark, plain, rows)


def test_blocks_and_forgetting_change_nothing(monkeypatch):
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text <> ''").fetchall()
    texts, one = [r[0] for r in rows], np.ones(1, np.int64)
    own = ta.Aligner(*ta.read_models())
    whole = own.align(texts, np.ones(len(texts), np.int64))
    monkeypatch.setattr(ta, "CHUNKS", 100)
    alone = [own.align([t], one) for t in texts]
    assert (np.concatenate([x["counts"] for x in alone]) == whole["counts"]).all()
    assert [x["groups"][0] for x in alone] == whole["groups"]


def test_other_vocabularies_go_by_the_library(plain):
    """Merges out of the order of ids: the tokenizers library encodes, with equal results."""
    import json

    a, b = ta.read_models()
    spec = json.loads(a)
    own = ta.Aligner(a, b)
    spec["model"]["merges"][-2:] = reversed(spec["model"]["merges"][-2:])  # the order is no longer that of the ids
    other = ta.Aligner(json.dumps(spec), b)
    assert other.a_encode != own.a_encode
    text = "The other words, 12 of them, aren't  here."
    assert list(other.a_encode(text)) == list(own.a_encode(text))


def test_empty_extra_columns_and_groups(spark, plain):
    assert ta.alignment(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "to be or", 5, "b", 2.0)], SCHEMA + ", n long, block string, pair double")
    r = ta.alignment(df, with_groups=True).first()
    assert hashlib.sha256(r["groups"].encode()).hexdigest() == r.groups_sha256
    a, b = plain.tokens("to be or")
    assert [i for g in r["groups"].split(";") for i in g.split("|")[0].split(",")] == [str(i) for i, _ in a]
    assert [i for g in r["groups"].split(";") for i in g.split("|")[1].split(",")] == [str(i) for i, _ in b]
