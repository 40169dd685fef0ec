import random

import numpy as np

from tracekit.llm import minhash_hamming as M


def brute(rows, width, percent):
    def items(text):
        ws = (text or "").encode().lower().split()
        if not ws:
            return frozenset()
        return frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1)))

    sets = [(i, items(t)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}
    for _ in range(len(label)):
        old = dict(label)
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    return {i: (len(x), label.get(i)) for i, x in sets}


def check(spark, rows, width=2, percent=80, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", M.F.lit(1)).withColumn("n", M.F.lit("x"))
    got = M.near_duplicates(df, width=width, percent=percent, **options).collect()
    assert len(got) == len(rows)
    want = brute(rows, width, percent)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.component_id == r.doc_id)


def test_matches_brute_force_with_edits_chains_and_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    rows, at = [], base
    for i in range(60):  # copies of one original whose edits differ, and a chain that drifts away
        edit = list(base)
        for _ in range(rng.randint(1, 4)):
            edit[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(edit)))
        at = list(at)
        at[rng.randrange(60)] = f"c{i}"
        rows.append((2000 + i, "\t".join(at).upper()))
    rows += [(5, " ".join(base)), (6, " ".join(base)), (None, " ".join(base)), (7, ""), (8, None), (9, " \n "), (10, "One"), (11, "oNE"), (12, "one two"), (13, "é é"), (14, "É é")]
    rows += [(3000 + i, " ".join(f"r{rng.randrange(50)}" for _ in range(12))) for i in range(60)]
    check(spark, rows)


def test_remainder_compares_members_of_different_components(spark):
    """Two originals that share most words: lists hold both groups, one pivot cannot settle them."""
    rng = random.Random(2)
    common = [f"k{i}" for i in range(70)]
    rows = []
    for g in range(3):
        base = common + [f"g{g}x{i}" for i in range(30)]
        for c in range(12):
            edit = list(base)
            for _ in range(c % 5):
                edit[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
            rows.append((g * 100 + c, " ".join(edit)))
    check(spark, rows)


def test_five_words_and_empty_table(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d"), (4, "a b c d"), (5, "a b c")]
    check(spark, rows, width=5)
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_distance_follows_similarity():
    a, b = (" ".join(f"x{i}" for i in r) for r in (range(1000), range(100, 1100)))
    sets, bounds = M.shingle_sets([a, b, None], 1)
    codes = M.signatures(sets, bounds)
    assert bounds.tolist() == [0, 1000, 2000, 2000] and not codes[2].any()
    assert 2 <= np.sum(codes[0] != codes[1]) <= 16  # similarity 0.82


def test_large_components_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rng = random.Random(11)
    rows = []
    for g in range(2):
        base = [f"k{i}" for i in range(60)] + [f"g{g}x{i}" for i in range(40)]
        for c in range(40):
            edit = list(base)
            for _ in range(c % 12):
                edit[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
            rows.append((g * 1000 + (c * 37) % 100, " ".join(edit)))
    check(spark, rows, large=3)


def groups_beside(sizes, seed=13):
    """Groups whose originals share three words in five: lists hold members of all of them."""
    rng, rows = random.Random(seed), []
    for g, n in enumerate(sizes):
        base = [f"k{i}" for i in range(60)] + [f"g{g}x{i}" for i in range(40)]
        for c in range(n):
            edit = list(base)
            for _ in range(1 + c % 5):
                edit[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
            rows.append((g * 1000 + c, " ".join(edit)))
    return rows


def test_components_on_both_sides_of_the_limit_between_the_two_ways(spark):
    check(spark, groups_beside([M.LARGE - 1, M.LARGE, M.LARGE + 1, 3]))


def test_long_lists_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "LIST", 4)
    check(spark, groups_beside([1] * 30 + [2] * 5))


def test_very_long_text_repeated_ids_and_shuffled_chain(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(60_000)]
    long = list(words)
    for i in rng.sample(range(60_000), 1000):
        long[i] = "x"
    rows = [(2, " ".join(words)), (1, " ".join(long))]
    at, ids = [f"a{i}" for i in range(40)], rng.sample(range(100, 1000), 60)
    for i in ids:  # every text is near the next one only, and ids are in no order
        rows.append((i, " ".join(at)))
        at = at[3:] + [f"c{i}x{k}" for k in range(3)]
    check(spark, rows)
    twice = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (5, "q r s t"), (4, "q r s t")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(twice, width=2).collect())
    assert got == [(4, 4, True), (5, 4, False), (5, 5, True), (5, 5, True)]


def by_text(rows, width=2, percent=80):
    """(id, text) -> the smallest id reachable from that text over links of texts, whatever ids they share."""
    one = brute([(k, t) for k, (_, t) in enumerate(rows)], width, percent)
    lowest = {}
    for k, (i, _) in enumerate(rows):
        lowest[one[k][1]] = min(lowest.get(one[k][1], i), i)
    return sorted((i, one[k][0], lowest[one[k][1]]) for k, (i, _) in enumerate(rows))


def repeated(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in M.near_duplicates(df, width=2).collect())
    assert got == by_text(rows)


def test_ids_that_several_texts_share(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 60), ("b", 200)))
    repeated(spark, [(3, f"{a} x"), (5, a), (5, b), (9, f"{b} y")])


def test_random_tables_with_repeated_ids(spark):
    for seed in range(3):
        rng = random.Random(seed)
        texts = []
        for g in range(12):
            base = [f"g{g}w{i}" for i in range(rng.choice([3, 30, 80]))]
            for _ in range(rng.randint(1, 6)):
                edit = list(base)
                if rng.random() < 0.7:
                    edit[rng.randrange(len(edit))] = f"e{rng.randrange(10**6)}"
                texts.append(" ".join(edit))
        repeated(spark, [(rng.randrange(20), t) for t in texts] + [(rng.randrange(20), rng.choice(texts)) for _ in range(20)])


def test_a_member_is_confirmed_with_one_pivot_unless_components_differ(spark, monkeypatch):
    """Copies of one original share many keys with many pivots: one pair a member settles them."""
    rng, counts = random.Random(5), []
    whole = M.confirmed_in_blocks

    def counted(pairs, *args, **kwargs):
        counts.append(pairs.count())
        return whole(pairs, *args, **kwargs)

    monkeypatch.setattr(M, "confirmed_in_blocks", counted)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        edit = list(base)
        for _ in range(rng.randint(2, 4)):
            edit[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(edit)))
    check(spark, rows)
    assert counts[0] <= len(rows), counts


def test_bits_bound_the_shingles_that_only_one_set_has(spark):
    rng, texts = random.Random(1), ["a", "a b"]
    for n in (40, 130, 400, 1500):
        base = [f"w{i}" for i in range(n)]
        for share in (0.0, 0.02, 0.1, 0.5):
            texts += [" ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    odd, sets = M.checkpointed(M.odd_table(docs, 2)), {r.doc_id: set(r["items"]) for r in M.set_table(docs, 2).collect()}
    l, r = (odd.select(M.F.col("doc_id").alias(x), M.F.col("odd").alias(f"{x}odd")) for x in "ab")
    got = {(p.a, p.b): p.d for p in l.crossJoin(r).select("a", "b", M._apart("aodd", "bodd").alias("d")).collect()}
    assert len(got) == len(texts) ** 2
    for (a, b), d in got.items():
        only = len(sets[a] ^ sets[b])
        assert d == got[b, a] and d <= only and d % 2 == only % 2, (a, b)
        if 0.8 <= len(sets[a]) / len(sets[b]) <= 1.25 and only <= 0.3 * len(sets[a]):
            assert d >= 0.7 * only - 8, (a, b, d, only)


def test_a_family_below_the_similarity_makes_no_pairs(spark, monkeypatch):
    """Copies with so many edits that none is linked: their signatures are near, and pairs grew with the square of the family."""
    counts, whole = [], M.confirmed_in_blocks

    def counted(pairs, *args, **kwargs):
        counts.append(pairs.count())
        return whole(pairs, *args, **kwargs)

    monkeypatch.setattr(M, "confirmed_in_blocks", counted)
    rng, rows = random.Random(9), []
    base = [f"w{i}" for i in range(200)]
    for i in range(100):
        edit = list(base)
        for k in rng.sample(range(0, 200, 2), 15):
            edit[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(edit)))
    rows += [(500 + i, f"{t} end") for i, t in rows[:5]]  # and a few that are
    check(spark, rows)
    assert counts[-1] <= len(rows), counts
