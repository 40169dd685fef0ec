from tracekit.llm import reply_trees as R

SCHEMA = "tree string, node string, parent string, role string, text string, score double"


def test_best_branch_of_a_tree(spark):
    rows = [("t", "a", None, "user", "hi", 1.0), ("t", "b", "a", "assistant", "low", 0.1), ("t", "c", "a", "assistant", "high", 0.9), ("t", "d", "c", "user", "more <|end|>\n\\", 0.5), ("u", "x", "gone", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.tree, r.branch): r for r in R.read_back(R.format_trees(df, branches=5)).collect()}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1)}
    assert [tuple(t) for t in got["t", 1].turns] == [("user", "hi"), ("assistant", "high"), ("user", "more <|end|>\n\\")]
    assert got["t", 1].loss_text == "high" and got["t", 2].loss_text == "low"
    assert [tuple(t) for t in got["u", 1].turns] == [("", "")]
    assert got["t", 1].formatted.count("<|end|>") == 3


def test_paths_of_a_long_chain_and_a_bush(spark):
    n = 150
    rows = [("c", f"c{i}", f"c{i - 1}" if i else None) for i in range(n)] + [("b", f"b{i}", f"b{(i - 1) // 2}" if i else None) for i in range(31)]
    got = R.paths(spark.createDataFrame(rows, "tree string, node string, parent string")).collect()
    chain = [r for r in got if r.tree == "c"]
    assert len(chain) == n and {r.up for r in chain} == set(range(n)) and {r.leaf for r in chain} == {f"c{n - 1}"}
    assert len([r for r in got if r.tree == "b"]) == 16 * 5


def test_escape_round_trip(spark):
    texts = ["", "\\", "<|turn|>user\n", "</s>[INST]<<SYS>>\\<|", "<\\|", "a\nb", "\\\\[INST]", "é\U0001f600</s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.escaped(R.F.col("t")).alias("e"))
    for r in df.withColumn("back", R.unescaped(R.F.col("e"))).collect():
        assert r.back == r.t
        assert not any(c in r.e for c in R.CONTROLS)


def test_chat_digest_of_ties_nulls_and_odd_roles(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", "x\\"), (2, None, None, "t"), (None, 0, "a\nb", "z"), (None, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in R.chat_digest(spark, df).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 3, 2: 1, None: 2, -1: 2}
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nuser\n\nassistant\nx\\\n") and got[1].loss_sha256 == sha("x\\")
    assert got[None].turns_sha256 == sha("a\nb\nz\nassistant\n\n")
    assert got[-1].loss_sha256 == sha(R.PROBE) and got[-1].loss_chars == len(R.PROBE)
    assert {r.conv_id for r in R.chat_digest(spark, df.limit(0)).collect()} == {-1}


def test_trees_may_number_their_messages_alike_and_cycles_end(spark):
    rows = [("t", "1", None, "user", "a", 1.0), ("t", "2", "1", "assistant", "b", 1.0), ("u", "1", None, "user", "c", 1.0), ("u", "2", "1", "assistant", "d", 1.0)]
    rows += [("v", "1", "2", "user", "x", 1.0), ("v", "2", "1", "user", "y", 1.0), ("v", "3", "2", "user", "below", 1.0), ("v", "4", None, "user", "root", 1.0), ("w", "1", "1", "user", "self", 1.0)]
    rows += [(None, "1", None, "user", "n", None), (None, "2", "1", "assistant", "m", None), ("t", None, "1", "user", "lost", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("up", R.F.lit(7)).withColumn("branch", R.F.lit("x")).withColumn("o_tree", R.F.lit("y"))
    got = {r.tree: [tuple(t) for t in r.turns] for r in R.read_back(R.format_trees(df)).collect()}
    assert got == {"t": [("user", "a"), ("assistant", "b")], "u": [("user", "c"), ("assistant", "d")], "v": [("user", "root")], None: [("user", "n"), ("assistant", "m")]}


def test_repeated_messages_count_once(spark):
    rows = [("t", "1", None, "user", "b", 1.0), ("t", "1", None, "user", "a", 1.0), ("t", "2", "1", "assistant", "c", 0.5), ("t", "2", "1", "assistant", "c", 0.5)]
    got = R.read_back(R.format_trees(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 1 and [tuple(t) for t in got[0].turns] == [("user", "a"), ("assistant", "c")] and got[0].loss_text == "c"


def test_long_texts_and_many_turns(spark):
    rows = [("t", f"{i:05d}", f"{i - 1:05d}" if i else None, "assistant" if i % 2 else "user", "x" * (i % 50) + ("é" * 300_000 if i == 7 else ""), 1.0) for i in range(1500)]
    got = R.read_back(R.format_trees(spark.createDataFrame(rows, SCHEMA))).first()
    assert [t.text for t in got.turns] == [r[4] for r in rows]
    assert got.loss_text == "".join(r[4] for r in rows[1::2])


def test_a_long_spine_with_side_leaves(spark, monkeypatch):
    """A tree whose paths are together quadratic in its nodes: no table holds more than a few rows a node."""
    import random

    rng = random.Random(2)
    n = 600  # 180,000 rows if every path were listed
    rows = []
    for i in range(n):
        rows.append((1, 2 * i, 2 * i - 2 if i else None, "user", f"s{i}", rng.choice([0.25, 0.5, 1.0])))
        rows.append((1, 2 * i + 1, 2 * i, "assistant", f"l{i}", rng.choice([0.25, 0.5, 2.0])))
    parent, score = {r[1]: r[2] for r in rows}, {r[1]: r[5] for r in rows}
    means = {}
    for leaf in set(parent) - set(parent.values()):
        at, held = leaf, []
        while at is not None:
            held.append(score[at])
            at = parent[at]
        means[leaf] = sum(held) / len(held)
    want = sorted(means, key=lambda x: (-means[x], x))[:3]
    largest, real = [0], R.checkpointed

    def counted(df):
        out = real(df)
        largest[0] = max(largest[0], out.count())
        return out

    monkeypatch.setattr(R, "checkpointed", counted)
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = R.format_trees(df, branches=3).orderBy("branch").collect()
    assert [r.leaf for r in got] == want
    assert largest[0] <= 2 * n + 3 * n
