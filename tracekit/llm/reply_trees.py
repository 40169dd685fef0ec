"""Chat formatting over reply trees.

Messages form trees through ``parent``; a message is named by its tree and its number or name there. Root-to-leaf paths are
enumerated by iterative self-joins that double the distance: jump tables (node -> ancestor 2^k above, with the sum of the scores
between) are built while any node has one. Branches of a tree are ranked by the mean score of their messages (ties: the
smaller leaf), which one row a leaf adds up over its jumps; the (leaf, node) rows of the chosen paths are then filled from the
largest jump down. The number of joins is three times the logarithm of the deepest path, rows never exceed the nodes or the
length of the chosen paths, and texts join only those.

A node with an ancestor as many steps above as its tree has nodes lies on a cycle or hangs below one, so the rounds end
there, whatever the table holds.

The template marks every turn with ``<|turn|>role\n`` and ``<|end|>\n``. Inside roles and texts a backslash is doubled
and every control string gets a backslash after its first character, so no control string can occur there and
dropping one backslash per pair restores the text. The loss mask lists the spans of assistant texts.

Defined cases: null role or text is empty; a null tree is one tree; a null node belongs to no path; a message whose parent
is missing is a root; rows of a cycle, or below one, belong to no path; of repeated (tree, node) rows the smallest parent,
the largest score and the smallest (role, text) count; a null score is 0; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpointed, offsets, written

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Strings that chat templates use as controls, apart from our own ``<|``.
CONTROLS = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<pad>", "<unk>"]


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _beside(rows: DataFrame, other: DataFrame, node: str = "node") -> Column:
    """Equality of tree and node with a table whose columns are called ``o_tree`` and ``o_node``."""
    return rows["tree"].eqNullSafe(other["o_tree"]) & (rows[node] == other["o_node"])


def climbs(nodes: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``nodes(tree, node, parent, score)`` -> (nodes, each once; the leaves whose path ends at a root; jump tables).

    Table k has the nodes with an ancestor 2^k steps above: that ancestor ``over`` and ``total``, the scores of the 2^k nodes from this one
    up to below it. Each comes from a self-join of the one before.
    """
    nodes = checkpointed(nodes.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.coalesce(F.max("score"), F.lit(0)).cast("double").alias("score")))
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    known = nodes.select(F.col("tree").alias("o_tree"), F.col("node").alias("o_node"))
    children = nodes.where("parent IS NOT NULL")
    jump = checkpointed(children.join(known, _beside(children, known, "parent"), "left_semi").select("tree", "node", F.col("parent").alias("over"), F.col("score").alias("total")))
    parents = jump.select(F.col("tree").alias("o_tree"), F.col("over").alias("o_node")).distinct()
    leaves = nodes.join(parents, _beside(nodes, parents), "left_anti").select("tree", F.col("node").alias("leaf"))
    jumps: list[DataFrame] = []
    while jump.limit(1).count():
        if 1 << len(jumps) >= most:  # no path is that long: what is left runs into a cycle
            endless = jump.select(F.col("tree").alias("o_tree"), F.col("node").alias("o_node"))
            leaves = leaves.join(endless, _beside(leaves, endless, "leaf"), "left_anti")
            break
        jumps.append(jump)
        again = jump.select(F.col("tree").alias("o_tree"), F.col("node").alias("o_node"), F.col("over").alias("far"), F.col("total").alias("more"))
        jump = checkpointed(jump.join(again, _beside(jump, again, "over")).select("tree", "node", F.col("far").alias("over"), (F.col("total") + F.col("more")).alias("total")))
    return nodes, leaves, jumps


def filled(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``leaves(tree, leaf)`` -> ``(tree, leaf, node, up)``: the nodes of each leaf's path to its root, ``up`` steps above it."""
    rows = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, table in reversed(list(enumerate(jumps))):
        step = table.select(F.col("tree").alias("o_tree"), F.col("node").alias("o_node"), "over")
        above = rows.join(step, _beside(rows, step)).select("tree", "leaf", F.col("over").alias("node"), (F.col("up") + F.lit(1 << k)).alias("up"))
        rows = checkpointed(rows.unionByName(above))
    return rows


def paths(nodes: DataFrame) -> DataFrame:
    """``nodes(tree, node, parent)`` -> ``(tree, leaf, node, up)``: the nodes of every root-to-leaf path, as many rows as all paths are long."""
    _, leaves, jumps = climbs(nodes.withColumn("score", F.lit(0.0)))
    return filled(leaves, jumps)


def path_means(nodes: DataFrame, leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, mean): the mean score of each leaf's path. One row a leaf climbs by the largest jumps first and adds up their totals;
    the nodes between are not listed."""
    rows = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0.0).alias("sum"), F.lit(1).cast("long").alias("n"))
    for k, table in reversed(list(enumerate(jumps))):
        step = table.select(F.col("tree").alias("o_tree"), F.col("node").alias("o_node"), "over", "total")
        rows = rows.join(step, _beside(rows, step), "left").select("tree", "leaf", F.coalesce("over", "node").alias("node"), (F.col("sum") + F.coalesce("total", F.lit(0.0))).alias("sum"), (F.col("n") + F.when(F.col("over").isNotNull(), 1 << k).otherwise(0)).alias("n"))
    top = nodes.select(F.col("tree").alias("o_tree"), F.col("node").alias("o_node"), "score")
    return rows.join(top, _beside(rows, top)).select("tree", "leaf", ((F.col("sum") + F.col("score")) / F.col("n")).alias("mean"))


def ranked_branches(means: DataFrame, branches: int) -> DataFrame:
    """The ``branches`` best leaves of each tree: tree, leaf, branch (rank from 1), mean."""
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))
    return means.withColumn("branch", rank).where(F.col("branch") <= branches)


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``messages(tree, node, parent, role, text, score)`` -> one conversation for each of the ``branches`` best paths of a tree.

    Returns tree, leaf, branch (rank from 1), formatted and loss, an array of (start, end) code points of assistant texts.
    """
    nodes, leaves, jumps = climbs(messages.select("tree", "node", "parent", "score"))
    best = checkpointed(ranked_branches(path_means(nodes, leaves, jumps), branches).select("tree", "leaf", "branch"))
    on_path = filled(best.select("tree", "leaf"), jumps)
    ranks = best.select(F.col("tree").alias("o_tree"), F.col("leaf").alias("o_node"), "branch")
    chosen = on_path.join(ranks, _beside(on_path, ranks, "leaf")).select("tree", "leaf", "branch", "node", "up")
    said = messages.select(F.col("tree").alias("o_tree"), F.col("node").alias("o_node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = chosen.join(said, _beside(chosen, said))
    header = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    turn = F.struct((-F.col("up")).alias("at"), F.col("role").alias("role"), F.col("text").alias("text"), header.alias("head"), escaped(F.col("text")).alias("body"))
    made = chosen.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    made = made.select("tree", "leaf", "branch", F.filter("all", lambda t, i: (i == 0) | (t["at"] != F.get("all", i - 1)["at"])).alias("turns"))
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)
    places = offsets(F.transform("turns", size))
    spans = F.zip_with("turns", places, lambda t, at: F.struct((at + F.length(t["head"])).cast("int").alias("start"), (at + F.length(t["head"]) + F.length(t["body"])).cast("int").alias("end"), (t["role"] == "assistant").alias("learn")))
    loss = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return made.select("tree", "leaf", "branch", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns, an array of (role, text), and loss_text, both read from the formatted string and its mask."""
    pieces = F.split("formatted", F.lit(r"\Q" + CLOSE + r"\E"), -1)
    head = r"(?s)^((?:[^\\\n]++|\\.)*+)\n"
    turn = lambda p: F.struct(
        unescaped(F.substring(F.regexp_extract(p, head, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"),
        unescaped(F.regexp_replace(p, head, "")).alias("text"),
    )
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumn("turns", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)).withColumn("loss_text", F.array_join(masked, ""))


def chains(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: every row answers the row before it (ties: by role, then text)."""
    said = rows.select(F.col(tree).alias("tree"), F.col(order).alias("order"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("order", "role", "text"))
    numbered = said.select("tree", node.alias("node"), "role", "text")
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


#: Conversation -1: control strings as plain text.
PROBE = "</s>[INST] ok [/INST]"


def threads(messages: DataFrame) -> DataFrame:
    """The same messages as threads in which two rows answer each one (row n answers row n / 2), branches ranked by mean length.

    tree, thread_branches (how many), thread_leaf and thread_mean of the best one.
    """
    nodes = messages.select("tree", "node", F.when(F.col("node") > 1, F.floor(F.col("node") / 2).cast("int")).alias("parent"), F.length("text").alias("score"))
    nodes, leaves, jumps = climbs(nodes)
    means = checkpointed(path_means(nodes, leaves, jumps))
    best = ranked_branches(means, 1).select(F.col("tree").alias("t_tree"), F.col("leaf").alias("thread_leaf"), F.col("mean").alias("thread_mean"))
    count = means.groupBy("tree").agg(F.count(F.lit(1)).alias("thread_branches"))
    return count.join(best, F.col("tree").eqNullSafe(F.col("t_tree"))).select("t_tree", "thread_branches", F.col("thread_leaf").cast("long").alias("thread_leaf"), "thread_mean")


def chat_digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The contract columns, read back from the formatted conversations, and the ranked branches of ``threads``."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    messages = written(chains(rows))  # paths read its ids only
    out = read_back(format_trees(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = out.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    return digest.join(threads(messages), F.col("conv_id").eqNullSafe(F.col("t_tree")), "left").drop("t_tree")


ORACLE = r"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) AS n,
  (length(text) - length(replace(text, '<|', ''))) // 2 + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '<s>', ''))) // 3
  + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
  + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8
  + (length(text) - length(replace(text, '<pad>', ''))) // 5 + (length(text) - length(replace(text, '<unk>', ''))) // 5 AS marks FROM r),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(8 + length(role) + 1 + n + marks + 8) AS formatted FROM e GROUP BY conv_id),
num AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, length(text) AS s, count(*) OVER (PARTITION BY conv_id) AS total FROM r),
walk AS (SELECT conv_id, n AS leaf, n FROM num WHERE 2 * n > total UNION ALL SELECT conv_id, leaf, n // 2 FROM walk WHERE n > 1),
means AS (SELECT conv_id, leaf, sum(s) / count(*) AS mean FROM walk JOIN num USING (conv_id, n) GROUP BY conv_id, leaf),
thread AS (SELECT conv_id, count(*) AS branches, arg_max(leaf, (mean, -leaf)) AS leaf, max(mean) AS mean FROM means GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars,
  CAST(branches AS BIGINT) AS thread_branches, CAST(thread.leaf AS BIGINT) AS thread_leaf, CAST(thread.mean AS DOUBLE) AS thread_mean FROM g JOIN thread USING (conv_id)
"""
