"""Chat formatting of reply trees, with DataFrame functions alone.

A tree's nodes have an id, a parent, a role, a text and a score. Iterative self-joins double the
reach of each node's pointer to its ancestors, so paths of n nodes take about log2(n) joins; the
same joins list the nodes on the path of every leaf. A branch's rank comes from the mean score of
its nodes; each chosen path becomes one conversation.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts every
backslash is doubled and the first character of a control string is followed by a backslash, so
no control string of CONTROLS is left and the change can be undone.

Null text and null role are empty. Rows of equal turns are taken in the order of role and text, null
first, and repeated rows stay turns of their own. A node whose parent is missing is a root. Nodes on
a cycle raise an error. An empty table gives an empty table. Other columns of the
input are ignored. A null conversation id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import cut_lineage, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: The template's own marks and those of widespread chat formats.
CONTROLS = [TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _literal(text: str) -> str:
    return "".join("\\" + c if c in "|[]()<>/\\" else c for c in text)


_CONTROL = "|".join(f"(?={_literal(c)})." for c in CONTROLS)


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_chain(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Nodes of a table of turns: every turn replies to the one before it. Columns tree, node, parent, role, text, score."""
    order = Window.partitionBy("tree").orderBy(F.col("__turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col(conversation).cast("long").alias("tree"), F.col(turn).alias("__turn"), "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """tree, leaf, node, up (steps from the leaf) for each node on the way from every leaf to its root."""
    same = F.col("a.tree").eqNullSafe(F.col("b.tree"))
    links = nodes.select("tree", "node", "parent")
    jump = links.alias("a").join(links.alias("b"), same & (F.col("a.parent") == F.col("b.node")), "left").select("a.tree", "a.node", F.col("b.node").alias("to"))
    jump = cut_lineage(jump)
    parents = jump.where("`to` is not null").select("tree", F.col("to").alias("node")).distinct()
    leaves = jump.select("tree", "node").alias("a").join(parents.alias("b"), same & (F.col("a.node") == F.col("b.node")), "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    step = 1
    jump = jump.where("`to` is not null")
    while not jump.isEmpty():
        more = found.alias("a").join(jump.alias("b"), same & (F.col("a.node") == F.col("b.node"))).select("a.tree", "a.leaf", F.col("b.to").alias("node"), (F.col("a.up") + step).alias("up"))
        found = cut_lineage(found.unionByName(more))
        jump = cut_lineage(jump.alias("a").join(jump.alias("b"), same & (F.col("a.to") == F.col("b.node"))).select("a.tree", "a.node", F.col("b.to").alias("to")))
        step *= 2
        if step > 1 << 24:
            raise ValueError("a node is its own ancestor")
    return found


def best_branches(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The nodes of each tree's ``branches`` best paths, with tree, leaf, branch (rank from 1), place (from the root).

    Branches are ranked by scores alone; roles and texts join the chosen paths only.
    """
    steps = paths(nodes)
    here = F.col("p.tree").eqNullSafe(F.col("n.tree")) & (F.col("p.node") == F.col("n.node"))
    scored = steps.alias("p").join(nodes.select("tree", "node", "score").alias("n"), here).select("p.tree", "p.leaf", "n.score")
    ranked = scored.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    branch = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))
    chosen = ranked.withColumn("branch", branch).where(F.col("branch") <= branches).alias("c")
    match = F.col("f.tree").eqNullSafe(F.col("c.tree")) & (F.col("f.leaf") == F.col("c.leaf"))
    kept = steps.alias("f").join(chosen, match).select("f.tree", "f.leaf", "c.branch", "f.node", "f.up")
    return kept.alias("p").join(nodes.alias("n"), here).select("p.tree", "p.leaf", "p.branch", "p.up", "n.role", "n.text")


def format_paths(steps: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """One row per path: tree, leaf, branch, formatted, and loss_spans (begin and length in code points of the texts to learn)."""
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    part = F.struct(
        F.col("up"), F.concat(head, text, F.lit(END)).alias("out"), F.length(head).cast("long").alias("skip"), F.length(text).cast("long").alias("n"), (F.col("role") == learn_from).alias("loss")
    )
    rows = steps.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(part), lambda a, b: F.when(a["up"] > b["up"], -1).when(a["up"] < b["up"], 1).otherwise(0)).alias("parts"))
    tail = len(END)
    # each turn begins where the lengths of those before it end
    begin = F.expr(
        f"aggregate(parts, named_struct('at', 0L, 'spans', cast(array() as array<struct<begin:bigint,length:bigint>>)), "
        f"(s, p) -> named_struct('at', s.at + p.skip + p.n + {tail}L, 'spans', if(coalesce(p.loss, false), concat(s.spans, array(named_struct('begin', s.at + p.skip, 'length', p.n))), s.spans)), s -> s.spans)"
    )
    return rows.select("tree", "leaf", "branch", F.concat_ws("", F.transform("parts", lambda p: p["out"])).alias("formatted"), begin.alias("loss_spans"))


def format_trees(nodes: DataFrame, branches: int = 1, learn_from: str = "assistant") -> DataFrame:
    return format_paths(best_branches(nodes, branches), learn_from)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of role and text."""
    parts = F.filter(F.split(formatted, _literal(TURN)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring_index(p, TEXT, 1)).alias("role"),
            unescaped(F.regexp_replace(F.regexp_replace(p, "(?s)^.*?" + _literal(TEXT), ""), _literal(END) + "$", "")).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, end to end."""
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["begin"] + 1).cast("int"), s["length"].cast("int")))))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(probe).alias("text")), F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(probe).alias("text")))).alias("r")).select("r.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = format_trees(reply_chain(turns)).select("tree", "formatted", "loss_spans")
    read = done.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
