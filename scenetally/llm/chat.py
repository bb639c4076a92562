"""Chat formatting of reply trees, with DataFrame operations only.

Branches. Every node points to its parent; iterative self-joins double the pointers, so root-to-leaf paths of depth d take
log2(d) rounds and no array grows along the way. A branch is ranked by the mean score of its nodes; of each tree the best
``n_best`` leaves are chosen (ties: smallest leaf) and their paths are enumerated by the same pointers, largest jump
first. The turns of one path become one conversation; this is the only thing that is gathered into a row.

Template. A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled, then ``<|``
becomes ``<\\|`` and, in roles, a line end becomes ``<\\~``, so no control string survives and all is reversible. The loss
mask holds, for each turn, start and length in code points within the turn; the length is 0 but for assistant texts.

Defined results: null text, role and score are empty, empty and 0; a node whose parent is absent is a root; a node with
null id is in no tree; of rows that repeat a node id the smallest (parent, role, text) counts; nodes on a cycle and below
are in no conversation; a null tree id is a tree like others; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetally.llm.common import keep
from scenetally.operators.ordered import positions

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: Column, line_end: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("<\\~")) if line_end else out


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("<\\~"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations of numbered turns as trees without branches: (tree, node, parent, role, text, score)."""
    rows = turns.select(
        F.col(conv_col).alias("tree"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    placed = positions(rows, ["tree"], ["turn", "role", "text"], "node")
    return placed.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def branches(nodes: DataFrame, n_best: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes with their depth, and (tree, leaf, node, branch_score) of every node on a chosen path."""
    own = keep(
        nodes.where("node is not null")
        .groupBy("tree", "node")
        .agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("r"))
        .select("tree", "node", "r.*")
    )
    same_tree = F.col("tree").eqNullSafe(F.col("_tree"))
    parents = own.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    known = own.join(parents, same_tree & (F.col("parent") == F.col("_node")), "left")
    state = keep(
        known.select("tree", "node", F.col("_node").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    )
    jumps, before = [], None
    ended, waiting = state.where("up is null"), state.where("up is not null")
    while True:
        open_ = waiting.count()
        if open_ == 0 or open_ == before:  # what no longer gets shorter runs in a circle
            break
        jumps.append(waiting.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "up"))
        before = open_
        above = ended.union(waiting).select(
            F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"),
            F.col("steps").alias("_steps"), F.col("total").alias("_total"),
        )
        # only nodes that have not met their root take part
        further = keep(
            waiting.join(above, same_tree & (F.col("up") == F.col("_node"))).select(
                "tree",
                "node",
                F.col("_up").alias("up"),
                (F.col("steps") + F.col("_steps")).alias("steps"),
                (F.col("total") + F.col("_total")).alias("total"),
            )
        )
        ended, waiting = ended.union(further.where("up is null")), further.where("up is not null")
    rooted = ended.select("tree", "node", F.col("steps").alias("depth"), (F.col("total") / F.col("steps")).alias("branch_score"))
    inner = own.select(F.col("tree").alias("_tree"), F.col("parent").alias("_node")).where("_node is not null").distinct()
    leaves = rooted.join(inner, same_tree & (F.col("node") == F.col("_node")), "left_anti")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), F.col("node")))
    path = leaves.withColumn("_rank", rank).where(F.col("_rank") <= n_best).select("tree", F.col("node").alias("leaf"), "node", "branch_score")
    for jump in reversed(jumps):
        met = path.join(jump, same_tree & (F.col("node") == F.col("_node")), "left")
        both = F.expr("filter(array(node, up), x -> x is not null)")
        path = met.select("tree", "leaf", "branch_score", F.explode(both).alias("node"))
    depth = rooted.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "depth")
    placed = own.join(depth, same_tree & (F.col("node") == F.col("_node"))).drop("_tree", "_node")
    return placed, path


def formatted(nodes: DataFrame, n_best: int = 1) -> DataFrame:
    """(tree, leaf, branch_score, formatted, loss) of each chosen branch; loss: array of (start, length) by turn."""
    placed, path = branches(nodes, n_best)
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), line_end=True), F.lit("\n"))
    text = escaped(F.col("text"))
    turns = placed.select(
        F.col("tree").alias("_tree"),
        F.col("node").alias("_node"),
        "depth",
        F.concat(head, text, F.lit(f"{CLOSE}\n")).alias("block"),
        F.when(F.col("role") == "assistant", F.length(head)).otherwise(0).alias("start"),
        F.when(F.col("role") == "assistant", F.length(text)).otherwise(0).alias("length"),
    )
    rows = path.join(turns, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node")))
    return (
        rows.groupBy("tree", "leaf", "branch_score")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "block", "start", "length"))).alias("turns"))
        .select(
            "tree",
            "leaf",
            "branch_score",
            F.array_join(F.col("turns.block"), "").alias("formatted"),
            F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
        )
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds turns (role, text) and the text under the loss mask, both from the formatted text and its mask."""
    blocks = F.expr(r"slice(split(formatted, '<\\|im_start\\|>', -1), 2, size(loss))")
    split = conversations.withColumn("_blocks", F.arrays_zip(blocks.alias("block"), F.col("loss").alias("mask")))

    def turn(b: Column) -> Column:
        role = F.substring_index(b["block"], "\n", 1)
        skip = F.length(role) + 1
        text = b["block"].substr(skip + 1, F.length(b["block"]) - skip - len(CLOSE) - 1)
        covered = F.concat(F.lit(OPEN), b["block"]).substr(b["mask"]["start"] + 1, b["mask"]["length"])
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"), unescaped(covered).alias("loss"))

    return (
        split.withColumn("turns", F.transform("_blocks", turn))
        .withColumn("loss_text", F.array_join(F.col("turns.loss"), ""))
        .drop("_blocks")
    )


def report(conversations: DataFrame) -> DataFrame:
    """Digest columns of formatted conversations, read back from the output."""
    back = read_back(conversations)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
