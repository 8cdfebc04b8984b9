"""Reply trees to chat training text.

Messages of a conversation form a tree (each names its parent). Iterative self-joins enumerate the root-to-leaf
paths: in round k every known ancestor is joined with the messages 2^k levels above it, so a path of length n takes
log2(n) rounds, and the rows made are exactly the path's messages. Branches are ranked by score, and each chosen
path is formatted as one conversation with a loss mask over the assistant's texts.

Joins are on (conversation, message), so a tree with very many messages is dealt over all tasks; only a path's own
messages meet in one row, the formatted conversation, which is the result's own unit (and holds at most 2 GB). `linear`
numbers the turns of a conversation in a window, so its rows, with their texts, are sorted by one task, which spills what
it can't hold. Rounds are written to the shared folder, so nothing is computed twice.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` per turn. Inside texts and roles `&` becomes `&amp;` and `<|` becomes
`&lt;|` (and a line break in a role `&nl;`), which `parsed` undoes.

Defined cases: null text or role counts as empty; a parent that does not exist makes its message a root; messages
of a cycle are on no path, and a leaf whose way up never ends raises ValueError; conversations without rows do not
appear; an empty table gives no rows. Rows of `linear` with the same turn are put in order of role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_blocks, let, running, stored, stretch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def linear(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Rows by turn as a tree without branches: (conv, node, parent, role, text, score)."""
    order = Window.partitionBy(conv_col).orderBy("turn", "role", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.row_number().over(order).cast("long").alias("node"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.char_length("text").cast("double").alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """(conv, leaf, node, up): every root-to-leaf path, `up` levels above the leaf."""
    ids = stored(nodes.select("conv", "node", "parent"), "reply-nodes")
    known = ids.select(F.col("conv").alias("c"), F.col("node").alias("p"))
    up = stored(
        ids.filter(F.col("parent").isNotNull()).join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p")), "left_semi"), "reply-up"
    )
    has_child = up.select(F.col("conv").alias("c"), F.col("parent").alias("p"))
    leaves = ids.join(has_child, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti")
    found = stored(leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "reply-paths")
    step = 1
    while True:
        above = up.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("parent").alias("a"))
        more = stored(
            found.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv", "leaf", F.col("a").alias("node"), (F.col("up") + step).alias("up")),
            "reply-more",
        )
        if more.isEmpty():
            return found
        if step > ids.count():  # no way up has more messages than there are
            raise ValueError("messages answer each other in a cycle")
        found = found.unionByName(more)
        far = above.select("c", F.col("n").alias("m"), F.col("a").alias("b"))
        up = stored(
            up.join(far, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("m"))).select("conv", "node", F.col("b").alias("parent")), "reply-up"
        )
        step *= 2


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&nl;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def branches(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(conv, leaf, branch, score, turns array<struct<role,text>>): paths in order, ranked by the sum of their scores.

    Ties go to the longer path, then to the smaller leaf id. best: how many branches of a conversation to keep.
    """
    body = nodes.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    rows = paths(nodes).join(body, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    whole = rows.groupBy("conv", "leaf").agg(
        F.sum(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("k"), "role", "text"))).alias("turns"),
    )
    whole = whole.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    ranked = whole.withColumn("branch", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), F.desc(F.size("turns")), "leaf")))
    return ranked if best is None else ranked.filter(F.col("branch") <= best)


def formatted(chosen: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Adds `formatted` and `loss_mask` (array<struct<start,end>>, code points of the formatted text, end exclusive)."""
    turns = F.transform("turns", lambda t: F.struct(F.replace(escaped(t["role"]), F.lit("\n"), F.lit("&nl;")).alias("role"), escaped(t["text"]).alias("text")))
    trained = F.replace(escaped(F.lit(trained_role)), F.lit("\n"), F.lit("&nl;"))

    def mask(ts: Column) -> Column:
        ends = running(F.transform(ts, lambda t: F.char_length(t["role"]) + F.char_length(t["text"]) + len(OPEN) + 1 + len(CLOSE)))
        places = F.zip_with(ts, ends, lambda t, end: F.struct((end - len(CLOSE) - F.char_length(t["text"])).alias("start"), (end - len(CLOSE)).alias("end"), (t["role"] == trained).alias("own")))
        return F.transform(F.filter(places, lambda p: p["own"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))

    text = lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")
    both = let(turns, lambda ts: F.struct(text(ts).alias("formatted"), mask(ts).alias("loss_mask")))
    return chosen.withColumn("_both", both).select("*", "_both.*").drop("_both")


def parsed(texts: DataFrame) -> DataFrame:
    """Reads `formatted` back: adds read_turns array<struct<role,text>> and loss_texts (under the mask), unescaped."""
    blocks = F.split("formatted", r"<\|im_end\|>\n", -1)
    heads = lambda b: F.substring(b, len(OPEN) + 1, F.char_length(b))
    turn = lambda x: F.struct(
        unescaped(F.substring_index(x, "\n", 1)).alias("role"), unescaped(F.substring(x, F.char_length(F.substring_index(x, "\n", 1)) + 2, F.char_length(x))).alias("text")
    )
    turns = F.transform(F.filter(blocks, lambda b: b != ""), lambda b: let(heads(b), turn))
    under = let(in_blocks(F.col("formatted")), lambda blocks: F.transform("loss_mask", lambda m: unescaped(stretch(blocks, m["start"], m["end"]))))
    return texts.withColumn("read_turns", turns).withColumn("loss_texts", under)


def digest(read: DataFrame) -> DataFrame:
    """Figures of what parsed() has read back."""
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
