"""Chat formatting: reply trees to conversations. Joins and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import Scratch

OPEN, OPENED, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    """Without <, so that no text holds a mark; & keeps it reversible."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: conv_id, branch (1 is best), depth, node.

    nodes: conv_id, node, parent, score; node is unique in its conv_id. A path's score is the sum of its nodes' (null: 0);
    branches of a conversation rank by it, then by leaf. A node without parent, or whose parent is missing, is a root.
    Nodes on or below a cycle have no root and are left out. Each self-join doubles the distance to the known ancestor,
    so a path of n nodes takes log2(n) joins up and as many down.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "paths")
    n = nodes.select("conv_id", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("gain"))
    up = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    lift = scratch.keep(
        n.alias("a").join(n.alias("b"), up & (F.col("a.parent") == F.col("b.node")), "left")
        .select("a.conv_id", "a.node", F.col("b.node").alias("over"), "a.gain", F.when(F.col("b.node").isNotNull(), 1).otherwise(0).alias("hops"))
    )
    leaves = lift.alias("a").join(lift.alias("b"), up & (F.col("a.node") == F.col("b.over")), "left_anti").select("conv_id", "node")
    lifts, count = [], lift.count()
    while True:
        going = lift.where("over is not null")  # only these are joined again: nodes whose root isn't reached
        if 2 ** len(lifts) > 2 * count or not going.limit(1).count():
            break
        lifts.append(going)
        farther = going.alias("a").join(lift.alias("b"), up & (F.col("a.over") == F.col("b.node"))).select(
            "a.conv_id", "a.node", F.col("b.over").alias("over"), (F.col("a.gain") + F.col("b.gain")).alias("gain"), (F.col("a.hops") + F.col("b.hops")).alias("hops")
        )
        lift = scratch.keep(farther.union(lift.where("over is null")))
    rooted = lift.where("over is null").select("conv_id", "node", "gain", "hops")
    scored = leaves.alias("l").join(rooted.alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.node") == F.col("r.node"))).select("l.conv_id", "l.node", "gain", "hops")
    ranks = Window.partitionBy("conv_id").orderBy(F.desc("gain"), "node")
    path = scored.withColumn("branch", F.row_number().over(ranks)).where(F.col("branch") <= top).select("conv_id", "branch", "node", F.col("hops").alias("depth"))
    for k in range(len(lifts) - 1, -1, -1):
        path = scratch.keep(path.union(
            path.alias("a").join(lifts[k].alias("b"), up & (F.col("a.node") == F.col("b.node"))).select("a.conv_id", "a.branch", F.col("b.over").alias("node"), (F.col("a.depth") - F.lit(2**k)).alias("depth"))
        ))
    path = path if lifts else scratch.keep(path)
    scratch.only(path)
    return path


def format_reply_trees(nodes: DataFrame, top: int = 1, trained_role: str = "assistant") -> DataFrame:
    """Conversations of the best paths: conv_id, branch, formatted, loss_spans array<struct<start,length>>.

    nodes: conv_id, node, parent, score, role, text; null roles and texts count as empty. Each turn is
    `<turn ROLE>\\nTEXT</turn>\\n`, with &, < and > of role and text as entities. loss_spans are the places of
    trained_role's texts in formatted, in code points from 0. See best_paths for trees without root or leaf.
    """
    path = best_paths(nodes, top)
    turns = path.alias("p").join(nodes.alias("n"), F.col("p.conv_id").eqNullSafe(F.col("n.conv_id")) & (F.col("p.node") == F.col("n.node"))).select(
        "p.conv_id", "p.branch", "p.depth", F.coalesce("n.role", F.lit("")).alias("role"), escape(F.coalesce("n.text", F.lit(""))).alias("body")
    )
    turns = turns.select("conv_id", "branch", F.struct("depth", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(OPENED)).alias("head"), "body", (F.col("role") == trained_role).alias("trained")).alias("t"))
    g = turns.groupBy("conv_id", "branch").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    width = lambda t: F.length(t["head"]) + F.length(t["body"]) + F.lit(len(CLOSE))
    start = F.aggregate(
        "ts",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + width(t)).alias("at"),
            F.when(t["trained"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    formatted = F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return g.select("conv_id", "branch", formatted.alias("formatted"), start["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    parts = F.split(formatted, CLOSE)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), OPENED, 1)).alias("role"), unescape(F.substr(p, F.instr(p, OPENED) + F.lit(len(OPENED)))).alias("text")),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))
