"""Reply trees: root-to-leaf paths by iterative self-joins, ranked, and written as one conversation each.

Every node points at its parent. In each round of the first part pointers double: a node whose pointer has not passed a root takes over the pointer of the node that it points
at. So a tree of depth d needs about log2(d) self-joins of narrow rows, each written to the shared folder. A leaf is a node that is nobody's parent; its path is
a branch. The second part walks these tables from the leaves: a path known up to 2**k nodes joins the k-th table, which gives the next 2**k. Only leaves carry paths, as rows (leaf, node,
steps from the leaf), so the work is that of the paths themselves.

Branches of a tree are ranked by the mean score of their nodes (added root first), highest first, then by lower leaf. Defined cases: a
row whose tree or node is null is dropped. Of rows that repeat a (tree, node), the one with the highest score,
then the least parent, role and text, stands. A parent that is null, or that its tree does not hold, makes a root. Nodes on
or below a cycle reach no root and are dropped. A null score counts 0, a null role as 'unknown', a null text as empty. An empty
table gives no rows. Extra columns are ignored. Trees of any depth and texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table

TOP = 2


def paths(nodes: DataFrame) -> DataFrame:
    """nodes: tree, node, parent, one row each. Result: tree, leaf, node, up (steps from the leaf), of every node of every branch."""
    known = nodes.select("tree", F.col("node").alias("parent"), F.col("node").alias("up"))
    now = as_table(nodes.select("tree", "node", "parent").join(known, ["tree", "parent"], "left").select("tree", "node", "up"), "replies-up")
    tables, open_before = [], None
    while True:
        still_open = now.where("up is not null").count()
        if not still_open or still_open == open_before:
            break
        open_before = still_open
        tables.append(now.where("up is not null"))
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        now = as_table(now.join(above, ["tree", "up"], "left").select("tree", "node", F.col("next").alias("up")), "replies-up")
    rooted = now.where("up is null").select("tree", "node")  # what still points somewhere is on or below a cycle
    parents = tables[0].select("tree", F.col("up").alias("node")).distinct() if tables else None
    leaves = rooted.join(parents, ["tree", "node"], "left_anti") if tables else rooted
    found = as_table(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")), "replies-paths")
    for k, table in enumerate(tables):
        higher = found.join(table.withColumnRenamed("up", "next"), ["tree", "node"]).select("tree", "leaf", F.col("next").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = as_table(found.unionByName(higher), "replies-paths")
    return found


def conversations(rows: DataFrame, top: int | None = TOP, tree_col: str = "tree", node_col: str = "node", parent_col: str = "parent", role_col: str = "role", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The `top` best branches of each tree (all if None): tree, rank, leaf, depth, score, conversation."""
    rows = rows.select(F.col(tree_col).alias("tree"), F.col(node_col).alias("node"), F.col(parent_col).alias("parent"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)).alias("score")).where("tree is not null and node is not null")
    first = Window.partitionBy("tree", "node").orderBy(F.desc("score"), "parent", "role", "text")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    rows = as_table(rows, "replies-rows")
    every = paths(rows)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "score"))), lambda x: x.score)
    scored = every.join(rows.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(in_order.alias("scores"))
    scored = scored.select("tree", "leaf", F.size("scores").alias("depth"), (F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores")).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    spoken = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>"))
    turns = every.join(ranked.select("tree", "leaf"), ["tree", "leaf"], "left_semi").join(rows.select("tree", "node", spoken.alias("turn")), ["tree", "node"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn"))), lambda x: x.turn), "\n")
    return turns.groupBy("tree", "leaf").agg(joined.alias("conversation")).join(ranked, ["tree", "leaf"]).select("tree", "rank", "leaf", "depth", "score", "conversation")


def threads(conv: DataFrame) -> DataFrame:
    """The table of conversations as trees: it has no parents, so a turn whose number is a multiple of 3 replies
    to the turn three before it, any other to the turn before. A turn's score is the length of its text."""
    parent = F.when(F.col("turn") % 3 == 0, F.col("turn") - 3).otherwise(F.col("turn") - 1)
    return conv.select(F.col("conv_id").alias("tree"), F.col("turn").alias("node"), parent.alias("parent"), "role", "text", F.length("text").alias("score"))


SQL = f"""
WITH RECURSIVE n AS (
  SELECT conv_id AS tree, turn AS node, CASE WHEN turn % 3 = 0 THEN turn - 3 ELSE turn - 1 END AS parent,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, CAST(coalesce(length(text), 0) AS DOUBLE) AS score FROM conversations
), w AS (
  SELECT tree, node, score AS total, 1 AS depth, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' AS conversation
  FROM n WHERE NOT EXISTS (SELECT 1 FROM n p WHERE p.tree = n.tree AND p.node = n.parent)
  UNION ALL
  SELECT n.tree, n.node, total + n.score, depth + 1, conversation || chr(10) || '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>'
  FROM w JOIN n ON n.tree = w.tree AND n.parent = w.node
), r AS (
  SELECT tree, node AS leaf, depth, total / depth AS score, conversation,
         row_number() OVER (PARTITION BY tree ORDER BY total / depth DESC, node) AS rank
  FROM w WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.tree = w.tree AND c.parent = w.node)
)
SELECT tree, CAST(rank AS INTEGER) AS rank, leaf, CAST(depth AS INTEGER) AS depth, score, conversation FROM r WHERE rank <= {TOP}
"""

ALL_SQL = SQL.replace(f" WHERE rank <= {TOP}", "")
