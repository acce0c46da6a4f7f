"""One digest of a whole corpus in the order of its keys: a hash tree over stretches of the key, whatever the partitions.

A row's digest is of its key and text. Rows are counted by digest, digests joined in cells (by their first four letters, so that a key that many rows share spreads over many tasks),
cells to the digest of a stretch of keys, and stretches, arity by arity, to a root; a node's digest names its children's numbers, so gaps count. The order of rows is that of their keys, which their digests hold.
A change of a row changes the nodes on its way to the root and no others, wherever rows are added or lost; two trees are compared from the root down, and a stretch is proved by the siblings on its way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.sinks import materialized

#: Keys of a stretch, children of a node.
WIDTH, ARITY = 1000, 64


def row_digest(key: Column, text: Column) -> Column:
    """Of a key and a text, each null or not."""
    return F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit(":"), text), F.lit("!"))), 256)


def _joined(kind: str, parts: Sequence[str], by: str) -> Column:
    """The digest of a group's parts in order."""
    listed = F.sort_array(F.collect_list(F.struct(by, *[p for p in parts if p != by])))
    return F.sha2(F.concat(F.lit(kind), F.array_join(F.transform(listed, lambda x: F.concat_ws("=", *[x[p].cast("string") for p in parts])), ",")), 256)


def tree(df: DataFrame, key: str, text: str, width: int = WIDTH, arity: int = ARITY) -> DataFrame:
    """level, node, n (rows below) and sha256: level 0 are the stretches (node is floor(key / width), null for null keys), each level above has floor(node / arity), and the last has the root, node 0, alone.

    Levels are as many as the range of keys asks for; each is written, as the next is made of it. A group of collected parts is at most a cell's digests, a stretch's 65,536 cells or arity children.
    """
    rows = df.select(F.floor(F.col(key) / F.lit(width)).cast("bigint").alias("node"), row_digest(F.col(key), F.col(text)).alias("digest"))
    counted = rows.groupBy("node", F.substring("digest", 1, 4).alias("cell"), "digest").agg(F.count(F.lit(1)).alias("n"))
    cells = counted.groupBy("node", "cell").agg(F.sum("n").alias("n"), _joined("c", ("digest", "n"), "digest").alias("sha256"))
    level = materialized(cells.groupBy("node").agg(F.sum("n").alias("n"), _joined("s", ("cell", "sha256"), "cell").alias("sha256")))
    levels = [level]
    while not level.filter(~F.col("node").isin(-1, 0)).isEmpty():  # floors end at -1 and 0
        above = level.groupBy(F.floor(F.col("node") / F.lit(arity)).cast("bigint").alias("parent")).agg(F.sum("n").alias("n"), _joined("n", ("node", "sha256"), "node").alias("sha256"))
        level = materialized(above.withColumnRenamed("parent", "node"))
        levels.append(level)
    levels.append(level.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), _joined("r", ("node", "sha256"), "node").alias("sha256")).select(F.lit(0).cast("bigint").alias("node"), "n", "sha256"))
    out = None
    for k, some in enumerate(levels):
        some = some.select(F.lit(k).alias("level"), "node", "n", "sha256")
        out = some if out is None else out.unionByName(some)
    return materialized(out)


def root(nodes: DataFrame) -> str:
    return nodes.orderBy(F.col("level").desc()).first()["sha256"]


def changes(old: DataFrame, new: DataFrame, arity: int = ARITY) -> DataFrame:
    """node and change (changed, added, removed) of the stretches in which two trees of one width and arity differ, found from the highest level that both have below their roots: of each level only the children of nodes that differ are read on."""
    top = min(nodes.agg(F.max("level")).first()[0] for nodes in (old, new)) - 1
    differ = None
    for level in range(top, -1, -1):
        a, b = (nodes.filter(F.col("level") == level).select(F.col("node").alias(f"{name}_node"), F.col("sha256").alias(name)) for nodes, name in ((old, "old"), (new, "new")))
        both = a.join(b, F.col("old_node").eqNullSafe(F.col("new_node")), "full").filter(~F.col("old").eqNullSafe(F.col("new")))
        both = both.select(F.coalesce("old_node", "new_node").alias("node"), "old", "new")
        if differ is not None:
            parent = differ.select(F.col("node").alias("parent"))
            both = both.join(parent, F.floor(F.col("node") / F.lit(arity)).cast("bigint").eqNullSafe(F.col("parent")), "left_semi")
        differ = materialized(both)
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return differ.select("node", change.alias("change"))


def proof(nodes: DataFrame, stretch: int, arity: int = ARITY) -> list[dict]:
    """What proves a stretch's digest: at each level the nodes that share its way's parent, in order; a few hundred rows."""
    top = nodes.agg(F.max("level")).first()[0]
    wanted, at = F.lit(False), stretch
    for level in range(top):
        same = F.floor(F.col("node") / F.lit(arity)) == at // arity if level < top - 1 else F.lit(True)
        wanted |= (F.col("level") == level) & same
        at //= arity
    return [x.asDict() for x in nodes.filter(wanted).orderBy("level", F.col("node").asc_nulls_first()).collect()]


def proved(siblings: list[dict], stretch: int, digest: str, arity: int = ARITY) -> str | None:
    """The root that a proof leads to from a stretch's digest, or None where the digest isn't on the way."""
    at = stretch
    levels = sorted({x["level"] for x in siblings})
    for level in levels:
        some = [x for x in siblings if x["level"] == level]
        if digest not in [x["sha256"] for x in some if x["node"] == at]:
            return None
        kind = "r" if level == levels[-1] else "n"
        digest = hashlib.sha256((kind + ",".join("=".join(str(v) for v in (x["node"], x["sha256"]) if v is not None) for x in some)).encode()).hexdigest()
        at //= arity
    return digest
