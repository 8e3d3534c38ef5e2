"""Merkle manifest of a dataset: a tree of hashes a source, and one over the sources, with proofs for every row.

Leaves are hashed where their texts are read; from then on a row is a few numbers and a digest. They
are sorted by range and numbered in two levels (rows within a partition, partitions within a source),
so that a source with most of the rows is split. Trees grow by superblocks of 3**LEVELS consecutive
nodes: one pass of ``applyInPandas`` reduces each superblock of every tree to one node, again until
each tree is one node. Then the proofs go down again: the nodes of a superblock and the outer nodes
that its own proof needs meet in a cogroup, which reduces the block once more, joins both parts of
each proof and folds it.

No group has more than 3**LEVELS rows, and the driver sees one number a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, settled

#: Nodes that make one, and levels of a superblock.
FAN, LEVELS = 3, 6
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Digest of fields, each as byte count, colon and value, or a dash for a null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): tampered is the leaf of the row without newlines in its text, for half of the rows, where it differs."""
    rest = [F.col(c) for c in COLUMNS[:-1]]
    changed = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    return docs.select(
        "doc_id", "source", leaf_digest(*rest, F.col("text")).alias("leaf"),
        F.when(changed, leaf_digest(*rest, F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"),
    )


def numbered(nodes: DataFrame, tree: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``i``, the place in its tree by ``order`` from 0, and ``n``, the nodes of the tree; and the settled table behind it.

    Rows are dealt by range and sorted; the sizes of (tree, partition) are summed, one row a partition or tree.
    Rows that are equal in ``order`` are cut by their place in the input, so that many of them need no single task.
    """
    nodes = nodes.withColumn("__salt", F.monotonically_increasing_id())
    keys = [*tree, *order, "__salt"]
    rows = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    rows = settled(rows.drop("__salt"), name)
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(*tree, part.alias("__part")).agg(F.count("*").alias("__size"), F.min("__at").alias("__first"))
    over = Window.partitionBy(*tree) if tree else Window.partitionBy(F.lit(0))
    sizes = sizes.select(
        *tree, "__part", F.sum("__size").over(over).alias("n"),
        (F.sum("__size").over(over.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"), "__first",
    )
    left, right = rows.withColumn("__part", part).alias("l"), sizes.alias("r")
    same = F.col("l.__part") == F.col("r.__part")
    for c in tree:
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    place = F.coalesce("r.__before", F.lit(0)) + F.col("l.__at") - F.col("r.__first")
    return left.join(right, same).select("l.*", place.alias("i"), "r.n").drop("__at", "__part"), rows


def levels(hashes: list[str], n: int) -> Iterator[tuple[list[str], list[str]]]:
    """(nodes, their parents) of each level of one superblock of a tree of ``n`` nodes, until the tree or the block is one node."""
    for _ in range(LEVELS):
        if n == 1:
            return
        parents = [digest(*hashes[i : i + FAN]) for i in range(0, len(hashes), FAN)]
        yield hashes, parents
        hashes, n = parents, -(-n // FAN)


def reduced(nodes: DataFrame, tree: list[str]) -> DataFrame:
    """(tree, i, n, hash) of the superblocks of ``nodes`` (tree, i, n, hash); a tree of one node stays as it is."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        hashes, n = part["hash"].tolist(), int(part["n"].iloc[0])
        for _, hashes in levels(hashes, n):
            pass
        out = part.iloc[:1][[*tree, "i", "n"]].copy()
        out["i"], out["n"], out["hash"] = out["i"] // BLOCK, -(-n // BLOCK), hashes[0]
        return out

    form = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in tree)
    rows = nodes.select(*tree, "i", "n", "hash", F.floor(F.col("i") / BLOCK).alias("block"))
    return rows.groupBy(*tree, "block").applyInPandas(run, f"{form + ', ' if tree else ''}i long, n long, hash string")


def walked(hashes: list[str], n: int) -> tuple[list[list[str]], str]:
    """For each node of a superblock, its steps to the block's top, each ``left hashes|right hashes`` separated by commas; and the top."""
    steps: list[list[str]] = [[] for _ in hashes]
    top, width = hashes[0], 1
    for nodes, parents in levels(hashes, n):
        around = []
        for i in range(len(nodes)):
            first = i - i % FAN
            around.append(",".join(nodes[first:i]) + "|" + ",".join(nodes[i + 1 : first + FAN]))
        for k, own in enumerate(steps):
            own.append(around[k // width])
        width *= FAN
        top = parents[0]
    return steps, top


def folded(leaf: str, steps: list[str]) -> str:
    """The root that a leaf and the nodes beside its way lead to."""
    for step in steps:
        left, right = step.split("|")
        leaf = digest(left.replace(",", ""), leaf, right.replace(",", ""))
    return leaf


def proof_digest(steps: list[str]) -> str:
    return digest("".join(steps).replace(",", "").replace("|", ""))


def handed_down(nodes: DataFrame, above: DataFrame, tree: list[str], keep: list[str], leaf: bool) -> DataFrame:
    """Nodes of a level with the whole of their proofs, from those of the superblocks above (tree, i, outer, subroot).

    ``outer`` has the steps above a superblock, separated by semicolons. The result has ``tree``, ``i``, ``keep``, the ``subroot`` that comes down, and for
    inner levels the ``outer`` of each node; for leaves (leaf, tampered) the proof's digest and the folded root.
    """

    def run(part: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        rest = [s for s in outer["outer"].iloc[0].split(";") if s]
        steps, _ = walked(part["hash"].tolist(), int(part["n"].iloc[0]))
        out = part[[*tree, "i", *keep]].copy()
        out["subroot"] = outer["subroot"].iloc[0]
        if not leaf:
            out["outer"] = [";".join([*own, *rest]) for own in steps]
            return out
        own_leaves = [t or h for t, h in zip(part["tampered"], part["hash"])]
        out["proof_sha256"] = [proof_digest([*own, *rest]) for own in steps]
        out["folded_root"] = [folded(h, [*own, *rest]) for h, own in zip(own_leaves, steps)]
        return out

    kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in (*tree, "i", *keep))
    more = "proof_sha256 string, folded_root string" if leaf else "outer string"
    left = nodes.withColumn("block", F.floor(F.col("i") / BLOCK)).groupBy(*tree, "block")
    right = above.withColumnRenamed("i", "block").groupBy(*tree, "block")
    return left.cogroup(right).applyInPandas(run, f"{kinds}, subroot string, {more}")


def grown(nodes: DataFrame, tree: list[str], name: str) -> list[DataFrame]:
    """The rounds of superblocks above ``nodes``, the last with one node a tree, each written to the shared folder."""
    out = []
    while True:
        nodes = settled(reduced(nodes, tree), name)
        out.append(nodes)
        if (nodes.agg(F.max("n")).first()[0] or 1) <= 1:
            return out


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes doc_id, source, lang, n_chars and text. Per source, a null one included, leaves ascend by
    doc_id, nulls first, and those of one doc_id by their digests; equal rows have leaves of their own. Three consecutive nodes
    make one, the last fewer, until one remains; the sources' nodes, ordered by source, likewise give the root. The proof has the other nodes of
    every run on the way up. Rows whose doc_id has an even crc32 are checked with a text without newlines
    (null doc_ids are not), so that those which had any do not verify. An empty table gives no rows;
    other columns are ignored; texts are hashed whole.
    """
    made = settled(leaves(docs), "leaves")
    rows, sorted_rows = numbered(made.withColumnRenamed("leaf", "hash"), ["source"], ["doc_id", "hash"], "leaves-sorted")
    # Pandas would turn whole numbers into fractions where some are null.
    rows = settled(rows.withColumn("doc_id", F.col("doc_id").cast("string")), "leaves-numbered")
    discard(made, sorted_rows)
    rounds = grown(rows, ["source"], "blocks")
    tops, sorted_tops = numbered(rounds[-1].select("source", "hash"), [], ["source"], "subroots")
    tops = settled(tops.withColumn("tree", F.lit(0)), "subroots-numbered")
    discard(sorted_tops)
    above = grown(tops, ["tree"], "roots")
    down = above[-1].select("tree", "i", F.lit("").alias("outer"), F.col("hash").alias("subroot"))
    for below in [*above[-2::-1], tops]:
        down = handed_down(below, down, ["tree"], ["source", "hash"] if below is tops else [], False)
    # The root has come down as ``subroot``; a source's own node is what its rows call so.
    down = settled(down.select("source", F.lit(0).cast("long").alias("i"), F.concat_ws(" ", "hash", "subroot").alias("subroot"), "outer"), "outer")
    for below in rounds[-2::-1]:
        down = settled(handed_down(below, down, ["source"], [], False).select("source", "i", "outer", "subroot"), "outer")
    out = handed_down(rows, down, ["source"], ["doc_id", "hash"], True)
    root = F.substring_index("subroot", " ", -1)
    return out.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "source", "i", F.col("hash").alias("leaf"), F.substring_index("subroot", " ", 1).alias("subroot"), root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


#: The same in SQL for DuckDB. The lowest bit of a crc32 is computed bit by bit.
ORACLE = """
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, *, CASE WHEN doc_id IS NULL THEN false ELSE
        xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda c, b:
            list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT) & 1 = 0 END AS odd
    FROM documents
), h AS (
    SELECT r, doc_id, source, odd AND contains(text, chr(10)) AS changed,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        text, replace(text, chr(10), '') AS other
    FROM d
), leaf AS (
    SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN changed THEN sha256(head || strlen(other) || ':' || other) END AS tampered
    FROM h
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM leaf
), tree AS (
    SELECT s, 0 AS lvl, i, leaf AS hash, n FROM placed
    UNION ALL
    SELECT s, lvl + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY s, lvl, i // 3, n
), subroots AS (
    SELECT s, hash, lvl FROM tree WHERE n = 1
), top AS (
    SELECT 0 AS lvl, s AS i, hash, (SELECT count(*) FROM subroots) AS n FROM subroots
    UNION ALL
    SELECT lvl + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, i // 3, n
), near AS (
    SELECT p.r, t.lvl AS step, t.i, t.hash, (p.i // (3 ** t.lvl)::BIGINT)::BIGINT AS own
    FROM placed p JOIN tree t ON t.s = p.s AND t.n > 1 AND t.i // 3 = (p.i // (3 ** (t.lvl + 1))::BIGINT)
    UNION ALL
    SELECT p.r, 1000 + t.lvl, t.i, t.hash, (p.s // (3 ** t.lvl)::BIGINT)::BIGINT
    FROM placed p JOIN top t ON t.n > 1 AND t.i // 3 = (p.s // (3 ** (t.lvl + 1))::BIGINT)
), steps AS (
    SELECT r, step, coalesce(string_agg(hash, '' ORDER BY i) FILTER (i < own), '') AS l, coalesce(string_agg(hash, '' ORDER BY i) FILTER (i > own), '') AS g FROM near GROUP BY r, step
), paths AS (
    SELECT r, list({'x': '', 'l': l, 'g': g} ORDER BY step) AS p, string_agg(l || g, '' ORDER BY step) AS s FROM steps GROUP BY r
), folded AS (
    SELECT p.doc_id, p.leaf, b.hash AS subroot, (SELECT hash FROM top WHERE n = 1) AS root, sha256(coalesce(q.s, '')) AS proof_sha256,
        list_reduce(list_prepend({'x': coalesce(p.tampered, p.leaf), 'l': '', 'g': ''}, coalesce(q.p, [])), lambda a, b: {'x': sha256(b.l || a.x || b.g), 'l': '', 'g': ''}).x AS folded_root
    FROM placed p JOIN subroots b USING (s) LEFT JOIN paths q USING (r)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
