"""Merkle manifest of a dataset, by higher-order SQL functions over blocks of leaves.

Every row is a leaf, the SHA-256 of its columns. The leaves of a group ascend by id;
every two neighbours become one node until one is left, the group's subroot; the
subroots, in the order of their groups, become the root in the same way.

1. One scan hashes each row, and each row as it would be after tampering.
2. Leaves are dealt by ranges of (group, id, leaf) and sorted in each range; what makes
   rows equal in all of these is their place in the written table, so that a third of
   all rows may be alike without meeting in one task. The counts of each range, one
   row for each group in it, give every leaf its place in its group.
3. ``BLOCK`` leaves in a row are one array. sequence, transform, slice and aggregate collapse
   it by as many levels as a block has, natively. The blocks' roots are the leaves of the next
   round, until each group has one: with blocks of 256, four rounds hold 4 billion leaves.
4. The siblings on the way up are handed down from the last round to the first, block by
   block, and each leaf's proof is folded with them.

Defined results: null columns are ``-``; rows without an id come first in their group,
rows of one id by their leaf; the null group is the first one; rows that repeat are
leaves each; very long texts are hashed whole; an empty table gives an empty manifest;
other columns, whatever their names, are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ._frames import small
from ._store import written

#: Paths that may be broadcast (a few KB each at most); more are shuffled.
PATHS = 10_000
#: log2 of the leaves of a block.
LEVELS = 8
BLOCK = 1 << LEVELS


def encoded(c: Column) -> Column:
    """The value's text with its length in UTF-8 bytes, ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the joined parts."""
    return F.sha2(F.concat(*parts), 256)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _parents(nodes: Column) -> Column:
    """Every two neighbours as one node; a last single one alone."""
    pair = lambda i: digest(nodes[2 * i], F.coalesce(F.get(nodes, 2 * i + 1), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)


def _levels(nodes: Column, count: Column) -> Column:
    """The arrays of nodes from the block's own up, over ``count`` levels."""
    rounds = F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), count)
    return F.aggregate(rounds, F.array(nodes), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))


def _height(leaves: Column) -> Column:
    """Levels that a block collapses: all that it has, or in a tree of one block as many
    as leave one node."""
    return F.when(leaves > BLOCK, LEVELS).when(leaves > 1, F.length(F.bin(leaves - 1))).otherwise(0)


def _path(levels: Column, count: Column, place: Column) -> Column:
    """The siblings (null: none) of the leaf at ``place`` of the block, and whether each
    stands to the left."""
    rounds = F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.lit(1), count)

    def step(level: Column) -> Column:
        at = F.call_function("shiftright", place, level)
        left = at % 2 == 1
        sibling = F.get(F.get(levels, level), F.when(left, at - 1).otherwise(at + 1))
        return F.struct(sibling.alias("sibling"), left.alias("left"))

    return F.transform(rounds, step)


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """tree, place (from 0), leaves (of the tree) and the other columns of nodes."""
    rows = written(nodes).withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie").drop("_tie")
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()))  # range << 33 | row of the range
    part = F.shiftright("_at", 33)
    counts = rows.groupBy("tree", part.alias("_range")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sums = written(_before(counts))
    joined = rows.withColumn("_range", part).join(small(sums), ["tree", "_range"])
    return joined.select("tree", (F.col("_before") + F.col("_at") - F.col("_first")).alias("place"), "leaves", *(c for c in nodes.columns if c != "tree"))


def _before(counts: DataFrame) -> DataFrame:
    """tree, _range, _first, leaves and _before (leaves of the tree in earlier ranges).
    Counts are one row for each tree and range that holds it."""
    item = F.struct("_range", "_n", "_first")
    whole = counts.groupBy("tree").agg(F.sort_array(F.collect_list(item)).alias("x"), F.sum("_n").alias("leaves"))  # at most one item for each range
    running = F.aggregate(
        "x", F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<_range:bigint,_first:bigint,_before:bigint>>").alias("out")),
        lambda s, r: F.struct((s["n"] + r["_n"]).alias("n"), F.concat(s["out"], F.array(F.struct(r["_range"].alias("_range"), r["_first"].alias("_first"), s["n"].alias("_before")))).alias("out")),
        lambda s: s["out"],
    )
    return whole.select("tree", "leaves", F.explode(running).alias("x")).select("tree", "leaves", "x.*")


def _blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """tree, block, leaves, root and items (place in the block, node, carried columns)
    of each block; written."""
    item = F.struct((F.col("place") % BLOCK).cast("int").alias("place"), "node", *carried)
    rows = nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).cast("long").alias("block"), "leaves").agg(F.sort_array(F.collect_list(item)).alias("items"))
    top = F.element_at(F.element_at(_levels(F.transform("items", lambda x: x["node"]), _height(F.col("leaves"))), -1), 1)
    return written(rows.withColumn("root", top))


def _paths(blocks: DataFrame, above: DataFrame, *carried: str) -> DataFrame:
    """tree, place, path (up to the root of all), top and carried columns of the nodes of
    blocks. ``above``: place, path and top of the blocks' roots."""
    over = above.select("tree", F.col("place").alias("block"), F.col("path").alias("over"), "top")
    rows = blocks.withColumn("height", _height(F.col("leaves"))).join(small(over, most=PATHS), ["tree", "block"])

    def leaves(levels: Column) -> Column:
        return F.transform("items", lambda x: F.struct(x["place"].alias("place"), F.concat(_path(levels, F.col("height"), x["place"]), F.col("over")).alias("path"), *(x[c].alias(c) for c in carried)))

    each = _let(_levels(F.transform("items", lambda x: x["node"]), F.col("height")), leaves)
    rows = rows.select("tree", "block", "top", F.explode_outer(each).alias("x"))  # a block is never empty
    return rows.select("tree", (F.col("block") * BLOCK + F.col("x.place")).alias("place"), "x.path", "top", *(F.col(f"x.{c}").alias(c) for c in carried))


def _grown(nodes: DataFrame, *carried: str) -> list[DataFrame]:
    """The blocks of each round, from the leaves up to one node for each tree."""
    rounds = [_blocks(nodes, *carried)]
    while (rounds[-1].agg(F.max("block")).first()[0] or 0) > 0:
        up = rounds[-1].select("tree", F.col("block").alias("place"), F.ceil(F.col("leaves") / BLOCK).cast("long").alias("leaves"), F.col("root").alias("node"))
        rounds.append(_blocks(up))
    return rounds


def _handed_down(rounds: list[DataFrame], above: DataFrame, *carried: str) -> DataFrame:
    """The paths of the first round's nodes, with their carried columns."""
    for blocks in reversed(rounds[1:]):
        above = written(_paths(blocks, above))
    return _paths(rounds[0], above, *carried)


def fold(node: Column, path: Column) -> Column:
    """The root that the node and its siblings give."""
    step = lambda h, s: F.when(s["sibling"].isNull(), digest(h)).when(s["left"], digest(s["sibling"], h)).otherwise(digest(h, s["sibling"]))
    return F.aggregate(path, node, step)


def proof(path: Column) -> Column:
    """The digest of the siblings, from the leaf up."""
    return digest(F.array_join(F.transform(path, lambda s: F.coalesce(s["sibling"], F.lit(""))), ""))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_column: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None) -> DataFrame:
    """The id, leaf, subroot, root, proof_sha256, folded_root and verified of each row. A leaf
    is hashed from ``columns`` in their order. ``tampered`` gives columns other values
    from which the folded root is computed."""
    changed = tampered or {}
    leaf = digest(*(encoded(F.col(c)) for c in columns))
    other = digest(*(encoded(changed.get(c, F.col(c))) for c in columns)) if changed else leaf
    # the tree's name sorts as the group does, the null group first
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col(id_column).alias("id"), leaf.alias("node"), F.nullif(other, leaf).alias("other"))
    rounds = _grown(_numbered(leaves, ["id", "node"]), "id", "other")
    tops = rounds[-1].select("tree", F.col("root").alias("node"))
    forest = _grown(_numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"]), "name")
    start = forest[-1].select("tree", F.lit(0).cast("long").alias("place"), F.array().cast("array<struct<sibling:string,left:boolean>>").alias("path"), F.col("root").alias("top"))
    over = _handed_down(forest, start, "name", "node")
    over = written(over.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.struct(F.col("node").alias("subroot"), F.col("top").alias("root")).alias("top")))
    rows = _handed_down(rounds, over, "id", "node", "other")
    folded = fold(F.coalesce("other", "node"), F.col("path"))
    rows = rows.select(F.col("id").alias(id_column), F.col("node").alias("leaf"), "top.subroot", "top.root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_ENCODED = {c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")}
_LEAF = "sha256(" + " || ".join(_ENCODED.values()) + ")"
_STEP = "CASE WHEN s.node IS NULL THEN sha256(f.h) WHEN f.place % 2 = 1 THEN sha256(s.node || f.h) ELSE sha256(f.h || s.node) END"
#: Nodes as rows, and a fold that meets the sibling of each level.
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT *, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 7 = 0 AS changed FROM documents, bits),
l AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF} AS leaf, changed FROM d),
o AS (SELECT coalesce('=' || lang, '') AS tree, {_LEAF} AS leaf, doc_id FROM (SELECT doc_id, source, lang, n_chars + 1 AS n_chars, text FROM d WHERE changed)),
p AS MATERIALIZED (SELECT row_number() OVER () AS id, l.doc_id, l.tree, l.leaf, coalesce(o.leaf, l.leaf) AS start, row_number() OVER (PARTITION BY l.tree ORDER BY l.doc_id, l.leaf) - 1 AS place FROM l LEFT JOIN o ON l.changed AND o.doc_id = l.doc_id AND o.tree = l.tree),
v AS (SELECT tree, 0 AS level, list(leaf ORDER BY place) AS nodes FROM p GROUP BY 1
  UNION ALL SELECT tree, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM v WHERE len(nodes) > 1),
n AS MATERIALIZED (SELECT tree, level, len(nodes) AS size, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS i FROM v),
top AS MATERIALIZED (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM n WHERE size = 1),
w AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM top
  UNION ALL SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM w WHERE len(nodes) > 1),
m AS MATERIALIZED (SELECT level, len(nodes) AS size, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS i FROM w),
f AS (SELECT id, tree, 0 AS level, place, start AS h, '' AS met FROM p
  UNION ALL SELECT f.id, f.tree, f.level + 1, f.place // 2, {_STEP}, f.met || coalesce(s.node, '')
  FROM f JOIN n x ON x.tree = f.tree AND x.level = f.level AND x.i = f.place AND x.size > 1 LEFT JOIN n s ON s.tree = f.tree AND s.level = f.level AND s.i = xor(f.place, 1)),
u AS MATERIALIZED (SELECT f.id, top.place, f.h, f.met, top.subroot FROM f JOIN n x ON x.tree = f.tree AND x.level = f.level AND x.size = 1 JOIN top ON top.tree = f.tree),
g AS (SELECT id, 0 AS level, place, h, met, subroot FROM u
  UNION ALL SELECT f.id, f.level + 1, f.place // 2, {_STEP}, f.met || coalesce(s.node, ''), f.subroot
  FROM g f JOIN m x ON x.level = f.level AND x.i = f.place AND x.size > 1 LEFT JOIN m s ON s.level = f.level AND s.i = xor(f.place, 1))
SELECT p.doc_id, p.leaf, g.subroot, m.node AS root, sha256(g.met) AS proof_sha256, g.h AS folded_root, g.h = m.node AS verified
FROM g JOIN m ON m.level = g.level AND m.size = 1 JOIN p ON p.id = g.id
"""
