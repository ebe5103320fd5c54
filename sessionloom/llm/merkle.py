"""Merkle manifest of a table, and inclusion proofs by pointer jumping.

Every row is a leaf. The leaves of a group, ordered by id, are hashed three at a time until
one digest is left, the subroot; the subroots, ordered by group, likewise give the root.

* Texts are read once and only digests are shuffled. Leaves are numbered by ranges; runs of
  729 leaves meet in one row and go up six levels there, so a tree of n leaves takes
  log(n) / log(729) shuffles, however large its group is.
* Each node holds `siblings` (the other digests of its run) and `turns` (how many stand left
  and right of it): a path of one step to its parent. A self-join appends to the path of a
  node the path of the node that it leads to, which doubles the distance; after
  log2(height) joins every leaf reaches the root. Only levels that a next join can meet
  are kept, a third of the nodes, then a ninth. A key of a join over distance d has at most 3^d
  rows; where fewer nodes than that are left to meet, they are broadcast behind a check of
  their size.

Defined cases: a null field is hashed as `-`; a null group is a group of its own, the first;
null ids come first in their group; rows of one id are ordered by their digest, so repeated
rows are leaves each; a group of one row has its leaf as subroot, a table of one group that
subroot as root; an empty table has no row and no root. Only the named fields are hashed,
other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, numbered, staged

FAN, LEVELS = 3, 6
#: Bytes of a table that a join broadcasts.
BROADCAST = 4 << 20


def leaf_hash(fields: list[Column]) -> Column:
    """Digest of a row, as hex: every field with its length before it."""

    def marked(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(marked, fields)).cast("binary"), 256)


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def fold(leaf: Column, turns: Column, siblings: Column) -> Column:
    """The root that a leaf (hex) and its siblings (digests one after another) lead to."""

    def climb(text: Column) -> Column:
        def step(s: Column, turn: Column) -> Column:
            left, right = F.shiftright(turn, 2) * 64, turn.bitwiseAND(3) * 64
            digests = F.concat(F.substring(text, s["at"], left), s["h"], F.substring(text, s["at"] + left, right))
            return F.struct(F.sha2(digests.cast("binary"), 256).alias("h"), (s["at"] + left + right).alias("at"))

        return F.aggregate(turns, F.struct(leaf.alias("h"), F.lit(1).alias("at")), step, lambda s: s["h"])

    return let(hexed(siblings), climb)


def _up(digests: Column) -> Column:
    """The digests one level higher."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(digests, i * FAN + 1, FAN), "").cast("binary"), 256))


def _height(n: Column) -> Column:
    """The smallest h with 3^h >= n."""
    return sum(((n > FAN**k).cast("int") for k in range(1, 40)), (n > 1).cast("int"))


def _nodes(k: int, level: int, kind: str) -> Column:
    """The nodes of array column `l{k}` of a run that begins at `level`."""
    digests = F.col(f"l{k}")

    def node(digest: Column, i: Column) -> Column:
        place = i % FAN
        run = F.slice(digests, i - place + 1, FAN)
        others = F.array_join(F.filter(run, lambda _, j: j != place), "")
        turn = (place * 4 + F.size(run) - 1 - place).cast("int")
        return F.struct(
            F.lit(level + k).alias("level"), (F.col("run") * FAN ** (LEVELS - k) + i).alias("idx"), F.unhex(digest).alias("digest"),
            F.array(turn).alias("turns"), F.unhex(others).alias("siblings"), F.get("items", i)["row"].alias("row") if k == 0 and level == 0 else F.lit(None).cast(kind).alias("row"),
        )

    return F.when(F.col("steps") > k, F.transform(digests, node)).otherwise(F.array().cast("array<struct<level:int,idx:bigint,digest:binary,turns:array<int>,siblings:binary,row:" + kind + ">>"))


def build(leaves: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(tree, idx, n, digest, row) -> written tables of nodes, and of roots (tree, digest).

    Nodes: (tree, top, level, idx, digest, turns, siblings, row); `top` is the height of the tree. The root is no node.
    A lone leaf is both: its path has no step."""
    kind = leaves.schema["row"].dataType.simpleString()
    base = leaves.select("tree", "idx", _height(F.col("n")).alias("top"), "digest", "row")
    nodes, roots, level = [], [], 0
    lone = base.where("top = 0")
    empty = F.array().cast("array<int>")
    nodes.append(lone.select("tree", "top", F.lit(0).alias("level"), "idx", "digest", empty.alias("turns"), F.lit(b"").alias("siblings"), "row"))
    roots.append(lone.select("tree", "digest"))
    base = base.where("top > 0")
    while not base.isEmpty():
        items = F.array_sort(F.collect_list(F.struct("idx", "digest", "row"))).alias("items")
        runs = base.groupBy("tree", "top", F.floor(F.col("idx") / FAN**LEVELS).alias("run")).agg(items)
        runs = runs.withColumn("l0", F.transform("items", lambda x: hexed(x["digest"]))).withColumn("steps", F.least(F.lit(LEVELS), F.col("top") - level))
        for k in range(LEVELS):
            runs = runs.withColumn(f"l{k + 1}", _up(F.col(f"l{k}")))
        last = F.unhex(F.get(F.get(F.array(*[F.col(f"l{k}") for k in range(LEVELS + 1)]), F.col("steps")), F.lit(0)))
        found = F.flatten(F.array(*[_nodes(k, level, kind) for k in range(LEVELS)]))
        written = staged(runs.select("tree", "top", "run", found.alias("found"), last.alias("last")), "merkle-runs")
        nodes.append(written.select("tree", "top", F.explode("found").alias("x")).select("tree", "top", "x.*"))
        roots.append(written.where(F.col("top") <= level + LEVELS).select("tree", F.col("last").alias("digest")))
        level += LEVELS
        base = written.where(F.col("top") > level).select("tree", F.col("run").alias("idx"), "top", F.col("last").alias("digest"), F.lit(None).cast(kind).alias("row"))
    return nodes, roots


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _jump(nodes: DataFrame, known: DataFrame, d: int) -> DataFrame:
    """Append to each path of d steps that of the node which it leads to.

    Paths that have reached their root meet nothing, under keys of their own."""
    still = F.col("level") + d < F.col("top")
    keyed = nodes.withColumn("_up", F.when(still, F.floor(F.col("idx") / FAN**d)).otherwise(-1 - F.col("idx"))).withColumn("_to", F.col("level") + d)
    ahead = known.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("idx").alias("_idx"), F.col("turns").alias("_turns"), F.col("siblings").alias("_siblings"))
    if known.count() * (64 * d + 64) <= BROADCAST:
        ahead = F.broadcast(ahead)
    met = keyed.join(ahead, (keyed["tree"] == ahead["_tree"]) & (keyed["_to"] == ahead["_level"]) & (keyed["_up"] == ahead["_idx"]), "left")
    turns = F.when(F.col("_turns").isNull(), F.col("turns")).otherwise(F.concat("turns", "_turns"))
    siblings = F.when(F.col("_turns").isNull(), F.col("siblings")).otherwise(F.concat("siblings", "_siblings"))
    return met.select(*[turns.alias(c) if c == "turns" else siblings.alias(c) if c == "siblings" else F.col(c) for c in nodes.columns])


def paths(nodes: list[DataFrame]) -> DataFrame:
    """(tree, digest, turns, siblings, row) of every leaf: its whole path to the root of its tree."""
    every = _union(nodes)
    tallest = every.agg(F.max("top")).first()[0] or 0
    leaves, d = every.where("level = 0"), 1
    known = every.where("level > 0").drop("digest", "row")
    while d < tallest:
        leaves = _jump(leaves, known.where(F.col("level") == d), d)
        known = staged(_jump(known.where(F.col("level") % (2 * d) == 0), known, d), f"merkle-paths-{2 * d}")
        d *= 2
    return leaves.select("tree", "digest", "turns", "siblings", "row")


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: (id, group, the columns of `keep`, leaf, subroot, root, turns, siblings).

    `siblings` are the digests next to the path from the leaf to the root, one after another, left to right, level by
    level; `turns` says for each level how many stand left (times four) and right. `keep` are further columns, made from docs."""
    extra = [c.alias(f"_keep_{k}") for k, c in (keep or {}).items()]
    own = docs.select(F.col(id_col).alias("_id"), F.col(group_col).alias("_group"), F.unhex(leaf_hash([F.col(c) for c in fields])).alias("digest"), *extra)
    places = [F.col("_group").asc_nulls_first(), F.col("_id").asc_nulls_first(), F.col("digest")]
    rows = numbered(staged(own, "merkle-leaves"), places, "merkle-places")
    groups = staged(rows.groupBy("_group").agg(F.min("_pos").alias("start"), F.count("*").alias("n")), "merkle-groups")
    trees = numbered(groups, [F.col("start")], "merkle-trees").select(F.col("_group").alias("_name"), "start", "n", F.col("_pos").alias("tree"))
    size = trees.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("_name").cast("string"))), F.lit(0))).first()
    few = 64 * size[0] + size[1] <= BROADCAST
    placed = rows.join(F.broadcast(trees) if few else trees, F.col("_group").eqNullSafe(F.col("_name")))
    payload = F.struct("_id", "_group", *[f"_keep_{k}" for k in keep or {}]).alias("row")
    nodes, roots = build(placed.select("tree", (F.col("_pos") - F.col("start")).alias("idx"), "n", "digest", payload))
    subroots = staged(_union(roots), "merkle-subroots")
    tops, root = build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(size[0]).alias("n"), "digest", F.struct("tree").alias("row")))
    above = staged(paths(tops).select(F.col("row.tree").alias("_tree"), F.col("digest").alias("subroot"), F.col("turns").alias("_turns"), F.col("siblings").alias("_siblings")), "merkle-tops")
    if size[0] * (64 * 48) <= BROADCAST:
        above = F.broadcast(above)
    joined = paths(nodes).join(above, F.col("tree") == F.col("_tree")).crossJoin(F.broadcast(_union(root).select(F.col("digest").alias("root"))))
    return joined.select(
        F.col("row._id").alias(id_col), F.col("row._group").alias(group_col), *[F.col(f"row._keep_{k}").alias(k) for k in keep or {}],
        hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        F.concat("turns", "_turns").alias("turns"), F.concat("siblings", "_siblings").alias("siblings"),
    )
