"""Merkle manifest of a table: a tree over aligned blocks of leaves whose versions copy only the path they change.

Rows become leaf hashes, numbered by key within their group (a source). Sixteen neighbours become one node, level by
level, until one is left: the group's root; the roots of all groups in order form the tree above. A block is an aligned
run of ``WIDTH ** LEVELS`` members, so one task holds the nodes of a few levels; the tops of blocks are the members of the next
table of blocks. A changed leaf makes a version of its block: the block's nodes are shared, only the ancestors of that leaf are copied.
The siblings above a block are handed down to it once, and every version goes on to the root where its leaf lies, so
versions never meet in the upper blocks, however many there are.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.shared import col, erase, numbered, store, workspace

WIDTH, LEVELS = 16, 3
BLOCK = WIDTH ** LEVELS
PATH = "array<struct<l:string,r:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """Nodes of one block, level by level. Nodes are never changed; :meth:`version` gives a tree that shares them."""

    def __init__(self, leaves: list[str], height: int | None = None):
        """``height``: levels above the leaves; as many as it takes to come to one node if none."""
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 if height is None else len(self.levels) <= height:
            below = self.levels[-1]
            self.levels.append([digest("".join(below[k: k + WIDTH])) for k in range(0, len(below), WIDTH)])

    def node(self, level: int, k: int) -> str:
        return self.levels[level][k]

    @property
    def top(self) -> str:
        return self.node(len(self.levels) - 1, 0)

    def siblings(self, k: int) -> list[tuple[str, str]]:
        """Nodes left and right of leaf ``k`` in its run and of each ancestor in its run, as joined hex texts."""
        out = []
        for below in self.levels[:-1]:
            run = k - k % WIDTH
            out.append(("".join(below[run: k]), "".join(below[k + 1: run + WIDTH])))
            k //= WIDTH
        return out

    def version(self, k: int, leaf: str) -> Version:
        return Version(self, k, leaf)


class Version:
    """A tree with one other leaf: its own path from that leaf up, every other node read from the base."""

    def __init__(self, base: Tree, k: int, leaf: str):
        self.base, self.path = base, [(k, leaf)]
        for level in range(len(base.levels) - 1):
            k //= WIDTH
            last = min((k + 1) * WIDTH, len(base.levels[level]))
            self.path.append((k, digest("".join(self.node(level, i) for i in range(k * WIDTH, last)))))

    def node(self, level: int, k: int) -> str:
        at, own = self.path[level]
        return own if at == k else self.base.node(level, k)

    @property
    def top(self) -> str:
        return self.path[-1][1]


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and the siblings above it lead to."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def height(n: int, block: int) -> int | None:
    """Levels that a block of a tree over ``n`` members spans: all if it is the only one."""
    if n <= block:
        return None
    levels, size = 0, 1
    while size < block:
        levels, size = levels + 1, size * WIDTH
    return levels


def _trees(group: pd.DataFrame):
    """Frames of the members of each tree in a task's group, in order. Small trees that start near each other share a group."""
    group = group.sort_values(["tree", "pos"], ignore_index=True)
    cuts = [0, *(group.index[group["tree"].diff().fillna(0) != 0]), len(group)]
    return [group.iloc[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """Members with the block they lie in: ``unit`` is the tree, or one for all small trees whose first rows are near each other."""
    return members.select(
        "*", F.expr(f"IF(small, -1 - (tree div {block}), tree)").alias("unit"), F.expr(f"pos div {block}").alias("block"))


def tops(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """From members (tree, pos, n, small, hash) their blocks as members of the next table.

    ``n`` counts the members of a tree, ``small`` says that its leaves fill no more than one block.
    """

    def build(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in _trees(group):
            t, n = part.iloc[0], int(part["n"].iloc[0])
            out.append((t["tree"], int(t["pos"]) // block, -(-n // block), t["small"], Tree(part["hash"].tolist(), height(n, block)).top))
        return pd.DataFrame(out, columns=["tree", "pos", "n", "small", "hash"])

    at = _dealt(members.select("tree", "pos", "n", "small", "hash"), block)
    return at.groupBy("unit", "block").applyInPandas(build, "tree long, pos long, n long, small boolean, hash string")


def climb(members: DataFrame, folder: str, block: int = BLOCK) -> list[DataFrame]:
    """Stored tables of members, from the given ones to one node for each tree. As many rounds as the largest tree has blocks of blocks."""
    out = [members]
    while len(out) == 1 or (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(store(tops(out[-1], block), f"{folder}/tops-{len(out)}"))
    return out


def descend(tables: list[DataFrame], above: DataFrame, block: int = BLOCK) -> DataFrame:
    """Paths of the members of the given tables' first one: (tree, pos, small, subroot, path).

    ``above`` holds the path of the single node of each tree, (tree, small, subroot, path); ``subroot`` is passed on.
    A table is a block's width smaller than the one before it.
    """

    def hand_down(group: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        out, over = [], {x["tree"]: x for x in upper.to_dict("records")}
        for part in _trees(group):
            x = over[part["tree"].iloc[0]]
            tree = Tree(part["hash"].tolist(), height(int(part["n"].iloc[0]), block))
            rest = [(y["l"], y["r"]) for y in x["path"]]
            out += [(x["tree"], pos, x["small"], x["subroot"], [{"l": left, "r": right} for left, right in tree.siblings(k) + rest])
                    for k, pos in enumerate(part["pos"].tolist())]
        return pd.DataFrame(out, columns=["tree", "pos", "small", "subroot", "path"])

    paths = above.select("tree", F.lit(0).cast("long").alias("pos"), "small", "subroot", "path")
    for members in reversed(tables[:-1]):
        paths = _meet(members, paths, hand_down, f"tree long, pos long, small boolean, subroot string, path {PATH}", block)
    return paths


def _meet(members: DataFrame, paths: DataFrame, fn, schema: str, block: int) -> DataFrame:
    """Each block of members with the path of its own top."""
    upper = paths.select("*", F.expr(f"IF(small, -1 - (tree div {block}), tree)").alias("unit"), F.col("pos").alias("block"))
    return _dealt(members, block).groupBy("unit", "block").cogroup(upper.groupBy("unit", "block")).applyInPandas(fn, schema)


def leaf(*columns: str | Column) -> Column:
    """Hash of the columns in order: ``-`` for a null, else byte count, colon and value."""
    parts = []
    for c in columns:
        value = (col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(rows: DataFrame, group: str, key: str, original: Column, tampered: Column, folder: str, block: int = BLOCK) -> DataFrame:
    """One row for each of ``rows``: key, leaf, subroot, root, proof_sha256, folded_root, verified, pos.

    ``tampered`` is the hash of a changed row, null where it stays. Leaves of a group ascend by key (null first), rows with one key by their hash; groups
    ascend (null first, bytewise). Rows are numbered by one stored global sort, so a group of any size is spread over many tasks. An empty
    table has no rows and no root.
    """
    spark = rows.sparkSession
    narrow = rows.select(col(group).cast("string").alias("grp"), col(key).alias("key"), original.alias("leaf"), tampered.alias("other"))
    leaves, _ = numbered(narrow, ["grp", "key", "leaf"], f"{folder}/leaves", "row")
    # Groups learn their first row through runs of neighbouring numbers, so that a large group is no single join key.
    leaves = leaves.withColumn("cell", F.expr(f"row div {block}"))
    runs = leaves.groupBy("grp", "cell").agg(F.min("row").alias("low"), F.count("*").alias("held"))
    runs = store(runs.select(F.col("grp").alias("g"), F.col("cell").alias("c"), "low", "held"), f"{folder}/runs")
    groups = runs.groupBy("g").agg(F.min("low").alias("tree"), F.sum("held").alias("n")).withColumnRenamed("g", "name")
    starts = runs.join(groups, F.col("g").eqNullSafe(F.col("name"))).select("g", "c", "tree", "n")
    members = leaves.join(starts, (F.col("cell") == F.col("c")) & F.col("grp").eqNullSafe(F.col("g"))).select(
        "tree", (F.col("row") - F.col("tree")).alias("pos"), "n", (F.col("n") <= block).alias("small"),
        F.col("leaf").alias("hash"), "key", "other")
    members = store(members, f"{folder}/members")
    erase(spark, f"{folder}/leaves")

    tables = climb(members, f"{folder}/group-trees", block)
    # Groups in order are trees in the order of their first rows; their roots are the leaves of the tree above.
    order, count = numbered(tables[-1].select("tree", "small", "hash"), ["tree"], f"{folder}/order", "pos")
    order = store(order, f"{folder}/order-numbered")
    upper = climb(order.select(
        F.lit(0).cast("long").alias("tree"), "pos", F.lit(count).cast("long").alias("n"), F.lit(count <= block).alias("small"), "hash",
    ), f"{folder}/root-tree", block)
    top = upper[-1].first()  # the one node of the tree above
    root = top["hash"] if top else None
    over = descend(upper, upper[-1].select("tree", "small", F.lit(None).cast("string").alias("subroot"), F.array().cast(PATH).alias("path")), block)
    above = over.select("pos", "path").join(order, "pos").select("tree", "small", F.col("hash").alias("subroot"), "path")
    blocks = descend(tables[1:], above, block)

    def finish(group: pd.DataFrame, handed: pd.DataFrame) -> pd.DataFrame:
        out, paths = [], {x["tree"]: x for x in handed.to_dict("records")}
        for part in _trees(group):
            x = paths[part["tree"].iloc[0]]
            rest = [(y["l"], y["r"]) for y in x["path"]]
            joined = "".join(left + right for left, right in rest)
            tree = Tree(part["hash"].tolist(), height(int(part["n"].iloc[0]), block))
            for k, (pos, hashed, key, other) in enumerate(zip(part["pos"].tolist(), part["hash"].tolist(), part["key"].tolist(), part["other"].tolist())):
                own = tree.siblings(k)
                proof = digest("".join(left + right for left, right in own) + joined)
                folded = fold(hashed, own + rest) if other is None else fold(tree.version(k, other).top, rest)
                out.append((key, hashed, x["subroot"], proof, folded, pos))
        made = pd.DataFrame(out, columns=["key", "leaf", "subroot", "proof_sha256", "folded_root", "pos"])
        return made.astype({"key": "object"})

    kind = members.schema["key"].dataType.simpleString()
    done = _meet(members, blocks, finish, f"key {kind}, leaf string, subroot string, proof_sha256 string, folded_root string, pos long", block)
    return done.select(
        F.col("key").alias(key), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root).cast("string")).alias("verified"), "pos")


def document_manifest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Manifest of the documents; where 5 divides the checksum of the decimal doc_id, the text's A-Z are lower-cased and must be found out.

    A null doc_id is never tampered with, nor is a null text changed. Columns besides doc_id, source, lang, n_chars and text are
    not read; repeated rows are leaves each.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = ["doc_id", "source", "lang", "n_chars"]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = F.when(hit, leaf(*fields, F.translate("text", upper, upper.lower())))
    rows = docs.select(*fields, "text")
    return manifest(rows, "source", "doc_id", leaf(*fields, "text"), other, workspace(docs.sparkSession, "manifest"), block)
