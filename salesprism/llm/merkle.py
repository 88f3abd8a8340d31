"""Manifest of a table as a Merkle tree: a tree for each partition value, a tree over their roots, and a proof per row.

Leaves are hashes of rows, in the order of their ids inside a tree; every `arity` consecutive nodes of a level become
their hash, the last run of a level may be shorter, until one node is left. The number of children of any parent
follows from the size of the tree, so nobody has to wait for a level to end: children are events. A round deals nodes
out by block, HEIGHT levels of a subtree, with combineByKey: a partial parent gathers the digests of its children by
index, on the side of the reader as well as after the shuffle; when its arity is met it becomes a node and an event
for its own parent, and so on up to the block's top. Tops that still lack siblings are the frontier of the next round,
which deals them out by larger blocks, until every tree has its root; the roots then go through the same rounds.

A block keeps its nodes by level, which links every parent with its children in reverse. Proofs go down these links
from the root: a block gets the path above its top, and a node's path is its siblings in the block, level by level,
and then that of the top. A row's proof is folded with its leaf, or with a forged leaf, to see which root it gives.

Bounds: a block has arity**HEIGHT first nodes at most, whatever the sizes of trees; a tree of n rows takes
log(n) / HEIGHT rounds, to the base of the arity. Nothing but one number, the size of the largest tree, comes to the driver.

Defined results: rows with a null partition value form a tree of their own, before all others; null ids come first in
their tree; rows with equal ids are ordered by their hash, equal rows are leaves of their own; null columns are hashed
as "-"; a table of one row has its leaf as root and an empty proof; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from salesprism.llm.common import discard, ranked, small, written

ARITY, HEIGHT = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a path: the place of a node in its run, and the other nodes of the run.
STEP = "struct<place int, others array<string>>"
BLOCK = "tree long, level int, block long, size long, tops array<string>, nodes array<array<string>>, payloads array<struct<id {id}, forged string>>"


def hashed(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def level_sizes(size: int, arity: int) -> list[int]:
    """Nodes of each level of a tree, from the leaves to its root."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


class Partial:
    """What is known of a block: nodes by level and index, and for each parent that waits how many children are there."""

    __slots__ = ("level", "nodes", "payloads", "sizes", "top", "waiting")

    def __init__(self, size: int, level: int, height: int, arity: int):
        self.sizes, self.level = level_sizes(size, arity), level
        self.top = max(level, min(level + height, len(self.sizes) - 1))
        self.nodes: dict[tuple[int, int], str] = {}
        self.payloads: dict[int, tuple] = {}
        self.waiting: dict[tuple[int, int], int] = {}

    def arrives(self, level: int, index: int, digest: str, arity: int) -> None:
        """A node is there; parents whose arity it meets come into being."""
        while True:
            self.nodes[level, index] = digest
            if level == self.top:
                return
            parent = (level + 1, index // arity)
            due = min(arity, self.sizes[level] - parent[1] * arity)
            self.waiting[parent] = self.waiting.get(parent, 0) + 1
            if self.waiting[parent] < due:
                return
            del self.waiting[parent]
            first = parent[1] * arity
            level, index, digest = *parent, hashed([self.nodes[level, i] for i in range(first, first + due)])

    def joins(self, other: Partial, arity: int) -> Partial:
        """The nodes of both; what waited on either side for children of the other resolves."""
        self.payloads |= other.payloads
        open_nodes = []
        for (level, index), digest in other.nodes.items():
            if (level + 1, index // arity) in other.nodes:
                self.nodes[level, index] = digest
            else:
                open_nodes.append((level, index, digest))
        for node in open_nodes:
            self.arrives(*node, arity)
        return self


def resolve(nodes: DataFrame, level: int, arity: int, height: int, id_type: str) -> DataFrame:
    """The written blocks above nodes (tree, index, size, digest, id, forged) of a level; size counts the tree's leaves.

    tops is the block's last level, one digest; nodes holds its digests by level, from the given one upwards.
    """
    span = arity**height
    pairs = nodes.select("tree", "index", "size", "digest", "id", "forged").rdd.map(lambda r: ((r[0], r[1] // span), tuple(r)[1:]))

    def value(p: Partial, v: tuple) -> Partial:
        index, _, digest, own, forged = v
        p.payloads[index] = (own, forged)
        p.arrives(level, index, digest, arity)
        return p

    def row(item: tuple) -> tuple:
        (tree, block), p = item
        by_level: list[list[str]] = [[] for _ in range(level, p.top + 1)]
        for (at, _), digest in sorted(p.nodes.items()):
            by_level[at - level].append(digest)
        return tree, level, block, p.sizes[0], by_level[-1], by_level, [p.payloads[i] for i in sorted(p.payloads)]

    combined = pairs.combineByKey(lambda v: value(Partial(v[1], level, height, arity), v), value, lambda a, b: a.joins(b, arity), numPartitions=int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(nodes.sparkSession.createDataFrame(combined.map(row), BLOCK.format(id=id_type), verifySchema=False), "merkle-blocks")


def raise_trees(leaves: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """The blocks of all rounds over leaves (tree, index, size, digest, id, forged); the last round has one block a tree, its root on top."""
    id_type = leaves.schema["id"].dataType.simpleString()
    largest, level, rounds = leaves.agg(F.max("size")).first()[0] or 0, 0, []
    while True:
        rounds.append(resolve(leaves, level, arity, height, id_type))
        level += height
        if len(level_sizes(max(1, largest), arity)) - 1 <= level:
            return rounds
        # trees that have their root already go on as blocks of one node
        leaves = rounds[-1].select("tree", F.col("block").alias("index"), "size", F.col("tops")[0].alias("digest"), F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("string").alias("forged"))


def paths_of(nodes: list[list[str]], arity: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The steps from each node of the first level to the block's top: its place in the run and the others of the run."""
    for index in range(len(nodes[0])):
        steps, at = [], index
        for level in nodes[:-1]:
            first = at - at % arity
            steps.append((at - first, [d for i, d in enumerate(level[first : first + arity], first) if i != at]))
            at //= arity
        yield steps


def folded(digest: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its path give."""
    for place, others in steps:
        digest = hashed([*others[:place], digest, *others[place:]])
    return digest


def _along(blocks: DataFrame, above: DataFrame, schema: str, rows: Callable[[dict], dict[str, list]]) -> DataFrame:
    """rows(block with the path of its top) of every block; above has (tree, index, path), by index = block."""
    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1).to_pylist()[0]
                block["path"] = [(step["place"], step["others"]) for step in block["path"]]
                yield pa.RecordBatch.from_pydict(rows(block), schema=arrow)

    own = above.withColumnRenamed("tree", "top_tree")
    return blocks.join(small(own), (F.col("tree") == F.col("top_tree")) & (F.col("block") == F.col("index"))).select("tree", "block", "nodes", "payloads", "path").mapInArrow(run, target)


def lower_paths(blocks: DataFrame, above: DataFrame, arity: int, height: int) -> DataFrame:
    """(tree, index, path): the path to the root of each first node of the blocks."""

    def rows(block: dict) -> dict[str, list]:
        paths = [[{"place": p, "others": o} for p, o in steps + block["path"]] for steps in paths_of(block["nodes"], arity)]
        first = block["block"] * arity**height
        return {"tree": [block["tree"]] * len(paths), "index": list(range(first, first + len(paths))), "path": paths}

    return _along(blocks, above, f"tree long, index long, path array<{STEP}>", rows)


def proofs(blocks: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """(tree, id, leaf, proof_sha256, folded_root) of each leaf: its path is hashed, and folded with the forged leaf if there is one."""

    def rows(block: dict) -> dict[str, list]:
        out = {"tree": [], "id": [], "leaf": [], "proof_sha256": [], "folded_root": []}
        for leaf, payload, steps in zip(block["nodes"][0], block["payloads"], paths_of(block["nodes"], arity), strict=True):
            path = steps + block["path"]
            digest = hashed([d for _, others in path for d in others])
            for name, value in zip(out, (block["tree"], payload["id"], leaf, digest, folded(payload["forged"] or leaf, path)), strict=True):
                out[name].append(value)
        return out

    id_type = blocks.schema["payloads"].dataType.elementType["id"].dataType.simpleString()
    return _along(blocks, above, f"tree long, id {id_type}, leaf string, proof_sha256 string, folded_root string", rows)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields, each as its length in bytes and its value, or "-"."""
    return F.sha2(F.concat(*[_field(f) for f in fields]), 256)


def build_manifest(docs: DataFrame, forged: Column | None = None, forge: dict[str, Column] | None = None, id_column: str = "doc_id", tree_column: str = "lang", fields: tuple[str, ...] = FIELDS, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof_sha256, folded_root and verified.

    Where `forged` holds, the proof is folded with the leaf of a row whose columns are replaced as `forge` says.
    """
    values = {f: F.col(f) for f in fields}
    other = leaf_hash(list((values | (forge or {})).values()))
    rows = docs.select(F.col(id_column).alias("id"), F.col(tree_column).cast(StringType()).alias("name"), leaf_hash(list(values.values())).alias("digest"), F.when(forged, other).alias("forged") if forged is not None else F.lit(None).cast("string").alias("forged"))
    rows = written(rows, "merkle-leaves")
    placed, ranges = ranked(rows, F.col("name").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest"))
    # names are ordered by their bytes, as strings are
    trees = written(placed.groupBy("name").agg(F.count("*").alias("size"), F.min("place").alias("first")), "merkle-sizes")
    numbered, tree_ranges = ranked(trees, F.col("name").asc_nulls_first(), number="tree")
    numbered = written(numbered.withColumn("tree", F.col("tree") - 1).withColumnRenamed("name", "own"), "merkle-trees")
    leaves = placed.join(small(numbered), F.col("name").eqNullSafe(F.col("own")))
    leaves = written(leaves.select("tree", (F.col("place") - F.col("first")).alias("index"), "size", "digest", "id", "forged"), "merkle-placed")
    rounds = raise_trees(leaves, arity, height)

    # the roots of the trees are the leaves of the last tree
    n = numbered.count()
    roots = rounds[-1].select(F.col("tree").alias("index"), F.col("tops")[0].alias("digest"))
    tops = raise_trees(roots.select(F.lit(0).cast("long").alias("tree"), "index", F.lit(n).cast("long").alias("size"), "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("forged")), arity, height)
    root = tops[-1].select(F.col("tops")[0].alias("root"))
    paths = docs.sparkSession.sql("SELECT 0L AS tree, 0L AS index").withColumn("path", F.array().cast(f"array<{STEP}>"))
    made = [ranges, rows, trees, tree_ranges, numbered, leaves]
    for blocks in reversed(tops):
        paths = written(lower_paths(blocks, paths, arity, height), "merkle-paths")
        made.append(paths)
    paths = paths.select(F.col("index").alias("tree"), F.lit(0).cast("long").alias("index"), "path")
    for blocks in reversed(rounds[1:]):
        paths = written(lower_paths(blocks, paths, arity, height), "merkle-paths")
        made.append(paths)
    found = proofs(rounds[0], paths, arity).withColumnRenamed("tree", "at")
    found = found.join(small(written(roots.withColumnRenamed("digest", "subroot"), "merkle-roots")), F.col("at") == F.col("index")).crossJoin(F.broadcast(root))
    discard(rows, ranges, trees, tree_ranges, numbered, leaves)
    return found.select(F.col("id").alias(id_column), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
