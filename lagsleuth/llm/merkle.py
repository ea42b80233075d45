"""Merkle manifest of a dataset: a tree of digests for each group, and one over the groups, with proofs for every row.

A row's leaf is the digest of its columns. Leaves of a group are numbered in order; while several nodes remain, every ARITY
consecutive ones (the last run: fewer, even one) become the digest of their joined hex digests. The groups' roots, in order of the
group column, make the root of the dataset in the same way.

Nodes are kept in append logs. A builder owns an aligned block of a span of ARITY ** HEIGHT nodes and writes each node when it is
complete, children before parents (postorder). So the place of a node follows from the sizes of the subtrees before it
(`position`), and a proof reads the siblings at such places. The blocks' last nodes are the leaves of the next round's blocks;
a group of n rows takes log(n) / log(span) rounds, and no task ever holds more than a span of rows of one group. Proofs go the other
way: the blocks of the last round hand each child block its path to the root, one row for each block.

Cases: a null value has a digest of its own (`-`), unlike that of an empty one; rows without a group are a group, which comes first;
rows of one id are ordered by their leaves, and rows without id come first; equal rows are so many leaves; an empty table has no
rows and no root; other columns, whatever their names, play no part. Numbers are read as decimals, texts as UTF-8.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.storage import materialize
from .common import arrow_types, part_count, slices

ARITY = 16
HEIGHT = 2
WIDTH = 32
ROW_BYTES = 128
PART_BYTES = 64 << 20


def digest(nodes: list[bytes]) -> bytes:
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


def position(level: int, j: int, n: int, arity: int = ARITY) -> int:
    """Place of node j of a level in the log of n leaves: its last leaf, all nodes complete before that leaf, and the levels between."""
    last, before = min((j + 1) * arity**level, n) - 1, 0
    k = last
    while k:
        before += k
        k //= arity
    return before + level


def levels(n: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree of n leaves."""
    found = 0
    while n > 1:
        n, found = -(-n // arity), found + 1
    return found


def append_nodes(leaves: list[bytes], height: int, arity: int = ARITY) -> list[bytes]:
    """The log of an aligned block: each leaf, and behind it the nodes that it completes."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(height)]
    for i, node in enumerate(leaves):
        log.append(node)
        for run in waiting:
            run.append(node)
            if len(run) < arity and i < len(leaves) - 1:
                break
            node = digest(run)
            run.clear()
            log.append(node)
    return log


@dataclass
class Step:
    """One level of a path: the node's place in its run, and the digests of the run's others."""

    place: int
    others: list[bytes]


def pack(path: list[Step]) -> bytes:
    return b"".join(bytes([s.place, len(s.others)]) + b"".join(s.others) for s in path)


def unpack(path: bytes) -> list[Step]:
    out, at = [], 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        out.append(Step(place, [path[at + 2 + WIDTH * k : at + 2 + WIDTH * (k + 1)] for k in range(n)]))
        at += 2 + WIDTH * n
    return out


def fold(node: bytes, path: list[Step]) -> bytes:
    """The root that a leaf and its siblings give."""
    for s in path:
        node = digest(s.others[: s.place] + [node] + s.others[s.place :])
    return node


def siblings_digest(path: list[Step]) -> str:
    return sha256("".join(n.hex() for s in path for n in s.others).encode()).hexdigest()


class Block:
    """The log of one block of `n` leaves, read by place."""

    def __init__(self, log: bytes, n: int, height: int):
        self.log, self.n, self.height = log, n, height

    def node(self, level: int, j: int) -> bytes:
        at = WIDTH * position(level, j, self.n)
        return self.log[at : at + WIDTH]

    def step(self, level: int, j: int) -> Step:
        size = -(-self.n // ARITY**level)
        first = j - j % ARITY
        return Step(j % ARITY, [self.node(level, k) for k in range(first, min(first + ARITY, size)) if k != j])

    def paths(self):
        """The path of each leaf to the last node, in order; steps of inner nodes are made once."""
        inner = {(level, j): self.step(level, j) for level in range(1, self.height) for j in range(-(-self.n // ARITY**level))}
        for i in range(self.n):
            yield [self.step(0, i)] * (self.height > 0) + [inner[level, i // ARITY**level] for level in range(1, self.height)]


def text_digest(columns, changed: dict | None = None) -> F.Column:
    """Hex sha256 of the columns, each `-` if null, else its UTF-8 size, a colon and its text."""
    parts = []
    for c in columns:
        v = (changed or {}).get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Adds i, the place in the key's order (from 0), and n, the key's rows; also (key, n). Ranges are sorted by tasks; only
    one count for each key and range is summed up over a key. `rows` is a stored table."""
    dealt = rows.repartitionByRange(parts_of(rows), key, *order).sortWithinPartitions(key, *order)
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select("*", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n")), "counts")
    joined = placed.join(counts, (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    out = joined.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("i"), "n")
    return out, counts.groupBy(F.col("_key").alias(key)).agg(F.first("n").alias("n"))


def parts_of(stored: DataFrame) -> int:
    return part_count(stored.sparkSession, stored.count() * ROW_BYTES, PART_BYTES)


def in_blocks(run, b: pa.RecordBatch, held: list):
    """Rows come sorted by (tree, block): calls run for each whole block, and keeps the last one until the next batch."""
    for row in b.to_pylist():
        if held and (held[0]["tree"], held[0]["block"]) != (row["tree"], row["block"]):
            yield run(held)
            held.clear()
        held.append(row)


def build_round(nodes: DataFrame, carried: list[str], parts: int, tall: int) -> DataFrame:
    """(tree, i, n, node, carried) -> (tree, block, n, size, height, log, lists of carried), a row for each block."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    dealt = nodes.withColumn("block", F.expr(f"i div {ARITY**tall}")).repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "i")

    def one(rows):
        height = min(tall, levels(rows[0]["n"]))
        log = b"".join(append_nodes([r["node"] for r in rows], height))
        return [rows[0]["tree"], rows[0]["block"], rows[0]["n"], len(rows), height, log, *([r[c] for r in rows] for c in carried)]

    names = ["tree", "block", "n", "size", "height", "log", *carried]

    def run(batches):
        held: list = []
        for b in batches:
            kinds_of = {c: b.schema.field(c).type for c in carried}
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *(pa.list_(kinds_of[c]) for c in carried)]
            made = list(in_blocks(one, b, held))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one(held), types, strict=True)], names=names)

    schema = "tree long, block long, n long, size int, height int, log binary" + "".join(f", {c} array<{kinds[c]}>" for c in carried)
    return dealt.select("tree", "block", "i", "n", "node", *carried).mapInArrow(run, schema)


def build(nodes: DataFrame, most: int, carried: list[str], parts: int, tall: int) -> list[DataFrame]:
    """The logs of all rounds of trees with at most `most` leaves: in the log of a block, the last node is its root."""
    span = ARITY**tall
    rounds = [materialize(build_round(nodes, carried, parts, tall), "log")]
    while most > span:
        most = -(-most // span)
        nodes = rounds[-1].where(F.col("n") > span).select("tree", F.col("block").alias("i"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), root_of().alias("node"))
        rounds.append(materialize(build_round(nodes, [], parts_of(rounds[-1]), tall), "log"))
    return rounds


def root_of() -> F.Column:
    return F.substring("log", F.length("log") - WIDTH + 1, F.lit(WIDTH))


def tree_roots(rounds: list[DataFrame], span: int) -> DataFrame:
    return reduce(DataFrame.unionAll, [r.where(F.col("n") <= span).select("tree", root_of().alias("node")) for r in rounds])


def open_round(blocks: DataFrame, above: DataFrame, emit, schema: str, columns: list[str]) -> DataFrame:
    """Joins each block with the path of its root, and gives the arrays that `emit(row, paths)` makes of them."""

    types = out_types(schema)

    def run(batches):
        for row in (row for b in batches for piece in slices(b) for row in piece.to_pylist()):
            block, end = Block(row["log"], row["size"], row["height"]), unpack(row["path"])
            made = emit(row, [p + end for p in block.paths()])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types.values(), strict=True)], names=list(types))

    return blocks.join(above, ["tree", "block"]).select("tree", "block", "size", "height", "log", "path", *columns).mapInArrow(run, schema)


def out_types(schema: str) -> dict[str, pa.DataType]:
    made = T.StructType.fromDDL(schema)
    return dict(zip(made.names, arrow_types(made), strict=True))


def hand_down(span: int):
    """To each leaf of a block its path, as the path of a block of the round below."""

    def emit(row, paths):
        first = row["block"] * span
        return [[row["tree"]] * len(paths), list(range(first, first + len(paths))), [pack(p) for p in paths]]

    return emit


def paths_to_base(rounds: list[DataFrame], tops: DataFrame, span: int) -> DataFrame:
    """(tree, block, path) for the blocks of the first round, from (tree, path) of the trees' roots."""
    ends = [r.where(F.col("n") <= span).select("tree", "block").join(tops, "tree") for r in rounds]
    above = ends[-1]
    for r, own in zip(rounds[:0:-1], ends[-2::-1], strict=True):
        above = own.unionAll(open_round(r, above, hand_down(span), "tree long, block long, path binary", []))
    return above


@dataclass
class Manifest:
    """rounds: logs of the groups' trees; top: logs of the tree over the groups; groups: (group, tree, subroot)."""

    rounds: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame
    root: str | None
    carried: list[str]
    span: int


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, altered: F.Column | None = None, height: int = HEIGHT) -> Manifest:
    """Trees over all rows. `altered`, if given: hex digest of a row as it is now (null: as it was), kept beside its leaf."""
    rows = docs.select(F.col(group).alias("own_group"), F.col(key).alias("own_key"), F.unhex(text_digest(columns)).alias("node"),
                       F.unhex(altered if altered is not None else F.lit(None).cast("string")).alias("altered"))
    rows = materialize(rows, "leaves")
    places, groups = numbered(rows, "own_group", ["own_key", "node", "altered"])
    groups = materialize(groups, "groups")
    total, most = groups.agg(F.count("*"), F.max("n")).first()
    trees, _ = numbered(groups.select("own_group", F.lit(0).alias("all")), "all", ["own_group"])
    trees = materialize(trees.select(F.col("own_group").alias("of"), F.col("i").alias("tree")), "trees")
    carried = ["own_key", "altered"]
    nodes = places.join(trees, F.col("own_group").eqNullSafe(F.col("of"))).select("tree", "i", "n", "node", *carried)
    rounds = build(nodes, most or 0, carried, parts_of(rows), height)
    subroots = materialize(tree_roots(rounds, ARITY**height), "subroots")
    ends = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(total).cast("long").alias("n"), "node")
    top = build(ends, total, [], parts_of(subroots), height)
    root = tree_roots(top, ARITY**height).select(F.lower(F.hex("node"))).first()
    return Manifest(rounds, top, trees.join(subroots, "tree").select("of", "tree", F.lower(F.hex("node")).alias("subroot")), root[0] if root else None, carried, ARITY**height)


def group_paths(m: Manifest) -> DataFrame:
    """(tree, path): from each group's root to the root of all."""
    start = m.groups.sparkSession.range(1).select(F.col("id").alias("tree"), F.lit(b"").alias("path"))
    base = paths_to_base(m.top, start, m.span)
    found = open_round(m.top[0], base, hand_down(m.span), "tree long, block long, path binary", [])
    return materialize(found.select(F.col("block").alias("tree"), "path"), "paths")


def leaf_rows(m: Manifest, emit, more: str) -> DataFrame:
    """One row for each leaf: its key, place in the group's log, leaf, subroot, and what emit makes of (leaf, altered, path)."""
    kind = m.rounds[0].schema["own_key"].dataType.elementType.simpleString()
    base = paths_to_base(m.rounds, group_paths(m), m.span) if m.root else m.rounds[0].select("tree", "block", F.lit(b"").alias("path"))
    span = m.span
    rooted = m.rounds[0].join(m.groups.select("tree", "subroot", "of"), "tree")

    def rows(row, paths):
        block = Block(row["log"], row["size"], row["height"])
        leaves = [block.node(0, i) for i in range(block.n)]
        first = row["block"] * span
        made = [emit(leaf, new, path) for leaf, new, path in zip(leaves, row["altered"], paths, strict=True)]
        return [row["own_key"], [row["of"]] * len(paths), [position(0, first + i, first + i + 1) for i in range(block.n)], [x.hex() for x in leaves],
                [row["subroot"]] * len(paths), *zip(*made, strict=True)]

    group = m.groups.schema["of"].dataType.simpleString()
    return open_round(rooted, base, rows, f"own_key {kind}, own_group {group}, log_position long, leaf string, subroot string, {more}", ["subroot", "of", *m.carried])


def proofs(m: Manifest) -> DataFrame:
    """The proof of each row, packed (`unpack`, `fold`)."""
    return leaf_rows(m, lambda leaf, new, path: (pack(path),), "proof binary").withColumn("root", F.lit(m.root).cast("string"))


def verified(m: Manifest) -> DataFrame:
    """Each row's proof, shortened to a digest, the root that its present digest gives, and whether it is that of the manifest."""
    out = leaf_rows(m, lambda leaf, new, path: (siblings_digest(path), fold(new or leaf, path).hex()), "proof_sha256 string, folded_root string")
    return out.withColumn("root", F.lit(m.root).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))
