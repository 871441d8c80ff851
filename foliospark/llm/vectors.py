"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Distances are angles. A node covers its members within its radius, which is the largest angle of its own members from its
center; two nodes whose centers are further apart than both radii and the threshold's angle hold no link. Radii halve from
level to level, so a group of near copies is a node of its own a few levels down, and meets unrelated ones as one center.
Vectors that are near no other are nodes of radius 0: for these the test of two centers is the test of the pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import components, text_buffer
from foliospark.llm.minhash import group_starts, runs
from foliospark.session import materialize, prepare, settled

_SLACK = 1e-6  # added to bounds, so that rounding never prunes a pair; pairs themselves are tested by cosine

_PART = 1024
_BLOCK = 256


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


class Node(NamedTuple):
    center: np.ndarray
    radius: float  # the largest angle of a member from the center
    members: np.ndarray
    children: list
    centers: np.ndarray  # of the children, or its own if it is a leaf, by row
    radii: np.ndarray
    single: np.ndarray  # whether a child is one vector


def _node(center: np.ndarray, radius: float, members: np.ndarray, children: list) -> Node:
    if not children:
        return Node(center, radius, members, children, center[None, :], np.array([radius]), np.array([len(members) == 1]))
    return Node(center, radius, members, children, np.array([c.center for c in children]), np.array([c.radius for c in children]), np.array([len(c.members) == 1 for c in children]))


def cover_tree(x: np.ndarray, leaf: int = 64) -> Node:
    """A tree of nested levels with halving radii over the unit vectors ``x``.

    The children of a node of radius r are centers among its members that are more than r / 2 apart, each with the
    members within r / 2 of it that no earlier center took. A node of ``leaf`` members or fewer whose radius is small is
    a leaf; a member that is alone is one of radius 0.
    """

    def build(center: np.ndarray, members: np.ndarray, far: np.ndarray) -> Node:
        radius = float(far.max(initial=0.0))
        if len(members) == 1 or len(members) <= leaf and radius <= 0.2:
            return _node(center, radius, members, [])
        if radius <= 0.1:  # too near each other for links to be ruled out; in parts, for memory
            parts = [slice(i, i + _PART) for i in range(0, len(members), _PART)]
            return _node(center, radius, members, [_node(center, float(far[s].max()), members[s], []) for s in parts] if len(parts) > 1 else [])
        children, rest, half = [], members, np.cos(radius / 2)
        while len(rest):
            first = x[rest[:_BLOCK]]  # the next centers, unless an earlier one takes them
            cosines, free = first @ x[rest].T, np.ones(len(rest), bool)
            for k, c in enumerate(first):
                if free[k]:
                    near = cosines[k] >= half
                    near &= free
                    near[k] = True
                    taken = np.flatnonzero(near)
                    children.append(build(c, rest[taken], angles(cosines[k][taken])))
                    free[taken] = False
            rest = rest[free]
        return _node(center, radius, members, children)

    everything = np.arange(len(x))
    return build(x[0], everything, angles(x @ x[0]))


class Tally:
    """How many pairs of centers a traversal tested, and of how many pairs of vectors the leaves it let through are."""

    def __init__(self) -> None:
        self.centers = self.pairs = 0


def dual_traversal(x: np.ndarray, a: Node, y: np.ndarray, b: Node, cosine: float, tally: Tally | None = None, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of index arrays (into x and y) of leaves that may hold linked vectors; all others are pruned.

    A tree against itself gives each leaf with itself, and other pairs of leaves both ways, or ``once`` (a single vector with itself then not at all).
    """
    for m, n in _pairs(a, b, float(np.arccos(cosine)) + _SLACK, tally or Tally(), once):
        yield m, n
        if a is b and m is not n and not once:
            yield n, m


def _pairs(a: Node, b: Node, reach: float, tally: Tally, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    same = a is b
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if not p.children and not q.children:
            tally.pairs += len(p.members) * len(q.members)
            yield p.members, q.members
            continue
        # the children of one or both against each other, in one product
        left, lr, ls = p.centers, p.radii, p.children or [p]
        right, rr, rs = q.centers, q.radii, q.children or [q]
        itself = same and p is q
        for lo in range(0, len(left), 512):
            meet = angles(left[lo : lo + 512] @ right.T) <= lr[lo : lo + 512, None] + rr[None, :] + reach
            if itself:
                meet &= np.arange(lo, lo + len(meet))[:, None] <= np.arange(len(right))[None, :]
            tally.centers += meet.size // (2 if itself else 1)
            i, j = np.nonzero(meet)
            i += lo
            lone = p.single[i] & q.single[j]
            if itself:
                lone &= i != j
            for u in np.unique(i[lone]).tolist():  # single vectors, those of one together
                tally.pairs += int((lone & (i == u)).sum())
                yield ls[u].members, np.concatenate([rs[v].members for v in j[lone & (i == u)].tolist()])
            stack += [(ls[u], rs[v]) for u, v in zip(i[~lone].tolist(), j[~lone].tolist(), strict=True) if not (once and itself and u == v and len(ls[u].members) == 1)]


def _prepare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key: digest of label and raw vector, null for rows that link with nothing; unit: its unit vector in doubles."""
    for batch in batches:
        n, lists, labels = batch.num_rows, batch.column("embedding"), batch.column("label").cast(pa.string())
        size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are nan
        at = np.cumsum(size) - size
        names = labels.to_pylist()
        keys: list[bytes | None] = [None] * n
        units: list[bytes | None] = [None] * n
        ok = (size > 0) & labels.is_valid().to_numpy(zero_copy_only=False)
        for dims in np.unique(size[ok]).tolist():
            rows = np.flatnonzero(ok & (size == dims))
            raw = flat[at[rows][:, None] + np.arange(dims)] + 0.0  # no minus zeros
            good = np.isfinite(raw).all(1) & raw.any(1)
            rows, raw = rows[good], raw[good]
            unit = raw / np.abs(raw).max(1)[:, None]
            unit /= np.sqrt((unit * unit).sum(1))[:, None]
            for k, i in enumerate(rows.tolist()):
                keys[i] = hashlib.sha256(names[i].encode() + b"\0" + raw[k].tobytes()).digest()
                units[i] = unit[k].tobytes()
        lengths = pa.array(size, pa.int32(), mask=np.array([k is None for k in keys], bool))
        yield pa.record_batch({"vec_id": batch.column("vec_id"), "label": labels, "dims": lengths, "key": pa.array(keys, pa.binary()), "unit": pa.array(units, pa.binary())})


Group = tuple[str, int]  # label and length


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[Group, np.ndarray, np.ndarray]]:
    """The rows of each group of a batch, and their unit vectors."""
    found: dict[Group, list[int]] = {}
    for i, g in enumerate(zip(batch.column("label").to_pylist(), batch.column("dims").to_pylist(), strict=True)):
        found.setdefault(g, []).append(i)
    for g, rows in found.items():
        units = text_buffer(batch.column("unit").take(pa.array(rows)))[0].view(np.float64)
        yield g, np.array(rows), units.reshape(len(rows), -1)


def _assign(pivots: dict[Group, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """cell: the nearest pivot; far: the angle to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.pi)
            for g, rows, x in _groups(batch):
                if g in pivots:
                    near = x @ pivots[g].T
                    cell[rows] = near.argmax(1)
                    far[rows] = angles(near.max(1))
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], [*batch.schema.names, "cell", "far"])

    return assign


def _visit(pivots: dict[Group, np.ndarray], radii: dict[Group, np.ndarray], reach: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """others: the later cells that may hold a vector linked with the row's.

    Such a cell's covering radius reaches it, and so does the plane halfway between the two pivots, beyond which all of
    the cell's vectors are; an earlier cell's vectors come to this one.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cell").to_numpy()
            others: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for g, rows, x in _groups(batch):
                if g not in pivots:
                    continue
                p, home = pivots[g], own[rows]
                near = x @ p.T
                between = np.sqrt(np.maximum(2.0 - 2.0 * (p @ p.T), 1e-30))
                plane = np.arcsin(np.clip((near[np.arange(len(rows)), home][:, None] - near) / between[home], -1.0, 1.0))
                go = (plane <= reach) & (angles(near) <= radii[g][None, :] + reach) & (np.arange(len(p))[None, :] > home[:, None])
                for i, k in zip(rows.tolist(), go, strict=True):
                    others[i] = np.flatnonzero(k).tolist()
            yield batch.append_column("others", pa.array(others, pa.list_(pa.int32())))

    return visit


def _join(cosine: float, leaf: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    keys = ["label", "dims", "at", "part"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            at = group_starts(t, keys)
            node, mult, side = t.column("key").to_pylist(), t.column("copies").to_numpy(), t.column("side").to_numpy()
            units = t.column("unit").combine_chunks()
            out_key, out_n, edge_a, edge_b = [], [], [], []
            tally, whole = Tally(), 0
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                here, guests = np.flatnonzero(side[i:j] == 0), np.flatnonzero(side[i:j] == 1)
                if not len(here) or j - i < 2:
                    continue
                x = text_buffer(units.slice(i, j - i))[0].view(np.float64).reshape(j - i, -1)
                whole += len(here) * (len(here) - 1) // 2 + len(here) * len(guests)
                links, root = np.zeros(j - i, np.int64), np.arange(j - i)
                p = cover_tree(x[here], leaf)
                sides = [(here, p)] + ([(guests, cover_tree(x[guests], leaf))] if len(guests) else [])
                for right, q in sides:
                    for m, n in dual_traversal(x[here], p, x[right], q, cosine, tally, once=True):
                        a, b = here[m], right[n]
                        hit = x[a] @ x[b].T >= cosine
                        itself = q is p and m is n
                        if itself:
                            np.fill_diagonal(hit, False)
                        if not hit.any():
                            continue
                        links[a] += hit @ mult[i:j][b]
                        if not itself:
                            links[b] += mult[i:j][a] @ hit
                        for r in np.flatnonzero(hit.any(1)):  # join the row's links with it: smallest root wins
                            mine = np.append(b[hit[r]], a[r])
                            old = np.unique(root[mine])
                            if len(old) > 1:
                                root[np.isin(root, old)] = old[0]
                for k in np.flatnonzero(links):
                    out_key.append(node[i + k])
                    out_n.append(int(links[k]))
                    edge_a.append(node[i + k])
                    edge_b.append(node[i + root[k]])
            # the last row says what was tested
            yield pa.record_batch({"key": pa.array([*out_key, None], pa.binary()), "n": pa.array([*out_n, whole], pa.int64()), "a": pa.array([*edge_a, None], pa.binary()), "b": pa.array([*edge_b, None], pa.binary()),
                                   "centers": pa.array([0] * len(out_key) + [tally.centers], pa.int64()), "pairs": pa.array([0] * len(out_key) + [tally.pairs], pa.int64())})

    return join


def vector_links(vectors: DataFrame, *, cosine: float = 0.93, cell: int = 2048, leaf: int = 64, sample: int = 4096) -> DataFrame:
    """(key, n, a, b, centers, pairs): per distinct vector of ``vectors`` (label, dims, key, unit, copies) and cell, links and an edge of the forest.

    Rows without a key say how many pairs a task had to decide (n), how many pairs of centers it tested for them, and of
    how many pairs of vectors the leaves were that it let through.

    Rows are dealt to cells of about ``cell`` vectors around pivots. Pivots are far apart from each other (farthest
    first, the order in which a cover tree nests its centers) and come from a sample of at most ``sample`` rows of
    least hash; every row goes to its nearest pivot, whichever rows the sample has. A cell whose rows are many more
    than ``cell`` is dealt by hash over several parts. A row also visits the later cells and parts that may hold a link of
    it, so each pair of linked vectors meets once.
    """
    total = vectors.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["label"], r["dims"]): r["n"] for r in total.orderBy(F.desc("n"), "label", "dims").limit(sample).collect()}
    picked: dict[Group, list[np.ndarray]] = {}
    for r in vectors.orderBy(F.xxhash64("key"), "key").limit(sample).select("label", "dims", "unit").collect():
        picked.setdefault((r["label"], r["dims"]), []).append(np.frombuffer(r["unit"]))
    pivots: dict[Group, np.ndarray] = {}
    for g, found in picked.items():
        x = np.array(found)
        want = min(len(x), -(-counts.get(g, 0) // cell))
        if want < 2:
            continue
        chosen, most = [0], x @ x[0]
        while len(chosen) < want and most.min() < 1.0 - 1e-12:
            chosen.append(int(np.argmin(most)))
            most = np.maximum(most, x @ x[chosen[-1]])
        pivots[g] = x[chosen]
    placed = materialize(vectors.mapInArrow(_assign(pivots), "label string, dims int, key binary, unit binary, copies bigint, cell int, far double"), "cells")
    stats = materialize(placed.groupBy("label", "dims", "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("radius")), "sizes")
    radii = {g: np.full(len(p), -np.pi) for g, p in pivots.items()}  # an empty cell has no visitors
    spark = vectors.sparkSession
    if pivots:  # no more groups or cells than sampled rows
        of = spark.createDataFrame(list(pivots), "label string, dims int")
        for r in stats.join(F.broadcast(of), ["label", "dims"], "left_semi").collect():
            radii[r["label"], r["dims"]][r["cell"]] = r["radius"]
    reach = float(np.arccos(cosine)) + _SLACK
    visitors = placed.mapInArrow(_visit(pivots, radii, reach), "label string, dims int, key binary, unit binary, copies bigint, cell int, far double, others array<int>")
    go = F.explode(F.concat(F.array(F.col("cell")), "others")).alias("at")
    parts = stats.select("label", "dims", F.col("cell").alias("at"), F.greatest(F.lit(1), F.ceil(F.col("rows") / (2 * cell)).cast("int")).alias("parts"))
    dealt = visitors.select("label", "dims", "key", "unit", "copies", "cell", go).join(parts, ["label", "dims", "at"])
    own = F.when(F.col("cell") == F.col("at"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).otherwise(0)
    dealt = dealt.withColumn("own", own).withColumn("part", F.explode(F.sequence("own", F.col("parts") - 1)))
    side = ((F.col("cell") != F.col("at")) | (F.col("part") > F.col("own"))).cast("int").alias("side")
    dealt = dealt.select("label", "dims", "at", "part", side, "key", "unit", "copies")
    schema = "key binary, n bigint, a binary, b binary, centers bigint, pairs bigint"
    return dealt.repartition("label", "dims", "at", "part").sortWithinPartitions("label", "dims", "at", "part").mapInArrow(_join(cosine, leaf), schema)


@settled
def vector_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, **options: int) -> DataFrame:
    """Groups of vectors of equal labels joined by links of cosine (in doubles) of ``cosine`` or more.

    Returns a row per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept (vec_id = component_id).
    Equal vectors are one while links are searched, and count as linked with each other. Vectors of different lengths
    are not linked. Null labels, null, zero or empty vectors and those with null or non-finite components have no
    links. Repeated rows: each counts. Null ids: never the smallest, kept null. Extra columns are ignored; an empty
    table gives an empty result.
    """
    prepare(vectors.sparkSession)
    base = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"), F.col(f"`{label_col}`").alias("label"))
    kind = base.schema["vec_id"].dataType.simpleString()
    rows = materialize(base.mapInArrow(_prepare_rows, f"vec_id {kind}, label string, dims int, key binary, unit binary"), "vectors")
    distinct = materialize(rows.where("key is not null").groupBy("label", "dims", "key").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies")), "distinct")
    found = materialize(vector_links(distinct, cosine=cosine, **options).where("key is not null"), "vector_links")
    n = found.groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(found.select("a", "b")).withColumnRenamed("node", "key")
    about = distinct.select("key", "copies").join(n, "key", "left").join(roots, "key", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("g"))
    linked = rows.where("key is not null").select("vec_id", "key").join(about, "key")
    linked = materialize(linked, "linked")
    # written, so that both sides of the join are plain exchanges, of which Spark splits a group's
    least = materialize(linked.groupBy("g").agg(F.min("vec_id").alias("least")), "least")
    out = linked.join(least, "g").select("vec_id", "n_links", F.col("least").alias("component_id"))
    out = out.unionByName(rows.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
