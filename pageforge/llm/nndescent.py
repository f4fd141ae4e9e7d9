"""Near-duplicate vectors by NN-descent (operator 4).

A first neighbour graph comes from rows that stand next to each other after sorting by random hyperplane codes.  Each
round then joins neighbours of neighbours: the members of a vertex's list are compared with one another, and better
edges go into their lists, until few change.  Lists keep the `LIST` best edges above a floor.  A list that is full of
edges at or above the threshold is saturated: it is enlarged to the vertex's whole provisional component, whose links are
counted by angles to a pivot and, where these leave it open, in blocks.  Links are decided on the original vectors in
double precision.  Only between two saturated vertices can a link be missing from both lists.  So the saturated
vertices descend again, with lists of edges out of their own component only, and the components that link are joined;
this goes on until no list holds a link.  An audit compares a fixed number of vertices with all rows by brute force; if
too few of their links were found, a further graph with other hyperplanes is added, and a last recall that is too low
is warned of.

Only vectors of one label and one length are compared.  Equal vectors are one vertex with a weight.  Vectors that are
null, empty, zero or hold null or non-finite components, and those without a label, link with nothing.  Repeated rows
are vectors of their own.  A null id has a null component and counts as kept.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageforge.llm.common import cut, drop, pick, shared_dir, shuffle_parts, signed, splitmix, table
from pageforge.llm.components import components
from pageforge.llm.vectors import matrix

THRESHOLD = 0.93
#: Length of neighbour lists, least similarity of an edge, rows that the sort links on each side, rounds at most, share
#: of the edges below which a round ends the descent.
LIST, FLOOR, NEXT, ROUNDS, FEW = 16, 0.6, 6, 5, 0.01
#: Rows of a block, vertices of the audit, its least recall, graphs at most.
BLOCK, AUDIT, RECALL, GRAPHS = 256, 200, 0.97, 3
#: How far an angle in double precision may be off.
SLACK = 1e-7


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of one length in double precision, divided by their lengths."""
    x = matrix(column)
    return x / np.sqrt((x**2).sum(1))[:, None]


FACTS = "vec_id long, label long, dim int, v {kind}, sound boolean, h1 long, h2 long"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a vector takes part, and two hashes of it: equal vectors have equal ones."""
    for b in batches:
        lists = b.column("v")
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
        sound, hashes = np.zeros(b.num_rows, bool), np.zeros((2, b.num_rows), np.uint64)
        for dim in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == dim)
            x = matrix(lists.take(pa.array(own))) + 0.0  # one zero, no negative one
            sound[own] = np.isfinite(x).all(1) & (x != 0).any(1)
            odd = np.random.default_rng([11, dim]).integers(1, 2**63, (dim, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            bits = splitmix(np.ascontiguousarray(x).view(np.uint64))
            for k in (0, 1):
                hashes[k, own] = splitmix((bits * odd[:, k]).sum(1, dtype=np.uint64))
        fine = b.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & b.column("label").is_valid().to_numpy(zero_copy_only=False)
        cols = [b.column("vec_id"), b.column("label"), pa.array(size), lists, pa.array(sound & fine), *(pa.array(signed(h)) for h in hashes)]
        yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "dim", "v", "sound", "h1", "h2"])


def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables, bits + 1))


def _codes(batches: Iterator[pa.RecordBatch], tables: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Each vertex once for each table: the code of its signs, and its place along one more direction."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            x = _units(part.column("v"))
            spots = np.einsum("nd,dtb->ntb", x, _planes(int(dim), tables, bits, seed), optimize=True)
            code = ((spots[:, :, :bits] > 0) << np.arange(bits)).sum(2).astype(np.int64)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("dim"), pa.array(code[:, t] * tables + t), pa.array(spots[:, t, bits]), part.column("id"), part.column("v"), part.column("own")],
                    ["label", "dim", "code", "spot", "id", "v", "own"],
                )


def _beside(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Edges between sorted rows of different components that stand near each other in one bucket."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks().to_batches()[0]
        carried = held.num_rows if held is not None else 0
        keys = [rows.column(c).to_numpy() for c in ("label", "dim", "code")]
        ids, comp = (rows.column(c).to_numpy() for c in ("id", "own"))
        flat = rows.column("v").flatten().to_numpy().astype(np.float64)
        dims = keys[1].astype(np.int64)
        out = []
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            ends = np.cumsum(dims)
            x = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
            x /= np.sqrt((x**2).sum(1))[:, None]
            for step in range(1, NEXT + 1):
                a, b = np.arange(len(own) - step), np.arange(step, len(own))
                good = (own[b] - own[a] == step) & (own[b] >= carried) & (comp[own[a]] != comp[own[b]])
                for k in keys:
                    good &= k[own[a]] == k[own[b]]
                a, b = a[good], b[good]
                near = np.einsum("nd,nd->n", x[a], x[b])
                keep = near >= floor
                out.append((ids[own[a[keep]]], ids[own[b[keep]]], near[keep]))
        held = rows.slice(max(0, rows.num_rows - NEXT))
        a, b, near = (np.concatenate([o[i] for o in out]) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(near)], ["a", "b", "near"])


def _lists(edges: DataFrame) -> DataFrame:
    """The best edges of each vertex (v, u, near, new), from edges (a, b, near, new) in either direction."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "near", "new").union(edges.select(F.col("b").alias("v"), F.col("a").alias("u"), "near", "new"))
    both = both.where("v <> u").groupBy("v", "u").agg(F.max("near").alias("near"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("near"), "u"))
    return both.withColumn("rank", rank).where(F.col("rank") <= LIST).drop("rank")


def _meet(groups: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """The members of each list compared with one another: edges that a member's list lacks and has a place for."""
    for batch in groups:
        out = []
        for members in batch.column("members"):
            rows = members.values
            _, once = np.unique(rows.field("u").to_numpy(), return_index=True)  # who lists and is listed comes twice
            rows = rows.take(pa.array(once))
            ids, own, low = (rows.field(c).to_numpy() for c in ("u", "own", "low"))
            x = _units(rows.field("v"))
            near = x @ x.T
            held = rows.field("held")
            has = np.zeros(near.shape, bool)
            owner = np.repeat(np.arange(len(ids)), np.diff(held.offsets.to_numpy()))
            spot, place = np.nonzero(held.flatten().to_numpy()[:, None] == ids)
            has[owner[spot], place] = True
            wanted = (near > low[:, None]) & ~has
            a, b = np.nonzero(np.triu((near >= floor) & (wanted | wanted.T) & (own[:, None] != own), 1))
            out.append((ids[a], ids[b], near[a, b]))
        if out:
            a, b, near = (np.concatenate([o[i] for o in out]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(near)], ["a", "b", "near"])


EDGE = "a long, b long, near double"


def graph(vertices: DataFrame, where: str, name: str, n: int, seed: int, threshold: float, floor: float = FLOOR) -> DataFrame:
    """Neighbour lists (v, u, near) of `n` vertices by one sort and rounds of NN-descent: no edge inside one `own`."""
    spark = vertices.sparkSession
    bits = int(np.clip(np.log2(max(n, 1) / 80), 1, 24))
    tables = int(min(64, max(16, np.ceil(5 / (1 - np.arccos(threshold) / np.pi) ** bits))))
    kind = vertices.schema["v"].dataType.simpleString()
    coded = vertices.mapInArrow(partial(_codes, tables=tables, bits=bits, seed=seed), f"label long, dim int, code long, spot double, id long, v {kind}, own long")
    keys = ("label", "dim", "code", "spot", "id")
    # Sorted by range, a bucket of any size is spread over tasks; edges across a border of tasks are found in other tables.
    edges = coded.repartitionByRange(2 * shuffle_parts(spark), *keys).sortWithinPartitions(*keys).mapInArrow(partial(_beside, floor=floor), EDGE)
    lists = cut(_lists(edges.withColumn("new", F.lit(True))), where, f"{name}-0")
    for step in range(1, ROUNDS + 1):
        known = lists.select(F.col("v").alias("at"), "u").union(lists.select(F.col("u").alias("at"), F.col("v").alias("u")))
        # Who lists a vertex that many list is dealt by hash into groups of about two lists, so that no group is large.
        hubs = lists.groupBy(F.col("u").alias("at")).count().where(F.col("count") > 2 * LIST).select("at", F.ceil((F.col("count") + LIST) / (2 * LIST)).alias("parts"))
        known = known.join(hubs, "at", "left").select("at", "u", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).alias("part"))
        own = lists.groupBy(F.col("v").alias("id")).agg(F.collect_list("u").alias("held"), F.min("near").alias("least"))  # LIST at most
        own = vertices.select("id", "v", "own").join(own, "id", "left")
        low = F.when(F.size("held") >= LIST, F.col("least")).otherwise(floor)
        state = own.select(F.col("id").alias("u"), "v", "own", low.alias("low"), F.coalesce("held", F.array().cast("array<long>")).alias("held"))
        met = known.join(state, "u")
        met = met.groupBy("at", "part").agg(F.collect_list(F.struct("u", "v", "own", "low", "held")).alias("members")).where(F.size("members") > 1)
        new = met.select("members").mapInArrow(partial(_meet, floor=floor), EDGE).withColumn("new", F.lit(True))
        old = lists.select(F.col("v").alias("a"), F.col("u").alias("b"), "near", F.lit(False).alias("new"))
        lists = cut(_lists(new.union(old)), where, f"{name}-{step}")
        drop(spark, where, f"{name}-{step - 1}")
        changed = lists.agg(F.count_if("new").alias("new"), F.count("*").alias("all")).first()
        if changed["new"] <= FEW * changed["all"]:
            break
    return lists.drop("new")


def _cosine(x: Column, y: Column) -> Column:
    """In double precision, of the vectors as they are."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda m, n: m.cast("double") * n.cast("double")), F.lit(0.0), lambda s, m: s + m)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def _strong(lists: DataFrame, where: str, name: str, threshold: float) -> DataFrame:
    """The links (a, b) among edges (v, u, near)."""
    return cut(lists.where(F.col("near") >= threshold).select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct(), where, name)


def _across(f: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the outer rows of one block and all rows of another, by weight; inner rows of the second get theirs too."""
    x, y = f[f["asks"]], f[~f["asks"]]
    if not len(x) or not len(y):
        return pd.DataFrame({"id": [], "n": []})
    p, q = (np.stack(g["v"].to_numpy()).astype(np.float64) for g in (x, y))
    near = (p @ q.T) / np.sqrt((p**2).sum(1))[:, None] / np.sqrt((q**2).sum(1)) >= threshold
    near &= x["id"].to_numpy()[:, None] != y["id"].to_numpy()
    inner = y["inner"].to_numpy()
    return pd.DataFrame({"id": np.concatenate([x["id"], y["id"][inner]]), "n": np.concatenate([near @ y["w"].to_numpy(), near[:, inner].T @ x["w"].to_numpy()])})


def _counted(members: DataFrame, where: str, name: str, threshold: float) -> DataFrame:
    """(id, n) for the members (component, id, v, w) of components with saturated lists: n by weight of those linked.

    The angle d to the component's pivot, its first vertex, decides most pairs: two vectors with d of at most half the
    threshold's angle are linked, so the weights of these inner ones are only added up; two whose d differ by more than
    the whole angle are not.  What is left, outer vectors against those in their ring of d and the rings beside it, is
    compared in blocks.
    """
    angle = float(np.arccos(threshold))
    pivots = members.where("id = component").select("component", F.col("v").alias("pivot"))
    d = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _cosine(F.col("v"), F.col("pivot")))))
    rows = members.join(pivots, "component").withColumn("d", d).drop("pivot")
    rows = rows.withColumns({"inner": F.col("d") <= angle / 2 - SLACK, "ring": F.floor(F.col("d") / (angle + SLACK)).cast("int")})
    rows = cut(rows, where, f"{name}-rings")
    inside = rows.groupBy("component").agg(F.sum(F.when(F.col("inner"), F.col("w"))).alias("all"))
    base = rows.where("inner").join(inside, "component").select("id", (F.col("all") - F.col("w")).alias("n"))
    sizes = rows.groupBy("component", "ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count_if(~F.col("inner")).alias("outer"))
    sizes = cut(sizes, where, f"{name}-sizes")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = rows.join(sizes, ["component", "ring"]).withColumn("block", block).drop("d", "blocks", "outer")
    beside = F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1))
    blocks = lambda ring, blk, some: sizes.where(some).select("component", F.col("ring").alias(ring), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(blk))
    asks = placed.where("not inner").select("component", "id", "v", "w", "inner", F.col("ring").alias("i"), F.col("block").alias("ib"), beside.alias("j")).join(blocks("j", "jb", "true"), ["component", "j"]).withColumn("asks", F.lit(True))
    answers = placed.select("component", "id", "v", "w", "inner", F.col("ring").alias("j"), F.col("block").alias("jb"), beside.alias("i")).join(blocks("i", "ib", "outer > 0"), ["component", "i"]).withColumn("asks", F.lit(False))
    more = asks.unionByName(answers).groupBy("component", "i", "ib", "j", "jb").applyInPandas(lambda f: _across(f, threshold), "id long, n double")
    out = base.union(more.select("id", F.col("n").cast("long"))).groupBy("id").agg(F.sum("n").alias("n"))
    return out


def _joined(vertices: DataFrame, strong: DataFrame, full: DataFrame, where: str, name: str, seed: int, threshold: float) -> DataFrame:
    """(node, component) of links, joined by the links between saturated vertices that their lists have no place for."""
    step = 0
    while True:
        parts = components(strong, where, f"{name}-component{step}")
        apart = vertices.drop("own").join(parts.join(full, "node").select(F.col("node").alias("id"), F.col("component").alias("own")), "id")
        apart = cut(apart, where, f"{name}-apart{step}")
        several = apart.groupBy("label", "dim").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("label", "dim")
        apart = apart.join(several, ["label", "dim"])
        n = apart.count()
        if not n:
            return parts
        met = _strong(graph(apart, where, f"{name}-across{step}", n, GRAPHS * (step + 1) + seed, threshold), where, f"{name}-met{step}", threshold)
        if met.isEmpty():
            return parts
        strong = strong.union(met)
        step += 1


def _found(vertices: DataFrame, lists: DataFrame, where: str, name: str, seed: int, threshold: float) -> DataFrame:
    """(id, n, component) of the vertices that link: n by weight of the others."""
    strong = _strong(lists, where, f"{name}-strong", threshold)
    full = lists.where(F.col("near") >= threshold).groupBy("v").count().where(F.col("count") >= LIST).select(F.col("v").alias("node"))
    full = cut(full, where, f"{name}-full")
    parts = _joined(vertices, strong, full, where, name, seed, threshold)
    large = cut(parts.join(full, "node").select("component").distinct(), where, f"{name}-large")
    # Components without a saturated list: their lists hold all their edges.
    w = vertices.select(F.col("id").alias("u"), "w")
    ends = strong.select(F.col("a").alias("id"), F.col("b").alias("u")).union(strong.select(F.col("b").alias("id"), F.col("a").alias("u")))
    ends = ends.join(parts.select(F.col("node").alias("id"), "component"), "id").join(large, "component", "left_anti")
    few = ends.join(w, "u").groupBy("id").agg(F.sum("w").alias("n"))
    # The others' lists, enlarged to the component.
    members = parts.join(large, "component").select("component", F.col("node").alias("id")).join(vertices.select("id", "v", "w"), "id")
    many = _counted(members, where, name, threshold)
    return cut(few.union(many).join(parts.withColumnRenamed("node", "id"), "id"), where, f"{name}-found")


def audit(vertices: DataFrame, found: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """The share of the true links that were found, of a fixed number of vertices, against all rows."""
    asked = vertices.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample).select("id", "label", "dim", "v").collect()
    ids, labels, dims = (np.array([r[c] for r in asked]) for c in ("id", "label", "dim"))
    rows = [np.array(r["v"], np.float64) for r in asked]

    def count(batches):
        for b in batches:
            out = np.zeros(len(ids), np.int64)
            bl, bd, bi, bw = (b.column(c).to_numpy() for c in ("label", "dim", "id", "w"))
            for dim in np.unique(bd):
                mine, theirs = np.flatnonzero(bd == dim), np.flatnonzero(dims == dim)
                if not len(theirs):
                    continue
                x = matrix(b.filter(pa.array(bd == dim)).column("v"))
                y = np.stack([rows[k] for k in theirs])
                near = (x @ y.T) / np.sqrt((x**2).sum(1))[:, None] / np.sqrt((y**2).sum(1)) >= threshold
                near &= (bl[mine][:, None] == labels[theirs]) & (bi[mine][:, None] != ids[theirs])
                out[theirs] += bw[mine] @ near
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out)], ["id", "true"])

    if not asked:
        return 1.0
    true = vertices.select("id", "label", "dim", "v", "w").mapInArrow(count, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    both = true.join(found.select("id", "n"), "id", "left").agg(F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("hit"), F.sum("true").alias("all")).first()
    return both["hit"] / both["all"] if both["all"] else 1.0


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", where: str | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, and the audit's recall."""
    spark = df.sparkSession
    where = where or shared_dir(spark)
    rows = pick(df, vec_id=vec_id, v=embedding, label=label).withColumn("label", F.when(F.col("label").isNotNull(), F.xxhash64("label")))
    rows = cut(rows.mapInArrow(_facts, FACTS.format(kind=rows.schema["v"].dataType.simpleString())), where, "rows")
    # Rows with equal vectors and labels are one vertex, named by the smallest id.
    sound = rows.where("sound")
    key = ["h1", "h2", "label", "dim"]
    vertices = sound.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.min_by("v", "vec_id").alias("v"))
    vertices = cut(vertices.withColumn("own", F.col("id")), where, "vertices")
    n = vertices.count()
    lists, recall = None, 0.0
    for seed in range(GRAPHS):
        new = graph(vertices, where, f"graph{seed}", n, seed, threshold)
        if lists is not None:
            new = cut(_lists(new.union(lists).select(F.col("v").alias("a"), F.col("u").alias("b"), "near", F.lit(False).alias("new"))).drop("new"), where, f"graph{seed}-joined")
        lists = new
        found = _found(vertices, lists, where, f"found{seed}", seed, threshold)
        recall = audit(vertices, found, threshold)
        if recall >= RECALL:
            break
    else:
        warnings.warn(f"the audit found {recall:.3f} of the links after {GRAPHS} graphs, less than {RECALL}", stacklevel=2)
    held = sound.select("vec_id", *key).join(vertices.select(*key, "id", "w"), key).join(found, "id", "left")
    linked = held.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audit_recall", F.lit(float(recall)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
