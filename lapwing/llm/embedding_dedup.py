"""Near-duplicate embeddings by an exact metric range join: pivots part the vectors, the triangle inequality sets what is replicated.

Vectors of length one are at cosine c or more exactly if they are at distance r = sqrt(2 - 2 c) or less. Equal vectors are one
class with a count. Pivots come from a bounded sample, in two kinds:

* Balls of radius r / 2 around dense places. All vectors of a ball are links of one another by the triangle inequality, so they are
  counted and never compared; only vectors at up to 3 r / 2 from a ball's centre can link to a part of it.
* Cells of what lies in no ball: each vector is at home with its nearest pivot. A vector may link into another cell only if it is
  within r of the plane halfway between the two pivots, and within r of that cell's farthest vector as seen from its pivot.

Balls and cells are numbered, and a vector is a guest only where the number is smaller than that of its home, so a pair meets once.
Balls and cells are joined independently, in blocks of bounded size, so that no task holds a whole one. What leaves a task is a
count and a root for each vector, not pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import BROADCAST_IDS, components, drop_path, saved, shared_dir, table

COSINE = 0.93
#: Distinct vectors that pivots are taken from. Any pivots give the same links; only the work depends on them.
SAMPLE = 4096
#: Balls and cells at most; a ball needs this many vectors of the sample.
BALLS, CELLS, DENSE = 256, 64, 3
#: Vectors of a block: a task compares at most two blocks.
BLOCK = 8192
STRIP = 512
#: Far above the error of a distance in double precision, far below any distance that matters. Bounds are widened by it.
SLACK = 1e-7


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dims, name, unit) of every row: the vector at length one as bytes of doubles and a 128-bit name of these.

    Name and unit are null for vectors that link with nothing: null, empty or zero ones, null labels, null or non-finite components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, units, dims = [], [], []
            for label, cell in zip(batch.column(1), batch.column(2)):
                unit = None
                if label.is_valid and cell.is_valid and cell.values.null_count == 0:
                    x = cell.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    most = np.abs(x).max(initial=0.0)
                    if 0 < most < math.inf:  # false for nan too
                        x = x / most
                        unit = x / math.sqrt(x @ x) + 0.0  # no negative zeros
                dims.append(None if unit is None else len(unit))
                units.append(None if unit is None else unit.tobytes())
                names.append(None if unit is None else hashlib.blake2b(units[-1], digest_size=16).digest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(names, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "label", "dims", "name", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label long, dims int, name binary, unit binary")


def pivots(sample: np.ndarray, cells: int, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(centres of balls, pivots of cells) for a sample of unit vectors: dense places first, then vectors far from one another."""
    near = sample @ sample.T >= 1 - r * r / 2
    open_, centres = np.ones(len(sample), bool), []
    for k in np.argsort(-near.sum(1), kind="stable").tolist():
        if len(centres) == BALLS or near[k].sum() < DENSE:
            break
        if open_[k]:
            centre = sample[near[k]].mean(0)
            for _ in range(2):  # towards the middle of what is around
                centre = centre / math.sqrt(centre @ centre)
                around = sample[sample @ centre >= 1 - r * r / 2]
                centre = around.mean(0) if len(around) else centre
            centre = centre / math.sqrt(centre @ centre)
            inside = sample @ centre >= 1 - r * r / 8
            if (inside & open_).sum() >= DENSE:
                centres.append(centre)
                open_ &= ~inside
            open_[k] = False
    spread = sample[open_] if open_.any() else sample
    chosen, nearest = [0], 2 - 2 * spread @ spread[0]
    while len(chosen) < cells and nearest.max() > r * r:  # the farthest from those chosen
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, 2 - 2 * spread @ spread[chosen[-1]])
    return np.array(centres).reshape(len(centres), sample.shape[1]), spread[chosen]


def homes_and_guests(x: np.ndarray, balls: np.ndarray, cells: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(home of each row of x, its distance there, then row, place and distance of each guest); places are balls, then cells."""
    to_balls = np.sqrt(np.maximum(2 - 2 * x @ balls.T, 0))
    to_cells = np.sqrt(np.maximum(2 - 2 * x @ cells.T, 0))
    cell = to_cells.argmin(1)
    home, at = len(balls) + cell, to_cells.min(1)
    in_ball = np.zeros(len(x), bool)
    if len(balls):
        ball = to_balls.argmin(1)
        in_ball = to_balls.min(1) <= r / 2 - SLACK
        home[in_ball], at[in_ball] = ball[in_ball], to_balls.min(1)[in_ball]
    row, place = np.nonzero((to_balls <= 1.5 * r + SLACK) & (np.arange(len(balls)) < home[:, None]))
    apart = np.sqrt(np.maximum(2 - 2 * cells @ cells.T, 0))[cell]
    beyond = (to_cells**2 - to_cells.min(1)[:, None] ** 2) <= 2 * (r + SLACK) * apart + SLACK
    row2, place2 = np.nonzero(beyond & (np.arange(len(cells)) < cell[:, None]) & ~in_ball[:, None])
    return home, at, np.concatenate((row, row2)), np.concatenate((place, len(balls) + place2)), np.concatenate((to_balls[row, place], to_cells[row2, place2]))


def _placed(classes: DataFrame, known: dict[int, tuple[np.ndarray, np.ndarray]], r: float) -> DataFrame:
    """classes with home, at, ball (whether home is one) and guest, an array of (place, at)."""
    shared = classes.sparkSession.sparkContext.broadcast(known)  # BALLS + CELLS vectors for each length of vectors in the sample
    fields = ["node", "label", "dims", "n", "low", "unit", "home", "at", "ball", "guest"]
    kind = pa.list_(pa.struct([("place", pa.int32()), ("at", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("dims").to_numpy()
            for dims in np.unique(of).tolist():
                part = batch.filter(pa.array(of == dims))
                x = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(-1, dims)
                balls, cells = shared.value.get(dims, (np.zeros((0, dims)), np.eye(1, dims)))
                home, at, row, place, far = homes_and_guests(x, balls, cells, r)
                order = np.argsort(row, kind="stable")
                bounds = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
                guest = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(place[order].astype(np.int32)), pa.array(far[order])], fields=list(kind.value_type)))
                yield pa.record_batch([*(part.column(f) for f in fields[:6]), pa.array(home.astype(np.int32)), pa.array(at), pa.array(home < len(balls)), guest], fields)

    return classes.select(*fields[:6]).mapInArrow(run, "node long, label long, dims int, n long, low long, unit binary, home int, at double, ball boolean, guest array<struct<place:int,at:double>>")


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, in which each number points to the least one of its set, with the sets of a and b joined pair by pair."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _joined_blocks(group: pa.Table, cosine: float) -> pa.Table:
    """(node, links, root) of two blocks' vectors that have links between the blocks, or inside the block where both are the same one."""
    group = group.combine_chunks()
    side, node, n = group.column("side").to_numpy(), group.column("node").to_numpy(), group.column("n").to_numpy()
    dims = group.column("dims")[0].as_py()
    x = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(-1, dims)
    same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    links, root, others = np.zeros(len(x), np.int64), np.arange(len(x)), x[right].T
    for k in range(0, len(left), STRIP):
        strip = left[k : k + STRIP]
        near = x[strip] @ others >= cosine
        if same:
            near &= np.arange(len(right))[None, :] > np.arange(k, k + len(strip))[:, None]
        links[strip] += near @ n[right]
        links[right] += n[strip] @ near
        a, b = np.nonzero(near)
        root = _merged(root, strip[a], right[b])
    met = np.flatnonzero(links > 0)
    return pa.table({"node": node[met], "links": links[met], "root": node[root[met]]})


def _sized(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with the numbers of their balls and cells, which are broadcast only where they are few."""
    small = stats.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(stats) if small else stats, keys, how)


def _block_links(placed: DataFrame, r: float, cosine: float) -> DataFrame:
    """(node, links, root) from all pairs of blocks of balls and cells that may hold links."""
    keys = ["label", "dims", "place"]
    home = placed.groupBy("label", "dims", F.col("home").alias("place"), "ball").agg(F.count("*").alias("homes"), F.max("at").alias("far"))
    as_guest = placed.select("label", "dims", "node", "n", "unit", F.explode("guest").alias("g")).select("label", "dims", "node", "n", "unit", F.col("g.place").alias("place"), F.col("g.at").alias("at"))
    reached = _sized(as_guest, home, keys).where(F.col("at") <= F.col("far") + r + SLACK).drop("at", "far")
    counts = reached.groupBy(*keys).agg(F.count("*").alias("guests"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    mine = lambda c: F.pmod(F.xxhash64("node"), F.greatest(F.col(c), F.lit(1))).cast("int")
    stats = home.join(counts, keys, "left").select(*keys, "ball", blocks("homes").alias("hb"), F.coalesce(blocks("guests"), F.lit(0)).alias("gb")).where("not ball or gb > 0")
    stats = saved(stats)
    at_home = _sized(placed.select("label", "dims", "node", "n", "unit", F.col("home").alias("place")), stats, keys).withColumn("b", mine("hb"))
    upto = lambda a, z, f: F.when(F.lit(z) >= F.lit(a), F.transform(F.sequence(F.lit(a).cast("int"), F.lit(z).cast("int")), f)).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    b, hb, gb = F.col("b"), F.col("hb"), F.col("gb")
    nothing = F.array().cast("array<struct<i:int,j:int,side:int>>")
    inside = F.when(F.col("ball"), nothing).otherwise(F.concat(upto(b, hb - 1, lambda j: cell(b, j, 0)), upto(F.lit(0), b - 1, lambda i: cell(i, b, 1))))
    at_home = at_home.withColumn("t", F.explode(F.concat(inside, upto(hb, hb + gb - 1, lambda j: cell(b, j, 0)))))
    visiting = _sized(reached.drop("ball", "homes"), stats, keys).withColumn("b", mine("gb"))
    visiting = visiting.withColumn("t", F.explode(upto(F.lit(0), hb - 1, lambda i: cell(i, hb + b, 1))))
    tasks = at_home.unionByName(visiting).select(*keys, "node", "n", "unit", "t.*")
    return tasks.groupBy(*keys, "i", "j").applyInArrow(lambda t: _joined_blocks(t, cosine), "node long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Two rows link if their labels are equal and not null and the cosine of their vectors in double precision is at least `cosine`
    (above 0). Null, empty and zero vectors, vectors with a null or non-finite component and vectors of different lengths link with nothing.
    n_links counts rows, so a repeated row is a link of the other one; component_id is the smallest vec_id reachable, the own one
    included. Null vec_ids never name a component; of null ones only it is null, and kept is then true. Other columns are ignored, and
    an empty table gives no row.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be above 0 and at most 1")
    spark, r = vectors.sparkSession, math.sqrt(2 - 2 * cosine)
    of = ["label", "dims", "name"]
    rows = saved(unit_vectors(vectors))
    classes = rows.where("unit is not null").groupBy(*of).agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("unit").alias("unit"))
    path = shared_dir(spark)
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), path)
    largest = classes.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 0
    sample = classes.orderBy(F.xxhash64("name")).limit(SAMPLE).select("dims", "unit").toArrow()
    of_dims = sample.column("dims").to_numpy()
    known = {}
    for dims in np.unique(of_dims).tolist():
        x = np.frombuffer(b"".join(sample.filter(pa.array(of_dims == dims)).column("unit").to_pylist()), np.float64).reshape(-1, dims)
        known[dims] = pivots(x, min(CELLS, -(-largest // BLOCK)), r)
    places = shared_dir(spark)
    placed = saved(_placed(classes, known, r), places)
    found = saved(_block_links(placed, r, cosine))
    balls = placed.where("ball").groupBy("label", "dims", "home").agg(F.sum("n").alias("in_ball"), F.min("node").alias("hub"))
    in_balls = _sized(placed.where("ball").select("node", "label", "dims", "home"), balls, ["label", "dims", "home"])
    links = components(found.select("node", "root").unionByName(in_balls.select("node", F.col("hub").alias("root"))), "node", "root")
    links = saved(links)
    ids = placed.select("node", "low").join(links, "node").groupBy("component").agg(F.min("low").alias("component_id"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = (
        classes.select("node", *of, "n", "low")
        .join(counted, "node", "left")
        .join(in_balls.select("node", "in_ball"), "node", "left")
        .join(links.join(ids, "component").select("node", "component_id"), "node", "left")
    )
    of_node = of_node.select(*of, (F.coalesce("in_ball", "n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    of_node = saved(of_node)
    for done in (path, places):
        drop_path(spark, done)
    linked = rows.where("unit is not null").join(of_node, of).select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
with recursive usable as materialized (
  select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0
), links as materialized (
  select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_cosine_similarity(a.x, b.x) >= 0.93
), reached as (
  select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reached r join links l on r.b = l.a
), lowest as (
  select a, min(b) as component_id from reached group by a
), counted as (
  select a, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings left join counted c on vec_id = c.a join lowest l on vec_id = l.a
"""
