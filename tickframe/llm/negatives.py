"""Hard negatives from shared lists of anchor clusters, walked until no better row can follow.

Anchors are clustered by angle. For a cluster whose members lie within an angle of b around its
centre, a row x at angle t from the centre can score no member u more than |u| |x| cos(max(0, t - b)).
So one list a cluster, sorted by |x| cos(max(0, t - b)), serves all its members: each walks it and stops
where the next bound is below the worst score it would still take. What it returns is exact.

Rows and anchors meet as blocks: anchors in bundles of whole clusters (or parts of a large one), rows
in blocks of bounded bytes; every pair of a bundle and a block is one group of bounded size, and the
best few of all blocks are merged by an ordered window. Positives come first, by one walk, then the
negatives below each positive by a second.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickframe.operators.series import settle

SLACK = 1e-6           # radians and relative: what rounding can add to a bound
STEP = 64              # rows of a list scored at once, doubled as the walk goes on


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of numbers as a matrix; shorter rows are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; those without a direction stay zero."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def centres(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """At most ``count`` centres of directions (spherical k-means, begun at spread places)."""
    unit = np.unique(directions(vectors), axis=0)
    chosen = unit[:1]
    while len(chosen) < min(count, len(unit)):
        far = int((unit @ chosen.T).max(axis=1).argmin())
        chosen = np.vstack([chosen, unit[far]])
    for _ in range(rounds):
        home = (unit @ chosen.T).argmax(axis=1)
        sums = np.zeros_like(chosen)
        np.add.at(sums, home, unit)
        moved = directions(sums)
        chosen = np.where(np.linalg.norm(moved, axis=1, keepdims=True) > 0, moved, chosen)
    return chosen


def angles(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The angle of each vector to a unit vector."""
    return np.arccos(np.clip(directions(vectors) @ centre, -1, 1))


class SharedList:
    """The rows of a block in the order in which a cluster's members walk them."""

    def __init__(self, members: np.ndarray, rows: np.ndarray):
        total = directions(members).sum(axis=0)
        centre = directions(total[None])[0]
        reach = angles(members, centre).max(initial=0.0)
        norms = np.linalg.norm(rows, axis=1)
        bound = norms * np.cos(np.maximum(0, angles(rows, centre) - reach - SLACK))
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order]
        self.rows = rows
        self.norms = np.linalg.norm(members, axis=1)
        self.members = members

    def walk(self, take, floor):
        """Steps (alive members, row numbers, scores). After each, ``take`` has stored what it wants and
        ``floor(alive)`` says the least score each alive member would still take."""
        alive, at, step = np.arange(len(self.members)), 0, STEP
        while at < len(self.order) and len(alive):
            most = self.norms[alive] * self.bound[at]
            alive = alive[most + np.abs(most) * SLACK + SLACK >= floor(alive)]
            chosen = self.order[at:at + step]
            if len(alive):
                take(alive, chosen, self.members[alive] @ self.rows[chosen].T)
            at, step = at + step, min(2 * step, 4096)


class Best:
    """The best ``k`` scores seen by each of ``count`` takers, and all entries that may be among them."""

    def __init__(self, count: int, k: int):
        self.top, self.k = np.full((count, k), -np.inf), k
        self.entries: list[tuple] = []

    def add(self, takers: np.ndarray, rows: np.ndarray, scores: np.ndarray, wanted: np.ndarray) -> None:
        scores = np.where(wanted, scores, -np.inf)
        who, which = np.nonzero(wanted & (scores >= self.top[takers].min(axis=1)[:, None]))
        if len(who):
            self.entries.append((takers[who], rows[which], scores[who, which]))
            joined = np.concatenate([self.top[takers], scores], axis=1)
            self.top[takers] = np.partition(joined, -self.k, axis=1)[:, -self.k:]

    def floor(self, takers: np.ndarray) -> np.ndarray:
        return self.top[takers].min(axis=1)

    def result(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(taker, row, score): each taker's best ``k`` by score, ties by smaller id."""
        if not self.entries:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        who, rows, scores = (np.concatenate(x) for x in zip(*self.entries))
        order = np.lexsort((ids[rows], -scores, who))
        who, rows, scores = who[order], rows[order], scores[order]
        first = np.searchsorted(who, who)
        keep = np.arange(len(who)) - first < self.k
        return who[keep], rows[keep], scores[keep]


def _unlike(vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, copies: int) -> np.ndarray:
    """Rows but for those of which ``copies`` with the same vector and label have smaller ids: they score
    alike, so no list of the best ``copies`` ever gets to them."""
    order = np.lexsort((ids, labels, *vectors.T))
    if not len(order):
        return order
    same = (labels[order[1:]] == labels[order[:-1]]) & (vectors[order[1:]] == vectors[order[:-1]]).all(axis=1)
    start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
    return np.sort(order[np.arange(len(order)) - start < copies])


def _group(task, copies: int):
    """A bundle of anchors (left) and a block of rows (right): ``task`` per cluster, on the block's
    rows without needless copies."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max((int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (left, right)), default=0)
        rows, labels, ids = matrix(right["v"], width), right["label"].to_numpy(), right["vec_id"].to_numpy()
        keep = _unlike(rows, labels, ids, copies)
        rows, labels, ids = rows[keep], labels[keep], ids[keep]
        clusters, anchors = left["cluster"].to_numpy(), matrix(left["v"], width)
        out = []
        for cluster in np.unique(clusters):
            at = np.flatnonzero(clusters == cluster)
            out.append(task(left.take(pa.array(at)), SharedList(anchors[at], rows), labels, ids))
        return pa.concat_tables(out) if out else task(left, None, labels, ids)
    return run


_POSITIVES = "anchor long, positive long, score double"
_NEGATIVES = "anchor long, positive long, place int, negative long, score double"


def _positives(k: int):
    def task(members: pa.Table, shared: SharedList, labels: np.ndarray, ids: np.ndarray) -> pa.Table:
        own, names = members["label"].to_numpy(), members["vec_id"].to_numpy()
        best = Best(len(names), k)
        shared.walk(lambda m, r, s: best.add(m, r, s, (labels[r] == own[m][:, None]) & (ids[r] != names[m][:, None])), best.floor)
        who, rows, scores = best.result(ids)
        return pa.table({"anchor": names[who], "positive": ids[rows], "score": scores})
    return _group(task, k + 1)


def _negatives(k: int, low: int, high: int):
    def task(members: pa.Table, shared: SharedList, labels: np.ndarray, ids: np.ndarray) -> pa.Table:
        own, names, given = members["label"].to_numpy(), members["vec_id"].to_numpy(), members["positives"].to_pylist()
        depth = max((len(x) for x in given), default=0)
        scores = np.array([[p["score"] for p in x] + [np.nan] * (depth - len(x)) for x in given]).reshape(len(given), depth)
        bests = [Best(len(names), k) for _ in range(depth)]
        with np.errstate(invalid="ignore"):
            least = np.where(np.isnan(scores), np.inf, low * scores / 100)

            def take(m, r, s):
                other = labels[r] != own[m][:, None]
                for n, best in enumerate(bests):
                    mark = scores[m, n][:, None]
                    best.add(m, r, s, other & (low * mark <= 100 * s) & (100 * s <= high * mark))

            def floor(m):
                return np.min([np.maximum(b.floor(m), least[m, n]) for n, b in enumerate(bests)], axis=0, initial=np.inf)

            shared.walk(take, floor)
        parts = []
        for n, best in enumerate(bests):
            who, rows, found = best.result(ids)
            parts.append(pa.table({"anchor": names[who], "positive": pa.array([given[w][n]["id"] for w in who.tolist()], pa.int64()),
                                   "place": np.full(len(who), n, np.int32), "negative": ids[rows], "score": found}))
        empty = pa.table({"anchor": pa.array([], pa.int64()), "positive": pa.array([], pa.int64()),
                          "place": pa.array([], pa.int32()), "negative": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *parts])
    return _group(task, k)


def _bundles(anchors: DataFrame, clusters: int, sample: int, bundle: int) -> DataFrame:
    """Anchors with ``cluster`` and ``bundle``: clusters of angle around centres fitted on a bounded sample,
    at most about ``bundle`` anchors together. A large cluster is dealt to several bundles by a hash of the id."""
    spark = anchors.sparkSession
    seen = anchors.select("v").where(F.size("v") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    model = spark.sparkContext.broadcast(centres(matrix(seen["v"]), clusters) if seen.num_rows else np.zeros((1, 1)))

    def nearest(batches):
        for batch in batches:
            given = matrix(batch.column("v"))
            width = max(given.shape[1], model.value.shape[1])
            fit = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
            home = (fit(given) @ fit(model.value).T).argmax(axis=1) if len(given) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int64())], names=[*batch.schema.names, "cluster"])

    placed = settle(anchors.mapInArrow(nearest, StructType([*anchors.schema.fields]).add("cluster", "long")))
    counts = placed.groupBy("cluster").count().orderBy("cluster").collect()     # at most ``clusters`` rows
    first, parts, room, at = {}, {}, 0, -1
    for row in counts:
        if row["count"] > bundle:
            parts[row.cluster] = -(-row["count"] // bundle)
            first[row.cluster], at, room = at + 1, at + parts[row.cluster], 0
        else:
            if row["count"] > room:
                at, room = at + 1, bundle
            parts[row.cluster], first[row.cluster], room = 1, at, room - row["count"]
    if not counts:
        return placed.withColumn("bundle", F.lit(0).cast("long"))
    lookup = lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), F.col("cluster"))
    return placed.withColumn("bundle", (lookup(first) + F.pmod(F.xxhash64("vec_id"), lookup(parts))).cast("long"))


def mine(rows: DataFrame, anchor, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         clusters: int = 64, sample: int = 8192, bundle: int = 4096, block_bytes: int = 1 << 22) -> DataFrame:
    """``rows`` (vec_id, label, v) → anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``v`` are numbers whose inner products are exact in a double (whole numbers below 2 ** 53). ``anchor``
    is a condition on rows. An anchor's positives are its ``positives`` best other rows of the same label, its
    negatives for one of them the ``negatives`` best rows of other labels with low * positive <= 100 * score
    <= high * positive; higher scores first, ties by smaller vec_id. Fewer are returned where there are fewer.

    Rows with a null vec_id, label or vector or a null or non-finite component take no part. A shorter vector
    counts as padded with zeros. Rows with the anchor's own vec_id are not other rows; of several anchors with one
    vec_id the one of smallest (label, v) asks. Repeated rows with different vec_id are candidates each. Empty
    tables give no rows; other columns are ignored. Centres are fitted on at most ``sample`` anchors; they
    decide how long walks are, never what is returned.
    """
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.col("v").cast("array<double>").alias("v"), anchor.alias("asks")).where(fit)
    rows = settle(rows.withColumn("place", F.monotonically_increasing_id()))
    count, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-count * 8 * max(1, width or 1) // block_bytes))
    items = rows.select(F.pmod(F.xxhash64("place"), F.lit(blocks)).alias("block"), "vec_id", "label", "v")
    asking = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
    asking = _bundles(asking, clusters, sample, bundle)
    asking = settle(asking)
    bundles = asking.agg(F.max("bundle")).first()[0]
    bundles = 1 if bundles is None else bundles + 1
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    right = items.select(every(bundles, "bundle"), "block", "vec_id", "label", "v").groupBy("bundle", "block")

    def against(left: DataFrame, task, schema: str) -> DataFrame:
        return left.select("*", every(blocks, "block")).groupBy("bundle", "block").cogroup(right).applyInArrow(task, schema)

    best = lambda by, what: Window.partitionBy(*by).orderBy(F.desc("score"), what)
    found = against(asking, _positives(positives), _POSITIVES)
    chosen = (found.withColumn("at", F.row_number().over(best(["anchor"], "positive"))).where(F.col("at") <= positives)
              .groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("at", F.col("positive").alias("id"), "score"))).alias("positives")))
    ready = settle(asking.join(chosen, F.col("vec_id") == F.col("anchor")).drop("anchor"))
    below = against(ready, _negatives(negatives, low, high), _NEGATIVES)
    ranked = below.withColumn("rank", F.row_number().over(best(["anchor", "place"], "negative"))).where(F.col("rank") <= negatives)
    scores = ready.select(F.col("vec_id").alias("anchor"), F.posexplode("positives").alias("place", "given"))
    return ranked.join(scores, ["anchor", "place"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        F.col("given.score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))
