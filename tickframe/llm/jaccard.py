"""Near duplicates: an exact Jaccard self-join on word shingles by vertical partitioning.

The global order of shingles is by how often they occur in whole texts: those in no more than ``frequent``
texts first, by hash, then the others, by hash; so a passage that many texts share leaves their prefixes.
Two sets with similarity of ``percent`` or more share a shingle among the first
``n - ceil(percent * n) + 1`` of either (prefix filter), so only those shingles meet.
The order is then cut into ``fragments`` by hash range; for every candidate pair each fragment counts its
partial overlap by itself, and the partial counts are summed per pair.

Before that, a parity bitmap a class bounds a pair from below: every shingle flips one bit, so two
sets differ by at least as many shingles as their bitmaps differ in bits.

Documents with equal sets are one class and meet nobody on each other's behalf. Classes link in rounds:
in each, two classes drawn by hash stand for every shingle, and a class is compared with the
``TRIES`` of those it meets under its prefix with which it shares most shingles. So a group of
thousands of near copies costs a few comparisons a member. When a round links less than a tenth of what those
before it linked, whatever still shares a prefix shingle across components is compared pair by pair: while more pairs are left than
were compared so far, a few of each class first, and pairs whose classes came together by then are dropped. No link between different
texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm import words
from tickframe.llm.graph import components
from tickframe.operators.series import settle

BITS = 16, 27  # of a bitmap: by what it has to hold, 16 MB at most, whatever the corpus holds
SALTS = 64     # parts a frequent shingle's rows are dealt to
TRIES = 4      # pairs of a class in a round
KEY = (1 << 48) - 1     # bits of a shingle by which it is counted
RANGE = 1 << 21         # shingles of a range that is counted at once
MARKS = 8      # 64-bit words of a class's parity bitmap


def set_class(hashes: np.ndarray) -> int:
    """One signed 64-bit value for a set of shingles."""
    total = words.mix(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(words.mix(total[None]).view(np.int64)[0])


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bitmap in which every shingle of the set flips one bit."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * MARKS), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(batches, text: str, size: int):
    """(batch, row number, sorted set) for each row, slice by slice."""
    for batch in batches:
        data, limits = words.buffers(batch.column(text))
        for a, b in words.slices(limits):
            part = data[limits[a]:limits[b]]
            for row, found in enumerate(words.shingle_sets(part, limits[a:b + 1] - limits[a], size), a):
                yield batch, row, found


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _signatures(size: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, classes, marks = [], [], []
            for _, _, found in _sets([batch], "text", size):
                counts.append(len(found))
                classes.append(set_class(found))
                marks.append(parity(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()),
                 pa.array(classes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "cls", "marks"])
    return run


def _flush(held: list[tuple], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    if held:
        yield from words.batches({k: np.concatenate(v) for k, v in zip(names, zip(*held))})
        held.clear()


def _every_shingle(size: int, ranges: int):
    """The shingles of every text, of equal sets once from a task, to learn which are frequent.

    They leave in packed runs: a range's low 48 bits ascending, each once a run, and how often. Long runs of bytes
    cost the shuffle next to nothing, where a row a shingle would cost it most of the join's time.
    """
    edges = np.array([(k << 48) // ranges for k in range(1, ranges)], np.uint64)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held) & np.uint64(KEY), return_counts=True)
        held.clear()
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        low, high = keys.astype("<u4"), (keys >> np.uint64(32)).astype("<u2")
        often = np.minimum(counts, 65535).astype("<u2")
        blobs = [pa.array([x[a:b].tobytes() for _, a, b in spans], pa.binary()) for x in (low, high, often)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in spans], pa.int32()), *blobs], names=["part", "low", "high", "often"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, rows, seen = [], 0, set()
        for _, _, found in _sets(batches, "text", size):
            if not len(found) or (cls := set_class(found)) in seen:
                continue
            if len(seen) < 1 << 18:
                seen.add(cls)
            held.append(found)
            rows += len(found)
            if rows > 1 << 20:
                yield packed(held)
                rows = 0
        if held:
            yield packed(held)
    return run


def _frequent(least: int):
    """From the runs of whole ranges, range after range: the low 48 bits of shingles in more than ``least`` texts."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def told():
            keys, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            often = keys[first][np.add.reduceat(counts, first) > least]
            return pa.RecordBatch.from_arrays([pa.array(often.view(np.int64))], names=["h"])

        for batch in batches:
            for k, low, high, often in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "high", "often"))):
                if k != part and held:
                    yield told()
                    held.clear()
                part = k
                keys = np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32)
                held.append((keys, np.frombuffer(often, "<u2").astype(np.int64)))
        if held:
            yield told()
    return run


def frequent_shingles(docs: DataFrame, total: int, size: int, least: int) -> DataFrame:
    """``h``, the low 48 bits of shingles in more than ``least`` texts, of about ``total`` shingles in all.

    Ranges hold some ``RANGE`` shingles; the same shingle leaves a task once in a million, so a frequent one fills none.
    """
    ranges = max(16, -(-total // RANGE))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select("text").mapInArrow(_every_shingle(size, ranges), "part int, low binary, high binary, often binary")
    return runs.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_frequent(least), "h long")


class Bitmap:
    """A bit for the low ``bits`` bits of each value held; never says no to one of them."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(1 << (bits - 6), np.uint64)

    def has(self, values: np.ndarray) -> np.ndarray:
        place = values & np.uint64((1 << self.bits) - 1)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(values: DataFrame, name: str) -> Bitmap:
    """A bitmap of the values, 32 bits a value as far as ``BITS`` allows; only its words reach the driver."""
    bits = min(max(int(32 * values.count()).bit_length(), BITS[0]), BITS[1])
    low = F.col(name).bitwiseAND(F.lit((1 << bits) - 1))
    found = (values.select(F.shiftright(low, 6).alias("w"), low.bitwiseAND(F.lit(63)).cast("int").alias("b"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toArrow())
    bitmap = Bitmap(bits)
    bitmap.words[found["w"].to_numpy()] = found["v"].to_numpy().view(np.uint64)
    return bitmap


def _prefixes(size: int, percent: int, frequent):
    def run(batches) -> Iterator[pa.RecordBatch]:
        held, rows, seen = [], 0, set()
        names = ("h", "cls", "n", "pos", "late")
        for _, _, found in _sets(batches, "text", size):
            n = len(found)
            if not n or (cls := set_class(found)) in seen:
                continue                      # a class needs its prefix once from a task
            if len(seen) < 1 << 18:           # beyond that only repeats reach the shuffle
                seen.add(cls)
            late = frequent.value.has(found)
            length = prefix_length(n, percent)
            order = np.flatnonzero(~late)[:length]
            if len(order) < length:
                order = np.concatenate([order, np.flatnonzero(late)[:length - len(order)]])
            held.append((found[order].view(np.int64), np.full(length, cls), np.full(length, n, np.int32),
                         np.arange(length, dtype=np.int32), late[order]))
            rows += length
            if rows > 1 << 17:
                yield from _flush(held, names)
                rows = 0
        yield from _flush(held, names)
    return run


def _fragments(size: int, fragments: int, wanted):
    """(class, fragment, shingles) of the texts whose hash may be wanted, once from a task."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        held, rows, seen = [], 0, set()
        cuts = np.array([(k << 64) // fragments for k in range(1, fragments)], dtype=np.uint64)

        def flush():
            table = {"cls": np.array([x[0] for x in held], np.int64), "part": np.array([x[1] for x in held], np.int32),
                     "hs": pa.array([x[2] for x in held], pa.list_(pa.int64()))}
            held.clear()
            return words.batches(table)

        def asked():
            for batch in batches:
                chosen = wanted.value.has(batch.column("text_hash").to_numpy().view(np.uint64))
                if chosen.any():
                    yield batch.filter(pa.array(chosen))

        for _, _, found in _sets(asked(), "text", size):
            if not len(found) or (cls := set_class(found)) in seen:
                continue
            if len(seen) < 1 << 18:
                seen.add(cls)
            for k, part in enumerate(np.split(found, np.searchsorted(found, cuts))):
                if len(part):
                    held.append((cls, k, part.view(np.int64)))
            rows += len(found)
            if rows > 1 << 18:
                yield from flush()
                rows = 0
        if held:
            yield from flush()
    return run


def _possible(percent: int) -> Column:
    """Whether sizes and places of a shared shingle leave room for enough overlap."""
    left = 1 + F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) - 1
    return left * (100 + percent) >= percent * (F.col("n1") + F.col("n2"))


def _close(percent: int, x: str, y: str) -> Column:
    """Whether two parity bitmaps leave room for enough overlap of sets of n1 and n2."""
    apart = sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(MARKS)), F.lit(0))
    return apart * (100 + percent) <= (100 - percent) * (F.col("n1") + F.col("n2"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs a > b of rows with two different classes."""
    first = F.col("cls1") > F.col("cls2")
    return (rows.where("cls1 <> cls2")
            .select(F.greatest("cls1", "cls2").alias("a"), F.least("cls1", "cls2").alias("b"),
                    F.when(first, F.col("n1")).otherwise(F.col("n2")).alias("na"),
                    F.when(first, F.col("n2")).otherwise(F.col("n1")).alias("nb")).distinct())


def similar_pairs(docs: DataFrame, marks: DataFrame, pairs: DataFrame, size: int, percent: int, fragments: int) -> DataFrame:
    """The candidate pairs (a, b, na, nb) whose overlap, summed over fragments, suffices.

    ``marks`` names the hash of one text of each class; only texts with such a hash are read into sets.
    """
    spark = docs.sparkSession
    nodes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    texts = settle(nodes.join(marks.select("cls", "text_hash"), "cls").select("text_hash"))
    wanted = spark.sparkContext.broadcast(bitmap_of(texts, "text_hash"))
    sets = (docs.select("text", F.xxhash64("text").alias("text_hash"))
            .mapInArrow(_fragments(size, fragments, wanted), "cls long, part int, hs array<long>").dropDuplicates(["cls", "part"]))
    spread = pairs.withColumn("part", F.explode(F.lit(list(range(fragments)))))
    left = sets.select(F.col("cls").alias("a"), "part", F.col("hs").alias("x"))
    right = sets.select(F.col("cls").alias("b"), "part", F.col("hs").alias("y"))
    partial = (spread.hint("merge").join(left, ["a", "part"]).join(right.hint("merge"), ["b", "part"])
               .select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).cast("long").alias("shared")))
    return (partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
            .where(F.col("shared") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))))


def _bounded(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose parity bitmaps leave room for enough overlap."""
    side = lambda k, c: marks.select(F.col("cls").alias(c), F.col("marks").alias(f"marks{k}"))
    return (pairs.withColumns({"n1": F.col("na"), "n2": F.col("nb")}).join(side(1, "a"), "a").join(side(2, "b"), "b")
            .where(_close(percent, "marks1", "marks2")).select("a", "b", "na", "nb"))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of linked classes after more links: what was joined before comes as one edge a class."""
    if roots is not None:
        links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return settle(components(links))


def _rooted(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows with ``root``, the component of their class, and ``size``, the classes in it."""
    if roots is None:
        return shared.withColumns({"root": F.col("cls"), "size": F.lit(1).cast("long")})
    sized = roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root").withColumnRenamed("node", "cls")
    return settle(shared.join(sized, "cls", "left").withColumns({"root": F.coalesce("root", "cls"), "size": F.coalesce("size", F.lit(1))}))


def _few_each(rooted: DataFrame, tried: DataFrame | None, percent: int, turn: int) -> DataFrame:
    """For each class at most ``TRIES`` new pairs with classes of other components.

    Under every shingle that several components have stand two classes: of its largest component one with few
    shingles before this one (of near copies those edited least, with which the others are likeliest to link; places
    count by ever coarser steps), and one drawn anew in every ``turn``. A class meets those of components no smaller
    than its own, so a large group does not ask after each straggler. Of those a class meets so, it takes the ones
    with which it shares most such shingles.
    """
    draw = F.xxhash64("cls", "h", F.lit(turn)).alias("draw")
    least = F.struct((-F.col("size")).alias("less"), F.shiftright("pos", turn).alias("step"), draw, "root", "cls", "n", "pos", "size")
    ends = rooted.groupBy("h").agg(F.min(least).alias("lo"), F.max(F.struct(draw, "root", "cls", "n", "pos", "size")).alias("hi"),
                                   F.min("root").alias("r1"), F.max("root").alias("r2"))
    ends = ends.where("r1 <> r2").select("h", *(F.struct(*(f"{x}.{c}" for c in ("root", "cls", "n", "pos", "size"))).alias(x) for x in ("lo", "hi")))
    met = rooted.join(ends, "h").withColumn("o", F.explode(F.array("lo", "hi"))).where("root <> o.root and size <= o.size").select(
        F.col("cls").alias("cls1"), F.col("n").alias("n1"), F.col("pos").alias("pos1"),
        F.col("o.cls").alias("cls2"), F.col("o.n").alias("n2"), F.col("o.pos").alias("pos2")).where(_possible(percent))
    counted = met.groupBy("cls1", "n1", "cls2", "n2").agg(F.count("*").alias("c"))
    if tried is not None:
        counted = counted.withColumns({"a": F.greatest("cls1", "cls2"), "b": F.least("cls1", "cls2")}).join(tried, ["a", "b"], "left_anti")
    ranked = counted.withColumn("at", F.expr("row_number() over (partition by cls1 order by c desc, cls2)"))
    return _pairs(ranked.where(F.col("at") <= TRIES))


def _all_apart(rooted: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes that share a prefix shingle and are in different components, within bounds.

    A frequent shingle's rows are dealt to ``SALTS`` parts, each of which meets all of them.
    """
    split = rooted.groupBy("h").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("h")
    open_ = settle(rooted.join(split, "h").select("h", "late", "cls", "n", "pos", "root").join(marks.select("cls", "marks"), "cls"))
    part = F.when(F.col("late"), F.pmod(F.xxhash64("cls"), F.lit(SALTS))).otherwise(0).cast("int")
    every = F.explode(F.when(F.col("late"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    side = lambda k, salt: open_.select("h", salt.alias("salt"), *(F.col(c).alias(f"{c}{k}") for c in ("cls", "n", "pos", "root", "marks")))
    met = side(1, part).join(side(2, every), ["h", "salt"]).where("root1 <> root2 and cls1 < cls2")
    return _pairs(met.where(_possible(percent)).where(_close(percent, "marks1", "marks2")))


def _still_apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose classes are in different components."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    placed = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return placed.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(pairs.columns)


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 75, frequent: int = 24,
                    fragments: int = 4) -> DataFrame:
    """``docs`` (doc_id, text) → doc_id, n_shingles, component_id, cls, root, text_hash; a row per row.

    ``component_id`` is the smallest doc_id reachable by links. Texts that are null, empty or
    without words have an empty set and link with nothing; a text of fewer than ``size`` words
    links only with the same sequence. Repeated rows are members of one class. A null doc_id
    takes part like any other row but is no component's id unless nothing else is in it. No rows
    give no rows; other columns are ignored. ``cls`` names the class of equal sets.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    members = settle(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _signatures(size), "doc_id long, text_hash long, n long, cls long, marks array<long>"))
    marks = settle(members.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min("marks").alias("marks"), F.min("text_hash").alias("text_hash")))
    total = members.agg(F.sum("n")).first()[0] or 0
    often = settle(frequent_shingles(docs, total, size, frequent))
    bitmap = spark.sparkContext.broadcast(bitmap_of(often, "h"))
    rows = docs.select("text").mapInArrow(
        _prefixes(size, percent, bitmap), "h long, cls long, n int, pos int, late boolean")
    rows = rows.withColumn("salt", F.when(F.col("late"), F.pmod(F.col("cls"), F.lit(SALTS))).otherwise(0).cast("int"))
    met = F.expr("min(cls) over (partition by h, salt) <> max(cls) over (partition by h, salt)")
    shared = settle(rows.withColumn("met", F.col("late") | met).where("met")
                    .dropDuplicates(["h", "salt", "cls"]).select("h", "cls", "n", "pos", "late"))

    roots, tried, found, total, turn = None, None, True, 0, 0
    while found:
        near = settle(_bounded(_few_each(_rooted(shared, roots), tried, percent, turn), marks, percent))
        more = settle(similar_pairs(docs, marks, near, size, percent, fragments).select("a", "b"))
        count = more.count()
        if count or roots is None:
            roots = _joined(roots, more)
        found, total, turn = 10 * count > total, total + count, turn + 1
        tried = near.select("a", "b") if tried is None else settle(tried.unionByName(near.select("a", "b")))
    rest = settle(_all_apart(_rooted(shared, roots), marks, percent).join(tried, ["a", "b"], "left_anti"))
    compared, each = tried.count(), TRIES
    while left := rest.count():
        rank = F.expr("row_number() over (partition by a order by xxhash64(a, b), b)")
        turns = settle(rest.withColumn("now", rank <= (each if left > compared else left)))
        now = turns.where("now").drop("now")
        more = settle(similar_pairs(docs, marks, now, size, percent, fragments).select("a", "b"))
        if not more.isEmpty():
            roots = _joined(roots, more)
        rest = turns.where("not now").drop("now")
        if left > compared:
            compared, each, rest = compared + now.count(), 4 * each, settle(_still_apart(rest, roots))

    named = settle(marks.select("cls", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
                   .withColumn("root", F.coalesce("root", "cls")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "root").select("cls", "component_id", "root")
    return (members.join(ids, "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    "cls", "root", "text_hash"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each component of near duplicates: that of its smallest doc_id, nulls last.

    Rows without words are linked with nothing and all stay. Of repeated rows one stays. All
    columns pass through.
    """
    found = near_duplicates(docs, **parameters).where("root is not null")
    first = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_text"))
    marked = docs.withColumn("_hash", F.xxhash64("text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = marked.where(worded).join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_hash"]).unionByName(marked.where(~worded)).drop("_hash")
