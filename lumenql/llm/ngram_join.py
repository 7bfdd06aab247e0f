"""N-gram Jaccard self-join by vertical partitioning.

1. One pass measures every text: size and fingerprint of its set of word 5-grams, a 1024-bit
   parity sketch, and a table of how often n-grams fall into each of 2**18 cells.  Cells seen more often
   than usual come last in the *global n-gram order* (level, hash); rare ones come first.  Equal sets
   are one class, and from here on only classes travel.
2. A second pass sends each set's prefix in that order, packed, to buckets of the order, a class once
   for each task.  Sets that reach the threshold share n-grams of their prefixes, so a bucket finds the
   groups that may hold links.  An n-gram of very many sets is dealt over several buckets.
3. Candidate pairs of classes must pass two exact bounds, on sizes and on the sketches (the parity bits
   that differ never outnumber the symmetric difference).
4. The sets of the candidates that are left are cut into fragments of the global order; each
   fragment counts its partial overlap, and the counts are summed per pair.

A group of m near copies would have m * m / 2 pairs.  Each group has a hub, the member that shares most with others,
as an original does with its copies.  Each set is verified against one hub first, then against the
other hubs of its groups; afterwards pairs count only if their ends are still in different components.  So no link
between components is lost, and none within one is enumerated.  A group is kept in parts of bounded
size: its members outside the largest component go to each part, and meet that component's sets once for all groups they share with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenql.llm import kernel as K
from lumenql.llm.components import components
from lumenql.llm.shared import bounded_buckets, dealt, dropped_since, mark, parted, saved, ship, summed, text_bytes, unpack_all

CELLS = 1 << 18
_SLICES = 16
_SKETCH = 16
#: Steps of the logarithm of a set's size for each doubling.
_STEPS = 1024
_BITS = [f"s{i}" for i in range(_SKETCH)]


@dataclass(frozen=True)
class JaccardJoin:
    """Words in an n-gram, threshold in percent, n-grams of the prefixes that a pair must share, fragments of the order,
    text bytes behind one bucket, occurrences of an n-gram that meet in one, and members in one part of a group."""

    size: int = 5
    percent: int = 75
    shared: int = 4
    fragments: int = 8
    bucket_bytes: int = 24 << 20
    split: int = 1 << 20
    part: int = 1000

    def prefix(self, n: int) -> int:
        """N-grams of a set of n among which are `shared` that a set of any size has too, if both link."""
        return n - -(-self.percent * n // 100) + self.shared

    def suffix(self, n: Column) -> Column:
        """What prefix() leaves of n n-grams."""
        return F.greatest(F.lit(0), F.ceil(F.lit(self.percent) * n / F.lit(100)) - F.lit(self.shared))

    def enough(self, x: Column, y: Column, weight: Column) -> Column:
        """Whether sets of x and y n-grams whose prefixes share `weight` may link.

        Of the prefix that ends first in the order all that is common is counted; the rest is in what that prefix leaves."""
        overlap = F.ceil(F.lit(self.percent) * (x + y) / F.lit(100 + self.percent))
        return weight >= overlap - F.greatest(self.suffix(x), self.suffix(y))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text."""
    data, ends = K.utf8(batch.column("text"))
    hashes, _, _, first = K.words(data, ends, lower=True)
    grams, begin = K.shingles(hashes, first, size)
    for row in range(batch.num_rows):
        yield row, K.distinct(grams[begin[row] : begin[row + 1]])


def _classes(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit fingerprint of each set, of its size and two sums of its members' hashes."""
    first = np.array([np.add.reduce(K.mix(s ^ np.uint64(0x5BD1E995))) for s in sets], np.uint64)
    second = np.array([np.add.reduce(K.mix(s + K._SLOT[7])) for s in sets], np.uint64)
    many = np.array([len(s) for s in sets], np.uint64)
    return K.mix(first ^ K.mix(second + many * K._SLOT[0])).view(np.int64)


_MEASURED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.int64()), *((b, pa.int64()) for b in _BITS), ("counts", pa.binary())])
_MEASURED_DDL = "kind int, doc_id long, n int, sig long, " + ", ".join(f"{b} long" for b in _BITS) + ", counts binary"


def _measure(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in K.slices(batches):
            sets = [s for _, s in _sets(batch, size)]
            bits = [np.bincount((s >> np.uint64(40)).astype(np.int64) & 1023, minlength=1024) & 1 for s in sets]
            wide = np.packbits(np.array(bits, np.uint8), axis=1).view(np.int64)
            cells += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            yield pa.record_batch(
                [pa.array(np.zeros(len(sets), np.int32)), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(_classes(sets))]
                + [pa.array(wide[:, i].copy()) for i in range(_SKETCH)]
                + [pa.nulls(len(sets), pa.binary())],
                schema=_MEASURED,
            )
        blobs = [x.tobytes() for x in np.split(cells, _SLICES)]
        none = [pa.nulls(_SLICES, pa.int64())] * _SKETCH
        yield pa.record_batch([pa.array(np.ones(_SLICES, np.int32)), pa.array(np.arange(_SLICES)), pa.nulls(_SLICES, pa.int32()), pa.nulls(_SLICES, pa.int64()), *none, pa.array(blobs, pa.binary())], schema=_MEASURED)

    return run


def _counts(measured: DataFrame) -> np.ndarray:
    """How many n-grams fall into each cell: CELLS numbers whatever the corpus, so each task may hold them."""
    rows = summed(measured.where("kind = 1").select(F.col("doc_id").alias("key"), "counts"), "long").collect()
    return np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted(rows, key=lambda r: r.key)]) if rows else np.zeros(CELLS, np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    """For each cell of n-grams twice the logarithm of how much oftener than the mean it occurs, 0 at least."""
    # a cell's count varies by its root; what is above that is level 1 and more
    mean = max(counts.mean(), 1.0)
    return np.clip(np.floor(2 * np.log2(np.maximum(counts, 1) / (mean + 4 * np.sqrt(mean))) + 1), 0, 127).astype(np.uint8)


def _in_order(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the global order: by level of its cell, then by hash."""
    level = levels[(s & np.uint64(CELLS - 1)).astype(np.int64)]
    return s[np.argsort(level, kind="stable")] if level.any() else s


def _prefixes(join: JaccardJoin, buckets: int, shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, splits = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sent: set[int] = set()

        def flush() -> pa.RecordBatch:
            grams, sets, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            split = splits[(grams & np.uint64(CELLS - 1)).astype(np.int64)]
            one = split == 1
            out = [(b, -1, x) for b, x in dealt(grams[one], buckets, (grams[one] // np.uint64(buckets)).astype(np.uint32), sets[one], sizes[one])]
            if not one.all():
                # a frequent n-gram: its sets are dealt over several turns, each with a bucket of its own
                grams, sets, sizes, split = grams[~one], sets[~one], sizes[~one], split[~one]
                turn = (K.mix(sets.view(np.uint64)) % split.astype(np.uint64)).astype(np.int64)
                for t in np.unique(turn):
                    i = turn == t
                    out += [(b, int(t), x) for b, x in dealt(K.mix(grams[i] + np.uint64(t) * K._SLOT[3]), buckets, grams[i], sets[i], sizes[i])]
            return pa.record_batch([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["bucket", "turn", "rows"])

        waiting = 0
        for batch in K.slices(batches):
            sets = [s for _, s in _sets(batch, join.size)]
            for s, name in zip(sets, _classes(sets).tolist(), strict=True):
                n = len(s)
                if not n or name in sent:
                    continue
                sent.add(name)
                some = _in_order(s, levels)[: join.prefix(n)]
                held.append((some, np.full(len(some), name, np.int64), np.full(len(some), round(_STEPS * np.log2(n)), np.uint16)))
                waiting += len(some)
            if waiting > 1_000_000:
                yield flush()
                waiting = 0
        if held:
            yield flush()

    return run


_GROUPS = pa.schema([("gid", pa.int64()), ("part", pa.int64()), ("x", pa.int64()), ("members", pa.int64()), ("weight", pa.int64())])


def _candidate_groups(join: JaccardJoin):
    """Groups of sets that share prefix n-grams, each once: (gid, part, x, members, weight), weight being how many n-grams.

    The turns of a frequent n-gram are parts of one group that the n-gram names."""

    def run(table: pa.Table) -> pa.Table:
        turn = table.column("turn")[0].as_py()
        (grams, sets, sizes), _ = unpack_all(table.column("rows"), "u4" if turn < 0 else "u8", "i8", "u2")
        order = np.lexsort((sets, sizes, grams))
        grams, sets, sizes = grams[order], sets[order], sizes[order]
        once = np.concatenate([[True], (grams[1:] != grams[:-1]) | (sets[1:] != sets[:-1])])
        grams, sets, sizes = grams[once], sets[once], sizes[once]
        if turn < 0:
            # sizes too far apart can't link: from here on the runs of near sizes are what an n-gram stands for
            grams = np.cumsum(np.concatenate([[0], (grams[1:] != grams[:-1]) | (sizes[1:].astype(int) - sizes[:-1] > _STEPS * np.log2(100 / join.percent) + 2)]))
            begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            many = np.diff(np.append(begin, len(grams)))
            take = np.repeat(many >= 2, many)
            grams, sets = grams[take], sets[take]
        if not len(grams):
            return _GROUPS.empty_table()
        begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        ends = np.append(begin[1:], len(sets))
        if turn < 0:
            name = K.mix(np.add.reduceat(K.mix(sets.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)), begin))
            _, once, weight = np.unique(name, return_index=True, return_counts=True)
        else:
            name, once, weight = K.mix(grams[begin]), np.arange(len(begin)), np.ones(len(begin), np.int64)
        length = (ends - begin)[once]
        within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        gid, members, weight = (np.repeat(c, length) for c in (name[once].view(np.int64), length, weight))
        part = within // join.part + (max(turn, 0) << 32)
        return pa.table([pa.array(c) for c in (gid, part, sets[np.repeat(begin[once], length) + within], members, weight)], schema=_GROUPS)

    return run


def _fragments(join: JaccardJoin, shared) -> object:
    """Each set's fragments for each bucket that has pairs of it, with the first sets `tops` of those pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, _ = shared.value
        last = join.fragments - 1
        for batch in K.slices(batches):
            rows = []
            sets = [s for _, s in _sets(batch, join.size)]
            for s, name, spots in zip(sets, _classes(sets).tolist(), batch.column("spots").to_pylist(), strict=True):
                # the frequent end of the order is one fragment, hash ranges of the rest are the others
                hot = levels[(s & np.uint64(CELLS - 1)).astype(np.int64)] > 0
                part = np.where(hot, last, ((s >> np.uint64(33)) * np.uint64(last)) >> np.uint64(31)).astype(np.int64)
                for p in np.unique(part).tolist():
                    blob = s[part == p].tobytes()
                    rows += [(spot["bucket"], p, name, np.array(spot["tops"], np.int64).tobytes(), blob) for spot in spots]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "part", "x", "tops", "grams"])

    return run


def _overlaps(table: pa.Table) -> pa.Table:
    """Partial overlaps in one fragment of the pairs (top, x) of a bucket."""
    own: dict[int, np.ndarray] = {}
    tops: dict[int, np.ndarray] = {}
    for x, firsts, blob in zip(table.column("x").to_pylist(), table.column("tops"), table.column("grams"), strict=True):
        own[x], tops[x] = np.frombuffer(blob.as_buffer(), np.uint64), np.frombuffer(firsts.as_buffer(), np.int64)
    found = [(a, b, _common(own[a], own[b])) for b, firsts in tops.items() for a in firsts.tolist() if a != b and a in own]
    return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["a", "b", "common"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    z = np.sort(np.concatenate([x, y]), kind="stable")
    return int((z[1:] == z[:-1]).sum())


def _may_link(percent: int, x: str, y: str, bits: list[str] = _BITS) -> Column:
    """Exact bounds: sizes, and overlap <= (|x| + |y| - differing parity bits) / 2; of a folded sketch it holds too."""
    nx, ny = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    sizes = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    differ = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in bits), F.lit(0))
    return sizes & ((100 + percent) * (nx + ny - differ) >= 2 * percent * (nx + ny))


def jaccard_components(docs: DataFrame, join: JaccardJoin = JaccardJoin()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document of `docs` (doc_id: long, text).

    component_id is the smallest doc_id that links reach.  A null or empty text, or one without
    words, has n_shingles 0 and its own doc_id.  Rows that repeat a doc_id are one document, the one with the
    largest set; rows with a null doc_id come back with null component_id and link with nothing.
    Other columns aren't read."""
    spark = docs.sparkSession
    ship(spark)
    since = mark()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    measured = saved(docs.mapInArrow(_measure(join.size), _MEASURED_DDL), "zmeasured")
    counts = _counts(measured)
    shared = spark.sparkContext.broadcast((_levels(counts), 1 + counts // join.split))
    sets = measured.where("kind = 0").select("doc_id", "n", "sig", *_BITS)
    facts = sets.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", "sig", *_BITS)).alias("m")).select("doc_id", "m.*")
    classed = saved(facts, "zclassed")
    reps = saved(classed.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), *(F.max(b).alias(b) for b in _BITS)), "zclasses")

    total = text_bytes(known)
    buckets = bounded_buckets(total, join.bucket_bytes)
    parts = bounded_buckets(total, 64 << 20, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = known.mapInArrow(_prefixes(join, buckets, shared), "bucket int, turn int, rows binary").repartition(parts, "bucket")
    groups = packed.groupBy("bucket", "turn").applyInArrow(_candidate_groups(join), "gid long, part long, x long, members long, weight long")
    # a set of members that several n-grams share is one group
    # both sides of the joins below grow with the corpus: none is broadcast
    reps_by = reps.hint("merge")
    groups = saved(groups.groupBy("gid", "part", "x").agg(F.sum("weight").alias("weight"), F.max("members").alias("members")), "zgroups")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of (a, b, n_both) that reach the threshold."""
        # about 2000 pairs a bucket; a hub of many pairs is in several
        buckets = 1 + pairs.count() // 2000
        many = pairs.groupBy("a").agg((1 + F.floor(F.count("*") / 1000)).cast("long").alias("salts"))
        dealt_out = pairs.join(many.hint("merge"), "a").withColumn("bucket", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), "salts")), F.lit(buckets)))
        members = dealt_out.select("bucket", "a", F.col("b").alias("sig")).unionByName(dealt_out.select("bucket", "a", F.col("a").alias("sig")).distinct())
        spots = members.groupBy("sig", "bucket").agg(F.collect_list("a").alias("tops")).groupBy("sig").agg(F.collect_list(F.struct("bucket", "tops")).alias("spots"))
        wanted = saved(spots.join(reps_by.select("sig", F.col("rep").alias("doc_id")), "sig").drop("sig"), "zwanted")
        cut = known.join(wanted, "doc_id").mapInArrow(_fragments(join, shared), "bucket long, part int, x long, tops binary, grams binary")
        counts = cut.groupBy("bucket", "part").applyInArrow(_overlaps, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
        full = counts.join(pairs.hint("merge"), ["a", "b"])
        return full.where(f"{100 + join.percent} * common >= {join.percent} * n_both").select("a", "b")

    # the hub of a group: of what shares most with others the most
    weight = groups.groupBy("x").agg(F.sum(F.col("weight") * F.col("members")).alias("rank"))
    by_part = groups.join(weight.hint("merge"), "x").groupBy("gid", "part").agg(F.max(F.struct("rank", "x")).alias("m"))
    hubs = by_part.select("gid", "part").join(by_part.groupBy("gid").agg(F.max("m").alias("m")).hint("merge"), "gid").select("gid", "part", F.col("m.rank").alias("rank"), F.col("m.x").alias("hub"))
    star = groups.join(hubs.hint("merge"), ["gid", "part"]).where("x <> hub").groupBy("x", "hub").agg(F.sum("weight").alias("weight"), F.max("rank").alias("rank"))
    p = star.alias("p").join(reps_by.alias("ra"), F.col("p.x") == F.col("ra.sig")).join(reps_by.alias("rb"), F.col("p.hub") == F.col("rb.sig"))
    p = p.where(_may_link(join.percent, "ra", "rb")).where(join.enough(F.col("ra.n"), F.col("rb.n"), F.col("p.weight")))
    star = saved(p.select("p.x", "p.hub", "p.rank", (F.col("ra.n") + F.col("rb.n")).cast("long").alias("n_both")), "zstar")
    ends = lambda df: df.select(F.least("x", "hub").alias("a"), F.greatest("x", "hub").alias("b"), "n_both").distinct()
    best = star.groupBy("x").agg(F.max(F.struct("rank", "hub", "n_both")).alias("m")).select("x", "m.hub", "m.n_both")
    first = saved(ends(best), "zpairs")
    links = saved(verified(first), "zlinks")
    label = saved(components(links), "zcomponents")
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c")).hint("merge")
    apart = star.join(of("x"), "x", "left").join(of("hub"), "hub", "left").where(F.coalesce("x_c", "x") != F.coalesce("hub_c", "hub"))
    also = saved(ends(apart).join(first, ["a", "b"], "left_anti"), "zpairs")
    links = saved(links.unionByName(verified(also)), "zlinks")
    label = saved(components(links), "zcomponents")
    named = saved(groups.join(label.hint("merge"), F.col("x") == F.col("node"), "left").select("gid", "part", "x", "weight", F.coalesce("component", "x").alias("c")), "znamed")
    # what is in more than one component: its parts, and the largest component
    tally = named.groupBy("gid", "part", "c").agg(F.count("*").alias("rows"))
    largest = tally.groupBy("gid", "c").agg(F.sum("rows").alias("rows")).groupBy("gid").agg(F.max(F.struct("rows", "c")).alias("m"), F.count("*").alias("components"))
    largest = largest.where("components > 1").select("gid", F.col("m.c").alias("main"))
    spots = tally.select("gid", "part").distinct().join(largest.hint("merge"), "gid")
    spots = spots.join(spots.groupBy("gid").agg(F.collect_list("part").alias("parts")).hint("merge"), "gid")
    # a sketch folded to half its words is one of parities too
    some = [f"f{i}" for i in range(_SKETCH // 2)]
    folded = [F.col(_BITS[i]).bitwiseXOR(F.col(_BITS[i + _SKETCH // 2])).alias(f) for i, f in enumerate(some)]
    open_ = saved(named.join(spots.hint("merge"), ["gid", "part"]).join(reps_by.select(F.col("sig").alias("x"), "n", *folded), "x"), "zopen")
    # what a set shares with any set of another component, at most
    reach = saved(open_.groupBy("x").agg(F.max("c").alias("c"), F.sum("weight").alias("reach")), "zreach")
    facts_of = reach.join(reps_by.select(F.col("sig").alias("x"), "n", *_BITS), "x")
    # sets outside a group's largest component meet that component once, however many groups they share with it
    spread = reach.groupBy("c").agg((1 + F.floor(F.count("*") / join.part)).cast("long").alias("spread"))
    within = facts_of.join(spread.hint("merge"), "c").withColumn("at", F.pmod(F.xxhash64("x"), "spread"))
    beside = open_.where("c <> main").select("x", "main").distinct().join(spread.withColumnRenamed("c", "main").hint("merge"), "main")
    beside = beside.join(facts_of.drop("c").hint("merge"), "x").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread") - 1)))
    reached = join.enough(F.col("l.n"), F.col("r.n"), F.least("l.reach", "r.reach"))
    l, r = within.alias("l"), beside.alias("r")
    one = l.join(r.hint("merge"), (F.col("l.c") == F.col("r.main")) & (F.col("l.at") == F.col("r.at")) & reached & _may_link(join.percent, "l", "r"))
    one = one.select(F.least("l.x", "r.x").alias("a"), F.greatest("l.x", "r.x").alias("b"), (F.col("l.n") + F.col("r.n")).cast("long").alias("n_both"))
    outside = open_.where("c <> main").join(reach.select("x", "reach").hint("merge"), "x").withColumn("at", F.explode("parts"))
    # two parts meet once, as (smaller, larger)
    ranged = outside.select("*", F.least("part", "at").alias("low"), F.greatest("part", "at").alias("high"))
    l, r = ranged.alias("l"), ranged.alias("r")
    meet = (F.col("l.gid") == F.col("r.gid")) & (F.col("l.low") == F.col("r.low")) & (F.col("l.high") == F.col("r.high"))
    two = l.join(r, meet & (F.col("l.x") < F.col("r.x")) & (F.col("l.c") != F.col("r.c")) & ((F.col("l.part") != F.col("r.part")) | (F.col("l.low") == F.col("l.high"))) & reached & _may_link(join.percent, "l", "r", some))
    two = two.select(F.col("l.x").alias("a"), F.col("r.x").alias("b"), F.col("l.n").alias("nx"), F.col("r.n").alias("ny"), F.col("l.weight").alias("weight"))
    # pairs that meet nowhere else have all their shared n-grams here; the others are in `one`
    across = two.groupBy("a", "b", "nx", "ny").agg(F.sum("weight").alias("weight"))
    across = across.where(join.enough(F.col("nx"), F.col("ny"), F.col("weight"))).alias("p")
    across = across.join(reps.alias("ra"), F.col("p.a") == F.col("ra.sig")).join(reps.alias("rb"), F.col("p.b") == F.col("rb.sig")).where(_may_link(join.percent, "ra", "rb"))
    across = across.select("p.a", "p.b", (F.col("p.nx") + F.col("p.ny")).cast("long").alias("n_both"))
    second = one.unionByName(across).distinct()
    second = saved(second.join(first, ["a", "b"], "left_anti").join(also, ["a", "b"], "left_anti"), "zpairs")
    more = saved(verified(second), "zlinks")

    by_class = saved(components(links.unionByName(more)), "zcomponents").join(reps_by.select(F.col("sig").alias("node"), "rep"), "node")
    least = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = by_class.join(least.hint("merge"), "component").select(F.col("node").alias("sig"), "component_id")
    final = classed.where("n > 0").select("doc_id", "sig").join(reps_by.select("sig", "rep"), "sig").join(of.hint("merge"), "sig", "left").select("doc_id", F.coalesce("component_id", "rep").alias("component_id"))
    sizes = sets.groupBy("doc_id").agg(F.max("n").cast("long").alias("n_shingles"))
    result = sizes.join(final.hint("merge"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    result = saved(result, "zjoined")
    dropped_since(since, result)
    return result


def keep_one(docs: DataFrame, join: JaccardJoin = JaccardJoin()) -> DataFrame:
    """The documents whose doc_id is their component's smallest, and those without doc_id; rows that repeat a kept doc_id all stay.

    An empty table gives an empty one; other columns are kept whatever their names."""
    found = saved(jaccard_components(docs, join).where("component_id <> doc_id").select("doc_id"), "zdropped")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"))
    # whole documents are wide: only those that a filter of the ids can't rule out are joined
    sure, other = parted(whole, "doc_id", found)
    return sure.unionByName(other.join(found, "doc_id", "left_anti")).select("_row.*")
