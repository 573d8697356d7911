"""N-gram Jaccard join: grouped prefix join over word shingles.

Each text's set of shingles is put into one global order, rare ones first, and only its prefix is indexed: two sets that are similar
enough share a shingle of their prefixes.  Copies of a set are one class; classes with the same prefix and size are one group, and
the index holds groups.  Group pairs that meet in it are filtered by size and by the position of the shingle they meet at; what is
left is expanded to members and verified on the whole sets.

Groups that many share a shingle with are not paired with each other: first every group meets one pivot of each of its shingles, and what
is linked becomes one component.  Only pairs whose components still differ are then tried in full, so no link between components
is lost, and a large group of near copies costs a pair a member, not the square.

The order is the bit length of a shingle's bucket count over all texts, then its digest.  The table of bit lengths has a fixed size
(``ORDER_BITS``); crowded buckets make the order less sharp, never the result less complete.

Defined cases: a text with fewer words than a shingle has is one shingle; a null or empty text has an empty set and links
with nothing; a null id has no component and links with nothing; repeated rows are copies; rows that repeat an id with
other texts are judged each by its text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.components import components
from turnout.llm.files import discard, ship, written
from turnout.llm.wordhash import BASE, blocks, distinct, mix, windows, words_of

#: 2^ORDER_BITS buckets of shingle counts, summed in ranges of 2^RANGE_BITS.
ORDER_BITS, RANGE_BITS = 22, 16
#: At most 2^SLOT_BITS bits (64 MB) tell which indexed shingles may be shared.
SLOT_BITS = 29
#: Up to so many ids are broadcast to pick texts for verification; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingle digests of each text, ascending."""
    found = words_of(column, fold=True)
    grams = windows(found.digests, words)
    for i in range(len(column)):
        first, last = found.bounds[i], found.bounds[i + 1]
        if last - first >= words:
            yield distinct(grams[first:last - words + 1])
        elif last > first:
            short = windows(found.digests[first:last], int(last - first))
            yield mix(short + np.uint64(last - first))
        else:
            yield np.zeros(0, np.uint64)


def _bucket(digests: np.ndarray) -> np.ndarray:
    return (digests >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def bucket_weights(docs: DataFrame, words: int) -> np.ndarray:
    """Bit length of the number of shingles in each bucket, over all texts: a table of fixed size (4 MB).

    Tasks add up dense ranges, and the ranges' sums are added again as they stream by; only the final bytes reach the driver.
    """
    size, ranges = 1 << RANGE_BITS, 1 << (ORDER_BITS - RANGE_BITS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * ranges, np.uint32)
        for batch in batches:
            for _, _, part in blocks(batch.column(0)):
                found = words_of(part, fold=True)
                grams = windows(found.digests, words)
                ends = found.bounds[1:]
                inside = np.ones(len(grams), bool)  # a run that starts in the last words - 1 words of a text crosses its end
                for k in range(1, words):
                    at = ends - k
                    inside[at[(at >= 0) & (at < len(grams))]] = False
                total += np.bincount(_bucket(grams[inside]), minlength=len(total)).astype(np.uint32)
        for r in range(ranges):
            part = total[r * size:(r + 1) * size]
            if part.any():
                kind = np.min_scalar_type(part.max())
                yield pa.record_batch([pa.array([r], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())],
                                      names=["range", "width", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, width, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums.setdefault(r, np.zeros(size, np.int64))
                sums[r] += np.frombuffer(counts, f"<u{width}").astype(np.int64)
        for r, total in sums.items():
            weight = np.ceil(np.log2(total + 1)).astype(np.uint8)
            yield pa.record_batch([pa.array([r], pa.int32()), pa.array([weight.tobytes()], pa.binary())], names=["range", "weights"])

    counted = docs.select("text").mapInArrow(count, "range int, width int, counts binary")
    table = np.zeros(size * ranges, np.uint8)
    for row in counted.repartition(ranges, "range").mapInArrow(add, "range int, weights binary").collect():
        table[row["range"] * size:(row["range"] + 1) * size] = np.frombuffer(row["weights"], np.uint8)
    return table


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of n that must be indexed so that no partner is missed."""
    return n - -(-percent * n // 100) + 1


def index_rows(docs: DataFrame, words: int, percent: int, weights: np.ndarray, steps: list[str]) -> DataFrame:
    """(doc_id, text_key, n, class, prefix, head): set size, digest of the set, its first shingles in order, digest of these."""
    table = docs.sparkSession.sparkContext.broadcast(weights)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = table.value
        for batch in batches:
            for start, stop, part in blocks(batch.column(0)):
                n, whole, prefix, head = [], [], [], []
                for grams in shingle_sets(part, words):
                    p = min(prefix_size(len(grams), percent), len(grams))
                    own = weight[_bucket(grams)]
                    if p < len(grams):
                        least = np.partition(own, p - 1)[p - 1]
                        low = np.flatnonzero(own < least)
                        low = low[np.argsort(own[low], kind="stable")]
                        chosen = np.r_[low, np.flatnonzero(own == least)[:p - len(low)]]
                    else:
                        chosen = np.argsort(own, kind="stable")
                    first = grams[chosen]
                    n.append(len(grams))
                    whole.append(int(mix(mix(grams).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(grams)))[0].astype(np.int64)))
                    head.append(int(mix((mix(first) * (np.arange(1, len(first) + 1, dtype=np.uint64) * np.uint64(BASE) | np.uint64(1))).sum(dtype=np.uint64, keepdims=True))[0].astype(np.int64)))
                    prefix.append(first.astype(np.int64))
                yield pa.record_batch([*(batch.column(c).slice(start, stop - start) for c in (1, 2)), pa.array(n, pa.int64()), pa.array(whole, pa.int64()),
                                       pa.array(prefix, pa.list_(pa.int64())), pa.array(head, pa.int64())], names=["doc_id", "text_key", "n", "class", "prefix", "head"])

    rows = docs.select("text", "doc_id", "text_key").mapInArrow(index, "doc_id bigint, text_key bigint, n bigint, class bigint, prefix array<bigint>, head bigint")
    return written(rows, steps)


def shared_slots(rows: DataFrame) -> np.ndarray:
    """Bits of the hash slots that two or more indexed shingles fall into; what falls into others is certainly unique.

    The bitmap has four slots a shingle or more, up to 2^SLOT_BITS; beyond that it filters less, and the join does the rest.
    """
    total = rows.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    bits = min(SLOT_BITS, max(20, int(4 * total).bit_length()))
    size = 1 << max(14, bits - 6)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.sort(_slots(batch.column(0).flatten().to_numpy(zero_copy_only=False), bits))
            cuts = np.searchsorted(slots, np.arange(0, (1 << bits) + size, size))
            for r in range(len(cuts) - 1):
                if cuts[r] < cuts[r + 1]:
                    part = (slots[cuts[r]:cuts[r + 1]] - r * size).astype("<u4")
                    yield pa.record_batch([pa.array([r], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["range", "slots"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, slots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = seen.setdefault(r, np.zeros(size, np.uint8))
                once, n = np.unique(np.frombuffer(slots, "<u4"), return_counts=True)
                held[once] = np.minimum(held[once] + np.minimum(n, 2), 2)
        for r, held in seen.items():
            yield pa.record_batch([pa.array([r], pa.int32()), pa.array([np.packbits(held > 1).tobytes()], pa.binary())], names=["range", "bits"])

    placed = rows.select("prefix").mapInArrow(place, "range int, slots binary")
    out = np.zeros(1 << bits - 3, np.uint8)
    for row in placed.repartition(64, "range").mapInArrow(add, "range int, bits binary").toLocalIterator():
        out[row["range"] * size // 8:(row["range"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return (mix(grams.astype(np.uint64) ^ np.uint64(BASE)) >> np.uint64(64 - bits)).astype(np.int64)


def indexed(rows: DataFrame, slots: np.ndarray) -> DataFrame:
    """(class, doc_id, n, pos, gram) of every row with shingles that may be shared: their places in the prefix, and digests."""
    table, bits = rows.sparkSession.sparkContext.broadcast(slots), (len(slots) * 8).bit_length() - 1

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        for batch in batches:
            prefix = batch.column(3)
            grams, ends = prefix.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(prefix.offsets.to_numpy()))
            at = _slots(grams, bits)
            shared = (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            place = np.arange(len(grams)) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends]))
            bounds = np.searchsorted(np.flatnonzero(shared), np.r_[0, ends]).astype(np.int32)
            some = np.diff(bounds) > 0
            lists = [pa.ListArray.from_arrays(bounds, pa.array(v[shared], kind)) for v, kind in ((place, pa.int32()), (grams, pa.int64()))]
            yield pa.record_batch([*(batch.column(c) for c in range(3)), *lists], names=["class", "doc_id", "n", "pos", "gram"]).filter(pa.array(some))

    return rows.select("class", "doc_id", "n", "prefix").mapInArrow(pick, "class bigint, doc_id bigint, n bigint, pos array<int>, gram array<bigint>")


def _overlap(a: str, b: str, percent: int) -> str:
    """Fewest common shingles of sets of sizes a and b that are similar enough, as SQL."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def _meet(percent: int) -> str:
    """Whether groups x and y can be similar if the shingle they meet at is the first they share."""
    need = _overlap("x.n", "y.n", percent)
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND x.n - x.pos >= {need} AND y.n - y.pos >= {need}"


def picked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted classes (one column, distinct); these are broadcast up to BROADCAST_IDS."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, wanted.columns, "left_semi")


def _both_sides(pairs: DataFrame, steps: list[str]) -> DataFrame:
    return written(pairs.select(F.col("a").alias("class")).unionAll(pairs.select("b")).distinct(), steps)


def prefix_filtered(pairs: DataFrame, rows: DataFrame, percent: int, steps: list[str]) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough.

    What two sets share beyond their prefixes is at most what is left of the one whose prefix ends first, so the prefixes
    themselves must share the rest of the overlap needed.
    """
    sets = written(picked(rows.select("class", "n", "prefix"), _both_sides(pairs, steps)).dropDuplicates(["class"]), steps)
    side = lambda c, p: sets.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("prefix").alias(p))
    both = pairs.hint("merge").join(side("a", "x"), "a").join(side("b", "y").hint("merge"), "b")
    return both.where(f"size(array_intersect(x, y)) >= {_overlap('na', 'nb', percent)} - greatest(na - size(x), nb - size(y))").select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, steps: list[str]) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    needed = _both_sides(pairs, steps)
    ids = written(picked(classes, needed).select(F.col("first_id").alias("doc_id")).distinct(), steps)
    wanted = picked(docs, ids)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in blocks(batch.column(0)):
                found = list(shingle_sets(part, words))
                whole = [int(mix(mix(g).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(g)))[0].astype(np.int64)) for g in found]
                yield pa.record_batch([pa.array(whole, pa.int64()), pa.array([g.tobytes() for g in found], pa.binary())], names=["class", "grams"])

    held = wanted.select("text").mapInArrow(sets, "class bigint, grams binary")
    held = written(picked(held, needed).dropDuplicates(["class"]), steps)
    one = pairs.hint("merge").join(held.select(F.col("class").alias("a"), F.col("grams").alias("x")), "a")
    two = one.join(held.select(F.col("class").alias("b"), F.col("grams").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                similar[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(similar))

    return two.mapInArrow(compare, "a bigint, b bigint")


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", star_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: component_id is the smallest id reachable by links."""
    steps: list[str] = []
    joined = written(_joined(docs, words, percent, doc_id, text, star_rounds, steps).select("doc_id", "n_shingles", "component_id"))
    discard(docs.sparkSession, steps)
    return joined


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id, of rows that repeat it one.

    Rows without a set of shingles or without an id stay as they are.
    """
    steps: list[str] = []
    joined = written(_joined(docs, words, percent, doc_id, text, 2, steps).where("doc_id IS NOT NULL AND n_shingles > 0"))
    discard(docs.sparkSession, steps)
    best = joined.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    judged = joined.join(best, "root").groupBy("doc_id", "text_key").agg(
        F.max(F.struct("doc_id", "text_key") == F.col("best")).alias("stays"), F.count(F.lit(1)).alias("n"))
    touched = written(judged.where("NOT stays OR n > 1"))
    side = F.broadcast(touched) if touched.count() <= BROADCAST_IDS else touched
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).cast("bigint").alias("doc_id"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    rest = keyed.join(side, ["doc_id", "text_key"], "left_anti")
    repeated = keyed.join(side.where("stays"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return rest.unionByName(repeated).select("_row.*")


def _joined(docs: DataFrame, words: int, percent: int, doc_id: str, text: str, star_rounds: int, steps: list[str]) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, root) for every row; ``steps`` notes the tables it reads.

    Joins with tables that grow with the corpus are merge joins by hint: Spark would broadcast them while they are small.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(whole.alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("text_key"))
    ship(docs.sparkSession)
    rows = index_rows(source, words, percent, bucket_weights(source, words), steps)
    linked = rows.where("doc_id IS NOT NULL AND n > 0")
    classes = written(linked.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.max("head").alias("head")), steps)
    # A group is named by its smallest class; most groups have one member.
    names = classes.groupBy("n", "head").agg(F.min("class").alias("grp"))
    members = written(classes.join(names.hint("merge"), ["n", "head"]).select("class", "grp", "first_id"), steps)
    heads = members.where("class = grp").select("class", "first_id")
    index = indexed(linked, shared_slots(linked)).join(heads.hint("merge"), "class").where("doc_id = first_id").dropDuplicates(["class"])
    groups = index.select(F.col("class").alias("grp"), "n", F.inline(F.arrays_zip("pos", "gram")))
    shared = groups.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram")
    postings = written(groups.join(shared.hint("merge"), "gram"), steps)
    within = members.where("class != grp").select(F.least("grp", "class").alias("a"), F.greatest("grp", "class").alias("b"))
    labels = members.select("class", "grp", F.col("class").alias("root"))
    tested = None
    for turn in range(star_rounds + 1):
        # Only shingles whose groups are not all of one component yet can bring a new link between components.
        state = labels.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        left = postings.join(state.hint("merge"), "grp")
        if turn:
            open_grams = left.groupBy("gram").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l != h").select("gram")
            left = written(left.join(open_grams.hint("merge"), "gram"), steps)
        if turn < star_rounds:
            # Every group meets the pivot of each shingle: the group in which the shingle stands earliest, then another one.
            order = F.struct("pos", "grp", "n") if turn == 0 else F.struct(F.xxhash64("grp", F.lit(turn)).alias("h"), "grp", "n", "pos")
            pivots = left.groupBy("gram").agg(F.min(order).alias("y"))
            met = left.alias("x").join(pivots.hint("merge"), "gram").where(f"x.grp != y.grp AND {_meet(percent)}").select(F.col("y.grp").alias("a"), F.col("x.grp").alias("b"))
            found = _expanded(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), labels)
            if turn == 0:
                found = found.unionAll(within)
        else:
            met = left.alias("x").join(left.alias("y").hint("merge"), "gram").where(f"x.grp < y.grp AND (x.low != y.low OR x.low != x.high OR y.low != y.high) AND {_meet(percent)}")
            met = met.select(F.col("x.grp").alias("a"), F.col("y.grp").alias("b")).distinct()
            inside = labels.alias("p").join(labels.alias("q"), "grp").where("p.class < q.class AND p.root != q.root").select(F.col("p.class").alias("a"), F.col("q.class").alias("b"))
            found = _expanded(met, labels).unionAll(inside)
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti")
        found = written(prefix_filtered(written(found, steps), linked, percent, steps), steps)
        if found.isEmpty():
            continue
        tested = found if tested is None else tested.unionAll(found)
        root_of = lambda side: labels.select(F.col("class").alias(side), F.col("root").alias(f"r{side}"))  # noqa: B023, E731
        good = verified(found, classes, source, words, percent, steps).join(root_of("a").hint("merge"), "a").join(root_of("b").hint("merge"), "b")
        merged = components(good.select(F.col("ra").alias("a"), F.col("rb").alias("b")), steps=steps)
        up = labels.join(merged.hint("merge"), labels["root"] == merged["node"], "left")
        labels = written(up.select("class", "grp", F.coalesce(merged["root"], labels["root"]).alias("root")), steps)
    full = classes.select("class", "first_id").join(labels.select("class", "root").hint("merge"), "class")
    lowest = full.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = full.join(lowest.hint("merge"), "root").select("class", "component_id", "root")
    out = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "class").join(named.hint("merge"), "class", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), "root")


def _expanded(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of groups to pairs of their members whose components differ."""
    one = pairs.hint("merge").join(labels.select(F.col("grp").alias("a"), F.col("class").alias("ca"), F.col("root").alias("ra")), "a")
    two = one.join(labels.select(F.col("grp").alias("b"), F.col("class").alias("cb"), F.col("root").alias("rb")), "b")
    return two.where("ra != rb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
