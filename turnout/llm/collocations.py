"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle.  Words are counted from the first scan on; a longer phrase
becomes active with the scan after both of its subphrases (without the last word, without the first) have reached the threshold in what is counted
so far, wherever in the cycle that is, and is counted for one full cycle of shards.  So phrases of all lengths are
counted in the same scans, and counting ends when no phrase is active any more.  Counts are exact: no phrase occurs more often
than its subphrases, and every active phrase sees every shard once.

What a task must know is when a phrase reached the threshold.  It reads this from a table of ``SLOT_BITS`` bits of slots with one byte each,
the scan in which the first phrase of the slot got there.  Phrases that share a slot can make a longer one active that need not be; it is
counted in full like any other and then falls below the threshold, so the table bounds memory and not results.  Each scan adds its
new slots as a table in the shared folder.

Counting itself is by the words: within a block of texts words are numbered by their bytes and phrases by the numbers of their words, with no
digest between; blocks' counts are summed by language and phrase in Spark.  Most rows of these sums are phrases that stay rare, so a row is kept small: one
binary of phrase and language, the count, and one number for all that follows from the phrase.  State between scans is a written table of the active phrases;
a phrase whose cycle is over leaves it, to the result if it reached the threshold.

Defined cases: a null text is empty, a null language is ``und``; texts are read whole, in blocks of whole texts; repeated rows count each; an empty table
gives no rows; a language with no phrase over the threshold gives none; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnout.llm.files import discard, run_folder, ship, store, written
from turnout.llm.wordhash import BASE, FOLD, blocks, grouped, mix
from turnout.operators.ordering import top_per_group

#: Slots of the table of scans, and bytes of text counted at a time.
SLOT_BITS, BLOCK_BYTES = 26, 4 << 20
NEVER = 255
_INSIDE, _BLANK, _PIECE_END = range(3)
_KIND = np.full(256, _INSIDE, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*range(0x0A, 0x0E), *b".,;:!?"]] = _PIECE_END
#: Words of up to so many bytes are digested eight bytes of all words at a time; _KEEP leaves the first bytes of eight.
_SHORT = 32
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Ends the phrase in a key of phrase and language; no phrase holds a tab.
_END = " \t"
_COUNTS = pa.schema([("key", pa.binary()), ("k", pa.int32()), ("slot", pa.int32()), ("since", pa.int32()), ("c", pa.int64())])
_SCHEMA = "key binary, k int, slot int, since int, c bigint"
#: A phrase's mark holds since, k and slot, from the bits named on; the highest is set when an earlier scan found the phrase over the threshold.
_SINCE_BIT, _K_BIT, _REACHED = 40, 32, 1 << 62


class Occurrences:
    """The words of a block of texts, numbered by their bytes, and where phrases may run on."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = FOLD[np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = _KIND[data]
        inside = kind == _INSIDE
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        bounds = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(stops - starts, out=bounds[1:])
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[inside].tobytes())).dictionary_encode()
        self.words, self.ids = words.dictionary, words.indices.to_numpy().astype(np.int64)
        names = langs.dictionary_encode()
        self.langs, text = names.dictionary, np.searchsorted(offsets, starts, side="right") - 1
        self.lang = names.indices.to_numpy().astype(np.int64)[text]
        # A phrase runs on from a word to the next of the same text with no end of a piece between them.
        closed = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == _PIECE_END, out=closed[1:])
        self.runs_on = np.zeros(len(starts), bool)
        self.runs_on[:-1] = (text[1:] == text[:-1]) & (closed[starts[1:]] == closed[stops[:-1]])
        self.keys = mix(digests(self.words)[self.ids] + digests(self.langs, 1)[self.lang])
        self.tails = pc.binary_join_element_wise(_END[1:], self.langs, "")

    def counted(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct phrase of ``k`` words (0: language) among the places, and how many places have it."""
        code, most = self.lang[at], len(self.langs)
        for j in range(k):
            # Numbers of phrases are made dense only where those of the next length would leave ``grouped`` no room for the places.
            if (most * len(self.words)).bit_length() + len(at).bit_length() > 63:
                code, most = grouped(code)[2], len(at)
            code, most = code * len(self.words) + self.ids[at + j], most * len(self.words)
        if most <= 4 * len(at):
            count, place = np.bincount(code, minlength=most), np.empty(most, np.int64)
            place[code] = at
            seen = np.flatnonzero(count)
            return place[seen], count[seen]
        first, count, _ = grouped(code)
        return at[first], count

    def named(self, at: np.ndarray, k: int) -> pa.Array:
        """Phrase and language of each place as one key."""
        parts = [self.words.take(pa.array(self.ids[at + j])) for j in range(k)] or [pa.array([""] * len(at))]
        return pc.binary_join_element_wise(*parts, self.tails.take(pa.array(self.lang[at])), _END[:1]).cast(pa.binary())


def digests(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """A digest of the bytes of each string, none null; equal in every task."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:strings.offset + len(strings) + 1].astype(np.int64)
    raw = strings.buffers()[2]
    data = (raw.to_pybytes() if raw is not None else b"") + bytes(_SHORT)
    starts, sizes = offsets[:-1], np.diff(offsets)
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = mix(sizes.astype(np.uint64) + np.uint64(seed << 32))
    for j in range(0, _SHORT, 8):
        at = np.flatnonzero((sizes > j) & (sizes <= _SHORT))
        out[at] = mix(out[at] * np.uint64(BASE) + (eights[starts[at] + j] & _KEEP[np.minimum(sizes[at] - j, 8)]))
    for i in np.flatnonzero(sizes > _SHORT):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]:starts[i] + sizes[i]], seed)
    return out


def slots_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def count_block(block: Occurrences, reached: np.ndarray, scan: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of all phrases of a block that are active in this scan, by length; length 0 counts the words of a language."""

    def rows(at: np.ndarray, k: int, slot: np.ndarray, since: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([block.named(at, k), pa.array(np.full(len(at), k, np.int32)), pa.array(slot.astype(np.int32)),
                                pa.array(since.astype(np.int32)), pa.array(count.astype(np.int64))], schema=_COUNTS)

    everywhere = np.arange(len(block.ids))
    if scan < shards and len(everywhere):
        at, count = block.counted(everywhere, 1)
        yield rows(at, 1, slots_of(block.keys[at]), np.zeros(len(at)), count)
        at, count = block.counted(everywhere, 0)
        yield rows(at, 0, np.zeros(len(at)), np.zeros(len(at)), count)
    keys, whole = block.keys, np.ones(len(everywhere), bool)
    for k in range(2, longest + 1):
        if len(keys) < 2:
            return
        whole = whole[:-1] & block.runs_on[k - 2:len(everywhere) - 1]
        place = reached[slots_of(keys)]
        since = np.maximum(place[:-1], place[1:]).astype(np.int32) + 1
        keys = mix(keys[:-1] * np.uint64(BASE) + block.keys[k - 1:])
        active = np.flatnonzero(whole & (since <= scan) & (scan < since + shards))
        if len(active):
            at, count = block.counted(active, k)
            yield rows(at, k, slots_of(keys[at]), since[at], count)


_table: dict = {"run": None}


def reached_table(run: str, scan: int) -> np.ndarray:
    """The scan in which each slot was first reached, as known before ``scan``; one table a worker, to which scans are added."""
    if _table["run"] != run or _table["scans"] > scan:
        _table.update(run=run, scans=0, table=np.full(1 << SLOT_BITS, NEVER, np.uint8))
    table = _table["table"]
    for done in range(_table["scans"], scan):
        system, path = store(f"{run}/reached-{done}")
        for file in system.get_file_info(pafs.FileSelector(path)):
            if file.base_name.endswith(".parquet"):
                with system.open_input_file(file.path) as stream:
                    slots = pq.read_table(stream, columns=["slot"]).column("slot").to_numpy()
                table[slots[table[slots] == NEVER]] = done
    _table["scans"] = scan
    return table


def scan_shard(shard: DataFrame, run: str, scan: int, shards: int, longest: int) -> DataFrame:
    """(key, c, mark): counts of one shard's active phrases, a row for each phrase and block."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = reached_table(run, scan)

        def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            texts, langs = (whole.column(c).chunk(0) for c in ("text", "lang"))
            for start, stop, part in blocks(texts, BLOCK_BYTES):
                yield from count_block(Occurrences(part, langs.slice(start, stop - start)), reached, scan, shards, longest)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(b.nbytes for b in held) >= BLOCK_BYTES:
                yield from counted(held)
                held = []
        if held:
            yield from counted(held)

    mark = F.expr(f"shiftleft(bigint(since), {_SINCE_BIT}) | shiftleft(bigint(k), {_K_BIT}) | slot")
    return shard.select("text", "lang").mapInArrow(count, _SCHEMA).select("key", "c", mark.alias("mark"))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Lets Spark remove the shuffle files of each write at its end, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def phrase_counts(docs: DataFrame, threshold: int = 10, longest: int = 3, shards: int = 3, doc_id: str = "doc_id", text: str = "text",
                  lang: str = "lang") -> DataFrame:
    """(lang, phrase, k, c) of all phrases of up to ``longest`` words that occur ``threshold`` times or more, and for k = 0 all words of a language."""
    spark = docs.sparkSession
    ship(spark)
    run = run_folder(spark, "phrases")
    dealt = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
                        F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(shards)).alias("shard"))
    dealt.write.partitionBy("shard").parquet(f"{run}/texts")
    corpus = spark.read.schema("text string, lang string, shard long").parquet(f"{run}/texts")
    results, kept, last, state, quiet = [], [], [], None, 0
    k, since = F.expr(f"int(shiftright(mark, {_K_BIT}) & 255)"), F.expr(f"shiftright(mark & {_REACHED - 1}, {_SINCE_BIT})")
    reached = F.col("c") >= threshold
    for scan in range(shards * longest):
        counts = scan_shard(corpus.where(F.col("shard") == scan % shards), run, scan, shards, longest)
        if state is not None:
            counts = counts.unionByName(state)
        # One mark for all rows of a phrase, but that only its row in the state says that it had reached the threshold.
        summed = counts.groupBy("key").agg(F.sum("c").alias("c"), F.max("mark").alias("mark"))
        summed = summed.withColumn("over", since + (shards - 1) <= scan).where(~F.col("over") | reached | (k == 0))
        steps: list[str] = []
        with shuffles_removed(spark):
            table = written(summed, steps)
        # What is over or has reached the threshold is a small part of the table, which is read once for it.
        picked = written(table.where(F.col("over") | reached), kept)
        results.append(picked.where("over"))
        fresh = picked.where(reached & (F.col("mark") < _REACHED) & k.between(1, longest - 1))
        fresh.select(F.expr(f"int(mark & {(1 << _K_BIT) - 1})").alias("slot")).distinct().write.parquet(f"{run}/reached-{scan}")
        state = table.where("NOT over").select("key", "c", F.when(reached, F.col("mark").bitwiseOR(F.lit(_REACHED))).otherwise(F.col("mark")).alias("mark"))
        discard(spark, last)
        last = steps
        # A phrase that is active in the next scan was made so by a slot reached in one of the last ``shards`` scans, whether it was seen since or not.
        quiet = 0 if not spark.read.schema("slot int").parquet(f"{run}/reached-{scan}").isEmpty() else quiet + 1
        if quiet >= shards:
            break
    found = results[0]
    for more in results[1:]:
        found = found.unionAll(more)
    split = found.select("c", k.alias("k"), "key", F.substring_index(F.col("key").cast("string"), _END, 1).alias("phrase"))
    lang_of = F.expr(f"substring(key, octet_length(phrase) + {len(_END) + 1})").cast("string")
    result = written(split.select(lang_of.alias("lang"), "phrase", "k", "c"))
    discard(spark, [*kept, *last, f"{run}/texts"])
    return result


def collocations(docs: DataFrame, threshold: int = 10, longest: int = 3, top: int = 2000, inside: int = 50, shards: int = 3, doc_id: str = "doc_id",
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases by the worst of their cuts.

    Left out are phrases of which ``inside`` percent or more occur as part of one longer phrase over the threshold.
    """
    counts = phrase_counts(docs, threshold, longest, shards, doc_id, text, lang)
    phrases = counts.where("k >= 2").select("lang", "phrase", "k", F.col("c").alias("a"))
    spans = F.expr("flatten(transform(sequence(2, k - 1), n -> transform(sequence(n, k), i -> substring_index(substring_index(phrase, ' ', i), ' ', -n))))")
    longer = phrases.where("k >= 3").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    cuts = open_.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    first, rest = F.expr("substring_index(phrase, ' ', cut)"), F.expr("substring_index(phrase, ' ', cut - k)")
    cuts = cuts.select("lang", "phrase", "a", "cut", first.alias("first"), rest.alias("rest"))
    sides = counts.where("k >= 1")
    cuts = cuts.join(sides.select("lang", F.col("phrase").alias("first"), F.col("c").alias("l")), ["lang", "first"])
    cuts = cuts.join(sides.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r")), ["lang", "rest"])
    # A product of three counts can pass 64 bits; 38 digits hold it, and the quotient is at most a million.  Smaller counts need no decimals.
    score = F.expr("CASE WHEN a <= 3000000 AND l <= 3000000000 AND r <= 3000000000 THEN (1000000 * a * a) div (l * r) "
                   "ELSE (cast(1000000 AS decimal(38,0)) * a * a) div (cast(l AS decimal(38,0)) * r) END")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    total = counts.where("k = 0").groupBy("lang").agg(F.sum("c").alias("n"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language's phrases are cut to the best of each share first, so that the last ranking sees ``top`` rows of a share and not all of a language.
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = worst.select("lang", "phrase", "a", "m.l", "m.r", "m.score", F.pmod(F.xxhash64("phrase"), F.lit(shares)).alias("share"))
    best = top_per_group(shared, ["lang", "share"], order, top).drop("share")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
