"""Self-join of documents by the Jaccard similarity of their word n-grams, as connected components.

Adaptive multi-match prefixes. Shingles have one global order, rare ones first. Two sets of which each has to share o of its
n shingles with the other share `level` shingles among the first n - o + level of each, for every level up to o. A higher
level has longer prefixes, and more shared shingles before a pair is worth verifying; each document picks the level at which
the cost is likely least, by counts of all shingles: postings that its prefix meets, plus verifications of the pairs that they can
give. It posts that prefix and no more; two documents have to share as many shingles as the lower of their levels.

Equal sets are one class throughout. Classes that are linked already needn't be compared again, so a large group of near
copies is first linked to hubs (one for each shared shingle), in rounds, and put into components; only pairs of classes in
different components that still share enough shingles are then verified. No pair of the group is emitted but those with hubs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, distinct, gram_hashes, small_batches, text_bytes, text_key, without_rows

#: Fewest and most slots of the sketch of shingle counts by which shingles are ordered; it is one byte a slot when it reaches the tasks. Between these there
#: is one slot for so many bytes of input: with more shingles a slot, rare and frequent ones could no longer be told apart.
SKETCH_BITS = (16, 24)
_SLOT_BYTES = 512
_SKETCH_PARTS = 64
#: Lowest and highest level. Sets that must share fewer shingles than a level have that many as theirs.
LEVELS = (1, 4)
#: The cost of what follows for a pair that is found, in postings.
VERIFY_COST = 2
#: Slots of the filter that says which texts are read again for verification: 1 bit each.
_FILTER_BITS = 24
#: Pairs of one class that are verified by one task.
_PAIRS_OF_A_TASK = 256
#: Hashes of sets that a task remembers, so as not to post equal sets again. Those of other tasks, or forgotten ones, are found to be equal later.
_RECENT = 1 << 17


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Distinct shingles of each text, rising. A text of fewer words than n is one shingle, one without words has none."""
    words = Words(texts)
    grams = gram_hashes(words.hashes, n)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        out.append(distinct(grams[a : b - n + 1].copy()) if b - a >= n else gram_hashes(words.hashes[a:b], b - a) if b > a else grams[:0])
    return out


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(docs: DataFrame) -> int:
    """By the planner's estimate of the size of docs."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(SKETCH_BITS[0], min(SKETCH_BITS[1], (size // _SLOT_BYTES).bit_length()))


def shingle_sketch(docs: DataFrame, text: str, n: int, bits: int | None = None) -> np.ndarray:
    """uint8[2**bits]: how often shingles of each slot occur in the whole corpus, on a logarithmic scale.

    Only the order of shingles and the levels depend on it, not which pairs are found. Tasks send their counts in parts, which are added up
    as they come in, so the memory for it depends on the number of slots alone.
    """
    bits = sketch_bits(docs) if bits is None else bits
    size = (1 << bits) // _SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            found = shingle_sets(batch["t"].to_pylist(), n)
            np.add.at(sums, _slot(np.concatenate(found), bits), np.uint32(1))
        for part, x in enumerate(sums.reshape(_SKETCH_PARTS, size)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch["part"].to_pylist(), batch["counts"].to_pylist()):
                sums.setdefault(part, np.zeros(size, np.uint64))[:] += np.frombuffer(zlib.decompress(x), np.uint32)
        for part, x in sums.items():
            scaled = np.minimum(255, np.round(8 * np.log2(1 + x.astype(np.float64)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([scaled.tobytes()], pa.binary())], ["part", "counts"])

    rows = docs.select(text_bytes(text).alias("t")).mapInArrow(count, "part int, counts binary")
    out = np.zeros((_SKETCH_PARTS, size), np.uint8)
    for r in rows.repartition(_SKETCH_PARTS, "part").mapInArrow(add, "part int, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def overlap_needed(n: np.ndarray | int, percent: int):
    """The shingles that a set of n has to share with any set linked to it."""
    return -(-percent * n // 100)


def ordered(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Tokens of a set in the global order: the sketch's byte, then the shingle's first 56 bits. Equal tokens of different shingles could only add candidates."""
    tokens = (sketch[_slot(s, len(sketch).bit_length() - 1)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    tokens.sort()
    return tokens


def set_features(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """doc_id, key (hash of the text), n (set size), h (hash of the set), level, prefix (tokens up to that level; null where the task has lately posted an equal set)."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = likely_counts(known.value), set()
        for batch in batches:
            found = shingle_sets(batch["t"].to_pylist(), n)
            hashes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in found]
            levels, prefixes = [], []
            for h, s in zip(hashes, found):
                new = len(s) > 0 and h not in seen
                if new:
                    seen.add(h)
                    tokens, o = ordered(s, known.value), overlap_needed(len(s), percent)
                    level = cheapest_level(counts[(tokens >> np.uint64(56)).astype(np.int64)], len(s) - o, o)
                    levels.append(level)
                    prefixes.append(tokens[: len(s) - o + level].view(np.int64))
                else:
                    levels.append(None)
                    prefixes.append(None)
            if len(seen) > _RECENT:
                seen.clear()
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(sizes), pa.array(hashes, pa.int64()), pa.array(levels, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "key", "n", "h", "level", "prefix"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("key"), text_bytes(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {id_type}, key bigint, n bigint, h bigint, level int, prefix array<bigint>")


def likely_counts(sketch: np.ndarray) -> np.ndarray:
    """For each value of the sketch, how often a shingle of such a slot is likely to occur: the slot's count less that of a usual slot."""
    return np.maximum(0.0, 2.0 ** (np.arange(256) / 8) - 2.0 ** (float(np.median(sketch)) / 8))


def cheapest_level(counts: np.ndarray, base: int, o: int, verify_cost: float = VERIFY_COST) -> int:
    """The level at which postings met plus verifications are likely to cost least. counts: of a set's tokens, in their order. A prefix of a level has base + level
    tokens; each pair takes `level` of the postings that the prefix meets, which bounds the pairs."""
    low, high = min(LEVELS[0], o), min(LEVELS[1], o)
    met = np.cumsum(counts[: base + high])[base + low - 1 :]
    return low + int(np.argmin(met * (1 + verify_cost / np.arange(low, high + 1))))


def near_classes(features: DataFrame) -> DataFrame:
    """h, n, level, score, toks, places: classes of equal sets with a prefix token that another class has too, with those of their tokens, rising, and the tokens'
    places in the order of the set. score: the postings of its tokens by its size. The class in the middle of a group of near copies, with few shingles of its own, has the highest."""
    rows = features.where("prefix IS NOT NULL").select("h", "n", "level", F.posexplode("prefix").alias("pos", "tok"))
    shared = rows.groupBy("tok").agg(F.min("h").alias("_low"), F.max("h").alias("_top"), F.count(F.lit(1)).alias("df")).where("_low <> _top").select(F.col("tok").alias("_t"), "df")
    both = rows.join(shared, F.col("tok") == F.col("_t")).select("h", "n", "level", "tok", F.col("pos").cast("int").alias("pos"), "df")
    return both.repartition("h").sortWithinPartitions("h", "tok").mapInArrow(_gathered, "h bigint, n bigint, level int, score double, toks array<bigint>, places array<int>")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a class, from its rows one after the other. Tasks that have posted equal sets have posted the same tokens: each counts once."""
    rest: list[np.ndarray] | None = None

    def put(x: list[np.ndarray]) -> pa.RecordBatch:
        h, n, level, tok, pos, df = x
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (tok[1:] != tok[:-1])))
        h, n, level, tok, pos, df = (c[new] for c in x)
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        offsets = pa.array(np.append(at, len(h)).astype(np.int32))
        score = np.add.reduceat(df, at) / n[at]
        return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(n[at]), pa.array(level[at]), pa.array(score), pa.ListArray.from_arrays(offsets, pa.array(tok)), pa.ListArray.from_arrays(offsets, pa.array(pos))], ["h", "n", "level", "score", "toks", "places"])

    for batch in batches:
        if not batch.num_rows:
            continue
        x = [batch[c].to_numpy() for c in ("h", "n", "level", "tok", "pos", "df")]
        if rest is not None:
            x = [np.concatenate(y) for y in zip(rest, x)]
        last = int(np.searchsorted(x[0], x[0][-1]))
        rest = [c[last:] for c in x]
        if last:
            yield put([c[:last] for c in x])
    if rest is not None:
        yield put(rest)


def _needed(percent: int) -> Column:
    """The shingles that sets of n_a and n_b share if they are linked."""
    return F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100.0 + percent) - 1e-9)


def may_link(percent: int, a: str, b: str) -> Column:
    """Whether a shared token can be the first that two linked sets share: sizes allow a link, and in either set no fewer tokens follow than have to be shared."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.col(f"pos_{a}") <= na - _needed(percent)) & (F.col(f"pos_{b}") <= nb - _needed(percent))


def promising(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), and shared, the common tokens of their prefixes, that share as many as the lower of their levels, and enough within all that is known of the
    prefixes. Of the set whose prefix ends first, only what follows the prefix can be shared besides."""
    after = (-F.floor(-(F.lit(percent) * F.col("n")) / 100) - F.col("level")).cast("bigint")
    side = lambda x: near.select(F.col("h").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "level", "toks")], after.alias(f"after_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    counted = both.withColumn("shared", F.size(F.array_intersect("toks_a", "toks_b")))
    enough = (F.col("shared") >= F.least("level_a", "level_b")) & (F.col("shared") + F.greatest("after_a", "after_b") >= _needed(percent))
    return counted.where(enough).select(*pairs.columns, "shared")


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those that are linked: 100 * shared >= percent * united. reps: h, rep (the id of a document that has the set).

    Texts of the classes' documents are read again and moved, not sets: words take less room than shingles. A text is known by its set's hash, so that
    ids that are null or stand for several texts do no harm.
    """
    spark = docs.sparkSession
    involved = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(reps, "h")
    bits = spark.sparkContext.broadcast(_bitmap(involved.select(_filter_slot(F.col("rep")).alias("slot"))))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch["slot"].to_numpy()
            batch = batch.filter(pa.array(bits.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0))
            if batch.num_rows:
                h = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in shingle_sets(batch["t"].to_pylist(), n)]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), batch["doc_id"], batch["t"]], ["_h", "_rep", "t"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = shingle_sets(batch["_x"].to_pylist(), n), shingle_sets(batch["_y"].to_pylist(), n)
            keep = np.zeros(batch.num_rows, bool)
            for i, (p, q) in enumerate(zip(x, y)):
                both = np.concatenate((p, q))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= percent * (len(p) + len(q) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), _filter_slot(F.col(doc_id)).alias("slot"), text_bytes(text).alias("t"))
    found = rows.mapInArrow(picked, f"_h bigint, _rep {id_type}, t binary")
    # Of repeated rows one is wanted; all of a class meet in the join already.
    texts = involved.join(found, (F.col("h") == F.col("_h")) & F.col("rep").eqNullSafe(F.col("_rep"))).groupBy("h").agg(F.first("t").alias("t"))

    def with_text(rows: DataFrame, side: str, other: str, name: str) -> DataFrame:
        """A class of many pairs is dealt over as many tasks as its pairs need, and its text to each of these."""
        dealt = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / _PAIRS_OF_A_TASK).cast("int").alias("_parts"))
        part = F.pmod(F.xxhash64(other), F.col("_parts")).cast("int").alias("_part")
        copies = texts.join(dealt.withColumnRenamed(side, "h"), "h").select(F.col("h").alias(side), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("t").alias(name))
        return rows.join(dealt, side).select(*rows.columns, part).join(copies, [side, "_part"]).drop("_part")

    return with_text(with_text(pairs, "a", "b", "_x"), "b", "a", "_y").select("a", "b", "_x", "_y").mapInArrow(linked, "a bigint, b bigint")


def _bitmap(slots: DataFrame) -> np.ndarray:
    """Packed bits of the slots that occur, least bit first; put together in blocks of 4 KB by the executors."""
    size = 1 << 15
    out = np.zeros((1 << _FILTER_BITS) // size * 4096, np.uint8).reshape(-1, 4096)
    for r in slots.groupBy(F.floor(F.col("slot") / size).cast("int").alias("block")).agg(F.bitmap_construct_agg((F.col("slot") % size).cast("bigint")).alias("bits")).collect():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _filter_slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(1 << _FILTER_BITS)).cast("int")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """h and comp, the least h that edges (a, b) lead to, for each h but these least ones. Large and small stars by turns: each vertex is tied to the least of its
    neighbours until nothing changes; the number of edges never grows."""
    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    was = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: neighbours above a vertex go to its least one.
        large = now.select(F.col("b").alias("v"), F.col("a").alias("u")).join(least.withColumnRenamed("a", "v"), "v").select(F.col("u").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a vertex and its neighbours below go to the least of them.
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        small = scratch.table(small, "stars")
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = small
        if state == was:
            break
        was = state
    out = scratch.table(now.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "h"), "components")
    scratch.drop(now)
    return out


def ngram_join(docs: DataFrame, *, n: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, and with them key (hash of the text) and group (a component, whatever its ids; null without words); a row for each row of docs.

    Documents link when 100 * shared shingles >= percent * united ones; a component is what links lead to, named by its least
    doc_id. Texts without words (nulls too) link with nothing; their component is their own id. Rows that repeat a doc_id count
    one by one, each by its own text. A null doc_id links like any other but never names a component, unless it is alone (null).
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    features = scratch.table(set_features(docs, doc_id, text, n, percent, shingle_sketch(docs, text, n)), "features")
    ids = scratch.table(features.select("doc_id", "key", "n", "h"), "ids")
    classes = scratch.table(ids.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("rep")), "classes")
    near = scratch.table(near_classes(features), "near")
    scratch.drop(features)

    links = linked_classes(docs, near, classes, scratch, doc_id, text, n, percent)
    # Equal sets are one class, so classes that are in no link have their copies too.
    comp = F.coalesce("comp", "h")
    of = classes.join(links, "h", "left").select("h", comp.alias("comp"), "rep")
    of = scratch.table(of, "components")
    names = scratch.table(of.groupBy("comp").agg(F.min("rep").alias("component_id")), "names")
    named = scratch.table(of.join(names, "comp").select("h", F.col("comp").alias("group"), "component_id"), "named")
    scratch.drop(links, classes, near, of, names)
    with_words = ids.where("n > 0").join(named, "h").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "key", "group")
    return with_words.unionByName(ids.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "key", F.lit(None).cast("bigint").alias("group")))


def one_of_each_group(docs: DataFrame, *, n: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs, as they are, without near duplicates: of each component of ngram_join() one row stays, that of the least doc_id (null last), then of the least hash of
    the text; of rows alike in both, one. Texts without words are linked with nothing and all stay.

    Rows are told apart by id and text, so rows that share an id, null too, don't go with each other. Texts of rows that are alone stay where they are.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    rows = scratch.table(ngram_join(docs, n=n, percent=percent, doc_id=doc_id, text=text).where("`group` IS NOT NULL").select("doc_id", "key", "group"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    # A group's rows are counted before they meet, and only those of groups with more rows than one matter.
    groups = scratch.table(rows.groupBy("group").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    members = rows.join(groups, "group").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")))
    pairs = scratch.table(members.groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1"), "pairs")
    kept = without_rows(docs, pairs.where("NOT stays").select("doc_id", "key"), doc_id, text)
    again = pairs.where("stays").select("doc_id", "key")
    if again.isEmpty():
        return kept
    whole = without_rows(kept, again, doc_id, text)
    return whole.unionByName(without_rows(kept, again, doc_id, text, inside=True).dropDuplicates([doc_id, text]))


def linked_classes(docs: DataFrame, near: DataFrame, classes: DataFrame, scratch: Scratch, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """h, comp: the components of classes that are linked with another, in rounds and then exactly.

    A round: of each token's classes one is the hub, at first that of the highest score, later that with the most links; classes of other
    components than the hub's meet it. Rounds go on while they link a hundredth of all classes and more pairs are likely left than there are classes.
    Then all pairs of classes in different components that share enough tokens are verified. A token whose classes are in one component needs no more work.
    """
    spark = docs.sparkSession
    open_tokens = near.select("h", "n", "level", "score", F.explode(F.arrays_zip(F.col("toks").alias("tok"), F.col("places").alias("pos"))).alias("_t")).select("h", "n", "level", "score", "_t.tok", "_t.pos")
    state = ["h", "n", "level", "score", "tok", "pos"]
    total, comps, degrees, met, k = near.count(), None, None, None, 0
    tables: list[DataFrame] = []
    spread_before = None
    while True:
        if comps is None:
            placed = open_tokens.select(*state, F.col("h").alias("comp"), F.lit(0).cast("bigint").alias("degree"))
        else:
            now = comps.join(degrees, "h", "full")
            placed = open_tokens.join(now, "h", "left").select(*state, F.coalesce("comp", "h").alias("comp"), F.coalesce("degree", F.lit(0)).alias("degree"))
        # One number orders the classes, and all that is kept of the hub is numbers: the sums stay in flat memory. Ties go by hash.
        merit = F.col("degree") * 1e9 + F.col("score") + F.pmod("h", F.lit(999983)) * 1e-7
        place = F.col("n") * F.lit(1 << 32) + F.col("pos")
        hubs = placed.groupBy("tok").agg(F.min("comp").alias("_low"), F.max("comp").alias("_top"), F.count(F.lit(1)).alias("of_tok"), *[F.max_by(c, merit).alias(x) for c, x in ((F.col("h"), "h_hub"), (place, "_place"), (F.col("comp"), "comp_hub"))]).where("_low <> _top")
        hubs = hubs.select("tok", "of_tok", "h_hub", "comp_hub", F.shiftright("_place", 32).alias("n_hub"), F.col("_place").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos_hub"))
        spread = placed.join(hubs, "tok").select(*state, "comp", "of_tok", "h_hub", "n_hub", "pos_hub", "comp_hub")
        if comps is not None:
            # Tokens within one component drop out for good: components only grow.
            old, spread = spread_before, scratch.table(spread, f"open-{k}")
            spread_before, open_tokens = spread, spread.select(*state)
            if old is not None:
                scratch.drop(old)
        away = spread.where("comp <> comp_hub")
        own = away.select(F.col("h").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("h_hub").alias("b"), F.col("n_hub").alias("n_b"), F.col("pos_hub").alias("pos_b"), "comp_hub", "of_tok")
        own = own.where(may_link(percent, "a", "b"))
        if comps is not None and (100 * found < total or (own.agg(F.sum("of_tok")).first()[0] or 0) <= total):
            break
        k += 1
        pairs = own.select("a", "b", "comp_hub").distinct()
        if met is not None:
            pairs = pairs.join(met, ["a", "b"], "left_anti")
        # Of the hubs of a component, at first of all hubs, that with the most shared tokens will do: one link joins the components.
        by = Window.partitionBy("a", "comp_hub") if comps is not None else Window.partitionBy("a")
        nearest = F.row_number().over(by.orderBy(F.desc("shared"), "b"))
        pairs = scratch.table(promising(pairs, near, percent).withColumn("_r", nearest).where("_r = 1").select("a", "b"), f"pairs-{k}")
        links = scratch.table(verified(docs, pairs, classes, doc_id, text, n, percent), f"links-{k}")
        tables += [pairs, links]
        met = pairs if met is None else met.unionByName(pairs)
        found = links.count()
        if comps is None or found:
            degrees = links.groupBy(F.col("b").alias("h")).agg(F.count(F.lit(1)).alias("degree")) if degrees is None else degrees.unionByName(links.groupBy(F.col("b").alias("h")).agg(F.count(F.lit(1)).alias("degree"))).groupBy("h").agg(F.sum("degree").alias("degree"))
            forest = links if comps is None else links.unionByName(comps.select(F.col("h").alias("a"), F.col("comp").alias("b")))
            comps, last = components(spark, forest, scratch), comps
            if last is not None:
                scratch.drop(last)

    # Left are pairs of classes in different components. A class has its tokens of one hub as bits, by their places in the hub's order, so that a pair comes up
    # once for each hub and 64 places, not once for each token that it shares.
    bit = F.expr("shiftleft(1L, cast(pos_hub % 64 AS int))")
    masks = spread.groupBy("h", "n", "comp", "h_hub", "comp_hub", F.floor(F.col("pos_hub") / 64).alias("block")).agg(F.bit_or(bit).alias("bits"), F.min("pos").alias("pos"))
    masks = scratch.table(masks, "masks")
    left = masks.where("comp <> comp_hub").select("h_hub", "block", "comp_hub", *[F.col(c).alias(f"{c}_a") for c in ("h", "n", "pos", "comp", "bits")])
    right = masks.select(F.col("h_hub").alias("_hub"), F.col("block").alias("_block"), *[F.col(c).alias(f"{c}_b") for c in ("h", "n", "pos", "comp", "bits")])
    common = F.col("bits_a").bitwiseAND(F.col("bits_b"))
    once = (F.col("comp_b") == F.col("comp_hub")) | (F.col("h_a") < F.col("h_b"))
    joined = left.join(right, (F.col("h_hub") == F.col("_hub")) & (F.col("block") == F.col("_block")) & (F.col("comp_a") != F.col("comp_b")) & once & (common != 0) & may_link(percent, "a", "b"))
    # A pair comes up in either order, by the component that the hub lies in. How many tokens it shares is seen from the prefixes.
    pairs = joined.select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b")).distinct()
    both_ways = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = scratch.table(promising(pairs.join(both_ways, ["a", "b"], "left_anti"), near, percent).select("a", "b"), "pairs")
    more = scratch.table(verified(docs, pairs, classes, doc_id, text, n, percent), "links")
    forest = more.unionByName(comps.select(F.col("h").alias("a"), F.col("comp").alias("b")))
    out = components(spark, forest, scratch)
    scratch.drop(*tables, pairs, more, comps, spread, masks)
    return out
