"""SimHash near-duplicate groups by multi-index hashing.

Each whole text gets a 64-bit fingerprint in one pass; from there on only distinct fingerprints travel. The index has one
table for each half (segment) of the fingerprint, keyed by the value of that half. Fingerprints at distance 2 or less
differ by one bit or none in one of the halves, so each fingerprint enumerates the Hamming ball of radius 1 around the
value of each of its segments, fetches the entries that the table has under these values, and verifies the complete
distance. Of two values that differ in a bit, the one without it asks for the other: about 17 values a segment, not 33.

A segment value of more than ``CROWDED`` fingerprints is left out of the tables, since all pairs under it would be
compared; all fingerprints of such a value, and those a bit from one, take an exact way besides: they meet under the 65
whole fingerprints at distance 0 or 1 from them. Two at distance 2 or less share one (that halfway between them), and any
two that share one are at distance 2 or less, so at most 65 meet under a key and each is linked to the smallest of them.

Groups are the connected components of these links: labels flow along keys, then jump to their label's label, until
nothing changes. Every round is written to the shared folder.

Defined results: null, empty and blank texts have the fingerprint 0 and are linked like any other; fewer words than
``words`` are one shingle; equal rows share a group; a null id is carried along, and counts as the smallest of its group
only if there is no other; an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

SEED = 42
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are counted at a time.
BLOCK = 65_536


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included."""
    import xxhash

    found = _WORDS.findall(text)
    if not found:
        return np.empty(0, np.uint64)
    data = " ".join(found).encode().translate(_LOWER)
    cut = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
    starts = [0, *(cut[: len(found) - words] + 1).tolist()]
    ends = [*cut[words - 1 :].tolist(), len(data)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[lo : lo + BLOCK])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py() or "", words)) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


#: Fingerprints under one segment value that are still compared pair by pair; rows of probes that one task enumerates, about.
CROWDED, PROBES = 16, 2_000_000


def segment_table(distinct: DataFrame) -> DataFrame:
    """fp, segment (0: the lower half, 1: the upper), value: the entries of both tables."""
    return distinct.select("fp", F.posexplode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))).alias("segment", "value"))


def _around(value: str, up: bool) -> str:
    """SQL for a segment's value and those a bit from it; ``up``: only those with one bit more."""
    flip = f"{value} | shiftleft(1L, b)" if up else f"{value} ^ shiftleft(1L, b)"
    return f"array_distinct(concat(array({value}), transform(sequence(0, 31), b -> {flip})))"


def table_links(entries: DataFrame, max_distance: int) -> DataFrame:
    """least, other: pairs of fingerprints of ``entries`` (fp, segment, value) that a probe fetched and the distance verified."""
    probes = entries.select(F.col("fp").alias("asks"), "segment", F.explode(F.expr(_around("value", True))).alias("value"))
    distance = F.bit_count(F.col("asks").bitwiseXOR(F.col("fp")))
    fetched = probes.join(entries, ["segment", "value"]).filter((F.col("asks") != F.col("fp")) & (distance <= max_distance))
    return fetched.select(F.least("asks", "fp").alias("least"), F.greatest("asks", "fp").alias("other"))


def ball_links(distinct: DataFrame, max_distance: int) -> DataFrame:
    """key, fp: those that meet under a whole fingerprint at distance 0 or 1 from them and are linked there."""
    half = lambda lo: f"transform(sequence({lo}, {lo + 31}), b -> fp ^ shiftleft(1L, b))"
    keyed = distinct.select("fp", F.explode(F.expr(f"concat(array(fp), {half(0)}, {half(32)})")).alias("key"))
    met = keyed.groupBy("key").agg(F.min("fp").alias("least"), F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    if max_distance < 2:  # of those around a key, only the key itself is that near to the others
        met = met.filter(F.array_contains("fps", F.col("key"))).withColumn("least", F.col("key"))
    checked = met.select("key", "least", F.explode("fps").alias("fp"))
    return checked.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= max_distance).select("key", "fp")


def links(distinct: DataFrame, max_distance: int = 2) -> DataFrame:
    """key, fp: the ``distinct`` fingerprints (column fp) in groups under keys; those under a key are connected by links."""
    if max_distance not in (1, 2):
        raise ValueError("two segments and balls of radius 1 serve distances of 1 and 2")
    distinct = scratch.table(distinct.select("fp"))
    # Each row becomes 36: enough tasks for that, whatever the size of the stored table.
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() * 36 // PROBES))
    entries = segment_table(distinct.repartition(tasks))
    crowded = scratch.table(entries.groupBy("segment", "value").count().filter(F.col("count") > CROWDED).select("segment", "value"))
    pairs = table_links(entries.join(crowded, ["segment", "value"], "left_anti"), max_distance)
    star = F.explode(F.array(F.struct(F.col("least").alias("key"), F.col("least").alias("fp")), F.struct(F.col("least").alias("key"), F.col("other").alias("fp"))))
    edges = pairs.select(star.alias("e")).select("e.key", "e.fp")
    if not crowded.isEmpty():
        near = crowded.select("segment", F.explode(F.expr(_around("value", False))).alias("value")).distinct()
        crowd = entries.join(near, ["segment", "value"], "left_semi").select("fp").distinct()
        edges = edges.unionByName(ball_links(crowd.repartition(tasks), max_distance))
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp, label: for each fingerprint in ``edges`` (key, fp) the smallest fingerprint it reaches."""
    edges = scratch.table(edges)
    labels = scratch.table(edges.groupBy("fp").agg(F.min("fp").alias("label")))
    while True:
        by_key = edges.join(labels, "fp").groupBy("key").agg(F.min("label").alias("least"))
        flowed = edges.join(by_key, "key").groupBy("fp").agg(F.min("least").alias("near"))
        # A label is a fingerprint too: what it flowed to is this label's next one.
        jump = flowed.select(F.col("fp").alias("label"), F.col("near").alias("far"))
        new = labels.join(flowed, "fp").join(jump, "label", "left").select("fp", F.col("label").alias("old"), F.least("near", F.coalesce("far", "near")).alias("label"))
        new = scratch.table(new)
        changed = new.filter(F.col("old") != F.col("label")).limit(1).count()
        scratch.drop(labels)
        if not changed:
            scratch.drop(edges)
        after = new.select("fp", "label")
        after.scratch_path = new.scratch_path
        if not changed:
            return after
        labels = after


def near_duplicates(docs: DataFrame, words: int = 3, max_distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest id that the document reaches over links, itself included."""
    marks = scratch.table(fingerprints(docs, words, id_col, text_col))
    place = scratch.mark()
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    edges = links(distinct.select("fp"), max_distance)
    labels = components(edges)
    scratch.drop_since(docs.sparkSession, place, labels)
    grouped = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    roots = grouped.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_fp = grouped.select("fp", "label").join(roots, "label").select("fp", "component_id")
    return marks.join(by_fp, "fp").select("doc_id", "fp", "component_id")


#: Min-wise hashes of a signature, and how the first of them make band keys: fixed odd factors from a fixed seed.
HASHES, BANDS, ROWS = 256, 16, 4
#: What the estimate may fall short of the similarity before a pair is left out: four times its standard error at 0.8.
#: The pairs that pass are decided by their sets of shingles.
TOLERANCE = 0.1
#: Pairs of a representative that are verified in one task, about.
PAIR_BLOCK = 256


def _factors() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least of each of the multiplied hashes; zeros for no hash."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 1024):
        part = hashes[lo : lo + 1024]
        mixed = (part ^ (part >> np.uint64(29)))[:, None] * factors
        np.minimum(least, mixed.min(axis=0), out=least)
    return least if len(hashes) else np.zeros(len(factors), np.uint64)


def word_class(text: str) -> int:
    """A hash of the text's words: equal for texts of equal word sequences."""
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(_WORDS.findall(text)).encode().translate(_LOWER), SEED)


def signatures(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, cls (of equal word sequences), fp (the SimHash), bands (keys), sig (16 bits of each min-wise hash)."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        factors = _factors()
        for batch in batches:
            cls, fps, bands, sigs = [], [], [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                h = shingle_hashes(text, words)
                least = minwise(h, factors)
                keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
                cls.append(word_class(text))
                fps.append(fingerprint(h))
                bands.append(np.array(keys, np.uint64).view(np.int64).tolist())
                sigs.append((least >> np.uint64(20)).astype("<u2").tobytes())
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], signed(cls), signed(fps), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _alike(pairs: DataFrame, sigs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (cls, rep) whose signatures agree in the share that the similarity asks for, less the tolerance."""
    least = round((similarity - TOLERANCE) * HASHES)
    both = pairs.join(sigs, "cls").join(sigs.select(F.col("cls").alias("rep"), F.col("sig").alias("rep_sig")), "rep").select("cls", "rep", "sig", "rep_sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig", "rep_sig"))
                yield batch.select(["cls", "rep"]).filter(pa.array((a == b).sum(1) >= least))

    return both.mapInArrow(run, "cls long, rep long")


def _sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """cls, shingles (the sorted distinct hashes) of the ``needed`` classes, each from one of its rows; stored.

    Rows are met by id and text together, so that the copies of a text don't come to one task.
    """
    text = F.col(f"`{text_col}`")
    of = classes.join(needed.distinct(), "cls", "left_semi").select(F.col("row.doc_id").alias("least"), F.col("row.text_hash").alias("least_hash"))
    mine = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    texts = mine.join(of, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("text_hash") == F.col("least_hash")), "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                part = [t.as_py() or "" for t in whole["text"].slice(lo, 256)]
                cls = np.array([word_class(t) for t in part], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([np.unique(shingle_hashes(t, words)).tobytes() for t in part], pa.binary())], names=["cls", "shingles"])

    return scratch.table(texts.select("text").mapInArrow(run, "cls long, shingles binary"))


def _similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * least.denominator >= (len(a) + len(b) - common) * least.numerator


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (cls, rep and other columns) whose sets of shingles have the similarity."""
    least, columns = Fraction(str(similarity)), pairs.columns
    # A representative of very many pairs is dealt into parts.
    often = pairs.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).alias("parts"))
    dealt = pairs.join(often, "rep").withColumn("part", F.pmod(F.xxhash64("cls"), "parts"))
    reps = sets.join(often, sets["cls"] == often["rep"]).select("rep", F.col("shingles").alias("rep_shingles"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = dealt.join(sets, "cls").join(reps, ["rep", "part"]).select(*columns, "shingles", "rep_shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least) for x, y in zip(batch["shingles"], batch["rep_shingles"])]
            yield batch.select(columns).filter(pa.array(alike, pa.bool_()))

    return both.mapInArrow(run, pairs.schema)


#: Entries of a block, about, when a key's entries are held against each other.
ENTRY_BLOCK = 512


def _undecided(entries: DataFrame, labels: DataFrame, classes: DataFrame, similarity: float, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """label, rep_label: groups that a pair joins which meets under a key of ``entries`` (kind, key, cls) and is similar.

    Under each key all pairs of different groups are decided, but those within a group are not: the entries outside the
    key's largest group are held against all others, block by block, so that no task has more than two blocks at a time.
    A block gives only pairs that join two groups which its earlier pairs had left apart.
    """
    estimate, least = round((similarity - TOLERANCE) * HASHES), Fraction(str(similarity))
    key = ["kind", "key"]
    labelled = scratch.table(entries.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")))
    groups = labelled.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = groups.groupBy(*key).agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).filter((F.col("most.n") < F.col("n")) & (F.col("n") > 2))  # of two entries one was the representative
    blocks = lambda n: F.ceil(n / ENTRY_BLOCK)
    mixed = mixed.select(*key, F.col("most.label").alias("main"), blocks(F.col("n") - F.col("most.n")).alias("subs"), blocks(F.col("n")).alias("parts"))
    rows = scratch.table(labelled.join(mixed, key).withColumn("asks", F.col("label") != F.col("main")))
    sets = _sets(docs, classes, rows.select("cls"), words, id_col, text_col)
    own = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = rows.withColumn("part", own(F.col("parts"), 2)).withColumn("sub", every("subs")).withColumn("side", F.lit(False))
    ask = rows.filter("asks").withColumn("sub", own(F.col("subs"), 1)).withColumn("part", every("parts")).withColumn("side", F.lit(True))
    block = F.xxhash64(*key, "sub", "part").alias("block")
    known = classes.select("cls", "sig").join(sets, "cls")
    dealt = held.unionByName(ask).select(block, "side", "asks", "cls", "label").join(known, "cls").repartition("block").sortWithinPartitions("block")

    def compare(side: np.ndarray, asks: np.ndarray, cls: np.ndarray, label: np.ndarray, sig: np.ndarray, shingles: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, group = np.unique(label, return_inverse=True)
        right = np.flatnonzero(~side)
        found: list[list[int]] = [[], []]
        for i in np.flatnonzero(side):
            j = right[(group[right] != group[i]) & (~asks[right] | (cls[right] > cls[i]))]
            for k in j[np.count_nonzero(sig[j] == sig[i], axis=1) >= estimate]:
                if group[k] != group[i] and _similar(shingles[i], shingles[k], least):
                    found[0].append(label[i])
                    found[1].append(label[k])
                    group[group == group[k]] = group[i]
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["label", "rep_label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for whole in batches:
            for lo in range(0, whole.num_rows, ENTRY_BLOCK):
                batch = whole.slice(lo, ENTRY_BLOCK)
                sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), "<u2").reshape(-1, HASHES)
                sets = np.empty(batch.num_rows, object)
                for i, x in enumerate(batch["shingles"]):
                    sets[i] = np.frombuffer(x.as_py(), np.uint64)
                new = [batch[c].to_numpy(zero_copy_only=False) for c in ("block", "side", "asks", "cls", "label")] + [sig, sets]
                kept = [np.concatenate(x) for x in zip(kept, new)] if kept else new
                cuts = [0, *(np.flatnonzero(np.diff(kept[0]) != 0) + 1).tolist()]
                for a, b in zip(cuts, cuts[1:]):
                    yield from compare(*(x[a:b] for x in kept[1:]))
                kept = [x[cuts[-1] :] for x in kept]  # the block that may go on
        if kept:
            yield from compare(*kept[1:])

    return dealt.mapInArrow(run, "label long, rep_label long").distinct()


def _star(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """key, fp: the pairs as edges for ``components``."""
    return pairs.select(F.col(b).alias("key"), F.col(a).alias("fp")).unionByName(pairs.select(F.col(b).alias("key"), F.col(b).alias("fp"))).distinct()


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: groups of documents whose sets of shingles are alike, by way of links of ``similarity`` or more.

    SimHash within two bits only sees copies that differ in very few words (at a similarity of 0.8 fingerprints differ in
    about ten bits, more than any Hamming ball serves), so bands of min-wise hashes of the same shingles give further
    candidates. Under each table key the entry that meets most others (in a group of copies: their original) stands for
    the key, and every other entry is held against it. Then the pairs that meet under a key and are still in different groups
    are compared (``_undecided``), so each pair that meets is decided or lies in one group anyway. The share of
    equal min-wise hashes leaves out pairs far from the similarity; the others are decided by their sets of shingles.
    """
    marks = scratch.table(signatures(docs, words, id_col, text_col))
    classes = scratch.table(marks.groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.min(F.struct("fp", "bands", "sig")).alias("m")).select("cls", "least_id", "row", "m.*"))
    place = scratch.mark()
    entries = classes.select("cls", F.explode("bands").alias("key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    multi = scratch.table(entries.join(sizes, "key"))
    score = multi.groupBy("cls").agg(F.sum("n").alias("score"))
    reps = multi.join(score, "cls").groupBy("key").agg(F.max(F.struct("score", "cls")).alias("r")).select("key", F.col("r.cls").alias("rep"))
    by_band = multi.join(reps, "key").select("cls", "rep")
    one_of = classes.groupBy("fp").agg(F.min("cls").alias("cls"))
    near = scratch.table(links(one_of.select("fp")))
    ends = near.groupBy("key").agg(F.min("fp").alias("rep_fp"))
    by_bits = near.join(ends, "key").filter(F.col("fp") != F.col("rep_fp")).select("fp", "rep_fp").distinct().join(one_of.withColumnRenamed("cls", "a"), "fp").join(one_of.select(F.col("fp").alias("rep_fp"), F.col("cls").alias("b")), "rep_fp").select(F.col("a").alias("cls"), F.col("b").alias("rep"))
    same_fp = classes.select("cls", "fp").join(one_of.withColumnRenamed("cls", "rep"), "fp").select("cls", "rep")
    pairs = by_band.unionByName(by_bits).unionByName(same_fp).filter(F.col("cls") != F.col("rep")).distinct()
    likely = scratch.table(_alike(pairs, classes.select("cls", "sig"), similarity))
    needed = likely.select(F.explode(F.array("cls", "rep")).alias("cls"))
    alike = scratch.table(_verified(likely, _sets(docs, classes, needed, words, id_col, text_col), similarity))
    labels = scratch.table(components(_star(alike, "cls", "rep")).select(F.col("fp").alias("cls"), "label"))
    shared = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2)
    met = multi.select(F.lit(0).alias("kind"), "key", "cls")
    met = met.unionByName(near.join(classes.select("cls", "fp"), "fp").select(F.lit(1).alias("kind"), "key", "cls"))
    met = met.unionByName(classes.select("cls", "fp").join(shared, "fp").select(F.lit(2).alias("kind"), F.col("fp").alias("key"), "cls"))
    further = scratch.table(_undecided(met, labels, classes, similarity, docs, words, id_col, text_col))
    joined = components(_star(further, "label", "rep_label"))
    scratch.drop_since(docs.sparkSession, place, labels, joined)
    joined = joined.select(F.col("fp").alias("label"), F.col("label").alias("joined"))
    labels = labels.unionByName(classes.join(labels, "cls", "left_anti").select("cls", F.col("cls").alias("label")))
    grouped = classes.select("cls", "fp", "least_id").join(labels, "cls").join(joined, "label", "left").withColumn("label", F.coalesce("joined", "label"))
    roots = grouped.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = grouped.select("cls", F.col("fp").alias("class_fp"), "label").join(roots, "label").select("cls", "class_fp", "component_id")
    # Equal hashes of the words are trusted only with equal fingerprints; a text that fails that stands for itself.
    return marks.select("doc_id", "cls", "fp").join(of_class, "cls").select("doc_id", F.when(F.col("fp") == F.col("class_fp"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id (and text hash); all columns as they are."""
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name clashes with a helper's
    rows = docs.toDF(*place.values())
    key, text = F.col(place[id_col]), F.col(place[text_col])
    marked = rows.select(F.struct(key.alias("id"), F.xxhash64(text).alias("text_hash")).alias("kw_row"), text.alias("kw_text"))
    groups = similar_groups(marked, words, similarity, "kw_row", "kw_text")
    keep = groups.select("component_id").distinct().select(F.col("component_id.id").alias("kw_id"), F.col("component_id.text_hash").alias("kw_hash"))
    kept = rows.join(keep, key.eqNullSafe(F.col("kw_id")) & (F.xxhash64(text) == F.col("kw_hash")), "left_semi")
    first = F.row_number().over(Window.partitionBy(key, F.xxhash64(text)).orderBy(key))  # equal rows
    return kept.withColumn("kw_first", first).filter(F.col("kw_first") == 1).select(*place.values()).toDF(*place)
