"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. ``sketch`` turns each text into its set of ``n``-word shingles (64-bit hashes), a 128-bit key of the set
   and band keys: ``bands`` groups of ``rows`` minimum hashes, chosen for the target recall at the threshold.
2. Documents with equal sets are one class; only its representative (least id) goes on, so exact copies
   are never paired.
3. Representatives meet on (band, key). Buckets with the same members are reduced to the first band's.
   A large bucket is cut into blocks of members, and a task gets one pair of blocks: every pair is compared once,
   no pair is emitted and no task holds a whole bucket.
4. A task counts shared shingles of all its pairs by matrix products over the distinct membership patterns of
   shingles, keeps pairs with Jaccard >= ``threshold`` that meet in no earlier band (so a pair counts once), and returns per member
   its number of links and one edge to the least member of its local component.
5. ``components`` joins these edges to classes by large-star and small-star steps on stored tables.

Result: one row per document with ``class_id`` (least id of its connected component), ``copy_of`` (least id with the
same set), ``n_links`` (other documents at or above the threshold, copies included) and ``n_set_links`` (other sets).

Edge cases: words are runs of characters other than space and \\t to \\r, compared as they are; a text of
one to four words has one shingle, all of it; NULL and empty texts and those without words have the same
empty set and link to each other only; rows with an equal ``doc_id`` are one node; a NULL ``doc_id`` is replaced inside
by a negative hash of the text; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import blocks, bytes_of, map_texts, mixed, stored

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Members and shingles that one side of a block comparison holds, about.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 20
#: Text bytes that are hashed at once.
BLOCK_TEXT = 2 << 20
#: Most ids of a member filter.
FILTER_IDS = 1 << 24


def plan_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows with the longest rows whose ``bands * rows <= most`` hashes find a pair at ``threshold`` with ``recall``."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def row_id() -> Column:
    """``doc_id``, or a negative hash of the text where it is NULL."""
    hashed = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseOR(F.lit(-(1 << 63)))
    return F.coalesce(F.col("doc_id").cast("bigint"), hashed)


def word_hashes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """A content hash of every word, and the offsets of the texts in them."""
    body, at = bytes_of(texts)
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    space = _SPACE[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[at] = True
    bounds = np.flatnonzero(edge)
    is_word = ~space[bounds[:-1]]
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
    coded = parts.dictionary_encode()
    distinct = coded.dictionary
    chars, stops = bytes_of(distinct)
    width = np.diff(stops)
    place = np.arange(len(chars)) - np.repeat(stops[:-1], width)
    weight = mixed(place.astype(np.uint64) * _FACTOR + np.uint64(1)) | np.uint64(1)
    sums = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * weight, stops[:-1])
    hashes = mixed(sums + width.astype(np.uint64) * _FACTOR)
    words = hashes[coded.indices.to_numpy()[is_word]]
    return words, np.concatenate([[0], np.cumsum(is_word)])[np.searchsorted(bounds, at)]


def shingle_sets(texts: pa.LargeStringArray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    grams = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        grams = grams * _FACTOR + words[k : k + len(grams)]
    grams = mixed(grams)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                short = short * _FACTOR + w
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band keys of the sets, (sets, bands) of int64; those of an empty set mean nothing."""
    factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * _FACTOR) | np.uint64(1)
    filled = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), bands), np.uint64)
    if not filled:
        return out.view(np.int64)
    flat = np.concatenate([sets[i] for i in filled])
    starts = np.cumsum([0, *(len(sets[i]) for i in filled[:-1])])
    keys = np.zeros((len(filled), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(filled), band, np.uint64)
        for row in range(rows):
            key = mixed(key * _FACTOR + np.minimum.reduceat(flat * factors[band * rows + row], starts))
        keys[:, band] = key
    out[filled] = keys
    return out.view(np.int64)


def _sketch(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, limit=BLOCK_TEXT):
            sets = shingle_sets(texts, n)
            keys = band_keys(sets, bands, rows)
            filled = np.array([len(s) > 0 for s in sets])
            offsets = np.concatenate([[0], np.cumsum(filled * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "row_id": batch.column("row_id"),
                    "set_key": pa.array([set_key(s) for s in sets], pa.string()),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[filled].ravel())),
                }
            )

    return run


def sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    schema = "doc_id bigint, row_id bigint, set_key string, n_shingles bigint, bands array<bigint>"
    return map_texts(docs.select("doc_id", row_id().alias("row_id"), "text"), _sketch(n, bands, rows), schema)


@dataclass
class Members:
    """A Bloom filter over ids: ``words`` of 64 bits."""

    words: np.ndarray

    def probably(self, ids: np.ndarray) -> np.ndarray:
        found = np.ones(len(ids), bool)
        for place in self.places(ids, len(self.words) * 64):
            found &= (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found

    @staticmethod
    def places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
        h = mixed(ids.astype(np.int64).view(np.uint64) * _FACTOR)
        return [((h >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 18, 36)]


def _member_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(Members.places(batch.column("rep").to_numpy(), bits)))
            word, first = np.unique(place >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first) if len(place) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(word, pa.int64()), "bits": pa.array(value.view(np.int64), pa.int64())})

    return run


def member_filter(ids: DataFrame, count: int) -> Members:
    """A filter over the column ``rep`` with about ten bits per id; its words are what reaches the driver."""
    bits = 1 << max(16, (10 * count - 1).bit_length())
    words = np.zeros(bits // 64, np.uint64)
    rows = ids.mapInArrow(_member_words(bits), "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Members(words)


def _sets(n: int, wanted: Members | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:
            batches = (b.filter(pa.array(wanted.probably(b.column("rep").to_numpy()))) for b in batches)
        for batch, texts in blocks(batches, limit=BLOCK_TEXT):
            sets = shingle_sets(texts, n)
            yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "set_key": pa.array(map(set_key, sets), pa.string()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def shared_counts(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections.

    Shingles with the same members are one weighted column; those of a single member are left out
    but on the diagonal, which is not needed.
    """
    m = len(sets)
    member = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    marks = mixed(np.arange(1, m + 1, dtype=np.uint64) * _FACTOR)
    pattern = np.zeros(column.max() + 1, np.uint64)
    np.add.at(pattern, column, marks[member])
    held = np.bincount(column)
    _, first, kind, weight = np.unique(pattern, return_index=True, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(held[first] > 1)
    slot = np.full(len(first), -1)
    slot[shared] = np.arange(len(shared))
    is_first = np.zeros(len(pattern), bool)
    is_first[first] = True
    kept = is_first[column] & (slot[kind[column]] >= 0)
    member, place = member[kept], slot[kind[column[kept]]]
    order = np.argsort(place, kind="stable")
    member, place = member[order], place[order]
    out = np.zeros((m, m))
    for begin in range(0, len(shared), chunk):
        a, b = np.searchsorted(place, [begin, begin + chunk])
        x = np.zeros((m, min(chunk, len(shared) - begin)), np.float32)
        x[member[a:b], place[a:b] - begin] = 1
        out += (x * weight[shared[begin : begin + chunk]].astype(np.float32)) @ x.T
    return out


def _local_roots(links: np.ndarray) -> np.ndarray:
    """The least member number of each member's component."""
    label = np.arange(len(links))
    while True:
        nearest = np.where(links, label, len(links)).min(axis=1, initial=len(links))
        lower = np.minimum(label, nearest)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            return label
        label = lower


VERIFIED = "rep bigint, n_set_links bigint, n_doc_links bigint, root bigint"


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending"), ("set_key", "ascending")])
        reps, copies, block = (table.column(c).to_numpy() for c in ("rep", "copies", "block"))
        band, left, right = (table.column(c)[0].as_py() for c in ("band", "left", "right"))
        keys = np.array(table.column("bands").to_pylist())
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets], np.float64)
        shared = shared_counts(sets)
        links = shared / np.maximum(size[:, None] + size[None, :] - shared, 1) >= threshold
        np.fill_diagonal(links, False)
        if left != right:
            links &= block[:, None] != block[None, :]
        for earlier in range(band):
            links &= keys[:, earlier][:, None] != keys[:, earlier][None, :]
        linked = links.any(axis=1)
        roots = reps[_local_roots(links)]
        columns = [reps, links.sum(axis=1), (links * copies[None, :]).sum(axis=1), roots]
        return pa.table({name: pa.array(c[linked].astype(np.int64)) for name, c in zip(("rep", "n_set_links", "n_doc_links", "root"), columns)})

    return run


def components(edges: DataFrame, *, most: int = 60) -> DataFrame:
    """``node`` and ``root`` (least node of its component) from edges ``u``, ``v``; every pass is a stored table."""

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = pairs.join(near, "u")
        if large:
            return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        return moved.select("e.*").where(F.col("u") != F.col("v"))

    def state(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    known = state(pairs)
    for _ in range(most):
        if not known[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pairs = stored(stars(stars(both, True).distinct(), False).distinct(), "stars")
        now = state(pairs)
        if now == known:
            break
        known = now
    else:
        raise RuntimeError(f"components are not joined after {most} passes")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _candidate_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Shingle sets of the wanted rows and of some more.

    Texts are chosen by a filter of ``wanted`` where they are read, so that no text is shuffled. The filter is made
    for at most ``FILTER_IDS`` ids (20 MB of bits); beyond that the texts meet the ids in a join.
    """
    texts = docs.select(row_id().alias("rep"), "text")
    count = wanted.count()
    if count <= FILTER_IDS:
        chosen = _sets(n, member_filter(wanted, count))
    else:
        texts, chosen = texts.join(wanted, "rep", "left_semi"), _sets(n, None)
    return map_texts(texts, chosen, "rep bigint, set_key string, shingles binary")


def join(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_id, class_id, copy_of, n_links, n_set_links."""
    bands, rows = plan_bands(threshold, recall)
    sketches = stored(sketch(docs, n, bands, rows), "sketches")
    classes = stored(
        sketches.groupBy("set_key").agg(
            F.min("row_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
        ),
        "classes",
    )
    placed = classes.select("rep", "set_key", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = (
        placed.groupBy("band", "key")
        .agg(
            F.count("*").alias("members"),
            F.sum("n_shingles").alias("shingles"),
            F.sum(F.xxhash64("set_key").cast("decimal(38,0)")).alias("mark"),
        )
        .where("members > 1")
    )
    first = buckets.groupBy("members", "mark").agg(F.min(F.struct("band", "key", "shingles")).alias("b")).select(
        "b.band",
        "b.key",
        F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("b.shingles") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"),
    )
    members = stored(placed.join(first, ["band", "key"]).select("band", "key", "rep", "set_key", "n_blocks"), "buckets")
    sets = _candidate_sets(docs, members.select("rep").distinct(), n).dropDuplicates(["rep", "set_key"])
    rows_of = sets.join(classes.select("rep", "set_key", "copies", "bands"), ["rep", "set_key"])
    own = F.pmod(F.xxhash64("set_key"), F.col("n_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    dealt = (
        members.withColumn("block", own).withColumn("other", other)
        .withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
        .select("band", "key", "left", "right", "block", "rep", "set_key")
        .join(rows_of, ["rep", "set_key"])
    )
    verified = stored(dealt.groupBy("band", "key", "left", "right").applyInArrow(_verify(threshold), VERIFIED), "verified")
    counts = verified.groupBy("rep").agg(F.sum("n_set_links").alias("n_set_links"), F.sum("n_doc_links").alias("n_doc_links"))
    roots = components(verified.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    zero = F.lit(0).cast("bigint")
    per_class = (
        classes.select("set_key", "rep", "copies").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "set_key",
            F.col("rep").alias("copy_of"),
            F.coalesce("root", "rep").alias("class_id"),
            (F.coalesce("n_doc_links", zero) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("n_set_links", zero).alias("n_set_links"),
        )
    )
    return sketches.select("doc_id", "row_id", "set_key").join(per_class, "set_key").select("doc_id", "row_id", "class_id", "copy_of", "n_links", "n_set_links")


def keep_first(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class: one per class, whole and with all columns (not ``_row_id``, ``_rows``).

    Where rows share the id of a class, each of their different texts stays, and of rows with an equal text the one with the least hash of
    all its columns.
    """
    kept = joined.where(F.col("row_id") == F.col("class_id")).groupBy(F.col("row_id").alias("_row_id")).agg(F.count("*").alias("_rows"))
    kept = stored(kept, "kept")
    rows = docs.withColumn("_row_id", row_id()).join(kept, "_row_id")
    if kept.where("_rows > 1").limit(1).count():
        own = F.struct(*docs.columns)
        many = rows.where("_rows > 1").groupBy("_row_id", F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.min_by(own, F.xxhash64(own)).alias("_row"))
        rows = rows.where("_rows = 1").select(*docs.columns).unionByName(many.select("_row.*"))
    return rows.select(*docs.columns)
