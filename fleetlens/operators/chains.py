"""Listings whose pages carry tokens only: pages are numbered by list ranking, on row numbers instead of tokens.

A page was asked for with a token (none for the first page) and names the token of the next one. One grouping by token finds the
page before every page. Lists of up to ``TASK_LINKS`` links are then ranked whole, many to a task. Longer ones are shortened first: in a
round the links whose hash is below those of both neighbours, a third of them, leave the list and their neighbours are joined, so that all
rounds together move a few times the links, however long the list is. The links that left are placed behind the one
before them, the last round first. Steps are written to the shared folder, so a lost executor repeats one.

Two different pages for one token are a fork, and a token that two pages name has no page before it: both break the chain
there instead of being followed. What comes back to itself is a circle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import fleet
from fleetlens.session import stored

#: Where a page stands: in the chain from the start; at a token with several pages; behind a token
#: that is named several times; behind no page at all (or behind a fork); in a circle.
PLACES = ("chain", "fork", "repeated", "loose", "circle")
#: Links of one list that a task holds at once, and links of short lists that are dealt to a task.
TASK_LINKS, DEALT_LINKS = 1_000_000, 250_000
#: No link before or behind.
NONE = -1


def rank(links: DataFrame, key: str, own: str, following: str) -> DataFrame:
    """``key``, ``own``, ``rank`` (from 0) and ``place`` of every link of the lists of ``key``.

    ``own`` is '' at the start of a list and ``following`` NULL at its end; equal links count once.
    """
    plain = links.select(F.col(key).alias("_key"), F.col(own).alias("_own"), F.col(following).alias("_following")).distinct()
    plain = stored(plain.withColumns({"_id": F.monotonically_increasing_id(), "_pages": F.lit(1)}), "links")
    placed = _placed(stored(_nodes(plain), "nodes"))
    return plain.join(placed, "_id").select(F.col("_key").alias(key), F.col("_own").alias(own), "rank", "place")


def _nodes(links: DataFrame) -> DataFrame:
    """One row per token of different links (``_key, _own, _following, _id, _pages``): the smallest ``_id`` of its links, the link
    before it (``_prev``) or its ``place`` if it follows none. ``_key`` and ``_token`` stay where it has several pages.
    """
    nothing = F.lit(None).cast("bigint")
    own = F.struct(F.col("_own").alias("_token"), F.col("_id").alias("_of"), F.col("_pages").cast("bigint").alias("_pages"), nothing.alias("_by"))
    named = F.struct(F.col("_following").alias("_token"), nothing.alias("_of"), nothing.alias("_pages"), F.col("_id").alias("_by"))
    sides = links.select("_key", F.inline(F.array(own, named))).where(F.col("_of").isNotNull() | F.col("_token").isNotNull())
    nodes = sides.groupBy("_key", "_token").agg(
        F.min("_of").alias("_id"), F.count("_of").alias("_links"), F.sum("_pages").alias("_pages"), F.count("_by").alias("_times"), F.min("_by").alias("_before")
    )
    place = (
        F.when(F.col("_links") > 1, "fork")
        .when(F.col("_token") == "", F.when(F.col("_times") == 0, "chain").otherwise("repeated"))
        .when(F.col("_times") > 1, "repeated")
        .when(F.col("_times") == 0, "loose")
    )
    several = F.col("_pages") > 1
    return nodes.where(F.col("_id").isNotNull()).select(
        F.xxhash64("_key").alias("_lot"), "_id", F.col("_before").alias("_prev"), place.alias("place"), F.when(several, F.col("_key")).alias("_key"), F.when(several, F.col("_token")).alias("_token"), several.alias("_several")
    )


def _placed(nodes: DataFrame) -> DataFrame:
    """``_id``, ``rank`` and ``place`` of stored nodes. Lists of one ``_lot`` (a hash of their key) stay together."""
    going = nodes.where(F.col("place").isNull()).select("_lot", "_id", "_prev", F.lit(1).cast("bigint").alias("_steps"))
    starts = nodes.where(F.col("place") == "chain").select("_lot", "_id", F.lit(NONE).cast("bigint").alias("_prev"), F.lit(0).cast("bigint").alias("_steps"))
    heads = nodes.where(F.col("place") != "chain").select("_id", F.lit(None).cast("bigint").alias("rank"), "place")
    long = stored(going.groupBy("_lot").agg(F.count("*").alias("_n")).where(F.col("_n") > TASK_LINKS).select("_lot"), "long-lists")
    if long.isEmpty():
        ranked = _ranked(going.unionByName(starts))
    else:
        short = going.unionByName(starts).join(F.broadcast(long), "_lot", "left_anti")
        ranked = _ranked(short).unionByName(_ranked_long(going.join(F.broadcast(long), "_lot", "left_semi"), starts.join(F.broadcast(long), "_lot", "left_semi")))
    return heads.unionByName(ranked)


def _ranked(links: DataFrame) -> DataFrame:
    """Rank links (``_lot, _id, _prev, _steps``) whose lots fit into a task; a start has no ``_prev``."""
    tasks = links.count() // DEALT_LINKS + 1
    found = links.repartition(tasks, "_lot").select("_id", "_prev", "_steps").mapInArrow(_rank_task(), "_id bigint, rank bigint, place string")
    return stored(found, "ranks")


def _rank_task() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that ranks all links of a task by pointer jumping; workers get it whole, without this module."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(map(len, parts)):
            return
        rows = pa.Table.from_batches(parts)
        ids, previous, steps = (rows[name].to_numpy() for name in rows.column_names)
        order = np.argsort(ids)
        ids, previous, steps = ids[order], previous[order], steps[order]
        far = np.minimum(np.searchsorted(ids, previous), len(ids) - 1)
        ends = ids[far] != previous
        start = previous == NONE
        far, steps = np.where(ends, np.arange(len(ids)), far), np.where(ends, 0, steps)
        # what has not come to an end after as many jumps as see all links goes round
        for _ in range(len(ids).bit_length()):
            if ends[far].all():
                break
            steps, far = steps + steps[far], far[far]
        kind = np.where(start[far], 0, np.where(ends[far], 1, 2))
        names = pa.array(["chain", "loose", "circle"])
        for i in range(0, len(ids), 100_000):
            some = slice(i, i + 100_000)
            rank = pa.array(steps[some], mask=kind[some] != 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), rank, names.take(pa.array(kind[some]))], ["_id", "rank", "place"])

    return ranked


def _ranked_long(going: DataFrame, starts: DataFrame) -> DataFrame:
    """Rank lists that are too long for a task: shorten them, rank the rest, and place what left behind what stayed."""
    number = lambda value, name: F.lit(value).cast("bigint").alias(name)
    own, behind = number(1, "_own"), [number(0, "_steps"), number(0, "_own")]
    live = _summed(
        going.select("_lot", "_id", "_prev", number(NONE, "_next"), "_steps", own)
        .unionByName(going.select("_lot", F.col("_prev").alias("_id"), number(0, "_prev"), (F.col("_id") - NONE).alias("_next"), *behind))
    )
    left: list[DataFrame] = []
    while live.groupBy("_lot").agg(F.count("*").alias("_n")).where(F.col("_n") > TASK_LINKS).limit(1).count():
        leaves = _leaves(len(left))
        circle = F.col("_prev") == F.col("_id")
        left.append(live.where(leaves | circle).select("_id", "_prev", "_steps"))
        leaving = live.where(leaves)
        # pointers are moved by differences: the sum of a link's own row and of what its neighbours send
        live = _summed(
            live.where(~leaves & ~circle).withColumn("_own", own)
            .unionByName(leaving.where(F.col("_next") != NONE).select("_lot", F.col("_next").alias("_id"), (F.col("_prev") - F.col("_id")).alias("_prev"), number(0, "_next"), "_steps", number(0, "_own")))
            .unionByName(leaving.select("_lot", F.col("_prev").alias("_id"), number(0, "_prev"), (F.col("_next") - F.col("_id")).alias("_next"), *behind))
        )
    ranked = _ranked(live.select("_lot", "_id", "_prev", "_steps").unionByName(starts))
    for gone in reversed(left):
        before = ranked.select(F.col("_id").alias("_prev"), F.col("rank").alias("_rank"), F.col("place").alias("_place"))
        place = F.when(F.col("_prev") == F.col("_id"), "circle").otherwise(F.coalesce("_place", F.lit("loose")))
        again = gone.join(before, "_prev", "left").select("_id", (F.col("_rank") + F.col("_steps")).alias("rank"), place.alias("place"))
        ranked = ranked.unionByName(stored(again, "ranks"))
    return ranked


def _leaves(round_: int) -> Column:
    """Whether a link leaves in a round: its hash is below those of both neighbours, so of two neighbours one stays."""
    of = lambda name: F.xxhash64(F.col(name), F.lit(round_))
    return (of("_id") < of("_prev")) & ((F.col("_next") == NONE) | (of("_id") < of("_next")))


def _summed(rows: DataFrame) -> DataFrame:
    """Sums of the rows of each link; what was sent to a link that is not there any more, or a head, is dropped."""
    sums = rows.groupBy("_lot", "_id").agg(*[F.sum(c).alias(c) for c in ("_prev", "_next", "_steps", "_own")])
    return stored(sums.where(F.col("_own") == 1).drop("_own"), "shortened")


def numbered_pages(pages: DataFrame) -> DataFrame:
    """Opened pages (``listing_id, after_token, raw``) with ``page_no`` from their tokens (NULL outside the chain) and ``place``; equal pages count once."""
    known = pages.where(F.col("listing_id").isNotNull())
    once = known.withColumns({"after_token": F.coalesce("after_token", F.lit("")), "page_no": F.lit(None).cast("bigint")}).dropDuplicates(["listing_id", "after_token", "raw"])
    opened = stored(fleet.open_pages(once).drop("page_no").withColumn("_id", F.monotonically_increasing_id()), "opened-pages")
    links = opened.groupBy(F.col("listing_id").alias("_key"), F.col("after_token").alias("_own"), F.col("next_token").alias("_following")).agg(F.min("_id").alias("_id"), F.count("*").alias("_pages"))
    nodes = stored(_nodes(links), "nodes")
    ranked = _placed(nodes)
    several = nodes.where("_several").select(F.col("_key").alias("listing_id"), F.col("_token").alias("after_token"), F.col("_id").alias("_node"))
    if not several.isEmpty():
        # pages with equal tokens but other records are different pages
        body = F.xxhash64(F.to_json("records"), "error")
        shared = stored(opened.join(several, ["listing_id", "after_token"]).select("_id", "_node", "next_token", body.alias("_body")), "shared-tokens")
        doubled = shared.select("_node", "next_token", "_body").distinct().groupBy("_node").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
        of_node = ranked.withColumnRenamed("_id", "_node").join(doubled, "_node", "left")
        of_node = of_node.select("_node", F.when(F.col("_n").isNull(), F.col("rank")).alias("rank"), F.when(F.col("_n") > 1, "fork").otherwise(F.col("place")).alias("place"))
        ranked = ranked.join(several.select(F.col("_node").alias("_id")), "_id", "left_anti").unionByName(shared.select("_id", "_node").join(of_node, "_node").drop("_node"))
    numbered = opened.join(ranked.withColumnRenamed("rank", "page_no"), "_id")
    return numbered.select("listing_id", "after_token", "next_token", "records", "error", "page_no", "place")


def token_chain(numbered: DataFrame) -> DataFrame:
    """One verdict per listing: pages, those in the chain, and the first error."""
    chained = F.col("place") == "chain"
    wrong = F.when(F.col("error") != "", F.struct(~chained, F.coalesce("page_no", F.lit(0)), "error"))
    verdict = numbered.groupBy("listing_id").agg(
        F.count("*").alias("pages"),
        F.count_if(chained).alias("chained"),
        F.min_by("error", wrong).alias("_first_error"),
        F.max(F.col("place").isin("repeated", "circle")).alias("_repeated"),
        F.count_if(chained & F.col("next_token").isNull()).alias("_ends"),
    )
    reason = (
        F.when(F.col("_first_error").isNotNull(), F.col("_first_error"))
        .when(F.col("_repeated"), "invalid page token")
        .when((F.col("chained") < F.col("pages")) | (F.col("_ends") != 1), "broken page chain")
        .otherwise("")
    )
    return verdict.select("listing_id", "pages", "chained", reason.alias("error"), (reason == "").alias("ok"))


def token_records(numbered: DataFrame) -> DataFrame:
    """Records of all pages of the listings whose chain holds."""
    sound = token_chain(numbered).where("ok").select("listing_id")
    return numbered.join(sound, "listing_id", "left_semi").select("listing_id", "page_no", F.posexplode("records").alias("pos", "record"))
