"""Packing of texts into token sequences of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..storage import cut_lineage, sql_conf
from .stable_bpe import ROWS_PER_BATCH, as_text, shared_encoder, slices

CAPACITY = 4096
OPEN_BINS = 1024
ROWS_PER_TASK = 100_000


class BestFit:
    """Bounded-space online best fit.

    At most ``open_bins`` bins are open.  A bitset has bit ``f`` set while some
    open bin has ``f`` free places, so the best fit for ``n`` is the lowest set
    bit from ``n`` on.  When a bin more is needed, the fullest one closes.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.free: dict[int, list[int]] = {}
        self.bits, self.count, self.made = 0, 0, 0

    def _take(self, free: int) -> int:
        stack = self.free[free]
        bin_ = stack.pop()
        if not stack:
            del self.free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_

    def put(self, size: int) -> tuple[int, int]:
        """Bin and offset for an item of ``size``."""
        if not 0 < size <= self.capacity:
            raise ValueError(f"an item of {size} does not fit {self.capacity}")
        fit = self.bits >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free, self.made = self.made, self.capacity, self.made + 1
        left = free - size
        if left:
            self.free.setdefault(left, []).append(bin_)
            self.bits |= 1 << left
            self.count += 1
        return bin_, self.capacity - free


def token_pieces(scrubs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY,
                 key: str = "doc_id", text: str = "scrubbed") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every text and its end id."""
    kind = scrubs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        encoder = shared_encoder(tokenizer)
        for batch in batches:
            column, keys = as_text(batch.column(1)), batch.column(0)
            for row, part in slices(column):
                ids, firsts = encoder.encode(part)
                n = len(part)
                out = np.full(len(ids) + n, end_id, "<i4")
                own = np.repeat(np.arange(n), np.diff(firsts))
                out[np.arange(len(ids)) + own] = ids
                firsts = firsts + np.arange(n + 1)
                owner, piece, start, length, crc = [], [], [], [], []
                raw = memoryview(out).cast("B")
                for i in range(n):
                    low, high = int(firsts[i]), int(firsts[i + 1])
                    for k, at in enumerate(range(low, high, capacity)):
                        stop = min(at + capacity, high)
                        owner.append(row + i)
                        piece.append(k)
                        start.append(at - low)
                        length.append(stop - at)
                        crc.append(zlib.crc32(raw[4 * at:4 * stop]))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64())],
                    names=[key, "piece", "start", "length", "ids_crc32"])

    return scrubs.select(key, text).mapInArrow(run, schema)


def _placed(items: DataFrame, order: list[str], size: str, rows: int, count: int,
            capacity: int, open_bins: int, label: str) -> DataFrame:
    """Items with ``bin`` and ``offset``: every task packs its part in a fixed
    pseudo-random order, so that a task that runs again gives the same bins."""
    parts = max(1, -(-count // rows))
    items = (items.withColumn("_turn", F.xxhash64(*order))
             .repartition(parts, "_turn").withColumn("_part", F.spark_partition_id())
             .sortWithinPartitions("_turn", *order))
    schema = items.drop("_turn", "_part").schema.add("bin", "long").add("offset", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit = BestFit(capacity, open_bins)
        for batch in batches:
            got = [fit.put(int(n)) for n in batch[size]]
            base = batch["_part"].to_numpy(np.int64) << 33
            batch = batch.drop(columns=["_turn", "_part"])
            batch["bin"] = base + np.array([b for b, _ in got], np.int64)
            batch["offset"] = np.array([o for _, o in got], np.int64)
            yield batch

    return cut_lineage(items.mapInPandas(run, schema), label)


def pack_scrubbed(scrubs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY,
                  open_bins: int = OPEN_BINS, rows_per_task: int = ROWS_PER_TASK,
                  key: str = "doc_id", text: str = "scrubbed") -> DataFrame:
    """Scrubbed texts as token sequences of at most ``capacity`` ids.

    ``scrubs`` are scrub results, ``(doc_id, scrubbed)``.  A text is its token ids
    followed by ``end_id``; only longer ones are cut, into pieces of ``capacity``
    with a shorter last one.  Every task packs about ``rows_per_task`` pieces by
    :class:`BestFit`; the sequences it leaves unfilled are packed once more, as
    items, with those of other tasks.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  A null text is empty (the end id alone).  Repeated rows are packed
    each on its own; null keys stay; other columns are ignored; an empty table
    gives no rows.  Only these few numbers per piece are shuffled, never ids.
    """
    with sql_conf(scrubs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH)):
        pieces = cut_lineage(token_pieces(scrubs, tokenizer, end_id, capacity, key, text), "pieces")
    order = [key, "piece", "start", "length", "ids_crc32"]
    placed = _placed(pieces, order, "length", rows_per_task, pieces.count(), capacity,
                     open_bins, "placed")
    unfilled = (placed.groupBy(F.col("bin").alias("old")).agg(F.sum("length").alias("used"))
                .where(F.col("used") < capacity))
    unfilled = cut_lineage(unfilled, "unfilled")
    again = _placed(unfilled, ["old", "used"], "used", rows_per_task, unfilled.count(),
                    capacity, open_bins, "refilled")
    moved = again.select(F.col("old").alias("bin"), (-1 - F.col("bin")).alias("new"),
                         F.col("offset").alias("base"))
    return placed.join(moved, "bin", "left").select(
        *order, F.coalesce("new", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
