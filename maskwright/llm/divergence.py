"""How far the parts of a labelled set differ in their words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import cut_lineage
from .stable_bpe import as_text, slices

SLICE_BYTES = 4_000_000
HELD_ROWS = 1_500_000
BLOCK_TERMS = 2_048
SPLIT_BLOCK = 64
ONE = 1_000_000_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms in order, and the text each one is from.

    A term is a longest run of ASCII letters and characters beyond ASCII, A-Z as a-z.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    low, n = int(ends[0]), int(ends[-1] - ends[0])
    if not n:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[low:low + n]
    ends -= low
    inside = _LETTER[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts_text = ends[:-1][ends[:-1] < n]
    begins[starts_text] = inside[starts_text]
    start = np.flatnonzero(begins)
    letters = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(letters[start], letters[-1]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(start), [
        None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    return terms, np.searchsorted(ends, start, "right") - 1


def _counted(cases: DataFrame) -> DataFrame:
    """``(task, split, term, n, texts)``: occurrences and texts with the term, summed up within tasks."""
    def merged(tables: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(tables, promote_options="default").combine_chunks()
        whole = whole.group_by(["task", "split", "term"]).aggregate([("n", "sum"), ("texts", "sum")])
        return whole.rename_columns({"n_sum": "n", "texts_sum": "texts"})

    def of(tasks: pa.Array, splits: pa.Array, texts: pa.Array) -> pa.Table:
        pairs = pa.StructArray.from_arrays([tasks, splits], ["task", "split"])
        seen: dict[tuple, int] = {}
        group = np.array([seen.setdefault((p["task"], p["split"]), len(seen)) for p in pairs.to_pylist()], np.int64)
        names = list(seen)
        terms, text = terms_of(texts)
        coded = terms.dictionary_encode()
        width = max(len(coded.dictionary), 1)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        per_text, n = np.unique(text * width + code, return_counts=True)
        cell = group[per_text // width] * width + per_text % width
        cells, place = np.unique(cell, return_inverse=True)
        owner = cells // width
        return pa.table({
            "task": pa.array([names[g][0] for g in owner], pa.string()),
            "split": pa.array([names[g][1] for g in owner], pa.string()),
            "term": coded.dictionary.take(pa.array(cells % width)),
            "n": np.bincount(place, weights=n, minlength=len(cells)).astype(np.int64),
            "texts": np.bincount(place, minlength=len(cells)).astype(np.int64)})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row, part in slices(as_text(batch.column(2)), SLICE_BYTES):
                held.append(of(batch.column(0).slice(row, len(part)), batch.column(1).slice(row, len(part)), part))
                size += held[-1].num_rows
                if size >= HELD_ROWS:
                    held = [merged(held)]
                    size = held[0].num_rows
                    if size >= HELD_ROWS // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from merged(held).to_batches()

    return cases.mapInArrow(run, "task string, split string, term string, n long, texts long")


def share(count: np.ndarray, total: np.ndarray, n_terms: int) -> np.ndarray:
    """``1 + floor(10**9 * (count + 2) / (total + 2 * n_terms))`` without rounding."""
    whole = total + 2 * n_terms
    rest, out = count + 2, np.zeros(np.broadcast(count, total).shape, np.int64)
    if int(np.max(whole, initial=0)) > 9 * 10**15:
        raise ValueError("more terms than 64-bit numbers can divide exactly")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def _share(count: Column, total: Column, n_terms: Column) -> Column:
    """The same as a column."""
    exact = "decimal(38,0)"
    return F.call_function("div", (F.lit(ONE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + 2)).cast(exact),
                           (total + 2 * n_terms).cast(exact)) + 1


class Trees:
    """Segment trees over the terms of a block, one per split, with equal subtrees shared.

    A leaf is a count; a node is a pair of nodes of the level below.  Nodes are hash-consed:
    whoever has the same counts over an aligned range of terms has the same node.
    ``left[k]`` and ``right[k]`` give the children of the nodes of level ``k + 1``.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(int(counts.shape[1]) - 1, 0).bit_length()
        full = np.zeros((len(counts), width), np.int64)
        full[:, :counts.shape[1]] = counts
        # Places beyond the last term are a leaf of their own, which costs nothing.
        full[:, counts.shape[1]:] = -1
        self.counts, nodes = np.unique(full, return_inverse=True)
        nodes = nodes.reshape(full.shape)
        self.left, self.right = [], []
        while nodes.shape[1] > 1:
            size = int(nodes.max()) + 1
            pairs, nodes = np.unique(nodes[:, 0::2] * size + nodes[:, 1::2], return_inverse=True)
            nodes = nodes.reshape(len(counts), -1)
            self.left.append(pairs // size)
            self.right.append(pairs % size)
        self.roots = nodes[:, 0]

    def prices(self, one: np.ndarray, two: np.ndarray, totals: np.ndarray, n_terms: int) -> np.ndarray:
        """The sum of ``floor((p - q)**2 / (p + q))`` for every pair of splits.

        Both trees are walked down together, for all pairs at once.  Node pairs
        that a pair of splits meets in several places are kept once, with their number,
        so each is priced once.
        """
        pair, a, b = np.arange(len(one)), self.roots[one], self.roots[two]
        times = np.ones(len(one), np.int64)
        for left, right in zip(reversed(self.left), reversed(self.right)):
            pair, times = np.concatenate([pair, pair]), np.concatenate([times, times])
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            width = int(max(a.max(), b.max())) + 1
            seen, place = np.unique((pair * width + a) * width + b, return_inverse=True)
            summed = np.zeros(len(seen), np.int64)
            np.add.at(summed, place, times)
            times, b, a, pair = summed, seen % width, seen // width % width, seen // width // width
        real = self.counts[a] >= 0
        pair, a, b, times = pair[real], a[real], b[real], times[real]
        p = share(self.counts[a], totals[one][pair], n_terms)
        q = share(self.counts[b], totals[two][pair], n_terms)
        out = np.zeros(len(one), np.int64)
        np.add.at(out, pair, (p - q) * (p - q) // (p + q) * times)
        return out


def _priced(rows: DataFrame) -> DataFrame:
    """``(task, one, two, value)`` of each block, for pairs of split numbers ``one < two``."""
    def run(table: pa.Table) -> pa.Table:
        row = table.slice(0, 1).to_pylist()[0]
        splits = table["number"].to_numpy().astype(np.int64)
        order = np.argsort(splits)
        splits = splits[order]
        counts = np.zeros((len(splits), row["n_places"]), np.int64)
        of = np.empty(len(splits), np.int64)
        of[order] = np.arange(len(splits))
        cells = table["cells"].combine_chunks()
        flat = cells.flatten()
        owner = np.repeat(of, cells.value_lengths().fill_null(0).to_numpy())
        counts[owner, flat.field("place").to_numpy(zero_copy_only=False)] = flat.field("n").to_numpy(
            zero_copy_only=False)
        i, j = np.triu_indices(len(splits), 1)
        low, high = splits[i] // SPLIT_BLOCK, splits[j] // SPLIT_BLOCK
        # Pairs within one block of splits are priced where it meets itself only.
        mine = (low == row["low"]) & (high == row["high"])
        i, j = i[mine], j[mine]
        if not len(i):
            return out.empty_table()
        totals = table["total"].to_numpy().astype(np.int64)[order]
        value = Trees(counts).prices(i, j, totals, row["n_terms"])
        return pa.table({"task": pa.array([row["task"]] * len(i), pa.string()), "one": splits[i],
                         "two": splits[j], "value": value})

    out = pa.schema([("task", pa.string()), ("one", pa.int64()), ("two", pa.int64()), ("value", pa.int64())])
    return rows.groupBy("task", "block", "low", "high").applyInArrow(
        run, "task string, one long, two long, value long")


def split_divergence(cases: DataFrame, least: int = 10, top: int = 10, task: str = "task",
                     split: str = "split", text: str = "text") -> DataFrame:
    """How the splits of a labelled set differ in their words, within each task.

    ``cases`` are labelled cases ``(task, split, text)``: a strategy chosen on one
    split tells little about another that is worded differently.  Terms are runs of
    letters and characters beyond ASCII, A-Z as a-z.  A task keeps the ``V`` terms that
    at least ``least`` of its cases hold.  In a split with ``N`` occurrences of
    kept terms a term with ``count`` of them has the share ``p = 1 + floor(10**9 *
    (count + 2) / (N + 2 V))``; two shares are ``floor((p - q)**2 / (p + q))`` apart.

    Returns ``task, split, part, item, value, rank`` for every split that occurs.  Part
    ``pair``: ``item`` is each other split of the task, ``value`` the sum over all kept
    terms.  Part ``term``: ``item`` is a kept term that the split holds, with a larger
    share than in the whole task, ``value`` how far they are apart; the ``top`` first
    only.  ``rank`` counts from 1 by falling value, then by item.  A null
    task, split or text is ''.  Repeated cases count each; other columns are ignored; an
    empty table gives no rows.  All arithmetic is exact in 64 bits.

    Kept terms are dealt to blocks of about ``BLOCK_TERMS`` by hash and numbered within them by
    frequency, rare ones first; a task prices the trees of one block of terms and
    at most two blocks of ``SPLIT_BLOCK`` splits (see :class:`Trees`).
    """
    cases = cases.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                           for c, name in ((task, "task"), (split, "split"), (text, "text"))])
    groups = cut_lineage(cases.groupBy("task", "split").agg(F.count(F.lit(1)).alias("n_cases")), "splits")
    raw = cut_lineage(_counted(cases), "split-terms")
    kept = raw.groupBy("task", "term").agg(F.sum("n").alias("all_n"), F.sum("texts").alias("texts"))
    kept = cut_lineage(kept.where(F.col("texts") >= least).select("task", "term", "all_n"), "kept-terms")
    tasks = cut_lineage(kept.groupBy("task").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("all_n").alias("all_total")), "kept-tasks")
    counts = cut_lineage(raw.join(kept, ["task", "term"]).groupBy("task", "split", "term", "all_n").agg(
        F.sum("n").alias("n")), "kept-counts")
    totals = counts.groupBy("task", "split").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["task", "split"], "left").join(tasks, "task", "left").select(
        "task", "split", F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("all_total", F.lit(0)).alias("all_total"))
    by_name = Window.partitionBy("task").orderBy("split")
    groups = cut_lineage(groups.withColumn("number", F.row_number().over(by_name).cast("long") - 1), "split-totals")

    # Terms that stand out in a split.
    p = _share(F.col("n"), F.col("total"), F.col("n_terms"))
    q = _share(F.col("all_n"), F.col("all_total"), F.col("n_terms"))
    shares = counts.join(groups, ["task", "split"]).withColumn("p", p).withColumn("q", q).where("p > q")
    apart = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    shares = shares.select("task", "split", F.lit("term").alias("part"), F.col("term").alias("item"),
                           apart.alias("value"))
    by_value = Window.partitionBy("task", "split", "part").orderBy(F.desc("value"), "item")
    shares = shares.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # Splits against each other, block by block.
    n_blocks = F.ceil(F.col("n_terms") / BLOCK_TERMS)
    numbered = kept.join(tasks, "task").withColumn("block", F.pmod(F.xxhash64("term"), n_blocks))
    in_block = Window.partitionBy("task", "block")
    numbered = cut_lineage(numbered.select(
        "task", "term", "block", F.count(F.lit(1)).over(in_block).cast("int").alias("n_places"),
        (F.row_number().over(in_block.orderBy("all_n", "term")) - 1).alias("place")), "term-places")
    cells = counts.join(numbered, ["task", "term"]).groupBy("task", "block", "split").agg(
        F.collect_list(F.struct("place", "n")).alias("cells"))
    blocks = numbered.select("task", "block", "n_places").distinct()
    rows = blocks.join(groups, "task").join(cells, ["task", "block", "split"], "left")
    own = F.floor(F.col("number") / SPLIT_BLOCK)
    last = tasks.select("task").join(groups.groupBy("task").agg(
        F.floor(F.max("number") / SPLIT_BLOCK).alias("last")), "task")
    rows = rows.join(last, "task").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    rows = rows.select("task", "block", "n_places", "n_terms", "number", "total", "cells",
                       F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    priced = cut_lineage(_priced(rows).groupBy("task", "one", "two").agg(F.sum("value").alias("value")), "split-prices")
    both = priced.union(priced.select("task", "two", "one", "value"))
    # Every two splits of a task are part of the result.
    a = groups.select("task", "split", F.col("number").alias("one"))
    b = groups.select("task", F.col("split").alias("item"), F.col("number").alias("two"))
    pairs = a.join(b, "task").where("one <> two").join(both, ["task", "one", "two"], "left").select(
        "task", "split", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(shares).select(
        F.col("task").alias(task), F.col("split").alias(split), "part", "item", "value", "rank")
