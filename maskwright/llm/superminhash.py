"""Groups of near copies by SuperMinHash signatures, bands and union-find.

1. Equal sets of word shingles are one *class*.  Classes are numbered in the order of
   their least key.
2. A class's signature has, for each of ``BANDS * ROWS`` places, the least rank that
   one of its shingles has there.  A shingle's ranks are correlated: its own random
   permutation deals one rank of every level 0, 1, 2 ... to the places, so all
   places are served evenly.  Once every place holds a rank of a level passed, no later
   rank can be less and the rest of the permutations is left out.
3. Classes with an equal band are candidates.  Two sets with a similarity of 0.85
   have no equal band with a chance of about 4e-6.
4. A class is first compared with the least class of one bucket, that of most of its
   bands.  Links, confirmed on whole sets, are joined by union-find.  Then classes of one bucket that
   are not yet in one group are compared with each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..storage import cut_lineage
from .components import components
from .jaccard import BITS, _bits_allow, _confirmed, _named_texts, _parity, _sets
from .word_hash import WordHasher, mix

BANDS, ROWS = 32, 7
PART_ELEMENTS = 100_000

_LEVEL = 0xD6E8FEB86659FD93


def signatures(elements: np.ndarray, first: np.ndarray, places: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures of sets of hashes; set ``i`` is ``first[i]:first[i + 1]``.

    A rank is ``level * 2**32`` plus a random number below ``2**32``; an empty set
    has the largest number in all places.
    """
    out = np.full((len(first) - 1, places), np.iinfo(np.uint64).max)
    flat = out.reshape(-1)
    left = np.arange(len(elements))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = None
    for level in range(places):
        if not len(left):
            break
        drawn = mix(elements[left] + np.uint64(_LEVEL * (level + 1) % 2**64))
        place = level + ((drawn >> np.uint64(32)) % np.uint64(places - level)).astype(np.int64)
        if order is None:
            where = place
        else:
            rows = np.arange(len(left))
            where = order[rows, place].astype(np.int64)
            order[rows, place] = order[:, level]
        rank = (drawn & np.uint64(0xFFFFFFFF)) | np.uint64(level << 32)
        np.minimum.at(flat, owner * places + where, rank)
        sets = np.unique(owner)
        going = np.zeros(len(out), bool)
        going[sets] = out[sets].max(axis=1) >= np.uint64((level + 1) << 32)
        stay = going[owner]
        left, owner = left[stay], owner[stay]
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(left), 1))
            order[np.arange(len(left)), place[stay]] = 0
        else:
            order = order[stay]
    return out


def band_keys(ranks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for every band of every signature; bands never share a key but by chance."""
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(ranks), bands))
    grid = ranks.reshape(len(ranks), bands, rows)
    for row in range(rows):
        key = mix(key + grid[:, :, row]) * np.uint64(0x9E3779B97F4A7C15)
    return key


def _described(texts: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    kind = texts.schema["key"].dataType.simpleString()
    schema = f"key {kind}, h1 long, h2 long, n long, print binary, bands array<long>, bits array<long>"

    def parts(sets):
        """Runs of sets with about ``PART_ELEMENTS`` shingles."""
        held, n = [], 0
        for row, found in sets:
            held.append((row, found))
            n += len(found)
            if n >= PART_ELEMENTS:
                yield held
                held, n = [], 0
        if held:
            yield held

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for held in parts(_sets(batch.column(3), hasher, size)):
                sets = [found for _, found in held]
                n = np.array([len(s) for s in sets])
                # A set that can only match its equal needs no bands.
                large = 100 * n >= percent * (n + 1)
                some = [s for s, one in zip(sets, large) if one]
                first = np.concatenate([[0], np.cumsum(n[large])])
                ranks = signatures(np.concatenate(some) if some else np.zeros(0, np.uint64), first, bands * rows)
                keys = band_keys(ranks, bands, rows).reshape(-1).view(np.int64)
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                whole = batch.slice(held[0][0], len(held))
                yield pa.RecordBatch.from_arrays(
                    [*whole.columns[:3], pa.array(n, pa.int64()), pa.array(prints, pa.binary()),
                     pa.ListArray.from_arrays(
                         pa.array(np.concatenate([[0], np.cumsum(large * bands)]), pa.int32()), pa.array(keys)),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(len(sets) + 1) * (BITS // 64), pa.int32()),
                         pa.array(np.concatenate([_parity(s) for s in sets])))],
                    names=["key", "h1", "h2", "n", "print", "bands", "bits"])

    return texts.mapInArrow(run, schema)


def _joined(links: DataFrame) -> DataFrame:
    """Links with those left out that a union-find over each task's links makes needless."""
    def run(batches):
        above: dict[int, int] = {}

        def root(x):
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
        flat = [(x, root(x)) for x in list(above)]
        flat = [(x, r) for x, r in flat if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in flat], pa.int64()),
                                          pa.array([r for _, r in flat], pa.int64())], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def group_near_copies(texts: DataFrame, size: int = 5, percent: int = 85, key: str = "doc_id",
                      text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near copies among texts, and the one of each group to scrub.

    ``texts`` are texts to scrub, or scrubbed ones, ``(doc_id, text)``; a finder need
    only read the kept text of a group.  A text's set is its distinct runs of ``size``
    words, A-Z as a-z; the whole sequence if it has fewer; empty without words.
    Texts link when ``100 * |intersection| >= percent * |union|``; an empty set links
    with nothing.  Every link returned is confirmed on whole sets; equal sets
    always link, and other links are found with the chance that the bands give
    (see the module).

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``component_id``, the
    least id that links reach, its own included, and ``kept``, whether the two are
    equal.  A null text is empty.  Repeated rows are copies and are all kept if
    their id is the least; a null id is larger than any other and equal to
    itself.  Other columns are ignored; an empty table gives no rows.
    """
    texts = _named_texts(texts, key, text)
    docs = cut_lineage(_described(texts, size, percent, bands, rows), "copy-signatures")
    one = docs.where("n > 0").groupBy("print").agg(
        F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "h1", "h2")).alias("of"),
        F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    one = one.select("print", "n", "bands", "bits", "of.*").orderBy(F.asc_nulls_last("key"), "print")
    classes = cut_lineage(one.withColumn("class", F.monotonically_increasing_id()), "copy-classes")

    index = classes.select("class", F.explode("bands").alias("bucket"))
    buckets = index.groupBy("bucket").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("size"))
    live = cut_lineage(index.join(buckets.where("size > 1"), "bucket"), "copy-buckets")
    votes = live.where("class <> hub").groupBy("class", "hub").agg(F.count(F.lit(1)).alias("votes"))
    first = cut_lineage(votes.groupBy(F.col("class").alias("a")).agg(
        F.max(F.struct("votes", (-F.col("hub")).alias("hub"))).alias("of")).select(
        "a", (-F.col("of.hub")).alias("b")), "copy-hubs")
    links = _confirmed(first, classes, texts, size, percent)
    found = cut_lineage(components(_joined(links)), "copy-groups")

    # Buckets that still hold several groups.  The largest one is not compared with itself.
    placed = live.select("class", "bucket").join(found.withColumnRenamed("vertex", "class"), "class", "left")
    placed = placed.withColumn("component", F.coalesce("component", "class"))
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n_classes"))
    top = (sizes.groupBy("bucket")
           .agg(F.max(F.struct("n_classes", "component")).alias("top"), F.count(F.lit(1)).alias("n_groups"))
           .where("n_groups > 1").select("bucket", F.col("top.component").alias("top")))
    open_ = cut_lineage(placed.join(top, "bucket").join(classes.select("class", "n", "bits"), "class"), "copy-open")
    a, b = open_.where("component <> top").alias("a"), open_.alias("b")
    pairs = a.join(b, F.expr(
        "a.bucket = b.bucket and a.component <> b.component and (b.component = b.top or a.class < b.class)"
        f" and 100 * least(a.n, b.n) >= {int(percent)} * greatest(a.n, b.n)")
        & _bits_allow("a.n", "a.bits", "b.n", "b.bits", percent))
    pairs = pairs.select(F.greatest("a.class", "b.class").alias("a"), F.least("a.class", "b.class").alias("b"))
    pairs = pairs.distinct().join(first, ["a", "b"], "left_anti")
    links = links.union(_confirmed(pairs, classes, texts, size, percent))
    found = cut_lineage(components(_joined(links)), "copy-groups")

    # A group is named by its first class, which has the least key.
    named = classes.select("class", "print").join(found.withColumnRenamed("vertex", "class"), "class", "left")
    named = cut_lineage(named.select("print", F.coalesce("component", "class").alias("component")), "copy-names")
    named = named.join(classes.select(F.col("class").alias("component"), F.col("key").alias("least")), "component")
    out = docs.select("key", "n", "print").join(
        cut_lineage(named.select("print", "least"), "copy-least"), "print", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("key").eqNullSafe(component).alias("kept"))
