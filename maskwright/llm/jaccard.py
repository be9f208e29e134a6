"""Links between near copies: a grouped prefix join on word shingles.

The plan, for sets of shingle hashes and the rule
``100 * |a ∩ b| >= percent * |a ∪ b|``:

1. Equal sets are one *class*.  Shingles have one global order, rare ones first;
   two linked classes share a shingle among the first ``n - ceil(t n) + 1``.
   Which shingles are frequent is found over all documents, with a bounded list:
   at most ``1 / SHARE`` shingles can hold more than ``SHARE`` of all entries.
2. Prefix shingles of a single class are dropped; they join nothing.  Classes of
   one size and with the same remaining prefix, places included, are one *group*; its
   least class stands for it in the join.
3. Members are compared with the class that stands for their group, and that
   class with one group of each of its shingles: that with the fewest shingles of its
   own, the middle of a family.  What links is joined into components.
4. Then all groups are paired by shared shingles, a group with itself, too, if its
   members are in several components; pairs are filtered by size, places and parity
   bits and number of shared prefix shingles, expanded to members of different components and verified on whole
   sets.  Groups of the most frequent component of a shingle are not paired with each
   other, so a large family costs no square.

Parity bits tell for each of BITS buckets whether a set has an odd number of
shingles in it.  Each shingle that only one of two sets has changes one bit, so
sets whose bits differ in more places than they may differ in shingles do not link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import cut_lineage, own_cuts, sql_conf
from .components import components
from .line_dedup import _bits, _maybe
from .stable_bpe import as_text, slices
from .word_hash import SLICE_BYTES, WordHasher, shingles

SHARE = 1 / 131_072
LOCAL_SHINGLES = 4_000_000
LOCAL_LEAST = 4
PAIRS_PER_BATCH = 1_000
BITS = 512


def _sets(batch_column: pa.Array, hasher: WordHasher, size: int):
    """``(row, set)`` of every text of a column."""
    for row, part in slices(as_text(batch_column), SLICE_BYTES):
        words, first = hasher(part)
        for i in range(len(part)):
            yield row + i, shingles(words[first[i]:first[i + 1]], size)


def _frequent(texts: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles over all texts, by hash, and their rank by frequency.

    A task reports what makes up more than ``SHARE`` of its entries; by the
    pigeonhole principle nothing frequent overall goes unreported.
    """
    def run(batches):
        hasher, held, n = WordHasher(), [], 0

        def report():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > max(LOCAL_LEAST - 1, int(SHARE * n))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(values[often].view(np.int64), 0)),
                 pa.array(np.append(counts[often], 0)),
                 pa.array(np.append(np.zeros(int(often.sum()), np.int64), n))],
                names=["shingle", "n", "entries"])

        for batch in batches:
            for _, found in _sets(batch.column(0), hasher, size):
                held.append(found)
                n += len(found)
                if n >= LOCAL_SHINGLES:
                    yield report()
                    held, n = [], 0
        if n:
            yield report()

    seen = cut_lineage(texts.select(text).mapInArrow(run, "shingle long, n long, entries long"), "frequent")
    entries = seen.agg(F.sum("entries")).first()[0] or 0
    rows = (seen.groupBy("shingle").agg(F.sum("n").alias("n"))
            .where(F.col("n") > int(SHARE * entries)).collect())
    hashes = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    rank = np.empty(len(rows), np.int64)
    rank[np.lexsort((hashes, [r[1] for r in rows]))] = np.arange(len(rows))
    order = np.argsort(hashes)
    return hashes[order], rank[order]


def _in_order(found: np.ndarray, hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Shingles as 64-bit keys whose order is the global one: rare ones by hash,
    below zero, then frequent ones by rank."""
    keys = (found >> np.uint64(1)).view(np.int64) + np.iinfo(np.int64).min
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        keys = np.where(hashes[at] == found, rank[at], keys)
    return np.sort(keys)


def _prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _parity(found: np.ndarray) -> np.ndarray:
    """Parity bits of a set, as 64-bit words."""
    odd = np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _bits_allow(n_a: str, bits_a: str, n_b: str, bits_b: str, percent: int) -> Column:
    """Whether two sets differ in no more bits than linked ones may; true without bits."""
    apart = F.lit(0)
    for i in range(BITS // 64):
        apart = apart + F.bit_count(F.get(bits_a, F.lit(i)).bitwiseXOR(F.get(bits_b, F.lit(i))))
    most = F.col(n_a) + F.col(n_b) - 2 * _need(F.col(n_a), F.col(n_b), percent)
    return F.coalesce(apart <= most, F.lit(True))


def _named_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, h1, h2, text``; the two hashes name a row by its id and text."""
    return texts.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("h1"),
                        F.xxhash64(F.lit(1), F.col(key), F.col(text)).alias("h2"), F.col(text).alias("text"))


def _prefixes(texts: DataFrame, size: int, percent: int, frequent) -> DataFrame:
    kind = texts.schema["key"].dataType.simpleString()
    schema = f"key {kind}, h1 long, h2 long, n long, print binary, prefix array<long>, bits array<long>"

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            n, prints, ends, prefix, bits = [], [], [0], [], []
            for _, found in _sets(batch.column(3), hasher, size):
                n.append(len(found))
                prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys = _in_order(found, *frequent)[:_prefix_length(len(found), percent) if len(found) else 0]
                prefix.append(keys)
                ends.append(ends[-1] + len(keys))
                bits.append(_parity(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(prints, pa.binary()),
                 pa.ListArray.from_arrays(
                     pa.array(ends, pa.int32()),
                     pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))),
                 pa.ListArray.from_arrays(
                     pa.array(np.arange(len(bits) + 1) * (BITS // 64), pa.int32()),
                     pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))],
                names=["key", "h1", "h2", "n", "print", "prefix", "bits"])

    return texts.mapInArrow(run, schema)


def _need(n_a: Column, n_b: Column, percent: int) -> Column:
    """The least intersection of two linked sets."""
    return F.ceil(percent * (n_a + n_b) / (100 + percent))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes close enough, and enough shingles left to share before and after a shared one.

    What precedes a shared shingle in one set can only be shared with what precedes it
    in the other; so with what follows it.
    """
    n_a, n_b, i, j = (F.col(f"{side}.{c}") for c in ("n", "pos") for side in (a, b))
    close = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return close & (F.least(i, j) + F.least(n_a - i, n_b - j) >= _need(n_a, n_b, percent))


def _enough(n_a: Column, n_b: Column, shared: Column, percent: int) -> Column:
    """Enough shared prefix shingles: of the set whose prefix ends first in the global
    order, what is not shared within the prefixes can only be shared beyond its own."""
    rest = F.greatest(n_a - _prefix_length_col(n_a, percent), n_b - _prefix_length_col(n_b, percent))
    return shared + rest >= _need(n_a, n_b, percent)


def _prefix_length_col(n: Column, percent: int) -> Column:
    return n - F.ceil(percent * n / 100) + 1


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of classes ``(a, b)`` that link, by their whole sets.

    Only texts that may stand for a class of a pair are shuffled; each is cut into
    shingles where it meets its partner.
    """
    bits = classes.select("class", "n", "bits")
    pairs = (pairs.join(bits.toDF("a", "n_a", "bits_a"), "a").join(bits.toDF("b", "n_b", "bits_b"), "b")
             .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
                    & _bits_allow("n_a", "bits_a", "n_b", "bits_b", percent)).select("a", "b"))
    pairs = cut_lineage(pairs, "copy-pairs")
    ids = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = cut_lineage(ids.join(classes.select("class", "h1", "h2"), "class"), "copy-wanted")
    maybe = _maybe("h1", cut_lineage(_bits(wanted, "h1"), "copy-filter").scalar())
    found = cut_lineage(texts.where(maybe).join(wanted, ["h1", "h2"]).select("class", "text")
                        .dropDuplicates(["class"]), "copy-texts")
    both = pairs.join(found.toDF("a", "text_a"), "a").join(found.toDF("b", "text_b"), "b").select(
        "a", "b", "text_a", "text_b")

    def run(batches):
        hasher, last, held = WordHasher(), None, None
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.flatnonzero(np.diff(b, prepend=b[0] - 1 if last is None or len(b) and b[0] != last else b[0]))
            hubs = {int(b[new[i]]): s for i, s in _sets(batch.column(3).take(pa.array(new)), hasher, size)}
            if last is not None:
                hubs.setdefault(last, held)
            keep = np.zeros(len(a), bool)
            for i, mine in _sets(batch.column(2), hasher, size):
                other = hubs[int(b[i])]
                if len(mine) > len(other):
                    mine, other = other, mine
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                common = int((other[at] == mine).sum())
                keep[i] = 100 * common >= percent * (len(mine) + len(other) - common)
            last = int(b[-1]) if len(b) else last
            held = hubs.get(last, held)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    spark = texts.sparkSession
    with sql_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(PAIRS_PER_BATCH)):
        return cut_lineage(both.mapInArrow(run, "a long, b long"), "copy-links")


def _linked(texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``key, n, print, ..`` of every text, and ``(print, least)``: the least id of its component."""
    frequent = _frequent(texts, "text", size)
    docs = cut_lineage(_prefixes(texts, size, percent, frequent), "prefixes")
    one = docs.where("n > 0").groupBy("print").agg(
        F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "h1", "h2")).alias("of"),
        F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    one = one.select("print", "n", "prefix", "bits", "of.*")
    classes = cut_lineage(one.withColumn("class", F.monotonically_increasing_id()), "classes")

    index = classes.select("class", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = index.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token")
    live = cut_lineage(index.join(shared, "token", "left_semi"), "live")

    # Groups of one size and prefix; their rows of the index are those of the least class.
    group = F.xxhash64(F.first("n"), F.sort_array(F.collect_list(F.struct("pos", "token"))))
    second = F.hash(F.sort_array(F.collect_list(F.struct("token", "pos"))))
    placed = live.groupBy("class").agg(
        F.first("n").alias("n"), group.alias("g1"), second.alias("g2"),
        (_prefix_length_col(F.first("n"), percent) - F.count(F.lit(1))).alias("own"))
    placed = cut_lineage(placed, "placed")
    groups = placed.groupBy("g1", "g2", "n").agg(F.min("class").alias("cell"), F.first("own").alias("own"))
    members = cut_lineage(placed.select("class", "g1", "g2", "n").join(groups, ["g1", "g2", "n"])
                          .select("class", "cell", "own"), "members")
    alone = members.where("class = cell").select("cell", "own")
    rows = cut_lineage(live.withColumnRenamed("class", "cell").join(alone, "cell"), "rows")

    # Members against their group's class, groups against the middle one of each shingle.
    hubs = rows.groupBy("token").agg(F.min(F.struct("own", "cell", "n", "pos")).alias("hub"))
    near = rows.alias("a").join(hubs.select("token", "hub.*").alias("b"), F.expr(
        "a.token = b.token and a.cell <> b.cell") & _may_link("a", "b", percent))
    near = near.groupBy(F.col("a.cell").alias("a"), F.col("b.cell").alias("b")).agg(
        F.first("a.n").alias("n_a"), F.first("b.n").alias("n_b"), F.count(F.lit(1)).alias("shared"))
    near = near.where(_enough(F.col("n_a"), F.col("n_b"), F.col("shared"), percent)).select("a", "b")
    inside = members.where("class <> cell").select(F.col("class").alias("a"), F.col("cell").alias("b"))
    first = cut_lineage(near.union(inside), "first-pairs")
    links = _confirmed(first, classes, texts, size, percent)
    found = cut_lineage(components(links).withColumnRenamed("vertex", "class"), "components")

    # Groups against groups, but for members of one component.
    members = cut_lineage(
        members.join(found, "class", "left").join(classes.select("class", "n", "bits"), "class").select(
            "class", "cell", "n", "bits", F.coalesce("component", "class").alias("component")), "placed-members")
    cells = members.groupBy("cell").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"),
        F.first("bits").alias("bits"))
    rows = rows.drop("own").join(cells.drop("bits"), "cell").withColumn(
        "component", F.when(F.col("low") == F.col("high"), F.col("low")))
    rows = cut_lineage(rows.select("token", "pos", "n", "cell", "component"), "group-rows")
    counts = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n_cells"))
    top = counts.groupBy("token").agg(
        F.max(F.when(F.col("component").isNotNull(), F.struct("n_cells", "component"))).alias("top"),
        F.sum(F.when(F.col("component").isNull(), F.col("n_cells")).otherwise(1)).alias("n_open")).where(
        "n_open > 1").select("token", F.col("top.component").alias("top"))
    open_ = cut_lineage(rows.join(top, "token").withColumn(
        "in_top", F.coalesce(F.col("component") == F.col("top"), F.lit(False))).drop("top"), "open-rows")
    # Parity bits, of groups of one class, join the rows for the comparison only.
    alone = cut_lineage(cells.where("size = 1").select("cell", "bits").join(
        open_.select("cell").distinct(), "cell", "left_semi"), "group-bits")
    with_bits = open_.join(alone, "cell", "left")
    pairs = with_bits.where("not in_top").alias("a").join(with_bits.alias("b"), F.expr(
        "a.token = b.token and (b.in_top or a.cell < b.cell) and not (a.component <=> b.component "
        "and a.component is not null)") & _may_link("a", "b", percent)
        & _bits_allow("a.n", "a.bits", "b.n", "b.bits", percent))
    swap = F.col("a.cell") > F.col("b.cell")
    sides = [F.when(swap, F.col(y)).otherwise(F.col(x)) for x, y in (("a.cell", "b.cell"), ("b.cell", "a.cell"))]
    pairs = pairs.groupBy(sides[0].alias("a_cell"), sides[1].alias("b_cell")).agg(
        F.first("a.n").alias("n_a"), F.first("b.n").alias("n_b"), F.count(F.lit(1)).alias("shared"))
    pairs = pairs.where(_enough(F.col("n_a"), F.col("n_b"), F.col("shared"), percent)).select("a_cell", "b_cell")
    mixed = cells.where("low <> high").select(F.col("cell").alias("a_cell"), F.col("cell").alias("b_cell"))
    pairs = cut_lineage(pairs.union(mixed), "group-pairs")
    a = pairs.join(members.alias("m"), F.expr("a_cell = m.cell")).select(
        "b_cell", "class", "n", "bits", "component", "a_cell")
    pairs = a.alias("a").join(members.alias("b"), F.expr(
        "a.b_cell = b.cell and a.component <> b.component and (a.a_cell <> a.b_cell or a.class < b.class)")
        & _bits_allow("a.n", "a.bits", "b.n", "b.bits", percent))
    pairs = pairs.select(F.greatest("a.class", "b.class").alias("a"), F.least("a.class", "b.class").alias("b"))
    links = links.union(_confirmed(pairs.distinct(), classes, texts, size, percent))
    found = components(links).withColumnRenamed("vertex", "class")

    # The least id of a component is found over its classes, then handed to the texts.
    named = classes.select("class", "print", "key", "no_key").join(found, "class", "left").select(
        "print", "key", "no_key", F.coalesce("component", "class").alias("component"))
    named = cut_lineage(named, "named")
    least = named.groupBy("component").agg(F.min(F.struct("no_key", "key")).alias("least"))
    least = cut_lineage(least.select("component", "least.key").withColumnRenamed("key", "least"), "least")
    prints = cut_lineage(named.select("print", "component").join(least, "component").select("print", "least"), "prints")
    return docs, prints


def link_near_copies(cases: DataFrame, size: int = 5, percent: int = 80, key: str = "id",
                     text: str = "text") -> DataFrame:
    """Which texts are near copies of each other.

    ``cases`` are labelled cases or other texts, ``(id, text)``.  A text's set is
    its distinct runs of ``size`` lower-cased (A-Z) words, the whole sequence if
    it has fewer words, and empty without words.  Two texts link when ``100 *
    |intersection| >= percent * |union|``; an empty set links with nothing.

    Returns one row per input row: ``id``, ``n_shingles`` and ``component_id``, the
    smallest id that links reach, its own included.  A null text is empty.
    Repeated rows link like copies; a null id is larger than any other, and a
    component of null ids only has a null ``component_id``.  Other columns are
    ignored; an empty table gives no rows.
    """
    with own_cuts(cases.sparkSession) as keep:
        docs, prints = map(keep, _linked(_named_texts(cases, key, text), size, percent))
    return docs.select("key", "n", "print").join(prints, "print", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))
