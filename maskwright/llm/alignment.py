"""Tokens of two tokenizers over the same texts, aligned by their bytes."""

from __future__ import annotations

import hashlib
import json
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..storage import cut_lineage, sql_conf
from .stable_bpe import ROWS_PER_BATCH, StableEncoder, as_text, byte_letters, slices, stable_cuts

SLICE_BYTES = 1_000_000
MEMO_ENTRIES = 300_000
SHARE = 1 / 262_144
HELD_PAIRS = 2_000_000
WIDE_GROUP = 256

_STATS = ["n_a", "n_b", "n_groups", "n_links"]


class ByteTokens(StableEncoder):
    """A byte-level BPE file: ids of texts, special tokens' strings being plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        table = [b""] * size
        for token, i in vocab.items():
            if all(c in letters for c in token):
                table[i] = bytes(letters[c] for c in token)
        self.table = table


class PieceTokens(StableEncoder):
    """A BPE model of the sentencepiece library that begins texts with a space.

    No piece runs from another character into a space mark, so a text may be cut
    before a space as in ``stable_bpe``; the constructor checks it.  Segments are
    looked up in the memo of the encoder that it is aligned with.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece holds a space mark behind another character")
        self.space = self.model.piece_to_id("▁")
        self.table = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i)
            else b"" if self.model.is_control(i) or self.model.is_unknown(i)
            else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.drops_space = False
        self._forget()

    def _learn(self, segments: list[str]) -> None:
        for at in range(0, len(segments), 4096):
            some = segments[at:at + 4096]
            # The model adds the space that every segment begins with; it gives nothing for "".
            found = self.model.encode([s[1:] for s in some], num_threads=1)
            found = [[self.space] if s == " " else ids for s, ids in zip(some, found)]
            self._add([], [i for ids in found for i in ids], [len(ids) for ids in found])


def _aligner(a_path: str, b_path: str) -> "Aligner":
    """One pair of encoders per process, kept beside the library that it wraps."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_aligners", {})
    if (a_path, b_path) not in kept:
        kept[a_path, b_path] = Aligner(ByteTokens(a_path), PieceTokens(b_path))
    return kept[a_path, b_path]


def _ids(encoder: StableEncoder, places: np.ndarray, codes: np.ndarray, firsts: np.ndarray):
    """Ids of all segments in order, and the first id of each text (and the end)."""
    start = np.frombuffer(encoder.first, np.int64)[places] if len(places) else np.zeros(0, np.int64)
    size = np.frombuffer(encoder.size, np.int64)[places] if len(places) else np.zeros(0, np.int64)
    lengths = size[codes]
    before = np.concatenate([[0], np.cumsum(lengths)])
    index = np.repeat(start[codes] - before[:-1], lengths)
    index += np.arange(len(index))
    store = np.frombuffer(encoder.store, np.int32) if len(encoder.store) else np.zeros(0, np.int32)
    return store[index], before[firsts]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray,
                high: np.ndarray) -> np.ndarray:
    """Which of the tokens ``low .. high`` (inclusive) of A end where a token of B ends.

    Divide and conquer over many ranges at once.  A range is searched from its
    middle outwards, each place by a bisection of B's ends; the common end
    nearest to the middle cuts it, and what has not been looked at on either side
    are the two halves.  A range without a common end is a leaf.  Every place is
    looked at once.
    """
    found, empty = [], np.zeros(0, np.int64)
    near = np.zeros(len(low), np.int64)
    middle = (low + high) >> 1

    def common(at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(at), bool)
        place = ends_a[at[inside]]
        bisected = np.searchsorted(ends_b, place)
        hit[inside] = ends_b[np.minimum(bisected, len(ends_b) - 1)] == place
        return hit

    while True:
        open_ = (middle + near <= high) | (middle - near >= low)
        low, high, middle, near = low[open_], high[open_], middle[open_], near[open_]
        if not len(low):
            return np.sort(np.concatenate(found)) if found else empty
        right, left = middle + near, middle - near
        cut_right = common(right, right <= high)
        cut_left = common(left, (left >= low) & ~cut_right & (near > 0))
        found += [right[cut_right], left[cut_left]]
        # A cut to the right leaves the place as far to the left for the left half.
        near_left = np.where(near > 0, left, left - 1)
        new_low = np.concatenate([low[cut_right], right[cut_right] + 1, low[cut_left], right[cut_left] + 1])
        new_high = np.concatenate([near_left[cut_right], high[cut_right], left[cut_left] - 1, high[cut_left]])
        whole = ~(cut_right | cut_left)
        real = new_low <= new_high
        new_low, new_high = new_low[real], new_high[real]
        low, high = np.concatenate([low[whole], new_low]), np.concatenate([high[whole], new_high])
        middle = np.concatenate([middle[whole], (new_low + new_high) >> 1])
        near = np.concatenate([near[whole] + 1, np.zeros(len(new_low), np.int64)])


def _pair_rows(a_ids, b_ids, a_start, b_start, doc, n_b_ids: int):
    """``(document, a, b, times)`` of all linked ids, in bounded parts that share no pair."""
    n_a, n_b = np.diff(a_start), np.diff(b_start)

    def expanded(groups):
        """Keys of all links of the groups."""
        each = n_a[groups] * n_b[groups]
        at = np.repeat(groups, each)
        k = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        wide = n_b[at]
        a, b = a_ids[a_start[at] + k // wide], b_ids[b_start[at] + k % wide]
        return doc[at] * np.int64(1 << 40) + a.astype(np.int64) * n_b_ids + b

    def of(keys, times=None):
        if times is None:
            keys, times = np.unique(keys, return_counts=True)
        else:
            keys, place = np.unique(keys, return_inverse=True)
            times = np.bincount(place, weights=times, minlength=len(keys)).astype(np.int64)
        low = keys & ((1 << 40) - 1)
        return keys >> 40, low // n_b_ids, low % n_b_ids, times

    wide = n_a * n_b > WIDE_GROUP
    has_wide = np.zeros(int(doc[-1]) + 1 if len(doc) else 0, bool)
    has_wide[doc[wide]] = True
    yield of(expanded(np.flatnonzero(~has_wide[doc])))
    # Texts with a large group: by ranges of A's ids, ids of a group counted first.
    for one in np.flatnonzero(has_wide):
        cells = []
        for g in np.flatnonzero(doc == one):
            a, times_a = np.unique(a_ids[a_start[g]:a_start[g + 1]], return_counts=True)
            b, times_b = np.unique(b_ids[b_start[g]:b_start[g + 1]], return_counts=True)
            cells.append((a, times_a, b, times_b))
        owners = np.concatenate([c[0] for c in cells])
        weight = np.concatenate([np.full(len(c[0]), len(c[2])) for c in cells])
        order = np.argsort(owners, kind="stable")
        part = np.cumsum(weight[order]) // HELD_PAIRS
        limits = [int(owners[order][np.searchsorted(part, p)]) for p in np.unique(part)]
        limits = sorted({0, *limits[1:]}) + [1 << 40]
        for least, end in zip(limits, limits[1:]):
            keys, times = [], []
            for a, times_a, b, times_b in cells:
                low, high = np.searchsorted(a, (least, end))
                pair = a[low:high, None].astype(np.int64) * n_b_ids + b[None, :]
                keys.append(pair.ravel() + np.int64(one) * (1 << 40))
                times.append((times_a[low:high, None] * times_b[None, :]).ravel())
            yield of(np.concatenate(keys), np.concatenate(times))


class Aligner:
    """Aligns the tokens of two encoders over slices of texts."""

    def __init__(self, a: StableEncoder, b: StableEncoder):
        self.a, self.b = a, b
        self.bytes_a, self.bytes_b = (pa.array(x.table, pa.binary()) for x in (a, b))
        self.size_a, self.size_b = (np.array([len(t) for t in x.table], np.int64) for x in (a, b))
        spelled = [f"{i}{c}" for i in range(len(a.table)) for c in ",|"]
        spelled += [f"{i}{c}" for i in range(len(b.table)) for c in ",;"]
        self.spelled = pa.array(spelled, pa.string())

    def _places(self, segments: pa.Array) -> np.ndarray:
        """Places of distinct segments, the same ones in both memos."""
        if self.a.full() or len(self.a.known) > MEMO_ENTRIES:
            self.a._forget()
            self.b._forget()
        before = len(self.a.known)
        places = self.a._places(segments)
        self.b._learn([*islice(self.a.known, before, None)])
        return places

    def _same(self, texts, ids, firsts, table, size) -> np.ndarray:
        """Of which texts the tokens' bytes are the text's."""
        raw = table.take(pa.array(ids))
        want = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        ends = np.concatenate([[0], np.cumsum(size[ids])])[firsts]
        same = np.diff(ends) == np.diff(want)
        got = raw.buffers()[2] if len(ids) else None
        got, data = memoryview(got or b""), memoryview(data or b"")
        if same.all() and got[:int(ends[-1])] == data[int(want[0]):int(want[-1])]:
            return same
        for i in np.flatnonzero(same):
            same[i] = got[int(ends[i]):int(ends[i + 1])] == data[int(want[i]):int(want[i + 1])]
        return same

    def __call__(self, texts: pa.Array):
        """Of a slice: ``(stats, spelled groups by text, parts of pairs)``."""
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        segments, cut = stable_cuts(spaced)
        coded = segments.dictionary_encode()
        places, codes = self._places(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        (a_ids, a_first), (b_ids, b_first) = (_ids(x, places, codes, cut) for x in (self.a, self.b))
        good = (self._same(spaced, a_ids, a_first, self.bytes_a, self.size_a)
                & self._same(spaced, b_ids, b_first, self.bytes_b, self.size_b) & ~empty)
        if not good.all():
            a_ids = a_ids[np.repeat(good, np.diff(a_first))]
            b_ids = b_ids[np.repeat(good, np.diff(b_first))]
        n_a, n_b = np.diff(a_first) * good, np.diff(b_first) * good
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))

        ends_a, ends_b = np.cumsum(self.size_a[a_ids]), np.cumsum(self.size_b[b_ids])
        last = first_a[1:][good] - 1
        some = n_a[good] > 1
        cuts = shared_cuts(ends_a, ends_b, first_a[:-1][good][some], last[some] - 1)
        cuts = np.union1d(cuts, last)
        a_start = np.concatenate([[0], cuts + 1])
        b_start = np.concatenate([[0], np.searchsorted(ends_b, ends_a[cuts]) + 1])
        doc = np.searchsorted(first_a, cuts, "right") - 1
        links = np.diff(a_start) * np.diff(b_start)
        n_groups = np.bincount(doc, minlength=len(texts))
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, doc, links)

        keys = np.empty(len(a_ids) + len(b_ids), np.int64)
        keys[np.arange(len(a_ids)) + np.repeat(b_start[:-1], np.diff(a_start))] = a_ids * np.int64(2)
        keys[np.arange(len(b_ids)) + np.repeat(a_start[1:], np.diff(b_start))] = (
            b_ids * np.int64(2) + 2 * len(self.size_a))
        keys[a_start[1:] - 1 + b_start[:-1]] += 1
        keys[b_start[1:] - 1 + a_start[1:]] += 1
        written = self.spelled.take(pa.array(keys))
        raw = memoryview(written.buffers()[2]) if len(keys) else memoryview(b"")
        ends = np.frombuffer(written.buffers()[1], np.int32) if len(keys) else np.zeros(1, np.int32)
        first = ends[first_a + first_b]
        groups = [raw[int(first[i]):int(first[i + 1]) - 1] if good[i] else None for i in range(len(texts))]
        pairs = _pair_rows(a_ids, b_ids, a_start, b_start, doc, len(self.size_b)) if len(doc) else iter(())
        return (n_a, n_b, n_groups, n_links), groups, pairs


def _align(texts: DataFrame, a_path: str, b_path: str, key: str, text: str, with_groups: bool) -> DataFrame:
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, row int, part int, {', '.join(f'{c} long' for c in _STATS)}, groups_sha256 string"
    schema += ", groups string" * with_groups + ", a array<int>, b array<int>, times array<int>"
    names = [key, "row", "part", *_STATS, "groups_sha256", *["groups"] * with_groups, "a", "b", "times"]

    def run(batches):
        aligner = _aligner(a_path, b_path)
        at = 0
        for batch in batches:
            for row, part in slices(as_text(batch.column(1)), SLICE_BYTES):
                stats, groups, pairs = aligner(part)
                digest = [hashlib.sha256(g).hexdigest() if g is not None else "" for g in groups]
                keys, n = batch.column(0).slice(row, len(part)), len(part)
                for k, (doc, a, b, times) in enumerate([*pairs] or [(np.zeros(0, np.int64),) * 4]):
                    who = np.arange(n) if k == 0 else np.unique(doc)
                    ends = pa.array(np.searchsorted(doc, np.append(who, n)), pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (a, b, times)]
                    columns = [keys.take(pa.array(who)), pa.array(at + who, pa.int32()),
                               pa.array(np.full(len(who), k), pa.int32())]
                    columns += [pa.array(s[who], pa.int64()) for s in stats]
                    columns.append(pa.array([digest[i] for i in who], pa.string()))
                    if with_groups:
                        columns.append(pa.array(
                            [bytes(groups[i]).decode() if k == 0 and groups[i] is not None else ""
                             for i in who], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns + lists, names=names)
                at += n

    rows = texts.select(key, text).mapInArrow(run, schema)
    # Number of the task above, number of the row below.
    base = F.shiftrightunsigned(F.monotonically_increasing_id(), 33)
    return rows.select(F.shiftleft(base, 33).bitwiseOR(F.col("row")).alias("row"), *[c for c in names if c != "row"])


def _pair_counts(rows: DataFrame) -> DataFrame:
    """``(a, b, n)``: in how many texts a pair of ids is linked, summed up within tasks first."""
    def run(batches):
        held, size = [], 0

        def report():
            keys = np.concatenate([k for k, _ in held])
            times = np.concatenate([t for _, t in held])
            keys, place = np.unique(keys, return_inverse=True)
            return keys, np.bincount(place, weights=times, minlength=len(keys)).astype(np.int64)

        def batch_of(keys, times):
            return pa.RecordBatch.from_arrays(
                [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)),
                 pa.array(times)], names=["a", "b", "n"])

        for batch in batches:
            a, b = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            held.append(np.unique((a << 32) | b, return_counts=True))
            size += len(held[-1][0])
            if size >= HELD_PAIRS:
                held = [report()]
                size = len(held[0][0])
                if size >= HELD_PAIRS // 2:
                    yield batch_of(*held[0])
                    held, size = [], 0
        if held:
            yield batch_of(*report())

    return rows.select("a", "b").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(
        F.sum("n").alias("n"))


def align_tokenizers(texts: DataFrame, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id",
                     text: str = "text", with_groups: bool = False) -> DataFrame:
    """How the tokens of two tokenizers correspond over texts.

    ``texts`` are texts to scrub or scrubbed ones, ``(doc_id, text)``; so a span
    that a finder reports in one tokenizer's tokens can be read in the other's.
    ``tokenizer_a`` is a byte-level BPE file, which encodes a space and the text,
    ``tokenizer_b`` a BPE model of the sentencepiece library, which adds that
    space; both paths are readable on every executor.  Special tokens' strings are
    plain text.  Texts are cut into groups where tokens of both end (see
    :func:`shared_cuts`); all tokens of A and of B within a group are linked.

    Returns one row per input row: ``doc_id``, ``n_a`` and ``n_b`` (tokens),
    ``n_groups``, ``n_links``, ``n_best`` (links whose pair of ids is linked in as
    many texts as any pair of its A id), ``count_sum`` (over links, the number of
    texts that link their ids) and ``groups_sha256``, the digest of the groups as
    ``a1,a2|b1;a3|b2,b3``; with ``with_groups`` also these ``groups``.  A text that
    is null or empty, or that the bytes of either's tokens do not spell, has no
    tokens: zeros and ''.  Repeated rows count as texts of their own, null keys
    stay, other columns are ignored; an empty table gives no rows.

    Pairs of a text are written once.  Pairs that make up more than ``SHARE`` of all
    entries, at most ``1 / SHARE`` by the pigeonhole principle, are handed to all
    tasks with their counts; the others, none of them frequent, are joined.
    """
    spark = texts.sparkSession
    with sql_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH)):
        rows = cut_lineage(_align(texts, tokenizer_a, tokenizer_b, key, text, with_groups), "alignment")
        counts = cut_lineage(_pair_counts(rows), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    counts = cut_lineage(counts.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("best")).alias("best")),
                         "pair-ranks")
    entries = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") > int(SHARE * entries)).toArrow()
    keys = (often["a"].to_numpy().astype(np.int64) << 32) | often["b"].to_numpy()
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((
        keys[order], often["n"].to_numpy()[order],
        often["best"].to_numpy(zero_copy_only=False).astype(bool)[order]))

    def apply(batches):
        keys, counted, is_best = known.value
        for batch in batches:
            lists = [batch.column(i) for i in (1, 2, 3)]
            a, b, times = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))])
            pair = (a << 32) | b
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)

            def summed(values):
                total = np.concatenate([[0], np.cumsum(values)])
                return pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())

            if len(keys):
                sums = [summed(times * hit * is_best[at]), summed(times * hit * counted[at])]
            else:
                sums = [summed(times * 0)] * 2
            left = np.concatenate([[0], np.cumsum(~hit)])[ends]
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~hit].astype(np.int32)))
                    for x in (a, b, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums, *rest],
                                             names=["row", "n_best", "count_sum", "a", "b", "times"])

    summed = rows.select("row", "a", "b", "times").mapInArrow(
        apply, "row long, n_best long, count_sum long, a array<int>, b array<int>, times array<int>")
    with sql_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH)):
        summed = cut_lineage(summed, "pair-sums")
    rare = summed.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select(
        "row", "p.*").join(counts, ["a", "b"])
    rare = rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"),
                       (F.col("times") * F.col("n")).alias("count_sum"))
    sums = summed.select("row", "n_best", "count_sum").union(rare).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.where("part = 0").join(sums, "row").select(
        key, *_STATS, "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)
