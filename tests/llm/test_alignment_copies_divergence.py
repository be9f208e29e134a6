"""Alignment of tokenizers, SuperMinHash groups and split divergence against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm import alignment, divergence, superminhash
from maskwright.llm.alignment import ByteTokens, align_tokenizers, shared_cuts
from maskwright.llm.divergence import Trees, share, split_divergence
from maskwright.llm.queries import BYTE_BPE, PIECE_BPE
from maskwright.llm.superminhash import band_keys, group_near_copies, signatures
from maskwright.plans.scrub import scrub

BYTE = Tokenizer.from_file(BYTE_BPE)
BYTE.encode_special_tokens = True
PIECE = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
TABLE = ByteTokens(BYTE_BPE).table


def piece_bytes(i):
    name = PIECE.id_to_piece(i)
    return bytes([int(name[3:5], 16)]) if PIECE.is_byte(i) else name.replace("▁", " ").encode()


def groups_of(text):
    """Groups of ids between shared ends, by sets; None without tokens."""
    if not text:
        return None
    a, b = BYTE.encode(" " + text, add_special_tokens=False).ids, PIECE.encode(text)
    raw_a, raw_b = [TABLE[i] for i in a], [piece_bytes(i) for i in b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
    common = np.intersect1d(ends_a, ends_b)
    out = [([], []) for _ in common]
    for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
        for i, end in zip(ids, ends):
            out[int(np.searchsorted(common, end))][side].append(i)
    return out


def aligned(texts):
    """The contract's columns by brute force, for every text."""
    groups = [groups_of(t) for t in texts]
    linked = [collections.Counter((x, y) for a, b in g or [] for x in a for y in b) for g in groups]
    count = collections.Counter(pair for links in linked for pair in links)
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for g, links in zip(groups, linked):
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        rows.append((
            sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(links.values()),
            sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if g else "", spelled))
    return rows


PARTS = ["a", "b", "the", "'s", " ", "  ", "\n", "é", "漢", "1", "<|endoftext|>", "!", "İ", "😀", "한", "ing",
         "<s>", "\x00", "　", "\t", "▁"]


def odd_texts():
    rng = random.Random(3)
    return [None, "", " ", "trail  ", " lead", "x\ny\n z", "a ▁ b", "漢字かな交じり文。" * 40, "ab" * 3000,
            "Mail\tDana  at dana@x.org\n" * 20, "tok " * 2000] + [
        "".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(150)]


def test_shared_cuts_equal_intersection():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 400):
        ends_a = np.cumsum(rng.integers(1, 5, n))
        inner = rng.choice(ends_a[-1], min(int(ends_a[-1]) - 1, n), replace=False) + 1
        ends_b = np.union1d(inner, ends_a[-1:])
        got = shared_cuts(ends_a, ends_b, np.array([0]), np.array([n - 1]))
        assert got.tolist() == np.flatnonzero(np.isin(ends_a, ends_b)).tolist()
    assert shared_cuts(np.array([1]), np.array([1]), np.zeros(0, int), np.zeros(0, int)).tolist() == []


@pytest.mark.parametrize("wide,held,share_", [(256, 4_000_000, 1 / 262_144), (3, 40, 1 / 40), (3, 40, 1.0)])
def test_alignment_equals_brute_force(spark, monkeypatch, wide, held, share_):
    monkeypatch.setattr(alignment, "WIDE_GROUP", wide)
    monkeypatch.setattr(alignment, "HELD_PAIRS", held)
    monkeypatch.setattr(alignment, "SHARE", share_)
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = {r.doc_id: tuple(r)[1:] for r in align_tokenizers(
        df.repartition(3), BYTE_BPE, PIECE_BPE, with_groups=True).collect()}
    assert [got[i] for i in range(len(texts))] == aligned(texts)


def test_alignment_query_digest_and_odd_rows(spark, tmp_path):
    from maskwright.llm.queries import op11_cross_tokenizer_alignment

    texts = odd_texts()[:40]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "one two", "x"), (3, "trail  ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_cross_tokenizer_alignment(spark, str(tmp_path))
    want = [row[:-1] for row in aligned([t for _, t, _ in rows])]
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        str((key,) + row) for (key, _, _), row in zip(rows, want))
    assert align_tokenizers(df.limit(0), BYTE_BPE, PIECE_BPE).count() == 0


def test_alignment_of_scrubbed_texts(spark):
    said = "Write to dana.w@corp.org or call 305-555-0199."
    done = scrub(spark.createDataFrame([(1, said), (2, said)], "doc_id long, text string"), contextual=None)
    texts = [r.scrubbed for r in done.orderBy("doc_id").collect()]
    got = align_tokenizers(done, BYTE_BPE, PIECE_BPE, text="scrubbed").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [row[:-1] for row in aligned(texts)] and texts[0] != said


def brute_signature(elements, places):
    """SuperMinHash of one set, element by element with whole permutations."""
    out = [2**64 - 1] * places
    for element in elements:
        order = list(range(places))
        for level in range(places):
            drawn = int(superminhash.mix(np.array([(int(element) + superminhash._LEVEL * (level + 1)) % 2**64],
                                                  np.uint64))[0])
            at = level + (drawn >> 32) % (places - level)
            order[level], order[at] = order[at], order[level]
            out[order[level]] = min(out[order[level]], (level << 32) | (drawn & 0xFFFFFFFF))
    return out


def test_signatures_equal_whole_permutations():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**64, n, np.uint64) for n in (1, 2, 7, 40, 300, 0, 5)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = signatures(np.concatenate(sets), first, 28)
    assert got.tolist() == [brute_signature(s, 28) for s in sets]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    shared, own = rng.integers(0, 2**64, 600, np.uint64), rng.integers(0, 2**64, 200, np.uint64)
    a, b = np.concatenate([shared, own[:100]]), np.concatenate([shared, own[100:]])
    ranks = signatures(np.concatenate([a, b]), np.array([0, 700, 1400]), 224)
    assert abs((ranks[0] == ranks[1]).mean() - 600 / 800) < 0.1
    assert (band_keys(ranks, 32, 7)[0] == band_keys(ranks, 32, 7)[1]).any()


def copies():
    rng = np.random.default_rng(5)
    texts = []
    for family in range(8):
        words = [f"w{x}" for x in rng.integers(0, 500, 120)]
        for k in range(14):
            copy = list(words)
            for at in rng.integers(0, 120, k % 5):
                copy[at] = f"new{rng.integers(0, 9)}"
            texts.append(" ".join(copy[:120 - k % 3]))
    # A chain whose ends do not link with each other, and families with much in common.
    base = [f"c{i}" for i in range(300)]
    texts += [" ".join(base[12 * k:12 * k + 140]) for k in range(10)]
    texts += [" ".join([f"t{i}" for i in range(90)] + [f"own{k}_{i}" for i in range(30)]) for k in range(12)]
    return texts + [None, "", "a", "A", "a b", "one two three four", "ONE two three four"]


def groups_by_brute_force(texts, size, percent):
    sets = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if v == high else v for v in label]
    return {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}


def test_groups_equal_brute_force(spark):
    texts = copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h1", F.lit("clash"))
    got = {r.doc_id: tuple(r)[1:] for r in group_near_copies(df.repartition(5)).collect()}
    assert got == groups_by_brute_force(texts, 5, 85)


def test_groups_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(2, base), (2, base), (1, base + " more"), (None, base), (4, None), (5, ""), (None, "alone in here"),
            (7, "x " * 60_000), (6, "X  " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in group_near_copies(df).collect())
    assert got == sorted([
        ("2", 56, "1", False), ("2", 56, "1", False), ("1", 57, "1", True), ("None", 56, "1", False),
        ("4", 0, "4", True), ("5", 0, "5", True), ("None", 1, "None", True), ("7", 1, "6", False),
        ("6", 1, "6", True)])
    assert group_near_copies(df.limit(0)).count() == 0


def test_groups_of_scrubbed_notes(spark):
    rows = [(i, "Dana Whitfield wrote from dana.w@corp.org about the shipment that never came to us "
                + "and asked for a call at 305-555-0199 on Monday" + " please" * (i % 2)) for i in range(4)]
    done = scrub(spark.createDataFrame(rows, "doc_id long, text string"), contextual=None)
    got = group_near_copies(done, text="scrubbed").collect()
    assert {r.component_id for r in got} == {0} and [r.doc_id for r in got if r.kept] == [0]


def divergence_by_brute_force(rows, least, top):
    counts, holds, splits = collections.Counter(), collections.defaultdict(set), set()
    for number, (task, split, text) in enumerate(rows):
        task, split = task or "", split or ""
        splits.add((task, split))
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for term in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower):
            counts[task, split, term] += 1
            holds[task, term].add(number)
    out = []
    for task in {t for t, _ in splits}:
        kept = sorted(term for t, term in holds if t == task and len(holds[t, term]) >= least)
        mine = sorted(s for t, s in splits if t == task)

        def shares(chosen):
            n = {k: sum(counts[task, s, k] for s in chosen) for k in kept}
            return {k: 1 + 10**9 * (n[k] + 2) // (sum(n.values()) + 2 * len(kept)) for k in kept}

        def ranked(split, part, found):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            return [(task, split, part, item, value, k + 1) for k, (item, value) in enumerate(found)]

        q = shares(mine)
        for s in mine:
            p = shares([s])
            out += ranked(s, "pair", [(t, sum((p[k] - o[k])**2 // (p[k] + o[k]) for k in kept))
                                      for t in mine if t != s for o in [shares([t])]])
            out += ranked(s, "term", [(k, (p[k] - q[k])**2 // (p[k] + q[k])) for k in kept
                                      if counts[task, s, k] and p[k] > q[k]])[:top]
    return out


@pytest.mark.parametrize("block,splits", [(2048, 64), (4, 2)])
def test_divergence_equals_brute_force(spark, monkeypatch, block, splits):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "SPLIT_BLOCK", splits)
    rng = random.Random(6)
    words = ["Alpha", "beta", "GAMMA", "délta", "ÉTA", "漢字", "don't", "x1y", "zeta_eta", "iota", "kappa"]
    rows = [(rng.choice(["drafting", "coding", None]), rng.choice(["dev", "holdout", None, "a", "ß"]),
             " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(160)]
    rows += [("lone", "dev", "never kept"), ("empty", "dev", None), ("empty", "holdout", ""), ("drafting", "bare", "")]
    df = spark.createDataFrame(rows, "task string, split string, text string").withColumn("term", F.lit("clash"))
    got = [tuple(r) for r in split_divergence(df.repartition(4), least=10, top=4).collect()]
    assert sorted(got) == sorted(divergence_by_brute_force(rows, 10, 4))
    assert split_divergence(df.limit(0)).count() == 0


def test_trees_share_equal_subtrees():
    counts = np.zeros((3, 64), np.int64)
    counts[:2, 5] = 3
    trees = Trees(counts)
    assert trees.roots[0] == trees.roots[1] != trees.roots[2]
    assert [len(x) for x in trees.left] == [2] * 6
    total = counts.sum(axis=1)
    got = trees.prices(np.array([0, 0]), np.array([1, 2]), total, 64)
    p, q = share(counts[0], total[:1], 64), share(counts[2], total[2:], 64)
    assert got.tolist() == [0, int(((p - q)**2 // (p + q)).sum())]


def test_share_is_exact():
    for count, total, n in ((10**15, 5 * 10**15, 10**6), (0, 0, 1), (7, 10**9, 3)):
        assert share(np.array([count]), np.array([total]), n)[0] == 1 + 10**9 * (count + 2) // (total + 2 * n)


def test_divergence_of_labelled_cases(spark, tmp_path):
    import json

    from maskwright.sources.cases import read_eval_cases

    with open(tmp_path / "cases.jsonl", "w") as f:
        for i in range(30):
            f.write(json.dumps({"id": f"c{i}", "task": "support", "text": "Refund the order" + " today" * (i % 2),
                                "pii": [], "essential": [], "split": "dev" if i % 2 else "holdout"}) + "\n")
    got = split_divergence(read_eval_cases(spark, str(tmp_path / "cases.jsonl"), "all"))
    first = {(r.split, r.part): r.item for r in got.collect() if r["rank"] == 1}
    assert first["dev", "term"] == "today" and first["dev", "pair"] == "holdout"


def test_memory_of_the_aligner_is_bounded(spark, monkeypatch):
    texts = [f"word{i} other{i} third{i}" for i in range(300)]
    whole = alignment._aligner(BYTE_BPE, PIECE_BPE)
    small = alignment.Aligner(whole.a, whole.b)
    want = [bytes(g) for g in small(pa.array(texts))[1]]
    monkeypatch.setattr(alignment, "MEMO_ENTRIES", 100)
    got, held = [], []
    for at in range(0, 300, 10):
        got += [bytes(g) for g in small(pa.array(texts[at:at + 10]))[1]]
        held.append(len(small.a.known))
    assert got == want and max(held[1:]) <= 100 + 30

    sizes, cut = [], alignment.cut_lineage

    def spied(df, label, **options):
        if "MapInArrow" in df._jdf.queryExecution().executedPlan().toString():
            sizes.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return cut(df, label, **options)

    monkeypatch.setattr(alignment, "cut_lineage", spied)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:20])], "doc_id long, text string")
    assert align_tokenizers(rows, BYTE_BPE, PIECE_BPE).count() == 20
    assert sizes and max(sizes) <= alignment.ROWS_PER_BATCH
