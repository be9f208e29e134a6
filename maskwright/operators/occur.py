"""Which pairs of a scope's map occur in which text of the scope.

A text needs only the pairs whose value it contains.  They are found by
equi-joins on token sequences, at every size of the map, so no text ever meets
the whole map of its scope and no list of a scope's pairs is built.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import let
from ..storage import cut_lineage

TOKEN = "[A-Za-z0-9]+"
CORE = "(?s)[A-Za-z0-9](?:.*[A-Za-z0-9])?"
INLINE_PAIRS = 1000
SALTS = 16


def attach_pairs(
    texts: DataFrame, pairs: DataFrame, keys: list[str], text: str = "text",
) -> DataFrame:
    """Add ``pairs`` (array of find/put) to ``texts(scope, keys, text, ...)``.

    ``pairs`` has ``(scope, find, put)`` with unique ``find`` per scope.  A text
    gets those that may occur in it as whole tokens; null if there is none.
    """
    found = occurring_pairs(texts.select("scope", *keys, text), pairs, keys, text)
    return texts.join(found, ["scope", *keys], "left")


def attach_stand_ins(
    texts: DataFrame, pairs: DataFrame, keys: list[str], text: str, inline: int = INLINE_PAIRS,
) -> DataFrame:
    """The same for restoring, where a stand-in may start inside a token.

    Scopes with at most ``inline`` pairs hand their list, salted, to their texts; for
    larger ones the texts are probed for hashes of stand-ins.  Restoring drops pairs
    that do not occur, so texts come out the same either way.
    """
    counts = pairs.groupBy("scope").agg(F.count(F.lit(1)).alias("_n"))
    large = counts.where(F.col("_n") > inline).select("scope")
    small_pairs = pairs.join(large, "scope", "left_anti").groupBy("scope").agg(
        F.collect_list(F.struct("find", "put")).alias("pairs")
    ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = texts.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))

    def handed(rows: DataFrame) -> DataFrame:
        return rows.join(small_pairs, ["scope", "_salt"], "left").drop("_salt")

    if large.isEmpty():
        return handed(salted)
    few = handed(salted.join(large, "scope", "left_anti"))
    many = texts.join(large, "scope", "left_semi")
    wanted = pairs.join(large, "scope", "left_semi")
    return few.unionByName(_probe_stand_ins(many, wanted, keys, text))


def occurring_pairs(
    texts: DataFrame, pairs: DataFrame, keys: list[str], text: str = "text",
) -> DataFrame:
    """``(scope, keys, pairs)`` with every pair whose ``find`` may occur in the text.

    A whole-token match starts and ends at the edges of letter-digit runs, so the
    part of ``find`` from its first to its last run equals a sequence of runs of
    the text.  First runs are matched alone, then sequences of the right lengths
    only where the first run fits.  Texts with the same keys share one list.
    """
    id_cols = ["scope", *keys]
    parsed = pairs.select(
        "scope", "find", "put", F.regexp_extract("find", CORE, 0).alias("core")
    )
    cored = parsed.where(F.col("core") != "")
    # Written first, so that its size is known: where it is small, the tokens of the texts
    # meet it where they are and only those that fit are shuffled.
    heads = cut_lineage(cored.groupBy("scope", F.regexp_extract("core", TOKEN, 0).alias("head")).agg(
        F.collect_set(F.size(F.regexp_extract_all("core", F.lit(TOKEN), F.lit(0)))).alias("ns")
    ), "heads")
    tokens = texts.select(
        *id_cols,
        F.explode_outer(
            F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
        ).alias("head"),
    )
    fitting = tokens.join(heads, ["scope", "head"]).groupBy(*id_cols).agg(
        F.map_from_entries(F.collect_set(F.struct("head", "ns"))).alias("_heads")
    )

    def sequences(pieces):
        at = F.transform(
            pieces,
            lambda piece, i: F.transform(
                F.element_at("_heads", piece),
                lambda n: F.array_join(F.slice(pieces, i + 1, n * 2 - 1), ""),
            ),
        )
        return F.array_distinct(F.flatten(F.filter(at, lambda a: a.isNotNull())))

    pieces = F.regexp_extract_all(text, F.lit(f"{TOKEN}|[^A-Za-z0-9]+"), F.lit(0))
    grams = texts.join(fitting, id_cols).select(
        *id_cols, F.explode_outer(let(pieces, sequences)).alias("core")
    )
    hits = grams.join(cored, ["scope", "core"]).select(*id_cols, "find", "put")
    bare = parsed.where(F.col("core") == "")
    if not bare.isEmpty():
        hits = hits.unionByName(_substring_hits(texts, bare, id_cols, text))
    return hits.groupBy(*id_cols).agg(F.collect_set(F.struct("find", "put")).alias("pairs"))


def _substring_hits(texts, pairs, id_cols, text) -> DataFrame:
    """Equi-join on all substrings of the lengths that the scope's pairs have."""
    lengths = pairs.groupBy("scope").agg(F.collect_set(F.length("find")).alias("_ls"))
    windows = F.flatten(F.transform(
        "_ls",
        lambda n: F.when(
            F.length(text) >= n,
            F.transform(
                F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.col(text).substr(i, n)
            ),
        ).otherwise(F.array().cast("array<string>")),
    ))
    grams = texts.join(lengths, "scope").select(
        *id_cols, F.explode_outer(F.array_distinct(windows)).alias("find")
    )
    return grams.join(pairs.select("scope", "find", "put"), ["scope", "find"]).select(
        *id_cols, "find", "put"
    )


LEAD = 64
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
MIXES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Probe:
    """Rolling hashes of the windows of a text, tested against a set of bits.

    A window's hash is the sum of its code points times powers of an odd base modulo
    2**64, taken from prefix sums; it does not depend on what lies around the window.
    """

    def __init__(self, bits: int, lengths: list[int]):
        self.bits, self.lengths = bits, lengths
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            self.up, self.down = (
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, b, np.uint64))])
                for b in (BASE, pow(BASE, -1, 1 << 64)))

    def places(self, text: str, scope: int):
        """``(start, length, places of its bits)`` for all windows of each length, in pieces."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self._powers(min(len(codes), PIECE + LEAD))
        mask = np.uint64(int(scope) & 0xFFFFFFFFFFFFFFFF)
        for start in range(0, len(codes), PIECE):
            piece = codes[start:start + PIECE + LEAD]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * self.up[:len(piece)])])
            for n in self.lengths:
                here = min(len(piece) - n + 1, PIECE)
                if here <= 0:
                    continue
                h = (sums[n:n + here] - sums[:here]) * self.down[:here] ^ mask
                h ^= h >> np.uint64(29)
                yield start, n, [(h * np.uint64(mix)) >> np.uint64(64 - self.bits) for mix in MIXES]

    def found(self, text: str, scope: int, words: np.ndarray) -> list[str]:
        """Distinct windows of the text whose bits are all set."""
        out = set()
        for start, n, (first, second) in self.places(text, scope):
            hit = np.flatnonzero(_is_set(words, first))
            hit = hit[_is_set(words, second[hit])] + start
            out.update(text[i:i + n] for i in hit.tolist())
        return sorted(out)


def _is_set(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) != 0


def _probe_stand_ins(texts: DataFrame, pairs: DataFrame, keys: list[str], text: str, max_bits: int = 27) -> DataFrame:
    """Texts with the ``pairs`` of large scopes that may occur in them, anywhere.

    Every stand-in, or its first 64 characters, is hashed into a set of bits: 16 bits
    a stand-in and 2**``max_bits`` at most (16 MB), which every task gets.  All
    windows of a text of the lengths that stand-ins have are tested against it where
    the text lies; only windows that pass are joined, and only texts with one are
    shuffled.  Windows that pass by chance, more of them once the set is full,
    meet no pair in the join.
    """
    id_cols = ["scope", *keys]
    pairs = cut_lineage(pairs.where("find <> ''").select(
        "scope", "find", "put", F.substring("find", 1, LEAD).alias("lead")), "stand-ins")
    sizes = pairs.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("lead")).alias("ns")).first()
    bits = min(max(10, (16 * sizes["n"]).bit_length()), max_bits)
    probe = Probe(bits, sorted(sizes["ns"]))

    @F.pandas_udf("array<long>")
    def bit_places(leads: pd.Series, scopes: pd.Series) -> pd.Series:
        alone = {n: Probe(bits, [n]) for n in probe.lengths}
        return pd.Series([
            [int(p[0]) for _, _, both in alone[len(t)].places(t, s) for p in both] for t, s in zip(leads, scopes)])

    place = F.explode(bit_places("lead", F.xxhash64("scope")))
    set_bits = pairs.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("mask")).toPandas()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[set_bits["word"].to_numpy(np.int64)] = set_bits["mask"].to_numpy(np.int64).view(np.uint64)
    handed = texts.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("array<string>")
    def windows(values: pd.Series, scopes: pd.Series) -> pd.Series:
        return pd.Series([probe.found(t, s, handed.value) if t else [] for t, s in zip(values, scopes)])

    probed = cut_lineage(texts.withColumn("_leads", windows(text, F.xxhash64("scope"))), "probed")
    with_some = probed.where(F.size("_leads") > 0)
    hits = with_some.select(*id_cols, F.explode("_leads").alias("lead")).join(pairs, ["scope", "lead"])
    found = hits.groupBy(*id_cols).agg(F.collect_list(F.struct("find", "put")).alias("pairs"))
    joined = with_some.drop("_leads").join(found, id_cols, "left")
    none = probed.where(F.size("_leads") == 0).drop("_leads")
    return joined.unionByName(none.withColumn("pairs", F.lit(None).cast(joined.schema["pairs"].dataType)))
