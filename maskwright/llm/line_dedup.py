"""Removal of lines that are near copies of earlier lines, over all texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import cut_lineage, own_cuts, sql_conf

BUCKETS = 1 << 18
WIDE = 32
EARLY_SHARE = 2
MOST = 65_535
FILTER_WORDS = 1 << 18
# Tokens are joined in so many parts, one after the other, so that a part of the index lies
# in shuffle files at once.
PASSES = 4
# A file's words are mostly in its dictionary; a larger one keeps them short.
WORD_FILES = {"parquet.dictionary.page.size": str(8 << 20), "compression": "zstd"}
LINE_FILES = {"compression": "zstd"}


def _clean(text: Column) -> Column:
    """The text in lower case, with a space for each white space character but the line feed."""
    low = F.lower(text)
    # Looks at every character by itself, so only where there is one to replace.
    other = reduce(Column.__or__, [F.contains(low, F.lit(c)) for c in "\t\x0b\f\r"])
    return F.when(other, F.translate(low, "\t\x0b\x0c\r", "    ")).otherwise(low)


def _set(line: Column) -> Column:
    """Distinct words of a cleaned line, as hashes."""
    return F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))


def _bucket(hash_: Column) -> Column:
    return hash_.bitwiseAND(BUCKETS - 1).cast("int")


def _keys(tokens: Column, ranks: Column) -> Column:
    """Tokens as numbers that sort rare ones first: the rank of their count above 48 bits of hash."""
    return F.sort_array(F.transform(
        tokens, lambda x: F.get(ranks, _bucket(x)).bitwiseOR(F.shiftrightunsigned(x, 16))))


def _print(keys: Column) -> list[Column]:
    return [F.xxhash64(keys).alias("a"), F.xxhash64(F.lit(1), keys).alias("b")]


def _parity(keys: Column) -> Column:
    """For each of 64 buckets, whether a set has an odd number of tokens in it."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))


def _line(rows: DataFrame, ranks: DataFrame, percent: int, *names: str) -> DataFrame:
    """``names, a, b, n, prefix, low, high`` of lines with their ``words``.

    ``low`` are the parity bits of all tokens, ``high``, of long lines only, those
    of the half of them with a further bit of the hash.  A prefix token keeps 32 bits.
    """
    # A step for what is used more than once: an expression within a lambda is interpreted.
    rows = rows.select(*names, "words", ranks.scalar().alias("ranks"))
    rows = rows.select(*names, _keys(F.col("words"), F.col("ranks")).alias("keys"))
    rows = rows.select(*names, "keys", F.size("keys").alias("n"))
    keys, n = F.col("keys"), F.col("n")
    half = F.filter(keys, lambda x: x.bitwiseAND(64) != 0)
    prefix = F.transform(F.slice(keys, F.lit(1), _prefix_length(n, percent)), lambda x: F.shiftright(
        F.call_function("shiftleft", x, F.lit(32)), 32).cast("int"))
    return rows.select(*names, *_print(keys), "n", _parity(keys).alias("low"),
                       F.when(n >= WIDE, _parity(half)).otherwise(0).alias("high"), prefix.alias("prefix"))


def token_ranks(lines: DataFrame) -> DataFrame:
    """One row with an array: the rank of each hash bucket of ``words`` by the lines they are in.

    A rank is 512 times the binary logarithm of the count, above 48 bits of zeros.  The
    array has ``BUCKETS`` entries however many words there are.
    """
    spark = lines.sparkSession
    counts = lines.select(F.explode("words").alias("w")).groupBy(_bucket(F.col("w")).alias("bucket")).count()
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").select(
        "bucket", F.call_function("shiftleft", F.floor(
            512 * F.log2(F.coalesce("count", F.lit(0)) + 1)).cast("long"), F.lit(48)).alias("n"))
    return counts.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "n"))),
                                  lambda x: x["n"]).alias("ranks"))


def _need(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.ceil(percent * (n_a + n_b) / (100 + percent))


def _prefix_length(n: Column, percent: int) -> Column:
    return (n - F.ceil(percent * n / 100) + 1).cast("int")


def _bits(ids: DataFrame, column: str) -> DataFrame:
    """A Bloom filter of fixed size as one row with an array of 64-bit words."""
    spark = ids.sparkSession
    h = F.xxhash64(column)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    words = ids.select(F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS)).cast("int").alias("word"),
                       bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = spark.range(FILTER_WORDS).select(F.col("id").cast("int").alias("word"))
    full = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))),
                                lambda x: x["bits"]).alias("words"))


def _maybe(column: str, bits: Column) -> Column:
    h = F.xxhash64(column)
    word = F.get(bits, F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS)).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    return word.bitwiseAND(bit) != 0


def _may_link(x: str, y: str, percent: int, first: bool) -> Column:
    """Length, position and parity filter of two lines that share a token.

    ``entry`` holds the token, the number of tokens and the token's place (see
    ``_later``).  What precedes the token in one set and what follows it can only be shared with what
    precedes and follows it in the other.  With ``first`` the token is taken for the first one that
    they share, so nothing before it counts: two linked lines pass by the one token that is.
    A token of one set only changes one parity bit; two long lines are compared by twice
    as many bits.  Lines of ``MOST`` tokens or more pass.
    """
    n_x, n_y = (F.shiftright(f"{s}.entry", 16).bitwiseAND(MOST) for s in (x, y))
    i, j = (F.col(f"{s}.entry").bitwiseAND(MOST) for s in (x, y))
    need = _need(n_x, n_y, percent)
    low = F.col(f"{x}.low").bitwiseXOR(F.col(f"{y}.low"))
    high = F.col(f"{x}.high").bitwiseXOR(F.col(f"{y}.high"))
    apart = F.when((n_x >= WIDE) & (n_y >= WIDE), F.bit_count(high) + F.bit_count(low.bitwiseXOR(high))).otherwise(
        F.bit_count(low))
    fits = ((100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y))
            & ((F.lit(0) if first else F.least(i, j)) + F.least(n_x - i, n_y - j) >= need)
            & (apart <= n_x + n_y - 2 * need))
    return fits | (F.greatest(n_x, n_y) == MOST)


def _names(key: str, text: str) -> list[Column]:
    """Two hashes that name a row by its id and text."""
    of = (F.col(key).isNull(), F.col(key), F.col(text))
    return [F.xxhash64(*of).alias("doc"), F.xxhash64(F.lit(1), *of).alias("twin")]


def _lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``id, doc, twin, key, line_no, words`` of the lines with words; the words are distinct hashes."""
    lines = texts.select(*_names(key, text), F.col(key).alias("key"),
                         F.posexplode(F.split(_clean(F.col(text)), "\n")).alias("line_no", "line"))
    lines = lines.select(F.monotonically_increasing_id().alias("id"), "doc", "twin", "key", "line_no",
                         _set(F.col("line")).alias("words"))
    # Filtered after it is written: a filter here would compute every line twice.  The older
    # layout of lists without nulls has no group around each value and takes less time to write.
    with sql_conf(texts.sparkSession, "spark.sql.parquet.writeLegacyFormat", "true"):
        return cut_lineage(lines, "line-words", **WORD_FILES).where(F.size("words") > 0)


def _later(words: DataFrame, percent: int) -> DataFrame:
    """``(doc, twin, line_no)`` of the lines to remove."""
    spark = words.sparkSession
    ranks = cut_lineage(token_ranks(words), "ranks")
    lines = cut_lineage(_line(words, ranks, percent, "id", "doc", "twin", "key", "line_no"), "lines",
                        **LINE_FILES)

    # Lines with equal sets are one class, for which its first line stands.
    place = F.struct("key", "line_no", "id")
    repeated = lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    repeated = cut_lineage(repeated.where("times > 1").select("a", "b", "first"), "line-repeats")
    # Sets too small to match any but their equal need no tokens of their own.
    stand = lines.where(100 * F.col("n") >= percent * (F.col("n") + 1)).join(repeated, ["a", "b"], "left")
    # From here on an id is a class's place in the order of lines.
    stand = stand.where("first is null or first.id = id").orderBy("key", "line_no", "id")
    stand = cut_lineage(stand.select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("line"),
                                     "n", "low", "high", "prefix"), "line-classes", **LINE_FILES)

    def index(rows: DataFrame) -> DataFrame:
        """``entry, id, low, high`` of every prefix token; an entry is the token above 16 bits
        each of the number of tokens and the token's place."""
        rows = rows.select("id", "low", "high", "n", F.posexplode("prefix").alias("pos", "token"))
        entry = F.call_function("shiftleft", F.col("token").cast("long"), F.lit(32))
        for value, bits in (("n", 16), ("pos", 0)):
            part = F.least(F.col(value), F.lit(MOST)).cast("long")
            entry = entry.bitwiseOR(F.call_function("shiftleft", part, F.lit(bits)))
        return rows.select(entry.alias("entry"), "id", "low", "high")

    def token(side: str) -> Column:
        return F.shiftright(f"{side}.entry", 32)

    def paired(pairs_of) -> DataFrame:
        """Distinct pairs of all parts of the tokens; ``pairs_of`` gives those of one."""
        with own_cuts(spark) as keep:
            parts = [cut_lineage(pairs_of(F.pmod(F.shiftright("entry", 33), F.lit(PASSES)) == k).distinct(),
                                 "line-parts") for k in range(PASSES)]
            return keep(cut_lineage(reduce(DataFrame.union, parts).distinct(), "line-pairs"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Later lines ``x`` of written pairs ``(x, y)`` that link, by whole token sets."""
        with own_cuts(spark) as keep:
            ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
            wanted = cut_lineage(stand.select("id", "line").join(ids, "id"), "line-wanted")
            bits = cut_lineage(_bits(wanted, "line"), "line-bits").scalar()
            sets = words.select(F.col("id").alias("line"), "words").where(_maybe("line", bits)).join(wanted, "line")
            both = (pairs.join(sets.select(F.col("id").alias("x"), F.col("words").alias("t_x")), "x")
                    .join(sets.select(F.col("id").alias("y"), F.col("words").alias("t_y")), "y")
                    .withColumn("common", F.size(F.array_intersect("t_x", "t_y"))))
            total = F.size("t_x") + F.size("t_y") - F.col("common")
            linked = both.where(100 * F.col("common") >= percent * total)
            return keep(cut_lineage(linked.select(F.col("x").alias("id")).distinct(), "line-later"))

    # First against the earliest line of each token, which most of a family match; of a
    # family only lines far from it are left.  This only saves work, so a part of the
    # tokens will do.
    def tried(part: Column) -> DataFrame:
        some = index(stand).where((F.pmod(F.shiftright("entry", 32), F.lit(EARLY_SHARE)) == 0) & part)
        hubs = some.groupBy(F.shiftright("entry", 32).alias("token")).agg(
            F.count(F.lit(1)).alias("df"), F.min(F.struct("id", "entry", "low", "high")).alias("hub"))
        hubs = hubs.where("df > 1").select("hub.*")
        pairs = some.alias("x").join(hubs.alias("y"), (token("x") == token("y")) & (F.col("x.id") > F.col("y.id"))
                                     & _may_link("x", "y", percent, first=False))
        return pairs.select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))

    early = verified(paired(tried))

    # Then all others.  Of two linked lines the shorter one has a shared token among its
    # first n - ceil(2 t n / (1 + t)) + 1, the longer one in its prefix.  A later line that
    # goes already needs no more: the sign of its id says so.
    marked = stand.join(early.withColumn("early", F.lit(True)), "id", "left").withColumn(
        "id", F.when(F.col("early"), -1 - F.col("id")).otherwise(F.col("id")))
    marked = cut_lineage(marked.drop("line"), "line-marked", **LINE_FILES)
    n = F.shiftright("entry", 16).bitwiseAND(MOST)
    n_x, n_y = (F.shiftright(f"{s}.entry", 16).bitwiseAND(MOST) for s in ("x", "y"))
    x, y = (F.when(F.col(c) < 0, -1 - F.col(c)).otherwise(F.col(c)) for c in ("x.id", "y.id"))

    def left(part: Column) -> DataFrame:
        rows = index(marked).where(part)
        short = rows.where(
            (F.col("entry").bitwiseAND(MOST) <= n - F.ceil(2 * percent * n / (100 + percent))) | (n == MOST))
        pairs = short.alias("x").join(rows.alias("y"), (token("x") == token("y")) & (
            (n_x < n_y) | ((n_x == n_y) & (F.col("x.id") < F.col("y.id"))))
            & (F.when(x > y, F.col("x.id")).otherwise(F.col("y.id")) >= 0) & _may_link("x", "y", percent, first=True))
        return pairs.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y"))

    pairs = paired(left)
    # A line goes with its first match, so each one's earliest is looked at before the others.
    best = pairs.groupBy("x").agg(F.min("y").alias("y"))
    soon = verified(cut_lineage(best, "line-pairs"))
    rest = pairs.join(soon.withColumnRenamed("id", "x"), "x", "left_anti")
    later = verified(cut_lineage(rest.join(best, ["x", "y"], "left_anti"), "line-pairs")).union(soon).union(early)
    matched = cut_lineage(lines.select(F.col("id").alias("line"), "a", "b").join(
        stand.select("id", "line").join(later, "id"), "line").select("a", "b"), "line-matched")
    judged = matched.withColumn("matched", F.lit(True)).join(repeated, ["a", "b"], "full")
    gone = lines.select("doc", "twin", "key", "line_no", "a", "b").join(judged, ["a", "b"])
    return gone.where(F.col("matched").isNotNull()
                      | (F.struct("key", "line_no") != F.col("first").dropFields("id"))
                      ).select("doc", "twin", "line_no")


def mark_later_lines(texts: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts with the numbers of their lines that an earlier line matches.

    ``texts`` are texts to scrub, or scrubbed ones, ``(doc_id, text)``.  A line's set
    is its distinct lower-cased words; a line without words takes no part.  Lines are
    ordered by ``doc_id`` and number; one is marked if any earlier one has ``100 *
    |intersection| >= percent * |union|``, whether or not that one is marked, too.

    Lines with equal sets are one class, which stands where its first line stands.
    Tokens are ordered rare first by word counts over all texts (summed up in hash
    buckets; ties by hash).  Linked classes share one of the first ``n - ceil(t n) +
    1`` tokens; pairs are filtered by length, positions and parity bits, and
    verified on whole sets.

    Returns the rows of ``texts``, all columns, with ``n_lines`` and ``later_lines``,
    line numbers from 0 (they replace columns of these names).  A null text is one
    empty line; a null id comes first; rows with equal ids are one text for the order:
    equal lines at equal numbers of them count as the same line, of different ones either
    may come first.  An empty table gives no rows.  Native expressions only.
    Texts are shuffled only if they may hold a marked line.
    """
    names = [c for c in texts.columns if c not in ("n_lines", "later_lines")]
    with own_cuts(texts.sparkSession) as keep:
        gone = _later(_lines(texts.select(key, text), key, text), percent)
        per_text = keep(cut_lineage(gone.groupBy("doc", "twin").agg(
            F.sort_array(F.collect_set("line_no")).alias("_gone")).toDF("_doc", "_twin", "_gone"), "gone"))
    doc, twin = _names(key, text)
    n_lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n_lines")
    texts = texts.select(*names, doc.alias("_h"), twin.alias("_h2"))
    maybe = _maybe("_h", cut_lineage(_bits(per_text, "_doc"), "gone-bits").scalar())
    none = F.array().cast("array<int>")
    rest = texts.where(~maybe).select(*names, n_lines, none.alias("later_lines"))
    hit = texts.where(maybe).join(per_text, (F.col("_h") == F.col("_doc")) & (F.col("_h2") == F.col("_twin")), "left")
    return rest.unionByName(hit.select(*names, n_lines, F.coalesce("_gone", none).alias("later_lines")))


def remove_later_lines(texts: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts without the lines that an earlier line matches (see :func:`mark_later_lines`).

    Returns the rows of ``texts``, all columns, with ``text`` rewritten where lines
    went, and ``n_removed`` (it replaces a column of that name).  A null text stays
    null.
    """
    names = [c for c in texts.columns if c != "n_removed"]
    # Own columns of the marks' names are carried along under other ones.
    held = {"n_lines": "_own_lines", "later_lines": "_own_later"}
    marked = mark_later_lines(texts.select(*[F.col(c).alias(held.get(c, c)) for c in names]), percent, key, text)
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), "later_lines")
    all_lines = F.split(text, "\n")
    left = F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")
    n = F.size("later_lines")
    return marked.select(
        *[(F.when(n > 0, left).otherwise(F.col(text)) if c == text else F.col(held.get(c, c))).alias(c) for c in names],
        n.alias("n_removed"))
