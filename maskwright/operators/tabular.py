"""Table detection by header: inside a text, or over a real Spark table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.hashing import let
from ..functions.text import csv_fields, text_lines, trim_spaces
from ..storage import cut_lineage
from .bind import bind_values, first_seen
from .detect import detect_hits
from .rewrite import make_pairs, rewrite

HOT_SHARE = 1 / 4_096
CELL_TYPE = "array<struct<text:string,kind:string>>"


def classify_header(header: Column) -> Column:
    """Column kind of a header: person, organization, location, identifier or skip."""

    def decide(h: Column) -> Column:
        out = None
        for kind, how, needles in fv.HEADER_RULES:
            if how == "equals":
                hit = h.isin(needles)
            elif how == "ends":
                hit = F.lit(False)
                for needle in needles:
                    hit = hit | h.endswith(needle)
            else:
                hit = F.lit(False)
                for needle in needles:
                    hit = hit | h.contains(needle)
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
        return out.otherwise("skip")

    spaced = F.translate(F.lower(header), "_-", "  ")
    return let(trim_spaces(spaced), decide)


def column_pii_kind(kind: Column) -> Column:
    """Contextual kind that the values of a column are bound by; null for skip."""
    out = F.lit(None).cast("string")
    for name, pii in fv.COLUMN_KIND_TO_PII.items():
        out = F.when(kind == name, pii).otherwise(out)
    return out


def csv_cells(lines: Column, kinds: Column) -> Column:
    """PII cells of data lines, row by row, given the kinds of the columns."""

    def row_cells(line: Column) -> Column:
        cells = F.transform(
            csv_fields(line),
            lambda v, i: F.struct(
                trim_spaces(v).alias("text"), column_pii_kind(F.get(kinds, i)).alias("kind")
            ),
        )
        return F.filter(
            cells,
            lambda c: c["kind"].isNotNull() & (F.length(c["text"]) >= fv.CSV_MIN_VALUE_CHARS),
        )

    return F.flatten(F.transform(lines, row_cells))


def csv_text_cells(text: Column) -> Column:
    """PII cells of a text that is a table, as ``CELL_TYPE`` in reading order."""

    def body(lines: Column) -> Column:
        kinds = F.transform(csv_fields(F.get(lines, F.lit(0))), classify_header)
        return let(
            kinds,
            lambda k: F.when(
                F.exists(k, lambda kind: kind != "skip"),
                csv_cells(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), k),
            ).otherwise(F.array().cast(CELL_TYPE)),
        )

    lines = F.filter(text_lines(text), lambda l: trim_spaces(l) != "")
    return F.coalesce(let(lines, body), F.array().cast(CELL_TYPE))


def classify_columns(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Kind of every string or integral column of a table, by its name.

    Runs the header rules once over the column names (schema, not data).
    """
    names = df.columns
    spark = df.sparkSession
    headers = spark.range(1).select(
        F.posexplode(F.array(*(F.lit(n) for n in names))).alias("i", "name")
    )
    rows = headers.select("name", classify_header(F.col("name")).alias("kind")).collect()
    kinds = {r["name"]: r["kind"] for r in rows}
    kinds.update(overrides or {})
    return kinds


def table_values(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Distinct values of the PII columns as ``(scope, real, kind, ord)``.

    A table has no row order, so values are served by column, then by text.
    Each column aggregates on the map side before the shuffle.
    """
    columns = [c for c in df.columns if kinds.get(c, "skip") != "skip"]
    if not columns:
        raise ValueError("no column of this table holds personal data")
    pairs = F.array(*(
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(fv.COLUMN_KIND_TO_PII[kinds[c]]).alias("kind"),
            trim_spaces(F.col(c).cast("string")).alias("real"),
        )
        for i, c in enumerate(columns)
    ))
    cells = df.select(F.explode(pairs).alias("c")).select("c.*")
    cells = cells.where(F.length("real") >= fv.CSV_MIN_VALUE_CHARS)
    cells = cells.withColumn("scope", F.lit("table"))
    return first_seen(cells, "scope", "real", "kind", F.col("ord"))


def _scanned(df: DataFrame, kinds: dict[str, str], scan: list[str] | None) -> list[str]:
    """Columns that are searched for identifiers: those named, or all other string columns."""
    if scan is not None:
        return [c for c in scan if kinds.get(c, "skip") == "skip"]
    return [c for c, t in df.dtypes if t == "string" and kinds.get(c, "skip") == "skip"]


def _found_in_rows(df: DataFrame, columns: list[str], kinds: dict[str, str], scanned: list[str]) -> Column:
    """What a row needs replacements for: ``array<struct<real, kind, step, place>>``.

    Identifiers come first (step 0), in columns of personal data, too, then whole cells.
    """
    def entry(real: Column, kind: Column, step: int, place: int) -> Column:
        return F.struct(real.alias("real"), kind.alias("kind"), F.lit(step).alias("step"), F.lit(place).alias("place"))

    def hits(text: Column, place: int) -> Column:
        return F.transform(detect_hits(text), lambda h: entry(h["value"], h["kind"], 0, place))

    parts = []
    for i, c in enumerate(df.columns):
        text = F.col(c).cast("string")
        if c in columns or c in scanned:
            parts.append(hits(text, i))
        if c in columns:
            cell = entry(trim_spaces(text), F.lit(fv.COLUMN_KIND_TO_PII[kinds[c]]), 1, i)
            parts.append(F.filter(F.array(cell), lambda x: F.length(x["real"]) >= fv.CSV_MIN_VALUE_CHARS))
    empty = F.array().cast("array<struct<real:string,kind:string,step:int,place:int>>")
    return F.concat(empty, *[F.coalesce(p, empty) for p in parts])


def _fakes_by_row(needs: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(_row, _fakes)``: the map of each row, for distinct ``(_row, real)``.

    Values of more than ``HOT_SHARE`` of all entries, at most ``1 / HOT_SHARE`` of them, are
    handed to all tasks with their fakes; the others, none of them hot, are
    joined in one shuffle for all columns.
    """
    counts = needs.groupBy("real").agg(F.count(F.lit(1)).alias("n"))
    total = needs.count()
    hot = mapping.select("real", "fake").join(
        counts.where(F.col("n") > int(HOT_SHARE * total)).select("real"), "real", "left_semi")
    hot = F.broadcast(cut_lineage(hot.withColumnRenamed("fake", "_hot"), "hot-values"))
    seen = needs.join(hot, "real", "left")
    rest = seen.where("_hot is null").select("_row", "real").join(mapping.select("real", "fake"), "real")
    pairs = seen.where("_hot is not null").select("_row", "real", F.col("_hot").alias("fake")).unionByName(rest)
    return pairs.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("real", "fake"))).alias("_fakes"))


def scrub_table(
    df: DataFrame,
    overrides: dict[str, str] | None = None,
    existing: DataFrame | None = None,
    scan: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Replace personal data in all columns of a table.

    Cells of columns that the header rules name are replaced whole.  All other string
    columns, or those that ``scan`` names, are searched for identifiers, which are
    replaced where they stand; an identifier found by a pattern keeps the
    pattern's kind, also where it is a whole cell.

    Returns the scrubbed table (same columns; changed ones become strings) and
    the mapping ``(scope, real, fake, kind)``.  Null cells stay null; equal values share
    a replacement in all columns; a table without personal data comes back as it is.
    The table is written once with row numbers and joined once with the maps of its
    rows, however many columns there are.
    """
    kinds = classify_columns(df, overrides)
    columns = [c for c in df.columns if kinds.get(c, "skip") != "skip"]
    scanned = _scanned(df, kinds, scan)
    rows = df.withColumn("_found", _found_in_rows(df, columns, kinds, scanned))
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()), "table-rows")
    found = rows.select("_row", F.explode("_found").alias("_f")).select("_row", "_f.*").withColumn(
        "scope", F.lit("table"))
    firsts = first_seen(found, "scope", "real", "kind", F.struct("step", "place"))
    # The map is used for hot and for other values: it is bound once and written.
    mapping = cut_lineage(bind_values(firsts, existing), "mapping")
    known = mapping.select("real", "fake")
    if existing is not None:
        old = existing.where("scope = 'table'").select("real", "fake")
        known = known.unionByName(old.join(known, "real", "left_anti"))
    needs = rows.select("_row", F.explode(F.array_distinct(F.transform("_found", lambda f: f["real"]))).alias("real"))
    out = rows.join(_fakes_by_row(needs, known), "_row", "left")

    def new(name: str) -> Column:
        text = F.col(name).cast("string")
        if name in columns:
            key = trim_spaces(text)
            put = F.element_at("_fakes", key)
            return F.when(put.isNull(), text).otherwise(F.replace(text, key, put))
        place = df.columns.index(name)
        hits = F.filter("_found", lambda f: (f["place"] == place) & F.map_contains_key("_fakes", f["real"]))
        pairs = make_pairs(F.transform(hits, lambda f: f["real"]),
                           F.transform(hits, lambda f: F.element_at("_fakes", f["real"])))
        return F.when(F.size(hits) > 0, rewrite(text, pairs)).otherwise(text)

    changed = [new(c).alias(c) if c in columns or c in scanned else F.col(c) for c in df.columns]
    return out.select(*changed), mapping.select("scope", "real", "fake", "kind")
