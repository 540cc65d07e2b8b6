"""Mail ingest.

Files in a folder may differ in header. Their records are landed by place in few
jobs, their headers become a table of one row a file, and decisions that depend on
the header (which text columns, which label rule) are expressions over the two.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.functions import labels as L
from riskline.functions.text import clean_basic, is_blank
from riskline.session import scratch_path

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for right results).
TEXT_CANDIDATES = ["subject", "body", "sender", "urls", "receiver", "text", "text_combined",
                   "email", "content", "message", "Email Text"]
LABEL_COLUMN = "label"
EMAIL_TYPE_COLUMN = "Email Type"
EMAIL_TEXT_COLUMN = "Email Text"
EXCLUDED_FILES = ["emails.csv"]
CSV_SUFFIX = ".csv"
# ---------------------------------------------------------------------------


def _csv_reader(spark: SparkSession):
    return (spark.read.option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("inferSchema", False)
            .option("mode", "PERMISSIVE"))


def read_mail_csv(spark: SparkSession, path, na_values: bool = True) -> DataFrame:
    """A1: one CSV (or several with the same header) with header; every column a string.

    Quoted fields may hold newlines and doubled quotes. The pandas missing
    spellings (``NA``, ``None``, ``null``, ...) become null when ``na_values``.
    A multi-line CSV cannot be split inside a file, so large inputs should be
    landed to parquet once (``land``) and read from there.
    """
    df = _csv_reader(spark).csv(path)
    if na_values:
        df = df.select(*(L.na_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns))
    return df


def valid_text(df: DataFrame, col: str = EMAIL_TEXT_COLUMN) -> DataFrame:
    """Drop rows whose text is null."""
    return df.where(F.col(f"`{col}`").isNotNull())


def find_text_columns(columns) -> list[str]:
    """Candidate text columns present, in the fixed candidate order."""
    present = set(columns)
    return [c for c in TEXT_CANDIDATES if c in present]


def build_text(df: DataFrame, out: str = "text") -> DataFrame:
    """Clean each candidate (E1), join with one space keeping empty parts, strip.

    ``concat_ws`` drops nulls but keeps '', and E1 maps null to '', so
    ('A', null, 'B') gives 'a  b'. An existing ``text`` column is both input
    and output. No candidate column -> ValueError.
    """
    cols = find_text_columns(df.columns)
    if not cols:
        raise ValueError(f"no known text column among {df.columns}")
    joined = F.trim(F.concat_ws(" ", *(clean_basic(F.col(f"`{c}`")) for c in cols)))
    return df.withColumn(out, joined)


def label_rule(columns, file_name: str) -> tuple[str, str | None] | None:
    """Which label source a file uses, decided per file (not per row).

    Returns ('column', name) for an existing label / Email Type column,
    ('source', None) for the file-name rule, or None when the file is skipped.
    """
    if LABEL_COLUMN in columns:
        return ("column", LABEL_COLUMN)
    if EMAIL_TYPE_COLUMN in columns:
        return ("column", EMAIL_TYPE_COLUMN)
    if L.source_rule(file_name) is not None:
        return ("source", None)
    return None


def list_csv_files(spark: SparkSession, folder: str, exclude=EXCLUDED_FILES) -> list[tuple[str, str]]:
    """A2/A3: top-level names ending in '.csv' (case-sensitive), sorted, minus ``exclude``.

    Returns (name, qualified path) pairs; works on any Hadoop file system. A CSV that Spark
    wrote is a folder of that name: each of its ``part-`` files is a pair of its own.
    """
    fs, p = _file_system(spark, folder)
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.endswith(CSV_SUFFIX) and name not in exclude:
            files = [st] if st.isFile() else [x for x in fs.listStatus(st.getPath())
                                              if x.isFile() and x.getPath().getName().startswith("part-")]
            out += [(name, x.getPath().toString()) for x in files]
    return sorted(out)


def _file_system(spark: SparkSession, folder: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Most columns a mail CSV may have.
MAX_COLUMNS = 64
#: The cells of a record by place; one more than allowed, to notice it.
CELLS = [f"c{i}" for i in range(MAX_COLUMNS + 1)]
CELL_SCHEMA = ", ".join(f"{n} string" for n in CELLS)

_QUOTED = re.compile(rb'[^"]*(?:""[^"]*)*').match
_CLOSED = re.compile(rb'"[\x00-\x20]*(,|$)').match


def open_after(line: bytes, quoted: bool) -> bool:
    """Whether a quoted field is open behind a line that begins inside one (``quoted``) or at a record's start.

    The CSV reader's rules: a quote opens a field only as its first byte, doubled quotes are
    text, a quote followed by other text than blanks gives an unquoted field.
    """
    at = 0
    if b'"' not in line:
        return quoted
    while True:
        if not quoted and line[at:at + 1] == b'"':
            quoted, at = True, at + 1
        if quoted:
            at = _QUOTED(line, at).end()
            if at == len(line):
                return True
            closed = _CLOSED(line, at)
            quoted, at = False, closed.start(1) if closed else at + 1
        at = line.find(b",", at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, line): the lines of the files, split by ranges of bytes; ``block`` is where a range begins.

    A task reads the lines of a range in the file's order.
    """
    return (spark.read.option("lineSep", "\n").text(paths)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").cast("binary").alias("line")))


def _by_block(batches):
    """((file, block), place of the line, line, other columns) of every line.

    A place lies between the range's and the line's first byte: ascending and unique within a file.
    """
    key = place = None
    for b in batches:
        more = [c.to_pylist() for c in b.columns[3:]]
        for k, *row in zip(zip(b.column("file").to_pylist(), b.column("block").to_pylist()),
                           b.column("line").to_pylist(), *more):
            if k != key:
                key, place = k, k[1] + (k[1] > 0)
            yield k, place, row[0], row[1:]
            place += len(row[0]) + 1


BLOCK_ENDS = "file string, block long, plain boolean, open boolean, last long, open_if boolean, last_if long"


def _block_ends(batches):
    """What a range does: whether a field is open behind it and where its last record begins, if it begins
    at a record's start, and if (``_if``) it begins inside a quoted field."""
    def row():
        return pa.RecordBatch.from_pylist([dict(zip(names, (*key, plain, *ends[0], *ends[1])))], schema)

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("plain", pa.bool_()), ("open", pa.bool_()),
                        ("last", pa.int64()), ("open_if", pa.bool_()), ("last_if", pa.int64())])
    names, key = schema.names, None
    for k, place, line, _ in _by_block(batches):
        if k != key:
            if key is not None:
                yield row()
            # the reader takes the first line end for that of the file, and knows two-byte encodings by their mark
            key, ends, plain = k, [(False, None), (True, None)], not (
                place == 0 and (b"\r" in line or line[:2] in (b"\xff\xfe", b"\xfe\xff")))
        plain = plain and b"\0" not in line
        for i, (quoted, last) in enumerate(ends):
            ends[i] = open_after(line, quoted), last if quoted or not line else place
    if key is not None:
        yield row()


def _block_starts(rows):
    """How each range of a file begins (inside a quoted field or not), and where the record begins that is open then."""
    rows = rows.sort_values("block")
    plain, quoted, owner, starts = bool(rows["plain"].all()), False, None, []
    for r in rows.itertuples():
        starts.append((plain, quoted, owner))
        end, last = (r.open_if, r.last_if) if quoted else (r.open, r.last)
        quoted, owner = end, owner if last is None or last != last else int(last)
    out = rows[["file", "block"]].copy()
    out["plain"], out["quoted"] = [p for p, _, _ in starts], [q for _, q, _ in starts]
    out["owner"] = [-1 if o is None else o for _, _, o in starts]
    return out


def _records(batches):
    """Records and, of those that begin or end in another range, the pieces: (file, id, place, whole, record).

    An empty cell is put behind a record, as the parser takes a quote before the end of its input for text.
    """
    def row():
        return key[0], owner, first, whole and not quoted, b"\n".join(held) + (b"" if quoted else b",")

    def batch():
        cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))]
        return pa.RecordBatch.from_arrays(cols, ["file", "id", "place", "whole", "record"])

    key, held, out, size = None, [], [], 0
    for k, place, line, (begins_quoted, begun) in _by_block(batches):
        if k != key:
            if held:
                out.append(row())
            key, held, quoted, owner, whole, first = k, [], begins_quoted, begun, False, place
        if not quoted:
            if not line:
                continue
            owner, whole, first = place, True, place
        held.append(line)
        quoted = open_after(line, quoted)
        if not quoted:
            out.append(row())
            size += len(out[-1][-1])
            held = []
        if size > 1 << 22 or len(out) > 10_000:
            yield batch()
            out, size = [], 0
    if held:
        out.append(row())
    if out:
        yield batch()


def _parsed(record: Column) -> Column:
    return F.from_csv(record, CELL_SCHEMA, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})


def _cells(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.when(F.col("parsed").isNotNull(), F.array(*[F.col("parsed")[n] for n in CELLS])).alias("cells"))


def land_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of CSV files by place, whatever their headers: (file, id, cells), written once to the shared folder.

    A fixed number of jobs for all files. Files are read by ranges of bytes, so that a file of any
    size is dealt over many tasks: a first pass tells of each range how it ends for either way it
    may begin, a few bytes a range; then each range's beginning is known, and a second pass cuts
    its records. Records over a range's end are put together from their pieces. Files whose lines
    do not end in ``\\n``, in a two-byte encoding or with NUL bytes are parsed from their start by
    one task a file. ``file`` is the scan's URI, ``id`` ascends within a file, so the header is the record
    of least id.
    """
    lines = _lines(spark, paths)
    ends = _written(lines.mapInArrow(_block_ends, BLOCK_ENDS), "mail-blocks")
    starts = _written(ends.groupBy("file").applyInPandas(
        _block_starts, "file string, block long, plain boolean, quoted boolean, owner long"), "mail-starts")
    plain = F.broadcast(starts.where("plain").drop("plain"))  # one row a range; a join that keeps the lines' order
    cut = (lines.join(plain, ["file", "block"]).select("file", "block", "line", "quoted", "owner")
           .mapInArrow(_records, "file string, id long, place long, whole boolean, record binary")
           .withColumn("record", F.col("record").cast("string"))
           .withColumn("parsed", F.when(F.col("whole"), _parsed(F.col("record"))))
           .withColumn("piece", F.when(~F.col("whole"), F.col("record"))))
    landed = _written(_cells(cut, "file", "id", "place", "piece"), "mail-rows")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"])
    joined = (landed.where("piece is not null").groupBy("file", "id").agg(F.array_join(pieces, "\n").alias("record"))
              .withColumn("parsed", _parsed(F.col("record"))))
    rows = landed.where("piece is null").select("file", "id", "cells").unionByName(_cells(joined, "file", "id"))
    other = {_plain_uri(r.file) for r in starts.where("not plain").select("file").distinct().collect()}
    if other:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        df = (_csv_reader(spark).option("header", False).schema(CELL_SCHEMA)
              .csv([p for p in paths if _plain_uri(path(p).toUri().toString()) in other])
              .select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"),
                      F.array(*CELLS).alias("cells")))
        rows = rows.unionByName(_written(df, "mail-other-rows"))
    return rows


def _plain_uri(uri: str) -> str:
    return re.sub("^file:/+", "file:/", uri)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def headers(rows: DataFrame, folder: str) -> DataFrame:
    """(file, header_id, header, source_file, rule) of every file, one row each; written once.

    ``source_file`` is the bare name in ``folder`` (A5), ``rule`` what its label comes from (C5): the
    name of a column, 'source' for the rule by file name, or null.
    """
    h = rows.groupBy("file").agg(F.min("id").alias("header_id"), F.min_by("cells", "id").alias("header"))
    fs, path = _file_system(rows.sparkSession, folder)
    above = sum(map(bool, fs.makeQualified(path).toUri().toString().split("/")))
    encoded = F.replace(F.get(F.filter(F.split("file", "/"), lambda c: c != ""), F.lit(above)), F.lit("+"), F.lit("%2B"))
    name = F.reflect(F.lit("java.net.URLDecoder"), F.lit("decode"), encoded, F.lit("UTF-8"))
    has = lambda c: F.array_contains("header", c)
    rule = (F.when(has(LABEL_COLUMN), F.lit(LABEL_COLUMN)).when(has(EMAIL_TYPE_COLUMN), F.lit(EMAIL_TYPE_COLUMN))
            .when(L.label_from_source("source_file").isNotNull(), F.lit(BY_SOURCE)))
    return _written(h.withColumn("source_file", name).withColumn("rule", rule), "mail-headers")


#: Rule of a file whose label comes from its name.
BY_SOURCE = "source"


def _cell(name: str) -> Column:
    """A row's cell under the header ``name`` (exact spelling; the first of equal names); null where there is none."""
    at = F.array_position("header", name)
    return L.na_to_null(F.when(at > 0, F.get("cells", (at - 1).cast("int"))))


def read_mail_dir(spark: SparkSession, folder: str, exclude=EXCLUDED_FILES) -> DataFrame:
    """A2-A5 + C5-C7 + J3: all usable CSVs of a folder as (text, label, source_file).

    The number of jobs does not depend on the number of files or headers: all records are
    landed by place (``land_rows``), the headers are a table of one row a file, and a cell
    is found through its file's header. Column names are compared exactly and never
    become columns here, so ``text`` and ``Text``, ``source_file`` or any other name may
    stand in a header. The label column's kind (numeric / boolean / string) is
    decided a file. Files without a record are passed over.
    """
    files = list_csv_files(spark, folder, exclude)
    if not files:
        raise FileNotFoundError(f"{folder} holds no CSV file to read")
    rows = land_rows(spark, [p for _, p in files])
    known = headers(rows, folder)
    text_names = F.array_intersect("header", F.array(*[F.lit(c) for c in TEXT_CANDIDATES]))
    wrong = known.where((F.size(text_names) == 0) | F.get("header", F.lit(MAX_COLUMNS)).isNotNull()).first()
    if wrong:
        names = [c for c in wrong["header"] if c is not None]
        raise ValueError(f"more than {MAX_COLUMNS} columns in {wrong['source_file']}" if len(names) > MAX_COLUMNS
                         else f"no known text column among {names}")
    known = known.where("rule is not null")
    if known.isEmpty():
        raise ValueError(f"no CSV file of {folder} has a label rule")
    d = rows.join(known, "file").where("id <> header_id")
    joined = F.concat_ws(" ", *(F.when(F.array_contains("header", c), clean_basic(_cell(c))) for c in TEXT_CANDIDATES))
    raw = F.when(F.col("rule") == LABEL_COLUMN, _cell(LABEL_COLUMN)).when(
        F.col("rule") == EMAIL_TYPE_COLUMN, _cell(EMAIL_TYPE_COLUMN))
    d = d.select(F.trim(joined).alias("text"), raw.alias("raw"), "rule", "source_file")
    kinds = d.where(F.col("rule") != BY_SOURCE).groupBy("source_file").agg(L.column_kind("raw").alias("kind"))
    d = d.join(_written(kinds, "mail-kinds"), "source_file", "left")  # one row a file
    label = F.when(F.col("rule") == BY_SOURCE, L.label_from_source("source_file")).otherwise(
        L.normalize_label("raw", F.col("kind")))
    return d.select("text", label.alias("label"), "source_file")


def drop_unusable(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """D2 + D3 + C9: drop null label or text, drop blank text, label as int."""
    return (df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
              .where(~is_blank(text_col))
              .withColumn(label_col, F.col(label_col).cast("int")))


def usable(text_col: str = "text", label_col: str = "label") -> Column:
    """Predicate form of D2 + D3 (for one-pass row counts, H1)."""
    return F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(is_blank(text_col), F.lit(True))


def land(df: DataFrame, path: str, partition_by: str | None = "source_file") -> str:
    """B1: write the combined dataset as parquet (partitioned by source)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path
