"""Readers: delimited tables, FASTA, GTF, annotator output, index metadata, symbol lists, documents."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerant.config import EVENT_COLUMNS, NULL_TOKENS, TEXT_COLUMNS
from chimerant.functions.text import nulls, unversioned
from chimerant.sources.matrix import read_vectors

GTF_SCHEMA = "chr string, source string, feature_type string, start string, end string, score string, strand string, frame string, attributes string"
ANNOTATOR_SCHEMA = ", ".join(f"c{i} string" for i in range(1, 16))


def snake(name: str) -> str:
    """Header in snake case: `Gene1` to gene1, `FusionStrand1` to fusion_strand1, `5P_UTR` to 5_p_utr."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", re.sub(r"[-\s]", "_", name.strip())).lower()


def separator_of(line: str) -> str:
    """Tab if it occurs at least as often as the comma."""
    return "\t" if line.count("\t") >= line.count(",") else ","


def sniff(lines: list[str]) -> str:
    """Of tab, comma and semicolon the one that cuts most lines into the same number of parts, more than one."""
    def score(sep: str) -> tuple[int, int]:
        counts = [line.count(sep) for line in lines if line.strip()]
        usual = max(set(counts), key=counts.count, default=0)
        return (counts.count(usual) if usual else 0, usual)

    return max(["\t", ",", ";"], key=score)


def resolve(path: str, folder: str = "input") -> str:
    """A path as given, or below the input folder."""
    return path if "://" in path or Path(path).exists() else f"{folder}/{path}"


def require(df: DataFrame, names: list[str]) -> DataFrame:
    if lost := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def read_strings(spark: SparkSession, path: str, sep: str = "\t", tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """A delimited table with every column as text; null tokens become null."""
    df = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("inferSchema", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return df.select(*(nulls(F.col(f"`{c}`"), tokens).alias(c) for c in df.columns))


def inferred(df: DataFrame, keep: list[str] = TEXT_COLUMNS) -> DataFrame:
    """Text columns of which every value is an integer, else a number, else true or false, as such: told by one pass over all rows.

    Columns without values, and those in `keep`, stay text."""
    texts = [c for c, kind in df.dtypes if kind == "string" and c not in keep]
    if not texts:
        return df
    kinds = ["bigint", "double", "boolean"]
    fits = lambda c, kind: F.col(f"`{c}`").rlike(r"^(?i:true|false)$") if kind == "boolean" else F.col(f"`{c}`").try_cast(kind).isNotNull() & ~F.col(f"`{c}`").rlike(r"^\s|\s$|[dDfFlL]$")
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(texts)), *(F.count_if(fits(c, k)).alias(f"{k}{i}") for i, c in enumerate(texts) for k in kinds)).first()
    chosen = {c: next((k for k in kinds if counts[f"n{i}"] and counts[f"{k}{i}"] == counts[f"n{i}"]), None) for i, c in enumerate(texts)}
    return df.select(*(F.col(f"`{c}`").try_cast(chosen[c]).alias(c) if chosen.get(c) else F.col(f"`{c}`") for c in df.columns))


def load_table(spark: SparkSession, path: str, required: list[str] | None = None, integers: tuple[str, ...] = ("id", "breakpoint1", "breakpoint2", "start", "end"), infer: bool = False) -> DataFrame:
    """A delimited table: separator from the first line (and the other one if that gives a single column), headers in
    snake case, null tokens, named integer columns, chromosomes as text. infer: all other columns by their values."""
    first = spark.read.text(path).first()
    sep = separator_of(first[0] if first else "")
    df = read_strings(spark, path, sep)
    if len(df.columns) == 1:
        df = read_strings(spark, path, "," if sep == "\t" else "\t")
    df = df.toDF(*map(snake, df.columns))
    df = df.withColumns({c: F.col(c).try_cast("bigint") for c in integers if c in df.columns and c not in TEXT_COLUMNS})
    return require(inferred(df) if infer else df, required or [])


def load_events(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, EVENT_COLUMNS)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence) of each record; gzip is read as it is. A record begins with `>` at the start of a line, which headers may hold too.

    Only a file's first record keeps its mark when lines are cut in front of the others'; blank lines before it go."""
    records = spark.read.option("lineSep", "\n>").text(path)
    first = F.regexp_replace("value", r"^\s*>", "")
    parts = F.split(first, r"\r?\n", 2)
    rows = records.filter(F.trim("value", F.lit(" \r\n\t")) != "")
    return rows.select(F.regexp_replace(parts[0], r"^\s+|\s+$", "").alias("header"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"))


def with_id(fasta: DataFrame, out: str = "protein_id") -> DataFrame:
    """The header's first word without its version as id."""
    return fasta.withColumn(out, unversioned(F.split("header", r"\s+")[0]))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Features with integer coordinates and their ids and tags; comments and lines of other than nine fields go."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(GTF_SCHEMA).csv(path)
    attribute = lambda key: F.nullif(unversioned(F.regexp_extract("attributes", f'(?:^|[; ]){key} "([^"]*)"', 1)), F.lit(""))
    rows = raw.filter("attributes IS NOT NULL").withColumns({"start": F.col("start").try_cast("bigint"), "end": F.col("end").try_cast("bigint")}).filter("start IS NOT NULL AND end IS NOT NULL")
    return rows.select(attribute("transcript_id").alias("transcript_id"), attribute("gene_id").alias("gene_id"), "feature_type", "strand", "chr", "start", "end", F.regexp_extract_all("attributes", F.lit(r'(?:^|[; ])tag "([^"]*)"'), 1).alias("tags"))


def read_annotator(spark: SparkSession, path: str) -> DataFrame:
    """(query, accession, name) from columns 1, 12 and 13 of an annotator's output."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(ANNOTATOR_SCHEMA).csv(path)
    return raw.select(F.trim("c1").alias("query"), F.trim("c12").alias("accession"), F.trim("c13").alias("name")).filter("coalesce(query, '') <> '' AND coalesce(accession, '') <> ''")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Merged hits, with `.` and `-` as null too, integer bounds."""
    df = read_strings(spark, path, "\t", ["", ".", "-"])
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in ("start", "end", "feat_len") if c in df.columns})


def read_index_metadata(spark: SparkSession, path: str, windows: DataFrame | None = None) -> DataFrame:
    """(pos, window_id, ipr_id, ipr_name) of each vector of an index, in index order.

    An object with a list `windows` takes its domains from the windows table (the last row of an id counts); a list of
    objects has its own, under one of several names. Items that are no objects keep their place, without a domain."""
    text = spark.read.option("wholetext", True).text(path)
    listed = text.filter(F.ltrim("value").startswith("["))
    keys = "window_id string, ipr_id string, IPR string, ipr string, signature_accession string, ipr_name string, name string, ipr_desc string"
    items = listed.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "raw")).withColumn("o", F.from_json(F.when(F.ltrim("raw").startswith("{"), F.col("raw")), keys.replace("IPR string, ", "IPR_ string, ")))
    upper = F.get_json_object("raw", "$.IPR")
    own = items.select("pos", F.col("o.window_id").alias("window_id"), F.coalesce("o.ipr_id", upper, "o.ipr", "o.signature_accession", F.lit(".")).alias("ipr_id"), F.coalesce("o.ipr_name", "o.name", "o.ipr_desc", F.lit("")).alias("ipr_name"))
    if windows is None:
        return own
    entries = text.filter(F.ltrim("value").startswith("{")).select(F.posexplode(F.from_json(F.get_json_object("value", "$.windows"), "array<string>")).alias("pos", "window_id"))
    last = windows.withColumn("_m", F.monotonically_increasing_id()).groupBy("window_id").agg(F.max_by("ipr_id", "_m").alias("ipr_id"), F.max_by("ipr_name", "_m").alias("ipr_name"))
    joined = entries.join(last, "window_id", "left").select("pos", "window_id", F.coalesce("ipr_id", F.lit(".")).alias("ipr_id"), F.coalesce("ipr_name", F.lit("")).alias("ipr_name"))
    return own.unionByName(joined)


def load_index(spark: SparkSession, vectors: str, metadata: str, windows: DataFrame | None = None) -> DataFrame:
    """(pos, window_id, ipr_id, ipr_name, vec): the vectors of a matrix or flat index with their metadata, JSON or a Parquet table."""
    named = read_index_metadata(spark, metadata, windows) if metadata.endswith(".json") else spark.read.parquet(metadata).select("pos", "window_id", "ipr_id", "ipr_name")
    return named.join(read_vectors(spark, vectors), "pos")


PAGE_METRICS = [f"{m}_{k}{s}" for s in (1, 2) for m, k in (("mean", "retained"), ("mean", "lost"), ("median", "retained"), ("median", "lost"))]
PAGE_RECORD = ", ".join(["gene1 string, gene2 string, transcript_id1 string, transcript_id2 string, chr1 string, chr2 string, breakpoint1 bigint, breakpoint2 bigint, max_height bigint, strand1 string, strand2 string", *(f"{c} double" for c in [*PAGE_METRICS, "coverage1", "coverage2"])])


def read_page_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Coverage of pages from JSON lists of records, once each, with the eight keys that events join on.

    Records may hold names twice, in other case; those in lower case count."""
    rows = spark.read.option("multiLine", True).schema(PAGE_RECORD).json(path)
    return rows.withColumnsRenamed({"chr1": "chromosome1", "chr2": "chromosome2"}).distinct()


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("symbol")).filter("symbol <> ''").distinct()


def list_documents(spark: SparkSession, folder: str, suffix: str = "pdf", batch: int | None = None, size: int = 20) -> DataFrame:
    """Files of a folder with their bytes, in order of path; batch i (from 1) holds `size` of them.

    Only paths, not contents, are ordered for the slice."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder)
    if batch is None:
        return files
    from chimerant.operators.ranges import numbered

    chosen = numbered(files.select("path"), ["path"], "n").filter(F.col("n").between((batch - 1) * size + 1, batch * size)).select("path")
    return files.join(chosen, "path", "left_semi")


def page_fields(text: DataFrame, symbols: DataFrame, column: str = "text") -> DataFrame:
    """Metadata of a plot page from its text: the first two transcripts, known genes and positions, and the largest height.

    As in the published runs, a missing first value moves the second into its place. `text` has page_id and the text."""
    t = F.col(column)
    transcripts = F.regexp_extract_all(t, F.lit(r"(ENST\d+)"), 1)
    places = F.regexp_extract_all(t, F.lit(r"((?:chr)?(?:\d{1,2}|X|Y|MT?):\d+)"), 1)
    fifth = F.get(F.split(t, "\n"), F.lit(4))
    genes = text.select("page_id", F.posexplode(F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9][A-Za-z0-9.-]*)"), 1)).alias("pos", "g")).join(symbols, F.upper("g") == F.col("symbol"), "left_semi")
    genes = genes.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "g"))), lambda x: x["g"]).alias("genes"))
    place = lambda i, j: F.get(F.split(F.get(places, F.lit(i)), ":"), F.lit(j))
    out = text.join(genes, "page_id", "left")
    return out.select(
        "page_id", *(F.get("genes", F.lit(i)).alias(f"gene{i + 1}") for i in (0, 1)), *(F.get(transcripts, F.lit(i)).alias(f"transcript_id{i + 1}") for i in (0, 1)),
        *(F.regexp_replace(place(i, 0), "^chr", "").alias(f"chromosome{i + 1}") for i in (0, 1)), *(place(i, 1).try_cast("bigint").alias(f"breakpoint{i + 1}") for i in (0, 1)),
        F.nullif(F.regexp_extract(fifth, r"(\d+)", 1), F.lit("")).try_cast("int").alias("max_height"),
    )
