"""Match files, pair tables, function records, reports, source trees, ID headers and overrides."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symbridge.functions.scalars import clean_text, parse_decimal, parse_hex
from symbridge.operators.components import checkpointed
from symbridge.operators.lookups import dense_numbers, last_wins
from symbridge.sources.ordered_files import write_text

# The image base of the match files, the number of their header lines, and their name.
IMAGE_BASE = 0x140000000
HEADER_LINES = 18
MATCH_NAME = r"^(\d+)\.(\d+)\.(\d+)_(\d+)\.(\d+)\.(\d+)\.txt$"

REFERENCE = "array<struct<rva:bigint,name:string,segment:string,csv:array<struct<row:int,og_id:bigint,ae_id:bigint>>>>"
FUNCTION_RECORD = f"""
    kind string, row int, csv_name string, og_rva bigint, og_id bigint, ae_rva bigint, ae_id bigint, side string,
    function struct<status:string,requested_rva:bigint,start_rva:bigint,end_rva:bigint,size:bigint,raw_name:string,demangled_name:string,type:string,
        instruction_count:bigint,mnemonics:map<string,bigint>,instruction_shapes:map<string,bigint>,semantic_sha256:string,
        object_displacements:map<string,bigint>,stack_displacements:map<string,bigint>,chunk_count:bigint,
        basic_block_count:bigint,cfg_edge_count:bigint,cfg_back_edge_count:bigint,
        calls:{REFERENCE},jumps:{REFERENCE},data_refs:{REFERENCE},callers:{REFERENCE},incoming_data_refs:{REFERENCE},
        strings:array<struct<rva:bigint,text:string>>,message:string>
"""


def lines(files: DataFrame) -> DataFrame:
    """file, line (from 1) and text of whole files (file, value); a last line break ends the last line."""
    cut = F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n", -1))
    return files.select("file", cut.alias("line", "text")).withColumn("line", F.col("line") + 1)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file (its name), line (from 1) and text of text files, which are read in splits: the lines before a split are a sum over those before it (a row a split)."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    splits = raw.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = raw.join(splits.select("_file", "_block", (before - F.col("_first") + 1).alias("_shift")), ["_file", "_block"])
    return placed.select("file", (F.col("_at") + F.col("_shift")).alias("line"), F.regexp_replace("value", r"\r\z", "").alias("text"))


def match_files(spark: SparkSession, path: str) -> DataFrame:
    """lver, rver, lrva, rrva of the version-pair match files of a folder, each read by as many tasks as it has splits."""
    return _matches(numbered_lines(spark, path))


def match_pairs(files: DataFrame) -> DataFrame:
    """match_files() of whole files (file, value)."""
    return _matches(lines(files.where(F.col("file").rlike(MATCH_NAME))))


def _matches(each: DataFrame) -> DataFrame:
    """The matches of lines (file, line, text); other files, short lines and bad numbers are left out."""
    each = each.where(F.col("file").rlike(MATCH_NAME) & (F.col("line") > HEADER_LINES)).withColumn("f", F.split("text", "\t"))
    part = lambda i: F.regexp_extract("file", MATCH_NAME, i).cast("int")
    version = lambda a: F.struct(part(a).alias("major"), part(a + 1).alias("minor"), part(a + 2).alias("build"), F.lit(0).alias("sub"))
    rva = lambda i: parse_hex(F.get("f", F.lit(i))) - IMAGE_BASE
    return each.select(version(1).alias("lver"), version(4).alias("rver"), rva(0).alias("lrva"), rva(1).alias("rrva")).where("lrva IS NOT NULL AND rrva IS NOT NULL")


def in_file_order(rows: DataFrame) -> DataFrame:
    """rows of freshly read files with number: 0, 1, .. in the order of file names and of rows within a file."""
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return dense_numbers(placed, ["_file", "_block", "_at"]).drop("_file", "_block", "_at")


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0 over all files; a file's header has none) and text of the records of `"`-quoted text with a header, in one file or in parts.

    A line begins a record if an even number of quotes stands before it in its file. Lines are read in splits; the parity of each split
    is a sum over the splits before it (a row a split), so no task reads a whole file, and only records of several lines are put together.
    Blank records do not count. Quotes stand only in quoted fields, doubled inside; records end at a line feed, or a return and a line feed.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    spot, split = ["_file", "_block"], W.partitionBy("_file", "_block").orderBy("_at")
    quotes = raw.withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    past = lambda c, by: F.coalesce(F.sum(c).over(by.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    odd = quotes.groupBy(spot).agg(F.sum("_quotes").alias("n")).select(*spot, past("n", W.partitionBy("_file")).alias("_before"))  # a row a split
    open_ = F.col("_before") + F.coalesce(F.sum("_quotes").over(split.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = checkpointed(quotes.join(odd, spot).withColumn("_starts", open_ % 2 == 0).where(~(F.col("_starts") & F.col("value").isin("", "\r"))))
    starts = marked.groupBy(spot).agg(F.count_if("_starts").alias("n"))
    placed = starts.select(*spot, past("n", W.partitionBy()).alias("_records"), ((past("n", W.partitionBy("_file")) == 0) & (F.col("n") > 0)).cast("int").alias("_header"))  # a row a split
    placed = placed.select(*spot, "_records", (F.sum("_header").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, 0))).alias("_headers"), "_header")
    own = F.count_if("_starts").over(split.rowsBetween(W.unboundedPreceding, W.currentRow))
    each = marked.join(placed, spot).withColumn("_own", own).withColumn("_record", F.col("_records") + F.col("_own")).withColumn("_is_header", (F.col("_header") == 1) & (F.col("_own") == 1))
    # a record that goes on in the next split has its headers counted there too, so its number is taken where it starts
    number = F.when(F.col("_starts") & ~F.col("_is_header"), F.col("_record") - F.col("_headers") - 1)
    each = each.select("_file", "_block", "_at", "value", "_starts", "_quotes", "_record", number.alias("number"))
    whole = F.col("_starts") & (F.col("_quotes") % 2 == 0)
    several = each.where(~whole).groupBy("_file", "_record").agg(F.max("number").alias("number"), F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))).alias("l"))
    records = each.where(whole).select("_file", "number", "value").unionAll(several.select("_file", "number", F.array_join(F.col("l.value"), "\n").alias("value")))
    return records.select(F.col("_file").alias("file"), "number", F.regexp_replace("value", r"\r\z", "").alias("text"))


def quoted_table(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """number and the columns (strings) that the header names, of quoted text in one file or in parts with equal headers."""
    records = quoted_records(spark, path)
    head = records.where("number IS NULL").orderBy("file").first()
    names = [] if head is None else next(csv.reader([head["text"].removeprefix("\ufeff")], delimiter=sep))
    if not names:
        return spark.createDataFrame([], "number bigint")
    fields = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), {"sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return records.where("number IS NOT NULL").select("number", fields.alias("f")).select("number", *(F.col(f"f.c{i}").alias(n) for i, n in enumerate(names)))


def pair_table(spark: SparkSession, path: str) -> DataFrame:
    """row (record number + 2), name, og_rva, og_id, ae_rva, ae_id of the pair table: `;` text with a byte-order mark and a header, in one file or in parts.

    Records are numbered, not lines: blank lines do not count and a quoted field may hold line breaks. Names are freed of NULs and of
    white space around them; a column that the header lacks is read as empty. A file is read by many tasks.
    """
    numbered = quoted_table(spark, path)
    of = lambda name: F.col(name) if name in numbered.columns else F.lit(None).cast("string")
    name = F.regexp_replace(clean_text(of("Name")), r"(?U)^\s+|\s+$", "")
    return numbered.select(
        (F.col("number") + 2).cast("int").alias("row"), name.alias("name"), parse_hex(of("OG_Addr")).alias("og_rva"), parse_decimal(of("OG_REL_ID")).alias("og_id"),
        parse_hex(of("AE_221_Addr")).alias("ae_rva"), parse_decimal(of("AE_221_REL_ID")).alias("ae_id"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Function records of JSON lines; the metadata record and blank lines are left out."""
    return spark.read.schema(FUNCTION_RECORD).json(path).where("kind IS NULL OR kind <> 'metadata'").where("row IS NOT NULL")


def write_records(records: DataFrame, path: str) -> None:
    records.write.json(path)


MARK = "\ufeff"


def quoted_line(fields: list[Column], sep: str) -> Column:
    """A record of quoted text: fields with the separator, a quote or a line break are quoted; NULL is nothing."""
    plain = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    shown = [F.when(f.rlike(f'[{re.escape(sep)}"\r\n]'), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f) for f in plain]
    return F.concat_ws(sep, *shown) if len(shown) > 1 else F.when(shown[0] == "", '""').otherwise(shown[0])


def write_report(rows: DataFrame, fields: list[str], path: str, order: list[str] | None = None, sep: str = ";", mark: bool = True) -> None:
    """A report in one file: a byte-order mark (or none), the header, and a record a row in the order given, the fields in theirs; other columns are left out.

    Records are written by many tasks and joined in order (ordered_files); a report without rows has its header. No order: that of the rows.
    """
    out = io.StringIO()
    csv.writer(out, delimiter=sep).writerow(fields)
    # lines are made of rows in order: finding the ranges to sort them by would make them too
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    write_text(ordered.select(quoted_line([F.col(c) for c in fields], sep).alias("_line")), "_line", path, [], head=(MARK if mark else "") + out.getvalue(), ending="\r\n")


def read_report(spark: SparkSession, path: str, fields: list[str], sep: str = ";") -> DataFrame:
    table = quoted_table(spark, path, sep)
    return table.select(*(F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in fields))


def source_lines(spark: SparkSession, path: str, generated: bool = True) -> DataFrame:
    """file, line, text of a source tree's .h, .hpp, .cpp and .cxx files; generated=False leaves *_IDs.h headers out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{h,hpp,cpp,cxx}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines(files if generated else files.where(~F.col("file").rlike(r"_IDs\.h$")))


CONSTANT = r"^\s*inline\s+constexpr\s+(\S.*?)\s+([A-Za-z_]\w*)\s*\{\s*(.*?)\s*\};"


def parse_header(source: DataFrame) -> DataFrame:
    """name and values (all ids, then all offsets) of an ID header's constants (file, line, text); the last of a name wins, none is an error."""
    c = source.select("file", "line", *(F.regexp_extract("text", CONSTANT, i).alias(n) for i, n in enumerate(("type", "name", "body"), 1))).where("name <> ''")
    body = F.concat("type", F.lit(" "), "body")
    value = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.alias("value"))
    ids = F.transform(F.regexp_extract_all("body", F.lit(r"REL::ID\s*\(\s*(\d+)\s*\)"), F.lit(1)), lambda n: value("id", n.cast("bigint")))
    offsets = F.transform(F.regexp_extract_all("body", F.lit(r"REL::Offset\s*\(\s*(0x[0-9A-Fa-f]+|\d+)\s*\)"), F.lit(1)), lambda n: value("offset", parse_decimal(n)))
    bare = F.when((F.col("type") == "REL::ID") & F.col("body").rlike(r"^\d+$"), F.array(value("id", F.col("body").try_cast("bigint"))))
    found = F.concat(ids, offsets)
    values = F.when(F.size(found) > 0, found).when(bare.isNotNull(), bare).otherwise(F.raise_error(F.concat(F.lit("no value: "), body)).cast("array<struct<kind:string,value:bigint>>"))
    return last_wins(c.select("name", "file", "line", values.alias("values")), ["name"], ["file", "line"]).select("name", "values")


def header_lines(constants: DataFrame, tables: bool = False) -> DataFrame:
    """name and line of an ID header: one constant a name, or (tables) an array of all its values; sort by name to write."""
    shown = lambda v: F.concat(F.when(v["kind"] == "id", "REL::ID(").otherwise("REL::Offset(0x"), F.when(v["kind"] == "id", v["value"].cast("string")).otherwise(F.hex(v["value"])), F.lit(")"))
    each = F.array_join(F.transform("values", shown), ", ")
    kind = F.when(F.exists("values", lambda v: v["kind"] == "offset"), "REL::Offset").otherwise("REL::ID")
    if tables:
        line = F.concat(F.lit("inline constexpr std::array<"), kind, F.lit(", "), F.size("values").cast("string"), F.lit("> "), "name", F.lit("{ "), each, F.lit(" };"))
    else:
        line = F.concat(F.lit("inline constexpr auto "), "name", F.lit("{ "), F.array_join(F.transform(F.slice("values", 1, 1), shown), ""), F.lit(" };"))
    return constants.select("name", line.alias("line"))


def write_header(constants: DataFrame, namespace: str, path: str, tables: bool = False) -> None:
    """An ID header as one text file: its opening, a line a constant sorted by name, its closing."""
    head = f"#pragma once\n\nnamespace RE\n{{\n\tnamespace {namespace}\n\t{{\n"
    body = header_lines(constants, tables).select("name", F.concat(F.lit("\t\t"), "line").alias("value"))
    write_text(body, "value", path, ["name"], head=head, tail="\t}\n}\n")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """number (from 0) and text of the lines of a written header."""
    return in_file_order(spark.read.text(path)).select("number", F.col("value").alias("text"))


OVERRIDE = "og_id bigint, ae_rva string, confidence_tier string, evidence string, replacement_strategy string, allow_candidate_correction string"


def read_overrides(spark: SparkSession, path: str | None) -> DataFrame:
    """Reviewed overrides; no path: none. A missing or repeated og_id is an error."""
    if path is None:
        return spark.createDataFrame([], OVERRIDE).withColumn("ae_rva", parse_hex(F.col("ae_rva")))
    rows = spark.read.schema(OVERRIDE).csv(path, sep=";", header=True)
    bad = rows.groupBy("og_id").count().where("og_id IS NULL OR count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"override without og_id, or repeated: {bad[0]['og_id']}")
    return rows.withColumn("ae_rva", parse_hex(F.col("ae_rva")))
