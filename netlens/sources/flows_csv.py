"""Flow datasets in CSV: two header dialects, mixed in one folder."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.operators.cleaning import align_schema, clean, dialect_of, encode_labels, union_all
from netlens.operators.sampling import hash_sample

IDENTITY = ("label_raw", "src_ip", "dst_ip", "Flow ID", "Source IP", "Destination IP", "Src IP", "Dst IP", "Timestamp")


def files_by_header(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """CSV files (any depth, suffix in any case) grouped by their header line.

    One distributed pass finds the first line of every file: the first block of a
    file is read in order by one task.  One short row per file comes to the driver.
    """
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").text(paths)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))
    heads = lines.where("block = 0").groupBy("file").agg(F.first("value").alias("header")).orderBy("file").collect()
    if not heads:
        raise FileNotFoundError(f"no CSV files under {paths}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in heads:
        groups.setdefault(tuple(next(csv.reader([row["header"]]))), []).append(row["file"])
    return groups


def _typed(df: DataFrame) -> DataFrame:
    """Feature columns to doubles; text that is no number becomes NULL."""
    return df.select(*[F.col(f"`{c}`") if c in IDENTITY else F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns])


def read_flows(spark: SparkSession, paths: str | list[str], sample_frac: float = 1.0, encoding: str = "iso-8859-1") -> DataFrame:
    """Cleaned, labelled and deduplicated flows from all files, one read per header.

    Malformed lines are dropped.  The older files are not UTF-8, hence the encoding.
    """
    parts = []
    for header, files in files_by_header(spark, paths).items():
        # text columns: types are decided after alignment, the same for every file
        schema = ", ".join(f"`c{i}` string" for i in range(len(header)))
        raw = (spark.read.option("header", True).option("mode", "DROPMALFORMED").option("encoding", encoding)
               .option("enforceSchema", True).schema(schema).csv(files)).toDF(*_unique(header))
        dialect = dialect_of(list(header))
        parts.append(encode_labels(clean(_typed(align_schema(raw, dialect))), dialect))
    everything = union_all(parts).dropDuplicates()
    if sample_frac >= 1.0:
        return everything
    row = F.xxhash64(*[F.col(f"`{c}`") for c in everything.columns])
    return hash_sample(everything, row, sample_frac)


def _unique(header: tuple[str, ...]) -> list[str]:
    """Repeated column names get .1, .2, ... appended."""
    seen: dict[str, int] = {}
    out = []
    for name in header:
        clean_name = name.strip()
        n = seen.get(clean_name, 0)
        seen[clean_name] = n + 1
        out.append(clean_name if n == 0 else f"{clean_name}.{n}")
    return out
