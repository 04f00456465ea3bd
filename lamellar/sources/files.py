"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar import schemas

COLUMNS = ["id", "filename", "md5", "size", "state"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a header; missing trailing fields are empty, a size like 123.0 is 123, no number is 0. Blank lines are skipped."""
    raw = spark.read.schema(schemas.MANIFEST).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    size = F.coalesce(F.trim("size").try_cast("double").try_cast("bigint"), F.lit(0))
    text = {c: F.coalesce(F.trim(c), F.lit("")) for c in ("filename", "md5", "state")}
    return raw.where(F.trim("id") != "").select(F.trim("id").alias("id"), text["filename"].alias("filename"), text["md5"].alias("md5"), size.alias("size"), text["state"].alias("state"))


def manifest_lines(files: DataFrame) -> DataFrame:
    """One text line for each file (id, filename, md5, size, state); null md5 and state are empty."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS]
    return files.select(F.concat_ws("\t", *text).alias("line"))


def write_manifest(files: DataFrame, path: str) -> None:
    """A folder with one text file: header, then lines by id. A manifest is a work list for one reader, hence the single file."""
    head = files.sparkSession.createDataFrame([(0, "\t".join(COLUMNS))], "o int, line string")
    body = manifest_lines(files).select(F.lit(1).alias("o"), "line")
    head.union(body).repartitionByRange(1, "o", "line").sortWithinPartitions("o", "line").select("line").write.mode("overwrite").text(path)


def mutation_manifest(slides: DataFrame) -> DataFrame:
    """Distinct mutation files of rows that have one."""
    return slides.where("has_maf").select(F.col("maf_file_id").alias("id"), F.col("maf_filename").alias("filename"), F.col("maf_md5sum").alias("md5"), F.col("maf_file_size").alias("size")).distinct().withColumn("state", F.lit(""))


def read_mutations(spark: SparkSession, path: str, gene: str = "Hugo_Symbol", sample: str = "Tumor_Sample_UUID") -> DataFrame:
    """Two columns of tab-separated files, compressed or not; # begins a comment, at the start of a line or within: what follows in the line is null."""
    rows = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path)

    def cut(name: str):
        earlier = rows.columns[: rows.columns.index(name)]
        gone = F.lit(False)
        for c in earlier:
            gone |= F.coalesce(F.col(f"`{c}`").contains("#"), F.lit(False))
        return F.when(~gone, F.nullif(F.substring_index(f"`{name}`", "#", 1), F.lit("")))

    return rows.select(cut(sample).alias("aliquot_id"), cut(gene).alias("gene"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """dir, file, size of the files below a path (metadata only: the content column is pruned)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    parts = F.split("path", "/")
    return df.select(F.element_at(parts, -2).alias("dir"), F.element_at(parts, -1).alias("file"), F.col("length").alias("size"), "path")


def read_payloads(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "raw"), recursive: bool = True) -> DataFrame:
    """path, content of files with one of the extensions."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path).select("path", "content")


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """path, place of a text file that names one path a line; blank lines and those that begin with # are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("path"), F.monotonically_increasing_id().alias("place"))
    return lines.where((F.col("path") != "") & ~F.col("path").startswith("#"))


def feature_file(spark: SparkSession, path: str, environ: dict | None = None, variable: str = "LAMELLAR_FEATURES", glob: str = "*.h5") -> str | None:
    """The file of precomputed features: the one that the environment names, else the first by path; None if there is none."""
    import os

    named = (os.environ if environ is None else environ).get(variable)
    return named or listing(spark, path, glob).agg(F.min("path")).first()[0]


def describe_source(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row: files, bytes and folders below a path, and the smallest and largest file."""
    return listing(spark, path, glob).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.countDistinct("dir").alias("folders"), F.min("size").alias("smallest"), F.max("size").alias("largest"))


def read_tars(spark: SparkSession, path: str) -> DataFrame:
    """path (member name), content of all members of the tars below a path, in order within each."""

    def members(frames):
        import io
        import tarfile

        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            yield pd.DataFrame({"path": [m.name], "content": [tar.extractfile(m).read()]})

    return read_payloads(spark, path, ("tar",)).mapInPandas(members, "path string, content binary")


def read_records(spark: SparkSession, path: str, record: int = 256 * 256 * 3) -> DataFrame:
    """file, idx, content of fixed-width records; a rest shorter than a record is dropped."""

    def cut(frames):
        import pandas as pd

        for frame in frames:
            for file, content in zip(frame["file"], frame["content"], strict=True):
                for lo in range(0, len(content) // record, 64):  # few records in a frame; the file isn't repeated beside them
                    idx = range(lo, min(lo + 64, len(content) // record))
                    yield pd.DataFrame({"file": file, "idx": list(idx), "content": [bytes(content[i * record : (i + 1) * record]) for i in idx]})

    files = read_payloads(spark, path, ("bin",)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInPandas(cut, "file string, idx int, content binary")


def resolve_source(spark: SparkSession, candidates: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """The first (kind, path) of (kind, path, glob) that has a file: raw before tars before loose files before thumbnails."""
    for kind, path, glob in candidates:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p) and len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, glob))):
            return kind, path
    return None


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet, and a CSV twin if asked; Spark's commit protocol leaves whole tables or none."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        df.sparkSession.read.parquet(path).write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}_csv")
