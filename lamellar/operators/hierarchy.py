"""Flattening nested records to one row for each slide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.functions.scalars import truthy
from lamellar.operators.lookups import last_wins


def unnest(df: DataFrame, levels: list[str], keep: dict[str, str]) -> DataFrame:
    """Explodes one array after another (inner: empty and null arrays vanish); keep: output name -> dotted path from the row or a level.

    Level i's element is named e{i}; levels are paths like `samples`, `e0.portions`, `e1.slides`.
    """
    for i, path in enumerate(levels):
        df = df.withColumn(f"e{i}", F.explode(path))
    return df.select(*(F.col(p).alias(n) for n, p in keep.items()))


def slides(cases: DataFrame) -> DataFrame:
    """case -> samples -> portions -> slides; a slide id found twice keeps the last (by case, then place)."""
    df = cases.select("*", F.posexplode("samples").alias("i0", "e0"))
    df = df.select("*", F.posexplode("e0.portions").alias("i1", "e1")).select("*", F.posexplode("e1.slides").alias("i2", "e2"))
    flat = df.select(
        F.col("e2.slide_id").alias("slide_id"), F.col("e2.submitter_id").alias("slide_submitter_id"), "e2.percent_tumor_cells", "e2.percent_necrosis",
        "e1.portion_id", "e1.is_ffpe", "e0.sample_id", F.col("e0.submitter_id").alias("sample_submitter_id"), "e0.sample_type", "e0.tissue_type",
        "case_id", F.col("submitter_id").alias("case_submitter_id"), F.struct("case_id", "i0", "i1", "i2").alias("_ord"),
    )
    return last_wins(flat, ["slide_id"], "_ord").drop("_ord")


def sample_index(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.col("submitter_id").alias("case_submitter_id"), F.explode("samples").alias("s")).select("case_id", "case_submitter_id", "s.sample_id", "s.sample_type", "s.tissue_type")


def aliquot_to_sample(cases: DataFrame) -> DataFrame:
    return unnest(cases, ["samples", "e0.portions", "e1.analytes", "e2.aliquots"], {"aliquot_id": "e3.aliquot_id", "sample_id": "e0.sample_id"})


def first(array: str | Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def primary(array: str, flag: str) -> Column:
    """The first element whose flag is true, else the first; null for an empty or null array."""
    return F.coalesce(first(F.filter(array, lambda d: truthy(d[flag]))), first(F.col(array)))


def case_table(cases: DataFrame) -> DataFrame:
    """Demographics and the primary diagnosis."""
    d = cases.withColumn("_d", primary("diagnoses", "diagnosis_is_primary_disease"))
    return d.select("case_id", "demographic.gender", "demographic.race", "demographic.ethnicity", "demographic.year_of_birth", "_d.primary_diagnosis", F.col("_d.diagnosis_is_primary_disease").alias("diagnosis_is_primary"), "_d.tumor_stage", "_d.tumor_grade", "_d.vital_status", "_d.days_to_death", "_d.age_at_diagnosis")


def mutation_files(files: DataFrame) -> DataFrame:
    """The last mutation file of each sample of its first case."""
    rows = files.select("ingest_ord", F.explode(first("cases")["samples"]).alias("s"), F.col("file_id").alias("maf_file_id"), F.col("file_name").alias("maf_filename"), F.col("file_size").alias("maf_file_size"), F.col("md5sum").alias("maf_md5sum"))
    return last_wins(rows.select("s.sample_id", "ingest_ord", "maf_file_id", "maf_filename", "maf_file_size", "maf_md5sum"), ["sample_id"], "ingest_ord").drop("ingest_ord")


def slide_table(files: DataFrame, cases: DataFrame, mafs: DataFrame | None = None, demographics: bool = True) -> DataFrame:
    """files joined to the hierarchy (inner), case data and mutation files (left)."""
    entity = first("associated_entities")["entity_id"]
    rows = files.select("ingest_ord", "file_id", F.col("file_name").alias("filename"), "file_size", "md5sum", F.col("state").alias("file_state"), first("cases")["project"]["project_id"].alias("project_id"), entity.alias("slide_id"))
    out = rows.join(slides(cases), "slide_id")
    if demographics:
        out = out.join(case_table(cases), "case_id", "left")
    if mafs is not None:
        out = out.join(mutation_files(mafs), "sample_id", "left").withColumn("has_maf", F.col("maf_file_id").isNotNull())
    return out
