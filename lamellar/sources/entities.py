"""Typed scans of projects, cases, files and annotations: presets over one filter form, pushed down by Catalyst."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.functions.filters import query
from lamellar.operators.hierarchy import first

#: Field names by endpoint, as dotted paths.
FIELDS: dict[str, list[str]] = {
    "cases": [
        "case_id", "submitter_id", "state", "created_datetime", "updated_datetime", "days_to_index",
        "demographic.demographic_id", "demographic.gender", "demographic.race", "demographic.ethnicity", "demographic.year_of_birth", "demographic.year_of_death", "demographic.state", "demographic.submitter_id",
        "diagnoses.diagnosis_id", "diagnoses.primary_diagnosis", "diagnoses.age_at_diagnosis", "diagnoses.days_to_death", "diagnoses.tumor_grade", "diagnoses.tumor_stage", "diagnoses.vital_status", "diagnoses.submitter_id",
        "exposures.exposure_id", "exposures.alcohol_history", "exposures.bmi", "exposures.cigarettes_per_day", "exposures.years_smoked", "exposures.submitter_id",
        "samples.sample_id", "samples.submitter_id", "samples.sample_type", "samples.tissue_type", "samples.is_ffpe", "samples.tumor_descriptor",
        "samples.portions.portion_id", "samples.portions.submitter_id", "samples.portions.is_ffpe",
        "samples.portions.slides.slide_id", "samples.portions.slides.submitter_id", "samples.portions.slides.percent_tumor_cells", "samples.portions.slides.percent_necrosis",
        "project.project_id", "project.name", "project.disease_type", "project.primary_site",
    ],
    "files": [
        "file_id", "file_name", "file_size", "md5sum", "file_state", "state", "data_category", "data_type", "data_format", "experimental_strategy", "access", "platform", "created_datetime", "updated_datetime",
        "cases.case_id", "cases.submitter_id",
        "cases.project.project_id", "cases.project.name", "cases.project.disease_type", "cases.project.primary_site",
        "cases.diagnoses.primary_diagnosis", "cases.diagnoses.tumor_stage", "cases.diagnoses.tumor_grade", "cases.diagnoses.vital_status",
        "associated_entities.entity_id", "associated_entities.entity_submitter_id", "associated_entities.entity_type", "associated_entities.case_id",
    ],
    "projects": [
        "project_id", "name", "disease_type", "primary_site", "released", "state",
        "program.name", "program.program_id",
        "summary.case_count", "summary.file_count", "summary.file_size",
        "summary.data_categories.data_category", "summary.data_categories.file_count",
    ],
    "annotations": [
        "annotation_id", "case_id", "case_submitter_id", "entity_id", "entity_submitter_id", "entity_type", "category", "classification", "notes", "status", "creator", "state", "created_datetime", "updated_datetime",
    ],
}


def catalog(endpoint: str, *groups: str) -> list[str]:
    """Dotted field names of an endpoint's groups ("" for fields without a path); all if none is named."""
    return [f for f in FIELDS[endpoint] if not groups or f.rpartition(".")[0] in groups]


#: The parts of a case that are read if neither fields nor parts are named.
CASE_PARTS = ["demographic", "diagnoses", "samples"]


def present(df: DataFrame, fields: list[str]) -> list[str]:
    """Those of the fields that the table has; a service leaves out unknown ones, too."""
    from lamellar.functions.filters import discover_fields

    have = set(discover_fields(df.schema))
    return [f for f in fields if f in have]


def projects(df: DataFrame, program: str | None = None, fields: list[str] | None = None) -> DataFrame:
    return query(df, {"program.name": program}, fields)


def cases(df: DataFrame, project_id=None, case_ids=None, submitter_ids=None, primary_site=None, disease_type=None, gender=None, vital_status=None, fields: list[str] | None = None, expand: list[str] | None = None, most: int | None = None, custom: dict | None = None) -> DataFrame:
    """expand: whole parts (CASE_PARTS if neither fields nor parts are named), beside the case's own scalars."""
    if fields is None:
        parts = [p for p in (CASE_PARTS if expand is None else expand) if p in df.columns]
        fields = present(df, catalog("cases", "", "project")) + parts
    elif expand:
        fields = [*fields, *(p for p in expand if p in df.columns)]
    wanted = {"project.project_id": project_id, "case_id": case_ids, "submitter_id": submitter_ids, "project.primary_site": primary_site, "project.disease_type": disease_type, "demographic.gender": gender, "diagnoses.vital_status": vital_status}
    return query(df, wanted, fields, most, custom=custom)


def files(df: DataFrame, project_id=None, case_id=None, case_submitter_id=None, fields: list[str] | None = None, most: int | None = None, sort: str | None = None, custom: dict | None = None, **columns: Any) -> DataFrame:
    """columns: data_type, data_category, data_format, experimental_strategy, access; a list means IN."""
    wanted = {"cases.project.project_id": project_id, "cases.case_id": case_id, "cases.submitter_id": case_submitter_id} | columns
    return query(df, wanted, fields, most, sort, custom)


def slide_images(df: DataFrame, project_id: str, access: str = "open", strategy: str | None = "Diagnostic Slide", most: int | None = None) -> DataFrame:
    return files(df, project_id, data_type="Slide Image", access=access, experimental_strategy=strategy, most=most)


def clinical_files(df: DataFrame, project_id: str, access: str = "open", most: int | None = None) -> DataFrame:
    return files(df, project_id, data_category="Clinical", access=access, most=most)


def biospecimen_files(df: DataFrame, project_id: str, access: str = "open", most: int | None = None) -> DataFrame:
    return files(df, project_id, data_category="Biospecimen", access=access, most=most)


def annotations(df: DataFrame, project_id=None, case_id=None, entity_type=None, category=None, most: int | None = None) -> DataFrame:
    wanted = {"case_id": case_id, "entity_type": entity_type, "category": category}
    return query(df, wanted | ({"project.project_id": project_id} if project_id else {}), most=most)


def flat_cases(df: DataFrame) -> DataFrame:
    """Case records with project, demographic and the first diagnosis as scalars."""
    d = first("diagnoses")
    return df.select("case_id", "submitter_id", "project.project_id", "demographic.gender", "demographic.race", "demographic.ethnicity", *(d[c].alias(c) for c in ("primary_diagnosis", "tumor_stage", "tumor_grade", "vital_status")))


def flat_annotations(df: DataFrame) -> DataFrame:
    return df.select("annotation_id", "case_id", "case_submitter_id", "entity_id", "entity_type", "category", "classification", "notes", "status")


def flat_files(df: DataFrame) -> DataFrame:
    """File records with the first case's ids as scalars."""
    case = first("cases")
    return df.select("file_id", "file_name", "file_size", "md5sum", "state", "access", "data_type", "data_category", "data_format", "experimental_strategy", case["case_id"].alias("case_id"), case["submitter_id"].alias("case_submitter_id"), case["project"]["project_id"].alias("project_id"))


def flat_projects(df: DataFrame) -> DataFrame:
    return df.select("project_id", "name", F.col("program.name").alias("program"), first("disease_type").alias("disease_type"), first("primary_site").alias("primary_site"), "summary.case_count", "summary.file_count", "summary.file_size")
