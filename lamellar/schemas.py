"""Schemas of the domain inputs; declared, never inferred.

They are parsed on first use, as Spark's parser needs a session: schemas.CASES is a StructType.
"""

from __future__ import annotations

from pyspark.sql import types as T

DDL: dict[str, str] = {}


DDL["CASES"] = (
    "case_id STRING, submitter_id STRING, project STRUCT<project_id STRING, name STRING, disease_type ARRAY<STRING>, primary_site ARRAY<STRING>>, "
    "demographic STRUCT<gender STRING, race STRING, ethnicity STRING, year_of_birth INT, year_of_death INT>, "
    "diagnoses ARRAY<STRUCT<primary_diagnosis STRING, diagnosis_is_primary_disease STRING, tumor_stage STRING, tumor_grade STRING, vital_status STRING, days_to_death INT, age_at_diagnosis INT>>, "
    "samples ARRAY<STRUCT<sample_id STRING, submitter_id STRING, sample_type STRING, tissue_type STRING, "
    "portions ARRAY<STRUCT<portion_id STRING, submitter_id STRING, is_ffpe BOOLEAN, "
    "slides ARRAY<STRUCT<slide_id STRING, submitter_id STRING, percent_tumor_cells DOUBLE, percent_necrosis DOUBLE>>, "
    "analytes ARRAY<STRUCT<aliquots ARRAY<STRUCT<aliquot_id STRING>>>>>>>>"
)
DDL["FILES"] = (
    "ingest_ord BIGINT, file_id STRING, file_name STRING, file_size BIGINT, md5sum STRING, state STRING, access STRING, data_type STRING, data_category STRING, data_format STRING, experimental_strategy STRING, "
    "associated_entities ARRAY<STRUCT<entity_id STRING, entity_submitter_id STRING, entity_type STRING, case_id STRING>>, "
    "cases ARRAY<STRUCT<case_id STRING, submitter_id STRING, project STRUCT<project_id STRING>, samples ARRAY<STRUCT<sample_id STRING>>>>"
)
DDL["PROJECTS"] = (
    "project_id STRING, name STRING, program STRUCT<name STRING>, disease_type ARRAY<STRING>, primary_site ARRAY<STRING>, released BOOLEAN, state STRING, "
    "summary STRUCT<case_count BIGINT, file_count BIGINT, file_size BIGINT, data_categories ARRAY<STRUCT<data_category STRING, file_count BIGINT>>>"
)
DDL["ANNOTATIONS"] = ("annotation_id STRING, case_id STRING, case_submitter_id STRING, entity_id STRING, entity_submitter_id STRING, entity_type STRING, category STRING, classification STRING, notes STRING, status STRING")
DDL["MANIFEST"] = ("id STRING, filename STRING, md5 STRING, size STRING, state STRING")
DDL["RESULTS"] = ("model STRING, task STRING, n_classes INT, n BIGINT, n_total BIGINT, accuracy DOUBLE, balanced_accuracy DOUBLE, macro_f1 DOUBLE, auroc DOUBLE, per_class_recall ARRAY<DOUBLE>, per_class_precision ARRAY<DOUBLE>, confusion_matrix ARRAY<ARRAY<BIGINT>>")


def __getattr__(name: str) -> T.StructType:
    if name not in DDL:
        raise AttributeError(name)
    return T.StructType.fromDDL(DDL[name])
