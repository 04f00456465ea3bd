"""Registered queries of sources and sinks: each writes a driver table by a sink and reads it back by its source; the SQL says what must be read.

The files go to fresh paths in the shared folder (spark.checkpoint.dir). Nested records (projects, cases, files, annotations) are made of the relational tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.operators import imaging
from lamellar.plans.queries import Tables, registered
from lamellar.session import fresh_path
from lamellar.sources import entities, files, results


def _path(t: Tables, name: str) -> str:
    return fresh_path(t._spark, name)


@registered("SELECT CAST(doc_id AS VARCHAR) AS id, 'doc_' || doc_id || '.txt' AS filename, coalesce(md5(text), '') AS md5, coalesce(n_chars, 0) AS size, coalesce(lang, '') AS state FROM documents")
def manifest_written_and_read(t: Tables) -> DataFrame:
    path = _path(t, "manifest")
    rows = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("filename"), F.md5("text").alias("md5"), F.col("n_chars").alias("size"), F.col("lang").alias("state"))
    files.write_manifest(rows, path)
    return files.read_manifest(t._spark, path)


@registered("SELECT CASE WHEN l_returnflag <> 'R' THEN CAST(l_orderkey AS VARCHAR) END AS aliquot_id, CASE WHEN l_returnflag <> 'R' THEN 'Brand' END AS gene FROM lineitem JOIN part ON p_partkey = l_partkey")
def mutations_with_comments(t: Tables) -> DataFrame:
    """A # begins a comment within the line: brands hold one, and returned lines have one in an earlier field, so nothing is left of them."""
    path = _path(t, "mutations")
    rows = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    note = F.when(F.col("l_returnflag") == "R", F.lit("x#y")).otherwise(F.lit("x"))
    rows.select(note.alias("Note"), F.col("l_orderkey").alias("Tumor_Sample_UUID"), F.col("l_linenumber").alias("Line"), F.col("p_brand").alias("Hugo_Symbol"), F.col("l_quantity").alias("Rest")).write.option("sep", "\t").option("header", True).csv(path)
    return files.read_mutations(t._spark, path)


@registered("SELECT '/data/' || (doc_id % 7) || '/' || doc_id || '.txt' AS path FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0")
def path_list(t: Tables) -> DataFrame:
    """One path a line; every third line is blank, every fifth a comment."""
    path = _path(t, "paths")
    line = F.concat(F.lit("  /data/"), F.col("doc_id") % 7, F.lit("/"), F.col("doc_id"), F.lit(".txt "))
    t.documents.select(F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).when(F.col("doc_id") % 5 == 0, F.lit("# note")).otherwise(line).alias("value")).write.text(path)
    return files.read_path_list(t._spark, path).select("path")


@registered("SELECT form, s_suppkey, s_name, s_acctbal FROM supplier, (SELECT unnest(['csv', 'parquet']) AS form)")
def table_and_csv_twin(t: Tables) -> DataFrame:
    path = _path(t, "table")
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    files.write_table(rows, path, csv=True)
    twin = t._spark.read.schema(rows.schema).option("header", True).csv(f"{path}_csv")
    return t._spark.read.parquet(path).withColumn("form", F.lit("parquet")).unionByName(twin.withColumn("form", F.lit("csv")))


@registered("SELECT 'm' || (label % 3) AS model, count(*) AS n, CAST(sum(CASE WHEN label % 3 = 1 THEN -vec_id ELSE vec_id END) AS BIGINT) AS ids FROM embeddings GROUP BY 1")
def embeddings_by_model(t: Tables) -> DataFrame:
    """Embeddings of three models, one of which is run again with other ids: its folder alone is replaced."""
    path = _path(t, "embeddings")
    rows = t.embeddings.select("vec_id", "embedding", F.concat(F.lit("m"), F.col("label") % 3).alias("model"))
    results.write_embeddings(rows, path)
    results.write_embeddings(rows.where("model = 'm1'").withColumn("vec_id", -F.col("vec_id")), path)
    found = t._spark.read.parquet(path).groupBy("model").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))
    return results.models(t._spark, path).join(found, "model")


_SCORES = "SELECT source AS model, lang AS task, count(DISTINCT lang) AS n_classes, count(*) AS n, round(avg(n_chars) / 1000, 6) AS accuracy, CASE WHEN count(*) % 2 = 0 THEN round(max(n_chars) / 1000.0, 6) END AS auroc FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2"


@registered(_SCORES)
def results_written_and_read(t: Tables) -> DataFrame:
    """Scalars of result rows from the CSV, the nested part stays in the JSON lines; a missing score is empty."""
    path = _path(t, "results")
    groups = t.documents.where("lang is not null and source is not null").groupBy(F.col("source").alias("model"), F.col("lang").alias("task"))
    even = F.count("*") % 2 == 0
    rows = groups.agg(F.countDistinct("lang").alias("n_classes"), F.count("*").alias("n"), F.round(F.avg("n_chars") / 1000, 6).alias("accuracy"), F.when(even, F.round(F.max("n_chars") / 1000, 6)).alias("auroc"), F.array(F.min("n_chars")).alias("per_class_recall"))
    results.write_results(rows, path)
    return t._spark.read.schema("model string, task string, n_classes bigint, n bigint, accuracy double, auroc double").option("header", True).csv(f"{path}/results_csv")


@registered("SELECT 'doc_' || doc_id || '.txt' AS path, md5(coalesce(text, '')) AS md5, CAST(strlen(coalesce(text, '')) AS INTEGER) AS size FROM documents")
def tars_written_and_read(t: Tables) -> DataFrame:
    """Texts packed to a tar for each hundred ids, and all members of the tars."""
    path = _path(t, "tars")
    rows = t.documents.select(F.floor(F.col("doc_id") / 100).cast("string").alias("item_id"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    imaging.pack_tars(rows, path if "://" in path else f"file://{path.removeprefix('file:')}").write.parquet(f"{path}-written")
    return files.read_tars(t._spark, path).select("path", F.md5("content").alias("md5"), F.length("content").alias("size"))


@registered("SELECT count(DISTINCT coalesce(lang, '')) AS folders FROM documents")
def described_folder(t: Tables) -> DataFrame:
    """A folder for each language, counted from the listing alone."""
    path = _path(t, "folders")
    t.documents.select("lang", "doc_id").repartition("lang").write.partitionBy("lang").parquet(path)
    return files.describe_source(t._spark, path, "*.parquet").select("folders")


# ---- typed scans of nested records


def _cases(t: Tables) -> DataFrame:
    """Customers as cases: the nation is the project, the market segment the gender, orders are diagnoses."""
    orders = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))), lambda o: F.struct(o["o_orderpriority"].alias("primary_diagnosis"), o["o_orderstatus"].alias("vital_status"), F.lit(None).cast("string").alias("tumor_stage"), o["o_orderkey"].cast("string").alias("tumor_grade"))).alias("diagnoses"))
    project = F.struct(F.col("n_name").alias("project_id"), F.col("n_name").alias("name"), F.array("r_name").alias("disease_type"), F.array("r_name").alias("primary_site"))
    none = F.lit(None).cast("string")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").cast("string").alias("case_id"), F.col("c_name").alias("submitter_id"), project.alias("project"), F.struct(F.col("c_mktsegment").alias("gender"), none.alias("race"), none.alias("ethnicity")).alias("demographic"), "diagnoses")


_FIRST = "(SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS d, CAST(min(o_orderkey) AS VARCHAR) AS g, min_by(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY 1)"
_CASES = f"FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN {_FIRST} ON o_custkey = c_custkey"


@registered(f"SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_name AS submitter_id, n_name AS project_id, c_mktsegment AS gender, d AS primary_diagnosis, g AS tumor_grade, v AS vital_status {_CASES}")
def flat_cases(t: Tables) -> DataFrame:
    return entities.flat_cases(_cases(t)).select("case_id", "submitter_id", "project_id", "gender", "primary_diagnosis", "tumor_grade", "vital_status")


@registered(f"SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_name AS submitter_id, c_mktsegment AS demographic_gender {_CASES} WHERE r_name = 'ASIA' AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'F')")
def typed_cases(t: Tables) -> DataFrame:
    """Filters on an array of scalars, on a scalar and on any element of an array of structs."""
    return entities.cases(_cases(t), primary_site="ASIA", gender=["BUILDING", "MACHINERY"], vital_status="F", fields=["case_id", "submitter_id", "demographic.gender"])


def _files(t: Tables) -> DataFrame:
    """Orders as files; the customer's case is in an array."""
    case = F.struct(F.col("c_custkey").cast("string").alias("case_id"), F.col("c_name").alias("submitter_id"), F.struct(F.col("c_mktsegment").alias("project_id")).alias("project"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    names = {"file_id": F.col("o_orderkey").cast("string"), "file_name": F.concat(F.lit("o"), "o_orderkey"), "file_size": F.col("o_totalprice").cast("bigint"), "md5sum": F.md5(F.col("o_orderkey").cast("string")), "state": F.col("o_orderstatus"), "access": F.when(F.col("o_orderstatus") == "F", "open").otherwise("controlled")}
    kinds = {"data_type": F.when(F.col("o_orderpriority") == "1-URGENT", "Slide Image").otherwise("Other"), "data_category": F.lit("Clinical"), "data_format": F.lit("SVS"), "experimental_strategy": F.lit("Diagnostic Slide")}
    return rows.select(*(c.alias(n) for n, c in (names | kinds).items()), F.array(case).alias("cases"))


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS file_id, CAST(c_custkey AS VARCHAR) AS case_id, c_mktsegment AS project_id, md5(CAST(o_orderkey AS VARCHAR)) AS md5sum FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING'")
def slide_image_files(t: Tables) -> DataFrame:
    """The preset scan of open diagnostic images of a project, flattened."""
    return entities.flat_files(entities.slide_images(_files(t), "BUILDING")).select("file_id", "case_id", "project_id", "md5sum")


@registered("SELECT CAST(doc_id AS VARCHAR) AS annotation_id, source AS case_id, lang AS category FROM documents WHERE source IS NOT NULL AND lang = 'de'")
def annotations_scan(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    rest = ["case_submitter_id", "entity_id", "entity_type", "classification", "notes", "status"]
    rows = t.documents.where("source is not null").select(F.col("doc_id").cast("string").alias("annotation_id"), F.col("source").alias("case_id"), F.col("lang").alias("category"), *(none.alias(c) for c in rest))
    return entities.flat_annotations(entities.annotations(rows, category="de")).select("annotation_id", "case_id", "category")
