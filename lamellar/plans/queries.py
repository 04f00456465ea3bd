"""Registered queries of the relational operators on the driver tables, each with the DuckDB SQL that must give the same rows.

SURVEY 7.3 says which table stands for which domain input: region/nation/customer/orders for the nested hierarchy, lineitem joined to part for
mutation files, documents for payload files, labels for tasks, embeddings for patch vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.functions import filters, scalars
from lamellar.operators import acquire, facets, hierarchy, imaging, labels, leaderboard, lookups, metrics, pooling, presence, selection
from lamellar.sources import files as file_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def registered(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _filtered(df: DataFrame, expr: dict) -> DataFrame:
    return df.where(filters.compile_filter(expr, df.schema))


def _cond(op: str, name: str, value=None) -> dict:
    return {"op": op, "content": {"field": name, "value": value}}


# ---- filters and projections


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice >= 100000) OR o_orderpriority = '1-URGENT'")
def filter_ast_and_or(t: Tables) -> DataFrame:
    expr = {"op": "or", "content": [{"op": "and", "content": [_cond("=", "o_orderstatus", "F"), _cond(">=", "o_totalprice", 100000)]}, _cond("=", "o_orderpriority", "1-URGENT")]}
    return _filtered(t.orders, expr).select("o_orderkey", "o_totalprice")


@registered("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def filter_in_exclude(t: Tables) -> DataFrame:
    b = filters.FilterBuilder().add("c_mktsegment", ["BUILDING", "MACHINERY"]).add("c_nationkey", [1, 2, 3], "exclude")
    return b.apply(t.customer).select("c_custkey", "c_mktsegment")


@registered("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def filter_missing(t: Tables) -> DataFrame:
    return filters.FilterBuilder().add_exists("quality", False).apply(t.documents.select("doc_id").join(t.labels, "doc_id", "left")).select("doc_id")


def _nations(t: Tables) -> DataFrame:
    """region -> nations[] -> customers[]: a nested stand-in of the entity hierarchy."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_list(F.struct("c_custkey", "c_mktsegment", "c_acctbal")).alias("customers"))
    n = t.nation.join(c, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct("n_nationkey", "n_name", "customers")).alias("nations"))
    return t.region.join(n, "r_regionkey", "left")


@registered("SELECT r_regionkey, r_name FROM region r WHERE EXISTS (SELECT 1 FROM nation n JOIN customer c ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_acctbal > 9990)")
def filter_nested_any(t: Tables) -> DataFrame:
    return _filtered(_nations(t), _cond(">", "nations.customers.c_acctbal", 9990)).select("r_regionkey", "r_name")


@registered("SELECT r_regionkey, r_name FROM region r WHERE NOT EXISTS (SELECT 1 FROM nation n JOIN customer c ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_acctbal < -999)")
def filter_nested_none(t: Tables) -> DataFrame:
    expr = {"op": "exclude", "content": {"field": "nations.flag", "value": [True]}}
    flagged = _nations(t).withColumn("nations", F.transform("nations", lambda n: F.struct(F.exists(F.coalesce(n["customers"], F.array().cast("array<struct<c_custkey:bigint,c_mktsegment:string,c_acctbal:double>>")), lambda c: c["c_acctbal"] < -999).alias("flag"))))
    return _filtered(flagged, expr).select("r_regionkey", "r_name")


@registered("SELECT p_partkey, p_brand FROM part WHERE p_size >= 40")
def projection_fields(t: Tables) -> DataFrame:
    return filters.query(t.part, fields=["p_partkey", "p_brand"], custom=_cond(">=", "p_size", 40))


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42 LIMIT 1")
def point_lookup(t: Tables) -> DataFrame:
    return filters.point_lookup(t.orders, "o_orderkey", 42).select("o_orderkey", "o_totalprice")


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def typed_scan(t: Tables) -> DataFrame:
    return filters.query(t.orders, {"o_orderstatus": "O", "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_custkey": None}, ["o_orderkey", "o_totalprice"])


@registered("SELECT unnest(['r_regionkey', 'r_name', 'nations.n_nationkey', 'nations.n_name', 'nations.customers.c_custkey', 'nations.customers.c_mktsegment', 'nations.customers.c_acctbal']) AS field")
def schema_discovery(t: Tables) -> DataFrame:
    names = filters.discover_fields(_nations(t).schema)
    return t.region.sparkSession.sql("SELECT explode(split(:names, ',')) AS field", args={"names": ",".join(names)})


@registered("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).where("k > 50")


@registered("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def head_limit(t: Tables) -> DataFrame:
    return selection.head(t.orders, ["o_orderdate", "o_orderkey"], 25).select("o_orderkey")


@registered("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def sort_size_desc(t: Tables) -> DataFrame:
    return selection.head(t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 50)


# ---- hierarchy and joins


@registered("SELECT r_name, n_name, c_custkey, c_mktsegment FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def hierarchy_flatten(t: Tables) -> DataFrame:
    return hierarchy.unnest(_nations(t), ["nations", "e0.customers"], {"r_name": "r_name", "n_name": "e0.n_name", "c_custkey": "e1.c_custkey", "c_mktsegment": "e1.c_mktsegment"})


@registered("SELECT r_regionkey, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def sample_index(t: Tables) -> DataFrame:
    return hierarchy.unnest(_nations(t), ["nations"], {"r_regionkey": "r_regionkey", "n_nationkey": "e0.n_nationkey", "n_name": "e0.n_name"})


@registered("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'F'), o_orderkey) AS k FROM orders)
SELECT c_custkey, o_orderkey AS primary_order FROM customer LEFT JOIN o ON o_custkey = c_custkey AND k = 1""")
def primary_pick(t: Tables) -> DataFrame:
    flagged = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderstatus") == "F").alias("flag")))).alias("orders"))
    picked = t.customer.select("c_custkey").join(flagged, "c_custkey", "left")
    return picked.select("c_custkey", hierarchy.primary("orders", "flag")["o_orderkey"].alias("primary_order"))


@registered("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def inner_lookup(t: Tables) -> DataFrame:
    return lookups.inner_lookup(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, "c_custkey").select("o_orderkey", "c_name")


@registered("SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS has_label FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_lookup_flag(t: Tables) -> DataFrame:
    return lookups.left_lookup(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), "doc_id", "has_label")


@registered("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def last_wins_dedupe(t: Tables) -> DataFrame:
    return lookups.last_wins(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderkey").alias("_o")), ["o_custkey"], "_o").drop("_o")


@registered("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1")
def map_back(t: Tables) -> DataFrame:
    return lookups.map_back(t.documents.select("doc_id"), t.labels.where("quality = 1"), "doc_id", "toxic")


@registered("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_todo(t: Tables) -> DataFrame:
    return lookups.todo(t.documents.select("doc_id"), t.labels, "doc_id")


@registered("""
SELECT p.page_id, coalesce(a.r_regionkey, b.r_regionkey) AS r_regionkey
FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, url FROM pages) p
LEFT JOIN (SELECT DISTINCT url AS name, 0 AS r_regionkey FROM pages WHERE url LIKE '%.com/%') a ON a.name = p.url
LEFT JOIN (SELECT DISTINCT regexp_extract(url, '([^/]*)$', 1) AS name, 1 AS r_regionkey FROM pages WHERE url NOT LIKE '%.com/%') b ON b.name = p.base""")
def label_by_path_or_base(t: Tables) -> DataFrame:
    """All pages are labelled: those of some hosts by the whole path, those of the others by its last part."""
    a = t.pages.where("url LIKE '%.com/%'").select(F.col("url").alias("name"), F.lit(0).alias("r_regionkey")).distinct()
    b = t.pages.where("url NOT LIKE '%.com/%'").select(scalars.base_name(F.col("url")).alias("name"), F.lit(1).alias("r_regionkey")).distinct()
    return lookups.exact_or_base(t.pages.select("page_id", "url"), a.union(b), "url", "name", "r_regionkey").select("page_id", "r_regionkey")


@registered("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def disjoint_check(t: Tables) -> DataFrame:
    return lookups.duplicated_keys(t.lineitem, "l_orderkey")


@registered("SELECT c_custkey, c_name FROM customer")
def shard_merge(t: Tables) -> DataFrame:
    return lookups.merge_shards([t.customer.where(F.col("c_custkey") % 3 == k).select("c_custkey", "c_name") for k in range(3)], "c_custkey")


# ---- manifests, counts


@registered("SELECT concat_ws(chr(9), CAST(doc_id AS VARCHAR), source, '', CAST(n_chars AS VARCHAR), '') AS line FROM documents")
def manifest_lines(t: Tables) -> DataFrame:
    return file_sources.manifest_lines(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.lit(None).cast("string").alias("md5"), F.col("n_chars").alias("size"), F.lit(None).cast("string").alias("state")))


@registered("SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id, p_name AS filename, p_brand AS md5, CAST(p_size AS BIGINT) AS size, '' AS state FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def maf_distinct(t: Tables) -> DataFrame:
    slides = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_partkey").cast("string").alias("maf_file_id"), F.col("p_name").alias("maf_filename"), F.col("p_brand").alias("maf_md5sum"), F.col("p_size").cast("bigint").alias("maf_file_size"), (F.col("l_returnflag") == "R").alias("has_maf"))
    return file_sources.mutation_manifest(slides)


@registered("SELECT count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders")
def status_tally(t: Tables) -> DataFrame:
    return facets.tallies(t.orders, "o_orderstatus", ["F", "O", "P"])


@registered("SELECT 'lang' AS facet, coalesce(nullif(lang, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'unknown'), count(*) FROM documents GROUP BY 2")
def facet_counts(t: Tables) -> DataFrame:
    return facets.facet_counts(t.documents, ["lang", "source"])


@registered("SELECT lang, source, count(*) AS n, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS total, CAST(grouping_id(lang, source) AS BIGINT) AS gid FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def facet_grouping_sets(t: Tables) -> DataFrame:
    return facets.facet_sets(t.documents, ["lang", "source"], "n_chars").select("lang", "source", "n", "total", F.col("gid").cast("bigint").alias("gid"))


@registered("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def facet_distinct(t: Tables) -> DataFrame:
    return facets.distinct_values(t.events, "event_type")


@registered("SELECT count(*) AS n, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS total, round(sum(coalesce(n_chars, 0)) / 1073741824.0, 2)::DOUBLE AS gib FROM documents")
def byte_total(t: Tables) -> DataFrame:
    return facets.bytes_total(t.documents, "n_chars")


@registered("SELECT count(DISTINCT source) AS done FROM documents WHERE lang <> 'de'")
def completed_dirs(t: Tables) -> DataFrame:
    return facets.completed_dirs(t.documents.select(F.col("source").alias("dir"), F.when(F.col("lang") == "de", "x.partial").otherwise("x").alias("file")))


@registered("SELECT s.source, CASE WHEN coalesce(d.done, 0) = 0 THEN 'not_started' WHEN d.done < s.total THEN 'in_progress' ELSE 'completed' END AS status FROM (SELECT source, count(*) AS total FROM documents GROUP BY 1) s LEFT JOIN (SELECT source, count(*) AS done FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) d USING (source)")
def download_progress(t: Tables) -> DataFrame:
    total = t.documents.groupBy("source").agg(F.count("*").alias("total"))
    done = t.documents.join(t.labels.where("toxic = 1"), "doc_id").groupBy("source").agg(F.count("*").alias("done"))
    return total.join(done, "source", "left").select("source", facets.progress(F.coalesce("done", F.lit(0)), F.col("total")).alias("status"))


@registered("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unchecked' WHEN doc_id % 3 = 1 THEN 'ok' ELSE 'mismatch' END AS status FROM documents")
def md5_verify(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    claimed = t.documents.withColumn("claimed", F.when(k == 0, "").when(k == 1, F.md5("text")).otherwise("0"))
    return claimed.select("doc_id", facets.md5_status(F.col("text"), F.col("claimed")).alias("status"))


# ---- acquisition


@registered("SELECT doc_id, '/slides/' || doc_id || '/' || source AS slide_local_path, CASE WHEN quality = 1 THEN '/maf/' || doc_id || '/' || lang END AS maf_local_path FROM documents LEFT JOIN labels USING (doc_id)")
def local_paths(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.col("doc_id").alias("file_id"), F.col("source").alias("filename"), F.col("quality").alias("has_maf"), F.col("doc_id").alias("maf_file_id"), F.col("lang").alias("maf_filename"))
    return acquire.stringified_paths(acquire.local_paths(rows, "/slides", "/maf")).select("doc_id", "slide_local_path", "maf_local_path")


@registered("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS slide_exists FROM documents")
def existence_flags(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.concat(F.lit("/d/"), "doc_id").alias("slide_local_path"))
    listing = t.labels.where("toxic = 1").select(F.concat(F.lit("/d/"), "doc_id").alias("path"))
    return acquire.existence_flags(rows, listing, {"slide_local_path": "slide_exists"}).select("doc_id", "slide_exists")


@registered("SELECT CASE WHEN l.doc_id IS NOT NULL AND toxic = 1 THEN 'skip' WHEN d.doc_id % 11 = 0 THEN 'fail' WHEN d.doc_id % 2 = 0 THEN 'reuse' ELSE 'download' END AS action, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND toxic = 1 GROUP BY 1")
def acquisition_plan(t: Tables) -> DataFrame:
    work = t.documents.select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("f"), "doc_id")).alias("file_id"))
    cached = t.documents.where("doc_id % 2 = 0").select(F.concat(F.lit("f"), "doc_id").alias("file_id"))
    plan = acquire.acquisition(work, t.labels.where("toxic = 1"), cached, "doc_id", "file_id")
    return plan.groupBy("action").agg(F.count("*").alias("n"))


@registered("SELECT source, CASE WHEN bool_or(doc_id % 50 = 0) THEN 'no_access' WHEN bool_or(doc_id % 9 = 0) THEN 'failed' ELSE 'ok' END AS state FROM documents GROUP BY 1")
def run_states(t: Tables) -> DataFrame:
    status = F.when(F.col("doc_id") % 50 == 0, "no_access").when(F.col("doc_id") % 9 == 0, "failed").otherwise("processed")
    return acquire.run_state(t.documents.select("source", status.alias("status")), "source")


# ---- presence matrices


def _presence(t: Tables) -> DataFrame:
    events = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_type").alias("feature"))
    return presence.presence_long(events, t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "feature")


_LONG = "SELECT DISTINCT o_custkey, p_type AS feature FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey"


@registered(_LONG)
def presence_long(t: Tables) -> DataFrame:
    return _presence(t)


_TYPES = ["ECONOMY ANODIZED", "STANDARD POLISHED", "never seen"]


@registered(f"WITH x AS ({_LONG}) SELECT o_custkey, " + ", ".join(f"CAST(coalesce(max(CASE WHEN feature = '{f}' THEN 1 END), 0) AS INTEGER) AS {n}" for f, n in zip(_TYPES, ("a", "b", "never"), strict=True)) + " FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN x USING (o_custkey) GROUP BY 1")
def presence_pivot(t: Tables) -> DataFrame:
    wide = presence.presence_wide(_presence(t), t.orders, "o_custkey", "feature", _TYPES)
    return wide.select("o_custkey", *(F.col(f"`{f}`").alias(n) for f, n in zip(_TYPES, ("a", "b", "never"), strict=True)))


@registered(f"WITH x AS ({_LONG}) SELECT c_custkey, CAST(coalesce(max(CASE WHEN feature = '{_TYPES[0]}' THEN 1 END), 0) AS INTEGER) AS a FROM customer LEFT JOIN x ON o_custkey = c_custkey GROUP BY 1")
def presence_merge(t: Tables) -> DataFrame:
    long = _presence(t).withColumnRenamed("o_custkey", "c_custkey")
    wide = presence.presence_wide(long, long, "c_custkey", "feature", _TYPES[:1])
    return presence.merge_presence(t.customer.select("c_custkey"), wide, "c_custkey", _TYPES[:1]).select("c_custkey", F.col(f"`{_TYPES[0]}`").alias("a"))


@registered(f"SELECT count(DISTINCT o_custkey) AS rows, count(DISTINCT feature) AS features FROM ({_LONG})")
def presence_shape(t: Tables) -> DataFrame:
    return presence.shape(_presence(t), "o_custkey", "feature")


# ---- ordered selection

_DEPTH = "row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1"


@registered(f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, {_DEPTH} AS d FROM orders) ORDER BY d, o_orderpriority LIMIT 333")
def stratified_topn(t: Tables) -> DataFrame:
    return selection.stratified_topn(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], 333)


@registered(f"SELECT o_orderkey FROM (SELECT o_orderkey, size, sum(size) OVER (ORDER BY d, o_orderpriority ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CAST(o_totalprice AS BIGINT) AS size, {_DEPTH} AS d FROM orders)) WHERE c - size < 90000000")
def byte_budget(t: Tables) -> DataFrame:
    sized = t.orders.select("o_orderkey", "o_orderpriority", F.bround("o_totalprice").cast("bigint").alias("size"))
    return selection.byte_budget(sized, "o_orderpriority", ["o_orderkey"], "size", 90000000.0, block=64).select("o_orderkey")


@registered("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS d FROM documents) WHERE d % 7 = 0")
def stride_sample(t: Tables) -> DataFrame:
    return selection.stride_sample(t.documents.select("doc_id", "source"), "source", ["doc_id"], 7).select("doc_id")


@registered("SELECT CAST(sum(ceil(n / 7.0)) AS BIGINT) AS kept FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def stride_count(t: Tables) -> DataFrame:
    return selection.stride_count(t.documents.groupBy("source").agg(F.count("*").alias("n")), "n", 7)


@registered("SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS INTEGER) AS worker FROM documents")
def worker_mod(t: Tables) -> DataFrame:
    return selection.worker_of(t.documents.select("doc_id", "source"), ["doc_id"], 4, "source").select("doc_id", F.col("worker").cast("int").alias("worker"))


@registered("""
WITH RECURSIVE w AS (SELECT source, sum(n_chars)::DOUBLE AS w, row_number() OVER (ORDER BY sum(n_chars) DESC, source) AS k FROM documents GROUP BY source),
step AS (SELECT 0::BIGINT AS k, [0.0, 0.0, 0.0]::DOUBLE[] AS load, NULL::VARCHAR AS source, 0 AS shard
 UNION ALL SELECT w.k, [l + CASE WHEN i = p THEN w.w ELSE 0 END FOR l, i IN load]::DOUBLE[], w.source, p - 1
 FROM (SELECT k, load, CAST(list_position(load, list_min(load)) AS INTEGER) AS p FROM step) s JOIN w ON w.k = s.k + 1)
SELECT source, CAST(shard AS INTEGER) AS shard FROM step WHERE k > 0""")
def shard_lpt(t: Tables) -> DataFrame:
    weights = t.documents.groupBy("source").agg(F.sum("n_chars").alias("w"))
    return selection.assign_shards(weights, "source", "w", 3).select("source", "shard")


@registered("SELECT l_linestatus, count(*) AS n, CASE WHEN count(*) > 1 THEN greatest(1, CAST(round_even(count(*) * 0.2, 0) AS BIGINT)) ELSE 0 END AS n_val FROM (SELECT DISTINCT l_linestatus, l_orderkey FROM lineitem) GROUP BY 1")
def stratified_split_sizes(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_linestatus", "l_orderkey").distinct()
    split = selection.stratified_split(rows, "l_linestatus", F.col("l_orderkey"), 0.2)
    return split.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if("is_val").alias("n_val"))


@registered("SELECT doc_id, p <= CASE WHEN n > 1 THEN greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) ELSE 0 END AS is_val FROM (SELECT doc_id, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || doc_id)) AS p FROM labels)")
def stratified_split(t: Tables) -> DataFrame:
    return selection.stratified_split(t.labels, "quality", F.col("doc_id"), 0.2).select("doc_id", "is_val")


@registered("SELECT doc_id, h <= (SELECT max(h) FROM (SELECT h FROM (SELECT md5('0:' || doc_id) AS h FROM labels) ORDER BY h LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) FROM labels))) AS is_val FROM (SELECT doc_id, md5('0:' || doc_id) AS h FROM labels)")
def random_split(t: Tables) -> DataFrame:
    return selection.random_split(t.labels, "doc_id", 0.2).select("doc_id", "is_val")


# ---- labels


@registered("SELECT doc_id, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS label FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') AND quality = 1")
def task_labels_map(t: Tables) -> DataFrame:
    task = labels.Task("english", "lang", {"en": 0, "de": 1}, (), "lang", ("en", "de"), "quality")
    return labels.task_labels(t.documents.join(t.labels, "doc_id"), task, "doc_id")


@registered("SELECT d.doc_id, CASE WHEN quality <> 0 OR toxic <> 0 THEN 1 ELSE 0 END AS label FROM documents d JOIN labels l USING (doc_id)")
def task_labels_any_of(t: Tables) -> DataFrame:
    task = labels.Task("either", label_any_of=("quality", "toxic"))
    return labels.task_labels(t.documents.join(t.labels, "doc_id", "left"), task, "doc_id")


@registered("SELECT 'quality' AS task, doc_id, quality AS label FROM labels UNION ALL SELECT 'toxic', doc_id, toxic FROM labels")
def task_labels_all(t: Tables) -> DataFrame:
    return labels.all_labels(t.labels, [labels.Task("quality", "quality"), labels.Task("toxic", "toxic")], "doc_id")


@registered("SELECT doc_id, CAST(doc_id AS VARCHAR) || '_slide' AS item, CAST(doc_id * 256 AS INTEGER) AS x, CAST(n_chars AS INTEGER) AS y FROM documents")
def slide_key_parse(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/a/b/"), F.col("doc_id"), F.lit("_slide__x"), F.col("doc_id") * 256, F.lit("_y"), F.col("n_chars"), F.lit(".jpg"))
    x, y = scalars.patch_xy(F.col("path"))
    return t.documents.select("doc_id", path.alias("path")).select("doc_id", scalars.item_key(F.col("path")).alias("item"), x.alias("x"), y.alias("y"))


# ---- vectors and metrics


@registered("SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 5) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def mean_pool(t: Tables) -> DataFrame:
    pooled = pooling.mean_pool(t.embeddings, ["label"], "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "mean"), F.col("n_patches").alias("n")).withColumn("mean", F.round("mean", 5))


@registered("WITH s AS (SELECT avg(o_totalprice) AS m, greatest(stddev_samp(o_totalprice), 1e-6) AS s FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM orders, s")
def zscore(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("train"))
    return pooling.z_scores(rows, "train", "o_totalprice").select("o_orderkey", F.round("z", 6).alias("z"))


def _predictions(t: Tables) -> DataFrame:
    """Deterministic predictions: y and pred from order and part keys, three classes, of which pred never is 2 for one task."""
    y, pred = (F.col("l_partkey") % 3).cast("int"), (F.col("l_suppkey") % F.when(F.col("l_returnflag") == "N", 2).otherwise(3)).cast("int")
    return t.lineitem.select(F.col("l_returnflag").alias("task"), y.alias("y"), pred.alias("pred"), F.bround(F.col("l_quantity")).alias("score"))


_PRED = "(SELECT l_returnflag AS task, CAST(l_partkey % 3 AS INTEGER) AS y, CAST(l_suppkey % CASE WHEN l_returnflag = 'N' THEN 2 ELSE 3 END AS INTEGER) AS pred, l_quantity AS score FROM lineitem)"
_CLASSES = f"""
WITH p AS {_PRED}, k AS (SELECT DISTINCT task, c FROM p, (SELECT unnest([0, 1, 2]) AS c)),
s AS (SELECT task, c, (SELECT avg((p.pred = k.c)::INTEGER) FROM p WHERE p.task = k.task AND p.y = k.c) AS r,
 coalesce((SELECT avg((p.y = k.c)::INTEGER) FROM p WHERE p.task = k.task AND p.pred = k.c), 0) AS q FROM k)"""


@registered(f"SELECT task, round(avg((y = pred)::INTEGER), 6) AS accuracy FROM {_PRED} GROUP BY 1")
def accuracy(t: Tables) -> DataFrame:
    return metrics.metric_bundle(_predictions(t), ["task"], 3).select("task", F.round("accuracy", 6).alias("accuracy"))


@registered(_CLASSES + " SELECT task, CAST(c AS INTEGER) AS class, round(r, 6) AS recall, round(q, 6) AS precision FROM s")
def per_class_pr(t: Tables) -> DataFrame:
    return metrics.class_scores(_predictions(t), ["task"], 3).select("task", "class", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@registered(_CLASSES + " SELECT task, (SELECT count(*) FROM p WHERE p.task = s.task) AS n, round(avg(r), 6) AS balanced_accuracy, round(avg(CASE WHEN r IS NULL THEN NULL WHEN r + q = 0 THEN 0 ELSE 2 * r * q / (r + q) END), 6) AS macro_f1 FROM s GROUP BY task")
def metric_bundle(t: Tables) -> DataFrame:
    return metrics.metric_bundle(_predictions(t), ["task"], 3).select("task", "n", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@registered(f"WITH p AS {_PRED} SELECT k.task, CAST(a.c AS INTEGER) AS y, CAST(b.c AS INTEGER) AS pred, (SELECT count(*) FROM p WHERE p.task = k.task AND p.y = a.c AND p.pred = b.c) AS n FROM (SELECT DISTINCT task FROM p) k, (SELECT unnest([0, 1, 2]) AS c) a, (SELECT unnest([0, 1, 2]) AS c) b")
def confusion_matrix(t: Tables) -> DataFrame:
    return metrics.confusion_matrix(_predictions(t), ["task"], 3)


@registered("SELECT event_id, (rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0)::DOUBLE AS rank FROM (SELECT *, floor(value) AS v FROM events)")
def average_rank(t: Tables) -> DataFrame:
    return metrics.average_ranks(t.events.select("event_id", "event_type", F.floor("value").alias("v")), ["event_type"], "v").select("event_id", "rank")


_AUROC = "SELECT task, {by} round((sum(CASE WHEN pos THEN r END) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6)::DOUBLE AS auroc FROM (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY score) + (count(*) OVER (PARTITION BY {part}, score) - 1) / 2.0 AS r FROM {source}) GROUP BY {group}"


@registered(_AUROC.format(by="", part="task", source="(SELECT task, y = 1 AS pos, score FROM " + _PRED + ")", group="task"))
def auroc_ties(t: Tables) -> DataFrame:
    rows = _predictions(t).withColumn("pos", F.col("y") == 1)
    return metrics.auroc(rows, ["task"], "score", "pos").select("task", F.round("auroc", 6).alias("auroc"))


@registered("SELECT task, round(avg(auroc), 5) AS auroc FROM (" + _AUROC.format(by="c,", part="task, c", source="(SELECT task, c, y = c AS pos, (score + 10 * c) % 17 AS score FROM " + _PRED + ", (SELECT unnest([0, 1, 2]) AS c))", group="task, c") + ") GROUP BY task")
def auroc_ovr(t: Tables) -> DataFrame:
    rows = _predictions(t).withColumn("prob", F.array(*((F.col("score") + 10 * c) % 17 for c in range(3))))
    return metrics.auroc_multiclass(rows, ["task"]).select("task", F.round("auroc", 5).alias("auroc"))


_RESULTS = "(SELECT source, lang, round(avg(n_chars), 4) AS v FROM documents GROUP BY 1, 2 HAVING avg(n_chars) < 2000)"


def _results(t: Tables) -> DataFrame:
    """Cells of all documents; those of long texts are missing, as a model-task cell may be."""
    return t.documents.groupBy("source", "lang").agg(F.avg("n_chars").alias("v")).where("v < 2000").withColumn("v", F.round("v", 4))


_LANGS = ["de", "en", "es", "fr"]
_PIVOT = "SELECT source, " + ", ".join(f"max(CASE WHEN lang = '{x}' THEN v END) AS {x}" for x in _LANGS) + f" FROM {_RESULTS} GROUP BY 1"


@registered(_PIVOT)
def leaderboard_pivot(t: Tables) -> DataFrame:
    return leaderboard.pivot(_results(t), "source", "lang", "v", _LANGS)


@registered(f"SELECT source, round(mean, 6) AS mean, row_number() OVER (ORDER BY mean DESC NULLS LAST, source) AS rank FROM (SELECT source, avg(v) AS mean FROM {_RESULTS} GROUP BY 1)")
def leaderboard_rank(t: Tables) -> DataFrame:
    out = leaderboard.ranked(leaderboard.pivot(_results(t), "source", "lang", "v", _LANGS), "source", _LANGS)
    return out.select("source", F.round("mean", 6).alias("mean"), F.col("rank").cast("bigint").alias("rank"))


@registered("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '-' ELSE printf('%.3f', page_id / 8.0 + 0.0001) END AS shown FROM pages")
def format_summary(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.when(F.col("page_id") % 4 != 0, F.col("page_id") / 8.0 + 0.0001).alias("shown"))
    return leaderboard.formatted(rows, ["shown"])


# ---- imaging


@registered("SELECT CAST(v AS INTEGER) AS v, count(b) AS n FROM (SELECT unnest(generate_series(0, 255)) AS v) LEFT JOIN (SELECT CAST(floor(l_extendedprice) AS BIGINT) % 256 AS b FROM lineitem) ON b = v GROUP BY 1")
def histogram256(t: Tables) -> DataFrame:
    return imaging.histogram(t.lineitem.select((F.floor("l_extendedprice") % 256).cast("int").alias("b")), [], "b")


_HIST = "(SELECT l_returnflag AS g, CAST(l_quantity AS BIGINT) * (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 5 END) AS v FROM lineitem)"


@registered(f"""
WITH h AS (SELECT g, v, count(*)::DOUBLE AS n FROM {_HIST} GROUP BY 1, 2), s AS (SELECT g, v, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY g) AS n, sum(n * v) OVER (PARTITION BY g) AS s FROM h WINDOW w AS (PARTITION BY g ORDER BY v)),
x AS (SELECT g, v, CASE WHEN n - w0 = 0 THEN 0 ELSE w0 * (n - w0) * (s0 / w0 - (s - s0) / (n - w0)) ** 2 END AS q FROM s)
SELECT g, CAST(min(v) AS INTEGER) AS threshold FROM x JOIN (SELECT g, max(q) AS m FROM x GROUP BY 1) USING (g) WHERE q >= m GROUP BY 1""")
def otsu(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("g"), (F.col("l_quantity").cast("int") * F.when(F.col("l_linestatus") == "F", 1).otherwise(5)).alias("v"))
    return imaging.otsu(imaging.histogram(rows, ["g"], "v"), ["g"])


@registered("SELECT CAST(l_partkey // 100 AS INTEGER) AS gx, CAST(l_suppkey // 10 AS INTEGER) AS gy, round(avg((l_returnflag = 'R')::INTEGER), 6) AS share FROM lineitem GROUP BY 1, 2 HAVING avg((l_returnflag = 'R')::INTEGER) >= 0.25")
def tissue_grid(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("x"), (F.col("l_suppkey") * 10).alias("y"), (F.col("l_returnflag") == "R").alias("mask"))
    return imaging.cell_shares(rows, [], "x", "y", 100, "mask", 0.25).select("gx", "gy", F.round("share", 6).alias("share"))


@registered("SELECT n_nationkey AS item, CAST(x AS INTEGER) AS gx, CAST(y AS INTEGER) AS gy, CAST(x * 512 AS INTEGER) AS x0, CAST(y * 512 AS INTEGER) AS y0 FROM nation, (SELECT unnest(generate_series(0, 9)) AS x) a, (SELECT unnest(generate_series(0, 9)) AS y) b WHERE (x + 1) * 256 <= n_nationkey * 100 AND (y + 1) * 256 <= 600")
def patch_grid(t: Tables) -> DataFrame:
    items = t.nation.select(F.col("n_nationkey").alias("item"), (F.col("n_nationkey") * 100).alias("width"), F.lit(600).alias("height"), F.lit(2.0).alias("level_downsample"))
    return imaging.grid(items).select("item", "gx", "gy", "x0", "y0")


@registered("SELECT l_orderkey, l_linenumber, l_partkey, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS best, round(list_max(e) / list_sum(e), 9) AS prob FROM (SELECT *, [exp(x - list_max(v)) for x in v] AS e FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, [l_quantity / 10, l_discount * 50, l_tax * 50] AS v FROM lineitem))")
def softmax_argmax(t: Tables) -> DataFrame:
    """Class and probability from three scores, the first of equal ones."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array(F.col("l_quantity") / 10, F.col("l_discount") * 50, F.col("l_tax") * 50).alias("v")).distinct()
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", scalars.argmax(F.col("v")).alias("best"), F.round(F.array_max(scalars.softmax(F.col("v"))), 9).alias("prob"))


@registered("""
WITH s AS (SELECT vec_id, label, [list_dot_product(embedding::DOUBLE[], [((i + 1) * (k + 3) * 7919 % 101 - 50) / 50.0 for i in range(64)]::DOUBLE[]) for k in range(10)] AS z FROM embeddings)
SELECT vec_id, label, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred FROM s""")
def fixed_head_scores(t: Tables) -> DataFrame:
    """A linear head of fixed weights applied to all embeddings: scoring alone, without training."""
    weights = [[((i + 1) * (k + 3) * 7919 % 101 - 50) / 50.0 for i in range(64)] for k in range(10)]
    dot = lambda w: F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, w)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select("vec_id", "label", scalars.argmax(F.array(*map(dot, weights))).alias("pred"))


@registered("SELECT s.n_nationkey AS slide, c.c_custkey AS aliquot, n.r_regionkey AS sample FROM (SELECT r_regionkey FROM region) n JOIN nation s ON s.n_regionkey = n.r_regionkey JOIN customer c ON c.c_nationkey = s.n_nationkey")
def nested_aliquots(t: Tables) -> DataFrame:
    """Three nested levels unnested to one row for each innermost element, with the ids above it."""
    inner = t.customer.groupBy("c_nationkey").agg(F.collect_list(F.struct("c_custkey")).alias("aliquots"))
    middle = t.nation.join(inner, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "aliquots")).alias("portions"))
    nested = t.region.join(middle, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_regionkey", "portions")
    return hierarchy.unnest(nested, ["portions", "e0.aliquots"], {"slide": "e0.n_nationkey", "aliquot": "e1.c_custkey", "sample": "r_regionkey"})


# ---- plans that need Python: rows are checked by tests


@registered()
def linear_probe(t: Tables) -> DataFrame:
    """Metrics of probes that tell the embedding labels apart: one model, two tasks."""
    from lamellar.operators import probe

    e = t.embeddings.select(F.lit("toy").alias("model"), F.col("vec_id").cast("string").alias("item_id"), "embedding")
    tasks = t.embeddings.select(F.explode(F.array(F.struct(F.lit("upper").alias("task"), (F.col("label") >= 5).cast("int").alias("label")), F.struct(F.lit("odd").alias("task"), (F.col("label") % 2).alias("label")))).alias("x"), F.col("vec_id").cast("string").alias("item_id"))
    return probe.results(probe.run_grid(e, tasks.select("item_id", "x.task", F.col("x.label").cast("int").alias("label"))), 2)


@registered()
def tile_encode_pool(t: Tables) -> DataFrame:
    """Synthetic images cut to patches, encoded by the toy encoder and pooled to one vector for each item."""
    from lamellar.operators import encode

    # reddish tissue on light ground: bytes of a digest tell which pixels and how red
    digest = F.concat(*(F.sha2(F.concat_ws(":", "n_name", F.lit(k)), 512) for k in range(8)))
    row = F.transform(F.sequence(F.lit(1), F.lit(1024), F.lit(2)), lambda i: F.when(F.substring(digest, i, 1) < "8", F.concat(F.substring(digest, i, 2), F.lit("3232"))).otherwise(F.lit("F0F0F0")))
    pixel = F.unhex(F.repeat(F.array_join(row, ""), 64 * 128 // 512))
    images = t.nation.select(F.col("n_name").alias("item_id"), F.lit(128).alias("width"), F.lit(64).alias("height"), pixel.alias("content"))
    return encode.item_embeddings(imaging.tile(images, 0.1, 32, 64), encode.ByteStatistics())


@registered("""
WITH b AS (SELECT DISTINCT o_custkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
h AS (SELECT r_name, c_custkey, c_mktsegment, EXISTS (SELECT 1 FROM b WHERE b.o_custkey = c_custkey AND p_brand = 'Brand#11') AS a, EXISTS (SELECT 1 FROM b WHERE b.o_custkey = c_custkey AND p_brand = 'Brand#23') AS z
 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS d FROM h) ORDER BY d, c_mktsegment LIMIT 40)
SELECT r_name, count(*) AS n, CAST(sum(a::INTEGER) AS BIGINT) AS with_11, CAST(sum(z::INTEGER) AS BIGINT) AS with_23 FROM s GROUP BY 1""")
def dataset_flagship(t: Tables) -> DataFrame:
    """Nested hierarchy flattened, a balanced sample of it, presence columns joined, counted by region."""
    brands = ["Brand#11", "Brand#23"]
    flat = hierarchy.unnest(_nations(t), ["nations", "e0.customers"], {"r_name": "r_name", "c_custkey": "e1.c_custkey", "c_mktsegment": "e1.c_mktsegment"})
    chosen = selection.stratified_topn(flat, "c_mktsegment", ["c_custkey"], 40)
    # only what the chosen rows need: their orders, and these orders' lines
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(chosen.select("c_custkey"), "c_custkey", "left_semi")
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    events = lines.join(t.part.where(F.col("p_brand").isin(brands)), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "p_brand")
    long = presence.presence_long(events, orders, "o_orderkey", "c_custkey", "p_brand")
    full = presence.merge_presence(chosen, presence.presence_wide(long, long, "c_custkey", "p_brand", brands), "c_custkey", brands)
    return full.groupBy("r_name").agg(F.count("*").alias("n"), F.sum(F.col("`Brand#11`")).alias("with_11"), F.sum(F.col("`Brand#23`")).alias("with_23"))
