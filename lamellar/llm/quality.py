"""Quality rules: fixed base rules, then thresholds learned per language and source from mergeable quantile sketches.

Each metric's fence in a group is median + spread_factor * (q75 - q25) + slack, from KLL sketches of all documents of the group; for the mean
word length there is a lower fence, too. Groups of under `least_rows` documents take the sketches merged over their language, or over all.
The fences are joined to the documents, which pass if no metric lies beyond its fence.

SLACK is part of the method, not a fixed cutoff in place of it: where a metric hardly varies in a group, a learned spread of zero would reject any
document that differs at all, so a fence never comes closer to the learned median than that.

Very long texts: read once, counted by bytes; their five-word windows are held while one text is read. Null text: no words, so base_failed. Null lang or source: a group of their own. Equal rows are judged alike, each. An empty table gives no rows.
Other columns of the input aren't read. Sketches are exact while a group has fewer than `sketch_k` rows; beyond, their rank error is about 2/k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.llm.common import staged, text_batches

SYMBOLS = "#*$%&|<>"
#: Metric -> the distance from the median that is always allowed.
SLACK = {"symbols_per_word": 0.1, "marks_per_word": 0.4, "upper_share": 0.15, "dup_line_share": 0.3, "repeat_share": 0.15, "mean_word": 1.5}
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows of `width` words that are found twice or more."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + width - max(end, i)
            end = i + width
    return covered


def text_stats(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper (A-Z), n_marks (ASCII punctuation)."""
    import numpy as np

    if not text:
        return (0,) * 8
    raw = text.encode()
    words, lines = raw.split(), raw.split(b"\n")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kept = [x for x in lines if x and not x.isspace()]
    white = int(count[9:14].sum() + count[32])
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    return len(words), len(text) - white, int(sum(count[ord(c)] for c in SYMBOLS)), len(kept) - len(set(kept)), repeated_words(words), len(kept), int(count[65:91].sum()), marks


def quality_stats(docs: DataFrame) -> DataFrame:
    def measure(batches):
        import pyarrow as pa

        for part, texts in text_batches(batches):
            stats = zip(*map(text_stats, texts), strict=True)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *(pa.array(x, pa.int64()) for x in stats)], [x.split()[0] for x in STATS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    words = F.greatest("n_words", F.lit(1))
    return rows.mapInArrow(measure, STATS).select(
        "*",
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_marks") / words).alias("marks_per_word"),
        (F.col("n_upper") / F.greatest("word_chars", F.lit(1))).alias("upper_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("word_chars") / words).alias("mean_word"),
    )


def fences(stats: DataFrame, spread_factor: float = 4.0, least_rows: int = 30, sketch_k: int = 2000) -> DataFrame:
    """One row for each (lang, source): the fences of all metrics. Sketches merge, so each row of stats is read once."""
    metrics = list(SLACK)
    groups = staged(stats.where("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("rows"), *(F.kll_sketch_agg_double(m, F.lit(sketch_k)).alias(m) for m in metrics)), "sketches")
    merged = lambda keys, name: groups.groupBy(*keys).agg(F.sum("rows").alias(f"{name}_rows"), *(F.kll_merge_agg_double(m, F.lit(sketch_k)).alias(f"{name}_{m}") for m in metrics))
    langs = merged(["lang"], "lang").withColumnRenamed("lang", "l")
    one = lambda rows: F.when(F.col(rows) >= 0, 1).alias("one")  # noqa: E731  a key that isn't folded away, so that the single row is looked up
    everything = F.broadcast(merged([], "all").select("*", one("all_rows")))
    out = groups.join(langs, F.col("lang").eqNullSafe(F.col("l")), "left").select("*", one("rows")).join(everything, "one")
    pick = lambda m: F.when(F.col("rows") >= least_rows, F.col(m)).when(F.col("lang_rows") >= least_rows, F.col(f"lang_{m}")).otherwise(F.col(f"all_{m}"))
    at = lambda m, q: F.kll_sketch_get_quantile_double(pick(m), F.lit(q))
    reach = lambda m: spread_factor * (at(m, 0.75) - at(m, 0.25)) + SLACK[m]
    return out.select("lang", "source", *((at(m, 0.5) + reach(m)).alias(f"most_{m}") for m in metrics), (at("mean_word", 0.5) - reach("mean_word")).alias("least_mean_word"))


def quality_verdicts(docs: DataFrame, least_words: int = 10, most_repeat_percent: int = 20, **kw) -> DataFrame:
    """Statistics of each document with base_failed, within_fences and kept."""
    stats = staged(quality_stats(docs), "stats")
    limits = staged(fences(stats, **kw), "fences").withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    within = F.col("mean_word") >= F.col("least_mean_word")
    for m in SLACK:
        within &= F.col(m) <= F.col(f"most_{m}")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("within_fences", F.coalesce(within, F.lit(False))).withColumn("kept", ~F.col("base_failed") & F.col("within_fences"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all documents."""
    out = quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(spread_factor: float = 4.0, least_rows: int = 30) -> str:
    """DuckDB SQL for op4_quality_rules while no group has more rows than a sketch keeps exactly. doc_id must be unique."""
    quartiles = ", ".join(f"quantile_disc({m}, {q}) AS {m}_{k}" for m in SLACK for k, q in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75)))
    pick = lambda m, k: f"CASE WHEN g.n >= {least_rows} THEN g.{m}_{k} WHEN l.n >= {least_rows} THEN l.{m}_{k} ELSE a.{m}_{k} END"
    reach = lambda m: f"({spread_factor} * ({pick(m, 'hi')} - {pick(m, 'lo')}) + {SLACK[m]})"
    within = " AND ".join(f"s.{m} <= {pick(m, 'mid')} + {reach(m)}" for m in SLACK) + f" AND s.mean_word >= {pick('mean_word', 'mid')} - {reach('mean_word')}"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
  length(t) - length(regexp_replace(t, '[!-/:-@\\[-`{{-~]', '', 'g')) AS n_marks FROM d LEFT JOIN cover USING (doc_id)),
s AS (SELECT *, n_symbols::DOUBLE / greatest(n_words, 1) AS symbols_per_word, n_marks::DOUBLE / greatest(n_words, 1) AS marks_per_word, n_upper::DOUBLE / greatest(word_chars, 1) AS upper_share,
  n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_share, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_share, word_chars::DOUBLE / greatest(n_words, 1) AS mean_word,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
g AS (SELECT lang, source, count(*) AS n, {quartiles} FROM s WHERE n_words > 0 GROUP BY 1, 2),
l AS (SELECT lang, count(*) AS n, {quartiles} FROM s WHERE n_words > 0 GROUP BY 1),
a AS (SELECT {quartiles} FROM s WHERE n_words > 0)
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, NOT s.base_failed AND coalesce({within}, false) AS kept
FROM s LEFT JOIN g ON g.lang IS NOT DISTINCT FROM s.lang AND g.source IS NOT DISTINCT FROM s.source LEFT JOIN l ON l.lang IS NOT DISTINCT FROM s.lang, a"""
