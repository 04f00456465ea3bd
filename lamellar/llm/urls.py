"""URL verdicts: allow and block rules by host and path, then a character language-model ratio; DataFrame operations only.

Two smoothed variable-order Markov models over URL characters, one of the URLs that rules allow, one of those that rules block: each gram of
1 to `order` + 1 characters has an interpolated (Witten-Bell) probability in either class; a character is scored with the longest context
that either class has seen it in. The mean over the characters of log p(accepted) - log p(rejected) is the URL's score. Its threshold is
calibrated on the ruled URLs of a fold that isn't learned from: the cut with the best mean of both classes' hit rates.
Characters are folded to an alphabet of 45, so the model has a proven bound of grams; it is broadcast only below `broadcast_rows`.

Counts weigh each distinct URL by its rows, so copies of a URL cost one row. Null url or none with `://`: host and path empty, no rule; its verdict
is the model's for the whole text (null: allow, nothing speaks against it). Without ruled URLs of both classes the score is 0 and all is allowed.
Equal rows are judged alike, each. An empty table gives no rows. Other columns of the input aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamellar.llm.common import staged

#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    part = lambda pattern: F.coalesce(F.regexp_extract(rest, pattern, 1), F.lit(""))
    return F.translate(part(r"^([^/?#]*)"), UPPER, LOWER), part(r"^[^/?#]*([^?#]*)")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits is the longest
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def folded(url: Column) -> Column:
    """Lower case, digits as 0, characters outside the alphabet as *, one mark before the first."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(url, r"^[^:]*://", "")), r"[0-9]", "0"), r"[^a-z0./?=&#_%:~+,;@!$'()\[\]-]", "*")
    return F.concat(F.lit("^"), text)


def contexts(text: Column, order: int) -> Column:
    """For each character the gram of it and up to `order` before it. The text is cut to characters once (bound by the outer lambda), so time is linear."""
    start = lambda i: F.greatest(i - order, F.lit(1))
    grams = lambda chars: F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.array_join(F.slice(chars, start(i), i - start(i) + 1), ""))
    return F.flatten(F.transform(F.array(F.filter(F.split(text, ""), lambda x: x != "")), grams))


def train(ruled: DataFrame, order: int = 3, least_context: int = 2) -> DataFrame:
    """ruled: text (folded), verdict, n. The staged model: gram, llr = log p(last character | those before), allow against block."""
    grams = ruled.select("verdict", "n", F.explode(contexts(F.col("text"), order)).alias("g"))
    grams = grams.groupBy("verdict", "g").agg(F.sum("n").alias("n"))  # few, before the suffixes are made
    suffixes = F.transform(F.sequence(F.lit(1), F.length("g")), lambda k: F.right(F.col("g"), k))
    grams = grams.select("verdict", "n", F.explode(suffixes).alias("g")).groupBy("g").agg(
        F.coalesce(F.sum(F.when(F.col("verdict") == "allow", F.col("n"))), F.lit(0)).alias("allow"), F.coalesce(F.sum(F.when(F.col("verdict") == "block", F.col("n"))), F.lit(0)).alias("block")
    )
    grams = staged(grams.withColumn("h", F.left("g", F.length("g") - 1)), "grams")
    sums = grams.groupBy("h").agg(*(f(c).alias(f"{a}_{c}") for c in ("allow", "block") for a, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))))
    sums = staged(sums.where((F.col("n_allow") + F.col("n_block") >= least_context) | (F.col("h") == "")), "contexts")
    known = grams.join(sums, "h")
    smooth = lambda c, lower: (F.col(c) + F.col(f"t_{c}") * lower) / F.greatest(F.col(f"n_{c}") + F.col(f"t_{c}"), F.lit(1))
    backed = lambda c, lower: F.when(F.col(f"n_{c}") > 0, smooth(c, lower)).otherwise(lower)
    level = known.where(F.length("g") == 1).select("g", *(backed(c, F.lit(1 / 64)).alias(f"p_{c}") for c in ("allow", "block")))
    levels = [level]
    for k in range(2, order + 2):
        lower = levels[-1].withColumnsRenamed({"g": "s", "p_allow": "l_allow", "p_block": "l_block"})
        now = known.where(F.length("g") == k).withColumn("s", F.right("g", F.lit(k - 1))).join(lower, "s")
        levels.append(staged(now.select("g", *(backed(c, F.col(f"l_{c}")).alias(f"p_{c}") for c in ("allow", "block"))), "level"))
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return staged(out.select("g", F.log(F.col("p_allow") / F.col("p_block")).alias("llr")), "model")


def scores(urls: DataFrame, model: DataFrame, order: int = 3, broadcast_rows: int = 500_000) -> DataFrame:
    """urls: u (unique), url. u, score: the mean log ratio of its characters."""
    hint = F.broadcast if model.count() <= broadcast_rows else (lambda df: df)
    # a URL grows to a row for each character, so small inputs are spread first; rows carry its number, not the URL
    urls = urls.select("u", "url").repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u")
    at = urls.select("u", F.explode(contexts(folded(F.col("url")), order)).alias("g"))
    at = at.groupBy("u", "g").agg(F.count("*").alias("times"))
    best = F.lit(None).cast("double")
    for k in range(1, order + 2):
        at = at.withColumn("s", F.when(F.length("g") >= k, F.right("g", F.lit(k))))
        at = at.join(hint(model.select(F.col("g").alias("s"), F.col("llr").alias(f"llr{k}"))), "s", "left").drop("s")
        best = F.coalesce(F.col(f"llr{k}"), best)
    return at.groupBy("u").agg((F.sum(F.coalesce(best, F.lit(0.0)) * F.col("times")) / F.sum("times")).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """scored: score, verdict, n of ruled URLs. The threshold, in the middle of the gap that parts best; from at most 4,001 bins of scores."""
    bins = scored.withColumn("bin", F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "score")), 2)).groupBy("bin").agg(*(F.sum(F.when(F.col("verdict") == c, F.col("n")).otherwise(0)).alias(c) for c in ("allow", "block")))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    cut = bins.select("bin", F.coalesce(F.lag("bin").over(Window.orderBy("bin")), "bin").alias("below"), (F.coalesce(F.sum("block").over(upto), F.lit(0)) / F.sum("block").over(total) - F.coalesce(F.sum("allow").over(upto), F.lit(0)) / F.sum("allow").over(total)).alias("gain"))
    best = cut.agg(F.max("gain").alias("gain")).join(cut, "gain").agg((F.min("below") + F.max("bin")) / 2).first()[0]
    return float(best or 0.0)


def url_verdicts(pages: DataFrame, rules=RULES, order: int = 3, fold: int = 5) -> DataFrame:
    """page_id, url, host, path, rule, score, verdict."""
    host, path = split_url(F.col("url"))
    urls = pages.where("url is not null").groupBy("url").agg(F.count("*").alias("n")).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = staged(urls.withColumns({"rule": rule, "ruled": verdict, "u": F.monotonically_increasing_id()}), "urls")
    tested = F.crc32("url") % fold == 0
    model = train(urls.where(F.col("ruled").isNotNull() & ~tested).select(folded(F.col("url")).alias("text"), F.col("ruled").alias("verdict"), "n"), order)
    scored = staged(urls.join(scores(urls, model, order), "u", "left"), "scored")
    counts = {(r[0], r[1]): r[2] for r in urls.where("ruled is not null").groupBy("ruled", tested.alias("t")).count().collect()}
    both = all(counts.get((c, t)) for c in ("allow", "block") for t in (True, False))
    threshold = calibrate(scored.where(F.col("ruled").isNotNull() & tested).select("score", F.col("ruled").alias("verdict"), "n")) if both else None
    by_model = F.when(F.col("score") < threshold, F.lit("block")).otherwise(F.lit("allow")) if both else F.lit("allow")
    judged = scored.select("url", "host", "path", "rule", "score", F.coalesce("ruled", by_model).alias("verdict"))
    out = pages.select("page_id", "url").join(judged, "url", "left")
    empty = F.lit("")
    return out.select("page_id", "url", F.coalesce("host", empty).alias("host"), F.coalesce("path", empty).alias("path"), "rule", "score", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url").withColumn("score", F.round("score", 6))
