"""Personal data: four kinds of base spans, then terms that corpus co-occurrence shows to disclose a protected entity; DataFrame operations only.

Base spans are found by patterns (leftmost, not overlapping, each kind apart) and checked: parts of an address at most 255, Luhn for cards, digits
of a phone number. Their values are the protected entities. Positions come from splitting the text at the matches, in code points.

Disclosure: a term is a run of letters, lower-cased, of three letters or more (of two or more in scripts other than Latin). For a term near an entity
(one of the `window` words on either side, whole words within `reach` characters), its evidence is the number of distinct
contexts in which the two stand together (copies of a passage count once). Near copies of a passage are no evidence: of the other words in these
contexts, `least_novelty` must stand in half of the contexts or fewer. p(entity | term) is the share of the documents with the term in which they
stand together, and the information is log2(p(entity | term) / p(entity)). A term with evidence of `least_contexts`, p of `least_share` and
information of `least_bits` or more discloses: its occurrences in all documents become spans of kind `term`. Document counts of terms are over all documents.
`sanitise` replaces base spans by their kind and disclosing terms by [TERM].

Null text: as empty. Null doc_id, repeated doc_ids and equal rows: each row gets its own result, rows are told apart by their place.
An empty table gives no rows. Other columns of the input, whatever their names, are kept by `sanitise` and not read by `find_spans`.
Very long texts: the patterns are written so that no long run is scanned from each of its places, and repetition doesn't recurse (possessive);
places are summed up in blocks of matches, so time grows with the text and its matches, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
#: As specified, with possessive repetition and starts at the beginning of a run or after the last match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text without a match mostly fails.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def matches(text: Column, kind: str, pattern: Column | str, block: int = 256) -> Column:
    """All matches of a pattern as an array of SPAN; the text between matches gives their places: lengths are summed up within blocks, then over blocks."""
    found, between = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0)), F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["hit"].alias("value")))).alias("spans"))

    def blocks(pairs):
        first = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(block))
        return F.transform(first, lambda i: F.aggregate(F.slice(pairs, i, F.lit(block)), empty, step))

    def begun(sums):
        """The length before each block."""
        return F.slice(F.aggregate(sums, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"]))), F.lit(1), F.size(sums))

    def moved(s, by):
        return F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))

    def placed(sums):
        return F.flatten(F.zip_with(sums, begun(sums), lambda b, by: F.transform(b["spans"], lambda s: moved(s, by))))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    of_pairs = F.transform(F.array(pairs), blocks)  # bound once, not once for each block
    return F.flatten(F.transform(of_pairs, placed))


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, 1).cast("int")
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, doubled(value(i))).otherwise(value(i))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.ltrim(p, F.lit("0")) > "255", 2).otherwise(3))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def checked(kind: str):
    return lambda span: valid(kind, span["value"])


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind, then start."""
    parts = []
    for kind in KINDS:
        hint = text.contains(HINTS[kind]) if HINTS[kind] else F.lit(True)
        likely = hint & text.rlike(PATTERNS[kind]) if kind != "card" else text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
        spans = F.filter(matches(text, kind, PATTERNS[kind]), checked(kind))
        parts.append(F.when(likely, spans).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.concat(*parts)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\P{L}+"), lambda w: w != "")


def chunks_of(text: Column, size: int = 2048) -> Column:
    """The text in chunks of so many code points, so that a place is found without a scan from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def beside(chunks: Column, span: Column, window: int, reach: int, size: int = 2048) -> tuple[Column, Column]:
    """Up to `window` whole words before and after a span, within `reach` characters (less than `size`); a word that the reach cuts doesn't count."""
    none, start, end = F.lit(""), span["start"], span["end"]
    i, j = F.floor(start / size).cast("int"), F.floor(end / size).cast("int")
    at = lambda k: F.coalesce(F.get(chunks, k), none)
    begin = start - i * size + F.when(i > 0, size).otherwise(0)  # of the span, in its chunk and the one before
    lo = F.greatest(begin - reach - 1, F.lit(0))
    left = F.substring(F.concat(F.when(i > 0, at(i - 1)).otherwise(none), at(i)), lo + 1, begin - lo)
    right = F.substring(F.concat(at(j), at(j + 1)), end - j * size + 1, F.lit(reach + 1))
    # one character more than the reach tells if a word goes on beyond it
    left = F.when(begin > reach, F.regexp_replace(left, r"^(?:\p{L}+|\P{L})", "")).otherwise(left)
    right = F.when(F.length(right) > reach, F.regexp_replace(right, r"(?:(?<!\p{L})\p{L}++|\P{L})\z", "")).otherwise(right)
    before, after = words_of(left), words_of(right)
    return F.slice(before, F.greatest(F.size(before) - window + 1, F.lit(1)), F.lit(window)), F.slice(after, F.lit(1), F.lit(window))


def candidates(rows: DataFrame, window: int, least_contexts: int, least_novelty: float, least_letters: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """rows: text, spans. Staged: (entity, term, evidence, together) of the terms with enough evidence, and (entity, entity_rows)."""

    def context(chunks):
        def of(s):
            left, right = beside(chunks, s, window, reach)
            return F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), left.alias("l"), right.alias("r"))

        return F.transform("spans", of)

    near = rows.where(F.size("spans") > 0).select(F.explode(F.flatten(F.transform(F.array(chunks_of(F.col("text"))), context))).alias("s")).select("s.*")
    near = near.select("entity", F.concat("l", "r").alias("near"), F.xxhash64(F.concat("l", F.array(F.lit("|")), "r")).alias("context"))
    contexts = staged(near.groupBy("entity", "context").agg(F.first("near").alias("near"), F.count("*").alias("n")), "contexts")  # copies of a passage meet here
    entities = contexts.groupBy("entity").agg(F.sum("n").alias("entity_rows"))
    pairs = contexts.select("entity", F.explode(F.array_distinct("near")).alias("term"), "n")
    pairs = pairs.where((F.length("term") >= least_letters) | ((F.length("term") > 1) & F.col("term").rlike(r"^\P{IsLatin}+$")))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("evidence"), F.sum("n").alias("together")).where(F.col("evidence") >= least_contexts)
    words = contexts.select("entity", "context", F.explode(F.array_distinct("near")).alias("word"))
    stand = words.withColumnRenamed("word", "term").join(pairs, ["entity", "term"])
    shared = stand.join(words, ["entity", "context"]).where("word <> term").groupBy("entity", "term", "word").agg(F.count("*").alias("k"), F.first("evidence").alias("e"))
    novel = shared.groupBy("entity", "term").agg((F.sum(F.when(2 * F.col("k") <= F.greatest("e", F.lit(2)), F.col("k")).otherwise(0)) / F.sum("k")).alias("novelty"))
    return staged(pairs.join(novel.where(F.col("novelty") >= least_novelty), ["entity", "term"]).select("entity", "term", "evidence", "together"), "pairs"), entities


def disclosing_terms(rows: DataFrame, window: int = 8, least_contexts: int = 3, least_share: float = 0.5, least_bits: float = 3.0, least_novelty: float = 0.5, least_letters: int = 3, reach: int = 400, broadcast_rows: int = 100_000) -> tuple[DataFrame, DataFrame] | None:
    """rows (staged): row, text, spans. Staged: (term, entity, evidence, share, bits), and (row, term) of the rows that hold such a term; None if no term has the evidence.

    One pass over all texts finds the rows that hold a candidate; their count by term is the term's document count.
    """
    pairs, entities = candidates(rows, window, least_contexts, least_novelty, least_letters, reach)
    asked = staged(pairs.select("term").distinct(), "asked")
    if (n := asked.count()) == 0:
        return None
    hint = F.broadcast if n <= broadcast_rows else (lambda df: df)
    holds = staged(rows.select("row", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).join(hint(asked), "term"), "holds")
    known = pairs.join(holds.groupBy("term").agg(F.count("*").alias("term_rows")), "term").join(entities, "entity")
    share = F.least(F.lit(1.0), F.col("together") / F.col("term_rows"))
    bits = F.log2(share / (F.col("entity_rows") / F.lit(max(1, rows.count()))))
    terms = staged(known.select("term", "entity", "evidence", share.alias("share"), bits.alias("bits")).where((F.col("share") >= least_share) & (F.col("bits") >= least_bits)), "terms")
    return terms, holds.join(hint(terms.select("term").distinct()), "term")


def with_terms(rows: DataFrame, holds: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """rows with spans of kind `term` added where holds (row, term) says so. Rows that hold one are broadcast only below a checked count, else exchanged."""
    holds = staged(holds.groupBy("row").agg(F.sort_array(F.collect_set("term")).alias("held")), "held")
    few = F.broadcast(holds) if holds.count() <= broadcast_rows else holds  # so that texts aren't exchanged for a few rows
    pattern = F.concat(F.lit(r"(?i)(?u)(?<!\p{L})(?:"), F.array_join("held", "|"), F.lit(r")(?!\p{L})"))
    joined = rows.join(few, "row", "left")
    free = F.filter(matches(F.col("text"), "term", pattern), lambda t: ~F.exists("spans", lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"])))
    return joined.withColumn("spans", F.when(F.col("held").isNotNull(), F.concat("spans", free)).otherwise(F.col("spans"))).drop("held")


def find_spans(docs: DataFrame, keep: list[str] | None = None, **kw) -> DataFrame:
    """row, text, spans (base, then terms) and the columns named in keep."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*(F.col(c).alias(f"kept_{c}") for c in keep or []), text.alias("text"), F.monotonically_increasing_id().alias("row")).withColumn("spans", base_spans(F.col("text")))
    rows = staged(rows, "pii")
    found = disclosing_terms(rows, **kw)
    return with_terms(rows, found[1]) if found else rows


def sanitise(docs: DataFrame, **kw) -> DataFrame:
    """docs with personal data in text replaced; overlapping spans are replaced together, by the first one's mark. Null texts stay null."""
    found = find_spans(docs, docs.columns, **kw)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        added = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], added).otherwise(acc["out"]).alias("out"))

    redone = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    new = F.when(F.size("spans") > 0, redone).otherwise(F.col("kept_text"))
    return found.select(*((new if c == "text" else F.col(f"kept_{c}")).alias(c) for c in docs.columns))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Spans in all documents."""
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("kept_doc_id").alias("doc_id"), *counts, F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
