"""Quality rules from counts within a text and from lines that many documents of a host share. DataFrame functions only.

A line is normalised (lower case, white space squeezed) and hashed. For every host the documents that hold
the line are counted, copies once: documents count as different if their normalised texts differ anywhere. A line
above both limits is boilerplate and goes; a document that keeps too little of its text is depleted and goes too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import fresh, materialize

SPACES = " \t\n\x0b\f\r"
#: A line is boilerplate in a host if more documents than both of these hold it: a number, and a share of the host's.
LINE_DOCS, LINE_SHARE = 10, 0.005
#: A document is depleted if less than this share of its lines' characters is left.
LEAST_LEFT = 0.3
FEWEST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20


def normalised(text: Column) -> Column:
    """Lines in normal form, in order; lines without a word are empty."""
    squeezed = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09\x0B-\x0D]+", " "))
    return F.transform(F.split(squeezed, "\n"), lambda x: F.trim(x))


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null text: no words."""
    t, taken = F.coalesce(F.col(text), F.lit("")), docs.columns
    words, found, runs = fresh("_words", taken), fresh("_found", taken), fresh("_runs", taken)
    with_words = docs.withColumn(words, F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n = F.size(words)
    # every window's hash and place, sorted so that equal windows are neighbours
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(words, i, WINDOW)).alias("h"), i.alias("p")))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    with_found = with_words.select(
        *docs.columns, n.alias("n_words"), F.when(n >= WINDOW, F.sort_array(hashed)).otherwise(none).alias(found)
    )
    s = F.col(found)
    same = lambda i, j: F.coalesce(F.try_element_at(s, j)["h"] == F.element_at(s, i)["h"], F.lit(False))
    index = F.when(F.size(s) > 1, F.sequence(F.lit(1), F.size(s))).otherwise(F.array().cast("array<int>"))
    twice = F.filter(index, lambda i: ((i > 1) & same(i, F.greatest(i - 1, F.lit(1)))) | same(i, i + 1))
    with_runs = with_found.select(
        *docs.columns, "n_words", F.array_sort(F.transform(twice, lambda i: F.element_at(s, i)["p"])).alias(runs)
    )
    covered = F.aggregate(
        F.col(runs),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(p - a["last"], F.lit(WINDOW))).alias("sum")),
        lambda a: a["sum"],
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    bare = F.translate(t, SPACES, "")
    return with_runs.select(
        *docs.columns,
        F.col("n_words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
    )


def boilerplate(docs: DataFrame, host: str, text: str, line_docs: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """(host, line): hashes of the lines above the limits; written, so that Spark knows its size."""
    seen = (
        docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), normalised(F.col(text)).alias("_l"))
        # the row's own hash keeps copies, and nothing else, from counting twice
        .select("host", F.xxhash64("_l").alias("at"), F.array_distinct(F.filter("_l", lambda x: x != "")).alias("_l"))
        .select("host", "at", F.explode(F.transform("_l", lambda x: F.xxhash64(x))).alias("line"))
    )
    sizes = docs.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(F.count("*").alias("docs"))
    counts = seen.groupBy("host", "line", "at").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.sum("one").alias("n"))
    return materialize(
        counts.where(F.col("n") > line_docs).join(sizes, "host").where(F.col("n") > share * F.col("docs")).select("host", "line")
    )


def judged(docs: DataFrame, text: str = "text", host: str = "source", **limits: float) -> DataFrame:
    """(doc: struct of a row of docs, the base counts, base_failed, n_lines_cut, chars_left, kept, kept_text).

    kept_text is the text without boilerplate lines, the other lines as they were. No row moves but to a host's boilerplate, whose
    size is bounded by the limits: a line in more than LINE_SHARE of a host's documents leaves room for few such lines.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("t"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    frequent = boilerplate(rows, "host", "t", **limits)
    by_host = materialize(frequent.groupBy("host").agg(F.collect_set("line").alias("cut")))
    lines = F.split(F.coalesce("t", F.lit("")), "\n")
    both = F.arrays_zip(normalised(F.col("t")).alias("norm"), lines.alias("raw"))
    counted = base(rows, "t").withColumn("_both", both).join(by_host, "host", "left")
    gone = lambda x: (x["norm"] != "") & F.coalesce(F.array_contains("cut", F.xxhash64(x["norm"])), F.lit(False))
    size = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(x["norm"]))
    marked = counted.withColumn("_left", F.filter("_both", lambda x: ~gone(x)))
    sized = marked.withColumn("n_lines_cut", (F.size("_both") - F.size("_left")).cast("long")).withColumn("chars_left", size(F.col("_left")))
    return sized.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_cut", "chars_left",
        (~F.col("base_failed") & (F.col("chars_left") >= LEAST_LEFT * size(F.col("_both")))).alias("kept"),
        F.when(F.col("n_lines_cut") == 0, F.col("t")).otherwise(F.array_join(F.transform("_left", lambda x: x["raw"]), "\n")).alias("kept_text"),
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **limits: float) -> DataFrame:
    """One row per row of docs: key, the base counts, base_failed, n_lines_cut, chars_left, kept.

    Null text: no words, so it fails. A null host is the host "". A null key is kept as it is. Repeated rows get the same verdict
    each. Columns beside key, text and host are not read. An empty table gives no rows.
    """
    return judged(docs.select(key, text, host), text, host, **limits).select(F.col("doc")[key].alias(key), *_VERDICT)


_VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_cut", "chars_left", "kept")


def cleaned(docs: DataFrame, text: str = "text", host: str = "source", **limits: float) -> DataFrame:
    """docs without the rejected rows and without boilerplate lines."""
    # the row number keeps the filter above the projection: pushed below, it would count again within its own functions
    kept = judged(docs, text, host, **limits).withColumn("_row", F.monotonically_increasing_id()).where("kept AND _row >= 0")
    return kept.select(*[F.col("kept_text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
