"""Quality rules: base counts per document, and divergence of its histograms from a reference of its language.

Two histograms describe a text: its characters by class (lower, upper, digit, punctuation, symbol, other, space) and its
words by common word (one bin for each function word, one for all other words). The reference of a language is the sum
over all documents with that ``lang`` that pass the base rules; documents without a language are compared with the
sum over all, by their characters only. The Jensen-Shannon distance (base 2, 0 to 1) to the reference must not exceed a limit. Guards: a
histogram is only judged for documents of a minimum length, where an empirical histogram is close enough to its source,
and against references of a minimum length. DataFrame functions only.

Defined results: null and empty texts have no words and fail the base rules; rows without an id are judged like any
other; repeated rows stay repeated (and count twice in the reference, as they do in the corpus). An empty table gives an
empty result; further columns are ignored. A distance equal to its limit passes; texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.session import stage

GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"
WINDOW = 3

# Frequent function words of English, German, French and Spanish.
COMMON = (
    "the of and to in is that for it with as on was by this from are at be "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch "
    "le la les de et à un une en que pour dans qui sur pas au par est "
    "el los y del se las por con no su para al lo como"
).split()
CLASSES = ("lower", "upper", "digit", "punctuation", "symbol", "other", "space")
UNKNOWN = "und"

# Documents of fewer words, and references of fewer, are not judged by a histogram.
LEAST_CHAR_WORDS, LEAST_COMMON_WORDS, LEAST_REFERENCE_WORDS = 50, 150, 2_000
MOST_CHAR_DISTANCE, MOST_COMMON_DISTANCE = 0.3, 0.32


def _zero() -> Column:
    return F.lit(0).cast("long")


def _hashed_windows(words: Column) -> Column:
    """One hash per window of three words."""
    def one(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))

    empty = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), one)).otherwise(empty)


def with_repeats(df: DataFrame, hashes: str, n_words: str, name: str) -> DataFrame:
    """Adds the number of words inside windows that occur twice or more.

    The position of each window is packed under the high bits of its hash, so that a sort of plain numbers
    brings equal windows together; the full hashes decide. Linear but for the sort, however repetitive the text.
    """
    bits = F.length(F.bin(F.col(n_words)))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1).cast("long")
    df = df.withColumn("_low", low).withColumn(
        "_packed",
        F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long")))),
        ),
    )

    def same(x: Column, y: Column) -> Column:
        def full(z: Column) -> Column:
            return F.get(F.col(hashes), z.bitwiseAND(F.col("_low")).cast("int"))

        return (x.bitwiseXOR(y) <= F.col("_low")) & (x.bitwiseXOR(y) >= 0) & (full(x) == full(y))

    def repeated(x: Column, i: Column) -> Column:
        before, after = F.get(F.col("_packed"), i - 1), F.get(F.col("_packed"), i + 1)
        return F.coalesce(same(x, before), F.lit(False)) | F.coalesce(same(x, after), F.lit(False))

    places = F.sort_array(F.transform(F.filter("_packed", repeated), lambda x: x.bitwiseAND(F.col("_low"))))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).cast("long").alias("last"), _zero().alias("total")),
        lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW).cast("long"), p - a["last"])).alias("total")),
        lambda a: a["total"],
    )
    return df.withColumn(name, F.when(F.col("_packed").isNull(), _zero()).otherwise(covered)).drop("_low", "_packed")


def _without(text: str, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def features(docs: DataFrame) -> DataFrame:
    """Base counts and both histograms of each row."""
    forms = sorted({f for w in COMMON for f in (w, w.capitalize(), w.upper())})
    df = docs.select(
        "doc_id", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    df = df.withColumn("words", F.filter(F.split("text", GAP), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(NOT_GAP))
    df = df.withColumn("lines", lines).select(
        "doc_id", "lang", "words",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("text").cast("long").alias("n_chars"),
        F.array_join("words", "").alias("solid"),
        _hashed_windows(F.col("words")).alias("hashes"),
        F.concat(F.lit(" "), F.lower(F.array_join(F.filter("words", lambda w: w.isin(forms)), "  ")), F.lit(" ")).alias("common"),
    )
    df = with_repeats(df, "hashes", "n_words", "n_repeat_words").drop("hashes", "words")
    df = df.withColumn("word_chars", F.length("solid").cast("long")).withColumn("rest1", _without("solid", r"\p{Ll}+"))
    df = df.withColumn("rest2", _without("rest1", r"\p{Lu}+")).withColumn("rest3", _without("rest2", r"\p{Nd}+"))
    df = df.withColumn("rest4", _without("rest3", r"""[.,;:!?'"()-]+""")).withColumn("rest5", _without("rest4", r"[#*$%&|<>]+"))
    sizes = [F.col("word_chars")] + [F.length(f"rest{k}").cast("long") for k in range(1, 6)]
    chars = [a - b for a, b in zip(sizes, sizes[1:])] + [sizes[-1], F.col("n_chars") - F.col("word_chars")]
    found = [
        F.floor((F.length("common") - F.length(F.replace(F.col("common"), F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2))
        for w in COMMON
    ]
    df = df.select(
        "doc_id", "lang", "n_words", "n_chars", "word_chars",
        (F.length("rest4") - F.length("rest5")).cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.array(*chars).alias("chars"), F.array(*found).alias("listed"),
    )
    other = F.col("n_words") - F.aggregate("listed", _zero(), lambda a, x: a + x)
    return df.withColumn("common", F.concat("listed", F.array(other))).drop("listed")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(rows: DataFrame) -> DataFrame:
    """Summed histograms per language, and one over all rows under no language."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"a{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"b{i}") for i in range(len(COMMON) + 1)]
    sums += [F.sum("n_chars").alias("ref_n_chars"), F.sum("n_words").alias("ref_n_words")]
    by_lang = stage(rows.where(~base_failed()).groupBy("lang").agg(*sums), "language-sums")
    whole = by_lang.agg(*(F.sum(c).alias(c) for c in by_lang.columns[1:])).select(F.lit(UNKNOWN).alias("lang"), "*")
    each = by_lang.where(F.col("lang") != UNKNOWN).union(whole)
    return each.select(
        "lang", "ref_n_chars", "ref_n_words", F.array(*(f"a{i}" for i in range(len(CLASSES)))).alias("ref_chars"),
        F.array(*(f"b{i}" for i in range(len(COMMON) + 1))).alias("ref_common"),
    )


def distance(counts: str, total: str, reference: str, reference_total: str) -> Column:
    """Jensen-Shannon distance of two count arrays with the given sums; null if one is missing or has no counts."""
    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def both(x: Column, y: Column) -> Column:
        p, q = x / F.col(total), y / F.col(reference_total)
        m = (p + q) / 2
        return (part(p, m) + part(q, m)) / 2

    divergence = F.aggregate(F.zip_with(counts, reference, both), F.lit(0.0), lambda a, x: a + x)
    return F.when((F.col(total) > 0) & (F.col(reference_total) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) in; base counts, base_failed, both distances and kept out, one row per row."""
    rows = stage(features(docs), "quality-features")
    df = rows.join(references(rows), "lang", "left")
    df = df.withColumns({
        "char_distance": distance("chars", "n_chars", "ref_chars", "ref_n_chars"),
        "common_distance": distance("common", "n_words", "ref_common", "ref_n_words"),
    })
    enough = F.col("ref_n_words") >= LEAST_REFERENCE_WORDS
    far = (F.col("n_words") >= LEAST_CHAR_WORDS) & (F.col("char_distance") > MOST_CHAR_DISTANCE)
    # Common words say nothing about a text whose language is unknown.
    known = (F.col("lang") != UNKNOWN) & (F.col("n_words") >= LEAST_COMMON_WORDS)
    far |= known & (F.col("common_distance") > MOST_COMMON_DISTANCE)
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & ~F.coalesce(far & enough, F.lit(False))).alias("kept"), "char_distance", "common_distance",
    )
