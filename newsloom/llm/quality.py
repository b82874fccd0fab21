"""Quality rules: distance of a document's histograms from those of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.columns import SPACES, let, whole, words
from newsloom.llm.hashing import by_ids
from newsloom.session import written

MIN_WORDS = 50
CLASSES = {
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "symbol": "[#*$%&|<>]",
    "punctuation": "[.,;:!?'\"()-]",
}
COMMON_WORDS = 32
REFERENCE_WORDS = 1000  # a language with fewer has no reference: its histograms would stray by more than 1 / sqrt(1000)
# Largest distance of a document of n words: base + noise / sqrt(n). A histogram
# of n draws strays from its source by about 1 / sqrt(n).
CHARACTER_LIMIT = (0.14, 0.9)
WORD_LIMIT = (0.14, 1.8)


def repeated_window_words(hashes: Column, width: int = 3) -> Column:
    """How many words, given as hashes, lie in a window of ``width`` words that occurs twice or more. Most texts repeat
    no window, which a set of their hashes shows; only the others are sorted."""

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])

    starts = F.sequence(F.lit(0), F.size(hashes) - width)
    windows = F.when(F.size(hashes) > width, F.transform(starts, window))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(x["hash"] == y["hash"], F.lit(False))

    def repeated(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, j: same(x, F.get(ordered, j - 1)) | same(x, F.get(ordered, j + 1)),
        )
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    def covered(at: Column) -> Column:
        # A window counts up to where the next one begins.
        steps = F.transform(
            at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width)))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def counted(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))
        return F.when(
            F.size(F.array_distinct(w)) < F.size(w), let(ordered, lambda o: let(repeated(o), covered))
        )

    return F.coalesce(let(windows, counted), F.lit(0).cast("long"))


def _common_words(docs: DataFrame, n: int) -> DataFrame:
    """The most frequent words of each language, by exact counts; ties by the word."""
    each = docs.select("language", F.explode("words").alias("word")).groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("language").orderBy(F.col("n").desc(), "word")
    # A rank limit is applied within each task before the rows of a language meet.
    top = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    ranked = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return top.groupBy("language").agg(ranked.alias("top")).select("language", F.col("top.word").alias("common"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda n: F.when(total > 0, n / total).otherwise(F.lit(0.0)))


def quality(
    docs: DataFrame,
    common_words: int = COMMON_WORDS,
    character_limit: tuple[float, float] = CHARACTER_LIMIT,
    word_limit: tuple[float, float] = WORD_LIMIT,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, character_distance, word_distance, base_failed, kept.

    Two histograms of every document, of character classes and of its language's
    ``common_words`` most frequent words, are compared with the mean histograms of
    all documents of the language by the Jensen-Shannon distance. A limit is wider
    for short documents; documents below ``min_words`` fail the base rules anyway.

    Every language has references of its own, however few its rows. Documents of languages with fewer
    than ``REFERENCE_WORDS`` words, and those without a language, pass on the base rules alone; the distances
    of the latter are to each other's mean. Everything per document is computed within its row;
    between rows move the counts of words, summed by task first, and sums by language.

    NULL or empty text has no words and fails. Repeated rows each get a row. An empty
    table gives an empty result. Other columns are ignored.
    """
    return _judged(docs, common_words, character_limit, word_limit, min_words).drop("key")


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their columns."""
    found = _judged(docs, COMMON_WORDS, CHARACTER_LIMIT, WORD_LIMIT, MIN_WORDS)
    rejected = written(found.filter("not kept").select("key").distinct(), "rejected")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key().alias("key"))
    return by_ids(keyed, rejected, "key", "left_anti").select("row.*")


def _key() -> Column:
    """What tells rows apart: id, language and text decide the verdict."""
    return F.xxhash64("doc_id", "lang", whole())


def _judged(
    docs: DataFrame,
    common_words: int,
    character_limit: tuple[float, float],
    word_limit: tuple[float, float],
    min_words: int,
) -> DataFrame:
    named = docs.select(_key().alias("key"), "doc_id", F.col("lang").alias("language"), whole().alias("text"))
    tokens = named.withColumn("words", words(F.col("text")))

    common = _common_words(tokens, common_words)
    common = written(common.withColumn("common", F.transform("common", lambda word: F.xxhash64(word))), "common").alias("c")
    # One row per language, without a bound: Spark broadcasts it by its size or shuffles.
    measured = tokens.alias("t").join(common, F.col("t.language").eqNullSafe(F.col("c.language")), "left")
    measured = measured.withColumn("hashes", F.transform("words", lambda word: F.xxhash64(word)))
    text, hashes = F.col("text"), F.col("hashes")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    n_words = F.size(hashes)
    # The words are compared as hashes, and outside of lambdas: there Spark compiles the loops.
    common_counts = [
        F.coalesce(n_words - F.size(F.array_remove(hashes, F.get("c.common", F.lit(i)))), F.lit(0)) for i in range(common_words)
    ]
    features = written(
        measured.select(
            "key",
            "doc_id",
            "t.language",
            n_words.cast("long").alias("n_words"),
            F.char_length(text).cast("long").alias("n_chars"),
            F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
            *[F.regexp_count(text, F.lit(group)).cast("long").alias(name) for name, group in CLASSES.items()],
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_window_words(hashes).alias("n_repeat_words"),
            F.array(*common_counts).alias("word_counts"),
        ),
        "features",
    )

    space = F.col("n_chars") - F.col("word_chars")
    classes = [*[F.col(name) for name in CLASSES], space]
    others = F.col("n_chars") - sum(classes)
    unknown = F.col("n_words") - F.aggregate("word_counts", F.lit(0), lambda total, n: total + n)
    shares = features.withColumns(
        {
            "characters": _shares(F.array(*classes, others), F.col("n_chars")),
            "common": _shares(F.concat("word_counts", F.array(unknown)), F.col("n_words")),
        }
    )

    def mean(name: str, n: int) -> Column:
        return F.array(*[F.avg(F.get(name, F.lit(i))) for i in range(n)])

    references = written(
        shares.filter("n_words > 0")
        .groupBy("language")
        .agg(
            mean("characters", len(CLASSES) + 2).alias("usual_characters"),
            mean("common", common_words + 1).alias("usual_common"),
            (F.col("language").isNotNull() & (F.sum("n_words") >= REFERENCE_WORDS)).alias("judges"),
        ),
        "references",
    ).alias("r")

    def within(name: str, limit: tuple[float, float]) -> Column:
        return F.col(name) <= limit[0] + limit[1] / F.sqrt(F.col("n_words"))

    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = (
        shares.alias("s")
        .join(references, F.col("s.language").eqNullSafe(F.col("r.language")), "left")
        .select(
            "key",
            "doc_id",
            "n_words",
            "word_chars",
            F.col("symbol").alias("n_symbols"),
            "n_dup_lines",
            "n_repeat_words",
            _distance(F.col("characters"), F.col("usual_characters")).alias("character_distance"),
            _distance(F.col("common"), F.col("usual_common")).alias("word_distance"),
            base_failed.alias("base_failed"),
            "judges",
        )
    )
    passed = within("character_distance", character_limit) & within("word_distance", word_limit)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(passed | ~F.col("judges"), F.lit(False))).drop("judges")
