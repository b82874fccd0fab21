"""Article summaries: an extractive one, and a hook for a user's model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TextModel = Callable[[Sequence[str]], Sequence[str]]

# A word's weight is this divided by the number of documents that use it.
WEIGHT_SCALE = 1_000_000
# White space (as in newsloom.functions.text) that is not a single blank: most of a text's is, and stays as it is.
UNEVEN_SPACE = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
# At most so many words are looked up by broadcast.
MAX_COMMON_WORDS = 1_000_000


def summary_text(df: DataFrame) -> Column:
    """What to summarise: the content, or the summary when that is blank."""

    def filled(name: str) -> Column:
        return F.when(F.btrim(F.col(name)) != "", F.col(name))

    names = [name for name in ("content", "summary") if name in df.columns]
    return F.coalesce(*[filled(name) for name in names], F.lit(""))


def _sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "([.!?]) ", "$1\n"), "\n")


def _least_use() -> Column:
    """How many documents use a common word at least: the least power of two that few enough words reach, or the share
    when that is less."""
    share = F.ceil(F.sum("n_docs") / MAX_COMMON_WORDS)
    reached = [F.when(F.count_if(F.col("n_docs") >= 2**k) <= MAX_COMMON_WORDS, 2**k) for k in range(24)]
    return F.least(share, *reached)


def extractive_summary(
    docs: DataFrame,
    id_col: str = "id",
    text_col: str = "content",
    min_words: int = 30,
    max_words: int = 130,
) -> DataFrame:
    """(id, summary): each text's sentences with the rarest words. Ids are unique
    and not NULL.

    Sentences are taken by falling mean word weight while they fit into
    ``max_words``, and joined in text order. A text under ``min_words`` words is
    kept whole; a sentence over ``max_words`` is cut when it is shown.

    The texts are shuffled once, by id; every step reads that exchange. The
    scores move keys and numbers only. At most ``MAX_COMMON_WORDS`` words are common, those used most, and at least those that
    make up 1 in ``MAX_COMMON_WORDS`` of all (document, word) pairs: there cannot be more than that many, whatever the input.
    These go by broadcast, each as 24 bytes: its 64-bit hash, its length and its weight, however long it is. Any other word
    is below that share, so no key of the shuffled join is hot. Every word is looked up once: a sentence's common words are
    added up where the text is, and only its sum and its other words move.
    """
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.btrim(F.regexp_replace(F.coalesce(text_col, F.lit("")), UNEVEN_SPACE, " ")).alias("text"),
    ).filter("id is not null").repartition("id")
    counts = (
        texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )
    usage = counts.select(
        "word",
        F.xxhash64("word").alias("hash"),
        F.expr(f"{WEIGHT_SCALE} div n_docs").alias("weight"),
        (F.col("n_docs") >= counts.agg(_least_use()).scalar()).alias("common"),
    )
    # The word count is taken before the words are exploded, once per sentence. There is a word in every sentence:
    # "outer" only keeps Spark from splitting each one twice, to filter empty lists.
    words = (
        texts.select("id", F.posexplode(_sentences(F.lower("text"))).alias("pos", "sentence"))
        .select("id", "pos", F.split("sentence", " ").alias("words"))
        .select("id", "pos", F.size("words").alias("n_words"), "words")
        .select("id", "pos", "n_words", F.explode_outer("words").alias("word"))
    )
    common = F.broadcast(usage.filter("common").select("hash", F.octet_length("word").alias("bytes"), "weight"))
    rare = usage.filter("not common").select("hash", "word", F.col("weight").alias("each"))
    # Added up where the texts are: a row for a sentence's common words (without word), and one for each other word in it.
    is_common = (F.xxhash64("word") == F.col("hash")) & (F.octet_length("word") - F.col("bytes") == 0)
    parts = (
        words.join(common, is_common, "left")
        .groupBy("id", "pos", "n_words", F.when(F.col("weight").isNull(), F.col("word")).alias("word"))
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    )
    # Rows without word match nothing; they are dealt out by their text.
    scored = (
        parts.withColumn("hash", F.when(F.col("word").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("word")))
        .join(rare, ["hash", "word"], "left")
        .select("id", "pos", "n_words", F.coalesce("weight", F.col("n") * F.col("each")).alias("weight"))
        .repartition("id")
        .groupBy("id", "pos", "n_words")
        .agg(F.sum("weight").alias("weight"))
        .select("id", "pos", "n_words", F.expr("weight div n_words").alias("score"))
    )
    best = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    used = F.sum(F.least("n_words", F.lit(max_words))).over(best.rowsBetween(Window.unboundedPreceding, 0))
    kept = (
        scored.select(
            "id",
            "pos",
            F.row_number().over(best).alias("rank"),
            used.alias("used"),
            F.sum("n_words").over(Window.partitionBy("id")).alias("doc_words"),
        )
        .filter((F.col("rank") == 1) | (F.col("used") <= max_words) | (F.col("doc_words") < min_words))
        .groupBy("id")
        .agg(F.array_sort(F.collect_list("pos")).alias("kept"))
    )

    def shown(sentence: Column) -> Column:
        return F.array_join(F.slice(F.split(sentence, " "), 1, max_words), " ")

    chosen = F.transform("kept", lambda pos: shown(F.get("sentences", pos)))
    return (
        texts.select("id", _sentences(F.col("text")).alias("sentences"))
        .join(kept, "id")
        .select(F.col("id").alias(id_col), F.array_join(chosen, " ").alias("summary"))
    )


def answers_of(model: TextModel, texts: Sequence[str | None]) -> tuple[list[str], list[bool]]:
    """The answers to ``texts``, and for each whether the model failed on it. When it fails on all, or gives more or fewer
    answers than it got texts, it is asked for one text at a time. Blank texts, and texts that it then fails on, give ''."""

    def of(asked: list[str]) -> list[str]:
        answers = list(model(asked))
        if len(answers) != len(asked) or not all(isinstance(answer, str) for answer in answers):
            raise ValueError(f"{len(answers)} answers to {len(asked)} texts")
        return answers

    def one(text: str) -> str | None:
        try:
            return of([text])[0]
        except Exception:
            return None

    places = [i for i, text in enumerate(texts) if text and not text.isspace()]
    asked = [texts[i] for i in places]
    try:
        answers = of(asked) if asked else []
    except Exception:
        answers = [one(text) for text in asked]
    given, failed = [""] * len(texts), [False] * len(texts)
    for i, answer in zip(places, answers):
        given[i], failed[i] = answer or "", answer is None
    return given, failed


def map_texts(
    df: DataFrame,
    load_model: Callable[[], TextModel],
    text_col: str,
    out_col: str,
    failed_col: str | None = None,
) -> DataFrame:
    """``df`` plus ``out_col``: the user's model applied to ``text_col``.

    ``load_model`` runs once per task; the model gets the texts of an Arrow
    batch. When it fails, or gives more or fewer answers than it got texts, it is asked for one text at a
    time. Blank texts, and texts that it then fails on, give ''; ``failed_col`` tells the latter apart.
    Texts and answers stay strings of their own length: what a task holds is a batch, however long the longest is.
    """
    added = [T.StructField(out_col, T.StringType())]
    if failed_col is not None:
        added.append(T.StructField(failed_col, T.BooleanType()))
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches):
        import pyarrow as pa

        model = load_model()

        def answered(batch):
            given, failed = answers_of(model, batch.column(text_col).to_pylist())
            batch = batch.append_column(out_col, pa.array(given, batch.schema.field(text_col).type))
            return batch if failed_col is None else batch.append_column(failed_col, pa.array(failed))

        yield from map(answered, batches)

    return df.mapInArrow(run, schema)


def with_extractive_summary(articles: DataFrame) -> DataFrame:
    """``articles`` (unique ``id``) with ``summary`` replaced by an extract of the
    content, or of the summary when there is no content."""
    texts = articles.select("id", summary_text(articles).alias("content"))
    extracts = extractive_summary(texts).select("id", F.col("summary").alias("_extract"))
    filled = articles.join(extracts, "id", "left").withColumn("summary", F.nullif("_extract", F.lit("")))
    return filled.select(*articles.columns)


def with_model_summary(load_model: Callable[[], TextModel]) -> Callable[[DataFrame], DataFrame]:
    """The same with a user's model instead of extracts."""

    def fill(articles: DataFrame) -> DataFrame:
        texts = articles.withColumn("_text", summary_text(articles))
        answered = map_texts(texts, load_model, "_text", "_answer")
        return answered.withColumn("summary", F.nullif("_answer", F.lit(""))).select(*articles.columns)

    return fill
