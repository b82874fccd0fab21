"""Landed article files (JSON) and written results (JSON, Markdown text)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from newsloom.clock import utc
from newsloom.functions import content_text, none_if_empty, parse_categories, slugify, title_case
from newsloom.schemas import RAW_JSON

NORMALIZED_FILE = "normalized_articles.json"
# JSON lines are a third as large this way. Spark reads such files as it does plain ones, but each by one task.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
CORRUPT = "_corrupt_record"
# Always true. Spark reads the column of broken records only together with another one.
READ = "length(coalesce(title, '')) >= 0"


def file_stem() -> Column:
    """Feed slug of the file a row came from: its ``slug=`` folder when this
    library wrote it, else the file name without '.json'."""
    folder = F.regexp_extract("_metadata.file_path", r"/slug=([^/]+)/", 1)
    name = F.regexp_replace("_metadata.file_name", r"\.json$", "")
    return F.coalesce(F.nullif(F.try_url_decode(folder), F.lit("")), name)


def read_articles(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    exclude: Sequence[str] = (NORMALIZED_FILE,),
    tag: str | None = None,
    json_lines: bool = False,
    stream: bool = False,
    with_place: bool = False,
) -> DataFrame:
    """All articles of a folder of JSON files, keys missing in a file as NULL.

    A file holds one JSON array, or one object per line with ``json_lines``
    (the form the writers here produce; plain files of lines are read in splits, those ending in .gz whole).
    Files named in ``exclude``, or in a folder of that name, are left out. Records that are no JSON
    are left out too: :func:`broken_articles` returns them. Content is the text
    of its list or object, else ``content_encoded``.
    ``with_place`` adds ``seq``, the place in the files (:func:`json_records`).
    ``tag='source'`` sets ``source`` to the file stem, ``tag='source_name'``
    sets ``source_name`` to its title-cased form. ``stream`` reads each new file
    of one folder.
    """
    rows = _landed(spark, path, exclude, json_lines, stream).filter(F.col(CORRUPT).isNull() & F.expr(READ))
    columns = {name: F.col(name) for name in RAW_JSON.fieldNames()}
    columns["categories"] = parse_categories(F.col("categories"))
    shaped = [none_if_empty(content_text(F.col(name))) for name in ("content", "content_encoded")]
    columns["content"] = F.coalesce(*shaped, F.col("content"))
    if tag == "source":
        columns["source"] = F.col("_stem")
    elif tag == "source_name":
        columns["source_name"] = title_case(F.col("_stem"))
    elif tag is not None:
        raise ValueError(f"unknown tag {tag!r}")
    if with_place:
        columns["seq"] = F.col("_place")
    return rows.select(*[column.alias(name) for name, column in columns.items()])


def _kept(rows: DataFrame, exclude: Sequence[str]) -> DataFrame:
    for name in exclude:
        rows = rows.filter(~F.contains(F.concat("_metadata.file_path", F.lit("/")), F.lit(f"/{name}/")))
    return rows


def json_records(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType,
    json_lines: bool = False,
    exclude: Sequence[str] = (),
    stream: bool = False,
) -> DataFrame:
    """The records of JSON files: the columns of ``schema``, ``_corrupt_record``, ``_file``, ``_stem`` and ``_place`` (not in
    streams of lines).

    A place is (file, start, row). In a file that is one array, or one object, the row is the position in it.
    Of files of lines, which are read in splits, it is the start of the split and the order there. Places are in the order of
    the files by name and of the records in them, however large the splits are.
    """
    reader = (spark.readStream if stream else spark.read).option("recursiveFileLookup", True)
    paths = path if isinstance(path, str) else list(path)
    file = [F.col("_metadata.file_path").alias("_file"), file_stem().alias("_stem")]
    if json_lines:
        rows = _kept(reader.schema(StructType([*schema.fields, StructField(CORRUPT, StringType())])).json(paths), exclude)
        start = F.col("_metadata.file_block_start")
        place = F.struct(
            F.col("_metadata.file_path").alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("row")
        )
        # Numbers of rows are not to be had in streams.
        return rows.select(*schema.fieldNames(), CORRUPT, *file, *([] if stream else [place.alias("_place")]))
    text = F.regexp_replace("value", r"^\x{FEFF}|^\s+$", "")
    parsed = F.from_json("_text", ArrayType(schema), {"mode": "PERMISSIVE"})
    wholes = _kept(reader.text(paths, wholetext=True), exclude).select(text.alias("_text"), *file)
    items = wholes.filter(F.col("_text") != "").withColumn("_items", parsed)
    # A file that is no JSON is one record without columns.
    rows = items.select("_text", "_file", "_stem", "_items", F.posexplode_outer("_items").alias("_row", "_item"))
    place = F.struct(F.col("_file").alias("file"), F.lit(0).cast("long").alias("start"), F.col("_row").cast("long").alias("row"))
    return rows.filter("_items is null or _row is not null").select(
        "_item.*", F.when(F.col("_items").isNull(), F.col("_text")).alias(CORRUPT), "_file", "_stem", place.alias("_place")
    )


def _landed(
    spark: SparkSession, path: str | Sequence[str], exclude: Sequence[str], json_lines: bool, stream: bool
) -> DataFrame:
    return json_records(spark, path, RAW_JSON, json_lines, exclude, stream)


def broken_articles(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    exclude: Sequence[str] = (NORMALIZED_FILE,),
    json_lines: bool = False,
) -> DataFrame:
    """(file, record, reason) of every record that is no JSON; in a JSON array
    a mistake breaks the whole file."""
    rows = _landed(spark, path, exclude, json_lines, False).filter(F.col(CORRUPT).isNotNull() & F.expr(READ))
    return rows.select(
        F.col("_file").alias("file"),
        F.col(CORRUPT).alias("record"),
        F.lit("not valid JSON").alias("reason"),
    )


def union_batches(*batches: DataFrame) -> DataFrame:
    """Bag union of batches whose columns may differ."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), batches)


def newest_first(articles: DataFrame) -> DataFrame:
    """Date descending, undated articles last."""
    return articles.orderBy(F.col("date").desc_nulls_last(), F.col("url"))


def write_by_source(articles: DataFrame, path: str) -> None:
    """JSON lines (gzip) in one folder per source slug; sources not in ``articles``
    keep their files. The rebalance splits a source that holds most rows, so that no file is large."""
    (
        articles.withColumn("slug", slugify(F.col("source")))
        .hint("rebalance", F.col("slug"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**GZIP)
        .partitionBy("slug")
        .json(path)
    )


def write_articles(articles: DataFrame, path: str, format: str = "json") -> None:
    """Replace the normalised articles at ``path``; JSON lines are written as gzip."""
    options = GZIP if format == "json" else {}
    articles.write.mode("overwrite").format(format).options(**options).save(path)


def _dated(path: str, as_of: datetime | str) -> str:
    return f"{path.rstrip('/')}/dt={utc(as_of):%Y%m%d}"


def write_digest(digest: DataFrame, path: str, as_of: datetime | str) -> str:
    """Write the ``digest`` text under the day's folder as one file: of one row, or of pieces of whole lines by ``number``."""
    target = _dated(path, as_of)
    rows = digest.coalesce(1)
    if "number" in digest.columns:
        rows = rows.sortWithinPartitions("number")
    rows.select("digest").write.mode("overwrite").text(target)
    return target


def write_full_list(blocks: DataFrame, path: str, as_of: datetime | str) -> str:
    """Write the heading and numbered blocks of :func:`full_article_list`: part files whose
    names are in the order of the numbers."""
    target = _dated(path, as_of)
    ordered = blocks.repartitionByRange("number").sortWithinPartitions("number").select("block")
    ordered.write.mode("overwrite").text(target)
    return target


def latest_digest(spark: SparkSession, path: str) -> DataFrame:
    """Day, time and text of the digest file changed last; no row without one. The file is
    found without reading any text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    newest = files.select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).first()
    if newest is None:
        return spark.range(0).selectExpr(
            "string(null) as name", "timestamp(null) as modified", "string(null) as content"
        )
    day = F.regexp_extract("_metadata.file_path", r"/dt=([^/]+)/", 1)
    return spark.read.text(newest.path, wholetext=True).select(
        F.concat(F.lit("digest_hebdo_"), day).alias("name"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.regexp_replace("value", r"\n\z", "").alias("content"),
    )
