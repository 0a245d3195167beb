"""Reading files in XML, and the detector locations that belong to them."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanepulse import schemas
from lanepulse.functions import fixed_values as V

ROW_TAG = "raw_speed_volume_list"
CORRUPT = "_corrupt_record"

# Lenient on purpose: a file that does not parse comes back as a row with its text in
# the corrupt column, where the dropping mode would lose it without a trace.
OPTIONS = {
    "valueTag": "_VALUE",
    "attributePrefix": "_",
    "charset": "UTF-8",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "ignoreNamespace": "true",
    "ignoreSurroundingSpaces": "true",
    "pathGlobFilter": "*.xml",
}
PLAIN = OPTIONS["pathGlobFilter"]
PACKED = "*.{xml,xml.gz}"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])


PARSING = {k: v for k, v in OPTIONS.items() if k not in ("pathGlobFilter", "charset")}


def _parsed(text, schema: T.StructType, **options):
    """Generates one struct per text, so that what reads its fields does not parse again."""
    return F.explode(F.array(F.from_xml(text, _with_corrupt(schema), PARSING | options)))


def _elements(raw: DataFrame, tag: str, schema: T.StructType, **options) -> DataFrame:
    """One row per element `tag` of a text read by the separator of that tag.

    A record reaches from the end of one element to the end of the next, so a large file is read
    by many tasks. Comments are left out; an empty tag, or an end tag with a space in it, ends an
    element within its record. What does not parse has its text in the corrupt column, as has
    the rest of a file that is cut short. A file cut right before its last end tag counts as
    whole. An end tag inside a comment or CDATA section is taken for one.
    """
    text = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, rf"<{tag}(\s[^>]*)?/>", rf"<{tag}$1></{tag} >")
    pieces = raw.select(
        F.col("_metadata.file_name").alias("source_file"), F.explode(F.split(text, rf"</{tag}\s+>")).alias("piece"))
    found = pieces.select("source_file", F.regexp_extract("piece", rf"(?s)<{tag}(\s[^>]*)?>.*", 0).alias("text")).where("text <> ''")
    rows = found.select("source_file", "text", _parsed(F.concat("text", F.lit(f"</{tag}>")), schema, **options).alias("p"))
    return rows.select(
        *[f"p.{name}" for name in schema.names], F.when(F.col(f"p.{CORRUPT}").isNotNull(), F.col("text")).alias(CORRUPT),
        "source_file")


def _text(reader, tag: str, files: str = PLAIN):
    return reader.format("text").option("lineSep", f"</{tag}>").option("pathGlobFilter", files)


def read_documents(spark: SparkSession, *paths: str, files: str = PLAIN) -> DataFrame:
    """One row per reading document, nested, leaves as text, with the file's name. `files` names
    those to read of a folder; PACKED takes gzip files too. One task reads a whole gzip file, and
    one that cannot be unpacked to its end fails the read."""
    return _elements(_text(spark.read, ROW_TAG, files).load(list(paths)), ROW_TAG, schemas.READING_DOCUMENT)


def stream_documents(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """The same rows as a stream over the files that arrive in a folder."""
    files = _text(spark.readStream, ROW_TAG).option("maxFilesPerTrigger", files_per_batch).load(path)
    return _elements(files, ROW_TAG, schemas.READING_DOCUMENT)


def read_periods(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per period. The date lies outside that element; the file name has it."""
    periods = _elements(_text(spark.read, "period").load(list(paths)), "period", schemas.PERIOD, nullValue="")
    date = F.regexp_replace(
        F.regexp_extract("source_file", V.FILE_DATE_PATTERN, 0), V.FILE_DATE_PATTERN, "$1-$2-$3"
    )
    return periods.select(
        date.alias("date"), F.struct("period_from", "period_to", "detectors").alias("period"),
        CORRUPT, "source_file",
    )


# A text read by this separator falls into the parts between tags of a period.
PERIOD_TAG = "period>"
DATE_TAG = r"<(?:[\w.-]+:)?date>\s*([^<]*?)\s*</"
PERIOD_END = r"</([\w.-]+:)?$"
PERIOD_START = r"(?s)^.*<([\w.-]+:)?period\s[^>]*>"
HOLDS_READINGS = r"<([\w.-]+:)?detector_id>"


def read_split_periods(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of `read_periods` with the date of their document, from files of any size.

    A file is read as text records that end at a period's tag, so it is split over tasks like
    any text file, and each period is parsed on its own. A period takes the last date before
    it: found within its split, else carried over from the splits before, of which only the last
    date counts. A record with readings that is no whole period, or does not parse, has its text
    in the corrupt column. One file may hold several documents, each with its date first. A tag
    of a period inside a comment or CDATA section is taken for one.
    """
    raw = spark.read.option("lineSep", PERIOD_TAG).option("pathGlobFilter", OPTIONS["pathGlobFilter"]).text(list(paths))
    pieces = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value",
        F.nullif(F.regexp_extract("value", DATE_TAG, 1), F.lit("")).alias("named"))

    ends = pieces.groupBy("path", "block").agg(F.max_by("named", F.when(F.col("named").isNotNull(), F.col("place"))).alias("last"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("path", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))

    # Parsed where it is read: what meets in a split's window is rows, and parsed once.
    whole = F.col("value").rlike(PERIOD_END)
    body = F.regexp_replace(F.regexp_replace("value", PERIOD_END, ""), PERIOD_START, "")
    kept = pieces.where(whole | F.col("named").isNotNull() | F.col("value").rlike(HOLDS_READINGS))
    rows = kept.withColumn("whole", whole).select(
        "*", _parsed(F.when(F.col("whole"), F.concat(F.lit("<period>"), body, F.lit("</period>"))), schemas.PERIOD).alias("p"))
    good = F.col("whole") & F.col(f"p.{CORRUPT}").isNull()
    read = rows.select(
        "path", "block", "place", "source_file", "named",
        F.when(good, F.struct("p.period_from", "p.period_to", "p.detectors")).alias("period"),
        F.when(~good & (F.col("whole") | F.col("value").rlike(HOLDS_READINGS)), F.col("value")).alias(CORRUPT))
    split = Window.partitionBy("path", "block")
    dated = read.withColumn("own", F.last("named", ignorenulls=True).over(
        split.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = dated.where(F.col("period").isNotNull() | F.col(CORRUPT).isNotNull()).join(carried, ["path", "block"], "left")
    return found.select(F.coalesce("own", "carried").alias("date"), "period", CORRUPT, "source_file")


def good_and_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and the quarantine: name and text of what did not parse."""
    good = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    kept = [c for c in ("source_file", CORRUPT) if c in rows.columns]
    return good, rows.filter(F.col(CORRUPT).isNotNull()).select(*kept)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Detector locations by header name, then cast by name: the file's column order does
    not matter and detector ids stay text. Columns the file lacks come back as NULL."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType))
        .alias(f.name)
        for f in schemas.LOCATIONS.fields
    ])
