"""Readers and writers of the file shapes in use.  Schemas are given, never inferred; a missing path is a defined result."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tallyloom.functions.extract import email, entities, phone, sections
from tallyloom.functions.text import clean_lines, clean_text, extension, strip
from tallyloom.operators.profiles import latest
from tallyloom.sources import pdf

QUESTIONS = "text string, intent string, difficulty string, topics array<string>"
DOMAINS = "map<string,string>"
PAGES = "id int, page int, text string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_questions(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A JSON array of questions; a missing file is empty, or an error if ``strict``."""
    if not _exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], QUESTIONS)
    return spark.read.schema(QUESTIONS).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """(domain, description) rows of one JSON object."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", DOMAINS)).alias("domain", "description"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """One topic a line, stripped, blank lines dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("topic")).filter("topic <> ''")


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARKS = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}


def _paragraphs(content: bytes) -> str:
    """The body's paragraphs of a Word file, joined by blanks; paragraphs within tables are no part of the body."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    return " ".join("".join(e.text or "" if e.tag == f"{_WORD}t" else _MARKS.get(e.tag, "") for e in p.iter()) for p in body.findall(f"{_WORD}p"))


@F.pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Text of Word files; bytes that are none are an error."""
    return content.map(_paragraphs)


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, raw_text, email, phone, entities, sections) of text, ATS, Word (docx) and PDF files.

    Bytes that are no UTF-8 are replaced; a PDF file that cannot be read has
    no text.  See ``parse_resumes`` for text that was extracted elsewhere.
    """
    files = spark.read.format("binaryFile").load(path)
    ext = extension(F.col("path"))
    plain = files.filter(ext.isin("txt", "ats")).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    word = files.filter(ext == "docx").select("path", docx_text("content").alias("text"))
    pages = pdf.whole_texts(pdf.parse_pdf(files.filter(ext == "pdf"))).select("path", "text")
    return parse_resumes(plain.union(word).union(pages))


def pdf_chunks(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """(path, id, page, text): stripped pages of PDF files that are longer than ``least``; ids count the others too."""
    rows = pdf.read_pdf(spark, path).filter("page IS NOT NULL").withColumn("text", strip(F.col("text")))
    return rows.filter(F.length("text") > least).select("path", (F.col("page") - 1).alias("id"), "page", "text")


def parse_resumes(rows: DataFrame) -> DataFrame:
    """From (path, text): text files keep their lines and get sections; other formats are flattened; unknown ones are an error."""
    ext = extension(F.col("path"))
    lined = ext.isin("txt", "ats")
    wrong = F.raise_error(F.concat(F.lit("unsupported format: "), ext)).cast("string")
    text = F.when(lined, clean_lines(F.col("text"))).when(ext.isin("pdf", "docx", "doc"), clean_text(F.col("text"))).otherwise(wrong)
    rows = rows.withColumn("raw_text", text)
    return rows.select(
        "path",
        F.when(lined, "ATS").otherwise(F.upper(ext)).alias("format"),
        "raw_text",
        email(F.col("raw_text")).alias("email"),
        phone(F.col("raw_text")).alias("phone"),
        entities(F.col("raw_text")).alias("entities"),
        F.when(lined, sections(F.col("raw_text"))).alias("sections"),
    )


def page_chunks(rows: DataFrame, pages: str = "pages", least: int = 20) -> DataFrame:
    """(id, page, text) of a column of page arrays: stripped pages longer than ``least``; ids count dropped pages too."""
    others = [c for c in rows.columns if c != pages]
    each = rows.select(*others, F.posexplode(pages).alias("id", "text")).withColumn("text", strip(F.col("text")))
    return each.filter(F.length("text") > least).withColumn("page", F.col("id") + 1)


def upload_ok(name: str = "name", size: str = "size", text: str = "text") -> F.Column:
    """A PDF or Word file of at most 10 MiB with 50 characters of text or more."""
    return extension(F.col(name)).isin("pdf", "docx") & (F.col(size) <= 10 * 1024 * 1024) & (F.length(strip(F.col(text))) >= 50)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """One folder a learner bucket, overwritten whole."""
    profiles.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(256))).write.mode("overwrite").partitionBy("bucket").json(path)


def read_profile(spark: SparkSession, path: str, user_id: object) -> DataFrame:
    """One learner's profile, from its bucket only; no row if there is none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "user_id long")
    rows = spark.read.json(path)
    return rows.filter((F.col("bucket") == F.pmod(F.xxhash64(F.lit(user_id).cast("long")), F.lit(256))) & (F.col("user_id") == user_id))


def get_or_create(learners: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every learner with a profile, new ones with zeros and the easy target."""
    defaults = {"total_attempted": F.lit(0), "total_correct": F.lit(0.0), "target": F.lit("easy")}
    joined = learners.join(profiles, "user_id", "left")
    return joined.withColumns({c: F.coalesce(c, v) for c, v in defaults.items() if c in profiles.columns})


def upsert_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cached questions by (subject, topic); the latest timestamp wins."""
    return latest(old.unionByName(new), ["subject", "topic"], ["timestamp"])


def cached_questions(cache: DataFrame, topic: str, subject: str) -> DataFrame:
    return cache.filter((F.col("topic") == topic) & (F.col("subject") == subject)).select("questions")


#: Fields keep their blanks and line ends, and a quote within is doubled.
_CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What ``write_csv`` wrote."""
    return spark.read.schema(schema).options(**_CSV).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """A text report of one string column."""
    lines.write.mode("overwrite").text(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """Chunks (subject, pos, id, page, text, embedding), a folder a subject: the vectors stand beside their text."""
    chunks.write.mode("overwrite").partitionBy("subject").parquet(path)


def read_index(spark: SparkSession, path: str, subject: str) -> DataFrame | None:
    """One subject's chunks, or None if there are none."""
    if not _exists(spark, f"{path}/subject={subject}"):
        return None
    return spark.read.parquet(path).filter(F.col("subject") == subject)


def unfinished(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not done yet, to take a job up where it stopped."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def label_metadata(spark: SparkSession, labels: list[str]) -> DataFrame:
    """(id, label) rows of a task."""
    return spark.createDataFrame(list(enumerate(labels)), "id int, label string")


def subjects(spark: SparkSession, path: str) -> DataFrame:
    """Names of the ``.index`` files in a folder."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "subject string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.index").load(path).select("path")
    return files.select(F.regexp_extract("path", "([^/]+)\\.index$", 1).alias("subject"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, and for a local master only, under the system's temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"tallyloom-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str = "kept") -> DataFrame:
    """rows, stored in a folder of ``scratch`` and read back: for what is read many times."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
