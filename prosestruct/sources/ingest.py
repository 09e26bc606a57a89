"""Documents from memory, files and folders; gates; sinks. Failures are rows, not job failures."""

from __future__ import annotations

import os
import stat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DOCUMENT_WIRE, ERROR, MAX_INPUT_BYTES, RAW

#: Extension to format, case-sensitive; anything else is plain text. A name's leading dot starts no extension.
FORMATS = {"md": "markdown", "markdown": "markdown", "pdf": "pdf", "docx": "docx"}
SHOWN = {"markdown": "Markdown", "plain": "PlainText", "pdf": "Pdf", "docx": "Docx"}
PYTHON_ERRORS = {
    "ModelNotFound": FileNotFoundError, "InputTooLarge": ValueError, "UnsupportedFormat": ValueError, "Io": OSError,
    "ModelInvalid": RuntimeError, "ParseFailed": RuntimeError,
}


def text_source(spark: SparkSession, text: str, format: str = "plain") -> DataFrame:
    """One document from memory."""
    return spark.createDataFrame([(0, None, text, format)], RAW)


def detect_format(path: Column) -> Column:
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    out = F.lit("plain")
    for name, format in FORMATS.items():
        out = F.when(extension == name, format).otherwise(out)
    return out


def error(kind: str, message: Column, what: Column | None = None, limit: Column | None = None, actual: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind), message, what if what is not None else none, limit if limit is not None else none, actual if actual is not None else none).cast(ERROR)


def too_large(what: str, actual: Column, limit: int) -> Column:
    message = F.concat(F.lit(f"{what} input too large: "), actual.cast("string"), F.lit(f" > limit {limit}"))
    return error("InputTooLarge", message, F.lit(what), F.lit(limit), actual)


def spread(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows by the hash of their document, in as many partitions as the session shuffles into.

    Texts move once, before anything is derived from them; whatever works by document reuses that partitioning.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def accepts(path: str) -> bool:
    """Whether the file source takes a path: a file, also by way of a link, which reading then refuses."""
    return os.path.isfile(path)


def candidate_paths(folder: str) -> list[str]:
    """A folder's own regular files, sorted by the bytes of their paths; links and anything else are left out."""
    with os.scandir(folder) as entries:
        return sorted((e.path for e in entries if e.is_file(follow_symlinks=False)), key=os.fsencode)


def path_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of a file, or of a folder's own files; ordered by path where they are collected, not before.

    A missing path raises. Sizes are checked on the listing, so a file over the limit is never read. In a local folder links
    and all that is no regular file are skipped; given as the path itself they are errors.
    """
    local = path.removeprefix("file:")
    folder = os.path.isdir(local)
    if "://" not in path and not os.path.exists(local):
        raise FileNotFoundError(f"io error: {path}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if folder:
        # The listing holds one name a file of one folder; only names of what isn't a regular file are kept.
        with os.scandir(local) as entries:
            others = sorted(e.name for e in entries if not e.is_file(follow_symlinks=False))
        files = reader.load(path)
        if others:
            files = files.where(~F.regexp_extract("path", "([^/]+)$", 1).isin(others))
    else:
        if os.path.islink(local):
            raise OSError(f"io error: {path}: a symbolic link")
        if os.path.exists(local) and not stat.S_ISREG(os.lstat(local).st_mode):
            raise OSError(f"io error: {path}: not a regular file")
        files = reader.load(path)
    named = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    large = named.where(F.col("length") > MAX_INPUT_BYTES).select("path", too_large("file_source", F.col("length"), MAX_INPUT_BYTES).alias("error"))
    small = named.where(F.col("length") <= MAX_INPUT_BYTES)
    bad = small.where("NOT is_valid_utf8(content)").select("path", error("Io", F.lit("io error: stream did not contain valid UTF-8")).alias("error"))
    documents = small.where("is_valid_utf8(content)").select(
        F.xxhash64("path").alias("doc_id"), "path", F.col("content").cast("string").alias("text"), detect_format(F.col("path")).alias("format")
    )
    return documents, large.unionByName(bad)


def gate(raw: DataFrame, formats=("markdown", "plain")) -> DataFrame:
    """Adds `error`: null, or why the document can't be analysed. Size goes before format; a null text is empty."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    shown = F.element_at(F.create_map(*(F.lit(x) for pair in SHOWN.items() for x in pair)), F.col("format"))
    unsupported = error("UnsupportedFormat", F.concat(F.lit("unsupported format: "), F.coalesce(shown, "format", F.lit("unknown"))))
    allowed = F.coalesce(F.col("format").isin(*formats), F.lit(False))
    return raw.withColumn("error", F.when(size > MAX_INPUT_BYTES, too_large("input", size, MAX_INPUT_BYTES)).when(~allowed, unsupported))


def split_errors(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents without error, doc_id / path / error of the others); together they are the input."""
    return gated.where("error IS NULL").drop("error"), gated.where("error IS NOT NULL").select("doc_id", "path", "error")


def display(path: Column, failure: Column) -> Column:
    return F.concat(F.coalesce(F.concat(path, F.lit(": ")), F.lit("")), failure.getField("message"))


def raise_error(failure) -> None:
    """The Python exception that stands for an error row."""
    raise PYTHON_ERRORS[failure["kind"]](failure["message"])


def to_json(documents: DataFrame) -> DataFrame:
    """doc_id and the document as JSON."""
    return documents.select("doc_id", F.to_json(F.struct(*(c for c in documents.columns if c != "doc_id")), {"ignoreNullFields": "false"}).alias("json"))


def from_json(lines: DataFrame) -> DataFrame:
    """Documents from JSON, also older forms: detections that weren't written yet read as empty, or as false."""
    read = lines.select("doc_id", F.from_json("json", DOCUMENT_WIRE).alias("d")).select("doc_id", "d.*")
    arrays = ("negations", "modals", "reportings", "root_adverbials", "hearst_pairs")

    def sentence(s: Column) -> Column:
        out = s.withField("bare_assertion", F.coalesce(s.bare_assertion, F.lit(False)))
        for name in arrays:
            out = out.withField(name, F.coalesce(s[name], F.filter(s[name], lambda _: F.lit(False)), F.array()))
        return out

    return read.withColumn("sections", F.transform("sections", lambda sec: sec.withField("paragraphs", F.transform(sec.paragraphs, lambda p: p.withField("sentences", F.transform(p.sentences, sentence))))))
