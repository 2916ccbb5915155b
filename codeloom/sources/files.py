"""File sources: discovery, decoding, routing by extension, line numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions.folds import bind
from ..functions.lexing import lines_of, unix_newlines

FINDING = T.StructType(
    [
        T.StructField("function", T.StringType()),
        T.StructField("vulnerability_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("code_snippet", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("remediation", T.StringType()),
    ]
)
REPORT = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("findings", T.ArrayType(FINDING)),
        T.StructField("total_vulnerabilities", T.LongType()),
    ]
)
BUILD_RECORD = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("compiler", T.StringType()),
        T.StructField("argv", T.ArrayType(T.StringType())),
    ]
)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)


def language(path: Column) -> Column:
    """Language by extension; null when the extension is not supported."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    by_lang: dict[str, list[str]] = {}
    for e, lang in dims.LANGUAGES.items():
        by_lang.setdefault(lang, []).append(e)
    for lang, exts in by_lang.items():
        out = F.when(ext.isin(exts), lang).otherwise(out)
    return out


def scan_source_files(
    spark: SparkSession, root: str, extensions: list[str] | None = None
) -> DataFrame:
    """Files below ``root`` as ``path, content`` bytes; pruned while listing."""
    exts = ",".join(extensions or dims.LANGUAGES)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{{{exts}}}")
        .load(root)
        .select("path", "content")
    )


def scan_preprocessed(spark: SparkSession, root: str) -> DataFrame:
    return scan_source_files(spark, root, ["i"])


def scan_text_files(spark: SparkSession, root: str) -> DataFrame:
    """Whole UTF-8 files, one row each."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("wholetext", "true")
        .text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


#: What the bytes 0x80 to 0x9F, control characters in Latin-1, stand for in code page 1252; five of them for nothing.
_CONTROLS = [chr(i) for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "ignore")]
_CP1252 = "".join(c.encode("latin-1").decode("cp1252") for c in _CONTROLS)
#: A 16-bit unit, or two that belong together, in hexadecimal digits.
_UNITS = r"\G(?:(?!D[89A-F])[0-9A-F]{4}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})"


def _utf16(raw: Column, latin: Column) -> Column:
    """``struct(content, encoding)`` of bytes that are UTF-16, else null.

    A byte-order mark decides, or else on which side of the pairs zero bytes stand: text has far more
    of its characters below U+0100 than a wrong order of the bytes gives.
    """

    def valid(digits: Column) -> Column:
        return F.regexp_replace(digits, _UNITS, "") == ""

    def low(high_byte_first: bool) -> Column:
        """Pairs with a zero high byte."""
        one = "\x00[^\x00]" if high_byte_first else "[^\x00]\x00"
        return F.length(F.regexp_replace(latin, rf"(?s)\G(?:({one})|..)", "$1"))

    def decoded(order: str) -> Column:
        # The digits of a little-endian text are put in order, to be checked alike.
        digits = F.hex(raw)
        if order == "LE":
            digits = F.regexp_replace(digits, "(..)(..)", "$2$1")
        content = F.regexp_replace(F.decode(raw, f"UTF-16{order}"), "^\ufeff", "")
        return F.when(valid(digits), F.struct(content.alias("content"), F.lit(f"utf-16-{order.lower()}").alias("encoding")))

    little = latin.startswith("\u00ff\u00fe")
    big = latin.startswith("\u00fe\u00ff")
    half = F.length(latin) / 2
    found = (
        F.when(little, decoded("LE"))
        .when(big, decoded("BE"))
        .when(latin.contains("\x00") & (low(False) > half), decoded("LE"))
        .when(latin.contains("\x00") & (low(True) > half), decoded("BE"))
    )
    return F.when((F.length(latin) % 2 == 0) & (little | big | latin.contains("\x00")), found)


def decode_with_fallback(raw: Column) -> Column:
    """``struct(content, encoding)``: UTF-16 by its mark or zero bytes, UTF-8 if valid, code page 1252 if
    bytes stand for its characters that Latin-1 has control characters for, else Latin-1.

    A zero byte is valid UTF-8 but no text, so UTF-16 is looked for first; a byte-order mark is no content.
    """

    def of(latin: Column) -> Column:
        as_text = raw.cast("string")
        utf8 = F.is_valid_utf8(as_text)
        windows = latin.rlike("[\x80-\x9f]") & ~latin.rlike("[\x81\x8d\x8f\x90\x9d]")
        simple = F.struct(
            F.when(utf8, F.regexp_replace(as_text, "^\ufeff", ""))
            .when(windows, F.translate(latin, "".join(_CONTROLS), _CP1252))
            .otherwise(latin)
            .alias("content"),
            F.when(utf8, "utf-8").when(windows, "cp1252").otherwise("latin1").alias("encoding"),
        )
        return F.coalesce(_utf16(raw, latin), simple)

    return F.when(raw.isNotNull(), bind(F.decode(raw, "ISO-8859-1"), of))


def source_table(scanned: DataFrame) -> DataFrame:
    """``path, content`` bytes to the ``files`` table.

    The id is a hash of the path, so it needs no shuffle and is stable from
    run to run.  Undecodable files keep a row with ``error`` set.
    """
    return (
        scanned.select("path", decode_with_fallback(F.col("content")).alias("d"))
        .select("path", "d.*")
        .select(
            F.xxhash64("path").alias("file_id"),
            "path",
            extension(F.col("path")).alias("ext"),
            language(F.col("path")).alias("lang"),
            unix_newlines(F.col("content")).alias("content"),
            "encoding",
            file_error(F.col("path"), F.col("content")).alias("error"),
        )
    )


def file_error(path: Column, content: Column) -> Column:
    """Why a file is set aside, or null: unsupported, unreadable, not text."""
    return (
        F.when(language(path).isNull(), "unsupported extension")
        .when(content.isNull(), "unreadable")
        .when(content.contains("\x00"), "not text")
    )


def quarantine(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): a bad file never stops a scan."""
    marked = files.withColumn("error", file_error(F.col("path"), F.col("content")))
    return marked.where(F.col("error").isNull()), marked.where(F.col("error").isNotNull())


def unsupported(spark: SparkSession, files: DataFrame) -> DataFrame:
    return files.withColumn("ext", extension(F.col("path"))).join(
        F.broadcast(dims.languages(spark)), "ext", "left_anti"
    )


def number_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line, counted from one."""
    return files.select(
        key, F.posexplode(lines_of(unix_newlines(F.col(text)))).alias("i", "line")
    ).select(key, (F.col("i") + 1).alias("ln"), "line")


def read_findings(reports: DataFrame, column: str = "value") -> DataFrame:
    """Finding rows out of report JSON."""
    return (
        reports.select(F.from_json(F.col(column), REPORT).alias("r"))
        .select(F.col("r.file").alias("file"), F.explode("r.findings").alias("f"))
        .select("file", "f.*")
    )


def read_findings_json(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_findings`, from written report files."""
    return read_findings(read_report_files(spark, path))


def read_report_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, value`` of the published reports below ``path``."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.analysis.json").text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), "value")


def scan_build_records(records: DataFrame, column: str = "record") -> DataFrame:
    return records.select(F.from_json(F.col(column), BUILD_RECORD).alias("r")).select("r.*")
