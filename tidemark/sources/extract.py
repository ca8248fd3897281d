"""Text of files: txt, md, docx, odt, rtf, and pdf behind cheap checks and a pluggable parser.

Every file gives a text or a reason, never an error; bytes come from Spark's binaryFile source.
"""

from __future__ import annotations

import io
import re
import signal
import threading
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import ACCENTED, FOLDED
from tidemark.operators.scratch import PIECE, reachable, tidy
from tidemark.operators.site import EXTENSIONS

#: Bounds of what is parsed, and the seconds that one file may take.
PARSE_SECONDS = 20
EDGE, COMPLEX_FROM, MOST_STREAMS, MEMORY_FACTOR, MOST_MEMORY = 65536, 2 << 20, 1500, 120, 1280
_BREAKS = re.compile(rb"</(?:w:p|w:tr|text:p|text:h|table:table-row)>|<(?:w:br|text:line-break)[^>]*/>")
_TABS = re.compile(rb"<(?:w:tab|text:tab|text:s)\b[^>]*/>")
_TAGS = re.compile("<[^>]*>")
#: Bytes that the parts of a packed file may unpack to.
MOST_UNPACKED = 256 << 20
#: The parts of a docx file that hold text.
DOCX_PARTS = ("word/document.xml", *(f"word/{kind}{i}.xml" for kind in ("header", "footer") for i in (1, 2, 3)))


def _text_of_xml(data: bytes) -> str:
    import html

    return html.unescape(_TAGS.sub("", _TABS.sub(b" ", _BREAKS.sub(b"\n", data)).decode("utf-8", "replace"))).strip()


def from_zip(data: bytes, parts: tuple[str, ...], kind: str) -> tuple[str | None, str | None]:
    """Text of a packed file's parts. An encrypted, damaged or endless one has a reason instead."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names, found, left = set(z.namelist()), [], MOST_UNPACKED
            for p in parts:
                if p in names:
                    with z.open(p) as f:
                        part = f.read(left + 1)
                    left -= len(part)
                    if left < 0:
                        return None, f"{kind}_unpacks_too_large"
                    found.append(_text_of_xml(part))
    except Exception:  # a damaged file may raise anything, and one file must not end the job
        return None, f"{kind}_zip_open_failed"
    if not found and kind == "odt":
        return None, "odt_no_content"
    text = "\n".join(t for t in found if t)
    return (text, None) if text else (None, f"{kind}_empty")


def from_rtf(data: bytes) -> tuple[str | None, str | None]:
    raw = data.decode("latin-1")
    raw = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) & 0xFFFF), raw)
    raw = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), raw)
    raw = re.sub(r"\\(?:par|line|tab)\b ?", " ", raw)
    raw = re.sub(r"\\[a-zA-Z]+-?\d* ?|\\.", "", raw)
    text = " ".join(re.sub(r"[{}]", "", raw).split())
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return (text, None) if text else (None, "rtf_empty_after_strip")


def preflight(data: bytes | None, most_mb: int) -> str | None:
    """Why a PDF can't or shouldn't be parsed, by its size and its first and last 64 KB."""
    if data is None:
        return "file_not_readable"
    size = len(data)
    if not size:
        return "file_size_unknown"
    mb = -(-size // (1 << 20))
    if size > most_mb << 20:
        return f"file_too_large_{mb}_mb"
    head, tail = data[:EDGE], data[-EDGE:]
    if not head.startswith(b"%PDF-"):
        return "pdf_header_missing"
    if b"%%EOF" not in tail:
        return "pdf_eof_missing_corrupt"
    if size > COMPLEX_FROM and head.count(b"/Length ") + tail.count(b"/Length ") > MOST_STREAMS:
        return "pdf_too_complex_skipped"
    if max(256, mb * MEMORY_FACTOR) > MOST_MEMORY:
        return f"pdf_too_big_for_memory_{mb}_mb"
    return None


class ParseTimeout(Exception):
    pass


def _within(seconds: int, parse: Callable[[bytes], str], data: bytes) -> str:
    """parse(data), ended after so many seconds; without a limit where signals cannot be had (off the main thread)."""
    if threading.current_thread() is not threading.main_thread():
        return parse(data)

    def stop(*_):
        raise ParseTimeout

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return parse(data)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract(kind: str, data: bytes | None, most_mb: int = 50, parse_pdf: Callable[[bytes], str] | None = None) -> tuple[str | None, str | None]:
    """(text, reason): one of them is None."""
    kind = kind.lower()
    if kind == "pdf":
        if reason := preflight(data, most_mb):
            return None, reason
        if parse_pdf is None:
            return None, "pdf_parser_missing"
        try:
            text = _within(PARSE_SECONDS, parse_pdf, data)
        except ParseTimeout:
            return None, f"parse_timeout_after_{PARSE_SECONDS}s"
        except Exception as e:  # a parser may raise anything, and one file must not end the job
            return None, "pdf_encrypted_or_restricted" if "secured pdf" in str(e).lower() or "encrypted" in str(e).lower() else f"parse_failed:{e}"[:200]
        return (text, None) if text.strip() else (None, "empty_textlayer_image_only")
    if data is None:
        return None, "file_not_readable"
    if kind in ("txt", "md"):
        text = data.decode("utf-8", "replace")
        return (text, None) if text.strip() else (None, "empty_file")
    if kind == "docx":
        return from_zip(data, DOCX_PARTS, kind)
    if kind == "odt":
        return from_zip(data, ("content.xml",), kind)
    if kind == "rtf":
        return from_rtf(data) if data else (None, "rtf_empty_file")
    return None, f"unsupported_extension_{kind}"


def pieces(values: Iterable, size: Callable) -> Iterator[list]:
    """Values in order, in lists of PIECE bytes and the last value: what a task holds doesn't grow with its rows.

    What a list took goes back to the system once it is handed on.
    """
    out, held = [], 0
    for v in values:
        out.append(v)
        held += size(v)
        if held >= PIECE:
            yield out
            out, held = [], 0
            tidy()
    if out:
        yield out
    tidy()


def extracted(kind: Column, content: Column, most_mb: int = 50, parse_pdf: Callable[[bytes], str] | None = None) -> Column:
    if (spark := SparkSession.getActiveSession()) is not None:
        reachable(spark)

    @F.pandas_udf("struct<text string, reason string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, contents in batches:
            each = (extract(k or "", None if c is None else bytes(c), most_mb, parse_pdf) for k, c in zip(kinds, contents, strict=True))
            for some in pieces(each, lambda e: len(e[0] or "")):
                yield pd.DataFrame(some, columns=["text", "reason"])

    return run(kind, content)


def _kinds_glob(kinds: tuple[str, ...]) -> str:
    """A file-name pattern of extensions in any case."""
    return "{" + ",".join("*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in k) for k in kinds) + "}"


def listed(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, length, modificationTime, content of the files under a folder; what a query does not select is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def read_files(spark: SparkSession, folder: str, most_mb: int = 50, parse_pdf: Callable[[bytes], str] | None = None, kinds: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, size, text, reason of every file under a folder.

    Only files of the kinds, and no larger than what is parsed, are opened: a listing of the folder gives the others
    their reasons. Kind and size reach the scan; each task opens its own files. Files of no bytes have no row, as
    Spark's file sources leave them out.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    most = most_mb << 20
    opened = listed(spark, folder, _kinds_glob(kinds)).where(F.col("length") <= most)
    opened = opened.withColumn("e", extracted(kind, F.col("content"), most_mb, parse_pdf)).select("path", F.col("length").alias("size"), "e.text", "e.reason")
    mb = F.ceil(F.col("length") / (1 << 20)).cast("string")
    why = F.when(~kind.isin(*kinds), F.concat(F.lit("unsupported_extension_"), kind)).otherwise(F.concat(F.lit("file_too_large_"), mb, F.lit("_mb")))
    closed = listed(spark, folder).where(~kind.isin(*kinds) | (F.col("length") > most))
    return opened.unionByName(closed.select("path", F.col("length").alias("size"), F.lit(None).cast("string").alias("text"), why.alias("reason")))


def below(path: Column, folder: str) -> Column:
    """A path as it is below a folder."""
    return F.regexp_replace(path, f"^.*{re.escape(folder.split('://')[-1].strip('/'))}/?", "")


def public_markers(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder) of every folder that holds a file named .public; no file is opened.

    Spark's readers leave out names with a leading dot, so the file system itself is asked, level by level as deep as there
    are files; only markers come to the driver.
    """
    root = folder.rstrip("/")
    depth = listed(spark, folder).agg(F.max(F.size(F.split(below(F.col("path"), folder), "/")))).first()[0] or 1
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = files.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(s.getPath().getParent()) for level in range(depth) for s in system.globStatus(files.Path(f"{root}/{'*/' * level}.public")) or []]
    return spark.createDataFrame([(p,) for p in found], "path string").select(below(F.col("path"), folder).alias("path"))


def site_files(spark: SparkSession, folder: str, most_mb: int = 50, parse_pdf: Callable[[bytes], str] | None = None, markers: DataFrame | None = None) -> DataFrame:
    """path (below the folder), size, text, reason, public of every file: public if a folder above holds a marker (markers: path)."""
    found = read_files(spark, folder, most_mb, parse_pdf).withColumn("path", below(F.col("path"), folder))
    marked = (public_markers(spark, folder) if markers is None else markers).select(F.col("path").alias("folder")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    public = found.select("path", F.explode(above).alias("folder")).join(marked, "folder", "left_semi").select("path").distinct().withColumn("public", F.lit(True))
    return found.join(public, "path", "left").withColumn("public", F.coalesce("public", F.lit(False)))


REASONS = (("file_too_large_", "The file is too large"), ("pdf_too_big_for_memory_", "The PDF needs too much memory"), ("parse_failed", "The PDF could not be parsed"), ("parse_timeout_", "The PDF took too long"), ("unsupported_extension_", "This kind of file is not indexed"), ("empty_", "The file has no text"), ("docx_", "The document is empty or damaged"), ("odt_", "The document is empty or damaged"), ("rtf_", "The document is empty or damaged"), ("pdf_", "The PDF is damaged or too complex"))


def humanized(reason: Column) -> Column:
    out = F.when(reason.isNull(), F.lit(None))
    for prefix, text in REASONS:
        out = out.when(reason.startswith(prefix), text)
    return out.otherwise(reason)


def register(spark: SparkSession) -> list[str]:
    """Makes table functions known to the session's SQL, for LATERAL joins; returns their names.

    extract_text(kind, content): text, reason of a file. text_words(text): pos, tok of a text's folded words; nulls for one without.
    """
    reachable(spark)

    @F.udtf(returnType="text string, reason string")
    class ExtractText:
        def eval(self, kind: str, content: bytes):
            yield extract(kind or "", None if content is None else bytes(content))

    spark.udtf.register("extract_text", ExtractText)
    folded = f"replace(translate(lower(coalesce(s, '')), '{ACCENTED}', '{FOLDED}'), 'ß', 'ss')"
    words = f"filter(split({folded}, r'[^\\p{{L}}\\p{{N}}]+'), t -> t <> '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_words(s STRING) RETURNS TABLE(pos INT, tok STRING) RETURN SELECT pos, col FROM (SELECT posexplode_outer({words}))")
    return ["extract_text", "text_words"]
