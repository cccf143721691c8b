"""Sources and sinks: delimited text, archives, JSON documents, XML attachments, filing sets.

Archives are read as binary rows and opened inside tasks, so any store that Spark reaches will do.
A container that can't be opened gives an ``error`` instead of failing the job.
"""

from __future__ import annotations

import base64
import binascii
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTACHMENTS = "path string, filename string, content binary, error string"


def read_delimited(spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1", schema: str | None = None) -> DataFrame:
    """Delimited text with a header, all columns strings unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_with_unit_row(spark: SparkSession, path: str, date: str, date_format: str, missing: str = "#N/A") -> DataFrame:
    """A wide series file whose second line is not data: rows whose date doesn't parse go, columns
    become doubles and ``missing`` null."""
    raw = spark.read.option("header", True).csv(path)
    day = F.to_date(F.try_to_timestamp(F.col(f"`{date}`"), F.lit(date_format)))
    values = [F.expr(f"try_cast(nullif(`{c}`, '{missing}') as double)").alias(c) for c in raw.columns if c != date]
    return raw.select(day.alias("date"), *values).where("date is not null")


def to_long(wide: DataFrame, key: str, suffix: str, name: str, value: str) -> DataFrame:
    """Columns that end in ``suffix`` to rows; the name loses the suffix."""
    columns = [c for c in wide.columns if c.endswith(suffix)]
    long = wide.unpivot([key], [F.col(f"`{c}`").alias(c) for c in columns], name, value)
    return long.withColumn(name, F.substring(name, F.lit(1), F.length(name) - len(suffix)))


def _open(content: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content))


def read_zip_member(spark: SparkSession, path: str, member: str, columns: Sequence[str], sep: str = ";", encoding: str = "latin-1") -> DataFrame:
    """Rows of the archive member named by the regular expression ``member`` in every archive under
    ``path``; archives without it, or unreadable ones, give no rows (see ``zip_errors``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    with _open(content) as z:
                        for name in (n for n in z.namelist() if re.fullmatch(member, n)):
                            with z.open(name) as f:
                                for part in pd.read_csv(f, sep=sep, encoding=encoding, dtype=str, chunksize=50_000, keep_default_na=False, na_values=[""]):
                                    yield part.reindex(columns=list(columns)).assign(path=p)
                except zipfile.BadZipFile:
                    continue

    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"{schema}, path string")


def zip_errors(spark: SparkSession, path: str) -> DataFrame:
    """``(path, error)`` of archives that can't be opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = [(p, "BadZipFile") for p, c in zip(batch["path"], batch["content"]) if not zipfile.is_zipfile(io.BytesIO(c))]
            yield pd.DataFrame(bad, columns=["path", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, error string")


def read_json_documents(spark: SparkSession, path: str, schema: str, key_pattern: str, keys: Sequence[str]) -> DataFrame:
    """One JSON document per file, with keys taken from the file name by a pattern's groups."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    name = F.col("_metadata.file_name")
    return docs.select("*", *(F.regexp_extract(name, key_pattern, i + 1).alias(k) for i, k in enumerate(keys)))


def xml_attachments(text: bytes, tag: str, name: str, content: str) -> list[tuple[str, bytes]]:
    """Name and decoded content of every ``tag`` element, empty ones left out. A declared UTF-8 that
    the bytes don't keep is read as Latin-1; name spaces are ignored."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        root = ElementTree.fromstring(re.sub(rb"encoding=[\"']utf-8[\"']", b'encoding="ISO-8859-1"', text, count=1, flags=re.I))
    plain = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for element in root.iter():
        if plain(element) != tag:
            continue
        inside = {plain(c): c.text or "" for c in element.iter()}
        try:
            raw = base64.b64decode(inside.get(content, ""))
        except binascii.Error:
            continue
        if raw:
            out.append((inside.get(name, ""), raw))
    return out


def read_attachments(spark: SparkSession, path: str, tag: str, name: str, content: str, exclude: str = r"$^", inner: str = "attachments.xml", inner_suffix: str = ".zip") -> DataFrame:
    """Attachments of filing archives: from the largest XML member that ``exclude`` doesn't match, else
    from ``inner`` in a nested archive; else, or if unreadable, a row with an ``error``."""

    def one(raw: bytes) -> list[tuple[str, bytes]]:
        with _open(raw) as z:
            xml = [i for i in z.infolist() if i.filename.lower().endswith(".xml") and not re.search(exclude, i.filename)]
            if xml:
                return xml_attachments(z.read(max(xml, key=lambda i: i.file_size)), tag, name, content)
            for i in z.infolist():
                if i.filename.lower().endswith(inner_suffix):
                    with _open(z.read(i)) as nested:
                        if inner in nested.namelist():
                            return xml_attachments(nested.read(inner), tag, name, content)
        raise LookupError("no attachments found")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, raw in zip(batch["path"], batch["content"]):
                try:
                    rows = [(p, n, c, None) for n, c in one(raw)]
                except (zipfile.BadZipFile, ElementTree.ParseError, LookupError) as e:
                    rows = [(p, None, None, type(e).__name__)]
                yield pd.DataFrame(rows, columns=["path", "filename", "content", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ATTACHMENTS)


def read_xml_rows(spark: SparkSession, path: str, tag: str, schema: str, encoding: str = "UTF-8", corrupt: str = "_broken") -> DataFrame:
    """A row per ``tag`` element of the XML files under ``path``, however large: files are split between
    elements and only the named columns are parsed. Of Spark's two parsers it takes the older one, which
    splits files and keeps to ``encoding``, whatever a file declares. Name spaces are ignored. An element that doesn't parse or
    doesn't fit ``schema`` is a row with its text in ``corrupt`` and nulls otherwise."""
    reader = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("encoding", encoding).option("useLegacyXMLParser", True)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).schema(f"{schema}, {corrupt} string").load(path)


def read_xml_attachments(spark: SparkSession, path: str, tag: str, name: str, content: str) -> DataFrame:
    """``ATTACHMENTS`` of plain XML files: a row per ``tag`` element with content, decoded by Spark's XML
    source and column functions. Bytes are read as Latin-1, which no file breaks, and names then as UTF-8, unless
    one of their file isn't. Files with a broken element or without any are read again, whole, by
    ``xml_attachments``; those that can't be read at all are a row with an ``error``."""
    rows = read_xml_rows(spark, path, tag, f"`{name}` string, `{content}` string", "ISO-8859-1").withColumn("path", F.col("_metadata.file_path"))
    utf8 = F.try_validate_utf8(F.encode(name, "ISO-8859-1").cast("string"))
    # Spark doesn't read the column of broken elements alone, so that the name is asked for with it
    broken = F.col("_broken").isNotNull() & F.coalesce(F.length(name) >= 0, F.lit(True))
    read = rows.groupBy("path").agg(F.max(broken).alias("odd"), F.max(F.col(name).isNotNull() & utf8.isNull()).alias("latin"))
    files = spark.read.format("binaryFile").load(path)
    state = files.select("path").join(read, "path", "left")
    sound = rows.join(state.where("not odd"), "path")
    named = F.coalesce(F.when(F.col("latin"), F.col(name)).otherwise(utf8), F.lit(""))
    decoded = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    good = sound.select("path", named.alias("filename"), decoded.alias("content"), F.lit(None).cast("string").alias("error")).where(F.length("content") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, raw in zip(batch["path"], batch["content"]):
                try:
                    out = [(p, n, c, None) for n, c in xml_attachments(raw, tag, name, content)]
                except ElementTree.ParseError as e:
                    out = [(p, None, None, type(e).__name__)]
                yield pd.DataFrame(out, columns=["path", "filename", "content", "error"])

    again = files.join(state.where("coalesce(odd, true)").select("path"), "path", "left_semi").select("path", "content")
    return good.unionByName(again.mapInPandas(run, ATTACHMENTS))


def literal_map(spark: SparkSession, *parts: dict[int, str]) -> DataFrame:
    """Literal ``(entity_id, name)`` relations; a later part wins."""
    merged = {k: v for part in parts for k, v in part.items()}
    return spark.createDataFrame(sorted(merged.items()), "entity_id long, name string")


def not_yet_done(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose keys have no result yet: incremental runs by anti-join."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append results under a run id, replacing those of the same run, so that reruns don't double."""
    rows = df.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_keyed_json(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    df.write.mode("overwrite").partitionBy(*keys).json(path)


def read_yearly(spark: SparkSession, path: str, member: str, columns: Sequence[str], year: str = r"(\d{4})", **options: str) -> DataFrame:
    """``read_zip_member`` of archives of several years in one relation, ``year`` taken from the archive's name."""
    rows = read_zip_member(spark, path, member, columns, **options)
    return rows.withColumn("year", F.regexp_extract(F.element_at(F.split("path", "/"), -1), year, 1).cast("int"))


def _plain(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _latin(raw: bytes) -> ElementTree.Element | None:
    """An XML document whose declared UTF-8 is Latin-1, as such files are; None if it can't be read."""
    try:
        return ElementTree.fromstring(re.sub(rb"encoding=[\"']utf-8[\"']", b'encoding="ISO-8859-1"', raw, count=1, flags=re.I))
    except ElementTree.ParseError:
        return None


def _field(container: ElementTree.Element, tag: str) -> bytes | None:
    text = next((c.text for c in container if _plain(c) == tag), None)
    try:
        return base64.b64decode((text or "").strip()) or None
    except binascii.Error:
        return None


def filing_item(package: bytes, field: str, modern: tuple[str, str, str], legacy: tuple[str, str, str, str, str]) -> bytes | None:
    """One item's file out of a filing package, or None.

    ``modern`` is the part of an XML member's name, the block and its description: the block's first
    description holds ``field``. Else ``legacy``, the suffix of an inner archive, its member, the
    element, and the tag and value that mark the item's."""
    with _open(package) as z:
        part, block, description = modern
        name = next((n for n in z.namelist() if n.lower().endswith(".xml") and part in n.lower()), None)
        root = _latin(z.read(name)) if name else None
        first = next((e for e in root.iter() if _plain(e) == block), None) if root is not None else None
        inside = next((c for c in first if _plain(c) == description), None) if first is not None else None
        found = _field(inside, field) if inside is not None else None
        if found is not None:
            return found
        suffix, member, element, tag, value = legacy
        name = next((n for n in z.namelist() if n.lower().endswith(suffix)), None)
        if name is None:
            return None
        try:
            with _open(z.read(name)) as nested:
                root = _latin(nested.read(member))
        except (zipfile.BadZipFile, KeyError):
            return None
    for e in root.iter() if root is not None else ():
        if _plain(e) == element and next((c.text for c in e if _plain(c) == tag), None) == value:
            return _field(e, field)
    return None


def read_items(spark: SparkSession, path: str, field: str, modern: tuple[str, str, str], legacy: tuple[str, str, str, str, str]) -> DataFrame:
    """``(path, content, error)`` of ``filing_item`` for every package under ``path``; a package without
    the item has a null content, one that can't be opened an ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, raw in zip(batch["path"], batch["content"]):
                try:
                    row = (p, filing_item(raw, field, modern, legacy), None)
                except zipfile.BadZipFile:
                    row = (p, None, "BadZipFile")
                yield pd.DataFrame([row], columns=["path", "content", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, content binary, error string")


def second_pass(results: DataFrame, keys: Sequence[str], again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``results`` with the rows that have an ``error`` replaced by those of ``again`` for their keys, once:
    what still fails keeps its error."""
    failed = results.where("error is not null").select(*keys).distinct()
    return results.join(failed, list(keys), "left_anti").unionByName(again(failed).select(*results.columns))


def write_table(df: DataFrame, path: str, *sort: str) -> None:
    """Replace a table; rows of a file are sorted by ``sort``, which narrows what later filters read."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(path)


def materialized(spark: SparkSession, path: str, work: DataFrame, keys: Sequence[str], make: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path`` with a result for every key of ``work``: only keys that it lacks are made,
    all of them with ``force``."""
    try:
        done = None if force else spark.read.parquet(path)
    except AnalysisException:
        done = None
    if done is None:
        make(work).write.mode("overwrite").parquet(path)
    else:
        todo = not_yet_done(work, done, keys)
        if not todo.isEmpty():
            make(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def pdf_lines(document) -> list[tuple[int, int, str, float, bool]]:
    """``(line_no, page, text, size, bold)`` of an open PDF of the ``pymupdf`` library: a line's spans
    together, its largest size to one digit, bold if any span is; blank lines are left out."""
    out: list[tuple[int, int, str, float, bool]] = []
    for number, page in enumerate(document):
        for block in page.get_text("dict")["blocks"]:
            for line in block.get("lines", ()):
                spans = line["spans"]
                text = "".join(s["text"] for s in spans).strip()
                if text:
                    bold = any(s["flags"] & 16 or "bold" in s["font"].lower() for s in spans)
                    out.append((len(out), number, text, round(max(s["size"] for s in spans), 1), bold))
    return out


def read_pdfs(spark: SparkSession, path: str, outline: bool = False) -> DataFrame:
    """Lines, or with ``outline`` the entries ``(seq, level, title, page)``, of the PDFs under ``path``. Needs
    the ``pymupdf`` library on the executors; a file that can't be read gives an ``error``."""
    names = ["seq", "level", "title", "page"] if outline else ["line_no", "page", "text", "size", "bold"]
    kinds = "seq int, level int, title string, page int" if outline else "line_no int, page int, text string, size double, bold boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for batch in batches:
            for p, raw in zip(batch["path"], batch["content"]):
                try:
                    with pymupdf.open(stream=raw, filetype="pdf") as d:
                        rows = [(i, *e[:3]) for i, e in enumerate(d.get_toc())] if outline else pdf_lines(d)
                    yield pd.DataFrame(rows, columns=names).assign(path=p, error=None)
                except (RuntimeError, ValueError) as e:
                    yield pd.DataFrame([[None] * len(names)], columns=names).assign(path=p, error=type(e).__name__)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"{kinds}, path string, error string")
