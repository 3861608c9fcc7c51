"""Raw files to text records.

Text and DOCX files are read here. PDF pages, OCR and anything else that needs a library enter as an
``extractor`` supplied by the caller; the rules that turn page content into records are native.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill import fixed, schema
from corpusmill.functions.text import posix_path, strip, visual_type
from corpusmill.session import ship_package

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TEXT_SUFFIXES = [".txt", ".md", ".csv", ".log"]
PDF_TEXT_MIN = 50

# extractor(path, content) -> one dict per record with the fields of schema.EXTRACTED
Extractor = Callable[[str, bytes], list[dict]]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def scan_files(spark: SparkSession, root: str, suffixes: list[str] = fixed.CORPUS_SUFFIXES) -> DataFrame:
    """(path, modificationTime, length, content) of every file below ``root`` with a known suffix."""
    pattern = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s[1:]) for s in suffixes) + "}"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


def path_columns(path: Column, root: str) -> dict[str, Column]:
    """category, subcategory and filename from the folders between ``root`` and the file."""
    clean = F.regexp_replace(posix_path(path), "^[a-z]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    inside = clean.startswith(base)
    parts = F.split(F.when(inside, F.substring(clean, F.lit(len(base) + 1), F.length(clean))).otherwise(clean), "/")
    depth = F.size(parts)
    nested = inside & (depth > 1)
    return {
        "source": clean,
        "filename": F.element_at(parts, -1),
        "category": F.when(nested, F.element_at(parts, 1)).otherwise("unknown"),
        "subcategory": F.when(
            inside & (depth > 2), F.array_join(F.slice(parts, 2, F.greatest(depth - 2, F.lit(0))), "/")
        ).otherwise(""),
    }


def decode_text(content: Column) -> Column:
    """UTF-8 if valid and not blank, else the Vietnamese code page, else Latin-1."""

    @F.pandas_udf(T.StringType())
    def legacy(raw: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            if data is None:
                return None
            for codec in ("cp1258", "iso-8859-1"):
                try:
                    text = bytes(data).decode(codec)
                except UnicodeDecodeError:
                    continue
                if text.strip():
                    return text
            return bytes(data).decode("utf-8", errors="ignore")

        return raw.map(one)

    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(utf8, legacy(F.when(utf8.isNull(), content)))


def text_records(files: DataFrame) -> DataFrame:
    """One record per non-blank text file; line ends are unified as on text reading."""
    text = F.regexp_replace(decode_text(F.col("content")), r"\r\n?", "\n")
    rows = files.where(suffix(F.col("path")).isin(TEXT_SUFFIXES)).select("path", strip(text).alias("text"))
    record = F.struct(
        F.lit(0).alias("rec_no"), "text", F.lit(0).alias("page"), F.lit("txt").alias("kind"), F.lit("text").alias("block_type"),
        F.lit(None).cast("array<double>").alias("bbox"),
        F.lit(None).cast(schema.TABLE).alias("table_data"),
        F.lit(None).cast(schema.IMAGE).alias("image_info"),
    )
    return rows.where(F.col("text") != "").select("path", record.alias("r")).select("path", "r.*")


def _runs(node: ElementTree.Element) -> str:
    marks = {"t": None, "tab": "\t", "br": "\n", "cr": "\n"}
    found = (n for n in node.iter() if n.tag.startswith(_WORD) and n.tag[len(_WORD):] in marks)
    return "".join(n.text or "" if n.tag == _WORD + "t" else marks[n.tag[len(_WORD):]] for n in found)


def read_docx(path: str, content: bytes) -> list[dict]:
    """Paragraphs in body order as one record, then one record per table that is not empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_WORD + "body")
    paragraphs, tables = [], []
    for child in body if body is not None else []:
        if child.tag == _WORD + "p":
            paragraphs.append(_runs(child).strip())
        elif child.tag == _WORD + "tbl":
            grid = [
                ["\n".join(_runs(p) for p in cell.findall(_WORD + "p")).strip() for cell in row.findall(_WORD + "tc")]
                for row in child.findall(_WORD + "tr")
            ]
            tables.append([row for row in grid if any(row)])
    text = "\n".join(p for p in paragraphs if p)
    records = [{"text": text, "page": 0, "kind": "docx", "block_type": "text"}] if text else []
    for number, rows in enumerate(t for t in tables if t):
        records.append({
            "text": "\n".join(" | ".join(c for c in row if c) for row in rows),
            "page": 0, "kind": "docx_table", "block_type": "table",
            "table_data": {"table_index": number, "headers": rows[0], "rows": rows, "page": 0},
        })
    return records


def extracted_records(files: DataFrame, extractor: Extractor, suffixes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of the files an extractor handles; one bad file does not stop the rest."""
    ship_package(files.sparkSession)
    names = [f.name for f in schema.EXTRACTED.fields]
    out = T.StructType([T.StructField("path", T.StringType()), *schema.EXTRACTED.fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    for number, record in enumerate(extractor(path, bytes(content))):
                        rows.append((path, *({"rec_no": number, **record}.get(n) for n in names), None))
                except Exception as problem:
                    rows.append((path, *([None] * len(names)), f"{type(problem).__name__}: {problem}"[:500]))
            yield pd.DataFrame(rows, columns=["path", *names, "error"]).astype(object)

    wanted = files.where(suffix(F.col("path")).isin(suffixes)).select("path", "content")
    result = wanted.mapInPandas(run, out)
    return result.where(F.col("error").isNull()).drop("error"), result.where(F.col("error").isNotNull()).select("path", "error")


def read_corpus(
    spark: SparkSession, root: str, suffixes: list[str] = fixed.CORPUS_SUFFIXES, pages: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of every file below ``root``: records with source, category and file name; failures with path and error.

    ``pages`` holds (path, page content as in schema.PAGE) for PDF files, from the caller's library. A PDF file without a
    page there is a failure, and so is a file that cannot be read or gives no record; no file goes without trace.
    """
    files = scan_files(spark, root, suffixes)
    docx, broken = extracted_records(files, read_docx, [".docx"])
    records = text_records(files).unionByName(docx)
    known = ["path", "error"]
    if pages is not None:
        records = records.unionByName(page_records(pages))
        unread = files.select("path").where(suffix(F.col("path")) == ".pdf").join(
            pages.select(posix_path(F.col("path")).alias("_p")).distinct(), F.regexp_replace(posix_path(F.col("path")), "^[a-z]+:/+", "/")
            == F.regexp_replace("_p", "^[a-z]+:/+", "/"), "left_anti",
        )
    else:
        unread = files.select("path").where(suffix(F.col("path")) == ".pdf")
    silent = files.select("path").where(suffix(F.col("path")) != ".pdf").join(records.select("path").distinct(), "path", "left_anti").join(
        broken.select("path"), "path", "left_anti"
    )
    failures = (
        broken.select(*known)
        .unionByName(unread.withColumn("error", F.lit("no page content given")))
        .unionByName(silent.withColumn("error", F.lit("no text")))
    )
    return records.select(
        *[c.alias(n) for n, c in path_columns(F.col("path"), root).items()], *[f.name for f in schema.EXTRACTED.fields]
    ), failures


def load_records(
    spark: SparkSession, root: str, suffixes: list[str] = fixed.CORPUS_SUFFIXES, pages: DataFrame | None = None
) -> DataFrame:
    """The records of ``read_corpus`` alone."""
    return read_corpus(spark, root, suffixes, pages)[0]


def reading_order(blocks: Column, page_width: Column) -> Column:
    """Text of page blocks top to bottom; with two clear columns, the left one first."""
    texts = F.filter(blocks, lambda b: (b["block_type"] == 0) & (strip(b["text"]) != ""))

    def joined(some: Column) -> Column:
        keyed = F.transform(
            some, lambda b: F.struct(F.bround(b["y0"] / 10).alias("y"), b["x0"].alias("x"), strip(b["text"]).alias("t"))
        )
        # Blocks on the same spot keep their order: the position breaks the tie.
        placed = F.transform(keyed, lambda k, i: F.struct(k["y"].alias("y"), k["x"].alias("x"), i.alias("i"), k["t"].alias("t")))
        return F.array_join(F.transform(F.array_sort(placed), lambda k: k["t"]), "\n")

    starts = F.array_sort(F.transform(texts, lambda b: b["x0"]))
    middle = F.get(starts, F.floor(F.size(starts) / 2).cast("int"))
    left = F.filter(texts, lambda b: b["x0"] < middle)
    right = F.filter(texts, lambda b: b["x0"] >= middle)
    gap = F.array_min(F.transform(right, lambda b: b["x0"])) - F.array_max(F.transform(left, lambda b: b["x1"]))
    columns = (F.size(texts) > 4) & (F.size(left) >= 2) & (F.size(right) >= 2) & (gap > page_width * 0.15)
    return strip(
        F.when(columns, F.concat(joined(left), F.lit("\n"), joined(right))).otherwise(joined(texts))
    )


def table_text(rows: Column) -> Column:
    """Rows as 'a | b' lines without empty cells and empty lines."""
    as_lines = F.transform(rows, lambda r: F.array_join(F.filter(r, lambda c: c != ""), " | "))
    return F.array_join(F.filter(as_lines, lambda s: s != ""), "\n")


def page_records(pages: DataFrame) -> DataFrame:
    """Records of PDF pages: the page text, one per sizeable table, one per usable picture."""
    ordered = reading_order(F.col("blocks"), F.col("width"))
    plain = strip(F.coalesce("plain_text", F.lit("")))
    own = F.when(F.length(F.coalesce(ordered, F.lit(""))) >= 10, ordered).otherwise(plain)
    scanned = (F.length(own) < PDF_TEXT_MIN) & F.col("ocr_text").isNotNull()
    base = pages.withColumn("_scan", scanned).withColumn("_text", F.when(scanned, F.col("ocr_text")).otherwise(own))
    empty_tables, empty_images = F.array().cast(T.ArrayType(schema.TABLE)), F.array().cast(T.ArrayType(schema.IMAGE))
    base = base.withColumn("_tables", F.when(F.col("_scan"), empty_tables).otherwise(F.coalesce("tables", empty_tables)))
    base = base.withColumn("_images", F.when(F.col("_scan"), empty_images).otherwise(F.coalesce("images", empty_images)))
    base = base.where((F.col("_text") != "") | (F.size("_tables") > 0) | (F.size("_images") > 0))
    no_box, no_table, no_image = (
        F.lit(None).cast("array<double>"), F.lit(None).cast(schema.TABLE), F.lit(None).cast(schema.IMAGE)
    )

    def record(text, kind, block, bbox, table, image) -> Column:
        return F.struct(
            text.alias("text"), F.col("page").alias("page"), kind.alias("kind"), F.lit(block).alias("block_type"),
            bbox.alias("bbox"), table.alias("table_data"), image.alias("image_info"),
        )

    main = record(
        F.col("_text"), F.when(F.col("_scan"), "pdf_scan").otherwise("pdf"), "text", no_box, no_table, no_image
    )
    sizeable = F.filter("_tables", lambda t: (F.size(t["rows"]) >= 2) & (F.length(t["text"]) >= 30))
    label = F.concat(F.lit("Bảng trang "), F.col("page").cast("string"), F.lit(":\n"))
    tables = F.transform(
        sizeable, lambda t: record(F.concat(label, t["text"]), F.lit("pdf_table"), "table", t["bbox"], t, no_image)
    )
    usable = F.filter(
        "_images",
        lambda i: (i["width"] >= 100) & (i["height"] >= 100) & ~((i["width"] > 1600) & (i["height"] > 2300)),
    )
    kind = visual_type(F.col("_text"))
    caption = F.concat(
        kind, F.lit(" trang "), F.col("page").cast("string"), F.lit(". Caption/ngữ cảnh gần ảnh: "), F.substring("_text", 1, 500)
    )
    figures = F.transform(
        usable,
        lambda i: record(caption, F.lit("pdf_figure"), "figure", i["bbox"], no_table, i.withField("visual_type", kind)),
    )
    none = F.filter(figures, lambda f: F.lit(False))
    everything = F.concat(F.array(main), tables, F.when(F.size("_images") <= 8, figures).otherwise(none))
    exploded = base.select("path", "page", F.posexplode(everything).alias("_i", "r"))
    # Pages are numbered, so page and place on the page give a stable record number.
    number = F.col("page") * 10_000 + F.col("_i")
    return exploded.select("path", number.cast("int").alias("rec_no"), "r.*")
