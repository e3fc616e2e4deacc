"""Sources and sinks: guarded binary files, layout JSON, HTML blocks, manifests."""

from __future__ import annotations

import inspect
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT_SCHEMA = """provider string, markdown string,
  pages array<struct<page_idx: int, page_size: array<double>, angle: int>>,
  blocks array<struct<page_idx: int, page_size: array<double>, bbox: array<double>, text: string, type: string, source_type: string, confidence: double>>,
  regions array<struct<page_idx: int, page_size: array<double>, bbox: array<double>, type: string, source_type: string, confidence: double, structured_content: string>>,
  metadata string"""


def guarded_files(files: DataFrame, suffix: str = ".pdf", magic: bytes = b"%PDF-", most: int = 200 << 20) -> DataFrame:
    """Binary files with the reason why one is turned away, null for those that pass, and their fingerprint."""
    fault = (
        F.when(~F.lower("path").endswith(suffix), "suffix")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > most, "too_large")
        .when(F.hex(F.substring("content", 1, len(magic))) != magic.hex().upper(), "magic")
    )
    return files.select("path", "length", fault.alias("fault"), F.sha2("content", 256).alias("sha256"))


def read_files(spark: SparkSession, path: str, **guards) -> DataFrame:
    """Guarded files of a folder; the bytes of files beyond the size guard are never read."""
    files = spark.read.format("binaryFile").load(path)
    most = guards.get("most", inspect.signature(guarded_files).parameters["most"].default)
    right = guarded_files(files.where(F.col("length") <= most), **guards)
    large = files.where(F.col("length") > most).select("path", "length", F.lit("too_large").alias("fault"), F.lit(None).cast("string").alias("sha256"))
    return right.unionByName(large)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout payloads, one JSON object per file, with an explicit schema."""
    return spark.read.schema(LAYOUT_SCHEMA).json(path, multiLine=True).withColumn("path", F.input_file_name())


def layout_tables(payloads: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, regions and blocks of payloads as flat tables; a page without a number has its place in the list."""
    pages = payloads.select(key, F.posexplode("pages").alias("at", "p")).select(
        key, F.coalesce("p.page_idx", "at").alias("page_idx"), F.get("p.page_size", 0).alias("width"), F.get("p.page_size", 1).alias("height"),
        F.pmod(-F.coalesce("p.angle", F.lit(0)), F.lit(360)).alias("angle"),
    )

    def boxed(name: str, extra: str) -> DataFrame:
        flat = payloads.select(key, F.posexplode(name).alias("idx", "e"))
        corner = [F.get("e.bbox", i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
        return flat.select(key, "e.page_idx", "idx", *corner, "e.type", "e.confidence", f"e.{extra}")

    return pages, boxed("regions", "structured_content"), boxed("blocks", "text")


#: Tags whose text is furniture, and what other tags' texts are.
FURNITURE = {"nav": "page_header", "header": "page_header", "footer": "page_footer", "aside": "page_header"}
KINDS = {"h1": "title", "h2": "section_heading", "h3": "section_heading", "p": "text", "li": "text", "td": "table_text", "th": "table_text"}
SILENT = ("script", "style", "noscript", "template")
VOID = ("br", "img", "hr", "meta", "link", "input")


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.held, self.kind, self.silent, self.furniture = "", "text", 0, []

    def flush(self, kind: str = "text") -> None:
        text = " ".join(self.held.split())
        if text:
            self.out.append((FURNITURE[self.furniture[-1]] if self.furniture else self.kind, text))
        self.held, self.kind = "", kind

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in FURNITURE:
            self.flush()
            self.furniture.append(tag)
        elif tag in KINDS or tag in ("div", "article", "section", "ul", "ol", "table", "tr", "body", "main"):
            self.flush(KINDS.get(tag, "text"))

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in FURNITURE:
            self.flush()
            if tag in self.furniture:
                del self.furniture[len(self.furniture) - 1 - self.furniture[::-1].index(tag) :]
        elif tag in KINDS or tag in ("div", "article", "section", "ul", "ol", "table", "tr", "body", "main"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held += data


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, n, type, text``: the blocks of each page in order; unclosed tags are tolerated, scripts and comments are no text."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ns, kinds, texts = [], [], [], []
            for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = _Blocks()
                parser.feed(h or "")
                parser.close()
                parser.flush()
                for n, (kind, text) in enumerate(parser.out):
                    keys.append(k), ns.append(n), kinds.append(kind), texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(ns, pa.int32()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], [key, "n", "type", "text"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInArrow(parse, f"{key} {kind}, n int, type string, text string")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON object per line; Spark's committer makes files appear whole or not at all."""
    manifest.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("overwrite").json(f"{path}/nested")
    flat = ledger.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page", F.explode("p.entries").alias("e"))
    flat.select("doc_id", "page", "e.*").write.mode("overwrite").parquet(f"{path}/flat")
