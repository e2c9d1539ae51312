"""Text of Office files and of encoded bytes."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.shipping import ship

PART_MOST, TOTAL_MOST = 10 << 20, 30 << 20
PARTS = {"docx": r"word/document\.xml", "xlsx": r"xl/(sharedStrings|worksheets/sheet\d+)\.xml", "pptx": r"ppt/slides/slide\d+\.xml"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def office_text(kind: str, data: bytes) -> str:
    """Paragraphs, shared strings and slides as lines. ValueError for files that aren't such or are too large."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise ValueError(f"not a {kind} file") from None
    number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
    names = sorted((n for n in archive.namelist() if re.fullmatch(PARTS[kind], n)), key=lambda n: ("sheet" in n.lower() and "shared" not in n.lower(), number(n)))
    total, lines, shared = 0, [], []
    for name in names:
        size = archive.getinfo(name).file_size
        total += size
        if size > PART_MOST or total > TOTAL_MOST:
            raise ValueError(f"{name} is too large")
        root = ElementTree.fromstring(archive.read(name))
        if kind == "xlsx" and name.endswith("sharedStrings.xml"):
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in root]
        elif kind == "xlsx":
            for row in (r for r in root.iter() if _local(r.tag) == "row"):
                cells = []
                for c in row:
                    value = next((v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t")), "")
                    cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
                if any(cells):
                    lines.append("\t".join(cells))
        else:
            for p in (p for p in root.iter() if _local(p.tag) == "p"):
                text = "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip()
                if text:
                    lines.append(text)
    return "\n".join(lines)


def inflated(data: bytes) -> str:
    """UTF-8 text, inflated first where the bytes start as gzip does."""
    return (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8", "replace")


def decoded(data: bytes, content_type: str = "") -> str:
    """By the charset of the header or of a meta element, else UTF-8, else GB 18030, else UTF-8 with replacements."""
    named = re.search(r"charset=[\"']?([\w-]+)", content_type or "") or re.search(rb"<meta[^>]*charset=[\"']?([\w-]+)", data[:2048], re.I)
    tries = [named[1] if isinstance(named[1], str) else named[1].decode()] if named else []
    for charset in [*tries, "utf-8", "gb18030"]:
        try:
            return data.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


def file_texts(files: DataFrame, kind: str = "kind", content: str = "content", *keys: str) -> DataFrame:
    """(keys, text, error) of binary rows by kind: docx, xlsx, pptx, gzip or text; other kinds are errors, not failures."""
    ship(files.sparkSession)
    slim = files.select(*keys, F.col(kind).alias("_kind"), F.col(content).alias("_content"))

    def one(kind: str, data: bytes) -> tuple[str | None, str | None]:
        try:
            if kind in PARTS:
                return office_text(kind, data or b""), None
            if kind in ("gzip", "text"):
                return (inflated if kind == "gzip" else decoded)(data or b""), None
            return None, f"unsupported_content: {kind}"
        except (ValueError, OSError, ElementTree.ParseError) as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(k, d) for k, d in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=[*keys, "text", "error"])

    own = dict(slim.dtypes)
    return slim.mapInArrow(run, ", ".join([*(f"`{k}` {own[k]}" for k in keys), "text string", "error string"]))
