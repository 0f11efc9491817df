"""Readers of the external collections: each archive file is one row of the binary source and is parsed in its task."""

from __future__ import annotations

import bz2
import csv
import email
import email.policy
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "dataset string, source_record string, raw_text string, label int"


def _read(spark: SparkSession, path: str, parse: Callable[[bytes, str], Iterator[tuple]], dataset: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, body in zip(f["path"], f["content"]):
                rows = list(parse(bytes(body), unquote(file).rpartition("/")[2]))
                yield pd.DataFrame({"dataset": dataset, "source_record": [r[0] for r in rows], "raw_text": [r[1] for r in rows], "label": pd.array([r[2] for r in rows], dtype="Int32")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def ragged_zip(spark: SparkSession, path: str, dataset: str = "campus_sms") -> DataFrame:
    """Zip of headerless Latin-1 CSV files: at least eight fields, label in the seventh; the message is the rest, joined
    again without empty fields at its end and stripped. The record is the member's stem and its line."""

    def parse(body: bytes, file: str) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                for k, row in enumerate(csv.reader(io.StringIO(z.read(name).decode("latin-1"), newline="")), 1):
                    if len(row) < 8 or row[6].strip().lower() not in ("ham", "spam"):
                        continue
                    rest = row[7:]
                    while rest and not rest[-1].strip():
                        rest.pop()
                    yield f"{PurePosixPath(name).stem}:{k}", ",".join(rest).strip(), int(row[6].strip().lower() == "spam")

    return _read(spark, path, parse, dataset)


def headed_zip(spark: SparkSession, path: str, dataset: str = "tube_comments") -> DataFrame:
    """Zip of Latin-1 CSV files with a header: the record is the member's file name and COMMENT_ID."""

    def parse(body: bytes, file: str) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv") and not n.startswith("__MACOSX/")):
                for row in csv.DictReader(io.StringIO(z.read(name).decode("latin-1"), newline="")):
                    yield f"{PurePosixPath(name).name}:{row['COMMENT_ID']}", row["CONTENT"], int(row["CLASS"])

    return _read(spark, path, parse, dataset)


def message_text(raw: bytes) -> str:
    """Subject and every text part without a file name; the only part of a plain mail whatever its type. Unknown charsets
    and broken bytes are read with replacement."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    found = [p for p in m.walk() if p.get_content_maintype() == "text" and not p.get_filename()] if m.is_multipart() else [m]
    return "\n".join(x for x in (str(m.get("subject", "") or ""), *map(_body, found)) if x)


def _body(part) -> str:
    body = part.get_payload(decode=True)
    if body is None:
        return str(part.get_payload())
    try:
        text = body.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return text


def mail_tar(spark: SparkSession, path: str, dataset: str = "mail_archive") -> DataFrame:
    """tar.bz2 of mails; the archive's name holds the label (spam and not ham); command files are skipped. The record is
    the archive's file name and the member."""

    def parse(body: bytes, file: str) -> Iterator[tuple]:
        stem = PurePosixPath(file).stem
        with tarfile.open(fileobj=io.BytesIO(bz2.decompress(body))) as t:
            for m in t:
                if m.isfile() and not m.name.endswith("cmds"):
                    yield f"{file}:{m.name}", message_text(t.extractfile(m).read()), int("spam" in stem and "ham" not in stem)

    return _read(spark, path, parse, dataset)


def coerced_csv(spark: SparkSession, path: str, dataset: str = "bosphor_sms") -> DataFrame:
    """Semicolon CSV with columns Group and Message: rows of group 1 or 2 with a message, stripped; label is group 1; the
    record is the row of its own file plus 2 (the header is line 1). A file is read by one task."""

    def parse(body: bytes, file: str) -> Iterator[tuple]:
        rows = (r for r in csv.reader(io.StringIO(body.decode("utf-8-sig"), newline=""), delimiter=";") if r)
        head = next(rows, [])
        for k, row in enumerate(rows):
            cells = dict(zip(head, row))
            try:
                group = float(cells.get("Group", ""))
            except ValueError:
                continue
            if group in (1.0, 2.0) and cells.get("Message"):
                yield f"row:{k + 2}", cells["Message"].strip(), int(group == 1)

    return _read(spark, path, parse, dataset)
