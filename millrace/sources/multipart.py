"""Bodies of multipart/form-data requests as rows, one a part."""

from __future__ import annotations

import base64
import binascii
import html
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.keyed import free_name

#: What may be wrong with a body, or a part.
NO_BOUNDARY, NO_PART, NO_END, NO_HEADERS = "no boundary in the content type", "no part in the body", "the final boundary is missing", "the headers of the part do not end"
NOT_BASE64, NO_FIELD = "the part is not base64", "the part has no field name"
_PARAMETER = re.compile(r""";\s*([!#$%&'*+\-.^_`|~0-9A-Za-z]+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^;\s]*))""", re.S)


def parameters(header: str) -> tuple[str, dict[str, str]]:
    """The value of a header and its parameters, names in lower case; ``name*`` in percent encoding goes before ``name``."""
    value, found = header.partition(";")[0].strip().lower(), {}
    for key, quoted, bare in _PARAMETER.findall(header):
        found.setdefault(key.lower(), re.sub(r'\\(["\\])', r"\1", quoted) if quoted else bare)
    for key in [k for k in found if k.endswith("*")]:
        charset, _, told = found.pop(key).partition("'")
        try:
            found[key[:-1]] = unquote_to_bytes(told.partition("'")[2]).decode(charset or "utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return value, found


def boundary_of(content_type: str | None) -> bytes | None:
    """The boundary that a content type names; None if it is no multipart type, or names none."""
    value, found = parameters(content_type or "")
    told = found.get("boundary", "")
    return told.encode("latin-1", "replace") if value.startswith("multipart/") and 0 < len(told) <= 200 else None


def split_parts(body: bytes, boundary: bytes) -> Iterator[tuple[bytes, bytes | None, str | None]]:
    """(headers, content, problem) of each part.

    A boundary counts at the start of the body or after a line end, and only if nothing but blanks and a line end follow it,
    or ``--`` and no word character; the same bytes inside content are content. The line end before a boundary belongs to it. What
    stands before the first boundary and after the last is no part. Without the final boundary the last part runs to
    the end of the body and is marked.
    """
    line = re.compile(rb"(?:\A|\r\n)--" + re.escape(boundary) + rb"(?:(--)(?![0-9A-Za-z])|[ \t]*(?:\r\n|\Z))")
    at = line.search(body)
    while at and not at[1] and at.end() < len(body):
        # The line end after a boundary may at once be the one before the next: that part is empty.
        after = line.search(body, at.end() - 2 if body[at.end() - 2 : at.end()] == b"\r\n" else at.end())
        end = after.start() if after else len(body)
        part = body[at.end() : max(end, at.end())]
        if part.startswith(b"\r\n"):
            head, found, content = b"", True, part[2:]
        else:
            head, blank, content = part.partition(b"\r\n\r\n")
            found = bool(blank)
            if not found and part.endswith(b"\r\n"):
                head, found, content = part[:-2], True, b""
        if part or after:
            yield head, content if found else None, (NO_HEADERS if not found else None) if after else NO_END
        at = after


def read_headers(head: bytes) -> dict[str, str]:
    """Names in lower case; lines that begin with a blank go on with the one before."""
    text = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace"))
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in text.split("\r\n")) if colon}


def read_body(body: bytes | None, content_type: str | None) -> list[dict]:
    """The rows of one body; see ``form_parts``."""
    blank = {"part_no": None, "field": None, "filename": None, "part_type": None, "content": None, "problem": None}
    boundary = boundary_of(content_type)
    if boundary is None:
        return [blank | {"problem": NO_BOUNDARY}]
    rows = []
    for head, content, problem in split_parts(body or b"", boundary):
        headers = read_headers(head)
        _, told = parameters(headers.get("content-disposition", ""))
        if content is not None and headers.get("content-transfer-encoding", "").lower() == "base64":
            try:
                content = base64.b64decode(re.sub(rb"\s", b"", content), validate=True)
            except binascii.Error:
                content, problem = None, problem or NOT_BASE64
        name = told.get("filename")
        if name is not None:
            name = re.split(r"[/\\]", html.unescape(name))[-1].strip()
        problem = problem or (None if "name" in told else NO_FIELD)
        kind = parameters(headers["content-type"])[0] if "content-type" in headers else None
        rows.append(blank | {"part_no": len(rows), "field": told.get("name"), "filename": name, "part_type": kind, "content": content, "problem": problem})
    return rows or [blank | {"problem": NO_PART}]


_ADDED = {
    "part_no": (T.IntegerType(), pa.int32()),
    "field": (T.StringType(), pa.string()),
    "filename": (T.StringType(), pa.string()),
    "part_type": (T.StringType(), pa.string()),
    "content": (T.BinaryType(), pa.binary()),
    "problem": (T.StringType(), pa.string()),
}


def form_parts(requests: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """One row a part, beside the request's other columns: (part_no, field, filename, part_type, content, problem).

    ``part_no`` counts from 0. ``filename`` is the last step of the path that the part names, null for a field that is no file and
    empty if no file was chosen; ``part_type`` is its content type without parameters. ``problem`` tells what is wrong,
    null if nothing is: a part whose headers do not end, or whose base64 does not decode, has no content; one without a
    field name is told; the last part of a body that is cut off has what there is. A request without a boundary in its content type, or
    without any part, has one row that says so. Body and content type are not carried along.

    A body is one value, so it is read in one task; parts leave it one by one. Columns of the added names are replaced.
    """
    others = [c for c in requests.columns if c not in (body, content_type) and c not in _ADDED]
    kept = requests.select(*others)
    rows = requests.select(*others, F.col(body).cast("binary").alias(free_name(kept, "body")), F.col(content_type).cast("string").alias(free_name(kept, "type")))
    schema = T.StructType([*rows.schema.fields[: len(others)], *(T.StructField(n, k) for n, (k, _) in _ADDED.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, (data, told) in enumerate(zip(*batch.columns[-2:])):
                found = read_body(data.as_py(), told.as_py())
                own = [batch.column(k).take(pa.array([no] * len(found))) for k in range(len(others))]
                made = [pa.array([f[n] for f in found], k) for n, (_, k) in _ADDED.items()]
                yield pa.RecordBatch.from_arrays([*own, *made], names=[*others, *_ADDED])

    return rows.mapInArrow(run, schema)


def form_uploads(parts: DataFrame, field: str = "image") -> DataFrame:
    """The files of one field, as uploads (name, content, ...): parts that name a file and have nothing wrong with them."""
    whole = (F.col("field") == field) & (F.col("filename") != "") & F.col("problem").isNull()
    return parts.where(whole).drop("field", "part_no", "part_type", "problem").withColumnRenamed("filename", "name")
