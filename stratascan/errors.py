"""Status codes, and the error that carries them with a place and a hint."""

from __future__ import annotations

import re
from enum import IntEnum


class Status(IntEnum):
    # The published status numbers.
    OK = 0
    INVALID_ARGUMENT = 1
    OUT_OF_MEMORY = 2
    NOT_IMPLEMENTED = 3
    INTERNAL = 4
    FILE_NOT_FOUND = 10
    FILE_OPEN = 11
    FILE_READ = 12
    FILE_WRITE = 13
    FILE_SEEK = 14
    FILE_TRUNCATED = 15
    INVALID_MAGIC = 20
    INVALID_FOOTER = 21
    INVALID_SCHEMA = 22
    INVALID_METADATA = 23
    INVALID_PAGE = 24
    INVALID_ENCODING = 25
    VERSION_NOT_SUPPORTED = 26
    THRIFT_DECODE = 30
    THRIFT_ENCODE = 31
    THRIFT_INVALID_TYPE = 32
    THRIFT_TRUNCATED = 33
    DECODE = 40
    ENCODE = 41
    DICTIONARY_NOT_FOUND = 42
    INVALID_RLE = 43
    INVALID_DELTA = 44
    COMPRESSION = 50
    DECOMPRESSION = 51
    UNSUPPORTED_CODEC = 52
    INVALID_COMPRESSED_DATA = 53
    TYPE_MISMATCH = 60
    COLUMN_NOT_FOUND = 61
    ROW_GROUP_NOT_FOUND = 62
    END_OF_DATA = 63
    CHECKSUM = 70
    CRC_MISMATCH = 71
    INVALID_STATE = 80
    ALREADY_CLOSED = 81
    NOT_OPEN = 82


#: What to do about failures that Spark jobs over such files meet, by the status they come to.
HINTS = {
    Status.FILE_NOT_FOUND: "list the folder with sources.files.listing(); only *.parquet, *.parq and *.pq count",
    Status.TYPE_MISMATCH: "Spark has no type for the column, or files disagree: open_table(engine='arrow') converts more types",
    Status.COLUMN_NOT_FOUND: "footers.schema_elements() has the names; case counts",
    Status.UNSUPPORTED_CODEC: "WriterOptions knows the codecs in sink.CODECS",
    Status.CRC_MISMATCH: "checks.validate() tells which files are damaged; verify_checksums=False reads on regardless",
    Status.INVALID_ENCODING: "open_table(engine='arrow') decodes what Spark's vectorized reader refuses",
    Status.OUT_OF_MEMORY: "smaller spark.sql.files.maxPartitionBytes, or fewer columns at once",
}

# What a caller may skip or try again.
RECOVERABLE = frozenset({Status.DECOMPRESSION, Status.DECODE, Status.INVALID_PAGE, Status.OUT_OF_MEMORY, Status.FILE_READ, Status.FILE_SEEK})


class ScanError(Exception):
    """An error with status code, place in the file and hint."""

    def __init__(self, status: Status, message: str, *, path: str | None = None, row_group: int | None = None, column: int | None = None):
        self.status, self.message, self.path, self.row_group, self.column = status, message, path, row_group, column
        super().__init__(self.describe())

    @property
    def hint(self) -> str | None:
        return HINTS.get(self.status)

    @property
    def recoverable(self) -> bool:
        return self.status in RECOVERABLE

    def describe(self) -> str:
        where = " ".join(f"{k}={v}" for k, v in (("path", self.path), ("row_group", self.row_group), ("column", self.column)) if v is not None)
        lines = [f"{self.status.name} ({int(self.status)}): {self.message}" if self.message else f"{self.status.name} ({int(self.status)})", where and f"at {where}", self.hint and f"try: {self.hint}"]
        return "\n".join(filter(None, lines))


#: Spark's error conditions that name a status outright.
CONDITIONS = {
    "PATH_NOT_FOUND": Status.FILE_NOT_FOUND,
    "UNABLE_TO_INFER_SCHEMA": Status.FILE_NOT_FOUND,
    "PARQUET_TYPE_ILLEGAL": Status.TYPE_MISMATCH,
    "DATATYPE_MISMATCH": Status.TYPE_MISMATCH,
    "UNRESOLVED_COLUMN": Status.COLUMN_NOT_FOUND,
}
#: What messages say, in words that aren't parts of a path.
MARKS = (
    (Status.FILE_NOT_FOUND, r"path does not exist|no such file|filenotfound|path_not_found|unable_to_infer_schema"),
    (Status.CRC_MISMATCH, r"crc|checksum"),
    (Status.INVALID_MAGIC, r"magic|is not a parquet file"),
    (Status.FILE_TRUNCATED, r"smaller than|file size is|unexpected end"),
    (Status.COLUMN_NOT_FOUND, r"unresolved_column|cannot resolve|no match for fieldref"),
    (Status.TYPE_MISMATCH, r"parquet_type_illegal|parquet_column_data_type_mismatch|datatype_mismatch|illegal parquet type"),
    (Status.UNSUPPORTED_CODEC, r"\bcodec\b"),
    (Status.DECOMPRESSION, r"decompress|corrupt"),
    (Status.INVALID_ENCODING, r"\bencoding\b"),
    (Status.INVALID_FOOTER, r"\bfooter\b|thrift"),
    (Status.OUT_OF_MEMORY, r"outofmemory|memoryerror"),
)
#: Paths, and what stands in quotes: names of files and columns say nothing of the failure.
NAMED = re.compile(r"\S*[/\\]\S*|'[^'\n]*'|\"[^\"\n]*\"|`[^`\n]*`")


def status_of(error: BaseException) -> Status:
    """The status that an exception of Spark, Arrow or Python stands for: by its condition or type, else by what it says, file names apart."""
    if isinstance(error, ScanError):
        return error.status
    condition = getattr(error, "getCondition", lambda: None)() or ""
    for name, status in CONDITIONS.items():
        if condition.split(".")[0].endswith(name):
            return status
    if isinstance(error, FileNotFoundError):
        return Status.FILE_NOT_FOUND
    if isinstance(error, MemoryError):
        return Status.OUT_OF_MEMORY
    text = f"{type(error).__name__}: {NAMED.sub(' ', str(error))}".lower()
    return next((status for status, marks in MARKS if re.search(marks, text)), Status.INTERNAL)
