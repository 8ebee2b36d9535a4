"""Writing Parquet with every option that the format's writer has."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..errors import ScanError, Status

# Codec names, and the names of their level settings.
CODECS = ("none", "snappy", "gzip", "lz4", "lz4_raw", "zstd")
LEVELS = {"zstd": "parquet.compression.codec.zstd.level", "gzip": "zlib.compress.level"}
GZIP_LEVELS = {0: "NO_COMPRESSION", 1: "BEST_SPEED", 2: "TWO", 3: "THREE", 4: "FOUR", 5: "FIVE", 6: "SIX", 7: "SEVEN", 8: "EIGHT", 9: "BEST_COMPRESSION"}
ZSTD_MOST = 22


@dataclass(frozen=True)
class WriterOptions:
    compression: str = "none"
    compression_level: int | None = None
    row_group_size: int = 128 << 20
    page_size: int = 1 << 20
    dictionary: bool = True
    dictionary_page_size: int = 1 << 20
    no_dictionary_columns: tuple[str, ...] = ()
    version_2: bool = False  # data pages and delta encodings of format version 2
    bloom: dict[str, int] = field(default_factory=dict)  # column: distinct values expected
    bloom_fpp: float = 0.01
    page_checksums: bool = True
    max_records_per_file: int = 0
    int96_timestamps: bool = False
    partition_by: tuple[str, ...] = ()

    def as_options(self) -> dict[str, str]:
        if self.compression not in CODECS:
            raise ScanError(Status.UNSUPPORTED_CODEC, self.compression)
        if self.row_group_size < 1 or self.page_size < 1:
            raise ScanError(Status.INVALID_ARGUMENT, "sizes have to be positive")
        out = {
            "compression": self.compression,
            "parquet.block.size": str(self.row_group_size),
            "parquet.page.size": str(self.page_size),
            "parquet.enable.dictionary": str(self.dictionary).lower(),
            "parquet.dictionary.page.size": str(self.dictionary_page_size),
            "parquet.writer.version": "PARQUET_2_0" if self.version_2 else "PARQUET_1_0",
            "parquet.page.write-checksum.enabled": str(self.page_checksums).lower(),
            "maxRecordsPerFile": str(self.max_records_per_file),
        }
        out |= {f"parquet.enable.dictionary#{c}": "false" for c in self.no_dictionary_columns}
        if (level := self.compression_level) is not None:
            known = GZIP_LEVELS if self.compression == "gzip" else range(1, ZSTD_MOST + 1) if self.compression == "zstd" else ()
            if level not in known:
                raise ScanError(Status.INVALID_ARGUMENT, f"{self.compression} has no level {level}")
            out[LEVELS[self.compression]] = GZIP_LEVELS[level] if self.compression == "gzip" else str(level)
        for c, n in self.bloom.items():
            out |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(n), f"parquet.bloom.filter.fpp#{c}": str(self.bloom_fpp)}
        return out


def write(df: DataFrame, path: str, options: WriterOptions = WriterOptions(), mode: str = "errorifexists") -> None:
    """Writes a frame; the committer takes back a failed job's files, so a table is there whole or not at all."""
    writer = df.write.mode(mode).options(**options.as_options())
    if options.partition_by:
        writer = writer.partitionBy(*options.partition_by)
    conf, key = df.sparkSession.conf, "spark.sql.parquet.outputTimestampType"
    old = conf.get(key)
    try:
        if options.int96_timestamps:
            conf.set(key, "INT96")
        writer.parquet(path)
    finally:
        conf.set(key, old)
