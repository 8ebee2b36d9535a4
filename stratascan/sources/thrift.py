"""Reading the compact protocol, in which footers and page indexes are written, into plain values.

A struct becomes a dict from field number to value; nothing is known of what fields mean.
"""

from __future__ import annotations

import struct

from ..errors import ScanError, Status

# The wire types of the protocol.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def byte(self) -> int:
        if self.at >= len(self.raw):
            raise ScanError(Status.THRIFT_TRUNCATED, "the bytes end within a value")
        self.at += 1
        return self.raw[self.at - 1]

    def unsigned(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def signed(self) -> int:
        n = self.unsigned()
        return (n >> 1) ^ -(n & 1)

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ScanError(Status.THRIFT_TRUNCATED, "the bytes end within a value")
        self.at += n
        return self.raw[self.at - n : self.at]

    def value(self, kind: int):
        if kind in (TRUE, FALSE):  # of a list; in a struct the type is the value
            return self.byte() == TRUE
        if kind == BYTE:
            return struct.unpack("b", self.take(1))[0]
        if kind in (I16, I32, I64):
            return self.signed()
        if kind == DOUBLE:
            return struct.unpack("<d", self.take(8))[0]
        if kind == BINARY:
            return self.take(self.unsigned())
        if kind in (LIST, SET):
            head = self.byte()
            n = head >> 4 if head >> 4 < 15 else self.unsigned()
            return [self.value(head & 15) for _ in range(n)]
        if kind == MAP:
            n = self.unsigned()
            kinds = self.byte() if n else 0
            return {self.value(kinds >> 4): self.value(kinds & 15) for _ in range(n)}
        if kind == STRUCT:
            return self.struct()
        raise ScanError(Status.THRIFT_INVALID_TYPE, f"no type {kind}")

    def struct(self) -> dict:
        out: dict = {}
        field = 0
        while head := self.byte():
            field = field + (head >> 4) if head >> 4 else self.signed()
            kind = head & 15
            out[field] = kind == TRUE if kind in (TRUE, FALSE) else self.value(kind)
        return out


def decode(raw: bytes) -> dict:
    """The struct that some bytes begin with."""
    return Reader(raw).struct()


def footer(f, length: int) -> dict:
    """The footer of an open file of so many bytes."""
    tail = f.read_at(8, length - 8) if length >= 12 else b""
    if tail[4:] != b"PAR1":
        raise ScanError(Status.INVALID_MAGIC, "trailing bytes")
    size = int.from_bytes(tail[:4], "little")
    if size > length - 12:
        raise ScanError(Status.INVALID_FOOTER, "footer length")
    return decode(f.read_at(size, length - 8 - size))
