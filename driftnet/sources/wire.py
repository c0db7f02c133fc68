"""Wire decoders: bencoded replies need a recursive grammar and so an Arrow function; fixed-stride data is left to functions.binary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 64


class Bad(ValueError):
    """What cannot be decoded."""


def decode(raw: bytes, at: int = 0, depth: int = 0) -> tuple[object, int]:
    """A bencoded value (int, bytes, list, dict) and the place behind it."""
    if at >= len(raw) or depth > DEEPEST:
        raise Bad("ends early" if at >= len(raw) else "too deep")
    kind = raw[at : at + 1]
    if kind == b"i":
        end = raw.find(b"e", at)
        digits = raw[at + 1 : end] if end > 0 else b""
        if not digits.removeprefix(b"-").isdigit():
            raise Bad("bad number")
        return int(digits), end + 1
    if kind.isdigit():
        colon = raw.find(b":", at, at + 12)
        if colon < 0 or not raw[at:colon].isdigit() or colon + 1 + int(raw[at:colon]) > len(raw):
            raise Bad("bad string")
        end = colon + 1 + int(raw[at:colon])
        return raw[colon + 1 : end], end
    if kind in b"ld":
        items, at = [], at + 1
        while raw[at : at + 1] != b"e":
            value, at = decode(raw, at, depth + 1)
            items.append(value)
        if kind == b"l":
            return items, at + 1
        if len(items) % 2 or not all(isinstance(k, bytes) for k in items[::2]):
            raise Bad("bad dictionary")
        return dict(zip(items[::2], items[1::2], strict=True)), at + 1
    raise Bad("unknown kind")


def encode(value) -> bytes:
    if isinstance(value, int):
        return b"i%de" % value
    if isinstance(value, bytes):
        return b"%d:%s" % (len(value), value)
    if isinstance(value, list):
        return b"l" + b"".join(map(encode, value)) + b"e"
    return b"d" + b"".join(encode(k) + encode(value[k]) for k in sorted(value)) + b"e"


def scrape_counts(raw: bytes) -> list[tuple[str, int, int]]:
    """(hash, complete, incomplete) of a scrape reply; keys that are not 20 bytes and fields that are not known are skipped."""
    top, _ = decode(raw)
    files = top.get(b"files", {}) if isinstance(top, dict) else {}
    number = lambda v, k: v[k] if isinstance(v, dict) and isinstance(v.get(k), int) else 0
    return [(h.hex(), number(v, b"complete"), number(v, b"incomplete")) for h, v in files.items() if len(h) == 20]


def krpc_error(raw: bytes) -> tuple[int | None, str]:
    """Code and message of an error: a list of both, or a bare message."""
    value, _ = decode(raw)
    if isinstance(value, bytes):
        return None, value.decode("utf-8", "replace")
    if isinstance(value, list) and len(value) >= 2 and isinstance(value[0], int) and isinstance(value[1], bytes):
        return value[0], value[1].decode("utf-8", "replace")
    raise Bad("bad error")


def scrape_replies(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, info_hash, complete, incomplete for each file of each reply; replies that cannot be decoded give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(k, *r) for r in scrape_counts(raw)] if raw is not None else []
                except Bad:
                    continue
            kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=[key, "info_hash", "complete", "incomplete"])

    return rows.select(key, column).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, info_hash string, complete long, incomplete long")


def verified_metadata(rows: DataFrame) -> DataFrame:
    """Rows whose metadata bytes have the promised digest."""
    return rows.filter(F.sha1("metadata") == F.col("info_hash"))
