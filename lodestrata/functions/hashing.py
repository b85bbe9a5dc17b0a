"""Content hashes, as columns and over streams."""

from __future__ import annotations

import hashlib
from typing import BinaryIO

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = {"sha256": 256, "sha512": 512}


def check_algorithm(name: str) -> str:
    """The name if it is supported.  sha2() itself would give null for an unknown size."""
    if name not in BITS:
        raise ValueError(f"unsupported hash algorithm {name!r}")
    return name


def content_hash(content: Column | str, algorithm: str = "sha256") -> Column:
    """Lower-case hex digest; native, so it stays within whole-stage code generation."""
    return F.sha2(content, BITS[check_algorithm(algorithm)])


def hash_stream(stream: BinaryIO, algorithm: str, chunk: int = 1 << 20) -> tuple[str, int]:
    """Digest and length of a stream in constant memory, for bodies that no column value can hold."""
    digest, size = hashlib.new(check_algorithm(algorithm)), 0
    while part := stream.read(chunk):
        digest.update(part)
        size += len(part)
    return digest.hexdigest(), size


def blob_key(prefix: str, digest: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.col(digest) if isinstance(digest, str) else digest)
