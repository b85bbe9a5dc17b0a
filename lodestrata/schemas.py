"""Schemas of the catalog, the listing and the report.

Catalog strings are never null; what is missing is the empty string.  `is_pointer` and `hash_algo` of
objects and `stored` of blobs go beyond the plain catalog: they keep a small pointer document from
being taken for a small object, make a change of algorithm rehash, and tell blobs that were only
measured from blobs whose bytes are in storage.
"""

from pyspark.sql import types as T

_KINDS = {"string": T.StringType, "bigint": T.LongType, "int": T.IntegerType, "boolean": T.BooleanType, "timestamp": T.TimestampType}


def struct(fields: str) -> T.StructType:
    """A flat struct from "name type, ...": unlike fromDDL it needs no session, so modules can be imported anywhere."""
    return T.StructType([T.StructField(name, _KINDS[kind]()) for name, kind in (f.split() for f in fields.split(","))])


LISTING = struct("bucket string, object_key string, etag string, size bigint, last_modified timestamp, content_type string")

OBJECTS = struct(
    "bucket string, object_key string, etag string, size bigint, last_modified timestamp, blob_bucket string, blob_hash string, last_seen_scan string, is_pointer boolean, hash_algo string"
)

BLOBS = struct("bucket string, blob_key string, hash string, size bigint, ref_count bigint, stored boolean")

#: What `register` takes: an object row with its blob's key and logical size.
RECORDS = struct(
    "bucket string, object_key string, etag string, size bigint, last_modified timestamp, blob_bucket string, blob_key string, blob_size bigint, hash string, last_seen_scan string, is_pointer boolean, hash_algo string"
)

POINTER = struct("blob_bucket string, blob_key string, hash string, size bigint, content_type string")

REPORT_FIELDS = (
    "scan_started", "scan_finished", "objects_scanned", "unique_blobs", "duplicates_found",
    "bytes_reclaimable", "bytes_reclaimed", "objects_relinked", "errors", "mode",
)

KEY = ["bucket", "object_key"]
UNCHANGED_ON = ["bucket", "object_key", "etag", "size", "last_modified"]
POINTER_TYPE = ".json+pointer"
