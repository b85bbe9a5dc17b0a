"""Object storage over the S3 REST protocol, on the standard library alone.

Requests are signed with version 4 signatures from static credentials.  A store is plain settings,
so it is pickled to the executors; each thread keeps its connection open and uses it again once an answer
was read whole.  Reads and writes of one key are repeated after a dropped connection or a server
error; all of them may be.  Bodies over ONE_PUT bytes go up in parts.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import hmac
import http.client
import ipaddress
import threading
import time
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from typing import BinaryIO
from urllib.parse import quote, unquote_plus, urlsplit
from xml.sax.saxutils import escape

from lodestrata.sources.objectstore import NoSuchKey, ObjectInfo, probed_cuts

#: Times that a call is made at most, and the seconds waited before the second one.
ATTEMPTS, PAUSE = 4, 0.2
TIMEOUT = 60
PART = 1 << 20
#: Bytes that one request puts or copies at most (the protocol has 5 GiB), of a part of larger bodies at least, and parts at most.
ONE_PUT, PART_BYTES, MOST_PARTS = 4 << 30, 64 << 20, 10_000
#: Keys of one delete request.
DELETED_AT_ONCE = 1000
UNSIGNED = "UNSIGNED-PAYLOAD"
_TRANSIENT = frozenset([429, 500, 502, 503, 504])


class S3Error(Exception):
    def __init__(self, status: int, code: str, message: str):
        super().__init__(f"{status} {code}: {message}")
        self.status, self.code = status, code


def signature(secret: str, region: str, when: str, text: str) -> str:
    key = f"AWS4{secret}".encode()
    for part in (when[:8], region, "s3", "aws4_request"):
        key = hmac.digest(key, part.encode(), "sha256")
    return hmac.digest(key, text.encode(), "sha256").hex()


def authorization(method: str, path: str, query: dict[str, str], headers: dict[str, str], payload: str, access: str, secret: str, region: str) -> str:
    """The Authorization header for a request whose other headers, x-amz-date among them, are all signed."""
    named = sorted((k.lower(), " ".join(v.split())) for k, v in headers.items())
    signed = ";".join(k for k, _ in named)
    canonical = "\n".join([method, path, _encoded(query), *[f"{k}:{v}" for k, v in named], "", signed, payload])
    when = headers["x-amz-date"]
    scope = f"{when[:8]}/{region}/s3/aws4_request"
    found = signature(secret, region, when, "\n".join(["AWS4-HMAC-SHA256", when, scope, hashlib.sha256(canonical.encode()).hexdigest()]))
    return f"AWS4-HMAC-SHA256 Credential={access}/{scope},SignedHeaders={signed},Signature={found}"


def _encoded(query: dict[str, str]) -> str:
    return "&".join(f"{quote(k, safe='-_.~')}={quote(v, safe='-_.~')}" for k, v in sorted(query.items()))


class _Connections(threading.local):
    """A thread's idle connections by (TLS, host)."""

    def __init__(self):
        self.idle: dict[tuple[bool, str], http.client.HTTPConnection] = {}

    def take(self, tls: bool, host: str) -> tuple[http.client.HTTPConnection, bool]:
        """A connection, and whether it was open before."""
        found = self.idle.pop((tls, host), None)
        if found is not None:
            return found, True
        return (http.client.HTTPSConnection if tls else http.client.HTTPConnection)(host, timeout=TIMEOUT), False

    def give_back(self, connection: http.client.HTTPConnection, response: http.client.HTTPResponse) -> None:
        """Keeps the connection if it may be used again: the answer was read whole, and the server has not closed it."""
        key = (isinstance(connection, http.client.HTTPSConnection), f"{connection.host}:{connection.port}" if connection.port != connection.default_port else connection.host)
        if response.isclosed() and not response.will_close and connection.sock is not None and key not in self.idle:
            self.idle[key] = connection
        else:
            connection.close()


_CONNECTIONS = _Connections()


class _Body:
    """The body of a response; closing it gives the connection back, or closes it."""

    def __init__(self, connection: http.client.HTTPConnection, response: http.client.HTTPResponse):
        self._connection, self._response = connection, response

    def read(self, n: int = -1) -> bytes:
        data = self._response.read() if n < 0 else self._response.read(n)
        if not data and n and self._response.length:  # a sized read does not tell by itself
            raise http.client.IncompleteRead(b"", self._response.length)
        return data

    def close(self) -> None:
        _CONNECTIONS.give_back(self._connection, self._response)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class _Slice:
    """`size` bytes of a body from where it stands, as a body."""

    def __init__(self, body: BinaryIO, size: int):
        self._body, self._start, self._size = body, body.tell(), size

    def tell(self) -> int:
        return self._body.tell() - self._start

    def seek(self, at: int) -> None:
        self._body.seek(self._start + at)

    def read(self, n: int = -1) -> bytes:
        left = self._size - self.tell()
        return self._body.read(left if n < 0 else min(n, left))


@dataclass(frozen=True)
class S3Store:
    """A store at `endpoint`: host[:port], or a URL whose scheme then decides about TLS."""

    endpoint: str
    access_key: str = ""
    secret_key: str = ""
    region: str = "us-east-1"
    use_path_style: bool = False
    secure: bool = False

    # -------------------------------------------------------------- requests

    def _place(self, bucket: str, key: str) -> tuple[bool, str, str]:
        """TLS, host and path.  Buckets are host names where the endpoint allows it, else part of the path."""
        url = urlsplit(self.endpoint if "://" in self.endpoint else f"{'https' if self.secure else 'http'}://{self.endpoint}")
        if url.scheme not in ("http", "https") or not url.hostname:
            raise ValueError(f"no S3 endpoint: {self.endpoint!r}")
        key = quote(key, safe="/-_.~")
        if self.use_path_style or not _names_host(url.hostname, bucket):
            return url.scheme == "https", url.netloc, f"/{quote(bucket, safe='-_.~')}" + (f"/{key}" if key else "")
        return url.scheme == "https", f"{bucket}.{url.netloc}", f"/{key}"

    def _call(self, method: str, bucket: str, key: str = "", query: dict[str, str] | None = None, headers: dict[str, str] | None = None, body: BinaryIO | bytes | None = None, size: int = 0) -> tuple[http.client.HTTPConnection, http.client.HTTPResponse]:
        """An open response with a status under 300."""
        start = body.tell() if hasattr(body, "tell") else 0
        for attempt in range(1, ATTEMPTS + 1):
            try:
                if hasattr(body, "seek"):
                    body.seek(start)
                connection, response = self._once(method, bucket, key, query or {}, headers or {}, body, size)
            except (OSError, http.client.HTTPException):
                if attempt == ATTEMPTS:
                    raise
            else:
                if response.status < 300:
                    return connection, response
                error = _error_of(response)
                _CONNECTIONS.give_back(connection, response)
                if error.status not in _TRANSIENT or attempt == ATTEMPTS:
                    raise error
            time.sleep(PAUSE * 2 ** (attempt - 1))
        raise AssertionError

    def _once(self, method, bucket, key, query, headers, body, size):
        tls, host, path = self._place(bucket, key)
        payload = hashlib.sha256(body or b"").hexdigest() if body is None or isinstance(body, bytes) else UNSIGNED if tls else _sha256_of(body)
        when = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
        sent = {"host": host, "x-amz-date": when, "x-amz-content-sha256": payload, **headers}
        sent["Authorization"] = authorization(method, path, query, sent, payload, self.access_key, self.secret_key, self.region or "us-east-1")
        start = body.tell() if hasattr(body, "tell") else 0
        while True:
            connection, used = _CONNECTIONS.take(tls, host)
            try:
                connection.putrequest(method, path + (f"?{_encoded(query)}" if query else ""), skip_host=True, skip_accept_encoding=True)
                for name, value in sent.items():
                    connection.putheader(name, value)
                if body is not None or method == "PUT":
                    connection.putheader("Content-Length", str(len(body) if isinstance(body, bytes) else size))
                connection.endheaders()
                if isinstance(body, bytes):
                    connection.send(body)
                elif body is not None:
                    while part := body.read(PART):
                        connection.send(part)
                return connection, connection.getresponse()
            except (OSError, http.client.HTTPException):
                connection.close()
                if not used:  # else the server had closed it while it was idle: a new one tells
                    raise
                if hasattr(body, "seek"):
                    body.seek(start)
            except BaseException:
                connection.close()
                raise

    def _whole(self, *call, **named) -> bytes:
        connection, response = self._call(*call, **named)
        try:
            return response.read()
        finally:
            _CONNECTIONS.give_back(connection, response)

    # -------------------------------------------------------------- the store

    def bucket_exists(self, bucket: str) -> bool:
        try:
            self._whole("HEAD", bucket)
            return True
        except S3Error as e:
            if e.status == 404:
                return False
            raise

    def _pages(self, bucket: str, query: dict[str, str]) -> Iterator[ET.Element]:
        token = None
        while True:
            page = ET.fromstring(self._whole("GET", bucket, query={"list-type": "2", "encoding-type": "url", **query, **({"continuation-token": token} if token else {})}))
            for element in page.iter():
                element.tag = element.tag.rpartition("}")[2]
            if page.findtext("EncodingType") == "url":  # XML cannot hold every key as it is
                for element in page.iter():
                    if element.tag in ("Key", "Prefix"):
                        element.text = unquote_plus(element.text or "")
            yield page
            token = page.findtext("NextContinuationToken")
            if page.findtext("IsTruncated") != "true" or not token:
                return

    def list(self, bucket: str, prefix: str, after: str = "", until: str | None = None) -> Iterator[ObjectInfo]:
        for page in self._pages(bucket, {"prefix": prefix, **({"start-after": after} if after else {})}):
            for found in page.iter("Contents"):
                key = found.findtext("Key") or ""
                if until is not None and key > until:
                    return
                # whole seconds, as a stat gives no more
                when = datetime.fromisoformat(found.findtext("LastModified")).astimezone(timezone.utc).replace(microsecond=0)
                yield ObjectInfo(key, int(found.findtext("Size")), (found.findtext("ETag") or "").strip('"'), when, "")

    def first_after(self, bucket: str, prefix: str, place: str) -> str | None:
        """The first key with the prefix after a place: one request, one key."""
        page = next(self._pages(bucket, {"prefix": prefix, "max-keys": "1", **({"start-after": place} if place else {})}))
        return next((found.findtext("Key") for found in page.iter("Contents")), None)

    def cuts(self, bucket: str, prefix: str, most: int, after: str = "", until: str | None = None) -> list[str]:
        return probed_cuts(lambda place: self.first_after(bucket, prefix, place), most, after, until)

    def get(self, bucket: str, key: str) -> BinaryIO:
        try:
            return _Body(*self._call("GET", bucket, key))
        except S3Error as e:
            if e.code == "NoSuchKey":
                raise NoSuchKey(f"{bucket}/{key}") from None
            raise

    def stat(self, bucket: str, key: str) -> ObjectInfo:
        try:
            connection, response = self._call("HEAD", bucket, key)
        except S3Error as e:
            if e.status == 404:
                raise NoSuchKey(f"{bucket}/{key}") from None
            raise
        response.read()
        _CONNECTIONS.give_back(connection, response)
        h = response.headers
        return ObjectInfo(key, int(h["Content-Length"]), (h["ETag"] or "").strip('"'), parsedate_to_datetime(h["Last-Modified"]).astimezone(timezone.utc), h["Content-Type"] or "")

    def put(self, bucket: str, key: str, body: BinaryIO, size: int, content_type: str) -> int:
        start, headers = body.tell(), {"content-type": content_type} if content_type else {}
        if size <= ONE_PUT:
            self._whole("PUT", bucket, key, headers=headers, body=body, size=size)
            return body.tell() - start
        with self._parts(bucket, key, headers) as (upload, done):
            step = max(PART_BYTES, -(-size // MOST_PARTS))
            for number, at in enumerate(range(0, size, step), 1):
                part = min(step, size - at)
                done.append((number, self._etag("PUT", bucket, key, {"partNumber": str(number), "uploadId": upload}, {}, _Slice(body, part), part)))
        return body.tell() - start

    def copy(self, bucket: str, key: str, target: str, etag: str, size: int, content_type: str) -> None:
        """A copy within the store, which no task reads; fails unless the object still has the etag."""
        source = {"x-amz-copy-source": f"/{quote(bucket, safe='-_.~')}/{quote(key, safe='/-_.~')}", "x-amz-copy-source-if-match": f'"{etag}"'}
        if size <= ONE_PUT:
            self._copied(self._whole("PUT", bucket, target, headers=source))
            return
        with self._parts(bucket, target, {"content-type": content_type} if content_type else {}) as (upload, done):
            step = max(PART_BYTES, -(-size // MOST_PARTS))
            for number, at in enumerate(range(0, size, step), 1):
                part = {**source, "x-amz-copy-source-range": f"bytes={at}-{min(at + step, size) - 1}"}
                done.append((number, self._copied(self._whole("PUT", bucket, target, query={"partNumber": str(number), "uploadId": upload}, headers=part))))

    @staticmethod
    def _copied(answer: bytes) -> str:
        """The etag of a copy; an error may come with status 200."""
        found = {e.tag.rpartition("}")[2]: e.text or "" for e in ET.fromstring(answer).iter()}
        if "ETag" not in found:
            raise S3Error(200, found.get("Code", ""), found.get("Message", "not copied"))
        return found["ETag"]

    def _etag(self, *call) -> str:
        connection, response = self._call(*call)
        response.read()
        _CONNECTIONS.give_back(connection, response)
        return response.headers["ETag"] or ""

    @contextlib.contextmanager
    def _parts(self, bucket: str, key: str, headers: dict[str, str]) -> Iterator[tuple[str, list[tuple[int, str]]]]:
        """An upload in parts: its id, and the list for (number, etag) of each; it is completed, or given up after an error."""
        answer = ET.fromstring(self._whole("POST", bucket, key, query={"uploads": ""}, headers=headers))
        upload, done = next(e.text or "" for e in answer.iter() if e.tag.rpartition("}")[2] == "UploadId"), []
        try:
            yield upload, done
            listed = "".join(f"<Part><PartNumber>{n}</PartNumber><ETag>{escape(e)}</ETag></Part>" for n, e in done)
            self._copied(self._whole("POST", bucket, key, query={"uploadId": upload}, body=f"<CompleteMultipartUpload>{listed}</CompleteMultipartUpload>".encode()))
        except BaseException:
            with contextlib.suppress(Exception):
                self._whole("DELETE", bucket, key, query={"uploadId": upload})
            raise

    def _removed(self, bucket: str, key: str) -> bool:
        try:
            self._whole("DELETE", bucket, key)
            return True
        except S3Error:
            return False

    def remove(self, bucket: str, keys: list[str]) -> list[str]:
        """The keys that did not fail.  An error that names no key fails its whole request."""
        done: list[str] = []
        for at in range(0, len(keys), DELETED_AT_ONCE):
            part = keys[at : at + DELETED_AT_ONCE]
            if any(not _in_xml(k) for k in part):  # XML cannot hold them: one request each
                odd = [k for k in part if not _in_xml(k)]
                done += [k for k in odd if self._removed(bucket, k)]
                part = [k for k in part if _in_xml(k)]
                if not part:
                    continue
            wanted = "".join(f"<Object><Key>{escape(k)}</Key></Object>" for k in part)
            body = f"<Delete><Quiet>true</Quiet>{wanted}</Delete>".encode()
            answer = ET.fromstring(self._whole("POST", bucket, query={"delete": ""}, headers={"content-md5": base64.b64encode(hashlib.md5(body).digest()).decode()}, body=body))
            failed = [next((k.text for k in e if k.tag.rpartition("}")[2] == "Key"), None) for e in answer.iter() if e.tag.rpartition("}")[2] == "Error"]
            if all(failed):
                done += [k for k in part if k not in failed]
        return done


def _in_xml(key: str) -> bool:
    return all(c >= " " and c not in "\ufffe\uffff" or c in "\t\n" for c in key)


def _names_host(host: str, bucket: str) -> bool:
    """Whether a bucket may be a name under the host: known services only, and no names with dots, which TLS rejects."""
    try:
        ipaddress.ip_address(host)
        return False
    except ValueError:
        return (host == "amazonaws.com" or host.endswith(".amazonaws.com")) and bucket.replace("-", "").isalnum() and bucket == bucket.lower()


def _sha256_of(body: BinaryIO) -> str:
    start, digest = body.tell(), hashlib.sha256()
    while part := body.read(PART):
        digest.update(part)
    body.seek(start)
    return digest.hexdigest()


def _error_of(response: http.client.HTTPResponse) -> S3Error:
    body = response.read()
    try:
        found = {e.tag.rpartition("}")[2]: e.text or "" for e in ET.fromstring(body)}
    except ET.ParseError:
        found = {}
    return S3Error(response.status, found.get("Code", ""), found.get("Message", response.reason))
