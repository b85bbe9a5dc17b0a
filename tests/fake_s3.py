"""An S3 endpoint in this process: enough of the protocol for the adapter, with small pages and signatures checked."""

import contextlib
import hashlib
import threading
import xml.etree.ElementTree as ET
from datetime import datetime, timezone
from email.utils import format_datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, quote_plus, unquote, urlsplit
from xml.sax.saxutils import escape

from lodestrata.sources.s3store import S3Store, authorization

ACCESS, SECRET, REGION, PAGE = "someone", "a secret", "eu-test-1", 3


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def log_message(self, *_):
        pass

    def answer(self, status, body=b"", **headers):
        self.send_response(status)
        for name, value in headers.items():
            self.send_header(name.replace("_", "-"), value)
        if "Content_Length" not in headers:
            self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def error(self, status, code):
        self.answer(status, f"<Error><Code>{code}</Code><Message>{code} here</Message></Error>".encode())

    def handle_any(self):
        server, url = self.server, urlsplit(self.path)
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        query = dict(parse_qsl(url.query, keep_blank_values=True))
        signed = self.headers["Authorization"].split("SignedHeaders=")[1].split(",")[0].split(";")
        headers = {h: self.headers[h] for h in signed}
        payload = hashlib.sha256(body).hexdigest()
        if self.headers["Authorization"] != authorization(self.command, url.path, query, headers, payload, ACCESS, SECRET, REGION) or headers["x-amz-content-sha256"] != payload:
            return self.error(403, "SignatureDoesNotMatch")
        if server.trouble:
            return self.error(server.trouble.pop(0), "InternalError")
        bucket, _, key = unquote(url.path[1:]).partition("/")
        if bucket not in server.buckets:
            return self.error(404, "NoSuchBucket")
        objects = server.buckets[bucket]
        if self.command == "POST" and "delete" in query:
            answer = ""
            for found in ET.fromstring(body).iter("Key"):
                if found.text in server.undeletable:
                    answer += f"<Error>{'' if server.undeletable[found.text] else f'<Key>{escape(found.text)}</Key>'}<Code>AccessDenied</Code></Error>"
                else:
                    objects.pop(found.text, None)
            return self.answer(200, f'<DeleteResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">{answer}</DeleteResult>'.encode())
        server.connections.add(self.client_address)
        if self.command == "DELETE":
            server.uploads.pop(query.get("uploadId"), None) if "uploadId" in query else objects.pop(key, None)
            return self.answer(204)
        if self.command == "POST" and "uploads" in query:
            upload = f"upload-{len(server.uploads)}"
            server.uploads[upload] = (self.headers.get("content-type", "binary/octet-stream"), {})
            return self.answer(200, f"<InitiateMultipartUploadResult><UploadId>{upload}</UploadId></InitiateMultipartUploadResult>".encode())
        if self.command == "POST" and "uploadId" in query:
            kind, parts = server.uploads.pop(query["uploadId"])
            wanted = [(int(p.findtext("PartNumber")), p.findtext("ETag")) for p in ET.fromstring(body).iter("Part")]
            if [(n, f'"{hashlib.md5(parts[n]).hexdigest()}"') for n in sorted(parts)] != wanted:
                return self.answer(200, b"<Error><Code>InvalidPart</Code></Error>")
            objects[key] = (b"".join(parts[n] for n in sorted(parts)), kind, datetime.now(timezone.utc))
            return self.answer(200, b"<CompleteMultipartUploadResult><ETag>&quot;x-2&quot;</ETag></CompleteMultipartUploadResult>")
        if self.command == "PUT":
            kind = self.headers.get("content-type", "binary/octet-stream")
            if source := self.headers.get("x-amz-copy-source"):
                _, name, there = unquote(source).split("/", 2)
                body, kind, _ = server.buckets[name][there]
                if self.headers["x-amz-copy-source-if-match"] != f'"{hashlib.md5(body).hexdigest()}"':
                    return self.error(412, "PreconditionFailed")
                if span := self.headers.get("x-amz-copy-source-range"):
                    first, _, last = span.removeprefix("bytes=").partition("-")
                    body = body[int(first) : int(last) + 1]
                server.copies += 1
            if "uploadId" in query:
                server.uploads[query["uploadId"]][1][int(query["partNumber"])] = body
            if "uploadId" in query or source:
                etag = f'"{hashlib.md5(body).hexdigest()}"'
                if "uploadId" not in query:
                    objects[key] = (body, kind, datetime.now(timezone.utc))
                return self.answer(200, f"<CopyResult><ETag>{escape(etag)}</ETag></CopyResult>".encode() if source else b"", ETag=etag)
            objects[key] = (body, self.headers.get("content-type", "binary/octet-stream"), datetime.now(timezone.utc))
            return self.answer(200)
        if key:
            if key not in objects:
                return self.error(404, "NoSuchKey")
            data, kind, when = objects[key]
            if self.command == "GET" and server.cut:
                self.close_connection = True
                return self.answer(200, data[: len(data) // 2], Content_Length=str(len(data)))
            return self.answer(200, data, Content_Length=str(len(data)), Content_Type=kind, ETag=f'"{hashlib.md5(data).hexdigest()}"', Last_Modified=format_datetime(when, usegmt=True))
        if self.command == "HEAD":
            return self.answer(200)
        return self.answer(200, self.page(objects, query))

    def page(self, objects, query):
        prefix, delimiter, out = query["prefix"], query.get("delimiter"), ""
        rows = {}
        for key in objects:
            if key.startswith(prefix):
                cut = key.find(delimiter, len(prefix)) if delimiter else -1
                rows[key if cut < 0 else key[: cut + 1]] = cut >= 0
        after = query.get("continuation-token", query.get("start-after", ""))
        names = sorted(n for n in rows if n > after)
        size = min(PAGE, int(query.get("max-keys", PAGE)))
        server = self.server
        with server.lock:
            server.prefixes.add(prefix)
            server.pages.append((query.get("max-keys"), self.client_address, after))
        for name in names[:size]:
            if rows[name]:
                out += f"<CommonPrefixes><Prefix>{quote_plus(name)}</Prefix></CommonPrefixes>"
            else:
                data, _, when = objects[name]
                out += f"<Contents><Key>{quote_plus(name)}</Key><LastModified>{when.isoformat(timespec='milliseconds').replace('+00:00', 'Z')}</LastModified><ETag>&quot;{hashlib.md5(data).hexdigest()}&quot;</ETag><Size>{len(data)}</Size></Contents>"
        more = len(names) > size
        token = f"<NextContinuationToken>{escape(names[size - 1])}</NextContinuationToken>" if more else ""
        return f'<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><EncodingType>url</EncodingType><IsTruncated>{str(more).lower()}</IsTruncated>{token}{out}</ListBucketResult>'.encode()

    do_GET = do_HEAD = do_PUT = do_POST = do_DELETE = handle_any


@contextlib.contextmanager
def serve(*buckets):
    """A store over a fresh endpoint; `server` of the endpoint is at `serve.server`."""
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.buckets, server.trouble, server.undeletable, server.cut = {b: {} for b in buckets}, [], {}, False
    server.pages, server.prefixes, server.lock, server.connections, server.uploads, server.copies = [], set(), threading.Lock(), set(), {}, 0
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    serve.server = server
    try:
        yield S3Store(f"127.0.0.1:{server.server_port}", ACCESS, SECRET, REGION)
    finally:
        server.shutdown()
        server.server_close()
