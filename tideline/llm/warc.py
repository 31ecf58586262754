"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record with an offset index."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .ngram_join import bitmap_of, in_bitmap

MIN_REVISIT = 1000
#: Bytes of records after which a new archive begins, compression level, and bytes read at once.
FILE_BYTES, LEVEL, READ = 256 << 20, 4, 1 << 20
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path of the shared folder: local, or one that pyarrow knows."""
    if uri.startswith(("/", "file:/")):
        return fs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, digest: str | None = None, place: str = "0") -> bytes:
    """A response record, or with refers_to a revisit record, which has the HTTP head but no payload. Its id is that of the
    page and its place, since rows may share a page's id; what it revisits goes by the page, in a header of its own."""
    sha = base64.b32encode(bytes.fromhex(digest) if digest else hashlib.sha1(payload).digest()).decode()
    name = "" if page_id is None else page_id
    block = _HTTP + (b"" if refers_to is not None else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}:{place}>",
        f"WARC-Target-URI: {quote(url or f'urn:page:{name}', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[4:4] = [f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {_REVISIT}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) for each record of an inflated stream, which is held only as far as one record goes."""
    held = bytearray()
    need = None
    for c in chunks:
        held += c
        while True:
            if need is None:
                if (end := held.find(b"\r\n\r\n")) < 0:
                    break
                lines = bytes(held[:end]).decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
                headers = dict(x.split(": ", 1) for x in lines[1:])
                need = end + 4 + int(headers["Content-Length"]) + 4
            if len(held) < need:
                break
            yield headers, bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def _inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, READ bytes at a time at most."""
    z = zlib.decompressobj(31)
    while data := stream.read(READ):
        while data:
            yield z.decompress(data, READ)
            data = z.unconsumed_tail
            if z.eof:
                data = z.unused_data
                z = zlib.decompressobj(31)
    while rest := z.decompress(z.unconsumed_tail, READ):
        yield rest


def _commit(system: fs.FileSystem, temporary: str, final: str) -> None:
    """A file gets its name when it is whole, so that a task that is lost or runs twice leaves no half one."""
    if system.type_name != "local" and system.get_file_info(final).type != fs.FileType.NotFound:
        system.delete_file(final)
    system.move(temporary, final)


def _attempt(path: str) -> str:
    return f"{path}.{TaskContext.get().taskAttemptId()}.tmp"


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (page_id, url, payload, refers_to, digest) to archives, each one gzip stream, and returns (file).
    Lazy: it writes when it is computed. Names have the attempt of their task, which may see rows in another order than one
    before; the files of an attempt that was lost are in no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        out = z = name = None
        n, k, size, files = 0, 0, 0, []

        def close() -> None:
            nonlocal out
            out.write(z.flush())
            out.close()
            _commit(system, _attempt(name), name)
            files.append(name.rsplit("/", 1)[1])
            out = None

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "digest")), strict=True):
                if out is None:
                    name, size, k = f"{root}/part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{n:04d}.warc.gz", 0, 0
                    system.create_dir(root, recursive=True)
                    out, z, n = system.open_output_stream(_attempt(name), compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), n + 1
                data, k = record(*row, place=f"{TaskContext.get().partitionId()}-{n - 1}-{k}"), k + 1
                size += len(data)
                out.write(z.compress(data))
                if size >= FILE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    return rows.mapInArrow(run, "file string")


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites archives of any gzip layout to one member per record, with a sidecar `.idx` of offset and length of
    each, and returns that index: (file, offset, length). Each file is inflated once, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_, a = _open(source)
        to, b = _open(target)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                to.create_dir(b, recursive=True)
                name, at, index = f"{b}/{file}", 0, []
                with from_.open_input_stream(f"{a}/{file}", compression=None) as stream, to.open_output_stream(_attempt(name), compression=None) as out:
                    for _, data in split_records(_inflated(stream)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        index.append((at, len(member)))
                        at += len(member)
                with to.open_output_stream(_attempt(f"{name}.idx"), compression=None) as out:
                    out.write("".join(f"{o} {n}\n" for o, n in index).encode())
                _commit(to, _attempt(name), name)
                _commit(to, _attempt(f"{name}.idx"), f"{name}.idx")
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(index), pa.string()), pa.array([o for o, _ in index], pa.int64()), pa.array([n for _, n in index], pa.int64())], names=["file", "offset", "length"])

    return files.mapInArrow(run, "file string, offset long, length long")


_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that an index names, each read and inflated by its offset alone. The payload of a revisit is null; a
    response whose payload doesn't have the digest and length of its headers is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name, stream = None, None
        page = lambda x: int(m[1]) if (m := re.match(r"<urn:page:(-?\d+):", x or "")) else None
        for b in batches:
            out = []
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    name, stream = file, system.open_input_file(f"{root}/{file}")
                ((h, data),) = split_records(iter([zlib.decompress(stream.read_at(length, offset), 31)]))
                digest, size, payload = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex(), int(h["X-Payload-Length"]), None
                if h["WARC-Type"] == "response":
                    payload = data[data.index(b"\r\n\r\n") + 4 :].split(b"\r\n\r\n", 1)[1][:-4]
                    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {offset}: the payload doesn't match its digest")
                out.append((page(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None, size, digest, payload))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    return index.mapInArrow(run, _READ)


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes a record per page, normalises the archives, and returns the records read back.

    Null html is an empty payload. Of pages with equal payloads of min_revisit bytes or more, that with the largest id
    is a response and the others revisit it; rows that repeat that id are responses too, and a null id never is the
    largest: where all are null, all are responses. Archives and index stay in `folder`/warc, by default in the shared
    folder. An empty table gives no records.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = folder or scratch.root
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = base.where(F.length("payload") >= min_revisit)
    # a table of the digests that several pages have, so that adaptive execution can split the pages of a hot one
    groups = scratch.table(large.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 and keep is not null").select("digest", "keep"), "groups")
    bitmap, bits = bitmap_of(groups, "digest", groups.count())
    bitmap = scratch.table(bitmap, "bits")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to")
    alone = F.lit(None).cast("long").alias("refers_to")
    # only pages whose digest may be repeated are shuffled, by a filter of bounded size
    rows = in_bitmap(large, "digest", bitmap, bits).join(groups, "digest", "left").select("page_id", "url", "payload", refers, "digest")
    rest = in_bitmap(large, "digest", bitmap, bits, inside=False).unionByName(base.where(F.length("payload") < min_revisit)).select("page_id", "url", "payload", alone, "digest")
    files = scratch.table(write_archives(rows.unionByName(rest), f"{folder}/streams"), "files")
    tasks = max(1, min(files.count(), pages.sparkSession.sparkContext.defaultParallelism * 4))
    index = scratch.table(normalise(files.repartition(tasks), f"{folder}/streams", f"{folder}/warc"), "index")
    system, path = _open(f"{folder}/streams")
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)  # all of it is in the normalised archives
    return read_records(index, f"{folder}/warc")
