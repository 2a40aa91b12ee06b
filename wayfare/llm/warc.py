"""WARC archives as seekable Zstandard bundles (operator 5)."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import small_batches, written

#: Bytes of records in a frame, and of frames in a bundle (whole records: one record may exceed both).
FRAME = 256 << 10
BUNDLE = 16 << 20
#: Tasks that read archives at most.
READERS = 10_000
#: Fixed values of the seekable format: skippable-frame and seek-table magics.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"
URN = "urn:wayfare:page:"
INDEX = "bundle string, frame int, offset int, size int, page_id long, kind string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A WARC/1.1 record; a revisit (of ``refers_to``) leaves its payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{URN}{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head["WARC-Refers-To"] = f"<{URN}{refers_to}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame with (compressed, decompressed) sizes of all frames."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(bundle) -> list[tuple[int, int, int]]:
    """(place, compressed, decompressed size) of each frame, from the footer of a seekable file."""
    size = bundle.seek(0, 2)
    bundle.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", bundle.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    bundle.seek(size - 9 - 8 * count)
    table, place, out = bundle.read(8 * count), 0, []
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((place, packed, plain))
        place += packed
    return out


def frame(bundle, place: int, packed: int, plain: int) -> bytes:
    bundle.seek(place)
    return zstandard.ZstdDecompressor().decompress(bundle.read(packed), max_output_size=plain)


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines)
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    return head, data[begin:stop], stop + 4


def page_of(uri: str) -> int | None:
    own = uri.removeprefix(f"<{URN}").removesuffix(">")
    return int(own) if own else None


def described(head: dict[str, str], block: bytes) -> tuple:
    """A record as a row of RECORD; what a response says of its payload is checked against it."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and (digest(payload) != told or len(payload) != size):
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(head["WARC-Record-ID"]), size, told, kind, refers, head["WARC-Target-URI"], payload if kind == "response" else None


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        pack = zstandard.ZstdCompressor(level=3)
        done: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        rows: list[tuple] = []
        name, held = f"{uuid.uuid4().hex}.warc.zst", bytearray()

        def end_frame() -> None:
            if held:
                done.append(pack.compress(bytes(held)))
                sizes.append((len(done[-1]), len(held)))
                held.clear()

        def end_bundle() -> pa.RecordBatch:
            nonlocal name
            end_frame()
            # a bundle appears under its name only when it is whole; readers go by the index of tasks that ended well
            with system.open_output_stream(f"{root}/.{name}.part") as out:
                for x in (*done, seek_table(sizes)):
                    out.write(x)
            system.move(f"{root}/.{name}.part", f"{root}/{name}")
            columns = list(zip(*rows, strict=True))
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
            done.clear(), sizes.clear(), rows.clear()
            name = f"{uuid.uuid4().hex}.warc.zst"
            return batch

        for batch in batches:
            for page, url, html, refers in zip(*(batch[x].to_pylist() for x in ("page_id", "url", "html", "refers_to")), strict=True):
                data = record(page, url or "", (html or "").encode(), refers)
                if held and len(held) + len(data) > FRAME:
                    end_frame()
                rows.append((name, len(sizes), len(held), len(data), page, "response" if refers is None else "revisit"))
                held += data
                if sum(x for x, _ in sizes) + len(held) >= BUNDLE:
                    yield end_bundle()
        if rows:
            yield end_bundle()

    return run


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0
) -> DataFrame:
    """Writes a record for each page to bundles in ``folder`` (a URI that all executors reach).

    Returns the index: bundle, frame, offset (within the decompressed frame), size, page_id,
    kind.  It is a written table and says which bundles count: what a lost task left behind is not
    in it.  Of pages with equal payloads of ``least`` bytes or more the one with the largest id is the
    response (all rows with that id, if it repeats); others revisit it.  A null html is an empty payload;
    null ids stay null and are responses unless a numbered page has the payload; an empty table gives
    an empty index and no file.
    """
    small_batches(pages.sparkSession, 500)
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha", F.sha1("html"))
    sizes = F.octet_length("html")
    chosen = rows.where(sizes >= least).groupBy("sha").agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("n"))
    # a written table rather than an aggregate, so that the join may split a hot payload's pages
    chosen = written(chosen.where("n > 1").select("sha", "chosen"), "chosen")
    joined = rows.join(chosen, "sha", "left")
    refers = F.when((sizes >= least) & ~F.col("chosen").eqNullSafe(F.col("page_id")), F.col("chosen"))
    planned = joined.select("page_id", "url", "html", refers.alias("refers_to"))
    return written(planned.mapInArrow(_writer(folder), INDEX), "warc-index")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["bundle"].to_pylist():
                with system.open_input_file(f"{root}/{name}") as bundle:
                    for place in frames_of(bundle):
                        data, at, out = frame(bundle, *place), 0, []
                        while at < len(data):
                            head, block, at = parsed(data, at)
                            out.append(described(head, block))
                        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                        columns = list(zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")]
                        )

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that ``index`` names; a frame is in memory at a time.

    A bundle's name is a short row that stands for megabytes, so names are dealt out by number, a few to a task.
    """
    bundles = index.select("bundle").distinct()
    tasks = min(max(1, bundles.count()), READERS)
    return bundles.repartition(tasks).mapInArrow(_reader(folder), RECORD)


def fetch(index: DataFrame, folder: str, page_ids: DataFrame) -> DataFrame:
    """Records of some pages only: seeks to each one's frame and to its offset in there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['bundle']}") as bundle:
                    head, block, _ = parsed(frame(bundle, *frames_of(bundle)[row["frame"]]), row["offset"])
                    out.append(described(head, block))
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")]
                )

    return index.join(page_ids.select("page_id").distinct(), "page_id").mapInArrow(run, RECORD)
