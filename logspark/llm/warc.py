"""WARC archives of pages, compressed record by record with a Zstandard dictionary of their own records.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on a bounded sample
of the archive's records; every record follows as a frame of its own that needs it. Readers take the dictionary
from the file and can decode from any record on.

Pages with equal payloads are stored once: the one with the largest page_id is the response, the others are
revisits with headers only. Payloads below a limit are always stored. Archives have about target_bytes of records
(headers and stored payloads) each and are written by one task each, under a temporary name that is moved when complete, so a task that
runs twice leaves one archive.

Nulls: a null html is an empty payload; a null url is written as urn:page:<id>; a null page_id has no id header,
never is the response of others with an id, and comes back as null. Repeated rows: rows with the page_id of the
response are all responses. Extra columns are not archived.
"""

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from logspark.llm.frames import exact, light, runs, stored

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
#: Bytes of a record's headers, about, besides its address.
HEADER_BYTES = 600
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write(
    pages: DataFrame, folder: str, least_bytes: int = 1000, target_bytes: int = 32 << 20, dictionary_bytes: int = 32 << 10,
    sample_bytes: int = 1 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id",
    url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Writes the pages as archives into the folder; rows (archive, file, n_records, n_bytes)."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    equal = stored(
        rows.groupBy("digest", "size").agg(
            F.max("page_id").alias("response"), F.count("*").alias("copies"),
            F.sum(HEADER_BYTES + F.coalesce(F.octet_length("url"), F.lit(0))).alias("headers"))
    )
    # what is written: every header, and the payloads that are not revisited
    is_shared = (F.col("copies") > 1) & (F.col("size") >= least_bytes)
    payloads = F.col("size") * F.when(is_shared, 1).otherwise(F.col("copies"))
    written = equal.agg(F.sum(payloads + F.col("headers"))).first()[0] or 0
    archives = max(1, -(-written // target_bytes))
    shared = equal.where(is_shared).drop("copies", "headers")
    typed = rows.join(light(shared), ["digest", "size"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    typed = typed.withColumn("refers_to", refers).drop("response")
    # headers only for a revisit, so its payload need not be moved
    typed = typed.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    archive = F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(archives))
    dealt = typed.withColumn("archive", archive).repartitionById(archives, F.col("archive").cast("int")).sortWithinPartitions("archive", "page_id", "url")
    # as text, since nulls would turn numbers into floats in pandas
    dealt = dealt.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return dealt.mapInPandas(
        _writer(folder, dictionary_bytes, sample_bytes, level, date), "archive bigint, file string, n_records bigint, n_bytes bigint"
    )


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url, payload: bytes | None, digest: str, size: int, refers_to, date: str, turn: int) -> bytes:
    """One WARC record; payload None makes a revisit."""
    identity = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{turn}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{identity}>",
        f"WARC-Target-URI: {_clean(url) if url is not None else f'urn:page:{page_id}'}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        first = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{refers_to}:0")
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{first}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int, sample_bytes: int):
    """A trained dictionary, or plain content where there is too little to train on."""
    import zstandard

    room = max(1, sample_bytes // max(1, len(records)))
    step = max(1, sum(min(len(r), 16384) for r in records) // sample_bytes)
    samples = [r[:16384] for r in records[::step]] if room < 16384 else [r[:16384] for r in records]
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"\x00" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes], dictionary_bytes: int, sample_bytes: int, level: int) -> bytes:
    import zstandard

    trained = dictionary(records, dictionary_bytes, sample_bytes)
    content = trained.as_bytes()
    trained.precompute_compress(level=level)
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    out = [SKIPPABLE.to_bytes(4, "little"), len(content).to_bytes(4, "little"), content]
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def _writer(folder: str, dictionary_bytes: int, sample_bytes: int, level: int, date: str):
    def write_archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for group in runs(batches, "archive"):
            records, last, turn = [], None, 0
            for r in group.itertuples(index=False):
                page_id = None if r.page_id is None else int(r.page_id)
                turn = turn + 1 if page_id == last else 0
                last = page_id
                refers = None if r.refers_to is None else int(r.refers_to)
                url = r.url if isinstance(r.url, str) else None
                payload = bytes(r.payload) if refers is None else None
                records.append(record(page_id, url, payload, r.digest, int(r.size), refers, date, turn))
            data = archive_bytes(records, dictionary_bytes, sample_bytes, level)
            number = int(group["archive"].iloc[0])
            system, base = fs.FileSystem.from_uri(folder)
            system.create_dir(base, recursive=True)
            path = f"{base}/{number:08d}.warc.zst"
            own = f"{path}.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as out:
                out.write(data)
            system.move(own, path)
            yield pd.DataFrame([(number, path, len(records), len(data))], columns=["archive", "file", "n_records", "n_bytes"])

    return write_archives


READ = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of the folder. A revisit has no payload; its digest and size are the response's."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out = []
                for row in records_of(bytes(content)):
                    out.append(row if payloads else (*row[:-1], None))
                    if len(out) == 1000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    return files.mapInPandas(parse, READ)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in READ.split(", ")]
    return exact(rows, names, "page_id", "refers_to")


def records_of(data: bytes) -> Iterator[tuple]:
    """Decodes one archive; checks the digest of every stored payload."""
    import zstandard

    if int.from_bytes(data[:4], "little") != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary frame")
    end = 8 + int.from_bytes(data[4:8], "little")
    kind = zstandard.DICT_TYPE_FULLDICT if data[8:12] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:end], dict_type=kind))
    stream = io.BufferedReader(unpacker.stream_reader(io.BytesIO(data[end:]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record does not start with its version")
        head = _headers(stream)
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
        stored_here = head["warc-type"] == "response"
        if stored_here and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError("a payload does not match its digest")
        number = {k: int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id")}
        yield (
            number["x-page-id"], head["warc-target-uri"], size, digest, head["warc-type"], number["x-refers-to-page-id"],
            payload if stored_here else None,
        )


def _headers(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
        out[name.lower()] = value
    return out
