"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of frames: payload length (8 bytes, little-endian), masked crc32 of those 8
bytes (4), the payload, masked crc32 of the payload (4). A payload is doc_id (8 bytes, signed), a
flag byte (1: the id is null), the width of an id in bytes (1 byte: 2 or 4) and the ids. Beside
``part-N.bin`` stands ``part-N.idx``: for each frame its byte offset and the number of ids before
it in the file (8 bytes each), so that a reader in shuffled order seeks straight to a record.
Frames are in ascending doc_id order within a file and from one file to the next; null ids first, and
rows of one doc_id by the digest of their text, so that every run writes the same bytes.
Files are written under a temporary name and renamed when complete, so a task that is run again
after a lost executor only replaces what it wrote with the same bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm.common import batches, scratch_path

#: Pieces in each of a worker's two tables.
KNOWN_WORDS = 100_000
#: Bytes of text behind one data file.
FILE_TEXT = 24 << 20
FRAME = struct.Struct("<QI")
HEAD = struct.Struct("<q?B")
#: White space in every definition; the tokenizer drops it, so what stands between is encoded alone.
BETWEEN = re.compile("[^ \t\n\r]+")
#: Texts of ASCII, Latin-1 and Latin Extended-A characters without unusual white space, controls and dotted I;
#: and, once lower-cased, their pieces: contractions, runs of letters, single digits, runs of anything else.
LATIN = re.compile("[\t\n\r -~\xa1-\xac\xae-\u012f\u0131-\u017f]*")
LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t\n\r a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\u017f\xb2\xb3\xb9\xbc-\xbe]+")


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it prints, else from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in plain else next(rest) for b in range(256)}


BYTE_SIGNS = _byte_signs()
#: How a tokenizer file must normalise and split for the cuts above to be its own.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def _cuts_apply(spec: dict) -> bool:
    """Whether a tokenizer file cuts texts as this module does: by NORMALIZER and SPLITTER, then byte by byte, with BPE."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = len(steps) == 2 and steps[0] == SPLITTER and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return plain and spec.get("normalizer") == NORMALIZER and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding") and spec["model"].get("type") == "BPE"


def masked_crc(data: bytes) -> int:
    """crc32, rotated by 15 bits and shifted by a constant, so that checksums of checksums stay apart."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


class Words:
    """Pieces' ids by the tokenizers library, packed as unsigned 32-bit integers, in tables of bounded size.

    A text of plain Latin characters is lower-cased and cut here as the tokenizer cuts it, since its
    normal form is itself, and the library's model merges each piece; pieces of other texts are what stands
    between white space, and go through the whole tokenizer. Either way the tokenizer never joins what a cut
    parts, so ids of a text are those of its pieces end to end. When the
    table is full it becomes the old one, from which pieces that are met again move back.
    Texts that hold one of the tokenizer's added tokens, and all texts of a tokenizer file that normalises or
    splits otherwise, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.cut_here = _cuts_apply(spec)
        self.added = [t["content"].lower() for t in spec.get("added_tokens") or [] if t["content"]]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return LATIN_PIECES.findall(text.lower()) if LATIN.fullmatch(text) else BETWEEN.findall(text)

    def learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known, self.old = {}, self.known
        again = self.old.keys() & new
        self.known.update({w: self.old[w] for w in again})
        tokenize = self.tokenizer.model.tokenize
        fresh = []
        for w in new - again:
            if LATIN_PIECES.fullmatch(w) and LATIN.fullmatch(w) and w == w.lower():
                self.known[w] = array("I", [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_SIGNS))]).tobytes()
            else:
                fresh.append(w)
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            self.known.update(zip(part, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)], strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text. Pieces that are new go to the library together."""
        whole = [i for i, t in enumerate(texts) if self.is_whole(t)]
        if not whole:
            return self._cut(texts)
        out = dict(zip(whole, [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)], strict=True))
        rest = [i for i in range(len(texts)) if i not in out]
        out.update(zip(rest, self._cut([texts[i] for i in rest]), strict=True))
        return [out[i] for i in range(len(texts))]

    def is_whole(self, text: str) -> bool:
        """Whether a text can't be cut here."""
        if not self.cut_here:
            return True
        low = text.lower() if self.added else ""
        return any(a in low for a in self.added)

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces(t) for t in texts]
        met = set().union(*split)
        new = met.difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            new = met
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.uint32) for words in split]


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record. ids: unsigned, 16 bits wide if all fit."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = HEAD.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def unframe(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """The record at byte ``at``: doc_id, ids as unsigned 32 bits, where the next begins. ValueError if damaged."""
    size, crc = FRAME.unpack_from(data, at)
    if masked_crc(data[at : at + 8]) != crc:
        raise ValueError(f"damaged length at byte {at}")
    payload = data[at + 12 : at + 12 + size]
    if len(payload) < size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked_crc(payload):
        raise ValueError(f"damaged record at byte {at}")
    doc_id, null, width = HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=HEAD.size).astype("<u4"), at + 16 + size


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


_WRITTEN = "part long, first_id long, n_docs long, n_tokens long, n_bytes long"


def _write(rows: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    files, root = _place(folder)
    part, words = TaskContext.get().partitionId(), words_of(tokenizer)
    name, mark = f"{root}/part-{part:06d}", uuid.uuid4().hex
    first, offsets, starts, at, tokens = None, [], [], 0, 0
    out = None
    for batch in batches(rows, 1 << 20):
        encoded = words.encode([t or "" for t in batch.column(1).to_pylist()])
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
            if out is None:
                out, first = files.open_output_stream(f"{name}.bin.{mark}"), doc_id
            ids = np.append(ids, np.uint32(end_id))
            data = frame(doc_id, ids)
            out.write(data)
            offsets.append(at)
            starts.append(tokens)
            at += len(data)
            tokens += len(ids)
    if out is None:
        return
    out.close()
    with files.open_output_stream(f"{name}.idx.{mark}") as index:
        index.write(np.array([offsets, starts], "<u8").T.tobytes())
    for kind in ("bin", "idx"):
        files.move(f"{name}.{kind}.{mark}", f"{name}.{kind}")
    yield pa.RecordBatch.from_pydict({"part": [part], "first_id": pa.array([first], pa.int64()), "n_docs": [len(offsets)], "n_tokens": [tokens], "n_bytes": [at]})


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1) -> list[dict]:
    """Encode ``docs(doc_id, text, ...)`` and write data and index files; returns and stores the manifest.

    Each text gets ``end_id`` at its end; a null text is empty. The manifest (one entry for each file:
    part, first_id, n_docs, n_tokens, n_bytes, start) is also written as manifest.json. No rows: no
    files and an empty manifest. Rows that share a doc_id are all written, side by side.
    Texts are encoded as the library does by default: an added token in a text is that token.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), round(size / FILE_TEXT))
    files, root = _place(folder)
    files.create_dir(root, recursive=True)
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.sha2(F.col("text").cast("binary"), 256)
    placed = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    found = sorted((r.asDict() for r in placed.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer_path, end_id=end_id), _WRITTEN).collect()), key=lambda r: r["part"])
    start = 0
    for entry in found:
        entry["start"] = start
        start += entry["n_tokens"]
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(found).encode())
    return found


def _read(rows: Iterator[pa.RecordBatch], folder: str, digest: bool) -> Iterator[pa.RecordBatch]:
    files, root = _place(folder)
    for batch in rows:
        for part, start, n_docs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            with files.open_input_stream(f"{root}/part-{part:06d}.bin") as stream:
                data = stream.readall()
            with files.open_input_stream(f"{root}/part-{part:06d}.idx") as stream:
                index = np.frombuffer(stream.readall(), "<u8").reshape(-1, 2)
            if len(index) != n_docs:
                raise ValueError(f"part {part}: {len(index)} records in its index, {n_docs} in the manifest")
            for lo in range(0, n_docs, 2000):
                read = [unframe(data, int(at))[:2] for at in index[lo : lo + 2000, 0]]
                if digest:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in read], pa.int64()), pa.array(start + index[lo : lo + 2000, 1].astype(np.int64)), pa.array([len(x[1]) for x in read], pa.int64()), pa.array([zlib.crc32(x[1].tobytes()) for x in read], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in read], pa.int64()), pa.array(start + index[lo : lo + 2000, 1].astype(np.int64)), pa.array([x[1] for x in read], pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))], ["doc_id", "start", "ids"])


_IDS, _DIGESTS = "doc_id long, start long, ids array<long>", "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_records(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, ids array<long>) from the files of a folder, by way of their indexes; checksums are verified.

    With ``digest`` n_tokens and the crc32 of the ids instead of the ids, made where the file is read.
    """
    files, root = _place(folder)
    with files.open_input_stream(f"{root}/manifest.json") as stream:
        manifest = json.loads(stream.readall())
    schema = _DIGESTS if digest else _IDS
    if not manifest:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(m["part"], m["start"], m["n_docs"]) for m in manifest], "part long, start long, n_docs long")
    return rows.repartition(len(manifest)).mapInArrow(partial(_read, folder=folder, digest=digest), schema)


def _crc(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids = batch.column(2)
        flat, cut = ids.flatten().to_numpy().astype("<u4"), np.asarray(ids.offsets) - ids.offsets[0].as_py()
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cut).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    return records.mapInArrow(_crc, _DIGESTS)


def record_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, digest: bool = False) -> DataFrame:
    """Write docs' records into the shared folder and read them back as read_records does."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "records")
    write_records(docs, folder, tokenizer_path, end_id)
    return read_records(spark, folder, digest)
