"""Token ids in files of directly addressable codes.

A file holds the ids of whole documents, one after the other. Level 0 has the low 8 bits of every id and a bitmap that says
which ids go on; level 1 has the next 8 bits of those only, and so forth. A rank directory counts the ones before every
512th bit, so the place of any id in the next level is the directory's count and at most eight popcounts: any token is read
without decoding others. Documents follow in ascending doc_id order through the files, files in the order of (part, number).

    file   := "SKDAC1\\n\\0" uint32 header length, header (JSON), sections
    header := {"docs", "ids", "levels": [{"n", ...}], ...} and each section's name, type, offset, length

Tasks write to the shared folder under names of their own and report them; a task that is repeated writes new files, and only those of
the successful attempt are in the manifest. A task keeps one file's ids in memory, FILE_IDS and one document at most.

Defined results: null text is empty and has the end id only; documents with null doc_id come first; those of equal doc_id stand in
the order of their texts; an empty table gives no files and no rows; repeated rows each get a row; a text of any length is encoded whole,
its ids in memory; other columns are ignored. token_at() reads one token from a file by its place.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FILE_IDS = 4_000_000
MAGIC = b"SKDAC1\n\0"
#: White space that the quick split does not take.
_OTHER = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


# The codes.


def dac_encode(ids, bits: int = 8) -> list[dict]:
    """Levels of an array of ids; each has its chunks, its bitmap of 64-bit words and its rank directory."""
    import numpy as np

    levels, now = [], np.asarray(ids, np.uint64)
    while len(now) or not levels:
        rest = now >> np.uint64(bits)
        more = rest > 0
        words = np.zeros((len(now) + 511) // 512 * 8, "<u8")
        packed = np.packbits(more, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).reshape(-1, 8).sum(1, dtype=np.int64))])
        levels.append({"chunks": (now & np.uint64((1 << bits) - 1)).astype(np.uint8), "bitmap": words, "ranks": ranks.astype("<u4")})
        now = rest[more]
    return levels


def _rank(level: dict, i: int) -> int:
    """Ones before bit i."""
    import numpy as np

    block, word = i >> 9, i >> 6
    if block == len(level["ranks"]) - 1:
        return int(level["ranks"][block])
    inside = int(np.bitwise_count(level["bitmap"][block * 8 : word]).sum())
    return int(level["ranks"][block]) + inside + (int(level["bitmap"][word]) & ((1 << (i & 63)) - 1)).bit_count()


def dac_access(levels: list[dict], i: int, bits: int = 8) -> int:
    """The i-th id alone."""
    value, shift = 0, 0
    for level in levels:
        value |= int(level["chunks"][i]) << shift
        if not int(level["bitmap"][i >> 6]) >> (i & 63) & 1:
            break
        i, shift = _rank(level, i), shift + bits
    return value


def dac_range(levels: list[dict], start: int, end: int, bits: int = 8):
    """Ids start to end. A range stays a range in every level, so each level takes one rank."""
    import numpy as np

    value, live, shift = np.zeros(end - start, np.uint32), np.arange(end - start), 0
    for level in levels:
        if start == end:
            break
        value[live] |= level["chunks"][start:end].astype(np.uint32) << np.uint32(shift)
        w = level["bitmap"][start >> 6 : (end + 63) >> 6].view(np.uint8)
        more = np.unpackbits(w, bitorder="little")[start & 63 :][: end - start].astype(bool)
        live = live[more]
        start = _rank(level, start)
        end, shift = start + len(live), shift + bits
    return value


# The files.


def file_system(uri: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri)


def pack_file(doc_ids: list, lengths: list[int], ids) -> bytes:
    import numpy as np

    sections: list[tuple[str, object]] = [("known", np.array([d is not None for d in doc_ids], np.uint8)), ("doc_ids", np.array([d or 0 for d in doc_ids], "<i8")), ("lengths", np.array(lengths, "<i8"))]
    levels = dac_encode(ids)
    for k, level in enumerate(levels):
        sections += [(f"{n}{k}", level[n]) for n in ("chunks", "bitmap", "ranks")]
    header, at = {"docs": len(doc_ids), "ids": len(ids), "levels": len(levels), "sections": []}, 0
    for name, x in sections:
        header["sections"].append([name, x.dtype.str, at, len(x)])
        at += (x.nbytes + 7) // 8 * 8
    head = json.dumps(header).encode()
    head += b" " * (-len(head) % 8)
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *(x.tobytes() + bytes(-x.nbytes % 8) for _, x in sections)])


def unpack_file(data: bytes) -> dict:
    """Header, doc_ids, lengths and levels; arrays are views of the data."""
    import numpy as np

    if data[:8] != MAGIC:
        raise ValueError("not a file of directly addressable codes")
    size = int.from_bytes(data[8:16], "little")
    header = json.loads(data[16 : 16 + size])
    part = {name: np.frombuffer(data, kind, n, 16 + size + at) for name, kind, at, n in header["sections"]}
    return header | part | {"levels": [{n: part[f"{n}{k}"] for n in ("chunks", "bitmap", "ranks")} for k in range(header["levels"])]}


def token_at(fs, path: str, i: int, bits: int = 8) -> int:
    """The i-th id of a file: besides the header, a few bytes of each level are read, and a bitmap block of at most 64."""
    import numpy as np

    with fs.open_input_file(path) as f:
        size = int.from_bytes(f.read(16)[8:], "little")
        header = json.loads(f.read(size))
        where = {name: (np.dtype(kind), 16 + size + at) for name, kind, at, _ in header["sections"]}

        def read(name: str, a: int, b: int):
            kind, at = where[name]
            f.seek(at + a * kind.itemsize)
            return np.frombuffer(f.read((b - a) * kind.itemsize), kind)

        value, shift = 0, 0
        for k in range(header["levels"]):
            value |= int(read(f"chunks{k}", i, i + 1)[0]) << shift
            block, word = i >> 9, i >> 6
            inside = read(f"bitmap{k}", block * 8, word + 1)
            last = int(inside[-1])
            if not last >> (i & 63) & 1:
                break
            i = int(read(f"ranks{k}", block, block + 1)[0]) + int(np.bitwise_count(inside[:-1]).sum()) + (last & ((1 << (i & 63)) - 1)).bit_count()
            shift += bits
    return value


# Encoding.


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class Encoder:
    """The library's encoding of whole texts, with its results kept.

    The tokenizer's pattern splits a text into parts, and its model encodes each alone; so a part is encoded once. Most texts have
    single spaces and line feeds only: there a word with the space before it never shares a part with its neighbours, and words
    are looked up whole. Texts that hold one of the tokenizer's added tokens are given to the library whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        common.local_threads()
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.characters = _byte_characters()
        self.space = self.characters[32]
        # Two generations each: what was not asked for since the last change goes.
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.get = self.words.get
        trial = "It's  a trial:\n\n 12 m\u00fcnzen\u2026 \n"
        if self._whole(trial) != b"".join(map(self._part, self.split(trial))):
            raise ValueError(f"{path}: not a byte-level tokenizer with the known pattern")

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if (got := self.parts.get(part)) is None:
            if (got := self.old_parts.get(part)) is None:
                if part.isascii() and part[1:].isalpha():
                    coded = self.space + part[1:] if part[0] == " " else part
                else:
                    coded = part.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.characters)
                got = array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()
            if len(self.parts) >= self.most:
                self.parts, self.old_parts = {}, self.parts
            self.parts[part] = got
        return got

    def _word(self, word: str) -> bytes:
        """A word as split from a text: after a space, or after a line feed of its own."""
        if (got := self.old_words.get(word)) is None:
            if word.isalpha():
                got = self._part(" " + word)
            elif word[:-1].isalpha() and word[-1] in ".,;:!?":
                got = self._part(" " + word[:-1]) + self._part(word[-1])
            else:
                parts = ["\n", *self.split(word[1:])] if word[0] == "\n" else self.split(" " + word)
                got = b"".join(map(self._part, parts))
        if len(self.words) >= self.most:
            self.words, self.old_words = {}, self.words
            self.get = self.words.get
        self.words[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if any(a in text for a in self.added):
            return self._whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        if "" in rest or "\n\n" in text or _OTHER.search(text):
            return b"".join(map(self._part, self.split(text)))
        return b"".join([*map(self._part, self.split(first)), *[self.get(w) or self._word(w) for w in rest]])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(documents: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files; the manifest has a row for each: part, number, path, n_docs, n_ids, start (ids in the files before)."""
    import pyarrow as pa

    common.batches(documents.sparkSession, 256)
    rows = common.pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        part, number, doc_ids, lengths, ids, n = TaskContext.get().partitionId(), 0, [], [], [], 0
        tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

        def flush():
            path = f"{base}/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.skdac"
            with fs.open_output_stream(path, compression=None) as f:
                f.write(pack_file(doc_ids, lengths, np.frombuffer(b"".join(ids), "<u4")))
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [path], "n_docs": [len(doc_ids)], "n_ids": [n]}, pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), encoder(tokenizer).encode_batch(b.column("text").to_pylist())):
                doc_ids.append(d)
                ids.append(x + tail)
                lengths.append(len(ids[-1]) // 4)
                n += lengths[-1]
                if n >= file_ids:
                    yield flush()
                    number, doc_ids, lengths, ids, n = number + 1, [], [], [], 0
        if doc_ids:
            yield flush()

    made = common.staged(rows.mapInArrow(run, "part int, number int, path string, n_docs long, n_ids long"), "manifest")
    # A row for each file: this one window is as small as the list of files.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str, want_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, and its ids if asked for, from the files."""
    import pyarrow as pa

    def run(batches):
        fs, _ = file_system(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with fs.open_input_stream(path, compression=None) as f:
                    x = unpack_file(f.read())
                at, out = 0, {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                for d, known, n in zip(x["doc_ids"].tolist(), x["known"].tolist(), x["lengths"].tolist()):
                    ids = dac_range(x["levels"], at, at + n)
                    for k, v in (("doc_id", d if known else None), ("start", start + at), ("n_tokens", n), ("ids_crc32", zlib.crc32(ids.astype("<u4").tobytes())), ("ids", ids.tolist() if want_ids else None)):
                        out[k].append(v)
                    at += n
                yield pa.RecordBatch.from_pydict(out, pa.schema([(k, pa.int64()) for k in list(out)[:4]] + [("ids", pa.list_(pa.int64()))]))

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def tokenized(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes documents to files in the shared folder and reads them back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{common.shared_dir(documents.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(documents, tokenizer, folder), folder).drop("ids")


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    return tokenized(common.table(spark, sf_dir, "documents"))
