"""Token ids of a corpus in flat binary files that training jobs map into memory.

A corpus is a folder of shards in document order. Shard k has three files:

* ``k.bin``  the ids of its documents end to end, unsigned 16 or 32 bits, little-endian;
* ``k.idx``  64-bit offsets: n + 1 positions of the documents in ``k.bin``, counted in ids;
* ``k.doc``  n 64-bit document ids, then n bytes that are 1 where the id is null.

``manifest.json`` lists the shards with their documents, ids and base: the number of ids in
all shards before, from prefix sums. So id j of document i of shard k has the global
position base + idx[i] + j.

Files are written under a name of the attempt and renamed, so a task that runs twice or
dies leaves a whole file or none.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Tokenizer

from tradewind.llm.common import map_batches

END_ID = 1  # appended to every document
WORDS_KEPT = 1 << 20  # distinct words whose ids a worker keeps; beyond, it starts anew
TEXTS_AT_ONCE = 500
PIECES_AT_ONCE = 1000  # new pieces that one call of the library encodes
SEPARATOR = " \x1e"  # between them; it has a blank and so stands in no piece
CHUNK_BYTES = 16 << 20  # read at once where a shard has to be fetched
SHARD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("first_null", T.BooleanType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("first_text", T.LongType()),
        T.StructField("documents", T.LongType()),
        T.StructField("tokens", T.LongType()),
    ]
)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    """With the library's own defaults: strings of special tokens in a text are those tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


class Words(dict):
    """Ids of pieces of texts between single spaces, as they stand in the files.

    Only for tokenizers that drop white space and never look across it, as word-end
    vocabularies do: there a text's ids are those of its pieces, end to end. Special tokens
    hold no blank, so each lies in one piece.
    """

    def __init__(self, path: str, kind: str):
        super().__init__()
        self.plain, self.kind = tokenizer(path), kind
        # A copy that knows the separator as a token: such tokens are cut out before anything else is done.
        self.separated = Tokenizer.from_str(self.plain.to_str())
        known = self.separated.get_vocab_size()
        self.separated.add_special_tokens([AddedToken(SEPARATOR, normalized=False)])
        self.cut = self.separated.token_to_id(SEPARATOR) if self.separated.get_vocab_size() > known else None
        self.new: list[str] = []

    def __missing__(self, piece: str) -> bytearray:
        self.new.append(piece)
        self[piece] = place = bytearray()  # filled once all new pieces of the texts are known
        return place

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > WORDS_KEPT:
            self.clear()
        found = [list(map(self.__getitem__, text.split(" "))) for text in texts]
        for at in range(0, len(self.new), PIECES_AT_ONCE):
            self.learn(self.new[at : at + PIECES_AT_ONCE])
        self.new = []
        return [b"".join(own) for own in found]

    def learn(self, pieces: list[str]) -> None:
        """The pieces' ids from one call for all; one by one where the separators don't all come back as such."""
        if self.cut is not None:
            (encoding,) = self.separated.encode_batch_fast([SEPARATOR.join(pieces)], add_special_tokens=False)
            ids = np.array(encoding.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.cut)
            if len(cuts) == len(pieces) - 1:
                data, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
                starts, ends = [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(data)]
                for piece, a, b in zip(pieces, starts, ends, strict=True):
                    self[piece][:] = data[a:b]
                return
        encodings = self.plain.encode_batch_fast(pieces, add_special_tokens=False)
        for piece, encoding in zip(pieces, encodings, strict=True):
            self[piece][:] = np.array(encoding.ids, self.kind).tobytes()


@lru_cache(maxsize=1)
def words_of(path: str, kind: str) -> Words:
    return Words(path, kind)


def pieces_of(texts: pa.Array) -> Iterator[pa.Array]:
    """The same texts, some hundreds at a time."""
    return (texts.slice(at, TEXTS_AT_ONCE) for at in range(0, len(texts), TEXTS_AT_ONCE))


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address and the path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def put(files: fs.FileSystem, path: str, parts: Iterator[bytes]) -> None:
    attempt = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
    files.move(attempt, path)


def mapped(files: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array without reading it: mapped where it lies, or from a copy where it is remote."""
    size = files.get_file_info(path).size
    if not size:
        return np.empty(0, kind)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with tempfile.TemporaryFile() as copy, files.open_input_stream(path) as source:
        while part := source.read(CHUNK_BYTES):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, kind, "r")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
    end_id: int = END_ID,
) -> dict:
    """Write every text's ids and ``end_id`` in ascending order of ids; returns the manifest.

    Rows are dealt out by ranges of (id, hash of the text), so repeated ids spread over
    shards; equal ids are ordered by that hash, null ids come first. Null and empty texts
    have the end id alone, an empty table gives a manifest without shards, other columns
    are ignored. One job; the driver gets one row per shard.

    ``folder`` must be shared by all executors. Memory: one shard's offsets and one batch
    of rows per task.
    """
    spark = docs.sparkSession
    size = tokenizer(tokenizer_path).get_vocab_size()
    kind = "<u2" if size <= 1 << 16 and end_id < 1 << 16 else "<u4"
    ordered = (
        docs.selectExpr(f"cast(`{id_column}` as bigint) as id", f"coalesce(`{text_column}`, '') as text")
        .withColumn("text_hash", F.xxhash64("text"))
        .repartitionByRange("id", "text_hash")
        .sortWithinPartitions("id", "text_hash")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        files, base = store(folder)
        words = words_of(tokenizer_path, kind)
        end, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        ids: list[int | None] = []
        sizes: list[int] = []
        first: list[int] = []
        name = uuid.uuid4().hex

        def encoded() -> Iterator[bytes]:
            for batch in batches:
                first[:] = first or [batch.column("text_hash")[0].as_py()]
                ids.extend(batch.column("id").to_pylist())
                for part in pieces_of(batch.column("text")):
                    for own in words.encode(part.to_pylist()):
                        sizes.append(len(own) // width + 1)
                        yield own
                        yield end

        files.create_dir(base, recursive=True)
        put(files, f"{base}/{name}.bin", encoded())
        if not ids:
            files.delete_file(f"{base}/{name}.bin")
            return
        nulls = np.array([i is None for i in ids], np.uint8)
        put(files, f"{base}/{name}.idx", iter([np.cumsum([0, *sizes], dtype="<i8").tobytes()]))
        put(files, f"{base}/{name}.doc", iter([np.array([i or 0 for i in ids], "<i8").tobytes(), nulls.tobytes()]))
        yield {
            "name": [name],
            "first_null": [ids[0] is None],
            "first_id": [ids[0] or 0],
            "first_text": first,
            "documents": [len(ids)],
            "tokens": [sum(sizes)],
        }

    found = map_batches(ordered, rows, SHARD).collect()  # one row per shard
    found.sort(key=lambda s: (not s.first_null, s.first_id, s.first_text))
    bases = accumulate((s.tokens for s in found), initial=0)
    manifest = {
        "dtype": kind,
        "end_id": end_id,
        "shards": [
            {"name": s.name, "documents": s.documents, "tokens": s.tokens, "base": base}
            for s, base in zip(found, bases, strict=False)
        ],
    }
    files, base = store(folder)
    files.create_dir(base, recursive=True)
    put(files, f"{base}/manifest.json", iter([json.dumps(manifest).encode()]))
    return manifest


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``; one task per shard.

    ``ids_crc32`` is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    files, base = store(folder)
    with files.open_input_stream(f"{base}/manifest.json") as source:
        manifest = json.loads(source.read())
    kind = manifest["dtype"]
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]
    )
    shards = [(s["name"], s["documents"], s["base"]) for s in manifest["shards"]]
    listed = spark.createDataFrame(shards, "name string, documents long, base long")
    listed = listed.repartition(max(1, len(shards)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        files, base = store(folder)
        for shard in chain.from_iterable(b.to_pylist() for b in batches):
            n, path = shard["documents"], f"{base}/{shard['name']}"
            ids = mapped(files, f"{path}.bin", kind)
            offsets = np.asarray(mapped(files, f"{path}.idx", "<i8"))
            docs = mapped(files, f"{path}.doc", "u1")
            for a in range(0, n, 4096):
                b = min(a + 4096, n)
                cuts = offsets[a : b + 1]
                wide = ids[cuts[0] : cuts[-1]].astype("<u4")
                local = (cuts - cuts[0]).tolist()
                yield {
                    "doc_id": pa.array(docs[8 * a : 8 * b].view("<i8"), mask=docs[8 * n + a : 8 * n + b] == 1),
                    "start": cuts[:-1] + shard["base"],
                    "n_tokens": np.diff(cuts),
                    "ids_crc32": [zlib.crc32(wide[i:j]) for i, j in zip(local, local[1:], strict=False)],
                }

    return map_batches(listed, rows, schema)


def token_folder(shared: str) -> str:
    """A new folder for one corpus under the shared one."""
    return os.path.join(shared, f"tokens-{uuid.uuid4().hex}")
