"""Token ids as flat binary files.

Documents are range-partitioned and sorted by id, so partition k's documents
come before those of partition k + 1.  Each task streams its documents through
the tokenizers library into a part of three files in the shared folder:

- ``.bin``  ids, unsigned little-endian, 16 bits where the vocabulary allows, else 32;
- ``.off``  64-bit offsets: where each document starts in ``.bin``, in ids, and the end;
- ``.key``  each document's id (64 bits) after a byte that is 1 for a null id.

A task's row in the manifest names its files.  File names hold a random part,
so a task that runs twice never writes into files that another reads, and only
those of the attempt that Spark commits get into the manifest.  A part's base
(ids of all parts before it) is a prefix sum over the manifest, which has one
row for each part.  Readers memory-map a part's files and go through its
documents one by one.

Defined results: a null or empty text holds the end id alone; a null document
id comes first; equal ids are in the order of their texts' hashes, then of the texts; an empty
table gives an empty manifest and no documents; other columns are not stored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import list_column
from .common import materialise, shared_path
from .pieces import PieceEncoder
from .resident import resident

KEY = np.dtype([("null", "u1"), ("id", "<i8")])
DOCS_PER_BATCH = 2_000
WORDS_AT_ONCE = 20_000
SLICE_BYTES = 16 << 20  # of text that is encoded together
WORD_ENTRIES = 500_000  # in each generation of a worker's cache, under 250 bytes each

MANIFEST = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("path", T.StringType()),
    T.StructField("dtype", T.StringType()), T.StructField("n_docs", T.LongType()),
    T.StructField("n_ids", T.LongType())])


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def _create(uri: str):
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "xb")
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path)


def _mapped(uri: str, dtype) -> np.ndarray:
    """The file as an array: memory-mapped, or fetched where the folder is a remote store."""
    if path := _local(uri):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _library(path: str) -> tuple[PieceEncoder, str]:
    return resident(("library", path), lambda: _load(path))


def _load(path: str) -> tuple[PieceEncoder, str]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    dtype = "<u2" if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]

    def ids_of(text: str) -> np.ndarray:
        return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype)

    # Words joined in one text are told apart by the token that opens each:
    # one that starts with the space before a word, or a line end put there.
    vocab = tok.get_vocab(with_added_tokens=True)
    space = tok.encode(" ", add_special_tokens=False).tokens[0]
    line_end = ids_of("\n")
    opens = {lead: np.zeros(1 + max(vocab.values()), bool) for lead in (" ", "\n")}
    opens[" "][[k for token, k in vocab.items() if token.startswith(space)]] = True
    opens["\n"][line_end] = len(line_end) == 1

    def encode_words(words: list[str]) -> list[bytes]:
        after = [w for w in words if w[0] == " "]
        bare = [w for w in words if w[0] != " "]
        found = dict(zip(after, encode_some(after, " ", ""))) | dict(zip(bare, encode_some(bare, "\n", "\n")))
        return [found[w] for w in words]

    def encode_some(words: list[str], lead: str, put: str) -> Iterator[bytes]:
        # The library's encodings hold hundreds of bytes per token.
        for a in range(0, len(words), WORDS_AT_ONCE):
            some = words[a:a + WORDS_AT_ONCE]
            ids = ids_of("".join(put + w for w in some)) if "\n" not in some else np.empty(0, dtype)
            starts = np.flatnonzero(opens[lead][ids])
            if len(starts) != len(some):
                yield from (ids_of(w).tobytes() for w in some)
                continue
            data, width = ids.tobytes(), ids.itemsize
            cuts = [*(starts * width).tolist(), len(data)]
            skip = len(put) * width
            yield from (data[x + skip:y] for x, y in zip(cuts, cuts[1:]))

    return PieceEncoder(lambda text: ids_of(text).tobytes(), specials, dtype, encode_words, WORD_ENTRIES,
                        SLICE_BYTES), dtype


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id",
                      text: str = "text", folder: str | None = None) -> DataFrame:
    """Write the documents in ascending `key` order; gives the manifest, with
    each part's ``base``."""
    folder = folder or shared_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dtype = _library(tokenizer)
        path = None
        n_docs = n_ids = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if path is None:
                part = TaskContext.get().partitionId()
                path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
                ids, offsets, keys = (_create(path + x) for x in (".bin", ".off", ".key"))
            for flat, ends in encoder.encode_many(batch.column(1)):
                ids.write(np.insert(flat, ends, end_id).tobytes())
                ends = ends + np.arange(1, len(ends) + 1) + n_ids
                offsets.write(np.concatenate(([n_ids], ends[:-1])).astype("<i8").tobytes())
                n_ids = int(ends[-1])
            row_keys = np.zeros(batch.num_rows, KEY)
            row_keys["null"] = np.array(batch.column(0).is_null())
            row_keys["id"] = np.array(batch.column(0).fill_null(0))
            keys.write(row_keys.tobytes())
            n_docs += batch.num_rows
        if path is not None:
            offsets.write(np.array([n_ids], "<i8").tobytes())
            for f in (ids, offsets, keys):
                f.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "dtype": dtype,
                                               "n_docs": n_docs, "n_ids": n_ids}])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = ("key", F.xxhash64("text"), "text")
    manifest = materialise(rows.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions(*order)
                           .mapInArrow(run, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(manifest: DataFrame, column: T.StructField,
          make: Callable[[list[np.ndarray]], pa.Array]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                ids = _mapped(part["path"] + ".bin", part["dtype"])
                offsets = _mapped(part["path"] + ".off", "<i8")
                keys = _mapped(part["path"] + ".key", KEY)
                for a in range(0, part["n_docs"], DOCS_PER_BATCH):
                    at = np.array(offsets[a:a + DOCS_PER_BATCH + 1])
                    own = np.array(keys[a:a + DOCS_PER_BATCH])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own["id"], mask=own["null"] == 1),
                        pa.array(at[:-1] + part["base"]), pa.array(np.diff(at)),
                        make([ids[x:y] for x, y in zip(at[:-1], at[1:])])], names)

    fields = [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens")] + [column]
    names = [f.name for f in fields]
    parts = max(1, manifest.count())
    return manifest.repartition(parts).mapInArrow(run, T.StructType(fields))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files."""
    return _read(manifest, T.StructField("ids", T.ArrayType(T.LongType())),
                 lambda rows: list_column(np.concatenate(rows).astype("<i8"), np.cumsum([len(r) for r in rows])))


def token_file_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files;
    the checksum is that of the ids as little-endian unsigned 32-bit integers."""
    return _read(manifest, T.StructField("ids_crc32", T.LongType()),
                 lambda rows: pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()))
