"""Token ids as flat binary files with 64-bit document offsets (operator 5).

Layout of a folder: ``shard-00000.ids`` holds the ids of its documents, one after the other, as
little-endian unsigned integers of 16 bits where the vocabulary allows it and 32 bits otherwise;
``shard-00000.idx`` holds the documents of the shard as pairs of 64-bit little-endian numbers: the
offset of its first id within the shard, and its doc_id; the offset after the last document ends the
file. Shards follow each other in ascending doc_id order. The manifest, a small Parquet table beside
them, has a row per shard with its base: the number of ids in all shards before it.

Documents are dealt into ranges of doc_id and encoded where they are written, so that only texts are
shuffled. A shard is written under a name of its own for each attempt and then moved to its place, so
that a repeated task leaves the same file. Readers map the files into memory where the folder is local
to them and read them by range elsewhere.

Texts are encoded as by ``encode(text, add_special_tokens=False)``: a special token that stands in a text gets its id.
A null text is empty: it has the end id alone. A null doc_id comes first and is kept as null. Rows that
share a doc_id are documents of their own, in order of their texts. An empty table gives an empty
manifest. Other columns are not read.
"""

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewise.llm.common import tasks

END_ID = 2
NO_DOC = -(1 << 63)
# Pieces whose ids a worker remembers; beyond that it starts over. It only saves time.
REMEMBERED = 500_000
DOCS_AT_ONCE = 64
# A blank between non-blanks always begins a piece of its own in a byte-level tokenizer.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
# Letters behind at most a blank, and marks behind them: two pieces, or one, by any such tokenizer.
_PLAIN = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,;:!?#$%&*|]*)")


MANIFEST = "shard INT, n_docs BIGINT, n_tokens BIGINT, width INT"


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves,
    the others for the letters from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class _Pieces(dict):
    """Piece to ids, learned on the first look. A piece that touches blanks within a text split at
    single blanks has no ids of its own: None."""

    def __init__(self, encoder: "Encoder", blank: str):
        self.encoder, self.blank = encoder, blank

    def __missing__(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            ids = None
        else:
            ids = self.encoder.encode(self.blank + piece)
        self[piece] = ids
        return ids

    def renew(self, lately: list[str]) -> "_Pieces":
        """Start over, with what was used lately."""
        new = _Pieces(self.encoder, self.blank)
        new.update((p, self[p]) for p in lately)
        return new


class Encoder:
    """Texts to ids. In a byte-level tokenizer the ids of a piece between single blanks do not depend on
    what is around it, so each different piece is encoded once by the tokenizer's own steps (its splits, then
    its model), and the ids of a text are those of its pieces in a row. Other tokenizers get whole texts."""

    def __init__(self, path: str, special: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        # Texts that hold one of these are encoded whole; all others are the same either way.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.by_piece = kind == "ByteLevel" and self.tokenizer.normalizer is None
        self.splitter, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.marks: dict[str, list[int]] = {}
        self.heads, self.tails = _Pieces(self, ""), _Pieces(self, " ")

    def encode(self, text: str) -> bytes:
        if not self.by_piece:
            return self._whole(text)
        if not (plain := _PLAIN.fullmatch(text)):
            parts = self.splitter.pre_tokenize_str(text)
            return self._packed([t.id for p, _ in parts for t in self.model.tokenize(p)])
        word, marks = plain.groups()
        if word.isascii():
            word = word.replace(" ", _LETTERS[32])
        else:
            word = word.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.model.tokenize(word)]
        if marks and marks not in self.marks:
            self.marks[marks] = [t.id for t in self.model.tokenize(marks)]
        return self._packed(ids + self.marks[marks] if marks else ids)

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _one(self, text: str) -> bytes:
        head, *tail = text.split(" ")
        try:
            return self.heads[head] + b"".join(map(self.tails.__getitem__, tail))
        except TypeError:  # blanks in a row: split between non-blanks only
            head, *tail = _SAFE.split(text)
            return self.encode(head) + b"".join([self.tails[p] or self.encode(" " + p) for p in tail])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``."""
        if not self.by_piece:
            return [self.encode(t) for t in texts]
        added = self.added.search if self.added else lambda text: None
        done = [self._whole(t) if added(t) else self._one(t) for t in texts]
        if len(self.tails) + len(self.heads) > REMEMBERED:
            lately = {p for t in texts for p in t.split(" ")[1:]}
            self.tails = self.tails.renew([p for p in lately if p in self.tails][: REMEMBERED // 4])
            self.heads = self.heads.renew([])
        return done


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = False) -> Encoder:
    """The encoder of a tokenizer file. With ``special``, added tokens that stand in a text get their own ids, as by
    the tokenizer's plain call; without, they are text like any other."""
    return Encoder(path, special)


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors reach, by any scheme that pyarrow knows."""
    if re.match(r"file:/", path):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _name(shard: int, kind: str) -> str:
    return f"shard-{shard:05d}.{kind}"


def _shard_writer(path: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer, special=True)
        fs, root = _folder(path)
        fs.create_dir(root)
        end = np.array([end_id], encode.dtype).tobytes()
        temporary = {k: f"{root}/.{_name(shard, k)}.{uuid.uuid4().hex}" for k in ("ids", "idx")}
        at = n = 0
        with fs.open_output_stream(temporary["ids"]) as ids, fs.open_output_stream(temporary["idx"]) as idx:
            for batch in batches:
                for i in range(0, len(batch), DOCS_AT_ONCE):
                    part = batch.slice(i, DOCS_AT_ONCE)
                    docs = part.column(0).fill_null(NO_DOC).to_numpy(zero_copy_only=False)
                    coded = [c + end for c in encode(part.column(1).fill_null("").to_pylist())]
                    sizes = np.array([len(c) for c in coded], np.int64) // encode.dtype.itemsize
                    pairs = np.empty((len(docs), 2), "<i8")
                    pairs[:, 0], pairs[:, 1] = at + np.cumsum(sizes) - sizes, docs
                    ids.write(b"".join(coded))
                    idx.write(pairs.tobytes())
                    at, n = at + int(sizes.sum()), n + len(docs)
            idx.write(np.array([at], "<i8").tobytes())
        for kind, name in temporary.items():
            final = f"{root}/{_name(shard, kind)}"
            if fs.get_file_info(final).type != pafs.FileType.NotFound:
                fs.delete_file(final)  # of an earlier attempt, with the same content
            fs.move(name, final)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "n_docs": [n], "n_tokens": [at],
                 "width": pa.array([encode.dtype.itemsize], pa.int32())}
            )

    return write


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None
) -> DataFrame:
    """Write ``docs (doc_id, text)`` into the folder ``path``, which all executors reach; the
    manifest (shard, n_docs, n_tokens, width, base). ``tokenizer`` is a file of the tokenizers library."""
    spark = docs.sparkSession
    written = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(shards or tasks(spark), F.asc_nulls_first("doc_id"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
        .mapInArrow(_shard_writer(path, tokenizer, end_id), MANIFEST)
    )
    written.write.mode("overwrite").parquet(f"{path}/written")
    # One row per shard: the prefix sums of the shards' sizes are the bases.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards_ = spark.read.schema(MANIFEST).parquet(f"{path}/written")
    based = shards_.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    based.write.mode("overwrite").parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, base BIGINT").parquet(f"{path}/manifest")


class Shard:
    """One shard, open for reading: ``bounds`` and ``doc_ids`` of its documents, ``ids(i)`` of one."""

    def __init__(self, path: str, shard: int, width: int):
        fs, root = _folder(path)
        self.dtype = np.dtype(f"<u{width}")
        opened = []
        for kind in ("idx", "ids"):
            name = f"{root}/{_name(shard, kind)}"
            local = isinstance(fs, pafs.LocalFileSystem)
            opened.append(pa.memory_map(name) if local else fs.open_input_file(name))
        index = np.frombuffer(opened[0].read_buffer(), "<i8")
        self.bounds = np.append(index[:-1:2], index[-1])
        self.doc_ids = index[1:-1:2]
        self.file = opened[1]

    def ids(self, i: int) -> np.ndarray:
        a, b = (int(x) * self.dtype.itemsize for x in self.bounds[i : i + 2])
        self.file.seek(a)
        return np.frombuffer(self.file.read_buffer(b - a), self.dtype)


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """A row per document, read back from the files: its place, its size and the crc32 of its ids
    as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(path, row["shard"], row["width"])
                for at in range(0, len(shard.doc_ids), 4096):
                    docs = shard.doc_ids[at : at + 4096]
                    bounds = shard.bounds[at : at + len(docs) + 1]
                    crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in range(at, at + len(docs))]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(docs, pa.int64(), mask=docs == NO_DOC),
                            "start": row["base"] + bounds[:-1],
                            "n_tokens": np.diff(bounds),
                            "ids_crc32": np.array(crc, np.int64),
                        }
                    )

    # A row per shard is little data but much work: a task for each.
    n = tasks(manifest.sparkSession)
    return manifest.repartition(n, "shard").mapInArrow(
        read, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"
    )
