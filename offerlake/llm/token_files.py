"""Token-ID output: Arrow IPC files of fixed-size-list batches, and reading them back by document.

``write_token_files`` range-partitions documents by id, tokenizes each partition in id order, ends every
document with ``end_id`` and writes one file per partition into the shared folder. A file is a run of
record batches with two columns: ``ids``, a fixed-size list of ``seq_len`` token ids (16 bits where the
vocabulary fits, else 32), and ``mask``, a fixed-size list of as many booleans. Only a file's last
sequence is padded (id 0, mask false). All batches but the last have ``batch_rows`` sequences, so sequence
``i`` is row ``i % batch_rows`` of batch ``i // batch_rows``: a memory map gives it without a copy. Beside
each file lies its index: doc_id, the file's token where the document starts, and how many tokens it has.

Files are written under a name of the attempt and then renamed, so a retried or doubled task leaves one
whole file. Nulls and empty texts give the end id alone; repeated ids stay separate rows, ordered by text;
an empty table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, encoder, fresh_path

SEQ_LEN = 2048
BATCH_ROWS = 256
#: Text of one file, about.
FILE_BYTES = 256_000_000


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class _Writer:
    """Cuts a stream of ids into sequences and batches, holding one batch at most."""

    def __init__(self, sink, kind: np.dtype, seq_len: int, batch_rows: int) -> None:
        self.seq_len, self.room = seq_len, seq_len * batch_rows
        self.buffer, self.fill, self.kind = np.zeros(self.room, kind), 0, kind
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_file(sink, self.schema.with_metadata({"offerlake": json.dumps({"seq_len": seq_len, "batch_rows": batch_rows})}))

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(self.room - self.fill, len(ids) - at)
            self.buffer[self.fill : self.fill + n] = ids[at : at + n]
            self.fill, at = self.fill + n, at + n
            if self.fill == self.room:
                self.flush()

    def flush(self) -> None:
        if self.fill:
            whole = -(-self.fill // self.seq_len) * self.seq_len
            ids = self.buffer[:whole].copy()
            ids[self.fill :] = 0
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, np.arange(whole) < self.fill)]
            self.out.write_batch(pa.record_batch(cols, schema=self.schema))
            self.fill = 0

    def close(self) -> None:
        self.flush()
        self.out.close()


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS, partitions: int | None = None) -> list[dict]:
    """Write the files; a dict per file (part, path, n_docs, n_tokens, start) comes back, in id order.

    What reaches the driver is one small row per file, whatever the files hold.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions
    if not n:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def write(batches):
        context, enc = TaskContext.get(), encoder(tokenizer)
        part, (fs, base) = context.partitionId(), _fs(out_dir)
        kind = np.dtype("<u2") if enc.size <= 65536 else np.dtype("<u4")
        own = f"{base}/.part-{part:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        fs.create_dir(base, recursive=True)
        n_docs, total = 0, 0
        with fs.open_output_stream(own) as sink, fs.open_output_stream(own + "-index") as index_sink:
            writer, index = _Writer(sink, kind, seq_len, batch_rows), None
            for batch in batches:
                done = 0
                for ids, counts in enc.encode_column(batch.column(1), end_id):
                    writer.add(ids.astype(kind))
                    first = total + np.cumsum(counts) - counts
                    about = pa.record_batch([batch.column(0).slice(done, len(counts)), pa.array(first), pa.array(counts)], names=["doc_id", "first", "n_tokens"])
                    index = index or pa.ipc.new_file(index_sink, about.schema)
                    index.write_batch(about)
                    done, total, n_docs = done + len(counts), total + len(ids), n_docs + len(counts)
            writer.close()
            if index:
                index.close()
        if not n_docs:
            fs.delete_file(own)
            fs.delete_file(own + "-index")
            return
        path = f"part-{part:06d}.arrow"
        fs.move(own + "-index", f"{base}/{path}.index")
        fs.move(own, f"{base}/{path}")
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([total], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    files = [r.asDict() for r in rows.mapInArrow(write, "part int, path string, n_docs long, n_tokens long").collect()]
    start = 0
    for f in sorted(files, key=lambda f: f["part"]):
        f["start"], start = start, start + f["n_tokens"]
    return sorted(files, key=lambda f: f["part"])


class TokenFile:
    """One file, for random access: a sequence and its mask, or the ids of a document."""

    def __init__(self, uri: str) -> None:
        fs, path = _fs(uri)
        self._source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self._file = pa.ipc.open_file(self._source)
        about = json.loads(self._file.schema.metadata[b"offerlake"])
        self.seq_len, self.batch_rows = about["seq_len"], about["batch_rows"]
        self._at, self._batch = -1, None
        self._index = pa.memory_map(path + ".index") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path + ".index")

    def index(self) -> Iterator[pa.RecordBatch]:
        """doc_id, first and n_tokens of the documents, a batch at a time."""
        reader = pa.ipc.open_file(self._index)
        for k in range(reader.num_record_batches):
            yield reader.get_batch(k)

    def _get(self, k: int):
        if k != self._at:
            self._at, self._batch = k, self._file.get_batch(k)
        return self._batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence ``i``."""
        batch, r = self._get(i // self.batch_rows), i % self.batch_rows
        ids, mask = batch.column(0).values, batch.column(1).values
        return ids.slice(r * self.seq_len, self.seq_len).to_numpy(), mask.slice(r * self.seq_len, self.seq_len).to_numpy(zero_copy_only=False)

    def tokens(self, first: int, n: int) -> np.ndarray:
        room, out = self.seq_len * self.batch_rows, []
        while n > 0:
            k, at = divmod(first, room)
            m = min(room - at, n)
            out.append(self._get(k).column(0).values.slice(at, m).to_numpy())
            first, n = first + m, n - m
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)


def read_token_files(spark, files: list[dict], out_dir: str, *, id_type: str = "long") -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(f"{out_dir}/{row['path']}")
                for ix in file.index():
                    first, n = (ix.column(c).to_numpy() for c in (1, 2))
                    ids, own = np.empty(0, np.uint32), []
                    for f, m in zip(first.tolist(), n.tolist()):
                        if m > len(ids):
                            # the next 2 million ids at once, or one document's
                            at, to = f, max(f + m, min(f + 2_000_000, int(first[-1] + n[-1])))
                            ids = file.tokens(at, to - at).astype("<u4")
                        own.append(crc32(ids[:m]))
                        ids = ids[m:]
                    yield pa.record_batch([ix.column(0), pa.array(first + row["start"]), ix.column(2), pa.array(own, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame([(f["path"], f["start"]) for f in files], "path string, start long")
    return rows.repartition(len(files)).mapInArrow(read, schema)


fresh_dir = fresh_path
