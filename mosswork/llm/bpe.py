"""BPE encoding and decoding with content-defined chunk reuse.

Each task keeps a bounded store of chunks (see tokens.ChunkEncoder), which lasts over the tasks of a worker process:
a chunk that documents share is encoded once and its ids looked up, and joins are repaired by
encoding the seam anew. Chunks are not sent between machines: shuffling texts and ids costs more
than encoding them, and a lost executor loses memory only. No shuffle at all, one output row per input row.

Defined cases: a null text is empty and has no tokens; ids and rows may repeat; an empty table
gives an empty result; further columns are dropped. Special strings inside a text are read as the
tokenizer file says (its special tokens).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, batches, only
from .tokens import ChunkEncoder, opened


def encode(documents: DataFrame, vocabulary: str, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, ids (array<int>), decoded."""
    return _mapped(documents, vocabulary, doc_id, text, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]),
                   "doc_id long, ids array<int>, decoded string", lambda ids, decoded: ([int(x) for x in ids.split(",")] if ids else [], decoded))


def digests(documents: DataFrame, vocabulary: str, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as `encode`, without moving ids and texts out of the task."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _mapped(documents, vocabulary, doc_id, text, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
                   "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, decoded: (ids.count(",") + 1 if ids else 0, sha(ids), sha(decoded)))


def _mapped(documents, vocabulary, doc_id, text, schema, ddl, row):
    def run(it):
        encoder = opened(ChunkEncoder, vocabulary)
        for b in batches(it):
            rows = [(doc, *row(*encoder.encode(t or ""))) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if rows:
                yield batch(schema, *map(list, zip(*rows, strict=True)))

    return only(documents, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)
