"""Token counts from flat token files: a vectorised scan for separators, stitched across blocks by a prefix scan.

A token file is a run of unsigned 16-bit ids without any index; a document ends at an end-of-document id. Files are
held as rows (file, block, ids): blocks have a fixed number of ids and cut documents anywhere. Each block is scanned on
its own: lengths between separators, the open head before the first and the open tail after the last. The number of
separators in earlier blocks of the file (a prefix scan over one row a block) numbers the documents, and the parts of a
document that spans blocks add up by that number, however many blocks it spans.

Defined results: a null or empty text has 0 tokens; a document without its end-of-document id (a cut file) is reported
with ``closed`` false if it has tokens; a separator string within a text is ordinary text; repeated rows are counted
each; no rows give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize

EOD = 50256  # the free id of the vocabulary
BLOCK = 1 << 18  # ids a block


def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Encodes every text and appends ``EOD``: (file, block, ids), and the order of documents (file, ordinal, doc_id)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, file = encoder(path), TaskContext.get().partitionId()
        held, size, number, ordinal = [], 0, 0, 0

        def out(kind: int, blocks: list, ids: list, docs_: list, ordinals: list) -> pa.RecordBatch:
            n = max(len(blocks), len(docs_))
            cols = [
                pa.array([file] * n, pa.int32()), pa.array(blocks or [None] * n, pa.int32()), pa.array(ids or [None] * n, pa.binary()),
                pa.array(docs_ if docs_ else [None] * n, pa.int64()), pa.array(ordinals or [None] * n, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["file", "block", "ids", "doc_id", "ordinal"])

        for batch in batches:
            names = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.fromiter(enc.encode_ordinary(text.as_py() or ""), np.uint16)
                held += [ids, np.array([EOD], np.uint16)]
                size += len(ids) + 1
                names.append(doc)
                if size >= block:
                    flat = np.concatenate(held)
                    whole = len(flat) // block
                    parts = [flat[i * block : (i + 1) * block].tobytes() for i in range(whole)]
                    yield out(0, list(range(number, number + whole)), parts, [], [])
                    number, held = number + whole, [flat[whole * block :]]
                    size = len(held[0])
            if names:
                yield out(1, [], [], names, list(range(ordinal, ordinal + len(names))))
                ordinal += len(names)
        if size:
            yield out(0, [number], [np.concatenate(held).tobytes()], [], [])

    schema = "file int, block int, ids binary, doc_id long, ordinal long"
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)
    made = materialize(made, "token-files")
    return made.where("ids is not null").select("file", "block", "ids"), made.where("ids is null").select("file", "ordinal", "doc_id")


def count_tokens(files: DataFrame, eod: int = EOD) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in ``files`` (file, block, ids)."""

    def separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                flat = np.frombuffer(ids.as_buffer(), np.uint16)
                at = np.flatnonzero(flat == eod)
                lengths = np.diff(np.concatenate([[-1], at, [len(flat)]])) - 1  # the last is the open tail
                n = len(lengths)
                closed = np.ones(n, bool)
                closed[-1] = False
                cols = [np.full(n, file, np.int32), np.full(n, block, np.int32), np.arange(n, dtype=np.int64), lengths.astype(np.int64), closed]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["file", "block", "part", "n", "closed"])

    parts = files.select("file", "block", "ids").mapInArrow(separators, "file int, block int, part long, n long, closed boolean")
    parts = materialize(parts, "token-parts")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.groupBy("file", "block").agg(F.count_if("closed").alias("c")).withColumn("ahead", F.coalesce(F.sum("c").over(before), F.lit(0)))
    numbered = parts.join(ahead.drop("c"), ["file", "block"]).withColumn("ordinal", F.col("ahead") + F.col("part"))
    docs = numbered.groupBy("file", "ordinal").agg(F.sum("n").alias("n_tokens"), F.bool_or("closed").alias("closed"))
    return docs.where("closed or n_tokens > 0")
