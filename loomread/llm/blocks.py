"""Documents packed into blocks of some megabytes, kept as a table that is bucketed by block.

Operators that need corpus-wide facts about what a text holds (counts of its words, owners of its substrings) ask block
by block: each block sends its distinct keys, the answers come back keyed by block, and a cogroup meets them with the
block's texts. As the table is bucketed, only questions and answers are shuffled, never the texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.storage import shared_dir


def pack(table) -> bytes:
    import pyarrow as pa

    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def unpack(payload):
    import pyarrow as pa

    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def blocked(docs: DataFrame, text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(block, n_rows, n_bytes, payload): every row of ``docs``, all its columns as Arrow data, about block_bytes of text each.

    A block takes whole rows in the order in which a task reads them; a longer text is a block of its own. The table is
    written once under spark.checkpoint.dir, so that a block holds the same rows whenever it is read again; there are
    as many buckets as shuffle partitions, so that answers shuffled by block meet it in place.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held, size, n = [], 0, 0

        def row():
            t = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), pa.array([t.num_rows], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(t)], pa.binary())],
                                              ["block", "n_rows", "n_bytes", "payload"])

        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()
            begun = 0
            for i, length in enumerate(lengths):
                if size and size + length > block_bytes:
                    if i > begun:
                        held.append(b.slice(begun, i - begun))
                    yield row()
                    held, size, n, begun = [], 0, n + 1, i
                size += length
            if len(lengths) > begun:
                held.append(b.slice(begun))
        if held:
            yield row()

    name = f"llm_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (docs.mapInArrow(run, "block long, n_rows long, n_bytes long, payload binary").write.option("path", f"{shared_dir(spark)}/{name}")
     .bucketBy(buckets, "block").saveAsTable(name))
    return spark.table(name)


def with_answers(blocks: DataFrame, answers: DataFrame, run, schema) -> DataFrame:
    """run(texts, answers) -> Arrow table for each block of ``blocks``, with its rows of ``answers`` (which has a block column)."""
    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n_bytes")).first()[0] or 0
