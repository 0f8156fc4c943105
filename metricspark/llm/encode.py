"""BPE encoding and decoding of a text column by forced boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from metricspark.llm.bpe import coder


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again: (id, ids, n_tokens, decoded).

    ``tokenizer`` is the place of a tokenizer file on every machine. ``ids`` holds
    little-endian unsigned 32-bit integers; ``decoded`` is the decoded text of a
    byte-level file, special tokens kept. One row for each input row, whatever its id:
    null and empty texts have no ids and an empty decoded text. Other columns of df
    are left out.
    """
    source = df.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, j, ids, at in bpe.encode_slices(texts):
                n = at[1:] - at[:-1]
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
                        pa.array(n),
                        pa.array([bpe.decode(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()),
                    ],
                    names=[id_col, "ids", "n_tokens", "decoded"],
                )

    return source.mapInArrow(run, f"`{id_col}` {id_type}, ids binary, n_tokens long, decoded string")
