"""Vector bin packing of examples into sequences of bounded length.

Every example has a demand for three resources: tokens, one segment, and tokens
that bear loss. A sequence offers a fixed amount of each. The dot-product heuristic
puts into the open sequence the example that fits and whose demand has the largest
dot product with what the sequence has left, both as shares of the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricspark.llm.bpe import coder

#: Examples that a task chooses from at once.
WINDOW = 4096


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most; ``cut_from``: room for which an example is cut."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2047
    cut_from: int = 16


@dataclass
class Piece:
    row: int  # of the example
    start: int
    length: int
    loss: int


@dataclass
class Packer:
    """Packs a stream of examples; only one sequence is open between calls."""

    limits: Limits
    sequence: int = 0
    used: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: (tokens, loss) of the examples that wait, and their pieces
    waiting: list[Piece] = field(default_factory=list)

    def close(self) -> None:
        self.sequence += 1
        self.used = np.zeros(3)

    def place(self, piece: Piece) -> tuple[Piece, int, int]:
        at = int(self.used[0])
        self.used += (piece.length, 1, piece.loss)
        return piece, self.sequence, at

    def pack(self, pieces: list[Piece], loss_of: Callable[[int, int, int], int]) -> Iterator[tuple[Piece, int, int]]:
        """Place all pieces: (piece, sequence, offset). Pieces longer than a sequence are cut.

        ``loss_of(row, start, length)`` is the number of loss-bearing tokens of a piece
        that begins there.
        """
        whole = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=float)
        todo: list[Piece] = []
        for p in pieces:
            while p.length > self.limits.tokens or p.loss > self.limits.loss:
                n = min(self.limits.tokens, p.length - 1)
                while loss_of(p.row, p.start, n) > self.limits.loss:
                    n = max(1, n - (loss_of(p.row, p.start, n) - self.limits.loss))
                todo.append(Piece(p.row, p.start, n, loss_of(p.row, p.start, n)))
                p = Piece(p.row, p.start + n, p.length - n, loss_of(p.row, p.start + n, p.length - n))
            todo.append(p)
        demand = np.array([(p.length, 1, p.loss) for p in todo], dtype=float).reshape(-1, 3)
        alive = np.ones(len(todo), dtype=bool)
        left = len(todo)
        while left:
            room = whole - self.used
            fits = alive & (demand <= room).all(axis=1)
            score = np.where(fits, (demand / whole) @ (room / whole), -1.0)
            k = int(score.argmax()) if len(score) else 0
            if score[k] >= 0:
                yield self.place(todo[k])
                alive[k] = False
                left -= 1
            elif room[0] >= self.limits.cut_from and room[1] >= 1 and room[2] >= 1:
                # Nothing fits: the longest example gives what the sequence has room for.
                k = int(np.where(alive, demand[:, 0], -1).argmax())
                p = todo[k]
                n = int(min(room[0], p.length - 1))
                while n > 1 and loss_of(p.row, p.start, n) > room[2]:
                    n = max(1, n - int(loss_of(p.row, p.start, n) - room[2]))
                yield self.place(Piece(p.row, p.start, n, loss_of(p.row, p.start, n)))
                todo[k] = p = Piece(p.row, p.start + n, p.length - n, loss_of(p.row, p.start + n, p.length - n))
                demand[k] = (p.length, 1, p.loss)
            else:
                self.close()
            if left and left < len(todo) // 2:
                rest = np.flatnonzero(alive)
                todo, demand = [todo[i] for i in rest], demand[rest]
                alive = np.ones(len(todo), dtype=bool)


def pack(
    df: DataFrame,
    tokenizer: str,
    limits: Limits = Limits(),
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
) -> DataFrame:
    """Encode all texts, end each with ``end_id`` and pack them into sequences.

    With ``prompt_col``, as in instruction data, an example is its prompt and then its
    text; the prompt's ids bear no loss. A null prompt is empty.

    One row for each piece: id, start (the example's ids before it), length, ids (packed
    as unsigned 32-bit integers), doc_tokens (with the end), sequence_id, offset (in the
    sequence, gapless from 0), n_loss. Each id of an example lies in exactly one piece.
    An example's first id bears no loss, as nothing predicts it, nor does the first of a
    piece that was cut off.

    Tasks pack the rows of their own partition, with no shuffle: the sequence id holds
    the partition, and each partition leaves one sequence partly filled at most. Null
    and empty texts are examples of one id, the end; rows with the same or a null id are
    examples of their own; other columns are left out; no rows give none.
    """
    source = df.select(id_col, text_col, *([F.col(prompt_col).alias("__prompt")] if prompt_col else []))
    id_type = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        packer = Packer(limits)
        part = TaskContext.get().partitionId() << 32
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            prompts = [bpe.encode(x or "") for x in batch.column(2).to_pylist()] if prompt_col else None

            def loss(row: int, start: int, length: int) -> int:
                """Ids of a piece after the prompt and after its own first one."""
                free = len(prompts[row]) if prompts else 0
                return max(0, start + length - max(start + 1, free))

            for i, j, ids, at in bpe.encode_slices(texts):
                for first in range(i, j, WINDOW):
                    last = min(j, first + WINDOW)
                    own = lambda k: ids[at[k - i] : at[k - i + 1]]
                    docs = [np.concatenate([*([prompts[k]] if prompts else []), own(k), end]) for k in range(first, last)]
                    loss_here = lambda row, start, length: loss(first + row, start, length)
                    pieces = [Piece(k, 0, len(d), loss_here(k, 0, len(d))) for k, d in enumerate(docs)]
                    rows = list(packer.pack(pieces, loss_here))
                    take = pa.array([first + p.row for p, _, _ in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(take),
                            pa.array([p.start for p, _, _ in rows], pa.int64()),
                            pa.array([p.length for p, _, _ in rows], pa.int64()),
                            pa.array([docs[p.row][p.start : p.start + p.length].tobytes() for p, _, _ in rows], pa.binary()),
                            pa.array([len(docs[p.row]) for p, _, _ in rows], pa.int64()),
                            pa.array([part + s for _, s, _ in rows], pa.int64()),
                            pa.array([o for _, _, o in rows], pa.int64()),
                            pa.array([p.loss for p, _, _ in rows], pa.int64()),
                        ],
                        names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "n_loss"],
                    )

    return source.mapInArrow(
        run,
        f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long,"
        " sequence_id long, offset long, n_loss long",
    )
