"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens, cut into quanta. In each round, which is one window's worth of
quanta, a queue's deficit grows by its share of the round; it sends the whole quanta of its deficit and carries the
rest to the next round, window and partition. So after r rounds of S quanta a queue of n among N quanta has sent
floor(r S n / N), always less than one quantum behind its target, and where a quantum lands follows from its number and
the queues' totals alone: partitions place their documents independently.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ByteIds
from .common import Staged, bounded_batches

#: (chunk, source) rows that may be broadcast; more of them are joined by a shuffle.
BROADCAST_BASES = 500_000
#: Queues of one call, whose totals are handled on the driver. Where there are more sources, those without a weight share
#: queues by a hash of their name; every token is still packed, and shares hold for the queues.
MAX_QUEUES = 20_000
#: Quanta of one schedule, so that its products fit in 64 bits; beyond, quanta are larger.
MAX_QUANTA = 1 << 40
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, sequence_length long"
_ENCODED = "doc_id {id}, source string, queue string, chunk long, chunk_start long, n long, ids binary"


def _muldiv(a: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """floor(a p / n) for 0 <= a, p <= n < 2**40 without overflow."""
    high, low = p >> 20, p & 0xFFFFF
    q, r = np.divmod(a * high, n)
    return (q << 20) + ((r << 20) + a * low) // n


class Schedule:
    """Where each queue's tokens land on the tape of all windows."""

    def __init__(self, totals: dict[str, int], window: int, quantum: int, weights: dict[str, float] | None = None):
        if window % quantum or window & (window - 1):
            raise ValueError("window must be a power of two and a multiple of quantum")
        self.window, self.quantum, self.slots = window, quantum, window // quantum
        names = sorted(totals)
        left = {s: totals[s] // quantum for s in names}
        self.full = dict(left)
        self.total = sum(totals.values())
        self.phases: dict[str, list[tuple[int, int, int, np.ndarray]]] = {s: [] for s in names}  # the queue's first slot, tape start, its place among the phase's queues, their slots
        tape, served = 0, dict.fromkeys(names, 0)
        while sum(left.values()):
            share = self._phase(left, weights)
            share = {s: share[s] for s in names if share.get(s)}
            counts = np.array(list(share.values()), dtype=np.int64)
            if counts.sum() >= MAX_QUANTA:
                raise ValueError("more than 2**40 quanta of one window each")
            for place, (s, n) in enumerate(share.items()):
                self.phases[s].append((served[s], tape, place, counts))
                served[s] += n
                left[s] -= n
            tape += int(counts.sum())
        at = tape * quantum
        self.tail: dict[str, int] = {}
        for s in names:
            self.tail[s] = at
            at += totals[s] % quantum

    @staticmethod
    def _phase(left: dict[str, int], weights: dict[str, float] | None) -> dict[str, int]:
        """Quanta that each queue gives until the first one runs dry at the target weights; without weights, all of them."""
        live = {s: n for s, n in left.items() if n}
        if weights is None:
            return live
        wanted = {s: weights.get(s, 0.0) for s in live if weights.get(s, 0.0) > 0}
        if not wanted:
            return live
        dry = min(wanted, key=lambda s: live[s] / wanted[s])
        rounds = live[dry] / wanted[dry]
        return {s: live[s] if s == dry else min(live[s], int(rounds * w)) for s, w in wanted.items()}

    def runs(self, source: str, x0: int, x1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For tokens [x0, x1) of a queue: first token, length and tape position of each contiguous run within a window."""
        q, parts = self.quantum, []
        for first, start, place, counts in self.phases[source]:
            count, n = int(counts[place]), int(counts.sum())
            a, b = max(x0 // q, first) - first, min(-(-x1 // q), first + count) - first
            if a >= b:
                continue
            # Quantum j leaves in the first round whose end has j + 1 of the queue sent.
            rounds = np.array(sorted({-(-(j + 1) * n // (self.slots * count)) - 1 for j in range(a, b)}), dtype=np.int64)[:, None]
            sent, after = (_muldiv(np.minimum(r * self.slots, n), counts[None, :], n) for r in (rounds, rounds + 1))
            begin, end = np.maximum(sent[:, place], a), np.minimum(after[:, place], b)
            ok = begin < end
            slot = start + sent.sum(1) + (after - sent)[:, :place].sum(1) + (begin - sent[:, place])
            parts.append(np.stack([(begin + first) * q, (end + first) * q, slot * q])[:, ok])
        full = self.full[source] * q
        if x1 > full:
            t = max(x0, full)
            parts.append(np.array([[t], [x1], [self.tail[source] + t - full]], dtype=np.int64))
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        begin, end, tape = np.concatenate(parts, axis=1)
        cut = np.maximum(begin, x0)
        tape, begin, end = tape + (cut - begin), cut, np.minimum(end, x1)
        return self._within_windows(begin, end - begin, tape)

    def _within_windows(self, begin: np.ndarray, length: np.ndarray, tape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # A round sends a queue at most a window, so a run crosses at most one border.
        room = self.window - tape % self.window
        over = length > room
        if over.any():
            extra = (begin[over] + room[over], length[over] - room[over], tape[over] + room[over])
            length = np.minimum(length, room)
            begin, length, tape = (np.concatenate(x) for x in zip((begin, length, tape), extra))
        edge = self.total // self.window * self.window
        if len(tape) and (tape + length).max() > edge:
            borders = self.borders()
            pieces = [p for r in zip(begin.tolist(), length.tolist(), tape.tolist()) for p in ([r] if r[2] + r[1] <= edge else self._split(*r, borders))]
            begin, length, tape = (np.array(x, dtype=np.int64) for x in zip(*pieces))
        order = np.argsort(begin)
        return begin[order], length[order], tape[order]

    def borders(self) -> list[tuple[int, int, int]]:
        """What is left after the last full window goes to sequences of power-of-two lengths: tape start, length, sequence."""
        at, left, out = self.total // self.window * self.window, self.total % self.window, []
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                out.append((at, 1 << bit, self.total // self.window + len(out)))
                at += 1 << bit
        return out

    @staticmethod
    def _split(begin: int, length: int, tape: int, borders: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out = []
        for start, size, _ in borders:
            a, b = max(tape, start), min(tape + length, start + size)
            if a < b:
                out.append((begin + a - tape, b - a, a))
        return out

    def place(self, tape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset in it and its length for tape positions."""
        sequence, offset, size = tape // self.window, tape % self.window, np.full(len(tape), self.window, dtype=np.int64)
        edge = self.total // self.window * self.window
        for i in np.flatnonzero(tape >= edge):
            start, length, number = next(b for b in self.borders() if b[0] <= tape[i] < b[0] + b[1])
            sequence[i], offset[i], size[i] = number, tape[i] - start, length
        return sequence, offset, size


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, window: int = 1024, quantum: int = 64, weights: dict[str, float] | None = None, end_id: int = 0) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text, source) into sequences of ``window`` tokens; one row per piece of a document.

    A document is its text's ids and ``end_id``; a null text is empty and a null source is a queue of its own. Each id
    lies in exactly one piece; sequences are full but for the last few, whose lengths are powers of two, so nothing is
    padded. ``weights`` are target token proportions of sources (default: each source's share of all tokens, so that
    every window has the corpus' mixture and all queues end together); when a queue runs dry the others keep their
    proportions. Repeated rows and ids are packed as they come, an empty table gives no piece, extra columns are not
    read.
    """
    bounded_batches(spark)
    staged = Staged(spark, "packing")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    named = F.coalesce(F.col("source"), F.lit("\x00null"))
    rows = docs.select("doc_id", named.alias("source"), named.alias("queue"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if docs.select("source").distinct().limit(MAX_QUEUES + 1).count() > MAX_QUEUES:
        own = F.col("source").isin([*(weights or {})]) if weights else F.lit(False)
        rows = rows.withColumn("queue", F.when(own, F.col("source")).otherwise(F.concat(F.lit("\x00"), F.pmod(F.xxhash64("source"), F.lit(MAX_QUEUES // 2)).cast("string"))))

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ids, chunk, at = ByteIds(tokenizer_path), TaskContext.get().partitionId(), {}
        for batch in batches:
            starts, counts, blobs = [], [], []
            queues = batch.column("queue").to_pylist()
            for queue, text in zip(queues, batch.column("text").to_pylist()):
                got = ids.ids(text)
                got.append(end_id)
                starts.append(at.get(queue, 0))
                counts.append(len(got))
                at[queue] = starts[-1] + len(got)
                blobs.append(got.tobytes() if got.itemsize == 4 else np.frombuffer(got, "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("queue"), pa.array([chunk] * len(counts), pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "source", "queue", "chunk", "chunk_start", "n", "ids"])

    encoded = staged.write(rows.mapInArrow(encode, _ENCODED.format(id=id_type)), "ids")
    per_chunk = staged.write(encoded.groupBy("chunk", "queue").agg(F.sum("n").alias("tokens")), "chunks")
    found = {r["queue"]: r["tokens"] for r in per_chunk.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}
    while quantum < window and sum(found.values()) // quantum >= MAX_QUANTA:
        quantum *= 2
    schedule = Schedule(found, window, quantum, weights)

    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = per_chunk.select("chunk", "queue", before.alias("base"))
    if per_chunk.limit(BROADCAST_BASES + 1).count() <= BROADCAST_BASES:
        bases = F.broadcast(bases)
    placed = encoded.join(bases, ["chunk", "queue"]).select("doc_id", "source", "queue", (F.col("base") + F.col("chunk_start")).alias("first"), "n", "ids")
    wide = ByteIds(tokenizer_path).code == "I"

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            sums: list[int] = []
            repeats = []
            sources, counts = batch.column("source").to_pylist(), batch.column("n").to_pylist()
            for queue, first, n, blob in zip(batch.column("queue").to_pylist(), batch.column("first").to_pylist(), counts, batch.column("ids").to_pylist()):
                data = memoryview(blob if wide else np.frombuffer(blob, "<u2").astype("<u4").tobytes())
                begin, length, tape = schedule.runs(queue, first, first + n)
                begin = begin - first
                sequence, offset, size = schedule.place(tape)
                for column, values in zip(columns, (begin, length, sequence, offset, size)):
                    column.append(values)
                sums += [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                repeats.append(len(begin))
            if not sums:
                continue
            take = np.repeat(np.arange(len(repeats)), repeats)
            begin, length, sequence, offset, size = (np.concatenate(c) for c in columns[:5])
            named = pa.array([None if s == "\x00null" else s for s in sources], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(take)), pa.array(begin), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.asarray(counts, np.int64)[take]), pa.array(sequence), pa.array(offset), named.take(pa.array(take)), pa.array(size)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "sequence_length"],
            )

    return placed.mapInArrow(cut, PIECES.format(id=id_type))
