"""Uploads that arrive in pieces, put together by a stateful stream.

An upload is a header, then for each file in turn a start, its chunks and an end; every piece has a number within the
upload. Pieces may come in any order and more than once, over any number of micro-batches: one that is ahead waits in
state, in an entry of up to 64 numbers (long data apart), one that is behind is a repetition and is dropped. What a micro-batch
brings to the open file is an entry of its own in state, never one growing value, and a file beyond its limit is no
longer held. A call talks to state once for its progress and once for each entry that it reads or changes, not for each
piece, and holds 8 MB of pieces before they go there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PIECE = "upload_id long, seq int, kind string, file_index int, name string, data binary, sha256 string, at timestamp"
RESULT = "upload_id long, file_index int, name string, status string, code string, size long, sha256 string, content binary"
_PROGRESS = (
    "next int, files int, open int, received int, good int, total long, size long, chunks int, waiting int, due long, name string, "
    "too_large boolean, done boolean"
)
_NEW = (0, 0, -1, 0, 0, 0, 0, 0, 0, -1, "", False, False)
_EARLY = "pieces array<struct<seq: int, kind: string, file_index: int, name: string, data: binary, sha256: string, apart: boolean>>"
_NAMES = [f.split()[0] for f in _PROGRESS.split(", ")]
Verdict = Row(*(f.split()[0] for f in RESULT.split(", ")))
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Numbers that share an entry of waiting pieces, bytes of a piece whose data waits apart, and bytes that a call holds before they go to state.
PACK, APART, HELD = 64, 64 << 10, 8 << 20


@dataclass(frozen=True)
class Limits:
    """What an upload may hold, and how long after its last piece it is given up."""

    files: int = 20
    file_bytes: int = 64 << 20
    request_bytes: int = 256 << 20
    wait_seconds: int = 3600


class Assembly(StatefulProcessor):
    """Pieces of one upload to verdicts: a row for each file that ends, and one without a file for the upload.

    Files are ACCEPTED with their content, or REJECTED as TOO_LARGE or CHECKSUM_MISMATCH. The upload is COMPLETED, PARTIAL
    or FAILED once its last file has ended; INVALID_REQUEST where pieces contradict each other, TOO_LARGE beyond the
    limit of all its bytes, INCOMPLETE when it is given up. What comes after a verdict on the upload is dropped.
    """

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", _PROGRESS)
        self.early = handle.getMapState("early", "pack int", _EARLY)
        self.large = handle.getMapState("large", "seq int", "data binary")
        self.chunks = handle.getMapState("chunks", "number int", "data binary")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = self._begin()
        latest, out = 0, []
        for piece in rows:
            latest = max(latest, int(piece.at.timestamp() * 1000))
            if at["done"] or piece.seq < at["next"]:
                continue
            ahead = piece.seq > at["next"]
            if ahead and piece.seq in self._pack(at, piece.seq):
                continue
            own = (piece.kind, piece.file_index, piece.name, piece.data, piece.sha256)
            at["total"] += len(own[3] or b"")
            if at["total"] > self.limits.request_bytes:
                out.append(self._end(key, at, "TOO_LARGE"))
            elif ahead:
                self._wait(at, piece.seq, own)
            else:
                out += self._take(key, at, own)
                while not at["done"] and at["waiting"] and at["next"] in self._pack(at, at["next"]):
                    out += self._take(key, at, self._waited(at))
        self._store(at)
        self._store_tail(at)
        if latest > at["due"]:  # the watermark is behind by the wait
            if at["due"] >= 0:
                self.handle.deleteTimer(at["due"])
            self.handle.registerTimer(latest)
            at["due"] = latest
        self.progress.update(tuple(at[n] for n in _NAMES))
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = self._begin()
        out = [] if at["due"] < 0 or at["done"] else [self._end(key, at, "INCOMPLETE")]
        self.progress.clear()
        return iter(out)

    def close(self) -> None:
        pass

    def _begin(self) -> dict:
        """What state tells of an upload; nothing else of it is held yet."""
        found = self.progress.get()
        at = dict(zip(_NAMES, _NEW if found is None else found, strict=True))
        self.packs: dict[int, dict] = {}
        self.changed: set[int] = set()
        self.tail: list[bytes] = []
        self.held, self.tail_bytes, self.stored = 0, 0, at["waiting"] > 0
        return at

    def _pack(self, at: dict, seq: int) -> dict:
        """The waiting pieces whose numbers share an entry with this one, read from state where a call does not hold them."""
        number = seq // PACK
        if number not in self.packs:
            if self.held > HELD:
                self._store(at)
            found = self.early.getValue((number,)) if self.stored else None
            self.packs[number] = {p[0]: tuple(p[1:]) for p in found[0]} if found else {}
            self.held += sum(len(p[3] or b"") for p in self.packs[number].values())
        return self.packs[number]

    def _wait(self, at: dict, seq: int, piece: tuple) -> None:
        """Keep a piece until its turn."""
        apart = len(piece[3] or b"") > APART
        if apart:
            self.large.updateValue((int(seq),), (piece[3],))
            piece = (*piece[:3], None, piece[4])
        self._pack(at, seq)[seq] = (*piece, apart)
        self.changed.add(seq // PACK)
        self.held += len(piece[3] or b"") + 256  # about what the rest of a piece takes
        at["waiting"] += 1
        if self.held > HELD:
            self._store(at)

    def _waited(self, at: dict) -> tuple:
        """The next piece, which has waited and does so no longer."""
        seq = at["next"]
        *piece, apart = self._pack(at, seq).pop(seq)
        self.changed.add(seq // PACK)
        at["waiting"] -= 1
        if apart:
            piece[3] = self.large.getValue((seq,))[0]
            self.large.removeKey((seq,))
        return tuple(piece)

    def _store(self, at: dict) -> None:
        """Put the waiting pieces that a call holds in state."""
        for number in sorted(self.changed):
            if self.packs[number]:
                self.early.updateValue((number,), ([(seq, *piece) for seq, piece in self.packs[number].items()],))
            elif self.stored:
                self.early.removeKey((number,))
        self.stored = self.stored or bool(self.changed)
        self.packs, self.changed, self.held = {}, set(), 0

    def _store_tail(self, at: dict) -> None:
        """Put the bytes of the open file that a call holds in state."""
        if self.tail:
            self.chunks.updateValue((at["chunks"],), (b"".join(self.tail),))
            at["chunks"] += 1
        self.tail, self.tail_bytes = [], 0

    def _take(self, key: tuple, at: dict, piece: tuple) -> list[Row]:
        """What the next piece in order leads to."""
        kind, index, name, data, told = piece
        at["next"] += 1
        if kind == "header" and at["next"] == 1 and index is not None and 1 <= index <= self.limits.files:
            at["files"] = int(index)
        elif kind == "start" and at["files"] and at["open"] < 0 and index == at["received"] < at["files"]:
            at |= {"open": int(index), "name": name or "", "size": 0, "chunks": 0, "too_large": False}
        elif kind == "chunk" and at["open"] >= 0 and index == at["open"]:
            at["size"] += len(data or b"")
            if at["size"] > self.limits.file_bytes and not at["too_large"]:
                at["too_large"] = True
                self._drop_chunks(at)
            if not at["too_large"] and data:
                self.tail.append(data)
                self.tail_bytes += len(data)
                if self.tail_bytes > HELD:
                    self._store_tail(at)
        elif kind == "end" and at["open"] >= 0 and index == at["open"]:
            return self._file(key, at, told)
        else:
            return [self._end(key, at, "INVALID_REQUEST")]
        return []

    def _drop_chunks(self, at: dict) -> None:
        if at["chunks"]:
            self.chunks.clear()
        self.tail, self.tail_bytes, at["chunks"] = [], 0, 0

    def _file(self, key: tuple, at: dict, told: str | None) -> list[Row]:
        content = b"" if at["too_large"] else b"".join([*(self.chunks.getValue((n,))[0] for n in range(at["chunks"])), *self.tail])
        sha = hashlib.sha256(content).hexdigest()
        code = "TOO_LARGE" if at["too_large"] else None if (told or "").lower() == sha else "CHECKSUM_MISMATCH"
        good = code is None
        row = Verdict(key[0], at["open"], at["name"], "ACCEPTED" if good else "REJECTED", code, at["size"], sha if good else None, content if good else None)
        self._drop_chunks(at)
        at["received"] += 1
        at["good"] += good
        at["open"] = -1
        if at["received"] < at["files"]:
            return [row]
        status = "COMPLETED" if at["good"] == at["files"] else "PARTIAL" if at["good"] else "FAILED"
        return [row, self._end(key, at, None, status)]

    def _end(self, key: tuple, at: dict, code: str | None, status: str = "FAILED") -> Row:
        at["done"] = True
        if at["waiting"] or self.stored:
            self.early.clear()
            self.large.clear()
        self.packs, self.changed, self.held, self.stored, at["waiting"] = {}, set(), 0, False, 0
        self._drop_chunks(at)
        return Verdict(key[0], None, None, status, code, at["total"], None, None)


def assembled(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The verdicts on a stream of pieces; an upload is given up when the stream's time has passed its last piece by the wait.

    A piece that comes later than that is dropped.
    """
    pieces.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    late = pieces.withWatermark("at", f"{limits.wait_seconds} seconds").where("upload_id is not null and seq is not null")
    return late.groupBy("upload_id").transformWithState(Assembly(limits), RESULT, "append", "eventTime")


def assemble_files(spark: SparkSession, source: str, target: str, checkpoint: str, limits: Limits = Limits(), files_a_batch: int = 1) -> None:
    """Run the pieces in a folder of Parquet files to their verdicts, as another folder."""
    pieces = spark.readStream.schema(PIECE).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    running = assembled(pieces, limits).writeStream.format("parquet").option("path", target)
    running.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
