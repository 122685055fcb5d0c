"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps a fixed number of open windows. Documents longer than a window fill windows of
their own; what remains of a document goes to the open window that it fills best, and when none has
room, the fullest is emitted and a new one opened. The windows left open at the end of each partition
are merged, a bounded number of partitions at a time, by cutting their pieces to fill windows exactly.
"""

from __future__ import annotations

import bisect
import contextlib
import ctypes
import gc
import re
import struct
import threading
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm.common import pin, table, union_all

WINDOW, OPEN_WINDOWS = 2048, 64
#: Leftovers of so many partitions are merged by one task at a time.
FAN_IN = 32
#: Words of which a worker remembers the ids, at most as many again from before.
CACHED_WORDS = 400_000
#: Bytes of those words and ids, as words may be of any length.
CACHED_BYTES = 16 << 20
#: Texts that a worker turns from Arrow into Python's strings at a time.
TEXTS = 256
#: Seconds without a task after which a worker forgets its words and gives memory back.
REST_S = 5.0
_SEPARATORS = "\x1c\x1d\x1e\x1f"

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Words of ASCII without apostrophes, which start contractions, and of Latin-1 letters; the pieces that the tokenizer's pattern cuts them into.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_PLAIN, _PIECE = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"), re.compile(f"{_LETTERS}|[0-9]|[!-&(-/:-@\\[-`{{-~]+")
#: The characters that stand for the bytes 161 to 255 in the tokenizer's vocabulary are their Latin-1 ones, but for 173; others are moved behind 255.
_MOVED = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


class _Known(dict):
    """Ids of words; a word that is missing is taken from the generation before, or learnt."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.old, self.held = learn, {}, 0

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        got = self[word] = self.learn(word) if got is None else got
        self.held += len(word) + len(got)
        return got

    def turn(self) -> None:
        """What is here becomes the generation before, so that words in use are kept and others go."""
        self.old, self.held = dict(self), 0
        self.clear()


class WordIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, one white-space separated word at a time.

    Exact for a tokenizer that drops white space and never joins across it; ids of a word are computed
    once by the tokenizer itself and remembered. Words of ASCII and Latin-1 letters are cut into letters, digits
    and marks, as the tokenizer's split pattern does, and go to its model piece by piece in lower case, as it
    lower-cases them first, with the characters that stand for their bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Known(self._learn)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:  # added tokens are found before the split
            return self._whole(word)
        pieces = _PIECE.findall(word.lower())
        if pieces[0] != word:
            return b"".join([self.known[p] for p in pieces])
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_MOVED)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if len(self.known) > CACHED_WORDS or self.known.held > CACHED_BYTES:
            self.known.turn()
        if any([c in text for c in _SEPARATORS]):  # str.split() cuts at these and drops them, the tokenizer has ids for them
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, text.split()))


_word_ids: dict[str, WordIds] = {}


def _ids_of(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


_rest: list[threading.Timer] = []


def _give_back() -> None:
    _word_ids.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # of the GNU C library only
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def _working():
    """A task in a worker. Workers are kept for later tasks: words are remembered from one to the next, not while other stages run."""
    while _rest:
        _rest.pop().cancel()
    try:
        yield
    finally:
        _rest.append(threading.Timer(REST_S, _give_back))
        _rest[-1].daemon = True
        _rest[-1].start()


def _texts(batches):
    """(id, text) of the rows, turned into Python's objects a few at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, TEXTS):
            yield from zip(*[batch.column(i).slice(first, TEXTS).to_pylist() for i in (0, 1)], strict=True)
        del batch  # before the next one comes


class OpenWindows:
    """A fixed number of open windows; add() yields the windows it had to emit, as lists of pieces."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.room: list[tuple[int, int]] = []  # (room, number) of the open windows, sorted
        self.pieces: dict[int, list] = {}
        self.made = 0

    def add(self, length: int, piece) -> list:
        at = bisect.bisect_left(self.room, (length, -1))
        out = []
        if at < len(self.room):
            room, number = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                _, full = self.room.pop(0)
                out.append(self.pieces.pop(full))
            room, number = self.window, self.made
            self.made += 1
            self.pieces[number] = []
        self.pieces[number].append(piece)
        if room > length:
            bisect.insort(self.room, (room - length, number))
        else:
            out.append(self.pieces.pop(number))
        return out


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                  ("sequence_id", pa.int64()), ("offset", pa.int64()), ("leftover", pa.int32()), ("ids", pa.binary())])
_OUT_DDL = f"{PIECE}, leftover int, ids binary"


class _Rows:
    """Pieces (doc, start, tokens, ids) of finished windows, as Arrow batches."""

    def __init__(self, base: int):
        self.sequence, self.rows = base, []

    def window(self, pieces: list, leftover: int = -1) -> None:
        """leftover >= 0: the window is still open and carries its ids, to be merged by that partition's group."""
        offset = 0
        for doc, start, tokens, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), tokens, self.sequence, offset, leftover, ids if leftover >= 0 else None))
            offset += n
        self.sequence += 1

    def batches(self, least: int = 1):
        if len(self.rows) >= least:
            rows, self.rows = self.rows, []
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _OUT, strict=True)], schema=_OUT)


def pack(docs: DataFrame, tokenizer: str, eos: int = 1, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its text's ids by the tokenizer file, then `eos`; null and empty texts are
    just that id. Repeated rows and ids are packed as often as they occur; null ids stay null. An empty
    table gives an empty result. sequence_id is unique; offsets in a sequence are gapless from 0. Other
    columns of docs are not read.
    """

    def place(batches):
        with _working():
            yield from placed_rows(batches)

    def placed_rows(batches):
        number = TaskContext.get().partitionId()
        ids_of, windows, rows = _ids_of(tokenizer), OpenWindows(window, open_windows), _Rows(number << 32)
        end, size = np.array([eos], dtype="<u4").tobytes(), window * 4
        for doc, text in _texts(batches):
            ids = (ids_of(text) if text else b"") + end
            tokens, at = len(ids) // 4, 0
            while len(ids) - at >= size:
                rows.window([(doc, at // 4, tokens, ids[at : at + size])])
                at += size
            if at < len(ids):
                for full in windows.add((len(ids) - at) // 4, (doc, at // 4, tokens, ids[at:])):
                    rows.window(full)
            yield from rows.batches(4096)
        for _, left in sorted(windows.room):
            rows.window(windows.pieces[left], number)
        yield from rows.batches()

    def merge(key, got):
        with _working():
            return merged_rows(key, got)

    def merged_rows(key, got):
        """Fill windows exactly with the pieces of a group's open windows, the fullest first; the last stays open."""
        level, group = key[0].as_py(), key[1].as_py()
        got = got.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        cols = [got.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")]
        rows, current, room = _Rows((1 << 62) + (level << 56) + (group << 24)), [], window
        for doc, start, tokens, ids in zip(*cols, strict=True):
            while ids:
                piece, ids = ids[: room * 4], ids[room * 4 :]
                n = len(piece) // 4
                # The end of what this window already holds goes on without a cut.
                if current and current[-1][0] == doc and current[-1][1] + len(current[-1][3]) // 4 == start and current[-1][2] == tokens:
                    current[-1] = (doc, current[-1][1], tokens, current[-1][3] + piece)
                else:
                    current.append((doc, start, tokens, piece))
                start, room = start + n, room - n
                if not room:
                    rows.window(current)
                    current, room = [], window
        if current:
            rows.window(current, group)
        return pa.Table.from_batches(list(rows.batches()), schema=_OUT)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = pin(base.mapInArrow(place, _OUT_DDL), "packed")
    closed, left = [placed.filter("leftover < 0")], placed.filter("leftover >= 0")
    parts, level = (left.agg(F.max("leftover")).first()[0] or 0) + 1, 0
    while True:
        parts = -(-parts // FAN_IN)
        grouped = left.withColumn("leftover", F.floor(F.col("leftover") / FAN_IN)).groupBy(F.lit(level).alias("level"), F.col("leftover").cast("long").alias("g"))
        merged = pin(grouped.applyInArrow(merge, _OUT_DDL), "merged")
        level += 1
        if parts == 1:
            closed.append(merged)
            break
        closed.append(merged.filter("leftover < 0"))
        left = merged.filter("leftover >= 0")
    return union_all(*closed).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op10_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
