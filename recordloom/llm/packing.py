"""Packing documents into training sequences of a fixed number of tokens, by bounded-space online best fit.

Each partition of the input keeps a fixed number of open windows. A document's tokens, after as many whole windows as
they fill, go into the open window with the least room that holds them. If none does and all windows are open, the
fullest is topped up with the head of the document and emitted, so no emitted window has padding; the rest of the
document is placed anew. What is still open at the end of a partition, never more than `open_windows` windows, is
merged: groups of FAN partitions put their leftovers into windows by the same rule, then groups of FAN groups, until
one is left. Of its windows all but the last are filled, and the last is cut at powers of two, so it has no padding.

State is bounded by open_windows windows a task, and by FAN times that for a group of the merge, whatever the input.
Every round is written to the shared folder: numbers of sequences hold when executors are lost. Open windows come last
in a file, so its other row groups, which are small, are passed over when the next round looks for them.

Every row is a document of its own, repeated rows too. Null and empty texts have the end token alone. A null doc_id is
kept. Other columns are ignored, and an empty table gives an empty one. One document's text and tokens must fit into a task.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import Scratch, positioned, python_ready

WINDOW, OPEN_WINDOWS, END = 2048, 32, 1
#: Partitions, or groups, whose leftovers one task merges.
FAN = 16
#: Bytes of a token id; ids are unsigned and little-endian.
WIDTH = 4
#: Pieces in a generation of those that a Python worker remembers, and the longest of them.
REMEMBERED, PIECE_CHARS = 150_000, 64
#: Characters that are their own normal form and have one lower case: ASCII, and the letters of Latin-1.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: Fixed value: the split pattern of the tokenizers that texts are cut for; they drop what it does not match.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: That pattern on plain characters in lower case. "<|" may begin one of its added tokens.
PIECE = re.compile(r"[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Bytes of texts in an Arrow batch, of ids in one, and of a row group as stored.
_BATCH_BYTES, _ROW_GROUP = 4 << 20, 4 << 20

_words: dict[int, "Words"] = {}


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _splits_at_space(config: dict) -> bool:
    """Whether a tokenizer is of the kind that PIECE is for. All others get whole texts."""
    normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (config.get("normalizer") or {}).get("normalizers", [])]
    split = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    dropping = (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
    return dropping and normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]


class Words(dict):
    """The ids of each piece of a text, as bytes. Such a tokenizer drops white space and gives every match of its split
    pattern its own ids, whatever stands beside it, so a text's ids are those of its pieces, one after the other. In
    texts of plain characters the pieces are matches of PIECE in lower case, by which words that differ in case or in
    their punctuation share their letters; other texts are cut at blanks, tabs and line ends only, and the tokenizer
    does the rest. Pieces are remembered in two generations of REMEMBERED, the older of which goes when the newer is full."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.model, self.by_piece = self.tokenizer.model, _splits_at_space(json.loads(tokenizer))
        #: the letters of Latin-1 as the tokenizer's split hands them to its model
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(128, 256)) if c.isalpha() and c.islower()} if self.by_piece else {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if piece.isalpha() and piece.islower() and (piece.isascii() or max(piece) <= "ÿ"):
                # one match, its own normal form in lower case; only its bytes are left to map
                ids = _bytes([t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))])
            elif piece.isascii() and piece.isprintable() and piece == piece.lower() and PIECE.fullmatch(piece):
                # nothing is left to normalise, to split or to map to bytes
                ids = _bytes([t.id for t in self.model.tokenize(piece)])
            else:
                ids = _bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= PIECE_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
                self[""] = b""
            self[piece] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if not self.by_piece:
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, PIECE.findall(text.lower())))
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def _words_of(tokenizer: str) -> Words:
    key = hash(tokenizer)
    if key not in _words:
        _words[key] = Words(tokenizer)
    return _words[key]


class Windows:
    """Open windows of one task. A piece is (doc_id, start, ids, doc_tokens); `emitted` takes lists of pieces."""

    def __init__(self, size: int, most: int, emitted):
        self.size, self.most, self.emitted = size * WIDTH, most, emitted
        self.room: list[int] = []
        self.held: list[list[tuple]] = []

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        at, end = 0, len(ids)
        while end - at >= self.size:
            self.emitted([(doc, start + at // WIDTH, ids[at : at + self.size], total)])
            at += self.size
        while at < end:
            need = end - at
            fits = [(r, k) for k, r in enumerate(self.room) if r >= need]
            if fits:
                _, k = min(fits)
            elif len(self.room) < self.most:
                k = len(self.room)
                self.room.append(self.size)
                self.held.append([])
            else:
                k = min(range(len(self.room)), key=self.room.__getitem__)
                need = self.room[k]
            self.held[k].append((doc, start + at // WIDTH, ids[at : at + need], total))
            self.room[k] -= need
            at += need
            if not self.room[k]:
                self.emitted(self.held[k])
                del self.room[k], self.held[k]

    def finish(self) -> None:
        """Emits what is open as full windows and, last, windows of powers of two."""
        pieces = [p for k in sorted(range(len(self.room)), key=self.room.__getitem__) for p in self.held[k]]
        left = sum(len(p[2]) for p in pieces)
        self.room, self.held = [], []
        sizes = [self.size] * (left // self.size)
        rest = left % self.size // WIDTH
        sizes += [(1 << b) * WIDTH for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        for size in sizes:
            window = []
            while size:
                doc, start, ids, total = pieces.pop(0)
                window.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    pieces.insert(0, (doc, start + size // WIDTH, ids[size:], total))
                size -= len(window[-1][2])
            self.emitted(window)


def _schema(doc_id: T.DataType) -> T.StructType:
    return T.StructType().add("doc_id", doc_id).add("start", "long").add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long").add("part", "long").add("open", "long")


class _Rows:
    """Rows of emitted and of open windows as Arrow batches. Sequences are numbered by round, part and order."""

    def __init__(self, schema: pa.Schema, turn: int, part: int):
        self.schema, self.part, self.next = schema, part, (turn << 56) + (part << 32)
        self.rows: list[tuple] = []
        self.bytes = 0

    def put(self, window: list[tuple], is_open: int = 0) -> None:
        offset = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, ids, total, self.next, offset, self.part, is_open))
            offset += len(ids) // WIDTH
            self.bytes += len(ids)
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(self.schema)
        found = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return found


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids (binary, 4 bytes each), doc_tokens, sequence_id, offset of every piece. tokenizer is the
    path of a file of the tokenizers library, which the driver reads (a few MB) and sends to the executors once."""
    spark = docs.sparkSession
    python_ready(spark, _BATCH_BYTES)
    docs, (doc_id, text) = positioned(docs, doc_id, text)
    with open(tokenizer, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(WIDTH, "little")
    schema = _schema(docs.schema[doc_id].dataType)
    scratch = Scratch(spark, "packing")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = _words_of(sent.value), _Rows(_arrow(schema), 0, TaskContext.get().partitionId())
        windows = Windows(window, open_windows, rows.put)
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(body.as_py()) + end
                windows.add(doc, 0, ids, len(ids) // WIDTH)
                if rows.bytes >= _BATCH_BYTES:
                    yield rows.batch()
        for held in windows.held:
            rows.put(held, 1)
        yield rows.batch()

    def merged(turn: int, last: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            part = key[0].as_py()
            rows = _Rows(_arrow(schema), turn, part)
            windows = Windows(window, open_windows, rows.put)
            pieces = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            for p in pieces.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
                windows.add(p["doc_id"], p["start"], p["ids"], p["doc_tokens"])
            if last:
                windows.finish()
            for held in windows.held:
                rows.put(held, 1)
            return pa.Table.from_batches([rows.batch()])

        return run

    found = scratch.table(docs.select(doc_id, text).mapInArrow(packed, schema), "round-0", _ROW_GROUP)
    rounds, turn = [found.filter("open = 0")], 0
    while (most := found.filter("open = 1").agg(F.max("part")).first()[0]) is not None:
        turn += 1
        grouped = found.filter("open = 1").groupBy(F.expr(f"part div {FAN}").alias("at"))
        found = scratch.table(grouped.applyInArrow(merged(turn, most < FAN), schema), f"round-{turn}", _ROW_GROUP)
        rounds.append(found.filter("open = 0"))
    result = rounds[0]
    for more in rounds[1:]:
        result = result.unionByName(more)
    length = F.expr(f"octet_length(ids) div {WIDTH}").cast("long")
    return result.select("doc_id", "start", length.alias("length"), "ids", "doc_tokens", "sequence_id", "offset")
