"""Pack tokenised documents into sequences of bounded length by hierarchical best fit.

Each task packs the pieces of its own documents by decreasing best fit. Bins that are full but for a few tokens
are final. The others become items, are dealt to fewer tasks and packed again, and so on up a tree, until one task
has held all that was left or a round hardly merges anything.

Token ids come from a byte-level BPE vocabulary in its rank form, which gives the ids of the same vocabulary's
JSON form (a test holds them together) at a third of the cost. The JSON form's added tokens, such as <|endoftext|>,
are found in the text as one token each.

Defined cases: a null or empty text is its end token alone. A text of any length is encoded in stretches cut where
no token can cross. Repeated rows are packed each for itself. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.jobfolder import crc, kept

END_ID = 2
#: Characters that are encoded at once.
STRETCH = 1 << 20
#: Items, and pieces in them, that a task packs at once, in its memory.
TASK_ITEMS = 50_000
TASK_PIECES = 400_000
#: A round that leaves more than this share of its items unmerged is the last.
WORTHWHILE = 0.97

_MEMBER = "struct<doc_id: {id}, piece: int, start: long, length: long, ids_crc32: long, offset: long>"
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    added = added_tokens(f"{path.removesuffix('.tiktoken')}.json")
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens of a vocabulary's JSON form."""
    with open(path, encoding="utf-8") as form:
        added = json.load(form)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError(f"{path} has an added token that takes more than its own text")
    return {t["content"]: t["id"] for t in added}


def stretches(text: str, limit: int = STRETCH) -> Iterator[str]:
    """The text in parts cut before a single space between two words, where every token ends."""
    at = 0
    while len(text) - at > limit:
        found = _SAFE_CUT.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a text and its end."""
    parts = [encoder(path).encode_to_numpy(part, allowed_special="all") for part in stretches(text)] if text else []
    return np.concatenate([*parts, [END_ID]]).astype("<u4")


def cut_pieces(ids: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32); only the first piece may be shorter than ``size``."""
    first = len(ids) % size or size
    for piece, start in enumerate([0, *range(first, len(ids), size)]):
        part = ids[start : first if not piece else start + size]
        yield piece, start, len(part), crc(part.tobytes())


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the fullest bin that still has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free tokens
    open_ = 0  # bit r: some bin has r free tokens
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[k]
        fitting = open_ >> n
        if fitting:
            free = n + ((fitting & -fitting).bit_length() - 1)
            b = room[free].pop()
            if not room[free]:
                open_ &= ~(1 << free)
            bins[b].append(k)
        else:
            free, b = size, len(bins)
            bins.append([k])
        if free > n:
            room[free - n].append(b)
            open_ |= 1 << (free - n)
    return bins


class _Packer:
    """Packs items (their members) of one task and makes the rows of its bins."""

    def __init__(self, size: int, slack: int, turn: int, schema: pa.Schema) -> None:
        self.size, self.slack, self.schema = size, slack, schema
        self.next_id = (turn << 56) + (TaskContext.get().partitionId() << 32)
        self.items: list[list[dict]] = []
        self.pieces = 0

    def add(self, members: list[dict]) -> bool:
        """True if it is time to flush."""
        self.items.append(members)
        self.pieces += len(members)
        return len(self.items) >= TASK_ITEMS or self.pieces >= TASK_PIECES

    def flush(self) -> Iterator[pa.RecordBatch]:
        lengths = [sum(m["length"] for m in item) for item in self.items]
        rows = []
        for together in best_fit(lengths, self.size):
            members, offset = [], 0
            for k in together:
                for m in self.items[k]:
                    members.append(m | {"offset": offset})
                    offset += m["length"]
            rows.append({"bin": self.next_id, "full": offset >= self.size - self.slack, "members": members})
            self.next_id += 1
        self.items, self.pieces = [], 0
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_pylist(rows[at : at + 4096], schema=self.schema)


def _arrow(id_type: pa.DataType) -> pa.Schema:
    member = pa.struct([
        ("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("offset", pa.int64()),
    ])
    return pa.schema([("bin", pa.int64()), ("full", pa.bool_()), ("members", pa.list_(member))])


def pack(docs: DataFrame, size: int = 1024, slack: int = 4, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    size: tokens of a sequence. slack: free tokens up to which a bin counts as full before the last round.
    vocabulary: path of the rank file, with the JSON form next to it, the same on all machines.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bins = f"bin long, full boolean, members array<{_MEMBER.format(id=id_type)}>"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            packer = packer or _Packer(size, slack, 0, _arrow(ids.type))
            for doc_id, text in zip(ids.to_pylist(), batch.column(batch.schema.get_field_index("text")), strict=True):
                for piece, start, length, check in cut_pieces(encode(text.as_py() or "", path), size):
                    member = {"doc_id": doc_id, "piece": piece, "start": start, "length": length, "ids_crc32": check}
                    if packer.add([member]):
                        yield from packer.flush()
        if packer:
            yield from packer.flush()

    def again(turn: int):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = None
            for batch in batches:
                members = batch.column(batch.schema.get_field_index("members"))
                packer = packer or _Packer(size, slack, turn, _arrow(members.type.value_type.field("doc_id").type))
                for item in members.to_pylist():
                    if packer.add(item):
                        yield from packer.flush()
            if packer:
                yield from packer.flush()

        return merge

    turn, table = 0, kept(docs.select("doc_id", "text").mapInArrow(first, bins), "bins")
    done, rest = [table.filter("full")], table.filter("not full")
    waiting, tasks = rest.count(), 0
    while waiting > 1 and tasks != 1:
        turn += 1
        tasks = max(1, -(-waiting // TASK_ITEMS))
        table = kept(rest.repartition(tasks, "bin").mapInArrow(again(turn), bins), "bins")
        done.append(table.filter("full"))
        rest = table.filter("not full")
        total, left = table.agg(F.count("*"), F.sum(F.when(F.col("full"), 0).otherwise(1))).first()
        if total > WORTHWHILE * waiting:
            break
        waiting = left or 0
    packed = rest
    for part in done:
        packed = packed.unionByName(part)
    return packed.select(F.col("bin").alias("sequence_id"), F.inline("members")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
