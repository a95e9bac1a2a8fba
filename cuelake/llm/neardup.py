"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is the weighted set of its word shingles (weight: how often one occurs). Over each shingle lies a random
field of darts, the same for all texts; a dart has a place along the weight, a rank and a coordinate. A text's darts
are those whose place is below the shingle's weight, and per coordinate the dart of least rank is kept: two texts
keep the same one with the probability of their weighted Jaccard similarity. Darts are thrown by increasing rank and
only as far as a text needs for all its coordinates, so a long text costs little more than one look per shingle.

Signatures are cut into bands; texts that share a band meet. Within a meeting not all pairs are made: each text is
compared with the meeting's most connected text first. Where texts of different classes remain in a meeting, each
is compared with some text of the largest class there, in a few rounds. What still remains is packed into blocks of a
few hundred, numbered by counts so that they are the same in any number of partitions; blocks that share a meeting
and aren't of one class are compared as matrices, each pair once, read by path from the shared folder. Only links
that join two classes leave a task. Every comparison computes the exact similarity from the texts.

Words are runs of letters, digits and bytes beyond ASCII, in lower case. Defined cases: a text of fewer words
than a shingle is one shingle; texts without words are alike if their bytes are, null being empty. Texts with equal
words are one class without comparison. A row is a document, also where ids repeat. class_id is the least doc_id of
the class, null ids aside. Other columns are ignored. A very long text is signed whole and may be a block of its own. An
empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import words
from cuelake.llm.components import components
from cuelake.llm.jobfolder import batches_of, column_bytes, kept, lowered, new_folder, numbered, numbered_texts, texts_of, together
from cuelake.llm.tiling import windows

SHINGLE = 5
BANDS, BAND_ROWS = 40, 6
#: Ranks are thrown in stretches of this width, so that a text of few shingles is done in few steps.
STRETCH = 16.0
#: Texts that are signed at once.
TOGETHER = 64
#: Texts and shingles of a block, and columns of its matrix that are multiplied at once.
BLOCK_TEXTS, BLOCK_SHINGLES, COLUMNS = 256, 1 << 19, 4096
#: Rounds that compare texts with a text of the largest class they meet, before blocks do the rest.
CLASS_ROUNDS = 2
#: Texts that a task counts, pairs of blocks that it compares, and the blocks that it holds meanwhile.
COUNTED, TASK_PAIRS, TILE = 500_000, 32, 8
#: Texts that go to Python at once, and members of bands that are counted in one partition.
BATCH_TEXTS, MEMBERS = 1000, 250_000
#: Bits of the table that tells which rows' texts are needed: 8 MB at any size.
ROW_BITS = 26


def shingles(tokens: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text with their weights."""
    if not len(tokens):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(windows(tokens, min(size, len(tokens))), return_counts=True)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the lesser weights over the sum of the greater ones."""
    _, at_x, at_y = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = np.minimum(x[1][at_x], y[1][at_y]).sum()
    total = x[1].sum() + y[1].sum() - both
    return float(both / total) if total else 0.0


def _uniform(value: np.ndarray) -> np.ndarray:
    return ((value >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(
    element: np.ndarray, weight: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, coordinate, rank, dart) of all darts with ranks in [low, high) of each text.

    The weight axis is cut into regions [2^v - 1, 2^(v+1) - 1); a region's darts come at rate 2^v along the rank.
    """
    out = []
    top = int(weight.max(initial=1))
    for v in range(top.bit_length()):
        width = float(1 << v)
        inside = np.flatnonzero(weight > (1 << v) - 1)
        first = (low[owner[inside]] // STRETCH).astype(np.int64)
        last = np.ceil(high[owner[inside]] / STRETCH).astype(np.int64)
        n = np.maximum(last - first, 0)
        cell = np.repeat(inside, n)
        stretch = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        state = words.mix(element[cell] ^ words.mix(stretch.astype(np.uint64) * np.uint64(64) + np.uint64(v + 1)))
        rank = stretch * STRETCH
        end = np.minimum(rank + STRETCH, high[owner[cell]])
        while len(cell):
            state = words.mix(state + np.uint64(0x9E3779B97F4A7C15))
            rank = rank - np.log(_uniform(state)) / width
            on = np.flatnonzero(rank < end)
            cell, state, rank, end = cell[on], state[on], rank[on], end[on]
            if not len(cell):
                break
            side = words.mix(state ^ np.uint64(0xA0761D6478BD642F))
            place = width - 1 + width * _uniform(side)
            hit = np.flatnonzero((place < weight[cell]) & (rank >= low[owner[cell]]))
            coordinate = ((words.mix(side) >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            out.append((owner[cell[hit]], coordinate[hit].astype(np.int64), rank[hit], state[hit]))
    if not out:
        return np.empty(0, int), np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * BAND_ROWS) -> np.ndarray:
    """The k kept darts of each weighted set; a row of zeros for an empty one."""
    n = len(sets)
    element = np.concatenate([s[0] for s in sets])
    weight = np.concatenate([s[1] for s in sets])
    owner = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    total = np.array([s[1].sum() for s in sets], float)
    best = np.full(n * k, np.inf)
    dart = np.zeros(n * k, np.uint64)
    low, high = np.zeros(n), np.zeros(n)
    going = np.flatnonzero(total > 0)
    high[going] = (k * math.log(k) + 2 * k) / total[going]
    while len(going):
        mine = np.isin(owner, going)
        who, coordinate, rank, state = _throw(element[mine], weight[mine], owner[mine], low, high, k)
        flat = who * k + coordinate
        np.minimum.at(best, flat, rank)
        won = best[flat] == rank
        dart[flat[won]] = state[won]
        going = going[np.isinf(best.reshape(n, k)[going]).any(axis=1)]  # a coordinate without a dart: throw on
        low[going], high[going] = high[going], 2 * high[going]
    return dart.reshape(n, k)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band and text; the band is part of the key."""
    parts = signature.reshape(len(signature), bands, rows)
    salt = words.mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows)
    return words.mix((words.mix(parts ^ salt) * (salt | np.uint64(1))).sum(axis=2, dtype=np.uint64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(batch.schema.get_field_index("row"))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        texts = column_bytes(batch, "text")
        for first, group in words.by_text(texts, words.PLAIN):
            sets = [shingles(tokens) for tokens in group]
            few = [sets[k : k + TOGETHER] for k in range(0, len(sets), TOGETHER)]
            keys = np.concatenate([band_keys(signatures(some)) for some in few]).view(np.int64)
            content = [
                xxhash.xxh3_128_digest(b"w" + tokens.tobytes() if len(tokens) else b"t" + texts[first + k])
                for k, tokens in enumerate(group)
            ]
            halves = np.frombuffer(b"".join(content), "<i8").reshape(-1, 2)
            bands = [row if len(s[0]) else [] for row, s in zip(keys, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([
                rows.slice(first, len(group)), ids.slice(first, len(group)), pa.array(halves[:, 0]),
                pa.array(halves[:, 1]), pa.array(bands, pa.list_(pa.int64())),
                pa.array([int(s[1].sum()) for s in sets], pa.int64()),
            ], ["row", "doc_id", "hi", "lo", "bands", "size"])


def _row_bits(row: np.ndarray) -> np.ndarray:
    return words.mix(row.astype(np.uint64)) >> np.uint64(64 - ROW_BITS)


def _needed(shared):
    """Rows whose bit is set: all that are needed, and a few more."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: np.ndarray = shared.value
        for batch in batches:
            bit = _row_bits(batch.column(batch.schema.get_field_index("row")).to_numpy())
            on = (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
            if on.any():
                yield batch.filter(pa.array(on.astype(bool)))

    return pick


def _row_table(rows: DataFrame) -> np.ndarray:
    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(_row_bits(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([
                pa.array((bit >> np.uint64(3)).astype(np.int32)),
                pa.array((1 << (bit & np.uint64(7)).astype(np.int32)).astype(np.int32)),
            ], ["byte", "bit"])

    found = rows.mapInArrow(set_bits, "byte int, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    found = together(found, 1 << (ROW_BITS - 3), 1 << 20).toArrow()
    table = np.zeros(1 << (ROW_BITS - 3), np.uint8)
    table[found["byte"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return table


def _compare(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            text_a, text_b = batch.column(2), batch.column(3)
            keep = []
            for k in range(len(a)):
                if a[k] != last:  # pairs come sorted by their first text
                    last, hub = a[k], _set_of(text_a[k].as_py())
                if similarity(hub, _set_of(text_b[k].as_py())) >= least:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return compare


def _set_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    group = [g for _, part in words.by_text([text], words.PLAIN) for g in part]
    return shingles(np.concatenate(group))


def linked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of row numbers whose texts are at least ``least`` alike."""
    needed = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row")))
    shared = pairs.sparkSession.sparkContext.broadcast(_row_table(needed))
    some = texts.select("row", "text").mapInArrow(_needed(shared), "row long, text binary")
    met = pairs.join(some.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    met = met.join(some.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    return met.select("a", "b", "text_a", "text_b").mapInArrow(_compare(least), "a long, b long")


def _meetings(members: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(key, node) of the bands where texts meet, and (key, hub).

    hub is the text that meets most others over all its bands. n: how many members there are at most.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = kept(together(sizes, n, MEMBERS), "band-sizes")
    met = kept(together(members.join(sizes, "key"), n, MEMBERS), "band-members")
    n = met.count()
    known = kept(together(met.groupBy("node").agg(F.sum("size").alias("known")), n), "band-known")
    ranked = met.join(known, "node")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("known", (-F.col("node")).alias("order"))).alias("top"))
    hubs = hubs.select("key", (-F.col("top.order")).alias("hub"))
    return met.select("key", "node"), kept(together(hubs, n), "band-hubs")


def _unary(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Weighted sets as plain ones: a shingle of weight 3 is three elements, so that common parts can be counted."""
    out = []
    for element, weight in sets:
        turn = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
        spread = np.repeat(element, weight)
        out.append(np.where(turn > 0, words.mix(spread + turn.astype(np.uint64)), spread))
    return out


def _running(block_texts: int):
    """(part, node, upto): how many blocks the texts before this one of the same task fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, upto = TaskContext.get().partitionId(), 0.0
        for batch in batches:
            fill = np.maximum(1 / block_texts, batch.column(2).to_numpy() / BLOCK_SHINGLES)
            after = upto + np.cumsum(fill)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(fill), part)), batch.column(0), batch.column(1), pa.array(after - fill), pa.array(after),
            ], ["part", "node", "label", "upto", "after"])
            upto = float(after[-1]) if len(after) else upto

    return run


def _blocks(folder: str):
    """Texts that come sorted by block, one file a block: (block, path, least and greatest label)."""

    def out(block: int, held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{block}-{uuid.uuid4().hex}"  # a task that runs again leaves a file that nobody lists
        nodes, labels = [x[0] for x in held], [x[1] for x in held]
        whole = pa.RecordBatch.from_arrays([
            pa.array([nodes], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int64())),
            pa.array([[len(x[2]) for x in held]], pa.list_(pa.int64())), pa.array([np.concatenate([x[2] for x in held]).tobytes()]),
        ], ["nodes", "labels", "sizes", "elements"])
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink, pa.ipc.new_stream(sink, whole.schema) as file:
            file.write_batch(whole)
        return pa.RecordBatch.from_arrays([
            pa.array([block]), pa.array([f"{folder}/{name}"]), pa.array([min(labels)]), pa.array([max(labels)]),
        ], ["block", "path", "least", "greatest"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            numbers, nodes, labels = (batch.column(k).to_pylist() for k in range(3))
            for number, node, label, text in zip(numbers, nodes, labels, column_bytes(batch, "text"), strict=True):
                if held and number != block:
                    yield out(block, held)
                    held = []
                block = number
                held.append((node, label, _unary([_set_of(text)])[0]))
        if held:
            yield out(block, held)

    return pack


def _read_block(path: str) -> tuple[list[int], np.ndarray, list[np.ndarray], np.ndarray]:
    store, place = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(place, compression=None) as source, pa.ipc.open_stream(source) as file:
        row = file.read_next_batch().to_pylist()[0]
    sizes = np.array(row["sizes"], np.int64)
    elements = np.frombuffer(row["elements"], np.uint64)
    return row["nodes"], np.array(row["labels"]), np.split(elements, np.cumsum(sizes)[:-1]), sizes


def common_parts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b``.

    Elements that few sets hold are counted pair by pair, those that many hold by a matrix product.
    """
    out = np.zeros((len(a), len(b)))
    x, y = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(x, y)
    if not len(shared):
        return out
    owners = []
    for every, sets in ((x, a), (y, b)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, every)
        at[at == len(shared)] = 0
        inside = np.flatnonzero(shared[at] == every)
        order = inside[np.argsort(at[inside], kind="stable")]
        owners.append((at[order], owner[order]))
    (of_x, own_x), (of_y, own_y) = owners
    in_x, in_y = np.bincount(of_x, minlength=len(shared)), np.bincount(of_y, minlength=len(shared))
    first_x, first_y = np.cumsum(in_x) - in_x, np.cumsum(in_y) - in_y
    many = in_x * in_y >= 512
    few = np.flatnonzero(~many)
    for part in np.array_split(few, max(1, int((in_x[few] * in_y[few]).sum()) >> 21)):
        n = in_x[part] * in_y[part]
        turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(in_y[part], n)
        i = own_x[np.repeat(first_x[part], n) + turn // wide]
        j = own_y[np.repeat(first_y[part], n) + turn % wide]
        out += np.bincount(i * len(b) + j, minlength=out.size).reshape(out.shape)
    column = np.cumsum(many) - 1
    for at in range(0, int(many.sum()), COLUMNS):
        sides = []
        for of, own, rows in ((of_x, own_x, len(a)), (of_y, own_y, len(b))):
            on = many[of] & (column[of] >= at) & (column[of] < at + COLUMNS)
            side = np.zeros((rows, COLUMNS), np.float32)
            side[own[on], column[of[on]] - at] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _join_blocks(least: float):
    """Links between texts of different classes of two blocks, as many as are needed to join the classes.

    Pairs (path, path of the other) come sorted so that neighbouring ones share blocks.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        held: dict[str, tuple] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        def block(path: str) -> tuple:
            held[path] = held.pop(path, None) or _read_block(path)
            while len(held) > 2 * TILE:
                del held[next(iter(held))]
            return held[path]

        for batch in batches:
            found = []
            for here, there in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (nodes_a, labels_a, sets_a, sizes_a), (nodes_b, labels_b, sets_b, sizes_b) = block(here), block(there)
                tops = {int(x): top(int(x)) for x in np.union1d(labels_a, labels_b)}
                if len(set(tops.values())) == 1:
                    continue  # all of one class by now
                class_a, class_b = (np.array([tops[int(x)] for x in labels]) for labels in (labels_a, labels_b))
                # equal classes need no look: without those texts of a side whose class is the only one across
                on_a = np.arange(len(class_a)) if len(set(class_b)) > 1 else np.flatnonzero(class_a != class_b[0])
                on_b = np.arange(len(class_b)) if len(set(class_a)) > 1 else np.flatnonzero(class_b != class_a[0])
                both = common_parts([sets_a[i] for i in on_a], [sets_b[j] for j in on_b])
                alike = both >= least * (sizes_a[on_a, None] + sizes_b[None, on_b] - both) - 1e-9
                for i, j in zip(*np.nonzero(alike & (class_a[on_a, None] != class_b[None, on_b])), strict=True):
                    x, y = top(int(class_a[on_a[i]])), top(int(class_b[on_b[j]]))
                    if x != y:
                        parent[x] = y
                        found.append((nodes_a[on_a[i]], nodes_b[on_b[j]]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return join


def _mixed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label) of the meetings where texts of different classes meet."""
    n = met.count()
    placed = met.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    placed = kept(together(placed, n), "band-classes")
    mixed = placed.groupBy("key").agg((F.min("label") < F.max("label")).alias("mixed")).filter("mixed").select("key")
    return kept(together(placed.join(mixed, "key", "left_semi"), n), "mixed-bands")


def _with_largest(left: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each text outside the largest class of a meeting with one of that class, for two meetings a text."""
    of_class = left.groupBy("key", "label").agg(
        F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("a")
    )
    largest = of_class.groupBy("key").agg(F.max(F.struct("n", "label", "a")).alias("top"))
    pairs = left.join(largest, "key").filter(F.col("label") != F.col("top.label")).select(
        F.col("top.a").alias("a"), F.col("node").alias("b")
    )
    chosen = [F.min_by("a", F.xxhash64("a", "b", F.lit(2 * turn + k))) for k in range(2)]
    return pairs.groupBy("b").agg(F.array(*chosen).alias("a")).select(F.explode(F.array_distinct("a")).alias("a"), "b")


def _numbered_blocks(nodes: DataFrame, count: int, block_texts: int) -> DataFrame:
    """(block, node, label): texts in order, a block for every ``block_texts`` or BLOCK_SHINGLES of them."""
    order = ["company", "label", "home", "node"]
    dealt = nodes.select("node", "label", "size", "company", "home").repartitionByRange(-(-count // COUNTED), *order)
    counted = kept(
        dealt.sortWithinPartitions(*order).mapInArrow(
            _running(block_texts), "part long, node long, label long, upto double, after double"
        ),
        "text-order",
    )
    # one number for each half a million texts
    ends = sorted(tuple(r) for r in counted.groupBy("part").agg(F.max("after")).collect())
    starts = list(zip((part for part, _ in ends), np.cumsum([0.0, *(fill for _, fill in ends[:-1])]).tolist(), strict=True))
    start = nodes.sparkSession.createDataFrame(starts, "part long, start double")
    return counted.join(F.broadcast(start), "part").select(
        F.floor(F.col("start") + F.col("upto") + 1e-6).alias("block"), "node", "label"
    )


def _across_classes(left: DataFrame, pairs: DataFrame, sizes: DataFrame, texts: DataFrame, least: float, block_texts: int) -> DataFrame:
    """Links (a, b) that join classes whose texts share a band.

    left: (key, node, label) of the meetings of different classes. pairs: each node with its hubs. sizes: (node, size).
    """
    spark = left.sparkSession
    # who meets whom, however indirectly: texts of such a company become neighbours, so that few blocks share a band
    company = components(pairs.join(left.select("key").distinct(), "key", "left_semi")).withColumnRenamed("label", "company")
    nodes = left.groupBy("node").agg(F.max("label").alias("label"), F.min("key").alias("home")).join(sizes, "node")
    nodes = nodes.join(company, "node", "left").withColumn("company", F.coalesce("company", "node"))
    nodes = kept(together(nodes, left.count()), "mixed-texts")
    count = nodes.count()
    if not count:
        return spark.createDataFrame([], "a long, b long")
    shared = spark.sparkContext.broadcast(_row_table(nodes.select("node")))
    some = texts.select("row", "text").mapInArrow(_needed(shared), "row long, text binary")
    place = kept(_numbered_blocks(nodes, count, block_texts), "block-of-text")
    dealt = place.join(some.withColumnRenamed("row", "node"), "node").repartition(-(-count // (4 * block_texts)), "block")
    written = dealt.select("block", "node", "label", "text").sortWithinPartitions("block", "node").mapInArrow(
        _blocks(new_folder(spark, "text-blocks")), "block long, path string, least long, greatest long"
    )
    with batches_of(spark, BATCH_TEXTS):
        blocks = kept(written, "block-paths")
    n = left.count()
    meets = left.join(place.select("node", "block"), "node").select("key", "block").distinct()
    meets = kept(together(meets, n), "block-bands")
    # bands with the same blocks are one: a pair of blocks is made once for all of them
    hashes = [F.bit_xor(F.xxhash64("block", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    lists = meets.groupBy("key").agg(F.count("*").alias("n"), *hashes).filter("n > 1")
    keys = lists.groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    keys = kept(together(keys, n), "block-lists")
    one = kept(together(meets.join(keys, "key", "left_semi").join(blocks, "block"), n), "block-meetings")
    other = one.select("key", *[F.col(c).alias(f"{c}_2") for c in blocks.columns])
    met = (F.col("block") < F.col("block_2")) & (F.least("least", "least_2") < F.greatest("greatest", "greatest_2"))
    both = one.join(other, "key").filter(met).select("block", "block_2", "path", "path_2").distinct()
    alone = blocks.filter("least < greatest").select("block", F.col("block").alias("block_2"), "path", F.col("path").alias("path_2"))
    both = kept(both.unionByName(alone), "block-pairs")
    tile = [F.floor(F.col("block") / TILE), F.floor(F.col("block_2") / TILE)]
    both = both.repartition(max(1, -(-both.count() // TASK_PAIRS)), *tile).sortWithinPartitions(*tile, "block", "block_2")
    return both.select("path", "path_2").mapInArrow(_join_blocks(least), "a long, b long")


def classes(docs: DataFrame, least: float = 0.8, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """(row, doc_id, class_id, first) of every row: first marks the row that stands for its class.

    least: similarity of a link. block_texts: texts that a task compares at once.
    """
    return _classes(numbered_texts(docs, lowered("text")), least, block_texts)


def _classes(texts: DataFrame, least: float, block_texts: int) -> DataFrame:
    id_type = texts.schema["doc_id"].dataType.simpleString()
    signatures = texts.mapInArrow(_sign, f"row long, doc_id {id_type}, hi long, lo long, bands array<long>, size long")
    with batches_of(texts.sparkSession, BATCH_TEXTS):
        signed = kept(signatures, "signatures")
    # texts with equal words are one node, named by its least row
    nodes = signed.groupBy("hi", "lo").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"),
        F.first("size").alias("size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("lead"),
    )
    nodes = kept(together(nodes, signed.count(), MEMBERS // BANDS), "texts")
    n = nodes.count()
    met, hubs = _meetings(nodes.select("node", F.explode("bands").alias("key")), n * BANDS)
    by_hub = met.join(hubs, "key").filter(F.col("node") != F.col("hub")).select("key", F.col("hub").alias("a"), F.col("node").alias("b"))
    by_hub = kept(together(by_hub, met.count()), "near-pairs")
    with batches_of(texts.sparkSession, BATCH_TEXTS):
        links = kept(linked(by_hub.select("a", "b").distinct(), texts, least), "near-links")
    labels = components(links)
    left = _mixed(met, labels)
    for turn in range(CLASS_ROUNDS):
        if left.isEmpty():
            break
        pairs = kept(together(_with_largest(left, turn), left.count()), "class-pairs")
        with batches_of(texts.sparkSession, BATCH_TEXTS):
            found = kept(linked(pairs, texts, least), "near-links")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        labels = components(links)
        left = _mixed(left.select("key", "node"), labels)
    if not left.isEmpty():
        across = _across_classes(left, by_hub, nodes.select("node", "size"), texts, least, block_texts)
        labels = components(links.unionByName(kept(across, "near-links")))
    named = nodes.select("hi", "lo", "node", "least_id", "lead").join(labels, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    heads = named.groupBy("label").agg(F.min("least_id").alias("class_id"), F.min("lead").alias("lead"))
    heads = kept(together(heads, n), "classes")
    of_text = named.select("hi", "lo", "label").join(heads, "label").select("hi", "lo", "class_id", "lead")
    of_text = kept(together(of_text, n), "class-of-text")
    return signed.select("row", "doc_id", "hi", "lo").join(of_text, ["hi", "lo"]).select(
        "row", "doc_id", "class_id", (F.col("row") == F.col("lead.row")).alias("first")
    )


def one_of_each(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their class (least id, then first row), with all their columns."""
    rows = numbered(docs)
    found = _classes(texts_of(rows, lowered("doc.text")), least, BLOCK_TEXTS)
    stay = kept(found.filter("first").select("row"), "class-rows")
    return rows.join(stay, "row", "left_semi").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
