"""Near-duplicate join on word n-grams: MinHash LSH forest, then exact Jaccard.

1. Every document's set of five-word shingles is hashed to a MinHash signature. Documents
   with the same set form a class and go on as one.
2. A forest of ``TREES`` prefix tries holds the classes: each tree's label is its own ``DEPTH``
   values of the signature, and the classes below one node are sorted by label, so that the
   classes with a common prefix of any length lie side by side. The shortest prefix that
   is used is the longest one with which a pair at the threshold meets in some tree with
   the target recall (``prefix_length``).
3. Matched prefixes are shortened step by step, from whole labels to that shortest prefix.
   Below each prefix a class joins the first leader that its signature shows to be within
   ``NEAR``, and is done: its leader stands for it. A class without such a leader leads itself
   and goes on to the shorter prefix. At the last prefix leaders that could still have
   members at the threshold are tied (triangle inequality of the Jaccard distance for one
   step on either side, with a margin for the signature's error). Large nodes are dealt over parts, and
   their leaders then meet in pairs of bounded blocks. A node gives fewer edges than it
   has classes, never all pairs.
4. Tied classes are candidates of each other. Their shingle sets are fetched once for each
   pair of bounded blocks of a candidate component, all pairs there are verified exactly,
   and only each class's number of links and a spanning forest leave the task.

Words are those of ``shared.words_of``; a text of fewer than five words, but not none, has one
shingle, all its words.

Defined results: texts without words (null, empty) link to nothing and are a group of their own;
equal sets always link; the group's id is its smallest identifier, nulls last; repeated rows
are rows of the same class; an empty table gives no rows; other columns are ignored
(``near_duplicates``) or kept (``keep_one``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.components import components
from twinloom.llm.registry import query, table
from twinloom.llm.shared import Words, mix, pieces, stage, words_of

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6
RECALL = 0.9999
#: Jaccard similarity within which a class joins a leader, and the signature's margin of error.
NEAR = 0.9
MARGIN = 0.13
PART = 2048  # classes of a trie node swept together
BLOCK = 1 << 17  # shingles of a block of a candidate component

_SLOTS = TREES * DEPTH
_random = np.random.default_rng(5)
_MULTIPLY = _random.integers(0, 2**63, _SLOTS).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _random.integers(0, 2**63, _SLOTS).astype(np.uint64)


def prefix_length(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix with which a pair at ``threshold`` is found in some tree with ``recall``."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted; offsets of the rows."""
    counts = np.diff(words.offsets)
    sizes = np.minimum(counts, SHINGLE)
    n = np.where(counts > 0, counts - sizes + 1, 0)
    row = np.repeat(np.arange(words.rows), n)
    first = np.repeat(words.offsets[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = sizes[row]
    hashed = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        inside = k < size
        at = np.where(inside, first + k, 0)
        step = hashed * np.uint64(0x9E3779B97F4A7C15) + (words.hashes[at] if len(words) else 0)
        hashed = np.where(inside, step, hashed)
    hashed = mix(hashed)
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    return hashed[keep], np.searchsorted(row[keep], np.arange(words.rows + 1))


def signatures(hashed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values, one row of ``TREES * DEPTH`` for each row with shingles (others zero).

    Of each least hash the last 16 bits are kept: others agree in them once in 65536 times.
    """
    out = np.zeros((len(offsets) - 1, _SLOTS), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        begin = offsets[:-1][full]
        for k in range(_SLOTS):
            values = ((hashed * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(values, begin) & np.uint32(0xFFFF)
    return out


def _name(sorted_hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_hashes.tobytes(), digest_size=16).digest()


def _signed(docs: DataFrame) -> DataFrame:
    """id, thash -> plus class (null without words), n shingles, signature bytes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            hashed, offsets = shingles(words_of(batch.column("text")))
            sig = signatures(hashed, offsets)
            n = np.diff(offsets)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "thash": batch.column("thash"),
                    "class": pa.array([_name(hashed[a:b]) if b > a else None for a, b in zip(offsets, offsets[1:])], pa.binary()),
                    "n": n.astype(np.int64),
                    "sig": pa.array([s.tobytes() if k else None for s, k in zip(sig, n)], pa.binary()),
                }
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, thash long, class binary, n long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), _SLOTS)


def _tree_keys(classes: DataFrame, depth: int) -> DataFrame:
    """(key, tree, class) for each class and tree; the key is that of the node of the shortest prefix."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column("sig")).reshape(-1, TREES, DEPTH)
            key = np.broadcast_to(np.arange(TREES, dtype=np.uint64), sig.shape[:2]).copy()
            for d in range(depth):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, d].astype(np.uint64))
            names = batch.column("class").take(pa.array(np.repeat(np.arange(batch.num_rows), TREES)))
            tree = np.tile(np.arange(TREES, dtype=np.int8), batch.num_rows)
            yield pa.RecordBatch.from_pydict({"key": key.reshape(-1).view(np.int64), "tree": tree, "class": names})

    return classes.select("class", "sig").mapInArrow(cut, "key long, tree byte, class binary")


class _Ties:
    """Leaders in the order they come, with one edge to each group of tied leaders found before."""

    def __init__(self, threshold: float, room: int):
        # a class may lie one join from its leader, on either side
        self.least = threshold - 2 * (1 - NEAR) - MARGIN
        self.sigs = np.zeros((room, _SLOTS), np.uint16)
        self.group = np.arange(room)
        self.n = 0

    def alike(self, sig: np.ndarray) -> np.ndarray:
        return (self.sigs[: self.n] == sig).mean(1)

    def add(self, sig: np.ndarray, alike: np.ndarray) -> np.ndarray:
        """Takes a leader in; the earlier leaders that it gets an edge to."""
        n, tied = self.n, np.flatnonzero(alike >= self.least)
        groups, first = np.unique(self.group[:n][tied], return_index=True)
        self.group[:n][np.isin(self.group[:n], groups)] = n
        self.sigs[n] = sig
        self.n += 1
        return tied[first]


def descend(labels: np.ndarray, sigs: np.ndarray, depth: int, threshold: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges among the classes below one node, and the leaders that are left.

    ``labels``: sorted rows of ``DEPTH`` values, which share the first ``depth``.
    """
    edges: list[tuple[int, int]] = []
    alive, leads = np.arange(len(labels)), np.zeros(len(labels), bool)
    for d in range(labels.shape[1], depth - 1, -1):
        if len(alive) < 2:
            break
        prefix = labels[alive, :d]
        cuts = np.flatnonzero((prefix[1:] != prefix[:-1]).any(1)) + 1
        left: list[int] = []
        for group in np.split(alive, cuts):
            ties, here = _Ties(threshold, len(group)), []
            for x in group.tolist():
                alike = ties.alike(sigs[x])
                best = int(alike.argmax()) if len(here) else -1
                if best >= 0 and alike[best] >= NEAR and not leads[x]:
                    edges.append((x, here[best]))
                    leads[here[best]] = True
                    continue
                new = ties.add(sigs[x], alike)
                if d == depth:
                    edges += [(x, here[k]) for k in new]
                here.append(x)
            left += here
        alive = np.array(left)
    return edges, alive.tolist()


def _sweep(rows: DataFrame, threshold: float, depth: int) -> DataFrame:
    """(key, part, class, label, sig, parts) -> edges (a, b), and leaders (b null) of nodes in several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, several = None, False
        names, labels, held = [], [], []
        found: dict[str, list] = {c: [] for c in ("key", "a", "b", "sig")}

        def note(a: bytes, b: bytes | None, sig: bytes | None) -> None:
            for column, value in zip(found.values(), (at[0], a, b, sig)):
                column.append(value)

        def close() -> None:
            trie = np.frombuffer(b"".join(labels), np.uint16).reshape(len(labels), DEPTH)
            edges, left = descend(trie, np.frombuffer(b"".join(held), np.uint16).reshape(len(held), _SLOTS), depth, threshold)
            for x, y in edges:
                note(names[x], names[y], None)
            for x in left if several else []:
                note(names[x], None, held[x])

        def flush() -> pa.RecordBatch:
            kinds = {"key": pa.int64()}
            out = pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in found.items()})
            for column in found.values():
                column.clear()
            return out

        for batch in batches:
            for key, part, name, parts, label, sig in zip(*[batch.column(c).to_pylist() for c in ("key", "part", "class", "parts", "label", "sig")]):
                if (key, part) != at:
                    if at is not None:
                        close()
                    at, several = (key, part), parts > 1
                    names, labels, held = [], [], []
                names.append(name)
                labels.append(label)
                held.append(sig)
            yield flush()
        if at is not None:
            close()
            yield flush()

    spread = rows.repartition("key", "part").sortWithinPartitions("key", "part", "label", "class")
    return spread.select("key", "part", "class", "parts", "label", "sig").mapInArrow(run, "key long, a binary, b binary, sig binary")


def _tied(units: DataFrame, threshold: float) -> DataFrame:
    """(key, x, y, class, sig) -> edges (a, b) that tie the leaders of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, held = None, [], []

        def close() -> pa.RecordBatch:
            sigs = np.frombuffer(b"".join(held), np.uint16).reshape(len(held), _SLOTS)
            ties = _Ties(threshold, len(held))
            pairs = [(x, k) for x in range(len(held)) for k in ties.add(sigs[x], ties.alike(sigs[x])).tolist()]
            return pa.RecordBatch.from_pydict({c: pa.array([names[p[k]] for p in pairs], pa.binary()) for k, c in enumerate("ab")})

        for batch in batches:
            for *key, name, sig in zip(*[batch.column(c).to_pylist() for c in ("key", "x", "y", "class", "sig")]):
                if key != at:
                    if at is not None:
                        yield close()
                    at, names, held = key, [], []
                names.append(name)
                held.append(sig)
        if at is not None:
            yield close()

    spread = units.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "class")
    return spread.select("key", "x", "y", "class", "sig").mapInArrow(run, "a binary, b binary")


def candidate_edges(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) whose components hold every pair of classes that the forest finds alike."""
    depth = prefix_length(threshold, recall)
    keys = stage(_tree_keys(classes, depth))
    nodes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    parts = F.ceil(F.col("size") / PART).cast("int")
    shared = keys.join(nodes.select("key", parts.alias("parts")), "key")
    shared = shared.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    label = F.substring(F.col("sig"), F.col("tree").cast("int") * F.lit(2 * DEPTH) + 1, F.lit(2 * DEPTH))
    named = shared.join(classes.select("class", "sig"), "class").withColumn("label", label)
    swept = stage(_sweep(named, threshold, depth))
    leaders = swept.filter(F.col("b").isNull()).select("key", F.col("a").alias("class"), "sig")
    blocks = leaders.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("blocks"))
    placed = leaders.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("class", F.lit("block")), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = placed.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "class", "sig")
    return swept.filter(F.col("b").isNotNull()).select("a", "b").unionByName(_tied(units, threshold))


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of the pairs of sorted sets with Jaccard similarity at least ``threshold``."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = n[column] > 1
    row, column = row[common], column[common]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    start = 0
    while start < len(row):
        # some hundred shared shingles at a time: whole columns of the incidence matrix
        stop = int(np.searchsorted(column, column[start] + 1024))
        _, local = np.unique(column[start:stop], return_inverse=True)
        part = np.zeros((len(sets), local.max() + 1), np.float32)
        part[row[start:stop], local] = 1
        both += part @ part.T
        start = stop
    union = sizes[:, None] + sizes[None, :] - both
    return both / union >= threshold


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """(root, x, y, class, blk, size, set), sorted by unit -> per class: links found, and its tie (null if none).

    A unit compares block x with block y of one candidate component, or x with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        unit: dict[bytes, tuple[int, int, np.ndarray]] = {}

        def result() -> pa.RecordBatch:
            names = list(unit)
            if len(names) < 2:
                return None
            block = np.array([unit[n][0] for n in names])
            size = np.array([unit[n][1] for n in names])
            link = _linked([unit[n][2] for n in names], threshold)
            np.fill_diagonal(link, False)
            if at[1] != at[2]:
                link &= block[:, None] != block[None, :]
            tie: list[bytes | None] = [None] * len(names)
            rest = link.any(1)
            while rest.any():
                root = int(rest.argmax())
                reached = np.zeros(len(names), bool)
                reached[root] = True
                edge = reached.copy()
                while edge.any():
                    edge = link[edge].any(0) & ~reached
                    reached |= edge
                for k in np.flatnonzero(reached):
                    tie[k] = names[root]
                rest &= ~reached
            return pa.RecordBatch.from_pydict(
                {"class": pa.array(names, pa.binary()), "links": (link * size[None, :]).sum(1).astype(np.int64), "tie": pa.array(tie, pa.binary())}
            )

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["root"], row["x"], row["y"])
                if key != at:
                    if at is not None and (out := result()) is not None:
                        yield out
                    at, unit = key, {}
                unit[row["class"]] = (row["blk"], row["size"], np.frombuffer(row["set"], np.uint64))
        if at is not None and (out := result()) is not None:
            yield out

    spread = rows.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "class")
    return spread.select("root", "x", "y", "class", "blk", "size", "set").mapInArrow(run, "class binary, links long, tie binary")


def _sets(texts: DataFrame) -> DataFrame:
    """Adds the shingle set of ``text``; rows whose set is not the class's are dropped."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashed, offsets = shingles(words_of(batch.column("text")))
            sets = [hashed[a:b] for a, b in zip(offsets, offsets[1:])]
            same = pa.array([_name(s) == c for s, c in zip(sets, batch.column("class").to_pylist())])
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            columns["set"] = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_pydict(columns).filter(same)

    schema = "root binary, class binary, blk int, blocks int, size long, set binary"
    return texts.select("root", "class", "blk", "blocks", "size", "text").mapInArrow(build, schema)


def _groups(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, thash, class) and classes (class, root, group_id, links); ``docs`` has id, text."""
    docs = docs.select("id", "text", F.xxhash64("text").alias("thash"))
    rows = stage(_signed(docs))
    classes = stage(
        rows.filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("id").alias("least"),
            F.min(F.struct("thash", "id")).alias("rep"),
            F.first("n").alias("n"),
            F.first("sig").alias("sig"),
        )
    )
    found = stage(components(candidate_edges(classes, threshold, recall)))
    members = classes.select("class", "size", "n", "rep").join(found, F.col("class") == F.col("node")).drop("node")
    totals = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = members.join(totals, "root").withColumn("blk", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    reps = members.select("root", "class", "size", "blk", "blocks", F.col("rep.thash").alias("rhash"), F.col("rep.id").alias("rid"))
    texts = docs.join(reps, (F.col("thash") == F.col("rhash")) & F.col("id").eqNullSafe(F.col("rid")))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = _sets(texts).withColumn("__other", others)
    units = units.withColumns({"x": F.least("blk", "__other"), "y": F.greatest("blk", "__other")})
    checked = stage(_verify(units, threshold))
    links = checked.groupBy("class").agg(F.sum("links").alias("links"))
    final = components(checked.filter(F.col("tie").isNotNull()).select(F.col("class").alias("a"), F.col("tie").alias("b")))
    whole = classes.select("class", "size", "least").join(final, F.col("class") == F.col("node"), "left").drop("node")
    whole = whole.withColumn("root", F.coalesce("root", "class")).join(links, "class", "left")
    whole = stage(whole.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("size") - 1))
    heads = whole.groupBy("root").agg(F.min("least").alias("group_id"))
    return rows.select("id", "thash", "class"), whole.join(heads, "root").select("class", "root", "group_id", "links")


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, class_id (smallest id of its group), n_links.

    ``n_links`` counts the other documents with Jaccard similarity of at least ``threshold``.
    """
    rows, classes = _groups(docs.select(ref(id_col).alias("id"), ref(text_col).alias("text")), threshold, recall)
    out = rows.join(classes, "class", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("group_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id (one of equal rows)."""
    rows, classes = _groups(docs.select(ref(id_col).alias("id"), ref(text_col).alias("text")), threshold, recall)
    held = rows.join(classes, "class", "left")
    alone = held.filter(F.col("class").isNull()).select("id", "thash").distinct().withColumn("many", F.lit(True))
    heads = held.filter(F.col("class").isNotNull() & F.col("id").eqNullSafe(F.col("group_id")))
    # few rows share a group's smallest id
    first = heads.groupBy("root").agg(F.min(F.struct("thash", "id")).alias("h"))
    chosen = first.select(F.col("h.id").alias("id"), F.col("h.thash").alias("thash"), F.lit(False).alias("many"))
    wanted = alone.unionByName(chosen)
    packed = docs.select(F.struct("*").alias("__row"), ref(id_col).alias("__id"), F.xxhash64(ref(text_col)).alias("__thash"))
    joined = packed.join(wanted, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__thash") == F.col("thash")))
    place = F.row_number().over(Window.partitionBy("__id", "__thash").orderBy(F.lit(0)))
    kept = joined.withColumn("__place", place).filter(F.col("many") | (F.col("__place") == 1))
    return kept.select([F.col("__row").getField(c).alias(c) for c in docs.columns])


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
