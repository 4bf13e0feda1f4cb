"""Exact duplicates by owners in Patricia tries.

Texts are equal when they are identical after each stretch of ASCII white space
has become one space.  A text's partition is given by its length and content hash,
so equal texts meet.  A task inserts whole byte strings into a compressed radix
trie: every edge holds a string, and the node where a text ends holds its owner, the
smallest identifier, and how many rows have the text.  So equality is decided by bytes,
never by a hash.

The same trie runs first in each task that reads documents: of equal texts there
one goes on, with its count and smallest identifier, under a number that its rows
keep.  So a text that a third of all rows share reaches its partition once a task,
and only narrow rows (number, identifier) are joined with the owners at the end.

A trie that outgrows ``memory`` spills by subtree: the largest subtrees leave the task
as rows of the staged table, whatever comes to them later follows, and these rows
are the next round's texts, spread anew by length and hash over as many partitions
as their bytes ask for.  Nothing is written to an executor's own disk, and a task that
is lost is run again from staged files.

Defined results: null counts as empty; of equal texts the row with the smallest id
stays (null ids last, of rows with one id the first in file order), so exactly one row
of a group is kept, and ``keep_id`` is null only if all its ids are; repeated rows are
rows of the group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.common import ROW_BITS, TEXTS_AT_ONCE, give_back, named, staged, table

MEMORY = 48 << 20  # bytes of a task's trie
NODE_BYTES = 350  # a node with its dictionary and owner, beside the label
BATCH_BYTES = 8 << 20
WHITE = frozenset(b"\t\n\x0b\x0c\r ")


def normalised(text: bytes) -> bytes:
    """``text`` with one space for each stretch of white space."""
    words = text.split()  # bytes split at ASCII white space
    if not words:
        return b" " if text else b""
    out = b" ".join(words)
    return (b" " if text[0] in WHITE else b"") + out + (b" " if text[-1] in WHITE else b"")


class Node:
    __slots__ = ("label", "children", "owner", "spilled", "size")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.children: dict[int, Node] | None = None
        self.owner: Owner | None = None
        self.spilled = False
        self.size = 0  # of the subtree, when it was last measured


class Owner:
    """What a terminal node holds: the smallest (id is null, id, row), the rows' count, and
    the numbers under which tasks have seen the text."""

    __slots__ = ("least", "n", "reps")

    def __init__(self) -> None:
        self.least: tuple | None = None
        self.n = 0
        self.reps: list[int] = []

    def add(self, least: tuple, n: int, reps: list[int]) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n += n
        self.reps += reps


def shared(label: bytes, key: bytes, at: int) -> int:
    """How many leading bytes of ``label`` stand in ``key`` at ``at``; fewer than all."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie over byte strings."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.bytes = self.owners = 0

    def owner(self, key: bytes) -> Owner | None:
        """The key's owner, new if there is none yet; None in a spilled subtree."""
        node, at = self.root, 0
        while not node.spilled:
            if at == len(key):
                if node.owner is None:
                    node.owner = Owner()
                    self.owners += 1
                return node.owner
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(child.label) + NODE_BYTES
            elif not key.startswith(child.label, at):
                cut = shared(child.label, key, at)
                above = Node(child.label[:cut])
                above.children = {child.label[cut]: child}
                child.label = child.label[cut:]
                node.children[key[at]] = child = above
                self.bytes += NODE_BYTES
            node, at = child, at + len(child.label)
        return None

    def entries(self, node: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, Owner]]:
        """(key, owner) of the subtree's terminal nodes; ``before`` leads to the node's label."""
        waiting = [(node or self.root, before)]
        while waiting:
            node, before = waiting.pop()
            key = before + node.label
            if node.owner is not None:
                yield key, node.owner
            waiting.extend((child, key) for child in (node.children or {}).values())

    def measure(self) -> None:
        order = [self.root]
        for node in order:
            order.extend((node.children or {}).values())
        for node in reversed(order):
            reps = 8 * len(node.owner.reps) if node.owner else 0
            node.size = len(node.label) + NODE_BYTES + reps + sum(c.size for c in (node.children or {}).values())
        self.bytes = self.root.size

    def spill(self) -> Iterator[tuple[bytes, Owner]]:
        """Give up the largest subtrees, a quarter of the bytes at least, but never the last owner."""
        self.measure()
        total, node, before = self.bytes, self.root, b""
        while True:
            held = sorted((c for c in (node.children or {}).values() if not c.spilled), key=lambda c: -c.size)
            if not held or not held[0].children or 2 * held[0].size <= total:
                break
            before += node.label
            node = held[0]
        before += node.label
        for child in held:
            entries = list(self.entries(child, before))
            if len(entries) == self.owners or 4 * (total - self.bytes) >= total:
                break
            yield from entries
            self.owners -= len(entries)
            self.bytes -= child.size - NODE_BYTES
            # Whatever begins as these texts did now goes the same way.
            child.label, child.children, child.owner, child.spilled = child.label[:1], None, None, True


def row_schema(id_type: T.DataType) -> T.StructType:
    """Rows of the staged tables: a document (row, id, rep), a text (text, length, hash, reps,
    low_id, low_row, n) or an owner (rep, low_id, low_row, n, digest)."""
    long, binary = T.LongType(), T.BinaryType()
    fields = {
        "row": long, "id": id_type, "rep": long, "text": binary, "length": long, "hash": long,
        "reps": T.ArrayType(long), "low_id": id_type, "low_row": long, "n": long, "digest": binary,
    }
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def filled(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    """A batch of the given columns; the others are null."""
    size = len(next(iter(columns.values())))
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def text_rows(schema: pa.Schema, entries: Iterator[tuple[bytes, Owner]]) -> Iterator[pa.RecordBatch]:
    keys: list[bytes] = []
    owners: list[Owner] = []
    size = 0

    def rows() -> pa.RecordBatch:
        return filled(
            schema, text=keys, length=[len(k) for k in keys],
            hash=[xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys], reps=[o.reps for o in owners],
            low_id=[o.least[1] for o in owners], low_row=[o.least[2] for o in owners], n=[o.n for o in owners],
        )

    for key, owner in entries:
        keys.append(key)
        owners.append(owner)
        size += len(key) + 8 * len(owner.reps)
        if size >= BATCH_BYTES:
            yield rows()
            keys, owners, size = [], [], 0
    if keys:
        yield rows()


def least_of(id_: object, row: int) -> tuple:
    return (id_ is None, 0, row) if id_ is None else (False, id_, row)


def in_task(batches: Iterator[pa.RecordBatch], schema: pa.Schema, memory: int) -> Iterator[pa.RecordBatch]:
    """Documents (id, text) to rows of documents and of texts, one for each text of the task.

    A trie that outgrows the memory is handed on whole, and a new one begins.
    """
    give_back()
    trie, row = Trie(), TaskContext.get().partitionId() << ROW_BITS
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            some = ids.slice(at, TEXTS_AT_ONCE).to_pylist()
            reps = []
            for id_, text in zip(some, texts.slice(at, TEXTS_AT_ONCE).to_pylist()):
                owner = trie.owner(normalised(text or b""))
                owner.add(least_of(id_, row), 1, [] if owner.reps else [row])
                reps.append(owner.reps[0])
                row += 1
            yield filled(schema, row=list(range(row - len(some), row)), id=some, rep=reps)
            if trie.bytes > memory:
                yield from text_rows(schema, ((k, nulled(o)) for k, o in trie.entries()))
                trie = Trie()
    yield from text_rows(schema, ((k, nulled(o)) for k, o in trie.entries()))


def nulled(owner: Owner) -> Owner:
    """The owner with its id as the tables hold it."""
    if owner.least[0]:
        owner.least = (True, None, owner.least[2])
    return owner


def in_partition(batches: Iterator[pa.RecordBatch], schema: pa.Schema, memory: int) -> Iterator[pa.RecordBatch]:
    """Texts that meet by length and hash to owners, and to the texts of spilled subtrees."""
    give_back()
    trie = Trie()
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            passed = []  # to spilled subtrees
            for text, reps, id_, row, n in zip(*(c.slice(at, TEXTS_AT_ONCE).to_pylist() for c in batch.columns)):
                owner = trie.owner(text)
                if owner is None:
                    owner = Owner()
                    passed.append((text, owner))
                owner.add(least_of(id_, row), n, reps)
                trie.bytes += 8 * len(reps)
                if trie.bytes > memory and trie.owners > 1:
                    yield from text_rows(schema, ((k, nulled(o)) for k, o in trie.spill()))
            yield from text_rows(schema, ((k, nulled(o)) for k, o in passed))
    owners: list[tuple] = []
    for key, owner in trie.entries():
        _, id_, row = nulled(owner).least
        digest = hashlib.sha256(key).digest()
        owners += [(rep, id_, row, owner.n, digest) for rep in owner.reps]
        if len(owners) >= 20_000:
            yield filled(schema, **dict(zip(("rep", "low_id", "low_row", "n", "digest"), zip(*owners))))
            owners = []
    if owners:
        yield filled(schema, **dict(zip(("rep", "low_id", "low_row", "n", "digest"), zip(*owners))))


def exact_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY
) -> DataFrame:
    """Every row with its group: (doc_id, keep_id, group_size, kept, digest), the digest being
    the SHA-256 of the normalised text."""
    rows = named(documents, id=id_col, text=text_col)
    schema = row_schema(rows.schema["id"].dataType)
    arrow = to_arrow_schema(schema)
    found = staged(rows.mapInArrow(lambda it: in_task(it, arrow, memory), schema), "dedup-rows", "zstd")
    members = found.filter("row IS NOT NULL").select("id", "row", "rep")
    texts, owners, usual = found.filter("text IS NOT NULL"), [], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = 0
    while True:
        size = texts.agg(F.sum(F.col("length") + NODE_BYTES)).first()[0] or 0
        if turn and not size:
            break
        spread = F.xxhash64(F.lit(turn), "length", "hash")
        met = texts.select("text", "reps", "low_id", "low_row", "n", spread.alias("_")).repartition(max(usual, -(-size // memory)), "_")
        done = staged(met.drop("_").mapInArrow(lambda it: in_partition(it, arrow, memory), schema), f"dedup-owners-{turn}", "zstd")
        owners.append(done.filter("rep IS NOT NULL").select("rep", "low_id", "low_row", "n", "digest"))
        texts, turn = done.filter("text IS NOT NULL"), turn + 1
    joined = members.join(reduce(DataFrame.unionAll, owners), "rep")
    return joined.select(
        F.col("id").alias("doc_id"), F.col("low_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("low_row")).alias("kept"), "digest",
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the document that stays of those with their text."""
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS same FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY same ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(same) AS text_sha256
FROM t WINDOW g AS (PARTITION BY same)
"""
