"""Language-model scores by cross-entropy difference.

Two bigram models of one kind, one smoothing and one vocabulary are counted: the target's
over the documents labelled as good, the background's over all documents.  A
document's score is its mean loss a token under the target model minus that
under the background model; the lower, the more the text is like the target.

The vocabulary holds every word of the documents (the minimum count is one),
and words, contexts and bigrams are counted exactly, over whole texts of all
documents.  A word stands by its 64-bit hash, and a bigram by a hash of the two beside
the part of the bigrams that it is counted in.

Tokens never leave their block (some documents of one task, ``TOKENS`` of them): a block
hands on each of its distinct words and bigrams once, with its counts, packed by the part
they are counted in, and its documents as packed word numbers.  Each part adds up the blocks'
counts and answers every block in the block's own order, so an answer needs no keys.
The answers are staged; then each block meets its answers and sums up the losses of its
documents.  What is shuffled grows with the distinct bigrams of blocks, not with documents times
bigrams, and a hot word costs one entry a block.  A bigram's part depends on both words, so the
bigrams after a hot word are spread over all parts.

Which rows are the target's is a join with the labelled ids, broadcast while
there are at most ``BROADCAST_IDS``, which is counted first; beyond that
narrow rows are joined, and bitmaps of positions choose the target's rows.

Defined results: null and empty texts have no tokens and score 0; ids labelled
more than once count once; rows with a null id are never target rows; repeated
rows count and score each; without target documents the target model is
uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.llm.common import TEXTS_AT_ONCE, give_back, named, staged, table
from tallyframe.llm.decontam import folded
from tallyframe.llm.positions import POSITION, inside, outside, positioned

# In OP8_SQL a number for every word and a bucket for every bigram.
VOCABULARY = (1 << 31) - 2
BUCKETS = (1 << 63) - 1
STEP = (1 << 31) + 11  # of the bigrams' hash
START = 0  # the hash that stands before a first word
PRIOR = 10.0  # occurrences that the unigrams weigh in a bigram's estimate
BROADCAST_IDS = 1_000_000
TOKENS = 2_000_000  # of a block
PART_BYTES = 16 << 20  # of the input's files to a part of the counts
BLOCK_BITS = 20  # block number: task in the upper, its block in the lower bits
DOCS, WORDS, BIGRAMS, TOTAL = range(4)  # kinds of rows


def with_target(documents: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, target) of every row; target is 1 or 0."""
    ids = named(target_ids, doc_id="doc_id").dropna().distinct()
    if ids.count() <= BROADCAST_IDS:
        rows = named(documents, doc_id=id_col, text=text_col)
        found = rows.join(F.broadcast(ids.withColumn("target", F.lit(1))), "doc_id", "left")
        return found.select("doc_id", "text", F.coalesce("target", F.lit(0)).alias("target"))
    rows = positioned(documents)
    marks = rows.select(*POSITION, F.col("row")[id_col].alias("doc_id")).join(ids, "doc_id", "left_semi")
    id_, text = F.col("row")[id_col].alias("doc_id"), F.col("row")[text_col].alias("text")
    sides = ((inside(rows, marks), 1), (outside(rows, marks), 0))
    return reduce(DataFrame.unionAll, [side.select(id_, text, F.lit(target).alias("target")) for side, target in sides])


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers of equal length: bytes of one place together, compressed."""
    planes = [np.ascontiguousarray(a).view("u1").reshape(a.size, a.itemsize).T.tobytes() for a in arrays]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True) if planes[0] else b""


def unpacked(data: bytes, size: int, *types: str) -> list[np.ndarray]:
    whole = size * sum(np.dtype(t).itemsize for t in types)
    raw = np.frombuffer(pa.decompress(data, whole, codec="zstd", asbytes=True) if size else b"", "u1")
    out, at = [], 0
    for kind in types:
        width = np.dtype(kind).itemsize
        planes = raw[at : at + size * width].reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * width
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """64 bits that each depend on all given ones."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def both(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mixed(mixed(first + np.uint64(0x9E3779B97F4A7C15)) + second)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(parts)).astype("i8")


def counted(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their times, in all and at flagged places."""
    distinct, n = np.unique(keys, return_counts=True)
    of_target = np.zeros(distinct.size, "i8")
    chosen, times = np.unique(keys[target], return_counts=True)
    of_target[np.searchsorted(distinct, chosen)] = times
    return distinct, n, of_target


def before(tokens: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The token before each; ``start`` before a document's first."""
    out = np.append(start, tokens[:-1])[: tokens.size]
    ends = np.cumsum(lengths)
    out[(ends - lengths)[lengths > 0]] = start
    return out


class Block:
    """Documents of one task, up to ``TOKENS`` tokens."""

    def __init__(self) -> None:
        self.numbers: defaultdict = defaultdict(count().__next__)
        self.tokens: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.target: list[int] = []
        self.ids: list = []
        self.size = 0

    def add(self, id_: object, words: list[bytes], target: int) -> None:
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), "i4", len(words)))
        self.lengths.append(len(words))
        self.target.append(target)
        self.ids.append(id_)
        self.size += len(words)

    def rows(self, number: int, parts: int) -> Iterator[dict]:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.numbers), "u8", len(self.numbers))
        hashes, same = np.unique(np.append(hashes, np.uint64(START)), return_inverse=True)
        part = part_of(hashes, parts)
        # Word numbers go by part, then hash, so a part's words are a stretch of them.
        order = np.lexsort((hashes, part))
        place = np.empty(order.size, "i8")
        place[order] = np.arange(order.size)
        hashes, part, place = hashes[order], part[order], place[same]
        tokens, lengths = place[np.concatenate(self.tokens)], np.array(self.lengths)
        start, size = int(place[-1]), hashes.size
        target = np.repeat(np.array(self.target, bool), lengths)
        context = before(tokens, lengths, start)

        n, n_t = (np.bincount(x, minlength=size) for x in (tokens, tokens[target]))
        c, c_t = (np.bincount(x, minlength=size) for x in (context, context[target]))
        # Common words get small numbers, which pack well.
        common = np.argsort(-n, kind="stable")
        rank = np.empty(size, "i4")
        rank[common] = np.arange(size)
        yield {
            "block": number, "kind": DOCS, "part": number, "size": tokens.size, "payload": packed(rank[tokens]),
            "order": packed(common.astype("i4")), "ids": self.ids, "lengths": self.lengths, "v": start, "n": size, "parts": parts,
        }
        ends = np.searchsorted(part, np.arange(parts + 1))
        for p in np.unique(part).tolist():
            at = slice(ends[p], ends[p + 1])
            # Most words are as often a context as a word: the difference packs to nothing.
            columns = [n[at], n_t[at], n[at] - c[at], n_t[at] - c_t[at]]
            yield {"block": number, "kind": WORDS, "part": p, "size": ends[p + 1] - ends[p],
                   "payload": packed(hashes[at], *[x.astype("i4") for x in columns])}

        keys, n, n_t = counted(context * size + tokens, target)
        first, second = keys // size, keys % size
        of = (part[first] + part[second]) % parts
        order = np.argsort(of, kind="stable")
        hashed, n, n_t, of = both(hashes[first], hashes[second])[order], n[order], n_t[order], of[order]
        ends = np.searchsorted(of, np.arange(parts + 1))
        for p in np.unique(of).tolist():
            at = slice(ends[p], ends[p + 1])
            yield {"block": number, "kind": BIGRAMS, "part": p, "size": ends[p + 1] - ends[p],
                   "payload": packed(hashed[at], n[at].astype("i4"), n_t[at].astype("i4"))}


def block_schema(id_type: T.DataType) -> T.StructType:
    long, binary = T.LongType(), T.BinaryType()
    fields = {"block": long, "kind": T.IntegerType(), "part": long, "size": long, "payload": binary, "order": binary,
              "ids": T.ArrayType(id_type), "lengths": T.ArrayType(long), "v": long, "n": long, "target": long, "parts": long}
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def blocks_of(batches: Iterator[pa.RecordBatch], schema: pa.Schema, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, target) to the packed rows of blocks."""
    give_back()
    number = TaskContext.get().partitionId() << BLOCK_BITS
    block = Block()
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            for id_, text, target in zip(*(c.slice(at, TEXTS_AT_ONCE).to_pylist() for c in batch.columns)):
                words = folded(text)
                if block.ids and block.size + len(words) > TOKENS:
                    yield batch_of(list(block.rows(number, parts)), schema)
                    block, number = Block(), number + 1
                block.add(id_, words, target)
    if block.ids:
        yield batch_of(list(block.rows(number, parts)), schema)


COLUMNS = {WORDS: ("i4",) * 4, BIGRAMS: ("i4",) * 2}


def answered(rows: pa.Table) -> pa.Table:
    """One part's counts, added up over the blocks and given back to each in its order."""
    kind = rows["kind"][0].as_py()
    if kind == DOCS:
        return rows
    sizes = rows["size"].to_pylist()
    slices = [unpacked(data, n, "u8", *COLUMNS[kind]) for data, n in zip(rows["payload"].to_pylist(), sizes)]
    keys, place = np.unique(np.concatenate([x[0] for x in slices]), return_inverse=True)
    totals = []
    for column in range(1, len(slices[0])):
        # Sums of counts are exact as doubles up to 2**53.
        totals.append(np.bincount(place, np.concatenate([x[column] for x in slices]), keys.size).astype("i8"))
    out, at = [], 0
    for block, part, n in zip(rows["block"].to_pylist(), rows["part"].to_pylist(), sizes):
        mine = place[at : at + n]
        at += n
        out.append({"block": block, "kind": kind, "part": part, "size": n, "payload": packed(*[t[mine] for t in totals])})
    if kind == WORDS:
        out.append({"kind": TOTAL, "v": int((totals[0] > 0).sum()), "n": int(totals[0].sum()), "target": int(totals[1].sum())})
    return pa.Table.from_batches([batch_of(out, rows.schema)])


def losses(rows: pa.Table, words: int, total: int, target_total: int, schema: pa.Schema) -> pa.Table:
    """(doc_id, n_tokens, target_loss, background_loss) of one block's documents."""
    rows = sorted(rows.to_pylist(), key=lambda r: (r["kind"], r["part"]))
    docs, start, size = rows[0], rows[0]["v"], rows[0]["n"]
    given = {kind: [r for r in rows if r["kind"] == kind] for kind in (WORDS, BIGRAMS)}
    part = np.repeat([r["part"] for r in given[WORDS]], [r["size"] for r in given[WORDS]]).astype("i8")

    def counts(kind: int) -> list[np.ndarray]:
        slices = [unpacked(r["payload"], r["size"], *["i8"] * len(COLUMNS[kind])) for r in given[kind]]
        return [np.concatenate(x) for x in zip(*slices)]

    lengths = np.array(docs["lengths"], "i8")
    per_doc = [np.zeros(lengths.size), np.zeros(lengths.size)]
    if docs["size"]:
        n, n_t, less, less_t = counts(WORDS)
        (common,), (ranks,) = unpacked(docs["order"], size, "i4"), unpacked(docs["payload"], docs["size"], "i4")
        tokens = common[ranks].astype("i8")
        keys, place = np.unique(before(tokens, lengths, start) * size + tokens, return_inverse=True)
        first, second = keys // size, keys % size
        order = np.argsort((part[first] + part[second]) % docs["parts"], kind="stable")
        pair, pair_t = np.empty(keys.size, "i8"), np.empty(keys.size, "i8")
        pair[order], pair_t[order] = counts(BIGRAMS)
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        for side, (all_, seen, word, context) in enumerate(
            ((target_total, pair_t, n_t, n_t - less_t), (total, pair, n, n - less))
        ):
            alone = (word[second] + 1) / (all_ + words + 1)
            loss = -np.log((seen + PRIOR * alone) / (context[first] + PRIOR))
            per_doc[side][lengths > 0] = np.add.reduceat(loss[place], starts) / lengths[lengths > 0]
    columns = [docs["ids"], lengths, *per_doc]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def scored(documents: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its losses: (doc_id, n_tokens, target_loss, background_loss, score).

    ``target_ids`` has the one column doc_id.
    """
    rows = named(documents, doc_id=id_col, text=text_col)
    spark, id_type = rows.sparkSession, rows.schema["doc_id"].dataType
    schema = block_schema(id_type)
    arrow = to_arrow_schema(schema)
    # Spark's own estimate from the files' sizes; any number of parts is right.
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, min(size // PART_BYTES, 1 << 24))
    flagged = with_target(documents, target_ids, id_col, text_col)
    blocks = flagged.mapInArrow(lambda it: blocks_of(it, arrow, parts), schema)
    answers = staged(blocks.groupBy("kind", "part").applyInArrow(answered, schema), "lm-answers")
    totals = answers.filter(F.col("kind") == TOTAL).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "n", "target")]).first()
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType())]
                       + [T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss")])
    out_arrow = to_arrow_schema(out)
    words, total, target_total = totals
    found = answers.filter(F.col("kind") != TOTAL).groupBy("block").applyInArrow(
        lambda block: losses(block, words, total, target_total, out_arrow), out
    )
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by how much they are like those labelled as good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    found = scored(table(spark, sf_dir, "documents"), good)
    rounded = [F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")]
    return found.select("doc_id", "n_tokens", *rounded)


OP8_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, d.doc_id, g.doc_id IS NOT NULL AS target,
         coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g USING (doc_id)),
token AS (SELECT r, target, unnest(w) AS word, unnest(range(len(w))) AS i FROM doc),
ranked AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS id FROM token GROUP BY word),
vocabulary AS (SELECT word, id FROM ranked WHERE id <= {VOCABULARY}),
size AS (SELECT count(*) AS v FROM vocabulary),
numbered AS (SELECT r, target, i, coalesce(id, 0) AS id FROM token LEFT JOIN vocabulary USING (word)),
pair AS (SELECT r, target, id, coalesce(lag(id) OVER (PARTITION BY r ORDER BY i), (SELECT v + 1 FROM size)) AS p FROM numbered),
gram AS (SELECT *, (p * {STEP} + id) % {BUCKETS} AS h FROM pair),
single AS (SELECT id, count(*) AS b, count(*) FILTER (target) AS t FROM gram GROUP BY id),
context AS (SELECT p, count(*) AS b, count(*) FILTER (target) AS t FROM gram GROUP BY p),
bucket AS (SELECT h, count(*) AS b, count(*) FILTER (target) AS t FROM gram GROUP BY h),
total AS (SELECT sum(b)::DOUBLE AS b, sum(t)::DOUBLE AS t FROM single),
loss AS (
  SELECT r,
    -ln((least(u.t, c.t) + {PRIOR} * (s.t + 1) / (n.t + z.v + 1)) / (c.t + {PRIOR})) AS lt,
    -ln((least(u.b, c.b) + {PRIOR} * (s.b + 1) / (n.b + z.v + 1)) / (c.b + {PRIOR})) AS lb
  FROM gram JOIN single s USING (id) JOIN context c USING (p) JOIN bucket u USING (h), total n, size z),
mean AS (SELECT r, avg(lt) AS lt, avg(lb) AS lb FROM loss GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(lt, 0), 6) AS target_loss,
       round(coalesce(lb, 0), 6) AS background_loss, round(coalesce(lt - lb, 0), 6) AS score
FROM doc LEFT JOIN mean USING (r)
"""
