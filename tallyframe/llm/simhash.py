"""SimHash near-duplicates by bit-sliced comparison of fingerprints.

A text's 4-word shingles (repeats included) are hashed with XXH64; a bit of
the fingerprint is set when over half of the hashes have it.  Fingerprints
link when they differ in at most ``radius`` bits; a component is what links
reach.

Candidates come from exact band tables: with ``b`` bands, two fingerprints
within radius r agree on at least ``b - r`` of them, so every linked pair
shares a key in the table of some ``b - r`` bands.  Rows of all tables are
range-partitioned by (table, key, fingerprint).  A task stores its
fingerprints vertically, 64 bit planes of lanes, and compares lane i with lane
i + d for d = 1, 2, ...: the planes are XORed with themselves shifted by d
lanes, differences are counted by carry-save adders in three bitwise counters
plus an overflow, and blocks of 64 lanes are abandoned once every lane of
interest exceeds the radius.  Lanes already known to be connected are not
compared again, so a dense group costs about its size, not its square, and a
task hands on one edge per fingerprint and table, never all pairs.

A bucket that a range boundary cuts is compared across its slices as well:
each pair of slices meets in one more task.  So a bucket of any size is split
over tasks, with no cap.  Components are joined up by alternating large-star
and small-star steps over the edges, each step staged in the shared folder.

Defined results: a text without words, an empty text and null have fingerprint
zero and link like any other; rows with null ids are kept, a component's id is
its smallest id that is not null (null if all are); repeated rows are kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import named, staged, table, text_udf

SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LANES_AT_ONCE = 1 << 12  # words of 64 lanes that are compared together
CHUNK = 1 << 16  # hashes whose bits are counted together


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of ``text`` as a signed integer."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        joined = iter([b" ".join(words)])
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    total = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), "<u8", total)
    ones = np.zeros(64, "i8")
    for start in range(0, total, CHUNK):
        octets = hashes[start : start + CHUNK].view("u1").reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def plan_bands(distinct: int, radius: int) -> tuple[int, int]:
    """(bands, bands in a key): the shortest keys that leave about one random
    bucket mate a row.  Any choice finds every link."""
    for chosen in range(1, 5):
        bands = radius + chosen
        if 2 ** (64 * chosen / bands) >= distinct:
            break
    return bands, chosen


def band_masks(bands: int, chosen: int) -> list[int]:
    """Signed masks, one per choice of ``chosen`` out of ``bands`` bands."""
    edges = [64 * i // bands for i in range(bands + 1)]
    band = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(bands)]
    masks = [sum(parts) for parts in combinations(band, chosen)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words) planes; lane i is bit i % 64 of word i // 64.  One zero word follows."""
    words = -(-len(prints) // 64) + 1
    bits = np.zeros((64, words * 64), "u1")
    octets = prints.astype("<u8").view("u1").reshape(-1, 8)
    bits[:, : len(prints)] = np.unpackbits(octets, axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def shifted(planes: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Words ``at`` of the planes as seen ``distance`` lanes on."""
    skip, rest = divmod(distance, 64)
    last = planes.shape[1] - 1
    out = planes[:, np.minimum(at + skip, last)]
    if rest:
        after = planes[:, np.minimum(at + skip + 1, last)]
        out = (out >> np.uint64(rest)) | (after << np.uint64(64 - rest))
    return out


def over_radius(ones, twos, fours, over, radius: int) -> np.ndarray:
    """Lanes whose count (overflow, or the three counter bits) is above the radius."""
    above, equal = over.copy(), ~over
    for counter, weight in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & weight:
            equal &= counter
        else:
            above |= equal & counter
            equal &= ~counter
    return above


def within_radius(differences: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, lanes in them) of the wanted lanes within the radius.

    ``differences`` are XORed planes; two planes enter the counters through
    one carry-save adder, and words are dropped every 16 planes once all
    their wanted lanes exceed the radius.
    """
    at = np.arange(wanted.size)
    ones, twos, fours, over = (np.zeros(wanted.size, "u8") for _ in range(4))
    for first in range(0, 64, 16):
        for plane in range(first, first + 16, 2):
            x, y = differences[plane], differences[plane + 1]
            either = ones ^ x
            carry = (ones & x) | (either & y)
            ones = either ^ y
            both = twos & carry
            twos ^= carry
            over |= fours & both
            fours ^= both
        alive = wanted & ~over_radius(ones, twos, fours, over, radius)
        kept = np.flatnonzero(alive)
        if not kept.size:
            return kept, alive[:0]
        if kept.size < at.size:
            at, wanted, differences = at[kept], wanted[kept], differences[:, kept]
            ones, twos, fours, over = ones[kept], twos[kept], fours[kept], over[kept]
            alive = alive[kept]
    return at, alive


def connect(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of a[i] and b[i]; a label is the smallest member."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        parent = np.arange(labels.size)
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further
        labels = parent[labels]


def local_components(buckets: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by bucket, the first row each is linked with inside the buckets."""
    n = len(prints)
    labels = np.arange(n)
    if n < 2:
        return labels
    planes = bit_planes(prints)
    ends = np.searchsorted(buckets, buckets, side="right")
    mates = ends - np.arange(n)  # rows of the bucket from here on
    lanes = np.flatnonzero(mates > 1)
    distance = 1
    while lanes.size:
        pieces, words = [], 0
        while lanes.size and words < LANES_AT_ONCE:
            open_ = lanes[labels[lanes] != labels[lanes + distance]]
            if open_.size:
                word = open_ >> 6
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                wanted = np.bitwise_or.reduceat(np.uint64(1) << (open_ & 63).astype("u8"), starts)
                at = word[starts]
                pieces.append((planes[:, at] ^ shifted(planes, at, distance), wanted, at, np.full(at.size, distance)))
                words += at.size
            distance += 1
            lanes = lanes[mates[lanes] > distance]
        if not pieces:
            break
        differences, wanted, at, distances = (np.concatenate(x, axis=-1) for x in zip(*pieces))
        found, alive = within_radius(differences, wanted, radius)
        if found.size:
            bits = np.unpackbits(alive.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(bits)
            a = at[found[row]] * 64 + lane
            labels = connect(labels, a, a + distances[found[row]])
    return labels


OUT = "a long, b long, band int, key long, part int"


def linked_rows(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Edges (fingerprint, first fingerprint it is linked with) of sorted whole buckets."""
    changes = (frame["band"].diff() != 0) | (frame["key"].diff() != 0)
    prints = frame["fp"].to_numpy("i8")
    first = prints[local_components(changes.cumsum().to_numpy(), prints.view("u8"), radius)]
    linked = first != prints
    return pd.DataFrame({"a": prints[linked], "b": first[linked], "band": None, "key": None, "part": None})


def edges_in(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Edges of one sorted partition, and the rows of its first and last bucket
    (b is null), which may go on in the neighbouring partitions."""
    held, first, part = None, None, TaskContext.get().partitionId()

    def at_edge(frame: pd.DataFrame, bucket: tuple) -> pd.DataFrame:
        of = frame[(frame["band"] == bucket[0]) & (frame["key"] == bucket[1])]
        return pd.DataFrame({"a": of["fp"], "b": None, "band": of["band"], "key": of["key"], "part": part})

    for frame in frames:
        if frame.empty:
            continue
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        first = first or (held["band"].iloc[0], held["key"].iloc[0])
        last = held.iloc[-1]
        open_ = (held["band"] == last["band"]) & (held["key"] == last["key"])
        if not open_.all():
            whole = held[~open_].reset_index(drop=True)
            yield linked_rows(whole, radius)
            yield at_edge(whole, first)
            held = held[open_].reset_index(drop=True)
    if held is not None:
        yield linked_rows(held, radius)
        yield at_edge(held, (held["band"].iloc[0], held["key"].iloc[0]))


def fingerprint_edges(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column ``fp``, distinct) within the radius."""
    masks = band_masks(*plan_bands(prints.count(), radius))
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key"))
            for i, mask in enumerate(masks)
        ]
    )
    found = staged(
        prints.select("fp", F.explode(keys).alias("_"))
        .select("fp", "_.band", "_.key")
        .repartitionByRange("band", "key", "fp")
        .sortWithinPartitions("band", "key", "fp")
        .mapInPandas(partial(edges_in, radius=radius), OUT),
        "simhash-edges",
    )
    # Buckets that a range boundary cuts: every two slices meet once more.
    edge_rows = found.filter("b is null").select("band", "key", "part", F.col("a").alias("fp"))
    slices = edge_rows.select("band", "key", "part").distinct()
    other = slices.withColumnRenamed("part", "other")
    meetings = slices.join(other, ["band", "key"]).filter("part <> other")

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        return linked_rows(frame.sort_values("fp", ignore_index=True), radius)

    cut = (
        edge_rows.join(meetings, ["band", "key", "part"])
        .withColumns({"one": F.least("part", "other"), "two": F.greatest("part", "other")})
        .groupBy("band", "key", "one", "two")
        .applyInPandas(across, OUT)
    )
    inside = found.filter("b is not null")
    return inside.select("a", "b").unionAll(cut.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of the edges but the smallest of its component, with that
    smallest.  Alternates large-star and small-star until nothing changes."""
    current = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b").distinct(),
        "star-0",
    )
    seen = None
    step = 0
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            return current
        seen, step = state, step + 1
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Staged, so that the join shuffles both sides itself and can split a hub's rows.
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = staged(low, f"star-{step}-low")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, f"star-{step}-large")
        low = staged(large.groupBy("a").agg(F.min("b").alias("m")), f"star-{step}-lowest")
        small = large.join(low, "a")
        current = staged(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low.select("a", F.col("m").alias("b")))
            .distinct(),
            f"star-{step}-small",
        )


def near_duplicates(
    documents: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text",
    more: dict[str, str] | None = None,
) -> DataFrame:
    """Every row with its fingerprint and component: (doc_id, fp, component_id, root, *more).

    ``root`` names the component also where no member has an id."""
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold distances up to 7")
    prints_of = text_udf(partial(fingerprint, shingle=shingle), T.LongType())
    rows = named(documents, **{"doc_id": id_col, "text": text_col, **(more or {})})
    rows = staged(rows.withColumn("fp", prints_of("text")).drop("text"), "simhash-prints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    linked = components(fingerprint_edges(nodes.select("fp"), radius)).toDF("fp", "root")
    member = nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(member.join(first, "root").select("fp", "component_id", "root"), "fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their SimHash fingerprint and component, radius 4."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
