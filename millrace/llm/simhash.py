"""SimHash near-duplicate detection with pigeonring candidate filtering.

The 64 bits form a ring of three segments (22, 21 and 21 bits). Two fingerprints that differ in at
most 2 bits have, by the pigeonring principle, a segment i from which every chain of consecutive
segments keeps within its share of the budget: segment i differs in at most floor(2/3) = 0 bits,
segments i and i+1 together in at most floor(4/3) = 1, all three in at most 2. As segment i+1 then
differs in at most one bit, one of its halves is equal, so segment i and that half are a key of 32
or 33 bits: six keys for each distinct fingerprint find every link. Within a key the whole chain
is checked before the full distance.

Keys that hold more than `bucket` distinct fingerprints are refined: the bits that are still free are
cut in three, of which one must be equal again, and each of the three makes a longer key. After
three refinements at most 10 bits are free, so no bucket can exceed 1,024 fingerprints: the work for a
fingerprint is bounded at any size, with no cap and no lost link. A bucket gives a spanning star for
each of its components rather than all its pairs.

Copies share a fingerprint and are one row from the start, so they meet in no bucket. Components come back to rows by a broadcast for fingerprints of at least a
thousandth of the rows, and by a join for the others.

Defined cases: a null or empty text has fingerprint zero and links like any other; a long text is hashed whole, some 65,000 shingles at a time. Ids may be of any
type with an order. A row with a null
id gets a fingerprint and the component of the others that link to it (null if all ids are null).
Repeated ids each get a row. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.shared import cold_values, hot_values, tidy, written

SEED, BUDGET = 42, 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Positions of the ring's segments, low bit and width
RING = ((0, 22), (22, 21), (43, 21))
CHUNK = 1 << 16


def _bits(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def _counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, n: int = 3) -> int:
    """The unsigned SimHash of a text's n-word shingles, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < n:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest, total, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - n + 1
    for at in range(0, count, CHUNK):
        k = min(CHUNK, count - at)
        total += _counts(np.fromiter((digest(line[s : e - 1], SEED) for s, e in zip(starts[at : at + k], ends[at + n - 1 : at + n - 1 + k])), np.uint64, k))
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), n) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fp long")


def _thirds(mask: int) -> list[int]:
    """The free bits of a mask in three runs."""
    free = [i for i in range(64) if not mask >> i & 1]
    k = len(free)
    return [sum(1 << i for i in free[k * j // 3 : k * (j + 1) // 3]) for j in range(3)]


def key_masks(level: int) -> list[tuple[int, int, int]]:
    """(parent's number, start segment of the chain, mask) of each key at a level of refinement."""
    if level == 0:
        out = []
        for i in range(3):
            low, width = RING[(i + 1) % 3]
            half = width // 2
            out += [(-1, i, _bits(*RING[i]) | piece) for piece in (_bits(low, half), _bits(low + half, width - half))]
        return out
    return [(k, i, mask | piece) for k, (_, i, mask) in enumerate(key_masks(level - 1)) for piece in _thirds(mask)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linker(level: int, budget: int):
    chains = [(_bits(*RING[(i + 1) % 3])) for _, i, _ in key_masks(level)]
    step = budget * 2 // 3

    def link(key: int, members: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """A star for each component within one key; members are (rep, unsigned fingerprint)."""
        members.sort()
        n, second = len(members), chains[key]
        boss = list(range(n))

        def top(x):
            while boss[x] != x:
                boss[x] = boss[boss[x]]
                x = boss[x]
            return x

        fps = np.fromiter((f for _, f in members), np.uint64, n) if n > 24 else None
        for x in range(n):
            if fps is None:
                mine = members[x][1]
                near = [y for y in range(x + 1, n) if (d := mine ^ members[y][1]) and (d & second).bit_count() <= step and d.bit_count() <= budget]
            else:
                diff = fps[x + 1 :] ^ fps[x]
                chain = np.flatnonzero(np.bitwise_count(diff & np.uint64(second)) <= step)
                near = (chain[np.bitwise_count(diff[chain]) <= budget] + x + 1).tolist()
            for y in near:
                p, q = top(x), top(y)
                if p != q:
                    boss[max(p, q)] = min(p, q)
        return [(members[r][0], members[x][0]) for x in range(n) if (r := top(x)) != x]

    def run(batches):
        for b in batches:
            out = []
            for key, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += link(key, [(m["rep"], m["fp"] % (1 << 64)) for m in members])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def fingerprint_links(reps: DataFrame, *, budget: int = BUDGET, bucket: int = 1024) -> DataFrame:
    """Edges (a, b) between the reps of distinct fingerprints; their components are those of all links."""
    if not 0 <= budget <= BUDGET:
        raise ValueError("the keys find links of up to 2 differing bits")
    rows, links = reps.select("rep", "fp", F.lit(-1).alias("key"), F.lit(0).cast("long").alias("part")), None
    for level in range(4):
        masks = key_masks(level)
        keys = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(k).alias("key"), F.lit(_signed(m)).alias("m")) for k, (p, _, m) in enumerate(masks)])
        if level:  # only the three keys below the row's own
            keys = F.filter(keys, lambda x: x["p"] == F.col("key"))
        made = rows.withColumn("k", F.explode(keys)).select("rep", "fp", F.col("k.key").alias("key"), F.col("fp").bitwiseAND(F.col("k.m")).alias("part"))
        hot = None
        if level < 3:
            hot = written(made.groupBy("key", "part").count().where(F.col("count") > bucket).select("key", "part"), "hot-keys")
            hot = None if hot.isEmpty() else hot
        cold = made if hot is None else made.join(hot, ["key", "part"], "left_anti")
        groups = cold.groupBy("key", "part").agg(F.collect_list(F.struct("rep", "fp")).alias("members")).where(F.size("members") > 1)
        found = groups.select("key", "members").mapInArrow(_linker(level, budget), "a long, b long")
        links = found if links is None else links.union(found)
        if hot is None:
            break
        rows = written(made.join(hot, ["key", "part"], "left_semi"), "hot-rows")
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3, budget: int = BUDGET, bucket: int = 1024) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(fingerprints(docs, id_col=id_col, text_col=text_col, n=n), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    known = written(reps.where("rep is not null"), "reps")
    parts = connected_components(fingerprint_links(known, budget=budget, bucket=bucket))
    key = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    found = known.join(parts, known.rep == parts.node, "left").select(key.alias("key"), "n", F.coalesce("component", "rep").alias("component_id"))
    found, rows = written(found, "classes"), fps.withColumn("key", key)
    rows = cold_values(hot_values(rows, found, "key", "n", ["component_id"]), found, "key", ["component_id"])
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
