"""Near duplicates by 5-word shingles at a Jaccard similarity of 0.8 or more.

Texts of that similarity differ in some 15 % of their SimHash bits, far beyond what segments of 64
bits can search, so SimHash alone can't find them. Candidates come from two sources, and each is then
checked exactly on the sets of distinct shingles of whole texts:

* SimHash links of at most 2 bits (`simhash.fingerprint_links`, pigeonring keys);
* a ring of eight segments of three minhashes each. Texts that agree in a whole segment meet under its key
  (at a similarity of 0.8 with a chance of 1 - (1 - 0.8^3)^8 = 0.997, at 0.9 of 0.9999), and go on if at
  most 10 of the 24 minhashes differ (0.998 at 0.8).

The links of a key are found in two steps. First the nearest pairs are checked: a minimum spanning forest over the
number of differing minhashes, n - 1 pairs for a group of n rather than all, which joins groups of near copies
early. Then each key whose texts are still in several components is checked whole (`key_links`): its texts meet
in one task with their shingle sets, and every pair in different components is counted exactly unless a prefix
of their rarest shingles rules it out. So texts that share a long passage don't hide a link among them. A key of more
than `block` shingles is dealt into blocks, every two of which meet in a task, so its length costs no link.

Members are sorted first, so the same rows give the same pairs. In the first step keys of more than `bucket` texts are not
collected: each text is set against one text of the key, chosen by a hash; those that differ from it in
over 4 minhashes go on under a longer key (the next segment too), until no key is large or all eight
segments are equal. The second step checks these keys whole like all others.

Texts with equal sets of shingles are one from the start; each such set has a number, by which links and components go, so rows that share an id
are never taken for one another. A row is told by its id and the hash of its text. The result is the component of the links that passed
the exact check, and which row of it stays: that with the smallest id, of several with that id the one with the smallest hash.

Defined cases: a null or empty text, or one without words, has the set of one empty shingle, so such texts
are alike; with fewer words than five the shingle is all of them; a long text is one set of all its shingles, made and checked by itself. A null id
counts as larger than all others (the component's id is null if all are null). Repeated ids each get a row, and rows that repeat id and text are all
marked as staying if one is (`deduplicate` then keeps one). An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from millrace.llm import simhash
from millrace.llm.components import connected_components
from millrace.llm.shared import cold_values, hot_values, text_or_empty, tidy, written

N_WORDS, SIMILARITY = 5, 0.8
SEGMENTS, WIDTH = 8, 3
#: Of 24 minhashes, at most so many differ in a candidate; a text this near to a large key's choice is done there
APART, CLOSE = 10, 4
#: Texts of one key that are counted against another at once; its component may have grown after that
CHECKED = 256
#: Shingles of a key's block of texts; a task holds two blocks at a time
BLOCK = 1 << 20
_RANDOM = np.random.default_rng(simhash.SEED)
FLIP = _RANDOM.integers(0, 1 << 64, (SEGMENTS * WIDTH, 1), np.uint64)
TIMES = _RANDOM.integers(0, 1 << 64, (SEGMENTS * WIDTH, 1), np.uint64) | np.uint64(1)
SKETCH = ["s0", "s1", "s2"]


def shingle_set(text: str | None, n: int = N_WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's n-word shingles, ascending."""
    words = (text or "").encode().translate(simhash.LOWER).split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(line, simhash.SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.unique(np.fromiter((digest(line[s : e - 1], simhash.SEED) for s, e in zip(starts, ends[n - 1 :])), np.uint64, len(words) - n + 1))


def minhashes(found: np.ndarray) -> np.ndarray:
    least = np.full(SEGMENTS * WIDTH, ~np.uint64(0))
    for at in range(0, len(found), simhash.CHUNK):
        least = np.minimum(least, ((found[None, at : at + simhash.CHUNK] ^ FLIP) * TIMES).min(axis=1))
    return least


def _sketches(n: int):
    def run(batches):
        for b in batches:
            digests, fps, parts, keys, sizes = [], [], [], [], []
            for t in b.column(2):
                text = t.as_py()
                found = shingle_set(text, n)
                least = minhashes(found)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                fps.append(simhash.fingerprint(text))
                sizes.append(len(found))
                # byte i of each of the three longs belongs to segment i
                parts.append(least.astype(np.uint8).reshape(SEGMENTS, WIDTH).T.copy().view(np.int64).ravel())
                keys.append([xxhash.xxh64_intdigest(least[i * WIDTH : (i + 1) * WIDTH].tobytes(), i) for i in range(SEGMENTS)])
            s = np.array(parts, np.int64).reshape(-1, WIDTH)
            keys = pa.array(np.array(keys, np.uint64).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * SEGMENTS), keys)
            columns = [b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), *(pa.array(s[:, i]) for i in range(WIDTH)), lists, pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "digest", "fp", *SKETCH, "keys", "size"])

    return run


def _forests(batches):
    """The pairs of a minimum spanning forest within each key."""
    for b in batches:
        one, other = [], []
        for members in b.column(0).to_pylist():
            reps = np.array([m["rep"] for m in members], np.int64)
            marks = np.array([[m[s] for s in SKETCH] for m in members], np.int64).view(np.uint8)
            best, near = np.full(len(reps), 255), np.zeros(len(reps), np.int64)
            left = np.ones(len(reps), bool)
            at = 0
            for _ in range(len(reps) - 1):
                left[at] = False
                apart = (marks != marks[at]).sum(axis=1)
                near[apart < best] = at
                best = np.minimum(best, apart)
                at = int(np.where(left, best, 256).argmin())
                if best[at] <= APART and reps[at] != reps[near[at]]:
                    one.append(int(reps[near[at]]))
                    other.append(int(reps[at]))
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], ["a", "b"])


def _apart(pairs: list[tuple[str, str]]):
    """How many bytes differ, over pairs of long columns."""
    total = F.lit(0)
    for a, b in pairs:
        x = F.col(a).bitwiseXOR(F.col(b))
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def ring_candidates(reps: DataFrame, *, bucket: int = 1024) -> DataFrame:
    """Pairs (a, b) of reps that share a segment of minhashes."""
    pairs = None
    rows = reps.select("rep", *SKETCH, F.posexplode("keys").alias("segment", "key"))
    for level in range(SEGMENTS):
        if level:
            rows = rows.withColumn("key", F.xxhash64("key", *[F.expr(f"shiftrightunsigned({s}, 8 * ((segment + {level}) % {SEGMENTS})) & 255") for s in SKETCH]))
        chosen = F.min_by(F.struct("rep", *SKETCH), F.xxhash64("rep", "segment")).alias("m")
        large = written(rows.groupBy("segment", "key").agg(F.count(F.lit(1)).alias("n"), chosen).where(F.col("n") > bucket), "large-keys")
        last = large.isEmpty()
        small = rows if last else rows.join(large, ["segment", "key"], "left_anti")
        groups = small.groupBy("segment", "key").agg(F.array_sort(F.collect_list(F.struct("rep", *SKETCH))).alias("members")).where(F.size("members") > 1)
        found = written(groups.select("members").mapInArrow(tidy(_forests), "a long, b long"), "pairs", "a")
        pairs = found if pairs is None else pairs.union(found)
        if last:
            return pairs
        flat = large.select("segment", "key", F.col("m.rep").alias("top"), *[F.col(f"m.{s}").alias(f"t{i}") for i, s in enumerate(SKETCH)])
        held = rows.join(flat, ["segment", "key"]).withColumn("apart", _apart([(s, f"t{i}") for i, s in enumerate(SKETCH)]))
        held = written(held.select("rep", *SKETCH, "segment", "key", "top", "apart"), "large-rows")
        pairs = pairs.union(held.where((F.col("apart") <= APART) & (F.col("rep") != F.col("top"))).select(F.col("top").alias("a"), F.col("rep").alias("b")))
        rows = held.where(F.col("apart") > CLOSE).select("rep", *SKETCH, "segment", "key")
    return pairs


def _sets(n: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # one at a time: a long text's set is as long as the text
                found = shingle_set(b.column(1)[i].as_py(), n).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))], ["rep", "shingles"])

    return run


def _joins(similarity: float):
    """Links that join the components of one key's texts, so that those of all its links are joined.

    A text of `k` shingles, ordered by how few of the key's texts hold them, shares one of its first
    k - ceil(2s / (1 + s) k) + 1 with the first k - ceil(s k) + 1 of any text as long or longer at a similarity of s:
    what shares none is no link. All others in different components are counted exactly.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "ascending"), ("rep", "ascending")])
        reps, parts = group["rep"].to_numpy(), np.unique(group["component"].to_numpy(), return_inverse=True)[1]
        lists = group["shingles"].combine_chunks()
        tokens, counts = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)[1:]
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        tokens, common = rank[tokens], np.sort(counts) > 1
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        for a, b in zip(ends - sizes, ends):
            tokens[a:b].sort()
        blocks, across = group["block"].to_numpy(), group["i"][0] != group["j"][0]  # texts of one block meet elsewhere
        holds, inside, out = {}, np.zeros(len(counts), bool), []
        least = similarity - 1e-9
        for y, (end, k) in enumerate(zip(ends.tolist(), sizes.tolist())):
            own = tokens[end - k : end]
            head = own[: k - math.ceil(least * k) + 1]
            met = [holds[t] for t in head[common[head]].tolist() if t in holds]
            near = np.unique(np.fromiter(chain.from_iterable(met), np.int64)) if met else np.zeros(0, np.int64)
            near = near[(sizes[near] >= least * k) & (parts[near] != parts[y])]
            if across:
                near = near[blocks[near] != blocks[y]]
            inside[own] = True
            while len(near):
                now, near = near[:CHECKED], near[CHECKED:]
                take = np.concatenate([np.arange(e - m, e) for e, m in zip(ends[now].tolist(), sizes[now].tolist())])
                both = np.add.reduceat(inside[tokens[take]].astype(np.int64), np.cumsum(sizes[now]) - sizes[now])
                for x in now[both / (sizes[now] + k - both) >= similarity - 1e-12].tolist():
                    if parts[x] != parts[y]:
                        out.append((reps[x], reps[y]))
                        parts[parts == parts[x]] = parts[y]
                near = near[parts[near] != parts[y]]
            inside[own] = False
            head = own[: k - math.ceil(2 * least / (1 + least) * k) + 1]
            for t in head[common[head]].tolist():
                holds.setdefault(t, []).append(y)
        return pa.table({"a": pa.array([int(a) for a, _ in out], pa.int64()), "b": pa.array([int(b) for _, b in out], pa.int64())})

    return run


def key_links(reps: DataFrame, parts: DataFrame, sets_of, *, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the components (node, component) of all links within a key.

    A key of more than `block` shingles is dealt into blocks, and every two blocks meet.
    """
    known = reps.join(parts, reps.rep == parts.node, "left").select("rep", "size", F.coalesce("component", "rep").alias("component"), F.posexplode("keys").alias("segment", "key"))
    known = written(known, "key-rows")
    open_keys = known.groupBy("segment", "key").agg(F.ceil(F.sum("size") / block).cast("int").alias("blocks"), F.min("component").alias("x"), F.max("component").alias("y"))
    open_keys = open_keys.where("x < y").select("segment", "key", "blocks")
    rows = known.join(open_keys, ["segment", "key"]).withColumn("block", F.pmod(F.xxhash64("rep", "segment"), "blocks").cast("int"))
    rows = written(rows.select("rep", "size", "component", "segment", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")), "open-rows", "rep")
    sets = sets_of(rows.select("rep").distinct())
    meet = rows.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other")
    return written(meet.join(sets, "rep").groupBy("segment", "key", "i", "j").applyInArrow(_joins(similarity), "a long, b long"), "key-links", "a")


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, name: str, most: int = 4096) -> DataFrame:
    """pairs with the set of one end. A set that is in more than `most` pairs is sent several times, to as many tasks."""
    many = pairs.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("tasks")).where("tasks > 1")
    dealt = pairs.join(many, end, "left").select(*pairs.columns, F.pmod(F.xxhash64(*pairs.columns[:2]), F.coalesce("tasks", F.lit(1))).cast("int").alias("task"))
    copied = sets.toDF(end, name).join(many, end, "left").select(end, name, F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1)).alias("task"))
    return dealt.join(copied, [end, "task"]).drop("task")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N_WORDS, similarity: float = SIMILARITY, bucket: int = 1024, block: int = BLOCK) -> DataFrame:
    """One row for each input row: doc_id, text_hash, component_id (the smallest id of its class), and whether it stays."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text"))
    schema = texts.drop("text").schema
    for name, kind in (("digest", "binary"), ("fp", "long"), *((x, "long") for x in SKETCH), ("keys", ArrayType(LongType())), ("size", "long")):
        schema = schema.add(name, kind)
    marks = written(texts.mapInArrow(tidy(_sketches(n)), schema), "sketches", "digest")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    reps = marks.groupBy("digest").agg(F.min(row).alias("first"), F.min_by(F.struct("fp", *SKETCH, "keys", "size"), row).alias("m"), F.count(F.lit(1)).alias("n"))
    reps = written(reps.select("digest", "first", "n", "m.*", F.monotonically_increasing_id().alias("rep")), "reps")
    by_print = written(reps.groupBy("fp").agg(F.min("rep").alias("rep")), "prints")
    same = reps.select("fp", F.col("rep").alias("b")).join(by_print.withColumnRenamed("rep", "a"), "fp").where("a <> b").select("a", "b")
    pairs = same.union(simhash.fingerprint_links(by_print)).union(ring_candidates(reps, bucket=bucket))
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "candidates")

    def sets_of(ends: DataFrame) -> DataFrame:
        """The shingle sets of the reps in the one column of ends."""
        rows = reps.join(ends.toDF("rep"), "rep", "left_semi").select("rep", F.col("first.doc_id").alias("i"), F.col("first.text_hash").alias("h"))
        whole = texts.join(rows, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))).select("rep", "text")
        sets = written(whole.mapInArrow(tidy(_sets(n)), "rep long, shingles array<long>"), "shingles", "rep")
        if sets.groupBy("rep").count().where("count > 1").isEmpty():
            return sets
        return written(sets.dropDuplicates(["rep"]), "shingles")  # rows that repeat both id and text

    sets = sets_of(pairs.select("a").union(pairs.select("b")).distinct())
    both = F.size(F.array_intersect("x", "y"))
    links = _with_sets(_with_sets(pairs, sets, "a", "x"), sets, "b", "y")
    links = links.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))
    links = written(links.where(F.col("similarity") >= similarity - 1e-12).select("a", "b"), "links", "a")

    links = links.union(key_links(reps, connected_components(links), sets_of, similarity=similarity, block=block))
    parts = written(connected_components(links), "classes")
    best = parts.join(reps.select(F.col("rep").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("best"))
    known = reps.join(parts.join(best, "component").select(F.col("node").alias("rep"), "best"), "rep", "left").select("digest", "n", F.coalesce("best", "first").alias("best"))
    known, rows = written(known, "known"), marks.select("doc_id", "text_hash", "digest")
    out = cold_values(hot_values(rows, known, "digest", "n", ["best"]), known, "digest", ["best"])
    return out.select("doc_id", "text_hash", F.col("best.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each class."""
    mark = "_text_hash"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    found = written(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "near-duplicates")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(f"{mark}id"), F.col("text_hash").alias(f"{mark}h")).distinct()
    rows = docs.withColumn(mark, F.xxhash64(text_or_empty(text_col)))
    rows = rows.join(gone, rows[id_col].eqNullSafe(gone[f"{mark}id"]) & (rows[mark] == gone[f"{mark}h"]), "left_anti")
    if not found.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates([id_col, mark])
    return rows.drop(mark)
