"""MinHash near-dedup: multi-index Hamming join of b-bit signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, least_labels, mix, sieve, text_slices, whole_groups, word_hashes, written

# Components of a signature, 16 bits each.
COMPONENTS = 64
# Members of a bucket, and documents of a candidate group and their shingles, that are compared at a time.
BUCKET_BLOCK = 1024
VERIFY_BLOCK = 128
VERIFY_SHINGLES = 1 << 20
# Links of one document that are joined to one copy of its set.
LINKS_A_COPY = 512


def chunks_for(similarity: float, errors: float = 4.5) -> int:
    """Chunks that pigeonhole splits a signature into, one error being allowed in a chunk.

    Two signatures that differ in at most radius = 2 * chunks - 1 components agree, but for one component, in
    some chunk. The radius lies `errors` standard deviations above what the least similarity lets differ.
    """
    apart = 1 - similarity
    most = COMPONENTS * apart + errors * (COMPONENTS * apart * similarity) ** 0.5
    return int(min(COMPONENTS // 2, max(1, np.ceil((most + 0.5) / 2))))


_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _RNG.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's set of `words`-word shingles as sorted 64-bit hashes; fewer words make one shingle."""
    h, first = word_hashes(texts)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            joined = h[a : b - words + 1] * _PLACE[0]
            for k in range(1, words):
                for m in range(0, len(joined), 65_536):
                    part = joined[m : m + 65_536]
                    part += h[a + k + m : a + k + m + len(part)] * _PLACE[k]
            for m in range(0, len(joined), 65_536):
                joined[m : m + 65_536] = mix(joined[m : m + 65_536])
            joined.sort()
            new = np.ones(len(joined), bool)
            np.not_equal(joined[1:], joined[:-1], out=new[1:])
            out.append(joined[new])
        elif b > a:
            own = (h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([own], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least_hashes(u: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every component, the least permuted hash of each run of u."""
    out = np.empty((len(starts), COMPONENTS), np.uint64)
    work = np.empty_like(u)
    for k in range(COMPONENTS):
        np.bitwise_xor(u, _XOR[k], out=work)
        np.multiply(work, _MUL[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def signatures(sets: list[np.ndarray], block: int = 65_536) -> np.ndarray:
    """b-bit MinHash signatures of non-empty sets, one row each; a set larger than a block is taken in parts."""
    least = np.empty((len(sets), COMPONENTS), np.uint64)
    start = 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + len(sets[stop]) <= block):
            total += len(sets[stop])
            stop += 1
        if total > block:
            u = sets[start]
            least[start] = np.min([_least_hashes(u[k : k + block], np.zeros(1, np.int64))[0] for k in range(0, len(u), block)], axis=0)
        else:
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : stop - 1]], dtype=np.int64)]).astype(np.int64)
            least[start:stop] = _least_hashes(np.concatenate(sets[start:stop]), starts)
        start = stop
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(sigs: np.ndarray, chunks: int) -> np.ndarray:
    """For each signature, a key per chunk and component left out (the allowed error)."""
    each = mix(sigs.astype(np.uint64) * _KEY + np.arange(COMPONENTS, dtype=np.uint64))
    out = np.zeros_like(each)
    for chunk in np.array_split(np.arange(COMPONENTS), chunks):
        whole = each[:, chunk].sum(axis=1, dtype=np.uint64)
        for k in chunk:
            out[:, k] = mix(whole - each[:, k] + _KEY[k])
    return out.view(np.int64)


def _second(s: np.ndarray) -> np.uint64:
    """A second hash of a set, independent of its sum."""
    out = np.uint64(0)
    for k in range(0, len(s), 65_536):
        out ^= np.bitwise_xor.reduce(mix(s[k : k + 65_536] + np.uint64(1)))
    return out


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                sets = shingle_sets(part.column(1), words)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = [k for k in range(len(sets)) if sizes[k]]
                sig = [b""] * len(sets)
                k1, k2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if full:
                    own = [sets[k] for k in full]
                    for k, s in zip(full, signatures(own)):
                        sig[k] = s.tobytes()
                    k1[full] = mix(np.array([s.sum(dtype=np.uint64) for s in own]))
                    k2[full] = mix(np.array([_second(s) for s in own]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sig, pa.binary())],
                    ["id", "n", "k1", "k2", "sig"],
                )

    return run


def _emit_keys(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, COMPONENTS)
                keys = chunk_keys(sigs, chunks)
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), COMPONENTS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "rep"])

    return run


def _distances(own: np.ndarray, most: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of `own` (or of a row of own and one of other) that differ in at most `most` components, and in how many."""
    rows, cols, apart = [], [], []
    for k in range(0, len(own), 64):
        d = (own[k : k + 64, None, :] != (own[None, k:, :] if other is None else other[None])).sum(axis=2, dtype=np.uint8)
        x, y = np.nonzero(d <= most)
        d = d[x, y]
        if other is None:
            later = y > x
            x, y, d = x[later], y[later] + k, d[later]
        rows.append(x + k)
        cols.append(y)
        apart.append(d)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(apart)


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The links of a least spanning forest of n nodes (as positions), by rounds in which every tree takes its best link."""
    order = np.argsort(weight, kind="stable")
    a, b = a[order], b[order]
    label, live, keep = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return order[np.concatenate(keep)]
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[live]], live)
        np.minimum.at(best, label[b[live]], live)
        chosen = np.unique(best[best < len(a)])
        keep.append(chosen)
        label = least_labels(n, label[a[chosen]], label[b[chosen]])[label]


def _close_signatures(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block pair of a bucket, a least spanning forest of the pairs within radius; of these the task's spanning
        forest, as the buckets of a group share most links."""
        forest = Forest()
        for table, starts in whole_groups(batches, ["key", "lo", "hi"]):
            reps = table["rep"].to_numpy()
            sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, COMPONENTS)
            size = np.diff(starts)
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
            two = starts[:-1][size == 2]
            for k in range(0, len(two), 8192):
                t = two[k : k + 8192]
                apart = (sigs[t] != sigs[t + 1]).sum(axis=1, dtype=np.uint8)
                near = apart <= radius
                out.append((reps[t[near]], reps[t[near] + 1], apart[near]))
            for g in np.flatnonzero(size > 2):
                own, ids = sigs[starts[g] : starts[g + 1]], reps[starts[g] : starts[g + 1]]
                x, y, apart = _distances(own, radius)
                best = spanning(len(ids), x, y, apart)
                out.append((ids[x[best]], ids[y[best]], apart[best]))
            a, b, apart = (np.concatenate(v) for v in zip(*out))
            new = forest.new(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[new], pa.int64()), pa.array(b[new], pa.int64()), pa.array(apart[new], pa.int32())], ["a", "b", "apart"])

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                sets = shingle_sets(part.column(1), words)
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                values = pa.array(np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["rep", "set"])

    return run


def _groups_in(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Row numbers and signatures of each group of a table."""
    sigs = table["sig"]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield np.arange(a, b), np.frombuffer(b"".join(sigs.slice(a, b - a).to_pylist()), np.uint16).reshape(-1, COMPONENTS)


def _undecided(numerator: int, denominator: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block pair of a candidate group: the members with a close signature outside their component, of a size that may do."""
        for table, starts in whole_groups(batches, ["grp", "lo", "hi"]):
            reps, labels, sizes = (table[c].to_numpy() for c in ("rep", "label", "n"))
            found = [np.zeros(0, np.int64)]
            for at, sig in _groups_in(table, starts):
                x, y, _ = _distances(sig, radius)
                x, y = at[x], at[y]
                short, long = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
                may = (labels[x] != labels[y]) & (short * denominator >= numerator * long)
                found.append(reps[np.unique(np.concatenate([x[may], y[may]]))])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)), pa.int64())], ["rep"])

    return run


def _confirm(numerator: int, denominator: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block pair of a candidate group: links between the components known so far whose full sets are similar."""
        for table, starts in whole_groups(batches, ["grp", "lo", "hi"]):
            reps, labels, column = table["rep"].to_numpy(), table["label"].to_numpy(), table["set"].combine_chunks()
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            out_a, out_b = [], []
            for at, sig in _groups_in(table, starts):
                _, label = np.unique(labels[at], return_inverse=True)
                label = label.tolist()
                up = list(range(len(at)))

                def root(x: int) -> int:
                    x = label[x]
                    while up[x] != x:
                        up[x] = up[up[x]]
                        x = up[x]
                    return x

                x, y, apart = _distances(sig, radius)
                order = np.argsort(apart, kind="stable")  # the nearest first: the rest of their group needs no test
                for i, j in zip(x[order].tolist(), y[order].tolist()):
                    ri, rj = root(i), root(j)
                    if ri == rj:
                        continue
                    s, t = (values[ends[at[k]] : ends[at[k] + 1]] for k in (i, j))
                    short, long = (len(s), len(t)) if len(s) < len(t) else (len(t), len(s))
                    if short * denominator < numerator * long:
                        continue
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if common * denominator >= numerator * (len(s) + len(t) - common):
                        up[max(ri, rj)] = min(ri, rj)
                        out_a.append(reps[at[i]])
                        out_b.append(reps[at[j]])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _with_set(links: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    """Links with the set of one end. The links of a node in many are dealt to several copies of its set."""
    many = links.groupBy(end).agg(F.ceil(F.count("*") / F.lit(LINKS_A_COPY)).cast("int").alias("copies")).where("copies > 1")
    one = F.coalesce("copies", F.lit(1))
    left = links.join(many, end, "left").withColumn("copy", F.pmod(F.xxhash64(other), one.cast("long")).cast("int")).drop("copies")
    right = sets.select(F.col("rep").alias(end), F.col("set").alias(f"set_{end}")).join(many, end, "left")
    return left.join(right.withColumn("copy", F.explode(F.sequence(F.lit(0), one - 1))).drop("copies"), [end, "copy"]).drop("copy")


def _similar(links: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The links (a, b) whose full sets are similar."""
    both = _with_set(_with_set(links, sets, "a", "b"), sets, "b", "a")
    both = both.select("a", "b", F.size("set_a").alias("x"), F.size("set_b").alias("y"), F.size(F.array_intersect("set_a", "set_b")).alias("c"))
    return both.where(f"c * {denominator}L >= {numerator}L * (x + y - c)").select("a", "b")


def _block_pairs(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows of groups dealt to blocks by a hash, each row once for every pair of blocks it belongs to: lo, hi."""
    df = df.withColumn("nb", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("rep", key), F.col("nb").cast("long")).cast("int"))
    others = F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: x != F.col("own")))
    df = df.withColumn("other", F.explode(others))
    df = df.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("nb", "own", "other")
    return df.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    threshold: tuple[int, int] = (80, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Group near-duplicate documents.

    docs: any columns; only id_col (long) and text_col are read. Words are runs of characters other
    than ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of `words`
    words, or the whole sequence where it is shorter. Documents are linked where the intersection is
    at least threshold (numerator, denominator) of the union.

    Returns one row per row of docs: id_col, n_shingles long, component_id long (least id reachable over
    links, itself included) and kept boolean (id = component_id). Null, empty and wordless texts
    have no shingles and link with nothing. Rows of one id count as one document. A null id takes no
    part: null component, kept. Texts of any length; ties need no rule; empty input gives an empty result.

    Equal sets are one class from the start, so copies are never paired. Of each class one row emits a
    key per chunk and left-out component; buckets of equal keys hold every pair of signatures that
    differ in at most a radius of the COMPONENTS components (a pair of just the threshold's similarity
    exceeds it about once in 100,000). Large buckets are compared in pairs of fixed-size blocks, and of the close
    pairs a spanning forest gives the candidate groups. Full sets confirm links: first each class with its closest
    one, two sets a link. Only groups that this leaves in several components go on: signatures alone
    show which members still have a close one in another component, and the sets of these are compared in pairs of
    blocks of bounded rows and bytes.
    """
    chunks = chunks_for(threshold[0] / threshold[1])
    radius = 2 * chunks - 1
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    about = written(d.mapInArrow(_describe(words), "id long, n long, k1 long, k2 long, sig binary"), "minhash")
    some = about.where("n > 0 and id is not null")
    classes = written(some.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.count("*").alias("copies")), "minhash-classes")
    keys = classes.select("rep", "sig").mapInArrow(_emit_keys(chunks), "key long, rep long")
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("low"), F.bit_xor(F.xxhash64("rep")).alias("print")).where("size > 1")
    # Buckets with the same members are looked at once.
    shared = shared.groupBy("size", "low", "print").agg(F.min("key").alias("key")).select("key", "size")
    members = keys.join(shared, "key").join(classes.select("rep", "sig"), "rep")
    members = _block_pairs(members, "key", F.ceil(F.col("size") / F.lit(BUCKET_BLOCK)))
    close = members.select("key", "lo", "hi", "rep", "sig").mapInArrow(_close_signatures(radius), "a long, b long, apart int")
    close = written(close, "minhash-close")
    n = 2 * close.count()  # no more nodes have links than links have ends
    groups = components(close, "minhash-close")
    part = groups.join(classes.select(F.col("rep").alias("node"), "sig", "n"), "node").select(F.col("node").alias("rep"), F.col("root").alias("grp"), "sig", "n")
    part = written(part, "minhash-candidates", n)
    # Texts of other documents are sieved out before the join; it is a merge join at every size.
    texts = sieve(d, ["id"], part, ["rep"])[0].join(part.select(F.col("rep").alias("id")).hint("merge"), "id").dropDuplicates(["id"])
    sets = written(texts.select("id", "text").mapInArrow(_full_sets(words), "rep long, set array<long>"), "minhash-sets")
    ends = close.select("a", "b", "apart").union(close.select("b", "a", "apart"))
    best = ends.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    best = written(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "minhash-best", n)
    links = written(_similar(best, sets, *threshold), "minhash-links", n)
    roots = components(links, "minhash-known")
    part = part.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "grp", "sig", "n", F.coalesce("root", "rep").alias("label"))
    left = part.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high").select("grp", "size")
    rest = written(part.join(left, "grp"), "minhash-open", n)
    if not rest.isEmpty():
        asked = _block_pairs(rest, "grp", F.ceil(F.col("size") / F.lit(BUCKET_BLOCK))).select("grp", "lo", "hi", "rep", "label", "n", "sig")
        rest = rest.drop("size").join(asked.mapInArrow(_undecided(*threshold, radius), "rep long").distinct(), "rep")
        rest = written(rest, "minhash-undecided", n)
        sizes = rest.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / F.lit(VERIFY_BLOCK)), F.ceil(F.sum("n") / F.lit(VERIFY_SHINGLES))).alias("blocks"))
        rest = _block_pairs(rest.join(sizes, "grp").join(sets, "rep"), "grp", F.col("blocks"))
        more = rest.select("grp", "lo", "hi", "rep", "label", "sig", "set").mapInArrow(_confirm(*threshold, radius), "a long, b long")
        roots = components(links.union(more), "minhash-links")
    rows = about.select("id", "n", "k1", "k2")
    # A class of over a thousandth of all rows is one of less than a thousand, and they are broadcast; the others don't skew a join.
    total = classes.agg(F.sum("copies").alias("n")).first()["n"] or 0
    roots = roots.withColumnRenamed("node", "rep")
    of_class = lambda c: c.select("k1", "k2", "rep").join(roots, "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("component"))
    hot = F.broadcast(of_class(classes.where(F.col("copies") * 1000 > total)))
    cold = of_class(classes.where(F.col("copies") * 1000 <= total))
    own = ["id", "n", "component"]
    out = rows.join(hot, ["k1", "k2"]).select(*own).union(rows.join(hot, ["k1", "k2"], "left_anti").join(cold, ["k1", "k2"], "left").select(*own))
    component = F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("id"))
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), component))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
