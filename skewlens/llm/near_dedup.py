"""Near-duplicate classes by ProbMinHash, banding and exact verification.

1. Each text's five-word shingles, weighted by how often they occur, get a ProbMinHash signature: every
   shingle is a Poisson process of arrivals with its weight as rate, each arrival falls into one register,
   a register keeps the shingle of its first arrival, and a process ends once its next arrival is later than
   every register's.  Two signatures agree in a register with probability J_P, the probability Jaccard.
2. Texts with equal weighted shingles form a copy class, and one of them represents it from here on.
3. Representatives that agree in all registers of a band share a bucket.  Each is first compared with one leader,
   the smallest copy hash that leads one of its buckets, and then with the other leaders (a bucket's smallest and
   largest copy hash) that are still in another class; never all with all.
4. Candidates are verified by the exact J_P >= 0.8 of their whole texts; connected components of verified links
   are classes.
5. Where a bucket's members besides its leaders are still in several classes, those outside the most frequent class are compared
   with those of other classes, in tasks of two blocks of texts each.  A task links classes as it goes and returns only the links
   that joined two: no rows of pairs are made.  So every pair that shares a bucket is either in one class, or was found to
   differ (exactly, or by an upper bound of its J_P), or its estimated J_P lies 4.6 standard errors and more below 0.8.

With 20 bands of 6 registers a pair of similarity s shares a bucket with probability 1 - (1 - s^6)^20:
0.9977 at 0.8, 0.99992 at 0.85.

Defined results: null counts as empty; a text without words is in a class of its own, the id alone; a text of one to
four words has one shingle; the class id is the smallest id in it; rows that
repeat both id and text share their decision, and rows that repeat an id with another text are documents of their own; a null
id is never a class id unless all ids of the class are null; an empty table gives an empty result.  Extra columns may have any name except those beginning with ``__nd_``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.llm.common import cut, fresh, ship_package, text_of
from skewlens.llm.shingles import WordHashes, mixed, probability_jaccard, shingle_sets
from skewlens.operators.reduce import may_match

BANDS, ROWS = 20, 6
#: Registers beyond those of the bands serve the estimate only.
REGISTERS = 238
THRESHOLD = 0.8
#: Share of registers that must agree before an exact comparison across classes: an estimate of J_P, 4.6 standard errors below 0.8.
LEAST_AGREE = 0.68
#: Texts and characters of a block of a large bucket; a comparison holds two blocks.
BLOCK_TEXTS, BLOCK_CHARS = 256, 4_000_000
#: Characters of neighbouring texts that are sketched together, and words whose hashes a task remembers.
CHUNK, KNOWN = 1_500_000, 150_000


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(starts: np.ndarray, hashes: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """ProbMinHash of all texts at once: (texts, m) shingle hashes; texts without shingles have 0s."""
    n = len(starts) - 1
    best, owner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(starts))
    h, rate, time, step = hashes, counts.astype(float), np.zeros(len(hashes)), 0
    worst, open_ = np.full(n, np.inf), np.arange(n)
    with np.errstate(over="ignore"):
        while len(h):
            step += 1
            draw = mixed(h + np.uint64(step) * np.uint64(0xD6E8FEB86659FD93))
            time = time - np.log(_uniform(draw)) / rate
            worst[open_] = best.reshape(n, m)[open_].max(axis=1)
            alive = time < worst[doc]                                   # early termination
            doc, h, rate, time, draw = doc[alive], h[alive], rate[alive], time[alive], draw[alive]
            slot = doc * m + (mixed(draw) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, slot, time)
            won = time == best[slot]
            owner[slot[won]] = h[won]
            if not step % 8:
                open_ = np.unique(doc)
    return owner.reshape(n, m)


def band_hashes(owner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket per band; the band's number is part of it."""
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(owner), 1))
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mixed(out * np.uint64(0x100000001B3) + owner[:, j * bands:(j + 1) * bands])
    return out.astype(np.int64)


def _registers(bands: int, rows: int, registers: int = REGISTERS) -> int:
    return -(-max(registers, bands * rows) // 7) * 7


def _packed(registers: np.ndarray) -> np.ndarray:
    """Bytes, seven to a long, as many longs as it takes (m is a multiple of seven, so none is half full)."""
    n, m = registers.shape
    full = np.zeros((n, -(-m // 7) * 7), np.int64)
    full[:, :m] = registers
    return full.reshape(n, -1, 7) @ (np.int64(1) << (8 * np.arange(7, dtype=np.int64)))


def _stretches(texts: pa.Array, most: int):
    """(place of the first, texts) of neighbouring texts, of about ``most`` characters each."""
    first, held, size = 0, [], 0
    for i in range(len(texts)):
        held.append(texts[i].as_py())
        size += len(held[-1])
        if size >= most or i == len(texts) - 1:
            yield first, held
            first, held, size = i + 1, [], 0


def sketch(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS,
           registers: int = REGISTERS) -> DataFrame:
    """(__nd_id, __nd_key, copy, sig, buckets), one row per document.

    __nd_key tells texts of one id apart; copy is a 128-bit hash of the weighted shingles (null: no words); sig has
    8 bits of each register, seven registers to a long.
    """
    m = _registers(bands, rows, registers)

    def done(ids, keys, texts, known):
        starts, h, c = shingle_sets(texts, known)
        owner = signatures(starts, h, c, m)
        with np.errstate(over="ignore"):
            sums = []
            for i in (3, 5):
                each = mixed(h * np.uint64(i) + c.astype(np.uint64) * np.uint64(0x9E3779B1))
                upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
                sums.append(upto[starts[1:]] - upto[starts[:-1]])
        copy, short = np.stack(sums, axis=1), _packed((owner >> np.uint64(56)).astype(np.int64))
        empty = np.diff(starts) == 0
        longs = lambda table: pa.array([None if e else r for r, e in zip(table, empty)], pa.list_(pa.int64()))
        copies = pa.array([None if e else r.tobytes() for r, e in zip(copy, empty)], pa.binary())
        return pa.RecordBatch.from_arrays([ids, keys, copies, longs(short), longs(band_hashes(owner, bands, rows))],
                                          ["__nd_id", "__nd_key", "copy", "sig", "buckets"])

    def run(batches):
        known = WordHashes(KNOWN)
        for batch in fresh(batches, known):
            ids, keys, texts = batch.columns
            for first, held in _stretches(texts, CHUNK):
                yield done(ids.slice(first, len(held)), keys.slice(first, len(held)), held, known)

    ship_package(docs.sparkSession)
    used = docs.select(F.col(id_col).cast("long").alias("__nd_id"), _key(text_col), text_of(text_col).alias("text"))
    return used.mapInArrow(run, "__nd_id bigint, __nd_key bigint, copy binary, sig array<bigint>, buckets array<bigint>")


def _key(text_col: str):
    return F.xxhash64(text_of(text_col)).alias("__nd_key")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold.  A leader's partition may be hot; both sides are exchanges,
    so AQE can split it."""
    def run(batches):
        known = WordHashes(KNOWN)
        for batch in fresh(batches, known):
            keep, last, right = [], None, None
            for i in range(batch.num_rows):
                if (b := batch.column(1)[i].as_py()) != last:
                    last, right = b, shingle_sets([batch.column(3)[i].as_py()], known)[1:]
                left = shingle_sets([batch.column(2)[i].as_py()], known)[1:]
                keep.append(probability_jaccard(*left, *right) >= threshold)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the smallest node of its component.

    Minimum labels travel along the links and jump to the label of their label; the rounds grow with the
    logarithm of the longest path, and each is cut.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), "edges")
    label = cut(both.groupBy("node").agg(F.min("other").alias("least"))
                    .select("node", F.least("least", "node").alias("label")), "labels")
    while True:
        near = both.join(label.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        low = cut(label.join(near, "node").select("node", "label", F.least("label", "near").alias("low")), "low")
        jump = low.join(low.select(F.col("node").alias("low"), F.col("low").alias("lower")), "low", "left")
        after = cut(jump.select("node", "label", F.least("low", "lower").alias("next")), "labels")
        label = after.select("node", F.col("next").alias("label"))
        if not after.where("label != next").limit(1).count():
            return label


def _joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """The labels after further links (a, b): components of the labels themselves, a far smaller graph."""
    for side in ("a", "b"):
        more = more.join(label.toDF(side, f"label_{side}"), side, "left")
    ends = cut(more.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")), "ends")
    whole = components(ends).toDF("label", "whole")
    known = label.join(whole, "label", "left").select("node", F.coalesce("whole", "label").alias("label"))
    return cut(known.unionByName(whole.toDF("node", "label").join(label.select("node"), "node", "left_anti")), "labels")


def _new_links(copies: list[bytes], labels: list[bytes], sig: np.ndarray, buckets: np.ndarray, block: np.ndarray,
               texts: list[str], bucket: int, threshold: float) -> list[tuple[bytes, bytes]]:
    """Verified links between members of one bucket that join all classes linked there: fewer than there are classes.

    Members of one block are compared with each other, those of two blocks with those of the other block.  Of each text's
    rivals (in another class by now, enough equal registers, the bucket the first that both share) the exact J_P is needed only
    where its upper bound reaches the threshold: common shingles of equal weights w count w / sum of max, as they do in
    J_P, others the smaller of the two shares.
    """
    starts, h, c = shingle_sets(texts, WordHashes(KNOWN))
    shingle, place = np.unique(h, return_inverse=True)
    root, sizes, total = np.unique(labels, return_inverse=True)[1], np.diff(starts), np.add.reduceat(c, starts[:-1])
    weight, links, crossed = np.zeros(len(shingle)), [], block.min() != block.max()
    for x in range(len(texts)):
        y = np.flatnonzero((root != root[x]) & ((block > block[x]) if crossed else (np.arange(len(texts)) > x)))
        y = y[(sig[y] == sig[x]).sum(axis=1) >= LEAST_AGREE * sig.shape[1]]
        y = y[buckets[x][(buckets[y] == buckets[x]).argmax(axis=1)] == bucket]
        if not len(y):
            continue
        mine, first = slice(starts[x], starts[x + 1]), np.cumsum(sizes[y]) - sizes[y]
        at = np.repeat(starts[y] - first, sizes[y]) + np.arange(sizes[y].sum())
        weight[place[mine]] = c[mine]
        own, its = weight[place[at]], c[at]
        weight[place[mine]] = 0
        most = total[x] + total[y] - np.add.reduceat(np.minimum(own, its), first)
        share = np.where(own == its, 0, np.minimum(own / total[x], its / np.repeat(total[y], sizes[y])))
        bound = np.add.reduceat(np.where(own == its, its, 0), first) / most + np.add.reduceat(share, first)
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < threshold - 1e-9:
                break
            if root[z := y[k]] != root[x]:
                its = slice(starts[z], starts[z + 1])
                if probability_jaccard(h[mine], c[mine], h[its], c[its]) >= threshold:
                    links.append((max(copies[x], copies[z]), min(copies[x], copies[z])))
                    root[root == root[z]] = root[x]
    return links


def _across(placed: DataFrame, reps: DataFrame, texts: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, one, two, block, copy, label, sig, buckets, text): members of buckets that hold several classes, dealt to comparisons.

    The leaders were compared with all members before, so they are not among them.  What is left of a larger bucket is dealt
    into blocks, those of its most frequent class apart; comparison (one, two) is that of two blocks, and there is none of two of
    the most frequent class, so a bucket of one large class costs nothing.
    """
    size = texts.select("copy", (F.length("text") / BLOCK_CHARS + 1 / BLOCK_TEXTS).alias("part"))
    inside = placed.where("copy != first and copy != last").select("bucket", "copy").join(
        label.withColumnRenamed("node", "copy"), "copy", "left").join(size, "copy")
    inside = cut(inside.select("bucket", "copy", "part", F.coalesce("label", "copy").alias("label")), "inside")
    most = inside.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("part").alias("part")).groupBy("bucket").agg(
        F.max_by("label", F.struct("n", "label")).alias("most"), F.max_by("part", F.struct("n", "label")).alias("largest"),
        F.sum("part").alias("parts"), F.count("*").alias("classes")).where("classes > 1")
    blocks = [F.expr(x).alias(name) for name, x in (
        ("few", "if(parts <= 1, 1, greatest(1, ceil(parts - largest)))"),
        ("blocks", "if(parts <= 1, 1, greatest(1, ceil(parts - largest)) + ceil(largest))"))]
    most = cut(most.select("bucket", "most", *blocks), "open")
    dealt = F.expr("if(label != most or blocks = few, pmod(xxhash64(copy), few), few + pmod(xxhash64(copy), blocks - few))")
    open_ = inside.join(most, "bucket").withColumn("block", dealt)
    open_ = open_.withColumn("other", F.explode(F.expr("sequence(0L, if(block < few, blocks, few) - 1)")))
    open_ = open_.select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                         "block", "copy", "label")
    return open_.join(reps.select("copy", "sig", "buckets"), "copy").join(texts, "copy").select(
        "bucket", "one", "two", "block", "copy", "label", "sig", "buckets", "text")


def _linked_across(dealt: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b) that join the classes of each comparison of :func:`_across`."""
    def run(group: pa.Table) -> pa.Table:
        bucket, one, two, block, copies, labels, sig, buckets, texts = (x.combine_chunks() for x in group.columns)
        block, links = block.to_numpy(), []
        if one[0].as_py() == two[0].as_py() or block.min() != block.max():
            n = len(block)
            bytes_ = sig.flatten().to_numpy().reshape(n, -1, 1).view(np.uint8)[:, :, :7].reshape(n, -1)
            links = _new_links(copies.to_pylist(), labels.to_pylist(), bytes_, buckets.flatten().to_numpy().reshape(n, -1), block,
                               texts.to_pylist(), bucket[0].as_py(), threshold)
        return pa.table([pa.array(x, pa.binary()) for x in (zip(*links) if links else ([], []))], ["a", "b"])

    return dealt.groupBy("bucket", "one", "two").applyInArrow(run, "a binary, b binary").distinct()


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) that are in different classes."""
    for side in ("a", "b"):
        pairs = pairs.join(label.toDF(side, f"label_{side}"), side, "left")
    return cut(pairs.where("coalesce(label_a, a) != coalesce(label_b, b)").select("a", "b"), "apart")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int) -> DataFrame:
    """(__nd_id, __nd_key, class_id, class_size), one row per document."""
    ids = cut(sketch(docs, id_col, text_col, bands, rows), "sketch")
    reps = cut(ids.where("copy is not null").groupBy("copy")
                  .agg(F.min("__nd_id").alias("id"), F.min(F.struct("__nd_id", "__nd_key")).alias("row"),
                       F.count("*").alias("n"), F.min(F.struct("sig", "buckets")).alias("s"))
                  .select("copy", "id", "row", "n", "s.*"), "copies")
    member = cut(reps.select("copy", F.explode("buckets").alias("bucket")), "buckets")
    shared = cut(member.groupBy("bucket").agg(F.min("copy").alias("first"), F.max("copy").alias("last"))
                       .where("first != last"), "shared")
    placed = cut(member.join(shared, "bucket"), "placed")
    star = placed.select("copy", F.explode(F.array("first", "last")).alias("lead")).where("copy != lead")
    star = cut(star.select(F.greatest("copy", "lead").alias("a"), F.least("copy", "lead").alias("b")).distinct(), "star")
    # One text per representative that shares a bucket.  The others go before the texts are shuffled (a few pass, if a
    # Bloom filter has to take the place of the list).
    owner = cut(reps.join(placed.select("copy").distinct(), "copy", "left_semi").select("copy", "row.*"), "owner")
    again = docs.select(F.col(id_col).cast("long").alias("__nd_i"), _key(text_col).alias("__nd_k"), text_of(text_col).alias("text"))
    again = may_match(again, owner.select(F.col("__nd_key").alias("__nd_k")), ["__nd_k"])
    texts = owner.join(again, owner["__nd_id"].eqNullSafe(again["__nd_i"]) & (owner["__nd_key"] == again["__nd_k"]))
    texts = cut(texts.groupBy("copy").agg(F.max("text").alias("text")), "texts")
    own = placed.groupBy("copy").agg(F.min("first").alias("lead")).where("copy != lead")
    own = cut(own.select(F.greatest("copy", "lead").alias("a"), F.least("copy", "lead").alias("b")), "leaders")
    links = cut(_verified(own, texts, threshold), "links")
    label = links.toDF("node", "label")                     # a leader is the smaller of the two
    apart = _apart(star.join(own, ["a", "b"], "left_anti"), label)
    links = cut(links.union(_verified(apart, texts, threshold)), "links")
    label = components(links)
    more = cut(_linked_across(_across(placed, reps, texts, label), threshold), "links")
    if more.limit(1).count():
        label = _joined(label, more)
    named = cut(reps.select("copy", "id", "n").join(label.withColumnRenamed("node", "copy"), "copy", "left")
                    .select("copy", "id", "n", F.coalesce("label", "copy").alias("label")), "named")
    whole = cut(named.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size")), "classes")
    named = cut(named.join(whole, "label").select("copy", "class_id", "class_size"), "named")
    of_copy = ids.where("copy is not null").select("__nd_id", "__nd_key", "copy").join(named, "copy").drop("copy")
    bare = ids.where("copy is null").select("__nd_id", "__nd_key", F.col("__nd_id").alias("class_id"),
                                            F.lit(1).cast("long").alias("class_size"))
    return of_copy.unionByName(bare)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: the id, class_id, class_size, kept (its id is the class's smallest)."""
    return _classes(docs, id_col, text_col, threshold, bands, rows).select(
        F.col("__nd_id").alias(id_col), "class_id", "class_size",
        F.col("__nd_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One document of each class, with all its columns."""
    gone = _classes(docs, id_col, text_col, threshold, bands, rows).where("not (__nd_id <=> class_id)")
    gone = gone.select(F.col("__nd_id").alias("__nd_gone"), F.col("__nd_key").alias("__nd_gone_key")).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__nd_gone")) & (_key(text_col) == F.col("__nd_gone_key")), "left_anti")
