"""N-gram Jaccard join by signature trees.

A document is the set of hashes of its distinct word n-grams. The upper levels of the tree are keyed and so can be
dealt out: a size range (band), then one of k hash ranges of the token space with the content that a set has there.
Sets of a band differ in at most d tokens when they link, so if more than d of a set's ranges hold enough tokens to
count, some range that counts is the same in both: every linking pair meets below some key. Below the keys a
signature is the bitmap of a set's tokens, with its size. A node holds the OR of the bitmaps below and their size
range, and a dual traversal drops node pairs whose greatest possible overlap is below the least that any pair of
their sizes needs. Sets that may link after that make blocks, which are small or hold near copies. The lower levels,
a tree for each cell of a block, go through the same traversal, and what is left is compared token by token.

Blocks larger than a cell are dealt into cells: first each cell is joined with itself, then a few sets of each large
class, and last the sets outside a block's largest class meet every cell. Pairs inside one class are linked already
and aren't compared, so a large group of near copies costs about its own size.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievework.llm.common import FOLD, Scratch, arrow_batches, small
from sievework.llm.components import components

U = np.uint64
#: Sets and tokens that a cell holds at most (a single longer set has a cell of its own hash).
CELL, CELL_TOKENS = 512, 1_000_000
LEAST_NODE = 8
#: Sets below one key that are compared by signature; larger groups go on as they are.
GROUP = 2048


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x + U(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words, but not none, has one: its whole sequence."""
    with np.errstate(over="ignore"):
        docs = [t.translate(FOLD).split() if t else [] for t in texts]
        sizes = [len(d) for d in docs]
        h = mix(np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(docs)), U, sum(sizes)))
        count = max(0, len(h) - n + 1)
        grams = np.zeros(count, U)
        for k in range(n):
            grams = grams * U(0xD6E8FEB86659FD93) + h[k : k + count]
        grams = mix(grams, n)
        out, at = [], 0
        for m in sizes:
            if m >= n:
                out.append(np.unique(grams[at : at + m - n + 1]))
            elif m:
                short = U(0)
                for x in h[at : at + m]:
                    short = short * U(0xD6E8FEB86659FD93) + x
                out.append(mix(np.array([short], U), 1000 + m))
            else:
                out.append(np.zeros(0, U))
            at += m
        return out


def band_edges(least: int, num: int, den: int, most: int = 1 << 31) -> np.ndarray:
    """Bands a little wider than the ratio of linked sizes, so that a partner lies in the next band at most."""
    edges = [least]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * den * 27 // (num * 25))))
    return np.array(edges)


class Keys:
    """The keys of a set under which it meets every set that it may link with, num/den being the least similarity.

    Of linked sets the smaller, with s tokens, differs from the other in at most s * (den - num) / num tokens; a band
    takes d from its largest s. Each difference spoils one range at most. So if more than d ranges of either set hold
    t tokens or more, one of those is the same in both. The first level has the largest t, up to 3, for which a
    set of the band is likely to have so many ranges; a set that hasn't goes on to levels with t = 1 and more ranges,
    until it has. A partner that stops later gives the keys of the earlier levels as well, so they meet at the
    earlier of the two."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        least = -(-num // (den - num))  # smaller sets link with equal ones only
        self.edges = band_edges(least, num, den)
        self.known: dict[int, list[tuple[int, int, int]]] = {}

    def levels(self, band: int) -> list[tuple[int, int, int]]:
        """(d, k, t) of each level of a band: differences, ranges, tokens that a range needs to count."""
        if band in self.known:
            return self.known[band]
        d = (int(self.edges[band + 1]) - 1) * (self.den - self.num) // self.num
        low = int(self.edges[band])
        first = (d, d + (low + 1) // 2, 1)
        for t in (1, 2, 3):
            for k in sorted({int(np.ceil(low / a)) for a in np.arange(1, 8, 0.1)}, reverse=True):
                a = low / k
                fewer = float(np.exp(-a) * sum(a**j / float(np.prod(np.arange(1, j + 1))) for j in range(t)))
                if k * (1 - fewer) - 2.5 * np.sqrt(k * fewer * (1 - fewer)) > d:
                    first = (d, k, t)  # of the levels that the smallest set will do with, the last: most tokens, fewest ranges
        more = [(d, (d + (low + 1) // 2) << j, 1) for j in range(40)]
        self.known[band] = [first, *more]
        return self.known[band]

    def of(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if n < self.edges[0]:
            return np.zeros(0, U)
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        bands = [own]
        if own and self.num * n <= self.den * (int(self.edges[own]) - 1):
            bands.append(own - 1)
        high, mixed, out = s >> U(32), mix(s, 7), []
        for b in bands:
            for d, k, t in self.levels(b):
                cell = (high * U(k)) >> U(32)
                first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                good = np.diff(np.r_[first, n]) >= t
                out.append((mix(np.add.reduceat(mixed, first) ^ mix(cell[first], b * 1_000_003 + k * 7 + t)))[good])
                if np.count_nonzero(good) > d:
                    break
        return np.concatenate(out)


def width_of(n: int) -> int:
    """Bits of a set's signature: a power of two, at least the tokens and 64, at most 2^16."""
    return min(1 << 16, max(64, 1 << max(0, n - 1).bit_length()))


def signature(s: np.ndarray) -> bytes:
    """Bitmap of a set's tokens, one bit for each by its lowest hash bits."""
    flags = np.zeros(width_of(len(s)), np.uint8)
    flags[(s & U(len(flags) - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """A signature as words, its halves laid over each other down to width bits."""
    w = np.frombuffer(bits, U)
    while len(w) * 64 > width:
        w = w[: len(w) // 2] | w[len(w) // 2 :]
    return w


def _describe(n: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                sets = shingle_sets(b.column(1).cast(pa.binary()).to_pylist(), n)
                digest = [[np.add.reduce(mix(s, salt)) if len(s) else U(0) for s in sets] for salt in (11, 12)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array(d, U).view(np.int64)) for d in digest), pa.array([signature(s) for s in sets], pa.binary())], ["doc_id", "th", "n", "d1", "d2", "bits"])

    return run


def _keys(n: int, num: int, den: int):
    """A row for each set and key."""

    def run(batches):
        keys = Keys(num, den)
        with np.errstate(over="ignore"):
            for b in batches:
                found = [keys.of(s) for s in shingle_sets(b.column(1).cast(pa.binary()).to_pylist(), n)]
                ids = np.repeat(b.column(0).to_numpy(), [len(k) for k in found])
                flat = np.concatenate([*found, np.zeros(0, U)]).view(np.int64)
                for lo in range(0, len(flat), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(flat[lo : lo + 200_000]), pa.array(ids[lo : lo + 200_000])], ["key", "set_id"])

    return run


def _shared(batches):
    """Of rows (key, set_id) sorted by key, those whose key has a neighbour with another set. Nothing but the row at a
    batch's end is held."""
    last = None  # key, set and whether the row is out already
    for b in batches:
        key, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(key):
            continue
        if last is not None:
            key, ids = np.r_[last[0], key], np.r_[last[1], ids]
        same = (key[1:] == key[:-1]) & (ids[1:] != ids[:-1])
        keep = np.r_[False, same] | np.r_[same, False]
        if last is not None and last[2]:
            keep[0] = False
        late = bool(keep[-1]) if len(key) > 1 else bool(last is not None and last[2])
        last = (key[-1], ids[-1], late)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(ids[keep])], ["key", "set_id"])


def _may_link(num: int, den: int):
    """Of rows (key, set_id, n, bits) that come key by key: edges that tie together what may link below a key."""

    def edges(rows: list) -> list[tuple[int, int]]:
        """Below a key every class hangs from its smallest id, so that keys with one smallest set give the same edges."""
        rows.sort()
        label = classes(rows)
        least: dict[int, int] = {}
        for k, r in zip(label, rows):
            least[k] = min(least.get(k, r[1]), r[1])
        return [(least[k], r[1]) for k, r in zip(label, rows) if r[1] != least[k]]

    def classes(rows: list) -> list[int]:
        width = min(len(r[2]) for r in rows) * 8
        if len(rows) > 24:
            i, j = Tree(np.stack([folded(r[2], width) for r in rows]), np.array([r[0] for r in rows])).pairs(num, den)
            label = np.arange(len(rows))
            while True:
                least = np.minimum(label[i], label[j])
                new = label.copy()
                np.minimum.at(new, i, least)
                np.minimum.at(new, j, least)
                new = new[new]
                if (new == label).all():
                    return label.tolist()
                label = new
        parent = list(range(len(rows)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        bits = [int.from_bytes(folded(r[2], width).tobytes(), "little") for r in rows]
        for j in range(len(rows)):
            for i in range(j):
                if (p := find(i)) != (q := find(j)):
                    a, b, x, y = rows[i][0], rows[j][0], bits[i], bits[j]
                    both = (x & y).bit_count()
                    most = both + min(a - x.bit_count(), b - y.bit_count())
                    if min(most, a - (x & ~y).bit_count(), b - (y & ~x).bit_count()) * (num + den) >= num * (a + b):
                        parent[max(p, q)] = min(p, q)
        return [find(x) for x in range(len(rows))]

    def run(batches):
        now, rows, out = None, [], []
        for b in batches:
            for key, i, n, bits in zip(*(b.column(c).to_pylist() for c in range(4))):
                if key != now:
                    out += edges(rows) if len(rows) > 1 else []
                    now, rows = key, []
                rows.append((n, i, bits))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                    out = []
        out += edges(rows) if len(rows) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def _ties(met: DataFrame, signatures: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """met (key, set_id), signatures (sid, n, bits) -> edges (a, b) between sets that may link. A key of more than GROUP
    sets never comes to one task: its sets stay together, tied to the smallest, and their cells are compared later."""
    crowds = met.groupBy("key").agg(F.count("*").alias("c"), F.min("set_id").alias("first")).where(F.col("c") > GROUP)
    crowds = scratch.keep(crowds.select(F.col("key").alias("ckey"), "first"), "crowds")
    few = small(crowds, 1_000_000)
    hung = met.join(few, F.col("key") == F.col("ckey")).where("set_id <> first").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    rest = met.join(few, F.col("key") == F.col("ckey"), "left_anti").join(signatures, F.col("set_id") == F.col("sid")).select("key", "set_id", "n", "bits")
    return rest.repartition("key").sortWithinPartitions("key", "set_id").mapInArrow(_may_link(num, den), "a long, b long").union(hung)


def _stars(ties: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, with the same components: every set hangs from its smallest neighbour, as do the others that
    it hung from. A set has one of those for each of its keys at most; over a group of near copies they are the same
    few, so that edges are about as many as sets."""
    smallest = ties.groupBy("b").agg(F.min("a").alias("m"), F.collect_set("a").alias("s"))
    ends = F.concat(F.array("b"), F.array_remove("s", F.col("m")))
    return smallest.select(F.col("m").alias("a"), F.explode(ends).alias("b")).distinct()


def _tokens(n: int):
    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(2).cast(pa.binary()).to_pylist(), n)
            offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["set_id", "at", "n", "tokens"])

    return run


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one width for the sets of a cell, four bits or more for each token of the largest."""
    width = 256
    while width < 4 * max(map(len, sets)) and width < 1 << 17:
        width *= 2
    bits = np.zeros((len(sets), width // 64), U)
    for i, s in enumerate(sets):
        at = s & U(width - 1)
        np.bitwise_or.at(bits[i], (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return bits


class Tree:
    """Signature tree: levels[0] has a node for each set, each further level one for every LEAST_NODE nodes below.
    bits: OR of bitmaps; lo, hi: size range; spare: most tokens beyond one for each bit."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        self.levels = [(bits, size, size, size - np.bitwise_count(bits).sum(1, dtype=np.int64))]
        while len(self.levels[-1][1]) > LEAST_NODE:
            bits, lo, hi, spare = self.levels[-1]
            cut = np.arange(0, len(lo), LEAST_NODE)
            self.levels.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(spare, cut)))

    def pairs(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs i < j that the bounds cannot rule out."""
        m = len(self.levels[-1][1])
        i, j = np.triu_indices(m)
        for at in range(len(self.levels) - 1, -1, -1):
            bits, lo, hi, spare = self.levels[at]
            if at == 0:
                keep = i < j
                i, j = i[keep], j[keep]
            # overlap / (a + b - overlap) >= num / den for sizes a >= lo, b >= lo
            need = -(-num * (lo[i] + lo[j]) // (num + den))
            keep = np.minimum(hi[i], hi[j]) >= need
            i, j, need = i[keep], j[keep], need[keep]
            most = np.empty(len(i), np.int64)
            step = max(1, (1 << 20) // bits.shape[1])
            for k in range(0, len(i), step):
                most[k : k + step] = np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(1, dtype=np.int64)
            keep = most + np.minimum(spare[i], spare[j]) >= need
            i, j = i[keep], j[keep]
            if at:
                below = len(self.levels[at - 1][1])
                grid = np.arange(LEAST_NODE)
                a = (i[:, None, None] * LEAST_NODE + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
                b = (j[:, None, None] * LEAST_NODE + grid[None, None, :] + 0 * grid[None, :, None]).ravel()
                keep = (a < below) & (b < below) & (a <= b)
                i, j = a[keep], b[keep]
        return i, j


def link_cell(ids: np.ndarray, comp: np.ndarray, probe: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that join what links in a cell: pairs of different classes, at least one of them a probe."""
    if len(sets) < 2:
        return []
    order = np.lexsort(([s[0] for s in sets], [len(s) for s in sets]))
    ids, comp, probe, sets = ids[order], comp[order], probe[order], [sets[k] for k in order]
    i, j = Tree(bitmaps(sets), np.array([len(s) for s in sets])).pairs(num, den)
    keep = (comp[i] != comp[j]) & (probe[i] | probe[j])
    i, j = i[keep], j[keep]
    if not len(i):
        return []
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]
    names, root = np.unique(comp, return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    token = np.split(token, ends[:-1])
    flag, edges = np.zeros(max(t.max() for t in token) + 1, bool), []
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(i)]):
        x, mine = int(i[a]), find(int(root[i[a]]))
        ys = [int(y) for y in j[a:b] if find(int(root[y])) != mine]
        if not ys:
            continue
        flag[token[x]] = True
        for y in ys:
            if (r := find(int(root[y]))) != (mine := find(mine)):
                both = int(np.count_nonzero(flag[token[y]]))
                if den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                    parent[max(r, mine)] = min(r, mine)
                    edges.append((int(ids[x]), int(ids[y])))
        flag[token[x]] = False
    return edges


def _link(num: int, den: int):
    """Cells come as runs of rows: block, cell, set_id, comp, probe, tokens."""

    def cells(batches):
        key, parts = None, []
        for b in batches:
            block, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero((block[1:] != block[:-1]) | (cell[1:] != cell[:-1])) + 1 if len(block) else []
            for lo, hi in zip(np.r_[0, cut].astype(int), np.r_[cut, len(block)].astype(int)):
                if lo < hi:
                    if (now := (block[lo], cell[lo])) != key and parts:
                        yield parts
                        parts = []
                    key = now
                    parts.append(b.slice(lo, hi - lo))
        if parts:
            yield parts

    def run(batches):
        a, b = [], []
        for parts in cells(batches):
            if sum(p.num_rows for p in parts) > 1:
                ids, comp, probe = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in (2, 3, 4))
                sets = [x.values.to_numpy().view(U) for p in parts for x in p.column(5)]
                for x, y in link_cell(ids, comp, probe, sets, num, den):
                    a.append(x)
                    b.append(y)
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def ngram_jaccard_join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, class_id (least doc_id with an equal set), component_id (least
    doc_id reachable by links of similarity num/den or more).

    Texts without words, null and empty ones included, have no shingles and link with nothing. A null doc_id links
    with nothing either and has null class and component. Rows that repeat a doc_id are one node that holds all their
    sets; each row keeps its own n_shingles. Ties do not arise: the least id names a class. Other columns are ignored,
    whatever their names. An empty table gives an empty result."""
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    described = scratch.keep(texts.select("doc_id", "text", "th").mapInArrow(_describe(n), "doc_id long, th long, n long, d1 long, d2 long, bits binary"), "described")
    full = described.where("n > 0 and doc_id is not null")
    copies = scratch.keep(full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("c")).where("c > 1").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("en"), "set_id"), "copies")
    same = (described.d1 == copies.e1) & (described.d2 == copies.e2) & (described.n == copies.en) & described.doc_id.isNotNull()
    slim = scratch.keep(described.join(small(copies, 1_000_000), same, "left").select("doc_id", "th", "n", F.coalesce("set_id", "doc_id").alias("class_id")), "slim")
    signatures = described.where("n > 0").select(F.col("doc_id").alias("sid"), "n", "bits").dropDuplicates(["sid", "n", "bits"])

    # one shuffle brings a key's sets together; most keys have one set and end here
    spare = slim.where("doc_id <> class_id").select(F.col("doc_id").alias("x"), F.col("th").alias("xth")).distinct()
    firsts = texts.where("doc_id is not null").join(small(spare, 1_000_000), (F.col("doc_id") == F.col("x")) & F.col("th").eqNullSafe(F.col("xth")), "left_anti")
    keyed = firsts.select("doc_id", "text").mapInArrow(_keys(n, num, den), "key long, set_id long").repartition("key").sortWithinPartitions("key", "set_id")
    met = scratch.keep(keyed.mapInArrow(_shared, "key long, set_id long").distinct(), "met")
    ties = scratch.keep(_stars(_ties(met, small(signatures, 200_000), num, den, scratch)), "ties")
    blocks = components(ties, scratch)
    scratch.drop(described, copies, met)

    sized = blocks.join(slim.where("doc_id = class_id").groupBy("doc_id").agg(F.max("n").alias("n")), F.col("id") == F.col("doc_id"))
    cells = F.greatest(F.ceil(F.count("*") / cell), F.ceil(F.sum("n") / CELL_TOKENS)).cast("long")
    sizes = scratch.keep(sized.groupBy("label").agg(cells.alias("cells")).where("cells > 1").withColumnRenamed("label", "b"), "sizes")
    wanted = blocks.join(small(sizes, 1_000_000), F.col("label") == F.col("b"), "left")
    wanted = scratch.keep(wanted.select("id", F.col("label").alias("block"), F.coalesce("cells", F.lit(1)).alias("cells")), "wanted")
    joined = lambda df: df.select("block", "cell", "set_id", "comp", "probe", "tokens").repartition("block", "cell").sortWithinPartitions("block", "cell").mapInArrow(_link(num, den), "a long, b long")

    def taken(some: DataFrame) -> DataFrame:
        found = texts.select("doc_id", "text").join(small(some, 1_000_000), F.col("doc_id") == F.col("id")).select("id", F.struct("block", "cells").alias("at"), "text")
        found = found.mapInArrow(_tokens(n), "set_id long, at struct<block:long,cells:long>, n long, tokens array<long>").where("n > 0")
        return found.select("at.block", "at.cells", "set_id", "tokens").withColumn("cell", F.pmod(F.xxhash64("set_id"), "cells"))

    dealt = taken(wanted)
    edges = scratch.keep(joined(dealt.select("*", F.col("set_id").alias("comp"), F.lit(True).alias("probe"))), "links")
    if sizes.limit(1).count():
        edges = _across(scratch, edges, taken(wanted.where("cells > 1")), joined, cell)

    same_id = slim.where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    repeated = slim.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y")).where("x < y").select("doc_id")
    edges = edges.union(same_id.join(repeated, same_id.a == repeated.doc_id, "left_semi"))
    names = components(edges, scratch).withColumnRenamed("id", "cid")
    out = slim.join(names, slim.class_id == names.cid, "left")
    lone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(lone, F.col("doc_id")).otherwise(F.coalesce("label", "class_id")).alias("component_id"))


def _across(scratch: Scratch, edges: DataFrame, dealt: DataFrame, joined, cell: int) -> DataFrame:
    """Links between the cells of blocks that have several."""

    def named(df: DataFrame, found: DataFrame) -> DataFrame:
        names = components(found, scratch).withColumnRenamed("id", "cid")
        return df.join(names, F.col("set_id") == F.col("cid"), "left").select("block", "cells", "cell", "set_id", "tokens", F.coalesce("label", "set_id").alias("comp"))

    # a few sets of each class that is large in its cell stand for it
    now = scratch.keep(named(dealt, edges), "classes")
    rank = F.row_number().over(W.partitionBy("block", "cell", "comp").orderBy(F.xxhash64("set_id"), "set_id"))
    large = F.count("*").over(W.partitionBy("block", "cell", "comp")) * 32 >= cell
    some = now.withColumns({"r": rank, "large": large}).where("large and r <= 8")
    some = some.withColumn("cell", F.pmod(F.xxhash64(F.lit(1), "set_id"), F.ceil(F.col("cells") * 64 / cell)))
    edges = scratch.keep(edges.union(joined(some.withColumn("probe", F.lit(True)))), "links")
    # whatever is outside the largest class meets every cell of its block
    was, now = now, scratch.keep(named(dealt, edges), "classes")
    scratch.drop(was)
    counts = scratch.keep(now.groupBy("block", "comp").agg(F.count("*").alias("c")), "counts")
    top = counts.groupBy("block").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.sum("c").alias("total"), F.max("c").alias("most"))
    top = top.select(F.col("block").alias("tb"), "top", F.ceil((F.col("total") - F.col("most")) * 2 / cell).cast("long").alias("lots")).where("lots > 0")
    top = scratch.keep(top, "top")
    rest = now.join(small(top, 100_000), F.col("block") == F.col("tb"))
    lot = F.pmod(F.xxhash64(F.lit(2), "set_id"), F.col("lots"))
    probes = rest.where("comp <> top").select("block", lot.alias("lot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("c"), "set_id", "comp", F.lit(True).alias("probe"), "tokens")
    others = rest.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.col("cell").alias("c"), "set_id", "comp", F.lit(False).alias("probe"), "tokens")
    return edges.union(joined(probes.union(others).withColumn("cell", F.col("lot") * 1_000_000 + F.col("c"))))


#: For three words and 90 of 100, on ids that don't repeat.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT c.doc_id, e.y FROM c JOIN e ON c.r = e.x)
SELECT c.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id
"""
