"""N-gram Jaccard join by universe partition.

A set of n shingle hashes lies in a size band (bounds grow by 5/4). A pair's larger set r lies in band p and
its smaller set s in band p or p - 1, so every set is indexed in its own partition and in the next. The
partition of band p deals the universe of hashes into m = H + 1 segments, H the largest symmetric
difference a linked pair of that band can have. By the pigeonhole principle any choice of values v for r's
segments (1: equal segment; 2: at most one hash apart, by one-deletion neighbourhoods; 0: skipped) that sums
to more than H_r, r's own bound, finds every partner.

The choice is made by cost. One shuffle brings equal keys together; a key that only one set holds costs
nothing to probe and is left there. For the others the number of holders is the cost: each set skips its
dearest segments, as many as its slack allows, and buys further skips by probing the neighbourhoods of its
cheapest spare segments (SPARE of them are indexed). Of what is left,

1. the best connected set of each bucket is verified against the others of the bucket (linear), and links
   merge classes into components;
2. only pairs of a prober and a holder of different components follow, in tiles of TILE probers, and only
   those that pass a necessary condition: the parity bits of both sets differ in no more places than the
   sets may differ (a bit is the parity of the number of hashes dealt to it). 256 bits go with every entry;
   as they saturate for sets of some hundred members, the rows of this step carry FINE bits more. Of buckets
   with the same rows one is read, as two sets that are near share most of their segments.

What passes is verified exactly, on the words of both texts. A bucket of thousands of near copies emits
pairs in proportion to its size. Comparing the bits of a bucket of many sets that are near but not linked
still grows with the square of the bucket, at a few nanoseconds a pair.

Equal sets collapse to one class first: sets are named by 128 bits of a digest, and by a 64-bit number
derived from it, which is derived anew with another salt where two digests share one.

Defined results: null text, or one without words, has an empty set and is linked with nothing, itself the
component; with fewer than five words the whole sequence is the one shingle; repeated rows are equal sets;
rows with a null id are compared as all others, and a component whose ids are all null is null; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_shuffles, forget, keep, ship, slices, text_bytes

WORDS, PERCENT = 5, 80
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})
BLOCK = 1 << 20
TILE, PAIRS, FEW = 512, 2000, 200_000
TEXT_KEY = ["h0", "h1"]
SIGNATURE = ["w0", "w1", "w2", "w3"]
FINE = 1024
KEY_MASK = np.int64(-1 << 16)  # 48 bits of an index key travel; keys that agree in them alone share a bucket and are told apart by what follows

#: First size of each band.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(max(BANDS[-1] + 1, -(-BANDS[-1] * 5 // 4)))

_RANDOM = np.random.default_rng(7)
#: One random number per byte value, the same for A-Z as for a-z.
BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
PLACE = _RANDOM.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes of many texts at once, from their bytes."""

    def __init__(self):
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            out = []
            for base in (BASE, UNBASE):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self._up, self._down = out
        return self._up[:n], self._down[:n]

    def _words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and where each text's words start (with the end). Reads blocks that end between words."""
        hashes, places, n, lo = [], [], len(data), 0
        first = np.zeros(n + 1, bool)
        first[starts] = True
        while lo < n:
            hi = min(lo + BLOCK, n)
            while hi < n and not (first[hi] or SPACE[data[hi - 1]]):
                back = np.flatnonzero(SPACE[data[lo:hi]] | first[lo + 1 : hi + 1])
                if len(back):
                    hi = lo + int(back[-1]) + 1
                else:  # one word fills the block
                    hi = min(hi + BLOCK, n)
            block = data[lo:hi]
            space, up_down = SPACE[block], self._powers(hi - lo)
            edge = np.ones(len(block) + 1, bool)
            edge[1:-1] = space[:-1]
            begin = np.flatnonzero(~space & (edge[:-1] | first[lo:hi]))
            edge[:-2] = space[1:]
            edge[-2] = True
            end = np.flatnonzero(~space & (edge[:-1] | first[lo + 1 : hi + 1])) + 1
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(BYTE[block] * up_down[0], out=total[1:])
            hashes.append(mix((total[end] - total[begin]) * up_down[1][begin]))
            places.append(begin + lo)
            lo = hi
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(places), starts)

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes of the five-word shingles of each text of a column."""
        data, starts = text_bytes(column)
        with np.errstate(over="ignore"):
            words, at = self._words(data, starts)
            whole = max(len(words) - WORDS + 1, 0)
            shingles = np.zeros(whole, np.uint64)
            for j in range(WORDS if whole else 0):
                shingles += PLACE[j] * words[j : j + whole]
            shingles = mix(shingles)
            out = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo >= WORDS:
                    s = np.sort(shingles[lo : hi - WORDS + 1])
                    new = np.ones(len(s), bool)
                    np.not_equal(s[1:], s[:-1], out=new[1:])
                    out.append(s[new])
                elif hi > lo:
                    out.append(mix((PLACE[: hi - lo] * words[lo:hi]).sum(keepdims=True) + np.uint64(hi - lo)))
                else:
                    out.append(np.zeros(0, np.uint64))
        return out


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def set_id(digest: bytes, salt: int = 0) -> int:
    if salt:
        digest = hashlib.blake2b(digest, digest_size=8, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True)


def band_of(n: int) -> int:
    return int(np.searchsorted(BANDS, n, "right")) - 1


def most_apart(larger: int) -> int:
    """Largest symmetric difference of a linked pair whose larger set has so many members."""
    return 2 * larger * (100 - PERCENT) // (100 + PERCENT)


def segments(band: int) -> int:
    return most_apart(BANDS[band + 1] - 1) + 1


def spare(m: int) -> int:
    """How many segments have their one-deletion neighbourhoods indexed."""
    return min(m, 3 + m // 24)


OWN, LESS = 1, 2


def entries(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and tags: segment * 4 + LESS (a one-deletion) + OWN (of the set's own band)."""
    keys, tags = [], []
    with np.errstate(over="ignore"):
        body = mix(shingles + np.uint64(BASE))
        own = band_of(len(shingles))
        for p in (own, own + 1):
            m = segments(p)
            seg = ((mix(shingles ^ np.uint64(p + 1)) >> np.uint64(11)) % np.uint64(m)).astype(np.int64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, seg, body)
            name = mix(np.arange(m, dtype=np.uint64) + np.uint64(p << 40))
            near = np.flatnonzero(seg < spare(m))
            at = seg[near]
            keys += [mix(total ^ name), mix((total[at] - body[near]) ^ name[at])]
            flag = OWN if p == own else 0
            tags += [np.arange(m) * 4 + flag, at * 4 + LESS + flag]
    return np.concatenate(keys).view(np.int64), np.concatenate(tags).astype(np.int32)


def allocate(n: int, tags: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Which entries of a set with n hashes it probes, at the least cost found; the values sum to more than most_apart(n).

    tags and costs are those of its keys that other sets hold too: any other key costs nothing and finds nothing.
    """
    m = segments(band_of(n))
    own = (tags & OWN) > 0
    less = (tags & LESS) > 0
    segment = tags >> 2
    whole = np.flatnonzero(own & ~less)
    cost = dict(zip(segment[whole].tolist(), costs[whole].tolist(), strict=True))
    more: dict[int, int] = dict.fromkeys(range(spare(m)), 0)
    for i in np.flatnonzero(own & less).tolist():
        more[int(segment[i])] += int(costs[i])
    dear = sorted(cost, key=lambda i: (-cost[i], i))
    cheap = sorted(more, key=lambda i: (more[i] + cost.get(i, 0), i))
    slack = m - (most_apart(n) + 1)
    skipped, both = set(dear[:slack]), set()
    for i in dear[slack:]:
        up = next((k for k in cheap if k not in both and k not in skipped and k != i), None)
        if up is None or more[up] >= cost[i] or i in both:
            break
        both.add(up)
        skipped.add(i)
    return own & np.where(less, np.isin(segment, list(both)), ~np.isin(segment, list(skipped)))


def signature(shingles: np.ndarray, bits: int = 256) -> np.ndarray:
    """Parity bits as signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        at = (mix(shingles ^ np.uint64(UNBASE)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def fits(a: str = "a_", b: str = "b_", fine: bool = False) -> Column:
    """What two sets (columns n, w0 to w3 and fine under the prefixes) need to be linked: sizes in proportion, and few different parity bits."""
    col = lambda p, c: F.col(p + c)
    words = lambda p: [F.get(col(p, "fine"), F.lit(k)) for k in range(FINE // 64)] if fine else [col(p, w) for w in SIGNATURE]
    sizes = 100 * F.least(col(a, "n"), col(b, "n")) >= PERCENT * F.greatest(col(a, "n"), col(b, "n"))
    apart = reduce(Column.__add__, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(words(a), words(b), strict=True)))
    return sizes & ((100 + PERCENT) * apart <= (100 - PERCENT) * (col(a, "n") + col(b, "n")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_key() -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("h0"), F.xxhash64(F.lit(1), "text").alias("h1")]


def shingle_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest, signature and text key of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches, "text"):
            sets = shingler.sets(batch.column("text"))
            bits = np.array([signature(s) for s in sets]).reshape(-1, 4)
            cols = [*(batch.column(c) for c in ("doc_id", *TEXT_KEY)), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest_of(s) for s in sets], pa.binary()), *(pa.array(bits[:, k]) for k in range(4))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *TEXT_KEY, "n_shingles", "digest", *SIGNATURE])

    return _texts(docs).select("doc_id", "text", *text_key()).mapInArrow(run, "doc_id long, h0 long, h1 long, n_shingles long, digest binary, w0 long, w1 long, w2 long, w3 long")


def index_entries(docs: DataFrame, salt: int, name: Callable[[bytes, int], int] = set_id) -> DataFrame:
    """set_id, key, tag of the sets that are not empty; a task emits equal sets once.

    In this order, what differs between the rows of a set lies in one place, and the shuffle's compression leaves little besides.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        for batch in slices(batches, "text"):
            keys, ids, tags = [], [], []
            for s in shingler.sets(batch.column("text")):
                if not len(s) or (d := digest_of(s)) in seen:
                    continue
                seen.add(d)
                k, t = entries(s)
                keys.append(k & KEY_MASK)
                tags.append(t)
                ids.append(np.full(len(k), name(d, salt)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, keys, tags)], names=["set_id", "key", "tag"])

    return _texts(docs).select("text").mapInArrow(run, "set_id long, key long, tag int")


def probed_buckets(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """key, set_id, probe, less, degree, n and signature of the entries that different sets share, with each set's allocation."""
    per_key = Window.partitionBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = entries.withColumn("holders", F.count("*").over(per_key)).withColumn("lo", F.min("set_id").over(per_key)).withColumn("hi", F.max("set_id").over(per_key))
    shared = counted.where("lo < hi").groupBy("set_id", "key", "tag").agg(F.max("holders").alias("holders"))  # tasks repeat equal sets
    # as long as one text's own entries
    by_set = shared.groupBy("set_id").agg(F.collect_list("key").alias("keys"), F.collect_list("tag").alias("tags"), F.collect_list("holders").alias("holders"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat = [part.column(c).flatten().to_numpy() for c in ("keys", "tags", "holders")]
                ends = np.cumsum(pc.list_value_length(part.column("keys")).to_numpy())
                probe, degree = np.zeros(len(flat[0]), bool), np.zeros(part.num_rows, np.int64)
                for k, (n, lo, hi) in enumerate(zip(part.column("n").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    probe[lo:hi] = allocate(n, flat[1][lo:hi], flat[2][lo:hi] - 1)
                    degree[k] = flat[2][lo:hi].sum()
                each = pa.array(np.repeat(np.arange(part.num_rows), np.diff(ends, prepend=0)))
                cols = [part.column(c).take(each) for c in ("set_id", "n", *SIGNATURE)]
                yield pa.RecordBatch.from_arrays([pa.array(flat[0]), *cols, pa.array(degree).take(each), pa.array(probe), pa.array((flat[1] & LESS) > 0)], names=["key", "set_id", "n", *SIGNATURE, "degree", "probe", "less"])

    joined = by_set.join(classes.select("set_id", "n", *SIGNATURE), "set_id")
    return joined.select("set_id", "keys", "tags", "holders", "n", *SIGNATURE).mapInArrow(run, "key long, set_id long, n long, w0 long, w1 long, w2 long, w3 long, degree long, probe boolean, less boolean")


def set_texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """set_id and text of each set of pairs (a, b).

    Up to FEW sets are looked up by broadcast; beyond it each distinct text moves once, to a join.
    """
    wanted = keep(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(classes.select("set_id", "digest", *TEXT_KEY), "set_id"))
    texts = _texts(docs).select("text", *text_key())
    if wanted.count() <= FEW:
        found = texts.join(F.broadcast(wanted), TEXT_KEY)
    else:
        found = texts.groupBy(*TEXT_KEY).agg(F.first("text").alias("text")).join(wanted, TEXT_KEY)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches, "text"):
            same = [digest_of(s) == d for s, d in zip(shingler.sets(batch.column("text")), batch.column("digest").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), batch.column("text")], names=["set_id", "text"]).filter(pa.array(same, pa.bool_()))

    return keep(found.select("set_id", "text", "digest").mapInArrow(check, "set_id long, text string").dropDuplicates(["set_id"]))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of sets, those that link, by the words of their texts (set_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in slices(batches, "x"):
            good = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if a != last[0]:
                    last = (a, shingles_of(x.as_py()))
                good.append(linked(last[1], shingles_of(y.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    # The text of a set with many pairs is copied for each PAIRS of them, so that no task reads all its pairs.
    copies = keep(pairs.groupBy("a").agg(F.floor(F.count("*") / PAIRS).cast("int").alias("copies")).where("copies > 0"))
    spread = pairs.join(copies, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(0)) + 1).cast("int").alias("copy"))
    first = texts.select(F.col("set_id").alias("a"), F.col("text").alias("x")).join(copies, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(0)))).alias("copy"))
    second = texts.select(F.col("set_id").alias("b"), F.col("text").alias("y"))
    both = spread.join(second, "b").join(first, ["a", "copy"])
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shingles_of(text: str) -> set[tuple[str, ...]]:
    """The shingles themselves."""
    words = WORD.findall(text.translate(UPPER))
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(WORDS)), strict=False))


def linked(x: set, y: set) -> bool:
    both = len(x & y)
    return both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both)


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest reachable node) for links (a, b): alternating large and small stars, until nothing changes."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.where("u <> v").distinct())
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = keep(small.where("u <> v").distinct())
        forget(edges, large)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))


def named_sets(ids: DataFrame, name: Callable[[bytes, int], int] = set_id) -> tuple[DataFrame, int]:
    """set_id, digest, n, text key and signature of each distinct set that is not empty, and the salt that tells their numbers apart."""
    digests = ids.where("n_shingles > 0").groupBy("digest").agg(F.first("n_shingles").alias("n"), F.min(F.struct(*TEXT_KEY)).alias("key"), *(F.first(w).alias(w) for w in SIGNATURE))  # equal in a class, the key apart
    digests = digests.select("digest", "n", "key.*", *SIGNATURE)
    salt = 0
    while True:

        def run(batches: Iterator[pa.RecordBatch], salt: int = salt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([name(d, salt) for d in batch.column("digest").to_pylist()], pa.int64()), *batch.columns], names=["set_id", *batch.schema.names])

        classes = keep(digests.mapInArrow(run, "set_id long, digest binary, n long, h0 long, h1 long, w0 long, w1 long, w2 long, w3 long"))
        if classes.groupBy("set_id").count().where("count > 1").isEmpty():
            return classes, salt
        forget(classes)
        salt += 1


def open_rows(named: DataFrame) -> DataFrame:
    """key, tiles, set_id, probe, less and comp of the rows (of probed_buckets, with comp) in buckets that hold a prober and several components.

    Of buckets with the same rows, known by two sums of their hashes, one is taken.
    """
    same = [F.sum(F.xxhash64(F.lit(k), "set_id", "probe", "less").cast("decimal(38,0)")).alias(f"same{k}") for k in range(2)]
    open_ = named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count_if("probe").alias("probes"), *same).where("c0 < c1 AND probes > 0")
    open_ = open_.groupBy("same0", "same1").agg(F.min(F.struct("key", "probes")).alias("one")).select("one.*")
    return named.join(open_.select("key", F.floor(F.col("probes") / TILE).cast("int").alias("tiles")), "key").select("key", "tiles", "set_id", "probe", "less", "comp")


def all_bits(texts: DataFrame) -> DataFrame:
    """set_id, n, signature and fine bits of sets given by their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches, "text"):
            sets = shingler.sets(batch.column("text"))
            bits = np.array([signature(s) for s in sets]).reshape(-1, 4)
            cols = [batch.column("set_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(bits[:, k]) for k in range(4)), pa.array([signature(s, FINE) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["set_id", "n", *SIGNATURE, "fine"])

    return texts.select("set_id", "text").mapInArrow(run, "set_id long, n long, w0 long, w1 long, w2 long, w3 long, fine array<long>")


def open_pairs(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs (a_set_id, b_set_id) of a prober and a holder of one bucket of open_rows whose components differ and which the bits let link."""
    side = lambda p, rows, tile: rows.select("key", tile.alias("tile"), "set_id", "less", "comp").join(bits, "set_id").select("key", "tile", *(F.col(c).alias(p + c) for c in ("set_id", "n", *SIGNATURE, "fine", "less", "comp")))
    probers = side("a_", rows.where("probe"), F.pmod(F.xxhash64("set_id"), F.col("tiles") + 1).cast("int"))
    holders = side("b_", rows, F.explode(F.sequence(F.lit(0), F.col("tiles"))))
    pairs = probers.join(holders, ["key", "tile"]).where("a_comp <> b_comp AND NOT (a_less AND b_less)").where(fits()).where(fits(fine=True))
    return pairs.select("a_set_id", "b_set_id")


def linked_classes(docs: DataFrame, name: Callable[[bytes, int], int] = set_id) -> DataFrame:
    """doc_id, text key, n_shingles and class (a number for each component; null for an empty set) of every document."""
    ids = keep(shingle_ids(docs))
    classes, salt = named_sets(ids, name)
    buckets = keep(probed_buckets(index_entries(docs, salt, name), classes))
    drop_shuffles(docs.sparkSession)  # the index entries, larger than all that follows
    member = F.struct("degree", "set_id", "n", *SIGNATURE)
    star = buckets.groupBy("key").agg(F.max(member).alias("hub"), F.max("probe").alias("any")).where("any").select("key", F.col("hub.set_id").alias("h_set"), *(F.col(f"hub.{c}").alias(f"h_{c}") for c in ("n", *SIGNATURE)))
    star = buckets.join(star, "key").where("set_id <> h_set").where(fits("", "h_"))
    star = keep(star.select(F.least("set_id", "h_set").alias("a"), F.greatest("set_id", "h_set").alias("b")).distinct())
    texts = set_texts(docs, classes, star)
    links = keep(verify(star, texts))
    forget(texts)
    known = keep(components(links))
    # What the stars leave: pairs of one bucket whose sets are in different components so far.
    named = keep(buckets.join(known, F.col("set_id") == F.col("node"), "left").select("key", "set_id", "probe", "less", F.coalesce("comp", "set_id").alias("comp")))
    forget(buckets, known)
    rows = keep(open_rows(named))
    forget(named)
    texts = set_texts(docs, classes, rows.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")).distinct())
    bits = keep(all_bits(texts))
    rest = open_pairs(rows, bits).select(F.least("a_set_id", "b_set_id").alias("a"), F.greatest("a_set_id", "b_set_id").alias("b")).distinct()
    rest = keep(rest.join(star, ["a", "b"], "left_anti"))
    forget(rows, bits, star)
    compared = keep(texts.join(rest.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "set_id", "left_semi"))
    forget(texts)
    links = keep(links.unionByName(verify(rest, compared)))
    forget(compared, rest)
    comp = components(links)
    # Equal sets are one node; an empty set is linked with nothing.
    node = classes.join(comp, F.col("set_id") == F.col("node"), "left").select("digest", F.coalesce("comp", "set_id").alias("class"))
    return keep(ids.select("doc_id", *TEXT_KEY, "n_shingles", "digest").join(node, "digest", "left").select("doc_id", *TEXT_KEY, "n_shingles", "class"))


def near_duplicates(docs: DataFrame, name: Callable[[bytes, int], int] = set_id) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every document."""
    group = linked_classes(docs, name)
    several = group.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return group.join(several, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
