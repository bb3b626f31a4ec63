"""N-gram Jaccard self-join by PartEnum signatures (operator 7).

Sizes of sets are cut into bands. For each band the domain of shingles is cut into first-level partitions, and each of
those into three second-level ones, of which all subsets of two are enumerated: a subset's signature is a hash of the
shingles that the set has in it. Sets with Jaccard of at least t and sizes a and b differ in at most d = (a + b) (1 - t) / (1 + t)
shingles, and each of these changes two subsets, so of a set's signatures at most 2 d are none of the other's. A set signs with
the first 2 d + 1 of its subsets that aren't empty, in one order for all sets that depends on what a subset holds (with a
rare shingle first): the first one that two such sets share is among those of each. A set with too few such subsets, as small
ones may have, signs by single shingles besides, of which d + 1 do. So similar sets of a band, or of neighbouring bands,
share a signature, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import partitions, small_batches, stored, table
from gatewell.llm.graph import components

WORDS, PERCENT = 5, 80
#: Ratio of the largest to the least size of a band, and shingles a first-level partition for the largest size.
RATIO, LOAD = 2, 5
CLASSES = 128
#: Sets of one signature that meet in one task (sets of larger ones sign again), and shingles of a family that do; what is more is dealt in blocks.
MOST, ROOM = 4096, 1 << 22
_ODD = tuple(np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(WORDS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of words, remembered up to `room` of them, and of the runs of words; `seen` are the sets met by a task."""

    def __init__(self, room: int = 400_000):
        self.room, self.memo, self.seen = room, {}, set()

    def _word(self, w: bytes) -> int:
        h = self.memo[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct 64-bit hashes, sorted, of the five-word shingles; with fewer words, of the whole sequence.

        As bytes, lower() changes A-Z alone and split() cuts at the six separators alone.
        """
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.memo) > self.room:
            self.memo.clear()
        get = self.memo.get
        h = np.array([x if (x := get(w)) is not None else self._word(w) for w in words], np.uint64)
        n = min(WORDS, len(h))
        m = len(h) - n + 1
        out = h[:m] * _ODD[0] + np.uint64(n)
        for i in range(1, n):
            out += h[i : m + i] * _ODD[i]
        return np.unique(_mix(out))


def set_key(s: np.ndarray) -> int:
    """The identity of a set: a hash of its sorted members, as a signed 64-bit number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def bands(size: int) -> list[int]:
    """The bands that a set of this size signs for: its own, and the next if a larger similar set may be there."""
    b = size.bit_length() - 1  # sizes from 2^b to 2^(b + 1) - 1
    return [b, b + 1] if size * 100 // PERCENT >= RATIO ** (b + 1) else [b]


def signatures(s: np.ndarray, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The signatures of a set. `common` are shingles known to be in many sets, sorted, with their level: they only set the order."""
    n = len(s)
    if not n:
        return np.empty(0, np.uint64)
    most = n * (100 - PERCENT) // PERCENT  # sizes a <= b <= 5a/4 differ in (a + b) / 9 <= a / 4 at most
    held = _levels(s, common, level)
    mixed = _mix(s)
    out = []
    for band in bands(n):
        # first-level partitions, of three second-level ones each
        parts = max(1, int((RATIO ** (band + 1) - 1) / LOAD))
        where = ((s >> np.uint64(32)) * np.uint64(3 * parts) >> np.uint64(32)).astype(np.int64)  # sorted, as s is
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        content, count, rare = np.zeros(3 * parts, np.uint64), np.zeros(3 * parts, np.uint64), np.full(3 * parts, 63, np.uint64)
        content[where[first]] = np.add.reduceat(mixed, first)
        count[where[first]] = np.diff(np.append(first, n)).astype(np.uint64)
        rare[where[first]] = np.minimum.reduceat(held, first)
        # all subsets of two second-level partitions: each leaves one of the three out
        content, count, rare = content.reshape(-1, 3), count.reshape(-1, 3), rare.reshape(-1, 3)
        content = (content.sum(1, keepdims=True) - content).ravel()
        count = (count.sum(1, keepdims=True) - count).ravel()
        rare = np.minimum(rare[:, [1, 0, 0]], rare[:, [2, 2, 1]]).ravel()
        full = np.flatnonzero(count)
        subsets = _mix(content[full] + full.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band))
        need = 2 * most + 1  # a shingle is in two of the subsets of its partition
        # one order for all sets, by what a subset holds: with a rare shingle, then of many shingles, then by hash
        out.append(_least(subsets, rare[full], np.minimum(count[full], 7), need))
        if len(full) < need:  # too few to be sure of one to agree on, if the other set has too few as well: sign by single shingles besides
            out.append(_least(_mix(mixed + np.uint64(band + 1000)), held, np.ones(n, np.uint64), most + 1))
    return np.concatenate(out)


def single_signatures(s: np.ndarray, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A set's rarest shingles, one more than a similar set may lack: the first that two similar sets share, in one order for all, is among those of each."""
    mixed = _mix(s)
    return _least(mixed, _levels(s, common, level), np.ones(len(s), np.uint64), len(s) * (100 - PERCENT) // 100 + 1)


def _levels(s: np.ndarray, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """How common each shingle of s is known to be; 0 if it isn't known."""
    if not len(common):
        return np.zeros(len(s), np.uint64)
    at = np.searchsorted(common, s)
    at[at == len(common)] = 0
    return np.where(common[at] == s, level[at], 0).astype(np.uint64)


def _least(hashes: np.ndarray, rare: np.ndarray, count: np.ndarray, need: int) -> np.ndarray:
    """The first `need` of hashes in order of rarity, size and hash."""
    if len(hashes) <= need:
        return hashes
    key = np.minimum(rare, np.uint64(63)) << np.uint64(58) | (np.uint64(7) - count) << np.uint64(55) | hashes >> np.uint64(9)
    return hashes[np.argpartition(key, need - 1)[:need]]


def _sets(docs: DataFrame, columns: str, make) -> DataFrame:
    """mapInArrow over the columns of docs: make(*values, shingler) gives rows of `columns`."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in columns.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            parts = [make(*values, shingler) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            join = lambda xs: np.concatenate(xs) if xs and isinstance(xs[0], np.ndarray) else [x for y in xs for x in y]
            columns = [join([p[k] for p in parts]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(run, columns)


def _common(docs: DataFrame, most: int = 200_000, share: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in many sets, by a sample of one text in `share`, and the level (log2 of the count). They order signatures; results don't depend on them.

    At most `most` of the commonest go to all tasks.
    """

    def make(text, shingler):
        return (shingler.shingles(text).view(np.int64),)

    sample = docs.filter(F.pmod(F.xxhash64(F.lit("common"), "doc_id"), F.lit(share)) == 0).select("text")
    counts = _sets(sample, "s long", make).groupBy("s").count().filter("count >= 3")
    rows = counts.orderBy(F.desc("count"), "s").limit(most).toPandas()
    s = rows["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], np.log2(rows["count"].to_numpy(np.int64)[order]).astype(np.int64) + 1


def _by_key(rows: DataFrame, key: str, order: list[str], run, schema: str) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups of rows sorted by key, some at a time; of a group only what the columns hold is kept."""
    rest = None
    for batch in batches:
        table_ = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not table_.num_rows:
            continue
        keys = table_.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1])) if keys[-1] != keys[0] else 0
        rest = table_.slice(last)
        if last:
            yield table_.slice(0, last)
    if rest is not None and rest.num_rows:
        yield rest


def _shared(signed: DataFrame) -> DataFrame:
    """(sig, u) for the rows of signatures that several sets share. Rows come sorted, so no group is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: signature, set, and whether it is given out
        for batch in batches:
            sig, u = (batch.column(c).to_numpy() for c in ("sig", "u"))
            if held is not None:
                sig, u = np.concatenate([[held[0]], sig]), np.concatenate([[held[1]], u])
            once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (u[1:] != u[:-1])])[: len(sig)]
            sig, u = sig[once], u[once]
            if not len(sig):
                continue
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            out = ~new | np.concatenate([~new[1:], [False]])
            if held is not None:
                out[0] &= not held[2]
            given = held[2] if held is not None and len(sig) == 1 else bool(out[-1])
            held = sig[-1], u[-1], given
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (sig, u)], ["sig", "u"])

    return _by_key(signed, "sig", ["u"], run, "sig long, u long")


def _classes(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set are in each class of the domain."""
    return np.minimum(np.bincount((s >> np.uint64(64 - CLASSES.bit_length() + 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8)


def _possible(n: np.ndarray, m: np.ndarray, k: np.ndarray, l: np.ndarray) -> np.ndarray:  # noqa: E741
    """Whether sets of sizes n and m and class counts k and l may be similar: they differ by at least as much as their counts do, and similar ones by (n + m) / 9 at most."""
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ((100 + PERCENT) * np.abs(k - l).sum(-1) <= (100 - PERCENT) * (n + m))


def _counts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16)


def _trees(count: int, near) -> np.ndarray:
    """For each of `count` sets the first set of its connected component, where near(i, others) tells which of the others are i's neighbours.

    Only sets that are in no component yet are asked about, so a group whose members are near its first one takes one question.
    """
    first, left = np.arange(count), np.arange(1, count)
    waiting = [0]
    while len(left):
        if not waiting:
            waiting.append(left[0])
            left = left[1:]
            continue
        i = waiting.pop()
        met = near(i, left)
        first[left[met]] = first[i]
        waiting.extend(left[met])
        left = left[~met]
    return first


def _distinct_groups(shared: DataFrame) -> DataFrame:
    """(sig, m): of the signatures that the very same sets share, one, and how many sets it has. Groups are told apart by 128 bits of their members' hashes."""
    mark = [F.bit_xor(F.xxhash64(F.lit(i), "u")).alias(f"x{i}") for i in range(2)]
    return shared.groupBy("sig").agg(F.count("*").alias("m"), *mark).groupBy("m", "x0", "x1").agg(F.min("sig").alias("sig")).select("sig", "m")


def _forest(rows: DataFrame, near=None, key: str = "g") -> DataFrame:
    """Edges (key, a, b) from the first set of each connected component of a group to its others: rows are key, u, n and k; near tells who may be similar."""
    near = near or _possible

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, key):
            g, u, n = (group.column(x).to_numpy() for x in (key, "u", "n"))
            k = _counts(group.column("k"))
            new = np.concatenate([[True], g[1:] != g[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            met = near(n, n[head], k, k[head])
            first = np.where(met, head, np.arange(len(g)))
            # where one is not near the first of three or more, the others have to be asked
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, len(g)))
            for low in starts[(size > 2) & ~np.logical_and.reduceat(met, starts)]:
                high = low + size[np.searchsorted(starts, low)]
                c, x = n[low:high], k[low:high]
                first[low:high] = low + _trees(high - low, lambda i, others: near(c[others], c[i], x[others], x[i]))  # noqa: B023
            out = first != np.arange(len(g))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[out], u[first[out]], u[out])], [key, "a", "b"])

    return _by_key(rows.select(key, "u", "n", "k"), key, ["u"], run, f"{key} long, a long, b long")


def _stars(rows: DataFrame) -> DataFrame:
    """(sig, a, b): for each set b of a block a centre a that may be similar to it; a centre is its own. rows are g (the block), sig, u, n and k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "g"):
            g, sig, u, n = (group.column(x).to_numpy() for x in ("g", "sig", "u", "n"))
            k = _counts(group.column("k"))
            centre = np.arange(len(g))
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            for low, high in zip(starts, [*starts[1:], len(g)], strict=True):
                left = np.arange(low, high)
                while len(left):
                    i, left = left[0], left[1:]
                    met = _possible(n[left], n[i], k[left], k[i])
                    centre[left[met]] = i
                    left = left[~met]
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(u[centre]), pa.array(u)], ["sig", "a", "b"])

    return _by_key(rows.select("g", "sig", "u", "n", "k"), "g", ["u"], run, "sig long, a long, b long")


def _near_centres(n: np.ndarray, m: np.ndarray, k: np.ndarray, l: np.ndarray) -> np.ndarray:  # noqa: E741
    """Whether two centres may have sets around them that are similar: the steps centre, set, set, centre each keep sizes within 4/5 and counts within (size + size) / 9."""
    return (1000 * np.minimum(n, m) >= 512 * np.maximum(n, m)) & (18 * np.abs(k - l).sum(-1) <= 7 * (n + m))


def _hot_families(shared: DataFrame, traits: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) that connect the sets of signatures of more than `most` sets, with at most three for each row of shared.

    A set meets its block of the signature once: there it gets a centre. The centres of a signature then meet, and are connected
    if sets around them may be similar; where there are more than `most` centres all are. So families may hold more than
    they must, and nothing is dealt once for each two blocks.
    """
    block = F.pmod(F.xxhash64(F.lit("block"), "u"), F.ceil(F.col("m") / most).cast("int"))
    stars = stored(_stars(shared.join(traits, "u").withColumn("g", F.xxhash64("sig", block))), "stars")
    heads = stars.filter("a = b").select("sig", F.col("a").alias("u"))
    count = stored(heads.groupBy("sig").agg(F.count("*").alias("m"), F.min("u").alias("a")), "heads")
    few = heads.join(count.filter(F.col("m") <= most), "sig").join(traits, "u")
    many = heads.join(count.filter(F.col("m") > most), "sig").select("a", F.col("u").alias("b"))
    return stars.select("a", "b").filter("a != b").unionByName(_forest(few, _near_centres, "sig").select("a", "b")).unionByName(many.filter("a != b"))


def _families(shared: DataFrame, traits: DataFrame, most: int, singles) -> DataFrame:
    """Edges (a, b) that connect all sets which share a signature and are not ruled out by size and class counts: at most a few for each row, never one for each pair.

    Sets that share a signature of more than `most` sets sign once more, by the rarest of their single shingles (`singles`
    gives sig and u for some u): similar ones share one of these too. So what sets have in common with many others no longer brings them together.
    """
    sizes = stored(_distinct_groups(shared), "groups")
    edges = _forest(shared.join(sizes.filter(F.col("m") <= most), "sig").join(traits, "u"), key="sig").select("a", "b")
    hot = sizes.filter(F.col("m") > most)
    if hot.isEmpty():
        return edges
    again = stored(_shared(singles(stored(shared.join(hot, "sig").select("u").distinct(), "hot"))), "again")
    sizes = stored(_distinct_groups(again), "groups")
    rest = again.join(sizes.filter(F.col("m") <= most), "sig").join(traits, "u")
    return edges.unionByName(_forest(rest, key="sig").select("a", "b")).unionByName(_hot_families(again.join(sizes.filter(F.col("m") > most), "sig"), traits, most))


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each of some sets the first set of its component by links; sets are sorted, and links verified."""
    size = np.array([len(s) for s in sets])
    kinds = np.stack([_classes(s) for s in sets]).astype(np.int16)
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    held = np.zeros(len(words), np.int64)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        met = _possible(size[others], size[i], kinds[others], kinds[i])
        held[ids[start[i] : start[i + 1]]] = 1
        for x in np.flatnonzero(met):
            j = others[x]
            both = int(held[ids[start[j] : start[j + 1]]].sum())
            met[x] = 100 * both >= PERCENT * (size[i] + size[j] - both)
        held[ids[start[i] : start[i + 1]]] = 0
        return met

    return _trees(len(sets), near)


def _verified(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """Links (a, b) that connect all linked sets of each group: dealt has u, g (its group) and row (which text has it). Sets are shipped once for each place in dealt."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            out = []
            for text, us, gs in zip(*(batch.column(c).to_pylist() for c in ("text", "us", "gs")), strict=True):
                s = shingler.shingles(text)
                key = set_key(s) if len(s) else None
                for u, g in zip(us, gs, strict=True):
                    if u == key and (u, g) not in shingler.seen:  # of equal sets in a task one goes
                        shingler.seen.add((u, g))
                        out.append((g, u, s.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["g", "u", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "g"):
            g, u, s = group.column("g").to_numpy(), group.column("u").to_numpy(), group.column("s").combine_chunks()
            once = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (u[1:] != u[:-1])]))
            g, u = g[once], u[once]
            sets = [np.frombuffer(s[int(i)].as_buffer(), np.uint64) for i in once]
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            first = np.concatenate([low + _linked(sets[low:high]) for low, high in zip(starts, [*starts[1:], len(g)], strict=True)])
            out = first != np.arange(len(g))
            yield pa.RecordBatch.from_arrays([pa.array(u[first[out]]), pa.array(u[out])], ["a", "b"])

    # candidates grow with the corpus, so texts are dealt by row at every size
    places = dealt.groupBy("row").agg(F.collect_list("u").alias("us"), F.collect_list("g").alias("gs")).hint("merge")
    found = rows.withColumn("row", _row()).join(places, "row").select("text", "us", "gs").mapInArrow(make, "g long, u long, s binary")
    return _by_key(found, "g", ["u"], run, "a long, b long")


def _row():
    """Which row a text is in; null ids and repeated ones are told by their texts."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def _family_links(rows: DataFrame, members: DataFrame, room: int, seeds: int = 4) -> DataFrame:
    """Links (a, b) that connect all linked sets of each family: members has u, n, row and f (its family).

    A family of more than `room` shingles is dealt in blocks, each with the same few seeds, so that what links to a seed
    is one component in all of them. Of such a family the sets outside its largest component are then held against every block.
    """
    pick = [F.min(F.struct(F.xxhash64(F.lit(i), "u").alias("h"), "u", "row")).alias(f"s{i}") for i in range(seeds)]
    size = members.groupBy("f").agg(F.ceil(F.sum("n") / room).cast("int").alias("blocks"), *pick)
    own = F.pmod(F.xxhash64(F.lit("block"), "u"), F.col("blocks")).cast("int")
    placed = stored(members.join(size.select("f", "blocks"), "f").withColumn("block", own), "members")
    cell = lambda *x: F.when(F.col("blocks") == 1, F.col("f")).otherwise(F.xxhash64("f", *x))
    whole = placed.select("row", "u", cell("block").alias("g"))
    large = stored(size.filter("blocks > 1"), "large")
    if large.isEmpty():
        return stored(_verified(rows, whole), "links")
    spread = large.select("f", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.explode(F.array(*[F.col(f"s{i}") for i in range(seeds)])).alias("s"))
    sown = whole.unionByName(spread.select("s.row", "s.u", cell("block").alias("g"))).distinct()
    links = stored(_verified(rows, sown), "links")
    named = placed.filter("blocks > 1").join(components(links), F.col("u") == F.col("node"), "left").withColumn("c", F.coalesce("component", "u")).drop("node", "component")
    named = stored(named, "named")
    main = named.groupBy("f", "c").agg(F.count("*").alias("m")).groupBy("f").agg(F.max_by("c", F.struct("m", "c")).alias("main"))
    apart = named.join(main, "f").filter("c != main")
    rounds = apart.groupBy("f").agg(F.ceil(F.sum("n") / room).cast("int").alias("rounds"))
    turn = F.pmod(F.xxhash64(F.lit("turn"), "u"), F.col("rounds")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    anchors = named.join(rounds, "f").withColumn("turn", every("rounds"))
    probes = apart.join(rounds, "f").withColumn("turn", turn).drop("block").withColumn("block", every("blocks"))
    grid = anchors.select("row", "u", cell("block", "turn").alias("g")).unionByName(probes.select("row", "u", cell("block", "turn").alias("g"))).distinct()
    return links.unionByName(stored(_verified(rows, grid), "links"))


def similar_sets(docs: DataFrame, most: int = MOST, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """(documents, components): doc_id, n_shingles and u, the key of its set (null if empty), for each row; and (node, component) of the sets that link to others.

    Stages: equal sets are one node, u. Sets sign; signatures that one set alone has are dropped. Sets that share one and may be
    similar by size and class counts are connected to families (those of a hot signature by a second one), and each family's sets, shipped once, are verified where they meet.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def describe(d, row, text, shingler):
        s = shingler.shingles(text)
        return [d], [row], [len(s)], [set_key(s) if len(s) else None], [_classes(s).tobytes()]

    common = docs.sparkSession.sparkContext.broadcast(_common(rows))

    def signed(texts: DataFrame, make) -> DataFrame:
        def sign(text, shingler):
            s = shingler.shingles(text)
            u = set_key(s)
            if not len(s) or u in shingler.seen:  # of equal sets in a task one signs
                return np.empty(0, np.int64), np.empty(0, np.int64)
            shingler.seen.add(u)
            x = make(s, *common.value).view(np.int64)
            return x, np.full(len(x), u)

        return _sets(texts.select("text"), "sig long, u long", sign)

    documents = stored(_sets(rows.select("doc_id", _row().alias("row"), "text"), "doc_id long, row long, n_shingles long, u long, k binary", describe), "documents")
    # one row of each set stands for it
    traits = documents.filter("u is not null").groupBy("u").agg(F.min(F.struct("row", F.col("n_shingles").alias("n"), "k")).alias("x")).select("u", "x.*")
    traits = stored(traits, "traits")
    shared = stored(_shared(signed(rows, signatures)), "shared")

    def singles(some: DataFrame) -> DataFrame:
        return signed(rows.withColumn("row", _row()).join(traits.join(some, "u").select("row"), "row"), single_signatures)

    families = components(_families(shared, traits.select("u", "n", "k"), most, singles))
    members = traits.select("u", "n", "row").join(families.select(F.col("node").alias("u"), F.col("component").alias("f")), "u")
    return documents, components(_family_links(rows, members, room))


def link_documents(docs: DataFrame, most: int = MOST, room: int = ROOM) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable by links, for each row.

    Texts that are null, empty or blank have no shingles and link with nothing; repeated rows are nodes with equal sets, and
    link; a null doc_id takes part, and is the component's id only if all are null. Other columns are ignored.
    """
    documents, parts = similar_sets(docs, most, room)
    whole = documents.join(parts, documents["u"] == parts["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "u").alias("c"))
    least = whole.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return whole.join(least, "c", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))
