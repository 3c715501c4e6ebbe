"""Operator 4: n-gram Jaccard join by parity sketches.

A document's set holds 64-bit hashes of its distinct shingles of ``shingle`` words; two sets link when 100 * intersection
>= ``percent`` * union (five words and 80 unless the caller says otherwise). Its parity sketch has one bit per hash value, kept
sparse; flipping a bit per element makes the Hamming distance of two sketches a lower bound of the sets' symmetric
difference. Two linked sets of sizes a + b = t differ in at most ``t - 2 ceil(percent t / (100 + percent))`` elements. Sizes are cut into bands; a band whose largest pair may differ in D elements cuts the sketch into D + 1 + slack
blocks, so linked sets agree on at least 1 + slack blocks, and on one that is not empty unless both have more than slack
empty ones (only then are empty blocks used). Sketch blocks (XOR of the mixed positions of their odd bits) are joined by
equality; a document also enters the next band if partners can lie there. Candidates are tested by the Hamming bound on a
512-bit folded sketch, then on sketches that grow with the set, then exactly on the sets.

Equal sets are one class from the start; a task packs a set's keys once, however many copies it meets. Each text is cut
into shingles once: block keys (packed, 14 bytes each) and descriptions travel in one shuffle to buckets whose number
follows the bytes of text. Up to 16
classes with the same block key are paired with each other; in a larger group every class is paired with the smallest one,
its hub. Members that are not linked to their hub's component are then compared with the hub's whole group in units of
bounded size (``rest_links``): sketches and sets are tested inside the task, and only links between components come out,
so hot shingles and large families of near copies make no quadratic table and lose no link.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer than ``shingle`` words are one shingle; null, empty and wordless
texts have no shingles and link with nothing. Repeated rows fall into one class. Classes are named by 64 bits of their set,
not by doc_id: rows without doc_id link too but never name a component (component_id is null where a whole component has
none), and different texts under one doc_id are different classes. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, drop, forget, fresh, shared_dir, small_batches, splitmix, written
from .graph import connected_components

GROWTH, FOLD = 1.35, 8  # FOLD: 64-bit words of the folded sketch
#: Linked sets lie in the same band or in neighbours only if sizes differ by less than GROWTH, so no percent below this one.
LEAST_PERCENT = 75
SMALL_GROUP, BUCKET_BYTES = 16, 8 << 20
#: Bytes of sets that a unit of ``rest_links`` holds, and that it is compared with; rows compared at once.
HELD_BYTES, MET_BYTES, MET_ROWS = 1 << 20, 2 << 20, 64
#: A table of ids up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Names of sets that a task remembers as packed before it forgets them: bounds memory, never results.
PACKED_NAMES = 200_000
#: Columns of the rows between the tasks of the candidate search; FOUND are those that are written.
ROW = "kind int, bucket long, x long, y long, doc_id long, n long, t long, sketch array<long>, keys binary, owners binary"
FOUND = ["kind", "x", "y", "doc_id", "n", "t", "sketch"]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(4)
def bands(percent: int) -> tuple[list[int], list[int], list[int]]:
    """(first size, number of blocks, slack) of each band."""
    firsts, blocks, slack = [1], [], []
    while firsts[-1] < 1 << 40:
        firsts.append(max(firsts[-1] + 8, int(firsts[-1] * GROWTH)))
    for last in (f - 1 for f in firsts[1:]):
        d = 2 * last * (100 - percent) // (100 + percent)
        slack.append(2 + d // 16)
        blocks.append(d + 1 + slack[-1])
    return firsts, blocks, slack


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    v, width = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n), min(n, shingle)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            h = splitmix(h ^ v[k : n - width + 1 + k]) if width < shingle else h * np.uint64(0xD6E8FEB86659FD93) + v[k : n - width + 1 + k]
    return np.unique(splitmix(h))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed integers."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        return tuple(int(np.bitwise_xor.reduce(splitmix(s ^ np.uint64(salt))).astype(np.int64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def folded(s: np.ndarray) -> np.ndarray:
    """The parity sketch folded to FOLD words: its Hamming distances are lower bounds too."""
    out = np.zeros(FOLD, np.uint64)
    np.bitwise_xor.at(out, (s >> np.uint64(6)).astype(np.int64) % FOLD, np.uint64(1) << (s & np.uint64(63)))
    return out


def wide_sketch(s: np.ndarray) -> bytes:
    """The parity sketch in two to four bits per element (64 at least), a power of two: it never saturates."""
    bits = 64 << max(0, (len(s) - 1).bit_length() - 5)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def hamming(x: bytes, y: bytes) -> int:
    """Distance of two wide sketches, the longer one folded to the other's length: a lower bound of the sets' difference."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def block_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the sketch blocks of a set, for its own band and, where partners can lie there, the next."""
    firsts, blocks, slack = bands(percent)
    n, out = len(s), []
    own = int(np.searchsorted(firsts, n, side="right")) - 1
    for band in (own, own + 1) if n * 100 >= percent * firsts[own + 1] else (own,):
        k = blocks[band]
        of = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # ascending, as s is
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        words = np.bitwise_xor.reduceat(splitmix(s), starts)
        at = of[starts]
        if k - len(starts) > slack[band]:
            at = np.concatenate([at, np.setdiff1d(np.arange(k, dtype=np.uint64), at)])
            words = np.concatenate([words, np.zeros(k - len(words), np.uint64)])
        out.append(splitmix(words ^ splitmix(at + np.uint64(band << 44))))
    return np.concatenate(out)


def _rows(kind: int, **columns):
    """A batch of ROW with these columns and nulls elsewhere."""
    import pyarrow as pa

    types = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    n = len(next(iter(columns.values())))
    named = [c.split() for c in ROW.split(", ")]
    columns["kind"] = pa.array(np.full(n, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, types[t]) for c, t in named], [c for c, _ in named])


def _described_and_packed(n_buckets: int, shingle: int, percent: int):
    """Task function: (doc_id, text, t) -> in one pass a row of kind 2 for each document (n, name, sketch) and rows of kind 3
    with block keys, packed per bucket. A set that this task has packed already is not packed again."""

    def work(batches: Iterable) -> Iterator:
        import pyarrow as pa

        forget()
        packed: set = set()
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                ids, texts = b.column(0)[lo : lo + 2000].cast(pa.int64()), b.column(1)[lo : lo + 2000]
                ns, names, sketches, keys, owners = [], [], [], [], []
                for t in texts:
                    s = shingle_set(t.as_py(), shingle)
                    ns.append(len(s))
                    names.append(set_key(s))
                    sketches.append(folded(s).view(np.int64))
                    if len(s) and (name := (len(s), *names[-1])) not in packed:
                        if len(packed) >= PACKED_NAMES:
                            packed.clear()
                        packed.add(name)
                        keys.append(k := block_keys(s, percent))
                        owners.append(np.full(len(k), name[1], np.int64))
                names = np.array(names, np.int64).reshape(-1, 2)
                sketch = pa.array(list(sketches), pa.list_(pa.int64()))
                # Spread by the row's own content, so that copies do not meet in one bucket.
                spread = splitmix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64) ^ names[:, 1].astype(np.uint64)) % np.uint64(n_buckets)
                yield _rows(2, bucket=pa.array(spread.astype(np.int64)), x=pa.array(names[:, 0].copy()), y=pa.array(names[:, 1].copy()), doc_id=ids, n=pa.array(ns, pa.int64()), t=b.column(2)[lo : lo + 2000], sketch=sketch)
                if not keys:
                    continue
                k, o = np.concatenate(keys), np.concatenate(owners)
                bucket = ((k >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                k, o, bucket = k[order], o[order], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = [*cut[1:], len(k)]
                six = k.view(np.uint8).reshape(-1, 8)[:, :6]
                pack = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())
                yield _rows(3, bucket=pa.array(bucket[cut]), keys=pack(six), owners=pack(o))

    return work


def _pair_bucket(batches: Iterable) -> Iterator:
    """Rows of buckets, sorted by bucket -> pairs of classes of small groups (kind 0) and of hubs with the other members of
    their large groups (kind 1). Documents (kind 2) pass through."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def solve(keys: list, owners: list):
        six = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 6)
        k = np.zeros((len(six), 8), np.uint8)
        k[:, :6] = six
        k, o = k.view(np.uint64).ravel(), np.frombuffer(b"".join(owners), np.int64)
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
        k, o = k[new], o[new]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(starts, len(k)))
        pairs: tuple[list, list] = [], []
        for g in range(2, SMALL_GROUP + 1):
            at = starts[sizes == g]
            if len(at):
                i, j = np.triu_indices(g, 1)
                pairs[0].append(np.stack([o[(at[:, None] + i).ravel()], o[(at[:, None] + j).ravel()]], 1))
        for at, g in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
            pairs[1].append(np.stack([np.full(g - 1, o[at]), o[at + 1 : at + g]], 1))  # classes ascend: the hub is the smallest
        for kind in (0, 1):
            if pairs[kind]:
                p = np.unique(np.concatenate(pairs[kind]), axis=0)
                yield kind, p[:, 0], p[:, 1]

    def out(keys: list, owners: list):
        for kind, x, y in solve(keys, owners):
            yield _rows(kind, x=pa.array(np.ascontiguousarray(x)), y=pa.array(np.ascontiguousarray(y))).select(FOUND)

    held, keys, owners = None, [], []
    for b in batches:
        packs = pc.equal(b.column("kind"), 3)
        if (docs := b.filter(pc.invert(packs))).num_rows:
            yield docs.select(FOUND)
        b = b.filter(packs)
        for bucket, k, o in zip(b.column("bucket").to_pylist(), b.column("keys"), b.column("owners")):
            if held is not None and bucket != held:
                yield from out(keys, owners)
                keys, owners = [], []
            held = bucket
            keys.append(k.as_py())
            owners.append(o.as_py())
    if keys:
        yield from out(keys, owners)


def _near_enough(a: str, b: str, percent: int):
    """The Hamming bound on folded sketches and the bound on sizes."""
    t = f"({a}.n + {b}.n)"
    far = " + ".join(f"bit_count({a}.sketch[{k}] ^ {b}.sketch[{k}])" for k in range(FOLD))
    return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND {far} <= {t} - 2 * (({percent} * {t} + {99 + percent}) div {100 + percent})")


def _described(spark: SparkSession, docs: DataFrame, wanted: DataFrame, folder: str, shingle: int, pack) -> DataFrame:
    """(id, n, s: ``pack`` of the set) of the classes in ``wanted`` (id, t: the hash of one of its texts), written."""

    def describe(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s)[0] for s in sets], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(pack, sets), pa.binary())], ["id", "n", "s"])

    hashes = written(spark, wanted.select("t").distinct(), f"{folder}-texts")
    small = bytes_of(spark, f"{folder}-texts") <= BROADCAST_BYTES
    texts = docs.join(hashes.hint("broadcast" if small else "shuffle_hash"), "t", "left_semi").select("text")
    return written(spark, texts.mapInArrow(describe, "id long, n long, s binary").dropDuplicates(["id"]), f"{folder}-sets")


def _passing(spark: SparkSession, docs: DataFrame, pairs: DataFrame, node: DataFrame, folder: str, shingle: int, pack, test) -> DataFrame:
    """The pairs (a, b of classes) for which ``test`` of both sizes and packed sets holds."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _described(spark, docs, ids.join(node.select("id", "t").hint("merge"), "id"), folder, shingle, pack)
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")).hint("merge")

    def judge(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            mask = pa.array([test(m, n, x.as_py(), y.as_py()) for m, n, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    out = written(spark, both.mapInArrow(judge, "a long, b long"), f"{folder}-passed")
    drop(spark, f"{folder}-sets")
    return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact test of two sets."""
    z = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((z[1:] == z[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, node: DataFrame, folder: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b of classes) whose sets are linked: the Hamming bound on wide sketches first, then the sets."""

    def close(m: int, n: int, x: bytes, y: bytes) -> bool:
        return hamming(x, y) <= m + n - 2 * -(-percent * (m + n) // (100 + percent))

    def linked(m: int, n: int, x: bytes, y: bytes) -> bool:
        return _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)

    pairs = _passing(spark, docs, written(spark, pairs, f"{folder}/candidates"), node, f"{folder}/wide", shingle, wide_sketch, close)
    return _passing(spark, docs, pairs, node, f"{folder}/exact", shingle, np.ndarray.tobytes, linked)


class _Unit:
    """Sets of one chunk of open members; what they are compared with streams by. Remembers which components have met."""

    def __init__(self, percent: int):
        self.percent, self.sets, self.parent = percent, [], {}
        self.own: list[int] = []
        self.roots = None

    def add(self, component: int, data: bytes) -> None:
        self.sets.append(np.frombuffer(data, np.uint64))
        self.own.append(component)

    def root(self, c: int) -> int:
        while (up := self.parent.get(c, c)) != c:
            self.parent[c] = c = self.parent.get(up, up)
        return c

    def close(self) -> None:
        """All open members are there."""
        self.n = np.array(list(map(len, self.sets)), np.int64)
        self.sketch = np.array([folded(s) for s in self.sets], np.uint64).reshape(-1, FOLD)
        self.roots = np.array(list(map(self.root, self.own)), np.int64)

    def meet(self, components: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Pairs of components that are linked and that this unit has not joined before."""
        n, percent = np.array(list(map(len, sets)), np.int64), self.percent
        sketch = np.array([folded(s) for s in sets], np.uint64).reshape(-1, FOLD)
        far = np.zeros((len(sets), len(self.sets)), np.int64)
        for k in range(FOLD):
            far += np.bitwise_count(sketch[:, k][:, None] ^ self.sketch[:, k][None, :])
        t = n[:, None] + self.n[None, :]
        near = (far <= t - 2 * ((percent * t + 99 + percent) // (100 + percent))) & (100 * np.minimum(n[:, None], self.n[None, :]) >= percent * np.maximum(n[:, None], self.n[None, :]))
        for k in np.flatnonzero(near.any(axis=1)):
            mine, left = self.root(components[k]), np.flatnonzero(near[k])
            while len(left := left[self.roots[left] != mine]):
                i, left = int(left[0]), left[1:]
                if _linked(sets[k], self.sets[i], percent):
                    other = int(self.roots[i])
                    yield min(mine, other), max(mine, other)
                    self.parent[other] = mine
                    self.roots[self.roots == other] = mine


class _Sketches:
    """Wide sketches of one chunk of open members, by length; what they are compared with streams by."""

    def __init__(self, percent: int):
        self.percent, self.rows, self.parts = percent, [], None

    def add(self, key: int, component: int, n: int, sketch: bytes) -> None:
        self.rows.append((key, component, n, np.frombuffer(sketch, np.uint64)))

    def near(self, component: int, n: int, sketch: bytes) -> bool:
        """Whether any of another component may be linked; those that may are remembered in ``hits``."""
        if self.parts is None:
            by: dict[int, list] = {}
            for k, r in enumerate(self.rows):
                by.setdefault(len(r[3]), []).append(k)
            self.parts = [(np.array(at), np.stack([self.rows[k][3] for k in at]), np.array([self.rows[k][2] for k in at]), np.array([self.rows[k][1] for k in at])) for at in by.values()]
            self.hits = np.zeros(len(self.rows), bool)
            self.least = [(int(p[2].min()), int(p[2].max())) for p in self.parts]
        y, found = np.frombuffer(sketch, np.uint64), False
        for (at, x, sizes, own), (lo, hi) in zip(self.parts, self.least):
            if 100 * n < self.percent * lo or 100 * hi < self.percent * n:
                continue
            fit = np.flatnonzero((100 * np.minimum(sizes, n) >= self.percent * np.maximum(sizes, n)) & (own != component))
            if not len(fit):
                continue
            w, t = min(len(y), x.shape[1]), sizes[fit] + n
            far = np.bitwise_count(np.bitwise_xor.reduce(x[fit].reshape(len(fit), -1, w), axis=1) ^ np.bitwise_xor.reduce(y.reshape(-1, w), axis=0)).sum(axis=1, dtype=np.int64)
            ok = far <= t - 2 * ((self.percent * t + 99 + self.percent) // (100 + self.percent))
            if ok.any():
                self.hits[at[fit[ok]]] = found = True
        return found


def _units(spark: SparkSession, m: DataFrame, packed: DataFrame, weight, folder: str) -> DataFrame:
    """(hub, i, j, side, id, component, n, s) of members (hub, id, component, n, open), dealt and sorted by units.

    The open members of a hub are dealt into chunks, all its members into others, and each pair of chunks is a unit of its
    own, wherever it runs: it holds its open ones (side 0), the others (side 1) stream by. Chunks follow ``weight``, the
    bytes of a packed set, so no task holds a group.
    """
    size = lambda which: F.sum(F.when(which, weight).otherwise(0))
    sums = m.groupBy("hub").agg(size(F.col("open")).alias("mine"), size(F.lit(True)).alias("all")).where("mine > 0")
    sums = written(spark, sums.select("hub", F.ceil(F.col("mine") / HELD_BYTES).alias("rows"), F.ceil(F.col("all") / MET_BYTES).alias("cols")), f"{folder}/chunks")
    few = "broadcast" if bytes_of(spark, f"{folder}/chunks") <= BROADCAST_BYTES else "merge"
    m = m.join(sums.hint(few), "hub")
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    zero = F.lit(0).cast("long")
    held = m.where("open").select("hub", "id", "component", F.lit(0).alias("side"), part("rows").alias("i"), F.explode(F.sequence(zero, F.col("cols") - 1)).alias("j"))
    met = m.select("hub", "id", "component", F.lit(1).alias("side"), F.explode(F.sequence(zero, F.col("rows") - 1)).alias("i"), part("cols").alias("j"))
    rows = held.union(met).join(packed.hint("merge"), "id").select("hub", "i", "j", "side", "id", "component", "n", "s")
    return rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side")


def _chosen(batches: Iterable, percent: int) -> Iterator:
    """Rows of units with wide sketches -> (hub, id) of the members that have a candidate in another component."""
    import pyarrow as pa

    key, unit, out = None, None, []

    def close():
        if unit is not None and unit.parts is not None:
            out.extend((key[0], unit.rows[k][0]) for k in np.flatnonzero(unit.hits))

    def send():
        made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["hub", "id"])
        out.clear()
        return made

    for b in batches:
        for hub, i, j, side, name, component, n, s in zip(*(c.to_pylist() for c in b.columns[:7]), b.column(7)):
            if (hub, i, j) != key:
                close()
                key, unit = (hub, i, j), _Sketches(percent)
            if side == 0:
                unit.add(name, component, n, s.as_py())
            elif unit.rows and unit.near(component, n, s.as_py()):
                out.append((hub, name))
        if out:
            yield send()
    close()
    if out:
        yield send()


def _compared(batches: Iterable, percent: int) -> Iterator:
    """Rows of units with sets -> links (a, b) between components."""
    import pyarrow as pa

    key, unit, waiting, out = None, None, ([], []), []

    def send():
        made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        out.clear()
        return made

    def meet():
        out.extend(unit.meet(*waiting))
        for w in waiting:
            w.clear()

    for b in batches:
        for hub, i, j, side, component, s in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3, 5)), b.column(7)):
            if (hub, i, j) != key:
                if waiting[0]:
                    meet()
                key, unit = (hub, i, j), _Unit(percent)
            if side == 0:
                unit.add(component, s.as_py())
                continue
            if not unit.sets:
                continue
            if unit.roots is None:
                unit.close()
            waiting[0].append(component)
            waiting[1].append(np.frombuffer(s.as_py(), np.uint64))
            if len(waiting[0]) >= MET_ROWS:
                meet()
        if out:
            yield send()
    if waiting[0]:
        meet()
    if out:
        yield send()


def rest_links(spark: SparkSession, docs: DataFrame, stars: DataFrame, labels: DataFrame, node: DataFrame, folder: str, shingle: int, percent: int) -> DataFrame:
    """Links (a, b of components) between open members of hubs' groups and all members of the same group.

    stars: (x: hub, y: member); labels: (id, component). A member is open if its component is not its hub's. Wide sketches
    tell first which members can have a link to another component at all, so sets are only sent for those.
    """
    of = lambda c, name: labels.select(F.col("id").alias(c), F.col("component").alias(name)).hint("merge")
    m = stars.join(of("x", "cx"), "x", "left").join(of("y", "cy"), "y", "left")
    m = m.select(F.col("x").alias("hub"), F.col("y").alias("id"), F.coalesce("cx", "x").alias("chub"), F.coalesce("cy", "y").alias("component")).withColumn("open", F.col("component") != F.col("chub"))
    some = written(spark, m.where("open").select("hub").distinct(), f"{folder}/hubs")
    few = "broadcast" if bytes_of(spark, f"{folder}/hubs") <= BROADCAST_BYTES else "merge"
    m = written(spark, m.join(some.hint(few), "hub", "left_semi").join(node.select("id", "n", "t").hint("merge"), "id").drop("chub"), f"{folder}/members")
    sketches = _described(spark, docs, m.select("id", "t"), f"{folder}/wide", shingle, wide_sketch)
    units = _units(spark, m.select("hub", "id", "component", "open", F.col("n").alias("size")), sketches, F.col("size") / 2 + 24, f"{folder}/sketched")
    chosen = written(spark, units.mapInArrow(lambda batches: _chosen(batches, percent), "hub long, id long").distinct(), f"{folder}/chosen")
    m = written(spark, m.join(chosen.hint("merge"), ["hub", "id"], "left_semi"), f"{folder}/kept")
    sets = _described(spark, docs, m.select("id", "t"), f"{folder}/whole", shingle, np.ndarray.tobytes)
    units = _units(spark, m.select("hub", "id", "component", "open", F.col("n").alias("size")), sets, 8 * F.col("size"), f"{folder}/compared")
    out = written(spark, units.mapInArrow(lambda batches: _compared(batches, percent), "a long, b long").distinct(), f"{folder}/links")
    drop(spark, f"{folder}/wide-sets")
    drop(spark, f"{folder}/whole-sets")
    return out


def jaccard_components(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, for a similarity of ``percent`` (75 to 100) hundredths or more."""
    if shingle < 1 or not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"shingle must be positive and percent between {LEAST_PERCENT} and 100")
    small_batches(spark)
    folder = shared_dir(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    n_buckets = max(1, -(-(n_bytes + 64 * n_docs) // BUCKET_BYTES))
    rows = docs.mapInArrow(_described_and_packed(n_buckets, shingle, percent), ROW).repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    groups = written(spark, rows.mapInArrow(_pair_bucket, "kind int, x long, y long, doc_id long, n long, t long, sketch array<long>"), f"{folder}/groups")
    meta = groups.where("kind = 2").select("doc_id", F.col("x").alias("id"), "n", "t", "sketch")
    named = meta.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("least"), F.min_by(F.struct("n", "t", "sketch"), "t").alias("v"))
    node = written(spark, named.select("id", "least", "v.*"), f"{folder}/classes")
    ends = node.select("id", F.struct("n", "sketch").alias("v"))
    pairs = groups.where("kind < 2").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    pairs = pairs.join(ends.select(F.col("id").alias("a"), F.col("v").alias("p")).hint("merge"), "a").join(ends.select(F.col("id").alias("b"), F.col("v").alias("q")).hint("merge"), "b")
    links = verified(spark, docs.select("text", "t"), pairs.where(_near_enough("p", "q", percent)).select("a", "b"), node, f"{folder}/first", shingle, percent)
    labels = connected_components(spark, links)
    stars = groups.where("kind = 1").select("x", "y").distinct()
    if not stars.isEmpty():
        more = rest_links(spark, docs.select("text", "t"), stars, labels, node, f"{folder}/second", shingle, percent)
        # Links between components: only the components themselves are joined anew.
        further = connected_components(spark, more).select(F.col("id").alias("component"), F.col("component").alias("whole"))
        whole = labels.join(further.hint("merge"), "component", "full").select(F.coalesce("id", "component").alias("id"), F.coalesce("whole", "component").alias("component"))
        labels = written(spark, whole, f"{folder}/labels")
    # The smallest doc_id of a component names it; only classes with links are there.
    least = node.select("id", "least").join(labels.hint("merge"), "id").groupBy("component").agg(F.min("least").alias("name"))
    least = written(spark, least, f"{folder}/names")
    few = "broadcast" if bytes_of(spark, f"{folder}/names") <= BROADCAST_BYTES else "merge"
    linked = labels.join(least.hint(few), "component").select("id", F.struct("name").alias("v"))
    names = node.select("id", "least").join(linked.hint("merge"), "id", "left").select("id", F.when(F.col("v").isNotNull(), F.col("v.name")).otherwise(F.col("least")).alias("name"))
    out = meta.join(written(spark, names, f"{folder}/found").hint("merge"), "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with exactly one row of each component: the smallest doc_id (nulls last), then the smallest row number.

    Rows are numbered and written first and only named by their number, so repeated rows, rows without doc_id and different
    texts under one doc_id are told apart. Rows without words are in no component and all stay.
    """
    folder, row = shared_dir(spark), fresh(docs, "__row")
    rows = written(spark, docs.withColumn(row, F.monotonically_increasing_id()), f"{folder}/rows")
    found = jaccard_components(spark, rows.select(F.col(row).alias("doc_id"), "text"), shingle, percent)
    later = written(spark, found.where("doc_id <> component_id").select(F.col("doc_id").alias(row), F.col("component_id").alias("first")), f"{folder}/later")
    # Each component is named by its smallest row number; where another of its rows survives, the two change places.
    members = later.union(later.select(F.col("first").alias(row), "first").distinct())
    ids = members.join(rows.select(row, "doc_id").hint("merge"), row)
    best = ids.groupBy("first").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("n")))["n"].alias("best"))
    swaps = written(spark, best.where("best <> first"), f"{folder}/swaps")
    gone = later.select(row).join(swaps.select(F.col("best").alias(row)).hint("merge"), row, "left_anti").union(swaps.select("first"))
    gone = written(spark, gone, f"{folder}/gone")
    small = bytes_of(spark, f"{folder}/gone") <= BROADCAST_BYTES
    return rows.join(gone.hint("broadcast" if small else "shuffle_hash"), row, "left_anti").drop(row)
