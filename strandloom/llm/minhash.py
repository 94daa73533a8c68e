"""Near-duplicate documents by SuperMinHash.

A document's set holds the hashes of its distinct word shingles. In SuperMinHash every element
walks the signature's slots in the order of its own random permutation and offers, at step j, the
rank j plus a random fraction; a slot keeps the least offer. A step beyond the largest kept rank
can win nothing, so documents of some length stop after a step or two; here the steps run over
all elements of a batch at once, and a document leaves when no slot of it is empty.

Documents with equal sets are one class. Signatures are cut into bands; classes that agree in a
band share a bucket. A bucket's pairs are never enumerated. First every member is held against its
bucket's leader; buckets draw theirs by one of some orders, so that the bands of a large group try
several. In buckets above a tile, the members that stay outside the bucket's largest
component (strays) are held against further leaders of that component. A stray that still stays
apart is bounded: shingles that no other member of a large bucket has are in no intersection, so
the others tell with which set sizes 80 % can be reached at all; most strays reach none and are
done. The rest, and the strays of small buckets, meet the members of reachable size tile by tile:
signatures first, pairs above a safe estimate on full sets, the most alike first and only while
they lie in different components; a tile returns the links that join something, never pairs.
Union-find over the confirmed links gives the components.

Defined results: null, empty and blank texts have no shingles and link with nothing. Rows with the
same id stand for themselves. A row without an id has no component and is kept; it lends none its
id, and a set that only such rows have confirms no link. Ties: the smallest id represents a component.

Scale: the signature table holds a few hundred bytes a document. Copies collapse before any
pairing; buckets of one member never travel; each class carries its full set to one leader, the
one its signature agrees with most. The work on a bucket grows with its members, but for
strays of reachable size, whose pairs with members cost a comparison of signatures each. Full sets
are made anew from the texts, only of documents in candidate pairs or large buckets, which a bloom
filter of at most 16 MB picks (a join does where there are too many for it).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_batches, sorted_groups, staged, text_bytes, text_key
from .components import connected_components
from .words import WordHashes, mix64, shingle_hashes, space_words

WIDTH, BANDS, ROWS = 4, 24, 5
#: Signature agreement below which no pair of 80 % similarity falls (over five standard deviations).
SAFE_MARGIN = 0.2
TILE = 512
BLOOM_BITS = 1 << 27
#: Orders that draw buckets' leaders; leaders that the strays of a bucket above TILE are held against further.
LEADERS = 4
#: Sets of sizes within one class differ by this factor at most; a stray of any reach has some twenty classes.
SIZE_STEP = 1.02
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORDS = WordHashes()


def shingle_set(text: bytes, width: int = WIDTH, words: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes((_WORDS if words is None else words).array(space_words(text)), width))


def super_minhash(elements: np.ndarray, owner: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Signatures (n x slots, uint64) of n sets; ``owner`` (ascending) names each element's set.

    A value is the rank in the upper 16 bits and the fraction in the lower 48.
    """
    signature = np.full(n * slots, _EMPTY, dtype=np.uint64)
    base, own = elements, owner.astype(np.int64)
    swaps: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while len(base) and step < slots:
        if step == 4:
            _by_permutation(signature, base, own, slots, step, swaps)
            break
        r = mix64(base + _seed(step))
        at = ((r >> np.uint64(32)) % np.uint64(slots - step)).astype(np.int64) + step
        np.minimum.at(signature, own * slots + _content(at, swaps), _offer(r, step))
        swaps.append((at, _content(np.full_like(at, step), swaps)))
        step += 1
        open_ = (signature.reshape(n, slots) == _EMPTY).any(axis=1)[own]
        base, own = base[open_], own[open_]
        swaps = [(k[open_], v[open_]) for k, v in swaps]
    return signature.reshape(n, slots)


def _seed(step: int) -> np.uint64:
    return np.uint64(int(_STEP) * (step + 1) & 0xFFFFFFFFFFFFFFFF)


def _offer(r: np.ndarray, step: int) -> np.ndarray:
    return (np.uint64(step) << np.uint64(48)) | (mix64(r) >> np.uint64(16))


def _content(position: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What the permutation holds at ``position`` after the swaps (place swapped to, value put there)."""
    out = position
    for place, value in swaps:
        out = np.where(place == position, value, out)
    return out


def _by_permutation(signature: np.ndarray, base: np.ndarray, own: np.ndarray, slots: int, step: int, swaps) -> None:
    """The remaining steps for the few elements of short documents, with permutations held whole."""
    for at in range(0, len(base), 50_000):
        part = slice(at, at + 50_000)
        b, o = base[part], own[part]
        rows = np.arange(len(b))
        order = np.tile(np.arange(slots, dtype=np.int64), (len(b), 1))
        for i, (k, _) in enumerate(swaps):
            k = k[part]
            order[rows, i], order[rows, k] = order[rows, k], order[rows, i].copy()
        for j in range(step, slots):
            r = mix64(b + _seed(j))
            k = ((r >> np.uint64(32)) % np.uint64(slots - j)).astype(np.int64) + j
            order[rows, j], order[rows, k] = order[rows, k], order[rows, j].copy()
            np.minimum.at(signature, o * slots + order[:, j], _offer(r, j))


def band_keys(short: np.ndarray, bands: int) -> np.ndarray:
    """The bands' keys (n x bands, int64) of short signatures."""
    slots = short.astype(np.uint64).reshape(len(short), bands, -1)
    keys = np.zeros((len(short), bands), dtype=np.uint64)
    for r in range(slots.shape[2]):
        keys = mix64(keys * np.uint64(0x100000001B3) + slots[:, :, r])
    return mix64(keys + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)


def sketch(docs: DataFrame, *, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: _id, _key, n_shingles, node (hash of the set; null if empty), bands, sig (16 bits a slot)."""
    slots = bands * rows

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in text_bytes(batch.column("_text"))]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            elements = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            signature = super_minhash(elements, np.repeat(np.arange(len(sets)), sizes), len(sets), slots)
            mixed = mix64(elements + _STEP)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            total = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
            node = mix64(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(np.uint64)).view(np.int64)
            short = (mix64(signature) >> np.uint64(48)).astype(np.uint16)
            keys = band_keys(short, bands)
            empty = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_key"),
                    pa.array(sizes),
                    pa.array(node, mask=empty),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.ravel())),
                    pa.array([row.tobytes() for row in short], pa.binary()),
                ],
                ["_id", "_key", "n_shingles", "node", "bands", "sig"],
            )

    return docs.withColumn("_key", text_key("_text")).mapInArrow(run, "_id long, _key long, n_shingles long, node long, bands array<long>, sig binary")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept. Options: width, percent, bands, rows."""
    return near_duplicate_rows(docs, id_col=id_col, text_col=text_col, **options).drop("text_key")


def near_duplicate_rows(docs: DataFrame, *, id_col: str, text_col: str, width: int = WIDTH, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As ``near_duplicates``, with text_key (a hash of the text), which tells rows of one id apart."""
    small_batches(docs.sparkSession)
    texts = id_text(docs, id_col, text_col)
    sketches = staged(sketch(texts, width=width, bands=bands, rows=rows), "minhash-sketches")
    nodes = staged(sketches.where("node IS NOT NULL").groupBy("node").agg(F.min("_id").alias("least"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "minhash-nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = staged(members.groupBy("bucket").agg(_drawn(F.pmod("bucket", F.lit(LEADERS))).alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-buckets")
    shared_bucket = held_by(buckets.select("bucket"))  # most buckets have one member, which need not travel to learn so
    placed = staged(members.where(shared_bucket("bucket")).join(buckets, "bucket"), "minhash-placed")
    estimate = percent / 100 - SAFE_MARGIN

    #: Only classes that share a bucket are ever compared; the others' signatures never travel again.
    signed = staged(nodes.join(placed.select("node").distinct(), "node", "left_semi").select("node", "size", "sig"), "minhash-signed")
    led = placed.groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg((F.min("n") == 2).alias("alone"))
    led = staged(_alike(led, signed, estimate), "minhash-alike")
    pairs = staged(led.where("alone").select("a", "b").union(_best(led.where("NOT alone"))), "minhash-pairs")
    hot = staged(placed.where(F.col("n") > TILE).select("node").distinct(), "minhash-hot")
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(hot).distinct(), nodes, texts, width)
    component = staged(connected_components(confirm(pairs, sets, percent)), "minhash-components")
    reach = None
    if not hot.isEmpty():
        shared = staged(shared_shingles(sets.join(hot, "node", "left_semi")), "minhash-shared")
        strays = _strays(placed.where(F.col("n") > TILE), component, LEADERS, shared.join(signed.select("node", "size"), "node"))
        more = strays.where("stray").select(F.explode("leaders").alias("a"), F.col("node").alias("b")).distinct().withColumn("alone", F.lit(False))
        component = _merged(component, confirm(staged(_best(_alike(more, signed, estimate)), "minhash-pairs"), sets, percent))
        strays = _strays(placed.where(F.col("n") > TILE), component, 0).where("stray").select("node").distinct()
        reach = staged(reachable(strays, shared, signed, percent), "minhash-reach")

    tiles = Tiles(placed, signed, component, reach, bands)
    near = staged(tiles.near(estimate), "minhash-near")
    if not near.isEmpty():
        sets = full_sets(near.select("node").distinct(), nodes, texts, width)
        component = _merged(component, staged(tiles.links(near, sets, estimate, percent), "minhash-links"))

    own = staged(nodes.select("node", "least").join(component, "node", "left").select("node", "least", F.coalesce("component", "node").alias("c")), "minhash-own")
    smallest = staged(own.groupBy("c").agg(F.min("least").alias("smallest")), "minhash-smallest")
    named = staged(own.join(smallest, "c").select("node", "smallest"), "minhash-named")
    out = sketches.select("_id", "_key", "n_shingles", "node").join(named, "node", "left")
    named = F.when(F.col("_id").isNotNull(), F.coalesce("smallest", "_id"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_key").alias("text_key"), "n_shingles", named.alias("component_id"), F.coalesce(F.col("_id") == named, F.lit(True)).alias("kept"))


def _drawn(seed):
    """The member of a bucket that comes first in the order of a seed's hash: buckets of one group and seed agree on few."""
    return F.min_by("node", F.xxhash64("node", seed))


def _best(pairs: DataFrame) -> DataFrame:
    """Of each b its pair with the most agreement. The others are not lost: where it does not link, the members of buckets of three and more meet in tiles."""
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("share", "a")).alias("a")).select("a", "b")


def _strays(placed: DataFrame, component: DataFrame, leaders: int, shared: DataFrame | None = None) -> DataFrame:
    """Per bucket and member: n, node, c (component), stray (outside the bucket's largest component), leaders of that one.

    Every other leader is drawn; the rest are those with the fewest shingles of their own by
    ``shared`` (node, size, shared), ties drawn: what lies in the middle of a group links with more of it.
    """
    comp = placed.join(component, "node", "left").select("bucket", "n", "node", F.coalesce("component", "node").alias("c"))
    own = F.lit(0)
    if shared is not None:
        comp, own = comp.join(shared, "node", "left"), F.col("size") - F.col("shared")
    comp = staged(comp, "minhash-comp")
    central = lambda k: F.min_by("node", F.struct(own, F.xxhash64("node", F.lit(k))))
    held = comp.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("held"), F.array(*(_drawn(F.lit(k)) if k % 2 else central(k) for k in range(leaders))).cast("array<bigint>").alias("leaders"))
    lead = staged(held.groupBy("bucket").agg(F.max_by(F.struct("c", "leaders"), F.struct("held", "c")).alias("lead")), "minhash-lead")
    return staged(comp.join(lead, "bucket").select("bucket", "n", "node", "c", (F.col("c") != F.col("lead.c")).alias("stray"), F.col("lead.leaders").alias("leaders")), "minhash-strays")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """Per node: shared, the number of its shingles that another of the sets holds.

    Shingles travel packed, dealt by their hash; a part holds about two million.
    """
    total = sets.agg(F.coalesce(F.sum(F.octet_length("set")), F.lit(0))).first()[0] // 8
    parts = max(8, -(-total // 2_000_000))

    def deal(batches):
        for batch in batches:
            found = [np.frombuffer(s, dtype=np.uint64) for s in batch.column("set").to_pylist()]
            if not found:
                continue
            node = np.repeat(batch.column("node").to_numpy(), [len(s) for s in found])
            shingle = np.concatenate(found)
            part = (mix64(shingle) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            node, shingle, part = node[order], shingle[order], part[order]
            run = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (node[1:] != node[:-1]))))
            length = np.diff(np.append(run, len(part))).astype(np.uint32)
            here, first = np.unique(part[run], return_index=True)
            runs = [*first.tolist(), len(run)]
            ends = [*run[first].tolist(), len(part)]
            slices = [[x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] for x, at in ((node[run], runs), (length, runs), (shingle, ends))]
            yield pa.RecordBatch.from_arrays([pa.array(here), *(pa.array(x, pa.binary()) for x in slices)], ["part", "nodes", "lengths", "shingles"])

    def count(batches):
        for _, group in sorted_groups(batches, 1):
            node, length, shingle = (np.frombuffer(b"".join(group.column(k).to_pylist()), dtype=t) for k, t in (("nodes", np.int64), ("lengths", np.uint32), ("shingles", np.uint64)))
            _, which, times = np.unique(shingle, return_inverse=True, return_counts=True)
            names, at = np.unique(node, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(np.repeat(at, length), weights=times[which] > 1).astype(np.int64))], ["node", "shared"])

    dealt = sets.mapInArrow(deal, "part long, nodes binary, lengths binary, shingles binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(count, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))


def reachable(strays: DataFrame, shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Per stray: least and most, the set sizes with which a link is possible (most < least: with none).

    Of sizes n and m and an intersection of s at most: 100 s >= percent (n + m - s).
    """
    n, s = F.col("size"), F.coalesce(F.col("shared"), F.lit(0))
    most = F.least(F.floor(n * 100 / percent), F.floor(s * (100 + percent) / percent) - n)
    return strays.join(nodes.select("node", "size"), "node").join(shared, "node", "left").select("node", F.ceil(n * percent / 100).alias("least"), most.alias("most"))


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links between nodes."""
    at_a, at_b = (component.select(F.col("node").alias(x), F.col("component").alias(f"{x}_c")) for x in "ab")
    moved = connected_components(links.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")))
    old = component.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return staged(old.unionByName(moved.join(component, "node", "left_anti")), "minhash-components")


def _alike(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, alone, share) of the pairs (a, b, alone) whose signatures agree in a share of ``least`` or more slots."""
    at_a, at_b = (nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(f"sig_{x}").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for x in "ab")
                share = (a == b).mean(axis=1)
                yield batch.select(["a", "b", "alone"]).append_column("share", pa.array(share)).filter(pa.array(share >= least))

    return pairs.where("a <> b").join(at_b, "b").join(at_a, "a").select("a", "b", "alone", "sig_a", "sig_b").mapInArrow(run, "a long, b long, alone boolean, share double")


class Tiles:
    """The buckets that join several components, cut into tiles of about TILE strays by TILE members.

    Strays are members outside their bucket's largest component; only they are held against the
    bucket, in buckets above TILE only those with a ``reach`` (node, least, most), and there against
    members of those sizes. Two members meet in the first bucket they share. ``near`` finds by
    signatures who may have a link across components; ``links`` confirms such pairs on full sets,
    the most alike first, those that are joined already left out, and returns the links that join
    something: no more than a tile has rows.
    """

    COLUMNS = ("bucket", "x", "y", "side", "node")

    def __init__(self, placed: DataFrame, nodes: DataFrame, component: DataFrame, reach: DataFrame | None, bands: int):
        rows = _strays(placed.where("n > 2"), component, 0).drop("leaders")
        size_class = lambda size: F.floor(F.log(SIZE_STEP, F.greatest(size, F.lit(1)))).cast("int")
        cold = rows.where(F.col("n") <= TILE).withColumn("k", F.lit(0))
        strays = cold.where("stray")
        if reach is not None:
            warm = rows.where(F.col("n") > TILE)
            own = warm.join(nodes.select("node", "size"), "node").withColumn("k", size_class(F.col("size"))).drop("size")
            far = warm.where("stray").join(reach.where("most >= least"), "node")
            far = far.withColumn("k", F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most"))))).drop("least", "most")
            rows, strays = cold.unionByName(own), strays.unionByName(far)
        else:
            rows = cold
        strays = staged(strays, "minhash-far")
        n = staged(rows.groupBy("bucket", "k").agg(F.count(F.lit(1)).alias("n")), "minhash-tiles")
        r = strays.groupBy("bucket", "k").agg(F.count(F.lit(1)).alias("r"))
        sizes = staged(n.join(r, ["bucket", "k"]).select("bucket", "k", F.ceil(F.col("n") / TILE).cast("int").alias("n_tiles"), F.ceil(F.col("r") / TILE).cast("int").alias("r_tiles")), "minhash-tiles")
        tile = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        of_class = lambda x: (F.col("k").cast("long") * (1 << 32) + F.col(x)).alias(x)
        out = ("bucket", of_class("x"), of_class("y"), "side", "node", "c")
        all_ = rows.drop("n").join(sizes, ["bucket", "k"]).withColumn("y", tile("n_tiles", 1)).withColumn("x", every("r_tiles")).withColumn("side", F.lit(1)).select(*out)
        some = strays.drop("n").join(sizes, ["bucket", "k"]).withColumn("x", tile("r_tiles", 2)).withColumn("y", every("n_tiles")).withColumn("side", F.lit(0)).select(*out)
        self.rows, self.nodes, self.bands = all_.unionByName(some), nodes, bands

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def near(self, least: float) -> DataFrame:
        """(tile, side, node, c) of all that have a partner of another component alike enough."""

        def run(batches):
            for (bucket, x, y), group in sorted_groups(batches, 3):
                side, node, c = (group.column(k).to_numpy() for k in ("side", "node", "c"))
                keep = np.zeros(len(side), dtype=bool)
                for i, hit, _ in _partners(group, bucket, n_bands, side, node, c, least):
                    keep[i] = True
                    keep[hit] = True
                if keep.any():
                    n = int(keep.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([bucket] * n, pa.int64()), pa.array([x] * n, pa.int64()), pa.array([y] * n, pa.int64()), pa.array(side[keep]), pa.array(node[keep]), pa.array(c[keep])], [*self_columns, "c"])

        self_columns, n_bands = self.COLUMNS, self.bands
        signed = self.rows.join(self.nodes.select("node", "sig"), "node").select(*self.COLUMNS, "c", "sig")
        return self._dealt(signed).mapInArrow(run, "bucket long, x long, y long, side int, node long, c long")

    def links(self, near: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
        """(a, b): confirmed links between members of different components, a spanning forest of each tile's."""

        def run(batches):
            for (bucket, _, _), group in sorted_groups(batches, 3):
                side, node, c = (group.column(k).to_numpy() for k in ("side", "node", "c"))
                sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("set").to_pylist()]
                pairs = [(-s, i, j) for i, hit, share in _partners(group, bucket, n_bands, side, node, c, least) for j, s in zip(hit.tolist(), share.tolist(), strict=True)]
                parent: dict[int, int] = {}

                def find(v: int, parent=parent) -> int:
                    while (up := parent.get(v, v)) != v:
                        parent[v] = v = parent.get(up, up)
                    return v

                a, b = [], []
                for _, i, j in sorted(pairs):
                    p, q = find(int(c[i])), find(int(c[j]))
                    if p != q:
                        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                            parent[p] = q
                            a.append(node[i])
                            b.append(node[j])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        n_bands = self.bands
        signed = near.join(self.nodes.select("node", "sig"), "node").join(sets, "node").select(*self.COLUMNS, "c", "sig", "set")
        return self._dealt(signed).mapInArrow(run, "a long, b long")


def _partners(group: pa.Table, bucket: int, n_bands: int, side: np.ndarray, node: np.ndarray, c: np.ndarray, least: float):
    """Of each stray of a tile: (its row, rows of partners of other components, their signatures' agreement)."""
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint16).reshape(len(side), -1)
    bands = band_keys(sig, n_bands)
    at = (bands == bucket).argmax(axis=1)
    earlier = np.arange(bands.shape[1])[None, :] < at[:, None]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for i in left.tolist():
        share = (sig[right] == sig[i]).mean(axis=1)
        ok = (share >= least) & (c[right] != c[i]) & (node[right] != node[i])
        hit, share = right[ok], share[ok]
        first = ~((bands[hit] == bands[i]) & earlier[hit]).any(axis=1)
        if first.any():
            yield i, hit[first], share[first]


def bloom(ids: DataFrame, most_bits: int = BLOOM_BITS) -> np.ndarray:
    """Bit table (bool bytes packed) of a one-column id frame; its size follows the ids up to 16 MB."""
    n = ids.count()
    bits = min(most_bits, 1 << max(13, int(np.ceil(np.log2(max(1, 16 * n))))))

    def run(batches):
        table = np.zeros(bits, dtype=bool)
        for batch in batches:
            for slot in bloom_slots(batch.column(0).to_numpy(), bits):
                table[slot] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["table"])

    out = np.zeros(bits // 8, dtype=np.uint8)
    for (part,) in ids.repartition(8).mapInArrow(run, "table binary").toLocalIterator():
        out |= np.frombuffer(part, dtype=np.uint8)
    return out


def bloom_slots(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix64(ids.astype(np.int64).view(np.uint64) + _STEP)
    return [(h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)]


def bloom_holds(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be one of those a table was made of; an id that is one always is."""
    keep = np.ones(len(ids), dtype=bool)
    for slot in bloom_slots(ids, len(packed) * 8):
        keep &= (packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
    return keep


def held_by(ids: DataFrame):
    """A condition on a long column without nulls: whether a one-column frame may hold it, never false where it does.

    It thins what an exact join by the same column then shuffles. Its table has at most 16 MB;
    beyond some eight million ids it lets more through, and the join alone decides as before.
    """
    shared = ids.sparkSession.sparkContext.broadcast(bloom(ids))

    @F.arrow_udf("boolean")
    def held(x: pa.Array) -> pa.Array:
        return pa.array(bloom_holds(shared.value, x.to_numpy(zero_copy_only=False)))

    return held


def full_sets(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, set) of the nodes, made from the text of the smallest id of each."""
    wanted = wanted.join(nodes.select("node", "least"), "node").where("least IS NOT NULL")
    wanted = staged(wanted, "minhash-wanted")
    spark = texts.sparkSession
    if wanted.count() > BLOOM_BITS >> 4:
        texts = texts.join(wanted.select(F.col("least").alias("_id")), "_id", "left_semi")
    shared = spark.sparkContext.broadcast(bloom(wanted.select("least")))

    def run(batches):
        packed = shared.value
        for batch in batches:
            batch = batch.filter(batch.column("_id").is_valid())
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(bloom_holds(packed, batch.column("_id").to_numpy())))
            sets = [shingle_set(t, width) for t in text_bytes(batch.column("_text"))]
            node = [int(mix64(np.array([mix64(s + _STEP).sum(dtype=np.uint64) + np.uint64(len(s))])).view(np.int64)[0]) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    made = texts.mapInArrow(run, "node long, set binary").join(wanted.select("node"), "node", "left_semi")
    return staged(made.dropDuplicates(["node"]), "minhash-sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose full sets share ``percent`` of their union or more."""
    at_a, at_b = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return staged(pairs.join(at_b, "b").join(at_a, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "minhash-links")


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, one of each near-duplicate component: the smallest id.

    Rows without an id stay. Rows of one id are told apart by their texts: those stay whose component
    is named after the id, so a unique text stays whatever else bears its id. Equal rows stay or go together.
    """
    found = near_duplicate_rows(docs, id_col=id_col, text_col=text_col, **options)
    gone = staged(found.where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")).distinct(), "minhash-gone")
    # texts that surely stay are not shuffled for the join
    row_id, row_text = docs[id_col].cast("long"), text_key(text_col)
    maybe = held_by(gone.select(F.xxhash64("_gone", "_gone_key")))(F.xxhash64(row_id, row_text))
    left = docs.where(maybe).join(gone, (row_id == gone["_gone"]) & (row_text == gone["_gone_key"]), "left_anti")
    return docs.where(~maybe).unionByName(left)
