"""Jaccard join of word shingles by partition-and-enumerate signatures."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import mix, shingle_set
from ._components import components
from ._registry import keep, query, table

WORDS = 5
#: A pair links when 100 times its intersection is at least this many times its union.
PERCENT = 75
#: Sets below this size have a part for every feature; bands above it are this much wider than the last.
SMALL, RATIO = 64, 4
#: Parts of a group, and how many of them a signature covers.
GROUP, COVER = 1, 1
#: Cells of the table of signature frequencies, and how many of them travel in one row.
CELL_BITS, CHUNK_BITS = 22, 13
#: Bits of the filter that passes the texts of candidate pairs.
FILTER_BITS = 23
#: Buckets above this size are compared in blocks of about so many members, or features where these are many.
SMALL_BUCKET, BLOCK, BLOCK_FEATURES = 16, 256, 1 << 19
#: Turns of candidates: by leaders, and in the last one all pairs that are still apart.
TURNS = 3
_C1, _C2, _C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def instances(n: int) -> list[tuple[int, int, int]]:
    """``(band, parts, budget)`` of a set of size ``n``.

    Linked sets of sizes r <= s have s <= 4r/3 and differ in at most (r + s) /
    7 features. Such a pair is found in the band of its smaller set, so a set
    also takes part in the band below when a set there may be its partner.
    ``budget`` bounds the features that differ, ``parts`` the parts into which
    the band's instance deals the domain (0: every feature is a part).
    """
    band = 0
    while n >= SMALL * RATIO**band:
        band += 1
    own = (n + n * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
    out = [(band, _parts(band), own)]
    edge = SMALL * RATIO ** (band - 1)
    if band and n <= (edge - 1) * 100 // PERCENT:
        out.append((band - 1, _parts(band - 1), (n + edge - 1) * (100 - PERCENT) // (100 + PERCENT)))
    return out


def _parts(band: int) -> int:
    """Enough parts that even the largest set of the instance fills clearly more parts than may differ."""
    if not band:
        return 0
    largest = SMALL * RATIO**band * 100 / PERCENT
    return int((1.0 if largest < 512 else 0.7 if largest < 4096 else 0.5) * largest) // GROUP * GROUP


def signatures(features: np.ndarray, heavy: np.ndarray | None = None) -> np.ndarray:
    """Signatures of a set, such that any two linked sets share one.

    The domain is dealt into parts by a hash. A signature is what the set has
    in a subset of ``COVER`` out of ``GROUP`` parts; empty ones are left out.
    One feature that differs changes comb(GROUP - 1, COVER - 1) signatures, so
    of all signatures of a set at most budget times that many are missing in
    its partner, and whichever order both follow, their first budget times
    that many plus one have one in common. The order takes the rarest first:
    by the level of the signature's cell in ``heavy``, then by value. Without
    ``heavy`` all signatures are returned, for counting.
    """
    out = []
    for band, parts, budget in instances(features.size):
        salt = np.uint64((band + 1) * int(_C3) & (1 << 64) - 1)
        if not parts:
            found = mix(features ^ salt)
        else:
            part = ((mix(features ^ salt) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            value = np.zeros(parts, np.uint64)
            np.add.at(value, part.astype(np.int64), mix(features + _C1))
            grid = value.reshape(-1, GROUP)
            place = np.arange(len(grid), dtype=np.uint64) * _C2
            found = []
            for i, chosen in enumerate(combinations(range(GROUP), COVER)):
                picked = grid[:, chosen]
                sums = mix(picked + np.array(chosen, np.uint64) * _C1 * (picked != 0)).sum(1, dtype=np.uint64)
                found.append(mix(sums + place + np.uint64(i) + salt)[(picked != 0).any(1)])
            found = np.concatenate(found)
        if heavy is not None:
            need = budget * comb(GROUP - 1, COVER - 1) + 1 if parts else budget + 1
            level = heavy[found >> np.uint64(64 - CELL_BITS)].astype(np.uint64)
            if found.size > need:
                found = found[np.argpartition(level << np.uint64(56) | found >> np.uint64(8), need - 1)[:need]]
        out.append(found)
    return np.concatenate(out)


def fingerprint(features: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a, b = mix(features).sum(dtype=np.uint64), mix(features ^ _C1).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


class _Seen:
    """Fingerprints of a task, forgotten when they are many."""

    def __init__(self):
        self.marks = set()

    def new(self, mark) -> bool:
        if mark in self.marks:
            return False
        if len(self.marks) > 500_000:
            self.marks.clear()
        self.marks.add(mark)
        return True


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            data = text.as_buffer() if text.is_valid else None
            yield i.as_py(), shingle_set(data.to_pybytes() if data is not None else b"", WORDS)


def sketch(features: np.ndarray) -> bytes:
    """Parities of a set's features over a power of two of cells, two cells and more for each feature."""
    cells = 64
    while cells < 2 * features.size:
        cells *= 2
    place = (mix(features ^ _C2) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the features in which two sets differ: each changes one parity.

    The larger sketch is folded, since its cells are a refinement of the smaller one's.
    """
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    if x.size < y.size:
        x, y = y, x
    if x.size > y.size:
        x = np.bitwise_xor.reduce(x.reshape(-1, y.size), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


_SET_SCHEMA = "doc_id long, n long, f1 long, f2 long, sketch binary, chunk int, hits binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, fingerprint and sketch per row; then how many signatures of this task fall into each cell."""
    cells, seen, rows = np.zeros(1 << CELL_BITS, np.uint32), _Seen(), []

    def batch_of(rows):
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            [x.split()[0] for x in _SET_SCHEMA.split(", ")],
        )

    for i, features in _sets(batches):
        mark = fingerprint(features)
        rows.append((i, features.size, *mark, sketch(features), None, None))
        if features.size and seen.new(mark):
            np.add.at(cells, (signatures(features) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        if len(rows) == 2048:
            yield batch_of(rows)
            rows = []
    for chunk, part in enumerate(cells.reshape(-1, 1 << CHUNK_BITS)):
        if part.any():
            rows.append((None, None, None, None, None, chunk, zlib.compress(part.tobytes(), 1)))
    if rows:
        yield batch_of(rows)


def _levels(group: pa.Table) -> pa.Table:
    """Frequency levels of a chunk of cells over all tasks, one byte a cell."""
    total = np.zeros(1 << CHUNK_BITS, np.uint64)
    for hits in group.column("hits"):
        total += np.frombuffer(zlib.decompress(hits.as_buffer()), np.uint32)
    level = np.minimum(255, np.rint(8 * np.log2(1 + total))).astype(np.uint8)
    return pa.table({"chunk": group.column("chunk")[:1], "level": pa.array([level.tobytes()], pa.binary())})


def _emit(heavy: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ids, sigs, held = _Seen(), [], [], 0
        for i, features in _sets(batches):
            if i is None or not features.size or not seen.new(fingerprint(features)):
                continue
            found = signatures(features, heavy)
            ids.append(np.full(found.size, i, np.int64))
            sigs.append(found.view(np.int64))
            held += found.size
            if held > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], ["sig", "doc"])
                ids, sigs, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], ["sig", "doc"])

    return emit


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar enough."""
    last, left = None, None
    for batch in batches:
        out = []
        for a, b, ta, tb in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b")), strict=True):
            key, data = a.as_py(), ta.as_buffer().to_pybytes()
            if data != last:
                last, left = data, shingle_set(data, WORDS)
            right = shingle_set(tb.as_buffer().to_pybytes(), WORDS)
            common = np.intersect1d(left, right, assume_unique=True).size
            if 100 * common >= PERCENT * (left.size + right.size - common):
                out.append((key, b.as_py()))
        cols = list(zip(*out, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their sketches do not rule out; a missing sketch rules out nothing."""
    for batch in batches:
        keep = []
        for na, nb, ka, kb in zip(*(batch.column(c) for c in ("n_a", "n_b", "k_a", "k_b")), strict=True):
            room = (na.as_py() + nb.as_py()) * (100 - PERCENT) // (100 + PERCENT)
            keep.append(not (ka.is_valid and kb.is_valid) or least_difference(ka.as_buffer(), kb.as_buffer()) <= room)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _parities(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _fold(rows: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_xor.reduce(rows.reshape(len(rows), -1, width), axis=1) if rows.shape[1] > width else rows


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text, sorted."""
    for batch in batches:
        for doc, text in zip(batch.column("doc"), batch.column("text"), strict=True):
            data = shingle_set(text.as_buffer().to_pybytes(), WORDS).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([data], pa.binary())], ["doc", "features"])


class _Joined:
    """Components of the members of two blocks, merged by the links found between them."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, c: int) -> int:
        while (p := self.up.get(c, c)) != c:
            self.up[c] = self.up.get(p, p)
            c = p
        return c

    def merge(self, c: int, d: int) -> bool:
        c, d = self.root(c), self.root(d)
        self.up[max(c, d)] = min(c, d)
        return c != d


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of one bucket, links that connect their members as far as they are linked, at most one per member.

    Sizes and sketches rule out most pairs; a member then meets all that are
    left of the other block and of other components at once, whole sets.
    """
    for batch in batches:
        for row in batch.to_pylist():
            xs, ys = ([(m["doc"], m["comp"], np.frombuffer(m["features"], np.uint64)) for m in row[c]] for c in ("x", "y"))
            joined, out = _Joined(), []
            sizes = np.array([f.size for _, _, f in ys])
            sketches = [sketch(f) for _, _, f in ys]
            widths = {w: np.flatnonzero([len(k) == w for k in sketches]) for w in {len(k) for k in sketches}}
            tables = {w: _parities([sketches[i] for i in at]) for w, at in widths.items()}
            for i, (doc, comp, mine) in enumerate(xs):
                home = joined.root(comp)
                rest = np.array([joined.root(c) != home for _, c, _ in ys])
                if row["same"]:
                    rest[: i + 1] = False
                room = (mine.size + sizes) * (100 - PERCENT) // (100 + PERCENT)
                rest &= np.abs(mine.size - sizes) <= room
                if not rest.any():
                    continue
                own = _parities([sketch(mine)])
                for w, at in widths.items():
                    some = at[rest[at]]
                    if some.size:
                        width = min(own.shape[1], tables[w].shape[1])
                        gap = np.bitwise_count(_fold(own, width) ^ _fold(tables[w][rest[at]], width)).sum(1)
                        rest[some[gap > room[some]]] = False
                left = np.flatnonzero(rest)
                if not left.size:
                    continue
                other = np.concatenate([ys[j][2] for j in left])
                at = np.minimum(np.searchsorted(mine, other), mine.size - 1)
                first = np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
                common = np.add.reduceat((mine[at] == other).astype(np.int64), first)
                for j in left[100 * common >= PERCENT * (mine.size + sizes[left] - common)]:
                    if joined.merge(comp, ys[j][1]):
                        out.append((min(doc, ys[j][0]), max(doc, ys[j][0])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def _parities(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _fold(rows: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_xor.reduce(rows.reshape(len(rows), -1, width), axis=1) if rows.shape[1] > width else rows


def _block_active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of one bucket, the members with a member of another component that sizes and sketches do not rule out."""
    for batch in batches:
        for row in batch.to_pylist():
            found = set()
            by_size = [{}, {}]
            for side, name in enumerate(("x", "y")):
                for m in row[name]:
                    by_size[side].setdefault(len(m["sketch"] or b""), []).append(m)
            for wide, xs in by_size[0].items():
                for narrow, ys in by_size[1].items():
                    nx, ny = (np.array([m["n_max"] for m in ms]) for ms in (xs, ys))
                    apart = np.array([m["comp"] for m in xs])[:, None] != np.array([m["comp"] for m in ys])[None, :]
                    if wide and narrow:
                        a, b = _parities([m["sketch"] for m in xs]), _parities([m["sketch"] for m in ys])
                        width = min(a.shape[1], b.shape[1])
                        a, b = _fold(a, width), _fold(b, width)
                        room = (nx[:, None] + ny[None, :]) * (100 - PERCENT) // (100 + PERCENT)
                        apart &= np.abs(nx[:, None] - ny[None, :]) <= room
                        for i in np.flatnonzero(apart.any(1)):
                            apart[i] &= np.bitwise_count(a[i] ^ b).sum(1) <= room[i]
                    found.update(xs[i]["doc"] for i in np.flatnonzero(apart.any(1)))
                    found.update(ys[j]["doc"] for j in np.flatnonzero(apart.any(0)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([row["sig"]] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())], ["sig", "doc"])


def _met(view: DataFrame, members: DataFrame, columns: list[str], most: int, name: str) -> DataFrame:
    """Blocks of large buckets ``(sig, doc, comp, n_max)`` that meet: ``sig, x, y, same``.

    Of buckets with the same members one is looked at. Its members are dealt
    by a hash into blocks of about ``BLOCK`` of them and ``most`` features, with
    ``columns`` of ``members``; every two blocks that hold more than one
    component meet once.
    """
    of_sig = view.groupBy("sig").agg(
        F.count("*").alias("members"), F.sum("n_max").alias("features"),
        F.bit_xor(F.xxhash64("doc")).alias("one"), F.bit_xor(F.xxhash64(F.lit("other"), "doc")).alias("two"),
    )
    number = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("features") / most)).cast("int")
    chosen = keep(of_sig.groupBy("members", "features", "one", "two").agg(F.min("sig").alias("sig")).select("sig", number.alias("blocks")), f"{name}-large")
    dealt = view.select("sig", "doc", "comp").join(chosen, "sig").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    blocks = keep(
        dealt.join(members, "doc").groupBy("sig", "block").agg(
            F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.collect_list(F.struct("doc", "comp", *columns)).alias("m")
        ), f"{name}-blocks",
    )
    marks = blocks.select("sig", "block", "c0", "c1")
    second = marks.select("sig", F.col("block").alias("other"), F.col("c0").alias("o0"), F.col("c1").alias("o1"))
    apart = ~((F.col("c0") == F.col("c1")) & (F.col("o0") == F.col("o1")) & (F.col("c0") == F.col("o0")))
    pairs = marks.join(second, "sig").filter((F.col("block") <= F.col("other")) & apart).select("sig", "block", "other")
    x = blocks.select("sig", "block", F.col("m").alias("x"))
    y = blocks.select("sig", F.col("block").alias("other"), F.col("m").alias("y"))
    return pairs.join(x, ["sig", "block"]).join(y, ["sig", "other"]).select("sig", "x", "y", (F.col("block") == F.col("other")).alias("same"))


def block_links(view: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect what is linked inside large buckets ``(sig, doc, comp, n_max)``, no row for a pair without.

    Blocks meet twice: first with sketches, which leave the members that may
    have a partner in another component, then those alone with their whole
    sets, and send back as many links as they merge components.
    """
    near = _met(view, sketches.select("doc", "n_max", "sketch"), ["n_max", "sketch"], 1 << 62, "shingle-sketched")
    active = keep(near.mapInArrow(_block_active, "sig long, doc long").distinct(), "shingle-active")
    left = view.join(active, ["sig", "doc"])
    sets = keep(texts_of(docs, active.select("doc").distinct()).mapInArrow(_features, "doc long, features binary"), "shingle-features")
    return _met(left, sets, ["features"], BLOCK_FEATURES, "shingle-whole").select("x", "y", "same").mapInArrow(_block_links, "a long, b long").distinct()


def near_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets can be similar enough, by ``sketches`` of ``(doc, n_max, sketch)``.

    No pair that links is lost, since a sketch only ever hides differences.
    """
    side = lambda s: sketches.select(F.col("doc").alias(s), F.col("n_max").alias(f"n_{s}"), F.col("sketch").alias(f"k_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near, "a long, b long")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc, text)`` of the documents whose id is in ``ids (doc)``.

    A filter of a fixed number of bits, built in Spark and small enough to be
    broadcast at any size of the data, passes over most other texts before the
    join; the join alone decides.
    """
    place = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))
    bits = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    )
    rows = docs.select(F.col("doc_id").alias("doc"), "text").withColumn("p", place)
    rows = rows.withColumn("bucket", F.bitmap_bucket_number("p")).withColumn("at", F.bitmap_bit_position("p"))
    byte = F.conv(F.hex(F.substr("bits", (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = rows.join(F.broadcast(bits), "bucket").filter(
        F.shiftrightunsigned(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0
    )
    return rows.select("doc", "text").join(ids, "doc", "left_semi")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that link, by the whole texts of their documents."""
    ends = pairs.select(F.col("a").alias("doc")).unionAll(pairs.select(F.col("b").alias("doc"))).distinct()
    texts = keep(texts_of(docs, keep(ends, "shingle-ends")), "shingle-texts")
    right = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    return both.mapInArrow(_linked, "a long, b long")


def _side(name: str):
    return F.struct("doc", "n_min", "n_max", "comp").alias(name)


def _stars(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Links together with those that the labels so far stand for; a step on stars ends sooner."""
    return links if label is None else links.unionByName(label.select(F.col("id").alias("a"), F.col("root").alias("b")))


def classes(docs: DataFrame) -> DataFrame:
    """``docs`` rows as ``doc_id, n_shingles, component_id``.

    The set of a text is its distinct runs of five words, lower-cased A-Z; a
    shorter text is one run, a null or blank one has none and links with
    nothing. The component is the smallest id reachable by links, its own
    included. Rows with one id are one node, whatever their texts. Rows
    without an id are returned with a null component and link nothing. Other
    columns are ignored. Shingles are compared by 64-bit hashes.

    Equal sets meet by fingerprint. Different ones that share a signature are
    candidates: first each with the smallest id of its signature, then, as long
    as signatures hold more than one component, with the member of the largest
    degree, and at last every pair in different components, so that no link is
    lost: in small buckets as candidates, in large ones block against block,
    which gives back links that connect what is linked. Candidates that the
    parities of their sets do not rule out are verified on whole texts.
    """
    docs = docs.select("doc_id", "text")
    described = keep(docs.mapInArrow(_describe, _SET_SCHEMA), "shingle-sets")
    rows = described.filter("chunk is null").drop("chunk", "hits")
    levels = described.filter("chunk is not null").select("chunk", "hits").groupBy("chunk").applyInArrow(
        _levels, "chunk int, level binary"
    )
    heavy = np.zeros(1 << CELL_BITS, np.uint8)
    for r in levels.collect():  # one byte a cell, a fixed bound
        heavy[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(r["level"], np.uint8)

    # One document stands for each set; ids with several sets tie their classes together.
    rep = rows.filter("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    known = keep(
        rows.filter("n > 0 and doc_id is not null").join(rep, ["f1", "f2", "n"]).select("doc_id", "rep", "n", "sketch"), "shingle-reps"
    )
    equal = known.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()

    by_sig = Window.partitionBy("sig")
    shared = (
        docs.filter("doc_id is not null").mapInArrow(_emit(heavy), "sig long, doc long")
        .withColumn("many", F.min("doc").over(by_sig) < F.max("doc").over(by_sig)).filter("many").select("sig", "doc")
    )
    shared = keep(shared, "shingle-shared")
    # A document with several sets stands for itself and has no sketch.
    sizes = known.groupBy(F.col("doc_id").alias("doc")).agg(
        F.max("n").alias("n_max"), F.min("n").alias("n_min"),
        F.when(F.min("rep") < F.max("rep"), F.col("doc_id")).otherwise(F.min("rep")).alias("rep"),
        F.when(F.min("rep") == F.max("rep"), F.first("sketch")).alias("sketch"),
    )
    # Copies of one set in different tasks become their representative.
    held = shared.join(sizes.drop("sketch"), "doc").select("sig", F.col("rep").alias("doc"), "n_min", "n_max").distinct()
    held = held.withColumn("many", F.min("doc").over(by_sig) < F.max("doc").over(by_sig)).filter("many").drop("many")
    held = keep(held, "shingle-buckets")

    nodes = keep(sizes.filter("doc = rep").join(held.select("doc").distinct(), "doc", "left_semi"), "shingle-sketches")
    tried = links = label = None
    for turn in range(TURNS):
        last_turn = turn == TURNS - 1
        if not turn:
            view = held.withColumn("comp", F.col("doc")).withColumn("deg", F.lit(0).cast("long"))
        else:
            placed = lambda rows, label=label: rows.join(label, F.col("doc") == F.col("id"), "left").withColumn("comp", F.coalesce("root", "doc"))
            mixed = placed(held).groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("members"))
            mixed = keep(mixed.filter("c0 < c1").select("sig", "members"), "shingle-mixed")
            view = placed(held.join(mixed, "sig")).drop("id", "root")
            ends = links.select(F.col("a").alias("doc")).unionAll(links.select(F.col("b").alias("doc")))
            view = view.join(ends.groupBy("doc").agg(F.count("*").alias("deg")), "doc", "left")
            view = keep(view.withColumn("deg", F.coalesce("deg", F.lit(0))), "shingle-open")
        one, two = _side("x"), _side("y")
        blocked = None
        if last_turn:
            blocked = keep(block_links(view.filter(F.col("members") > SMALL_BUCKET).drop("members"), nodes, docs), "shingle-block-links")
            view = view.filter(F.col("members") <= SMALL_BUCKET)
            found = view.select("sig", one).join(view.select("sig", two), "sig").filter("x.comp < y.comp")
        else:
            lead = F.max(F.struct("deg", (-F.col("doc")).alias("neg"), one)).over(by_sig)
            found = view.select(lead.getField("x").alias("x"), two).filter("x.comp <> y.comp")
        fits = (F.col("x.n_min") * PERCENT <= F.col("y.n_max") * 100) & (F.col("y.n_min") * PERCENT <= F.col("x.n_max") * 100)
        found = found.filter(fits).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
        if tried is not None:
            found = found.join(tried, ["a", "b"], "left_anti")
        found = keep(found, "shingle-pairs")
        if turn and not last_turn and found.isEmpty():
            continue
        near = keep(near_pairs(found, nodes), "shingle-near")
        good = keep(verify(near, docs), "shingle-links")
        if blocked is not None:
            good = good.unionByName(blocked)
        links = good if links is None else links.unionByName(good)
        tried = found if tried is None else tried.unionByName(found)
        if not last_turn and not (turn and good.isEmpty()):
            label = keep(components(_stars(label, good)), "shingle-labels")
    label = components(_stars(label, links.unionByName(equal)))
    return rows.join(label, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")
    )


@query("op2_ngram_join")
def op2_ngram_join(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))
