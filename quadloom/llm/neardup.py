"""Near-duplicates by HyperMinHash sketches, banding and verification.

A document's set holds its distinct word shingles as 64-bit hashes.  Its sketch
has ``REGISTERS`` registers; each keeps, of the smallest hash in its part of the
hash space, the count of leading zeros (6 bits) and the next 10 bits.  Four
registers make a band of 64 bits.

1. One scan makes sketches; equal sets (count and 128-bit sum) become one class,
   which has a number of its own and is the node of all that follows.
2. Texts that share a band are candidates.  A band's texts are not paired with
   each other: each text is compared with the band's hub, by the collision-corrected
   estimate, and its best estimate is verified on full sets.
3. Where a band still holds texts of several components, the pairs across them
   are estimated too, in blocks and only between sets whose sizes allow the
   threshold.  A text with such an estimate is verified with its best partner in
   the other component and, if that fails, compared on full sets with all texts
   of that component, again in blocks.  So no link between components is lost to
   step 2, whatever the size of a band.
4. Verified links give connected components.

With 32 bands a pair at the threshold shares none with probability below 1e-5.

Defined cases: null or blank texts have empty sets and link with nothing, also
not with each other; with fewer words than a shingle the whole sequence is the
one shingle; repeated rows share one component, the smallest id; rows of one
doc_id with different texts are linked by their texts only, each for itself;
rows with a null doc_id are never linked and have component_id null; other
columns are ignored.  ``keep_one`` keeps one row of each component, and all rows
with a null doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.frames import carry, pick
from quadloom.llm import bytescan as B
from quadloom.operators.components import connected_components
from quadloom.plans.scratch import materialize

REGISTERS = 128
ROWS_PER_BAND = 4
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
U64 = np.uint64
#: Standard deviations below the threshold at which an estimate is still verified.
SLACK = 4.5
#: Rows of one block in step 3: of a band's sketches, and of full sets on either side.
BLOCK, SETS = 1024, 512
#: A band of more parts than this has larger blocks too: both grow with the square root, so that fewer rows move.
PARTS = 16
#: Sets of so many shingles or fewer have each register as a band.
FEW = 4


def shingles(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a chunk and the rows, in row order."""
    starts, ends, row = B.words(buf, offs)
    hashes = B.span_hash(B.LOWER[buf], starts, ends)
    key, at = B.windows(hashes, row, k)
    owner = row[at]
    count = np.bincount(row, minlength=len(offs) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    for n in range(1, k):
        few = np.flatnonzero(count == n)
        if len(few):
            total = hashes[first[few]].copy()
            for i in range(1, n):
                total = total * U64(B.BASE) + hashes[first[few] + i]
            key, owner = np.concatenate([key, B.mix64(total + U64(n))]), np.concatenate([owner, few])
    order = np.argsort(B.fold(key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    order = np.argsort(owner, kind="stable")
    return key[order], owner[order]


def registers(key: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """The sketches: ``rows`` x REGISTERS values of 16 bits."""
    bits = 64 - int(math.log2(REGISTERS))
    none = U64((1 << bits) - 1)
    least = np.full(rows * REGISTERS, none, U64)
    np.minimum.at(least, owner * REGISTERS + (key & U64(REGISTERS - 1)).astype(np.int64), key >> U64(64 - bits))
    empty = least == none
    least[empty] = 1
    # frexp rounds above 53 bits, so the position of the first one is taken from the upper half first
    high = (least >> U64(32)).astype(np.float64)
    low = (least & U64(0xFFFFFFFF)).astype(np.float64)
    length = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.int64)
    zeros = bits - length
    rest = least << (64 - length + 1).astype(U64) % U64(64)
    rest[length == 1] = 0
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (rest >> U64(64 - MANTISSA)).astype(np.uint16)
    out[empty] = EMPTY
    return out.reshape(rows, REGISTERS)


def sums(key: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, together its signature."""
    out = []
    for salt in (U64(0x632BE59BD9B4E019), U64(0xE220A8397B1DCDAF)):
        total = np.zeros(len(key) + 1, U64)
        np.cumsum(B.mix64(key ^ salt), out=total[1:])
        edge = np.searchsorted(owner, np.arange(rows + 1))
        out.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
    return out[0], out[1]


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, text_hash, n_shingles, sig_a, sig_b, regs for each row of ``docs`` (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, buf, offs in B.chunks(batch.column("text")):
                key, owner = shingles(buf, offs, k)
                rows = hi - lo
                a, b = sums(key, owner, rows)
                regs = [r.tobytes() for r in registers(key, owner, rows)]
                n = np.bincount(owner, minlength=rows).astype(np.int64)
                columns = [ids.slice(lo, rows), batch.column("text_hash").slice(lo, rows), pa.array(n), pa.array(a), pa.array(b), _binary(regs)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "sig_a", "sig_b", "regs"])

    d = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    return d.mapInArrow(scan, "doc_id long, text_hash long, n_shingles long, sig_a long, sig_b long, regs binary")


def shingle_sets(wanted: DataFrame, k: int = 5) -> DataFrame:
    """rep and its sorted shingle hashes, 8 bytes each; ``wanted``: rep, text, and the signature that the text must have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep")
            sig_a, sig_b = (batch.column(c).to_numpy() for c in ("sig_a", "sig_b"))
            for lo, hi, buf, offs in B.chunks(batch.column("text")):
                key, owner = shingles(buf, offs, k)
                a, b = sums(key, owner, hi - lo)
                mine = np.flatnonzero((a == sig_a[lo:hi]) & (b == sig_b[lo:hi]))
                edge = np.searchsorted(owner, np.arange(hi - lo + 1))
                sets = [np.sort(key[edge[i] : edge[i + 1]]).tobytes() for i in mine]
                yield pa.RecordBatch.from_arrays([reps.slice(lo, hi - lo).take(pa.array(mine)), _binary(sets)], ["rep", "shingles"])

    return wanted.select("rep", "sig_a", "sig_b", "text").mapInArrow(scan, "rep long, shingles binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def bands(reps: DataFrame) -> DataFrame:
    """(band, at, rep) for each band with a filled register; ``at`` is its place in the sketch.

    Of sets with few shingles, all of which may lie in one band, each filled register
    is a band too, at the place after the last.
    """
    n = REGISTERS // ROWS_PER_BAND

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _matrix(batch.column("regs"))
            keys = regs.view(U64).reshape(-1, n)
            full = keys != U64(0xFFFFFFFFFFFFFFFF)
            mixed = B.mix64(B.mix64(keys) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
            reps = batch.column("rep").to_numpy()
            ids = np.repeat(reps, n).reshape(-1, n)
            at = np.broadcast_to(np.arange(n, dtype=np.int8), full.shape)
            few, place = np.nonzero((regs != EMPTY) & (batch.column("n_shingles").to_numpy() <= FEW)[:, None])
            single = B.mix64(B.mix64(regs[few, place].astype(U64) + U64(1)) + (place + n + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
            columns = [np.r_[mixed[full], single].view(np.int64), np.r_[at[full], np.full(len(few), n, np.int8)], np.r_[ids[full], reps[few]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["band", "at", "rep"])

    return reps.select("rep", "n_shingles", "regs").mapInArrow(scan, "band long, at byte, rep long")


def shared_bands(band: DataFrame) -> DataFrame:
    """(band, at, rep, hub) of the bands that several texts have.

    A band's hub is its text with the most company over all of its own bands: of
    a group of copies that is likely the text they were made from, which is
    nearer to each of them than they are to each other.
    """
    sizes = band.groupBy("band").agg(F.count("*").alias("_size")).filter("_size > 1")
    members = materialize(band.join(sizes, "band"), "shared-bands")
    company = members.groupBy("rep").agg(F.sum("_size").alias("_company"))
    ranked = members.drop("_size").join(company, "rep")
    hubs = ranked.groupBy("band").agg(F.max_by("rep", F.struct("_company", -F.col("rep"))).alias("hub"))
    return materialize(members.drop("_size").join(hubs, "band"), "members")


def estimate(same: np.ndarray, filled: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard from equal registers, less the collisions that different sets would have.

    With a and b expected hashes a register, the smallest are exponential; a cell
    at x is about 0.72 * x * 2^-MANTISSA wide, so different sets agree in a
    register with probability near 0.72 * 2^-MANTISSA * ab / (a + b)^2.
    """
    a, b = n / REGISTERS, m / REGISTERS
    chance = 0.72 * 2.0**-MANTISSA * a * b / (a + b) ** 2
    raw = same / np.maximum(filled, 1)
    return np.clip((raw - chance) / (1 - chance), 0, 1)


def floor_of(threshold: float, filled: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least estimate that is verified: SLACK deviations below ``threshold``.

    The filled registers are a sample without replacement of the sets' union, so
    for small sets, most of which is in the sketch, the deviation is small.
    """
    union = np.maximum((n + m) / (1 + threshold), 2)
    unseen = np.clip((union - filled) / (union - 1), 0, 1)
    # one register more or less is always possible where the union is not known exactly
    return threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1) * unseen) - 1 / np.maximum(filled, 1)


def _compare(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of sketch pairs (broadcast over rows), and which are to be verified."""
    same = ((x == y) & (x != EMPTY)).sum(-1)
    filled = ((x != EMPTY) | (y != EMPTY)).sum(-1)
    est = estimate(same, filled, n, m)
    sized = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    return est, (est >= floor_of(threshold, filled, n, m)) & sized


def star_candidates(members: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """For each rep its best-estimated partner among the hubs of its bands."""
    r = reps.select("rep", "n_shingles", "regs")
    pairs = members.filter("rep <> hub").select("hub", "rep").distinct()
    pairs = pairs.join(r.toDF("rep", "n", "regs"), "rep").join(r.toDF("hub", "m", "hub_regs"), "hub")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                est, ok = _compare(_matrix(batch.column("regs")), _matrix(batch.column("hub_regs")), batch.column("n").to_numpy(), batch.column("m").to_numpy(), threshold)
                yield pa.RecordBatch.from_arrays([batch.column("rep").filter(pa.array(ok)), batch.column("hub").filter(pa.array(ok)), pa.array(est[ok])], ["rep", "hub", "est"])

    found = pairs.select("rep", "hub", "n", "m", "regs", "hub_regs").mapInArrow(scan, "rep long, hub long, est double")
    best = F.max_by("hub", F.struct("est", -F.col("hub")))
    return found.groupBy("rep").agg(best.alias("hub")).select(F.col("hub").alias("a"), F.col("rep").alias("b"))


def _runs(batches: Iterator[pa.RecordBatch], work, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of each ``key`` of a partition that is sorted by it; holds one key's rows at a time."""
    held: list[pa.RecordBatch] = []  # rows of the key that the last batch left open

    def results(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        key = t.column("key").to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        found = [work(t.slice(i, j - i)) for i, j in zip(edge[:-1], edge[1:], strict=True) if j - i > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and held[-1].column("key")[0].as_py() != key[-1]):
            yield from results([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from results(held)


def cross_candidates(members: DataFrame, reps: DataFrame, component: DataFrame, threshold: float) -> DataFrame:
    """(rep, component, partner): a text, another component that may have a text near it, and the nearest one by estimate.

    Estimates every pair of texts that share a band but no component, once: in
    the first band they share.  Of the two components the text of the smaller one
    is named, so a large group and those beside it make a row for each of these.
    """
    sizes = component.groupBy("component").agg(F.count("*").alias("_nodes"))
    known = component.join(sizes, "component").select(F.col("node").alias("rep"), "component", "_nodes")
    labelled = members.select("band", "at", "rep").join(known, "rep", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "rep")).withColumn("nodes", F.coalesce("_nodes", F.lit(1)).cast("long"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("band")
    rows = labelled.join(mixed, "band").join(reps.select("rep", "n_shingles"), "rep")
    # two sets can reach the threshold only within one step of size; each goes to its own class and the next
    rows = rows.withColumn("own_class", F.floor(F.log("n_shingles") / math.log(1 / threshold) + 1e-9).cast("int"))
    rows = rows.withColumn("size_class", F.explode(F.array("own_class", F.col("own_class") + 1)))
    group = rows.groupBy("band", "size_class").agg(F.count("*").alias("_n"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi")
    blocks = F.col("_n") / BLOCK
    parts = F.ceil(F.when(blocks <= PARTS, blocks).otherwise(F.sqrt(blocks * PARTS)))
    rows = rows.join(group.select("band", "size_class", parts.cast("int").alias("parts")), ["band", "size_class"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("left_part", F.least("part", "_other")).withColumn("right_part", F.greatest("part", "_other"))
    rows = rows.join(reps.select("rep", "regs"), "rep")
    key = F.xxhash64("band", "size_class", "left_part", "right_part")
    sides = [(F.col("part") == F.col("left_part")).alias("in_left"), (F.col("part") == F.col("right_part")).alias("in_right")]
    rows = rows.select(key.alias("key"), "at", "size_class", "own_class", "rep", "component", "nodes", F.col("n_shingles").alias("n"), *sides, "regs")
    rows = rows.repartition("key").sortWithinPartitions("key")

    def near(t: pa.Table) -> tuple[np.ndarray, ...]:
        rep, comp, nodes, n, own = (t.column(c).to_numpy() for c in ("rep", "component", "nodes", "n", "own_class"))
        best: dict[tuple[int, int], tuple[float, int]] = {}

        def note(text: int, other: int, est: float, partner: int) -> None:
            best[text, other] = max(best.get((text, other), (-1.0, 0)), (est, -partner))

        regs = _matrix(t.column("regs")) if comp.min() != comp.max() else np.zeros((0, REGISTERS), np.uint16)
        keys = regs.view(U64)
        band, size_class = t.column("at")[0].as_py(), t.column("size_class")[0].as_py()
        in_left, in_right = t.column("in_left").to_numpy(), t.column("in_right").to_numpy()
        both = in_left & in_right
        for i in np.flatnonzero(in_left) if len(regs) else ():
            # each pair once: in the larger of its classes, and in the first band that both share
            at = in_right & (comp != comp[i]) & (np.maximum(own, own[i]) == size_class)
            if both[i]:
                at[: i + 1] &= ~both[: i + 1]
            at = np.flatnonzero(at)
            if band and len(at):
                early = keys[i, :band]
                at = at[~((keys[at, :band] == early) & (early != U64(0xFFFFFFFFFFFFFFFF))).any(1)]
            if not len(at):
                continue
            est, ok = _compare(regs[i], regs[at], n[i], n[at], threshold)
            at, est = at[ok], est[ok]
            mine = (nodes[i] < nodes[at]) | ((nodes[i] == nodes[at]) & (comp[i] > comp[at]))
            for j, e, m in zip(at.tolist(), est.tolist(), mine.tolist(), strict=True):
                if m:
                    note(int(rep[i]), int(comp[j]), e, int(rep[j]))
                else:
                    note(int(rep[j]), int(comp[i]), e, int(rep[i]))
        found = [(x, c, -p, e) for (x, c), (e, p) in best.items()]
        columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
        return tuple(np.array(v, kind) for v, kind in zip(columns, (np.int64, np.int64, np.int64, np.float64), strict=True))

    names = ["rep", "component", "partner", "est"]
    found = rows.mapInArrow(lambda batches: _runs(batches, near, names), "rep long, component long, partner long, est double")
    return found.groupBy("rep", "component").agg(F.max_by("partner", F.struct("est", -F.col("partner"))).alias("partner"))


def cross_links(candidates: DataFrame, component: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For each (rep, component) of ``candidates`` one link of the text into the component, if full sets have any.

    The component's texts and those to be compared with it meet in blocks of
    bounded size; one pass over a block counts a text's common shingles with all
    of the block's texts.
    """
    c = candidates.toDF("x", "c")
    nodes = component.select(F.col("node").alias("y"), F.col("component").alias("c"))
    # a text without a link is its own component
    alone = c.select("c").distinct().join(nodes.select("c").distinct(), "c", "left_anti").select(F.col("c").alias("y"), "c")
    nodes = nodes.unionAll(alone)
    of_x = c.groupBy("c").agg(F.ceil(F.count("*") / SETS).cast("int").alias("x_parts"))
    of_y = nodes.groupBy("c").agg(F.ceil(F.count("*") / SETS).cast("int").alias("y_parts"))
    parts = of_x.join(of_y, "c")
    part = lambda v, n: F.pmod(F.xxhash64(v), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    xs = c.join(parts, "c").withColumn("i", part("x", "x_parts")).withColumn("j", every("y_parts")).select("c", "i", "j", F.col("x").alias("id"), F.lit(True).alias("is_x"))
    ys = nodes.join(parts, "c").withColumn("j", part("y", "y_parts")).withColumn("i", every("x_parts")).select("c", "i", "j", F.col("y").alias("id"), F.lit(False).alias("is_x"))
    rows = xs.unionAll(ys).join(sets.toDF("id", "set"), "id")
    rows = rows.select(F.xxhash64("c", "i", "j").alias("key"), "id", "is_x", "set").repartition("key").sortWithinPartitions("key")

    def links(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, is_x = t.column("id").to_numpy(), t.column("is_x").to_numpy()
        parts = [np.frombuffer(x.as_buffer(), U64) for x in t.column("set").combine_chunks()]
        of = np.flatnonzero(~is_x)
        if not len(of) or not is_x.any():
            return ids[:0], ids[:0]
        size = np.array([len(parts[k]) for k in of])
        hashes, owner = np.concatenate([parts[k] for k in of]), np.repeat(np.arange(len(of)), size)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        a, b = [], []
        for k in np.flatnonzero(is_x):
            lo, hi = np.searchsorted(hashes, parts[k]), np.searchsorted(hashes, parts[k], "right")
            many = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            common = np.bincount(owner[at], minlength=len(of))
            union = len(parts[k]) + size - common
            best = int(np.argmax(common / union))
            if 100 * common[best] >= percent * union[best]:
                a.append(min(ids[k], ids[of[best]]))
                b.append(max(ids[k], ids[of[best]]))
        return np.array(a, np.int64), np.array(b, np.int64)

    return rows.mapInArrow(lambda batches: _runs(batches, links, ["a", "b"]), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets reach ``percent``, with their Jaccard similarity."""
    p = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, all_ = [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                common = int((v[at] == u).sum())
                both.append(common)
                all_.append(len(u) + len(v) - common)
            i, j = np.array(both, np.int64), np.array(all_, np.int64)
            ok = 100 * i >= percent * j
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(i[ok] / np.maximum(j[ok], 1))], ["a", "b", "jaccard"])

    return p.select("a", "b", "set_a", "set_b").mapInArrow(scan, "a long, b long, jaccard double")


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for each row of ``docs``."""
    threshold = percent / 100
    d = pick(docs, "doc_id", "text")
    rows = materialize(sketches(d, k), "sketches")
    filled = rows.filter("n_shingles > 0 and doc_id is not null")
    reps = filled.groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("doc_id").alias("low"), F.first("regs").alias("regs"))
    # the numbers stay what they are once they are written
    reps = materialize(reps.withColumn("_number", F.monotonically_increasing_id()), "classes")
    # a class is called by its smallest doc_id, unless some doc_id is that of several classes
    plain = reps.groupBy("low").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    reps = reps.withColumn("rep", F.col("low" if plain else "_number")).drop("_number")
    members = shared_bands(bands(reps))
    wanted = members.select("rep").distinct().join(reps.select("rep", F.col("low").alias("doc_id"), "sig_a", "sig_b"), "rep")
    sets = materialize(shingle_sets(d.join(wanted, "doc_id"), k), "sets").dropDuplicates(["rep"])
    links = materialize(verified(star_candidates(members, reps, threshold), sets, percent).select("a", "b"), "links")
    first = materialize(connected_components(links), "components")
    classes = reps.drop("regs").join(first, F.col("rep") == F.col("node"), "left").withColumn("_part", F.coalesce("component", "rep")).drop("node", "component")
    across = materialize(cross_candidates(members, reps, first, threshold), "across")
    if not across.isEmpty():
        likely = across.select(F.col("rep").alias("a"), F.col("partner").alias("b"))
        more = materialize(verified(likely, sets, percent).select("a", "b"), "links")
        rest = across.join(more.toDF("rep", "partner"), ["rep", "partner"], "left_anti").select("rep", "component")
        rest = materialize(rest, "unlinked")
        if not rest.isEmpty():
            more = more.unionAll(materialize(cross_links(rest, first, sets, percent), "links"))
        # the links between components join these; what is inside them is known
        named = first.toDF("_node", "_component")
        for end in ("a", "b"):
            more = more.join(named, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_component", end)).drop("_node", "_component")
        joined = connected_components(more).toDF("_node", "_whole")
        classes = classes.join(joined, F.col("_part") == F.col("_node"), "left").withColumn("_part", F.coalesce("_whole", "_part")).drop("_node", "_whole")
    if plain:
        classes = classes.withColumn("component_id", F.col("_part"))
    else:
        classes = materialize(classes, "parts")
        classes = classes.join(classes.groupBy("_part").agg(F.min("low").alias("component_id")), "_part")
    classes = classes.select("sig_a", "sig_b", "n_shingles", "component_id")
    linked = filled.drop("regs").join(classes, ["sig_a", "sig_b", "n_shingles"]).select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    out = _components(docs, k, percent).drop("text_hash")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one of each, with all their columns; none for empty texts but one of each doc_id and text."""
    docs = carry(docs, ("doc_id", "text"), ("_id", "_hash", "_own"))
    mine = _components(docs, k, percent).filter("doc_id = component_id")
    # a component that has several texts of its smallest doc_id keeps one of them
    linked = mine.filter("n_shingles > 0").groupBy(F.col("component_id").alias("_id")).agg(F.min("text_hash").alias("_hash"), F.count("*").alias("_rows"))
    empty = mine.filter("n_shingles = 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_rows"))
    kept = materialize(linked.unionAll(empty.select("_id", "_hash", "_rows")), "kept")
    docs = docs.withColumn("_own", F.xxhash64("text"))
    same = (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_hash"))
    out = docs.join(kept.filter("_rows = 1"), same, "left_semi").unionAll(docs.filter("doc_id is null"))
    if not kept.filter("_rows > 1").isEmpty():
        again = docs.join(kept.filter("_rows > 1"), same, "left_semi")
        out = out.unionAll(again.dropDuplicates(["doc_id", "_own"]).select(out.columns))
    return out.drop("_own")
