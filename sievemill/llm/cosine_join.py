"""Weighted cosine join of record texts between splits that loses no pair within an edit bound.

Vectors. The letters and digits of a training text are cut into disjoint segments of SEGMENT letters, or of fewer where the text would
otherwise have less than two segments more than the most edits, k, that a pair of its length may have. Its terms are the segments; the
square of a term's weight is an integer that grows with the logarithm of its inverse frequency, which is counted over all training texts
in a table of SLOTS hash slots. A held-out text is a query: its terms are all its windows of those sizes, and the dot product of the two is the weight of
the training text's segments that stand in it, where the lengths before and after them differ by k in all at most.

Threshold. An edit touches one segment at most, so whatever the k edits are, the dot product is no less than the text's squared norm without its k heaviest
terms. That is the cosine each training text asks for; it needs no tuning and no pair falls under it.

Pruning. Terms enter the inverted lists from the heaviest on, until the squared norm of the residual, which bounds what all the terms left could
add as no list has a larger weight for a term, can't reach the threshold any more; that takes k + 1 terms. One more is listed, so that a
pair must share the weight of two. Common phrases thus stay out of the lists, unless a text has nothing else. Matches also pass filters by length, position and the
counts of characters in 32 groups, which k edits change by 2k at most in all. Lists meet in buckets by hash; dot products are summed
per pair over the buckets, pairs below their threshold go, and the exact edit distance decides on the rest.

A term whose list would be longer than an average bucket is hot: its list is cut by text into as many parts in buckets of their own as that takes, and the
queries go to all parts.

Equal texts of a side are one class; pairs of classes are spread to pairs of records at the end, and counts of links never are.

Nulls: a record without id, split or context takes no part. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.letters import letters, mix, ragged, windows
from sievemill.session import stored

SLOTS = 1 << 20
SEGMENT = 7
SPARE = 2  #: terms in the lists beyond the most edits, where there are as many
GROUPS = 32  #: of characters, by code point, counted modulo 16
FIELD = (1 << 16) - 1  #: positions beyond are taken for this, and texts as long aren't told apart by them
ENTRY = np.dtype([("gram", "<u4"), ("pos", "<u2")])
HEAD = np.dtype([("counts", "u1", (GROUPS // 2,)), ("n", "<u4"), ("norm", "<u4"), ("left", "<u2"), ("each", "u1"), ("pad", "u1")])  #: of a text, before its entries
ROOM = 1 << 21  #: letters, or matches, that are looked at together
MARKS = 1 << 22  #: bits of the table of texts that are in a pair


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance by bit-parallel columns; any number over `most` once it can't be reached."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    m = len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for j, c in enumerate(b):
        eq = where.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right = down | ~(diag | up) & full
        left = up & diag
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        if score - (len(b) - 1 - j) > most:
            return most + 1
        right = (right << 1 | 1) & full
        up = (left << 1) & full | ~(diag | right) & full
        down = right & diag
    return score


def most_edits(n: np.ndarray, tenth: int) -> np.ndarray:
    """Of the longest text within reach of one of n letters."""
    return (n + n // (tenth - 1)) // tenth


def segment_size(n: np.ndarray, tenth: int) -> np.ndarray:
    return np.maximum(np.minimum(SEGMENT, n // (most_edits(n, tenth) + SPARE)), 1)


def segments(texts: list[str], tenth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and hash of the disjoint segments of each text."""
    a, start, n = ragged(texts)
    size = segment_size(n, tenth)
    count = n // size
    row = np.repeat(np.arange(len(texts)), count)
    pos = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size[row]
    h = np.zeros(len(row), np.uint64)
    for q in np.unique(size):
        at = size[row] == q
        h[at] = mix(windows(a, int(q))[(start[row] + pos)[at]] + np.uint64(q))
    return row, pos, h


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def _count(tenth: int):
    def run(batches):
        total, docs = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            row, _, h = segments(b["norm"].to_pylist(), tenth)
            total += np.bincount(np.unique(row * SLOTS + _slot(h)) % SLOTS, minlength=SLOTS)
            docs += b.num_rows
        if docs:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], docs), pa.int64())], names=["slot", "n"])

    return run


FINE = 16  #: steps of a frequency's logarithm


def weights(classes: DataFrame, tenth: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The squared weight of the terms in each slot, and into how many parts the list of one is cut."""
    counts = classes.where("side = 0").select("norm").mapInArrow(_count(tenth), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = counts.select("slot", F.round(FINE * F.log2("n")).cast("short").alias("n")).toArrow()  # at most SLOTS + 1 rows
    slot, n = table["slot"].to_numpy(), 2.0 ** (table["n"].to_numpy() / FINE)
    total = float(n[slot < 0].sum())
    often = np.ones(SLOTS)
    often[slot[slot >= 0]] = n[slot >= 0]
    each = max(n[slot >= 0].sum() / buckets, 2.0)  # entries of an average bucket
    return np.clip(8 * np.log2(1 + total / often), 1, 255).astype(np.uint8), np.clip(np.ceil(often / each), 1, buckets).astype(np.int32)


def listed(row: np.ndarray, weight: np.ndarray, n: np.ndarray, tenth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which terms enter the lists, and per text: their squared norm; of it, what the most edits leave; the weight by which
    that grows at least for each edit less."""
    order = np.lexsort((-weight.astype(np.int64), row))
    count = np.bincount(row, minlength=len(n))
    first = np.cumsum(count) - count
    rank = np.empty(len(row), np.int64)
    rank[order] = np.arange(len(row)) - first[row[order]]
    k = most_edits(n, tenth)
    keep = rank < (k + SPARE)[row]
    w = weight.astype(np.int64)
    norm = np.bincount(row[keep], w[keep], len(n)).astype(np.int64)
    spared = keep & (rank >= k[row])
    left = np.bincount(row[spared], w[spared], len(n)).astype(np.int64)
    each = np.zeros(len(n), np.int64)
    last = rank == k[row] - 1
    each[row[last]] = w[last]
    return np.flatnonzero(keep), norm, left, each


def _fold(least: int, *names: str):
    def run(batches):
        for b in batches:
            t = letters(b["context"].to_pylist())
            n = np.fromiter(map(len, t), np.int32, len(t))
            keep = np.flatnonzero(n >= least)
            t = [t[i] for i in keep]
            keys = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in t]
            out = {"side": b["side"].take(pa.array(keep)), "key": pa.array(keys, pa.binary()), "norm": pa.array(t, pa.string())}
            if "id" in names:
                out["id"] = b["id"].take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names=list(names))

    return run


def all_windows(texts: list[str], tenth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of every window that may be a segment of a text within reach."""
    a, start, n = ragged(texts)
    top = n + n // (tenth - 1)
    size = segment_size(np.arange(top.max() + 1), tenth)
    row = np.repeat(np.arange(len(texts)), n)
    pos = np.arange(len(a)) - start[row]
    out = []
    for q in np.unique(size[(n - n // tenth).min() :]):
        below = np.append(0, np.cumsum(size == q))
        used = below[top + 1] > below[n - n // tenth]
        keep = used[row] & (pos + q <= n[row])
        out.append((row[keep], pos[keep], mix(windows(a, int(q))[keep] + np.uint64(q))))
    return tuple(np.concatenate(x) for x in zip(*out))


def _packed(head: np.ndarray, entry: np.ndarray, size: np.ndarray) -> pa.Array:
    """One binary value per head: it, and its `size` entries after it."""
    n = HEAD.itemsize + size * ENTRY.itemsize
    ends = np.cumsum(n)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = _heads(ends - n, len(data))
    data[first], data[~first] = np.ascontiguousarray(head).view(np.uint8), entry.view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])


def _heads(start: np.ndarray, n: int) -> np.ndarray:
    """True at the bytes of heads that begin at `start`."""
    step = np.zeros(n + 1, np.int8)
    step[start] = 1
    step[start + HEAD.itemsize] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The heads and their counts (each times 16, so that they wrap as bytes do), and of each entry the row and, in one number, gram and position."""
    parts, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for c in t["terms"].chunks:
        if len(c):
            at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]])
            sizes.append(np.diff(at).astype(np.int64))
    data, n = np.concatenate(parts), np.concatenate(sizes)
    first = _heads(np.cumsum(n) - n, len(data))
    head, entry = data[first].view(HEAD), data[~first].view(ENTRY)
    counts = np.concatenate([head["counts"] & 0xF0, head["counts"] << 4], axis=1)
    return head, counts, np.repeat(np.arange(len(n)), (n - HEAD.itemsize) // ENTRY.itemsize), entry["gram"].astype(np.uint64) << np.uint64(16) | entry["pos"]


def _spread_grams(held: bool, labels: list[int], tenth: int, table):
    """One row per text and bucket, with the text's terms there."""
    buckets, label = len(labels), np.array(labels, np.int32)

    def run(batches):
        weight, parts = table.value
        for b in batches:
            every, cids = b["norm"].to_pylist(), b["cid"].to_numpy()
            part = np.cumsum(np.fromiter(map(len, every), np.int64, len(every))) // ROOM
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                texts, cid = [every[i] for i in at], cids[at]
                a, _, n = ragged(texts)
                head = np.zeros(len(n), HEAD)
                counts = np.bincount(np.repeat(np.arange(len(n)), n) * GROUPS + a % GROUPS, minlength=len(n) * GROUPS).astype(np.uint8).reshape(-1, GROUPS)
                head["counts"], head["n"] = counts[:, ::2] << 4 | counts[:, 1::2] & 15, n
                row, pos, h = (all_windows if held else segments)(texts, tenth)
                if held:
                    times = parts[_slot(h)]
                    salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, pos, h = (np.repeat(x, times) for x in (row, pos, h))
                else:
                    keep, head["norm"], head["left"], head["each"] = listed(row, weight[_slot(h)], n, tenth)
                    row, pos, h = row[keep], pos[keep], h[keep]
                    salt = cid[row] % parts[_slot(h)]
                key = row * buckets + ((h >> np.uint64(40)).astype(np.int64) + salt) % buckets
                order = np.argsort(key, kind="stable")
                entry = np.empty(len(order), ENTRY)
                entry["gram"], entry["pos"] = h[order] & np.uint64(0xFFFFFFFF), np.minimum(pos, FIELD)[order]
                key, size = np.unique(key, return_counts=True)
                r = key // buckets
                yield pa.RecordBatch.from_arrays([pa.array(label[key % buckets], pa.int32()), pa.array(cid[r], pa.int64()), _packed(head[r], entry, size)], names=["bucket", "cid", "terms"])

    return run


_LANES = np.uint64(0x00FF00FF00FF00FF)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far counts lie apart in all, at least: they are known modulo 16."""
    d = a - b
    v = np.minimum(d, np.uint8(0) - d).view(np.uint64)
    v = (v & _LANES) + (v >> np.uint64(8) & _LANES)
    v = v[:, 0] + v[:, 1] + v[:, 2] + v[:, 3]
    return (v * np.uint64(0x0001000100010001) >> np.uint64(52)).astype(np.int64)


def _meet(tenth: int, table):
    """Pairs of one bucket, with the dot product of the terms they share there, the least it must be in all, and the squared norm."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        head_a, counts_a, row_a, entry_a = _unpacked(left)
        head_b, counts_b, row_b, entry_b = _unpacked(right)
        n_a, n_b, rows = head_a["n"].astype(np.int64), head_b["n"].astype(np.int64), max(len(head_b), 1)
        found = [np.zeros(0, np.int64)]
        # Held-out entries by band of length, then by hash and position, so that one range holds what a segment may meet.
        band = np.floor(np.log(np.maximum(n_a, 1)) / np.log(1.1)).astype(np.int64)
        low, high = (np.floor(np.log(np.maximum(x, 1)) / np.log(1.1)).astype(np.int64) for x in (n_b - n_b // tenth - 1, n_b + n_b // (tenth - 1) + 1))
        reach = most_edits(n_b, tenth)
        order = np.lexsort((entry_a, band[row_a]))
        row_a, entry_a = row_a[order], entry_a[order]
        bands, first = np.unique(band[row_a], return_index=True)
        pos_b = (entry_b & np.uint64(FIELD)).astype(np.int64)
        gram_b = entry_b - pos_b.astype(np.uint64)
        for g, x, y in zip(bands, first, [*first[1:], len(row_a)]):
            held = entry_a[x:y]
            at = np.flatnonzero((low[row_b] <= g) & (g <= high[row_b]))
            k = reach[row_b[at]]
            lo = np.searchsorted(held, gram_b[at] + np.maximum(pos_b[at] - k, 0).astype(np.uint64))
            c = np.searchsorted(held, gram_b[at] + np.minimum(pos_b[at] + k, FIELD).astype(np.uint64), "right") - lo
            at, lo, c = at[c > 0], lo[c > 0], c[c > 0]
            part = np.cumsum(c) // ROOM
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(at))
            for s, e in zip(cuts, cuts[1:]):
                j = np.repeat(at[s:e], c[s:e])
                i = np.arange(len(j)) + np.repeat(lo[s:e] - (np.cumsum(c[s:e]) - c[s:e]), c[s:e]) + x
                ra, rb = row_a[i], row_b[j]
                la, lb = n_a[ra], n_b[rb]
                most, longer = np.maximum(la, lb) // tenth, la - lb
                before = (entry_a[i] & np.uint64(FIELD)).astype(np.int64) - pos_b[j]
                ok = np.flatnonzero((np.abs(longer) <= most) & ((np.abs(before) + np.abs(longer - before) <= most) | (np.maximum(la, lb) >= FIELD)))
                ra, rb, j = ra[ok], rb[ok], j[ok]
                ok = _apart(counts_a[ra], counts_b[rb]) + np.abs(longer[ok]) <= 2 * most[ok]
                # A segment counts once, wherever in the text it stands.
                found.append(np.unique(ra[ok] * len(entry_b) + j[ok]))
        term = np.unique(np.concatenate(found))
        held, j = term // max(len(entry_b), 1), term % max(len(entry_b), 1)
        pair, which = np.unique(held * rows + row_b[j], return_inverse=True)
        dot = np.bincount(which, table.value[0][_slot(entry_b[j] >> np.uint64(16))], len(pair)).astype(np.int64)
        ra, rb = pair // rows, pair % rows
        norm, spared, each = (head_b[c].astype(np.int64) for c in ("norm", "left", "each"))
        least = spared[rb] + (reach[rb] - np.maximum(n_a[ra], n_b[rb]) // tenth) * each[rb]
        return pa.table({"cid_a": pa.array(left["cid"].to_numpy()[ra], pa.int64()), "cid_b": pa.array(right["cid"].to_numpy()[rb], pa.int64()), **{c: pa.array(x, pa.int32()) for c, x in (("dot", dot), ("least", least), ("norm", norm[rb]))}})

    return run


def _verify(tenth: int):
    def run(batches):
        for b in batches:
            near = []
            for x, y in zip(b["norm_a"].to_pylist(), b["norm_b"].to_pylist()):
                most = max(len(x), len(y)) // tenth
                near.append(edit_distance(x, y, most) <= most)
            yield b.select(["key_a", "key_b", "cosine"]).filter(pa.array(near, pa.bool_()))

    return run


def _marked(near: DataFrame, classes: DataFrame, cid: str) -> DataFrame:
    """classes without most of those that are in no pair, by a table of bits of fixed size."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS)).cast("int")

    def mark(batches):
        bits = np.zeros(MARKS, bool)
        for b in batches:
            bits[b["slot"].to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes())], pa.binary())], names=["bits"])

    bits = np.zeros(MARKS // 8, np.uint8)
    for r in near.select(slot(cid).alias("slot")).mapInArrow(mark, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    bits = near.sparkSession.sparkContext.broadcast(bits)

    def only(batches):
        for b in batches:
            x = b["slot"].to_numpy()
            yield b.filter(pa.array((bits.value[x >> 3] >> (7 - (x & 7)) & 1).astype(bool)))

    kinds = dict(classes.dtypes)
    return classes.withColumn("slot", slot("cid")).mapInArrow(only, ", ".join([*(f"{c} {kinds[c]}" for c in classes.columns), "slot int"]))


def near_classes(records: DataFrame, least: int = 40, tenth: int = 10) -> tuple[DataFrame, DataFrame]:
    """(id, side, key) of the records that take part, side 0 being train and key naming the class of equal texts; and (key_a, key_b, cosine) of all
    classes of dev or test and of train whose texts have at least `least` letters and digits and turn into each other by at most
    1/`tenth` of the longer one's length in edits."""
    spark = records.sparkSession
    side = F.when(F.col("split") == "train", 0).when(F.col("split").isin("dev", "test"), 1).cast("byte").alias("side")
    rows = records.select("id", side, "context").where("id IS NOT NULL AND side IS NOT NULL AND context IS NOT NULL")
    members = stored(rows.mapInArrow(_fold(least, "id", "side", "key"), "id string, side byte, key binary").distinct(), "p1-members")
    texts = rows.select("side", "context").mapInArrow(_fold(least, "side", "key", "norm"), "side byte, key binary, norm string")
    classes = stored(texts.dropDuplicates(["side", "key"]).withColumn("cid", F.monotonically_increasing_id()), "p1-classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = spark.sparkContext.broadcast(weights(classes, tenth, parts))
    numbers = spark.range(64 * parts).select(F.col("id").cast("int").alias("x"))
    labels = [r["x"] for r in numbers.groupBy(F.pmod(F.hash("x"), F.lit(parts))).agg(F.min("x").alias("x")).collect()]  # one bucket for each partition of the shuffle
    e, t = (classes.where(F.col("side") == s).select("cid", "norm").mapInArrow(_spread_grams(s == 1, labels, tenth, table), "bucket int, cid long, terms binary").groupBy("bucket") for s in (1, 0))
    shared = e.cogroup(t).applyInArrow(_meet(tenth, table), "cid_a long, cid_b long, dot int, least int, norm int")
    sums = shared.groupBy("cid_a", "cid_b").agg(F.sum("dot").alias("dot"), F.max("least").alias("least"), F.max("norm").alias("norm"))
    near = stored(sums.where("dot >= least").select("cid_a", "cid_b", F.sqrt(F.col("dot") / F.col("norm")).alias("cosine")), "p1-near")
    text = [_marked(near, classes.where(F.col("side") == s), f"cid_{k}").select(F.col("cid").alias(f"cid_{k}"), F.col("key").alias(f"key_{k}"), F.col("norm").alias(f"norm_{k}")) for s, k in ((1, "a"), (0, "b"))]
    found = near.join(text[0], "cid_a").join(text[1], "cid_b").select("key_a", "key_b", "norm_a", "norm_b", "cosine").mapInArrow(_verify(tenth), "key_a binary, key_b binary, cosine double")
    return members, found


def near_pairs(records: DataFrame, least: int = 40, tenth: int = 10) -> DataFrame:
    """id_eval, id_train and the cosine of the records of such classes."""
    members, found = near_classes(records, least, tenth)
    ids = [members.where(F.col("side") == s).select(F.col("key").alias(f"key_{k}"), F.col("id").alias(f"id_{k}")) for s, k in ((1, "a"), (0, "b"))]
    return found.join(ids[0], "key_a").join(ids[1], "key_b").select(F.col("id_a").alias("id_eval"), F.col("id_b").alias("id_train"), "cosine")


def links(records: DataFrame, least: int = 40, tenth: int = 10) -> DataFrame:
    """id, class_id (the smallest id of its side with an equal text) and n_links, the records of the other side it is near to, for every record that takes
    part. Links are counted between classes and never written out."""
    members, found = near_classes(records, least, tenth)
    found = stored(found, "p1-found")
    size = members.groupBy("side", "key").agg(F.count("*").alias("n"), F.min("id").alias("class_id"))
    per = []
    for s, own, other in ((1, "key_a", "key_b"), (0, "key_b", "key_a")):
        n = size.where(F.col("side") == 1 - s).select(F.col("key").alias(other), "n")
        per.append(found.join(n, other).groupBy(F.lit(s).cast("byte").alias("side"), F.col(own).alias("key")).agg(F.sum("n").alias("n_links")))
    classes = size.select("side", "key", "class_id").join(per[0].unionByName(per[1]), ["side", "key"], "left")
    return members.join(classes, ["side", "key"]).select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
