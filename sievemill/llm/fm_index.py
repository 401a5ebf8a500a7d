"""Held-out passages inside a large corpus, found by an FM-index per shard.

The letters and digits of a shard's documents, with a separator between documents, are sorted into a suffix array by
prefix doubling over packed integers. Of it stay the Burrows-Wheeler transform as a wavelet matrix with rank counts, and
every STEP-th suffix position. A passage of n letters and digits leaks into a document if more than half of it, k = n//2 + 1
in a row, stands there. Of passages up to SHORT letters every window of k letters is searched backward. In longer ones such a run
covers one of the passage's aligned blocks of (k + 1)//2 letters (SEED at most), so these are searched. Occurrences are located
by stepping to the next sampled suffix position and grow to both sides as far as passage and document agree, so that the work
grows with the passage's length and not with its square. Runs of k letters or more stay, and the spans of a passage in a document
are merged.

A shard is indexed once, over its own alphabet, however many passages there are: they come in broadcast blocks of about BLOCK
letters, of which a task holds one at a time. A text beyond a shard is indexed in pieces that overlap by the longest block, and
occurrences grow over the whole text. Null and empty texts and passages have no letters and match nothing. Repeated passages are
searched once and reported for each item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemill.llm.letters import codes, letters
from sievemill.session import stored

SHARD_BITS = 20
STEP = 8
SHORT = 64
SEED = 1 << 12
TOGETHER = 64  #: letters by which occurrences grow all at once; longer runs are then compared one by one
BLOCK = 1 << 22


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Of symbols below 2^bits - 1, at most 2^20 - 1 of them; a suffix that ends sorts before one that goes on."""
    n = len(s)
    per = 40 // bits
    key = np.zeros(n + per, np.uint64)
    key[:n] = s.astype(np.uint64) + np.uint64(1)
    pack = np.zeros(n, np.uint64)
    for k in range(per):
        pack = pack << np.uint64(bits) | key[k : k + n]
    index, mask = np.arange(n, dtype=np.uint64), np.uint64((1 << SHARD_BITS) - 1)
    got = np.sort(pack << np.uint64(SHARD_BITS) | index)
    sa, group = (got & mask).astype(np.int32), got >> np.uint64(SHARD_BITS)
    rank = np.zeros(n + 1, np.int32)  # 1 + the slot where its group begins; 0 past the end
    slots, width = np.arange(n, dtype=np.int32), per
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = group[1:] != group[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        rank[sa[slots]] = slots[head] + 1
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = slots[~alone]
        if not len(slots):
            return sa
        at = sa[slots]
        pair = rank[at].astype(np.uint64) << np.uint64(21) | rank[np.minimum(at.astype(np.int64) + width, n)].astype(np.uint64)
        got = np.sort(pair << np.uint64(SHARD_BITS) | at.astype(np.uint64))
        sa[slots], group = (got & mask).astype(np.int32), got >> np.uint64(SHARD_BITS)
        width *= 2


class Wavelet:
    """Wavelet matrix over symbols below 2^bits: how often a symbol stands before a position."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        start = np.arange(1 << bits)  # while descending: where each symbol's block begins
        begin = np.zeros(1 << bits, np.int64)
        for b in range(bits - 1, -1, -1):
            one = (s >> b & 1).astype(bool)
            packed = np.zeros((len(s) // 64 + 2) * 8, np.uint8)
            p = np.packbits(one, bitorder="little")
            packed[: len(p)] = p
            words = packed.view(np.uint64)
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            zeros = len(s) - int(np.count_nonzero(one))
            self.levels.append((b, words, before, zeros))
            s = np.concatenate([s[~one], s[one]])
            begin = self._down(self.levels[-1], start, begin)
        self.begin = begin

    @staticmethod
    def _down(level, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        b, words, before, zeros = level
        w = i >> 6
        ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
        return np.where(symbol >> b & 1, zeros + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in self.levels:
            i = self._down(level, symbol, i)
        return i - self.begin[symbol]


class Index:
    """Of the code points of a shard; its own alphabet are the symbols, of which the separator is the first."""

    def __init__(self, text: np.ndarray):
        self.alphabet, s = np.unique(text, return_inverse=True)
        bits = max(2, (len(self.alphabet) + 2).bit_length())
        s = s.astype(np.uint16 if bits <= 16 else np.uint32)
        sa = suffix_array(s, bits)
        bwt = s[sa - 1]
        self.n, self.end_row = len(s), int(np.flatnonzero(sa == 0)[0])
        self.bwt, self.tree = bwt, Wavelet(bwt, bits)
        count = np.bincount(s, minlength=(1 << bits) + 1)
        self.first = np.cumsum(count) - count
        self.at = np.flatnonzero(sa % STEP == 0)
        self.sampled = np.full(self.n, -1, np.int32)
        self.sampled[self.at] = sa[self.at]

    def symbols(self, a: np.ndarray) -> np.ndarray:
        """a as symbols; what the shard doesn't have is a symbol that stands nowhere."""
        at = np.minimum(np.searchsorted(self.alphabet, a), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == a, at, len(self.alphabet))

    def search(self, flat: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows lo to hi of each pattern flat[end - size : end], all read backward at once."""
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        live = np.arange(len(end))
        for k in range(int(size.max(initial=0))):
            live = live[size[live] > k]
            c = flat[end[live] - 1 - k]
            a, b = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[b > a]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        todo, row = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            found = self.sampled[row] >= 0
            out[todo[found]] = self.sampled[row[found]] + steps[todo[found]]
            todo, row = todo[~found], row[~found]
            c = self.bwt[row].astype(np.int64)
            # Before the whole text stands its last separator, which is the smallest suffix of all.
            row = self.first[c] + self.tree.rank(c, row) + ((c == 0) & (row <= self.end_row))
            steps[todo] += 1
        return out


class Phrases:
    """Distinct passages as code points, and the patterns of them that are searched."""

    def __init__(self, passages: list[str], names: list[int] | None = None):
        self.names = np.array(range(len(passages)) if names is None else names, np.int64)
        self.flat = codes("".join(passages))
        self.size = np.fromiter(map(len, passages), np.int64, len(passages))
        self.start = np.cumsum(self.size) - self.size
        self.need = self.size // 2 + 1
        block = np.where(self.size <= SHORT, self.need, np.minimum((self.need + 1) // 2, SEED))
        step = np.where(self.size <= SHORT, 1, block)
        n = np.where(self.size > 0, (self.size - block) // step + 1, 0)
        self.who = np.repeat(np.arange(len(passages)), n)
        k = np.arange(len(self.who)) - np.repeat(np.cumsum(n) - n, n)
        self.first = self.start[self.who] + k * step[self.who]
        self.length = block[self.who]


def occurrences(index: Index, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and position of each pattern's occurrence in the shard."""
    lo, hi = index.search(index.symbols(phrases.flat), phrases.first + phrases.length, phrases.length)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n))


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many values are the same from the first one on."""
    other = x != y
    return int(other.argmax()) if other.any() else len(x)


def grown(text: np.ndarray, phrases: Phrases, which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, start and stop in text of the longest runs around the occurrences, those that are more than half of their passage."""
    who = phrases.who[which]
    a, b = at.copy(), at + phrases.length[which]
    p, q = phrases.first[which].copy(), phrases.first[which] + phrases.length[which]
    begin, end = phrases.start[who], phrases.start[who] + phrases.size[who]
    live, steps = np.arange(len(at)), 0
    while len(live := live[(a[live] > 0) & (p[live] > begin[live])]) and (steps := steps + 1) <= TOGETHER:
        live = live[text[a[live] - 1] == phrases.flat[p[live] - 1]]
        a[live] -= 1
        p[live] -= 1
    for i in live.tolist():
        n = min(a[i], p[i] - begin[i])
        a[i] -= _agreeing(text[a[i] - n : a[i]][::-1], phrases.flat[p[i] - n : p[i]][::-1])
    live, steps = np.arange(len(at)), 0
    while len(live := live[(b[live] < len(text)) & (q[live] < end[live])]) and (steps := steps + 1) <= TOGETHER:
        live = live[text[b[live]] == phrases.flat[q[live]]]
        b[live] += 1
        q[live] += 1
    for i in live.tolist():
        n = min(len(text) - b[i], end[i] - q[i])
        b[i] += _agreeing(text[b[i] : b[i] + n], phrases.flat[q[i] : q[i] + n])
    keep = b - a >= phrases.need[who]
    return who[keep], a[keep], b[keep]


def merged(text: np.ndarray, who: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The spans of one passage in one text, joined where they touch."""
    if not len(a):
        return text, who, a, b
    order = np.lexsort((b, a, who, text))
    text, who, a, b = text[order], who[order], a[order], b[order]
    other = np.ones(len(a), bool)
    other[1:] = (text[1:] != text[:-1]) | (who[1:] != who[:-1])
    lift = np.cumsum(other) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift)
    new = other.copy()
    new[1:] |= (a + lift)[1:] > reach[:-1]
    return text[new], who[new], a[new], np.maximum.reduceat(b, np.flatnonzero(new))


def _pieces(n: int, over: int) -> list[int]:
    """Where the pieces of a text of n letters begin; each has up to most - 1 letters and the next one repeats `over` of them."""
    most = (1 << SHARD_BITS) - 2
    return list(range(0, n, most - 1 - over)) if n >= most else [0]


def leaks(texts: list[str], blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, passage's name, start and stop of each merged span in a shard's texts; one text may be longer than a shard."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size + 1) - size - 1
    text = codes("\0".join(texts) + "\0")
    most = (1 << SHARD_BITS) - 2
    found: list[list[np.ndarray]] = [[], [], []]
    if size.sum():
        # Blocks are searched in each piece; the pieces of a text overlap by what the longest pattern needs.
        for at in _pieces(len(text), min(SEED, most // 2)):
            piece = text[at : at + most - 1]
            index = Index(piece if piece[-1] == 0 else np.append(piece, np.uint32(0)))
            for phrases in blocks():
                which, where = occurrences(index, phrases)
                who, a, b = grown(text, phrases, which, where + at)
                for x, y in zip(found, (phrases.names[who], a, b)):
                    x.append(y)
    who, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    row = np.searchsorted(start, a, "right") - 1
    return merged(row, who, a - start[row], b - start[row])


def _scan(blocks):
    def each():
        for b in blocks:
            yield b.value
            if len(blocks) > 1:
                vars(b).pop("_value", None)  # the next block takes its place in memory

    def found(ids, texts):
        row, who, a, b = leaks(texts, each)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(row)), pa.array(who, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "passage", "start", "stop"])

    def run(batches):
        ids, texts, size, most = [], [], 0, (1 << SHARD_BITS) - 2
        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), letters(batch["text"].to_pylist())):
                if texts and size + len(t) + 1 > most:
                    yield found(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t) + 1
        if texts:
            yield found(ids, texts)

    return run


def _folded(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["item_id"], pa.array(letters(b["passage"].to_pylist()), pa.string())], names=["item_id", "norm"])


def leaked_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id, start, stop (in letters and digits of the document) of every span of items (item_id, passage)
    that stands in documents (doc_id, text)."""
    spark = documents.sparkSession
    folded = stored(items.where("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", "passage").mapInArrow(_folded, "item_id long, norm string").where("norm <> ''"), "p7-items")
    distinct = folded.groupBy("norm").agg(F.min("item_id").alias("passage"))
    blocks, texts, names, n = [], [], [], 0
    for r in distinct.toLocalIterator():  # the driver, too, holds one block at a time
        texts.append(r["norm"])
        names.append(r["passage"])
        n += len(r["norm"])
        if n >= BLOCK:
            blocks.append(spark.sparkContext.broadcast(Phrases(texts, names)))
            texts, names, n = [], [], 0
    if texts:
        blocks.append(spark.sparkContext.broadcast(Phrases(texts, names)))
    if not blocks:
        return spark.createDataFrame([], "item_id long, doc_id long, start long, stop long")
    spans = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_scan(blocks), "doc_id long, passage long, start long, stop long")
    named = folded.join(distinct, "norm").select("passage", "item_id")
    return spans.join(named, "passage").select("item_id", "doc_id", "start", "stop")


def removal_spans(spans: DataFrame) -> DataFrame:
    """doc_id, start, stop: the spans of all items in a document, merged where they touch."""
    w = W.partitionBy("doc_id").orderBy("start", "stop")
    seen = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = spans.select("doc_id", "start", "stop").distinct().withColumn("new", F.when(F.col("start") <= seen, 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    return cut.groupBy("doc_id", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")
