"""Spans of at least LEAST characters that stand verbatim in more than one document.

A text falls into sentences. As a text may have none for long, a sentence also begins wherever, among REACH starting
positions in a row without a sentence's beginning, the hash of the next GRAM characters is smallest; so in any stretch of LEAST
characters a sentence begins within REACH + 1 characters at a place that the same stretch in another text has too. From each beginning the
run of the following sentences is hashed: up to the sentence that begins INNER to INNER + REACH - 1 characters later. Where two texts
have LEAST characters in common, the run of the first beginning lies within them in both, so they share its hash.

Pairs: texts that share a run of at most HOT texts are compared character by character. A stock phrase a little shorter than LEAST may
give a third of all texts the same run; the run then gives way to the hashes of all windows of LEAST characters around it, so
that only texts meet that do share a stretch. Which runs are that frequent is counted exactly, and HOT doesn't depend on the data.

Spans and shares need no pairs. Of each text the windows of LEAST characters around runs that stand in several texts are
counted over all texts by their 64-bit hash: a window of several texts is shared, and what such windows cover makes up the
spans. A span is removable where its windows stand in a text of smaller id as well; a sentence that removable spans cover goes.

Equal texts are one class, named by its smallest document; its members are spread at the end. A run counts once per text. Null
texts and those under LEAST characters take part in nothing. Repeated rows of a document count once. Repetition within one
document alone is no sharing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.letters import codes, mix, ragged, windows
from sievemill.session import stored

LEAST, REACH, GRAM = 200, 32, 8
INNER = 2 * REACH + GRAM - 1  #: by how much the distance from a run's first beginning to its last one is below LEAST, at least
# The characters that end a sentence.
ENDS = ".!?。！？；;\n"
HOT = 200
SLICE = 1 << 18  #: code points handled at once, for the processor's cache
_BASE = 0x9E3779B97F4A7C15


def _slide(a: np.ndarray, width: int, op, back: bool = False) -> np.ndarray:
    """op over the `width` values from each position on, or up to it."""
    out, done = a.copy(), 1
    while done < width:
        step = min(done, width - done)
        if back:
            out[step:] = op(out[step:], out[:-step].copy())
        else:
            out[:-step] = op(out[:-step], out[step:].copy())
        done += step
    return out


def _ended(a: np.ndarray) -> np.ndarray:
    """True where the character before is the last of several that end a sentence; False at the first."""
    end = np.isin(a, codes(ENDS))
    out = np.zeros(len(a), bool)
    out[1:] = end[:-1] & ~end[1:]
    return out


def beginnings(a: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The positions where a sentence begins; the rank of each position as a beginning, smallest first, and the smallest one among
    the REACH from each position on, 0 where they aren't all within the text; a, start and n as of ragged()."""
    key = mix(windows(a, GRAM)) >> np.uint64(1)
    key[~_ended(a)] |= np.uint64(1 << 63)
    row = np.repeat(np.arange(len(n)), n)
    left = (start + n)[row] - np.arange(len(a))
    least = _slide(key, REACH, np.minimum)
    least[left < REACH + GRAM - 1] = 0  # the window leaves its text
    least[start[n > 0]] = 0  # what precedes the first character is unknown in a stretch
    reach = _slide(least, REACH, np.maximum, back=True)
    return np.flatnonzero((reach == key) & (reach > 0)), key, least


def _powers(n: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2^64."""
    if len(cache.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE), base, np.uint64)
            p[0] = 1
            cache[name] = np.multiply.accumulate(p)
    return cache["up"][:n], cache["down"][:n]


def runs_of(a: np.ndarray, start: np.ndarray, n: np.ndarray, least: int, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of the run of sentences from each beginning on, where one ends within its text."""
    every, key, lowest = beginnings(a, start, n)
    begin = every
    goal = begin + (least - INNER)
    begin, goal = begin[goal < len(a)], goal[goal < len(a)]
    fits = lowest[goal] > 0
    begin, goal = begin[fits], goal[fits]
    row = np.repeat(np.arange(len(n)), n)
    same = row[begin] == row[goal]
    begin, goal = begin[same], goal[same]
    at = np.searchsorted(every, goal)
    todo = np.arange(len(goal))
    while len(todo := todo[key[every[at[todo]]] != lowest[goal[todo]]]):
        at[todo] += 1
    end = every[at]
    up, down = _powers(len(a) + 1, cache)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return begin, end, mix((total[end] - total[begin]) * down[begin] ^ (end - begin).astype(np.uint64) << np.uint64(48))


def _slices(batch: pa.RecordBatch, cache: dict, least: int):
    """Parts of a batch: its rows from and to, code points, starts, lengths, and of each run row, begin, end and hash."""
    texts, at = batch["text"].to_pylist(), 0
    while at < len(texts):
        stop, total = at, 0
        while stop < len(texts) and (stop == at or total + len(texts[stop]) <= SLICE):
            total += len(texts[stop])
            stop += 1
        a, start, n = ragged(texts[at:stop])
        begin, end, h = runs_of(a, start, n, least, cache)
        yield at, stop, a, start, n, np.searchsorted(start, begin, "right") - 1, begin, end, h.view(np.int64)
        at = stop


def _runs(least: int):
    """Run and cid of every run, once per text."""
    cache: dict = {}

    def run(batches):
        for b in batches:
            cid = b["cid"].to_numpy()
            for at, _, *_, row, _, _, h in _slices(b, cache, least):
                pair = np.unique(np.stack([h, row], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(cid[at + pair[:, 1]])], names=["run", "cid"])

    return run


def _tagged(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row and run in one number; should two ever be taken for one, some more windows are looked at."""
    return h.view(np.uint64) + mix(row.astype(np.uint64) + np.uint64(1))


def _around(least: int, places: bool):
    """cid and hash of the windows of `least` characters that hold one of the text's own `runs` whole, with their place if asked for,
    or once per text if not."""
    cache: dict = {}

    def run(batches):
        for b in batches:
            cid, chosen = b["cid"].to_numpy(), b["runs"]
            for at, stop, a, start, n, row, begin, end, h in _slices(b, cache, least):
                own = chosen.slice(at, stop - at)
                which = np.repeat(np.arange(stop - at), np.diff(own.offsets.to_numpy()))
                keep = np.isin(_tagged(row, h), _tagged(which, own.flatten().to_numpy()))
                row, begin, end = row[keep], begin[keep], end[keep]
                # Marks where such windows begin, added up: +1 from the first place on, -1 after the last.
                first, last = np.maximum(end - least, start[row]), np.minimum(begin, (start + n)[row] - least)
                some = first <= last
                mark = np.zeros(len(a) + 1, np.int64)
                np.add.at(mark, first[some], 1)
                np.add.at(mark, last[some] + 1, -1)
                place = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                w = mix(windows(a, least)[place] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)
                of = np.searchsorted(start, place, "right") - 1
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(cid[at + of]), pa.array(place - start[of], pa.int32())], names=["window", "cid", "place"])
                else:
                    pair = np.unique(np.stack([w, of], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(cid[at + pair[:, 1]])], names=["window", "cid"])

    return run


def in_common(x: str, y: str, least: int = LEAST) -> bool:
    """Whether two texts share a stretch of `least` characters: windows of one hash are compared."""
    hx, hy = (windows(codes(t), least)[: max(0, len(t) - least + 1)] for t in (x, y))
    _, i, j = np.intersect1d(hx, hy, return_indices=True)
    return any(x[k : k + least] == y[m : m + least] for k, m in zip(i.tolist(), j.tolist()))


def _confirmed(least: int):
    def run(batches):
        for b in batches:
            yes = [in_common(x, y, least) for x, y in zip(b["text_a"].to_pylist(), b["text_b"].to_pylist())]
            yield b.select(["cid_a", "cid_b"]).filter(pa.array(yes, pa.bool_()))

    return run


def classes(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(cid, doc_id) of the documents of `least` characters or more by class of equal texts, and (cid, text) of the classes."""

    def digest(batches):
        for b in batches:
            keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(keys, pa.binary())], names=["doc_id", "key"])

    rows = documents.select("doc_id", "text").where(f"doc_id IS NOT NULL AND length(text) >= {least}")
    keyed = rows.mapInArrow(digest, "doc_id long, key binary")
    names = keyed.groupBy("key").agg(F.min("doc_id").alias("cid"))
    members = stored(keyed.join(names, "key").select("cid", "doc_id").distinct(), "p8-members")
    texts = stored(rows.join(members.select(F.col("cid").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("cid"), "text"), "p8-texts")
    return members, texts


def linked(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """cid_a < cid_b of all pairs of classes with a stretch of `least` characters in common."""
    runs = texts.mapInArrow(_runs(least), "run long, cid long")
    hot = stored(runs.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("run"), "p8-hot")
    pairs = lambda df, key: df.withColumnRenamed("cid", "cid_a").join(df.withColumnRenamed("cid", "cid_b"), key).where("cid_a < cid_b").select("cid_a", "cid_b").distinct()
    maybe = pairs(runs.join(hot, "run", "left_anti"), "run")
    ta, tb = (texts.select(F.col("cid").alias(f"cid_{k}"), F.col("text").alias(f"text_{k}")) for k in "ab")
    near = maybe.join(ta, "cid_a").join(tb, "cid_b").mapInArrow(_confirmed(least), "cid_a long, cid_b long")
    often = runs.join(hot, "run", "left_semi").groupBy("cid").agg(F.collect_list("run").alias("runs"))  # as many as a text has
    wide = texts.join(often, "cid").mapInArrow(_around(least, False), "window long, cid long")
    return near.unionByName(pairs(wide, "window")).distinct()


def sharing_pairs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id_a < doc_id_b of all pairs of documents with a stretch of `least` characters in common."""
    members, texts = classes(documents, least)
    ma, mb = (members.select(F.col("cid").alias(f"cid_{k}"), F.col("doc_id").alias(f"doc_{k}")) for k in "ab")
    across = linked(texts, least).join(ma, "cid_a").join(mb, "cid_b").select("doc_a", "doc_b")
    same = members.withColumnRenamed("doc_id", "doc_a").join(members.withColumnRenamed("doc_id", "doc_b"), "cid").where("doc_a < doc_b").select("doc_a", "doc_b")
    return across.unionByName(same).select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b"))


def links(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, class_id (the smallest document of equal text) and n_links, the other documents it shares a stretch with, for every document
    of `least` characters or more. Pairs are those of classes."""
    members, texts = classes(documents, least)
    size = members.groupBy("cid").agg(F.count("*").alias("copies"))
    pairs = stored(linked(texts, least), "p8-links")
    both = pairs.unionByName(pairs.select(F.col("cid_b").alias("cid_a"), F.col("cid_a").alias("cid_b")))
    per = both.join(size.withColumnRenamed("cid", "cid_b"), "cid_b").groupBy(F.col("cid_a").alias("cid")).agg(F.sum("copies").alias("others"))
    out = members.join(size, "cid").join(per, "cid", "left")
    return out.select("doc_id", F.col("cid").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def _spans(least: int):
    """The windows of a text, and those of them that stand in a smaller document too, as spans without gaps."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for cid, *both in zip(b["cid"].to_pylist(), *(b[c] for c in ("places", "later"))):
                for later, places in enumerate(both):
                    at = np.sort(places.values.to_numpy())
                    if not len(at):
                        continue
                    new = np.flatnonzero(np.diff(at, prepend=at[0] - least - 1) > least)
                    stop = at[np.append(new[1:], len(at)) - 1] + least
                    for c, v in zip(out, ([cid] * len(new), [bool(later)] * len(new), at[new].tolist(), stop.tolist())):
                        c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.int32(), pa.int32()))], names=["cid", "later", "start", "stop"])

    return run


def class_spans(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """cid, later, start, stop: what of a class's text stands in other classes too, as spans without gaps; and, `later`, what of it stands
    in a class of smaller name."""
    runs = texts.mapInArrow(_runs(least), "run long, cid long")
    several = runs.groupBy("run").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a < b").select("run")
    chosen = runs.join(several, "run", "left_semi").groupBy("cid").agg(F.collect_list("run").alias("runs"))  # as many as a text has
    held = stored(texts.join(chosen, "cid").mapInArrow(_around(least, True), "window long, cid long, place int"), "p8-windows")
    first = held.groupBy("window").agg(F.min("cid").alias("first"), F.max("cid").alias("last")).where("first < last").select("window", "first")
    spots = held.join(first, "window").select("cid", "place", F.when(F.col("cid") > F.col("first"), F.col("place")).alias("late"))
    places = spots.groupBy("cid").agg(F.collect_list("place").alias("places"), F.collect_list("late").alias("later"))
    return places.mapInArrow(_spans(least), "cid long, later boolean, start int, stop int")


def spans(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, stop of the stretches of each document that stand in another one too, joined where they touch."""
    members, texts = classes(documents, least)
    lone = members.groupBy("cid").agg(F.count("*").alias("copies"))
    found = class_spans(texts, least).where("NOT later")
    m = members.join(lone, "cid")
    parts = m.where("copies = 1").join(found, "cid").select("doc_id", "start", "stop")
    whole = m.where("copies > 1").join(texts, "cid").select("doc_id", F.lit(0).alias("start"), F.length("text").alias("stop"))
    return parts.unionByName(whole)


def shares(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document with a stretch shared: its length, the characters that stand elsewhere too, and those to remove, being
    the ones that stand in a document of smaller id."""
    members, texts = classes(documents, least)
    n = lambda later: F.coalesce(F.sum(F.when(F.col("later") == later, F.col("stop") - F.col("start"))), F.lit(0))
    per = class_spans(texts, least).groupBy("cid").agg(n(False).alias("shared"), n(True).alias("later"))
    size = members.groupBy("cid").agg(F.count("*").alias("copies")).join(texts.select("cid", F.length("text").alias("n_chars")), "cid")
    m = members.join(size, "cid").join(per, "cid", "left")
    out = m.select(
        "doc_id",
        "n_chars",
        F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).cast("long").alias("n_shared"),
        F.when(F.col("doc_id") > F.col("cid"), F.col("n_chars")).otherwise(F.coalesce("later", F.lit(0))).cast("long").alias("n_removed"),
    )
    return out.where("n_shared > 0")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the sentences that the spans cover; a sentence ends after the last of several characters that end one."""
    a = codes(text)
    cut = np.concatenate([[0], np.flatnonzero(_ended(a)), [len(a)]])
    mark = np.zeros(len(a) + 1, np.int64)
    for start, stop in spans:
        mark[start] += 1
        mark[stop] -= 1
    under = np.concatenate([[0], np.cumsum(np.cumsum(mark)[:-1] > 0)])
    return "".join(text[i:j] for i, j in zip(cut.tolist(), cut[1:].tolist()) if under[j] - under[i] < j - i)


def deduplicated(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and text_kept of every document that loses a sentence: sentences go that are covered by spans standing in a document of
    smaller id. Of equal documents all but the first lose everything."""
    members, texts = classes(documents, least)

    def cut(batches):
        for b in batches:
            kept = [without(t, [(s["start"], s["stop"]) for s in spans]) for t, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist())]
            less = pa.array([len(k) < len(t) for k, t in zip(kept, b["text"].to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["cid"], pa.array(kept, pa.string())], names=["doc_id", "text_kept"]).filter(less)

    later = class_spans(texts, least).where("later").groupBy("cid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    firsts = texts.join(later, "cid").mapInArrow(cut, "doc_id long, text_kept string")
    return firsts.unionByName(members.where("doc_id > cid").select("doc_id", F.lit("").alias("text_kept")))
