"""Token counts under a given merge list, and totals per slice kept up to date through signed deltas.

The tokenizer: a run of the letters A-Z and a-z starts as single letters; while adjacent pieces form a listed pair, the pair of
lowest rank is joined wherever it stands, left to right. Any other character that is not whitespace is one token. Each
distinct word is encoded once per worker.

A `Ledger` is a folder that outlives the session. It holds the token counts by content and tokenizer, to which an update only adds, and per
version the rows (kind, id, source, lang, domain, content, n_tokens) and their totals; `content` is a hash of text and tokenizer. An update
looks the contents of the new deliveries up among the counts and encodes only those that were never seen, each once. It compares the deliveries with the
last version by kind and id: what changed or vanished leaves the totals by a negative row, what came enters by a positive one.

Null and empty texts have no tokens, and no content to look up, so they meet in no join. Null languages and domains fall back on the source's own, spelling variants of
a language to its two-letter code; what stays null is a slice of its own. Repeated ids count once.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.llm.letters import codes

_WORD = re.compile("[A-Za-z]+")
CACHE = 1 << 20  #: distinct words a worker remembers before it starts anew
SLICES = ("kind", "source", "lang", "domain")


class _Counts(dict):
    """Word to its number of pieces, encoded when first asked for."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        pieces = list(word) if len(word) <= 2000 else None
        self[word] = n = len(self.merge(pieces)) if pieces else _long(word, self.ranks)
        return n

    def merge(self, pieces: list[str]) -> list[str]:
        while True:
            best = min(((r, p) for p in zip(pieces, pieces[1:]) if (r := self.ranks.get(p)) is not None), default=None)
            if best is None:
                return pieces
            a, b = best[1]
            out, i = [], 0
            while i < len(pieces):
                if i + 1 < len(pieces) and pieces[i] == a and pieces[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(pieces[i])
                    i += 1
            pieces = out


def _long(word: str, ranks: dict[tuple[str, str], int]) -> int:
    """The same for a very long run: pairs wait in a heap by rank, so that no pass over all pieces is needed. Joining left to
    right by (rank, position) equals joining a rank everywhere at once, as a join makes only pairs of other pieces."""
    import heapq

    piece, prev, nxt = list(word), list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
    alive, heap = [True] * len(word), []
    push = lambda i: (i >= 0 and nxt[i] >= 0 and (r := ranks.get((piece[i], piece[nxt[i]]))) is not None) and heapq.heappush(heap, (r, i, piece[i], piece[nxt[i]]))
    for i in range(len(word)):
        push(i)
    n = len(word)
    while heap:
        # All pairs of one rank that stand now are joined before a new pair of a lower rank is looked at.
        rank = heap[0][0]
        now = []
        while heap and heap[0][0] == rank:
            now.append(heapq.heappop(heap))
        touched = []
        for _, i, a, b in now:
            j = nxt[i] if alive[i] else -1
            if j < 0 or piece[i] != a or piece[j] != b:
                continue
            piece[i], alive[j], nxt[i] = a + b, False, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            n -= 1
            touched.append(i)
        for i in touched:
            push(prev[i])
            push(i)
    return n


class Tokenizer:
    def __init__(self, merges: list[tuple[str, str]]):
        """merges in the order of their ranks."""
        self.merges = merges
        self.name = hashlib.sha256("\n".join(f"{a} {b}" for a, b in merges).encode()).hexdigest()[:16]
        self._words = None

    @classmethod
    def of(cls, merges: DataFrame) -> Tokenizer:
        """From rows (merge_rank, left_piece, right_piece): a tokenizer's own table, as long as its vocabulary."""
        rows = merges.where("left_piece IS NOT NULL AND right_piece IS NOT NULL").orderBy("merge_rank").collect()
        return cls([(r["left_piece"], r["right_piece"]) for r in rows])

    def __getstate__(self):
        return {"merges": self.merges, "name": self.name, "_words": None}

    def encode(self, word: str) -> list[str]:
        return self.words.merge(list(word))

    @property
    def words(self) -> _Counts:
        if self._words is None:
            ranks: dict[tuple[str, str], int] = {}
            for k, p in enumerate(self.merges):
                ranks.setdefault(p, k)
            self._words = _Counts(ranks)
        return self._words

    def count(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0, np.int64)
        texts = [t or "" for t in texts]
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        single = np.concatenate([[0], np.cumsum(_SINGLE[codes("".join(texts))])])
        stop = np.cumsum(n)
        get, find = self.words.__getitem__, _WORD.findall
        return single[stop] - single[stop - n] + np.fromiter((sum(map(get, find(t))) for t in texts), np.int64, len(texts))


# True at code points that are a token of their own.
_SINGLE = np.ones(sys.maxunicode + 1, bool)
_SINGLE[[c for c in range(0x3001) if chr(c).isspace() or chr(c).isascii() and chr(c).isalpha()]] = False


def language(lang: Column, fallback: Column) -> Column:
    """The two-letter code of a spelling variant: eng and en-US are en, zh_Hans is zh; the fallback for null."""
    head = F.lower(F.regexp_extract(lang, "^[A-Za-z]+", 0))
    return F.coalesce(F.when(F.length(head) >= 2, F.substring(head, 1, 2)), F.lower(fallback))


def content(text: Column, tokenizer: Tokenizer) -> Column:
    return F.when(text != "", F.unhex(F.md5(F.concat(F.lit(tokenizer.name + "\n"), text))))


def encoded(rows: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """rows with n_tokens in place of the text."""
    rest = [c for c in rows.columns if c != text]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), pa.array(tokenizer.count(b[text].to_pylist()), pa.int64())], names=[*rest, "n_tokens"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "n_tokens long"]))


def deliveries(records: DataFrame, documents: DataFrame, datasets: DataFrame) -> DataFrame:
    """kind, id, source, lang, domain, text of both tables; a record's domain, and a missing language, are its dataset's."""
    d = datasets.where("key IS NOT NULL").dropDuplicates(["key"]).select(F.col("key").alias("source"), F.col("lang").alias("own_lang"), F.col("domain").alias("own_domain"))
    none = F.lit(None).cast("string")
    both = records.select(F.lit("record").alias("kind"), F.col("id"), "source", "lang", none.alias("domain"), F.col("context").alias("text")).unionByName(
        documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "source", "lang", "domain", "text")
    )
    joined = both.where("id IS NOT NULL").join(d, "source", "left")
    return joined.select("kind", "id", "source", language(F.col("lang"), F.col("own_lang")).alias("lang"), F.coalesce("domain", F.when(F.col("kind") == "record", F.col("own_domain"))).alias("domain"), "text")


def first_ledger(new: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """The rows of deliveries when there were none before."""
    return update(None, new, tokenizer)


def unseen(known: DataFrame | None, new: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """content and n_tokens of what `new` has and `known` (content, n_tokens) hasn't: each content is encoded once, however many rows have it."""
    texts = new.select(content(F.col("text"), tokenizer).alias("content"), "text").where("content IS NOT NULL")
    if known is not None:
        texts = texts.join(known.select("content"), "content", "left_anti")
    return encoded(texts.dropDuplicates(["content"]), tokenizer)


def rows_of(counts: DataFrame, new: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """The rows of `new`, once per kind and id, with their n_tokens by counts (content, n_tokens)."""
    hashed = new.withColumn("content", content(F.col("text"), tokenizer)).drop("text").dropDuplicates(["kind", "id"])
    return hashed.where("content IS NOT NULL").join(counts, "content").unionByName(hashed.where("content IS NULL").withColumn("n_tokens", F.lit(0).cast("long")))


def update(ledger: DataFrame | None, new: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """The rows of `new`, a whole delivery, encoding each content that the rows of `ledger` don't have once."""
    known = ledger.where("content IS NOT NULL").groupBy("content").agg(F.max("n_tokens").alias("n_tokens")) if ledger is not None else None
    added = unseen(known, new, tokenizer)
    return rows_of(added.unionByName(known) if known is not None else added, new, tokenizer)


class Ledger:
    """The counts, rows and totals under one folder. A version is there once it is written whole; an update that was
    cut off leaves the last one as it was, and the counts it added stay good."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def _there(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._there("")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[8:]) for n in names if n.startswith("version-") and fs.exists(self._there(f"{n}/totals/_SUCCESS")[0]))

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{path}")

    def counts(self, tokenizer: Tokenizer) -> DataFrame | None:
        p, fs = self._there(f"counts/{tokenizer.name}")
        return self._read(f"counts/{tokenizer.name}").dropDuplicates(["content"]) if fs.exists(p) else None

    def rows(self) -> DataFrame | None:
        v = self.versions()
        return self._read(f"version-{v[-1]}/rows") if v else None

    def totals(self) -> DataFrame | None:
        v = self.versions()
        return self._read(f"version-{v[-1]}/totals") if v else None

    def update(self, new: DataFrame, tokenizer: Tokenizer) -> DataFrame:
        """Takes in `new`, a whole delivery, and gives the totals after it."""
        write = lambda df, path, mode="overwrite": df.write.mode(mode).option("compression", "zstd").parquet(f"{self.folder}/{path}")
        write(unseen(self.counts(tokenizer), new, tokenizer), f"counts/{tokenizer.name}", "append")
        old, cube, n = self.rows(), self.totals(), (self.versions() or [0])[-1] + 1
        write(rows_of(self.counts(tokenizer), new, tokenizer), f"version-{n}/rows")
        rows = self._read(f"version-{n}/rows")
        write(budget(rows) if old is None else updated(cube, deltas(old, rows)), f"version-{n}/totals")
        return self._read(f"version-{n}/totals")


def deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per slice, what enters and leaves between two ledgers: n_docs and n_tokens, signed."""
    cols = (*SLICES[1:], "content", "n_tokens")
    side = lambda df, k: df.select("kind", "id", *(F.col(c).alias(f"{c}_{k}") for c in cols), F.lit(True).alias(f"in_{k}"))
    both = side(old, "a").join(side(new, "b"), ["kind", "id"], "full")
    same = F.coalesce(F.col("in_a") & F.col("in_b"), F.lit(False))
    for c in cols:
        same = same & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    one = lambda k, sign: F.struct(*(F.col(f"{c}_{k}").alias(c) for c in SLICES[1:]), (F.lit(sign) * F.col(f"n_tokens_{k}")).alias("n_tokens"), F.lit(sign).cast("long").alias("n_docs"), F.col(f"in_{k}").alias("there"))
    rows = both.where(~same).select("kind", F.explode(F.array(one("a", -1), one("b", 1))).alias("x")).where("x.there").select("kind", "x.*")
    return rows.groupBy(*SLICES).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def budget(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*SLICES).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def updated(cube: DataFrame, change: DataFrame) -> DataFrame:
    """A budget after a change; slices that have become empty go."""
    return cube.unionByName(change).groupBy(*SLICES).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs > 0")
