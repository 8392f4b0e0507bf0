"""Exact substring dedup over a compacted De Bruijn graph of sampled token k-mers.

Nodes are the minimizer k-mers of a document (the smallest k-mer hash of every ``reach`` successive
k-mers); the words from one node to the end of the next are an edge, named by their hash. ``reach``
is chosen so that any ``window`` successive words hold a whole edge, and equal windows hold the same
inner edges: a window can only repeat if all its edges do.

Edges of one document only are dropped. Two neighbouring edges form a nonbranching link if their
occurrences are the same places shifted by one, which an exclusive-or of place hashes tells without
gathering them; paths of such links compact to one span whose windows all have the same documents.
Windows inside such a span are settled by the smallest document of the span. The others, at branches
and at the ends of repeated text, are compared by a 96-bit hash of all their words. Spans are verified by
hashes at their coordinates, not by reading the source's words again: a span has two edges or more, whose 64-bit
hashes must all agree. Paths are put together inside a document, after a join has told which links don't branch.

No step gathers the documents of an edge: groups are aggregated (minimum, maximum, count, exclusive
or) before the shuffle and joined back, so a passage in a third of all documents stays spread out.

Edge cases: a null text has no words; a text shorter than the window keeps all its words. A row with
a null ``doc_id`` is neither source nor changed. Rows that repeat an id aren't sources of each other.
A periodic text is cut by its own repeats in other documents only. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fresh, table, words
from cairn.sources.scratch import cut_lineage

KMER = 5
WINDOW = 50
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of word spans of one text, from prefix sums of a polynomial modulo 2^64."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        self.power, self.inverse = self._powers(base, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.power[:n], out=self.sums[1:])

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls.powers or len(cls.powers[base][0]) <= n:
            size = max(4096, 2 * n)
            cls.powers[base] = tuple(
                np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)], dtype=np.uint64)
                for b in (base, pow(base, -1, 1 << 64))
            )
        return cls.powers[base]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def word_hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))


def edges(rolling: Rolling, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word, end and turn of every edge of a text of at least ``window`` words.

    The turn is the last start of ``reach`` k-mers whose smallest is the edge's first node. The edge
    is an inner one of a window, and so in every place of it, if the window holds all words of the
    k-mers from the turn and of those from the place after it.
    """
    reach = (window - KMER + 1) // 2
    first = np.arange(len(rolling.sums) - KMER)
    kmers = rolling.spans(first, first + KMER)
    nodes = np.lib.stride_tricks.sliding_window_view(kmers, reach).argmin(1)
    nodes += np.arange(len(nodes))
    turn = np.flatnonzero(nodes[1:] != nodes[:-1])
    start, end = nodes[turn], nodes[turn + 1] + KMER
    return rolling.spans(start, end), start, end, turn


def _edge_lists(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for text in batch.column(2):
                parts = text.as_py().split()
                if len(parts) < window:
                    lists.append(np.zeros(0, np.int64))
                    continue
                rolling = Rolling(word_hashes(parts), BASES[0])
                lists.append(edges(rolling, window)[0].view(np.int64))
            sizes = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(sizes, flat)],
                names=["doc_id", "tkey", "edges"],
            )

    return run


def _packed(window: int):
    """Compressed texts of at least ``window`` words: the only long column that is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            long = [i for i, x in enumerate(texts) if len(x.split(None, window)) >= window]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(long, pa.int32())) for c in (0, 1)),
                    pa.array([press.compress(texts[i]) for i in long], pa.binary()),
                ],
                names=["doc_id", "tkey", "packed"],
            )

    return run


def _spread(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges low..high (inclusive)."""
    ok = low <= high
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, low[ok], 1)
    np.add.at(steps, high[ok] + 1, -1)
    return np.cumsum(steps[:n]) > 0


def _resolve(window: int):
    """Per document with repeated edges: settled window starts and hashes of the open windows."""
    reach = (window - KMER + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("packed", "settled", "start", "h1", "h2", "open")}
            keep = []
            for r in range(batch.num_rows):
                me = batch.column(0)[r].as_py()
                packed = batch.column(2)[r].as_py()
                rows = batch.column(3)[r].values
                parts = press.decompress(packed).split()
                hashes = word_hashes(parts)
                rolling = Rolling(hashes, BASES[0])
                _, start, end, turn = edges(rolling, window)
                places = len(parts) - window + 1
                at = rows.field("i").to_numpy(zero_copy_only=False)
                order = np.argsort(at)
                at = at[order]
                column = lambda k: rows.field(k).to_numpy(zero_copy_only=False)[order]
                links_out, links_in = column("o"), column("p")
                lows = np.array(rows.field("lo").to_pylist(), object)[order]
                earlier = (lows < me).astype(bool)

                def inner(which: np.ndarray) -> np.ndarray:
                    """Windows that have one of these edges as an inner one."""
                    low = turn[which] + 1 + reach + KMER - 1 - window
                    return _spread(places, np.maximum(low, 0), np.minimum(turn[which], places - 1))

                single = np.ones(len(start), bool)
                single[at] = False
                repeated = ~inner(np.flatnonzero(single))
                linked = (
                    (np.diff(at) == 1)
                    & (links_out[:-1] == links_in[1:])
                    & (lows[:-1] == lows[1:])
                )
                head = np.flatnonzero(np.r_[True, ~linked])
                tail = np.r_[head[1:], len(at)] - 1
                low, high = start[at[head]], end[at[tail]] - window
                inside = _spread(places, low, high)
                settled = _spread(places, low[earlier[head]], high[earlier[head]])
                own = inner(at[~earlier])
                begin = np.flatnonzero(repeated & ~inside)
                asks = ~own[begin]
                done = np.flatnonzero(settled)
                if not len(begin) and not len(done):
                    continue
                keep.append(r)
                other = Rolling(hashes * np.uint64(BASES[1]) ^ (hashes >> np.uint64(29)), BASES[1])
                out["packed"].append(packed if len(done) or asks.any() else None)
                out["settled"].append(done.astype(np.int32))
                out["start"].append(begin.astype(np.int32))
                out["h1"].append(rolling.spans(begin, begin + window).view(np.int64))
                out["h2"].append((other.spans(begin, begin + window) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                out["open"].append(asks)
            if keep:
                ids = [batch.column(c).take(pa.array(keep)) for c in (0, 1, 4)]
                kinds = [pa.binary(), *(pa.list_(x) for x in (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()))]
                cols = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
                yield pa.RecordBatch.from_arrays([*ids, *cols], names=["doc_id", "tkey", "row", *out])

    return run


def cut(text: bytes, starts: list[int], window: int) -> tuple[bytes, int]:
    """The text without the words of the windows at ``starts``, and how many words went.

    Runs of kept words keep the white space between them; runs are joined by one space.
    """
    parts = text.split()
    gone = _spread(len(parts), np.array(starts), np.array(starts) + window - 1)
    pieces, run, at = [], None, 0
    for word, drop in zip(parts, gone.tolist()):
        begin = text.index(word, at)
        at = begin + len(word)
        if drop:
            if run:
                pieces.append(text[run[0] : run[1]])
            run = None
        else:
            run = (run[0] if run else begin, at)
    if run:
        pieces.append(text[run[0] : run[1]])
    return b" ".join(pieces), int(gone.sum())


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            keep, texts, counts = [], [], []
            for r, (me, packed, done, more) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)))
            ):
                starts = {*done, *(x["start"] for x in more or [] if x["lo"] < me)}
                if starts:
                    kept, n = cut(press.decompress(packed), sorted(starts), window)
                    keep.append(r)
                    texts.append(kept)
                    counts.append(n)
            ids = [batch.column(c).take(pa.array(keep, pa.int32())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(texts, pa.binary()), pa.array(counts, pa.int64())],
                names=["doc_id", "tkey", "text", "n_removed"],
            )

    return run


def changes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, tkey, text, n_removed) of the documents that lose words; tkey is the old text's hash.

    A word goes if it lies in ``window`` successive words that also occur in a document with a
    smaller id. All windows are judged on the input.
    """
    if window < 2 * KMER:
        raise ValueError(f"the window needs {2 * KMER} words or more")
    docs = df.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("tkey"),
        F.col(text).cast("binary").alias("text"),
    ).filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = docs.mapInArrow(_edge_lists(window), f"doc_id {kind}, tkey bigint, edges array<bigint>")
    lists = cut_lineage(lists.filter(F.size("edges") > 0).withColumn("row", F.monotonically_increasing_id()))
    placed = lists.select("doc_id", "row", F.posexplode("edges").alias("i", "h"))
    # Written, so that the joins below shuffle both sides afresh and a hot edge can be split.
    graph = cut_lineage(
        placed.groupBy("h")
        .agg(
            F.min("doc_id").alias("lo"),
            F.max("doc_id").alias("hi"),
            F.bit_xor(F.xxhash64("row", "i")).alias("o"),
            F.bit_xor(F.xxhash64("row", F.col("i") - 1)).alias("p"),
        )
        .filter("lo <> hi")
        .drop("hi")
    )
    paths = (
        placed.select("row", "i", "h")
        .join(graph, "h")
        .groupBy("row")
        .agg(F.collect_list(F.struct("i", "lo", "o", "p")).alias("path"))
        .join(lists.groupBy("doc_id", "tkey").agg(F.min("row").alias("row")), "row")
    )
    packed = docs.mapInArrow(_packed(window), f"doc_id {kind}, tkey bigint, packed binary")
    found = cut_lineage(
        packed.join(paths, ["doc_id", "tkey"])
        .select("doc_id", "tkey", "packed", "path", "row")
        .mapInArrow(
            _resolve(window),
            f"doc_id {kind}, tkey bigint, row bigint, packed binary, settled array<int>, "
            "start array<int>, h1 array<bigint>, h2 array<int>, open array<boolean>",
        )
    )
    hashed = found.select(
        "doc_id", "row", F.explode(F.arrays_zip("start", "h1", "h2", "open")).alias("x")
    ).select("doc_id", "row", "x.*")
    shared = cut_lineage(
        hashed.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .filter("lo <> hi")
        .drop("hi")
    )
    hits = (
        hashed.filter("open")
        .select("h1", "h2", "row", "start")
        .join(shared, ["h1", "h2"])
        .groupBy("row")
        .agg(F.collect_set(F.struct("start", "lo")).alias("more"))
    )
    touched = (
        found.filter("packed IS NOT NULL")
        .select("doc_id", "tkey", "packed", "settled", "row")
        .dropDuplicates(["row"])
        .join(hits, "row", "left")
        .filter("size(settled) > 0 OR more IS NOT NULL")
        .select("doc_id", "tkey", "packed", "settled", "more")
    )
    return touched.mapInArrow(
        _cut(window), f"doc_id {kind}, tkey bigint, text binary, n_removed bigint"
    ).withColumn("text", F.col("text").cast("string"))


def drop_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with the repeated words gone from ``text``; texts without repeats stay as they are."""
    old, new, key, id_ = (fresh(df) for _ in range(4))
    done = changes(df, doc_id, text, window).select(
        F.col("doc_id").alias(id_), F.col("tkey").alias(key), F.col("text").alias(new)
    )
    return (
        df.withColumn(old, F.xxhash64(F.col(text)))
        .join(done, (F.col(doc_id) == F.col(id_)) & (F.col(old) == F.col(key)), "left")
        .withColumn(text, F.coalesce(F.col(new), F.col(text)))
        .select(*df.columns)
    )


def digest_report(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``df``."""
    done = changes(df, window=window).select(
        F.col("doc_id").alias("id"),
        F.col("tkey").alias("key"),
        "n_removed",
        F.sha2(F.array_join(words(F.col("text")), " "), 256).alias("sha"),
    )
    whole = df.select("doc_id", F.xxhash64("text").alias("tkey"), words(F.col("text")).alias("w")).select(
        "doc_id",
        "tkey",
        F.size("w").cast("long").alias("n_words"),
        F.sha2(F.array_join("w", " "), 256).alias("all_sha"),
    )
    return whole.join(done, (F.col("doc_id") == F.col("id")) & (F.col("tkey") == F.col("key")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("sha", "all_sha").alias("kept_sha256"),
    )


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digest_report(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by a dictionary of all windows; for tests."""
    first: dict[tuple, int] = {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i, w in split.items():
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = b" ".join(x for a, x in enumerate(w) if a not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out
