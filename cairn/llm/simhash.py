"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code has a code
word within three bits of every 23-bit word; a segment yields the indices of all code words within
four bits (one, or six where the nearest lies at three bits). Segments that differ in two bits or
fewer have such a code word in common: the word half way between them lies within three bits of one.
Of three segments with five wrong bits or fewer in all, two have at most two, so fingerprints within
five bits share the index pair of two segments. Pairs that share a key are verified bit by bit.

Dense groups: first, members that share a nearest key link to at most three hubs of it, which joins
a group of near copies by stars. Pairs are then made across the groups so found only, so two members
of one group never meet, and the links still connect the same fingerprints.

Edge cases: a null or blank text has fingerprint zero and links like any other. A null ``doc_id`` is
carried through and never names a component unless all its documents have none. Repeated rows give
repeated results. An empty table gives an empty table. Other columns of the input aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fresh, table
from cairn.llm.graph import components
from cairn.sources.scratch import cut_lineage, discard, passing

SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
CHECK_BITS = 11


def _remainder(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, CHECK_BITS - 1, -1):
        x ^= np.where((x >> bit) & 1, GENERATOR << (bit - CHECK_BITS), 0)
    return x


def golay_patterns() -> np.ndarray:
    """By syndrome, up to six error patterns of four bits or fewer; -1 where there are no more."""
    table = np.full((1 << CHECK_BITS, 6), -1, dtype=np.int64)
    filled = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)])
        for e, s in zip(errors.tolist(), _remainder(errors).tolist()):
            table[s, filled[s]] = e
            filled[s] += 1
    return table


def golay_indices(x: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Indices of the code words within four bits of each 23-bit word, six columns, -1 for none."""
    found = patterns[_remainder(x)]
    return np.where(found >= 0, (x[:, None] ^ found) >> CHECK_BITS, -1)


def fuzzy_keys(
    fingerprints: np.ndarray, patterns: np.ndarray, nearest: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: index pairs of every two segments, tagged with the segments."""
    bits = fingerprints.view(np.uint64)
    parts = [
        golay_indices(
            ((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64), patterns
        )[:, : 1 if nearest else None]
        for at, width in SEGMENTS
    ]
    rows, keys = [], []
    for tag, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        a, b = parts[i][:, :, None], parts[j][:, None, :]
        row, *_ = np.nonzero((a >= 0) & (b >= 0))
        rows.append(row)
        keys.append(((tag << 24) | (a << 12) | b)[(a >= 0) & (b >= 0)])
    return np.concatenate(rows), np.concatenate(keys).astype(np.int32)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    by = hashes.view(np.uint8).reshape(len(hashes), 8)
    if len(hashes) < 256:
        return np.unpackbits(by, axis=1, bitorder="little").sum(0)
    of_byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.concatenate(
        [np.bincount(by[:, k], minlength=256) @ of_byte.astype(np.int64) for k in range(8)]
    )


def simhash(hashes: np.ndarray) -> int:
    """Signed 64 bits: a bit is set if more than half the hashes set it; zero for no hash."""
    if not len(hashes):
        return 0
    over = 2 * bit_counts(hashes) > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.int64)[0])


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of lower-cased words, repeats included."""
    parts = (text or b"").lower().split()
    joined = b" ".join(parts)
    if len(parts) <= size:
        one = [xxhash.xxh64_intdigest(joined, 42)] if parts else []
        return np.array(one, dtype=np.uint64)
    width = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(width + 1) - 1
    start = (end - width)[: len(parts) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], 42) for a, b in zip(start, end[size - 1 :].tolist())], dtype=np.uint64
    )


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp) for each row of (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(shingle_hashes(t.as_py(), size)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp bigint"
    )


def keyed(fps: DataFrame, with_: str, nearest: bool = False) -> DataFrame:
    """(key, fp, with_) for each row of ``fps`` and each of its keys, or its three nearest keys.

    The result has about 85 times the rows of ``fps``, which Spark's size estimate doesn't know: joins
    on it ask for a merge join, so that it is never broadcast.
    """
    patterns = golay_patterns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column(0).to_numpy(zero_copy_only=False)
                rows, keys = fuzzy_keys(fp, patterns, nearest)
                other = part.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(fp[rows]), pa.array(other[rows])],
                    names=["key", "fp", with_],
                )

    return fps.select("fp", with_).mapInArrow(run, f"key int, fp bigint, {with_} bigint")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _stars(fps: DataFrame, most: int) -> DataFrame:
    """Links from the fingerprints of a nearest key to its most copied, smallest and largest one."""
    keys = keyed(fps, "copies", nearest=True)
    hubs = keys.groupBy("key").agg(
        F.max(F.struct("copies", "fp")).alias("top"),
        F.min("fp").alias("lo"),
        F.max("fp").alias("hi"),
    )
    hubs = hubs.filter("lo <> hi").select("key", F.array("top.fp", "lo", "hi").alias("hubs"))
    met = keys.join(hubs.hint("merge"), "key").select(F.col("fp").alias("a"), F.explode("hubs").alias("b"))
    return met.filter((F.col("a") != F.col("b")) & (distance(F.col("a"), F.col("b")) <= most))


def _first_tag(a: Column, b: Column) -> Column:
    """The tag of the first two segments with two differing bits or fewer."""
    x = a.bitwiseXOR(b)
    close = [
        F.bit_count(F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1))) <= 2
        for at, width in SEGMENTS
    ]
    return F.when(close[0] & close[1], 0).when(close[0] & close[2], 1).when(close[1] & close[2], 2)


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): links between different fingerprints that connect all within ``most`` (up to five) bits.

    Stars over the three nearest keys come first and merge what is dense; the full keys then only
    make pairs across the groups found, each pair once for each code word pair that it shares.
    """
    if most > 5:
        raise ValueError("two of three segments with two errors or fewer cover five bits at most")
    star = cut_lineage(_stars(fps, most).distinct())
    with passing() as kept:
        grouped = fps.join(components(star, "a", "b"), F.col("fp") == F.col("node"), "left").select(
            "fp", F.coalesce("root", "fp").alias("root")
        )
        grouped = kept(grouped)
    keys = keyed(grouped, "root").repartition("key")  # both sides of the join read one shuffle
    one = keys.select("key", F.col("fp").alias("a"), F.col("root").alias("ra"))
    two = keys.select(F.col("key").alias("other"), F.col("fp").alias("b"), F.col("root").alias("rb"))
    rest = one.join(
        two.hint("merge"),
        (F.col("key") == F.col("other"))
        & (F.col("a") < F.col("b"))
        & (F.col("ra") != F.col("rb"))
        & (distance(F.col("a"), F.col("b")) <= most)
        & (F.shiftright("key", 24) == _first_tag(F.col("a"), F.col("b"))),
    ).select("a", "b")
    return star.union(rest).distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, by four-word shingles and four bits."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    each = cut_lineage(fingerprints(docs))
    fps = cut_lineage(
        each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    )
    roots = components(links(fps), "a", "b")
    grouped = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = grouped.join(
        grouped.groupBy("root").agg(F.min("first").alias("component_id")), "root"
    ).select("fp", "component_id")
    return each.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Texts, and shingles of each, in the sample that tells common shingles from rare ones.
SAMPLE_TEXTS = 4000
SAMPLE_SHINGLES = 1000
#: Longs of a text's parity bits: beside its shingles, and in its signature at least.
PARITY_LONGS = 4
SIGNATURE_LONGS = 32
#: Slots of the mask that thins out texts before their join.
MASK_SLOTS = 1 << 22
BITS = [f"p{k}" for k in range(PARITY_LONGS)]


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def prefix_length(n: int, least: float) -> int:
    """So many first shingles, in any fixed order, that two sets with Jaccard ``least`` share one of them."""
    return n - math.ceil(least * n - 1e-9) + 1


def parity(hashes: np.ndarray, longs: int = PARITY_LONGS) -> np.ndarray:
    """A bit for each of the hash's residues: whether an odd number of hashes has it.

    Two sets differ in at least as many elements as their parity bits differ.
    """
    odd = np.bincount((hashes % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def signature(hashes: np.ndarray) -> bytes:
    """The number of hashes and their parity bits, at least one for each hash: of fewer, unlike sets differ in half."""
    longs = max(SIGNATURE_LONGS, 1 << max(0, len(hashes) - 1).bit_length() >> 6)
    return np.r_[len(hashes), parity(hashes, longs)].tobytes()


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many parity bits two sets differ, in as many as the shorter of the two has."""
    longs = min(len(x), len(y))  # a power of two, so the bits of fewer residues are those of the longer one folded
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, longs), axis=0) for v in (x, y))
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def _common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that three or more sampled texts have, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                one = shingle_set(t.as_py(), size)[:SAMPLE_SHINGLES].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(one)], names=["token"])

    share = SAMPLE_TEXTS / max(1, docs.count())
    drawn = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = docs.filter(drawn).select("text").distinct().select(F.col("text").cast("binary").alias("text"))
    counts = sample.mapInArrow(run, "token bigint").groupBy("token").count().filter("count > 2").toArrow()
    token, count = (counts[c].to_numpy() for c in ("token", "count"))
    order = np.argsort(token.view(np.uint64))
    return token.view(np.uint64)[order], count[order]


def _texts(docs: DataFrame, size: int, least: float) -> DataFrame:
    """The different texts of (doc_id, text): node, first id, hash, number of shingles, first ones, parity, signature, fp.

    The first shingles are the rarest by the sample, ties by hash. A signature is the number and more parity bits.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = sent.value
        for batch in batches:
            sizes, firsts, bits, signatures, fps = [], [], [], [], []
            for t in batch.column(3):
                one = shingle_set(t.as_py(), size)
                fps.append(simhash(shingle_hashes(t.as_py(), 4)))
                bits.append(parity(one))
                signatures.append(signature(one))
                one = one if len(one) else np.zeros(1, np.uint64)
                often = np.zeros(len(one), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, one), len(common) - 1)
                    often = np.where(common[at] == one, count[at], 0)
                sizes.append(len(one))
                firsts.append(one[np.argsort(often, kind="stable")][: prefix_length(len(one), least)].view(np.int64))
            bits = np.reshape(bits, (len(bits), PARITY_LONGS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))]
                + [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(PARITY_LONGS)]
                + [pa.array(signatures, pa.binary()), pa.array(fps, pa.int64())],
                names=["doc_id", "tkey", "tid", "n", "firsts", *BITS, "signature", "fp"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = docs.select(
        "doc_id",
        F.xxhash64("text").alias("tkey"),
        F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("tid"),
        F.col("text").cast("binary").alias("text"),
    ).mapInArrow(
        run,
        f"doc_id {kind}, tkey bigint, tid binary, n int, firsts array<bigint>, "
        + "".join(f"{b} bigint, " for b in BITS)
        + "signature binary, fp bigint",
    )
    found = each.groupBy("tid").agg(
        F.min("doc_id").alias("first"), *[F.min(c).alias(c) for c in ("tkey", "n", "firsts", *BITS, "signature", "fp")]
    )
    return cut_lineage(found.withColumn("node", F.monotonically_increasing_id()).drop("tid"))


def _need(x: Callable[[str], Column], y: Callable[[str], Column], least: float) -> Column:
    """So many shingles two texts with Jaccard ``least`` have in common."""
    return F.ceil((x("n") + y("n")) * (least / (1 + least)) - 1e-9)


def _parities_allow(x: Callable[[str], Column], y: Callable[[str], Column], least: float) -> Column:
    """Whether the parity bits of two texts leave room for Jaccard ``least``."""
    apart = sum((F.bit_count(x(b).bitwiseXOR(y(b))) for b in BITS), F.lit(0))
    return apart <= x("n") + y("n") - 2 * _need(x, y, least)


def _early(x: Callable[[str], Column], y: Callable[[str], Column], least: float) -> Column:
    """Whether a shingle's places leave room for Jaccard ``least``, if it's the first that both texts have.

    By what follows it in each text, which bounds the lengths too.
    """
    return F.least(x("n") - x("pos"), y("n") - y("pos")) >= _need(x, y, least)


def _shared(texts: DataFrame) -> DataFrame:
    """The first shingles that two or more texts have: token, node, position, size and parity of the text."""
    each = texts.select("node", "n", F.posexplode("firsts").alias("pos", "token"))
    many = each.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token")
    met = each.join(many.hint("merge"), "token")
    return cut_lineage(met.join(texts.select("node", *BITS), "node").select("token", "node", "pos", "n", *BITS))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): texts whose fingerprints link by their Golay keys, and each text with the first of its fingerprint."""
    with passing() as kept:
        fps = cut_lineage(texts.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("copies")))
        near = links(fps.select("fp", "copies"))
        same = texts.select("fp", "node").join(fps, "fp").filter(F.col("node") != F.col("rep"))
        ends = [fps.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in ("a", "b")]
        met = near.join(ends[0], "a").join(ends[1], "b")
        return kept(met.select(*_ordered("rep_a", "rep_b")).union(same.select(*_ordered("node", "rep"))))


def _star_pairs(shared: DataFrame, least: float) -> DataFrame:
    """(a, b): each text with two texts of each of its shingles, those of smallest and largest hash."""
    whole = F.struct(F.xxhash64("node", "token").alias("rank"), "node", "pos", "n", *BITS)
    hubs = shared.groupBy("token").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    met = shared.join(hubs.hint("merge"), "token")
    pairs = [
        met.filter(F.col("node") != F.col(f"{h}.node"))
        .filter(_early(F.col, lambda c, h=h: F.col(f"{h}.{c}"), least))
        .filter(_parities_allow(F.col, lambda c, h=h: F.col(f"{h}.{c}"), least))
        .select(*_ordered("node", f"{h}.node"))
        for h in ("lo", "hi")
    ]
    return pairs[0].union(pairs[1]).distinct()


def _cross_pairs(shared: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b): all texts of different groups that share enough first shingles and may be similar.

    Of the first shingles of the text whose last one comes first in the order, all that the other text has are
    among that one's first ones too. So two similar texts share all but those that the similarity leaves to one
    alone: a share of the length, where unlike texts share one or two. Only the counts of pairs are shuffled.
    """
    grouped = cut_lineage(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    one = grouped.select(*[F.col(c).alias(f"x_{c}") for c in grouped.columns])
    two = grouped.select(*[F.col(c).alias(f"y_{c}") for c in grouped.columns])
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    need = _need(x, y, least)
    met = one.join(
        two.hint("merge"),
        (x("token") == y("token"))
        & (x("node") > y("node"))
        & (x("root") != y("root"))
        & (F.least(x("n"), y("n")) >= need)
        & _parities_allow(x, y, least),
    )
    # The number of first shingles is prefix_length(n, least).
    wanted = need + 1 - F.ceil(F.greatest(x("n"), y("n")) * least - 1e-9)
    pairs = met.select(
        x("node").alias("a"), y("node").alias("b"), wanted.cast("int").alias("wanted"), _early(x, y, least).alias("early")
    )
    counts = pairs.groupBy("a", "b", "wanted").agg(F.count("*").alias("met"), F.max("early").alias("early"))
    return counts.filter("met >= wanted AND early").select("a", "b")


def _in_mask(wanted: DataFrame) -> Callable[[Column], Column]:
    """A test of hashes that holds for all ``tkey`` of the table, and for few others if it's small."""
    slots = wanted.select(F.pmod("tkey", F.lit(MASK_SLOTS)).cast("int").alias("slot"))
    rows = (
        slots.select(F.shiftright("slot", 6).alias("at"), F.expr("shiftleft(1L, slot & 63)").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    mask = np.zeros(MASK_SLOTS // 64, np.int64)
    mask[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    sent = wanted.sparkSession.sparkContext.broadcast(np.unpackbits(mask.view(np.uint8), bitorder="little"))

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(sent.value[keys.to_numpy() % MASK_SLOTS] > 0)

    return test


def _sets(docs: DataFrame, texts: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(node, set): the sorted shingles of the texts of the pairs."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut_lineage(texts.select("node", "first", "tkey").join(nodes, "node"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    each = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.col("text").cast("binary").alias("text"))
    return cut_lineage(
        each.filter(_in_mask(wanted)(F.col("tkey")))
        .join(
            wanted.select(F.col("first").alias("id"), F.col("tkey").alias("key"), "node"),
            F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tkey") == F.col("key")),
        )
        .select("node", "text")
        .dropDuplicates(["node"])
        .mapInArrow(shingles, "node bigint, set binary")
    )


def _held(pairs: DataFrame, values: DataFrame, test: Callable[[np.ndarray, np.ndarray], bool], kind: type) -> DataFrame:
    """The (a, b) for which the test of the values of (node, value), arrays of ``kind``, holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3))
            good = [test(*(np.frombuffer(v.as_buffer(), kind) for v in both)) for both in sides]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return (
        pairs.join(values.toDF("a", "x"), "a")
        .join(values.toDF("b", "y"), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(run, "a bigint, b bigint")
    )


def _possible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The (a, b) whose signatures don't rule out this Jaccard similarity."""

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        n = int(x[0] + y[0])
        return bits_apart(x[1:], y[1:]) <= n - 2 * math.ceil(n * (least / (1 + least)) - 1e-9)

    return _held(pairs, texts.select("node", "signature"), test, np.int64)


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The (a, b) whose shingle sets have at least this Jaccard similarity, exactly."""

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (len(x) + len(y) - both)

    return _held(pairs, sets, test, np.uint64)


def _linked(docs: DataFrame, texts: DataFrame, pairs: DataFrame, size: int, least: float) -> DataFrame:
    """The (a, b) of the pairs whose texts are similar: by signatures first, then exactly."""
    with passing() as kept:
        near = cut_lineage(_possible(pairs, texts, least))
        return kept(_similar(near, _sets(docs, texts, near, size), least))


def similar_groups(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """(node, first, tkey, root) of the different texts of (doc_id, text).

    Texts link if their sets of ``size``-word shingles have a Jaccard similarity of ``least`` or more,
    compared exactly; the groups are those that a comparison of all pairs gives. SimHash fingerprints
    within four bits, found by their Golay keys as in :func:`links`, name the first pairs. They miss pairs
    near ``least``: two similar sets share one of their first shingles in any fixed order, here the rarest
    first. Stars over shared first shingles join dense groups with them; then every pair across the groups
    that shares a first shingle is compared, unless its positions, parity bits or signatures rule the
    similarity out.
    """
    texts = _texts(docs, size, least)
    with passing() as kept:
        shared = _shared(texts)
        slim = kept(texts.drop("firsts"))
        discard(texts)
        named = _fingerprint_pairs(slim).union(_star_pairs(shared, least)).distinct()
        linked = _linked(docs, slim, named, size, least)
        crossing = _cross_pairs(shared, components(linked, "a", "b"), least)
        found = linked.union(_linked(docs, slim, crossing, size, least))
        roots = kept(components(found, "a", "b"))
    return slim.join(roots, "node", "left").select(
        "node", "first", "tkey", F.coalesce("root", "node").alias("root")
    )


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of copies and near copies: the one with the smallest id.

    Null texts count as empty ones. Ids that are null come last.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node", "tkey")).alias("best")
    with passing() as kept:
        groups = similar_groups(df.select(F.col(doc_id).alias("doc_id"), whole.alias("text")))
        keepers = kept(groups.groupBy("root").agg(best).select("best.first", "best.tkey").distinct())
    own, other = fresh(df), fresh(df)
    keys = keepers.select(F.struct("first", F.coalesce("tkey", F.lit(0)).alias("tkey")).alias(other))
    # One column of one type as key, also with null ids: texts are shuffled once, for the copies and the join.
    # A semi join would be moved below the copies, where a row that comes very often is in one task.
    return (
        df.withColumn(own, F.struct(F.col(doc_id).alias("first"), F.xxhash64(whole).alias("tkey")))
        .dropDuplicates([own])
        .join(keys, F.col(own) == F.col(other))
        .drop(own, other)
    )


def op4_simhash_golay(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
