"""Personal data: fixed patterns as seeds, and contextual patterns bootstrapped from them.

Seeds are e-mail addresses, IP addresses, card and phone numbers found by fixed patterns. Every seed
and every other identifier-like token is a mention; neighbouring groups of digits are one. A mention has lexical
patterns with back-off: the two words before it, the word before it, that word with a ``:`` or ``=`` (a field), and
the words on both sides (digits count as 0). Patterns and the different tokens that fill them
form a graph. In each round a pattern's confidence for a kind is the summed score of its fillers over
their number, given enough support, and an unseen filler scores one minus the product of its
patterns' doubts. After the last round, mentions in the confident patterns of a kind whose form fits
the kind (an at sign; three dots and four digits; 12 digits; 7 digits) become spans of kind ``ctx_<kind>``; the most
confident kind wins, ties go to the name that comes last. They follow the base spans, by kind as listed and start.

The graph lives in tables: joins and aggregates score it, each round is written to the shared folder.

Edge cases: a null text is empty. A null ``doc_id`` is carried through; rows are told apart by a row
number of the written table. Texts are read whole, in time linear in their length. Repeated rows count
as one filler of a pattern. An empty table gives an empty table. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import table
from cairn.sources.scratch import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base spans (the part of an address before @ is found backwards).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Groups of digits parted by single spaces, or a token with a digit or an at sign; spaces end it.
MENTION = re.compile(
    r"""(?<!\S)[+(]?[0-9][0-9()./-]*(?:\x20[(]?[0-9][0-9()./-]*)+(?![^\s.,;:!?)\]}>"'|])|(?<!\S)[^\s0-9@]*[0-9@]\S*"""
)
WORD = re.compile(r"""[^\s.,;:!?()\[\]{}<>"'`*#$%&|=]+""")
EDGE = ".,;:!?()[]{}<>\"'`*#$%&|"

#: Characters of the shortest mention: nothing shorter has the form of a kind, but an address like a@b.
SHORTEST = 3
ROUNDS = 3
SUPPORT = 3
CONFIDENCE = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and not LOCAL_TAIL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            after = m.end()
        else:
            after = at + 1
        at = text.find("@", after)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = [("email", *x) for x in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


class Words:
    """Words of a text, for the patterns of a span."""

    def __init__(self, text: str):
        self.text, found = text, [m.span() for m in WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def word(self, k: int) -> str:
        return DIGIT.sub("0", self.text[self.starts[k] : self.ends[k]].lower())

    def patterns(self, start: int, end: int) -> list[str]:
        """From two words before to one; a word that the span is a part of is none."""
        at, after = bisect_right(self.ends, start), bisect_left(self.starts, end)
        if not at:
            return []
        left, found = self.word(at - 1), []
        if at > 1:
            found.append(f"{self.word(at - 2)} {left} _")
        if after < len(self.starts):
            found.append(f"{left} _ {self.word(after)}")
        k = start - 1
        while self.text[k].isspace() or self.text[k] in "\"'":
            k -= 1
        if self.text[k] in ":=":
            found.append(f"{left}{self.text[k]} _")
        return [*found, f"{left} _"]


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple]:
    """(kind or None, start, end, filler, patterns) of the base spans and of other identifiers."""
    if "@" not in text and not DIGIT.search(text):
        return []
    words = Words(text)
    found = [(k, a, b, text[a:b], words.patterns(a, b)) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    k = 0
    for m in MENTION.finditer(text):
        token = m[0].strip(EDGE)
        a = m.start() + m[0].find(token)
        b = a + len(token)
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if len(token) >= SHORTEST and not (k < len(taken) and taken[k][0] < b):
            found.append((None, a, b, token, words.patterns(a, b)))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def read_documents(df: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): base counts, digest, spans and mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mention = pa.list_(
            pa.struct(
                [
                    ("kind", pa.string()),
                    ("start", pa.int32()),
                    ("end", pa.int32()),
                    ("filler", pa.string()),
                    ("patterns", pa.list_(pa.string())),
                ]
            )
        )
        fields = ("kind", "start", "end", "filler", "patterns")
        for batch in batches:
            counts = {k: [] for k in KINDS}
            digests, spans, all_mentions = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base))
                all_mentions.append([dict(zip(fields, x)) for x in mentions(text, base)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(counts[k], pa.int64()) for k in KINDS),
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(all_mentions, mention),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "mentions"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return df.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, {counts}, base_sha256 string, base string, mentions array<struct<kind:string,"
        "start:int,end:int,filler:string,patterns:array<string>>>",
    )


def score_patterns(
    graph: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE
) -> DataFrame:
    """(pattern, kind, confidence) of the confident patterns of a (pattern, filler, kind) graph.

    ``kind`` is null for fillers that no fixed pattern has found.
    """
    size = graph.groupBy("pattern").agg(F.count("*").alias("fillers"))
    seeds = graph.filter("kind IS NOT NULL").select("filler", "kind", F.lit(1.0).alias("score")).distinct()
    scores = seeds
    for left in range(rounds, 0, -1):
        patterns = cut_lineage(
            graph.select("pattern", "filler")
            .join(scores, "filler")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("hits"))
            .filter(F.col("hits") >= support)
            .join(size, "pattern")
            .select("pattern", "kind", (F.col("hits") / F.col("fillers")).alias("confidence"))
            .filter(F.col("confidence") >= confidence)
        )
        if left > 1:
            doubt = F.log(1 - F.least("confidence", F.lit(0.99)))
            unseen = (
                graph.filter("kind IS NULL")
                .select("pattern", "filler")
                .join(patterns, "pattern")
                .groupBy("filler", "kind")
                .agg((1 - F.exp(F.sum(doubt))).alias("score"))
            )
            scores = seeds.union(unseen.select("filler", "kind", "score"))
    return patterns


def _fits(kind, filler):
    digits = F.length(F.regexp_replace(filler, "[^0-9]", ""))
    dots = F.length(F.regexp_replace(filler, "[^.]", ""))
    return (
        F.when(kind == "email", filler.contains("@"))
        .when(kind == "ip", (dots >= 3) & (digits >= 4))
        .when(kind == "card", digits >= 12)
        .otherwise(digits >= 7)
    )


def find_personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **scoring) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) of every row.

    ``scoring``: rounds, support and confidence of ``score_patterns``.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    read = cut_lineage(read_documents(docs).withColumn("row", F.monotonically_increasing_id()))
    each = read.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    met = each.select("row", "start", "end", "kind", "filler", F.explode("patterns").alias("pattern"))
    graph = cut_lineage(met.groupBy("pattern", "filler").agg(F.max("kind").alias("kind")))
    patterns = score_patterns(graph, **scoring)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("best.kind"))
    found = (
        met.filter("kind IS NULL")
        .drop("kind")
        .join(patterns, "pattern")
        .filter(_fits(F.col("kind"), F.col("filler")))
        .groupBy("row", "start", "end")
        .agg(F.max(F.struct("confidence", "kind")).alias("best"))
        .groupBy("row")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(order.alias("at"), F.concat(F.lit("ctx_"), "best.kind").alias("kind"), "start", "end"))
            ).alias("more")
        )
    )
    shown = F.transform("more", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return read.join(found, "row", "left").select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        "base_sha256",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), shown).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"),
    )


def op6_contextual_pii(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
