"""Secret scan: fixed patterns, and a guess-cost measure for values in a credential context.

The guess cost of a value is the cheapest way to cut it into parts that an attacker would try: words
of a ranked list (also with capitals and look-alike characters), dates, repeats, keyboard walks and
sequences, and brute-force spans. The list is a fixed one of common password parts and after it the words of the
corpus itself by frequency, counted over all texts. A dynamic programme over the end positions adds the bits of each
part and a constant per part; all starts of walks and repeats count, of which only those that can still lead are
kept, so the time grows with the length of the value. A value after a credential word is a secret if it costs
``least_bits`` or more.

Spans are code points, end exclusive: assign, access and hex by fixed patterns, guess by the measure.
Guess spans cover the value alone and never overlap a fixed one.

Edge cases: null is an empty text. Long texts are read whole. Repeated rows give repeated results. A
null ``doc_id`` is carried through. An empty table gives an empty table. Columns of any name stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fresh, table
from cairn.sources.scratch import cut_lineage

# The patterns of the base spans.
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")

#: A name, a separator or "is"; a credential word as a part of the name; a value without spaces.
NAMED = re.compile(r"""(?a:(?<![\w-])((?:\w|-(?!>))++)["']?\x20*(?:->|=>|[:=]|\b(?i:is)\b)\x20*["'`]?)""")
CREDENTIAL = re.compile(
    r"""(?a:(?:(?i:pass(?:word|wd|phrase|code)|secret|token|credentials?"""
    r"""|(?:api|access|private|secret|client)[_-]?(?:key|secret|token))"""
    r"""|(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:pass|pwd|login|auth(?:orization)?))"""
    r"""(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z])))"""
)
VALUE = re.compile(r"""[^\s"'`<>,;]{6,}""")
HINTS = ("pass", "pwd", "secret", "token", "credential", "login", "auth", "key")

# Common parts of passwords, most common first.
COMMON = (
    "password", "love", "admin", "welcome", "login", "master", "dragon", "monkey", "letmein", "qwerty",
    "sunshine", "princess", "football", "baseball", "shadow", "michael", "jordan", "superman", "hello",
    "freedom", "whatever", "trust", "secret", "summer", "winter", "spring", "autumn", "test", "guest",
    "user", "root", "changeme", "default", "access", "pass", "word", "star", "wars", "batman", "hunter",
    "killer", "soccer", "hockey", "tigger", "charlie", "ginger", "pepper", "cookie", "cheese", "computer",
    "internet", "server", "system", "service", "public", "private", "demo", "temp", "sample", "example",
    "token", "key", "api", "prod", "dev", "none", "null", "true", "false", "your", "here", "insert",
    "required", "optional", "string", "value", "the", "and", "you", "this", "that", "with", "from", "for",
    "not", "is", "my", "correct", "horse", "battery", "staple",
)
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LOOKALIKE = str.maketrans("@4301!5$7", "aaeoliss" + "t")
DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d"
    r"|(?:19|20)\d\d"
)
PART_BITS = 1.0
LEAST_BITS = 28.0
#: Bounds of the words learned from the corpus: their number, and the letters of one.
LEARNED = 100_000
LETTERS = (3, 24)
#: Different words in a task's dictionary before they are passed on.
HELD = 300_000
FIELD = re.compile(rb"[:=]\s+\S+")


def _neighbours() -> dict[str, set[str]]:
    at = {k: (r, c) for r, row in enumerate(KEY_ROWS) for c, k in enumerate(row)}
    return {
        a: {b for b, (y, x) in at.items() if b != a and abs(y - r) <= 1 and -1 <= x - c + (y - r) <= 1 and abs(x - c) <= 1}
        for a, (r, c) in at.items()
    }


NEXT_TO = _neighbours()


def character_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c.isascii() and c.isalpha():
        return math.log2(26)
    return math.log2(33) if c.isascii() else 10.0


def word_bits(part: str, ranks: dict[str, int]) -> float | None:
    """Bits of a listed word: its rank, which letters are capital, which are look-alikes."""
    plain = part.lower()
    swapped = 0
    if plain not in ranks:
        plain, before = plain.translate(LOOKALIKE), plain
        if plain not in ranks:
            return None
        swapped = sum(a != b for a, b in zip(plain, before))
    capitals = sum(c.isupper() for c in part)
    styled = 0.0 if not capitals else 1.0 if part[0].isupper() and capitals == 1 or part.isupper() else float(len(part))
    return math.log2(ranks[plain] + 1) + styled + 1.5 * swapped


class Starts:
    """Cheapest start of a span whose cost is the start's plus ``weight`` times the logarithm of its length.

    The difference of two starts only falls as the end moves on, so a start that an earlier one has overtaken
    never leads again. The latest start kept leads until the one before it overtakes.
    """

    def __init__(self, weight: float):
        self.weight, self.kept = weight, []

    def cost(self, start: tuple[float, int], end: int) -> float:
        return start[0] + self.weight * math.log2(end - start[1])

    def overtaken(self, early: tuple[float, int], late: tuple[float, int]) -> float:
        """The end from which ``early``, which has the smaller cost, leads."""
        ratio = 2 ** min((late[0] - early[0]) / self.weight, 60.0)
        return (ratio * late[1] - early[1]) / (ratio - 1) if ratio > 1 else math.inf

    def add(self, cost: float, at: int, end: int) -> None:
        new, kept = (cost, at), self.kept
        while kept and kept[-1][0] >= cost:
            kept.pop()
        if kept and self.cost(kept[-1], end) <= self.cost(new, end):
            return
        while len(kept) > 1 and self.overtaken(kept[-2], kept[-1]) <= self.overtaken(kept[-1], new):
            kept.pop()
        kept.append(new)

    def least(self, end: int) -> float:
        kept = self.kept
        while len(kept) > 1 and self.cost(kept[-2], end) <= self.cost(kept[-1], end):
            kept.pop()
        return self.cost(kept[-1], end) if kept else math.inf


def guess_bits(value: str, ranks: dict[str, int] | None = None) -> float:
    """Logarithm to base two of the guesses that the cheapest segmentation needs."""
    ranks = ranks if ranks is not None else {w: i + 1 for i, w in enumerate(COMMON)}
    longest = max(map(len, ranks), default=0)
    n, low = len(value), value.lower()
    dates = {}
    for i, c in enumerate(value):
        if c.isdigit() and (m := DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
    best = [0.0] + [math.inf] * n
    brute = math.inf  # cheapest cut whose last part is a brute-force span
    same = walk = step = 0  # lengths of the runs that end here, and the step of the sequence
    unit_runs = {2: 0, 3: 0, 4: 0}
    alike, walks = Starts(1.0), Starts(1.2)
    units = {u: [Starts(1.0) for _ in range(u)] for u in unit_runs}
    for e in range(1, n + 1):
        c = value[e - 1]
        before = value[e - 2] if e > 1 else ""
        same = same + 1 if c == before else 1
        delta = ord(c) - ord(before) if before else 0
        near = bool(before) and (low[e - 1] in NEXT_TO.get(low[e - 2], ()) or delta == step and delta in (1, -1))
        walk = walk + 1 if near else 1
        step = delta if delta in (1, -1) else 0
        brute = min(brute, best[e - 1] + PART_BITS) + character_bits(c)
        cost = brute
        if same == 1:
            alike = Starts(1.0)
        if same >= 3:
            alike.add(best[e - 3], e - 3, e)
            cost = min(cost, alike.least(e) + character_bits(c) + PART_BITS)
        if walk == 1:
            walks = Starts(1.2)
        if walk >= 3:
            walks.add(best[e - 3] - 0.4 * (e - 3), e - 3, e)
            cost = min(cost, walks.least(e) + 0.4 * e + math.log2(47) + PART_BITS)
        for unit in unit_runs:
            again = e > unit and value[e - 1 - unit] == c
            if not again:
                units[unit] = [Starts(1.0) for _ in range(unit)]
            unit_runs[unit] = unit_runs[unit] + 1 if again else 0
            if unit_runs[unit] >= unit:
                line = units[unit][e % unit]
                line.add(best[e - 2 * unit], e - 2 * unit, e)
                one = sum(map(character_bits, value[e - unit : e]))
                cost = min(cost, line.least(e) - math.log2(unit) + one + PART_BITS)
        for size in range(2, min(longest, e) + 1):
            bits = word_bits(value[e - size : e], ranks)
            if bits is not None:
                cost = min(cost, best[e - size] + bits + PART_BITS)
        for s in dates.get(e, ()):
            span = math.log2(200) if e - s == 4 else math.log2(200 * 366) + (2 if e - s > 8 else 0)
            cost = min(cost, best[s] + span + PART_BITS)
        best[e] = cost
    return best[n]


def scan(text: str | None, ranks: dict[str, int], least_bits: float = LEAST_BITS) -> list[tuple]:
    """(kind, start, end, value start, bits) by start, then kind; bits only for credential values."""
    text = text or ""
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    found = []
    if hinted:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                found.append(("assign", *m.span(), m.start(2), guess_bits(m[2], ranks)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                found.append(("access", *m.span(), m.start(), None))
    for m in HEX.finditer(text):
        found.append(("hex", *m.span(), m.start(), None))
    if hinted:
        fixed = [x[1:3] for x in found]
        at = 0
        while m := NAMED.search(text, at):
            at = m.end(1)
            if not CREDENTIAL.search(m[1]) or not (v := VALUE.match(text, m.end())):
                continue
            at = v.end()
            value = v[0].rstrip(".:!?)]}")
            a, b = v.start(), v.start() + len(value)
            if len(value) < 6 or any(a < y and x < b for x, y in fixed):
                continue
            if (bits := guess_bits(value, ranks)) >= least_bits:
                found.append(("guess", a, b, a, bits))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in spans)


def _ranks(words: Sequence[str]) -> dict[str, int]:
    ranks: dict[str, int] = {}
    for w in words:
        ranks.setdefault(w.lower(), len(ranks) + 1)
    return ranks


def _word_table() -> bytes:
    """Byte table of :func:`learn_words`: lower case; marks of sentences become spaces, other bytes stay."""
    one = lambda b: b + 32 if 0x41 <= b <= 0x5A else 32 if b in b".,;:!?()[]{}\"'" or b < 32 else b
    return bytes(map(one, range(256)))


WORDS = _word_table()


def learn_words(df: DataFrame, text: str = "text", most: int = LEARNED) -> list[str]:
    """Words of the whole corpus, most frequent first: those with a share of one in ``most`` of all words or more.

    So there are at most ``most``. Words are runs of ASCII letters between spaces and marks of sentences, without
    the first ones after ``:`` and ``=``, where values stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if w.isalpha() and w.isascii() and LETTERS[0] <= len(w) <= LETTERS[1]]
            words = pa.array([w for w, _ in kept], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                counts.update(FIELD.sub(b" ", t.as_py()).translate(WORDS).split())
            if len(counts) > HELD:
                yield out()
                counts.clear()
        yield out()

    read = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = cut_lineage(read.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") * most >= total).collect()
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


def word_ranks(df: DataFrame, text: str, words: Sequence[str] | None):
    """Broadcast ranks of ``words``, or of the common parts of passwords and then the words of the corpus."""
    words = (*COMMON, *learn_words(df, text)) if words is None else words
    return df.sparkSession.sparkContext.broadcast(_ranks(words))


def find_secrets(
    df: DataFrame, text: str = "text", spans: str = "secrets", words: Sequence[str] | None = None, least_bits: float = LEAST_BITS
) -> DataFrame:
    """``df`` with ``spans``: kind, start, end, start of the value and its guess bits."""
    sent, name = word_ranks(df, text, words), fresh(df)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,value:int,bits:double>>")
    def run(texts):
        ranks = sent.value
        return texts.map(
            lambda t: [dict(zip(("kind", "start", "end", "value", "bits"), x)) for x in scan(t, ranks, least_bits)]
        )

    return df.withColumn(name, run(F.col(text))).withColumn(spans, F.col(name)).drop(name)


def redact_text(text: str, spans: list[tuple], mark: str) -> str:
    """The text with the value of every span replaced; overlapping values become one mark."""
    pieces, at = [], 0
    for _, _, end, value, _ in sorted(spans, key=lambda x: (x[3], x[2])):
        if end <= at:
            continue
        if value >= at:
            pieces += [text[at:value], mark]
        at = end
    return "".join([*pieces, text[at:]])


def redact(
    df: DataFrame, text: str = "text", mark: str = "[SECRET]", words: Sequence[str] | None = None, least_bits: float = LEAST_BITS
) -> DataFrame:
    """``df`` with the secret values in ``text`` replaced by ``mark``; null stays null."""
    sent = word_ranks(df, text, words)

    @F.pandas_udf("string")
    def run(texts):
        ranks = sent.value
        return texts.map(
            lambda t: t if t is None or not (x := scan(t, ranks, least_bits)) else redact_text(t, x, mark)
        )

    return df.withColumn(text, run(F.col(text)))


def digest_report(df: DataFrame, words: Sequence[str] | None = None, least_bits: float = LEAST_BITS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess) of every row."""
    sent = word_ranks(df, "text", words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        for batch in batches:
            counts = {k: [] for k in KINDS}
            digests, spans = [], []
            for text in batch.column(1):
                found = scan(text.as_py(), ranks, least_bits)
                base = [x for x in found if x[0] != "guess"]
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in found))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
            n = {k: pa.array(v, pa.int64()) for k, v in counts.items()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n["assign"], n["access"], n["hex"], pa.array(digests, pa.string()), pa.array(spans, pa.string()), n["guess"]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
        "spans string, n_guess bigint",
    )


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest_report(table(spark, sf_dir, "documents"))
