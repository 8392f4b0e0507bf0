"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file gives the vocabulary; its merges follow from the ranks (the two parts into which the
lower ranks merge a token). Each byte stands for one printable character inside the library; byte
positions of the tokens give offsets in the text's own characters. Decoding maps characters back to
bytes and joins them before reading UTF-8, so characters split over tokens come back whole; ids that
end inside a character give U+FFFD in the text form and the exact bytes in the byte form.

Edge cases: null and empty texts have no tokens, empty bytes and an empty text. Special tokens don't
exist: their strings are ordinary text. Texts are encoded one by one and whole. Repeated rows give repeated results, an empty table gives an empty table, other
columns aren't touched. Unknown ids raise an error.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import fresh, table

#: Rank file of the default vocabulary, in the folder of public tokenizers.
RANKS = "byte_bpe_50k.tiktoken"
#: Different pieces that a task remembers at a time.
KNOWN_PIECES = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """The character of each byte: printable ones stand for themselves, the others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def merge_parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes a token of two bytes or more."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        _, i = min(
            (ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1)
        )
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def model_spec(ranks: dict[bytes, int]) -> dict:
    """Vocabulary and merges over byte characters; the size is that of the rank file."""
    chars = byte_characters()
    shown = lambda raw: "".join(chars[b] for b in raw)
    in_order = sorted((r, t) for t, r in ranks.items() if len(t) > 1)
    return {
        "vocab": {shown(t): r for t, r in ranks.items()},
        "merges": [tuple(map(shown, merge_parts(t, ranks))) for _, t in in_order],
    }


class Codec:
    """Encodes texts and decodes ids inside a task.

    Texts are cut by the pattern, pieces go through the byte table, and the library's model merges
    each different piece once; the memory of pieces starts anew when it is full.
    """

    def __init__(self, spec: dict, pattern: str):
        import regex
        from tokenizers import models

        self.model = models.BPE(**spec, ignore_merges=True)
        space = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(space)
        chars = byte_characters()
        self.table = dict(enumerate(chars))
        byte = {c: b for b, c in enumerate(chars)}
        self.pieces = [b""] * (max(spec["vocab"].values()) + 1)
        for shown, i in spec["vocab"].items():
            self.pieces[i] = bytes(byte[c] for c in shown)
        self.known: dict[str, list[int]] = {}

    def cut(self, text: str) -> list[str]:
        """The pieces in byte characters. Byte 255, which UTF-8 lacks, separates them on the way."""
        one = "\udcff".join(self.pattern.findall(text)).encode("utf-8", "surrogateescape")
        return one.decode("latin-1").translate(self.table).split(self.table[255])

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        for piece in self.cut(text):
            found = self.known.get(piece)
            if found is None:
                if len(self.known) >= KNOWN_PIECES:
                    self.known.clear()
                found = self.known[piece] = [t.id for t in self.model.tokenize(piece)]
            ids += found
        return ids

    def offsets(self, text: str | None, ids: list[int]) -> list[list[int]]:
        """First and end character of each token; a character split over tokens belongs to all."""
        raw = np.frombuffer((text or "").encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.pieces[i]) for i in ids], dtype=np.int64)
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        return np.column_stack([char[starts], char[ends - 1] + 1]).tolist() if len(ends) else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


def _mapped(df: DataFrame, path: str | None, run: Callable, schema: str) -> DataFrame:
    import public_tokenizers

    spec = model_spec(read_ranks(path or public_tokenizers.path(RANKS)))
    sent, pattern = df.sparkSession.sparkContext.broadcast(spec), public_tokenizers.PATTERN

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield run(codec, batch.slice(at, 1000))

    return df.mapInArrow(over, schema)


def _schema(df: DataFrame, more: str) -> str:
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema]
    return ", ".join([*own, more])


def _added(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
    )


def encode(df: DataFrame, text: str = "text", ids: str = "ids", offsets: str = "offsets", path: str | None = None) -> DataFrame:
    """``df`` with the token ids and each token's start and end character (end exclusive)."""
    at = df.columns.index(text)
    name_ids, name_offsets = fresh(df), fresh(df)

    def run(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        found = [codec.encode(t) for t in texts]
        places = [codec.offsets(t, x) for t, x in zip(texts, found)]
        return _added(
            batch,
            **{
                name_ids: pa.array(found, pa.list_(pa.int32())),
                name_offsets: pa.array(places, pa.list_(pa.list_(pa.int32()))),
            },
        )

    schema = _schema(df, f"{name_ids} array<int>, {name_offsets} array<array<int>>")
    done = _mapped(df, path, run, schema)
    return done.withColumns({ids: F.col(name_ids), offsets: F.col(name_offsets)}).drop(
        name_ids, name_offsets
    )


def decode(df: DataFrame, ids: str = "ids", raw: str = "bytes", text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with the exact bytes of the ids and their text, U+FFFD for bytes that aren't UTF-8."""
    at = df.columns.index(ids)
    name_raw, name_text = fresh(df), fresh(df)

    def run(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [codec.decode(x or []) for x in batch.column(at).to_pylist()]
        return _added(
            batch,
            **{
                name_raw: pa.array(found, pa.binary()),
                name_text: pa.array([x.decode("utf-8", "replace") for x in found], pa.string()),
            },
        )

    schema = _schema(df, f"{name_raw} binary, {name_text} string")
    done = _mapped(df, path, run, schema)
    return done.withColumns({raw: F.col(name_raw), text: F.col(name_text)}).drop(name_raw, name_text)


def digest_report(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode and digest in one pass."""

    def run(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        count, of_ids, of_bytes = [], [], []
        for text in batch.column(1):
            ids = codec.encode(text.as_py())
            count.append(len(ids))
            of_ids.append(hashlib.sha256(array("I", ids).tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    docs = df.select("doc_id", "text")
    schema = _schema(docs.select("doc_id"), "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return _mapped(docs, path, run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_report(table(spark, sf_dir, "documents"))
