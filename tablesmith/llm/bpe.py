"""BPE encoding and decoding by content-defined chunk reuse.

A text is cut into chunks where a rolling hash of the last 32 bytes hits a mask.
The cuts follow the content, so a passage that several documents share falls into
the same chunks wherever it stands. A worker encodes a chunk once and keeps its
ids, decimal digits and decoded bytes; every later occurrence is a dictionary
look-up.

Joins are repaired: the piece left and the piece right of a cut are encoded as one
text; where that differs from the two encodings side by side, the two chunks are
encoded again as one, and its joins are looked at again, until all agree. Cuts are
placed before a single space between ASCII characters that are no white space,
where the vocabulary's pre-tokeniser always splits, so a repair is rare.

The chunk store of a worker is bounded in bytes (``CACHE_BYTES``) and emptied when
full; that costs work, never results. Nothing is shuffled. Sharing encoded chunks
between tasks would shuffle every chunk and every id, about twice the input.

Defined results: a null text counts as empty; an empty text has no ids; repeated
rows are encoded each; the vocabulary's special token in a text is its one id, as
the library does by default; a text without a safe cut is one chunk; all other
columns are ignored by ``encode`` unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.llm.common import small_batches

MASK_BITS = 7
CACHE_BYTES = 64 << 20
ROWS_PER_BATCH = 512

_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)],
                 dtype=np.uint32)


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes stand for themselves, the rest, in order,
    for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder of one byte-level BPE vocabulary file (tokenizers format) with its chunk store."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.core = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                      mergeable_ranks={b: i for i, b in plain.items()})
        of = plain | {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [of.get(i, b"") for i in range(max(of) + 1)]
        self.digits = [b"%d" % i for i in range(max(of) + 1)]
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache_bytes, self.held = cache_bytes, 0
        self.chunks: dict[bytes, tuple] = {}
        self.ends: dict[str, list[int]] = {}

    def plain(self, text: str) -> list[int]:
        """Ids of a text, special tokens included."""
        if self.special_re is None or not self.special_re.search(text):
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for part in self.special_re.split(text):
            out += [self.special[part]] if part in self.special else self.core.encode_ordinary(part)
        return out

    def entry(self, ids: list[int]) -> tuple:
        """ids, their decimal digits joined by commas, the decoded bytes."""
        return array("i", ids), b",".join([self.digits[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])

    def chunk(self, raw: bytes) -> tuple:
        """Entry of a chunk, encoded at its first occurrence."""
        got = self.chunks.get(raw)
        if got is None:
            got = self.chunks[raw] = self.entry(self.plain(raw.decode()))
            self.held += 300 + 7 * len(raw)
        return got

    def cuts(self, raw: bytes) -> list[int]:
        """Offsets of safe spaces at which the rolling hash of the 32 bytes before them ends in MASK_BITS zeros."""
        b = np.frombuffer(raw, dtype=np.uint8)
        if len(b) < 64:
            return []
        h = _GEAR[b]
        for s in (1, 2, 4, 8, 16):  # afterwards h[i] covers the 32 bytes that end at i
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
        at = np.flatnonzero((h[32:-2] >> np.uint32(32 - MASK_BITS) == 0) & (b[33:-1] == 32)) + 33
        at = at[(b[at - 1] > 32) & (b[at + 1] > 32) & (b[at - 1] < 128) & (b[at + 1] < 128)]
        return at.tolist()

    def _piece(self, text: str) -> list[int]:
        got = self.ends.get(text)
        if got is None:
            got = self.ends[text] = self.plain(text)
            self.held += 250
        return got

    def agrees(self, left: bytes, right: bytes) -> bool:
        """Whether the last piece of one chunk and the first piece of the next have the same ids apart and together."""
        a, b = _tail(left), _head(right)
        return self.plain(a + b) == self._piece(a) + self._piece(b)

    def encode(self, text: str) -> tuple[array, bytes, bytes]:
        """ids, their decimal digits joined by commas, the decoded bytes of a whole text."""
        if self.held > self.cache_bytes:
            self.chunks.clear()
            self.ends.clear()
            self.held = 0
        raw = text.encode("utf-8", errors="replace")
        edges = [0, *self.cuts(raw), len(raw)]
        spans = [raw[a:b] for a, b in zip(edges, edges[1:]) if b > a]
        i = 0
        while i + 1 < len(spans):
            if self.agrees(spans[i], spans[i + 1]):
                i += 1
            else:  # one chunk from now on, and the join before it is looked at again
                spans[i:i + 2] = [spans[i] + spans[i + 1]]
                i = max(0, i - 1)
        parts = [self.chunk(x) for x in spans]
        if len(parts) == 1:
            return parts[0]
        ids = array("i")
        for p in parts:
            ids.extend(p[0])
        return ids, b",".join([p[1] for p in parts]), b"".join([p[2] for p in parts])

    def decode(self, ids) -> str:
        return b"".join([self.bytes_of[int(i)] for i in ids]).decode("utf-8", errors="replace")


def _tail(chunk: bytes) -> str:
    """The last piece of a chunk: from its last safe cut on."""
    at = len(chunk)
    while (at := chunk.rfind(b" ", 0, at)) > 0:
        if _safe(chunk, at):
            return chunk[at:].decode()
    return chunk.decode()


def _head(chunk: bytes) -> str:
    """The first piece of a chunk: up to its first safe cut."""
    at = 0
    while (at := chunk.find(b" ", at + 1)) > 0:
        if _safe(chunk, at):
            return chunk[:at].decode()
    return chunk.decode()


def _safe(chunk: bytes, at: int) -> bool:
    return at + 1 < len(chunk) and 32 < chunk[at - 1] < 127 and 32 < chunk[at + 1] < 127


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary; its stores live as long as the worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _path(vocabulary: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(vocabulary)


def encode(docs: DataFrame, vocabulary: str, keep: list[str], with_ids: bool = True) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids and decoded text."""
    kept = docs.select(*[docs[f"`{c}`"].alias(f"_k{i}") for i, c in enumerate(keep)],
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_text"))
    fields = [*kept.schema.fields[:-1], T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(_path(vocabulary))
        for batch in batches:
            for at in range(0, len(batch), ROWS_PER_BATCH):
                part = batch.iloc[at:at + ROWS_PER_BATCH]
                n, a, b, all_ids = [], [], [], []
                for text in part["_text"]:
                    ids, digits, back = own.encode(text)
                    n.append(len(ids))
                    a.append(hashlib.sha256(digits).hexdigest())
                    b.append(hashlib.sha256(back.decode("utf-8", errors="replace").encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids, dtype=np.int32))
                out = part.drop(columns="_text").assign(n_tokens=n, ids_sha256=a, decoded_sha256=b)
                yield out.assign(token_ids=all_ids) if with_ids else out

    small_batches(docs.sparkSession)
    out = kept.mapInPandas(run, T.StructType(fields))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
                      *[f.name for f in fields[len(keep):]])


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``encode`` on the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, "byte_bpe_50k.json", ["doc_id"], with_ids=False)
