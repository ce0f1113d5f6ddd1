"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

A text is normalised as its model says and cut into symbols, one per character. All
adjacent pairs of symbols whose concatenation is a piece go on an agenda, a heap
ordered by the piece's score, highest first, then by place, leftmost first. The best
pair is merged, its two new neighbour pairs go on the agenda, and entries whose
symbols have since been merged away are skipped when they surface. Symbols left over
that are no piece become the byte pieces of their UTF-8 bytes.

No merge can join two neighbour characters that stand side by side in no piece. So a
text may be cut there and the agenda run part by part, with the same result: first by a
pattern made from the vocabulary (before word marks, signs and characters of no longer
piece), then, in long words not met before, at all such places. The short words of a slice
of a batch that were not met before share one agenda, an array with a row a word: in every
round each row merges its own best pair. A worker keeps the ids of
the words and parts it has seen in a store bounded in bytes (``STORE_BYTES``; when its younger half is
full, it becomes the older half).

In every Arrow batch the ids and the decoded texts are compared with those of the
sentencepiece library for the same whole texts; ``agrees`` says so per row. Nothing is
shuffled, and a task holds one batch of at most ``BATCH_CHARS`` characters or one text.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows
are encoded each; the marks of begin, end and unknown in a text are ordinary text; a
very long word takes time n log n; an empty table gives an empty result; all columns but
the text are ignored unless named in ``keep``, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.llm.common import small_batches

MARK = "▁"
STORE_BYTES = 640 << 20
SHORT = 24
ROWS = 8192
KEPT = 180  # bytes of a word besides its text and ids; as measured, 210 bytes a word of the documents in all
_NO_PIECE = np.iinfo(np.int32).max
BATCH_CHARS = 1 << 20


class _Words(dict):
    """Ids of words; a word that is not among them is asked for."""

    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, word: str) -> bytes | bytearray:
        return self.ask(word)


class PieceCodec:
    """Encoder and decoder of one merge-type model with its word store."""

    def __init__(self, path: str, store_bytes: int = STORE_BYTES):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.cost: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.out: list[bytes] = []  # what an id decodes to
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.out.append(bytes((int(piece[3:5], 16),)))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.out.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                self.ids[piece], self.cost[piece] = i, -sp.get_score(i)
                self.out.append(piece.replace(MARK, " ").encode())
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.tokens = self._token_pattern()
        self.digits = np.array([b"%d," % i for i in range(len(self.out))], "S8").view(np.uint64)
        self.is_byte = set(self.byte_ids)
        self.starts = {i for p, i in self.ids.items() if p.startswith(MARK)}
        self._number_symbols()
        self.words = _Words(self.ask)  # the younger half of the store: packed 32-bit ids
        self.older: dict[str, bytes] = {}
        self.store_bytes, self.held = store_bytes, 0
        self.open: dict[str, bytearray] = {}  # short words without ids yet

    def _token_pattern(self) -> re.Pattern | None:
        """Tokens that no piece crosses: word marks, signs and letters up to the next mark, to a sign that follows no
        letter in any piece, or to a character of no longer piece, which stands alone."""
        if any(x[0] != MARK and x[1] == MARK for x in self.inside):
            return None
        known = {c for x in self.inside for c in x} - {MARK}
        letters = {c for c in known if c.isalnum()}
        tied = {x[1] for x in self.inside if x[0] in letters} - letters  # signs that may follow a letter

        def one_of(chars, prefix=""):
            return f"[{prefix}{''.join(map(re.escape, sorted(chars)))}]" if chars else "(?!)"

        # a repeat shares no character with what follows it, so none is ever given back; most words fit the first choice
        letter, sign, tail = one_of(letters), one_of(known - letters), f"(?:{one_of(tied)}{one_of(known)}*+)?+"
        return re.compile(f"{MARK}?+{letter}++{tail}|{MARK}*+{sign}*+{letter}++{tail}|{MARK}++{sign}*+|{sign}++|{one_of(known | {MARK}, '^')}")

    def _number_symbols(self) -> None:
        """Pieces, then other characters by code point, then the end of a row; and all pairs that make a piece."""
        names = list(self.cost)
        number = {p: i for i, p in enumerate(names)}
        self.end = len(names) + sys.maxunicode + 1
        self.symbol_of = np.arange(len(names), self.end, dtype=np.int32)  # of a code point
        for c in number:
            if len(c) == 1:
                self.symbol_of[ord(c)] = number[c]
        for c in {c for p in names for c in p} - number.keys():
            number[c] = int(self.symbol_of[ord(c)])
        pairs = sorted((number[p[:k]] * (self.end + 1) + number[p[k:]], number[p]) for p in names
                       for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.pairs = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max])
        self.made = np.array([p for _, p in pairs] + [-1], dtype=np.int32)
        self.rank = np.append(np.unique(list(self.cost.values()), return_inverse=True)[1], _NO_PIECE).astype(np.int32)
        self.id_of = np.array([self.ids[p] for p in names], dtype=np.int32)

    def _made_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes; -1: none."""
        key = left * np.int64(self.end + 1) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.made[at], np.int32(-1))

    def agendas(self, words: Sequence[str]) -> list[bytes | None]:
        """Packed ids of short texts, a row each: in every round each row merges its best pair, the leftmost of equals.
        None for a text of which a symbol is left that is no piece."""
        n, width = len(words), max(map(len, words))
        size = np.fromiter(map(len, words), np.int64, n)
        code = np.array(words, f"U{width}").view(np.uint32).reshape(n, width)
        symbol = np.full((n, width + 2), self.end, np.int32)  # an end on both sides, which joins nothing
        np.copyto(symbol[:, 1:-1], self.symbol_of[code], where=np.arange(width) < size[:, None])
        done, row = symbol.copy(), np.arange(n)
        made = self._made_of(symbol[:, :-1], symbol[:, 1:])
        while True:
            best = self.rank[made].argmin(1)
            new = made[np.arange(len(row)), best]
            live = new >= 0
            if not live.all():
                done[row[~live], :symbol.shape[1]] = symbol[~live]
                done[row[~live], symbol.shape[1]:] = self.end
                row, best, new, symbol, made = row[live], best[live], new[live], symbol[live], made[live]
                if not len(row):
                    break
            at, column = np.arange(len(row)), np.arange(symbol.shape[1] - 1)
            symbol = np.where(column > best[:, None], symbol[:, 1:], symbol[:, :-1])
            symbol[at, best] = new
            made = np.where(column[:-1] >= best[:, None], made[:, 1:], made[:, :-1])
            made[at, best - 1] = self._made_of(symbol[at, best - 1], new)
            made[at, best] = self._made_of(new, symbol[at, best + 1])
        used = done != self.end
        flat, sizes = done[used], used.sum(1)
        ends = sizes.cumsum()
        whole = np.logical_and.reduceat(flat < len(self.id_of), ends - sizes).tolist()
        packed, at = self.id_of[np.minimum(flat, len(self.id_of) - 1)].tobytes(), (4 * ends).tolist()
        return [packed[a:b] if ok else None for a, b, ok in zip([0, *at], at, whole)]

    def ask(self, word: str) -> bytes | bytearray:
        """Ids of a word that the younger store lacks; those of a short new word come with ``settle``."""
        ids = self.stored(word)
        if ids is None:
            ids = self.open.setdefault(word, bytearray()) if len(word) <= SHORT else self.word(word)
        return ids

    def settle(self) -> None:
        """Fill in and store the ids of the words asked for, by one agenda for many of them."""
        opened, self.open = self.open, {}
        asked = sorted(opened, key=len)
        for i in range(0, len(asked), ROWS):
            words = asked[i:i + ROWS]
            for word, ids in zip(words, self.agendas(words), strict=True):
                if ids is None:
                    ids = self.word(word)
                else:
                    self.keep(word, ids)
                opened[word] += ids

    def agenda(self, text: str) -> list[int]:
        """Ids of a normalised text by merging its best pair until none is left. An entry of the agenda is
        (cost, place of the left symbol, length of the pair); a pair whose symbols have changed is longer by now."""
        get, n = self.cost.get, len(text)
        symbol = list(text)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        agenda = [(c, i, 2) for i in range(n - 1) if (c := get(text[i:i + 2])) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, a, size = pop(agenda)
            merged = symbol[a]
            if merged is None or (b := right[a]) == n or len(merged) + len(symbol[b]) != size:
                continue
            merged = symbol[a] = merged + symbol[b]
            symbol[b] = None
            after = right[a] = right[b]
            if after < n:
                left[after] = a
                both = merged + symbol[after]
                if (c := get(both)) is not None:
                    push(agenda, (c, a, len(both)))
            before = left[a]
            if before >= 0:
                both = symbol[before] + merged
                if (c := get(both)) is not None:
                    push(agenda, (c, before, len(both)))
        return self._ids([s for s in symbol if s is not None])

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is None:
                out += [self.byte_ids[b] for b in s.encode()]
            else:
                out.append(i)
        return out

    def cuts(self, word: str) -> list[str]:
        """The word cut between all neighbour characters that stand side by side in no piece."""
        at = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.inside]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)]

    def stored(self, word: str) -> bytes | None:
        """Packed ids of a word of the store."""
        got = self.words.get(word)
        if got is None and (got := self.older.get(word)) is not None:
            self.keep(word, got)
        return got

    def keep(self, word: str, ids: bytes) -> None:
        self.held += KEPT + 2 * len(word) + len(ids)
        if self.held > self.store_bytes // 2:
            self.older, self.words, self.held = self.words, _Words(self.ask), 0
        self.words[word] = ids

    def word(self, word: str) -> bytes:
        """Packed ids of a word that the younger store lacks; its parts come from the store or off the agenda."""
        ids = self.stored(word)
        if ids is None:
            parts = [word] if word.isascii() and word.isalpha() or word[1:].isalpha() and word[1:].isascii() else self.cuts(word)
            found = []
            for part in parts:
                got = self.stored(part) if len(parts) > 1 else None
                if got is None:
                    got = array("i", self.agenda(part)).tobytes()
                    self.keep(part, got)
                found.append(got)
            ids = b"".join(found)
            if len(parts) > 1:
                self.keep(word, ids)
        return ids

    def raw(self, ids) -> bytes:
        """Decoded UTF-8 of ids whose byte pieces form whole characters, the leading space of a text included."""
        out = self.out
        return b"".join([out[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return array("i", next(self.encode_all([text]))).tolist()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of whole texts."""
        found = []
        for text in texts:
            normal = self.library.normalize(text) if text else ""
            words = self.tokens.findall(normal) if self.tokens else [normal] if normal else []
            found.append([])
            for i in range(0, len(words), ROWS):  # the halves of the store may change in between
                found[-1] += map(self.words.__getitem__, words[i:i + ROWS])
        self.settle()
        return map(b"".join, found)

    def joined(self, ids: list[int], packed: bytes | None = None) -> tuple[bytes, bytes]:
        """Decimal ids joined by commas, and the decoded text in UTF-8, of what ``encode`` returns."""
        digits = self.digits[np.frombuffer(array("i", ids) if packed is None else packed, np.int32)]
        back = self.raw(ids)
        return digits.tobytes().translate(None, b"\0")[:-1], back[1:] if back.startswith(b" ") else back

    def decode(self, ids) -> str:
        """Text of any ids: runs of byte pieces are read as UTF-8, a byte that fits nowhere gives U+FFFD."""
        text, run = [], bytearray()
        for i in [*map(int, ids), None]:
            if i in self.is_byte:
                run += self.out[i]
                continue
            if run:
                text.append(_utf8(bytes(run)))
                run.clear()
            x = "" if i is None else self.out[i].decode()
            if x:
                text.append(x[1:] if not text and i in self.starts else x)
        return "".join(text)


def _utf8(raw: bytes) -> str:
    """UTF-8 read character by character; each byte that starts none is U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(vocabulary: str) -> PieceCodec:
    """The worker's codec of a vocabulary; its word store lives as long as the worker."""
    if vocabulary not in _CODECS:
        import public_tokenizers
        _CODECS[vocabulary] = PieceCodec(public_tokenizers.path(vocabulary))
    return _CODECS[vocabulary]


def _slices(texts: list[str]) -> Iterator[slice]:
    """Consecutive slices of at most BATCH_CHARS characters, at least one text each."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > BATCH_CHARS:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encode(docs: DataFrame, vocabulary: str, keep: list[str], with_ids: bool = True) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256, agrees (with the library, ids and decoded text)
    and, if asked for, token_ids."""
    kept = docs.select(*[docs[f"`{c}`"].alias(f"_k{i}") for i, c in enumerate(keep)],
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_text"))
    fields = [*kept.schema.fields[:-1], T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
              T.StructField("agrees", T.BooleanType())]
    if with_ids:
        fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(vocabulary)
        for batch in batches:
            texts = batch["_text"].tolist()
            for part in _slices(texts):
                n, a, b, same, all_ids = [], [], [], [], []
                known = own.library.encode(texts[part], out_type="numpy", num_threads=1)
                gc.disable()  # the store holds no cycles, and a pass of the collector walks all of it
                for packed, ids_known in zip(own.encode_all(texts[part]), known, strict=True):
                    ids = array("i", packed).tolist()
                    digits, back = own.joined(ids, packed)
                    n.append(len(ids))
                    a.append(hashlib.sha256(digits).hexdigest())
                    b.append(hashlib.sha256(back).hexdigest())
                    same.append(packed == ids_known.tobytes() and back == own.library.decode(ids, out_type=bytes))
                    if with_ids:
                        all_ids.append(np.array(ids, dtype=np.int32))
                gc.enable()
                out = batch.iloc[part].drop(columns="_text").assign(
                    n_tokens=n, ids_sha256=a, decoded_sha256=b, agrees=same)
                yield out.assign(token_ids=all_ids) if with_ids else out

    small_batches(docs.sparkSession)
    out = kept.mapInPandas(run, T.StructType(fields))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
                      *[f.name for f in fields[len(keep):]])


def op12_pieces(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``encode`` on the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, "piece_bpe_32k.model", ["doc_id"], with_ids=False)
