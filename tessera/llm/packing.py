"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs the documents of its own partition in one pass, so nothing is shuffled. Whole windows of a long document
become sequences of their own. A shorter rest goes to that open bin whose free room, as a vector of shares of the three
limits, has the largest dot product with the rest's demand. Where no open bin holds it, the fullest bin is topped up with
a cut of it. At the end of a partition what the open bins hold is dealt out again to full sequences and at last to
lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import small_batches

END_ID = 1
#: Words whose ids a worker keeps, twice: those since the last change and those before. Bounds the memory of a Python worker.
MEMO_WORDS = 800_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048


class WordIds:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers, word by word through a bounded memo.

    The vocabulary's pre-tokenizer never joins across ASCII white space, so a text's ids are its words' ids in order. Words
    of letters only are encoded many at a time: the last token of each one carries the word-end suffix and parts them again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _one_by_one(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.memo[w] = np.array(e.ids, "<u4").tobytes()

    def _letters(self, words: list[bytes]) -> None:
        """Words that are one pre-token each."""
        parts = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(stops) != len(part):  # lower-casing has split a word
                self._one_by_one(part)
                continue
            raw, at = ids.tobytes(), 0
            for w, to in zip(part, stops.tolist(), strict=True):
                self.memo[w] = raw[at:to]
                at = to

    def _learn(self, words: set[bytes]) -> None:
        memo, old, letters, others, marked = self.memo, self.old, set(), set(), []
        for w in words:
            if (ids := old.get(w)) is not None:
                memo[w] = ids
                continue
            # marks after a letter are a token of their own
            stem = w.rstrip(b".,;:!?")
            if stem.isalpha() or (not stem.isascii() and stem.decode().isalpha()):
                low, mark = stem.lower(), w[len(stem) :]
                if low not in memo:
                    if (ids := old.get(low)) is not None:
                        memo[low] = ids
                    else:
                        letters.add(low)
                if mark and mark not in memo:
                    others.add(mark)
                if low != w:
                    marked.append((w, low, mark))
            else:
                others.add(w)
        self._letters(list(letters))
        self._one_by_one(list(others))
        for w, low, mark in marked:
            memo[w] = memo[low] + memo[mark] if mark else memo[low]

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO_WORDS:
            self.old, self.memo = self.memo, {}
        split = [t.encode("utf-8", "replace").split() for t in texts]
        new = set().union(*split).difference(self.memo)
        if new:
            self._learn(new)
        get, end = self.memo.__getitem__, END_ID.to_bytes(4, "little")
        return [b"".join(map(get, ws)) + end for ws in split]


@dataclass
class Piece:
    doc: int | str | None
    start: int
    ids: bytes
    doc_tokens: int
    prompt: int = 0

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        """Every id bears loss but those of the prompt and the closing one."""
        return max(0, min(self.start + self.length, self.doc_tokens - 1) - max(self.start, self.prompt))

    def prefix(self, tokens: int, loss: int) -> int:
        """The longest prefix within both limits."""
        free = max(0, self.prompt - self.start)
        n = min(tokens, free + loss, self.length)
        # the closing id is free as well
        return n + (n < tokens and n + 1 == self.length and self.start + self.length == self.doc_tokens)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens, self.prompt), Piece(self.doc, self.start + n, self.ids[4 * n :], self.doc_tokens, self.prompt)


class Packer:
    """Packs pieces one by one; rows() hands over what sequences are complete."""

    def __init__(self, limits: Limits, first_sequence: int, open_bins: int = 32):
        self.limits, self.next, self.open_bins = limits, first_sequence, open_bins
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.bins: list[list[Piece]] = []
        self.room = np.zeros((0, 3))
        self.out: list[tuple] = []

    def _emit(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.out.append((p.doc, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, self.next, at, p.loss))
            at += p.length
        self.next += 1

    def _close(self, k: int) -> None:
        self._emit(self.bins.pop(k))
        self.room = np.delete(self.room, k, axis=0)

    def add(self, piece: Piece) -> None:
        limits = self.limits
        while piece.length >= limits.tokens or piece.loss > limits.loss_tokens:
            whole, piece = piece.cut(piece.prefix(limits.tokens, limits.loss_tokens))
            self._emit([whole])
        while piece.length:
            need = np.array([piece.length, 1, piece.loss], float)
            # the last segment of a bin goes to a piece that fills it
            fits = (self.room >= need).all(axis=1) & ((self.room[:, 1] > 1) | (self.room[:, 0] == need[0]))
            if fits.any():
                k = int(np.argmax(np.where(fits, (self.room / self.capacity) @ (need / self.capacity), -1)))
                self._place(k, piece, need)
                return
            if len(self.bins) < self.open_bins:
                self.bins.append([])
                self.room = np.vstack([self.room, self.capacity])
                self._place(len(self.bins) - 1, piece, need)
                return
            k = int(np.argmin(self.room[:, 0]))
            head, piece = piece.cut(piece.prefix(int(self.room[k, 0]), int(self.room[k, 2])))
            if head.length:
                self.bins[k].append(head)
            self._close(k)

    def _place(self, k: int, piece: Piece, need: np.ndarray) -> None:
        self.bins[k].append(piece)
        self.room[k] -= need
        if self.room[k, 0] == 0 or self.room[k, 1] == 0:
            self._close(k)

    def rows(self, key: str = "Int64") -> pd.DataFrame:
        out, self.out = self.out, []
        return pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": key})

    def finish(self) -> None:
        rest = [p for b in self.bins for p in b][::-1]
        self.bins, self.room = [], np.zeros((0, 3))
        while rest:
            want, loss = 0, self.limits.loss_tokens
            for p in rest[: -self.limits.segments - 1 : -1]:
                n = p.prefix(self.limits.tokens - want, loss)
                want, loss = want + n, loss - p.cut(n)[0].loss
                if n < p.length:
                    break
            want = want if want == self.limits.tokens else 1 << (want.bit_length() - 1)
            chosen = []
            while want:
                p = rest.pop()
                if p.length > want:
                    p, tail = p.cut(want)
                    rest.append(tail)
                chosen.append(p)
                want -= p.length
            self._emit(chosen)


_ids: dict[str, WordIds] = {}


def pack(df: DataFrame, tokenizer: str, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", prompt: str | None = None) -> DataFrame:
    """One row per piece: key, start and length in its document's ids, their crc32, the document's ids, sequence, offset and loss-bearing ids.

    prompt: a column of text that comes before text and bears no loss, as in instruction data; the limit on loss-bearing
    ids then closes sequences that the limit on tokens would leave open. tokenizer: path of the vocabulary file on every
    machine. Null and empty texts have the closing id only; repeated rows are packed each; a null key stays null; an empty
    table gives no row. Keys that are not whole numbers are given as strings. Only key, text and prompt are read.
    """
    small_batches(df.sparkSession)
    whole = isinstance(df.schema[key].dataType, IntegralType)
    kind = "Int64" if whole else "object"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _ids.setdefault(tokenizer, None) or _ids.update({tokenizer: WordIds(tokenizer)}) or _ids[tokenizer]
        packer = Packer(limits, TaskContext.get().partitionId() << 36)
        encode = lambda column: ids.texts(["" if t is None else t for t in column])
        for b in batches:
            before = [x[:-4] for x in encode(b["p"])] if prompt else [b""] * len(b)
            for doc, first, raw in zip(b["k"], before, encode(b["t"]), strict=True):
                packer.add(Piece(None if pd.isna(doc) else int(doc) if whole else doc, 0, first + raw, (len(first) + len(raw)) // 4, len(first) // 4))
            yield packer.rows(kind)
        packer.finish()
        yield packer.rows(kind)

    columns = [F.col(key).cast("long" if whole else "string").alias("k"), F.col(text).alias("t"), *([F.col(prompt).alias("p")] if prompt else [])]
    return df.select(*columns).mapInPandas(run, PIECES if whole else PIECES.replace("doc_id long", "doc_id string"))
