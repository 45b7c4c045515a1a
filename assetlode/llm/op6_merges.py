"""Byte-level BPE by replaying the merges over all new words of a block at once.

Texts are cut into pieces by the tokenizer's split pattern, and the distinct
pieces not met before are laid end to end as one array of token ids, linked both
ways. An inverted index leads from the rank of a mergeable pair to the places
where it stands; ranks are taken in rising order, every place of a rank is merged
from left to right, and only the two neighbours of a merged place are looked up
again. A word in which a merge makes a pair of lower rank than the one in hand
(vocabularies allow it) puts off its remaining places until that pair is done,
so each word gets exactly the merges that it would get alone.

Memory: a block is one Arrow batch; the tables of words and pieces are bounded in
entries, forget what was not used of late and never keep one of more than LONG
characters, so a text without spaces doesn't fill them.

Defined results: a null or empty text has no ids; repeated rows are encoded row
by row; a null id stays null; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assetlode.llm.batches import columns, documents, map_batches, texts_of
from assetlode.llm.units import PATTERN, TwoAges, cut, open_ended, words_of

UNITS, WORDS, LONG = 600_000, 800_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._ranks = ranks
        self._bytes = [ranks[bytes([b])] for b in range(256)]
        #: The same for two bytes.
        self._first = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        #: Rank of the token that two neighbours make, by left << 32 | right; -1 for none.
        self._pairs = TwoAges(self._pair, 1_000_000)

    def _pair(self, key: int) -> int:
        return self._ranks.get(self.tokens[key >> 32] + self.tokens[key & 0xFFFFFFFF], -1)

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word."""
        ids, prev, nxt, owner, starts = [], [], [], [], []
        pairs, one, first = self._pairs, self._bytes, self._first
        places: dict[int, list[int]] = {}
        whole: dict[int, int] = {}
        for w, word in enumerate(words):
            at = len(ids)
            starts.append(at)
            if (rank := self._ranks.get(word)) is not None:
                whole[w] = rank  # no merge order can end elsewhere than at the word's own token
                continue
            ids += [one[b] for b in word]
            n = len(word)
            prev += range(at - 1, at + n - 1)
            nxt += range(at + 1, at + n + 1)
            owner += [w] * n
            if n:
                prev[at], nxt[-1] = -1, -1
            for i, (a, b) in enumerate(zip(word, word[1:]), at):
                if (r := first[a << 8 | b]) >= 0:
                    if r in places:
                        places[r].append(i)
                    else:
                        places[r] = [i]
        heap = sorted(places)
        while heap:
            rank = heappop(heap)
            found = places.pop(rank, None)
            if not found:
                continue
            found.sort()
            put_off, later = -1, []
            for i in found:
                w = owner[i]
                if w == put_off:
                    later.append(i)
                    continue
                j = nxt[i]
                if ids[i] < 0 or j < 0 or pairs[ids[i] << 32 | ids[j]] != rank:
                    continue  # a merge before this one took a part of the pair
                k = nxt[j]
                ids[i], ids[j], nxt[i] = rank, -1, k
                if (a := prev[i]) >= 0 and (r := pairs[ids[a] << 32 | rank]) >= 0:
                    if r in places:
                        places[r].append(a)
                    else:
                        places[r] = [a]
                        heappush(heap, r)
                    if r < rank:
                        put_off = w
                if k >= 0:
                    prev[k] = i
                    if (r := pairs[rank << 32 | ids[k]]) >= 0:
                        if r in places:
                            places[r].append(i)
                        else:
                            places[r] = [i]
                            heappush(heap, r)
                        if r < rank:
                            put_off = w
            if later:
                if rank in places:
                    places[rank] += later
                else:
                    places[rank] = later
                    heappush(heap, rank)
        out, ends = [], [*starts, len(ids)][1:]
        for w, (at, end) in enumerate(zip(starts, ends, strict=True)):
            out.append((whole[w],) if w in whole else tuple([t for t in ids[at:end] if t >= 0]))
        return out


class Codec:
    """Encodes blocks of texts and decodes ids; keeps the ids of words between blocks."""

    _shared: dict[str, Codec] = {}

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self._merges = Merges(ranks)
        self.tokens = self._merges.tokens
        self.names = list(map(str, range(len(self.tokens))))
        self._words = TwoAges(lambda word: self._merges.replay([word.encode()])[0], WORDS, LONG)
        self._units = TwoAges(self._unit, UNITS, LONG)

    @classmethod
    def shared(cls, path: str) -> Codec:
        if path not in cls._shared:
            cls._shared[path] = cls(read_ranks(path))
        return cls._shared[path]

    def _unit(self, piece: str) -> tuple[int, ...] | None:
        return None if open_ended(piece) else tuple(chain.from_iterable(map(self._words.__getitem__, words_of(piece))))

    def _split(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self._words.__getitem__, PATTERN.findall(text))))

    def _learn(self, texts: Iterable[str]) -> None:
        """Replays the merges over the words that the table lacks, all at once."""
        units: set[str] = set()
        for text in texts:
            units.update(text.split(" "))
        cut_up = {u: words_of(u) for u in units if u not in self._units and u not in self._units.old and not open_ended(u)}
        words = [w for w in {w for ws in cut_up.values() for w in ws} if len(w) <= LONG and w not in self._words and w not in self._words.old]
        for word, ids in zip(words, self._merges.replay([w.encode() for w in words]), strict=True):
            self._words[word] = ids
        for unit, ws in cut_up.items():
            if len(unit) <= LONG:
                self._units.keep(unit, self._words[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable(map(self._words.__getitem__, ws))))

    def encode(self, texts: list[str]) -> list[list[int]]:
        self._learn(texts)
        return [self._encode(t) for t in texts]

    def _encode(self, text: str) -> list[int]:
        if not text:
            return []
        first, rest = cut(text)
        if rest and not open_ended(first):
            try:
                return [*self._split(first), *chain.from_iterable(map(self._units.__getitem__, rest))]
            except TypeError:  # a piece that doesn't stand alone
                pass
        return list(self._split(text))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encoded(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its ids as an array."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = columns(batch)
        return pa.RecordBatch.from_arrays([ids, pa.array(Codec.shared(ranks).encode(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(texts_of(docs, id_col, text_col), each, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, ranks: str) -> DataFrame:
    """doc_id and the text of its ids; bytes that are no UTF-8 become U+FFFD."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.shared(ranks)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(i or []).decode(errors="replace") for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(tokens.select("doc_id", "ids"), each, "doc_id long, text string")


def digest(docs: DataFrame, ranks: str) -> DataFrame:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = columns(batch)
        codec = Codec.shared(ranks)
        names = codec.names
        n, shas, back = [], [], []
        for tokens in codec.encode(texts):
            n.append(len(tokens))
            shas.append(hashlib.sha256(" ".join(map(names.__getitem__, tokens)).encode()).hexdigest())
            back.append(hashlib.sha256(codec.decode(tokens)).hexdigest())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(texts_of(docs), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
