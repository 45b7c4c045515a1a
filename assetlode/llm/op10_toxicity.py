"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the words of a text and the beginnings of its longer words. A bounded
sample of labelled rows (SAMPLE, by a hash of the id) gives the examples, and all
terms of the examples span the space; a term that no example has can meet nothing.
A text is the vector of its terms: log frequency, times inverse document frequency
over all documents, times the term's relevance. Relevance is the correlation of the
term with the label over the sample where it is significant, and REST for every
other term, so each term counts but a few random words in common don't drown those
that tell the label. (Without the factor, i.e. with plain TF-IDF, the nearest
examples find 0.6 of the toxic documents; README has the figures.)

Examples lie in an inverted index of two kinds of lists. Lists of rare terms are
short and walked whole. Lists of the HEAD most frequent terms are cut into blocks
of BLOCK examples, like ones side by side, and each block keeps the largest weight
of each of these terms. That gives a bound of every block for a query. The blocks
with the largest bounds are opened first; of the others only those whose bound
reaches the K-th best similarity so far. So the K nearest are exact. Nearness is
cosine; ties go to the example that comes first in the index.

The score is the share of label 1 in the votes, which count by similarity to the
power SHARPNESS, smoothed towards the sample's share of label 1. A logistic curve
makes the share a probability. It is fitted on all examples, each judged by an
index and by relevances of the half of the sample that it doesn't belong to.

Labels are learned only from rows that aren't held out: crc32 of the id as text,
modulo 3, is not 1. Labels, language, source and id are no inputs of a score.

Defined results: a text without a known term, an empty or a null one gets the
score of the smoothed share of the sample; repeated rows get equal scores; of rows
that share a labelled id the one with the least text is the example; repeated
labels of an id count once, by the larger label; a label that is null isn't used;
a term in all sampled rows, and every term where all labels are equal, has the
relevance REST, and a curve that can't be fitted leaves shares as they are; without
labels every score is PRIOR; an empty table gives no rows; other columns are not
read. Rows with a null id are scored and not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.llm.batches import columns, documents, map_batches, map_stream, texts_of
from assetlode.llm.units import TwoAges
from assetlode.workspace import Workspace, release

#: Bound of the labelled rows that the classifier is fitted on.
SAMPLE = 2_500
#: A term has a relevance of its own if so many sampled rows hold it and its chi-squared statistic reaches so much.
LEAST_ROWS, LEAST_CHI2, REST = 3, 8.0, 0.05
K, SHARPNESS, SMOOTHING, PRIOR, THRESHOLD = 16, 2.0, 0.1, 0.05, 0.7
#: Terms whose lists are cut into blocks, examples to a block, and blocks that a query opens first.
HEAD, BLOCK, FIRST = 1024, 64, 4
#: Terms from the beginning of a word: their lengths.
PREFIXES = (4,)
#: Pieces that a worker remembers, and the longest of them.
PIECES, PIECE_CHARS = 200_000, 48

_WORD = re.compile(r"\w+")


def terms(piece: str) -> list[str]:
    """Words in lower case, and the beginnings of longer words, marked by a final *, each as often as it occurs."""
    out = []
    for word in _WORD.findall(piece.lower()):
        out.append(word)
        out += [word[:n] + "*" for n in PREFIXES if len(word) > n]
    return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(labels: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id and toxic of at most size rows that may be learned from."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    once = rows.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size or SAMPLE)


def example_terms(docs: DataFrame, few: DataFrame) -> pa.Table:
    """doc_id, toxic, the terms and their frequencies of each sampled row, in order of the ids; few has a bounded number of rows."""
    rows = texts_of(docs).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [Counter(terms(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "counts"])

    return map_batches(rows, each, "doc_id long, toxic int, terms array<string>, counts array<int>").toArrow().sort_by("doc_id")


class Vectors:
    """Known terms of texts, by number, with their frequencies."""

    def __init__(self, vocabulary: list[str]) -> None:
        self._words = {t: i for i, t in enumerate(vocabulary) if t[-1] != "*"}
        self._begins = {t[:-1]: i for i, t in enumerate(vocabulary) if t[-1] == "*"}
        self._pieces = TwoAges(self._of, PIECES, PIECE_CHARS)

    def _of(self, piece: str) -> list[int]:
        """As terms() by number."""
        piece, out = piece.lower(), []
        if piece.isalpha():
            found = (piece,)
        elif (bare := piece[:-1]).isalpha() and piece[-1] in ".,;:!?":
            found = (bare,)
        else:
            found = _WORD.findall(piece)
        for word in found:
            if (i := self._words.get(word)) is not None:
                out.append(i)
            for n in PREFIXES:
                if len(word) > n and (i := self._begins.get(word[:n])) is not None:
                    out.append(i)
        return out

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in rising order, frequencies."""
        pieces = Counter(text.split())
        found = list(map(self._pieces.__getitem__, pieces))
        ids = np.fromiter(chain.from_iterable(found), np.int64)
        if not len(ids):
            return ids, ids
        often = np.repeat(np.fromiter(pieces.values(), np.int64, len(pieces)), np.fromiter(map(len, found), np.int64, len(found)))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        return ids[first], np.add.reduceat(often[order], first)


def counted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, held_out, the numbers of the known terms in rising order and their frequencies."""
    shared, made = docs.sparkSession.sparkContext.broadcast(vocabulary), []  # terms of SAMPLE texts

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Vectors(shared.value))
        rows = [made[0].count(t) for t in columns(batch)[1]]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])]), pa.int32())
        flat = [pa.array(np.concatenate([r[i] for r in rows]) if rows else np.zeros(0), pa.int32()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.ListArray.from_arrays(ends, f) for f in flat)], ["doc_id", "held_out", "terms", "counts"])

    return map_batches(texts_of(docs).withColumn("held_out", held_out()), each, "doc_id long, held_out boolean, terms array<int>, counts array<int>")


def document_frequencies(vectors: DataFrame, n_terms: int) -> tuple[int, np.ndarray]:
    """Documents, and documents with each known term, over all of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)[:n_terms]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]), pa.int32()), pa.array(np.concatenate([[rows], n[at]]), pa.int64())], ["term", "n"])

    sums = map_stream(vectors.select("terms"), each, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each known term at most
    term, n = sums.column("term").to_numpy(), sums.column("n").to_numpy()
    df = np.zeros(n_terms, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


class Examples(NamedTuple):
    """Labelled texts: of each the id, the label, and where its terms begin in the flat lists."""

    ids: np.ndarray
    label: np.ndarray
    start: np.ndarray
    term: np.ndarray
    count: np.ndarray

    def some(self, which: np.ndarray) -> Examples:
        sizes = np.diff(self.start)
        flat = np.repeat(which, sizes)
        return Examples(self.ids[which], self.label[which], np.concatenate([[0], np.cumsum(sizes[which])]), self.term[flat], self.count[flat])


def relevance(examples: Examples, n_terms: int) -> np.ndarray:
    """The correlation of each term's presence with the label where it is significant, else REST."""
    rows, toxic = len(examples.ids), float(examples.label.sum())
    n = np.bincount(examples.term, minlength=n_terms).astype(np.float64)
    a = np.bincount(examples.term, np.repeat(examples.label, np.diff(examples.start)).astype(np.float64), n_terms)
    under = n * (rows - n) * toxic * (rows - toxic)
    chi2 = np.divide(rows * (a * rows - n * toxic) ** 2, under, out=np.zeros(n_terms), where=under > 0)
    chi2[(n < LEAST_ROWS) | (chi2 < LEAST_CHI2)] = 0
    return np.maximum(REST, np.sqrt(chi2 / max(1, rows)))


class Evidence(NamedTuple):
    #: The least doc_id of the rows that make the example.
    example: int
    similarity: float
    n: int
    n_toxic: int


class Index:
    """Examples by term. weight_of holds each term's inverse document frequency times its relevance."""

    def __init__(self, weight_of: np.ndarray, examples: Examples) -> None:
        self.weight_of = weight_of
        merged: dict[tuple[bytes, bytes], list[int]] = {}
        for x in range(len(examples.ids)):
            lo, hi = examples.start[x], examples.start[x + 1]
            if lo < hi:
                order = np.argsort(examples.term[lo:hi])
                key = examples.term[lo:hi][order].tobytes(), examples.count[lo:hi][order].tobytes()
                held = merged.setdefault(key, [0, 0, int(examples.ids[x])])
                held[0] += 1
                held[1] += int(examples.label[x])
                held[2] = min(held[2], int(examples.ids[x]))
        vectors = []
        for (t, c), held in merged.items():
            ids = np.frombuffer(t, examples.term.dtype)
            w = self.weights(ids, np.frombuffer(c, examples.count.dtype))
            vectors.append((ids[np.argsort(-w, kind="stable")[:4]].tolist(), held[2], ids, w, held))
        merged.clear()
        vectors.sort(key=lambda v: v[:2])  # neighbours share their heaviest terms
        self.ids = [v[1] for v in vectors]
        self.n = np.array([v[4][0] for v in vectors], np.float64)
        self.n_toxic = np.array([v[4][1] for v in vectors], np.float64)
        self.size = len(vectors)
        self.prior = (float(examples.label.sum()) + PRIOR) / (len(examples.ids) + 1)
        self.curve = (1.0, 0.0)
        term = np.concatenate([v[2] for v in vectors]) if vectors else np.zeros(0, np.int64)
        example = np.repeat(np.arange(self.size), [len(v[2]) for v in vectors])
        weight = np.concatenate([v[3] for v in vectors]) if vectors else np.zeros(0)
        order = np.argsort(term, kind="stable")
        self.example, self.weight = example[order].astype(np.int32), weight[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(weight_of)))])
        self._deal()

    def _deal(self) -> None:
        """The frequent terms' weights as a table of examples, and their largest one in each block."""
        frequent = np.argsort(-np.diff(self.start), kind="stable")[:HEAD]
        self.head = np.full(len(self.weight_of), -1, np.int32)
        self.head[frequent] = np.arange(len(frequent))
        self.blocks = -(-self.size // BLOCK)
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK))
        for row, t in enumerate(frequent.tolist()):
            at = slice(self.start[t], self.start[t + 1])
            self.dense[row, self.example[at]] = self.weight[at]
        self.most = self.dense.reshape(len(frequent), self.blocks, BLOCK).max(axis=2) if self.size else np.zeros((len(frequent), 0))

    def __getstate__(self) -> dict:
        """Without the tables, which each worker makes from the lists."""
        return {k: v for k, v in self.__dict__.items() if k not in ("head", "dense", "most")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._deal()

    def weights(self, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        w = (1 + np.log(c)) * self.weight_of[t]
        return w / math.sqrt(float(w @ w))

    def similarities(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
        """Of each query and example; -1 in blocks that can't hold one of the k nearest."""
        n, width = len(queries), self.blocks * BLOCK
        q = np.zeros((n, self.dense.shape[0]))
        flat: list[np.ndarray] = [np.zeros(0, np.int64)]
        value: list[np.ndarray] = [np.zeros(0)]
        for x, (t, c) in enumerate(queries):
            if not len(t):
                continue
            w, at = self.weights(t, c), self.head[t]
            q[x, at[at >= 0]] = w[at >= 0]
            rare, v = t[at < 0], w[at < 0]
            lo, size = self.start[rare], self.start[rare + 1] - self.start[rare]
            where = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
            flat.append(self.example[where] + np.int64(x * width))
            value.append(self.weight[where] * np.repeat(v, size))
        lists = np.bincount(np.concatenate(flat), np.concatenate(value), n * width).reshape(n, width)
        bounds = (q @ self.most + lists.reshape(n, self.blocks, BLOCK).max(axis=2)) * (1 + 1e-9)
        out = np.full((n, width), -1.0)
        opened = np.zeros(bounds.shape, bool)
        np.put_along_axis(opened, np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        self._open(opened, q, lists, out)
        least = np.partition(out, width - k, axis=1)[:, width - k] if width > k else np.full(n, -1.0)
        self._open(~opened & (bounds >= least[:, None]), q, lists, out)
        return out[:, : self.size].round(12)

    def _open(self, which: np.ndarray, q: np.ndarray, lists: np.ndarray, out: np.ndarray) -> None:
        for b in np.flatnonzero(which.any(axis=0)).tolist():
            rows, at = np.flatnonzero(which[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
            out[rows, at] = lists[rows, at] + q[rows] @ self.dense[:, at]

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> list[list[tuple[float, int]]]:
        """For each query similarity and number of the k nearest examples that share a term, nearest first."""
        if not self.size:
            return [[] for _ in queries]
        found = []
        for s in self.similarities(queries, k):
            least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else 0.0
            hit = np.flatnonzero((s >= least) & (s > 0))
            hit = hit[np.lexsort((hit, -s[hit]))[:k]]
            found.append(list(zip(s[hit].tolist(), hit.tolist(), strict=True)))
        return found

    def share(self, found: list[tuple[float, int]]) -> float:
        """The smoothed share of label 1 in the votes."""
        votes, toxic = SMOOTHING, SMOOTHING * self.prior
        for similarity, x in found:
            v = similarity**SHARPNESS
            votes, toxic = votes + v * self.n[x], toxic + v * self.n_toxic[x]
        return toxic / votes

    def score(self, found: list[tuple[float, int]]) -> float:
        z = self.curve[0] * _logit(self.share(found)) + self.curve[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def evidence(self, found: list[tuple[float, int]]) -> list[Evidence]:
        return [Evidence(self.ids[x], s, int(self.n[x]), int(self.n_toxic[x])) for s, x in found]


def _logit(share: float) -> float:
    share = min(max(share, 1e-4), 1 - 1e-4)
    return math.log(share / (1 - share))


def curve(shares: list[float], labels: np.ndarray) -> tuple[float, float]:
    """Scale and offset of the logits of shares; (1, 0) where the labels are all equal or the fit would turn the order round."""
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    x = np.column_stack([[_logit(s) for s in shares], np.ones(len(y))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.1, x.T @ (y - p) - 0.1 * (beta - (1.0, 0.0)))
        beta = beta + np.clip(step, -1, 1)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def trained(examples: Examples, idf: np.ndarray) -> Index:
    """The index of all examples, with a curve that is fitted across two halves of them."""
    half = np.arange(len(examples.ids)) % 2 == 0
    shares, labels = [], []
    for own in (half, ~half):
        others, judged = examples.some(~own), examples.some(own)
        judge = Index(idf * relevance(others, len(idf)), others)
        known = np.isin(judged.term, others.term)
        queries = [(judged.term[lo:hi][known[lo:hi]], judged.count[lo:hi][known[lo:hi]]) for lo, hi in zip(judged.start, judged.start[1:])]
        for i in range(0, len(queries), 256):
            shares += [judge.share(f) for f in judge.nearest(queries[i : i + 256])]
        labels.append(judged.label)
        del judge, others, judged, queries
    index = Index(idf * relevance(examples, len(idf)), examples)
    index.curve = curve(shares, np.concatenate(labels))
    return index


def fit(ws: Workspace, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Index, list[str]]:
    """The vectors of all documents, as a table of the workspace, the index of the examples and the known terms."""
    found = example_terms(docs, ws.save(sample(labels), "sample")).combine_chunks()  # SAMPLE rows at most
    flat = found.column("terms").combine_chunks().flatten().dictionary_encode()
    vocabulary = flat.dictionary.to_pylist()
    sizes = found.column("terms").combine_chunks().value_lengths().to_numpy()
    count = found.column("counts").combine_chunks().flatten().to_numpy()
    examples = Examples(found.column("doc_id").to_numpy(), found.column("toxic").to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat.indices.to_numpy(), count)
    del found, flat
    vectors = ws.save(counted(docs, vocabulary), "vectors")
    total, df = document_frequencies(vectors, len(vocabulary))
    return vectors, trained(examples, np.log((1 + total) / (1 + df)) + 1), vocabulary


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the nearest examples by doc_id as evidence."""
    vectors, model, _ = fit(Workspace(docs.sparkSession, "toxicity"), docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vectors of SAMPLE texts

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        lists = [batch.column(c) for c in ("terms", "counts")]
        ends = lists[0].offsets.to_numpy()
        terms_, counts = (x.values.to_numpy() for x in lists)
        shift = lists[1].offsets.to_numpy()[0] - ends[0]
        nearest = index.nearest([(terms_[lo:hi], counts[lo + shift : hi + shift]) for lo, hi in zip(ends, ends[1:])]) if batch.num_rows else []
        s = np.array([index.score(found) for found in nearest], np.float64)
        evidence = [",".join(f"{e.example}:{e.similarity:.4f}:{e.n_toxic}/{e.n}" for e in index.evidence(found[:3])) for found in nearest]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(evidence, pa.string())], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return map_batches(vectors, each, "doc_id long, held_out boolean, score double, predicted int, evidence string")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns; the verdict is each row's own."""
    ws = Workspace(docs.sparkSession, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(fit(ws, docs, labels)[1:])  # vectors and terms of SAMPLE texts
    ws.drop()
    release(ws.spark)
    at, made = docs.columns.index("text"), []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, vocabulary = shared.value
        if not made:
            made.append(Vectors(vocabulary))
        nearest = index.nearest([made[0].count(t or "") for t in batch.column(at).to_pylist()]) if batch.num_rows else []
        return batch.filter(pa.array([index.score(found) < THRESHOLD for found in nearest], pa.bool_()))

    return map_batches(docs, each, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
