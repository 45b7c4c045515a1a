"""Quality rules and robust multivariate outliers.

Fixed rules reject a document by itself. What they leave is judged against the
documents of its language and source: statistics of the text are transformed to
a vector, the centre and covariance of each group are estimated by the minimum
covariance determinant, and a vector beyond the chi-squared quantile OUTLIER of
the squared Mahalanobis distance is rejected.

Every statistic is a share or a mean over the document's own characters, words or
lines, so its sampling variance is known from their number: 1 / 4m for the root of
a share of m units (a repeat counts in units of REPEAT_UNIT words, the fewest that
it makes), and the variance of word lengths over the words. What an estimate holds
beyond the mean sampling variance of its core is the group's own spread; a document
is judged by that spread plus its own sampling variance. So statistics that are
constant in a group's core need no floor, and a short text may stray further than a
long one.

Estimates start thrice: from medians and quartiles alone, and with the correlations
of scaled values' hyperbolic tangents and of their spatial signs. A concentration
step keeps the share CORE of a group's rows with the smallest distances and takes
the next centre and covariance from them. After TRIES steps the start with the least
determinant goes on, until no group's determinant falls by more than SETTLED. At
the end all rows within the quantile NEAR make the estimate.

One aggregation does a step: rows are summed up by group, start and fine logarithmic
bin of the distance on each worker, then over all of them, before a group's bins meet
in one task; a group of any size reaches it as BINS rows a start at most, and the core
is cut at a bin. Medians come from histograms of fixed bins. Rows also count for their
language and for the whole table: an estimate is drawn towards that of the language,
and that one towards that of all rows, by the weight of SHRINK rows, so a group of any
size has one and none is switched over.

Defined results: null text is empty and fails the base rules; null language or
source is a group of its own; repeated rows count as often as they occur; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.llm.batches import column_bytes, documents, map_batches, map_groups, map_stream
from assetlode.llm.components import hot_join
from assetlode.workspace import Workspace, release

MIN_WORDS, MAX_REPEATED = 50, 50
FEATURES = ("word_length", "symbols", "duplicate_lines", "repeated_words", "capitals", "punctuation")
P = len(FEATURES)
#: Words of the shortest repeat: two windows of three.
REPEAT_UNIT = 6
CORE, NEAR, OUTLIER = 0.75, 0.975, 0.9999
#: Steps with all starts, further steps at most, and the fall of the log determinant that ends them.
TRIES, MOST_STEPS, SETTLED = 2, 10, 0.01
#: Rows that the next wider estimate counts for.
SHRINK = 5 * P
#: Least variance along an axis, far below any spread; keeps matrices regular.
LEAST = 1e-6
#: Bins of the squared distance to a power of two, and the largest bin.
PER_OCTAVE, BINS = 8, 320
#: Bins to a unit of a transformed statistic, for the start.
FINE = 2048

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(set(range(256)) - set(_SYMBOLS))
_SPACE = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(set(range(256)) - set(range(65, 91)))
_MARKS = bytes(set(range(256)) - set(b"!\"'(),-./:;?@[\\]^_`{}~+="))
_BLANK_LINE = re.compile(rb"[ \t-\r]*")


def statistics(text: bytes) -> tuple[int, int, int, int, int, list[float], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the transformed vector and its sampling variances."""
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    chars = int(lengths.sum())
    varied = float(lengths.var() / lengths.mean() ** 2) if n else 0.0
    if not text.isascii():
        chars = len(text.decode()) - (len(text) - len(text.translate(None, _SPACE)))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    seen: set[bytes] = set()
    n_lines = n_dup = 0
    for line in text.split(b"\n"):
        if line and not _BLANK_LINE.fullmatch(line):
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    repeated = _repeated(words)
    size = max(1, chars)
    n, lines = max(1, n), max(1, n_lines)
    vector = [
        math.log1p(chars / n),
        math.sqrt(symbols / size),
        math.sqrt(n_dup / lines),
        math.sqrt(repeated / n),
        math.sqrt(len(text.translate(None, _CAPITALS)) / size),
        math.sqrt(len(text.translate(None, _MARKS)) / size),
    ]
    share = 1 / (4 * size)
    return len(words), chars, symbols, n_dup, repeated, vector, [varied / n, share, 1 / (4 * lines), REPEAT_UNIT / (4 * n), share, share]


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    base = len(index)
    if base > 2_000_000:  # three ids no longer fit one word
        _, pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
        key = pairs[:-1].astype(np.int64) * base + ids[2:]
    else:
        key = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= often
    covered[1:-1] |= often
    covered[2:] |= often
    return int(covered.sum())


def measured(docs: DataFrame) -> DataFrame:
    """Per document the counts, base_failed, the group keys from narrow to wide, the vector in x0, x1, ... and its sampling variances in v0, v1, ..."""
    table = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        _group().alias("g2"),
        F.concat(F.lit("1:"), _key("lang")).alias("g1"),
    )
    schema = "doc_id long, g2 string, g1 string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"{c} double" for c in _XS + _VS)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = column_bytes(batch)
        rows = [statistics(t) for t in texts]
        counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        failed = pa.array(map(base_fails, rows), pa.bool_())
        xs = [pa.array([r[j][i] for r in rows], pa.float64()) for j in (5, 6) for i in range(P)]
        return pa.RecordBatch.from_arrays([ids, batch.column(2), batch.column(3), *counts, failed, *xs], ["doc_id", "g2", "g1", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *_XS, *_VS])

    return map_batches(table, each, schema)


def base_fails(found: tuple) -> bool:
    return found[0] < MIN_WORDS or 100 * found[4] > MAX_REPEATED * found[0]


def _group() -> F.Column:
    return F.concat(F.lit("2:"), _key("lang"), F.lit("|"), _key("source"))


def _key(name: str) -> F.Column:
    """A text that differs for every value, null included."""
    c = F.col(name).cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.regexp_replace(c, r"\|", "||")))


def chi2_cdf(x: float, df: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, df // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < q else (lo, mid)
    return lo


#: Makes the covariance of a core of CORE right for a normal law.
CONSISTENCY = CORE / chi2_cdf(chi2_quantile(CORE, P), P + 2)
_XS, _VS = [f"x{i}" for i in range(P)], [f"v{i}" for i in range(P)]
_UPPER = np.triu_indices(P)
#: Of a group: rows, and for one or more starts the centres, own spreads (P x P, in row order) and log determinants, one after another.
_PARAMS = "g string, n_group long, centre array<double>, spread array<double>, determinant array<double>"
#: Sums of a bin: rows, vectors, products of their components, sampling variances.
_SUMS = [f"s{i}" for i in range(1 + P + len(_UPPER[0]) + P)]


def own_spread(cov: np.ndarray, sampling: np.ndarray) -> np.ndarray:
    """A covariance without the sampling variances, its axes LEAST long at least."""
    values, axes = np.linalg.eigh(cov - np.diag(sampling))
    return (axes * np.maximum(values, LEAST)) @ axes.T


def distances(x: np.ndarray, v: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Squared, row by row, under the own spread and the row's sampling variances."""
    off = x - centre
    return np.maximum(np.einsum("ni,ni->n", off, np.linalg.solve(spread + v[:, :, None] * np.eye(P), off[:, :, None])[:, :, 0]), 0)


def _params(g: str, n: int, found: list[tuple[np.ndarray, np.ndarray, float]]) -> pd.DataFrame:
    return pd.DataFrame({"g": [g], "n_group": [n], "centre": [np.concatenate([c for c, _, _ in found]).round(9).tolist()], "spread": [np.concatenate([s.ravel() for _, s, _ in found]).round(10).tolist()], "determinant": [[round(d, 6) for _, _, d in found]]})


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in names])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column without nulls as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _bins(d2: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(d2, 1e-30)) * PER_OCTAVE) + BINS // 2, 0, BINS).astype(np.int64)


def _middle(rows: DataFrame, total: int) -> DataFrame:
    """Medians of each group as centres, and as its spread the squared quartile distances and the mean sampling variances."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("j"), F.floor(F.col(x) * FINE).cast("long").alias("bin"), F.col(v).alias("v")) for i, (x, v) in enumerate(zip(_XS, _VS, strict=True))))).alias("v")
    counts = rows.select("g", values).groupBy("g", "v.j", "v.bin").agg(F.count("*").alias("n"), F.sum("v.v").alias("v"))

    def each(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        centre, scale, sampling, n = np.zeros(P), np.zeros(P), np.zeros(P), 0
        for j, part in found.groupby("j"):
            part = part.sort_values("bin")
            cum = part["n"].cumsum().to_numpy()
            n = int(cum[-1])
            q1, q2, q3 = (part["bin"].to_numpy()[np.searchsorted(cum, q * n)] / FINE for q in (0.25, 0.5, 0.75))
            centre[j], scale[j], sampling[j] = q2, ((q3 - q1) / 1.349) ** 2, part["v"].sum() / n
        return _params(key[0], n, [(centre, np.diag(np.maximum(scale, sampling)), 0.0), (centre, np.diag(sampling), 0.0)])

    return map_groups(counts, P * total, "g", each, _PARAMS)


def _with(rows: DataFrame, params: DataFrame, total: int) -> DataFrame:
    """Rows of the levels, total of them, with their group's parameters; the language and the whole table are hot keys."""
    return hot_join(rows, params.select("g", F.col("n_group").alias("n"), "centre", "spread"), "g", total, gather=True).select("g", *_XS, *_VS, "centre", "spread")


def _sums(rows: DataFrame, of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """By group, start and bin the sums of what `of` gives of a batch: starts, bins and values, each with a row for each start and row of the batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, bins, values = of(batch)
            groups = batch.column(0).dictionary_encode()
            key = (np.tile(groups.indices.to_numpy().astype(np.int64), len(values) // batch.num_rows) * 8 + starts) * (BINS + 1) + bins
            order = np.argsort(key, kind="stable")
            found, first = np.unique(key[order], return_index=True)
            totals = np.add.reduceat(values[order], first)
            names = groups.dictionary.to_pylist()
            for k, total in zip(found.tolist(), totals, strict=True):
                at = names[k // (BINS + 1) // 8], k // (BINS + 1) % 8, k % (BINS + 1)
                sums[at] = sums[at] + total if at in sums else total
            if len(sums) > 100_000:  # very many groups
                yield _sum_rows(sums)
                sums = {}
        if sums:
            yield _sum_rows(sums)

    parts = map_stream(rows, each, "g string, start long, bin long, " + ", ".join(f"{c} double" for c in _SUMS))
    return parts.groupBy("g", "start", "bin").agg(*(F.sum(c).alias(c) for c in _SUMS))


def _sum_rows(sums: dict[tuple[str, int, int], np.ndarray]) -> pa.RecordBatch:
    g, start, bins = zip(*sums, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(start, pa.int64()), pa.array(bins, pa.int64()), *map(pa.array, np.array(list(sums.values())).T)], ["g", "start", "bin", *_SUMS])


def _values(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, x[:, _UPPER[0]] * x[:, _UPPER[1]], v])


def _square(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    out[_UPPER] = upper
    return np.triu(out) + np.triu(out, 1).T


def _start(rows: DataFrame, middle: DataFrame, total: int) -> DataFrame:
    """The three starts of each group."""

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, v, n = _columns(batch, _XS), _columns(batch, _VS), batch.num_rows
        centre, scale = _matrix(batch.column("centre"), 2 * P)[:, :P], _matrix(batch.column("spread"), 2 * P * P)[:, : P * P : P + 1]
        z = (x - centre) / np.sqrt(np.maximum(scale, LEAST))
        signs = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        return np.repeat([1, 2], n), np.zeros(2 * n, np.int64), np.concatenate([_values(np.tanh(z), v), _values(signs, v)])

    sums = _sums(_with(rows, middle, total), of)

    def each(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        own = found[found["start"].isna()].iloc[0]
        centre, both = np.array(own["centre"][:P]), np.array(own["spread"]).reshape(2, P, P)
        scale, sampling = np.sqrt(np.diag(both[0])), np.diag(both[1])
        out = [(centre, own_spread(both[0], sampling), 0.0)]
        for _, row in found[found["start"].notna()].sort_values("start").iterrows():
            products = _square(row[_SUMS[1 + P : 1 + P + len(_UPPER[0])]].to_numpy(np.float64))
            size = np.sqrt(np.maximum(np.diag(products), 1e-12))
            out.append((centre, own_spread(products / np.outer(size, size) * np.outer(scale, scale), sampling), 0.0))
        return _params(key[0], int(own["n_group"]), out)

    return map_groups(sums.unionByName(middle.drop("determinant"), allowMissingColumns=True), total, "g", each, _PARAMS)


def _step(rows: DataFrame, params: DataFrame, total: int, starts: int, choose: bool = False, last: bool = False) -> DataFrame:
    """The next estimate of each start: of the core by share, or at the end of all rows within NEAR; choose leaves the start with the least determinant."""

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, v, n = _columns(batch, _XS), _columns(batch, _VS), batch.num_rows
        centre, spread = _matrix(batch.column("centre"), starts * P).reshape(n, starts, P), _matrix(batch.column("spread"), starts * P * P).reshape(n, starts, P, P)
        bins = [_bins(distances(x, v, centre[:, s], spread[:, s])) for s in range(starts)]
        return np.repeat(np.arange(starts), n), np.concatenate(bins), np.tile(_values(x, v), (starts, 1))

    sums = _sums(_with(rows, params, total), of)

    def each(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        out, n = [], 0
        for _, part in found.groupby("start"):
            part = part.sort_values("bin")
            values, bins = part[_SUMS].to_numpy(), part["bin"].to_numpy()
            n = int(round(values[:, 0].sum()))
            kept = bins <= _bins(np.array([chi2_quantile(NEAR, P)]))[0] if last else np.arange(len(bins)) <= np.searchsorted(np.cumsum(values[:, 0]), CORE * n)
            kept[0] = True
            total = values[kept].sum(axis=0)
            total = total / total[0]
            centre, sampling = total[1 : P + 1], total[-P:]
            cov = (_square(total[P + 1 : -P]) - np.outer(centre, centre)) * (1.0 if last else CONSISTENCY)
            spread = own_spread(cov, sampling)
            out.append((centre, spread, float(np.linalg.slogdet(spread + np.diag(sampling))[1])))
        return _params(key[0], n, [min(out, key=lambda e: e[2])] if choose else out)

    return map_groups(sums, total, "g", each, _PARAMS)


def estimates(ws: Workspace, rows: DataFrame) -> DataFrame:
    """Centre and own spread of each group, language and the whole."""
    levels = rows.select(F.explode(F.array("g2", "g1", F.lit("0"))).alias("g"), *_XS, *_VS)
    total = 3 * rows.count()
    params = ws.save(_start(levels, ws.save(_middle(levels, total), "middle"), total), "start")
    for step in range(TRIES):
        params = ws.save(_step(levels, params, total, 3, choose=step == TRIES - 1), f"try{step}")
        release(ws.spark)
    for step in range(MOST_STEPS):
        then = ws.save(_step(levels, params, total, 1), f"step{step}")
        release(ws.spark)
        both = params.select("g", F.col("determinant")[0].alias("before"), F.lit(None).cast("double").alias("after")).union(then.select("g", F.lit(None).cast("double"), F.col("determinant")[0]))
        falls = both.groupBy("g").agg((F.max("before") - F.max("after")).alias("fall"))
        params = then
        if not falls.where(F.col("fall") > SETTLED).take(1):
            break
    return ws.save(_step(levels, params, total, 1, last=True), "last")


def _drawn(batch: pd.DataFrame) -> pd.DataFrame:
    """The estimate of a group, drawn towards that of its language, and that towards that of all rows."""
    rows = []
    for r in batch.itertuples():
        centre, spread = np.array(r.c0), np.array(r.s0)
        for n, c, s in ((r.n1, r.c1, r.s1), (r.n2, r.c2, r.s2)):
            w = n / (n + SHRINK)
            centre, spread = w * np.array(c) + (1 - w) * centre, w * np.array(s) + (1 - w) * spread
        rows.append((r.g2, centre.tolist(), spread.tolist()))
    return pd.DataFrame(rows, columns=["g2", "centre", "spread"])


def drawn(rows: DataFrame, params: DataFrame) -> DataFrame:
    """g2, centre and spread that its rows are judged by."""
    groups = rows.select("g2", "g1").distinct().withColumn("g0", F.lit("0"))
    for i in (2, 1, 0):
        groups = groups.join(params.select(F.col("g").alias(f"g{i}"), F.col("n_group").alias(f"n{i}"), F.col("centre").alias(f"c{i}"), F.col("spread").alias(f"s{i}")), f"g{i}")
    return groups.mapInPandas(lambda batches: map(_drawn, batches), "g2 string, centre array<double>, spread array<double>")


def judges(ws: Workspace, all_rows: DataFrame) -> DataFrame:
    """g2, its rows n, and the centre and spread that its rows are judged by; null where all rows failed the base rules."""
    good = all_rows.where(~F.col("base_failed"))
    found = drawn(good, estimates(ws, good))
    return ws.save(all_rows.groupBy("g2").agg(F.count("*").alias("n")).join(found, "g2", "left"), "groups")


def _too_far(batch: pa.RecordBatch, x: np.ndarray, v: np.ndarray, failed: np.ndarray) -> np.ndarray:
    """Squared distances, nan where the base rules failed."""
    d2 = np.full(len(failed), np.nan)
    if not failed.all():
        some = batch.filter(pa.array(~failed))
        d2[~failed] = distances(x[~failed], v[~failed], _matrix(some.column("centre"), P), _matrix(some.column("spread"), P * P).reshape(-1, P, P))
    return d2


def judged(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, distance2 (null if base_failed) and kept of each document."""
    ws = Workspace(docs.sparkSession, "quality")
    all_rows = ws.save(measured(docs), "measured")
    groups = judges(ws, all_rows)
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    cut = chi2_quantile(OUTLIER, P)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
        d2 = _too_far(batch, _columns(batch, _XS), _columns(batch, _VS), failed)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in counts), pa.array(~failed & ~(d2 > cut)), pa.array(d2, mask=failed)], [*counts, "kept", "distance2"])

    far = hot_join(all_rows, groups, "g2", all_rows.count(), gather=True).select(*counts, *_XS, *_VS, "centre", "spread")
    return map_batches(far, each, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, distance2 double")


def passed(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns; the verdict is each row's own."""
    ws = Workspace(docs.sparkSession, "quality")
    all_rows = ws.save(measured(docs), "measured")
    groups, total, width, at = judges(ws, all_rows), all_rows.count(), len(docs.columns), docs.columns.index("text")
    ws.drop("measured")
    cut = chi2_quantile(OUTLIER, P)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics((t or "").encode()) for t in batch.column(at).to_pylist()]
        failed = np.array([base_fails(f) for f in found], bool)
        own = pa.RecordBatch.from_arrays(batch.columns[width:], ["centre", "spread"])
        d2 = _too_far(own, np.array([f[5] for f in found]).reshape(-1, P), np.array([f[6] for f in found]).reshape(-1, P), failed)
        return pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width]).filter(pa.array(~failed & ~(d2 > cut)))

    keyed = docs.select(*(F.col(f"`{c}`") for c in docs.columns), _group().alias("judged_group"))
    of = groups.select(F.col("g2").alias("judged_group"), "n", F.col("centre").alias("judged_centre"), F.col("spread").alias("judged_spread"))
    joined = hot_join(keyed, of, "judged_group", total, gather=True).select(*(F.col(f"`{c}`") for c in docs.columns), "judged_centre", "judged_spread")
    return map_batches(joined, each, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir))
