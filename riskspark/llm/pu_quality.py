"""Quality scores by positive-unlabelled learning.

Only trusted positives (and how frequent they are) come from labels.  A logistic model
g minimises the non-negative unbiased risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

over the positives and all unlabelled texts.  Texts are turned into a few numbers each
(shares of character classes, repetition, word shapes) once; every step of the fit is one
pass over these numbers, summed inside the tasks, then by Spark: each row takes part, and
only sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .repetition import _covered, _repeated
from .store import keyed, plain_id, small, stored

FEATURES = [
    "log_words", "log_bytes", "word_chars", "upper", "digits", "bang", "symbols", "bars", "angles", "non_ascii", "spaces",
    "equal_neighbours", "log_distinct", "repeated_trigrams", "repeated_lines", "bare_words", "ending_marks", "entropy", "line_words", "upper_words", "longest_word",
]
_CLASSES = np.zeros((256, 9), np.float64)
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"#*$%&", b"|", b"<>", bytes(range(128, 256)), b" \t\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz"]):
    _CLASSES[np.frombuffer(_chars, np.uint8), _k] = 1
_IS_LETTER = (_CLASSES[:, 0] + _CLASSES[:, 6] + _CLASSES[:, 8]) > 0
_IS_LOWER = (_CLASSES[:, 6] + _CLASSES[:, 8]) > 0
_IS_MARK = np.zeros(256, bool)
_IS_MARK[np.frombuffer(b".,;:!?", np.uint8)] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a batch; an empty text has zeros."""
    n = offsets.size - 1
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    counts = np.bincount(text * 256 + data, minlength=256 * n).reshape(n, 256).astype(np.float64)
    total = np.maximum(1.0, counts.sum(1))
    shares = counts / total[:, None]
    entropy = -(shares * np.log2(np.where(shares > 0, shares, 1.0))).sum(1)
    upper, digits, bang, symbols, bars, angles, wide, spaces, lower = (counts @ _CLASSES).T
    starts, ends, word_text = K.words(data, offsets)
    spans, cp = K.Spans(data), K.code_points(data)
    per = lambda w=None, t=word_text: np.bincount(t, w, minlength=n).astype(np.float64)
    n_words = per()
    words = np.maximum(1.0, n_words)
    h = spans.hash(starts, ends)
    later = _repeated(h, word_text)[1] if h.size else np.zeros(0, bool)
    neighbour = np.zeros(h.size, bool)
    neighbour[1:] = (h[1:] == h[:-1]) & (word_text[1:] == word_text[:-1])
    tri, at = K.windows(h, word_text, 3)
    hit = _covered(h.size, at, _repeated(tri, word_text[at])[0], 3) if at.size else np.zeros(h.size, bool)
    running = np.zeros((2, data.size + 1), np.int64)
    np.cumsum(_IS_LETTER[data], out=running[0, 1:])
    np.cumsum(_IS_LOWER[data], out=running[1, 1:])
    letters, lowers = running[0, ends] - running[0, starts], running[1, ends] - running[1, starts]
    lines = np.bincount(text[data == 10], minlength=n) + 1.0
    line_starts, stops, line_text = K.lines(data, offsets)
    full = stops > line_starts
    line_text = line_text[full]
    again = _repeated(spans.hash(line_starts[full], stops[full]), line_text)[1] if full.any() else np.zeros(0, bool)
    longest = np.zeros(n)
    np.maximum.at(longest, word_text, (cp[ends] - cp[starts]).astype(np.float64))
    root = lambda x, y: np.sqrt(x / np.maximum(1.0, y))
    return np.column_stack([
        np.log1p(n_words), np.log1p(size), per(cp[ends] - cp[starts]) / words, root(upper, upper + lower + wide), root(digits, total), root(bang, total), root(symbols, total), root(bars, total), root(angles, total), wide / total, spaces / total,
        root(per(neighbour), words), np.log1p(n_words - per(later)) / np.log1p(words), root(per(hit), words), root(per(again, line_text), lines), root(per(letters == 0), words), per(_IS_MARK[data[ends - 1]]) / words, entropy, np.log1p(n_words / lines), root(per((letters > 1) & (lowers == 0)), words), np.log1p(longest),
    ])


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, text) in, (id, t, x) out."""
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(2))
        for lo, hi in K.pieces(offsets, K.PART_BYTES):
            part = offsets[lo : hi + 1]
            x = text_features(data[part[0] : part[-1]], part - part[0]).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists], ["id", "t", "x"])


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, x array<float>) for each row of ``docs``."""
    return keyed(docs, id_col, text_col).mapInArrow(feature_rows, "id long, t long, x array<float>")


def _summed(rows: DataFrame, columns: list[str], fn) -> np.ndarray:
    """Sum over all rows of ``fn(batch)``, a vector: inside the tasks, then by Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = fn(batch)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    sums = rows.select(*columns).mapInArrow(part, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(sums))
    for r in sums:
        out[r["i"]] = r["v"]
    return out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)


def _standard(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip((x - mean) / sd, -8, 8), np.ones(len(x))])


def fit_pu(rows: DataFrame, prior: float, ridge: float = 1e-3, few: float = 5.0, steps: int = 12, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, sd, weights) of the model of least non-negative risk. ``rows``: x and ``positive`` (else unlabelled).

    Weights are held back by ``ridge`` and, with few rows n, by ``few`` / n.
    Newton steps on the unbiased risk; each pass weighs four step lengths by the
    non-negative risk.  Where the unlabelled part has gone below zero, the step climbs
    that part's gradient instead, as the non-negative estimator does.
    """

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, pos = _matrix(batch), batch.column("positive").to_numpy(zero_copy_only=False)
        return np.concatenate([[len(x), pos.sum()], x.sum(0), (x * x).sum(0)])

    m = _summed(rows, ["x", "positive"], moments)
    if m.size == 0 or m[1] == 0 or m[1] == m[0]:
        return np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.append(np.zeros(len(FEATURES)), np.log(prior / (1 - prior)))
    n, n_pos = m[0], m[1]
    mean = m[2 : 2 + len(FEATURES)] / n
    sd = np.sqrt(np.maximum(m[2 + len(FEATURES) :] / n - mean**2, 0))
    sd = np.where(sd > 1e-6, sd, 1.0)
    d = len(FEATURES) + 1
    penalty = np.append(np.full(d - 1, ridge + few / n), 0.0)

    def sums(tries: np.ndarray):
        def fn(batch: pa.RecordBatch) -> np.ndarray:
            z, pos = _standard(_matrix(batch), mean, sd), batch.column("positive").to_numpy(zero_copy_only=False)
            out = []
            for w in tries:
                g = z @ w
                s = 1 / (1 + np.exp(-g))
                loss_up, loss_down = np.logaddexp(0, -g), np.logaddexp(0, g)
                h = s * (1 - s)
                for who in (pos, ~pos):
                    a = z[who]
                    out += [[loss_up[who].sum(), loss_down[who].sum()], a.sum(0), s[who] @ a, ((a * h[who, None]).T @ a).ravel()]
            return np.concatenate(out)

        return fn

    width = 2 + 2 * d + d * d
    weights, tries = None, np.append(np.zeros(d - 1), np.log(prior / (1 - prior)))[None]
    best = np.inf
    for _ in range(steps):
        parts = _summed(rows, ["x", "positive"], sums(tries)).reshape(len(tries), 2, width)
        parts[:, 0] /= n_pos
        parts[:, 1] /= n - n_pos
        negative = parts[:, 1, 1] - prior * parts[:, 0, 1]
        risk = prior * parts[:, 0, 0] + np.maximum(0, negative) + 0.5 * (penalty * tries**2).sum(1)
        i = int(np.argmin(risk))
        if not risk[i] < best - tolerance * abs(best if np.isfinite(best) else 0):
            if risk[i] < best:
                weights = tries[i]
            break
        best, weights = risk[i], tries[i]
        p, u = parts[i]
        cut = lambda v: (v[2 : 2 + d], v[2 + d : 2 + 2 * d], v[2 + 2 * d :].reshape(d, d))
        (p_x, p_s, p_h), (_, u_s, u_h) = cut(p), cut(u)
        if negative[i] >= 0:
            gradient, hessian = u_s - prior * p_x + penalty * weights, u_h
        else:
            gradient, hessian = prior * p_s - u_s, u_h + prior * p_h
        step = np.linalg.solve(hessian + np.diag(penalty + 1e-6), gradient)
        tries = weights - np.array([1.0, 0.5, 0.2, 0.05])[:, None] * step
    return mean, sd, weights


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, prior: float | None = None, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    held_out: crc32 of the id as text, mod ``folds``, is 0; such rows take no part in the fit.
    Positives: the other rows whose label is 1 (in every row of ``labels`` that has one).
    Unlabelled: the other rows that are not positive, labels hidden.  ``prior``: share of good
    texts; by default estimated as the share of label 1 among the labelled rows that are not
    held out.  The unlabelled sample leaves the positives out, so its own share of good texts
    is worked out from the prior before the fit.  A label counts once for each id, a null
    label or id is none.  Empty and null texts are scored from zero features; without positives
    or without other rows each score is the prior (0.5 if there are no labels).  No rows give no rows.
    """
    rows = stored(feature_table(docs, id_col, text_col), "features")
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    known = small(stored(known, "labels"))
    remainder = F.crc32(F.coalesce(plain_id().cast("string"), F.lit("")).cast("binary")) % folds
    rows = rows.join(known, "id", "left").select("id", "t", "x", (remainder == 0).alias("held_out"), F.when(remainder != 0, F.col("label")).alias("label"))
    rows = stored(rows.withColumn("positive", F.coalesce(F.col("label") == 1, F.lit(False))), "labelled")
    fit = rows.filter("NOT held_out")
    n, n_labelled, n_pos = fit.agg(F.count(F.lit(1)), F.count("label"), F.coalesce(F.sum(F.col("positive").cast("long")), F.lit(0))).first()
    whole = prior if prior is not None else (n_pos / n_labelled if n_labelled else 0.5)
    rest = (whole * n - n_pos) / (n - n_pos) if n > n_pos else whole
    mean, sd, weights = fit_pu(fit.select("x", "positive"), float(np.clip(rest, 0.01, 0.99)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = _standard(_matrix(batch), mean, sd) @ weights if batch.num_rows else np.zeros(0)
            s = 1 / (1 + np.exp(-g))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "t", "held_out", "score", "predicted"])

    return rows.select("id", "t", "held_out", "x").mapInArrow(score, "id long, t long, held_out boolean, score double, predicted int")
