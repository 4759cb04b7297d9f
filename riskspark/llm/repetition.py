"""Repetition rules: how much of a text lies in repeated word n-grams and lines.

Every batch of texts is handled as arrays.  Each word gets a hash; hashes of the words'
hashes are rolled over the texts for several n-gram lengths; a text's repeated hashes
mark their words, and the marked words' characters are summed.  Nothing leaves
the task but one row per text, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

#: Published limits on the share of characters in repeated n-grams of each length.
MAX_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Published limits on the share of lines and of characters in lines that repeat an earlier one.
MAX_LINE_SHARE, MAX_LINE_CHAR_SHARE = 0.30, 0.20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _repeated(h: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes in ``groups`` (texts): whether each occurs twice or more, and whether it is a later one."""
    key = K.mix(h ^ K.mix(groups.astype(K.U64) + K.U64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(s.size + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice, later = np.zeros(s.size, bool), np.zeros(s.size, bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def _covered(n_words: int, at: np.ndarray, hit: np.ndarray, k: int) -> np.ndarray:
    """Words inside a window of ``k`` words that is hit."""
    starts = at[hit]
    edge = np.bincount(starts, minlength=n_words + 1) - np.bincount(starts + k, minlength=n_words + 1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text of a batch."""
    n = offsets.size - 1
    out: dict[str, np.ndarray] = {}
    starts, ends, text = K.words(data, offsets)
    spans, cp = K.Spans(data), K.code_points(data)
    chars = cp[ends] - cp[starts]
    count = lambda x, w=None: np.bincount(x, w, minlength=n).astype(np.int64)
    out["n_words"], out["word_chars"] = count(text), count(text, chars)
    marks = np.zeros(data.size + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=marks[1:])
    out["n_symbols"] = marks[offsets[1:]] - marks[offsets[:-1]]
    values = spans.hash(starts, ends)
    for k in (3, *lengths):
        h, at = K.windows(values, text, k)
        hit = _covered(starts.size, at, _repeated(h, text[at])[0], k) if at.size else np.zeros(starts.size, bool)
        if k == 3:
            out["n_repeat_words"] = count(text[hit])
        if k in lengths:
            out[f"chars_{k}"] = count(text[hit], chars[hit])
    # lines with a word
    line_starts, stops, line_text = K.lines(data, offsets)
    solid = np.zeros(data.size + 1, np.int64)
    np.cumsum(~K.SPACES[data], out=solid[1:])
    full = solid[stops] > solid[line_starts]
    line_starts, stops, line_text = line_starts[full], stops[full], line_text[full]
    later = _repeated(spans.hash(line_starts, stops), line_text)[1] if line_starts.size else np.zeros(0, bool)
    out["n_lines"], out["n_dup_lines"] = count(line_text), count(line_text[later])
    out["line_chars"] = count(line_text, cp[stops] - cp[line_starts])
    out["dup_line_chars"] = count(line_text[later], (cp[stops] - cp[line_starts])[later])
    return out


def verdict(m: Mapping[str, np.ndarray], max_share: Mapping[int, float], max_lines: float, max_line_chars: float) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the counts."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = (m["n_dup_lines"] > max_lines * m["n_lines"]) | (m["dup_line_chars"] > max_line_chars * m["line_chars"])
    for k, share in max_share.items():
        bad |= m[f"chars_{k}"] > share * m["word_chars"]
    return failed, ~failed & ~bad


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: Mapping[int, float] | None = None, max_lines: float = MAX_LINE_SHARE, max_line_chars: float = MAX_LINE_CHAR_SHARE) -> DataFrame:
    """One row per row of ``docs``: counts, repetition coverage and the verdict.

    ``chars_k`` is the number of word characters inside word k-grams that occur at
    least twice in the text (the first one included).  ``base_failed``: under 50
    words, or over half of the words in repeated 3-word windows.  ``kept``: not
    base_failed and within all limits.  Null and empty texts have all counts 0 and
    fail; repeated rows give repeated results; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    limits = dict(MAX_SHARE if max_share is None else max_share)
    lengths = tuple(sorted(limits))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "line_chars", "dup_line_chars", *(f"chars_{k}" for k in lengths)]
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for lo, hi in K.pieces(offsets):
                part = offsets[lo : hi + 1]
                m = measure(data[part[0] : part[-1]], part - part[0], lengths)
                failed, kept = verdict(m, limits, max_lines, max_line_chars)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(m[x]) for x in names), pa.array(failed), pa.array(kept)], ["doc_id", *names, "base_failed", "kept"])

    return source.mapInArrow(rows, schema)
