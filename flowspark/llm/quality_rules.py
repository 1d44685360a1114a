"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger row holds the measurements and one long with a failure bit per rule; a
policy version is a mask over those bits, so policies are applied and compared without reading texts again, and ablations
are bitwise aggregations over the distinct masks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm import tokens as T

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_bare_words", "n_same_words")

#: Rule name -> failure test over the measurements; the place in this list is the bit. Append only: stored ledgers rely on it.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("too_long", "n_words > 100000"),
    ("mean_word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("upper_case", "100 * n_upper_words > 40 * n_words"),
    ("bare_words", "100 * n_bare_words > 20 * n_words"),
    ("some_repeats", "100 * n_repeat_words > 20 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BITS[n] for n in set(names))


#: Policy version -> rules it enforces.
POLICIES = {
    "base": mask("too_short", "repeated_windows"),
    "v1": mask("too_short", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": mask("too_short", "repeated_windows", "too_long", "mean_word_length", "symbols", "duplicate_lines", "upper_case", "bare_words"),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _has(f: T.Flat, starts: np.ndarray, ends: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Whether each span holds a byte that passes the test."""
    at = np.flatnonzero(test)
    return np.searchsorted(at, ends) > np.searchsorted(at, starts)


def measure_texts(f: T.Flat) -> dict[str, np.ndarray]:
    """The measurements of every text of a batch."""
    n = len(f)
    starts, ends, text_of = T.word_spans(f)
    hashes = T.span_hashes(f.buf, starts, ends)
    sep = f.per_text(np.flatnonzero(T._SEP[f.buf]))
    inner = f.per_text(np.flatnonzero((f.buf & 0xC0) == 0x80))
    out = {
        "n_words": np.bincount(text_of, minlength=n),
        "word_chars": np.diff(f.offsets) - inner - sep,
        "n_symbols": f.per_text(np.flatnonzero(_SYMBOL[f.buf])),
    }
    # lines that hold a word; a line ends at a line feed or with its text
    cut = np.zeros(len(f.buf) + 1, bool)
    cut[f.offsets] = True
    cut[np.flatnonzero(f.buf == 10)] = True
    bounds = np.flatnonzero(cut)
    feed = np.zeros(len(f.buf) + 1, bool)
    feed[: len(f.buf)] = f.buf == 10
    begin, end = bounds[:-1] + feed[bounds[:-1]], bounds[1:]
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[worded], end[worded]
    line_of = f.owner(begin)
    one, _ = T.distinct_pairs(line_of, T.span_hashes(f.buf, begin, end))
    out["n_lines"] = np.bincount(line_of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(one, minlength=n)
    # words that lie in a three-word window found twice or more in the text
    whole = T.whole_runs(text_of, 3)
    key = np.bitwise_xor(T.gram_hashes(hashes, 3), T.mix64(text_of[: len(whole)].astype(np.uint64) + np.uint64(1)))[whole]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    windows = np.flatnonzero(whole)[twice]
    covered = np.zeros(len(starts), bool)
    for j in range(3):
        covered[windows + j] = True
    out["n_repeat_words"] = np.bincount(text_of[covered], minlength=n)
    same = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
    out["n_same_words"] = np.bincount(text_of[1:][same], minlength=n)
    small = (f.buf >= 97) & (f.buf <= 122)
    upper = (f.buf >= 65) & (f.buf <= 90)
    other = f.buf >= 128
    low, big, far = (_has(f, starts, ends, x) for x in (small, upper, other))
    out["n_upper_words"] = np.bincount(text_of[big & ~low & (ends - starts > 2)], minlength=n)
    out["n_bare_words"] = np.bincount(text_of[~(low | big | far)], minlength=n)
    return out


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements); a null or empty text measures 0 everywhere; repeated rows are measured each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            got = measure_texts(T.flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(got[c].astype(np.int64)) for c in MEASURES)], names=["doc_id", *MEASURES]
            )

    rows = T.id_text(df, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} long" for c in MEASURES)]))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Measurements and ``failed``: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, (_, test) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << i)).otherwise(0).cast("long"))
    return measure(df, id_col, text_col).withColumn("failed", bits)


def passes(policy: str | int, failed: str | Column = "failed") -> Column:
    """Whether a ledger row passes a policy version (or a mask)."""
    c = F.col(failed) if isinstance(failed, str) else failed
    enforced = POLICIES[policy] if isinstance(policy, str) else policy
    return c.bitwiseAND(F.lit(enforced).cast("long")) == 0


def ablation(rows: DataFrame, policy: str = "v2", rules=RULES) -> DataFrame:
    """Per enforced rule: texts failing it, failing it alone, and kept if the policy left it out.

    One aggregation over the distinct masks, of which there are 2**rules at most.
    """
    enforced = POLICIES[policy]
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(enforced).cast("long")).alias("f")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(rules) if enforced >> i & 1])
    each = counts.select("f", "n", F.explode(names).alias("r")).select("f", "n", "r.*")
    hit, rest = F.col("f").bitwiseAND(F.col("bit")) != 0, F.col("f").bitwiseAND(F.bitwise_not("bit")) == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(total(hit).alias("n_failed"), total(hit & rest).alias("n_only"), total(rest).alias("n_kept_without"))
