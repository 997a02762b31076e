"""Quality rules of documents, and verdicts on hosts from the failures of their documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names, pieces, stored, widened

_BASE = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, failures int"
#: The rules, by bit of `failures`. Of any document that fails one of the first two nothing is kept.
RULES = ("words", "repeats", "symbols", "lines")
BASE_RULES = 0b0011
#: Bytes that part words: space and 9 to 13. No longer UTF-8 sequence has them.
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of `width` words that are found twice or more, the first included."""
    n = len(words)
    if n <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) > n - 2:
        return 0
    span = 1
    while span < width:  # ids of windows twice as wide, exactly: no hashing
        pairs = ids[:-span] * (n + 1) + ids[span:]
        ids = np.unique(pairs, return_inverse=True)[1]
        span *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:n]))


def line_counts(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    return len(lines), len(lines) - len(set(lines))


def failures(n_words: int, n_repeat_words: int, n_symbols: int, n_lines: int, n_dup_lines: int) -> int:
    """Bits of the RULES that a text fails: under 20 words; over 30 % of words in repeated 8-word windows; more than a symbol
    for each ten words; over half of its lines equal to earlier ones."""
    failed = (n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > n_words, 2 * n_dup_lines > n_lines)
    return sum(bit << i for i, bit in enumerate(failed))


def _measured(raw: bytes) -> tuple[int, int, int, int, int]:
    words = raw.split()
    n_lines, n_dup_lines = line_counts(raw)
    return len(words), repeated_words(words), sum(raw.count(c) for c in _SYMBOLS), n_lines, n_dup_lines


def text_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """The counts of each text and the rules that it fails, as bits. A null text has no words and so fails. One narrow pass."""

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            rows = []
            for raw in texts:
                n_words, again, symbols, n_lines, dup_lines = _measured(raw)
                inside = len(raw.translate(None, _CONTINUATION + _SPACES))
                rows.append((n_words, inside, symbols, dup_lines, again, n_lines, failures(n_words, again, symbols, n_lines, dup_lines)))
            columns = list(zip(*rows))
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split(" ")[0] for x in _BASE.split(", ")])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias(text))
    return rows.mapInArrow(rules, _BASE)


def host_verdicts(rules: DataFrame, least: float = 0.5, most: float = 0.9, tolerated: float = 0.02) -> DataFrame:
    """host, n_docs, rate_<rule> of each of the RULES, rejected and strict for each host of text_rules().

    The rate of a rule's failures is shrunk by an empirical beta prior, fitted for that rule to all hosts by the method of
    moments (each host's observed rate counts once; where hosts differ no more than chance, the prior weighs as much as
    an average host). A host is rejected where a shrunk rate reaches three deviations above the prior's mean, but no less
    than `least` and no more than `most`: much of what it has fails, and it stands out. `strict` has the bits of rules whose shrunk rate is `tolerated` or more: on such
    a host failing them is no exception, and its documents that do so are not kept; elsewhere they are. Documents
    of a host are pre-aggregated in each task. Null is a host like any other.
    """
    failed = [F.sum(F.shiftright("failures", i).bitwiseAND(F.lit(1)).cast("long")).alias(f"n_{r}") for i, r in enumerate(RULES)]
    hosts = stored(rules.groupBy("host").agg(F.count("*").alias("n_docs"), *failed))
    moments = [f(F.col(f"n_{r}") / F.col("n_docs")) for r in RULES for f in (F.avg, F.var_pop)]
    size, *moments = hosts.agg(F.avg("n_docs"), *moments).first()
    rejected, strict = F.lit(False), F.lit(0)
    rates = []
    for i, r in enumerate(RULES):
        alpha, beta = beta_prior(moments[2 * i], moments[2 * i + 1], size)
        mean = alpha / (alpha + beta)
        deviation = (mean * (1 - mean) / (alpha + beta + 1)) ** 0.5
        rate = (F.col(f"n_{r}") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
        rates.append(rate.alias(f"rate_{r}"))
        rejected = rejected | (rate >= max(least, min(most, mean + 3 * deviation)))
        strict = strict.bitwiseOR(F.when(rate >= tolerated, F.lit(1 << i)).otherwise(F.lit(0)))
    return hosts.select("host", "n_docs", *rates, rejected.alias("rejected"), strict.alias("strict"))


def _passes(failed: str, rejected: str, strict: str):
    """Whether a document is kept, by the rules it fails and its host's verdict."""
    return ~F.col(rejected) & (F.col(failed).bitwiseAND(F.lit(BASE_RULES).bitwiseOR(F.col(strict))) == 0)


def beta_prior(mean: float | None, spread: float | None, size: float | None) -> tuple[float, float]:
    """Parameters of the beta distribution with this mean and variance; its weight is bounded to 1 ... size."""
    if mean is None:
        return 0.5, 0.5
    inner = min(max(mean, 1e-6), 1 - 1e-6)
    weight = inner * (1 - inner) / spread - 1 if spread else size
    weight = min(max(weight, 1.0), max(size, 1.0))
    return inner * weight, (1 - inner) * weight


def judged(docs: DataFrame, tolerated: float = 0.02, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """The columns of text_rules() and base_failed, host_rejected and kept: whether the document passes the first two rules, its
    host is not rejected, and it fails no rule that its host is strict in.

    Counts are computed once and stored; host verdicts come back by a join on the host, which Spark splits where one
    host has many documents. Rows are kept as they are; other columns are ignored; an empty table gives an empty result.
    """
    rules = stored(text_rules(docs, text, key, host))
    verdicts = host_verdicts(rules, tolerated=tolerated).select(F.col("host").alias("_host"), "rejected", "strict")
    joined = rules.join(verdicts, F.col("host").eqNullSafe(F.col("_host")))
    kept = _passes("failures", "rejected", "strict")
    return joined.select(*rules.columns, (F.col("failures").bitwiseAND(F.lit(BASE_RULES)) != 0).alias("base_failed"), F.col("rejected").alias("host_rejected"), kept.alias("kept"))


def good_documents(docs: DataFrame, tolerated: float = 0.02, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """The rows of docs, all columns, that judged() keeps. Texts are read twice rather than stored or shuffled. Columns may have
    any name; null texts go, null ids and hosts are kept as they are; an empty table stays empty."""
    failed, name, rejected, strict = free_names(docs.columns, "_failures", "_host", "_rejected", "_strict")
    verdicts = host_verdicts(text_rules(docs, text, key, host), tolerated=tolerated).select(F.col("host").alias(name), F.col("rejected").alias(rejected), F.col("strict").alias(strict))
    schema = widened(docs.schema, **{failed: "int"})

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            bits = pa.array([failures(*_measured(raw)) for raw in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, bits], [*batch.schema.names, failed])

    passed = docs.mapInArrow(marked, schema).where(F.col(failed).bitwiseAND(F.lit(BASE_RULES)) == 0)
    joined = passed.join(verdicts, F.col(host).cast("string").eqNullSafe(F.col(name)))
    return joined.where(_passes(failed, rejected, strict)).select(*[F.col(f"`{c}`") for c in docs.columns])
