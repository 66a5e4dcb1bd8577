"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule says good (1), bad (0) or abstains. Documents with equal votes count as one pattern, of
which there are 3^rules at most, so the whole corpus enters the estimate as a bounded table of
counts. EM fits the share of good documents and each rule's chance to say good, bad or nothing of
either class; a document is kept by its pattern's posterior probability of being good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loamcast.llm.common import longs, make_room, numbered, restored, slices, stage, texts_of

SYMBOLS = b"#*$%&|<>"
_SPACE = bytes([32, *range(9, 14)])
_CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_POSTERIOR = 50, 50, 0.5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words")
_LETTER = bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window that occurs twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    m = len(ids)
    if m == n:
        return 0
    code = a[:-2] * m + a[1:-1]
    if m >= 1 << 21:  # a third factor would leave 64 bits
        code = np.unique(code, return_inverse=True)[1]
    code = code * m + a[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    again = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        hit[again + k] = True
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The FEATURES of one text."""
    words = text.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    chars = len(text.translate(None, _SPACE + _CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    letters = sum(1 for w in words if w[0] in _LETTER)
    return len(words), chars, symbols, dup, repeat_words(words), lines, letters


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with FEATURES (long); a null text has none of anything."""
    at = docs.columns.index(text_col)
    schema = T.StructType(docs.schema.fields[:])
    for f in FEATURES:
        schema = schema.add(f, "long")

    def run(batches):
        make_room()
        for whole in batches:
            for b in slices(whole, at, 2 << 20):
                rows = [measure(x) for x in texts_of(b.column(at))]
                cols = np.array(rows, np.int64).reshape(-1, len(FEATURES)).T
                yield pa.RecordBatch.from_arrays([*b.columns, *map(longs, cols)], names=[*b.schema.names, *FEATURES])

    return docs.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules() -> list[Column]:
    """Votes of each rule over the features: 2 good, 1 bad, 0 abstains."""
    n, share = F.greatest(F.col("n_words"), F.lit(1)), lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    vote = lambda good, bad: F.when(bad, 1).when(good, 2).otherwise(0)
    return [
        vote(F.col("n_words") >= 100, F.col("n_words") < MIN_WORDS),
        vote(share("n_repeat_words") < 0.1, share("n_repeat_words") > 0.5),
        vote(F.col("n_symbols") < 0.01 * F.col("word_chars"), F.col("n_symbols") > 0.1 * F.col("word_chars")),
        vote((F.col("word_chars") / n).between(3.5, 9), ~(F.col("word_chars") / n).between(2, 14)),
        vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        vote(share("n_letter_words") > 0.9, share("n_letter_words") < 0.6),
    ]


def fit(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 100) -> np.ndarray:
    """Posterior probability of being good for each vote pattern (base-3 codes), by EM.

    It starts from rules that are right four times in five; counts are smoothed by one, so a rule
    that never votes changes nothing. Without documents the result is empty.
    """
    votes = patterns[:, None] // 3 ** np.arange(n_rules) % 3
    table = np.empty((2, n_rules, 3))
    table[1], table[0] = [0.2, 0.16, 0.64], [0.2, 0.64, 0.16]
    prior, total = 0.8, counts.sum()
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        logs = np.log(table[:, np.arange(n_rules), votes]).sum(axis=2) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        for y, p in ((1, new), (0, 1 - new)):
            for v in range(3):
                table[y, :, v] = ((votes == v) * (p * counts)[:, None]).sum(axis=0) + 1
            table[y] /= table[y].sum(axis=1, keepdims=True)
        prior = float(np.clip(((new * counts).sum() + 1) / (total + 2), 1e-6, 1 - 1e-6))
        if len(new) and np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return post


def _voted(measured: DataFrame) -> DataFrame:
    code = sum((v * 3**k for k, v in enumerate(rules())), F.lit(0)).cast("int")
    return measured.withColumns({"base_failed": base_failed(), "__votes": code})


def posteriors(measured: DataFrame) -> DataFrame:
    """(__votes, posterior) of every vote pattern of measured (with FEATURES): 3^rules rows at most."""
    found = _voted(measured).groupBy("__votes").agg(F.count(F.lit(1)).alias("n")).orderBy("__votes").collect()
    post = fit(np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.float64), len(rules()))
    return measured.sparkSession.createDataFrame([(int(r[0]), float(p)) for r, p in zip(found, post, strict=True)], "__votes int, posterior double")


def judge(measured: DataFrame, table: DataFrame, least: float = MIN_POSTERIOR) -> DataFrame:
    """measured (with FEATURES) and base_failed, posterior (double), kept.

    table is posteriors(measured). kept is false where base_failed, else whether the posterior is `least`
    or more.
    """
    out = _voted(measured).join(F.broadcast(table), "__votes").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
    return out.drop("__votes")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, FEATURES, base_failed, posterior, kept) for every row.

    Only the id and the text are read, so other columns of docs may have any name. A null text has no
    words and fails the base rule, as an empty one; long texts are read whole. Rows with equal texts have
    equal results, repeated rows a row each, a null id stays null. An empty table gives an empty result.
    """
    measured = stage(features(docs.select(id_col, text_col), text_col).drop(text_col), "quality-features")
    return judge(measured, posteriors(measured))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs, whatever these are called.

    Null, empty and short texts fail the base rule; long texts are read whole. Repeated rows are judged
    one by one, alike. An empty table gives an empty result.
    """
    rows = numbered(docs)
    text = rows.columns[docs.columns.index(text_col)]
    table = posteriors(features(rows.select(text), text))
    # Texts are measured again rather than written to disk in between.
    return restored(judge(features(rows, text), table).where("kept"), docs.columns)
