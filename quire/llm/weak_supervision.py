"""Quality rules as weak supervision.

Each rule looks at a few counts of a text and votes good, bad or abstains.  No
rule decides alone: expectation-maximisation over the votes of all documents
estimates how often each rule votes which way on good and on bad texts, and a
document's posterior probability of being good replaces all-must-pass filtering.

The votes of a document form one pattern.  Spark counts documents by pattern, and
EM runs on the pattern counts: at most 3**(number of rules) rows, however many
documents, and the same result as EM over all documents.  Most rules look for one
fault and vote bad or abstain, since the lack of one fault says little; a bad vote
on a text that all else speaks for lowers the rule's estimated accuracy.  Good and
bad keep their meaning because the estimates start from, and are tied by pseudo-
votes (``PRIOR_SHARE`` of the documents) to, rules that are right more often than not.

Counts (words are ``[^\\x20\\x09-\\x0D]+`` of the whole text): word_chars, code points
in words; n_symbols, characters of ``[#*$%&|<>]``; n_dup_lines, \\n-split lines with
a word that equal an earlier line; n_repeat_words, words in 5-word windows that
occur twice or more in the text, the first included.

A text fails the base when n_words < 10 or 100 * n_repeat_words > 20 * n_words; it is
kept when it passes and its posterior is 0.5 or more.

Defined results: null and empty texts have zero counts and fail the base; rules
that need words abstain without; an empty table gives an empty result; extra
columns are ignored, and repeated rows are rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import shared_keys, wordhash
from quire.session import ensure_checkpoint_dir

#: The symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20
KEEP_POSTERIOR = 0.5
PRIOR_SHARE = 0.02
PRIOR_GOOD = 0.75
ROUNDS = 200
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_PLAIN_END = np.zeros(256, dtype=bool)                      # letters, digits and sentence marks
_PLAIN_END[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b".,;:!?)\"'"]] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits",
           "n_distinct", "n_endings", "n_plain_ends")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a batch."""
    buf, offsets = wordhash.utf8(texts)
    w = wordhash.words(texts)
    n = len(offsets) - 1
    at, h = wordhash.windows(w, 5)
    keyed = wordhash.mix(h + w.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.row) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    repeat = np.cumsum(cover[:-1]) > 0
    words_keyed = wordhash.mix(w.hash + w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.unique(words_keyed, return_index=True)[1]
    last = buf[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in range(n):
        seen: set[bytes] = set()
        for line in bytes(buf[offsets[r]:offsets[r + 1]]).split(b"\n"):
            if line.strip():
                lines[r] += 1
                dups[r] += line in seen
                seen.add(line)
    in_word = np.ones(len(buf), dtype=bool)
    in_word[(buf == 32) | ((buf >= 9) & (buf <= 13))] = False
    return {
        "n_words": np.diff(w.first), "word_chars": _per_row(in_word & ~_CONTINUES[buf], offsets),
        "n_symbols": _per_row(_SYMBOL[buf], offsets), "n_dup_lines": dups,
        "n_repeat_words": np.bincount(w.row[repeat], minlength=n), "n_lines": lines,
        "n_upper": _per_row((buf >= 65) & (buf <= 90), offsets), "n_lower": _per_row((buf >= 97) & (buf <= 122), offsets),
        "n_digits": _per_row((buf >= 48) & (buf <= 57), offsets), "n_distinct": np.bincount(w.row[distinct], minlength=n),
        "n_endings": np.bincount(w.row[(last == 46) | (last == 33) | (last == 63)], minlength=n),
        "n_plain_ends": np.bincount(w.row[_PLAIN_END[last]], minlength=n),
    }


#: The votes (bad, abstain, good) expected on bad and on good texts.
_EXPECTED = {
    "fault": ((0.25, 0.7498, 0.0002), (0.01, 0.9898, 0.0002)),
    "merit": ((0.0002, 0.4998, 0.5), (0.0002, 0.2498, 0.75)),
    "both": ((0.25, 0.35, 0.4), (0.01, 0.24, 0.75)),
}


def _vote(bad: Column | None, good: Column | None) -> tuple[str, Column]:
    kind = "both" if bad is not None and good is not None else "fault" if bad is not None else "merit"
    vote = F.lit(0) if good is None else F.when(good, 1).otherwise(0)
    return kind, vote if bad is None else F.when(bad, -1).otherwise(vote)


def rules() -> dict[str, tuple[str, Column]]:
    """Rule -> (kind, its vote: 1 good, -1 bad, 0 abstains) from the counts; no vote on a text without words."""
    n, c = F.col("n_words"), F.col
    votes = {
        "symbols": _vote(c("n_symbols") * 100 > n * 10, None),
        "symbols_many": _vote(c("n_symbols") * 100 > n * 30, None),
        "ends": _vote(c("n_plain_ends") * 100 < n * 70, None),
        "repeats": _vote(c("n_repeat_words") * 100 > n * 15, None),
        "lines": _vote((c("n_dup_lines") * 100 > c("n_lines") * 30) & (c("n_lines") >= 4), None),
        "word_length": _vote((c("word_chars") < n * 2) | (c("word_chars") > n * 14), None),
        "capitals": _vote(c("n_upper") > c("n_lower"), None),
        "digits": _vote(c("n_digits") * 100 > c("word_chars") * 20, None),
        "variety": _vote((c("n_distinct") * c("n_distinct") < n * 4) & (n >= 40), c("n_distinct") * c("n_distinct") >= n * 16),
        "endings": _vote((c("n_endings") * 100 > n * 40) | ((c("n_endings") == 0) & (n >= 60)),
                         (c("n_endings") * 100 <= n * 25) & (c("n_endings") * 100 >= n)),
        "length": _vote(None, n >= 40),
        "plain": _vote(None, (c("n_symbols") * 100 <= n) & (c("n_upper") * 5 <= c("n_lower"))),
    }
    return {name: (kind, F.when(n > 0, vote).otherwise(0)) for name, (kind, vote) in votes.items()}


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, kinds: list[str], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """(share of good, P(vote | class)) of vote patterns (rows of -1, 0, 1) with counts ``n``.

    The second value has a row for each rule (of that kind) and [class: bad, good][vote + 1].
    """
    prior = np.array([_EXPECTED[k] for k in kinds])               # rule, class, vote
    theta, good, tie = prior, PRIOR_GOOD, PRIOR_SHARE * n.sum()
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)      # pattern, rule, vote
    for _ in range(rounds if n.sum() else 0):
        q = posterior(good, theta, patterns)
        weight = np.stack([n * (1 - q), n * q], axis=1)                                # pattern, class
        seen = np.einsum("pc,prv->rcv", weight, onehot) + tie * prior
        theta = seen / seen.sum(axis=2, keepdims=True)
        good = float((weight[:, 1].sum() + tie * PRIOR_GOOD) / (n.sum() + tie))
    return good, theta


def posterior(good: float, theta: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """P(good | votes) of each pattern."""
    log = np.log(theta)
    rule = np.arange(patterns.shape[1])[None, :]
    odds = np.log(good) - np.log(1 - good) + (log[rule, 1, patterns + 1] - log[rule, 0, patterns + 1]).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, the votes (vote_<rule>), posterior, base_failed and kept for each row of ``docs`` (doc_id, text)."""
    ensure_checkpoint_dir(docs.sparkSession)

    def run(batches):
        for part in shared_keys.slices(batches):
            found = counts(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(found[c].astype(np.int64)) for c in _COUNTS]],
                                             names=["doc_id", *_COUNTS])

    counted = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
               .mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)))
    votes = rules()
    digits = [(F.col(f"vote_{name}") + 1) * 3 ** i for i, name in enumerate(votes)]
    voted = counted.withColumns({f"vote_{name}": vote for name, (_, vote) in votes.items()})
    voted = voted.withColumn("pattern", sum(digits[1:], digits[0]).cast("int")).checkpoint()      # counts only, a few bytes a row
    table = voted.groupBy("pattern").count().orderBy("pattern").toPandas()                        # <= 3 ** rules rows
    code = table["pattern"].to_numpy(dtype=np.int64)
    patterns = np.stack([code // 3 ** i % 3 - 1 for i in range(len(votes))], axis=1).astype(int)
    good, theta = expectation_maximisation(patterns, table["count"].to_numpy(dtype=float), [k for k, _ in votes.values()])
    q = posterior(good, theta, patterns)
    known = docs.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(code, q)], "pattern int, posterior double")
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    return (voted.join(F.broadcast(known), "pattern").withColumn("base_failed", base)
            .withColumn("kept", ~base & (F.col("posterior") >= KEEP_POSTERIOR)).drop("pattern"))


def op9_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """Every document's base counts and the verdict of the rules together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                              "posterior")
