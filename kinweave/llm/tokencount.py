"""Token counts through two tiers of known word lengths; no word is ever shuffled.

The sentencepiece vocabularies served here keep the blank as the mark U+2581 and have it, in any piece, only in front. So
no merge spans the place between a word and the blanks after it, nor a line feed (which no piece holds), and the count of
a text is the sum over its words. ``word_rules`` verifies both properties on the vocabulary; where one does not hold,
texts are encoded whole.

Tier one holds the lengths of the corpus' most frequent words, at most ``FREQUENT``, counted in about ``SAMPLE_DOCS`` texts
that are drawn from all rows. It is broadcast once as two arrays (the words end to end, a length each) and becomes a hash
table in each worker. Tier two is each worker's cache of the misses, bounded in bytes; words of more than ``LONG_WORD``
characters are encoded whenever they come. The sample decides speed only: no count depends on it.

Defined results: a null text counts as empty (0 bytes, 0 tokens); one row per input row, repeated ones included; a null id
is carried along; an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes, about, of the words that a worker keeps besides the broadcast ones; beyond that it forgets them and starts anew.
CACHE_BYTES = 64_000_000
#: Bytes of an entry of the cache besides the word's own; the longest words that are kept; words that are looked up at a time.
ENTRY_BYTES, LONG_WORD, STEP = 120, 64, 65_536
#: Words of tier one, and texts that they are counted in, about.
FREQUENT, SAMPLE_DOCS = 50_000, 4_000
MARK = "▁"
_RUNS = re.compile(r"\n| *[^ \n]+| +")


def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def word_rules(sp) -> bool:
    """Whether texts may be counted word by word with this model."""
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    inside = any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
    kept = sp.encode(" a  b\n c ", out_type=str)  # blanks are kept and a first one is added
    return not inside and "".join(kept).replace("<0x0A>", "\n") == f"{MARK}{MARK}a{MARK}{MARK}b\n{MARK}c{MARK}"


def frequent_words(docs: DataFrame, text_col: str = "text", words: int = FREQUENT, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """The words, with the blank in front, that stand most often in a sample of the texts."""
    text = docs.select(F.col(f"`{text_col}`").alias("text"))
    share = min(1.0, sample_docs / max(1, docs.count()))
    drawn = text.sample(share, seed=1) if share < 1 else text
    each = drawn.select(F.explode(F.split("text", "[ \n]+")).alias("w")).filter(F.char_length("w").between(1, LONG_WORD))
    top = each.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words)  # partial counts first; the sample is bounded
    return [" " + r["w"] for r in top.collect() if MARK not in r["w"]]


class Lengths:
    """Words and their lengths as two arrays: what is broadcast."""

    def __init__(self, words: list[str], model: str):
        lengths = Counter(model).lengths(words) if words else []
        self.text, self.lengths = "\n".join(words).encode(), np.array(lengths, np.uint16)

    def table(self) -> dict[str, int]:
        return dict(zip(self.text.decode().split("\n"), self.lengths.tolist())) if len(self.lengths) else {}


class Counter:
    """Numbers of tokens of whole texts, equal to those of the model."""

    def __init__(self, model: str, frequent: dict[str, int] | None = None, cache_bytes: int = CACHE_BYTES):
        self.sp = _processor(model)
        self.by_word = word_rules(self.sp)
        self.frequent, self.limit = frequent or {}, cache_bytes
        self.known, self.held = dict(self.frequent), 0
        # Words are encoded behind a line feed, whose tokens are then taken off: the model adds a blank in front of a text.
        self.behind = len(self.sp.encode("\n"))

    def lengths(self, words: list[str]) -> list[int]:
        return [len(ids) - self.behind for ids in self.sp.encode(["\n" + w for w in words], num_threads=1)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word:
            return len(self.sp.encode(text, num_threads=1))
        text = " " + text.replace(MARK, " ")
        if "  " in text or " \n" in text or text[-1] == " " or "\0" in text:
            units = _RUNS.findall(text)
        else:
            units = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return sum(self._sum(units[lo : lo + STEP]) for lo in range(0, len(units), STEP))

    def _sum(self, units: list[str]) -> int:
        new = set(units).difference(self.known)
        if not new:
            return sum(map(self.known.__getitem__, units))
        size = sum(len(w) + ENTRY_BYTES for w in new if len(w) <= LONG_WORD)
        if self.held + size > self.limit:
            self.known, self.held = dict(self.frequent), 0
            new = set(units).difference(self.known)
        learned = dict(zip(new, self.lengths(list(new))))
        short = {w: n for w, n in learned.items() if len(w) <= LONG_WORD}
        self.known.update(short)
        self.held += sum(len(w) + ENTRY_BYTES for w in short)
        if len(short) == len(learned):
            return sum(map(self.known.__getitem__, units))
        return sum(learned[w] if w in learned else self.known[w] for w in units)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens (without begin, end or added tokens), over_limit (n_tokens > limit)."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    frequent = docs.sparkSession.sparkContext.broadcast(Lengths(frequent_words(docs, text_col), model))  # at most FREQUENT words of LONG_WORD characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model, frequent.value.table())
        for batch in batches:
            size, tokens = [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                size.append(len(text.encode()))
                tokens.append(counter.count(text))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)
