"""Token counts of byte-level BPE by rank-synchronous array merging.

Every pre-token that a worker has not seen is a ragged row of one symbol array. A round finds
each row's lowest-rank pair and applies it in all rows at once; rows without a pair leave the
arrays. What is left of a row is its token count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from stillwright.llm.array_bpe import ArrayBPE
from stillwright.llm.common import column, steps, texts

#: Unicode white space as the tokenizer's pattern takes it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pattern that splits text before the merges of this vocabulary.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Distinct words that a worker remembers before it starts anew.
MEMORY = 500_000


class Counter:
    """Token counts of whole texts; words seen before are looked up."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.bpe, self.memory = ArrayBPE(path), memory
        self.pattern = regex.compile(PATTERN)
        #: A single space between two other characters begins a pre-token whatever stands around it.
        self.cut = regex.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        self.double = regex.compile(rf"[{SPACE}]{{2}}")
        self.special = regex.compile("|".join(map(regex.escape, self.bpe.special))) if self.bpe.special else None
        #: What stands for itself with the space before it, and what begins a text.
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})

    def _split(self, text: str) -> list[str]:
        """Pieces whose pre-tokens together are those of text; all but the first lack the space before them."""
        return self.cut.split(text) if text[0] in " \n" or text[-1] == " " or self.double.search(text) else text.split(" ")

    def count(self, block: list[str]) -> list[int]:
        out, plan = [0] * len(block), []
        for i, text in enumerate(block):
            if self.special and self.special.search(text):
                out[i] = len(self.special.findall(text))
                plan += [(i, part) for part in self.special.split(text) if part]
            elif text:
                plan.append((i, text))
        split = [(i, self._split(text)) for i, text in plan]
        inner, heads = self.known
        if len(inner) + len(heads) > self.memory:
            inner.clear(), heads.clear()
        self._learn(inner, set().union(*(words[1:] for _, words in split)) - inner.keys(), " ")
        self._learn(heads, {words[0] for _, words in split} - heads.keys(), "")
        for i, words in split:
            out[i] += heads[words[0]] + sum(map(inner.__getitem__, words[1:]))
        return out

    def _learn(self, known: dict[str, int], words: set[str], prefix: str) -> None:
        parts = [self.pattern.findall(prefix + w) for w in words]
        distinct = list({p for ps in parts for p in ps})
        counts = dict(zip(distinct, self.bpe.count([p.encode("utf-8", "surrogatepass") for p in distinct]).tolist(), strict=True))
        known.update((w, sum(counts[p] for p in ps)) for w, ps in zip(words, parts, strict=True))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, memory: int = MEMORY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, special strings as the file marks them.

    One map over the rows, without a shuffle: skew of keys or copies doesn't matter, and a lost
    executor costs its own splits. Null and empty texts have 0 tokens; repeated rows stay; an empty
    table gives an empty result; other columns are not read. Memory: one step of texts
    and `memory` remembered words a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, memory)
        for part in steps(batches):
            block = column(part, "text").to_pylist()
            n = np.array(counter.count(block), np.int64)
            size = pc.binary_length(column(part, "text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
