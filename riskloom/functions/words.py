"""A trie over words: many phrases looked up in many texts at once, each text read once whatever the number of phrases."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A trie of more pickled bytes is not sent to the executors.
MOST_BYTES = 256 << 20


class WordTrie:
    """Phrases, as sequences of words, with what each stands for. Nodes are numbers; 0 is the root."""

    def __init__(self, phrases: Iterable[tuple[tuple[str, ...], int]]):
        self.steps: dict[tuple[int, str], int] = {}
        self.ends: dict[int, list[int]] = {}
        size = 0
        for words, means in phrases:
            node = 0
            for word in words:
                node_, node = node, self.steps.get((node, word), 0)
                if not node:
                    size += 1
                    self.steps[node_, word] = node = size
            if words:
                self.ends.setdefault(node, []).append(means)

    def found(self, words: list[str]) -> list[int]:
        """What the phrases in ``words`` stand for, each once, in order of first place and length."""
        out: dict[int, None] = {}
        for start in range(len(words)):
            node = 0
            for word in words[start:]:
                node = self.steps.get((node, word), 0)
                if not node:
                    break
                out |= dict.fromkeys(self.ends.get(node, ()))
        return list(out)


def lookup(spark: SparkSession, phrases: list[tuple[tuple[str, ...], dict]], kind: str, arrow: pa.DataType, most: int = MOST_BYTES) -> Callable[[Column], Column]:
    """A function of a column of words: array of what the phrases (words, value) in it stand for; values are of the Spark
    type ``kind`` and the Arrow type ``arrow``. The trie is broadcast, and its size checked before; the plan names it once,
    so it does not grow with the phrases."""
    held = (WordTrie((words, k) for k, (words, _) in enumerate(phrases)), [value for _, value in phrases])
    size = len(pickle.dumps(held))
    if size > most:
        raise ValueError(f"a trie of {size} bytes; {most} are sent at most")
    shared = spark.sparkContext.broadcast(held)

    @F.arrow_udf(f"array<{kind}>")
    def found(texts: pa.Array) -> pa.Array:
        trie, values = shared.value
        return pa.array([None if words is None else [values[k] for k in trie.found(words)] for words in texts.to_pylist()], pa.list_(arrow))

    return found
