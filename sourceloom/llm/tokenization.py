"""Encoding with a public byte-level BPE tokenizer as a token automaton.

The merge list is compiled into a deterministic automaton over tokens. It
starts with one state and a loop for each byte, and each merge ``a b -> c`` in
turn adds its gadget:

* the state behind ``a`` is copied and loses its edge ``b``;
* every state that has an edge ``a`` gets an edge ``c`` to where ``a b`` led.

After all merges the automaton accepts, for every byte string, exactly one
token sequence, the one that BPE yields. The state behind a token depends on
the token alone, so that the gadgets need not be stored as 50k x 50k edges:
each is kept as (left, right, time), and whether a state has an edge follows by
walking the gadgets back in time. Answers are kept in a transition table.

Words are encoded by walking a byte trie of the tokens from every position and
taking the arcs that the automaton has; each position is reached by one arc
only. The labels of the arcs of the path are the ids; decoding emits the bytes
of the labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sourceloom.session import spread

#: Where the public vocabulary files are, unless a path is given.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the published split pattern of this byte-level tokenizer.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries kept per worker; a full table is emptied, which changes no result.
WORDS_KEPT, EDGES_KEPT = 200_000, 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TokenAutomaton:
    """The compiled merges of one tokenizer."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)["model"]
        to_byte = byte_alphabet()
        special = {t["content"] for t in json.loads(raw).get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {
            i: bytes(to_byte[c] for c in text) for text, i in model["vocab"].items() if text not in special
        }
        id_of = {b: i for i, b in self.bytes_of.items()}
        size = max(self.bytes_of) + 1
        self.left, self.right, self.created = [-1] * size, [-1] * size, [-1] * size
        self.removed: dict[int, int] = {}
        for time, pair in enumerate(model["merges"]):
            a, b = (id_of[bytes(to_byte[c] for c in part)] for part in (pair.split(" ") if isinstance(pair, str) else pair))
            c = id_of[self.bytes_of[a] + self.bytes_of[b]]
            if self.created[c] >= 0:
                raise ValueError("two merges make the same token")
            self.left[c], self.right[c], self.created[c] = a, b, time
            self.removed[a << 20 | b] = time
        self.arcs: dict[int, int] = {}
        self.accepts: list[int] = [-1]
        for i, text in self.bytes_of.items():
            node = 0
            for byte in text:
                nxt = self.arcs.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.arcs[node << 8 | byte] = len(self.accepts)
                    self.accepts.append(-1)
                node = nxt
            self.accepts[node] = i
        self.split = regex.compile(SPLIT_PATTERN)
        self.edges: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}

    def has_edge(self, x: int, y: int) -> bool:
        """Whether the state behind token x has an edge y after all merges."""
        until = len(self.left) + 1
        removed, created, left, right = self.removed, self.created, self.left, self.right
        while True:
            gone = removed.get(x << 20 | y)
            if gone is not None and gone < until:
                return False
            kx, ky = created[x], created[y]
            if kx < 0 and ky < 0:
                return True
            if ky > kx:  # the edge y came with y's gadget, where the edge to its left part was
                until, y = min(until, ky + 1), left[y]
            else:  # the state behind x began as the one behind its right part
                until, x = min(until, kx), right[x]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word, by transitions from each position."""
        n, arcs, accepts, edges = len(word), self.arcs, self.accepts, self.edges
        into = [-1] * (n + 1)
        for i in range(n):
            before, node, j = into[i], 0, i
            while j < n:
                node = arcs.get(node << 8 | word[j])
                if node is None:
                    break
                j += 1
                token = accepts[node]
                if token < 0 or into[j] >= 0:
                    continue
                if i:
                    edge = before << 20 | token
                    ok = edges.get(edge)
                    if ok is None:
                        if len(edges) >= EDGES_KEPT:
                            edges.clear()
                        ok = edges[edge] = self.has_edge(before, token)
                    if not ok:
                        continue
                into[j] = token
        out, j = [], n
        while j:
            out.append(into[j])
            j -= len(self.bytes_of[into[j]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one."""
        out: list[int] = []
        words = self.words
        for word in self.split.findall(text or ""):
            ids = words.get(word)
            if ids is None:
                ids = self.encode_word(word.encode())
                if len(word) <= 64:
                    if len(words) >= WORDS_KEPT:
                        words.clear()
                    words[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_COMPILED: dict[bytes, TokenAutomaton] = {}


def automaton(raw: bytes) -> TokenAutomaton:
    """The automaton of a vocabulary file, compiled once in a worker."""
    key = raw[:64] + raw[-64:] + str(len(raw)).encode()
    if key not in _COMPILED:
        _COMPILED[key] = TokenAutomaton(raw)
    return _COMPILED[key]


def shipped(spark: SparkSession, tokenizer: str):
    """The vocabulary file as a broadcast of its own fixed size (some 2 MB), so
    that executors need no access to its path."""
    return spark.sparkContext.broadcast(Path(tokenizer).read_bytes())


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """One row per input row: its id and ``ids``, the token ids of its text.

    Null and empty texts give an empty list. Names of special tokens are
    ordinary text. A null id stays null, repeated rows stay repeated, other
    columns are ignored, an empty table gives an empty table. Long texts are
    encoded whole; time is linear in their length.
    """
    vocabulary = shipped(df.sparkSession, tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocabulary.value)
        for batch in batches:
            lists = [auto.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"]
            )

    source = spread(df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """One row per input row: its id and ``n_tokens``; 0 for null and empty
    texts. Only the counts leave the workers."""
    vocabulary = shipped(df.sparkSession, tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocabulary.value)
        for batch in batches:
            sizes = [len(auto.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "n_tokens"])

    source = spread(df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)
