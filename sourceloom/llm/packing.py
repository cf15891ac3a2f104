"""Filling context windows with whole documents.

Best-two-fit: a window is filled greedily with the largest documents that fit;
then its smallest document is taken out and replaced by two unpacked documents
that fit the widened gap more tightly, as long as that helps. Documents are
dealt into shards of bounded size by a hash, and each shard is packed by
itself; a shard wastes at most its last windows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.tokenization import DEFAULT_TOKENIZER, token_counts
from sourceloom.session import durable

#: Tokens of a window, and documents that a shard has on average.
CAPACITY, SHARD_DOCS = 2048, 20_000


class _Sizes:
    """Unpacked items by size: counts, and the sizes present in order."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.present = sorted(self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.present[bisect_right(self.present, size) - 1]

    def put_back(self, size: int) -> None:
        if not self.count.get(size):
            insort(self.present, size)
        self.count[size] = self.count.get(size, 0) + 1

    def largest(self, limit: int) -> int:
        """The largest size up to a limit, or 0."""
        k = bisect_right(self.present, limit)
        return self.present[k - 1] if k else 0

    def best_two(self, limit: int, above: int) -> tuple[int, int] | None:
        """Two unpacked sizes with the largest sum up to a limit, if it is
        above another; by two pointers over the sizes present."""
        present = self.present
        lo, hi = 0, bisect_right(present, limit - 1) - 1
        best, pair = above, None
        while lo <= hi:
            total = present[lo] + present[hi]
            if total > limit:
                hi -= 1
                continue
            if total > best and (lo != hi or self.count[present[lo]] > 1):
                best, pair = total, (present[lo], present[hi])
                if best == limit:
                    break
            lo += 1
        return pair


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of sizes; every size from 1 to the capacity is used."""
    left = _Sizes(sizes)
    windows = []
    while left.present:
        window, gap = [], capacity
        while size := left.largest(gap):
            left.take(size)
            window.append(size)
            gap -= size
        while gap and len(window) > 0:
            smallest = window[-1]
            pair = left.best_two(gap + smallest, smallest)
            if pair is None:
                break
            window.pop()
            for size in pair:
                left.take(size)
            left.put_back(smallest)
            window.extend(pair)
            window.sort(reverse=True)
            gap += smallest - sum(pair)
        windows.append(window)
    return windows


def fill_windows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    tokenizer: str = DEFAULT_TOKENIZER, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """The window of each document, or of each piece of one that exceeds the
    capacity: id, ``piece_no`` (from 1), ``start_token`` and ``n_tokens`` of
    the piece in its document, and ``window_id``.

    Whole documents are never split; longer ones give full pieces, each a
    window of its own, and a rest that is packed like a document. Null, empty
    and other texts without tokens get the first window of their shard. Each
    row is an item of its own, equal ones too; other columns are ignored; an
    empty table gives an empty result. Window ids are the shard times 2^32 plus
    a number, and come out equal in every run on equal rows.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    sizes = durable(token_counts(df, id_col, text_col, tokenizer).withColumnRenamed(id_col, "id"))
    kind = sizes.schema["id"].dataType.simpleString()
    shards = max(1, ceil(sizes.count() / shard_docs))
    dealt = sizes.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "n_tokens"], kind="stable")
        shard = int(pdf["shard"].iloc[0])
        rows, rest, number, empty = [], {}, 0, []
        for item, n in zip(pdf["id"].tolist(), pdf["n_tokens"].tolist()):
            pieces = n // capacity
            for k in range(pieces):
                rows.append([item, k + 1, k * capacity, capacity, number])
                number += 1
            tail = n - pieces * capacity
            if tail:
                rest.setdefault(tail, []).append((item, pieces + 1, pieces * capacity))
            elif not n:
                empty.append(item)
        for window in best_two_fit([s for s, items in rest.items() for _ in items], capacity):
            for size in window:
                item, piece, start = rest[size].pop()
                rows.append([item, piece, start, size, number])
            number += 1
        rows += [[item, 1, 0, 0, 0] for item in empty]
        out = pd.DataFrame(rows, columns=["id", "piece_no", "start_token", "n_tokens", "window_id"])
        out["window_id"] += shard << 32
        return out

    packed = dealt.groupBy("shard").applyInPandas(pack, f"id {kind}, piece_no int, start_token bigint, n_tokens int, window_id bigint")
    return packed.withColumnRenamed("id", id_col)
