"""Packing token streams into sequences by order-preserving dynamic programming.

Each task lays the token ids of its documents end to end and cuts the stream into windows of at most SIZE tokens. Cuts
may stand at document ends (free), at sentence ends (a small penalty) and elsewhere (a larger one). A window of length
n costs SIZE - n for padding, or nothing if n is a power of two. With p the place and f the cost of the best packing
that ends at a cut,

    f(j) = penalty(j) + ONE + min( SIZE - p(j) + min { f(i) + p(i) : p(j) - p(i) <= SIZE },  min { f(i) : p(j) - p(i) a power of two } ),

whose first minimum runs over a sliding window and is kept in a monotone queue. The stream is solved in blocks; the last
windows of a block are solved again with the next, so memory is bounded by BLOCK tokens and the longest document.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_of

SIZE, END = 2048, 1
SENTENCE, ELSEWHERE, ONE = 2, 24, 16
#: Tokens between cuts elsewhere; tokens in a block.
STEP, BLOCK = 64, 1 << 19

# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of white space on which tiktoken's matching by backtracking may exhaust its stack.
_LONG_SPACE = re.compile(r"\s{1000}")


class Encoder:
    """The ids that ``tokenizers`` gives for a byte-level BPE file, without added special tokens.

    The same vocabulary and merges run in tiktoken, which is some four times as fast; a text that holds a special
    token's string or a long run of white space goes to ``tokenizers`` itself.
    """

    def __init__(self, file: str | None):
        import tiktoken

        if file is None:
            import public_tokenizers

            file = public_tokenizers.path("byte_bpe_50k.json")
        self.file, self.slow = file, None  # loaded when first needed
        with open(file, encoding="utf-8") as f:
            whole = json.load(f)
        special = {t["content"] for t in whole.get("added_tokens", [])}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in whole["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = sorted(special)
        stops = {i for t, i in ranks.items() if t.rstrip(b" ") and t.rstrip(b" ")[-1:] in b".!?\n"}
        self.stops = np.zeros(max(ranks.values()) + 2 + len(special), dtype=bool)
        self.stops[list(stops)] = True

    def ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special) and not _LONG_SPACE.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.file)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cuts(ends: np.ndarray, stops: np.ndarray, n: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows may end, and their penalties. ends: places after documents; stops: places after sentences; n: the stream's length; last: no more documents come."""
    penalty = np.full(n + 1, -1, dtype=np.int32)
    penalty[STEP::STEP] = ELSEWHERE
    if last:  # the shard's last windows may be cut to powers of two
        penalty[max(1, n - 2 * SIZE) :] = ELSEWHERE
    penalty[stops] = SENTENCE
    penalty[ends] = 0
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def pack(places: np.ndarray, penalties: np.ndarray) -> list[int]:
    """The cuts of the best packing of 0 .. places[-1]; ``places`` rise, no two neighbours (nor 0 and the first) are over SIZE apart."""
    p = np.concatenate([[0], places])
    pairs: dict[int, list[int]] = {}
    for k in range(SIZE.bit_length() - 1):  # windows of 2^k tokens
        at = np.searchsorted(p, p - (1 << k))
        for j in np.flatnonzero(p[at] == p - (1 << k)).tolist():
            pairs.setdefault(j, []).append(int(at[j]))
    p, cost = p.tolist(), [0, *penalties.tolist()]
    f, back = [0] * len(p), [0] * len(p)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f + p, i): rising in both
    for j in range(1, len(p)):
        here = p[j]
        while here - p[queue[0][1]] > SIZE:
            queue.popleft()
        best, i = queue[0]
        best += SIZE - here
        for other in pairs.get(j, ()):
            if f[other] < best:
                best, i = f[other], other
        f[j], back[j] = best + cost[j] + ONE, i
        key = f[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(p) - 1
    while j:
        out.append(p[j])
        j = back[j]
    return out[::-1]


class Shard:
    """The documents of one task, packed block by block."""

    def __init__(self, first: int):
        self.next, self.docs, self.tokens = first, [], 0  # docs: [id, ids, stops, tokens already placed]

    def add(self, doc_id: object, ids: np.ndarray, stops: np.ndarray) -> None:
        self.docs.append([doc_id, ids, stops, 0])
        self.tokens += len(ids)

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pieces of all windows, or, unless ``last``, of those that the next documents can hardly change."""
        if not self.docs:
            return
        lengths = np.array([len(ids) - done for _, ids, _, done in self.docs])
        ends = np.cumsum(lengths)
        stops = np.concatenate([s[s > done] - done + e - n for (_, _, s, done), e, n in zip(self.docs, ends, lengths, strict=True)]).astype(np.int64)
        windows = pack(*cuts(ends, stops, int(ends[-1]), last))
        if not last:
            windows = windows[:-3]
        k = 0
        for first, b in zip([0, *windows], windows, strict=False):
            a = first
            while a < b:
                doc_id, ids, _, done = doc = self.docs[k]
                n = min(b, int(ends[k])) - a
                yield doc_id, done, n, zlib.crc32(ids[done : done + n].astype("<u4").tobytes()), len(ids), self.next, a - first
                doc[3] += n
                a += n
                if doc[3] == len(ids):
                    k += 1
            self.next += 1
        self.docs = self.docs[k:]
        self.tokens = sum(len(ids) - done for _, ids, _, done in self.docs)


def packing(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and gives the end token alone. Nothing is dropped: each id of each row, repeated rows too, is
    in one piece. Sequences hold documents in the order of the input's partitions and never span two partitions;
    ``sequence_id`` is the partition's number in the high bits. ``tokenizer`` is a path that executors can open, None
    for the public byte-level file. Extra columns are ignored; an empty table gives no rows. There is no shuffle: a lost
    task is simply run again.
    """
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, id_type = Encoder(tokenizer), Shard(TaskContext.get().partitionId() << 40), None

        def made(last: bool) -> Iterator[pa.RecordBatch]:
            pieces = list(shard.flush(last))
            if pieces:
                columns = list(zip(*pieces, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=id_type), *(pa.array(c, type=pa.int64()) for c in columns[1:])], names)

        for batch in (part for whole in batches for part in slices(whole)):
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text)
                stops = np.flatnonzero(encoder.stops[ids]) + 1
                shard.add(doc_id, np.append(ids, np.uint32(END)), stops)
                if shard.tokens >= BLOCK:
                    yield from made(False)
        yield from made(True)

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:])).withColumnRenamed("id", id_col)
