"""Cost-balanced packing of documents into fixed-length training sequences.

A document is its token ids and a closing id 0, cut into whole sequences and a rest. The rests of a block
of documents are placed by estimated attention cost a * n + b * n^2, dearest first, each on the sequence of
lowest cost that still has room; where none has, the rest is cut to fill the emptiest ones. A block of rests
with T tokens makes ceil(T / seq) sequences; the last of a partition is split at powers of two, to which
length buckets pad nothing, so hardly any padding is left.

Plan: no shuffle. A task streams its partition, tokenizes and packs block by block, so its memory is one
block. Sequence ids are (partition << 40) + a counter: unique, and the same when a lost task runs again.

Tokenizing: the vocabulary's merges, read from the tokenizer's own file, are the ranks of a byte-level BPE
encoder that keeps no words from text to text; it gives the same ids (the tests hold it to the tokenizer,
every code point included). Texts with one of the vocabulary's special strings go to the tokenizer itself.

Cases: null and empty texts are one id 0; repeated rows are documents of their own; an empty table or
partition gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.common import batches, frugal, only, read

SEQ, BLOCK, LINEAR, QUADRATIC = 1024, 1 << 20, 1.0, 1.0 / 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the pre-tokenizer's pattern, without ways back into what has matched.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others
    in order from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Token ids of whole texts, as little-endian 32-bit integers."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            known, byte = json.load(f)["model"]["vocab"], byte_of()
        ranks = {bytes(byte[c] for c in x): i for x, i in known.items() if x not in self.special}
        self.fast = tiktoken.Encoding("millrace", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """By the tokenizer itself."""
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@functools.lru_cache(maxsize=1)
def ids_by(path: str) -> Ids:
    """One for all tasks of a worker: the vocabulary and nothing else."""
    return Ids(path)


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def place(rests: list[int], seq: int = SEQ) -> Iterator[tuple[int, int, int, int, int]]:
    """(index of the rest, its start, length, sequence, offset) for rests shorter than seq."""
    count = -(-sum(rests) // seq)
    used, dear = np.zeros(count, np.int64), np.zeros(count)
    aside: list[tuple[int, int]] = []
    for i in sorted(range(len(rests)), key=lambda i: (-rests[i], i)):
        n = rests[i]
        open_ = np.where(used <= seq - n, dear, np.inf)
        k = int(open_.argmin())
        if open_[k] < np.inf:
            yield i, 0, n, k, int(used[k])
            used[k] += n
            dear[k] += cost(n)
        else:
            aside.append((i, n))
    used = used.tolist()
    room = iter([k for k in range(count) if used[k] < seq])
    k = next(room, 0)
    for i, n in aside:
        start = 0
        while start < n:
            if used[k] == seq:
                k = next(room)
            m = min(n - start, seq - used[k])
            yield i, start, m, k, used[k]
            used[k] += m
            start += m


def carve(rests: list, tokens: int) -> tuple[list, list]:
    """(what stays, what goes): the shortest rests, the last of them cut, so that ``tokens`` go."""
    stay, go = sorted(rests, key=lambda x: x[3] - x[2], reverse=True), []
    while tokens:
        d, ids, a, b = stay.pop()
        if b - a > tokens:
            stay.append((d, ids, a, b - tokens))
            a = b - tokens
        go.append((d, ids, a, b))
        tokens -= b - a
    return stay, go


def pack(docs: DataFrame, tokenizer: str | None = None, seq: int = SEQ, block: int = BLOCK) -> DataFrame:
    """One row a piece of documents with columns doc_id and text; see the module for the columns."""
    tokenizer = tokenizer or default_tokenizer()

    def run(source):
        ids_of, made, rows, rests, held = ids_by(tokenizer), TaskContext.get().partitionId() << 40, [], [], 0

        def add(d, ids, a, b, k, offset):
            rows.append((d, a, b - a, zlib.crc32(ids[a * 4 : b * 4]), len(ids) // 4, made + k, offset))

        def fill():
            nonlocal rests, made
            stay, rests = carve(rests, sum(b - a for _, _, a, b in rests) % seq)
            for i, start, n, k, offset in place([b - a for _, _, a, b in stay], seq):
                d, ids, a, _ = stay[i]
                add(d, ids, a + start, a + start + n, k, offset)
            made += sum(b - a for _, _, a, b in stay) // seq

        def end():
            nonlocal made
            left, room, used = sum(b - a for _, _, a, b in rests), 0, 0
            for d, ids, a, b in rests:
                while a < b:
                    if used == room:
                        made, room, used = made + (room > 0), 1 << (left.bit_length() - 1), 0
                        left -= room
                    n = min(b - a, room - used)
                    add(d, ids, a, a + n, 0, used)
                    a, used = a + n, used + n

        for batch in batches(source, 128):
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                for a in range(0, n - seq + 1, seq):
                    add(d, ids, a, a + seq, 0, 0)
                    made += 1
                if n % seq:
                    rests.append((d, ids, n - n % seq, n))
                    held += n % seq
                if held >= block:
                    fill()
                    held = sum(b - a for _, _, a, b in rests)
            if len(rows) >= 10_000:
                yield table(rows)
                rows.clear()
        fill()
        end()
        yield table(rows)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), SCHEMA)


def table(rows: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def query(spark, sf_dir):
    return pack(only(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
