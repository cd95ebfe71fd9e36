"""Best-two-fit packing of token pieces into fixed-length sequences.

A document's pieces differ only in their lengths, at most ``budget`` of them, so the
plan is made over the histogram of lengths, whose size does not depend on the corpus.
A bin takes the largest unpacked length, is filled greedily with the largest that
fits, and then its smallest piece is replaced with two unpacked ones as long as two fit
the expanded gap more tightly. The same bin is repeated while its lengths last, which
gives a short list of bins with multiplicities.

Pieces are numbered within their length by salted windows (a length that a third of
all pieces share is spread over the salts) and find their place in the plan by binary
search. Full pieces are sequences by themselves.

Defined cases: a null text is empty; an empty text is the end id alone, one piece of
length one; very long texts are cut into as many pieces as they fill; repeated rows are
separate documents and may share doc_id and piece; a row with a null id is packed like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, give_back, materialize, slices

BUDGET = 2048
END_ID = 0
#: Salts of a length: at least, and at most; in between one for each so many pieces.
SALTS, MOST_SALTS, SALT_PIECES = 64, 1024, 1_000_000


class Encoder:
    """Ids of the byte-level BPE in a tokenizers file.

    Ordinary text goes through the same vocabulary's ranks (several times as fast,
    with equal ids); a text that holds the string of a special token goes through the
    tokenizers file itself.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        self.path, self.whole, self.ranks = path, None, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks is None or any(s in text for s in self.special):
            if self.whole is None:  # tens of MB that most tasks never need
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def default_encoder() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def cut(ids: np.ndarray, budget: int = BUDGET) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the budget."""
    first = len(ids) % budget or budget
    return [(0, first), *((s, budget) for s in range(first, len(ids), budget))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", encoder: tuple | None = None, budget: int = BUDGET) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    encoder = encoder or default_encoder()

    def run(batches):
        encode = Encoder(*encoder)
        end = np.array([END_ID], "<u4")
        for batch in slices(batches):
            rows = []
            for at, t in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([encode(t), end]) if t else end
                rows += [(at, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(ids, budget))]
            at, piece, *more = zip(*rows, strict=True) if rows else [()] * 5
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in more)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        del encode
        give_back()

    slim = docs.select(column(id_col).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], budget: int = BUDGET) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how often it is made) for a histogram of lengths."""
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left)
    bins = []

    def largest(limit: int, need: dict[int, int]) -> int:
        i = bisect_right(sizes, limit) - 1
        while i >= 0 and left[sizes[i]] <= need.get(sizes[i], 0):
            i -= 1
        return sizes[i] if i >= 0 else 0

    def best_two(limit: int, need: dict[int, int]) -> tuple[int, int, int]:
        best = (0, 0, 0)
        i = bisect_right(sizes, limit - 1) - 1
        while i >= 0 and 2 * sizes[i] > best[0]:
            a = sizes[i]
            if left[a] > need.get(a, 0):
                need[a] = need.get(a, 0) + 1
                b = largest(min(a, limit - a), need)
                need[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == limit:
                        break
            i -= 1
        return best

    while sizes:
        need: dict[int, int] = {}
        gap, content = budget, []
        while gap and (n := largest(gap, need)):
            content.append(n)
            need[n] = need.get(n, 0) + 1
            gap -= n
        while gap:
            small = min(content)
            total, a, b = best_two(gap + small, need)
            if total <= small:
                break
            content.remove(small)
            need[small] -= 1
            content += [a, b]
            for n in (a, b):
                need[n] = need.get(n, 0) + 1
            gap += small - total
        times = min(left[n] // k for n, k in need.items() if k)
        bins.append((sorted(content, reverse=True), times))
        for n, k in need.items():
            left[n] -= k * times
            if k and not left[n]:
                del sizes[bisect_right(sizes, n) - 1]
    return bins


def _slots(bins: list[tuple[list[int], int]], shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Runs of ranks: (length << shift) + first rank, first bin, offset; and the number of bins."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for content, times in bins:
        at = 0
        for n in content:
            rank = used.get(n, 0)
            rows.append(((n << shift) + rank, first, at))
            used[n] = rank + times
            at += n
        first += times
    keys, firsts, offsets = (np.array(x, np.int64) for x in (zip(*sorted(rows), strict=True) if rows else ((), (), ())))
    return keys, firsts, offsets, first


def pack(items: DataFrame, budget: int = BUDGET, salts: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to written rows with doc_id, piece, length and ids_crc32."""
    shift = 44
    salts = salts or min(MOST_SALTS, max(SALTS, items.count() // SALT_PIECES))
    salted = items.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    short = salted.where(F.col("length") < budget)
    cells = short.groupBy("length", "__salt").agg(F.count("*").alias("n")).collect()  # at most budget x MOST_SALTS rows
    counts = np.zeros((budget, salts), np.int64)
    for length, salt, n in cells:
        counts[length, salt] = n
    bins = plan({n: int(c) for n, c in enumerate(counts.sum(1)) if c}, budget)
    keys, firsts, offsets, total = _slots(bins, shift)
    before = np.cumsum(counts, axis=1) - counts

    names = items.columns
    order = [c for c in ("doc_id", "ids_crc32", "piece", "start") if c in names]
    ranked = short.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)))

    def place(batches):
        for batch in batches:
            length, salt, row = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__salt", "__rank"))
            want = (length << shift) + before[length, salt] + row - 1
            run = np.searchsorted(keys, want, side="right") - 1
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(firsts[run] + want - keys[run]), pa.array(offsets[run])], [*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*items.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    full = items.where(F.col("length") == budget).withColumn("sequence_id", F.lit(total) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return ranked.mapInArrow(place, schema).unionByName(full)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", encoder: tuple | None = None, budget: int = BUDGET) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece."""
    return pack(materialize(pieces(docs, id_col, text, encoder, budget), "packing-pieces"), budget)
