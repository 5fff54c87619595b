"""Best-fit packing of tokenised documents by hierarchical residual rounds.

A document longer than a sequence is cut into full pieces and a rest; nothing
else is cut.  Pieces are then packed in rounds.  In each round every partition
packs its items best-fit in falling order of size, bins that are full to
within ``slack`` tokens are final, and so are those that not even the smallest
bin left anywhere would fit.  The others become the items of the next round,
which deals them anew to a ``fan_in``-th of the partitions, but never more than
``max_items`` to one.  Rounds go on until no bin is left; what one partition
held whole is final, and a round that merges nothing at its full width ends
them.  Best fit leaves at most one bin a partition that is half full or less,
so the smallest bins are soon gone, and then no two bins fit together.

An item carries the pieces it holds (at most ``capacity`` of them), so a round
moves only small rows and no text.  Rounds are written to the shared folder.

Defined results: null text counts as empty; a text without tokens has no
piece; repeated rows are packed each; pieces of a row with a null id carry the
null; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.bpe import PieceEncoder
from lexigrain.llm.common import id_text, materialise

_SPACES = str.maketrans("\n\t\r", "   ")
# In texts of these characters the pre-tokens are known; all others are cut at ASCII white space only.
_LETTER = "a-z\u00df-\u00f6\u00f8-\u00ff"
_SIGN = r"!-&(-/:-@\[-`{-~"
_SIMPLE = re.compile(f"[{_LETTER}0-9{_SIGN} \t\n\r]*")
_WORDS = re.compile(f"[{_LETTER}]+|[0-9]|[{_SIGN}]+")
_PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
_ITEM = f"size int, pieces array<{_PIECE}>"
_ENCODERS: dict[tuple, PieceEncoder] = {}


def split_words(text: str, added: list[str]) -> list[str]:
    """Pieces that a tokenizer which lowers case and drops white space encodes on their own."""
    low = text.lower()
    if _SIMPLE.fullmatch(low) and not any(t in low for t in added):
        return _WORDS.findall(low)
    return text.translate(_SPACES).split(" ")


def tokenise(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_words: int = 600_000,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row per piece.

    For tokenizers that lower case and drop white space: words are encoded on
    their own and kept in a bounded store.
    """
    key = (tokenizer_path, max_words)

    def run(batches):
        if key not in _ENCODERS:
            _ENCODERS[key] = PieceEncoder(*key, plain=_WORDS)
        enc, end = _ENCODERS[key], np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            words = [split_words(t, enc.added) for t in b.column(1).to_pylist()]
            enc.learn(words)
            for doc_id, own in zip(b.column(0).to_pylist(), words, strict=True):
                ids = enc.ids(own) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: falling sizes, each into the fullest bin that takes it."""
    open_bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms: list[int] = []  # rooms that some bin has, in order
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        k = bisect_left(rooms, s)
        if k == len(rooms):
            held, left = [i], capacity - s
            bins.append(held)
        else:
            room = rooms[k]
            held = open_bins[room].pop()
            if not open_bins[room]:
                del rooms[k]
            held.append(i)
            left = room - s
        if left > 0:
            if not open_bins[left]:
                insort(rooms, left)
            open_bins[left].append(held)
    return bins


def _pack_partition(capacity: int, final_from: int, round_no: int):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        sizes = t.column("size").to_pylist()
        bins = best_fit(sizes, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(sizes))
        lists = pa.concat_arrays(t.column("pieces").take(pa.array(order)).chunks)
        counts = lists.value_lengths().to_numpy()
        held = np.cumsum([0, *map(len, bins)])
        offsets = np.concatenate(([0], np.cumsum(counts)))[held]
        merged = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists.flatten())
        fills = np.array([sum(sizes[i] for i in b) for b in bins], np.int32)
        first = (round_no << 56) + (TaskContext.get().partitionId() << 32)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(fills),
                merged,
                pa.array(fills >= final_from),
                pa.array(np.arange(len(bins), dtype=np.int64) + first),
            ],
            names=["size", "pieces", "final", "sequence_id"],
        )
        for at in range(0, out.num_rows, 5000):
            yield out.slice(at, 5000)

    return run


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    slack: int = 8,
    fan_in: int = 8,
    first_items: int = 40_000,
    max_items: int = 400_000,
) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``tokenise``.

    ``pieces`` is read more than once, so it should be a stored table.
    """
    items = pieces.select(
        F.col("length").cast("int").alias("size"),
        F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("pieces"),
    )
    nearly = F.col("size") >= capacity - slack
    done = [items.where(nearly).select("pieces", F.monotonically_increasing_id().alias("sequence_id"))]
    done = [materialise(done[0], "packing-full")]
    rest = items.where(~nearly)
    n = rest.count()
    width, round_no = max(1, -(-n // first_items)), 1
    while n:
        least, last = max(1, -(-n // max_items)), width == 1
        held = lambda c: F.transform("pieces", lambda p: p[c])
        packed = rest.repartition(width, F.xxhash64(F.lit(round_no), held("doc_id"), held("piece"))).mapInArrow(
            _pack_partition(capacity, 0 if last else capacity - slack, round_no),
            f"{_ITEM}, final boolean, sequence_id bigint",
        )
        packed = materialise(packed, f"packing-{round_no}")
        left = packed.where("not final")
        bins, smallest = packed.agg(F.count("*"), F.min(F.when(~F.col("final"), F.col("size")))).first()
        room = 0 if smallest is None or (bins == n and width <= least) else capacity - smallest
        done.append(packed.where(F.col("final") | (F.col("size") > room)).select("pieces", "sequence_id"))
        rest = left.where(F.col("size") <= room).select("size", "pieces")
        n = rest.count() if room else 0
        width, round_no = max(1, -(-n // max_items), width // fan_in), round_no + 1
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    lengths = F.slice("pieces", F.lit(1), F.col("k"))
    return bins.select("sequence_id", "pieces", F.posexplode("pieces").alias("k", "p")).select(
        "p.*",
        "sequence_id",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("offset"),
    )


def tokenise_and_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, **kw) -> DataFrame:
    """All pieces of ``docs`` with their places; tokenised once."""
    return pack(materialise(tokenise(docs, tokenizer_path, capacity, **kw), "packing-pieces"), capacity)
