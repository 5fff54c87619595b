"""BPE encoding and decoding by reuse of content-defined chunks.

Texts are cut where a gear rolling hash of the last 16 bytes says so, which
gives the same chunks wherever the same passage stands.  A chunk is encoded
whole, as if it were a text, once per executor process; later documents with
that chunk take its pieces and ids from a store keyed by 128-bit digest.  What
stands next to a cut may be wrong, since a word, a run of white space or an
added token may straddle it.  So every join is repaired: the last pieces of the
chunk before it and the first of the chunk behind it are encoded again as one
text, and the outermost of these pieces must come out as they were in their
chunks, and so with the same ids.  Where they do not, more pieces are taken in on that
side, twice as many each time, until both sides agree or the text ends; a chunk
that is used up by this joins the next one.  The ids between the agreed pieces
are then replaced.

A window starts with four pieces a side, and two of each side must agree.  Where
a piece ends is decided by what precedes it, at most two characters behind it,
and added tokens; so two unchanged pieces show that nothing before or behind
them looks across the join.

Both stores are bounded, so memory does not follow the corpus: the older half
goes when a store is full, and a chunk met again is encoded again, with the
same result.  The store is per process because sending chunk texts and ids
through a shuffle moves more bytes than the documents have.

Defined results: null text counts as empty and has no ids; rows are kept
one for one, repeated ones as well; an empty table gives an empty one; other
columns are ignored.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import gear_hashes, id_text, trimmed

_JOIN = re.compile(r"(?<=\S)(?= \S)")  # the safe points
# In texts of these characters without double white space the pre-tokens are known; all others are cut at safe points only.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SIGN = r"!-&(-/:-@\[-`{-~"
_SIMPLE = re.compile(f"[{_LETTER}0-9{_SIGN} \n]*")
_DOUBLE = re.compile(r"[ \n][ \n]|[ \n]\Z")
_PIECES = _PLAIN = re.compile(f" ?[{_LETTER}]+| ?[0-9]+| ?[{_SIGN}]+|\n")


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the 256 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_core(tok):
    """The vocabulary of ``tok`` for single pre-tokens, and the mark that ends them.

    Merging by the ids of whole tokens gives what merging by pairs gives, as
    long as each token encodes to itself: while a span is cut off from its
    surroundings, only one order of merges is possible within it.  In
    vocabularies with word ends, byte 0xFF, which no text holds, is the end.
    """
    import tiktoken

    letters, suffix = byte_letters(), tok.model.end_of_word_suffix or ""
    added = {t.content for t in tok.get_added_tokens_decoder().values()}
    ranks = {}
    for token, i in tok.get_vocab(with_added_tokens=True).items():
        if token not in added:
            end = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if end else token
            ranks[bytes(letters[c] for c in body) + b"\xff" * end] = i
    core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core, b"\xff" if suffix else b""


class PieceEncoder:
    """Ids (little-endian unsigned 32-bit) of pieces that encode on their own.

    ``plain`` matches the pieces that are a pre-token as they stand; all others
    go through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int, plain: re.Pattern = _PLAIN):
        self.tok, self.limit, self.plain, self.store = load_tokenizer(path), limit, plain, {"": b""}
        self.core, self.end = merge_core(self.tok)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def learn(self, lists: list[list[str]]) -> None:
        """Encodes what is new in the lists; older entries may go."""
        self.store = trimmed(self.store, self.limit)
        store, single, plain, end, rest = self.store, self.core.encode_single_piece, self.plain.fullmatch, self.end, []
        for p in set().union(*lists).difference(store):
            if plain(p):
                store[p] = array("I", single(p.encode() + end)).tobytes()
            else:
                rest.append(p)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for p, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                store[p] = array("I", e.ids).tobytes()

    def ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.store.__getitem__, pieces))

    def split(self, text: str) -> list[str]:
        """The pieces of a text that is encoded on its own."""
        if _SIMPLE.fullmatch(text) and not _DOUBLE.search(text) and not any(t in text for t in self.added):
            return _PIECES.findall(text)
        return _JOIN.split(text)


class Chunk:
    """A chunk encoded as a text of its own: where its pieces and their ids begin."""

    __slots__ = ("text", "pieces", "starts", "ids", "at")

    def __init__(self, text: str, pieces: list[str]):
        self.text, self.pieces, self.starts, self.ids, self.at = text, pieces, None, b"", None

    def encoded(self, ids: list[bytes]) -> None:
        """Takes the ids; pieces are kept as places in the text only."""
        self.starts = np.cumsum([0, *map(len, self.pieces)], dtype=np.int32)
        self.ids, self.at = b"".join(ids), np.cumsum([0, *map(len, ids)], dtype=np.int32)
        self.pieces = None

    def __len__(self) -> int:
        return len(self.pieces if self.starts is None else self.starts) - (self.starts is not None)

    def span(self, lo: int, hi: int) -> list[str]:
        if self.starts is None:
            return self.pieces[lo:hi]
        at = self.starts[lo : hi + 1].tolist()
        return [self.text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class Part:
    """A chunk's place in a text: those of its pieces that no join has replaced."""

    __slots__ = ("chunk", "lo", "hi")

    def __init__(self, chunk: Chunk, lo: int, hi: int):
        self.chunk, self.lo, self.hi = chunk, lo, hi


def last_pieces(parts: list[Part | list[str]], n: int) -> list[str]:
    """The last n pieces of a text so far, or all."""
    found: list[str] = []
    for p in reversed(parts):
        need = n - len(found)
        if need <= 0:
            break
        found = (p[-need:] if isinstance(p, list) else p.chunk.span(max(p.lo, p.hi - need), p.hi)) + found
    return found


def drop_last(parts: list[Part | list[str]], n: int) -> None:
    while n:
        p = parts[-1]
        size = len(p) if isinstance(p, list) else p.hi - p.lo
        if size <= n:
            parts.pop()
        elif isinstance(p, list):
            del p[-n:]
        else:
            p.hi -= n
        n -= min(n, size)


class ChunkEncoder:
    def __init__(self, path: str, mean_bytes: int, max_pieces: int, max_chunks: int, first: int = 4):
        self.pieces, self.chunks, self.max_chunks = PieceEncoder(path, max_pieces), {}, max_chunks
        self.limit, self.first = np.uint32((1 << 32) // mean_bytes), first

    def cuts(self, data: np.ndarray) -> list[int]:
        """Ends of chunks: after hits of the rolling hash, at whole code points."""
        at = np.flatnonzero(gear_hashes(data) < self.limit) + 1
        at = at[at < len(data)]
        return [*at[(data[at] & 0xC0) != 0x80].tolist(), len(data)]

    def chunk(self, raw: bytes) -> Chunk:
        key = xxhash.xxh3_128_digest(raw)
        if (known := self.chunks.get(key)) is None:
            text = raw.decode("utf-8")
            known = self.chunks[key] = Chunk(text, self.pieces.split(text))
        return known

    def join(self, parts: list[Part | list[str]], chunk: Chunk) -> None:
        """Adds ``chunk`` to a text, its join with what is there repaired."""
        i = j = self.first
        while True:
            left, right = last_pieces(parts, i), chunk.span(0, min(j, len(chunk)))
            window = self.pieces.split("".join(left + right))
            # equal pieces have equal ids; where a side is used up there is nothing to agree with
            left_agrees = len(left) < i or window[:2] == left[:2]
            right_agrees = j >= len(chunk) or window[-2:] == right[-2:]
            if left_agrees and right_agrees:
                break
            i, j = (i if left_agrees else 2 * i), (j if right_agrees else 2 * j)
        drop_last(parts, len(left))
        if parts and isinstance(parts[-1], list):
            parts[-1] += window
        else:
            parts.append(window)
        if j < len(chunk):
            parts.append(Part(chunk, j, len(chunk)))

    def parts(self, text: str) -> list[Part | list[str]]:
        """A text as parts of chunks and, between them, the pieces of the repaired joins."""
        raw = text.encode("utf-8")
        out: list[Part | list[str]] = []
        start = 0
        for end in self.cuts(np.frombuffer(raw, np.uint8)) if raw else ():
            chunk = self.chunk(raw[start:end])
            if start:
                self.join(out, chunk)
            else:
                out.append(Part(chunk, 0, len(chunk)))
            start = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        self.chunks = trimmed(self.chunks, self.max_chunks)
        whole = [self.parts(t) for t in texts]
        new = [c for c in self.chunks.values() if c.at is None]
        self.pieces.learn([*(c.pieces for c in new), *(p for parts in whole for p in parts if isinstance(p, list))])
        for c in new:
            c.encoded(list(map(self.pieces.store.__getitem__, c.pieces)))
        return [
            b"".join([self.pieces.ids(p) if isinstance(p, list) else p.chunk.ids[p.chunk.at[p.lo] : p.chunk.at[p.hi]] for p in parts])
            for parts in whole
        ]


def token_bytes(path: str) -> list[bytes]:
    """The bytes each id of a byte-level vocabulary stands for."""
    shown = {c: bytes([b]) for c, b in byte_letters().items()}
    tok = load_tokenizer(path)
    known = {i: t for t, i in tok.get_vocab(with_added_tokens=True).items()}
    return [b"".join(shown.get(c, c.encode()) for c in known.get(i, "")) for i in range(max(known) + 1)]


_ENCODERS: dict[tuple, ChunkEncoder] = {}
_TABLES: dict[str, list[bytes]] = {}


def encode(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    mean_bytes: int = 1024,
    max_pieces: int = 300_000,
    max_chunks: int = 8_000,
) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    key = (tokenizer_path, mean_bytes, max_pieces, max_chunks)

    def run(batches):
        if key not in _ENCODERS:
            _ENCODERS[key] = ChunkEncoder(*key)
        enc = _ENCODERS[key]
        for b in batches:
            ids = enc.encode(b.column(1).to_pylist())
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, to the columns of ``encode``."""

    def run(batches):
        if tokenizer_path not in _TABLES:
            _TABLES[tokenizer_path] = token_bytes(tokenizer_path)
        table = _TABLES[tokenizer_path]
        for b in batches:
            texts = [
                b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]).decode("utf-8", "replace")
                for x in b.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"]
            )

    return encoded.select("doc_id", "n_tokens", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string"
    )
