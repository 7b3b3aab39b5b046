"""Byte-level BPE by rank files, encoded in linear time.

Bytes are read as Latin-1 so that one Aho-Corasick automaton over all tokens
finds every token that ends at each byte. Encoding walks from the longest token
at a position and goes back to shorter ones where two neighbours could not both
be left standing by the merges: a pair is compatible when merging it apart, from
the newest merge down, never meets a pair that merges earlier. That test depends
on the two ids alone and is memoised; positions that failed once are not tried
again, so the walk is linear and gives the ids of the merges exactly.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from pitchframe.llm.common import map_arrow, texts
from pitchframe.llm.vocabularies import Memo, encoder, id_bytes

PAIRS = 250_000
PARTS = 500_000


class ByteBpe:
    """``text -> ids`` for the ranks in ``content``; text is first split by ``pattern``, each match is encoded alone."""

    blank_safe = False

    def __init__(self, content: bytes, pattern: str | None = None):
        import ahocorasick
        import regex

        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        order = sorted(ranks, key=ranks.get)
        self.tokens = dict(zip(map(ranks.get, order), order, strict=True))
        self.rank = ranks
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.double_blank = regex.compile(r" \s").search
        self.automaton = ahocorasick.Automaton()
        for token in order:
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, ranks[token]))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter = {ranks[t]: next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), None) for t in order}
        for token in order:
            self._learn(token)
        self.compatible = Memo(lambda pair: self._compatible(divmod(pair, len(ranks))), PAIRS)
        self.ranks = len(ranks)
        self.matches = Memo(lambda match: id_bytes(self.encode_match(match.encode())), 100_000)
        self.parts = Memo(self._part, PARTS)

    def _learn(self, token: bytes) -> None:
        """Find the two tokens whose merge makes ``token``."""
        own = self.rank[token]
        left = self.shorter[own]
        while left is not None:
            right = self.rank.get(token[len(self.tokens[left]) :])
            if left < own and right is not None and right < own and self._compatible((left, right)):
                self.halves[own], self.merged[left, right] = (left, right), own
                return
            left = self.shorter[left]
        self.halves[own] = (own, own)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Would the merges leave these two neighbours as they are?"""
        left, right = pair
        bound = None  # the merges from this rank on have been taken apart
        while True:
            made = self.merged.get((left, right))
            if made is not None and (bound is None or made < bound):
                return False
            if left > right:
                bound, inner = left, self.halves[left][1]
                if inner != left:
                    left = inner
                    continue
                bound, inner = right + 1, self.halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                bound, inner = right + 1, self.halves[right][0]
                if inner != right:
                    right = inner
                    continue
                bound, inner = left, self.halves[left][1]
                if inner == left:
                    return True
                left = inner

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():  # one match, whatever follows, and kept as a part already
            return id_bytes(self.encode_match(b" " + part.encode()))
        return b"".join(map(self.matches.__getitem__, self.find(" " + part)))

    def encode_match(self, raw: bytes) -> list[int]:
        whole = self.rank.get(raw)
        if whole is not None and (len(raw) == 1 or self.halves[whole][0] != whole):
            return [whole]
        size, ranks, lengths, compatible, shorter = len(raw), self.ranks, self.lengths, self.compatible, self.shorter
        # Matches come in order of their ends: the last one that starts at a place is the longest.
        longest = [0] * (size + 1)
        for last, (back, token) in self.automaton.iter(raw.decode("latin-1")):
            longest[last - back] = token
        open_at = bytearray(b"\x01") * (size + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            end = at + lengths[token]
            if open_at[end] and (not ids or compatible[ids[-1] * ranks + token]):
                ids.append(token)
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token is None:
                open_at[at] = 0
                last = ids.pop()
                at -= lengths[last]
                token = shorter[last]
        return ids

    def __call__(self, text: str) -> bytes:
        """A single blank before a non-blank always begins a match, so such parts are encoded, and memoised, on their own."""
        if self.double_blank(text):
            return b"".join(map(self.matches.__getitem__, self.find(text)))
        parts = text.split(" ")
        first = b"".join(map(self.matches.__getitem__, self.find(parts[0])))
        return first + b"".join(map(self.parts.__getitem__, parts[1:]))


@lru_cache(maxsize=2)
def token_table(path: str) -> dict[int, bytes]:
    """The bytes of each rank: all that decoding needs."""
    with open(path, "rb") as file:
        return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file.read().splitlines())}


@lru_cache(maxsize=2)
def id_names(path: str) -> dict[int, str]:
    return {rank: str(rank) for rank in token_table(path)}


def encode_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids (array), n_tokens`` of each row by the rank file ``ranks``.

    Defined cases: a null text counts as empty and has no ids; repeated rows and
    null keys each keep their row; an empty table gives no row; other columns are
    ignored. No shuffle; a very long text costs memory in proportion to itself.
    """

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(ranks)
        ids = [memoryview(coder(t)).cast("I").tolist() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
            names=["doc_id", "n_tokens", "ids"],
        )

    return map_arrow(texts(docs, id_col, text_col), encode, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes that the array ``ids`` stands for (null ids: null)."""

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = token_table(ranks)
        lists = batch.column("ids")
        decoded = pa.array([b"".join(map(tokens.__getitem__, ids.values.to_pylist())) if ids.is_valid else None for ids in lists], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in encoded.dtypes)
    return map_arrow(encoded, decode, f"{fields}, decoded binary")


def coded_digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row: encoded, decoded again from the ids, and digested in one pass.

    ``ids_sha256`` is that of the decimal ids joined by a space, both are
    lowercase hex. The cases are those of :func:`encode_documents`.
    """

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, tokens, names = encoder(ranks), token_table(ranks), id_names(ranks)
        counts, ids_hex, decoded_hex = [], [], []
        for text in batch.column("text").to_pylist():
            ids = memoryview(coder(text)).cast("I").tolist()
            counts.append(len(ids))
            ids_hex.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            decoded_hex.append(hashlib.sha256(b"".join(map(tokens.__getitem__, ids))).hexdigest())
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(texts(docs, id_col, text_col), code, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
