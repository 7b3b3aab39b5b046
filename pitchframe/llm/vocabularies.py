"""Token ids of texts by public vocabularies, as little-endian unsigned 32-bit bytes.

An encoder is a callable ``text -> bytes`` with a ``version`` (digest of its
file) and ``blank_safe`` (runs of blanks don't matter to it). Encoders live once
per Python worker. Where the library's result for a text is the concatenation
of its results for the space-separated parts, parts are memoised: invented or
rare words miss, common words hit. The memo has two generations of a fixed
number of parts, so its memory is bounded whatever the vocabulary. A column of
texts asks the memo once for each distinct part.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_PARTS = 300_000
MEMO_LENGTH = 48


class Memo(dict):
    """``part -> value``, computed on a miss; the older generation answers until it is replaced."""

    def __init__(self, compute, parts: int = MEMO_PARTS):
        super().__init__()
        self.compute, self.parts, self.older = compute, parts, {}

    def __missing__(self, part: str):
        value = self.older.get(part)
        if value is None:
            value = self.compute(part)
            if isinstance(part, str) and len(part) > MEMO_LENGTH:
                return value
        if len(self) >= self.parts:
            self.older = dict(self)
            self.clear()
        self[part] = value
        return value


def id_bytes(ids) -> bytes:
    return array("I", ids).tobytes()


def byte_letters() -> dict[int, str]:
    """The printable characters by which byte-level vocabularies write bytes, as the published rule has them."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def id_column(encode, texts: pa.Array) -> list[bytes]:
    """The ids of each text of a column without nulls."""
    return encode.column(texts) if getattr(encode, "blank_safe", False) else [encode(text) for text in texts.to_pylist()]


class WordPieces:
    """A ``tokenizers`` file; ``parted`` if its pre-tokenizer drops all white space, so no token spans a space."""

    def __init__(self, path: str, content: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rule = json.loads(content)
        steps = (rule.get("pre_tokenizer") or {}).get("pretokenizers") or []
        normal = (rule.get("normalizer") or {}).get("normalizers") or []
        self.ascii_rule = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
        full = self.ascii_rule.replace("[a-z]+", r"[\p{L}]+").replace("[0-9]", r"[\p{N}]", 1).replace(r"[^\sa-z0-9]+", r"[^\s\p{L}\p{N}]+")
        self.blank_safe = bool(
            steps
            and steps[0].get("type") == "Split"
            and steps[0].get("invert")
            and steps[0].get("behavior") == "Removed"
            and steps[0]["pattern"].get("Regex") == full
            and [n.get("type") for n in normal] == ["NFC", "Replace", "Lowercase"]
            and all(not t["lstrip"] and not t["rstrip"] for t in rule.get("added_tokens", []))
            and not any(" " in t["content"] for t in rule.get("added_tokens", []))
        )
        self.special = any("<|" not in t["content"] for t in rule.get("added_tokens", []))
        if self.blank_safe:
            # Letters below U+0180 stand in NFC and are lowered to each other; the capital I with a dot becomes two characters and is left out.
            letters = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
            self.plain_rule = rf"\A[\x21-\x7e{letters}]*\z"
            self.plain = re.compile(rf"[\x21-\x7e{letters}]*").fullmatch
            rule = self.ascii_rule.replace("a-z", f"a-z{letters}")
            self.find, self.find_marked = re.compile(rule).findall, re.compile(f"{rule}| ").findall
            self.letters = byte_letters()
            self.pieces = Memo(self._piece, 250_000)
            self.parts = Memo(self._part, 50_000)

    def _piece(self, piece: str) -> bytes:
        if piece == " ":
            return b""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return id_bytes([t.id for t in self.tokenizer.model.tokenize(piece)])

    def _part(self, part: str) -> bytes:
        if len(part) <= MEMO_LENGTH and self.plain(part) and "<|" not in part and not self.special:
            return b"".join(map(self.pieces.__getitem__, self.find(part.lower())))
        return self.whole(part)

    def whole(self, text: str) -> bytes:
        return id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if not self.blank_safe:
            return self.whole(text)
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))

    def column(self, texts: pa.Array) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        known, begin, sizes = self._distinct(words.dictionary)
        of = words.indices.to_numpy()
        n = sizes[of]
        until = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(begin[of] - until[:-1], n)
        where += np.arange(len(where))
        ids = known[where]
        return [ids[a:b].tobytes() for a, b in zip(until[first[:-1]].tolist(), until[first[1:]].tolist(), strict=True)]

    def _distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of ``parts`` in any order, and where those of each part begin and how many they are. Plain parts are taken apart together, so they need no memo of their own."""
        plain = pc.and_(pc.match_substring_regex(parts, self.plain_rule), pc.less_equal(pc.utf8_length(parts), MEMO_LENGTH)).to_numpy(zero_copy_only=False)
        plain &= ~pc.match_substring(parts, "<|").to_numpy(zero_copy_only=False) & (not self.special)
        pieces = self.find_marked(" ".join(_strings(parts.filter(pa.array(plain)))).lower())
        found = list(map(self.pieces.__getitem__, pieces))
        until = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        marks = np.flatnonzero(np.array(pieces, object) == " ")
        found += map(self.parts.__getitem__, _strings(parts.filter(pa.array(~plain))))
        rest = np.fromiter(map(len, found[len(pieces) :]), np.int64, len(found) - len(pieces)) // 4
        begin, sizes = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        if plain.any():
            begin[plain] = until[np.concatenate([[0], marks])]
            sizes[plain] = until[np.concatenate([marks, [len(pieces)]])] - begin[plain]
        begin[~plain], sizes[~plain] = until[-1] + np.cumsum(rest) - rest, rest
        return np.frombuffer(b"".join(found), np.uint32), begin, sizes


class SentencePieces:
    blank_safe = False

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, text: str) -> bytes:
        return id_bytes(self.processor.encode(text, num_threads=1))


@lru_cache(maxsize=4)
def encoder(path: str):
    with open(path, "rb") as file:
        content = file.read()
    if path.endswith(".json"):
        made = WordPieces(path, content)
    elif path.endswith(".model"):
        made = SentencePieces(path)
    else:
        from pitchframe.llm.byte_bpe import ByteBpe

        made = ByteBpe(content)
    made.version = hashlib.sha256(content).hexdigest()
    return made
