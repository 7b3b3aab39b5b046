import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitchframe.llm import byte_bpe, packing, token_counts
from pitchframe.llm.vocabularies import Memo, WordPieces, encoder, id_column
from pitchframe.session import shared_dir

WORD, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", "á b", "ÉCOLE  l'été x y", "<|startoftext|>a <|endoftext|> b", "don't YOU'LL 12a3 \x01\x7f", "Σας ΑΣ. İ ß", "a\x0bb\x1cd\x85e", "日本 👍🏽 a👍b", "a   b \n x\n c  \n"]


def test_word_encoder_is_the_library():
    library, own = Tokenizer.from_file(WORD), encoder(WORD)
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice("ab' \n'stLé9.🙂<|>") for _ in range(50)) for _ in range(300)]
    assert [list(memoryview(own(t)).cast("I")) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_column_is_the_library_and_meets_each_piece_once():
    library, own = Tokenizer.from_file(WORD), WordPieces(WORD, open(WORD, "rb").read())
    draw = random.Random(5)
    letters = [chr(c) for c in range(0xA0, 0x260)]
    texts = ODD + ["".join(draw.choice([*"ab' \n'stLé9.🙂<|>", "\u0301", draw.choice(letters)]) for _ in range(50)) for _ in range(600)] + ["x" * 60, "é" * 49, "\n", " "]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    column = pa.array(["left out", *texts]).slice(1)
    assert [list(memoryview(ids).cast("I")) for ids in id_column(own, column)] == want
    assert [list(memoryview(own(t)).cast("I")) for t in texts] == want
    assert id_column(own, pa.array([], pa.string())) == [] and id_column(own, pa.array([""])) == [b""]
    met = []
    own.pieces, own.parts = Memo(lambda piece: met.append(piece) or WordPieces._piece(own, piece)), Memo(lambda part: met.append(part) or b"")
    id_column(own, pa.array(["Oneaï (oneaï) oneaï, ONEAÏ.", "oneaï; Oneaï"]))
    assert sorted(met) == sorted([" ", "oneaï", "(", ")", ",", ".", ";"])


def test_sentence_pieces_are_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), encoder(path)
    assert [list(memoryview(own(t)).cast("I")) for t in ODD] == library.encode(ODD)


def test_byte_encoder_is_the_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    library, own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), encoder(BYTES)
    draw = random.Random(4)
    texts = ODD + ["".join(draw.choice("ab \n'st1é🙂 ") for _ in range(60)) for _ in range(500)] + ["".join(draw.choice("etaoin shrdlu") for _ in range(200)) for _ in range(300)]
    texts += ["ab" * 30_000, "é" * 5000]
    assert [list(memoryview(own(t)).cast("I")) for t in texts] == [library.encode_ordinary(t) for t in texts]


def test_counts_and_cache(spark, odd, nothing):
    cache = shared_dir(spark, "cache")
    library = Tokenizer.from_file(WORD)
    rows = token_counts.token_counts(odd, WORD, cache, 100).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    want = sorted((len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 100) for t in texts)
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({" ".join(t.replace("\n", " ").split(" ")) if not t.strip(" \n") == "" else t for t in texts}) or stored <= len(set(texts))
    token_counts.token_counts(odd, WORD, cache, 100).count()
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded again
    assert token_counts.token_counts(nothing, WORD, cache).count() == 0


def test_round_trip(odd, nothing):
    rows = byte_bpe.decode_documents(byte_bpe.encode_documents(odd, BYTES), BYTES).collect()
    want = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in odd.collect())
    assert sorted(hashlib.sha256(r["decoded"]).hexdigest() for r in rows) == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert byte_bpe.encode_documents(nothing, BYTES).count() == 0


def check_plan(counts, capacity):
    runs = packing.plan(counts, capacity)
    places, of = set(), {}
    for length, rank, n, layers, first, base in runs:
        of.setdefault(length, []).append((rank, n * layers))
        for r in range(n * layers):
            sequence, offset = first + r % n, base + length * (r // n)
            for place in range(offset, offset + length):
                assert (sequence, place) not in places and place < capacity
                places.add((sequence, place))
    for length, parts in of.items():
        at = 0
        for rank, n in sorted(parts):
            assert rank == at
            at += n
        assert at == counts[length]
    sequences = {}
    for sequence, place in places:
        sequences.setdefault(sequence, set()).add(place)
    assert all(s == set(range(len(s))) for s in sequences.values())
    return len(sequences)


def best_fit(lengths, capacity):
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= length
        else:
            room.append(capacity - length)
    return len(room)


def test_plan_is_best_fit():
    draw = random.Random(1)
    for _ in range(150):
        counts = {draw.randint(1, 60): draw.randint(1, 30) for _ in range(draw.randint(0, 25))}
        assert check_plan(counts, 60) == best_fit([n for n, c in counts.items() for _ in range(c)], 60)


def test_packed_documents(odd, nothing):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack(odd, WORD, 512, 1).collect()
    lengths = sorted(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["ids_crc32"] if r["piece"] == 0 else None), 0)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(lengths)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(nothing, WORD).count() == 0


def test_digests_of_one_pass_equal_the_two_operators(spark, odd, nothing):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(odd, ranks), ranks)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert plain(byte_bpe.coded_digests(odd, ranks)) == plain(coded.select("doc_id", "n_tokens", ids, F.sha2("decoded", 256)))
    assert byte_bpe.coded_digests(nothing, ranks).count() == 0
