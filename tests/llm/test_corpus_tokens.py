"""Token files and packing: exact round trips against the tokenizer itself."""

import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402
import pyarrow as pa  # noqa: E402

from planshift.llm.packing import packed  # noqa: E402
from planshift.llm.token_files import SequenceReader, read_documents, write_token_files  # noqa: E402
from planshift.llm.word_ids import PieceIds, vocabulary  # noqa: E402
from planshift.session import work_path  # noqa: E402

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = [
    "", None, " a", "a ", "a  b", "a\n\nb", "a\n\n\nb", "x\n", "\n", " \n", "a\tb", "it's  'll don't", "a \n b", "ab\x01c", " x",
    "Á b é é", "hello <|endoftext|> wor|d", "12 345 6", "\x01", "a\x1c!\x1c! b", "a b", "x  y", "Σας ΣΑΣ", "tail\n\n", "İ. (İ\") e̸. x!\"s ...Word?! 's a’ 3rd, 1,5 e-mail;", "a <|startoftext|> B<|endoftext|>c",
]


def whole(file, texts, end):
    tokenizer = Tokenizer.from_file(file)
    return [np.array([*e.ids, *end], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("file", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_pieces_give_the_ids_of_the_tokenizer(file, kind, monkeypatch):
    texts = ODD + [d[1] for d in corpus.rows()]
    encoder = PieceIds(file, kind)
    for most in (600_000, 50):  # with a store that starts anew
        monkeypatch.setattr("planshift.llm.word_ids.MOST_PIECES", most)
        ids, bounds = encoder.encode(pa.array(texts))
        for i, want in enumerate(whole(file, texts, [])):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == want.tolist(), repr(texts[i])


@pytest.mark.parametrize(("file", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_pieces_of_any_letters_digits_and_punctuation(file, kind):
    draw = random.Random(11)
    parts = [*"stdmlrvex'\"’.,-!(/09ÁéßΣ٣Ⅷ日\u0301İÑñøŸǅȺªº²¼ß×_\n ", "'s", "'ll", "'re", " '", "\n'", " \"", "...", "word", "Word", " 2019", "\x7f"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(4000)]
    ids, bounds = PieceIds(file, kind).encode(pa.array(texts))
    for i, want in enumerate(whole(file, texts, [])):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == want.tolist(), repr(texts[i])


def test_token_files_round_trip(spark):
    folder = work_path(spark, "token-test")
    files = write_token_files(corpus.frame(spark), folder, BYTE, sequence_length=16)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_documents(files).collect())
    data = sorted(corpus.rows(), key=lambda d: d[0])
    start, want = 0, []
    for d, ids in zip(data, whole(BYTE, [d[1] for d in data], [0]), strict=True):
        want.append((d[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    part = files.orderBy("part").first()
    ids, mask = SequenceReader(part["path"]).sequence(0)
    assert len(ids) == len(mask) == 16
    assert write_token_files(corpus.empty(spark), work_path(spark, "token-test"), BYTE).count() == 0


def test_token_files_spread_copies_of_one_key(spark):
    data = [(7, f"text {i % 3} of one key", None, None, 0, *["x"] * 6) for i in range(300)]
    files = write_token_files(corpus.frame(spark, data), work_path(spark, "token-test"), BYTE, sequence_length=16)
    got = read_documents(files).collect()
    assert Counter((r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (len(x), zlib.crc32(x.tobytes())) for x in whole(BYTE, [d[1] for d in data], [0]))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_packing_covers_every_id_once_and_holds_the_mixture(spark):
    data = corpus.rows()
    got = packed(corpus.frame(spark), WORD, window=64, quantum=4).collect()
    ids = {d[0]: x for d, x in zip(data, whole(WORD, [d[1] for d in data], [2]), strict=True)}
    assert sum(r["length"] for r in got) == sum(len(ids[d[0]]) for d in data)
    covered = Counter()
    windows = defaultdict(list)
    for r in got:
        piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        covered.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
        windows[r["sequence_id"]].append(r)
    times = Counter(d[0] for d in data)
    assert all(n == times[k[0]] for k, n in covered.items())
    assert sorted(windows) == list(range(len(windows)))
    source = {d[0]: d[3] for d in data}
    total = sum(len(ids[d[0]]) for d in data)
    share = sum(len(ids[d[0]]) for d in data if d[3] == "big") / total
    for number, pieces in windows.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        if number < len(windows) - 1:
            assert at == 64
            big = sum(r["length"] for r in pieces if source[r["doc_id"]] == "big")
            assert abs(big - 64 * share) <= 4 * 4 + 1
    assert packed(corpus.empty(spark), WORD).count() == 0
