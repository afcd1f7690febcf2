import random
import zlib

import numpy as np
import pytest

from ledgerflow.llm import packing, tokens

from .fixtures import AWKWARD, awkward


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def test_pieces_give_the_ids_of_the_whole_text(whole):
    rng = random.Random(5)
    chars = " \t\n\r\x0b\x1c\x85\xa0　.,'!aébÀ字9²_-\0😀"
    texts = [t for _, t in AWKWARD] + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40)))
                                       for _ in range(3000)]
    texts += ["I'll say, it's don't. we've  done", " x", "x ", "a , b", "word, word. word.. word., 3.5, x²."
              "a_. b_, ,c .d", ".", ",", "a\nb.\nc,\n\nd", "é. é́. x\u200b. a.b@c.de,f"]
    enc = tokens.Encoder(tokens.default_tokenizer())
    for t, got in zip(texts, enc.encode(texts)):
        assert ids(got) == whole(t), repr(t)


def test_cuts_between_kinds_of_characters(whole):
    """Letters, digits, signs, apostrophes, single and double white space of all sorts, in any order."""
    rng = random.Random(11)
    parts = ["a", "Zz", "é", "×", "÷", "ÿ", "ß", "7", "42", "²", ".", ",", "!?", "_", "'", "'s", "'ll", "'T", "<|",
             "|>", " ", " ", " ", "\n", "\n", "\t", "\r\n", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f",
             "\u205f", "\u3000", "\u0301", "\u201c", "\u2014", "字", "、", "😀", "\0", "\x1f", "the", "tion"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20000)]
    texts += [a + b + c for a in parts for b in (" ", "\n", ".", "'") for c in parts]
    enc = tokens.Encoder(tokens.default_tokenizer())
    for t, got in zip(texts, enc.encode(texts)):
        assert ids(got) == whole(t), repr(t)


def test_arrays_with_nulls_slices_and_end_ids(whole):
    import pyarrow as pa

    texts = ["cut", None, "", "a b\nc.", "x <|endoftext|> y", "w" * 500, "", "tail ", " head", None]
    enc = tokens.Encoder(tokens.default_tokenizer())
    for kind in (pa.string(), pa.large_string()):
        array = pa.array(texts, kind)
        for at, n in [(0, len(texts)), (1, 3), (4, 2), (9, 1), (2, 1), (3, 0)]:
            got = enc.encode_array(array.slice(at, n), end=0).to_pylist()
            assert [ids(b) for b in got] == [[*whole(t), 0] for t in texts[at:at + n]]
    assert enc.encode_array(pa.array([None, ""], pa.string())).to_pylist() == [b"", b""]


def test_long_pieces_are_not_kept(whole):
    enc = tokens.Encoder(tokens.default_tokenizer())
    texts = ["字" * 300 + " " + "word", "字" * 300 + "x", "word word"]
    rows = []
    for _ in range(3):
        assert [ids(b) for b in enc.encode(texts)] == [whole(t) for t in texts]
        rows.append((enc.n_rows, enc.n_ids, len(enc.cache)))
    assert len(set(rows)) == 1 and all(len(p) <= tokens.LONGEST for p in enc.cache)


def test_other_kinds_of_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = ["Some words, and  more.\nNext line", "", "a <|endoftext|> b", "x1 y2'z"]
    assert not enc.cuts
    assert [ids(b) for b in enc.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_slices_bound_rows_and_bytes():
    import pyarrow as pa

    texts = pa.array(["x" * 10, None, "", "y" * 100, "z" * 3, "z" * 3, "z" * 3])
    assert list(tokens.slices(texts, 3, 1000)) == [(0, 3), (3, 3), (6, 1)]
    assert list(tokens.slices(texts, 99, 12)) == [(0, 3), (3, 1), (4, 3)]
    assert list(tokens.slices(texts.slice(0, 0))) == []


def test_joined_words_give_the_ids_of_each(whole):
    words = ["the", "Ünïcödé", "字字", "don", "ⅷ", "²", "x" * 200, "éé", "ſt", "ﬁn", "Straße", "ａｂ"]
    enc = tokens.Encoder(tokens.default_tokenizer())
    assert [ids(b) for b in enc._joined(words, "\n")] == [whole(w) for w in words]
    assert [ids(b) for b in enc._joined([" " + w for w in words], " ")] == [whole(" " + w) for w in words]
    letters = [chr(c) for c in range(0x80, 0x3000) if chr(c).isalpha()]
    for mark, own in (("\n", letters), (" ", [" " + c for c in letters])):
        assert [ids(b) for b in enc._joined(own, mark)] == [whole(w) for w in own]


def test_cache_stays_bounded():
    enc = tokens.Encoder(tokens.default_tokenizer(), cache_entries=10)
    for i in range(20):
        enc.encode([f"word{i} other{i} third{i}"])
        assert len(enc.cache) <= 10 + 6


@pytest.mark.parametrize("window", [1024, 7])
def test_pieces_tile_documents_and_sequences(spark, whole, window):
    docs = awkward(spark).repartition(5)
    rows = packing.pack(docs, window=window).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.sequence_id * window + r.offset - r.start, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, own in by_seq.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or s == max(by_seq) and at <= window
    got = []
    for own in by_doc.values():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert all(r.doc_tokens == sum(x.length for x in own) for r in own)
        got.append((own[0].doc_id, b"".join(r.ids for r in own)))
    want = [(i, np.array([*whole(t), 0], "<u4").tobytes()) for i, t in AWKWARD]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sequences_are_padded(spark):
    pieces = packing.pack(awkward(spark), window=64)
    seqs = packing.sequences(pieces, window=64, pad_id=9).collect()
    assert all(len(s.ids) == 256 for s in seqs)
    last = max(seqs, key=lambda s: s.sequence_id)
    assert ids(last.ids)[last.n_tokens:] == [9] * (64 - last.n_tokens)
    assert all(s.n_tokens == 64 for s in seqs if s is not last)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_file_order_follows_the_files_numbers(spark, whole, tmp_path):
    # later files are larger, so that Spark would deal them out first
    rows = [(i, f"w{i} " * (1 + i // 10)) for i in range(200)]
    path = str(tmp_path / "ordered")
    (spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(9, "doc_id")
     .sortWithinPartitions("doc_id").write.parquet(path))
    pieces = packing.pack(spark.read.parquet(path), window=64, file_order=True).collect()
    firsts = sorted((r.sequence_id, r.offset, r.doc_id) for r in pieces if r.start == 0)
    assert [d for _, _, d in firsts] == list(range(200))
