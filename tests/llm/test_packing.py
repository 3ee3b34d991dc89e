"""Packing: ids equal the tokenizer's, pieces cover each document once, lengths are powers of two."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True
ENCODE = packing.Encoder()


def spec_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aé ßЖ'\n\t\r.,;1٣²\x0b\x85\xa0 ", max_size=60)))
def test_ids_equal_tokenizers(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODE(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_pieces():
    for n in (1, 2, 3, 2047, 2048, 2049, 6000):
        cut = packing.pieces(n)
        assert [s for s, _ in cut] == list(np.cumsum([0, *[k for _, k in cut[:-1]]])) and sum(k for _, k in cut) == n
        assert all(k & (k - 1) == 0 and k <= 2048 for _, k in cut)


def test_pack(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "word " * 5000), (4, "word " * 5000), (5, "<|endoftext|> x"), (6, "x" * 3000), (None, "null id"), (7, "naïve café ﷽ \U0001f600 z")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, offset int").repartition(3)
    got = packing.pack(docs).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    by = defaultdict(list)
    for r in got:
        assert r.offset == 0 and r.length == 1 << r.bucket <= 2048 and r.ids_crc32 == zlib.crc32(r.ids)
        by[r.doc_id].append(r)
    for d, text in rows:
        ids = spec_ids(text)
        parts = sorted({(r.start, r.length, r.doc_tokens, bytes(r.ids)) for r in by[d]})
        assert b"".join(p[3] for p in parts) == np.array(ids, "<u4").tobytes() and {p[2] for p in parts} == {len(ids)}
    assert packing.pack(docs.limit(0)).count() == 0


def test_both_engines_agree_on_every_pair_of_plain_characters():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    exact.encode_special_tokens = True
    encode = packing.Encoder()
    plain = [chr(c) for c in range(0x3000) if (c < 128 and c in packing._PLAIN_BYTES) or (c > 127 and packing._PLAIN_CHARS.fullmatch(chr(c)))]
    assert len(plain) > 1000
    for a in plain:
        for text in (" ".join(a + b for b in plain), "\n".join(b + a for b in plain), "x" + "1".join(a + b + a for b in plain[::7])):
            for piece in (text[i : i + 300] for i in range(0, len(text), 300)):
                assert encode.fast.encode_ordinary(piece) == exact.encode(piece, add_special_tokens=False).ids, repr(piece)


def test_engines_agree_around_the_longest_run():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    exact.encode_special_tokens = True
    encode = packing.Encoder()
    for unit in ("a", "ab1", "é", "ж", "-", "7", "'s", "the", "–", "xY."):
        for n in (398, 399, 400, 401, 1200):
            run = (unit * n).encode()[:n].decode(errors="ignore")
            for text in (run, f"start {run} end", f"{run}\n{run}"):
                ids = exact.encode(text, add_special_tokens=False).ids
                assert encode(text).tolist() == ids
                assert encode.fast.encode_ordinary(text) == ids
