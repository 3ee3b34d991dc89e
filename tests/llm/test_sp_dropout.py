"""Merge-dropout: the model's own segmentation at 0, a plain agenda otherwise, lossless decoding."""

import heapq

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import sp_dropout as spd

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
MODEL = spd.MergeModel()
TEXTS = ["Hello world, this is a test.", "ÉTÉ  où ça\n\n\tx", "日本語 \U0001f600 mixed", "a" * 300, "  leading and trailing  ", "x\x00ý zero", "the the the " * 60, " ", "12345.678"]


def skipped(key, place, left, right, dropout):
    m = 2**64 - 1
    h = key ^ (place * int(spd._C[0]) & m) ^ (left * int(spd._C[1]) & m) ^ (right * int(spd._C[2]) & m)
    h ^= h >> 32
    h = h * int(spd._C[3]) & m
    h ^= h >> 29
    h = h * int(spd._C[0]) & m
    h ^= h >> 32
    return h < int(dropout * 2**64)


def spec(text, key, dropout):
    """A heap of candidates over a linked list, popped best first."""
    if not text:
        return []
    chars = list(" " + text)
    table = {int(p): (int(r), int(m)) for p, r, m in zip(MODEL.pair, MODEL.rank, MODEL.merged, strict=True)}
    sym, place = [], []
    for i, c in enumerate(chars):
        own = MODEL.char_id[ord(c)]
        part = [int(own)] if own >= 0 else [int(MODEL.byte_id[b]) for b in c.encode()]
        sym += part
        place += [i] * len(part)
    nxt, prv = [*range(1, len(sym)), None], [None, *range(len(sym) - 1)]
    heap = []

    def push(i):
        if i is None or nxt[i] is None:
            return
        j = nxt[i]
        hit = table.get(sym[i] * MODEL.size + sym[j])
        if hit:
            heapq.heappush(heap, (hit[0], i, sym[i], j, sym[j], hit[1]))

    for i in range(len(sym)):
        push(i)
    gone = set()
    while heap:
        _, i, a, j, b, merged = heapq.heappop(heap)
        if i in gone or j in gone or nxt[i] != j or (sym[i], sym[j]) != (a, b):
            continue
        if dropout and skipped(key, place[i], a, b, dropout):
            continue
        sym[i] = merged
        gone.add(j)
        nxt[i] = nxt[j]
        if nxt[i] is not None:
            prv[nxt[i]] = i
        push(prv[i])
        push(i)
    return [s for i, s in enumerate(sym) if i not in gone]


def test_without_dropout_equals_the_library():
    got = spd.encode(MODEL, TEXTS, [1] * len(TEXTS), 0.0)
    assert [g.tolist() for g in got] == [SP.encode(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aeinrst th▁ é\nß", max_size=40), min_size=1, max_size=4), st.integers(0, 5))
def test_dropout_equals_plain_agenda_and_decodes(texts, seed):
    keys = [spd.document_key(seed, i) for i in range(len(texts))]
    for share in (0.0, 0.2, 0.9):
        got = spd.encode(MODEL, texts, keys, share)
        assert [g.tolist() for g in got] == [spec(t, k, share) for t, k in zip(texts, keys, strict=True)]
        assert [spd.decode(MODEL, g).decode() for g in got] == texts


def test_long_texts_are_cut_between_runs(monkeypatch):
    texts = [*TEXTS, "many words go here " * 40]
    keys = [spd.document_key(3, i) for i in range(len(texts))]
    whole = [g.tolist() for g in spd.encode(MODEL, texts, keys, 0.3)]
    monkeypatch.setattr(spd, "CHUNK", 50)
    assert [g.tolist() for g in spd.encode(MODEL, texts, keys, 0.3)] == whole


def test_long_runs_take_the_heap(monkeypatch):
    texts = ["ab" * 900 + " cd", "éa" * 700, "x" * 2000, "日本語a" * 300, "there" * 400 + "\n" + "here" * 400]
    keys = [spd.document_key(5, i) for i in range(len(texts))]
    for share in (0.0, 0.3):
        got = [g.tolist() for g in spd.encode(MODEL, texts, keys, share)]
        assert got == [spec(t, k, share) for t, k in zip(texts, keys, strict=True)]
        monkeypatch.setattr(spd, "LONG_RUN", 10**9)
        assert got == [g.tolist() for g in spd.encode(MODEL, texts, keys, share)]
        monkeypatch.setattr(spd, "LONG_RUN", 512)
    assert [spd.decode(MODEL, np.array(g)).decode() for g in got] == texts


def test_one_run_of_a_megabyte():
    text = "abcdefgh" * 40_000
    assert spd.decode(MODEL, spd.encode(MODEL, [text], [1])[0]).decode() == text


def test_documents(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(50, None, "k"), (51, "", "k"), (52, "same text here", "k"), (52, "same text here", "k"), (53, "same text here", "k"), (None, "no id ▁", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = spd.encode_documents(docs, dropout=0.5).cache()
    got = out.collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    same = [bytes(r.ids) for r in got if r.doc_id == 52]
    assert same[0] == same[1] != [bytes(r.ids) for r in got if r.doc_id == 53][0]
    assert {bytes(r.ids) for r in spd.encode_documents(docs, dropout=0.5, seed=4).filter("doc_id = 52").collect()} != set(same)
    back = {(r.doc_id, r.text) for r in spd.decode_documents(out).collect()}
    assert back == {(d, t or "") for d, t, _ in rows}
    assert spd.encode_documents(docs.limit(0)).count() == 0
    share = np.mean([r.n_ids for r in got if r.doc_id == 3])
    assert share > len(SP.encode(TEXTS[3]))
