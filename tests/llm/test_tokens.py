"""Token counts and packing against the tokenizer itself."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import AWKWARD, corpus
from tickframe.llm import packing, token_counts, tokens

BYTES, WORDS = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")
PARTS = ["a", "The", "é", "É", "ß", "İ", "Σ", "ς", "1", "23", " ", "  ", "\n", " \n", "\n\n", "\t", ".", ",", "...", "'s", "’s",
         "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\xa0", "́", "　", "日本", "🙂", "ﬁ", "-", "$$$", "\x1c", "\x85",
         " ", "​", "\r\n", "don't", "²"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=30))
def test_words_encode_like_whole_texts(text):
    counter, encoder = tokens.byte_counter(BYTES), tokens.word_encoder(WORDS)
    assert counter.count(text) == counter.whole(text)
    assert encoder.encode(text) == encoder.whole(text)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 10)
    counter = tokens.ByteCounter(BYTES)
    text = " ".join(f"w{k}x" for k in range(500))
    assert counter.count(text) == counter.whole(text) and len(counter.later) <= 11


def test_words_of_letters_signs_and_digits_are_put_together(monkeypatch):
    """Only different runs of letters, digits and signs go to the tokenizer; a word met again outlives the cache's turn."""
    monkeypatch.setattr(tokens, "CACHE", 40)
    encoder, asked = tokens.WordEncoder(WORDS), []
    plain = encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda text: asked.append(text) or plain(text))
    text = " ".join(f"often$$$ {a}{b}{b}12-{a}," for a in "abcdefgh" for b in "éßxyz")
    assert encoder.encode(text) == plain(text) and len(asked) <= 6 and len(encoder.words) + len(encoder.words.before) <= 42
    assert encoder.encode("it's don't 'tis, x's") == plain("it's don't 'tis, x's")


def test_commas_before_spaces_are_words(monkeypatch):
    """A word met with and without a comma is one word to the cache; signs before or in a run with a comma stay whole."""
    encoder = tokens.WordEncoder(WORDS)
    text = " ".join(f"{w}{e}" for w in ("oak", "elm", "it's", "a1", "éß") for e in ("", ",", ".")) + " end"
    assert encoder.encode(text) == encoder.whole(text)
    assert set(encoder.words) <= {"oak", "elm", "it's", "a1", "a", "1", "éß", ",", ".", "end"}
    for odd in ("a..., b", "a»,, b", "x!. y", "²., z", "a , b", ", a", "a,. b, c", "'s, 't. x", "É, ß. µ, ª. b", "ǆ, Σ. b", "a\n, b", "a\xa0, b", "a\x85. b", "e\u0301, b", "\xad, b"):
        assert encoder.encode(odd) == encoder.whole(odd), odd


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*PARTS, ", ", ". ", ",", ".", " ", "b"]), max_size=12).map("".join) | st.text(st.characters(max_codepoint=255), max_size=12).map(lambda t: t + ", " + t + ". "))
def test_signs_before_spaces_encode_like_whole_texts(text):
    encoder = tokens.word_encoder(WORDS)
    assert encoder.encode(text) == encoder.whole(text)


def test_terms_of_documents_by_one_sort():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 1 << 16, n, dtype=np.uint16) % k for n, k in ((1, 9), (500, 40), (3, 2), (700, 1 << 15), (4, 65535))]
    for given_ in (docs, [docs[k % 5] for k in range((1 << 16) + 5)]):
        owner, terms, counts = packing._terms(given_)
        for k in (0, 1, 4, len(given_) - 1):
            want = np.unique(given_[k], return_counts=True)
            assert (terms[owner == k] == want[0]).all() and (counts[owner == k] == want[1]).all()


HUGE = ["a" * 5000 + " b", " " * 3000 + "x" * 10 + "\n" * 2000, "<|endoftext|>" * 300, "é" * 4000, "ab 12\n\n  " * 500,
        "<|endof" * 600, " x<|endoftext|>  " * 300, "plain words, here. " * 400]


@pytest.mark.parametrize("size,overlap", [(301, 66), (1024, 80)])
def test_huge_texts_are_spliced_exactly(spark, size, overlap):
    texts = HUGE + AWKWARD + HUGE[:2]
    got = token_counts.token_counts(corpus(spark, texts, extra=True), BYTES, limit=100, huge=500, size=size, overlap=overlap)
    whole = tokens.load(BYTES)
    for r in got.collect():
        t = texts[r.doc_id] or ""
        n = len(whole.encode(t, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(t.encode()), n > 100)
    assert got.count() == len(texts)
    assert token_counts.token_counts(corpus(spark, ["x"]).limit(0), BYTES).count() == 0


def check_packed(rows, texts, length=4096):
    whole, by_doc, by_sequence = tokens.load(WORDS), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for k, parts in by_doc.items():
        ids = whole.encode(texts[k] or "", add_special_tokens=False).ids + [2]
        parts.sort(key=lambda r: r.start)
        assert [x for r in parts for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
        assert {r.doc_tokens for r in parts} == {len(ids)}
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
        total = sum(r.length for r in parts)
        assert total == parts[0].sequence_length and (total == length or total & (total - 1) == 0 and total < length)


def test_every_id_is_packed_once(spark):
    rng = np.random.default_rng(2)
    texts = AWKWARD + [" ".join(rng.choice(["alpha", "beta", "gamma", "delta."], rng.integers(1, 900))) for _ in range(40)]
    for shard in (1 << 20, 3000):
        rows = packing.pack_documents(corpus(spark, texts, extra=True), WORDS, shard_tokens=shard, spread=3).collect()
        check_packed(rows, texts)
    assert packing.pack_documents(corpus(spark, ["x"]).limit(0), WORDS).count() == 0


def test_neighbours_share_windows(spark):
    """Documents on one subject lie together: more pairs in a window agree than by chance."""
    rng = np.random.default_rng(4)
    subjects = [[f"{a}{b}" for b in ("oak", "elm", "ash", "fir", "yew", "bay")] for a in ("red", "big", "old", "new")]
    texts = [" ".join(rng.choice(subjects[k % 4], 120)) for k in range(80)]
    rows = packing.pack_documents(corpus(spark, texts), WORDS, length=1024, spread=1).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, set()).add(r.doc_id)
    pairs = [(a % 4, b % 4) for w in windows.values() for a in w for b in w if a < b]
    assert np.mean([a == b for a, b in pairs]) > 0.6


def test_scores_are_bm25():
    docs = [np.array([1, 1, 2], np.uint16), np.array([2, 3], np.uint16), np.array([4], np.uint16)]
    idf = np.zeros(packing.VOCABULARY)
    idf[[1, 2, 3, 4]] = [2.0, 0.5, 1.5, 1.0]
    shard = packing.Shard(docs, idf, 2.0, 10)
    weight = lambda i, tf, n: i * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2))
    assert np.allclose(shard.scores(0), [weight(2, 2, 3) + weight(0.5, 1, 3), weight(0.5, 1, 2), 0])


def test_all_terms_of_a_seed_ask():
    """A seed with many terms that nobody shares still finds the neighbour that shares the others."""
    rng = np.random.default_rng(6)
    own = np.arange(1000, 1040)                       # rare, in the seed alone
    docs = [np.append(own, [1, 2, 3])] + [rng.integers(10, 90, 40) for _ in range(30)] + [np.array([1, 2, 3])]
    docs = [x.astype(np.uint16) for x in docs]
    df = np.bincount(np.concatenate([np.unique(x) for x in docs]), minlength=packing.VOCABULARY)
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    scores = packing.Shard(docs, idf, 40.0).scores(0)
    assert scores[-1] > 0 and scores[1:].argmax() == len(docs) - 2
    assert not packing.Shard(docs, idf, 40.0, 24).scores(0)[1:].any()
    many = [rng.integers(0, 50, 40).astype(np.uint16) for _ in range(30)]
    shard = packing.Shard(many, np.ones(packing.VOCABULARY), 40.0)      # most of the index: read by document
    want = [sum(2.2 * tf / (tf + 1.2) for t, tf in zip(*np.unique(x, return_counts=True)) if t in many[0]) for x in many]
    assert np.allclose(shard.scores(0), want)
