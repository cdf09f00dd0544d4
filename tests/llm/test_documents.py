"""Encoding, packing and splitting of documents."""

import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoloom.llm import packing, splitting, token_ids
from chronoloom.llm.token_ids import VOCABULARY, Encoder, encoded, encoding

ODD = ["", " ", "\n\n \n", "a", "<|endoftext|> a", "don't we'll", "x" * 5000, "  two  spaces \n\n\tand tabs ", "é ü　漢字 かな 👩‍💻", "1234567890 " * 300, "  a \x1c b \x85 c", "a  b　\n c"]


def ids_of(text, every=3):
    return np.frombuffer(Encoder(every=every).ids(text), dtype=np.int32).tolist()


@pytest.mark.parametrize("text", ODD)
def test_chunks_give_the_ids_of_the_whole(text):
    assert ids_of(text, 1) == encoding(VOCABULARY).encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", " ", "　", "\x1c", "\t", "'s", "ab", "12", "-", "é", "漢", "word", "."]), max_size=60).map("".join))
def test_any_text(text):
    assert ids_of(text, 1) == encoding(VOCABULARY).encode_ordinary(text)


def test_the_other_library_agrees():
    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in ODD:
        assert ids_of(text) == t.encode(text, add_special_tokens=False).ids


def test_chunks_are_reused():
    e = Encoder(every=4)
    first = "The queue delays everything during a full rebuild, so wait. " * 30
    e.ids(first)
    known = len(e.known)
    e.ids("Another start. " + first)
    assert len(e.known) <= known + 3


def test_encoded_table(spark):
    rows = [(1, "some text", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encoded(df, "doc_id", "text")
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == [(1, encoding(VOCABULARY).encode_ordinary("some text")), (2, []), (3, []), (3, [])]
    assert encoded(df.limit(0), "doc_id", "text").count() == 0


def test_patterns_hold_every_length_once():
    r = random.Random(1)
    for _ in range(50):
        h = {r.randrange(1, 101): r.randrange(1, 400) for _ in range(r.randrange(1, 40))}
        made = packing.packing_patterns(h, 100)
        held = collections.Counter()
        for n, p in made:
            assert sum(p) <= 100
            held.update({k: v * n for k, v in collections.Counter(p).items()})
        assert held == h
    lengths = collections.Counter(min(1024, int(r.lognormvariate(5, 1.2)) + 1) for _ in range(20_000))
    made = sum(n for n, _ in packing.packing_patterns(lengths, 1024))
    assert made <= 1.02 * -(-sum(k * v for k, v in lengths.items()) // 1024)


def test_containers(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1, 5, 5, 5, 30, 64, 99, 100, 101, 250, 1000]), "c") for i in range(3000)] + [(7, 5, "c"), (8, None, "c"), (9, 0, "c"), (10, -3, "c")]
    df = spark.createDataFrame(rows, "key bigint, n_tokens bigint, container_id string")
    got = packing.packed(df, 100).collect()
    load, parts = collections.Counter(), collections.defaultdict(list)
    for x in got:
        load[x.container_id] += x.n_tokens
        parts[x.key].append((x.piece_no, x.from_token, x.n_tokens))
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    sizes = collections.defaultdict(list)
    for k, n, _ in rows:
        if n and n > 0:
            sizes[k].append(n)
    for k, all_sizes in sizes.items():
        assert sum(n for *_, n in parts[k]) == sum(all_sizes)
        if len(all_sizes) == 1:
            assert [n for *_, n in sorted(parts[k])] == [100] * ((all_sizes[0] - 1) // 100) + [(all_sizes[0] - 1) % 100 + 1]
    assert len(load) <= 1.03 * -(-sum(sum(v) for v in sizes.values()) // 100) + 1
    assert packing.packed(df.limit(0), 100).count() == 0


def texts():
    r = random.Random(3)
    words = "alpha beta gamma delta epsilon queue session token window cache".split()
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randrange(4, 14))).capitalize() + r.choice([".", "?", "!", '."'])
    out = ["\n\n".join(" ".join(sentence() for _ in range(r.randrange(1, 7))) for _ in range(n)) for n in (3, 30, 200)]
    out += ["x" * 9000, "a1b2c3" * 900, "漢字かな交じり文。" * 300, "👩‍💻" * 400, "word " * 3000, "\n".join(f"line {i}" for i in range(900)), "no-space-but-signs/" * 400, "é" * 4000, " " * 6000, "\n" * 3000]
    return out


@pytest.mark.parametrize("i", range(len(texts())))
def test_pieces(i):
    text, s = texts()[i], splitting.Splitter()
    got = s.pieces(text)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b, n, piece in got:
        assert piece == text[a:b] and n == len(s.encode(piece)) <= 512
    for x, y in zip(got, got[1:]):
        assert x[0] < y[0] < x[1] < y[1]
    if i in (1, 2):
        shared = [len(s.encode(text[y[0] : x[1]])) for x, y in zip(got, got[1:])]
        assert all(30 <= n <= 130 for n in shared) and 50 < sum(shared) / len(shared) < 80
        assert all(text[: x[1]].endswith((".", "?", "!", '"', "\n")) for x in got[:-1])


def cheapest(at, starts, price, limit, even, scale):
    cost = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        cost[j] = min((cost[i] + scale * (at[j] - starts[i] - even) ** 2 + price[j] for i in range(j) if at[j] - starts[i] <= limit), default=float("inf"))
    return cost[-1]


def test_cuts_are_the_cheapest():
    r = random.Random(9)
    for _ in range(1500):
        m = r.randrange(2, 40)
        at = [0, *sorted(r.sample(range(1, 400), m - 1))]
        starts = [0]
        for j in range(1, m):
            starts.append(max(starts[-1], at[max(0, j - r.randrange(0, 4))]))
        price, limit = [r.choice([1.5, 2.1, 2.5, 4.5, 21.5]) for _ in at], r.choice([20, 60, 120])
        even, scale = r.uniform(5, limit), r.choice([4 / limit**2, 0.001, 1.0])
        back, j, cost = splitting.best_cuts(at, starts, price, limit, even, scale), m - 1, 0.0
        while j > 0 and back[j] >= 0:
            size = at[j] - starts[back[j]]
            assert size <= limit
            cost, j = cost + scale * (size - even) ** 2 + price[j], back[j]
        want = cheapest(at, starts, price, limit, even, scale)
        assert want == float("inf") and j > 0 or abs(cost - want) < 1e-6


def test_dear_places_are_not_needed():
    """With every place the cheapest division is hardly cheaper."""
    few, every = splitting.Splitter(), splitting.Splitter(every_place=True)
    for text in texts()[1:3]:
        a, b = [[x[:2] for x in s.pieces(text)] for s in (few, every)]
        assert len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= len(a) // 10


@pytest.mark.parametrize("every", [1, 3])
def test_long_stretches_are_repaired(every, monkeypatch):
    """Chunks cut anywhere in texts without white space, against the tokenizer on the whole text."""
    monkeypatch.setattr(token_ids, "LONG_STRETCH", 40)
    r, e, plain = random.Random(every), token_ids.Encoder(every=every), encoding(VOCABULARY).encode_ordinary
    signs = ["don't", "'s", "''ll", "漢字", "かな", "。", "、", "a1b2", "…", "é", "e\u0301", "👩‍💻", "--", "\t", "\u3000", "x", "9", "'", "ß", "٣", "\u00a0"]
    for _ in range(300):
        text = "".join(r.choice(signs) * r.choice([1, 1, 2, 9]) for _ in range(r.randrange(1, 120)))
        assert np.frombuffer(e.ids(text), dtype=np.int32).tolist() == plain(text), text


def test_split_table(spark):
    rows = [(1, "short", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 2000, "x"), (1, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    got = splitting.split_texts(df, "doc_id", "text").collect()
    assert [tuple(r)[1:] for r in got if r.doc_id == 1] == [(0, 0, 5, 1, "short")] * 2
    assert {r.doc_id for r in got} == {1, 4} and [r.piece_no for r in got if r.doc_id == 4] == list(range(sum(r.doc_id == 4 for r in got)))
    assert splitting.split_texts(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        splitting.Splitter(100, 60)
    assert token_ids.token_counts(df, "doc_id", "text").where("doc_id = 4").collect()[0].n_tokens == len(encoding(VOCABULARY).encode_ordinary("word " * 2000))
