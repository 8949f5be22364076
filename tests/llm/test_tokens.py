import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dockside.llm.packing import Mixture, WordEncoder, pack
from dockside.llm.token_counts import Counter, check_rules, longest_within, prefix_tables, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = "abcdehilorst '\n\t  !.,12éßñ漢  \x1c\r<|>'sΣİ"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    return made + [
        "a<|endoftext|>b", "  <|endoftext|> ", "it's we'll 'rest '", "ΑΣ ΣΑΣ", "x ́y", "é x",
        "abc\x1cdef! \x1c!", "abc" * 900, "", " ", "a b c ", "\na b", " a b\n\nc d", "<|startoftext|>x",
    ]


def test_counts_and_prefixes(texts):
    library, own = Tokenizer.from_file(BYTES), Counter(BYTES)

    def n(t):
        return len(library.encode(t, add_special_tokens=False).ids)

    assert own.count_all(pa.array(texts)) == [n(t) for t in texts]
    for t in texts[:150] + texts[-14:-7]:
        assert own.prefixes(t).tolist() == [n(t[:i]) for i in range(len(t) + 1)]


def test_ids(texts):
    library, own = Tokenizer.from_file(WORDS), WordEncoder(WORDS)
    for _ in range(2):
        flat, cuts = own.encode(pa.array(texts))
        for t, a, b in zip(texts, cuts, cuts[1:]):
            assert flat[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_words_met_before_are_not_encoded_again():
    letters = "abcdefghijklmnop"
    words = ["".join(letters[i >> shift & 15] for shift in (0, 4, 8, 12, 16)) for i in range(250_000)]
    own = WordEncoder(WORDS)
    batch = pa.array([" ".join(words)])
    ids, cuts = own.encode(batch)
    own.tokenizer = None  # not needed a second time
    again, cuts_again = own.encode(batch)
    assert ids.tolist() == again.tolist() and cuts.tolist() == cuts_again.tolist()


def test_token_counts(make_docs, corpus):
    library = Tokenizer.from_file(BYTES)
    want = []
    for i, t in corpus:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    got = [tuple(r) for r in token_counts(make_docs(corpus), BYTES).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_counts(make_docs([]), BYTES).collect() == []


def test_budget(make_docs):
    docs = make_docs([(1, "the quick brown fox jumps"), (2, None)])
    table = prefix_tables(docs, BYTES)
    got = {r.doc_id: r.n for r in table.select("doc_id", longest_within("prefix_tokens", 3).alias("n")).collect()}
    assert got == {1: len("the quick brown"), 2: 0}


def check_packed(rows, got, length=2048):
    library = Tokenizer.from_file(WORDS)
    wanted = defaultdict(int)
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        wanted[i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)] += 1
    by_sequence = defaultdict(list)
    by_doc = defaultdict(list)
    for r in got:
        assert r.length > 0
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    full = 0
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        full += at == length
    assert full >= len(by_sequence) - 1
    for (i, _, n), times in wanted.items():
        assert sum(p[1] for p in by_doc[i]) == sum(k[2] * c for k, c in wanted.items() if k[0] == i)
    single = {i: k for k in wanted for i in [k[0]] if sum(w[0] == i for w in wanted) == 1 and wanted[k] == 1}
    for i, key in single.items():
        at = 0
        for start, n, crc, tokens in sorted(by_doc[i]):
            assert start == at and tokens == key[2]
            at += n
        if len(by_doc[i]) == 1:
            assert by_doc[i][0][2] == key[1]


def test_packing_is_whole(make_docs, corpus):
    got = pack(make_docs(corpus), WORDS).collect()
    check_packed(corpus, got)


def test_packing_with_targets(make_docs, corpus):
    got = pack(make_docs(corpus), WORDS, 64, 4, {"s0": 0.7, "s1": 0.3}).collect()
    check_packed(corpus, got, 64)


def test_piece_checksums(make_docs):
    library = Tokenizer.from_file(WORDS)
    rows = [(1, "alpha beta gamma " * 40), (2, "delta " * 70)]
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    for r in pack(make_docs(rows), WORDS, 16, 2).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def test_empty_table(make_docs):
    assert pack(make_docs([]), WORDS).collect() == []


def test_every_window_has_the_shares():
    mixture = Mixture({"a": 70_000, "b": 29_999, "c": 1}, 1000)
    last = [0, 0, 0]
    for k in range(1, 100):
        now = mixture.given(k)
        got = [x - y for x, y in zip(now, last)]
        assert abs(got[0] - 700) <= 1 and abs(got[1] - 300) <= 1
        last = now
    stream = []
    for s in "abc":
        stream += [(at, at + n) for _, n, at in mixture.segments(s, 0, mixture.totals[mixture.place[s]])]
    stream.sort()
    assert stream[0][0] == 0 and stream[-1][1] == 100_000
    assert all(a[1] == b[0] for a, b in zip(stream, stream[1:]))


@pytest.mark.parametrize(
    "change",
    [
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"added_tokens": [{"id": 0, "content": "<s>", "lstrip": True}]},
        {"model": {"type": "BPE", "ignore_merges": True}},
        {"model": {"type": "Unigram"}},
    ],
)
def test_a_vocabulary_of_other_rules_is_refused(change):
    with open(BYTES, encoding="utf-8") as file:
        held = json.load(file)
    check_rules(held)
    with pytest.raises(ValueError, match="other rules"):
        check_rules(held | change)
