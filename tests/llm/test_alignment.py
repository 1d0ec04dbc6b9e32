"""Tokenizer alignment against token bytes joined one by one, and pairs counted in dictionaries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from glint.llm import alignment as al
from glint.llm.queries import vocabulary_file
from tests.llm.test_llm import ODD, docs

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute(rows):
    """Result rows for (doc_id, text): ids from the libraries, bytes of each token, all links as a list."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a = Tokenizer.from_file(P.path(FILE_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path(FILE_B))
    letters = {}
    for c in [*range(0x800), *range(0x800, 0xD800, 64), *range(0xE000, 0x10000, 64), *range(0x10000, 0x110000, 4096)]:
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]
        letters |= zip(shown, chr(c).encode(), strict=True)      # which letter stands for which byte

    def bytes_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else \
            b.id_to_piece(i).replace("▁", " ").encode()

    found, held = [], Counter()
    for i, t in rows:
        groups = []
        if t:
            ia, ib, raw = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t), (" " + t).encode()
            ta, tb = [bytes_a(x) for x in ia], [bytes_b(x) for x in ib]
            if b"".join(ta) == raw and b"".join(tb) == raw:
                ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
                low = 0
                for e in sorted(set(ea) & set(eb)):
                    groups.append(([x for x, k in zip(ia, ea, strict=True) if low < k <= e],
                                   [x for x, k in zip(ib, eb, strict=True) if low < k <= e]))
                    low = e
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        held.update(set(links))
        found.append((i, groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups, links in found:
        line = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), len(links),
                    sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links),
                    hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r))


def texts():
    rng = random.Random(3)
    hard = ["<|endoftext|> and <s> </s> <0x41> <unk>", "▁ low line", "é" * 40, "漢字かな交じり文 한국어", "🙂👩‍👩‍👧 x",
            "é combining ﬁ ①", "   spaces  \t\n\r\n", "a" * 300, " lead and trail ", "\x00\x01\x7f",
            "ﷺ\U0001F468\U0001F3FD", "=" * 200, "0123456789" * 20, "ελληνικά русский עברית", "﻿ bom", "a\x1cb \x1c c\u2003 d \u00a0e\u3000 f  g",
            "one two\u2581three four", " x", "x ", "  ", "a b"]
    made = ["".join(rng.choice("abc dé漢🙂 \n\t.,'sTh=1" + "▁" * (n % 5 == 0))
                    for _ in range(rng.randint(0, 60))) for n in range(150)]
    return hard + made + ["the same text over and over again"] * 30


def test_alignment_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(al, "SLICE_BYTES", 300)
    monkeypatch.setattr(al, "BLOCK_BYTES", 900)
    monkeypatch.setattr(al, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(al, "KNOWN_PARTS", 60)
    df = docs(spark, ODD + texts())
    got = [tuple(r) for r in al.align(df, vocabulary_file(FILE_A), vocabulary_file(FILE_B)).collect()]
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert order(got) == order(want)
    assert sum(r[1] == 0 for r in want) < len(want) / 2


def test_given_documents_equal_brute_force(spark, sf_small):
    from glint.llm.queries import QUERIES

    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op13_alignment"](spark, sf_small).collect()]
    assert order(got) == order(brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]))


def test_no_rows(spark):
    assert al.align(docs(spark, ["a"]).limit(0), vocabulary_file(FILE_A), vocabulary_file(FILE_B)).collect() == []


def test_byte_fallback_and_shared_characters_are_refined():
    # cut 4 is shared by three tokens of 1, 1 and 2 bytes; then one of 3 bytes
    assert al.refine(np.array([4, 4, 4, 7]), np.array([1, 1, 2, 3])).tolist() == [1, 2, 4, 7]
    tok = al.coder(al.Pieces, vocabulary_file(FILE_B))
    ids, ends = tok.encode(["漢x"])
    assert len(set(ends[0])) < len(ends[0]) == len(ids[0])         # byte tokens have no span of their own


def test_trimmed_spans_give_way_to_decoded_bytes():
    tok = al.coder(al.ByteLevel, vocabulary_file(FILE_A))
    raw = b" a b"
    ids, spans = tok.encode(["a b"])
    args = (np.zeros(2, np.int64), np.frombuffer(raw, np.uint8), np.array([0]), np.array([True]))
    assert al.token_ends(tok, np.array(ids[0]), np.array(spans[0]), *args).tolist() == [2, 4]
    assert al.token_ends(tok, np.array(ids[0]), np.array([1, 3]), *args).tolist() == [2, 4]


@pytest.mark.parametrize("n", [1, 10, 11, 1000])
def test_digits(n):
    rows, width = al._digits(n)
    assert [bytes(r[:w]).decode() for r, w in zip(rows, width, strict=True)] == [str(i) for i in range(n)]


def test_workers_give_memory_back_after_encoding(spark, monkeypatch):
    from glint.llm import alignment

    tidied = []
    monkeypatch.setattr(alignment, "releasing", lambda run: tidied.append(run.__name__) or run, raising=False)
    monkeypatch.setattr(alignment, "stored", lambda df, name: df)
    alignment.encode_blocks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), b"", b"")
    assert tidied == ["run"]
