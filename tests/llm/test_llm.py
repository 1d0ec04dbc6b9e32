"""Operators of the training-data subpackage against brute force, on odd rows and on the small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, size string, shard int, next string, base string, found string"


def docs(spark, texts, first=0):
    """Documents with further columns whose names clash with those of operators."""
    rows = [(None if i is None else i, t, "x", "y", 7, "z", "b", "f") for i, t in
            (x if isinstance(x, tuple) else (n + first, x) for n, x in enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " ", "a", "a a a a a a", "éß \U0001F642 'll  \t\n x", "w" * 5000, "the of and", (None, "lost id"),
       (3, "a"), (4, "a a a a a a"), (4, "a a a a a a"), "+1 (743) 555-3824 and 4539 1488 0343 6467", "\x00 \x01 >  "]


def base_text(t):
    """Base spans by the plain patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            s += x - 9 * (x > 9)
        return s % 10 == 0

    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0]))


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    from glint.llm.bpe import decode_documents, encode_documents, read_ranks
    from glint.llm.queries import rank_file

    raw, pattern = rank_file()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(raw), special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeéß  \t\n\u0085\x1c漢'sl129!#-_THEthe") for _ in range(rng.randint(0, 80)))
             for _ in range(200)] + ["a" * 100, "-" * 90, "ab" * 50]
    df = docs(spark, ODD + texts)
    out = decode_documents(encode_documents(df, raw, pattern), raw).collect()
    assert len(out) == len(ODD) + len(texts)
    for r in out:
        t = r["text"] or ""
        assert r["ids"] == enc.encode_ordinary(t)
        assert bytes(r["decoded"]) == t.encode()
        assert r["size"] == "y"
    assert encode_documents(df.limit(0), raw, pattern).count() == 0


def test_bpe_lower_rank_after_a_merge():
    from glint.llm.bpe import MergeReplay

    # the pair (ab, c) has a lower rank than the merge that makes it possible
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"cab": 258}
    m = MergeReplay(ranks)
    for word in (b"abcab", b"ababc", b"cabcab", b"abababc"):
        flat, count = m.replay([word, b"abab"])
        assert flat[:count[0]].tolist() == m.one(word)


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("<p>x", "x"),
    ("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two<br>three"
     "<div class='ad'>buy</div><p>Be.</article><section class=comments><p>me too</section><footer>f</footer>",
     "A & B\n\none two three\n\nBe."),
    ("<article><p>a<form><p>b</form><aside>c</aside><script>d</script><style>e</style><p>f</article>", "a\n\nf"),
    ("<div class='sidebar'><p>s</div><div id=content><p>" + "long text " * 30 + "<p>end</div><div class='cookie-notice'>n</div>",
     ("long text " * 30).strip() + "\n\nend"),
])
def test_html(html, want):
    from glint.llm.html_text import main_text

    assert main_text(html) == want


def test_html_rows(spark):
    from glint.llm.html_text import extract_main_text

    df = spark.createDataFrame([(1, None, "k"), (1, "<article>x</article>", "k"), (None, "<p>y", "k")],
                               "page_id long, html string, main_text string")
    assert sorted(r["main_text"] for r in extract_main_text(df).collect()) == ["", "x", "y"]
    assert extract_main_text(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    from glint.llm.warc import mark_revisits, read_bundles, read_record, record_index, write_bundles

    long = "<p>" + "xé" * 60
    rows = [(5, "http://a/é b", long), (3, None, long), (3, None, long), (None, "u", long), (7, "u", "short"),
            (8, "u", "short"), (9, "u", None), (10, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("q"))
    b = write_bundles(mark_revisits(df).repartition(1), "2024-01-01T00:00:00Z", frame_bytes=300).cache()
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"])
                  for r in read_bundles(b).collect()), key=str)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = h == long and p != 3
        want.append((p, "revisit" if again else "response", 3 if again else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want, key=str)
    files = {r["bundle_id"]: bytes(r["bundle_bytes"]) for r in b.collect()}
    index = record_index(b).collect()
    assert len({r["record_id"] for r in index}) == len(rows) and len({r["frame"] for r in index}) > 1
    for r in index:
        assert read_record(files[r["bundle_id"]], r["frame"], r["offset"], r["length"])["record_id"] == r["record_id"]
    assert write_bundles(mark_revisits(df.limit(0)), "d").count() == 0


def test_shards(spark):
    from glint.llm.histogram_shard import shard_by_bytes

    rng = random.Random(2)
    texts = ODD + ["t" * rng.randint(1, 300) for _ in range(400)] + ["same text"] * 300
    out = shard_by_bytes(docs(spark, texts), shards=5).collect()
    assert len(out) == len(texts)
    total = {}
    for r in out:
        n = len((r["text"] or "").encode()) + 8
        assert r["size"] == n
        total.setdefault(r["shard"], []).append((r["slot"], n))
    for rows in total.values():
        assert sorted(s for s, _ in rows) == list(range(len(rows)))
    sums = [sum(n for _, n in total[s]) for s in range(5)]
    assert max(sums) - min(sums) <= 2 * 5008
    assert shard_by_bytes(docs(spark, texts).limit(0)).count() == 0


def test_pii_base_spans(spark):
    from glint.llm.pii import find_spans, joined, redact, train

    rng = random.Random(3)
    parts = ["a.b@c.de", "x@y", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "000255.1.1.1", "4539 1488 0343 6467", "4539-1488 03436467",
             "+1 (743) 555-3824", "+44 20", "@", ".", "-", " ", "_", "+", "12", "é\U0001F642", "123456789012345678901", "w@a.b_c@d.ef"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["9" * 4000, "a" * 4000 + "@b.c"]
    df = docs(spark, ODD + texts)
    model = train(df)
    rows = find_spans(df, model).select("text", joined("base").alias("b"), joined("found").alias("f")).collect()
    assert len(rows) == len(ODD) + len(texts)
    for r in rows:
        assert r["b"] == base_text(r["text"] or "")
        assert set(filter(None, r["b"].split(","))) <= set(r["f"].split(","))
    red = redact(docs(spark, ["mail a.b@c.de now", None, "", "ip 1.2.3.4"]), None).orderBy("doc_id").collect()
    assert [r["text"] for r in red] == ["mail [EMAIL] now", None, "", "ip [IP]"]
    empty = df.limit(0)
    assert train(empty) is None and find_spans(empty, None).count() == 0


def brute_repeats(rows, k):
    first = {}
    for i, b in rows:
        for p in range(len(b) - k + 1):
            s = b[p:p + k]
            first[s] = min(first.get(s, 1 << 62), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if first[b[p:p + k]] < i:
                gone[p:p + k] = b"\1" * k
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def test_repeats(spark):
    from glint.llm.suffix_dedup import find_repeats

    rng = random.Random(4)
    pool = ["".join(rng.choice("abcd é") for _ in range(rng.randint(20, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) for _ in range(60)] + ["a" * 300, "a" * 120, "ab" * 99]
    rows = [(n + 100, t) for n, t in enumerate(texts)] + [(101, texts[1]), (7, "a" * 60), (None, texts[3]), (8, None), (9, "")]
    out = find_repeats(docs(spark, rows)).collect()
    last = np.iinfo(np.int64).max
    want = brute_repeats([(last if i is None else i, (t or "").encode()) for i, t in rows], 50)
    assert sorted((last if r["doc_id"] is None else r["doc_id"], bytes(r["kept"])) for r in out) == want
    for r in out:
        assert r["n_bytes"] - sum(s["end"] - s["start"] for s in r["spans"]) == len(r["kept"])
    assert find_repeats(docs(spark, rows).limit(0)).count() == 0


def test_near_duplicates(spark):
    from glint.llm.minhash import keep_one, least_matches, near_duplicates

    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            edit = list(base)
            for _ in range(rng.randint(0, 4)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            texts.append(" ".join(edit) if rng.random() < 0.7 else "\t".join(edit).upper())
    rows = [(i + 10, t) for i, t in enumerate(texts)] + [(3, "One two"), (4, "one\x0btwo"), (5, ""), (6, None), (None, "one two"),
                                                         (3, "One two")]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    out = near_duplicates(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        i = r["doc_id"]
        assert (r["component_id"], r["kept"]) == ((root(i), root(i) == i) if i is not None else (None, True))
        if i is not None:
            assert r["n_shingles"] == len(sets[i])
    assert {r["doc_id"] for r in keep_one(docs(spark, rows)).collect()} == {i for i in sets if root(i) == i} | {None}
    assert near_duplicates(docs(spark, rows).limit(0)).count() == 0
    least = least_matches(3, 4, 128, 32, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 96


def test_spot_signatures(spark):
    from glint.llm.spotsigs import (ANCHORS, add_signatures, edited_text, fingerprint, likeness, similar_fingerprints,
                                    with_next)

    rng = random.Random(8)
    vocab = sorted(ANCHORS)[:30] + [f"content{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = ODD + texts
    df = docs(spark, rows)
    d = with_next(df, add_signatures, ["text", "sigs"])
    d = d.withColumn("e", edited_text(F.col("text"), F.col("next.text"))).withColumn("nt", F.col("next.text"))
    got = d.select("doc_id", "text", "e", "nt", fingerprint(F.col("sigs")).alias("f"),
                   likeness(F.col("sigs"), F.col("next.sigs")).alias("l")).collect()
    assert len(got) == len(rows)

    def spots(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        at = [i for i, x in enumerate(w) if x not in ANCHORS]
        found = {(w[i - 1], w[i], w[j]) for i, j in zip(at, at[1:], strict=False) if i and w[i - 1] in ANCHORS}
        return found or ({tuple(w)} if w else set())

    for r in got:
        t, n = r["text"] or "", r["nt"] or ""
        q = len(t) // 4
        assert r["e"] == t[:len(t) - q] + n[:q]
        a, b = spots(t), spots(n)
        assert len(r["f"]) == 8 * len(a)
        assert r["l"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    ordered = sorted((r for r in got if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    assert len({r["doc_id"] for r in ordered}) == len(ordered) - 3
    assert with_next(df.limit(0), add_signatures, ["text"]).count() == 0

    sets = [(i, sorted({rng.randrange(20 + i % 3) for _ in range(rng.randint(0, 14))})) for i in range(120)]
    pairs = {(r["a"], r["b"]): r["similarity"] for r in similar_fingerprints(
        spark.createDataFrame(sets, "id long, sigs array<long>")).collect()}
    one = {}
    for i, s in sets:
        if s:
            one.setdefault(tuple(s), i)
    reps = [(i, set(s)) for s, i in one.items()]
    want = {(min(a, b), max(a, b)): len(x & y) / len(x | y) for a, x in reps for b, y in reps
            if a < b and len(x & y) >= 0.75 * len(x | y)}
    assert pairs == pytest.approx(want)


def test_contamination(spark):
    from glint.llm.decontam import common_subsequence, contaminated, without_contamination

    rng = random.Random(9)
    words = ["the", "of", "and"] * 40 + [f"x{i}" for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(30))) for i in range(10)] + [(10, ""), (11, None), (None, "x1 x2"),
                                                          (12, " ".join(say(25)) + "? Answer: x77 x78")]
    rows = [(i, " ".join(say(rng.randint(1, 400)))) for i in range(150)]
    planted = set()
    for d in range(150, 162):
        i = d % 10
        w = items[i][1].upper().split()
        if d % 3 == 0:                      # a paraphrase: some words replaced
            for k in range(0, len(w), 6):
                w[k] = "other"
        rows.append((d, " ".join(say(90)) + ".\n" + ", ".join(w) + " " + " ".join(say(70))))
        planted.add((d, i))
    rows += [(None, items[0][1]), (200, None), (201, ""), (202, items[12 + 1][1]), (203, items[13][1].split("?")[0] + "? Answer: no no")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs(spark, rows), bench).collect()}
    assert got == planted | {(202, 12)}
    left = {r["doc_id"] for r in without_contamination(docs(spark, rows), bench).collect()}
    assert left == {i for i, _ in rows} - {d for d, _ in got}
    assert contaminated(docs(spark, rows).limit(0), bench).count() == 0
    assert contaminated(docs(spark, rows), bench.limit(0)).count() == 0
    assert common_subsequence(list("abcbdab"), list("bdcaba")) == 4


def test_contamination_of_frequent_items(spark):
    from glint.llm.decontam import contaminated

    rng = random.Random(19)
    say = lambda n: [f"x{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(say(34))) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, " ".join(say(rng.randint(30, 200)))) for i in range(120)]
    rows += [(1000 + i, " ".join(say(50) + items[0][1].split() + say(50))) for i in range(60)]
    rows += [(2000, " ".join(say(50) + items[3][1].split() + say(50)))]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs(spark, rows), bench).collect()}
    assert got == {(1000 + i, 0) for i in range(60)} | {(2000, 3)}     # an item in a third of the rows
    few = [(0, " ".join(say(9)) + " " + items[5][1]), (1, items[5][1] + " " + " ".join(say(60))), (2, "x1 and x2")]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs(spark, few), bench).collect()}
    assert got == {(0, 5), (1, 5)}                                      # three documents


def test_contamination_of_long_items(spark):
    from glint.llm.decontam import contaminated

    rng = random.Random(29)
    say = lambda n: [f"x{rng.randrange(9000)}" for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate((30, 97, 250, 400, 1000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, " ".join(say(rng.randint(30, 1200)))) for i in range(100)]
    rows += [(1000 + i, " ".join(say(70) + t.split() + say(50))) for i, t in items]
    for i, t in items:                                    # a paraphrase: a quarter of the words replaced
        rows.append((2000 + i, " ".join(w if k % 4 else "other" for k, w in enumerate(t.split()))))
    rows.append((3000, " ".join(items[3][1].split()[:200])))              # half an item
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs(spark, rows), bench).collect()}
    assert got == {(first + i, i) for i, _ in items for first in (1000, 2000)}


def test_toxicity(spark):
    from glint.llm.toxicity import best_threshold, classify

    rng = random.Random(10)
    say = lambda n: [f"word{rng.randrange(200)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        w = say(rng.randint(5, 60))
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = f"vilest{rng.randrange(1000)}"       # a stem with any ending
        rows.append((i, " ".join(w)))
        if i < 300:
            labels.append((i, int(rng.random() < 0.5), int(toxic)))
    rows += [(900, None), (901, ""), (None, "vilestx word1"), (0, rows[0][1])]
    labels += [(None, 1, 1), (950, None, 1), (5, 1, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = classify(docs(spark, rows), lab).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    assert sum(r["toxic"] == (r["doc_id"] % 5 == 0) for r in held) >= 98
    assert not any(r["toxic"] for r in out if not r["text"])
    assert not any(r["toxic"] for r in classify(docs(spark, rows), lab.limit(0)).collect())
    assert classify(docs(spark, rows).limit(0), lab).count() == 0
    assert 0.2 <= best_threshold(np.array([0.1, 0.9, 0.3]), np.array([0, 1, 1])) <= 0.3 and best_threshold(np.zeros(2), np.zeros(2)) > 1


def test_pipeline_keeps_columns_and_decodes(spark):
    import corpus_pipeline as c
    from glint.llm.common import stored
    from glint.llm.queries import table

    d = table(spark, SF, "documents")
    last = d
    for name, stage in c.STAGES[:-1]:
        nxt = stored(stage(spark, last, SF), f"test-{name}")
        assert nxt.columns == d.columns
        assert nxt.count() <= last.count() and nxt.select("doc_id").exceptAll(last.select("doc_id")).isEmpty()
        last = nxt
    out = c.tokenise(spark, last, SF).join(last.select("doc_id", F.sha2("text", 256).alias("h")), "doc_id")
    assert out.count() == last.count() and out.filter("h <> decoded_sha256").isEmpty()
