"""Snowball English: published pairs, and a plain Python form of the algorithm over many words."""

import random
import re

import pytest

from glint.functions import snowball as S

# Published examples of the algorithm's description and sample vocabulary.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri
knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel
kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife
knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob
knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp
knot knot knots knot caresses caress ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoping hope
falling fall failing fail filing file luxuriating luxuri hopped hop hoped hope by by say say cry cri enjoy enjoy
generate generat generic generic generous generous communism communism community communiti arsenal arsenal
sky sky skies sky dying die news news inning inning innings inning proceed proceed proceeding proceed exceed exceed
herring herring herrings herring agreed agre bed bed sing sing beautiful beauti beautifully beauti rational ration
relational relat vietnamization vietnam analogously analog rate rate roll roll controlling control probate probat
cease ceas a a is is yes yes youth youth boyish boyish bee bee beef beef""".split()
PAIRS = dict(zip(PAIRS[::2], PAIRS[1::2], strict=True))


def plain(w):
    """The algorithm letter by letter."""
    if len(w) <= 2:
        return w
    if w in S.EXCEPTIONS:
        return S.EXCEPTIONS[w]
    w = list(w[1:] if w[0] == "'" else w)
    vowel = lambda c: c in "aeiouy"
    i = 0
    if w and w[0] == "y":
        w[0] = "Y"
    while i + 1 < len(w):
        if vowel(w[i]) and w[i + 1] == "y":
            w[i + 1] = "Y"
            i += 1
        i += 1
    w = "".join(w)

    def region(start):
        i = start
        while i < len(w) and not vowel(w[i]):
            i += 1
        while i < len(w) and vowel(w[i]):
            i += 1
        return i + 1 if i < len(w) else len(w)

    r1 = next((len(p) for p in S.R1_PREFIXES if w.startswith(p)), None) or region(0)
    r2 = region(r1)

    def short(s):
        if len(s) == 2:
            return vowel(s[0]) and not vowel(s[1])
        return len(s) > 2 and not vowel(s[-1]) and s[-1] not in "wxY" and vowel(s[-2]) and not vowel(s[-3])

    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[:-len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(vowel(c) for c in w[:-2]):
        w = w[:-1]
    if w in S.AFTER_1A:
        return w
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            rest = w[:-len(s)]
            if s.startswith("eed"):
                w = rest + "ee" if len(rest) >= r1 else w
            elif any(map(vowel, rest)):
                w = rest
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-2:] in S.DOUBLES:
                    w = w[:-1]
                elif r1 >= len(w) and short(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and not vowel(w[-2]):
        w = w[:-1] + "i"
    for n, rules in ((2, S.STEP2), (3, S.STEP3), (4, [(s, "") for s in S.STEP4])):
        found = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if found:
            s, new = found
            rest = w[:-len(s)]
            ok = len(rest) >= (r2 if n == 4 or s == "ative" else r1)
            if n == 2 and s == "ogi":
                ok = ok and rest.endswith("l")
            if n == 2 and s == "li":
                ok = ok and rest[-1:] != "" and rest[-1:] in S.LI_ENDING
            if n == 4 and s == "ion":
                ok = ok and rest[-1:] in ("s", "t")
            if ok:
                w = rest + new
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "term string")
    return {r["term"]: r["stem"] for r in S.stem_terms(df).collect()}


def words():
    rng = random.Random(11)
    ends = [s for s, _ in S.STEP2 + S.STEP3] + S.STEP4 + ["s", "es", "ed", "ing", "edly", "ingly", "eed", "eedly", "y",
                                                         "ies", "'s", "'", "e", "ll", "ss", "us", "ogi", "sses"]
    heads = ["gener", "commun", "arsen", "b", "tr", "y", "say", "hop", "fal", "l", "mat", "siz", "trouble", "écol", "x9"]
    out = {"".join(rng.choice("abceilmnorstuyxw'") for _ in range(rng.randint(1, 9))) for _ in range(1500)}
    for _ in range(2500):
        out.add(rng.choice(heads) + "".join(rng.choice("aeioutnlsyr") for _ in range(rng.randint(0, 4)))
                + "".join(rng.choice(ends) for _ in range(rng.randint(1, 2))))
    return sorted(out | set(S.AFTER_1A) | set(S.EXCEPTIONS) | {"ayy", "yyy", "sayyid", "漢字s", "🙂ing", "\nings"})


def test_published_pairs(spark):
    got = stems(spark, list(PAIRS))
    assert {w: got[w] for w in PAIRS} == PAIRS
    assert {w: plain(w) for w in PAIRS} == PAIRS


def test_equals_plain_form(spark):
    some = words()
    got = stems(spark, some)
    assert {w: got[w] for w in some} == {w: plain(w) for w in some}


def test_given_vocabulary(spark, sf_small):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()]
    some = sorted({w for t in texts for w in re.findall(r"[^\W_]+", t.lower())})
    got = stems(spark, some)
    assert {w: got[w] for w in some} == {w: plain(w) for w in some}


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "term string")
    assert sorted((r["stem"] for r in S.stem_terms(df).collect()), key=str) == ["", None]


def test_counts_regroup_by_stem(spark):
    df = spark.createDataFrame([(1, "run", 2, 9), (1, "runs", 3, 9), (1, "running", 1, 9), (2, "runs", 4, 5),
                                (2, "漢", 1, 5)], "doc_id int, term string, tf int, dl int")
    got = sorted(tuple(r) for r in S.stem_counts(df, ["doc_id"], keep=("dl",)).collect())
    assert got == [(1, "run", 6, 9), (2, "run", 4, 5), (2, "漢", 1, 5)]


def test_stemming_stays_in_the_jvm(spark):
    from tests.test_plans import plan_of

    df = spark.range(9).selectExpr("id AS doc_id", "concat('run', id) AS term", "id AS tf")
    plan = plan_of(S.stem_counts(df, ["doc_id"]))
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("word", ["consign", "knaves"])
def test_plain_form_is_stable_on_these(word):
    assert plain(plain(word)) == plain(word)
