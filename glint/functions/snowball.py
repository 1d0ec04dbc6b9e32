"""Snowball English stemming (V2) of a table of distinct terms, as built-in column expressions.

The published algorithm ("Porter2"): regions R1 and R2, marked consonant Y, exception lists, steps
0 to 5. Every step is a ``when`` chain over the state of the step before it, so it stays in the JVM;
``stem_counts`` stems each distinct term once and joins the stems back.
Letters outside a-z count as consonants, as in the published definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm: exceptions, suffixes and their replacements.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
AFTER_1A = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
R1_PREFIXES = ["gener", "commun", "arsen"]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
STEP2 = [
    ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"),
    ("izer", "ize"), ("ization", "ize"), ("ational", "ate"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"),
    ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"),
    ("ogi", "og"), ("fulli", "ful"), ("lessli", "less"), ("li", ""),
]
STEP3 = [
    ("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", ""),
]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate",
         "iti", "ous", "ive", "ize", "ion"]
LI_ENDING = "cdeghkmnrt"

V, C = "[aeiouy]", "[^aeiouy]"
REGION = f"^{C}*{V}+{C}"
SHORT_SYLLABLE = f"({C}{V}[^aeiouywxY]$)|(^{V}{C}$)"


def _cut(w: Column, n: int, more: str = "") -> Column:
    kept = F.substring(w, F.lit(1), F.length(w) - n)
    return F.concat(kept, F.lit(more)) if more else kept


def _longest(w: Column, rules: list, allowed) -> Column:
    """The longest suffix that ``w`` ends with is replaced where ``allowed(suffix)`` holds; no other is tried."""
    out = None
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        then = F.when(allowed(suffix), _cut(w, len(suffix), new)).otherwise(w)
        out = F.when(w.endswith(suffix), then) if out is None else out.when(w.endswith(suffix), then)
    return out.otherwise(w)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _state(s: Column, w: Column, stop: Column | None = None) -> Column:
    return F.struct(w.alias("w"), s["r1"].alias("r1"), s["r2"].alias("r2"),
                    (s["stop"] if stop is None else stop).alias("stop"))


def _in(w: Column, region: Column):
    return lambda suffix: F.length(w) - len(suffix) >= region


def _marked(term: Column) -> Column:
    """Without a leading apostrophe; y that counts as a consonant as Y."""
    w = F.regexp_replace(term, "^'", "")
    return F.regexp_replace(F.regexp_replace(w, "^y", "Y"), f"({V})y", "$1Y")


def _regions(w: Column) -> Column:
    """State: the word, where R1 and R2 begin, and whether it is done."""
    prefix = F.length(F.regexp_extract(w, f"^({'|'.join(R1_PREFIXES)})", 0))
    plain = F.length(F.regexp_extract(w, REGION, 0))
    r1 = F.when(prefix > 0, prefix).when(plain > 0, plain).otherwise(F.length(w))

    def with_r2(r1: Column) -> Column:
        rest = F.length(F.regexp_extract(F.substring(w, r1 + 1, F.length(w)), REGION, 0))
        r2 = F.when(rest > 0, r1 + rest).otherwise(F.length(w))
        return F.struct(w.alias("w"), r1.alias("r1"), r2.alias("r2"), F.lit(False).alias("stop"))
    return _let(r1, with_r2)


def _step_0(s: Column) -> Column:
    return _state(s, F.regexp_replace(s["w"], "('s'|'s|')$", ""))


def _step_1a(s: Column) -> Column:
    w = s["w"]
    return _state(s, F.when(w.endswith("sses"), _cut(w, 2))
                  .when(w.endswith("ied") | w.endswith("ies"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
                  .when(w.endswith("us") | w.endswith("ss"), w)
                  .when(w.rlike(f"(?s){V}.+s$"), _cut(w, 1)).otherwise(w))


def _done(s: Column) -> Column:
    return _state(s, s["w"], s["w"].isin(AFTER_1A))


def _step_1b(s: Column) -> Column:
    """Past and present participles, then the ends that a deletion leaves."""
    w = s["w"]
    cut = (F.when(s["stop"] | w.endswith("eedly") | w.endswith("eed"), F.lit(None).cast("string"))
           .when(w.rlike(f"(?s){V}.*ingly$"), _cut(w, 5)).when(w.rlike(f"(?s){V}.*edly$"), _cut(w, 4))
           .when(w.rlike(f"(?s){V}.*ing$"), _cut(w, 3)).when(w.rlike(f"(?s){V}.*ed$"), _cut(w, 2)))

    def mended(left: Column) -> Column:
        return (F.when(left.isNull(), _longest(w, [("eedly", "ee"), ("eed", "ee")], _in(w, s["r1"])))
                .when(left.rlike("(at|bl|iz)$"), F.concat(left, F.lit("e")))
                .when(left.rlike(f"({'|'.join(DOUBLES)})$"), _cut(left, 1))
                .when((F.length(left) <= s["r1"]) & left.rlike(SHORT_SYLLABLE), F.concat(left, F.lit("e")))
                .otherwise(left))
    return _state(s, F.when(s["stop"], w).otherwise(_let(cut, mended)))


def _step_1c(s: Column) -> Column:
    w = s["w"]
    return _state(s, F.when(~s["stop"] & w.rlike(f"(?s).{C}[yY]$"), _cut(w, 1, "i")).otherwise(w))


def _step_2(s: Column) -> Column:
    w, r1 = s["w"], _in(s["w"], s["r1"])
    before = {"ogi": "logi$", "li": f"[{LI_ENDING}]li$"}
    new = _longest(w, STEP2, lambda x: r1(x) & w.rlike(before[x]) if x in before else r1(x))
    return _state(s, F.when(s["stop"], w).otherwise(new))


def _step_3(s: Column) -> Column:
    w, r1, r2 = s["w"], _in(s["w"], s["r1"]), _in(s["w"], s["r2"])
    new = _longest(w, STEP3, lambda x: r1(x) & r2(x) if x == "ative" else r1(x))
    return _state(s, F.when(s["stop"], w).otherwise(new))


def _step_4(s: Column) -> Column:
    w, r2 = s["w"], _in(s["w"], s["r2"])
    new = _longest(w, [(x, "") for x in STEP4], lambda x: r2(x) & w.rlike("[st]ion$") if x == "ion" else r2(x))
    return _state(s, F.when(s["stop"], w).otherwise(new))


def _step_5(s: Column) -> Column:
    w, r1, r2 = s["w"], _in(s["w"], s["r1"]), _in(s["w"], s["r2"])
    final_e = w.endswith("e") & (r2("e") | (r1("e") & ~_cut(w, 1).rlike(SHORT_SYLLABLE)))
    return _state(s, F.when(~s["stop"] & (final_e | (w.endswith("ll") & r2("l"))), _cut(w, 1)).otherwise(w))


def stem(term) -> Column:
    """Snowball English stem of a lower-case term (null stays null; up to two letters stay as they are)."""
    t = F.col(term) if isinstance(term, str) else term
    steps = [_regions, _step_0, _step_1a, _done, _step_1b, _step_1c, _step_2, _step_3, _step_4, _step_5]

    def chain(value: Column, rest: list) -> Column:
        return _let(value, lambda s: chain(rest[0](s), rest[1:])) if rest else F.translate(value["w"], "Y", "y")
    known = F.create_map(*[F.lit(x) for pair in EXCEPTIONS.items() for x in pair])
    return F.when(F.length(t) <= 2, t).when(t.isin(list(EXCEPTIONS)), F.element_at(known, t)).otherwise(
        chain(_marked(t), steps))


def stem_terms(terms: DataFrame, term: str = "term", out: str = "stem") -> DataFrame:
    """``terms`` with the stem of ``term``."""
    return terms.withColumn(out, stem(term))


def stem_counts(counts: DataFrame, keys: list[str], count: str = "tf", keep: tuple = (),
                by: list[str] | None = None) -> DataFrame:
    """Counts per (``keys``, term) regrouped by stem: ``keys, term, count, keep``.

    Each distinct term is stemmed once (one row per term after a partial aggregate) and joined back.
    ``keep``: columns that depend on ``keys`` alone; ``by``: deal the rows by these keys before they are grouped, so that
    a later grouping by them moves nothing.
    """
    stems = stem_terms(counts.select("term").distinct())
    out = counts.join(stems, "term", "left").withColumn("term", F.coalesce("stem", "term")).drop("stem")
    out = out.repartition(*by) if by else out
    return out.groupBy(*keys, "term").agg(F.sum(count).alias(count), *[F.first(k).alias(k) for k in keep])
