"""Personal data: candidate spans, boosted trees, calibrated thresholds. DataFrame operations only.

Base rules find e-mail addresses, IP addresses, card and phone numbers; their spans always
stay. High-recall generators propose further, possibly overlapping spans (written-out
addresses, numbers with other separators). Boosted trees score each candidate by features
of its format and context. They are trained on a bounded sample of documents (``train_docs``,
least hash of doc_id), each taken three times: as it is, where a candidate that a base rule confirms is a
positive and any other a negative, and with its addresses and phone numbers rewritten in place into forms
that no base rule finds (spelt-out addresses, national numbers), where these are the positives and
what else the generators propose the negatives, and with phone numbers replaced by numbers that are nobody's
(plain runs, years, dates, amounts), all negatives. Per kind, the least score at which held-out candidates reach ``precision`` is the
threshold; a candidate at or above it that overlaps no base span becomes a span.

The trees become one SQL expression, so that scoring runs inside the scan's stage: no
shuffle, no row per candidate. Offsets are code points, end exclusive. They come from the
lengths of matches and of the gaps between them, both by the same regular expression.

Defined cases: null text is empty text; a text of any length is searched whole; repeated rows
are searched each; without candidates of both classes there is no model and only base spans
are returned; existing columns of the output's names are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glint.llm.common import without

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base rules. Possessive quantifiers and the look-behinds only cut the
# search short where no match can follow; what is found stays the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"            # shorter runs fail anyway
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
IP_OK = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
# Generators with high recall.
LOOSE_EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9-]++"
               r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++")
# Forms that training rewrites spans into: (kind, SQL over x.m, the match, and d, its digits).
FORMS = (
    ("email", "concat(substring_index(x.m, '@', 1), ' [at] ', replace(substring_index(x.m, '@', -1), '.', ' [dot] '))"),
    ("email", "concat(substring_index(x.m, '@', 1), '(at)', replace(substring_index(x.m, '@', -1), '.', '(dot)'))"),
    ("email", "concat(substring_index(x.m, '@', 1), ' @ ', substring_index(x.m, '@', -1))"),
    ("phone", "concat('(', substring(d, 2, 3), ') ', substring(d, 5, 3), '-', substring(d, 8))"),
    ("phone", "concat('00', substring(d, 1, 2), ' ', substring(d, 3, 2), ' ', substring(d, 5))"),
    ("phone", "concat('0', substring(d, 3, 3), '/', substring(d, 6))"),
)
# Numbers that are nobody's: plain runs, spans of years, dates, grouped amounts, version-like ones.
DECOYS = (
    ("phone", "substring(d, 1, 9)"),
    ("phone", "concat('19', substring(d, 2, 2), '-20', substring(d, 4, 2))"),
    ("phone", "concat('20', substring(d, 2, 2), '-0', substring(d, 4, 1), '-1', substring(d, 5, 1))"),
    ("phone", "concat(substring(d, 2, 1), ' ', substring(d, 3, 3), ' ', substring(d, 6, 3), ' ', substring(d, 3, 3))"),
    ("phone", "concat(substring(d, 2, 4), ' (', substring(d, 5, 4), ') ', substring(d, 3, 2), '.', substring(d, 6, 1))"),
)
LOOSE_NUMBER = r"[+(]{0,2}[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+"
CONTEXT = r"(?i)(?:tel|phone|call|mobile|fax|mail|contact|card|visa|credit|account|address|host|server|\bip\b)"

SPANS = "array<struct<kind:string,s:int,e:int>>"
CANDIDATES = "array<struct<s:int,e:int,m:string,kind:string,f:array<double>>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of all matches, leftmost first."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        one = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    total = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])
    return F.when(F.size(found) > 0, total).otherwise(empty)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of at most 19 digits passes the check."""
    d = F.lpad(d, 19, "0")
    twice = F.translate(d, "0123456789", "0246813579")
    total = F.lit(0)
    for i in range(1, 20):
        total = total + F.substring(d if i % 2 else twice, i, 1).cast("int")
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the base rules by kind."""
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def guarded(sign: str, pattern: str) -> Column:
        return F.when(F.instr(text, sign) > 0, matches(text, pattern)).otherwise(empty)

    n = lambda x: F.length(digits(x["m"]))
    return {
        "email": guarded("@", EMAIL),
        "ip": F.filter(guarded(".", IP), lambda x: x["m"].rlike(IP_OK)),
        "card": F.filter(matches(text, CARD), lambda x: (n(x) <= 19) & luhn(digits(x["m"]))),
        "phone": F.filter(guarded("+", PHONE), lambda x: (n(x) >= 9) & (n(x) <= 15)),
    }


def _tagged(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind), x["s"], x["e"])).cast(SPANS)


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


FEATURES = ("n_digits", "n_chars", "plus", "at", "dots", "seps", "luhn", "octets", "left", "right", "context",
            "spelt", "edge")


def features(text: Column, x: Column) -> list[Column]:
    """Format and context of one candidate, as doubles in the order of FEATURES."""
    m, d = x["m"], digits(x["m"])
    nd = F.length(d)
    before = F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
    after = F.substring(text, x["e"] + 1, F.lit(1))
    return [c.cast("double") for c in (
        nd, F.length(m), m.startswith("+"), F.instr(m, "@") > 0, F.size(F.split(m, r"\.")) - 1,
        F.length(F.regexp_replace(m, "[^ ()/-]", "")), (nd >= 13) & (nd <= 19) & luhn(F.substring(d, 1, 19)),
        m.rlike(IP_OK), before.rlike("[A-Za-z0-9.@-]$"), after.rlike("[A-Za-z0-9@-]"), before.rlike(CONTEXT),
        m.rlike(r"[\[(](?:at|dot)[\])]"), m.rlike("^[(]"))]


def candidates(text: Column) -> Column:
    """array<struct<s, e, m, kind, f array<double>>> of all proposals."""
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    mail = F.when(text.rlike(r"@|[\[(]at[\])]"), matches(text, LOOSE_EMAIL)).otherwise(empty)
    number = matches(text, LOOSE_NUMBER)
    ip = F.when(F.instr(text, ".") > 0, matches(text, IP)).otherwise(empty)

    def rows(found: Column, kind) -> Column:
        return F.transform(found, lambda x: F.struct(
            x["s"], x["e"], x["m"], kind(x), F.array(*features(text, x)))).cast(CANDIDATES)

    long_run = lambda x: F.length(digits(x["m"])) >= 13
    return F.concat(rows(mail, lambda x: F.lit("email")),
                    rows(number, lambda x: F.when(long_run(x) & ~x["m"].rlike(r"^[+(]|^00"), "card").otherwise("phone")),
                    rows(ip, lambda x: F.lit("ip")))


def rewritten(text: str, spans: str, forms: tuple = FORMS) -> Column:
    """struct<out string, at int, got array<struct<kind, s, e>>>: column ``text`` with the ``spans`` (array<struct<s, e, m,
    kind>>, in order) of the kinds of ``forms`` in other forms, chosen by hash, and where these stand."""
    new = "CASE "
    for kind in sorted({k for k, _ in forms}):
        mine = [sql.replace("d,", "regexp_replace(x.m, '[^0-9]', ''),") for k, sql in forms if k == kind]
        for i, sql in enumerate(mine):
            new += f"WHEN x.kind = '{kind}' AND pmod(xxhash64(x.m), {len(mine)}) = {i} THEN {sql} "
    new += "ELSE x.m END"
    state = f"struct<out:string,at:int,got:{SPANS}>"
    begins = "length(acc.out) + x.s - acc.at"
    return F.expr(f"""aggregate(`{spans}`, CAST(named_struct('out', '', 'at', 0, 'got', array()) AS {state}),
        (acc, x) -> IF(x.s < acc.at, acc, CAST(named_struct(
            'out', concat(acc.out, substring(`{text}`, acc.at + 1, x.s - acc.at), {new}), 'at', x.e,
            'got', concat(acc.got, CAST(array(named_struct('kind', x.kind, 's', {begins}, 'e', {begins} + length({new})))
                                        AS {SPANS}))) AS {state})),
        acc -> CAST(named_struct('out', concat(acc.out, substring(`{text}`, acc.at + 1, length(`{text}`))), 'at', acc.at,
                                 'got', acc.got) AS {state}))""")


def rewritable(base: dict[str, Column]) -> Column:
    """The base spans of the kinds of FORMS with their kind, in order."""
    def named(kind: str) -> Column:
        return F.transform(base[kind], lambda x: F.struct(x["s"], x["e"], x["m"], F.lit(kind).alias("kind")))
    return F.array_sort(F.concat(*[named(k) for k in sorted({k for k, _ in FORMS})]))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, kind, f, label of the candidates of ``docs`` (doc_id, text) as they are, rewritten, and with decoys; one
    scan, in which a document becomes up to three texts with the spans that are sure in each."""
    base = base_spans(F.col("text"))
    alone = F.size(base["email"]) + F.size(base["ip"]) + F.size(base["card"]) == 0       # nothing but phone numbers
    d = docs.select("doc_id", "text", F.concat(*[_tagged(base[k], k) for k in KINDS]).alias("sure"),
                    rewritable(base).alias("found"), alone.alias("alone"))
    moved, decoy = rewritten("text", "found"), rewritten("text", "found", DECOYS)
    shape = f"struct<text:string,sure:{SPANS}>"
    some = F.when(F.size("found") > 0, F.struct(moved["out"].alias("text"), moved["got"].alias("sure")).cast(shape))
    none = F.when((F.size("found") > 0) & F.col("alone"),
                  F.struct(decoy["out"].alias("text"), F.array().cast(SPANS).alias("sure")).cast(shape))
    texts = F.array_compact(F.array(F.struct("text", "sure").cast(shape), some, none))
    v = d.select("doc_id", F.explode(texts).alias("v")).select("doc_id", "v.sure", F.explode(candidates(F.col("v.text"))).alias("x"))
    same = F.exists("sure", lambda b: (b["s"] == F.col("x.s")) & (b["e"] == F.col("x.e")) & (b["kind"] == F.col("x.kind")))
    part = F.exists("sure", lambda b: (b["s"] < F.col("x.e")) & (F.col("x.s") < b["e"]))      # neither one nor the other
    return (v.select("doc_id", "x.kind", "x.f", same.cast("double").alias("label"), part.alias("part"))
            .filter((F.col("label") == 1) | ~F.col("part")).drop("part"))


def _tree_sql(lines: list[str], at: int) -> tuple[str, int]:
    """The CASE expression of the tree whose description begins at line ``at``, and the line after it."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return f"{float(line.split(':')[1])!r}D", at + 1
    number, bound = re.match(r"If \(feature (\d+) <= ([-\d.eE+]+)\)", line).groups()
    yes, at = _tree_sql(lines, at + 1)
    no, at = _tree_sql(lines, at + 1)          # the line of Else
    return f"CASE WHEN x.f[{number}] <= {float(bound)!r}D THEN {yes} ELSE {no} END", at


def model_sql(description: str) -> str:
    """SQL of a boosted model's probability for a candidate ``x``, from the model's description."""
    lines, parts, at = description.split("\n"), [], 0
    while at < len(lines):
        head = re.match(r"\s*Tree \d+ \(weight ([-\d.eE+]+)\):", lines[at])
        at += 1
        if head:
            tree, at = _tree_sql(lines, at)
            parts.append(f"{float(head[1])!r}D * ({tree})")
    return f"1D / (1D + exp(-2D * ({' + '.join(parts)})))"


def train(docs: DataFrame, train_docs: int = 10_000, precision: float = 0.99) -> tuple[str, dict[str, float]] | None:
    """(probability SQL, threshold by kind), or None without candidates of both classes."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    some = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").filter(text.rlike("[0-9@]"))
    rows = labelled(some)
    rows = (rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0)
            .withColumn("v", array_to_vector("f")).cache())
    classes = {(r["held"], r["label"]) for r in rows.select("held", "label").distinct().collect()}
    if not classes >= {(False, 0.0), (False, 1.0)}:
        rows.unpersist()
        return None
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=8, maxDepth=3, seed=7).fit(rows.filter("not held"))
    tested = (model.transform(rows.filter("held")).select("kind", "label", vector_to_array("probability")[1].alias("p"))
              .collect())                     # candidates of at most train_docs documents
    rows.unpersist()
    thresholds = {}
    for kind in KINDS:
        own = sorted(((r["p"], r["label"]) for r in tested if r["kind"] == kind), reverse=True)
        hit, best = 0.0, 1.1
        for i, (p, label) in enumerate(own, 1):
            hit += label
            if hit / i >= precision and (i == len(own) or own[i][0] < p):
                best = p - 1e-9          # the SQL form adds up in another order
        thresholds[kind] = best
    return model_sql(model.toDebugString), thresholds


def find_spans(docs: DataFrame, model: tuple[str, dict[str, float]] | None, text: str = "text", base: str = "base",
               found: str = "found") -> DataFrame:
    """``docs`` with ``base`` and ``found`` (array<struct<kind, s, e>>, by kind as in KINDS, then start)."""
    d = without(docs, base, found, "__llm_cand")
    t = F.coalesce(F.col(text), F.lit(""))
    own = base_spans(t)
    d = d.withColumn(base, F.when(t.rlike("[0-9@]"), F.concat(*[
        _tagged(own[k], k) for k in KINDS])).otherwise(F.array()).cast(SPANS))
    if model is None:
        return d.withColumn(found, F.col(base))
    sql, thresholds = model
    least = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in thresholds.items()) + " END"
    d = d.withColumn("__llm_cand", F.when(t.rlike("[0-9@]|[\\[(]at[\\])]"), candidates(t)))
    extra = F.expr(f"""transform(filter(coalesce(__llm_cand, array()), x ->
        NOT exists(`{base}`, b -> b.s < x.e AND x.s < b.e) AND {sql} >= {least}), x -> struct(x.kind, x.s, x.e))""")
    both = F.concat(base, extra.cast(SPANS))
    ordered = F.concat(*[F.array_sort(_of_kind(both, k)) for k in KINDS])
    return d.withColumn(found, F.array_distinct(ordered)).drop("__llm_cand")


def joined(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redact(docs: DataFrame, model: tuple[str, dict[str, float]] | None, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans become one,
    named after the first. Null text stays null."""
    d = find_spans(docs, model, text, "__llm_base", "__llm_found").drop("__llm_base")
    one = F.transform("__llm_found", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        over = (F.size(acc) > 0) & (x["s"] < F.try_element_at(acc, F.lit(-1))["e"])
        wide = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))
        return F.when(over, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wide))).otherwise(
            F.concat(acc, F.array(x)))

    merged = F.aggregate(F.array_sort(one), F.array().cast("array<struct<s:int,e:int,kind:string>>"), join)
    d = d.withColumn("__llm_spans", merged)
    ends = F.expr("transform(__llm_spans, (x, i) -> IF(i = 0, 0, __llm_spans[i - 1].e))")
    d = d.withColumn("__llm_from", ends)
    pieces = F.zip_with("__llm_spans", "__llm_from", lambda x, a: F.concat(
        F.substring(F.col(text), a + 1, x["s"] - a), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    tail = F.substring(F.col(text), F.element_at("__llm_spans", -1)["e"] + 1, F.length(text))
    new = F.when(F.size("__llm_spans") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text))
    return d.withColumn(text, new).select(*[F.col(f"`{c}`") for c in docs.columns])
