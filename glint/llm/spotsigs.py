"""Document fingerprints by spot signatures. DataFrame operations only.

A spot is an anchor (a very common word) followed by a chain of two content words; common
words between these are skipped. The set of a document's spot signatures is its fingerprint:
frequent words decide where signatures begin, so menus and numbers add little, and an edit
changes only the spots that it touches.

``similar_fingerprints`` finds similar pairs: sets are partitioned by length, so that a set
meets only partitions whose lengths can reach the threshold; inside them an index over the
rarest signatures of each set (the prefix that must share one) proposes pairs, and Jaccard is
computed where the length bound still allows it.

Defined cases: null text is empty text and has the empty fingerprint; a text without spots
has one signature of its normalised whole; two empty fingerprints have likeness 1, one empty
and one not 0; ``with_next`` orders rows by doc_id (nulls last), then by a hash of the text,
and repeated rows follow each other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.llm.common import stored, without

# Common words of English, German, French and Spanish that open a spot.
ANCHORS = """a an and are as at be by for from has have he in is it its of on or that the this to was were will with
aber als am auch auf aus bei das dem den der des die ein eine einer er es für ich im ist mit nicht sich sie sind
und von war wie zu au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous ou par pas
pour que qui se ses son sur un une al como con del el ella esta este las lo los más no para pero por sin su sus
una y""".split()
BIN_BYTES = 16 << 20           # text of a bin in which neighbours are looked up
MOST_BINS = 4096               # beyond this many, bins grow instead (a window's sort spills)
MARK = "\u0001"                # before an anchor; the normal form has no such character


def _trie(words: list[str]) -> str:
    """A regular expression for a list of words that shares their beginnings."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [h + _trie(rest) for h, rest in sorted(heads.items())]
    if not parts:
        return ""
    body = parts[0] if len(parts) == 1 and "" not in words else f"(?:{'|'.join(parts)})"
    return body + "?" if "" in words else body


def normal_form(text: Column) -> Column:
    """Lower-case words (letters and digits) with one space before, between and after."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++", " "),
                    F.lit(" "))


def add_signatures(docs: DataFrame, text: str = "text", out: str = "sigs") -> DataFrame:
    """``docs`` with ``out``: the sorted distinct 32-bit hashes (as long) of the spots of ``text``.

    A run of common words is glued to the content word after it as mark, last common word, ``>``.
    Words and glued words then agree in position, and a spot is a glued word with the next content word.
    Every step is a column of its own, so that none is evaluated twice.
    """
    anchors = _trie(sorted(set(ANCHORS)))
    d = without(docs, out, "__llm_w", "__llm_n", "__llm_c", "__llm_s").withColumn("__llm_w", normal_form(F.col(text)))
    d = d.withColumn("__llm_n", F.regexp_replace("__llm_w", rf"(?<=\x20)(?:({anchors})\x20)++", MARK + "$1>"))
    d = d.withColumn("__llm_c", F.split(F.regexp_replace("__llm_n", f"{MARK}[^>]*+>", ""), " "))

    def spot(x: Column, i: Column) -> Column:
        after = F.get("__llm_c", i + 1)
        return F.when(x.startswith(MARK) & (F.get("__llm_c", i) != "") & (after != ""),
                      F.xxhash64(x, after).bitwiseAND(F.lit(0xFFFFFFFF)))

    d = d.withColumn("__llm_s", F.array_compact(F.array_distinct(F.transform(F.split("__llm_n", " "), spot))))
    whole = F.when(F.length(F.trim("__llm_w")) > 0, F.array(F.xxhash64("__llm_w").bitwiseAND(F.lit(0xFFFFFFFF)))) \
        .otherwise(F.array().cast("array<bigint>"))
    return d.withColumn(out, F.when(F.size("__llm_s") > 0, F.array_sort("__llm_s")).otherwise(whole)) \
        .drop("__llm_w", "__llm_n", "__llm_c", "__llm_s")


def fingerprint(signature_set: Column) -> Column:
    """A signature set as text: eight hexadecimal digits each."""
    return F.array_join(F.transform(signature_set, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def with_next(docs: DataFrame, derive: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``derive(docs)`` with ``next``, a struct of ``columns`` of the next document (after the last: the first).

    ``derive`` adds columns row by row. Rows are dealt into bins of about BIN_BYTES by quantiles of doc_id; a window looks ahead in
    each bin, and the first row of each bin (one per bin) is the next of the last row before it.
    """
    d = without(docs, "next", "__llm_bin", "__llm_tie", "__llm_id")
    d = d.withColumn("__llm_id", F.col("doc_id").cast("long")).withColumn(
        "__llm_tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    bins = min(MOST_BINS, max(2, -(-(size or 0) // BIN_BYTES)))
    cuts = []
    if rows:
        cuts = sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / bins for i in range(1, bins)],
                                                       20 * bins + 1000)).first()[0]))
    # two levels, so that a row looks at about twice the root of the number of bins
    span = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(c) for c in cuts[::span]]).cast("array<bigint>")
    fine = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    group = F.greatest(F.size(F.filter(coarse, lambda c: c <= F.col("__llm_id"))) - 1, F.lit(0))
    near = F.filter(F.slice(fine, group * span + 1, F.lit(span)), lambda c: c <= F.col("__llm_id"))
    at = F.when(F.col("__llm_id").isNull(), F.lit(len(cuts) + 1)).otherwise(group * span + F.size(near))
    d = d.withColumn("__llm_bin", at.cast("int"))
    # the first row of every bin: one row each, found by its key alone
    key = F.struct(F.col("__llm_id").isNull().alias("z"), F.col("__llm_id").alias("i"), F.col("__llm_tie").alias("t"))
    least = d.groupBy("__llm_bin").agg(F.min(key).alias("k"))
    least = least.select(F.col("__llm_bin").alias("b"), F.col("k.i").alias("i"), F.col("k.t").alias("t")).collect()
    least.sort()
    spark = docs.sparkSession
    before = {r["b"]: least[i - 1]["b"] for i, r in enumerate(least)}
    rows = [F.struct(F.lit(r["b"]), F.lit(before[r["b"]]), F.lit(r["i"]), F.lit(r["t"])) for r in least]
    of_bin = spark.range(1).select(F.inline(F.array(*rows).cast(
        "array<struct<b:int,before:int,i:bigint,t:bigint>>")))
    first = d.join(F.broadcast(of_bin), (F.col("__llm_bin") == F.col("b")) & F.col("__llm_tie").eqNullSafe(F.col("t"))
                   & F.col("__llm_id").eqNullSafe(F.col("i"))).dropDuplicates(["b"])        # one row per bin
    first = derive(first).select(F.col("before").alias("__llm_bin"), F.struct(*columns).alias("first"))
    first = stored(first, "bin-first")
    order = [F.asc_nulls_last("__llm_id"), F.col("__llm_tie")]
    d = derive(d)
    cols = [F.col(f"`{c}`") for c in d.columns if not c.startswith("__llm_")]
    d = d.withColumn("next", F.lead(F.struct(*columns)).over(Window.partitionBy("__llm_bin").orderBy(*order)))
    return (d.join(F.broadcast(first), "__llm_bin", "left")
            .select(*cols, F.coalesce("next", "first").alias("next")))


def edited_text(text: Column, following: Column) -> Column:
    """``text`` whose last quarter is replaced by the beginning of ``following``."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def similar_fingerprints(sets: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs (a, b, similarity) of class representatives with Jaccard >= threshold, and no others.

    ``sets``: (id long, sigs array<long>). Equal sets are one class, named after its smallest id
    (``signature_classes`` has the membership). Empty sets match nothing.
    """
    classes = stored(signature_classes(sets).filter("id = class_id").select("id", "sigs"), "spot-classes")
    one = classes.select("id", F.size("sigs").alias("n"), F.posexplode("sigs").alias("p", "sig")).drop("p")
    often = one.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = one.join(often, "sig").withColumn(
        "r", F.row_number().over(Window.partitionBy("id").orderBy("df", "sig")))
    prefix = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    # partitions of lengths: n -> floor(log(n) / log(1 / threshold)); a set reaches its own and the next
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-_log(threshold)) + F.lit(1e-9))
    prefix = prefix.select("id", "n", "sig", part.alias("part"))
    left = prefix.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    cand = (left.alias("x").join(prefix.alias("y"), ["sig", "part"])
            .filter("x.id <> y.id and x.n <= y.n and (x.n < y.n or x.id < y.id)")
            .filter(F.col("x.n") >= F.lit(threshold) * F.col("y.n"))
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    both = (cand.join(classes.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a")
            .join(classes.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b"))
    return (both.withColumn("similarity", likeness(F.col("sa"), F.col("sb")))
            .filter(F.col("similarity") >= threshold)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"))


def signature_classes(sets: DataFrame) -> DataFrame:
    """id, sigs, class_id: the smallest id with the same non-empty set (a null id is in no class)."""
    s = sets.filter("id is not null and size(sigs) > 0").withColumn("k", F.sha2(F.array_join("sigs", ","), 256))
    return s.join(s.groupBy("k").agg(F.min("id").alias("class_id")), "k").drop("k")


def _log(x: float) -> float:
    import math

    return math.log(x)
