"""Personal data by fixed patterns, and by contexts learnt from what the patterns found.

Seeds are the spans of four fixed patterns (email, ip, card, phone). A mention is a
run of words that hold a digit or an at sign; its contexts are the two words before
it and the two words after it. Mentions and contexts form a bipartite graph:

* a context scores for a kind by the share of its occurrences in the whole corpus
  that are followed (or preceded) by known values of that kind, unknown values of the
  kind's form left out of the count, and needs MIN_VALUES different ones, so ordinary
  word pairs and copies of one document earn nothing;
* a value scores for a kind by its accepted contexts, 1 - product of (1 - score),
  and must have the kind's form (an at sign, dotted numbers, 12 to 19 or 7 to 15 digits).

Accepted values are seeds of the next round, everywhere they occur, until a round
accepts none. Only DataFrame functions are used. One pass over the texts finds spans
and mentions, a second counts the word pairs that are contexts of enough mentions;
texts are not shuffled. Rounds work on the mentions alone, with combined counts per
(context, kind, value), so a frequent context or value is never gathered.

Patterns are written so that the engine's matcher needs no stack and linear time:
repeats give nothing back, and a run of characters is tried from its first only.
Null text counts as empty. Rows that share an id are rows of their own, equal ones
included; a null id stays null. Empty tables give empty results. Words are parted by
blanks and control characters; the ends of a text count as words. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.registry import query, table
from panelcast.sources.stage import write_stage

KINDS = ["email", "ip", "card", "phone"]
#: Possessive forms of the four patterns: same matches, without backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BLANK = r"\x00-\x20"
_WORD = rf"[^{BLANK}0-9@]*+[0-9@][^{BLANK}]*+"
MENTION = rf"(?<![^{BLANK}]){_WORD}(?:\x20{_WORD})*+"
#: A context needs this share of its occurrences, and so many different known values; a value needs the other score.
MIN_SHARE, MIN_VALUES, MIN_SCORE = 0.8, 3, 0.8
#: Entries of the table that rules out word pairs; it has this size at every input.
SLOTS = 1 << 18


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def value(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def holds(kind: str, text: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
        return text.rlike(rf"^(?:{part}\.){{3}}{part}$")
    number = digits_of(text)
    if kind == "phone":
        return F.length(number).between(8, 15)
    return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)


def blocks_of(items: Column, body) -> Column:
    """``body`` of each block of neighbouring items; there are about as many blocks as items in one, so a scan over both is short."""
    size = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(items))).cast("int"))
    starts = F.filter(F.sequence(F.lit(0), F.size(items), size), lambda i: i < F.size(items))
    return F.transform(starts, lambda i: body(F.slice(items, i + 1, size)))


def sums_before(steps: Column) -> Column:
    """For an array of integers, the sum of the entries before each."""

    def scan(items: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def joined(parts: Column) -> Column:
        ahead = scan(F.transform(parts, lambda p: p["at"]))["out"]
        return bound(ahead, lambda a: F.flatten(F.transform(parts, lambda p, i: F.transform(p["out"], lambda x: x + F.get(a, i)))))

    return bound(steps, lambda x: bound(blocks_of(x, scan), joined))


def located(text: Column, pattern: str) -> Column:
    """Structs (start, end, value, before, after) of all matches, offsets in code points; before and after are the texts between."""
    hits = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def spans(h: Column) -> Column:
        steps = F.transform(h["m"], lambda m, i: F.length(m) + F.length(F.get(h["gap"], i)))

        def one(before: Column, i: Column) -> Column:
            start = before + F.length(F.get(h["gap"], i))
            value = F.get(h["m"], i)
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
                            F.get(h["gap"], i).alias("before"), F.get(h["gap"], i + 1).alias("after"))

        return F.transform(sums_before(steps), one)

    return bound(hits, spans)


def base_spans(text: Column, kind: str) -> Column:
    """Structs (kind, start, end) of a kind's matches that count; kind is its place in KINDS."""
    sign = SIGNS[kind]
    tried = text.rlike("[0-9]") if sign is None else F.contains(text, F.lit(sign))
    kept = F.filter(located(text, PATTERNS[kind]), lambda x: holds(kind, x["value"]))
    spans = F.transform(kept, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when(tried, spans).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int>>"))


def _edge_words(gap: Column, last: bool, edge: str) -> Column:
    """The two words at the end, or the start, of a text between mentions, lower-cased; ``edge`` stands where there is none."""
    flat = F.trim(F.translate(F.lower(gap), "\n\r\t\f\v", "     "))
    near = F.substring_index(flat, " ", -8 if last else 8)  # blanks may be doubled
    words = F.filter(F.split(near, " +"), lambda w: w != "")
    words = F.slice(F.reverse(words) if last else words, 1, 2)
    return F.concat_ws(" ", F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.when(F.size(words) < 2, F.lit(edge))))


def _hash(side: str, words: Column) -> Column:
    return F.xxhash64(F.lit(side), words)


def mentions(text: Column, base: Column) -> Column:
    """Structs (start, end, value, kind, left, right) of runs of words with a digit or an at sign.

    ``kind`` is that of the base spans inside, -1 without one, and -2 with several kinds. Punctuation
    around a value is not part of it. The contexts are hashes of the two words on either side.
    """

    def overlapping(spans: Column, x: Column) -> Column:
        return F.filter(spans, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))

    def one(x: Column, near: Column) -> Column:
        head = F.length(F.regexp_extract(x["value"], r"^[^0-9A-Za-z+(@]*+", 0))
        value = F.regexp_extract(x["value"], r"^[^0-9A-Za-z+(@]*+(.*[0-9A-Za-z)])?", 1)
        inside = overlapping(F.flatten(F.transform(overlapping(near, x), lambda b: b["items"])), x)
        inside = F.array_distinct(F.transform(inside, lambda b: b["kind"]))
        kind = F.when(F.size(inside) == 0, -1).when(F.size(inside) > 1, -2).otherwise(F.get(inside, F.lit(0)))
        return F.struct(
            (x["start"] + head).alias("start"), (x["start"] + head + F.length(value)).alias("end"), F.xxhash64(F.lower(value)).alias("value"),
            kind.alias("kind"), forms(value).alias("forms"),
            _hash("left", _edge_words(x["before"], True, "^")).alias("left"), _hash("right", _edge_words(x["after"], False, "$")).alias("right"),
        )

    kind = "array<struct<start:int,end:int,value:bigint,kind:int,forms:array<int>,left:bigint,right:bigint>>"
    ordered = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"))))
    near = bound(ordered, lambda o: blocks_of(o, lambda items: F.struct(
        F.get(items, F.lit(0))["start"].alias("start"), F.array_max(F.transform(items, lambda b: b["end"])).alias("end"), items.alias("items"))))
    found = bound(near, lambda n: F.transform(located(text, MENTION), lambda x: one(x, n)))
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(kind))


def forms(value: Column) -> Column:
    """The kinds, as places in KINDS, whose form a value has."""
    count = F.length(digits_of(value))
    plain = value.rlike(r"^[0-9()+.\x20/-]+$")
    rules = [value.rlike("[A-Za-z0-9]@[A-Za-z0-9]"), value.rlike(r"^[0-9]++(?:[.:][0-9]++){2,7}+$"), plain & count.between(12, 19), plain & count.between(7, 15)]
    return F.filter(F.array(*[F.when(rule, F.lit(i)) for i, rule in enumerate(rules)]), lambda k: k.isNotNull())


def open_contexts(graph: DataFrame, min_share: float = MIN_SHARE, min_values: int = MIN_VALUES) -> DataFrame:
    """Contexts that may ever be accepted, judged by their mentions alone.

    A share of ``min_share`` leaves at most the rest of a context's mentions to values that are not, and cannot
    become, of the kind; it also needs ``min_values`` different ones. No other context can be accepted in any round.
    """
    kinds = F.when(F.col("kind") >= 0, F.array("kind")).otherwise(F.col("forms"))
    all_ = graph.groupBy("context").agg(F.sum("n").alias("all_mentions"))
    each = graph.select("context", "value", "n", F.explode(kinds).alias("kind")).groupBy("context", "kind", "value").agg(F.sum("n").alias("n"))
    each = each.groupBy("context", "kind").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("own")).where(F.col("values") >= min_values)
    return each.join(all_, "context").where(F.col("own") >= min_share * F.col("all_mentions")).select("context").distinct()


def context_totals(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``context`` and ``total``: how often each of ``contexts`` occurs in all texts.

    A left context occurs where its two words stand, a right one likewise; the text's ends count as words.
    A table of SLOTS bytes, of fixed size, tells most other word pairs apart before any row is made;
    what it lets through is combined and joined.
    """
    slot = F.pmod("context", F.lit(SLOTS)).cast("int")
    mask = bytearray(SLOTS)
    for r in contexts.select(slot.alias("slot")).distinct().collect():  # at most SLOTS rows
        mask[r["slot"]] = 1
    filled = F.lit(bytes(mask))

    def wanted(context: Column) -> Column:
        return F.substring(filled, F.pmod(context, F.lit(SLOTS)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")

    words = F.filter(F.split(F.translate(F.lower("text"), "\n\r\t\f\v", "     "), " +"), lambda w: w != "")

    def of(w: Column) -> Column:
        n = F.size(w)

        def pair(i: Column) -> Column:
            a, b = F.element_at(w, i), F.element_at(w, i + 1)
            return F.filter(F.array(_hash("left", F.concat_ws(" ", b, a)), _hash("right", F.concat_ws(" ", a, b))), wanted)

        ends = F.array(
            _hash("left", F.concat_ws(" ", F.get(w, F.lit(0)), F.lit("^"))), _hash("right", F.concat_ws(" ", F.get(w, n - 1), F.lit("$"))),
            _hash("left", F.lit("^")), _hash("right", F.lit("$")),
        )
        inner = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), pair)))
        return F.concat(F.coalesce(inner, F.array().cast("array<bigint>")), F.filter(ends, wanted))

    found = docs.select(F.explode(bound(words, of)).alias("context")).groupBy("context").agg(F.count(F.lit(1)).alias("total"))
    return found.join(contexts, "context", "left_semi")


def discover(graph: DataFrame, totals: DataFrame, min_share: float = MIN_SHARE, min_values: int = MIN_VALUES, min_score: float = MIN_SCORE) -> DataFrame:
    """``value`` and ``kind`` of values that accepted contexts reveal.

    ``graph`` has a row (value, kind, context, forms, n) per value, known kind (-1: none) and context, with its number of
    mentions. A round scores contexts from the known values and values from the accepted contexts; rounds go on until none is new.
    """
    known = write_stage(graph.where("kind >= 0").select("value", "kind").distinct(), "pii-known")
    found = None
    while True:
        # A value may be known for several kinds; it then counts for each.
        counted = graph.groupBy("context", "value").agg(F.sum("n").alias("n")).join(known, "value")
        scores = counted.groupBy("context", "kind").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("values"))
        scores = scores.where(F.col("values") >= min_values).join(totals, "context")
        formed = graph.where("kind = -1").select("context", "value", "n", F.explode("forms").alias("kind")).join(known, ["value", "kind"], "left_anti")
        unsure = formed.groupBy("context", "kind").agg(F.sum("n").alias("unsure"))
        share = F.col("hits") / F.greatest(F.col("total") - F.coalesce("unsure", F.lit(0)), F.col("hits"))
        scores = scores.join(unsure, ["context", "kind"], "left").select("context", "kind", share.alias("share")).where(F.col("share") >= min_share)
        votes = formed.join(scores, ["context", "kind"])
        # Shares below 1 keep the logarithm finite.
        miss = F.sum(F.log(1 - F.least("share", F.lit(0.999))))
        new = votes.groupBy("value", "kind").agg((1 - F.exp(miss)).alias("score")).where(F.col("score") >= min_score)
        new = new.select("value", "kind").join(known, ["value", "kind"], "left_anti")
        new = write_stage(new, "pii-new")
        if new.isEmpty():
            break
        known = write_stage(known.unionByName(new), "pii-known")
        found = new if found is None else found.unionByName(new)
    return found if found is not None else known.limit(0)


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``id_col``, base counts per kind, ``base`` and ``spans`` (arrays of (kind, start, end), sorted) of every row.

    ``limits`` are those of ``discover``.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Equal rows get equal spans, so two hashes of a row serve as its key.
    keyed = docs.select("id", F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit("second"), "id", "text").alias("k2"), "text")
    base = F.concat(*[base_spans(F.col("text"), k) for k in KINDS])
    both = bound(base, lambda b: F.struct(b.alias("base"), mentions(F.col("text"), b).alias("mentions")))
    rows = write_stage(keyed.select("id", "k1", "k2", both.alias("x")).select("id", "k1", "k2", "x.base", "x.mentions"), "pii-rows")
    each = rows.select("k1", "k2", F.explode("mentions").alias("m")).select("k1", "k2", "m.*")
    sides = F.explode(F.array("left", "right")).alias("context")
    graph = each.where("kind > -2").select("value", "kind", "forms", sides).groupBy("value", "kind", "context").agg(F.first("forms").alias("forms"), F.count(F.lit(1)).alias("n"))
    graph = write_stage(graph, "pii-graph")
    contexts = write_stage(open_contexts(graph, **{k: v for k, v in limits.items() if k != "min_score"}), "pii-contexts")
    totals = write_stage(context_totals(docs, contexts), "pii-totals")
    new = discover(write_stage(graph.join(contexts, "context", "left_semi"), "pii-open"), totals, **limits)
    added = each.where("kind = -1").join(new.withColumnRenamed("kind", "as"), "value")
    added = added.select("k1", "k2", F.struct(F.col("as").alias("kind"), "start", "end").alias("s")).groupBy("k1", "k2").agg(F.collect_set("s").alias("more"))
    out = rows.drop("mentions").join(added, ["k1", "k2"], "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return out.select(F.col("id").alias(id_col), *counts, "base", spans.alias("spans"))


@query("op13_pii")
def op13_pii(spark, folder: str) -> DataFrame:
    """Base counts and all spans of every document; the counts and the digest are of base spans alone."""
    found = find(table(spark, folder, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
