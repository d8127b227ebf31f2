"""Personal data: checked patterns, and identifiers found by bootstrapped context.

Base kinds (email, ip, card, phone) are leftmost, non-overlapping matches of fixed patterns, each checked
(parts of at most 255, Luhn, number of digits); a match that fails is dropped.

Bootstrapping finds identifiers of no known form. Its graph has two kinds of nodes, both taken from the corpus:

* instances are values (by their hash): runs of six or more of ``[A-Za-z0-9_-]`` with a digit behind a sign,
  and words with a digit or an ``@``, numbers with blanks among them, in running text;
* patterns are the contexts that values stand in. Behind ``=``, ``:`` or ``#`` that is the label as written
  (``badge: "``); in running text it is the two words to the left (``reach me _``), and the word to the left with
  the word to the right (``me _ today``).

Seeds are values that are a checked email, address, card or phone number, or have a published credential form,
wherever they stand, and values behind ``password`` and its like. Spark counts the graph's edges over the whole corpus
and scores it for some rounds: a pattern's confidence is the score of its instances, weighted by occurrences
and smoothed; an instance's score for a pattern is the confidence of the other patterns that have it, seeds
being sure. A pattern is no evidence for itself. So seeds make patterns sure, these make unseen values sure, and these
further patterns, whose values were never seen anywhere else. For labels, where the value says less, its make-up
(hex, digits, upper, lower, mixed) does: its score for a label is the share of seeds among that make-up's occurrences
behind other labels, and no round adds to it; forms that are checked are make-ups of their own.
Patterns below ``min_support`` occurrences never count and are left out of the graph.
All patterns of at least ``min_confidence`` mark every value in
them, seen before or not (up to ``FEW_PATTERNS`` of them as constants of the plan, more by a shuffled join); values of a seed form are marked wherever they stand. These spans (kind ``key``)
come after the base kinds, less any that overlaps one.

Offsets are code points, end exclusive. Null counts as empty; repeated rows are searched each, and counted each; rows
without a doc_id are searched like others; an empty table has no patterns; other columns stay with their rows. All steps are DataFrame functions, and the
patterns are written so that none backtracks or recurses over long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, stage, table

ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT = 4, 0.5, 3
#: So many patterns are written into the plan, if they have no more characters than MOST_CHARS in all; more are joined.
FEW_PATTERNS, MOST_CHARS = 20_000, 1_000_000
#: Matches are summed up in runs of so many, so that offsets of very many matches cost no square.
_RUN = 256

# The contract's patterns with possessive loops. A match can only start where the run before it ends, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
LABELLED = r"(?<!\p{L})\p{L}++ {0,2}+[=:#] {0,2}+[\"']?+(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
GUARD = r"\p{L} {0,2}[=:#] {0,2}[\"']?[A-Za-z_-]*[0-9]"
LABEL = r"^(\p{L}+ {0,2}[=:#] {0,2}[\"']?)"
#: Two words and a value in running text; group 1 is the word to the right. A word of a value may end in a sign, which isn't part of it.
FREE = (
    r"(?<![\p{L}\p{N}])\p{L}++ {1,2}+\p{L}++ {1,2}+[\"'(]?+(?:\+[0-9][ ().0-9-]{6,}+|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}+(?![0-9])|(?=[A-Za-z_.%+-]*+[0-9@])[A-Za-z0-9+][A-Za-z0-9._%+@-]{5,}+)"
    r"(?=[^\p{L}\p{N}]{0,3}+(\p{L}*+))"
)
FREE_GUARD = r"\p{L} {1,2}[\"'(]?[A-Za-z0-9._%+-]*[0-9@]"
LEFT = r"^(\p{L}+ {1,2}\p{L}+ {1,2}[\"'(]?)"
_TAIL = r"[^A-Za-z0-9]+$"
#: Forms known in advance: access key identifiers and tokens with a published prefix.
SEED_FORM = r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{24})(?![A-Za-z0-9_-])"
#: Labels that name a private value in so many words: seed patterns. All other labels have to be found.
SEED_LABEL = r"(?i)^(?:password|passwd|passphrase|secret)$"
_EMAIL, _IP = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$", r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"

_ITEM = "array<struct<start:bigint,end:bigint,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their offsets: array of start, end, value.

    The text's pieces between matches and the matches alternate, so running sums of their lengths are the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    empty = F.array().cast(_ITEM)

    def offsets(items: Column) -> Column:
        def step(a, x):
            start = a["at"] + x["gap"]
            end = start + F.length(x["value"])
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

        def run(a, k):
            part = F.aggregate(F.slice(items, k * _RUN + 1, _RUN), F.struct(a["at"].alias("at"), empty.alias("out")), step)
            return F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.concat(a["out"], p["out"]).alias("out")))[0]

        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _RUN).cast("int")), F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), run)["out"]

    def placed(m: Column) -> Column:
        zipped = F.transform(F.array(between), lambda b: F.transform(m, lambda x, i: F.struct(F.get(b, i).alias("gap"), x.alias("value"))))[0]
        return F.when(F.size(m) == 0, empty).otherwise(F.transform(F.array(zipped), offsets)[0])

    return F.transform(F.array(found), placed)[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Of a string of digits."""

    def summed(d: Column) -> Column:
        n = F.length(d)

        def add(a, i):
            digit = F.substring(d, i, F.lit(1)).cast("int")
            twice = digit * 2
            return a + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0

    return F.transform(F.array(number), summed)[0]


def _small(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def _sized(x: Column, lo: int, hi: int) -> Column:
    return F.length(_digits(x)).between(lo, hi)


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array of start, end, value. Texts without the kind's telling characters aren't searched."""
    none = F.array().cast(_ITEM)
    when = lambda guard, x: F.when(guard, x).otherwise(none)
    number = text.rlike(r"[0-9][ -]?[0-9]")
    return {
        "email": when(F.instr(text, "@") > 0, matches(text, EMAIL)),
        "ip": when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP), lambda m: _small(m["value"]))),
        "card": when(number, F.filter(matches(text, CARD), lambda m: F.when(_sized(m["value"], 13, 19), luhn(_digits(m["value"]))).otherwise(False))),
        "phone": when(F.instr(text, "+") > 0, F.filter(matches(text, PHONE), lambda m: _sized(m["value"], 9, 15))),
    }


def make_up(value: Column) -> Column:
    return F.when(value.rlike("^[0-9_-]+$"), "digits").when(value.rlike("^[0-9a-f]+$"), "hex").when(value.rlike("^[0-9A-Z_-]+$"), "upper").when(value.rlike("^[0-9a-z_-]+$"), "lower").otherwise("mixed")


def _label(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, LABEL, 1))


def _form(value: Column) -> Column:
    """Which checked form a value has, or null."""
    digits = F.when(value.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), luhn(_digits(value))).otherwise(False)
    return (
        F.when(value.rlike(_EMAIL), "email")
        .when(F.when(value.rlike(_IP), _small(value)).otherwise(False), "ip")
        .when(F.when(value.rlike(r"^\+[0-9][ ().0-9-]+[0-9]$"), _sized(value, 9, 15)).otherwise(False), "phone")
        .when(digits, "card")
        .when(value.rlike(f"^{SEED_FORM}$"), "form")
    )


def contexts(text: Column) -> Column:
    """Values in running text: array of start, end, value, and their two patterns left and around."""
    found = matches(text, FREE)
    right = F.regexp_extract_all(text, F.lit(FREE), F.lit(1))

    def split(m: Column, i: Column) -> Column:
        left = F.regexp_extract(m["value"], LEFT, 1)
        value = F.regexp_replace(F.substring(m["value"], F.length(left) + 1, F.length(m["value"])), _TAIL, "")
        start = m["start"] + F.length(left)
        said = F.lower(F.regexp_replace(left, r" +", " "))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.concat(said, F.lit("_")).alias("left"), F.concat(F.regexp_extract(said, r"(\p{L}+ [\"'(]?)$", 1), F.lit("_ "), F.lower(F.get(right, i))).alias("around"))

    placed = F.transform(F.array(found), lambda f: F.transform(f, split))[0]
    return F.filter(F.when(text.rlike(FREE_GUARD), placed).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string,left:string,around:string>>")), lambda c: F.length(c["value"]) >= 6)


def graph(documents: DataFrame) -> DataFrame:
    """pattern, label (or context in running text), instance, shape, n, seeds: how often the corpus has a value (hashed) in a pattern."""
    text = F.col("text")
    behind = F.when(text.rlike(GUARD), F.regexp_extract_all(text, F.lit(LABELLED), F.lit(0))).otherwise(F.array().cast("array<string>"))
    signed = F.transform(behind, lambda x: F.struct(_label(x).alias("pattern"), F.lit(True).alias("label"), F.regexp_replace(x, LABEL, "").alias("value")))
    free = F.flatten(F.transform(contexts(text), lambda c: F.transform(F.array(c["left"], c["around"]), lambda q: F.struct(q.alias("pattern"), F.lit(False).alias("label"), c["value"].alias("value")))))
    found = documents.where(text.rlike("[0-9@]")).select(F.explode(F.concat(signed, free)).alias("x")).select("x.*")
    # Values are counted before they are looked at: a value that is written often is judged once for each pattern.
    found = found.groupBy("pattern", "label", "value").agg(F.count("*").alias("n")).withColumn("form", _form(F.col("value")))
    named = F.col("label") & F.regexp_extract("pattern", r"^(\p{L}+)", 1).rlike(SEED_LABEL)
    seed = F.when(named | F.col("form").isNotNull(), F.col("n")).otherwise(F.lit(0))
    return found.select("pattern", "label", F.xxhash64("value").alias("instance"), F.coalesce("form", make_up(F.col("value"))).alias("shape"), "n", seed.cast("long").alias("seeds"))


def patterns_of(documents: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """pattern, confidence, support: all patterns in which values are identifiers."""
    edges = stage(graph(documents), "pii-graph")
    n, seeds, rest = F.col("n"), F.col("seeds"), F.col("n") - F.col("seeds")
    enough = edges.groupBy("pattern").agg(F.sum("n").alias("support")).where(F.col("support") >= min_support).select("pattern")
    edges = stage(edges.join(enough, "pattern"), "pii-edges")
    # What a make-up says of a label: seeds of the other labels that have it. Running text is no evidence of that kind.
    made = stage(edges.groupBy("pattern", "label", "shape").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds")), "pii-shapes")
    total = made.where("label").groupBy("shape").agg(F.sum("n").alias("all_n"), F.sum("seeds").alias("all_seeds"))
    said = F.when(F.col("label"), (F.col("all_seeds") - seeds) / (F.col("all_n") - n + 1)).otherwise(F.lit(0.0))
    prior = made.join(F.broadcast(total), "shape", "left").select("pattern", "shape", said.alias("prior"), "n", "seeds")  # a row for each of ten shapes
    patterns = prior.groupBy("pattern").agg(F.sum(seeds + rest * F.col("prior")).alias("base"), F.sum("n").alias("support"))
    patterns = stage(patterns.withColumn("confidence", F.col("base") / (F.col("support") + 1)), "pii-patterns")
    # Only values that stand in several patterns carry scores from one to another.
    several = edges.groupBy("instance").agg(F.count("*").alias("k"), F.sum(rest).alias("unsure")).where("k > 1 AND unsure > 0").select("instance")
    shared = stage(edges.join(several, "instance").join(prior.select("pattern", "shape", "prior"), ["pattern", "shape"]), "pii-shared")
    for _ in range(rounds if shared.limit(1).count() else 0):
        sure = shared.join(patterns.select("pattern", "confidence"), "pattern").withColumn("sure", seeds + rest * F.col("confidence"))
        score = sure.groupBy("instance").agg(F.sum("sure").alias("all_sure"), F.sum("n").alias("all_n"))
        other = (F.col("all_sure") - F.col("sure")) / (F.col("all_n") - n)
        # As much as the value says beyond its make-up, which the base holds.
        more = sure.join(score, "instance").groupBy("pattern").agg(F.sum(rest * F.greatest(other - F.col("prior"), F.lit(0.0))).alias("more"))
        further = patterns.join(more, "pattern", "left").select("pattern", "base", "support", ((F.col("base") + F.coalesce("more", F.lit(0.0))) / (F.col("support") + 1)).alias("confidence"))
        further = stage(further, "pii-patterns")
        discard(patterns)
        patterns = further
    return patterns.drop("base").where(F.col("confidence") >= min_confidence)


def learn(documents: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> list[str]:
    """The patterns of :func:`patterns_of`, best first."""
    best = patterns_of(documents, rounds, min_confidence, min_support).orderBy(F.desc("confidence"), F.desc("support"), "pattern")
    return [r["pattern"] for r in best.collect()]


def _held(documents: DataFrame, patterns: DataFrame, key: str, out: str) -> DataFrame:
    """key (the text's hash), out: which of the patterns each text holds."""
    text = F.col("text")
    labels = F.transform(F.regexp_extract_all(text, F.lit(LABELLED), F.lit(0)), _label)
    free = F.flatten(F.transform(contexts(text), lambda c: F.array(c["left"], c["around"])))
    found = documents.where(text.rlike("[0-9@]")).select(F.sha2(text, 256).alias(key), F.explode(F.array_distinct(F.concat(labels, free))).alias("pattern")).distinct()
    return found.join(patterns.select("pattern"), "pattern").groupBy(key).agg(F.collect_set("pattern").alias(out))


def find(documents: DataFrame, labels: list[str] | DataFrame | None = None, out: str = "pii") -> DataFrame:
    """documents with a struct of arrays (start, end, value) by kind: email, ip, card, phone, key."""
    if labels is None:
        labels = stage(patterns_of(documents).select("pattern"), "pii-labels")
    if isinstance(labels, DataFrame):
        size = labels.limit(FEW_PATTERNS + 1).agg(F.count("*").alias("n"), F.sum(F.length("pattern")).alias("chars")).first()
        if size["n"] <= FEW_PATTERNS and (size["chars"] or 0) <= MOST_CHARS:
            labels = sorted(r["pattern"] for r in labels.collect())
    raw, mine, key = f"__{out}_text", f"__{out}_held", f"__{out}_hash"
    df = documents.withColumn(raw, F.coalesce(F.col("text"), F.lit("")))
    joined = isinstance(labels, DataFrame)
    if joined:
        df = df.withColumn(key, F.sha2(raw, 256)).join(_held(documents, labels, key, mine), key, "left").drop(key)
    text = F.col(raw)
    none = F.array().cast(_ITEM)
    kinds = base_spans(text)
    seeded = F.when(text.rlike("AKIA|gh[pousr]_|sk_"), matches(text, SEED_FORM)).otherwise(none)

    def known(x: Column, among: list[str] | None) -> Column:
        return F.coalesce(F.array_contains(F.col(mine), x), F.lit(False)) if joined else x.isin(among)

    label = lambda m: F.regexp_extract(m["value"], LABEL, 1)
    # No label holds the mark that stands for the value in a context of running text.
    signed, free = ([x for x in labels if "_" not in x], [x for x in labels if "_" in x]) if not joined else (None, None)
    behind, around = none, none
    if joined or signed:
        behind = F.when(
            text.rlike(GUARD),
            F.transform(F.filter(matches(text, LABELLED), lambda m: known(F.lower(label(m)), signed)), lambda m: F.struct((m["start"] + F.length(label(m))).alias("start"), m["end"].alias("end"), F.regexp_replace(m["value"], LABEL, "").alias("value"))),
        ).otherwise(none)
    if joined or free:
        around = F.transform(F.filter(contexts(text), lambda c: known(c["left"], free) | known(c["around"], free)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value")))
    clear_of = lambda spans, others: F.filter(spans, lambda s: ~F.exists(others, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    df = df.withColumn(f"__{out}_behind", behind).withColumn(f"__{out}_around", around)
    with_around = F.concat(F.col(f"__{out}_behind"), clear_of(F.col(f"__{out}_around"), F.col(f"__{out}_behind")))
    df = df.withColumn(f"__{out}_both", with_around)
    more = F.concat(F.col(f"__{out}_both"), clear_of(seeded, F.col(f"__{out}_both")))
    df = df.withColumn(out, F.struct(*(c.alias(k) for k, c in kinds.items()), more.alias("more")))
    base = F.concat(*(F.col(out)[k] for k in kinds))
    clear = F.transform(F.array(base), lambda b: F.filter(F.col(out)["more"], lambda m: ~F.exists(b, lambda x: (x["start"] < m["end"]) & (x["end"] > m["start"]))))[0]
    key = F.sort_array(F.when(F.size(F.col(out)["more"]) > 0, clear).otherwise(none))
    return df.withColumn(out, F.struct(*(F.col(out)[k].alias(k) for k in kinds), key.alias("key"))).drop(raw, mine, f"__{out}_behind", f"__{out}_around", f"__{out}_both")


def listed(pii: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, in order, comma-joined."""
    return F.array_join(F.concat(*(_told(pii[k], k) for k in kinds)), ",")


def _told(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))


def masked(text: Column, pii: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first (then longest) counts."""
    spans = F.sort_array(F.concat(*(_tagged(pii[k], k) for k in ("email", "ip", "card", "phone", "key"))))

    def cut(s: Column) -> Column:
        def step(a, x):
            keep = x["start"] >= a["at"]
            piece = F.concat(F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), x["tag"])
            return F.struct(F.when(keep, -x["back"]).otherwise(a["at"]).alias("at"), F.when(keep, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

        folded = F.aggregate(s, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), step)
        return F.transform(F.array(folded), lambda f: F.concat(F.array_join(f["out"], ""), F.substring(text, (f["at"] + 1).cast("int"), F.length(text))))[0]

    return F.when(F.size(spans) <= 0, text).otherwise(F.transform(F.array(spans), cut)[0])


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), F.lit(f"[{kind.upper()}]").alias("tag")))


def mask_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: spans give way to [KIND], and n_chars follows the text."""
    df = find(docs, out="__pii")
    df = df.withColumn("__masked", F.when(F.col("text").isNotNull(), masked(F.col("text"), F.col("__pii"))))
    return df.select(*(F.col("__masked").alias(c) if c == "text" else F.length("__masked").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def op4_contextual_pii(spark, sf_dir: str) -> DataFrame:
    df = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("email", "ip", "card", "phone")
    pii = F.col("pii")
    return df.select("doc_id", *(F.size(pii[k]).cast("long").alias(f"n_{k}") for k in base), F.sha2(listed(pii, base), 256).alias("base_sha256"), listed(pii, (*base, "key")).alias("spans"))

