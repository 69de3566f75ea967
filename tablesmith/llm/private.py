"""Personal data by base patterns and gradient-boosted candidates, with DataFrame functions only.

Base patterns with their checks find e-mail addresses, IPv4 addresses, card and phone
numbers. High-recall generators propose further, overlapping spans: long tokens and digit groups. The words before a
candidate label some of them: ``token =`` says that a secret follows, and no such word far and wide says that none does. Boosted
trees, trained on one half of all of these, never see what stands around: they score a candidate by its format,
so what they learn holds for candidates without such words too. Thresholds calibrated on all of the other half select, a lower one
where a word names the candidate. The trees become column expressions, so a text is scored where it is read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.quality import let
from tablesmith.llm.shared import col, erase, fresh, store, workspace

# The base patterns. A local part starts where no character of its class stands before, or where
# the last match ended; possessive repeats give the same matches in linear time.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){12}[0-9]", "phone": r"\+[0-9][\x20().0-9-]"}
#: Candidate generators, in the order in which their kinds follow the base kinds.
GENERATORS = {
    "secret": r"(?<![\p{L}\p{N}_-])[A-Za-z0-9_-]{16,}+(?![\p{L}\p{N}_-])",
    "number": r"(?<![\p{L}\p{N}+.(-])[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![\p{L}\p{N}])",
}
#: Public formats of access keys: always added.
KEY_FORMATS = r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35})$"
#: Words whose nearness labels a candidate, and what must stand between the word and a candidate that it names.
WORDS = {
    "secret": (r"(?:key|token|secret|password|passwd|pwd|auth|bearer|credential)", r"[\"'\s]*[=:][\"'\s]*$"),
    "number": (r"(?:phone|tel|telephone|call|fax|mobile|card|account|iban|ssn|passport)", r"\W{0,4}$"),
}
TREES, DEPTH = 12, 3
#: Share of held-out named candidates that a threshold should let pass, and of all others that may pass it: without a naming word, and with one.
RECALL, OTHERS_PASS, NAMED_PASS = 0.98, 0.005, 0.02
BEFORE, BLOCK = 24, 256
CUTS = 64  # of the margins that may be the one looked for, in each round


def scan(values: Column, most: bool = False) -> Column:
    """Running sums (or maxima) of an array of longs, block by block, so long arrays take no quadratic time."""
    zero = F.lit(0).cast("long")
    fold = lambda xs: F.aggregate(xs, zero, lambda a, x: F.greatest(a, x) if most else a + x)
    join = lambda a, b: F.greatest(a, b) if most else a + b
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    scanned = let(blocks, lambda bs: let(F.transform(bs, fold), lambda sums: F.flatten(F.transform(bs, lambda s, b: let(
        fold(F.slice(sums, F.lit(1), b)), lambda base: F.transform(s, lambda x, i: join(base, fold(F.slice(s, F.lit(1), i + 1)))))))))
    return F.when(F.size(values) > 0, scanned).otherwise(F.array().cast("array<bigint>"))


def found(text: Column, pattern: str, needs: str | None) -> Column:
    """Leftmost non-overlapping matches: start, end (code points), value and the text just before."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(ms: Column) -> Column:
        lengths = F.transform(ms, lambda m: F.char_length(m).cast("long"))
        return let(pieces, lambda ps: let(lengths, lambda ls: let(scan(ls), lambda ends: let(
            scan(F.transform(ps, lambda p: F.char_length(p).cast("long"))), lambda gaps: F.transform(ms, lambda m, i: F.struct(
                (F.get(gaps, i) + F.get(ends, i) - F.get(ls, i)).alias("start"), (F.get(gaps, i) + F.get(ends, i)).alias("end"),
                m.alias("value"), F.right(F.get(ps, i), F.lit(BEFORE)).alias("before")))))))

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")
    some = let(matches, lambda ms: F.when(F.size(ms) > 0, placed(ms)).otherwise(none))
    return some if needs is None else F.when(text.rlike(needs), some).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit doubled."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: let(
        F.coalesce(c.try_cast("int"), F.lit(0)), lambda d: F.when(i % 2 == 1, doubled(d)).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The check that a base match must pass."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    n = F.char_length(digits(value))
    if kind == "card":
        return n.between(13, 19) & luhn(digits(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    passing = lambda k: lambda x: valid(k, x["value"])
    return {k: F.filter(found(text, p, NEEDS[k]), passing(k)) for k, p in KINDS.items()}


FEATURES = ["length", "digits", "mixed", "other", "kinds", "luhn", "plus", "turns"]


def features(value: Column) -> dict[str, Column]:
    """Format of a candidate, as doubles. Nothing around it, which the labels come from, has a part in them."""
    n = F.char_length(value)
    share = lambda chars: 1.0 - F.char_length(F.regexp_replace(value, chars, "")) / n
    ds = digits(value)
    out = {
        "length": n, "digits": share("[0-9]"), "mixed": F.least(share("[A-Z]"), share("[a-z]")), "other": share("[^A-Za-z0-9]"),
        "kinds": F.size(F.array_distinct(F.split(value, ""))) / n,
        "luhn": (F.char_length(ds).between(13, 19) & luhn(ds)).cast("int"), "plus": value.startswith("+").cast("int"),
        # Changes between letters and digits.
        "turns": F.char_length(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), "[^0]+", "a"), "^.", "")),
    }
    return {k: v.cast("double") for k, v in out.items()}


def named(generator: str, before: Column) -> Column:
    """Whether a word of the generator names what follows."""
    word, link = WORDS[generator]
    return F.lower(before).rlike(word + link)


def label(generator: str, value: Column, before: Column) -> Column:
    """1 where a word names the candidate, 0 where none of the words is near, else null: these are never trained on.

    Some of the 0s are unnamed secrets, so thresholds look at the share of them that passes and not at precision. Keys of a public
    format are added anyway and have no label.
    """
    return F.when(named(generator, before), 1).when(~F.lower(before).rlike(WORDS[generator][0]) & ~value.rlike(KEY_FORMATS), 0)


def candidates(docs: DataFrame, path: str) -> DataFrame:
    """All labelled candidates by generator, label and format, with their number ``n``; half are held out.

    Equal candidates count once, so a hot value has no more say than another.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    labelled = lambda g: lambda x: F.struct(
        F.lit(g).alias("generator"), label(g, x["value"], x["before"]).alias("label"), x["value"].alias("value"), x["before"].alias("before"))
    each = [F.transform(found(text, p, None), labelled(g)) for g, p in GENERATORS.items()]
    rows = docs.select(F.explode(F.filter(F.concat(*each), lambda x: x["label"].isNotNull())).alias("x")).select("x.*").distinct()
    made = features(F.col("value"))
    shown = rows.select("generator", F.col("label").cast("double").alias("label"), *[made[f].alias(f) for f in FEATURES],
                        (F.pmod(F.xxhash64("value", "before"), F.lit(2)) == 0).alias("held"))
    return store(shown.groupBy("generator", "label", "held", *FEATURES).agg(F.count("*").alias("n")), f"{path}/candidates")


def tree_column(node, value: dict[str, Column]) -> Column:
    """A regression tree as a column expression."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(value[FEATURES[split.featureIndex()]] <= F.lit(float(split.threshold())), tree_column(node.leftChild(), value)).otherwise(
        tree_column(node.rightChild(), value))


def _near(x: float) -> range:
    """Whole numbers around a product that rounding may have moved."""
    return range(max(0, math.floor(x) - 1), math.ceil(x) + 2)


class Model:
    """Boosted trees of each generator with their thresholds; a generator without both labels has none.

    ``threshold``: the margin to reach without a naming word and with one. ``measured``: of the held-out candidates,
    the share of the others and of the named ones that reach the first.
    """

    def __init__(self, rows: DataFrame):
        self.trees: dict[str, list] = {}
        self.threshold: dict[str, tuple[float, float]] = {}
        self.measured: dict[str, tuple[float, float]] = {}
        for g in GENERATORS:
            own = rows.where(F.col("generator") == g)
            # Both labels weigh the same however rare one is.
            held = {r["label"]: r for r in own.where("NOT held").groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("formats")).collect()}
            if len(held) < 2:
                continue
            every, formats = (sum(r[c] for r in held.values()) for c in ("n", "formats"))
            share = F.when(F.col("label") == 1, every / 2 / held[1.0]["n"]).otherwise(every / 2 / held[0.0]["n"])
            assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
                own.where("NOT held").withColumn("weight", F.col("n") * share))
            # Spark looks for splits in all rows only where these are no more than the square of the bins.
            bins = max(32, math.isqrt(formats) + 1)
            fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, labelCol="label", weightCol="weight", maxBins=bins).fit(assembled)
            self.trees[g] = [(w, t._call_java("rootNode")) for w, t in zip(fitted.treeWeights, fitted.trees)]
            self._calibrate(g, own.where("held").groupBy("label", self.margin(g, {f: F.col(f) for f in FEATURES}).alias("m")).agg(F.sum("n").alias("n")))

    def _calibrate(self, generator: str, held: DataFrame) -> None:
        """Margins as low as named candidates need, no lower than the others' share allows; equal margins pass or fail together.

        Margins with their numbers stay distributed: ranks are found by narrowing, in a few aggregates.
        """
        other, named_ = F.col("label") == 0, F.col("label") == 1
        total = held.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (other, named_)]).first()

        def nth(which: Column, rank: int) -> float | None:
            """The margin that ``rank`` candidates of a label reach or exceed, at least, and fewer exceed."""
            low, high = held.where(which).agg(F.min("m"), F.max("m")).first()
            while low < high:
                cuts = [low + (high - low) * i / CUTS for i in range(CUTS)]
                got = held.where(which).agg(*[F.struct(F.sum(F.when(F.col("m") > c, F.col("n"))).alias("n"), F.max(F.when(F.col("m") <= c, F.col("m"))).alias("m"),
                                                       F.min(F.when(F.col("m") > c, F.col("m"))).alias("next")).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
                above = [x for x in got if (x["n"] or 0) >= rank and x["next"] is not None]
                under = [x for x in got if (x["n"] or 0) < rank and x["m"] is not None]
                low = max([low] + [x["next"] for x in above])
                high = min([high] + [x["m"] for x in under])
            return low

        def passes(share: float) -> float:
            """The lowest margin that no more than this share of the others reaches."""
            allowed = max(k for k in _near(share * total[0]) if k / (total[0] or 1) <= share)
            over = F.lit(True) if total[0] <= allowed else F.col("m") > F.lit(nth(other, allowed + 1))
            return held.where(over).agg(F.min("m")).first()[0]

        def half(m: float) -> float:
            """Half way to the next lower margin, so that a format a little off the trained ones passes too."""
            lower = held.where(F.col("m") < F.lit(m)).agg(F.max("m")).first()[0]
            return m if lower is None else (m + lower) / 2

        first, second = passes(OTHERS_PASS), passes(NAMED_PASS)
        sure, at = float("inf"), (0.0, 0.0)
        if first is not None:
            if total[1]:
                enough = min(k for k in _near(RECALL * total[1]) if k / total[1] >= RECALL)
                first = max(first, nth(named_, enough))
            sure = half(first)
            got = held.where(F.col("m") >= F.lit(first)).agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (other, named_)]).first()
            at = (got[0] / (total[0] or 1), got[1] / (total[1] or 1))
        near = half(second) if second is not None else float("inf")
        self.threshold[generator], self.measured[generator] = (sure, min(sure, near)), at

    def margin(self, generator: str, value: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for weight, root in self.trees[generator]:
            total = total + F.lit(float(weight)) * tree_column(root, value)
        return total

    def chosen(self, text: Column, generator: str) -> Column:
        """Candidates at or over the generator's threshold; those of a public key format even where nothing was trained."""
        known = lambda x: x.rlike(KEY_FORMATS)
        if generator not in self.trees:
            sure = F.filter(found(text, GENERATORS[generator], None), lambda x: known(x["value"]))
            return F.transform(sure, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(1.0).alias("margin")))
        scored = F.transform(found(text, GENERATORS[generator], None), lambda x: let(
            F.struct(*[v.alias(k) for k, v in features(x["value"]).items()]),
            lambda f: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                               self.margin(generator, {k: f[k] for k in FEATURES}).alias("margin"), known(x["value"]).alias("known"),
                               named(generator, x["before"]).alias("named"))))
        sure, near = self.threshold[generator]
        passing = F.filter(scored, lambda x: x["known"] | (x["margin"] >= F.when(x["named"], near).otherwise(sure)))
        return F.transform(passing, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["margin"].alias("margin")))


def _overlaps(x: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"]))


def _show(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def detect(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of kind, start and end by kind as listed, then start.

    Base spans always stay; an added span overlaps none of them, and of added spans that overlap the one with the higher score
    stays (ties: the earlier generator). Null and empty texts have none. Repeated rows are searched each; names
    that the input uses get an underscore. Without labelled candidates only keys of a public format are added.
    """
    spark = docs.sparkSession
    path = path or workspace(spark, "private")
    learned = candidates(docs, path)
    model = Model(learned)
    erase(spark, f"{path}/candidates")
    return add_spans(docs, model)


def add_spans(docs: DataFrame, model: Model) -> DataFrame:
    raw, added, base, spans = fresh(docs, "raw", "added", "base", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = lambda k, xs: F.transform(xs, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    step = docs.withColumn(raw, F.concat(*[kinds(k, xs) for k, xs in base_spans(text).items()]))
    step = step.withColumn(added, F.struct(*[F.filter(model.chosen(text, g), lambda x: ~_overlaps(x, col(raw))).alias(g) for g in GENERATORS]))
    a, b = GENERATORS
    weaker = lambda xs, ys, strict: F.filter(xs, lambda x: ~F.exists(ys, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & (
        (y["margin"] > x["margin"]) if strict else (y["margin"] >= x["margin"]))))
    extra = F.concat(kinds(a, weaker(col(added)[a], col(added)[b], True)), kinds(b, weaker(col(added)[b], col(added)[a], False)))
    return step.select(*[col(c) for c in docs.columns], col(raw).alias(base), F.concat(col(raw), extra).alias(spans))


def report(docs: DataFrame) -> DataFrame:
    """Counts by base kind, digest of the base spans, and all spans of every document."""
    rows = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(_show(F.col("base")), 256).alias("base_sha256"),
                       _show(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all rows stay, n_chars follows the text."""
    found_in = detect(docs)
    spans, = [c for c in found_in.columns[-1:]]
    by_start, new = fresh(found_in, "by_start", "redacted")
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = F.sort_array(F.transform(col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = found_in.withColumn(by_start, ordered)

    def replaced(xs: Column) -> Column:
        ends = scan(F.transform(xs, lambda x: x["end"]), most=True)

        def shown(before: Column) -> Column:
            parts = F.transform(xs, lambda x, i: let(F.coalesce(F.get(before, i - 1), F.lit(0).cast("long")), lambda at: F.when(
                x["start"] >= at, F.concat(F.substring(text, (at + 1).cast("int"), (x["start"] - at).cast("int")),
                                           F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")))
            last = F.element_at(before, -1)
            return F.concat(F.array_join(parts, ""), F.substring(text, (last + 1).cast("int"), F.char_length(text)))

        return let(ends, shown)

    step = step.withColumn(new, F.when(F.size(col(by_start)) > 0, replaced(col(by_start))).otherwise(F.col("text")))
    made = {"text": col(new)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.size(col(by_start)) > 0, F.char_length(col(new))).otherwise(col("n_chars"))
    return step.select(*[(made[c].cast(docs.schema[c].dataType).alias(c) if c in made else col(c)) for c in docs.columns])
