"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of one pattern per kind that pass their check (parts of an address,
check digit, number of digits). Beside them, generous generators propose overlapping candidates of each kind (spelled
out addresses, unusual separators, numbers without prefix). Boosted trees judge a candidate by its format and by what
stands around it; they learn from the candidates of every document, those that are base spans being positive (distant
supervision). Candidates that look alike in all features count as one with a weight. On the quarter of the candidates kept apart, a threshold per kind is set so that candidates above it are base
spans with at least `PRECISION`; what lies above it and overlaps no base span is added, the best one of each cluster of
overlapping candidates. Base spans always stay.

Everything of a document happens inside its row, by array functions: no shuffle, no key, nothing collected but the
trees. The patterns are possessive and anchored so that they are linear in the text, yet find the same leftmost
matches. Trees become one Column expression.

Null text: empty. Any length: places are prefix sums over two levels. Repeated rows and ids: judged row by row. Other
columns are kept; `base_spans`, `spans` replace columns of that name. An empty table gives no rows. Fewer than
`LEAST_SAMPLE` candidates of either class: nothing is added.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebuyflow.llm.tables import numbered
from rebuyflow.plans.stages import stage

KINDS = ("email", "ip", "card", "phone")
# fixed values: the patterns of the base spans, possessive where nothing can be given back
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:[.,][0-9]{1,4}+){3,4}+",
    "card": r"(?<![0-9])[0-9](?:[ ./_-]?[0-9]){10,21}+",
    "phone": r"(?<![0-9])(?:\+|00|\()?[0-9](?:[ ()./-]{0,2}[0-9]){7,15}+",
}
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CONTEXT = 12
LEAST_SAMPLE = 30
PRECISION = 0.995
FEATURES = ("kind", "length", "digits", "letters", "separators", "spaces", "groups", "at_signs", "brackets", "dots", "before_word", "after_word",
            "before_digit", "after_digit", "before_letters", "after_letters", "check_digit", "longest_group")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(values: Column) -> Column:
    """Sums of what stands before each element; two levels, so that long arrays stay near linear."""
    size = 512

    def running(part, start):
        return F.slice(F.aggregate(part, F.array(start), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))), 1, F.size(part))

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / size).cast("int"), F.lit(0))), lambda b: F.slice(values, b * size + 1, size))

    def joined(ps):
        sums = F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda a, v: a + v))
        return let(running(sums, F.lit(0)), lambda starts: F.flatten(F.transform(ps, lambda p, i: running(p, F.get(starts, i)))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(parts, joined))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found, before, after) of the leftmost matches; places in code points, end exclusive.

    The pieces between matches come from the same pattern, so places are sums of lengths.
    """
    def placed(pair):
        found, between = pair["found"], pair["between"]
        steps = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.length(m))
        return let(prefix_sums(steps), lambda at: F.transform(found, lambda m, i: let(
            F.get(at, i) + F.length(F.get(between, i)), lambda start: F.struct(
                start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"),
                F.right(F.get(between, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(between, i + 1), F.lit(CONTEXT)).alias("after")))))

    shape = "array<struct<start:int,end:int,found:string,before:string,after:string>>"
    some = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), some).otherwise(F.array().cast(shape))


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def check_digit_holds(digits: Column) -> Column:
    """The sum over digits, every second from the right doubled (less 9 above 9), ends with 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.try_cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(F.filter(each, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.regexp_like(found, F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))
    return let(digits_of(found), lambda d: F.length(d).between(12, 19) & check_digit_holds(d) if kind == "card" else F.length(d).between(9, 15))


def base_spans(text: Column) -> Column:
    """Sorted array of (start, kind, end): kind by its place in KINDS."""
    def of(kind, k):
        return F.transform(F.filter(matches(text, BASE[kind]), lambda m: passes(kind, m["found"])),
                           lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))
    return F.array_sort(F.concat(*[of(kind, k) for k, kind in enumerate(KINDS)]))


def candidates(text: Column) -> Column:
    """Array of (start, kind, end, f): everything the generators propose, with its features."""
    def count(value, what):
        return F.length(F.regexp_replace(value, f"[^{what}]", "")).cast("double")

    def features(kind, m):
        found, before, after = m["found"], m["before"], m["after"]
        digits = digits_of(found)
        return F.array(
            F.lit(float(kind)), F.length(found).cast("double"), F.length(digits).cast("double"), count(found, "A-Za-z"), count(found, "/,_-"),
            count(found, " "), F.size(F.split(found, "[^0-9]+")).cast("double"), count(found, "@"), count(found, r"()\[\]"), count(found, "."),
            *[F.regexp_like(side, F.lit(p)).cast("double") for side, p in ((before, "[A-Za-z]$"), (after, "^[A-Za-z]"), (before, r"[0-9][.,+-]?$"), (after, r"^[.,-]?[0-9]"))],
            count(before, "A-Za-z"), count(after, "A-Za-z"), F.coalesce(check_digit_holds(digits), F.lit(False)).cast("double"),
            F.array_max(F.transform(F.split(found, "[^0-9]+"), lambda g: F.length(g))).cast("double"))

    def of(kind, k):
        return F.transform(matches(text, GENERATORS[kind]), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), features(k, m).alias("f")))
    return F.concat(*[of(kind, k) for k, kind in enumerate(KINDS)])


@dataclass(frozen=True)
class SpanModel:
    trees: tuple[tuple[float, str], ...]  # weight and rules of each tree
    thresholds: tuple[float, ...]  # by kind; above 1: add nothing


def margin(trees: tuple[tuple[float, str], ...], f: Column) -> Column:
    """Sum of the trees as one expression, read from their printed rules (If / Else / Predict)."""
    def tree(lines, at):
        line = lines[at].strip()
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1])), at + 1
        feature, threshold = re.search(r"feature (\d+) <= ([^)]+)\)", line).groups()
        left, at = tree(lines, at + 1)
        right, at = tree(lines, at + 1)  # past the Else line
        return F.when(f[int(feature)] <= float(threshold), left).otherwise(right), at
    total = F.lit(0.0)
    for weight, rules in trees:
        total = total + tree(rules.split("\n"), 0)[0] * weight
    return total


def probability(trees, f: Column) -> Column:
    return 1 / (1 + F.exp(-2 * margin(trees, f)))


def fit_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 12, depth: int = 4) -> SpanModel:
    """Trees and thresholds from the candidates of all documents; a quarter of the ids, by their hash, is kept apart for the thresholds.

    Candidates equal in kind, features and label are one row with their number as weight: the trees' loss is a sum over
    candidates, so this is the same loss, and what is stored and read again each round does not repeat them.
    """
    nothing = SpanModel((), (2.0,) * len(KINDS))
    some = F.regexp_like(F.col(text_col), F.lit("@|[0-9].{0,2}[0-9].{0,2}[0-9].{0,2}[0-9]"))
    each = docs.filter(some).select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).select("id", F.inline(F.array(F.struct(base_spans(F.col("body")).alias("base"), candidates(F.col("body")).alias("all")))))
    each = each.select("id", "base", F.explode("all").alias("c"))
    y = F.exists("base", lambda b: (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")) & (b["kind"] == F.col("c.kind")))
    rows = each.select((F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) == 0).alias("apart"), F.col("c.kind").alias("kind"), F.col("c.f").alias("f"), y.cast("double").alias("label"))
    rows = stage(rows.groupBy("apart", "kind", "f", "label").agg(F.count("*").cast("double").alias("n")), "span-candidates")
    train = rows.filter("not apart")
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if min(sizes.get(0.0, 0), sizes.get(1.0, 0)) < LEAST_SAMPLE:
        return nothing
    fitted = GBTClassifier(featuresCol="v", labelCol="label", weightCol="n", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=11, maxBins=64).fit(train.select(array_to_vector("f").alias("v"), "label", "n"))
    trees = tuple((float(w), "\n".join(t.toDebugString.strip().split("\n")[1:])) for w, t in zip(fitted.treeWeights, fitted.trees))
    scored = rows.filter("apart").select("kind", "label", "n", F.round(probability(trees, F.col("f")), 3).alias("p"))
    steps = scored.groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("n")).alias("hits"), F.sum("n").alias("n")).collect()  # at most 1001 per kind
    return SpanModel(trees, tuple(_threshold([r for r in steps if r["kind"] == k]) for k in range(len(KINDS))))


def _threshold(steps) -> float:
    """Least probability from which on candidates are base spans with the wanted precision."""
    best, hits, n = 2.0, 0.0, 0
    for r in sorted(steps, key=lambda r: -r["p"]):
        hits, n = hits + r["hits"], n + r["n"]
        if n >= LEAST_SAMPLE and hits >= PRECISION * n:
            best = r["p"]
    return best


def added_spans(base: Column, all_found: Column, model: SpanModel) -> Column:
    """Candidates above their threshold that touch no base span; of overlapping ones the most probable."""
    cut = F.array(*[F.lit(t) for t in model.thresholds])
    likely = F.filter(F.transform(all_found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), probability(model.trees, c["f"]).alias("p"))),
                      lambda c: c["p"] >= F.get(cut, c["kind"]))

    def clear(cs):
        tagged = F.array_sort(F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit(2.0).alias("p"))), cs))
        none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("kind"), F.lit(-1.0).alias("p"))
        state = F.struct(F.lit(-1).alias("reach"), none.alias("best"), F.array().cast("array<struct<start:int,end:int,kind:int,p:double>>").alias("out"))

        def step(s, c):
            open_ = c["start"] < s["reach"]
            better = F.when(c["p"] > s["best"]["p"], c).otherwise(s["best"])
            return F.struct(F.greatest(s["reach"], c["end"]).alias("reach"), F.when(open_, better).otherwise(c).alias("best"),
                            F.when(open_ | (s["best"]["p"] < 0) | (s["best"]["p"] == 2.0), s["out"]).otherwise(F.concat(s["out"], F.array(s["best"]))).alias("out"))

        return F.aggregate(tagged, state, step, lambda s: F.when((s["best"]["p"] >= 0) & (s["best"]["p"] < 2.0), F.concat(s["out"], F.array(s["best"]))).otherwise(s["out"]))

    shape = "array<struct<start:int,kind:int,end:int>>"
    return F.when(F.size(likely) == 0, F.array().cast(shape)).otherwise(
        F.transform(let(likely, clear), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))


def find_spans(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """Every row with base_spans and spans (base and added): sorted arrays of (start, kind, end)."""
    kept = [i for i, c in enumerate(docs.columns) if c not in ("base_spans", "spans")]
    names, own, plain = [docs.columns[i] for i in kept], [f"c{i}" for i in kept], numbered(docs)
    text = F.coalesce(F.col(f"c{docs.columns.index(text_col)}"), F.lit(""))
    if not model.trees:
        return plain.select(*own, base_spans(text).alias("base_spans")).withColumn("spans", F.col("base_spans")).toDF(*names, "base_spans", "spans")
    # the one-row generator keeps the optimizer from repeating the matching inside the later expressions
    found = plain.select(*own, F.inline(F.array(F.struct(base_spans(text).alias("base_spans"), candidates(text).alias("found")))))
    spans = F.array_sort(F.concat("base_spans", added_spans(F.col("base_spans"), F.col("found"), model)))
    return found.select(*own, "base_spans", spans.alias("spans")).toDF(*names, "base_spans", "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become the first one's mark."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, span):
        gap = F.substring(text, s["at"] + 1, span["start"] - s["at"])
        return F.when(span["start"] >= s["at"], F.struct(span["end"].alias("at"), F.concat(s["out"], F.array(gap, F.get(names, span["kind"]))).alias("out"))).otherwise(
            F.struct(F.greatest(s["at"], span["end"]).alias("at"), s["out"].alias("out")))

    done = F.aggregate(spans, state, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
