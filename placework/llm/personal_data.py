"""Personal data in documents: candidate spans, boosted trees, calibrated thresholds. DataFrame operations only.

Generators are regular expressions that propose spans freely, also overlapping ones. Four base kinds are decided by
their own rules. The other kinds are decided by gradient-boosted trees over the format of a span and its context; for each
kind the threshold is the least one that is precise on examples kept out of training.

Positions come from the split of a text at the matches of an expression, so a text is never walked in Python. All spans
of a row lie in one task once, after the shuffle by row.
"""

from __future__ import annotations

import dataclasses
import random

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of

# Base kinds in their order (fixed values). Possessive quantifiers and look-behinds give the same leftmost matches as the
# plain forms without going back over long runs; \G is the end of the match before, where the next one may begin.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "secret": r"(?i)(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth)[\"']?\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{12,}+",
    "key": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
KINDS = [*BASE, *PROPOSED]
_CONTEXT = 24
_CUES = {
    "secret": "token|secret|passw|key|auth|credential",
    "person": "name|born|ssn|social|security|tax|passport|patient|insur",
    "bank": "iban|account|bank|bic|swift|transfer|payment",
    "call": "phone|tel|call|mobile|fax|contact|dial",
    "thing": "order|invoice|isbn|version|part|serial|model|page|ticket|build|commit|sha|file|lot",
}
PRECISION = 0.98


def proposed_spans(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """One row per proposal (kind, start, end in code points, match, context left and right), or one with a null kind.

    uid names the row of docs; rows with equal uid lie in one partition.
    """
    def found(kind: str, pattern: str) -> Column:
        parts = F.split("_text", pattern, -1)

        def span(match: Column, at: Column) -> Column:
            before, after = F.element_at(parts, at + 1), F.element_at(parts, at + 2)
            return F.struct(
                F.lit(kind).alias("kind"),
                at.alias("at"),
                F.length(before).cast("long").alias("before"),
                match.alias("match"),
                F.right(before, F.lit(_CONTEXT)).alias("left"),
                F.left(after, F.lit(_CONTEXT)).alias("right"),
            )

        return F.transform(F.regexp_extract_all("_text", F.lit(pattern), 0), span)

    lists = [found(kind, pattern) for kind, pattern in {**BASE, **PROPOSED}.items()]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), *keep, text.alias("_text"))
    rows = rows.select("uid", *keep, F.explode_outer(F.concat(*lists)).alias("span")).select("uid", *keep, "span.*")
    rows = rows.repartition("uid")
    upto = Window.partitionBy("uid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("match").cast("long")
    end = F.sum(F.col("before") + length).over(upto)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - length).drop("at", "before")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Of 14 to 19 digits."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(
        places, lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10))
    )
    total = F.aggregate(doubled, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))
    # Only values of the right length are looked at digit by digit.
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def base_valid() -> Column:
    match, digits = F.col("match"), _digits(F.col("match"))
    byte = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", match.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$"))
        .when(F.col("kind") == "card", passes_luhn(digits))
        .when(F.col("kind") == "phone", F.length(digits).between(10, 15))
        .otherwise(False)
    )


def span_features() -> dict[str, Column]:
    """Format and context of a proposal; all are numbers, also where there is no proposal."""
    match = F.coalesce("match", F.lit(""))
    near = F.lower(F.concat(F.coalesce("left", F.lit("")), match))
    size = F.greatest(F.length(match), F.lit(1))

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(match, pattern, "")) / size

    out = {f"is_{kind}": (F.col("kind") == kind) for kind in PROPOSED}
    out |= {f"cue_{cue}": near.rlike(words) for cue, words in _CUES.items()}
    out |= {
        "size": F.length(match),
        "digits": share("[^0-9]"),
        "letters": share("[^A-Za-z]"),
        "capitals": share("[^A-Z]"),
        "dashes": share("[^_-]"),
        "hex": match.rlike("(?i)[0-9a-f]{20}"),
        "changes": F.regexp_count(match, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]")),
        "opens_word": F.coalesce("left", F.lit("")).rlike("[A-Za-z0-9/@#]$"),
        "closes_word": F.coalesce("right", F.lit("")).rlike("^[A-Za-z0-9@]"),
    }
    return {name: F.coalesce(column.cast("double"), F.lit(0.0)) for name, column in out.items()}


def labelled_spans(rows: int = 1500, seed: int = 9) -> list[tuple[int, str, float]]:
    """Made-up examples (number, text, label): each text holds one span that is personal data (1) or looks like it (0)."""
    syllables = "an er in on re st ti es en at ou th ed nd ha to or ea hi is".split()
    out = []
    for number in range(rows):
        r = random.Random(seed * 1_000_003 + number)
        word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))  # noqa: B023, E731
        pick = lambda letters, n: "".join(r.choices(letters, k=n))  # noqa: B023, E731
        hexa, digit, upper = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        mixed = upper + upper.lower() + digit
        group = lambda n: " ".join(pick(upper[:6] + digit * 3, 4) for _ in range(n))  # noqa: B023, E731
        positive = [
            lambda: f'{r.choice(["token", "secret", "api_key", "access_key", "auth"])}{r.choice([" = ", "=", ": "])}"{pick(hexa, r.choice([32, 40, 64]))}"',
            lambda: f'{r.choice(["password", "token", "api-key", "secret"])}{r.choice([" = ", "=", ": "])}{pick(mixed, r.randint(14, 40))}',
            lambda: f'{r.choice(["key", "credential", "secret key"])} {pick(mixed, r.randint(28, 44))}',
            lambda: f'{r.choice(["SSN", "social security number", "tax id", "born, ssn", "insurance"])} {pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}',
            lambda: f'{r.choice(["IBAN", "account", "bank account:", "transfer to"])} {pick(upper, 2)}{pick(digit, 2)} {group(r.randint(3, 5))}',
            lambda: f'{r.choice(["phone", "call", "tel.", "mobile:", "contact"])} {r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(pick(digit, 3), pick(digit, 3), pick(digit, 4))}',
        ]
        negative = [
            lambda: "".join(word() for _ in range(9)),
            lambda: "-".join(word() for _ in range(8)),
            lambda: f"commit {pick(hexa, 40)}",
            lambda: f"sha256 {pick(hexa, 64)}",
            lambda: f"file {word()}_{pick(digit, 8)}_{word()}_{word()}_{word()}{word()}",
            lambda: f'{r.choice(["order", "part", "invoice", "lot", "serial"])} {pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}',
            lambda: f'{r.choice(["order", "ticket", "part", "isbn", "model"])} {pick(digit, 3)}-{pick(digit, 3)}-{pick(digit, 4)}',
            lambda: f'{r.choice(["serial", "part", "model", "build"])} {pick(upper, 2)}{pick(digit, 2)} {group(r.randint(3, 5))}',
            lambda: "_" * r.randint(24, 60),
            lambda: f'token = "{word()}{word()}{word()}{word()}{word()}"',
            lambda: f"{pick(digit, r.randint(24, 40))}",
        ]
        label = number % 2
        thing = r.choice(positive if label else negative)()
        before, after = (" ".join(word() for _ in range(r.randint(0, 9))) for _ in "ab")
        out.append((number, f"{before} {thing}{r.choice(['', '.', ','])} {after}", float(label)))
    return out


@dataclasses.dataclass
class SpanModel:
    trees: GBTClassificationModel
    thresholds: dict[str, float]

    def score(self, spans: DataFrame) -> DataFrame:
        features = span_features()
        rows = spans.withColumns({f"f_{k}": v for k, v in features.items()})
        rows = VectorAssembler(inputCols=[f"f_{k}" for k in features], outputCol="features").transform(rows)
        rows = self.trees.transform(rows).withColumn("chance", vector_to_array("probability")[1])
        return rows.drop("features", "rawPrediction", "probability", "prediction", *[f"f_{k}" for k in features])


def fit_spans(spark: SparkSession) -> SpanModel:
    """Boosted trees from two thirds of the made-up examples; thresholds from the rest. Their number is fixed."""
    examples = spark.createDataFrame(labelled_spans(), "example long, text string, label double").coalesce(1)
    spans = proposed_spans(examples, text_of(), ["example", "label"]).where(F.col("kind").isin(*PROPOSED))
    features = span_features()
    rows = spans.select("example", "label", "kind", *[v.alias(k) for k, v in features.items()]).coalesce(1)
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    trees = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=7).fit(rows.where("example % 3 <> 0"))
    held = trees.transform(rows.where("example % 3 = 0")).select("kind", vector_to_array("probability")[1].alias("p"), "label").collect()
    thresholds = {}
    for kind in PROPOSED:
        own = sorted(((r["p"], r["label"]) for r in held if r["kind"] == kind), reverse=True)
        right, least = 0.0, 2.0
        for count, (p, label) in enumerate(own, 1):
            right += label
            if label and right / count >= PRECISION:
                least = p
        thresholds[kind] = max(least, 0.5)
    return SpanModel(trees, thresholds)


def personal_data(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row of docs.

    Base spans always stay. A span of another kind is added from the threshold of its kind on, unless it overlaps a base
    span or begins inside an added span that begins before it. Spans are kind:start:end by start, then kind, joined by
    commas; positions count code points from 0, ends are exclusive. Null and empty texts have none (and the digest of the
    empty text). Repeated rows get a row each; an empty table gives an empty result; other columns are ignored.
    """
    model = model or fit_spans(docs.sparkSession)
    spans = proposed_spans(docs, text_of(), ["doc_id"]).withColumn("base", F.coalesce(base_valid(), F.lit(False)))
    spans = model.score(spans)
    enough = F.lit(False)
    for kind, least in model.thresholds.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("chance") >= least))
    spans = spans.withColumn("added", F.coalesce(enough, F.lit(False))).withColumn(
        "place", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.coalesce("kind", F.lit("")))
    )
    order = Window.partitionBy("uid").orderBy("start", "place")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    reached = F.max(F.when(F.col("base") | F.col("added"), F.col("end"))).over(earlier)
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(later)
    clear = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end"))
    spans = spans.withColumn("added", F.col("added") & clear)

    def chosen(which: Column) -> Column:
        span = F.struct("start", "place", F.concat_ws(":", "kind", "start", "end").alias("text"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, span))), lambda s: s["text"]), ",")

    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE]
    return spans.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        *counts,
        F.sha2(chosen(F.col("base")), 256).alias("base_sha256"),
        chosen(F.col("base") | F.col("added")).alias("spans"),
        F.count(F.when(F.col("added"), 1)).alias("n_added"),
    ).drop("uid")
