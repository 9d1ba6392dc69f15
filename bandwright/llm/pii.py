"""Personal data: candidate spans, labelers that vote on them, and a trained span classifier.

Everything is DataFrame and SQL functions.

1. Patterns propose spans of eight kinds. The four base kinds (email, ip, card, phone) are
   facts of the contract and always stay.
2. Four labelers vote yes, no or abstain on every candidate: its shape, a gazetteer, the
   words before it, and words that speak against it.
3. Expectation-maximisation estimates, from all candidates of all documents, each
   labeler's reliability (the chance of its votes on real and on false spans) and each
   kind's prior. It works on counts of vote patterns, a table of bounded size; an
   iteration is one aggregate over it.
4. A logistic regression learns the resulting probabilities from the votes and from what
   no labeler looks at (length, neighbouring characters), again from counts. It decides
   on the candidates of the other kinds.

Spans are code points, end exclusive. Those of one kind don't overlap; a span of another
kind that overlaps a base span is dropped, and of two others the earlier, then longer, then
first listed kind stays. Null and empty texts have no spans. Repeated rows are read one by
one. Without candidates nothing is trained and no span is added. Input columns that carry a
result's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.frames import without
from bandwright.sources.session import written

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kind and pattern. Possessive quantifiers and the assertions before a match keep long runs
#: of one character class from being tried from each of their characters.
BASE = {
    # A local part starts where its run of characters does, or where the last match ended.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole chain of digits with single separators; only chains of 16 to 19 digits count.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Our own further kinds and gazetteers.
FIRST_NAMES = (
    "James", "Mary", "John", "Linda", "Robert", "Sarah", "David", "Karen", "Peter", "Laura", "Anna", "Paul",
    "Maria", "Thomas", "Julia", "Michael", "Sophie", "Pierre", "Claire", "Hans", "Greta", "Juan", "Carmen", "Luis",
)
MORE = {
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "person": rf"(?<![A-Za-z])(?:{'|'.join(FIRST_NAMES)}) [A-Z][a-z]{{2,20}}(?![A-Za-z])",
}
KINDS = [*BASE, *MORE]
_NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "national_id": "[0-9]",
          "iban": "[A-Z]{2}[0-9]", "local_phone": "[0-9]", "person": "[A-Z][a-z]"}
ENDINGS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "eu", "io", "info")
COUNTRIES = ("1", "33", "34", "44", "49", "39", "31", "41", "43", "32", "351", "52", "54", "55", "61", "81", "86", "91")
IBAN_COUNTRIES = ("DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH", "PT", "IE", "PL", "SE", "DK", "FI", "LU")
FOR = r"(?i)\b(e-?mail|mail|contact|call|tel|telephone|phone|mobile|fax|card|visa|iban|account|ssn|social|ip|host|name|mr|mrs|ms|dr|dear|from|by)\b"
AGAINST = r"(?i)\b(version|release|isbn|issn|order|invoice|serial|model|part|page|chapter|section|id|no|nr|build)\b[^a-z]*$"
CONTEXT = 40
ITERATIONS = 8
YES, NO, SILENT = 1, 2, 0
VOTES = ["shape", "gazetteer", "context", "against"]
RESULTS = ["spans", "base_spans"]


def _positions(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<kind, start, end, value>>: matches and what lies between them, summed up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    item = "struct<kind:string,start:int,end:int,value:string>"
    pairs = F.zip_with(
        found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"))
    )

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["g"]
        end = start + F.length(pair["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    none = F.array().cast(f"array<{item}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    spans = F.when(F.size(found) > 0, F.aggregate(pairs, start, add, lambda s: s["out"])).otherwise(none)
    return F.coalesce(F.when(text.rlike(_NEEDS[kind]), spans), none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: every second from the right doubled, the sum ends in 0."""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, size - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0


def _kept(kind: str, value: Column) -> Column:
    """Base matches that count."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _found(text: Column, kinds: dict[str, str]) -> Column:
    def counted(kind: str, pattern: str) -> Column:
        return F.filter(_positions(text, kind, pattern), lambda s: _kept(kind, s["value"]))

    return F.concat(*[counted(k, p) for k, p in kinds.items()])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), YES).when(F.coalesce(no, F.lit(False)), NO).otherwise(SILENT)


def _labelled(text: Column, span: Column) -> Column:
    """The span with the labelers' votes and the classifier's further features."""
    kind, value = span["kind"], span["value"]
    digits = _digits(value)
    before = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))
    left = F.substring(text, span["start"], F.lit(1))
    right = F.substring(text, span["end"] + 1, F.lit(1))
    same = F.length(F.replace(digits, F.substring(digits, 1, 1))) == 0
    shape_no = (
        (kind.isin("card", "phone", "local_phone", "national_id") & same)
        | ((kind == "ip") & value.rlike(r"(^|\.)0[0-9]|^(0|127)\."))
        | ((kind == "national_id") & value.rlike("^(000|666|9)|-00-|-0000$"))
        | ((kind == "local_phone") & value.rlike(r"^\(?[01]"))
        | ((kind == "email") & value.rlike(r"^\.|\.@|\.\."))
    )
    shape_yes = (
        ((kind == "email") & value.rlike(r"@.*\.[A-Za-z]{2,}$")) | (kind == "ip")
        | ((kind == "card") & value.rlike("^[3456]")) | ((kind == "phone") & F.length(digits).between(10, 13))
        | (kind == "national_id") | ((kind == "iban") & F.length(F.replace(value, F.lit(" "))).between(15, 34))
        | ((kind == "local_phone") & value.rlike(r"^\("))
    )
    country = F.array(*[F.lit(c) for c in COUNTRIES])
    listed = (
        ((kind == "email") & F.regexp_extract(value, r"\.([A-Za-z]+)$", 1).isin(*ENDINGS))
        | ((kind == "phone") & F.exists(country, lambda c: digits.startswith(c)))
        | ((kind == "iban") & F.substring(value, 1, 2).isin(*IBAN_COUNTRIES)) | (kind == "person")
    )
    unlisted = (kind == "iban") & ~F.substring(value, 1, 2).isin(*IBAN_COUNTRIES)
    votes = [
        _vote(shape_yes & ~shape_no, shape_no), _vote(listed, unlisted), _vote(before.rlike(FOR), F.lit(False)),
        _vote(F.lit(False), before.rlike(AGAINST)),
    ]
    return F.struct(
        kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
        *[v.alias(n) for v, n in zip(votes, VOTES)],
        F.least(F.floor(F.length(value) / 8), F.lit(4)).cast("int").alias("size"),
        left.rlike(r"[\s(\[:,;]").cast("int").alias("left_open"), right.rlike(r"[\s)\].,;:!?]").cast("int").alias("right_open"),
    )


FEATURES = [*VOTES, "size", "left_open", "right_open"]


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, votes, further features, n): how many candidates look alike; at most
    8 x 3**4 x 5 x 2 x 2 rows."""
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = own.select("text", F.explode(_found(F.col("text"), {**BASE, **MORE})).alias("span"))
    labelled = spans.select(_labelled(F.col("text"), F.col("span")).alias("c")).select("c.kind", *[f"c.{f}" for f in FEATURES])
    return labelled.groupBy("kind", *FEATURES).agg(F.count("*").alias("n"))


def reliabilities(counts: DataFrame) -> Column:
    """Probability that a candidate is real, from its kind and votes, as an expression.

    Dawid and Skene's model with conditionally independent labelers. It starts from the
    share of yes votes; every sum is smoothed by one candidate.
    """
    yes = sum((F.when(F.col(v) == YES, 1).otherwise(0) for v in VOTES), F.lit(0))
    no = sum((F.when(F.col(v) == NO, 1).otherwise(0) for v in VOTES), F.lit(0))
    q = (yes + 0.5) / (yes + no + 1)
    for _ in range(ITERATIONS):
        n, real = F.col("n"), F.col("n") * F.col("q")
        sums = [F.sum(F.when(F.col("kind") == k, x)).alias(f"{k}_{i}") for k in KINDS for i, x in enumerate((n - real, real))]
        sums += [
            F.sum(F.when(F.col(v) == vote, x)).alias(f"{v}_{vote}_{i}")
            for v in VOTES for vote in (SILENT, YES, NO) for i, x in enumerate((n - real, real))
        ]
        row = counts.withColumn("q", q).agg(*sums).first()

        def share(name: str, i: int, row=row) -> float:
            return (row[f"{name}_{i}"] or 0.0) + 1

        odds = F.lit(0.0)
        for k in KINDS:
            odds = F.when(F.col("kind") == k, math.log(share(k, 1) / share(k, 0))).otherwise(odds)
        for v in VOTES:
            total = [sum(share(f"{v}_{vote}", i) for vote in (SILENT, YES, NO)) for i in (0, 1)]
            gain = F.lit(0.0)
            for vote in (SILENT, YES, NO):
                ratio = share(f"{v}_{vote}", 1) / total[1] / (share(f"{v}_{vote}", 0) / total[0])
                gain = F.when(F.col(v) == vote, math.log(ratio)).otherwise(gain)
            odds = odds + gain
        q = 1 / (1 + F.exp(-odds))
    return q


def _inputs(get) -> list[Column]:
    """The classifier's numbers for a candidate; `get` maps a feature's name to its column."""
    kinds = [(get("kind") == k).cast("double") for k in KINDS]
    votes = [(get(v) == vote).cast("double") for v in VOTES for vote in (YES, NO)]
    return [*kinds, *votes, *[get(f).cast("double") for f in ("size", "left_open", "right_open")]]


def train(docs: DataFrame, text: str = "text") -> list[float] | None:
    """Coefficients and intercept of the span classifier; None without candidates."""
    counts = written(vote_counts(docs, text), "votes")
    if counts.isEmpty():
        return None
    judged = counts.withColumn("q", reliabilities(counts))
    names = [f"x{i}" for i in range(len(_inputs(F.col)))]
    rows = judged.select(*[c.alias(n) for c, n in zip(_inputs(F.col), names)], "n", "q")
    both = rows.withColumns({"label": F.lit(1.0), "weight": F.col("n") * F.col("q")}).union(
        rows.withColumns({"label": F.lit(0.0), "weight": F.col("n") * (1 - F.col("q"))})
    )
    data = VectorAssembler(inputCols=names, outputCol="features").transform(both.where("weight > 0"))
    model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=30).fit(data)
    return [*map(float, model.coefficients), float(model.intercept)]


def _apart(spans: Column) -> Column:
    """Spans in the order given without those that overlap an earlier one."""
    def add(out: Column, s: Column) -> Column:
        free = ~F.exists(out, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
        return F.when(free, F.concat(out, F.array(s))).otherwise(out)

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def annotate(docs: DataFrame, model: Sequence[float] | None, text: str = "text") -> DataFrame:
    """`docs` with base_spans and spans (base ones and those the model accepts), each
    array<struct<kind, start, end>>, by kind as listed and then by start."""
    docs = without(docs, RESULTS)
    own = F.coalesce(F.col(text), F.lit(""))
    brief = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    out = docs.withColumn("_base", F.transform(_found(own, BASE), brief))
    if model is None:
        more = F.slice(F.col("_base"), 1, 0)
    else:
        def accepted(s: Column) -> Column:
            total = sum((c * w for c, w in zip(_inputs(lambda f: s[f]), model)), F.lit(model[-1]))
            # The sum is at least 0 where the probability is at least a half.
            return total >= 0

        free = F.filter(
            _found(own, MORE),
            lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )
        # One struct order serves both: by start, the longer first, then by kind as listed.
        ranked = F.array_sort(F.transform(
            F.filter(F.transform(free, lambda s: _labelled(own, s)), accepted),
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("back"),
                F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["kind"].alias("kind"),
                s["end"].alias("end"),
            ),
        ))
        more = F.when(F.size(ranked) > 0, F.transform(
            F.array_sort(F.transform(
                _apart(ranked),
                lambda s: F.struct(s["place"].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
            )), brief,
        )).otherwise(F.slice(F.col("_base"), 1, 0))
    return out.withColumns({"base_spans": F.col("_base"), "spans": F.concat("_base", more)}).drop("_base")


def _united(spans: Column) -> Column:
    """Spans by start, those that overlap joined to one."""

    def grown(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(s["start"] < last["end"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(s)))

    return F.aggregate(F.slice(spans, F.lit(2), F.size(spans)), F.slice(spans, 1, 1), grown)


def redact(docs: DataFrame, model: Sequence[float] | None, text: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets. Overlapping spans, which only
    base kinds of different patterns can be, are one: from the first start to the last end,
    under the kind of the earliest (of equal starts the shorter one)."""
    own = F.coalesce(F.col(text), F.lit(""))
    marked = annotate(docs.withColumnsRenamed({c: f"_own_{c}" for c in RESULTS}), model, text)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marked = marked.withColumn("_cuts", F.when(F.size("spans") > 0, _united(by_start)))
    pieces = F.transform("_cuts", lambda s, i: F.concat(
        F.substring(own, F.when(i > 0, F.col("_cuts")[i - 1]["end"]).otherwise(0) + 1,
                    s["start"] - F.when(i > 0, F.col("_cuts")[i - 1]["end"]).otherwise(0)),
        F.lit("["), F.upper(s["kind"]), F.lit("]"),
    ))
    last = F.element_at("_cuts", -1)["end"]
    new = F.concat(F.array_join(pieces, ""), F.substring(own, last + 1, F.length(own)))
    out = marked.withColumn(text, F.when(F.col("_cuts").isNotNull(), new).otherwise(F.col(text)))
    return out.drop("_cuts", *RESULTS).withColumnsRenamed({f"_own_{c}": c for c in RESULTS})
