"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from one pattern a kind. Labelers vote on each: the kind's format, its
check (Luhn, number ranges, known top-level domains), gazetteers of numbering prefixes, cue words
before the span, and the characters around it. A vote is for (2), against (1) or none (0).
Expectation-maximisation over counts of vote patterns estimates how reliable each labeler is, and
a logistic span classifier is trained on the resulting soft labels. Counts are taken over all
documents; what reaches the driver is one row per distinct vote pattern, at most a few thousand
whatever the size of the input.

Spans whose format and check hold are base spans and always stay; the classifier adds candidates
to which it gives a probability of ``ADD_FROM`` or more and that overlap no base span.

Defined cases: a null or empty text has no spans; rows are judged one by one, so repeated rows
get equal results; with no candidate anywhere the model adds nothing; spans that start together are
ordered by kind; very long texts are read whole, and running sums over their spans are taken in steps,
so that work grows little faster than their number; an empty table gives an empty one. Positions are
code points, end exclusive. Of clashing names, ``pii_spans`` is replaced; all other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kinds in the order that breaks ties, with patterns that match leftmost and never overlap. Runs
#: are possessive and begin at their first character (or where the last match ended), so that a
#: long run without a match is passed over once.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+])(?=[A-Za-z_/+]{0,64}[0-9])[A-Za-z0-9_/+]{24,}+",
}
#: Needed for a match, and cheap to look for.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")) & F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "secret": lambda t: F.rlike(t, F.lit(PATTERNS["secret"])),
}
KINDS = list(PATTERNS)
BASE_KINDS = KINDS[:4]
#: Words that announce a kind.
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|pay|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon",
    "secret": "token|secret|password|passwd|api.?key|credential",
}
#: Characters before a span in which cue words are looked for.
REACH = 24
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
VOTES = ("format", "check", "prefix", "cue", "edges")
#: Rounds of expectation-maximisation and of the classifier's gradient ascent.
EM_ROUNDS, FIT_ROUNDS = 40, 200
#: Values of an array that are summed or joined one by one; longer arrays are cut into such steps.
STEP = 256
#: A candidate is added from this probability on.
ADD_FROM = 0.9


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is used."""
    return F.transform(F.array(x), use)[0]


def _steps(n: Column) -> Column:
    """Numbers of the steps of an array of ``n`` > 0 values."""
    return F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int"))


def _running(values: Column, zero: int, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of numbers, each with its own value; at least one value."""
    empty = F.struct(F.lit(zero).alias("all"), F.array().cast("array<int>").alias("each"))

    def within(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(add(acc["all"], x).alias("all"), F.concat(acc["each"], F.array(add(acc["all"], x))).alias("each"))

        return F.aggregate(part, empty, step)

    def joined(parts: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(add(acc["all"], x["all"]).alias("all"), F.concat(acc["each"], F.array(acc["all"])).alias("each"))

        before = F.aggregate(parts, empty, step)["each"]
        return F.flatten(F.zip_with(parts, before, lambda x, b: F.transform(x["each"], lambda y: add(b, y))))

    return _let(values, lambda v: _let(F.transform(_steps(F.size(v)), lambda c: within(F.slice(v, c * STEP + 1, STEP))), joined))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _vote(yes: Column) -> Column:
    return F.when(yes, 2).otherwise(1)


def _format(kind: str, m: Column) -> Column:
    """Whether the match is a base span."""
    if kind == "ip":
        return F.rlike(m, F.lit(OCTETS))
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(kind == "email")


def _votes(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    d = _digits(m)
    if kind == "email":
        own = [
            _vote(F.length(m) <= 254),
            _vote(F.rlike(m, F.lit(r"\.[A-Za-z]{2,24}$"))),
            F.when(F.rlike(m, F.lit(r"(?i)\.(com|org|net|edu|gov|io|info|de|fr|es|eu|uk)$")), 2).otherwise(0),
        ]
    elif kind == "ip":
        own = [_vote(F.rlike(m, F.lit(OCTETS))), _vote(F.length(m) <= 15), _vote(~F.rlike(m, F.lit(r"^0")))]
    elif kind == "card":
        own = [
            _vote(F.length(d).between(14, 19)),
            _vote(F.call_function("luhn_check", d)),
            F.when(F.rlike(d, F.lit(r"^(4|5[1-5]|2[2-7]|3[47]|6)")), 2).otherwise(1),
        ]
    elif kind == "phone":
        own = [_vote(F.length(d).between(10, 15)), _vote(F.length(d) >= 8), F.when(F.rlike(m, F.lit(r"^\+(1|[2-9][0-9])")), 2).otherwise(1)]
    else:
        own = [
            _vote(F.rlike(m, F.lit(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9_]{30,})$"))),
            _vote(F.length(d) * 5 >= F.length(m)),
            F.when(F.rlike(before, F.lit(r"[=:]\s?[\"']?$")), 2).otherwise(1),
        ]
    cue = F.when(F.rlike(before, F.lit(rf"(?i)(?:{CUES[kind]})")), 2).otherwise(0)
    edges = _vote(~F.rlike(before, F.lit(r"[\p{L}0-9]$")) & ~F.rlike(after, F.lit(r"^[\p{L}0-9]")))
    return [*own, cue, edges]


def _found(text: Column, kind: str) -> Column:
    """Array of candidate structs of one kind. The pieces between matches give the positions."""
    pattern = F.lit(PATTERNS[kind])
    row = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, PATTERNS[kind], -1).alias("p"))

    def spans(r: Column) -> Column:
        sizes = F.zip_with(F.slice(r["p"], F.lit(1), F.size(r["m"])), r["m"], lambda p, m: F.length(p) + F.length(m))
        return _let(_running(sizes, 0, lambda x, y: x + y), lambda ends: F.transform(F.sequence(F.lit(0), F.size(r["m"]) - 1), lambda i: made(r, ends[i], i)))

    def made(r: Column, end: Column, i: Column) -> Column:
        def judged(c: Column) -> Column:
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                (c["end"] - F.length(c["m"])).alias("start"),
                c["end"].alias("end"),
                _format(kind, c["m"]).alias("base"),
                F.array(*_votes(kind, c["m"], c["before"], c["after"])).alias("votes"),
                F.least(F.floor(F.length(c["m"]) / 8), F.lit(6)).cast("int").alias("size"),
            )

        around = F.struct(r["m"][i].alias("m"), end.alias("end"), F.right(r["p"][i], F.lit(REACH)).alias("before"), F.left(r["p"][i + 1], F.lit(1)).alias("after"))
        return _let(around, judged)

    return F.when(GATES[kind](text), _let(row, lambda r: F.when(F.size(r["m"]) > 0, spans(r))))


def candidates(text: Column) -> Column:
    """All candidates of a text as one array, ordered by kind and then place; digit runs too
    short or too long to look like a card are no candidates."""
    lists = []
    for kind in KINDS:
        found = _found(text, kind)
        if kind == "card":
            found = F.filter(found, lambda c: c["base"] | ((c["end"] - c["start"]).between(13, 23)))
        lists.append(F.coalesce(found, F.array().cast(_TYPE)))
    return F.concat(*lists)


_ONE = "struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,size:int>"
_TYPE = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,size:int>>"


def learn(docs: DataFrame, text: str = "text") -> dict[tuple, float]:
    """Weights of the span classifier, learned from all candidates of ``docs``; see :func:`train`."""
    counts = (
        docs.select(F.explode(candidates(F.col(text))).alias("c"))
        .groupBy("c.kind", "c.base", "c.votes", "c.size")
        .agg(F.count("*").alias("n"))
    )
    return train([(r["kind"], r["base"], tuple(r["votes"]), r["size"], r["n"]) for r in counts.collect()])


def train(patterns: list[tuple]) -> dict[tuple, float]:
    """From rows (kind, base, votes, size, count): posterior by expectation-maximisation, then a
    logistic classifier on them. Gives weights by feature."""
    patterns = sorted(patterns)
    # Each labeler: P(vote | kind, truth). A base span is known to be true.
    like: dict[tuple, float] = {}
    prior = {k: 0.5 for k in range(len(KINDS))}
    post = [1.0 if base else (sum(v == 2 for v in votes) + 0.5) / (sum(v > 0 for v in votes) + 1.0) * 0.5 for _, base, votes, _, _ in patterns]
    for _ in range(EM_ROUNDS):
        mass: dict[tuple, float] = {}
        for (kind, _, votes, _, n), p in zip(patterns, post):
            for truth, q in ((1, p), (0, 1 - p)):
                mass[kind, truth] = mass.get((kind, truth), 0.0) + n * q
                for j, v in enumerate(votes):
                    mass[kind, truth, j, v] = mass.get((kind, truth, j, v), 0.0) + n * q
        for kind in range(len(KINDS)):
            total = mass.get((kind, 1), 0.0) + mass.get((kind, 0), 0.0)
            prior[kind] = (mass.get((kind, 1), 0.0) + 1) / (total + 2)
            for truth in (0, 1):
                for j in range(len(VOTES)):
                    for v in (0, 1, 2):
                        # The pseudo-counts say that a labeler is right more often than not.
                        lean = 2.0 if v == (2 if truth else 1) else 1.0
                        like[kind, truth, j, v] = (mass.get((kind, truth, j, v), 0.0) + lean) / (mass.get((kind, truth), 0.0) + 4.0)
        new = []
        for kind, base, votes, _, _ in patterns:
            a = math.log(prior[kind]) + sum(math.log(like[kind, 1, j, v]) for j, v in enumerate(votes))
            b = math.log(1 - prior[kind]) + sum(math.log(like[kind, 0, j, v]) for j, v in enumerate(votes))
            new.append(1.0 if base else 1 / (1 + math.exp(min(700.0, b - a))))
        post = new
    w: dict[tuple, float] = {}
    total = sum(p[4] for p in patterns) or 1
    for _ in range(FIT_ROUNDS):
        grad: dict[tuple, float] = {}
        for (kind, _, votes, size, n), p in zip(patterns, post):
            fs = _features(kind, votes, size)
            g = n / total * (p - 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(w.get(f, 0.0) for f in fs))))))
            for f in fs:
                grad[f] = grad.get(f, 0.0) + g
        for f, g in grad.items():
            w[f] = w.get(f, 0.0) + 4.0 * g - 1e-4 * w.get(f, 0.0)
    return w


def _features(kind: int, votes: tuple, size: int) -> list[tuple]:
    return [("kind", kind), ("size", kind, size)] + [("vote", kind, j, v) for j, v in enumerate(votes) if v]


def _likelihood(w: dict[tuple, float], c: Column) -> Column:
    """The classifier's log-odds of a candidate; literal maps hold the weights."""

    def weight(prefix: str, key: Column) -> Column:
        own = {"/".join(map(str, f[1:])): v for f, v in w.items() if f[0] == prefix}
        if not own:
            return F.lit(0.0)
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(own.items()) for x in kv]), key), F.lit(0.0))

    odds = weight("kind", c["kind"].cast("string")) + weight("size", F.concat_ws("/", c["kind"].cast("string"), c["size"].cast("string")))
    for j in range(len(VOTES)):
        odds = odds + weight("vote", F.concat_ws("/", c["kind"].cast("string"), F.lit(str(j)), c["votes"][j].cast("string")))
    return odds


def _clear(found: Column, others: Column) -> Column:
    """Those of ``found`` that overlap none of ``others``: by ends, each meets the latest end of the others
    that start before its own end."""
    of_others = F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("other"), o["end"].alias("end"), F.lit(None).cast(_ONE).alias("c")))
    own = F.transform(found, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("other"), F.lit(-1).alias("end"), c.alias("c")))

    def free(events: Column) -> Column:
        tops = _running(F.transform(events, lambda e: e["end"]), -1, F.greatest)
        return F.filter(F.zip_with(events, tops, lambda e, top: F.when(top <= e["c"]["start"], e["c"])), lambda c: c.isNotNull())

    return F.when((F.size(found) == 0) | (F.size(others) == 0), found).otherwise(_let(F.array_sort(F.concat(of_others, own)), free))


def _where_kind(spans: Column, test: Callable[[Column], Column]) -> Column:
    """The spans whose kind meets ``test``. Spark gives a function of two arguments the index as second,
    defaults too, so that the function here takes the span alone."""
    return F.filter(spans, lambda s: test(s["kind"]))


def find_spans(docs: DataFrame, weights: dict[tuple, float], text: str = "text") -> DataFrame:
    """``docs`` with ``pii_spans``: array of (start, kind, end, base), ordered. Spans the method
    adds overlap no base span, nor an added one of an earlier kind."""

    def ordered(base: Column, added: Column) -> Column:
        return F.array_sort(F.transform(F.concat(base, added), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"))))

    def by_kind(free: Column) -> Column:
        each = [_clear(_where_kind(free, lambda kind: kind == k), _where_kind(free, lambda kind: kind < k)) for k in range(len(KINDS))]
        return F.concat(*each)

    def chosen(spans: Column, base: Column) -> Column:
        likely = F.filter(spans, lambda c: ~c["base"] & (_likelihood(weights, c) >= math.log(ADD_FROM / (1 - ADD_FROM))))
        return F.when(F.size(spans) > F.size(base), _let(likely, lambda x: F.when(F.size(x) > 0, _let(_clear(x, base), by_kind)).otherwise(x))).otherwise(F.array().cast(_TYPE))

    made = _let(candidates(F.col(text)), lambda spans: _let(F.filter(spans, lambda c: c["base"]), lambda base: ordered(base, chosen(spans, base))))
    return docs.withColumn("pii_spans", made)


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span found by its kind in brackets. Base spans of different kinds may
    overlap: those that touch are joined first, under the first one's name."""
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(text)

    def cut(part: Column, at: Column, pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda x: F.concat(F.substring(part, x["from"] - at + 1, x["to"] - x["from"]), x["name"])), "")

    def joined(pieces: Column) -> Column:
        # Counting characters starts at a text's begin: each step's stretch is taken out first.
        def step(own: Column) -> Column:
            at = own[0]["from"]
            return _let(F.substring(t, at + 1, F.element_at(own, -1)["to"] - at), lambda part: cut(part, at, own))

        return F.array_join(F.transform(_steps(F.size(pieces)), lambda c: _let(F.slice(pieces, c * STEP + 1, STEP), step)), "")

    def pieces(spans: Column, tops: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(tops, F.lit(1), F.size(tops) - 1))
        each = F.zip_with(spans, before, lambda s, b: F.struct(b.alias("from"), s["start"].alias("to"), name[s["kind"]].alias("name")))
        last = F.struct(F.element_at(tops, -1).alias("from"), F.length(t).alias("to"), F.lit("").alias("name"))
        return F.concat(F.filter(each, lambda x: x["to"] >= x["from"]), F.array(last))

    def whole(spans: Column) -> Column:
        return _let(_running(F.transform(spans, lambda s: s["end"]), 0, F.greatest), lambda tops: _let(pieces(spans, tops), joined))

    return docs.withColumn(text, F.when(F.size("pii_spans") > 0, _let(F.col("pii_spans"), whole)).otherwise(t))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find_spans(docs, learn(docs))
    base = F.filter("pii_spans", lambda s: s["base"])
    counts = [F.size(_where_kind(base, lambda kind: kind == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"))
