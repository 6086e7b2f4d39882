"""Personal data in texts: checked patterns, and candidates selected by boosted trees, in DataFrame functions only.

Four base patterns with checks (e-mail, IPv4 address, payment card, phone) always count. They are
greedy, and take no second try, so a card or phone beside another number can escape them. Beyond
them high-recall generators propose spans that may overlap the base ones and each other: ``handle``
(anything like name-at-domain, also written out), ``number`` (seven or more digits with
separators), ``run`` (13 to 19 digits, or four groups of four) and ``plus`` (an international
number of two, three or four groups). Boosted trees over format and context features select among
the candidates that no base span covers.

Labels don't come from what the base patterns match but from what they miss: each base span of the
corpus is rewritten in its own context so that its pattern fails (``REWRITES``: written out, without
its plus, run into another number), and a candidate that is exactly the rewritten span is positive.
Decoys (no host, a broken check digit, a bare number) are negative. All other uncovered candidates
are unlabelled: those that first trees score under nearly all positives of their kind are taken as
negative, the rest teach nothing (the spy technique of learning from positive and unlabelled rows).
A candidate is added if its probability reaches the threshold of its kind, the lowest one from
``LEAST`` that on the calibration fold keeps ``PRECISION``.

Positions come without a shuffle: ``split`` and ``regexp_extract_all`` walk over the same matches, so
the lengths of pieces and matches add up to the starts. The patterns are possessive wherever that
does not change what they match, and take time in proportion to the text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsight.llm import boosting
from capsight.llm.spark import fold, written

#: Kinds in order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "handle", "number", "run", "plus")
N_BASE = 4

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: (kind, pattern, base kinds that confirm it).
GENERATORS = (
    ("handle", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?(?:@|[(\[]\x20?at\x20?[)\]])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]\x20?dot\x20?[)\]]\x20?)[A-Za-z0-9-]++)*+", ("email",)),
    ("number", r"(?<![0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+", ("email", "ip", "card", "phone")),
    ("run", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])", ("card",)),
    *(
        ("plus", rf"\+[0-9]{{1,3}}[\x20.-]?\(?[0-9]{{1,4}}\)?(?:[\x20.-][0-9]{{2,4}}){{{n}}}(?![0-9])", ("phone",))
        for n in (2, 3, 4)
    ),
)
#: What a text must hold for a pattern to be tried at all.
NEEDED = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
    "handle": r"@|[(\[]\x20?at\x20?[)\]]", "number": r"[0-9](?:[\x20().-]{0,2}[0-9]){6}",
    "run": r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}", "plus": r"\+[0-9]",
}
#: A host of two parts or more after the at sign.
HOST = r"(?:@|at\x20?[)\]])\x20?[A-Za-z0-9-]++(?:\.|\x20?[(\[]\x20?dot)"
#: Words before a candidate that hint at what it is.
CUES = (r"(?i)mail|contact|write", r"(?i)phone|tel|call|mobile|fax", r"(?i)card|visa|credit|payment", r"(?i)\bip\b|host|server|address")

FEATURES = ("generator", "digits", "groups", "signs", "before", "after", "cue", "head", "luhn", "host")
#: Places of the features of the candidate's own form, without its context: what settles unlabelled candidates.
FORM = (0, 1, 2, 3, 8, 9)
PRECISION = 0.95
#: No threshold is lower, however few negatives the calibration fold holds.
LEAST = 0.5
#: The share of positives under whose scores an unlabelled candidate is taken as negative.
SPY = 0.05
#: Code points of a base span that is rewritten to learn from, and of its context on either side.
REWRITTEN, CONTEXT = 64, 24
CALIBRATION_FOLDS = 5
_BLOCK = 256
_SPANS = "array<struct<kind:int,start:int,end:int>>"
_BASE = "array<struct<kind:int,start:int,end:int,before:string,match:string,after:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _range(n: Column) -> Column:
    """0 .. n - 1, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _running(lengths: Column) -> Column:
    """Sums of all lengths before each one. Two levels, so that long arrays cost little more than their length."""

    def before(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            values, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        )["out"]

    blocks = F.transform(
        _range(F.ceil(F.size(lengths) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))
    )
    return _let(
        blocks,
        lambda found: _let(
            before(F.transform(found, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x)), F.lit(0)),
            lambda starts: F.flatten(F.zip_with(found, starts, lambda block, start: before(block, start))),
        ),
    )


def _matches(text: Column, pattern: str, make) -> Column:
    """``make(match, start, piece before, piece after)`` of every match, as an array."""

    def of(pieces: Column, found: Column) -> Column:
        lengths = F.transform(_range(F.size(found)), lambda i: F.length(F.get(pieces, i)) + F.length(F.get(found, i)))
        return _let(
            _running(lengths),
            lambda starts: F.transform(
                _range(F.size(found)),
                lambda i: make(
                    F.get(found, i), F.get(starts, i) + F.length(F.get(pieces, i)), F.get(pieces, i), F.get(pieces, i + 1)
                ),
            ),
        )

    return _let(
        F.split(text, pattern, -1),
        lambda pieces: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: of(pieces, found)),
    )


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits ends in 0."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + _let(
            F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
        return F.forall(F.split(match, r"\."), lambda part: part.rlike(small))
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    """Base spans of a kind; the match, if short enough to be rewritten, and its context go with them."""
    number = KINDS.index(kind)

    def make(match: Column, start: Column, before: Column, after: Column) -> Column:
        return F.struct(
            F.lit(number).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"),
            F.right(before, F.lit(CONTEXT)).alias("before"),
            F.when(F.length(match) <= REWRITTEN, match).alias("match"), F.left(after, F.lit(CONTEXT)).alias("after"),
            _valid(kind, match).alias("valid"),
        )

    spans = F.transform(F.filter(_matches(text, PATTERNS[kind], make), lambda s: s["valid"]), lambda s: s.dropFields("valid"))
    return F.when(text.rlike(NEEDED[kind]), spans.cast(_BASE)).otherwise(F.array().cast(_BASE))


def _class_of(sign: Column) -> Column:
    """0 nothing, 1 white space, 2 letter, 3 digit, 4 plus, 5 any other sign."""
    return (
        F.when(sign.isNull() | (sign == ""), 0).when(sign.rlike(r"\s"), 1).when(sign.rlike(r"\p{L}"), 2)
        .when(sign.rlike("[0-9]"), 3).when(sign == "+", 4).otherwise(5)
    )


def _bucket(value: Column, bounds: tuple[int, ...]) -> Column:
    """How many of the bounds the value reaches."""
    out = F.lit(0)
    for bound in bounds:
        out = out + (value >= bound).cast("int")
    return out


_CANDIDATE = "array<struct<kind:int,start:int,end:int," + ",".join(f"{f}:int" for f in FEATURES) + ">>"


def _candidates(text: Column, kind: str, pattern: str) -> Column:
    """Proposed spans with their features: each a small number, so that few combinations exist."""
    number = KINDS.index(kind)

    def make(match: Column, start: Column, before: Column, after: Column) -> Column:
        context = F.right(before, F.lit(CONTEXT))
        cue = F.lit(0)
        for k, words in reversed(list(enumerate(CUES, 1))):
            cue = F.when(context.rlike(words), k).otherwise(cue)
        digits = _digits(match)
        n = F.length(digits)
        return F.struct(
            F.lit(number).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"),
            F.lit(number - N_BASE).alias("generator"),
            _bucket(n, (1, 7, 8, 10, 11, 13, 16, 17, 20)).alias("digits"),
            _bucket(F.size(F.split(match, "[^A-Za-z0-9]+")), (2, 3, 4, 5, 6)).alias("groups"),
            (match.rlike(r"[()\[\]]").cast("int") + F.lit(2) * match.rlike(r"\.").cast("int") + F.lit(4) * match.rlike("@").cast("int")).alias("signs"),
            _class_of(F.right(before, F.lit(1))).alias("before"), _class_of(F.left(after, F.lit(1))).alias("after"),
            cue.alias("cue"),
            _bucket(F.length(F.regexp_extract(match, r"^\(?([A-Za-z0-9]*)", 1)), (1, 2, 3, 4, 5, 9)).alias("head"),
            F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False)).cast("int").alias("luhn"),
            match.rlike(HOST).cast("int").alias("host"),
        )

    return F.when(text.rlike(NEEDED[kind]), _matches(text, pattern, make).cast(_CANDIDATE)).otherwise(F.array().cast(_CANDIDATE))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _confirms(base: Column, candidate: Column) -> Column:
    """Whether a base span, of a kind that can confirm the candidate, overlaps it."""
    able = F.lit(False)
    for kind, names in {kind: names for kind, _, names in GENERATORS}.items():
        able = F.when(candidate["kind"] == KINDS.index(kind), base["kind"].isin(*[KINDS.index(n) for n in names])).otherwise(able)
    return _overlap(base, candidate) & able


def _rewrites(span: Column) -> Column:
    """(positive, before, match, after) of the forms of a base span that its own pattern misses, and of its decoys."""
    match, before, after = span["match"], span["before"], span["after"]
    forms = "array<struct<positive:boolean,before:string,match:string,after:string>>"

    def form(positive: bool, left: Column, middle: Column, right: Column) -> Column:
        return F.struct(F.lit(positive).alias("positive"), left.alias("before"), middle.alias("match"), right.alias("after"))

    name, host = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    written_out = [
        form(True, before, F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))), after)
        for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", "."), (" @ ", "."))
    ]
    no_host = [form(False, before, F.concat(name, F.lit(at), F.substring_index(host, ".", 1)), after) for at in ("@", " (at) ")]
    another = F.concat(F.lit(" 97.51.17.173"), after)
    last = F.right(match, F.lit(1)).cast("int")
    broken = F.concat(F.left(match, F.length(match) - 1), ((last + 1) % 10).cast("string"))
    bare = form(False, F.lit("no "), _digits(match), after)
    of_kind = {
        "email": [*written_out, *no_host],
        "phone": [form(True, before, match, another), form(True, before, F.regexp_replace(match, r"^\+", ""), after), bare],
        "card": [form(True, before, match, another), form(False, before, broken, another), form(False, before, broken, after)],
    }
    out = F.array().cast(forms)
    for kind, found in of_kind.items():
        out = F.when(span["kind"] == KINDS.index(kind), F.array(*found).cast(forms)).otherwise(out)
    return out


def _all_candidates(text: Column) -> Column:
    return F.concat(*[_candidates(text, kind, pattern) for kind, pattern, _ in GENERATORS])


def proposed(docs: DataFrame, *others: str) -> DataFrame:
    """Per row of ``docs``: doc_id, ``others``, base spans and candidates (with ``hit``: a base span overlaps)."""
    text = F.coalesce("text", F.lit(""))
    base = F.concat(*[_base(text, kind) for kind in KINDS[:N_BASE]])
    candidates = _all_candidates(text)
    found = docs.select("doc_id", *others, base.alias("_base"), candidates.alias("_proposed"))
    return found.select(
        "doc_id", *others, "_base",
        F.transform(
            "_proposed", lambda c: c.withField("hit", F.exists("_base", lambda b: _confirms(b, c)))
        ).alias("_proposed"),
    )


@dataclass
class Selector:
    """The trees, and the least probability of each added kind."""

    trees: boosting.Trees
    thresholds: dict[int, float]

    def selected(self, candidate: Column) -> Column:
        least = F.lit(2.0)
        for kind, value in self.thresholds.items():
            least = F.when(candidate["kind"] == kind, value).otherwise(least)
        return ~candidate["hit"] & (self.trees.probability(candidate) >= least)


def examples(found: DataFrame) -> DataFrame:
    """(doc_id, label, c) of all learning candidates of ``proposed``: 1 and 0 of rewritten spans, null of uncovered ones."""
    forms = (
        found.select("doc_id", F.explode("_base").alias("_span")).where("_span.match is not null")
        .select("doc_id", F.explode(_rewrites(F.col("_span"))).alias("_form"))
        .select("doc_id", "_form", F.length("_form.before").alias("_from"), (F.length("_form.before") + F.length("_form.match")).alias("_to"))
    )
    text = F.concat("_form.before", "_form.match", "_form.after")
    made = forms.select("doc_id", F.col("_form.positive").cast("int").alias("label"), "_from", "_to", F.explode(_all_candidates(text)).alias("c"))
    made = made.where("c.start = _from and c.end = _to").select("doc_id", "label", "c")
    uncovered = F.filter("_proposed", lambda c: ~c["hit"])
    others = found.select("doc_id", F.lit(None).cast("int").alias("label"), F.explode(uncovered).alias("c"))
    return made.union(others.withColumn("c", F.col("c").dropFields("hit")))


def learn(found: DataFrame, precision: float = PRECISION) -> Selector:
    """Trees and thresholds from all ``examples`` of ``proposed``.

    They are counted by pattern in Spark; there are at most 4 * 10 * 6 * 8 * 6 * 6 * 5 * 7 * 2 * 2 patterns,
    of which a corpus holds some hundreds, whatever its size. One fold of the documents calibrates.
    A kind without positives adds nothing.
    """
    calibration = (fold("doc_id", CALIBRATION_FOLDS) == 0) & F.col("doc_id").isNotNull()
    rows = (
        examples(found).groupBy(
            F.coalesce(calibration, F.lit(False)).alias("calibration"), "c.kind", *[F.col(f"c.{f}") for f in FEATURES]
        )
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label").isNull()).alias("free"))
        .collect()
    )
    counted = [Counted(tuple(r[f] for f in FEATURES), r["kind"], r["calibration"], r["pos"], r["neg"], r["free"]) for r in rows]
    counted = _weighed(counted)
    counted = _settled(counted)
    trees = boosting.train(FEATURES, [(c.pattern, c.pos, c.neg) for c in counted if not c.calibration])
    held = {k: [(c.pattern, c.pos, c.neg) for c in counted if c.calibration and c.kind == k] for k in range(N_BASE, len(KINDS))}
    return Selector(trees, {k: max(LEAST, boosting.threshold(trees, own, precision)) for k, own in held.items()})


@dataclass(frozen=True)
class Counted:
    """The positive, negative and unlabelled candidates of one pattern of features."""

    pattern: tuple[int, ...]
    kind: int
    calibration: bool
    pos: float
    neg: float
    free: float


def _weighed(counted: list[Counted]) -> list[Counted]:
    """Positives of each kind weigh as much as its unlabelled candidates, if those are more."""
    scale = {}
    for kind in {c.kind for c in counted}:
        own = [c for c in counted if c.kind == kind]
        scale[kind] = max(1.0, sum(c.free for c in own) / max(1, sum(c.pos for c in own)))
    return [replace(c, pos=c.pos * scale[c.kind]) for c in counted]


def _settled(counted: list[Counted]) -> list[Counted]:
    """Unlabelled candidates whose form trees score under nearly all positives of their kind become negatives, the others go."""
    form = {c: tuple(c.pattern[i] for i in FORM) for c in counted}
    first = boosting.train([FEATURES[i] for i in FORM], [(form[c], c.pos, c.neg + c.free) for c in counted if not c.calibration])
    least = {}
    for kind in {c.kind for c in counted}:
        scored = sorted((first.margin(form[c]), c.pos) for c in counted if c.kind == kind and c.pos and not c.calibration)
        below, most = 0.0, SPY * sum(pos for _, pos in scored)
        least[kind] = math.inf
        for margin, pos in scored:
            below += pos
            if below > most:
                least[kind] = margin
                break
    return [replace(c, neg=c.neg + (c.free if first.margin(form[c]) < least[c.kind] else 0), free=0) for c in counted]


def spans(found: DataFrame, selector: Selector, *others: str) -> DataFrame:
    """(doc_id, ``others``, spans) of the rows of ``proposed``: base spans and selected candidates, by kind and start."""
    added = F.transform(
        F.filter("_proposed", selector.selected),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")),
    )
    base = F.transform("_base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return found.select("doc_id", *others, F.array_sort(F.concat(base.cast(_SPANS), added.cast(_SPANS))).alias("spans"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array of (kind, start, end)) of every row of ``docs`` (doc_id, text).

    kind is a place in KINDS; positions are code points, end exclusive. Null and empty texts have
    no spans; equal rows have equal spans; a null doc_id stays null; other columns are not read. The
    texts are read once; spans and features, not texts, are written to the shared folder.
    """
    found = written(proposed(docs.select("doc_id", "text")), "proposed")
    return spans(found, learn(found))


def merged(found: Column) -> Column:
    """Spans by start, overlapping ones joined under the kind of the first."""
    by_start = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")

    def step(acc: Column, span: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"), last["kind"].alias("kind"))
        inside = (F.size(acc) > 0) & (span["start"] < last["end"])
        return F.when(inside, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(span)))

    return F.aggregate(by_start, empty, step)


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS])

    def of(signs: Column, spans_: Column) -> Column:
        pieces = F.transform(
            _range(F.size(spans_)),
            lambda i: _let(
                F.when(i > 0, F.get(spans_, i - 1)["end"]).otherwise(0),
                lambda start: F.concat(
                    F.array_join(F.slice(signs, start + 1, F.get(spans_, i)["start"] - start), ""),
                    F.get(names, F.get(spans_, i)["kind"]),
                ),
            ),
        )
        rest = F.get(spans_, F.size(spans_) - 1)["end"]
        return F.concat(F.array_join(pieces, ""), F.array_join(F.slice(signs, rest + 1, F.size(signs)), ""))

    return F.when(F.size(found) > 0, _let(F.split(text, ""), lambda signs: _let(merged(found), lambda s: of(signs, s)))).otherwise(text)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data in text replaced by its kind, and n_chars, if there, as it is then.

    All columns and rows stay. Patterns go over the texts once: rows are written with their spans and
    candidates, learned from, and read again to redact. Nothing is shuffled but counted patterns.
    """
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = written(proposed(whole, "_row"), "proposed")
    done = spans(found, learn(found), "_row").select(
        "_row", redacted(F.col("_row.text"), F.col("spans")).alias("_redacted")
    )
    new = {"text": F.col("_redacted"), "n_chars": F.length("_redacted").cast("long")}
    return done.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def joined(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
