import random
import re

import pytest

from capsight.llm import boosting, pii
from tests.llm import frames

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def card(rng):
    head = "".join(rng.choice("0123456789") for _ in range(15))
    return next(head + c for c in "0123456789" if luhn(head + c))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    bits = "a@b.c._x@d.e é@x.yz 1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1 +1 (234) 555-0000 +1 + ++4 4111 1111-1111 1111 @ @@ . - 9 12 漢字@漢.字 x@y 𝒳".split(" ")
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "-", "."]) for _ in range(rng.randrange(30))) for _ in range(200)]
    texts += [f"call +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} now {card(rng)} ok" for _ in range(120)]
    texts += ["call +1 (826) 555-4081 9.9.51.173 now", f"see {card(rng)} 97.51.17.173", "number 1234567890123456 no"]
    texts += ["a." * 3000 + "@b." + "c." * 3000, "1." * 20_000, "+" + "1 " * 9000, "9" * 30_000]
    return [frames.row(1000 + i, t) for i, t in enumerate(texts)] + frames.awkward(rng)


def test_base_spans_and_added_ones(spark, rows):
    found = {}
    for r in pii.find_personal_data(frames.documents(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append([(pii.KINDS[s.kind], s.start, s.end) for s in r.spans])
    assert sum(map(len, found.values())) == len(rows)
    for r in rows:
        for spans in found[r[0]]:
            if r[0] not in (9,):
                assert [s for s in spans if s[0] in BASE] == base_spans(r[1]), r[1][:200]
    texts = {r[1]: r[0] for r in rows}
    beside_ip = found[texts["call +1 (826) 555-4081 9.9.51.173 now"]][0]
    assert ("plus", 5, 22) in beside_ip  # greedy, the phone takes the address's digits and fails
    assert not [s for s in found[texts["number 1234567890123456 no"]][0] if s[0] == "run"]


def test_redaction(spark, rows):
    docs = frames.documents(spark, rows)
    done = pii.without_personal_data(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    texts = {r.doc_id: r for r in done.collect()}
    by_text = {r[1]: r[0] for r in rows}
    assert texts[by_text["call +1 (826) 555-4081 9.9.51.173 now"]].text == "call [PLUS] [IP] now"
    before = {r[0]: r[1] for r in rows}
    for r in texts.values():
        assert r.text is None or r.n_chars == len(r.text)
        if (before[r.doc_id] or "").startswith(("call ", "see ")):
            assert not base_spans(r.text)
    assert texts[1].text is None and texts[6].text == next(r[1] for r in rows if r[0] == 6)


def test_empty_table(spark):
    assert pii.find_personal_data(frames.empty(spark)).collect() == []
    assert pii.without_personal_data(frames.empty(spark)).collect() == []


def test_trees_learn_an_interaction_and_thresholds_keep_precision():
    patterns = [((a, b), 90 if a and b else 10, 10 if a and b else 90) for a in range(2) for b in range(2)]
    trees = boosting.train(("a", "b"), patterns)
    assert boosting.probability(trees.margin((1, 1))) > 0.8 > 0.2 > boosting.probability(trees.margin((0, 1)))
    limit = boosting.threshold(trees, patterns, 0.85)
    assert boosting.probability(trees.margin((0, 1))) < limit <= boosting.probability(trees.margin((1, 1)))
    assert boosting.threshold(trees, patterns, 0.95) > 1
    assert boosting.train(("a",), []).margin((3,)) == 0


def test_added_spans_recall_and_precision(spark):
    """Spans that no base pattern gives, in documents of their own, beside lookalikes."""
    rng = random.Random(29)
    leads = ["please mail ", "you reach me at ", "see ", "send it over to ", "my phone: ", "the card is "]
    names = ["ann", "bo.li", "christopher", "d", "eve_77", "f.g.h"]
    learn_from = [
        f"{rng.choice(leads)}{rng.choice(names)}{i}@host{i}.org, {rng.choice(leads)}+1 (234) 555-{1000 + i}; {rng.choice(leads)}{card(rng)} thanks"
        for i in range(60)
    ]
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    wanted, texts = [], []

    def put(kind, before, span, after):
        texts.append(before + span + after)
        wanted.append((kind, len(before), len(before) + len(span)))

    for i in range(60):
        put("handle", "reach me: ", f"joe{i} (at) site{number(3)} (dot) com", " today")
        put("handle", "write to ", f"kim.{number(2)}[at]mail{i}[dot]net", ", thanks")
        put("run", "the card ", card(rng), f" {number(14)} was used")
        put("plus", "please call ", f"+1 ({number(3)}) 555-{number(4)}", f" {rng.randrange(99)}.9.51.173 now")
    clean = [f"order {number(9)} of 2024-05-{10 + i % 20}, {number(3)}.{number(3)}.{number(3)} pieces" for i in range(60)]
    clean += [f"lunch (at) noon{i}, see @someone{i} and {number(16)[:-1]}x" for i in range(60)]
    clean += [f"part {n}" for n in (number(16) for _ in range(60)) if not luhn(n)]
    rows = [frames.row(i, t) for i, t in enumerate(learn_from + texts + clean)]
    found = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans] for r in pii.find_personal_data(frames.documents(spark, rows)).collect()}
    added = {d: [s for s in spans if s[0] not in BASE] for d, spans in found.items()}
    for kind in ("handle", "run", "plus"):
        own = [(len(learn_from) + i, span) for i, span in enumerate(wanted) if span[0] == kind]
        caught = sum(span in added[d] for d, span in own)
        assert caught >= 0.9 * len(own), (kind, caught, len(own))
    false = sum(bool(added[len(learn_from) + len(texts) + i]) for i in range(len(clean)))
    assert false <= 0.05 * len(clean), false


def test_query_counts_and_digests(spark, rows, tmp_path):
    import hashlib

    from capsight.llm import pii_queries

    frames.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r[0]: r[1] for r in rows if r[0] is not None and [x[0] for x in rows].count(r[0]) == 1}
    for r in pii_queries.op5_pii(spark, str(tmp_path)).collect():
        if r.doc_id in texts:
            base = base_spans(texts[r.doc_id])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in BASE]
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
            assert r.n_spans == len([s for s in r.spans.split(",") if s])
