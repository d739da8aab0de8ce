"""The divergence audit against a plain version that goes through every term of every pair."""

import re
from collections import Counter

import pytest

from arcwarden.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, term string, value string"


def plain(rows, config):
    texts = [((r["lang"] or ""), (r["source"] or ""), re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))) for r in rows]
    out = []
    for lang in {t[0] for t in texts}:
        own = [t for t in texts if t[0] == lang]
        held = Counter(term for _, _, terms in own for term in set(terms))
        kept = {t for t, n in held.items() if n >= config.min_docs}
        counts = {s: Counter(t for _, source, terms in own if source == s for t in terms if t in kept) for s in {t[1] for t in own}}
        whole = sum(counts.values(), Counter())

        def shares(count, kept=kept):
            n = sum(count.values()) + config.smooth * len(kept)
            return {t: 1 + config.scale * (count[t] + config.smooth) // n for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in p:
            parts = {"pair": [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in p if o != s], "term": [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[: config.top_terms if part == "term" else None])]
    return sorted(out)


def check(spark, rows, config):
    frame = spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in divergence.audit(frame, config).collect()) == plain([r.asDict() for r in frame.collect()], config)


WORDS = "the THE and Über naïve don’t “quoted” 東京 東京 a-b x1y é É ÿ 🙂 _ q".split()
ROWS = [(k, " ".join(WORDS[(k * j) % len(WORDS)] for j in range(k % 23)), ["en", "de", None, ""][k % 4], [f"s{k % 5}", None, "", "Z"][k % 3]) for k in range(120)]
ODD = [(1, None, None, None), (2, "", "xx", "s"), (3, "123 !?", "xx", "t"), (4, "rare", "xx", "u"), (5, "LONG words " * 200_000, "en", "s1"), (5, "LONG words " * 200_000, "en", "s1"), (None, "nobody", "en", "s\0"), (6, "three three three", "l\0x", "s"), (7, "three", "l\0x", "s"), (8, "three two", "l\0x", "t")]


@pytest.mark.parametrize("config", [divergence.DivergenceConfig(), divergence.DivergenceConfig(shard_terms=7, top_terms=4, estimate=1), divergence.DivergenceConfig(min_docs=1, smooth=3, scale=1000)])
def test_audit(spark, config):
    check(spark, ROWS + ODD, config)


def test_few_documents(spark):
    check(spark, ODD[:4], divergence.DivergenceConfig())
    check(spark, [], divergence.DivergenceConfig())


def test_sums_are_sparse(spark):
    frame = spark.createDataFrame([(*r, *[None] * 4) for r in ROWS], SCHEMA)
    found = divergence.shares(frame, divergence.DivergenceConfig())
    assert found.terms.where("p <= 0").count() == 0 and found.terms.count() == found.groups.selectExpr("sum(kinds)").first()[0]


def test_terms_are_shuffled_beyond_the_limit(spark, monkeypatch):
    """The same rows where vocabulary and shares of languages are too many for a broadcast."""
    monkeypatch.setattr(divergence, "BROADCAST_TERMS", 0)
    check(spark, [(k, f"a b{k % 2} c{k % 3} a", "xy"[k % 2], "st"[k // 6]) for k in range(12)], divergence.DivergenceConfig())


def test_tokens_are_those_of_groups(spark):
    """A group's rows make one run, however many they are, and the fit sees a term in as many documents as have it, up to the least number."""
    frame = spark.createDataFrame([(f"A b a c{k % 9}", "en", "s") for k in range(90)] + [("b x", "en", "s"), ("x", "en", "s")], "text string, lang string, source string")
    rows = divergence.tokens_of(frame.coalesce(1), divergence.DivergenceConfig()).collect()
    assert len(rows) == 1 and sum(2**k for k, own in enumerate(rows[0]["tokens"]) if "en\0a" in own) == 180
    assert [("en\0x" in own, "en\0b" in own) for own in rows[0]["docs"]] == [(True, True), (True, True), (False, True)]


def test_runs_are_cut(spark, monkeypatch):
    """The same rows where tasks write their terms down early, a few in a row."""
    real = divergence.tokens_of
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    monkeypatch.setattr(divergence, "ROW_TERMS", 2)
    frame = spark.createDataFrame([(*r, *[None] * 4) for r in ROWS + ODD], SCHEMA)
    assert real(frame, divergence.DivergenceConfig()).count() > 20
    check(spark, ROWS + ODD, divergence.DivergenceConfig())
