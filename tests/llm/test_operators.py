"""Edge cases of the training-data operators, and brute-force versions where SQL has no word for them."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwarden.llm import chat, components, decontam, forest, htmltext, langid, linededup, minhash, mixing, quality, warc
from arcwarden.llm.common import stored

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, score double, n_lines long, size string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], DOCS)


LONG = " ".join(f"{w}{k}" for k in range(3000) for w in WORDS)
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "nobody's text"), (5, LONG), (6, "123 !?")]


def test_langid(spark):
    train = [(k, ("the cat sat on a mat " if k % 2 else "le chat est sur la table ") * (1 + k % 5), "en" if k % 2 else "fr") for k in range(60)]
    frame = docs(spark, train)
    model = langid.fit(frame)
    found = {r["doc_id"]: r for r in langid.identify_language(docs(spark, ODD), model).collect()}
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 and found[k]["rejected"] for k in (1, 2, 3, 6))
    right = [r["lang_pred"] == r["lang"] for r in langid.identify_language(frame, model).collect()]
    assert np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.fit(frame.where("false")) is None and langid.fit(docs(spark, [(1, "x", None)])) is None
    assert {r["lang_pred"] for r in langid.identify_language(frame, None).collect()} == {"und"}
    kept = langid.keep_identified(frame.unionByName(docs(spark, ODD)))
    assert kept.columns == frame.columns and {1, 2, 3, 6}.isdisjoint({r["doc_id"] for r in kept.where("lang is null").collect()})


def test_langid_held_out(spark):
    rows = langid.op1_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_langid_rejects(spark):
    """Shuffled letters, a language that wasn't learned and texts of next to nothing go; texts of the corpus stay."""
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(frame)
    kept = langid.identify_language(frame.where("length(text) > 200 and lang is not null"), model)
    assert kept.where("rejected").count() <= 0.02 * kept.count()
    rng = np.random.default_rng(1)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 400)) for _ in range(20)]
    dutch = "Het was een mooie dag en de jongens liepen langs het water naar huis, waar hun moeder met het eten op hen wachtte"
    polish = "Wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw, sa oni obdarzeni rozumem i sumieniem"
    out = [langid.predict_text(model, t) for t in (*junk, dutch, polish)]
    assert all(r[2] for r in out), out
    repeated = docs(spark, [(1, "the cat sat on the mat " * 9, "en"), (2, "le chat est sur la table " * 9, "fr")] * 200)
    assert len(langid._sample(repeated, langid.LangIdConfig())) < 12


def test_line_dedup(spark):
    line = "A line of more than twenty signs"
    rows = [(1, f"x\n{line}\ny"), (2, f" {line.upper()} \n{line}"), (3, f"{line}\n\n{line}"), (9, None), (8, ""), (None, line), (2, f" {line.upper()} \n{line}"), (7, "short\nshort"), (6, "short"), (5, "short")]
    long = linededup.dedup_lines(docs(spark, [*rows, (77, "\n".join(f"{line} {k}" for k in range(20_000)) + f"\n{line}")])).where("doc_id in (3, 77)").select("doc_id", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, long)) == [(3, 3, 2), (77, 20_001, 0)]
    out = linededup.dedup_lines(docs(spark, rows))
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()}
    assert found == {1: ("x\ny", 3, 1), 2: ("", 2, 2), 3: (f"{line}\n\n{line}", 3, 0), 9: (None, 1, 0), 8: ("", 1, 0), None: (line, 1, 0), 7: ("short\nshort", 2, 0), 6: ("short", 1, 0), 5: ("short", 1, 0)}
    assert out.count() == len(rows) and linededup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_runs_agree(spark):
    """Many batches and compactions give what one batch gives."""
    rng = np.random.default_rng(1)
    rows = [(int(k), "\n".join(f"line number {rng.integers(40)} of the common stock" for _ in range(6))) for k in range(120)]
    one = linededup.LineDedupConfig(batches=1)
    many = linededup.LineDedupConfig(batches=7, part_lines=50)
    a, b = (sorted(map(tuple, linededup.dedup_lines(docs(spark, rows), c).select("doc_id", "text", "n_dropped").collect())) for c in (one, many))
    assert a == b and sum(r[2] for r in a) > 0


def test_line_runs_stay_where_they_lie(spark):
    """Merging runs and meeting them with a batch moves no run: the plans' exchanges are the batch's own."""
    from contextlib import redirect_stdout
    from io import StringIO

    lines = linededup.stored(linededup.line_table(docs(spark, [(k, f"a line of enough letters, number {k % 5}\nanother line of enough letters {k}") for k in range(40)]), linededup.LineDedupConfig()), "lines")
    runs = linededup.Runs(spark, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k in range(3):
            runs.add(linededup._news(lines.where(f"doc_id % 3 = {k}"), runs, linededup.LineDedupConfig()))
        plans = []
        for df in (linededup._merged(*runs.all()), linededup._news(lines, runs, linededup.LineDedupConfig())):
            with redirect_stdout(StringIO()) as said:
                df.explain()
            plans.append(said.getvalue())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        runs.drop()
    assert "Exchange" not in plans[0], plans[0]
    assert "SortMergeJoin" in plans[1] and "Exchange" not in plans[1].split("Bucketed: true", 1)[1], plans[1]
    assert "HashAggregate" in plans[1].split("Exchange")[1], plans[1]


def near_brute(rows, width=4):
    sets = []
    for k, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((k, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    label = {k: k for k, _ in sets}
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {k: (len(s), label[k]) for k, s in sets}


def test_joined_components(spark):
    rng = np.random.default_rng(3)
    first = [*[(k, k + 1) for k in range(20, 24)], *rng.integers(0, 60, (20, 2)).tolist()]
    later = [(70, 5), (24, 80), (80, 81), (90, 91), (33, 33), *rng.integers(0, 60, (8, 2)).tolist()]
    edges = lambda rows: stored(spark.createDataFrame(rows, "a long, b long"), "edges")
    root = {}
    for a, b in [*first, *later]:
        low, high = sorted((root.get(a, a), root.get(b, b)))
        root |= {a: low, b: low} if a != b else {}
        root |= {n: low for n, r in root.items() if r == high}
    for rows in ([], later):
        joined = components.joined(stored(components.components(edges(first)), "labels"), edges(rows))
        got = [tuple(r) for r in joined.select("node", "component").collect()]
        assert len(got) == len({n for n, _ in got})
        plain = {tuple(r) for r in components.components(edges(first + rows)).select("node", "component").collect()}
        assert set(got) == plain
    assert plain == set(root.items())


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE\ttwo"), (1004, LONG), (1005, LONG + " end")]
    for family in range(8):
        base = [WORDS[x] for x in rng.integers(0, 20, 60)]
        for k in range(12):
            text = list(base)
            for at in rng.integers(0, 60, k % 5):
                text[at] = f"w{rng.integers(1000)}"
            rows.append((family * 12 + k, " ".join(text)))
    want = near_brute(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == want
    twice = docs(spark, [(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (9, "A b c d e")])
    assert sorted(r["doc_id"] or 0 for r in minhash.keep_first(twice).collect()) == [0, 3] and minhash.near_duplicates(docs(spark, [])).count() == 0


def test_densified_sketches_estimate():
    config = minhash.MinHashConfig()
    rng = np.random.default_rng(3)
    off = []
    for n in (5, 40, 400):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n * 8 // 10], rng.integers(0, 1 << 63, n - n * 8 // 10, dtype=np.uint64)])
        x, y = np.unique(a), np.unique(b)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        off.append((minhash.sketch(x, config).view(np.uint16) == minhash.sketch(y, config).view(np.uint16)).mean() - true)
    assert max(map(abs, off)) < 0.2


def plain_words(text):
    """Lower-case words, by a pattern of its own."""
    import regex

    return regex.findall(r"[\p{Thai}\p{Lao}\p{Tibetan}\p{Myanmar}\p{Khmer}\p{Hiragana}\p{Katakana}\p{Han}]|(?:(?![\p{Thai}\p{Lao}\p{Tibetan}\p{Myanmar}\p{Khmer}\p{Hiragana}\p{Katakana}\p{Han}])[\p{L}\p{N}])+", (text or "").lower())


def brute_leak(text, item, window=13, percent=80):
    """Whether some window of the item, laid word on word over some stretch of the text, agrees in enough words."""
    d, i = plain_words(text), plain_words(item)
    if len(i) < 5:
        return bool(i) and d == i
    width = min(window, len(i))
    known = {w: k for k, w in enumerate(dict.fromkeys(i))}
    d, i = np.array([known.get(w, -1) for w in d]), np.array([known[w] for w in i])
    for shift in range(width - len(i), len(d) - width + 1):  # every way to lay the item over the text
        low, high = max(0, shift), min(len(d), shift + len(i))
        same = (d[low:high] == i[low - shift : high - shift]).astype(int)
        if high - low >= width and 100 * np.convolve(same, np.ones(width, int), "valid").max() >= percent * width:
            return True
    return False


def test_decontamination(spark):
    item = " ".join(WORDS)
    swap = lambda *at: " ".join("other" if k in at else w for k, w in enumerate(WORDS))
    rows = [(1, f"intro, {item.upper()}! end"), (2, f"x y z {swap(5, 13)} end"), (3, " ".join(WORDS[:8]) + " and more"), (4, None), (5, ""), (None, item), (6, swap(*range(0, 20, 3))), (7, "tiny item text of six"), (8, "short " * 400 + item), (9, " ".join(WORDS[3:17]))]
    bench = spark.createDataFrame([(1, item), (2, "tiny item text of six"), (3, "a b"), (4, None), (None, item)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(docs(spark, rows), bench).collect()}
    want = {(k, i) for k, t, *_ in rows if k for i, x in ((1, item), (2, "tiny item text of six"), (3, "a b")) if t and brute_leak(t, x)}
    assert found == want and {(1, 1), (2, 1), (8, 1), (7, 2), (9, 1)} <= found and not {k for k, _ in found} & {3, 6}
    assert decontam.contaminations(docs(spark, []), bench).count() == 0 and decontam.contaminations(docs(spark, rows), bench.where("false")).count() == 0
    kept = decontam.drop_contaminated(docs(spark, rows), bench)
    assert kept.count() == len(rows) - len({k for k, _ in found}) and kept.columns == docs(spark, rows).columns


def test_masks_hit_all_double_substitutions():
    config = decontam.SeedConfig()
    ids = np.arange(13, dtype=np.uint64) + np.uint64(7)
    for a in range(13):
        for b in range(a):
            other = ids.copy()
            other[[a, b]] = np.uint64(1 << 40)
            assert any((decontam.seed_keys(ids, m, config) == decontam.seed_keys(other, m, config)).any() for m in config.masks)


def test_decontamination_of_short_items(spark):
    """Every placement of the substitutions that an item of 5 to 12 words may have, and one more, against brute force."""
    from itertools import combinations

    rows, want, items = [], set(), []
    for n in range(5, 13):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for subs in range(n // 5 + 2):
            for at in combinations(range(n), subs):
                rows.append((len(rows) + 1, "some words " + " ".join("other" if k in at else w for k, w in enumerate(item)) + " go on"))
                if subs <= n // 5:
                    want.add((len(rows), n))
    rows += [(9001, "Yes: forty–two!"), (9002, "yes forty two more"), (9003, "那只敏捷的棕色狐狸跳过了懒狗然后回家"), (9004, "前言。敏捷的棕色狐狸跳过了懒猫，然后"), (9005, "so “alpha—beta\u2003gamma” delta…epsilon zeta"), (9006, "Yes")]
    items += [(101, "Yes, forty two."), (102, "敏捷的棕色狐狸跳过了懒狗"), (103, "alpha beta gamma delta epsilon zeta"), (104, "..."), (105, "yes")]
    want |= {(9001, 101), (9003, 102), (9004, 102), (9005, 103), (9006, 105)}
    found = decontam.contaminations(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want


def mix_brute(rows, config=mixing.MixConfig()):
    """Taken words by a plain walk over (id, size, source) rows, as {source: [taken of each row, sorted]}; targets by filling up step by step."""
    import hashlib
    import math
    from collections import defaultdict

    by = defaultdict(list)
    for k, n, s in rows:
        by[s].append((k, n))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: config.weights[i % 3] for i, s in enumerate(order)}
    size = {s: sum(n for _, n in by[s]) for s in by}
    total, capped = sum(size.values()), set()
    while True:
        open_ = [s for s in by if s not in capped]
        level = (total - 3 * sum(size[s] for s in capped)) / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if level * weight[s] >= 3 * size[s]}
        if not more:
            break
        capped |= more
    out = {}
    for s, docs_ in by.items():
        target = round(float(3 * size[s]) if s in capped else level * weight[s], 4)
        base = math.floor(target / size[s]) if size[s] else 0
        gap = target - base * size[s]
        u = lambda k: (int(hashlib.sha256(f"mix:{'' if k is None else k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        ranked = sorted((u(k) / (1 - u(k)) / math.sqrt(max(n, 1)), i) for i, (k, n) in enumerate(docs_) if n)
        taken = set()
        for step in range(2):
            room = gap
            for _, i in ranked:
                if i not in taken and (step == 0 or docs_[i][1] <= room):
                    if docs_[i][1] > gap:
                        break
                    taken.add(i)
                    gap -= docs_[i][1]
        rest = [(abs(docs_[i][1] - gap), r, i) for r, i in ranked if i not in taken and docs_[i][1] < 2 * gap]
        taken |= {min(rest)[2]} if rest else set()
        out[s] = (target, sorted(n * (base + (i in taken)) for i, (_, n) in enumerate(docs_)))
    return out


MIX_ROWS = [(k, "w " * (1 + k % 7), None, f"s{k % 3}") for k in range(90)] + [(900, None, None, "s0"), (901, "w " * 5, None, None), (902, "", None, "empty"), (5, "w " * 6, None, "s2"), (None, "w w", None, "s1"), (77, "w " * 400, None, "s2")]


def test_decontamination_against_brute_force(spark):
    """Random substitutions, insertions and cuts over a small vocabulary; a filter too small for its keys changes nothing."""
    rng = np.random.default_rng(9)
    items = [(k, " ".join(rng.choice(WORDS, int(rng.integers(4, 40))))) for k in range(12)]
    rows = []
    for k in range(150):
        own = items[int(rng.integers(12))][1].split()
        cut = int(rng.integers(len(own)))
        part = own[cut : cut + int(rng.integers(3, 40))]
        part = [w if rng.random() > 0.12 else "zzz" for w in part]
        rows.append((k + 1, " ".join([*rng.choice(WORDS, int(rng.integers(0, 300))), *part, *rng.choice(WORDS, int(rng.integers(0, 9)))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, i) for k, t in rows for i, x in items if brute_leak(t, x)}
    for config in (decontam.SeedConfig(), decontam.SeedConfig(filter_bits=8, chunk=500, segment=32)):
        assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(docs(spark, rows), bench, config).collect()} == want
    assert len(want) > 40


def test_op3_query(spark):
    """The registered query on the small tables against brute force."""
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select("item_id" if t == "benchmark" else "doc_id", "text").collect()]
    items = [(i, x, set(plain_words(x))) for i, x in read("benchmark")]
    want = {(k, i) for k, t in read("documents") for w in [set(plain_words(t))] for i, x, own in items if len(own & w) >= 8 and brute_leak(t, x)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.op3_decontam(spark, SF).collect()} == want and want


@pytest.mark.parametrize("rank_rows", [3, 50_000])
def test_mixing(spark, rank_rows):
    config, rows = mixing.MixConfig(rank_rows=rank_rows), MIX_ROWS
    out = mixing.mix_sources(docs(spark, rows), config).collect()
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(sum(r["size"] for r in out), abs=0.01) and by["empty"][0]["target"] == 0 and by[None][0]["target"] <= 15
    want = mix_brute([(k, len((t or "").split()), s) for k, t, _, s in rows])
    assert {s: (v[0]["target"], sorted(r["taken"] for r in v)) for s, v in by.items()} == {s: (pytest.approx(t), w) for s, (t, w) in want.items()}
    again = mixing.mix_sources(docs(spark, rows[::-1]), config).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in out) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in again)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert mixing.draw_mix(docs(spark, rows)).count() == sum(r["copies"] for r in out)


def test_mixing_of_equal_rows(spark):
    """Rows without an id, and repeated rows, are cut one by one, down to the hash of the row."""
    rows = [(None, "w " * 10, None, "a")] * 300 + [(7, "w " * 10, None, "b")] * 300 + [(k, "w " * 10, None, "c") for k in range(200)]
    out = mixing.mix_sources(docs(spark, rows), mixing.MixConfig(rank_rows=5)).groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert len(out) == 3 and all(abs(r["target"] - r["sum(taken)"]) <= 5 for r in out)


def test_mixing_inclusion_frequencies(spark):
    """Over many seeds, documents are taken about as often as their design probabilities say."""
    sizes = [1 + 3 * k for k in range(40)]
    frame = spark.createDataFrame([(k, "x", n) for k, n in enumerate(sizes)], "doc_id long, source string, size long")
    seen, rest = np.zeros(40), sum(sizes) / 2
    for seed in range(60):  # one column of ranks for each seed
        frame = mixing.ranked_sizes(frame, mixing.MixConfig(seed=f"seed{seed}")).withColumnRenamed("rank", f"r{seed}")
    rows = frame.where("source = 'x'").collect()
    for seed in range(60):
        left = rest
        for r in sorted(rows, key=lambda r: r[f"r{seed}"]):  # noqa: B023
            if r["size"] > left:
                break
            left -= r["size"]
            seen[r["doc_id"]] += 1 / 60
    want = np.array(mixing.inclusion_probabilities(sizes, [n**0.5 for n in sizes], rest))
    assert abs(np.dot(want, sizes) - rest) < 0.01 and abs(seen - want).mean() < 0.08 and np.corrcoef(seen, want)[0, 1] > 0.6
    assert seen[20:].mean() - seen[:20].mean() > 0.5 * (want[20:].mean() - want[:20].mean()) > 0.05


def test_mix_keeps_clashing_columns(spark):
    frame = docs(spark, MIX_ROWS).selectExpr("doc_id", "text", "source", "'mine' as copies", "'own' as copy", "'s' as size", "1 as row", "2 as rank")
    out = mixing.draw_mix(frame)
    assert out.columns == [*frame.columns, "copies_", "copy_"] and {(r["copies"], r["copy"], r["size"], r["row"], r["rank"]) for r in out.collect()} == {("mine", "own", "s", 1, 2)}


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept them all now, please, to go on.</div><article><h1>Big&nbsp;news &amp; more</h1><p>First   part of
the <b>story</b>, told at length, with commas and a full stop.<p>Second part, longer than the first one, goes on &lt;here&gt;.<br>And there.</article>
<aside><p>Related stories that you may like, one and two and three.</p></aside><div id=comments><p>I read it all, said a reader, and it was long.</p></div><form><label>Name</label><input></form><script>var a="</p>";</script><footer>Copyright &copy; us.</footer></body></html>"""


def test_html(spark):
    want = "Big news & more First part of the story, told at length, with commas and a full stop. Second part, longer than the first one, goes on <here>. And there."
    assert htmltext.main_text(PAGE) == want
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<nav><a href=x>y</a></nav>") == ""
    assert htmltext.main_text("<article><p>A sentence that is long enough, cut in the midd<") .endswith("midd")
    assert htmltext.main_text("<p>" * 3000 + "A deep sentence, long enough to be kept, stands here all alone and goes on for some more words.").startswith("A deep")
    frame = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, text string")
    out = htmltext.extract_text(frame)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and sorted((r["page_id"], r["n_chars"]) for r in out.collect()) == [(1, len(want)), (2, 0), (2, 0)]


ARTICLE = "<article><h1>Big news</h1><p>First part of the story, told at length, with commas and a full stop.</p><p>Second part, longer than the first one, goes on and on here.</p></article>"


@pytest.mark.parametrize("name", sorted(htmltext.SKIPPED - {"head"}))
def test_html_after_unclosed_skipped(name):
    want = htmltext.main_text(ARTICLE)
    assert want.startswith("Big news First part") and want.endswith("on here.")
    for before in (f"<div><{name}><b>Junk, that is long enough to look like a sentence of some story.</b></div>", f"<{name}><b>Junk of some words.</b>", f"<div><{name}><select><option>One</{name}></div>", f"<div><{name}><p>Junk</{name}></div>", f"<p>Short<{name}><p>Junk<p>Junk</{name}></p>"):
        assert htmltext.main_text(f"<html><body>{before}{ARTICLE}</body></html>") == want or "<p>Short" in before and htmltext.main_text(f"<body>{before}{ARTICLE}") in (want, f"Short {want}"), before
    closed = f"<body><{name}><article><p>Inside, told at length, with commas and a full stop, it is left out as before.</p></article></{name}>{ARTICLE}</body>"
    assert htmltext.main_text(closed) == want
    assert htmltext.main_text(f"<head><title>x</title><meta charset=a>{ARTICLE}") == want


def page_truth(page):
    """The article's text, by patterns; pages of the small tables have one article without boilerplate inside."""
    import html
    import re

    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?p>|<br>|</?h1>", " ", inner[1]))).split()) if inner else ""


def test_op4_query(spark):
    """The registered query on the small tables against the patterns."""
    want = {(r["page_id"], t, len(t)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect() for t in [page_truth(r["html"])]}
    assert {(r["page_id"], " ".join(r["text"].split()), r["n_chars"]) for r in htmltext.op4_htmltext(spark, SF).collect()} == want


def test_html_cut_decides(spark):
    """On pages without telling elements, of sites that taught nothing, the cut mends the classifier's labels on many pages and spoils none."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = F.crc32(F.split_part("url", F.lit("/"), F.lit(3))) % 2
    weights, config = htmltext.fit(pages.where(host == 0)), htmltext.CutConfig()
    assert dict(zip(htmltext.FEATURES, weights, strict=True))["links"] != config.start["links"]
    better = worse = n = 0
    for r in pages.where(host == 1).collect():
        plain = re.sub(r"<(/?)(article|nav|footer|p|h1|li|ul)>", r"<\1div>", r["html"].replace(' class="ad"', ""))
        truth, found = [bool(b.bits & htmltext.ARTICLE) for b in htmltext.blocks(r["html"])], htmltext.blocks(plain)
        if len(found) != len(truth):
            continue
        costs = htmltext.block_costs(found, weights)
        right = lambda labels: sum(a == b for a, b in zip(labels, truth, strict=True))  # noqa: B023, E731
        cut, alone = right(htmltext.min_cut(costs, htmltext.block_edges(found, config))), right([c > 0 for c in costs])
        better, worse, n = better + (cut > alone), worse + (cut < alone), n + 1
    assert n > 80 and better >= 0.1 * n and not worse


STORY = "<h1>Big news</h1><p>First part of the story, told at length, with commas and a full stop.</p><p>Yes.</p><p>Second part, longer than the first one, goes on and on here.</p>"
STORY_TEXT = "Big news First part of the story, told at length, with commas and a full stop. Yes. Second part, longer than the first one, goes on and on here."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form action=/x><div><nav><a href=/>Home</a></nav><article>{STORY}</article></div><label>Name</label><input></form></body>",
        "<body><article><header>" + STORY.replace("</h1>", "</h1></header>") + "</article></body>",
        f"<body class='has-sidebar with-header'><div class='content with-sidebar'><main>{STORY}</main></div><div class=sidebar><p>Other things that you may like, one and two.</p></div></body>",
        f"<body><article>{STORY}</article><div id=comments><article class=comment-body><p>I read it all, said a reader, and it was long.</p></article></div></body>",
        f"<body><form class=search><p>Find what you like, all of it, in here.</p></form><article>{STORY}</article><form id=newsletter><p>Join us, it is free, and it is fun for all.</p></form></body>",
        f"<div role=navigation><p>Go to this place, or to that place, as you like.</p></div><div role=main>{STORY}</div>",
    ],
)
def test_html_wrappers(page):
    assert htmltext.main_text(page) == STORY_TEXT


def test_html_depth_takes_linear_time():
    import time

    start = time.time()
    for page in ("<div>" * 50_000 + "x y. " * 20, "<p>" * 20_000 + "<x>" * 20_000 + "</p>" * 20_000 + "end", "<div>" * 30_000 + "</x>" * 30_000, "<center>" * 20_000 + "<p>a" * 20_000):
        htmltext.main_text(page)
    assert time.time() - start < 60


def test_min_cut_is_least():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        unary = [float(x) for x in rng.normal(0, 2, n)]
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: sum(max(0, u) for u, s in zip(unary, side, strict=True) if not s) + sum(max(0, -u) for u, s in zip(unary, side, strict=True) if s) + sum(c for i, j, c in edges if side[i] != side[j])  # noqa: B023, E731
        best = min(cost([bool(k >> b & 1) for b in range(n)]) for k in range(1 << n))
        assert cost(htmltext.min_cut(unary, edges)) == pytest.approx(best)


def test_quality(spark):
    good = [(k, " ".join(np.random.default_rng(k).choice(WORDS, 40)).capitalize() + ".", "en", f"s{k % 4}") for k in range(120)]
    bad = [(500 + k, "BUY!! NOW!! " * 30, "en", f"s{k % 4}") for k in range(40)]
    frame = docs(spark, good + bad + [(900, None), (901, ""), (None, "x")]).selectExpr("doc_id", "source as site", "lang as section", "text")
    labels = spark.createDataFrame([(k, int(k < 500)) for k, *_ in good[::2] + bad[::2]] + [(7777, 1), (None, 1), (3, None)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.classify_quality(frame, labels).collect()}
    assert np.mean([found[k]["kept"] for k, *_ in good]) > 0.97 and not any(found[k]["kept"] for k, *_ in bad) and len(found) == 163
    assert all(0 <= r["quality"] <= 1 for r in found.values())
    none = quality.classify_quality(frame, labels.where("false")).collect()
    assert {round(r["doc_score"], 6) for r in none} == {0.5} and quality.classify_quality(frame.where("false"), labels).count() == 0


def test_quality_against_brute_force(spark):
    """Posteriors of sites and sections recomputed from the documents' evidence; a site of one document has the global mean."""
    rng = np.random.default_rng(3)
    text = lambda bad: "BUY!! NOW!! " * int(rng.integers(2, 9)) if bad else " ".join(rng.choice(WORDS, int(rng.integers(5, 40)))).capitalize() + "."
    rows = [(k, f"s{k % 5}" if k % 11 else None, f"p{k % 3}", text(rng.random() < 0.15 * (k % 5)), "x", 1.0) for k in range(300)] + [(900, "lonely", None, text(True), "x", 1.0), (901, "long", "p", LONG, "x", 1.0), (902, "s1", "p1", None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, site string, section string, text string, quality string, doc_score double")
    labels = spark.createDataFrame([(k, int("!!" not in (t or ""))) for k, _, _, t, *_ in rows if k % 2], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.classify_quality(frame, labels).collect()}
    assert len(found) == len(rows)
    score = {k: r["doc_score"] for k, r in found.items()}
    mu = np.mean(list(score.values()))

    def groups(key):
        out = {}
        for k, site, section, *_ in rows:
            out.setdefault(key(site, section), []).append(score[k])
        return {g: (len(v), sum(v)) for g, v in out.items()}

    def strength(stats):
        n, mean, prior = (np.array(x) for x in zip(*stats, strict=True))
        within = (n * prior * (1 - prior)).sum() / n.sum()
        between = max((n * (mean - prior) ** 2).sum() / n.sum() - (prior * (1 - prior)).sum() / n.sum(), within / 1e6)
        return min(1e6, max(1.0, within / between - 1))

    sites, sections = groups(lambda a, b: a), groups(lambda a, b: (a, b))
    k1 = strength([(n, t / n, mu) for n, t in sites.values()])
    k2 = strength([(n, t / n, (sites[a][1] + k1 * mu) / (sites[a][0] + k1)) for (a, _), (n, t) in sections.items()])
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    for k, site, section, *_ in rows:
        n1, t1, n2, t2 = *sites[site], *sections[site, section]
        above = (t1 - score[k] + k1 * mu) / (n1 - 1 + k1)
        own = (t2 - score[k] + k2 * above) / (n2 - 1 + k2)
        assert found[k]["site_posterior"] == pytest.approx(above) and found[k]["section_posterior"] == pytest.approx(own)
        assert found[k]["quality"] == pytest.approx(1 / (1 + np.exp(-(logit(score[k]) - logit(mu) + logit(own)))))
    assert found[900]["site_posterior"] == pytest.approx(mu)
    spread = lambda name: np.std([found[k][name] for k in found])
    assert spread("site_posterior") < np.std([t / n for n, t in sites.values()])


def test_clashing_columns(spark):
    """Columns that carry the names of outputs and of inner steps change nothing."""
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn long, role string, text string")
    more = turns.selectExpr("*", "1 as turns", "2 as formatted", "3 as loss_mask", "4 as t")
    assert chat.format_chats(more).collect() == chat.format_chats(turns).collect()
    rng = np.random.default_rng(7)
    vectors = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=8)]) for k in range(60)], "vec_id long, embedding array<double>")
    extra = vectors.selectExpr("*", "1 as v", "2 as shard", "3 as block", "4 as rank", "5 as score", "6 as query_id", "7 as dim")
    found = lambda df: sorted(map(tuple, forest.nearest(df, df.where("vec_id % 20 = 0")).collect()))
    assert found(extra) == found(vectors)
    bench = spark.createDataFrame([(1, " ".join(WORDS))], "item_id long, text string")
    rows = docs(spark, [(1, " ".join(WORDS)), (2, "clean")]).selectExpr("*", "1 as seg", "2 as keys", "3 as item_id", "4 as h")
    kept = decontam.drop_contaminated(rows, bench.selectExpr("*", "1 as tokens", "2 as at"))
    assert kept.columns == rows.columns and [r["doc_id"] for r in kept.collect()] == [2]


def test_warc(spark):
    pages = [(3, "http://a", "same"), (1, "http://b/é x", "same"), (5, None, None), (2, "u\r\nX: y", ""), (4, "http://c", LONG), (None, "http://d", "same"), (1, "http://b", "same")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = warc.fresh_path(spark, "warc")
    warc.write_archives(frame, path)
    found = warc.read_archives(spark, path).collect()
    b32 = lambda s: warc.payload_digest((s or "").encode())
    want = sorted((str(k), len((h or "").encode()), b32(h), {3: 1, 5: 2}.get(k)) for k, _, h in pages)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in found) == want
    assert {r["record_type"] for r in found if r["refers_to"]} == {"revisit"} and next(r["payload"] for r in found if r["page_id"] == 4).decode() == LONG
    records = warc.read_archives(spark, path)
    assert warc.broken_revisits(records).count() == 0 and warc.broken_revisits(records.where("record_type = 'revisit'")).count() == 2
    clashing = frame.selectExpr("page_id", "url", "html", "'x' as frame", "1 as key", "2 as n", "3 as first", "4 as refers_to")
    clash = warc.fresh_path(spark, "warc")
    warc.write_archives(clashing, clash)
    assert warc.read_archives(spark, clash).count() == len(pages)
    empty = warc.fresh_path(spark, "warc")
    warc.write_archives(frame.where("false"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_reader_checks():
    good = warc.record(1, "http://a", b"payload", None, warc.WarcConfig())
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"payload", b"payl0ad"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: 7", b"Content-Length: 6"), good.replace(b"Content-Length: 7", b"Content-Length: x"), good.replace(b"sha1:", b"md5:"), good.replace(b"urn:page:1", b"urn:page:y"), b"junk"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    import zstandard

    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"some words to share " * 20)).compress(good)
    archive = warc.dictionary_frame(b"some words to share " * 20) + frame + warc.FRAME_END.encode() + frame
    assert list(warc.read_frames(archive)) == [good, good]
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(archive[:-5]))


def test_chat(spark):
    rows = [(1, 1, "assistant", "a <|end|> \\ b"), (1, 0, "user", "<|turn|>"), (1, 2, "assistant", "<\\|next|>"), (1, 3, "user", None), (2, None, None, "x"), (2, 0, "assistant", ""), (None, 0, "user", "q"), (1, 2, "assistant", "<\\|next|>"), (3, 5, "user<|text|>", "<")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(frame)
    out = {r["conv_id"]: r for r in done.withColumn("turns", chat.read_turns(done["formatted"])).withColumn("loss", chat.loss_text(done["formatted"], done["loss_mask"])).collect()}
    for key in (1, 2, 3, None):
        want = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == key))
        assert [(t["role"], t["text"]) for t in out[key]["turns"]] == [(r, x) for _, r, x in want]
        assert out[key]["loss"] == "".join(x for _, r, x in want if r == "assistant")
        assert sum(m["chars"] for m in out[key]["loss_mask"]) == len(out[key]["formatted"])
    assert out[1]["formatted"].count(chat.TURN) == 3 and chat.format_chats(frame.where("false")).count() == 0


def test_forest(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 32)).astype(np.float32)
    vectors[100:140] = vectors[7]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] + [1.0] * 31), (5003, [None] + [1.0] * 31), (None, [1.0] * 32), (3, [float(x) for x in vectors[3]]), (5004, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in forest.nearest(frame, frame.where("vec_id % 20 = 0"), forest.ForestConfig(shard_rows=1000, block_queries=100)).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x = vectors.astype(float)
    recall = []
    for q in range(0, 3000, 20):
        score = np.multiply(x, x[q]).sum(axis=1)
        order = [k for k in np.lexsort((np.arange(3000), -score)) if k != q][:20]
        recall.append(len(set(order) & {k for k, _ in found[q]}) / 20)
        assert len(found[q]) == 20 and len({k for k, _ in found[q]}) == 20 and all(s == pytest.approx(score[k], abs=1e-12) for k, s in found[q])
        assert found[q] == sorted(found[q], key=lambda r: (-r[1], r[0]))
    assert np.mean(recall) >= 0.9 and 5004 not in {k for v in found.values() for k, _ in v}
    assert forest.nearest(frame.where("false"), frame.where("false")).count() == 0


@pytest.mark.parametrize("times", [3, 50])
def test_forest_repeated_rows(spark, times):
    """Repeated rows change nothing, and an id's differing rows leave room for the other ids."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(120, 16)).astype(np.float32)
    one = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = lambda df: sorted(map(tuple, forest.nearest(df, one.where("vec_id % 10 = 0")).collect()))
    want = found(one)
    assert len(want) == 12 * 20 and found(one.selectExpr("vec_id", "embedding", f"explode(sequence(1, {times}))").drop("col")) == want
    ids, x = np.repeat(np.arange(120), times), np.repeat(vectors.astype(float), times, axis=0) * np.tile(1 - 1e-6 * np.arange(times), 120)[:, None]
    out = [[], [], []]
    forest._best(ids, x, np.arange(len(ids)), 0, vectors[0].astype(float), 20, out)
    assert len(set(out[1][0])) == 20


def test_pipeline_against_brute_force(spark):
    """Stage by stage over a small table: what each stage keeps is what a plain version keeps."""
    import corpus_pipeline as c

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    identified = c.common.stored(c.identify(spark, rows, SF), "t")
    model = langid.fit(rows)
    assert ids(identified) == {r["doc_id"] for r in rows.collect() if not langid.predict_text(model, r["text"])[2]} and len(ids(identified)) >= 0.98 * rows.count()
    junk = rows.withColumn("text", F.lit("qzx vkj wqzxk jvqx zkqw xjvz qqzk vxwk jzqv kxzw")).withColumn("lang", F.lit(None).cast("string"))
    assert c.identify(spark, junk.unionByName(rows), SF).count() == identified.count()
    lined = c.common.stored(c.drop_lines(spark, identified, SF), "t")
    assert lined.columns == rows.columns and ids(lined) == ids(identified) and lined.where("n_chars != length(text)").count() == 0
    texts = [(r["doc_id"], r["text"]) for r in lined.collect()]
    single = c.common.stored(c.drop_near_duplicates(spark, lined, SF), "t")
    assert ids(single) == {k for k, (_, comp) in near_brute(texts, 5).items() if k == comp}
    clean = c.common.stored(c.decontaminate(spark, single, SF), "t")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = [set(plain_words(i)) for i in items]
    leaks = {k for k, t in texts if k in ids(single) for i, w in zip(items, words, strict=True) if len(w & set(plain_words(t))) >= 8 and brute_leak(t, i)}
    assert ids(clean) == ids(single) - leaks
    kept = [(r["doc_id"], len((r["text"] or "").encode().split()), r["source"]) for r in clean.collect()]
    want = {s: [x for x in taken if x] for s, (_, taken) in mix_brute(kept).items()}
    taken = {}
    for r in c.mix(spark, clean, SF).collect():
        assert 1 <= r["copy"] <= r["copies"] <= 3
        taken.setdefault((r["source"], r["doc_id"]), []).append(len(r["text"].encode().split()))
    got = {}
    for (source, _), sizes in taken.items():
        got.setdefault(source, []).append(sum(sizes))
    assert {s: sorted(v) for s, v in got.items()} == {s: v for s, v in want.items() if v}


def test_contract_digests(spark):
    """Digest columns on a hand-made row."""
    rows = [(1, "a\nb")]
    out = linededup.dedup_lines(docs(spark, rows)).first()
    assert hashlib.sha256(out["text"].encode()).hexdigest() == hashlib.sha256(b"a\nb").hexdigest()


SAID = "This is a paragraph of the article, with several clauses, that goes on for a while and ends here. It even has a second sentence."
REMARK = "I liked this a lot, thank you for writing it. COMMENT"


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        (f"<article><p>{SAID} one</p><p class='legal-text'>{SAID} two</p><p>{SAID} three</p></article>", "one two three"),
        (f"<article><p>{SAID} one</p><div class='related-work'>{SAID} two</div><p>{SAID} three</p></article>", "one two three"),
        (f"<article><p>{SAID} one</p><div class='share-price'>{SAID} two</div><p>{SAID} three</p></article>", "one two three"),
        (f"<article><p>{SAID} one</p><div class='advert'>{SAID} two</div><p>{SAID} three</p></article>", "one three"),
        (f"<article><p>{SAID} one</p><p>{SAID} two</p><section id='discussion'><p>{REMARK}</p></section></article>", "one two"),
        (f"<article><p>{SAID} one</p><p>{SAID} two</p></article><ol><li>{REMARK}</li><li>{REMARK}</li></ol>", "one two"),
    ],
)
def test_html_names_and_places(spark, page, kept):
    """Names that articles use too don't take paragraphs out of them; adverts and comments go, with and without telling names."""
    learned = htmltext.fit(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html"))
    for weights in (None, learned):
        text = htmltext.main_text(f"<body><nav><a href='/'>Home</a></nav>{page}</body>", weights)
        assert [w for w in ("one", "two", "three") if f". {w}" in text] == kept.split() and "COMMENT" not in text


def plain_buckets(text, config):
    """Buckets of all n-grams by their definition, word by word, in 32 bits."""
    out, low = [], 0xFFFFFFFF
    words, word = [], ""
    for c in text + " ":
        if c.isalpha():
            word += c.lower()[0]
        elif word:
            words.append(word)
            word = ""
    for w in words:
        p = [32, *map(ord, w), 32]
        two = [(a * 0x01000193 + b) & low for a, b in zip(p, p[1:])]
        three = [(h * 0x01000193 + c) & low for h, c in zip(two, p[2:])]
        four = [(h * 0x01000193 + c) & low for h, c in zip(three, p[3:])]
        for h in [*two, *(h ^ 0x5BD1E995 for h in three), *(h ^ 0x27D4EB2F for h in four)]:
            h = ((h ^ (h >> 15)) * 0x85EBCA6B) & low
            out.append(((h ^ (h >> 13)) & low) % config.buckets)
    return out


def test_langid_against_plain_version():
    """Predictions from n-grams counted word by word, whatever the chunk; a letter's place in a chunk changes nothing."""
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcÄéß東京 .-7\nI'’"), int(n))) for n in rng.integers(1, 60, 60)] + ["a", "ab", "  x  ", "word " * 50]
    scores = rng.normal(size=(1 << 16, 3)).astype(np.float32)
    known = rng.random(1 << 16) < 0.9
    for chunk in (1, 8, 1 << 20):
        config = langid.LangIdConfig(chunk=chunk)
        model = langid.LangIdModel(("a", "b", "c"), scores, np.array([0.1, 0.0, -0.2]), 1.3, 20.0, 0.4, known, 0.85, config)
        for text in texts:
            grams = plain_buckets(text, config)
            assert sorted(np.concatenate([np.zeros(0, np.int64), *langid.subword_buckets(text, config)]).tolist()) == sorted(grams)
            if not grams:
                assert langid.predict_text(model, text) == ("und", 0.0, True)
                continue
            z = (np.mean(scores[grams].astype(np.float64), axis=0) + model.bias) / (1.3 * (1 + 20.0 / len(grams)))
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            lang, score, rejected = langid.predict_text(model, text)
            assert lang == "abc"[int(p.argmax())] and abs(score - p.max()) < 1e-4
            assert rejected == (score < 0.4 or sum(known[g] for g in grams) < 0.85 * len(grams))


def test_langid_sample_is_bounded(spark):
    """Long texts and many languages make the sample smaller, not the texts; a training row keeps all its n-grams."""
    frame = docs(spark, [(k, " ".join(WORDS[(k * j) % 20] + "xyzq"[j % 4] * (1 + j % 9) for j in range(900)), f"l{k % 4}") for k in range(1, 200)])
    config = langid.LangIdConfig(max_chars=200_000)
    rows = [r for r in langid._sample(frame, config) if r[2] == langid.TRAIN]
    assert 4 < len(rows) < 80 and len({r[1] for r in langid._sample(frame, langid.LangIdConfig(max_langs=2))}) == 2
    text = frame.where(F.col("doc_id") == rows[0][0]).first()["text"]
    assert len(rows[0][3]) == len(set(plain_buckets(text, config)))


def test_small_sets_need_no_sketch():
    config = minhash.MinHashConfig()
    assert minhash.least_agreement(np.array([1, 5, 10]), config).tolist() == [0, 0, 0] and 70 < minhash.least_agreement(np.array([10_000]), config)[0] < 80
    rng, lost = np.random.default_rng(5), 0
    for n in (5, 10, 20, 40, 80, 160, 640):
        for _ in range(400):
            x = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(x[:n]), np.unique(x[n // 4 - n // 8 :][: n + n // 8])
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * both >= 80 * either:
                agree = (minhash.sketch(a, config).view(np.uint16) == minhash.sketch(b, config).view(np.uint16)).sum()
                lost += agree < minhash.least_agreement(np.array([max(len(a), len(b))]), config)[0]
    assert lost == 0


def test_chat_merges_adjacent_turns(spark):
    rows = [(1, k, role, text) for k, (role, text) in enumerate([("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", None), ("assistant", "<|d"), ("user", "e " * 400_000)])]
    blocks = chat.merged_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()["blocks"]
    assert [(b["role"], len(b["texts"])) for b in blocks] == [("user", 2), ("assistant", 3), ("user", 1)] and blocks[1]["texts"] == ["c", "", "<\\|d"]


def test_only_named_sets_of_like_sizes_move(spark):
    """Pairs are confirmed as by their sets alone; sets that no pair of like sizes names stay where they are."""
    held = {k: list(range(k % 4, 20 + 30 * (k == 7))) for k in range(12)}
    sets = minhash.stored(spark.createDataFrame([(k, len(v), v) for k, v in held.items()], "doc_id long, n long, shingles array<long>"), "sets")
    pairs = spark.createDataFrame([(0, 1), (0, 7), (1, 7), (0, 3), (2, 3)], "a long, b long")
    found = minhash.confirmed(pairs, sets, minhash.MinHashConfig())
    similar = lambda a, b: 100 * len({*held[a]} & {*held[b]}) >= 80 * len({*held[a]} | {*held[b]})
    assert sorted(map(tuple, found.collect())) == sorted((r["a"], r["b"]) for r in pairs.collect() if similar(r["a"], r["b"])) != []
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2


def test_refuted_pairs_are_asked_once(spark, monkeypatch):
    """Families of three whose texts share a bucket but too few shingles, and one of true copies: no pair is confirmed in two rounds."""
    asked, real = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, sets, config: (asked.append(sorted(map(tuple, pairs.select("a", "b").collect()))), real(pairs, sets, config))[1])
    words = [[f"w{f}x{k}" for k in range(200)] for f in range(9)]
    rows = [(3 * f + v, " ".join(w if not v or k % 50 != 11 * v or not f else f"e{v}" for k, w in enumerate(own)) + f" {'tail ' * v * bool(f)}" + " ".join(f"t{f}v{v}k{k}" for k in range(22 * bool(f)))) for f, own in enumerate(words) for v in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, [(d, t.strip()) for d, t in rows])).collect()}
    assert got == {d: 0 if d < 3 else d for d, _ in rows}
    assert len(asked) > 1 and asked[0] and all(not {*x} & {*y} for x, y in zip(asked, asked[1:], strict=False))
    assert "bands" not in minhash.signatures(docs(spark, rows[:1]), minhash.MinHashConfig()).columns
