"""The training-data operators against brute force, round trips and held-out rows, and on the awkward rows."""

import itertools
import math
import os
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import common, decontaminate, embedding_dedup, langid, licenses, line_dedup, queries, repair, simhash, sptok, suffix_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, node long, h long, words string, gram long"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with extra columns whose names clash with our own."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 1, 2, "w", 3) for r in rows], DOC)


def words(n, seed, pool=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}x{seed % 7}" for _ in range(n)]


AWKWARD = [(1, None), (2, ""), (3, "   \n\n "), (None, "alpha beta gamma"), (4, "one"), (4, "one"), (5, "long " * 60_000), (6, "♥ ▁▁  x"), (7, "!!!")]


@pytest.mark.parametrize("run", [
    simhash.groups, simhash.keep_first, line_dedup.drop_boilerplate, suffix_dedup.repeated_passages, licenses.detect, repair.shards, sptok.encode,
    lambda d: langid.identify(d, langid.fit(d)), lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 200).alias("text"))),
    lambda d: toxicity.classify(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("toxic")))), lambda d: toxicity.keep_clean(d, toxicity.NOTHING),
])
def test_awkward_and_empty(spark, run):
    d = docs(spark, AWKWARD)
    run(d).collect()
    assert run(d.where("false")).count() == 0


def test_simhash_is_exact(spark):
    rng, base = random.Random(1), [words(80, s) for s in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        for e in range(4):
            v = list(w)
            for _ in range(e * 3):
                v[rng.randrange(len(v))] = f"new{rng.randrange(999)}"
            rows.append((100 + 4 * i + e, " ".join(v)))
    d = docs(spark, rows)
    u = np.array([(r.lo, r.hi) for r in simhash.fingerprints(d).select("lo", "hi").distinct().collect()]).view(np.uint64)
    want = set()
    for i in range(len(u)):
        for j in range(i):
            if sum(int(x).bit_count() for x in u[i] ^ u[j]) <= simhash.TAU:
                want.add(frozenset((tuple(u[i]), tuple(u[j]))))
    got = simhash.near_pairs(spark.createDataFrame(u.view(np.int64).tolist(), "lo long, hi long")).collect()
    assert {frozenset((tuple(np.array([r.alo, r.ahi]).view(np.uint64)), tuple(np.array([r.blo, r.bhi]).view(np.uint64)))) for r in got} == want and len(want) > 60
    assert len(got) == len(want)
    rows = simhash.groups(d).collect()
    groups = {r.doc_id: r.group_id for r in rows}
    of = {r.doc_id: tuple(np.array([r.lo, r.hi]).view(np.uint64)) for r in simhash.fingerprints(d).collect()}
    degree = Counter(x for pair in want for x in pair)
    assert {r.doc_id: r.n_links for r in rows} == {i: degree[f] for i, f in of.items()}
    assert all(groups[100 + 4 * i] == i and not any(groups[j] == i for j in range(30) if j != i) for i in range(30))
    assert {r.doc_id for r in simhash.keep_first(d).collect()} == set(groups.values())


def _near_one(n, flips, seed=1):
    """Distinct fingerprints (lo, hi) that differ from one in at most ``flips`` bits."""
    rng = np.random.default_rng(seed)
    bits = np.repeat(rng.integers(0, 2, (1, 128), np.uint8), n, axis=0)
    for row in bits:
        row[rng.choice(128, rng.integers(0, flips + 1), replace=False)] ^= 1
    return np.unique(np.packbits(bits, axis=1, bitorder="little").view(np.int64), axis=0)


def test_simhash_holds_no_square_of_a_dense_group():
    u = _near_one(2000, 9)
    rows = pa.RecordBatch.from_arrays([pa.array(u[:, k].copy()) for k in (0, 1)], names=["lo", "hi"])
    batches = pa.Table.from_batches(simhash._spread(iter([rows]))).sort_by("place").combine_chunks().to_batches(10_000)
    tracemalloc.start()
    pairs = sum(b.num_rows for b in simhash._search(iter(batches), simhash.TAU))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == len(u) * (len(u) - 1) // 2 and peak < 60e6


def test_simhash_counts_links_without_their_pairs(spark):
    u = np.concatenate([_near_one(400, 12, seed) for seed in (1, 2, 3)])
    near = np.bitwise_count(u[:, None].view(np.uint64) ^ u[None].view(np.uint64)).sum(axis=2) <= simhash.TAU
    links = near.sum(axis=1) - 1
    rows = simhash.near_links(spark.createDataFrame(u.tolist(), "lo long, hi long")).collect()
    got, at = Counter(), {tuple(x): k for k, x in enumerate(u.tolist())}
    root = np.arange(len(u))
    for r in rows:
        got[at[r.lo, r.hi]] += r.n
        common.union(root, np.array([at[r.lo, r.hi]]), np.array([at[r.rlo, r.rhi]]))
    assert [got[k] for k in range(len(u))] == links.tolist()
    want = np.arange(len(u))
    common.union(want, *np.nonzero(near))
    assert root.tolist() == want.tolist()
    assert len(rows) < links.sum() / 4


def test_simhash_groups_write_no_row_a_pair(spark, monkeypatch):
    base = words(300, 1, 5000)
    d = docs(spark, [(i, " ".join([*base, *(f"new{i}x{e}" for e in range(4))])) for i in range(400)])
    sizes, durable = [], simhash.durable
    monkeypatch.setattr(simhash, "durable", lambda df: sizes.append((x := durable(df)).count()) or x)
    rows = simhash.groups(d).collect()
    assert {r.group_id for r in rows} == {0} and sum(r.n_links for r in rows) > 100_000
    assert max(sizes) < 10_000


def test_simhash_sends_fingerprints_of_one_part_by_many_tasks(spark, monkeypatch):
    def numbered(batches):
        from pyspark import TaskContext

        for batch in batches:
            place = pa.array([TaskContext.get().partitionId()] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([place, batch.column(0), batch.column(1)], names=["place", "lo", "hi"])

    u = _near_one(3000, 19)
    d = spark.createDataFrame(u.tolist(), "lo long, hi long").coalesce(1)
    want = {tuple(x) for x in u.tolist()}
    monkeypatch.setattr(simhash, "_SPREAD", 500, raising=False)
    monkeypatch.setattr(simhash, "_spread", numbered)
    rows = simhash._spread_out(d).collect()
    assert {(r.lo, r.hi) for r in rows} == want and len(rows) == len(want)
    assert max(Counter(r.place for r in rows).values()) < 1000


def test_components_both_ways(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)], "a long, b long")
    small, large = ({r.node: r.root for r in common.components(edges, n).collect()} for n in (10**6, 1))
    assert small == large and {small[k] for k in range(100, 131)} == {100}


def test_line_dedup(spark, monkeypatch):
    rows = [(i, f"menu\nbody {i}\n\n menu ", "en", "a" if i < 10 else None) for i in range(20)] + [(30 + i, "menu\nrare", "en", f"h{i}") for i in range(3)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs(spark, rows), count_col="gone").collect()}
    assert got[3].text == "body 3\n" and got[3].gone == 2 and got[13].text == "body 13\n" and got[31].text == "menu\nrare"
    assert len(line_dedup.drop_boilerplate(docs(spark, rows)).columns) == 9
    odd = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n", "en", "a"), (4, "x\ny", "en", "a"), (4, "x\nz", "en", "a"), (None, "x", "en", "b")]
    d = docs(spark, odd).withColumn("gone", F.lit("clash"))
    want = {(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "y", 1), (4, "z", 1), (None, "x", 0)}
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 1 << 20)
    assert {(r.doc_id, r.text, r.gone) for r in line_dedup.drop_boilerplate(d, count_col="gone").collect()} == want
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)  # the other way gives the same rows
    assert {(r.doc_id, r.text, r.gone) for r in line_dedup.drop_boilerplate(d, count_col="gone").collect()} == want
    assert {r.doc_id: r for r in line_dedup.drop_boilerplate(docs(spark, rows), count_col="gone").collect()} == got


def test_suffix_sort_against_windows(spark):
    rng, depth = random.Random(4), 12
    shared = [words(30, 90 + k) for k in range(3)]
    rows = []
    for i in range(40):
        w = words(rng.randrange(0, 60), i)
        if i % 3 == 0:
            w += shared[i % 2] + words(5, i + 50)
        rows.append((i, " ".join(w)))
    rows += [(100, "a b " * 40), (101, "c " * 30), (0, rows[0][1])]
    seen = defaultdict(list)
    for i, t in sorted(set(rows)):
        w = re.findall(r"\w+", t)
        for s in range(len(w) - depth + 1):
            seen[tuple(w[s : s + depth])].append((i, s))
    want = {x: min(at) for at in seen.values() if len(at) > 1 for x in at}
    got = {}
    for r in suffix_dedup.repeated_passages(docs(spark, rows), depth=depth).collect():
        for k in range(r.n_words - depth + 1):
            assert (r.doc_id, r.start + k) not in got
            got[r.doc_id, r.start + k] = (r.first_doc_id, r.first_start + k)
    assert got == want and len(want) > 100


def test_a_gram_in_half_of_all_documents(spark):
    """Grams that many share go another way, to the same rows."""
    rng, notice = random.Random(11), words(40, 77)
    rows = [(i, " ".join(words(rng.randrange(5, 30), i) + (notice if i % 2 else []) + words(9, i + 300))) for i in range(80)]
    d = docs(spark, [*rows, rows[1], (500, " ".join(notice * 3))])
    plain, split = ({tuple(r) for r in suffix_dedup.repeated_passages(d, depth=12, hot=h).collect()} for h in (10**6, 8))
    assert plain == split and len({r[0] for r in plain}) >= 41


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for n in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '/root/testdata/sf0.001/{n}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), duck.execute(queries.SQL[name]).df()
    rows = lambda df: sorted(df[sorted(df.columns)].astype(object).itertuples(index=False, name=None), key=repr)
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_decontamination_recall(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng.randrange(20, 50), 200 + i, 5000))) for i in range(60)]
    rows, planted = [], set()
    for i in range(120):
        w = words(100, i, 5000)
        if i < 60:
            leak = [x if rng.random() > 0.08 else "zz" for x in items[i][1].split()]
            w[40:40] = leak
            planted.add((i, i))
        rows.append((i, " ".join(w)))
    bench = spark.createDataFrame(items + [(None, None), (99, "")], "item_id long, text string")
    d = docs(spark, rows)
    truth = set()
    seeds = [t.split() for _, t in items]
    for i, t in rows:
        w = t.split()
        for j, b in enumerate(seeds):
            n = min(decontaminate.WINDOW, len(b))
            for o in range(-len(b), len(w)):
                m = [0 <= o + k < len(w) and w[o + k] == x for k, x in enumerate(b)]
                if any(o + k >= 0 and o + k + n <= len(w) and sum(m[k : k + n]) >= math.ceil(decontaminate.MATCH * n) for k in range(len(b) - n + 1)):
                    truth.add((i, j))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(d, bench).collect()}
    assert got <= truth and len(got & truth) >= 0.9 * len(truth) and len(planted & got) >= 54
    parts = {(r.doc_id, r.item_id) for r in decontaminate.contamination(d, bench, part_bytes=3000).collect()}
    assert parts == got and {r.doc_id for r in decontaminate.clean(d, bench).collect()} == {i for i, _ in rows} - {i for i, _ in got}


def test_decontamination_finds_all_copies_of_short_items():
    """Items of 1 to 14 words, with each choice of as many substitutions as MATCH accepts; one more is no copy."""
    for n in range(1, 15):
        item = [f"i{n}w{k}" for k in range(n)]
        seeds, most = decontaminate.Seeds([(n, " ".join(item))]), n - math.ceil(decontaminate.MATCH * n - 1e-9)
        for e in (most, most + 1):
            texts = [" ".join(["before", *("new" if k in gone else w for k, w in enumerate(item)), "after"]) for gone in itertools.combinations(range(n), e)]
            found = seeds.overlaps(*common.WordHashes().texts(texts))
            assert found == ({(d, 0): (n, 1) for d in range(len(texts))} if e == most else {}), (n, e)


def test_toxicity_held_out_and_fair():
    rng = random.Random(6)
    bad, groups = ["nastyword", "vileword", "awfulword"], list(toxicity.IDENTITY[3]) + list(toxicity.IDENTITY[0][:2])
    rows = []
    for i in range(600):
        w, y = words(40, i, 300), int(i % 4 == 0)
        if y:
            w += rng.sample(bad, 2)
        if (y and rng.random() < 0.7) or rng.random() < 0.05:
            w.append(groups[0])  # the biased label: one group is named mostly in toxic texts
        rows.append((Counter(w), y))
    plain, fair = (toxicity.train(rows[:400], fair=x) for x in (0.0, 50.0))
    score = lambda m, c: toxicity.Scorer(m).texts([" ".join(c.elements())])[0]
    right = sum((score(fair, c) > 0) == bool(y) for c, y in rows[400:])
    assert right >= 190
    neutral = [Counter([*words(40, 1000 + k, 300), groups[0]]) for k in range(20)]
    gap = lambda m: np.mean([abs(score(m, c) - score(m, toxicity.swapped(c))) for c in neutral])
    assert gap(fair) < 0.3 * gap(plain)
    assert sum(score(fair, c) > 0 for c in neutral) == 0


def test_toxicity_features_and_loss_against_brute_force():
    """Features counted one by one, and a point from which no step in any feature lessens the loss."""
    make, words = toxicity.Features(), Counter({"muslim": 2, "abcdefghij": 1, "a": 5})
    import xxhash

    plain = Counter()
    for w, c in words.items():
        for f in {w, *(w[:k] + "*" for k in range(4, 9) if len(w) > k)}:
            plain[f] += c
    f, v = toxicity.of_words(words, make)
    assert dict(zip(f.tolist(), v.tolist())) == {int(np.uint64(xxhash.xxh64_intdigest(x)).view(np.int64)): min(1.0, toxicity.RATE * c / 8) for x, c in plain.items()}
    rng = random.Random(2)
    rows = [(Counter(words_) , y) for words_, y in (([f"w{rng.randrange(25)}" for _ in range(12)] + ["bad"] * y + ["man"] * (i % 3 == 0), y) for i, y in ((i, i % 2) for i in range(60)))]
    b, hashes, w = toxicity.train(rows, ridge=1e-2)

    def loss(b, w):
        at, total = dict(zip(hashes.tolist(), w.tolist())), 0.0
        dot = lambda c: sum(x * at.get(k, 0.0) for k, x in zip(*(z.tolist() for z in toxicity.of_words(c, make))))
        named = [c for c, _ in rows if not toxicity.SWAP.keys().isdisjoint(c)]
        for c, y in rows:
            z = b + dot(c)
            total += (math.log1p(math.exp(-z)) if y else math.log1p(math.exp(z))) / len(rows)
        return total + 0.5e-2 * float(w @ w) + toxicity.FAIR / len(named) * sum((dot(c) - dot(toxicity.swapped(c))) ** 2 for c in named)

    here = loss(b, w)
    for k in range(len(w)):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(b, moved) > here
    text = " ".join(rows[0][0].elements())
    at = dict(zip(hashes.tolist(), w.tolist()))
    assert abs(toxicity.Scorer((b, hashes, w)).texts([text])[0] - b - sum(x * at[k] for k, x in zip(*(z.tolist() for z in toxicity.of_words(rows[0][0], make))))) < 1e-5
    assert toxicity.train([(Counter("ab"), 1)] * 3) is toxicity.NOTHING


def test_licenses(spark):
    assert len(licenses.rules()) >= 200
    scan = licenses.Scanner().scan
    assert [x[4] for x in scan("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.")] == ["Apache-2.0", "MIT"]
    assert [x[4] for x in scan("SPDX-License-Identifier: MIT")] == ["MIT"]
    assert scan("nothing to see") == []
    text = "GNU  Lesser General\nPublic License v2.1 and SPDX-License-Identifier: GPL-2.0-only; see the LICENSE file for details. BSD-3-Clause license, MIT License"
    brute = licenses.resolve([(p, m.start(), m.end(), k, m.group("id").rstrip(".") if n == "*SPDX" else n) for k, (p, n, _, rx) in enumerate(licenses.rules()) if n != "*SPDX-EXPRESSION" for m in rx.finditer(text)])
    assert scan(text) == brute and len(brute) >= 4


@pytest.mark.parametrize("text, name", [
    ("GNU General\nPublic License, version 3", "GPL-3.0"), ("Mozilla\nPublic  License, v. 2.0", "MPL-2.0"), ("CC-BY 4.0", "CC-BY-4.0"), ("CC-BY-SA 4.0", "CC-BY-SA-4.0"),
    ("Permission is\nhereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT"), ("Licensed under the EUPL, Version 1.2", "EUPL-1.2"),
    ("Creative Commons Attribution-Non-Commercial", "CC-BY-NC"), ("see COPYING for details", "LicenseRef-SeeFile"), ("may not be copied without", "LicenseRef-NoRedistribution"), ("Copyright (c) 2000-2006, The Perl Foundation", "Artistic-2.0"),
])
def test_license_notices_whose_keyword_is_wrapped_or_spelt_otherwise(text, name):
    assert [x[4] for x in licenses.Scanner().scan(text)] == [name]


def _matched_by(tree, rng, blank):
    """A text that a parsed pattern matches, by random branches and repeats."""
    out = []
    for op, a in tree:
        match str(op):
            case "LITERAL":
                out.append(chr(a))
            case "SUBPATTERN":
                out.append(_matched_by(a[3], rng, blank))
            case "BRANCH":
                out.append(_matched_by(rng.choice(a[1]), rng, blank))
            case "IN":
                kind, x = rng.choice(a)
                out.append({"LITERAL": lambda: chr(x), "RANGE": lambda: chr(rng.randint(*x)), "CATEGORY": lambda: {"CATEGORY_SPACE": blank, "CATEGORY_DIGIT": "7"}.get(str(x), "q")}[str(kind)]())
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += [_matched_by(a[2], rng, blank) for _ in range(rng.randint(a[0], min(int(a[1]), a[0] + 2)))]
            case other:
                assert other == "AT", other
    return "".join(out)


def test_license_gate_drops_nothing():
    """Gated scans are those of all rules, on texts made from each rule with wrapped, doubled and tabbed blanks."""
    scanner = licenses.Scanner()
    for k, (_, name, _, rx) in enumerate(licenses.rules()):
        rng, seen = random.Random(k), 0
        for _ in range(10):
            made = _matched_by(re._parser.parse(rx.pattern, re.IGNORECASE), rng, rng.choice([" ", "\n", "  ", "\t", "\u00a0"]))
            if rx.search(made):
                seen += 1
                for text in (made, made.upper(), made.replace("s", "\u017f")):
                    assert scanner.scan(text) == scanner.matches(licenses.bare(text), range(len(scanner.rules))), (name, text)
                for lead in (" * ", "# ", "// ", ";; ", "-- "):
                    wrapped = f"/*\n{lead}" + re.sub(r"\s+", f"\n{lead}", made)
                    assert (k in {x[3] for x in scanner.matches(licenses.bare(wrapped), [k])}) == bool(rx.search(re.sub(r"\s+", "\n", made))), (name, wrapped)
                    assert scanner.scan(wrapped) == scanner.matches(licenses.bare(wrapped), range(len(scanner.rules)))
        assert seen, name


def test_license_resolve_is_fast_and_that_of_the_plain_rule():
    began = time.time()
    assert len(licenses.Scanner().scan("MIT License.\n" * 80_000)) == 80_000 and time.time() - began < 10
    for seed in range(200):
        rng = random.Random(seed)
        found = [(rng.randrange(3), a, a + rng.randrange(1, 9), rng.randrange(4), "x") for a in (rng.randrange(20) for _ in range(25))]
        taken = []
        for row in sorted(set(found), key=lambda r: (-r[0], r[1] - r[2], r[1], r[3])):
            if not any(t[1] <= row[1] and row[2] <= t[2] for t in taken):
                taken.append(row)
        assert licenses.resolve(found) == sorted(taken, key=lambda r: (r[1], r[2], r[3]))


def test_language_id_words_then_grams(spark):
    model = list(langid.count([("en", "the house the dog the cat house dog"), ("de", "der hund das haus der hund das haus")]))
    scorer = langid.Scorer(model)
    assert scorer.word("the")[1] and not scorer.word("hundhaus")[1]
    n4 = {r[2] for r in model if r[0] == "4"}
    hit = [scorer.tables["4"][g] for g in langid.grams("hundhaus", 4) if g in n4]
    assert scorer.word("hundhaus")[0] == [sum(x) / len(hit) for x in zip(*hit)]
    got = scorer.texts(["the dog", "hundhaus", None, "", "12 !", "ßßß"])
    assert [g[0] for g in got[:5]] == ["en", "de", None, "und", "und"]
    text, total = "the dog xylo dog", np.zeros(2)
    for w in text.split():
        total += scorer.word(w)[0]
    assert scorer.texts([text])[0][0] == scorer.langs[int(np.argmax(total))]


def test_language_id_fit_counts_all_and_identifies_held_out_texts(spark):
    rng, langs = random.Random(3), ("aa", "bb", "cc")
    pool = {x: ["".join(rng.choice("aeiou" + "bcdfghklmnprst"[3 * k : 3 * k + 8]) for _ in range(rng.randrange(3, 9))) for _ in range(400)] for k, x in enumerate(langs)}
    text = lambda x: " ".join(rng.choice(pool[x]) for _ in range(40))
    train = [(i, text(langs[i % 3]), langs[i % 3]) for i in range(150)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "x y", None), train[0]]
    d = docs(spark, train + odd)
    model = langid.fit(d)
    assert model == langid.count((x, t) for t, x in {(t, x) for _, t, x in [*train, (901, "", "aa")]})
    part = langid.fit(d, sample=60)
    assert {r[:3] for r in part} < {r[:3] for r in model} and 20 < sum(r[3] for r in part if r[0] == "w") / 40 < 110
    held = [(i, text(langs[i % 3]) + " zzqq", langs[i % 3]) for i in range(200)]
    got = {r.doc_id: r for r in langid.identify(docs(spark, held + [(500, None), (501, "")]), model).collect()}
    assert sum(got[i].predicted == x for i, _, x in held) >= 196
    assert got[500][1:] == (None, None, None, None) and got[501][1:] == ("und", 0, 0, 0.0)
    # ties: the language that sorts first
    tie = langid.Scorer(langid.count([("bb", "same"), ("aa", "same")]))
    assert tie.texts(["same same"])[0][0] == "aa"


def test_embedding_pairs_are_exact(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 32))
    near = base + rng.normal(size=base.shape) * rng.choice([0.1, 0.3, 0.33, 0.4], size=(60, 1))
    x = np.concatenate([base, near, base[:5]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (None, [1.0] * 32), (904, [1.0, 2.0]), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("a", F.lit(1)).withColumn("v", F.lit("x"))
    y = x.astype(float)
    c = (y @ y.T) / np.sqrt((y**2).sum(1)[:, None] * (y**2).sum(1)[None, :])
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min(root[j] for j in np.flatnonzero(c[i] >= 0.95)) for i in range(len(x))]
    rows = embedding_dedup.groups(df).collect()
    got = {r.vec_id: r.group_id for r in rows}
    _, one = np.unique(x, axis=0, return_index=True)
    for r in rows:
        if r.vec_id is not None and r.vec_id < len(x):
            assert r.n_links == sum(c[r.vec_id, k] >= 0.95 and (x[r.vec_id] != x[k]).any() for k in one)
    assert [got[i] for i in range(len(x))] == root and len(set(root)) < 100
    assert [got[k] for k in (900, 901, 902, 903, 905)] == [900, 901, 902, 903, 904]
    assert embedding_dedup.groups(df.where("false")).count() == 0


def test_repair_round_trip(spark):
    rows = [(i, " ".join(words(200, i % 9, 60))) for i in range(60)] + [(200, None), (201, ""), (None, "x y z"), (7, "again again again again again again again again again")]
    d, t = docs(spark, rows).coalesce(1), repair.tokenizer()
    out = repair.shards(d, shard_ids=3000)
    want = sorted((repr(i), None if x is None else tuple(t.encode_ordinary(x))) for i, x in rows)
    assert sorted((repr(r.doc_id), None if r.token_ids is None else tuple(r.token_ids)) for r in repair.read(out).collect()) == want
    for r in out.collect():
        s = repair.Shard(r)
        assert sum(len(x) for x in (s.symbols, s.rules.ravel())) < sum(c or 0 for c in s.counts)
        ids = s.decode(1)
        assert all(s.decode_range(1, a, b).tolist() == ids[a:b] for a in range(0, len(ids), 17) for b in (a, a + 1, a + 40))


def test_repair_rules_are_frequent_pairs():
    seq = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 9, 9, 9, 9, 9], np.int32)
    s, ends, rules, lengths = repair.compress(seq, np.array([3, 16]), 10, min_count=2)
    assert rules[0].tolist() == [1, 2] and repair.expand(s, rules, 10).tolist() == seq.tolist()
    assert repair.expand(s[: ends[0]], rules, 10).tolist() == [1, 2, 3]
    assert all(len(repair.expand(np.array([10 + k]), rules, 10)) == n for k, n in enumerate(lengths))


def _pairs_left(symbols, ends):
    return Counter(p for a, b in zip([0, *ends], ends) for p in zip(symbols[a:b].tolist(), symbols[a + 1 : b].tolist()))


def test_repair_goes_on_until_no_pair_is_frequent():
    """Ten copies of a passage in a shard of other ids, and a long run: each round of theirs shortens the shard by far less than 1 %."""
    rng = np.random.default_rng(1)
    passage = rng.permutation(2000) + 1000
    parts = [x for _ in range(10) for x in (rng.integers(3000, 1_000_000, 40_000), passage)] + [np.zeros(5000, np.int64), np.arange(0)]
    seq, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    s, e, rules, lengths = repair.compress(seq, ends, 1_000_000)
    assert max(_pairs_left(s, e).values()) < repair.MIN_COUNT
    assert len(s) < 400_000 + 10 * 8 + 32
    assert repair.expand(s, rules, 1_000_000).tolist() == seq.tolist()
    assert all(len(repair.expand(s[a:b], rules, 1_000_000)) == len(p) for a, b, p in zip([0, *e], e, parts))


def test_repair_leaves_no_frequent_pair_of_small_alphabets():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        seq, ends = rng.integers(0, 1 + seed % 6, 3000), np.sort(np.append(rng.integers(0, 3001, seed % 5), 3000))
        s, e, rules, lengths = repair.compress(seq, ends, 6)
        assert max(_pairs_left(s, e).values(), default=0) < repair.MIN_COUNT
        assert [repair.expand(s[a:b], rules, 6).tolist() for a, b in zip([0, *e], e)] == [seq[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_repair_takes_the_more_frequent_pair_then_the_left_one():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        at = np.flatnonzero(rng.random(60) < 0.8)
        rank, want = rng.integers(0, 1 + seed % 9, len(at)), set()
        for k in np.lexsort((at, rank)):
            if not want & {at[k] - 1, at[k] + 1}:
                want.add(at[k])
        assert at[repair._choose(at, at + 1, rank)].tolist() == sorted(want)


def _plain_rounds(seq, ends, base):
    """(documents, rules) by rounds that count all pairs anew, with no table of slots."""
    parts, rules, floor = [seq[a:b].tolist() for a, b in zip([0, *ends], ends)], [], math.inf
    while True:
        count = Counter(p for d in parts for p in zip(d, d[1:]))
        if max(count.values(), default=0) < repair.MIN_COUNT:
            return parts, rules
        floor = max(repair.MIN_COUNT, repair.SHARE * min(floor, max(count.values())))
        rank = {p: k for k, p in enumerate(sorted((p for p in count if count[p] >= floor), key=lambda p: (-count[p], p)))}
        taken, uses = set(), Counter()
        for k, d, i in sorted((rank[p], d, i) for d, x in enumerate(parts) for i, p in enumerate(zip(x, x[1:])) if p in rank):
            if not {(d, i - 1), (d, i + 1)} & taken:
                taken.add((d, i))
                uses[k] += 1
        good = [p for p, k in rank.items() if uses[k] >= 3]
        if not good:
            if floor == repair.MIN_COUNT:
                return parts, rules
            continue
        name = {p: base + len(rules) + k for k, p in enumerate(good)}
        rules += good
        for d, x in enumerate(parts):
            out, i = [], 0
            while i < len(x):
                new = (d, i) in taken and name.get((x[i], x[i + 1]))
                out.append(new or x[i])
                i += 2 if new else 1
            parts[d] = out


def test_repair_rounds_are_the_plain_ones_and_no_pair_waits():
    """Also with thousands of pairs in a round, of which several shared a slot and waited for a later one."""
    rng = np.random.default_rng(3)
    passages = [rng.permutation(3000) + 3000 * k for k in range(2)]
    many = np.concatenate([passages[k % 2][: 3000 - k] for k in range(20)])
    for seq, ends in ((many, np.array([5000, 5000, len(many)])), (rng.integers(0, 40, 6000), np.array([100, 6000])), (rng.integers(0, 2, 3000), np.array([3000]))):
        s, e, rules, _ = repair.compress(seq, ends, 10_000)
        parts, want = _plain_rounds(seq, ends, 10_000)
        assert [s[a:b].tolist() for a, b in zip([0, *e], e)] == parts and [tuple(r) for r in rules.tolist()] == want


def test_sentencepiece_best_segmentation(spark):
    pieces = sptok.Pieces.load()
    score = {}
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sptok.MODEL)
    for i in range(m.get_piece_size()):
        if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)):
            score[m.id_to_piece(i)] = m.get_score(i)
    for text in ("▁hello", "▁internationalisation", "▁thntblere", "▁queeuxé"):
        best = [0.0] + [-math.inf] * len(text)
        for e in range(1, len(text) + 1):
            for b in range(e):
                if text[b:e] in score:
                    best[e] = max(best[e], best[b] + score[text[b:e]])
        ids = pieces.viterbi(text)
        assert math.isclose(sum(m.get_score(i) for i in ids), best[-1], rel_tol=1e-6)
    texts = ["", " two  blanks ", "a▁b", "naïve\ttab\nline", "漢字 ♥ \U0001f600", None]
    d = docs(spark, [(i, t) for i, t in enumerate(texts)])
    enc = sptok.encode(d)
    assert {r.doc_id: r.text for r in sptok.decode(enc).collect()} == dict(enumerate(texts))


def test_pipeline_against_brute_force(spark, tmp_path):
    rng, rows, labels = random.Random(9), [], []
    for i in range(120):
        w = words(60, i, 3000)
        if i % 6 == 0:
            w[10:10] = ["nastyword", "vileword", "nastyword"]
        labels.append((i, 0, int(i % 6 == 0)))
        rows.append((i, "menu of the site\n" + " ".join(w)))
    bench = [(k, " ".join(words(30, 500 + k, 3000))) for k in range(3)]
    rows += [(200 + i, rows[i][1]) for i in range(1, 6)] + [(300 + k, bench[k][1] + " tail") for k in range(3)] + [(400, None), (401, "menu of the site")]
    d = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {i: t.replace("menu of the site\n", "") for i, t in rows if i < 120 and i % 6}
    emptied = {400: (None, None), 401: (0, [])}
    assert set(got) == set(want) | set(emptied) and {i: (got[i].n_tokens, got[i].token_ids) for i in emptied} == emptied
    codec = sptok.Codec(sptok.Pieces.load())
    assert all(got[i].token_ids == codec.encode([t])[0].tolist() for i, t in want.items())
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "SimHash near-dedup" and rng
    stage = d
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
