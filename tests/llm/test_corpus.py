"""The corpus operators against brute force on small fixtures, with the odd cases that each docstring defines."""

import collections
import math
import random
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    licenses,
    line_dedup,
    minhash,
    pii,
    pitman_yor,
    quality_rules,
    sentencepiece,
    substring_dedup,
    toxicity,
)
from tidemark.llm.common import components, cut, join_by_name

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}{c}" for a in "bdkmst" for b in "aeiou" for c in ("n", "r", "la", "mo", "x")]


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage, line = words(rng, 60), words(rng, 14)
    base = words(rng, 120)
    out = [None, "", " \n\t", "one", "one", "a b c d", base, base, "x" * 3000, "z " * 400, words(rng, 4000)]
    for _ in range(20):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY) + "q"
        out.append(" ".join(w))
    for _ in range(30):
        t = words(rng, rng.randint(1, 150))
        if rng.random() < 0.4:
            t += "\n" + line
        if rng.random() < 0.3:
            t += " " + passage + " " + words(rng, 9)
        out.append(t + "\n" + words(rng, rng.randint(1, 30)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6]]  # a repeated row
    clash = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return clash.withColumns({"g": F.lit(1), "bucket": F.lit("x"), "_t": F.lit(None).cast("string"), "text2": F.col("text")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_pii_matches_the_base_definition(spark):
    cases = [
        None, "", "mail a.b@c.de and a@b@c.d", "10.0.0.255 1.2.3.400 1.2.3.4.5.6.7.8 000.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (555) 010-9999, +12, +1234567890123456", "9" * 3000, "x" * 2000 + "@a.b", "1 " * 5000, "😀 é@q.r z@z.zz",
    ]
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def brute(t):
        out = []
        for k, p in patterns.items():
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m.group())
                ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[k]()
                if ok:
                    out.append(f"{k}:{m.start()}:{m.end()}")
        return ",".join(out)

    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in pii.pii_spans(df).select("doc_id", pii._joined("base").alias("b")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(cases)}
    assert pii.redact(df, mark="#").where("doc_id = 9").first().text == "😀 é@q.r #"
    assert pii.pii_spans(empty(spark)).count() == 0


def test_pii_added_spans_by_kind(spark):
    """Spans that only the trees add: recall and precision by kind against what was planted, and no overlap with base spans."""
    rng = random.Random(61)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: rng.choice(VOCABULARY) + rng.choice(VOCABULARY)
    # (good, bad) of a kind: the bad ones look alike but aren't personal data
    makers = {
        "email_masked": (lambda: f"contact {name()} [at] {name()} [dot] com", lambda: f"meet {name()} (at) {name()}.{name()[:9]}"),
        "phone_local": (lambda: f"call ({rng.randint(2, 9)}{digits(2)}) {rng.randint(2, 9)}{digits(2)}-{digits(4)}", lambda: f"part 0{digits(2)}.1{digits(2)}.{digits(4)}"),
        "ssn": (lambda: f"ssn {rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", lambda: f"lot 9{digits(2)}-{digits(2)}-{digits(4)}"),
        "secret": (lambda: f"api_key={name()}{digits(8)}{name().upper()}", lambda: f"token: {name()}"),
    }
    rows, good = [], {}
    for i in range(1600):
        kind = list(makers)[i % 4]
        real = rng.random() < 0.5
        good[i] = kind if real else None
        rows.append((i, f"{words(rng, 6)} {makers[kind][0 if real else 1]()} {words(rng, 6)}"))
    rows += [(5000, None), (5001, ""), (1, rows[1][1])]
    df = spark.createDataFrame([(*x, "k", 0.5) for x in rows], "doc_id long, text string, found string, score double")
    got: dict = {}
    for r in pii.pii_spans(df).collect():
        got[r.doc_id] = {pii.KINDS[s.k] for s in r.spans} - set(pii.BASE)
        for s in r.spans:
            assert s.k < 4 or all(s.start >= b.end or b.start >= s.end for b in r.base)
    for kind in makers:
        planted, said = {i for i, k in good.items() if k == kind}, {i for i in good if kind in got[i]}
        assert len(planted & said) >= 0.9 * len(planted), (kind, "recall", len(planted & said) / len(planted))
        assert len(planted & said) >= 0.9 * len(said), (kind, "precision", len(planted & said) / len(said))
    assert got[5000] == got[5001] == set()


def test_licences(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    wrapped = "Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except\n# in compliance with the License.\nYou may"
    rows = [
        (0, "x\nLicensed under the Apache License, Version 2.0.\ny"), (1, "licensed under apache"), (2, None), (3, ""), (4, "pre " + wrapped), (5, "Copyright 2020\n\n" + mit.replace(" ", "\n", 40) + "\nmore"),
        (6, mit.replace("Software", "Program", 2)), (7, "w " * 20_000 + "Released under the MIT License. " + "w " * 50), (0, "licensed"), (8, "the software license " * 500), (9, "Released under the MIT License. " * 300),
    ]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "doc_id long, text string, license string, dice int")
    got = [(r.doc_id, [m.license for m in r.matches]) for r in licenses.license_matches(df).collect()]
    mit_both = ["MIT-text", "MIT-grant"]
    assert got == [(0, ["Apache-2.0"]), (1, []), (2, []), (3, []), (4, ["Apache-2.0", "Apache-2.0-header"]), (5, mit_both), (6, mit_both), (7, ["MIT"]), (0, []), (8, []), (9, ["MIT"])]
    assert licenses.license_matches(df.where("doc_id = 7")).first().matches[0].start_word == 20_000
    assert licenses.license_matches(df.limit(0)).count() == 0


def test_every_window_over_the_threshold_holds_an_anchor():
    # without its anchors a template keeps too few bigrams, whatever else a window holds
    for text in licenses.TEMPLATES.values():
        grams, out = licenses._bigrams(text), {w for w, _ in licenses.anchors(text)}
        left = [g for g in grams if not out & set(g.split())]
        assert 2 * len(left) / (len(left) + len(grams)) < licenses.THRESHOLD


def test_language_model(spark, docs, texts):
    rows = {}
    for r in pitman_yor.language_model_scores(docs).collect():
        rows.setdefault(r.doc_id, r)
    train = [t for i, t in [*enumerate(texts), (6, texts[6])] if zlib.crc32(str(i).encode()) % 7 != 2]
    seen = [w for t in train for w in [*split(lower(t)), None]]
    count = collections.Counter(seen)
    assert len(rows) == len(texts) and rows[0].train_tokens == len(seen)
    for i, t in enumerate(texts):
        own = [*split(lower(t)), None]
        assert (rows[i].n_tokens, rows[i].n_known) == (len(own), sum(w in count for w in own))
        base = sum(math.log10((count.get(w, 0) + 1) / (len(seen) + len(count) + 1)) for w in own)
        assert abs(rows[i].base_score - base) < 1e-9 * len(own)
        assert rows[i].score < 0
    assert pitman_yor.language_model_scores(empty(spark)).count() == 0


def test_predictive_probabilities_add_up():
    import numpy as np

    rng = np.random.default_rng(1)
    words_, rooms, discount = 200, 8, 0.6
    counts = rng.integers(0, 30, (words_, rooms)).astype(np.int64)
    parent = np.full(words_, 1 / (words_ + 1))
    seats = pitman_yor.Seats(counts.ravel(), np.tile(np.arange(rooms), words_), rooms)
    for _ in range(3):
        seats.sweep(np.repeat(parent, rooms), discount, pitman_yor.STRENGTH, rng)
    tables = seats.tables().reshape(counts.shape)
    assert (tables <= counts).all() and ((tables > 0) == (counts > 0)).all() and np.allclose(seats.all, tables.sum(axis=0))
    guests = tables.sum(axis=1)
    root = pitman_yor.Seats(guests, np.zeros(words_, np.int64), 1)
    root.sweep(parent, 0.5, pitman_yor.STRENGTH_ROOT, rng)
    less = guests - 0.5 * root.tables()
    p = pitman_yor.root_probability(np.append(less, 0.0), root.tables().sum(), guests.sum(), words_, 0.5)
    assert abs(p.sum() - 1) < 1e-9
    whole = pitman_yor.probability(np.vstack([counts, np.zeros(rooms)]), np.vstack([tables, np.zeros(rooms)]), counts.sum(axis=0), tables.sum(axis=0), p[:, None], discount)
    assert np.allclose(whole.sum(axis=0), 1)


def test_substring_dedup(spark, docs, texts):
    first, want = {}, {}
    for i, t in enumerate(texts):
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first.setdefault(tuple(w[p : p + 20]), (i, p)) != (i, p):
                gone[p : p + 20] = [True] * 20
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    rows = substring_dedup.substring_dedup(docs).collect()
    assert len(rows) == len(texts) + 1
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == want
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_minhash(spark, docs, texts):
    sets = []
    for t in texts:
        w = split(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (len(s), group[i], group[i] == i) for i, s in enumerate(sets)}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_of_shared_ids(spark):
    rng = random.Random(41)
    a, b = words(rng, 80), words(rng, 80)
    rows = [(1, a), (1, b), (1, a), (2, a + " x"), (3, b + " y"), (4, words(rng, 80)), (None, a), (5, None), (6, "")]
    rows += [(7, "Tail " + a)] * 3
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True), *[(7, 1, False)] * 3]


def test_scratch_tables_can_be_removed(spark):
    import os

    from tidemark.llm import common

    common.clean(spark)
    cut = common.cut(spark.range(3), "x")
    assert cut.count() == 3 and len(common._WRITTEN) == 1
    path = common._WRITTEN[0]
    assert os.path.isdir(path) and common.clean(spark) == 1 and not os.path.exists(path)


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_quality_rules(spark, docs, texts):
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        w = split(t)
        grams = {}
        for p in range(len(w) - 2):
            grams.setdefault(tuple(w[p : p + 3]), []).append(p)
        again = {q for at in grams.values() if len(at) > 1 for p in at for q in (p, p + 1, p + 2)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or "")) and r.kept in ((False,) if r.base_failed else (True, False))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and r.kept == (not r.base_failed and not r.failed_rules)
    assert quality_rules.quality_rules(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "# a b", 1), (1, None, 2), (1, "x " * 20_000, 3)], "doc_id long, text string, n_words int")
    got = {(r.doc_id, r.n_words): (r.n_symbols, r.n_repeat_words, r.kept) for r in quality_rules.quality_rules(odd).collect()}
    assert got == {(None, 3): (1, 0, False), (1, 0): (0, 0, False), (1, 20_000): (0, 20_000, False)}


def test_sentencepiece_round_trip(spark, docs, texts):
    rows = sentencepiece.encode(docs).collect()
    assert all(r.restored for r in rows if r.ids is not None) and sum(r.ids is None for r in rows) == 1
    back = {r.doc_id: r.text for r in sentencepiece.decode(sentencepiece.encode(docs)).collect()}
    assert back == dict(enumerate(texts))
    assert sentencepiece.encode(empty(spark)).count() == 0
    odd = spark.createDataFrame([(1, [3 + 0xFF]), (2, [10**6, -1, None, 0]), (3, []), (4, None), (5, [1, 2])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sentencepiece.decode(odd).collect()} == {1: "\ufffd", 2: "\ufffd" * 4, 3: "", 4: None, 5: ""}


def test_sentencepiece_ids_are_those_of_the_library(texts, tiny):
    import pyarrow.parquet as pq
    import sentencepiece as library

    theirs = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    coder = sentencepiece.Coder(sentencepiece.load_vocabulary())
    own = pq.read_table(f"{tiny}/documents.parquet")["text"].to_pylist()
    # stretches without a space that are much longer than the window
    long = ["a" * 500, "aaaab" * 100, "thequickbrownfoxjumpsoverthelazydog" * 40, "日本語テキスト😀" * 30, "x\ty\n\n z" * 50, "ab" * 3000]
    for t in [*own, *texts, *long, "  two  spaces ", "naïve 😀\n\n x"]:
        if t is not None:
            assert coder.encode(t) == list(theirs.encode(t)), t[:50]
            assert coder.decode(coder.encode(t)) == t
    assert coder.decode(coder.encode("▁ a▁b")) == "▁ a▁b"


def test_streaming_viterbi_equals_a_full_table():
    rng = random.Random(8)
    alphabet = "abcd"
    pieces = {c: 4.0 for c in alphabet} | {"".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))): rng.uniform(2, 9) for _ in range(120)}
    vocabulary = {"pieces": {p: (i, -c) for i, (p, c) in enumerate(pieces.items())}, "bytes": {b: 1000 + b for b in range(256)}, "merges": False}
    search = sentencepiece.Viterbi(vocabulary)
    cost = {i: c for i, c in enumerate(pieces.values())}
    for n in [*range(1, 40), 500, 3000]:
        text = "".join(rng.choice(alphabet + "é" * (n % 3 == 0)) for _ in range(n))
        best = [0.0] + [math.inf] * n
        for e in range(1, n + 1):
            for s in range(max(0, e - 6), e):
                best[e] = min(best[e], best[s] + pieces.get(text[s:e], math.inf))
            if best[e] == math.inf:
                best[e] = best[e - 1] + search.fallback
        ids = []
        for start in range(0, n, 7):
            ids += search.feed(text[start : start + 7])
            assert len(search.text) < 4 * search.longest + 7  # the window doesn't grow with the text
        ids += search.close()
        unknown = sum(i >= 1000 for i in ids) // 2
        assert abs(sum(cost.get(i, 0) for i in ids) + unknown * search.fallback - best[n]) < 1e-6


def test_line_dedup(spark, docs, texts):
    seen, want = {}, {}
    lines = [(i, [x for x in (t or "").split("\n") if split(x)]) for i, t in enumerate(texts)]
    for n, (i, own) in enumerate(lines):
        gone = set()
        for p in range(len(own)):
            best = 0
            for m, q in seen.get(own[p], []):
                other, k = lines[m][1], 0
                while p + k < len(own) and q + k < len(other) and own[p + k] == other[q + k]:
                    k += 1
                best = max(best, k)
            if sum(len(split(x)) for x in own[p : p + best]) >= line_dedup.MIN_WORDS:
                gone |= set(range(p, p + best))
            seen.setdefault(own[p], []).append((n, p))
        want[i] = [x for k, x in enumerate(own) if k not in gone]
    got = {r.doc_id: [x for x in (r.text or "").split("\n") if split(x)] for r in line_dedup.line_dedup(docs).collect()}
    assert got == want
    assert line_dedup.line_dedup(docs).columns == docs.columns
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    item = words(rng, 30).split()
    edited = [*item[:5], "extra", *item[5:12], *item[13:20], "other", *item[21:]]
    far = [w if i % 3 else "zz" for i, w in enumerate(item)]
    wrap = lambda w: words(rng, 40) + " " + " ".join(w) + " " + words(rng, 40)
    rows = [(0, wrap(item)), (1, wrap(edited).upper()), (2, wrap(far)), (3, words(rng, 300)), (4, None), (5, ""), (6, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.distance) for r in decontaminate.benchmark_hits(docs, bench).collect()}
    assert {k: v for k, v in got.items() if k[1] == 7} == {(0, 7): (40, 0), (1, 7): (40, 3), (6, 7): (0, 0)}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3, 4, 5}
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    bad = ["zorgluk", "krampfo", "blixxen"]
    rows, labels = [], []
    for i in range(600):
        w, toxic = words(rng, 40).split(), i % 4 == 0
        if toxic:
            x = rng.choice(bad)
            w[rng.randrange(40)] = rng.choice([x, "".join(c + "." for c in x), x[:3] + "e" + x[3:], x.upper() + "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.trained_score(docs, marks).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[1000] == got[1001] < 0.5
    assert {r.score for r in toxicity.trained_score(docs, marks.limit(0)).collect()} == {0.0}


def test_pipeline_keeps_clean_rows(spark, tiny):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash", "decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, tiny).select("doc_id", "restored").collect()
    whole = spark.read.parquet(f"{tiny}/documents.parquet").count()
    assert 0.6 * whole < len(out) <= whole and all(r.restored for r in out)


def test_pipeline_stages_on_odd_rows(spark, tiny):
    import corpus_pipeline

    rng = random.Random(51)
    item = spark.read.parquet(f"{tiny}/benchmark.parquet").first().text
    line, long = words(rng, 12), " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))
    text = words(rng, 150)
    near = text.split()
    near[70] = "changed"
    rows = [(1, None), (2, ""), (3, text), (4, " ".join(near)), (5, text), (3, text), (6, line + "\n" + words(rng, 30)), (7, words(rng, 30) + "\n" + line),
            (8, words(rng, 20) + " " + item + " " + words(rng, 20)), (None, words(rng, 40)), (None, None), (9, long), (10, long + " end"), (11, words(rng, 60)), (11, words(rng, 60))]
    rows = [(i, t, "en", "src", None if t is None else len(t), "g", t, 0.5) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _h string, keys string, label double")
    key = lambda df: sorted(((r.doc_id or 0), r.text or "") for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    every = key(docs)
    for name in ("toxicity", "line_dedup", "minhash", "decontamination"):
        out = stages[name](spark, docs, tiny)
        assert out.columns == docs.columns and stages[name](spark, docs.limit(0), tiny).count() == 0
        got = key(out)
        if name == "toxicity":
            assert got == every
        if name == "line_dedup":
            texts = {i: t for i, t in got}
            assert len(got) == len(every) and line not in texts[7] and line in texts[6] and texts[9] == long and texts[5] == "" and texts[4] != ""
        if name == "minhash":  # a near copy of 0.93 and exact ones go, rows of one id stay together
            assert [i for i, _ in got] == [0, 0, 1, 2, 3, 3, 6, 7, 8, 9, 11, 11]
        if name == "decontamination":
            assert [i for i, _ in got] == sorted(i or 0 for i, *_ in rows if i != 8)
    out = stages["sentencepiece"](spark, docs, tiny)
    assert out.count() == len(rows) and out.where("restored = false").count() == 0 and out.where("ids IS NULL").count() == 2


def test_language_model_learns_each_pair(spark):
    rng = random.Random(3)
    after = dict(zip(VOCABULARY, rng.sample(VOCABULARY, len(VOCABULARY))))  # every word has one follower

    def chain(n):
        out = [rng.choice(VOCABULARY)]
        while len(out) < n:
            out.append(after[out[-1]])
        return out

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, chain(60)) for i in range(400)]
    same = [(i, " ".join(w)) for i, w in rows]
    mixed = [(i, " ".join(rng.sample(w, len(w)) if i in held else w)) for i, w in rows]
    scores = []
    for texts in (same, mixed):
        df = pitman_yor.language_model_scores(spark.createDataFrame(texts, "doc_id long, text string"))
        scores.append([r.score / r.n_tokens for r in df.collect() if r.doc_id in held])
    # the order tells the next word: far likelier than one of 150 words, and mixed texts are not
    assert min(scores[0]) > -0.35 and max(scores[1]) < -1.5


def test_gibbs_seats_like_a_plain_sampler():
    import numpy as np

    def plain(turns, c, discount, strength, p, rng):
        tables, seat, out = [c], [0] * c, []
        for _ in range(turns):
            for i in range(c):
                tables[seat[i]] -= 1
                used = sum(x > 0 for x in tables)
                weight = [max(x - discount, 0) for x in tables] + [(strength + discount * used) * p]
                to = rng.choices(range(len(weight)), weight)[0]
                if to == len(tables):
                    tables.append(0)
                tables[to] += 1
                seat[i] = to
            out.append(sum(x > 0 for x in tables))
        return out

    discount, strength, p, c = 0.4, 1.0, 0.3, 12
    # the exact distribution of the tables of one dish: weights are the generalised Stirling numbers
    stirling = {1: 1.0}
    for i in range(1, c):
        stirling = {t: stirling.get(t - 1, 0) + (i - discount * t) * stirling.get(t, 0) for t in range(1, i + 2)}
    weight = {t: x * np.prod([(strength + discount * k) * p for k in range(t)]) for t, x in stirling.items()}
    want = np.array([weight.get(t, 0) for t in range(c + 1)]) / sum(weight.values())
    rough = np.bincount(plain(20_000, c, discount, strength, p, random.Random(1)), minlength=c + 1) / 20_000
    assert abs(rough - want).max() < 0.02
    dishes = 4000
    for moves in (24, 5):  # a whole dish in a sweep, and a part of its customers
        old, pitman_yor.MOVES = pitman_yor.MOVES, moves
        seats, rng, got = pitman_yor.Seats(np.full(dishes, c), np.arange(dishes), dishes), np.random.default_rng(4), []
        for turn in range(60):
            seats.sweep(np.full(dishes, p), discount, strength, rng)
            assert (np.add.reduceat(seats.size, seats.start) == c).all()
            if turn >= 30:
                got.append(np.bincount(seats.tables(), minlength=c + 1) / dishes)
        pitman_yor.MOVES = old
        assert abs(np.mean(got, axis=0) - want).max() < 0.01


def test_a_sweep_moves_every_customer_of_large_dishes(monkeypatch):
    import numpy as np

    rng, c = np.random.default_rng(2), 3000
    seats = pitman_yor.Seats(np.array([c, 5]), np.arange(2), 2)
    seats.sweep(np.ones(2), 0.4, 1e9, rng)
    assert seats.tables().tolist() == [c, 5]
    seats.sweep(np.full(2, 1e-12), 0.4, 1e-12, rng)  # nobody opens a table: those that all left are gone
    assert seats.tables()[0] < 0.8 * c
    # the exact mean of the tables of dishes that move three of three hundred customers in a step
    discount, strength, p, c = 0.4, 30.0, 0.5, 300
    log = np.full(c + 1, -np.inf)
    log[1] = 0
    for i in range(1, c):
        stay = np.log(np.maximum(i - discount * np.arange(c + 1), 1e-300)) + log
        log = np.logaddexp(np.append(-np.inf, log[:-1]), np.where(np.arange(c + 1) <= i, stay, -np.inf))
    log[1:] += np.cumsum(np.log((strength + discount * np.arange(c)) * p))
    want = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
    monkeypatch.setattr(pitman_yor, "STEPS", 100)
    dishes, got = 300, []
    seats = pitman_yor.Seats(np.full(dishes, c), np.arange(dishes), dishes)
    for turn in range(60):
        seats.sweep(np.full(dishes, p), discount, strength, rng)
        used = [np.bincount(seats.label[a : a + c], minlength=c) for a in seats.start[:5]]
        assert all((x == seats.size[a : a + c]).all() and (x > 0).sum() == t for x, a, t in zip(used, seats.start, seats.t))
        got += seats.tables().tolist() if turn >= 20 else []
    mean = (want * np.arange(c + 1)).sum()
    assert abs(np.mean(got) / mean - 1) < 0.03 and np.allclose(seats.all, seats.tables())


def test_language_model_deals_common_pairs_over_parts(spark, docs, monkeypatch):
    whole = {(r.doc_id, r.n_tokens): r for r in pitman_yor.language_model_scores(docs).collect()}
    monkeypatch.setattr(pitman_yor, "PART_CHARS", 4000)
    monkeypatch.setattr(pitman_yor, "SLICE_CHARS", 9000)
    for r in pitman_yor.language_model_scores(docs).collect():
        other = whole[(r.doc_id, r.n_tokens)]
        assert (r.n_known, r.train_tokens) == (other.n_known, other.train_tokens) and abs(r.base_score - other.base_score) < 1e-6
        assert abs(r.score - other.score) < 0.1 * abs(other.score) + 0.15 * r.n_tokens  # other samples, the same model


def test_line_dedup_removes_short_lines(spark):
    line = "one two three four five six seven eight nine"
    rows = [(1, f"a b\n{line}\nc d"), (2, f"e f\n{line}\ng h"), (3, f"{line}\n\nok\nok\ni j")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    assert got == {1: rows[0][1], 2: "e f\ng h", 3: "\nok\ni j"}
    kept = {r.doc_id: r.text for r in line_dedup.line_dedup(df, min_words=10).collect()}
    assert kept == dict(rows)
    # longer floors still join lines to runs
    runs = spark.createDataFrame([(1, "a b c\nd e f\nx"), (2, "y\na b c\nd e f"), (3, "a b c\nz")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(runs, min_words=6).collect()} == {1: "a b c\nd e f\nx", 2: "y", 3: "a b c\nz"}


def test_line_runs_are_found_by_doubling_to_their_end(spark, tmp_path, monkeypatch):
    run = [f"line {i}" for i in range(40)]
    rows = [(1, ["a", *run, "b"]), (2, ["c", *run, "d"]), (3, [*run[5:9], "e", *run[30:], *run[:3]]), (4, ["f", "g"]), (5, ["h"] * 6)]
    spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cuts = []
    monkeypatch.setattr(line_dedup, "cut", lambda df, name: cuts.append(name) or cut(df, name))
    got = {r.doc_id: (r.n_lines_with_words_left, r.n_runs, r.longest_run) for r in line_dedup.op8_line_dedup(spark, str(tmp_path)).collect()}
    # in the fifth text the copies of four lines from line 2 and from line 3 on both come from the first line
    assert got == {1: (42, 0, 0), 2: (2, 1, 40), 3: (1, 3, 10), 4: (2, 0, 0), 5: (1, 2, 4)}
    assert [c for c in cuts if c.startswith("prefixes")] == [f"prefixes{2**r}" for r in range(1, 7)]  # the sixth finds no run of 64


def test_decontamination_of_long_and_five_word_items(spark):
    rng = random.Random(12)
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in (5, 200, 300)}
    rows, want = [], set()
    for n, item in items.items():
        for turn in range(60 if n > 5 else 3):
            w = list(item)
            # places of the allowed edits: the third word of five, or anywhere
            for at in [2] if n == 5 else sorted(rng.sample(range(n), n // 5), reverse=True):
                w[at : at + 1] = [["zz"], [], ["zz", w[at]]][turn % 3 if n == 5 else rng.randrange(3)]
            want.add((len(rows), n))
            rows.append((len(rows), words(rng, 20) + " " + " ".join(w) + " " + words(rng, 20)))
    rows.append((len(rows), " ".join(["w5x0", "a", "b", "w5x3", "w5x4"])))  # two edits
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    hits = decontaminate.benchmark_hits(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == want


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash_loses_no_link_between_small_sets(spark, percent):
    rng = random.Random(percent)
    rows = []
    for i in range(20_000):
        # sets of 6 to 60 shingles whose similarity is the least that counts: the longer text has extra words at its end
        n = rng.randint(6, 60)
        common = -(-percent * n // 100)
        if rng.random() < 0.4:  # exactly the threshold
            n = 20 * rng.randint(1, 3)
            common = n * percent // 100
        w = [f"{i}w{k}" for k in range(n + 4)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: common + 4]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = minhash.near_duplicates(df, percent=percent)
    assert got.where("doc_id % 2 = 1 AND component_id <> doc_id - 1").count() == 0
    assert got.where("doc_id % 2 = 0 AND component_id <> doc_id").count() == 0


def test_string_kernel_has_no_negative_eigenvalue(texts):
    import numpy as np

    rng = random.Random(6)
    kernel = toxicity.Kernel(["zorgluk", "krampfo", "blixxen", "😀😀ab😀"])
    long = "".join(rng.choice("zorglukab") for _ in range(300))
    for w in ["zorgluk", "zxoxrxgxlxuxk", "zoorrgglluukk", "krampfozorgluk", "😀😀ab😀", "", "abc", long]:
        plain = toxicity.subsequences(w)
        for m, landmark in enumerate(["zorgluk", "krampfo", "blixxen", "😀😀ab😀"]):
            own = toxicity.subsequences(landmark)
            want = sum(v * plain.get(f, 0.0) for f, v in own.items()) ** 2 / sum(v * v for v in own.values())
            assert abs(kernel.of([w])[0, m] - want) < 1e-9
    # any words, and any sentences of them: each against all
    some = [w for w in {"".join(rng.choice("abcde") for _ in range(rng.randint(4, 12))) for _ in range(60)} if toxicity.subsequences(w)]
    own = [toxicity.subsequences(w) for w in some]
    matrix = toxicity.Kernel(some).of(some)
    matrix = matrix / np.array([sum(v * v for v in x.values()) for x in own])[:, None]
    assert np.allclose(matrix, matrix.T) and np.linalg.eigvalsh(matrix).min() > -1e-9
    sentences = np.array([[rng.random() < 0.2 for _ in some] for _ in range(40)], float)
    assert np.linalg.eigvalsh(sentences @ matrix @ sentences.T).min() > -1e-9


def test_toxicity_of_insults_with_letters_put_in(spark):
    rng = random.Random(7)
    bad, rows, labels, kinds = ["zorgluk", "krampfo", "blixxen"], [], [], {}
    for i in range(1200):
        w, toxic = words(rng, 60).split(), i % 3 == 0
        w = [x + "." if k % 9 == 8 else x for k, x in enumerate(w)]
        if toxic:
            gap = rng.randint(0, 3)
            kinds[i] = gap
            w[rng.randrange(60)] = "".join(c + "".join(rng.choice("aeiou") for _ in range(gap)) for c in rng.choice(bad))
        rows.append((i, " ".join(w), 5, None))
        labels.append((i, int(toxic)))
    rows += [(2000, None, 1, 1.0), (2001, "", 1, 1.0), (2002, "z o r g l u k", 1, 1.0), (2003, "Z-O-R-G-L-U-K!!", 1, 1.0), (2004, "zorgluk " * 3000, 1, 1.0), (5, rows[5][1], 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, label double")
    marks = spark.createDataFrame(labels + [(0, 0), (1, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.trained_score(docs, marks).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    for gap in range(4):
        own = [i for i in held if kinds.get(i) == gap]
        assert sum(got[i] >= 0.5 for i in own) >= 0.9 * len(own) > 0, gap
    clean = [i for i in held if i % 3]
    assert sum(got[i] < 0.5 for i in clean) >= 0.97 * len(clean)
    assert got[2000] == got[2001] < 0.5 <= min(got[2002], got[2003], got[2004])
    assert toxicity.trained_score(docs.limit(0), marks).count() == 0


def test_decontamination_recall_by_item_length(spark):
    """Items of 3 to 200 words at the allowed number of edits, against the exact distance; and nothing beyond it."""
    rng = random.Random(21)
    lengths = [1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 17, 23, 30, 41, 59, 100, 200]
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in lengths}

    def edited(item, edits, spread):
        w = list(item)
        for at in sorted(rng.sample(range(max(edits, int(len(item) * spread))), edits), reverse=True):
            w[at : at + 1] = [["zz"], [], ["zz", w[at]]][rng.randrange(3)]
        return w

    rows, near, far = [], {}, {}
    for n, item in items.items():
        for turn in range(30):
            near[len(rows)] = n
            w = edited(item, n // 5, 1.0 if turn % 3 else 0.4)
            rows.append((len(rows), words(rng, 12) + " " + " ".join(w).upper() + ", " + words(rng, 12)))
        for turn in range(5):  # every third word is another: over the limit by the exact distance
            w = ["yy" if k % 3 == turn % 3 else x for k, x in enumerate(item)]
            if sum(x == "yy" for x in w) > n // 5:
                far[len(rows)] = n
                rows.append((len(rows), " ".join(w)))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    hits = {(r.doc_id, r.item_id): r for r in decontaminate.benchmark_hits(docs, bench).collect()}
    for n in lengths:
        own = [i for i in near if near[i] == n]
        assert sum((i, n) in hits for i in own) >= 0.95 * len(own), n
    assert not [i for i in far if (i, far[i]) in hits]
    plain = decontaminate._WORDS
    for (i, n), r in hits.items():
        found = plain.findall(rows[i][1].lower())[r.start_word : r.start_word + r.n_words]
        before = list(range(len(found) + 1))
        for a, x in enumerate(items[n], 1):
            now = [a]
            for b, y in enumerate(found, 1):
                now.append(min(now[-1] + 1, before[b] + 1, before[b - 1] + (x != y)))
            before = now
        assert before[-1] == r.distance <= n // 5


def test_decontamination_of_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, item, "x", 0), (1, "clean text of one id", "x", 0), (2, item, "x", 0), (2, item, "x", 0), (None, item, "x", 0), (None, "clean", "x", 0), (3, None, "x", 0), (4, "", "x", 0), (5, item + " w" * 20_000 + " " + item, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string, item_id int")
    bench = spark.createDataFrame([(7, item), (7, "another text"), (8, None), (None, item), (9, "")], "item_id long, text string")
    hits = decontaminate.benchmark_hits(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.start_word) for r in hits) == [(0, 7, 0), (1, 7, 0), (2, 7, 0), (5, 7, 0)]
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "clean"), (1, "clean text of one id"), (3, ""), (4, "")]
    assert decontaminate.benchmark_hits(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_substring_dedup_of_shared_ids_and_a_common_phrase(spark):
    rng = random.Random(31)
    p, q = words(rng, 40), words(rng, 40)
    rows = [(1, p), (2, p), (2, q), (None, p), (3, q + " " + p)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 40, 0), (1, 40, 0), (2, 40, 0), (2, 40, 40), (3, 80, 80)]
    # a phrase of twelve words in every text, without a common window
    phrase = words(rng, 12)
    df = spark.createDataFrame([(i, f"{words(rng, 9)} x{i} {phrase} y{i} {words(rng, 9)}") for i in range(300)], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.substring_dedup(df).collect()} == {0}


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("often", [0, 3000])
def test_a_join_by_name_passes_each_row_once(spark, how, often):
    rows = spark.range(6000).select("id", F.when(F.col("id") < often, 7).when(F.col("id") % 10 > 0, F.col("id") % 2500).alias("k"))
    names = rows.groupBy("k").count().where("count > 1 AND k % 3 > 0").withColumn("x", F.col("k") * 2)
    got = join_by_name(rows, names, ["k"], ["x"], how)
    want = rows.join(names.select("k", "x"), "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join ") == (2 if often else 1)


def test_substring_dedup_of_runs_alone_and_of_texts_taken_together(spark, monkeypatch):
    """Texts without any symbol but runs; and short texts on end keep to themselves, however many are taken together."""
    runs = spark.createDataFrame([(1, "a " * 30), (2, "a " * 25)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(runs).collect()}
    assert got == {1: (30, 29), 2: (25, 25)}  # the window at 2 starts at 1 too, and so on

    texts = ["a " * 30, "x", "x y " * 20, " ".join(map(str, range(25))), "a " * 20 + "b", " ".join(map(str, range(3, 24))), None, "b " * 21]
    part = pd.DataFrame({"text": texts})
    (together,) = substring_dedup._together(part)
    monkeypatch.setattr(substring_dedup, "TOGETHER", 1)
    alone = list(substring_dedup._together(part))
    assert len(alone) == 6 and list(together.place) == [x.place[0] for x in alone]
    for i, one in enumerate(alone):
        mine = together.owner == i
        assert list(together.run[mine & together.valid]) == list(one.run)
        assert sorted(together.name[together.text == i]) == sorted(one.name)
