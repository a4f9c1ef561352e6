"""Token files, source divergence and tokenizer alignment against brute force, SQL and the tokenizers' own results."""

import collections
import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, bpe_words, divergence, licenses, minhash, pii, token_files
from tidemark.llm.bpe_words import Library, byte_characters
from tidemark.llm.common import scratch

#: Scripts, controls, combining marks, marks of the vocabularies, kinds of white space.
ODD = [
    None, "", " ", "\n\n  \t", "one", "one", "One TWO  three", "a\n  b\r\nc d e\x1c\x85f", "don't WE'LL it's 1234 x²½ª", "ÀÉß İı Σας ŒŸ ĳ", "é ́x ﬁ Ａ１",
    "<|endoftext|> <|startoftext|>x</s><s>", "日本語のテキスト 한국어 עברית العربية", "😀👩‍👩‍👧 ​﻿", "▁ marked ▁▁x", "x" * 3000, "9" * 700 + "!" * 500, " z" * 4000, "tab\tand\x0bvt\x0cff", "\x00\x01 nul", "end  ",
]


def some_texts():
    rng = random.Random(3)
    words = ["the", "of", "und", "été", "naïve", "Größe,", "42", "end.", "(x)", "co-op", "https://a.b/c?d=e", "año", "\n", "\n\n"]
    return ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 101, t) for i, t in enumerate(some_texts())] + [(None, "no id"), (None, None), (7, "shared"), (7, "shared"), (7, "another")]
    plain = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return plain.withColumns({"h1": F.lit("x"), "weight": F.lit(2), "part": F.lit("y"), "n_docs": F.lit(None).cast("int")})


# ---- ids of words ----


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_stretches_are_the_library_s(name):
    source = open(f"/opt/tokenizers/{name}", encoding="utf-8").read()
    for special in (True, False):
        own, plain = Library(source, special), Tokenizer.from_str(source)
        plain.encode_special_tokens = not special
        assert own.pattern is not None
        for text in [t or "" for t in some_texts()] + [chr(c) + "a" for c in range(0x20, 0x260)] + ["b" + chr(c) for c in range(0x20, 0x260)]:
            assert np.frombuffer(own.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, (text, special)


# ---- op11 ----


def expected_files(rows, tokenizer="/opt/tokenizers/word_bpe_49k.json", end=2):
    plain = Tokenizer.from_file(tokenizer)
    return [(key, plain.encode(text or "", add_special_tokens=False).ids + [end]) for key, text in rows]


def test_token_files_hold_what_the_tokenizer_gives(spark, docs):
    folder = scratch(spark, "ids")
    manifest = token_files.write_ids(docs, folder, block=64)
    got = sorted(token_files.read_ids(manifest, folder, with_ids=True).collect(), key=lambda r: r.start)
    want = collections.Counter((k, tuple(ids)) for k, ids in expected_files([(r.doc_id, r.text) for r in docs.collect()]))
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda k: (k is not None, k))
    parts = manifest.orderBy("part").collect()
    assert [p.start for p in parts] == [sum(q.n_ids for q in parts[:i]) for i in range(len(parts))]
    assert sum(p.n_docs for p in parts) == docs.count()
    assert token_files.read_ids(token_files.write_ids(docs.limit(0), folder), folder).count() == 0


def test_bit_planes_of_a_query(spark, tiny):
    got = {r.doc_id: r for r in token_files.op11_token_files(spark, tiny).collect()}
    at = 0
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for key, ids in expected_files(rows):
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=50), max_size=12), st.sampled_from(["bit", "byte"]), st.sampled_from([8, 64]))
def test_files_give_back_any_range(docs_ids, kind, block):
    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    w = token_files.Writer(out, block, kind)
    for i, ids in enumerate(docs_ids):
        w.add(i if i % 3 else None, np.array(ids, np.uint32))
    flat = [x for ids in docs_ids for x in ids]
    assert w.close() == (len(docs_ids), len(flat))
    r = token_files.Reader(pa.PythonFile(io.BytesIO(out.getvalue()), mode="r"))
    assert [(k, at, [x for p in parts for x in p.tolist()]) for k, at, parts in r.documents()] == [
        (i if i % 3 else None, sum(map(len, docs_ids[:i])), ids) for i, ids in enumerate(docs_ids)
    ]
    for start in range(0, len(flat) + 1, 7):
        assert r.ids(start, start + 13).tolist() == flat[start : start + 13]


def test_a_range_reads_its_blocks_only_and_damage_is_seen(tmp_path):
    path = str(tmp_path / "x.ids")
    local = fs.LocalFileSystem()
    w = token_files.Writer(local.open_output_stream(path), 64)
    ids = np.arange(1000, dtype=np.uint32) * 7
    w.add(1, ids)
    w.close()
    r = token_files.Reader(local.open_input_file(path))
    read = []
    block = r.block
    r.block = lambda i: read.append(i) or block(i)
    assert r.ids(130, 200).tolist() == ids[130:200].tolist() and read == [2, 3]
    (tmp_path / "y.ids").write_bytes((tmp_path / "x.ids").read_bytes()[:-3])
    with pytest.raises(ValueError):
        token_files.Reader(local.open_input_file(str(tmp_path / "y.ids")))


# ---- op12 ----


def compared(df, want):
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def in_duckdb(rows):
    db = duckdb.connect()
    table = pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())))})
    db.register("documents", table)
    return db.execute(divergence.ORACLE_SQL).fetchall()


def test_divergence_matches_sql_on_odd_rows(spark):
    rng = random.Random(11)
    words = ["Alpha", "alpha", "beta", "Été", "ÉTÉ", "naïve", "x1y", "日本", "áb", "gamma-delta", "KK"]
    rows = []
    for i in range(120):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", None, "é", "z" * 50])
        rows.append((i % 90, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), lang, source))
    rows += [(None, None, "en", "quiet"), (3, "", "en", "silent"), (4, "once twice", "xx", "a"), (4, "other", "xx", "b"), (5, "lone lone lone", "yy", "only")] + [rows[0]] * 3
    rows += [(9, "hot " * 500, "en", "hot")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    clash = docs.withColumns({"g": F.lit(1), "term": F.lit("t"), "value": F.lit("v"), "n": F.lit(None).cast("long")})
    compared(divergence.source_divergence(clash), in_duckdb(rows))
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_divergence_query_matches_sql(spark, tiny):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    compared(divergence.op12_source_divergence(spark, tiny), db.execute(divergence.ORACLE_SQL).fetchall())


def test_shares_are_exact_for_large_counts():
    for c, d in ((0, 1), (9 * 10**14, 9 * 10**15 - 1), (123456789012345, 987654321098765), (5, 7)):
        assert int(divergence.share(np.int64(c), np.int64(d))) == 1 + 10**9 * (c + 1) // d


def test_accumulators_split_and_flush(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = rng.integers(0, 40, (300, 17)) * (rng.random((300, 17)) < 0.4)
    total, v = n.sum(axis=0), len(n)
    of, g = np.nonzero(n)
    p = 1 + 10**9 * (n + 1) // (total + v)
    want = np.array([[((p[:, x] - p[:, y]) ** 2 // p[:, y]).sum() for y in range(17)] for x in range(17)])
    for cells in (8, 1 << 20):
        monkeypatch.setattr(divergence, "CELLS", cells)
        peers = divergence.Peers(total, v)
        acc = {x: np.zeros(17, np.int64) for x in range(17)}
        peers.scatter(of, g, n[of, g], acc)
        got = np.array([acc[x] for x in range(17)]) + v * divergence.excess(peers.p0[:, None], peers.p0)
        for x in range(17):
            counts, times = np.unique(n[n[:, x] > 0, x], return_counts=True)
            rows, cols = peers.baselines(x, counts, times)
            got[x] += rows
            got[:, x] += cols
        off = ~np.eye(17, dtype=bool)
        assert (got[off] == want[off]).all()


# ---- op13 ----


def expected_alignment(rows):
    a, b = Tokenizer.from_file(alignment.A), sentencepiece.SentencePieceProcessor(model_file=alignment.B)
    a.encode_special_tokens = True
    of = {c: n for n, c in byte_characters().items()}
    bytes_a = {i: bytes(of[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in of for c in t)}
    found, holds = [], collections.Counter()
    for key, text in rows:
        found.append((key, None))
        if not text:
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        sides = []
        for ids, piece in ((ids_a, bytes_a.__getitem__), (ids_b, lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
            at, ends = b"", []
            for i in ids:
                at += piece(i)
                ends.append(len(at))
            sides.append((at, ends))
        if any(at != (" " + text).encode() for at, _ in sides):
            continue
        groups, x, y = [], 0, 0
        for end in sorted(set(sides[0][1]) & set(sides[1][1])):
            i, j = (side[1].index(end) + 1 for side in sides)
            groups.append((ids_a[x:i], ids_b[y:j]))
            x, y = i, j
        links = collections.Counter((p, q) for ga, gb in groups for p in ga for q in gb)
        holds.update(links.keys())
        told = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        found[-1] = (key, (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(told.encode()).hexdigest()))
    most = {}
    for (p, _), n in holds.items():
        most[p] = max(most.get(p, 0), n)
    return collections.Counter(
        (key, 0, 0, 0, 0, 0, 0, "")
        if f is None
        else (key, *f[:3], sum(f[3].values()), sum(k for (p, q), k in f[3].items() if holds[p, q] == most[p]), sum(k * holds[x] for x, k in f[3].items()), f[4])
        for key, f in found
    )


@pytest.mark.parametrize("small, links, together", [(1_000_000, 4096, 1 << 19), (0, 3, 50)])
def test_alignment_matches_brute_force(spark, docs, monkeypatch, small, links, together):
    monkeypatch.setattr(alignment, "SMALL", small)
    want = expected_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert collections.Counter(tuple(r) for r in alignment.align(docs).collect()) == want
    aligner = alignment.Aligner(open(alignment.A, encoding="utf-8").read(), open(alignment.B, "rb").read())
    plain = dict(aligner.align(some_texts()))
    monkeypatch.setattr(alignment, "LINKS", links)
    monkeypatch.setattr(alignment, "TOGETHER", together)
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    for i, got in aligner.align(some_texts()):
        assert all(np.array_equal(got[c], plain[i][c]) for c in got)


def test_alignment_of_no_rows_and_of_copies(spark, docs):
    assert alignment.align(docs.limit(0)).count() == 0
    rows = [(i, "the same text again") for i in range(50)] + [(100, "other words"), (101, "the same"), (102, "▁")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert alignment.aligned_texts(df.select("text")).count() == 3
    assert collections.Counter(tuple(r) for r in alignment.align(df).collect()) == expected_alignment(rows)


def test_alignment_query(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    assert collections.Counter(tuple(r) for r in alignment.op13_alignment(spark, tiny).collect()) == expected_alignment(rows)


def test_alignment_of_texts_that_end_in_one_space(spark):
    rows = [(1, "a "), (2, "two words "), (3, " "), (4, "  "), (5, "end \n "), (6, "x\n "), (7, "a"), (8, " a "), (9, "\u00a0 "), (10, "1,5! ")]
    want = expected_alignment(rows)
    assert all(row[1] for row in want)  # each of them has tokens
    assert collections.Counter(tuple(r) for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


# ---- earlier operators ----


def test_trees_learn_from_all_candidates(spark, monkeypatch):
    seen, cut = [], pii.cut

    def counted(df, name):
        out = cut(df, name)
        seen.append(out.count())
        return out

    monkeypatch.setattr(pii, "cut", counted)
    x = F.array(*[F.col("id") % (i + 2) * F.lit(1.0) for i in range(len(pii.FEATURES))])
    one = F.struct(F.lit(4).alias("k"), F.col("id").cast("int").alias("start"), F.lit(0).alias("end"), (F.col("id") % 2 == 1).alias("valid"), x.alias("x"))
    score, least = pii.fit_trees(spark.range(25_000).select(F.col("id").alias("doc_id"), F.array(one).alias("found")), trees=2)
    assert seen == [25_000] and 4 in least


def test_redaction_of_rows_that_share_an_id_or_have_none(spark):
    rows = [(1, "mail a.b@c.de now", "x"), (1, "mail a.b@c.de now", "y"), (1, "clean", "z"), (None, "write to q@r.st", "n"), (None, None, "n"), (2, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = sorted((r.doc_id or 0, r.text or "", r.tag) for r in pii.redact(docs.withColumnRenamed("_key", "tag")).collect())
    assert got == [(0, "", "n"), (0, "write to [REDACTED]", "n"), (1, "clean", "z"), (1, "mail [REDACTED] now", "x"), (1, "mail [REDACTED] now", "y"), (2, "", "e")]


def test_two_and_three_clause_licences_are_told_apart(spark):
    two, third = licenses.TEMPLATES["BSD-2-Clause-text"], licenses.TEMPLATES["BSD-3-Clause"]
    docs = spark.createDataFrame([(1, "x " + two + " y"), (2, two + " 3. " + third), (3, "as said: " + third)], "doc_id long, text string")
    found = {r.doc_id: {m.license for m in r.matches} for r in licenses.license_matches(docs).collect()}
    assert "BSD-3-Clause" not in found[1] and "BSD-3-Clause" in found[2] and "BSD-2-Clause-text" in found[1] and found[3] == {"BSD-3-Clause"}


def test_a_group_apart_from_its_first_hub_is_one_star_later(spark, monkeypatch):
    """Text 0 shares a shingle with all others and is near none of them; these are near each other."""
    rng = random.Random(3)
    common, body = [f"c{i}" for i in range(5)], [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(common + [f"a{i}" for i in range(40)]))]
    for i in range(1, 150):
        words = list(body)
        words[rng.randrange(50)] = f"v{i}"
        rows.append((i, " ".join(common + words)))
    seen, across = [], minhash._across
    monkeypatch.setattr(minhash, "_across", lambda rest, texts, percent: (met := across(rest, texts, percent), seen.append(met.count()))[0])
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 65).collect()}
    assert out[0] == 0 and {c for i, c in out.items() if i} == {1} and seen[0] < 300


def test_alignment_takes_ordinary_stretches_together():
    """Joined stretches have the ids that each has alone, and cost one call of the library."""
    aligner = alignment.Aligner(open(alignment.A, encoding="utf-8").read(), open(alignment.B, "rb").read())
    rng = random.Random(5)
    odd = [" <|endoftext|>", " naïve,", "\n x", " İx", " 日本", " 3.14's", "  two", " ­", " x y", " a_b-c's", "\t", " ▁x", " 'll", " ", " I'll", " 1st!?"]
    parts = list(dict.fromkeys(odd + [" " + "".join(rng.choice("abcdeéß'.,-3<|>") for _ in range(rng.randint(1, 12))) for _ in range(9000)]))
    assert aligner.joined
    packed, of = aligner._ids_a(parts)
    alone = [aligner.a.tokenizer.encode(p, add_special_tokens=False).ids for p in parts]
    assert np.frombuffer(packed, "<u4").tolist() == [i for ids in alone for i in ids] and of.tolist() == [len(ids) for ids in alone]
    taken = []
    ids, aligner.a.ids = aligner.a.ids, lambda p: (taken.append(p), ids(p))[1]
    aligner._ids_a(parts)
    assert 0 < len(taken) < 20


def test_words_and_parts_that_come_again_outlast_one_turn_of_the_memory(monkeypatch):
    monkeypatch.setattr(token_files, "NEW", 4)
    monkeypatch.setattr(bpe_words, "REMEMBERED", 4)
    with open(token_files.TOKENIZER, encoding="utf-8") as f:
        words = token_files.Words(f.read())
    merged, merge = [], words.library.merge
    words.library.merge = lambda x: merged.append(x) or merge(x)
    first = words.of(b"alpha Beta gamma. 12 delta")
    again = words.of(b"alpha Beta.")  # as many as are remembered came since
    whole = Tokenizer.from_file(token_files.TOKENIZER).encode("alpha Beta gamma. 12 delta alpha Beta.", add_special_tokens=False).ids
    assert [*first, *again] == whole
    assert len(merged) == len(set(merged))


def test_latin_texts_are_lower_cased_before_words_are_remembered():
    with open(token_files.TOKENIZER, encoding="utf-8") as f:
        words = token_files.Words(f.read())
    asked, real = [], words.library.ids
    words.library.ids = lambda w: asked.append(w) or real(w)
    whole = Tokenizer.from_file(token_files.TOKENIZER)
    same = lambda t: words.of(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids
    assert same("Übung ALPHA alpha Alpha. übung alpha.") and asked == ["Übung", "alpha", "alpha.", "übung"]
    # marks that compose with small letters only, special tokens in other cases, and letters whose small form is longer
    odd = ["H̱ ẖ T̈ W̊ Aʾ J̌", "İ İ Iİ ıI", "<|STARTOFTEXT|> a", "A <|startoftext|>B <|EndOfText|>", "ΑΣ ΑΣ. ΑΣA", "ẞ STRASSE ẞA", "DON'T D'L X'S É́A ǅ"]
    assert [t for t in odd if not same(t)] == []
